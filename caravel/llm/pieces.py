"""SentencePiece encoding that knows, for every piece, the bytes of the original text it stands for, and decoding.

A model's normaliser maps strings by a compiled character map: a double-array trie of source strings beside their
replacements. Here the text is walked from left to right; at every place the longest source string that the map has
replaces itself, any other character stays, and each byte written remembers the byte of the text it came from. Blanks
are then squeezed, escaped and prefixed as the model says, and the alignment follows each step. The segmenter, which is the library with its
normaliser switched off, cuts the normalised text into pieces; the ends of a piece, looked up in the alignment, are its span
in the original bytes. Spans are in order, and the last one ends where the text ends or where its trailing blanks begin. Pieces that
stand for one byte of a longer character (byte fallback) have empty spans but for the last, which has the whole character.

Where no piece of a BPE vocabulary reaches over the start of a word, words do not influence each other, so long texts are
segmented in parts of about ``PART_BYTES``. A null text counts as empty and gives no ids. Repeated rows are encoded one by one; an empty table
gives an empty result. Names of special pieces in a text are ordinary text. Models with symbols of the user's own are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from caravel.llm.frames import pick, slices

MODEL = "piece_bpe_32k.model"
PART_BYTES = 200_000
# Fixed values of the model's file format: numbers of fields, types of pieces, kinds of models.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, TYPE = 1, 3
NORMAL_PIECE, USER_PIECE, BYTE_PIECE = 1, 4, 6
MODEL_KIND, BLANK_AS_SUFFIX, BYTE_FALLBACK, BPE = 3, 24, 35, 2
CHARACTER_MAP, DUMMY_PREFIX, SQUEEZE_BLANKS, ESCAPE_BLANKS = 2, 3, 4, 5
BLANK = "▁".encode()
WORD_START = re.compile(b"(?<!%b)%b" % (BLANK, BLANK))


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message; nested messages stay bytes."""

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    at = 0
    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, message[at : at + size]
        at += size


class CharacterMap:
    """Longest-prefix look-up in a compiled character map."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.texts = compiled[4 + size :]
        self.heads = self._heads() if self.units else None

    def _offset(self, unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        """The node after a byte, before its own offset is applied."""
        there = node ^ byte
        return there if there < len(self.units) and self.units[there] & 0x800000FF == byte else None

    def _heads(self) -> re.Pattern:
        """Matches wherever a source string may begin, by its first two bytes."""
        root, ways = self._offset(self.units[0]), []
        for first in range(1, 256):
            there = self._step(root, first)
            if there is not None:
                unit = self.units[there]
                seconds = [s for s in range(1, 256) if self._step(there ^ self._offset(unit), s) is not None]
                more = b"" if unit >> 8 & 1 else b"[" + b"".join(re.escape(bytes([s])) for s in seconds) + b"]"
                ways.append(re.escape(bytes([first])) + more)
        return re.compile(b"|".join(ways), re.DOTALL)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """End and replacement of the longest source string that begins here."""
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(data)):
            there = self._step(node, data[i]) if data[i] else None
            if there is None:
                break
            unit = self.units[there]
            node = there ^ self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end, text = found
        return end, self.texts[text : self.texts.index(b"\0", text)]

    def replaced(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The text after replacement, and for each of its bytes the start of what it came from."""
        raw = np.frombuffer(data, np.uint8)
        source = np.maximum.accumulate(np.where(raw & 0xC0 == 0x80, 0, np.arange(len(raw), dtype=np.int32))) if len(raw) else np.zeros(0, np.int32)
        if self.heads is None:
            return data, source
        out, origin, done, at = [], [], 0, 0
        while head := self.heads.search(data, at):
            at = head.start()
            longest = self.longest(data, at)
            if longest is None:
                at += 1
                continue
            out += [data[done:at], longest[1]]
            origin += [source[done:at], np.full(len(longest[1]), at, np.int32)]
            at = done = longest[0]
        return b"".join([*out, data[done:]]), np.concatenate([*origin, source[done:]])


class Encoder:
    """A model's normaliser with alignment, its segmenter, and its decoder."""

    def __init__(self, model: bytes, part_bytes: int = PART_BYTES):
        spec: dict[int, dict] = {TRAINER: {}, NORMALIZER: {}}
        pieces = []
        for field, value in fields(model):
            if field == PIECES:
                pieces.append(dict(fields(value)))
            elif field in spec:
                spec[field] |= dict(fields(value))
        kinds = [p.get(TYPE, NORMAL_PIECE) for p in pieces]
        if USER_PIECE in kinds:
            raise ValueError("models with symbols of the user's own are not supported")
        rules, trainer = spec[NORMALIZER], spec[TRAINER]
        self.characters = CharacterMap(rules.get(CHARACTER_MAP, b""))
        self.prefix, self.squeeze, self.escape = (bool(rules.get(f, 1)) for f in (DUMMY_PREFIX, SQUEEZE_BLANKS, ESCAPE_BLANKS))
        self.suffix = bool(trainer.get(BLANK_AS_SUFFIX, 0))
        self.sizes = np.array([1 if kind == BYTE_PIECE else len(p[PIECE]) for p, kind in zip(pieces, kinds)], np.int64)
        self.fallback = bool(trainer.get(BYTE_FALLBACK, 0))
        crossing = any(WORD_START.search(p[PIECE], 1) for p, kind in zip(pieces, kinds) if kind == NORMAL_PIECE)
        self.part_bytes = part_bytes if trainer.get(MODEL_KIND, 1) == BPE and self.escape and not crossing else None
        # A later field of the same number overrides an earlier one: no map, no prefix, no squeezing, no escaping.
        plain = bytes([CHARACTER_MAP << 3 | 2, 0, DUMMY_PREFIX << 3, 0, SQUEEZE_BLANKS << 3, 0, ESCAPE_BLANKS << 3, 0])
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model + bytes([NORMALIZER << 3 | 2, len(plain)]) + plain)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)

    def normalised(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and their alignment: the place in the text that each comes from, and one more for the end."""
        text, source = self.characters.replaced(data)
        end = len(data)
        if self.squeeze:
            raw = np.frombuffer(text, np.uint8)
            blank = raw == 0x20
            keep = ~(blank & np.append(True, blank[:-1])) if len(raw) else blank
            solid = np.flatnonzero(~blank)
            if not len(solid):
                return b"", np.array([end], np.int32)
            text, source = raw[keep].tobytes(), source[keep]
        if not text:
            return b"", np.array([end], np.int32)
        mark = BLANK if self.escape else b" "
        if self.escape:
            source = np.repeat(source, np.where(np.frombuffer(text, np.uint8) == 0x20, len(BLANK), 1))
            text = text.replace(b" ", BLANK)
        if self.prefix and not self.suffix:
            text, source = mark + text, np.concatenate([np.full(len(mark), source[0], np.int32), source])
        while self.squeeze and text.endswith(mark):
            text, end = text[: -len(mark)], int(source[len(text) - len(mark)])
            source = source[: len(text)]
        if self.prefix and self.suffix:
            text, source = text + mark, np.concatenate([source, np.full(len(mark), end, np.int32)])
        return text, np.append(source, np.int32(end))

    def parts(self, text: bytes) -> Iterator[bytes]:
        """Cut at the start of a word after every so many bytes."""
        start = 0
        while self.part_bytes and len(text) - start > self.part_bytes:
            cut = WORD_START.search(text, start + self.part_bytes)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def segmented(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of a normalised text, and where each ends in it."""
        ids, ends, done = [], [], 0
        for part in self.parts(text):
            if self.fallback:
                found = np.asarray(self.segmenter.encode(part.decode(), return_type="numpy"), np.int32)
                stops = np.cumsum(self.sizes[found])
            else:  # an unknown piece has any length
                told = self.segmenter.encode(part.decode(), return_type="proto").pieces
                found, stops = np.array([p.id for p in told], np.int32), np.array([p.end for p in told], np.int64)
            ids.append(found)
            ends.append(stops + done)
            done += len(part)
        return np.concatenate(ids), np.concatenate(ends)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first byte and the end of each piece in the original text."""
        normal, source = self.normalised((text or "").encode())
        if not normal:
            return (np.zeros(0, np.int32),) * 3
        ids, ends = self.segmented(normal)
        return ids, source[np.append(0, ends[:-1])], source[ends]

    def decode(self, ids) -> str:
        return self.whole.decode(ids if isinstance(ids, np.ndarray) and len(ids) else list(ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of one model file, built once in each Python worker."""
    with open(path, "rb") as model:
        return Encoder(model.read())


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int32()))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: key, n_tokens, ids, starts and ends (byte spans in the text), and the text decoded from the ids."""
    path = path or public_tokenizers.path(MODEL)
    rows = pick(df, key=key, text=text)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for part in slices(batches, 1):
            coded = [model.encode(t.as_py()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(c[0]) for c in coded], pa.int64()),
                    *[_lists([c[i] for c in coded]) for i in range(3)],
                    pa.array([model.decode(c[0]) for c in coded], pa.string()),
                ],
                names=["key", "n_tokens", "ids", "starts", "ends", "decoded"],
            )

    out = f"key {kind}, n_tokens bigint, ids array<int>, starts array<int>, ends array<int>, decoded string"
    return rows.mapInArrow(run, out).withColumnRenamed("key", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Texts of stored ids (arrays of integers; a null array counts as empty): key and decoded."""
    path = path or public_tokenizers.path(MODEL)
    rows = pick(df, key=key, ids=ids)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for part in batches:
            texts = [model.decode(x.as_py() or []) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["key", "decoded"])

    return rows.mapInArrow(run, f"key {kind}, decoded string").withColumnRenamed("key", key)
