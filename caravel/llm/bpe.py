"""Byte-level BPE: texts to token ids by a public rank file, and ids back to the exact bytes.

A null text counts as empty and gives no tokens. Repeated rows are encoded one by one; an empty table
gives an empty result. Strings that look like special tokens are ordinary text. A text of any length is
cut at safe boundaries first, so that no call holds more than about ``PIECE_CHARS`` characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from caravel.llm.frames import pick, slices, tidy

RANKS = "byte_bpe_50k.tiktoken"
PIECE_CHARS = 200_000

# No match of the pattern spans a visible character followed by white space: only a leading space can
# be white space in a match that also holds something visible. The lookahead for the end of a run
# of white space looks right only, and the left part ends with a visible character.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n])")


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of one rank file, built once in each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text at the first safe boundary after every ``most`` characters."""
    start = 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def token_ids(encoding: tiktoken.Encoding, text: str, most: int = PIECE_CHARS) -> np.ndarray:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    parts = [np.array(encoding.encode_ordinary(piece), dtype="<u4") for piece in pieces(text, most)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode(
    df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """One row per input row: key, n_tokens, ids (binary, four bytes an id) and the bytes decoded from the ids."""
    path = path or public_tokenizers.path(RANKS)
    rows = pick(df, key=key, text=text)
    kind = rows.schema["key"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(path, pattern)
        for part in slices(batches, 1):
            ids = [token_ids(encoding, t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array([encoding.decode_bytes(x) for x in ids], pa.binary()),
                ],
                names=["key", "n_tokens", "ids", "decoded"],
            )

    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint, ids binary, decoded binary").withColumnRenamed("key", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Bytes of stored ids: key and decoded (binary, null ids count as none). The bytes need not be valid UTF-8."""
    path = path or public_tokenizers.path(RANKS)
    rows = pick(df, key=key, ids=ids)
    kind = rows.schema["key"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(path, public_tokenizers.PATTERN)
        for part in slices(batches, 1):
            texts = [encoding.decode_bytes(np.frombuffer(x or b"", "<u4")) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], names=["key", "decoded"])

    return rows.mapInArrow(run, f"key {kind}, decoded binary").withColumnRenamed("key", key)
