"""Language identification with interpolated Kneser-Ney character models, one per learned language.

The models learn from a bounded sample of labelled documents (``PER_LANGUAGE`` expected per language, chosen
by a hash of the id); a fifth of the sample is held back to calibrate. N-grams of all languages
share one sorted array of hashes per order, each entry with the log-probability in every language. A text
gets the language of lowest cross-entropy per character; it is rejected where that cross-entropy is
beyond what calibration texts of the language show, or where the languages cannot be told apart.

A text that is null or holds no letter gets ``und``, score 0 and is rejected. Documents without a label or
id are not learned from. Without any labelled text every text gets ``und``. Repeated rows count as often
as they stand there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.llm.frames import pick, slices, tidy

ORDER = 4
PER_LANGUAGE = 2000
UNKNOWN = 1
FIRST_LETTER = 2
UNDECIDED = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so that multiplying keeps codes apart
SLICE_BYTES = 1 << 18  # of text at once: the tables of a slice take about a hundred times as much
LIMIT_QUANTILE, LIMIT_MARGIN, SHORT_ALLOWANCE, LEAST_SCORE = 0.999, 0.5, 6.0, 0.5


def letter_table() -> np.ndarray:
    """True for code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as code points, each after ``ORDER - 1`` line ends, and the text number of each point."""
    lowered = [t.lower() for t in texts]
    pad = "\n" * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(lowered)).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.repeat(np.arange(len(texts)), [len(t) + ORDER - 1 for t in lowered])


def symbol_rows(texts: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, n-gram codes of the highest order and text numbers, at each symbol that is predicted.

    Symbol 0 is a run of anything but letters; the padding before a text is context only.
    """
    points, text = code_points(texts)
    found = symbols[points]
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    padding = np.zeros(len(text), bool)
    for i in range(ORDER - 1):
        padding[i:] |= first[: len(first) - i]
    before = np.zeros_like(found)
    before[1:] = found[:-1]
    keep = padding | (found != 0) | (before != 0)
    found, text, padding = found[keep].astype(np.uint64), text[keep], padding[keep]
    codes = found.copy()
    for back in range(1, ORDER):
        codes[back:] |= found[:-back] << np.uint64(16 * back)
    at = ~padding
    return found[at], codes[at], text[at]


@dataclass
class LanguageModels:
    """Sorted n-gram hashes per order with log-probabilities, and back-off weights of the contexts."""

    languages: list[str]
    symbols: np.ndarray
    vocabulary: int
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    sharpness: float = 1.0
    limits: np.ndarray | None = None

    def log_probabilities(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """One row per code, one column per language; unseen n-grams back off to shorter ones."""
        if order == 0:
            return np.full((len(codes), len(self.languages)), -np.log(self.vocabulary), np.float32)
        at, there = lookup(self.keys[order - 1], codes)
        out = self.logs[order - 1][at]
        missing = np.flatnonzero(~there)
        if len(missing):
            rest = codes[missing]
            lower = self.log_probabilities(rest & mask(order - 1), order - 1)
            if order > 1:
                where, known = lookup(self.contexts[order - 1], rest >> np.uint64(16))
                lower = lower + np.where(known[:, None], self.backoffs[order - 1][where], 0)
            else:
                lower = lower + self.backoffs[0]
            out[missing] = lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol in nats for each text and language, and the letters of each text."""
        letters, sums, counts = (np.zeros(n) for n in (len(texts), (len(texts), len(self.languages)), len(texts)))
        symbols, codes, text = symbol_rows(texts, self.symbols)
        if len(codes):
            logs = self.log_probabilities(codes)
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            sums[text[first]] = np.add.reduceat(logs, first, axis=0, dtype=np.float64)
            counts = np.bincount(text, minlength=len(texts))
            letters = np.bincount(text, symbols > 0, minlength=len(texts))
        return -sums / np.maximum(counts, 1)[:, None], letters

    def predict(self, texts: list[str]) -> pd.DataFrame:
        """Columns lang_pred, score, cross_entropy and rejected."""
        out = pd.DataFrame({"lang_pred": [UNDECIDED] * len(texts), "score": 0.0, "cross_entropy": np.nan, "rejected": True})
        if not self.languages or not texts:
            return out
        entropy, letters = self.entropies(texts)
        best = entropy.argmin(axis=1)
        low = entropy.min(axis=1)
        score = 1 / np.exp(-self.sharpness * (entropy - low[:, None])).sum(axis=1)
        limit = self.limits[best] + SHORT_ALLOWANCE / np.sqrt(np.maximum(letters, 1))
        some = letters > 0
        out["lang_pred"] = np.where(some, np.array(self.languages, object)[best], UNDECIDED)
        out["score"] = np.where(some, score, 0.0)
        out["cross_entropy"] = np.where(some, low, np.nan)
        out["rejected"] = ~some | (low > limit) | (score < LEAST_SCORE)
        return out


def mask(order: int) -> np.uint64:
    return np.uint64((1 << 16 * order) - 1)


def lookup(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each code's hash in a sorted hash array, and whether it stands there."""
    hashes = codes * MIX
    at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
    return at, keys[at] == hashes if len(keys) else np.zeros(len(codes), bool)


def fit(languages: list[str], alphabet: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]]) -> LanguageModels:
    """Interpolated Kneser-Ney from (codes, counts) of the highest order for each language."""
    symbols = symbol_table(alphabet)
    vocabulary = FIRST_LETTER + len(alphabet)
    grams = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: in how many different n-grams of one more symbol
        grams[order] = [np.unique(codes & mask(order), return_counts=True) for codes, _ in grams[order + 1]]
    model = LanguageModels(languages, symbols, vocabulary, [], [], [], [])
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([codes for codes, _ in grams[order]]))
        union = union[np.argsort(union * MIX)]
        heads = np.unique(np.concatenate([codes >> np.uint64(16) for codes, _ in grams[order]]))
        heads = heads[np.argsort(heads * MIX)]
        lower = np.exp(model.log_probabilities(union & mask(order - 1), order - 1))
        logs, backoffs = np.zeros((len(union), len(languages)), np.float32), np.zeros((len(heads), len(languages)), np.float32)
        for i, (codes, n) in enumerate(grams[order]):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
            count, _ = spread(union, codes, n)
            total, _ = spread(heads, codes >> np.uint64(16), n)
            kinds, _ = spread(heads, codes >> np.uint64(16), np.ones(len(n)))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            at, _ = lookup(heads * MIX, union >> np.uint64(16))
            seen = np.maximum(count - discount, 0) / np.maximum(total[at], 1)
            logs[:, i] = np.log(seen + weight[at] * lower[:, i])
            backoffs[:, i] = np.log(weight)
        model.keys.append(union * MIX)
        model.logs.append(logs)
        model.contexts.append(heads * MIX)
        model.backoffs.append(backoffs)
    return model


def spread(entries: np.ndarray, codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the values of each entry's code; entries are in the order of their hashes."""
    at, there = lookup(entries * MIX, codes)
    return np.bincount(at[there], np.asarray(values)[there], minlength=len(entries)), there


def symbol_table(alphabet: np.ndarray) -> np.ndarray:
    """Symbol of every code point: 0 for no letter, 1 for a letter that was not learned."""
    symbols = np.where(letter_table(), UNKNOWN, 0).astype(np.uint16)
    symbols[alphabet] = np.arange(FIRST_LETTER, FIRST_LETTER + len(alphabet), dtype=np.uint16)
    return symbols


def sample(df: DataFrame, key: str, text: str, lang: str, learn: Column | None, per_language: int) -> DataFrame:
    """Labelled rows chosen by a hash of the key, about ``per_language`` of each language; fold 0 calibrates."""
    names = {"key": key, "text": text, "lang": lang}
    rows = pick(df.withColumn("_learn", F.lit(True) if learn is None else learn), **names, learn="_learn")
    rows = rows.where("learn and key is not null and text is not null and lang is not null")
    share = {r["lang"]: per_language / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / (1 << 30)
    picked = F.lit(False)
    for name, part in share.items():
        picked = picked | ((F.col("lang") == name) & (chance < part))
    return rows.where(picked).select("text", "lang", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(5)).alias("fold"))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None, per_language: int = PER_LANGUAGE) -> LanguageModels:
    """Models of every label value found where ``learn`` holds; what reaches the driver is bounded by the sample."""
    rows = sample(df, key, text, lang, learn, per_language)
    kept = rows.where("fold <> 0")
    points = kept.select(F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    found = [ord(r["c"]) for r in points.orderBy(F.desc("n"), "c").limit((1 << 16) - FIRST_LETTER).collect() if len(r["c"]) == 1 and r["c"].isalpha()]
    alphabet = np.array(sorted(found), np.int64)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = symbol_table(alphabet)
        for part in slices(batches, 0, SLICE_BYTES):
            texts, names = part.column(0).to_pylist(), np.array(part.column(1).to_pylist(), object)
            _, codes, text_of = symbol_rows(texts, symbols)
            for name in sorted(set(names)):
                code, n = np.unique(codes[names[text_of] == name], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], names=["lang", "code", "n"]
                )

    grams = kept.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(grams.column("lang").to_pylist()))
    if not names:
        return LanguageModels([], symbol_table(alphabet), FIRST_LETTER + len(alphabet), [], [], [], [])
    lang_of, codes, n = (grams.column(c).to_numpy() for c in ("lang", "code", "n"))
    model = fit(names, alphabet, [(codes[lang_of == x].view(np.uint64), n[lang_of == x]) for x in names])
    calibrate(model, rows.where("fold = 0").select("text", "lang"))
    return model


def calibrate(model: LanguageModels, held: DataFrame) -> None:
    """Sharpness of the score by likelihood, and for each language the cross-entropy beyond which texts are rejected."""
    spread_model = held.sparkSession.sparkContext.broadcast(model)
    width = len(model.languages)

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, SLICE_BYTES):
            entropy, letters = spread_model.value.entropies(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(entropy)), pa.array(letters)], names=["lang", "entropy", "letters"])

    measured = held.mapInArrow(measure, "lang string, entropy array<double>, letters double").where("letters > 0").toPandas()
    measured = measured[measured["lang"].isin(model.languages)]
    model.limits = np.full(width, np.inf)
    if not len(measured):
        return
    entropy = np.stack(measured["entropy"].to_list())
    label = measured["lang"].map(model.languages.index).to_numpy()
    own = entropy[np.arange(len(label)), label]
    sizes = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]
    model.sharpness = max(sizes, key=lambda s: -np.log(np.exp(-s * (entropy - own[:, None])).sum(axis=1)).sum())
    allowance = SHORT_ALLOWANCE / np.sqrt(np.maximum(measured["letters"].to_numpy(), 1))
    everywhere = np.quantile(own - allowance, LIMIT_QUANTILE)
    for i in range(width):
        mine = (own - allowance)[label == i]
        model.limits[i] = LIMIT_MARGIN + max(everywhere, np.quantile(mine, LIMIT_QUANTILE) if len(mine) else everywhere)


def predict(df: DataFrame, model: LanguageModels, text: str = "text", into: str = "language") -> DataFrame:
    """All rows and columns with a struct column: lang_pred, score, cross_entropy and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = ["lang_pred", "score", "cross_entropy", "rejected"]

    @F.arrow_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def judge(texts: pa.Array) -> pa.Array:
        done = [shared.value.predict([t or "" for t in part.column(0).to_pylist()]) for part in slices([pa.record_batch([texts], ["t"])], 0, SLICE_BYTES)]
        found = pd.concat(done, ignore_index=True) if done else shared.value.predict([])
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(found[c], k) for c, k in zip(names, kinds)], names=names)

    at = df.columns.index(text)
    apart = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    judged = apart.withColumn("_judged", judge(F.col(f"_{at}")))
    return judged.toDF(*df.columns, into)
