"""From raw documents to training tokens: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a frame; its result is written as Parquet in the shared
folder and read again before the next stage starts, so a lost executor never costs more than one stage.
All but the last return the columns of ``documents``. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel.llm import decontaminate, language, lines, simhash
from caravel.llm.frames import numbered, table, unused, written
from caravel.llm.queries import token_digests


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the language models reject; without labelled text there are no models, and all stay.

    Null, empty and letterless texts are rejected. Rows are judged by their text alone, so repeated rows and shared ids make no
    difference, and long texts are read as a whole.
    """
    model = language.train(docs)
    if not model.languages:
        return docs
    name = unused(docs, "_language")
    return language.predict(docs, model, into=name).where(~F.col(f"{name}.rejected")).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete blocks of lines that an earlier document has; documents left with nothing of what they had go.

    Null and empty texts and rows without an id stay as they are; rows that share an id lose what smaller ids have.
    """
    name = unused(docs, "_dedup")
    text, cut = F.col(f"{name}.text"), F.col(f"{name}.n_removed") > 0
    emptied = cut & (F.trim(text, F.lit(lines.BLANKS + "\n")) == "")
    kept = lines.deduplicate(docs, into=name).where(F.coalesce(~emptied, F.lit(True)))
    length = F.when(cut, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumns({"text": text, "n_chars": length}).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose SimHash fingerprints link, the one with the smallest id stays.

    Shingle length and bit distance are those of the operator's contract, its defaults. Rows are judged one by one: of repeated
    rows one stays, rows that share an id stay apart where their texts are, and a row without an id stays only if no
    other of its group has one. Texts without words, null and empty ones too, are one group.
    """
    rows, number = numbered(docs, "near-dedup")
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", F.col(number).alias("number"))
    found = simhash.near_duplicates(rows.select(row.alias("row"), "text"), key="row")
    gone = found.where("row <> component_id").select(F.col("row.number").alias(number))
    return rows.join(gone, number, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; each row is judged by its own text, whatever its id."""
    rows, number = numbered(docs, "decontamination")
    gone = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), key=number).select(number).distinct()
    return rows.join(gone, number, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of the kept documents, as digests and counts; a null text has no ids, repeated rows are encoded one by one."""
    return token_digests(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE encoding and decoding", encode),
]

# Language models, alignment and bit-wise fingerprints have no SQL form; tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
