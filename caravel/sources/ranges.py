"""Records that may span lines, read from byte ranges of a file in parallel.

Spark cuts a file into ranges and each range into pieces that end with a separator. Whether a separator ends a
record depends on what stands before it, back to the start of the file: an open quote, the depth of brackets. A piece is
therefore summed up by what it does to that state, whatever the state is (it sets it, flips it, or leaves it), each
range by the pieces in it, and a prefix over the ranges of a file, a few numbers each, tells the state in which
every range really starts. Then the pieces are put together: records inside a range where they are, and those that cross into the next
range from their parts, at most two a range. No task holds more than one range or one record.

The first pass moves numbers only, the second the text once by range and once by record. Everything is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = ["file", "block"]
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'  # what quotes may hold; a doubled quote is one of the text


def pieces(spark: SparkSession, path: str, separator: str, **options: str) -> DataFrame:
    """Columns file, block (first byte of the range), at (order in the range) and value (without its separator)."""
    text = spark.read.options(**options).text(path, lineSep=separator)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return text.select(*where, F.monotonically_increasing_id().alias("at"), "value")


def with_state(frame: DataFrame, of: list[str], by: str) -> DataFrame:
    """Columns known (state before a row, if a row before it sets one) and parity (flips before it), from fixed and flips."""
    to_here = Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    counted = frame.withColumn("_flips", F.sum("flips").over(to_here))
    mark = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "_flips"))
    last, so_far = F.last(mark, ignorenulls=True).over(before), F.coalesce(F.max("_flips").over(before), F.lit(0))
    return counted.withColumn("_last", last).withColumn("parity", so_far).select(
        *frame.columns, ((F.col("_last.fixed") + F.col("parity") - F.col("_last._flips")) % 2).alias("known"), "parity"
    )


def starts(told: DataFrame) -> DataFrame:
    """For each range the state it starts in (0 outside, 1 inside) and the sums over it of d0 and d1 under that state."""
    after = F.coalesce("fixed", (F.col("known") + F.col("flips")) % 2)
    out = (F.coalesce("known", F.lit(0)) + F.when(F.col("known").isNull(), F.col("parity")).otherwise(0)) % 2
    other = F.when(F.col("known").isNull(), 1 - out).otherwise(out)  # the state of a piece if the range starts inside
    delta = [F.sum(F.when(s == 0, F.col("d0")).otherwise(F.col("d1"))) for s in (out, other)]
    ranges = told.groupBy(*RANGE).agg(
        F.max_by(after, "at").alias("fixed"), (F.sum("flips") % 2).alias("flips"), delta[0].alias("d0"), delta[1].alias("d1")
    )
    ranges = with_state(ranges, ["file"], "block")
    inside = F.coalesce("known", F.col("parity") % 2)
    return ranges.select(*RANGE, inside.alias("inside"), F.when(inside == 0, F.col("d0")).otherwise(F.col("d1")).alias("delta"))


def records(parts: DataFrame, ends: Column, depth: str, separator: str) -> DataFrame:
    """Columns file, first (of its file), finished, last_depth and text: pieces put together up to those that end a record."""
    before = Window.partitionBy(*RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cut = parts.withColumn("ends", ends.cast("int")).withColumn("n", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    in_order = F.sort_array(F.collect_list(F.struct("at", "value")))
    grouped = cut.groupBy(*RANGE, "n").agg(
        F.array_join(in_order["value"], separator).alias("text"),
        F.max("ends").alias("finished"), F.max_by(depth, "at").alias("last_depth"),
    )
    crossing = (F.col("n") == 0) | (F.col("finished") == 0)
    inner = grouped.where(~crossing).select("file", F.lit(False).alias("first"), F.lit(True).alias("finished"), "last_depth", "text")
    order = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, -1)
    edges = grouped.where(crossing).withColumn("id", F.coalesce(F.sum("finished").over(order), F.lit(0)))
    in_order = F.sort_array(F.collect_list(F.struct("block", "n", "text")))
    joined = edges.groupBy("file", "id").agg(
        F.array_join(in_order["text"], separator).alias("text"),
        F.max("finished").alias("finished"), F.max_by("last_depth", F.struct("block", "n")).alias("last_depth"),
    )
    whole = joined.select("file", (F.col("id") == 0).alias("first"), (F.col("finished") == 1).alias("finished"), "last_depth", "text")
    return inner.unionByName(whole)


def _fields(then: str) -> str:
    """A pattern of whole fields, each with its comma, and what follows them."""
    return rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?+,)*+{then}'


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Column record: the text of every record of delimited files, the header of each file left out.

    A quote opens at the start of a field only, and closes where it is not doubled; elsewhere it is text. Line ends
    outside quotes are LF or CRLF, those inside stay as they are. Blank lines between records are passed over. A quote that is never
    closed makes the rest of its file one record.
    """
    opened = _fields(rf'"{_INSIDE}$')
    from_outside = F.col("value").rlike(f"^{opened}")
    from_inside = F.col("value").rlike(rf'^{_INSIDE}(?:$|"(?!")[^,]*+,{opened})')
    told = pieces(spark, path, "\n").withColumn("none", F.lit(0))
    told = told.withColumn("a", from_outside.cast("int")).withColumn("b", from_inside.cast("int"))
    told = told.withColumn("fixed", F.when(F.col("a") == F.col("b"), F.col("a"))).withColumn("flips", (F.col("a") > F.col("b")).cast("int"))
    told = with_state(told.withColumn("d0", F.lit(0)).withColumn("d1", F.lit(0)), RANGE, "at")
    met = told.join(starts(told).select(*RANGE, "inside"), RANGE)
    state = F.coalesce("known", (F.col("inside") + F.col("parity")) % 2)
    ends = F.when(state == 0, F.col("a")).otherwise(F.col("b")) == 0
    found = records(met, ends, "none", "\n").where("not first")
    return found.select(F.regexp_replace("text", r"\r$", "").alias("record")).where(F.trim("record") != "")


def _count(text: Column, *signs: str) -> Column:
    """How many of the signs a text holds."""
    lengths = [F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit(""))) for sign in signs]
    return reduce(lambda a, b: a + b, lengths)


def json_elements(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Column data (VARIANT): the elements of files that each hold one JSON array, whatever their layout.

    Pieces end with closing braces; one outside strings at the depth of the array ends an element. Values between
    objects are read with the object that follows. A file that is no array, is cut off or has something
    else around its elements stops the job.
    """
    told = pieces(spark, path, "}", **options)
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"\\.", "")).otherwise(F.col("value"))
    parts = F.split(plain, '"')
    told = told.withColumn("parts", parts).withColumn("flips", (F.size("parts") - 1) % 2).withColumn("fixed", F.lit(None).cast("int"))

    def net(odd: int) -> Column:
        """Brackets opened less closed outside strings, the brace at the end included."""
        outside = F.array_join(F.filter("parts", lambda _, i: i % 2 == odd), "")
        return _count(outside, "[", "{") - _count(outside, "]") - F.when(F.col("flips") == odd, 1).otherwise(0)

    told = told.withColumn("d0", net(0)).withColumn("d1", net(1)).drop("parts")
    told = with_state(told, RANGE, "at")
    file = Window.partitionBy("file")
    earlier = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = starts(told).withColumn("total", F.sum("delta").over(file)).withColumn("depth", F.coalesce(F.sum("delta").over(earlier), F.lit(0)))
    # The last piece of a file has no brace, but was counted with one.
    broken = F.raise_error(F.concat(F.lit("not one whole JSON array: "), F.col("file"))).cast("bigint")
    ranges = ranges.select(*RANGE, "inside", F.when(F.col("total") == -1, F.col("depth")).otherwise(broken).alias("depth"))
    met = told.join(ranges, RANGE)
    state = F.coalesce("known", (F.col("inside") + F.col("parity")) % 2)
    met = met.withColumn("delta", F.when(state == 0, F.col("d0")).otherwise(F.col("d1"))).withColumn("out", (state + F.col("flips")) % 2 == 0)
    to_here = Window.partitionBy(*RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("depth", F.col("depth") + F.sum("delta").over(to_here))
    found = records(met, F.col("out") & (F.col("depth") == 1), "depth", "}")
    opening = F.when(F.col("first"), r"\[").otherwise(",")
    last = ~F.col("finished")
    whole = F.concat("text", F.when(last, "").otherwise("}"))
    inner = F.when(last, F.regexp_replace(whole, r"\]\s*+$", "")).otherwise(whole)
    fits = F.when(F.col("first"), whole.rlike(r"^\s*+\[")).when(last & whole.rlike(r"^\s*+\]\s*+$"), True).otherwise(whole.rlike(r"^\s*+,"))
    fits = fits & (F.col("finished") | whole.rlike(r"\]\s*+$"))
    body = F.regexp_replace(inner, F.lit(r"^\s*+[\[,]"), F.lit(""))
    # Behind a comma there is a value: an empty list of values is one only in an empty array, or when the array ends.
    empty = (body.rlike(r"^\s*+$")) & ~(F.col("first") | whole.rlike(r"^\s*+\]\s*+$"))
    stop = F.raise_error(F.concat(F.lit("not one whole JSON array: "), F.col("file"))).cast("string")
    # Nearly every element stands between a comma and a brace and needs none of these patterns.
    plain = ~F.col("first") & F.col("finished") & F.startswith("text", F.lit(","))
    checked = F.when(plain, F.concat(F.lit("["), F.substring("text", 2, 2**31 - 1), F.lit("}]")))
    checked = checked.when(fits & ~empty, F.concat(F.lit("["), body, F.lit("]"))).otherwise(stop)
    return found.select(F.explode(F.from_json(checked, "array<variant>", {"mode": "FAILFAST"})).alias("data"))
