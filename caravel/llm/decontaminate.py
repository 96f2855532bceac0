"""Benchmark decontamination by templates: numbers, units and names become typed placeholders.

Documents and benchmark items are cut into words at white space and each word is canonicalised, so word i
of a text is token i of its template. Windows of ``size`` template tokens are hashed and joined. Joined
windows of one item at one offset belong together; over the words that they hold, each slot value of the
item must always stand for the same value in the document, punctuation around it aside. A document is
contaminated by an item when at least ``least`` consistent windows (all of them, if the item has fewer) match
at one offset: the passage itself, or the question with other numbers, names or units. The first word of an item
counts as a word and as a name, since a document may have it in mid-sentence.

Verbatim copies need no template: windows of plain words, whatever their case and the punctuation around them, count by
themselves, and no other place of the document can speak against them. An item with fewer than ``least`` telling
windows of plain words (short questions, arithmetic, lists) must be there as a whole, however short it is.

Only DataFrame and SQL functions run here. The join carries no hint: Spark broadcasts the benchmark's
windows while they are below its size threshold and shuffles both sides beyond it.

A window of a template that holds fewer than ``literals`` literal words says nothing and never matches. Null and empty texts have no windows; rows without an id are not reported. Rows
that share an id are one document: windows of any of them count, slots are compared within each. Empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.llm.frames import pick, written

SIZE, LEAST, LITERALS = 8, 6, 4

# Unit words and signs that become a placeholder when they follow a number.
UNITS = (
    "%", "$", "€", "£", "°c", "°f", "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "seconds", "min", "minutes",
    "h", "hours", "days", "weeks", "months", "years", "miles", "feet", "inches", "pounds", "dollars", "euros", "percent", "mph", "km/h",
    "w", "kw", "v", "hz", "j", "n",
)

# Every pattern starts with what is rare in a text, so that most places are passed over after one character.
BLANKS = r"[<> \t\n\x0B\f\r]+"  # the placeholders' own signs count as blanks
# Runs of them that are more than one blank alone; most of a text's blanks stay as they are and cost no match.
UNEVEN = r"[<>\t\n\x0B\f\r][<> \t\n\x0B\f\r]*| [<> \t\n\x0B\f\r]+"
NUMBER = r"[0-9]+(?:[.,:/-][0-9]+)*"
# A capital after a blank and a word that does not end a sentence starts a name, unless the word is all capitals.
NAME = r"\p{Lu}(?<=[^.!?:; ] \p{Lu})(?!\p{Lu})[\p{L}'’-]*"
OPENING, CLOSING = r"[\"'(\[{«„“‘]+", r"[.,!?:;\"')\]}»“”’…]+"  # what may stand around a word without being part of it
PLAIN = r"^[^0-9]*\p{L}[^0-9]*$"
SIGNS = r"[!-/:;=?@\[-`{-~«»“”‘’„–—…]+"
SIGN_LIST = "!\"#$%&'()*+,-./:;=?@[\\]^_`{|}~«»“”‘’„–—…"  # the same, one by one
NUM, UNIT, PERSON = "<0>", "<1>", "<2>"  # digits, so that no later pass takes a placeholder for a word


def word_text(text: Column) -> Column:
    """The text with single blanks between words."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN, " "))


def template_text(words: Column) -> Column:
    """Words turned into template tokens one for one, blanks kept."""
    units = "|".join(sorted((u.replace("$", r"\$") for u in UNITS), key=len, reverse=True))
    out = F.lower(F.regexp_replace(F.regexp_replace(words, NUMBER, NUM), NAME, PERSON))
    return F.translate(F.regexp_replace(out, rf"({NUM} ?)(?:{units})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}"), SIGN_LIST, "")


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, words and tokens (arrays of one length)."""
    rows = pick(df, key=key, text=text).where("key is not null")
    cut = rows.select("key", word_text(F.col("text")).alias("plain"))
    return cut.select("key", F.split("plain", " ").alias("words"), F.split(template_text(F.col("plain")), " ").alias("tokens"))


def windows(told: DataFrame, size: int) -> DataFrame:
    """Columns key, at and window (hash of ``size`` template tokens) for every window of the templates.

    Windows are hashed from windows half as long, two overlapping ones for a size that is no power of two, so the
    work is linear in the text: a slice per window would copy the whole array each time. Each level is a
    column of its own, which the next one uses twice.
    """
    found = told.select("key", F.size("tokens").alias("n"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    held = 1
    while held < size:
        step = min(held, size - held)
        pairs = F.zip_with("hashes", F.slice("hashes", step + 1, F.col("n")), lambda a, b: F.xxhash64(a, b))
        found = found.select("key", "n", pairs.alias("hashes"))
        held += step
    whole = F.slice("hashes", 1, F.greatest(F.col("n") - size + 1, F.lit(0)))
    return found.select("key", F.posexplode(whole).alias("at", "window"))


def slots(first: Column, size: Column) -> Column:
    """Places of the placeholders among ``size`` tokens from place ``first`` (from 0)."""
    places = F.sequence(first, first + size - 1)
    return F.filter(places, lambda i: F.element_at("tokens", i + 1).contains("<"))


def bare(word: Column) -> Column:
    """A word in lower case without the punctuation around it."""
    return F.lower(F.regexp_replace(word, f"^{OPENING}|{CLOSING}$", ""))


def by_templates(docs: DataFrame, benchmark: DataFrame, size: int, least: int, literals: int) -> DataFrame:
    """Pairs (key, item, n_windows, item_windows, n_slots, changed_slots) whose templates match, from frames (key, text)."""
    items = written(tokens(benchmark, "key", "text"), "items")
    literal = F.size(F.filter(F.slice("tokens", F.col("at") + 1, size), lambda t: (t != "") & ~t.contains("<"))) >= literals
    telling = windows(items, size).join(items, "key").where(literal).select("key", "at", "window")
    # The first word as it would be canonicalised behind another word.
    within = F.split(template_text(F.concat(F.lit("a "), F.array_join("words", " "))), " ")
    behind = items.select("key", F.slice(within, 2, F.size("tokens")).alias("tokens"))
    opening = windows(behind, size).where("at = 0").join(telling.where("at = 0").select("key"), "key", "left_semi")
    counted = telling.withColumn("behind", F.lit(False)).unionByName(opening.withColumn("behind", F.lit(True)))
    counted = counted.groupBy(F.col("key").alias("item"), F.col("at").alias("item_at"), "window").agg(F.min("behind").alias("behind"))
    counted = written(counted, "windows")
    totals = counted.groupBy("item").agg(F.countDistinct("item_at").alias("item_windows"))
    met = windows(tokens(docs, "key", "text"), size).join(counted, "window")
    spans = met.groupBy("key", "item", (F.col("at") - F.col("item_at")).alias("offset")).agg(
        F.collect_set("item_at").alias("ats"), F.countDistinct(F.when(~F.col("behind"), F.col("item_at"))).alias("as_it_stands")
    )
    spans = spans.select(
        "key", "item", "offset", "ats", "as_it_stands", F.array_min("ats").alias("first"), (F.array_max("ats") + size).alias("end")
    )
    # The window with the first word as a name is counted only where it is needed.
    needed = F.least(F.lit(least), F.col("item_windows"))
    n_windows = F.when(F.col("as_it_stands") >= needed, F.col("as_it_stands")).otherwise(F.size("ats").cast("bigint"))
    enough = written(spans.join(totals, "item").withColumn("n_windows", n_windows).where(F.col("n_windows") >= needed).drop("as_it_stands"), "spans")
    of_item = items.select(F.col("key").alias("item"), "tokens", F.col("words").alias("item_words"))
    asked = enough.join(of_item, "item").withColumn("places", slots(F.col("first"), F.col("end") - F.col("first"))).drop("tokens")
    hit = docs.join(enough.select("key").distinct(), "key", "left_semi")
    in_docs = hit.select("key", F.split(word_text(F.col("text")), " ").alias("words"))
    pairs = F.transform("places", lambda i: F.struct(
        bare(F.element_at("item_words", i + 1)).alias("asked"),
        bare(F.try_element_at("words", (i + F.col("offset") + 1).cast("int"))).alias("found"),
        F.exists("ats", lambda a: (a <= i) & (i < a + size)).alias("matched"),
    ))
    held = in_docs.join(asked, "key").select("key", "item", "n_windows", "item_windows", pairs.alias("pairs"))
    matched = F.filter("pairs", lambda p: p["matched"])
    consistent = held.where(F.size(F.array_distinct(matched)) == F.size(F.array_distinct(F.transform(matched, lambda p: p["asked"]))))
    changed = F.size(F.filter("pairs", lambda p: ~p["asked"].eqNullSafe(p["found"])))
    return consistent.groupBy("key", "item").agg(
        F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"),
        F.min(F.size("pairs")).cast("bigint").alias("n_slots"), F.min(changed).cast("bigint").alias("changed_slots"),
    )


def plain_words(df: DataFrame) -> DataFrame:
    """Columns key (id and hash of the words) and tokens: lower-case words without the punctuation around them."""
    plain = F.concat(F.lit(" "), word_text(F.col("text")), F.lit(" "))
    plain = F.regexp_replace(F.regexp_replace(plain, f" {OPENING}", " "), f"{CLOSING}(?= )", "")
    cut = df.where("key is not null").select("key", F.lower(F.trim(F.regexp_replace(plain, "  +", " "))).alias("plain")).where("plain <> ''")
    return cut.select(F.struct("key", F.xxhash64("plain").alias("mark")).alias("key"), F.split("plain", " ").alias("tokens"))


def verbatim(docs: DataFrame, benchmark: DataFrame, size: int, least: int, literals: int) -> DataFrame:
    """Pairs (key, item, n_windows, item_windows) that share enough windows of plain words, from frames (key, text)."""
    items = written(plain_words(benchmark).distinct(), "plain-items")
    width = F.least(F.size("tokens"), F.lit(size))
    widths = sorted(r[0] for r in items.select(width.alias("width")).distinct().collect())  # no more than ``size``
    told = plain_words(docs)
    met = []
    for n in widths:
        words = F.size(F.filter(F.slice("tokens", F.col("at") + 1, n), lambda t: t.rlike(PLAIN)))
        same = items.where(width == n)
        cut = written(windows(same, n).join(same, "key").select(F.col("key").alias("item"), F.col("at").alias("item_at"), "window", (words >= literals).alias("telling")), "plain-windows")
        totals = cut.groupBy("item").agg(F.count_if("telling").alias("n_telling"), F.count("*").alias("n_all"))
        whole = F.col("n_telling") < least
        counted = cut.join(totals, "item").where(whole | F.col("telling")).select(
            "item", "item_at", "window", F.when(whole, F.col("n_all")).otherwise(F.col("n_telling")).alias("item_windows"),
            F.when(whole, F.col("n_all")).otherwise(F.lit(least)).alias("needed"),
        )
        met.append(windows(told, n).join(written(counted, "plain-counted"), "window"))
    if not met:
        return docs.select("key", F.lit(None).cast(dict(benchmark.dtypes)["key"]).alias("item"), *[F.lit(0).cast("bigint").alias(c) for c in ("n_windows", "item_windows")]).where("false")
    joined = met[0]
    for more in met[1:]:
        joined = joined.unionByName(more)
    runs = joined.groupBy("key", "item", (F.col("at") - F.col("item_at")).alias("offset")).agg(
        F.countDistinct("item_at").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("needed").alias("needed")
    )
    enough = runs.where("n_windows >= needed")
    return enough.groupBy(F.col("key.key").alias("key"), F.col("item.key").alias("item")).agg(
        F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows")
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    size: int = SIZE, least: int = LEAST, literals: int = LITERALS,
) -> DataFrame:
    """Columns key, item, n_windows, item_windows, n_slots and changed_slots for every contaminated pair.

    changed_slots counts slots whose value in the document differs from the item's: zero for a plain copy. A pair that
    only its plain words show has the counts of their windows and no slots.
    """
    texts, asked = pick(docs, key=key, text=text), pick(benchmark, key=item, text=item_text)
    found = written(by_templates(texts, asked, size, least, literals), "by-templates")
    copied = verbatim(texts, asked, size, least, literals).join(found, ["key", "item"], "left_anti")
    none = F.lit(0).cast("bigint")
    both = found.unionByName(copied.withColumns({"n_slots": none, "changed_slots": none}))
    return both.select(F.col("key").alias(key), F.col("item").alias(item), "n_windows", "item_windows", "n_slots", "changed_slots")
