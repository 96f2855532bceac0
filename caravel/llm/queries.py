"""The corpus operators as registered queries over the supplied tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel.llm import bpe, centroids, decontaminate, language, licenses, lines, periods, pieces, quality, simhash, suffixes, vectors, warc
from caravel.llm.frames import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every whole document loses to 50-byte strings of earlier documents, and a digest of what is left."""
    found = suffixes.deduplicate(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and of the bytes decoded from them, for every whole document."""
    return token_digests(table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    coded = bpe.encode(docs)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold: the URL of every page is looked up in the capture index and its records are read."""
    pages = table(spark, sf_dir, "pages")
    folder, directory = warc.archive(spark, pages)
    records = warc.lookup(directory, folder, pages)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def remainder(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key belongs to no fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from two of the three folds."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, learn=F.coalesce(remainder("doc_id", 3) != 1, F.lit(False)))
    judged = language.predict(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return judged.select("doc_id", held_out, "language.lang_pred", "language.score", "language.rejected")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every whole document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document loses to earlier ones, the documents it was aligned with, and a digest of what is left."""
    found = lines.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "dedup.n_lines", "dedup.n_removed", "dedup.partners", F.sha2(F.coalesce("dedup.text", F.lit("")), 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or with other numbers, names or units."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices found in the documents, with coverage and span."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document, learned from three of the four folds."""
    learn = F.coalesce(remainder("doc_id", 4) != 2, F.lit(False))
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=learn)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.9 or more."""
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """Columns doc_id and text: in every tenth document, by the hash of its id, the words from some place on repeat with some period.

    With h = crc32(doc_id) and g = floor(h / 10), word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). Texts without words and rows without an id stay as they are.
    """
    blanks = r"[\x20\x09-\x0D]+"
    bare = F.trim("text", F.lit(periods.BLANKS.decode()))
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", hashed.alias("h"), bare.alias("bare")).selectExpr(
        "doc_id", "text", "h div 10 AS g", f"if(h % 10 = 0 AND bare <> '', split(bare, r'{blanks}'), null) AS words"
    )
    rows = rows.selectExpr("*", "size(words) AS n", "cast(g % size(words) AS int) AS a").selectExpr(
        "*", "cast(1 + (n - a) div (3 + g % 8) AS int) AS p"
    )
    repeated = "array_join(transform(sequence(0, n - 1), i -> words[if(i < a, i, a + (i - a) % p)]), ' ')"
    return rows.selectExpr("doc_id", f"if(words IS NULL, text, {repeated}) AS text")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest periodic run of words in every whole document, and digests of all runs and of what is left without repeats."""
    found = periods.find_runs(planted_repeats(table(spark, sf_dir, "documents")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids, of the text decoded from them and of the byte spans of all pieces, for every whole document."""
    coded = pieces.encode(table(spark, sf_dir, "documents"))

    def listed(name: str) -> Column:
        return F.array_join(F.col(name).cast("array<string>"), ",")

    spans = F.concat(listed("starts"), F.lit(";"), listed("ends"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2(listed("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(spans, 256).alias("spans_sha256"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 components after three rounds of exact integer means."""
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_quality": op9_quality,
    "op10_embeddings": op10_embeddings,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_centroids": op13_centroids,
}


def decontamination_sql() -> str:
    """Templates, windows and slot checks as the operator has them, in patterns that need no look-around."""
    units = "|".join(sorted((u.replace("$", r"\$") for u in decontaminate.UNITS), key=len, reverse=True))
    size, least, literals = decontaminate.SIZE, decontaminate.LEAST, decontaminate.LITERALS

    def replaced(text: str, pattern: str, by: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"regexp_replace({text}, '{quoted}', '{by}', 'g')"

    def words(text: str) -> str:
        blanks = r"[<> \t\n\x0B\f\r]+"
        return f"trim({replaced(f'coalesce({text}, {chr(39) * 2})', blanks, ' ')}, ' ')"

    name = r"([^.!?:; ] )\p{Lu}(?:[\p{Ll}\p{Lt}\p{Lm}\p{Lo}'’-][\p{L}'’-]*)?([^\p{L}'’-]|$)"
    template = replaced("plain", decontaminate.NUMBER, "<0>")
    for _ in range(2):  # a match takes the blank that the next name needs
        template = replaced(template, name, r"\1<2>\2")
    template = f"lower({template})"
    for _ in range(2):
        template = replaced(template, rf"(<0> ?)(?:{units})([^\p{{L}}\p{{N}}]|$)", r"\1<1>\2")
    template = replaced(template, decontaminate.SIGNS, "")
    window = f"tokens[i + 1 : i + {size}]"
    places = f"unnest(range(CAST(len(tokens) - {size} + 1 AS BIGINT)))"
    return f"""
        WITH item_words AS (SELECT item_id, {words('text')} AS plain FROM benchmark WHERE item_id IS NOT NULL),
        items AS (SELECT item_id, string_split(plain, ' ') AS words, string_split({template}, ' ') AS tokens FROM item_words),
        item_places AS (SELECT item_id, tokens, {places} AS i FROM items),
        telling AS (
            SELECT item_id, i, {window} AS w FROM item_places
            WHERE len(list_filter({window}, lambda t: t <> '' AND NOT contains(t, '<'))) >= {literals}),
        totals AS (SELECT item_id, count(DISTINCT i) AS item_windows FROM telling GROUP BY item_id),
        doc_words AS (SELECT doc_id, {words('text')} AS plain FROM documents WHERE doc_id IS NOT NULL),
        docs AS (SELECT doc_id, string_split(plain, ' ') AS words, string_split({template}, ' ') AS tokens FROM doc_words),
        doc_places AS (SELECT doc_id, tokens, {places} AS i FROM docs),
        met AS (
            SELECT d.doc_id, t.item_id, d.i - t.i AS shift, t.i AS item_at
            FROM (SELECT doc_id, i, {window} AS w FROM doc_places) d JOIN telling t ON d.w = t.w),
        spans AS (
            SELECT doc_id, item_id, shift, count(DISTINCT item_at) AS n_windows, min(item_at) AS low, max(item_at) + {size} AS high
            FROM met GROUP BY doc_id, item_id, shift),
        enough AS (SELECT * FROM spans JOIN totals USING (item_id) WHERE n_windows >= least({least}, item_windows)),
        slots AS (
            SELECT e.doc_id, e.item_id, e.n_windows, e.item_windows,
                   list_transform(list_filter(range(low, high), lambda j: contains(i.tokens[j + 1], '<')),
                                  lambda j: [lower(i.words[j + 1]), lower(d.words[j + shift + 1])]) AS pairs
            FROM enough e JOIN items i USING (item_id) JOIN docs d USING (doc_id)),
        checked AS (
            SELECT *, len(list_distinct(pairs)) AS n, len(list_distinct(list_transform(pairs, lambda p: p[1]))) AS asked,
                   len(list_distinct(list_transform(pairs, lambda p: p[2]))) AS found
            FROM slots)
        SELECT doc_id, item_id, CAST(max(n_windows) AS BIGINT) AS n_windows, CAST(max(item_windows) AS BIGINT) AS item_windows,
               CAST(min(len(pairs)) AS BIGINT) AS n_slots,
               CAST(min(len(list_filter(pairs, lambda p: p[1] <> p[2]))) AS BIGINT) AS changed_slots
        FROM checked WHERE n = asked AND n = found GROUP BY doc_id, item_id
    """


def centroids_sql() -> str:
    """Rounds written out one after the other; floor division of integers as SQL has it only towards zero."""
    k, size, rounds = centroids.K, centroids.SIZE, centroids.ROUNDS
    steps = [
        f"""
        WITH kept AS (
            SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({centroids.SCALE} * x) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
        drawn AS (SELECT v, row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id) NULLS LAST, v) - 1 AS cluster FROM kept),
        c0 AS (SELECT cluster, v AS c FROM drawn WHERE cluster < {k}),
        numbered AS (SELECT row_number() OVER () AS row, vec_id, v FROM kept)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""
        d{i} AS (
            SELECT row, vec_id, v, cluster,
                   list_sum(list_transform(range(1, {size + 1}), lambda j: (v[j] - c[j]) * (v[j] - c[j]))) AS distance
            FROM numbered, c{i}),
        a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""
        s{i} AS (
            SELECT cluster, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, {size + 1}) r(j) GROUP BY cluster, j),
        m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{i} GROUP BY cluster),
        c{i + 1} AS (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster))""")
    return ",".join(steps) + f"""
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
               CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)
    """


ORACLES: dict[str, str] = {
    "op13_centroids": centroids_sql(),
    # Five hex digits make four base-32 digits.
    "op3_warc": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        digests AS (
            SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex,
                   max(page_id) OVER (PARTITION BY payload) AS holder
            FROM payloads)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          CAST((CAST('0x' || substr(hex, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * j AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '')), '')
                   AS payload_digest,
               CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
        FROM digests
    """,
    "op7_decontamination": decontamination_sql(),
    "op10_embeddings": """
        WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
            WHERE isfinite(list_cosine_similarity(a.v, b.v)) AND list_cosine_similarity(a.v, b.v) >= 0.9),
        reached(vec_id, root) AS (
            SELECT vec_id, vec_id FROM vectors UNION SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.vec_id),
        components AS (SELECT vec_id, min(root) AS component_id FROM reached GROUP BY vec_id)
        SELECT vec_id, CAST((SELECT count(*) FROM links WHERE a = c.vec_id) AS BIGINT) AS n_links, component_id,
               vec_id = component_id AS kept
        FROM components c
    """,
}
