"""WARC fixity audit with Merkle trees.

Records are ordered by number. A leaf hashes a record: its number, the offset range it takes in its file and its content. A node of
level l covers ``FANOUT`` ** l numbers and hashes its children in order, with the offset where the first of them starts and the bytes of all. Two replicas with
equal roots are equal; otherwise only mismatching branches are descended, level by level, down to the records.

A file holds ``FILE_RECORDS`` numbers, so offsets are running sums within a file and no order over the whole archive is needed.
Levels are as many as the largest number needs. Both replicas are hashed in one pass over their contents; the leaves are written, and so
is every level of more than ``DERIVED_NODES`` nodes; the smaller ones above are derived from it.

Defined results: a record that only one replica has is ``missing`` or ``extra``; null content is unlike empty content, both
have length 0; records of one number (repeated rows) are one leaf over their contents as a multiset, whatever their order, kept as sums of
hash words, so their count has no bound; a different count is a mismatch. Records without a number, or with a negative one, have no place in a file: they hash into
``LOOSE`` leaves of their own and are compared as a multiset of (number, content), so what one replica has more of is ``missing`` or ``extra``, one row a distinct content, with
the number as it is and no offset. Two empty replicas are equal; extra columns are not hashed. A change of length also moves the offsets of the records after it
in the file; those are reported as ``moved``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FANOUT_BITS, FILE_BITS, DERIVED_NODES, LOOSE, LANES = 5, 10, 100_000, 32_768, 6
RESULT = "record bigint, status string, start bigint, length bigint, found_length bigint, hash string, found_hash string"


def warc_record(url: Column, content: Column) -> Column:
    """The bytes of a response record, as text; null if there is no content."""
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, content, F.lit("\r\n\r\n"))


def _lane(body: Column, i: int) -> Column:
    """30 bits of a hash; sums of up to 2 ** 33 of them fit a bigint."""
    return F.conv(F.substring(body, 1 + 8 * i, 8), 16, 10).cast("bigint") % (1 << 30)


def hashed(records: DataFrame, side: int, key: str, content: str) -> DataFrame:
    """(side, number, k, length, body): ``k`` is the number, or below 0 the leaf of a record that has none. Contents are hashed before anything is shuffled."""
    own = records.select(F.lit(side).alias("side"), F.col(key).cast("bigint").alias("number"),
        F.coalesce(F.octet_length(content), F.lit(0)).cast("bigint").alias("length"),
        F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.sha2(F.lit("no content"), 256)).alias("body"))
    loose = F.sha2(F.concat_ws(":", F.col("number").cast("string"), "body"), 256)
    return own.withColumn("k", F.when(F.col("number") >= 0, F.col("number")).otherwise(F.lit(-1) - _lane(loose, 0) % LOOSE))


def leaves(records: DataFrame, file_bits: int = FILE_BITS) -> DataFrame:
    """(side, k, start, length, copies, body, hash) by side and record number; sums only, so a number with very many records is one row from each task."""
    one = records.groupBy("side", "k").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("copies"),
        *(F.sum(_lane(F.col("body"), i)).alias(f"_{i}") for i in range(LANES)))
    one = one.select("side", "k", "length", "copies",
        F.sha2(F.concat_ws(",", *(F.col(f"_{i}").cast("string") for i in range(LANES)), F.col("copies").cast("string")),
            256).alias("body"))
    run = Window.partitionBy("side", F.shiftright("k", file_bits)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.withColumn("start", F.when(F.col("k") >= 0, F.sum("length").over(run) - F.col("length")))
    return placed.withColumn("hash", F.sha2(F.concat_ws(":", "k", F.coalesce("start", F.lit(-1)), "length", "copies", "body"), 256))


def parents(level: DataFrame, up: Column) -> DataFrame:
    """The next level: (side, k, start, length, hash) of nodes over runs of children."""
    c = F.array_sort(F.collect_list(F.struct("k", "start", "length", "hash")))
    nodes = level.groupBy("side", up.alias("up")).agg(c.alias("c"))
    length = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x["length"])
    told = F.concat_ws(":", F.col("c")[0]["k"], F.element_at("c", -1)["k"], F.coalesce(F.col("c")[0]["start"], F.lit(-1)), length,
        F.array_join(F.transform("c", lambda x: F.concat_ws("=", x["k"], x["hash"])), ","))
    return nodes.select("side", F.col("up").alias("k"), F.col("c")[0]["start"].alias("start"), length.alias("length"), F.sha2(told, 256).alias("hash"))


def tree(leaf: DataFrame, largest: int, fanout_bits: int = FANOUT_BITS) -> list[DataFrame]:
    """Levels 0 (leaves) to the one whose nodes are at most two a side: that of the numbered records and that of the others."""
    levels, shift = [leaf], 0
    while (largest >> shift) or (LOOSE >> shift) > 1:
        shift += fanout_bits
        up = parents(levels[-1], F.shiftright("k", fanout_bits))
        levels.append(materialize(up, f"fixity-{len(levels)}") if largest >> shift > DERIVED_NODES else up)
    return levels


def _differing(level: DataFrame) -> DataFrame:
    """The nodes whose hashes differ between the sides, or that one side lacks."""
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("hash")))
    return level.groupBy("k").agg(of(0).alias("_a"), of(1).alias("_b")).where("NOT _a <=> _b").select("k")


def audit(a: DataFrame, b: DataFrame, key: str = "page_id", content: str = "html", fanout_bits: int = FANOUT_BITS, file_bits: int = FILE_BITS) -> DataFrame:
    """(record, status, start, length, found_length, hash, found_hash) of all records in which replica ``b`` differs from ``a``."""
    spark, every = a.sparkSession, hashed(a, 0, key, content).unionByName(hashed(b, 1, key, content))
    leaf = materialize(leaves(every, file_bits), "fixity-leaves")
    largest = leaf.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    levels = tree(leaf, max(0, largest), fanout_bits)
    roots = {r["side"]: r["hash"] for r in parents(levels[-1], F.lit(0)).select("side", "hash").collect()}  # one row a side
    if roots.get(0) == roots.get(1):
        return spark.createDataFrame([], RESULT)
    suspects = _differing(levels[-1])
    for level in reversed(levels[:-1]):  # only the children of mismatching nodes
        below = level.join(suspects.select(F.col("k").alias("_up")), F.shiftright("k", fanout_bits) == F.col("_up"), "left_semi")
        suspects = _differing(below)
    suspects = materialize(suspects, "fixity-suspects")
    side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{'ab'[s]}")
    both = leaf.where("k >= 0").join(suspects, "k", "left_semi").groupBy("k").agg(*(side(c, s) for c in ("start", "length", "copies", "body") for s in (0, 1)))
    status = F.when(F.col("body_b").isNull(), "missing").when(F.col("body_a").isNull(),
        "extra").when((F.col("body_a") == F.col("body_b")) & (F.col("copies_a") == F.col("copies_b")),
        "moved").otherwise("corrupt")
    numbered = both.select(F.col("k").alias("record"), status.alias("status"), F.coalesce("start_a", "start_b").alias("start"),
        F.col("length_a").alias("length"), F.col("length_b").alias("found_length"), F.col("body_a").alias("hash"),
        F.col("body_b").alias("found_hash"))
    n = lambda s: F.count_if(F.col("side") == s)
    loose = every.where("number IS NULL OR number < 0").join(suspects, "k", "left_semi").groupBy("number", "length",
        "body").agg(n(0).alias("n_a"), n(1).alias("n_b")).where("n_a <> n_b")
    there = lambda c, s: F.when(F.col(f"n_{s}") > 0, F.col(c))
    others = loose.select(F.col("number").alias("record"),
        F.when(F.col("n_a") > F.col("n_b"), "missing").otherwise("extra").alias("status"),
        F.lit(None).cast("bigint").alias("start"), there("length", "a").alias("length"),
        there("length", "b").alias("found_length"), there("body", "a").alias("hash"), there("body", "b").alias("found_hash"))
    return numbered.unionByName(others)


def archived(pages: DataFrame) -> DataFrame:
    """(page_id, record): every page as a WARC record."""
    return pages.select("page_id", warc_record(F.col("url"), F.col("html")).alias("record"))


def second_replica(pages: DataFrame) -> DataFrame:
    """A replica with damage decided by a hash of the record number: a letter changed, a tail lost, records lost."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("rot:"), F.col("page_id").cast("string"))), 1, 4), 16, 10).cast("int")
    html = F.when(u < 200, F.concat(F.lit("?"), F.substring("html", 2, 2**30))).when(u < 230,
        F.expr("substring(html, 1, length(html) - 7)")).otherwise(F.col("html"))
    return pages.withColumn("u", u).withColumn("html", html).where("u IS NULL OR u < 65500").drop("u")


def oracle(file_bits: int = FILE_BITS) -> str:
    end = "chr(13) || chr(10)"
    record = f"'WARC/1.0' || {end} || 'WARC-Type: response' || {end} || 'WARC-Target-URI: ' || coalesce(url, '') || {end} || 'Content-Length: ' || strlen(html) || {end} || {end} || html || {end} || {end}"
    body = "sha256(" + " || ',' || ".join(f"(('0x' || substr(h, {1 + 8 * i}, 8))::bigint % {1 << 30})" for i in range(LANES)) + " || ',1')"
    leaf = lambda t: f"SELECT n, sum(length) OVER (PARTITION BY n // {1 << file_bits} ORDER BY n ROWS UNBOUNDED PRECEDING)::bigint - length AS start, length, {body} AS body FROM {t}"
    return f"""
WITH u AS (SELECT page_id AS n, url, html, ('0x' || substr(md5('rot:' || page_id::varchar), 1, 4))::int AS u FROM pages),
a0 AS (SELECT n, strlen(r)::bigint AS length, sha256(r) AS h FROM (SELECT n, {record} AS r FROM u)),
b1 AS (SELECT n, url, CASE WHEN u < 200 THEN '?' || substr(html, 2) WHEN u < 230 THEN substr(html, 1, length(html) - 7) ELSE html END AS html FROM u WHERE u < 65500),
b0 AS (SELECT n, strlen(r)::bigint AS length, sha256(r) AS h FROM (SELECT n, {record} AS r FROM b1)),
a AS ({leaf('a0')}), b AS ({leaf('b0')})
SELECT a.n AS record, CASE WHEN b.body IS NULL THEN 'missing' WHEN a.body = b.body THEN 'moved' ELSE 'corrupt' END AS status, a.start, a.length, b.length AS found_length, a.body AS hash, b.body AS found_hash
FROM a LEFT JOIN b USING (n) WHERE b.body IS NULL OR a.body <> b.body OR a.start <> b.start OR a.length <> b.length
"""
