"""Full-text search, facets, filters and recall over the documents table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.tables import content_slice
from ..session import shared_dir
from .base import CLASSES, DOCS, classifications, documents, query, table

KEY = ["document_id"]


_written: dict[tuple, str] = {}


def _index(spark: SparkSession, d: str) -> S.Index:
    """The index of all documents, written once an application and table, then read by every search: only the row groups of its terms."""
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    changed = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(source).getModificationTime()
    key = (spark.sparkContext.applicationId, d, changed)
    if key not in _written:
        path = f"{shared_dir(spark)}/indexes/{uuid.uuid4().hex}"
        S.Index.build(documents(spark, d), KEY).write(path, spark.sparkContext.defaultParallelism)
        _written[key] = path
    return S.Index.read(spark, _written[key], KEY)


def _sql(text: str, phrase: bool = False, scored: bool = True) -> str:
    """CTEs ``m`` (document_id, score) of the texts that satisfy a query, by brute force over all tokens."""
    tree = S.parse_query(text, phrase)
    every = S.leaves(tree)
    places = lambda leaf: f"len(list_filter(range(1, len(k) + 1), lambda i: {' AND '.join(f"k[i + {n}] = '{t}'" for n, t in enumerate(leaf.tokens))}))"
    number = iter(range(len(every)))

    def holds(node) -> str:
        if isinstance(node, S.Leaf):
            return f"f{next(number)} > 0"
        return "(" + (" OR " if isinstance(node, S.Any_) else " AND ").join(map(holds, node.parts)) + ")"

    condition = holds(tree)
    idf = lambda i: f"(SELECT CASE WHEN n{i} < N - n{i} THEN ln((N - n{i} + 0.5::double) / (n{i} + 0.5::double)) ELSE 1e-6::double END FROM stats)"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2::double / (f{i} + 1.2::double * (0.25::double + 0.75::double * n / (SELECT a FROM stats)))" for i in range(len(every)))
    return rf"""{DOCS}, {CLASSES},
tokens AS (SELECT document_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS k FROM docs),
hits AS MATERIALIZED (SELECT document_id, len(k) AS n, {', '.join(f'{places(leaf)} AS f{i}' for i, leaf in enumerate(every))} FROM tokens),
stats AS MATERIALIZED (SELECT count(*)::double AS N, avg(n) AS a, {', '.join(f'(count(*) FILTER (f{i} > 0))::double AS n{i}' for i in range(len(every)))} FROM hits),
m AS (SELECT document_id{f', -({score}) AS score' if scored else ''} FROM hits WHERE {condition}),
j AS (SELECT m.*, d.filename, d.status, d.created_at, c.code, c.label FROM m JOIN docs d USING (document_id) LEFT JOIN classes c USING (document_id))"""


def _page(spark: SparkSession, d: str, text: str, phrase: bool = False, **how) -> DataFrame:
    found = S.search(_index(spark, d), text, documents(spark, d), classifications(spark, d), phrase=phrase, **how)
    return found.select("document_id", "filename", "status", "code", "label", F.round("score", 6).alias("score"))


def _page_sql(text: str, phrase: bool = False, limit: int = 20, offset: int = 0, where: str = "true") -> str:
    return f"WITH {_sql(text, phrase)} SELECT document_id, filename, status, code, label, round(score, 6) AS score FROM j WHERE {where} ORDER BY j.score, created_at DESC, document_id LIMIT {limit} OFFSET {offset}"


@query(_page_sql("tion ther"))
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "tion ther")


@query(_page_sql("the license", limit=10, offset=5))
def search_page(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "the license", limit=10, offset=5)


@query(_page_sql("the and", phrase=True, limit=50))
def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "the and", phrase=True, limit=50)


@query(_page_sql('"of the" ing', limit=50))
def search_quoted(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, '"of the" ing', limit=50)


@query(_page_sql("ther-tion ble's", limit=50))
def search_compound(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "ther-tion ble's", limit=50)


@query(f"WITH {_sql('tion', scored=False)} SELECT count(DISTINCT document_id) AS total FROM j")
def search_count(spark: SparkSession, d: str) -> DataFrame:
    return S.count(_index(spark, d), "tion", documents(spark, d), classifications(spark, d))


@query(_page_sql("tion", limit=500, where="code ILIKE '1%' AND filename ILIKE '%RC1%' AND status = 'en'"))
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "tion", limit=500, filters=S.Filters(code_prefix="1", filename_contains="RC1", status="en"))


_FROM, _TO = "2024-01-05 00:00:00", "2024-01-25 12:00:00"


@query(_page_sql("tion", limit=500, where=f"created_at BETWEEN TIMESTAMP '{_FROM}' AND TIMESTAMP '{_TO}'"))
def search_dates(spark: SparkSession, d: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return _page(spark, d, "tion", limit=500, filters=S.Filters(created_after=at(_FROM), created_before=at(_TO)))


@query(
    f"""WITH {_sql("ther", scored=False)},
b AS (SELECT 'classification' AS facet, code AS value, label, count(DISTINCT document_id) AS "count" FROM j GROUP BY code, label
UNION ALL SELECT 'status', status, NULL, count(DISTINCT document_id) FROM j GROUP BY status
UNION ALL SELECT 'filename', filename, NULL, count(DISTINCT document_id) FROM j GROUP BY filename
UNION ALL SELECT 'total', NULL, NULL, count(DISTINCT document_id) FROM j HAVING count(*) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY "count" DESC, value NULLS FIRST, label NULLS FIRST) AS n FROM b)
SELECT facet, coalesce(value, '') AS value, coalesce(label, '') AS label, "count" FROM r WHERE facet IN ('status', 'total') OR n <= 7"""
)
def search_facets(spark: SparkSession, d: str) -> DataFrame:
    return S.facets(_index(spark, d), "ther", documents(spark, d), classifications(spark, d), facet_limit=7)


@query()
def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    page = S.search(_index(spark, d), "tion ther", docs, classifications(spark, d))
    return S.snippets(page.select("document_id"), docs, "tion ther")


def _recall_sql(phrases: list[str], expected: int) -> str:
    one = lambda p: f"SELECT '{p}' AS phrase, coalesce(bool_or(document_id = {expected}), false) AS hit FROM (WITH {_sql(p)} SELECT document_id FROM j ORDER BY j.score, created_at DESC, document_id LIMIT 20)"
    return " UNION ALL ".join(map(one, phrases))


@query(_recall_sql(["tion", "license", "of the"], 3))
def search_recall(spark: SparkSession, d: str) -> DataFrame:
    return S.recall(_index(spark, d), ["tion", "license", "of the"], documents(spark, d), 3)


_VERSIONS = """v AS (SELECT doc_id AS document_id, doc_id * 2 + n AS run_id, TIMESTAMP '2024-01-01' + to_hours(doc_id + CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n END) AS made, (doc_id + n) % 5 <> 0 AS done, text || CASE WHEN n = 1 THEN ' tion renewed' ELSE '' END AS text FROM documents, range(0, 2) t(n)),
latest AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY document_id ORDER BY made DESC) AS r FROM v) WHERE r = 1 AND done)"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Two output versions of every document, some of failed runs, some of one moment."""
    t = table(spark, d, "documents").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    hours = F.col("doc_id") + F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("n"))
    made = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=hours.cast("int"))
    return t.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") * 2 + F.col("n")).alias("run_id"),
        made.alias("created_at"), F.when((F.col("doc_id") + F.col("n")) % 5 != 0,
            "succeeded").otherwise("failed").alias("status"), F.concat("text", F.when(F.col("n") == 1,
                " tion renewed").otherwise("")).alias("text"))


def _cleaned(spark: SparkSession, d: str) -> tuple[S.Index, DataFrame]:
    """The index of all versions, and those in force: the latest output of each document, if its run succeeded."""
    v = _versions(spark, d)
    return S.Index.build(v, ["document_id", "run_id"],
        only=["tion", "renewed"]), S.latest_outputs(v.select("document_id", "run_id", "created_at"),
        v.select("run_id", "status"))


_CLEANED = f"""WITH {DOCS}, {CLASSES}, {_VERSIONS}, k AS (SELECT document_id, run_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS k FROM v),
h AS MATERIALIZED (SELECT document_id, run_id, len(k) AS n, len(list_filter(k, lambda x: x = 'tion')) AS f0, len(list_filter(k, lambda x: x = 'renewed')) AS f1 FROM k),
stats AS MATERIALIZED (SELECT count(*)::double AS total, avg(n) AS a, (count(*) FILTER (f0 > 0))::double AS n0, (count(*) FILTER (f1 > 0))::double AS n1 FROM h),
m AS (SELECT h.*, -((CASE WHEN n0 < total - n0 THEN ln((total - n0 + 0.5::double) / (n0 + 0.5::double)) ELSE 1e-6::double END) * f0 * 2.2::double / (f0 + 1.2::double * (0.25::double + 0.75::double * n / a)) + (CASE WHEN n1 < total - n1 THEN ln((total - n1 + 0.5::double) / (n1 + 0.5::double)) ELSE 1e-6::double END) * f1 * 2.2::double / (f1 + 1.2::double * (0.25::double + 0.75::double * n / a))) AS score FROM h, stats WHERE f0 > 0 AND f1 > 0),
j AS (SELECT m.document_id, m.run_id, m.score, d.created_at, d.status, c.code FROM m JOIN latest USING (document_id, run_id) JOIN docs d ON d.document_id = m.document_id LEFT JOIN classes c ON c.document_id = m.document_id)"""


@query(_CLEANED + " SELECT document_id, run_id, status, code, round(score, 6) AS score FROM j WHERE code = '1' ORDER BY j.score, created_at DESC, document_id LIMIT 30 OFFSET 2")
def search_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Versions are searched, only those in force are hits; frequencies count all versions. Filtered by code."""
    index, current = _cleaned(spark, d)
    found = S.search(index, "tion renewed", documents(spark, d), classifications(spark, d), S.Filters(code="1"), limit=30, offset=2, current=current)
    return found.select("document_id", "run_id", "status", "code", F.round("score", 6).alias("score"))


@query(_CLEANED + """ SELECT 'status' AS facet, status AS value, count(DISTINCT document_id) AS "count" FROM j GROUP BY status UNION ALL SELECT 'total', '', count(DISTINCT document_id) FROM j UNION ALL SELECT 'classification', coalesce(code, ''), count(DISTINCT document_id) FROM j GROUP BY code""")
def search_cleaned_facets(spark: SparkSession, d: str) -> DataFrame:
    index, current = _cleaned(spark, d)
    found = S.facets(index, "tion renewed", documents(spark, d), classifications(spark, d).withColumn("label", F.lit("x")), facet_limit=50, current=current)
    return found.where("facet <> 'filename'").groupBy("facet", "value").agg(F.sum("count").alias("count"))


@query(r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM t GROUP BY term")
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Vocabulary of the whole index: built from the postings."""
    postings = S.Index.build(documents(spark, d), KEY).postings
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("positions")).alias("occurrences"))


_POSTINGS = "SELECT term, count(*) AS texts, sum(len(p))::bigint AS occurrences, sum(list_sum(p))::bigint AS places FROM (SELECT document_id, term, list(pos) AS p FROM t GROUP BY 1, 2) GROUP BY term"


@query(rf"WITH {DOCS}, k AS (SELECT document_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS k FROM docs WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), t AS (SELECT document_id, unnest(k) AS term, unnest(range(len(k))) AS pos FROM k) {_POSTINGS}")
def index_delete(spark: SparkSession, d: str) -> DataFrame:
    """The postings after the toxic documents were deleted: texts, occurrences and the sum of the positions of every term."""
    gone = classifications(spark, d).where("label = '1'").select("document_id")
    return _postings(S.Index.build(documents(spark, d), KEY).without(gone))


def _postings(index: S.Index) -> DataFrame:
    places = F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size("positions")).alias("occurrences"), F.sum(places).alias("places"))


@query(rf"WITH {DOCS}, k AS (SELECT document_id, regexp_extract_all(lower(CASE WHEN document_id % 2 = 0 THEN 'renewed ' || text ELSE text END), '[\pL\pN]+') AS k FROM docs), t AS (SELECT document_id, unnest(k) AS term, unnest(range(len(k))) AS pos FROM k) {_POSTINGS}")
def index_update(spark: SparkSession, d: str) -> DataFrame:
    """Every other document indexed anew, with a word put before it: its old postings are replaced."""
    docs = documents(spark, d)
    changed = docs.where("document_id % 2 = 0").withColumn("text", F.concat(F.lit("renewed "), "text"))
    return _postings(S.Index.build(docs, KEY).updated(changed))


@query(f"WITH {DOCS}, {CLASSES} SELECT document_id, code FROM docs JOIN classes USING (document_id) WHERE code ILIKE '1%'")
def filter_prefix_ci(spark: SparkSession, d: str) -> DataFrame:
    joined = documents(spark, d).join(classifications(spark, d), "document_id")
    return S.Filters(code_prefix="1").apply(joined).select("document_id", "code")


@query(f"WITH {DOCS} SELECT document_id, filename FROM docs WHERE filename ILIKE '%C1%'")
def filter_contains_ci(spark: SparkSession, d: str) -> DataFrame:
    return S.Filters(filename_contains="C1").apply(documents(spark, d)).select("document_id", "filename")


@query(f"WITH {DOCS} SELECT document_id FROM docs WHERE created_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09'")
def filter_date_range(spark: SparkSession, d: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return documents(spark, d).where(F.col("created_at").between(at("2024-01-03"), at("2024-01-09"))).select("document_id")


@query("SELECT doc_id AS document_id, substr(text, 101, 200) AS content, length(text) AS total_chars, length(text) > 300 AS truncated FROM documents")
def content_window(spark: SparkSession, d: str) -> DataFrame:
    return content_slice(documents(spark, d), 100, 200).select("document_id", "content", "total_chars", "truncated")


@query("SELECT doc_id AS document_id, source AS filename, n_chars AS byte_size FROM documents WHERE doc_id = 17")
def get_document(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("document_id = 17").select("document_id", "filename", "byte_size")


@query("SELECT DISTINCT b.item_id, d.doc_id AS document_id, strpos(lower(d.text), lower(b.text)) AS at FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def quote_contains(spark: SparkSession, d: str) -> DataFrame:
    """Verbatim occurrences of every benchmark quote in the documents."""
    return S.quotes_in(documents(spark, d), table(spark, d, "benchmark"), "document_id", "item_id")
