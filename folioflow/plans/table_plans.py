"""Versions, writes, queue, roll-ups and streams over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import process, rollups
from ..operators import search as S
from ..operators import tables as T
from ..session import shared_dir
from ..streaming import streams
from .base import CLASSES, DOCS, RUNS, classifications, documents, outputs, query, runs, table

NOW = "2024-01-20 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"WITH {RUNS}, o AS (SELECT *, rank() OVER (PARTITION BY document_id ORDER BY created_at DESC) AS r FROM runs) SELECT document_id, run_id FROM o WHERE r = 1 AND status = 'succeeded'")
def latest_rank(spark: SparkSession, d: str) -> DataFrame:
    return S.latest_outputs(outputs(spark, d), runs(spark, d)).select("document_id", "run_id")


@query(f"WITH {RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, run_id DESC) AS r FROM runs WHERE status = 'succeeded') SELECT document_id, run_id FROM o WHERE r = 1")
def latest_succeeded(spark: SparkSession, d: str) -> DataFrame:
    return S.latest_succeeded(outputs(spark, d), runs(spark, d)).select("document_id", "run_id")


@query(f"WITH {DOCS} SELECT document_id, filename FROM docs ORDER BY created_at DESC, document_id LIMIT 25 OFFSET 50")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    return T.list_documents(documents(spark, d), 25, 50).select("document_id", "filename")


def _run_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("sequence"), F.col("user_id").alias("run_id"),
        F.col("event_type").alias("stage"), F.col("props").alias("message"), F.col("ts").alias("created_at"),
        F.col("value").alias("duration_ms"))


@query("SELECT event_id AS sequence, event_type || ': ' || props AS line FROM events WHERE user_id = 8 ORDER BY event_id LIMIT 20 OFFSET 5")
def events_page(spark: SparkSession, d: str) -> DataFrame:
    return T.list_events(_run_events(spark, d), 8, 20, 5).select("sequence", "line")


@query(
    """WITH old AS (SELECT c_custkey AS document_id, 'new' AS status, 0.0::double AS price, c_nationkey::bigint AS created FROM customer),
new AS (SELECT o_custkey AS document_id, o_orderstatus AS status, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders)
SELECT coalesce(o.document_id, n.document_id) AS document_id, coalesce(n.status, o.status) AS status, round(coalesce(n.price, o.price), 2) AS price, coalesce(o.created, n.first) AS created FROM old o FULL JOIN (SELECT * FROM new WHERE r = 1) n ON o.document_id = n.document_id"""
)
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Customers overwritten by their newest order, ``created`` kept from the first row of the key."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.lit("new").alias("status"),
        F.lit(0.0).alias("price"), F.col("c_nationkey").cast("bigint").alias("created"),
        F.lit(-1).cast("bigint").alias("seq"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("created"), F.col("o_orderkey").alias("seq"))
    return T.upsert(old, new, ["document_id"], keep=("created",), order="seq").select("document_id", "status", F.round("price", 2).alias("price"), "created")


@query(f"WITH {DOCS}, {CLASSES}, gone AS (SELECT document_id FROM classes WHERE label = '1'), s AS (SELECT sha256(text) AS h FROM docs JOIN gone USING (document_id)) SELECT 'documents' AS kind, document_id FROM docs WHERE document_id NOT IN (FROM gone) UNION ALL SELECT 'classifications', document_id FROM classes WHERE label <> '1' UNION ALL SELECT 'cache', document_id FROM docs WHERE sha256(text) NOT IN (FROM s)")
def delete_survivors(spark: SparkSession, d: str) -> DataFrame:
    """What stays after the toxic documents were deleted with their classifications and the cache rows any of their texts share."""
    docs, labels = documents(spark, d), classifications(spark, d)
    sha = docs.select("document_id", F.sha2("text", 256).alias("sha256"))
    kept = T.delete_documents({"documents": docs, "classifications": labels, "chunks": sha,
            "cache": sha.select(F.col("document_id").alias("row"), F.col("sha256").alias("chunk_sha256"))},
        labels.where("label = '1'"))
    one = lambda name, c="document_id": kept[name].select(F.lit(name).alias("kind"), F.col(c).alias("document_id"))
    return one("documents").unionByName(one("classifications")).unionByName(one("cache", "row"))


@query("WITH c AS (SELECT sha256(text) AS h FROM documents JOIN labels USING (doc_id)) SELECT doc_id AS document_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (FROM c)")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Texts that no labelled document has: what a cache of the labelled texts would miss."""
    docs = documents(spark, d).withColumn("sha256", F.sha2("text", 256))
    cache = docs.join(classifications(spark, d), "document_id", "left_semi").select(F.col("sha256").alias("chunk_sha256")).distinct()
    return process.cache_misses(docs, cache).select("document_id", "sha256")


@query("WITH s AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS p, 'doc_' || substr(sha256(text), 1, 16) AS id, strlen(text)::bigint AS n FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM s) SELECT id AS document_id, p AS source_path, doc_id || '.txt' AS filename, 'text/plain' AS media_type, n AS byte_size FROM r WHERE r = 1")
def content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"),
            F.lit(".txt")).alias("source_path"), F.encode("text", "UTF-8").alias("content"))
    return process.ingest(files).select("document_id", "source_path", "filename", "media_type", "byte_size")


@query("WITH c AS (SELECT o_custkey AS run_id, max_by(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) SELECT c_custkey AS run_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') OR s IS NULL THEN CASE c_mktsegment WHEN 'BUILDING' THEN 'canceled' WHEN 'MACHINERY' THEN 'succeeded' ELSE 'running' END ELSE s END AS status FROM customer LEFT JOIN c ON run_id = c_custkey")
def run_status_guard(spark: SparkSession, d: str) -> DataFrame:
    """Status changes apply to open runs only; canceled and succeeded ones stay."""
    state = F.when(F.col("c_mktsegment") == "BUILDING", "canceled").when(F.col("c_mktsegment") == "MACHINERY", "succeeded").otherwise("running")
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), state.alias("status"),
        F.lit("chunk").alias("stage"), F.lit(None).cast("string").alias("error"))
    changes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.max_by("o_orderstatus",
            "o_orderkey").alias("status")).withColumns({"stage": F.lit("clean"), "error": F.lit(None).cast("string")})
    return T.update_run_status(held, changes).select("run_id", "status")


@query(
    f"""WITH {RUNS}, live AS (SELECT * FROM runs WHERE status = 'running'), docs AS (SELECT DISTINCT document_id FROM live)
SELECT 'run' AS kind, run_id AS id, CASE WHEN status = 'running' THEN 'succeeded' ELSE status END AS value FROM runs
UNION ALL SELECT 'document', c_custkey, CASE WHEN c_custkey IN (FROM docs) THEN 'ready' ELSE 'new' END FROM customer
UNION ALL SELECT 'output', run_id, CASE WHEN status = 'running' THEN 'new' ELSE 'old' END FROM runs WHERE status = 'running' OR run_id % 2 = 0
UNION ALL SELECT 'class', c_custkey, CASE WHEN c_custkey IN (FROM docs) THEN '000' ELSE '999' END FROM customer"""
)
def publish_runs(spark: SparkSession, d: str) -> DataFrame:
    """Running runs publish: output and classification replaced or added, run succeeded, document ready; the others are left alone."""
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.lit("new").alias("status"))
    held = outputs(spark, d).where("run_id % 2 = 0").withColumn("text", F.lit("old"))
    classes = docs.select("document_id", F.lit("999").alias("code"))
    after = T.publish(held, classes, runs(spark, d), docs, outputs(spark, d).withColumn("text", F.lit("new")),
        outputs(spark, d).select("document_id", F.lit("000").alias("code")).distinct())
    one = lambda name, kind, key, value: after[name].select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(value).alias("value"))
    return one("runs", "run", "run_id", "status").unionByName(one("documents", "document", "document_id",
            "status")).unionByName(one("outputs", "output", "run_id", "text")).unionByName(one("classifications", "class",
            "document_id", "code"))


def _queue(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view",
        "retry").when(F.col("event_type") == "error", "running").when(F.col("event_type") == "signup",
        "failed").otherwise("succeeded")
    lease = F.when(F.col("event_type") == "error", F.col("ts") + F.make_interval(days=F.lit(10)))
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), kinds.alias("status"),
        (F.col("user_id") % 5).cast("int").alias("attempts"), F.col("ts").alias("available_at"), lease.alias("locked_at"),
        F.when(F.col("event_type") == "error", "w1").alias("locked_by"), F.col("ts").alias("updated_at"),
        F.lit(None).cast("string").alias("last_error"))


_QUEUE = "q AS (SELECT event_id AS run_id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'retry' WHEN 'error' THEN 'running' WHEN 'signup' THEN 'failed' ELSE 'succeeded' END AS status, (user_id % 5)::int AS attempts, ts AS available_at, CASE WHEN event_type = 'error' THEN ts + INTERVAL 10 DAY END AS locked_at, CASE WHEN event_type = 'error' THEN 'w1' END AS locked_by, ts AS updated_at FROM events)"


@query(f"WITH {_QUEUE}, {RUNS} SELECT q.run_id FROM q JOIN runs r USING (run_id) WHERE q.status IN ('queued', 'retry', 'running') AND available_at <= TIMESTAMP '{NOW}' AND (locked_at IS NULL OR locked_at <= TIMESTAMP '{NOW}') AND r.status NOT IN ('succeeded', 'canceled')")
def queue_claimable(spark: SparkSession, d: str) -> DataFrame:
    return T.claimable(_queue(spark, d), runs(spark, d), _now()).select("run_id")


@query(f"WITH {_QUEUE}, {RUNS} SELECT q.run_id, q.attempts + 1 AS attempts, 'w7' AS locked_by, TIMESTAMP '{NOW}' + INTERVAL 60 SECOND AS locked_at FROM q JOIN runs r USING (run_id) WHERE q.status IN ('queued', 'retry', 'running') AND available_at <= TIMESTAMP '{NOW}' AND (locked_at IS NULL OR locked_at <= TIMESTAMP '{NOW}') AND r.status NOT IN ('succeeded', 'canceled') ORDER BY updated_at, run_id LIMIT 1")
def queue_claim(spark: SparkSession, d: str) -> DataFrame:
    return T.claim(_queue(spark, d), runs(spark, d), "w7", _now(), 60).select("run_id", "attempts", "locked_by", "locked_at")


@query(f"WITH {_QUEUE} SELECT run_id, CASE WHEN status <> 'running' THEN status WHEN attempts >= 3 THEN 'failed' ELSE 'retry' END AS status, CASE WHEN status = 'running' AND attempts < 3 THEN TIMESTAMP '{NOW}' + to_seconds(least(300.0, greatest(1.0, pow(2.0, attempts - 1)))) ELSE available_at END AS available_at FROM q")
def queue_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Every running entry fails: it waits 2 ** (attempts - 1) seconds, or is failed for good."""
    q = _queue(spark, d)
    failed = q.where("status = 'running'").select("run_id", F.lit("w1").alias("worker"), F.lit("boom").alias("error"))
    return T.fail(q, failed, 3, _now()).select("run_id", "status", "available_at")


@query(f"WITH {_QUEUE} SELECT run_id, CASE WHEN status = 'running' THEN 'succeeded' ELSE status END AS status, CASE WHEN status = 'running' THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM q")
def queue_complete(spark: SparkSession, d: str) -> DataFrame:
    q = _queue(spark, d)
    return T.complete(q, q.select("run_id", F.lit("w1").alias("worker")), _now()).select("run_id", "status", "updated_at")


@query(f"WITH {_QUEUE}, n AS (SELECT o_orderkey AS run_id FROM orders) SELECT run_id, CASE WHEN n.run_id IS NOT NULL AND (q.status IS NULL OR q.status IN ('failed', 'succeeded')) THEN 'queued' ELSE q.status END AS status, CASE WHEN n.run_id IS NOT NULL AND (q.status IS NULL OR q.status IN ('failed', 'succeeded')) THEN coalesce(attempts, 0) ELSE attempts END AS attempts FROM q FULL JOIN n USING (run_id)")
def queue_enqueue(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"))
    return T.enqueue(_queue(spark, d), new, _now()).select("run_id", "status", "attempts")


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY UNION ALL SELECT -1")
def audit_retention(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.col("ts").alias("created_at"))
    new = spark.range(1).select((F.col("id") - 1).alias("event_id"), _now().alias("created_at"))
    return T.retain_audit(events, new, _now(), 10).select("event_id")


@query("SELECT 'documents_rows' AS name, count(*)::bigint AS value FROM documents UNION ALL SELECT 'documents_text_bytes', sum(strlen(text))::bigint FROM documents UNION ALL SELECT 'documents_bytes', sum(n_chars)::bigint FROM documents UNION ALL SELECT 'pages_rows', count(*) FROM pages UNION ALL SELECT 'pages_text_bytes', sum(strlen(html))::bigint FROM pages UNION ALL SELECT 'events_rows', count(*) FROM events")
def storage_stats(spark: SparkSession, d: str) -> DataFrame:
    return T.statistics({n: table(spark, d, n) for n in ("documents", "pages", "events")}, {"documents": "text", "pages": "html"}, ("documents", "n_chars"))


@query("SELECT 'lineitem' AS child, 'orders' AS parent, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'labels', 'documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'documents', 'labels', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def verify_references(spark: SparkSession, d: str) -> DataFrame:
    t = {"lineitem": table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"),
        **{n: table(spark, d, n) for n in ("orders", "labels", "documents")}}
    return T.verify(t, [("lineitem", "orders", "o_orderkey"), ("labels", "documents", "doc_id"), ("documents", "labels", "doc_id")])


@query("SELECT 'doc_' || doc_id AS document_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def index_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Raw texts whose document is not indexed (has no label)."""
    blobs = table(spark, d, "documents").select(F.concat(F.lit("raw:doc_"), F.col("doc_id").cast("string")).alias("key"), "text")
    return T.backfill(blobs, table(spark, d, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id")))


@query("SELECT d.doc_id AS document_id, 'kept' AS kind FROM documents d JOIN labels USING (doc_id) WHERE quality = 1 UNION ALL SELECT doc_id, 'skipped' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def collect_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    kept, skipped = T.collect_sources(docs.drop("text"), docs.select("document_id", "text"), classifications(spark, d), prefix="1")
    return kept.select("document_id", F.lit("kept").alias("kind")).unionByName(skipped.select("document_id", F.lit("skipped").alias("kind")))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Page records of a manifest a user: source and status from the event's type."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return table(spark, d, "events").select(F.col("user_id").alias("manifest"),
        F.when(kind == "error", "failed").when(kind == "signup", "pending").otherwise("succeeded").alias("status"),
        F.when(kind == "view", "ocr").otherwise("embedded").alias("source"),
        F.when(k < 90, k.cast("double")).alias("confidence"), (k % 7 == 0).alias("corrected"), (k % 4 - 1).alias("attempts"),
        F.col("value").alias("duration_ms"), rollups.page_warnings(F.when(k < 90, k.cast("double")),
            F.when(k % 5 == 0, 90).otherwise(0), 40.0).alias("warnings"))


_PAGES = "p AS (SELECT user_id AS manifest, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'succeeded' END AS status, CASE WHEN event_type = 'view' THEN 'ocr' ELSE 'embedded' END AS source, (props->>'$.k')::int AS k, value FROM events)"


@query(f"WITH {_PAGES} SELECT manifest, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (status = 'pending') > 0 THEN 'pending' ELSE 'succeeded' END AS status, count(*) AS pages, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, coalesce(sum(k % 4 - 1) FILTER (k % 4 >= 1), 0)::bigint AS attempts, count(*) FILTER (source = 'ocr') AS ocr_pages, count(*) FILTER (k % 7 = 0) AS corrected_pages, round(avg(k) FILTER (k < 90), 4) AS average_confidence, round(max(value), 4) AS max_duration_ms FROM p GROUP BY manifest")
def page_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollups.page_summary(_pages(spark, d), ["manifest"]).withColumns({c: F.round(c, 4) for c in ("average_confidence", "max_duration_ms")})


@query(f"""WITH {_PAGES}, w AS (SELECT manifest, 'page-rotation-corrected' AS value FROM p WHERE k % 5 = 0 UNION ALL SELECT manifest, 'missing-ocr-confidence' FROM p WHERE k >= 90 UNION ALL SELECT manifest, 'low-ocr-confidence' FROM p WHERE k < 40) SELECT manifest, value, count(*) AS "count" FROM w GROUP BY 1, 2""")
def warning_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollups.warning_counts(_pages(spark, d), by=["manifest"])


@query(f"""WITH {_PAGES} SELECT manifest, source AS value, count(*) AS "count" FROM p GROUP BY 1, 2""")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollups.value_counts(_pages(spark, d), "source", ["manifest"])


@query("""SELECT event_type AS stage, count(*) AS "count", round(sum(value), 2) AS total_ms, round(max(value), 2) AS max_ms FROM events GROUP BY 1""")
def stage_durations(spark: SparkSession, d: str) -> DataFrame:
    return rollups.stage_durations(_run_events(spark, d), "stage", "duration_ms").withColumns({c: F.round(c, 2) for c in ("total_ms", "max_ms")})


_STATUS_CODE = "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END"


@query(f"SELECT {_STATUS_CODE} AS status_code, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 2) AS duration_ms FROM events GROUP BY 1")
def request_metrics(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select(F.expr(_STATUS_CODE).alias("status_code"), F.col("value").alias("duration_ms"))
    return rollups.request_metrics(calls).withColumn("duration_ms", F.round("duration_ms", 2))


@query("SELECT event_type || ':m' || user_id % 3 AS model, sum((props->>'$.k')::bigint)::bigint AS prompt_tokens, sum(event_id)::bigint AS completion_tokens, sum((props->>'$.k')::bigint + event_id)::bigint AS total_tokens, round(sum((props->>'$.k')::bigint) * 0.5 / 1000 + sum(event_id) * 1.5 / 1000, 4)::double AS estimated_cost FROM events GROUP BY 1")
def llm_usage(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    calls = table(spark, d, "events").select(F.col("event_type").alias("provider"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), k.alias("prompt_tokens"),
        F.col("event_id").alias("completion_tokens"), (k + F.col("event_id")).alias("total_tokens"))
    return rollups.llm_usage(calls, 0.5, 1.5).withColumn("estimated_cost", F.round("estimated_cost", 4))


@query("""SELECT 'stage_total{stage="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def prometheus_lines(spark: SparkSession, d: str) -> DataFrame:
    return rollups.prometheus(rollups.stage_durations(_run_events(spark, d), "stage", "duration_ms"), "stage_total", "count", ["stage"])


@query("SELECT count(*) FILTER (o_orderstatus <> 'P') AS converted, count(*) FILTER (o_orderstatus = 'F') AS ingested, count(*) FILTER (o_orderstatus = 'F') AS processed, count(*) FILTER (o_orderstatus = 'O') AS queued, 0::bigint AS skipped, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders")
def import_summary(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    return rollups.import_summary(table(spark, d, "orders").select(status.alias("status"),
            F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("document_id")))


@query("WITH c AS (SELECT *, quality = 1 AS passed, n_chars // 2 AS output_chars, CASE WHEN toxic = 1 THEN 2 ELSE 0 END AS f, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS w FROM documents JOIN labels USING (doc_id)) SELECT count(*) AS case_count, count(*) FILTER (passed) AS passed_count, count(*) FILTER (NOT passed) AS failed_count, round(count(*) FILTER (passed) / count(*), 6) AS pass_rate, sum(n_chars)::bigint AS total_input_chars, sum(output_chars)::bigint AS total_output_chars, round(avg(n_chars), 4) AS average_chars_per_second, sum(w)::bigint AS warning_count, sum(f)::bigint AS failure_count, count(*) FILTER (w > 0) AS warning_case_count, count(*) FILTER (f > 0) AS failure_case_count FROM c")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    two = lambda when, *v: F.when(when, F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>"))
    cases = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.col("quality") == 1).alias("passed"),
        F.col("n_chars").alias("input_chars"), F.expr("n_chars div 2").alias("output_chars"),
        F.col("n_chars").cast("double").alias("chars_per_second"), two(F.col("quality") == 0, "w").alias("warnings"),
        two(F.col("toxic") == 1, "a", "b").alias("failures"))
    return rollups.eval_summary(cases).withColumns({"pass_rate": F.round("pass_rate", 6), "average_chars_per_second": F.round("average_chars_per_second", 4)})


@query("SELECT user_id, max_by(rot, key) AS rotation, max_by(conf, key) AS confidence FROM (SELECT user_id, (event_id % 4 * 90)::int AS rot, CASE WHEN event_type <> 'error' THEN (props->>'$.k')::double END AS conf, coalesce(CASE WHEN event_type <> 'error' THEN (props->>'$.k')::double END, -1) * 1000 - event_id % 4 * 90 AS key FROM events) GROUP BY user_id")
def best_rotation(spark: SparkSession, d: str) -> DataFrame:
    tries = table(spark, d, "events").select("user_id", (F.col("event_id") % 4 * 90).cast("int").alias("rotation"),
        F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("double")).alias("confidence"),
        F.lit("").alias("text"))
    return rollups.best_rotation(tries, ["user_id"]).drop("text")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, t AS start, 1 AS used, true AS allowed, 0 AS retry_after FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - f.start >= 60 THEN e.t ELSE f.start END, CASE WHEN e.t - f.start >= 60 THEN 1 WHEN f.used >= 2 THEN f.used ELSE f.used + 1 END, e.t - f.start >= 60 OR f.used < 2, CASE WHEN e.t - f.start >= 60 OR f.used < 2 THEN 0 ELSE greatest(1, trunc(60 - (e.t - f.start))::int) END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id, allowed, retry_after FROM f"""
)
def rate_limit_fold(spark: SparkSession, d: str) -> DataFrame:
    """At most two requests a minute and identity, the window beginning with its first request."""
    return streams.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id", 2)


def _commands(spark: SparkSession, d: str) -> DataFrame:
    command = F.expr("CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE CASE WHEN value < 2 THEN 'cancel' ELSE 'enqueue' END END")
    return table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
        command.alias("command"), F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("worker"),
        F.col("props").alias("error"))


@query(
    """WITH RECURSIVE c AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE CASE WHEN value < 2 THEN 'cancel' ELSE 'enqueue' END END AS command, 'w' || user_id % 4 AS worker, props AS error, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT run_id, 0::bigint AS n, NULL::varchar AS status, 0 AS attempts, NULL::varchar AS locked_by, NULL::varchar AS last_error FROM c
UNION ALL SELECT c.run_id, c.n,
 CASE WHEN c.command = 'cancel' THEN 'canceled' WHEN c.command = 'enqueue' AND (s.status IS NULL OR s.status IN ('failed', 'succeeded')) THEN 'queued' WHEN c.command = 'claim' AND s.status IN ('queued', 'retry') THEN 'running' WHEN c.command = 'complete' AND s.status = 'running' AND c.worker = s.locked_by THEN 'succeeded' WHEN c.command = 'fail' AND s.status = 'running' AND c.worker = s.locked_by THEN CASE WHEN s.attempts >= 3 THEN 'failed' ELSE 'retry' END ELSE s.status END,
 CASE WHEN c.command = 'claim' AND s.status IN ('queued', 'retry') THEN s.attempts + 1 ELSE s.attempts END,
 CASE WHEN c.command = 'enqueue' AND (s.status IS NULL OR s.status IN ('failed', 'succeeded')) THEN NULL WHEN c.command = 'claim' AND s.status IN ('queued', 'retry') THEN c.worker WHEN c.command = 'fail' AND s.status = 'running' AND c.worker = s.locked_by THEN NULL ELSE s.locked_by END,
 CASE WHEN c.command = 'cancel' THEN c.error WHEN c.command = 'enqueue' AND (s.status IS NULL OR s.status IN ('failed', 'succeeded')) THEN NULL WHEN c.command = 'fail' AND s.status = 'running' AND c.worker = s.locked_by THEN c.error ELSE s.last_error END
 FROM s JOIN c ON c.run_id = s.run_id AND c.n = s.n + 1)
SELECT run_id, status, attempts, locked_by, last_error FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC) AS last FROM s) WHERE last = 1"""
)
def queue_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of every run after its commands, in order."""
    return streams.queue_states(_commands(spark, d))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS "count" FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed_counts(table(spark, d, "events"), "ts", "event_type").select("window.start", "event_type", "count")


@query("""SELECT event_type AS stage, count(*) AS "count", round(sum(value), 2) AS total_ms FROM events GROUP BY 1""")
def event_stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """The same roll-up by Structured Streaming: the event file is followed until it is drained, the last totals are written and read."""
    at = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = streams.event_tail(spark, f"{d}/events.parquet*", schema).select(F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"))
    streams.drain(streams.stage_totals(stream), lambda batch, _n: batch.write.mode("overwrite").parquet(f"{at}/totals"), f"{at}/checkpoint", "complete")
    return spark.read.parquet(f"{at}/totals").withColumn("total_ms", F.round("total_ms", 2))


#: A detail for every rule and what it should be; the fallbacks by status after it.
_DETAILS = (
    ("Document NOT FOUND", "not_found"), ("Invalid API key", "invalid_api_key"),
        ("scope does not allow this operation", "insufficient_scope"),
        ("Request body contains more than the configured limit", "request_too_large"),
        ("Upload exceeds it", "upload_too_large"), ("Batch upload contains too much, configured limit 3", "batch_too_large"),
    ("Import contains more files than the configured limit", "import_too_large"),
        ("Import manifest contains more bytes than the configured limit", "import_manifest_too_large"),
        ("PDF page manifest contains more than the configured limit", "page_manifest_too_large"),
        ("manifest_path contains more than the configured limit", "import_manifest_too_large"),
    ("bad upload directory", "invalid_upload_path"), ("upload data_dir is bad", "invalid_upload_path"),
        ("Run submission failed", "run_submission_failed"), ("needs job_backend=sqlite", "queue_backend_required"),
        ("no such import root", "invalid_import_path"), ("path must be under it", "invalid_import_path"),
        ("manifest_path is odd", "invalid_manifest_path"),
    ("PDF page manifest is odd", "invalid_manifest_path"), ("output_dir is odd", "invalid_output_dir"),
        ("subdirectory_name is odd", "invalid_subdirectory_name"), ("source_dir is odd", "invalid_source_dir"),
        ("Invalid document_status", "invalid_document_status"), ("Invalid search scope", "invalid_search_scope"),
        ("Search query exceeds configured limit", "search_query_too_large"),
    ("Invalid search query", "invalid_search_query"), ("created_after is later than created_before", "invalid_search_window"),
        ("Archive inputs are not supported", "archive_not_supported"),
        ("Unsupported file extension", "unsupported_file_type"), ("terminal runs cannot be canceled", "run_terminal"),
        ("the run is not failed", "run_not_failed"),
)
_CODES = {401: "unauthorized", 403: "forbidden", 404: "not_found", 413: "payload_too_large", 429: "rate_limited",
    422: "validation_error", 503: "service_unavailable", 400: "bad_request", 500: "server_error", 507: "server_error",
    418: "http_error"}


def _pick(values, by: str) -> str:
    return " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)).join((f"CASE {by} ", " END"))


@query(f"SELECT event_id, CASE WHEN event_id % 41 < 30 THEN {_pick([c for _, c in _DETAILS], 'event_id % 41')} ELSE {_pick(_CODES.values(), 'event_id % 41 - 30')} END AS code FROM events")
def error_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every named rule, and every status where no rule holds."""
    detail = F.coalesce(F.expr(_pick([x for x, _ in _DETAILS], "event_id % 41")), F.lit("other"))
    status = F.when(F.col("event_id") % 41 < 30, 400).otherwise(F.expr(_pick(_CODES, "event_id % 41 - 30")).cast("int"))
    return table(spark, d, "events").select("event_id", X.api_error_code(status, detail).alias("code"))
