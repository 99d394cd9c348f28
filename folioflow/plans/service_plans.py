"""Requests, credentials, queue updates, manifests, names and reports over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import backup, evaluation, manifests, rollups, scans, service
from ..operators import tables as T
from ..session import shared_dir
from ..sources import readers
from .base import RUNS, query, runs, table
from .table_plans import _PAGES, _QUEUE, NOW, _now, _pages, _queue


@query(f"WITH {_QUEUE}, b AS (SELECT event_id AS run_id, CASE WHEN user_id % 2 = 0 THEN 'w1' ELSE 'w2' END AS worker FROM events WHERE event_id % 2 = 0) SELECT q.run_id, CASE WHEN b.worker = q.locked_by AND q.status = 'running' THEN TIMESTAMP '{NOW}' + INTERVAL 90 SECOND ELSE locked_at END AS locked_at, CASE WHEN b.worker = q.locked_by AND q.status = 'running' THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at, CASE WHEN b.run_id IS NULL THEN 'none' ELSE coalesce(b.worker = q.locked_by AND q.status = 'running', false)::varchar END AS extended FROM q LEFT JOIN b USING (run_id)")
def queue_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    """Every other entry gets a beat, of its own worker or of another one."""
    beats = table(spark, d, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("run_id"),
        F.when(F.col("user_id") % 2 == 0, "w1").otherwise("w2").alias("worker"))
    after, told = T.heartbeat(_queue(spark, d), beats, _now(), 90)
    return after.join(told.drop("worker"), "run_id", "left").select("run_id", "locked_at", "updated_at",
        F.coalesce(F.col("extended").cast("string"), F.lit("none")).alias("extended"))


@query(f"WITH {_QUEUE} SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'canceled' ELSE status END AS status, CASE WHEN run_id % 3 <> 0 THEN locked_by END AS locked_by, CASE WHEN run_id % 3 <> 0 THEN locked_at END AS locked_at, CASE WHEN run_id % 3 = 0 THEN 'stop ' || run_id ELSE NULL END AS last_error, CASE WHEN run_id % 3 = 0 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM q")
def queue_cancel(spark: SparkSession, d: str) -> DataFrame:
    q = _queue(spark, d)
    gone = q.where("run_id % 3 = 0").select("run_id", F.concat(F.lit("stop "), F.col("run_id").cast("string")).alias("error"))
    return T.cancel(q, gone, _now()).select("run_id", "status", "locked_by", "locked_at", "last_error", "updated_at")


@query(f"WITH {RUNS}, p AS (SELECT l_orderkey AS run_id, max(l_linenumber)::int AS completed_chunks FROM lineitem GROUP BY 1) SELECT r.run_id, CASE WHEN p.run_id IS NOT NULL AND r.status <> 'failed' THEN 'running' WHEN r.status = 'failed' THEN 'canceled' ELSE r.status END AS status, CASE WHEN p.run_id IS NOT NULL AND r.status <> 'failed' THEN p.completed_chunks ELSE 0 END AS completed_chunks FROM runs r LEFT JOIN p USING (run_id)")
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    """A run's lines are its chunks; each tells how far it is, the furthest counts; failed runs stand for canceled ones."""
    held = runs(spark, d).withColumn("status",
        F.when(F.col("status") == "failed", "canceled").otherwise(F.col("status"))).withColumns({"completed_chunks": F.lit(0),
            "failed_chunks": F.lit(0), "updated_at": _now()})
    told = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.lit("running").alias("status"),
        F.lit("clean").alias("stage"), F.col("l_linenumber").cast("int").alias("completed_chunks"),
        F.lit(0).alias("failed_chunks"))
    return T.update_progress(held, told, _now()).select("run_id", "status", "completed_chunks")


@query("SELECT 'run_' || substr(sha256(c_custkey || ':1'), 1, 16) AS run_id, c_custkey AS document_id, 'queued' AS status, 'queued processing run' AS message FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'unknown', o_custkey + 1000000, '', '' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 10 = 0)")
def runs_started(spark: SparkSession, d: str) -> DataFrame:
    """A run and its first event for each wanted document; ids that are none are told."""
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"))
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"))
    wanted = wanted.unionByName(wanted.where("document_id % 10 = 0").select((F.col("document_id") + 1000000).alias("document_id")))
    started, events, unknown = T.start_runs(docs, wanted, "1", _now())
    return started.join(events.select("run_id", "message"), "run_id").select("run_id", "document_id", "status",
        "message").unionByName(unknown.select(F.lit("unknown").alias("run_id"), "document_id", F.lit("").alias("status"),
            F.lit("").alias("message")))


@query(f"WITH {_QUEUE}, {RUNS}, due AS (SELECT q.* FROM q JOIN runs r USING (run_id) WHERE q.status IN ('queued', 'retry', 'running') AND available_at <= TIMESTAMP '{NOW}' AND (locked_at IS NULL OR locked_at <= TIMESTAMP '{NOW}') AND r.status NOT IN ('succeeded', 'canceled') ORDER BY updated_at, run_id LIMIT 200), o AS (SELECT *, CASE run_id % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'canceled' ELSE 'lost' END AS outcome FROM due) SELECT q.run_id, CASE outcome WHEN 'succeeded' THEN 'succeeded' WHEN 'canceled' THEN 'canceled' ELSE CASE WHEN outcome IS NULL THEN q.status WHEN q.attempts + 1 >= 3 THEN 'failed' ELSE 'retry' END END AS status, CASE WHEN outcome IS NULL THEN q.attempts ELSE q.attempts + 1 END AS attempts, CASE outcome WHEN 'failed' THEN 'boom' WHEN 'lost' THEN 'no outcome' ELSE NULL END AS last_error FROM q LEFT JOIN o USING (run_id)")
def queue_worked(spark: SparkSession, d: str) -> DataFrame:
    """A worker's turn: 200 entries claimed and processed in one job; some succeed, fail, are canceled or are lost."""

    def process(work: DataFrame) -> DataFrame:
        kind = F.col("run_id") % 4
        return work.where(kind != 3).select("run_id",
            F.when(kind == 0, "succeeded").when(kind == 1, "failed").otherwise("canceled").alias("outcome"),
            F.when(kind == 1, "boom").alias("error"))

    after, _ = T.work_once(_queue(spark, d), runs(spark, d), "w9", _now(), 60, process, 3, 200)
    return after.select("run_id", "status", "attempts", "last_error")


@query(f"WITH {RUNS} SELECT count(*) FILTER (status = 'succeeded') AS runs_completed_total, count(*) FILTER (status = 'failed') AS runs_failed_total, count(*) FILTER (status = 'canceled') AS runs_canceled_total FROM runs")
def runs_finished(spark: SparkSession, d: str) -> DataFrame:
    return rollups.runs_finished(runs(spark, d))


@query(f"SELECT count(*) AS queue_claims_total, sum(greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) // 1000, 0))::bigint AS queue_wait_ms_total FROM events")
def queue_claim_waits(spark: SparkSession, d: str) -> DataFrame:
    return rollups.queue_claims(table(spark, d, "events").select(F.col("ts").alias("available_at"), _now().alias("claimed_at")))


@query(
    f"""WITH {RUNS} SELECT (SELECT count(*) FROM runs WHERE status = 'succeeded') AS runs_completed_total, (SELECT count(*) FROM runs WHERE status = 'failed') AS runs_failed_total, count(*) AS requests_total, count(*) FILTER (event_type = 'error') AS errors_total,
round(sum(value) / count(*), 6) AS average_request_ms, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate, round((SELECT count(*) FILTER (status = 'failed') / count(*) FILTER (status IN ('failed', 'succeeded')) FROM runs), 6) AS run_failure_rate, 0.0::double AS average_queue_wait_ms, round(sum(event_id) / count(*), 6)::double AS average_tokens_per_request FROM events"""
)
def metrics_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Counters and guarded ratios in one row; there are no claims, so their mean wait is 0."""
    events = table(spark, d, "events")
    requests = events.select(F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.col("value").alias("duration_ms"))
    claims = events.where("false").select(F.col("ts").alias("available_at"), F.col("ts").alias("claimed_at"))
    one = rollups.snapshot(runs(spark, d), requests, claims, events.select(F.col("event_id").alias("total_tokens")))
    ratios = ("average_request_ms", "error_rate", "run_failure_rate", "average_queue_wait_ms", "average_tokens_per_request")
    return one.select("runs_completed_total", "runs_failed_total", "requests_total", "errors_total", *(F.round(c, 6).alias(c) for c in ratios))


@query(f"WITH {_PAGES} SELECT source || ':' || status AS key, count(*) AS pages, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (k % 7 = 0) AS corrected, round(sum(value), 2) AS duration_ms FROM p GROUP BY 1")
def ocr_pages_by_source(spark: SparkSession, d: str) -> DataFrame:
    return rollups.ocr_page_counts(_pages(spark, d)).withColumn("duration_ms", F.round("duration_ms", 2))


@query("""SELECT CASE event_type WHEN 'error' THEN 'unsupported' WHEN 'click' THEN 'dependency-missing' WHEN 'view' THEN 'empty-output' ELSE 'extraction-failed' END || ':' || CASE WHEN user_id % 2 = 0 THEN 'pdf' ELSE 'none' END AS key, count(*) AS "count" FROM events GROUP BY 1""")
def conversion_failure_counts(spark: SparkSession, d: str) -> DataFrame:
    message = F.expr("CASE event_type WHEN 'error' THEN 'Unsupported file extension: .x' WHEN 'click' THEN 'OCR requires installing tesseract' WHEN 'view' THEN 'No extractable text' ELSE 'broken' END")
    failures = table(spark, d, "events").select(X.conversion_failure(message).alias("failure"),
        F.when(F.col("user_id") % 2 == 0, "pdf").otherwise("").alias("extension"))
    return rollups.conversion_failures(failures)


_KEY = "CASE user_id % 4 WHEN 0 THEN 'read: k' || user_id WHEN 1 THEN ' Admin:k' || user_id || ' ' WHEN 2 THEN 'read:' ELSE 'other:k' || user_id END"


@query(f"SELECT event_id, {_KEY} AS entry, CASE user_id % 4 WHEN 0 THEN 'k' || user_id WHEN 1 THEN 'k' || user_id WHEN 2 THEN 'read:' ELSE 'other:k' || user_id END AS key, CASE WHEN user_id % 4 = 0 THEN 'read' ELSE 'write' END AS scope FROM events")
def api_credentials(spark: SparkSession, d: str) -> DataFrame:
    entry = F.expr(_KEY.replace("'read: k' || user_id", "concat('read: k', user_id)").replace("' Admin:k' || user_id || ' '",
            "concat(' Admin:k', user_id, ' ')").replace("'other:k' || user_id", "concat('other:k', user_id)"))
    return table(spark, d, "events").select("event_id", entry.alias("entry")).withColumn("_c",
        service.credential(F.col("entry"))).select("event_id", "entry", "_c.key", "_c.scope")


@query("""WITH r AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'GET' ELSE 'POST' END AS method, CASE event_type WHEN 'click' THEN '/search/results' WHEN 'error' THEN '/config' WHEN 'view' THEN CASE WHEN user_id % 5 = 0 THEN '/metrics' ELSE '/documents' END ELSE '/runs' END AS path FROM events),
s AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'read' WHEN user_id % 3 = 1 THEN 'write' END AS scope FROM r)
SELECT event_id, scope, coalesce(CASE scope WHEN 'write' THEN true WHEN 'read' THEN path NOT IN ('/config', '/metrics') AND (method = 'GET' OR path = '/search/results') END, false) AS allowed FROM s""")
def api_access(spark: SparkSession, d: str) -> DataFrame:
    """Requests with the scope of their key, given in plain or as a hash, and what it allows. Of two credentials with one key the first counts."""
    e = table(spark, d, "events")
    method = F.when(F.col("event_type") == "view", "GET").otherwise("POST")
    path = F.expr("CASE event_type WHEN 'click' THEN '/search/results' WHEN 'error' THEN '/config' WHEN 'view' THEN CASE WHEN user_id % 5 = 0 THEN '/metrics' ELSE '/documents' END ELSE '/runs' END")
    users = e.select("user_id").distinct().where("user_id % 3 < 2")
    key, scope = F.concat(F.lit("key"), F.col("user_id").cast("string")), F.when(F.col("user_id") % 3 == 0, "read").otherwise("write")
    hashed = F.col("user_id") % 2 == 0
    known = users.select(F.lit(1).alias("ordinal"), F.when(hashed, F.sha2(key, 256)).otherwise(key).alias("key"), scope.alias("scope"), hashed.alias("hashed"))
    later = users.select(F.lit(2).alias("ordinal"), key.alias("key"), F.lit("none").alias("scope"), F.lit(False).alias("hashed"))
    supplied = service.supplied_key(F.when(F.col("user_id") % 2 == 0, key), F.concat(F.lit("bearer "), key))
    requests = e.select("event_id", method.alias("method"), path.alias("path"), supplied.alias("supplied"))
    return service.matched_credential(requests, known.unionByName(later)).select("event_id", "scope",
        F.coalesce(service.allows(F.col("scope"), F.col("method"), F.col("path")), F.lit(False)).alias("allowed"))


@query("SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'api-key:' || sha256('k' || user_id) WHEN 1 THEN 'ip:203.0.113.' || user_id % 200 WHEN 2 THEN 'ip:198.51.100.' || user_id % 200 ELSE 'ip:10.0.0.' || user_id % 200 END AS identity FROM events")
def rate_limit_identities(spark: SparkSession, d: str) -> DataFrame:
    """By key; by the forwarded address behind a trusted proxy; by the peer if the proxy is not trusted, or what it says is no address."""
    last = (F.col("user_id") % 200).cast("string")
    kind = F.col("user_id") % 4
    key = F.when(kind == 0, F.concat(F.lit("k"), F.col("user_id").cast("string")))
    host = F.when(kind == 2, F.concat(F.lit("198.51.100."), last)).otherwise(F.concat(F.lit("10.0.0."), last))
    forwarded = F.when(kind == 3, "nonsense").otherwise(F.concat(F.lit(" 203.0.113."), last, F.lit(", 10.0.0.1")))
    return table(spark, d, "events").select("event_id",
        service.rate_limit_identity(key, service.client_host(host, forwarded, "10.0.0.0/8, 2001:db8::/32")).alias("identity"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'scope=read' WHEN event_type = 'click' THEN 'present' ELSE '' END AS credential FROM events ORDER BY event_id DESC LIMIT 40 OFFSET 20")
def audit_page(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id",
        service.credential_summary(F.col("event_type").isin("view", "click"),
            F.when(F.col("event_type") == "view", "read")).alias("credential"))
    return T.page(events, [F.desc("event_id")], 40, 20)


@query(f"""WITH {RUNS}, t AS (SELECT user_id AS run_id, string_agg('data: ' || event_type || ': ' || props || chr(10) || chr(10), '' ORDER BY event_id) AS text FROM events GROUP BY 1) SELECT t.run_id, text || CASE WHEN status IS NULL OR status IN ('succeeded', 'failed', 'canceled') THEN 'event: done' || chr(10) || 'data: done' || chr(10) || chr(10) ELSE '' END AS text FROM t LEFT JOIN runs USING (run_id)""")
def event_stream_text(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("event_id").alias("sequence"), F.col("user_id").alias("run_id"),
        F.col("event_type").alias("stage"), F.col("props").alias("message"))
    return service.event_text(events, runs(spark, d))


@query("""SELECT event_id, '{"level":"INFO","logger":"api","message":"token=[REDACTED] by ' || user_id || '","timestamp":"2024-01-01"' || ',"status_code":' || event_id % 7 || CASE WHEN event_type = 'view' THEN ',"run_id":"r' || user_id || '"' ELSE '' END || '}' AS line FROM events""")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.lit("INFO").alias("level"), F.lit("api").alias("logger"),
        F.concat(F.lit("token=s3cr3t by "), F.col("user_id").cast("string")).alias("message"),
        F.lit("2024-01-01").alias("timestamp"), (F.col("event_id") % 7).alias("status_code"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("r"), F.col("user_id").cast("string"))).alias("run_id"))
    return service.log_line(e, keep=("event_id",))


@query("SELECT event_id, map_extract_value(m, 'b') AS b, map_extract_value(m, 'a') AS a, cardinality(m) AS n FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN map([]::varchar[], []::varchar[]) WHEN event_id % 5 = 1 THEN map(['a', 'b'], [event_id || '=x', 'z']) ELSE map(['a'], [user_id::varchar]) END AS m FROM events)")
def otel_headers(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 5 = 1 THEN concat(' a = ', event_id, '=x , b=z') ELSE concat('a=0,a=', user_id) END")
    return table(spark, d, "events").select("event_id", service.otel_headers(text).alias("m")).select("event_id",
        F.col("m")["b"].alias("b"), F.col("m")["a"].alias("a"), F.size("m").alias("n"))


@query("SELECT event_id % 12 AS attempt, least(0.5 * pow(2.0, event_id % 12), 8.0)::double AS seconds, count(*) AS n FROM events GROUP BY 1, 2")
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("event_id") % 12).alias("attempt")).select("attempt",
        service.retry_delay(F.col("attempt"), 0.5, 8.0).alias("seconds")).groupBy("attempt",
        "seconds").agg(F.count(F.lit(1)).alias("n"))


# --- manifests, names, reports


@query("""SELECT page_id, '{"generated_by":"folioflow","artifact_type":"conversion-sidecar","source_path":"/in/' || page_id || '.html","output_path":"/out/' || page_id || '.md","format":"md","output_chars":' || length(html) || ',"extraction":null}' AS json, '/out/' || page_id || '.md.json' AS path FROM pages""")
def conversion_sidecars(spark: SparkSession, d: str) -> DataFrame:
    name = lambda pre, post: F.concat(F.lit(pre), F.col("page_id").cast("string"), F.lit(post))
    return table(spark, d, "pages").select("page_id",
        manifests.sidecar(name("/in/", ".html"), name("/out/", ".md"), F.lit("md"), F.col("html")).alias("json"),
        manifests.sidecar_path(name("/out/", ".md")).alias("path"))


def _page_records(spark: SparkSession, d: str) -> DataFrame:
    """Users are files, their events pages; the last page of each is missing."""
    k = F.get_json_object("props", "$.k").cast("int")
    numbered = table(spark, d, "events").selectExpr("*",
        "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page_number",
        "count(*) OVER (PARTITION BY user_id) AS page_count")
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), F.col("event_id").cast("string")))
    source = F.when(F.col("event_type") == "view", "ocr").when(F.col("event_type") == "signup", "pending").otherwise("embedded")
    warnings = rollups.page_warnings(F.when(k < 90, k.cast("double")), F.when(k % 5 == 0, 90).otherwise(0), 40.0)
    text = F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit(" page "), F.col("event_id").cast("string"), F.lit(" ")))
    return numbered.where("page_number < page_count OR page_count = 1").select(
        F.col("user_id").alias("file"), "page_number", F.col("page_count").cast("int").alias("page_count"), text.alias("text"),
            source.alias("source"), F.when(k < 90, k.cast("double")).alias("confidence"), (k % 7 == 0).alias("corrected"),
            error.alias("error"), F.lit(None).cast("string").alias("raw_text"),
            F.lit(None).cast("string").alias("image_path"),
        F.when(k % 5 == 0, 90).otherwise(0).alias("rotation_degrees"), warnings.alias("warnings"), (k % 4).alias("attempts"),
            F.round("value", 3).alias("duration_ms"), F.concat(F.lit("/in/a_b-"), F.col("user_id").cast("string"),
                F.lit(".pdf")).alias("source_path"), F.sha2(F.col("user_id").cast("string"), 256).alias("source_sha256"),
            F.lit("{}").alias("extraction_config"),
    )


_RECORDS = """n AS (SELECT *, (props->>'$.k')::int AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page_number, count(*) OVER (PARTITION BY user_id) AS page_count FROM events),
r AS (SELECT user_id AS file, page_number, page_count, event_id, k, value, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'succeeded' END AS status, CASE event_type WHEN 'view' THEN 'ocr' WHEN 'signup' THEN 'pending' ELSE 'embedded' END AS source, event_type FROM n WHERE page_number < page_count OR page_count = 1)"""


@query(f"""WITH {_RECORDS}, every AS (SELECT file, page_number, status, source, k % 4 AS attempts, CASE WHEN event_type = 'error' THEN '' ELSE ' page ' || event_id || ' ' END AS text FROM r UNION ALL SELECT user_id, page_count, 'pending', 'pending', 0, '' FROM n WHERE page_number = page_count AND page_count > 1)
SELECT file, page_number::int AS page_number, status, source, attempts, text, count(*) FILTER (status = 'failed') OVER (PARTITION BY file)::int AS failed_pages, sum(attempts) OVER (PARTITION BY file)::int AS all_attempts, CASE WHEN count(*) FILTER (status = 'failed') OVER (PARTITION BY file) > 0 THEN 'failed' WHEN count(*) FILTER (status = 'pending') OVER (PARTITION BY file) > 0 THEN 'pending' ELSE 'succeeded' END AS file_status FROM every""")
def page_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON and read again: all pages with the summary of their file; the missing page is pending."""
    written = manifests.page_manifest(_page_records(spark, d), ["file"])
    read = written.select("file", manifests.read_page_manifest(F.col("json"))["manifest"].alias("m"))
    return read.select("file", F.inline("m.pages"), F.col("m.summary.status_counts")["failed"].alias("failed_pages"),
        F.col("m.summary.attempts").alias("all_attempts"), F.col("m.summary.status").alias("file_status")).select("file",
        "page_number", "status", "source", "attempts", "text", "failed_pages", "all_attempts", "file_status")


@query(f"WITH {_RECORDS} SELECT page_number::int AS page_number, event_id FROM r WHERE file = (SELECT min(user_id) FROM events WHERE event_type = 'error') AND status = 'failed' ORDER BY page_number LIMIT 5 OFFSET 1")
def failed_pages(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "events").where("event_type = 'error'").agg(F.min("user_id").alias("file"))
    pages = _page_records(spark, d).withColumn("status", rollups.page_status(F.col("error"), F.col("source"))).join(F.broadcast(first), "file")
    return manifests.page_window(pages, 5, 1, True).select(F.col("page_number").cast("int").alias("page_number"),
        F.regexp_extract("error", "[0-9]+", 0).cast("bigint").alias("event_id"))


@query(f"WITH {_RECORDS} SELECT file, page_number::int AS page_number, (k % 4)::int AS attempts FROM r")
def page_attempts(spark: SparkSession, d: str) -> DataFrame:
    """What earlier manifests say of attempts, read from their JSON; twice the same manifest counts once."""
    written = manifests.page_manifest(_page_records(spark, d), ["file"])
    stored = manifests.pages_of(written.unionByName(written), by=["file"]).where("source <> 'pending' OR chars IS NOT NULL")
    return manifests.previous_attempts(stored, ["file"]).select("file", "page_number", "attempts")


@query(rf"""WITH {_RECORDS}, b AS (SELECT file, page_number, CASE WHEN event_type = 'error' THEN '<!-- page: ' || page_number || ' source: ' || source || ' status: failed error: broken ' || event_id || ' -->' || chr(10) ELSE '<!-- page: ' || page_number || ' source: ' || source || ' corrected: ' || (k % 7 = 0) || ' -->' || chr(10) || chr(10) || '#### Page ' || page_number || chr(10) || chr(10) || 'page ' || event_id || chr(10) END AS block FROM r)
SELECT file, '---' || chr(10) || 'generated_by: folioflow' || chr(10) || 'artifact_type: pdf-page-extraction' || chr(10) || 'source_file: a_b-' || file || '.pdf' || chr(10) || 'page_count: ' || count(*) || chr(10) || '---' || chr(10) || chr(10) || '# a b ' || file || chr(10) || chr(10) || rtrim(string_agg(block, chr(10) ORDER BY page_number), chr(10)) || chr(10) AS markdown FROM b GROUP BY file""")
def pages_markdown(spark: SparkSession, d: str) -> DataFrame:
    return manifests.pages_markdown(_page_records(spark, d), ["file"])


@query("SELECT o_orderkey AS source_path, CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status, count(*) FILTER (o_orderstatus <> 'P') OVER ()::int AS converted, count(*) FILTER (o_orderstatus = 'P') OVER ()::int AS failed FROM orders")
def import_reports(spark: SparkSession, d: str) -> DataFrame:
    """The report of an import written as JSON and read again."""
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    none = F.lit(None).cast("string")
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("source_path"), none.alias("converted_path"),
        none.alias("document_id"), none.alias("run_id"), status.alias("status"), none.alias("error"))
    ddl = "summary struct<converted:int,failed:int>, items array<struct<source_path:string,status:string>>"
    read = manifests.import_report(items).select(F.from_json("json",
            ddl).alias("j")).select(F.col("j.summary.converted").alias("converted"), F.col("j.summary.failed").alias("failed"),
        F.inline("j.items"))
    return read.select(F.col("source_path").cast("bigint").alias("source_path"), "status", "converted", "failed")


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/o/' || source || '.md' WHEN 1 THEN '/o/x.md' ELSE '/o/x-' || (doc_id % 7) || '.md' END AS p FROM documents),
t AS (SELECT DISTINCT regexp_replace(p, '\\.md$', '') AS stem FROM s), e AS (SELECT '/o/x' AS stem), r AS (SELECT doc_id, regexp_replace(p, '\\.md$', '') AS stem, row_number() OVER (PARTITION BY p ORDER BY doc_id) - CASE WHEN p = '/o/x.md' THEN 0 ELSE 1 END AS j FROM s),
taken AS (SELECT regexp_extract(stem, '^(.*)-([2-9]|[1-9][0-9]+)$', 1) AS base, regexp_extract(stem, '^(.*)-([2-9]|[1-9][0-9]+)$', 2)::int AS k FROM t WHERE regexp_matches(stem, '^(.*)-([2-9]|[1-9][0-9]+)$')),
g AS (SELECT base, list(k) AS ks FROM taken GROUP BY 1)
SELECT doc_id, CASE WHEN j = 0 THEN stem || '.md' ELSE stem || '-' || list_filter(range(2, 40 + j), lambda f: NOT list_contains(coalesce(ks, []::int[]), f::int))[j] || '.md' END AS path FROM r LEFT JOIN g ON base = stem""")
def unique_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths that many rows share, that look like numbered ones, or that exist already."""
    path = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('/o/', source, '.md') WHEN 1 THEN '/o/x.md' ELSE concat('/o/x-', doc_id % 7, '.md') END")
    there = spark.range(1).select(F.lit("/o/x.md").alias("path"))
    return readers.unique_paths(table(spark, d, "documents").select("doc_id", path.alias("path")), "path", "doc_id", there)


_FILES = "CASE doc_id % 11 WHEN 0 THEN 'txt' WHEN 1 THEN 'MD' WHEN 2 THEN 'csv' WHEN 3 THEN 'html' WHEN 4 THEN 'exe' WHEN 5 THEN 'txt' WHEN 6 THEN 'md' WHEN 7 THEN 'txt' WHEN 8 THEN 'csv' WHEN 9 THEN 'json' ELSE 'json' END"


@query(rf"""WITH f AS (SELECT doc_id, doc_id % 11 AS g, text, strlen(text) AS n FROM documents),
s AS (SELECT doc_id, CASE WHEN g = 4 THEN 'unsupported file extension: exe' WHEN g IN (0, 1, 2) AND n > 4000 THEN 'file exceeds the configured limit' WHEN g = 5 THEN 'file is not valid UTF-8' WHEN g = 6 THEN 'archive inputs are not supported: zip' WHEN g = 7 THEN 'file is binary' WHEN g = 8 THEN 'no extractable text' END AS error, CASE g WHEN 3 THEN 'a b & c' WHEN 9 THEN '{{' || chr(10) || '  "a": ' || doc_id || chr(10) || '}}' WHEN 10 THEN '{{bad' ELSE text END AS text FROM f)
SELECT doc_id, CASE WHEN error IS NULL THEN 'converted' ELSE 'failed' END AS status, error, CASE WHEN error IS NULL THEN md5(text) END AS h, CASE WHEN error IS NULL THEN NULL WHEN error LIKE 'unsupported%' THEN 'unsupported' WHEN error LIKE 'no extractable%' THEN 'empty-output' ELSE 'extraction-failed' END AS failure FROM s""")
def extract_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Files of every kind, and files that can't be read: another kind, too large, no UTF-8, an archive, a NUL byte, blank. Each has a status; none fails the job."""
    g = F.col("doc_id") % 11
    data = F.encode("text", "UTF-8")
    content = F.when(g == 3, F.encode(F.lit("<head>x</head><p>a <b>b</b> &amp; c</p>"), "UTF-8")).when(g == 4,
        F.unhex(F.lit("FF00FE"))).when(g == 5, F.concat(data, F.unhex(F.lit("FF")))).when(g == 6,
        F.concat(F.unhex(F.lit("504B0304")), data)).when(g == 7, F.concat(F.unhex(F.lit("00")), data)).when(g == 8,
        F.encode(F.lit(" \n"), "UTF-8")).when(g == 9, F.encode(F.concat(F.lit('{"a":'), F.col("doc_id").cast("string"),
                F.lit("}")), "UTF-8")).when(g == 10, F.encode(F.lit("{bad"), "UTF-8")).otherwise(data)
    small = (F.length(content) <= 4000) | g.isin(3, 4, 5, 6, 7)
    files = table(spark, d, "documents").select("doc_id",
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("."), F.expr(_FILES)).alias("source_path"),
        content.alias("content"), small.alias("_small"))
    limited = readers.extract(files.where("NOT _small"), 4000).unionByName(readers.extract(files.where("_small")))
    return limited.select("doc_id", "status", "error", F.md5("text").alias("h"), "failure")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '.txt' ELSE 'é' || doc_id || '.md' END AS name FROM documents")
def truncated_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of up to 1,500 bytes cut to 255 between characters, extension kept; told by the first part and the ending."""
    long = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.repeat(F.lit("漢é"), F.lit(100)),
            F.lit(".txt"))).otherwise(F.concat(F.lit("é"), F.col("doc_id").cast("string"), F.repeat(F.lit("x"), F.lit(300)),
            F.lit(".md")))
    cut = X.truncate_filename(long)
    checked = F.when(F.octet_length(cut).between(252, 255) & F.startswith(long, X.sub(cut, r"\.[^.]*$", "")),
        F.regexp_replace(cut, "[漢é]*(\\.txt)|x*(\\.md)", "$1$2"))
    return table(spark, d, "documents").select("doc_id", checked.alias("name"))


@query("SELECT event_id, (event_id % 5 * 90)::int % 450 AS given, CASE WHEN event_id % 5 < 4 THEN (event_id % 5 * 90)::int ELSE 0 END AS rotation, CASE WHEN event_id % 3 = 0 THEN event_id::int WHEN event_id % 3 = 1 THEN 7 ELSE 0 END AS number, CASE WHEN event_id % 2 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS media FROM events")
def manifest_values(spark: SparkSession, d: str) -> DataFrame:
    """Rotations, counts and media types of manifests: what is none gets its default."""
    given = (F.col("event_id") % 5 * 90).cast("int")
    number = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, "7").otherwise("x")
    return table(spark, d, "events").select("event_id", given.alias("given"), manifests.rotation_degrees(given).alias("rotation"),
        manifests.int_or(number).alias("number"), manifests.figure_media_type(F.when(F.col("event_id") % 2 == 0,
                ".JPG").otherwise("odd")).alias("media"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN '' ELSE 'n' || user_id END AS warnings, CASE event_id % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN '' ELSE 'n' || user_id || ',1' END AS tags FROM events""")
def json_lists(spark: SparkSession, d: str) -> DataFrame:
    """Warnings keep strings alone; tags of a column are read as text; what is no list is empty."""
    raw = F.expr("""CASE event_id % 3 WHEN 0 THEN '["a", null, "b"]' WHEN 1 THEN '{"a": 1}' ELSE concat('["n', user_id, '", 1]') END""")
    return table(spark, d, "events").select("event_id", F.array_join(manifests.warnings_of(raw), ",").alias("warnings"),
        F.array_join(X.tags_from_json(raw), ",").alias("tags"))


@query("""SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN '[f1]' || chr(10) || chr(10) || '**Figure (page 1):** image/png of ' || doc_id || ' then [f2]' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '**Figure (page 2):** image/jpeg of ' || doc_id ELSE '' END || ' end' ELSE '[f1] then [f2] end' END AS text, CASE WHEN doc_id % 3 = 0 THEN 1 + (doc_id % 2 = 0)::int ELSE 0 END AS n_figures FROM documents""")
def figures_described(spark: SparkSession, d: str) -> DataFrame:
    """Two placeholders a text; documents of every third id have figures, a repeated one, one too small, and one that the model fails on."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit("[f1] then [f2] end").alias("text"))
    each = F.array(*(F.struct(F.lit(o).alias("ordinal"), F.lit(p).alias("placeholder"), F.lit(g).alias("page"),
                F.lit(m).alias("media_type"), F.lit(s).alias("size")) for o, p, g, m,
            s in ((1, "[f1]", 1, "image/png", 5), (2, "[f1]", 9, "image/gif", 5), (3, "[f3]", 3, "image/png", 5),
                (4, "[f2]", 2, "image/jpeg", 1), (5, "[f2]", 2, "image/jpeg", 6))))
    figures = docs.where("document_id % 3 = 0").select("document_id", F.inline(each)).withColumn("data",
        F.encode(F.rpad(F.col("document_id").cast("string"), 12, " "), "UTF-8")).withColumn("data",
        F.when(F.col("size") == 1, F.encode(F.lit("x"), "UTF-8")).otherwise(F.col("data")))
    described = lambda media, data: F.when(~((media == "image/jpeg") & (F.trim(F.decode(data,
            "UTF-8")).try_cast("int") % 2 == 1)), F.concat(F.lit(" "), media, F.lit(" of "),
            F.trim(F.decode(data, "UTF-8"))))
    return manifests.enrich_figures(docs, figures, described, least_bytes=5)


@query("SELECT event_id AS page, CASE WHEN c0 >= 60 THEN 0 ELSE best END AS rotation FROM (SELECT event_id, (props->>'$.k')::double AS c0, CASE WHEN (props->>'$.k')::double >= user_id AND (props->>'$.k')::double >= event_id % 100 THEN 0 WHEN user_id >= event_id % 100 THEN 90 ELSE 180 END AS best FROM events)")
def rotation_choices(spark: SparkSession, d: str) -> DataFrame:
    """Upright if usable, else the most confident try, the smaller rotation on ties; a failed try and one without confidence are least."""
    k = F.get_json_object("props", "$.k").cast("double")
    tries = F.array(*(F.struct(F.lit(r).alias("rotation"), c.alias("confidence"), t.alias("text")) for r, c,
            t in ((0, k, F.lit("a")), (90, F.col("user_id").cast("double"), F.lit("b")),
                (180, (F.col("event_id") % 100).cast("double"), F.lit("c")), (270, F.lit(None).cast("double"), F.lit("d")))))
    rows = table(spark, d, "events").select(F.col("event_id").alias("page"), F.inline(tries))
    return scans.rotation_choice(rows, ["page"], 60.0).select("page", "rotation")


@query("""WITH k AS (SELECT event_id, (props->>'$.k')::int AS k FROM events WHERE event_type IN ('view', 'error')) SELECT event_id AS page_number, CASE WHEN k < 50 THEN 'a b ' || event_id ELSE 'a  b' || chr(10) || event_id END AS text, k < 50 AS corrected, CASE WHEN k < 50 THEN 'a  b' || chr(10) || event_id END AS raw_text FROM k""")
def pages_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Pages of low confidence go through the stand-in model; the others stay."""
    k = F.get_json_object("props", "$.k").cast("double")
    pages = table(spark, d, "events").where("event_type IN ('view', 'error')").select(F.col("event_id").alias("page_number"),
        F.concat(F.lit("a  b\n"), F.col("event_id").cast("string")).alias("text"), k.alias("confidence"))
    return scans.corrected(pages, scans.mock_correction, "low-confidence", 50.0).select("page_number", "text", "corrected", "raw_text")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '- item ' || page_id WHEN page_id % 3 = 1 THEN '1. item ' || page_id ELSE 'item ' || page_id END || chr(10) || chr(10) || 'a | ' || page_id || chr(10) || 'c' || chr(10) || chr(10) || 'head' AS text FROM pages")
def word_texts(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs, a table and a header, in whatever order the parts come."""
    pages = table(spark, d, "pages")
    number = F.col("page_id").cast("string")
    none = F.lit(None).cast("array<array<string>>")
    part = lambda place, o, text, style, rows: F.struct(F.lit(place).alias("place"), F.lit(o).alias("ordinal"),
        text.cast("string").alias("text"), style.cast("string").alias("style"), rows.alias("rows"))
    style = F.when(F.col("page_id") % 3 == 0, "List Bullet 2").when(F.col("page_id") % 3 == 1, "List Number").otherwise("Normal")
    cells = F.array(F.array(F.lit(" a "), F.lit(""), number), F.array(F.lit(" "), F.lit("")), F.array(F.lit("c"), F.lit("")))
    parts = pages.select("page_id", F.inline(F.array(part("header", 0, F.lit("head"), F.lit(None), none),
                part("body", 3, F.lit(None), F.lit(None), cells), part("body", 1, F.lit("  "), F.lit("Normal"), none),
                part("body", 2, F.concat(F.lit(" item "), number), style, none))))
    return manifests.word_text(parts, ["page_id"])


# --- evaluation


@query("SELECT doc_id, t.r AS r, t.c AS c, t.cell AS cell FROM documents, LATERAL (VALUES (0, 0, 'name'), (0, 1, 'value'), (1, 0, source), (1, 1, doc_id::varchar), (2, 0, lang), (2, 1, '')) t(r, c, cell)")
def markdown_table_cells(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("intro\n| name | value |\n|:---|---:|\n| "), "source", F.lit(" | "), F.col("doc_id").cast("string"),
        F.lit(" |\n| "), "lang", F.lit(" |  |\n\nend"))
    t = table(spark, d, "documents").select("doc_id", evaluation.tables_column(text).alias("t"))
    return t.select("doc_id", F.posexplode(F.col("t")[0]).alias("r", "row")).select("doc_id", "r", F.posexplode("row").alias("c", "cell"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'missing Markdown table' ELSE CASE WHEN lang = 'en' THEN '' ELSE 'table row missing related cells: EN, ' || doc_id || ';' END || CASE WHEN source = 'src0' THEN '' ELSE 'table column missing related cells: src0, kind;' END END AS failures FROM documents")
def table_expectations(spark: SparkSession, d: str) -> DataFrame:
    """The language and the id stand in one row; the source stands below "kind". Every third text has no table."""
    number = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 3 == 0, "none").otherwise(F.concat(F.lit("|kind|lang|id|\n|---|---|---|\n|"), "source",
            F.lit("|"), "lang", F.lit("|"), number, F.lit("|")))
    rows, columns = F.array(F.array(F.lit("EN"), number)), F.array(F.array(F.lit("src0"), F.lit("kind")))
    found = evaluation.table_failures(text, rows, columns)
    return table(spark, d, "documents").select("doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.array_join(found,
                ";")).otherwise(F.array_join(F.transform(found, lambda x: F.concat(x, F.lit(";"))), "")).alias("failures"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN '' ELSE 'missing expected pattern: the;' END || 'invalid expected pattern ''(''' || ';' || CASE WHEN regexp_matches(text, '[0-9]{3}') THEN '' ELSE 'missing expected pattern: three digits;' END AS failures FROM documents")
def pattern_expectations(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.pattern_failures(F.col("text"), [(r"\bthe\b", False, "the"), ("(", True, None), ("[0-9]{3}", True, "three digits")])
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(found, lambda x: F.concat(x, F.lit(";"))), "").alias("failures"))


@query("""SELECT event_id, CASE WHEN value > 2 THEN 'conversion_seconds ' || printf('%.3f', round(value, 3)) || ' > maximum 2.000;' ELSE '' END || CASE WHEN event_type = 'view' THEN 'max_processing_seconds requires process=true;' WHEN user_id > 100 THEN 'processing_seconds ' || user_id || '.000 > maximum 100.000;' ELSE '' END || CASE WHEN event_id > 5000 THEN 'peak_memory_bytes ' || event_id || ' > maximum 5000;' ELSE '' END AS failures FROM events""")
def budget_expectations(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.when(F.col("event_type") != "view", F.col("user_id").cast("double"))
    found = evaluation.budget_failures(F.round("value", 3), F.when(F.col("value") > 2, F.lit(2.0)).otherwise(F.lit(1e9)), seconds,
        F.lit(100.0), F.col("event_id"), F.lit(5000))
    return table(spark, d, "events").select("event_id", F.array_join(F.transform(found, lambda x: F.concat(x, F.lit(";"))), "").alias("failures"))


@query(f"""WITH {_PAGES}, m AS (SELECT manifest, count(*) FILTER (source = 'ocr') AS ocr, count(*) FILTER (source = 'embedded') AS emb, count(*) FILTER (k % 7 = 0) AS cor FROM p GROUP BY 1) SELECT manifest, CASE WHEN emb <> 40 THEN 'page source embedded count ' || emb || ' != expected 40;' ELSE '' END || CASE WHEN ocr <> 20 THEN 'page source ocr count ' || ocr || ' != expected 20;' ELSE '' END || CASE WHEN ocr < 15 THEN 'ocr_pages ' || ocr || ' < minimum 15;' ELSE '' END || CASE WHEN cor < 8 THEN 'corrected_pages ' || cor || ' < minimum 8;' ELSE '' END AS failures FROM m""")
def page_expectations(spark: SparkSession, d: str) -> DataFrame:
    m = evaluation.page_metrics(_pages(spark, d), ["manifest"])
    found = evaluation.page_failures(F.col("source_counts"), F.create_map(F.lit("ocr"), F.lit(20), F.lit("embedded"), F.lit(40)),
        F.col("ocr_pages"), F.lit(15), F.col("corrected_pages"), F.lit(8))
    return m.select("manifest", F.array_join(F.transform(found, lambda x: F.concat(x, F.lit(";"))), "").alias("failures"))


@query(f"""WITH {_RECORDS}, a AS (SELECT file, sum(k % 4) AS n FROM r GROUP BY 1) SELECT file, CASE WHEN file % 2 = 0 THEN 'page summary attempts ' || n + 1 || ' != expected ' || n ELSE '' END AS failures FROM a""")
def summary_expectations(spark: SparkSession, d: str) -> DataFrame:
    """The summary a manifest holds against one computed from its pages; every other one has a wrong number of attempts."""
    written = manifests.page_manifest(_page_records(spark, d), ["file"])
    read = written.select("file", manifests.read_page_manifest(F.col("json"))["manifest"].alias("m"))
    stored = F.when(F.col("file") % 2 == 0, F.col("m.summary").withField("attempts", F.col("m.summary.attempts") + 1)).otherwise(F.col("m.summary"))
    metrics = evaluation.page_metrics(manifests.pages_of(written, by=["file"]), ["file"])
    names = [c for c in metrics.columns if c != "file"]
    both = read.select("file", stored.alias("s")).join(metrics.select("file", F.struct(*names).alias("x")), "file")
    return both.select("file", F.array_join(evaluation.summary_failures(F.col("s"), F.col("x")), ";").alias("failures"))


@query("SELECT count(*) AS case_count, count(*) FILTER (quality = 1) AS passed_count, count(*) FILTER (quality = 0) AS failed_count, round(count(*) FILTER (quality = 1) / count(*), 6) AS pass_rate, sum(strlen(text))::bigint AS total_input_bytes, sum(n_chars)::bigint AS total_output_chars, sum(doc_id % 5)::bigint AS total_page_attempts, sum(toxic)::bigint AS total_failed_pages, max(n_chars) AS max_peak_memory_bytes, max(CASE WHEN quality = 1 THEN doc_id END)::double AS max_page_duration_ms, round(avg(CASE WHEN toxic = 0 THEN quality END), 6)::double AS average_search_recall, sum(toxic * 2)::bigint AS failure_count, sum(toxic)::bigint AS failure_case_count FROM documents JOIN labels USING (doc_id)")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    two = F.when(F.col("toxic") == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    zero = F.lit(0)
    cases = j.select((F.col("quality") == 1).alias("passed"), F.octet_length("text").alias("input_bytes"),
        F.col("n_chars").alias("output_chars"), (F.col("doc_id") % 5).alias("page_attempts"),
        F.col("toxic").alias("failed_pages"), zero.alias("ocr_pages"), zero.alias("corrected_pages"),
        F.col("n_chars").alias("peak_memory_bytes"),
        F.when(F.col("quality") == 1, F.col("doc_id").cast("double")).alias("max_page_duration_ms"),
        F.when(F.col("toxic") == 0, F.col("quality").cast("double")).alias("search_recall"), zero.alias("phrases"),
        zero.alias("hits"), two.alias("failures"))
    return evaluation.corpus_summary(cases).withColumns({c: F.round(c, 6) for c in ("pass_rate",
                "average_search_recall")}).drop("total_ocr_pages", "total_corrected_pages", "total_search_phrases",
        "total_search_hits")


@query("SELECT event_type, count(*) AS run_count, round(avg(value), 6) AS average_chars_per_second, round(max(value), 6) AS fastest_chars_per_second, sum(event_id)::bigint AS total_input_chars, CASE WHEN event_type = 'view' THEN 'real-provider' ELSE 'mock-smoke' END AS evidence_tier FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def benchmark_summaries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    out = []
    for kind in ("view", "click"):
        runs_ = e.where(F.col("event_type") == kind).select(F.lit("mock" if kind == "click" else "other").alias("provider"),
            F.col("event_id").alias("input_chars"), F.lit(1).alias("chunks"), F.lit(1.0).alias("total_seconds"),
            F.col("value").alias("chars_per_second"))
        one = evaluation.benchmark_summary(runs_)
        out.append(one.select(F.lit(kind).alias("event_type"), "run_count",
                *(F.round(c, 6).alias(c) for c in ("average_chars_per_second", "fastest_chars_per_second")), "total_input_chars",
                "evidence_tier"))
    return out[0].unionByName(out[1])


@query("""SELECT item_id, string_agg(i || '. ' || substr(repeat('A rough note about a library: cataloguing, classification, chunking and cleaning of scanned pages. ', 4), 1, 250), chr(10) || chr(10) ORDER BY i) AS text FROM benchmark, range(0, 3) t(i) GROUP BY item_id""")
def synthetic_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", evaluation.synthetic_text(3, 250).alias("text"))


@query(r"""WITH c AS (SELECT doc_id, 'case ' || doc_id AS name, 'note ' || doc_id || ' on  ' || source || CASE WHEN doc_id % 2 = 0 THEN ' by a doctor' ELSE '' END AS input FROM documents),
o AS (SELECT *, regexp_replace(input, '\s+', ' ', 'g') AS out FROM c) SELECT name, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS passed, length(out) AS output_chars, CASE WHEN doc_id % 2 = 0 THEN '610' ELSE '000' END AS code, CASE WHEN doc_id % 3 = 0 THEN 'missing expected text: NOWHERE;' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'classification 000 does not match 61;' END AS failures FROM o""")
def eval_suite(spark: SparkSession, d: str) -> DataFrame:
    """A case a document through the whole pipeline: chunk, clean, assemble, classify, compare with what is expected."""
    strings = F.array().cast("array<string>")
    number = F.col("doc_id").cast("string")
    cases = table(spark, d, "documents").select(
        F.concat(F.lit("case "), number).alias("name"),
            F.concat(F.lit("note "), number, F.lit(" on  "), "source",
                F.when(F.col("doc_id") % 2 == 0, " by a doctor").otherwise("")).alias("input_text"), strings.alias("tags"),
            F.array(F.when(F.col("doc_id") % 3 == 0, "NOWHERE").otherwise("NOTE")).alias("expected_contains"),
            F.array(F.lit("zzz")).alias("forbidden_contains"),
        F.lit("61").alias("expected_classification_prefix"), F.lit(1).alias("min_output_chars"),
            F.lit(0.5).alias("min_output_char_ratio"), F.lit(1.5).alias("max_output_char_ratio"),
            strings.alias("allowed_warnings"),
    )
    out = evaluation.run_suite(cases)
    return out.select("name", "passed", "output_chars", "code", F.array_join(F.transform("failures", lambda x: F.concat(x, F.lit(";"))), "").alias("failures"))


@query("SELECT 'documents' AS name, true AS ok, count(*) AS n_rows, count(*) AS found_rows FROM documents UNION ALL SELECT 'labels', true, count(*), count(*) FROM labels UNION ALL SELECT 'events', true, count(*), count(*) FROM events")
def backup_verified(spark: SparkSession, d: str) -> DataFrame:
    """Three tables backed up and verified from what was written."""
    path = f"{shared_dir(spark)}/backups/{uuid.uuid4().hex}"
    backup.backup({n: table(spark, d, n) for n in ("documents", "labels", "events")}, path)
    return backup.verify(spark, path)


@query(f"WITH {_RECORDS} SELECT file, page_number::int AS page_number FROM r WHERE file % 3 = 0 AND status = 'succeeded' AND source IN ('embedded', 'ocr')")
def pages_reusable(spark: SparkSession, d: str) -> DataFrame:
    """Stored pages that an extraction of the same file under the same configuration takes over; every third file is unchanged."""
    stored = _page_records(spark, d).withColumn("status", rollups.page_status(F.col("error"), F.col("source")))
    stored = stored.select("file", F.col("page_number").cast("int").alias("page_number"), "status", "source", F.col("source_sha256").alias("sha256"), F.col("extraction_config").alias("config"), "page_count")
    files = stored.select("file", "sha256", "config", "page_count").distinct()
    changed = F.when(F.col("file") % 3 == 0, F.col("sha256")).otherwise("other")
    wanted = files.where("file % 3 < 2").withColumn("sha256", changed)
    wanted = wanted.unionByName(files.where("file % 3 = 2").withColumn("config", F.lit("{changed}")))
    return rollups.reusable_pages(stored, wanted).select("file", "page_number")


@query("SELECT user_id, round(avg(k - 20) FILTER (k >= 20 AND event_type <> 'click'), 6) AS confidence FROM (SELECT user_id, event_type, (props->>'$.k')::int AS k FROM events) GROUP BY 1")
def ocr_confidences(spark: SparkSession, d: str) -> DataFrame:
    """The mean over words that are not blank and have a confidence; a click is a blank word."""
    conf = F.get_json_object("props", "$.k").cast("double") - 20
    words = table(spark, d, "events").select("user_id", conf.alias("conf"), F.when(F.col("event_type") == "click", "  ").otherwise("w").alias("text"))
    return rollups.ocr_confidence(words, ["user_id"]).withColumn("confidence", F.round("confidence", 6))


@query("WITH held AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0) SELECT doc_id, CASE WHEN sha256(text) IN (SELECT h FROM held) THEN 'cached ' || sha256(text) ELSE text END AS text FROM documents")
def extraction_cached(spark: SparkSession, d: str) -> DataFrame:
    """Contents extracted before under the same configuration come from the cache, another configuration's do not, the rest is extracted."""
    docs = table(spark, d, "documents")
    files = docs.select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"), F.encode("text", "UTF-8").alias("content"))
    mine, other = readers.config_signature({"mode": "a"}), readers.config_signature({"mode": "b"})
    sha = docs.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_sha256")).distinct()
    kept = sha.where("doc_id % 2 = 0").select("content_sha256").distinct().select("content_sha256", F.lit(mine).alias("config_signature"), F.concat(F.lit("cached "), "content_sha256").alias("text"))
    cache = kept.unionByName(sha.select("content_sha256").distinct().select("content_sha256", F.lit(other).alias("config_signature"), F.lit("wrong").alias("text")))
    got, _ = readers.extract_cached(files, cache, mine)
    return got.select("doc_id", "text")
