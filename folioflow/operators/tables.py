"""Table operators: upserts with guards, deletes with everything that hangs on a document, queue, audit, statistics.

Each takes tables and gives the tables after it; the caller writes them as a new version. Every upsert is one shuffle on the key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("queued", "retry", "running")
FINAL = ("succeeded", "canceled")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of equal keys; columns ``keep`` stay as first written. Of repeated new keys the last by ``order`` counts."""
    tagged = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    by = [F.desc("_new"), *([F.desc(order)] if order else [])]
    last = Window.partitionBy(*key).orderBy(*by)
    first = Window.partitionBy(*key).orderBy("_new", *([order] if order else [])).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = {c: F.first(c).over(first) for c in keep}
    return tagged.withColumns({**{f"_{c}": v for c, v in kept.items()},
            "_n": F.row_number().over(last)}).where("_n = 1").select(*(F.col(f"_{c}").alias(c) if c in keep else F.col(c) for c in old.columns))


def guarded_upsert(old: DataFrame, new: DataFrame, key: list[str], frozen: Column) -> DataFrame:
    """An upsert that leaves rows alone where ``frozen`` holds of the old row (canceled runs, terminal states)."""
    locked = old.where(frozen).select(*key)
    return upsert(old, new.join(locked, key, "left_anti"), key)


def replace_by(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` without the rows of keys that ``new`` has, and ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def lookup(df: DataFrame, key: dict, required: bool = False) -> DataFrame:
    """The rows of a key; the filter reaches the scan. A required key that has none is a KeyError."""
    for column, value in key.items():
        df = df.where(F.col(column) == F.lit(value))
    if required and df.isEmpty():
        raise KeyError(", ".join(map(str, key.values())))
    return df


def are_canceled(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run_id, canceled) of the wanted runs."""
    gone = runs.where("status = 'canceled'").select("run_id", F.lit(True).alias("_c")).distinct()
    return wanted.select("run_id").join(gone, "run_id", "left").select("run_id", F.coalesce("_c", F.lit(False)).alias("canceled"))


def update_run_status(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """(run_id, status, stage, error) applied unless the run is canceled or succeeded already."""
    c = changes.dropDuplicates(["run_id"]).select("run_id", *(F.col(x).alias(f"_{x}") for x in ("status", "stage", "error")))
    free = ~F.col("status").isin(*FINAL) & F.col("_status").isNotNull()
    return runs.join(c, "run_id", "left").select(*(F.when(free, F.col(f"_{x}")).otherwise(F.col(x)).alias(x) if x in ("status",
                "stage", "error") else F.col(x) for x in runs.columns))


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without what belongs to the documents ``gone``, and the chunk cache without rows any of their chunks share."""
    ids = gone.select("document_id").distinct()
    out = {name: df.join(ids, "document_id", "left_anti") if "document_id" in df.columns else df for name, df in tables.items()}
    if "cache" in tables and "chunks" in tables:
        shas = tables["chunks"].join(ids, "document_id", "left_semi").select(F.col("sha256").alias("chunk_sha256")).distinct()
        out["cache"] = tables["cache"].join(shas, "chunk_sha256", "left_anti")
    return out


def publish(outputs: DataFrame, classifications: DataFrame, runs: DataFrame, documents: DataFrame, new_outputs: DataFrame,
    new_classifications: DataFrame) -> dict[str, DataFrame]:
    """The tables after successful runs: only running runs publish; output, classification, document and run change together."""
    live = new_outputs.join(runs.where("status = 'running'").select("run_id"), "run_id", "left_semi")
    done, docs = live.select("run_id").distinct(), live.select("document_id").distinct()
    mark = lambda df, key, ids, value: df.join(ids.withColumn("_hit", F.lit(True)), key, "left").withColumn("status",
        F.when(F.col("_hit"), value).otherwise(F.col("status"))).drop("_hit")
    return {"outputs": upsert(outputs, live.select(*outputs.columns), ["document_id", "run_id"]),
        "classifications": upsert(classifications, new_classifications.join(docs, "document_id",
                "left_semi").select(*classifications.columns), ["document_id"]), "runs": mark(runs, "run_id", done, "succeeded"),
        "documents": mark(documents, "document_id", docs, "ready")}


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be between 1 and {most}, offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def list_documents(documents: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return page(documents, [F.desc("created_at"), "document_id"], limit, offset)


def list_events(events: DataFrame, run_id, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(events.where(F.col("run_id") == F.lit(run_id)), ["sequence"], limit, offset).withColumn("line", F.concat_ws(": ", "stage", "message"))


def content_slice(df: DataFrame, offset: int, limit: int, text: str = "text") -> DataFrame:
    """(.., content, total_chars, truncated): a window of characters of each text."""
    n = F.length(text)
    return df.withColumns({"content": F.substring(text, offset + 1, limit), "total_chars": n, "truncated": n > offset + limit})


def claimable(queue: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Queue entries that a worker may take: due, not leased or with an expired lease, of runs still open."""
    open_runs = runs.where(~F.col("status").isin(*FINAL)).select("run_id")
    due = F.col("status").isin(*ACTIVE) & (F.col("available_at") <= now) & (F.col("locked_at").isNull() | (F.col("locked_at") <= now))
    return queue.where(due).join(open_runs, "run_id", "left_semi")


def claim(queue: DataFrame, runs: DataFrame, worker: str, now: Column, lease_seconds: int) -> DataFrame:
    """The one entry to work on next, as it is after the claim: running, one attempt more, leased."""
    lease = now + F.make_interval(secs=F.lit(lease_seconds))
    return claimable(queue, runs, now).orderBy("updated_at",
        "run_id").limit(1).withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1,
            "locked_by": F.lit(worker), "locked_at": lease, "updated_at": now})


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(300.0), F.greatest(F.lit(1.0), F.pow(F.lit(2.0), attempts - 1)))


def fail(queue: DataFrame, failed: DataFrame, most_attempts: int, now: Column) -> DataFrame:
    """(run_id, worker, error): entries of that worker become failed, or wait for the next try."""
    f = failed.dropDuplicates(["run_id"]).select("run_id", F.col("worker").alias("_w"), F.col("error").alias("_e"))
    mine = (F.col("status") == "running") & F.col("_e").isNotNull() & (F.col("_w").isNull() | (F.col("_w") == F.col("locked_by")))
    over = F.col("attempts") >= most_attempts
    wait = now + F.make_interval(secs=backoff_seconds(F.col("attempts")))
    new = {"status": F.when(over, "failed").otherwise("retry"),
        "available_at": F.when(over, F.col("available_at")).otherwise(wait), "last_error": F.col("_e"),
        "locked_by": F.lit(None).cast("string"), "locked_at": F.lit(None).cast("timestamp_ntz"), "updated_at": now}
    joined = queue.join(f, "run_id", "left")
    return joined.select(*(F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in queue.columns))


def complete(queue: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    d = done.dropDuplicates(["run_id"]).select("run_id", F.col("worker").alias("_w"), F.lit(True).alias("_d"))
    mine = F.coalesce(F.col("_d"), F.lit(False)) & (F.col("status") == "running") & (F.col("_w").isNull() | (F.col("_w") == F.col("locked_by")))
    return queue.join(d, "run_id", "left").select(*(F.when(mine,
                F.lit("succeeded") if c == "status" else now).otherwise(F.col(c)).alias(c) if c in ("status",
                "updated_at") else F.col(c) for c in queue.columns))


def heartbeat(queue: DataFrame, beats: DataFrame, now: Column, lease_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(the queue after, (run_id, worker, extended)) of beats (run_id, worker): the lease of a running entry goes on for its own worker only."""
    if lease_seconds < 1:
        raise ValueError("lease_seconds must be at least 1")
    b = beats.select("run_id", F.col("worker").alias("_w")).distinct()
    owned = queue.where("status = 'running' AND locked_by IS NOT NULL").join(b,
        "run_id").where(F.col("_w") == F.col("locked_by")).select("run_id", F.lit(True).alias("_beat"))
    lease, beat = now + F.make_interval(secs=F.lit(lease_seconds)), F.coalesce(F.col("_beat"), F.lit(False))
    after = queue.join(owned, "run_id", "left").select(*(F.when(beat,
                {"locked_at": lease, "updated_at": now}[c]).otherwise(F.col(c)).alias(c) if c in ("locked_at",
                "updated_at") else F.col(c) for c in queue.columns))
    held = queue.select("run_id", F.col("status").alias("_s"), F.col("locked_by").alias("_l"))
    told = b.join(held, "run_id", "left").select("run_id", F.col("_w").alias("worker"),
        F.coalesce((F.col("_s") == "running") & (F.col("_l") == F.col("_w")), F.lit(False)).alias("extended"))
    return after, told


def cancel(queue: DataFrame, canceled: DataFrame, now: Column) -> DataFrame:
    """Entries of (run_id, error) are canceled, whatever their state."""
    c = canceled.groupBy("run_id").agg(F.max("error").alias("_e")).withColumn("_c", F.lit(True))
    new = {"status": F.lit("canceled"), "locked_at": F.lit(None).cast("timestamp_ntz"), "locked_by": F.lit(None).cast("string"),
        "updated_at": now, "last_error": F.col("_e")}
    return queue.join(c, "run_id", "left").select(*(F.when(F.col("_c"), new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in queue.columns))


def update_progress(runs: DataFrame, progress: DataFrame, now: Column) -> DataFrame:
    """(run_id, status, stage, completed_chunks, failed_chunks) applied unless the run is canceled; of repeated runs the one furthest on."""
    names = ("status", "stage", "completed_chunks", "failed_chunks")
    p = progress.groupBy("run_id").agg(F.max_by(F.struct(*names), F.struct("completed_chunks", "failed_chunks", "status", "stage")).alias("_p"))
    free = F.col("_p").isNotNull() & (F.col("status") != "canceled")
    new = {**{n: F.col(f"_p.{n}") for n in names}, "updated_at": now}
    return runs.join(p, "run_id", "left").select(*(F.when(free, new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in runs.columns))


def start_runs(documents: DataFrame, wanted: DataFrame, attempt: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, events, unknown): a queued run and its first event for every wanted document there is; ids that are no document.

    A run's id derives from the document and ``attempt``, so starting again after a lost job makes the same run.
    """
    known, ids = documents.select("document_id").distinct(), wanted.select("document_id").distinct()
    run = F.concat(F.lit("run_"), F.substring(F.sha2(F.concat_ws(":", F.col("document_id").cast("string"), F.lit(attempt)), 256), 1, 16))
    zero, none = F.lit(0), F.lit(None).cast("string")
    runs = ids.join(known, "document_id").select(run.alias("run_id"), "document_id", F.lit("queued").alias("status"),
        F.lit("ingest").alias("stage"), zero.alias("total_chunks"), zero.alias("completed_chunks"),
        zero.alias("failed_chunks"), now.alias("created_at"), now.alias("updated_at"), none.alias("error"))
    events = runs.select("run_id", F.lit("ingest").alias("stage"), F.lit("queued processing run").alias("message"), now.alias("created_at"))
    return runs, events, ids.join(known, "document_id", "left_anti")


def emit(events: DataFrame, new: DataFrame) -> DataFrame:
    """``events`` with new ones appended; their sequence goes on after the last one, by run and message."""
    last = events.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("_last"))
    order = Window.orderBy("created_at", "run_id", "stage", "message")  # one append's events
    more = new.crossJoin(F.broadcast(last)).withColumn("sequence", F.col("_last") + F.row_number().over(order)).drop("_last")
    return events.unionByName(more.select(*events.columns))


def remapped(rows: DataFrame, mapping: DataFrame, column: str = "chunk_id") -> DataFrame:
    """``rows`` with surrogate ids replaced by (old_id, document_id, new_id) of their document; rows without one are left out."""
    m = mapping.select(F.col("old_id").alias(column), "document_id", "new_id").distinct()
    return rows.join(m,
        [column, "document_id"] if "document_id" in rows.columns else column).select(*(F.col("new_id").alias(c) if c ==
            column else F.col(c) for c in rows.columns))


def show_document(documents: DataFrame, outputs: DataFrame, classifications: DataFrame, document_id) -> DataFrame:
    """One document with the length of its newest output and its classification, if it has them."""
    one = documents.where(F.col("document_id") == F.lit(document_id))
    newest = outputs.where(F.col("document_id") == F.lit(document_id)).groupBy("document_id").agg(F.max_by(F.length("text"),
            F.struct("created_at", "run_id")).alias("output_chars"))
    return one.join(newest, "document_id", "left").join(classifications.where(F.col("document_id") == F.lit(document_id)), "document_id", "left")


def work_once(queue: DataFrame, runs: DataFrame, worker: str, now: Column, lease_seconds: int,
    process: Callable[[DataFrame], DataFrame], most_attempts: int = 3, batch: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(the queue after, metrics): claim the oldest entries, process all of them as one job, and complete, fail or cancel each.

    ``process`` maps claimed entries (run_id, ..) to (run_id, outcome, error), outcome being succeeded, failed or canceled; what it leaves out has failed. Metrics: claims, wait_ms, and runs by
    outcome. ``batch`` is how many a worker takes at a time.
    """
    lease = now + F.make_interval(secs=F.lit(lease_seconds))
    taken = claimable(queue, runs, now).orderBy("updated_at", "run_id").limit(batch)
    mine = taken.select("run_id", (F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("available_at").cast("timestamp"))).alias("_wait"))
    change = {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "locked_by": F.lit(worker), "locked_at": lease, "updated_at": now}
    claimed = queue.join(mine.select("run_id", F.lit(True).alias("_m")), "run_id",
        "left").select(*(F.when(F.col("_m"),
                change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in queue.columns))
    work = claimed.join(mine.select("run_id"), "run_id", "left_semi")
    outcome = work.select("run_id").join(process(work).dropDuplicates(["run_id"]), "run_id", "left").select("run_id",
        F.coalesce("outcome", F.lit("failed")).alias("outcome"),
        F.coalesce("error", F.when(F.col("outcome").isNull(), "no outcome")).alias("error"), F.lit(worker).alias("worker"))
    after = complete(claimed, outcome.where("outcome = 'succeeded'"), now)
    after = fail(after, outcome.where("outcome = 'failed'").withColumn("error", F.coalesce("error", F.lit("failed"))), most_attempts, now)
    after = cancel(after, outcome.where("outcome = 'canceled'"), now)
    metrics = outcome.join(mine, "run_id").agg(F.count(F.lit(1)).alias("queue_claims"),
        F.coalesce(F.sum(F.greatest(F.col("_wait"), F.lit(0))), F.lit(0)).alias("queue_wait_ms"),
        *(F.count_if(F.col("outcome") == s).alias(f"runs_{s}") for s in ("succeeded", "failed", "canceled")))
    return after, metrics


def enqueue(queue: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Runs of ``new`` are queued: unknown ones as new entries, failed and succeeded ones again with their attempts kept, others as they are."""
    n = new.select("run_id", F.lit(True).alias("_n")).distinct()
    again = F.coalesce(F.col("_n"), F.lit(False)) & (F.col("status").isNull() | F.col("status").isin("failed", "succeeded"))
    none = {"locked_by": F.lit(None).cast("string"), "locked_at": F.lit(None).cast("timestamp_ntz"), "last_error": F.lit(None).cast("string")}
    fresh = {"status": F.lit("queued"), "attempts": F.coalesce("attempts", F.lit(0)), "available_at": now, "updated_at": now, **none}
    return queue.join(n, "run_id", "full").select(*(F.when(again, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in queue.columns))


def retain_audit(events: DataFrame, new: DataFrame, now: Column, days: int) -> DataFrame:
    return events.where(F.col("created_at") >= now - F.make_interval(days=F.lit(days))).unionByName(new)


def statistics(tables: dict[str, DataFrame], text_columns: dict[str, str], size_column: tuple[str, str] | None = None) -> DataFrame:
    """(name, value): rows of every table, bytes of text, and the sum of a size column; one scan a table."""
    out = []
    for name, df in tables.items():
        aggs = [F.count(F.lit(1)).cast("bigint").alias("rows")]
        if name in text_columns:
            aggs.append(F.coalesce(F.sum(F.octet_length(text_columns[name])), F.lit(0)).cast("bigint").alias("text_bytes"))
        if size_column and size_column[0] == name:
            aggs.append(F.coalesce(F.sum(size_column[1]), F.lit(0)).cast("bigint").alias("bytes"))
        one = df.agg(*aggs)
        out.append(one.select(F.inline(F.array(*(F.struct(F.lit(f"{name}_{c}").alias("name"), F.col(c).alias("value")) for c in one.columns)))))
    return reduce(DataFrame.unionByName, out)


def verify(tables: dict[str, DataFrame], references: list[tuple[str, str, str]]) -> DataFrame:
    """(child, parent, orphans) of every (child, parent, key)."""
    return reduce(DataFrame.unionByName, [tables[c].where(F.col(k).isNotNull()).join(tables[p].select(k), k,
                "left_anti").agg(F.lit(c).alias("child"), F.lit(p).alias("parent"), F.count(F.lit(1)).alias("orphans")) for c, p,
            k in references])


def backfill(blobs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Raw texts whose document is not indexed yet: (document_id, text)."""
    raw = blobs.where(F.col("key").startswith("raw:doc_")).select(F.substring("key", 5, 1000).alias("document_id"), "text")
    return raw.join(indexed.select("document_id"), "document_id", "left_anti")


def collect_sources(documents: DataFrame, outputs: DataFrame, classifications: DataFrame, prefix: str | None = None,
    tag: str | None = None, series: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with output and classification that pass the filters, documents without either)."""
    whole = documents.join(outputs, "document_id").join(classifications, "document_id")
    if prefix:
        whole = whole.where(F.col("code").startswith(prefix))
    if tag:
        whole = whole.where(F.exists("tags", lambda t: F.lower(t) == tag.strip().lower()))
    if series:
        wanted = series.strip().lower()
        whole = whole.where((F.lower("series_key") == wanted) | F.coalesce(F.lower("series_key").contains(wanted),
                F.lit(False)) | F.coalesce(F.lower("series_title").contains(wanted), F.lit(False)))
    both = outputs.select("document_id").intersect(classifications.select("document_id"))
    return whole, documents.join(both, "document_id", "left_anti")
