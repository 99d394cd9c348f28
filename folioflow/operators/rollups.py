"""Roll-ups: page manifests, evaluations, imports, conversions, metrics. Each is one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def page_summary(pages: DataFrame, by: list[str]) -> DataFrame:
    """Page records (status, source, confidence, corrected, attempts, duration_ms, warnings) rolled up by manifest."""
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("unknown"))
    n = lambda value: F.count_if(status == value)
    return pages.groupBy(*by).agg(
        F.when(n("failed") > 0, "failed").when(n("pending") > 0, "pending").otherwise("succeeded").alias("status"),
            F.count(F.lit(1)).alias("pages"), n("succeeded").alias("succeeded"), n("failed").alias("failed"),
            n("pending").alias("pending"),
        F.coalesce(F.sum(F.when(F.col("attempts") >= 0, F.col("attempts"))), F.lit(0)).cast("bigint").alias("attempts"),
            F.count_if(F.col("source") == "ocr").alias("ocr_pages"), F.count_if(F.col("corrected")).alias("corrected_pages"),
            F.avg("confidence").alias("average_confidence"), F.max("duration_ms").alias("max_duration_ms"),
    )


def value_counts(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """(by, value, count) of non-empty values."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def warning_counts(df: DataFrame, column: str = "warnings", by: list[str] = ()) -> DataFrame:
    return value_counts(df.select(*by, F.explode(column).alias("value")), "value", by)


def page_status(error: Column, source: Column) -> Column:
    return F.when(error.isNotNull(), "failed").when(source == "pending", "pending").otherwise("succeeded")


def page_warnings(confidence: Column, rotation: Column, threshold: float) -> Column:
    return F.coalesce(F.array_compact(F.array(F.when(rotation != 0, "page-rotation-corrected"),
                F.when(confidence.isNull(), "missing-ocr-confidence"), F.when(confidence < threshold, "low-ocr-confidence"))),
        F.array().cast("array<string>"))


def best_rotation(tries: DataFrame, by: list[str]) -> DataFrame:
    """Of the OCR tries of a page (rotation, confidence, text) the one of most confidence; null is least, the smaller rotation wins ties."""
    return tries.groupBy(*by).agg(F.max_by(F.struct("rotation", "confidence", "text"),
            F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("rotation"))).alias("best")).select(*by, "best.*")


def ocr_confidence(words: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the confidences of words that are not blank and not negative; null if there are none."""
    return words.groupBy(*by).agg(F.avg(F.when((F.col("conf") >= 0) & (F.trim("text") != ""), F.col("conf"))).alias("confidence"))


def needs_correction(mode: str, confidence: Column, threshold: float) -> Column:
    if mode not in ("never", "low-confidence", "always"):
        raise ValueError(f"unknown mode: {mode}")
    return F.lit(True) if mode == "always" else F.lit(False) if mode == "never" else F.coalesce(confidence < threshold, F.lit(False))


def reusable_pages(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored page records that fit (sha256, config, page_count) and succeeded from text or OCR."""
    return stored.join(wanted, ["sha256", "config", "page_count"],
        "left_semi").where((F.col("status") == "succeeded") & F.col("source").isin("embedded", "ocr"))


def eval_summary(cases: DataFrame) -> DataFrame:
    """Cases (passed, input_chars, output_chars, chars_per_second, warnings, failures) in one row."""
    passed, n = F.count_if("passed"), F.count(F.lit(1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return cases.agg(n.alias("case_count"), passed.alias("passed_count"), (n - passed).alias("failed_count"),
        ratio(passed, n).alias("pass_rate"), total("input_chars").alias("total_input_chars"),
        total("output_chars").alias("total_output_chars"),
        F.coalesce(F.avg("chars_per_second"), F.lit(0.0)).alias("average_chars_per_second"),
        total(F.size("warnings")).alias("warning_count"), total(F.size("failures")).alias("failure_count"),
        F.count_if(F.size("warnings") > 0).alias("warning_case_count"),
        F.count_if(F.size("failures") > 0).alias("failure_case_count"))


def case_failures(text: Column, contains: Column, forbidden: Column, ratio_: Column, least: Column, most: Column) -> Column:
    """What an evaluation case expects of a text and does not find, as messages."""
    low = F.lower(text)
    missing = F.transform(F.filter(contains, lambda x: ~low.contains(F.lower(x))), lambda x: F.concat(F.lit("missing: "), x))
    found = F.transform(F.filter(forbidden, lambda x: low.contains(F.lower(x))), lambda x: F.concat(F.lit("forbidden: "), x))
    sizes = F.array_compact(F.array(F.when(ratio_ < least, "output ratio too small"), F.when(ratio_ > most, "output ratio too large")))
    return F.concat(missing, found, F.coalesce(sizes, F.array().cast("array<string>")))


def in_order(text: Column, before: Column, after: Column, case_sensitive: Column) -> Column:
    """Does ``before`` stand before ``after``? White space is normalised."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    norm = lambda c: F.when(case_sensitive, flat(c)).otherwise(F.lower(flat(c)))
    first, second = F.position(norm(before), norm(text)), F.position(norm(after), norm(text))
    return (first > 0) & (second > first)


def import_summary(items: DataFrame) -> DataFrame:
    done = lambda *s: F.count_if(F.col("status").isin(*s))
    return items.agg(done("converted", "ingested", "processed", "queued").alias("converted"),
        F.count_if(F.col("document_id").isNotNull()).alias("ingested"), done("processed").alias("processed"),
        done("queued").alias("queued"), done("skipped").alias("skipped"), done("failed").alias("failed"))


def stage_durations(events: DataFrame, by: str, duration: str) -> DataFrame:
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("count"), F.sum(duration).alias("total_ms"), F.max(duration).alias("max_ms"))


def request_metrics(requests: DataFrame) -> DataFrame:
    return requests.groupBy("status_code").agg(F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") >= 500).alias("errors"), F.sum("duration_ms").alias("duration_ms"))


def runs_finished(runs: DataFrame) -> DataFrame:
    """Counters of runs by terminal status; open ones count in none."""
    n = lambda s: F.count_if(F.col("status") == s)
    return runs.agg(n("succeeded").alias("runs_completed_total"), n("failed").alias("runs_failed_total"), n("canceled").alias("runs_canceled_total"))


def queue_claims(claims: DataFrame) -> DataFrame:
    """Claims (available_at, claimed_at) counted, with the milliseconds they waited; a claim ahead of time waited 0."""
    wait = F.floor((F.unix_micros(F.col("claimed_at").cast("timestamp")) - F.unix_micros(F.col("available_at").cast("timestamp"))) / 1000).cast("bigint")
    return claims.agg(F.count(F.lit(1)).alias("queue_claims_total"), F.coalesce(F.sum(F.greatest(wait, F.lit(0))), F.lit(0)).alias("queue_wait_ms_total"))


def snapshot(runs: DataFrame, requests: DataFrame, claims: DataFrame, usage: DataFrame) -> DataFrame:
    """One row of service metrics: counters and guarded ratios (0 where nothing was counted)."""
    r = requests.agg(F.count(F.lit(1)).alias("requests_total"), F.count_if(F.col("status_code") >= 500).alias("errors_total"),
        F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("request_ms"))
    u = usage.agg(F.count(F.lit(1)).alias("llm_requests_total"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("llm_tokens_total"))
    one = runs_finished(runs).crossJoin(r).crossJoin(queue_claims(claims)).crossJoin(u)  # a row each
    ended = F.col("runs_completed_total") + F.col("runs_failed_total")
    return one.withColumns({"average_request_ms": ratio(F.col("request_ms"), F.col("requests_total")),
            "error_rate": ratio(F.col("errors_total"), F.col("requests_total")),
            "run_failure_rate": ratio(F.col("runs_failed_total"), ended),
            "average_queue_wait_ms": ratio(F.col("queue_wait_ms_total"), F.col("queue_claims_total")),
            "average_tokens_per_request": ratio(F.col("llm_tokens_total"), F.col("llm_requests_total"))}).drop("request_ms")


def ocr_page_counts(pages: DataFrame) -> DataFrame:
    """(key, pages, failed, corrected, duration_ms) by source and status."""
    return pages.groupBy(F.concat_ws(":", "source", "status").alias("key")).agg(F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if("corrected").alias("corrected"),
        F.sum("duration_ms").alias("duration_ms"))


def conversion_failures(failures: DataFrame) -> DataFrame:
    """(key, count) by kind of failure and extension."""
    return failures.groupBy(F.concat_ws(":", "failure",
            F.coalesce(F.nullif(F.col("extension"), F.lit("")),
                F.lit("none"))).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def conversion_report(items: DataFrame) -> DataFrame:
    """One row: counts of converted and failed files, and the items by path. The report of one conversion."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return items.agg(n("converted"), n("failed"), F.array_sort(F.collect_list(F.struct("source_path", "output_path", "status", "error"))).alias("items"))


def llm_usage(calls: DataFrame, prompt_rate: float = 0.0, completion_rate: float = 0.0) -> DataFrame:
    cost = F.col("prompt_tokens") * prompt_rate / 1000 + F.col("completion_tokens") * completion_rate / 1000
    return calls.groupBy(F.concat_ws(":", "provider",
            "model").alias("model")).agg(*(F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")),
        F.sum(cost).alias("estimated_cost"))


def prometheus(rows: DataFrame, metric: str, value: str, labels: list[str]) -> DataFrame:
    """One exposition line a row, labels sorted and escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")),
        F.lit('"'), F.lit('\\"'))
    inner = F.concat_ws(",", *(F.concat(F.lit(f'{name}="'), esc(F.col(name)), F.lit('"')) for name in sorted(labels)))
    return rows.select(F.concat(F.lit(metric), F.concat(F.lit("{"), inner, F.lit("}")) if labels else F.lit(""), F.lit(" "),
            F.col(value).cast("string")).alias("line"))
