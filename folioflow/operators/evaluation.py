"""Evaluation of conversions and of the processing pipeline: expectations on texts, tables, pages, budgets; suites as DataFrames; roll-ups."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import process, rollups

TABLES = "array<array<array<string>>>"
CASES = "cases array<struct<name:string,input_text:string,tags:array<string>,expected_contains:array<string>,forbidden_contains:array<string>,expected_classification_prefix:string,min_output_chars:int,min_output_char_ratio:double,max_output_char_ratio:double,allowed_warnings:array<string>>>"
_RULE = re.compile(r":?-{3,}:?")
STRINGS = "array<string>"


def _strings() -> Column:
    return F.array().cast(STRINGS)


def markdown_tables(text: str | None) -> list[list[list[str]]]:
    """The cells of all tables: runs of lines with two or more cells between bars; rules are left out."""
    tables, current = [], []
    for line in (text or "").splitlines():
        cells = [c.strip() for c in line.strip().strip("|").split("|")] if "|" in line else []
        if len(cells) < 2:
            if current:
                tables.append(current)
            current = []
        elif not all(_RULE.fullmatch(c.replace(" ", "")) for c in cells):
            current.append(cells)
    return [*tables, current] if current else tables


def tables_column(text: Column) -> Column:
    """The tables of each text. Texts without a bar are not sent to Python."""

    @F.pandas_udf(TABLES)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(markdown_tables)

    return F.coalesce(run(F.when(F.contains(text, F.lit("|")), text)), F.array().cast(TABLES))


def columns_of(table: Column) -> Column:
    """The table's columns; a short row has no cell in the last ones."""
    width = F.coalesce(F.array_max(F.transform(table, lambda row: F.size(row))), F.lit(0))
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.filter(F.transform(table, lambda row: F.get(row, i)), lambda c: c.isNotNull()))


def normalized(c: Column, case_sensitive: Column) -> Column:
    flat = X.squeeze(c)
    return F.when(case_sensitive, flat).otherwise(F.lower(flat))


def related(tables: Column, cells: Column, relation: str, case_sensitive: Column | None = None) -> Column:
    """Does one row (or one column) of one table hold all the cells, as parts of its cells?"""
    if relation not in ("row", "column"):
        raise ValueError(f"unknown relation: {relation}")
    exact = F.lit(False) if case_sensitive is None else case_sensitive
    groups = F.flatten(tables if relation == "row" else F.transform(tables, columns_of))
    wanted = F.transform(cells, lambda c: normalized(c, exact))
    return F.exists(groups, lambda g: F.forall(wanted, lambda w: F.exists(g, lambda c: F.contains(normalized(c, exact), w))))


def table_failures(text: Column, rows: Column, columns: Column) -> Column:
    """Messages about expected cells (arrays of arrays) that stand in no row or column together."""
    tables = tables_column(text)
    told = lambda kind, cells: F.concat(F.lit(f"table {kind} missing related cells: "), F.array_join(cells, ", "))

    def missing(t: Column, wanted: Column, kind: str) -> Column:
        return F.transform(F.filter(wanted, lambda cells: ~related(t, cells, kind)), lambda cells: told(kind, cells))

    asked = F.size(rows) + F.size(columns) > 0
    return X.let(tables, lambda t: F.when(~asked, _strings()).when(F.size(t) == 0,
            F.array(F.lit("missing Markdown table"))).otherwise(F.concat(missing(t, rows, "row"), missing(t, columns, "column"))))


def pattern_failures(text: Column, patterns: list[tuple[str, bool, str | None]]) -> Column:
    """Messages about (pattern, case_sensitive, description) that are not found; a pattern that doesn't compile is a failure, not an error. Patterns are Java's."""
    found = []
    jvm = SparkSession.active().sparkContext._jvm
    for pattern, exact, description in patterns:
        try:
            jvm.java.util.regex.Pattern.compile(pattern)
        except Exception:  # whatever the JVM says of it
            found.append(F.lit(f"invalid expected pattern {pattern!r}"))
            continue
        found.append(F.when(~F.coalesce(text.rlike(pattern if exact else f"(?iu){pattern}"), F.lit(False)),
                F.lit(f"missing expected pattern: {description or pattern}")))
    return F.array_compact(F.array(*found)) if found else _strings()


def over_budget(name: str, value: Column, most: Column, decimals: int = 3) -> Column:
    """A message where a measure is over its maximum; nothing without a maximum."""
    show = (lambda c: F.format_string(f"%.{decimals}f", c.cast("double"))) if decimals else (lambda c: c.cast("bigint").cast("string"))
    return F.when(value > most, F.concat(F.lit(f"{name} "), show(value), F.lit(" > maximum "), show(most)))


def budget_failures(conversion: Column, most_conversion: Column, processing: Column, most_processing: Column, memory: Column, most_memory: Column) -> Column:
    unprocessed = F.when(most_processing.isNotNull() & processing.isNull(), "max_processing_seconds requires process=true")
    return F.array_compact(F.array(over_budget("conversion_seconds", conversion, most_conversion), unprocessed,
            over_budget("processing_seconds", processing, most_processing),
            over_budget("peak_memory_bytes", memory, most_memory, 0)))


def page_metrics(pages: DataFrame, by: list[str]) -> DataFrame:
    """Page records of an extraction rolled up: maps of counts by status, source and warning, attempts, OCR and corrected pages, mean confidence, longest page."""
    named = lambda c: F.coalesce(X.blank_to_null(F.col(c)), F.lit("unknown"))
    base = pages.withColumns({"status": named("status"), "source": named("source")})
    duration = F.when(F.col("duration_ms") >= 0, F.col("duration_ms").cast("double"))
    # a row for the page and one for each value that is counted, so that the pages are read once
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    told = F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: w != "")
    each = F.concat(F.array(one("page", F.lit("")), one("status", F.col("status")), one("source", F.col("source"))), F.transform(told, lambda w: one("warning", w)))
    confidence = F.col("confidence").cast("double")
    counted = base.select(*by, "attempts", duration.alias("_d"), "source", "corrected", confidence.alias("_c"), F.inline(each)).groupBy(*by, "kind",
        "value").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("attempts") >= 0, F.col("attempts"))), F.lit(0)).cast("bigint").alias("attempts"),
            F.max("_d").alias("max_duration_ms"), F.count_if(F.col("source") == "ocr").alias("ocr_pages"),
            F.count_if("corrected").alias("corrected_pages"), F.avg("_c").alias("average_ocr_confidence"),
    )
    names = ("attempts", "max_duration_ms", "ocr_pages", "corrected_pages", "average_ocr_confidence")
    page = lambda c: F.max(F.when(F.col("kind") == "page", F.col(c))).alias(c)
    of = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("value", "n"))))).alias(f"{kind}_counts")
    return counted.groupBy(*by).agg(*map(page, names), *map(of, ("status", "source", "warning")))


def _told(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def page_failures(sources: Column, expected: Column, ocr: Column, least_ocr: Column, corrected: Column, least_corrected: Column) -> Column:
    """Messages about expected counts by source (a map) and least OCR and corrected pages."""
    have = lambda k: F.coalesce(F.try_element_at(sources, k), F.lit(0).cast("bigint"))
    off = F.filter(F.array_sort(F.map_entries(expected)), lambda e: have(e["key"]) != e["value"])
    wrong = F.transform(off, lambda e: F.concat(F.lit("page source "), e["key"], F.lit(" count "), have(e["key"]).cast("string"),
            F.lit(" != expected "), e["value"].cast("string")))
    few = lambda name, n, least: F.when(n < least, F.concat(F.lit(f"{name} "), n.cast("string"), F.lit(" < minimum "), least.cast("string")))
    return F.concat(F.coalesce(wrong, _strings()),
        F.array_compact(F.array(few("ocr_pages", ocr, least_ocr), few("corrected_pages", corrected, least_corrected))))


def summary_failures(stored: Column, metrics: Column) -> Column:
    """Messages where a stored page summary differs from one computed anew (``page_metrics``); doubles by more than 1e-6."""
    count = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0).cast("bigint"))
    three = lambda m: F.to_json(F.map_from_arrays(F.array(*map(F.lit, ("failed", "pending", "succeeded"))),
            F.array(*(count(m, k) for k in ("failed", "pending", "succeeded")))))
    ordered = lambda m: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
    counts = metrics["status_counts"]
    status = F.when(count(counts, "failed") > 0, "failed").when(count(counts, "pending") > 0, "pending").otherwise("succeeded")
    differs = lambda key, a, b: F.when(~a.eqNullSafe(b), F.concat(F.lit(f"page summary {key} "), _told(a), F.lit(" != expected "), _told(b)))
    near = lambda a, b: (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= 1e-6, F.lit(False))
    far = lambda key, a, b: F.when(~near(a, b), F.concat(F.lit(f"page summary {key} "), _told(a), F.lit(" != expected "), _told(b)))
    found = [differs("status", stored["status"], status),
        differs("status_counts", ordered(stored["status_counts"]), three(counts)),
        differs("source_counts", ordered(stored["source_counts"]), ordered(metrics["source_counts"])),
        differs("warning_counts", ordered(stored["warning_counts"]), ordered(metrics["warning_counts"]))]
    found += [differs(k, stored[k].cast("bigint"), metrics[k].cast("bigint")) for k in ("attempts", "ocr_pages", "corrected_pages")]
    found += [far("average_ocr_confidence", stored["average_ocr_confidence"], metrics["average_ocr_confidence"]),
        far("max_duration_ms", stored["max_duration_ms"], metrics["max_duration_ms"])]
    return F.when(stored.isNull(), _strings()).otherwise(F.array_compact(F.array(*found)))


def converted_failures(text: Column, ratio: Column, least: Column, most: Column, contains: Column, forbidden: Column,
    headings: Column, no_markers: Column) -> Column:
    """What a conversion should hold and doesn't: size, texts, headings, no context marks."""
    low = F.lower(text)
    shown = lambda c: F.format_string("%.3f", c)
    sizes = F.array_compact(F.array(F.when(ratio < least,
                F.concat(F.lit("output ratio "), shown(ratio), F.lit(" < "), shown(least))),
            F.when(ratio > most, F.concat(F.lit("output ratio "), shown(ratio), F.lit(" > "), shown(most)))))
    missing = F.transform(F.filter(contains, lambda x: ~F.contains(low, F.lower(x))), lambda x: F.concat(F.lit("missing expected text: "), x))
    found = F.transform(F.filter(forbidden, lambda x: F.contains(low, F.lower(x))), lambda x: F.concat(F.lit("found forbidden text: "), x))
    marks = F.array_compact(F.array(F.when(headings & ~text.rlike(X.HEADING), "missing Markdown headings"),
            F.when(no_markers & text.rlike(r"(?i)\[context:|\[continuing from:"), "context marker in output")))
    return F.concat(sizes, missing, found, marks)


def corpus_summary(cases: DataFrame) -> DataFrame:
    """Corpus cases (passed, input_bytes, output_chars, page_attempts, failed_pages, ocr_pages, corrected_pages, peak_memory_bytes, max_page_duration_ms, search_recall, phrases, hits, failures) in one row."""
    passed, n = F.count_if("passed"), F.count(F.lit(1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = {"total_input_bytes": "input_bytes", "total_output_chars": "output_chars", "total_page_attempts": "page_attempts",
        "total_failed_pages": "failed_pages", "total_ocr_pages": "ocr_pages", "total_corrected_pages": "corrected_pages",
        "total_search_phrases": "phrases", "total_search_hits": "hits"}
    return cases.agg(
        n.alias("case_count"), passed.alias("passed_count"), (n - passed).alias("failed_count"),
            rollups.ratio(passed, n).alias("pass_rate"), *(total(c).alias(name) for name, c in sums.items()),
            F.coalesce(F.max("peak_memory_bytes"), F.lit(0)).alias("max_peak_memory_bytes"),
            F.max("max_page_duration_ms").alias("max_page_duration_ms"),
        F.avg("search_recall").alias("average_search_recall"), total(F.size("failures")).alias("failure_count"),
            F.count_if(F.size("failures") > 0).alias("failure_case_count"),
    )


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Benchmark runs (provider, input_chars, chunks, total_seconds, chars_per_second) in one row; the evidence is real only if every provider is."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    real = (F.count(F.lit(1)) > 0) & (F.count_if(F.col("provider") == "mock") == 0)
    return runs.agg(F.count(F.lit(1)).alias("run_count"),
        F.coalesce(F.avg("chars_per_second"), F.lit(0.0)).alias("average_chars_per_second"),
        F.coalesce(F.max("chars_per_second"), F.lit(0.0)).alias("fastest_chars_per_second"),
        total("input_chars").alias("total_input_chars"), total("chunks").alias("total_chunks"),
        F.coalesce(F.sum("total_seconds"), F.lit(0.0)).alias("total_seconds"),
        F.when(real, "real-provider").otherwise("mock-smoke").alias("evidence_tier"))


def benchmark(docs: DataFrame, policy: process.ChunkPolicy, repeats: int = 1, key: str = "document_id", **how) -> DataFrame:
    """A run (provider, input_chars, chunks, chunking_seconds, cleaning_seconds, total_seconds, chars_per_second, ..) for each repeat of chunking and cleaning all documents."""
    import time

    if repeats < 1:
        raise ValueError("repeats must be at least 1")
    chars, runs = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0], []
    for _ in range(repeats):
        began = time.perf_counter()
        chunked = process.chunks(docs, policy, key)
        n = chunked.agg(F.count(F.lit(1)), F.sum(F.length("chunk_id"))).first()[0]
        cut = time.perf_counter()
        process.clean(chunked, key=key, **how).agg(F.sum(F.length("clean_text"))).first()  # chunks anew and cleans
        both = max(time.perf_counter() - cut, 1e-9)
        runs.append(("mock", chars, n, cut - began, max(both - (cut - began), 0.0), both, chars / both, policy.target, policy.overlap))
    return docs.sparkSession.createDataFrame(runs,
        "provider string, input_chars bigint, chunks bigint, chunking_seconds double, cleaning_seconds double, total_seconds double, chars_per_second double, chunk_target_chars int, chunk_overlap_chars int")


def synthetic_text(paragraphs: int, chars: int) -> Column:
    """Deterministic text: numbered paragraphs of a seed sentence, repeated and cut to size."""
    if paragraphs < 1 or chars < 1:
        raise ValueError("paragraphs and chars must be at least 1")
    seed = "A rough note about a library: cataloguing, classification, chunking and cleaning of scanned pages. "
    body = F.substring(F.repeat(F.lit(seed), F.lit(chars // len(seed) + 1)), 1, chars)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(paragraphs - 1)), lambda i: F.concat(i.cast("string"), F.lit(". "), body)), "\n\n")


def synthetic_corpus(spark: SparkSession, documents: int, paragraphs: int = 3, chars: int = 400) -> DataFrame:
    """(path, content) of a corpus of Markdown, plain text, SRT and VTT files, one kind after the other; deterministic."""
    i = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, ("md", "txt", "srt", "vtt"))), (i % 4 + 1).cast("int"))
    stamp = lambda s, mark: F.concat(X.srt_time(s, mark), F.lit(" --> "), X.srt_time(s + 2.0, mark))
    cue = lambda mark: lambda n: F.concat((n + 1).cast("string"), F.lit("\n"), stamp(n.cast("double") * 2, mark),
        F.lit("\nSpeaker "), (n % 2 + 1).cast("string"), F.lit(": sentence "), n.cast("string"), F.lit(" of file "),
        i.cast("string"), F.lit("."))
    cues = lambda mark: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(paragraphs * 4 - 1)), cue(mark)), "\n\n")
    text = synthetic_text(paragraphs, chars)
    content = F.when(kind == "md", F.concat(F.lit("# Report "), i.cast("string"), F.lit("\n\n"), text)).when(kind == "txt",
        text).when(kind == "srt", cues(",")).otherwise(F.concat(F.lit("WEBVTT\n\n"), cues(".")))
    return spark.range(documents).select(F.concat(F.lit("file-"), F.lpad(i.cast("string"), 6, "0"), F.lit("."), kind).alias("path"), content.alias("content"))


def load_suite(spark: SparkSession, path: str, most_bytes: int = 1 << 20) -> DataFrame:
    """The cases of a suite in a JSON file; an empty suite or a larger file is an error. Ratios left out are not tested, at least one character is expected."""
    file = spark.read.format("binaryFile").load(path).select("length", F.decode("content", "UTF-8").alias("json")).first()
    if file["length"] > most_bytes:
        raise ValueError(f"evaluation suite exceeds {most_bytes} bytes")
    cases = spark.createDataFrame([(file["json"],)], "json string").select(F.inline(F.from_json("json", CASES)["cases"]))
    if cases.isEmpty():
        raise ValueError("an evaluation suite needs at least one case")
    lists = {c: F.coalesce(c, _strings()) for c in ("tags", "expected_contains", "forbidden_contains", "allowed_warnings")}
    return cases.withColumns({**lists, "min_output_chars": F.coalesce("min_output_chars", F.lit(1))})


def run_suite(cases: DataFrame, policy: process.ChunkPolicy = process.ChunkPolicy(), **how) -> DataFrame:
    """Each case through chunking, cleaning, assembly and classification, all cases in one job: name, passed, sizes, code, warnings and what was expected and isn't so."""
    docs = cases.select(F.col("name").alias("document_id"), F.col("input_text").alias("text"))
    done = process.process(docs, policy, **how).withColumnRenamed("document_id", "name")
    j = cases.join(done.select("name", F.col("text").alias("_out"), F.col("warnings").alias("_w"), "code", "label"), "name",
        "left").withColumns({"_out": F.coalesce("_out", F.lit("")), "_w": F.coalesce("_w", _strings()),
            "code": F.coalesce("code", F.lit("000"))})
    out, low = F.length("_out"), F.lower("_out")
    ratio = out / F.length("input_text")
    shown = lambda c: F.format_string("%.3f", c)
    unexpected = F.array_except("_w", "allowed_warnings")
    one = F.array_compact(
        F.array(
            F.when(F.size(unexpected) > 0, F.concat(F.lit("unexpected output warnings: "), F.array_join(unexpected, ", "))),
                    F.when(out < F.col("min_output_chars"), F.concat(F.lit("output has "), out.cast("string"),
                F.lit(" chars, expected at least "), F.col("min_output_chars").cast("string"))),
            F.when(ratio < F.col("min_output_char_ratio"),
                        F.concat(F.lit("output character ratio "), shown(ratio), F.lit(" is below minimum "),
                shown(F.col("min_output_char_ratio")))), F.when(ratio > F.col("max_output_char_ratio"),
                        F.concat(F.lit("output character ratio "), shown(ratio), F.lit(" is above maximum "),
                shown(F.col("max_output_char_ratio")))),
        )
    )
    missing = F.transform(F.filter("expected_contains", lambda x: ~F.contains(low, F.lower(x))), lambda x: F.concat(F.lit("missing expected text: "), x))
    found = F.transform(F.filter("forbidden_contains", lambda x: F.contains(low, F.lower(x))), lambda x: F.concat(F.lit("found forbidden text: "), x))
    prefix = F.col("expected_classification_prefix")
    off = F.array_compact(F.array(F.when(F.coalesce(prefix, F.lit("")) != "",
                F.when(~F.startswith("code", prefix), F.concat(F.lit("classification "), "code", F.lit(" does not match "),
            prefix)))))
    told = j.withColumn("failures", F.concat(one, missing, found, off))
    return told.select("name", (F.size("failures") == 0).alias("passed"), "tags", F.length("input_text").alias("input_chars"),
        out.alias("output_chars"), ratio.alias("output_char_ratio"), "code", "label", F.col("_w").alias("warnings"),
        "failures")
