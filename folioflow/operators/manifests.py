"""JSON that is written beside converted files and read again: sidecars, page manifests, import manifests and reports; and pages as Markdown.

All are Column expressions or one aggregate by file; ``readers.write_files`` writes them. JSON is compact, keys are in the order given here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .rollups import page_status

MARK = "folioflow"
PAGE = "struct<page_number:int,source:string,status:string,chars:int,confidence:double,corrected:boolean,error:string,warnings:array<string>,attempts:int,duration_ms:double,raw_text:string,image_path:string,rotation_degrees:int,text:string>"
SUMMARY = "struct<status:string,status_counts:map<string,int>,source_counts:map<string,int>,warning_counts:map<string,int>,attempts:int,ocr_pages:int,corrected_pages:int,average_ocr_confidence:double,max_duration_ms:double>"
MANIFEST = f"struct<generated_by:string,artifact_type:string,schema_version:int,source_path:string,source_sha256:string,extraction_config:string,page_count:int,summary:{SUMMARY},pages:array<{PAGE}>>"
PAGE_MANIFEST, SIDECAR, REPORT, IMPORT = "pdf-page-extraction-manifest", "conversion-sidecar", "import-report", "import-manifest"
_ALL = {"ignoreNullFields": "false"}


def sidecar(source_path: Column, output_path: Column, format: Column, text: Column, extraction: Column | None = None) -> Column:
    """Where a converted file comes from and what was found in it."""
    fields = [F.lit(MARK).alias("generated_by"), F.lit(SIDECAR).alias("artifact_type"), source_path.alias("source_path"),
        output_path.alias("output_path"), format.alias("format"), F.length(text).alias("output_chars")]
    return F.to_json(F.struct(*fields, (F.lit(None).cast("string") if extraction is None else extraction).alias("extraction")), _ALL)


def sidecar_path(output_path: Column) -> Column:
    return F.concat(output_path, F.lit(".json"))


def attempts_of(value: Column) -> Column:
    """A count, 0 if it is none."""
    return F.when(value >= 0, value).otherwise(0)


def rotation_degrees(value: Column) -> Column:
    return F.when(value.isin(0, 90, 180, 270), value).otherwise(0)


def int_or(value: Column, default: int = 0) -> Column:
    """An integer, or a text that is one; else the default."""
    return F.coalesce(F.trim(value.cast("string")).try_cast("int"), F.lit(default))


def warnings_of(json: Column) -> Column:
    """The strings of a JSON array, whatever else it holds; empty for anything that is no array."""
    items = F.coalesce(F.from_json(json, "array<variant>"), F.expr("array()").cast("array<variant>"))
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(strings, lambda v: F.variant_get(v, "$", "string"))


def _counts(values: Column) -> Column:
    """Distinct values of an array with their counts, as a map sorted by value."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(v, F.size(F.filter(values, lambda x: x == v)))))


def summary_of(pages: Column) -> Column:
    """The roll-up of an array of page records."""
    of = lambda c: F.transform(pages, lambda p: p[c])
    n = lambda value: F.size(F.filter(of("status"), lambda s: s == value))
    known = lambda c: F.filter(of(c), lambda x: x.isNotNull())
    filled = lambda x: F.filter(x, lambda v: v.isNotNull() & (v != ""))
    warnings = filled(F.flatten(F.transform(pages, lambda p: F.coalesce(p["warnings"], F.array().cast("array<string>")))))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    confidences = known("confidence")
    return F.struct(
        F.when(n("failed") > 0, "failed").when(n("pending") > 0, "pending").otherwise("succeeded").alias("status"),
        F.map_from_arrays(F.array(*map(F.lit, ("failed", "pending", "succeeded"))), F.array(n("failed"), n("pending"), n("succeeded"))).alias("status_counts"),
        _counts(filled(of("source"))).alias("source_counts"),
        _counts(warnings).alias("warning_counts"),
        F.aggregate(of("attempts"), F.lit(0), lambda a, x: a + F.coalesce(attempts_of(x), F.lit(0))).alias("attempts"),
        F.size(F.filter(of("source"), lambda s: s == "ocr")).alias("ocr_pages"),
        F.size(F.filter(of("corrected"), lambda c: c)).alias("corrected_pages"),
        F.when(F.size(confidences) > 0, total(confidences) / F.size(confidences)).alias("average_ocr_confidence"),
        F.array_max(F.filter(known("duration_ms"), lambda d: d >= 0)).alias("max_duration_ms"),
    )


def page_manifest(pages: DataFrame, by: list[str]) -> DataFrame:
    """(by, source_path, source_sha256, extraction_config, page_count, json): the manifest of each file.

    ``pages`` has the columns of a page record, a status or the error and source that give one. Pages of a file that has no record yet are ``pending``, without attempts.
    A file's pages are one row; their number is bounded by the file.
    """
    own = [F.col("page_number").cast("int").alias("page_number"), "source",
        (F.col("status") if "status" in pages.columns else page_status(F.col("error"), F.col("source"))).alias("status"),
        F.length(F.coalesce("text", F.lit(""))).alias("chars")]
    record = F.struct(*own, F.col("confidence").cast("double").alias("confidence"), "corrected", "error", "warnings",
        F.col("attempts").cast("int").alias("attempts"), F.col("duration_ms").cast("double").alias("duration_ms"), "raw_text",
        "image_path", F.col("rotation_degrees").cast("int").alias("rotation_degrees"), "text")
    held = pages.groupBy(*by).agg(F.sort_array(F.collect_list(record)).alias("_have"),
        *(F.first(c).alias(c) for c in ("source_path", "source_sha256", "extraction_config")),
        F.max("page_count").cast("int").alias("page_count"))
    missing = F.array_except(F.when(F.col("page_count") >= 1,
            F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.array().cast("array<int>")), F.col("_have.page_number"))
    blank = lambda n: F.from_json(F.concat(F.lit('{"source":"pending","status":"pending","attempts":0,"text":"","page_number":'),
            n.cast("string"), F.lit("}")), PAGE)
    held = held.withColumn("_have", F.col("_have").cast(f"array<{PAGE}>"))
    every = held.withColumn("pages", F.sort_array(F.concat("_have", F.transform(missing, blank))))
    whole = F.struct(F.lit(MARK).alias("generated_by"), F.lit(PAGE_MANIFEST).alias("artifact_type"),
        F.lit(1).alias("schema_version"), "source_path", "source_sha256", "extraction_config", "page_count",
        summary_of(F.col("pages")).alias("summary"), "pages")
    return every.select(*by, "source_path", "source_sha256", "extraction_config", "page_count", F.to_json(whole, _ALL).alias("json"))


def read_page_manifest(json: Column) -> Column:
    """struct(error, manifest): what a page manifest says, or why it is none. A text is parsed once for its validity and once for its fields."""
    is_object = F.regexp_like(json, F.lit(r"(?s)^\s*\{.*\}\s*$"))
    is_list = F.regexp_like(F.coalesce(F.get_json_object(json, "$.pages"), F.lit("")), F.lit(r"^\s*\["))

    def judge(x: Column) -> Column:
        parsed = x["parsed"]
        has_pages = parsed["pages"].isNotNull() | is_list  # the second only for lists that are no list of pages
        error = F.when(~x["valid"], "page manifest is invalid JSON").when(~is_object,
            "page manifest must be a JSON object").when(~parsed["artifact_type"].eqNullSafe(PAGE_MANIFEST),
            "page manifest has an unexpected artifact_type").when(~has_pages, "page manifest is missing pages")
        return X.let(error, lambda e: F.struct(e.alias("error"), F.when(e.isNull(), parsed).alias("manifest")))

    return X.let(F.struct(F.try_parse_json(json).isNotNull().alias("valid"), F.from_json(json, MANIFEST, {"mode": "PERMISSIVE"}).alias("parsed")), judge)


def pages_of(manifests: DataFrame, json: str = "json", by: list[str] = ()) -> DataFrame:
    """The page records of manifests as rows; invalid ones have none."""
    return manifests.select(*by, F.inline(read_page_manifest(F.col(json))["manifest"]["pages"]))


def page_window(pages: DataFrame, limit: int, offset: int = 0, failures_only: bool = False) -> DataFrame:
    """A page of page records in order, of the failed ones only if wanted."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive, offset not negative")
    shown = pages.where("status = 'failed'") if failures_only else pages
    return shown.orderBy("page_number").offset(offset).limit(limit)


def previous_attempts(stored: DataFrame, by: list[str]) -> DataFrame:
    """(by, page_number, attempts) that earlier manifests count for each page; of repeated pages the last."""
    return stored.where("page_number IS NOT NULL").groupBy(*by, "page_number").agg(F.max(attempts_of(F.coalesce("attempts", F.lit(0)))).alias("attempts"))


def pages_markdown(pages: DataFrame, by: list[str], source_path: str = "source_path") -> DataFrame:
    """(by, markdown): each file's pages in order under front matter, each after a comment that says where its text is from."""
    number, text = F.col("page_number").cast("string"), X.strip(F.coalesce("text", F.lit("")))
    failed = F.concat(F.lit("<!-- page: "), number, F.lit(" source: "), "source", F.lit(" status: failed error: "), "error", F.lit(" -->\n"))
    shown = F.concat(F.lit("<!-- page: "), number, F.lit(" source: "), "source", F.lit(" corrected: "),
        F.coalesce("corrected", F.lit(False)).cast("string"), F.lit(" -->\n\n#### Page "), number, F.lit("\n\n"), text,
        F.lit("\n"))
    block = F.when((text == "") & F.col("error").isNotNull() & (F.col("error") != ""), failed).otherwise(shown)
    one = pages.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("page_number").alias("n"),
                block.alias("b")))), lambda x: x["b"]), "\n").alias("_body"), F.count(F.lit(1)).alias("_n"),
        F.first(source_path).alias("_path"))
    name = F.element_at(F.split("_path", "/"), -1)
    title = F.coalesce(X.blank_to_null(X.strip(F.translate(X.stem(name), "_-", "  "))), name)
    head = F.concat(F.lit(f"---\ngenerated_by: {MARK}\nartifact_type: pdf-page-extraction\nsource_file: "), name,
        F.lit("\npage_count: "), F.col("_n").cast("string"), F.lit("\n---\n\n# "), title, F.lit("\n\n"))
    return one.select(*by, F.concat(X.strip(F.concat(head, "_body")), F.lit("\n")).alias("markdown"))


_ITEM = ("source_path", "converted_path", "document_id", "run_id", "status", "error")


#: Items of one part of a report, about 1.5 MB of JSON.
REPORT_ITEMS = 10_000


def import_report(items: DataFrame, kind: str = REPORT, most_items: int = REPORT_ITEMS) -> DataFrame:
    """A row (json) for each part of an import's report: the summary of the whole import and up to about ``most_items`` of its items, by source path.

    An import of up to ``most_items`` is one part. The parts of a larger one are ranges of source paths, so that none is larger for the import's size; each is a report by itself.
    """
    if kind not in (REPORT, IMPORT):
        raise ValueError(f"unknown kind: {kind}")
    done = lambda *s: F.count_if(F.col("status").isin(*s)).alias
    names = ("converted", "ingested", "processed", "queued", "skipped", "failed")
    told = items.agg(
        done("converted", "ingested", "processed", "queued")("converted"),
            F.count_if(F.col("document_id").isNotNull()).alias("ingested"), done("processed")("processed"),
            done("queued")("queued"), done("skipped")("skipped"), done("failed")("failed"), F.count(F.lit(1)).alias("_n"),
    ).first()
    n_parts = -(-told["_n"] // most_items)
    summary = F.struct(*(F.lit(told[c]).cast("bigint").alias(c) for c in names))
    each = items.select(*(F.col(c).cast("string").alias(c) for c in _ITEM))
    listed = F.array_sort(F.collect_list(F.struct(*_ITEM))).alias("items")
    if n_parts <= 1:
        parts = each.agg(listed)
    else:
        parts = each.repartitionByRange(n_parts, *_ITEM).groupBy(F.spark_partition_id().alias("_part")).agg(listed)
    return parts.select(F.to_json(F.struct(F.lit(MARK).alias("generated_by"), F.lit(kind).alias("artifact_type"),
                summary.alias("summary"), "items"), _ALL).alias("json"))


def manifest_error(path: str, json: str | None) -> str | None:
    """Why a file can't be overwritten as an import manifest; null if it can. ``json`` is what the file holds, null if there is none."""
    import json as J

    if not path.lower().endswith(".json"):
        return "manifest_path must use a .json file"
    if json is None:
        return None
    try:
        held = J.loads(json)
    except ValueError:
        return "manifest_path points to an invalid JSON file"
    if not isinstance(held, dict):
        return "manifest_path points to a non-object JSON file"
    return None if held.get("generated_by") == MARK and held.get("artifact_type") in (REPORT,
        IMPORT) else "manifest_path points to a JSON file of another origin"


def workspace_output(data_dir: str, source_name: str | None, mode: str, output_dir: str | None = None) -> tuple[str, str | None]:
    """(mode, directory): workspace mode is a new directory below the data's; a directory import gets one of its own there."""
    if mode != "workspace":
        return mode, output_dir
    if output_dir is not None:
        raise ValueError("output_dir is only supported with new-directory output mode")
    root = f"{data_dir.rstrip('/')}/converted"
    return "new-directory", f"{root}/{source_name}" if source_name else root


def output_exclusions(source_dir: str, mode: str, output_dir: str | None = None, subdirectory: str = "converted") -> tuple[str, ...]:
    """Directories that discovery skips because the conversion writes there."""
    if mode == "subdirectory":
        return (f"{source_dir.rstrip('/')}/{subdirectory}",)
    return (output_dir,) if mode == "new-directory" and output_dir else ()


def check_output(source_dir: str, mode: str, output_dir: str | None) -> None:
    if mode != "new-directory":
        return
    if output_dir is None:
        raise ValueError("an output directory is required for new-directory mode")
    if (source_dir.rstrip("/") + "/").startswith(output_dir.rstrip("/") + "/"):
        raise ValueError("output_dir must not be source_dir or an ancestor of source_dir")


def budget_error(files: DataFrame, most_files: int, most_bytes: int) -> str | None:
    """Why files are too many or too large for one import; null if they aren't. Listing only."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if n > most_files:
        return f"Import contains more than {most_files} files, exceeding configured limit {most_files}"
    return f"Import contains more than {most_bytes} bytes, exceeding configured limit {most_bytes}" if size > most_bytes else None


def enrich_figures(docs: DataFrame, figures: DataFrame, describe, key: str = "document_id", most: int = 10, least_bytes: int = 1,
    most_bytes: int = 10 << 20, most_chars: int = 2000) -> DataFrame:
    """``docs`` with a description after each figure's placeholder in ``text``, and ``n_figures``.

    ``figures``: key, ordinal, placeholder, page, media_type, data. Of equal placeholders the first counts; it must stand in the text and be of a size in
    range; the first ``most`` by ordinal are described. ``describe`` maps (media_type, data) columns to a text column, null where it fails.
    """
    f = figures.join(docs.select(key, "text"), key).where(F.contains("text", "placeholder") &
        F.octet_length("data").between(least_bytes, most_bytes)).drop("text")
    from pyspark.sql import Window

    f = f.withColumn("_n", F.row_number().over(Window.partitionBy(key,
                "placeholder").orderBy("ordinal"))).where("_n = 1").withColumn("_n",
        F.row_number().over(Window.partitionBy(key).orderBy("ordinal"))).where(F.col("_n") <= most)
    told = f.withColumn("_d", X.blank_to_null(F.substring(X.strip(describe(F.col("media_type"), F.col("data"))), 1, most_chars))).where("_d IS NOT NULL")
    blocks = told.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "placeholder",
        F.concat("placeholder", F.lit("\n\n**Figure (page "), F.col("page").cast("string"), F.lit("):** "),
            "_d").alias("block")))).alias("_b"))

    def put(text: Column, b: Column) -> Column:
        at = F.position(b["placeholder"], text)
        return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), b["block"],
                F.substring(text, at + F.length(b["placeholder"]), F.length(text)))).otherwise(text)

    joined = docs.join(blocks, key, "left")
    text = F.when(F.col("_b").isNotNull(), F.aggregate("_b", F.col("text"), put)).otherwise(F.col("text"))
    return joined.withColumns({"text": text, "n_figures": F.coalesce(F.size("_b"), F.lit(0))}).withColumn("n_figures",
        F.greatest("n_figures", F.lit(0))).drop("_b")


def figure_media_type(format: Column) -> Column:
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp",
        "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)),
            F.ltrim(F.lower(format), F.lit("."))), F.lit("image/png"))


def paragraph_text(text: Column, style: Column) -> Column:
    """A paragraph of a word-processor file: list styles become list marks."""
    body, kind = X.strip(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(style, F.lit("")))
    return F.when(body == "", "").when(kind.contains("list bullet"),
        F.concat(F.lit("- "), body)).when(kind.contains("list number"), F.concat(F.lit("1. "), body)).otherwise(body)


def table_text(rows: Column) -> Column:
    """Rows of cell texts, filled cells joined by bars, rows without any left out."""
    lines = F.transform(rows, lambda cells: F.array_join(F.filter(F.transform(cells, lambda c: X.strip(F.coalesce(c, F.lit("")))), lambda c: c != ""), " | "))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def word_text(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, text) of word-processor parts (place, ordinal, text, style, rows): body paragraphs, then tables, then headers and footers, blank ones left out."""
    shown = F.when(F.col("rows").isNotNull(), table_text(F.col("rows"))).otherwise(paragraph_text(F.col("text"), F.col("style")))
    rank = F.when(F.col("place") != "body", 2).when(F.col("rows").isNotNull(), 1).otherwise(0)
    return parts.select(*by, rank.alias("_r"), "ordinal",
        shown.alias("_t")).where("_t <> ''").groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r",
                "ordinal", "_t"))), lambda x: x["_t"]), "\n\n").alias("text"))
