"""Files as DataFrames: discovery, archive and binary guards, extraction by extension, caching, resumable import.

Extraction never fails a job: each file has a status and an error. PDF, Office, OCR and model back ends are functions given by the caller.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import names, transcripts
from ..session import spread

TEXT, CAPTIONS, PAGES = ("txt", "md", "csv"), ("srt", "vtt"), ("html", "htm", "xml")
SUPPORTED = (*TEXT, "json", *CAPTIONS, *PAGES)
#: First bytes in hexadecimal and what they tell.
ARCHIVES = (("504B0304", "zip"), ("504B0506", "zip"), ("1F8B", "gzip"), ("FD377A585A00", "xz"),
    ("377ABCAF271C", "7z"), ("526172211A07", "rar"), ("28B52FFD", "zstd"))
#: Beginnings that are letters are told by more than those: bzip2 by its level and the mark of a block or of the end, tar by the bytes after its name.
BZIP2, TARS = "^425A683[1-9](?:314159265359|177245385090)", (b"ustar\x00", b"ustar  \x00")
STATUSES = {"convert": ("converted", "ingested", "processed", "queued"), "ingest": ("ingested", "processed", "queued"),
    "process": ("processed",), "queue": ("queued", "processed")}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def archive_label(content: Column) -> Column:
    """The kind of archive by its first bytes, or null."""
    head = F.hex(F.substring(content, 1, 10))
    out = F.when(F.lit(False), "")
    for magic, name in ARCHIVES:
        out = out.when(F.startswith(head, F.lit(magic)), name)
    out = out.when(head.rlike(BZIP2), "bzip2")
    for magic in TARS:
        out = out.when(F.substring(content, 258, len(magic)) == F.lit(magic), "tar")
    return out


def has_nul(content: Column) -> Column:
    return F.instr(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), "\x00") > 0


MARK = "folioflow"
ARTIFACTS = ("conversion-sidecar", "import-manifest", "import-report", "pdf-page-extraction-manifest")
#: Sidecars are told by this much of a JSON file.
SIDECAR_BYTES = 65_536


def any_case(extensions: tuple[str, ...]) -> str:
    """A path pattern for files of these extensions in any case, which the listing applies before a file is opened."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def local_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def is_under(path: Column, roots: tuple[str, ...]) -> Column:
    """Is the path one of the roots or below one?"""
    out = F.lit(False)
    for root in roots:
        out |= (local_path(path) == root.rstrip("/")) | F.startswith(local_path(path), F.lit(root.rstrip("/") + "/"))
    return out


def is_artifact(content: Column) -> Column:
    """Is this JSON one of the files written here beside converted ones? Files beyond ``SIDECAR_BYTES`` are told by their beginning."""
    head = F.decode(F.substring(content, 1, SIDECAR_BYTES), "ISO-8859-1")
    kind = "|".join(ARTIFACTS)
    return head.rlike(rf'"generated_by"\s*:\s*"{MARK}"') & head.rlike(rf'"artifact_type"\s*:\s*"(?:{kind})"')


def discover(spark: SparkSession, folder: str, recursive: bool = True, excluded: tuple[str, ...] = (),
    supported: tuple[str, ...] = SUPPORTED, allowed_root: str | None = None, ordered: bool = False) -> DataFrame:
    """(source_path, length, modified_at, content) of supported files.

    Generated JSON files are left out, and so are files that have one beside them (they were written here), files below ``excluded`` and
    files outside ``allowed_root``. Only JSON files are read for this, the others' content only if the caller uses it. ``ordered`` sorts by lower-cased path below the folder.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())

    def listed(extensions: tuple[str, ...]) -> DataFrame:
        files = reader.option("pathGlobFilter", any_case(extensions)).load(folder)
        return files.select(F.col("path").alias("source_path"), "length", F.col("modificationTime").alias("modified_at"), "content")

    sidecars = listed(("json",)).where(is_artifact(F.col("content"))).select(F.regexp_replace("source_path", r"\.[jJ][sS][oO][nN]$", "").alias("source_path"))
    rest = tuple(e for e in supported if e != "json")
    files = listed(rest) if rest else None
    if "json" in supported:
        own = listed(("json",)).where(~is_artifact(F.col("content")))
        files = own if files is None else files.unionByName(own)
    files = files.where(~is_under(F.col("source_path"), tuple(excluded))).join(sidecars, "source_path", "left_anti")
    if allowed_root:
        files = files.where(is_under(F.col("source_path"), (allowed_root,)))
    return files.orderBy(F.lower("source_path"), "source_path") if ordered else files


def extract(files: DataFrame, most_bytes: int = 50 << 20, others: dict[str, Callable[[bytes], str]] | None = None,
    fallback: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``files`` with text, status (converted or failed) and error. ``others`` maps more extensions to extractors, run in Arrow batches; where one fails, that of ``fallback`` is tried.

    A file never fails the job: bytes that are no UTF-8, another kind, an archive, a NUL byte, too many bytes or no text each give an error. Only the files of a kind that
    needs Python are sent to it.
    """
    kind, content = extension(F.col("source_path")), F.col("content")
    known = (*SUPPORTED, *(others or ()))
    decoded = F.try_validate_utf8(content.cast("string"))
    error = F.when(~kind.isin(*known), F.concat(F.lit("unsupported file extension: "), kind)).when(content.isNull(),
        "file cannot be read").when(F.length(content) > most_bytes, "file exceeds the configured limit")
    error = error.when(kind.isin(*SUPPORTED) & archive_label(content).isNotNull(),
        F.concat(F.lit("archive inputs are not supported: "),
            archive_label(content))).when(kind.isin(*SUPPORTED) & has_nul(content),
        "file is binary").when(kind.isin(*SUPPORTED) & decoded.isNull(), "file is not valid UTF-8")
    checked = files.withColumn("_error", error).withColumn("_kind", F.when(F.col("_error").isNull(), kind))
    raw, kind = decoded, F.col("_kind")

    @F.pandas_udf("string")
    def pretty(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            try:
                return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
            except ValueError:
                return t  # kept as it is

        return texts.map(one, na_action="ignore")

    of = lambda kinds: F.when(kind.isin(*kinds), raw)
    captions = F.nullif(transcripts.render_column(transcripts.parse_column(of(CAPTIONS), merged=True), "md"), F.lit(""))
    text = F.when(kind.isin(*TEXT), raw).when(kind == "json", pretty(of(("json",)))).when(kind.isin(*CAPTIONS),
        captions).when(kind.isin(*PAGES), X.html_to_text(raw))
    if others:

        @F.pandas_udf("string")
        def custom(contents: pd.Series, kinds: pd.Series) -> pd.Series:
            def one(c: bytes, k: str) -> str | None:
                for extractors in (others, fallback or {}):
                    if k in extractors:
                        try:
                            return extractors[k](c)
                        except Exception as e:  # one file must not fail the job
                            failed = f"\x00{e}"
                return failed

            return pd.Series([one(c, k) if k in others else None for c, k in zip(contents, kinds)], dtype=object)

        text = text.when(kind.isin(*others), custom(F.when(kind.isin(*others), content), kind))
    out = checked.withColumn("text", text)
    out = out.withColumn("error", F.coalesce("_error", F.when(F.startswith("text", F.lit("\x00")), F.substring("text", 2, 1000)),
            F.when(F.col("text").isNull() | (X.strip(F.col("text")) == ""), "no extractable text"))).drop("_error", "_kind")
    return out.withColumns({"text": F.when(F.col("error").isNull(), F.col("text")),
            "status": F.when(F.col("error").isNull(), "converted").otherwise("failed"),
            "failure": F.when(F.col("error").isNotNull(), X.conversion_failure(F.col("error")))})


def config_signature(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:32]


def extract_cached(files: DataFrame, cache: DataFrame, signature: str, **how) -> tuple[DataFrame, DataFrame]:
    """(extracted files, new cache rows): contents extracted before under the same configuration are taken from the cache; failures are not cached."""
    keyed = files.withColumn("content_sha256", F.sha2("content", 256))
    known = cache.where(F.col("config_signature") == signature).select("content_sha256", "text")
    hit = keyed.join(known, "content_sha256").withColumns({"error": F.lit(None).cast("string"), "status": F.lit("converted"),
            "failure": F.lit(None).cast("string")})
    fresh = extract(keyed.join(known, "content_sha256", "left_anti"), **how)
    new = fresh.where("status = 'converted'").select("content_sha256", F.lit(signature).alias("config_signature"),
        extension(F.col("source_path")).alias("source_extension"), "text").dropDuplicates(["content_sha256"])
    return hit.unionByName(fresh), new


def read_pages(pages: DataFrame) -> DataFrame:
    return spread(pages).withColumn("text", X.html_to_text(F.col("html")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The items of an import manifest; of repeated source paths the last."""
    ddl = "items array<struct<source_path:string,converted_path:string,document_id:string,run_id:string,status:string,error:string>>"
    items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", ddl)["items"]).alias("_n", "item")).select("_n", "item.*")
    return items.withColumn("_r", F.row_number().over(Window.partitionBy("source_path").orderBy(F.desc("_n")))).where("_r = 1").drop("_n", "_r")


def plan_import(files: DataFrame, manifest: DataFrame | None, mode: str) -> DataFrame:
    """``files`` with ``resume``: was it finished for this mode by an earlier import?"""
    if mode not in STATUSES:
        raise ValueError(f"unknown mode: {mode}")
    if manifest is None:
        return files.withColumn("resume", F.lit(False))
    done = manifest.where(F.col("status").isin(*STATUSES[mode], "skipped")).select("source_path", F.lit(True).alias("_done"))
    return files.join(done, "source_path", "left").withColumn("resume", F.coalesce("_done", F.lit(False))).drop("_done")


def import_files(files: DataFrame, manifest: DataFrame | None = None, mode: str = "ingest", **how) -> DataFrame:
    """(source_path, document_id, status, error, text): earlier finished files are skipped, the rest extracted, each on its own."""
    planned = plan_import(files, manifest, mode)
    skipped = planned.where("resume").select("source_path", F.lit(None).cast("string").alias("document_id"),
        F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("text"))
    fresh = extract(planned.where("NOT resume"), **how).withColumn("document_id",
        F.when((F.col("status") == "converted") & (F.lit(mode) != "convert"),
            F.concat(F.lit("doc_"), F.substring(F.sha2("content", 256), 1, 16))))
    status = F.when(F.col("status") == "failed", "failed").otherwise({"convert": "converted", "ingest": "ingested",
            "process": "processed", "queue": "queued"}[mode])
    return skipped.unionByName(fresh.select("source_path", "document_id", status.alias("status"), "error", "text"))


def output_path(source: Column, source_dir: str, format: str, mode: str, target: str | None = None, subdirectory: str = "converted") -> Column:
    """Where a converted file goes: beside its source, in a subdirectory, or in a new directory."""
    if mode == "new-directory" and not target:
        raise ValueError("an output directory is required for new-directory mode")
    base = source_dir.rstrip("/")
    named = F.concat(F.regexp_replace(source, r"\.[^./]*$", ""), F.lit(f".{format}"))
    below = F.substring(named, F.lit(len(base) + 2), F.length(named))
    return {"original": named, "subdirectory": F.concat(F.lit(f"{base}/{subdirectory}/"), below),
        "new-directory": F.concat(F.lit(f"{(target or '').rstrip('/')}/"), below)}[mode]


def unique_paths(df: DataFrame, column: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Paths that meet no other row's and none of ``existing`` (a column of the same name): -2, -3, .. before the extension."""
    stem, ending = F.regexp_extract(column, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(column, r"(\.[^./]*)$", 1)
    parts = lambda d: d.withColumns({"_stem": stem, "_ending": ending})
    named = names.with_free_names(parts(df), ["_ending"], "_stem", order, None if existing is None else parts(existing.select(column)))
    return named.withColumn(column, F.concat("_stem", "_ending")).drop("_stem", "_ending")


def existing_paths(spark: SparkSession, folder: str, column: str = "path") -> DataFrame:
    """The files below a folder, by listing alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(local_path(F.col("path")).alias(column))


def render_conversion(text: Column, source: Column, format: str) -> Column:
    """Markdown gets a title unless the source is Markdown or a PDF with front matter; plain text loses its marks."""
    body, kind = X.strip(text), extension(source)
    if format == "txt":
        return F.concat(X.markdown_to_text(body), F.lit("\n"))
    name = F.element_at(F.split(source, "/"), -1)
    title = F.coalesce(X.blank_to_null(X.strip(F.translate(X.stem(name), "_-", "  "))), name)
    own = (kind == "md") | ((kind == "pdf") & F.startswith(body, F.lit("---\n")))
    return F.when(own, F.concat(body, F.lit("\n"))).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n")))


def write_files(df: DataFrame, path: str = "path", content: str = "content", root: str = "") -> DataFrame:
    """Write each row's content to its path below ``root``, a folder all executors share, from the executors; gives (path, bytes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for f in frames:
            sizes = []
            for p, c in zip(f[path], f[content]):
                target = os.path.join(root, p.lstrip("/"))
                os.makedirs(os.path.dirname(target), exist_ok=True)
                data = c.encode()
                with open(target + ".tmp", "wb") as out:
                    out.write(data)
                os.replace(target + ".tmp", target)
                sizes.append(len(data))
            yield pd.DataFrame({"path": f[path], "bytes": sizes})

    return df.select(path, content).mapInPandas(run, "path string, bytes bigint")
