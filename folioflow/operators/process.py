"""Processing documents: chunk, clean, validate, assemble, classify, all documents in one job.

Chunking and sentence dedupe walk a text from left to right, so they are Arrow UDFs; everything else is Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import spread

#: White space after a sentence's end, an empty line, a line feed before a heading. It begins with \s so that the search skips to white space.
_BREAK = re.compile(r"\s(?:(?<=[!?.]\s)\s*|(?<=\n)(?:\n+|(?=\#{1,6}\s)))")
CHUNKS = "array<struct<ordinal:int,text:string,start_char:int,end_char:int>>"


@dataclass(frozen=True)
class ChunkPolicy:
    target: int = 12_000
    overlap: int = 800
    least: int = 500

    def __post_init__(self):
        if self.target <= 0 or self.least < 0 or not 0 <= self.overlap < self.target:
            raise ValueError("target must be positive, overlap not negative and below target, least not negative")


def _past_blanks(text: str, at: int) -> int:
    rest = text[at : at + 64]
    while rest and rest.isspace():
        at += len(rest)
        rest = text[at : at + 64]
    return at + len(rest) - len(rest.lstrip())


def _last_break(body: str, first: int, end: int) -> int | None:
    """Start of the last break from ``first`` to ``end``, looked for from behind. A search begins after a character that is no white space, so it finds the breaks that one from ``first`` does."""
    size = 128
    while True:
        at = max(first, end - size)
        while at > first and body[at - 1].isspace():
            at -= 1
        last = None
        for last in _BREAK.finditer(body, at, end + 1):
            pass
        if last or at == first:
            return last and last.start()
        size *= 4


def split_text(text: str | None, policy: ChunkPolicy) -> list[dict]:
    """Chunks of about ``target`` characters that overlap, cut at the last heading, blank line or sentence end in their second half, else hard."""
    body = (text or "").strip()
    out: list[dict] = []
    at, size = 0, len(body)
    while at < size:
        end = at + policy.target
        if end >= size:
            end = size
        else:
            place = _last_break(body, at + max(policy.least, policy.target // 2), end)
            end = end if place is None else place
        piece = body[at:end].strip()
        if piece:
            first = _past_blanks(body, at)
            out.append({"ordinal": len(out), "text": piece, "start_char": first, "end_char": first + len(piece)})
        if end >= size:
            break
        back = max(end - policy.overlap, 0)
        at = _past_blanks(body, back if back > at else end)
    return out


def chunk_column(text: Column, policy: ChunkPolicy = ChunkPolicy()) -> Column:
    @F.arrow_udf(CHUNKS)
    def run(texts: pa.Array) -> pa.Array:
        found, offsets = [], [0]
        for t in texts:
            found += split_text(t.as_py(), policy)
            offsets.append(len(found))
        fields = [(n, k, [c[n] for c in found]) for n, k in (("ordinal", pa.int32()), ("text", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()))]
        each = pa.StructArray.from_arrays([pa.array(v, k) for _, k, v in fields], [n for n, _, _ in fields])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)

    return run(text)


def chunks(docs: DataFrame, policy: ChunkPolicy = ChunkPolicy(), key: str = "document_id") -> DataFrame:
    """(key, ordinal, text, start_char, end_char, sha256, chunk_id); ids derive from content."""
    one = docs.select(key, F.inline(chunk_column(F.col("text"), policy))).withColumn("sha256", F.sha2("text", 256))
    return one.withColumn("chunk_id", X.digest("chk_", F.concat_ws(":", F.col(key).cast("string"), "ordinal", "sha256")))


def ingest(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Content-addressed documents of (source_path, content): document_id, sha256, byte_size, filename, media_type, duplicate.

    Equal contents are one document; it is a duplicate if it is known already.
    """
    name = F.element_at(F.split("source_path", "/"), -1)
    mime = {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "html": "text/html",
        "htm": "text/html", "pdf": "application/pdf", "srt": "application/x-subrip", "vtt": "text/vtt",
        "xml": "application/xml"}
    kinds = F.create_map(*(F.lit(x) for pair in mime.items() for x in pair))
    own = files.withColumns({"sha256": F.sha2("content", 256), "byte_size": F.octet_length("content").cast("bigint"),
            "filename": name, "media_type": F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))),
                F.lit("application/octet-stream"))})
    own = own.withColumn("document_id", F.concat(F.lit("doc_"), F.substring("sha256", 1, 16)))
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy("source_path"))).where("_n = 1").drop("_n", "content")
    if known is None:
        return first.withColumn("duplicate", F.lit(False))
    held = known.select("document_id", F.lit(True).alias("_known")).distinct()
    return first.join(held, "document_id", "left").withColumn("duplicate", F.coalesce("_known", F.lit(False))).drop("_known")


def cache_misses(chunked: DataFrame, cache: DataFrame) -> DataFrame:
    return chunked.join(cache.select("chunk_sha256"), chunked["sha256"] == cache["chunk_sha256"], "left_anti")


def cache_hits(chunked: DataFrame, cache: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks whose text was cleaned before; of equal chunks of a document the last one is served, the others are cleaned again."""
    last = Window.partitionBy(key, "sha256").orderBy(F.desc("ordinal"))
    one = chunked.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return one.join(cache.select(F.col("chunk_sha256").alias("sha256"), F.col("text").alias("clean_text")), "sha256")


def clean(chunked: DataFrame, model: Callable[[Column], Column] = X.mock_clean, mode: str = "fast", key: str = "document_id",
    most_chars: int | None = None) -> DataFrame:
    """(.., clean_text, warnings) of every chunk. ``model`` maps a prompt column to an answer.

    fast: chunks alone. balanced: with the last 500 characters of the answer before, in runs of four. max-coherence: through the document.
    For the carried context the chunk before is cleaned without its own context, which makes both modes a window and not a loop; ``clean_in_turn`` carries it in earnest.
    """
    if mode not in ("fast", "balanced", "max-coherence"):
        raise ValueError(f"unknown mode: {mode}")
    prompt = F.col("text")
    if mode != "fast":
        order = Window.partitionBy(key).orderBy("ordinal") if mode == "max-coherence" else Window.partitionBy(key,
            F.floor(F.col("ordinal") / 4)).orderBy("ordinal")
        # only the end of the answer travels with the chunk to its neighbour
        chunked = chunked.withColumn("_before", F.lag(F.substring(model(F.col("text")), -500, 500)).over(order))
        prompt = F.when(F.length("_before") > 0, F.concat(F.lit("[CONTEXT: This continues from: "), "_before", F.lit("]\n\n"), F.col("text"))).otherwise(prompt)
    answer = model(prompt)
    if most_chars is not None:
        answer = F.when(F.length(answer) <= most_chars,
            answer).otherwise(F.raise_error(F.lit("the model's answer exceeds the configured limit")).cast("string"))
    checked = chunked.withColumn("_v", X.validate(answer, F.length("text"), F.col("text")))
    return checked.withColumns({"clean_text": F.col("_v.text"), "warnings": F.col("_v.warnings")}).drop("_v", "_before")


def validated_text(answer: str) -> str:
    """The text that validation makes of an answer, on one text."""
    first = answer.strip()
    kept = first
    if re.search(X.ARTIFACTS, first):
        kept = "\n".join(line for line in first.split("\n") if not re.search(X.ARTIFACTS, line)).strip()
    return re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{4,}", "\n\n\n", kept))).strip()


def clean_in_turn(chunked: DataFrame, call: Callable[[str], str], mode: str = "max-coherence", key: str = "document_id",
    run: int = 4, carried: int = 500) -> DataFrame:
    """``clean`` with the answer before as context in earnest: each chunk is asked after the one before it was, with the last characters of that one's text.

    max-coherence carries through the document, balanced through runs of ``run`` chunks of those given (with a cache: of the misses). ``call`` runs in the workers. A document's
    chunks follow each other in one task; they are not gathered.
    """
    if mode not in ("balanced", "max-coherence"):
        raise ValueError(f"unknown mode: {mode}")
    at = F.row_number().over(Window.partitionBy(key).orderBy("ordinal")) - 1
    ready = chunked.withColumn("_run", F.floor(at / run).cast("int") if mode == "balanced" else F.lit(0)).withColumn("_answer", F.lit(None).cast("string"))
    names = ready.columns

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, before = None, ""
        for frame in frames:
            answers = []
            for k, r, text in zip(frame[key], frame["_run"], frame["text"]):
                before = before if (k, r) == last else ""
                last = (k, r)
                answers.append(call(f"[CONTEXT: This continues from: {before}]\n\n{text}" if before else text))
                before = validated_text(answers[-1])[-carried:]
            yield frame.assign(_answer=answers)[names]

    asked = ready.repartition(key).sortWithinPartitions(key, "_run", "ordinal").mapInPandas(ask, ready.schema)
    checked = asked.withColumn("_v", X.validate(F.col("_answer"), F.length("text"), F.col("text")))
    return checked.withColumns({"clean_text": F.col("_v.text"), "warnings": F.col("_v.warnings")}).drop("_v", "_run", "_answer")


_BLANK_LINES = re.compile(r"(\n\n+)")
_LEAD = re.compile(r"\s*([^.!?]+[.!?])\s*")
#: White space after a sentence's end; it begins with \s so that the search skips to white space.
_GAP = re.compile(r"(\s(?<=[.!?]\s)\s*)")


def _last_sentence(s: str) -> str:
    """The last match of ``[^.!?]+[.!?]`` in lower case, found from behind: a text without a sentence's end would be walked once from each of its characters."""
    mark = lambda end: max(s.rfind(".", 0, end), s.rfind("!", 0, end), s.rfind("?", 0, end))
    at = mark(len(s))
    while at > 0 and s[at - 1] in ".!?":
        at -= 1
    return s[mark(at) + 1 : at + 1].strip().lower() if at > 0 else ""


def drop_repeated_sentences(text: str) -> str:
    """Drop a sentence that repeats the one before it, across paragraphs too; structured parts lose only a leading one."""
    before, out = "", []
    for part in _BLANK_LINES.split(text):
        if not part or part[0] == "\n":
            out.append(part)
        elif "\n" in part or part.lstrip()[:1] == "#":
            lead = _LEAD.match(part) if before else None
            if lead and lead[1].strip().lower() == before:
                part = part[lead.end() :]
            out.append(part)
            before = _last_sentence(part) or before
        else:
            pieces = _GAP.split(part)
            if len(pieces) < 3:
                out.append(part)
                before = _last_sentence(part) or before
                continue
            kept = []
            for i in range(0, len(pieces), 2):
                key = pieces[i].strip().lower()
                if key and key == before:
                    continue
                kept += pieces[i : i + 2]
                before = key or before
            out.append("".join(kept).rstrip())
    return "".join(out)


def assemble_text(text: Column) -> Column:
    """The five repairs of joined chunks: context marks, artifact lines, repeated sentences, doubled headers, white space."""

    @F.arrow_udf("string")
    def dedupe(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else drop_repeated_sentences(t) for t in texts.to_pylist()], pa.string())

    return X.strip(X.tidy_lines(X.without_doubled_headers(dedupe(X.without_artifact_lines(X.without_context_markers(text))))))


def assemble(cleaned: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, text, warnings, n_chunks, failed_chunks) by document; one shuffle on the key."""
    parts = F.transform(F.array_sort(F.collect_list(F.when(X.strip(F.col("clean_text")) != "", F.struct("ordinal", "clean_text")))), lambda c: c["clean_text"])
    grouped = cleaned.groupBy(key).agg(F.array_join(parts, "\n\n").alias("_joined"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings"),
        F.count(F.lit(1)).alias("n_chunks"), F.count_if(X.strip(F.col("clean_text")) == "").alias("failed_chunks"))
    return grouped.select(key, assemble_text(F.col("_joined")).alias("text"), "warnings", "n_chunks", "failed_chunks")


def process(docs: DataFrame, policy: ChunkPolicy = ChunkPolicy(), key: str = "document_id", cache: DataFrame | None = None, **how) -> DataFrame:
    """Processed documents: text, warnings, chunk counts, code, label, summary. With a cache only misses are cleaned."""
    chunked = chunks(spread(docs.select(key, "text")), policy, key)
    if cache is None:
        cleaned = clean(chunked, key=key, **how)
    else:
        served = cache_hits(chunked, cache, key).withColumn("warnings", F.array().cast("array<string>"))
        todo = chunked.join(served.select("chunk_id"), "chunk_id", "left_anti")
        cleaned = served.unionByName(clean(todo, key=key, **how))
    return assemble(cleaned, key).withColumn("_c", X.classify(F.col("text"))).select("*", "_c.*").drop("_c")
