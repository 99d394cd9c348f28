"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import hashlib
import html
import math
import re
from pathlib import Path

import duckdb
import pytest

from folioflow.functions import text as X
from folioflow.operators import process, transcripts
from folioflow.plans import base, registry


def rows(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    plain = lambda v: "" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return names, sorted(tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, sql, name):
    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(sql.sql(registry.ORACLES[name]).df())


#: Queries that SQL can't express; each has a test below that reads every column of every row.
WITHOUT_SQL = {"chunks", "process_documents", "process_coherent", "search_snippets", "transcript_merge", "transcript_round_trip", "quote_fuzzy", "bundle_files"}


def test_what_has_no_sql_is_known():
    assert set(registry.QUERIES) - set(registry.ORACLES) == WITHOUT_SQL


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def naive_chunks(text: str, target: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Start and end of every chunk, position by position."""
    text, out, at = text.strip(), [], 0
    while at < len(text):
        end = at + target
        if end < len(text):
            for p in range(end, at + max(least, target // 2) - 1, -1):
                after_sentence = p > 0 and text[p - 1] in ".!?" and p < len(text) and text[p].isspace()
                blank = text[p : p + 2] == "\n\n"
                heading = text[p : p + 1] == "\n" and text[p + 1 :].lstrip("#") != text[p + 1 :] and 1 <= len(text[p + 1 :]) - len(text[p + 1 :].lstrip("#")) <= 6 and text[p + 1 :].lstrip("#")[:1].isspace()
                if p <= end and (after_sentence or blank or heading):
                    end = p
                    break
        end = min(end, len(text))
        piece = text[at:end]
        if piece.strip():
            first = at + len(piece) - len(piece.lstrip())
            out.append((first, first + len(piece.strip())))
        if end >= len(text):
            return out
        at = end - overlap if end - overlap > at else end
        while at < len(text) and text[at].isspace():
            at += 1
    return out


def test_chunks_equal_a_naive_walk(spark, sf_dir, docs):
    got: dict = {}
    for r in registry.QUERIES["chunks"](spark, sf_dir).collect():
        body = docs[r["document_id"]]["text"].strip()
        assert r["text"] == body[r["start_char"] : r["end_char"]] and r["sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
        own = hashlib.sha256(f"{r['document_id']}:{r['ordinal']}:{r['sha256']}".encode()).hexdigest()
        assert r["chunk_id"] == "chk_" + own[:16]
        got.setdefault(r["document_id"], []).append((r["ordinal"], r["start_char"], r["end_char"]))
    for i, r in docs.items():
        assert [(a, b) for _, a, b in sorted(got.get(i, []))] == naive_chunks(r["text"], 1000, 100, 200), i


def naive_clean(text: str) -> str:
    return re.sub(r"^\n+|\n+$", "", "\n".join(" ".join(line.split()) for line in re.split(r"\r\n|[\n\r]", text)))


def test_processed_documents_equal_a_plain_pipeline(spark, sf_dir, docs):
    got = {r["document_id"]: r for r in registry.QUERIES["process_documents"](spark, sf_dir).collect()}
    for i, r in docs.items():
        body = r["text"].strip()
        parts = [process.validated_text(naive_clean(body[a:b])) for a, b in naive_chunks(r["text"], 1000, 100, 200)]
        if not parts:
            assert i not in got
            continue
        assert got[i]["n_chunks"] == len(parts) and got[i]["failed_chunks"] == sum(not p for p in parts)
        text = process.drop_repeated_sentences("\n".join(line for line in "\n\n".join(p for p in parts if p).split("\n") if not re.search(X.ARTIFACTS, line)))
        text = re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{4,}", "\n\n\n", text))).strip()
        assert got[i]["summary"] == (text[:500].strip() or "No summary available."), i
    coherent = registry.QUERIES["process_coherent"](spark, sf_dir).collect()
    assert {r["document_id"] for r in coherent} == set(got) and all(r["n_chunks"] == got[r["document_id"]]["n_chunks"] for r in coherent)


def test_snippets_show_the_query(spark, sf_dir, docs):
    page = registry.QUERIES["search_snippets"](spark, sf_dir).collect()
    assert len(page) == 20 or len(page) > 5
    for r in page:
        bare = html.unescape(re.sub(r"</?mark>", "", r["snippet"])).removeprefix("...").removesuffix("...")
        assert bare in docs[r["document_id"]]["text"] and re.search(r"<mark>(tion|ther)</mark>", r["snippet"], re.I)
        assert len(re.findall(r"[^\W_]+", bare)) <= 16


@pytest.fixture(scope="module")
def talks(spark, sf_dir):
    out: dict = {}
    for r in base.segments(spark, sf_dir).orderBy("document_id", "seg").collect():
        out.setdefault(r["document_id"], []).append({c: r[c] for c in ("text", "start_seconds", "duration_seconds", "speaker")})
    return out


def test_transcript_queries(spark, sf_dir, talks):
    said = lambda rows: {k: [r["text"] for r in v] for k, v in rows.items()}
    merged: dict = {}
    for r in registry.QUERIES["transcript_merge"](spark, sf_dir).collect():
        merged.setdefault(r["document_id"], []).append(r.asDict())
    squeeze = lambda s: re.sub(r"\s+([,.;:!?])", r"\1", " ".join(s.split()))
    for k, segments in talks.items():
        assert squeeze(" ".join(said(merged)[k])) == squeeze(" ".join(s["text"] for s in segments))
        assert all(a["start_seconds"] <= b["start_seconds"] for a, b in zip(merged[k], merged[k][1:]))
        speakers = [s["speaker"] for s in segments]
        assert len(merged[k]) >= 1 + sum(a != b for a, b in zip(speakers, speakers[1:]))
    back: dict = {}
    for r in registry.QUERIES["transcript_round_trip"](spark, sf_dir).collect():
        back.setdefault(r["document_id"], []).append((r["speaker"], r["start_seconds"]))
    assert all([(s["speaker"], s["start_seconds"]) for s in v] == back[k] for k, v in talks.items() if all(s["text"].strip() and "\n" not in s["text"].strip() for s in v))
    for r in registry.QUERIES["quote_fuzzy"](spark, sf_dir).collect():
        segments = talks[r["document_id"]]
        text = (segments[1] if len(segments) > 1 else segments[0])["text"]
        want = transcripts.find_quote(segments, text[3:] + " " + text[:3], 0.6)
        assert (r["start_segment_index"], r["strategy"], r["confidence"]) == ((want["start_segment_index"], want["strategy"], want["confidence"]) if want else (None, None, None))


def test_bundle_files_hold_together(spark, sf_dir, docs):
    files = registry.QUERIES["bundle_files"](spark, sf_dir).collect()
    held = {r["path"]: r["content"] for r in files}
    assert len(held) == len(files) and "index.md" in held
    concepts = {p for p in held if not p.endswith("index.md")}
    assert len(concepts) == len(docs)
    linked = set()
    for path, content in held.items():
        if path not in concepts:
            found = re.findall(r"\]\(/([^)]+)\)", content)
            assert set(found) <= set(held), path
            linked |= set(found)
            counted = [int(n) for n in re.findall(r"(\d+) concept\(s\)", content)]
            folders = re.findall(r"\]\(/([^)]+)/index\.md\)", content)
            assert counted == [sum(p.startswith(f + "/") for p in concepts) for f in folders]
        else:
            assert content.startswith("---\ntype: ") and content.endswith("\n")
    assert concepts <= linked


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_contract(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns[0] == "document_id"


def test_the_library_does_not_import_llm():
    root = Path(registry.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert "llm import" not in p.read_text() and "from .llm" not in p.read_text(), p
