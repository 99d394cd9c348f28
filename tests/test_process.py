from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import process as P


def value(spark, column, **cells):
    """A column's value over one row of the given cells."""
    ddl = ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in (cells or {"x": "1"}).items())
    return spark.createDataFrame([tuple((cells or {"x": "1"}).values())], ddl).select(column.alias("v")).first()["v"]


@given(st.text(alphabet="ab. \n", max_size=400), st.integers(20, 80), st.integers(0, 15), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text(text, target, overlap, least):
    parts = P.split_text(text, P.ChunkPolicy(target, overlap, least))
    body = text.strip()
    assert [c["ordinal"] for c in parts] == list(range(len(parts)))
    seen = set()
    for c in parts:
        assert body[c["start_char"] : c["end_char"]] == c["text"] and len(c["text"]) <= target
        seen |= set(range(c["start_char"], c["end_char"]))
    assert all(i in seen or body[i].isspace() for i in range(len(body)))


def test_chunks_are_deterministic_and_blank_has_none(spark):
    text = "\n\n".join(f"Paragraph {i}. This is source text." for i in range(100))
    docs = spark.createDataFrame([("d", text), ("e", "  \n"), ("f", None)], "document_id string, text string")
    a, b = (P.chunks(docs, P.ChunkPolicy(500, 50, 100)).orderBy("ordinal").collect() for _ in range(2))
    assert a == b and len(a) > 1 and {r["document_id"] for r in a} == {"d"}
    for bad in ((0, 0, 0), (10, 10, 0), (10, 0, -1)):
        with pytest.raises(ValueError):
            P.ChunkPolicy(*bad)


@pytest.mark.parametrize(
    "raw, source, text, warnings",
    [
        ("", "", "", ["empty-output"]),
        (None, "", "", ["empty-output"]),
        ("As an AI language model I can't", "x", "", ["artifact-filtered", "empty-after-artifact-filter"]),
        ("Kept.\nPlease provide your transcript", "x", "Kept.", ["artifact-filtered"]),
        ("short", "y" * 200, "short", ["suspiciously-short-output"]),
        ("a [Next context] b", "x", "a [Next context] b", ["context-marker-leak"]),
        ("text\n- ", "x", "text\n-", ["orphan-list-marker"]),
        ("| a | b |\n| c | d |", "x", "| a | b |\n| c | d |", ["malformed-markdown-table"]),
        ("the end is near " * 10, "x", ("the end is near " * 10).strip(), ["repeated-tail"]),
        ("-" * 300, "x", "-" * 300, []),
        ("plain", "# Head\n- item\n[1]", "plain", ["missing-markdown-heading", "missing-markdown-list", "missing-citation-marker"]),
        ("a\n\n\n\n\n\nb", "x", "a\n\n\nb", []),
    ],
)
def test_validation(spark, raw, source, text, warnings):
    got = value(spark, X.validate(F.col("raw"), F.length("source"), F.col("source")), raw=raw, source=source)
    assert (got["text"], got["warnings"]) == (text, warnings)


def test_repeated_tail_of_another_period(spark):
    assert value(spark, X.has_repeated_tail(F.col("t")), t="lead in " + "one two three four " * 9)
    assert not value(spark, X.has_repeated_tail(F.col("t")), t="lead in " + "one two three four " * 5)


def test_assembly_repairs(spark):
    chunks = spark.createDataFrame([("d", 1, "Same here. New line.", ["b"]), ("d", 0, "First one. Same here.", ["a", "b"]), ("d", 2, " ", []), ("e", 0, "# Top  # Top\n[CONTEXT: This continues from: x]\nbody", [])], "document_id string, ordinal int, clean_text string, warnings array<string>")
    got = {r["document_id"]: r for r in P.assemble(chunks).collect()}
    assert got["d"]["text"] == "First one. Same here.\n\nNew line."
    assert (got["d"]["warnings"], got["d"]["n_chunks"], got["d"]["failed_chunks"]) == (["a", "b"], 3, 1)
    assert got["e"]["text"] == "# Top\nbody"


def test_process_serves_the_cache(spark):
    docs = spark.createDataFrame([("d", "hello   sadd1e"), ("e", "other text")], "document_id string, text string")
    sha = docs.where("document_id = 'e'").select(F.sha2("text", 256)).first()[0]
    cache = spark.createDataFrame([(sha, "served horse")], "chunk_sha256 string, text string")
    got = {r["document_id"]: (r["text"], r["code"]) for r in P.process(docs, cache=cache).collect()}
    assert got == {"d": ("hello Saddle", "000"), "e": ("served horse", "636.1")}
    with pytest.raises(ValueError):
        P.clean(P.chunks(docs), mode="slow")


def test_modes_carry_context(spark):
    docs = spark.createDataFrame([("d", "One sentence here. " * 40)], "document_id string, text string")
    chunked = P.chunks(docs, P.ChunkPolicy(100, 0, 10))
    leaks = lambda mode: [("context-marker-leak" in r["warnings"]) for r in P.clean(chunked, mode=mode).orderBy("ordinal").collect()]
    fast, balanced, coherent = leaks("fast"), leaks("balanced"), leaks("max-coherence")
    assert not any(fast) and [i for i, x in enumerate(balanced) if not x] == list(range(0, len(fast), 4)) and coherent == [False] + [True] * (len(fast) - 1)


def test_ingest_dedupes_content(spark):
    files = spark.createDataFrame([("b/x.md", bytearray(b"same")), ("a/y.txt", bytearray(b"same")), ("c.bin", bytearray(b"other"))], "source_path string, content binary")
    got = {r["source_path"]: (r["media_type"], r["duplicate"]) for r in P.ingest(files, P.ingest(files.where("source_path = 'c.bin'"))).collect()}
    assert got == {"a/y.txt": ("text/plain", False), "c.bin": ("application/octet-stream", True)}


@pytest.mark.parametrize("text, want", [("Q2 2026", "2026-Q2"), ("2026-07", "2026-07"), ("H1 2024 review", "2024-H1"), ("mayor 2020", "2020-05"), ("soon", "soon"), ("", None), (None, None), ("in 1999", "1999")])
def test_period(spark, text, want):
    assert value(spark, X.period(F.col("t")), t=text) == want


@pytest.mark.parametrize("name, want", [("CBRE_Dallas_Office_MarketView_2026-06.pdf", "cbre-dallas-office-marketview"), ("CBRE_Dallas_Office_MarketView_2026-07.pdf", "cbre-dallas-office-marketview"), ("report.pdf", None), ("scan_copy.pdf", None)])
def test_series_of_a_file(spark, name, want):
    assert value(spark, X.series_key(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("n")), n=name) == want


def test_text_functions(spark):
    assert value(spark, X.redact(F.col("t")), t='password=abc "token": "x y" Authorization: Bearer zz sk-12345678') == 'password=[REDACTED] "token": "[REDACTED]" Authorization: Bearer [REDACTED] [REDACTED]'
    assert value(spark, X.html_to_text(F.col("t")), t="<head><title>x</title></head><h1>A &amp; B</h1><script>no()</script><p>one<br>two</p><!-- c -->") == "A & B\none\ntwo"
    assert value(spark, X.clean_tags(F.col("t")), t=[" A  b", "a b", "", "C"]) == ["a b", "c"]
    assert value(spark, X.seconds_of(F.col("t")), t="1:02:03,5") == 3723.5 and value(spark, X.seconds_of(F.col("t")), t="x") is None
    assert value(spark, X.srt_time(F.col("s")), s=3661.5) == "01:01:01,500" and value(spark, X.compact_time(F.col("s")), s=59.9) == "00:59"
    assert value(spark, X.first_sentence(F.col("t")), t="One  two. Three.") == "One two."
    assert value(spark, X.yaml_quote(F.col("t")), t='a"b\\c\n') == '"a\\"b\\\\c "'
    assert value(spark, X.api_error_code(F.lit(404), F.col("t")), t="Run not found") == "not_found"
    assert value(spark, X.parse_payload(F.col("t")), t="nothing") is None
    assert value(spark, X.parse_payload(F.col("t"))["dewey_code"], t='x {"dewey_code": "610", "summary": "s", "category_name": "c"} y') == "610"
    assert value(spark, X.parse_payload(F.col("t")), t='x {"dewey_code": "610"} y') is None  # three fields are required
    assert value(spark, X.export_stem(F.lit("610"), F.col("t"), F.lit("f.txt")), t="A/B: c" * 60)[:9] == "610 A B c"
