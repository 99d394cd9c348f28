"""What the third round changed: gates before patterns, and walks whose time grows with the text only."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions.data import KEYWORDS
from folioflow.operators import process

_SENTENCE = re.compile(r"[^.!?]+[.!?]")
_BREAK = re.compile(r"(?<=[!?.])\s+|\n(?:\n+|(?=\#{1,6}\s))")


def test_a_text_without_sentence_ends_is_walked_once():
    text = "word after word " * 10_000
    began = time.perf_counter()
    assert process.drop_repeated_sentences(text + "\n" + text) == text + "\n" + text
    assert time.perf_counter() - began < 5  # walked once from each character, 20,000 characters took 7 seconds


def test_walks_from_behind_find_what_walks_from_the_front_do():
    draw = random.Random(3)
    for _ in range(5_000):
        text = "".join(draw.choice(("a", "b.", " ", "\n", "\n\n", "# ", "! ", "?", ".", "x" * 90, "A. ")) for _ in range(draw.randint(0, 30)))
        found = _SENTENCE.findall(text)
        assert process._last_sentence(text) == (found[-1].strip().lower() if found else ""), repr(text)
        first, end = draw.randint(0, 20), min(draw.randint(20, 900), len(text))
        places = [m.start() for m in _BREAK.finditer(text, first, end + 1)]
        assert process._last_break(text, first, end) == (places[-1] if places else None), repr(text)


def test_white_space_is_what_the_pattern_says(spark):
    one = spark.range(1, 0x110000).where("id < 55296 OR id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    found = {r["id"] for r in one.where(F.col("c").rlike(r"(?U)^\s\z")).collect()}
    assert found == set(map(ord, X.WHITE))


@pytest.fixture(scope="module")
def odd(spark):
    """Texts of all that the gates and the patterns look at."""
    draw = random.Random(4)
    parts = ("a", "B", "é", "ok. ", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\r", "\x0b", "\xa0", " ", "’", "　", "\x1c", "# H\n", "# H  # H\n", "- ", "1. ", "| a | b |\n", "|---|---|\n", "[1]", "(Doe, 1999)", "[Next context]",
        "Sadd1e", "SADD1E", "sadd1es", "Canter Transit10ns", "chain-of-CUST0DY", "\n\n\n\n\n", " \n", "\n\t", "As an AI language model", "as a language model", "AS AN ai", "THERE IS NO TEXT TO", "I cannot SEE", "i'm READY to begin", "please provide the transcript",
        "here is the cleaned text", "INPUT was BLANK", "text provided is empty", "[Omitted long matching line]", "[THE assistant's response would]", "I don't have ACCESS to", "I'm ready to edit", "a horsehair", "Novels", "DOCTOR", "algorithms", "the end is near " * 9, "no. no. " * 14, "x1y " * 30)
    rows = [("".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) + draw.choice(("", "", "the end is near " * 9, "one two\nthree four. " * 8)),) for _ in range(3000)]
    return spark.createDataFrame([*rows, *((p,) for p in parts), ("",), (None,)], "t string").repartition(4).cache()


def _plain_tail(c):
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"(?U)^\s+|\s+$", ""), -1920, 1920)


def test_gates_change_no_result(spark, odd):
    t, sub = F.col("t"), F.regexp_replace
    strip = lambda c: sub(c, r"(?U)^\s+|\s+$", "")
    squeeze = lambda c: strip(sub(c, r"(?U)\s+", " "))
    line = lambda x: sub(sub(sub(squeeze(x), r"(?i)\bsadd1e\b", "Saddle"), r"(?i)\bcanter transit10ns\b", "canter transitions"), r"(?i)\bchain-of-cust0dy\b", "chain-of-custody")
    rule = F.when(F.lit(False), "")
    for code, terms in KEYWORDS:
        rule = rule.when(F.lower(t).rlike("|".join(terms)), code)
    pairs = {
        "strip": (X.strip(t), strip(t)),
        "mock_clean": (X.mock_clean(t), sub(F.array_join(F.transform(F.split(t, r"\r\n|[\n\r]"), line), "\n"), r"^\n+|\n+$", "")),
        "tidy": (X.tidy_lines(t), sub(sub(sub(t, r"\n{4,}", "\n\n\n"), r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n")),
        "artifact": (X.has_artifact(t), t.rlike(X.ARTIFACTS)),
        "lines": (X.without_artifact_lines(t), F.array_join(F.filter(F.split(t, "\n"), lambda x: ~x.rlike(X.ARTIFACTS)), "\n")),
        "headers": (X.without_doubled_headers(t), sub(t, r"(#{1,6}\s+[^\n]+)\s+\1", "$1")),
        "code": (X.classify(t)["code"], rule.otherwise("000")),
        "table": (X.has_table(t), (F.regexp_count(t, F.lit(X.TABLE_ROW)) >= 2) & t.rlike(X.TABLE_RULE)),
    }
    got = odd.select("t", *(F.struct(a.alias("a"), b.alias("b")).alias(n) for n, (a, b) in pairs.items())).collect()
    for n in pairs:
        assert [(r["t"], r[n]["a"]) for r in got] == [(r["t"], r[n]["b"]) for r in got], n
        assert len({r[n]["b"] for r in got}) > 2, n
    tails = odd.select(X.has_repeated_tail(t).alias("got"), _plain_tail(t).alias("flat")).where("flat IS NOT NULL").collect()
    for r in tails:
        flat = r["flat"]
        want = any(flat.endswith(flat[-k:] * 8) and len(set(re.sub(r"[^\w]", "", flat[-k:]))) >= 2 for k in range(12, min(240, len(flat) // 8) + 1))
        assert r["got"] == want, flat
    assert len({r["got"] for r in tails}) == 2


def test_collapsed_paragraphs_are_still_told(spark):
    source = "One. \n \nTwo.\n\nThree."
    rows = [("word " * 120, source), ("word " * 120 + "\n\nx", source), ("word " * 120, "One.\n\nTwo."), ("word " * 120 + "\n \nx", source)]
    df = spark.createDataFrame(rows, "raw string, source string")
    got = [("collapsed-paragraphs" in r["v"]["warnings"]) for r in df.select(X.validate(F.col("raw"), F.length("source"), F.col("source")).alias("v")).collect()]
    assert got == [True, False, False, False]


def test_texts_travel_by_document_only(spark, sf_dir):
    from folioflow.plans import registry

    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    told = registry.QUERIES["bundle_files"](spark, sf_dir)._jdf.queryExecution().explainString(mode)
    moved = re.findall(r"\) (?:Exchange|Sort|Window)\b[^\n]*\nInput \[\d+\]: \[([^\n]*)\]\nArguments: ([^\n]*)", told)
    assert len(moved) > 10
    assert not [how for what, how in moved if re.search(r"\btext#", what) and "document_id#" not in how.split(",")[0]]


def test_links_of_large_groups_are_the_same(spark, sf_dir, monkeypatch):
    from folioflow.operators import export
    from folioflow.plans import registry, text_plans

    shown = lambda: sorted(map(str, registry.QUERIES["bundle_links"](spark, sf_dir).collect()))
    want = shown()
    files = sorted(map(str, registry.QUERIES["bundle_files"](spark, sf_dir).collect()))
    for most in (0, 11):  # all groups are large, some are
        monkeypatch.setattr(export, "LARGE_GROUP", most)
        assert shown() == want
    assert sorted(map(str, registry.QUERIES["bundle_files"](spark, sf_dir).collect())) == files
    part = text_plans._sources(spark, sf_dir).withColumn("series_key", F.when(F.col("document_id") % 2 == 0, F.col("series_key")))
    for r in export.linked(export.concepts(part)).collect():
        assert bool(r["editions"]) <= (r["document_id"] % 2 == 0) and len(r["related"]) == 12
