from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from folioflow.operators import search as S

DAY = dt.datetime(2024, 1, 1)


def library(spark, texts: dict[str, str]):
    rows = [(n, n, t, DAY + dt.timedelta(days=i), "ready") for i, (n, t) in enumerate(texts.items())]
    docs = spark.createDataFrame(rows, "document_id string, filename string, text string, created_at timestamp_ntz, status string")
    return docs, S.Index.build(docs, ["document_id"])


def found(spark, texts, query, **how):
    docs, index = library(spark, texts)
    return [r["document_id"] for r in S.search(index, query, docs, **how).collect()]


@pytest.mark.parametrize(
    "query, phrase, want",
    [
        ('"follow-up care" horse?!', False, '"follow up care" AND horse'),
        ("follow-up care", False, "((follow AND up) OR followup) AND care"),
        ("Children's hospital", False, "children AND hospital"),
        ('one "two three', False, "one AND two AND three"),
        ("a b", True, '"a b"'),
        ("foo_bar", False, '"foo bar"'),
    ],
)
def test_query_is_parsed(query, phrase, want):
    assert S.render(S.parse_query(query, phrase)) == want


@pytest.mark.parametrize("query", ['"', "", "?!", "x" * 4097])
def test_bad_query_is_refused(query):
    with pytest.raises(ValueError):
        S.parse_query(query)


CARE = {"phrase.txt": "Follow-up care checklist for discharge.", "reordered.txt": "Care plans should follow up after discharge.", "compact.txt": "Followup care checklist for discharge."}


def test_compounds_match_broadly_and_phrases_exactly(spark):
    assert sorted(found(spark, CARE, "follow-up care")) == sorted(CARE)
    assert found(spark, CARE, "follow-up care", phrase=True) == ["phrase.txt"]
    assert found(spark, CARE, '"follow-up care"') == ["phrase.txt"]


def test_possessive(spark):
    texts = {"a": "Children hospital opens", "b": "Children's hospital opens", "c": "nothing"}
    assert sorted(found(spark, texts, "children's hospital")) == ["a", "b"]


def test_score_is_bm25(spark):
    texts = {"a": "horse horse cart", "b": "horse", "c": "cart cart cart cart", "d": "mill", "e": "mill"}
    docs, index = library(spark, texts)
    got = {r["document_id"]: r["score"] for r in index.scored(S.parse_query("horse")).collect()}
    n = {k: len(v.split()) for k, v in texts.items()}
    avg = sum(n.values()) / 5
    idf = math.log((5 - 2 + 0.5) / 2.5)
    want = {k: -idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n[k] / avg)) for k, f in (("a", 2), ("b", 1))}
    assert got == pytest.approx(want)


def test_overlapping_phrase_occurrences_count(spark):
    _, index = library(spark, {"a": "care care care", "b": "care"})
    assert [r["f_0"] for r in index.matches(S.parse_query("care care", True)).where("_hit").collect()] == [2]


def test_page_order_ties_and_date_window(spark):
    docs, index = library(spark, {"old": "horse", "new": "horse", "x": "mill", "y": "mill", "z": "mill"})
    page = lambda **how: [r["document_id"] for r in S.search(index, "horse", docs, **how).collect()]
    assert page() == ["new", "old"] and page(limit=1, offset=1) == ["old"]
    assert page(filters=S.Filters(created_after=DAY + dt.timedelta(hours=23), created_before=DAY + dt.timedelta(hours=25))) == ["new"]
    with pytest.raises(ValueError):
        S.Filters(created_after=DAY, created_before=DAY - dt.timedelta(1))
    with pytest.raises(ValueError):
        S.search(index, "horse", docs, limit=0)


def test_facets_cap_names_but_not_the_total(spark):
    docs, index = library(spark, {f"facet-{i}.txt": "horse" for i in range(3)})
    classes = spark.createDataFrame([("facet-0.txt", "636.1", "Horses")], "document_id string, code string, label string")
    rows = S.facets(index, "horse", docs, classes, facet_limit=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r["facet"], []).append((r["value"], r["count"]))
    assert by["total"] == [("", 3)] and sorted(by["filename"]) == [("facet-0.txt", 1), ("facet-1.txt", 1)]
    assert sorted(by["classification"]) == [("", 2), ("636.1", 1)] and by["status"] == [("ready", 3)]


def test_snippet_is_escaped_and_marked(spark):
    docs, _ = library(spark, {"a": "<script>alert(1)</script> horse <mark>not trusted</mark>"})
    got = S.snippets(docs.select("document_id"), docs, "script horse").first()["snippet"]
    assert "<mark>horse</mark>" in got and "<script>" not in got and "&lt;mark&gt;not trusted" in got


def test_like_wildcards_are_literal(spark):
    df = spark.createDataFrame([("50%",), ("500",), ("a_b",), ("axb",), ("~",)], "v string")
    hits = lambda needle: sorted(r["v"] for r in df.where(S.like(F.col("v"), needle)).collect())
    assert hits("0%") == ["50%"] and hits("A_b") == ["a_b"] and hits("~") == ["~"]


def test_versions_follow_the_two_latest_rules(spark):
    outputs = spark.createDataFrame([("d", "r1", 1), ("d", "r2", 2), ("e", "r3", 1), ("e", "r4", 1)], "document_id string, run_id string, created_at int")
    runs = spark.createDataFrame([("r1", "succeeded"), ("r2", "failed"), ("r3", "succeeded"), ("r4", "succeeded")], "run_id string, status string")
    ids = lambda df: sorted(r["run_id"] for r in df.collect())
    assert ids(S.latest_outputs(outputs, runs)) == ["r3", "r4"] and ids(S.latest_succeeded(outputs, runs)) == ["r1", "r4"]


def test_index_updates_deletes_and_round_trips(spark, tmp_path):
    docs, index = library(spark, {"a": "horse", "b": "mill", "c": "", "d": "cart"})
    new = spark.createDataFrame([("b", "horse horse")], "document_id string, text string")
    after = index.updated(new).without(spark.createDataFrame([("a",)], "document_id string"))
    after.write(str(tmp_path), 2)
    again = S.Index.read(spark, str(tmp_path), ["document_id"])
    assert [r["document_id"] for r in again.matches(S.parse_query("horse")).where("_hit").collect()] == ["b"]
    assert again.sizes.count() == 3


def test_quotes_in_texts(spark):
    docs = spark.createDataFrame([(1, "Said: The quick brown fox jumps over!"), (2, "nothing"), (3, None), (4, "")], "id int, text string")
    quotes = spark.createDataFrame([(1, "the QUICK brown fox jumps"), (2, "nothing"), (3, ""), (4, None), (5, "ick brown fox jumps ov")], "q int, text string")
    assert sorted(map(tuple, S.quotes_in(docs, quotes, "id", "q").collect())) == [(1, 1, 7), (2, 2, 1), (5, 1, 13)]
    assert S.quote_of_query('a "bc d" "e"') == "bc d"
