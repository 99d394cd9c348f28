from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import decontaminate

from .helpers import EDGES, docs_of, prose, words


def brute(rows, items, least):
    out = set()
    for i, t in rows:
        w = words(t)
        for k, text in items:
            q = words(text)
            if len(q) < decontaminate.LEAST_WORDS:
                continue
            need, best = min(least, len(q)), None
            for p in range(len(q)):
                for s in range(len(w)):
                    n = 0
                    while p + n < len(q) and s + n < len(w) and q[p + n] == w[s + n]:
                        n += 1
                    if n >= need and (best is None or (-n, p, s) < best):
                        best = (-n, p, s)
            if best:
                out.add((i, k, best[2], best[1], -best[0]))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randrange(5, 40), 60)) for k in range(8)] + [(8, "too short"), (9, None), (10, ""), (11, "w3"), (12, "x x x")]
    rows = [(i, prose(rng, rng.randrange(1, 60), 60)) for i in range(25)]
    for i in range(12):
        q = words(items[i % 8][1])
        a = rng.randrange(max(1, len(q) - 8))
        rows.append((100 + i, f"{prose(rng, 10)}, {' - '.join(q[a:]).upper()}! {prose(rng, 4)}"))
    rows += [e for e in EDGES if e[0] != 7094] + [(7094, "x " * 300)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for part, scan in ((10, 60), (10, 10**6), (10**6, 10**6)):
        got = {tuple(r) for r in decontaminate.matches(docs_of(spark, rows), bench, min_words=8, part_words=part, scan_words=scan).collect()}
        assert got == brute(rows, items, 8) and len(got) > 8


def test_affected_documents_go(spark):
    text = " ".join(f"a{i}" for i in range(20))
    docs = docs_of(spark, [(1, "x " + text + " y"), (1, "clean twin"), (2, "clean"), (None, text), *EDGES]).withColumn("item_id", F.lit(3))
    bench = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    out = decontaminate.remove_affected(docs, bench)
    assert out.columns == docs.columns and out.where("doc_id = 1").isEmpty() and out.where("doc_id IS NULL").count() == 2 and out.where("doc_id = 2").count() == 1
    assert decontaminate.matches(docs, bench.where("false")).isEmpty() and decontaminate.matches(docs.where("false"), bench).isEmpty()


def test_suffix_array():
    text = np.random.default_rng(1).integers(2, 5, 300).astype(np.uint32)
    order = decontaminate.suffix_array(text, 300)
    assert [tuple(text[i:]) for i in order] == sorted(tuple(text[i:]) for i in range(300))


def test_items_without_an_id_match(spark):
    one, two = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    docs = docs_of(spark, [(1, "x " + one + " y"), (2, "x " + two), (3, "clean"), (4, one)])
    bench = spark.createDataFrame([(None, one), (None, two), (None, None), (7, one)], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"] or 0, r["n_words"]) for r in decontaminate.matches(docs, bench).collect())
    assert got == [(1, 0, 20), (1, 7, 20), (2, 0, 20), (4, 0, 20), (4, 7, 20)]
    assert [r["doc_id"] for r in decontaminate.remove_affected(docs, bench.where("item_id IS NULL")).collect()] == [3]


def test_a_passage_that_fills_the_text_is_found_once(spark):
    docs = docs_of(spark, [(1, "x " * 200_000), (2, "y " + "x " * 40 + "z")]).withColumns({c: F.lit("mine") for c in ("_hit", "item_id", "n_words")})
    bench = spark.createDataFrame([(5, "x " * 300), (6, "x " * 20)], "item_id bigint, text string")
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == [(1, 5, 0, 0, 300), (1, 6, 0, 0, 20), (2, 5, 1, 0, 40), (2, 6, 1, 0, 20)]
    assert decontaminate.remove_affected(docs, bench).columns == docs.columns and decontaminate.remove_affected(docs, bench).isEmpty()


def test_pairs_are_extended_in_pieces():
    text = np.array([2, 3, 4, 5, 1, 3, 4, 5, 6, 1, 2, 3, 4, 1], np.uint32)
    q = decontaminate.Queries([(1, np.array([2, 3, 4, 5, 6], np.uint32))], 2, 1)
    order = decontaminate.suffix_array(text, 5)
    all_of = lambda pairs: sorted((int(q.start[a]), int(b), int(n)) for x in decontaminate.search(text, order, q, pairs) for a, b, n in zip(*x))
    assert all_of(1) == all_of(100) == [(0, 0, 4), (0, 10, 3), (1, 5, 4)]
