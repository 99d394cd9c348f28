from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import mixing, sharding

from .helpers import EDGES, docs_of


def test_slots_are_balanced_and_stable(spark):
    docs = docs_of(spark, [(i, "a" * (i * 7 % 900)) for i in range(3000)] + EDGES)
    out = sharding.shard_documents(docs.withColumns({"slot": F.lit("mine"), "shard": F.lit(1)}), 256, 8)
    assert out.count() == 3000 + len(EDGES) and {"slot", "shard", "map_version", "text"} <= set(out.columns)
    # one shard a slot; the same slot whatever else is in the table
    assert out.groupBy("slot").agg(F.count_distinct("shard").alias("n")).where("n > 1").isEmpty()
    one = {r["doc_id"]: r["slot"] for r in out.where("doc_id = 7").collect()}
    assert one == {7: docs.where("doc_id = 7").select(sharding.slot_of(F.col("doc_id"), 256)).first()[0]}


def test_rebalancing_evens_the_load_and_edits_the_map(spark):
    rng = np.random.default_rng(0)
    loads = spark.createDataFrame([(s, int(x)) for s, x in enumerate(rng.pareto(2, 512) * 1000)], "slot int, bytes bigint")
    first = sharding.initial_map(spark, 512, 8)
    edits = sharding.rebalance(first, loads, 2, 8)
    both = first.unionByName(edits)
    held = lambda v: [r["b"] for r in sharding.current(both, v).join(loads, "slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert max(held(2)) < max(held(1)) and max(held(2)) / (sum(held(2)) / 8) < 1.25
    assert held(None) and sum(held(1)) == sum(held(2)) and edits.count() < 512


def test_empty_corpus_keeps_the_first_map(spark):
    empty = docs_of(spark, [])
    assert sharding.shard_documents(empty, 16, 4).isEmpty()
    m = sharding.current(sharding.plan(empty, sharding.new_map_path(spark), 16, 4))
    assert m.where("shard <> slot % 4 OR map_version <> 1").isEmpty() and m.count() == 16


def test_a_second_corpus_edits_the_stored_map(spark, tmp_path):
    path = str(tmp_path / "map")
    one = docs_of(spark, [(i, "a" * (20000 if i < 30 else i * 7 % 900)) for i in range(2000)])
    two = one.unionByName(docs_of(spark, [(5000 + i, "b" * 30000) for i in range(25)]))
    held = lambda v=None: {r["slot"]: r["shard"] for r in sharding.current(sharding.load_map(spark, path, v)).collect()}
    placed = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(one, 128, 4, map_path=path).collect()}
    after_one, known = held(), sharding.versions(spark, path)
    again = {r["doc_id"]: (r["shard"], r["map_version"]) for r in sharding.shard_documents(two, 128, 4, map_path=path).collect()}
    last = sharding.versions(spark, path)
    assert known == [1, 2] and last == [1, 2, 3]
    moved = {s for s in after_one if held()[s] != after_one[s]}
    assert 0 < len(moved) < 64 and held(2) == after_one and held(1) == {s: s % 4 for s in range(128)}
    # documents of slots that stayed are where they were, under the version that put them there
    slots = {r["doc_id"]: r["slot"] for r in sharding.assign(one, sharding.load_map(spark, path), 128).collect()}
    assert all(again[i][0] == placed[i] and again[i][1] < 3 for i in placed if slots[i] not in moved)
    sharding.shard_documents(two, 128, 4, map_path=path)
    assert sharding.versions(spark, path)[:3] == [1, 2, 3] and len(sharding.versions(spark, path)) < 5
    last = sharding.versions(spark, path)[-1]
    edits = sharding.initial_map(spark, 128, 4).withColumn("version", F.lit(last))
    for bad in (edits, edits.withColumn("version", F.lit(9)), edits.unionByName(edits).withColumn("version", F.lit(last + 1))):
        with pytest.raises(ValueError):
            sharding.save_edits(bad, path)
    with pytest.raises(ValueError):
        sharding.load_map(spark, path, 8)
    with pytest.raises(ValueError):
        sharding.shard_documents(one, 64, 4, map_path=path)


def test_records_without_a_key_spread_by_their_text(spark):
    docs = docs_of(spark, [(None, f"text {i}") for i in range(400)] + [(None, None), (None, ""), (3, None)])
    out = sharding.shard_documents(docs, 64, 8)
    assert out.count() == 403 and out.groupBy("slot").count().agg(F.max("count")).first()[0] < 30


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(2)
    codes = [np.repeat(np.arange(3), 20), np.tile(np.repeat(np.arange(4), 5), 3), np.tile(np.arange(5), 12)]
    targets = [rng.dirichlet(np.ones(n) * 5) for n in (3, 4, 5)]
    tokens = rng.uniform(1, 100, 60)
    drawn = tokens * mixing.rake_within(codes, tokens, targets, 0.05, 60)
    assert drawn.sum() == pytest.approx(0.05 * tokens.sum())
    for c, t in zip(codes, targets):
        assert np.bincount(c, drawn) / drawn.sum() == pytest.approx(t, abs=1e-6)


def test_sample_follows_targets_at_any_size_of_the_cell_table(spark):
    rows = [(i, "word " * (10 + i % 7), "en" if i % 3 else None, f"s{i % 4}", 0) for i in range(4000)] + [(None, None, None, None, None), (1, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("p", F.lit(9))
    goal = {"source": {"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1, mixing.NONE: 0.0}}
    small = mixing.drawn(docs, 0.3, targets=goal)
    share = {r["source"]: r["t"] for r in small.groupBy("source").agg(F.sum("tokens").alias("t")).collect() if r["source"]}
    total = sum(share.values())
    for s, want in goal["source"].items():
        assert share.get(s, 0) / total == pytest.approx(want, abs=0.05)
    key = lambda df: sorted((r["doc_id"] or -1, round(r["p"], 9)) for r in df.collect())
    assert key(small) == key(mixing.drawn(docs, 0.3, targets=goal, driver_cells=0))
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs.where("false")).isEmpty()
    ids = lambda b: {r["doc_id"] for r in mixing.mixed(docs, b).collect()}
    assert ids(0.2) <= ids(0.5)


def test_saturated_cells_are_made_up_for(spark):
    # shares 0.91, 0.06, 0.03 at budget 0.6: the tempered targets of the two small sources are more than they have
    rows = [(i, "word " * 19 + "word", "en" if i % 2 else "de", "a" if i % 100 < 91 else "b" if i % 100 < 97 else "c", 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("topic", F.lit("t"))
    marked = mixing.with_cells(docs)  # has a topic
    for cells in (10**6, 0):
        p = mixing.calibrated(marked, 0.6, rounds=3, driver_cells=cells).toPandas()
        assert (p["p"] <= 1).all() and (p["p"] * p["cell_tokens"]).sum() == pytest.approx(0.6 * 120000, rel=1e-6)
        assert (p.loc[p["_source"] == "c", "p"] > 0.999).all()  # three rounds


def test_feasible_marginals_are_met_though_cells_saturate():
    # free raking wants 1.2 times the cell (0, 0); the others of its row and column can give the rest
    tokens, codes = np.array([100.0, 300.0, 300.0, 300.0]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), np.zeros(4, np.int64)]
    targets = [np.array([0.55, 0.45]), np.array([0.55, 0.45]), np.array([1.0])]
    drawn = tokens * mixing.rake_within(codes, tokens, targets, 0.6, 200)
    assert (drawn <= tokens).all() and drawn.sum() == pytest.approx(600)
    for c, t in zip(codes, targets):
        assert np.bincount(c, drawn) == pytest.approx(600 * t, rel=1e-6)


def test_marginals_are_those_of_the_sample(spark):
    # many small documents, so that the sample lies close to its expectation
    rows = [(i, "word " * 4 + "word", ("en", "de", "fr")[i % 7 % 3], f"s{i % 5 % 3}", 0) for i in range(30000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("topic", (F.col("doc_id") % 2).cast("string")).withColumn("drawn", F.lit(1))
    got = mixing.drawn(docs, 0.3)
    total = got.agg(F.sum("tokens")).first()[0]
    assert total / (5 * 30000) == pytest.approx(0.3, abs=0.01)
    told = {(r["dimension"], r["value"]): r for r in mixing.marginals(docs, 0.3).collect()}
    assert {(r["dimension"], r["value"]) for r in mixing.marginals(docs, 0.3, driver_cells=0).collect()} == set(told)
    for d in mixing.DIMS:
        for r in got.groupBy(d).agg(F.sum("tokens").alias("t")).collect():
            one = told[d, r[d]]
            assert one["drawn"] == pytest.approx(one["goal"], abs=1e-6) == pytest.approx(one["target"], abs=1e-6) and r["t"] / total == pytest.approx(one["drawn"], abs=0.02)


def test_infeasible_targets_are_told(spark):
    docs = docs_of(spark, [(i, "word word") for i in range(10)])
    told = {(r["dimension"], r["value"]): (r["target"], r["goal"], r["drawn"]) for r in mixing.marginals(docs, 0.5, targets={"source": {"s": 0.5, "gone": 0.5}}).collect()}
    assert told["source", "gone"] == (0.5, 0.0, 0.0) and told["source", "s"] == (0.5, 1.0, 1.0) and told["lang", "en"] == (1.0, 1.0, 1.0)
    assert mixing.marginals(docs.where("false")).isEmpty()


def test_clashing_columns_come_back_and_long_texts_count(spark):
    rows = [(1, "x " * 60000, "en", "s", 0), (1, "x " * 60000, "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({"p": F.lit(9), "tokens": F.lit(1), "_source": F.lit("a"), "cell_tokens": F.lit(3), "row": F.lit("r"), "topic": F.lit(None).cast("string")})
    out = mixing.mixed(docs, 1.0)
    assert out.columns == docs.columns and out.count() == 3 and out.where("p <> 9 OR tokens <> 1 OR _source <> 'a' OR row <> 'r'").isEmpty()
    assert mixing.drawn(docs, 1.0).where("doc_id = 1").agg(F.max("tokens")).first()[0] == 60001
