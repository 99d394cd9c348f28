"""The registered queries over the smallest tables: against their SQL, or against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from folioflow.llm import decontaminate, mixing, neardup, pii, queries, ranking, sharding
from tests.test_queries import rows, sql  # noqa: F401

from .helpers import brute_groups, brute_reasons, docs_of
from .test_decontaminate import brute as brute_matches
from .test_substrings import brute as brute_spans


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").collect() for n in ("documents", "benchmark", "labels")}


def signed(texts: list[tuple]) -> list[tuple]:
    at, sig = neardup.minhash(pa.array([t for _, t in texts], pa.string()))
    return [(texts[i][0], s) for i, s in zip(at, sig)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, sql, name):  # noqa: F811
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(sql.sql(queries.ORACLES[name]).df())


def test_op2_equals_brute_force(spark, sf_dir, tables):
    want = brute_reasons([(r["doc_id"], r["text"], r["lang"]) for r in tables["documents"]])
    got = {r["doc_id"] for r in queries.op2_fertility(spark, sf_dir).collect()}
    assert got == {i for i, reason in want.items() if reason is None} and 0 < len(got) < len(want)


def test_op3_equals_brute_force(spark, sf_dir, tables):
    want = brute_groups(signed([(r["doc_id"], r["text"]) for r in tables["documents"]]), neardup.DISTANCE)
    assert {r["doc_id"]: r["kept_doc_id"] for r in queries.op3_minhash(spark, sf_dir).collect()} == want and want


def test_op4_equals_brute_force(spark, sf_dir, tables):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = ranking.learn(docs, labels)
    score = ranking.scores(pa.array([r["text"] for r in tables["documents"]], pa.string()), model)
    order = sorted(score)
    cut = next(s for k, s in enumerate(order) if sum(x <= s for x in order) > float(model["cut"]) * len(order))
    want = {(r["doc_id"], round(float(s), 3)) for r, s in zip(tables["documents"], score) if s >= cut - 1e-9 and s > ranking.LOWEST}
    assert {(r["doc_id"], round(r["score"], 3)) for r in queries.op4_bradley_terry(spark, sf_dir).collect()} == want and 0 < len(want) < len(order)


def test_op5_equals_decoding_whole_texts(spark, sf_dir, tables):
    w, want = pii.train(), set()
    for r in tables["documents"]:
        tokens = pii.tokenize(r["text"])
        found = pii.decode(tokens, pii.score_spans(tokens, r["text"], w))
        want |= {(r["doc_id"], tokens[i][1], tokens[j - 1][2] - tokens[i][1], kind) for i, j, kind in found}
    assert {(r["doc_id"], r["start"], r["length"], r["type"]) for r in queries.op5_pii(spark, sf_dir).collect()} == want and want


def test_op6_equals_brute_force(spark, sf_dir, tables):
    want = brute_spans([(r["doc_id"], r["text"]) for r in tables["documents"]], 50)
    assert {tuple(r) for r in queries.op6_substrings(spark, sf_dir).collect()} == want and want


def matched(docs: list, items: list) -> set:
    """Brute force, spared the pairs that share no run of words."""
    from .helpers import words

    need = decontaminate.MIN_WORDS
    runs = {k: {tuple(w[p : p + n]) for n in [min(need, len(w))] for p in range(len(w) - n + 1)} for k, w in ((r["item_id"], words(r["text"])) for r in items)}
    out = set()
    for d in docs:
        w = words(d["text"])
        own = {tuple(w[p : p + n]) for n in {len(next(iter(x))) for x in runs.values() if x} for p in range(len(w) - n + 1)}
        near = [(r["item_id"], r["text"]) for r in items if own & runs[r["item_id"]]]
        out |= brute_matches([(d["doc_id"], d["text"])], near, need) if near else set()
    return out


def test_op9_equals_brute_force(spark, sf_dir, tables):
    want = matched(tables["documents"], tables["benchmark"])
    assert {tuple(r) for r in queries.op9_decontamination(spark, sf_dir).collect()} == want and want


def test_pipeline_equals_brute_force(spark, sf_dir, tables, sql):  # noqa: F811
    docs = tables["documents"]
    reasons = brute_reasons([(r["doc_id"], r["text"], r["lang"]) for r in docs])
    docs = [r for r in docs if reasons[r["doc_id"]] is None]
    copies = brute_groups(signed([(r["doc_id"], r["text"]) for r in docs]), neardup.DISTANCE)
    docs = [r for r in docs if r["doc_id"] not in copies]
    leaked = {m[0] for m in matched(docs, tables["benchmark"])}
    docs = [r for r in docs if r["doc_id"] not in leaked]
    c = sql.cursor()
    put = lambda rs: c.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM held") if c.register("held", pa.Table.from_pylist([r.asDict() for r in rs])) else None
    put(docs)
    drawn = set(c.execute(mixing.oracle().replace("SELECT doc_id, m.source", "SELECT doc_id AS doc_id, m.source")).df()["doc_id"])
    docs = [r for r in docs if r["doc_id"] in drawn]
    put(docs)
    want = rows(c.execute(sharding.oracle()).df())
    assert rows(corpus_pipeline.run(spark, sf_dir).select("doc_id", "slot", "shard", "map_version").toPandas()) == want and len(want[1]) > 20


def test_pipeline_takes_any_rows_and_columns(spark, tmp_path):
    """Nulls, repeats, a very long text, clashing columns; the same with an empty table."""
    from pyspark.sql import functions as F

    edges = [(None, "lost id of a short text"), (1, None), (2, ""), (3, "  \n"), (4, "é"), (4, "é"), (5, "x " * 60000), (None, None)]
    docs = docs_of(spark, edges).withColumns({c: F.lit("mine") for c in ("reason", "band", "n_tokens", "row", "tokens", "p", "topic", "_gone", "_hit", "_source", "slot", "shard")})
    for n, d in enumerate((docs, docs.where("false"))):
        folder = tmp_path / str(n)
        d.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, None), (None, "")], "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.count() <= d.count() and out.where("reason <> 'mine' OR band <> 'mine' OR tokens <> 'mine' OR p <> 'mine' OR _source <> 'mine'").isEmpty()
        before = {c for c in d.columns if c not in ("slot", "shard")}
        assert set(out.columns) == before | {"slot", "shard", "map_version"}
