from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioflow.llm import fixity, urlfilter

from .helpers import docs_of, prose

LIST = (("example.com", "block"), ("good.example.com", "allow"), ("good.example.com/a", "block"), ("good.example.com/a/b", "allow"), ("Twice.org", "allow"), ("twice.org", "block"), (None, "block"), (" ", "block"))
URLS = {"http://example.com": "block", "https://u:p@x.EXAMPLE.com:80/q": "block", "http://good.example.com/": "allow", "http://good.example.com//a?x": "block", "http://good.example.com/a/b/c#f": "allow", "http://good.example.com/ab": "allow", "http://other.com/example.com": "allow", "http://twice.org./": "block", "http://notexample.com": "allow", "": "none", None: "none", "no url": "none", "http://long.example.com/" + "a/" * 20000: "block"}


@pytest.mark.parametrize("limit", [10**6, 0])
@pytest.mark.parametrize("as_table", [False, True])
def test_longest_match_decides(spark, limit, as_table):
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)] + [(0, "http://example.com", "mine")], "page_id int, url string, host string")
    pages = pages.withColumns({c: F.lit("mine") for c in ("path", "action", "entry")})
    entries = spark.createDataFrame(list(LIST), "entry string, action string") if as_table else LIST
    got = urlfilter.verdicts(pages, entries, limit).collect()
    assert len(got) == len(URLS) + 1 and {r["url"]: r["action"] for r in got} == URLS
    assert urlfilter.verdicts(pages.where("false"), entries, limit).isEmpty()
    assert {r["action"] for r in urlfilter.verdicts(pages, ()).collect()} == {"allow", "none"}


def test_the_trie_stays_below_its_bound():
    """What NODE_BYTES says of a trie holds for hosts and paths of many shapes."""
    import tracemalloc

    rng = random.Random(3)
    entries = [(f"h{rng.randrange(10**6)}.d{rng.randrange(500)}.org", "/".join(f"p{rng.randrange(1000)}" for _ in range(rng.randrange(4))), "block") for _ in range(20000)]
    tracemalloc.start()
    trie = urlfilter.build(entries)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert trie and held < urlfilter.NODE_BYTES * sum(len(h.split(".")) + (len(p.split("/")) if p else 0) for h, p, _ in entries)


def test_audit_finds_all_damage(spark):
    rng = random.Random(4)
    a = [(i, prose(rng, 5)) for i in range(500) if i % 11] + [(499, None), (None, "lost"), (7, "twin")]
    b = dict(enumerate(a))
    b[3] = (a[3][0], a[3][1][::-1])
    del b[100]
    b[9999] = (5000, "new")
    left, right = (spark.createDataFrame(x, "page_id bigint, html string") for x in (a, list(b.values())))
    got = {r["record"]: r["status"] for r in fixity.audit(left, right, file_bits=3).collect()}
    lost, changed = a[100][0], a[3][0]
    assert got[changed] == "corrupt" and got[lost] == "missing" and got[5000] == "extra"
    assert all(s == "moved" and n >> 3 == lost >> 3 and n > lost for n, s in got.items() if n not in (changed, lost, 5000))
    assert fixity.audit(left, left.orderBy(F.desc("html"))).isEmpty() and fixity.audit(left.where("false"), left.where("false")).isEmpty()
    nul = spark.createDataFrame([(499, "")], "page_id bigint, html string")
    assert fixity.audit(nul, nul.withColumn("html", F.lit(None).cast("string"))).first()["status"] == "corrupt"


def test_audit_of_records_without_a_number_and_of_repeated_ones(spark):
    rows = [(None, "lost"), (None, "lost"), (None, "kept"), (-1, "below"), (-1, "gone"), (5, "twin"), (5, "other"), (6, "x" * 300_000), (6, "x" * 300_000), (7, None), (8, "")]
    a = spark.createDataFrame(rows, "page_id bigint, html string").withColumns({c: F.lit("mine") for c in ("k", "side", "body", "start", "hash", "number")})
    without = lambda *gone: spark.createDataFrame([r for i, r in enumerate(rows) if i not in gone], "page_id bigint, html string")
    told = lambda b: sorted((str(r["record"]), r["status"], r["length"], r["found_length"]) for r in fixity.audit(a, b).collect())
    assert told(without()) == [] and told(without().orderBy(F.desc("html"))) == []
    assert told(without(0)) == [("None", "missing", 4, 4)] and told(without(4)) == [("-1", "missing", 4, None)]
    assert told(without(5)) == [("5", "corrupt", 9, 5), ("6", "moved", 600_000, 600_000), ("7", "moved", 0, 0), ("8", "moved", 0, 0)]
    assert told(without(8)) == [("6", "corrupt", 600_000, 300_000), ("7", "moved", 0, 0), ("8", "moved", 0, 0)]
    assert {s for _, s, *_ in told(without().where("false"))} == {"missing"}
    extra = without().unionByName(spark.createDataFrame([(None, "new")], "page_id bigint, html string"))
    assert told(extra) == [("None", "extra", None, 3)]


def test_trees_of_any_height_agree(spark, monkeypatch):
    rows = [(i * 7919 % 100_003, f"page {i}") for i in range(300)]
    a = spark.createDataFrame(rows, "page_id bigint, html string")
    b = spark.createDataFrame([(n, t if i % 50 else t.upper()) for i, (n, t) in enumerate(rows)], "page_id bigint, html string")
    want = {n for i, (n, _) in enumerate(rows) if not i % 50}
    for bits in (1, 5, 9):
        assert {r["record"] for r in fixity.audit(a, b, fanout_bits=bits).collect()} == want
    monkeypatch.setattr(fixity, "DERIVED_NODES", 10)
    assert {r["record"] for r in fixity.audit(a, b).collect()} == want


def test_pipeline_keeps_clean_documents_and_its_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(["the", "house", "stands", "near", "a", "river", "and", "water", "runs", "under", "old", "stone", "bridges", "where", "people", "walk"]) + (str() if rng.random() > 0.1 else ",") for _ in range(n))
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(i, say(80)) for i in range(120)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " again"), (202, say(40) + " " + item), (203, None), (204, "")]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert set(range(120)) <= seen["quality_rules"] and not {203, 204} & seen["quality_rules"]
    assert not {200, 201} & seen["near_dedup"] and {3, 4} <= seen["near_dedup"]
    assert seen["near_dedup"] - seen["decontamination"] <= {202} and 202 not in seen["decontamination"]
    assert seen["shard"] == seen["mix_sources"] <= seen["decontamination"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["shard"]
