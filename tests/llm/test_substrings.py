from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import substrings
from folioflow.llm.common import pack_gaps, pack_ints, row_blocks, unpack_gaps, unpack_ints

from .helpers import EDGES, docs_of, prose, words


def brute(rows, window):
    holders = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            holders[tuple(w[p : p + window])].add(i)
    covered = defaultdict(set)
    for i, t in rows:
        w = words(t)
        covered[i] |= {p for p in range(len(w) - window + 1) if len(holders[tuple(w[p : p + window])]) > 1}
    out = set()
    for i, at in covered.items():
        if i is None:
            continue
        for p in sorted(at):
            if p - 1 not in at and not any(p - g in at for g in range(1, window + 1)):
                last = p
                while nxt := next((q for q in range(last + window, last, -1) if q in at), None):
                    last = nxt
                out.add((i, p, last + window - p))
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 700}, {"per_window": 1, "rows": 1}])
def test_equals_brute_force(spark, sizes):
    rng = random.Random(4)
    passage, other = prose(rng, 40), prose(rng, 25)
    rows = [(i, prose(rng, rng.randrange(5, 90))) for i in range(60)]
    rows += [(100 + i, f"{prose(rng, 12)} {passage} {prose(rng, 9)}") for i in range(5)] + [(200, passage.upper()), (201, f"{other} {other}"), (202, other), (203, prose(rng, 30)), (204, f"{passage} {other}"), *EDGES, (None, passage)]
    got = {tuple(r) for r in substrings.repeated_passages(docs_of(spark, rows), 10, **sizes).collect()}
    assert got == brute(rows, 10) and any(i == 204 for i, _, _ in got)


def test_repeats_inside_one_document_do_not_count(spark):
    text = prose(random.Random(1), 30)
    assert substrings.repeated_passages(docs_of(spark, [(1, text + " " + text), (1, text)]), 10).isEmpty()
    assert substrings.repeated_passages(docs_of(spark, []), 10).isEmpty()


def test_packing_round_trips():
    for x in ([], [0], [5, 5, 300, 70000, 2**33], list(range(1000))):
        assert unpack_gaps(pack_gaps(np.array(x, np.int64))).tolist() == x
    for x in ([], [3], [-(2**63), 5], [7, 7, 8, 2**40, -1], [2**62, -(2**62)]):
        assert unpack_ints(pack_ints(np.array(x, np.int64))).tolist() == x


def test_blocks_that_come_back_in_another_order_lose_nothing(spark, monkeypatch):
    """A second scan that gives other blocks than the first sends all their windows; the result is the same."""
    rng = random.Random(9)
    passage = prose(rng, 30)
    rows = [(i, prose(rng, 40)) for i in range(20)] + [(50, prose(rng, 5) + " " + passage), (51, passage)]
    docs = docs_of(spark, rows)
    real = substrings.answers
    monkeypatch.setattr(substrings, "answers", lambda d, *how: real(d.orderBy(F.desc("doc_id")), *how))
    assert {tuple(r) for r in substrings.repeated_passages(docs, 10, block_bytes=500).collect()} == brute(rows, 10)


def test_the_prefilter_drops_windows_before_the_grouping(spark):
    rng = random.Random(2)
    docs = docs_of(spark, [(i, prose(rng, 300, 5000)) for i in range(60)])
    sketch = substrings.Sketch(20000, 2, 2)
    told = substrings.answers(docs, sketch, 10, 10**6).collect()
    two = sum(int(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).sum()) for r in told)
    assert 0 < two < 0.7 * sum(r["n"] for r in told)


def test_row_blocks_depend_on_rows_only():
    texts = pa.array(["a" * n for n in (5, 0, 9, 30, 1, 1, 1)] + [None])
    one = [pa.record_batch([texts], names=["t"])]
    many = [pa.record_batch([texts.slice(i, 1)], names=["t"]) for i in range(len(texts))]
    cut = lambda batches: [(n, t.column(0).to_pylist()) for n, t in row_blocks(iter(batches), 0, 10)]
    assert cut(one) == cut(many) and [len(x) for _, x in cut(one)] == [3, 1, 4]
