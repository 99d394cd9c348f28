"""Benchmark decontamination with suffix arrays of the training text.

The corpus is cut into shards (consecutive documents of one task, ``SHARD_BYTES`` of text). Each shard's words get
a suffix array, by prefix doubling up to the longest item; every suffix of every benchmark item is binary-searched in it. The
range of suffixes that share ``min_words`` words with it holds all places where the match is long enough; those that don't continue a
match of the word before are extended to their longest verbatim match. A match is verbatim on lower-cased words; punctuation and white space don't count.

No shuffle: shards are local to a task and the result is as long as the matches. The items' words are broadcast as arrays, four bytes a word and at most
``SCAN_WORDS`` words a scan of the corpus; within a scan a shard's array is made once and asked for ``part_words`` words at a time. Places are extended ``PAIRS`` at a time, so
a passage that fills a shard needs no more memory than any other.

Defined results: an item of fewer than ``min_words`` words has to be matched whole; one of fewer than ``least_words`` (1 by default: none) never
matches; null and empty texts never match; an item with a null item_id matches as
any other and appears with null in ``matches``, each distinct text by itself; rows with a null doc_id appear with
null in ``matches`` and stay in ``remove_affected``, since they can't be named; rows repeating a doc_id go together; of equally long
matches of one document and item the first in the item, then in the document, is given; an empty table on either
side gives no matches; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .textscan import slices, words

MIN_WORDS, LEAST_WORDS, SHARD_BYTES, PART_WORDS, SCAN_WORDS, PAIRS = 13, 1, 2 << 20, 2_000_000, 16_000_000, 1_000_000


def codes(hashes: np.ndarray) -> np.ndarray:
    """Words as 32-bit letters of the suffix array, at least 2; 0 ends a query, 1 a document."""
    return np.maximum((hashes >> np.uint64(32)).astype(np.uint32), np.uint32(2))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` ordered by their first ``depth`` letters at least; prefix doubling on the ties only."""
    n = len(text)
    wide = text.astype(np.uint64)
    key = wide << np.uint64(32)
    key[:-1] |= wide[1:]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    known = 2
    tied = ~new
    tied[:-1] |= ~new[1:]
    slots = np.flatnonzero(tied)
    while known < depth and len(slots):
        at = order[slots]
        after = at + known
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[at]
        both = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = both[1:] != both[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = slots[tied]
        known *= 2
    return order


class Queries:
    """All suffixes of items that can hold a match. Items are (id, letters); each is followed by a 0."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], min_words: int, least_words: int):
        self.ids = pa.array([i for i, _ in items], pa.int64())
        sizes = np.array([len(c) for _, c in items], np.int64)
        self.flat = np.concatenate([x for _, c in items for x in (c, np.zeros(1, np.uint32))] or [np.empty(0, np.uint32)]).astype(np.uint32)
        base = np.cumsum(sizes + 1) - (sizes + 1)
        need = np.where(sizes >= max(1, least_words), np.minimum(min_words, sizes), 0)
        counts = np.where(need > 0, sizes - need + 1, 0)
        self.item = np.repeat(np.arange(len(items)), counts)
        self.start = np.arange(len(self.item)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = base[self.item] + self.start
        self.lengths = need[self.item]
        self.depth = int(max(2, sizes.max(initial=0)))


def _bound(text: np.ndarray, order: np.ndarray, q: Queries, right: bool) -> np.ndarray:
    """Binary search of all queries at once: the first suffix not before (or, right: after) those that start with the query."""
    lo, hi = np.zeros(len(q.at), np.int64), np.full(len(q.at), len(order), np.int64)
    depth = int(q.lengths.max(initial=0))
    padded = np.concatenate([text, np.zeros(depth, text.dtype)])
    live = np.arange(len(q.at))
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        start, less, open_ = order[mid], np.zeros(len(live), bool), np.arange(len(live))
        equal = np.zeros(len(live), bool)
        for d in range(depth):
            done = q.lengths[live[open_]] <= d
            equal[open_[done]] = True
            open_ = open_[~done]
            if not len(open_):
                break
            letter, t = q.flat[q.at[live[open_]] + d], padded[start[open_] + d]
            less[open_] = t < letter
            open_ = open_[t == letter]
        else:
            equal[open_] = True
        less |= equal & right
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
        live = live[lo[live] < hi[live]]
    return lo


def search(text: np.ndarray, order: np.ndarray, q: Queries, pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, position in the shard, words that match from there) of all matches that are long enough and can't begin a word earlier; ``order`` is the suffix array."""
    lo = _bound(text, order, q, False)
    sizes = _bound(text, order, q, True) - lo
    ends = np.cumsum(sizes)
    ended = np.append(text, np.uint32(1))
    for first in range(0, int(sizes.sum()), pairs):
        pair = np.arange(first, min(first + pairs, int(ends[-1])))
        query = np.searchsorted(ends, pair, "right")
        at = order[lo[query] + pair - (ends[query] - sizes[query])]
        from_ = q.at[query]
        # a match that goes on from the word before is part of a longer one; marks between documents are no word of an item
        goes_on = (q.start[query] > 0) & (at > 0) & (q.flat[from_ - 1] == text[at - 1])
        query, at, from_ = query[~goes_on], at[~goes_on], from_[~goes_on]
        n = q.lengths[query].copy()
        live = np.arange(len(query))
        while len(live):  # extend all matches by a word until none grows
            place = np.minimum(at[live] + n[live], len(text))
            live = live[q.flat[from_[live] + n[live]] == ended[place]]
            n[live] += 1
        yield query, at, n


def _scans(benchmark: DataFrame, part_words: int, scan_words: int) -> Iterator[list[list[tuple[int | None, np.ndarray]]]]:
    """The items in parts of ``part_words`` words, as many parts at a time as one scan of the corpus takes."""
    scan, part, n, total = [], [], 0, 0
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"),
        "text").distinct().orderBy("item_id", "text").toLocalIterator()
    for item, text in rows:
        part.append((item, codes(words(*_one(text))[0])))
        n, total = n + len(part[-1][1]), total + len(part[-1][1])
        if n >= part_words or total >= scan_words:
            scan.append(part)
            part, n = [], 0
        if total >= scan_words:
            yield scan
            scan, total = [], 0
    if part:
        scan.append(part)
    if scan:
        yield scan


def _one(text: str) -> tuple[np.ndarray, np.ndarray]:
    return next((o, d) for _, _, o, d in slices(pa.array([text], pa.string())))


def best_matches(row: np.ndarray, item: np.ndarray, item_word: np.ndarray, doc_word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row and item the longest match, the first in the item, then in the document."""
    order = np.lexsort((doc_word, item_word, -n, item, row))
    pair = np.stack([row[order], item[order]])
    best = order[np.concatenate([[True], (np.diff(pair) != 0).any(0)])[: len(order)]]
    return row[best], item[best], item_word[best], doc_word[best], n[best]


def matches(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, least_words: int = LEAST_WORDS,
    part_words: int = PART_WORDS, scan_words: int = SCAN_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): the longest match of every document and item that have one."""
    spark, schema = docs.sparkSession, "doc_id bigint, item_id bigint, doc_word int, item_word int, n_words int"
    out = spark.createDataFrame([], schema)
    for scan in _scans(benchmark, part_words, scan_words):
        shared, depth = spark.sparkContext.broadcast(scan), max(2, *(len(c) for part in scan for _, c in part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, depth=depth) -> Iterator[pa.RecordBatch]:
            parts, only = shared.value, Queries(shared.value[0], min_words, least_words) if len(shared.value) == 1 else None
            for batch in batches:
                for first, end, offsets, data in slices(batch.column(1), SHARD_BYTES):
                    h, bounds = words(offsets, data)
                    if not len(h):
                        continue
                    # a mark after every document, so that no match crosses its end
                    text = np.insert(codes(h), bounds[1:], np.uint32(1))
                    starts = bounds[:-1] + np.arange(end - first)
                    order = suffix_array(text, depth)
                    for part in parts:
                        q = only or Queries(part, min_words, least_words)
                        found = []
                        for query, at, n in search(text, order, q):
                            row = np.searchsorted(starts, at, "right") - 1
                            found.append(best_matches(row, q.item[query], q.start[query], at - starts[row], n))
                        if not sum(len(f[0]) for f in found):
                            continue
                        row, item, item_word, doc_word, n = best_matches(*(np.concatenate(x) for x in zip(*found)))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), q.ids.take(pa.array(item)),
                                *(pa.array(x.astype(np.int32)) for x in (doc_word, item_word, n))],
                            names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        out = out.unionByName(map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, schema))
    return out


def remove_affected(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without those that hold a match."""
    hit = materialize(matches(docs, benchmark, min_words,
            least_words).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_hit")).distinct(), "contaminated")
    return docs.join(hit, docs["doc_id"] == hit["_hit"], "left_anti")
