"""MinHash near-dedup by a multi-index Hamming join.

A document's signature is ``SYMBOLS`` b-bit minwise hashes (b = 16) of its word shingles; the distance of two signatures
is the number of symbols that differ. All pairs within ``distance`` are found: the symbols are split into ``chunks``, by
pigeonhole one chunk has at most e = distance // chunks errors, and every choice of e dropped positions of every
chunk is an index key. Two signatures within the distance therefore share at least one key, and every candidate
that shares one is verified.

Equal signatures are one node. Within a set of candidates a spanning forest of the verified relation is enough for the
groups, so a group of thousands costs its members, not its pairs. Nothing is capped.

A set of more than ``LARGE`` nodes (boilerplate gives many documents the same symbols) is split again by the same pigeonhole on the symbols in which its
members differ: where they differ in no more than the distance all of them are pairs and hang on the least; else every pair within the distance is equal in one of the chunks of
those symbols. So neither a task nor a comparison of all with all grows with the set; only a set whose members still agree in nearly every such symbol stays one group.

Defined results: null and empty texts and texts without a word have no signature and are no one's duplicate; texts of
fewer words than a shingle are one shingle; rows with a null doc_id can't be named, so they neither appear in a result nor
leave the corpus; rows repeating a doc_id are one document and stay or go together; of a group the least doc_id stays;
an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, group_arrow, map_arrow, materialize
from .textscan import mix, shingles, slices, words

SYMBOLS, SHINGLE, DISTANCE, CHUNKS = 64, 2, 24, 13
#: Up to so many edges (16 bytes each, about 150 as a forest in Python) the components are found on the driver, beyond it by label propagation on the executors, with the same result.
DRIVER_EDGES = 500_000
FLUSH_NODES, LARGE = 20_000, 5_000
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)


def minhash(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a word, their signatures as uint16)."""
    rows, found = [], []
    for first, _end, offsets, data in slices(column, 1 << 20):
        s, bounds = shingles(*words(offsets, data), k)
        has = np.flatnonzero(np.diff(bounds))
        if not len(has):
            continue
        x, starts = (s >> np.uint64(32)).astype(np.uint32), bounds[:-1][has]
        out, y, z = np.empty((len(has), SYMBOLS), np.uint16), np.empty_like(x), np.empty_like(x)
        for j in range(SYMBOLS):
            np.multiply(x ^ _ADD[j], _MULTIPLY[j], out=y)
            np.right_shift(y, np.uint32(15), out=z)
            y ^= z
            y *= np.uint32(0x2C1B3C6D)
            np.right_shift(y, np.uint32(13), out=z)
            y ^= z
            out[:, j] = np.minimum.reduceat(y, starts) & np.uint32(0xFFFF)
        rows.append(has + first)
        found.append(out)
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.empty(0, np.int64), np.empty((0, SYMBOLS), np.uint16))


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, sig) of the documents that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sig = minhash(batch.column(1), k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), blobs([r.tobytes() for r in sig])], names=["doc_id", "sig"])

    return map_arrow(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, sig binary")


def key_masks(symbols: int = SYMBOLS, distance: int = DISTANCE, chunks: int = CHUNKS) -> list[np.ndarray]:
    """The positions each index key is made of: of every chunk, all ways to leave out distance // chunks positions."""
    if not 0 <= distance < symbols or not 1 <= chunks <= symbols:
        raise ValueError("distance must be below the symbols, chunks between 1 and the symbols")
    e = distance // chunks
    masks = []
    for part in np.array_split(np.arange(symbols), chunks):
        if len(part) <= e:
            raise ValueError("a chunk may not allow errors in all its symbols: use fewer chunks")
        masks += [np.array([p for p in part if p not in left_out]) for left_out in combinations(part, e)]
    return masks


def index_keys(sig: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key by signature (row) and mask (column)."""
    out = np.empty((len(sig), len(masks)), np.uint64)
    wide = sig.astype(np.uint64)
    for m, part in enumerate(masks):
        h = np.full(len(sig), m + 1, np.uint64)
        for p in part:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + wide[:, p])
        out[:, m] = h
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def near_edges(ids: np.ndarray, sig: np.ndarray, distance: int, every: bool = False) -> list[tuple[int, int]]:
    """Edges of the relation "within the distance" on one candidate set: all of them, or a spanning forest."""
    out, left = [], np.arange(len(ids))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = (sig[left] != sig[at]).sum(1) <= distance
            out += [(int(ids[at]), int(ids[x])) for x in left[near]]
            if every:
                break
            queue += left[near].tolist()
            left = left[~near]
    return out


def _by_run(keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal sorted keys, and the end."""
    return np.concatenate([np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def candidate_sets(nodes: DataFrame, distance: int = DISTANCE, chunks: int = CHUNKS, symbols: int = SYMBOLS, bucket_rows: int = 2_000_000) -> DataFrame:
    """(set, node) of the distinct sets of two or more nodes that share an index key.

    Keys travel packed, a blob by task and bucket of the key space; buckets are as many as the nodes need.
    """
    masks = key_masks(symbols, distance, chunks)
    buckets = max(8, nodes.count() * len(masks) // bucket_rows + 1)

    def flush(ids: list[np.ndarray], sig: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate([index_keys(x, masks).ravel() for x in sig])
        owner = np.repeat(np.concatenate(ids), len(masks))
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        held = np.flatnonzero(np.diff(ends))
        cut = [order[ends[b] : ends[b + 1]] for b in held]
        return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), blobs([keys[c].tobytes() for c in cut]),
                blobs([owner[c].tobytes() for c in cut])], names=["bucket", "keys", "nodes"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sig, n = [], [], 0
        for batch in batches:
            ids.append(np.asarray(batch.column(0)))
            sig.append(_matrix(batch.column(1)))
            n += len(batch)
            if n >= FLUSH_NODES:
                yield flush(ids, sig)
                ids, sig, n = [], [], 0
        if n:
            yield flush(ids, sig)

    def match(t: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint64)
        node = np.frombuffer(b"".join(t.column("nodes").to_pylist()), np.int64)
        order = np.lexsort((node, keys))
        keys, node = keys[order], node[order]
        starts = np.concatenate([[0], _by_run(keys)[:-1]]).astype(np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        total = int(sizes.sum())
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes).astype(np.int64) + np.arange(total) if total else np.empty(0, np.int64)
        members = node[at]
        # equal sets get equal names, whatever key found them; a name that two different sets share is the key's own for both
        mixed = mix(members.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        name = mix(np.add.reduceat(mixed, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)) +
            sizes.astype(np.uint64)) if total else np.empty(0, np.uint64)
        keep = np.zeros(len(name), bool)
        first = np.unique(name, return_index=True)[1]
        keep[first] = True
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if total else np.empty(0, np.int64)
        same = first[np.searchsorted(name[first], name)] if total else first
        for i in np.flatnonzero((sizes != sizes[same]) | (members[begin] != members[begin[same]]) |
            (members[begin + sizes - 1] != members[begin[same] + sizes[same] - 1])) if total else ():
            keep[i], name[i] = True, mix(name[i : i + 1] + np.uint64(int(keys[starts[i]])))[0]
        rows = np.repeat(keep, sizes)
        return pa.table({"set": pa.array(np.repeat(name, sizes)[rows].view(np.int64)), "node": pa.array(members[rows])})

    packed = map_arrow(nodes.select("node", "sig"), emit, "bucket int, keys binary, nodes binary")
    return group_arrow(packed, "bucket", match, "set bigint, node bigint").distinct()


def split_masks(varying: np.ndarray, distance: int) -> list[np.ndarray]:
    """Keys over the positions in which a set's members differ, more than the distance: of all chunkings whose keys number at most 128 the one with the longest keys."""
    best: tuple[int, int, list[np.ndarray]] = (0, 0, [])
    for chunks in range(1, len(varying) + 1):
        e, parts = distance // chunks, np.array_split(varying, chunks)
        length = min(map(len, parts)) - e
        keys = sum(comb(len(p), e) for p in parts)
        if length > 0 and keys <= 128 and (length, -keys) > best[:2]:
            best = (length, -keys, [np.array([x for x in p if x not in out]) for p in parts for out in combinations(p, e)])
    return best[2]


def split_large(nodes: DataFrame, sets: DataFrame, distance: int = DISTANCE, large: int = LARGE) -> DataFrame:
    """``sets`` with those of more than ``large`` nodes replaced by smaller ones that miss no pair within the distance."""
    big = materialize(sets.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where(F.col("n") > large), "minhash-large")
    if big.isEmpty():
        return sets
    rows = sets.join(big.select("set"), "set").join(nodes.select("node", "sig"), "node").select("set", "node", "sig")

    def ends(sets_: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, at = np.unique(sets_, return_inverse=True)
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(len(names)))
        return names, np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)

    def told(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
        return [pa.array(names, pa.int64()), blobs([x.tobytes() for x in low]), blobs([x.tobytes() for x in high])]

    def spread_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sig = _matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays(told(*ends(np.asarray(batch.column(0)), sig, sig)), names=["set", "low", "high"])

    def merge(t: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("set", "low", "high"), told(*ends(np.asarray(t.column("set")), _matrix(t.column("low")), _matrix(t.column("high")))))))

    ranges = group_arrow(map_arrow(rows.select("set", "sig"), spread_, "set bigint, low binary, high binary"), "set", merge,
        "set bigint, low binary, high binary")

    def rekey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[bytes, list[np.ndarray]] = {}
        for batch in batches:
            names, node, least = (np.asarray(batch.column(i)) for i in (0, 1, 5))
            sig, low, high = (_matrix(batch.column(i)) for i in (2, 3, 4)) if len(batch) else ([], [], [])
            for name in np.unique(names):
                at = np.flatnonzero(names == name)
                varying = np.flatnonzero(low[at[0]] != high[at[0]])
                if len(varying) <= distance:  # all are pairs: each hangs on the least
                    other = at[node[at] != least[at]]
                    sub = mix(node[other].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(int(name) % 2**64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(sub.view(np.int64), 2)),
                            pa.array(np.concatenate([node[other], least[other]]))], names=["set", "node"])
                    continue
                if varying.tobytes() not in masks:
                    masks[varying.tobytes()] = split_masks(varying, distance)
                keys = index_keys(sig[at], masks[varying.tobytes()])
                keys = mix(keys + np.uint64(int(name) % 2**64) * np.uint64(0xD6E8FEB86659FD93))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(node[at], keys.shape[1]))], names=["set", "node"])

    known = rows.join(ranges, "set").join(big.select("set", "least"), "set").select("set", "node", "sig", "low", "high", "least")
    subs = materialize(map_arrow(known, rekey, "set bigint, node bigint"), "minhash-split")
    shared = subs.groupBy("set").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("set")
    return sets.join(big.select("set"), "set", "left_anti").select("set",
        "node").unionByName(subs.join(shared, "set", "left_semi").select("set", "node")).distinct()


def verified(nodes: DataFrame, sets: DataFrame, distance: int = DISTANCE, every: bool = False, bucket_rows: int = 200_000) -> DataFrame:
    """(a, b) edges within the distance among the members of every candidate set."""

    def check(t: pa.Table) -> pa.Table:
        names, ids, sig = np.asarray(t.column("set")), np.asarray(t.column("node")), _matrix(t.column("sig"))
        order = np.lexsort((ids, names))
        names, ids, sig = names[order], ids[order], sig[order]
        ends = _by_run(names)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        two = ends - starts == 2
        first = starts[two]
        ok = first[(sig[first] != sig[first + 1]).sum(1) <= distance] if len(first) else first
        edges = list(zip(ids[ok].tolist(), ids[ok + 1].tolist()))
        for s, e in zip(starts[~two], ends[~two]):
            edges += near_edges(ids[s:e], sig[s:e], distance, every)
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})

    buckets = max(8, sets.count() // bucket_rows + 1)
    joined = sets.join(nodes.select("node", "sig"), "node").withColumn("bucket", F.pmod(F.hash("set"), F.lit(buckets)))
    return group_arrow(joined, "bucket", check, "a bigint, b bigint").distinct()


def components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, root): the least node of the component of every node that has an edge."""
    spark = edges.sparkSession
    if edges.count() <= driver_edges:
        t = edges.select("a", "b").toArrow()
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        return spark.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()),
                    "root": pa.array([find(x) for x in nodes], pa.int64())}), "node bigint, root bigint")
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "cc")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("least"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("root", "least").alias("root"), F.col("root").alias("was"))
        # pointer jumping: take the root of the root
        up = step.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        new = materialize(step.join(up, step.root == up.up, "left").select("node", F.least("root", F.coalesce("up_root", "root")).alias("root"), "was"), "cc")
        if new.where("root <> was").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def _nodes(sigs: DataFrame) -> DataFrame:
    return sigs.groupBy("sig").agg(F.min("doc_id").alias("node"))


def near_pairs(docs: DataFrame, distance: int = DISTANCE, chunks: int = CHUNKS) -> DataFrame:
    """All pairs (a < b) of documents whose signatures lie within the distance, as many as there are."""
    sigs = materialize(signatures(docs).distinct(), "minhash")
    nodes = materialize(_nodes(sigs), "minhash-nodes")
    edges = verified(nodes, materialize(candidate_sets(nodes, distance, chunks), "minhash-sets"), distance, every=True)
    members = sigs.join(nodes, "sig").select("node", "doc_id")
    same = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    left, right = members.toDF("a", "doc_a"), members.toDF("b", "doc_b")
    pairs = edges.union(same).join(left, "a").join(right, "b")
    return pairs.where("doc_a <> doc_b").select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct()


def duplicates(docs: DataFrame, distance: int = DISTANCE, chunks: int = CHUNKS, large: int = LARGE) -> DataFrame:
    """(doc_id, kept_doc_id) of every document that repeats or nearly repeats another one, the least of its group."""
    sigs = materialize(signatures(docs), "minhash")
    nodes = materialize(_nodes(sigs), "minhash-nodes")
    sets = split_large(nodes, materialize(candidate_sets(nodes, distance, chunks), "minhash-sets"), distance, large)
    edges = materialize(verified(nodes, sets, distance), "minhash-edges")
    roots = components(edges)
    group = nodes.join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("kept_doc_id"))
    return sigs.join(group, "sig").where("doc_id <> kept_doc_id").select("doc_id", "kept_doc_id").distinct()


def keep_one(docs: DataFrame, distance: int = DISTANCE, chunks: int = CHUNKS) -> DataFrame:
    """``docs`` without the documents that ``duplicates`` lists."""
    gone = materialize(duplicates(docs, distance, chunks).select(F.col("doc_id").alias("_gone")), "minhash-gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
