"""Substring dedup with a count-min prefilter.

Every window of ``WINDOW`` words of every document is counted. First pass: each block of documents sketches its windows and sends
every segment of the sketch the counters it uses; the segment's owner merges them counter by counter, so a window's least counter
never underestimates, and answers each block with one bit a counter: has it reached two? Second pass: the block meets its answers,
and only its windows whose every counter reached two are grouped exactly, by a 64-bit hash and 32 bits of an independent one; no
repeated window is lost. A window counts as repeated when at least two documents hold it. The result are the maximal spans covered by repeated windows.

The sketch has ``PER_WINDOW`` counters a row for every word of the corpus, so its error rate is the same at any size. It is never
put together anywhere: counters travel sparse (the gaps between those in use, about a byte each), answers as bits, and the block's
text travels compressed to its answers, once. Nothing is broadcast or sent to the driver but the corpus' number of bytes.

A block is found again by its place in the scan and a sum over its windows' hashes. If the second scan gives other blocks than the
first (rows in another order, as an unordered shuffle above may), a block without matching answers sends all its windows, so the result never depends on it.

Defined results: null and empty texts and texts shorter than a window have no spans; a window repeated only inside one document is no
repeat; rows with a null doc_id count as one unnamed document and are not returned; rows repeating a doc_id are one document;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, cogroup_arrow, group_arrow, map_arrow, pack_gaps, pack_ints, row_blocks, text_bytes, unpack_gaps, unpack_ints
from .textscan import mix, slices, windows, words

WINDOW, ROWS, PER_WINDOW = 50, 2, 2
#: Counters of a segment, words of a bucket of the exact grouping, bytes of text of a block.
SEGMENT, BUCKET_WORDS, BLOCK_BYTES = 8_000_000, 2_000_000, 6 << 20
#: Beyond so many buckets they get larger instead, or a block would send each only a few windows.
MOST_BUCKETS = 65_536
NO_DOCUMENT = -(2**63)
EMITTED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("h", "second", "place", "ids", "firsts"))])
_SLICE = 1 << 20


def _counter(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """The counter of each window in one row of the sketch, counted over all rows."""
    x = h if row == 0 else mix(h + np.uint64(row * 0x9E3779B97F4A7C15 % 2**64))
    high, low = x >> np.uint64(32), np.uint64(width)
    # (high * width) >> 32 without overflow at any width
    return ((high * (low >> np.uint64(32))) + ((high * (low & np.uint64(0xFFFFFFFF))) >> np.uint64(32)) + np.uint64(row * width)).astype(np.int64)


def _pieces(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, byte offsets, bytes) of about ``_SLICE`` bytes each; a row is never split."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE, "right")) - 1)
        yield at, end, offsets[at : end + 1] - offsets[at], data[offsets[at] : offsets[end]]
        at = end


def _lowered(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets, bytes) of the lower-cased texts of a block."""
    parts = [(o, d) for chunk in column.chunks for _, _, o, d in slices(chunk)]
    starts = np.cumsum([0, *(len(d) for _, d in parts)])
    return np.concatenate([[0], *(o[1:] + s for (o, _), s in zip(parts, starts))]).astype(np.int64), np.concatenate([d for _,
            d in parts] or [np.empty(0, np.uint8)])


def _block_key(number: int) -> int:
    return (TaskContext.get().partitionId() << 32) | number


def _sum(h: np.ndarray) -> int:
    return int(np.add.reduce(h, dtype=np.uint64).view(np.int64)) if len(h) else 0


class Sketch:
    """The geometry of the sketch; no counters."""

    def __init__(self, n_words: int, rows: int, per_window: int):
        self.rows, self.width = rows, per_window * n_words
        self.segments = max(16, rows * self.width // SEGMENT + 1)
        self.length = -(-rows * self.width // self.segments)

    def used(self, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(the sorted counters that windows use, each once or twice, by row the place of each window's counter among the distinct ones)."""
        held, places, base = [], [], 0
        for r in range(self.rows):
            c = _counter(h, r, self.width)
            order = np.argsort(c)
            c = c[order]
            new, third = np.ones(len(c), bool), np.zeros(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            third[2:] = c[2:] == c[:-2]  # counters are full at two
            place = np.empty(len(c), np.int64)
            place[order] = np.cumsum(new) - 1 + base
            base += int(new.sum())
            held.append(c[~third])
            places.append(place)
        return np.concatenate(held), places


def answers(docs: DataFrame, sketch: Sketch, window: int, block_bytes: int) -> DataFrame:
    """(block, segment, check, bits): for every distinct counter of the segment that the block uses, in order, whether it reached two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in row_blocks(batches, 0, block_bytes):
            h = np.concatenate([windows(*words(o, d), window)[0] for _, _, o, d in _pieces(*_lowered(block.column(0)))] or [np.empty(0, np.uint64)])
            if not len(h):
                continue
            at, _ = sketch.used(h)
            ends = np.searchsorted(at, np.arange(sketch.segments + 1) * sketch.length)
            used = np.flatnonzero(np.diff(ends))
            n, own = len(used), _sum(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(np.full(n, _block_key(number)), pa.int64()),
                        pa.array(np.full(n, own), pa.int64()), blobs([pack_gaps(at[ends[s] : ends[s +
                                1]] - s * sketch.length) for s in used])],
                names=["segment", "block", "check", "counters"],
            )

    def merge(t: pa.Table) -> pa.Table:
        count, asked = np.zeros(sketch.length, np.uint8), []
        for blob in t.column("counters"):
            at = unpack_gaps(blob.as_py())
            again = np.zeros(len(at), bool)
            again[1:] = at[1:] == at[:-1]
            for x in (at[~again], at[again]):
                count[x] = np.minimum(count[x] + 1, 2)
            asked.append(at[~again].astype(np.int32))
        return pa.table({"block": t.column("block"), "segment": t.column("segment"), "check": t.column("check"),
                "n": pa.array([len(x) for x in asked], pa.int32()),
                "bits": blobs([np.packbits(count[x] == 2).tobytes() for x in asked])})

    sent = map_arrow(docs.select("text"), count, "segment int, block bigint, check bigint, counters binary")
    return group_arrow(sent, "segment", merge, "block bigint, segment int, check bigint, n int, bits binary")


def _possible(h: np.ndarray, sketch: Sketch, answered: pa.Table) -> np.ndarray:
    """Indices of the windows whose every counter reached two; all of them, if the answers aren't this block's."""
    order = np.argsort(np.asarray(answered.column("segment")))
    own, bits, n = _sum(h), answered.column("bits").to_pylist(), np.asarray(answered.column("n"))
    _, places = sketch.used(h)
    distinct = max((int(p.max()) + 1 for p in places if len(p)), default=0)
    if not len(order) or (np.asarray(answered.column("check")) != own).any() or int(n.sum()) != distinct:
        return np.arange(len(h))
    two = np.concatenate([np.unpackbits(np.frombuffer(bits[i], np.uint8), count=int(n[i])) for i in order]).astype(bool)
    hot = np.ones(len(h), bool)
    for place in places:
        hot &= two[place]
    return np.flatnonzero(hot)


def repeated_windows(docs: DataFrame, window: int = WINDOW, rows: int = ROWS, per_window: int = PER_WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, at): packed start words of the windows that another document holds too, some rows a document."""
    n_words = text_bytes(docs) // 6 + 64
    sketch = Sketch(n_words, rows, per_window)
    buckets = min(MOST_BUCKETS, max(8, n_words // BUCKET_WORDS + 1))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks' texts, lower-cased and compressed, one row a block."""
        for number, block in row_blocks(batches, 1, block_bytes):
            offsets, data = _lowered(block.column("text"))
            ids = np.asarray(block.column("doc_id").fill_null(NO_DOCUMENT))
            yield pa.RecordBatch.from_arrays([pa.array([_block_key(number)], pa.int64()), blobs([pack_ints(ids)]),
                    blobs([pack_ints(offsets)]), blobs([pa.compress(data.tobytes(), codec="zstd", asbytes=True)])],
                names=["block", "ids", "offsets", "text"])

    def emit(block: pa.Table, answered: pa.Table) -> pa.Table:
        """A blob by bucket. ``place`` counts words over all texts of the block, so it rises; a text's id and first word are told once a blob."""
        out = []
        for row in block.to_pylist():
            ids, offsets = unpack_ints(row["ids"]), unpack_ints(row["offsets"])
            data = np.frombuffer(pa.decompress(row["text"], decompressed_size=int(offsets[-1]), codec="zstd", asbytes=True), np.uint8)
            scanned = [(a, b, *words(o, d)) for a, b, o, d in _pieces(offsets, data)]
            found = [windows(wh, bounds, window) for _, _, wh, bounds in scanned]
            hot = _possible(np.concatenate([h for h, _ in found] or [np.empty(0, np.uint64)]), sketch, answered)
            held, base, before = [], 0, 0
            for (first, end, wh, bounds), (h, at) in zip(scanned, found):
                mine = hot[np.searchsorted(hot, before) : np.searchsorted(hot, before + len(h))] - before
                before += len(h)
                if len(mine):
                    # an independent hash: the words' hashes are mixed again before they are summed; kept to 32 bits more
                    other, _ = windows(mix(wh ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds, window)
                    some = np.flatnonzero(np.diff(bounds))  # a text without a word would share its first word with the next
                    held.append((h[mine], (other[mine] >> np.uint64(32)).astype(np.uint32), at[mine] + base, ids[first:end][some], bounds[:-1][some] + base))
                base += len(wh)
            if held:
                out.append(bucketed(*(np.concatenate(x) for x in zip(*held))))
        return pa.concat_tables(out) if out else EMITTED.empty_table()

    def bucketed(h: np.ndarray, second: np.ndarray, place: np.ndarray, ids: np.ndarray, firsts: np.ndarray) -> pa.Table:
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket.astype(np.uint32), kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(ends))
        cut = [order[ends[b] : ends[b + 1]] for b in used]
        texts = [np.unique(np.searchsorted(firsts, place[c], "right") - 1) for c in cut]
        return pa.table([pa.array(used, pa.int32()), blobs([h[c].tobytes() for c in cut]),
                blobs([second[c].tobytes() for c in cut]), blobs([pack_gaps(place[c]) for c in cut]),
                blobs([pack_ints(ids[t]) for t in texts]), blobs([pack_ints(firsts[t]) for t in texts])], schema=EMITTED)

    def located(place: bytes, ids: bytes, firsts: bytes) -> tuple[np.ndarray, np.ndarray]:
        at, starts = unpack_gaps(place), unpack_ints(firsts)
        row = np.searchsorted(starts, at, "right") - 1
        return (at - starts[row]).astype(np.uint32), unpack_ints(ids)[row]

    def group(t: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        h, second = join("h", np.uint64), join("second", np.uint32)
        place, owner = (np.concatenate(x) for x in zip(*map(located, *(t.column(c).to_pylist() for c in ("place", "ids", "firsts")))))
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(h), bool)
        sorted_h = h[order]
        same[1:] = sorted_h[1:] == sorted_h[:-1]
        same[:-1] |= same[1:]
        order = order[same]  # most estimates that were wrong end here
        order = order[np.lexsort((owner[order], second[order], h[order]))]
        h, second, place, owner = h[order], second[order], place[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (second[1:] != second[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(h))
        shared_by_two = owner[starts] != owner[ends - 1] if len(starts) else np.empty(0, bool)
        keep = np.repeat(shared_by_two, ends - starts) & (owner != NO_DOCUMENT)
        owner, place = owner[keep], place[keep]
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
        ends = np.append(cuts[1:], len(owner)) if len(cuts) else cuts
        return pa.table({"doc_id": pa.array(owner[cuts], pa.int64()), "at": blobs([place[a:b].tobytes() for a, b in zip(cuts, ends)])})

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shipped = map_arrow(read, ship, "block bigint, ids binary, offsets binary, text binary")
    packed = cogroup_arrow(shipped, answers(docs, sketch, window, block_bytes), "block", emit,
        "bucket int, h binary, second binary, place binary, ids binary, firsts binary")
    return group_arrow(packed, "bucket", group, "doc_id bigint, at binary")


def spans(positions: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, words) of the unions of overlapping or touching windows that start at ``positions``."""
    at = np.unique(positions).astype(np.int64)
    if not len(at):
        return at, at
    first = np.concatenate([[True], np.diff(at) > window])
    starts = at[first]
    last = at[np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1)]
    return starts, last + window - starts


def repeated_passages(docs: DataFrame, window: int = WINDOW, **sizes) -> DataFrame:
    """(doc_id, start_word, n_words): the maximal spans of each document that repeat in other documents."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(np.frombuffer(b"".join(x), np.uint32), window) for x in batch.column(1).to_pylist()]
            ids = np.repeat(np.asarray(batch.column(0)), [len(s) for s, _ in found])
            starts, lengths = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int32) for x in (([s for s, _ in found]), ([n for _, n in found])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts), pa.array(lengths)], names=["doc_id", "start_word", "n_words"])

    hits = repeated_windows(docs, window, **sizes)
    return map_arrow(hits.groupBy("doc_id").agg(F.collect_list("at").alias("at")), merge, "doc_id bigint, start_word int, n_words int")
