"""Quality rules by tokeniser fertility.

A public byte-level vocabulary gives characters per token and the entropy of the token distribution; a vocabulary with
byte fallback gives the share of tokens it can only spell as bytes. A text is rejected when a measure lies outside the
band of its language (its script where ``lang`` is null) and length: the measures of short texts scatter more, and entropy
falls with length. The bands are robust: median plus or minus ``width`` times the median absolute deviation of all texts of
that language whose number of tokens has the same power of two; with fewer than ``MIN_GROUP`` such texts, of all texts of the language.
Each distinct text counts once, however many documents hold it: a text with very many copies would set the median and a deviation of 0.
Copies that differ in a character count as texts of their own.

* ``chars_per_token``: characters without white space by tokens, white space being folded to one blank before.
* ``byte_share``: byte tokens by tokens of the fallback vocabulary. Line ends count as blanks, so only characters that
  the vocabulary lacks fall back.
* ``token_entropy``: entropy of the text's token distribution by log2 of its number of tokens, so 0..1 at any length.

Defined results: null and empty texts, and texts of white space only, have 0 tokens and null measures and are rejected;
texts of fewer than ``min_tokens`` tokens are judged by byte_share alone, since the other measures of so short a
text are noise; repeated rows are judged alike, each for itself; an empty table gives an empty result. ``keep_good`` gives the documents
back with all their columns as they came, whatever their names; ``judge`` replaces columns named band, n_tokens, reason or like a measure. Whole texts are encoded, white-space aligned pieces of at most
``PIECE`` characters at a time, which bounds the encoder's memory.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, split_batch

TOKENIZERS = "/opt/tokenizers"
MIN_TOKENS, MIN_GROUP, WIDTH, PIECE = 32, 30, 6.0, 100_000
#: The least half-width of a band, so that a language whose texts are all alike does not reject a slight difference.
FLOOR = {"chars_per_token": 0.15, "byte_share": 0.01, "token_entropy": 0.03}
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
BROADCAST_BANDS = 100_000
#: Measures are compared and counted at this step.
STEP = 0.001
#: The column that tells texts apart.
TEXT_KEY = "_text_key"
FILES = ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model")
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A row of the input while it is measured.
ROW = "row"


def read_vocabularies(folder: str = TOKENIZERS) -> tuple[bytes, bytes]:
    """The two vocabulary files, about 1.4 MB, read on the driver and broadcast: executors need no copy of the folder. A missing file raises."""
    byte_level, pieces = ((Path(folder) / name).read_bytes() for name in FILES)
    return byte_level, pieces


@lru_cache(maxsize=2)
def _encoders(files: tuple[bytes, bytes]):
    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, files[0].splitlines())}
    byte_level = tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    is_byte = np.array([pieces.IsByte(i) for i in range(pieces.GetPieceSize())])
    known = {" "} | {p for p in (pieces.IdToPiece(i) for i in range(pieces.GetPieceSize())) if len(p) == 1}
    unknown = re.compile("[^" + "".join(re.escape(c) for c in sorted(known)) + "]")
    return byte_level, pieces, is_byte, unknown


def _parts(text: str) -> list[str]:
    parts, at = [], 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        cut = at + PIECE if cut < 0 else cut
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def measure(texts: list[str | None], files: tuple[bytes, bytes]) -> tuple[np.ndarray, ...]:
    """(tokens, chars_per_token, byte_share, token_entropy) of every text; measures are NaN where there is no token."""
    byte_level, pieces, is_byte, unknown = _encoders(files)
    flat = [" ".join((x or "").split()) for x in texts]
    encoded = [[byte_level.encode_to_numpy(p, disallowed_special=()) for p in _parts(x)] if x else [] for x in flat]
    tokens = np.array([sum(map(len, e)) for e in encoded], np.int64)
    chars = np.array([len(x) - x.count(" ") for x in flat], np.float64)
    share = np.zeros(len(flat))
    for i, x in enumerate(flat):
        if x and unknown.search(x):
            ids = [np.asarray(pieces.encode(p, num_threads=1), np.int64) for p in _parts(x)]
            share[i] = sum(int(is_byte[k].sum()) for k in ids) / max(1, sum(map(len, ids)))
    ids = np.concatenate([p for e in encoded for p in e] or [np.empty(0, np.uint32)]).astype(np.int64)
    keys = np.sort((np.repeat(np.arange(len(flat), dtype=np.int64), tokens) << 20) | ids)
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(at, append=len(keys)).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.bincount(keys[at] >> 20, counts * np.log2(counts), len(flat)) if len(keys) else np.zeros(len(flat))
        entropy = np.where(tokens > 1, (np.log2(tokens) - spread / tokens) / np.log2(np.maximum(tokens, 2)), 1.0)
        per_token = chars / tokens
    nothing = tokens == 0
    return tokens, *(np.where(nothing, np.nan, np.round(x / STEP) * STEP) for x in (per_token, share, entropy))


def with_measures(docs: DataFrame, folder: str = TOKENIZERS, text: Callable[[pa.RecordBatch], pa.Array] = lambda batch: batch.column("text")) -> DataFrame:
    """``docs`` with n_tokens and the measures; one pass, no shuffle. ``text`` takes the texts out of a batch."""
    rest = docs.drop("n_tokens", *MEASURES)
    schema = T.StructType([*rest.schema.fields, T.StructField("n_tokens", T.LongType()), *(T.StructField(m, T.DoubleType()) for m in MEASURES)])
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabularies(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in split_batch(whole, text(whole))):
            tokens, *rest = measure(text(batch).to_pylist(), shared.value)
            more = [pa.array(tokens, pa.int64()), *(pa.array(x, pa.float64(), from_pandas=True) for x in rest)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "n_tokens", *MEASURES])

    return map_arrow(rest, run, schema)


def text_key() -> Column:
    return F.xxhash64("text").alias(TEXT_KEY)


def group_of() -> Column:
    """The language, or where it is null the script of most letters."""
    count = lambda script: F.regexp_count("text", F.lit(rf"\p{{Is{script}}}"))
    scripts = ("Latin", "Cyrillic", "Greek", "Arabic", "Han", "Hangul", "Devanagari")
    most = F.array_max(F.array(*(F.struct(count(s).alias("n"), F.lit(f"script:{s}").alias("name")) for s in scripts)))
    return F.when(F.col("lang").isNotNull(), F.col("lang")).when(F.length(F.coalesce("text", F.lit(""))) == 0, "script:none").otherwise(most["name"])


def octave_of() -> Column:
    return F.concat_ws(":", "band", F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))).cast("string"))


def _median(binned: DataFrame, value: str) -> DataFrame:
    """Lower median by (band, measure) of a histogram. Its rows are languages times steps in use, so a window is enough."""
    w = Window.partitionBy("band", "measure")
    run = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return binned.withColumns({"run": run, "all": F.sum("n").over(w)}).where("run * 2 >= all").groupBy("band", "measure").agg(F.min(value).alias("median"))


def bands(measured: DataFrame, width: float = WIDTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(band, n, measure -> lo, hi) by language or script, and by these and octave of length: median -+ width * MAD, over all texts of enough tokens.

    Rows of the same ``TEXT_KEY``, where there is one, count once.
    """
    texts = measured.where(F.col("n_tokens") >= min_tokens)
    if TEXT_KEY in measured.columns:
        texts = texts.select(TEXT_KEY, "band", "n_tokens", *MEASURES).dropDuplicates([TEXT_KEY, "band"])
    long = texts.select(F.explode(F.array("band", octave_of())).alias("band"),
        F.posexplode(F.array(*(F.round(F.col(m) / STEP).cast("bigint") for m in MEASURES))).alias("measure", "step"))
    binned = materialize(long.groupBy("band", "measure", "step").agg(F.count(F.lit(1)).alias("n")), "fertility-bins")
    middle = _median(binned, "step")
    off = binned.join(middle, ["band", "measure"]).withColumn("off",
        F.abs(F.col("step") - F.col("median"))).groupBy("band", "measure", "off").agg(F.sum("n").alias("n"))
    mad = _median(off, "off").withColumnRenamed("median", "mad")
    floor = F.element_at(F.array(*(F.lit(FLOOR[m] / STEP) for m in MEASURES)), F.col("measure") + 1)
    half = F.greatest(F.lit(width) * F.col("mad"), floor)
    sizes = binned.groupBy("band", "measure").agg(F.sum("n").alias("n"))
    joined = middle.join(mad, ["band", "measure"]).join(sizes, ["band", "measure"]).select("band", "measure", "n",
        (F.col("median") - half).alias("lo"), (F.col("median") + half).alias("hi"))
    ends = [e for i, m in enumerate(MEASURES) for e in (F.max(F.when(F.col("measure") == i, F.col("lo"))).alias(f"{m}_lo"),
            F.max(F.when(F.col("measure") == i, F.col("hi"))).alias(f"{m}_hi"))]
    return materialize(joined.groupBy("band").agg(F.max("n").alias("n"), *ends), "fertility-bands")


def judged(measured: DataFrame, limits: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``measured`` with ``reason``: null, or the first rule broken. A band that no text could set rejects nothing.

    ``limits`` has a row for each language or script and octave of length; it is broadcast if these number at most ``BROADCAST_BANDS`` (about 15 MB), else joined by shuffle.
    """
    sent = F.broadcast if limits.count() <= BROADCAST_BANDS else lambda side: side
    names = [f"{m}_{e}" for m in MEASURES for e in ("lo", "hi")]
    wide = limits.select("band", *(F.col(c).alias(f"all_{c}") for c in names))
    near = limits.where(F.col("n") >= MIN_GROUP).select(F.col("band").alias("_octave"), *names)
    step = lambda m: F.round(F.col(m) / STEP)
    end = lambda c: F.coalesce(F.col(c), F.col(f"all_{c}"))
    long = F.col("n_tokens") >= min_tokens
    reason = (
        F.when(F.col("n_tokens") == 0, "empty")
        .when(step("byte_share") > F.greatest(end("byte_share_hi"), F.lit(FLOOR["byte_share"] / STEP)), "byte_share")
        .when(long & ~step("chars_per_token").between(end("chars_per_token_lo"), end("chars_per_token_hi")), "chars_per_token")
        .when(long & (step("token_entropy") < end("token_entropy_lo")), "token_entropy")
    )
    joined = measured.withColumn("_octave", octave_of()).join(sent(near), "_octave", "left").join(sent(wide), "band", "left")
    return joined.select(*measured.columns, reason.alias("reason"))


def judge(docs: DataFrame, folder: str = TOKENIZERS, width: float = WIDTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Every document with band, measures and reason. Tokenises once: the measured rows are written before the bands are counted."""
    measured = materialize(with_measures(docs.drop("band", "reason").withColumns({"band": group_of(), TEXT_KEY: text_key()}), folder), "fertility")
    return judged(measured, bands(measured, width, min_tokens), min_tokens).drop(TEXT_KEY)


def keep_good(docs: DataFrame, folder: str = TOKENIZERS, width: float = WIDTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The documents inside the bands. Their columns travel as one struct, so that no name of theirs meets one of the measures."""
    packed = docs.select(F.struct(*docs.columns).alias(ROW), group_of().alias("band"), text_key())
    at = docs.columns.index("text")
    measured = materialize(with_measures(packed, folder, lambda batch: batch.column(0).field(at)), "fertility")
    return judged(measured, bands(measured, width, min_tokens), min_tokens).where(F.col("reason").isNull()).select(f"{ROW}.*")
