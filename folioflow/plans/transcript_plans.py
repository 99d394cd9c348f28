"""Transcripts over the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import transcripts as R
from .base import SEGMENTS, query, segment_arrays, segments, table

KEY = ("document_id", "seg")


@query(f"WITH {SEGMENTS}, n AS (SELECT *, lead(start_seconds) OVER (PARTITION BY document_id ORDER BY seg) AS next FROM segs) SELECT document_id, seg, CASE WHEN duration_seconds <= 1 AND next > start_seconds THEN greatest(next - start_seconds, 0.001::double) ELSE duration_seconds END AS duration_seconds FROM n")
def segment_durations(spark: SparkSession, d: str) -> DataFrame:
    return R.infer_durations(segments(spark, d), *KEY).select("document_id", "seg", "duration_seconds")


_PLAIN = r"trim(regexp_replace(regexp_replace(lower(text), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"WITH {SEGMENTS}, p AS (SELECT document_id, seg, {_PLAIN} AS plain FROM segs), o AS (SELECT *, coalesce(sum(length(plain) + 1) OVER (PARTITION BY document_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start_pos FROM p) SELECT document_id, seg, plain, start_pos, start_pos + length(plain) AS end_pos FROM o")
def segment_offsets(spark: SparkSession, d: str) -> DataFrame:
    return R.offsets(segments(spark, d), *KEY).select("document_id", "seg", "plain", "start_pos", "end_pos")


@query("WITH t AS (SELECT conv_id, turn, turn * 725 + conv_id % 60 AS s FROM conversations) SELECT conv_id AS document_id, turn AS seg, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS compact, printf('%02d:%02d:%02d,%03d', s // 3600, s // 60 % 60, s % 60, turn * 125 % 1000) AS srt, printf('%02d:%02d:%02d.%03d', s // 3600, s // 60 % 60, s % 60, turn * 125 % 1000) AS vtt FROM t")
def timestamp_format(spark: SparkSession, d: str) -> DataFrame:
    """Compact, SRT and VTT form of times up to an hour and beyond."""
    s = (F.col("turn") * 725 + F.col("conv_id") % 60).cast("double")
    exact = s + F.col("turn") * 125 % 1000 / 1000.0
    return table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("seg"),
        X.compact_time(s + 0.9).alias("compact"), X.srt_time(exact).alias("srt"), X.srt_time(exact, ".").alias("vtt"))


@query("SELECT conv_id AS document_id, turn AS seg, (turn * 3661 + 0.5::double) AS seconds FROM conversations")
def timestamp_parse(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.concat_ws(":", F.col("turn").cast("string"), F.col("turn").cast("string"), F.concat(F.col("turn").cast("string"), F.lit(",5")))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("seg"), X.seconds_of(stamp).alias("seconds"))


@query(rf"""WITH {SEGMENTS} SELECT document_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY seg) AS content FROM segs GROUP BY document_id""")
def transcript_txt(spark: SparkSession, d: str) -> DataFrame:
    return segment_arrays(spark, d).select("document_id", R.render_column(F.col("segments"), "txt").alias("content"))


@query(rf"""WITH {SEGMENTS} SELECT document_id, string_agg('- [' || printf('%02d:%02d', start_seconds::int // 60, floor(start_seconds)::int % 60) || '] ' || speaker || ': ' || text, chr(10) ORDER BY seg) AS content FROM segs GROUP BY document_id""")
def transcript_md(spark: SparkSession, d: str) -> DataFrame:
    return segment_arrays(spark, d).select("document_id", R.render_column(F.col("segments"), "md").alias("content"))


@query()
def transcript_merge(spark: SparkSession, d: str) -> DataFrame:
    """Segments joined to sentences."""
    return segment_arrays(spark, d).select("document_id", F.inline(R.merge_column(F.col("segments"))))


@query()
def transcript_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rendered as captions and parsed again."""
    srt = R.render_column(F.col("segments"), "srt")
    return segment_arrays(spark, d).select("document_id", F.inline(R.parse_column(srt)))


_STAMP = lambda t, mark: f"printf('%02d:%02d:%02d{mark}%03d', floor({t})::int // 3600, floor({t})::int // 60 % 60, floor({t})::int % 60, round(({t} - floor({t})) * 1000)::int)"
_SPAN = lambda mark: f"{_STAMP('start_seconds', mark)} || ' --> ' || {_STAMP('(start_seconds + duration_seconds)', mark)} || chr(10) || speaker || ': ' || text"


@query(f"WITH {SEGMENTS} SELECT document_id, string_agg((seg + 1) || chr(10) || {_SPAN(',')}, chr(10) || chr(10) ORDER BY seg) || chr(10) AS srt, 'WEBVTT' || chr(10) || chr(10) || string_agg({_SPAN('.')}, chr(10) || chr(10) ORDER BY seg) || chr(10) AS vtt FROM segs GROUP BY document_id")
def transcript_captions(spark: SparkSession, d: str) -> DataFrame:
    return segment_arrays(spark, d).select("document_id", R.render_column(F.col("segments"), "srt").alias("srt"),
        R.render_column(F.col("segments"), "vtt").alias("vtt"))


_FIELD = "CASE WHEN regexp_matches({0}, '[\",\r\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(f"WITH {SEGMENTS} SELECT document_id, 'start,end,duration_seconds,speaker,text' || chr(13) || chr(10) || string_agg({_STAMP('start_seconds', '.')} || ',' || {_STAMP('(start_seconds + duration_seconds)', '.')} || ',' || printf('%.3f', duration_seconds) || ',' || speaker || ',' || {_FIELD.format('text')}, chr(13) || chr(10) ORDER BY seg) || chr(13) || chr(10) AS content FROM segs GROUP BY document_id")
def transcript_csv(spark: SparkSession, d: str) -> DataFrame:
    return segment_arrays(spark, d).select("document_id", R.render_column(F.col("segments"), "csv").alias("content"))


@query(
    rf"""WITH {SEGMENTS}, p AS (SELECT *, {_PLAIN} AS plain FROM segs), o AS (SELECT *, coalesce(sum(length(plain) + 1) OVER (PARTITION BY document_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS a FROM p),
q AS (SELECT document_id, string_agg(plain, ' ' ORDER BY seg) AS whole, string_agg(plain, ' ' ORDER BY seg) FILTER (seg BETWEEN 1 AND 2) AS quote FROM p GROUP BY 1),
m AS (SELECT document_id, strpos(whole, quote) - 1 AS pos, length(quote) AS n FROM q WHERE quote <> ''),
s AS (SELECT o.document_id, min(seg) FILTER (pos >= a AND pos < a + length(plain)) AS first, min(seg) FILTER (pos + n > a AND pos + n <= a + length(plain)) AS last FROM o JOIN m USING (document_id) GROUP BY 1)
SELECT s.document_id, first::int AS start_segment_index, last::int AS end_segment_index, min(start_seconds) AS start_seconds, max(start_seconds + duration_seconds) AS end_seconds, 'exact-normalized' AS strategy, 1.0::double AS confidence FROM s JOIN segs g ON g.document_id = s.document_id AND g.seg BETWEEN first AND last GROUP BY ALL"""
)
def quote_exact(spark: SparkSession, d: str) -> DataFrame:
    """The second and third turn of a conversation, with a dash between them, as a quote from it: where it stands."""
    a = segment_arrays(spark, d)
    quote = F.array_join(F.transform(F.slice("segments", 2, 2), lambda s: s["text"]), " - ")
    return a.select("document_id", R.match_column(F.col("segments"),
            quote).alias("m")).where("m IS NOT NULL").select("document_id", "m.start_segment_index", "m.end_segment_index",
        "m.start_seconds", "m.end_seconds", "m.strategy", "m.confidence")


@query(rf"""WITH {SEGMENTS} SELECT document_id, text AS quote, printf('%02d:%02d', 0, floor(start_seconds)::int) AS start, strategy, matched FROM (SELECT document_id, seg, text, start_seconds, 'exact-normalized' AS strategy, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\s+([,.;:!?])', '', 'g') AS matched FROM segs WHERE seg = 0) WHERE trim(regexp_replace(regexp_replace(lower(text), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g')) <> ''""")
def quote_json(spark: SparkSession, d: str) -> DataFrame:
    """The first turn found and told as JSON, read back."""
    a = segment_arrays(spark, d).withColumn("quote", F.col("segments")[0]["text"])
    told = a.select("document_id", R.match_json(F.col("quote"), R.match_column(F.col("segments"), F.col("quote"))).alias("j")).where("j IS NOT NULL")
    return told.select("document_id", F.from_json("j",
            "quote string, matched_text string, start string, strategy string").alias("m")).select("document_id", "m.quote",
        "m.start", "m.strategy", F.col("m.matched_text").alias("matched"))


@query()
def quote_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The whole second turn with its first three characters moved to its end: found by similarity."""
    a = segment_arrays(spark, d)
    said = F.coalesce(F.get("segments", F.lit(1))["text"], F.get("segments", F.lit(0))["text"])
    quote = F.concat(F.substring(said, F.lit(4), F.length(said)), F.lit(" "), F.substring(said, 1, 3))
    return a.select("document_id", R.match_column(F.col("segments"), quote, 0.6).alias("m")).select("document_id",
        "m.start_segment_index", "m.end_segment_index", "m.strategy", "m.confidence")


_QUOTE = "the and of to in"


@query(
    rf"""WITH {SEGMENTS}, w AS (SELECT a.document_id, a.seg AS first, b.seg AS last, string_agg(c.text, ' ' ORDER BY c.seg) AS text FROM segs a JOIN segs b ON a.document_id = b.document_id AND b.seg BETWEEN a.seg AND a.seg + 11 JOIN segs c ON c.document_id = a.document_id AND c.seg BETWEEN a.seg AND b.seg GROUP BY 1, 2, 3),
p AS (SELECT document_id, first, last, {_PLAIN} AS plain FROM w) SELECT document_id, first, last, round(len(list_intersect(string_split('{_QUOTE}', ' '), string_split(plain, ' '))) / 5.0, 6)::double AS overlap, length(plain) AS n_chars FROM p"""
)
def quote_window_overlap(spark: SparkSession, d: str) -> DataFrame:
    return R.windows(segments(spark, d), *KEY, _QUOTE).withColumn("overlap", F.round("overlap", 6))
