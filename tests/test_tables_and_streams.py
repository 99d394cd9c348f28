from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioflow.operators import export, rollups
from folioflow.operators import tables as T
from folioflow.operators import transcripts as R
from folioflow.sources import readers
from folioflow.streaming import streams

NOW = dt.datetime(2024, 5, 1)
QUEUE = "run_id string, status string, attempts int, available_at timestamp_ntz, locked_at timestamp_ntz, locked_by string, updated_at timestamp_ntz, last_error string"


def now():
    return F.lit(NOW.isoformat()).cast("timestamp_ntz")


def test_guarded_upsert_leaves_frozen_rows(spark):
    old = spark.createDataFrame([(1, "canceled"), (2, "running")], "id int, status string")
    new = spark.createDataFrame([(1, "done"), (2, "done"), (3, "new")], "id int, status string")
    assert sorted(map(tuple, T.guarded_upsert(old, new, ["id"], F.col("status") == "canceled").collect())) == [(1, "canceled"), (2, "done"), (3, "new")]


def test_queue_lease_and_retry(spark):
    h = dt.timedelta(hours=1)
    queue = spark.createDataFrame([("free", "queued", 0, NOW - h, None, None, NOW - h, None), ("leased", "running", 1, NOW - h, NOW + h, "w1", NOW - 3 * h, None), ("expired", "running", 2, NOW - h, NOW - h, "w1", NOW - 2 * h, None), ("later", "retry", 1, NOW + h, None, None, NOW - 4 * h, None), ("gone", "queued", 0, NOW - h, None, None, NOW - 9 * h, None)], QUEUE)
    runs = spark.createDataFrame([(r, "canceled" if r == "gone" else "running") for r in ("free", "leased", "expired", "later", "gone")], "run_id string, status string")
    got = T.claim(queue, runs, "w2", now(), 30).first()
    assert (got["run_id"], got["attempts"], got["locked_by"], got["locked_at"]) == ("expired", 3, "w2", NOW + dt.timedelta(seconds=30))
    failed = T.fail(queue, spark.createDataFrame([("leased", "w1", "boom"), ("expired", "w2", "boom")], "run_id string, worker string, error string"), 3, now())
    by = {r["run_id"]: r for r in failed.collect()}
    assert by["leased"]["status"] == "retry" and by["leased"]["available_at"] == NOW + dt.timedelta(seconds=1) and by["leased"]["last_error"] == "boom"
    assert by["expired"]["status"] == "running"  # another worker's lease


def brute_limit(rows, limit):
    state, out = {}, {}
    for user, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        start, used = state.get(user, (None, 0))
        if start is None or t - start >= 60:
            state[user], out[i] = (t, 1), True
        else:
            out[i] = used < limit
            state[user] = (start, used + (used < limit))
    return out


def test_rate_limit_batch_and_stream_agree(spark, tmp_path):
    rows = [(i % 3, i, float((i * 37) % 400)) for i in range(120)]
    df = spark.createDataFrame([(u, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)) for u, i, t in rows], "user int, id int, at timestamp_ntz")
    want = brute_limit(rows, 2)
    assert {r["id"]: r["allowed"] for r in streams.rate_limit(df, "user", "at", "id", 2).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {}
    stream = streams.rate_limit_stream(streams.event_tail(spark, str(tmp_path / "in"), df.schema), "user", "at", "id", 2)
    streams.drain(stream, lambda b, _n: got.update({r["id"]: r["allowed"] for r in b.collect()}), str(tmp_path / "cp"))
    assert got == want


def test_queue_stream_equals_batch(spark, tmp_path):
    rows = [(i % 4, i, ("enqueue", "claim", "fail", "claim", "complete")[i // 4 % 5], "w", None if i % 2 else "e") for i in range(60)]
    df = spark.createDataFrame(rows, "run_id int, seq int, command string, worker string, error string")
    want = {r["run_id"]: tuple(r) for r in streams.queue_states(df).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {}
    streams.drain(streams.queue_stream(streams.event_tail(spark, str(tmp_path / "in"), df.schema)), lambda b, _n: got.update({r["run_id"]: tuple(r) for r in b.collect()}), str(tmp_path / "cp"), "update")
    assert got == want


SRT = "1\n00:00:01,000 --> 00:00:03,500\nAda: First point is\n\n2\n00:00:04,000 --> 00:00:06,000 align:start\nmade by Dr. Who. <i>Second</i> point\n\n3\n00:00:06,000 --> 00:00:09,000\nspans two segments.\n"


def test_transcripts():
    segs = R.parse(SRT)
    assert [(s["text"], s["start_seconds"], s["speaker"]) for s in segs] == [("First point is", 1.0, "Ada"), ("made by Dr. Who. Second point", 4.0, None), ("spans two segments.", 6.0, None)]
    assert R.parse("WEBVTT\n\n00:01.000 --> 00:02.000\n<v Ada>Hi &amp; bye</v>")[0] == {"text": "Hi & bye", "start_seconds": 1.0, "duration_seconds": 1.0, "speaker": "Ada"}
    assert len(R.merge(segs)) == 1 and not R.ends_sentence("ask Dr.") and R.ends_sentence("Done.") and not R.ends_sentence("costs 1.5")
    hit = R.find_quote(segs, "second point spans two segments")
    assert (hit["start_seconds"], hit["end_seconds"], hit["start_segment_index"], hit["end_segment_index"], hit["strategy"], hit["confidence"]) == (4.0, 9.0, 1, 2, "exact-normalized", 1.0)
    assert R.find_quote(segs, "seconde pointe span two segment", 0.55)["strategy"] == "fuzzy-window" and R.find_quote(segs, "zzz qqq", 0.78) is None
    with pytest.raises(ValueError):
        R.find_quote(segs, " ")


def test_render_and_parse_round_trip(spark):
    df = spark.createDataFrame([(1, SRT)], "id int, t string").select(R.parse_column(F.col("t")).alias("s"))
    for form in ("srt", "vtt"):
        again = df.select(R.parse_column(R.render_column(F.col("s"), form)).alias("r"), "s").first()
        assert again["r"] == again["s"]
    with pytest.raises(ValueError):
        R.render_column(F.col("s"), "doc")


def test_extraction_by_kind(spark, tmp_path):
    for name, data in {"a.txt": b"plain", "b.json": b'{"k":1}', "c.srt": SRT.encode(), "d.html": b"<p>x</p>", "e.md": b"PK\x03\x04zip", "f.csv": b"a\x00b", "g.txt": b"  ", "h.json": b'{"generated_by": "folioflow", "artifact_type": "import-report"}', "i.doc": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    files = readers.discover(spark, str(tmp_path))
    got = {r["source_path"].rsplit("/", 1)[1]: (r["status"], r["failure"], r["text"]) for r in readers.extract(files).collect()}
    assert got["a.txt"] == ("converted", None, "plain") and got["b.json"][2] == '{\n  "k": 1\n}' and got["d.html"][2] == "x" and "Ada: First point" in got["c.srt"][2]
    assert got["e.md"][0] == got["f.csv"][0] == "failed" and got["g.txt"][1] == "empty-output" and "h.json" not in got and "i.doc" not in got


def test_extraction_cache_and_resume(spark):
    files = spark.createDataFrame([("x/a.txt", bytearray(b"one")), ("x/b.txt", bytearray(b"two")), ("x/c.txt", bytearray(b" "))], "source_path string, content binary")
    cache = spark.createDataFrame([], "content_sha256 string, config_signature string, source_extension string, text string")
    sig = readers.config_signature({"v": 1})
    out, new = readers.extract_cached(files, cache, sig)
    assert out.count() == 3 and new.count() == 2
    _, again = readers.extract_cached(files, new, sig)
    assert again.count() == 0 and readers.extract_cached(files, new, readers.config_signature({"v": 2}))[1].count() == 2
    manifest = spark.createDataFrame([("x/a.txt", "ingested"), ("x/b.txt", "failed")], "source_path string, status string")
    got = {r["source_path"]: r["status"] for r in readers.import_files(files, manifest).collect()}
    assert got == {"x/a.txt": "skipped", "x/b.txt": "ingested", "x/c.txt": "failed"}


def test_paths_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a.md"), (2, "a.md"), (3, "b.md")], "id int, path string")
    named = readers.unique_paths(df, "path", "id").withColumn("content", F.lit("é"))
    assert sorted(r["path"] for r in named.collect()) == ["a-2.md", "a.md", "b.md"]
    assert {r["bytes"] for r in readers.write_files(named, root=str(tmp_path)).collect()} == {2} and (tmp_path / "a-2.md").read_text() == "é"


def test_bundle(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, f"f{i}.pdf", "Body text.", at, "610", None, "Sum. More.", "Same title", ["t"], None, "Acme", "acme-x", "X", f"2024-0{3 - i}", 0.5) for i in range(3)]
    src = spark.createDataFrame(rows, "document_id int, filename string, text string, created_at timestamp_ntz, code string, label string, summary string, title string, tags array<string>, description string, issuer string, series_key string, series_title string, period string, confidence double")
    files = {r["path"]: r["content"] for r in export.bundle(src).collect()}
    base = "600-technology/610-medicine-health/"
    assert {base + "same-title.md", base + "same-title-2.md", base + "same-title-3.md", base + "index.md", "600-technology/index.md", "index.md"} == set(files)
    one = files[base + "same-title.md"]
    assert one.startswith('---\ntype: "PDF Document"\ntitle: "Same title"\ndescription: "Sum."') and one.index("2024-01](") < one.index("2024-02](") and "3 concept(s)" in files["index.md"]


def test_rollups(spark):
    pages = spark.createDataFrame([("succeeded", "ocr", 80.0, True, 2, 5.0), ("pending", "embedded", None, False, -1, 7.0)], "status string, source string, confidence double, corrected boolean, attempts int, duration_ms double").withColumn("m", F.lit(1))
    r = rollups.page_summary(pages, ["m"]).first()
    assert (r["status"], r["pages"], r["attempts"], r["ocr_pages"], r["corrected_pages"], r["average_confidence"], r["max_duration_ms"]) == ("pending", 2, 2, 1, 1, 80.0, 7.0)
    tries = spark.createDataFrame([(1, 0, None, "a"), (1, 90, 50.0, "b"), (1, 180, 50.0, "c")], "page int, rotation int, confidence double, text string")
    assert rollups.best_rotation(tries, ["page"]).first()["rotation"] == 90
    assert rollups.ratio(F.lit(1), F.lit(0)) is not None
    line = rollups.prometheus(spark.createDataFrame([('a"b', 2)], "l string, v int"), "m", "v", ["l"]).first()[0]
    assert line == 'm{l="a\\"b"} 2'
