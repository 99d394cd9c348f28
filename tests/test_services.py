"""Files, names, backups, scans, model calls, jobs: what the registered queries don't reach."""

from __future__ import annotations

import json
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import backup, evaluation, export, jobs, manifests, names, process, scans, service, transcripts
from folioflow.operators import tables as T
from folioflow.sources import readers


def test_names_never_meet(spark):
    rng = random.Random(1)
    for _ in range(6):
        rows = [(i, rng.choice("pq"), rng.choice(["a", "a-2", "a-3", "a-2-2", "b", "a-1", "a-02", None])) for i in range(60)]
        there = [("p", "a"), ("p", "a-4"), ("q", "zz"), ("q", None)]
        df = spark.createDataFrame(rows, "id int, box string, name string")
        taken = spark.createDataFrame(there, "box string, name string")
        got = names.with_free_names(df, ["box"], "name", "id", taken).collect()
        made = [(r["box"], r["name"]) for r in got]
        assert len(set(made)) == len(rows) == len(made) and not set(made) & set(there)
        first = {}
        for i, box, name in rows:
            first.setdefault((box, name), i)
        assert all((r["box"], r["name"]) == k for r in got for k, i in first.items() if r["id"] == i and k not in there)


def test_concepts_and_paths_of_the_verdict(spark):
    paths = spark.createDataFrame([(1, "x.md"), (2, "x.md"), (3, "x-2.md")], "n int, p string")
    assert [r["p"] for r in readers.unique_paths(paths, "p", "n").orderBy("n").collect()] == ["x.md", "x-3.md", "x-2.md"]
    rows = [(i, t) for i, t in enumerate(["a", "a", "a 2", "a 2 2"])]
    docs = spark.createDataFrame(rows, "document_id int, title string").withColumns({"code": F.lit("610"), "label": F.lit("x"), "filename": F.lit("f.txt"), "summary": F.lit("s"), "description": F.lit("d"), "created_at": F.lit("2024-01-01").cast("timestamp_ntz")})
    made = [r["path"] for r in export.concepts(docs).collect()]
    assert len(set(made)) == 4


def test_discovery_and_import(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"b.TXT": b"text b", "a.md": b"# A", "sub/c.json": b'{"x": 1}', "sub/bad.txt": b"\xff\xfe\x00", "sub/d.bin": b"\x00\xff", "gone/e.txt": b"e", "conv.md": b"converted", "conv.md.json": json.dumps({"generated_by": "folioflow", "artifact_type": "conversion-sidecar"}).encode(), "report.json": json.dumps({"generated_by": "folioflow", "artifact_type": "import-report", "items": ["x" * 70000]}).encode(), "other.json": json.dumps({"artifact_type": "import-report"}).encode()}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    short = lambda df: [r["source_path"].split(tmp_path.name + "/")[1] for r in df.collect()]
    found = readers.discover(spark, str(tmp_path), excluded=(f"{tmp_path}/gone",), ordered=True)
    assert short(found) == ["a.md", "b.TXT", "other.json", "sub/bad.txt", "sub/c.json"]
    assert set(short(readers.discover(spark, str(tmp_path), allowed_root=f"{tmp_path}/sub"))) == {"sub/c.json", "sub/bad.txt"}
    assert short(readers.discover(spark, str(tmp_path), recursive=False, supported=("md",))) == ["a.md"]
    got = {r["source_path"].rsplit("/", 1)[1]: r for r in readers.import_files(found, mode="convert").collect()}
    assert got["bad.txt"]["status"] == "failed" and got["a.md"]["text"] == "# A" and got["c.json"]["text"] == '{\n  "x": 1\n}'
    kinds = spark.createDataFrame([("/x/a.txt", bytearray(b"\xff")), ("/x/b.exe", bytearray(b"\xff\x00")), ("/x/c.txt", bytearray(b"fine")), ("/x/d.pdf", bytearray(b"\xff")), ("/x/e.doc", bytearray(b"1")), ("/x/f.txt", None)], "source_path string, content binary")

    def broken(_: bytes) -> str:
        raise RuntimeError("engine down")

    out = {r["source_path"][-5]: (r["status"], r["error"], r["text"]) for r in readers.extract(kinds, others={"pdf": broken, "doc": broken}, fallback={"pdf": lambda c: f"{len(c)} bytes"}).collect()}
    assert out["a"][:2] == ("failed", "file is not valid UTF-8") and out["b"][1] == "unsupported file extension: exe" and out["c"] == ("converted", None, "fine")
    assert out["d"] == ("converted", None, "1 bytes") and out["e"][1] == "engine down" and out["f"][0] == "failed"
    # what is written can be read again, and an import goes on from it
    manifest = manifests.import_report(readers.import_files(found, mode="convert").select("source_path", F.lit(None).cast("string").alias("converted_path"), "document_id", F.lit(None).cast("string").alias("run_id"), "status", "error"), manifests.IMPORT)
    readers.write_files(manifest.select(F.lit("manifest.json").alias("path"), F.col("json").alias("content")), root=str(tmp_path)).collect()
    again = readers.import_files(readers.discover(spark, str(tmp_path)), readers.read_manifest(spark, str(tmp_path / "manifest.json")), "convert").collect()
    assert {r["status"] for r in again if not r["source_path"].endswith(("bad.txt", "e.txt"))} == {"skipped"}
    assert manifests.manifest_error("m.json", (tmp_path / "manifest.json").read_text()) is None and "origin" in manifests.manifest_error("m.json", "{}") and "non-object" in manifests.manifest_error("m.json", "[]") and "invalid" in manifests.manifest_error("m.json", "{") and ".json" in manifests.manifest_error("m.txt", None)
    assert manifests.budget_error(found, 3, 10**9).startswith("Import contains more than 3 files") and "bytes" in manifests.budget_error(found, 99, 10) and manifests.budget_error(found, 99, 10**9) is None
    assert {r["path"] for r in readers.existing_paths(spark, str(tmp_path / "sub")).collect()} == {f"{tmp_path}/sub/{n}" for n in ("c.json", "bad.txt", "d.bin")}


def test_output_places():
    assert manifests.workspace_output("/d/", "in", "workspace") == ("new-directory", "/d/converted/in") and manifests.workspace_output("/d", None, "workspace")[1] == "/d/converted"
    assert manifests.workspace_output("/d", "in", "original", "/o") == ("original", "/o")
    assert manifests.output_exclusions("/in/", "subdirectory") == ("/in/converted",) and manifests.output_exclusions("/in", "new-directory", "/o") == ("/o",) and manifests.output_exclusions("/in", "original") == ()
    manifests.check_output("/in", "new-directory", "/in/out")
    for bad in ("/in", "/", None):
        with pytest.raises(ValueError):
            manifests.check_output("/in", "new-directory", bad)
    with pytest.raises(ValueError):
        manifests.workspace_output("/d", "in", "workspace", "/o")


def test_backup_restore_compact(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", {"k": 1}), (1, "x", {"k": 1}), (2, None, None)], "i int, s string, m map<string,int>")
    tables = {"a": a, "empty": a.where("false")}
    path = str(tmp_path / "b")
    assert {r["name"]: r["n_rows"] for r in backup.backup(tables, path).collect()} == {"a": 3, "empty": 0}
    with pytest.raises(ValueError):
        backup.backup(tables, path)
    assert sorted(map(str, backup.restore(spark, path)["a"].collect())) == sorted(map(str, a.collect()))
    folder = next(r["folder"] for r in spark.read.parquet(f"{path}/_manifest").collect() if r["name"] == "a")
    a.where("i = 1").write.mode("overwrite").parquet(f"{path}/{folder}")
    assert {r["name"]: r["ok"] for r in backup.verify(spark, path).collect()} == {"a": False, "empty": True}
    with pytest.raises(ValueError, match="a"):
        backup.restore(spark, path)
    spark.range(100).repartition(7).write.parquet(str(tmp_path / "t"))
    assert backup.compact(spark, str(tmp_path / "t")) == 1 and spark.read.parquet(str(tmp_path / "t")).count() == 100
    left = backup.exclusions(spark.createDataFrame([("/d/a",), ("/d/db",), ("/d/db/x",), ("/e/a",)], "path string"), "/d", "/d/db")
    assert [r["path"] for r in left.collect()] == ["/d/a"]


def test_scans(spark):
    page = np.full((60, 80), 255, np.uint8)
    page[10:50:8, 10:70] = 0
    tilted = scans.rotated(page, 3.0)
    assert scans.deskew_score(page, 0, 128) > scans.deskew_score(tilted, 0, 128)
    assert scans.deskew_score(scans.deskewed(tilted, 128), 0, 128) > 1.3 * scans.deskew_score(tilted, 0, 128)
    assert set(np.unique(scans.binarized(np.arange(256, dtype=np.uint8)[None], 100))) == {0, 255} and scans.binarized(np.array([[100, 101]], np.uint8), 100).tolist() == [[0, 255]]
    assert scans.grayscale(np.zeros((2, 2, 3), np.uint8) + np.array([255, 0, 0], np.uint8))[0, 0] == 76
    assert scans.oriented(page, 90, 1.4) is page and scans.oriented(page, 90, 1.5).shape == (80, 60) and scans.deskew_score(np.full((5, 5), 255, np.uint8), 0, 128) == 0

    def ocr(image: np.ndarray) -> tuple[str, float | None]:
        if image.shape[0] == 3:
            raise RuntimeError("no page")
        return f"{image.shape}", {(60, 80): 10.0, (80, 60): 90.0}.get(image.shape)

    rows = [(1, 60, 80, 1, bytearray(page.tobytes())), (2, 80, 60, 1, bytearray(page.T.tobytes())), (3, 3, 3, 1, bytearray(9))]
    got = {r["page"]: r for r in scans.read_pages(spark.createDataFrame(rows, "page int, height int, width int, channels int, pixels binary"), ocr, ["page"]).collect()}
    assert (got[1]["rotation_degrees"], got[1]["confidence"]) == (90, 90.0) and got[2]["rotation_degrees"] == 0 and got[3]["error"] == "no page"
    with pytest.raises(ValueError):
        scans.prepared(page, "sepia")
    pages = spark.createDataFrame([(1, "a  b", 10.0), (2, "c", None), (3, "", 1.0)], "page_number int, text string, confidence double")
    low = {r["page_number"]: r for r in scans.corrected(pages, scans.mock_correction, "low-confidence", 50.0).collect()}
    assert low[1]["text"] == "a b" and low[1]["corrected"] and not low[2]["corrected"] and not low[3]["corrected"] and low[1]["raw_text"] == "a  b"
    every = {r["page_number"]: r for r in scans.corrected(pages, lambda p: F.lit(""), "always", 50.0).collect()}
    assert every[1]["text"] == "a  b" and "empty" in every[1]["error"] and "empty" in every[2]["error"]
    assert "too long" in scans.corrected(pages, scans.mock_correction, "always", 50.0, 2).where("page_number = 1").first()["error"]


def test_model_calls(spark):
    class Busy(Exception):
        status_code = 503

    tries, waits = [], []

    def call(prompt: str) -> str:
        tries.append(prompt)
        if len(tries) < 3:
            raise Busy("token=abc is busy")
        return prompt.upper()

    assert service.with_retries(call, 3, sleep=waits.append)("x") == "X" and len(tries) == 3 and 0.5 <= waits[0] <= 0.55 and 1.0 <= waits[1] <= 1.1
    with pytest.raises(RuntimeError, match=r"after retries: token=\[REDACTED\]"):
        service.with_retries(lambda p: (_ for _ in ()).throw(Busy("token=abc")), 1, sleep=lambda s: None)("x")
    with pytest.raises(RuntimeError, match="request failed: odd"):
        service.with_retries(lambda p: (_ for _ in ()).throw(ValueError("odd")), sleep=lambda s: None)("x")
    df = spark.createDataFrame([("a  b",), (None,)], "p string")
    assert [r[0] for r in df.select(service.model_column(None)(F.col("p"))).collect()] == ["a b", None]
    assert [r[0] for r in df.select(service.model_column(str.upper)(F.col("p"))).collect()] == ["A  B", None]
    with pytest.raises(Exception, match="character limit"):
        df.select(service.model_column(None, 2)(F.col("p"))).collect()


def test_prompts_filters_and_headers(spark, tmp_path):
    (tmp_path / "clean_v1.txt").write_text("Clean this", encoding="utf-8")
    assert service.load_prompt(str(tmp_path), "clean", "v1") == "Clean this"
    assert service.parse_status(None) is None and service.parse_status("ready") == "ready" and service.parse_scope("raw") == "raw"
    assert service.parse_moment("2024-01-01T00:00:00Z").utcoffset().total_seconds() == 0 and service.parse_moment(None) is None
    for bad in (lambda: service.parse_status("x"), lambda: service.parse_scope("x"), lambda: service.parse_moment("x")):
        with pytest.raises(ValueError):
            bad()
    for bad in ("a", "=b"):
        with pytest.raises(Exception, match="OpenTelemetry"):
            spark.range(1).select(service.otel_headers(F.lit(bad))).collect()
    with pytest.raises(KeyError):
        T.lookup(spark.range(1), {"id": 5}, required=True)


def test_context_is_carried_in_turn(spark):
    chunked = spark.createDataFrame([(d, o, f"t{o}  x") for d in ("a", "b") for o in range(6)], "document_id string, ordinal int, text string")
    call = lambda p: p.replace("[CONTEXT: This continues from: ", "<").replace("]\n\n", ">")
    whole = {(r["document_id"], r["ordinal"]): r["clean_text"] for r in process.clean_in_turn(chunked, call).collect()}
    assert whole["a", 0] == "t0  x" and whole["a", 2] == "<<t0  x>t1  x>t2  x" and whole["b", 0] == "t0  x" and whole["b", 5].count("<") == 5
    runs = {r["ordinal"]: r["clean_text"] for r in process.clean_in_turn(chunked.where("document_id = 'a' AND ordinal <> 1"), call, "balanced", run=2).collect()}
    assert runs[0] == "t0  x" and runs[2] == "<t0  x>t2  x" and runs[3] == "t3  x" and runs[4].startswith("<t3  x>")
    with pytest.raises(ValueError):
        process.clean_in_turn(chunked, call, "fast")


def test_transcript_files_and_citations(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\nAda: First point.\n\n2\n00:00:03,000 --> 00:00:04,500\nAda: The second one\n"
    files = spark.createDataFrame([("a.srt", srt), ("b.srt", "nothing"), ("c.srt", srt)], "path string, text string")
    got = {r["path"]: r for r in transcripts.normalize_files(files, "txt", existing=files.where("path = 'c.srt'").select("path")).collect()}
    assert got["a.srt"]["n_segments"] == 2 and got["a.srt"]["content"].startswith("Ada: First point.") and "no transcript" in got["b.srt"]["error"] and "exists" in got["c.srt"]["error"]
    told = {r["path"]: r for r in transcripts.citations(files, "first POINT the second").collect()}
    assert told["a.srt"]["citation"]["end_segment_index"] == 1 and told["a.srt"]["citation_error"] is None and "no transcript" in told["b.srt"]["citation_error"]
    assert "not found" in transcripts.citations(files, "zzzz qqqq").where("path = 'a.srt'").first()["citation_error"]


def test_suites_and_benchmarks(spark, tmp_path):
    cases = [{"name": "one", "input_text": "see the  doctor", "expected_contains": ["see the doctor"], "expected_classification_prefix": "610"}, {"name": "two", "input_text": "x", "min_output_chars": 5}]
    path = tmp_path / "suite.json"
    path.write_text(json.dumps({"cases": cases}))
    out = {r["name"]: r for r in evaluation.run_suite(evaluation.load_suite(spark, str(path))).collect()}
    assert out["one"]["passed"] and out["two"]["failures"] == ["output has 1 chars, expected at least 5"]
    with pytest.raises(ValueError):
        evaluation.load_suite(spark, str(path), 10)
    path.write_text('{"cases": []}')
    with pytest.raises(ValueError):
        evaluation.load_suite(spark, str(path))
    docs = spark.range(3).select(F.col("id").alias("document_id"), evaluation.synthetic_text(5, 500).alias("text"))
    runs = evaluation.benchmark(docs, process.ChunkPolicy(1000, 50, 100), 2)
    one = evaluation.benchmark_summary(runs).first()
    assert one["run_count"] == 2 and one["average_chars_per_second"] > 0 and one["total_chunks"] > 6 and one["evidence_tier"] == "mock-smoke"
    with pytest.raises(ValueError):
        evaluation.benchmark(docs, process.ChunkPolicy(), 0)
    corpus = evaluation.synthetic_corpus(spark, 8).collect()
    assert len(transcripts.parse(corpus[2]["content"])) == 12 == len(transcripts.parse(corpus[3]["content"])) and corpus == evaluation.synthetic_corpus(spark, 8).collect()


def test_jobs(spark):
    runner = jobs.JobRunner(spark)
    assert runner.submit("r1", lambda: spark.range(10).count()).result() == 10
    slow = runner.submit("r2", lambda: spark.range(4).select(F.java_method(F.lit("java.lang.Thread"), F.lit("sleep"), (F.col("id") * 0 + 20000).cast("bigint"))).collect())
    time.sleep(3)
    runner.cancel("r2")
    runner.wait()
    assert slow.cancelled() or slow.exception() is not None
    assert jobs.with_heartbeat(lambda: 5, lambda: True, lambda: None, 0.01) == 5
    stopped = threading.Event()
    with pytest.raises(jobs.Canceled):
        jobs.with_heartbeat(lambda: stopped.wait(5), lambda: False, stopped.set, 0.01)
    done, stop = [], threading.Event()

    def turn() -> bool:
        done.append(1)
        if len(done) == 3:
            stop.set()
        return len(done) < 3

    assert jobs.run_forever(turn, stop, 0.01) == 2 and jobs.heartbeat_seconds(600) == 30 and jobs.heartbeat_seconds(1) == 1


def test_repeated_changes_multiply_nothing(spark):
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    queue = spark.createDataFrame([("r", "running", 1, None, None, "w", None, None)], "run_id string, status string, attempts int, available_at timestamp_ntz, locked_at timestamp_ntz, locked_by string, updated_at timestamp_ntz, last_error string")
    twice = spark.createDataFrame([("r", "w", "e"), ("r", "w", "e")], "run_id string, worker string, error string")
    assert T.complete(queue, twice, now).count() == 1 and T.fail(queue, twice, 3, now).count() == 1 and T.cancel(queue, twice, now).count() == 1 and T.heartbeat(queue, twice, now, 5)[0].count() == 1
    with pytest.raises(ValueError):
        T.heartbeat(queue, twice, now, 0)


def test_texts_of_pages(spark):
    assert spark.range(1).select(X.unescape(F.lit("&#65;&#x1F600;&lt;&nope;&amp;lt;&"))).first()[0] == "A\U0001F600<&nope;&lt;&"


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.safe_name(F.lit(" A b/Ç! "))) == "a-b-ç" and one(X.safe_filename(F.lit("%ff/../"))) == "upload.txt"
    items = spark.createDataFrame([("b", "o/b", "failed", "e"), ("a", "o/a", "converted", None)], "source_path string, output_path string, status string, error string")
    from folioflow.operators import rollups, search

    r = rollups.conversion_report(items).first()
    assert (r["converted"], r["failed"], [i["source_path"] for i in r["items"]]) == (1, 1, ["a", "b"])
    assert search.quote_of_query('say "a b" or "a longer one"') == "a longer one" and search.quote_of_query("plain") == "plain"
    fresh, new = readers.extract_cached(spark.createDataFrame([("/a.txt", bytearray(b"x")), ("/b.txt", bytearray(b"\x00"))], "source_path string, content binary"), spark.createDataFrame([], "content_sha256 string, config_signature string, text string"), "s")
    assert [r["text"] for r in new.collect()] == ["x"] and fresh.count() == 2  # failures are not cached
    made = one(X.classified(X.mock_classification(F.lit("Text to analyze: a catalog of novels")), F.lit("t"), F.lit("f.txt")))
    assert (made["code"], made["label"], made["tags"]) == ("800", "Literature", ["literature"])
