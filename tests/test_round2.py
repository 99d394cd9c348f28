"""What the second review found."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import manifests, process
from folioflow.plans import registry
from folioflow.sources import readers


def against_sql(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over tables given as (rows, schema)."""
    c = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = c.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    return sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))), sorted(map(str, want.fetchall()))


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_a_large_report_has_parts_that_hold_every_item_once(spark):
    none = F.lit(None).cast("string")
    items = spark.range(1000).select(F.format_string("/p/%04d", "id").alias("source_path"), none.alias("converted_path"), none.alias("document_id"),
        none.alias("run_id"), F.when(F.col("id") % 4 == 0, "failed").otherwise("queued").alias("status"), none.alias("error"))
    ddl = "summary struct<converted:int,failed:int,queued:int>, items array<struct<source_path:string,status:string>>"
    read = lambda df: [r["j"] for r in df.select(F.from_json("json", ddl).alias("j")).collect()]
    parts = read(manifests.import_report(items, most_items=100))
    assert len(parts) > 5 and max(len(p["items"]) for p in parts) < 250
    assert {tuple(p["summary"]) for p in parts} == {(750, 250, 750)}
    assert [i["source_path"] for p in sorted(parts, key=lambda p: p["items"][0]["source_path"]) for i in p["items"]] == [f"/p/{i:04}" for i in range(1000)]
    assert len(read(manifests.import_report(items))) == 1 and len(read(manifests.import_report(items.limit(0)))) == 1


def test_texts_that_begin_like_archives_are_texts(spark, tmp_path):
    texts = ["BZhang wrote this.", "x" * 257 + "ustar and on", "plain"]
    rows = [(2 * i + 1, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got, want = against_sql(spark, tmp_path, "extraction_cached", documents=(rows, DOCUMENTS))
    assert got == want


def test_archives_are_still_told(spark):
    import bz2
    import io
    import tarfile

    tars = []
    for form in (tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT):
        with tarfile.open(fileobj=(held := io.BytesIO()), mode="w", format=form) as t:
            t.addfile(tarfile.TarInfo("a.txt"))
        tars.append(held.getvalue())
    data = spark.createDataFrame([(bytearray(x),) for x in (bz2.compress(b"a text"), bz2.compress(b""), *tars)], "content binary")
    assert [r[0] for r in data.select(readers.archive_label(F.col("content"))).collect()] == ["bzip2", "bzip2", "tar", "tar", "tar"]


def test_artifacts_are_whole_words(spark, tmp_path):
    texts = ["ention, pas an aiellereoi le", "the context is empty", "éas an AI", "Has an AI part.", "as an aielle"]
    got, want = against_sql(spark, tmp_path, "validation_warnings", documents=([(4 * i + 3, t, "fr", "s", len(t)) for i, t in enumerate(texts)], DOCUMENTS))
    assert got == want


@pytest.mark.parametrize("said", ["As an AI, I can't", "so,as an AI.", "—as a language model", "x[omitted long matching line]", "(I'm ready to edit)", "The text provided was empty"])
def test_artifacts_are_still_found(spark, said):
    got = spark.createDataFrame([(f"Kept.\n{said}",)], "t string").select(X.validate(F.col("t"), F.lit(1))["text"]).first()[0]
    assert got == process.validated_text(f"Kept.\n{said}") == "Kept."


def test_postings_are_made_of_bounded_slices(monkeypatch):
    import pyarrow as pa

    from folioflow.operators import search

    tokens = [["b", "a", "b"], [], ["c"] * 9, ["a"], ["a", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(tokens)], names=["id", "tokens"])
    monkeypatch.setattr(search, "SLICE_TOKENS", 4)
    out = list(search._term_lists(iter([batch]), None))
    assert len(out) == 3 and max(len(b.column(2).flatten()) for b in out) == 9
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(0, "b", [0, 2]), (0, "a", [1]), (2, "c", list(range(9))), (3, "a", [0]), (4, "a", [0]), (4, "b", [1])]


def test_fuzzy_quotes_compare_few_windows_and_find_the_same(monkeypatch):
    import random

    from folioflow.operators import transcripts as R

    rnd, calls = random.Random(7), []
    seen = R.confidence
    monkeypatch.setattr(R, "confidence", lambda q, w: calls.append(1) or seen(q, w))
    words, n_windows = ["ai", "the", "of", "tion", "er", "Éa", "...", "so", ""], 0
    for _ in range(150):
        texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 14))) for _ in range(rnd.randint(1, 16))]
        said = rnd.choice(texts)
        quote, least = said[3:] + " " + said[:3] + rnd.choice(["", " zz"]), rnd.choice([0.0, 0.5, 0.8])
        segs = [{"text": t, "start_seconds": float(i), "duration_seconds": 1.0, "speaker": None} for i, t in enumerate(texts)]
        if not R._plain(quote):
            continue
        best = (-1.0, 0, 0)
        for i in range(len(texts)):
            for j in range(i, min(len(texts), i + R.MOST_WINDOW)):
                window = R._plain(" ".join(texts[i : j + 1]))
                n_windows += 1
                if window and (c := seen(R._plain(quote), window)) > best[0]:
                    best = (c, i, j)
        got = R.find_quote(segs, quote, least)
        if got is None or got["strategy"] == "fuzzy-window":
            want = (best[1], best[2], round(best[0], 6)) if best[0] >= max(least, 0) else None
            assert (got and (got["start_segment_index"], got["end_segment_index"], got["confidence"])) == want
    assert len(calls) < n_windows / 4


def test_page_metrics_read_the_pages_once(spark, tmp_path):
    from folioflow.operators import evaluation

    schema = "file bigint, status string, source string, warnings array<string>, attempts int, duration_ms double, corrected boolean, confidence double"
    rows = [(1, "succeeded", "ocr", ["a", "", "a"], 2, 5.0, True, 0.5), (1, None, "", None, None, -1.0, None, None), (2, "failed", "ocr", [], 1, None, False, 1.0)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/pages")
    out = evaluation.page_metrics(spark.read.parquet(f"{tmp_path}/pages"), ["file"])
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r["file"]: r for r in out.collect()}
    assert got[1]["status_counts"] == {"succeeded": 1, "unknown": 1} and got[1]["source_counts"] == {"ocr": 1, "unknown": 1} and got[1]["warning_counts"] == {"a": 2}
    assert (got[1]["attempts"], got[1]["max_duration_ms"], got[1]["ocr_pages"], got[1]["corrected_pages"], got[1]["average_ocr_confidence"]) == (2, 5.0, 1, 1, 0.5)
    assert got[2]["warning_counts"] == {} and got[2]["max_duration_ms"] is None


def test_missing_pages_are_found_without_comparing_all_with_all(spark):
    names = "file bigint, page_number int, source string, status string, text string, confidence double, corrected boolean, error string, warnings array<string>, attempts int, duration_ms double, raw_text string, image_path string, rotation_degrees int, source_path string, source_sha256 string, extraction_config string, page_count int"
    rows = [(1, n, "ocr", "succeeded", "t", None, None, None, None, 1, None, None, None, 0, "p", "s", "{}", 6) for n in (5, 2)]
    written = manifests.page_manifest(spark.createDataFrame(rows, names), ["file"])
    assert "exists(" not in written._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["page_number"], r["status"]) for r in manifests.pages_of(written).collect()] == [(n, "succeeded" if n in (2, 5) else "pending") for n in range(1, 7)]
