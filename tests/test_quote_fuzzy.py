from __future__ import annotations

from folioflow.plans import registry


def test_long_turns_are_searched_whole(spark, tmp_path):
    said = " ".join(f"word{i} {chr(0x3B1 + i % 24)}" for i in range(150))  # each Greek letter is rare, as difflib wants of long texts
    spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", said)], "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    r = registry.QUERIES["quote_fuzzy"](spark, str(tmp_path)).first()
    assert r["strategy"] == "fuzzy-window" and r["start_segment_index"] == r["end_segment_index"] == 1 and r["confidence"] > 0.95
