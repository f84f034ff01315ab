"""Subtitle files through the data source: the same cues as from texts, whole files or none."""

import os

import pytest
from pyspark.sql import functions as F

from skriva.operators import cues as C
from skriva.sources import cue_source, transcripts


@pytest.fixture
def documents(spark):
    cue_source.register(spark)
    rows = [(f"file {i}/é", k, 2.0 * k, 2.0 * k + 1.5, f"said {k} in {i}") for i in range(12) for k in range(i)]
    cues = spark.createDataFrame(rows, "file_id string, cue_idx int, start_s double, end_s double, text string")
    return cues, C.srt(cues).select("file_id", "document"), C.vtt(cues).select("file_id", "document")


def test_files_written_are_read_back(spark, documents, tmp_path):
    cues, srt, vtt = documents
    srt.repartition(3).write.format("cues").mode("append").save(f"{tmp_path}/d")
    vtt.write.format("cues").mode("append").option("suffix", "vtt").save(f"file://{tmp_path}/d")
    assert sorted(os.listdir(f"{tmp_path}/d")) == sorted(f"file {i}%2F%C3%A9.{s}" for i in range(1, 12) for s in ("srt", "vtt"))
    got = spark.read.format("cues").option("bytesPerPartition", 300).load(f"{tmp_path}/d")
    assert got.rdd.getNumPartitions() > 3
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    texts = transcripts.texts(spark, f"{tmp_path}/d").withColumn("path", F.url_decode("path"))
    want = transcripts.parse_cues(texts)
    key = lambda rows: sorted((r.name.replace("%2F", "/").replace("%C3%A9", "é"), r.cue_idx, r.start_s, r.end_s, r.text) for r in rows)
    rows = key(got.withColumn("name", name).collect())
    assert len(rows) == 2 * cues.count()
    assert [r[1:] for r in rows] == [r[1:] for r in key(want.withColumn("name", F.regexp_extract("path", r"d/(.*)$", 1)).collect())]
    srt.limit(2).write.format("cues").mode("overwrite").save(f"{tmp_path}/d")
    assert sum(f.endswith(".srt") for f in os.listdir(f"{tmp_path}/d")) == 2 and sum(f.endswith(".vtt") for f in os.listdir(f"{tmp_path}/d")) == 11


def test_a_failing_task_leaves_nothing(spark, documents, tmp_path):
    _, srt, _ = documents
    os.makedirs(f"{tmp_path}/d")
    broken = srt.repartition(4).withColumn("document", F.when(F.col("file_id").startswith("file 7"), F.raise_error(F.lit("no"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="no"):
        broken.write.format("cues").mode("append").save(f"{tmp_path}/d")
    assert os.listdir(f"{tmp_path}/d") == []
    with pytest.raises(Exception, match="twice"):
        srt.unionByName(srt).write.format("cues").mode("append").save(f"{tmp_path}/d")
    assert os.listdir(f"{tmp_path}/d") == []


def test_odd_files(spark, tmp_path):
    cue_source.register(spark)
    (tmp_path / "a.srt").write_bytes(b"\xef\xbb\xbf1\r\n00:00:01,000 --> 00:00:02,000\r\n\xff bad\r\n")
    (tmp_path / "b.SRT").write_text("")
    (tmp_path / "c.txt").write_text("1\n00:00:01,000 --> 00:00:02,000\nx\n")
    got = spark.read.format("cues").load(str(tmp_path)).collect()
    assert [(r.cue_idx, r.start_s, r.end_s, r.text) for r in got] == [(0, 1.0, 2.0, "� bad")]
    assert spark.read.format("cues").load(f"{tmp_path}/a.srt").count() == 1
    (tmp_path / "none").mkdir()
    assert spark.read.format("cues").load(f"{tmp_path}/none").count() == 0
