"""The stream extensions give what the batch operators give."""

import datetime


from skriva.operators import cues
from skriva.streaming import cues as streaming
from tests.test_operators import tokens_of


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
        return df.sparkSession.sql(f"select * from {name}").collect()
    finally:
        q.stop()


def test_cue_builder_flushes_at_the_end(spark, tmp_path):
    tokens = tokens_of("はい。" * 20 + "さようなら")
    rows = [("f", i, bytes(b), t, i == len(tokens) - 1) for i, (b, t) in enumerate(tokens)]
    schema = "file_id string, pos int, bytes binary, t_s double, last boolean"
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = drain(streaming.build_cues(stream), "built")
    want = list(cues.cues_of(tokens))
    assert sorted((round(r.start_s, 6), round(r.end_s, 6), r.text) for r in got) == sorted((round(s, 6), round(e, 6), t) for s, e, t in want)


def test_gap_sessions_close_behind_the_watermark(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    schema = "f string, ts timestamp"
    for part in ([("a", at(0.0)), ("a", at(1.0)), ("a", at(5.0))], [("a", at(100.0))], [("a", at(101.0))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = drain(streaming.gap_sessions(stream, "f", "ts"), "gaps")
    assert sorted(r.n for r in got) == [1, 2]  # the one still open at the end has not passed the watermark
