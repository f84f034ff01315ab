"""Functions by name in SQL text, and cues with a time map."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from skriva.functions import registered
from skriva.operators import chunking, cues


@pytest.fixture(autouse=True)
def names(spark):
    registered.register(spark)
    registered.register(spark)  # again is no error


def test_cues_of_texts(spark):
    srt = "1\r\n00:00:01,500 --> 00:00:02,000\r\none\r\ntwo\r\n\r\n2\r\n00:01:00,000 --> 01:00:00,250\r\nthree"
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000 align:start\nx\n\n"
    rows = spark.createDataFrame([(1, srt), (2, vtt), (3, None), (4, "")], "id int, raw string")
    got = spark.sql("SELECT id, c.* FROM {rows}, LATERAL parse_cues(raw) c ORDER BY id, cue_idx", rows=rows).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1.5, 2.0, "one\ntwo"), (1, 1, 60.0, 3600.25, "three"), (2, 0, 1.0, 2.0, "x")]


def test_regions(spark):
    got = spark.sql("SELECT * FROM split_regions(7, 3)").collect()
    assert [tuple(r) for r in got] == [(0, 0, 2), (1, 2, 4), (2, 4, 7)]
    assert spark.sql("SELECT * FROM split_regions(cast(NULL AS int), 3)").count() == 0
    assert spark.sql("SELECT * FROM split_regions(9, 0)").count() == 0


@pytest.mark.parametrize("key", ["string", "bigint"])
def test_chunks_of_a_table_take_its_key(spark, key):
    rng = np.random.default_rng(1)
    files = {"7": rng.normal(size=3000), "8": rng.normal(size=1800), None: rng.normal(size=900)}
    rows = [(f, k, x[k : k + 100].tolist()) for f, x in files.items() for k in range(0, len(x), 100)]
    blocks = spark.createDataFrame(rows, "file string, place int, samples array<double>").selectExpr(f"cast(file AS {key}) AS file", "place", "samples").repartition(4)
    got = spark.sql("SELECT * FROM energy_chunks(TABLE({blocks}), 1.0, 0.2, 400)", blocks=blocks)
    assert got.schema["file"].dataType.simpleString() == key
    got = got.collect()
    for f, x in files.items():
        bounds = [0, *chunking.energy_cuts(x, 1.0, 0.2, 400), len(x)]
        assert sorted((r.start_sample, r.end_sample) for r in got if r.file == (f if key == "string" or f is None else int(f))) == list(zip(bounds[:-1], bounds[1:], strict=True))
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM energy_chunks(TABLE({two}), 1.0, 0.2, 400)", two=blocks.select("file", "samples"))


def test_expressions_and_readings(spark):
    r = spark.sql("SELECT cue_timestamp(3661.0005D, ',') AS t, term_hits('aaaa', 'aa') AS n, term_hits('x', '') AS none, plain_error_rate('abc', 'abd') AS e, read_number('2018') AS said, to_kana('カナ12') AS k").first()
    assert (r.t, r.n, r.none, round(r.e, 6), r.said, r.k) == ("01:01:01,000", 2, 0, 0.333333, "にせんじゅうはち", "かなじゅうに")


def test_cues_of_compacted_audio_get_their_original_times(spark):
    tokens = spark.createDataFrame([("f", 0, k, bytes(w, "utf8"), t) for k, (w, t) in enumerate([("a", 0.5), ("b", 0.6), ("c", 5.0), ("d", 5.1)])] + [("g", 0, 0, b"x", 1.0)], "file_id string, chunk_idx int, pos int, bytes binary, t_s double")
    mapping = spark.createDataFrame([("f", 0.0, 0.0), ("f", 4.0, 14.0)], "file_id string, new_start_s double, old_start_s double")
    got = cues.build(tokens, time_map=mapping).orderBy("file_id", "cue_idx").collect()
    assert [(r.file_id, r.text, round(r.start_s, 6), round(r.end_s, 6)) for r in got] == [("f", "ab", 0.42, 0.6), ("f", "cd", 14.92, 15.1), ("g", "x", 0.92, 1.0)]
