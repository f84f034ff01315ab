"""A run's rows are added once, whatever ends a writer and whoever writes beside it."""

import pytest

from skriva.sources import sinks

SCHEMA = "file string, cer double, truncated boolean, looped boolean"


def rows(spark, *files):
    return spark.createDataFrame([(f, 0.1, f == "b", False) for f in files], SCHEMA)


def held(spark, path):
    return sorted(r.file for r in sinks.run_rows(spark, path, rows(spark).schema).collect())


@pytest.mark.parametrize("step", ["claim", "settle"])
def test_a_writer_that_ends_between_the_steps(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "run")
    sinks.write_run(rows(spark, "a"), path, {})
    own = getattr(sinks._Manifest, step)
    left = [1 if step == "claim" else 2]  # the second settle follows the commit

    def end(self, *args):
        left[0] -= 1
        if not left[0]:
            raise KeyboardInterrupt
        return own(self, *args)

    monkeypatch.setattr(sinks._Manifest, step, end)
    with pytest.raises(KeyboardInterrupt):
        sinks.write_run(rows(spark, "a", "b"), path, {})
    monkeypatch.undo()
    assert held(spark, path) == (["a"] if step == "claim" else ["a", "b"])
    header = sinks.write_run(rows(spark, "a", "b", "c"), path, {"files_expected": 3})
    assert held(spark, path) == ["a", "b", "c"] and header["complete"] and header["truncated"] == ["b"]


def test_two_writers_add_a_file_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "run")
    own, other = sinks._Manifest.claim, []

    def after_another(self, number, batch):
        if not other:
            other.append(1)
            sinks.write_run(rows(spark, "b", "c"), path, {})
        return own(self, number, batch)

    monkeypatch.setattr(sinks._Manifest, "claim", after_another)
    header = sinks.write_run(rows(spark, "a", "b"), path, {"files_expected": 4})
    assert held(spark, path) == ["a", "b", "c"] and header["files_scored"] == 3 and not header["complete"]


def test_nothing_to_add_and_repeated_files(spark, tmp_path):
    path = str(tmp_path / "run")
    assert held(spark, path) == []
    assert sinks.write_run(rows(spark), path, {})["files_scored"] == 0
    assert sinks.write_run(rows(spark, "a", "a"), path, {})["files_scored"] == 1 and held(spark, path) == ["a"]
