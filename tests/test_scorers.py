"""Scores of files, by function and by command line."""

import json

import pytest

from skriva.__main__ import main
from skriva.operators import cues
from skriva.plans import scorers
from tests.test_operators import CUE, cue_list


def test_files_are_scored(spark, tmp_path, capsys):
    (tmp_path / "r.txt").write_text("Ann:\nWe take you through\nsome real things\n")
    (tmp_path / "h.txt").write_text("we take you through some real thinks")
    got = scorers.coverage(spark, str(tmp_path / "r.txt"), str(tmp_path / "h.txt")).first()
    assert (got.unit, got.ref_units, got.subs, got.edited_reference) == ("word", 7, 1, False)
    for name, shift in (("r", 0.0), ("h", 0.4)):
        document = cues.srt(spark.createDataFrame(cue_list(shift), CUE), width=1000).first().document
        (tmp_path / f"{name}.srt").write_text(document)
    assert main(["timing", str(tmp_path / "r.srt"), str(tmp_path / "h.srt")]) == 0
    printed = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert abs(printed["constant_offset_ms"] - 400) < 20
    assert printed["break_f1"] == 1.0
    assert main(["coverage", str(tmp_path / "none.txt"), str(tmp_path / "h.txt")]) == 1
    with pytest.raises(SystemExit) as usage:
        main(["timing", str(tmp_path / "r.txt"), str(tmp_path / "h.srt")])
    assert usage.value.code == 2


def test_every_scorer_has_a_command(spark, tmp_path, capsys):
    (tmp_path / "r.txt").write_text("カタカナで1500です")
    (tmp_path / "h.txt").write_text("かたかなで1500でず")
    assert set(scorers.SCORERS) == set(scorers.METRICS)
    printed = {}
    for metric in ("cer", "kana", "coverage_kana", "lenient"):
        assert main([metric, str(tmp_path / "r.txt"), str(tmp_path / "h.txt")]) == 0
        printed[metric] = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert printed["cer"] == {"unit": "char", "ref_units": 11, "hyp_units": 11, "error": 5 / 11}
    assert 0 < printed["kana"]["kana_cer"] < 0.1
    assert printed["coverage_kana"]["kana_excused"] == 0
    assert printed["lenient"]["forgiven"] == 4
