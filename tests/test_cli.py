"""The command line: files written, exit codes and messages."""

import json

import numpy as np
import pytest

from earshot import cli
from earshot.sources.audio import wav_bytes


@pytest.fixture(autouse=True)
def session(spark, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)


@pytest.fixture
def listing(tmp_path):
    (tmp_path / "a.wav").write_bytes(wav_bytes(np.sin(np.arange(8000) / 9).astype(np.float32) * 0.5, 8000))
    (tmp_path / "b.wav").write_bytes(b"no audio")
    path = tmp_path / "set.json"
    path.write_text(json.dumps({"utterances": [{"id": "a", "audio_path": "a.wav", "reference": "one small cat sat on the mat"}, {"id": "b", "audio_path": "b.wav", "reference": "unheard"}]}))
    return str(path)


def test_demo_and_report(tmp_path, capsys):
    out = str(tmp_path / "demo")
    assert cli.main(["demo", "--n", "1", "--out", out, "--conditions", "wideband_clean", "telephony_clean"]) == 0
    body = json.loads((tmp_path / "demo/results.json").read_text())
    assert body["plan"]["cells"] == 30 == len(body["results"]) and (tmp_path / "demo/wer_heatmap.svg").exists()
    assert cli.main(["report", "--results", f"{out}/results.json", "--out", str(tmp_path / "again")]) == 0
    assert (tmp_path / "again/REPORT.md").read_text() == (tmp_path / "demo/REPORT.md").read_text()
    assert capsys.readouterr().out.count("REPORT.md") == 2


def test_run(listing, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert cli.main(["run", "--manifest", listing, "--providers", "mock", "--conditions", "telephony_alaw", "--out", out, "--no-report"]) == 0
    rows = json.loads((tmp_path / "out/results.json").read_text())["results"]
    assert [r["utterance_id"] for r in rows] == ["a"] and not (tmp_path / "out/REPORT.md").exists()
    assert "without readable audio: 1" in capsys.readouterr().err


def test_dry_run_and_budget(listing, tmp_path, capsys):
    args = ["run", "--manifest", listing, "--providers", "deepgram", "--out", str(tmp_path / "out")]
    assert cli.main([*args, "--dry-run"]) == 0
    plan = json.loads(capsys.readouterr().out)
    assert plan["cells"] == 14 and plan["audio_seconds"] == 1.0 and plan["estimated_cost_usd"]["deepgram"] > 0
    assert cli.main([*args, "--max-cost", "0"]) == 2
    assert "no call was made" in capsys.readouterr().err and not (tmp_path / "out").exists()


def test_unknown_condition_ends_with_a_message(listing, capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["run", "--manifest", listing, "--providers", "mock", "--conditions", "on_the_moon"])
    said = capsys.readouterr().err
    assert e.value.code == 2 and "on_the_moon" in said and "telephony_clean" in said
    with pytest.raises(SystemExit):
        cli.main(["demo", "--conditions", "on_the_moon"])


def test_corpus(tmp_path, capsys):
    assert cli.main(["corpus", "--out", str(tmp_path / "c"), "--n", "1"]) == 0
    assert len(list((tmp_path / "c").glob("*.wav"))) == 15
    assert cli.main(["tts-corpus", "--out", "x"]) == 3 and "backend" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["corpus", "--out", "x", "--odd"])
