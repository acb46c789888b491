"""Channel simulation: native array expressions and the NumPy chain."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import dsp, signal


def tone(f=440, sr=16000, seconds=1.0):
    return (0.5 * np.sin(2 * np.pi * f * np.arange(int(sr * seconds)) / sr)).astype(np.float32)


def rms(x):
    return float(np.sqrt(np.mean(np.square(x))))


def test_resample():
    assert abs(len(dsp.resample(tone(), 16000, 8000)) - 8000) <= 2
    assert (dsp.resample(tone(), 8000, 8000) == tone()).all()
    y = dsp.resample(tone(440), 16000, 8000)[500:-500]
    assert np.abs(y - tone(440, 8000)[500 : 500 + len(y)]).max() < 0.01
    assert rms(dsp.resample(tone(6000), 16000, 8000)) < 0.05  # above the new Nyquist frequency
    assert len(dsp.resample(tone(440, 8000), 8000, 16000)) == 16000 and len(dsp.resample(np.zeros(0), 16000, 8000)) == 0


def test_bandlimit():
    assert rms(dsp.bandlimit(tone(100, 8000), 8000)) < 0.2 * rms(tone(100))
    assert rms(dsp.bandlimit(tone(1000, 8000), 8000)) > 0.5 * rms(tone(1000))
    assert (dsp.bandlimit(tone(), 8000, 4000, 300) == tone()).all()
    x = np.zeros(4000)
    x[100] = 1
    assert np.abs(dsp.bandlimit(x, 8000)[:100]).max() < 1e-6  # nothing sounds before its cause


def test_filter_against_recursion():
    zeros, poles, gain = dsp.butterworth(4, 0.05, 0.75)
    b, a = (gain * np.poly(zeros)).real, np.poly(poles).real
    x, y = np.random.default_rng(0).standard_normal(300), np.zeros(300)
    for n in range(300):
        y[n] = sum(b[k] * x[n - k] for k in range(min(n + 1, len(b)))) - sum(a[k] * y[n - k] for k in range(1, min(n + 1, len(a))))
    assert np.abs(dsp.filtered(x, 4, 0.05, 0.75) - y).max() < 1e-6


@pytest.mark.parametrize("codec", [dsp.mulaw, dsp.alaw])
def test_companding(codec):
    y = codec(tone())
    assert y.shape == tone().shape and 0 < np.abs(y - tone()).max() < 0.15
    assert np.abs(codec(np.array([5.0, -5.0]))).max() <= 1


@pytest.mark.parametrize("kind", list(dsp.NOISES))
@pytest.mark.parametrize("snr", [5.0, 15.0])
def test_noise(kind, snr):
    x = tone(440, 16000, 2.0)
    noise = dsp.add_noise(x, snr, kind, np.random.default_rng(1)) - x
    assert abs(10 * np.log10(dsp.active_speech_power(x) / np.mean(noise.astype(float) ** 2)) - snr) < 2
    with pytest.raises(ValueError):
        dsp.add_noise(x, 5, "rain")


def test_loss():
    y = dsp.packet_loss(np.ones(32000, np.float32), 8000, 0.10)
    assert 0.03 < (y == 0).mean() < 0.25 and (dsp.packet_loss(tone(), 8000, 0.0) == tone()).all()
    z = dsp.packet_loss(np.arange(1, 32001, dtype=np.float32), 8000, 0.10, conceal="repeat")
    assert (z > 0).all() and (z != np.arange(1, 32001)).any()


def test_suppression():
    rng = np.random.default_rng(2)
    noise = (rng.standard_normal(16000) * 0.05).astype(np.float32)
    y = dsp.spectral_suppression(noise, 16000, 0.8)
    assert len(y) == 16000 and rms(y) < rms(noise)
    assert np.abs(dsp.spectral_suppression(tone(), 16000, 0.0) - tone()).max() < 1e-4  # nothing taken, nothing changed
    assert len(dsp.spectral_suppression(tone()[:100], 16000)) == 100 and len(dsp.spectral_suppression(np.zeros(0), 16000)) == 0


def test_chain(spark):
    for cfg in dsp.standard_conditions():
        y, sr = dsp.apply_channel(tone() * 3, 16000, cfg)
        assert sr == cfg.target_sr and np.abs(y).max() <= 1 and (y == dsp.apply_channel(tone() * 3, 16000, cfg)[0]).all()
        json.dumps(cfg.to_dict())
    with pytest.raises(ValueError):
        dsp.apply_channel(tone(), 16000, dsp.ChannelConfig(codec="g729"))
    from earshot.sources.manifest import conditions_table

    fields = [c.split()[0] for c in dsp.CONFIG_SCHEMA.split(", ")]
    df = spark.createDataFrame([(tone()[:4000].tolist(),), (None,)], "a array<float>").crossJoin(conditions_table(spark))
    rows = df.select("a", "name", dsp.degrade(F.col("a"), F.lit(16000), F.struct(*fields)).alias("d")).collect()
    by = {c.name: c for c in dsp.standard_conditions()}
    for r in rows:
        if r["a"] is None:
            assert r["d"]["audio"] is None
        else:
            assert np.allclose(r["d"]["audio"], dsp.apply_channel(np.array(r["a"], np.float32), 16000, by[r["name"]])[0], atol=1e-6)


def test_native_expressions(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(-1.5, 1.5, 1200), [0.0, 1.0, -1.0]])
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    one = lambda c: df.select(c).first()[0]
    c = F.col("x")
    assert one(signal.mulaw_codes(c))[-3:] == [128, 255, 0]
    assert np.allclose(one(signal.mulaw_expand(signal.mulaw_codes(c))), dsp.mulaw(x), atol=1e-6)
    assert np.allclose(one(signal.alaw_expand(signal.alaw_codes(c))), dsp.alaw(x), atol=1e-6)
    assert one(signal.pcm16(c)) == (np.clip(x, -1, 1) * 32767).astype(np.int16).tolist()
    assert one(signal.active_power(c)) == pytest.approx(dsp.active_speech_power(x))
    assert one(signal.active_power(F.slice(c, 1, 50))) == pytest.approx(dsp.active_speech_power(x[:50]))
    assert len(one(signal.frame_powers(c))) == 3 and one(signal.frame_powers(F.slice(c, 1, 50))) == []
    assert np.allclose(one(signal.peak_normalize(c)), x / np.abs(x).max())
    assert np.allclose(one(signal.hum(F.lit(400))), dsp._hum(400, None)) and one(signal.hum(F.lit(0))) == []
    u = np.random.default_rng(0).random(100)
    states = spark.createDataFrame([(u.tolist(),)], "u array<double>").select(signal.loss_states(F.col("u"), 0.1)).first()[0]
    lost = dsp.packet_loss(np.ones(16000, np.float32), 8000, 0.1, rng=np.random.default_rng(0)).reshape(100, 160)[:, 0] == 0
    assert states == lost.astype(int).tolist()


def test_loss_states_of_long_signals(spark):
    import random

    from earshot.functions.signal import loss_states

    rng = random.Random(4)
    rows = [(k, [rng.random() for _ in range(n)]) for k, n in enumerate((0, 1, 255, 256, 257, 5000))] + [(9, None)]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(rows, "k int, u array<double>").select("k", loss_states(F.col("u"), 0.3).alias("s")).collect()}
    q, p = 1 / 3, 0.3 / 3 / 0.7
    for k, u in rows:
        bad, want = 0, []
        for r in u or ():
            bad = int(r > q) if bad else int(r < p)
            want.append(bad)
        assert got[k] == (None if u is None else want)
