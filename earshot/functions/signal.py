"""Memoryless signal operations and frame statistics as Column builders over arrays of samples."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MU, A = 255, 87.6
_LN_A = 1.0 + math.log(A)


def let(value: Column, then) -> Column:
    """then(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double")))


def _quantise(level: Column) -> Column:
    """A level in -1 to 1 on 256 steps, halves to the even one."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint((level + 1.0) * 127.5))).cast("int")


def mulaw_codes(samples: Column, mu: int = MU) -> Column:
    return F.transform(samples, lambda x: _quantise(F.signum(clip(x)) * F.log1p(F.lit(float(mu)) * F.abs(clip(x))) / math.log1p(mu)))


def mulaw_expand(codes: Column, mu: int = MU) -> Column:
    def one(c: Column) -> Column:
        d = c / F.lit(127.5) - 1.0
        return F.signum(d) * (F.pow(F.lit(1.0 + mu), F.abs(d)) - 1.0) / float(mu)

    return F.transform(codes, one)


def alaw_codes(samples: Column) -> Column:
    def one(x: Column) -> Column:
        a = F.abs(clip(x))
        level = F.when(a < 1.0 / A, A * a / _LN_A).otherwise((1.0 + F.log(F.greatest(A * a, F.lit(1e-12)))) / _LN_A)
        return _quantise(F.signum(clip(x)) * level)

    return F.transform(samples, one)


def alaw_expand(codes: Column) -> Column:
    def one(c: Column) -> Column:
        d = c / F.lit(127.5) - 1.0
        a = F.abs(d)
        return F.signum(d) * F.when(a < 1.0 / _LN_A, a * _LN_A / A).otherwise(F.exp(a * _LN_A - 1.0) / A)

    return F.transform(codes, one)


def pcm16(samples: Column) -> Column:
    """16-bit samples, cut towards zero."""
    return F.transform(samples, lambda x: (clip(x) * 32767.0).cast("smallint"))


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double")))), F.lit(0.0))


def peak_normalize(samples: Column) -> Column:
    """Divides by the peak, only where that exceeds 1."""
    return let(F.greatest(peak(samples), F.lit(1.0)), lambda top: F.transform(samples, lambda x: x.cast("double") / top))


def hum(n: Column, rate: int = 8000) -> Column:
    """Mains hum of n samples: 50 Hz and a weaker 150 Hz."""
    two_pi = 2 * math.pi

    def one(k: Column) -> Column:
        t = k / float(rate)
        return F.sin(two_pi * 50 * t) + 0.3 * F.sin(two_pi * 150 * t)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), one)).otherwise(F.array().cast("array<double>"))


def mean_power(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, total / F.greatest(F.size(samples), F.lit(1))).otherwise(F.lit(0.0))


def frame_powers(samples: Column, frame: int = 400) -> Column:
    """Mean power of whole frames; a last part frame is left out."""
    n = (F.size(samples) / frame).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: mean_power(F.slice(samples, k * frame + 1, frame)))).otherwise(F.array().cast("array<double>"))


def active_power(samples: Column, frame: int = 400, percentile: float = 0.7) -> Column:
    """Mean power of the frames at or above a percentile (between neighbours, linear); of the whole signal if it is shorter than a frame."""

    def louder(p: Column) -> Column:
        at = (F.size(p) - 1) * F.lit(percentile)
        low, high = (F.greatest(f(at).cast("int"), F.lit(0)) for f in (F.floor, F.ceil))
        first = F.element_at(p, low + 1)
        return let(first + (at - low) * (F.element_at(p, high + 1) - first), lambda level: F.filter(p, lambda x: x >= level))

    mean = let(let(F.array_sort(frame_powers(samples, frame)), louder), lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1)))
    whole = mean_power(samples)
    return F.when(F.size(samples) >= frame, mean).otherwise(F.when(whole == 0, F.lit(1e-12)).otherwise(whole))


def noise_gain(speech_power: Column, noise_power: Column, snr_db: Column) -> Column:
    """Factor that brings noise to a signal-to-noise ratio; without noise power 1e-12 stands for it."""
    return F.sqrt(speech_power / F.pow(F.lit(10.0), snr_db / 10.0) / F.when(noise_power == 0, F.lit(1e-12)).otherwise(noise_power))


def mix(samples: Column, noise: Column, gain: Column) -> Column:
    return F.zip_with(samples, noise, lambda x, z: x.cast("double") + z * gain)


def loss_states(uniforms: Column, loss_rate: float, burst: float = 3.0, chunk: int = 256) -> Column:
    """1 for lost frames of a two-state chain: good turns bad below p, bad stays bad above q = 1 / burst.

    Frames are folded in chunks, so that appending a state copies a chunk at most and the cost is linear in the frames.
    """
    q = 1.0 / burst
    p = loss_rate * q / max(1e-9, 1.0 - loss_rate)

    def step(acc: Column, r: Column) -> Column:
        bad = F.when(acc["bad"] == 1, (r > q).cast("int")).otherwise((r < p).cast("int"))
        return F.struct(F.concat(acc["out"], F.array(bad)).alias("out"), bad.alias("bad"))

    def whole(acc: Column, part: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("out"), acc["bad"].alias("bad"))
        return let(F.aggregate(part, start, step), lambda x: F.struct(F.concat(acc["out"], F.array(x["out"])).alias("out"), x["bad"].alias("bad")))

    n = F.ceil(F.size(uniforms) / chunk).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.slice(uniforms, k * chunk + 1, chunk))).otherwise(F.array().cast("array<array<double>>"))
    zero = F.struct(F.array().cast("array<array<int>>").alias("out"), F.lit(0).alias("bad"))
    return F.when(uniforms.isNotNull(), F.aggregate(parts, zero, whole, lambda acc: F.flatten(acc["out"])))


def real_time_factor(latency: Column, audio: Column) -> Column:
    return F.when(audio == 0, F.lit(float("inf"))).otherwise(latency / F.when(audio != 0, audio))
