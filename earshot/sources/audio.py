"""Audio files: reading by Spark's binaryFile source, 16-bit WAV encoding and header scans."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.types import AUDIO, BYTES, REAL


def wav_bytes(audio: np.ndarray, sr: int) -> bytes:
    """A mono WAV file of 16-bit samples, cut towards zero."""
    samples = (np.clip(np.asarray(audio, float), -1, 1) * 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(int(sr))
        w.writeframes(samples.tobytes())
    return out.getvalue()


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1 to 1, channels averaged, and the rate. PCM of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, sr = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = np.concatenate([np.zeros((len(b), 1), np.uint8), b], axis=1).copy().view("<i4")[:, 0] / 2.0**31
    else:
        x = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(1).astype(np.float32), sr


@F.pandas_udf(AUDIO)
def decode_wav(content: pd.Series) -> pd.DataFrame:
    """audio, sr and duration_s of WAV contents; null where they can't be read."""
    rows = []
    for data in content:
        try:
            x, sr = read_wav(bytes(data))
            rows.append((x, sr, len(x) / sr))
        except Exception:  # an unreadable file is a row without audio
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["audio", "sr", "duration_s"])


@F.pandas_udf(REAL)
def wav_duration(content: pd.Series) -> pd.Series:
    """Seconds by the header alone; null where it can't be read."""

    def one(data: bytes) -> float | None:
        try:
            with wave.open(io.BytesIO(bytes(data))) as w:
                return w.getnframes() / w.getframerate()
        except Exception:
            return None

    return content.map(one).astype(float)


@F.pandas_udf(BYTES)
def encode_wav(audio: pd.Series, sr: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else wav_bytes(x, int(r)) for x, r in zip(audio, sr, strict=True)])


def plain_path(path: Column) -> Column:
    """A local path without its scheme, so that paths of files and of manifests compare."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_audio(spark: SparkSession, folder: str) -> DataFrame:
    """path, audio, sr and duration_s of the WAV files in a folder; durations come from the headers, so a plan that needs only them decodes nothing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(folder)
    return files.select(plain_path(F.col("path")).alias("path"), decode_wav("content").alias("a"), wav_duration("content").alias("duration_s")).select("path", "a.audio", "a.sr", "duration_s")
