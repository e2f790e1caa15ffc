"""PCM WAV recordings on Arrow batches: probe, volume, split, silence, recombine.  Other formats need a provider.

Files are rows of ``landing()``; a file that can't be read gives nulls and an error, never an exception.  Samples are
read as numbers in [-1, 1]; what is written has the width of what was read.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBE = T.StructType().add("channels", "integer").add("duration_seconds", "double").add("mean_volume_db", "double").add("error", "string")
TRACKS = T.ArrayType(T.StructType().add("channel", "string").add("content", "binary"))


def read_wav(raw: bytes) -> tuple[int, int, object]:
    """(frames a second, bytes of a sample, samples by frame and channel)."""
    import numpy as np

    with wave.open(io.BytesIO(raw)) as w:
        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        body = w.readframes(w.getnframes())
    body = body[: len(body) // (width * channels) * width * channels]
    if width == 1:  # the only width without a sign
        x = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    else:
        padded = np.zeros((len(body) // width, 4), np.uint8)
        padded[:, 4 - width :] = np.frombuffer(body, np.uint8).reshape(-1, width)
        x = padded.view("<i4")[:, 0] / 2.0**31
    return rate, width, x.reshape(-1, channels)


def write_wav(rate: int, width: int, x) -> bytes:
    import numpy as np

    if width == 1:
        body = np.clip(np.round(x * 128) + 128, 0, 255).astype(np.uint8).tobytes()
    else:
        top = 2 ** (8 * width - 1)
        scaled = np.clip(np.round(x * top), -top, top - 1).astype(np.int64) << (32 - 8 * width)
        body = scaled.astype("<i4").reshape(-1, 1).view(np.uint8)[:, 4 - width :].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(body)
    return out.getvalue()


def _power(x) -> float:
    return float((x * x).mean()) if x.size else 0.0


@F.pandas_udf(PROBE)
def _probe(content: pd.Series) -> pd.DataFrame:
    rows = []
    for raw in content:
        try:
            rate, _, x = read_wav(raw)
            power = _power(x)
            rows.append((x.shape[1], len(x) / rate, 10 * math.log10(power) if power else -math.inf, None))
        except Exception as e:  # noqa: BLE001 - whatever is wrong with the file
            rows.append((None, None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["channels", "duration_seconds", "mean_volume_db", "error"]).astype({"channels": "Int32"})


def probe(files: DataFrame) -> DataFrame:
    """(path, channels, duration_seconds, mean_volume_db, error): what the gates need of a recording."""
    return files.select("path", _probe("content").alias("p")).select("path", "p.*")


def is_dual_mono(left, right, least: float = 0.05) -> bool:
    """Whether two channels carry one signal: their difference is small beside them."""
    return _power(left - right) < least**2 * max(_power(left), 1e-12)


@F.pandas_udf(TRACKS)
def split_channels(content: pd.Series) -> pd.Series:
    """left and right of two channels that differ; else one mono track, the mean of all channels.  Null if unreadable."""

    def one(raw):
        try:
            rate, width, x = read_wav(raw)
        except Exception:  # noqa: BLE001 - the probe says why
            return None
        if x.shape[1] == 2 and not is_dual_mono(x[:, 0], x[:, 1]):
            return [{"channel": name, "content": write_wav(rate, width, x[:, k : k + 1])} for k, name in enumerate(("left", "right"))]
        return [{"channel": "mono", "content": write_wav(rate, width, x.mean(1, keepdims=True))}]

    return content.map(one)


def mask_track(content: Column, ranges: Column) -> Column:
    """The track with silence in the ranges (seconds); null, not the unmasked track, if it can't be read."""

    @F.pandas_udf("binary")
    def silence(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tracks, all_ranges in parts:
            out = []
            for raw, spans in zip(tracks, all_ranges, strict=True):
                try:
                    rate, width, x = read_wav(raw)
                except Exception:  # noqa: BLE001
                    out.append(None)
                    continue
                x = x.copy()
                for s in spans if spans is not None else ():
                    x[max(0, math.floor(s["start"] * rate)) : max(0, math.ceil(s["end"] * rate))] = 0
                out.append(write_wav(rate, width, x))
            yield pd.Series(out, dtype=object)

    return silence(content, ranges)


@F.pandas_udf(T.BinaryType())
def recombine(left: pd.Series, right: pd.Series) -> pd.Series:
    """Two tracks as left and right of one recording, the shorter one filled with silence; null if one is missing."""
    import numpy as np

    def one(a, b):
        try:
            (rate, width, x), (other, _, y) = read_wav(a), read_wav(b)
        except Exception:  # noqa: BLE001
            return None
        if rate != other:
            return None
        n = max(len(x), len(y))
        return write_wav(rate, width, np.stack([np.pad(t[:, 0], (0, n - len(t))) for t in (x, y)], 1))

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype=object)


def compliant(files: DataFrame, redaction_map: DataFrame) -> DataFrame:
    """(path, compliant, held, reason): recordings with silence in their masked ranges (path, channel, start, end).

    A recording of which a track can't be read, masked or recombined is held, and has no compliant content."""
    tracks = files.select("path", F.explode_outer(split_channels("content")).alias("t")).select("path", "t.*")
    ranges = redaction_map.groupBy(F.col("path").alias("r_path"), F.col("channel").alias("r_channel")).agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    joined = tracks.join(ranges, (F.col("path") == F.col("r_path")) & (F.col("channel") == F.col("r_channel")), "left")
    masked = joined.select("path", "channel", mask_track(F.col("content"), F.col("ranges")).alias("track"))
    of = lambda c: F.max(F.when(F.col("channel") == c, F.col("track"))).alias(c)
    both = masked.groupBy("path").agg(of("left"), of("right"), of("mono"))
    out = both.select("path", F.coalesce("mono", recombine("left", "right")).alias("compliant"))
    held = F.col("compliant").isNull()
    return out.select("path", "compliant", held.alias("held"), F.when(held, "no compliant recording").alias("reason"))
