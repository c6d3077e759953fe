"""Media columns: texts as WAV, and spectral-peak fingerprints of what is read back.

``to_media`` stores a text's UTF-8 bytes, padded with zero bytes to a positive multiple
of 64, as 8-bit mono samples in a WAV file (one binary value for each row).
``media_features`` opens such a value with the wave module, takes a short-time Fourier
transform of it (windows of ``FRAME`` samples, half overlapping, the last one filled up
with zeros), finds the strongest
bins of each window and pairs each peak with those of the next windows. A pair is one
number: the time, the two bins and the distance in time.

A null text counts as empty: 64 zero bytes, no peaks. Equal texts give equal values, and
repeated rows each get their row. An empty table stays empty. Long texts are taken whole.
Other columns stay, whatever their names; those named as an output are replaced.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowloom.llm.batches import add_columns, utf8

BLOCK = 64
RATE = 8_000
FRAME, HOP = 256, 128
#: Strongest local maxima of a window, and windows ahead that they are paired with.
PEAKS, AHEAD = 2, 2
#: Windows transformed at once.
AT_ONCE = 4_096


def pack(data: bytes) -> bytes:
    payload = data + bytes(-len(data) % BLOCK or (BLOCK if not data else 0))
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def unpack(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, bin) of the strongest local maxima of each window's spectrum, in order."""
    short = FRAME - len(samples) if len(samples) < FRAME else (FRAME - len(samples)) % HOP
    samples = np.r_[samples, np.zeros(short, samples.dtype)]
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    shape = np.hanning(FRAME).astype(np.float32)
    times, bins = [], []
    for i in range(0, len(frames), AT_ONCE):
        part = frames[i : i + AT_ONCE].astype(np.float32)
        part -= part.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(part * shape, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        tops = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1e-3), inner, 0)
        best = np.argpartition(-tops, PEAKS, axis=1)[:, :PEAKS]
        best.sort(axis=1)
        good = np.take_along_axis(tops, best, axis=1) > 0
        at, k = np.nonzero(good)
        times.append(at + i)
        bins.append(best[at, k] + 1)
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(payload: bytes) -> np.ndarray:
    """Pairs of peaks as time << 18 | bin << 10 | other bin << 2 | windows between."""
    time, at = peaks(np.frombuffer(payload, np.uint8))
    out = []
    for step in range(1, PEAKS * (AHEAD + 1)):
        gap = time[step:] - time[:-step]
        near = (gap >= 1) & (gap <= AHEAD)
        out.append(time[:-step][near] << 18 | at[:-step][near] << 10 | at[step:][near] << 2 | gap[near])
    return np.unique(np.concatenate([time[:0], *out]))


def to_media(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_bytes long (of the text) and media binary."""

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for (texts,) in batches:
            data = utf8(texts)
            yield [[len(x) for x in data], [pack(x) for x in data]]

    return add_columns(df, [text], "n_bytes long, media binary", run)


def media_features(df: DataFrame, media: str = "media", codes: bool = True) -> DataFrame:
    """``df`` with the digests of what ``media`` holds and its fingerprint.

    payload_bytes, payload_sha256 and tail_crc32 (of the last 64 bytes) are of the bytes
    read back, media_bytes and media_sha256 of the stored value; feature is the hash of
    the fingerprint after its number of pairs; peak_pairs array<long>, with ``codes``, is
    the fingerprint itself. A null value counts as the media form of an empty text.
    """

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for (values,) in batches:
            rows = []
            for value in values:
                stored = value.as_py() or pack(b"")
                payload = unpack(stored)
                pairs = fingerprint(payload)
                feature = f"{len(pairs)}:{hashlib.sha256(pairs.astype('<i8').tobytes()).hexdigest()[:32]}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, *[pairs] * codes))
            yield [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(6 + codes)]

    names = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return add_columns(df, [media], names + ", peak_pairs array<long>" * codes, run)
