"""Operator 4: media columns. Bytes stored as WAV samples, read back by the wave module; spectral-peak pair fingerprints from short-time Fourier transforms."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_texts, sha

#: Samples a second, of a frame and between frames.
RATE, FRAME, HOP = 8000, 256, 128
#: Upper ends of the bands of frequency bins in which a frame has one peak each.
BANDS = (4, 8, 16, 32, 64, 129)
#: A peak pairs with the next band's peak in its own frame, and with its band's peaks in so many frames after it.
REACH = 3
UNIT = 64
_HANN = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples, one for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate. Other than 8-bit mono is an error."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono only")
        return w.readframes(w.getnframes()), w.getframerate()


def spectra(samples: np.ndarray, block: int = 4096) -> Iterator[np.ndarray]:
    """Magnitudes of the frames' spectra, some frames at a time; the last frame is filled up with silence."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    for at in range(0, n, block):
        end = min(n, at + block)
        part = samples[at * HOP : (end - 1) * HOP + FRAME].astype(np.float32) - 128.0
        part = np.pad(part, (0, (end - at - 1) * HOP + FRAME - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        yield np.abs(np.fft.rfft(frames * _HANN, axis=1))


def fingerprints(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs, sorted: frame << 32 | bin of the first peak << 16 | bin of the second << 4 | frames between them.

    A frame's peak in a band is its strongest bin, if that is over the frame's mean.
    """
    bins, strong = [], []
    lows = (0, *BANDS[:-1])
    for mag in spectra(np.frombuffer(samples, np.uint8)):
        mean = mag.mean(axis=1)
        at = np.stack([lo + mag[:, lo:hi].argmax(axis=1) for lo, hi in zip(lows, BANDS)], axis=1)
        bins.append(at)
        strong.append(np.take_along_axis(mag, at, 1) > mean[:, None])
    b, s = np.concatenate(bins), np.concatenate(strong)
    out = []
    for i in range(len(BANDS) - 1):
        t = np.flatnonzero(s[:, i] & s[:, i + 1])
        out.append(t << 32 | b[t, i] << 16 | b[t, i + 1] << 4)
    for d in range(1, min(REACH, len(b) - 1) + 1):
        for i in range(len(BANDS)):
            t = np.flatnonzero(s[:-d, i] & s[d:, i])
            out.append(t << 32 | b[t, i] << 16 | b[t + d, i] << 4 | d)
    return np.sort(np.concatenate(out))


def payload(text: bytes, unit: int = UNIT) -> bytes:
    """The bytes with bytes 0 after them, up to a multiple of unit that is not zero."""
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media binary: each text's payload as a WAV file. Null and empty texts are one unit of silence at byte 0; repeated rows stay."""
    return map_texts(docs, lambda texts: {"n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array([to_wav(payload(x)) for x in texts], pa.binary())}, "n_bytes bigint, media binary", {id_col: F.col(f"`{id_col}`")}, text_col)


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, peaks array<bigint> of each WAV file. Null media have no peaks."""

    def run(batches):
        for b in batches:
            got = [fingerprints(from_wav(x)[0]) if x is not None else np.zeros(0, np.int64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], [id_col, "peaks"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(f"`{id_col}`", f"`{media_col}`").mapInArrow(run, f"`{id_col}` {kind}, peaks array<bigint>")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores, reads back and digests in one pass: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (digest of the peaks), n_peaks. Null is an empty text."""

    def run(texts: list[bytes]) -> dict:
        rows = []
        for x in texts:
            media = to_wav(payload(x))
            back, _ = from_wav(media)
            peaks = fingerprints(back)
            rows.append((len(x), len(back), sha(back), zlib.crc32(back[-UNIT:]), len(media), sha(media), hashlib.sha256(peaks.astype("<i8").tobytes()).hexdigest()[:32], len(peaks)))
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_peaks")
        return {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)}

    return map_texts(docs, run, "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_peaks bigint", {id_col: F.col(f"`{id_col}`")}, text_col)
