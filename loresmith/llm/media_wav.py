"""Media columns: whole texts as 8-bit WAV, and fingerprints of spectral-peak pairs.

``to_wav_column`` adds the stored form as a binary column, ``wav_fingerprints``
reads it back with the ``wave`` module.  Nothing is shuffled.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import frugal

UNIT = 576  # payload bytes are padded to a positive multiple of this
RATE = 8000
FRAME, HOP = 576, 288
#: Bin bounds of the bands; each frame offers the loudest bin of each.
BANDS = (2, 12, 28, 60, 124, 289)
#: A peak is paired with the next peaks, at most so many and so many frames on.
PAIRS, REACH = 3, 16
#: Frames that are transformed at a time.
_AT_ONCE = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks of 8-bit samples: in each band the loudest bin, if it is louder than the band's mean by half and than its neighbours in time."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    lows, highs = np.array(BANDS[:-1]), np.array(BANDS[1:])
    loud = np.empty((len(frames), len(lows)), np.float32)
    where = np.empty((len(frames), len(lows)), np.int32)
    clear = np.empty((len(frames), len(lows)), bool)
    for a in range(0, len(frames), _AT_ONCE):
        part = frames[a : a + _AT_ONCE].astype(np.float32)
        part -= part.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(part * _WINDOW, axis=1)).astype(np.float32)
        for k, (low, high) in enumerate(zip(lows, highs, strict=True)):
            band = power[:, low:high]
            top = band.argmax(axis=1)
            value = band[np.arange(len(band)), top]
            loud[a : a + len(band), k] = value
            where[a : a + len(band), k] = top + low
            clear[a : a + len(band), k] = value > 1.5 * band.mean(axis=1)
    before = np.vstack([np.zeros((1, loud.shape[1]), np.float32), loud[:-1]])
    after = np.vstack([loud[1:], np.zeros((1, loud.shape[1]), np.float32)])
    frame, band = np.nonzero(clear & (loud >= before) & (loud > after))
    return frame, where[frame, band]


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of peak pairs (first bin 9 bits, second bin 9 bits, frames between 5 bits) and the frame of the first peak, in time order."""
    frame, bins = peaks(samples)
    codes, times, lags = [], [], []
    for k in range(1, PAIRS + 1):
        if len(frame) <= k:
            break
        gap = frame[k:] - frame[:-k]
        ok = gap <= REACH
        codes.append(bins[:-k][ok].astype(np.int64) << 14 | bins[k:][ok].astype(np.int64) << 5 | gap[ok])
        times.append(frame[:-k][ok])
        lags.append(np.full(int(ok.sum()), k))
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    code, time, lag = np.concatenate(codes), np.concatenate(times), np.concatenate(lags)
    order = np.lexsort((code, lag, time))
    return code[order].astype(np.int32), time[order].astype(np.int32)


def to_wav_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes`` of the text in UTF-8 and ``media``: the text padded with bytes 255 to a positive multiple of 576, as a WAV file.

    Null text counts as empty (one unit of padding).  Null and repeated ids are
    carried through; each row is on its own, so ties and empty tables need no rule.
    """

    @frugal
    def store(batches):
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                data = text.encode()
                sizes.append(len(data))
                media.append(to_wav(data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\xff")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(store, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def wav_fingerprints(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``media`` with ``payload`` (the samples read back), and the time-coded arrays ``codes`` and ``times``.

    A null media value gives nulls in the three.  Columns of the table that
    already have one of these names (in any case) are replaced.  Each row is on
    its own: null and repeated ids are carried, an empty table gives no rows.
    """
    made = ("payload", "codes", "times")
    carried = [c for c in media.columns if c.lower() not in made]

    @frugal
    def features(batches):
        for batch in batches:
            payloads, codes, times = [], [], []
            for value in batch.column(len(carried)):
                stored = value.as_py()
                samples = None if stored is None else from_wav(stored)
                payloads.append(samples)
                code, time = (None, None) if stored is None else fingerprint(np.frombuffer(samples, np.uint8))
                codes.append(code)
                times.append(time)
            columns = [*batch.columns[: len(carried)], pa.array(payloads, pa.binary()), pa.array(codes, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*carried, *made])

    kinds = "".join(f"`{n}` {t}, " for n, t in media.dtypes if n in carried)
    rows = media.select(*(F.col(f"`{c}`") for c in carried), F.col(media_col).alias("__media"))
    return rows.mapInArrow(features, f"{kinds}payload binary, codes array<int>, times array<int>")
