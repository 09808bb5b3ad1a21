"""Audio media columns: lossless 8-bit WAV, polyphase resampling, log-mel tensors and energy segments.

store()     writes bytes as mono 8-bit PCM WAV files (one binary value a row) in a table of the shared folder.
analyse()   reads the stored bytes back, resamples by a rational factor with a polyphase windowed-sinc filter, takes
              overlapped frames through a mel filterbank, cuts the log-mel frames into patches of a fixed shape, and finds
              segments whose energy rises above one threshold and has not yet fallen below a lower one.
tensors      of a file are one Arrow stream: a row for each patch with its time span (start, end) and the patch as a
              fixed_shape_tensor; read_tensors() reads it back, whatever engine has stored the bytes.

A patch is a row-major float32 array of SHAPE (frames, mel bands); the last one is filled up with the floor
value. Time spans are in seconds. Long media are worked on in blocks of frames.

Defined results: null and empty payloads are padded to one unit; equal payloads give equal values; a null or
unreadable file gives null features; repeated rows get one result each; columns besides id and payload are ignored.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import scratch_path, text_batches

RATE, TARGET = 16_000, 8_000
FRAME, HOP, BANDS = 256, 128, 32
SHAPE = (32, BANDS)
FLOOR = 1e-10
TENSORS = pa.schema([("start", pa.float64()), ("end", pa.float64()), ("patch", pa.fixed_shape_tensor(pa.float32(), SHAPE, dim_names=["frame", "band"]))])
BLOCK_FRAMES = 4096
FEATURES = "struct<payload:binary,seconds:double,frames:long,tensors:binary,segments:array<struct<start:double,end:double,level:double>>>"


def padded(payload: Column, unit: int = 576, fill: str = "FF") -> Column:
    """Bytes filled up to a positive multiple of unit; null is empty."""
    data = F.coalesce(payload, F.lit("").cast("binary"))
    size = F.octet_length(data)
    missing = F.greatest(F.lit(1), F.ceil(size / unit).cast("int")) * unit - size
    return F.concat(data, F.unhex(F.repeat(F.lit(fill), missing)))


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of unsigned 8-bit mono samples; an odd payload gets the format's pad byte."""
    odd = len(payload) % 2
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload) + odd, b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * odd


def samples(file: bytes) -> tuple[bytes, int]:
    """(sample bytes, rate) of such a file, found by walking its chunks."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(file):
        kind, size = struct.unpack_from("<4sI", file, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", file, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM")
        elif kind == b"data":
            return file[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@functools.cache
def _phases(up: int, down: int, half: int = 8) -> tuple[np.ndarray, int]:
    """Taps by phase (up, taps) of a Hann-windowed low-pass at the narrower band's edge, and its delay."""
    wide = max(up, down)
    n = np.arange(-half * wide, half * wide + 1)
    h = np.sinc(n / wide) * (0.5 + 0.5 * np.cos(np.pi * n / (half * wide + 1)))
    h *= up / h.sum()
    taps = -(-len(h) // up)
    table = np.zeros((up, taps), np.float32)
    for p in range(up):
        own = h[p::up]
        table[p, : len(own)] = own
    return table[:, ::-1].copy(), half * wide


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase: output m is the dot product of the inputs around m * down / up with the taps of one phase."""
    common = gcd(up, down)
    up, down = up // common, down // common
    if up == down:
        return x.astype(np.float32)
    table, delay = _phases(up, down)
    taps, size = table.shape[1], -(-len(x) * up // down)
    place = np.arange(size) * down + delay  # in upsampled steps
    last = place // up  # newest input that the filter touches
    edge = np.concatenate([np.zeros(taps - 1, np.float32), x.astype(np.float32), np.zeros(int(last[-1]) + 1 - len(x) if size and last[-1] >= len(x) else 0, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(edge, taps)
    out = np.empty(size, np.float32)
    for first in range(up):  # outputs of one phase stand at equal steps
        mine = slice(first, None, up)
        step = windows[last[first] :: down][: len(out[mine])]
        out[mine] = step @ table[place[first] % up]
    return out


@functools.cache
def _bank(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and triangular mel filters (spectrum, bands)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), BANDS + 2) / 2595) - 1)
    freqs = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rise = (freqs - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - freqs) / (edges[2:] - edges[1:-1])
    return np.hanning(FRAME).astype(np.float32), np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames, energy of each frame in dB) of overlapped frames; a short signal is filled up to one frame."""
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.float32)])
    window, filters = _bank(rate)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mels, energy = np.empty((len(frames), BANDS), np.float32), np.empty(len(frames))
    for at in range(0, len(frames), BLOCK_FRAMES):
        part = frames[at : at + BLOCK_FRAMES]
        spectrum = np.abs(np.fft.rfft(part * window, axis=1)).astype(np.float32) ** 2
        mels[at : at + BLOCK_FRAMES] = np.log10(np.maximum(spectrum @ filters, FLOOR))
        energy[at : at + BLOCK_FRAMES] = 10 * np.log10(np.maximum(np.einsum("ij,ij->i", part, part, dtype=np.float64) / FRAME, FLOOR))
    return mels, energy


def segments(energy: np.ndarray, rise: float = 0.25, fall: float = 0.25) -> list[tuple[int, int]]:
    """[first, last) frames of each segment: it starts at or above mean + rise * deviation and lasts until below mean - fall * deviation."""
    mean, deviation = energy.mean(), energy.std()
    mark = np.where(energy >= mean + rise * deviation, 1, np.where(energy < mean - fall * deviation, -1, 0))
    known = np.where(mark != 0, np.arange(len(mark)), -1)
    last = np.maximum.accumulate(known)
    on = np.concatenate([[False], (last >= 0) & (mark[np.maximum(last, 0)] == 1), [False]])
    turns = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def tensor_stream(start: np.ndarray, end: np.ndarray, patches: np.ndarray) -> bytes:
    """An Arrow stream of TENSORS: a row for each patch."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(patches.reshape(-1)), SHAPE[0] * SHAPE[1])
    rows = pa.record_batch([pa.array(start, pa.float64()), pa.array(end, pa.float64()), pa.ExtensionArray.from_storage(TENSORS.field("patch").type, flat)], schema=TENSORS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSORS) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(spans, patches) of such a stream: (n, 2) seconds and (n, frames, bands)."""
    table = pa.ipc.open_stream(stream).read_all()
    if table.schema != TENSORS:
        raise ValueError("not a stream of such tensors")
    rows = table.combine_chunks()
    spans = np.stack([rows["start"].to_numpy(), rows["end"].to_numpy()], 1)
    return spans, rows["patch"].combine_chunks().to_numpy_ndarray()


def describe(file: bytes) -> dict:
    data, rate = samples(file)
    x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x, TARGET, rate)
    mels, energy = log_mel(y, TARGET)
    seconds = lambda frame: frame * HOP / TARGET
    first = np.arange(0, len(mels), SHAPE[0])
    last = np.minimum(first + SHAPE[0], len(mels)) - 1
    patches = np.full((len(first) * SHAPE[0], BANDS), np.log10(FLOOR), np.float32)
    patches[: len(mels)] = mels
    found = [{"start": seconds(a), "end": seconds(b - 1) + FRAME / TARGET, "level": round(float(energy[a:b].mean()), 3)} for a, b in segments(energy)]
    return {"payload": data, "seconds": len(x) / rate, "frames": len(mels), "tensors": tensor_stream(seconds(first), seconds(last) + FRAME / TARGET, patches.reshape(-1, *SHAPE)), "segments": found}


def store(rows: DataFrame, payload: Column, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, n_bytes, media): the payload of each row, padded, as a WAV file, in a table at path (default: the shared folder)."""
    text_batches(rows.sparkSession)

    @F.pandas_udf("binary")
    def encode(data: pd.Series) -> pd.Series:
        return pd.Series([wav(d) for d in data], dtype=object)

    path = path or scratch_path(rows.sparkSession)
    n_bytes = F.coalesce(F.octet_length(payload), F.lit(0)).cast("long")
    made = rows.select(F.col(id_col), n_bytes.alias("n_bytes"), encode(padded(payload)).alias("media"))
    made.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(made.schema).parquet(path)


def analyse(media: DataFrame, media_col: str = "media", out_col: str = "audio") -> DataFrame:
    """media with a struct of the payload read back, its length in seconds, tensors and segments."""
    text_batches(media.sparkSession)

    @F.pandas_udf(FEATURES)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("payload", "seconds", "frames", "tensors", "segments")
        for files in batches:
            out = []
            for file in files:
                try:
                    out.append(describe(file))
                except (ValueError, TypeError, struct.error):
                    out.append(dict.fromkeys(names))
            yield pd.DataFrame(out, columns=list(names))

    return media.withColumn(out_col, of(F.col(media_col)))
