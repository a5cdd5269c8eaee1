"""Audio columns: samples kept losslessly as WAV, resampled, turned into log-mel tensors and segmented by energy."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import by_bytes, map_arrow, stage

#: Samples a second as stored, and as analysed after resampling by UP / DOWN.
RATE, UP, DOWN = 16000, 2, 3
#: Filter taps for each of the UP phases; frame, hop and mel bands; frames of one tensor.
TAPS, FRAME, HOP, MELS, TENSOR = 16, 256, 128, 24, 64
#: Decibels below a recording's loudest frame at which a segment begins, and below which it ends.
OPEN_DB, CLOSE_DB = 3.0, 6.0
#: Frames that are computed together; memory follows it, not a recording's length.
SLAB = 1 << 13
#: A payload is padded with spaces to a positive multiple of this.
UNIT = 192


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples; the payload's length is even."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(wav: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit WAV file; chunks other than fmt and data are passed over."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(wav):
        name, size = wav[at : at + 4], struct.unpack_from("<I", wav, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", wav, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            return wav[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def _phases() -> np.ndarray:
    """The low-pass prototype, a Kaiser-windowed sinc, split into its UP phases: (UP, TAPS), each of sum 1."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.kaiser(UP * TAPS, 8.0)
    h = np.stack([h[p::UP][::-1] for p in range(UP)])
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resampled_length(n: int) -> int:
    return -(-n * UP // DOWN)


def resample(x: np.ndarray, begin: int = 0, end: int | None = None) -> np.ndarray:
    """UP / DOWN polyphase resampling: output m is phase (m * DOWN) % UP over the TAPS inputs about m * DOWN / UP.

    Outputs ``begin`` to ``end``, all without them; inputs are zero outside of ``x``. Unsigned bytes are samples about 128.
    """
    end = resampled_length(len(x)) if end is None else end
    base = begin * DOWN // UP
    low, high = base - TAPS // 2, (max(end, begin + 1) - 1) * DOWN // UP + TAPS + DOWN
    part = x[max(low, 0) : high]
    part = (part.astype(np.float32) - 128) / 128 if x.dtype == np.uint8 else part
    part = np.pad(part, (max(-low, 0), max(high - len(x), 0)))
    windows = np.lib.stride_tricks.sliding_window_view(part, TAPS)
    out = np.empty(end - begin, np.float32)
    for c in range(min(UP, end - begin)):
        count = len(range(c, end - begin, UP))
        at, phase = divmod((begin + c) * DOWN, UP)
        out[c::UP] = windows[at - base : at - base + DOWN * count : DOWN][:count] @ _phases()[phase]
    return out


@lru_cache
def _mel() -> np.ndarray:
    """Triangular filters, evenly spaced in mel: (FRAME // 2 + 1, MELS)."""
    top = RATE * UP / DOWN / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(0, mel(top), MELS + 2) / 2595) - 1)
    f = np.linspace(0, top, FRAME // 2 + 1)[:, None]
    rise, fall = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@lru_cache
def _window() -> np.ndarray:
    return np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log10 mel energies of overlapped frames of the resampled ``x``, and each frame's energy in decibels."""
    length = resampled_length(len(x))
    n = max(1, -(-(length - FRAME) // HOP) + 1)
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for low in range(0, n, SLAB):
        high = min(low + SLAB, n)
        y = resample(x, low * HOP, min((high - 1) * HOP + FRAME, length))
        y = np.pad(y, (0, (high - low - 1) * HOP + FRAME - len(y)))
        part = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * _window()
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32) ** 2
        mel[low:high] = np.log10(np.maximum(power @ _mel(), 1e-8))
        energy[low:high] = 10 * np.log10(np.maximum((part**2).mean(axis=1), 1e-8))
    return mel, energy


def segments(energy: np.ndarray) -> np.ndarray:
    """(first, last + 1) frames of segments: one opens at OPEN_DB below the loudest frame and lasts until CLOSE_DB below it."""
    top = energy.max()
    event = np.where(energy >= top - OPEN_DB, 1, np.where(energy < top - CLOSE_DB, 0, -1))
    known = np.maximum.accumulate(np.where(event >= 0, np.arange(len(event)), -1))
    state = np.where(known >= 0, event[np.maximum(known, 0)], 0)
    edge = np.flatnonzero(np.diff(np.r_[0, state, 0]))
    return edge.reshape(-1, 2)


#: The stored type: half-precision tensors of TENSOR frames by MELS bands.
TENSOR_TYPE = pa.fixed_shape_tensor(pa.float16(), (TENSOR, MELS), dim_names=("frame", "mel"))
_PARTS = pa.schema([("t_begin", pa.float64()), ("t_end", pa.float64()), ("n_frames", pa.int32()), ("tensor", TENSOR_TYPE)])
#: Seconds from one frame to the next.
STEP = HOP * DOWN / UP / RATE


def to_arrow(mel: np.ndarray) -> bytes:
    """An Arrow stream with a row for each TENSOR frames: t_begin, t_end, n_frames and a fixed-shape tensor.

    The last tensor is filled up with the floor of the logarithm.
    """
    count = -(-len(mel) // TENSOR)
    out = np.full((count * TENSOR, MELS), -8.0, np.float16)
    out[: len(mel)] = mel
    first = np.arange(count) * TENSOR
    last = np.minimum(first + TENSOR, len(mel))
    values = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), TENSOR * MELS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PARTS) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array(first * STEP), pa.array(last * STEP), pa.array((last - first).astype(np.int32)), pa.ExtensionArray.from_storage(TENSOR_TYPE, values)], schema=_PARTS))
    return sink.getvalue().to_pybytes()


def from_arrow(stored: bytes) -> pa.Table:
    """The inverse of ``to_arrow``; the tensor column has its shape."""
    return pa.ipc.open_stream(stored).read_all()


def store(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes and media: each whole text's UTF-8 bytes (null: none), padded with spaces, as a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "t"):
            texts = b["t"].to_pylist()
            n = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array([to_wav(payload_of(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])

    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text).alias("t")), run, f"id {dict(df.dtypes)[id_col]}, n_bytes long, media binary")


_SPANS = pa.list_(pa.struct([("t_begin", pa.float64()), ("t_end", pa.float64())]))


def analyse(df: DataFrame) -> DataFrame:
    """Features of a ``store`` table, from the stored bytes.

    id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, n_frames, segments (array of
    begin and end in seconds) and tensors: an Arrow stream of fixed-shape log-mel tensors with their time spans, as
    ``from_arrow`` reads it. Silence, such as an empty text's spaces, is one segment. A null or broken file fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "media"):
            rows = []
            for media in b["media"].to_pylist():
                payload, _ = from_wav(media)
                mel, energy = log_mel(np.frombuffer(payload, np.uint8))
                spans = [{"t_begin": p * STEP, "t_end": q * STEP} for p, q in segments(energy).tolist()]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), len(mel), spans, to_arrow(mel)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), _SPANS, pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b["id"], b["n_bytes"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "segments", "tensors"])

    schema = f"id {dict(df.dtypes)['id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, segments array<struct<t_begin: double, t_end: double>>, tensors binary"
    return map_arrow(df.select("id", "n_bytes", "media"), run, schema)


def describe(df: DataFrame) -> DataFrame:
    """An ``analyse`` table with feature in place of n_frames, segments and tensors, a line of text from what is stored.

    It has the frames, segments, seconds of sound, the last tensor's end and a crc32 of the tensors' values.
    """
    kept = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "tensors"):
            lines = []
            for spans, stored in zip(b["segments"].to_pylist(), b["tensors"].to_pylist(), strict=True):
                table = from_arrow(stored)
                values = table["tensor"].combine_chunks().storage.flatten().to_numpy()
                sound = sum(s["t_end"] - s["t_begin"] for s in spans)
                lines.append(f"frames={sum(table['n_frames'].to_pylist())} segments={len(spans)} sound={sound:.3f}s end={table['t_end'][-1].as_py():.3f}s logmel={zlib.crc32(values.astype('<f2').tobytes()):08x}")
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(lines, pa.string())], [*kept, "feature"])

    types = dict(df.dtypes)
    return map_arrow(df.select(*kept, "segments", "tensors"), run, ", ".join(f"{c} {types[c]}" for c in kept) + ", feature string")


def audio_features(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``analyse`` of ``store``, each written as a table in the shared folder and read back."""
    return stage(analyse(stage(store(df, id_col, text), "media")), "media-features")
