"""Audio columns: lossless 8-bit WAV storage, resampling, log-mel tensors and activity spans.

Samples are resampled by a polyphase filter, framed with overlap into log-mel
filterbanks, and cut into active spans by energy with hysteresis.  Features
are stored as blocks of a fixed shape (``BLOCK_FRAMES`` x ``MELS``) with the
time span of each block.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 8_000
#: Resampling ratio: 8,000 to 6,000 samples a second.
UP, DOWN = 3, 4
TAPS = 16  # of the filter, for each phase
FRAME, HOP, MELS = 256, 128, 24
BLOCK_FRAMES = 32
#: Payloads are padded to a multiple of so many bytes.
UNIT = 576
#: Samples that are resampled and framed at once; a multiple of DOWN.
PIECE = 1 << 18
#: Activity begins above the first and ends below the second level over the median log energy.
RISE, FALL = 0.10, 0.02


def pad(data: bytes) -> bytes:
    """Append bytes 255 up to a positive multiple of ``UNIT``."""
    return data + b"\xff" * ((-len(data)) % UNIT if data else UNIT)


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM WAV file; any bytes are valid samples, so nothing is lost."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


def _filter() -> np.ndarray:
    """Windowed-sinc low pass, as (phase, tap) with unit gain in each phase."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    phases = h.reshape(TAPS, UP).T
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Polyphase resampling by UP/DOWN.  Output sample m uses phase (m*DOWN) mod UP and the TAPS inputs up to m*DOWN div UP.

    ``before`` holds the TAPS - 1 inputs ahead of ``x``; without it they are silent.
    """
    phases = _filter()
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate((np.zeros(TAPS - 1, np.float32) if before is None else before, x))
    out = np.empty(n, np.float32)
    for r in range(UP):  # every UP-th output has the same phase and moves DOWN inputs on
        first = (r * DOWN) // UP
        count = len(range(r, n, UP))
        windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)[first::DOWN][:count]
        out[r::UP] = windows @ phases[(r * DOWN) % UP][::-1]
    return out


def mel_bank(rate: float) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, as (bin, mel)."""
    top = 2595.0 * np.log10(1.0 + rate / 2 / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(0.0, top, MELS + 2) / 2595.0) - 1.0)
    freqs = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (freqs[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - freqs[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(up, down)).astype(np.float32)


_WINDOW = np.hanning(FRAME).astype(np.float32)
_BANK = mel_bank(RATE * UP / DOWN)


def log_mel(samples: np.ndarray) -> np.ndarray:
    """(frames, MELS) of natural logs; the last frame is padded with silence, so every sample lies in one."""
    hops = max(0, -(-(len(samples) - FRAME) // HOP))
    samples = np.concatenate((samples, np.zeros(FRAME + hops * HOP - len(samples), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    for i in range(0, len(frames), 1024):
        power = np.abs(np.fft.rfft(frames[i : i + 1024] * _WINDOW, axis=1)).astype(np.float32) ** 2
        out[i : i + 1024] = np.log(power @ _BANK + np.float32(1e-6))
    return out


def active_spans(energy: np.ndarray) -> list[tuple[int, int]]:
    """Half-open frame ranges: a range begins where energy exceeds the upper level and lasts while it stays above the lower."""
    if not len(energy):
        return []
    middle = float(np.median(energy))
    state = np.where(energy >= middle + RISE, 1, np.where(energy < middle + FALL, -1, 0))
    marks = np.flatnonzero(state)
    if not len(marks):
        return []
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = (last >= 0) & (state[np.maximum(last, 0)] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(payload: bytes, rate: int) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]]]:
    """Blocks (n, BLOCK_FRAMES, MELS), their time spans (n, 2) in seconds, and the active spans in seconds.

    The last block is padded with the lowest value.  Silence after the payload
    lets its last samples pass the whole filter.  Payloads of more than
    ``PIECE`` samples are resampled in pieces; each takes the last inputs of
    the one before, so the result is that of the whole.
    """
    x = np.frombuffer(payload + b"\x80" * (TAPS - 1), dtype=np.uint8)
    level = lambda a, b: (x[a:b].astype(np.float32) - 128.0) / 128.0
    small = [resample(level(i, i + PIECE), level(i - TAPS + 1, i) if i else None) for i in range(0, len(x), PIECE)]
    mel = log_mel(np.concatenate(small) if len(small) > 1 else small[0])
    seconds = HOP * DOWN / UP / rate
    n = -(-len(mel) // BLOCK_FRAMES)
    blocks = np.full((n * BLOCK_FRAMES, MELS), mel.min(), np.float32)
    blocks[: len(mel)] = mel
    begins = np.arange(n) * BLOCK_FRAMES
    ends = np.minimum(begins + BLOCK_FRAMES, len(mel))
    spans = [(a * seconds, b * seconds) for a, b in active_spans(mel.mean(axis=1))]
    return blocks.reshape(n, BLOCK_FRAMES, MELS), np.stack((begins, ends), 1) * seconds, spans


def tensor_type() -> pa.FixedShapeTensorType:
    return pa.fixed_shape_tensor(pa.float32(), (BLOCK_FRAMES, MELS))


def to_tensors(values: list[list[float]]) -> pa.FixedShapeTensorArray:
    """The blocks of a row, as read from the table, as a fixed-shape Arrow tensor array."""
    storage = pa.FixedSizeListArray.from_arrays(pa.array(np.asarray(values, np.float32).reshape(-1)), BLOCK_FRAMES * MELS)
    return pa.ExtensionArray.from_storage(tensor_type(), storage)


_AUDIO = "struct<media:binary,n_bytes:long,blocks:array<struct<begin:double,end:double,mel:array<float>>>,active:array<struct<begin:double,end:double>>>"


def audio_columns(docs: DataFrame, text: str = "text", out: str = "audio") -> DataFrame:
    """Add struct ``out``: the WAV file, unpadded bytes, mel blocks with time spans, and active spans.

    ``mel`` holds BLOCK_FRAMES x MELS values in row order, the storage of
    :func:`tensor_type`.  A null text counts as empty, whose payload is one
    unit of padding.  An existing column ``out`` is replaced.
    """

    @F.pandas_udf(_AUDIO)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                data = (t or "").encode("utf-8", "surrogatepass")
                media = write_wav(pad(data))
                blocks, spans, active = features(*read_wav(media))
                held = [{"begin": a, "end": b, "mel": m} for (a, b), m in zip(spans.tolist(), blocks.reshape(len(blocks), -1), strict=True)]
                rows.append((media, len(data), held, [{"begin": a, "end": b} for a, b in active]))
            yield pd.DataFrame(rows, columns=["media", "n_bytes", "blocks", "active"])

    return docs.withColumn(out, run(F.col(text)))


_DIGEST = "struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>"


def audio_digest(docs: DataFrame, audio: str = "audio", out: str = "digest") -> DataFrame:
    """Add struct ``out`` with sums of what :func:`audio_columns` stored under ``audio``, and of the bytes read back from the media.

    ``feature`` names the tensors' shape, a digest of their values rounded to
    1/64, their mean for each third of the mel bands, the end of the last
    block, and the active spans' number and total seconds.
    """

    @F.pandas_udf(_DIGEST)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stored in batches:
            rows = []
            for media, n, held, active in zip(stored["media"], stored["n_bytes"], stored["blocks"], stored["active"], strict=True):
                media = bytes(media)
                payload, _ = read_wav(media)
                blocks = np.stack([np.asarray(b["mel"], np.float32) for b in held]).reshape(-1, BLOCK_FRAMES, MELS)
                tensors = np.round(blocks * 64).astype("<i2")
                thirds = ",".join(f"{blocks[:, :, i : i + MELS // 3].mean():.3f}" for i in range(0, MELS, MELS // 3))
                length = sum(a["end"] - a["begin"] for a in active)
                feature = f"{len(blocks)}x{BLOCK_FRAMES}x{MELS};{hashlib.sha256(tensors.tobytes()).hexdigest()[:16]};{thirds};{held[-1]['end']:.4f};{len(active)};{length:.4f}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.withColumn(out, run(F.col(audio)))
