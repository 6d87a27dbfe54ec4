"""Media columns: payload bytes kept as WAV sound, and fingerprints of its spectral peaks.

A text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, are the samples of a
mono 8-bit WAV file written and read by the wave module. The samples that were read back are cut
into frames; of each frame's spectrum the strongest bin of each band is a peak if it exceeds the
same band's peaks of both neighbouring frames. A peak and one of the next peaks form a pair, kept
as one long: time << 32 | first bin << 20 | second bin << 8 | distance in time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from philolog.llm import _bytes

UNIT = 192
RATE = 8000
#: Frames whose spectra are held at once.
FRAMES_AT_ONCE = 4096
#: Upper ends of the bands of spectrum bins; bin 0 is the mean.
BANDS = (8, 20, 44, 97)
#: Following peaks that a peak is paired with, within this many frames.
FAN_OUT, REACH = 2, 32


def write_wav(samples: bytes) -> bytes:
    with io.BytesIO() as file:
        with wave.open(file, "wb") as out:
            out.setnchannels(1)
            out.setsampwidth(1)
            out.setframerate(RATE)
            out.writeframes(samples)
        return file.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as source:
        return source.readframes(source.getnframes())


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strength and bin of the strongest bin for each frame of UNIT samples and each band."""
    window, frames = np.hanning(UNIT).astype(np.float32), samples.reshape(-1, UNIT)
    strength, bins = np.zeros((len(frames), len(BANDS)), np.float32), np.zeros((len(frames), len(BANDS)), np.int64)
    for lo in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[lo : lo + FRAMES_AT_ONCE].astype(np.float32) - 128
        spectrum = np.abs(np.fft.rfft(part * window, axis=1))
        low = 1
        for k, high in enumerate(BANDS):
            best = spectrum[:, low:high].argmax(1)
            bins[lo : lo + len(part), k] = best + low
            strength[lo : lo + len(part), k] = spectrum[np.arange(len(part)), best + low]
            low = high
    return strength, bins


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Peak pairs in the order of time."""
    strength, bins = band_peaks(samples)
    fenced = np.pad(strength, ((1, 1), (0, 0)), constant_values=-1)
    times, bands = np.nonzero((strength > fenced[:-2]) & (strength >= fenced[2:]))
    peaks = bins[times, bands]
    out = []
    for step in range(1, FAN_OUT + 1):
        if len(times) > step:
            apart = times[step:] - times[:-step]
            near = apart <= REACH
            out.append((times[:-step] << 32 | peaks[:-step] << 20 | peaks[step:] << 8 | apart)[near])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def describe(text: bytes, keep: bool) -> tuple:
    payload = text + b" " * (-len(text) % UNIT or (0 if text else UNIT))
    media = write_wav(payload)
    back = read_wav(media)
    pairs = fingerprint(np.frombuffer(back, np.uint8))
    feature = f"{len(pairs)}:{hashlib.blake2b(pairs.astype('<i8').tobytes(), digest_size=16).hexdigest()}"
    return (
        len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media),
        hashlib.sha256(media).hexdigest(), feature, pairs, media if keep else None,
    )


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
        ("pairs", pa.list_(pa.int64())), ("media", pa.binary()),
    ]
)
#: Bytes of text in one output batch.
BATCH_BYTES = 8 << 20


def to_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep_media: bool = True) -> DataFrame:
    """One row per row of docs: sizes, digests, `pairs` (array of long), `feature` and, if kept, the file as `media`.

    feature is the number of pairs and a digest of them, so equal texts have equal features. A null
    text counts as empty (192 spaces); an id may be null or repeated. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            data, offsets = _bytes.utf8(batch.column(1))
            for lo, hi in _bytes.blocks(offsets, BATCH_BYTES):
                rows = [describe(data[offsets[i] : offsets[i + 1]].tobytes(), keep_media) for i in range(lo, hi)]
                arrays = [batch.column(0).slice(lo, hi - lo), *(pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), list(SCHEMA)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.binary(): "binary"}
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in SCHEMA))
