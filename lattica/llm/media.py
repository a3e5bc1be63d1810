"""Audio columns: lossless 8-bit WAV storage and log-mel features as fixed-shape tensors with time spans.

``store`` writes a media table (id, WAV bytes) to the shared folder. ``audio_features`` reads media bytes back and writes feature archives there:
Arrow streams with a row for each chunk of CHUNK frames, whose tensor column is of the canonical fixed-shape type (CHUNK x BANDS
float16, zero-padded at the end), with its start and end in seconds and the document's active segments and digests. The archives are
listed in a manifest table. ``read_chunks`` and ``read_digests`` read them, batch by batch.

* resampling: polyphase, RATE * UP / DOWN, one windowed-sinc filter of TAPS taps a phase, computed in blocks;
* frames: FRAME samples every HOP (overlapping), Hann window, power spectrum, triangular mel bands, natural log;
* segments: frames whose level passes ``high`` open a segment, which lasts while the level stays above ``low``
  (hysteresis; both in dB below the loudest frame).

Defined results: a null or empty payload is 64 zero
bytes; equal payloads give equal media and features; null and repeated ids and other columns pass through; an empty table gives
no rows. Memory follows the batch and one row's samples in blocks of BLOCK.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.shared import bound_batches, fresh_path, materialize

from .storage import open_input, open_output

RATE, UP, DOWN, TAPS = 8000, 3, 4, 8
FRAME, HOP, BANDS, CHUNK = 256, 128, 32, 32
PAD = 64
BLOCK = 1 << 16
HIGH, LOW = 6.0, 12.0


def pad(payload: bytes, unit: int = PAD) -> bytes:
    return payload + b"\0" * (max(unit, -(-len(payload) // unit) * unit) - len(payload))


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """Mono 8-bit PCM."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def samples_of(stored: bytes) -> tuple[bytes, int]:
    """The samples and rate of a mono 8-bit WAV; walks its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at, rate = 12, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        if name == b"data":
            return stored[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def _filter() -> np.ndarray:
    """(window, UP): the taps that make UP outputs from a window of inputs which moves by DOWN."""
    half = TAPS * UP // 2
    t = np.arange(-half, half + 1)
    cutoff = 1 / max(UP, DOWN)
    h = UP * cutoff * np.sinc(cutoff * t) * np.hamming(len(t))
    width = TAPS + DOWN + 1
    m = np.zeros((width, UP))
    for p in range(UP):
        for i in range(width):  # output p of a block stands at p * DOWN / UP inputs after the block's first
            k = p * DOWN - UP * (i - TAPS // 2) + half
            if 0 <= k < len(h):
                m[i, p] = h[k]
    return m


@cache
def _mel() -> np.ndarray:
    """(FRAME // 2 + 1, BANDS) triangles, evenly spread over the mel scale."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(30.0), mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    return np.clip(np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0, None)


_WINDOW = np.hanning(FRAME + 1)[:-1]


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase rate change by UP / DOWN."""
    m, blocks = _filter(), -(-len(x) // DOWN)
    padded = np.zeros(blocks * DOWN + len(m))
    padded[TAPS // 2 : TAPS // 2 + len(x)] = x
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(m))[::DOWN]
    out = np.empty((blocks, UP))
    for at in range(0, blocks, BLOCK // DOWN):
        out[at : at + BLOCK // DOWN] = windows[at : min(at + BLOCK // DOWN, blocks)] @ m
    return out.reshape(-1)[: -(-len(x) * UP // DOWN)]


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, BANDS) log-mel energies rounded to 3 decimals, and each frame's level in dB."""
    frames = max(1, -(-max(0, len(y) - FRAME) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + FRAME)
    padded[: min(len(y), len(padded))] = y[: len(padded)]
    windows = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    mels, level = np.empty((frames, BANDS)), np.empty(frames)
    for at in range(0, frames, BLOCK // FRAME):
        part = windows[at : at + BLOCK // FRAME] * _WINDOW
        spectrum = np.fft.rfft(part, axis=1)
        mels[at : at + len(part)] = (spectrum.real**2 + spectrum.imag**2) @ _mel()
        level[at : at + len(part)] = np.einsum("ij,ij->i", part, part)
    return np.round(np.log(mels + 1e-6), 3), np.round(10 * np.log10(level + 1e-9), 3)


def segments(level: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """[first, last + 1) frames of runs above the low threshold that pass the high one."""
    top = level.max()
    on = np.concatenate([[False], level >= top - low, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
    passed = np.concatenate([[0], np.cumsum(level >= top - high)])
    return [(int(a), int(b)) for a, b in edges if passed[b] > passed[a]]


def features(samples: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]]]:
    """Tensors (chunks, CHUNK, BANDS) in half precision, their spans (chunks, 2) and active segments, in seconds."""
    x = (np.frombuffer(samples, np.uint8) - 128.0) / 128.0
    mels, level = log_mel(resample(x))
    step, rate = HOP * DOWN / UP / RATE, RATE * UP / DOWN
    chunks = -(-len(mels) // CHUNK)
    tensor = np.zeros((chunks * CHUNK, BANDS), np.float16)
    tensor[: len(mels)] = mels
    first = np.arange(chunks) * CHUNK
    last = np.minimum(first + CHUNK, len(mels)) - 1
    spans = np.stack([first * step, last * step + FRAME / rate], 1)
    return tensor.reshape(chunks, CHUNK, BANDS), spans, [(a * step, (b - 1) * step + FRAME / rate) for a, b in segments(level)]


def store(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A written media table: doc_id, n_bytes, media (WAV of the padded UTF-8 text)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def run(batches):
        for batch in batches:
            bodies = [x.as_buffer().to_pybytes() for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in bodies], pa.int64()), pa.array([wav(pad(x)) for x in bodies], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    path = fresh_path(docs.sparkSession, "media")
    stored = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")
    stored.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(stored.schema).parquet(path)


ROLL = 1 << 14  # chunks in an archive
ROWS = 1024  # chunks in a record batch
TENSOR = pa.fixed_shape_tensor(pa.float16(), [CHUNK, BANDS])
_SPAN = [("start", pa.float64()), ("end", pa.float64())]
_DIGEST = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]


def _archive_schema(doc_id: pa.DataType) -> pa.Schema:
    return pa.schema([("row", pa.int64()), ("doc_id", doc_id), *_DIGEST, ("active", pa.list_(pa.struct(_SPAN))), *_SPAN, ("tensor", TENSOR)])


def _write_features(folder: str):
    def run(batches):
        sink = writer = None
        path, chunks, docs = "", 0, 0
        held: list[tuple] = []

        def put() -> None:
            """The held documents as one record batch."""
            row, ids, digests, tensors, spans, active = zip(*held, strict=True)
            times = [len(x) for x in tensors]
            at = pa.array(np.repeat(np.arange(len(held)), times))
            flat = pa.array(np.concatenate(tensors).reshape(-1))
            storage = pa.FixedSizeListArray.from_arrays(flat, CHUNK * BANDS)
            both = np.concatenate(spans)
            columns = [pa.array(row, pa.int64()).take(at), pa.concat_arrays(ids).take(at)]
            columns += [pa.array([x[i] for x in digests], kind).take(at) for i, (_, kind) in enumerate(_DIGEST)]
            columns.append(pa.array([[dict(start=a, end=b) for a, b in x] for x in active], pa.list_(pa.struct(_SPAN))).take(at))
            columns += [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.ExtensionArray.from_storage(TENSOR, storage)]
            writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=writer_schema))
            held.clear()

        def close() -> pa.RecordBatch:
            writer.close()
            sink.close()
            return pa.RecordBatch.from_pylist([{"path": path, "documents": docs, "chunks": chunks}], _MANIFEST)

        for batch in batches:
            ids, sizes = batch.column("doc_id"), batch.column("n_bytes")
            for k, stored in enumerate(batch.column("media")):
                stored = stored.as_buffer().to_pybytes()
                samples, _ = samples_of(stored)
                tensor, spans, active = features(samples)
                if writer is None:
                    path, chunks, docs = f"{folder}/part-{uuid.uuid4().hex}.arrow", 0, 0
                    sink, writer_schema = open_output(path), _archive_schema(ids.type)
                    writer = pa.ipc.new_stream(sink, writer_schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                digest = (sizes[k].as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest())
                held.append((docs, ids.slice(k, 1), digest, tensor, spans, active))
                docs, chunks = docs + 1, chunks + len(tensor)
                if chunks // ROWS > (chunks - len(tensor)) // ROWS:
                    put()
                if chunks >= ROLL:
                    if held:
                        put()
                    yield close()
                    writer = None
            if held:  # their ids belong to this batch
                put()
        if writer is not None:
            yield close()

    return run


_MANIFEST = pa.schema([("path", pa.string()), ("documents", pa.int64()), ("chunks", pa.int64())])


def audio_features(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, media) -> the written manifest of its feature archives: path, documents, chunks."""
    folder = fresh_path(media.sparkSession, "audio")
    return materialize(media.select("doc_id", "n_bytes", "media").mapInArrow(_write_features(folder), "path string, documents long, chunks long"), "audio-manifest")


def open_archive(path: str) -> Iterator[pa.RecordBatch]:
    """Record batches of one feature archive."""
    with open_input(path) as source, pa.ipc.open_stream(source) as reader:
        yield from reader


def _read(manifest: DataFrame, rows, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from rows(open_archive(path))

    return manifest.repartition(max(1, manifest.count()), "path").select("path").mapInArrow(run, schema)


def read_chunks(manifest: DataFrame, doc_id: str = "long") -> DataFrame:
    """doc_id, start, end, tensor (CHUNK * BANDS numbers) of every chunk; doc_id: the Spark type of the ids."""

    def rows(batches):
        for b in batches:
            storage = b.column("tensor").storage
            offsets = pa.array(np.arange(0, (len(b) + 1) * CHUNK * BANDS, CHUNK * BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("end"), pa.ListArray.from_arrays(offsets, pa.array(storage.flatten().to_numpy(zero_copy_only=False).astype(np.float32)))], names=["doc_id", "start", "end", "tensor"])

    return _read(manifest, rows, f"doc_id {doc_id}, start double, end double, tensor array<float>")


def _described(batches):
    """Documents of an archive, each from all its chunks, which may go on in the next batch."""
    names = [n for n, _ in _DIGEST]
    now = None  # [row, id, digests, chunks, sum, sha, last end, active]

    def out(docs):
        feature = [
            f"chunks={n};seconds={end:.3f};mean={total / (n * CHUNK * BANDS):.3f};tensor={sha.hexdigest()[:16]};active=" + ",".join(f"{x['start']:.3f}-{x['end']:.3f}" for x in active)
            for _, _, _, n, total, sha, end, active in docs
        ]
        columns = [pa.array([d[2][i] for d in docs], kind) for i, (_, kind) in enumerate(_DIGEST)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([d[1] for d in docs]), *columns, pa.array(feature)], names=["doc_id", *names, "feature"])

    for batch in batches:
        docs = []
        row = batch.column("row").to_numpy()
        flat = batch.column("tensor").storage.flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        sums = np.add.reduceat(flat.sum(1, dtype=np.float64), first)
        ends = batch.column("end").to_numpy()
        digests = list(zip(*(batch.column(n).take(pa.array(first)).to_pylist() for n in names), strict=True))
        actives = batch.column("active").take(pa.array(first)).to_pylist()
        for k, (a, b) in enumerate(zip(first.tolist(), np.r_[first[1:], len(row)].tolist(), strict=True)):
            if now is None or now[0] != row[a]:
                if now is not None:
                    docs.append(now)
                now = [int(row[a]), batch.column("doc_id").slice(a, 1), digests[k], 0, 0.0, hashlib.sha256(), 0.0, actives[k]]
            now[3] += b - a
            now[4] += float(sums[k])
            now[5].update(flat[a:b])
            now[6] = float(ends[b - 1])
        if docs:
            yield out(docs)
    if now is not None:
        yield out([now])


def read_digests(manifest: DataFrame, doc_id: str = "long") -> DataFrame:
    """doc_id, sizes and digests of what was read back, and the tensors read back as one string; doc_id: the Spark type of the ids."""
    columns = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _read(manifest, _described, f"doc_id {doc_id}, {columns}")
