"""Many small records in one binary value, so that a shuffle moves a few large rows.

Records of the same shape are columns of numpy arrays. `scatter` deals them out to buckets, one packed value for each bucket and
batch; Spark then groups the rows by bucket, and a task unpacks one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard

SCHEMA = "bucket long, data binary"
_ARROW = pa.schema([("bucket", pa.int64()), ("data", pa.binary())])


def pack(columns: Sequence[np.ndarray], ascending: bool = False) -> bytes:
    """Columns of one length as bytes; `ascending`: the first is sorted and unsigned, and its differences are stored."""
    parts = [np.int64(len(columns[0])).tobytes()]
    for i, col in enumerate(columns):
        if ascending and i == 0 and len(col):
            col = np.concatenate((col[:1], np.diff(col)))
        planes = np.ascontiguousarray(col).view(np.uint8).reshape(len(col), col.dtype.itemsize)
        parts.append(np.ascontiguousarray(planes.T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes, dtypes: Sequence[str], ascending: bool = False) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, dtype=np.int64, count=1)[0]), 8, []
    for i, name in enumerate(dtypes):
        kind = np.dtype(name)
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * kind.itemsize, offset=at).reshape(kind.itemsize, n)
        col = np.ascontiguousarray(planes.T).view(kind).reshape(n)
        at += n * kind.itemsize
        out.append(np.cumsum(col, dtype=kind) if ascending and i == 0 else col)
    return out


def unpack_all(blobs: Iterable[bytes], dtypes: Sequence[str], ascending: bool = False) -> list[np.ndarray]:
    parts = [unpack(x, dtypes, ascending) for x in blobs]
    if not parts:
        return [np.empty(0, dtype=x) for x in dtypes]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(dtypes))]


def scatter(bucket: np.ndarray, columns: Sequence[np.ndarray], ascending: bool = False) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that occurs; `ascending`: each bucket is sorted by its first column."""
    if not len(bucket):
        return
    order = np.lexsort((columns[0], bucket)) if ascending else np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edge = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
    blobs = [pack([c[a:b] for c in columns], ascending) for a, b in zip(edge[:-1], edge[1:])]
    yield pa.record_batch([pa.array(bucket[edge[:-1]].astype(np.int64)), pa.array(blobs, pa.binary())], schema=_ARROW)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """One of n buckets for each 64-bit hash, by its upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def bucket_count(spark, records: int, each: int) -> int:
    """Buckets of about `each` records, and no fewer than the shuffle has partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(records) // each), 1)
