"""Packed arrays in rows of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of long: their bytes above the least, each array's low ones before its high ones."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        low = int(a.min()) if len(a) else 0
        wide = (a - low).astype("<u8")
        planes = max(1, (int(wide.max()).bit_length() + 7) // 8) if len(a) else 1
        out += [np.array([len(a), low, planes], np.int64).tobytes(), np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()]
    body = b"".join(out)
    return len(body).to_bytes(8, "little") + _CODEC.compress(body, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    body = _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    at, out = 8, []
    for _ in range(int(np.frombuffer(body, np.int64, 1)[0])):
        n, low, planes = np.frombuffer(body, np.int64, 3, at).tolist()
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :planes] = np.frombuffer(body, np.uint8, n * planes, at + 24).reshape(planes, n).T
        out.append(wide.reshape(-1).view(np.int64) + low)
        at += 24 + n * planes
    return out


def as_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["task", "block", "data"])
