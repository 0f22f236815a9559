"""Gradient compression: half precision, thresholds, runs of kept entries, error feedback."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed value: the smallest normal half-precision float, the least threshold.
LEAST_THRESHOLD = np.float32(2.0**-14)
#: Entries that a threshold is estimated from at most.
SAMPLE = 16_384


class CodecError(ValueError):
    """Bytes that aren't an encoded gradient."""


def half(values: np.ndarray) -> np.ndarray:
    """Rounded to half precision and back."""
    with np.errstate(over="ignore"):
        return values.astype(np.float16).astype(np.float32)


def threshold(values: np.ndarray, keep_ratio: float, rng: np.random.Generator | None = None) -> np.float32:
    """Entries of at least this size are about the share ``keep_ratio`` of all."""
    size = np.abs(values)
    if len(size) > SAMPLE:
        size = (rng or np.random.default_rng(0)).choice(size, SAMPLE, replace=False)
    if not len(size):
        return LEAST_THRESHOLD
    k = min(int(len(size) * (1 - keep_ratio)), len(size) - 1)
    return max(np.float32(np.partition(size, k)[k]), LEAST_THRESHOLD)


def runs(values: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(start, length) of the stretches of entries of at least ``least``."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.abs(values) >= least).astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def encode_sparse(values: np.ndarray, least: float) -> bytes:
    """Length, then for each run the gap before it, its length and its half-precision values."""
    out, at = [struct.pack("<Q", len(values))], 0
    for start, n in runs(values, least):
        out.append(struct.pack("<II", start - at, n) + values[start : start + n].astype("<f2").tobytes())
        at = start + n
    return b"".join(out)


def decode_sparse(body: bytes) -> np.ndarray:
    """Zero between the runs; raises on bytes that end early or reach beyond the length."""
    if len(body) < 8:
        raise CodecError("no length")
    (n,) = struct.unpack_from("<Q", body)
    out, at, pos = np.zeros(n, np.float32), 0, 8
    while pos < len(body):
        if pos + 8 > len(body):
            raise CodecError("a run ends early")
        gap, k = struct.unpack_from("<II", body, pos)
        at, pos = at + gap, pos + 8
        if at + k > n or pos + 2 * k > len(body):
            raise CodecError("a run reaches beyond the gradient")
        out[at : at + k] = np.frombuffer(body, "<f2", k, pos)
        at, pos = at + k, pos + 2 * k
    return out


def compress(values: np.ndarray, keep_ratio: float | None) -> tuple[bytes, bool]:
    """(bytes, sparse): sparse only if that takes no more than half precision for all."""
    if keep_ratio is not None:
        body = encode_sparse(values, threshold(values, keep_ratio))
        if len(body) <= 2 * len(values):
            return body, True
    with np.errstate(over="ignore"):
        return values.astype("<f2").tobytes(), False


def decompress(body: bytes, sparse: bool) -> np.ndarray:
    return decode_sparse(body) if sparse else np.frombuffer(body, "<f2").astype(np.float32)


def send(residual: np.ndarray, keep_ratio: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(what arrives, what is left for the next round): entries that a sparse push sent leave the residual,
    a dense push clears it."""
    body, sparse = compress(residual, keep_ratio)
    arrived = decompress(body, sparse)
    if not sparse:
        return arrived, np.zeros_like(residual)
    sent = np.zeros(len(residual), bool)
    for start, n in runs(residual, threshold(residual, keep_ratio)):
        sent[start : start + n] = True
    return arrived, np.where(sent, np.float32(0), residual)
