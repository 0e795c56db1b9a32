"""Regions of RGBA images that look like codes, faces or signatures, and their redaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGION = "category string, x double, y double, width double, height double, confidence double"
DARK, BARS, BAND, FACE_AREA, PAD, BLUR = 128, 8, 4, 120, 2, 20


def _grey(rgba: np.ndarray) -> np.ndarray:
    return rgba[..., 0] * 0.299 + rgba[..., 1] * 0.587 + rgba[..., 2] * 0.114


def _runs(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and length of each run."""
    at = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    return line[at], np.diff(np.concatenate((at, [len(line)])))


def _finder(line: np.ndarray) -> float | None:
    """Centre of the middle run of a line that has runs as 1:1:3:1:1, dark first."""
    value, n = _runs(line)
    if len(n) < 5:
        return None
    a, b, c, d, e = (n[k : len(n) - 4 + k].astype(float) for k in range(5))
    unit = (a + b + d + e) / 4
    good = (value[: len(a)] == 0) & (unit >= 1) & (c >= 2.2 * unit) & (c <= 4.2 * unit)
    for x in (a, b, d, e):
        good &= np.abs(x - unit) <= 0.8 * unit
    if not good.any():
        return None
    mid = (len(n) - 1) // 2
    return float(n[:mid].sum() + n[mid] / 2)


def qr_regions(light: np.ndarray) -> list[tuple]:
    h, w = light.shape
    lines = [(True, light[y]) for y in range(0, h, 3)] + [(False, light[:, x]) for x in range(0, w, 3)]
    hits = [(row, at) for row, line in lines if (at := _finder(line)) is not None]
    out = []
    while hits:
        row, first = hits[0]
        group = [x for x in hits[1:] if abs(x[1] - first) < max(w, h) * 0.25]
        hits = [x for x in hits[1:] if not abs(x[1] - first) < max(w, h) * 0.25]
        if group:
            low, high = min(first, *(g[1] for g in group)), max(first, *(g[1] for g in group))
            out.append(("qr_code", low, 0, high - low + 1, h, 0.7) if row else ("qr_code", 0, low, w, high - low + 1, 0.7))
    return out


def _bands(good: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], good.astype(np.int8), [0])))
    return [(a, b) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]


def barcode_regions(light: np.ndarray) -> list[tuple]:
    h, w = light.shape
    bands = _bands((light[:, 1:] != light[:, :-1]).sum(1) >= BARS)
    a, b = max(bands, key=lambda x: x[1] - x[0], default=(0, 0))
    return [("barcode", 0, a, w, b - a, 0.7)] if b - a >= BAND else []


def signature_regions(light: np.ndarray) -> list[tuple]:
    dark = light == 0
    h, w = light.shape
    share, out = dark.sum(1) / max(1, w), []
    for a, b in _bands((share >= 0.01) & (share <= 0.5)):
        cols = np.flatnonzero(dark[a:b].any(0))
        if b - a >= BAND and len(cols) and cols[-1] - cols[0] > w * 0.2:
            out.append(("signature", cols[0], a, cols[-1] - cols[0] + 1, b - a, 0.6))
    return out[:3]


def face_regions(rgba: np.ndarray) -> list[tuple]:
    r, g, b = (rgba[..., k].astype(float) for k in range(3))
    cb, cr = 128 - 0.169 * r - 0.331 * g + 0.5 * b, 128 + 0.5 * r - 0.419 * g - 0.081 * b
    skin = (r >= 60) & (g >= 40) & (b >= 20) & (r > g) & (r > b) & (cb >= 77) & (cb <= 127) & (cr >= 133) & (cr <= 173)
    # labels of horizontal runs, joined where runs of neighbouring rows touch
    parent: list[int] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    runs, last = [], []
    for y, row in enumerate(skin):
        own = []
        for s, e in _bands(row):
            k = len(parent)
            parent.append(k)
            for s0, e0, k0 in last:
                if s0 < e and s < e0:
                    x, z = root(k), root(k0)
                    parent[max(x, z)] = min(x, z)
            own.append((s, e, k))
            runs.append((y, s, e, k))
        last = own
    blobs: dict[int, list] = {}
    for y, s, e, k in runs:
        o = blobs.setdefault(root(k), [0, s, y, e, y])
        blobs[root(k)] = [o[0] + e - s, min(o[1], s), min(o[2], y), max(o[3], e), max(o[4], y)]
    big = sorted((o for o in blobs.values() if o[0] >= FACE_AREA), key=lambda o: -o[0])[:3]
    return [("face", x, y, e - x, y2 - y + 1, 0.6) for _, x, y, e, y2 in big]


def detect(rgba: bytes, width: int, height: int) -> list[tuple]:
    image = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)
    light = (_grey(image) >= DARK).astype(np.int8)
    return qr_regions(light) + barcode_regions(light) + face_regions(image) + signature_regions(light)


def _blurred(part: np.ndarray) -> np.ndarray:
    """A Gaussian blur of BLUR pixels; beyond its edges the part goes on as at them."""
    reach = 3 * BLUR
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / BLUR) ** 2)
    out = part.astype(np.float32)
    for axis in (0, 1):
        n = out.shape[axis]
        wide = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in range(3)], mode="edge")
        out = sum(w * wide.take(np.arange(i, i + n), axis) for i, w in enumerate(weights / weights.sum()))
    return np.rint(out).clip(0, 255).astype(np.uint8)


def redact(rgba: bytes, width: int, height: int, regions: list) -> bytes:
    """Regions (x, y, width, height, mode) painted black, or blurred, with a margin of two
    pixels; regions without a place are passed over."""
    image = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).copy()
    for x, y, w, h, mode in regions:
        if None in (x, y, w, h):
            continue
        a, b = max(0, int(x) - PAD), max(0, int(y) - PAD)
        part = image[b : max(0, int(y + h) + PAD), a : max(0, int(x + w) + PAD)]
        if mode == "blur":
            if part.size:
                part[...] = _blurred(part)
        else:
            part[...] = (0, 0, 0, 255)
    return image.tobytes()


def image_regions(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(id, REGION) of rows (id, width, height, rgba); null or wrongly sized images have none."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, rows = [], []
            for i, (w, h, data) in enumerate(zip(*(b.column(c).to_pylist() for c in ("width", "height", "rgba")))):
                if data and w and h and len(data) == w * h * 4:
                    found = detect(data, w, h)
                    at += [i] * len(found)
                    rows += found
            cols = [pa.array([r[0] for r in rows], pa.string()), *(pa.array([float(r[k]) for r in rows], pa.float64()) for k in range(1, 6))]
            yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(at, pa.int64())), *cols], names=[id_col, *(x.split()[0] for x in REGION.split(", "))])

    kind = images.schema[id_col].dataType.simpleString()
    return images.select(F.col(id_col).alias("_id"), "width", "height", "rgba").mapInArrow(run, f"`{id_col}` {kind}, {REGION}")
