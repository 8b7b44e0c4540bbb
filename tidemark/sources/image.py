"""A picture of a set of series: one line each, as PNG bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.plans.frame import Series, consolidated

#: Colours by name, and in the order in which lines take them.
COLORS = {"blue": (31, 119, 180), "red": (214, 39, 40), "green": (44, 160, 44), "orange": (255, 127, 14), "purple": (148, 103, 189), "brown": (140, 86, 75), "black": (0, 0, 0), "gray": (127, 127, 127)}


def png(pixels: np.ndarray) -> bytes:
    """Height x width x 3 bytes as a PNG file."""
    h, w, _ = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * 3)], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _stroke(pixels: np.ndarray, x: np.ndarray, y: np.ndarray, color: tuple[int, int, int], width: int) -> None:
    """A line through the points, each segment in steps of at most one pixel."""
    for k in range(max(1, len(x) - 1)):
        j = min(k + 1, len(x) - 1)
        n = int(max(abs(x[j] - x[k]), abs(y[j] - y[k]))) + 1
        px = np.rint(np.linspace(x[k], x[j], n + 1)).astype(int)
        py = np.rint(np.linspace(y[k], y[j], n + 1)).astype(int)
        for d in range(width):
            pixels[np.clip(py + d - width // 2, 0, pixels.shape[0] - 1), np.clip(px, 0, pixels.shape[1] - 1)] = color


def png_document(s: Series, width: int = 800, height: int = 600) -> bytes:
    """Lines between the points of each series, on the range of all times and values.

    A series has at most one point a pixel column, so the driver gets ``width`` rows a series
    at most.  The options color, lineWidth and drawAsInfinite act; gaps of more than a step
    are not bridged.
    """
    thin = consolidated(s, width)
    option = lambda k: F.element_at("options", F.lit(k))
    dim = thin.dim.select("sid", "name", "ordinal", "step", option("color").alias("color"), option("lineWidth").alias("line"), option("drawAsInfinite").alias("infinite"))
    rows = thin.pts.where("value IS NOT NULL AND NOT isnan(value)").join(dim, "sid").orderBy("ordinal", "name", "sid", "ts").collect()
    pixels = np.full((height, width, 3), 255, np.uint8)
    if not rows:
        return png(pixels)
    ts, v = np.array([r["ts"] for r in rows], float), np.array([r["value"] for r in rows], float)
    fit = lambda a, size: (a - a.min()) / max(a.max() - a.min(), 1e-300) * (size - 1) if a.max() > a.min() else np.full(len(a), (size - 1) / 2)
    x, y = fit(ts, width), height - 1 - fit(v, height)
    names = list(COLORS)
    sids = [r["sid"] for r in rows]
    new = [i for i in range(len(rows)) if i == 0 or sids[i] != sids[i - 1]]
    for k, (a, b) in enumerate(zip(new, [*new[1:], len(rows)], strict=True)):
        r = rows[a]
        color = COLORS.get(r["color"] or names[k % len(names)], (0, 0, 0))
        line = max(1, int(float(r["line"] or 1)))
        if r["infinite"]:
            for c in np.rint(x[a:b]).astype(int):
                pixels[:, c] = color
            continue
        # a run of neighbouring steps is one stroke
        cut = [a, *(i for i in range(a + 1, b) if ts[i] - ts[i - 1] > r["step"]), b]
        for lo, hi in zip(cut, cut[1:], strict=False):
            _stroke(pixels, x[lo:hi], y[lo:hi], color, line)
    return png(pixels)
