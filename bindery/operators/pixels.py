"""Page images as arrays: crop, split, contrast, smoothing, shrinking, panels. One row is one page.

Pages come from Spark's image source, or as rows height, width, data (one byte a pixel, gray)."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = "pkg_id string, page_no int, part int, height int, width int, data binary"
CLIP, GAMMA = 0.005, 0.8


def gray(image: DataFrame) -> DataFrame:
    """Rows of Spark's image source (image.height, width, nChannels, data; blue first) as gray pages on white."""
    return image.select("pkg_id", "page_no", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data").mapInPandas(_gray, "pkg_id string, page_no int, height int, width int, data binary")


def _gray(frames):
    for pdf in frames:
        out = []
        for h, w, c, data in zip(pdf["height"], pdf["width"], pdf["channels"], pdf["data"]):
            x = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float32)
            if c == 4:
                x = x[..., :3] * (x[..., 3:] / 255) + 255 - x[..., 3:]
            y = x[..., 0] if c == 1 else x[..., :3] @ np.array([0.114, 0.587, 0.299], np.float32)
            out.append(np.rint(y).astype(np.uint8).tobytes())
        yield pdf.assign(data=out)[["pkg_id", "page_no", "height", "width", "data"]]


def cropped(x: np.ndarray, step: float = 20.0, least: float = 0.02) -> np.ndarray:
    """Without borders: lines whose mean stays near the edge line's; narrow borders stay."""
    for axis in (0, 1):
        mean, n = x.mean(axis=1 - axis, dtype=np.float64), x.shape[axis]
        far = np.flatnonzero(np.abs(mean - mean[0]) > step)
        low = int(far[0]) if len(far) and far[0] >= least * n else 0
        far = np.flatnonzero(np.abs(mean - mean[-1]) > step)
        high = int(far[-1]) + 1 if len(far) and n - far[-1] - 1 >= least * n else n
        x = x[low:high] if axis == 0 else x[:, low:high]
    return x


def enhanced(x: np.ndarray, clip: float = CLIP, gamma: float = GAMMA) -> np.ndarray:
    """Stretched between the clip points, then brightened, by one table of 256 values."""
    count = np.bincount(x.ravel(), minlength=256)
    need = clip * x.size
    low, high = int(np.argmax(np.cumsum(count) >= need)), 255 - int(np.argmax(np.cumsum(count[::-1]) >= need))
    if high <= low:
        return x
    table = np.clip((np.arange(256) - low) / (high - low), 0, 1) ** gamma * 255
    return np.rint(table).astype(np.uint8)[x]


def smoothed(x: np.ndarray, amount: float = 0.5) -> np.ndarray:
    """A 3 x 3 blur against patterns of dots, then sharpened by what the blur took."""
    p = np.pad(x.astype(np.float32), 1, mode="edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    blur = (rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 16
    return np.clip(np.rint(blur + amount * (blur - _blur(blur))), 0, 255).astype(np.uint8)


def _blur(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, 1, mode="edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    return (rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 16


def shrunk(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """To fit a box, by means of areas; a page that fits stays."""
    scale = min(width / x.shape[1], height / x.shape[0])
    if scale >= 1:
        return x
    for axis in (0, 1):
        n = max(1, int(x.shape[axis] * scale))
        edge = np.linspace(0, x.shape[axis], n + 1)
        sums = np.concatenate((np.zeros_like(x.take([0], axis), np.float64), np.cumsum(x, axis=axis, dtype=np.float64)), axis)
        low = np.floor(edge).astype(int)
        at = sums.take(low, axis) + (edge - low).reshape((-1, 1) if axis == 0 else (1, -1)) * np.concatenate((x, np.zeros_like(x.take([0], axis))), axis).take(low, axis)
        x = np.diff(at, axis=axis) / (x.shape[axis] / n)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def halves(x: np.ndarray, right_first: bool = False) -> list[np.ndarray]:
    """A spread, which is wider than high, as two pages in reading order; another page as it is."""
    if x.shape[1] <= x.shape[0]:
        return [x]
    parts = [x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]]
    return parts[::-1] if right_first else parts


def panels(x: np.ndarray, limit: float = 100.0, least: float = 0.03) -> list[tuple[float, float, float, float]]:
    """(x, y, w, h) in percent: strips between even lines, then cells between even columns; one cell is none."""

    def between(flat: np.ndarray, n: int) -> list[tuple[int, int]]:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (~flat).astype(np.int8), [0]))))
        return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least * n]

    h, w = x.shape
    cells = [(a, c, b, d) for a, b in between(x.var(axis=1) < limit, h) for c, d in between(x[a:b].var(axis=0) < limit, w)]
    return [] if len(cells) < 2 else [(100 * c / w, 100 * a / h, 100 * (d - c) / w, 100 * (b - a) / h) for a, c, b, d in cells]


def _prepared(frames, width: int, height: int, right_first: bool):
    for pdf in frames:
        rows = []
        for pkg, no, h, w, data in zip(pdf["pkg_id"], pdf["page_no"], pdf["height"], pdf["width"], pdf["data"]):
            page = cropped(np.frombuffer(data, np.uint8).reshape(h, w))
            for k, part in enumerate(halves(page, right_first)):
                out = shrunk(enhanced(part), width, height)
                rows.append((pkg, no, k, *out.shape, out.tobytes()))
        yield pd.DataFrame(rows, columns=["pkg_id", "page_no", "part", "height", "width", "data"])


def prepared(pages: DataFrame, width: int, height: int, right_first: bool = False) -> DataFrame:
    """Gray pages for a device: cropped, split, stretched and shrunk."""
    return pages.mapInPandas(partial(_prepared, width=width, height=height, right_first=right_first), PAGE)


def _panels(frames):
    for pdf in frames:
        rows = [(pkg, no, k, *p) for pkg, no, h, w, data in zip(pdf["pkg_id"], pdf["page_no"], pdf["height"], pdf["width"], pdf["data"]) for k, p in enumerate(panels(np.frombuffer(data, np.uint8).reshape(h, w)))]
        yield pd.DataFrame(rows, columns=["pkg_id", "page_no", "panel_no", "x", "y", "w", "h"])


def panel_table(pages: DataFrame) -> DataFrame:
    return pages.mapInPandas(_panels, "pkg_id string, page_no int, panel_no int, x double, y double, w double, h double")
