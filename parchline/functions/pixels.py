"""Measurements of grey page images in Arrow batches. Images are bytes, row by row, with their height and width."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

METRICS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("sharpness", "rms_contrast", "speckle_index", "ink_fraction", "line_score", "table_regions", "skew_deg")])
# fixed values: grey level below which a pixel is ink, least share of the smaller side of a long line, largest speck
INK_BELOW, LONG_LINE, SPECK = 160, 0.15, 5


def laplacian_variance(g: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian, edges mirrored."""
    p = np.pad(g.astype(float), 1, mode="reflect") if min(g.shape) > 1 else np.pad(g.astype(float), 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of the horizontal runs of a mask."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1]


def opened(mask: np.ndarray, length: int) -> np.ndarray:
    """The pixels of horizontal runs of at least ``length``: what an opening with a line of that length leaves."""
    row, start, stop = runs(mask)
    on = stop - start >= length
    step = np.zeros((mask.shape[0], mask.shape[1] + 1), dtype=np.int32)
    np.add.at(step, (row[on], start[on]), 1)
    np.add.at(step, (row[on], stop[on]), -1)
    return np.cumsum(step[:, :-1], axis=1) > 0


def labelled_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of the runs of a mask, and the number of the 8-connected component that each is in."""
    row, start, stop = runs(mask)
    parent = np.arange(len(row))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        a, b = first[y - 1], first[y]
        i, j = a, b
        while i < b and j < first[y + 1]:
            if start[i] <= stop[j] and start[j] <= stop[i]:
                x, z = find(i), find(j)
                if x != z:
                    parent[z] = x
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(k) for k in range(len(row))], dtype=int)
    return row, start, stop, np.unique(roots, return_inverse=True)[1] if len(row) else roots


def components(mask: np.ndarray) -> np.ndarray:
    """Sizes of the 8-connected components of a mask, by union of horizontal runs."""
    _, start, stop, label = labelled_runs(mask)
    return np.bincount(label, weights=stop - start) if len(label) else np.zeros(0)


def line_score(ink: np.ndarray) -> float:
    """Length of drawn straight lines in page widths: pixels in long horizontal and vertical runs, over an assumed thickness."""
    h, w = ink.shape
    least = max(1, int(LONG_LINE * min(h, w)))
    return float((opened(ink, least).sum() + opened(ink.T, least).sum()) / max(1.0, h / 400.0) / w)


def table_regions(ink: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of ruled grids: connected lines that fill a tenth of the width and a twentieth of the height with four or more
    pixels where they cross."""
    h, w = ink.shape
    across, down = opened(ink, max(10, w // 30)), opened(ink.T, max(10, h // 30)).T
    row, start, stop, label = labelled_runs(across | down)
    both = across & down
    out = []
    for k in range(int(label.max(initial=-1)) + 1):
        on = label == k
        x, y = int(start[on].min()), int(row[on].min())
        cw, ch = int(stop[on].max()) - x, int(row[on].max()) + 1 - y
        if cw >= w * 0.1 and ch >= h * 0.05 and both[y : y + ch, x : x + cw].sum() >= 4:
            out.append((x, y, cw, ch))
    return out


def skew(ink: np.ndarray) -> float | None:
    """Median angle of text rows and long lines, in degrees without sign, weighted by their length; null without any. Ink is smeared along the
    rows, and each component that is three times as long as high, along its main axis, has an angle."""
    if ink.sum() < 50:
        return None
    reach = max(15, ink.shape[1] // 50) // 2
    step = np.pad(ink.astype(np.int32), ((1, 1), (reach, reach)))
    run = np.cumsum(np.pad(step, ((0, 0), (1, 0))), axis=1)
    wide = (run[:, 2 * reach + 1 :] - run[:, : -2 * reach - 1]) > 0
    row, start, stop, label = labelled_runs(wide[:-2] | wide[1:-1] | wide[2:])
    n = (stop - start).astype(float)
    total = np.bincount(label, weights=n)
    mid = (start + stop - 1) / 2
    mean = lambda v: np.bincount(label, weights=v * n) / total
    mx, my = mean(mid), mean(row)
    xx, yy, xy = mean(mid**2 + (n**2 - 1) / 12) - mx**2, mean(row.astype(float) ** 2) + 1 / 12 - my**2, mean(mid * row) - mx * my
    gap = np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
    long, short = np.sqrt(12 * ((xx + yy) / 2 + gap)), np.sqrt(12 * np.maximum((xx + yy) / 2 - gap, 1 / 12))
    angle = np.degrees(0.5 * np.arctan2(2 * xy, xx - yy))
    angle = (angle + 45) % 90 - 45
    on = (total >= 200) & (long >= 3 * short)
    if not on.any():
        return None
    order = np.argsort(angle[on], kind="stable")
    weight = np.cumsum(long[on][order])
    return abs(float(angle[on][order][np.searchsorted(weight, weight[-1] / 2)]))


def measure(g: np.ndarray) -> tuple[float | None, ...]:
    ink = g < INK_BELOW
    sizes = components(ink)
    return laplacian_variance(g), float(g.std()), float((sizes <= SPECK).sum() / (g.size / 100_000)), float(ink.mean()), line_score(ink), float(len(table_regions(ink))), skew(ink)


def measure_images(df: DataFrame, key: str, content: str, height: str, width: str) -> DataFrame:
    """(key, metrics of ``METRICS``); all null where the bytes do not fill height times width."""
    n = len(METRICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data, h, w in zip(*[c.to_pylist() for c in b.columns[1:]], strict=True):
                ok = data and h and w and len(data) == h * w
                rows.append(measure(np.frombuffer(data, dtype=np.uint8).reshape(h, w)) if ok else (None,) * n)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], pa.float64()) for k in range(n)]], names=["k", *METRICS.names])

    schema = T.StructType([T.StructField("k", df.schema[key].dataType), *METRICS.fields])
    return df.select(key, content, height, width).mapInArrow(run, schema).withColumnRenamed("k", key)
