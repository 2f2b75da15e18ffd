"""Regions of a label grid: cells of one label that touch by a side, and small ones given to their neighbours.

Grids are sparse, a row a cell, one outline's at a time (bounded by its ground).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def sides(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of cells (n, 2) that share a side, each once."""
    low = cells.min(axis=0) if len(cells) else np.zeros(2, np.int64)
    width = int(cells[:, 0].max() - low[0]) + 2 if len(cells) else 1
    key = (cells[:, 1] - low[1]) * width + cells[:, 0] - low[0]
    order = np.argsort(key)
    found = []
    for step in (1, width):
        at = np.searchsorted(key[order], key + step)
        hit = np.flatnonzero((at < len(key)) & (key[order][np.minimum(at, len(key) - 1)] == key + step))
        found.append((hit, order[at[hit]]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def regions(cells: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of each cell the row of its region's first cell, by rows of the grid and then along them."""
    n = len(cells)
    order = np.lexsort((cells[:, 0], cells[:, 1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    a, b = sides(cells)
    same = labels[a] == labels[b]
    a, b, least = a[same], b[same], rank.copy()
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[order[new]]  # and what the least cell has found
        if (new == least).all():
            return order[least]
        least = new


def merge_small(cells: np.ndarray, labels: np.ndarray, least: float) -> np.ndarray:
    """Labels after every region of fewer than ``least`` cells, the smallest first, has taken the label that most of the cells
    around it have (of equally many the lowest). A region with nothing around it stays."""
    labels = labels.copy()
    a, b = sides(cells)
    ends, others = np.concatenate((a, b)), np.concatenate((b, a))
    while True:
        region = regions(cells, labels)
        names, size = np.unique(region, return_counts=True)
        for name in names[np.argsort(size, kind="stable")][: int((size < least).sum())]:
            own = region == name
            around = np.unique(others[own[ends] & ~own[others]])
            if len(around):
                votes, count = np.unique(labels[around], return_counts=True)
                labels[own] = votes[count.argmax()]
                break
        else:
            return labels


def label_regions(grid: DataFrame, key: str, least: float = 0) -> DataFrame:
    """(key, label, first_cx, first_cy, n) of the regions of each grid (key, cx, cy, label), small ones merged."""
    kind = grid.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cells, labels = group[["cx", "cy"]].to_numpy(np.int64), group["label"].to_numpy(np.int64)
        if least:
            labels = merge_small(cells, labels, least)
        first, n = np.unique(regions(cells, labels), return_counts=True)
        return pd.DataFrame({key: [group[key].iloc[0]] * len(first), "label": labels[first], "first_cx": cells[first, 0], "first_cy": cells[first, 1], "n": n})

    return grid.select(key, "cx", "cy", "label").groupBy(key).applyInPandas(run, f"{key} {kind}, label bigint, first_cx bigint, first_cy bigint, n bigint")
