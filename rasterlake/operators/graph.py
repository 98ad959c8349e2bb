"""Components of the small graphs inside frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rooted(ids: list[int], pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Each id's root, the smallest id of its component."""
    up = {i: i for i in ids}

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots of rooted() for ids from 0 to n, as an array, where links are many: a[i] < b[i] are linked."""
    up = np.arange(n)
    while len(a):
        # the larger root of each link goes below the least root that it is linked to, and all point to their roots again
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        first = np.concatenate((np.ones(1, bool), b[1:] != b[:-1]))
        up[b[first]] = a[first]
        while ((above := up[up]) != up).any():
            up = above
        a, b = up[a], up[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        open_ = a < b
        a, b = a[open_], b[open_]
    return up


def frame_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """frame, id, grp: the component of each node (frame, id) under links (frame, u, v); frames are independent.

    The links of a frame don't depend on the order in which they are followed, so a frame's nodes are joined in one
    task each, whatever the number of frames.
    """
    rows = nodes.select("frame", F.col("id").alias("u"), F.col("id").alias("v")).unionByName(links.select("frame", "u", "v"))

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        own = g[g["u"] == g["v"]]["u"].tolist()
        found = rooted(own, list(zip(g["u"], g["v"])))
        return pd.DataFrame({"frame": g["frame"].iloc[0], "id": list(found), "grp": list(found.values())})

    return rows.groupBy("frame").applyInPandas(settle, "frame long, id int, grp int")
