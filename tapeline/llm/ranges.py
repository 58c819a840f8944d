"""Deterministic shards of consecutive ids, balanced by weight."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of a shard, in bytes of content; small tables are cut into up to FEW shards of at least LEAST_BYTES.
SHARD_BYTES, LEAST_BYTES, FEW = 32 << 20, 2 << 20, 64
#: Shards at most; beyond, shards grow. Their writers roll files by size.
MOST_SHARDS = 100_000
#: Equal id ranges that one pass weighs, at least, and for each shard; only these sums reach the driver.
CELLS, CELLS_A_SHARD = 4096, 4
#: Passes at most; a cell that is still too heavy then becomes a shard as it is.
PASSES = 5


def bounds(df: DataFrame, id_col: str, weight: Column) -> list[int]:
    """Ascending first ids of shards 1.. (shard 0 starts at the lowest id); the same for the same rows.

    Weighs equal cells of the id range, then cuts the heaviest cells that alone exceed a shard into finer ones.
    """
    low, high = df.agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        return []
    n_cells, cells = CELLS, _weighed(df, id_col, weight, int(low), int(high), CELLS)
    total = sum(w for w, _ in cells.values())
    shards = min(MOST_SHARDS, max(-(-total // SHARD_BYTES), min(FEW, -(-total // LEAST_BYTES))))
    if shards < 2:
        return []
    if CELLS_A_SHARD * shards > CELLS:
        n_cells = CELLS_A_SHARD * shards
        cells = _weighed(df, id_col, weight, int(low), int(high), n_cells)
    share = total / shards
    for _ in range(PASSES):
        heavy = sorted(((w, first, last) for first, (w, last) in cells.items() if w > share and last > first), reverse=True)[:16]
        if not heavy:
            break
        for _, first, last in heavy:
            del cells[first]
            cells |= _weighed(df, id_col, weight, first, last, n_cells)
    cells = {first: w for first, (w, _) in cells.items()}
    out, filled = [], 0.0
    for first in sorted(cells):
        if filled and filled + cells[first] > share and first > low:
            out.append(first)
            filled = 0.0
        filled += cells[first]
    return out


def _weighed(df: DataFrame, id_col: str, weight: Column, low: int, high: int, n_cells: int) -> dict[int, tuple[float, int]]:
    """Weight and last id of the cells of an id range, by first id; cells without rows are left out."""
    width = (high - low) // n_cells + 1
    at = F.expr(f"cast((cast({id_col} as decimal(20,0)) - {low}) div {width} as long)")
    rows = df.where(F.col(id_col).between(low, high)).groupBy(at.alias("cell")).agg(F.sum(weight)).collect()
    return {low + cell * width: (w, min(high, low + (cell + 1) * width - 1)) for cell, w in rows}


def shard_of(starts: list[int]):
    """A column function from an id to its shard number."""
    edges = np.array(starts, np.int64)

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), "right").astype(np.int32))

    return shard


def deal(rows: DataFrame, starts: list[int]) -> DataFrame:
    """Rows with a shard number, each shard in a partition of its own."""
    return rows.repartitionById(len(starts) + 1, F.col("shard"))
