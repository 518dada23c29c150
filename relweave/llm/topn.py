"""The N best items of every group by secondary sort.

The rows are hash-partitioned by group, sorted within each partition by group, score and identifier, and streamed as
Arrow batches; the stream emits the first N different items of a group and skips the rest. Its state is the group it
stands in and the at most N items emitted for it, so a group of any size passes through in constant memory.

A group that holds a large part of all rows would still be one task's work. The same sort and stream therefore runs
on each input partition first: a partition passes on at most N rows of a group, and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_n(n: int):
    """Streams sorted batches of (group, item, ...) and passes the first n different items of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, emitted = None, np.empty(0, "i8")
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy(zero_copy_only=False)
            item = batch.column(1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            head = int(starts[1]) if len(starts) > 1 else len(g)
            carried = group is not None and g[0] == group
            keep = np.ones(len(g), bool)
            if carried:
                # most rows of a large group end here, without any further work
                if len(emitted) >= n:
                    keep[:head] = False
                else:
                    keep[:head] = ~np.isin(item[:head], emitted)
            at = np.flatnonzero(keep)
            # a row counts only if its item is new in the group: within a group the first of equal items is the best
            order = np.lexsort((at, item[at], g[at]))
            same = np.r_[False, (g[at][order][1:] == g[at][order][:-1]) & (item[at][order][1:] == item[at][order][:-1])] if len(at) else np.empty(0, bool)
            at = np.sort(at[order[~same]])
            if len(at):
                first = np.r_[True, g[at][1:] != g[at][:-1]]
                begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                rank = np.arange(len(at)) - begin
                if carried:
                    rank[g[at] == group] += len(emitted)
                at = at[rank < n]
            last = g[-1]
            new = item[at[g[at] == last]] if len(at) else item[:0]
            emitted = np.r_[emitted, new] if carried and last == group else new
            group = last
            if len(at):
                yield batch.take(pa.array(at))

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The n different items of highest score of every group, as (group, item, score); ties: smaller item first.

    A repeated (group, item) counts once, with its highest score. Rows with a null group, item or score, or a NaN score,
    never count. Groups with fewer than n items keep all; an empty table gives an empty result. ``group`` and ``item``
    must be integers; other columns are dropped.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    cells = df.select(F.col(group).cast("bigint").alias("g"), F.col(item).cast("bigint").alias("i"), F.col(score).cast("double").alias("s"))
    cells = cells.filter("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    order = [F.col("g"), F.col("s").desc(), F.col("i")]
    run = _first_n(n)
    local = cells.sortWithinPartitions(*order).mapInArrow(run, cells.schema)
    merged = local.repartition("g").sortWithinPartitions(*order).mapInArrow(run, cells.schema)
    return merged.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score))
