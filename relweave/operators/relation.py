"""Sparse relations as tables of cells (row_idx, col_idx, score): slices, filters, products, unions, ranks.

A cell that is absent is no row. Every function selects the three columns first, so that other columns of its input,
whatever their names, are dropped. Cells with a null index or score, or a NaN score, are no cells; ``relation`` removes
them and merges repeated cells, and the other functions expect its result. All functions give an empty result on
empty input and are lazy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

R, C, S = "row_idx", "col_idx", "score"


def relation(df: DataFrame, row: str = R, col: str = C, score: str = S, merge: str = "max") -> DataFrame:
    """The cells of ``df``; a repeated cell keeps its highest score (``max``) or the sum of its scores (``sum``)."""
    cells = df.select(F.col(row).cast("bigint").alias(R), F.col(col).cast("bigint").alias(C), F.col(score).cast("double").alias(S))
    cells = cells.filter(F.col(R).isNotNull() & F.col(C).isNotNull() & F.col(S).isNotNull() & ~F.isnan(S))
    return cells.groupBy(R, C).agg({"max": F.max, "sum": F.sum}[merge](S).alias(S))


def _cells(r: DataFrame) -> DataFrame:
    return r.select(R, C, S)


# --- slices and filters


def slice_rows(r: DataFrame, index: DataFrame) -> DataFrame:
    """The rows that ``index`` (old_idx, new_idx) lists, renumbered; a row listed twice appears twice."""
    return _cells(r).join(index.select("old_idx", "new_idx"), F.col(R) == F.col("old_idx")).select(F.col("new_idx").alias(R), C, S)


def slice_cols(r: DataFrame, index: DataFrame) -> DataFrame:
    """The columns that ``index`` (old_idx, new_idx) lists, renumbered."""
    return transpose(slice_rows(transpose(r), index))


def cols_from(r: DataFrame, first: int) -> DataFrame:
    """The columns from ``first`` on, renumbered from 0."""
    return _cells(r).filter(F.col(C) >= first).withColumn(C, F.col(C) - first)


def non_empty(r: DataFrame, axis: str = R) -> DataFrame:
    return r.select(axis).distinct()


def threshold(r: DataFrame, least: float) -> DataFrame:
    """Cells of at least ``least``."""
    return _cells(r).filter(F.col(S) >= least)


def drop_zeros(r: DataFrame) -> DataFrame:
    return _cells(r).filter(F.col(S) != 0)


def drop_diagonal(r: DataFrame) -> DataFrame:
    return _cells(r).filter(F.col(R) != F.col(C))


def prune_heads(r: DataFrame, most_in_row: int, most_in_col: int) -> DataFrame:
    """Without the rows and columns of more cells than that; both counts are of the relation as it comes."""
    heavy_rows = r.groupBy(R).count().filter(F.col("count") > most_in_row).select(R)
    heavy_cols = r.groupBy(C).count().filter(F.col("count") > most_in_col).select(C)
    return _cells(r).join(heavy_rows, R, "left_anti").join(heavy_cols, C, "left_anti").select(R, C, S)


def binarise(r: DataFrame) -> DataFrame:
    return r.select(R, C, F.lit(1.0).alias(S))


def scale(r: DataFrame, by: float) -> DataFrame:
    return r.select(R, C, (F.col(S) * F.lit(float(by))).alias(S))


# --- products and rearrangements


def transpose(r: DataFrame) -> DataFrame:
    return r.select(F.col(C).alias(R), F.col(R).alias(C), S)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product. Its cost is the sum over the inner index of the cells on either side: prune heavy inner
    indexes or keep the top of each row first."""
    x = a.select(R, F.col(C).alias("inner"), F.col(S).alias("x"))
    y = b.select(F.col(R).alias("inner"), C, F.col(S).alias("y"))
    return x.join(y, "inner").groupBy(R, C).agg(F.sum(F.col("x") * F.col("y")).alias(S))


#: Cells of either factor that meet in one task, and products that it sorts at a time; a column in so many at most is sorted.
LEFT_CELLS, RIGHT_CELLS, SUMS, FEW = 500_000, 2_000_000, 2_000_000, 20


def _best_of_block(k: int, digits: int):
    """Cells (row_idx, inner, x) and (inner, col_idx, y) to the k best of each row of their product.

    A row adds its products up in one array over the columns. What the k best columns of each of its inner indexes sum up
    to bounds its k best from below, so that one comparison leaves few sums to round and sort. A row of few products sorts them
    instead.
    """

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({R: pa.array([], pa.int64()), C: pa.array([], pa.int64()), S: pa.array([], pa.float64())})
        inner, y = right.column("inner").to_numpy(), right.column("y").to_numpy()
        cols, col = np.unique(right.column(C).to_numpy(), return_inverse=True)
        order = np.lexsort((-y, inner))
        best_col = col[order]
        order = np.lexsort((col, inner))
        inner, y, col = inner[order], y[order], col[order]
        order = np.argsort(left.column(R).to_numpy(), kind="stable")
        row, wanted, x = (left.column(c).to_numpy()[order] for c in (R, "inner", "x"))
        low, high = np.searchsorted(inner, wanted, "left"), np.searchsorted(inner, wanted, "right")
        some = high > low
        row, x, low, high = row[some], x[some], low[some], high[some]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, "i8")
        total = np.add.reduceat(high - low, starts) if len(row) else starts
        ends, few = np.r_[starts[1:], len(row)], min(SUMS, len(cols) // FEW)
        xs, lows, highs = x.tolist(), low.tolist(), high.tolist()
        # what a quarter of the columns have is added as a whole
        dense = {}
        for at in np.flatnonzero(high - low > len(cols) // 4).tolist():
            if lows[at] not in dense:
                dense[lows[at]] = np.zeros(len(cols))
                dense[lows[at]][col[lows[at] : highs[at]]] = y[lows[at] : highs[at]]
        sums, part = np.zeros(len(cols)), np.empty(len(cols))
        out_n, out_c, out_s = [], [], []
        for first, end, n in zip(starts.tolist(), ends.tolist(), total.tolist()):
            if n <= few:
                c, place = np.unique(np.concatenate([col[lows[i] : highs[i]] for i in range(first, end)]), return_inverse=True)
                s = np.bincount(place, np.concatenate([xs[i] * y[lows[i] : highs[i]] for i in range(first, end)]))
            else:
                sums.fill(0)
                for i in range(first, end):
                    if lows[i] in dense:
                        sums += np.multiply(dense[lows[i]], xs[i], out=part)
                    else:
                        sums[col[lows[i] : highs[i]]] += xs[i] * y[lows[i] : highs[i]]
                some = np.unique(np.concatenate([best_col[lows[i] : min(highs[i], lows[i] + k)] for i in range(first, end)]))
                # a sum below this by more than rounding moves is not among the best
                least = np.partition(sums[some], len(some) - k)[len(some) - k] - 10.0**-digits if len(some) >= k else 0.0
                if least > 0:
                    c = np.flatnonzero(sums >= least)
                else:
                    met = np.zeros(len(cols), bool)
                    for i in range(first, end):
                        met[col[lows[i] : highs[i]]] = True
                    c = np.flatnonzero(met)
                s = sums[c]
            s = np.round(s, digits)
            best = np.lexsort((c, -s))[:k]
            out_n.append(len(best))
            out_c.append(c[best])
            out_s.append(s[best])
        a = np.repeat(row[starts], out_n)
        b, s = (np.concatenate(v) if v else np.empty(0, kind) for v, kind in ((out_c, "i8"), (out_s, "f8")))
        return pa.table({R: a, C: cols[b], S: s})

    return run


def multiply_top_k(a: DataFrame, b: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The k best cells of each row of the matrix product, its scores rounded to ``digits`` places; ties: smaller column first.

    The product itself, in which a frequent inner index pairs a large part of all rows with a large part of all columns, is
    never written or shuffled. The rows of ``a`` and the columns of ``b`` are dealt into blocks of bounded size; each
    pair of blocks adds up its products in one task and passes on k cells a row. A row or a column of more cells than a
    block is multiplied by a join and an aggregate instead. The number of products is that of ``multiply``.
    """
    from relweave.session import cut

    x = cut(a.select(R, F.col(C).alias("inner"), F.col(S).alias("x")))
    y = cut(b.select(F.col(R).alias("inner"), C, F.col(S).alias("y")))
    heavy_rows = cut(x.groupBy(R).count().filter(F.col("count") > LEFT_CELLS).select(R))
    heavy_cols = cut(y.groupBy(C).count().filter(F.col("count") > RIGHT_CELLS).select(C))
    parts = []
    light_x, light_y = x, y
    if not heavy_rows.isEmpty():
        light_x = x.join(heavy_rows, R, "left_anti")
        parts.append(x.join(heavy_rows, R, "left_semi").join(y, "inner"))
    if not heavy_cols.isEmpty():
        light_y = y.join(heavy_cols, C, "left_anti")
        parts.append(light_x.join(y.join(heavy_cols, C, "left_semi"), "inner"))
    n, m = x.count(), y.count()
    cores = x.sparkSession.sparkContext.defaultParallelism
    lefts, rights = max(1, -(-n // LEFT_CELLS), min(cores, n // 1000)), max(1, -(-m // RIGHT_CELLS))
    left = light_x.withColumn("p", F.pmod(F.xxhash64(R), F.lit(lefts)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(rights - 1))))
    right = light_y.withColumn("q", F.pmod(F.xxhash64(C), F.lit(rights)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(lefts - 1))))
    tasks = min(20_000, lefts * rights)
    on = ["p", "q"]
    grid = left.repartition(tasks, *on).groupBy(*on).cogroup(right.repartition(tasks, *on).groupBy(*on))
    out = grid.applyInArrow(_best_of_block(k, digits), f"{R} bigint, {C} bigint, {S} double")
    for part in parts:
        out = out.unionByName(part.groupBy(R, C).agg(F.round(F.sum(F.col("x") * F.col("y")), digits).alias(S)))
    return top_k(out, k)


def cooccurrence(r: DataFrame) -> DataFrame:
    """Of the columns of ``r``, over its rows."""
    return multiply(transpose(r), r)


def mean_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product divided by the product of the binarised relations: the mean over the matching inner indexes.

    Both have the same cells, so one pass computes either.
    """
    x = a.select(R, F.col(C).alias("inner"), F.col(S).alias("x"))
    y = b.select(F.col(R).alias("inner"), C, F.col(S).alias("y"))
    return x.join(y, "inner").groupBy(R, C).agg((F.sum(F.col("x") * F.col("y")) / F.count("*")).alias(S))


def symmetrise_sum(r: DataFrame) -> DataFrame:
    """``r`` plus its transpose; the diagonal doubles."""
    return add(r, transpose(r))


def symmetrise_missing(r: DataFrame) -> DataFrame:
    """``r`` with the transposed cells that it lacks."""
    return _cells(r).unionByName(transpose(r).join(r.select(R, C), [R, C], "left_anti").select(R, C, S))


def column_scale_by_count(r: DataFrame) -> DataFrame:
    """Each cell divided by the number of cells in its column."""
    counts = r.groupBy(C).agg(F.count("*").alias("n"))
    return _cells(r).join(counts, C).select(R, C, (F.col(S) / F.col("n")).alias(S))


def row_normalise(r: DataFrame) -> DataFrame:
    """Each cell divided by the sum of its row; a row that sums to 0 has no cells in the result."""
    total = F.sum(S).over(Window.partitionBy(R))
    return _cells(r).withColumn("total", total).filter("total <> 0").select(R, C, (F.col(S) / F.col("total")).alias(S))


def row_minmax(r: DataFrame, drop_zero: bool = True) -> DataFrame:
    """Each row stretched to 0..1; a row of equal scores becomes 1. ``drop_zero`` then drops the lowest cells."""
    w = Window.partitionBy(R)
    low, high = F.min(S).over(w), F.max(S).over(w)
    out = _cells(r).withColumn("low", low).withColumn("high", high)
    out = out.select(R, C, F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise((F.col(S) - F.col("low")) / (F.col("high") - F.col("low"))).alias(S))
    return drop_zeros(out) if drop_zero else out


def from_lists(df: DataFrame, row: str, items: str) -> DataFrame:
    """Cells of rows with arrays of column indexes; an index that repeats adds up. Null and empty arrays give no cells."""
    return df.select(F.col(row).cast("bigint").alias(R), F.explode(F.col(items).cast("array<bigint>")).alias(C)).dropna().groupBy(R, C).agg(F.count("*").cast("double").alias(S))


def mean_by_column(r: DataFrame) -> DataFrame:
    """(col_idx, score): the mean over the cells of each column."""
    return r.groupBy(C).agg(F.avg(S).alias(S))


# --- unions and differences


def add(*rs: DataFrame) -> DataFrame:
    """The sum of relations, cell by cell."""
    return concat(*rs).groupBy(R, C).agg(F.sum(S).alias(S))


def concat(*rs: DataFrame) -> DataFrame:
    out = _cells(rs[0])
    for r in rs[1:]:
        out = out.unionByName(_cells(r))
    return out


def union_distinct(*rs: DataFrame) -> DataFrame:
    """The cells of any of the relations, with score 1."""
    return binarise(concat(*rs)).distinct()


def subtract_cells(r: DataFrame, known: DataFrame) -> DataFrame:
    """Without the cells that ``known`` has, whatever their scores."""
    return _cells(r).join(known.select(R, C), [R, C], "left_anti").select(R, C, S)


def intersect_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(R, C).intersect(b.select(R, C))


def shift(r: DataFrame, rows: Column | int = 0, cols: Column | int = 0) -> DataFrame:
    return r.select((F.col(R) + rows).cast("bigint").alias(R), (F.col(C) + cols).cast("bigint").alias(C), S)


def block(blocks: list[list[DataFrame | None]], heights: list[int], widths: list[int]) -> DataFrame:
    """The block matrix of relations of those heights and widths; None is an empty block."""
    parts, top = [], 0
    for line, h in zip(blocks, heights, strict=True):
        left = 0
        for r, w in zip(line, widths, strict=True):
            if r is not None:
                parts.append(shift(r, top, left))
            left += w
        top += h
    return concat(*parts)


def union_with_offsets(cells: DataFrame, sizes: DataFrame, part: str) -> DataFrame:
    """Relations stacked by ``part`` in its order: rows and columns move by the sizes of the parts before.

    ``cells`` has ``part`` beside its three columns; ``sizes`` (part, n_rows, n_cols) has a row per part.
    """
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over the few rows of sizes
    offsets = sizes.select(part, F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("n_cols").over(before), F.lit(0)).alias("cols_before"))
    return shift(cells.join(offsets, part), F.col("rows_before"), F.col("cols_before"))


# --- ranks


def by_score(*partition: str) -> Window:
    """Best first; equal scores by column."""
    return Window.partitionBy(*(partition or (R,))).orderBy(F.desc(S), C)


def top_k(r: DataFrame, k: int) -> DataFrame:
    """The k best cells of each row; equal scores: smaller column first; rows of fewer cells keep all."""
    return _cells(r).withColumn("rank", F.row_number().over(by_score())).filter(F.col("rank") <= k).select(R, C, S)


def top_k_normalised(r: DataFrame, k: int) -> DataFrame:
    """The k best cells of each row after it was stretched to 0..1."""
    return top_k(row_minmax(r), k)


def ranked(r: DataFrame) -> DataFrame:
    """With ``rank``, from 1 within each row."""
    return _cells(r).withColumn("rank", F.row_number().over(by_score()))


def rank_band(r: DataFrame, after: int, width: int, keep: int | None = None) -> DataFrame:
    """The cells ranked ``after`` + 1 to ``after`` + ``width`` of each row, the first ``keep`` of them."""
    last = after + min(width, keep if keep is not None else width)
    return ranked(r).filter((F.col("rank") > after) & (F.col("rank") <= last)).select(R, C, S)


def row_lists(r: DataFrame) -> DataFrame:
    """(row_idx, cells): the cells of each row as an array of structs, best first."""
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col(S)).alias("minus"), F.col(C).alias(C)))), lambda x: F.struct(x[C].alias(C), (-x["minus"]).alias(S)))
    return r.groupBy(R).agg(order.alias("cells"))


# --- counts


def counts(r: DataFrame, axis: str = R) -> DataFrame:
    return r.groupBy(axis).agg(F.count("*").alias("n"))


def sums(r: DataFrame, axis: str = R) -> DataFrame:
    return r.groupBy(axis).agg(F.sum(S).alias("total"))


def mean_count(r: DataFrame, size: int) -> DataFrame:
    """(mean_cells): cells per row of ``size`` rows, empty ones included."""
    return r.agg((F.count("*") / F.lit(float(size))).alias("mean_cells"))
