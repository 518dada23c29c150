"""The most similar vectors for every vector: a navigable small-world graph per shard, shard results merged.

Equal vectors form one class, so that copies neither crowd out a graph nor cost anything. Classes are dealt to cells
around centroids, which are fitted on a bounded sample; a cell above ``SHARD`` classes is split by hash into several
shards. Every shard gets a graph in flat neighbour arrays, in the task that searches it. A class searches the cell of
its nearest centroid, starting from itself, and every other cell whose centroid is nearly as near. How nearly is not
given but validated: the nearest vectors of a sample of classes are found by comparing them with all classes, and the
gap is the one that ``recall`` of them need. So the number of cells that are searched follows the data, at any size.

Above ``FAN`` cells the centroids form a tree of two levels: the first deals classes to at most ``FAN`` parts, and each
part has centroids of its own, a row of a table. With ``CELL`` classes a cell this reaches to 10^11 classes; beyond,
cells grow and are split into more shards. The driver holds ``FAN`` centroids, the sample and its nearest vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.llm import hnsw
from relweave.operators.retrieval import exact_search
from relweave.session import cut, spread

#: Classes in a cell on average and in a shard at most (on average over the shards of a cell).
CELL, SHARD = 6_000, 12_000
#: Centroids of one level of the tree.
FAN = 4096
#: Classes that the centroids of the first level are fitted on, and those of a part per centroid, about.
SAMPLE, SAMPLE_PER_CENTROID = 40_000, 16
#: The share of the nearest vectors that lie in searched cells, and the number of classes that validate it, about.
RECALL, VALIDATED = 0.975, 800
#: How many candidates the walk through a graph keeps, from a class's own node and from the top.
OWN_WIDTH, WIDTH = 12, 12
#: Queries that a task searches a shard for, on average at most.
BLOCK = 48_000
MAX_TASKS = 20_000
_BUCKETS = 1 << 30


def usable(vector: Column, dim: int) -> Column:
    """Exactly ``dim`` values, all finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype("f8")
    raw /= np.abs(raw).max(axis=1, keepdims=True)  # squares of very small or large values stay finite
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], column.type)
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype("f4").reshape(n, -1) if n else np.empty((0, 0), "f4")


def _units(column) -> np.ndarray:
    m = _matrix(column)
    return unit(m).astype("f4") if len(m) else m


def vector_classes(df: DataFrame, vec_id: str, vector: str, dim: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct usable vectors: (class_id, vector), the class named by its smallest id; the classes of several ids,
    (class_id, n_ids, ids) with how many and the k + 1 smallest; and the ids in these, (vec_id, class_id).

    A row delivered twice counts once; of different vectors under one id the first by their hashes counts.
    """
    rows = df.filter(F.col(vec_id).isNotNull() & usable(F.col(vector), dim)).select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    # two hashes of 64 bits stand for the vector until the last join
    rows = rows.withColumns({"h": F.xxhash64("vector"), "g": F.xxhash64(F.lit(1), F.col("vector"))})
    first = F.row_number().over(Window.partitionBy("id").orderBy("h", "g"))
    keyed = cut(rows.select("id", "h", "g").withColumn("at", first).filter("at = 1").drop("at"))
    named = keyed.groupBy("h", "g").agg(F.min("id").alias("class_id"), F.count("*").alias("n_ids"))
    vectors = rows.join(named.select(F.col("class_id").alias("id"), "h", "g"), ["id", "h", "g"]).select(F.col("id").alias("class_id"), "vector").distinct()
    several = cut(named.filter("n_ids > 1"))
    members = keyed.join(several, ["h", "g"]).select(F.col("id").alias("vec_id"), "class_id", "n_ids")
    # copies may make up a large part of all rows: their smallest ids are kept per salt before they meet
    few = members.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("class_id", "salt").orderBy("vec_id"))).filter(F.col("rank") <= k + 1)
    ids = few.groupBy("class_id").agg(F.first("n_ids").alias("n_ids"), F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))  # at most 64 (k + 1) ids each
    return cut(vectors), cut(ids), members.select("vec_id", "class_id")


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids by spherical k-means, started from vectors of the sample."""
    rng = np.random.default_rng(7)
    cells = min(cells, len(sample))
    centroids = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds if cells > 1 else 0):
        home = np.concatenate([(sample[at : at + 4096] @ centroids.T).argmax(axis=1) for at in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
    return centroids.astype("f4")


def gaps(queries: np.ndarray, neighbours: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """How much nearer each query's nearest centroid is to it than the nearest centroid of its neighbour."""
    s = queries @ centroids.T
    return s.max(axis=1) - s[np.arange(len(s)), (neighbours @ centroids.T).argmax(axis=1)]


def _placed(vectors: np.ndarray, centroids: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells in reach of each vector: rows, cells and whether a cell is the vector's home."""
    out = []
    for at in range(0, len(vectors), 2048):
        s = vectors[at : at + 2048] @ centroids.T
        home = s.argmax(axis=1)
        near = s >= (s[np.arange(len(s)), home] - gap)[:, None]
        row, cell = np.nonzero(near)
        out.append((row + at, cell, cell == home[row]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, bool))


_PLACED = "class_id bigint, vector array<float>, cell bigint, home boolean"


def _rows_placed(class_id, vector, row: np.ndarray, cell: np.ndarray, home: np.ndarray) -> list:
    at = pa.array(row)
    return [class_id.take(at), vector.take(at), pa.array(cell.astype("i8")), pa.array(home)]


def _first_level(shipped, gap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _placed(_units(batch.column(1)), shipped.value, gap)
                yield pa.RecordBatch.from_arrays(_rows_placed(batch.column(0), batch.column(1), *found), ["class_id", "vector", "cell", "home"])

    return run


def _first_counts(shipped, gap: float):
    """As ``_first_level``, but only (cell, n, q): the classes at home in each cell and those that search it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shipped.value)
        n, q = np.zeros(size, "i8"), np.zeros(size, "i8")
        for batch in batches:
            _, cell, home = _placed(_units(batch.column(1)), shipped.value, gap)
            n += np.bincount(cell[home], minlength=size)
            q += np.bincount(cell, minlength=size)
        at = np.flatnonzero(q)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(q[at])], ["cell", "n", "q"])

    return run


def _part_centroids(cell: int, fan: int):
    """The sample of a part, with its whole size, to its centroids."""

    def run(key, rows):
        size = rows.column("n")[0].as_py()
        c = fit_centroids(_units(rows.column("vector")), max(1, min(fan, round(size / cell))))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "centroids": pa.array([c.tobytes()], pa.binary())})

    return run


def _second_level(gap: float, fan: int, dim: int):
    def run(key, rows, centroids):
        if not rows.num_rows or not centroids.num_rows:
            return pa.table({"class_id": pa.array([], pa.int64()), "vector": pa.array([], pa.list_(pa.float32())), "cell": pa.array([], pa.int64()), "home": pa.array([], pa.bool_())})
        c = np.frombuffer(centroids.column("centroids")[0].as_py(), "f4").reshape(-1, dim)
        row, cell, home = _placed(_units(rows.column("vector")), c, gap)
        home &= rows.column("home").to_numpy()[row]
        return pa.table(_rows_placed(rows.column("class_id"), rows.column("vector"), row, cell + key[0].as_py() * fan, home), ["class_id", "vector", "cell", "home"])

    return run


def _part_gaps(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, v = _matrix(batch.column("q")), _matrix(batch.column("v"))
            found = [float(gaps(q[k : k + 1], v[k : k + 1], np.frombuffer(c.as_py(), "f4").reshape(-1, dim))[0]) for k, c in enumerate(batch.column("centroids"))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], ["gap"])

    return run


def _nearest_of(shipped, k: int):
    """The k nearest of a partition for each shipped query: (query, neighbour, cosine, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = shipped.value
        n = len(own)
        ids, sims, vectors = np.full((n, k), -1, "i8"), np.full((n, k), -3.0, "f4"), np.zeros((n, k, queries.shape[1]), "f4")
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                key, v = part.column(0).to_numpy(), _units(part.column(1))
                s = queries @ v.T
                s[key[None, :] == own[:, None]] = -3
                top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                all_s = np.concatenate([sims, np.take_along_axis(s, top, 1)], axis=1)
                best = np.argsort(-all_s, axis=1)[:, :k]
                sims = np.take_along_axis(all_s, best, 1)
                ids = np.take_along_axis(np.concatenate([ids, key[top]], axis=1), best, 1)
                vectors = np.take_along_axis(np.concatenate([vectors, v[top]], axis=1), best[:, :, None], 1)
        row, col = np.nonzero(sims > -2)
        flat = vectors[row, col]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, max(1, flat.shape[1]), dtype="i4")), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(row.astype("i4")), pa.array(ids[row, col]), pa.array(sims[row, col].astype("f8")), lists], ["query", "neighbour", "cosine", "vector"])

    return run


@dataclass(frozen=True)
class Settings:
    dim: int = 64
    k: int = 5
    recall: float = RECALL
    width: int = WIDTH
    cell: int = CELL
    shard: int = SHARD
    block: int = BLOCK
    fan: int = FAN
    sample: int = SAMPLE
    validated: int = VALIDATED


def _drawn(rows: DataFrame, share: float | Column, salt: int) -> DataFrame:
    """The rows whose hash falls into the first ``share`` of its range."""
    return rows.filter(F.pmod(F.xxhash64("class_id", F.lit(salt)), F.lit(_BUCKETS)) < (F.lit(share) if isinstance(share, float) else share) * _BUCKETS)


def _validation(rows: DataFrame, n: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """About ``validated`` classes and their k nearest, compared with all: two aligned matrices of unit vectors."""
    drawn = _drawn(rows, min(1.0, s.validated / n), 3).toArrow()
    own, q = drawn.column("class_id").to_numpy(), _units(drawn.column("vector"))
    if not len(own):
        return np.empty((0, s.dim), "f4"), np.empty((0, s.dim), "f4")
    shipped = rows.sparkSession.sparkContext.broadcast((own, q))  # about ``validated`` vectors
    near = spread(rows).mapInArrow(_nearest_of(shipped, s.k), "query int, neighbour bigint, cosine double, vector array<float>")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))
    best = near.withColumn("rank", rank).filter(F.col("rank") <= s.k).select("query", "vector").toArrow()  # k rows a query
    return q[best.column("query").to_numpy()], _matrix(best.column("vector")).reshape(-1, s.dim)


def _gap(found: np.ndarray, recall: float) -> float:
    return float(np.quantile(found, recall)) + 1e-6 if len(found) else 2.0


def _cells(rows: DataFrame, n: int, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Every class in every cell that it searches (class_id, vector, cell, home), and the plan (cell, n, q)."""
    spark = rows.sparkSession
    cells = max(1, round(n / s.cell))
    sample = _units(_drawn(rows, min(1.0, s.sample / n), 2).select("vector").toArrow().column("vector")) if cells > 1 else np.empty((0, s.dim), "f4")
    centroids = fit_centroids(sample, min(s.fan, cells)) if len(sample) else np.zeros((1, s.dim), "f4")
    shipped = spark.sparkContext.broadcast(centroids)  # at most FAN vectors
    q, v = _validation(rows, n, s) if len(centroids) > 1 else (sample[:0], sample[:0])
    two = cells > s.fan
    # of two levels each may lose half of what may be lost
    gap = _gap(gaps(q, v, centroids), (1 + s.recall) / 2 if two else s.recall)
    counts = spread(rows).mapInArrow(_first_counts(shipped, gap), "cell bigint, n bigint, q bigint").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    counts = spark.createDataFrame(counts.toArrow())  # at most FAN rows
    placed = spread(rows).mapInArrow(_first_level(shipped, gap), _PLACED)
    if not two:
        return placed, F.broadcast(counts)
    counts = F.broadcast(counts.withColumnRenamed("cell", "part"))
    homes = placed.filter("home").withColumnRenamed("cell", "part").join(counts, "part")
    share = F.least(F.lit(SAMPLE_PER_CENTROID / s.cell), F.lit(float(SAMPLE_PER_CENTROID * s.fan)) / F.col("n"))
    # a part of few classes is drawn whole, so that each has a centroid
    drawn = _drawn(homes, F.when(F.col("n") <= 4 * s.cell, 1.0).otherwise(share), 4)
    tree = cut(drawn.groupBy("part").applyInArrow(_part_centroids(s.cell, s.fan), "part bigint, centroids binary"))
    pairs = pa.table({"part": pa.array((v @ centroids.T).argmax(axis=1).astype("i8")), "q": pa.array(list(q), pa.list_(pa.float32())), "v": pa.array(list(v), pa.list_(pa.float32()))})
    inner = spark.createDataFrame(pairs).join(tree, "part").mapInArrow(_part_gaps(s.dim), "gap double").toArrow().column("gap").to_numpy()
    blocks = counts.select("part", F.ceil(F.col("q") / s.block).cast("int").alias("blocks"))
    left = placed.withColumnRenamed("cell", "part").join(F.broadcast(blocks), "part").withColumn("block", F.pmod(F.xxhash64("class_id", F.lit(5)), F.col("blocks")).cast("int"))
    left = left.select("part", "block", "class_id", "vector", "home")
    right = tree.join(F.broadcast(blocks), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "centroids")
    on, tasks = ["part", "block"], min(MAX_TASKS, 2 * (n // s.block + 1) + 2 * s.fan)
    leaf = left.repartition(tasks, *on).groupBy(*on).cogroup(right.repartition(tasks, *on).groupBy(*on)).applyInArrow(_second_level(_gap(inner, (1 + s.recall) / 2), s.fan, s.dim), _PLACED)
    leaf = cut(leaf)
    return leaf, leaf.groupBy("cell").agg(F.count_if("home").alias("n"), F.count("*").alias("q"))


def _searched(k: int, width: int):
    """The classes of a shard, which are members, queries or both, to (class_id, neighbour, cosine)."""

    def run(rows):
        none = {"class_id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())}
        rows = rows.sort_by("class_id")
        ids, member, query = (rows.column(c).to_numpy() for c in ("class_id", "member", "query"))
        if not member.any() or not query.any():
            return pa.table(none)
        exact = unit(_matrix(rows.column("vector")))
        v = exact.astype("f4")
        inside = np.flatnonzero(member)
        graph = hnsw.build(v[inside])
        out = []
        own = np.flatnonzero(query[inside])
        away = np.flatnonzero(query & ~member)
        for at, start in ((inside[own], own), (away, None)):
            for part in range(0, len(at), hnsw.BATCH):
                q = at[part : part + hnsw.BATCH]
                found, _ = graph.search(v[q], k + 1, width) if start is None else graph.search_from(start[part : part + hnsw.BATCH], k + 1, OWN_WIDTH)
                row, col = np.nonzero(found >= 0)
                near = inside[found[row, col]]
                ok = near != q[row]
                row, near = row[ok], near[ok]
                out.append((ids[q[row]], ids[near], np.einsum("nd,nd->n", exact[q[row]], exact[near])))
        a, b, c = (np.concatenate(x) for x in zip(*out))
        return pa.table({"class_id": pa.array(a), "neighbour": pa.array(b), "cosine": pa.array(c)})

    return run


def nearest_classes(vectors: DataFrame, s: Settings) -> DataFrame:
    """(class_id, neighbour, cosine, rank) of the up to k nearest other classes of each class; ties: smaller id first."""
    n = vectors.count()
    placed, counts = _cells(vectors, n, s) if n else (vectors.select("class_id", "vector", F.lit(0).cast("bigint").alias("cell"), F.lit(True).alias("home")), None)
    if counts is None:
        return placed.select("class_id", F.col("class_id").alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(1).alias("rank"))
    plan = counts.select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / s.shard)).cast("int").alias("shards"), F.ceil(F.col("q") / s.block).cast("int").alias("blocks"))
    rows = placed.join(F.broadcast(plan) if round(n / s.cell) <= s.fan else plan, "cell")
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    rows = rows.withColumn("member", F.col("home") & (F.pmod(F.xxhash64("class_id", F.lit(1)), F.col("shards")) == F.col("shard")))
    # the queries of a shard are dealt into blocks; its members stand in each
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class_id", F.lit(2)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("block", F.explode(F.when(F.col("member"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    rows = rows.select("cell", "shard", "block", "class_id", "vector", "member", (F.col("block") == F.col("own")).alias("query"))
    tasks = max(1, min(MAX_TASKS, 2 * max(round(n / s.cell), n // s.shard)))
    found = rows.repartition(tasks, "cell", "shard", "block").groupBy("cell", "shard", "block").applyInArrow(_searched(s.k, s.width), "class_id bigint, neighbour bigint, cosine double")
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("cosine"), "neighbour"))
    best = cut(found.withColumn("rank", rank).filter(F.col("rank") <= s.k))
    full = best.groupBy("class_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(s.k, n - 1)).select("class_id")
    short = vectors.join(full, "class_id", "left_anti")
    if short.isEmpty():
        return best
    # cells of very few classes: these are compared with all
    exact = exact_search(short.withColumnRenamed("class_id", "idx"), vectors.withColumnRenamed("class_id", "idx"), s.k + 1, s.dim).filter("row_idx <> col_idx")
    rest = exact.select(F.col("row_idx").alias("class_id"), F.col("col_idx").alias("neighbour"), F.col("score").alias("cosine")).withColumn("rank", rank).filter(F.col("rank") <= s.k)
    return best.join(full, "class_id", "left_semi").select("class_id", "neighbour", "cosine", "rank").unionByName(rest)


def nearest_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(vec_id, neighbour, cosine): the k nearest other vectors of each usable vector; ties: smaller id first.

    Vectors that are null, of another length, not finite or all zero are left out. Rows of one class have the same
    neighbours of other classes; a class of more than k vectors is its own neighbourhood, of which the smallest
    ids come first. A table with fewer than two usable vectors gives no rows.
    """
    s = settings
    vectors, several, members = vector_classes(df, vec_id, vector, s.dim, s.k)
    near = nearest_classes(vectors, s)
    # a class of m <= k vectors needs k - m + 1 more; larger ones need none. Most classes have one vector and are in no table
    lists = near.join(several.select("class_id", "n_ids", F.col("ids").alias("own_ids")), "class_id", "left").withColumn("more", s.k + 1 - F.coalesce("n_ids", F.lit(1))).filter("rank <= more")
    ids = several.select(F.col("class_id").alias("neighbour"), F.slice("ids", 1, s.k).alias("near_ids"))
    wide = lists.join(ids, "neighbour", "left").withColumn("near_id", F.explode(F.coalesce("near_ids", F.array("neighbour"))))
    place = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("cosine"), "near_id"))
    others = wide.withColumn("place", place).filter("place <= more")
    outside = others.select(F.explode(F.coalesce("own_ids", F.array("class_id"))).alias("vec_id"), F.col("near_id").alias("neighbour"), "cosine")
    # within a class: the smallest ids but the vector's own
    inside = members.join(several.select("class_id", "ids"), "class_id").select("vec_id", F.slice(F.array_remove("ids", F.col("vec_id")), 1, s.k).alias("ids"))
    inside = inside.select("vec_id", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("cosine"))
    return inside.unionByName(outside)


def similar_pairs(df: DataFrame, threshold: float = 0.85, vec_id: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """Distinct pairs (vec_a, vec_b), vec_a < vec_b, with a cosine of at least ``threshold`` of which one is among the
    other's k nearest."""
    near = nearest_vectors(df, vec_id, vector, settings).filter(F.col("cosine") >= threshold)
    return near.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()
