"""Entity graphs, personalised PageRank, random walks, multi-hop expansion and conflation.

Edges are (src, dst, weight), nodes are any type that can be joined. State of all queries is kept in one table keyed by
(query, node), so that a round of an iteration is one join and one aggregate, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.functions.draws import draws
from relweave.session import cut

#: Rounds between two cuts of the lineage.
CUT_EVERY = 5
ROUNDS_A_PLAN = 2
#: Edges of a graph that is broadcast to random walkers, at most.
WALK_EDGES = 2_000_000
#: Edges, and steps that are no restart, of a part of a larger graph, about.
PART_EDGES, PART_STEPS = 1_000_000, 1_000_000
#: Queries of PageRank that stand side by side in columns, at most.
SIDE_BY_SIDE = 16


# --- construction


def entity_graph(triples: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The relation subject -> object over a vocabulary (idx, token), scores counting triples; parts without an entry are
    dropped. ``triples`` has s, p, o, a row per occurrence."""
    s = vocabulary.select(F.col("token").alias("s"), F.col("idx").alias("row_idx"))
    o = vocabulary.select(F.col("token").alias("o"), F.col("idx").alias("col_idx"))
    return triples.join(s, "s").join(o, "o").groupBy("row_idx", "col_idx").agg(F.count("*").cast("double").alias("score"))


def fact_entity_graph(triples: DataFrame, facts: DataFrame, vocabulary: DataFrame, binary: bool = False) -> DataFrame:
    """The relation fact -> entity: each occurrence of a fact counts for its subject and its object, so that a fact with
    one entity on both sides counts twice. ``facts`` is (idx, token) of fact texts; ``binary`` sets scores to 1."""
    texts = triples.select(F.concat_ws(" ", "s", "p", "o").alias("token"), F.explode(F.array("s", "o")).alias("entity"))
    f = facts.select("token", F.col("idx").alias("row_idx"))
    e = vocabulary.select(F.col("token").alias("entity"), F.col("idx").alias("col_idx"))
    out = texts.join(f, "token").join(e, "entity").groupBy("row_idx", "col_idx").agg(F.count("*").cast("double").alias("score"))
    return out.withColumn("score", F.lit(1.0)) if binary else out


def fact_edges(triples: DataFrame) -> DataFrame:
    """(src, dst, weight): subject and object of each triple, counted in both directions."""
    both = triples.select(F.col("s").alias("src"), F.col("o").alias("dst")).unionByName(triples.select(F.col("o").alias("src"), F.col("s").alias("dst")))
    return both.dropna().groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def passage_edges(triples: DataFrame, passage: str) -> DataFrame:
    """(src, dst, weight 1): each passage and the entities of its triples, once."""
    ends = triples.select(F.col(passage).alias("src"), F.explode(F.array("s", "o")).alias("dst"))
    return ends.dropna().distinct().withColumn("weight", F.lit(1.0))


def assemble(fact: DataFrame, passage: DataFrame, synonym: DataFrame, nodes: DataFrame) -> DataFrame:
    """The undirected edges of all kinds: a synonym edge replaces a fact or passage edge of the same ordered pair, a passage
    edge a fact edge. Loops and edges to nodes that do not exist (``nodes`` has node) are dropped.

    A fact edge comes in both directions and, as the graph is undirected, counts twice; a passage edge once.
    """
    ranked = fact.withColumn("kind", F.lit(0)).unionByName(passage.withColumn("kind", F.lit(1))).unionByName(synonym.withColumn("kind", F.lit(2)))
    merged = ranked.groupBy("src", "dst").agg(F.max_by("weight", "kind").alias("weight")).filter("src <> dst")
    keep = nodes.select("node").distinct()
    return merged.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, parallel ones added up."""
    # not a union, which would compute the edges twice
    ends = F.explode(F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = edges.select(ends.alias("e"), "weight").select("e.src", "e.dst", "weight")
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def seed_weights(query_facts: DataFrame, fact_entities: DataFrame, label_entities: DataFrame, compound: bool = False) -> DataFrame:
    """(query, node, weight): per query the mean over its facts' entities of the fact's score divided by the number of labels
    with the entity.

    ``query_facts`` is (row_idx query, col_idx fact, score), ``fact_entities`` (row_idx fact, side 0 or 1, entity),
    ``label_entities`` a relation label -> entity. An entity without labels is not divided. ``compound`` divides the
    object's score by the frequencies of both sides.
    """
    frequency = label_entities.groupBy(F.col("col_idx").alias("entity")).agg(F.countDistinct("row_idx").alias("df"))
    ends = fact_entities.join(frequency, "entity", "left").withColumn("df", F.coalesce("df", F.lit(1)).cast("double"))
    if compound:
        whole = F.first(F.when(F.col("side") == 0, F.col("df")), True).over(Window.partitionBy("row_idx"))
        ends = ends.withColumn("df", F.when(F.col("side") == 1, F.col("df") * F.coalesce(whole, F.lit(1.0))).otherwise(F.col("df")))
    facts = query_facts.select(F.col("row_idx").alias("query"), F.col("col_idx").alias("fact"), "score")
    hits = facts.join(ends.select(F.col("row_idx").alias("fact"), F.col("entity").alias("node"), "df"), "fact")
    return hits.groupBy("query", "node").agg(F.avg(F.col("score") / F.col("df")).alias("weight"))


def join_seeds(entity: DataFrame, passage: DataFrame, passage_share: float = 0.05) -> DataFrame:
    """Seeds of entities and, weighted by ``passage_share``, of passages; per query scaled to a sum of 1. Negative and NaN
    weights count 0; a query without weight has no seeds."""
    both = entity.select("query", "node", "weight").unionByName(passage.select("query", "node", (F.col("weight") * passage_share).alias("weight")))
    good = both.withColumn("weight", F.when(F.isnan("weight") | (F.col("weight") < 0), 0.0).otherwise(F.col("weight")))
    summed = good.groupBy("query", "node").agg(F.sum("weight").alias("weight")).filter("weight > 0")
    return summed.select("query", "node", (F.col("weight") / F.sum("weight").over(Window.partitionBy("query"))).alias("weight"))


# --- PageRank


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.5, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """(query, node, score): x = (1 - d) r + d W x with W the edges scaled to a sum of 1 per source.

    ``edges`` are directed; give ``undirected`` ones for an undirected graph. ``seeds`` are (query, node, weight) with a
    sum of 1 per query. What reaches a node without edges goes back to the seeds, so that scores always sum to 1.
    ``tolerance`` ends the rounds when the change of every query falls below it, checked at each cut.
    """
    from relweave.operators.indexing import dense_index

    edges = cut(edges.select("src", "dst", "weight"))
    out_weight = edges.groupBy("src").agg(F.sum("weight").alias("total")).filter("total > 0")
    transition = cut(edges.join(out_weight, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    # kept by source, so that no round shuffles the edges again; what an executor loses is read from the table again
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    transition = transition.repartition(parts, "src").sortWithinPartitions("src").persist()
    # queries stand side by side in columns, so that an edge is read once for as many
    places = cut(dense_index(seeds.select("query").distinct(), ["query"], "place").select("query", "place"))
    width = max(1, min(SIDE_BY_SIDE, places.count()))
    xs = [f"x{k}" for k in range(width)]
    named = places.withColumn("group", F.floor(F.col("place") / width)).withColumn("slot", F.pmod("place", F.lit(width)).cast("int"))
    put = [F.coalesce(F.sum(F.when(F.col("slot") == k, F.col("weight").cast("double"))), F.lit(0.0)).alias(c) for k, c in enumerate(xs)]
    r = cut(seeds.join(named, "query").groupBy("group", "node").agg(*put))
    reached = transition.select(F.col("dst").alias("node")).unionByName(r.select("node")).distinct()
    ends = cut(reached.join(transition.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
    # without dead ends a round uses the one before once, and several rounds make one plan
    dead_ends = ends.limit(1).count() > 0
    every = 1 if dead_ends else ROUNDS_A_PLAN
    restart = r.select("group", "node", *((F.col(c) * (1 - damping)).alias(c) for c in xs))
    x = before = r
    for k in range(1, rounds + 1):
        moved = x.join(transition, F.col("node") == F.col("src")).select("group", F.col("dst").alias("node"), *((damping * F.col(c) * F.col("p")).alias(c) for c in xs)).unionByName(restart)
        if dead_ends:
            lost = x.join(ends, "node", "left_semi").groupBy("group").agg(*(F.sum(c).alias(f"lost_{c}") for c in xs))
            moved = moved.unionByName(r.join(lost, "group").select("group", "node", *((damping * F.col(c) * F.col(f"lost_{c}")).alias(c) for c in xs)))
        x = moved.groupBy("group", "node").agg(*(F.sum(c).alias(c) for c in xs))
        if k % every == 0 or k == rounds:
            x = cut(x)
            if tolerance is not None and (k % (2 * ROUNDS_A_PLAN) == 0 or k == rounds):
                gap = lambda c: F.sum(F.abs(F.coalesce(F.col(f"a.{c}"), F.lit(0.0)) - F.coalesce(F.col(f"b.{c}"), F.lit(0.0))))
                both = x.alias("a").join(before.alias("b"), (F.col("a.group") == F.col("b.group")) & (F.col("a.node") == F.col("b.node")), "full")
                change = both.groupBy(F.coalesce("a.group", "b.group").alias("group")).agg(F.greatest(*map(gap, xs), F.lit(0.0)).alias("c"))
                if (change.agg(F.max("c")).first()[0] or 0.0) < tolerance:
                    break
                before = x
    transition.unpersist()  # the last round is a table of its own
    entries = F.explode(F.array(*(F.struct(F.lit(k).alias("slot"), F.col(c).alias("score")) for k, c in enumerate(xs))))
    scores = x.select("group", "node", entries.alias("e")).select("group", "node", "e.slot", "e.score").filter("score > 0")
    return scores.join(named.select("query", "group", "slot"), ["group", "slot"]).select("query", "node", "score")


def rank_nodes(scores: DataFrame, nodes: DataFrame, k: int = 200) -> DataFrame:
    """The k best of ``nodes`` (node) per query; ties: smaller node first."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    return scores.join(nodes.select("node").distinct(), "node", "left_semi").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "node", "score", "rank")


# --- walks


def walk_expectation(edges: DataFrame, starts: DataFrame, restart: float = 0.5, length: int = 8) -> DataFrame:
    """(start, node, score): the expected visits of a walk with restart, sum over k < ``length`` of (1 - restart)^k T^k."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total")).filter("total > 0")
    step = cut(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total") * (1 - restart)).alias("p")))
    at = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("x", F.lit(1.0))
    visits = at
    for k in range(1, length):
        at = at.join(step, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.sum(F.col("x") * F.col("p")).alias("x"))
        if k % CUT_EVERY == 0:
            at = cut(at)
        visits = visits.unionByName(at)
    return visits.groupBy("start", "node").agg(F.sum("x").alias("score"))


def walk_ranges(edges: DataFrame) -> DataFrame:
    """(src, bin, dst, low, high, dst_bins): the edges' ranges of cumulated probability by the bins that they reach into.

    A node has as many bins of equal width as edges, so that there are fewer than two rows per edge, and a uniform draw
    meets fewer than two on average, whatever the degree. ``dst_bins`` is null at a node without edges.
    """
    ranges = edge_ranges(edges)
    bins = ranges.select(F.col("src").alias("dst"), F.col("bins").alias("dst_bins")).distinct()
    reached = F.sequence(_bin("low", "bins"), _bin("high", "bins"))
    return ranges.join(bins, "dst", "left").select("src", F.explode(reached).alias("bin"), "dst", "low", "high", "dst_bins")


def edge_ranges(edges: DataFrame) -> DataFrame:
    """(src, dst, bins, low, high): each edge's range of cumulated probability at its source, and the source's edges, as a table."""
    w = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("src")
    ranges = edges.filter("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return cut(ranges.select("src", "dst", F.count("*").over(whole).cast("int").alias("bins"), ((F.sum("weight").over(w) - F.col("weight")) / F.sum("weight").over(whole)).alias("low"), (F.sum("weight").over(w) / F.sum("weight").over(whole)).alias("high")))


def _bin(x: str, bins: str) -> Column:
    return F.least(F.floor(F.col(x) * F.col(bins)), F.col(bins) - 1).cast("int")


def _with_visits(visits: DataFrame | None, state: DataFrame) -> DataFrame:
    new = state.select("start", F.explode("path").alias("node")).groupBy("start", "node").agg(F.count("*").cast("int").alias("n"))
    return new if visits is None else visits.unionByName(new)


def _drawn(first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each draw the edge of first..last - 1 whose range has it, -1 if none has."""
    at, end = first.copy(), last.copy()
    while (open_ := np.flatnonzero(at < end)).size:
        mid = (at[open_] + end[open_]) >> 1
        up = high[mid] <= u[open_]
        at[open_[up]] = mid[up] + 1
        end[open_[~up]] = mid[~up]
    found = np.flatnonzero(at < last)
    out = np.full(len(u), -1, "i8")
    found = found[low[at[found]] <= u[found]]
    out[found] = at[found]
    return out


def _local_walks(shipped, restart: float, length: int, seed: int):
    """Batches of (start, walker) to (start, node, score), over edges that every worker has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, dst, low, high = shipped.value
        known = {name: k for k, name in enumerate(names.to_pylist())}
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                starts = batch.column(0).to_pylist()
                others = [x for x in dict.fromkeys(starts) if x not in known]
                places = known | {x: len(known) + k for k, x in enumerate(others)} if others else known
                home = np.array([places[x] for x in starts], "i8")
                edges = np.r_[first, np.full(len(others), first[-1])]  # others have none
                u = draws(starts, batch.column(1).to_pylist(), length, restart, seed)
                path = np.empty((len(home), length), "i8")
                path[:, 0] = home
                for step in range(1, length):
                    path[:, step] = home
                    go = np.flatnonzero(~np.isnan(u[:, step - 1]))
                    at = path[go, step - 1]
                    edge = _drawn(edges[at], edges[at + 1], low, high, u[go, step - 1])
                    path[go[edge >= 0], step] = dst[edge[edge >= 0]]
                path.sort(axis=1)
                new = np.ones(path.shape, bool)
                new[:, 1:] = path[:, 1:] != path[:, :-1]
                at = np.flatnonzero(new)
                n = np.diff(np.r_[at, path.size])
                nodes = pa.concat_arrays([names, pa.array(others, names.type)]).take(pa.array(path.ravel()[at]))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(names.type).take(pa.array(at // length)), nodes, pa.array(n.astype("f8"))], ["start", "node", "score"])

    return run


def _chains(restart: float, length: int, seed: int, kind: pa.DataType):
    """Batches of (start, walker) to (start, node, us, n): for each run of steps without a restart its start and its draws; a row
    without draws has the visits that restarts, and the first step, pay to the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                u = draws(batch.column(0).to_pylist(), batch.column(1).to_pylist(), length, restart, seed)
                on = ~np.isnan(u)
                begins = on.copy()
                begins[:, 1:] &= ~on[:, :-1]
                begin = np.flatnonzero(begins)
                offsets = np.r_[(np.cumsum(on.ravel()) - on.ravel())[begin], on.sum()].astype("i4")
                row = begin // (length - 1) if length > 1 else begin
                rows = np.r_[row, np.arange(batch.num_rows)]
                us = pa.ListArray.from_arrays(pa.array(np.r_[offsets, np.full(batch.num_rows, offsets[-1], "i4")]), pa.array(u[on]))
                n = np.r_[np.zeros(len(row), "i4"), 1 + (~on).sum(axis=1).astype("i4")]
                names = batch.column(0).cast(kind).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([names, names, us, pa.array(n.astype("i4"))], ["start", "node", "us", "n"])

    return run


def _part(key, edges):
    """The edges (part, src, dst, weight) of some sources as one row: sources, where their edges start, ends of edges, ranges."""
    edges = edges.sort_by([("src", "ascending"), ("dst", "ascending")])
    src, dst = (edges.column(c).combine_chunks().dictionary_encode() for c in ("src", "dst"))
    s, d = src.indices.to_numpy(zero_copy_only=False), dst.indices.to_numpy(zero_copy_only=False)
    new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])])
    weight = np.add.reduceat(edges.column("weight").to_numpy(), new)
    s = s[new]
    first = np.r_[np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), len(s)]
    high = np.concatenate([np.cumsum(weight[a:b]) for a, b in zip(first[:-1], first[1:])])
    total = np.repeat(high[first[1:] - 1], np.diff(first))
    table = pa.table({"dst": edges.column("dst").combine_chunks().take(pa.array(new)), "low": (high - weight) / total, "high": high / total})
    named = pa.table({"src": src.dictionary, "first": first[:-1].astype("i8")})
    blobs = []
    for t in (named, table):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        blobs.append(sink.getvalue().to_pybytes())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sources": pa.array(blobs[:1], pa.binary()), "edges": pa.array(blobs[1:], pa.binary())})


def _stepped(kind: pa.DataType):
    """One step of chains (part, start, node, us) over the edges of their nodes: (start, node, us, n)."""

    def run(key, state, part):
        start, us = state.column("start").combine_chunks(), state.column("us").combine_chunks()
        u, ends = us.flatten().to_numpy(zero_copy_only=False), np.cumsum(us.value_lengths().to_numpy(zero_copy_only=False))
        begins = np.r_[0, ends[:-1]].astype("i8") if len(ends) else np.empty(0, "i8")
        nodes = start
        if part.num_rows and state.num_rows:
            named, table = (pa.ipc.open_stream(part.column(c)[0].as_py()).read_all() for c in ("sources", "edges"))
            place = pa.compute.index_in(state.column("node").combine_chunks(), named.column("src").combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False)
            first = np.r_[named.column("first").to_numpy(), table.num_rows, table.num_rows]
            # a node without edges stands last
            place = np.where(place < 0, len(first) - 2, place)
            edge = _drawn(first[place], first[place + 1], table.column("low").to_numpy(), table.column("high").to_numpy(), u[begins])
            there = table.column("dst").combine_chunks().take(pa.array(edge, mask=edge < 0))
            nodes = pa.compute.coalesce(there, start)
        rest = np.ones(len(u), bool)
        rest[begins] = False
        offsets = np.r_[0, ends - np.arange(1, len(ends) + 1)].astype("i4")
        return pa.table({"start": start, "node": nodes.cast(kind), "us": pa.ListArray.from_arrays(pa.array(offsets), pa.array(u[rest])), "n": pa.array(np.ones(len(ends), "i4"))})

    return run


def _walks_in_parts(edges: DataFrame, n_edges: int, walking: DataFrame, restart: float, length: int, seed: int) -> DataFrame:
    """The visits of ``random_walks`` on a graph that no worker holds.

    What is drawn at a step does not depend on the way there, and a restart leads to the start. So the runs of steps between
    restarts are independent: all make their first step at once, then their second, and the rounds are as many as the
    longest run has steps, not as the walk has; each has about half the steps of the one before. The edges of a part of the
    nodes are one row of arrays.
    """
    kind = edges.schema["src"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    spark = edges.sparkSession
    cores = spark.sparkContext.defaultParallelism
    steps = int(walking.count() * length * (1 - restart))
    parts = max(2 * cores, -(-n_edges // PART_EDGES), -(-steps // PART_STEPS))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int").alias("part")
    own = edges.filter("weight > 0").select(part("src"), "src", F.col("dst").cast(kind).alias("dst"), F.col("weight").cast("double").alias("weight"))
    graph = cut(own.repartition(parts, "part").groupBy("part").applyInArrow(_part, "part int, sources binary, edges binary"))
    schema = f"start {kind}, node {kind}, us array<double>, n int"
    state = cut(walking.repartition(4 * cores).mapInArrow(_chains(restart, length, seed, arrow), schema))
    visits = state.select("start", "node", "n")
    while not (left := state.filter("size(us) > 0")).isEmpty():
        at = left.select(part("node"), "start", "node", "us").repartition(parts, "part").groupBy("part")
        state = cut(at.cogroup(graph.repartition(parts, "part").groupBy("part")).applyInArrow(_stepped(arrow), schema))
        visits = visits.unionByName(state.select("start", "node", "n"))
    return visits.filter("n > 0").groupBy("start", "node").agg(F.sum("n").cast("double").alias("score"))


def random_walks(edges: DataFrame, starts: DataFrame, restart: float = 0.5, length: int = 400, walkers: int = 1, seed: int = 1) -> DataFrame:
    """(start, node, score): visits of walks of ``length`` steps with restart from each start, by hash-seeded draws.

    A walker at a node without edges restarts. The expectation of the visits is ``walk_expectation`` up to scale. A graph of at
    most ``WALK_EDGES`` edges, between integer or text nodes, is broadcast, and each walker walks in one task. A larger one is
    walked in parts, see ``_walks_in_parts``. Between other nodes a step of all walkers is a join with the ranges of
    ``walk_ranges``. The draws, and so the visits, are the same.
    """
    plain = cut(edges.select("src", "dst", "weight"))
    kind = plain.schema["src"].dataType.simpleString()
    if kind in ("bigint", "int", "string"):
        n_edges = plain.count()
        walking = starts.select(F.col("node").cast(kind).alias("start")).distinct().select("start", F.explode(F.sequence(F.lit(1), F.lit(walkers))).alias("walker"))
        if n_edges > WALK_EDGES:
            return _walks_in_parts(plain, n_edges, cut(walking), restart, length, seed)
        rows = edge_ranges(plain).withColumn("dst", F.col("dst").cast(kind)).orderBy("src", "dst").toArrow()  # at most WALK_EDGES rows
        src, dst = (rows.column(c).combine_chunks() for c in ("src", "dst"))
        names = pa.concat_arrays([src, dst]).unique()
        places = [pa.compute.index_in(c, names).to_numpy(zero_copy_only=False).astype("i8") for c in (src, dst)]
        # the sources come first, in the order of their edges
        first = np.r_[0, np.cumsum(np.bincount(places[0], minlength=len(names)))].astype("i8")
        low, high = (rows.column(c).to_numpy() for c in ("low", "high"))
        shipped = edges.sparkSession.sparkContext.broadcast((names, first, places[1], low, high))  # 24 bytes an edge
        cores = edges.sparkSession.sparkContext.defaultParallelism
        visits = walking.repartition(4 * cores).mapInArrow(_local_walks(shipped, restart, length, seed), f"start {kind}, node {kind}, score double")
        return visits.groupBy("start", "node").agg(F.sum("score").alias("score"))
    edges = plain
    ranges = cut(walk_ranges(edges))
    degrees = edges.filter("weight > 0").groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").cast("int").alias("bins"))
    # kept by source and bin, so that no step shuffles the edges again
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.repartition(parts, "src", "bin").sortWithinPartitions("src", "bin").persist()
    state = starts.select("node").distinct().join(degrees, "node", "left").select(F.col("node").alias("start"), "node", F.explode(F.sequence(F.lit(1), F.lit(walkers))).alias("walker"), "bins", F.col("bins").alias("start_bins"))
    # the nodes of the steps since the last cut go along, so that a step is computed once
    state = cut(state.withColumn("path", F.array("node")))
    none = F.array().cast(state.schema["path"].dataType)
    visits = None

    def draw(step: int, purpose: int):
        digits = F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("start").cast("string"), F.col("walker").cast("string"), F.lit(str(step)), F.lit(str(purpose)))), 1, 12)
        return F.conv(digits, 16, 10).cast("bigint") / float(16**12)

    for k in range(1, length):
        moved = state.withColumn("u", draw(k, 0)).withColumn("again", draw(k, 1) < restart)
        moved = moved.withColumn("drawn", _bin("u", "bins"))
        hit = (F.col("node") == F.col("src")) & (F.col("drawn") == F.col("bin")) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))
        home = F.col("again") | F.col("dst").isNull()
        state = moved.join(ranges, hit, "left").select("start", F.when(home, F.col("start")).otherwise(F.col("dst")).alias("node"), "walker", F.when(home, F.col("start_bins")).otherwise(F.col("dst_bins")).alias("bins"), "start_bins", "path")
        state = state.withColumn("path", F.concat("path", F.array("node")))
        if k % CUT_EVERY == 0:
            state = cut(state)
            visits = _with_visits(visits, state)
            state = state.withColumn("path", none)
        if k % (4 * CUT_EVERY) == 0:
            visits = cut(visits.groupBy("start", "node").agg(F.sum("n").cast("int").alias("n")))
    visits = cut(_with_visits(visits, state).groupBy("start", "node").agg(F.sum("n").cast("double").alias("score")))
    ranges.unpersist()
    return visits


def seed_nodes(reset: DataFrame, columns: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(row_idx, col_idx): the columns that each row of ``reset`` restarts to, and ``n`` random other starts of ``columns``
    (node).

    The columns stand in hash order, and a row takes n in turn from a place of its own, so that they differ within a row
    and no row meets all columns. With fewer than n columns all are taken.
    """
    from relweave.operators.indexing import dense_index, hash_key

    placed = cut(dense_index(columns.select("node").distinct().withColumn("_h", hash_key(seed, "node")), ["_h", "node"], "place").select("node", "place"))
    size = placed.count()
    own = reset.select("row_idx", "col_idx").distinct()
    if not size or not n:
        return own
    rows = own.select("row_idx").distinct()
    first = F.pmod(F.conv(F.substring(hash_key(seed, "row_idx"), 1, 12), 16, 10).cast("bigint"), F.lit(size))
    drawn = rows.select("row_idx", F.explode(F.sequence(first, first + min(n, size) - 1)).alias("at")).select("row_idx", F.pmod("at", F.lit(size)).alias("place"))
    return own.unionByName(drawn.join(placed, "place").select("row_idx", F.col("node").alias("col_idx"))).distinct()


def node_rank_walks(reset: DataFrame, forward: DataFrame, restart: float = 0.5, length: int = 100, seed: int = 1, num_seed_nodes: int = 0, kept: DataFrame | None = None) -> DataFrame:
    """Personalised node rank by walks that restart to a distribution: (row_idx, col_idx, score), scores of a row sum to 1.

    ``reset`` is the relation seed -> column with the restart weights, ``forward`` a square relation of columns with the
    step weights. A walk that restarts to a distribution is a mixture of walks that restart to its columns, so one walk
    per column serves all seeds. ``num_seed_nodes`` more starts of the columns are drawn for each row, with the mean weight
    of its own. Over a graph of two kinds of nodes ``kept`` (node) names those whose visits count: those a step away
    from the seeds, two steps away, or, if None, both.
    """
    if num_seed_nodes:
        starts = seed_nodes(reset, forward.select(F.col("row_idx").alias("node")), num_seed_nodes, seed)
        mean = reset.groupBy("row_idx").agg(F.avg("score").alias("mean"))
        reset = starts.join(reset.select("row_idx", "col_idx", "score"), ["row_idx", "col_idx"], "left").join(mean, "row_idx").select("row_idx", "col_idx", F.coalesce("score", "mean").alias("score"))
    steps = forward.select(F.col("row_idx").alias("src"), F.col("col_idx").alias("dst"), F.col("score").alias("weight"))
    walks = random_walks(steps, reset.select(F.col("col_idx").alias("node")), restart, length, 1, seed)
    walks = walks if kept is None else walks.join(kept.select("node").distinct(), "node", "left_semi")
    mixed = reset.select("row_idx", F.col("col_idx").alias("start"), F.col("score").alias("w")).join(walks, "start")
    mixed = mixed.groupBy("row_idx", F.col("node").alias("col_idx")).agg(F.sum(F.col("score") * F.col("w")).alias("score"))
    return mixed.withColumn("score", F.col("score") / F.sum("score").over(Window.partitionBy("row_idx")))


# --- expansion and conflation


def multi_hop(r: DataFrame, most_labels: int = 4, hops: int | None = None) -> DataFrame:
    """(row_idx, path, rest): every ordered choice of a row's labels, the empty one included; ``rest`` are the labels left.

    n labels give sum n!/(n - k)! rows, so rows of more than ``most_labels`` labels are refused with an error. With
    ``hops`` a choice has at most so many labels, out of however many the row has.
    """
    if hops is not None:
        level = r.groupBy("row_idx").agg(F.array_sort(F.collect_set("col_idx")).alias("rest")).select("row_idx", F.array().cast("array<bigint>").alias("path"), "rest")
        return _choices(level, hops)
    lists = r.groupBy("row_idx").agg(F.array_sort(F.collect_set("col_idx")).alias("rest"), F.count_distinct("col_idx").alias("n"))
    checked = lists.withColumn("rest", F.when(F.col("n") > most_labels, F.raise_error(F.lit(f"a row has more than {most_labels} labels"))).otherwise(F.col("rest")))
    return _choices(checked.select("row_idx", F.array().cast("array<bigint>").alias("path"), "rest"), most_labels)


def _choices(level: DataFrame, hops: int) -> DataFrame:
    out = level
    for _ in range(hops):
        level = level.withColumn("pick", F.explode("rest")).select("row_idx", F.concat("path", F.array("pick")).alias("path"), F.array_remove("rest", F.col("pick")).alias("rest"))
        out = out.unionByName(level)
    return out


def expanded_queries(paths: DataFrame, queries: DataFrame, labels: DataFrame, separator: str = " [SEP] ") -> DataFrame:
    """(identifier, text): for each path of ``multi_hop`` the query's text and those of its labels in order. Paths with a
    label or query that has no text are left out; both tables are (idx, identifier, text)."""
    steps = paths.select("row_idx", "path", F.posexplode_outer("path").alias("pos", "col_idx"))
    named = steps.join(labels.select(F.col("idx").alias("col_idx"), F.col("text").alias("label")).dropDuplicates(["col_idx"]), "col_idx", "left")
    order = F.array_sort(F.collect_list(F.struct("pos", "col_idx", "label")))
    whole = named.groupBy("row_idx", "path").agg(F.filter(order, lambda x: x["pos"].isNotNull()).alias("steps"))
    whole = whole.filter(F.forall("steps", lambda x: x["label"].isNotNull()))
    q = queries.filter("text IS NOT NULL").select(F.col("idx").alias("row_idx"), "text").dropDuplicates(["row_idx"])
    name = F.concat(F.lit("qry-"), F.col("row_idx").cast("string"), F.array_join(F.transform("steps", lambda x: F.concat(F.lit("_lbl-"), x["col_idx"].cast("string"))), ""))
    text = F.concat(F.col("text"), F.array_join(F.transform("steps", lambda x: F.concat(F.lit(separator), x["label"])), ""))
    return whole.join(q, "row_idx").select(name.alias("identifier"), text.alias("text"))


def beam_hops(start: DataFrame, step: DataFrame, hops: int, per_hop: int, beam: int) -> DataFrame:
    """(row_idx, path, score): paths of ``hops`` steps over ``step``; each path goes on to its ``per_hop`` best columns that
    it has not visited, and each row keeps its ``beam`` best paths. A path's score is the product of its scores."""
    from relweave.operators.relation import top_k

    best = cut(top_k(step, per_hop + hops))  # a path visits at most ``hops`` columns, so enough remain
    paths = start.select("row_idx", F.array("col_idx").alias("path"), F.col("score"))
    order = Window.partitionBy("row_idx").orderBy(F.desc("score"), "path")
    paths = paths.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= beam).drop("k")
    for _ in range(hops):
        on = best.select(F.col("row_idx").alias("at"), F.col("col_idx").alias("to"), F.col("score").alias("w"))
        grown = paths.join(on, F.element_at("path", -1) == F.col("at")).filter(~F.array_contains("path", F.col("to")))
        own = Window.partitionBy("row_idx", "path").orderBy(F.desc("w"), "to")
        grown = grown.withColumn("k", F.row_number().over(own)).filter(F.col("k") <= per_hop)
        grown = grown.select("row_idx", F.concat("path", F.array("to")).alias("path"), (F.col("score") * F.col("w")).alias("score"))
        paths = grown.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= beam).drop("k")
    return paths


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): connected components, named by their smallest node.

    Large-star and small-star rounds: every node's neighbours are linked to the smallest of them, until no edge moves.
    The edges stay a table; each round is two aggregates, and hubs do not gather lists. The number of rounds grows with the
    square of the logarithm of the nodes at most.
    """
    edges = pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least_small = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least_small, "a").select("b", "m", "a")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = cut(new)
        moved = new.exceptAll(edges).limit(1).count() + edges.exceptAll(new).limit(1).count()
        edges = new
        if not moved:
            break
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.select("node").distinct().join(roots, "node", "left").withColumn("component", F.coalesce("component", F.col("node")))


def conflate_similar(similar: DataFrame, r: DataFrame, columns: DataFrame, top: int = 1, least: float = 0.9, most: float | None = None, largest_difference: float | None = None) -> DataFrame:
    """``r`` with its columns merged along similarity: each column is linked to its ``top`` most similar of at least
    ``least`` and at most ``most``, linked columns become their smallest, and scores of merged cells add up. ``columns`` has
    node. With ``largest_difference`` a column is linked only to those whose similarity differs from that of its best by
    no more than that."""
    from relweave.operators.relation import drop_diagonal, threshold, top_k

    close = threshold(drop_diagonal(similar), least)
    close = close if most is None else close.filter(F.col("score") <= most)
    if largest_difference is not None:
        best = F.max("score").over(Window.partitionBy("row_idx"))
        close = close.withColumn("best", best).filter(F.col("best") - F.col("score") <= largest_difference).drop("best")
    links = top_k(close, top).select(F.col("row_idx").alias("src"), F.col("col_idx").alias("dst"))
    return remap_columns(r, components(links, columns))


def conflate_phrases(info: DataFrame, r: DataFrame) -> DataFrame:
    """``r`` with the columns merged whose cleaned texts are equal; ``info`` is (idx, identifier, text). Columns without a
    text, or with one that is empty once it is cleaned, stay as they are."""
    from relweave.functions.text import clean

    named = info.select(F.col("idx").alias("node"), clean(F.col("text")).alias("phrase")).filter("phrase <> ''")
    first = named.groupBy("phrase").agg(F.min("node").alias("component"))
    # a column of several texts goes with the smallest
    return remap_columns(r, named.join(first, "phrase").groupBy("node").agg(F.min("component").alias("component")))


def remap_columns(r: DataFrame, mapping: DataFrame) -> DataFrame:
    """Columns renamed by ``mapping`` (node, component); columns that it lacks stay."""
    return (
        r.join(mapping.select(F.col("node").alias("col_idx"), "component"), "col_idx", "left")
        .groupBy("row_idx", F.coalesce("component", F.col("col_idx")).alias("col_idx"))
        .agg(F.sum("score").alias("score"))
    )
