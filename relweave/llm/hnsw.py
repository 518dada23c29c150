"""A hierarchical navigable small-world graph over one shard of unit vectors, in flat neighbour arrays.

Each layer is one int32 array with a row of neighbours per node, padded with -1. A shard is small, so that the
candidates of a layer's links are found by matrix products of its nodes, and only then thinned out to diverse ones and
linked back. Whole batches are searched at a time: a step of the search expands one node for every query of the
batch, so that all work is array arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEGREE, UPPER_DEGREE = 20, 12
#: One node in so many also stands in the layer above.
THINNING = 16
#: Candidates of a node's links among all nodes and among those of the layer above, which lead out of dense clusters.
CANDIDATES, FAR = 24, 12
#: Nodes or queries handled at a time.
BATCH = 1024
#: A layer of at most so many nodes is the top; all of it is compared with a query, and so many of the best are entries.
TOP, ENTRIES = 1024, 8
#: New links to a node considered together when its row is full.
INCOMING = 24


def beam(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best nodes that a best-first walk from ``entries`` finds for each query: ids (-1: none) and similarities."""
    n = len(queries)
    ids, sims, done = np.full((n, width), -1, "i4"), np.full((n, width), -2, "f4"), np.ones((n, width), bool)
    seen = np.zeros((n, len(vectors) + 1), bool)  # the last column takes the padding
    seen[:, -1] = True
    seen[np.arange(n)[:, None], entries] = True
    e = min(width, entries.shape[1])
    first = np.einsum("nkd,nd->nk", vectors[entries], queries)
    first[entries < 0] = -2
    best = np.argsort(-first, axis=1)[:, :e]
    ids[:, :e], sims[:, :e] = np.take_along_axis(entries, best, 1), np.take_along_axis(first, best, 1)
    done[:, :e] = ids[:, :e] < 0
    rows = np.arange(n)
    while len(rows):
        open_ = np.where(done[rows], -3, sims[rows])
        pick = open_.argmax(axis=1)
        go = open_[np.arange(len(rows)), pick] > -2.5
        rows, pick = rows[go], pick[go]
        if not len(rows):
            break
        done[rows, pick] = True
        near = graph[ids[rows, pick]]
        fresh = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        r, c = np.nonzero(fresh)
        node = near[r, c]
        s = np.einsum("nd,nd->n", vectors[node], queries[rows[r]])
        better = s > sims[rows].min(axis=1)[r]
        r, node, s = r[better], node[better], s[better]
        if not len(r):
            continue
        # what is new and better for each query, side by side
        some, place, n_new = np.unique(r, return_inverse=True, return_counts=True)
        col = np.arange(len(r)) - (np.cumsum(n_new) - n_new)[place]
        new_s, new_id = np.full((len(some), n_new.max()), -2, "f4"), np.full((len(some), n_new.max()), -1, "i4")
        new_s[place, col], new_id[place, col] = s, node
        at = rows[some]
        all_s = np.concatenate([sims[at], new_s], axis=1)
        keep = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        sims[at] = np.take_along_axis(all_s, keep, 1)
        ids[at] = np.take_along_axis(np.concatenate([ids[at], new_id], axis=1), keep, 1)
        done[at] = np.take_along_axis(np.concatenate([done[at], new_id < 0], axis=1), keep, 1)
    order = np.argsort(-sims, axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates up to ``degree``: first those nearer to the node than to any chosen before, best first,
    then the best of the others."""
    order = np.argsort(-np.where(ids < 0, -3, sims), axis=1)
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    n, c = ids.shape
    v = vectors[ids]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen, count = np.zeros((n, c), bool), np.zeros(n, "i4")
    closest = np.full((n, c), -2.0, "f4")  # of each candidate to the chosen
    for k in range(c):
        take = (ids[:, k] >= 0) & (sims[:, k] > closest[:, k]) & (count < degree)
        chosen[:, k] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, k]), closest)
    rank = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(ids, rank, 1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


@dataclass
class Graph:
    """``layers[0]`` spans all nodes; ``members[l]`` are the nodes of layer l, whose rows are ``layers[l]``."""

    vectors: np.ndarray
    layers: list[np.ndarray]
    members: list[np.ndarray]

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """Nodes from which to search the lowest layer: the best of the top layer, led down through those between."""
        top = self.members[-1]
        s = queries @ self.vectors[top].T
        e = min(ENTRIES, len(top))
        at = top[np.argpartition(-s, e - 1, axis=1)[:, :e]]
        for level in range(len(self.layers) - 2, 0, -1):
            member = self.members[level]
            found, _ = beam(self.vectors[member], self.layers[level], queries, np.searchsorted(member, at).astype("i4"), ENTRIES)
            at = member[np.where(found < 0, found[:, :1], found)]
        return _distinct(at)

    def search(self, queries: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``k`` nearest nodes found, best first, as ids (-1: none) and similarities."""
        found = [beam(self.vectors, self.layers[0], q, self.entries(q), max(k, width)) for at in range(0, len(queries), BATCH) for q in [queries[at : at + BATCH]]]
        return np.concatenate([f[0][:, :k] for f in found]), np.concatenate([f[1][:, :k] for f in found])


    def search_from(self, nodes: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``search``, for the vectors of nodes, which are the entries; a node finds itself first."""
        found = [beam(self.vectors, self.layers[0], self.vectors[part], part[:, None].astype("i4"), max(k, width)) for at in range(0, len(nodes), BATCH) for part in [nodes[at : at + BATCH]]]
        return np.concatenate([f[0][:, :k] for f in found]), np.concatenate([f[1][:, :k] for f in found])


def _distinct(entries: np.ndarray) -> np.ndarray:
    entries = np.sort(entries, axis=1).astype("i4")
    entries[:, 1:][entries[:, 1:] == entries[:, :-1]] = -1
    return entries


def _best(s: np.ndarray, c: int) -> np.ndarray:
    return np.argpartition(-s, c - 1, axis=1)[:, :c].astype("i4")


def _layer(vectors: np.ndarray, degree: int, above: np.ndarray) -> np.ndarray:
    """Links over ``vectors``: diverse ones of each node's nearest and of its nearest among the nodes ``above``, and back."""
    n = len(vectors)
    graph = np.full((n, degree), -1, "i4")
    c, far = min(CANDIDATES, n - 1), min(FAR, len(above) - 1)
    for at in range(0, n if c > 0 else 0, BATCH):
        s = vectors[at : at + BATCH] @ vectors.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -3
        near = _best(s, c)
        sims = np.take_along_axis(s, near, 1)
        if far > 0:
            np.put_along_axis(s, near, -3, 1)  # each candidate once
            among = s[:, above]
            more = _best(among, far)
            far_sims = np.take_along_axis(among, more, 1)
            near = np.concatenate([near, np.where(far_sims > -2, above[more], -1)], axis=1).astype("i4")
            sims = np.concatenate([sims, far_sims], axis=1)
        graph[at : at + BATCH] = diverse(vectors, near, sims, degree)
    _link_back(vectors, graph, np.arange(n, dtype="i4"))
    return graph


def _link_back(vectors: np.ndarray, graph: np.ndarray, new: np.ndarray) -> None:
    """Add ``new`` to the rows of their neighbours; a row that overflows keeps a diverse choice."""
    source, target = np.repeat(new, graph.shape[1]), graph[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    known = (graph[target] == source[:, None]).any(axis=1)
    source, target = source[~known], target[~known]
    if not len(target):
        return
    s = np.einsum("nd,nd->n", vectors[source], vectors[target])
    order = np.lexsort((-s, target))
    source, target = source[order], target[order]
    first = np.r_[True, target[1:] != target[:-1]]
    rank = np.arange(len(target)) - np.maximum.accumulate(np.where(first, np.arange(len(target)), 0))
    source, target, rank = (x[rank < INCOMING] for x in (source, target, rank))
    nodes, row = np.unique(target, return_inverse=True)
    incoming = np.full((len(nodes), INCOMING), -1, "i4")
    incoming[row, rank] = source
    for part in range(0, len(nodes), BATCH):
        own = nodes[part : part + BATCH]
        both = np.concatenate([graph[own], incoming[part : part + BATCH]], axis=1)
        graph[own] = diverse(vectors, both, np.einsum("nkd,nd->nk", vectors[both], vectors[own]), graph.shape[1])


def build(vectors: np.ndarray, seed: int = 1) -> Graph:
    """The graph of unit ``vectors`` (float32)."""
    n = len(vectors)
    levels = (-np.log(np.random.default_rng(seed).random(n)) / np.log(THINNING)).astype(int)
    members = [np.arange(n)]
    while len(members[-1]) > TOP:
        members.append(np.flatnonzero(levels >= len(members)))
    layers = []
    for level, m in enumerate(members):
        upper = np.flatnonzero(levels[m] > level)
        layers.append(_layer(vectors[m], UPPER_DEGREE if level else DEGREE, upper))
    return Graph(vectors, layers, members)
