"""Communities of a weighted graph, and the reports built on them.

Partitions are made by local moving, refinement and aggregation of modularity,
with a fixed order of nodes, one Python task for each group of ``group``
(a repository or a namespace); the reports around it are DataFrames. A group of
more than ``TASK_EDGES`` edges is cut into its connected components, which are
partitioned apart and give the same communities; one component has to fit a task,
as arrays of integers and weights.
"""

from __future__ import annotations

import random
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.names import stable_community_id
from lodestone.operators import numbering
from lodestone.storage import written

MIN_FILES = 10
TASK_EDGES = 8_000_000  # of a group that goes to a task uncut: some 300 MB there
Graph = dict[object, dict[object, float]]


def adjacency(edges: list[tuple[object, object, float]]) -> Graph:
    out: Graph = defaultdict(dict)
    for a, b, w in edges:
        out[a][b] = out[a].get(b, 0.0) + w
        if a != b:
            out[b][a] = out[b].get(a, 0.0) + w
        else:
            out[a].setdefault(a, 0.0)
    return out


class Compact(NamedTuple):
    """An undirected graph of nodes 0, 1, ...: the neighbours of node n and their weights stand at ``start[n]:start[n + 1]``,
    sorted, without n itself; ``loop`` is the weight of its edge to itself. 24 bytes an edge."""

    start: np.ndarray
    near: np.ndarray
    weight: np.ndarray
    loop: np.ndarray


BLOCK = 1 << 22  # entries that are sorted at once


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their weights."""
    if not len(key):
        return key, weight
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(weight[order], first)


def _blocks(start: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of nodes with about BLOCK entries each."""
    lo, n = 0, len(start) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(start, start[lo] + BLOCK, "right")) - 1))
        yield lo, hi
        lo = hi


def compact(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> Compact:
    """Of edges (a, b, w) between ``n`` nodes; the weights of edges that come several times add up."""
    own = a == b
    loop = np.bincount(a[own], w[own], n).astype(float)
    if own.any():
        a, b, w = a[~own], b[~own], w[~own]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n))])
    near, weight, size, end = np.empty(bounds[-1], np.int32), np.empty(bounds[-1]), np.zeros(n, np.int64), 0
    for lo, hi in _blocks(bounds):
        i, j = (np.flatnonzero((x >= lo) & (x < hi)) for x in (a, b))
        key, sums = _summed(np.concatenate([a[i], b[j]]).astype(np.int64) * n + np.concatenate([b[i], a[j]]), np.concatenate([w[i], w[j]]))
        near[end : end + len(key)], weight[end : end + len(key)] = key % n, sums
        size[lo:hi] = np.bincount(key // n - lo, minlength=hi - lo)
        end += len(key)
    return Compact(np.concatenate([[0], np.cumsum(size)]), near[:end], weight[:end], loop)


def _rows(graph: Compact, lo: int, hi: int) -> np.ndarray:
    return np.repeat(np.arange(lo, hi), np.diff(graph.start[lo : hi + 1]))


def _merged(graph: Compact, group: np.ndarray, n: int) -> Compact:
    """The graph of ``n`` groups of nodes."""
    loop, keys, sums = np.bincount(group, graph.loop, n).astype(float), [], []
    for lo, hi in _blocks(graph.start):
        s, e = graph.start[lo], graph.start[hi]
        a, b, w = group[_rows(graph, lo, hi)].astype(np.int64), group[graph.near[s:e]], graph.weight[s:e]
        inner = a == b
        loop += np.bincount(a[inner], w[inner] / 2, n)  # an edge inside is met from both of its ends
        key, total = _summed(a[~inner] * n + b[~inner], w[~inner])
        keys.append(key)
        sums.append(total)
        if sum(map(len, keys)) > 4 * BLOCK:
            keys, sums = ([x] for x in _summed(np.concatenate(keys), np.concatenate(sums)))
    key, weight = _summed(np.concatenate([*keys, np.empty(0, np.int64)]), np.concatenate([*sums, np.empty(0)]))
    return Compact(np.concatenate([[0], np.cumsum(np.bincount(key // n, minlength=n))]), (key % n).astype(np.int32), weight, loop)


def _inner(graph: Compact, part: np.ndarray) -> Compact:
    """The graph without the edges between parts."""
    near, weight, size = [graph.near[:0]], [graph.weight[:0]], np.zeros(len(part), np.int64)
    for lo, hi in _blocks(graph.start):
        s, e = graph.start[lo], graph.start[hi]
        rows = _rows(graph, lo, hi)
        same = part[rows] == part[graph.near[s:e]]
        near.append(graph.near[s:e][same])
        weight.append(graph.weight[s:e][same])
        size[lo:hi] = np.bincount(rows[same] - lo, minlength=hi - lo)
    return Compact(np.concatenate([[0], np.cumsum(size)]), np.concatenate(near), np.concatenate(weight), graph.loop)


def _lists(graph: Compact) -> tuple[Callable, Callable]:
    """Functions that give a node's neighbours and weights as lists; those of a small graph are made once."""
    start = graph.start.tolist()
    near, weight = (lambda n, x=x: x[start[n] : start[n + 1]].tolist() for x in (graph.near, graph.weight))
    if start[-1] <= BLOCK // 16:
        return tuple([f(n) for n in range(len(start) - 1)].__getitem__ for f in (near, weight))
    return near, weight


def _move(graph: Compact, start: np.ndarray, gamma: float, within: np.ndarray | None = None, total: float | None = None, seed: int | None = None) -> np.ndarray:
    """Local moving: each node joins the neighbouring community of the largest gain, until none gains.

    ``within``: moves stay inside the node's part of it (refinement). ``total``:
    the strength of the whole graph, where this is a part of one. ``seed``: the
    order of nodes is shuffled by it.
    """
    n_nodes = len(start)
    power = 2 * graph.loop
    for lo, hi in _blocks(graph.start):
        power[lo:hi] += np.bincount(_rows(graph, lo, hi) - lo, graph.weight[graph.start[lo] : graph.start[hi]], hi - lo)
    total = total or float(power.sum()) or 1.0
    mass, strength, part = np.bincount(start, power, n_nodes).tolist(), power.tolist(), start.tolist()
    around, _ = _lists(graph)
    near, weight = _lists(graph if within is None else _inner(graph, within))
    order = list(range(n_nodes))
    if seed is not None:
        random.Random(seed).shuffle(order)
    queue, waiting = deque(order), bytearray(b"\1") * n_nodes
    of = part.__getitem__
    while queue:
        n = queue.popleft()
        waiting[n] = 0
        own = best = part[n]
        mass[own] -= strength[n]
        cost = gamma * strength[n] / total
        links: dict = {}
        get = links.get
        for p, w in zip(map(of, near(n)), weight(n), strict=True):
            links[p] = get(p, 0.0) + w
        stay = top = get(own, 0.0) - cost * mass[own]
        for p, w in links.items():
            gain = w - cost * mass[p]
            if gain >= top and (gain > top or (best != own and p > best)):
                best, top = p, gain
        if top <= stay + 1e-12:
            best = own
        mass[best] += strength[n]
        if best != own:
            part[n] = best
            for m in around(n):
                if not waiting[m] and part[m] != best:
                    waiting[m] = 1
                    queue.append(m)
    return np.array(part, np.int32)


def parts(graph: Compact, gamma: float = 1.0, total: float | None = None, seed: int | None = None) -> np.ndarray:
    """The community of each node, named by its least node. Communities are connected, as refinement only merges neighbours."""
    at = np.arange(len(graph.loop), dtype=np.int32)  # of each node, the group that it is in by now
    part = at
    while True:
        part = _move(graph, part, gamma, None, total, seed)
        fine = _move(graph, np.arange(len(part), dtype=np.int32), gamma, part, total, seed)
        _, first, group = np.unique(fine, return_index=True, return_inverse=True)
        if len(first) == len(fine):
            break
        # groups and parts are numbered anew in the order of their names, by which ties go
        graph, at = _merged(graph, group, len(first)), group.astype(np.int32)[at]
        part = np.unique(part[first], return_inverse=True)[1].astype(np.int32)
    _, least, community = np.unique(part[at], return_index=True, return_inverse=True)
    return least[community]


def partition(graph: Graph, gamma: float = 1.0, total: float | None = None, seed: int | None = None) -> dict:
    """Node to community, as ``parts``, of a graph of named nodes."""
    names = sorted(graph, key=str)
    number = {n: i for i, n in enumerate(names)}
    ends = [(number[n], number[m], w) for n, near in graph.items() for m, w in near.items() if number[n] <= number[m]]
    a, b, w = (np.array([e[k] for e in ends], kind) for k, kind in enumerate((np.int32, np.int32, float)))
    found = parts(compact(a, b, w, len(names)), gamma, total, seed)
    return {n: names[c] for n, c in zip(names, found.tolist(), strict=True)}


def components(edges: DataFrame, group: str) -> DataFrame:
    """(group, member, component): connected components, each named by its least member.

    Every node takes the least name among its neighbours' and then that name's
    own, so names travel along twice as long paths in each round; a round is two joins
    and two aggregates, whatever the number of components.
    """
    both = written(edges.select(group, F.col("a").alias("member"), F.col("b").alias("other")).union(edges.select(group, "b", "a")).distinct(), "ends")
    own = written(both.groupBy(group, "member").agg(F.least(F.col("member"), F.min("other")).alias("component")), "components")
    while True:
        names = own.select(group, F.col("member").alias("other"), F.col("component").alias("_near"))
        near = both.join(names, [group, "other"]).groupBy(group, "member").agg(F.min("_near").alias("_near"))
        # a component's name goes on to the node that it named, so whole trees hook at once
        hooked = own.join(near, [group, "member"]).withColumn("_least", F.least("component", "_near"))
        roots = hooked.groupBy(group, F.col("component").alias("other")).agg(F.min("_least").alias("_root"))
        new = hooked.select(group, "member", "component", F.col("_least").alias("other")).join(roots, [group, "other"], "left")
        new = written(new.select(group, "member", F.col("component").alias("_was"), F.least("other", F.coalesce("_root", "other")).alias("component")), "components")
        own = new.drop("_was")
        if not new.where("component <> _was").limit(1).count():
            return own


def detect(edges: DataFrame, group: str, gamma: float = 1.0, task_edges: int = TASK_EDGES) -> DataFrame:
    """(group, member, community) of undirected edges (group, a, b, weight).

    Names are numbered first, so a task holds integers, some 40 bytes an edge at most.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "weight")] for b in batches]
        a, b, w = (np.concatenate([p.pop(0) for p in pieces]) for _ in range(3))
        there = np.zeros(int(max(a.max(), b.max())) + 1, bool)
        there[a] = there[b] = True
        nodes, local = np.flatnonzero(there).astype(np.int32), np.cumsum(there, dtype=np.int32)
        a, b = local[a] - 1, local[b] - 1
        graph = compact(a, b, w, len(nodes))
        del a, b, w, local, there
        found = nodes[parts(graph, gamma, key[1].as_py())]
        for i in range(0, len(nodes), 100_000):
            n = len(nodes[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * n, pa.string()), pa.array(nodes[i : i + n]), pa.array(found[i : i + n])], [group, "member", "community"])

    schema = f"{group} string, member int, community int"
    edges = written(edges.select(group, "a", "b", F.col("weight").cast("double").alias("weight")), "graph")
    names = numbering.numbered(edges.select(F.col("a").alias("name")).union(edges.select("b")))
    edges = written(numbering.replaced(edges, names, "a", "b"), "graph")
    sizes = edges.groupBy(group).agg((F.count("*") > task_edges).alias("large"), (2 * F.sum("weight")).alias("total"))
    if not sizes.where("large").limit(1).count():
        found = edges.withColumn("total", F.lit(None).cast("double")).groupBy(group, "total").applyInArrow(run, schema)
    else:
        parts_ = edges.join(sizes, edges[group].eqNullSafe(sizes[group])).drop(sizes[group])
        small = parts_.where("not large").withColumn("total", F.lit(None).cast("double")).drop("large").groupBy(group, "total").applyInArrow(run, schema)
        large = parts_.where("large").drop("large")
        own = components(large, group).withColumnRenamed("member", "a")
        found = small.unionByName(large.join(own, [group, "a"]).groupBy(group, "total", "component").applyInArrow(run, schema))
    return numbering.named(found, names, "member", "community")


def clusters(members: DataFrame, group: str, prefix: str, languages: DataFrame | None = None) -> DataFrame:
    """One row for each community: stable id, size, members and language (ties go to the first by name)."""
    named = members if languages is None else members.join(languages, "member", "left")
    language = F.mode("language", True) if languages is not None else F.lit(None).cast("string")
    out = named.groupBy(group, "community").agg(F.sort_array(F.collect_set("member")).alias("members"), language.alias("dominant_language"))
    return out.select(group, stable_community_id(prefix, F.col("members")).alias("id"), F.size("members").cast("long").alias("size"), "members", "dominant_language")


def singletons(members: DataFrame, group: str, least: int = MIN_FILES) -> DataFrame:
    """Small graphs aren't clustered: below ``least`` members each is its own community."""
    few = members.withColumn("_n", F.count("*").over(W.partitionBy(group)))
    return few.withColumn("community", F.when(F.col("_n") < least, F.col("member")).otherwise(F.col("community"))).drop("_n")


def crossing(edges: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Edges with the communities of both ends."""
    of = lambda side, name: members.select(group, F.col("member").alias(side), F.col("community").alias(name))
    return edges.join(of("from_node", "from_community"), [group, "from_node"]).join(of("to_node", "to_community"), [group, "to_node"])


def cohesion(crossed: DataFrame, group: str) -> DataFrame:
    """Inner edges over inner and outer ones of each community; an outer edge counts for both ends."""
    ends = crossed.select(group, F.explode(F.array_distinct(F.array("from_community", "to_community"))).alias("community"), (F.col("from_community") == F.col("to_community")).cast("double").alias("inner"))
    return ends.groupBy(group, "community").agg(F.round(F.sum("inner") / F.count("*"), 6).alias("cohesion"))


def module_dependencies(crossed: DataFrame, group: str) -> DataFrame:
    out = crossed.where("from_community <> to_community").groupBy(group, "from_community", "to_community")
    return out.agg(F.round(F.sum("weight"), 6).alias("weight"))


def module_importance(sizes: DataFrame, dependencies: DataFrame, group: str) -> DataFrame:
    """Size times one plus the weight of what comes in and goes out."""
    ends = dependencies.select(group, F.explode(F.array("from_community", "to_community")).alias("community"), "weight")
    outer = ends.groupBy(group, "community").agg(F.sum("weight").alias("outer"))
    return sizes.join(outer, [group, "community"], "left").withColumn("importance", F.round(F.col("size") * (1 + F.coalesce("outer", F.lit(0.0))), 6))


def architecture(dependencies: DataFrame, group: str, most: int = 3) -> DataFrame:
    """The strongest outgoing dependencies of each community."""
    order = W.partitionBy(group, "from_community").orderBy(F.desc("weight"), "to_community")
    return dependencies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def view_nodes(edges: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """(group, node, community, degree): of each node, the number of nodes it shares an edge with; one without has 0."""
    ends = edges.where("from_node <> to_node").select(group, F.col("from_node").alias("node"), F.col("to_node").alias("other"))
    both = ends.union(ends.select(group, "other", "node")).distinct().groupBy(group, "node").agg(F.count("*").alias("degree"))
    own = members.select(group, F.col("member").alias("node"), "community")
    return own.join(both, [group, "node"], "left").na.fill(0, ["degree"])


def view_edges(edges: DataFrame, group: str) -> DataFrame:
    """(group, from_node, to_node, weight, kind): of the kinds, the first by name."""
    return edges.select(group, "from_node", "to_node", "weight", F.array_min("kinds").alias("kind"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over both ends of undirected edges (a, b)."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def meta_graph(crossed: DataFrame, group: str) -> DataFrame:
    """One node for each community; an edge weighs as many edges as cross."""
    pair = (F.least("from_community", "to_community").alias("a"), F.greatest("from_community", "to_community").alias("b"))
    return crossed.where("from_community <> to_community").groupBy(group, *pair).agg(F.count("*").alias("weight"))


def layout(nodes: list[str], edges: list[tuple[str, str, float]], seed: int = 7) -> dict[str, tuple[float, float]]:
    """Force-directed places of a graph small enough to draw (after meta_graph): 60 rounds above 500 nodes, else 120."""
    n = len(nodes)
    if not n:
        return {}
    at = np.random.default_rng(seed).random((n, 2))
    index = {x: i for i, x in enumerate(nodes)}
    pairs = np.array([(index[a], index[b]) for a, b, _ in edges if a != b], int).reshape(-1, 2)
    k, rounds = 1 / np.sqrt(n), 60 if n > 500 else 120
    for r in range(rounds):
        gap = at[:, None] - at[None]
        far = np.maximum(np.linalg.norm(gap, axis=2), 1e-9)
        push = (gap / far[..., None] * (k * k / far)[..., None]).sum(axis=1)
        pull = np.zeros_like(at)
        if len(pairs):
            d = at[pairs[:, 0]] - at[pairs[:, 1]]
            f = d * (np.linalg.norm(d, axis=1) / k)[:, None]
            np.add.at(pull, pairs[:, 0], -f)
            np.add.at(pull, pairs[:, 1], f)
        step = push + pull
        size = np.maximum(np.linalg.norm(step, axis=1), 1e-9)[:, None]
        at += step / size * np.minimum(size, 0.1 * (1 - r / rounds))
    return {x: (float(a), float(b)) for x, (a, b) in zip(nodes, at, strict=True)}


def _cut(graph: Graph, source: object, sink: object) -> list[tuple[object, object, float]]:
    """The edges of a minimum cut between two nodes of an undirected graph: blocking flows over shortest paths until none is left."""
    room = {n: dict(near) for n, near in graph.items()}
    near = {n: list(x) for n, x in room.items()}
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            n = queue.popleft()
            for m in near[n]:
                if m not in level and room[n][m] > 1e-12:
                    level[m] = level[n] + 1
                    queue.append(m)
        if sink not in level:
            return [(n, m, w) for n in level for m, w in graph[n].items() if m not in level]
        at, path = dict.fromkeys(level, 0), [source]
        while path:
            n = path[-1]
            if n == sink:
                steps = list(zip(path, path[1:], strict=False))
                flow = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= flow
                    room[b][a] += flow
                path = [source]
                continue
            while at[n] < len(near[n]):
                m = near[n][at[n]]
                if room[n][m] > 1e-12 and level.get(m, -1) == level[n] + 1:
                    path.append(m)
                    break
                at[n] += 1
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1


def _candidates(inner: Graph, fine: dict) -> dict[object, tuple[float, float]]:
    """(cut share, participation) of each node between the two largest parts of a community.

    The parts' inner ends are joined to one node each by edges too strong to be
    cut, except for the nodes at the border, whose edges the cut can go through.
    """
    size: dict = defaultdict(int)
    for p in fine.values():
        size[p] += 1
    first, second = sorted(size, key=lambda p: (-size[p], str(p)))[:2]
    border = {n for n in inner if any(fine[m] != fine[n] for m in inner[n])}
    ends = {first: ("end", 0), second: ("end", 1)}
    whole: Graph = {n: {m: w for m, w in near.items() if m != n} for n, near in inner.items()}
    huge = 1 + sum(sum(near.values()) for near in whole.values())
    for p, end in ends.items():
        own = [n for n in whole if fine.get(n) == p]
        for n in [n for n in own if n not in border] or own:
            whole.setdefault(end, {})[n] = huge
            whole[n][end] = huge
    cut = _cut(whole, *ends.values())
    weight = sum(w for *_, w in cut) or 1.0
    share: dict = defaultdict(float)
    for a, b, w in cut:
        share[a] += w / weight
        share[b] += w / weight
    out = {}
    for n, near in inner.items():
        by: dict = defaultdict(float)
        for m, w in near.items():
            by[fine[m]] += w
        strength = sum(by.values()) or 1.0
        out[n] = (min(share[n], 1.0), 1 - sum((w / strength) ** 2 for w in by.values()))
    return out


def couplings(edges: DataFrame, group: str, ladder: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0), nearest: int = 8, seeds: int = 4) -> DataFrame:
    """Nodes that hold communities together: how much oftener their community separates once they are taken out.

    A community that separates into two parts of more than a node at no
    resolution of the ladder is skipped; one that separates first at a higher one is fragile, and names
    its two largest parts there. Its nodes are ranked by their share of the
    minimum cut between these and by participation; the ``nearest`` best are
    taken out one by one (a verification of candidates, so ``nearest`` bounds a
    report, as a top-k does), and the rest is partitioned under ``seeds`` orders of
    nodes at each resolution. ``split_probability``: the share of runs at the
    resolution of most effect in which the parts separate, ``baseline`` the same share with
    the node there, ``strength`` their difference; ``gamma_low`` and
    ``gamma_high``: the resolutions between which there is one.
    """

    def apart(graph: Graph, gamma: float, a: set, b: set) -> float:
        """The share of seeds by which most of one part shares no community with most of the other."""
        split = 0
        for seed in range(seeds):
            found = partition(graph, gamma, seed=seed)
            main = [max(sorted({found[n] for n in part if n in found}, key=str), key=lambda c, p=part: sum(found.get(n) == c for n in p), default=None) for part in (a, b)]
            split += main[0] != main[1]
        return split / seeds

    edge_lists = "a array<string>, b array<string>, weight array<double>"
    shape = f"{group} string, community string, {edge_lists}, first array<string>, second array<string>, baseline array<double>, node string, cut_share double, participation double"

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        graph = adjacency(list(pdf[["a", "b", "weight"]].itertuples(index=False, name=None)))
        groups: dict = defaultdict(set)
        for n, c in partition(graph, ladder[0]).items():
            groups[c].add(n)
        rows = []
        for c, nodes in sorted(groups.items(), key=lambda x: str(x[0])):
            inner = {n: {m: w for m, w in graph[n].items() if m in nodes} for n in nodes}
            for gamma in ladder:
                fine = partition(inner, gamma)
                if len([n for n in pd.Series(fine).value_counts() if n > 1]) > 1:
                    break
            else:
                continue
            scores = _candidates(inner, fine)
            size = pd.Series(fine).value_counts()
            first, second = sorted(size.index, key=lambda p: (-size[p], str(p)))[:2]
            parts = [sorted((n for n in fine if fine[n] == p), key=str) for p in (first, second)]
            base = [apart(inner, g, *map(set, parts)) for g in ladder]
            own = list(zip(*((n, m, w) for n, near in inner.items() for m, w in near.items() if str(n) <= str(m)), strict=True)) or [(), (), ()]
            best = sorted((n for n in nodes if max(scores[n]) > 0), key=lambda n: (-sum(scores[n]), str(n)))[:nearest]
            rows += [(pdf[group].iloc[0], c, *map(list, own), *parts, base, n, *(round(x, 6) for x in scores[n])) for n in best]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in shape.split(", ")])

    found = ("split_probability", "baseline", "strength", "cut_share", "participation", "gamma_low", "gamma_high")

    def ablate(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rest = adjacency([e for e in zip(r.a, r.b, r.weight, strict=True) if r.node not in e[:2]])
                a, b = set(r.first) - {r.node}, set(r.second) - {r.node}
                if not a or not b:
                    continue
                base = dict(zip(ladder, r.baseline, strict=True))
                # where the parts always separate, nothing is left to gain
                gone = {g: apart(rest, g, a, b) if base[g] < 1 else base[g] for g in ladder}
                best = max(ladder, key=lambda g: (gone[g] - base[g], -g))  # noqa: B023
                moved = [g for g in ladder if gone[g] > base[g]] or [None]
                rows.append((getattr(r, group), r.community, r.node, gone[best], base[best], gone[best] - base[best], r.cut_share, r.participation, moved[0], moved[-1]))
            yield pd.DataFrame(rows, columns=[group, "community", "node", *found])

    listed = written(edges.groupBy(group).applyInPandas(candidates, shape), "candidates")
    tasks = listed.repartition(edges.sparkSession.sparkContext.defaultParallelism, group, "community", "node")
    return tasks.mapInPandas(ablate, f"{group} string, community string, node string, {', '.join(f'{c} double' for c in found)}")


def facade_split(edges: DataFrame, group: str, percentile: float = 99.0) -> DataFrame:
    """Edges in which each node of very high degree that couples communities is one facade for each of them.

    Such a node is joined to hundreds of others and glues their communities;
    a facade ``node@community`` keeps its edges into one of them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph = adjacency(list(pdf[["a", "b", "weight"]].itertuples(index=False, name=None)))
        degree = pd.Series({n: sum(near.values()) for n, near in graph.items()})
        large = set(degree[degree >= degree.quantile(percentile / 100)].index)
        rest = {n: {m: w for m, w in near.items() if m not in large} for n, near in graph.items() if n not in large}
        part = partition(rest) if rest else {}
        split = {n for n in large if len({part[m] for m in graph[n] if m in part}) > 1}
        facade = lambda n, other: f"{n}@{part[other]}" if n in split and other in part else n
        out = pdf.copy()
        out["a"], out["b"] = [facade(a, b) for a, b in zip(pdf.a, pdf.b, strict=True)], [facade(b, a) for a, b in zip(pdf.a, pdf.b, strict=True)]
        return out[[group, "a", "b", "weight"]]

    return edges.groupBy(group).applyInPandas(run, f"{group} string, a string, b string, weight double")


def community_of_symbol(members: DataFrame, symbol: str) -> DataFrame:
    """The community of a symbol: an exact member, else one whose short name it is, else one that holds it."""
    from lodestone.functions.names import short_symbol

    rank = F.when(F.col("member") == symbol, 0).when(short_symbol(F.col("member")) == symbol, 1).when(F.contains("member", F.lit(symbol)), 2)
    return members.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "community", "member").limit(1).drop("_rank")


def naming_prompts(named: DataFrame, directories: DataFrame, group: str) -> DataFrame:
    """(id, prompt) for a naming port: members and main directories of each community, which goes by its least member."""
    dirs = directories.groupBy(group, "community").agg(F.concat_ws(", ", F.sort_array(F.collect_list("directory"))).alias("dirs"))
    own = named.withColumn("community", F.array_min("members")).join(dirs, [group, "community"], "left")
    return own.select("id", F.concat(F.lit("Name this module in at most four words. Directories: "), F.coalesce("dirs", F.lit("")), F.lit(". Members: "), F.array_join(F.slice("members", 1, 20), ", ")).alias("prompt"))
