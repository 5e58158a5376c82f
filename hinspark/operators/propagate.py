"""Feature propagation: slots over the type graph, and features and labels along metapaths."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..graph import HinGraph
from ..scratch import dropped, written
from ..types import CEType, Metapath, in_prefix_order, self_loop
from . import linalg


def slots(graph: HinGraph, feats: dict[str, DataFrame], max_hops: int = 99, reduce: str = "mean", message: Callable | None = None) -> dict[str, DataFrame]:
    """Each node type's features from every featured type, one slot for each.

    For each featured type, hop by hop, every edge type out of a filled type fills
    one that isn't yet.  The hops are planned on names alone.
    """
    out: dict[str, list[DataFrame]] = {n: [] for n in graph.nodes}
    for source, own in feats.items():
        reached = {source: own.withColumn("slot", F.lit(source))}
        for step in graph.meta.hops(source, max_hops):
            before = dict(reached)
            for c in step:
                sent = linalg.messages(graph.edges[c], before[c.src], message)
                reached[c.dst] = linalg.REDUCERS[reduce](sent, graph.edges[c])
        for n, df in reached.items():
            out[n].append(df.select("nid", "slot", "col", "val"))
    merged = {}
    for n, parts in out.items():
        if parts:
            merged[n] = parts[0]
            for p in parts[1:]:
                merged[n] = merged[n].unionByName(p)
    return merged


def along(graph: HinGraph, feats: DataFrame, path: list[str | tuple], reduce: str = "sum") -> DataFrame:
    """Features sent along one metapath, reduced after each edge; edges must follow each other."""
    steps = [graph.meta.canonical(p) for p in path]
    for a, b in zip(steps, steps[1:]):
        if a.dst != b.src:
            raise ValueError(f"{b} doesn't follow {a}")
    for c in steps:
        feats = linalg.REDUCERS[reduce](linalg.messages(graph.edges[c], feats), graph.edges[c]).select("nid", "slot", "col", "val")
    return feats


class MetapathFeatures:
    """A_k … A_1 X of many metapaths: products share their common prefixes, features first.

    The prefix tree is built from names.  A prefix that several metapaths go on from,
    or that is asked for itself too, is written once, so no product is made twice and
    lost executors cost none; :meth:`free` deletes what was written.  Features always
    multiply first, so nothing wider than features is ever made.
    """

    def __init__(self, adjs: dict[CEType, DataFrame], feats: dict[str, DataFrame | None], persist: bool = True):
        self.adjs, self.feats, self.persist = adjs, feats, persist
        self.known: dict[Metapath, DataFrame] = {}
        self.held: list[DataFrame] = []

    def build(self, paths: list[Metapath]) -> dict[Metapath, DataFrame]:
        trimmed = {p: tuple(c for c in p if not c.is_self_loop) for p in paths}
        prefixes = [t[:k] for t in set(trimmed.values()) for k in range(1, len(t))]
        branching = {}
        for t in {*trimmed.values(), *prefixes}:
            if len(t) > 1:
                branching.setdefault(t[:-1], set()).add(t)
        asked = set(trimmed.values())
        self.shared = {t for t, nexts in branching.items() if len(nexts) + (t in asked) > 1}
        return {p: self._product(p[0].src, trimmed[p]) for p in in_prefix_order(paths)}

    def _product(self, source: str, path: Metapath) -> DataFrame:
        if not path:
            return self.feats[source]
        if path not in self.known:
            x = self._product(source, path[:-1])
            adj = self.adjs[path[-1]]
            if x is None:  # no features: the product of adjacencies itself
                made = adj
            elif "slot" in x.columns:
                made = linalg.apply(*linalg.by_source(adj, x))
            else:
                made = linalg.compose(adj, x)
            if self.persist and path in self.shared:
                made = written(made, "prefix")
                self.held.append(made)
            self.known[path] = made
        return self.known[path]

    def free(self) -> None:
        while self.held:
            dropped(self.held.pop())


def walk_counts(graph: HinGraph, paths: list[Metapath]) -> dict[Metapath, DataFrame]:
    """Of each metapath one row ``n``, its instances: ones sent along the bare edges and added up; prefixes are shared."""
    begun = {p: p if p[0].is_self_loop else (self_loop(p[0].src), *p) for p in paths}
    used = {c for p in paths for c in p if not c.is_self_loop}
    bare = {c: graph.edges[c].select("dst", "src").distinct().withColumn("w", F.lit(1).cast("long")) for c in used}
    ones = {p[0].src: graph.nodes[p[0].src].select("nid", F.lit("one").alias("slot"), F.lit(0).alias("col"), F.lit(1).cast("long").alias("val")) for p in paths}
    made = MetapathFeatures(bare, ones).build(list(begun.values()))
    return {p: made[q].agg(F.coalesce(F.sum("val"), F.lit(0)).alias("n")) for p, q in begun.items()}


def metapath_adjacency(adjs: dict[CEType, DataFrame], path: Metapath, widths: dict[str, int] | None = None) -> DataFrame:
    """Product of a metapath's adjacencies.

    With node counts, a chain is split at its narrowest inner type when that is
    narrower than both ends: prefix and suffix are multiplied apart and joined last.
    """
    steps = [c for c in path if not c.is_self_loop]
    if widths and len(steps) > 2:
        inner = [(widths[c.dst], i + 1) for i, c in enumerate(steps[:-1])]
        least, at = min(inner)
        if least < min(widths[steps[0].src], widths[steps[-1].dst]) and 1 < at < len(steps) - 1:
            return linalg.compose(metapath_adjacency(adjs, tuple(steps[at:])), metapath_adjacency(adjs, tuple(steps[:at])))
    now = adjs[steps[0]]
    for c in steps[1:]:
        now = linalg.compose(adjs[c], now)
    return now


def metapath_diagonal(adjs: dict[CEType, DataFrame], path: Metapath) -> DataFrame:
    """The diagonal of a closed metapath's product, without the product."""
    steps = [c for c in path if not c.is_self_loop]
    if steps[0].src != steps[-1].dst or len(steps) < 2:
        raise ValueError("a diagonal needs a closed metapath of two edges at least")
    return linalg.diagonal_of_product(adjs[steps[-1]], metapath_adjacency(adjs, tuple(steps[:-1])))


def training_labels(nodes: DataFrame) -> DataFrame:
    """One-hot labels of the training nodes only; an error if they are all the labelled nodes."""
    labelled = nodes.where("label is not null and split is not null")
    n, train = labelled.agg(F.count("*"), F.count_if(F.col("split") == "train")).first()
    if train >= n:
        raise ValueError("training nodes must be a part of the labelled ones")
    return labelled.where("split = 'train'").select("nid", F.lit("label").alias("slot"), F.col("label").cast("int").alias("col"), F.lit(1.0).alias("val"))


def label_features(adjs: dict[CEType, DataFrame], path: Metapath, labels: DataFrame) -> DataFrame:
    """A·Y − diag(A)·Y over a closed metapath of two edges at least: no node sees its own label.

    The product A is never made: labels go along the metapath edge by edge, and what
    comes back to its own node is taken off by the diagonal.  Paths are counted
    beside the weights, so a cell that only its own node's paths reach is left out.
    What has come to a node between is written: its size is then known, and where few
    nodes gather many labels they go to the edges, not all edges to their tasks.
    """
    steps = [c for c in path if not c.is_self_loop]
    if len(steps) < 2 or steps[0].src != steps[-1].dst:
        raise ValueError("labels go along closed metapaths of two edges at least")
    one = F.lit(1).cast("long").alias("n")
    reached = labels.select("nid", "slot", "col", "val", one)
    for i, c in enumerate(steps):
        joined = adjs[c].join(reached, F.col("src") == F.col("nid"))
        reached = joined.groupBy(F.col("dst").alias("nid"), "slot", "col").agg(F.sum(F.col("w") * F.col("val")).alias("val"), F.sum("n").alias("n"))
        if i < len(steps) - 1:
            reached = written(reached, "reached")
    # paths from labelled nodes up to the last edge, which must lead back
    ahead = adjs[steps[0]].join(labels.select(F.col("nid").alias("src")).distinct(), "src", "left_semi").select("dst", "src", "w", one)
    for c in steps[1:-1]:
        mid = ahead.select(F.col("dst").alias("mid"), F.col("src").alias("start"), F.col("w").alias("w1"), "n")
        ahead = adjs[c].join(mid, F.col("src") == F.col("mid")).groupBy("dst", F.col("start").alias("src")).agg(F.sum(F.col("w") * F.col("w1")).alias("w"), F.sum("n").alias("n"))
    back = adjs[steps[-1]].select(F.col("dst").alias("nid"), F.col("src").alias("mid"), F.col("w").alias("w2"))
    back = back.join(ahead.select(F.col("dst").alias("mid"), F.col("src").alias("nid"), "w", "n"), ["nid", "mid"])
    back = back.groupBy("nid").agg(F.sum(F.col("w2") * F.col("w")).alias("w"), F.sum("n").alias("own_n"))
    own = labels.join(back, "nid").select("nid", "slot", "col", (F.col("w") * F.col("val")).alias("own"), "own_n")
    both = reached.join(own, ["nid", "slot", "col"], "left").where("own_n is null or n > own_n")
    return both.select("nid", "slot", "col", (F.col("val") - F.coalesce("own", F.lit(0.0))).alias("val"))


def metapath_pattern(graph: HinGraph, paths: list[list[str | tuple]]) -> DataFrame:
    """Distinct (dst, src) joined by any of the metapaths."""
    out = None
    for path in paths:
        steps = [graph.meta.canonical(p) for p in path]
        now = linalg.pattern(linalg.adjacency(graph.edges[steps[0]]))
        for c in steps[1:]:
            step = graph.edges[c].select(F.col("src").alias("mid"), "dst").distinct()
            now = linalg.joined_pairs(now.select("src", F.col("dst").alias("mid")), step).select("dst", "src")
        out = now if out is None else out.union(now)
    return out if len(paths) == 1 else out.distinct()


def rows_along(graph: HinGraph, feats: DataFrame, path: Metapath, wanted: DataFrame, normalize: bool = True) -> DataFrame:
    """A_k … A_1 X at the wanted nodes (nid) of the metapath's end only.

    The wanted rows are sent back through the chain first, a semi-join for each edge
    type: what doesn't lead to them is neither normalised nor multiplied.  Weights are
    normalised over whole rows, as a kept row keeps all of its edges.
    """
    steps, rows = [], wanted.select("nid").distinct()
    for c in reversed([c for c in path if not c.is_self_loop]):
        edges = graph.edges[c].join(rows.withColumnRenamed("nid", "dst"), "dst", "left_semi")
        adj = linalg.adjacency(edges)
        steps.insert(0, linalg.row_normalized(adj) if normalize else adj)
        rows = edges.select(F.col("src").alias("nid")).distinct()
    out = feats.join(rows, "nid", "left_semi")
    for adj in steps:
        out = linalg.apply(adj, out)
    return out.select("nid", "slot", "col", "val")


@dataclass(frozen=True)
class MetapathDataset:
    """Features of the nodes of one type by many metapaths, as rows that are made when they are asked for.

    ``feats`` are the features of each metapath's first type; where they have several
    slots, as those of :func:`slots` do, a metapath has a block for each of them.
    """

    graph: HinGraph
    feats: Mapping[str, DataFrame]
    paths: Mapping[str, Metapath]
    normalize: bool = True

    def __post_init__(self):
        ends = {p[-1].dst for p in self.paths.values()}
        if len(ends) != 1:
            raise ValueError(f"metapaths end at {len(ends)} node types")

    def rows(self, wanted: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
        """(mp, nid, slot, col, val) of the wanted nodes, by the asked metapaths; nothing else is multiplied."""
        names = list(self.paths) if names is None else list(names)
        parts = [rows_along(self.graph, self.feats[self.paths[n][0].src], self.paths[n], wanted, self.normalize).select(F.lit(n).alias("mp"), "nid", "slot", F.col("col").cast("long").alias("col"), "val") for n in names]
        return functools.reduce(DataFrame.unionByName, parts)

    def all(self) -> DataFrame:
        """(mp, nid, slot, col, val) of every node, products sharing their prefixes."""
        used = {c for p in self.paths.values() for c in p if not c.is_self_loop}
        adjs = {c: linalg.adjacency(self.graph.edges[c]) for c in used}
        if self.normalize:
            adjs = {c: linalg.row_normalized(a) for c, a in adjs.items()}
        made = MetapathFeatures(adjs, dict(self.feats)).build(list(self.paths.values()))
        parts = [made[p].select(F.lit(n).alias("mp"), "nid", "slot", F.col("col").cast("long").alias("col"), "val") for n, p in self.paths.items()]
        return functools.reduce(DataFrame.unionByName, parts)


def polynomial_along(adjs: Mapping[CEType, DataFrame], feats: Mapping[str, DataFrame], coefficients: Mapping[Metapath, float]) -> dict[str, DataFrame]:
    """By end type, the sum over metapaths of coefficient · A_k … A_1 X, of (nid, slot, col, val).

    Metapaths (without self loops) form a prefix tree, of which every edge is
    multiplied once: a prefix's product is written, and both summed and gone on from.
    """
    parts: dict[str, list[DataFrame]] = {}

    def walk(path: Metapath, x: DataFrame) -> None:
        if path in coefficients:
            parts.setdefault(path[-1].dst, []).append(x.withColumn("val", F.col("val") * coefficients[path]))
        for c in sorted({p[len(path)] for p in coefficients if p[: len(path)] == path and len(p) > len(path)}):
            more = sum(p[: len(path) + 1] == (*path, c) for p in coefficients) > 1
            made = linalg.apply(adjs[c], x)
            walk((*path, c), written(made, "product") if more else made)

    starts = {p[0].src for p in coefficients}
    for source in sorted(starts):
        for c in sorted({p[0] for p in coefficients if p[0].src == source}):
            made = linalg.apply(adjs[c], feats[source].select("nid", "slot", "col", "val"))
            walk((c,), written(made, "product") if sum(p[0] == c for p in coefficients) > 1 else made)
    return {n: _added(found) for n, found in parts.items()}


def polynomial_back(adjs: Mapping[CEType, DataFrame], ends: Mapping[str, DataFrame], coefficients: Mapping[Metapath, float]) -> dict[str, DataFrame]:
    """By start type, the sum over metapaths of coefficient · (A_k … A_1)ᵀ Y, Y by end type: the other half of the polynomial.

    The same prefix tree from its leaves: what comes back along an edge is its end's
    Y times the coefficient of the path so far plus all that came back further on, so
    again every edge of the tree is multiplied once.
    """
    turned = {c: a.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "w") for c, a in adjs.items()}

    def back(path: Metapath) -> list[DataFrame]:
        own = [ends[path[-1].dst].select("nid", "slot", "col", (F.col("val") * coefficients[path]).alias("val"))] if path in coefficients else []
        nexts = sorted({p[len(path)] for p in coefficients if p[: len(path)] == path and len(p) > len(path)})
        return own + [linalg.apply(turned[c], _added(back((*path, c)))) for c in nexts]

    out: dict[str, list[DataFrame]] = {}
    for c in sorted({p[0] for p in coefficients}):
        out.setdefault(c.src, []).append(linalg.apply(turned[c], _added(back((c,)))))
    return {n: _added(found) for n, found in out.items()}


def _added(parts: list[DataFrame]) -> DataFrame:
    if len(parts) == 1:
        return parts[0].select("nid", "slot", "col", "val")
    return functools.reduce(DataFrame.unionByName, [p.select("nid", "slot", "col", "val") for p in parts]).groupBy("nid", "slot", "col").agg(F.sum("val").alias("val"))
