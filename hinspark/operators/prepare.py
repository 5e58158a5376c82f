"""Networks made ready for a model: types without features go, splits are put right, ids become global."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..graph import HinGraph, Tables
from ..types import CEType
from . import linalg


def without_featureless(graph: HinGraph, featured: Iterable[str], strict: bool = True) -> HinGraph:
    """Without the node types that aren't ``featured``, and without their edge types.

    Such a type may only have edges to itself; strict, one between it and a featured
    type is an error, else it goes too.  A target without features is an error.
    """
    keep = set(featured)
    if graph.target is not None and graph.target not in keep:
        raise ValueError(f"the target {graph.target} has no features")
    cut = [c for c in graph.edges if (c.src in keep) != (c.dst in keep)]
    if strict and cut:
        raise ValueError(f"edge types join featured and featureless node types: {cut}")
    edges = graph.edges.only(c for c in graph.edges if c.src in keep and c.dst in keep)
    return replace(
        graph,
        nodes=graph.nodes.only(n for n in graph.nodes if n in keep),
        edges=edges,
        inverse={a: b for a, b in graph.inverse.items() if a in edges and b in edges},
    )


def homogeneous_for(graph: HinGraph, featured: Iterable[str] | None = None, loops: str = "all", weights: str = "keep", order: Iterable[str] | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(gid, type, nid) and (src, dst, etype, weight) as a homogeneous model reads them.

    ``loops``: ``all`` node types get self loops, the ``target`` only, or ``none``.
    ``weights``: ``keep`` (missing ones count 1) or ``refuse``, an error if any edge
    type has them.
    """
    if loops not in ("all", "target", "none") or weights not in ("keep", "refuse"):
        raise ValueError(f"unknown choice: {loops}, {weights}")
    if featured is not None:
        graph = without_featureless(graph, featured, strict)
    if weights == "refuse":
        weighted = [c for c, e in graph.edges.items() if "weight" in e.columns]
        if weighted:
            raise ValueError(f"weighted edge types: {weighted}")
    if loops != "none":
        graph = graph.with_self_loops(None if loops == "all" else [graph.target])
    return graph.homogeneous(order)


def target_rows(graph: HinGraph, rows: DataFrame, order: Iterable[str] | None = None) -> DataFrame:
    """Rows of global ids (nid, ...) that are of the target, under its local ids."""
    order = list(order or graph.nodes)
    first = graph.offsets(order)
    at, after = first[graph.target], order.index(graph.target) + 1
    mine = F.col("nid") >= at
    if after < len(order):
        mine = mine & (F.col("nid") < first[order[after]])
    return rows.where(mine).withColumn("nid", F.col("nid") - at)


def united(*graphs: HinGraph) -> HinGraph:
    """All edges of graphs over the same nodes, with the edge types of any of them; a weight missing on one side is 1.

    Repeated edges stay: a multigraph's union.
    """
    edges = Tables({})
    inverse: dict[CEType, CEType] = {}
    for g in graphs:
        inverse |= g.inverse
        shared = {c: _appended(edges[c], g.edges[c]) for c in g.edges if c in edges}
        edges = edges | g.edges | shared
    return replace(graphs[0], edges=edges, inverse=inverse)


def _appended(a: DataFrame, b: DataFrame) -> DataFrame:
    if "weight" not in a.columns and "weight" not in b.columns:
        return a.select("src", "dst").unionByName(b.select("src", "dst"))
    full = lambda e: e.select("src", "dst", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight") if "weight" in e.columns else F.lit(1.0).alias("weight"))
    return full(a).unionByName(full(b))


def others_to_train(train: HinGraph, val: HinGraph, targets: Iterable[str | tuple]) -> tuple[HinGraph, HinGraph]:
    """Validation edges of all but the target edge types go back to training; a target's inverse is in neither's validation."""
    meta = val.meta
    wanted = {meta.canonical(t) for t in targets}
    held = wanted | {meta.inverse[t] for t in wanted if t in meta.inverse}
    back = replace(val, edges=val.edges.only(c for c in val.edges if c not in held))
    return united(train, back), replace(val, edges=val.edges.only(c for c in val.edges if c in wanted), inverse={})


def with_identity(pattern: DataFrame, nodes: DataFrame) -> DataFrame:
    """An adjacency (dst, src, w) made binary, with a loop at every node (nid), rows normalised."""
    loops = nodes.select(F.col("nid").alias("dst"), F.col("nid").alias("src"))
    both = pattern.where("w <> 0").select("dst", "src").union(loops).distinct()
    return linalg.row_normalized(both.withColumn("w", F.lit(1.0)))


def polynomial_inputs(graph: HinGraph, feats: Mapping[str, DataFrame], binary: Iterable[str] = (), order: Iterable[str] | None = None) -> tuple[DataFrame, dict[str, int], dict[CEType, DataFrame]]:
    """What a polynomial of metapaths reads: (nid, slot, col, val) under global ids, the width of each type's block, and adjacencies under global ids.

    Every type keeps its place: one without features has a single column of zeros, so
    its block is one wide and the ids after it hold.  Adjacencies are normalised by row
    within their type; those named ``binary`` are made binary over all nodes of the
    network, with a loop at each, and normalised again.
    """
    order = list(order or graph.nodes)
    first = graph.offsets(order)
    widths, parts = {}, []
    for n in order:
        known = feats.get(n)
        width = known.agg(F.max("col") + 1).first()[0] if known is not None else None
        widths[n] = width or 1
        if width:
            parts.append(known.select((F.col("nid") + first[n]).alias("nid"), "slot", "col", "val"))
    if not parts:
        raise ValueError("no type has features")
    every = functools.reduce(DataFrame.unionByName, [graph.nodes[n].select((F.col("nid") + first[n]).alias("nid")) for n in order])
    adjs, binary = {}, set(binary)
    for c in graph.edges:
        local = linalg.row_normalized(linalg.adjacency(graph.edges[c]))
        moved = local.select((F.col("dst") + first[c.dst]).alias("dst"), (F.col("src") + first[c.src]).alias("src"), "w")
        adjs[c] = with_identity(moved, every) if c.etype in binary else moved
    return functools.reduce(DataFrame.unionByName, parts), widths, adjs
