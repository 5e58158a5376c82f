"""Schema refinement: switches over node and undirected edge types, and what they compile to."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..graph import HinGraph
from ..operators.features import identity
from ..operators.propagate import slots


@dataclass(frozen=True)
class Selection:
    """Node types that get identity features, and edge types that go (each with its inverse)."""

    featured: frozenset[str] = frozenset()
    excluded: frozenset[str] = frozenset()

    @staticmethod
    def of(graph: HinGraph, switches: dict[str, bool]) -> Selection:
        """A node type's switch is on for features (off unless said), an edge type's or its inverse's is off to drop the pair."""
        meta = graph.meta
        featured, excluded = set(), set()
        names = {c.etype for c in meta.cetypes}
        for name, on in switches.items():
            if name in meta.ntypes:
                if on:
                    featured.add(name)
            elif name in names:
                if not on:
                    c = meta.canonical(name)
                    excluded |= {c.etype, *([meta.inverse[c].etype] if c in meta.inverse else [])}
            else:
                raise KeyError(f"{name} is no node or edge type")
        return Selection(frozenset(featured), frozenset(excluded))

    @staticmethod
    def of_point(graph: HinGraph, nodes: dict[str, int], edges: dict[str, int]) -> Selection:
        """A search point: for nodes 1 includes features, for edges 1 excludes the pair; no featured node type is an error."""
        if not any(nodes.values()):
            raise ValueError("a point needs one featured node type at least")
        return Selection.of(graph, {**{n: bool(v) for n, v in nodes.items()}, **{e: not v for e, v in edges.items()}})


def refined(graph: HinGraph, selection: Selection, max_hops: int = 99, reduce: str = "mean") -> tuple[HinGraph, dict[str, DataFrame]]:
    """Features propagate over all edges; then excluded edge types go, and node types that no longer reach the target."""
    own = {n: identity(graph.nodes[n], n) for n in sorted(selection.featured)}
    feats = slots(graph, own, max_hops, reduce) if own else {}
    if selection.excluded:
        graph = graph.without_etypes(sorted(selection.excluded))
    return graph, {n: f for n, f in feats.items() if n in graph.nodes}


def points(nodes: list[str], edges: list[str]) -> Iterator[tuple[dict[str, int], dict[str, int]]]:
    """Every search point with one featured node type at least."""
    for bits in itertools.product((0, 1), repeat=len(nodes) + len(edges)):
        n, e = dict(zip(nodes, bits)), dict(zip(edges, bits[len(nodes) :]))
        if any(n.values()):
            yield n, e


def sweep(graph: HinGraph, nodes: list[str], edges: list[str], score: Callable[[HinGraph, dict[str, DataFrame]], float], at_most: int) -> list[tuple[float, Selection]]:
    """The first ``at_most`` points scored, best first; a point whose schema is impossible is left out."""
    found = []
    for n, e in itertools.islice(points(nodes, edges), at_most):
        try:
            selection = Selection.of_point(graph, n, e)
            found.append((score(*refined(graph, selection)), selection))
        except (ValueError, NotImplementedError):
            continue
    return sorted(found, key=lambda x: -x[0])
