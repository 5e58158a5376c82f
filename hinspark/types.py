"""Types of a heterogeneous network: node types, canonical edge types, and the graph they form.

Everything here is plain Python over a handful of names; no data is touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple


class CEType(NamedTuple):
    """A canonical edge type; edges run from ``src`` to ``dst``."""

    src: str
    etype: str
    dst: str

    @property
    def is_self_loop(self) -> bool:
        return self.src == self.dst and self.etype == f"{self.src}-self"


def self_loop(ntype: str) -> CEType:
    """The identity edge type of a node type; symbolic, never materialised by the planner."""
    return CEType(ntype, f"{ntype}-self", ntype)


Metapath = tuple[CEType, ...]


@dataclass(frozen=True)
class MetaGraph:
    """Node types, edge types, and which edge type is whose inverse."""

    ntypes: tuple[str, ...]
    cetypes: tuple[CEType, ...]
    inverse: dict[CEType, CEType] = field(default_factory=dict)

    def __post_init__(self):
        known = set(self.ntypes)
        for c in self.cetypes:
            if c.src not in known or c.dst not in known:
                raise ValueError(f"{c} has an unknown node type")

    def canonical(self, name: str | tuple) -> CEType:
        """The canonical type of a name, which must be unambiguous, or of a triple."""
        if not isinstance(name, str):
            found = [c for c in self.cetypes if c == tuple(name)]
        else:
            found = [c for c in self.cetypes if c.etype == name]
        if len(found) != 1:
            raise KeyError(f"{name} names {len(found)} edge types")
        return found[0]

    def without(self, etypes: Iterable[str | tuple]) -> MetaGraph:
        gone = {self.canonical(e) for e in etypes}
        left = tuple(c for c in self.cetypes if c not in gone)
        if not left:
            raise ValueError("no edge type would be left")
        return MetaGraph(self.ntypes, left, {a: b for a, b in self.inverse.items() if a in left and b in left})

    def with_self_loops(self, ntypes: Iterable[str] | None = None) -> MetaGraph:
        more = tuple(self_loop(n) for n in (self.ntypes if ntypes is None else ntypes))
        return MetaGraph(self.ntypes, self.cetypes + tuple(c for c in more if c not in self.cetypes), dict(self.inverse))

    def reaching(self, target: str) -> set[str]:
        """Node types from which edges lead to the target, itself included."""
        found, edge = {target}, [target]
        while edge:
            now = edge.pop()
            for c in self.cetypes:
                if c.dst == now and c.src not in found:
                    found.add(c.src)
                    edge.append(c.src)
        return found

    def pruned(self, target: str) -> MetaGraph:
        """Without the node types that can't reach the target, and their edge types."""
        keep = self.reaching(target)
        left = tuple(c for c in self.cetypes if c.src in keep and c.dst in keep)
        return MetaGraph(tuple(n for n in self.ntypes if n in keep), left, {a: b for a, b in self.inverse.items() if a in left and b in left})

    def undirected(self) -> list[tuple[CEType, CEType | None]]:
        """Edge types paired with their inverses, each pair once."""
        seen, pairs = set(), []
        for c in self.cetypes:
            if c not in seen:
                other = self.inverse.get(c)
                pairs.append((c, other))
                seen |= {c, other}
        return pairs

    def hops(self, source: str, max_hops: int) -> list[list[CEType]]:
        """Which edge types first fill a node type, hop by hop, from one source type.

        A type that is filled in a hop feeds others from the next hop on.  Two edge
        types that fill one type in the same hop are an error: how to combine them
        isn't defined.
        """
        filled, plan = {source}, []
        for _ in range(max_hops):
            step = [c for c in self.cetypes if c.src in filled and c.dst not in filled]
            if not step:
                break
            reached = [c.dst for c in step]
            if len(set(reached)) < len(reached):
                raise NotImplementedError(f"several edge types reach one node type at once: {step}")
            plan.append(step)
            filled |= set(reached)
        return plan

    def metapaths(self, max_hops: int, target: str | None = None) -> list[Metapath]:
        """All walks of at most max_hops edges, each begun by its source's self loop; those to the target only, if given."""
        layer: list[Metapath] = [(self_loop(n),) for n in self.ntypes]
        found = list(layer)
        for _ in range(max_hops):
            layer = [(*walk, c) for walk in layer for c in self.cetypes if c.src == walk[-1].dst and not c.is_self_loop]
            found += layer
        return [w for w in found if target is None or w[-1].dst == target]

    def simple_metapaths(self, target: str, max_hops: int) -> list[Metapath]:
        """Closed walks from the target that use an edge type once at most; of those through the same node types the last."""
        found: dict[tuple[str, ...], Metapath] = {}

        def walk(path: Metapath) -> Iterator[Metapath]:
            if path and path[-1].dst == target:
                yield path
            if len(path) < max_hops:
                here = path[-1].dst if path else target
                for c in self.cetypes:
                    if c.src == here and c not in path:
                        yield from walk((*path, c))

        for path in walk(()):
            found[(target, *(c.dst for c in path))] = path
        return list(found.values())

    def extensions(self, max_hops: int) -> list[tuple[str, int, int]]:
        """(edge type, walk, walk it extends to) over the walks of :meth:`metapaths`, by number."""
        walks = {w: i for i, w in enumerate(self.metapaths(max_hops))}
        return [(w[-1].etype, walks[w[:-1]], i) for w, i in walks.items() if len(w) > 1]


def expansions(cetypes: Iterable[CEType], max_hops: int) -> list[Metapath]:
    """All walks of one to max_hops edge types, shorter ones first, without self loops."""
    layer: list[Metapath] = [(c,) for c in cetypes if not c.is_self_loop]
    found = list(layer)
    for _ in range(max_hops - 1):
        layer = [(*walk, c) for walk in layer for c in cetypes if c.src == walk[-1].dst and not c.is_self_loop]
        found += layer
    return found


def transposed(path: Metapath, inverse: dict[CEType, CEType]) -> Metapath:
    """The walk back: each edge type's inverse, the last first."""
    return tuple(inverse[c] for c in reversed(path))


def coded(path: Metapath, codes: dict[CEType, str]) -> str:
    """A walk as the codes of its edge types, two letters each, one after the other."""
    return "".join(codes[c] for c in path)


class Aliases:
    """Short names of metapaths: the shortest unique capitalised prefix of each node type, the last type first."""

    def __init__(self, meta: MetaGraph):
        self.meta, self.of = meta, {}
        for n in meta.ntypes:
            for k in range(1, len(n) + 1):
                short = n[:k].capitalize()
                if not any(m != n and m[:k].capitalize() == short for m in meta.ntypes):
                    break
            self.of[n] = short
        self.back = {a: n for n, a in self.of.items()}
        if len(self.back) < len(self.of):
            raise ValueError("two node types share every prefix")

    def short(self, path: Metapath) -> str:
        steps = [c for c in path if not c.is_self_loop]
        types = [path[0].src, *(c.dst for c in steps)]
        return "".join(self.of[n] for n in reversed(types))

    def canonical(self, short: str) -> Metapath:
        """The walk of a short name; each pair of node types must have one edge type."""
        names, at = [], 0
        while at < len(short):
            end = at + 1
            while end < len(short) and not short[end].isupper():
                end += 1
            names.append(self.back[short[at:end]])
            at = end
        names.reverse()
        path: list[CEType] = [self_loop(names[0])]
        for a, b in zip(names, names[1:]):
            found = [c for c in self.meta.cetypes if (c.src, c.dst) == (a, b) and not c.is_self_loop]
            if len(found) != 1:
                raise KeyError(f"{len(found)} edge types run from {a} to {b}")
            path.append(found[0])
        return tuple(path)


def in_prefix_order(paths: Iterable[Metapath], depth_first: bool = True) -> list[Metapath]:
    """Walks sorted so that those with a common prefix are neighbours, or by length and then so."""
    paths = list(paths)
    return sorted(paths, key=(lambda p: p) if depth_first else (lambda p: (len(p), p)))
