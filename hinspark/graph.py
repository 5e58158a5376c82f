"""A heterogeneous network as DataFrames: one for each node type and one for each edge type."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Hashable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from .types import CEType, MetaGraph, self_loop


class Tables(Mapping):
    """DataFrames by name; one given as a function is made when it is first asked for, once for all mappings that share it."""

    def __init__(self, tables: Mapping[Hashable, DataFrame | Callable[[], DataFrame]]):
        given = tables._given if isinstance(tables, Tables) else tables
        self._given = {k: functools.cache(v) if callable(v) else v for k, v in given.items()}

    def __getitem__(self, name) -> DataFrame:
        table = self._given[name]
        return table() if callable(table) else table

    def __iter__(self) -> Iterator:
        return iter(self._given)

    def __len__(self) -> int:
        return len(self._given)

    def __contains__(self, name) -> bool:
        return name in self._given

    def __or__(self, more: Mapping) -> Tables:
        return Tables({**self._given, **(more._given if isinstance(more, Tables) else more)})

    def only(self, names: Iterable) -> Tables:
        return Tables({n: self._given[n] for n in names})


@dataclass(frozen=True)
class HinGraph:
    """Nodes have ``nid`` (and what else they carry), edges ``src``, ``dst`` and perhaps ``weight``; null weight is 1.

    A value: operators return another graph and share the DataFrames they don't
    change.  Tables may be given as functions: what a query doesn't touch is never
    read, and no ids of it are written.
    """

    nodes: Mapping[str, DataFrame]
    edges: Mapping[CEType, DataFrame]
    inverse: dict[CEType, CEType] = field(default_factory=dict)
    target: str | None = None

    def __post_init__(self):
        for name in ("nodes", "edges"):
            object.__setattr__(self, name, Tables(getattr(self, name)))

    @property
    def meta(self) -> MetaGraph:
        return MetaGraph(tuple(self.nodes), tuple(self.edges), dict(self.inverse))

    def edge(self, name: str | tuple) -> DataFrame:
        return self.edges[self.meta.canonical(name)]

    def labelled(self, split: str | None = None) -> DataFrame:
        """Target nodes of a split, or of all splits."""
        nodes = self.nodes[self.target]
        return nodes.where(F.col("split").isNotNull() if split is None else F.col("split") == split)

    def of_meta(self, meta: MetaGraph) -> HinGraph:
        """The part of the graph that a reduced meta graph names."""
        return replace(self, nodes=self.nodes.only(meta.ntypes), edges=self.edges.only(meta.cetypes), inverse=dict(meta.inverse))

    def without_etypes(self, etypes: Iterable[str | tuple], unreachable: str = "full") -> HinGraph:
        """Without edge types; then, unless ``none``, without the node types that no longer reach the target."""
        meta = self.meta.without(etypes)
        return self.of_meta(meta.pruned(self.target) if unreachable == "full" and self.target else meta)

    def merged(self, keep: str | tuple, drop: str | tuple) -> HinGraph:
        """The distinct union of two edge types of the same ends, under the first's name; weighted ones are refused."""
        a, b = self.meta.canonical(keep), self.meta.canonical(drop)
        if (a.src, a.dst) != (b.src, b.dst):
            raise ValueError(f"{a} and {b} join different node types")
        if any("weight" in self.edges[c].columns for c in (a, b)):
            raise ValueError("weighted edge types can't be merged")
        both = self.edges[a].select("src", "dst").union(self.edges[b].select("src", "dst")).distinct()
        return replace(self, edges=self.edges.only(c for c in self.edges if c != b) | {a: both}, inverse={x: y for x, y in self.inverse.items() if b not in (x, y)})

    def symmetric(self) -> HinGraph:
        """Edge types between one node type merged with their inverses, whose direction then counts no more."""
        graph = self
        for a, b in self.meta.undirected():
            if b and b != a and a.src == a.dst:
                graph = graph.merged(a, b)
        return graph

    def with_inverses(self, suffix: str = "-inv") -> HinGraph:
        """An inverse for each edge type that has none."""
        more, inverse = {}, dict(self.inverse)
        for c in self.edges:
            if c not in inverse:
                back = CEType(c.dst, c.etype + suffix, c.src)
                more[back] = functools.partial(lambda c: reversed_edges(self.edges[c]), c)
                inverse |= {c: back, back: c}
        return replace(self, edges=self.edges | more, inverse=inverse)

    def with_self_loops(self, ntypes: Iterable[str] | None = None) -> HinGraph:
        made = lambda n: self.nodes[n].select(F.col("nid").alias("src"), F.col("nid").alias("dst"))
        return replace(self, edges=self.edges | {self_loop(n): functools.partial(made, n) for n in (self.nodes if ntypes is None else ntypes)})

    def node_counts(self) -> DataFrame:
        """(kind, name, n) of each node type, in one plan; edges aren't touched."""
        parts = [df.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.lit(name).alias("name"), "n") for name, df in self.nodes.items()]
        return functools.reduce(DataFrame.unionByName, parts)

    def counts(self) -> DataFrame:
        """(kind, name, n) of each node and edge type, in one plan."""
        parts = [df.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.lit(c.etype).alias("name"), "n") for c, df in self.edges.items()]
        return functools.reduce(DataFrame.unionByName, parts, self.node_counts())

    def offsets(self, order: Iterable[str]) -> dict[str, int]:
        """First global id of each type: types follow each other, each as wide as its largest id."""
        order = list(order)
        sizes = {n: self.nodes[n].agg(F.coalesce(F.max("nid") + 1, F.lit(0))).first()[0] for n in order}
        out, at = {}, 0
        for n in order:
            out[n], at = at, at + sizes[n]
        return out

    def homogeneous(self, order: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(gid, type, nid) and (src, dst, etype, weight) over all types; ids are local ids plus the type's offset."""
        order = list(order or self.nodes)
        first = self.offsets(order)
        nodes = edges = None
        for i, n in enumerate(order):
            part = self.nodes[n].select((F.col("nid") + first[n]).alias("gid"), F.lit(i).alias("type"), "nid")
            nodes = part if nodes is None else nodes.unionByName(part)
        for i, (c, e) in enumerate(self.edges.items()):
            weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in e.columns else F.lit(1.0)
            part = e.select((F.col("src") + first[c.src]).alias("src"), (F.col("dst") + first[c.dst]).alias("dst"), F.lit(i).alias("etype"), weight.alias("weight"))
            edges = part if edges is None else edges.unionByName(part)
        return nodes, edges

    def save(self, path: str) -> None:
        """A folder of Parquet tables, one for each type, and schema.json; edges are sorted by destination for row lookups."""
        spark = next(iter(self.nodes.values())).sparkSession
        for n, df in self.nodes.items():
            df.write.mode("overwrite").parquet(f"{path}/node={n}")
        for i, df in enumerate(self.edges.values()):
            df.repartitionByRange("dst").sortWithinPartitions("dst").write.mode("overwrite").parquet(f"{path}/edge={i}")
        known = {"nodes": list(self.nodes), "edges": [list(c) for c in self.edges], "inverse": [[list(a), list(b)] for a, b in self.inverse.items()], "target": self.target}
        spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema.json")

    @staticmethod
    def load(spark: SparkSession, path: str) -> HinGraph:
        known = json.loads(spark.read.text(f"{path}/schema.json").first()[0])
        etypes = [CEType(*c) for c in known["edges"]]
        return HinGraph(
            {n: spark.read.parquet(f"{path}/node={n}") for n in known["nodes"]},
            {c: spark.read.parquet(f"{path}/edge={i}") for i, c in enumerate(etypes)},
            {CEType(*a): CEType(*b) for a, b in known["inverse"]},
            known["target"],
        )


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def is_identity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: whether the edges are exactly one loop at every node."""
    loops = edges.agg(F.count("*").alias("n"), F.countDistinct("src").alias("d"), F.bool_and(F.col("src") == F.col("dst")).alias("all_loops"))
    return loops.crossJoin(nodes.agg(F.count("*").alias("nodes"))).select((F.coalesce("all_loops", F.lit(True)) & (F.col("n") == F.col("nodes")) & (F.col("d") == F.col("nodes"))).alias("identity"))
