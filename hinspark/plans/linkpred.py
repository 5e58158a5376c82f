"""Link prediction: a network to learn from, links to tell from others, and where the others come from."""

from __future__ import annotations

import functools
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from ..graph import HinGraph, reversed_edges
from ..operators import prepare, sample
from ..scratch import written
from ..types import CEType

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class LinkTask:
    """``graph`` has the training links of ``target`` and their inverse; ``positives`` the links of each split, ``static`` given other pairs.

    Positives and other pairs are (src, dst) under the ids of the target's two node types.
    """

    graph: HinGraph
    target: CEType
    positives: Mapping[str, DataFrame]
    static: Mapping[str, DataFrame] = field(default_factory=dict)

    @staticmethod
    def of(graph: HinGraph, target: str | tuple, train_share: float = 0.9, seed: int = 0) -> LinkTask:
        """One edge type's links split: the first tail of each head is for training, of the others about train_share."""
        c = graph.meta.canonical(target)
        links = written(sample.split_links(graph.edges[c].select("src", "dst").distinct(), train_share, seed), "links")
        positives = {s: links.where(F.col("split") == s).select("src", "dst") for s in ("train", "val")}
        return LinkTask(_with_links(graph, c, positives["train"]), c, positives)

    def folds(self, k: int, seed: int = 0) -> DataFrame:
        """(src, dst, fold): training and validation links in k even folds; tests' links are in none."""
        links = functools.reduce(DataFrame.unionByName, [self.positives[s].select("src", "dst") for s in ("train", "val") if s in self.positives]).distinct()
        keyed = links.withColumn("link", F.struct("src", "dst"))
        return sample.k_folds(keyed, k, None, "link", seed).select("src", "dst", "fold")

    def held(self, folds: DataFrame, fold: int) -> LinkTask:
        """The task with one fold for validation and the others for training; inverse edges follow."""
        placed = written(folds, "folds")
        positives = {**self.positives, "train": placed.where(F.col("fold") != fold).select("src", "dst"), "val": placed.where(F.col("fold") == fold).select("src", "dst")}
        return replace(self, graph=_with_links(self.graph, self.target, positives["train"]), positives=positives)

    def known(self, split: str) -> HinGraph:
        """The network with the links of all splits up to this one, both ways."""
        more = [_with_links(replace(self.graph, edges={}, inverse=self.graph.inverse), self.target, self.positives[s]) for s in SPLITS[1 : SPLITS.index(split) + 1] if s in self.positives]
        return prepare.united(self.graph, *more)

    def two_hop_pairs(self, split: str, seed: int = 0) -> DataFrame:
        """(src, dst, y): the split's links, and for each head as many draws from the tails two undirected links away.

        Links of every split count as links; draws are with replacement, and a head
        without candidates has none.
        """
        everything = self.known(SPLITS[-1])
        order = sorted(everything.nodes)
        first, positives = everything.offsets(order), self.positives[split]
        low, tail = first[self.target.src], self.target.dst
        at = order.index(tail) + 1
        ends = (first[tail], first[order[at]] if at < len(order) else (1 << 63) - 1)
        one_way = {}  # links are undirected here: of two inverse edge types one will do
        for c in everything.edges:
            if everything.inverse.get(c) not in one_way:
                one_way[c] = None
        links = replace(everything, edges=everything.edges.only(one_way)).homogeneous(order)[1].select("src", "dst")
        pairs = sample.two_hop_candidates(links, positives.select((F.col("src") + low).alias("src")), ends)
        candidates = pairs.select((F.col("src") - low).alias("src"), (F.col("dst") - ends[0]).alias("dst"))
        others = sample.drawn(candidates, positives.groupBy("src").agg(F.count("*").alias("n")), seed)
        return positives.select("src", "dst", F.lit(1).alias("y")).unionByName(others.select("src", "dst", F.lit(0).alias("y")))

    def negatives(self, split: str, how: str = "uniform", hops: int = 2, k: int = 1, seed: int = 0) -> DataFrame:
        """(src, dst): other pairs for the split's links, as many for a head as it has links, times ``k`` for draws from hops.

        ``uniform``: even draws from all tails, linked ones too.  ``hops``: draws from
        the tails within so many edges of the head in the network known by then, that
        aren't linked to it; heads without any drop out.  ``static``: the given pairs.
        """
        if how == "static":
            return self.static[split].select("src", "dst")
        positives = self.positives[split]
        if how == "uniform":
            tails = self.graph.nodes[self.target.dst]
            n = tails.agg(F.coalesce(F.max("nid") + 1, F.lit(0))).first()[0]
            return sample.random_tails(positives, tails, n, seed).select("src", F.col("neg").alias("dst"))
        if how != "hops":
            raise ValueError(f"{how} is none of uniform, hops, static")
        known = self.known(split)
        heads = positives.select(F.col("src").alias("nid")).distinct()
        candidates = sample.reached_within(known, heads, self.target.src, self.target.dst, hops, known.edges[self.target])
        return sample.drawn(candidates, positives.groupBy("src").agg((F.count("*") * k).alias("n")), seed).select("src", "dst")

    def sampled(self, choice: Mapping[str, str], **kw) -> DataFrame:
        """(split, src, dst): other pairs of each split by its own choice."""
        parts = [self.negatives(s, how, **kw).select(F.lit(s).alias("split"), "src", "dst") for s, how in choice.items()]
        return functools.reduce(DataFrame.unionByName, parts)


def _with_links(graph: HinGraph, c: CEType, links: DataFrame) -> HinGraph:
    """The graph with these links as an edge type, and turned as its inverse's."""
    back = graph.inverse.get(c)
    edges = {c: links} | ({back: reversed_edges(links)} if back is not None and back != c else {})
    return replace(graph, edges=graph.edges | edges)
