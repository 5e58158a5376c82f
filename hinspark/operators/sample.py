"""Splits, negatives and neighbour samples, all drawn by hashes of keys: the same in any partitioning."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import hash_order, hash_uniform
from ..graph import HinGraph
from ..scratch import written
from . import linalg
from .atomize import dense_ids

#: Parts of a stratum that are numbered apart.
STRATUM_PARTS = 64
#: Candidates of a head that are one list.
LISTED = 4096


def split_first_lines(lines: DataFrame, line: str = "line_no", share: int = 5) -> DataFrame:
    """The first ⌊n / share⌋ rows by line number are ``val``, the others ``train``; line numbers count from 0 without gaps."""
    n = lines.agg(F.floor(F.count("*") / share).alias("__n"))
    return lines.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col(line) < F.col("__n"), "val").otherwise("train")).drop("__n")  # one row


def split_links(edges: DataFrame, train_share: float = 0.9, seed: int = 0) -> DataFrame:
    """The first tail of each head is ``train``; of the others, about train_share is, the rest ``val``."""
    first = edges.groupBy("src").agg(F.min("dst").alias("__first"))
    train = (F.col("dst") == F.col("__first")) | (hash_uniform(F.col("src"), F.col("dst"), seed=seed) < train_share)
    return edges.join(first, "src").withColumn("split", F.when(train, "train").otherwise("val")).drop("__first")


def random_tails(edges: DataFrame, tails: DataFrame, n_tails: int, seed: int = 0) -> DataFrame:
    """A tail drawn evenly for each edge: (src, neg)."""
    draw = F.floor(hash_uniform(F.col("src"), F.col("dst"), seed=seed) * n_tails).cast("long")
    return edges.select("src", draw.alias("neg"))


def unlinked_tails(edges: DataFrame, n_tails: int, seed: int = 0, tries: int = 8) -> DataFrame:
    """(src, dst, neg): for each edge an even draw from the tails 0 to n_tails - 1 that its head isn't linked to.

    The first of ``tries`` draws that is free is taken; where none was, a place among
    the head's free tails is drawn.  Only a head linked to every tail has null.  Every
    edge has one draw first, and only edges still without a tail have the others.
    """
    links = edges.select("src", "dst").distinct()
    taken = links.select("src", F.col("dst").alias("neg"))

    def free(todo: DataFrame, low: int, high: int) -> DataFrame:
        draws = todo.withColumn("t", F.explode(F.sequence(F.lit(low), F.lit(high))))
        draws = draws.withColumn("neg", F.floor(hash_uniform(F.col("src"), F.col("dst"), F.col("t"), seed=seed) * n_tails).cast("long"))
        return draws.join(taken, ["src", "neg"], "left_anti").groupBy("src", "dst").agg(F.min_by("neg", "t").alias("neg"))

    found, todo, low = None, links, 0
    for high in sorted({0, tries - 1}):
        first = written(todo.join(free(todo, low, high), ["src", "dst"], "left"), "draws")
        some, todo, low = first.where("neg is not null"), first.where("neg is null").select("src", "dst"), high + 1
        found = some if found is None else found.unionByName(some)
    found = found.unionByName(_placed_tails(links, todo, n_tails, F.lit(tries), seed))
    return edges.select("src", "dst").join(found, ["src", "dst"], "left")


def _placed_tails(links: DataFrame, wanted: DataFrame, n_tails: int, t: Column, seed: int) -> DataFrame:
    """(src, dst, neg): of the tails a head isn't linked to, that at a drawn place.

    The j-th linked tail has tail - j free ones below it, so the free tail at place r
    is r plus the links with no more than r free ones below: one running count.
    """
    linked = links.where(F.col("dst").between(0, n_tails - 1)).join(wanted.select("src").distinct(), "src", "left_semi")
    below = linked.select("src", (F.col("dst") - F.row_number().over(Window.partitionBy("src").orderBy("dst")) + 1).alias("at"), F.lit(0).alias("draw"), F.lit(None).cast(links.schema["dst"].dataType).alias("dst"))
    left = wanted.join(linked.groupBy("src").agg(F.count("*").alias("d")), "src", "left").withColumn("left", n_tails - F.coalesce("d", F.lit(0)))
    place = F.floor(hash_uniform(F.col("src"), F.col("dst"), t, seed=seed) * F.col("left")).cast("long")
    draws = left.where("left > 0").select("src", place.alias("at"), F.lit(1).alias("draw"), "dst")
    so_far = Window.partitionBy("src").orderBy("at", "draw", "dst").rowsBetween(Window.unboundedPreceding, 0)
    counted = below.unionByName(draws).withColumn("neg", F.col("at") + F.sum(1 - F.col("draw")).over(so_far))
    return counted.where("draw = 1").select("src", "dst", "neg")


def random_pairs(edges: DataFrame, n_heads: int, n_tails: int, seed: int = 0, tries: int = 8) -> DataFrame:
    """As many (src, dst) as edges, both ends drawn evenly and again until the pair is no edge.

    Every edge has one draw first; only for those that met an edge more are made, in
    rounds that are written, each longer than the one before.  Without any free pair
    it's an error.
    """
    counted = written(edges.groupBy("src", "dst").agg(F.count("*").alias("n")), "links")
    links = counted.select("src", "dst")
    if links.where(F.col("src").between(0, n_heads - 1) & F.col("dst").between(0, n_tails - 1)).count() >= n_heads * n_tails:
        raise ValueError("every pair is an edge")
    taken = links.select(F.col("src").alias("head"), F.col("dst").alias("tail"), F.lit(True).alias("taken"))
    u = lambda end: hash_uniform(F.col("src"), F.col("dst"), F.col("k"), F.col("t"), F.lit(end), seed=seed)
    ends = lambda todo: todo.withColumns({"head": F.floor(u(0) * n_heads).cast("long"), "tail": F.floor(u(1) * n_tails).cast("long")})
    todo = counted.select("src", "dst", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    drawn = written(ends(todo.withColumn("t", F.lit(0))).join(taken, ["head", "tail"], "left").select("src", "dst", "k", "head", "tail", "taken"), "draws")
    out = drawn.where("taken is null").select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    todo, low, tries = drawn.where("taken").select("src", "dst", "k"), 1, max(1, tries - 1)
    while not todo.isEmpty():
        again = ends(todo.withColumn("t", F.explode(F.sequence(F.lit(low), F.lit(low + tries - 1)))))
        free = again.join(taken, ["head", "tail"], "left_anti")
        best = written(free.groupBy("src", "dst", "k").agg(F.min_by(F.struct("head", "tail"), "t").alias("pair")), "draws")
        out = out.unionByName(best.select(F.col("pair.head").alias("src"), F.col("pair.tail").alias("dst")))
        todo = written(todo.join(best, ["src", "dst", "k"], "left_anti"), "todo")
        low, tries = low + tries, 2 * tries
    return out


def two_hop_candidates(links: DataFrame, positives: DataFrame, tails: tuple[int, int] | None = None) -> DataFrame:
    """(src, dst) for each head of ``positives``: nodes two undirected links away, neither linked to it nor itself.

    ``links`` are (src, dst) over one id space; of it ``tails`` is the range (first, after
    the last) that candidates come from, if not all: other ends are never made.
    """
    both = links.select("src", "dst").union(links.select("dst", "src"))
    heads = written(positives.select("src").distinct(), "heads")
    low, high = heads.agg(F.min("src"), F.max("src")).first()
    first = written(both.where(F.col("src").between(F.lit(low), F.lit(high))).join(heads, "src", "left_semi").distinct(), "first")
    ends = written((both if tails is None else both.where((F.col("dst") >= tails[0]) & (F.col("dst") < tails[1]))).distinct(), "ends")
    known = first if tails is None else first.where((F.col("dst") >= tails[0]) & (F.col("dst") < tails[1]))
    without = known.select("src", "dst").union(heads.select("src", F.col("src").alias("dst")))
    return linalg.joined_pairs(first.select("src", F.col("dst").alias("mid")), ends.select(F.col("src").alias("mid"), "dst"), without)


def reached_within(graph: HinGraph, heads: DataFrame, head: str, tail: str, hops: int, without: DataFrame | None = None) -> DataFrame:
    """(src, dst): for each head (nid) the nodes of type ``tail`` from which at most ``hops`` edges, of any types, lead to it, but for pairs of ``without``.

    With no edge a head leads to itself, where both types are one.  Walked against the
    edges from the heads, through node types only that the tails can still lead to in
    the hops that are left; a level that is gone on from has each pair once, and what was
    found is grouped together with the pairs left out.
    """
    useful = [{tail}]
    for _ in range(hops):
        useful.append(useful[-1] | {c.dst for c in graph.edges if c.src in useful[-1]})
    level, found = {head: heads.select(F.col("nid").alias("src"), F.col("nid").alias("at")).distinct()}, []
    for left in range(hops, -1, -1):
        if tail in level:
            found.append(level[tail])
        if left == 0:
            break
        ahead: dict[str, list[DataFrame]] = {}
        for c, e in graph.edges.items():
            if c.dst in level and c.src in useful[left - 1]:
                step = level[c.dst].join(e.select(F.col("dst").alias("at"), F.col("src").alias("to")), "at").select("src", F.col("to").alias("at"))
                ahead.setdefault(c.src, []).append(step)
        level = {n: functools.reduce(DataFrame.unionByName, parts) for n, parts in ahead.items()}
        if left > 1:
            level = {n: written(df.distinct(), "level") for n, df in level.items()}
    if not found:
        return heads.select(F.col("nid").alias("src"), F.col("nid").alias("dst")).where("false")
    pairs = functools.reduce(DataFrame.unionByName, found).select("src", F.col("at").alias("dst"))
    if without is None:
        return pairs.distinct()
    out = without.join(heads.select(F.col("nid").alias("src")).distinct(), "src", "left_semi").select("src", "dst", F.lit(True).alias("out"))
    return pairs.withColumn("out", F.lit(False)).unionByName(out).groupBy("src", "dst").agg(F.bool_or("out").alias("out")).where("not out").select("src", "dst")


def n_hop_candidates(steps: list[DataFrame | list[DataFrame]], direct: DataFrame) -> DataFrame:
    """(src, dst) joined by any of the step tables one after the other, without direct edges.

    Each step is (src, dst) over the ids of the one before, or a list of tables over
    ids between that are no candidates; with an identity step first the node itself is
    a candidate, as where both ends are of one type.  A step leaves out the pairs that
    are known before it, so pairs of different steps needn't be compared.
    """
    found, now, known = None, None, direct.select("src", "dst").distinct()
    for n, step in enumerate(steps):
        *between, last = step if isinstance(step, list) else [step]
        for e in between:
            now = _ahead(now, e)
        new = _ahead(now, last, known)
        found = new if found is None else found.unionByName(new)
        if n + 1 < len(steps):
            now, known = _ahead(now, last), known.unionByName(new)
    return found


def _ahead(now: DataFrame | None, step: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) one step on from ``now``, or the step's own."""
    step = step.select("src", "dst").distinct()
    if now is None:
        return step if without is None else step.join(without, ["src", "dst"], "left_anti")
    return linalg.joined_pairs(now.select("src", F.col("dst").alias("mid")), step.select(F.col("src").alias("mid"), "dst"), without)


def drawn(candidates: DataFrame, per_head: DataFrame, seed: int = 0) -> DataFrame:
    """(src, k, dst): for each head as many draws with replacement as ``per_head`` (src, n) says.

    A head's candidates are numbered in the order of their hashes.  Those of a head with
    ``LISTED`` at most are one list, hashed and sorted where they have met; those of
    larger heads are numbered by ranges, so no long list is one task's.
    """
    candidates = written(candidates.select("src", "dst"), "candidates")
    sizes = written(candidates.groupBy("src").agg(F.count("*").alias("size")), "sizes")
    few = candidates.join(sizes.where(F.col("size") <= LISTED).select("src"), "src").groupBy("src").agg(F.collect_set("dst").alias("dst"))
    ordered = F.array_sort(F.transform("dst", lambda d: F.struct(hash_order(F.col("src"), d, seed=seed).alias("h"), d.alias("dst"))))
    picks = few.select("src", ordered.alias("c"), F.size("dst").alias("size")).join(per_head, "src").select("src", "c", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("k"))
    place = F.floor(hash_uniform(F.col("src"), F.col("k"), seed=seed + 1) * F.col("size"))
    out = picks.select("src", "k", F.get("c", place.cast("int"))["dst"].alias("dst"))
    large = sizes.where(F.col("size") > LISTED).select("src")
    if large.isEmpty():
        return out
    return out.unionByName(_drawn_by_ranges(candidates.join(large, "src", "left_semi"), per_head, seed))


def _drawn_by_ranges(candidates: DataFrame, per_head: DataFrame, seed: int) -> DataFrame:
    """(src, k, dst): candidates are numbered in the order of (head, hash), and a draw picks a number among its head's."""
    key = F.struct("src", hash_order(F.col("src"), F.col("dst"), seed=seed).alias("h"), "dst")
    numbered = dense_ids(candidates.select(key.alias("__key")), "__key").select("__key.src", "__key.dst", "nid")
    ranges = numbered.groupBy("src").agg(F.min("nid").alias("first"), F.count("*").alias("size"))
    picks = per_head.join(ranges, "src").select("src", "first", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("k"))
    place = F.col("first") + F.floor(hash_uniform(F.col("src"), F.col("k"), seed=seed + 1) * F.col("size")).cast("long")
    return picks.select("src", "k", place.alias("nid")).join(numbered.select("nid", "dst"), "nid").select("src", "k", "dst")


def k_folds(rows: DataFrame, k: int, stratum: Column | None, key: str, seed: int = 0) -> DataFrame:
    """``fold`` from 0 to k - 1, even within each stratum.

    Keys are numbered in the order of (stratum, hash) by ranges, so neither all rows nor
    a large stratum is one task's; rows of one key share a fold.
    """
    keyed = rows.withColumn("__key", F.struct((F.lit(0) if stratum is None else stratum).alias("s"), hash_order(F.col(key), seed=seed).alias("h"), F.col(key).alias("k")))
    ids = dense_ids(keyed, "__key").withColumnRenamed("nid", "__place")
    if stratum is not None:  # a stratum meets its first place in parts, so a large one isn't one task's
        first = ids.groupBy(F.struct("__key.s").alias("__s")).agg(F.min("__place").alias("__first"))
        first = first.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(STRATUM_PARTS - 1).cast("long"))))
        ids = ids.withColumns({"__s": F.struct("__key.s"), "__part": F.pmod(F.col("__place"), F.lit(STRATUM_PARTS).cast("long"))}).join(first, ["__s", "__part"])
        ids = ids.select("__key", (F.col("__place") - F.col("__first")).alias("__place"))
    placed = ids.select("__key", F.pmod(F.col("__place"), F.lit(k)).cast("long").alias("fold"))
    return keyed.join(placed, "__key").drop("__key")


def proportional_split(rows: DataFrame, key: str, label: str, train: float, val: float, seed: int = 0) -> DataFrame:
    """``train``, ``val`` or ``test`` by a hashed draw in those shares; null for an unlabelled row (null or -1)."""
    u = hash_uniform(F.col(key), seed=seed)
    named = F.when(u < train, "train").when(u < train + val, "val").otherwise("test")
    return rows.withColumn("split", F.when(F.coalesce(F.col(label), F.lit(-1)) != -1, named))


def neighbours(edges: DataFrame, frontier: DataFrame, fanout: int, seed: int = 0) -> DataFrame:
    """In-edges of the frontier's nodes (nid): all if fanout is -1, none if 0, else so many for each node, by hash."""
    into = edges.select("src", "dst").join(frontier.select(F.col("nid").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    if fanout < 0:
        return into
    if fanout == 0:
        return into.where("false")
    w = Window.partitionBy("dst").orderBy(hash_order(F.col("src"), F.col("dst"), seed=seed), "src")
    return into.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= fanout).drop("__r")


def layers(graph, seeds: dict[str, DataFrame], fanouts: list[dict | int], seed: int = 0) -> tuple[list[dict], dict[str, DataFrame]]:
    """Sampled edges of each layer, outermost first, and the nodes of the last frontier.

    A layer's fan-out is one number or one for each edge type.
    """
    frontier, out = dict(seeds), []
    for depth, fanout in enumerate(fanouts):
        block = {}
        for c in graph.edges:
            n = fanout if isinstance(fanout, int) else fanout.get(c, 0)
            if c.dst in frontier and n:
                block[c] = neighbours(graph.edges[c], frontier[c.dst], n, seed + depth)
        for c, e in block.items():
            found = e.select(F.col("src").alias("nid"))
            frontier[c.src] = (frontier[c.src].select("nid").union(found) if c.src in frontier else found).distinct()
        out.insert(0, block)
    return out, frontier


def block_shuffled(rows: DataFrame, key: str, chunk: int, batch: int, seed: int = 0) -> DataFrame:
    """``batch`` of each row: chunks of consecutive keys keep together, in a hashed order; keys count from 0 without gaps.

    Chunks are numbered by ranges of their hashes.
    """
    block = F.floor(F.col(key) / chunk)
    hashed = rows.select(F.struct(hash_order(block, seed=seed).alias("h"), block.alias("b")).alias("__key"))
    order = dense_ids(hashed, "__key").select(F.col("__key.b").alias("__b"), F.col("nid").alias("__o"))
    placed = rows.withColumn("__b", block).join(order, "__b")
    return placed.withColumn("batch", F.floor((F.col("__o") * chunk + F.pmod(F.col(key), F.lit(chunk))) / batch).cast("long")).drop("__b", "__o")


def node_sequences(edges: DataFrame, targets: DataFrame, length: int, hops: int, seed: int = 0) -> DataFrame:
    """(nid, seq): each target, then its neighbours by depth and hash, cut or padded with null to a length.

    Rows are ranked before they are gathered, so a list has ``length`` nodes at most.
    """
    now = targets.select("nid", F.col("nid").alias("at"), F.lit(0).alias("depth"))
    seen = now
    for d in range(1, hops + 1):
        step = edges.select(F.col("src").alias("at"), "dst")
        now = now.where(F.col("depth") == d - 1).join(step, "at").select("nid", F.col("dst").alias("at"), F.lit(d).alias("depth")).distinct()
        now = now.join(seen.select("nid", "at"), ["nid", "at"], "left_anti").select("nid", "at", "depth")
        seen = seen.union(now)
    w = Window.partitionBy("nid").orderBy("depth", hash_order(F.col("nid"), F.col("at"), seed=seed), "at")
    ranked = seen.withColumn("r", F.row_number().over(w)).where(F.col("r") <= length)
    seq = F.transform(F.array_sort(F.collect_list(F.struct("r", "at"))), lambda x: x["at"])
    out = ranked.groupBy("nid").agg(seq.alias("seq"))
    return out.select("nid", F.concat("seq", F.array_repeat(F.lit(None).cast("long"), F.lit(length) - F.size("seq"))).alias("seq"))


def subgraph(graph: HinGraph, seeds: dict[str, DataFrame], fanouts: list[dict | int], seed: int = 0) -> tuple[HinGraph, dict[str, DataFrame]]:
    """The network of the last sampled layer, with ids from 0 in each type, and the seeds under their new ids.

    Layers are sampled as :func:`layers` does.  The nodes are the last frontier, which
    is closed: the edges are those sampled for the layer before it, so both ends are
    in it.  Nodes are (nid, old), numbered in the order of their old ids; all types are
    numbered in one pass over ranges, so none is one task's.  A seed without edges stays.
    Each frontier and sample is written once, not sampled again for each of its uses.
    """
    before = {n: written(df.select("nid").distinct(), "frontier") for n, df in layers(graph, seeds, fanouts[:-1], seed)[1].items()}
    last = {c: written(e, "sampled") for c, e in layers(graph, before, fanouts[-1:], seed + len(fanouts) - 1)[0][0].items()}
    frontier = dict(before)
    for c, e in last.items():
        found = e.select(F.col("src").alias("nid"))
        frontier[c.src] = frontier[c.src].union(found) if c.src in frontier else found
    kinds = sorted(frontier)
    nodes = functools.reduce(DataFrame.unionByName, [frontier[n].select(F.struct(F.lit(k).alias("type"), F.col("nid").alias("old")).alias("key")) for k, n in enumerate(kinds)])
    placed = dense_ids(nodes, "key").select("key.type", "key.old", F.col("nid").alias("place"))
    first = placed.groupBy("type").agg(F.min("place").alias("first"))
    ids = written(placed.join(F.broadcast(first), "type").select("type", "old", (F.col("place") - F.col("first")).alias("nid")), "subgraph")  # a row for each type
    of = {n: ids.where(F.col("type") == k).select("nid", "old") for k, n in enumerate(kinds)}
    edges = {}
    for c, e in last.items():
        src, dst = (of[t].select(F.col("nid").alias(f"new_{end}"), F.col("old").alias(end)) for t, end in ((c.src, "src"), (c.dst, "dst")))
        edges[c] = e.join(src, "src").join(dst, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
    begun = {n: df.select(F.col("nid").alias("old")).distinct().join(of[n], "old").select("nid", "old") for n, df in seeds.items()}
    return HinGraph(of, edges, {}, graph.target if graph.target in of else None), begun
