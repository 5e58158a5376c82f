"""Forward passes of message-passing layers, with parameters given as numbers or tables.

Node vectors are (nid, h ARRAY<DOUBLE>).  A layer projects before it joins, weights
messages on the edges, and adds them up per destination, element by element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import bound, dot, elu, gelu, l2_normalized, leaky_relu, matvec, prelu
from ..scratch import written
from ..types import CEType
from .evaluate import softmax


def vector_sum(rows: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """(key, vector): weighted sum of arrays per key, as grouped sums of the elements."""
    w = F.lit(1.0) if weight is None else weight
    cells = rows.select(key, w.alias("__w"), F.posexplode(vector).alias("__i", "__v"))
    sums = cells.groupBy(key, "__i").agg(F.sum(F.col("__w") * F.col("__v")).alias("__v"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda x: x["__v"]).alias(vector))


def linear(nodes: DataFrame, w: list[list[float]]) -> DataFrame:
    return nodes.select("nid", matvec(w, F.col("h")).alias("h"))


def mean_conv(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean of in-neighbours' vectors."""
    sent = edges.join(nodes, F.col("src") == F.col("nid")).select("dst", "h")
    degree = edges.groupBy("dst").agg(F.count("*").alias("d"))
    return vector_sum(sent, "dst", "h").join(degree, "dst").select(F.col("dst").alias("nid"), F.transform("h", lambda x: x / F.col("d")).alias("h"))


def relation_weights(logits: dict[CEType, float]) -> dict[CEType, float]:
    """Softmax of one logit per edge type over the edge types into the same node type."""
    import math

    out = {}
    for dst in {c.dst for c in logits}:
        group = {c: v for c, v in logits.items() if c.dst == dst}
        top = max(group.values())
        mass = sum(math.exp(v - top) for v in group.values())
        out |= {c: math.exp(v - top) / mass for c, v in group.items()}
    return out


def srgcn_conv(edges: dict[CEType, DataFrame], nodes: dict[str, DataFrame], logits: dict[CEType, float], dst: str) -> DataFrame:
    """Weighted sum of each relation's mean into one node type, weights by softmax over its relations."""
    weights, out = relation_weights(logits), None
    for c, e in edges.items():
        if c.dst == dst:
            part = mean_conv(e, nodes[c.src]).select("nid", "h", F.lit(weights[c]).alias("w"))
            out = part if out is None else out.unionByName(part)
    return vector_sum(out, "nid", "h", F.col("w"))


def gat_conv(edges: DataFrame, nodes: DataFrame, left: list[float], right: list[float], slope: float = 0.2) -> DataFrame:
    """Graph attention over homogeneous edges (src, dst[, etype_logit]).

    The attention vector is split: each end's part is a number of its node, so
    nothing wide is on the edges before the weights are known.
    """
    vec = lambda v: F.array(*map(F.lit, v))
    ends = nodes.select("nid", dot(F.col("h"), vec(left)).alias("l"), dot(F.col("h"), vec(right)).alias("r"))
    more = F.col("etype_logit") if "etype_logit" in edges.columns else F.lit(0.0)
    scored = edges.join(ends.select(F.col("nid").alias("src"), "l"), "src").join(ends.select(F.col("nid").alias("dst"), "r"), "dst")
    scored = scored.select("src", "dst", leaky_relu(F.col("l") + F.col("r") + more, slope).alias("x"))
    a = softmax(scored, ["dst"], "x", "a")
    sent = a.join(nodes.withColumnRenamed("nid", "src"), "src").select("dst", "a", "h")
    return vector_sum(sent, "dst", "h", F.col("a")).withColumnRenamed("dst", "nid")


def _per_head(h: Column, w: list[list[list[float]]]) -> Column:
    """The vector's slice of each head as a row, times that head's matrix; one array per head."""
    width = len(w[0])
    turned = [[list(column) for column in zip(*m, strict=True)] for m in w]
    return F.array(*(matvec(m, F.slice(h, i * width + 1, width)) for i, m in enumerate(turned)))


def typed_attention(edges: dict[CEType, DataFrame], nodes: dict[str, DataFrame], dst: str, query: list[list[float]], key: dict[str, list[list[float]]], relation: dict[CEType, list[list[list[float]]]], prior: dict[CEType, list[float]], per_type: bool = False) -> DataFrame:
    """(dst, src, etype, head, a): attention of one node type's nodes over all their in-edges, whatever the edge type, or ``per_type``.

    A score is query · (key · relation matrix) of a head, times the relation's prior,
    over the root of the head's width; softmax is over a node's edges of all types.
    Keys meet the relation matrix at their nodes, before they are joined to edges.
    ``etype`` is the place of the edge type in ``edges``.
    """
    width = len(next(iter(relation.values()))[0])
    heads = len(query) // width
    asked = nodes[dst].select(F.col("nid").alias("dst"), matvec(query, F.col("h")).alias("q"))
    scored = None
    for i, (c, e) in enumerate(edges.items()):
        if c.dst != dst:
            continue
        keys = nodes[c.src].select(F.col("nid").alias("src"), matvec(key[c.src], F.col("h")).alias("k")).select("src", _per_head(F.col("k"), relation[c]).alias("k"))
        both = e.select("src", "dst", *(["weight"] if "weight" in e.columns else [])).join(keys, "src").join(asked, "dst")
        weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in e.columns else F.lit(1.0)
        x = F.array(*(dot(F.slice("q", h * width + 1, width), F.get("k", h)) * (prior[c][h] / width**0.5) * weight for h in range(heads)))
        part = both.select("dst", "src", F.lit(i).alias("etype"), F.posexplode(x).alias("head", "x"))
        scored = part if scored is None else scored.unionByName(part)
    return softmax(scored, ["dst", *(["etype"] if per_type else []), "head"], "x", "a").select("dst", "src", "etype", "head", "a")


def hgt_conv(edges: dict[CEType, DataFrame], nodes: dict[str, DataFrame], dst: str, query: list[list[float]], key: dict[str, list[list[float]]], value: dict[str, list[list[float]]], relation: dict[CEType, list[list[list[float]]]], message: dict[CEType, list[list[list[float]]]], prior: dict[CEType, list[float]], out: list[list[float]], skip: float, per_type: bool = False) -> DataFrame:
    """Typed attention over messages, then gelu(out · sum), mixed with the node's own vector by a gate, sigmoid(skip).

    A node without in-edges has a sum of zeros.  With ``per_type``, the older form: the
    edges of each type have a softmax of their own, messages are averaged over the edge
    types into the node type, those without an edge counted as zeros, and there's no gelu.
    """
    import math

    attention = typed_attention(edges, nodes, dst, query, key, relation, prior, per_type)
    if per_type:
        attention = attention.withColumn("a", F.col("a") / sum(c.dst == dst for c in edges))
    active = (lambda x: x) if per_type else gelu
    sent = None
    for i, c in enumerate(edges):
        if c.dst != dst:
            continue
        said = nodes[c.src].select(F.col("nid").alias("src"), matvec(value[c.src], F.col("h")).alias("v")).select("src", F.posexplode(_per_head(F.col("v"), message[c])).alias("head", "m"))
        part = attention.where(F.col("etype") == i).join(said, ["src", "head"]).select("dst", "a", F.struct("head", "m").alias("s"))
        sent = part if sent is None else sent.unionByName(part)
    width = len(next(iter(message.values()))[0])
    cells = sent.select("dst", "a", F.col("s.head").alias("head"), F.posexplode("s.m").alias("i", "m"))
    sums = cells.groupBy("dst", (F.col("head") * width + F.col("i")).alias("i")).agg(F.sum(F.col("a") * F.col("m")).alias("v"))
    joined = sums.groupBy("dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("s"))
    gate = 1 / (1 + math.exp(-skip))
    mixed = nodes[dst].join(joined, F.col("nid") == F.col("dst"), "left")
    s = F.coalesce("s", F.array_repeat(F.lit(0.0), len(query)))
    return mixed.select("nid", F.zip_with(matvec(out, s), F.col("h"), lambda x, y: active(x) * gate + y.cast("double") * (1 - gate)).alias("h"))


def attention_residual(now: Column, before: Column | None, alpha: float) -> Column:
    return now if before is None else now * (1 - alpha) + before * alpha


def regcn_conv(edges: DataFrame, nodes: DataFrame, relation: dict[int, float], slope: float = 0.01) -> DataFrame:
    """Edges (src, dst, etype) weighted by their type's leaky weight, normalised by both ends' weighted degrees to the power −½ (degrees at least 1)."""
    pairs = [x for k, v in relation.items() for x in (F.lit(k), F.lit(v if v >= 0 else slope * v))]
    e = edges.withColumn("w", F.create_map(*pairs)[F.col("etype")])
    scale = lambda end: e.groupBy(end).agg(F.pow(F.greatest(F.sum("w"), F.lit(1.0)), F.lit(-0.5)).alias(f"s_{end}"))
    weighted = e.join(scale("src"), "src").join(scale("dst"), "dst").select("src", "dst", (F.col("w") * F.col("s_src") * F.col("s_dst")).alias("w"))
    sent = weighted.join(nodes.withColumnRenamed("nid", "src"), "src").select("dst", "w", "h")
    return vector_sum(sent, "dst", "h", F.col("w")).withColumnRenamed("dst", "nid")


def soft_adjacency(edges: dict[CEType, DataFrame], logits: dict[CEType, float]) -> DataFrame:
    """(dst, src, w): softmax mixture of edge types between the same nodes."""
    import math

    top = max(logits.values())
    mass = sum(math.exp(v - top) for v in logits.values())
    out = None
    for c, e in edges.items():
        part = e.select("dst", "src", F.lit(math.exp(logits[c] - top) / mass).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("dst", "src").agg(F.sum("w").alias("w"))


def semantic_attention(per_path: DataFrame, w: list[list[float]], q: list[float]) -> DataFrame:
    """Of (nid, mp, h): mean over nodes of q·tanh(W h) per metapath, softmax over metapaths, weighted sum."""
    score = dot(F.transform(matvec(w, F.col("h")), F.tanh), F.array(*map(F.lit, q)))
    means = per_path.groupBy("mp").agg(F.avg(score).alias("x")).withColumn("all", F.lit(0))
    beta = softmax(means, ["all"], "x", "beta").select("mp", "beta")
    return vector_sum(per_path.join(F.broadcast(beta), "mp"), "nid", "h", F.col("beta"))  # a row for each metapath


def polynomial(per_path: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Sum over metapaths of coefficient times features, of (mp, nid, slot, col, val)."""
    pairs = [x for k, v in coefficients.items() for x in (F.lit(k), F.lit(v))]
    return per_path.groupBy("nid", "slot", "col").agg(F.sum(F.col("val") * F.coalesce(F.create_map(*pairs)[F.col("mp")], F.lit(0.0))).alias("val"))


def linear_attention(q: DataFrame, k: DataFrame, v: DataFrame) -> DataFrame:
    """φ(Q)(φ(K)ᵀV) over (φ(K)ᵀ1), with vectors already mapped by φ: two global sums, then one row per query.

    φ(K)ᵀV has as many cells as the widths multiply to; it is broadcast.
    """
    kv = k.select("nid", F.posexplode("h").alias("i", "k")).join(v.select("nid", F.posexplode("h").alias("j", "v")), "nid").groupBy("i", "j").agg(F.sum(F.col("k") * F.col("v")).alias("kv"))
    total = k.select(F.posexplode("h").alias("i", "k")).groupBy("i").agg(F.sum("k").alias("z"))
    cells = q.select("nid", F.posexplode("h").alias("i", "q"))
    top = cells.join(F.broadcast(kv), "i").groupBy("nid", "j").agg(F.sum(F.col("q") * F.col("kv")).alias("t"))
    low = cells.join(F.broadcast(total), "i").groupBy("nid").agg(F.sum(F.col("q") * F.col("z")).alias("b"))
    out = top.join(low, "nid").select("nid", "j", (F.col("t") / F.col("b")).alias("x"))
    return out.groupBy("nid").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("h"))


def concat_normalized(*layers: DataFrame) -> DataFrame:
    """Each layer's vectors L2-normalised and put side by side."""
    out = layers[0].select("nid", l2_normalized(F.col("h")).alias("h"))
    for x in layers[1:]:
        out = out.join(x.select("nid", l2_normalized(F.col("h")).alias("more")), "nid").select("nid", F.concat("h", "more").alias("h"))
    return out


def pair_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, score=dot) -> DataFrame:
    """``pairs`` with the score of both ends' vectors: the dot product, or what is given."""
    j = pairs.join(left.select(F.col("nid").alias("src"), F.col("h").alias("__a")), "src").join(right.select(F.col("nid").alias("dst"), F.col("h").alias("__b")), "dst")
    return j.withColumn("score", score(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def metapath_weights(extensions: DataFrame, relation: list[DataFrame], start: DataFrame) -> DataFrame:
    """(mp, weight): relation weights (etype, w) of each layer multiplied along the meta graph's extensions (etype, mp, to)."""
    now, out = start, start
    for w in relation:
        now = now.join(extensions, "mp").join(w, "etype").groupBy(F.col("to").alias("mp")).agg(F.sum(F.col("weight") * F.col("w")).alias("weight"))
        out = out.unionByName(now)
    return out


def top_metapaths(weights: DataFrame, n: int | None = None, mix: float | None = None) -> DataFrame:
    """Metapaths of (mp, logit): the n of the largest softmax weight, or all of at least mix · largest + (1 − mix) · smallest."""
    p = softmax(weights.withColumn("all", F.lit(0)), ["all"], "logit", "p").drop("all")
    if n is not None:
        return p.orderBy(F.desc("p"), "mp").limit(n)
    ends = p.agg(F.max("p").alias("hi"), F.min("p").alias("lo"))
    return p.crossJoin(F.broadcast(ends)).where(F.col("p") >= mix * F.col("hi") + (1 - mix) * F.col("lo")).drop("hi", "lo")  # one row


def weighted_metapaths(per_path: DataFrame, weights: DataFrame) -> DataFrame:
    """(nid, slot, col, val): features of all metapaths added up by the weights (mp, weight); one without weight counts nothing."""
    used = per_path.join(weights.select("mp", "weight"), "mp")
    return used.groupBy("nid", "slot", "col").agg(F.sum(F.col("val") * F.col("weight")).alias("val"))


def metapath_attention(per_path: DataFrame, query: list[list[float]], key: list[list[float]], value: list[list[float]], gamma: float) -> DataFrame:
    """Of (nid, mp, h): each node's metapaths attend to each other; softmax of q · k over the keys' metapaths, times gamma, plus h."""
    p = per_path.select("nid", "mp", "h", matvec(query, F.col("h")).alias("q"))
    k = per_path.select("nid", F.col("mp").alias("to"), matvec(key, F.col("h")).alias("k"), matvec(value, F.col("h")).alias("v"))
    scored = p.select("nid", "mp", "q").join(k, "nid").select("nid", "mp", dot(F.col("q"), F.col("k")).alias("x"), F.posexplode("v").alias("i", "v"))
    top = scored.groupBy("nid", "mp").agg(F.max("x").alias("top"))
    e = F.exp(F.col("x") - F.col("top"))
    sums = scored.join(top, ["nid", "mp"]).groupBy("nid", "mp", "i").agg((F.sum(e * F.col("v")) / F.sum(e)).alias("v"))
    rows = sums.groupBy("nid", "mp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))
    return p.join(rows, ["nid", "mp"]).select("nid", "mp", F.zip_with("h", "v", lambda x, y: x.cast("double") + gamma * y).alias("h"))


def slot_gat_conv(edges: DataFrame, nodes: DataFrame, weight: dict[str, list[list[list[float]]]], left: dict[str, list[list[float]]], right: dict[str, list[list[float]]], slope: float = 0.2, before: DataFrame | None = None, alpha: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """((nid, slot, h), (src, dst, head, a)): attention that all slots of a node share, messages that stay in their slots.

    ``nodes`` are (nid, slot, h); a slot that a node hasn't is zeros and needs no row.
    Each slot has a matrix for each head and its part of both attention vectors, so an
    end's score is a number for each head: the sum of its slots' parts.  Edges are
    (src, dst[, etype_logit]).  With the attention of the layer before, the new one
    is mixed with it, ``alpha`` of the old.  Messages are added up by (node, slot,
    head, element) first, then put together by (node, slot).
    """
    slots, heads = sorted(weight), len(next(iter(weight.values())))
    table = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    parts = []
    for s in slots:
        own = nodes.where(F.col("slot") == s).select("nid", "slot", F.posexplode(F.array(*(matvec(m, F.col("h")) for m in weight[s]))).alias("head", "f"))
        parts.append(own.select("nid", "slot", "head", "f", dot(F.col("f"), F.get(table(left[s]), F.col("head"))).alias("l"), dot(F.col("f"), F.get(table(right[s]), F.col("head"))).alias("r")))
    projected = parts[0]
    for p in parts[1:]:
        projected = projected.unionByName(p)
    ends = projected.groupBy("nid", "head").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    more = F.col("etype_logit") if "etype_logit" in edges.columns else F.lit(0.0)
    each = edges.select("src", "dst", more.alias("e"), F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head"))
    scored = each.join(ends.select(F.col("nid").alias("src"), "head", "l"), ["src", "head"], "left").join(ends.select(F.col("nid").alias("dst"), "head", "r"), ["dst", "head"], "left")
    x = F.coalesce("l", F.lit(0.0)) + F.coalesce("r", F.lit(0.0)) + F.col("e")
    a = softmax(scored.select("src", "dst", "head", leaky_relu(x, slope).alias("x")), ["dst", "head"], "x", "a").select("src", "dst", "head", "a")
    if before is not None:
        a = a.join(before.withColumnRenamed("a", "b"), ["src", "dst", "head"], "left").select("src", "dst", "head", attention_residual(F.col("a"), F.coalesce("b", "a"), alpha).alias("a"))
    sent = a.join(projected.select(F.col("nid").alias("src"), "slot", "head", "f"), ["src", "head"]).select("dst", "slot", "head", "a", F.posexplode("f").alias("i", "f"))
    cells = sent.groupBy("dst", "slot", "head", "i").agg(F.sum(F.col("a") * F.col("f")).alias("v"))
    rows = cells.groupBy(F.col("dst").alias("nid"), "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("head", "i", "v"))), lambda c: c["v"]).alias("h"))
    return rows, a


def slots_merged(rows: DataFrame, slots: list[str], width: int, how: str, w: list[list[float]] | None = None, b: list[float] | None = None, q: list[float] | None = None) -> DataFrame:
    """(nid, h) of (nid, slot, h): slots ``mean``, ``max`` or ``concat``, or weighted by a ``softmax`` over slots.

    The softmax is over q · tanh(w h + b), averaged over all nodes.  Missing slots
    are zeros and count as such.  A node's slots are gathered in one row, as many
    vectors as there are slots at most.
    """
    known = rows.groupBy("nid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "h"))).alias("m"))
    zeros = F.array_repeat(F.lit(0.0), width)
    all_ = F.array(*(F.coalesce(F.element_at("m", F.lit(s)), zeros) for s in slots))
    if how == "softmax":
        score = lambda h: dot(F.zip_with(matvec(w, h), F.array(*map(F.lit, b)), lambda x, y: F.tanh(x + y)), F.array(*map(F.lit, q)))
        long = known.select("nid", F.posexplode(all_).alias("k", "h"))
        means = long.groupBy("k").agg(F.avg(score(F.col("h"))).alias("x")).withColumn("all", F.lit(0))
        beta = softmax(means, ["all"], "x", "beta").select("k", "beta")
        return vector_sum(long.join(F.broadcast(beta), "k"), "nid", "h", F.col("beta"))  # a row for each slot
    add = lambda f: F.aggregate(F.slice(all_, 2, len(slots)), F.get(all_, 0), lambda s, h: F.zip_with(s, h, f))
    made = {"mean": lambda: F.transform(add(lambda x, y: x + y), lambda x: x / len(slots)), "max": lambda: add(lambda x, y: F.greatest(x, y)), "concat": lambda: F.flatten(all_)}
    if how not in made:
        raise ValueError(how)
    return known.select("nid", made[how]().alias("h"))


def han_conv(paths: dict[str, DataFrame], nodes: DataFrame, left: dict[str, list[float]], right: dict[str, list[float]], w: list[list[float]], q: list[float], slope: float = 0.2) -> DataFrame:
    """Attention over each metapath's pairs (src, dst), elu, then attention over the metapaths.

    A node without a pair of a metapath counts there with zeros, as the mean over nodes is over all of them.
    """
    out = None
    for mp, edges in paths.items():
        seen = gat_conv(edges, nodes, left[mp], right[mp], slope).withColumnRenamed("h", "m")
        part = nodes.join(seen, "nid", "left").select("nid", F.lit(mp).alias("mp"), F.transform(F.coalesce("m", F.transform("h", lambda x: F.lit(0.0))), lambda x: elu(x)).alias("h"))  # transform would give a second argument its index
        out = part if out is None else out.unionByName(part)
    return semantic_attention(out, w, q)


def group_norm(h: Column, groups: int, eps: float = 1e-5) -> Column:
    """Each of ``groups`` equal stretches of a vector less its mean, over its population deviation."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def normed(v: Column) -> Column:
        width = (F.size(v) / groups).cast("int")
        centred = lambda a: bound(total(a) / width, lambda m: F.transform(a, lambda x: x - m))
        scaled = lambda a: bound(F.sqrt(total(F.transform(a, lambda x: x * x)) / width + eps), lambda d: F.transform(a, lambda x: x / d))
        parts = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: F.slice(v, i * width + 1, width))
        return F.flatten(F.transform(F.transform(parts, centred), scaled))

    return bound(h, normed)


def _vector(v: list[float]) -> Column:
    return F.array(*map(F.lit, v))


def affine(w: list[list[float]], b: list[float], x: Column) -> Column:
    return F.zip_with(matvec(w, x), _vector(b), lambda u, v: u + v)


def readout(h: Column, hidden: list[tuple[list[list[float]], list[float], float]], w: list[list[float]], b: list[float]) -> Column:
    """Logits: for each hidden layer (matrix, offsets, slope) affine, normalised, parametric relu; then affine."""
    for matrix, offset, slope in hidden:
        h = F.transform(group_norm(affine(matrix, offset, h), 1), lambda x: prelu(x, F.lit(slope)))  # noqa: B023
    return affine(w, b, h)


def srgcn(edges: dict[CEType, DataFrame], feats: dict[str, DataFrame], projection: dict[str, tuple[list[list[float]], list[float]]], logits: list[dict[CEType, float]], heads: int, residual: float, target: str, hidden: list, w: list[list[float]], b: list[float]) -> DataFrame:
    """(nid, h): logits of the target's nodes by a whole relational network.

    Features of each type are projected into one space and normalised by head; a layer
    for each entry of ``logits`` sends means along relations, weighted by a softmax
    over the relations into a type; from the second layer on ``residual`` of a node's vector
    before is added.  A node without a message keeps zeros.  Layers are made for the
    types only that the target still needs.
    """
    needed = [{target}]
    for _ in logits:
        needed.insert(0, needed[0] | {c.src for c in edges if c.dst in needed[0]})
    width = len(next(iter(projection.values()))[1])
    now = {n: feats[n].select("nid", group_norm(affine(*projection[n], F.col("h")), heads).alias("h")) for n in feats if n in needed[0]}
    zeros = F.array_repeat(F.lit(0.0), width)
    for i, weights in enumerate(logits):
        after = {}
        for n in needed[i + 1]:
            into = {c: e for c, e in edges.items() if c.dst == n and c.src in now}
            got = now[n].withColumnRenamed("h", "own")
            if into:
                got = got.join(srgcn_conv(into, now, {c: weights[c] for c in into}, n), "nid", "left")
            else:
                got = got.withColumn("h", zeros)
            sent = F.coalesce("h", zeros)
            h = F.zip_with(sent, "own", lambda x, y: x + residual * y) if i else sent
            after[n] = written(got.select("nid", h.alias("h")), "layer")
        now = after
    return now[target].select("nid", readout(F.col("h"), hidden, w, b).alias("h"))


def paths_stacked(per_path: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(nid, hs) of (nid, mp, h): a node's vectors in the order of ``widths``, zeros where a metapath has none; as many as metapaths at most."""
    known = per_path.groupBy("nid").agg(F.map_from_entries(F.collect_list(F.struct("mp", "h"))).alias("m"))
    return known.select("nid", F.array(*(F.coalesce(F.element_at("m", F.lit(mp)), F.array_repeat(F.lit(0.0), n)) for mp, n in widths.items())).alias("hs"))


def path_projection(hs: Column, w: list[list[list[float]]], b: list[list[float]], slope: float) -> Column:
    """Each metapath's vector by its own matrix and offsets, normalised over all metapaths of the node together, parametric relu."""
    parts = F.flatten(F.array(*(affine(m, v, F.get(hs, i)) for i, (m, v) in enumerate(zip(w, b, strict=True)))))
    flat = F.transform(group_norm(parts, 1), lambda x: prelu(x, F.lit(slope)))
    width = len(b[0])
    return F.array(*(F.slice(flat, i * width + 1, width) for i in range(len(b))))


def searched_paths(hs: Column, alpha: list[float], sampled: list[int]) -> Column:
    """The sampled metapaths' vectors added up by the softmax of their weights."""
    import math

    top = max(alpha[i] for i in sampled)
    mass = sum(math.exp(alpha[i] - top) for i in sampled)
    out = None
    for i in sampled:
        part = F.transform(F.get(hs, i), lambda x: x.cast("double") * (math.exp(alpha[i] - top) / mass))  # noqa: B023
        out = part if out is None else F.zip_with(out, part, lambda x, y: x + y)
    return out
