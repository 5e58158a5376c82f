"""Self-attention inside bounded node sequences, with relation encodings of the nodes' types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import bound, dot, leaky_relu, matvec
from .layers import vector_sum


def degree_conv(edges: DataFrame, nodes: DataFrame, weight: list[list[float]] | None = None, bias: list[float] | None = None, scale: dict[int, float] | None = None, relu: bool = True) -> DataFrame:
    """Sum of in-neighbours' vectors over the roots of both ends' degrees, at least 1.

    ``weight`` (out x in) is applied at the nodes, before they are joined to edges.
    ``scale`` is a factor for each type of a source node, whose table then has
    ``type``: the relation encoding.  A node without in-edges gets the bias alone.
    """
    out = edges.groupBy(F.col("src").alias("nid")).agg(F.count("*").alias("o"))
    into = edges.groupBy(F.col("dst").alias("nid")).agg(F.count("*").alias("d"))
    h = F.col("h") if weight is None else matvec(weight, F.col("h"))
    factor = F.pow(F.greatest(F.coalesce("o", F.lit(1)), F.lit(1)).cast("double"), F.lit(-0.5))
    if scale is not None:
        factor = factor * F.create_map(*(F.lit(x) for pair in scale.items() for x in pair))[F.col("type")]
    sent = nodes.join(out, "nid", "left").select(F.col("nid").alias("src"), h.alias("m"), factor.alias("f"))
    sums = vector_sum(edges.join(sent, "src").select("dst", F.col("m").alias("h"), "f"), "dst", "h", F.col("f"))
    both = nodes.select("nid", *(["type"] if scale is not None else [])).join(sums.withColumnRenamed("dst", "nid"), "nid", "left").join(into, "nid", "left")
    if weight is None:  # the width of the vectors themselves
        both = both.join(nodes.select("nid", F.size("h").alias("__w")), "nid")
    zeros = F.array_repeat(F.lit(0.0), F.col("__w") if weight is None else F.lit(len(weight)))
    base = F.transform(F.coalesce("h", zeros), lambda x: x * F.pow(F.greatest(F.coalesce("d", F.lit(1)), F.lit(1)).cast("double"), F.lit(-0.5)))
    if bias is not None:
        base = F.zip_with(base, F.array(*map(F.lit, bias)), lambda x, y: x + y)
    if relu:
        base = F.transform(base, lambda x: F.greatest(x, F.lit(0.0)))
    return both.select("nid", *(["type"] if scale is not None else []), base.alias("h"))


def gathered(sequences: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(nid, items): each sequence with its nodes' vectors h and relation encodings r, in order; empty places are left out.

    A row holds as many items as a sequence has places, a parameter of
    :func:`sample.node_sequences`; vectors are joined to places, not to sequences.
    """
    places = sequences.select("nid", F.posexplode("seq").alias("pos", "at")).where("at is not null")
    filled = places.join(nodes.select(F.col("nid").alias("at"), "h"), "at").join(relations.select(F.col("nid").alias("at"), F.col("h").alias("r")), "at")
    return filled.groupBy("nid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h", "r"))), lambda x: F.struct(x["h"].alias("h"), x["r"].alias("r"))).alias("items"))


def _layer_norm(h: Column, gain: list[float], bias: list[float], eps: float = 1e-5) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    centred = bound(h, lambda v: bound(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m)))

    def scaled(c: Column) -> Column:
        deviation = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) / F.size(c) + eps)
        return bound(deviation, lambda d: F.zip_with(F.zip_with(c, F.array(*map(F.lit, gain)), lambda x, g: x / d * g), F.array(*map(F.lit, bias)), lambda x, b: x + b))

    return bound(centred, scaled)


def sequence_attention(rows: DataFrame, left: list[list[float]], right: list[list[float]], att_left: list[list[float]], att_right: list[list[float]], source: list[list[list[float]]], target: list[list[list[float]]], out: list[list[float]], gain: list[float], bias: list[float], beta: float = 1.0, temper: float = 1.0, slope: float = 0.01) -> DataFrame:
    """(nid, items) of (nid, items): every place attends to every place of its own sequence.

    A head's score of places i and j is att_left · leaky(left h_i) + att_right ·
    leaky(right h_j) + beta · (source r_i) · (target r_j), over the temper; its softmax
    over j weighs right h_j.  Heads are put side by side, mapped by ``out``, added to h
    and normalised.  All is done inside a row; relation encodings go on unchanged.
    A place's parts of the scores are made before places meet, and what a formula names
    twice is bound, so that work grows with the pairs of places and nothing is made again.
    """
    heads, width = len(att_left), len(left) // len(att_left)
    part = lambda v, k: F.slice(v, k * width + 1, width)
    lit = lambda v: F.array(*map(F.lit, v))

    def side(x: Column) -> Column:
        leaky = lambda v: F.transform(v, lambda y: leaky_relu(y, slope))
        mine = bound(leaky(matvec(left, x["h"])), lambda v: F.array(*(dot(part(v, k), lit(att_left[k])) for k in range(heads))))
        theirs = bound(matvec(right, x["h"]), lambda v: F.array(*(F.struct(dot(leaky(part(v, k)), lit(att_right[k])).alias("a"), part(v, k).alias("f")) for k in range(heads))))
        return F.struct(
            x["h"].alias("h"),
            x["r"].alias("r"),
            mine.alias("l"),
            theirs.alias("k"),
            F.array(*(matvec(m, x["r"]) for m in source)).alias("s"),
            F.array(*(matvec(m, x["r"]) for m in target)).alias("t"),
        )

    def context(p: Column, x: Column, k: int) -> Column:
        score = lambda y: (F.get(x["l"], k) + F.get(y["k"], k)["a"] + beta * dot(F.get(x["s"], k), F.get(y["t"], k))) / temper
        scored = F.transform(p, lambda y: F.struct(score(y).alias("x"), F.get(y["k"], k)["f"].alias("v")))
        zero = F.struct(F.lit(0.0).alias("m"), F.array_repeat(F.lit(0.0), width).alias("v"))
        weighed = lambda s: bound(F.array_max(F.transform(s, lambda y: y["x"])), lambda top: F.transform(s, lambda y: F.struct(F.exp(y["x"] - top).alias("e"), y["v"].alias("v"))))
        add = lambda s, y: F.struct((s["m"] + y["e"]).alias("m"), F.zip_with(s["v"], y["v"], lambda a, b: a + y["e"] * b).alias("v"))
        return F.aggregate(bound(scored, weighed), zero, add, lambda s: F.transform(s["v"], lambda v: v / s["m"]))

    def done(p: Column, x: Column) -> Column:
        mapped = matvec(out, F.concat(*(context(p, x, k) for k in range(heads))))
        return F.struct(_layer_norm(F.zip_with(x["h"], mapped, lambda a, b: a + b), gain, bias).alias("h"), x["r"].alias("r"))

    return rows.select("nid", bound(F.transform("items", side), lambda p: F.transform(p, lambda x: done(p, x))).alias("items"))


def first_places(rows: DataFrame) -> DataFrame:
    """(nid, h): the vector at the first place, the node's own."""
    return rows.select("nid", F.get("items", 0)["h"].alias("h"))
