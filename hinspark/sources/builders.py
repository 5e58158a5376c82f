"""Networks from raw folders, by declaration: one interpreter reads, slices, names, inverts, atomizes and splits."""

from __future__ import annotations

import functools
import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..graph import HinGraph, Tables, reversed_edges
from ..operators import atomize, linalg, prepare, sample
from ..operators.features import identity
from ..plans.selection import Selection, refined
from ..types import CEType
from . import folders, hgb, specs
from .specs import Block, Spec


@dataclass(frozen=True)
class Built:
    """A network with the features of its node types, lazily.

    For links ``graph`` has the training edges, and ``val``, ``test`` and
    ``test_negatives`` the others over the same nodes.
    """

    graph: HinGraph
    feats: Mapping[str, DataFrame]
    val: HinGraph | None = None
    test: HinGraph | None = None
    test_negatives: HinGraph | None = None
    slots: Mapping[str, DataFrame] = field(default_factory=dict)


class _Reader:
    """The tables of a folder, each scanned for its few statistics once."""

    def __init__(self, spark: SparkSession, folder: str, spec: Spec, seed: int):
        self.spark, self.folder, self.spec, self.seed = spark, folder.rstrip("/"), spec, seed

    @functools.cached_property
    def nodes(self) -> DataFrame:
        return hgb.nodes(self.spark, hgb.find(self.spark, self.folder, "node"))

    @functools.cached_property
    def links(self) -> DataFrame:
        return hgb.links(self.spark, hgb.find(self.spark, self.folder, "link"))

    @functools.cached_property
    def ranges(self) -> dict[str, tuple[int, int]]:
        """First global id and number of nodes of each type; a row for each type reaches the driver."""
        names = list(self.spec.ntypes)
        if folders.exists(self.spark, f"{self.folder}/info.dat"):
            given = json.loads(folders.read_text(self.spark, f"{self.folder}/info.dat"))["node.dat"]["node type"]
            names = [specs.RENAMED.get(given[str(k)], given[str(k)]) for k in range(len(given))]
        found = {r.type: (r["shift"], r.n) for r in hgb.node_stats(self.nodes).collect()}
        if sorted(found) != list(range(len(names))) or sorted(names) != sorted(self.spec.ntypes):
            raise ValueError(f"the folder has node types {sorted(found)}, the declaration {self.spec.ntypes}, named {names}")
        return {n: found[k] for k, n in enumerate(names)}

    def _number(self, ntype: str) -> int:
        return list(self.ranges).index(ntype)

    def _labels(self) -> DataFrame:
        whole = folders.exists(self.spark, f"{self.folder}/label.dat") and folders.exists(self.spark, f"{self.folder}/label.dat.test")
        return hgb.hgb_labels(self.spark, self.folder) if whole else hgb.split_labels(self.spark, self.folder)

    def node_table(self, ntype: str) -> DataFrame:
        shift = self.ranges[ntype][0]
        own = self.nodes.where(F.col("type") == self._number(ntype)).select("id", (F.col("id") - shift).alias("nid"))
        if ntype != self.spec.target:
            return own.select("nid")
        labels = self._labels()
        if self.spec.labels == "multi":
            width = hgb.n_classes(labels).first()[0] or 0
            known = hgb.multi_hot(labels, width).select("id", F.col("y").alias("label"), "split")
        else:
            known = labels.select("id", F.array_min("labels").cast("long").alias("label"), "split")
        out = own.join(known, "id", "left").select("nid", "label", "split")
        return out.fillna({"label": -1}) if self.spec.labels == "single-or-minus-one" else out

    def attributes(self, ntype: str) -> DataFrame:
        """(nid, col, val) of the attributes that aren't 0; none where the type has no attributes."""
        shift = self.ranges[ntype][0]
        rows = self.nodes.where(F.col("type") == self._number(ntype)).select((F.col("id") - shift).alias("nid"), F.posexplode("attr").alias("col", "val"))
        return rows.where("val <> 0")

    @functools.cached_property
    def widths(self) -> dict[str, int]:
        """Attributes of each type; a row for each type reaches the driver."""
        per = {r.type: r.w for r in self.nodes.groupBy("type").agg(F.max(F.size("attr")).alias("w")).collect()}
        return {n: max(per[k] or 0, 0) for k, n in enumerate(self.ranges)}

    def edge_table(self, src: str, dst: str, links: DataFrame) -> DataFrame:
        """Local (src, dst) of links between two types, repeated ones added up and zeros left out."""
        (a, n), (b, m) = self.ranges[src], self.ranges[dst]
        inside = links.where(F.col("head").between(a, a + n - 1) & F.col("tail").between(b, b + m - 1))
        summed = inside.groupBy("head", "tail").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w")).where("w <> 0")
        return summed.select((F.col("head") - a).alias("src"), (F.col("tail") - b).alias("dst"))

    def edges(self, number: int) -> DataFrame:
        r = self.spec.relations[number]
        links = self.links
        if self.spec.layout == "numbered":
            assert self.relations_checked
            links = links.where(F.col("rel") == number)
        return self.edge_table(r.src, r.dst, links)

    @functools.cached_property
    def relations_checked(self) -> bool:
        """Each relation number must join the node types it is declared for, or else it's an error."""
        names = list(self.ranges)
        for r in hgb.link_stats(self.links, self.nodes).collect():
            found = (names[r.head_type], names[r.tail_type])
            if r.rel >= len(self.spec.relations) or found != (self.spec.relations[r.rel].src, self.spec.relations[r.rel].dst):
                raise ValueError(f"relation {r.rel} joins {found}, which isn't declared")
        return True

    def features(self, ntype: str) -> DataFrame:
        """(nid, slot, col, val): the attributes, or the identity where the type has none."""
        if self.widths[ntype] == 0:
            return identity(self.node_table(ntype), ntype)
        return self.attributes(ntype).select("nid", F.lit(ntype).alias("slot"), "col", "val")


class _FolderReader(_Reader):
    """A folder with one file for each relation, and for features, labels and splits of the target, rows being node ids."""

    def _file(self, path: str) -> str:
        for ending in (".csv", ".csv.gz"):
            if folders.exists(self.spark, f"{self.folder}/{path}{ending}"):
                return f"{self.folder}/{path}{ending}"
        raise FileNotFoundError(f"{self.folder}/{path}.csv")

    def _rows(self, path: str) -> DataFrame:
        """(nid, f): the fields of each line; the line's number is the node."""
        return hgb.numbered_lines(self.spark, self._file(path)).select(F.col("line_no").alias("nid"), F.split("value", ",").alias("f"))

    @functools.cached_property
    def ranges(self) -> dict[str, tuple[int, int]]:
        row = self.spark.read.option("header", True).csv(self._file("raw/num-node-dict")).first().asDict()
        return {n: (0, int(row[n])) for n in self.spec.ntypes}

    def node_table(self, ntype: str) -> DataFrame:
        nodes = self.spark.range(self.ranges[ntype][1]).select(F.col("id").alias("nid"))
        if ntype != self.spec.target:
            return nodes
        labels = self._rows(f"raw/node-label/{ntype}/node-label").select("nid", F.get("f", 0).cast("double").cast("long").alias("label"))
        parts = [self.spark.read.schema("nid long").csv(self._file(f"split/time/{ntype}/{f}")).withColumn("split", F.lit(s)) for f, s in (("train", "train"), ("valid", "val"), ("test", "test"))]
        splits = functools.reduce(DataFrame.unionByName, parts)
        return nodes.join(labels, "nid", "left").join(splits, "nid", "left")

    def attributes(self, ntype: str) -> DataFrame:
        return self._rows(f"raw/node-feat/{ntype}/node-feat").select("nid", F.posexplode(F.transform("f", lambda x: x.cast("double"))).alias("col", "val")).where("val <> 0")

    @functools.cached_property
    def widths(self) -> dict[str, int]:
        per = self._rows(f"raw/node-feat/{self.spec.target}/node-feat").agg(F.max(F.size("f"))).first()[0] or 0
        return {n: per if n == self.spec.target else 0 for n in self.spec.ntypes}

    def edges(self, number: int) -> DataFrame:
        r = self.spec.relations[number]
        return self.spark.read.schema("src long, dst long").csv(self._file(f"raw/relations/{r.src}___{r.name}___{r.dst}/edge"))

    def years(self, ntype: str) -> DataFrame:
        """(nid, year, split)."""
        years = self._rows(f"raw/node-feat/{ntype}/node_year").select("nid", F.get("f", 0).cast("double").cast("int").alias("year"))
        return years.join(self.node_table(ntype).select("nid", "split"), "nid")


def _atomized(reader: _Reader, block: Block):
    """(nodes, forward edges, backward edges) of a block, each made when asked for."""
    width = functools.cache(lambda: (reader.widths[block.of] if block.high is None else block.high) - block.low)
    count = lambda: reader.ranges[block.of][1]

    def cells() -> DataFrame:
        inside = F.col("col") >= block.low if block.high is None else F.col("col").between(block.low, block.high - 1)
        return reader.attributes(block.of).where(inside).select("nid", (F.col("col") - block.low).cast("long").alias("col"), "val")

    def weighted(per: str, table: DataFrame) -> DataFrame:
        there = table.select(F.col("nid").alias("src"), F.col("col").alias("dst"), F.col("val").alias("weight"))
        return there if per == "col" else reversed_edges(there)

    if block.kind == "one-hot":
        n, forward = width, lambda: atomize.one_hot_block(cells())
        backward = lambda: reversed_edges(forward())
    elif block.kind == "words":
        n, forward, backward = width, lambda: weighted("col", linalg.normalized_bow(cells(), "col")), lambda: weighted("nid", linalg.normalized_bow(cells(), "nid"))
    elif block.kind in ("numbers", "with-mean"):

        def numbers() -> DataFrame:
            if block.kind == "numbers":
                return cells()
            # a missing cell is a 0, which counts for the mean and gets an edge like any other
            ids = reader.node_table(block.of).select("nid")
            one = ids.join(cells().where("col = 0").select("nid", "val"), "nid", "left").select("nid", F.coalesce("val", F.lit(0.0)).alias("v"))
            return atomize.with_mean_column(one, "nid", "v").select(F.col("row").alias("nid"), F.col("col").cast("long").alias("col"), F.col("weight").alias("val"))

        n = width if block.kind == "numbers" else lambda: 2
        forward = lambda: weighted("col", linalg.normalized_numeric(numbers(), count(), "col"))
        backward = lambda: weighted("nid", linalg.normalized_numeric(numbers(), n(), "nid"))
    elif block.kind == "train-year":
        rows = lambda: reader.years(block.of).where("split = 'train'")
        n = lambda: (lambda r: 0 if r[0] is None else r[1] - r[0] + 1)(rows().agg(F.min("year"), F.max("year")).first())
        forward = lambda: atomize.train_range(rows(), "nid", "year", F.col("split"))
        backward = lambda: reversed_edges(forward())
    else:
        raise ValueError(block.kind)
    return (lambda: reader.spark.range(n()).select(F.col("id").alias("nid"))), forward, backward


def build(spark: SparkSession, folder: str, spec: Spec, seed: int = 0) -> Built:
    """The network of a raw folder; nothing but statistics of types is read until a table is asked for."""
    reader = (_FolderReader if spec.layout == "folders" else _Reader)(spark, folder, spec, seed)
    nodes = {n: functools.partial(reader.node_table, n) for n in spec.ntypes}
    forward = {CEType(r.src, r.name, r.dst): functools.partial(reader.edges, k) for k, r in enumerate(spec.relations)}
    back = {CEType(r.src, r.name, r.dst): CEType(r.dst, r.inverse, r.src) for r in spec.relations}
    feats = Tables({n: functools.partial(reader.features, n) for n in spec.ntypes})
    if spec.held:
        return _links(reader, spec, nodes, forward, back, feats)
    return Built(_with_blocks(reader, spec, _both_ways(nodes, Tables(forward), back, spec.target)), feats)


def _both_ways(nodes, forward: Tables, back: dict[CEType, CEType], target: str | None) -> HinGraph:
    turned = {back[c]: functools.partial(lambda c: reversed_edges(forward[c]), c) for c in forward if c in back}
    inverse = {c: back[c] for c in forward if c in back}
    return HinGraph(nodes, forward | turned, inverse | {b: a for a, b in inverse.items()}, target)


def _with_blocks(reader: _Reader, spec: Spec, graph: HinGraph) -> HinGraph:
    nodes, edges, inverse = {}, {}, dict(graph.inverse)
    for b in spec.blocks:
        a, z = CEType(b.of, b.forward, b.to), CEType(b.to, b.backward, b.of)
        nodes[b.to], edges[a], edges[z] = _atomized(reader, b)
        inverse |= {a: z, z: a}
    return replace(graph, nodes=graph.nodes | nodes, edges=graph.edges | edges, inverse=inverse)


def _links(reader: _Reader, spec: Spec, nodes, forward, back, feats) -> Built:
    """Training, validation and test edges, and test negatives: pairs two links apart that aren't linked."""
    whole = Tables(forward)
    split = functools.cache(lambda c: sample.split_links(whole[c], 0.9, reader.seed))
    side = lambda name: Tables({c: functools.partial(lambda c: split(c).where(F.col("split") == name).select("src", "dst"), c) for c in forward})
    train, val = (_both_ways(nodes, side(name), back, spec.target) for name in ("train", "val"))
    for name in spec.symmetric:
        c = next(c for c in forward if c.etype == name)
        train, val = train.merged(c, back[c]), val.merged(c, back[c])
    if spec.moved_to_train:
        train, val = prepare.others_to_train(train, val, spec.held)
    numbers = {c: k for k, c in enumerate(forward) if c.etype in spec.held}
    held = functools.cache(lambda: hgb.links(reader.spark, f"{reader.folder}/link.dat.test"))
    test = {c: functools.partial(lambda c, k: reader.edge_table(c.src, c.dst, held().where(F.col("rel") == k)), c, k) for c, k in numbers.items()}

    def negatives(c: CEType, k: int) -> DataFrame:
        """As many for each head as it has test edges, drawn from its candidates of the tails' type."""
        (a, _), (b, m) = reader.ranges[c.src], reader.ranges[c.dst]
        known = reader.links.select(F.col("head").alias("src"), F.col("tail").alias("dst")).unionByName(held().select(F.col("head").alias("src"), F.col("tail").alias("dst")))
        positives = Tables(test)[c].select((F.col("src") + a).alias("src"))
        candidates = sample.two_hop_candidates(known, positives, (b, b + m))
        drawn = sample.drawn(candidates, positives.groupBy("src").agg(F.count("*").alias("n")), reader.seed)
        return drawn.select((F.col("src") - a).alias("src"), (F.col("dst") - b).alias("dst"))

    wrong = {c: functools.partial(negatives, c, k) for c, k in numbers.items()}
    graph = _with_blocks(reader, spec, train)
    return Built(graph, feats, val, HinGraph(nodes, test), HinGraph(nodes, wrong))


#: Every network by name: its declaration as released, and with its attributes as node types.
REGISTRY: dict[str, Spec] = {
    "imdb": specs.IMDB,
    "dblp": specs.DBLP,
    "acm": specs.ACM,
    "freebase": specs.FREEBASE,
    "mag": specs.MAG,
    "amazon": specs.AMAZON,
    "lastfm": specs.LASTFM,
    "pubmed": specs.PUBMED,
    "atomic-imdb": replace(specs.IMDB, blocks=specs.IMDB_BLOCKS),
    "atomic-dblp": replace(specs.DBLP, blocks=specs.DBLP_BLOCKS),
    "atomic-acm": specs.ACM,
    "atomic-freebase": specs.FREEBASE,
    "atomic-mag": replace(specs.MAG, blocks=specs.MAG_BLOCKS),
    "atomic-lastfm": specs.LASTFM,
    "atomic-amazon": replace(specs.AMAZON, blocks=specs.AMAZON_BLOCKS),
    "atomic-pubmed": replace(specs.PUBMED, blocks=specs.PUBMED_BLOCKS),
}


def profiles(name: str) -> list[str]:
    """The profiles of a network, the default first."""
    if name not in REGISTRY:
        raise ValueError(f"unknown network {name}: one of {', '.join(REGISTRY)}")
    return ["atomic", "refined"] if name.startswith("atomic-") else ["vanilla"]


def dataset(spark: SparkSession, name: str, folder: str, profile: str | None = None, remove_unreachable: bool | None = None, seed: int = 0, **switches: bool) -> Built:
    """A network by name and profile.

    ``vanilla`` takes no switches; ``atomic`` has every edge type and features of no
    node type unless switches say so; ``refined`` starts from a known selection, which
    switches change.  Selected node types' features propagate along all edges and come
    as ``slots``.  Node types that don't reach the target go, unless
    ``remove_unreachable`` is off; networks for links have no target, so to ask for it
    is an error there.
    """
    profile = profile or profiles(name)[0]
    if profile not in profiles(name):
        raise ValueError(f"{name} has no profile {profile}: one of {', '.join(profiles(name))}")
    built = build(spark, folder, REGISTRY[name], seed)
    if profile == "vanilla" and switches:
        raise ValueError(f"{name} can't be refined; atomic-{name} can")
    if built.graph.target is None and remove_unreachable:
        raise ValueError("a network for links has no target that types could reach")
    preset = {}
    if profile == "refined":
        known = specs.REFINED[name]
        preset = {**dict.fromkeys(known["on"].split(), True), **dict.fromkeys(known["off"].split(), False)}
    if profile != "vanilla":
        graph, feats = refined(built.graph, Selection.of(built.graph, preset | switches))
        built = replace(built, graph=graph, slots=feats)
    if built.graph.target is not None and remove_unreachable is not False:
        graph = built.graph.of_meta(built.graph.meta.pruned(built.graph.target))
        built = replace(built, graph=graph, slots={n: f for n, f in built.slots.items() if n in graph.nodes})
    return built
