"""Propagated features kept from session to session, found again by what they were made of.

An entry's key is a digest of its metapath, of the content of every edge table along
it and of the features at its start, so a changed input misses and the same input
under any path hits.  Features are asked for by metapath: the longest prefix that is
kept is read, only the rest is multiplied, and what was asked for is kept in turn.

Entries are folders, written under a temporary name and renamed when whole; of two
writers of one entry the second finds it there.  Each holds a small file that says
what it is, with the whole digests; names have the first digits of them only.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..graph import HinGraph
from ..sources import folders
from ..types import CEType, Metapath, in_prefix_order
from . import linalg
from .propagate import slots

ABOUT = "_about.json"

#: Characters of an entry's name at most.
NAME_LENGTH = 40


def digest(of) -> str:
    return hashlib.sha1(json.dumps(of, sort_keys=True).encode()).hexdigest()


def fingerprint(table: DataFrame) -> str:
    """A digest of a table's rows as a multiset, whatever their order and partitions, and of its columns.

    One aggregation over the table: its count and two sums of row hashes.  Sums of
    floating-point numbers that are computed anew may differ in their last digits from
    run to run; name a version of such a table instead.
    """
    columns = sorted(table.columns)
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    row = table.agg(F.count("*"), wide(F.xxhash64(*columns)), wide(F.xxhash64(F.lit(17), *columns))).first()
    return digest([[c, table.schema[c].dataType.simpleString()] for c in columns] + [str(x) for x in row])


class FeatureCache:
    """Entries in a folder that all machines share.

    ``versions`` names the state of an edge type (by its name) or of a node type's
    features, which then aren't scanned for a fingerprint.  ``made`` lists the edge
    types that were multiplied, ``found`` the entries that were read.
    """

    def __init__(self, spark: SparkSession, folder: str, versions: dict[str, str] | None = None):
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), versions or {}
        self.made: list[CEType] = []
        self.found: list[str] = []
        self._prints: dict[int, tuple[DataFrame, str]] = {}
        self._held: dict[str, DataFrame] = {}

    # ---- entries

    def _print(self, name: str, table: DataFrame) -> str:
        if name in self.versions:
            return f"version {self.versions[name]}"
        if id(table) not in self._prints:
            self._prints[id(table)] = (table, fingerprint(table))
        return self._prints[id(table)][1]

    def _names(self, about: dict):
        """The names an entry may have: a clash of the short digests goes on to the next."""
        short = re.sub(r"[^A-Za-z0-9_.]+", "-", about["alias"])
        name = f"{digest(about['path'])[:8]}{digest(about['feats'])[:4]}-{short}"[:NAME_LENGTH]
        yield name
        for k in range(1, 1000):
            yield f"{name[: NAME_LENGTH - 4]}~{k}"

    def _about(self, name: str) -> dict | None:
        path = f"{self.folder}/{name}/{ABOUT}"
        return json.loads(folders.read_text(self.spark, path)) if folders.exists(self.spark, path) else None

    def get(self, about: dict) -> DataFrame | None:
        """The kept table: of this session, else of the folder, else none."""
        key = about["key"]
        if key in self._held:
            return self._held[key]
        for name in self._names(about):
            known = self._about(name)
            if known is None:
                return None
            if known["key"] == key:
                self.found.append(name)
                self._held[key] = self.spark.read.parquet(f"{self.folder}/{name}")
                return self._held[key]
        return None

    def put(self, about: dict, table: DataFrame) -> DataFrame:
        """Write an entry, or find that it has come to be there, and read it."""
        temporary = f"{self.folder}/_temporary-{uuid.uuid4().hex}"
        table.write.parquet(temporary)
        folders.write_text(self.spark, f"{temporary}/{ABOUT}", json.dumps(about))
        for name in self._names(about):
            known = self._about(name)
            if known is None and folders.committed(self.spark, temporary, f"{self.folder}/{name}"):
                break
            if (known or self._about(name) or {}).get("key") == about["key"]:
                folders.removed(self.spark, temporary)
                break
            if not folders.exists(self.spark, temporary):
                raise RuntimeError(f"another writer took the name {name} at the same time; ask again")
        self._held[about["key"]] = self.spark.read.schema(table.schema).parquet(f"{self.folder}/{name}")
        return self._held[about["key"]]

    def entries(self) -> list[dict]:
        """What each entry is, with its name and bytes: the index of the folder."""
        out = []
        for name in folders.listed(self.spark, self.folder):
            if not name.startswith("_") and (about := self._about(name)):
                out.append({"name": name, "bytes": folders.size(self.spark, f"{self.folder}/{name}"), **about})
        return out

    def write_index(self) -> str:
        """A file of the folder with the metapath of every key; entries stay what they are without it."""
        path = f"{self.folder}/_index.json"
        folders.write_text(self.spark, path, json.dumps({e["key"]: {"name": e["name"], "path": e["path"], "alias": e["alias"]} for e in self.entries()}, indent=1))
        return path

    def ls(self, paths: list[Metapath]) -> list[dict]:
        """The entries of these metapaths, whatever they were made of."""
        wanted = [[list(c) for c in p if not c.is_self_loop] for p in paths]
        return [e for e in self.entries() if [s["etype"] for s in e["path"]] in wanted]

    # ---- features along metapaths

    def features(self, graph: HinGraph, feats: dict[str, DataFrame], paths: list[Metapath], normalize: bool = True, alias: Callable[[Metapath], str] | None = None) -> dict[Metapath, DataFrame]:
        """Each metapath's features, edge weights normalised by row or as they are."""
        alias = alias or (lambda p: "-".join(c.etype for c in p if not c.is_self_loop))
        trimmed = {p: tuple(c for c in p if not c.is_self_loop) for p in paths}
        nexts: dict[Metapath, set[Metapath]] = {}
        for t in {t[:k] for t in trimmed.values() for k in range(1, len(t) + 1)}:
            nexts.setdefault(t[:-1], set()).add(t)
        kept = {*trimmed.values(), *(t for t, more in nexts.items() if len(more) > 1)}

        def about(source: str, path: Metapath) -> dict:
            steps = [{"etype": list(c), "print": self._print(c.etype, graph.edges[c])} for c in path]
            out = {"path": steps, "feats": [source, self._print(source, feats[source])], "normalize": normalize}
            return {**out, "key": digest(out), "alias": alias(path)}

        products: dict[Metapath, DataFrame] = {}

        def product(source: str, path: Metapath) -> DataFrame:
            if not path:
                return feats[source]
            if path not in products:
                what = about(source, path)
                found = self.get(what)
                if found is None:
                    before, adj = product(source, path[:-1]), linalg.adjacency(graph.edges[path[-1]])
                    found = linalg.apply(linalg.row_normalized(adj) if normalize else adj, before)
                    self.made.append(path[-1])
                    if path in kept:
                        found = self.put(what, found)
                products[path] = found
            return products[path]

        return {p: product(p[0].src, trimmed[p]) for p in in_prefix_order(paths)}

    # ---- features of every type from every featured type

    def slots(self, graph: HinGraph, feats: dict[str, DataFrame], max_hops: int = 99, reduce: str = "mean") -> dict[str, DataFrame]:
        """As :func:`propagate.slots`, an entry for each node type, all made of the whole graph and its features."""
        steps = [{"etype": list(c), "print": self._print(c.etype, graph.edges[c])} for c in sorted(graph.edges)]
        made_of = {"path": steps, "feats": [[n, self._print(n, feats[n])] for n in sorted(feats)], "hops": max_hops, "reduce": reduce}
        out, made = {}, None
        for n in graph.nodes:
            about = {**made_of, "of": n, "alias": f"slots-{n}"}
            about["path"] = [{"etype": ["slots", n, reduce], "print": digest(steps)}]
            about["key"] = digest({k: v for k, v in about.items() if k != "alias"})
            found = self.get(about)
            if found is None:
                if made is None:
                    made = slots(graph, feats, max_hops, reduce)
                if n not in made:
                    continue
                found = self.put(about, made[n])
            out[n] = found
        return out
