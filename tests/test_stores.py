"""Features by row, features kept from session to session, and rows made on demand."""

import glob
import json
from dataclasses import replace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hinspark.operators import cache, features, linalg, propagate
from hinspark.operators.cache import FeatureCache
from hinspark.queries_stores import customer_metapaths
from hinspark.sources import folders, rowstore
from hinspark.sources.relational import commerce


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def near(df):
    return {tuple(r[:-1]): r[-1] for r in df.collect()}


# ---- rows


@pytest.fixture(scope="module")
def cells(spark):
    return spark.range(2000).select(
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("mp"), F.col("id").alias("nid"), F.lit("s").alias("slot"), F.explode(F.array(F.lit(0), (F.col("id") % 7 + 1).cast("int"))).alias("col"), (F.col("id") / 4).alias("val")
    ).where("mp = 'a' or nid % 3 = 0")


@pytest.fixture(scope="module")
def store(cells, tmp_path_factory):
    return rowstore.RowStore.write(cells, f"file://{tmp_path_factory.mktemp('s')}/store", file_rows=150, group_bytes=4096)


def test_store_gives_back_what_it_was_given(store, cells):
    assert rows(rowstore.cells_of(store.all())) == rows(cells)
    assert rows(rowstore.cells_of(store.between(10, 400, ["b"]))) == rows(cells.where("nid between 10 and 400 and mp = 'b'"))
    assert store.between(3000, 4000).count() == 0 and store.between(5, 4).count() == 0


def test_range_reads_few_files(store):
    part = store.between(700, 760)
    assert 1 <= len(part.inputFiles()) <= 3 < len(store.all().inputFiles())
    plan = part._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(nid,700)" in plan
    files = store.index.collect()
    assert sum(f.n for f in files) == 2000 and all(f.n <= 150 for f in files)
    spans = sorted((f.low, f.high) for f in files)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_row_groups_of_a_file_are_ranges(cells, tmp_path):
    s = rowstore.RowStore.write(cells.coalesce(1), f"file://{tmp_path}/store", group_bytes=1024)
    spans = []
    for path in glob.glob(f"{tmp_path}/store/rows/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        at = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == "nid")
        spans += [(meta.row_group(k).column(at).statistics.min, meta.row_group(k).column(at).statistics.max) for k in range(meta.num_row_groups)]
    spans.sort()
    assert len(spans) > 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and s.all().count() == 2000


def test_store_is_written_with_one_shuffle(cells):
    ranges = cells.select("mp", "nid", F.struct("slot", "col", "val").alias("cell")).repartitionByRange("nid")
    plan = ranges.groupBy("nid", "mp").agg(F.collect_list("cell").alias("v")).groupBy("nid").agg(F.collect_list("v")).sortWithinPartitions("nid")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_batches_and_wanted_rows(store, spark, cells):
    assert sorted(r.nid for r in store.batch(3, 100).collect()) == list(range(300, 400))
    wanted = spark.createDataFrame([(5,), (5,), (1999,), (99_999,), (None,)], "nid long")
    assert rows(rowstore.cells_of(store.rows(wanted))) == rows(cells.where("nid in (5, 1999)"))
    assert store.rows(wanted.where("nid is null")).count() == 0


def test_a_store_is_not_written_over(store, cells):
    with pytest.raises(FileExistsError):
        rowstore.RowStore.write(cells, store.path)


def test_an_empty_store(spark, cells, tmp_path):
    s = rowstore.RowStore.write(cells.where("nid < 0"), f"file://{tmp_path}/store")
    assert s.all().count() == 0 and s.between(0, 10).count() == 0


# ---- kept features


def of(g, *names):
    return tuple(g.meta.canonical(n) for n in names)


@pytest.fixture
def kept(spark, sf_dir, tmp_path):
    g = commerce(spark, sf_dir)
    feats = {"brand": features.identity(g.nodes["brand"], "brand")}
    return g, feats, f"file://{tmp_path}/cache"


def test_second_run_multiplies_nothing(spark, kept):
    g, feats, folder = kept
    long, short = of(g, "brand-of", "in-order", "placed-by"), of(g, "brand-of", "in-order")
    first = FeatureCache(spark, folder)
    a = first.features(g, feats, [long, short])
    assert len(first.made) == 3 and first.found == []
    again = FeatureCache(spark, folder)
    b = again.features(commerce(spark, "/root/testdata/sf0.001"), feats, [long, short])
    assert again.made == [] and len(again.found) == 2
    direct = propagate.MetapathFeatures(linalg.row_normalized_adjacencies(g.edges, set(long)), feats, persist=False).build([long, short])
    for p in (long, short):
        assert near(a[p]) == pytest.approx(near(direct[p])) and near(b[p]) == near(a[p])


def test_longest_kept_prefix_is_read(spark, kept):
    g, feats, folder = kept
    FeatureCache(spark, folder).features(g, feats, [of(g, "brand-of", "in-order")])
    more = FeatureCache(spark, folder)
    more.features(g, feats, [of(g, "brand-of", "in-order", "placed-by")])
    assert more.made == [g.meta.canonical("placed-by")] and len(more.found) == 1


def test_branching_prefixes_are_kept_too(spark, kept):
    g, feats, folder = kept
    c = FeatureCache(spark, folder)
    c.features(g, feats, [of(g, "brand-of", "in-order", "placed-by"), of(g, "brand-of", "in-order", "contains")])
    assert len(c.made) == 4 and len(c.entries()) == 3


def test_changed_inputs_miss(spark, kept):
    g, feats, folder = kept
    path = of(g, "brand-of", "in-order")
    FeatureCache(spark, folder).features(g, feats, [path, path[:1]])
    e = g.edge("in-order")
    for change in (e.where("src > 1"), e.withColumn("weight", F.col("weight") + 1), e.unionByName(e.limit(1))):
        other = FeatureCache(spark, folder)
        other.features(replace(g, edges=g.edges | {path[1]: change}), feats, [path])
        assert other.made == [path[1]] and len(other.found) == 1  # the prefix is still there
    moved = FeatureCache(spark, folder)
    moved.features(g, {"brand": feats["brand"].withColumn("val", F.lit(2.0))}, [path])
    assert len(moved.made) == 2
    bare = FeatureCache(spark, folder)
    bare.features(g, feats, [path], normalize=False)
    assert len(bare.made) == 2


def test_fingerprints_are_of_rows(spark):
    t = spark.createDataFrame([(1, "a", 0.5), (2, None, None), (2, None, None)], "i long, s string, x double")
    same = cache.fingerprint(t)
    assert cache.fingerprint(t.repartition(3).select("x", "s", "i")) == same
    for other in (t.limit(2), t.union(t.limit(1)), t.withColumn("i", F.col("i").cast("int")), t.withColumnRenamed("s", "t"), t.where("i > 5")):
        assert cache.fingerprint(other) != same


def test_named_versions_are_not_scanned(spark, kept, monkeypatch):
    g, feats, folder = kept
    path = of(g, "brand-of", "in-order")
    monkeypatch.setattr(cache, "fingerprint", lambda t: pytest.fail("scanned"))
    names = {"brand-of": "1", "in-order": "1", "brand": "1"}
    FeatureCache(spark, folder, names).features(g, feats, [path])
    same, newer = FeatureCache(spark, folder, names), FeatureCache(spark, folder, names | {"in-order": "2"})
    same.features(g, feats, [path]), newer.features(g, feats, [path])
    assert same.made == [] and newer.made == list(path)


def test_two_writers_and_a_clash_of_names(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/cache"
    a, b = (FeatureCache(spark, folder) for _ in range(2))
    about = {"path": ["p"], "feats": ["f"], "key": "k1", "alias": "A B"}
    one = spark.range(3)
    assert rows(a.put(about, one)) == rows(b.put(about, one)) and len(a.entries()) == 1
    other = about | {"key": "k2"}  # the same short digests
    assert rows(a.put(other, spark.range(5))) == rows(spark.range(5)) and len(a.entries()) == 2
    fresh = FeatureCache(spark, folder)
    assert (fresh.get(about).count(), fresh.get(other).count(), fresh.get(about | {"key": "k3"})) == (3, 5, None)
    assert all(len(e["name"]) <= cache.NAME_LENGTH and e["bytes"] > 0 for e in a.entries())
    assert not [n for n in folders.listed(spark, folder) if n.startswith("_temporary")]


def test_a_half_written_entry_is_none(spark, kept):
    g, feats, folder = kept
    spark.range(2).write.parquet(f"{folder}/_temporary-lost")
    c = FeatureCache(spark, folder)
    assert c.entries() == [] and len(c.features(g, feats, [of(g, "brand-of")])) == 1 and len(c.entries()) == 1


def test_listing_and_index(spark, kept):
    g, feats, folder = kept
    c = FeatureCache(spark, folder)
    c.features(g, feats, [of(g, "brand-of", "in-order"), of(g, "brand-of")])
    assert [e["alias"] for e in c.ls([of(g, "brand-of", "in-order")])] == ["brand-of-in-order"] and c.ls([of(g, "placed-by")]) == []
    index = json.loads(folders.read_text(spark, c.write_index()))
    assert sorted(v["alias"] for v in index.values()) == ["brand-of", "brand-of-in-order"] and len(c.entries()) == 2


def test_slots_are_kept(spark, sf_dir, tmp_path):
    def made():
        g = commerce(spark, sf_dir)
        g = g.of_meta(type(g.meta)(("region", "nation", "customer"), of(g, "has-nation", "home-of")))
        c = FeatureCache(spark, f"file://{tmp_path}/cache")
        return c, c.slots(g, {"region": features.identity(g.nodes["region"], "region")})

    (a, x), (b, y) = made(), made()
    assert a.found == [] and len(b.found) == 3 and {n: rows(t) for n, t in x.items()} == {n: rows(t) for n, t in y.items()}


# ---- rows on demand


def test_rows_on_demand_are_those_of_the_product(spark, sf_dir):
    data = customer_metapaths(spark, sf_dir)
    wanted = spark.createDataFrame([(3,), (17,), (17,), (10**9,), (None,)], "nid long")
    want = {k: v for k, v in near(data.all()).items() if k[1] in (3, 17)}
    assert near(data.rows(wanted)) == pytest.approx(want) and want
    assert near(data.rows(wanted, ["region"])) == {k: v for k, v in want.items() if k[0] == "region"}
    assert data.rows(wanted.where("nid < 0")).count() == 0


def test_every_step_is_cut_by_a_semi_join(spark, sf_dir):
    data = customer_metapaths(spark, sf_dir)
    plan = data.rows(spark.createDataFrame([(3,)], "nid long"), ["brands"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") >= 4  # an edge type each, and the features


def test_a_dataset_has_blocks_of_slots_and_one_end(spark, sf_dir):
    g = commerce(spark, sf_dir)
    small = g.of_meta(type(g.meta)(("region", "nation", "customer"), of(g, "has-nation", "home-of")))
    feats = propagate.slots(small, {n: features.identity(g.nodes[n], n) for n in ("region", "nation")})
    data = propagate.MetapathDataset(small, feats, {"CN": of(small, "home-of")})
    assert {r.slot for r in data.rows(g.nodes["customer"]).select("slot").distinct().collect()} == {"region", "nation"}
    assert near(data.rows(g.nodes["customer"])) == pytest.approx(near(data.all()))
    with pytest.raises(ValueError):
        propagate.MetapathDataset(g, feats, {"a": of(g, "home-of"), "b": of(g, "has-nation")})
