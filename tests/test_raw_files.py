import pytest

from hinspark.sources import hgb

NODES = "0\ta0\t0\t1.0,0.0\n1\ta1\t0\t0.0,1.0\n2\ta2\t0\t1.0,1.0\n3\tp0\t1\n4\tp1\t1\t7.0\n5\tp2\t1\n6\tp3\t1\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "node.dat").write_text(NODES)
    (tmp_path / "link.dat").write_text("0\t3\t0\t1.0\n0\t4\t0\t1.0\n1\t4\t0\t1.0\n2\t6\t0\t1.0\n2\t6\t0\t2.0\n")
    (tmp_path / "link.dat.test").write_text("1\t5\t0\t1.0\n")
    (tmp_path / "label.dat").write_text("0\ta0\t0\t0\n1\ta1\t0\t0,1\n")
    (tmp_path / "label.dat.test").write_text("2\ta2\t0\t1\n")
    return str(tmp_path)


def test_raw(spark, folder):
    r = hgb.raw(spark, folder)
    assert {tuple(x) for x in r.node_stats.collect()} == {(0, 3, 0), (1, 4, 3)}
    assert [tuple(x) for x in r.link_stats.collect()] == [(0, 5, 0, 1)]
    assert {x["id"]: x["attr"] for x in r.nodes.collect()}[4] is None
    assert {(x["id"], x["split"]) for x in r.labels.collect()} == {(0, "train"), (1, "train"), (2, "test")}
    assert hgb.n_classes(r.labels).first()[0] == 2
    assert {x["id"]: x["y"] for x in hgb.multi_hot(r.labels, 2).collect()}[1] == [1, 1]
    local = hgb.local_edges(r.links, r.node_stats, 0, r.nodes)
    assert {tuple(x) for x in local.collect()} == {(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0), (2, 3, 3.0)}
    assert hgb.link_prediction(spark, folder).groupBy("split").count().count() == 2


def test_both_or_no_file_is_an_error(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        hgb.find(spark, folder, "nothing")
    (tmp_path / "node.csv").write_text("node_id,node_type,attr\n0,0,1.0 2.0\n1,0,3\n")
    with pytest.raises(FileNotFoundError):
        hgb.find(spark, folder, "node")
    got = {r["id"]: r["attr"] for r in hgb.nodes(spark, f"{folder}/node.csv").collect()}
    assert got == {0: [1.0, 2.0], 1: None}


def test_wrong_arity_is_an_error(spark, tmp_path):
    (tmp_path / "node.dat").write_text("0\ta\n")
    with pytest.raises(Exception, match="3 or 4 fields"):
        hgb.nodes(spark, f"{tmp_path}/node.dat").collect()


def test_line_numbers(spark, tmp_path):
    (tmp_path / "x.dat").write_text("".join(f"line {i}\n" for i in range(100)))
    assert {(r["line_no"], r["value"]) for r in hgb.numbered_lines(spark, f"{tmp_path}/x.dat").collect()} == {(i, f"line {i}") for i in range(100)}
