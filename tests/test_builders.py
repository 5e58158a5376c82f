"""Networks built from raw folders of every layout, by name, and what their tables hold."""

import json

import pytest
from pyspark.sql import functions as F

from hinspark.operators import evaluate
from hinspark.sources import builders, specs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def near(df):
    return {tuple(r[:-1]): round(r[-1], 6) for r in df.collect()}


def write(folder, **files):
    for name, lines in files.items():
        path = folder / name.replace("__", "/").replace("DOT", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(lines) + "\n" if lines else "")
    return f"file://{folder}"


def nodes(*types):
    """node.dat lines: per type a list of attribute lists, or of None."""
    out, k = [], 0
    for t, attrs in enumerate(types):
        for a in attrs:
            out.append("\t".join([str(k), f"n{k}", str(t), *([",".join(map(str, a))] if a else [])]))
            k += 1
    return out


def link(*xs):
    return ["\t".join(map(str, x)) for x in xs]


def one_hot(width, *at):
    return [float(i in at) for i in range(width)]


@pytest.fixture
def imdb(tmp_path):
    def movie(numbers, words):
        return numbers + [0.0] * (16 - len(numbers)) + one_hot(132, 0, 5, 60, 120) + words

    movies = [movie([2.0, -2.0], [1.0, 2.0, 0.0]), movie([1.0], [0.0, 1.0, 0.0]), movie([], [0.0, 0.0, 0.0]), movie([0.0, -3.0], [0.0, 0.0, 4.0])]
    return write(
        tmp_path,
        nodeDOTdat=nodes(movies, [None] * 2, [None] * 3, [None]),
        linkDOTdat=link((0, 4, 0, 1.0), (4, 0, 1, 1.0), (1, 5, 0, 1.0), (1, 5, 0, 1.0), (0, 6, 2, 1.0), (2, 8, 2, 1.0), (3, 9, 4, 0.5), (3, 9, 9, -0.5), (2, 9, 4, 1.0)),
        labelDOTdat=link((0, "n0", 0, "0,2"), (1, "n1", 0, "1")),
        **{"labelDOTdatDOTtest": link((3, "n3", 0, "2"))},
    )


def test_multi_label_network(spark, imdb):
    b = builders.dataset(spark, "imdb", imdb)
    assert {r["name"]: r.n for r in b.graph.counts().collect()} == {"movie": 4, "director": 2, "actor": 3, "keyword": 1, "directed-by": 2, "directed": 2, "stars": 2, "acts": 2, "contains": 1, "is-in": 1}
    assert rows(b.graph.edge("acts")) == [(0, 0), (2, 2)] and rows(b.graph.edge("contains")) == [(2, 0)]  # links that add up to 0 are none
    assert rows(b.graph.nodes["movie"].where("split is not null")) == [(0, [1, 0, 1], "train"), (1, [0, 1, 0], "train"), (3, [0, 0, 1], "test")]
    assert rows(b.feats["director"]) == [(0, "director", 0, 1.0), (1, "director", 1, 1.0)] and b.feats["movie"].where("nid = 3").count() == 6


def test_attributes_as_node_types(spark, imdb):
    g = builders.dataset(spark, "atomic-imdb", imdb).graph
    sizes = {r["name"]: r.n for r in g.node_counts().collect()}
    assert sizes == {"movie": 4, "director": 2, "actor": 3, "keyword": 1, "numerical": 16, "color": 3, "language": 48, "country": 65, "content_rating": 16, "word": 3}
    assert rows(g.edge("has-color")) == [(i, 0) for i in range(4)] and rows(g.edge("is-rating-for")) == [(4, i) for i in range(4)]
    # signed numbers: by row times the width of 16, by column times the 4 movies
    assert near(g.edge("is-numerical-of")) == {(0, 0): 8.0, (1, 0): -8.0, (0, 1): 16.0, (1, 3): -16.0}
    assert near(g.edge("has-numerical")) == {(0, 0): 2.666667, (1, 0): 1.333333, (0, 1): -1.6, (3, 1): -2.4}
    assert near(g.edge("is-word-of")) == {(0, 0): 0.666667, (1, 0): 1.333333, (1, 1): 1.0, (2, 3): 1.0}
    assert near(g.edge("contains-word")) == {(0, 0): 1.0, (0, 1): 1.333333, (1, 1): 0.666667, (3, 2): 1.0}


def test_profiles_and_switches(spark, imdb):
    plain = builders.dataset(spark, "atomic-imdb", imdb, word=True, **{"is-in": False})
    names = {c.etype for c in plain.graph.edges}
    assert not names & {"is-in", "contains"} and "keyword" not in plain.graph.nodes and set(plain.slots) >= {"word", "movie", "actor"}
    refined = builders.dataset(spark, "atomic-imdb", imdb, profile="refined", word=False)
    assert not {c.etype for c in refined.graph.edges} & {"has-color", "is-country-of", "is-in-language"} and not {"color", "country"} & set(refined.graph.nodes)
    assert {r.slot for r in refined.slots["movie"].select("slot").distinct().collect()} == {"director", "language", "country", "content_rating", "numerical"}
    for bad in (dict(name="imdb", word=True), dict(name="imdb", profile="atomic"), dict(name="nothing"), dict(name="atomic-imdb", profile="vanilla")):
        with pytest.raises(ValueError):
            builders.dataset(spark, folder=imdb, **bad)
    with pytest.raises(KeyError):
        builders.dataset(spark, "atomic-imdb", imdb, nothing=True)


def test_types_named_by_the_folder(spark, tmp_path):
    given = {"0": "author", "1": "paper", "2": "term", "3": "venue"}  # another order than declared
    folder = write(
        tmp_path,
        nodeDOTdat=nodes([[1.0, 0.0], [0.0, 1.0]], [[1.0, 3.0], [0.0, 2.0]], [[0.5, -0.5], [2.0, 0.0]], [None]),
        linkDOTdat=link((2, 0, 0, 1.0), (3, 1, 0, 1.0), (3, 0, 0, 1.0), (2, 4, 1, 1.0), (3, 6, 2, 1.0)),
        labelDOTdat=link(*((i, f"n{i}", 0, str(3 - i)) for i in range(1))),
        infoDOTdat=[json.dumps({"node.dat": {"node type": given}})],
        **{"labelDOTdatDOTtest": link((1, "n1", 0, "1,0"))},
    )
    b = builders.dataset(spark, "atomic-dblp", folder)
    assert rows(b.graph.edge("pubs-in")) == [(1, 0)] and rows(b.graph.edge("contains")) == [(0, 0)] and rows(b.graph.edge("writing")) == [(0, 0), (0, 1), (1, 1)]
    assert rows(b.graph.nodes["author"]) == [(0, 3, "train"), (1, 0, "test")] and rows(b.graph.edge("has-authorfeat")) == [(0, 0), (1, 1)]
    assert near(b.graph.edge("is-numerical-of")) == {(0, 0): 1.0, (1, 0): -1.0, (0, 1): 2.0}
    assert rows(b.feats["conference"]) == [(0, "conference", 0, 1.0)]


def test_tables_with_headers(spark, tmp_path):
    folder = write(
        tmp_path,
        nodeDOTcsv=["node_id,node_type,attr", "0,0,1.0 0.0", "1,0,0.0 2.0", "2,1,7.0", "3,2,1.0", "4,3,1.0"],
        linkDOTcsv=["head,tail,rel,weight", "0,1,0,1.0", "0,2,2,1.0", "1,3,4,1.0", "1,4,6,1.0"],
        data_trainDOTcsv=["node_id,node_type,labels", "0,0,2 1"],
        data_valDOTcsv=["node_id,node_type,labels", "1,0,0"],
        data_testDOTcsv=["node_id,node_type,labels"],
    )
    b = builders.dataset(spark, "acm", folder)
    assert rows(b.graph.edge("citing")) == [(0, 1)] and rows(b.graph.edge("cited")) == [(1, 0)] and rows(b.graph.edge("is-about")) == [(1, 0)]
    assert rows(b.graph.nodes["paper"]) == [(0, 1, "train"), (1, 0, "val")]
    assert rows(b.feats["paper"]) == [(0, "paper", 0, 1.0), (1, "paper", 1, 2.0)] and rows(b.feats["author"]) == [(0, "author", 0, 1.0)]


def test_many_relations_without_features(spark, tmp_path):
    folder = write(tmp_path, nodeDOTdat=nodes([None] * 2, *([None] for _ in range(7))), linkDOTdat=link((0, 2, 1, 1.0), (0, 1, 0, 1.0), (6, 8, 33, 1.0)), labelDOTdat=link((1, "n1", 0, "4")), **{"labelDOTdatDOTtest": []})
    b = builders.dataset(spark, "freebase", folder)
    assert len(b.graph.edges) == 72 and len(b.graph.nodes) == 8
    assert rows(b.graph.nodes["book"]) == [(0, -1, None), (1, 4, "train")]
    assert rows(b.graph.edge("book-to-film-inv")) == [(0, 0)] and rows(b.graph.edge("book-and-book")) == [(0, 1)] and b.graph.edge("organization-for-business").count() == 0
    assert len({r.name for r in specs.FREEBASE.relations}) == 36


def test_folders_of_files(spark, tmp_path):
    folder = write(
        tmp_path,
        **{
            "raw__num-node-dictDOTcsv": ["author,field_of_study,institution,paper", "2,1,1,4"],
            "raw__relations__author___affiliated_with___institution__edgeDOTcsv": ["0,0"],
            "raw__relations__author___writes___paper__edgeDOTcsv": ["0,0", "1,3"],
            "raw__relations__paper___cites___paper__edgeDOTcsv": ["0,1", "2,1"],
            "raw__relations__paper___has_topic___field_of_study__edgeDOTcsv": ["3,0"],
            "raw__node-feat__paper__node-featDOTcsv": ["1.0,-1.0", "0.0,2.0", "0.0,0.0", "4.0,0.0"],
            "raw__node-feat__paper__node_yearDOTcsv": ["2010", "2012", "2011", "2011"],
            "raw__node-label__paper__node-labelDOTcsv": ["3", "0", "1", "2"],
            "split__time__paper__trainDOTcsv": ["0", "1"],
            "split__time__paper__validDOTcsv": ["2"],
            "split__time__paper__testDOTcsv": ["3"],
        },
    )
    # the parts of a relation's name are joined by underscores, which write() reads as folders
    for name in ("author/_affiliated_with/_institution", "author/_writes/_paper", "paper/_cites/_paper", "paper/_has_topic/_field_of_study"):
        (tmp_path / "raw/relations" / name.replace("/_", "___")).mkdir()
        (tmp_path / "raw/relations" / name / "edge.csv").rename(tmp_path / "raw/relations" / name.replace("/_", "___") / "edge.csv")
    b = builders.dataset(spark, "atomic-mag", folder)
    g = b.graph
    assert rows(g.edge("cited")) == [(1, 0), (1, 2)] and rows(g.edge("written_by")) == [(0, 0), (3, 1)]
    assert rows(g.nodes["paper"]) == [(0, 3, "train"), (1, 0, "train"), (2, 1, "val"), (3, 2, "test")]
    assert rows(g.edge("published-in-year")) == [(0, 0), (1, 2)] and g.nodes["year"].count() == 3  # training papers only
    assert near(g.edge("is-numerical-of")) == {(0, 0): 1.0, (1, 0): -1.0, (1, 1): 2.0, (0, 3): 2.0}
    assert near(g.edge("has-numerical")) == {(0, 0): 0.8, (3, 0): 3.2, (0, 1): -1.333333, (1, 1): 2.666667}


def test_links_to_predict(spark, tmp_path):
    links = [(u, 6 + a, 0, 1.0) for u in range(6) for a in range(4) if (u + a) % 2] + [(0, 1, 1, 1.0), (2, 0, 1, 1.0), (6, 10, 2, 1.0), (7, 10, 2, 1.0), (7, 11, 2, 1.0)]
    folder = write(tmp_path, nodeDOTdat=nodes([None] * 6, [None] * 4, [None] * 2), linkDOTdat=link(*links), **{"linkDOTdatDOTtest": link((0, 6, 0, 1.0), (5, 9, 0, 1.0))})
    b = builders.dataset(spark, "lastfm", folder)
    assert {c.etype for c in b.graph.edges} == {"user-artist", "artist-user", "user-user", "artist-tag", "tag-artist"}
    both = b.graph.edge("user-artist").select("src", "dst").union(b.val.edge("user-artist"))
    assert rows(both) == sorted((u, a - 6) for u, a, r, _ in links if r == 0) and {r.src for r in b.graph.edge("user-artist").collect()} == set(range(6))
    assert evaluate.same_rows(b.graph.edge("artist-user").select("dst", "src"), b.graph.edge("user-artist").select("src", "dst"))
    assert rows(b.graph.edge("user-user").distinct()) == [(0, 1), (0, 2), (1, 0), (2, 0)] and b.graph.edge("artist-tag").count() == 3  # held back of targets only
    assert rows(b.test.edge("user-artist")) == [(0, 0), (5, 3)]
    wrong = rows(b.test_negatives.edge("user-artist"))
    known = set(rows(both)) | {(0, 0), (5, 3)}
    assert not set(wrong) & known and all(0 <= a < 4 for _, a in wrong) and {u for u, _ in wrong} <= {0, 5}
    with pytest.raises(ValueError):
        builders.dataset(spark, "lastfm", folder, remove_unreachable=True)


def test_links_with_attributes_and_undeclared_relations(spark, tmp_path):
    def product(price, rank, brand, *more):
        return [price, *one_hot(810, rank), *one_hot(3, brand), *more]

    items = [product(2.0, 0, 1, 1.0, 0.0), product(0.0, 5, 2, 0.0, 1.0), product(-1.0, 5, 0, 0.0, 0.0)]
    files = dict(nodeDOTdat=nodes(items), **{"linkDOTdatDOTtest": link((0, 2, 1, 1.0))})
    g = builders.dataset(spark, "atomic-amazon", write(tmp_path / "a", linkDOTdat=link((0, 1, 0, 1.0), (1, 2, 1, 1.0)), **files)).graph
    assert rows(g.edge("product-sales_rank")) == [(0, 0), (1, 5), (2, 5)] and rows(g.edge("category-product")) == [(0, 0), (1, 1)]
    # a mean magnitude of 1 beside each price, both plus 1e-7
    assert near(g.edge("price-product")) == {(0, 0): 1.333333, (1, 0): 0.666667, (0, 1): 0.0, (1, 1): 2.0, (0, 2): -1.0, (1, 2): 1.0}
    assert near(g.edge("product-price")) == {(0, 0): 2.0, (1, 0): 0.0, (2, 0): -1.0, (0, 1): 1.0, (1, 1): 1.0, (2, 1): 1.0}
    wrong = builders.dataset(spark, "amazon", write(tmp_path / "b", linkDOTdat=link((0, 1, 0, 1.0), (1, 2, 2, 1.0)), **files))
    with pytest.raises(ValueError, match="isn't declared"):
        wrong.graph.edge("co-view")


def test_dense_attributes_of_every_type(spark, tmp_path):
    folder = write(tmp_path, nodeDOTdat=nodes([[1.0, 3.0]], [[2.0, 2.0]] * 2, [[1.0, -1.0]], [[5.0, 0.0]]), linkDOTdat=link((0, 1, 1, 1.0), (1, 2, 2, 1.0), (3, 0, 3, 1.0)), **{"linkDOTdatDOTtest": link((2, 1, 2, 1.0))})
    g = builders.dataset(spark, "atomic-pubmed", folder).graph
    assert len(g.edges) == 28 and rows(g.edge("species-chemical")) == [(0, 0)] and rows(g.edge("disease-disease-inv")) == [(1, 0)]
    assert near(g.edge("feat-of-species")) == {(0, 0): 0.5, (1, 0): 1.5} and near(g.edge("disease-has-feat")) == {(i, j): 1.0 for i in range(2) for j in range(2)}


def test_a_folder_with_other_types_is_refused(spark, imdb):
    with pytest.raises(ValueError, match="node types"):
        builders.dataset(spark, "freebase", imdb).graph.nodes["book"].count()


def test_nothing_is_read_before_it_is_asked_for(spark):
    b = builders.build(spark, "file:///nowhere", specs.PUBMED)
    assert len(b.graph.meta.cetypes) == 20 and set(b.feats) == set(specs.PUBMED_TYPES)
