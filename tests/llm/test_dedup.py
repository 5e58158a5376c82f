"""Line deduplication, the shingle join, components."""

import random
import re
import time

import pytest

from hinspark.llm import line_dedup, ngram_join
from hinspark.llm.components import components


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def trimmed(line):
    return line.strip(" \t\r\x0b\x0c")


def expected_lines(rows, min_chars=0, max_edits=1):
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for p, line in enumerate(t.split("\n")):
            if trimmed(line):
                first[trimmed(line)] = min(first.get(trimmed(line), (d, p)), (d, p))
    gone = {b for a in first for b in first if max_edits and min(len(a), len(b)) >= min_chars and first[a] < first[b] and near(a, b)}
    out = []
    for d, t in rows:
        if t is None or d is None:
            out.append((d, 0 if t is None else len(t.split("\n")), 0, t))
            continue
        lines = t.split("\n")
        keep = [x for p, x in enumerate(lines) if not trimmed(x) or (first[trimmed(x)] == (d, p) and trimmed(x) not in gone)]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def variants(rng, line):
    i = rng.randrange(len(line) + 1)
    return rng.choice([line[:i] + "x" + line[i:], line[:i] + line[i + 1 :], line[:i] + "y" + line[i + 1 :], line, line[:i] + "q" + line[i + 2 :]])


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randrange(18, 60))) + "z" for _ in range(12)]
    rows = []
    for d in range(120):
        lines = [variants(rng, rng.choice(base)) for _ in range(rng.randrange(1, 5))] + ["", "short", f"{'page of the book no. '}{rng.randrange(30)}"]
        rows.append((d, "\n".join(lines)))
    rows += [(200, None), (None, rows[0][1]), (201, ""), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for kw in ({}, {"min_chars": 20}, {"max_edits": 0}):
        got = line_dedup.dedup_lines(df, **kw).select("doc_id", "n_lines", "n_dropped", "text").collect()
        key = lambda r: (r[0] is None, r[0], r[1])
        assert sorted((tuple(r) for r in got), key=key) == sorted(expected_lines(rows, **kw), key=key)


@pytest.mark.parametrize("bound", ["MAX_BROADCAST_KEYS", "MAX_BROADCAST_LINES"])
def test_lines_beyond_the_broadcast_bounds(spark, monkeypatch, bound):
    monkeypatch.setattr(line_dedup, bound, 0)
    rows = [(i, f"a line of the kind {i % 7}{i % 5}\nx{i % 3}\n{'same half of them ' * 3}{i}") for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: t for d, _, _, t in expected_lines(rows)}


def test_short_lines(spark):
    rows = [(i, t) for i, t in enumerate(["a", "b", "ab", "abc", "xyz", "é", "xz", "z", "abcd ", " abcd", "漢字", "漢", "a\nb\na"])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: t for d, _, _, t in expected_lines(rows)}


def test_time_on_a_long_line_is_no_square(spark):
    text = "".join(random.Random(3).choices("abcdefgh ", k=1_000_000))
    rows = [(0, text), (1, text[:400_000] + "Q" + text[400_001:]), (2, text[:-3] + "q" + text[-3:]), (3, text[:10] + "QQ" + text[12:])]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0}


def test_lines_plan_is_native(spark, docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_lines_odd_rows(spark, odd):
    out = line_dedup.dedup_lines(odd.withColumnRenamed("score", "n_dropped"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_words", "n_dropped", "n_lines"] and out.count() == odd.count()
    left = line_dedup.without_repeated_lines(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 5, 7, 8]
    assert line_dedup.dedup_lines(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(odd, max_edits=3)


def test_long_lines_and_a_hot_group(spark):
    long = "lorem ipsum " * 3000
    rows = [(0, long), (1, long[:20000] + "X" + long[20000:])] + [(10 + i, f"line number {i:04d} of a log file") for i in range(300)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0 and got[1] == 1 and got == {d: n for d, _, n, _ in expected_lines(rows)}


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(rows, n, percent):
    sets = [(d, shingles(t, n)) for d, t in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, (d, a) in enumerate(sets):
        for j, (e, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                at[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


def altered(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(["uno", "dos", "tres", f"w{rng.randrange(99)}"])
    return words


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_links_against_brute_force(spark, n, percent):
    rng = random.Random(n)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for g in range(14):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(rng.randrange(3, 260))]
        for _ in range(rng.randrange(1, 9)):
            words = altered(rng, base, rng.randrange(0, 1 + len(base) // 12))
            rows.append((len(rows) * 3 % 1009, " ".join(words + (common if rng.random() < 0.4 else []))))
    rows += [(5000 + i, " ".join(common)) for i in range(5)] + [(5100 + i, " ".join(common + [f"x{i}"] * (i % 3))) for i in range(30)]
    rows += [(6000, None), (6001, ""), (6002, " \n"), (6003, "one two"), (6004, "One\ttwo"), (None, rows[0][1]), (None, "lonely text of no id at all"), rows[1], (6005, " ".join(f"L{i}" for i in range(30_000))), (6006, " ".join(f"L{i}" for i in range(29_900)))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.link_documents(df, n, percent).collect()
    assert order(got) == order(groups(rows, n, percent))


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(altered(rng, base, rng.randrange(0, 5)))) for i in range(250)]
    assert order(ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()) == order(groups(rows, 4, 85))


def test_one_of_each(spark, odd):
    left = ngram_join.one_of_each(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 5, 7, 8]
    assert ngram_join.link_documents(odd.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)] + [(7, 7), (None, 3)]
    at = {}

    def find(i):
        at.setdefault(i, i)
        while at[i] != i:
            i = at[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            at[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in at}


def test_runs_and_periods_take_no_square(spark):
    """Pairs of a million equal characters, and of a repeated pair of characters, each one edit apart."""
    rows, n = [], 1_000_000
    for k, x in enumerate(("=" * n, "ab" * (n // 2), "=" * (n // 2) + "-" + "=" * (n // 2))):
        rows += [(10 * k, x), (10 * k + 1, x[:-1]), (10 * k + 2, x[: n // 3] + "Q" + x[n // 3 + 1 :]), (10 * k + 3, x[:-3])]
    begun = time.perf_counter()
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert time.perf_counter() - begun < 60
    # without its dash the line of doc 20 is that of doc 0, and the line of doc 23 that of doc 3
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 10: 0, 11: 1, 12: 1, 13: 0, 20: 1, 21: 1, 22: 1, 23: 1}


def test_runs_of_every_length_against_brute_force(spark):
    draw = random.Random(11)
    lines = ["=" * k for k in range(1, 140)] + ["ab" * k + "a" * (k % 2) for k in range(1, 80)] + ["=" * a + "-" + "=" * b for a, b in ((3, 60), (64, 64), (65, 64), (10, 130), (10, 129))]
    lines += ["".join(draw.choices("ab", weights=(9, 1), k=draw.randint(60, 75))) for _ in range(120)]
    lines += [x[:i] + draw.choice(["", "a", "ba"]) + x[i + 1 :] for x in draw.sample(lines, 80) for i in [draw.randrange(len(x))]]
    draw.shuffle(lines)
    rows = [(i, x) for i, x in enumerate(lines)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: n for d, _, n, _ in expected_lines(rows)}


def test_a_long_list_of_unrelated_documents_is_cut_into_blocks(spark, monkeypatch):
    """Thousands of classes in one list: pairs are those of one key, and no key holds more than two blocks."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.lit(7).cast("long").alias("shingle"), F.lit(0).alias("pos"), F.col("id").alias("cid"), (F.col("id") - F.col("id") % 3).alias("component"), F.lit(10).cast("long").alias("n"), F.array(F.lit(8).cast("long"), F.pow(F.lit(2.0), F.col("id") % 61).cast("long")).alias("bits"))
    few = rows.where("cid < 200")
    one = {tuple(r) for r in ngram_join._between_components(few.withColumn("blocks", F.lit(1).cast("long")), 80).collect()}
    cut = {tuple(r) for r in ngram_join._between_components(few.withColumn("blocks", F.lit(9).cast("long")), 80).collect()}
    assert one == cut and one
    block = F.pmod(F.xxhash64("component"), F.lit(30))
    sizes = [r["count"] for r in rows.groupBy(block.alias("i")).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 3 * 3000 / 30
    plan = ngram_join._between_components(rows.withColumn("blocks", F.lit(30).cast("long")), 80)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Cross" not in plan


@pytest.mark.parametrize("block_rows", [1, 5])
def test_links_with_lists_in_blocks_against_brute_force(spark, monkeypatch, block_rows):
    """With a table of two cells nothing is rare, so a shared passage is in many prefixes."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", 6)
    rng = random.Random(13)
    shared = [f"s{i}" for i in range(9)]
    rows = []
    for d in range(90):
        own = [f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 5))]
        rows.append((d, " ".join(shared + own if rng.random() < 0.7 else own + shared)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 90, 9)]
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), n=4, percent=85).collect()
    assert order(got) == order(groups(rows, 4, 85))
