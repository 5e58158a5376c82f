"""Filter interactions, repair of conversations and shards, against brute force."""

import hashlib
import heapq
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hinspark.llm import conversation_repair as repair
from hinspark.llm import filter_audit, sharding


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- filter interactions


def fails(rows_, copies):
    out = []
    for i, text, _ in rows_:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for j, u, _ in rows_ if (u or "") == t and j is not None and i is not None and j < i]
        out.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": bool(same)})
    return out


def interactions(docs, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    judged, out = fails(docs, None), {}
    parts = sorted({s or "" for *_, s in docs})
    for part in parts:
        mine = [(d[0], f) for d, f in zip(docs, judged) if (d[2] or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                removed = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                redundant = sum(x[1][f] and any(x[1][b] for b in order[: step - 1]) for x in mine)
                unique = sum(x[1][f] and sum(x[1].values()) == 1 for x in mine)
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, unique, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return {(*k, *v) for k, v in out.items()}


def test_interactions_of_odd_documents(spark):
    long = " ".join(f"w{i % 150}" for i in range(50_000))
    sound = " ".join(f"w{i}" for i in range(200))
    texts = [None, "", sound, sound, sound + " $", sound.upper(), "a a a a A", long, long, "x y\x0bz |", sound + "\x1f", "ÄÖ AB " + sound]
    docs = [(i, t, ["a", None, "b"][i % 3]) for i, t in enumerate(texts)] + [(3, sound, "a"), (2, sound, "b"), (None, sound, "a"), (None, None, None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(10)] + [(2, None, 1), (2, 1, 0), (None, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame([(*d, 5, "p") for d in docs], "doc_id long, text string, source string, mask int, part string")
    known = spark.createDataFrame([(*x, "s") for x in labels], "doc_id long, quality int, toxic int, source string")
    got = rows(filter_audit.audit(table, known))
    assert len(got) == len(set(got)) == 3 * 600 and set(got) == interactions(docs, labels)


def test_interactions_of_the_smallest_table(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = interactions(rows(docs.select("doc_id", "text", "source")), rows(labels.select("doc_id", "quality", "toxic")))
    assert set(rows(filter_audit.audit(docs, labels))) == want


def test_interactions_of_nothing(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert rows(filter_audit.audit(docs.where("false"), labels)) == []
    assert filter_audit.audit(docs, labels.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_audit_is_native(docs, sf_dir, spark):
    plan = filter_audit.audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# ---- repair of conversations

MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def least(turns):
    """(cost, audit, repaired) by Dijkstra over (turns read, state) with whole audits; turns are (role, text, fault)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(turns) and state in (0, 3):
            return cost, audit, [x for x in out]
        done.add((i, state))
        steps = [(2, "I", i, MOVES.get((state, x)), ((("user", "assistant")[x == "a"], ""),)) for x in "ua"]
        if i < len(turns):
            role, text, fault = turns[i]
            steps.append((3, "D", i + 1, state, ()))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                steps.append((more, "K", i + 1, MOVES.get((state, role[:1])), ((role, text),)))
                steps += [(2 + more, "R", i + 1, MOVES.get((state, x)), ((("user", "assistant")[x == "a"], text),)) for x in "ua"]
        for price, letter, j, to, made in steps:
            if to is not None:
                heapq.heappush(heap, (cost + price, audit + letter, j, to, (*out, *made)))


def letters(turns):
    return "".join(chr(65 + {"s": 0, "u": 1, "a": 2}.get(r[:1], 3) + 4 * {None: 0, "truncated": 2}.get(f, 1)) for r, _, f in turns)


def test_least_repairs_of_all_short_conversations():
    kinds = [(r, "", f) for r in ("system", "user", "assistant", "tool") for f in (None, "blank", "truncated")]
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            assert repair.least_repair(letters(turns)) == least(list(turns))[:2], turns


def test_least_repairs_of_random_conversations():
    draw = random.Random(5)
    for _ in range(300):
        turns = [(draw.choice(["system", "user", "user", "assistant", "assistant", "x"]), "", draw.choice([None, None, "blank", "truncated"])) for _ in range(draw.randint(4, 14))]
        assert repair.least_repair(letters(turns)) == least(turns)[:2], turns


def test_long_conversations_take_time_in_proportion():
    draw = random.Random(6)
    x = "".join(draw.choice("ABCDEFGHIJKL") for _ in range(300_000))
    begun = time.perf_counter()
    cost, audit = repair.least_repair(x)
    assert time.perf_counter() - begun < 20 and len(audit) >= len(x) and cost > len(x) / 2


def faults(rows_):
    """Rows of one conversation in order, each with its first fault."""
    seen, out = set(), []
    for _, role, text in sorted(rows_, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())):
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, kind))
    return out


def repaired(table):
    """What ``report`` should return for damaged rows (conv_id, turn, role, text)."""
    per, out = defaultdict(list), {}
    for c, t, r, x in table:
        per[c].append((t, " " if r is None else r, " " if x is None else x))
    for c, mine in per.items():
        turns = faults(mine)
        at = [t for t, *_ in mine if t is not None]
        kinds = Counter(k for *_, k in turns)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, made = least(turns)
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
        out[c] = (max(at) - min(at) + 1 - len(set(at)) if at else 0, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, sha)
    return out


def damaged(table):
    out = []
    for c, t, r, x in table:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if code == 0:
            continue
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        out += [(c, t, "user" if code == 4 else r, x)] * (2 if code == 3 else 1)
    return out


NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_reports_of_odd_conversations(spark):
    table = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes?"), (1, None, "system", "Be kind."), (1, 3, "user", "x"), (1, 3, "user", "x"), (1, 3, "assistant", "y\x0b"),
        (2, 5, None, None), (2, 5, "tool", " \t\n"), (3, None, "user", "a."), (3, None, "assistant", "a."), (None, 1, "user", "q."), (None, 2, "assistant", "é."),
        (4, 0, "", "none."), (4, 1, "assistant", "long " * 60_000 + "."), (5, 0, "user", "same."), (5, 9, "user", "same."), (6, 2, "assistant", " "),
    ]
    draw = random.Random(7)
    table += [(i, draw.choice([None, *range(8)]), draw.choice(["system", "user", "assistant", None]), draw.choice(["a.", "b", "", "c!", None])) for i in range(10, 60) for _ in range(draw.randint(0, 7))]
    df = spark.createDataFrame([(*r, "z", 1) for r in table], "conv_id long, turn long, role string, text string, audit string, place int")
    want = {c: NOTHING for c, *_ in table} | repaired(damaged(table))
    got = rows(repair.report(repair.damaged(df), df))
    assert len(got) == len(want) and {r[0]: r[1:] for r in got} == want


def test_a_conversation_that_holds_most_rows(spark):
    """Spread over ranges and blocks, and put together again."""
    draw = random.Random(8)
    table = [(7, t, draw.choice(["user", "assistant"]), draw.choice([f"{t}.", f"{t}", "again.", ""])) for t in range(2500)] + [(c, t, "user", f"{t}.") for c in (6, 8) for t in range(3)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r[0]: r[1:] for r in rows(repair.report(df, df))}
    assert got == repaired(table)


def test_repaired_rows_are_well_formed(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    table = damaged(rows(df.select("conv_id", "turn", "role", "text")))
    per = defaultdict(list)
    for c, t, edit, role, text in sorted(rows(repair.repaired(repair.damaged(df)))):
        assert t == len(per[c])
        per[c].append((role, text))
    want = repaired(table)
    for c, made in per.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in made))
        assert hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest() == want[c][-1]
    assert set(per) == {c for c, w in want.items() if w[-1] != NOTHING[-1]}


def test_no_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("false")
    assert rows(repair.report(repair.damaged(df), df)) == [] and rows(repair.repaired(df)) == []


# ---- shards


def shards_of(df, n):
    got = rows(df.select("shard", "slot"))
    sizes = Counter(s for s, _ in got)
    assert all(sorted(j for s, j in got if s == k) == list(range(sizes[k])) for k in sizes)
    assert set(sizes) <= set(range(n)) and max(sizes.values()) - min(sizes.get(k, 0) for k in range(n)) <= 1
    return got


def test_shards_hold_the_mixture(spark, docs):
    df = sharding.assignment(docs).cache()
    shards_of(df, 8)
    per, all_ = Counter(map(tuple, df.select("source", "shard").collect())), Counter(r[0] for r in docs.select("source").collect())
    for (source, _), n in per.items():
        assert abs(n - all_[source] / 8) < 2
    texts = dict(rows(docs.select("doc_id", "text")))
    for r in df.collect():
        b = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)


def test_shards_don_t_depend_on_partitions(spark, docs):
    a, b = (sorted(rows(sharding.assignment(docs.repartition(n)).select("doc_id", "shard", "slot"))) for n in (1, 7))
    assert a == b and a != sorted(rows(sharding.assignment(docs, seed=1).select("doc_id", "shard", "slot")))


def test_shards_of_a_hot_source_and_many_small_ones(spark):
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("source"), F.lit("same").alias("text"))
    df = sharding.interleaved(table, 7).cache()
    shards_of(df, 7)
    hot = Counter(r[0] for r in df.where("source = 'hot'").select("shard").collect())
    assert all(abs(n - 1000 / 7) < 5 for n in hot.values()) and df.agg(F.count_distinct("doc_id")).first()[0] == 3000


def test_shards_of_odd_rows(odd):
    df = sharding.assignment(odd)
    shards_of(df, 8)
    assert df.count() == odd.count() and df.where("text_crc32 = 0 and size = 1").count() >= 2
    clashing = odd.withColumnsRenamed({"n_words": "shard", "score": "slot"})
    out = sharding.interleaved(clashing, 3)
    assert sorted(out.columns) == sorted(clashing.columns)
    shards_of(out, 3)
    assert sharding.assignment(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        sharding.interleaved(odd, 0)


def test_written_shards_are_the_shards(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, 4)
    back = spark.read.parquet(path)
    assert sorted(rows(back.select("doc_id", "text", "shard", "slot"))) == sorted(rows(sharding.interleaved(docs, 4).select("doc_id", "text", "shard", "slot")))
