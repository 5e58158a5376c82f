"""Least-cost repair of the turn structure of conversations.

A conversation is well formed if the first letters of its roles read
``(s?(ua)+)?``: perhaps a system turn, then user and assistant in turns, or
nothing at all.  Four edits make one so: Keep (0), Delete (3; a must for blank
and repeated turns), Rerole to user or assistant (2) and Insert an empty user or
assistant turn anywhere (2).  A truncated turn that stays costs 1 more.

The search is one of cost layers over the grammar's four states.  For each turn,
from the last to the first, layer c is the bitset of states from which the rest
can be finished for c at most; each layer is made from the smaller ones of the
turn after it, shifted by the price of an edit.  Every state is in the layer a few
steps after the first that isn't empty, so a turn needs a handful of them and the
work is linear in the turns, however many must be mended.  The first layer of the
first turn that holds the start state is the least cost.  A trace from the start
keeps the bitset of states that the same letters lead to and takes, at every step,
the least letter that stays within the layers: the ASCII-least audit.

Spark does the rest: turns are sorted by ranges of (conversation, turn), so a
conversation of any length is spread over tasks; one is read back as strings of
one letter for each turn, put together in blocks.  Only the edited rows of one
conversation are streamed through a single task, in batches, as the digest of a
text can only be taken in order.

Defined results: null roles and texts count as one space; null turns come first;
rows of one turn are ordered by role, then text; a null conv_id is a conversation
of its own; repeated rows are duplicates; other columns are ignored; an empty
table gives an empty one; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import written
from .arrays import batched

#: Turns of a conversation that are gathered as one block of letters: two to this power.
BLOCK_BITS = 10

KEEP, DELETE, INSERT, REROLE = "K", "D", "I", "R"

#: Faults of a turn.
SOUND, MUST_GO, TRUNCATED = range(3)

#: States: nothing yet, after the system, after a user, after an assistant; moves by the first letter of a role.
_MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_START, _ENDS, _ALL = 0b0001, 0b1001, 0b1111
_AFTER = {letter: [sum({1 << t for s, t in moves.items() if states >> s & 1}) for states in range(16)] for letter, moves in _MOVES.items()}
_BEFORE = {letter: [sum(1 << s for s, t in moves.items() if states >> t & 1) for states in range(16)] for letter, moves in _MOVES.items()}

#: A turn's letter: its role's first letter (or another) and its fault.
_ROLES = "sua-"


def _letter(role: Column, fault: Column) -> Column:
    first = F.substring(role, 1, 1)
    place = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return F.char(65 + place + 4 * fault)


def _turn(letter: str) -> tuple[str, int]:
    k = ord(letter) - 65
    return _ROLES[k % 4], k // 4


def _within(layers: tuple[int, ...], cost: int) -> int:
    """States of the layer, which grow with the cost."""
    return 0 if cost < 0 else layers[min(cost, len(layers) - 1)]


def _grown(without_insert) -> tuple[int, tuple[int, ...]]:
    """(cost of the first layer that isn't empty, the layers from there until one holds all states), with inserts."""
    layers: list[int] = []
    while not layers or layers[-1] != _ALL:
        c = len(layers)
        now = without_insert(c) | (layers[-1] if layers else 0)
        if c >= 2:
            now |= _BEFORE["u"][layers[c - 2]] | _BEFORE["a"][layers[c - 2]]
        layers.append(now)
    base = next(c for c, states in enumerate(layers) if states)
    return base, tuple(layers[base:])


_LAST = _grown(lambda c: _ENDS)


@lru_cache(maxsize=None)
def _layers(after: tuple[int, ...], letter: str) -> tuple[int, tuple[int, ...]]:
    """The layers of a turn, and the cost of its first one over that of the turn after it."""
    role, fault = _turn(letter)
    more = 1 if fault == TRUNCATED else 0

    def without_insert(c: int) -> int:
        states = _within(after, c - 3)
        if fault != MUST_GO:
            if role in _MOVES:
                states |= _BEFORE[role][_within(after, c - more)]
            mended = _within(after, c - 2 - more)
            states |= _BEFORE["u"][mended] | _BEFORE["a"][mended]
        return states

    return _grown(without_insert)


@lru_cache(maxsize=None)
def _edits(after: tuple[int, ...] | None, letter: str, states: int) -> tuple[str, int]:
    """(the least letters up to and with the turn's own edit, the states they lead to); after the last turn, inserts only."""
    base, here = _LAST if after is None else _layers(after, letter)
    left = next(c for c, found in enumerate(here) if found & states)
    role, fault = _turn(letter) if after is not None else ("-", MUST_GO)
    more, done = (1 if fault == TRUNCATED else 0), ""
    while True:
        added = _AFTER["u"][states] | _AFTER["a"][states]
        if after is None:
            if left == 0:
                return done, states
        elif now := states & _within(after, left + base - 3):
            return done + DELETE, now
        if now := added & _within(here, left - 2):
            done, states, left = done + INSERT, now, left - 2
            continue
        if role in _MOVES and fault != MUST_GO and (now := _AFTER[role][states] & _within(after, left + base - more)):
            return done + KEEP, now
        return done + REROLE, added & _within(after, left + base - 2 - more)


def least_repair(letters: str) -> tuple[int, str]:
    """(cost, audit) of a conversation given as one letter for each turn."""
    stack, cost, after = [None], _LAST[0], _LAST[1]
    for letter in reversed(letters):
        stack.append(after)
        base, after = _layers(after, letter)
        cost += base
    cost += next(c for c, states in enumerate(after) if states & _START)
    audit, states = [], _START
    for letter in letters:
        done, states = _edits(stack.pop(), letter, states)
        audit.append(done)
    audit.append(_edits(None, "", states)[0])
    return cost, "".join(audit)


def _illegal(letters: str) -> int:
    roles = "".join(_turn(x)[0] for x in letters)
    return sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by the checksum of ``conv_id:turn``: dropped, emptied, cut, repeated or reroled turns."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn"))) % 20
    coded = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), code.alias("code")).where("code <> 0")
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return coded.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _placed(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place): places grow in the order of turns; sorted in ranges, so no conversation is one task's."""
    known = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    ranges = known.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return written(ranges.withColumn("place", F.monotonically_increasing_id()), "turns")


def _judged(placed: DataFrame) -> DataFrame:
    """(conv_id, turn, place, role, fault, kind) of each turn; kind names the first fault."""
    bare = F.translate("text", " \t\n\x0b\x0c\r", "")
    thin = placed.select("conv_id", "turn", "place", "role", F.sha2("text", 256).alias("h"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    seen = thin.groupBy("conv_id", "role", "h").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("t"), "first")
    both = thin.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("t")), "left")
    kind = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    fault = F.when(kind.isin("blank", "duplicate"), MUST_GO).when(kind == "truncated", TRUNCATED).otherwise(SOUND)
    return both.select("conv_id", "turn", "place", "role", kind.alias("kind"), fault.alias("fault"))


_COUNTS = ("blank", "duplicate", "truncated")


def _conversations(judged: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, letters): blocks of letters first, then one row for each conversation."""
    blocks = judged.groupBy("conv_id", F.shiftright("place", BLOCK_BITS).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", _letter(F.col("role"), F.col("fault")).alias("letter")))), lambda x: x["letter"]), "").alias("letters"),
        *(F.count_if(F.col("kind") == c).alias(c) for c in _COUNTS),
        F.min("turn").alias("low"),
        F.max("turn").alias("high"),
        F.size(F.collect_set("turn")).alias("turns"),
    )
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "letters", "low", "high", "turns"))).alias("blocks"), *(F.sum(c).alias(c) for c in _COUNTS), F.min("low").alias("low"), F.max("high").alias("high"))
    # blocks are in the order of turns: one may go on with the turn that the last one ended with
    distinct = F.aggregate("blocks", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last")), lambda s, b: F.struct((s["n"] + b["turns"] - F.when(b["low"] == s["last"], 1).otherwise(0)).cast("long").alias("n"), F.coalesce(b["high"].cast("long"), s["last"]).alias("last")), lambda s: s["n"])
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - distinct, F.lit(0)).cast("long")
    return whole.select("conv_id", gaps.alias("gaps"), *_COUNTS, F.array_join(F.transform("blocks", lambda b: b["letters"]), "").alias("letters"))


def _planned(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)."""

    @F.pandas_udf("illegal long, cost long, audit string")
    def plan(letters: pd.Series) -> pd.DataFrame:
        out = [(_illegal(x), *least_repair(x)) for x in letters]
        return pd.DataFrame(out, columns=["illegal", "cost", "audit"])

    return conversations.withColumn("plan", plan("letters")).select("conv_id", "gaps", *_COUNTS, "plan.illegal", "plan.cost", "plan.audit")


def _edited(batches) -> Iterator[tuple]:
    """(conv_id, place or None, edit, role, text) of each row that stays or is put in, and (conv_id, None, None, None, None) after each conversation.

    Rows come sorted, a conversation's audit (place -1) before its turns.
    """
    conv, audit, at, out, odd = None, None, 0, 0, 0

    def inserts():
        nonlocal at, out
        while at < len(audit) and audit[at] == INSERT:
            yield conv, None, INSERT, ("user", "assistant")[(out - odd) % 2], ""
            at, out = at + 1, out + 1

    for batch in batches:
        for c, place, role, text, plan in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "place", "role", "text", "audit"))):
            if plan is not None:
                if audit is not None:
                    yield from inserts()
                    yield conv, None, None, None, None
                conv, audit, at, out, odd = c, plan, 0, 0, (len(plan) - plan.count(DELETE)) % 2
                continue
            yield from inserts()
            edit, at = audit[at], at + 1
            if edit != DELETE:
                yield conv, place, edit, role if edit == KEEP else ("user", "assistant")[(out - odd) % 2], text
                out += 1
    if audit is not None:
        yield from inserts()
        yield conv, None, None, None, None


def _sorted_with_plans(placed: DataFrame, plans: DataFrame) -> DataFrame:
    heads = plans.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    rows = heads.unionByName(placed.select("conv_id", "place", "role", "text", F.lit(None).cast("string").alias("audit")))
    return batched(rows).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def _batches(rows: Iterator[tuple], names: list[str], types: list, size: int = 1000):
    import pyarrow as pa

    schema, held = pa.schema(list(zip(names, types))), []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema)


def _hashes(batches):
    import hashlib

    import pyarrow as pa

    def digests(conv_type):
        sha, empty = hashlib.sha256(), True
        for conv, _, edit, role, text in _edited(source):
            if edit is None:
                yield conv, sha.hexdigest()
                sha, empty = hashlib.sha256(), True
                continue
            if not empty:
                sha.update(b"\n")
            sha.update(f"{role}:".encode())
            sha.update(text.encode())
            empty = False

    first = next(batches, None)
    if first is None:
        return
    source = _chained(first, batches)
    kind = first.schema.field("conv_id").type
    yield from _batches(digests(kind), ["conv_id", "repaired_sha256"], [kind, pa.string()])


def _chained(first, rest):
    yield first
    yield from rest


def _rows(batches):
    import pyarrow as pa

    def numbered():
        n = 0
        for conv, place, edit, role, text in _edited(source):
            if edit is None:
                n = 0
                continue
            yield conv, n, edit, role, text
            n += 1

    first = next(batches, None)
    if first is None:
        return
    source = _chained(first, batches)
    kind = first.schema.field("conv_id").type
    yield from _batches(numbered(), ["conv_id", "turn", "edit", "role", "text"], [kind, pa.int64(), pa.string(), pa.string(), pa.string()])


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows."""
    return _planned(_conversations(_judged(_placed(rows))))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, edit, role, text): the repaired conversations, turns counted from 0; edit is K, R or I."""
    placed = _placed(rows)
    found = _planned(_conversations(_judged(placed)))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _sorted_with_plans(placed, found).mapInArrow(_rows, f"conv_id {kind}, turn long, edit string, role string, text string")


def report(rows: DataFrame, every: DataFrame) -> DataFrame:
    """The plan of each conversation of ``rows`` with the digest of its repaired ``role:text`` lines, for each conv_id of ``every``.

    A conv_id without rows has zeros, an empty audit and the digest of nothing.
    """
    placed = _placed(rows)
    found = written(_planned(_conversations(_judged(placed))), "plans")
    kind = rows.schema["conv_id"].dataType.simpleString()
    hashes = _sorted_with_plans(placed, found).mapInArrow(_hashes, f"conv_id {kind}, repaired_sha256 string")
    ids = every.select(F.col("conv_id").alias("id")).distinct()
    same = lambda other: F.col("id").eqNullSafe(F.col(other))
    joined = reduce(lambda a, b: a.join(b[0], same(b[1]), "left"), [(found.withColumnRenamed("conv_id", "p"), "p"), (hashes.withColumnRenamed("conv_id", "q"), "q")], ids)
    longs = ("gaps", *_COUNTS, "illegal", "cost")
    return joined.select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
