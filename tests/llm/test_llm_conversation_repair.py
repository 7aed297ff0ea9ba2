import hashlib
import random
import sys
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from cleanframe.llm import conversation_repair as cr
from cleanframe.llm.queries import damaged

sys.setrecursionlimit(20_000)
SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """(cost, audit, digest, counts) of the sorted (role, text) rows of a conversation, by trying all edits."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in (0, 3):
            options.append((0, "", ()))
        if inserts < 3:
            for letter in "ua":
                if (state, letter) in step:
                    cost, audit, rest = best(i, step[state, letter], inserts + 1)
                    options.append((cost + 5, "I" + audit, ((names[letter], ""), *rest)))
        if i < len(rows):
            cost, audit, rest = best(i + 1, state, 0)
            options.append((cost + 2, "D" + audit, rest))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                role, text = rows[i]
                if (state, role[:1]) in step:
                    cost, audit, rest = best(i + 1, step[state, role[:1]], 0)
                    options.append((cost + more, "K" + audit, ((role, text), *rest)))
                for letter in "ua":
                    if (state, letter) in step:
                        cost, audit, rest = best(i + 1, step[state, letter], 0)
                        options.append((cost + more + 1, "R" + audit, ((names[letter], text), *rest)))
        return min(options, default=(1 << 30, "", ()))

    cost, audit, turns = best(0, 0, 0)
    initials = [r[:1] for r, _ in rows]
    return {
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
    }


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        turns = {r[1] for r in own if r[1] is not None}
        out[conv] = {**plain([(r, x) for _, _, r, x in own]), "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0}
    return out


def made(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for t in range(rng.randint(1, longest)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut", "", " \n", "Hm?", None, f"text {t}.", f"long {t}", "多字节。"])
            rows += [(conv if conv else None, None if rng.random() < 0.05 else t, role, text)] * rng.choice([1, 1, 1, 2])
    # Turns of equal number and role keep an order by digest; the plain version has none, so they get numbers of their own.
    seen, out = {}, []
    for r in rows:
        key = (r[0], r[1], r[2] if r[2] is not None else " ")
        if seen.setdefault(key, r) == r:
            out.append(r)
    return out


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_repair_is_the_cheapest(spark, batch):
    rows = made(5, 40, 25) + [(99, t, "user" if t % 40 else "system", "Go on") for t in range(300)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit("clash")).repartition(5)
        got = {r["c"]: r.asDict() for r in cr.repair(df).conversations().collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    wanted = expected(rows)
    assert set(got) == set(wanted)
    for conv, own in wanted.items():
        assert {k: got[conv][k] for k in own} == own, conv


def test_powers_agree_with_single_steps():
    for code in range(16):
        costs = cr.END
        for _ in range(37):
            costs = cr.applied(cr.power(code, 0), costs)
        assert cr.advance(code, 37, cr.END) == costs
        assert cr.applied(cr.product([code] * 37), cr.END) == costs


def test_empty_table_and_repaired_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(none).conversations().collect() == []
    one = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "user", "Bye."), (1, 3, "assistant", "Bye.")], none.schema)
    turns = cr.repair(one).turns().orderBy("seq").collect()
    assert [(r.role, r.text) for r in turns] == [("user", "Hi."), ("assistant", "Hello."), ("user", "Bye."), ("assistant", "Bye.")]


def test_damage(spark):
    rows = [(i, t, "assistant", "One. Two!") for i in range(40) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = damaged(df).collect()
    import zlib

    wanted = []
    for c, t, r, x in rows:
        fill = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{fill(c)}:{fill(t)}".encode()) % 20
        role, text = fill(r), fill(x)
        text = "" if fate == 1 else text.replace(".", "").replace("!", "") if fate == 2 else text
        wanted += [(c, t, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    order = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=order) == sorted(wanted, key=order)
