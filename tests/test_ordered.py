"""Running values over sliced histories against plain loops."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from models import T0
from sightings.operators.changes import throttle
from sightings.operators.ordered import (
    as_of,
    before,
    held,
    highest,
    lag,
    last,
    rows_since,
    running,
    total,
)


def history(seed, n=300):
    rng = random.Random(seed)
    rows, at = [], {"a": T0, "b": T0, "hot": T0}
    for i in range(n):
        k = rng.choice(["a", "b", "hot", "hot", "hot"])
        at[k] += timedelta(seconds=rng.choice([1, 60, 600, 5000, 40_000]))
        v = rng.choice([None, 1, 2, 3])
        rows.append((k, at[k], i, v, rng.random() < 0.2))
    return rows


SCHEMA = "k string, ts timestamp, no long, v long, f boolean"


def per_key(rows):
    keys = {}
    for r in rows:
        keys.setdefault(r[0], []).append(r)
    return keys


@pytest.mark.parametrize("seed", [1, 2])
def test_running_values(spark, seed):
    rows = history(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = running(
        df, ["k"], ["ts", "no"],
        {"l": last("v"), "b": before("v"), "g": lag("v"), "t": total("v"), "h": highest("v")},
    )
    back = running(df, ["k"], ["ts", "no"], {"n": before("v")}, reverse=True)
    have = {r.no: (r.l, r.b, r.g, r.t, r.h) for r in got.collect()}
    nxt = {r.no: r.n for r in back.collect()}
    for seq in per_key(rows).values():
        seen, sums, prev = None, None, None
        best = None
        for r in seq:
            b, g = seen, prev
            if r[3] is not None:
                seen = r[3]
                sums = (sums or 0) + r[3]
                best = max(best or 0, r[3])
            prev = r[3]
            assert have[r[2]] == (seen, b, g, sums, best)
        seen = None
        for r in reversed(seq):
            assert nxt[r[2]] == seen
            seen = r[3] if r[3] is not None else seen


def test_rows_since_and_held(spark):
    rows = history(3)
    df = spark.createDataFrame(rows, SCHEMA)
    since = {
        r.no: r.s for r in rows_since(df, ["k"], ["ts", "no"], F.col("f"), "s").collect()
    }
    rng = random.Random(5)
    linked, want_held = [], {}
    for seq in per_key(rows).values():
        n, prev, on = 0, None, False
        for r in seq:
            n = 0 if r[4] else n + 1
            assert since[r[2]] == n
            link = prev if rng.random() < 0.8 else -1
            on = r[4] or (on and link == prev and prev is not None)
            want_held[r[2]] = on
            linked.append((*r, link))
            prev = r[2]
    d = spark.createDataFrame(linked, SCHEMA + ", prev long")
    got = held(d, ["k"], ["ts", "no"], F.col("f"), "no", "prev", "on").collect()
    assert {r.no: r.on for r in got} == want_held


def test_as_of_both_ways(spark):
    rng = random.Random(7)
    left = [(rng.choice("xy"), i, T0 + timedelta(seconds=rng.randrange(90_000))) for i in range(150)]
    right = [(rng.choice("xyz"), T0 + timedelta(seconds=rng.randrange(90_000)), i) for i in range(40)]
    right += [(left[0][0], left[0][2], 99)]
    l = spark.createDataFrame(left, "k string, id long, ts timestamp")
    r = spark.createDataFrame(right, "k string, at timestamp, val long")
    got = {x.id: x.val for x in as_of(l, r, ["k"], "ts", ["val"], "at", tie=["val"]).collect()}
    fwd = {
        x.id: x.val
        for x in as_of(l, r, ["k"], "ts", ["val"], "at", forward=True, tie=["val"]).collect()
    }
    for k, i, ts in left:
        past = [(t, v) for kk, t, v in right if kk == k and t <= ts]
        ahead = [(t, v) for kk, t, v in right if kk == k and t > ts]
        assert got[i] == (max(past)[1] if past else None)
        assert fwd[i] == (min(ahead)[1] if ahead else None)


def test_throttle(spark):
    rng = random.Random(9)
    rows, at = [], {"a": T0, "b": T0}
    for i in range(200):
        k = rng.choice("ab")
        at[k] += timedelta(hours=rng.choice([0, 1, 5, 11, 12, 24, 30]))
        rows.append((k, at[k], i))
    df = spark.createDataFrame(rows, "k string, ts timestamp, no long")
    got = {(r.k, r.no) for r in throttle(df, ["k"], "ts", 86_400, tie="no").collect()}
    want, fired = set(), {}
    for k, ts, no in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k not in fired or ts - fired[k] > timedelta(days=1):
            fired[k] = ts
            want.add((k, no))
    assert got == want
    plain = throttle(df.select("k", "ts"), ["k"], "ts", 86_400).collect()
    assert len(plain) == len(want)


@pytest.mark.parametrize("reverse", [False, True])
def test_rows_that_are_kept_have_the_values_of_all(spark, reverse):
    """Some slices hold no row that is kept, and hand on their values all the same."""
    values = lambda: {
        "l": last("v"), "b": before("v"), "g": lag("v"), "t": total("v"), "h": highest("v"),
    }
    d = spark.createDataFrame(history(11), SCHEMA)
    some = F.col("no") % 7 == 0
    all_rows = running(d, ["k"], ["ts", "no"], values(), reverse=reverse).filter(some)
    kept = running(d, ["k"], ["ts", "no"], values(), reverse=reverse, keep=some)
    assert kept.columns == all_rows.columns
    assert sorted(kept.collect(), key=lambda r: r.no) == sorted(all_rows.collect(), key=lambda r: r.no)
