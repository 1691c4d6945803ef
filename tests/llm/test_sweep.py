"""The sweep of open intervals against brute force over every event."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vocabulon.llm import sweep
from vocabulon.llm.ship import ship

KIND = "key long, start long, end long, amount long"


@pytest.fixture(scope="module")
def sp(spark):
    ship(spark)
    return spark


def by_hand(rows, total=None):
    keys = {r[0] for r in rows if r[0] is not None} | ({total} if total is not None else set())
    out = set()
    for key in keys:
        moves = {}
        for k, a, b, amount in rows:
            if k is None or a is None or (b is not None and b <= a) or key not in (k, total):
                continue
            for t, sign in ((a, 1), (b, -1)):
                if t is not None:
                    n, c = moves.get(t, (0, 0))
                    moves[t] = n + sign, c + sign * (amount or 0)
        times = sorted(t for t, move in moves.items() if move != (0, 0))
        n = c = high = 0
        found = []
        for i, t in enumerate(times):
            n, c = n + moves[t][0], c + moves[t][1]
            high = max(high, n)
            found.append((key, t, times[i + 1] if i + 1 < len(times) else None, n, c, high))
        peak = max((x[4] for x in found), default=0)
        out |= {(*x, x[4] == peak) for x in found}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("key", "since", "until", "n_open", "amount_open", "high", "is_peak").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("width", "block", "parts"), [(1440, 256, 1), (7, 2, 5), (1, 3, 9), (50, 1, 64)])
def test_steps_equal_brute_force_however_they_are_cut(sp, width, block, parts):
    rng = random.Random(width)
    rows = [(rng.choice([1, 1, 1, 2, -1]), a := rng.randrange(-60, 300), rng.choice([None, a + rng.randrange(1, 90)]), rng.choice([None, 0, rng.randrange(-50, 500)])) for _ in range(300)]
    rows += [(None, 5, 9, 1), (3, None, 9, 1), (4, 9, 9, 1), (4, 9, 3, 1), (5, 2**40, None, 7), (5, -(2**40), 2**40, 7)] + rows[:40]  # no part, ends that cancel starts, far moments, repeated rows
    rows += [(6, 1, 20, 10), (6, 20, 40, 10), (6, 40, None, 3)]  # at 20 nothing changes, at 40 the amount alone
    df = sp.createDataFrame(rows, KIND).withColumn("part", F.lit("x")).repartition(parts)
    assert found(sweep.stepped(df, width, -2, block)) == by_hand(rows, -2)


def test_one_key_only_and_nothing_at_all(sp):
    rows = [(1, 3, 8, 5), (1, 3, 8, -5)]
    assert found(sweep.stepped(sp.createDataFrame(rows, KIND))) == by_hand(rows)
    assert sweep.stepped(sp.createDataFrame([], KIND), total=-2).collect() == []
    assert sweep.stepped(sp.createDataFrame([(1, 4, 4, 9)], KIND)).collect() == []


def test_functions_stay_as_small_as_their_range(sp):
    rows = sp.range(0, 20_000, 1, 4).select(F.lit(1).alias("key"), (F.col("id") % 97).alias("start"), (F.col("id") % 97 + F.col("id") % 5 + 1).alias("end"), F.lit(1).alias("amount"))
    leaves = sweep.local_functions(rows, 50).collect()
    assert len(leaves) == 4 * 3 and all(len(r["at"]) <= 50 for r in leaves)  # tasks x ranges, whatever the rows
    merged = sweep.added_in_pairs(sweep.added_in_pairs(sweep.local_functions(rows, 50))).collect()
    assert len(merged) == 3 and {r["part"] for r in merged} == {0}


def test_sales_of_a_shop(sp):
    day = datetime(2024, 3, 1, 10, 0, 30)
    ntz = "sale_id long, client_id long, total double, sold_at timestamp_ntz, item_id string"
    sales = sp.createDataFrame(
        [(1, 1, 1.005, day, "x"), (2, None, None, day, "x"), (3, 9, float("inf"), day + timedelta(seconds=29), "x"), (4, 2, 2.0, None, "x"), (5, 1, 3.0, day, "x"), (None, 3, 4.0, day, "x"), (1, 1, 1.005, day, "x")], ntz
    )
    lines = sp.createDataFrame(
        [(1, day + timedelta(days=2)), (1, day + timedelta(days=1)), (1, None), (5, day - timedelta(days=7, seconds=30)), (None, day), (3, None)], "sale_id long, shipped_at timestamp_ntz"
    )
    clients = sp.createDataFrame([(1, 7), (2, 8), (3, None), (3, 4), (None, 5)], "client_id long, nation_id int")
    got = sorted((tuple(r) for r in sweep.sale_intervals(sales, lines, clients).collect()), key=str)
    a = int((datetime(2024, 3, 1, 10) - datetime(1970, 1, 1)).total_seconds()) // 60
    assert got == sorted([(7, a, a + 8 * 1440, 100), (7, a, a + 8 * 1440, 100), (-1, a, None, 0), (-1, a, None, 0), (4, a, None, 400)], key=str)
    sp.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # a time without a zone is UTC, also in the hour that a zone leaves out
        odd = sp.createDataFrame([(datetime(2024, 3, 10, 2, 30),)], "t timestamp_ntz")
        assert odd.select(sweep.minutes(odd, "t")).first()[0] == (datetime(2024, 3, 10, 2, 30) - datetime(1970, 1, 1)).total_seconds() // 60
    finally:
        sp.conf.unset("spark.sql.session.timeZone")
