"""Joins and ranks under hot keys against brute force."""

import random
from collections import defaultdict

import pytest

from sluiceway.operators import skew


@pytest.mark.parametrize("least", [10, 10_000])
def test_grouped_rank_is_exact_on_either_path(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "HOT_LEAST", least)
    monkeypatch.setattr(skew, "HOT_PARTS", 100)
    rng = random.Random(5)
    rows = [("hot", float(rng.randint(0, 40))) for _ in range(400)] + [(f"g{i % 7}", float(rng.randint(0, 5))) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["v"]): (r["n_less"], r["n_equal"], r["n_all"]) for r in skew.grouped_rank(df, ["g"], "v", len(rows), buckets=8).collect()}
    for g in {g for g, _ in rows}:
        vs = [v for h, v in rows if h == g]
        for v in vs:
            assert got[g, v] == (sum(x < v for x in vs), vs.count(v), len(vs))


@pytest.mark.parametrize("least", [10, 10_000])
@pytest.mark.parametrize("nulls", [5, 90])
def test_grouped_rank_keeps_a_null_group_on_either_path(spark, monkeypatch, least, nulls):
    monkeypatch.setattr(skew, "HOT_LEAST", least)
    monkeypatch.setattr(skew, "HOT_PARTS", 100)
    rng = random.Random(7)
    rows = [(None, "s", float(rng.randint(0, 30))) for _ in range(nulls)] + [("g", rng.choice(["s", None]), float(rng.randint(0, 30))) for _ in range(60)]
    got = {(r["g"], r["h"], r["v"]): (r["n_less"], r["n_equal"], r["n_all"]) for r in skew.grouped_rank(spark.createDataFrame(rows, "g string, h string, v double"), ["g", "h"], "v", len(rows), buckets=8).collect()}
    want = defaultdict(list)
    for g, h, v in rows:
        want[g, h].append(v)
    assert got == {(*k, v): (sum(x < v for x in vs), vs.count(v), len(vs)) for k, vs in want.items() for v in vs}


@pytest.mark.parametrize("least", [10, 10_000])
def test_row_numbers_on_either_path(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "HOT_LEAST", least)
    rng = random.Random(8)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = {r["i"]: r["n"] for r in skew.row_numbers(df, ["g"], ["v", "i"], "n").collect()}
    for g in ("hot", "a", "b", None):
        mine = sorted((v, i) for h, v, i in rows if h == g)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
