"""Problems 3 and 4 against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import random
import re
from collections import Counter, defaultdict
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway.llm import dedup, ranking
from sluiceway.operators import skew


def canonical(url):
    """An independent reading of the rules for copies."""
    u = re.sub(r"\s+", "", url)
    u, _, frag = u.partition("#")
    base, _, query = u.partition("?")
    base = re.sub(r"^(?:[a-zA-Z][\w+.-]*:)?//+", "", unquote(base))
    base = re.sub(r"^www\.", "", base, flags=re.I)
    norm = lambda s: re.sub(r"[\W_]+", "", unquote(s)).lower()
    pairs = Counter((norm(k), norm(v)) for k, _, v in (p.partition("=") for p in query.split("&")) if norm(k) or norm(v))
    return norm(base), norm(frag), frozenset(pairs.items())


URLS = [
    (1, "https://www.a.test/x-y?b=1&a=2"), (2, "HTTP://A.test/x%2Dy/?a=2&b=1"), (3, "http://a.test/xy?a=2&b=1&"), (4, "http://a.test/xy?a=1&b=2"), (5, None), (6, None), (7, "  https://a.test//X_Y?b=1&a=2#  "),
    (8, "http://a.test/yx?a=2&b=1"), (9, "http://b.test/"), (10, "https://www.b.test"), (10, "https://www.b.test"), (11, "http://b.test/?"), (12, ""), (13, " "), (14, "http://b.test/%zz"), (15, "http://c.test/p?a=1&a=1"), (16, "http://c.test/p?a=1"),
    (17, "http://c.test/p?a=1&A=1"), (18, "http://w.test/wwwx"), (19, "http://www.w.test/www.x"), (20, "a.test/x-y?b=1&a=2"), (21, "http://d.test/é?x=ü"), (22, "http://d.test/%C3%A9?X=%C3%BC"),
]


def expected(rows):
    groups = defaultdict(set)
    for i, u in rows:
        if u is not None:
            groups[canonical(u)].add(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def test_copies_equal_brute_force(spark):
    rows = [r for r in URLS if r[0] != 14]
    df = spark.createDataFrame(rows, "result_id bigint, url string")
    got = {tuple(r) for r in dedup.copies(df, "result_id", dedup.url_fields(F.col("url"))).collect()}
    assert got == expected(rows)
    counts = {r[0]: r[1] for r in dedup.copy_counts(df, "result_id", dedup.url_fields(F.col("url"))).collect()}
    assert sum(counts.values()) == len({i for i, _ in rows}) and counts[1] == 5 and counts[5] == 1


def test_malformed_percent_codes_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://b.test/%zz", "u"), (2, "http://b.test/zz", "v")], "id bigint, url string, fields string")
    assert [tuple(r) for r in dedup.copies(df, "id", dedup.url_fields(F.col("url"))).collect()] == [(1, 2)]


def test_records_in_any_field_order(spark):
    df = spark.createDataFrame([(1, "A-b", "x"), (2, "a b", "X."), (3, "x", "ab"), (4, None, "x"), (5, None, "x ")], "id bigint, p string, q string")
    got = {tuple(r) for r in dedup.copies(df, "id", dedup.record_fields(["p", "q"])).collect()}
    assert got == {(1, 2), (4, 5)}


def test_no_rows(spark):
    df = spark.createDataFrame([], "result_id bigint, url string")
    assert dedup.copies(df, "result_id", dedup.url_fields(F.col("url"))).count() == 0


def test_colliding_fingerprints_never_merge(spark, monkeypatch):
    monkeypatch.setattr(dedup, "fingerprint", lambda f: (F.lit(1).cast("bigint"), F.lit(1).cast("bigint")))
    rows = [(1, "http://a.test/1"), (2, "http://a.test/2"), (3, "http://a.test/2"), (4, "http://a.test/1"), (5, "http://a.test/3")]
    df = spark.createDataFrame(rows, "result_id bigint, url string")
    got = {tuple(r) for r in dedup.copies(df, "result_id", dedup.url_fields(F.col("url"))).collect()}
    assert got == {(1, 4), (2, 3)}


def test_hot_groups_take_the_other_path(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_LEAST", 20)
    rng = random.Random(3)
    rows = [(i, f"http://hot.test/{'-' * rng.randrange(5)}x") for i in range(200)] + [(200 + i, f"http://c.test/{i % 50}") for i in range(100)]
    df = spark.createDataFrame(rows, "result_id bigint, url string")
    got = {tuple(r) for r in dedup.copies(df, "result_id", dedup.url_fields(F.col("url"))).collect()}
    assert got == expected(rows)


def brute_best(scores, low):
    last = {}
    for q, r, s, v, at in scores:
        if (q, r, s) not in last or (at, v is not None, v or 0) > (last[q, r, s][0], last[q, r, s][1] is not None, last[q, r, s][1] or 0):
            last[q, r, s] = (at, v)
    by = defaultdict(dict)
    for (q, r, s), (_, v) in last.items():
        if v is not None:
            by[q, s][r] = -v if s in low else v
    sources, votes = defaultdict(set), Counter()
    for (q, s), d in by.items():
        sources[q].add(s)
        top = [r for r, v in d.items() if v == max(d.values())]
        if len(top) == 1:
            votes[q, top[0]] += 1
    return {(q, r) for (q, r), n in votes.items() if len(sources[q]) >= 3 and n >= len(sources[q]) - 1}


def make_scores(seed, n_queries=12):
    rng = random.Random(seed)
    rows = []
    for q in range(n_queries):
        names = rng.sample("abcdef", rng.randint(1, 5))
        star = rng.randrange(8)
        for s in names:
            for r in range(8):
                v = round(rng.random() * 10 ** rng.randint(0, 4), 1) if rng.random() < 0.9 else None
                if r == star and rng.random() < 0.85:
                    v = -50.0 if s in "ab" else 99999.0
                rows.append((q, q * 100 + r, s, v, rng.randint(1, 3)))
                if rng.random() < 0.1:
                    rows.append((q, q * 100 + r, s, 5.0, rng.randint(0, 4)))
                if rng.random() < 0.1:
                    rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_agreed_best_equals_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(skew, "HOT_LEAST", 30)
        monkeypatch.setattr(skew, "HOT_PARTS", 100)
    rows = make_scores(7)
    df = spark.createDataFrame(rows, "query_id bigint, result_id bigint, source string, score double, scored_at int")
    src = spark.createDataFrame([(s, "low" if s in "ab" else "high") for s in "abcde"], "source string, better string")
    ranking_ = ranking.fuse_rankings(df, src).collect()
    assert {(r["query_id"], r["result_id"]) for r in ranking.agreed_best(ranking.fuse_rankings(df, src)).collect()} == brute_best(rows, {"a", "b"})
    by = defaultdict(list)
    for r in ranking_:
        by[r["query_id"]].append((r["position"], -r["projection"], r["result_id"]))
    for places in by.values():
        places.sort()
        assert [p[0] for p in places] == list(range(1, len(places) + 1))
        assert [p[1:] for p in places] == sorted(p[1:] for p in places)


def test_no_source_rules_by_its_range(spark):
    """One source has a huge range and disagrees with four others: the four win."""
    rows = []
    for r in range(20):
        rows += [(1, r, s, float(r) * k, 1) for s, k in zip("abcd", (1, 2, 0.5, 0.01), strict=True)]
        rows.append((1, r, "z", float((r * 7) % 20) * 1e9, 1))
    df = spark.createDataFrame(rows, "query_id bigint, result_id bigint, source string, score double, scored_at int")
    src = spark.createDataFrame([(s, "high") for s in "abcdz"], "source string, better string")
    top = {r["position"]: r["result_id"] for r in ranking.fuse_rankings(df, src).collect()}
    assert top[1] == 19 and top[20] == 0


def test_ranking_of_nothing(spark):
    df = spark.createDataFrame([], "query_id bigint, result_id bigint, source string, score double, scored_at int")
    src = spark.createDataFrame([], "source string, better string")
    assert ranking.agreed_best(ranking.fuse_rankings(df, src)).count() == 0
    one = spark.createDataFrame([(1, 1, "a", None, 1), (1, None, "a", 1.0, 1)], df.schema)
    assert ranking.fuse_rankings(one, src).count() == 0


def test_the_component_decides_the_order(spark):
    """Loadings are those of the matrix, their signs those of the declared directions; the floor never hides an agreed best."""
    rng = random.Random(9)
    rows = []
    for q in range(30):
        for r in range(9):
            z = rng.gauss(0, 1)
            for s, (k, noise) in {"a": (1, 0.3), "b": (-100, 0.5), "c": (5, 2.0), "d": (0.01, 0.4)}.items():
                if rng.random() < 0.8:
                    rows.append((q, q * 10 + r, s, k * (z + rng.gauss(0, noise)), 1))
    df = spark.createDataFrame(rows, "query_id bigint, result_id bigint, source string, score double, scored_at int")
    src = spark.createDataFrame([("a", "high"), ("b", "low")], "source string, better string")
    got = {(r["query_id"], r["result_id"]): r for r in ranking.fuse_rankings(df, src).collect()}
    by = defaultdict(dict)
    for q, r, s, v, _ in rows:
        by[q, s][r] = -v if s == "b" else v
    rank = {(r, s): (sum(y < v for y in d.values()) + 1) / (len(d) + 1) for (q, s), d in by.items() for r, v in d.items()}
    names = "abcd"
    m = np.eye(4)
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            both = [(rank[r, x], rank[r, y]) for r in {r for _, r in got} if (r, x) in rank and (r, y) in rank]
            m[i, j] = np.corrcoef(np.array(both).T)[0, 1] if i != j else 1.0
    load = np.abs(np.linalg.eigh(m)[1][:, -1])
    stat = {s: (np.mean(v), np.std(v)) for s in names for v in [[x for (r, t), x in rank.items() if t == s]]}
    for (q, r), row in got.items():
        want = sum(load[i] * (rank[r, s] - stat[s][0]) / stat[s][1] for i, s in enumerate(names) if (r, s) in rank)
        assert abs(row["projection"] - want) < 1e-6
    assert {(r["query_id"], r["result_id"]) for r in ranking.agreed_best(ranking.fuse_rankings(df, src)).collect()} == brute_best(rows, {"b"})
