"""Resampling of whole studies against plain Python over the same draws."""

import random
import statistics
from bisect import bisect_right
from datetime import datetime, timedelta

import pytest

from tidemark.operators import resampling as R
from tidemark.operators import study as S

SCHEMA = "id bigint, asset string, horizon int, treated boolean, starts boolean, outcome double, observed_at timestamp"


def rows(n=240, seed=4):
    r, out = random.Random(seed), []
    for i in range(n):
        treated = r.random() < 0.3
        for h in (1, 24):
            value = None if r.random() < 0.1 else round(r.gauss(0.4 if treated and h == 24 else 0, 1), 2)
            out.append((i, r.choice(["a", "b", "b", "thin"]) if i > 3 else "lone", h, treated, treated and r.random() < 0.5, value, datetime(2024, 1, 1) + timedelta(hours=i)))
    return out


def study_cells(data):
    got = {}
    for i, asset, h, treated, starts, v, _ in data:
        if v is None:
            continue
        for level in ("observation", "regime"):
            if level == "regime" and treated and not starts:
                continue
            for population in (asset, "POOLED"):
                got.setdefault((level, population, h), []).append((i, treated, v))
    return got


def h_of(i, seed):
    return R.number(seed, i) % R.PRIME


@pytest.fixture(scope="module")
def outcomes(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def test_study_equals_plain_python(spark, outcomes):
    B, seed = 60, 9
    a, b = (x.tolist() for x in R.multipliers(seed, B))
    want = {}
    for cell, members in study_cells(rows()).items():
        t, o = [v for _, x, v in members if x], [v for _, x, v in members if not x]
        if len(t) < 2 or len(o) < 2:
            want[cell] = (len(t), len(o), None, None, None)
            continue
        real, hits = statistics.fmean(t) - statistics.fmean(o), 0
        for r in range(B):
            order = sorted(((h_of(i, seed) * a[r] + b[r]) % R.PRIME, i, v) for i, _, v in members)
            d = statistics.fmean(v for *_, v in order[: len(t)]) - statistics.fmean(v for *_, v in order[len(t) :])
            hits += abs(d) >= abs(real) - 1e-12
        spread = max(1e-12, ((statistics.pvariance(t) + statistics.pvariance(o)) / 2) ** 0.5)
        want[cell] = (len(t), len(o), real, real / spread, (hits + 1) / (B + 1))
    got = {(r.level, r.population, r.horizon): (r.n_treated, r.n_ordinary, r.mean_diff, r.standardized_diff, r.p_value) for r in R.study(outcomes, B, seed).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9), k


def test_bootstrap_equals_plain_python(spark, outcomes):
    B, seed = 80, 5
    a, b = (x.tolist() for x in R.multipliers(seed, B))
    want = {}
    for cell, members in study_cells(rows()).items():
        diffs = []
        for r in range(B):
            sums = {True: [0, 0.0], False: [0, 0.0]}
            for i, t, v in members:
                w = bisect_right(R.POISSON, ((h_of(i, seed) * a[r] + b[r]) % R.PRIME) / R.PRIME)
                sums[t][0] += w
                sums[t][1] += w * v
            if sums[True][0] and sums[False][0]:
                diffs.append(sums[True][1] / sums[True][0] - sums[False][1] / sums[False][0])
        if diffs:
            diffs.sort()
            want[cell] = (diffs[int(0.025 * (len(diffs) - 1))], diffs[int(0.975 * (len(diffs) - 1))])
    got = {(r.level, r.population, r.horizon): (r.ci_low, r.ci_high) for r in R.bootstrap(outcomes, B, seed).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9), k


def test_no_rows(spark, outcomes):
    assert R.bootstrap(outcomes.limit(0), 10).count() == 0 and R.study(outcomes.limit(0), 10).count() == 0


def test_ranks(spark):
    r = random.Random(2)
    data = [("x", r.choice([0.0, 1.0, 1e9, -3.5, r.random()])) for _ in range(500)] + [("same", 7.0)] * 40 + [("one", -1.0)]
    df = spark.createDataFrame(data, "k string, _v double")
    sizes = {"x": 500, "same": 40, "one": 1}
    asked = [(k, str(i), i) for k, n in sizes.items() for i in {0, n // 2, (n - 1) // 2, n - 1, n // 3}]
    got = {(x.k, x.name): x.value for x in R.histogram_ranks(df, ["k"], spark.createDataFrame(asked, "k string, name string, rank bigint"), cells=8).collect()}
    ordered = {k: sorted(v for q, v in data if q == k) for k in sizes}
    assert got == {(k, name): ordered[k][i] for k, name, i in asked}


def verdict(spark, tests, shuffled=0.1, coverage=(("a", 5, 5),), **more):
    t = spark.createDataFrame(tests, "level string, population string, horizon int, n_treated bigint, p_value double, mean_diff double")
    c = spark.createDataFrame([(shuffled,)], "shuffled_diff double")
    return R.verdict(t, c, spark.createDataFrame(list(coverage), "asset string, eligible bigint, covered bigint"), **more).first()["disposition"]


def test_verdicts(spark):
    cell = lambda n=20, r=6, p=0.01, q=0.02, d=0.5: [("observation", "POOLED", 24, n, p, d), ("regime", "POOLED", 24, r, q, d), ("observation", "POOLED", 4, 99, 0.9, 9.0), ("observation", "a", 24, 99, 0.9, 9.0)]
    assert verdict(spark, cell()) == "SUPPORTED"
    assert verdict(spark, cell(), shuffled=-0.6) == "INCONCLUSIVE"
    assert verdict(spark, cell(), coverage=[("a", 5, 5), ("b", 1, 0)]) == "DATA_INSUFFICIENT"
    assert verdict(spark, cell(), coverage=[("a", 5, 5), ("b", 0, 0)]) == "SUPPORTED"
    assert verdict(spark, cell(n=11)) == verdict(spark, cell(r=4)) == verdict(spark, []) == "DATA_INSUFFICIENT"
    assert verdict(spark, cell(q=0.05)) == "INCONCLUSIVE"
    assert verdict(spark, cell(p=0.05)) == "REJECTED"
    assert verdict(spark, cell(p=None, d=None)) == "DATA_INSUFFICIENT"


def test_roles_and_adjusted_values(spark):
    data = [("observation", "POOLED", 24, 0.001), ("observation", "POOLED", 1, 0.04), ("observation", "a", 24, 0.01), ("observation", "a", 1, 0.03), ("observation", "b", 24, None), ("regime", "a", 1, 0.002)]
    df = spark.createDataFrame(data, "level string, population string, horizon int, p_value double").selectExpr("*", "'s' AS study").withColumn("role", S.role())
    got = {(r.level, r.population, r.horizon): (r.role, r.p_adjusted) for r in S.bh_adjust(df, ["study"]).collect()}
    assert got[("observation", "POOLED", 24)] == ("PRIMARY", None) and got[("regime", "a", 1)] == ("EXPLORATORY", None)
    assert [got[("observation", *k)][1] for k in (("a", 24), ("a", 1), ("POOLED", 1))] == pytest.approx([0.03, 0.04, 0.04])


def test_medians_of_groups_with_null_keys_and_outliers(spark):
    import statistics

    r = random.Random(5)
    data = [(k, f, None if r.random() < 0.1 else r.choice([0.0, 0.25, 1e12, -7.0, r.gauss(0, 1e-6)])) for k in ("a", "b", None) for f in (True, False, None) for _ in range(r.randint(60, 90))]
    data += [("one", True, 2.0), ("one", False, 1.0), ("none", True, None)]
    df = spark.createDataFrame(data, "k string, treated boolean, outcome double")
    got = {x.k: x for x in S.effect_sizes(df, ["k"]).collect()}
    summed = {x.k: x for x in S.outcome_summary(df, ["k"]).collect()}
    assert set(got) == set(summed) == {"a", "b", None, "one", "none"}
    for k in got:
        side = {f: [v for q, g, v in data if q == k and g is f and v is not None] for f in (True, False)}
        every = sorted(v for q, _, v in data if q == k and v is not None)
        assert (got[k].n_treated, got[k].n_ordinary) == (len(side[True]), len(side[False]))
        if min(map(len, side.values())) < 2:
            assert got[k].median_diff is None and got[k].mean_diff is None
        else:
            assert got[k].median_diff == statistics.median(side[True]) - statistics.median(side[False])
        assert summed[k].n == len(every) and summed[k].missing == sum(q == k and v is None for q, _, v in data)
        assert summed[k]["median"] == (statistics.median(every) if every else None)
        assert [summed[k][f"p{p:02d}"] for p in (5, 25, 50, 75, 95)] == [every[round((len(every) - 1) * p / 100)] if every else None for p in (5, 25, 50, 75, 95)]


def test_digests_of_many_texts():
    import hashlib

    from tidemark.operators.digests import Endings

    ends = [b"|0", b"|-7", b"", b"|123456", b"|1|99", b"|%d" % (10**17), b"|0"]
    made = Endings(ends)
    for beginning in (b"9|0", b"20260901|17", b"20260901|999"):
        assert made.numbers(beginning).tolist() == [int(hashlib.md5(beginning + e).hexdigest()[:8], 16) for e in ends]


def test_resamples_are_made_inside_tasks(spark, monkeypatch):
    """Equal to plain Python, also where a side has several blocks, and without a row for each replicate and row."""
    monkeypatch.setattr(R, "PICKED", 25)
    B, seed = 40, 9
    data = [(i, k, t, v, at) for i, k, h, t, _, v, at in rows() if h == 24 and k != "lone"]
    df = spark.createDataFrame(data, "id bigint, k string, treated boolean, outcome double, observed_at timestamp").repartition(4)
    ci, p = {}, {}
    for k in {x[1] for x in data}:
        known = sorted((at, i, t, v) for i, q, t, v, at in data if q == k and v is not None)
        side = {t: [x[3] for x in known if x[2] is t] for t in (True, False)}
        mean = lambda t, r: statistics.fmean(side[t][R.number(seed, r, int(t), i) % len(side[t])] for i in range(len(side[t])))  # noqa: B023, E731
        diffs = sorted(mean(True, r) - mean(False, r) for r in range(B))
        ci[k] = (diffs[int(0.025 * (B - 1))], diffs[int(0.975 * (B - 1))])
        real, hits, n = statistics.fmean(side[True]) - statistics.fmean(side[False]), 0, len(side[True])
        for r in range(B):
            order = [v for *_, v in sorted((R.number(seed, r, i), i, v) for _, i, _, v in known)]
            hits += abs(statistics.fmean(order[:n]) - statistics.fmean(order[n:])) >= abs(real) - 1e-12
        p[k] = (real, (hits + 1) / (B + 1))
    got = {x.k: (x.ci_low, x.ci_high) for x in S.bootstrap_ci(df, ["k"], B, seed).collect()}
    assert set(got) == set(ci) and all(got[k] == pytest.approx(ci[k]) for k in ci)
    tested = S.permutation_p(df, ["k"], B, seed)
    assert {x.k: (x["diff"], x.p_value) for x in tested.collect()} == {k: pytest.approx(v) for k, v in p.items()}


def test_draws_are_remainders_and_stay_in_cache():
    import numpy as np

    a, b = R.multipliers(7, 1000)
    h = np.array([0, 1, 2, R.PRIME - 1, R.PRIME // 2, *np.random.default_rng(3).integers(0, R.PRIME, 400)])
    want = [[(int(x) * int(p) + int(q)) % R.PRIME for p, q in zip(a, b, strict=True)] for x in h[:8]]
    assert R._draws(h, a, b)[:8].tolist() == want and R._draws(h, a, b).max() < R.PRIME
    assert R.ROWS * 1000 * 8 <= 1 << 20


@pytest.mark.parametrize("bundle", [1, 400, 1 << 26])
def test_digests_are_made_once_for_all_blocks_of_a_bundle(spark, monkeypatch, bundle):
    """Groups and blocks that a task holds share the digests; bundles of one block each give the same interval."""
    from tidemark.operators import digests

    monkeypatch.setattr(R, "PICKED", 25)
    monkeypatch.setattr(R, "BUNDLE", bundle)
    r, made = random.Random(4), spark.sparkContext.accumulator(0)
    counting = digests.Endings.counting.__func__

    class Counted(digests.Endings):
        @classmethod
        def counting(cls, before, start, stop):
            made.add(stop - start)
            return counting(digests.Endings, before, start, stop)

    monkeypatch.setattr(R, "Endings", Counted)
    sides = {(g, s): [r.choice([1.5, -2.0, r.random()]) for _ in range(n)] for g, s, n in (("a", 1, 30), ("a", 0, 130), ("b", 1, 7), ("b", 0, 100))}
    df = spark.createDataFrame([(g, s, i, v) for (g, s), vs in sides.items() for i, v in enumerate(vs)], "_g string, _side int, _i bigint, _v double").repartition(3)
    got = {x._g: (x.ci_low, x.ci_high) for x in R.digest_bootstrap(df, 40, 7).collect()}
    mean = lambda g, s, k: statistics.fmean(sides[g, s][R.number(7, k, s, i) % len(sides[g, s])] for i in range(len(sides[g, s])))
    for g in "ab":
        d = sorted(mean(g, 1, k) - mean(g, 0, k) for k in range(40))
        assert got[g] == pytest.approx((d[int(0.025 * 39)], d[int(0.975 * 39)]))
    if bundle == 1 << 26:
        assert made.value == (130 + 30) * min(40, R.SHARES)
