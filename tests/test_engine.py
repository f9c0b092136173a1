"""Ranks over ranges, prefix counts, greedy books, settings trees and sketches against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import asof, decorrelate, ranks, scoring, settings, sketches


def test_counts_below_are_those_of_prefixes(spark):
    r = random.Random(1)
    series = {t: [r.choice([1.0, 2.0, 3.5, r.random() * 5]) for _ in range(n)] for t, n in (("a", 1), ("b", 2), ("c", 77), ("d", 256), ("e", 300))}
    points = spark.createDataFrame([(t, j, v) for t, vs in series.items() for j, v in enumerate(vs)], "t string, j int, value double")
    asked = [(t, q, q, r.choice([0.0, 2.0, 3.5, r.random() * 6])) for t, vs in series.items() for q in range(len(vs))]
    got = {(x.t, x.q): x.below for x in asof.count_below(points, spark.createDataFrame(asked, "t string, q int, upto int, value double"), ["t"]).collect()}
    assert got == {(t, q): sum(v < x for v in series[t][: upto + 1]) for t, q, upto, x in asked}


def test_running_places_of_groups_that_span_ranges(spark):
    r = random.Random(2)
    rows = [("hot" if k % 3 else f"g{k % 7}", r.randint(0, 50), k) for k in range(3000)]
    got = ranks.running(spark.createDataFrame(rows, "g string, v int, k int"), ["g"], [F.desc("v"), F.col("k")]).collect()
    want = {}
    for g in {g for g, *_ in rows}:
        mine = sorted([(-v, k) for x, v, k in rows if x == g])
        want |= {k: (place, len(mine)) for place, (_, k) in enumerate(mine, 1)}
    assert {x.k: (x.upto, x.total) for x in got} == want


def test_average_ranks_and_lanes(spark):
    r = random.Random(3)
    rows = [("x" if k % 4 else "y", f"T{k}", k, r.choice([1.0, 2.0, 2.0, r.random()]), r.gauss(0, 1)) for k in range(400)]
    table = spark.createDataFrame(rows, "arm string, ticker string, cutoff int, score double, relative double")
    got = {x.arm: (x.n, x.rho, x.edge) for x in ranks.lanes(table, ["arm"]).collect()}
    for arm in ("x", "y"):
        mine = [x for x in rows if x[0] == arm]

        def mean_ranks(values):
            return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]

        a, b = mean_ranks([x[3] for x in mine]), mean_ranks([x[4] for x in mine])
        ordered = sorted(mine, key=lambda x: (-x[3], x[1], x[2]))
        h = len(mine) // 2
        edge = statistics.mean(x[4] for x in ordered[:h]) - statistics.mean(x[4] for x in ordered[-h:])
        assert got[arm] == (len(mine), pytest.approx(statistics.correlation(a, b), abs=1e-6), pytest.approx(edge, abs=1e-6))


@pytest.mark.parametrize("fan", [2, 5, 32])
def test_weighted_prefixes_without_copies(spark, fan):
    r = random.Random(4)
    rows = [(r.randint(0, 5), k, r.gauss(0, 1)) for k in range(130)]
    times = {(d, b): r.randint(0, 3) for d in range(6) for b in range(6)}
    units = {d: [v for b, _, v in sorted(rows, key=lambda x: x[1]) for _ in range(times[d, b])] for d in range(6)}
    asked = [(d, q, upto) for d in range(6) for q, upto in enumerate((1, len(units[d]) // 2, len(units[d]))) if units[d]]
    drawn = spark.createDataFrame([(d, b, t) for (d, b), t in times.items() if t], "draw int, bucket int, times int")
    table = spark.createDataFrame(rows, "bucket int, k int, v double")
    got = ranks.weighted_prefixes(table, drawn, spark.createDataFrame(asked, "draw int, q int, upto int"), [F.col("k")], "v", fan).collect()
    assert {(x.draw, x.q): round(x["sum"], 6) for x in got} == {(d, q): round(sum(units[d][:upto]), 6) for d, q, upto in asked}


def correlation(a, b):
    k = min(len(a), len(b))
    a, b = a[:k], b[:k]
    if k < decorrelate.LEAST or len(set(a)) == 1 or len(set(b)) == 1:
        return None
    return statistics.correlation(a, b)


@pytest.mark.parametrize("block", [3, 40])
def test_greedy_books_refill_from_below(spark, block):
    r = random.Random(5)
    base = [[r.gauss(0, 1) for _ in range(36)] for _ in range(4)]
    rows = []
    for bucket in range(3):
        for k in range(30):
            trail = [x + r.gauss(0, 0.4) for x in base[k % 4]][: r.choice([36, 30, 11])]
            rows.append((bucket, f"n{k}", round(r.random(), 3), trail if k % 11 else [1.0] * 20))
    caps = [2.0, 0.8, 0.3]
    got = {(x.bucket, x.cap, x.id) for x in decorrelate.greedy(spark.createDataFrame(rows, "bucket int, id string, score double, trail array<double>"), caps, 6, block).collect()}
    want = set()
    for bucket in range(3):
        ranked = sorted([x for x in rows if x[0] == bucket], key=lambda x: (-x[2], x[1]))
        for cap in caps:
            kept = []
            for x in ranked:
                if len(kept) < 6 and (cap > 1 or all((c := correlation(x[3], y[3])) is None or c < cap for y in kept)):
                    kept.append(x)
            want |= {(bucket, cap, x[1]) for x in kept}
    assert got == want


def test_inverse_normal_of_many_places(spark):
    places = [k / 1000 for k in range(1, 1000)] + [1e-6, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in places], "p double").select(scoring.inverse_normal(F.col("p")).alias("z")).collect()
    assert [r.z for r in got] == [pytest.approx(statistics.NormalDist().inv_cdf(p), abs=1e-6) for p in places]


def test_overlays(spark):
    rows = {
        1: ('{"a": 1, "b": {"c": 2, "d": 3}}', '{"a": 5, "b": {"c": null, "e": 4}}', {"a": "5", "b/c": "2", "b/d": "3", "b/e": "4"}),
        2: ('{"a": {"x": 1}}', '{"a": 7, "n": null}', {"a": "7", "n": None}),
        3: ('{"a": 1}', '{"a": {"x": 2}}', {"a/x": "2"}),
        4: ('{"a": {"x": 1}, "l": [1, 2]}', '{"a": null, "l": [3]}', {"a/x": "1", "l": "[3]"}),
        5: ('{"a": 1.0}', "not json", {"a": "1"}),
    }
    base, over = (settings.leaves(spark.createDataFrame([(k, v[i]) for k, v in rows.items()], "id int, json string")) for i in (0, 1))
    got = {}
    for x in settings.overlaid(base, over).collect():
        got.setdefault(x.id, {})[x.path] = x.value
    assert got == {k: v[2] for k, v in rows.items()}
    assert {(x.id, x.path, x.was, x.now) for x in settings.drift(base, over).collect()} == {(1, "a", "1", "5"), (1, "b/e", None, "4"), (2, "a", None, "7"), (3, "a/x", None, "2"), (4, "l", "[1,2]", "[3]")}


def test_both_caps_of_sizes_hold(spark):
    r = random.Random(6)
    rows = [(f"T{k}", "core" if k % 3 else "other", f"s{k % 4}", r.uniform(1, 90), r.uniform(1, 20)) for k in range(60)]
    table = spark.createDataFrame(rows, "ticker string, class string, sector string, score double, volatility double")
    got = {x.ticker: x.weight for x in scoring.sizes(table, spark.createDataFrame([("core", 70.0), ("other", 30.0)], "class string, budget double"), 0.04, sector_cap=0.15, sector_class="core").collect()}
    assert max(got.values()) <= 0.04 + 1e-9 and len(got) == 60
    for sector in {x[2] for x in rows}:
        assert sum(got[x[0]] for x in rows if x[1] == "core" and x[2] == sector) <= 0.15 + 1e-5


def test_sketches_merge_within_their_bounds(spark):
    events = spark.range(60000).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"), (F.col("id") * 7919 % 5000).alias("user_id"), (F.col("id") * 104729 % 1009).cast("double").alias("value"))
    week = F.date_trunc("week", "day").cast("date")
    rows = sketches.checked(events.withColumn("day", F.to_date("ts")), week, sketches.merged(sketches.daily(events), week)).collect()
    assert len(rows) >= 3 and all(x.users_near and x.median_near and x.p90_near for x in rows)
