"""Guards and boundaries of the series measures on small closed-form series."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import decorrelate, journal, scoring, series, stats, universe, walk
from tallyforge.sources import tables as T


def bars(spark, closes, ticker="A", gap=1):
    start = date(2010, 1, 4)
    return spark.createDataFrame([(ticker, start + timedelta(days=gap * k), float(c), 10.0) for k, c in enumerate(closes)], "ticker string, bar_date date, close double, volume double")


def test_drawdown_of_a_known_path(spark):
    row = series.drawdown(bars(spark, [3, 1, 5, 2])).first()
    assert row.max_drawdown == pytest.approx(66.666667, abs=1e-5)
    assert row.rolling_positive is None and row.worst_rolling is None


def test_flat_prices_are_a_perfect_trend(spark):
    row = series.trend(bars(spark, [5.0] * 10)).first()
    assert (row.trend_r2, row.trend_cagr, row.from_high, row.at_high, row.at_low) == (1.0, 0.0, 0.0, True, True)


def test_one_bar_has_no_risk(spark):
    row = series.risk(bars(spark, [5.0])).first()
    assert row.volatility is None and row.downside is None and row.max_daily is None


def test_empty_bars_give_no_rows(spark):
    none = bars(spark, [1.0]).limit(0)
    assert series.risk(none).count() == series.drawdown(none).count() == series.streak(none).count() == 0


def test_horizons_need_the_history(spark):
    rows = {r.horizon: r.change for r in series.horizon_changes(bars(spark, range(1, 400))).collect()}
    assert rows["1Y"] is not None and rows["5Y"] is None and rows["20Y"] is None


def test_streak_names_its_span(spark):
    row = series.streak(bars(spark, [5, 4, 5, 6, 7])).first()
    assert (row.direction, row.days, row.duration) == (1, 3, "3d")


def test_correlation_without_variance_is_null(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "g string, x double, y double")
    assert stats.correlations(rows, "g", "x", "y").first().pearson is None


def test_ties_share_their_rank(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double").withColumn("g", F.lit(1))
    assert sorted(r.r for r in rows.withColumn("r", stats.average_rank("v", "g")).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_missing_values_pass_gates(spark):
    columns = ["age_years", "pct_rank", "life_cagr", "max_drawdown", "above_ma", "volatility", "avg_turnover"]
    rows = spark.createDataFrame([(None,) * 7, (1.0, 50.0, 5.0, 10.0, 0.0, 10.0, 1e6)], ", ".join(f"{c} double" for c in columns))
    assert [r.f for r in rows.select(scoring.failed(scoring.Knobs()).alias("f")).collect()] == [[], ["young"]]


def test_relative_returns_sum_to_zero(spark, sf_dir):
    rows = walk.samples(T.bars(spark, sf_dir), T.spans(spark, sf_dir), T.sectors(spark, sf_dir), peers=10**6)
    sums = rows.groupBy("bucket").agg(F.sum("relative").alias("s"), F.count("*").alias("n")).collect()
    assert sums and all(abs(r.s) < 1e-5 * r.n for r in sums)


def test_decorrelation_keeps_the_first_of_twins(spark):
    up = [float(k % 5) for k in range(20)]
    rows = spark.createDataFrame([(0, "a", 4.0, up), (0, "b", 3.0, [2 * x for x in up]), (0, "c", 2.0, [-x for x in up]), (0, "d", 1.0, up[:5])], "bucket int, id string, score double, trail array<double>")
    assert {r.id for r in decorrelate.greedy(rows, [0.6]).collect()} == {"a", "c", "d"}


def test_sizes_keep_the_cap(spark):
    rows = spark.createDataFrame([("a", "x", 9.0, 1.0), ("b", "x", 1.0, 1.0), ("c", "y", 1.0, 1.0)], "ticker string, class string, score double, volatility double")
    budgets = spark.createDataFrame([("x", 50.0), ("y", 50.0)], "class string, budget double")
    weights = {r.ticker: r.weight for r in scoring.sizes(rows, budgets, 0.3).collect()}
    assert weights["a"] == 0.3 and weights["b"] == pytest.approx(0.2) and weights["c"] == 0.3


def test_bootstrap_draws_repeat(spark):
    buckets = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 5)], "bucket int")
    a, b = (sorted(stats.draws(spark, buckets, 30, 2).collect()) for _ in range(2))
    assert a == b and {r.bucket for r in a} <= {1, 2, 3, 4, 5} and {r.draw for r in a} == set(range(30))
    assert all(sum(r.times for r in a if r.draw == k) == 5 for k in range(30)) and len({tuple((r.bucket, r.times) for r in a if r.draw == k) for k in range(30)}) > 5


def test_bands_need_buckets(spark):
    rows = spark.createDataFrame([(k % 3, f"t{k}", k, float(k), float(k % 7)) for k in range(30)], "bucket int, ticker string, cutoff int, score double, relative double")
    drawn = stats.draws(spark, rows.select("bucket"), 20, 2)
    assert stats.bootstrap(rows, drawn).first().mid is None
    assert stats.bootstrap(rows, drawn, least_keys=2, least_blocks=1).first().mid is not None


def test_overlap_groups_against_python(spark):
    import random

    r = random.Random(2)
    held = {f"F{k:02d}": set(r.sample(range(14), r.randint(3, 9))) for k in range(30)}
    rows = spark.createDataFrame([(1, f, f"S{x}") for f, xs in held.items() for x in xs], "report long, fund string, symbol string")
    groups = []
    for f in sorted(f for f, x in held.items() if len(x) >= 5):
        home = next((g for g in groups if all(len(held[f] & held[m]) >= 5 for m in g)), None)
        if home is None:
            groups.append([f])
        else:
            home.append(f)
    want = sorted((" ".join(g), len(set.intersection(*[held[m] for m in g]))) for g in groups if len(g) > 1)
    assert sorted((x.members, x.common) for x in universe.overlap_groups(rows).collect()) == want and want
    pairs = {(a, b, len(held[a] & held[b])) for a in held for b in held if a < b and len(held[a] & held[b]) >= 5}
    assert {tuple(x) for x in universe.overlaps(rows).collect()} == pairs


def test_same_day_runs_keep_the_first_snapshot(spark):
    one = spark.createDataFrame([("2024-01-01", 1, "A", 1.0)], "day string, rank int, ticker string, px double")
    two = spark.createDataFrame([("2024-01-01", 1, "B", 2.0), ("2024-01-02", 1, "B", 2.0)], "day string, rank int, ticker string, px double")
    assert sorted((r.day, r.ticker) for r in journal.append_once(one, two).collect()) == [("2024-01-01", "A"), ("2024-01-02", "B")]


def test_gap_band_leaves_its_edges_out(spark):
    make = lambda x: spark.createDataFrame([("A", x)], "ticker string, weight double")
    assert [universe.allocation_gaps(make(a), make(10.0)).first().advice for a in (14.9, 15.0, 5.1, 5.0)] == ["hold", "trim", "hold", "add"]


def test_overlaps_of_very_common_holdings(spark, monkeypatch):
    import random

    monkeypatch.setattr(universe, "COMMON", 6)
    monkeypatch.setattr(universe, "CHUNK", 8)
    r = random.Random(5)
    held = {f"F{k}": {*r.sample([f"C{n}" for n in range(8)], r.randint(0, 6)), *r.sample([f"R{n}" for n in range(40)], r.randint(0, 12))} for k in range(60)}
    rows = spark.createDataFrame([(f, s) for f, x in held.items() for s in [*x, None]], "fund string, symbol string")
    want = {(a, b, len(held[a] & held[b])) for a in held for b in held if a < b and len(held[a] & held[b]) >= 5}
    assert {tuple(x) for x in universe.overlaps(rows).collect()} == want and len(want) > 20
    plan = universe.overlaps(rows)._jdf.queryExecution().executedPlan().toString()
    assert "held" not in plan and "collect_set" not in plan  # pairs don't carry what either holds


def test_overlap_groups_fold_linked_funds_alone(spark):
    held = {f"F{k:04d}": {f"S{k}-{n}" for n in range(5)} for k in range(400)} | {f"G{k}": {f"T{n}" for n in range(k, k + 6)} for k in range(4)}
    rows = spark.createDataFrame([(1, f, s) for f, x in held.items() for s in x], "report long, fund string, symbol string")
    told = universe.overlap_groups(rows)
    assert [tuple(x) for x in told.orderBy("members").collect()] == [(1, "G0 G1", 5), (1, "G2 G3", 5)]
    assert "fold(report#" in (plan := told._jdf.queryExecution().optimizedPlan().toString()) and "symbol" not in plan.split("fold(report#")[1].split(")")[0]


def test_lanes_in_ranges_and_rounds(spark, monkeypatch):
    import random

    import numpy as np

    from tallyforge.operators import ranks

    monkeypatch.setattr(ranks, "RANGE", 20)
    monkeypatch.setattr(ranks, "ROUND", 150)
    r = random.Random(4)
    sizes = {"a": 200, "b": 90, "c": 20, "d": 3, "e": 61}
    rows = [(g, f"T{n:03d}", n % 7, 5.0 if g == "b" and n < 60 else float(r.randint(0, 40)), float(r.randint(-20, 20))) for g, m in sizes.items() for n in range(m)]
    mean_rank = lambda x: (x[:, None] > x).sum(axis=1) + ((x[:, None] == x).sum(axis=1) + 1) / 2
    want = {}
    for g, m in sizes.items():
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[3], x[1], x[2]))
        rho = np.corrcoef(mean_rank(np.array([x[3] for x in own])), mean_rank(np.array([x[4] for x in own])))[0, 1]
        want[g] = (m, rho, np.mean([x[4] for x in own[: m // 2]]) - np.mean([x[4] for x in own[m - m // 2 :]])) if m >= 4 else (m, None, 0.0)
    df = spark.createDataFrame(rows, "g string, ticker string, cutoff int, score double, relative double").repartition(5)
    told = ranks.lanes(df, ["g"])
    assert {x.g: (x.n, x.rho, x.edge) for x in told.collect()} == {g: (n, None if rho is None else pytest.approx(rho, abs=2e-6), pytest.approx(edge, abs=2e-6)) for g, (n, rho, edge) in want.items()}
    assert told._jdf.queryExecution().optimizedPlan().toString().count("parquet") > 1  # several rounds


def test_hold_sweep_keeps_what_each_hold_gives(spark, sf_dir):
    from tallyforge.operators import books

    told = books.hold_sweep(T.bars(spark, sf_dir), T.spans(spark, sf_dir), T.sectors(spark, sf_dir), holds=(1, 2))
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "parquet" in plan  # bars aren't read and shuffled for all holds at once
    assert {r.years for r in told.collect()} <= {1, 2}


def test_trails_that_no_sample_asks_for_are_not_shuffled(spark):
    from tallyforge.operators import books

    rows = spark.createDataFrame([("A", date(2010, 2, 1), 7, 1.0)], "ticker string, cutoff date, bucket int, score double")
    trail = books.trails(bars(spark, [5, 6, 5, 7, 6] * 10))
    for cap in (2.0, 0.8):
        assert [tuple(r) for r in books.decorrelated(rows, trail, [cap]).collect()] == [(7, cap, 1, "A:2010-02-01")]
    asked = books.asked_trails(rows, trail)
    assert [(r.ticker, r.cutoff, len(r.trail)) for r in asked.collect()] == [("A", date(2010, 2, 1), 28)]
