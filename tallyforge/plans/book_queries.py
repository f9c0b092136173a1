"""Queries of the book reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import books as B
from tallyforge.plans.walk_queries import _EDGES, _SAMPLES
from tallyforge.plans.walk_queries import QUERIES as WALK
from tallyforge.sources import sinks
from tallyforge.sources import tables as T

_rows = WALK["walk_samples"]


def _verdicts(s, d):
    old = s.createDataFrame([(1, "old"), (2, "old"), (5, "old")], "years int, verdict string")
    new = B.deciles(_rows(s, d)).select(F.lit(2).alias("years"), F.when(F.col("d50") > 1, "gain").otherwise("loss").alias("verdict"))
    return sinks.upsert(old, new, "years")


QUERIES = {
    "book_hold_sweep": lambda s, d: B.hold_sweep(T.bars(s, d), T.spans(s, d), T.sectors(s, d)),
    "book_deciles": lambda s, d: B.deciles(_rows(s, d)),
    "book_rank_slices": lambda s, d: B.rank_slices(_rows(s, d)),
    "book_entry_states": lambda s, d: B.entry_states(_rows(s, d), T.benchmark_bars(s, d)),
    "book_trims": lambda s, d: B.trimmed_books(_rows(s, d), "range_pct", (0.0, 20.0, 50.0)),
    "book_union": lambda s, d: B.union_books(_rows(s, d), F.col("vol")),
    "book_base_rate": lambda s, d: B.base_rate(_rows(s, d)),
    "book_benchmark": lambda s, d: B.benchmark_at(_rows(s, d).select("cutoff"), T.benchmark_bars(s, d)),
    "book_against_index": lambda s, d: B.against_index(_rows(s, d), T.benchmark_bars(s, d)),
    "verdict_upsert": _verdicts,
}

_RANKED = _SAMPLES + ", k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, ticker, cutoff) AS rn FROM samples), bm AS (SELECT bucket, avg(1 + realized / 100) AS multiple, min(cutoff) AS start FROM k WHERE rn <= 10 GROUP BY bucket)"
_DECILES = _RANKED + ", o AS (SELECT *, row_number() OVER (ORDER BY multiple, bucket) AS p, count(*) OVER () AS n FROM bm)"


def _at(p: float) -> str:
    return f"round(max(multiple) FILTER (WHERE p - 1 = floor({p / 100}::DOUBLE * (n - 1) + 0.5)), 6)"


def _hold(years: int) -> str:
    rows = _SAMPLES.replace("+ 730", f"+ {365 * years}") + f", z AS (SELECT *, ticker || ':' || cutoff AS id, {years} AS yrs FROM samples)" + _EDGES.format(by="yrs", key="id", src="z")
    return f"SELECT {years}::INT AS years, n, edge FROM ({rows} SELECT n, round(top - bottom, 6) AS edge FROM e)"


_BENCH = """, bb AS (SELECT cutoff, (SELECT arg_min(close, bar_date) FROM bench WHERE bar_date >= cutoff AND close > 0) AS a, (SELECT arg_min(close, bar_date) FROM bench WHERE bar_date >= cutoff + 730 AND close > 0) AS b, (SELECT arg_max(close, bar_date) FROM bench WHERE bar_date <= cutoff - 730 AND close > 0) AS p,
  (SELECT arg_max(close, bar_date) FROM bench WHERE bar_date <= cutoff AND close > 0) AS q, (SELECT max(close) FROM bench WHERE bar_date <= cutoff) AS hi FROM (SELECT DISTINCT cutoff FROM samples))"""


def _trim(p: float) -> str:
    return f"""SELECT {p}::DOUBLE AS percent, count(*) AS buckets, round(avg(m), 6) AS mean FROM (SELECT bucket, avg(1 + realized / 100) AS m FROM (SELECT s.*, row_number() OVER (PARTITION BY s.bucket ORDER BY score DESC, ticker, cutoff) AS rn FROM samples s LEFT JOIN
(SELECT bucket, max(CASE WHEN v - 1 = least(floor({p / 100}::DOUBLE * n), n - 1) THEN range_pct END) AS fl FROM (SELECT bucket, range_pct, row_number() OVER (PARTITION BY bucket ORDER BY range_pct) AS v, count(*) OVER (PARTITION BY bucket) AS n FROM samples WHERE range_pct IS NOT NULL) GROUP BY 1) f USING (bucket)
WHERE range_pct IS NULL OR fl IS NULL OR range_pct >= fl) WHERE rn <= 10 GROUP BY bucket)"""


SQL = {
    "book_hold_sweep": " UNION ALL ".join(map(_hold, (1, 2, 3, 5, 8, 10))),
    "book_benchmark": _SAMPLES + _BENCH + " SELECT cutoff, round(100 * (b / a - 1), 6) AS forward, round(100 * (q / p - 1), 6) AS trailing, round(100 * (q / hi - 1), 6) AS drawdown FROM bb",
    "book_against_index": _RANKED + _BENCH + ", f AS (SELECT bucket, max(realized) FILTER (WHERE rn = 1) AS one, avg(realized) FILTER (WHERE rn BETWEEN 2 AND 10) AS rest FROM k GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN multiple < 1 + round(100 * (b / a - 1), 6) / 100 THEN 1.0::DOUBLE WHEN b / a IS NOT NULL THEN 0 END), 6) AS p_below_index, round(avg(CASE WHEN multiple < 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_loss, count(*) FILTER (WHERE one > rest) AS best_in_top FROM bm JOIN bb ON start = cutoff JOIN f USING (bucket)",
    "book_deciles": _DECILES + f" SELECT count(*) AS n, {_at(10)} AS d10, {_at(50)} AS d50, {_at(90)} AS d90, round(avg(CASE WHEN multiple < 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_loss FROM o",
    "book_rank_slices": _RANKED + " SELECT CASE WHEN rn = 1 THEN '01' WHEN rn <= 5 THEN '02-05' WHEN rn <= 10 THEN '06-10' WHEN rn <= 20 THEN '11-20' ELSE '21-50' END AS slice, count(*) AS n, round(avg(realized), 6) AS mean FROM k WHERE rn <= 50 GROUP BY 1",
    "book_entry_states": _RANKED + ", f AS (SELECT bar_date, 100 * (close / max(close) OVER (ORDER BY bar_date) - 1) AS dd FROM bench) SELECT CASE WHEN dd > -5 THEN 'high' WHEN dd > -15 THEN 'dip' ELSE 'bear' END AS state, count(*) AS n, round(avg(multiple), 6) AS mean FROM bm JOIN f ON start = bar_date GROUP BY 1",
    "book_trims": _SAMPLES + " " + " UNION ALL ".join(_trim(p) for p in (0.0, 20.0, 50.0)),
    "book_union": _SAMPLES + """, a AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, ticker, cutoff) AS x, row_number() OVER (PARTITION BY bucket ORDER BY vol DESC NULLS LAST, ticker, cutoff) AS y FROM samples),
u AS (SELECT *, row_number() OVER (PARTITION BY bucket, ticker ORDER BY cutoff) AS q FROM a WHERE x <= 5 OR y <= 5) SELECT bucket, count(*) AS names, round(avg(realized), 6) AS mean FROM u WHERE q = 1 GROUP BY bucket""",
    "book_base_rate": _SAMPLES + " SELECT count(*) FILTER (WHERE cagr_life >= 20) AS qualifying, round(100 * avg(CASE WHEN realized >= 44 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE cagr_life >= 20), 6) AS sustained, round(100 * avg(CASE WHEN realized >= 44 THEN 1.0::DOUBLE ELSE 0 END), 6) AS everyone FROM samples",
    "verdict_upsert": _DECILES + f" SELECT 1 AS years, 'old' AS verdict UNION ALL SELECT 5, 'old' UNION ALL SELECT 2, CASE WHEN {_at(50)} > 1 THEN 'gain' ELSE 'loss' END FROM o",
}
