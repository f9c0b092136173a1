"""Queries of the walk-forward and of cross-sectional statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import stats as X
from tallyforge.operators import walk as K
from tallyforge.sources import tables as T
from tallyforge.sources.tables import SQL as VIEWS

ARMS = [(f"r{r}-d{d}", r, d) for r in (0.0, 0.1, 0.5) for d in (0.0, 0.05, 0.2)]
DRAWS, BLOCK = 1000, 2


def _samples(s, d):
    return K.samples(T.bars(s, d), T.spans(s, d), T.sectors(s, d))


def _gate():
    return (F.col("max_dd") <= 98) & (F.col("range_pct") >= 40)


def _bootstrap(s, d):
    rows = _samples(s, d)
    return X.bootstrap(rows, X.draws(s, rows.select("bucket"), DRAWS, BLOCK), BLOCK, least_blocks=2).select(*[F.round(c, 4).alias(c) for c in ("lo", "mid", "hi")])


QUERIES = {
    "walk_samples": _samples,
    "walk_books": lambda s, d: K.books(_samples(s, d), T.benchmark_bars(s, d)),
    "walk_purged_cut": lambda s, d: K.purged_cut(_samples(s, d)),
    "walk_gate_audit": lambda s, d: K.gate_audit(_samples(s, d), _gate()),
    "walk_newly_admitted": lambda s, d: K.newly_admitted(_samples(s, d), _gate(), F.col("range_pct") >= 20),
    "walk_exits": lambda s, d: K.exits(_samples(s, d), _gate()),
    "walk_factor_probe": lambda s, d: K.factor_probe(_samples(s, d), ["cagr_life", "max_dd", "vol", "range_pct", "r2"]),
    "walk_knob_sweep": lambda s, d: K.knob_sweep(_samples(s, d), s.createDataFrame(ARMS, "arm string, w_range double, w_dd double")),
    "stat_correlations": lambda s, d: X.correlations(T.bars(s, d), "ticker", "close", "volume"),
    "stat_percentiles": lambda s, d: X.percentiles(T.bars(s, d), "ticker", "close"),
    "stat_edges": lambda s, d: X.edges(_samples(s, d).withColumn("id", F.concat_ws(":", "ticker", F.col("cutoff").cast("string"))), "bucket", key="id"),
    "stat_bootstrap": _bootstrap,
    "stat_turnover": lambda s, d: X.turnover(_samples(s, d)),
    "stat_recall": lambda s, d: X.recall(_samples(s, d).withColumn("score", F.when(_gate(), F.col("score"))), least=0.5),
    "stat_lane_metrics": lambda s, d: X.lane_metrics(_samples(s, d), "bucket"),
}

_SAMPLES = (
    "WITH "
    + ", ".join(VIEWS[n] for n in ("bars", "spans", "sectors", "bench"))
    + """, r1 AS (SELECT *, row_number() OVER w - 1 AS i, (close - lag(close) OVER w) / lag(close) OVER w * 100 AS ret, max(close) OVER p AS peak, avg(close) OVER (PARTITION BY ticker ORDER BY bar_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS endpoint, first_value(close) OVER p AS c0, min(bar_date) OVER p AS d0
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY bar_date), p AS (PARTITION BY ticker ORDER BY bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r2 AS (SELECT *, (peak - close) / peak * 100 AS dd FROM r1),
r3 AS (SELECT *, max(dd) OVER p AS mdd, stddev_pop(ret) OVER (PARTITION BY ticker ORDER BY bar_date ROWS BETWEEN 77 PRECEDING AND CURRENT ROW) AS v, regr_r2(ln(close), i) OVER p AS rr
  FROM r2 WINDOW p AS (PARTITION BY ticker ORDER BY bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r4 AS (SELECT a.*, (SELECT arg_min(b.close, b.bar_date) FROM bars b WHERE b.ticker = a.ticker AND b.bar_date >= a.bar_date + 730) AS fwd, (SELECT count(*) FROM bars b WHERE b.ticker = a.ticker AND b.bar_date <= a.bar_date AND b.close < a.endpoint) AS below FROM r3 a WHERE i >= 156 AND (i - 156) % 20 = 0),
r5 AS (SELECT r4.*, market, class FROM r4 LEFT JOIN sectors USING (ticker) WHERE fwd IS NOT NULL AND (NOT EXISTS (SELECT 1 FROM spans s WHERE s.ticker = r4.ticker) OR EXISTS (SELECT 1 FROM spans s WHERE s.ticker = r4.ticker AND s.start_date <= bar_date AND (s.end_date IS NULL OR bar_date < s.end_date)))),
r6 AS (SELECT ticker, bar_date AS cutoff, CAST(year(bar_date) * 2 + (month(bar_date) - 1) // 6 AS INT) AS bucket, market, class, round((fwd / close - 1) * 100, 6) AS realized,
  round(CASE WHEN bar_date = d0 THEN (close / c0 - 1) * 100 ELSE (power(greatest(close / c0, 1e-9), 1 / ((bar_date - d0) / 365.25)) - 1) * 100 END, 6) AS cagr_life, round(mdd, 6) AS max_dd, round(v, 6) AS vol,
  round(below / i * 100, 6) AS range_pct, round(rr, 6) AS r2 FROM r5),
samples AS (SELECT *, round(realized - CASE WHEN count(*) OVER (PARTITION BY bucket, class, market) >= 8 THEN avg(realized) OVER (PARTITION BY bucket, class, market) ELSE avg(realized) OVER (PARTITION BY bucket, class) END, 6) AS relative,
  round(least(cagr_life, 30.0) + range_pct / 10 - max_dd / 20, 4) AS score FROM r6)"""
)
_GATE = "coalesce(max_dd <= 98 AND range_pct >= 40, max_dd <= 98, range_pct >= 40, true)"
_EDGES = """, b AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY relative, {key}) AS vn, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {key}) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {src}),
lim AS (SELECT {by}, max(CASE WHEN vn - 1 = floor(0.01 * (n - 1) + 0.5) THEN relative END) AS lo, max(CASE WHEN vn - 1 = floor(0.99 * (n - 1) + 0.5) THEN relative END) AS hi FROM b GROUP BY {by}),
c AS (SELECT *, greatest(least(relative, hi), lo) AS clamped FROM b JOIN lim USING ({by})),
e AS (SELECT {by}, n, avg(relative) FILTER (WHERE rn <= n // 2) AS top, avg(relative) FILTER (WHERE rn > n - n // 2) AS bottom, avg(relative) FILTER (WHERE rn <= n // 3) AS t1, avg(relative) FILTER (WHERE rn > n // 3 AND rn <= n - n // 3) AS t2,
  avg(relative) FILTER (WHERE rn > n - n // 3) AS t3, avg(clamped) FILTER (WHERE rn <= n // 2) - avg(clamped) FILTER (WHERE rn > n - n // 2) AS w FROM c GROUP BY {by}, n)"""
_ARMS = ", ".join(f"('{a}', {r}::DOUBLE, {d}::DOUBLE)" for a, r, d in ARMS)
_RHO = "round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6)"

SQL = {
    "walk_samples": _SAMPLES + " SELECT * FROM samples",
    "walk_books": _SAMPLES + """, k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, ticker, cutoff) AS rn FROM samples), l(top) AS (VALUES (1), (3), (5), (10), (20)),
bk AS (SELECT CAST(top AS INT) AS top, bucket, avg(1 + realized / 100) AS multiple, min(cutoff) AS start FROM k JOIN l ON rn <= top GROUP BY 1, 2),
x AS (SELECT top, bucket, (sqrt(greatest(multiple, 0)) - 1) * 100 AS book, (sqrt(greatest((SELECT arg_min(close, bar_date) FROM bench WHERE bar_date >= start + 730) / (SELECT arg_min(close, bar_date) FROM bench WHERE bar_date >= start), 0)) - 1) * 100 AS "index" FROM bk),
y AS (SELECT *, book - "index" AS excess, row_number() OVER (PARTITION BY top ORDER BY bucket) AS rn, count(*) OVER (PARTITION BY top) AS m FROM x)
SELECT top, count(*) AS buckets, round(avg(book), 4) AS book, round(avg("index"), 4) AS "index", round(avg(excess), 4) AS excess, round(100 * avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0 END), 4) AS win_pct, round(min(book), 4) AS worst,
  round(avg(excess) FILTER (WHERE rn <= m // 2), 4) AS early, round(avg(excess) FILTER (WHERE rn > m // 2), 4) AS late FROM y GROUP BY top""",
    "walk_purged_cut": _SAMPLES + """, k AS (SELECT *, row_number() OVER (ORDER BY cutoff, ticker) AS rn, count(*) OVER () AS n FROM samples), e AS (SELECT cutoff AS edge FROM k WHERE rn = floor(0.7 * n) + 1)
SELECT part, count(*) AS n, min(cutoff) AS first, max(cutoff) AS last FROM (SELECT cutoff, CASE WHEN cutoff >= edge THEN 'test' WHEN cutoff < edge - 720 THEN 'train' END AS part FROM samples, e) WHERE part IS NOT NULL GROUP BY part""",
    "walk_gate_audit": _SAMPLES + f" SELECT {_GATE} AS passed, count(*) AS n, round(avg(relative), 6) AS mean, round(median(relative), 6) AS median FROM samples GROUP BY 1",
    "walk_newly_admitted": _SAMPLES + f" SELECT count(*) AS n, round(avg(relative), 6) AS mean FROM samples WHERE NOT ({_GATE}) AND coalesce(range_pct >= 20, true)",
    "walk_exits": _SAMPLES + f", k AS (SELECT *, {_GATE} AS ok FROM samples), l AS (SELECT *, lead(ok) OVER (PARTITION BY ticker ORDER BY cutoff) AS nxt FROM k) SELECT nxt AS stayed, count(*) AS n, round(avg(relative), 6) AS mean FROM l WHERE ok AND nxt IS NOT NULL GROUP BY 1",
    "walk_factor_probe": _SAMPLES + f""", u AS (UNPIVOT (SELECT relative, ticker, cutoff, cagr_life, max_dd, vol, range_pct, r2 FROM samples) ON cagr_life, max_dd, vol, range_pct, r2 INTO NAME factor VALUE value),
k AS (SELECT *, rank() OVER (PARTITION BY factor ORDER BY value) + (count(*) OVER (PARTITION BY factor, value) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY factor ORDER BY relative) + (count(*) OVER (PARTITION BY factor, relative) - 1) / 2.0::DOUBLE AS ry FROM u WHERE value IS NOT NULL)
SELECT factor, count(*) AS n, {_RHO} AS rho FROM k GROUP BY factor""",
    "walk_knob_sweep": _SAMPLES + f", arms(arm, w_range, w_dd) AS (VALUES {_ARMS}), z AS (SELECT arm, relative, round(least(cagr_life, 30.0) + w_range * range_pct - w_dd * max_dd, 4) AS score, ticker || ':' || cutoff AS id FROM samples, arms)" + _EDGES.format(by="arm", key="id", src="z") + " SELECT arm, n, round(top - bottom, 6) AS edge FROM e",
    "stat_correlations": "WITH " + VIEWS["bars"] + f""", k AS (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY close) + (count(*) OVER (PARTITION BY ticker, close) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY ticker ORDER BY volume) + (count(*) OVER (PARTITION BY ticker, volume) - 1) / 2.0::DOUBLE AS ry FROM bars)
SELECT ticker, round(covar_pop(close, volume) / nullif(stddev_pop(close) * stddev_pop(volume), 0), 6) AS pearson, {_RHO} AS spearman FROM k GROUP BY ticker""",
    "stat_percentiles": "WITH " + VIEWS["bars"] + """, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY close) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM bars)
SELECT ticker, round(max(close) FILTER (WHERE rn - 1 = least(floor(0.3::DOUBLE * n), n - 1)), 6) AS floor, round(max(close) FILTER (WHERE rn - 1 = floor(0.95::DOUBLE * (n - 1) + 0.5)), 6) AS nearest, round(median(close), 6) AS median, round(avg(close), 6) AS mean FROM k GROUP BY ticker""",
    "stat_edges": _SAMPLES + ", z AS (SELECT *, ticker || ':' || cutoff AS id FROM samples)" + _EDGES.format(by="bucket", key="id", src="z") + """ SELECT bucket, n, round(top, 6) AS top, round(bottom, 6) AS bottom, round(top - bottom, 6) AS edge, round(CASE WHEN n >= 3 THEN t1 END, 6) AS t1, round(CASE WHEN n >= 3 THEN t2 END, 6) AS t2, round(CASE WHEN n >= 3 THEN t3 END, 6) AS t3,
  coalesce(n >= 3 AND t1 > t2 AND t2 > t3, false) AS monotone, round(CASE WHEN n >= 4 THEN w END, 6) AS winsor_edge FROM e""",
    "stat_turnover": _SAMPLES + """, k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, ticker, cutoff) AS rn, count(*) OVER (PARTITION BY bucket) AS n FROM samples), h AS (SELECT bucket, array_agg(DISTINCT ticker) AS held FROM k WHERE rn <= n // 2 GROUP BY 1),
l AS (SELECT *, lag(held) OVER (ORDER BY bucket) AS was FROM h) SELECT coalesce(round(avg(1 - len(list_intersect(held, was)) / nullif(len(list_distinct(list_concat(held, was))), 0)), 6), 0) AS turnover FROM l WHERE was IS NOT NULL""",
    "stat_recall": _SAMPLES + f""", k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY realized DESC, ticker, cutoff) AS rn, count(*) OVER (PARTITION BY bucket) AS n FROM samples),
p AS (SELECT bucket, ticker, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, ticker, cutoff) AS sn FROM samples WHERE {_GATE}), h AS (SELECT DISTINCT bucket, ticker FROM p WHERE sn <= 10),
w AS (SELECT greatest(1 + realized / 100, 0) AS m, EXISTS (SELECT 1 FROM h WHERE h.bucket = k.bucket AND h.ticker = k.ticker) AS held FROM k WHERE n >= 2 AND rn <= least(greatest(floor(0.1::DOUBLE * n + 0.5), 1), n))
SELECT round(avg(CASE WHEN held THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall, round(sum(CASE WHEN held THEN m ELSE 0 END) / sum(m), 6) AS captured, count(*) AS winners FROM w WHERE m >= 0.5""",
    "stat_lane_metrics": _SAMPLES + ", z AS (SELECT *, ticker || ':' || cutoff AS id FROM samples)" + _EDGES.format(by="bucket", key="id", src="z") + f""", k2 AS (SELECT bucket, rank() OVER (PARTITION BY bucket ORDER BY score) + (count(*) OVER (PARTITION BY bucket, score) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY bucket ORDER BY relative) + (count(*) OVER (PARTITION BY bucket, relative) - 1) / 2.0::DOUBLE AS ry FROM samples),
r AS (SELECT bucket, CASE WHEN count(*) >= 4 THEN {_RHO} END AS rho FROM k2 GROUP BY 1) SELECT bucket, n, rho, CASE WHEN n >= 4 THEN round(top - bottom, 6) ELSE 0 END AS edge FROM e JOIN r USING (bucket)""",
    "stat_bootstrap": _SAMPLES + f""", b AS (SELECT bucket, row_number() OVER (ORDER BY bucket) - 1 AS place, count(*) OVER () AS m FROM (SELECT DISTINCT bucket FROM samples)), x AS (SELECT d.range AS draw, n.range AS nth, (SELECT max(m) FROM b) AS m FROM range({DRAWS}) d, range(0, 10000) n WHERE n.range <= ((SELECT max(m) FROM b) - 1) // {BLOCK}),
y AS (SELECT draw, (((draw * 7919 + nth * 104729) * 48271 % 2147483647) % m + k.range) % m AS place FROM x, range({BLOCK}) k WHERE nth * {BLOCK} + k.range < m), c AS (SELECT draw, bucket, count(*) AS times FROM y JOIN b USING (place) GROUP BY 1, 2),
u AS (SELECT draw, relative, row_number() OVER (PARTITION BY draw ORDER BY score DESC, ticker, cutoff) AS rn, count(*) OVER (PARTITION BY draw) AS n FROM samples JOIN (SELECT draw, bucket, unnest(range(times)) FROM c) USING (bucket)),
e AS (SELECT draw, avg(relative) FILTER (WHERE rn <= n // 2) - avg(relative) FILTER (WHERE rn > n - n // 2) AS edge FROM u GROUP BY 1), r AS (SELECT edge, row_number() OVER (ORDER BY edge) - 1 AS i, count(*) OVER () AS n FROM e), g AS (SELECT count(*) >= 4 AND count(*) // {BLOCK} >= 2 AS ok FROM b)
SELECT round(CASE WHEN any_value(ok) THEN max(edge) FILTER (WHERE i = floor(0.05::DOUBLE * (n - 1) + 0.5)) END, 4) AS lo, round(CASE WHEN any_value(ok) THEN max(edge) FILTER (WHERE i = floor(0.5::DOUBLE * (n - 1) + 0.5)) END, 4) AS mid, round(CASE WHEN any_value(ok) THEN max(edge) FILTER (WHERE i = floor(0.95::DOUBLE * (n - 1) + 0.5)) END, 4) AS hi FROM r, g""",
}
