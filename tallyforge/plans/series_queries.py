"""Queries of the series measures, and their SQL."""

from __future__ import annotations

from tallyforge.operators import series as S
from tallyforge.sources import tables as T
from tallyforge.sources.tables import with_views

QUERIES = {
    "series_growth": lambda s, d: S.growth(T.bars(s, d), T.dividends(s, d)),
    "series_trend": lambda s, d: S.trend(T.bars(s, d)),
    "series_drawdown": lambda s, d: S.drawdown(T.bars(s, d)),
    "series_risk": lambda s, d: S.risk(T.bars(s, d)),
    "calendar_returns": lambda s, d: S.calendar_returns(T.bars(s, d)),
    "monthly_tail": lambda s, d: S.monthly_tail(T.bars(s, d)),
    "horizon_changes": lambda s, d: S.horizon_changes(T.bars(s, d)),
    "series_income": lambda s, d: S.income(T.bars(s, d), T.dividends(s, d), T.splits(s, d)),
    "trend_streak": lambda s, d: S.streak(T.bars(s, d)),
    "splice_start": lambda s, d: S.splice_start(T.bars(s, d)),
    "splice_proxy": lambda s, d: S.splice_proxy(T.bars(s, d).filter("bar_date >= '1996-01-01'"), T.benchmark_bars(s, d)).selectExpr("ticker", "bar_date", "round(close, 6) AS close"),
    "trailing_returns": lambda s, d: S.trailing(T.bars(s, d)),
    "intraday_changes": lambda s, d: S.intraday(T.bars(s, d)),
}

_POS = """, pos AS (SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS prev, lag(bar_date) OVER w AS prev_date, max(close) OVER w AS peak, count(*) OVER (PARTITION BY ticker) AS n,
  min(bar_date) OVER (PARTITION BY ticker) AS first_date, max(bar_date) OVER (PARTITION BY ticker) AS last_date, last_value(close) OVER (PARTITION BY ticker ORDER BY bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_close,
  (close - lag(close) OVER w) / lag(close) OVER w * 100 AS ret FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY bar_date))"""
_LIFE = "CASE WHEN {first} > 0 AND {days} / 365.25 >= 0.5 THEN (power(greatest({last} / {first}, 1e-9), 1 / ({days} / 365.25)) - 1) * 100 END"
_H = ", ".join(f"('{k}', {v}, {S.anchor_half(v)})" for k, v in S.HORIZONS.items())
_DIV = "".join(
    f", round(CASE WHEN d0 <= d1 - {d} THEN coalesce(s{h}::DOUBLE, 0) END, 4) AS div_{h.lower()}, round(CASE WHEN d0 <= d1 - {d} AND px > 0 THEN coalesce(s{h}::DOUBLE, 0) / ({d} / 365.0::DOUBLE) / px * 100 END, 8) AS yield_{h.lower()}"
    for h, d in S.DIVIDEND_HORIZONS.items()
)
_DIVSUM = "".join(f", sum(amount) FILTER (WHERE ex_date > d1 - {d} AND ex_date <= d1) AS s{h}" for h, d in S.DIVIDEND_HORIZONS.items())

SQL = {
    "series_growth": with_views("bars divs", _POS + f""", one AS (SELECT ticker, arg_min(close, bar_date) AS first, arg_max(close, bar_date) AS last, min(bar_date) AS d0, max(bar_date) AS d1,
  arg_min(close, bar_date) FILTER (WHERE bar_date >= last_date - 1826) AS cf, min(bar_date) FILTER (WHERE bar_date >= last_date - 1826) AS cd, avg(close) FILTER (WHERE i >= n - 5) AS endpoint FROM pos GROUP BY ticker),
paid AS (SELECT ticker, sum(amount)::DOUBLE AS paid FROM divs GROUP BY ticker)
SELECT ticker, round((d1 - d0) / 365.25, 6) AS age_years, round({_LIFE.format(first="first", last="last", days="(d1 - d0)")}, 6) AS life_cagr,
  round({_LIFE.format(first="first", last="(last + coalesce(paid, 0))", days="(d1 - d0)")}, 6) AS tr_life_cagr,
  round(CASE WHEN (d1 - d0) / 365.25 >= 5 THEN {_LIFE.format(first="cf", last="last", days="(d1 - cd)")} END, 6) AS capped_cagr,
  round(CASE WHEN first > 0 AND (d1 - d0) / 365.25 >= 0.5 THEN (endpoint - first) / first * 100 END, 6) AS life_return FROM one LEFT JOIN paid USING (ticker)"""),
    "series_trend": with_views("bars", _POS + """, up AS (SELECT ticker, ln(close) AS y, row_number() OVER (PARTITION BY ticker ORDER BY bar_date) - 1 AS x FROM bars WHERE close > 0),
fit AS (SELECT ticker, count(*) AS m, regr_r2(y, x) AS r2, regr_slope(y, x) AS slope FROM up GROUP BY ticker),
one AS (SELECT ticker, count(*) AS n, avg(close) FILTER (WHERE i >= n - 60) AS ma, arg_max(close, bar_date) AS last, max(close) AS hi, min(close) AS lo, any_value(ep) AS ep, count(*) FILTER (WHERE close < ep) AS below FROM (SELECT *, avg(close) FILTER (WHERE i >= n - 5) OVER (PARTITION BY ticker) AS ep FROM pos) GROUP BY ticker)
SELECT ticker, round(CASE WHEN m >= 2 THEN coalesce(r2, 1.0) ELSE 0 END, 6) AS trend_r2, round(CASE WHEN m >= 2 THEN (exp(slope * 78) - 1) * 100 END, 4) AS trend_cagr,
  round(CASE WHEN n >= 60 AND ma > 0 THEN greatest(0, (ma - last) / ma * 100) ELSE 0 END, 6) AS below_ma, round(CASE WHEN n >= 60 AND ma > 0 THEN greatest(0, (last - ma) / ma * 100) ELSE 0 END, 6) AS above_ma,
  round(CASE WHEN n >= 2 THEN below / (n - 1) * 100 ELSE 0 END, 6) AS pct_rank, round(greatest(0, (hi - ep) / hi * 100), 6) AS from_high, last >= hi * 0.98 AS at_high, last <= lo * 1.02 AS at_low FROM one LEFT JOIN fit USING (ticker)"""),
    "series_drawdown": with_views("bars", _POS + """, p2 AS (SELECT *, lead(close, 78) OVER w AS ahead, max(CASE WHEN close > 0 AND close >= peak THEN i END) OVER w AS top_i FROM pos WINDOW w AS (PARTITION BY ticker ORDER BY bar_date)),
p3 AS (SELECT *, i % 5 = 0 AND close > 0 AND coalesce(ahead, 0) > 0 AS pair FROM p2)
SELECT ticker, round(greatest(0, max((peak - close) / peak * 100)), 6) AS max_drawdown, round(CASE WHEN count(*) >= 2 THEN max(i - top_i) / 252.0::DOUBLE END, 6) AS underwater_years,
  round(100.0::DOUBLE * count(*) FILTER (WHERE pair AND ahead > close) / nullif(count(*) FILTER (WHERE pair), 0), 6) AS rolling_positive, round(min(100 * (ahead / close - 1)) FILTER (WHERE pair), 6) AS worst_rolling FROM p3 GROUP BY ticker"""),
    "series_risk": with_views("bars", _POS + """, t AS (SELECT * FROM pos WHERE i >= n - 250)
SELECT ticker, round(CASE WHEN count(ret) >= 2 THEN stddev_pop(ret) END, 6) AS volatility, round(CASE WHEN count(ret) >= 2 THEN stddev_pop(ret) * sqrt(78 / 252.0::DOUBLE) END, 6) AS daily_volatility, round(max(ret), 6) AS max_daily,
  round(CASE WHEN count(ret) >= 2 THEN sqrt(avg(power(least(ret, 0), 2)) FILTER (WHERE ret IS NOT NULL)) END, 6) AS downside, round(avg(close * volume) FILTER (WHERE close * volume > 0), 4) AS avg_turnover, round(avg(volume) FILTER (WHERE volume > 0), 6) AS avg_volume FROM t GROUP BY ticker"""),
    "calendar_returns": with_views("bars", """, y AS (SELECT ticker, year(bar_date)::INT AS year, arg_max(close, bar_date) AS close FROM bars WHERE close > 0 GROUP BY 1, 2), e AS (SELECT ticker, year(max(bar_date)) AS last FROM bars GROUP BY 1),
l AS (SELECT *, lag(close) OVER w AS was, lag(year) OVER w AS before FROM y WINDOW w AS (PARTITION BY ticker ORDER BY year))
SELECT ticker, year, round(100 * (close / was - 1), 6) AS ret FROM l JOIN e USING (ticker) WHERE year - before = 1 AND year <> last"""),
    "monthly_tail": with_views("bars", """, m AS (SELECT ticker, CAST(date_trunc('month', bar_date) AS DATE) AS month, arg_max(close, bar_date) AS close FROM bars WHERE close > 0 GROUP BY 1, 2),
l AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY month) AS was, row_number() OVER (PARTITION BY ticker ORDER BY month DESC) AS back FROM m)
SELECT ticker, month, round((close / was - 1) * 100, 6) AS ret FROM l WHERE was IS NOT NULL AND back <= 36"""),
    "horizon_changes": with_views("bars", _POS + f""", h(horizon, days, half) AS (VALUES {_H}),
x AS (SELECT *, last_date - days AS target FROM pos, h),
one AS (SELECT ticker, horizon, days, avg(close) FILTER (WHERE half > 0 AND bar_date BETWEEN target - half AND target + half) AS mean, arg_max(close, bar_date) FILTER (WHERE bar_date <= target) AS past,
  arg_max(close, bar_date) AS raw, avg(close) FILTER (WHERE i >= n - 5) AS smooth, min(first_date) AS d0, min(target) AS target FROM x GROUP BY ALL)
SELECT ticker, horizon, round(CASE WHEN d0 <= target + 31 THEN ((CASE WHEN days >= 365 THEN smooth ELSE raw END) - coalesce(mean, past)) / nullif(coalesce(mean, past), 0) * 100 END, 6) AS change FROM one"""),
    "series_income": with_views("bars divs splits", f""", e AS (SELECT ticker, min(bar_date) AS d0, max(bar_date) AS d1, arg_max(close, bar_date) AS px FROM bars GROUP BY 1),
one AS (SELECT ticker, d0, d1, px{_DIVSUM} FROM e LEFT JOIN divs USING (ticker) GROUP BY ticker, d0, d1, px),
f AS (SELECT ticker, product(ratio) AS factor FROM splits WHERE eff_date > DATE '1999-01-01' AND ratio > 0 GROUP BY 1)
SELECT ticker{_DIV}, coalesce(factor, 1.0)::DOUBLE AS split_factor FROM one LEFT JOIN f USING (ticker)"""),
    "trend_streak": with_views("bars", _POS + """, s AS (SELECT *, sign(close - prev) AS sg FROM pos), f AS (SELECT *, last_value(sg) OVER (PARTITION BY ticker ORDER BY bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM s),
one AS (SELECT ticker, coalesce(max(final), 0)::INT AS direction, CASE WHEN coalesce(max(final), 0) = 0 THEN 0 ELSE max(bar_date) - max(CASE WHEN sg IS NULL OR sg <> final THEN bar_date END) END::INT AS days FROM f GROUP BY 1)
SELECT *, CASE WHEN days >= 365 THEN (days // 365) || 'Y' WHEN days >= 30 THEN (days // 30) || 'M' WHEN days >= 7 THEN (days // 7) || 'w' WHEN days >= 1 THEN days || 'd' ELSE '0s' END AS duration FROM one"""),
    "splice_start": with_views("bars", _POS + """, r AS (SELECT *, power(close / prev, 7 / greatest(bar_date - prev_date, 7)::DOUBLE) AS rate FROM pos)
SELECT ticker, coalesce(max(bar_date) FILTER (WHERE prev > 0 AND close > 0 AND (rate > 3 OR rate < 1 / 3.0::DOUBLE)), min(bar_date)) AS start FROM r GROUP BY ticker"""),
    "splice_proxy": with_views("bars bench", """, b AS (SELECT * FROM bars WHERE bar_date >= DATE '1996-01-01'), f AS (SELECT ticker, min(bar_date) AS d0, arg_min(close, bar_date) AS c0 FROM b GROUP BY 1),
a AS (SELECT f.*, (SELECT arg_max(close, bar_date) FROM bench WHERE bar_date <= f.d0) AS p0 FROM f)
SELECT ticker, bench.bar_date, round(close * c0 / p0, 6) AS close FROM a JOIN bench ON bench.bar_date < d0 WHERE c0 > 0 AND p0 > 0 UNION ALL SELECT ticker, bar_date, round(close, 6) FROM b"""),
    "trailing_returns": with_views("bars", _POS + """, g AS (SELECT ticker, bar_date, CASE WHEN prev > 0 AND close > 0 THEN ret END AS good FROM pos)
SELECT ticker, bar_date, count(good) OVER w AS n_trail, round(avg(good) OVER w, 6) AS mean_trail FROM g WINDOW w AS (PARTITION BY ticker ORDER BY bar_date ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)"""),
    "intraday_changes": with_views("bars", _POS + ", one AS (SELECT ticker, max(last_close) AS last" + "".join(f", max(close) FILTER (WHERE i = n - 1 - {k}) AS p{k}" for k in (1, 6, 12)) + " FROM pos GROUP BY 1) SELECT ticker" + "".join(f", round((last - p{k}) / nullif(p{k}, 0) * 100, 6) AS chg_{k}" for k in (1, 6, 12)) + " FROM one"),
}
