"""Queries of the as-of quotes, and their SQL, which compares each cutoff to all bars of its slice."""

from __future__ import annotations

from tallyforge.operators import asof as A
from tallyforge.operators.series import DIVIDEND_HORIZONS, ENDPOINT_DAYS, HORIZONS, anchor_half
from tallyforge.sources import tables as T
from tallyforge.sources.tables import SQL as VIEWS

JUMP = 50.0  #: times a week; invented prices jump more than real ones

QUERIES = {
    "walk_quotes": lambda s, d: A.quotes(T.bars(s, d), T.dividends(s, d), max_weekly=JUMP),
    "walk_cutoffs": lambda s, d: A.walked(T.bars(s, d), JUMP, None, None, None)
    .filter("i >= history AND (i - history) % step = 0")
    .select("ticker", "bar_date", "i", "seg", "j", "cadence", "history", "step"),
}


def _rounded(k: str) -> str:
    return f"CAST(coalesce(greatest(floor((n - 1) * 365.25::DOUBLE / nullif(span, 0) * {k} + 0.5), 1), 1) AS INT)"


_WALK = f"""WITH {VIEWS["bars"]}, {VIEWS["divs"]},
a AS (SELECT ticker, bar_date, close, row_number() OVER w - 1 AS i, count(*) OVER p AS n, lag(close) OVER w AS prev, greatest(bar_date - lag(bar_date) OVER w, 7) AS days,
  max(bar_date) OVER p - min(bar_date) OVER p AS span
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY bar_date), p AS (PARTITION BY ticker)),
b AS (SELECT *, sum(CASE WHEN prev > 0 AND close > 0 AND (power(close / prev, 7.0 / days) > {JUMP} OR power(close / prev, 7.0 / days) < 1 / {JUMP}::DOUBLE) THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY bar_date) AS seg,
  {_rounded("1.0")} AS cadence, {_rounded("3.0")} AS history, {_rounded("0.5")} AS step FROM a),
c AS (SELECT ticker, bar_date, close, i, n, seg, cadence, history, step, row_number() OVER w - 1 AS j, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * 100 AS ret, max(close) OVER w AS peak,
  count(CASE WHEN close > 0 THEN 1 END) OVER w - 1 AS x FROM b WINDOW w AS (PARTITION BY ticker, seg ORDER BY bar_date)),
cut AS (SELECT ticker, seg, i, j, cadence, bar_date AS cutoff, close AS price, greatest(1, {ENDPOINT_DAYS} * cadence // 252) AS late, {A.LONG_MA_DAYS} * cadence // 252 AS ma FROM c WHERE i >= history AND (i - history) % step = 0)"""

_HORIZONS = ",\n  ".join(
    f"arg_max(s.close, bar_date) FILTER (bar_date <= cutoff - {d}) AS at_{h}" + (f", avg(s.close) FILTER (bar_date BETWEEN cutoff - {d + anchor_half(d)} AND cutoff - {d - anchor_half(d)}) AS mean_{h}" if anchor_half(d) else f", NULL AS mean_{h}")
    for h, d in HORIZONS.items()
)
_CHANGES = ",\n  ".join(
    f"round(CASE WHEN d0 <= cutoff - {d} + 31 THEN ({'endpoint' if d >= 365 else 'price'} - coalesce(mean_{h}, at_{h})) / nullif(coalesce(mean_{h}, at_{h}), 0) * 100 END, 6) AS chg_{h.lower()}" for h, d in HORIZONS.items()
)
_PAID = ",\n  ".join(
    f"round(CASE WHEN d0 <= cutoff - {d} THEN coalesce((SELECT sum(amount::DOUBLE) FROM divs v WHERE v.ticker = r.ticker AND ex_date <= cutoff AND ex_date > cutoff - {d}), 0) END, 6) AS div_{h.lower()}" for h, d in DIVIDEND_HORIZONS.items()
)
_LIFE = "CASE WHEN {of} > 0 AND (cutoff - {since}) / 365.25 >= 0.5 THEN (power({to} / {of}, 365.25 / (cutoff - {since})) - 1) * 100 END"
_ROLLING = ",\n  ".join(
    f"(SELECT count(*) FROM c e JOIN c b ON b.ticker = e.ticker AND b.seg = e.seg AND b.j = e.j - {k} * e.cadence WHERE e.ticker = g.ticker AND e.seg = g.seg AND e.j <= g.j AND b.j % {A.ROLLING_STEP} = 0 AND b.close > 0 AND e.close > 0 {cond}) AS {name}{k}"
    for k in (1, 2)
    for name, cond in (("pairs", ""), ("ups", "AND e.close > b.close"))
) + ",\n  " + ",\n  ".join(
    f"(SELECT min(100 * (e.close / b.close - 1)) FROM c e JOIN c b ON b.ticker = e.ticker AND b.seg = e.seg AND b.j = e.j - {k} * e.cadence WHERE e.ticker = g.ticker AND e.seg = g.seg AND e.j <= g.j AND b.j % {A.ROLLING_STEP} = 0 AND b.close > 0 AND e.close > 0) AS low{k}"
    for k in (1, 2)
)

SQL = {
    "walk_cutoffs": _WALK + " SELECT ticker, bar_date, i, seg, j, cadence, history, step FROM c WHERE i >= history AND (i - history) % step = 0",
    "walk_quotes": _WALK
    + f""",
t AS (SELECT ticker, seg, j, x - max(CASE WHEN close > 0 AND close >= top THEN x END) OVER (PARTITION BY ticker, seg ORDER BY bar_date) AS under FROM (SELECT *, max(CASE WHEN close > 0 THEN close END) OVER (PARTITION BY ticker, seg ORDER BY bar_date) AS top FROM c)),
g AS (SELECT cut.ticker, cut.seg, cut.i, cut.j, cut.cadence, cutoff, price, cut.ma, min(bar_date) AS d0, arg_min(s.close, bar_date) AS c0, avg(s.close) FILTER (cut.j - s.j < late) AS endpoint, max(s.close) AS peak,
  avg(s.close) FILTER (cut.j - s.j < cut.ma) AS mean, count(ret) FILTER (cut.i - s.i < cut.cadence) AS rets, stddev_pop(ret) FILTER (cut.i - s.i < cut.cadence) AS sd, avg(power(least(ret, 0), 2)) FILTER (ret IS NOT NULL AND cut.i - s.i < cut.cadence) AS sq,
  max(ret) FILTER (cut.i - s.i < greatest(1, cut.cadence // 12)) AS max_daily, regr_r2(ln(s.close), x) FILTER (s.close > 0) AS r2, regr_slope(ln(s.close), x) FILTER (s.close > 0) AS slope, count(*) FILTER (s.close > 0) AS m,
  max((s.peak - s.close) / nullif(s.peak, 0) * 100) AS max_dd, max(under) AS under, arg_min(s.close, bar_date) FILTER (bar_date >= cutoff - 1826) AS cap_close, min(bar_date) FILTER (bar_date >= cutoff - 1826) AS cap_date,
  {_HORIZONS}
  FROM cut JOIN c s ON s.ticker = cut.ticker AND s.seg = cut.seg AND s.j <= cut.j JOIN t ON t.ticker = s.ticker AND t.seg = s.seg AND t.j = s.j GROUP BY ALL),
l AS (SELECT g.ticker, g.i, count(*) AS below FROM g JOIN c ON c.ticker = g.ticker AND c.seg = g.seg AND c.j <= g.j AND c.close < g.endpoint GROUP BY 1, 2),
r AS (SELECT g.*, coalesce(below, 0) AS below, coalesce((SELECT sum(amount::DOUBLE) FROM divs v WHERE v.ticker = g.ticker AND ex_date <= cutoff), 0) AS paid,
  {_ROLLING} FROM g LEFT JOIN l USING (ticker, i))
SELECT ticker, cutoff, i, cadence, round(price, 6) AS price, round((cutoff - d0) / 365.25, 6) AS age_years, {_CHANGES},
  {_PAID},
  round(greatest(0, (peak - endpoint) / peak * 100), 6) AS from_high, round(CASE WHEN j >= 1 THEN below / j * 100 ELSE 0 END, 6) AS pct_rank, round(CASE WHEN rets >= 2 THEN sd * sqrt(cadence / 252) END, 6) AS vol,
  round(CASE WHEN rets >= 2 THEN sqrt(sq) * sqrt(cadence / 252) END, 6) AS downside, round(max_daily, 6) AS max_daily,
  round(CASE WHEN j + 1 >= ma AND ma > 0 AND mean > 0 THEN greatest(0, (mean - price) / mean * 100) ELSE 0 END, 6) AS below_ma, round(CASE WHEN j + 1 >= ma AND ma > 0 AND mean > 0 THEN greatest(0, (price - mean) / mean * 100) ELSE 0 END, 6) AS above_ma,
  round(CASE WHEN m >= 2 THEN coalesce(r2, 1) ELSE 0 END, 6) AS trend_r2, round(CASE WHEN m >= 2 THEN (exp(slope * cadence) - 1) * 100 END, 6) AS trend_cagr, round({_LIFE.format(of="c0", to="price", since="d0")}, 6) AS life_cagr,
  round(CASE WHEN (cutoff - d0) / 365.25 >= 5 THEN {_LIFE.format(of="cap_close", to="price", since="cap_date")} END, 6) AS capped_cagr, round({_LIFE.format(of="c0", to="(price + paid)", since="d0")}, 6) AS tr_cagr, round(greatest(0, max_dd), 6) AS max_drawdown,
  round(100.0::DOUBLE * ups1 / nullif(pairs1, 0), 6) AS roll1_pos, round(low1, 6) AS worst1, round(100.0::DOUBLE * ups2 / nullif(pairs2, 0), 6) AS roll2_pos, round(low2, 6) AS worst2, round(CASE WHEN m >= 2 THEN under / cadence END, 6) AS underwater_years, {A.UNKNOWN_TURNOVER}::DOUBLE AS turnover FROM r""",
}
