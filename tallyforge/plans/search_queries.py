"""Queries that search and compare scores, and of books under a cap on correlation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import books as B
from tallyforge.operators import picks as PK
from tallyforge.operators import walk as K
from tallyforge.plans.score_queries import _QUOTES, quotes
from tallyforge.plans.walk_queries import _GATE, _RHO, _SAMPLES, _gate, _samples
from tallyforge.sources import tables as T
from tallyforge.sources.tables import SQL as VIEWS

DRAWS, SHARE, PURGE = 500, 0.7, 6
FACTOR_DRAWS = 200
FACTORS = ["cagr_life", "max_dd", "vol", "range_pct", "r2"]
LIVE_CAP, LIVE_KEEP = 0.2, 8  #: invented prices hardly move together
CAPS = [2.0, 0.8, 0.6]  #: the first keeps all
#: Terms of the score that an arm leaves out.
TERMS = {"growth": "least(cagr_life, 30.0)", "range": "range_pct / 10", "fall": "-max_dd / 20"}


def _without(name: str) -> str:
    return " + ".join(f"({t})" for k, t in TERMS.items() if k != name)


def _ablation(s, d):
    arms = {k: F.round(F.expr(_without(k)), 4) for k in TERMS}
    # an arm's own gate, which some rows that the base admits don't pass
    arms["strict"] = F.when(F.col("max_dd") <= 95, F.round(F.expr(_without("growth")), 4))
    return K.ablation(_samples(s, d), F.when(_gate(), F.col("score")), arms, PURGE)


def _without_copies(s, d):
    last = B.trails(T.bars(s, d)).groupBy("ticker").agg(F.max_by("trail", "cutoff").alias("trail"))
    return PK.without_copies(quotes(s, d).select("ticker", "market", F.col("pct_rank").alias("score")), last, "market", LIVE_CAP, LIVE_KEEP)


QUERIES = {
    "walk_knob_search": lambda s, d: K.knob_search(_samples(s, d), K.knob_draws(s, DRAWS), SHARE, PURGE),
    "walk_factor_sweep": lambda s, d: K.factor_sweep(_samples(s, d), FACTORS, PURGE),
    "walk_factor_draws": lambda s, d: K.factor_draws(_samples(s, d), FACTORS, FACTOR_DRAWS, PURGE),
    "walk_ablation": _ablation,
    "stat_decorrelate": lambda s, d: B.decorrelated(_samples(s, d), B.trails(T.bars(s, d)), CAPS),
    "picks_without_copies": _without_copies,
    "book_corr_cap": lambda s, d: B.capped_books(_samples(s, d), B.trails(T.bars(s, d)), T.benchmark_bars(s, d), CAPS),
}

_DRAWS = f"""d AS (SELECT range AS id FROM range({DRAWS})),
a0 AS (SELECT 'd' || lpad(id::VARCHAR, 4, '0') AS arm, ((id * 2654435761) % 997) / 996.0::DOUBLE AS x, ((id * 2654435761 + 31337) % 997) / 996.0::DOUBLE AS y, ((id * 2654435761 + 70001) % 997) / 996.0::DOUBLE AS z FROM d),
arms AS (SELECT arm, CASE WHEN x < 1 / 3.0::DOUBLE THEN 0 ELSE round((x - 1 / 3.0::DOUBLE) * 3 - 1, 4) END AS w_range, CASE WHEN y < 1 / 3.0::DOUBLE THEN 0 ELSE round((y - 1 / 3.0::DOUBLE) * 3 - 1, 4) END AS w_dd, CASE WHEN z < 1 / 3.0::DOUBLE THEN 0 ELSE round((z - 1 / 3.0::DOUBLE) * 3 - 1, 4) END AS w_cagr FROM a0)"""


def _lane(tag: str, src: str, by: str) -> str:
    """Halves' edge and rank correlation of ``src`` (by, score, relative, ticker, cutoff) as ``{tag}`` (by, n, rho, edge)."""
    mean_rank = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE"
    return f""", {tag}b AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, ticker, cutoff) AS rn, count(*) OVER (PARTITION BY {by}) AS n,
  {mean_rank.format(by=by, x="score")} AS rx, {mean_rank.format(by=by, x="relative")} AS ry FROM {src}),
{tag} AS (SELECT {by}, n, CASE WHEN n >= 4 THEN {_RHO} END AS rho,
  CASE WHEN n >= 4 THEN round(avg(relative) FILTER (WHERE rn <= n // 2) - avg(relative) FILTER (WHERE rn > n - n // 2), 6) ELSE 0 END AS edge FROM {tag}b GROUP BY {by}, n)"""


def _edge(src: str, share: float) -> str:
    """The date of the row of ``src`` at ``share`` of all."""
    return f"(SELECT cutoff FROM (SELECT cutoff, row_number() OVER (ORDER BY cutoff) AS p, count(*) OVER () AS m FROM {src}) WHERE p = floor({share}::DOUBLE * m) + 1)"


def _halves(src: str, by: str) -> str:
    """``t`` and the purged halves of ``src`` as ``sides`` (by, early_rho, late_rho)."""
    part = f"CASE WHEN cutoff >= {_edge(src, 0.5)} THEN 'late' WHEN cutoff < {_edge(src, 0.5)} - {30 * PURGE} THEN 'early' END"
    return (
        _lane("t", src, by)
        + f", hv AS (SELECT *, {by} || ':' || {part} AS part FROM {src}), hw AS (SELECT * FROM hv WHERE part IS NOT NULL)"
        + _lane("u", "hw", "part")
        + f", sides AS (SELECT t.{by}, max(u.rho) FILTER (u.part = t.{by} || ':early') AS early_rho, max(u.rho) FILTER (u.part = t.{by} || ':late') AS late_rho FROM t LEFT JOIN u ON u.part IN (t.{by} || ':early', t.{by} || ':late') GROUP BY 1)"
    )


_SCORE = "round(least(cagr_life, 30.0) * w_cagr + w_range * range_pct - w_dd * max_dd, 4) AS score, ticker, cutoff"
_LONG = f"(UNPIVOT (SELECT relative, ticker, cutoff, {', '.join(FACTORS)} FROM samples) ON {', '.join(FACTORS)} INTO NAME factor VALUE score)"
_BEATS = "coalesce(t.edge > (SELECT edge FROM v) AND early_rho > 0 AND late_rho > 0, false) AS beats"
_ARM_SCORES = ", ".join([f"struct_pack(arm := '{k}', score := round({_without(k)}, 4))" for k in TERMS] + [f"struct_pack(arm := 'strict', score := CASE WHEN max_dd <= 95 THEN round({_without('growth')}, 4) ELSE score END)"])
_CAPS = ", ".join(f"({c}::DOUBLE)" for c in CAPS)
#: The walk of a bucket, one candidate after another.
_GREEDY = (
    _SAMPLES.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", caps(cap) AS (VALUES {_CAPS}),
cand AS (SELECT bucket, ticker || ':' || cutoff AS id, ticker, cutoff, realized, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, ticker || ':' || cutoff) AS rn FROM samples),
rets AS (SELECT ticker, bar_date, row_number() OVER w AS i, (close / lag(close) OVER w - 1) * 100 AS ret FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY bar_date)),
tr AS (SELECT c.bucket, c.id, c.rn, r.ret, row_number() OVER (PARTITION BY c.id ORDER BY r.i DESC) AS p FROM cand c JOIN rets e ON e.ticker = c.ticker AND e.bar_date = c.cutoff JOIN rets r ON r.ticker = c.ticker AND r.i > e.i - 36 AND r.i <= e.i WHERE r.ret IS NOT NULL),
rho AS (SELECT a.bucket, a.id AS one, b.id AS two, corr(a.ret, b.ret) AS rho FROM tr a JOIN tr b ON a.bucket = b.bucket AND a.p = b.p AND a.rn < b.rn GROUP BY 1, 2, 3 HAVING count(*) >= 12),
near AS (SELECT bucket, cap, two AS id, list(one) AS near FROM rho, caps WHERE cap <= 1 AND rho >= cap GROUP BY 1, 2, 3),
g AS (SELECT bucket, cap, 0::BIGINT AS r, []::VARCHAR[] AS kept FROM (SELECT DISTINCT bucket FROM samples), caps UNION ALL
  SELECT g.bucket, g.cap, g.r + 1, CASE WHEN len(kept) < 10 AND NOT list_has_any(kept, coalesce(near, []::VARCHAR[])) THEN list_append(kept, c.id) ELSE kept END
  FROM g JOIN cand c ON c.bucket = g.bucket AND c.rn = g.r + 1 LEFT JOIN near n ON n.bucket = g.bucket AND n.cap = g.cap AND n.id = c.id),
held AS (SELECT g.bucket, g.cap, c.rn::INT AS rn, c.id, c.realized, c.cutoff FROM (SELECT bucket, cap, arg_max(kept, r) AS kept FROM g GROUP BY 1, 2) g JOIN cand c ON c.bucket = g.bucket AND list_contains(g.kept, c.id))"""
)

SQL = {
    "walk_knob_search": _SAMPLES
    + f""", {_DRAWS}, ed AS (SELECT {_edge("samples", SHARE)} AS edge),
tr AS (SELECT arm, relative, {_SCORE} FROM samples, arms, ed WHERE cutoff < edge - {30 * PURGE}), te AS (SELECT arm, relative, {_SCORE} FROM samples, arms, ed WHERE cutoff >= edge)"""
    + _lane("t", "tr", "arm")
    + _lane("u", "te", "arm")
    + """, won AS (SELECT arm, (w_range <> 0)::INT + (w_dd <> 0)::INT + (w_cagr <> 0)::INT AS active, t.rho AS train_rho, t.edge AS train_edge FROM t JOIN arms USING (arm) WHERE t.rho > 0 ORDER BY t.edge DESC, active, arm LIMIT 1)
SELECT won.*, u.rho AS test_rho, u.edge AS test_edge FROM won LEFT JOIN u USING (arm)""",
    "walk_factor_sweep": _SAMPLES
    + f", f AS (SELECT factor, score, relative, ticker, cutoff FROM {_LONG} WHERE score IS NOT NULL), al AS (SELECT 'all' AS g, score, relative, ticker, cutoff FROM samples)"
    + _halves("f", "factor")
    + _lane("v", "al", "g")
    + f" SELECT t.*, early_rho, late_rho, {_BEATS} FROM t JOIN sides USING (factor)",
    "walk_factor_draws": _SAMPLES
    + f""", w AS (SELECT range AS draw, round((range * 2654435761 + 7) % 1999 / 999.0::DOUBLE - 1, 6) AS weight FROM range({FACTOR_DRAWS})),
fl AS (SELECT * FROM (SELECT relative, ticker, cutoff, score AS base, {", ".join(FACTORS)} FROM samples) UNPIVOT INCLUDE NULLS (value FOR factor IN ({", ".join(FACTORS)}))),
f AS (SELECT factor || ':' || lpad(draw::VARCHAR, 4, '0') AS arm, relative, ticker, cutoff, round(base + coalesce(weight * value, 0), 6) AS score FROM fl, w), al AS (SELECT 'all' AS g, score, relative, ticker, cutoff FROM samples)"""
    + _halves("f", "arm")
    + _lane("v", "al", "g")
    + f" SELECT split_part(arm, ':', 1) AS factor, draw::INT AS draw, weight, n, rho, edge, early_rho, late_rho, {_BEATS} FROM t JOIN sides USING (arm) JOIN w ON draw = split_part(arm, ':', 2)::INT",
    "walk_ablation": _SAMPLES
    + f""", ad AS (SELECT relative, ticker, cutoff, unnest([struct_pack(arm := 'full', score := score), {_ARM_SCORES}]) AS x FROM samples WHERE {_GATE} AND score IS NOT NULL),
f AS (SELECT relative, ticker, cutoff, x.arm AS arm, x.score AS score FROM ad)"""
    + _halves("f", "arm")
    + """ SELECT t.*, round(t.rho - b.rho, 6) AS d_rho, round(t.edge - b.edge, 6) AS d_edge, early_rho, late_rho FROM t JOIN sides USING (arm), (SELECT rho, edge FROM t WHERE arm = 'full') b""",
    "picks_without_copies": _QUOTES.replace("WITH ", "WITH RECURSIVE " + VIEWS["bars"] + ", ", 1)
    + f""", cand AS (SELECT market AS bucket, ticker AS id, row_number() OVER (PARTITION BY market ORDER BY pct_rank DESC, ticker) AS rn FROM quotes),
rets AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY bar_date DESC) AS p, (close / lag(close) OVER (PARTITION BY ticker ORDER BY bar_date) - 1) * 100 AS ret FROM bars),
tr AS (SELECT c.bucket, c.id, c.rn, r.ret, r.p FROM cand c JOIN rets r ON r.ticker = c.id WHERE r.p <= 36 AND r.ret IS NOT NULL),
rho AS (SELECT a.bucket, a.id AS one, b.id AS two, corr(a.ret, b.ret) AS rho FROM tr a JOIN tr b ON a.bucket = b.bucket AND a.p = b.p AND a.rn < b.rn GROUP BY 1, 2, 3 HAVING count(*) >= 12),
near AS (SELECT bucket, two AS id, list(one) AS near FROM rho WHERE rho >= {LIVE_CAP} GROUP BY 1, 2),
g AS (SELECT bucket, 0::BIGINT AS r, []::VARCHAR[] AS kept FROM (SELECT DISTINCT bucket FROM cand) UNION ALL
  SELECT g.bucket, g.r + 1, CASE WHEN len(kept) < {LIVE_KEEP} AND NOT list_has_any(kept, coalesce(near, []::VARCHAR[])) THEN list_append(kept, c.id) ELSE kept END
  FROM g JOIN cand c ON c.bucket = g.bucket AND c.rn = g.r + 1 LEFT JOIN near n ON n.bucket = g.bucket AND n.id = c.id)
SELECT c.bucket AS market, row_number() OVER (PARTITION BY c.bucket ORDER BY c.rn)::INT AS place, c.rn::INT AS rn, c.id AS ticker FROM (SELECT bucket, arg_max(kept, r) AS kept FROM g GROUP BY 1) g JOIN cand c ON c.bucket = g.bucket AND list_contains(g.kept, c.id)""",
    "stat_decorrelate": _GREEDY + " SELECT bucket, cap, rn, id FROM held",
    "book_corr_cap": _GREEDY
    + """, bk AS (SELECT cap, bucket, avg(1 + realized / 100) AS multiple, min(cutoff) AS start FROM held GROUP BY 1, 2),
x AS (SELECT cap, bucket, (sqrt(greatest(multiple, 0)) - 1) * 100 AS book, (sqrt(greatest(1 + round(100 * ((SELECT arg_min(close, bar_date) FROM bench WHERE bar_date >= start + 730 AND close > 0) / (SELECT arg_min(close, bar_date) FROM bench WHERE bar_date >= start AND close > 0) - 1), 6) / 100, 0)) - 1) * 100 AS "index" FROM bk),
y AS (SELECT *, book - "index" AS excess, row_number() OVER (PARTITION BY cap ORDER BY bucket) AS rn, count(*) OVER (PARTITION BY cap) AS m FROM x WHERE "index" IS NOT NULL)
SELECT cap, count(*) AS buckets, round(avg(book), 4) AS book, round(avg("index"), 4) AS "index", round(avg(excess), 4) AS excess, round(100 * avg(CASE WHEN excess > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS win_pct, round(min(book), 4) AS worst,
  round(avg(excess) FILTER (WHERE rn <= m // 2), 4) AS early, round(avg(excess) FILTER (WHERE rn > m // 2), 4) AS late FROM y GROUP BY cap""",
}
