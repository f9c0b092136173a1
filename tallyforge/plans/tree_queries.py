"""Queries of settings trees, lazily read charts, mergeable sketches, table functions and neutral scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import scoring as C
from tallyforge.operators import settings as ST
from tallyforge.operators import sketches as SK
from tallyforge.operators import tables_of_rows as TR
from tallyforge.plans.asof_queries import _rounded
from tallyforge.plans.feed_queries import _charts
from tallyforge.plans.score_queries import _QUOTES, quotes
from tallyforge.sources import feeds
from tallyforge.sources import tables as T
from tallyforge.sources.tables import SQL as VIEWS

E = F.expr
MIDDLE = "2024-01-16"
NAME_CAP, SECTOR_CAP = 0.05, 0.12
#: A user's settings: of each type of event the largest key and the number of events in the first half of the month.
_BASE = "named_struct('type', map_from_entries(transform(r, x -> struct(x.t, named_struct('k', x.k, 'n', x.n)))), 'flag', user_id % 2, 'only', named_struct('a', 1, 'b', named_struct('c', 'x')))"
#: What the second half says: no key for every third user, a null flag for every fourth, for every fifth a value where the base has a tree, and a new key.
_OVER = "named_struct('type', map_from_entries(transform(r, x -> struct(x.t, named_struct('k', IF(user_id % 3 = 0, NULL, x.k), 'm', x.n)))), 'flag', IF(user_id % 4 = 0, NULL, user_id % 3), 'only', IF(user_id % 5 = 0, parse_json('7'), parse_json('{}')), 'new', CAST(NULL AS STRING))"


def _trees(s, d, late: bool):
    e = T.table(s, d, "events").filter(f"ts {'>=' if late else '<'} '{MIDDLE}'").selectExpr("user_id", "event_type AS t", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    g = e.groupBy("user_id", "t").agg(F.max("k").alias("k"), F.count("*").cast("int").alias("n"))
    one = g.groupBy("user_id").agg(F.collect_list(F.struct("t", "k", "n")).alias("r"))  # a row a type of event
    return ST.leaves(one.select(F.col("user_id").alias("id"), E(f"to_json(to_variant_object({_OVER if late else _BASE}))").alias("json")))


def _week():
    return F.date_trunc("week", "day").cast("date")


def _sketched(s, d):
    events = T.table(s, d, "events")
    told = SK.merged(SK.daily(events), _week())
    return SK.checked(events.withColumn("day", F.to_date("ts")), _week(), told)


def _sizes(s, d):
    rows = quotes(s, d).select("ticker", F.when(F.col("market").isin("ASIA", "EUROPE"), "core").otherwise("other").alias("class"), "sector", F.col("pct_rank").alias("score"), "volatility")
    return C.sizes(rows, s.createDataFrame([("core", 60.0), ("other", 30.0), ("unused", 10.0)], "class string, budget double"), NAME_CAP, sector_cap=SECTOR_CAP, sector_class="core")


QUERIES = {
    "settings_overlay": lambda s, d: ST.overlaid(_trees(s, d, False), _trees(s, d, True)),
    "settings_drift": lambda s, d: ST.drift(_trees(s, d, False), _trees(s, d, True)),
    "feed_lazy_field": lambda s, d: feeds.chart_field(feeds.lazy_charts(_charts(s, d)), "$.timestamp[0]", "bigint").withColumnRenamed("value", "first"),
    "sketch_weeks": _sketched,
    "walk_cutoffs_udtf": lambda s, d: TR.cutoffs(T.bars(s, d)),
    "score_neutral": lambda s, d: C.neutral_scores(quotes(s, d), "sector", "life_cagr"),
    "position_sizes_sectors": _sizes,
}

_TREE = f"""g AS (SELECT user_id AS id, event_type AS t, ts >= TIMESTAMP '{MIDDLE}' AS late, max(json_extract_string(props, '$.k')::INT) AS k, count(*) AS n FROM events GROUP BY 1, 2, 3),
b AS (SELECT id, 'type/' || t || '/k' AS path, k::VARCHAR AS value FROM g WHERE NOT late AND k IS NOT NULL UNION ALL SELECT id, 'type/' || t || '/n', n::VARCHAR FROM g WHERE NOT late
  UNION ALL SELECT DISTINCT id, 'flag', (id % 2)::VARCHAR FROM g WHERE NOT late UNION ALL SELECT DISTINCT id, 'only/a', '1' FROM g WHERE NOT late UNION ALL SELECT DISTINCT id, 'only/b/c', 'x' FROM g WHERE NOT late),
o AS (SELECT id, 'type/' || t || '/k' AS path, k::VARCHAR AS value FROM g WHERE late AND id % 3 <> 0 AND k IS NOT NULL UNION ALL SELECT id, 'type/' || t || '/m', n::VARCHAR FROM g WHERE late
  UNION ALL SELECT DISTINCT id, 'flag', (id % 3)::VARCHAR FROM g WHERE late AND id % 4 <> 0 UNION ALL SELECT DISTINCT id, 'only', '7' FROM g WHERE late AND id % 5 = 0)"""


def _sizes_sql(passes: int = 5) -> str:
    parts = [f""", z AS (SELECT ticker, CASE WHEN market IN ('ASIA', 'EUROPE') THEN 'core' ELSE 'other' END AS class, sector, pct_rank / volatility AS raw FROM quotes WHERE pct_rank > 0 AND volatility > 0), bu(class, budget) AS (VALUES ('core', 60.0::DOUBLE), ('other', 30.0)),
y0 AS (SELECT ticker, class, sector, raw, budget / (SELECT sum(budget) FROM bu WHERE class IN (SELECT class FROM z)) AS room, 0.0::DOUBLE AS weight, false AS ful FROM z JOIN bu USING (class))"""]
    for k in range(passes):
        parts.append(f"""x{k} AS (SELECT ticker, class, sector, raw, room, ful, CASE WHEN weight < {NAME_CAP} AND NOT ful THEN least({NAME_CAP}, weight + coalesce((room - sum(weight) OVER (PARTITION BY class)) * raw / nullif(sum(CASE WHEN weight < {NAME_CAP} AND NOT ful THEN raw END) OVER (PARTITION BY class), 0), 0)) ELSE weight END AS weight FROM y{k}),
v{k} AS (SELECT *, sum(weight) OVER (PARTITION BY class, sector) AS s FROM x{k}),
y{k + 1} AS (SELECT ticker, class, sector, raw, room, CASE WHEN class = 'core' AND s > {SECTOR_CAP} THEN weight * {SECTOR_CAP} / s ELSE weight END AS weight, ful OR (class = 'core' AND s > {SECTOR_CAP}) AS ful FROM v{k})""")
    return ", ".join(parts) + f" SELECT ticker, class, round(weight, 6) AS weight FROM y{passes}"


#: Newton's steps on the normal distribution, whose integral is a series; good to 1e-9 for places that aren't extreme.
_PHI = "(0.5::DOUBLE + exp(-x * x / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60), lambda k: x ** (2 * k + 1) / list_product(list_transform(range(0, k + 1), lambda j: 2.0::DOUBLE * j + 1)))))"

SQL = {
    "settings_overlay": f"""WITH {_TREE}, gone AS (SELECT b.id, b.path FROM b JOIN o ON o.id = b.id AND (o.path = b.path OR starts_with(b.path, o.path || '/')))
SELECT id, path, value, 'base' AS origin FROM b ANTI JOIN gone USING (id, path) UNION ALL SELECT id, path, value, 'overlay' FROM o
UNION ALL SELECT DISTINCT id, 'new', NULL, 'overlay' FROM g WHERE late
UNION ALL SELECT id, 'type/' || t || '/k', NULL, 'overlay' FROM g x WHERE late AND (id % 3 = 0 OR k IS NULL) AND NOT EXISTS (SELECT 1 FROM b WHERE b.id = x.id AND b.path = 'type/' || x.t || '/k')
UNION ALL SELECT DISTINCT id, 'flag', NULL, 'overlay' FROM g x WHERE late AND id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM b WHERE b.id = x.id AND b.path = 'flag')""",
    "settings_drift": f"WITH {_TREE} SELECT id, path, b.value AS was, o.value AS now FROM o LEFT JOIN b USING (id, path) WHERE b.value IS DISTINCT FROM o.value",
    "feed_lazy_field": "SELECT 'U' || user_id AS ticker, min(floor(epoch(ts)))::BIGINT AS first FROM events GROUP BY 1",
    "sketch_weeks": "SELECT CAST(date_trunc('week', ts) AS DATE) AS period, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near, true AS p90_near FROM events GROUP BY 1",
    "walk_cutoffs_udtf": f"""WITH {VIEWS["bars"]}, a AS (SELECT ticker, bar_date, row_number() OVER (PARTITION BY ticker ORDER BY bar_date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n, max(bar_date) OVER (PARTITION BY ticker) - min(bar_date) OVER (PARTITION BY ticker) AS span FROM bars),
c AS (SELECT *, {_rounded("1.0")} AS cadence, {_rounded("3.0")} AS history, {_rounded("0.5")} AS step FROM a) SELECT ticker, bar_date AS cutoff, i::INT AS i, cadence FROM c WHERE i >= history AND (i - history) % step = 0""",
    "score_neutral": _QUOTES
    + f""", r AS (SELECT ticker, sector, rank() OVER w + (count(*) OVER (PARTITION BY sector, life_cagr) - 1) / 2.0::DOUBLE AS rank, count(*) OVER (PARTITION BY sector) AS n FROM quotes WHERE life_cagr IS NOT NULL WINDOW w AS (PARTITION BY sector ORDER BY life_cagr)),
s0 AS (SELECT *, (rank - 0.5) / n AS p, 0.0::DOUBLE AS x FROM r)"""
    + "".join(f", s{k + 1} AS (SELECT ticker, sector, rank, n, p, x - ({_PHI} - p) / (exp(-x * x / 2) / sqrt(2 * pi())) AS x FROM s{k})" for k in range(6))
    + " SELECT ticker, sector, rank, round(x, 6) AS z FROM s6",
    "position_sizes_sectors": _QUOTES + _sizes_sql(),
}
