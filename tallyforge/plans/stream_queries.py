"""Queries that run streams to the end of what is there; tests and SQL hold them against the batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.plans.report_queries import SQL as REPORTS
from tallyforge.plans.score_queries import SQL as SCORES
from tallyforge.plans.score_queries import quotes
from tallyforge.operators import scoring as C
from tallyforge.sources import parsers as P
from tallyforge.sources import sinks
from tallyforge.sources import tables as T
from tallyforge.sources.tables import SQL as VIEWS
from tallyforge.streaming import streams as ST


def _windows(s, d):
    rows = ST.drained(ST.window_totals(ST.event_stream(s, d)), "complete")
    return rows.select(F.col("start").cast("date").alias("day"), "event_type", "n", "total")


def _prices(events):
    return events.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), "ts", F.col("value").cast("double").alias("px"), F.col("event_id").alias("seq"))


def _levels(events):
    return events.select(F.col("event_type").alias("series"), "ts", F.col("value").cast("double").alias("level"), F.col("event_id").alias("seq"))


def _verdicts(s, d, times):
    rows = T.table(s, d, "lineitem").groupBy(F.year("l_shipdate").alias("horizon")).agg(F.count("*").alias("n"))
    return rows.select("horizon", (F.col("n") * times).alias("verdict"))


QUERIES = {
    "stream_windows": _windows,
    "stream_first_of_day": lambda s, d: ST.drained(ST.first_of_day(ST.event_stream(s, d)), "append"),
    "stream_dip_alerts": lambda s, d: ST.drained(ST.dip_alerts(_prices(ST.event_stream(s, d))), "append").groupBy("ticker").agg(F.count("*").alias("alerts")),
    "stream_regime_flips": lambda s, d: ST.drained(ST.regime_flips(_levels(ST.event_stream(s, d))), "append").groupBy("series", "was", "state").agg(F.count("*").alias("n")),
    "stream_sessions": lambda s, d: ST.drained(ST.sessions(ST.event_stream(s, d)), "complete"),
    "stream_refetches": lambda s, d: ST.drained(ST.refetches(_prices(ST.event_stream(s, d)).select(F.col("ticker").alias("key"), "ts")), "append").groupBy("key").agg(F.count("*").alias("n")),
    "sink_journal_json": lambda s, d: P.journal_lines(sinks.journal_json(T.journal(s, d)).select("line")),
    "sink_viewer_payload": lambda s, d: sinks.viewer_payload(C.screen(quotes(s, d), top=1), "market").select(F.explode(F.from_json("payload", "map<string, struct<ticker: string, score: double>>")).alias("market", "r")).select("market", "r.ticker", "r.score"),
    "sink_verdicts": lambda s, d: sinks.upsert(_verdicts(s, d, 1), _verdicts(s, d, 2).filter("horizon % 3 = 0"), "horizon"),
}

SQL = {
    "stream_windows": REPORTS["event_windows"],
    "stream_first_of_day": "SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events",
    "stream_dip_alerts": """WITH r AS (SELECT 'U' || user_id AS ticker, ts, value <= 0.7::DOUBLE * max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dip, event_id FROM events), l AS (SELECT *, lag(dip) OVER (PARTITION BY ticker ORDER BY ts, event_id) AS was FROM r)
SELECT ticker, count(*) AS alerts FROM l WHERE dip AND NOT coalesce(was, false) GROUP BY 1""",
    "stream_regime_flips": """WITH r AS (SELECT event_type AS series, ts, event_id, 100 * (value / max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) AS dd FROM events), s AS (SELECT series, ts, event_id, CASE WHEN dd <= -15 THEN 'BEAR' WHEN dd <= -5 THEN 'PULLBACK' ELSE 'NEAR-HIGH' END AS state FROM r),
l AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY series ORDER BY ts, event_id), 'NEAR-HIGH') AS was FROM s) SELECT series, was, state, count(*) AS n FROM l WHERE was <> state GROUP BY 1, 2, 3""",
    "stream_sessions": """WITH r AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM r) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM k GROUP BY user_id, k""",
    "stream_refetches": """WITH RECURSIVE e AS (SELECT 'U' || user_id AS key, ts FROM events), r AS (SELECT key, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT r.key, (SELECT min(ts) FROM e WHERE e.key = r.key AND e.ts >= r.ts + INTERVAL 3 DAY) FROM r WHERE r.ts IS NOT NULL) SELECT key, count(ts) AS n FROM r GROUP BY 1""",
    "sink_journal_json": "WITH " + VIEWS["journal"] + " SELECT day, rank, ticker, px FROM journal",
    "sink_viewer_payload": f"SELECT market, ticker, score FROM ({SCORES['flagship_screen']}) WHERE place = 1",
    "sink_verdicts": "SELECT year(l_shipdate)::INT AS horizon, count(*) * CASE WHEN year(l_shipdate) % 3 = 0 THEN 2 ELSE 1 END AS verdict FROM lineitem GROUP BY 1, year(l_shipdate)",
}
