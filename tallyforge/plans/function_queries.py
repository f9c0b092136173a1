"""Queries of the scalar functions, over the samples and small inline tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import finance as FI
from tallyforge.functions import formatting as FO
from tallyforge.plans.walk_queries import QUERIES as WALK
from tallyforge.plans.walk_queries import SQL as WALK_SQL
from tallyforge.sources import tables as T

TIERS = [("all-world", "world"), ("msci world", "developed"), ("s&p 500", "country"), ("world", "world")]
#: A fund of each part: its name, fee, replication, share class and size.
FUND = "p_partkey, element_at(array('A All-World ETF', 'B MSCI World Energy', 'C S&P 500', 'D Europe', 'E World Small'), CAST(p_partkey % 5 AS INT) + 1) AS name, IF(p_partkey % 4 = 0, NULL, p_size / 100.0D) AS ter, IF(p_partkey % 3 = 0, 'swap', IF(p_partkey % 7 = 0, NULL, 'physical')) AS replication, IF(p_partkey % 6 = 0, 'dist', 'acc') AS share_class, p_retailprice * 1e5 AS aum"


def _edges(s, d):
    rows = WALK["stat_edges"](s, d)
    return rows.select("bucket", F.round(FI.annual_edge(F.col("top"), F.col("bottom"), 2), 6).alias("annual_edge"), F.round(FI.effective_windows(F.col("n"), 2), 6).alias("n_eff"), F.round(F.col("edge") - FI.cost_points(F.lit(0.5), 2), 6).alias("net_edge"), FI.gap_verdict(F.col("top"), F.col("bottom"), F.col("t1"), F.col("t3")).alias("verdict"))


RUNGS = [(2.0, 0.1), (5.0, 0.2), (8.0, 0.3)]


def _tax(s, d):
    rows = T.table(s, d, "part").select("p_partkey", (F.col("p_size") % 12 + 1).alias("years"), (F.col("p_retailprice") / 100 - 8).alias("yearly"))
    rate = FI.tax_rate(0.28, F.col("years"), RUNGS)
    held, sold = FI.after_tax(F.col("yearly"), 5, rate, F.lit(0.28))
    return rows.select("p_partkey", F.round(rate, 6).alias("rate"), F.round(held, 6).alias("held"), F.round(sold, 6).alias("rotated"))


def _funds(s, d):
    rows = T.table(s, d, "part").selectExpr(*[c.strip() for c in _columns(FUND)])
    return rows.select("p_partkey", FI.fund_category(F.col("name"), TIERS, ["energy"]).alias("tier"), FI.hold_miss(F.col("ter"), F.col("replication"), F.col("share_class"), F.col("aum")).alias("miss"))


def _columns(text: str) -> list[str]:
    """The parts between commas outside brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        out = [*out, ""] if c == "," and not depth else [*out[:-1], out[-1] + c]
    return out


def _implied(s, d):
    rows = T.table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), (F.col("p_size") - 5).cast("double").alias("e"))
    return rows.select("p_partkey", F.round(FI.implied_growth(F.col("price"), F.col("e"), 0.1, 10, 15.0), 6).alias("growth"), F.round(FI.composite([F.col("price"), F.when(F.col("e") > 0, F.col("e")), F.when(F.col("e") > 20, F.lit(1.0))]), 6).alias("composite"), FI.profit_zone((F.col("e") - 10) / 40).alias("zone"))


QUERIES = {
    "format_cells": lambda s, d: T.table(s, d, "customer").select("c_custkey", FO.money(F.col("c_acctbal")).alias("money"), FO.percent_cell(F.floor(F.col("c_acctbal")) / 4).alias("pct"), FO.human(F.col("c_custkey") * F.lit(1000.0) * F.col("c_custkey")).alias("human"), FO.truncated(F.col("c_name"), 10).alias("name")),
    "edge_tags": _edges,
    "after_tax": _tax,
    "fund_hold_rules": _funds,
    "implied_growth": _implied,
}

SQL = {
    "edge_tags": f"""WITH x AS ({WALK_SQL["stat_edges"]}) SELECT bucket, round((sqrt(greatest(1 + top / 100, 0)) - sqrt(greatest(1 + bottom / 100, 0))) * 100, 6) AS annual_edge, round(n / 4.0::DOUBLE, 6) AS n_eff, round(edge - 0.4::DOUBLE, 6) AS net_edge,
  CASE WHEN top > bottom AND t1 > t3 THEN 'first' WHEN top < bottom AND t1 < t3 THEN 'second' ELSE 'unclear' END AS verdict FROM x""",
    "after_tax": """WITH x AS (SELECT p_partkey, p_size % 12 + 1 AS years, p_retailprice / 100 - 8 AS y FROM part), r AS (SELECT *, 0.28::DOUBLE * (1 - CASE WHEN years >= 8 THEN 0.3::DOUBLE WHEN years >= 5 THEN 0.2 WHEN years >= 2 THEN 0.1 ELSE 0 END) AS rate, power(1 + y / 100, 5) - 1 AS g FROM x)
SELECT p_partkey, round(rate, 6) AS rate, round(1 + g - greatest(g, 0) * rate, 6) AS held, round(power(1 + y / 100 - greatest(y / 100, 0) * 0.28::DOUBLE, 5), 6) AS rotated FROM r""",
    "fund_hold_rules": """WITH f AS (SELECT p_partkey, p_partkey % 5 AS n, CASE WHEN p_partkey % 4 <> 0 THEN p_size / 100.0::DOUBLE END AS ter, CASE WHEN p_partkey % 3 = 0 THEN 'swap' WHEN p_partkey % 7 <> 0 THEN 'physical' END AS rep, CASE WHEN p_partkey % 6 = 0 THEN 'dist' ELSE 'acc' END AS cls, p_retailprice * 1e5 AS aum FROM part)
SELECT p_partkey, ['world', 'narrow', 'country', 'other', 'world'][n + 1] AS tier, CASE WHEN ter > 0.3::DOUBLE THEN 'ter' WHEN rep = 'swap' THEN 'replication' WHEN cls = 'dist' THEN 'share class' WHEN aum < 1e8 THEN 'size' END AS miss FROM f""",
    "implied_growth": """WITH x AS (SELECT p_partkey, p_retailprice AS price, (p_size - 5)::DOUBLE AS e FROM part)
SELECT p_partkey, round(CASE WHEN price > 0 AND e > 0 THEN (power(price * power(1.1::DOUBLE, 10) / (e * 15), 0.1::DOUBLE) - 1) * 100 END, 6) AS growth, round(CASE WHEN e > 20 THEN (price + e + 1) / 3 WHEN e > 0 THEN (price + e) / 2 END, 6) AS composite,
  CASE WHEN (e - 10) / 40 < 0 THEN 'Capitulation' WHEN (e - 10) / 40 < 0.25 THEN 'Hope/Fear' WHEN (e - 10) / 40 < 0.5 THEN 'Optimism/Anxiety' WHEN (e - 10) / 40 < 0.75 THEN 'Belief/Denial' ELSE 'Euphoria/Greed' END AS zone FROM x""",
    "format_cells": """SELECT c_custkey, format('{:,.2f}', c_acctbal) AS money, (CASE WHEN floor(c_acctbal) >= 0 THEN '+' ELSE '-' END) || (CASE WHEN abs(floor(c_acctbal) / 4) >= 1000 THEN printf('%.0f', abs(floor(c_acctbal) / 4)) ELSE printf('%.1f', abs(floor(c_acctbal) / 4)) END) || '%' AS pct,
  CASE WHEN h >= 1e12 THEN format('{:,.1f}', h / 1e12) || 'T' WHEN h >= 1e9 THEN format('{:,.1f}', h / 1e9) || 'B' WHEN h >= 1e6 THEN format('{:,.1f}', h / 1e6) || 'M' WHEN h >= 1e3 THEN format('{:,.1f}', h / 1e3) || 'K' ELSE printf('%.0f', h) END AS human,
  CASE WHEN length(c_name) > 10 THEN left(c_name, 9) || '…' ELSE c_name END AS name FROM (SELECT *, c_custkey * 1000.0::DOUBLE * c_custkey AS h FROM customer)""",
}
