"""Canonical views over the input tables: bars, benchmark, dividends, splits, filings, spans, journal.

Each view is one grouping of its table; ``bars`` and all that hangs on it is partitioned by ticker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker(column: str = "l_suppkey"):
    return F.concat(F.lit("S"), F.col(column).cast("string"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, bar_date, close, volume): a supplier's day."""
    rows = table(spark, sf_dir, "lineitem").select(ticker().alias("ticker"), F.col("l_shipdate").cast("date").alias("bar_date"), "l_extendedprice", "l_quantity")
    return rows.groupBy("ticker", "bar_date").agg(F.max("l_extendedprice").alias("close"), F.sum("l_quantity").alias("volume"))


def benchmark_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bar_date, close): the market's day."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("bar_date"), "l_quantity")
    return rows.groupBy("bar_date").agg(F.sum("l_quantity").alias("close"))


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ex_date, amount): returned lines pay their discount."""
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return rows.select(ticker().alias("ticker"), F.col("l_shipdate").cast("date").alias("ex_date"), F.col("l_discount").cast("decimal(12,4)").alias("amount"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, eff_date, ratio): seventh lines split two for one."""
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7")
    return rows.select(ticker().alias("ticker"), F.col("l_shipdate").cast("date").alias("eff_date"), F.lit(2.0).alias("ratio")).distinct()


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter a row, known 45 days after its end: revenue, income, margins in percent, a share's earnings, the balance, and
    what the filing says of the year before, which not all do. Taxes stand for costs that operating income doesn't bear."""
    q = table(spark, sf_dir, "lineitem").select(
        ticker().alias("ticker"),
        F.date_sub(F.add_months(F.trunc(F.col("l_shipdate").cast("date"), "quarter"), 3), 1).alias("period_end"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("rev"),
        (F.col("l_extendedprice").cast("decimal(18,4)") * F.col("l_discount").cast("decimal(6,4)")).cast("decimal(18,4)").alias("cost"),
        (F.col("l_extendedprice").cast("decimal(18,4)") * F.col("l_tax").cast("decimal(6,4)")).cast("decimal(18,4)").alias("duty"),
        F.col("l_quantity").cast("decimal(18,4)").alias("qty"),
    )
    g = q.groupBy("ticker", "period_end").agg(F.sum("rev").cast("double").alias("revenue"), F.sum("cost").cast("double").alias("net_income"), F.sum("duty").cast("double").alias("duty"), F.sum("qty").cast("double").alias("shares"))
    g = g.withColumns({"filed": F.date_add("period_end", 45), "eps": F.col("net_income") / F.col("shares")})
    net, rev, duty, eps, shares, quarter = F.col("net_income"), F.col("revenue"), F.col("duty"), F.col("eps"), F.col("shares"), F.quarter("period_end")
    return g.select(
        "ticker", "filed", "period_end", "revenue", "net_income", "eps", "shares", (100 * net / rev).alias("net_margin"), (100 * (net + duty) / rev).alias("op_margin"), (100 * (2 * net + duty) / rev).alias("gross_margin"), (100 * duty / rev).alias("fcf_margin"),
        (3 * rev).alias("assets"), (net / (rev / 2) * 100).alias("roe"), (net / (3 * rev) * 100).alias("roa"), (net + 2 * duty).alias("ebitda"), (rev / 4 - 100 * shares).alias("net_debt"), ((net + duty) / (rev / 100)).alias("interest_cover"),
        F.when(quarter % 2 == 0, eps * 0.95).alias("prior_eps"), F.when(quarter == 4, shares * 1.02).alias("prior_shares"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, start_date, end_date): membership; suppliers whose key is divisible by 3 leave in 2000."""
    rows = table(spark, sf_dir, "supplier")
    end = F.when(F.col("s_suppkey") % 3 == 0, F.lit("2000-01-01").cast("date"))
    return rows.select(ticker("s_suppkey").alias("ticker"), F.make_date(F.lit(1995) + (F.col("s_suppkey") % 4).cast("int"), F.lit(1), F.lit(1)).alias("start_date"), end.alias("end_date"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector, market, class): a supplier's nation and region, and one of three asset classes by its key."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    both = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return both.select(ticker("s_suppkey").alias("ticker"), F.col("n_name").alias("sector"), F.col("r_name").alias("market"), (F.col("s_suppkey") % 3).cast("int").alias("class"))


def journal(spark: SparkSession, sf_dir: str, top: int = 20) -> DataFrame:
    """(day, rank, ticker, px): the ``top`` users of each day by the value of their events."""
    from pyspark.sql import Window

    day = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker")).agg(F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("px"))
    return day.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("px"), "ticker"))).filter(F.col("rank") <= top).select("day", "rank", "ticker", "px")


#: The same views in SQL, as common table expressions.
SQL = {
    "bars": "bars AS (SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS bar_date, max(l_extendedprice) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)",
    "bench": "bench AS (SELECT CAST(l_shipdate AS DATE) AS bar_date, sum(l_quantity) AS close FROM lineitem GROUP BY 1)",
    "divs": "divs AS (SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS ex_date, CAST(l_discount AS DECIMAL(12,4)) AS amount FROM lineitem WHERE l_returnflag = 'R')",
    "splits": "splits AS (SELECT DISTINCT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS eff_date, 2.0::DOUBLE AS ratio FROM lineitem WHERE l_linenumber = 7)",
    "filings": """q AS (SELECT 'S' || l_suppkey AS ticker, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
  CAST(l_extendedprice AS DECIMAL(18,4)) AS rev, CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(6,4)) AS DECIMAL(18,4)) AS cost, CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_tax AS DECIMAL(6,4)) AS DECIMAL(18,4)) AS du, CAST(l_quantity AS DECIMAL(18,4)) AS qty FROM lineitem),
qs AS (SELECT ticker, period_end, sum(rev)::DOUBLE AS revenue, sum(cost)::DOUBLE AS net_income, sum(du)::DOUBLE AS duty, sum(qty)::DOUBLE AS shares, sum(cost)::DOUBLE / sum(qty)::DOUBLE AS eps FROM q GROUP BY 1, 2),
filings AS (SELECT ticker, CAST(period_end + INTERVAL 45 DAY AS DATE) AS filed, period_end, revenue, net_income, eps, shares, 100 * net_income / revenue AS net_margin, 100 * (net_income + duty) / revenue AS op_margin, 100 * (2 * net_income + duty) / revenue AS gross_margin, 100 * duty / revenue AS fcf_margin,
  3 * revenue AS assets, net_income / (revenue / 2) * 100 AS roe, net_income / (3 * revenue) * 100 AS roa, net_income + 2 * duty AS ebitda, revenue / 4 - 100 * shares AS net_debt, (net_income + duty) / (revenue / 100) AS interest_cover,
  CASE WHEN quarter(period_end) % 2 = 0 THEN eps * 0.95::DOUBLE END AS prior_eps, CASE WHEN quarter(period_end) = 4 THEN shares * 1.02::DOUBLE END AS prior_shares FROM qs)""",
    "spans": "spans AS (SELECT 'S' || s_suppkey AS ticker, make_date(1995 + s_suppkey % 4, 1, 1) AS start_date, CASE WHEN s_suppkey % 3 = 0 THEN DATE '2000-01-01' END AS end_date FROM supplier)",
    "sectors": "sectors AS (SELECT 'S' || s_suppkey AS ticker, n_name AS sector, r_name AS market, (s_suppkey % 3)::INT AS class FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "journal": """days AS (SELECT CAST(ts AS DATE) AS day, 'U' || user_id AS ticker, sum(CAST(value AS DECIMAL(18,6)))::DOUBLE AS px FROM events GROUP BY 1, 2),
journal AS (SELECT day, CAST(rank AS INT) AS rank, ticker, px FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY px DESC, ticker) AS rank FROM days) WHERE rank <= 20)""",
}


def with_views(names: str, body: str) -> str:
    """SQL with the named views in front of ``body``; ``body`` may go on with further expressions after a comma."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + body
