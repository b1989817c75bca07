"""Generic relational plans on the star schema: grouping sets, joins, windows, pricing summary."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.plans.registry import query
from lexispark.sources.tables import table


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, folder):
    """Sums by flag and status; filter and columns reach the scan."""
    rows = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def revenue_by_nation(spark, folder):
    """Five-way join; the small dimensions are broadcast by their measured size."""
    t = lambda n: table(spark, folder, n)
    places = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))""")
def order_grouping_sets(spark, folder):
    """Totals overall, by status and by priority in one pass."""
    rows = table(spark, folder, "orders")
    sets = rows.groupingSets([[], ["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority")
    out = sets.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return out.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "total")


@query("""SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_orders(spark, folder):
    """Three largest orders of every customer."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, folder, "orders").withColumn("rank", place).where("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("""SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS k
FROM events GROUP BY ALL""")
def event_days(spark, folder):
    """Events, users and means per day and type."""
    day = F.unix_date(F.to_date("ts")).cast("long").alias("day")
    return table(spark, folder, "events").groupBy("event_type", day).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("k"),
    )
