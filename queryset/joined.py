"""Joins: enrichment, lookups, full, semi, anti, and interval overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryset.registry import query
from queryset.views import DEATHS, END, QUARTERS, SPANS, YEARS
from strataguild.functions.scalar import interval_label, override
from strataguild.operators import joins as J
from strataguild.operators.summaries import group_counts


@query(
    "left_enrich",
    "c_custkey:i c_name:s o_orderkey:i status:s",
    """SELECT c_custkey, c_name, o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'none') AS status
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
)
def left_enrich(t):
    """Left join on keys of different names; a customer may meet many orders or none."""
    both = J.enrich(t.customer, t.orders, "c_custkey", "o_custkey", "tax_")
    return both.select(
        "c_custkey",
        "c_name",
        F.col("tax_o_orderkey").alias("o_orderkey"),
        override(F.col("tax_o_orderstatus"), F.lit("none"), "P").alias("status"),
    )


@query(
    "full_join",
    "part:i supplies:i size:i",
    """SELECT coalesce(a.part, b.part) AS part, supplies, size FROM
       (SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS supplies FROM lineitem GROUP BY 1) a
       FULL JOIN (SELECT p_partkey AS part, p_size AS size FROM part) b ON a.part = b.part""",
)
def full_join(t):
    a = t.lineitem.groupBy(F.col("l_partkey").alias("part")).agg(
        F.countDistinct("l_suppkey").alias("supplies")
    )
    b = t.part.select(F.col("p_partkey").alias("part"), F.col("p_size").alias("size"))
    return J.same_keys(a, b, ["part"], "full")


@query(
    "null_keys_meet",
    "segment:s n:i mean:d",
    """SELECT a.segment, n, mean FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS segment, count(*) AS n FROM customer GROUP BY 1) a
       JOIN (SELECT nullif(c_mktsegment, 'BUILDING') AS segment, avg(c_acctbal) AS mean FROM customer GROUP BY 1) b
       ON a.segment IS NOT DISTINCT FROM b.segment""",
)
def null_keys_meet(t):
    rows = t.customer.withColumn("segment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return J.same_keys(
        group_counts(rows, ["segment"]), rows.groupBy("segment").agg(F.avg("c_acctbal").alias("mean")), ["segment"]
    )


@query(
    "semi",
    "c_custkey:i c_acctbal:d",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def semi(t):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return J.present_only(t.customer, urgent, ["c_custkey"])


@query(
    "survivors_per_run",
    "run:i name:i guild:s",
    "SELECT run, pool.name, guild FROM runs CROSS JOIN pool WHERE NOT EXISTS (SELECT 1 FROM deaths d WHERE d.run = runs.run AND d.name = pool.name)",
    DEATHS,
)
def survivors_per_run(t):
    return J.survivors(J.per_run(t.pool(), t.runs()), t.deaths())


@query(
    "alive_in_year",
    "name:i guild:s",
    "SELECT name, guild FROM pool WHERE name NOT IN (SELECT name FROM deaths WHERE run = 3 AND death_year <= 10)",
    DEATHS,
)
def alive_in_year(t):
    """One simulated run: names alive after its tenth year."""
    return J.alive_in_year(t.pool(), t.deaths().where(F.col("run") == 3), 10)


@query(
    "alive_every_year",
    "run:i guild:s year:i n:i mean:d",
    f"""SELECT runs.run, guild, year, count(*) AS n, avg(value) AS mean FROM runs CROSS JOIN pool CROSS JOIN generate_series(0, {YEARS}) AS y(year)
        LEFT JOIN deaths d ON d.run = runs.run AND d.name = pool.name WHERE d.death_year IS NULL OR d.death_year > year GROUP BY ALL""",
    DEATHS,
)
def alive_every_year(t):
    """Survivors of every run and year, from one table of changes."""
    return J.alive_by_year(t.pool(), t.deaths(), t.runs(), YEARS)


OVERLAP = "name:i guild:s bin_num:i interval:s"


@query(
    "interval_overlap_open",
    OVERLAP,
    "SELECT * FROM spans JOIN quarters ON lad < hi AND fad > lo",
    f"{SPANS}, {QUARTERS}",
)
def interval_overlap_open(t):
    return J.overlap_join(t.spans(), t.quarters())


@query(
    "interval_overlap_closed",
    OVERLAP,
    "SELECT * FROM spans JOIN quarters ON lad <= hi AND fad >= lo",
    f"{SPANS}, {QUARTERS}",
)
def interval_overlap_closed(t):
    return J.overlap_join(t.spans(), t.quarters(), closed=True)


@query(
    "interval_overlap_cells",
    "day:s n:i",
    f"""SELECT day, count(*) AS n FROM (SELECT l_partkey, l_suppkey,
          date_diff('day', CAST(min(l_shipdate) AS DATE), DATE '{END}') AS fad,
          date_diff('day', CAST(max(l_shipdate) AS DATE), DATE '{END}') AS lad FROM lineitem GROUP BY ALL) s
        JOIN (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, date_diff('day', CAST(o_orderdate AS DATE), DATE '{END}') AS hi,
          date_diff('day', CAST(o_orderdate AS DATE), DATE '{END}') - 1 AS lo FROM orders) i
        ON lad < hi AND fad > lo GROUP BY day""",
)
def interval_overlap_cells(t):
    """Spans against every order day."""
    age = lambda c: F.datediff(F.lit(END).cast("date"), c.cast("date")).cast("double")
    spans = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(
        age(F.min("l_shipdate")).alias("fad"), age(F.max("l_shipdate")).alias("lad")
    )
    days = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), age(F.col("o_orderdate")).alias("hi"))
    days = days.distinct().withColumn("lo", F.col("hi") - 1)
    return group_counts(J.overlap_join(spans, days), ["day"])


@query(
    "cut_labels",
    "name:i fad_interval:s lad_interval:s",
    """SELECT * FROM (SELECT name,
         CASE WHEN fad > 0 AND fad <= 2 THEN 'late' WHEN fad > 2 AND fad <= 4 THEN 'middle' WHEN fad > 4 AND fad <= 6.5 THEN 'early' END AS fad_interval,
         CASE WHEN lad >= 0 AND lad < 2 THEN 'late' WHEN lad >= 2 AND lad < 4 THEN 'middle' WHEN lad >= 4 AND lad < 6.5 THEN 'early' END AS lad_interval
       FROM spans) WHERE fad_interval IS NOT NULL AND lad_interval IS NOT NULL""",
    SPANS,
)
def cut_labels(t):
    bounds = [("late", 0.0, 2.0), ("middle", 2.0, 4.0), ("early", 4.0, 6.5)]
    labelled = t.spans().select(
        "name",
        interval_label(F.col("fad"), bounds, "right").alias("fad_interval"),
        interval_label(F.col("lad"), bounds, "left").alias("lad_interval"),
    )
    return labelled.dropna()
