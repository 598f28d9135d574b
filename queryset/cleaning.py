"""Reading, cleaning, classification and reshaping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queryset.registry import query
from queryset.views import DEATHS, SEGMENTS
from strataguild.functions import classify as C
from strataguild.functions import nulls, scalar
from strataguild.operators import reshape, rows
from strataguild.session import checkpoint_folder
from strataguild.sources import files
from strataguild.sources.dimensions import lookup


def scratch(t, name: str) -> str:
    """A new folder beside the shared checkpoints."""
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "csv_clean",
    "part_key:i part_name:s name_number:d part_type:s size:i retail_price:d",
    """SELECT p_partkey AS part_key, nullif(nullif(p_name, 'red widget'), 'old rod') AS part_name,
       TRY_CAST(p_name AS DOUBLE) AS name_number, nullif(p_type, 'PROMO') AS part_type, p_size AS size,
       p_retailprice AS retail_price FROM part""",
)
def csv_clean(t):
    """Written as delimited text, read back with null tokens, trimming and junk numbers."""
    path = scratch(t, "csv")
    padded = t.part.select(
        "p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")), "p_name", "p_type", "p_size", "p_retailprice"
    )
    files.write_csv(padded, path)
    columns = [
        ("Part Key", "bigint"),
        ("Part.Name", "string"),
        ("name number", "double"),
        ("PART_TYPE", "string"),
        ("Size", "int"),
        ("Retail..Price.", "double"),
    ]
    return files.read_csv(t.spark, path, columns, na=("", "NA", "red widget", "old rod", "PROMO"))


@query(
    "stage_round_trip",
    "p_type:s p_brand:s n:i price:d",
    "SELECT p_type, p_brand, count(*) AS n, avg(p_retailprice) AS price FROM part GROUP BY ALL",
)
def stage_round_trip(t):
    """Hand-off table written to Parquet by statistic and read back."""
    path = scratch(t, "stage")
    per_brand = t.part.groupBy("p_type", "p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("price")
    )
    files.write_stage(per_brand, path, ["p_type"])
    return files.read_traits(t.spark, path)


@query(
    "parse_number",
    "c_custkey:i number:d from_segment:d",
    r"""SELECT c_custkey, TRY_CAST(regexp_extract(c_name || ' cm', '(-?[0-9]+\.?[0-9]*)', 1) AS DOUBLE) AS number,
        TRY_CAST(regexp_extract(c_mktsegment, '(-?[0-9]+\.?[0-9]*)', 1) AS DOUBLE) AS from_segment FROM customer""",
)
def parse_number(t):
    return t.customer.select(
        "c_custkey",
        scalar.parse_number(F.concat("c_name", F.lit(" cm"))).alias("number"),
        scalar.parse_number(F.col("c_mktsegment")).alias("from_segment"),
    )


RULES = (("herbivore", "small|new"), ("carnivore", "large|old"), ("invertivore", "hot|cold"))
DIET = "CASE WHEN p_size > 45 THEN NULL ELSE upper(p_name) END"


def text_sql(omni: bool) -> str:
    hit = lambda pat: f"coalesce(regexp_matches(diet, '{pat}', 'i'), false)"
    several = " + ".join(f"CAST({hit(p)} AS INTEGER)" for _, p in RULES) + " > 1"
    if omni:
        several = f"{hit('gizmo')} OR {several}"
    cases = " ".join(f"WHEN {hit(p)} THEN '{label}'" for label, p in RULES)
    return f"CASE WHEN {several} THEN 'omnivore' {cases} ELSE 'herbivore' END"


@query(
    "classify_regex",
    "p_partkey:i with_text:s count_only:s",
    f"SELECT p_partkey, {text_sql(True)} AS with_text, {text_sql(False)} AS count_only FROM (SELECT *, {DIET} AS diet FROM part)",
)
def classify_regex(t):
    diet = F.col("diet")
    return t.part.withColumn("diet", F.expr(DIET)).select(
        "p_partkey",
        C.by_text(diet, RULES, "gizmo").alias("with_text"),
        C.by_text(diet, RULES).alias("count_only"),
    )


@query(
    "classify_share",
    "o_custkey:i guild:s",
    """SELECT o_custkey, CASE WHEN greatest(plant, inv, vert) <= 50 THEN 'omnivore' WHEN plant = greatest(plant, inv, vert) THEN 'herbivore'
         WHEN inv = greatest(plant, inv, vert) THEN 'invertivore' ELSE 'carnivore' END AS guild FROM (
       SELECT o_custkey, 100 * sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice ELSE 0 END) / sum(o_totalprice) AS plant,
         100 * sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice ELSE 0 END) / sum(o_totalprice) AS inv,
         100 * sum(CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN o_totalprice ELSE 0 END) / sum(o_totalprice) AS vert
       FROM orders GROUP BY o_custkey)""",
)
def classify_share(t):
    share = lambda *p: (
        100 * F.sum(F.when(F.col("o_orderpriority").isin(*p), F.col("o_totalprice")).otherwise(0.0)) / F.sum("o_totalprice")
    )
    shares = t.orders.groupBy("o_custkey").agg(
        share("1-URGENT", "2-HIGH").alias("plant"),
        share("3-MEDIUM").alias("inv"),
        share("4-NOT SPECIFIED", "5-LOW").alias("vert"),
    )
    guild = C.by_share({"herbivore": F.col("plant"), "invertivore": F.col("inv"), "carnivore": F.col("vert")})
    return shares.select("o_custkey", guild.alias("guild"))


FLAG_WORDS = ("small", "large", "hot", "cold", "old", "new", "red", "blue")
FLAGS = ", ".join(
    f"CASE WHEN p_size > {40 + i} THEN NULL WHEN p_name LIKE '%{w}%' THEN 1 ELSE 0 END AS f_{w}"
    for i, w in enumerate(FLAG_WORDS)
)


def flag_guild(p: str, i: str, v: str) -> str:
    return f"""CASE WHEN {p} + {i} + {v} > 1 THEN 'omnivore' WHEN {p} + {i} + {v} > 0 THEN
      CASE WHEN {p} >= {i} AND {p} >= {v} THEN 'herbivore' WHEN {i} >= {v} THEN 'invertivore' ELSE 'carnivore' END END"""


@query(
    "classify_flags",
    "p_partkey:i amphibian:s reptile:s",
    f"""SELECT p_partkey, {flag_guild('ap', 'ai', 'av')} AS amphibian, {flag_guild('rp', 'ri', 'rv')} AS reptile FROM (
      SELECT p_partkey, coalesce(least(f_small, f_large), 0) AS ap, coalesce(f_hot, 0) AS ai, coalesce(f_cold, 0) AS av,
        greatest(f_small, f_large, f_hot) AS rp, CASE WHEN f_cold IS NOT NULL AND f_old IS NOT NULL THEN greatest(f_cold, f_old) END AS ri,
        CASE WHEN f_new IS NOT NULL AND f_red IS NOT NULL AND f_blue IS NOT NULL THEN greatest(f_new, f_red, f_blue) END AS rv
      FROM (SELECT p_partkey, {FLAGS} FROM part))""",
)
def classify_flags(t):
    c = {w: F.col(f"f_{w}") for w in FLAG_WORDS}
    zero = lambda col: F.coalesce(col, F.lit(0))
    flagged = t.part.select("p_partkey", *[F.expr(f) for f in FLAGS.split(", ")])
    amphibian = {
        "herbivore": zero(C.plant_flag_all([c["small"], c["large"]])),
        "invertivore": zero(c["hot"]),
        "carnivore": zero(c["cold"]),
    }
    reptile = {
        "herbivore": C.flag_any([c["small"], c["large"], c["hot"]], skip_null=True),
        "invertivore": C.flag_any([c["cold"], c["old"]], skip_null=False),
        "carnivore": C.flag_any([c["new"], c["red"], c["blue"]], skip_null=False),
    }
    return flagged.select("p_partkey", C.by_flags(amphibian).alias("amphibian"), C.by_flags(reptile).alias("reptile"))


@query(
    "classify_map",
    "p_partkey:i guild:s",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'herbivore' WHEN 'SMALL' THEN 'planktivore' WHEN 'MEDIUM' THEN 'omnivore'
       WHEN 'STANDARD' THEN 'omnivore' WHEN 'LARGE' THEN 'higher carnivore' END AS guild FROM part""",
)
def classify_map(t):
    mapping = {
        "ECONOMY": "herbivore",
        "SMALL": "planktivore",
        "MEDIUM": "omnivore",
        "STANDARD": "omnivore",
        "LARGE": "higher carnivore",
    }
    return t.part.select("p_partkey", C.by_map(F.col("p_type"), mapping).alias("guild"))


@query(
    "last_occurrence",
    "o_orderkey:i lad:d",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 1000 END AS lad FROM orders""",
)
def last_occurrence(t):
    age = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string"))
    return t.orders.select("o_orderkey", C.last_occurrence(F.col("o_orderstatus"), age, ["O"]).alias("lad"))


@query(
    "scalar_functions",
    "c_custkey:i whole:i ln_bal:d log10_bal:d up:i root:d pct:d pmin:d pmax:d total:d biggest:s kept:s label:s closed_right:s closed_left:s mark:s",
    """SELECT c_custkey, trunc(c_acctbal / 7) AS whole, CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END AS ln_bal,
       log10(abs(c_acctbal) + 1) AS log10_bal, ceil(c_acctbal) AS up, sqrt(abs(c_acctbal)) AS root,
       (c_acctbal - 500) / 500 * 100 AS pct, least(c_acctbal, 1000, bal) AS pmin,
       CASE WHEN bal IS NOT NULL THEN greatest(c_acctbal, 1000, bal) END AS pmax, c_acctbal + coalesce(bal, 0) AS total,
       CASE WHEN c_acctbal >= c_nationkey * 300 THEN 'balance' ELSE 'nation' END AS biggest,
       coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS kept,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'TOOLS' WHEN 'FURNITURE' THEN 'HOUSEHOLD' ELSE c_mktsegment END AS label,
       CASE WHEN n > 0 AND n <= 5 THEN 'low' WHEN n > 5 AND n <= 10 THEN 'mid' WHEN n > 10 AND n <= 20 THEN 'high' END AS closed_right,
       CASE WHEN n >= 0 AND n < 5 THEN 'low' WHEN n >= 5 AND n < 10 THEN 'mid' WHEN n >= 10 AND n < 20 THEN 'high' END AS closed_left,
       CASE WHEN abs(c_acctbal) / 1e5 <= 0.001 THEN '***' WHEN abs(c_acctbal) / 1e5 <= 0.01 THEN '**'
         WHEN abs(c_acctbal) / 1e5 <= 0.05 THEN '*' WHEN abs(c_acctbal) / 1e5 <= 0.1 THEN '.' ELSE ' ' END AS mark
       FROM (SELECT *, c_nationkey AS n, CASE WHEN c_acctbal < 9000 THEN c_acctbal * 2 END AS bal FROM customer)""",
)
def scalar_functions(t):
    bal, acct, n = F.col("bal"), F.col("c_acctbal"), F.col("c_nationkey")
    bounds = [("low", 0.0, 5.0), ("mid", 5.0, 10.0), ("high", 10.0, 20.0)]
    return t.customer.withColumn("bal", F.when(acct < 9000, acct * 2)).select(
        "c_custkey",
        scalar.trunc(acct / 7).alias("whole"),
        scalar.positive_ln(acct).alias("ln_bal"),
        F.log10(F.abs(acct) + 1).alias("log10_bal"),
        F.ceil(acct).alias("up"),
        F.sqrt(F.abs(acct)).alias("root"),
        scalar.percent_change(acct, F.lit(500.0)).alias("pct"),
        scalar.row_min([acct, F.lit(1000.0), bal], skip_null=True).alias("pmin"),
        scalar.row_max([acct, F.lit(1000.0), bal]).alias("pmax"),
        scalar.row_sum([acct, bal], skip_null=True).alias("total"),
        scalar.row_arg_max([acct, n * 300], ["balance", "nation"]).alias("biggest"),
        scalar.override(F.col("c_mktsegment"), F.lit("none"), "BUILDING").alias("kept"),
        scalar.recode(F.col("c_mktsegment"), {"MACHINERY": "TOOLS", "FURNITURE": "HOUSEHOLD"}).alias("label"),
        scalar.interval_label(n, bounds, "right").alias("closed_right"),
        scalar.interval_label(n, bounds, "left").alias("closed_left"),
        scalar.stars(F.abs(acct) / 1e5).alias("mark"),
    )


@query(
    "clean_filters",
    "p_partkey:i p_name:s p_type:s size:i big:b label:s",
    """SELECT p_partkey, p_name, p_type, coalesce(small_size, 0) AS size, coalesce(small_size > 20, false) AS big, p_type || ' ' || p_brand AS label
       FROM (SELECT *, CASE WHEN p_size <= 40 THEN p_size END AS small_size FROM part)
       WHERE NOT coalesce(regexp_matches(p_name, '^red gear$|gizmo|NA', 'i'), false) AND p_type NOT IN ('PROMO')
         AND (p_retailprice > 950 OR small_size IS NULL)""",
)
def clean_filters(t):
    """Regex exclusion, set exclusion, null tests, null filling, selection and pasting."""
    sized = t.part.withColumn("small_size", F.when(F.col("p_size") <= 40, F.col("p_size")))
    kept = sized.where(
        ~nulls.matches(F.col("p_name"), "^red gear$|gizmo|NA")
        & nulls.not_in_set(F.col("p_type"), ["PROMO"])
        & ((F.col("p_retailprice") > 950) | F.col("small_size").isNull())
    )
    out = kept.withColumns(
        {
            "big": F.coalesce(F.col("small_size") > 20, F.lit(False)),
            "label": F.concat_ws(" ", "p_type", "p_brand"),
        }
    ).fillna({"small_size": 0})
    return rows.pick(out, "p_partkey", "p_name", "p_type", "big", "label", rename={"size": "small_size"})


@query(
    "column_picks",
    "p_partkey:i p_brand:s p_type:s p_size:i price:d",
    "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice AS price FROM part",
)
def column_picks(t):
    return rows.pick(t.part, "p_partkey", span=("p_brand", "p_size"), prefixes=("p_t",), rename={"price": "p_retailprice"})


@query(
    "drop_incomplete",
    "o_orderkey:i status:s",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders WHERE o_orderstatus <> 'P'",
)
def drop_incomplete(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")).dropna(
        subset=["status"]
    )


@query(
    "distinct_rows",
    "l_partkey:i l_returnflag:s l_linestatus:s",
    "SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem",
)
def distinct_rows(t):
    return t.lineitem.select("l_partkey", "l_returnflag", "l_linestatus").dropDuplicates()


@query(
    "first_row_per_key",
    "l_partkey:i l_orderkey:i l_linenumber:i l_suppkey:i l_extendedprice:d",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey,
       l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""",
)
def first_row_per_key(t):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
    return rows.first_per_key(t.lineitem, ["l_partkey"], order)


@query(
    "arranged",
    "c_mktsegment:s c_custkey:i",
    "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment, c_custkey",
)
def arranged(t):
    return rows.arrange(t.customer, "c_mktsegment", "c_custkey")


@query(
    "unpivot_pivot_totals",
    "label:s " + " ".join(f"{s}:d" for s in SEGMENTS),
    "SELECT * FROM wide UNION ALL SELECT '# Significant', "
    + ", ".join(f"sum(CASE WHEN \"{s}\" < 0.05 THEN 1 ELSE 0 END)" for s in SEGMENTS)
    + " FROM wide",
    "wide AS (SELECT 'NATION ' || c_nationkey AS label, "
    + ", ".join(f"avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) FILTER (c_mktsegment = '{s}') AS \"{s}\"" for s in SEGMENTS)
    + " FROM customer GROUP BY 1)",
)
def unpivot_pivot_totals(t):
    """Wide to long with a prefix stripped, back to wide, and the count row."""
    per = [
        F.avg(F.when(F.col("c_mktsegment") == s, F.when(F.col("c_acctbal") < 0, 1.0).otherwise(0.0))).alias(f"cat_{s}")
        for s in SEGMENTS
    ]
    wide = t.customer.groupBy(F.concat(F.lit("NATION "), F.col("c_nationkey")).alias("label")).agg(*per)
    long = reshape.to_long(wide, ["label"], [f"cat_{s}" for s in SEGMENTS], "segment", "share", "cat_")
    back = reshape.to_wide(long, ["label"], "segment", "share", SEGMENTS)
    return reshape.add_count_row(back, "label", list(SEGMENTS))


@query(
    "events_from_matrix",
    "run:i name:i t:d death_year:i",
    "SELECT run, name, t, death_year FROM deaths",
    DEATHS,
)
def events_from_matrix(t):
    """One time column per run, turned into long events; missing cells are survivors."""
    runs = sorted(r["run"] for r in t.runs().collect())  # one column each, so their number is that of a table's columns
    cells = [F.min(F.when(F.col("run") == i, F.col("t"))).alias(f"sim_{i}") for i in runs]
    matrix = t.deaths().groupBy("name").agg(*cells)
    return reshape.events_from_matrix(matrix, "name", [f"sim_{i}" for i in runs])


@query(
    "stacked_sources",
    "source:s key:i status:s balance:d",
    """SELECT 'order' AS source, o_orderkey AS key, o_orderstatus AS status, NULL AS balance FROM orders
       UNION ALL SELECT 'customer', c_custkey, NULL, c_acctbal FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, NULL, s_acctbal FROM supplier""",
)
def stacked_sources(t):
    """Tagged union of equal columns, then a union in which columns are missing."""
    people = reshape.stack_sources(
        [
            ("customer", t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))),
            ("supplier", t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))),
        ]
    )
    orders = t.orders.select(
        F.lit("order").alias("source"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")
    )
    return reshape.stack_loose(orders, people)


@query(
    "lookup_labels",
    "n_name:s r_name:s abbr:s",
    "SELECT n_name, r_name, CASE r_name WHEN 'AFRICA' THEN 'AF' WHEN 'ASIA' THEN 'AS' END AS abbr FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def lookup_labels(t):
    from strataguild.operators.joins import lookup_join

    key = lookup(t.spark, [("AFRICA", "AF"), ("ASIA", "AS")], "r_name string, abbr string")
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return lookup_join(named, key, "r_name")
