"""Counts, quantiles, ranges and other grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryset.registry import query
from queryset.views import GUILDS, TRAITS, five
from strataguild.operators import density as kde
from strataguild.operators import quantiles as Q
from strataguild.operators import summaries as S
from strataguild.plans import fossil, living

RG = ["region", "guild"]
FIVE = "region:s guild:s n:i q0:d q25:d q50:d q75:d q100:d"


@query("guild_counts", "region:s guild:s n:i", "SELECT region, guild, count(*) AS n FROM traits GROUP BY ALL", TRAITS)
def guild_counts(t):
    return S.group_counts(t.traits(), RG)


@query(
    "group_size_on_rows",
    "region:s guild:s species:i size:i",
    """SELECT DISTINCT region, guild, species, count(*) OVER (PARTITION BY region, guild) AS size FROM traits""",
    TRAITS,
)
def group_size_on_rows(t):
    sized = S.with_group_size(t.traits().select("region", "guild", "species"), RG, "size")
    return sized.dropDuplicates()


@query("five_number", FIVE, f"SELECT region, guild, count(*) AS n, {five('mass')} FROM traits GROUP BY ALL", TRAITS)
def five_number(t):
    return Q.five_number(t.traits(), RG, "mass")


@query(
    "five_number_one_pass", FIVE, f"SELECT region, guild, count(*) AS n, {five('mass')} FROM traits GROUP BY ALL", TRAITS
)
def five_number_one_pass(t):
    return Q.five_number(t.traits(), RG, "mass", method="histogram")


BOX = """hinges AS (SELECT region, guild, count(*) AS n, quantile_cont(mass, 0.25) AS lower, quantile_cont(mass, 0.5) AS middle,
  quantile_cont(mass, 0.75) AS upper FROM traits GROUP BY ALL),
fenced AS (SELECT t.*, n, lower, middle, upper,
  mass BETWEEN lower - 1.5::DOUBLE * (upper - lower) AND upper + 1.5::DOUBLE * (upper - lower) AS inside
  FROM traits t JOIN hinges USING (region, guild))"""


@query(
    "boxplot_stats",
    "region:s guild:s n:i lower:d middle:d upper:d ymin:d ymax:d n_outliers:i",
    """SELECT region, guild, any_value(n) AS n, any_value(lower) AS lower, any_value(middle) AS middle,
       any_value(upper) AS upper, min(mass) FILTER (inside) AS ymin, max(mass) FILTER (inside) AS ymax,
       count(*) FILTER (NOT inside) AS n_outliers FROM fenced GROUP BY ALL""",
    f"{TRAITS}, {BOX}",
)
def boxplot_stats(t):
    return Q.boxplot_stats(t.traits(), RG, "mass")[0]


@query(
    "boxplot_outliers",
    "region:s guild:s species:i mass:d",
    "SELECT region, guild, species, mass FROM fenced WHERE NOT inside",
    f"{TRAITS}, {BOX}",
)
def boxplot_outliers(t):
    return Q.boxplot_stats(t.traits().select(*RG, "species", "mass"), RG, "mass")[1]


@query(
    "range_summary",
    "guild:s region:s min_size:d which_min:i max_size:d which_max:i med_size:d",
    """SELECT guild, region, min(mass) AS min_size, arg_min(species, (mass, species)) AS which_min, max(mass) AS max_size,
       arg_min(species, (-mass, species)) AS which_max, median(mass) AS med_size FROM traits GROUP BY ALL""",
    TRAITS,
)
def range_summary(t):
    return S.range_summary(t.traits(), ["guild", "region"], "mass", "species")


# Stand-in for periods and continents: years of shipping and regions.
PERIOD = "CASE WHEN year <= 1997 THEN 'Pleistocene' WHEN year <= 1999 THEN 'Holocene' WHEN year = 2000 THEN 'Modern' ELSE 'Future' END"
CONTINENT = """CASE region WHEN 'AFRICA' THEN 'AF' WHEN 'AMERICA' THEN 'NA' WHEN 'ASIA' THEN 'EA' WHEN 'EUROPE' THEN 'SA'
  ELSE 'Insular' END"""
RANGES = f"""ranges AS (
  SELECT guild, {PERIOD} AS bin, {CONTINENT} AS continent, min(mass) AS min_size, max(mass) AS max_size, median(mass) AS med_size
  FROM traits GROUP BY ALL)"""
CONTRAST = """min(min_size) AS minimum, max(max_size) AS maximum, (max(max_size) + min(min_size)) / 2 AS avg,
  max(med_size) AS med, max(med_size) FILTER (bin = 'Modern') AS extant_med, max(med_size) FILTER (bin = 'Future') AS future_med,
  max(max_size) FILTER (bin = 'Modern') AS extant_max, max(max_size) FILTER (bin = 'Future') AS future_max"""


def ranges(t):
    rows = t.traits().select(
        "guild",
        F.expr(PERIOD).alias("bin"),
        F.expr(CONTINENT).alias("continent"),
        F.col("mass").alias("value"),
        F.col("species").alias("name"),
    )
    return fossil.size_ranges(rows, ("guild", "bin", "continent"))


@query(
    "guild_contrasts",
    "guild:s minimum:d maximum:d avg:d med:d extant_med:d future_med:d extant_max:d future_max:d",
    f"SELECT guild, {CONTRAST} FROM ranges GROUP BY guild",
    f"{TRAITS}, {RANGES}",
)
def guild_contrasts(t):
    return S.period_contrasts(ranges(t), ["guild"])


RATES = f"""stats AS (SELECT guild, continent, {CONTRAST} FROM ranges WHERE continent <> 'Insular' GROUP BY ALL),
long AS (SELECT guild, continent, 'pleis' AS time, extant_med - med AS diff FROM stats
  UNION ALL SELECT guild, continent, 'future', future_med - extant_med FROM stats),
timed AS (SELECT *, CASE WHEN time = 'future' THEN 500.0 WHEN continent = 'AF' THEN 11500.0 WHEN continent = 'AUS' THEN 40000.0
  WHEN continent = 'EA' THEN 38500.0 WHEN continent = 'NA' THEN 2000.0 WHEN continent = 'SA' THEN 6500.0 END::DOUBLE AS length FROM long),
rated AS (SELECT *, diff / length AS rate, diff / length - (SELECT min(diff / length) FROM timed) AS corr_rate FROM timed),
shift AS (SELECT trunc(log10(min(corr_rate))) AS c FROM rated WHERE corr_rate > 0)"""


@query(
    "rates_of_change",
    "guild:s continent:s time:s diff:d length:d rate:p corr_rate:p log_corr_rate:d",
    "SELECT *, log10(corr_rate + pow(10.0::DOUBLE, c)) - c AS log_corr_rate FROM rated, shift",
    f"{TRAITS}, {RANGES}, {RATES}",
)
def rates_of_change(t):
    return fossil.rates_of_change(ranges(t))


# Four of the six labels read as guilds; rates are per year, so they are shown in millionths.
AS_GUILD = """CASE guild WHEN 'ECONOMY' THEN 'herbivore' WHEN 'SMALL' THEN 'omnivore' WHEN 'MEDIUM' THEN 'invertivore'
  WHEN 'LARGE' THEN 'carnivore' ELSE 'none' END"""
LIMITS = f"""pts AS (SELECT {AS_GUILD} AS guild, log10(length) AS x, rate * 1000000 AS y FROM rated
    WHERE time = 'pleis' AND guild IN ('ECONOMY', 'SMALL', 'MEDIUM', 'LARGE')),
  lines AS (SELECT DISTINCT a.guild, (a.y - (b.y - a.y) / (b.x - a.x) * a.x) AS a, (b.y - a.y) / (b.x - a.x) AS b
    FROM pts a JOIN pts b ON a.guild = b.guild AND a.x < b.x),
  scored AS (SELECT l.guild, tau, l.a, l.b, round(sum((y - l.a - l.b * x) * (CASE WHEN y - l.a - l.b * x >= -1e-9 THEN tau ELSE tau - 1 END)), 9) AS loss
    FROM lines l JOIN pts USING (guild) CROSS JOIN (VALUES (0.025::DOUBLE), (0.975::DOUBLE)) AS k(tau) GROUP BY ALL)"""


@query(
    "rate_limits",
    "guild:s tau:c intercept:c slope:c loss:c",
    """SELECT guild, tau, arg_min(a, (loss, b)) AS intercept, arg_min(b, (loss, b)) AS slope, min(loss) AS loss
       FROM scored GROUP BY guild, tau""",
    f"{TRAITS}, {RANGES}, {RATES}, {LIMITS}",
)
def rate_limits(t):
    """Quantile lines of past rates on log event length, per guild."""
    rates = fossil.rates_of_change(ranges(t)).withColumn("guild", F.expr(AS_GUILD))
    lines = fossil.rate_limits(rates)
    return lines.withColumns({c: F.col(c) * 1e6 for c in ("intercept", "slope", "loss")})


@query(
    "trimmed_means",
    "guild:s trim:c trimmed_mean:d",
    """SELECT guild, trim, CASE WHEN trim >= 0.5 THEN med ELSE kept END AS trimmed_mean FROM (
         SELECT guild, trim, max(med) AS med,
                avg(mass) FILTER (rn > floor(n * trim) AND rn <= n - floor(n * trim)) AS kept
         FROM (SELECT guild, mass, row_number() OVER (PARTITION BY guild ORDER BY mass) AS rn,
                      count(*) OVER (PARTITION BY guild) AS n, median(mass) OVER (PARTITION BY guild) AS med FROM traits) r,
              (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) AS k(trim) GROUP BY guild, trim)""",
    TRAITS,
)
def trimmed_means(t):
    parts = [
        Q.trimmed_mean(t.traits(), ["guild"], "mass", trim).withColumn("trim", F.lit(trim))
        for trim in (0.0, 0.05, 0.25, 0.5)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "central_interval",
    "guild:s mean:d low_ci:d upp_ci:d low_ci_50:d upp_ci_50:d",
    """SELECT guild, avg(mass) AS mean, quantile_cont(mass, 0.025) AS low_ci, quantile_cont(mass, 0.975) AS upp_ci,
       quantile_cont(mass, 0.25) AS low_ci_50, quantile_cont(mass, 0.75) AS upp_ci_50 FROM traits GROUP BY guild""",
    TRAITS,
)
def central_interval(t):
    return Q.central_interval(t.traits(), ["guild"], "mass")


@query(
    "hdi",
    "guild:s low:d upp:d",
    """SELECT guild, arg_min(low, (w, low)) AS low, arg_min(upp, (w, low)) AS upp FROM (
         SELECT a.guild, a.mass AS low, b.mass AS upp, b.mass - a.mass AS w FROM ranked a JOIN ranked b
         ON a.guild = b.guild AND b.rn = a.rn + CAST(floor(a.n * 0.95::DOUBLE) AS BIGINT)) GROUP BY guild""",
    f"""{TRAITS}, ranked AS (SELECT guild, mass, row_number() OVER (PARTITION BY guild ORDER BY mass) AS rn,
        count(*) OVER (PARTITION BY guild) AS n FROM traits)""",
)
def hdi(t):
    return Q.hdi(t.traits(), ["guild"], "mass")


@query(
    "group_mean_model",
    "region:s guild:s n:i estimate:d std_error:d statistic:c low:d upp:d",
    """SELECT *, estimate / std_error AS statistic, estimate - 1.96::DOUBLE * std_error AS low, estimate + 1.96::DOUBLE * std_error AS upp
       FROM (SELECT region, guild, count(*) AS n, avg(mass) AS estimate, stddev_samp(mass) / sqrt(count(*)) AS std_error
             FROM traits GROUP BY ALL)""",
    TRAITS,
)
def group_mean_model(t):
    return S.group_mean_model(t.traits(), RG, "mass")


@query(
    "weighted_mean_var",
    "guild:s wtd_mean:d wtd_var:d",
    """SELECT guild, any_value(m) AS wtd_mean, sum(w * (avg - m) * (avg - m)) / (any_value(sw) - 1) AS wtd_var FROM (
         SELECT *, sum(w * avg) OVER (PARTITION BY guild) / sum(w) OVER (PARTITION BY guild) AS m,
                sum(w) OVER (PARTITION BY guild) AS sw
         FROM (SELECT guild, species, avg(mass) AS avg, 1 / (stddev_samp(mass) * stddev_samp(mass)) AS w FROM traits
               GROUP BY ALL HAVING stddev_samp(mass) > 0)) GROUP BY guild""",
    TRAITS,
)
def weighted_mean_var(t):
    per_species = t.traits().groupBy("guild", "species").agg(F.avg("mass").alias("avg"), F.stddev_samp("mass").alias("sd"))
    return S.weighted_mean_var(per_species, ["guild"], "avg", S.inverse_variance(F.col("sd")))


@query(
    "distinct_mean",
    "species:i guild:s year:i mass:d",
    "SELECT species, guild, year, avg(mass) AS mass FROM (SELECT DISTINCT species, guild, year, mass FROM traits) GROUP BY ALL",
    TRAITS,
)
def distinct_mean(t):
    return S.mean_of_distinct(t.traits(), ["species", "guild", "year"], "mass")


@query(
    "abs_limit",
    "limit:d",
    """SELECT greatest(abs(min(lo)), abs(max(hi))) * 1.01::DOUBLE AS "limit" FROM (
         SELECT quantile_cont(mass, 0.025) AS lo, quantile_cont(mass, 0.975) AS hi FROM traits GROUP BY region, guild)""",
    TRAITS,
)
def abs_limit(t):
    return S.abs_limit(Q.central_interval(t.traits(), RG, "mass"), "low_ci", "upp_ci")


SOURCE_ROWS = """src AS (SELECT *, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 WHEN 'R' THEN 3 END AS rank,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS place,
  CAST(l_linenumber AS VARCHAR) AS line, row_number() OVER (PARTITION BY l_partkey, l_linestatus ORDER BY
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END,
    l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem),
firsts AS (SELECT l_partkey, l_linestatus, line, min(seq) AS seq FROM src GROUP BY ALL)"""


@query(
    "merge_sources",
    "l_partkey:i l_linestatus:s l_suppkey:i line:s sources:s l_quantity:d l_discount:d l_extendedprice:d",
    """SELECT a.*, b.line FROM (
         SELECT l_partkey, l_linestatus, arg_min(l_suppkey, (rank, seq)) AS l_suppkey,
                string_agg(l_returnflag, ', ' ORDER BY seq) AS sources, max(l_quantity) AS l_quantity,
                min(l_discount) AS l_discount, avg(l_extendedprice) AS l_extendedprice FROM src GROUP BY ALL) a
       JOIN (SELECT l_partkey, l_linestatus, string_agg(line, ', ' ORDER BY seq) AS line FROM firsts GROUP BY ALL) b
       USING (l_partkey, l_linestatus)""",
    SOURCE_ROWS,
)
def merge_sources(t):
    rows = t.lineitem.withColumn("line", F.col("l_linenumber").cast("string"))
    return S.merge_duplicates(
        rows,
        ["l_partkey", "l_linestatus"],
        "l_returnflag",
        ("N", "A", "R"),
        picks=["l_suppkey"],
        row_order=["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"],
        texts=["line"],
        highest=["l_quantity"],
        lowest=["l_discount"],
        means=["l_extendedprice"],
        stack_order=("A", "N", "R"),
    )


def density_sql(by: str, where: str, n_grid: int, n_bins: int) -> tuple[str, str]:
    ctes = f"""{TRAITS}, shape AS (
      SELECT {by}, n, lo, hi, 0.9::DOUBLE * least(sd, iqr / 1.34::DOUBLE) * pow(n::DOUBLE, -0.2::DOUBLE) AS bw, (hi - lo) / {n_bins} AS step
      FROM (SELECT {by}, count(*) AS n, min(mass) AS lo, max(mass) AS hi, stddev_samp(mass) AS sd,
            quantile_cont(mass, 0.75) - quantile_cont(mass, 0.25) AS iqr FROM traits WHERE {where} GROUP BY {by})),
    bins AS (SELECT {by}, least(floor((mass - lo) / step), {n_bins - 1}) AS bin, count(*) AS c
      FROM traits JOIN shape USING ({by}) GROUP BY ALL)"""
    sql = f"""SELECT {by}, grid, any_value(lo + (hi - lo) * grid / {n_grid - 1}) AS x,
      sum(c * exp(-0.5::DOUBLE * pow((lo + (hi - lo) * grid / {n_grid - 1} - (lo + (bin + 0.5::DOUBLE) * step)) / bw, 2)))
        / (any_value(n) * any_value(bw) * 2.506628274631000502::DOUBLE) AS density
      FROM bins JOIN shape USING ({by}) CROSS JOIN generate_series(0, {n_grid - 1}) AS s(grid) GROUP BY {by}, grid"""
    return sql, ctes


@query("density_grid", "region:s grid:i x:d density:d", *density_sql("region", "true", 128, 2048))
def density_grid(t):
    return kde.density(t.traits(), "mass", ["region"], 128, 2048)


@query("size_density", "guild:s grid:i x:d density:d", *density_sql("guild", "guild IN ('SMALL', 'LARGE')", 512, 2048))
def size_density(t):
    return living.size_density(t.traits(), ("SMALL", "LARGE"), "mass")


@query(
    "resample_summary",
    "event_type:s n:i y0:d y5:d y25:d y50:d y75:d y95:d y100:d avg:d stddev:d",
    """SELECT event_type, count(*) AS n, min(value) AS y0, quantile_cont(value, 0.05) AS y5, quantile_cont(value, 0.25) AS y25,
       median(value) AS y50, quantile_cont(value, 0.75) AS y75, quantile_cont(value, 0.95) AS y95, max(value) AS y100,
       avg(value) AS avg, stddev_samp(value) AS stddev FROM events GROUP BY event_type""",
)
def resample_summary(t):
    return Q.resample_summary(t.events, ["event_type"], "value", "rescan")


@query("order_levels", "guild:s ord:i n:i", """SELECT guild, gk AS ord, count(*) AS n FROM traits GROUP BY ALL""", TRAITS)
def order_levels(t):
    from strataguild.operators.rows import with_levels

    return S.group_counts(with_levels(t.traits(), "guild", GUILDS, "ord"), ["guild", "ord"])
