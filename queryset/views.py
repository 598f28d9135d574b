"""The given tables, and the shapes the operators want derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataguild.functions.scalar import level_rank
from strataguild.operators.reshape import death_year
from strataguild.sources.dimensions import intervals

# Ordered labels.
GUILDS = ("ECONOMY", "SMALL", "MEDIUM", "STANDARD", "LARGE", "PROMO")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
BIOMES = tuple(f"NATION_{i}" for i in range(25))
YEARS = 500
END = "2002-01-01"


# Schemas already read from a table's footer, so that it is read once per process.
_SCHEMAS: dict[str, T.StructType] = {}


class Tables:
    """Access to one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def traits(self) -> DataFrame:
        """One measurement per row: species, guild, region, biome and ln mass."""
        # Part and supplier grow with the data, so their joins are left to the optimizer;
        # nations and regions are fixed lists of 25 and 5 rows.
        return (
            self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(F.broadcast(self.nation), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("l_partkey").alias("species"),
                F.col("p_type").alias("guild"),
                F.col("r_name").alias("region"),
                F.col("n_name").alias("biome"),
                F.ln("l_extendedprice").alias("mass"),
                F.year("l_shipdate").alias("year"),
                ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("row_id"),
                F.col("r_regionkey").alias("rk"),
                level_rank(F.col("p_type"), GUILDS).alias("gk"),
            )
        )

    def spans(self) -> DataFrame:
        """One span per customer: ages of its first and last order, in years before 2002."""
        age = lambda c: F.datediff(F.lit(END).cast("date"), c.cast("date")) / 365.25
        ends = self.orders.groupBy("o_custkey").agg(
            age(F.min("o_orderdate")).alias("fad"),
            age(F.max("o_orderdate")).alias("lad"),
            F.ln(F.sum("o_totalprice")).alias("value"),
        )
        return ends.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("guild"), "fad", "lad", "value"
        )

    def quarters(self) -> DataFrame:
        """Calendar quarters that hold orders, as age intervals."""
        start = F.trunc(F.col("o_orderdate").cast("date"), "quarter")
        age = lambda c: F.datediff(F.lit(END).cast("date"), c) / 365.25
        days = self.orders.select(start.alias("start")).distinct()
        bounds = days.select(
            F.date_format("start", "yyyy-MM").alias("interval"),
            age(F.col("start")).alias("hi"),
            age(F.add_months("start", 3)).alias("lo"),
        )
        return intervals(bounds, "interval", "hi", "lo")

    def pool(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("name"), F.col("p_type").alias("guild"), F.ln("p_retailprice").alias("value")
        )

    def deaths(self) -> DataFrame:
        """Death time of a species in a run; species without a row survive the run."""
        t = self.lineitem.groupBy(F.col("l_linenumber").alias("run"), F.col("l_partkey").alias("name")).agg(
            F.min(F.col("l_quantity") * 10 - F.col("l_discount") * 50).alias("t")
        )
        return t.withColumn("death_year", death_year(F.col("t")))

    def runs(self) -> DataFrame:
        return self.lineitem.select(F.col("l_linenumber").alias("run")).distinct()


def values(rows, names: str) -> str:
    """SQL list of literal rows as a table."""

    def lit(x):
        return "'" + x + "'" if isinstance(x, str) else str(x)

    body = ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


def levels(labels, name="label") -> str:
    return values([(x, i + 1) for i, x in enumerate(labels)], f"{name}, ord")


TRAITS = f"""traits AS (
  SELECT l_partkey AS species, p_type AS guild, r_name AS region, n_name AS biome,
         ln(l_extendedprice) AS mass, year(l_shipdate) AS year,
         (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS row_id,
         r_regionkey AS rk, lv.ord AS gk
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN {levels(GUILDS)} AS lv ON lv.label = p_type)"""

SPANS = f"""spans AS (
  SELECT c_custkey AS name, c_mktsegment AS guild, fad, lad, value FROM (
    SELECT o_custkey, date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '{END}') / 365.25::DOUBLE AS fad,
           date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '{END}') / 365.25::DOUBLE AS lad,
           ln(sum(o_totalprice)) AS value
    FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey)"""

QUARTERS = f"""quarters AS (
  SELECT *, row_number() OVER (ORDER BY lo DESC) AS bin_num FROM (
    SELECT DISTINCT strftime(date_trunc('quarter', o_orderdate), '%Y-%m') AS "interval",
      date_diff('day', CAST(date_trunc('quarter', o_orderdate) AS DATE), DATE '{END}') / 365.25::DOUBLE AS hi,
      date_diff('day', CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS DATE), DATE '{END}') / 365.25::DOUBLE AS lo
    FROM orders))"""

DEATHS = """pool AS (SELECT p_partkey AS name, p_type AS guild, ln(p_retailprice) AS value FROM part),
deaths AS (
  SELECT l_linenumber AS run, l_partkey AS name, min(l_quantity * 10 - l_discount * 50) AS t, CAST(ceil(min(l_quantity * 10 - l_discount * 50)) AS INTEGER) AS death_year
  FROM lineitem GROUP BY 1, 2),
runs AS (SELECT DISTINCT l_linenumber AS run FROM lineitem)"""


def five(value: str) -> str:
    return ", ".join(
        f"quantile_cont({value}, {p}) AS {n}"
        for n, p in (("q0", 0), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q100", 1))
    )


NUMERATOR = "0.0352624965998911 0.700383064443688 6.37396220353165 33.912866078383 112.079291497871 221.213596169931 220.206867912376"
DENOMINATOR = "0.0883883476483184 1.75566716318264 16.064177579207 86.7807322029461 296.564248779674 637.333633378831 793.826512519948 440.413735824752"


def two_sided(z: str) -> str:
    """SQL for the two-sided normal p of a column ``z``."""

    def poly(text):
        out = ""
        for c in text.split():
            out = f"{c}::DOUBLE" if not out else f"({out}*abs({z})+{c}::DOUBLE)"
        return out

    near = f"exp(-{z}*{z}/2)*{poly(NUMERATOR)}/{poly(DENOMINATOR)}"
    a = f"abs({z})"
    far = f"exp(-{z}*{z}/2)/({a}+1/({a}+2/({a}+3/({a}+4/({a}+0.65::DOUBLE)))))/2.506628274631::DOUBLE"
    return f"least(1.0::DOUBLE, 2*(CASE WHEN {a} < 7.07106781186547::DOUBLE THEN {near} ELSE {far} END))"


def pair_table(src: str, by: str, group: str, labels, adjacent: bool) -> str:
    """Label pairs compared in each partition."""
    rule = "b.ord = a.ord + 1" if adjacent else "b.ord > a.ord"
    lead = f"{by}, " if by else ""
    join = f" AND a.{by} = b.{by}" if by else ""
    dim = f"(SELECT DISTINCT {lead}{group} AS g, ord FROM {src} JOIN {levels(labels)} AS lv ON lv.label = {group})"
    return f"SELECT {('a.' + by + ', ') if by else ''}a.g AS ga, b.g AS gb FROM {dim} AS a JOIN {dim} AS b ON {rule}{join}"


def rank_sum(src: str, by: str, group: str, labels, value: str, adjacent: bool) -> str:
    """CTEs that end in ``tests``: one row per partition and pair with stat and p."""
    return f"""pairs AS ({pair_table(src, by, group, labels, adjacent)}),
hist AS (SELECT {by}, {group} AS g, {value} AS v, count(*) AS c FROM {src} GROUP BY ALL),
pv AS (SELECT pairs.{by}, ga, gb, v, sum(CASE WHEN g = ga THEN c ELSE 0 END)::DOUBLE AS ca,
       sum(CASE WHEN g = gb THEN c ELSE 0 END)::DOUBLE AS cb
       FROM hist JOIN pairs ON hist.{by} = pairs.{by} AND (g = ga OR g = gb) GROUP BY ALL),
cum AS (SELECT *, sum(cb) OVER (PARTITION BY {by}, ga, gb ORDER BY v ROWS UNBOUNDED PRECEDING) - cb AS bb FROM pv),
sums AS (SELECT {by}, ga, gb, sum(ca) AS n_a, sum(cb) AS n_b, sum(ca * (bb + cb / 2)) AS stat,
         sum((ca+cb)*(ca+cb)*(ca+cb) - (ca+cb)) AS ties FROM cum GROUP BY ALL),
zs AS (SELECT *, (stat - n_a*n_b/2 - sign(stat - n_a*n_b/2)*0.5::DOUBLE)
       / sqrt(n_a*n_b/12 * ((n_a+n_b+1) - ties/((n_a+n_b)*(n_a+n_b-1)))) AS z FROM sums),
tests AS (SELECT {by}, ga AS group_a, gb AS group_b, n_a, n_b, stat, {two_sided('z')} AS p FROM zs)"""


def exact_tests(by: str) -> str:
    """CTEs after ``rank_sum`` that end in ``exact_tests``: small untied samples get the p of the exact law.

    The law of U grows by one value at a time, from either group.
    """
    return f"""most AS (SELECT coalesce(max(greatest(n_a, n_b)), 0) AS n FROM sums WHERE ties = 0 AND n_a < 50 AND n_b < 50),
law AS (SELECT 0 AS a, 0 AS b, CAST(0 AS BIGINT) AS u, 1.0::DOUBLE AS c UNION ALL (
  SELECT a, b, u, sum(c) AS c FROM (
    SELECT a + 1 AS a, b, u + b AS u, c * (a + 1) / (a + b + 1) AS c FROM law, most WHERE a < n UNION ALL
    SELECT a, b + 1, u, c * (b + 1) / (a + b + 1) FROM law, most WHERE b < n) GROUP BY a, b, u)),
tails AS (SELECT a, b, u, sum(c) OVER (PARTITION BY a, b ORDER BY u) AS tail FROM law),
exact_tests AS (SELECT t.{by}, group_a, group_b, t.n_a, t.n_b, t.stat,
    CASE WHEN z.ties = 0 AND t.n_a < 50 AND t.n_b < 50 THEN least(1.0::DOUBLE, 2 * tail) ELSE t.p END AS p
  FROM tests t JOIN zs z ON t.{by} = z.{by} AND t.group_a = z.ga AND t.group_b = z.gb
  LEFT JOIN tails ON tails.a = t.n_a AND tails.b = t.n_b
    AND tails.u = least(CAST(round(t.stat) AS BIGINT), CAST(t.n_a * t.n_b - round(t.stat) AS BIGINT)))"""


def holm(src: str, family: str = "") -> str:
    """SELECT that adds the step-down adjusted p of each family to ``src``."""
    part = f"PARTITION BY {family} " if family else ""
    return f"""SELECT * EXCLUDE (rn, m), least(1.0::DOUBLE, max((m - rn + 1) * p) OVER ({part}ORDER BY p, rn ROWS UNBOUNDED PRECEDING)) AS p_adj
  FROM (SELECT *, row_number() OVER ({part}ORDER BY p) AS rn, count(*) OVER ({part}) AS m FROM {src})"""


def star(p: str, dot: str = ".") -> str:
    return f"""CASE WHEN {p} <= 0.001 THEN '***' WHEN {p} <= 0.01 THEN '**' WHEN {p} <= 0.05 THEN '*'
  WHEN {p} <= 0.1 THEN '{dot}' ELSE ' ' END"""


P31 = 2147483647


def mix31(cols, seed: int, out: str) -> str:
    """Select items that compute the integer mix step by step into column ``out``."""
    items, prev = [], f"CAST({seed % P31} AS BIGINT)"
    for i, c in enumerate(cols):
        a, b, d = f"{out}_{i}a", f"{out}_{i}b", f"{out}_{i}c"
        items += [
            f"({prev} * 48271 + CAST({c} AS BIGINT) % {P31} + 11) % {P31} AS {a}",
            f"({a} * {a}) % {P31} AS {b}",
            f"({b} * 69621 + 7919) % {P31} AS {d}",
        ]
        prev = d
    items += [f"({prev} * {prev}) % {P31} AS {out}_z", f"({out}_z * 16807 + 5) % {P31} AS {out}"]
    return ", ".join(items)


def draw_rank(cols, n: str, seed: int) -> str:
    return f"{mix31(cols, seed, 'hi')}, {mix31(cols, seed + 1, 'lo')}, (hi * {P31} + lo) % {n} + 1 AS rank"


def fold(state: str, key: str) -> str:
    """SQL for one more key folded into a state column."""
    x = f"(({state} * 48271 + {key} % {P31} + 11) % {P31})"
    return f"((({x} * {x}) % {P31}) * 69621 + 7919) % {P31}"


def finish(state: str) -> str:
    return f"((({state}) * ({state})) % {P31} * 16807 + 5) % {P31}"


def text_number(cols) -> str:
    """SQL for the number of text keys."""
    return f"CAST('0x' || substr(md5(concat_ws(chr(1), {', '.join(cols)})), 1, 13) AS BIGINT)"


def bootstrap_sql(by: str, key, reps: int, seed: int, positions: int, flips: int) -> str:
    """CTEs that end in ``draws``: by, n, rep, rank.

    ``ranked`` and ``sized`` come before.  ``key`` lists whole-number columns, or is SQL for one number.
    """
    cols = key if isinstance(key, list) else ["kn"]
    steps = ", ".join(mix31(cols, seed + i, s) for i, s in enumerate(("hi", "lo", "tr")))
    last = f"_{len(cols) - 1}c"
    number = "0 AS kn" if isinstance(key, list) else f"{key} AS kn"
    keyed = f"""keyed AS (SELECT {by}, n, hi{last} AS hi, lo{last} AS lo, tr{last} AS tr FROM (SELECT *, {steps} FROM (SELECT *, {number} FROM sized)))"""
    word = finish(fold("st", "w"))
    return f"""{keyed},
tree AS (
  SELECT {by}, n, hi, lo, {fold('tr', 'rep')} AS tr, CASE WHEN n <= {positions} THEN 0 ELSE length(bin((n - 1) // {positions})) END AS k, rep, 0 AS lev, CAST(1 AS BIGINT) AS node, n AS m
  FROM keyed, generate_series(1, {reps}) AS r(rep)
  UNION ALL
  SELECT {by}, n, hi, lo, tr, k, rep, lev + 1, 2 * node + side, CASE side WHEN 0 THEN ones ELSE m - ones END FROM (
    SELECT *, CAST(list_sum(list_transform(range((m + {flips - 1}) // {flips}), lambda w:
      bit_count(CAST(({word}) & (CASE WHEN (w + 1) * {flips} <= m THEN {(1 << flips) - 1} ELSE (1 << (m - w * {flips})) - 1 END) AS BIGINT)))) AS BIGINT) AS ones
    FROM (SELECT *, {fold('tr', 'node')} AS st FROM tree WHERE lev < k AND m > 0)), (VALUES (0), (1)) AS s(side)),
leaf AS (SELECT *, node - (1 << k) AS b, {fold('h1', 'node')} AS h2, {fold('l1', 'node')} AS l2 FROM (
  SELECT *, {fold('hi', 'rep')} AS h1, {fold('lo', 'rep')} AS l1 FROM tree WHERE lev = k AND m > 0)),
draws AS (SELECT {by}, n, rep, (b * n + ({finish('h3')} * {P31} + {finish('l3')}) % n) // (1 << k) + 1 AS rank FROM (
  SELECT *, {fold('h2', 'd')} AS h3, {fold('l2', 'd')} AS l3 FROM (SELECT *, unnest(range(1, m + 1)) AS d FROM leaf)))"""


def permuted(src: str, by: str, group: str, labels, value: str, adjacent: bool, tau: float, r: int, seed: int) -> str:
    """CTEs that end in ``tests``: the observed differences with the share of ``r`` label permutations that reach them.

    A replicate draws how many of group a lie below a place, then walks up and down from it, as whole numbers.
    """
    low = lambda n: f"(CAST(floor(({n} - 1) * {tau}::DOUBLE) AS BIGINT) + 1)"
    weight = lambda n: f"(({n} - 1) * {tau}::DOUBLE - floor(({n} - 1) * {tau}::DOUBLE))"
    prime2 = P31 * P31
    order = "(VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(labels)) + ") AS {0}(g, i)"
    mets = ", ".join(
        f"CASE WHEN {'fa' if j < 2 else 'NOT fa'} AND {'na' if j < 2 else 'nb'} = {k} THEN npos ELSE p{j} END AS p{j}"
        for j, k in enumerate(("ka", "ka2", "kb", "kb2"))
    )
    # Upwards: the next position's label.  Downwards: the label of the position that is passed.
    return f"""pairs AS ({pair_table(src, by, group, labels, adjacent)}),
q AS (SELECT {by}, {group} AS g, count(*) AS n, quantile_cont({value}, {tau}) AS q FROM {src} GROUP BY ALL),
observed AS (SELECT row_number() OVER () AS pid, p.{by}, ga, gb, la.i AS ia, lb.i AS ib, a.n AS n_a, b.n AS n_b, a.q - b.q AS diff,
    {low('a.n')} AS ka, least({low('a.n')} + 1, a.n) AS ka2, {low('b.n')} AS kb, least({low('b.n')} + 1, b.n) AS kb2
  FROM pairs p JOIN q a ON a.{by} = p.{by} AND a.g = ga JOIN q b ON b.{by} = p.{by} AND b.g = gb
  JOIN {order.format('la')} ON la.g = ga JOIN {order.format('lb')} ON lb.g = gb),
support AS (SELECT pid, x, CASE WHEN x = lo THEN 0.0::DOUBLE ELSE
    ln((n_a - x + 1)::DOUBLE * (h - x + 1) / (x::DOUBLE * (n_b - h + x))) END AS step
  FROM (SELECT *, unnest(range(lo, hi + 1)) AS x FROM (SELECT pid, n_a, n_b, ka + kb AS h, greatest(0, ka + kb - n_b) AS lo, least(n_a, ka + kb) AS hi FROM observed))),
logs AS (SELECT pid, x, sum(step) OVER (PARTITION BY pid ORDER BY x) AS lp FROM support),
mass AS (SELECT pid, x, exp(lp - max(lp) OVER (PARTITION BY pid)) AS m FROM logs),
chance AS (SELECT pid, x, sum(m) OVER (PARTITION BY pid ORDER BY x) / sum(m) OVER (PARTITION BY pid) AS c FROM mass),
keyed AS (SELECT pid, kn_0c AS st FROM (SELECT pid, {mix31(['kk'], seed, 'kn')} FROM (SELECT pid, {text_number([by, 'ia', 'ib'])} AS kk FROM observed))),
reps AS (SELECT pid, rep, own, ({finish('u1')} * {P31} + {finish('u2')})::DOUBLE / {prime2}::DOUBLE AS u FROM (
  SELECT *, {fold('own', '1')} AS u1, {fold('own', '2')} AS u2 FROM (
    SELECT pid, rep, {fold('st', 'rep')} AS own FROM keyed, generate_series(1, {r}) AS s(rep)))),
begun AS (SELECT reps.pid, rep, own, x FROM reps ASOF JOIN chance ON reps.pid = chance.pid AND u <= c),
walk(pid, rep, up, st, pos, a, step, p0, p1, p2, p3) USING KEY (pid, rep, up) AS (
  SELECT b.pid, rep, up, CASE WHEN up THEN {fold('own', '3')} ELSE {fold('own', '4')} END, ka + kb, x, 0,
    CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  FROM begun b JOIN observed USING (pid), (VALUES (true), (false)) AS d(up)
  UNION
  SELECT pid, rep, up, st, CASE WHEN up THEN pos + 1 ELSE pos - 1 END, CASE WHEN up THEN a + fa::BIGINT ELSE a - fa::BIGINT END, step, {mets} FROM (
    SELECT *, CASE WHEN up THEN a + 1 ELSE a END AS na, CASE WHEN up THEN pos + 1 - a ELSE pos - a END AS nb, CASE WHEN up THEN pos + 1 ELSE pos END AS npos FROM (
      SELECT *, CASE WHEN up THEN w * (n_a + n_b - pos) < (n_a - a) * {P31} ELSE w * pos < a * {P31} END AS fa FROM (
        SELECT pid, rep, up, st, pos, a, step, p0, p1, p2, p3, n_a, n_b, ka, ka2, kb, kb2, {finish('s2')} AS w FROM (
          SELECT pid, rep, up, st, pos, a, step + 1 AS step, p0, p1, p2, p3, n_a, n_b, ka, ka2, kb, kb2, {fold('st', '(step + 1)')} AS s2
          FROM walk JOIN observed USING (pid)
          WHERE CASE WHEN up THEN a < ka2 OR pos - a < kb2 ELSE a >= ka OR pos - a >= kb END))))),
places AS (SELECT pid, rep, max(p0) AS p0, max(p1) AS p1, max(p2) AS p2, max(p3) AS p3 FROM walk GROUP BY ALL),
taken AS (SELECT pid, p0, p1, p2, p3, count(*) AS times FROM places GROUP BY ALL),
pooled AS (SELECT pid * 1000000000000 + row_number() OVER (PARTITION BY pid ORDER BY {value}) AS place, {value} AS v
  FROM {src} JOIN observed ON {src}.{by} = observed.{by} AND ({group} = ga OR {group} = gb)),
tests AS (SELECT {by}, group_a, group_b, n_a, n_b, diff, hits, hits / {r}::DOUBLE AS p FROM (
  SELECT o.{by}, ga AS group_a, gb AS group_b, n_a, n_b, diff, sum(CASE WHEN round(abs(
      (v0.v + (v1.v - v0.v) * {weight('n_a')}) - (v2.v + (v3.v - v2.v) * {weight('n_b')})), 9) >= round(abs(diff), 9) THEN times ELSE 0 END) AS hits
  FROM taken t JOIN observed o USING (pid)
  {' '.join(f'JOIN pooled v{j} ON v{j}.place = t.pid * 1000000000000 + p{j}' for j in range(4))}
  GROUP BY ALL))"""
