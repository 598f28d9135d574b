"""Quality rules with robust multivariate outliers (minimum covariance determinant per language and source)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataguild.llm.common import settle
from strataguild.session import BROADCAST_ROWS, marked, measured

STATS = ("v0", "v1", "v2", "v3", "v4")
P = len(STATS)
#: Share of a group's rows that its estimate rests on, and what the covariance of that core of a normal law of five
#: dimensions is multiplied with to be the law's: 0.75 over the chi-square law of seven dimensions at the 0.75 quantile of five.
CORE = 0.75
CONSISTENCY = 1.412
#: The same for the last estimate, on the rows within the 0.975 quantile of five dimensions of the one before.
NEAR = 12.833
NEAR_CONSISTENCY = 1.056
#: Rows that passed the base rules, ten a dimension, that a group needs for an estimate of its own.
MIN_GROUP = 10 * P
#: Squared distance beyond which a document is rejected: one in a thousand of a normal law (``chi_square_tail``).
LIMIT = 20.515
#: Log determinants that fall by less than this stand still.
STILL = 1e-3
#: Words of common length, in letters, and without any sign that all texts are smoothed with, so that one symbol or long
#: word in a short text is no outlier: shares and means of few words vary more.
SMOOTH = 50
LETTERS = 5
ALL = "all"
_SPACE = "\t\n\x0b\x0c\r"


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of the whole text.

    Words are runs without space, tab, line feed, vertical tab, form feed or return.  Windows of five words are told
    apart by 64-bit hashes within their own document.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.translate(text, _SPACE, " " * len(_SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    one = docs.select(
        *keep,
        F.array_remove(F.split(plain, " "), "").alias("qr_words"),
        lines.alias("qr_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    n = F.size("qr_words")
    starts = F.when(n >= 5, F.sequence(F.lit(0), n - 5)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.get("qr_words", i)
    hashes = F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2), word(i + 3), word(i + 4)))
    two = one.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("qr_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("qr_hashes"),
    )
    # Only a text with a repeated window needs its windows sorted.
    tied = F.size(F.array_distinct("qr_hashes")) < F.size("qr_hashes")
    pairs = F.array_sort(F.transform("qr_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    three = two.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(tied, pairs).alias("qr_pairs"))
    here = lambda i: F.get("qr_pairs", i)["h"]
    again = F.filter(
        F.transform("qr_pairs", lambda x, i: F.when((here(i - 1) == x["h"]) | (here(i + 1) == x["h"]), x["i"])), lambda i: i.isNotNull()
    )
    four = three.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.array_sort(again).alias("qr_again"))
    covered = F.aggregate(
        "qr_again",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + 5).alias("end"), (acc["n"] + i + 5 - F.greatest(i, acc["end"])).alias("n")),
        lambda acc: acc["n"],
    )
    return four.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def transformed() -> list[Column]:
    """The statistic vector: logs of length and mean word length, and of symbols, repeated lines and repeated words
    per hundred words."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    rate = lambda c: F.log1p(100 * F.col(c) / (n + SMOOTH))
    return [
        F.log(n).alias("v0"),
        F.log((F.col("word_chars") + SMOOTH * LETTERS) / (n + SMOOTH)).alias("v1"),
        rate("n_symbols").alias("v2"),
        rate("n_dup_lines").alias("v3"),
        rate("n_repeat_words").alias("v4"),
    ]


def _floors() -> list[Column]:
    """The resolution of each statistic in a text of the group's median (``m0``, ``m1``): what one word, one character,
    one symbol, one repeated line and one repeated window change.  No spread is taken to be smaller."""
    n = F.exp("m0")
    one = lambda k: F.log1p(F.lit(100.0 * k) / (n + SMOOTH))
    return [x.alias(f"f{i}") for i, x in enumerate([1 / n, 1 / ((n + SMOOTH) * F.exp("m1")), one(1), one(1), one(5)])]


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
KEY = ["grp", "start"]
FIT = [*[f"m{i}" for i in range(P)], *[f"f{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS], "det"]


def _factored(fit: DataFrame) -> DataFrame:
    """``fit`` with the lower Cholesky factor ``l`` of its covariance ``a`` and the log determinant ``det``."""
    out = fit
    for j in range(P):
        left = F.col(f"a{j}{j}")
        for k in range(j):
            left = left - F.col(f"l{j}{k}") ** 2
        # Floors on the diagonal keep the exact value above this; rounding must not make it zero.
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(left, F.col(f"f{j}") ** 2 / 4)))
        for i in range(j + 1, P):
            left = F.col(f"a{i}{j}")
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", left / F.col(f"l{j}{j}"))
    det = F.lit(0.0)
    for i in range(P):
        det = det + 2 * F.log(f"l{i}{i}")
    return out.withColumn("det", det)


def _moments(rows: DataFrame, consistency: float = CONSISTENCY) -> DataFrame:
    """Mean vector ``m`` and covariance ``a`` of ``rows`` per ``KEY``, made consistent, with the squared floors added."""
    n = F.count(F.lit(1))
    sums = rows.groupBy(*KEY).agg(
        *[(F.sum(v) / n).alias(f"m{i}") for i, v in enumerate(STATS)],
        *[(F.sum(F.col(STATS[i]) * F.col(STATS[j])) / n).alias(f"c{i}{j}") for i, j in PAIRS],
        *[F.max(f"f{i}").alias(f"f{i}") for i in range(P)],
    )

    def entry(i: int, j: int) -> Column:
        spread = F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
        return consistency * F.greatest(spread, F.lit(0.0)) + F.col(f"f{i}") ** 2 if i == j else consistency * spread

    covered = sums.select(*KEY, *FIT[: 2 * P], *[entry(i, j).alias(f"a{i}{j}") for i, j in PAIRS])
    return _factored(covered).select(*KEY, *FIT)


def _distance(rows: DataFrame, fit: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance under each of the group's estimates, and ``FIT``'s keys."""
    kept = rows.columns
    out = rows.join(fit, by, how)
    total = F.lit(0.0)
    for i in range(P):
        left = F.col(STATS[i]) - F.col(f"m{i}")
        for k in range(i):
            left = left - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", left / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") ** 2
    return out.select(*kept, *[c for c in ("start", *FIT[P : 2 * P]) if c in fit.columns], total.alias("d2"))


def _grouped(stats: DataFrame) -> DataFrame:
    """``stats`` with ``grp``, the group that judges a row, and ``feeds``, the groups whose estimates it takes part in.

    A language and source with ``MIN_GROUP`` good rows judge themselves; else the language does, with all its rows; a
    language of fewer rows is judged by all rows.
    """
    named = stats.withColumn("own", F.to_json(F.struct(F.lit("source").alias("by"), "lang", "source"))).withColumn(
        "tongue", F.to_json(F.struct(F.lit("lang").alias("by"), "lang"))
    )
    sizes = settle(named.groupBy("own", "tongue").agg(F.sum((~F.col("base_failed")).cast("long")).alias("size")))
    tongues = settle(sizes.groupBy("tongue").agg(F.sum("size").alias("tongue_size"), F.max(F.col("size") < MIN_GROUP).alias("asked")))
    rest = bool(tongues.agg(F.max(F.col("tongue_size") < MIN_GROUP)).first()[0])
    enough, many = F.col("size") >= MIN_GROUP, F.col("tongue_size") >= MIN_GROUP
    feeds = F.array_compact(F.array(F.when(enough, F.col("own")), F.when(many & F.col("asked"), F.col("tongue")), F.lit(ALL if rest else None)))
    chosen = sizes.join(tongues, "tongue").select(
        "own", F.when(enough, F.col("own")).when(many, F.col("tongue")).otherwise(ALL).alias("grp"), feeds.alias("feeds")
    )
    return named.join(measured(chosen), "own").drop("own", "tongue")


def _starts(good: DataFrame) -> DataFrame:
    """Two first estimates per group: medians with median deviations (0), and with the covariance of the deviations after
    ``tanh``, which far rows hardly move (1)."""
    middle = settle(good.groupBy("grp").agg(
        *[F.percentile_approx(v, F.lit(0.5), F.lit(2000)).alias(f"m{i}") for i, v in enumerate(STATS)], F.count(F.lit(1)).alias("size")
    ).where(F.col("size") >= MIN_GROUP).select("grp", *FIT[:P], *_floors()))
    away = [F.abs(F.col(v) - F.col(f"m{i}")) for i, v in enumerate(STATS)]
    spread = good.join(marked(middle), "grp").groupBy("grp").agg(
        *[F.greatest(1.4826 * F.percentile_approx(x, F.lit(0.5), F.lit(2000)), F.max(f"f{i}")).alias(f"d{i}") for i, x in enumerate(away)]
    )
    scaled = settle(middle.join(spread, "grp"))
    bent = [F.tanh((F.col(v) - F.col(f"m{i}")) / F.col(f"d{i}")) for i, v in enumerate(STATS)]
    bends = good.join(marked(scaled), "grp").groupBy("grp").agg(*[F.covar_pop(bent[i], bent[j]).alias(f"b{i}{j}") for i, j in PAIRS])
    scale = {(i, j): F.col(f"d{i}") * F.col(f"d{j}") for i, j in PAIRS}
    plain = scaled.select("grp", F.lit(0).alias("start"), *FIT[: 2 * P], *[(scale[i, j] if i == j else F.lit(0.0)).alias(f"a{i}{j}") for i, j in PAIRS])
    bowed = scaled.join(bends, "grp").select(
        "grp", F.lit(1).alias("start"), *FIT[: 2 * P], *[(scale[i, j] * (F.col(f"b{i}{j}") + (0.01 if i == j else 0.0))).alias(f"a{i}{j}") for i, j in PAIRS]
    )
    return _factored(plain.unionByName(bowed)).select(*KEY, *FIT)


def robust_distance(stats: DataFrame) -> DataFrame:
    """``stats`` (with ``v0..v4``, ``base_failed``, ``lang``, ``source``) with ``d2`` from its group's robust estimate.

    Each concentration step takes the ``CORE`` share of a group's good rows that are nearest under the last estimate and
    fits mean and covariance to them.  An estimate is replaced only by one with a smaller covariance determinant, and
    steps go on until no determinant falls any more; as floors bound it from below, that happens.  Of the two starts
    the one that ends lower decides; its mean and covariance are then taken anew from all rows near it, which leaves fewer
    honest rows out.  Every step is an aggregate per group and a join with the few estimates (sent to the
    tasks if their counted rows are few), so no group is gathered anywhere.  Without enough rows there is no distance.
    """
    rows = settle(_grouped(stats))
    good = settle(rows.where("not base_failed").select(F.explode("feeds").alias("grp"), *STATS))
    fit = settle(_starts(good).withColumn("det", F.lit(float("inf"))).withColumn("moved", F.lit(True)))
    # No later table has more rows than this one, so one count bounds all that is sent to the tasks.
    few = fit.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = F.broadcast if few else lambda table: table
    while fit.where("moved").head(1):
        near = _distance(good, sent(fit.where("moved").drop("moved")), ["grp"])
        edge = near.groupBy(*KEY).agg(F.percentile_approx("d2", F.lit(CORE), F.lit(2000)).alias("edge"))
        new = _moments(near.join(sent(edge), KEY).where("d2 <= edge"))
        old = fit.drop("moved").withColumnsRenamed({c: f"old_{c}" for c in FIT})
        falls = F.coalesce(F.col("det") < F.col("old_det") - STILL, F.lit(False))
        both = old.join(sent(new), KEY, "left")
        fit = settle(both.select(*KEY, *[F.when(falls, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in FIT], falls.alias("moved")))
    lowest = fit.groupBy("grp").agg(F.min_by(F.struct("start", *FIT), F.struct("det", "start")).alias("best")).select("grp", "best.*")
    near = _distance(good, sent(lowest), ["grp"]).where(F.col("d2") <= NEAR)
    best = settle(_moments(near, NEAR_CONSISTENCY).drop("start", "det"))
    return _distance(rows, sent(best.drop(*FIT[P : 2 * P])), ["grp"], "left").drop("grp", "feeds")


def judge_quality(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Base rules and the outlier verdict for every row.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance``.  A
    row is rejected by the base rules (under 10 words, or more than 20 in 100 words in repeated windows) or if its
    squared robust distance within its language and source is above ``limit``.  Texts are read whole, however long.
    Null texts have no words and fail the base rules; null languages and sources are groups of their own; a source
    with fewer than ``MIN_GROUP`` good rows is judged by its language, such a language by all rows; without enough rows
    nothing but the base rules decides.  Repeated rows are judged one by one, equal texts of a group alike; other
    columns are ignored; an empty table gives an empty result.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    stats = with_statistics(docs, ["doc_id", "lang", "source"])
    stats = settle(stats.select("*", base_failed().alias("base_failed"), *transformed()))
    found = robust_distance(stats)
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= F.lit(float(limit)))
    return found.select("doc_id", *counts, "base_failed", kept.alias("kept"), F.col("d2").alias("distance"))


def chi_square_tail(x: float) -> float:
    """Upper tail of the chi-square law of five degrees of freedom, for the documentation of ``LIMIT``."""
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
