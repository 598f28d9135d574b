"""Mixing to target weights: domain posteriors from a labelled table, and document rates by projected least squares."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataguild.llm.common import settle

#: Labelled documents that a classifier is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 8000
#: Words with a weight, at most, for each trait; the log odds and the likelihood ratio statistic that they must reach.
MAX_WORDS = 400
STRONG = 2.0
SURE = 25.0
#: Bits of the level that stands for the number of a document's telling words: two levels to a doubling, so no number is cut.
LEVEL_BITS = 5
TRAITS = ("poor", "toxic")
DOMAINS = ("good", "poor", "good_toxic", "poor_toxic")
#: Weight of the rates' squared distance from 1 against the squared relative differences of domains with and without a
#: target.  No document's posterior is zero, so a target of zero is never met; with a smaller weight its domain drives out
#: documents that are hardly in it, until few are left with rates of many copies.
PULL = (0.0001, 0.01)
#: Step lengths that a move chooses from; the shortest but zero is below one over the largest curvature, 1 + 1 / min(PULL).
LENGTHS = (0.0, *[4.0**-i for i in range(8)])
#: Shares of all tokens that the documents shall have by domain after mixing.
TARGETS = {"good": 0.93, "poor": 0.07, "good_toxic": 0.0, "poor_toxic": 0.0}


def _with_words(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``mix``: the number of words, the distinct words and bins of a few facts of the whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ws = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    one = docs.select(*keep, ws.alias("mix_words"), F.regexp_count(text, F.lit(r"[#*$%&|<>!]")).alias("mix_signs"))
    two = one.select(*keep, F.size("mix_words").alias("mix_n"), F.array_distinct("mix_words").alias("mix_words"), "mix_signs")
    n, least = F.col("mix_n"), F.greatest("mix_n", F.lit(1))
    share = lambda x: F.least(F.floor(x * 10 / least), F.lit(9)).cast("int")
    bins = F.array(share(F.size("mix_words")), share(F.col("mix_signs")) + 10, F.floor(F.log2(n + F.lit(1.0))).cast("int") + 20)
    return two.select(*keep, F.struct(F.col("mix_n").cast("long").alias("n"), F.col("mix_words").alias("words"), bins.alias("bins")).alias("mix"))


def telling(mix: Column, words: list[str]) -> Column:
    """The level of how many of ``words`` a document has: two levels to a doubling."""
    return F.floor(2 * F.log2(F.size(F.array_intersect(mix["words"], F.array(*[F.lit(w) for w in words]))) + F.lit(1.0))).cast("int")


@dataclass
class Classifier:
    """Log odds of two independent traits: a bias, weights of the number of telling words, weights of bins."""

    bias: list[float]
    words: tuple[list[str], ...] = ((), ())
    found: tuple[list[float], ...] = ((), ())
    bins: dict[int, list[float]] = field(default_factory=dict)

    def code(self, mix: Column) -> Column:
        """All that the classifier sees of a document in one number: telling words of both traits, then the bins."""
        poor, toxic = (telling(mix, w) if w else F.lit(0) for w in self.words)
        digits = [(poor, 0), (toxic, LEVEL_BITS), (mix["bins"][0], 2 * LEVEL_BITS), (mix["bins"][1] - 10, 2 * LEVEL_BITS + 4), (mix["bins"][2] - 20, 2 * LEVEL_BITS + 8)]
        total = F.lit(0).cast("long")
        for digit, at in digits:
            total = total + digit * 2**at
        return F.coalesce(total, F.lit(0).cast("long"))

    def posteriors(self, code: Column) -> Column:
        """Array of the probabilities of ``DOMAINS`` for a document's code."""
        digit = lambda at, bits: F.shiftright(code, at).bitwiseAND(F.lit(2**bits - 1)).cast("int")
        bins = [digit(2 * LEVEL_BITS, 4), digit(2 * LEVEL_BITS + 4, 4) + 10, digit(2 * LEVEL_BITS + 8, 6) + 20]

        def odds(k: int) -> Column:
            total = F.lit(self.bias[k])
            if self.words[k]:
                total += F.get(F.array(*[F.lit(x) for x in self.found[k]]), digit(LEVEL_BITS * k, LEVEL_BITS))
            if self.bins:
                table = F.array(*[F.lit(self.bins.get(b, [0.0, 0.0])[k]) for b in range(max(self.bins) + 1)])
                for b in bins:
                    total += F.coalesce(F.get(table, b), F.lit(0.0))
            return 1 / (1 + F.exp(-total))

        p, t = odds(0), odds(1)
        return F.array((1 - p) * (1 - t), p * (1 - t), (1 - p) * t, p * t)


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_words: int = MAX_WORDS) -> Classifier:
    """Log odds from at most ``sample`` labelled documents.

    Telling words are chosen on one half of the sample; what their number means is learned on the other half.  Rows with a null id or label are left out; a document labelled twice counts as poor or toxic if one label says so.
    Without labelled documents all posteriors are even.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``sample`` rows at most
    texts = texts.groupBy("text").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    texts = texts.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    rows = settle(
        _with_words(texts, ["quality", "toxic", "half"]).select(
            "half",
            F.when(F.col("quality") == 0, 1).otherwise(0).alias("poor"), F.col("toxic").cast("int").alias("toxic"), "mix"
        )
    )
    total = rows.agg(F.count(F.lit(1)), F.sum("poor"), F.sum("toxic")).first()
    if not total[0]:
        return Classifier([0.0, 0.0])
    n, sums = total[0], (total[1], total[2])

    def weigh(part: DataFrame, key: Column) -> tuple[DataFrame, list[Column], list[Column]]:
        size = part.agg(F.count(F.lit(1)), *[F.sum(t) for t in TRAITS]).first()
        n, sums = size[0], [x or 0 for x in size[1:]]
        counts = part.select(key.alias("key"), *TRAITS).groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in TRAITS])
        odds, sure = [], []
        for k, t in enumerate(TRAITS):
            yes, no = F.col(t), F.col("n") - F.col(t)
            odds.append(F.log((yes + 0.5) / (sums[k] + 1.0)) - F.log((no + 0.5) / (n - sums[k] + 1.0)))
            share = sums[k] / max(n, 1)
            gain = lambda x, e: F.when(x * e > 0, x * F.log(x / e)).otherwise(0.0)
            sure.append(2 * (gain(yes, F.col("n") * share) + gain(no, F.col("n") * (1 - share))))
        return counts, odds, sure

    words, found = [], []
    counts, odds, sure = weigh(rows.where("half = 0"), F.explode("mix.words"))
    for k in range(2):
        top = counts.where((sure[k] >= SURE) & (odds[k] >= STRONG)).orderBy(sure[k].desc(), "key").limit(max_words)
        words.append([r["key"] for r in top.collect()])
        steps = {}
        if words[k]:
            other, weight, _ = weigh(rows.where("half = 1"), telling(F.col("mix"), words[k]))
            steps = {r["key"]: r["w"] for r in other.select("key", weight[k].alias("w")).collect()}
        found.append([steps.get(i, max(steps.values(), default=0.0)) for i in range(2**LEVEL_BITS)])
    counts, odds, _ = weigh(rows, F.explode("mix.bins"))
    bins = {r["key"]: [r["p"], r["t"]] for r in counts.select("key", odds[0].alias("p"), odds[1].alias("t")).collect()}
    return Classifier([math.log((s + 0.5) / (n - s + 0.5)) for s in sums], tuple(words), tuple(found), bins)


def point_of(aims: list[list[float]], parts: list[float], p: Column) -> Column:
    """Struct of a document's rate ``r`` after some moves from 1, for its posteriors ``p``.

    A move goes the share ``parts`` of the way to ``1 - aim p`` and projects the rate to zero or more.  Moves along the
    gradient and moves within the face (where a rate of zero stays) take turns.  They are numbers per domain, so no
    state is kept per document.
    """
    if not aims:
        return F.named_struct(F.lit("r"), F.lit(1.0))
    # As SQL text: a literal is cheap to read there, and a column for each number is not.
    listed = [
        f"struct(array({', '.join(f'{x!r}D' for x in aim)}) AS aim, {part!r}D AS part, {str(i % 2 == 1).lower()} AS face)"
        for i, (aim, part) in enumerate(zip(aims, parts, strict=True))
    ]
    moves = F.expr(f"array({', '.join(listed)})")
    rate = F.aggregate(moves, F.lit(1.0), lambda r, s: _moved(r, s["aim"], s["part"], s["face"], p))
    return F.named_struct(F.lit("r"), rate)


def _moved(rate: Column, aim: Column, part: Column, face: Column, p: Column) -> Column:
    goal = F.lit(1.0)
    for i in range(len(DOMAINS)):
        goal = goal - F.get(aim, F.lit(i)) * F.get(p, F.lit(i))
    return F.when(face & (rate <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), rate + part * (goal - rate)))


def alike(scored: DataFrame, model: Classifier) -> DataFrame:
    """``code, n_tokens, posteriors``: one row for all documents with the same code.

    They share posteriors and rate, so nothing is lost.  With at most ``MAX_WORDS`` telling words a trait has 18 levels; with
    two bins of ten and one of 32 there are fewer than 2 ** 20 codes.
    """
    sums = scored.groupBy("code").agg(F.sum("n_tokens").alias("n_tokens"))
    return settle(sums.withColumn("posteriors", model.posteriors(F.col("code"))))


def fit_rates(scored: DataFrame, targets: dict[str, float], tolerance: float = 1e-6) -> tuple[list[list[float]], list[float]]:
    """The moves of projected-gradient least squares for ``scored`` (``n_tokens``, ``posteriors``), for ``point_of``.

    Minimises the squared differences between expected tokens per domain (sum of rate * tokens * posterior) and
    ``targets`` (shares of all tokens) over rates of zero or more.  A difference counts relative to the domain's own
    tokens, so a small domain weighs as much as a large one.  Many rates do equally well; ``PULL`` times the squared
    distance of the rates from 1 chooses among them.

    Two moves take turns, each the best of some step lengths and one aggregate to a few numbers: a projected gradient
    step, which finds the rates that are zero, and a projected step towards the least-squares solution of the rates that
    are not, so that badly scaled domains do not need thousands of gradient steps.  The shortest gradient step is below
    one over the largest curvature, so the function falls until the gradient step of full length changes no domain's
    expected tokens by more than ``tolerance`` of its own tokens, or until it can't fall any more in double precision.
    There is no limit of rounds.
    """
    k = len(DOMAINS)
    p, t = F.col("posteriors"), F.col("n_tokens").cast("double")
    of = [F.get(p, F.lit(i)) for i in range(k)]
    row = scored.agg(F.sum(t), *[F.sum(t * x) for x in of]).first()
    size = row[0]
    if not size:
        return [], []
    own = np.maximum(np.array(row[1:]) / size, 1e-9)
    goal = np.array([targets.get(d, 0.0) for d in DOMAINS])
    pull = np.where(goal > 0, *PULL) * own
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    aims: list[list[float]] = []
    lengths: list[float] = []

    def tried(aim: np.ndarray) -> dict[float, np.ndarray]:
        """For each step length: squared distance from 1, tokens and moved tokens per domain, and the face's moments."""
        face = F.lit(len(aims) % 2 == 1)
        at = scored.select("n_tokens", "posteriors", point_of(aims, lengths, p)["r"].alias("rate"), F.explode(F.array(*[F.lit(x) for x in LENGTHS])).alias("part"))
        to = F.array(*[F.lit(float(x)) for x in aim])
        new = F.col("new")
        sums = at.withColumn("new", _moved(F.col("rate"), to, F.col("part"), face, p)).groupBy("part").agg(
            F.sum(t * (new - 1) ** 2),
            *[F.sum(t * new * x) for x in of],
            *[F.sum(t * F.abs(new - F.col("rate")) * x) for x in of],
            *[F.sum(F.when(new > 0, t * x).otherwise(0.0)) for x in of],
            *[F.sum(F.when(new > 0, t * of[i] * of[j]).otherwise(0.0)) for i, j in pairs],
        )
        return {r[0]: np.array(r[1:]) / size for r in sums.collect()}  # one row for each of LENGTHS

    def value(sums: np.ndarray) -> float:
        return float(sums[0] + (((sums[1 : 1 + k] - goal) ** 2) / pull).sum()) / 2

    tokens, last = np.array(row[1:]) / size, math.inf
    while True:
        aim = (tokens - goal) / pull
        found = tried(aim)
        if (found[1.0][1 + k : 1 + 2 * k] <= tolerance * own).all():
            return aims, lengths
        part = min(LENGTHS, key=lambda x: value(found[x]))
        aims, lengths = [*aims, aim.tolist()], [*lengths, part]
        here = found[part]
        curve = np.diag(pull)
        for (i, j), x in zip(pairs, here[1 + 3 * k :], strict=True):
            curve[i, j] += x
            curve[j, i] = curve[i, j]
        scale = 1 / np.sqrt(np.diag(curve))
        aim = scale * np.linalg.solve(curve * np.outer(scale, scale), scale * (here[1 + 2 * k : 1 + 3 * k] - goal))
        found = tried(aim)
        part = min(LENGTHS, key=lambda x: value(found[x]))
        aims, lengths = [*aims, aim.tolist()], [*lengths, part]
        tokens = found[part][1 : 1 + k]
        if value(found[part]) >= last * (1 - 1e-15):
            return aims, lengths
        last = value(found[part])


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Domain posteriors and mixing rate of every document.

    Returns ``doc_id, n_tokens, posteriors, rate``: a rate of 1.2 asks for 1.2 copies in expectation, 0 for none.
    Tokens are words (runs of letters and digits).  Null and empty texts have no tokens and the rate of their bins;
    repeated rows are weighed one by one; other columns are ignored; without rows or tokens all rates are 1.
    """
    model = fit_classifier(docs, labels)
    scored = settle(_with_words(docs, ["doc_id"]).select("doc_id", F.col("mix.n").alias("n_tokens"), model.code(F.col("mix")).alias("code")))
    table = alike(scored, model)
    aims, lengths = fit_rates(table, targets or TARGETS)
    rates = table.select("code", "posteriors", point_of(aims, lengths, F.col("posteriors"))["r"].alias("rate"))
    return scored.join(F.broadcast(rates), "code").select("doc_id", "n_tokens", "posteriors", "rate")  # fewer than 2 ** 20 rows


def shares_without(scored: DataFrame, unwanted: tuple[str, ...]) -> dict[str, float]:
    """The domains' own shares of all tokens once the unwanted domains have none and the others fill their place."""
    t = F.col("n_tokens").cast("double")
    row = scored.agg(*[F.sum(t * F.get("posteriors", F.lit(i))) for i in range(len(DOMAINS))]).first()
    wanted = {d: x or 0.0 for d, x in zip(DOMAINS, row, strict=True) if d not in unwanted}
    return {d: x / (sum(wanted.values()) or 1.0) for d, x in wanted.items()}


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, unwanted: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """``docs`` with every row as often as its rate says, rounded to whole copies (at least one from a rate of 0.5 on).

    Without ``targets`` these are the domains' own shares without the ``unwanted`` ones.  ``most`` bounds the copies of
    a row, for a corpus that shall not have the same text twice.  Copies of a row are equal in
    all columns.  The rows are scored again where they are, so texts are not shuffled.  Edge cases as in ``mix``.
    """
    model = fit_classifier(docs, labels)
    scored = _with_words(docs, []).select(F.col("mix.n").alias("n_tokens"), model.code(F.col("mix")).alias("code"))
    table = alike(scored, model)
    aims, lengths = fit_rates(table, targets or shares_without(table, unwanted))
    copies = F.round(point_of(aims, lengths, F.col("posteriors"))["r"]).cast("int")
    copies = F.least(copies, F.lit(most)) if most is not None else copies
    wanted = settle(table.select("code", copies.alias("mix_copies"))).where("mix_copies > 0")
    names = [f"kept_{i}" for i in range(len(docs.columns))]
    packed = docs.select(F.col("text"), F.struct(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("mix_row"))
    coded = _with_words(packed, ["mix_row"]).select("mix_row", model.code(F.col("mix")).alias("code"))
    rows = coded.join(F.broadcast(wanted), "code")  # fewer than 2 ** 20 rows
    many = rows.select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return many.select(*[F.col(f"mix_row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)])
