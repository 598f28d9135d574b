"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataguild.llm.common import map_batches, release_memory, settle
from strataguild.session import measured

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Documents of a language that a model is fitted on, about (all of a language with fewer).
PER_LANG = 2500
#: Entries that a model chooses, shared evenly among the languages: words, and n-grams of each length.  The counts of
#: a chosen entry are kept in every language, so a model has these numbers of rows at most, and a column a language.
MAX_WORDS = 60_000
MAX_GRAMS = 20_000
#: Unseen words whose scores a worker remembers between texts, and texts that it takes up at once.
MEMORY = 20_000
TEXTS = 256
#: Distinct words of a language that a task counts before it hands them on.
COUNTED = 50_000


def tokens(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """Texts one by one, unpacked a few at a time."""
    for at in range(0, len(column), TEXTS):
        yield from column.slice(at, TEXTS).to_pylist()


def held_out(doc_id: str = "doc_id", parts: int = 4, which: int = 2) -> Column:
    """Documents kept out of learning: crc32 of the id as text, modulo ``parts``; a null id is not kept out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == which, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, word, total`` over all rows with text and lang."""

    def table(words: dict[str, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, counts in words.items() for _ in counts]
        listed = [word for counts in words.values() for word in counts]
        totals = [n for counts in words.values() for n in counts.values()]
        arrays = [pa.array(langs, pa.string()), pa.array(listed, pa.string()), pa.array(totals, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "word", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang, text in zip(langs, texts_of(batch.column(1)), strict=True):
                own = words.setdefault(lang, Counter())
                own.update(tokens(text))
                if len(own) > COUNTED:
                    yield table({lang: words.pop(lang)})
            release_memory()
        yield table(words)

    rows = docs.where("text is not null and lang is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "lang string, word string, total long").groupBy("lang", "word").agg(F.sum("total").alias("total"))


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, n, gram, total``: words (n is 0) and their n-grams, which are counted once a distinct word."""
    words = settle(count_words(docs))
    marked = lambda n: F.when(n > 1, F.concat(F.lit("<"), "word", F.lit(">"))).otherwise(F.col("word"))
    starts = lambda n: F.filter(F.sequence(F.lit(1), F.length("word") + 2), lambda i: i + n - 1 <= F.length(marked(n)))
    cut = lambda n: F.transform(starts(n), lambda i: F.struct(n.alias("n"), F.substring(marked(n), i, n).alias("gram")))
    grams_ = F.flatten(F.transform(F.array(*[F.lit(n) for n in range(1, LONGEST + 1)]), cut))
    parts = words.select("lang", F.explode(grams_).alias("g"), "total").select("lang", "g.n", "g.gram", "total")
    return words.select("lang", F.lit(0).alias("n"), F.col("word").alias("gram"), "total").unionByName(
        parts.groupBy("lang", "n", "gram").agg(F.sum("total").alias("total"))
    )


class Model:
    """Smoothed log frequencies of words and n-grams per language.

    One matrix holds the scores of all entries, words first, then n-grams from the shortest on, and after them those of
    unseen words met lately.  Entries travel as one text, so that a model unpacks into few objects.
    """

    def __init__(self, rows: list[tuple[str, int, str, int]], totals: list[tuple[str, int, int]]) -> None:
        self.langs = sorted({lang for lang, _, _ in totals})
        at = {lang: i for i, lang in enumerate(self.langs)}
        mass = np.ones((LONGEST + 1, len(self.langs)))
        for lang, n, total in totals:
            mass[n, at[lang]] += total
        names: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for _, n, gram, _ in rows:
            names[n].setdefault(gram, len(names[n]))
        parts = [np.zeros((len(own), len(self.langs))) for own in names]
        for lang, n, gram, total in rows:
            parts[n][names[n][gram], at[lang]] = total
        # A frequency is judged against the mean over languages, so that only differences count.
        for n, part in enumerate(parts):
            part[:] = np.log((part + 0.5) / (mass[n] + 0.5 * len(part)))
            part -= part.mean(axis=1, keepdims=True) if len(self.langs) else 0.0
        self.entries = ["\n".join(own) for own in names]
        self.scores = np.concatenate(parts).astype(np.float32)
        self._index()

    def _index(self) -> None:
        self.rows: list[dict[str, int]] = []
        first = 0
        for text in self.entries:
            own = text.split("\n") if text else []
            self.rows.append(dict(zip(own, range(first, first + len(own)), strict=True)))
            first += len(own)
        self.known: dict[str, int] = {}
        self.table = np.concatenate([self.scores, np.zeros((MEMORY, len(self.langs)), np.float32)])
        self.scores = self.table[:first]

    def __getstate__(self) -> tuple:
        return self.langs, self.entries, self.scores

    def __setstate__(self, state: tuple) -> None:
        self.langs, self.entries, self.scores = state
        self._index()

    def _unseen(self, word: str) -> int:
        """Row of a word that is no entry: the mean of its longest known n-grams; -1 if none is known."""
        for n in range(LONGEST, 0, -1):
            table = self.rows[n]
            if found := [table[g] for g in grams(word, n) if g in table]:
                row = len(self.scores) + len(self.known)
                self.table[row] = self.scores[found].mean(axis=0, dtype=float)
                self.known[word] = row
                return row
        return -1

    def evidence(self, words: Counter) -> tuple[np.ndarray, bool]:
        """Summed scores of a text's words, and whether any of them is known by itself or by its n-grams."""
        total, known, listed = np.zeros(len(self.langs)), False, list(words.items())
        for i in range(0, len(listed), MEMORY // 2):
            some = listed[i : i + MEMORY // 2]
            if len(self.known) + len(some) > MEMORY:
                self.known.clear()
            own, seen = self.rows[0], self.known
            at = np.array([own[w] if w in own else seen[w] if w in seen else self._unseen(w) for w, _ in some])
            n = np.array([k for _, k in some], float)
            total += n[at >= 0] @ self.table[at[at >= 0]]
            known |= bool((at >= 0).any())
        return total, known

    def predict(self, text: str | None) -> tuple[str, float]:
        """Best language and its share of the posterior; ``und`` and 0 without letters or languages."""
        lang, score, _ = self.judge(text)
        return lang, score

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """As ``predict``, and whether the text gives evidence at all: a word or n-gram that the model knows."""
        words = Counter(tokens(text)) if text else None
        if not words or not self.langs:
            return UNKNOWN, 0.0, False
        total, known = self.evidence(words)
        total -= total.max()
        share = np.exp(np.maximum(total, -700.0))
        best = int(np.argmax(total))
        return self.langs[best], float(1.0 / math.fsum(share)), known


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """``lang, text`` of about ``per_lang`` documents of every language, chosen by a hash of the id, so that it is the
    same sample every time."""
    known = docs.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    # One row a language: sent to the tasks if they are counted to be few.
    share = measured(known.groupBy("lang").agg((F.lit(float(per_lang)) / F.count(F.lit(1))).alias("share")))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return known.join(share, "lang").where(place < F.col("share")).select("lang", "text")


def fit(docs: DataFrame, per_lang: int = PER_LANG, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from a bounded sample of the rows with text and lang.

    Every language chooses its most frequent words and n-grams of each length, an even share of ``max_words`` and
    ``max_grams`` (ties by text); a chosen entry brings its counts in all languages.  No language is left out.
    """
    counts = settle(count_grams(sample(docs, per_lang)))
    totals = [tuple(r) for r in counts.groupBy("lang", "n").agg(F.sum("total")).collect()]
    langs = len({lang for lang, _, _ in totals}) or 1
    # A language's counts come from a bounded sample, so a task can rank them.
    place = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("total"), "gram"))
    most = F.when(F.col("n") == 0, max(1, max_words // langs)).otherwise(max(1, max_grams // langs))
    chosen = counts.withColumn("place", place).where(F.col("place") <= most).select("n", "gram").distinct()
    rows = [tuple(r) for r in counts.join(chosen, ["n", "gram"], "left_semi").select("lang", "n", "gram", "total").collect()]
    return Model(sorted(rows), totals)


def predict(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys`` with ``lang_pred, score`` for the whole text of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    n = len(keys)

    def step(batch: pa.RecordBatch) -> dict:
        found = [sent.value.predict(t) for t in texts_of(batch.column(n))]
        out = {k: batch.column(i) for i, k in enumerate(keys)}
        return out | {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    rows = docs.select(*keys, F.col("text").cast("string").alias("body"))
    return map_batches(rows, step, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, learned from the rows that are not held out.

    A text that is null or has no letters is ``und`` with score 0, and so is every text if nothing can be learned
    (an empty table, no lang at all).  Ties go to the first language by name.  Repeated rows are judged one by one;
    other columns are ignored; only the text is an input of a prediction.
    """
    model = fit(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with a posterior of ``least`` or more; columns as they are.

    Rejected are texts that are null or have no letter, and texts without evidence: no word of theirs and no part of
    one is known in any language, as in an unknown script.  Repeated rows are judged one by one; an empty table, or one
    to learn nothing from, keeps none.
    """
    model = fit(docs.where(~held_out()))
    sent, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    body = "body"
    while body in columns:
        body += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.judge(t) for t in texts_of(batch.column(batch.schema.get_field_index(body)))]
            keep = pa.array([known and lang != UNKNOWN and score >= least for lang, score, known in found], pa.bool_())
            yield batch.select(columns).filter(keep)
            release_memory()

    return docs.select("*", F.col("text").cast("string").alias(body)).mapInArrow(run, docs.schema)
