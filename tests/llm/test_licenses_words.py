"""License scans against a plain version, SQL for the base columns, and repeated fragments."""

import random
import re

import pytest

from strataguild.llm import licenses, queries
from strataguild.llm.license_texts import TEXTS

SCHEMA = "doc_id long, text string, labels string, tpl int, hash long, spans string"


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in enumerate(texts)], SCHEMA)


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_spans(text, k=3, drift=3, least=0.6):
    """Every template against every place, diagonals merged in order of their first hit."""
    w, out = words(text), []
    for tpl in licenses.NOTICES:
        t = tpl.text.split()
        diagonals = {}
        for i in range(len(w) - k + 1):
            for j in range(len(t) - k + 1):
                if w[i : i + k] == t[j : j + k]:
                    diagonals.setdefault(i - j, []).append(j)
        merged = []
        for low, high, d, hits in sorted((min(h) + d, max(h) + d, d, h) for d, h in diagonals.items()):
            own = {x for j in hits for x in range(j, j + k)}
            met = {x + d for x in own}
            if merged and abs(merged[-1][2] - d) <= drift and low - merged[-1][1] <= k + drift:
                last = merged[-1]
                merged[-1] = (last[0], max(last[1], high), d, last[3] | own, last[4] | met)
            else:
                merged.append((low, high, d, own, met))
        for low, high, _, own, met in merged:
            if len(own) >= least * len(t) and len(met) >= least * (high + k - low):
                out.append((tpl.label, low, high + k - 1))
    return sorted(out)


def test_spans_match_plain_version(spark):
    rnd = random.Random(3)
    filler = "the of license software and copy under version this is provided to any person".split()
    texts = [None, "", "of the license " * 8, "of the license " * 400, "the copyright holder " * 30]
    for label, text in TEXTS:
        texts += [text, "x " * 50 + text + " y" * 50, text + "\n\n" + text]
        w = text.split()
        texts.append(" ".join(x for i, x in enumerate(w) if i % 17))
        texts.append(" ".join(w[: len(w) // 3]))
        texts.append(" ".join(rnd.sample(w, len(w))))
    for notice in licenses.NOTICES[:8]:
        w = notice.text.split()
        at = rnd.randrange(len(w))
        texts.append(" ".join(w[:at] + rnd.choices(filler, k=rnd.randrange(3)) + w[at:]))
    texts += [" ".join(rnd.choices(filler, k=200)) for _ in range(20)]
    got = {r.doc_id: sorted((s.label, s.first, s.last) for s in r.spans) for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(texts)}
    assert sum(len(s) for s in got.values()) > 40


def test_repeated_fragments_are_no_license(spark):
    got = licenses.scan(docs_of(spark, ["of the license " * 8, "either version 3 of the license " * 2])).orderBy("doc_id").collect()
    assert got[0].labels == "" and got[0].score < 0.3
    assert got[1].labels == ""


def test_whole_license_texts_get_their_label(spark):
    got = licenses.scan(docs_of(spark, [text for _, text in TEXTS])).collect()
    for r in got:
        assert TEXTS[r.doc_id][0] in r.labels.split(",") and r.score == 1.0


def test_a_very_long_text(spark):
    text = "word " * 30_000 + TEXTS[0][1] + " end" * 10_000
    r = licenses.scan(docs_of(spark, [text])).first()
    assert r.labels == "mit" and {s.first for s in r.spans} == {30_000}


BASE = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
    FROM '{path}'),
  phrases(label, ps) AS (VALUES ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])),
  hits AS (SELECT doc_id, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + len(ps)] = ps)) AS place FROM w, phrases)
  SELECT w.doc_id, len(ws), count(place), min(place), max(place), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '')
  FROM w LEFT JOIN hits USING (doc_id) GROUP BY w.doc_id, len(ws)"""


def test_base_columns_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.01"
    want = duckdb.sql(BASE.format(path=f"{folder}/documents.parquet")).fetchall()
    got = queries.op3_licenses(spark, folder).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == sorted(want)
