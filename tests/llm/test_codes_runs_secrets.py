"""Vector codes, periodic runs and secret scans against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from strataguild.llm import leaks, runs, vectors

SCHEMA = "doc_id long, text string, best string, runs long, spans int, body string, n_words string, kind string"
EDGE = [(1, None), (2, ""), (3, "   \n"), (4, "word"), (4, "word"), (None, "a text without id")]


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def docs_of(spark, rows):
    """Documents with columns that clash with names the operators use."""
    return spark.createDataFrame([(a, b, "x", 7, 3, "y", "z", "k") for a, b in rows], SCHEMA)


# --- Vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes by full comparison in Python integers; rows are (vec_id, vector, label)."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c)), j) for j, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(r[1], p)[1] for r in kept]
            fresh = []
            for j, c in enumerate(books[p]):
                mine = [cut(r[1], p) for r, k in zip(kept, own) if k == j]
                fresh.append([sum(x) // len(mine) for x in zip(*mine)] if mine else c)
            books[p] = fresh
    out = []
    for i, v, lab in kept:
        best = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), lab))
    return out, books


def random_vectors(n, width=24, seed=5):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(7, width))
    rows = [(i, [float(np.float32(x)) for x in centres[g.integers(7)] + g.normal(scale=0.3, size=width)], int(g.integers(4))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] + [0.0] * (width - 1), 1), (n + 2, [float("nan")] * width, 1), (n + 3, [float("inf")] * width, 2)]
    # Repeated rows, ties, null labels and a null id.
    rows += [rows[3], rows[3], (5, rows[6][1], None), (None, rows[7][1], None), (n + 4, [-0.5 / 4096] * width, None)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int, code string, error int, x string"


@pytest.mark.parametrize("block", [4096, 7])
def test_vector_codes_match_full_comparison(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = random_vectors(150)
    df = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], VECTORS).repartition(5)
    got = vectors.code_rows(df).collect()
    want, books = plain_codes(rows)
    by_label = {}
    for _, _, e, lab in want:
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([tuple(r) for r in got], key=key) == sorted([(i, c, e, by_label[lab], digest) for i, c, e, lab in want], key=key)


def test_bounds_save_comparisons_and_stay_true():
    """Codes equal a full scan in every round, bounds never exceed true distances, and few groups are compared late."""
    g = np.random.default_rng(2)
    centres = g.integers(-3000, 3000, size=(16, 16))
    x = (centres[g.integers(16, size=3000)] + g.integers(-300, 300, size=(3000, 16))).astype(np.int16).reshape(3000, 2, 8)
    books = vectors.Codebooks([x[:16].transpose(1, 0, 2).astype(np.int64)])
    state = vectors.State.fresh(3000, 2, 16)
    scanned = []
    for _ in range(8):
        nearest, n = vectors.assign(x, books, state)
        scanned.append(n)
        full = ((x[:, :, None, :].astype(np.int64) - books.now[None]) ** 2).sum(axis=3)
        assert (state.codes == full.argmin(axis=2)).all() and (nearest == full.min(axis=2)).all()
        others = full.astype(float)
        np.put_along_axis(others, state.codes[:, :, None].astype(np.int64), np.inf, axis=2)
        per_group = np.sqrt(others.reshape(3000, 2, 4, 4).min(axis=3))
        moved = books.moved()
        now = np.stack([[state.bounds[:, p, k] - moved[state.stamps[:, p, k], p, k] for k in range(4)] for p in range(2)]).transpose(2, 0, 1)
        assert (now <= per_group * (1 + 1e-6)).all()
        sums = vectors.part_sums(x, state.codes, 16)
        count = sums[:, :, 8:]
        books.history.append(np.where(count > 0, sums[:, :, :8] // np.maximum(count, 1), books.now))
    assert scanned[0] == 3000 * 2 * 16
    assert scanned[-1] < 0.5 * scanned[0]


def test_net_displacement_is_tighter_than_drifts():
    steps = [np.zeros((1, 4, 2), np.int64), np.full((1, 4, 2), 30), np.full((1, 4, 2), 2)]
    moved = vectors.Codebooks(steps).moved()
    assert moved[0, 0, 0] == pytest.approx(math.sqrt(8)) and moved[0, 0, 0] < math.sqrt(1800) + math.sqrt(2 * 28**2)


def test_vector_code_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vectors.code_rows(empty).count() == 0
    few = spark.createDataFrame([(i, [float(i)] * 8, None, "a", 1, "b") for i in (3, 1)], VECTORS)
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in vectors.code_rows(few).orderBy("vec_id").collect()] == [(1, "00" * 8, 0, 0), (3, "01" * 8, 0, 0)]
    odd = spark.createDataFrame([(1, [1.0] * 8, 0, "a", 1, "b"), (2, [1.0] * 9, 0, "a", 1, "b"), (3, [], 0, "a", 1, "b")], VECTORS)
    assert [r.vec_id for r in vectors.code_rows(odd).collect()] == [1]
    with pytest.raises(ValueError, match="equal parts"):
        vectors.code_rows(spark.createDataFrame([(1, [1.0] * 9, 0, "a", 1, "b")], VECTORS))


# --- Periodic runs


def plain_runs(w, shortest=24, powers=3):
    """Every lag compared at every place."""
    out = []
    for q in range(1, len(w) // powers + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(shortest, powers * q):
                x = w[i : i + size]
                if not any(x[p:] == x[: size - p] for p in range(1, q)):
                    out.append((i, size, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + math.floor((n - a) / (3 + g % 8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id,
        len(found),
        *best,
        None if not found else 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
        sha(" ".join(x for i, x in enumerate(w) if i not in dropped)),
    )


def periodic_text(rnd):
    """Stretches of random words and of repeated ones, over few letters so that they also meet by chance."""
    letters = [chr(97 + i) for i in range(rnd.choice([1, 2, 3, 5, 20]))]
    w = []
    for _ in range(rnd.randrange(5)):
        w += [rnd.choice(letters) for _ in range(rnd.randrange(30))]
        period = [rnd.choice(letters) for _ in range(rnd.randrange(1, 12))]
        w += (period * 8)[: rnd.randrange(10, 50)]
    return rnd.choice([" ", "\n", "\t \r"]).join(w)


def test_periodic_runs_match_plain_version(spark):
    rnd = random.Random(8)
    rows = [(i, periodic_text(rnd)) for i in range(400)] + EDGE + [(500, "  a b " * 30), (501, "x " * 70)]
    got = runs.run_rows(docs_of(spark, rows).repartition(3)).drop("n_words").collect()
    want = [plain_row(*r) for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert sum(r[1] > 1 for r in want) > 10


@pytest.mark.parametrize("shortest,powers", [(4, 2), (10, 3), (24, 5), (50, 4)])
def test_runs_of_other_lengths(shortest, powers):
    rnd = random.Random(shortest)
    for _ in range(150):
        w = [b"%c" % (97 + rnd.randrange(rnd.choice([1, 2, 3]))) for _ in range(rnd.randrange(90))]
        ((_, got),) = runs.find_in([w], [None], shortest, powers)
        assert got == plain_runs(w, shortest, powers)


def test_rare_words_split_until_nothing_changes():
    """Three a, b and c each lie in one part only after the part of d has gone."""
    ids = np.array([0, 1, 0, 1, 9, 0, 1, 2, 2, 2, 2])
    assert runs.surviving(ids, np.array([0]), np.array([11]), shortest=4, powers=3) == [(7, 11)]
    ids = np.array([0, 1] * 6 + [9] + [2] * 12)
    assert sorted(runs.surviving(ids, np.array([0]), np.array([25]), 4, 3)) == [(0, 12), (13, 25)]


def test_very_long_texts_of_runs(spark):
    """A million words in one run, and a long text beside short ones; a tenth of the words as slices of a batch."""
    rows = [(1, "a b " * 300_000), (2, "one two"), (3, " ".join(str(i % 9973) for i in range(100_000)))]
    got = {r.doc_id: r for r in runs.find_runs(docs_of(spark, rows), ["doc_id"], texts=False).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 600_000, 2)] and got[2].runs == []
    assert [tuple(r) for r in got[3].runs] == [(0, 100_000, 9973)]
    assert runs.find_runs(docs_of(spark, rows), ["doc_id"]).where("doc_id = 1").first().collapsed == "a b"


def test_run_edges(spark):
    assert runs.run_rows(docs_of(spark, [])).count() == 0
    got = runs.find_runs(docs_of(spark, EDGE), ["doc_id", "kind"]).orderBy("doc_id").collect()
    assert [(r.doc_id, r.kind, r.n_words, r.runs, r.best, r.collapsed) for r in got][1:4] == [(1, "k", 0, [], None, ""), (2, "k", 0, [], None, ""), (3, "k", 0, [], None, "")]
    assert len(got) == len(EDGE)


# --- Secrets


def plain_base(text):
    """Finds of the base forms, step by step from the left."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    value = set(alnum + "+/_.=-")
    out = []

    def assignment(at):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            piece = text[at : at + len(word)]
            if piece.isascii() and piece.lower() == word:
                i = at + len(word)
                if text[i : i + 1] in ('"', "'") and text[i : i + 1]:
                    i += 1
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] not in (":", "="):
                    continue
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] in ('"', "'") and text[i : i + 1]:
                    i += 1
                j = i
                while j < len(text) and text[j] in value:
                    j += 1
                if j > i:
                    return i, j
        return None

    at = 0
    while at < len(text):
        if found := assignment(at):
            if found[1] - found[0] >= 8:
                out.append(("assign", at, found[1]))
            at = found[1]
        else:
            at += 1
    at = 0
    while at < len(text):
        j = at + 4
        while text[at : at + 4] == "AKIA" and j < len(text) and text[j] in alnum[:26] + alnum[52:]:
            j += 1
        if j > at + 4:
            if j - at >= 16:
                out.append(("access", at, j))
            at = j
        else:
            at += 1
    at = 0
    while at < len(text):
        j = at
        while j < len(text) and text[j] in "0123456789abcdef":
            j += 1
        if j - at >= 32:
            out.append(("hex", at, j))
        at = max(at + 1, j)
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def random_secret_text(rnd):
    pieces = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "apikey", ":", "=", " ", "  ", '"', "'", "AKIA", "akia", "ſecret", "toKen", "\U0001f600", "é"]
    pieces += ["".join(rnd.choices("0123456789abcdef", k=rnd.choice([5, 31, 32, 40]))), "".join(rnd.choices("ABCDEFGHIJ0123456789", k=rnd.choice([3, 11, 12, 16]))), "abc.def-g_h", "\n"]
    return "".join(rnd.choices(pieces, k=rnd.randrange(14)))


def test_base_secrets_match_plain_version(spark):
    rnd = random.Random(4)
    rows = [(i, random_secret_text(rnd)) for i in range(1500)] + EDGE
    rows += [(2000, 'secret:token:abcdefghijk'), (2001, "token==abcdefgh"), (2002, "x" * 300_000 + " password = hunter2hunter2"), (2003, "AKIA" * 4)]
    got = leaks.secret_rows(docs_of(spark, rows).repartition(3)).collect()
    want = []
    for doc_id, text in rows:
        base = plain_base(text or "")
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        want.append((doc_id, *[sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")], digest))
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    assert sum(r[1] for r in want) > 50 and sum(r[2] for r in want) > 10 and sum(r[3] for r in want) > 50
    for r in got:
        spans = [x for x in r.spans.split(",") if x and not x.startswith(leaks.METHOD)]
        assert hashlib.sha256(",".join(spans).encode()).hexdigest() == r.base_sha256


def test_random_strings_are_found_and_names_are_not(spark):
    """Planted random strings against digests, identifiers, words, paths and numbers."""
    rnd = random.Random(6)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rnd.choices(base64, k=rnd.choice([24, 32, 40, 64]))) for _ in range(200)]
    keys += ["ghp_" + "".join(rnd.choices(base64[:62], k=36)) for _ in range(100)]
    names = [hashlib.sha1(str(i).encode()).hexdigest().upper() for i in range(50)]
    names += ["550e8400-e29b-41d4-a716-446655440000", "Donaudampfschifffahrtsgesellschaft", "2024-01-31_12-30-59-000001", "12345678901234567890123"]
    names += ["get_user_account_by_identifier", "HttpRequestHandlerFactoryBean", "https://example.com/articles/history/rivers", "internationalization", "MAXIMUM_CONNECTION_TIMEOUT"]
    rows = [(i, f"we keep {s} here, é") for i, s in enumerate(keys + names)]
    got = {r.doc_id: r.spans for r in leaks.scan(docs_of(spark, rows), ["doc_id"]).collect()}
    caught = sum([tuple(x) for x in got[i]] == [("random", 8, 8 + len(s))] for i, s in enumerate(keys))
    assert caught >= 0.97 * len(keys)
    assert [s for i, s in enumerate(names) if got[len(keys) + i]] == []
    assert leaks.random_spans("password = " + keys[0], leaks.Meter(_vocabulary()), leaks.base_spans("password = " + keys[0])) == []


def _vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_secret_edges(spark):
    assert leaks.secret_rows(docs_of(spark, [])).count() == 0
    got = leaks.secret_rows(docs_of(spark, EDGE)).collect()
    assert {(r.n_assign, r.n_access, r.n_hex, r.spans, r.base_sha256) for r in got} == {(0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    long = "zQ7" * 400_000
    assert [tuple(x) for x in leaks.scan(docs_of(spark, [(1, "a " + long + " z")]), ["doc_id"]).first().spans] == [("random", 2, 1_200_002)]
    both = leaks.scan(docs_of(spark, [(1, "\U0001f600 token=0123456789abcdef0123456789abcdef")]), ["doc_id"]).first().spans
    assert [tuple(x) for x in both] == [("assign", 2, 40), ("hex", 8, 40)]


def test_base_secrets_match_sql(spark, tmp_path):
    """Access keys and hex strings counted by another engine over the given table."""
    duckdb = pytest.importorskip("duckdb")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in leaks.secret_rows(docs).collect()}
    rows = duckdb.sql(
        r"""SELECT doc_id,
            len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)),
            len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)),
            len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32))
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM '/root/testdata/sf0.01/documents.parquet')"""
    ).fetchall()
    assert got == {r[0]: r[1:] for r in rows}
