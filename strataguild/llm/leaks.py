"""Secret scans: fixed forms, and strings that a tokenizer's vocabulary can't shorten."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base forms and the least length of what they find (of the value, for an assignment).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
FORMS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
METHOD = "random"

#: Strings that are looked at: this many characters of key alphabets in a row.
SHORTEST = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
#: Characters a token below which a string is random.  English words have 4 and more, words of other languages and
#: identifiers above 2.2; random letters and digits of both cases about 1.4, random small letters and digits 1.7.
RATIO = 1.9
#: Characters that are tokenized at once, so that a very long string costs no more than its length.
PIECE = 256
#: Lengths of digests in hexadecimal digits (128 to 512 bits).
DIGESTS = {32, 40, 48, 56, 64, 96, 128}
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Identifiers that look random but are names: UUIDs, numbers and dates, names built of words.
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
NUMBERS = re.compile(r"[0-9+/_-]+=*")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

Span = tuple[str, int, int]


class Meter:
    """Characters a token under a byte-pair vocabulary."""

    def __init__(self, path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("leaks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, text: str) -> float:
        n = sum(len(self.coder.encode_ordinary(text[i : i + PIECE])) for i in range(0, len(text), PIECE))
        return len(text) / n


def is_name(text: str) -> bool:
    """Known digests and identifiers: no secret, however random they look."""
    body = text.rstrip("=")
    if HEXADECIMAL.fullmatch(body) and len(body) in DIGESTS or UUID.fullmatch(body) or NUMBERS.fullmatch(text):
        return True
    # Letters of one case without digits are words; so are names whose parts are mostly whole words.
    if body.isalpha() and (body.islower() or body.isupper() or body[1:].islower()):
        return True
    parts = PARTS.findall(body)
    return len(body) >= 4 * len(parts)


def base_spans(text: str) -> list[Span]:
    """Finds of the base forms, by kind: leftmost, without overlaps inside a kind; what is too short is dropped."""
    return [(kind, *m.span()) for kind, form, group, least in FORMS for m in form.finditer(text) if m.end(group) - m.start(group) >= least]


def random_spans(text: str, meter: Meter, taken: list[Span], ratio: float = RATIO) -> list[Span]:
    """Strings below ``ratio`` characters a token that no base find touches and that are no names."""
    out = []
    held = sorted((s, e) for _, s, e in taken)
    at = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(held) and held[at][1] <= start:
            at += 1
        if any(s < end and e > start for s, e in held[at : at + 3]):
            continue
        if not is_name(m[0]) and meter.ratio(m[0]) < ratio:
            out.append((METHOD, start, end))
    return out


def scan(docs: DataFrame, keys: list[str], path: str | None = None, ratio: float = RATIO) -> DataFrame:
    """``keys`` and the ``spans`` (kind, start, end in code points, end exclusive; by start, then kind) of every text.

    Kinds are ``assign``, ``access`` and ``hex`` by their forms and ``random`` by the token test: a string of
    ``SHORTEST`` or more key characters is a secret if the vocabulary in the file ``path`` gives it fewer than ``ratio``
    characters a token, unless it is a digest of a usual length, a UUID, a number or a name built of words.  Base finds
    stay as they are; what touches one is not reported again.  Null and empty texts have none.  Repeated rows are
    answered one by one; other columns are ignored; an empty table gives no rows.  Texts are taken whole.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    n = len(keys)
    rank = {kind: i for i, kind in enumerate([f[0] for f in FORMS] + [METHOD])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = None
        for batch in batches:
            meter = meter or Meter(path)
            kinds, starts, ends, sizes = [], [], [], []
            for value in batch.column(n):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + random_spans(text, meter, base, ratio), key=lambda x: (x[1], rank[x[0]]))
                sizes.append(len(spans))
                kinds += [x[0] for x in spans]
                starts += [x[1] for x in spans]
                ends += [x[2] for x in spans]
            offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
            one = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + [pa.ListArray.from_arrays(offsets, one)], names=[*keys, "spans"])

    names = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    rows = docs.select(*keys, F.col("text").cast("string").alias("body_"))
    return rows.mapInArrow(run, f"{names}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def secret_rows(docs: DataFrame) -> DataFrame:
    """Counts and digests of the finds of every document."""
    found = scan(docs, ["doc_id"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda x: x["kind"] != METHOD)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
