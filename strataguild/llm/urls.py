"""URL filters: pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataguild.llm.common import map_batches

TOKEN = re.compile(r"[a-z0-9]+")
RULES_PER_BLOCK = 100_000


@dataclass(frozen=True)
class Rule:
    """A pattern over host and path (``example.org/path``); ``tokens`` are literals that every match contains."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool = False


def site_rule(name: str, action: str) -> Rule:
    """A rule ``host/path``: fits the host and its subdomains where the path starts with the rule's."""
    return Rule(name, action, r"^(?:[^/]*\.)?" + re.escape(name), tuple(TOKEN.findall(name.lower().rpartition("/")[0])), True)


def word_rule(word: str, action: str) -> Rule:
    """A rule for hosts with a label that is ``word`` or has it as a part between hyphens."""
    return Rule(f"*{word}*", action, rf"^[^/]*(?:^|[.-]){re.escape(word)}(?=[.-]|/|$)", tuple(TOKEN.findall(word)))


#: Given site rules, and word rules for hosts of kinds that a text corpus leaves out.
SITE_RULES = [site_rule(*x) for x in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))]
WORD_RULES = [word_rule(w, "block") for w in ("adult", "bets", "casino", "porn", "spam", "xxx")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), upper, upper.lower()), F.coalesce(path, F.lit(""))


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many rows of ``host, path`` each of the tokens occurs; a token of no row is left out."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    own = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit("[a-z0-9]+"), F.lit(0)))
    found = urls.select(F.explode(own).alias("token")).join(wanted, "token", "left_semi").groupBy("token").count()
    return {r["token"]: r["count"] for r in found.toLocalIterator()}


class Index:
    """Rules under their rarest token; rules without tokens are tried for every URL."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]) -> None:
        self.under: dict[str, list] = {}
        self.always = []
        for rule in rules:
            entry = (rule, re.compile(rule.pattern))
            if rule.tokens:
                self.under.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def match(self, host: str, path: str) -> list[Rule]:
        text = host + path
        tokens = set(TOKEN.findall(text.lower()))
        entries = [e for t in tokens if t in self.under for e in self.under[t]] + self.always
        return [rule for rule, pattern in entries if pattern.search(text)]


#: The indexes of the last call, once for each worker.
_KEPT: dict = {}


def judge_urls(pages: DataFrame, rules: list[Rule], keys: list[str], url: str = "url", per_block: int = RULES_PER_BLOCK) -> DataFrame:
    """``keys`` with ``host, path, rule, verdict, patterns`` for every row.

    The longest fitting site rule decides (``rule``); where none fits, any fitting blocking pattern blocks, else the
    page is allowed.  ``patterns`` lists the fitting pattern rules.  A first pass counts the rules' tokens over all
    URLs, so that each rule is kept under its rarest one; the second fetches the candidates of a URL by its tokens
    and runs only their expressions.  Rules are sent in blocks of ``per_block``.  A null URL or one without ``://``
    has an empty host and path and is allowed; repeated rows are judged one by one; other columns are ignored.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(*keys, host.alias("host"), path.alias("path"))
    counts = token_counts(rows, [t for r in rules for t in r.tokens])
    sc = pages.sparkSession.sparkContext
    blocks = [sc.broadcast((rules[i : i + per_block], counts)) for i in range(0, len(rules), per_block)]
    n = len(keys)

    name = uuid.uuid4().hex

    def indexes() -> list[Index]:
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = [Index(*b.value) for b in blocks]
        return _KEPT[name]

    def step(batch: pa.RecordBatch) -> dict:
        hosts, paths = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
        out = {k: batch.column(i) for i, k in enumerate(keys)} | {"host": hosts, "path": paths}
        found = [[r for x in indexes() for r in x.match(h, p)] for h, p in zip(hosts, paths, strict=True)]
        sites = [max((r for r in f if r.site), key=lambda r: len(r.name), default=None) for f in found]
        extra = [sorted({r.name for r in f if not r.site}) for f in found]
        bad = [any(r.action == "block" for r in f if not r.site) for f in found]
        out["rule"] = [s and s.name for s in sites]
        out["verdict"] = [s.action if s else "block" if b else "allow" for s, b in zip(sites, bad, strict=True)]
        return out | {"patterns": extra}

    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    return map_batches(rows, step, f"{kinds}, host string, path string, rule string, verdict string, patterns array<string>")
