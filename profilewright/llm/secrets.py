"""Secret scans: three fixed patterns, and tokens that a character Markov model of random strings explains better than one of ordinary identifiers."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, with_results

#: The base patterns, their kinds in order, and least lengths.
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

#: What the models judge: runs of key characters of this length or more.
LEAST_TOKEN = 20
#: Mean log-likelihood ratio per character, in nats, from which a token counts as random.
LEAST_RATIO = 0.4
_TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}"
_CLASSES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

# Words of ordinary identifiers as programmers choose them; the labelled sample is made of them by rule, without a look at any table that is judged.
_PARTS = """
account action address amount array author balance batch block branch buffer button cache calendar category channel client cluster
column command comment commit config connection container content context controller counter country course customer database date
default delete depth device dialog directory document domain driver editor element email engine entry error event example export
factory feature field file filter folder format frame function gateway global graph group handle header height history image import
index input insert instance integer item iterator journal kernel keyboard label language layer layout length level library license
limit link list listener location logger manager mapping master matrix measure member memory message method metric migration minute
model module monitor mutex name network node notify number object offset option order output package packet page parameter parent
parser partition password path pattern payment pixel player plugin pointer policy position prefix process product profile project
property protocol provider public query queue random range reader record reference region register release remote render report
request resource response result return router sample schedule schema screen search second section segment select sequence server
service session setting shadow signal simple singleton size source spark special stack stage standard state static status storage
stream string structure student style submit subscribe summary support switch symbol system table target template terminal thread
threshold ticket timeout timestamp title token toolbar total tracker transaction transfer transform trigger update upload user
utility validate value variable vector version video view virtual visitor warning weather widget window worker wrapper writer
""".split()  # fmt: skip


def labelled_tokens(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """The labelled sample, by rule: ``n`` ordinary identifiers (0) and ``n`` random strings (1)."""
    rng, rows = random.Random(seed), []
    joins = (
        lambda p: "_".join(p), lambda p: "-".join(p), lambda p: "".join(x.capitalize() for x in p), lambda p: "".join(p), lambda p: "_".join(p).upper(), lambda p: "/".join(p),
        lambda p: p[0] + "".join(x.capitalize() for x in p[1:]), lambda p: "_".join(p) + "_" + str(rng.randint(1, 2030)), lambda p: "-" * 6 + p[0] + "=" * 6,
    )
    alphabets = (_CLASSES[:62], _CLASSES[:62], _CLASSES[:64], "0123456789abcdef", _CLASSES[:26] + _CLASSES[52:62], _CLASSES[26:62])
    for i in range(n):
        rows.append((joins[i % len(joins)](rng.choices(_PARTS, k=rng.randint(2, 5))), 0))
        rows.append(("".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 48))), 1))
    return rows


class Markov:
    """Log-likelihood ratio, random over ordinary, of each character after the one before."""

    def __init__(self, table: np.ndarray, classes: np.ndarray):
        self.table, self.classes = table, classes

    def ratio(self, token: str) -> float:
        """Mean over the token's characters."""
        codes = self.classes[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]
        return float(self.table[np.concatenate([[len(self.table) - 1], codes[:-1]]), codes].mean())


def train(labelled: list[tuple[str, int]] | None = None, smoothing: float = 0.5) -> Markov:
    """Bigram counts of each class of the labelled tokens with additive smoothing. Bounded by the sample given; it lies on the driver."""
    k = len(_CLASSES) + 1  # the last is any other character, and as a row also the start
    classes = np.full(256, k - 1, np.int64)
    for i, c in enumerate(_CLASSES):
        classes[ord(c)] = i
    logs = []
    for label in (0, 1):
        counts = np.full((k, k), smoothing)
        for token, its in labelled or labelled_tokens():
            if its == label:
                codes = classes[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]
                np.add.at(counts, (np.concatenate([[k - 1], codes[:-1]]), codes), 1)
        logs.append(np.log(counts / counts.sum(axis=1, keepdims=True)))
    return Markov(logs[1] - logs[0], classes)


def find_spans(text: str, model: Markov, least_ratio: float = LEAST_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind's place in ``KINDS``, end) in code points, sorted. Base spans first, by the fixed patterns; a random token that touches none is added."""
    low = text.lower()
    spans = [(m.start(), 0, m.end()) for m in _RE["assign"].finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]] if any(k in low for k in _KEYWORDS) else []
    spans += [(m.start(), 1, m.end()) for m in _RE["access"].finditer(text) if m.end() - m.start() >= LEAST["access"]]
    spans += [(m.start(), 2, m.end()) for m in _RE["hex"].finditer(text)]
    spans.sort()
    base, at, reach = spans[:], 0, 0
    for m in _RE["token"].finditer(text):
        while at < len(base) and base[at][0] < m.end():  # spans that begin before the token's end, and how far they reach
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= m.start() and model.ratio(m.group()) >= least_ratio:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def best_ratio(text: str, model: Markov) -> float | None:
    """The largest ratio of the text's tokens, wherever they lie; None without a token."""
    return max((model.ratio(m.group()) for m in _RE["token"].finditer(text)), default=None)


# A run of hex digits is taken whole, so asking for the least length inside the pattern finds the same spans and skips the rest.
_RE = {"assign": re.compile(ASSIGN), "access": re.compile(ACCESS), "hex": re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}"), "token": re.compile(_TOKEN)}
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: Markov | None = None, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``docs`` with ``n_assign, n_access, n_hex, base_sha256, spans, best_ratio``; its other columns are kept, whatever their names, and every row.

    ``spans`` are ``kind:start:end`` by start, then kind, comma-joined. ``best_ratio`` is the largest log-likelihood ratio among the
    text's tokens, in base spans too; null without a token. Null is an empty text: no spans, and the digest of the empty string.
    Whole texts are scanned where they lie; nothing is shuffled.
    """
    model, columns = model or train(), {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string", "best_ratio": "double"}

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            rows = []
            for text in column:
                spans = find_spans(text or "", model, least_ratio)
                base = [s for s in spans if s[1] < 3]
                rows.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), best_ratio(text or "", model)))
            yield pd.DataFrame(rows, columns=list(columns))

    udf = F.pandas_udf(found, ", ".join(f"{c} {kind}" for c, kind in columns.items()))
    return with_results(docs, udf(F.col("text")), {c: c for c in columns})


def redact(docs: DataFrame, mark: str = "[SECRET]", model: Markov | None = None, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``, overlapping ones by one; all rows and columns are kept, null stays null."""
    model = model or train()

    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(lambda text: text if text is None else _replaced(text, find_spans(text, model, least_ratio), mark))

    return docs.withColumn("text", F.pandas_udf(cleaned, "string")(F.col("text")))


def _replaced(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def n_chars(text: Column) -> Column:
    return F.char_length(text).cast("long")


def op7_secret_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_base_counts(spark, sf_dir):
    """What does not depend on the models: the base spans of every document by kind, by the same operator."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_assign", "n_access", "n_hex")


_EITHER_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
OP7_COUNTS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '({_EITHER_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= {LEAST['assign']})) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(text, '{ACCESS}'), lambda x: length(x) >= {LEAST['access']})) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(text, '{HEX}'), lambda x: length(x) >= {LEAST['hex']})) AS BIGINT) AS n_hex FROM d
"""
