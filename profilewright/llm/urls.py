"""URL filter: rules by host and path, and for the rest a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: The rules of the query, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# The labelled words are names of categories in published lists of URLs by category, taken as they stand: those that such lists
# are used to block, and others. They were chosen without a look at the tables that are judged.
_BLOCKED = """
adult adv aggressive anonvpn costtraps cryptojacking dangerousmaterial dating ddos dialer drugs gamble gambling hacking lingerie
malware marketingware mixedadult phishing porn publicity redirector ringtones sect sex spyware stalkerware tracker violence warez weapons
""".split()
_ALLOWED = """
astrology automobile bank blog celebrity chat child cleaning cooking education examination filehosting finance forum games government
hobby homestyle hospitals imagehosting jobsearch library manga military movies music news podcasts politics press radio recreation
religion science searchengines shopping socialnet sports translation update webmail webradio webtv
""".split()
_PREFIXES = ("", "www.", "m.", "blog.")


def labelled_urls() -> pd.DataFrame:
    """The small labelled table, ``word, host, path, blocked``: each word alone and in longer names, as a host and in the path, by one rule for both labels."""
    rows = []
    for label, words in ((1, _BLOCKED), (0, _ALLOWED)):
        for i, word in enumerate(words):
            for j, name in enumerate((word, f"{word}24", f"my-{word}", f"{word}-online", f"best{word}", f"{word}hub")):
                end = ("example.com", "example.net", "example.org", "example")[(i + j) % 4]
                path = ("/", "/index.html", f"/{word}/", f"/en/{word}/1.html", "/about", f"/p/{j}?ref={word}")[(i + j) % 6]
                rows.append((word, f"{_PREFIXES[(i + j) % 4]}{name}.{end}", path, label))
    return pd.DataFrame(rows, columns=["word", "host", "path", "blocked"])


class Model:
    """Weights of 2**bits buckets and a bias."""

    def __init__(self, bits: int, sizes: tuple[int, ...], weights: np.ndarray, bias: float):
        self.bits, self.sizes, self.weights, self.bias = bits, sizes, weights, bias


def features(hosts: list[str], paths: list[str], bits: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram of ``^host$`` and ``^path$``; the two have buckets apart."""
    rows, buckets = [], []
    for salt, texts in ((0x9E3779B97F4A7C15, hosts), (0xC2B2AE3D27D4EB4F, paths)):
        data = [np.frombuffer(f"^{t}$".encode("utf-8", "replace"), np.uint8) for t in texts]
        lengths = np.array([len(d) for d in data], dtype=np.int64)
        flat = np.concatenate(data).astype(np.uint64) if data else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(texts)), lengths)
        for n in sizes:
            if len(flat) < n:
                continue
            code = np.full(len(flat) - n + 1, (salt * n) & 0xFFFFFFFFFFFFFFFF, np.uint64)
            for k in range(n):
                code = (code ^ flat[k : len(flat) - n + 1 + k]) * np.uint64(0x100000001B3)
                code ^= code >> np.uint64(29)
            same = row[: len(code)] == row[n - 1 :]
            rows.append(row[: len(code)][same])
            buckets.append((code[same] >> np.uint64(64 - bits - 8)).astype(np.int64) & ((1 << bits) - 1))
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def train(labelled: pd.DataFrame, bits: int = 14, sizes: tuple[int, ...] = (3, 4), steps: int = 300, rate: float = 4.0, decay: float = 1e-4) -> Model:
    """Full-batch gradient descent on the logistic loss; each URL's features are scaled to length one. The table is small: it lies on the driver."""
    row, bucket = features(list(labelled["host"]), list(labelled["path"]), bits, sizes)
    y, n = labelled["blocked"].to_numpy(float), len(labelled)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
    weights, bias = np.zeros(1 << bits), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, weights[bucket], n) * scale + bias)))
        err = (p - y) / n
        weights -= rate * n / 100 * (np.bincount(bucket, (err * scale)[row], 1 << bits) + decay * weights)
        bias -= rate * err.sum()
    return Model(bits, sizes, weights, bias)


def probabilities(model: Model, hosts: list[str], paths: list[str]) -> np.ndarray:
    n = len(hosts)
    row, bucket = features(hosts, paths, model.bits, model.sizes)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
    return 1 / (1 + np.exp(-np.clip(np.bincount(row, model.weights[bucket], n) * scale + model.bias, -50, 50)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest of the rules that fit, as struct ``verdict, rule``; null if none. A rule fits its host and all subdomains, for paths that start with its path."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(found)
    return found


def judge(pages: DataFrame, model: Model | None = None, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """``page_id, url`` to ``page_id, host, path, rule, verdict, score``, a row for each row; ``score`` is the model's probability of ``block``.

    A null url, or one without ``://``, has empty host and path, no rule, and the model's verdict on empty names. Nothing is
    shuffled; batches of any length are scored in place.
    """
    model = model or train(labelled_urls())

    @F.pandas_udf("double")
    def blocked(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        out = np.zeros(len(hosts))
        for i in range(0, len(hosts), 2000):  # bounds the arrays of n-grams
            out[i : i + 2000] = probabilities(model, list(hosts[i : i + 2000]), list(paths[i : i + 2000]))
        return pd.Series(out)

    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("match", matched_rule(F.col("host"), F.col("path"), rules))
    scored = named.withColumn("score", blocked("host", "path"))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("match.rule").alias("rule"), F.coalesce("match.verdict", own).alias("verdict"), "score")


def op3_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


def op3_url_parts(spark, sf_dir):
    """What does not depend on the model: host, path and rule of every page, by the same operator."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule")


OP3_PARTS_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT * FROM (VALUES {", ".join(f"('{host}', '{path}')" for _, host, path in RULES)}) AS t(name, start)),
f AS (SELECT page_id, name || start AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(name || start) DESC) AS place FROM p JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start))
SELECT p.page_id, host, path, rule FROM p LEFT JOIN f ON f.page_id = p.page_id AND place = 1
"""
