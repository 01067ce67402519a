"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1; an n-gram's vector binds (multiplies) its letters' vectors, each permuted by its
place; a text's vector bundles (adds) those of all its n-grams; a language's prototype bundles its texts. A text gets the
language whose prototype makes the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, with_results

DIM = 1024
N = 3
#: At most so many texts of a language are learned from; they are the first in a fixed hash order.
SAMPLE_PER_LANG = 1000
#: n-grams whose vectors are held at once, and n-grams of a text that are counted at once.
BLOCK, PIECE = 1024, 1 << 20
UNDETERMINED = "und"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def letter_vectors(letters: np.ndarray, dim: int = DIM) -> np.ndarray:
    """One row of +1 and -1 for each code point, always the same for the same one."""
    words = np.arange(dim // 64, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    bits = _mixed(_mixed(letters.astype(np.uint64) + np.uint64(1))[:, None] + words)
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, dim: int = DIM, n: int = N) -> np.ndarray:
    """Bound vectors of packed n-grams (21 bits a letter): the product of the letters' vectors, each rolled by its place."""
    out = None
    for k in range(n):
        letters, at = np.unique((grams >> (21 * (n - 1 - k))) & 0x1FFFFF, return_inverse=True)
        vectors = np.roll(letter_vectors(letters, dim), k, axis=1)[at]
        out = vectors if out is None else out * vectors
    return out.astype(np.float32)


class Alphabet:
    """Which code points are letters, looked up once for each 65536 of them."""

    def __init__(self):
        self.is_letter = np.zeros(0x110000, bool)
        self.known = np.zeros(0x110, bool)

    def mask(self, codes: np.ndarray) -> np.ndarray:
        for plane in np.unique(codes >> 12):
            if not self.known[plane]:
                self.known[plane] = True
                self.is_letter[plane << 12 : (plane + 1) << 12] = [chr(c).isalpha() for c in range(plane << 12, (plane + 1) << 12)]
        return self.is_letter[codes]


def gram_counts(text: str | None, alphabet: Alphabet, n: int = N) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct packed n-grams of the lower-cased text and their counts; runs of other characters, and the ends, are one blank. None without a letter."""
    parts, carry = [], np.zeros(1, np.int64)  # code 0 is the blank
    seen = False
    for i in range(0, len(text or ""), PIECE):
        codes = np.frombuffer(text[i : i + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        mask = alphabet.mask(codes)
        seen = seen or bool(mask.any())
        codes = np.concatenate([carry, np.where(mask, codes, 0)])
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        if i + PIECE >= len(text):
            codes = np.concatenate([codes, np.zeros(1, np.int64)]) if codes[-1] else codes
        if len(codes) >= n:
            grams = codes[: len(codes) - n + 1].copy()
            for k in range(1, n):
                grams = (grams << 21) | codes[k : len(codes) - n + 1 + k]
            parts.append(np.unique(grams, return_counts=True))
        carry = codes[-(n - 1) :]
    if not seen:
        return None
    if len(parts) == 1:
        return parts[0]
    if not parts:  # one letter or two
        return np.array([int(c) for c in carry[-1:]]), np.ones(1, np.int64)
    grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


class Bundler:
    """Text vectors of batches; vectors of n-grams that recur are kept, up to a bound."""

    def __init__(self, dim: int = DIM, n: int = N, keep: int = 2048):
        self.dim, self.n, self.keep, self.alphabet = dim, n, keep, Alphabet()
        self.grams, self.vectors = np.zeros(0, np.int64), np.zeros((0, dim), np.float32)

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == grams if len(self.grams) else np.zeros(len(grams), bool)
        if known.all():
            return self.vectors[at]
        out = np.empty((len(grams), self.dim), np.float32)
        out[known] = self.vectors[at[known]]
        out[~known] = fresh = gram_vectors(grams[~known], self.dim, self.n)
        if len(self.grams) + len(fresh) <= self.keep:
            self.grams = np.concatenate([self.grams, grams[~known]])
            order = np.argsort(self.grams)
            self.grams, self.vectors = self.grams[order], np.concatenate([self.vectors, fresh])[order]
        return out

    def bundle(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """A vector for each text, and which of them have a letter."""
        out, some = np.zeros((len(texts), self.dim), np.float32), np.zeros(len(texts), bool)
        rows, grams, counts = [], [], []
        for i, text in enumerate(texts):
            if (found := gram_counts(text, self.alphabet, self.n)) is not None:
                some[i] = True
                rows.append(np.full(len(found[0]), i)), grams.append(found[0]), counts.append(found[1])
        if not rows:
            return out, some
        rows, grams, counts = np.concatenate(rows), np.concatenate(grams), np.concatenate(counts)
        names, at = np.unique(grams, return_inverse=True)
        order = np.argsort(at, kind="stable")
        rows, at, counts = rows[order], at[order], counts[order]
        edges = np.searchsorted(at, np.arange(0, len(names) + BLOCK, BLOCK))
        for b in range(len(edges) - 1):
            part = slice(edges[b], edges[b + 1])
            block = names[b * BLOCK : (b + 1) * BLOCK]
            dense = np.zeros((len(texts), len(block)), np.float32)
            dense[rows[part], at[part] - b * BLOCK] = counts[part]
            out += dense @ self._vectors(block)
        return out, some


def _batches(texts: list, rows: int = 128, chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and j - i < rows and (j == i or size + len(texts[j] or "") <= chars):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def learning_sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """At most ``per_lang`` rows of each language, by a hash of doc_id. A first cut by share of the hash range bounds what is ranked."""
    sizes = docs.groupBy("lang").count()
    order = F.xxhash64(F.col("doc_id").cast("string"))
    share = (F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30))) <= 2.0 * per_lang / F.col("count")
    near = docs.join(F.broadcast(sizes), "lang").filter(share)  # one row a language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    return near.withColumn("place", place).filter(F.col("place") <= per_lang).select("lang", "text")


def learn(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, dim: int = DIM, n: int = N) -> dict[str, np.ndarray]:
    """Prototypes from ``lang, text``: a bundle of at most ``per_lang`` texts of each language, of length one. A few vectors come to the driver."""

    def bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundler, sums = Bundler(dim, n), {}
        for frame in batches:
            texts, langs = list(frame["text"]), list(frame["lang"])
            for i, j in _batches(texts):
                vectors, _ = bundler.bundle(texts[i:j])
                norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                for vector, lang in zip(vectors / norms, langs[i:j], strict=True):
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    parts = learning_sample(docs, per_lang).repartition(16).mapInPandas(bundled, "lang string, vector array<double>")
    total = parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = {}
    for row in total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        vector = np.array([p["x"] for p in row["v"]])
        if norm := np.linalg.norm(vector):
            found[row["lang"]] = (vector / norm).astype(np.float32)
    return dict(sorted(found.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM, n: int = N, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with the best prototype, 0 at least; its other columns are kept.

    ``und`` with score 0 for a null text, one without a letter, or with nothing learned. Ties go to the first name. Texts are
    read whole, in pieces of bounded size; nothing is shuffled. ``into`` gives the two columns other names; columns of these
    names in ``docs`` give way, any others may have any name.
    """
    names, matrix = list(prototypes), np.stack(list(prototypes.values())) if prototypes else np.zeros((0, dim), np.float32)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bundler = Bundler(dim, n)
        for column in batches:
            texts = list(column)
            langs, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            for i, j in _batches(texts) if names else ():
                vectors, some = bundler.bundle(texts[i:j])
                cosines = vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                best = cosines.argmax(axis=1)
                langs[i:j] = np.where(some, np.array(names, object)[best], UNDETERMINED)
                scores[i:j] = np.where(some, np.clip(cosines[np.arange(j - i), best], 0, 1), 0)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    guess = F.pandas_udf(scored, "lang_pred string, score double")
    return with_results(docs, guess(F.col("text")), {"lang_pred": into[0], "score": into[1]})


def held_out(doc_id: Column) -> Column:
    """Every fourth document by crc32 of its id; a null id is not held out, and never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_unheld(docs: DataFrame) -> dict[str, np.ndarray]:
    return learn(docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text"))


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    prototypes = learn_unheld(docs)
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), prototypes).drop("text")
