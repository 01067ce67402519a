"""Operators 11 to 13 against brute force, with awkward rows."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilewright import scratch
from profilewright.llm import elkan, suffix_tree, whitening
from profilewright.llm.textops import Hasher, find_words
from tests.llm.test_texts import corpus, docs_of

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


# --- 11: suffix tree ---


def tokens(text):
    return BLANK.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


class BruteTree:
    """The tree with dictionaries of tuples, from its definition."""

    def __init__(self, texts, depth, share, least, discount):
        lists = [tokens(t) for t in texts]
        self.n, self.c = sum(map(len, lists)), Counter(w for ws in lists for w in ws)
        self.v, self.depth, self.discount = len(self.c), depth, discount
        grams = {w for w, c in self.c.items() if c >= share * self.n}
        self.words = set(grams)
        self.next, self.total, self.stays = {}, {(): self.n}, set()
        counts = Counter()
        for d in range(1, depth + 1):
            for ws in lists:
                for i in range(d, len(ws)):
                    counts[tuple(ws[i - d : i + 1])] += 1
        keep = {g: c for g, c in counts.items() if c >= max(least, share * self.n) and all(w in self.words for w in g)}
        single = {(w,): self.c[w] for w in self.words}
        for g, c in keep.items():
            self.next.setdefault(g[:-1], {})[g[-1]] = c
        for s in sorted(self.next, key=len):
            self.total[s] = single[s] if len(s) == 1 else keep[s]
            of = {x: c / self.total[s] for x, c in self.next[s].items()}
            shorter = {x: self.p(s[1:], x) for x in of}
            rest, rest_shorter = 1 - sum(of.values()), 1 - sum(shorter.values())
            gain = sum(p * math.log(p / shorter[x]) for x, p in of.items()) + (rest * math.log(rest / rest_shorter) if rest > 1e-12 else 0)
            if self.total[s] * gain > 0.5 * len(of) * math.log(self.total[s]):
                self.stays.add(s)

    def p(self, s, x):
        """Probability of x in the longest suffix of s that stayed."""
        while s and s not in self.stays:
            s = s[1:]
        if not s:
            return (self.c[x] + 1) / (self.n + self.v + 1)
        left = 1 - sum(c - self.discount for c in self.next[s].values()) / self.total[s]
        own = (self.next[s][x] - self.discount) / self.total[s] if x in self.next[s] else 0
        return own + left * self.p(s[1:], x)

    def score(self, text):
        ws = tokens(text)
        base = sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in ws)
        return len(ws), sum(self.c[w] > 0 for w in ws), self.n, base, sum(math.log10(self.p(tuple(ws[max(0, i - self.depth) : i]), w)) for i, w in enumerate(ws))


TEXTS = [None, "", " \t\n", "one", "ONE one One", "a b c d e f g", "x\x1fy x\x1fy", "é É ß ẞ", "the end . the end . the end ."] + ["she sells sea shells by the sea shore"] * 6 + ["sea shells by the shore " * 300]
LONG = " ".join(f"w{i * i % 97}" for i in range(60_000))


def tree_docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS + [r[1] for r in corpus(5)])] + [(900, LONG), (3, "one"), (None, "a b c d e f g"), (901, "never seen words of any text"), (902, "sea never " * 50)]
    return rows, docs_of(spark, rows).withColumns({"score": F.lit("mine"), "n_tokens": F.lit("mine"), "one": F.lit(1)})


@pytest.mark.parametrize("share", [2.0**-20, 1 / 400])
def test_scores_equal_a_tree_of_dictionaries(spark, share):
    rows, docs = tree_docs(spark)
    docs = docs.withColumn("held_out", suffix_tree.held_out(F.col("doc_id"))).repartition(5)
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    brute = BruteTree([t for i, t in rows if i is not None and not is_held(i)], 3, share, suffix_tree.LEAST, suffix_tree.DISCOUNT)
    model = suffix_tree.fit(docs.filter(F.col("doc_id").isNotNull() & ~F.col("held_out")), share=share)
    assert [int(x.stays.sum()) for x in model.tree.levels[:3]] == [sum(len(s) == d for s in brute.stays) for d in (1, 2, 3)] and brute.stays
    got = suffix_tree.score(docs, model)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "code", "hash", "key", "one", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted(got.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == len(rows)
    for r, (i, text) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        n, known, train, base, score = brute.score(text)
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, is_held(i), n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


@pytest.mark.parametrize("most", [1 << 20, 100, 10])
def test_whole_trees_are_scored_however_large_they_are(spark, monkeypatch, most):
    """Contexts that were learned twice count among any number of tokens, in a broadcast tree and in tables."""
    monkeypatch.setattr(suffix_tree, "HELD", most)
    monkeypatch.setattr(suffix_tree, "SHARE", 1 / 400)
    rows, docs = tree_docs(spark)
    twice = [(1000 + i, "only these two texts say so of a " + w) for i, w in enumerate(["kind", "kind"])]
    rows, docs = rows + twice, docs.unionByName(docs_of(spark, twice), allowMissingColumns=True)
    brute = BruteTree([t for i, t in rows if i is not None], 3, 0, suffix_tree.LEAST, suffix_tree.DISCOUNT)
    model = suffix_tree.fit(docs.filter(F.col("doc_id").isNotNull()).repartition(3))
    assert (model.weights is None) == (most == 1 << 20)
    got = sorted(suffix_tree.score(docs.repartition(5), model).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    for r, (i, text) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        n, known, train, base, score = brute.score(text)
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_what_a_step_of_a_large_tree_leaves_on_disk_goes(spark, monkeypatch):
    """Counted runs and levels are deleted when the next step has them; words and weights stay, and so do settings of the session."""
    monkeypatch.setattr(suffix_tree, "HELD", 10)
    own = scratch.own_dir(spark).removeprefix("file:")
    there = lambda: {x.rsplit("-", 1)[0] for x in set(os.listdir(own)) - old}
    scratch.materialize(spark.range(1), "lm-other")
    old = set(os.listdir(own))
    docs = docs_of(spark, [(i, t) for i, t in enumerate(TEXTS)])
    model = suffix_tree.fit(docs)
    assert there() - {"lm-ids"} == {"lm-words", "lm-weights"} and model.weights.count()
    assert suffix_tree.score(docs, model).count() == len(TEXTS)
    assert there() - {"lm-ids"} == {"lm-words", "lm-weights", "lm-totals"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_weights_of_a_large_tree_are_a_few_arrays(spark, monkeypatch):
    """However many runs have weights, they are a row a bucket and kind; buckets follow the learned tokens and not the tasks, and of a tree that is broadcast a step has what it needs."""
    monkeypatch.setattr(suffix_tree, "HELD", 10)
    model = suffix_tree.fit(docs_of(spark, [(i, t) for i, t in enumerate(TEXTS + [LONG, LONG])]))
    assert suffix_tree.buckets_for(model.tree.n_tokens) == 16 and suffix_tree.buckets_for(100 * suffix_tree.BUCKET) == 100
    rows = model.weights.collect()
    assert 0 < len(rows) <= 2 * 16 and sum(len(r["run"]) for r in rows) > 8 * 100
    assert [x.counts is None for x in model.tree.sent(scores=False).levels] == [True]


def test_probabilities_of_all_next_tokens_sum_to_one(spark):
    texts = [r[1] for r in corpus(3)] + ["sea shells by the sea shore"] * 9
    tree = suffix_tree.fit(docs_of(spark, list(enumerate(texts)))).tree
    words = tree.levels[0].keys
    hasher = Hasher(suffix_tree._SEED)
    for context in (["sea"], ["the", "sea"], ["shells", "by", "the"]):
        data = np.frombuffer(" ".join(context).encode(), np.uint8)
        starts, ends, _ = find_words(data, np.array([0, len(data)]))
        ids = suffix_tree.places(words, hasher.words(data, starts, ends))
        runs = np.concatenate([np.append(ids, x) for x in range(len(words))])
        begins = np.arange(len(runs)) % (len(ids) + 1) == 0
        p = 10 ** tree.log_probabilities(runs, begins)[len(ids) :: len(ids) + 1]
        left = 10 ** tree.log_probabilities(np.append(ids, -1), np.arange(len(ids) + 1) == 0)[-1]
        assert p.sum() + left / (tree.n_tokens + tree.n_distinct + 1) == pytest.approx(1, abs=1e-9) and p.min() > 0


def test_nothing_learned_and_nothing_to_score(spark):
    _, docs = tree_docs(spark)
    none = suffix_tree.fit(docs.filter("doc_id > 5000"))
    got = suffix_tree.score(docs.filter("doc_id in (1, 5)"), none).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(1, 0, 0, 0.0, 0.0), (8, 0, 0, 0.0, 0.0)]
    assert suffix_tree.score(docs.filter("doc_id > 5000"), none).count() == 0


# --- 12: Elkan ---


def brute_clusters(rows, k, rounds, dims):
    """(key, x) of usable rows to (key, cluster, distance, computed digest)."""
    usable = [(i, np.floor(np.array(v, float) * 64).astype(int)) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(usable, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist()))
    centres = [x.copy() for _, x in order[:k]]
    near = lambda x: min((int(((x - c) ** 2).sum()), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in usable]
        for j in range(len(centres)):
            mine = [x for (_, x), o in zip(usable, own, strict=True) if o == j]
            if mine:
                centres[j] = np.array([int(s) // len(mine) for s in sum(mine)])
    found = [(i, *near(x)[::-1]) for i, x in usable]
    per = Counter()
    for _, j, d in found:
        per[j] += d
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in found), key=repr)


VECTORS = "vec_id long, embedding array<float>, cluster string, x int, kept int, note string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, 2, None) for i, v in rows], VECTORS)


def cloud(n, dims, seed, grid=None):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.2, (n, dims)) + rng.integers(0, 4, (n, 1))
    return (v if grid is None else np.round(v * grid) / grid).tolist()


AWKWARD = [None, [], [0.5], [float("nan")] * 64, [None] * 64, [float("inf"), *[0.0] * 63], [1.0] * 65]


@pytest.mark.parametrize(("k", "grid", "rounds"), [(16, None, 3), (5, 0.5, 6), (40, 2, 3)])
def test_clusters_equal_brute_force_with_ties(spark, k, grid, rounds):
    """A coarse grid makes equal vectors, equal centroids and tied distances."""
    rows = [(i, v) for i, v in enumerate(AWKWARD + cloud(300, 64, k, grid))] + [(50, [2.0] * 64)] * 3 + [(None, [1.0] * 64)] * 2 + [(-7, [-3.015625] * 64), (60, [1000.25] * 64)]
    got = elkan.cluster(vectors_of(spark, rows).repartition(4), k, rounds)
    assert got.columns == ["vec_id", "x", "kept", "note", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed"]
    found = got.collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in found), key=repr) == brute_clusters(rows, k, rounds, 64)
    assert all(k <= r["computed"] <= (rounds + 1) * k for r in found)


def test_bounds_skip_distances_of_parted_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (10 * (i % 4) + rng.normal(0, 0.1, 64)).tolist()) for i in range(200)]
    found = elkan.cluster(vectors_of(spark, rows), 4, 5).agg(F.avg("computed")).first()[0]
    assert found < 12  # of 24


def test_few_vectors_none_and_too_large_ones(spark):
    one = elkan.cluster(vectors_of(spark, [(4, [0.25] * 64)])).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in one] == [(4, 0, 0, 0)]
    for rows in ([], list(enumerate(AWKWARD))):
        none = elkan.cluster(vectors_of(spark, rows))
        assert none.count() == 0 and "centroid_sha256" in none.columns
    with pytest.raises(Exception, match="larger than"):
        elkan.cluster(vectors_of(spark, [(4, [1e30] * 64)])).collect()


def test_bounds_are_rounded_away_from_the_truth():
    x = np.sqrt(np.random.default_rng(0).integers(0, 1 << 62, 100_000).astype(float))
    assert (elkan.above(x).astype(float) >= x).all() and (elkan.below(x).astype(float) <= x).all()
    assert elkan.below(np.array([-1.0, 0.0])).tolist() == [0, 0]


# --- 13: whitening ---


def brute_whitening(x, most=8):
    n, s = len(x), x.sum(axis=0)
    deviation = [sum(int(n * int(a) - int(t)) ** 2 for a, t in zip(row, s, strict=True)) for row in x]
    centred = (n * x - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return deviation, centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize(("parts", "fan"), [(1, 16), (9, 2)])
def test_whitening_equals_an_eigendecomposition(spark, parts, fan):
    rng = np.random.default_rng(8)
    v = (rng.normal(0, 0.3, (400, 12)) * np.linspace(1, 3, 12)).astype(np.float32)
    other = rng.normal(0, 1, (50, 3)).astype(np.float32)  # another length has its own fit
    rows = [(i, r) for i, r in enumerate(v.tolist())] + [(1000 + i, r) for i, r in enumerate(other.tolist())] + [(5, v[5].tolist()), (None, v[6].tolist())]
    bad = [(2000 + i, r) for i, r in enumerate([None, [], [float("nan")] * 12, [None] * 12, [float("-inf")] + [0.0] * 11])]
    df = vectors_of(spark, rows + bad).withColumns({"n": F.lit("mine"), "width": F.lit("w"), "whitened": F.lit(0)}).repartition(parts)
    got = whitening.whiten(df, whitening.fit(df, fan=fan))
    assert got.columns == ["vec_id", "cluster", "x", "kept", "note", "width", *whitening.RESULTS]
    got = got.toPandas()
    for mine, most in ((np.array([r for _, r in rows if len(r) == 12]), 8), (other, 3)):
        ids = [i for i, r in rows if len(r) == mine.shape[1]]
        x = np.floor(1024 * mine.astype(float)).astype(np.int64) + 100_000
        deviation, z, explained = brute_whitening(x, most)
        part = got[got["n"] == len(x)]
        assert len(part) == len(x) * most and sorted(part["component"].unique()) == list(range(1, most + 1))
        want = sorted((repr(None if i is None else float(i)), d, np.round(np.abs(r), 6).tolist()) for i, d, r in zip(ids, deviation, z, strict=True))
        part = part.assign(key=part["vec_id"].map(lambda i: repr(None if math.isnan(i) else float(i))), size=part["whitened"].abs().round(6))
        listed = part.sort_values("component")
        found = []
        for (key, d), group in listed.groupby(["key", "deviation"]):  # equal rows are taken apart by turns
            copies = len(group) // most
            found += [(key, d, [group["size"].iloc[c * copies] for c in range(most)])] * copies
        assert sorted((k, d) for k, d, _ in found) == sorted((k, d) for k, d, _ in want)
        assert np.allclose([r for *_, r in sorted(found)], [r for *_, r in want], atol=1e-5)
        assert np.allclose(part.groupby("component")["explained"].first(), explained, rtol=1e-9) and part["identity_error"].max() < 1e-9 and part["identity_error"].nunique() == 1


def test_signs_are_the_same_for_all_rows_and_ranks_may_be_short(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(0, 1, (60, 2)) @ rng.normal(0, 1, (2, 6))
    df = vectors_of(spark, [(i, (np.round(r * 64) / 64).tolist()) for i, r in enumerate(np.hstack([flat[:, :2], flat[:, :2]]))])
    got = whitening.whiten(df, whitening.fit(df)).toPandas()
    assert sorted(got["component"].unique()) == [1, 2] and got["identity_error"].max() < 1e-6
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(z.T @ z / 60, np.eye(2), atol=1e-6)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 4])
def test_no_spread_gives_no_rows(spark, rows):
    df = vectors_of(spark, rows)
    got = whitening.whiten(df, whitening.fit(df))
    assert got.count() == 0 and set(whitening.RESULTS) <= set(got.columns)


def test_sums_stay_exact_beyond_a_long():
    x = np.array([[1 << 40, 5], [-(1 << 40), 6]])
    u = whitening.scaled_deviations(x, 1 << 30, [0, 11])
    assert u.tolist() == [[1 << 70, (5 << 30) - 11], [-(1 << 70), (6 << 30) - 11]]
    assert whitening.square_sums(u).to_pylist() == [None, None]
    assert whitening.square_sums(np.array([[3_000_000_000, 1], [2, 3]], object)).to_pylist() == [9_000_000_000_000_000_001, 13]
    assert np.allclose(whitening.centred(x, 1 << 30, [0, 11])[:, 0], x[:, 0])
