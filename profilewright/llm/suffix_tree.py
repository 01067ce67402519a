"""Language-model scoring with a probabilistic suffix tree over words.

The tree's nodes are contexts: runs of up to ``DEPTH`` words before a token. A context stays if its next-token distribution
diverges from that of its longest suffix that stayed by more than its parameters cost; its distribution is smoothed with that
suffix's by absolute discounting, down to the counts of single tokens. A token is scored in the longest context that stayed.

Counts cover every learned text, and every context with a next token that was learned twice is in the tree. While no level has more
than ``HELD`` rows, the tree is collected and broadcast. Above, levels are tables: the tree's score of a text is a sum of weights of
its runs of tokens (``run_weights``), which are looked up by bucket of the runs' hashes. So are the exact counts of words that are not
broadcast; only for a tree that is broadcast whole a join of rows finds those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize, shuffles_once
from .common import private, table
from .textops import Hasher, find_words, first_of_runs, mixed, text_slices

#: Words of the longest context.
DEPTH = 3
#: Share of all learned tokens from which a word is broadcast where levels are tables; and the least number of times for a context with its next token.
SHARE, LEAST = 2.0**-20, 2
#: Taken off every count of a context, for its suffix.
DISCOUNT = 0.6
#: Rows of a level that are broadcast at most. A tree with more has its runs in tables, and is scored by a join.
HELD = 1 << 20
#: Bits of the broadcast map that leaves out of those lookups most runs the tree lacks; those it lets through are not found there.
MAP_BITS = 27
#: Pieces of that map, by the first bits of a hash, that are put together apart.
MAP_PIECES = 256
#: Parts of the texts, by their hash, that are scored one after another where levels are tables: the lookups of all texts are never on disk at once.
PARTS = 7
#: Learned tokens whose runs a bucket has, about; a task has a few in memory.
BUCKET = 1 << 19
#: Tokens whose counts a task holds before it sends them on.
FLUSH = 1 << 22

_BITS = 21
_END = 0  # in place of the hash of a word
_SEED = 11
_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Documents that are not learned from, by crc32 of their id; a null id is not held out, and never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key stands in the sorted keys; -1 where it doesn't."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    at[keys[at] != wanted] = -1
    return at


def decided(prefix: np.ndarray, counts: np.ndarray, total: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which contexts stay, what each leaves to its suffix, and the probabilities of the runs that stayed contexts give their last tokens. ``prefix`` has each run's place among the contexts, ``total`` their counts, ``shorter`` the last token's probability in the suffix."""
    n = len(total)
    seen = counts / total[prefix]
    sums = lambda x: np.bincount(prefix, x, n)
    rest, rest_shorter = 1 - sums(seen), 1 - sums(shorter)
    rest[rest < 1e-12] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        divergence = sums(seen * np.log(seen / shorter)) + np.where(rest > 0, rest * np.log(rest / np.maximum(rest_shorter, 1e-300)), 0)
        stays = (kinds := np.bincount(prefix, minlength=n)).astype(bool) & (total * divergence > 0.5 * kinds * np.log(total))
        left = 1 - sums((counts - DISCOUNT) / total[prefix])
    return stays, left, np.where(stays[prefix], (counts - DISCOUNT) / total[prefix] + left[prefix] * shorter, shorter)


@dataclass
class Level:
    """Runs of n tokens, by the place of their first n - 1 in the level before and their last token. ``p`` is the last one's probability in the longest suffix of the others that stayed."""

    keys: np.ndarray
    counts: np.ndarray | None
    p: np.ndarray | None = None
    suffix: np.ndarray | None = None
    #: log10 of what a run leaves to its suffix when it is a context that stayed, else 0.
    left: np.ndarray | None = None
    stays: np.ndarray | None = None


@dataclass
class Tree:
    """The levels, bounded by ``1 / SHARE`` rows each; all learned tokens and distinct ones are counted in ``n_tokens`` and ``n_distinct``."""

    n_tokens: int
    n_distinct: int
    levels: list[Level] = field(default_factory=list)

    def base(self, counts) -> np.ndarray:
        return (np.asarray(counts, float) + 1) / (self.n_tokens + self.n_distinct + 1)

    def sent(self, scores: bool) -> Tree:
        """What tasks need of it to find runs, and to score."""
        levels = [Level(x.keys, x.counts if scores and not n else None, *((x.p, None, x.left) if scores else ())) for n, x in enumerate(self.levels)]
        return Tree(self.n_tokens, self.n_distinct, levels)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add the next level, and decide which runs of the level before stay as contexts."""
        order = np.argsort(keys)
        new = Level(keys[order], counts[order])
        if not self.levels:
            new.p, new.suffix = self.base(new.counts), np.zeros(len(keys), np.int64)
        else:
            above = self.levels[-1]
            prefix, last = new.keys >> _BITS, new.keys & ((1 << _BITS) - 1)
            new.suffix = last if len(self.levels) == 1 else places(above.keys, above.suffix[prefix] << _BITS | last)
            above.stays, left, new.p = decided(prefix, new.counts, above.counts.astype(float), above.p[new.suffix])
            with np.errstate(divide="ignore", invalid="ignore"):
                above.left = np.where(above.stays, np.log10(left), 0.0)
        new.stays, new.left = np.zeros(len(keys), bool), np.zeros(len(keys))
        self.levels.append(new)

    def runs(self, ids: np.ndarray, begins: np.ndarray, up_to: int) -> list[np.ndarray]:
        """For n = 1 to ``up_to``, the place of the run of n tokens that ends at each token; -1 where it is not in the tree or would begin in another text."""
        out = [ids]
        for level in self.levels[1:up_to]:
            before, out_n = out[-1], np.full(len(ids), -1, np.int64)
            ok = np.flatnonzero((before[:-1] >= 0) & (before[1:] >= 0) & ~begins[1:])
            out_n[ok + 1] = places(level.keys, before[ok] << _BITS | ids[ok + 1])
            out.append(out_n)
        return out

    def log_probabilities(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; of a token below the share (-1), what its contexts leave to its count."""
        runs = self.runs(ids, begins, len(self.levels))
        out = np.zeros(len(ids))
        for n, (level, at) in enumerate(zip(self.levels, runs, strict=True)):
            known = at >= 0
            if n:  # longer contexts that lack the token leave it to their suffixes
                context = np.concatenate([[-1], runs[n - 1][:-1]])
                context[begins] = -1
                lacks = (context >= 0) & ~known
                out[lacks] += self.levels[n - 1].left[context[lacks]]
            out[known] = np.log10(level.p[at[known]])
        return out


def token_ids(words: np.ndarray, doc: np.ndarray, n_texts: int, vocabulary: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words (-1: below the share) and of an end after each text, and where texts begin among them."""
    first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_texts) + 1)])
    ids = np.full(first[-1], end, np.int64)
    ids[np.arange(len(words)) + doc] = places(vocabulary, words)
    return ids, first


def _counted(parts: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    keys, n = np.unique(np.concatenate(parts), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=names)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``text`` to ``word, n``: hashes of words, and the ends of texts."""
    hasher, held = Hasher(_SEED), []
    for batch in batches:
        for i, j, data, offsets in text_slices(batch.column("text"), lower=True):
            starts, ends, _ = find_words(data, offsets)
            held += [hasher.words(data, starts, ends), np.full(j - i, _END, np.uint64)]
            if sum(map(len, held)) >= FLUSH:
                yield _counted(held, ["word", "n"])
                held = []
    if held:
        yield _counted(held, ["word", "n"])


def coded_texts(words) -> Callable:
    """Batches ``text`` to ``ids``, one list of token ids a text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, vocabulary = Hasher(_SEED), words.value
        end = int(places(vocabulary, np.zeros(1, np.uint64))[0])
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column("text"), lower=True):
                starts, ends, doc = find_words(data, offsets)
                ids, first = token_ids(hasher.words(data, starts, ends), doc, j - i, vocabulary, end)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["ids"])

    return rows


def count_runs(tree) -> Callable:
    """Batches ``ids`` to ``key, n``: runs of one token more than the tree has, where both runs of one less are in it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = tree.value, []
        for batch in batches:
            lists = batch.column("ids")
            first, ids = np.asarray(lists.offsets) - lists.offsets[0].as_py(), np.asarray(lists.flatten()).astype(np.int64)
            begins = np.zeros(len(ids) + 1, bool)
            begins[first] = True
            at = known.runs(ids, begins[:-1], len(known.levels))[-1]
            ok = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & ~begins[1:-1])
            held.append(at[ok] << _BITS | ids[ok + 1])
            if sum(map(len, held)) >= FLUSH:
                yield _counted(held, ["key", "n"])
                held = []
        if held:
            yield _counted(held, ["key", "n"])

    return rows


def hashed_runs(words: np.ndarray, doc: np.ndarray, n_texts: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1 to ``longest``: hashes of all n tokens in a row of the words and an end after each text; which of them lie in one text; and its number."""
    tokens, text = np.full(len(words) + n_texts, _END, np.uint64), np.repeat(np.arange(n_texts), np.bincount(doc, minlength=n_texts) + 1)
    tokens[np.arange(len(words)) + doc] = words
    hashes = tokens
    for n in range(1, longest + 1):
        if n > 1:
            hashes = joined(hashes[:-1], hashes[1:])
        yield hashes, text[: len(hashes)] == text[len(tokens) - len(hashes) :], text[: len(hashes)]


def joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The hash of a run, by those of all but its last token and of all but its first."""
    return mixed(context * _ODD + suffix)


def mapped(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the map of ``map_of`` has."""
    at = (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def buckets_for(n_tokens: int) -> int:
    """Buckets over which arrays of runs are dealt: one for ``BUCKET`` learned tokens, however many tasks there are; so a share of a bucket has many runs."""
    return max(16, -(-n_tokens // BUCKET))


def dealt(buckets: int, hashes: np.ndarray, /, **columns: np.ndarray) -> pa.RecordBatch:
    """A row a bucket that has any of the hashes: its share of each column, as bytes, in the order given."""
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)  # 16 bits are sorted by their digits
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(first_of_runs(bucket))
    ends = np.append(first, len(order))[1:]
    shares = [pa.array([x[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()) for x in (c[order] for c in columns.values())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), *shares], names=["bucket", *columns])


def of_kind(kind: int, batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with a column ``kind``, and nulls in what else the schema has."""
    n = batch.num_rows
    have = {c: batch.column(c) for c in batch.schema.names} | {"kind": pa.array(np.full(n, kind, np.int32))}
    return pa.RecordBatch.from_arrays([have[f.name] if f.name in have else pa.nulls(n, f.type) for f in schema], schema=schema)


def gathered(table: pa.Table, **kinds) -> list[np.ndarray]:
    """The columns of a bucket, its shares put together."""
    return [np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in kinds.items()]


def merged_runs(buckets: int) -> Callable:
    """The runs of a bucket that were learned ``LEAST`` times, dealt by their suffixes."""

    def merged(bucket: pa.Table) -> pa.Table:
        context, suffix, n = gathered(bucket, context=np.uint64, suffix=np.uint64, n=np.int32)
        order = np.argsort(runs := joined(context, suffix))
        first = np.flatnonzero(first_of_runs(runs[order]))
        total = np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        at = order[first[total >= LEAST]]
        return pa.Table.from_batches([dealt(buckets, suffix[at], context=context[at], suffix=suffix[at], n=total[total >= LEAST])])

    return merged


def with_shorter(buckets: int) -> Callable:
    """A bucket's runs with the probability that their suffixes give their last tokens, dealt by their contexts; those whose suffix was not learned ``LEAST`` times go."""

    def found(runs: pa.Table, before: pa.Table) -> pa.Table:
        context, suffix, n = gathered(runs, context=np.uint64, suffix=np.uint64, n=np.int64)
        keys, p = gathered(before, run=np.uint64, p=np.float64)
        order = np.argsort(keys)
        at = places(keys[order], suffix)
        ok = at >= 0
        context, suffix = context[ok], suffix[ok]
        return pa.Table.from_batches([dealt(buckets, context, context=context, run=joined(context, suffix), n=n[ok], p=p[order][at[ok]])])

    return found


#: Kinds of rows: runs of a level with counts and probabilities; weights of runs; counts of words that are not broadcast. Lookups of texts have those of what they look up.
RUNS, WEIGHTS, WORDS = range(3)
_LEVEL = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("run", pa.binary()), ("n", pa.binary()), ("p", pa.binary())])
_LEVEL_SQL = "kind int, bucket int, run binary, n binary, p binary"


def placed_runs(buckets: int) -> Callable:
    """A bucket's contexts decided by their runs: the runs of the new level, and weights of them and of the contexts, each dealt by its hash."""

    def placed(runs: pa.Table, before: pa.Table) -> pa.Table:
        context, run, n, shorter = gathered(runs, context=np.uint64, run=np.uint64, n=np.int64, p=np.float64)
        keys, totals = gathered(before, run=np.uint64, n=np.int64)
        order = np.argsort(keys)
        at = places(keys[order], context)
        ok = at >= 0
        prefix, run, n, shorter = at[ok], run[ok], n[ok], shorter[ok]
        stays, left, p = decided(prefix, n, totals[order].astype(float), shorter)
        under = stays[prefix]
        gains = np.log10(p[under]) - np.log10(shorter[under]) - np.log10(left[prefix[under]])
        weighed, gains = np.concatenate([run[under], keys[order][stays]]), np.concatenate([gains, np.log10(left[stays])])
        return pa.Table.from_batches([of_kind(RUNS, dealt(buckets, run, run=run, n=n, p=p), _LEVEL), of_kind(WEIGHTS, dealt(buckets, weighed, run=weighed, p=gains), _LEVEL)])

    return placed


def dealt_words(buckets: int, tree: Tree, kind: int) -> Callable:
    """Batches ``word, n`` to the first level's runs, or to words that are looked up."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = Tree(tree.n_tokens, tree.n_distinct).base
        for batch in batches:
            run, n = batch.column("word").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            yield of_kind(kind, dealt(buckets, run, run=run, **({"n": n, "p": base(n)} if kind == RUNS else {"p": np.log10(n + 1.0)})), _LEVEL)

    return rows


def merged_weights(bucket: pa.Table) -> pa.Table:
    """A bucket's weights of each kind in one row, by ascending hash; those of a run are added up."""
    parts = []
    for kind in (WEIGHTS, WORDS):
        runs, weights = gathered(bucket.filter(pa.compute.equal(bucket["kind"], kind)), run=np.uint64, p=np.float64)
        keys, of = np.unique(runs, return_inverse=True)
        one = pa.RecordBatch.from_pydict({"bucket": bucket["bucket"][:1].combine_chunks(), "run": pa.array([keys.tobytes()], pa.binary()), "p": pa.array([np.bincount(of, weights, len(keys)).astype(float).tobytes()], pa.binary())})
        parts += [of_kind(kind, one, _LEVEL)] if len(keys) else []
    return pa.Table.from_batches(parts, _LEVEL)


def weights_of(vocabulary) -> Callable:
    """Batches of weights to ``word, weight``: of words that are broadcast."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, p in zip(batch.column("run").to_pylist(), batch.column("p").to_pylist(), strict=True):
                keys, p = np.frombuffer(run, np.uint64), np.frombuffer(p, np.float64)
                ok = places(vocabulary.value, keys) >= 0
                yield pa.RecordBatch.from_arrays([pa.array(keys[ok].view(np.int64)), pa.array(p[ok])], names=["word", "weight"])

    return rows


def looked_up(buckets: int) -> Callable:
    """A bucket's part of what each text gains by its runs, and by its words below the share, and how many of those were learned; dealt by texts."""

    def found(lookups: pa.Table, tables: pa.Table) -> pa.Table:
        rows, gains, words = [], [], []
        for kind in (WEIGHTS, WORDS):
            row, run = gathered(lookups.filter(pa.compute.equal(lookups["kind"], kind)), rows=np.int64, runs=np.uint64)
            keys, p = gathered(tables.filter(pa.compute.equal(tables["kind"], kind)), run=np.uint64, p=np.float64)
            at = places(keys, run)
            ok = at >= 0
            rows.append(row[ok]), gains.append(p[at[ok]]), words.append(np.full(int(ok.sum()), float(kind == WORDS)))
        rows, gains, words = (np.concatenate(x) for x in (rows, gains, words))
        of, place = np.unique(rows, return_inverse=True)
        sums = lambda x: np.bincount(place, x, len(of)).astype(float)
        return pa.Table.from_batches([dealt(buckets, mixed(of.view(np.uint64)), row=of, gained=sums(gains * (1 - words)), rare=sums(gains * words), seen=sums(words))])

    return found


def summed_gains(bucket: pa.Table) -> pa.Table:
    rows, *parts = gathered(bucket, row=np.int64, gained=np.float64, rare=np.float64, seen=np.float64)
    of, place = np.unique(rows, return_inverse=True)
    gained, rare, seen = (np.bincount(place, x, len(of)) for x in parts)
    return pa.table({"row": of, "gained": gained.astype(float), "rare": rare.astype(float), "seen": seen.astype(np.int64)})


def count_long_runs(level: int, bits, buckets: int) -> Callable:
    """Batches ``text`` to ``context, suffix, n`` by bucket: runs of ``level`` tokens by the hashes of all but their last and of all but their first, where the map has both."""

    def counted(held: list) -> pa.RecordBatch:
        context, suffix = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(runs := joined(context, suffix))
        first = np.flatnonzero(first_of_runs(runs := runs[order]))
        at, n = order[first], np.diff(np.append(first, len(runs)))
        return dealt(buckets, runs[first], context=context[at], suffix=suffix[at], n=n.astype(np.int32))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = Hasher(_SEED), []
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column("text"), lower=True):
                starts, ends, doc = find_words(data, offsets)
                *_, (shorter, _, _), (_, inside, _) = hashed_runs(hasher.words(data, starts, ends), doc, j - i, level)
                known = mapped(bits.value, shorter)
                inside = inside & known[:-1] & known[1:]
                held.append((shorter[:-1][inside], shorter[1:][inside]))
                if sum(len(x) for x, _ in held) >= FLUSH // 4:  # each has two hashes, and is sorted
                    yield counted(held)
                    held = []
        if held:
            yield counted(held)

    return rows


def run_weights(docs: DataFrame, counts: DataFrame, common: Column, tree: Tree, depth: int) -> DataFrame:
    """Arrays ``run, p`` by ``kind, bucket``: what each run of tokens adds to log10 of a text's base probability, by the same rules as ``Tree.add``, for trees of any size; and of words that are not ``common`` log10 of their count and one.

    A token in a context that stayed has the context's own probability of it, or else what it leaves to its suffix. So a run adds
    what its context leaves wherever it is such a context, and the rest of its last token's gain where it was learned. Those sums
    over all runs of a text are its score. What single words of the tree add is in its first level's ``left``.

    Runs go as arrays, by bucket: of their hash to be counted, of their suffix's for what that gives their last token, and of their
    context's, whose fate they decide together. Only those that were learned twice go on, so a context's have different last tokens.

    A run that was learned twice has a context and a suffix that were, so a level sends only runs of those, as far as a map can
    tell. What a step leaves behind, tables and shuffles, goes before the next one.
    """
    share, n, by = docs.sparkSession.sparkContext.broadcast, buckets_for(tree.n_tokens), "bucket"
    before = materialize(counts.filter(F.col("n") >= LEAST).select("word", "n").mapInArrow(dealt_words(n, tree, RUNS), _LEVEL_SQL), "lm-level")
    parts = [materialize(counts.filter(~common).select("word", "n").mapInArrow(dealt_words(n, tree, WORDS), _LEVEL_SQL), "lm-part")]
    for level in range(2, depth + 2):
        bits = share(map_of(before))
        runs = docs.select("text").mapInArrow(count_long_runs(level, bits, n), "bucket int, context binary, suffix binary, n binary").groupBy(by)
        runs = materialize(runs.applyInArrow(merged_runs(n), "bucket int, context binary, suffix binary, n binary"), "lm-runs")
        bits.destroy()
        with_p = runs.groupBy(by).cogroup(before.select(by, "run", "p").groupBy(by)).applyInArrow(with_shorter(n), "bucket int, context binary, run binary, n binary, p binary")
        with_p = materialize(with_p, "lm-shorter")
        discard(runs)
        placed = materialize(with_p.groupBy(by).cogroup(before.select(by, "run", "n").groupBy(by)).applyInArrow(placed_runs(n), _LEVEL_SQL), "lm-placed")
        discard(with_p, before)
        parts.append(materialize(placed.filter(F.col("kind") == WEIGHTS), "lm-part"))
        if level <= depth:
            before = materialize(placed.filter(F.col("kind") == RUNS), "lm-level")
        discard(placed)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    weights = materialize(every.groupBy(by).applyInArrow(merged_weights, _LEVEL_SQL), "lm-weights")
    discard(*parts)
    first = tree.levels[0]
    found = weights.filter(F.col("kind") == WEIGHTS).mapInArrow(weights_of(share(first.keys)), "word long, weight double").toArrow()
    first.left[places(first.keys, found["word"].to_numpy().view(np.uint64))] = found["weight"].to_numpy()
    return weights


def places_in_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of arrays ``run`` to ``piece, bits``: which bits of a piece they set."""
    for batch in batches:
        runs = np.frombuffer(b"".join(batch.column("run").to_pylist()), np.uint64)
        at = np.unique(runs >> np.uint64(64 - MAP_BITS)).astype(np.uint32)
        size = (1 << MAP_BITS) // MAP_PIECES
        cuts = np.searchsorted(at, np.arange(MAP_PIECES + 1) * size)
        pieces = np.flatnonzero(np.diff(cuts))
        yield pa.RecordBatch.from_arrays([pa.array(pieces.astype(np.int32)), pa.array([(at[cuts[k] : cuts[k + 1]] - k * size).astype(np.uint32).tobytes() for k in pieces], pa.binary())], names=["piece", "bits"])


def merged_map(piece: pa.Table) -> pa.Table:
    (at,) = gathered(piece, bits=np.uint32)
    out = np.zeros((1 << MAP_BITS) // MAP_PIECES, bool)
    out[at] = True
    return pa.table({"piece": piece["piece"][:1], "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})


def map_of(runs: DataFrame) -> np.ndarray:
    """A bit for the first ``MAP_BITS`` bits of each run's hash: ``2 ** MAP_BITS`` bits, whatever the number of runs."""
    found = runs.select("run").mapInArrow(places_in_map, "piece int, bits binary").groupBy("piece").applyInArrow(merged_map, "piece int, bits binary").toArrow()
    out = np.zeros((MAP_PIECES, (1 << MAP_BITS) // MAP_PIECES // 8), np.uint8)
    for piece, bits in zip(found["piece"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[piece] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


@dataclass
class Model:
    """The tree, and ``word, n``: exact counts of the learned words that are below its share. A tree of more than ``HELD`` rows a level has its words alone, and the rest as ``run_weights`` for runs of up to ``longest`` tokens."""

    tree: Tree
    rare: DataFrame
    weights: DataFrame | None = None
    longest: int = 0


def fit(docs: DataFrame, depth: int = DEPTH, share: float | None = None) -> Model:
    """Learn from every row of ``docs(text)``; null is an empty text, which is one end. Without rows every probability is that of no count at all.

    The tree has every word, and every context with a next token that was learned ``LEAST`` times; with ``share``, only those that make up
    that share of all tokens.
    """
    spark = docs.sparkSession
    counts = materialize(docs.select("text").mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    n_tokens, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    whole, n_tokens = share is None, int(n_tokens)

    def words(least: float) -> tuple[Tree, Column]:
        common = (F.col("n") >= least) | (F.lit(whole) & (F.col("word") == _END))
        found, tree = counts.filter(common).toArrow(), Tree(n_tokens, int(n_distinct))
        tree.add(np.asarray(found["word"]).view(np.uint64), np.asarray(found["n"]))
        return tree, common

    if not whole or n_distinct <= HELD:
        least = 0.0 if whole else share * n_tokens
        tree, common = words(least)
        send = spark.sparkContext.broadcast
        with shuffles_once(spark):
            coded = materialize(docs.select("text").mapInArrow(coded_texts(sent := send(tree.levels[0].keys)), "ids array<int>"), "lm-ids")
            sent.destroy()
            for _ in range(depth):
                runs = coded.mapInArrow(count_runs(sent := send(tree.sent(scores=False))), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
                runs = runs.filter(F.col("n") >= max(float(LEAST), least))
                found = (runs.limit(HELD + 1) if whole else runs).toArrow()
                sent.destroy()
                if whole and len(found) > HELD:
                    break
                tree.add(np.asarray(found["key"]), np.asarray(found["n"]))
        discard(coded)
        if len(tree.levels) > depth:
            return Model(tree, counts.filter(~common))
    tree, common = words(SHARE * n_tokens)
    with shuffles_once(spark):
        return Model(tree, counts.filter(~common), run_weights(docs, counts, common, tree, depth), depth + 1)


def _counted_by_text(hashes: np.ndarray, doc: np.ndarray, n_texts: int) -> tuple[pa.Array, pa.Array]:
    """Lists a text: its different hashes, and how often it has each."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    lists = pa.array(np.searchsorted(doc[at], np.arange(n_texts + 1)).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(lists, pa.array(x)) for x in (hashes[at].view(np.int64), np.diff(np.concatenate([at, [len(order)]]))))


def _scored(known: Tree, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For slices of batches ``row, kept, text``: columns of what the tree knows of each text, hashes and text numbers of its words, and which words are below the share."""
    hasher = Hasher(_SEED)
    vocabulary, base = known.levels[0].keys, np.log10(known.base(known.levels[0].counts))
    end = int(places(vocabulary, np.zeros(1, np.uint64))[0])
    for batch in batches:
        for i, j, data, offsets in text_slices(batch.column("text"), lower=True):
            starts, ends, doc = find_words(data, offsets)
            words = hasher.words(data, starts, ends)
            ids, first = token_ids(words, doc, j - i, vocabulary, end)
            begins = np.zeros(len(ids), bool)
            begins[first[:-1]] = True
            if end < 0:  # nothing was learned
                base_of = np.full(len(ids), np.log10(known.base(0)))
                base_of[np.arange(len(words)) + doc] = 0
            else:
                base_of = np.where(ids >= 0, base[ids] if len(base) else 0, 0)
            scores = known.log_probabilities(ids, begins) if end >= 0 else base_of
            if end >= 0 and len(known.levels) == 1:  # the rest is in tables, but for what single words leave
                scores = scores + np.where(ids >= 0, known.levels[0].left[ids], 0)
            of_text = [np.diff(first), *(np.add.reduceat(x, first[:-1]) for x in ((ids >= 0).astype(np.int64), base_of, scores))]
            yield [batch.column("row").slice(i, j - i), batch.column("kept").slice(i, j - i), *map(pa.array, of_text)], words, doc, ids[np.arange(len(words)) + doc] < 0


_OF_TEXT = ["row", "kept", "n_tokens", "n_known", "base", "score"]


def score_rows(tree) -> Callable:
    """Batches ``row, kept, text`` to what the tree knows of each text, and its words below the share with how often they stand in it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, words, doc, rare in _scored(tree.value, batches):
            yield pa.RecordBatch.from_arrays([*columns, *_counted_by_text(words[rare], doc[rare], len(columns[0]))], names=[*_OF_TEXT, "words", "times"])

    return rows


def score_and_deal(tree, bits, longest: int, buckets: int) -> Callable:
    """Batches ``row, kept, text`` to what the tree knows of each text (kind ``RUNS``), and what each bucket has to look up: the runs of up to ``longest`` tokens that the map ``bits`` has, and the words below the share."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.log10(tree.value.base(0))
        for columns, words, doc, rare in _scored(tree.value, batches):
            n_texts, row = len(columns[0]), columns[0].to_numpy()
            n_rare = np.bincount(doc[rare], minlength=n_texts)
            columns[4], columns[5] = (pa.array(x.to_numpy() + n_rare * none) for x in columns[4:])
            texts = pa.RecordBatch.from_arrays(columns, names=_OF_TEXT)
            schema = pa.schema([("kind", pa.int32()), *texts.schema, ("bucket", pa.int32()), ("rows", pa.binary()), ("runs", pa.binary())])
            yield of_kind(RUNS, texts, schema)
            runs, of = [], []
            for n, (hashes, inside, text) in enumerate(hashed_runs(words, doc, n_texts, longest)):
                if n == 0:
                    ends = np.ones(len(hashes), bool)
                    ends[np.arange(len(words)) + doc] = ~rare
                    inside = ~ends
                at = np.flatnonzero(inside)
                at = at[mapped(bits.value, hashes[at])]
                runs.append(hashes[at]), of.append(row[text[at]])
            for kind, hashes, rows_of in ((WEIGHTS, np.concatenate(runs), np.concatenate(of)), (WORDS, words[rare], row[doc[rare]])):
                yield of_kind(kind, dealt(buckets, hashes, rows=rows_of, runs=hashes), schema)

    return rows


RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without ``text``, and ``n_tokens, n_known, train_tokens, base_score, score``, which take the place of columns of those names; every row stays.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z lower-cased, and one end; null is an empty text. Base: sum of
    log10((c + 1) / (N + V + 1)) with the token's count c, all N and distinct V in what was learned. ``score`` is the tree's log10
    probability of the tokens, which sums to 1 over all next tokens in every context. Words are told apart by 64 bits of hash.
    """
    share = docs.sparkSession.sparkContext.broadcast
    tree, texts = share(model.tree.sent(scores=True)), _texts(docs)
    if model.weights is None:
        kind = texts.schema["kept"].dataType.simpleString()
        held = materialize(texts.mapInArrow(score_rows(tree), f"row long, kept {kind}, n_tokens long, n_known long, base double, score double, words array<long>, times array<long>"), "lm-scores")
        each = held.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
        of_rare = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(model.tree.n_tokens + model.tree.n_distinct + 1)))
        sums = each.join(model.rare, "word", "left").groupBy("row").agg(F.sum(F.col("times") * of_rare).alias("rare"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("seen"), F.lit(0.0).alias("gained"))
        return _totals(docs, held, sums, model)
    bits, every = share(map_of(model.weights.filter(F.col("kind") == WEIGHTS))), None
    with shuffles_once(docs.sparkSession):
        for k in range(PARTS):
            part = texts.filter(F.pmod(F.xxhash64("text"), F.lit(PARTS)) == k)
            part, held = _looked_up(docs, part, model, tree, bits)
            part = materialize(part, "lm-totals")
            discard(held)
            every = part if every is None else every.unionByName(part)
    return every


def _texts(docs: DataFrame) -> DataFrame:
    rest = [c for c in docs.columns if c.lower() not in ("text", *RESULTS)]
    return docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(1).alias(private(docs, "one"))).alias("kept"), F.col("text").cast("string").alias("text"))


def _looked_up(docs: DataFrame, texts: DataFrame, model: Model, tree, bits) -> tuple[DataFrame, DataFrame]:
    """The totals of texts by a tree in tables, and the table that they read: texts and lookups, written once."""
    n, kind = buckets_for(model.tree.n_tokens), texts.schema["kept"].dataType.simpleString()
    schema = f"kind int, row long, kept {kind}, n_tokens long, n_known long, base double, score double, bucket int, rows binary, runs binary"
    held = materialize(texts.mapInArrow(score_and_deal(tree, bits, model.longest, n), schema), "lm-scores")
    lookups = held.filter(F.col("kind") != RUNS).select("kind", "bucket", "rows", "runs").groupBy("bucket")
    found = lookups.cogroup(model.weights.select("kind", "bucket", "run", "p").groupBy("bucket")).applyInArrow(looked_up(n), "bucket int, row binary, gained binary, rare binary, seen binary")
    sums = found.groupBy("bucket").applyInArrow(summed_gains, "row long, gained double, rare double, seen long")
    return _totals(docs, held.filter(F.col("kind") == RUNS).select(*_OF_TEXT), sums, model), held


def _totals(docs: DataFrame, held: DataFrame, sums: DataFrame, model: Model) -> DataFrame:
    total, rest = held.join(sums, "row", "left"), [c for c in docs.columns if c.lower() not in ("text", *RESULTS)]
    rare = F.coalesce("rare", F.lit(0.0))
    made = [F.col("n_tokens"), (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(model.tree.n_tokens).cast("long").alias("train_tokens"), (F.col("base") + rare).alias("base_score"), (F.col("score") + rare + F.coalesce("gained", F.lit(0.0))).alias("score")]
    return total.select(*(F.col("kept").getField(c).alias(c) for c in rest), *made)


def op11_suffix_tree_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(docs, fit(docs.filter(F.col("doc_id").isNotNull() & ~F.col("held_out"))))
