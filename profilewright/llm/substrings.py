"""Substring deduplication: windows of words that an earlier document has are removed, found level by level with doubling lengths.

Windows repeated at one length alone are extended to twice that length (the last step to the asked length), until none survive.
The first level is sampled without loss: each window of the second level is represented by the smallest hash among the first-level
windows inside it, so equal windows have equal representatives. A task first settles what repeats among its own texts; only one
row of a window and task then meets the other tasks' rows, so a passage that a third of all documents hold makes no large group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, table
from .textops import Hasher, find_words, first_of_runs, inside, mixed, text_slices

WINDOW = 13
#: Halving the window stops at this length or below: shorter windows repeat by chance, and a level of them costs more than it saves.
LEAST = 7
#: Windows that a task settles among themselves before it sends them on.
FLUSH = 1 << 20

_ROWS = "hash long, tag long, doc_id long"


def levels_of(window: int, least: int = LEAST) -> list[int]:
    out = [window]
    while out[0] > least:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Texts:
    """Hashes of the words of a slice of texts, and its windows."""

    def __init__(self, hashers: tuple[Hasher, Hasher], data: np.ndarray, offsets: np.ndarray):
        self.hashers = hashers
        self.starts, self.ends, self.doc = find_words(data, offsets)
        self.words = [h.words(data, self.starts, self.ends) for h in hashers[:1]]
        self._data = data
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))  # of each text, in words; and the end

    def windows(self, length: int, which: int = 0) -> np.ndarray:
        if which == len(self.words):
            self.words.append(self.hashers[which].words(self._data, self.starts, self.ends))
        return self.hashers[which].windows(self.words[which], length)

    def sampled(self, short: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows of ``long`` words inside one text: where they start, where their representatives do; and all short windows' codes."""
        codes = self.windows(short)
        ok = np.flatnonzero(inside(self.doc, long))
        n = max(0, len(self.doc) - long + 1)
        least, at = codes[:n].copy(), np.zeros(n, np.int64)
        for k in range(1, long - short + 1):
            better = codes[k : k + n] < least
            np.copyto(least, codes[k : k + n], where=better)
            at[better] = k
        return ok, ok + at[ok], codes


def marked(texts: Texts, codes: np.ndarray, hashes: pa.ListArray, rows: slice) -> np.ndarray:
    """Marks of the windows whose hash is among those that ``hashes`` has for their text."""
    part = hashes.slice(rows.start, rows.stop - rows.start)
    named = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    owner = np.repeat(np.arange(len(part), dtype=np.uint64), np.diff(np.asarray(part.offsets)))
    own = texts.doc[: len(codes)].astype(np.uint64)
    return np.isin(codes ^ mixed(own + np.uint64(1)), named ^ mixed(owner + np.uint64(1)))


def settle(code: np.ndarray, check: np.ndarray, doc: np.ndarray, last: bool) -> pa.RecordBatch:
    """Rows to send on, of windows gathered by one task: each window's first document here, and what is sure already.

    On the last level a window in documents after its first is surely removed; before, a window in two documents surely
    survives in all. Sure rows have a tag other than 0 in the low half, different by document, so that they stay apart; the
    high half holds more bits of the window's hash.
    """
    order = np.lexsort((doc, check, code))
    code, check, doc = code[order], check[order], doc[order]
    head = first_of_runs(code) | first_of_runs(check)
    once = head | first_of_runs(doc)
    code, check, doc, head = code[once], check[once], doc[once], head[once]
    starts = np.flatnonzero(head)
    several = np.diff(np.append(starts, len(code))) > 1
    sure = ~head if last else several[np.cumsum(head) - 1]
    high = check & np.uint64(0xFFFFFFFF00000000)
    apart = high | (mixed(doc.view(np.uint64)) & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    columns = (code, code), (high, apart), (doc, doc)
    parts = [np.concatenate([x[head], y[sure]]) for x, y in columns]
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in parts], names=["hash", "tag", "doc_id"])


def level_rows(first: bool, length: int, before: int, last: bool, sampled: bool, flush: int = FLUSH) -> Callable:
    """The windows of one level, of batches ``doc_id, text`` and, but for the first level, ``hashes`` of those that survived the one before.

    ``length`` and ``before``: of this level's windows and of the last one's; on the first level, ``before`` is the next one's.
    ``sampled``: the level before was the sampled first one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = Hasher(1), Hasher(2)
        held: list[tuple] = []
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64)
            for i, j, data, offsets in text_slices(batch.column("text")):
                texts = Texts(hashers, data, offsets)
                if first:
                    _, chosen, codes = texts.sampled(length, before)
                    chosen = chosen[first_of_runs(chosen)]
                else:
                    if sampled:
                        ok, represented, old = texts.sampled(before, length)
                        chosen = ok[marked(texts, old, batch.column("hashes"), slice(i, j))[represented]]
                    else:
                        marks = marked(texts, texts.windows(before), batch.column("hashes"), slice(i, j))
                        ok = np.flatnonzero(inside(texts.doc, length))
                        chosen = ok[marks[ok] & marks[ok + length - before]]
                    codes = texts.windows(length)
                check = texts.windows(length, 1)[chosen] if last else np.zeros(len(chosen), np.uint64)
                held.append((codes[chosen], check, ids[i + texts.doc[chosen]]))
                if sum(len(x[0]) for x in held) >= flush:
                    yield settle(*(np.concatenate(x) for x in zip(*held, strict=True)), last)
                    held = []
        if held:
            yield settle(*(np.concatenate(x) for x in zip(*held, strict=True)), last)

    return rows


def removed_words(texts: Texts, hashes: pa.ListArray, rows: slice, window: int) -> np.ndarray:
    """Marks of the words under the windows named, in one slice."""
    codes = texts.windows(window)
    marks = marked(texts, codes, hashes, rows) & inside(texts.doc, window)
    step = np.zeros(len(texts.doc) + 1, np.int64)
    step[: len(marks)] += marks
    step[window : window + len(marks)] -= marks
    return np.cumsum(step[:-1]) > 0


def removal(window: int) -> Callable:
    """Batches ``doc_id, text, hashes, copy`` to the words kept."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = Hasher(1), Hasher(2)
        for batch in batches:
            hashes = batch.column("hashes")
            has, copy = np.asarray(hashes.is_valid()), batch.column("copy").to_pylist()
            lengths = np.where(has, np.asarray(hashes.value_lengths().fill_null(0)), 0)
            filled = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), hashes.flatten())
            n_words, n_removed, kept = [], [], []
            for i, j, data, offsets in text_slices(batch.column("text")):
                gone = None
                if has[i:j].any():
                    texts = Texts(hashers, data, offsets)
                    gone = removed_words(texts, filled, slice(i, j), window)
                raw = data.tobytes()
                for k in range(j - i):
                    words = raw[offsets[k] : offsets[k + 1]].split()
                    n_words.append(len(words))
                    if copy[i + k]:
                        words = words if len(words) < window else []
                    elif gone is not None and has[i + k] and (mask := gone[texts.first[k] : texts.first[k + 1]]).any():
                        words = [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                if sum(map(len, kept)) > 16 << 20:
                    yield _kept(batch.column("doc_id").slice(j - len(kept), len(kept)), n_words, n_removed, kept)
                    n_words, n_removed, kept = [], [], []
            yield _kept(batch.column("doc_id").slice(batch.num_rows - len(kept), len(kept)), n_words, n_removed, kept)

    return rows


def _kept(ids: pa.Array, n_words: list, n_removed: list, kept: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def repeated_windows(texts: DataFrame, window: int = WINDOW, least: int = LEAST, flush: int = FLUSH) -> DataFrame:
    """``doc_id, hashes`` of the windows of ``texts(doc_id, text)`` that also start in a document with a smaller id."""
    levels = levels_of(window, least)
    if len(levels) == 1:
        levels = [window, window]
    found = None
    for k, length in enumerate(levels):
        last = k == len(levels) - 1
        if found is None:
            rows = texts.mapInArrow(level_rows(True, length, levels[1], False, False, flush), _ROWS)
        else:
            rows = texts.join(found.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "hashes").mapInArrow(level_rows(False, length, levels[k - 1], last, k == 1, flush), _ROWS)
        same = Window.partitionBy("hash", "tag")
        sure = F.col("tag").bitwiseAND(F.lit(0xFFFFFFFF)) != 0
        if last:
            met = rows.withColumn("first", F.min("doc_id").over(same)).filter(sure | (F.col("doc_id") > F.col("first")))
        else:
            met = rows.withColumns({"first": F.min("doc_id").over(same), "other": F.max("doc_id").over(same)}).filter(sure | (F.col("first") < F.col("other")))
        found = met.groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"))  # a few numbers a word at most
    return found


def later_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, codes``: hashes of those texts of a document that a document with a smaller id has as a whole."""
    codes = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("code"), F.xxhash64(F.lit("again"), "text").alias("code2"))
    firsts = codes.groupBy("code", "code2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("other")).filter("first < other")
    return spread_join(codes, firsts, ["code", "code2"], "whole-copies").filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("code").alias("codes"))


def dedup(docs: DataFrame, window: int = WINDOW, least: int = LEAST, flush: int = FLUSH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for each row of ``docs(doc_id, text)``; other columns don't matter.

    Words are ``[^\\x20\\x09-\\x0D]+``. Each word under a window of ``window`` words whose words, in order, also start in a document
    with a smaller doc_id is removed; windows are judged on the input. ``kept_text`` joins the others by single spaces.
    Null text: no words, an empty kept text. Texts of fewer words than a window keep all. Rows with a null doc_id keep all and
    take no part. Rows that share a doc_id do not remove from each other; equal rows get equal results, a row each.
    Whole texts that a document with a smaller doc_id has need no windows: all their words go. On the last level windows are told
    apart by 96 bits of hash.
    """
    coded = docs.select("doc_id", F.col("text").alias("text"), F.xxhash64("text").alias("code"))
    # One exchange of the texts serves every level and the removal; its rows without an id are kept out, so that all uses are alike.
    texts = coded.filter(F.col("doc_id").isNotNull()).repartition("doc_id")
    whole = texts.join(later_copies(docs).hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", F.coalesce(F.array_contains("codes", F.col("code")), F.lit(False)).alias("copy"))
    found = repeated_windows(whole.filter(~F.col("copy")).select("doc_id", "text"), window, least, flush)
    placed = whole.join(found.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "hashes", "copy")
    apart = coded.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("hashes"), F.lit(False).alias("copy"))
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    return placed.mapInArrow(removal(window), schema).unionByName(apart.mapInArrow(removal(window), schema))


def op5_substring_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (SELECT doc_id, i, words[i:i + 12] AS gram FROM d, unnest(range(1, len(words) - 11)) AS t(i)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS least FROM w),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS pos FROM m, unnest(range(0, 13)) AS t(j) WHERE doc_id > least GROUP BY doc_id),
k AS (SELECT doc_id, len(words) AS n, coalesce(len(pos), 0) AS r,
             list_filter(words, lambda x, i: pos IS NULL OR NOT list_contains(pos, i)) AS kept FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
