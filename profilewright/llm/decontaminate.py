"""Benchmark decontamination with DataFrame functions only.

Test items become windows of normalised words, broadcast as a hash set after a check of their number. A training text is probed
at every fourth word: whatever window occurs there, the run of ten words that begins at the next such place lies inside it, so
runs of ten words, hashed, find all windows with a quarter of the probes. Hits are verified word by word where they are found, and
only hits, and a row of numbers a text, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import LOWER, UPPER, private, spread_join, table

WINDOW = 13
#: ASCII characters that part words; with A-Z lower-cased, the words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
PARTING = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Rows of the hash set that are broadcast at most (about 250 bytes each); above, the probe is a shuffled join.
BROADCAST_ROWS = 500_000
#: Tasks over which that join spreads a run of words, however common.
SALTS = 16
#: The code of a text's own row.
OWN = 0


def normal_words(text: Column) -> Column:
    """Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased; none for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER + PARTING, LOWER + " " * len(PARTING)), " "), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, text`` to ``gram, item_ids``: distinct windows with the items that hold them. An item of fewer words, but not none, is one window."""
    words = items.select("item_id", F.explode(F.array(normal_words(F.col("text")))).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    grams = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, length))).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))


def probe_kinds(lengths: list[int], window: int) -> list[tuple[int, int, int]]:
    """(window length, run of words that is hashed, distance between probes); windows of fewer words are probed at every word."""
    step = max(1, window // 3)
    return [(k, k - step + 1, step) if k == window else (k, k, 1) for k in lengths]


def anchors(windows: DataFrame, kinds: list[tuple[int, int, int]]) -> DataFrame:
    """``code, ahead, gram, item_ids``: the runs of each window that a probe may meet, and how many words of the window come before."""
    runs = F.lit(None).cast("array<struct<ahead:int,code:bigint>>")
    for k, run, step in kinds:
        own = F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda o: F.struct(o.alias("ahead"), F.xxhash64(F.slice("gram", o + 1, run)).alias("code")))  # noqa: B023
        runs = F.when(F.size("gram") == k, own).otherwise(runs)
    return windows.select(F.explode(runs).alias("r"), "gram", "item_ids").select("r.code", "r.ahead", "gram", "item_ids")


def text_key() -> Column:
    """What names the text of a row: doc_id, and hash and length of the text."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("code"), F.coalesce(F.length("text"), F.lit(-1)).alias("chars"))


def probes(kinds: list[tuple[int, int, int]]) -> tuple[Column, Column]:
    """Of an array ``words``: the codes to look up, the text's own first; and for a ``slot`` of it the word, from 0, where its run begins."""
    n = F.size("words")
    codes, at, before = [F.array(F.lit(OWN).cast("bigint"))], F.lit(None).cast("int"), F.lit(1)
    for k, run, step in kinds:
        some = F.transform(F.sequence(F.lit(1), F.greatest(n - (run - 1), F.lit(1)), F.lit(step)), lambda i: F.xxhash64(F.slice("words", i, run)))  # noqa: B023
        codes.append(F.when(n >= k, some).otherwise(F.array().cast("array<bigint>")))
        count = F.when(n >= k, F.floor((n - run) / step).cast("int") + 1).otherwise(0)
        at = F.when(at.isNull() & (F.col("slot") >= before) & (F.col("slot") < before + count), (F.col("slot") - before) * step).otherwise(at)
        before = before + count  # the slots of each kind follow each other
    return F.concat(*codes), at


def verified(found: DataFrame) -> DataFrame:
    """Rows ``key, words, start, first, gram, item_ids`` - the word where a window should start, and the number of the first of ``words`` - to ``key, n_words, span, item_ids`` of those whose words are the window's."""
    here = F.col("start") - F.col("first")
    same = (here >= 0) & (F.slice("words", F.greatest(here, F.lit(0)) + 1, F.size("gram")) == F.col("gram"))
    return found.filter(same).select("key", F.lit(None).cast("long").alias("n_words"), F.struct(F.col("start").alias("at"), F.size("gram").alias("length")).alias("span"), "item_ids")


def hits_of(docs: DataFrame, windows: DataFrame, kinds: list[tuple[int, int, int]], broadcast: bool) -> DataFrame:
    """``key, words``, a row a text, to ``key, n_words, span, item_ids``: a row for each text, with its number of words, and one for each hit."""
    codes, at = probes(kinds)
    looked_up = anchors(windows, kinds)
    if broadcast:
        own = docs.sparkSession.range(1).select(F.lit(OWN).cast("bigint").alias("code"), F.lit(None).cast("int").alias("ahead"), F.lit(None).cast("array<string>").alias("gram"), F.lit(None).cast("array<string>").alias("item_ids"))
        # Words stay where they are: a generated row goes on only if its code is in the hash set.
        found = docs.select("key", "words", F.posexplode(codes).alias("slot", "code")).join(F.broadcast(looked_up.unionByName(own)), "code")
        is_own, start = (F.col("slot") == 0) & F.col("gram").isNull(), at - F.col("ahead")
        same = (F.col("slot") > 0) & (start >= 0) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("gram")) == F.col("gram"))
        return found.filter(is_own | F.coalesce(same, F.lit(False))).select(
            "key", F.when(is_own, F.size("words").cast("long")).alias("n_words"), F.when(~is_own, F.struct(start.alias("at"), F.size("gram").alias("length"))).alias("span"), "item_ids"
        )
    # Only numbers are shuffled to be looked up; a stretch of words is fetched for each candidate.
    looked_up = materialize(looked_up, "anchors")
    salted = looked_up.select("code").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    probed = docs.select("key", F.posexplode(codes).alias("slot", "code")).filter("slot > 0").withColumn("salt", F.pmod(F.xxhash64("key", "slot"), F.lit(SALTS)).cast("int"))
    met = probed.join(salted, ["code", "salt"], "left_semi").select("key", "slot", "code").distinct()
    by_text = met.groupBy("key").agg(F.collect_list(F.struct("slot", "code")).alias("met")).withColumnRenamed("key", "met_key")  # a few numbers a word of the text
    each = docs.join(by_text, F.col("key").eqNullSafe(F.col("met_key"))).select("key", "words", F.explode("met").alias("m")).select("key", "words", "m.slot", "m.code").withColumn("at", at)
    longest = max(k for k, _, _ in kinds)
    first = F.greatest(F.lit(0), F.col("at") - longest)
    near = materialize(each.select("key", "code", "at", first.alias("first"), F.slice("words", first + 1, 2 * longest + 1).alias("words")), "candidates")
    found = spread_join(near, looked_up, ["code"], "candidates").withColumn("start", F.col("at") - F.col("ahead"))
    counted = docs.select("key", F.size("words").cast("long").alias("n_words"), F.lit(None).cast("struct<at:int,length:int>").alias("span"), F.lit(None).cast("array<string>").alias("item_ids"))
    return counted.unionByName(verified(found))


def covered_words(spans: Column) -> Column:
    """Number of words under any of the ``(at, length)``, in an array sorted by ``at``."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))

    def step(acc, s):
        end = s["at"] + s["length"]
        return F.struct(F.greatest(acc["to"], end).alias("to"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["to"], s["at"]))).alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``doc_id, key, n_words, n_hit, item_ids, spans``.

    ``spans`` are the hit ``(at, length)`` in word positions, sorted; ``item_ids`` the sorted ids, as strings, of items with an
    occurring window. ``key`` names the text of the row: (doc_id, hash and length of the text).
    Null or wordless texts, and an empty benchmark, have no hits; null doc_ids are kept; equal rows get equal results, a row each.
    Other columns of either table don't matter.
    """
    windows = materialize(item_windows(items, window), "windows")
    counts = windows.groupBy(F.size("gram").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("item_ids")).alias("ids")).collect()  # at most ``window`` rows
    kinds = probe_kinds(sorted(r["k"] for r in counts), window)
    step_of = {k: step for k, _, step in kinds}
    rows = sum(max(r["n"], r["ids"]) * step_of[r["k"]] for r in counts)
    # A generator of one row: the optimiser can't copy the splitting of the text into the lambda of every window.
    keyed = docs.select(text_key().alias("key"), F.explode(F.array(normal_words(F.col("text")))).alias("words"))
    found = hits_of(keyed, windows, kinds, rows <= broadcast_rows)
    per_text = found.groupBy("key").agg(  # at most a few rows a word of the text; equal rows meet partly before the shuffle
        F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids")
    )
    each = per_text.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("key.doc_id", "key", "n_words", covered_words(F.col("spans")).alias("n_hit"), "item_ids", "spans")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept."""
    name = private(docs, "bad_key")
    bad = scan(docs, items, window).filter(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("key").alias(name)).distinct()
    return docs.join(bad, text_key().eqNullSafe(F.col(name)), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, clean_words``: the normalised words of every row without those that are hit."""
    found = scan(docs, items, window)
    words = docs.select(text_key().alias("word_key"), normal_words(F.col("text")).alias("words")).dropDuplicates(["word_key"])
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))
    joined = found.join(words, found["key"].eqNullSafe(F.col("word_key")))
    kept = F.when(F.size("words") > 0, F.array_except(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), hit)).otherwise(F.array().cast("array<int>"))
    return joined.select("doc_id", F.transform(kept, lambda i: F.get("words", i)).alias("clean_words"))


def op10_decontaminate(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


OP10_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, words[i:i + least(len(words), 13) - 1] AS gram FROM item, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS t(i) WHERE len(words) > 0),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
probe AS (
  SELECT doc_id, i, k, words[i:i + k - 1] AS gram FROM doc, (SELECT DISTINCT len(gram) AS k FROM win) AS l, unnest(range(1, len(words) - k + 2)) AS t(i)),
hit AS (SELECT doc_id, i, k, item_id FROM probe JOIN win USING (gram)),
n_hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, k)) AS t(j) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc LEFT JOIN n_hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
