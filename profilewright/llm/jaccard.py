"""Exact n-gram Jaccard join: documents whose sets of word shingles have a similarity of at least 0.9, and their components.

A metric-space join: pivots make Voronoi cells, the triangle inequality says which documents beyond a border must be replicated
into a cell and where a cell falls apart, and cells are joined recursively, exactly, until a pivot is left with what it was
measured against. Every link is found as a distance to a pivot.

Unrelated texts all lie at Jaccard distance 1 from each other and so from any pivot: there, distances tell nothing, and cells around
pivots drawn from the whole corpus would hold everything. Documents therefore meet pivots only where some distance can be below
1/9: the shingle space is hashed into more blocks than a linked pair can differ in, such a pair then agrees on all of some
block (distances between sets, restricted to a block, cannot exceed those between the sets), and documents that agree on a block
share a region. Inside regions everything goes by pivots; only what they leave together, as texts that share much with all
of a region, is told apart by its rarest shingles, and met by new pivots. Whatever is connected already is not compared again,
so large groups of near copies cost one pivot each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import LOWER, UPPER, spread_join, table
from .components import components
from .textops import Hasher, find_words, first_of_runs, inside, mixed, text_slices

SHINGLE = 3
#: Linked: 100 * intersection >= PERCENT * union. The bounds below hold for 90.
PERCENT = 90
RADIUS = 0.1
#: Shingles of a region that one task takes; regions above are split over tasks.
REGION_SHINGLES = 2_000_000
FLUSH_BYTES = 32 << 20
#: Pivots of a step: in a small group, in a larger one, and in a region that is spread over tasks, where each further step has twice as many.
FEW, PIVOTS, MANY = 1, 4, 16
SMALL = 8


def size_classes(most: int) -> np.ndarray:
    """Lower bounds of size classes up to ``most``: nines while small, then by a ratio."""
    bounds = [1]
    while bounds[-1] <= most:
        low = bounds[-1]
        bounds.append(max(9 * (low // 9 + 1), int(low / 0.65) if low > 90 else 0))
    return np.array(bounds, np.int64)


_BOUNDS = size_classes(1 << 40)


def blocks_of(size_class: int) -> tuple[int, int]:
    """Blocks of a class, and how many small ones a document may leave out.

    For |x| <= |y| linked, |x - y| + |y - x| <= 0.1 |x or y| <= |x| / 9; with the smaller set in this class at most
    ``differ`` blocks differ. Of ``differ + 1 + spare`` blocks more than ``spare`` agree, so one stays if a document leaves out no
    more than ``spare`` of them.
    """
    differ = int(_BOUNDS[size_class + 1] - 1) // 9
    spare = (12 * differ + 50) // 100
    return differ + 1 + spare, spare


def shingle_sets(hasher: Hasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a slice's texts, one after the other, and where each text's begin. Texts of fewer words are one shingle."""
    starts, ends, doc = find_words(data, offsets)
    words = hasher.words(data, starts, ends)
    n_texts = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n_texts + 1))
    codes = hasher.windows(words, SHINGLE)
    ok = inside(doc, SHINGLE)
    codes, owner = codes[ok], doc[: len(ok)][ok]
    n = np.diff(first)
    for k in range(1, SHINGLE):
        few = np.flatnonzero(n == k)
        if len(few):
            codes = np.concatenate([codes, hasher.windows(words, k)[first[few]]])
            owner = np.concatenate([owner, few])
    if (n < SHINGLE).any():
        order = np.argsort(owner, kind="stable")
        codes, owner = codes[order], owner[order]
    edges = np.searchsorted(owner, np.arange(n_texts + 1))
    codes = codes.copy()
    for i in range(n_texts):
        codes[edges[i] : edges[i + 1]].sort()
    new = first_of_runs(codes) | first_of_runs(owner)
    codes, owner = codes[new], owner[new]
    return codes, np.searchsorted(owner, np.arange(n_texts + 1))


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of each stretch, empty ones too."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[edges[1:]] - total[edges[:-1]]


def signatures(codes: np.ndarray, size_class: int) -> np.ndarray:
    """A hash of each block's shingles for one set in one class; small blocks are left out if there are few."""
    blocks, spare = blocks_of(size_class)
    at = ((mixed(codes + np.uint64(0x51ED270B)) >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    at = at.astype(np.int64)
    counts = np.bincount(at, minlength=blocks)
    sums = np.zeros(blocks, np.uint64)
    np.add.at(sums, at, mixed(codes ^ np.uint64(0xA5A5F00DCAFE1234)))
    names = mixed(sums ^ mixed(np.arange(blocks, dtype=np.uint64) + np.uint64(size_class << 40)))
    small = counts <= 1
    return names[~small] if small.sum() <= spare else names


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text a row of kind 0, ``a, b`` a hash of its set; and rows of kind 1, ``a`` a signature, of one document for each set of the task."""
    hasher, held, bytes_held = Hasher(3), [], 0
    for batch in batches:
        ids = batch.column("doc_id")
        valid = np.asarray(ids.is_valid())
        ids = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        for i, j, data, offsets in text_slices(batch.column("text"), lower=True):
            codes, edges = shingle_sets(hasher, data, offsets)
            a, b = _sums(mixed(codes), edges), _sums(mixed(codes ^ np.uint64(0x0F1E2D3C4B5A6978)), edges)
            held.append((ids[i:j], valid[i:j], a, b, codes, edges))
            bytes_held += codes.nbytes
            if bytes_held >= FLUSH_BYTES:
                yield from _settled_sets(held)
                held, bytes_held = [], 0
    yield from _settled_sets(held)


def _settled_sets(held: list) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    chosen: dict[tuple[int, int], tuple[int, int, int]] = {}
    sigs, owners = [], []
    for part, (ids, valid, a, b, _, edges) in enumerate(held):
        n = np.diff(edges)
        mask = ~valid
        yield _set_batch(0, a.view(np.int64), b.view(np.int64), pa.array(ids, mask=mask), n)
        for k in np.flatnonzero(valid & (n >= 9)):  # smaller sets link with equal ones alone
            key = int(a[k]), int(b[k])
            if key not in chosen or ids[k] < chosen[key][0]:
                chosen[key] = int(ids[k]), part, int(k)
    local: list[np.ndarray] = []
    for doc, part, k in chosen.values():
        codes, edges = held[part][4:]
        own = codes[edges[k] : edges[k + 1]]
        c = int(np.searchsorted(_BOUNDS, len(own), side="right")) - 1
        found = [signatures(own, c)]
        if c and 9 * len(own) <= 10 * int(_BOUNDS[c] - 1):
            found.append(signatures(own, c - 1))
        local.append(np.concatenate(found))
        owners.append(doc)
    if not local:
        return
    doc = np.repeat(np.array(owners, np.int64), [len(x) for x in local])
    sig = np.concatenate(local)
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    head = first_of_runs(sig)
    # Of a signature that several documents here share, its first document goes on; the others are tied to it by a signature of the two.
    lead = doc[np.flatnonzero(head)][np.cumsum(head) - 1]
    ties = np.unique(np.stack([lead[~head], doc[~head]], axis=1), axis=0)
    ties = ties[ties[:, 0] != ties[:, 1]]
    name = mixed(mixed(ties[:, 0].astype(np.uint64)) ^ ties[:, 1].astype(np.uint64))
    sig = np.concatenate([sig[head], name, name])
    doc = np.concatenate([doc[head], ties[:, 0], ties[:, 1]])
    for i in range(0, len(sig), 1 << 18):
        part = slice(i, i + (1 << 18))
        yield _set_batch(1, sig[part].view(np.int64), np.zeros(len(sig[part]), np.int64), pa.array(doc[part]), np.zeros(len(sig[part]), np.int64))


def _set_batch(kind: int, a, b, doc, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), doc, pa.array(n.astype(np.int64))], names=["kind", "a", "b", "doc_id", "n"])


def region_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``region, doc_id, text`` to ``region, doc_id, n, codes``."""
    hasher = Hasher(3)
    for batch in batches:
        for i, j, data, offsets in text_slices(batch.column("text"), lower=True):
            codes, edges = shingle_sets(hasher, data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(codes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("region").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array(np.diff(edges)), lists], names=["region", "doc_id", "n", "codes"])


class Region:
    """The sets of one region, and the links found between them."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], parents: dict[int, int] | None = None):
        self.ids, self.sets = ids, sets
        self.n = np.array([len(s) for s in sets], np.int64)
        self.values = np.concatenate(sets)
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        # Sets of one document, and of documents known to be connected, begin connected.
        self.root = np.arange(len(ids))
        self.links: list[tuple[int, int]] = []
        first: dict[int, int] = {}
        for i, doc in enumerate(ids):
            other = first.setdefault((parents or {}).get(doc, doc), i)
            self.root[i] = self.root[other]

    def connect(self, i: int, others: np.ndarray) -> None:
        roots, first = np.unique(self.root[others], return_index=True)
        new = roots != self.root[i]
        if new.any():
            self.links += [(self.ids[i], self.ids[j]) for j in others[first[new]]]
            self.root[np.isin(self.root, roots[new])] = self.root[i]

    def common(self, i: int, members: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i with each of the members."""
        own = self.sets[i]
        if len(members) == len(self.ids):
            values, edges = self.values, self.starts
        else:
            values = np.concatenate([self.sets[m] for m in members])
            edges = np.concatenate([[0], np.cumsum(self.n[members])])
        at = np.searchsorted(own, values)
        at[at == len(own)] = 0
        return _sums((own[at] == values).astype(np.int64), edges)

    def measure(self, i: int, members: np.ndarray) -> np.ndarray:
        """Distances to i; what is close enough is linked."""
        both = self.common(i, members)
        either = self.n[i] + self.n[members] - both
        self.connect(i, members[100 * both >= PERCENT * either])
        return 1 - both / either

    def parts(self, members: np.ndarray) -> list[np.ndarray]:
        """Members told apart by their rarest shingles here: of linked sets, the rarest tenth of each (and one more) have one in common."""
        values = np.concatenate([self.sets[m] for m in members])
        n = self.n[members]
        owner = np.repeat(np.arange(len(members)), n)
        names, at, count = np.unique(values, return_inverse=True, return_counts=True)
        order = np.lexsort((at, count[at], owner))
        place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
        rare = order[place <= n[owner] // 10]
        rare = rare[count[at[rare]] > 1]
        rare = rare[np.argsort(at[rare], kind="stable")]
        same = np.flatnonzero(at[rare][1:] == at[rare][:-1])
        ties = np.unique(np.stack([owner[rare][same], owner[rare][same + 1]], axis=1), axis=0)
        label = np.arange(len(members))
        while len(ties):  # the least label spreads, with jumps
            low = np.minimum(label[ties[:, 0]], label[ties[:, 1]])
            new = label.copy()
            np.minimum.at(new, ties[:, 0], low)
            np.minimum.at(new, ties[:, 1], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        order = np.argsort(label, kind="stable")
        return [members[g] for g in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(g) > 1]

    def join(self, members: np.ndarray) -> None:
        """Find the components of the members: by pivots, Voronoi cells and their windows, and again inside each cell."""
        stack = [(members, 2 * len(members))]
        while stack:
            members, tried = stack.pop()
            if len(members) < 2 or (self.root[members] == self.root[members[0]]).all():
                continue
            # A pivot is settled once it has been compared with all. Small components come first: what is left then is one.
            roots, first, size = np.unique(self.root[members], return_index=True, return_counts=True)
            picks = members[first[np.argsort(size, kind="stable")[: FEW if len(members) <= SMALL else PIVOTS]]]
            distances = np.stack([self.measure(p, members) for p in picks])
            rest = ~np.isin(members, picks)
            members, distances = members[rest], distances[:, rest]
            cells = [c for cell in voronoi(distances) for c in windows(distances, cell) if len(c) > 1]
            if 2 * sum(map(len, cells)) <= 3 * len(members):
                stack += [(members[c], 2 * len(c)) for c in cells]
            elif 4 * len(members) > 3 * tried:  # rarest shingles left this together not long ago
                stack.append((members, tried))
            else:
                # Cells that overlap too much would be joined again and again: what the pivots leave together meets others by its rarest shingles.
                stack += [(g, len(g)) for g in self.parts(members)]


def voronoi(distances: np.ndarray) -> list[np.ndarray]:
    """Cells, a row of distances a pivot: those nearest to it, and those beyond the border that may link with one of them."""
    nearest, home = distances.min(axis=0), distances.argmin(axis=0)
    cells = []
    for c in np.unique(home):
        own = home == c
        near = distances[c] <= nearest + 2 * RADIUS + 1e-9
        # Of those replicated, some member of the cell must be within the radius, as far as any pivot can tell.
        for d in distances:
            near &= (d >= d[own].min() - RADIUS - 1e-9) & (d <= d[own].max() + RADIUS + 1e-9)
        cells.append(np.flatnonzero(own | near))
    return cells


def windows(distances: np.ndarray, cell: np.ndarray) -> list[np.ndarray]:
    """A cell parted wherever, by the distance to some pivot, nobody stands in a stretch as wide as the radius: no link can span it."""
    cells = [cell]
    for d in distances:
        parted = []
        for c in cells:
            order = c[np.argsort(d[c], kind="stable")]
            parted += np.split(order, np.flatnonzero(np.diff(d[order]) > RADIUS + 1e-9) + 1)
        cells = parted
    return cells


def region_links(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by region to links that connect what is connected inside each region; a region's sets are held together."""
    now, ids, sets = None, [], []

    def done() -> pa.RecordBatch:
        region = Region(ids, sets)
        region.join(np.arange(len(ids)))
        pairs = np.array(region.links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in parts:
        regions, docs, codes = batch.column("region").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("codes")
        edges, flat = np.asarray(codes.offsets), np.asarray(codes.values).view(np.uint64)
        for k, region in enumerate(regions):
            if region != now:
                if len(ids) > 1:
                    yield done()
                now, ids, sets = region, [], []
            ids.append(docs[k]), sets.append(flat[edges[k] : edges[k + 1]].copy())
    if len(ids) > 1:
        yield done()


def refine_regions(sets: DataFrame) -> DataFrame:
    """Rows ``region, doc_id, n, codes`` under the smaller regions that their documents' rarest shingles tell apart; documents left alone go.

    As ``Region.parts``, over tasks: shingles are counted inside each region, and a document's rarest tenth (and one more) tie it
    to the others of the region that have one of them.
    """
    node = F.xxhash64("region", "doc_id")
    each = sets.select("region", node.alias("node"), F.monotonically_increasing_id().alias("row"), "n", F.explode("codes").alias("code"))
    each = materialize(each, "jaccard-shingles")
    shared = each.groupBy("region", "code").agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("first")).filter("count > 1")
    counted = each.join(shared, ["region", "code"], "left").select("region", "node", "row", "n", "code", F.coalesce("count", F.lit(1)).alias("count"), "first")
    place = F.row_number().over(Window.partitionBy("region", "row").orderBy("count", "code"))
    rare = counted.withColumn("place", place).filter((F.col("place") <= F.floor(F.col("n") / 10) + 1) & (F.col("count") > 1))
    ties = components(rare.select(F.col("first").alias("a"), F.col("node").alias("b")))
    return sets.withColumn("node", node).join(ties, F.col("node") == F.col("id")).select(F.col("component").alias("region"), "doc_id", "n", "codes")


def split_regions(sets: DataFrame, region_shingles: int, pivots: int = MANY) -> tuple[DataFrame, DataFrame]:
    """Regions too large for a task, the same join spread over tasks: links to pivots, and regions of bounded size that hold every pair that may still link.

    ``sets(region, doc_id, n, codes)``. Pivots of a region are its first sets by a hash; its sets are dealt into chunks of bounded
    size, and each chunk meets all its pivots, so that no region fills a task. A set belongs to the cell of its nearest pivot and is
    replicated, with the others of its document, into every cell within twice the radius. A cell whose documents are all connected
    by links is done. Cells become regions; where they overlap too much their region stays whole, without its pivots, which are
    settled. What is too large still is told apart by its rarest shingles and gets new pivots, twice as many each time, dealt to
    twice as many chunks. So a region that nothing parts - many texts at about the radius from each other - is used up by its
    pivots in a number of steps that is the logarithm of its documents; the distances measured there grow with their square.
    """
    links = small = None
    level = 0
    more = lambda a, b: b if a is None else a.unionByName(b)
    refine = False
    while True:
        sizes = materialize(sets.groupBy("region").agg(F.sum("n").alias("shingles")), "jaccard-sizes")
        large = sizes.filter(F.col("shingles") > region_shingles).withColumn("chunks", F.ceil(F.col("shingles") / F.lit(region_shingles)).cast("int"))
        fitting = sizes.filter(F.col("shingles") <= region_shingles).select("region")
        small = more(small, sets.join(fitting, "region", "left_semi"))
        left = large.agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]
        if not left:
            return links if links is not None else small.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0), small
        if refine:
            sets, refine = materialize(refine_regions(sets.join(large.select("region"), "region", "left_semi")), "jaccard-finer"), False
            continue
        deeper, level, refine = 1 << level, level + 1, True
        large = large.withColumn("chunks", F.col("chunks") * deeper)
        counts = sets.groupBy("region").agg(F.count(F.lit(1)).alias("rows_of_key"))
        members = spread_join(sets, large.select("region", "chunks"), ["region"], "jaccard-members", materialize(counts, "jaccard-members"))
        members = materialize(members.withColumns({"set": F.xxhash64("codes"), "chunk": F.pmod(F.xxhash64("doc_id", "codes"), F.col("chunks")).cast("int")}), "jaccard-members")
        place = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("doc_id"), "doc_id", "set"))
        chosen = members.select("region", "doc_id", "set", "n", "codes", "chunks").withColumn("pivot", place).filter(F.col("pivot") <= pivots * deeper)
        met = chosen.select("region", "pivot", F.col("doc_id").alias("p"), F.col("set").alias("p_set"), F.col("n").alias("p_n"), F.col("codes").alias("p_codes"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        both = F.size(F.array_intersect("codes", "p_codes"))
        pairs = members.join(met, ["region", "chunk"]).withColumn("both", both).select("region", "doc_id", "set", "n", "pivot", "p", "p_set", "both", (F.col("n") + F.col("p_n") - F.col("both")).alias("either"))
        pairs = materialize(pairs.withColumn("d", 1 - F.col("both") / F.col("either")), "jaccard-pivots")
        links = more(links, pairs.filter((100 * F.col("both") >= PERCENT * F.col("either")) & (F.col("doc_id") != F.col("p"))).select(F.col("doc_id").alias("a"), F.col("p").alias("b")))
        known = components(links)
        open_sets = pairs.join(chosen.select("region", F.col("doc_id").alias("p"), F.col("set").alias("p_set")).withColumnsRenamed({"p": "doc_id", "p_set": "set"}), ["region", "doc_id", "set"], "left_anti")
        homes = open_sets.groupBy("region", "doc_id", "set").agg(F.min("d").alias("d_home"))
        cells = open_sets.join(homes, ["region", "doc_id", "set"]).filter(F.col("d") <= F.col("d_home") + 2 * RADIUS + 1e-9).select("region", "pivot", "doc_id")
        cells = cells.distinct().join(known, F.col("doc_id") == F.col("id"), "left").select("region", "pivot", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        cells = materialize(cells, "jaccard-cells")
        overlaps = cells.groupBy("region").agg(F.count(F.lit(1)).alias("placed"), F.count_distinct("doc_id").alias("docs")).filter(2 * F.col("placed") > 3 * F.col("docs")).select("region")
        together = cells.join(overlaps, "region", "left_semi").select("region", F.lit(0).alias("pivot"), "doc_id", "component").distinct()
        cells = materialize(cells.join(overlaps, "region", "left_anti").unionByName(together), "jaccard-cells")
        undone = cells.groupBy("region", "pivot").agg(F.min("component").alias("one"), F.max("component").alias("other")).filter("one < other").select("region", "pivot", F.xxhash64("region", "pivot", F.lit("cell")).alias("cell"))
        homes_of = cells.join(undone, ["region", "pivot"]).select("doc_id", F.col("region").alias("whole"), "cell")
        settled = chosen.select("region", "doc_id", "set")
        rest = members.join(settled, ["region", "doc_id", "set"], "left_anti")
        sets = materialize(rest.join(homes_of, (rest["doc_id"] == homes_of["doc_id"]) & (rest["region"] == homes_of["whole"])).select(F.col("cell").alias("region"), rest["doc_id"], "n", "codes"), "jaccard-regions")


def link_components(docs: DataFrame, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``; other columns don't matter.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; a set holds a text's distinct 3-word shingles, with fewer words the
    whole sequence; texts without words have an empty set and link with nothing. Sets are compared as 64-bit hashes of their
    shingles. ``component_id`` is the smallest doc_id reachable by links, a document's own included. Rows that share a doc_id are
    one document with several texts. A null doc_id has a null component and links with nothing. Equal sets count once.
    """
    texts = docs.select("doc_id", F.col("text").alias("text"))
    rows = materialize(texts.mapInArrow(set_rows, "kind int, a long, b long, doc_id long, n long"), "jaccard-sets")
    sets = rows.filter("kind = 0").select("doc_id", "n", "a", "b")
    full = sets.filter("n > 0 and doc_id is not null")
    keepers = full.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows_of_key")).filter("rows_of_key > 1")
    keepers = materialize(keepers, "jaccard-keepers")
    copies = spread_join(full, keepers.select("a", "b", "rep"), ["a", "b"], "jaccard-copies", keepers).filter("doc_id > rep").select("doc_id", "rep").distinct()
    copies = materialize(copies, "jaccard-copies")

    # A document with other sets too stays in its regions, where all its texts are read.
    ends = full.groupBy("doc_id").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    of_one_set = ends.filter("a0 = a1 and b0 = b1").select("doc_id")
    replaced = materialize(copies.join(of_one_set, "doc_id", "left_semi"), "jaccard-replaced")

    first = F.min("doc_id").over(Window.partitionBy("a"))
    shared = rows.filter("kind = 1").select("a", "doc_id").withColumn("first", first).filter("doc_id > first").select("first", "doc_id").distinct()

    def kept(df: DataFrame, column: str) -> DataFrame:
        """Copies that have no other set give way to the first document with theirs."""
        named = replaced.select(F.col("doc_id").alias("copy"), F.col("rep"))
        return df.join(named, df[column] == named["copy"], "left").withColumn(column, F.coalesce("rep", column)).drop("copy", "rep")

    regions = components(kept(kept(shared, "first"), "doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    regions = regions.select(F.col("id").alias("doc_id"), F.col("component").alias("region"))
    candidates = texts.join(regions.hint("shuffle_hash"), "doc_id").select("region", "doc_id", "text")
    found = materialize(candidates.mapInArrow(region_sets, "region long, doc_id long, n long, codes array<long>").filter("n > 0"), "jaccard-regions")
    links = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    large = found.groupBy("region").agg(F.sum("n").alias("shingles")).filter(F.col("shingles") > region_shingles)
    small = found
    if large.head(1):
        more, small = split_regions(found, region_shingles)
        links = links.unionByName(more)
    links = links.unionByName(small.repartition("region").sortWithinPartitions("region").mapInArrow(region_links, "a long, b long"))
    labels = components(links)
    return sets.join(labels, sets["doc_id"] == labels["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


OP9_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, words[i:i + 2] AS gram FROM w, unnest(range(1, greatest(len(words) - 1, 2))) AS t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.id = w.doc_id GROUP BY 1, 2
"""


def op9_jaccard_join(spark, sf_dir):
    return link_components(table(spark, sf_dir, "documents"))
