"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by 80 of 100 are linked.

1. Every document gets its set's size and two 64-bit hashes; equal sets are one class from here on.
2. Candidates, without loss: linked sets share one of their n - ceil(0.8 n) + 1 first shingles, in any common order.
   The order puts shingles that are frequent in the corpus last (counts of them only choose the order), so that a
   passage shared by many documents rarely brings them together. Shards of the shingles, which travel in compressed
   blocks, count how many first shingles two documents share. Of two linked documents the one whose first shingles
   end earlier can only miss some of them, which gives the least count; pairs below it are dropped. A shingle of more
   than ``FEW`` documents is not counted but puts them into a star, by sizes that can be linked, inside the task and
   then in the shard. All documents of such a shingle are at most two steps from the star's hub, so the hub, its
   points and their points are a candidate group, and so are a document and its counted partners. Linked documents
   meet in one of these groups; a document may be in several.
3. Signature trees over the bitmaps of a group, which are all that travels: documents ordered by size are the leaves'
   entries; each node holds the OR of their bitmaps and the range of their sizes. A dual traversal drops pairs of nodes
   whose largest possible overlap is too small for their sizes. What it cannot rule out connects two documents, and
   connected documents of all groups are one set. A star of more than ``STAR`` documents connects them as it is.
4. The texts travel once, to their set, and the same traversal verifies exactly what its bitmaps leave, skipping
   documents that are linked already. Sets share tasks by the number of their shingles.
5. Sets beyond ``BLOCK`` documents or ``LOAD`` shingles are cut by size: linked sizes lie in one class or in two
   neighbouring ones, so each document goes to its own class and the one before. What is still larger is cut into
   blocks that each also hold a few documents of the whole set; documents that stay outside the set's main component
   are then compared with every block. Nothing is capped.

Defined results: a shorter text than five words is one shingle; null, empty and blank texts have no shingles, link
with nothing and are their own component; rows that repeat an id are one node, linked through each of their texts,
and each appear in the result; a row without an id has no component and takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.llm.common import packed, power_of_two, rows_in_slices, shingle_set, shipped, unpacked
from firmatlas.operators.resolve import clusters
from firmatlas.session import write_stage

PERCENT = 80
FREQUENT, SEEN_TOGETHER = 262_144, 3  # shingles that are ordered last; least documents of a slice that hold one
FLUSH, SHARD = 600_000, 400_000  # shingles held by a task before it hands them on; shingles of a shard
BLOCK, HUBS = 6000, 64
LOAD, PACK = 12_000_000, 1_500_000  # shingles of a set that one task takes; shingles of the sets that share a task
STAR, STAR_PACK = 20_000, 20_000_000  # documents of a group whose bitmaps meet in one task; shingles of the groups that share it
CLASS = 1.26  # ratio of the size classes; linked sizes differ by less
FEW = 8  # documents of a shingle up to which its pairs are counted
LEAF, FAN = 16, 4


def least_overlap(a: int, b: int) -> int:
    """Smallest intersection of linked sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def first_codes(codes: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The codes of a sorted set among which a linked set must have one, frequent codes last."""
    keep = len(codes) - -(-PERCENT * len(codes) // 100) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, codes), len(common) - 1)
        rank = np.where(common[at] == codes, ranks[at], 0)
        if rank.any():
            return codes[np.argsort(rank, kind="stable")[:keep]]
    return codes[:keep]


class Links:
    """Union of linked documents; the smallest index leads."""

    def __init__(self, size: int) -> None:
        self.parent = list(range(size))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


class Node:
    """A part of the documents ordered by size: OR of their bitmaps, range of sizes, most codes that share a bit."""

    __slots__ = ("bits", "children", "entries", "large", "rows", "sizes", "small", "spare", "spares")

    def __init__(self, entries: list[int], children: list[Node], bits: np.ndarray, small: int, large: int, spare: int) -> None:
        self.entries, self.children = entries, children
        self.bits, self.small, self.large, self.spare = bits, small, large, spare


class SignatureTree:
    """A tree over documents with their sizes and bitmaps; trees that are compared have one bitmap width."""

    def __init__(self, picked: list[int], sizes: np.ndarray, bits: np.ndarray) -> None:
        level = []
        order = np.lexsort((picked, sizes))
        for start in range(0, len(order), LEAF):
            part = order[start : start + LEAF]
            rows, counts = bits[part], sizes[part]
            spares = counts - np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
            leaf = Node([picked[i] for i in part], [], np.bitwise_or.reduce(rows), int(counts[0]), int(counts[-1]), int(spares.max()))
            leaf.rows, leaf.sizes, leaf.spares = rows, counts, spares
            level.append(leaf)
        while len(level) > 1:
            level = [
                Node([i for n in part for i in n.entries], part, np.bitwise_or.reduce([n.bits for n in part]), part[0].small, part[-1].large, max(n.spare for n in part))
                for part in (level[k : k + FAN] for k in range(0, len(level), FAN))
            ]
        self.root = level[0] if level else None


def marked(codes: np.ndarray, width: int) -> np.ndarray:
    """The bitmap of a set as 64-bit words."""
    row = np.zeros(width, dtype=bool)
    row[(codes & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(row, bitorder="little").view(np.uint64)


def tree_of(sets: list[np.ndarray], picked: list[int], width: int) -> SignatureTree:
    sizes = np.array([len(sets[i]) for i in picked], dtype=np.int64)
    bits = np.array([marked(sets[i], width) for i in picked], dtype=np.uint64).reshape(len(picked), width // 64)
    return SignatureTree(picked, sizes, bits)


def own_width(size: int) -> int:
    """Bits of the bitmap that travels with a document: linked documents have one width or neighbouring ones."""
    return power_of_two(2 * size, 64)


def may_link(small_a: int, large_a: int, small_b: int, large_b: int, overlap: int) -> bool:
    return 100 * large_a >= PERCENT * small_b and 100 * large_b >= PERCENT * small_a and overlap >= least_overlap(small_a, small_b)


def overlap_bound(bits_a: np.ndarray, spare_a: int, bits_b: np.ndarray, spare_b: int) -> int:
    return int(np.bitwise_count(bits_a & bits_b).sum()) + min(spare_a, spare_b)


def traverse(left: SignatureTree, right: SignatureTree, links: Links, sets: list[np.ndarray] | None = None) -> None:
    """Dual traversal; joins the linked documents of two trees (or of one with itself), without ``sets`` all that may be."""
    find = links.find
    todo = [(left.root, right.root)] if left.root and right.root else []
    while todo:
        a, b = todo.pop()
        if a is not b and not may_link(a.small, a.large, b.small, b.large, overlap_bound(a.bits, a.spare, b.bits, b.spare)):
            continue
        if a.children or b.children:
            if a is b:
                todo += [(x, y) for k, x in enumerate(a.children) for y in a.children[k:]]
            elif a.children and (not b.children or len(a.entries) >= len(b.entries)):
                todo += [(x, b) for x in a.children]
            else:
                todo += [(a, y) for y in b.children]
            continue
        for k, m in np.argwhere(possible(a, b)).tolist():
            i, j = a.entries[k], b.entries[m]
            if (a is b and k >= m) or find(i) == find(j):
                continue
            if sets is None:
                links.join(i, j)
                continue
            x, y = sets[i], sets[j]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= PERCENT * (len(x) + len(y) - shared):
                links.join(i, j)


def possible(a: Node, b: Node) -> np.ndarray:
    """Which entries of two leaves may be linked, by sizes and bitmaps."""
    x, y = a.sizes[:, None], b.sizes[None, :]
    overlap = np.bitwise_count(a.rows[:, None] & b.rows[None, :]).sum(axis=2, dtype=np.int64) + np.minimum(a.spares[:, None], b.spares[None, :])
    return (100 * x >= PERCENT * y) & (100 * y >= PERCENT * x) & (overlap >= -(-PERCENT * (x + y) // (100 + PERCENT)))


def width_for(sets: list[np.ndarray]) -> int:
    return min(65_536, power_of_two(4 * max(map(len, sets), default=1), 64))


def joined(sets: list[np.ndarray]) -> list[int]:
    """For each set the smallest index that links lead to."""
    links = Links(len(sets))
    tree = tree_of(sets, list(range(len(sets))), width_for(sets))
    traverse(tree, tree, links, sets)
    return [links.find(i) for i in range(len(sets))]


def perhaps_joined(sizes: np.ndarray, marks: list[bytes]) -> list[int]:
    """For each document the smallest index that it may be linked to through others, by sizes and bitmaps alone."""
    links = Links(len(marks))
    widths = np.array([8 * len(m) for m in marks])
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width).tolist()
        tree = SignatureTree(own, sizes[own], np.array([np.frombuffer(marks[i], np.uint64) for i in own]))
        traverse(tree, tree, links)
        wider = np.flatnonzero(widths == 2 * width).tolist()
        if wider:  # the upper half of a bitmap falls on its lower half
            halves = np.array([np.frombuffer(marks[i], np.uint64) for i in wider]).reshape(len(wider), 2, -1)
            traverse(tree, SignatureTree(wider, sizes[wider], halves[:, 0] | halves[:, 1]), links)
    return [links.find(i) for i in range(len(marks))]


def runs(code: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries (shingle, range of sizes) in order of shingle and size: where a run begins, and how far it reaches.

    A run holds entries of one shingle whose sizes may be those of linked sets, one after the other.
    """
    if not len(code):
        return np.empty(0, bool), most
    new = np.concatenate([[True], code[1:] != code[:-1]])
    group = np.cumsum(new) << 40
    reach = np.maximum.accumulate(most + group) - group
    new[1:] |= PERCENT * least[1:] > 100 * reach[:-1]
    return new, reach


def group_sizes(code: np.ndarray) -> np.ndarray:
    """For each entry of an ordered array how many entries equal it."""
    if not len(code):
        return np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    sizes = np.diff(np.append(starts, len(code)))
    return np.repeat(sizes, sizes)


def stars(node: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct pairs (node, first node of its run)."""
    if not len(node):
        return np.empty((0, 2), np.uint64)
    hub = node[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return np.unique(np.stack([node, hub], axis=1)[node != hub], axis=0)


# --- steps over all documents -------------------------------------------------------------------------------------


def _described(read: DataFrame) -> DataFrame:
    """One row per document (size and hashes of its set), and rows (code, seen) for shingles many documents share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "h1", "h2", "marks", "code", "seen"]
        for batch in rows_in_slices(batches, "text"):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            raw = [s.tobytes() for s in sets]
            hashes = [np.array([xxhash.xxh3_64_intdigest(r, seed) for r in raw], dtype=np.uint64).view(np.int64) for seed in (0, 1)]
            none = pa.nulls(len(sets), pa.int64())
            marks = pa.array([marked(s, own_width(len(s))).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, hashes), marks, none, none], names)
            codes, seen = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
            often = seen >= SEEN_TOGETHER
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(none), pa.binary()), pa.array(codes[often].view(np.int64)), pa.array(seen[often].astype(np.int64))], names)

    return read.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, marks binary, code long, seen long")


def _shards(read: DataFrame, common: np.ndarray, ranks: np.ndarray, shards: int) -> DataFrame:
    """Blocks of (shingle, node) per shard of the shingles, and links inside the task's own documents."""
    shift = np.uint64(64 - (shards.bit_length() - 1))

    def blocks(codes: list[np.ndarray], nodes: list[tuple[int, int, int]], number: int) -> pa.RecordBatch:
        code = np.concatenate(codes)
        which = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        node, size, end = (np.array(x, dtype=np.uint64) for x in zip(*nodes, strict=True))
        size = size.astype(np.int64)
        order = np.lexsort((node[which], size[which], code))
        code, which = code[order], which[order]
        # equal sets stand beside each other: once is enough
        once = np.concatenate([[True], (code[1:] != code[:-1]) | (node[which[1:]] != node[which[:-1]])])
        code, which = code[once], which[once]
        many = group_sizes(code) > FEW
        first, reach = runs(code[many], size[which[many]], size[which[many]])
        near = stars(node[which[many]], first)
        starts = np.flatnonzero(first)
        keep = ~many
        keep[np.flatnonzero(many)[starts]] = True
        beyond = np.zeros(len(code), dtype=np.int64)  # 0: one document; else how far a run of many goes, plus 1
        if len(starts):
            beyond[np.flatnonzero(many)[starts]] = np.maximum.reduceat(reach, starts) - size[which[many]][starts] + 1
        code, which, beyond = code[keep], which[keep], beyond[keep]
        shard = (code >> shift).astype(np.int64) if shards > 1 else np.zeros(len(code), np.int64)
        cuts = [*np.flatnonzero(np.diff(shard, prepend=-1)), len(code)]
        out: list[tuple] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            known, at = np.unique(which[a:b], return_inverse=True)
            rest = [zstandard.compress(x.astype(np.uint32).tobytes(), 1) for x in (size[known], at, beyond[a:b])]
            out.append((int(shard[a]), packed(code[a:b]), node[known].tobytes(), end[known].tobytes(), *rest))
        if len(near):
            out.append((number % shards, None, near[:, 0].tobytes(), near[:, 1].tobytes(), None, None, None))
        kinds = (pa.int64(), *[pa.binary()] * 6)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "codes", "nodes", "ends", "sizes", "at", "beyond"])

    def place(code: np.uint64) -> int:
        """Where a shingle stands in the common order, as a number (cut to 64 bits, so ties are possible)."""
        at = int(np.searchsorted(common, code))
        rank = int(ranks[at]) if at < len(common) and common[at] == code else 0
        return rank << 56 | int(code) >> 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, nodes, held, number = [], [], 0, 0
        for batch in rows_in_slices(batches, "text"):
            for data in batch.column("text").to_pylist():
                found = shingle_set(data)
                if len(found):
                    codes.append(first_codes(found, common, ranks))
                    nodes.append((xxhash.xxh3_64_intdigest(found.tobytes(), 0), len(found), place(codes[-1][-1])))
                    held += len(codes[-1])
                    if held >= FLUSH:
                        yield blocks(codes, nodes, number)
                        codes, nodes, held, number = [], [], 0, number + 1
        if codes:
            yield blocks(codes, nodes, number)

    return read.mapInArrow(run, "shard long, codes binary, nodes binary, ends binary, sizes binary, at binary, beyond binary")


PAIRS = "u long, v long, shared long, least long"


def _connect(rows: pd.DataFrame) -> pd.DataFrame:
    """(u, v, shared, least): pairs of nodes that share first shingles of the shard; ``least`` is 0 in a star."""

    def numbers(data: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(data), np.uint32).astype(np.int64)

    parts, stars_found = [], [np.empty((0, 2), np.uint64)]
    for code, nodes, ends, sizes, at, beyond in rows[["codes", "nodes", "ends", "sizes", "at", "beyond"]].itertuples(index=False):
        if code is None:
            stars_found.append(np.stack([np.frombuffer(nodes, np.uint64), np.frombuffer(ends, np.uint64)], axis=1))
        else:
            which = numbers(at)
            parts.append((unpacked(code), np.frombuffer(nodes, np.uint64)[which], np.frombuffer(ends, np.uint64)[which], numbers(sizes)[which], numbers(beyond)))
    found = None
    if parts:
        code, node, end, size, beyond = map(np.concatenate, zip(*parts, strict=True))
        del parts
        again = np.isin(code, _repeated(code))
        code, node, end, size, beyond = code[again], node[again], end[again], size[again], beyond[again]
        order = np.lexsort((node, size, code))
        order = order[np.concatenate([[True], (code[order][1:] != code[order][:-1]) | (node[order][1:] != node[order][:-1])])] if len(order) else order
        code, node, end, size, beyond = code[order], node[order], end[order], size[order], beyond[order]
        many = (group_sizes(code) > FEW) | np.isin(code, code[beyond > 0])
        first, _ = runs(code[many], size[many], size[many] + np.maximum(beyond[many] - 1, 0))
        stars_found.append(stars(node[many], first))
        code, node, end, size = code[~many], node[~many], end[~many], size[~many]
        # pairs as numbers of two places in the list of nodes
        known, at, place = np.unique(node, return_index=True, return_inverse=True)
        end, size, counted = end[at], size[at], []
        for gap in range(1, FEW):
            i = np.flatnonzero(code[gap:] == code[:-gap])
            i, j = place[i], place[i + gap]
            fits = (100 * size[i] >= PERCENT * size[j]) & (100 * size[j] >= PERCENT * size[i])
            counted.append(np.minimum(i[fits], j[fits]) * len(known) + np.maximum(i[fits], j[fits]))
        pair, seen = np.unique(np.concatenate([np.empty(0, np.int64), *counted]), return_counts=True)
        i, j = np.divmod(pair, max(len(known), 1))
        found = known[i].view(np.int64), known[j].view(np.int64), seen, _least_shared(size[i], size[j], end[i], end[j])
    star = np.unique(np.concatenate(stars_found), axis=0).view(np.int64)
    none = np.zeros(len(star), np.int64)
    columns = star[:, 0], star[:, 1], none, none
    return pd.DataFrame({name: c if found is None else np.append(f, c) for name, c, f in zip(("u", "v", "shared", "least"), columns, found or columns, strict=True)})


def _least_shared(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """First shingles that linked sets of sizes a and b have in common at least: of the set whose own end earlier,
    all but those that the link allows it to miss."""
    overlap = -(-PERCENT * (a + b) // (100 + PERCENT))
    of_a, of_b = (overlap - -(-PERCENT * n // 100) + 1 for n in (a, b))
    return np.maximum(np.where(end_a < end_b, of_a, np.where(end_b < end_a, of_b, np.minimum(of_a, of_b))), 1)


def _repeated(codes: np.ndarray) -> np.ndarray:
    ordered = np.sort(codes)
    return np.unique(ordered[1:][ordered[1:] == ordered[:-1]])


def _groups(pairs: DataFrame) -> DataFrame:
    """cluster, h1: the candidate groups. A document is in one for each hub that is two steps from it at most.

    A hub that is a point of another star and has no points of points itself needs no group: its points are in the
    other hub's.
    """
    star = write_stage(pairs.where("least = 0").select("u", "v").distinct(), "ngram-stars")
    beyond = star.select(F.col("u").alias("w"), F.col("v").alias("u")).join(star, "u").select(F.col("w").alias("u"), "v").where("u <> v")
    beyond = write_stage(beyond.distinct(), "ngram-beyond")
    tops = star.select("v").distinct().join(star.select(F.col("u").alias("v")).distinct(), "v", "left_anti").union(beyond.select("v")).distinct()
    points = star.union(beyond).join(tops, "v", "left_semi").union(tops.select("v", "v"))
    # counts of one pair may come from several shards
    sums = pairs.where("least > 0").groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.min("least").alias("least"))
    # what is below the least count is linked only through uncounted shingles, that is inside a star
    counted = write_stage(sums.where("shared >= least").select("u", "v"), "ngram-counted")
    partners = counted.select(F.xxhash64("u", F.lit(1)).alias("cluster"), F.explode(F.array("u", "v")).alias("h1"))
    return points.select(F.xxhash64("v", F.lit(0)).alias("cluster"), F.col("u").alias("h1")).union(partners).distinct()


def _small_groups(rows: pd.DataFrame) -> pd.DataFrame:
    """rep, component for all groups of a pack."""
    out = []
    for _, group in rows.groupby("cluster", sort=False):
        group = group.sort_values("rep")
        reps = group["rep"].tolist()
        out += [(rep, reps[k]) for rep, k in zip(reps, joined([shingle_set(t) for t in group["text"]]), strict=True)]
    return pd.DataFrame(out, columns=["rep", "component"])


def _perhaps(rows: pd.DataFrame) -> pd.DataFrame:
    """u, v: documents of the groups of a pack whose bitmaps don't rule out a link, each with one that stands for them."""
    out = []
    for _, group in rows.groupby("cluster", sort=False):
        reps = group["rep"].tolist()
        found = perhaps_joined(group["n_shingles"].to_numpy(), group["marks"].tolist())
        out += [(reps[i], reps[k]) for i, k in enumerate(found) if i != k]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _across(rows: pd.DataFrame) -> pd.DataFrame:
    """rep, component for a block and a block of stragglers, whose components so far are in ``label``."""
    rows = rows.sort_values(["rep", "side"]).reset_index(drop=True)
    sets, links, lead = [shingle_set(t) for t in rows["text"]], Links(len(rows)), {}
    for i, label in enumerate(rows["label"]):
        links.join(lead.setdefault(label, i), i)
    width = width_for(sets)
    sides = [tree_of(sets, np.flatnonzero(rows["side"] == side).tolist(), width) for side in (0, 1)]
    traverse(*sides, links, sets)
    reps = rows["rep"].tolist()
    return pd.DataFrame({"rep": reps, "component": [reps[links.find(i)] for i in range(len(reps))]})


def _packed(near: DataFrame, shingles: int) -> DataFrame:
    """rep, component for groups that one task can hold, many to a task."""
    pack = F.pmod(F.xxhash64("cluster"), F.lit(max(16, -(-shingles // PACK))))
    return near.select("cluster", "rep", "text").withColumn("pack", pack).groupBy("pack").applyInPandas(_small_groups, "rep long, component long")


def _sized(members: DataFrame) -> DataFrame:
    """cluster, size, load: documents and shingles of each group."""
    return members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("load"))


def _fits() -> Column:
    """Groups that one task takes whole."""
    return (F.col("size") <= BLOCK) & (F.col("load") <= LOAD)


def _totals(sizes: DataFrame) -> tuple[int, bool]:
    """Shingles in groups that one task takes, and whether there are larger groups."""
    told = sizes.agg(F.sum(F.when(_fits(), F.col("load"))), F.count_if(~_fits())).first()
    return told[0] or 0, told[1] > 0


def _large_groups(near: DataFrame) -> DataFrame:
    """rep, component for groups too large for one task: by size classes first."""
    rank = F.floor(F.log("n_shingles") / F.log(F.lit(CLASS)))
    ranked = near.drop("size", "load").withColumn("rank", F.explode(F.array(rank, rank - 1))).withColumn("cluster", F.xxhash64("cluster", "rank"))
    sizes = write_stage(_sized(ranked), "ngram-classes")
    shingles, larger = _totals(sizes)
    sized = ranked.join(sizes, "cluster")
    found = _packed(sized.where(_fits()), shingles)
    if larger:
        found = found.union(_block_groups(write_stage(sized.where(~_fits()), "ngram-large")))
    return found


def _block_groups(near: DataFrame) -> DataFrame:
    """rep, component for groups of more than ``BLOCK`` documents of like size."""
    n_blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("load") / LOAD))
    hub = F.pmod(F.xxhash64(F.lit("hub"), "rep"), F.col("size")) < HUBS
    near = near.withColumn("n_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("rep"), n_blocks))
    spread = near.withColumn("block", F.explode(F.when(hub, F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array("block"))))
    local = spread.select("cluster", "block", "rep", "text").groupBy("cluster", "block").applyInPandas(_small_groups, "rep long, component long")
    local = write_stage(local, "ngram-blocks")
    label = clusters(local.select(F.col("rep").alias("record"), F.col("component").alias("token"))).select(F.col("record").alias("rep"), F.col("cluster").alias("label"))
    label = write_stage(label, "ngram-labels")
    # ids only, until it is known which documents have to meet
    named = write_stage(near.drop("text").join(label, "rep"), "ngram-named")
    counts = named.groupBy("cluster", "label").count()
    main = counts.groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels"), (F.sum("count") - F.max("count")).alias("outside"))
    main = write_stage(main.where("labels > 1"), "ngram-main")
    if main.isEmpty():
        return label.select("rep", F.col("label").alias("component"))
    # every document meets every straggler: by blocks of both
    named = named.join(main, "cluster")
    outer = F.ceil(F.col("outside") * F.col("n_blocks") / F.col("size"))  # of about the blocks' size
    right = named.where("label <> main").withColumn("other", F.pmod(F.xxhash64("rep"), outer))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumn("side", F.lit(1))
    left = named.withColumn("other", F.explode(F.sequence(F.lit(0), outer - 1))).withColumn("side", F.lit(0))
    columns = ["cluster", "block", "other", "side", "rep", "label"]
    meeting = left.select(columns).union(right.select(columns)).distinct().join(near.select("cluster", "rep", "text"), ["cluster", "rep"])
    met = meeting.groupBy("cluster", "block", "other").applyInPandas(_across, "rep long, component long")
    edges = write_stage(label.select("rep", F.col("label").alias("component")).union(met), "ngram-met")
    return clusters(edges.select(F.col("rep").alias("record"), F.col("component").alias("token"))).select(F.col("record").alias("rep"), F.col("cluster").alias("component"))


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    read = shipped(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    told = write_stage(_described(read), "ngram-sets")
    described = told.where("code is null").select("doc_id", "n_shingles", "h1", "h2", "marks")
    rows = described.drop("marks")
    often = told.where("code is not null").groupBy("code").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "code").limit(FREQUENT).collect()
    often = sorted((r["code"] % 2**64, int(r["seen"]).bit_length()) for r in often)
    common, ranks = np.array([c for c, _ in often], dtype=np.uint64), np.array([r for _, r in often], dtype=np.int8)

    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    shards = power_of_two(total * (100 - PERCENT) / 100 / SHARD, 16)
    blocks = _shards(read.where("doc_id is not null"), common, ranks, shards)
    pairs = write_stage(blocks.groupBy("shard").applyInPandas(_connect, PAIRS), "ngram-pairs")
    classes = described.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("marks").alias("marks"))
    groups = write_stage(_groups(pairs).join(classes.select("h1", "rep", "n_shingles"), "h1").drop("h1"), "ngram-groups")
    sizes = write_stage(_sized(groups), "ngram-sizes")
    load = sizes.where(F.col("size") <= STAR).agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    # bitmaps travel to the groups of their documents
    near = groups.join(sizes.where((F.col("size") > 1) & (F.col("size") <= STAR)).select("cluster"), "cluster").join(classes.select("rep", "n_shingles", "marks"), ["rep", "n_shingles"])
    pack = F.pmod(F.xxhash64("cluster"), F.lit(max(16, -(-load // STAR_PACK))))
    edges = near.withColumn("pack", pack).groupBy("pack").applyInPandas(_perhaps, "u long, v long")
    wide = groups.join(sizes.where(F.col("size") > STAR).select("cluster"), "cluster")
    hubs = wide.groupBy("cluster").agg(F.min("rep").alias("v"))
    edges = write_stage(edges.union(wide.join(hubs, "cluster").select(F.col("rep").alias("u"), "v")).where("u <> v").distinct(), "ngram-perhaps")

    linked = clusters(edges.select(F.explode(F.array("u", "v")).alias("record"), F.col("v").alias("token"))).withColumnRenamed("record", "rep")
    members = write_stage(linked.join(classes.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles")), "rep"), "ngram-members")
    sizes = write_stage(_sized(members), "ngram-sets-sized")
    shingles, larger = _totals(sizes)
    near = members.join(sizes, "cluster").join(read.select(F.col("doc_id").alias("rep"), "text"), "rep")
    if larger:  # these texts are needed more than once
        near = write_stage(near, "ngram-near")
    found = _packed(near.where(_fits()), shingles)
    if larger:
        large = write_stage(_large_groups(near.where(~_fits())), "ngram-classed")
        tied = clusters(large.select(F.col("rep").alias("record"), F.col("component").alias("token")))
        found = found.union(tied.select(F.col("record").alias("rep"), F.col("cluster").alias("component")))
    found = write_stage(found, "ngram-components")
    # an id with several texts ties their components together
    repeated = rows.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.countDistinct("h1").alias("texts")).where("texts > 1")
    classes = classes.join(found.groupBy("rep").agg(F.min("component").alias("component")), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    placed = rows.join(classes, ["h1", "h2"], "left")
    if not repeated.isEmpty():
        pairs = placed.where("component is not null and doc_id is not null").select("doc_id", "component").union(found)
        tied = clusters(pairs.select(F.col("doc_id").alias("record"), F.col("component").alias("token")))
        placed = rows.join(tied.select(F.col("record").alias("doc_id"), F.col("cluster").alias("component")), "doc_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", "n_shingles", own.alias("component_id"))
