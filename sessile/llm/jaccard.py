"""Near duplicates: an exact Jaccard join of shingle sets with count-vector R-trees.

A set's shingles are hashed into groups, a power of two that follows its size; its
counts by group are a point. Points of twice the groups fold into points of half.
Two sets share at most the sum of the smaller counts, and boxes of points bound
that from above, so a tree of boxes finds the pairs that can reach the threshold.
The survivors are verified on their sets.

Points of unrelated texts of one length lie close together, so a single tree over
a whole corpus would visit most pairs of leaves. Sets that can reach the threshold
share one of the first elements in a fixed order of all shingles (very frequent ones
last). All sets that share a first element form a cell, the least of them leads it,
and the cells of one leader are a star. Every star has its trees, whatever its size:
it is dealt into blocks of bounded size, each with the leader, and a tree a block
gives its candidates. First each set joins the star of its least leader alone, then
all stars whose sets this has not connected are joined. Where a star has several
blocks, its blocks then meet each other as far as it is still in several components.

Sets travel only for members that have a candidate. A task verifies candidates in
order of their bounds and joins what is linked, so a block gives fewer links than
it has members, and pairs that links already connect are not verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessile.llm import tokens
from sessile.llm.common import BROADCAST_ROWS, arrow_rows, stored, table
from sessile.llm.components import components

WIDTH = 5
#: Similarity of at least PART / WHOLE.
PART, WHOLE = 75, 100
#: Fewest and most groups, and shingles of a set for each group. Counts of unrelated sets of n
#: shingles differ by about 1.1 * sqrt(n * groups) in all, linked ones by 2 n / 7 at most.
GROUPS, MOST_GROUPS, EACH = 32, 1 << 22, 4
#: Trees fold points to at most so many groups; pairs that survive are bounded again by all of theirs.
TREE_GROUPS = 1024
#: Points of a leaf, and boxes of a box.
LEAF = 8
#: Members of a star that meet at once; larger stars are joined in blocks of about this size.
BLOCK = 256
#: Rows and bytes of blocks that a task works on at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 8_000, 32 << 20
#: At most so many shingles are held to be very frequent: those in this share of all, at least MANY.
FREQUENT = 1_000_000
MANY = 64
#: Texts of which a task remembers that it has seen the like, so that copies meet before the shuffle.
SEEN = 1_000_000


def first_length(n: int) -> int:
    """So many first elements: sets that reach the threshold share one of them."""
    return n - -(-PART * n // WHOLE) + 1 if n else 0


def least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fewest shared elements of linked sets of sizes a and b: 100 s >= 75 (a + b - s)."""
    return -(-PART * (a + b) // (PART + WHOLE))


def groups_for(n: int) -> int:
    """Groups for a set of n shingles; sizes of linked sets are so close that theirs differ by a factor of 2 at most."""
    g = GROUPS
    while g < MOST_GROUPS and g * EACH < n:
        g *= 2
    return g


def count_vector(s: np.ndarray) -> bytes:
    """A byte for the count of each group; more groups where a count would not fit."""
    g = groups_for(len(s))
    while True:
        counts = np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g)
        if counts.max() < 256:
            return counts.astype(np.uint8).tobytes()
        g *= 2


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points (rows) over fewer groups."""
    return points if points.shape[1] == groups else points.reshape(len(points), -1, groups).sum(axis=1, dtype=np.int32)


def _points(counts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(counts), np.uint8).reshape(len(counts), -1).astype(np.int32)


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return tokens.shingle_sets([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()], WIDTH)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that repeat among a task's texts, with their counts; and the number of all, under null."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        keep = c > 1
        return pa.RecordBatch.from_arrays([pa.array([None, *h[keep].view(np.int64).tolist()], pa.int64()), pa.array([int(c.sum()), *c[keep].tolist()], pa.int64())], ["h", "c"])

    held, size = [], 0
    for batch in batches:
        for s in _sets(batch):
            held.append(s)
            size += len(s)
        if size > 4_000_000:
            yield flush(held)
            held, size = [], 0
    yield flush(held)


def frequent(docs: DataFrame) -> np.ndarray:
    """Very frequent shingles, FREQUENT at most. Any such list gives the same links; a good one keeps cells small."""
    counts = stored(arrow_rows(docs.select("text")).mapInArrow(count_batches, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "shingle-counts")
    total = counts.filter("h IS NULL").agg(F.sum("c")).first()[0] or 0
    rows = counts.filter(F.col("h").isNotNull() & (F.col("c") >= max(MANY, -(-total // FREQUENT)))).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(np.int64).view(np.uint64))


def _lists(lists: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64), pa.int64()))


def feature_batches(common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text: size, digest and counts of its set, and its first elements, those that are very frequent apart.

    Of texts with one set that a task meets, the first alone gives its first elements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        none = np.zeros(0, np.uint64)
        for batch in batches:
            sizes, digests, counts, firsts, hots = [], [], [], [], []
            for s in _sets(batch):
                n = len(s)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                sizes.append(n)
                digests.append(digest)
                counts.append(count_vector(s))
                if digest in seen or not n:
                    firsts.append(none)
                    hots.append(none)
                    continue
                if len(seen) < SEEN:
                    seen.add(digest)
                k = first_length(n)
                is_common = np.zeros(n, bool)
                if len(common):
                    at = np.searchsorted(common, s)
                    at[at == len(common)] = 0
                    is_common = common[at] == s
                firsts.append(s[~is_common][:k])
                hots.append(s[is_common][: k - len(firsts[-1])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(counts, pa.binary()), _lists(firsts), _lists(hots)], ["doc_id", "n", "digest", "counts", "first", "hot"])

    return run


def cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, ordered by cell and row, to pairs of a row and the least row of a cell it is in.

    Only cells of several rows count; the least row is paired with itself. Cells stream
    through: of the last one, only the leader is held, and whether it was given out.
    """
    last_h, leader, out = None, None, True
    for batch in batches:
        h, row = batch.column("h").to_numpy(), batch.column("row").to_numpy()
        if not len(h):
            continue
        goes_on = last_h is not None and h[0] == last_h
        like_last = np.concatenate([[goes_on], h[1:] == h[:-1]])
        several = like_last | np.append(h[1:] == h[:-1], False)
        start = np.flatnonzero(~like_last)
        lead = np.empty(len(h), np.int64)
        lead[start] = row[start]
        if goes_on:
            lead[0] = leader
        at = np.where(~like_last, np.arange(len(h)), 0)
        lead = lead[np.maximum.accumulate(at)]
        pairs = np.stack([row[several], lead[several]])
        if goes_on and not out:
            pairs = np.concatenate([[[leader], [leader]], pairs], axis=1)
        last_h, leader, out = int(h[-1]), int(lead[-1]), bool(several[-1])
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["row", "leader"])


class CountForest:
    """R-trees over points of group counts, one for each tree number, all of them of the same height.

    A leaf holds LEAF points, of one component where that has enough of them in the
    tree, else of like size and like counts of the most varied groups.
    """

    def __init__(self, tree: np.ndarray, component: np.ndarray, points: np.ndarray) -> None:
        points = points.astype(np.int32)
        _, name, many = np.unique(np.stack([tree, component]), axis=1, return_inverse=True, return_counts=True)
        name = name.reshape(-1)
        kind = np.where(many[name] >= LEAF, name, -1)
        spread = np.argsort(-points.var(axis=0), kind="stable")[:2]
        size = points.sum(axis=1)
        self.order = np.lexsort((points[:, spread[1]] // 4, points[:, spread[0]] // 4, size // 8, kind, tree))
        of, box, n, c = tree[self.order], points[self.order], size[self.order], component[self.order]
        trees = len(np.unique(of))
        # Of each level: the tree of each box, its least and largest points, sizes and components, and its first child.
        self.levels = [(of, box, box, n, n, c, c, None)]
        while len(of) > trees:
            start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            position = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
            cut = np.flatnonzero(position % LEAF == 0)
            _, low, high, low_n, high_n, low_c, high_c, _ = self.levels[-1]
            least, most = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append((of[cut], least(low, cut), most(high, cut), least(low_n, cut), most(high_n, cut), least(low_c, cut), most(high_c, cut), cut))
            of = of[cut]

    def pairs(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of points of the trees of so many numbers, first[k] <= second[k], whose components differ and whose
        bound reaches what the threshold needs: positions, and how far. In parts of bounded size."""
        top = self.levels[-1][0]
        x, y = np.searchsorted(top, first), np.searchsorted(top, second)
        real = (x < len(top)) & (y < len(top))
        x, y, first, second = x[real], y[real], first[real], second[real]
        real = (top[x] == first) & (top[y] == second)
        yield from self._below(len(self.levels) - 1, x[real], y[real])

    def _below(self, level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        _, _, high, low_n, high_n, low_c, high_c, child = self.levels[level]
        keep = (i <= j if level else i < j) & ~((low_c[i] == high_c[i]) & (low_c[j] == high_c[j]) & (low_c[i] == low_c[j]))
        i, j = i[keep], j[keep]
        # Sizes alone first: the smaller set bounds what is shared.
        need = least_shared(low_n[i], low_n[j])
        keep = np.minimum(high_n[i], high_n[j]) >= need
        i, j, need = i[keep], j[keep], need[keep]
        shared = np.zeros(len(i), np.int64)
        step = max(64, (1 << 21) // high.shape[1])  # pairs compared at once, for memory
        for at in range(0, len(i), step):
            shared[at : at + step] = np.minimum(high[i[at : at + step]], high[j[at : at + step]]).sum(axis=1)
        keep = shared >= need
        i, j = i[keep], j[keep]
        if not level:
            if len(i):
                yield self.order[i], self.order[j], shared[keep] / np.maximum(need[keep], 1)
            return
        ends = np.append(child[1:], len(self.levels[level - 1][0]))
        for at in range(0, len(i), 4096):
            a, b = i[at : at + 4096], j[at : at + 4096]
            ca, cb = child[a][:, None] + np.arange(LEAF), child[b][:, None] + np.arange(LEAF)
            real = (ca < ends[a][:, None])[:, :, None] & (cb < ends[b][:, None])[:, None, :]
            k, p, q = np.nonzero(real)
            yield from self._below(level - 1, ca[k, p], cb[k, q])


def _ratios(counts: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far the count bound of each pair exceeds what a link needs: 1 or more if the two may be linked."""
    out = np.zeros(len(x))
    width = np.array([len(c) for c in counts])
    for gx, gy in {*zip(width[x].tolist(), width[y].tolist(), strict=True)}:
        at = np.flatnonzero((width[x] == gx) & (width[y] == gy))
        least, step = min(gx, gy), max(1, (1 << 22) // max(gx, gy))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            a, b = (folded(_points([counts[i] for i in v[part]]), least) for v in (x, y))
            out[part] = np.minimum(a, b).sum(axis=1) / np.maximum(least_shared(a.sum(axis=1), b.sum(axis=1)), 1)
    return out


def tree_pairs(block: np.ndarray, own: np.ndarray, side: np.ndarray, component: np.ndarray, n: np.ndarray, counts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one block that may be linked, as (positions, positions, how far the bound exceeds the need).

    Blocks are numbered from 0. A block of its own joins its rows with each other,
    others join the rows of side 0 with those of side 1. Sets of linked texts have
    the same number of groups, or one has twice those of the other.
    """
    width = np.array([groups_for(k) for k in n.tolist()], np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        tree_width = min(w, TREE_GROUPS)
        wide = width[rows] == 2 * w
        points = np.empty((len(rows), tree_width), np.int32)
        size_of = np.array([len(counts[r]) for r in rows.tolist()])
        for g in np.unique(size_of).tolist():
            at = np.flatnonzero(size_of == g)
            points[at] = folded(_points([counts[r] for r in rows[at].tolist()]), tree_width)
        # Four trees a block: side 0 and 1 of the sets of w groups, then of those of 2 w.
        forest = CountForest(4 * block[rows] + 2 * wide + side[rows], component[rows], points)
        mine, others = np.unique(block[rows][own[rows]]) * 4, np.unique(block[rows][~own[rows]]) * 4
        first = np.concatenate([mine, mine, others, others, others + 1])
        second = np.concatenate([mine, mine + 2, others + 1, others + 3, others + 2])
        for x, y, ratio in forest.pairs(first, second):
            x, y = rows[x], rows[y]
            if w > TREE_GROUPS:
                ratio = _ratios(counts, x, y)
                x, y, ratio = x[ratio >= 1], y[ratio >= 1], ratio[ratio >= 1]
            yield x, y, ratio


KEYS = ("lead", "i", "j", "side", "node", "component")


def _blocks(batches: Iterator[pa.RecordBatch], extra: str) -> Iterator[tuple[dict[str, np.ndarray], list, np.ndarray]]:
    """Whole blocks of rows that are ordered by KEYS, several at once: keys, the extra column, block numbers."""
    held: list[dict[str, np.ndarray]] = []
    more: list = []
    size = rows = 0

    def cut(last: bool) -> tuple[dict[str, np.ndarray], list, np.ndarray] | None:
        nonlocal held, more, size, rows
        k = {c: np.concatenate([h[c] for h in held]) for c in KEYS}
        new = np.concatenate([[True], (k["lead"][1:] != k["lead"][:-1]) | (k["i"][1:] != k["i"][:-1]) | (k["j"][1:] != k["j"][:-1])])
        end = len(new) if last else int(np.flatnonzero(new)[-1])  # the last block may go on
        if not end:
            held = [k]
            return None
        out = {c: v[:end] for c, v in k.items()}, more[:end], np.cumsum(new[:end]) - 1
        held, more = [{c: v[end:] for c, v in k.items()}], more[end:]
        rows, size = len(more), sum(len(x) for x in more)
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({c: batch.column(c).to_numpy().astype(np.int64) for c in KEYS})
        column = batch.column(extra)
        if pa.types.is_list(column.type):
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
            values = [flat[a:b].copy() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        else:
            values = column.to_pylist()
        more += values
        rows += len(values)
        size += sum(len(x) for x in values)
        if rows >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
            out = cut(False)
            if out:
                yield out
    if rows:
        yield cut(True)


def candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks that are in a pair which may be linked; the counts are left out."""
    for k, counts, block in _blocks(batches, "counts"):
        n = np.fromiter((sum(c) for c in counts), np.int64, len(counts))
        found = np.zeros(len(n), bool)
        for x, y, _ in tree_pairs(block, k["i"] == k["j"], k["side"], k["component"], n, counts):
            found[x] = found[y] = True
        yield pa.RecordBatch.from_arrays([pa.array(k[c][found]) for c in KEYS], list(KEYS))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(b) < len(a):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their sets to links (a, b) that connect, in each block, whatever its links connect.

    A set that several tasks gave comes several times, one after the other; once counts.
    Of a component without links before, b is one node: the leader, or else the least.
    """
    for k, sets, block in _blocks(batches, "items"):
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (k["side"][1:] != k["side"][:-1]) | (k["node"][1:] != k["node"][:-1])])
        k, sets, block = {c: v[new] for c, v in k.items()}, [x for x, first in zip(sets, new.tolist(), strict=True) if first], block[new]
        n = np.array([len(s) for s in sets], np.int64)
        parts = list(tree_pairs(block, k["i"] == k["j"], k["side"], k["component"], n, [count_vector(s) for s in sets]))
        x, y, ratio = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(3))
        order = np.lexsort((y, x, -ratio, block[x])) if len(x) else x
        # One name for a component in a block; names are joined as links are found.
        _, name = np.unique(np.stack([block, k["component"]]), axis=1, return_inverse=True)
        name = name.reshape(-1).tolist()
        parent = list(range(len(name)))

        def root(v: int, parent: list[int] = parent) -> int:
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            return v

        a, b = [], []
        for p, q in zip(x[order].tolist(), y[order].tolist(), strict=True):
            u, v = root(name[p]), root(name[q])
            if u == v:
                continue
            s = shared(sets[p], sets[q])
            if WHOLE * s >= PART * (len(sets[p]) + len(sets[q]) - s):
                parent[max(u, v)] = min(u, v)
                a.append(p)
                b.append(q)
        # One row of a node in each component that links have made, the leader where it is in it, stands for it.
        node, lead = k["node"].tolist(), k["lead"].tolist()
        chief: dict[int, int] = {}
        for r in dict.fromkeys(a + b):
            u = root(name[r])
            at = chief.setdefault(u, r)
            if (node[r] != lead[r], node[r]) < (node[at] != lead[at], node[at]):
                chief[u] = r
        rows = [(node[r], node[chief[root(name[r])]]) for r in dict.fromkeys(a + b)]
        rows = [r for r in rows if r[0] != r[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in (0, 1)], ["a", "b"])


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests and sets of texts; a set that repeats in a task is given once, as far as the task remembers."""
    seen: set[bytes] = set()
    for batch in batches:
        digests, sets = [], []
        for s in _sets(batch):
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            if digest in seen:
                continue
            if len(seen) < SEEN:
                seen.add(digest)
            digests.append(digest)
            sets.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), _lists(sets)], ["digest", "items"])


def digested(docs: DataFrame, name: str) -> DataFrame:
    """The documents with one more column: the digest of the set of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in _sets(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_rows(docs).mapInArrow(run, f"{fields}, `{name}` binary")


def _links(dealt: DataFrame, counts: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) of nodes that connect what the links within blocks (lead, i, j) of nodes connect.

    Trees over the counts first tell which rows of a block have a candidate. Sets are
    made again from the texts of those nodes alone and meet in the blocks.
    """
    keys = ", ".join(f"{k} long" for k in KEYS)
    blocks = dealt.join(counts, "node").select(*KEYS, "counts").repartition("lead", "i", "j").sortWithinPartitions(*KEYS)
    rows = stored(arrow_rows(blocks).mapInArrow(candidate_batches, keys).join(nodes, "node"), "candidates")
    ids = rows.select(F.col("doc_id").alias("_id")).distinct()
    side = F.broadcast(ids) if ids.count() <= 10 * BROADCAST_ROWS else ids
    texts = docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = arrow_rows(texts).mapInArrow(set_batches, "digest binary, items array<long>")
    blocks = sets.join(rows.drop("doc_id"), "digest").select(*KEYS, "items").repartition("lead", "i", "j").sortWithinPartitions(*KEYS)
    return stored(arrow_rows(blocks).mapInArrow(link_batches, "a long, b long").distinct(), "links")


def join(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links reach, its own included).

    Documents are the same set, or linked, as their whole texts say; a text without
    words, or null, has no shingles and is linked with nothing. Rows that repeat each
    give a row. Rows with a null id take part; a component of them alone has a null
    name. An empty table gives no rows; other columns are ignored.
    """
    return decided(docs).drop("digest")


def decided(docs: DataFrame) -> DataFrame:
    """The rows of join, with the digest of each document's set."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    features = stored(
        arrow_rows(docs.select("doc_id", "text")).mapInArrow(feature_batches(frequent(docs)), f"doc_id {kind}, n int, digest binary, counts binary, first array<long>, hot array<long>")
        .withColumn("row", F.monotonically_increasing_id()), "shingle-sets")
    full = features.filter("n > 0")
    sets = stored(full.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")), "set-groups")
    members = stored(full.select("row", "doc_id", "n", "digest").join(sets, "digest"), "set-members")
    nodes = stored(members.filter("row = node").select("node", "doc_id", "digest"), "set-nodes")
    # Cells of first elements and the stars of their leaders. Leaders of very frequent elements, FREQUENT at most, are
    # found by partial aggregation and broadcast; the other cells are small.
    hot = full.select("row", F.explode("hot").alias("h"))
    leaders = hot.groupBy("h").agg(F.min("row").alias("leader"), F.count("*").alias("c")).filter("c > 1").drop("c")
    cells = (arrow_rows(full.select("row", F.explode("first").alias("h")).repartition("h").sortWithinPartitions("h", "row"), 100_000)
        .mapInArrow(cell_batches, "row long, leader long").union(hot.join(F.broadcast(leaders), "h").select("row", "leader")).distinct())
    node_of = members.select("row", "node")
    stars = stored(cells.join(node_of, "row").join(node_of.select(F.col("row").alias("leader"), F.col("node").alias("lead")), "leader").select("lead", "node").filter("lead <> node").distinct(), "stars")
    counts = features.select(F.col("row").alias("node"), "counts")
    # Each set in the star of its least leader alone. No set is in two of these, so its link tells its component so far.
    least = stars.groupBy("node").agg(F.min("lead").alias("lead")).select("lead", "node")
    links = _links(_dealt(least.withColumn("component", F.col("node")), least.select("lead").distinct().withColumn("component", F.col("lead"))), counts, docs, nodes)
    # All stars with sets that are still apart.
    so_far = links.groupBy("a").agg(F.min("b").alias("component"))
    label = lambda rows, c: rows.join(so_far.withColumnRenamed("a", c), c, "left").withColumn("component", F.coalesce("component", c))
    labelled, leads = label(stars, "node"), label(stars.select("lead").distinct(), "lead")
    labelled = stored(labelled.select("lead", "node", "component"), "star-labels")
    apart = labelled.join(leads.withColumnRenamed("component", "of_lead"), "lead").groupBy("lead").agg(F.count_if(F.col("component") != F.col("of_lead")).alias("others")).filter("others > 0").select("lead")
    apart = stored(apart, "open-stars")
    links = stored(links.union(_links(_dealt(labelled.join(apart, "lead"), leads.join(apart, "lead")), counts, docs, nodes)), "all-links")
    named = components(links)
    large = stored(stars.groupBy("lead").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK).select("lead"), "large-stars")
    if large.limit(1).count():
        # Links between blocks join components by their names.
        more = _links(_between(stars.join(large, "lead"), named), counts, docs, nodes)
        for c in ("a", "b"):
            more = more.join(named.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
        joined = stored(more.filter("a <> b"), "component-links")
        if joined.limit(1).count():
            joined = components(joined).withColumnRenamed("node", "was").withColumnRenamed("component", "now")
            both = stored(named.join(joined.withColumnRenamed("was", "component"), "component", "left").select("node", F.coalesce("now", "component").alias("component")), "components")
            named = both.union(joined.join(both, joined["was"] == both["node"], "left_anti").select("was", "now"))
    grouped = stored(members.join(named, "node", "left").withColumn("component", F.coalesce("component", "node")), "grouped")
    names = stored(grouped.groupBy("component").agg(F.min("least_id").alias("component_id")), "component-names")
    empty = features.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "digest")
    return grouped.join(names, "component").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "digest").unionByName(empty)


def _dealt(members: DataFrame, leads: DataFrame) -> DataFrame:
    """Blocks of the stars (lead, node, component), each with its leader (lead, component)."""
    sized = stored(members.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "star-sizes")
    inside = members.join(sized, "lead").select("lead", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("i"), "node", "component")
    leading = leads.join(sized, "lead").select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), F.col("lead").alias("node"), "component")
    return inside.union(leading).select("lead", "i", F.col("i").alias("j"), "node", "component", F.lit(0).cast("long").alias("side"))


def _between(stars: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs of blocks of the stars that are still in several components.

    A component that fills blocks has blocks of its own, which need not meet each
    other; all else of a star is dealt into blocks that meet each block of the star.
    """
    labelled = stored(stars.join(named, "node", "left").select("lead", "node", F.coalesce("component", "node").alias("component")), "star-components")
    parts = labelled.groupBy("lead", "component").agg(F.count("*").alias("c")).withColumn("own", F.col("c") >= BLOCK)
    open_stars = parts.groupBy("lead").agg(F.count("*").alias("parts"), F.sum(F.when(~F.col("own"), F.col("c"))).alias("mixed")).filter("parts > 1")
    blocks = F.ceil(F.when(F.col("own"), F.col("c")).otherwise(F.col("mixed")) / BLOCK).cast("long")
    parts = stored(parts.join(open_stars, "lead").select("lead", "component", F.when(F.col("own"), F.col("component")).otherwise(-1).alias("tag"), blocks.alias("blocks")), "star-parts")
    name = lambda number: F.xxhash64("tag", number)
    each = stored(parts.select("lead", "tag", "blocks").distinct().select("lead", "tag", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b")).select("lead", "tag", name(F.col("b")).alias("i")), "star-blocks")
    meet = each.join(each.select("lead", F.col("tag").alias("tag_j"), F.col("i").alias("j")), "lead").filter("i <= j AND (tag = -1 OR tag <> tag_j)").select("lead", "i", "j")
    rows = labelled.join(parts, ["lead", "component"]).select("lead", "node", "component", name(F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("at"))
    sides = [rows.join(meet.withColumn("at", F.col(c)), ["lead", "at"]).filter(f"i <> j OR {s} = 0").select("lead", "i", "j", "node", "component", F.lit(s).cast("long").alias("side")) for s, c in enumerate("ij")]
    return sides[0].union(sides[1])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: Pairs of equal shingles counted, then all that links reach. Ids are taken to be unique.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i) WHERE len(l) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
f AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x, y FROM f UNION SELECT r.x, f.y FROM r JOIN f ON r.y = f.x),
m AS (SELECT x, min(y) AS least FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.x = w.doc_id
"""
