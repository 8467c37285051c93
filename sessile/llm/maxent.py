"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

A word's probability is that of its class, given the words before it, times that of
the word within its class, given the word before. Both are softmaxes over the weights
of hashed features:

* Classes are the most frequent words, one each, and groups of all others by a hash of
  their endings. Their features are a bias, the word before, the pair of the two words
  before, and the word before the last (a skip); words enter as one of `buckets` numbers.
* A word in a group has the log of its count + 1 as a fixed weight and, if it is among the
  FREQUENT ones, a learned weight for each pair (head, word) seen LEAST_SEEN times, where
  the head is the word before as one of `heads` numbers. The sum below the fraction is
  that of the class plus what these pairs change, so it is exact and takes a sum over
  them alone.

The counted vocabulary sets the numbers of buckets, classes, hashed rows and heads
(`Sizes`); the pairs (head, word) are a distributed table. Each update
adds up gradients that Spark tasks compute over their part of the counts. Of the tables
that tasks hold, the one of classes and that of sums (heads by classes) stop at
TABLE_CELLS. Texts are scored in batches: the softmax of each context that a batch has.

Word counts and pairs stay distributed tables. The most frequent words and pairs, a
bounded number, are sent to all tasks; the others of each text meet the tables in a
shuffle join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessile.llm import tokens
from sessile.llm.common import arrow_rows, fold, give_back, stored, table

FOLDS, HELD_OUT = 7, 2
#: Words and pairs known to all tasks at most; the rest is joined.
FREQUENT, FREQUENT_PAIRS = 200_000, 250_000
#: Cells at most of a table that every task holds.
TABLE_CELLS = 1 << 22
ACTIVE = 4
UPDATES, PAIR_UPDATES = 25, 4
#: A pair has a weight if it was seen so often.
LEAST_SEEN = 2
#: Slots of the bitmap that tells most pairs without a weight from those to be joined.
SLOTS, PART = 1 << 25, 1 << 19
#: The inverse variance of a Gaussian prior on the weights of pairs.
PRIOR = 1.0
#: Cells of one row of the sums that tasks send.
SLICE = 8192
#: The hash that stands for the end of a text; no word is likelier to have it than any other.
END = np.uint64(0x5EED0F7EC7ED0E4D)


def _power(x: float, least: int) -> int:
    return max(least, 1 << max(0, round(np.log2(max(x, 1.0)))))


@dataclass(frozen=True)
class Sizes:
    """Numbers that follow the counted vocabulary, as powers of two.

    Of the buckets and heads, 0 is the start of a text, the next are frequent words, the
    others hashes (of endings, of words). Of the classes, the first are frequent words,
    then comes the end, then endings.
    """

    buckets: int
    classes: int
    heads: int

    @classmethod
    def of(cls, words: int) -> Sizes:
        buckets, classes, heads = _power(12 * words ** (1 / 5), 64), _power(3 * words ** (1 / 5), 16), _power(words ** (1 / 2) / 2, 32)
        while cls(buckets, classes, heads).rows * classes > TABLE_CELLS:
            buckets //= 2
        while heads * classes > TABLE_CELLS:
            heads //= 2
        return cls(buckets, classes, heads)

    @property
    def own_buckets(self) -> int:
        return self.buckets // 2 - 1

    @property
    def own_classes(self) -> int:
        return self.classes // 2 - 1

    @property
    def own_heads(self) -> int:
        return self.heads // 2 - 1

    @property
    def pairs(self) -> int:
        """Rows of the class weights for hashed pairs; bias, word before and skip have rows of their own."""
        return 16 * self.buckets

    @property
    def first_total(self) -> int:
        """Keys of counts: first (context, class), from here (head, class) of words in groups, then (rank, head)."""
        return self.buckets * self.buckets * self.classes

    @property
    def first_pair(self) -> int:
        return self.first_total + self.heads * self.classes

    @property
    def rows(self) -> int:
        return 1 + 2 * self.buckets + self.pairs

    def group(self, endings: np.ndarray) -> np.ndarray:
        return self.own_classes + 1 + endings % (self.classes - 1 - self.own_classes)


def context_rows(contexts: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The active rows of the class weights for each context (bucket before * buckets + bucket before that)."""
    b1, b2 = contexts // sizes.buckets, contexts % sizes.buckets
    pair = (tokens.mixed(contexts.astype(np.uint64) + np.uint64(1)) % np.uint64(sizes.pairs)).astype(np.int64)
    return np.stack([np.zeros(len(contexts), np.int64), 1 + b1, 1 + sizes.buckets + b2, 1 + 2 * sizes.buckets + pair], 1)


def log_softmax(weights: np.ndarray, contexts: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Natural log of the class distribution of each context."""
    rows = context_rows(contexts, sizes)
    z = weights[rows[:, 0]]
    for k in range(1, ACTIVE):
        z = z + weights[rows[:, k]]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _found(held: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value in an array in order, and whether it is there."""
    if not len(held):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(held, values), len(held) - 1)
    return at, held[at] == values


@dataclass
class Lexicon:
    """The most frequent words: hashes in order, counts, ranks by frequency (the end: -1); by rank count + 1 and class."""

    sizes: Sizes
    hashes: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    bases: np.ndarray
    classes: np.ndarray

    @classmethod
    def of(cls, sizes: Sizes, hashes: np.ndarray, endings: np.ndarray, counts: np.ndarray) -> Lexicon:
        order = np.argsort(hashes)
        hashes, endings, counts = hashes[order], endings[order], counts[order]
        by_count = np.lexsort((hashes, -counts))
        by_count = by_count[hashes[by_count] != END]
        ranks = np.full(len(hashes), -1, np.int64)
        ranks[by_count] = np.arange(len(by_count))
        classes = sizes.group(endings[by_count])
        own = min(sizes.own_classes, len(classes))
        classes[:own] = np.arange(own)
        return cls(sizes, hashes, counts, ranks, counts[by_count] + 1.0, classes)

    def numbers(self, words: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class, bucket, head and rank (-1: none) of each word."""
        s = self.sizes
        at, known = _found(self.hashes, words)
        rank = np.where(known, self.ranks[at], -1) if len(self.hashes) else np.full(len(words), -1)
        other = (tokens.mixed(words) % np.uint64(s.heads - 1 - s.own_heads)).astype(np.int64)

        def own(most: int, first: int, otherwise: np.ndarray) -> np.ndarray:
            return np.where((rank >= 0) & (rank < most), first + rank, otherwise)

        classes = own(s.own_classes, 0, s.group(endings))
        classes[words == END] = s.own_classes
        return classes, own(s.own_buckets, 1, 1 + s.own_buckets + endings % (s.buckets - 1 - s.own_buckets)), own(s.own_heads, 1, 1 + s.own_heads + other), rank


def stream(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts as (words, 16 bits of a hash of their endings, first position of each text), an END after each text."""
    for _, chunk in tokens.in_chunks(texts):
        words, counts, endings = tokens.words_and_ends(chunk)
        endings = (endings & np.uint64(0xFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(counts + 1)])
        is_end = np.zeros(first[-1], bool)
        is_end[first[1:] - 1] = True
        all_words, all_endings = np.empty(first[-1], np.uint64), np.zeros(first[-1], np.int64)
        all_words[is_end], all_words[~is_end], all_endings[~is_end] = END, words, endings
        yield all_words, all_endings, first


def before(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number before each position and the one before that; 0 where a text has none."""
    one, two = np.concatenate([[0], numbers[:-1]]), np.concatenate([[0, 0], numbers[:-2]])[: len(numbers)]
    starts = first[:-1]
    one[starts] = two[starts] = 0
    second = starts + 1
    two[second[second < first[1:]]] = 0
    return one, two


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Arrays (key, others, count) of several parts as one: keys in order, counts of equal keys added up."""
    arrays = [np.concatenate([h[i] for h in held]) for i in range(len(held[0]))]
    order = np.argsort(arrays[0], kind="stable")
    arrays = [x[order] for x in arrays]
    new = np.flatnonzero(np.concatenate([[True], arrays[0][1:] != arrays[0][:-1]])) if len(order) else order
    return (*(x[new] for x in arrays[:-1]), np.add.reduceat(arrays[-1], new) if len(new) else arrays[-1])


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts in a task's texts, and the hash of their endings."""
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> pa.RecordBatch:
        w, g, c = merged(held)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(g), pa.array(c)], ["w", "g", "c"])

    size = 0
    for batch in batches:
        for words, endings, _ in stream(_texts(batch)):
            w, at, c = np.unique(words, return_index=True, return_counts=True)
            held.append((w, endings[at], c.astype(np.int64)))
            size += len(w)
            if size > 3_000_000:
                held = [merged(held)]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def feature_batches(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of a task's texts by key: (context, class), (head, class) of words in groups, (rank, head) of those with a rank."""
    s = lexicon.sizes

    def rows(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 100_000]), pa.array(n[k : k + 100_000])], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for words, endings, first in stream(_texts(batch)):
                classes, buckets, heads, rank = lexicon.numbers(words, endings)
                one, two = before(buckets, first)
                head = before(heads, first)[0]
                grouped = classes > s.own_classes
                ranked = grouped & (rank >= 0)
                keys = ((one * s.buckets + two) * s.classes + classes, s.first_total + head[grouped] * s.classes + classes[grouped], s.first_pair + rank[ranked] * s.heads + head[ranked])
                held.append(np.unique(np.concatenate(keys), return_counts=True))
                size += len(held[-1][0])
            if size > 6_000_000:
                held = [merged(held)]
                size = len(held[0][0])
                if size > 4_000_000:
                    yield from rows(*held[0])
                    held, size = [], 0
        if held:
            yield from rows(*merged(held))

    return run


def feature_sums(contexts: np.ndarray, values: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Sums of the contexts' rows of values over the rows of the weight table that each context has."""
    out = np.zeros((sizes.rows, sizes.classes))
    rows = context_rows(contexts, sizes)
    for k in range(ACTIVE):
        order = np.argsort(rows[:, k], kind="stable")
        at = rows[order, k]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] += np.add.reduceat(values[order], first, axis=0)
    return out


def gradient_batches(weights: np.ndarray | None, sizes: Sizes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Expected feature counts over a part of the contexts, and the log likelihood; without weights the observed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, likelihood, any_rows = np.zeros((sizes.rows, sizes.classes)), 0.0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            any_rows = True
            contexts = batch.column("context").to_numpy()
            n = np.zeros((len(contexts), sizes.classes))
            lists = batch.column("cells")
            owner = np.repeat(np.arange(len(contexts)), np.diff(lists.offsets.to_numpy()))
            cells = lists.flatten()
            n[owner, cells.field("class").to_numpy()] = cells.field("n").to_numpy()
            if weights is None:
                sums += feature_sums(contexts, n, sizes)
                continue
            logs = log_softmax(weights, contexts, sizes)
            likelihood += float((n * logs).sum())
            sums += feature_sums(contexts, np.exp(logs) * n.sum(axis=1, keepdims=True), sizes)
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([sums.astype("<f4").tobytes()], pa.binary()), pa.array([likelihood])], ["sums", "likelihood"])

    return run


def train(cells: DataFrame, sizes: Sizes, updates: int = UPDATES) -> tuple[np.ndarray, list[float]]:
    """Class weights of the feature rows, and the log likelihood before each update.

    The gradient of a weight is its observed count less the expected one. Each is
    divided by the larger of the two (and by the features active at a time), which
    bounds the step. Tasks return one table each, rows by classes.
    """
    shape = (sizes.rows, sizes.classes)

    def summed(weights: np.ndarray | None) -> tuple[np.ndarray, float]:
        parts = cells.mapInArrow(gradient_batches(weights, sizes), "sums binary, likelihood double").collect()
        return sum((np.frombuffer(p.sums, "<f4").reshape(shape).astype(np.float64) for p in parts), np.zeros(shape)), sum(p.likelihood for p in parts)

    weights, told = np.zeros(shape), []
    seen, _ = summed(None)
    for _ in range(updates if seen.any() else 0):
        expected, likelihood = summed(weights)
        told.append(likelihood)
        give_back()
        weights = weights + 2.0 / ACTIVE * (seen - expected) / (np.maximum(seen, expected) + 5.0)
    return weights, told


def pair_weights(n: np.ndarray, base: np.ndarray, totals: np.ndarray, bare: np.ndarray, below: list[np.ndarray]) -> np.ndarray:
    """Weights of pairs after the updates whose sums below the fraction are given.

    n and base are the counts of pairs and of words + 1, totals the occurrences of any
    word of the class after the head, bare and below the sums: without weights, and before
    each update. Weights start at the log of the ratio of counts to expected counts. An
    update adds the gradient of the penalised log likelihood (count, less the expected
    count, less PRIOR times the weight) over the larger of the two counts plus PRIOR. No
    state but the sums is needed, so a lost task makes its updates again.
    """
    weights = np.log((n + PRIOR) / (totals / bare * base + PRIOR))
    for sums in below:
        expected = totals / sums * base * np.exp(weights)
        weights += (n - expected - PRIOR * weights) / (np.maximum(n, expected) + PRIOR)
    return weights


@dataclass
class PairModel:
    """What tasks need to tell the weights of pairs: by rank count + 1 and class, by class the bare sums, by cell (head, class) totals and sums."""

    sizes: Sizes
    bases: np.ndarray
    classes: np.ndarray
    class_sums: np.ndarray
    totals: np.ndarray
    below: list[np.ndarray]

    def weigh(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of pairs from 0, cells, and weights."""
        key = batch.column("key").to_numpy() - self.sizes.first_pair
        rank = key // self.sizes.heads
        group = self.classes[rank]
        cell = key % self.sizes.heads * self.sizes.classes + group
        n = batch.column("n").to_numpy().astype(np.float64)
        return key, cell, pair_weights(n, self.bases[rank], self.totals[cell], self.class_sums[group], [b[cell] for b in self.below])


def cell_sums(pairs: DataFrame, model: PairModel) -> np.ndarray:
    """By cell (head, class): what the pairs' weights add to the sum below the fraction.

    Tasks send tables in slices, each of which is added up in one task; the driver gets one table of heads by classes.
    """
    cells = model.sizes.heads * model.sizes.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(cells)
        for batch in batches:
            key, cell, weights = model.weigh(batch)
            out += np.bincount(cell, model.bases[key // model.sizes.heads] * np.expm1(weights), cells)
        used = [k for k in range(0, cells, SLICE) if out[k : k + SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([out[k : k + SLICE].tobytes() for k in used], pa.binary())], ["first", "sums"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in part["sums"])
        return pa.table({"first": part["first"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(cells)
    for r in arrow_rows(pairs, 200_000).mapInArrow(run, "first int, sums binary").groupBy("first").applyInArrow(add, "first int, sums binary").collect():
        part = np.frombuffer(r.sums, np.float64)
        out[r.first : r.first + len(part)] = part
    return out


def train_pairs(pairs: DataFrame, lexicon: Lexicon, totals: np.ndarray, class_sums: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Weights of pairs (key, n) as a table (k, gain, n), and the sums below the fraction by head and class.

    totals has the occurrences of each (head, class), class_sums the sums of classes without any pair.
    """
    sizes = lexicon.sizes
    model = PairModel(sizes, lexicon.bases, lexicon.classes, class_sums, totals.astype(np.float32), [])
    for k in range(PAIR_UPDATES + 1):
        below = np.tile(class_sums, sizes.heads) + cell_sums(pairs, model)
        if k < PAIR_UPDATES:
            model.below.append(below.astype(np.float32))
        give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, _, weights = model.weigh(batch)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(weights / np.log(10)), batch.column("n")], ["k", "gain", "n"])

    return stored(arrow_rows(pairs, 200_000).mapInArrow(run, "k long, gain double, n long"), "pair-weights"), below.reshape(sizes.heads, sizes.classes)


def slots(keys: np.ndarray) -> np.ndarray:
    return (tokens.mixed(keys.view(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)


def bitmap(pairs: DataFrame) -> np.ndarray:
    """A table of SLOTS bits, true at the slot of each pair: a pair whose bit is false is not among them.

    Parts are made apart, each from its distinct slots (PART at most), so the driver gets bits alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots(batch.column("k").to_numpy())))], ["slot"])

    def bits(part: pa.Table) -> pa.Table:
        at = part["slot"].to_numpy()
        out = np.zeros(PART, bool)
        out[at % PART] = True
        return pa.table({"part": pa.array([int(at[0]) // PART]), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    slot = arrow_rows(pairs.select("k"), 200_000).mapInArrow(run, "slot long").distinct()
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in slot.groupBy(F.expr(f"slot div {PART}")).applyInArrow(bits, "part long, bits binary").collect():
        out[r.part * PART // 8 : (r.part + 1) * PART // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _level(count: str):  # noqa: ANN202
    return F.floor(F.log2(count) * 16)


def most_frequent(counts: DataFrame, count: str, most: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows with the largest counts, so many at most, cut between levels of counts; the others; all rows' number."""
    by_level = sorted(counts.groupBy(_level(count).alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level)
    least, known = 1 << 30, 0
    for r in by_level:
        if known + r.n > most:
            break
        least, known = r.level, known + r.n
    return counts.filter(_level(count) >= least), counts.filter(_level(count) < least), sum(r.n for r in by_level)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    below: np.ndarray  # sums below the fraction by head and class
    pair_keys: np.ndarray  # of frequent pairs (rank * heads + head), in order
    pair_gains: np.ndarray
    others: np.ndarray  # bitmap of the other pairs
    tokens: int  # of the training texts
    words: int  # distinct ones
    class_tokens: np.ndarray
    class_words: np.ndarray


def fit(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the documents (all of them), their word counts (w, c) and the pairs that the model does not hold (k, gain)."""
    texts = docs.select("text")
    words = stored(arrow_rows(texts).mapInArrow(count_batches, "w long, g long, c long").groupBy("w", "g").agg(F.sum("c").alias("c")), "word-counts")
    top, _, distinct = most_frequent(words, "c", FREQUENT)
    sizes = Sizes.of(distinct)
    top = top.select("w", "g", "c").toPandas()
    lexicon = Lexicon.of(sizes, top["w"].to_numpy(np.int64).view(np.uint64), top["g"].to_numpy(np.int64), top["c"].to_numpy(np.int64))

    counted = arrow_rows(texts).mapInArrow(feature_batches(lexicon), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = stored(counted.filter((F.col("key") < sizes.first_pair) | (F.col("n") >= LEAST_SEEN)), "features")
    cells = counted.filter(F.col("key") < sizes.first_total).select(F.expr(f"key div {sizes.classes}").alias("context"), F.struct((F.col("key") % sizes.classes).alias("class"), "n").alias("cell"))
    cells = stored(cells.groupBy("context").agg(F.collect_list("cell").alias("cells")), "contexts")
    # buckets * buckets rows at most: a few tasks are enough for them.
    weights, _ = train(arrow_rows(cells.coalesce(8), 5_000), sizes)

    group = F.lit(sizes.own_classes + 1) + F.col("g") % (sizes.classes - 1 - sizes.own_classes)
    class_tokens, class_words = np.zeros(sizes.classes, np.int64), np.zeros(sizes.classes, np.int64)
    for r in words.groupBy(group.cast("int").alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        class_tokens[r.g], class_words[r.g] = r.c, r.n
    # Words with a class of their own leave the class of their endings.
    single = {int(w): int(i) for w, i in zip(lexicon.hashes.view(np.int64), lexicon.ranks, strict=True) if 0 <= i < sizes.own_classes} | {int(END.view(np.int64)): sizes.own_classes}
    total = int(class_tokens.sum())
    for r in words.filter(F.col("w").isin(list(single))).select("w", "c", group.cast("int").alias("g")).collect():
        class_tokens[r.g] -= r.c
        class_words[r.g] -= 1
        class_tokens[single[r.w]], class_words[single[r.w]] = r.c, 1

    give_back()
    after = counted.filter((F.col("key") >= sizes.first_total) & (F.col("key") < sizes.first_pair)).toPandas()
    totals = np.zeros(sizes.heads * sizes.classes)
    totals[after["key"].to_numpy(np.int64) - sizes.first_total] = after["n"].to_numpy(np.int64)
    pairs = counted.filter(F.col("key") >= sizes.first_pair)
    pairs = pairs.coalesce(max(8, pairs.count() // 500_000))
    gains, below = train_pairs(pairs, lexicon, totals, class_tokens + class_words + 1.0)
    top, rest, _ = most_frequent(gains, "n", FREQUENT_PAIRS)
    top = top.select("k", F.col("gain").cast("float").alias("gain")).toPandas().sort_values("k")
    model = Model(lexicon, weights, below, top["k"].to_numpy(np.int64), top["gain"].to_numpy(np.float32), bitmap(rest), total, distinct, class_tokens, class_words)
    give_back()
    return model, words.select("w", "c"), rest.select("k", "gain")


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))


SCORED = "n_tokens long, known long, logs double, parts double, rare array<long>, rare_pairs array<long>"


def score_batches(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text: tokens; known ones and log10(count + 1) of frequent words; log10 of the rest; the other words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, sizes = model.lexicon, model.lexicon.sizes
        log_below = np.log10(model.below)
        log_counts = np.log10(lex.counts + 1.0)
        for batch in batches:
            sizes_of, known, logs, parts, rare, rare_pairs = [], [], [], [], [], []
            for words, endings, first in stream(_texts(batch)):
                classes, buckets, heads, rank = lex.numbers(words, endings)
                one, two = before(buckets, first)
                head = before(heads, first)[0]
                context, at = np.unique(one * sizes.buckets + two, return_inverse=True)
                part = log_softmax(model.weights, context, sizes)[at, classes] / np.log(10) - log_below[head, classes]
                place, frequent = _found(lex.hashes, words)
                value = np.zeros(len(words))
                value[frequent] = log_counts[place[frequent]]
                ranked = np.flatnonzero((classes > sizes.own_classes) & (rank >= 0))
                keys = rank[ranked] * sizes.heads + head[ranked]
                place, sent = _found(model.pair_keys, keys)
                part[ranked[sent]] += model.pair_gains[place[sent]]
                slot = slots(keys)
                joined = ~sent & (model.others[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                starts, cuts = first[:-1], first[1:-1]
                sizes_of.append(np.diff(first))
                known.append(np.add.reduceat(frequent.astype(np.int64), starts))
                logs.append(np.add.reduceat(value, starts))
                parts.append(np.add.reduceat(part, starts))
                other = np.flatnonzero(~frequent)
                rare += np.split(words[other].view(np.int64), np.searchsorted(other, cuts))
                rare_pairs += np.split(keys[joined], np.searchsorted(ranked[joined], cuts))
            columns = [pa.array(np.concatenate(x) if x else np.zeros(0), kind) for x, kind in ((sizes_of, pa.int64()), (known, pa.int64()), (logs, pa.float64()), (parts, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns, _lists(rare), _lists(rare_pairs)], ["doc_id", "held_out", "n_tokens", "known", "logs", "parts", "rare", "rare_pairs"])

    return run


def score(docs: DataFrame, train_on: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from train_on, by default the documents outside the held-out
    fold. A null or empty text is its end alone. With nothing to learn from, all
    counts are 0 and classes are equally likely. Rows that repeat each give a row;
    other columns are ignored.
    """
    marked = docs.select("doc_id", "text", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    model, words, pairs = fit(marked.filter(~F.col("held_out")) if train_on is None else train_on)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = arrow_rows(marked).mapInArrow(score_batches(model), f"doc_id {kind}, held_out boolean, {SCORED}")
    out = stored(out.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare_words = out.select("row", F.explode("rare").alias("w")).join(words, "w").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"))
    rare_pairs = out.select("row", F.explode("rare_pairs").alias("k")).join(pairs, "k").groupBy("row").agg(F.sum("gain").alias("gain"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return out.drop("rare", "rare_pairs").join(rare_words, "row", "left").join(rare_pairs, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.words + 1)))).alias("base_score"),
        (logs + F.col("parts") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
