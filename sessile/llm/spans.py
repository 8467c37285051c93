"""Which tokens of two tokenizers cover the same bytes of a text.

A is a byte-level merge vocabulary, B a merge-type vocabulary of pieces with byte
fallback. Both libraries give the characters that each token covers: these are the
coarse cuts. Where tokens share a character (a character of several bytes that is cut
inside), the bytes that the tokens decode to place the cuts between two coarse ones.
The merged cuts of A and B are the links; cuts that both have are the groups.

Texts are cut first into units (words, marks, line ends) at places where neither
tokenizer can have a token across; units repeat, so each worker keeps what it has found
for them. New units go through the libraries in one call for many, and one whole text of
each Arrow batch is compared with the libraries' encoding of it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from sessile.llm.common import arrow_rows, stored, table
from sessile.llm.pieces import MARK, PARTS

#: Units that a worker remembers in each of two generations, and new ones that are encoded in one text.
REMEMBERED, TOGETHER = 150_000, 2_000
#: White space that no piece of several characters holds.
_ALONE = r"\t\n\x0b\x0c"
#: Letters with one space before; other marks up to a letter or a space; line ends up to a word (A has the last one apart if no space follows).
_SIMPLE = rf" ?\p{{L}}++(?!\p{{M}})|[^\p{{L}}\p{{M}}\s'{MARK}]++(?=[\p{{L}} {_ALONE}]|\Z)|[{_ALONE}](?=\p{{L}})|[{_ALONE}]+(?=[{_ALONE}]\p{{L}})|[{_ALONE}]++(?= \p{{L}})"
#: The rest: up to white space before which both tokenizers cut.
UNITS = regex.compile(rf"{_SIMPLE}|\s*\S+(?:[^\S {_ALONE}]\s*\S*)*|\s+")
#: Units that mean the same between two line ends.
PLAIN = regex.compile(rf" ?\p{{L}}+|[^\p{{L}}\p{{M}}\s'{MARK}]+")

#: Texts that are aligned at once.
ROWS = 200
#: Pairs with more than this share of all links are sent to all tasks: fewer than 100,000 rows.
FREQUENT_SHARE = 1 / 100_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            out[chr(256 + len(out) - len(shown))] = b
    return out


class Aligner:
    """Two tokenizers, and what is known of units: (tokens of A, of B, groups, groups as text, links as pair codes)."""

    def __init__(self, a_json: str, b_proto: bytes) -> None:
        cut = json.loads(a_json)["pre_tokenizer"]
        if cut != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": cut.get("trim_offsets"), "use_regex": True}:
            raise ValueError("only byte-level vocabularies with the usual pattern are supported")
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        special = set(self.a.get_added_tokens_decoder())
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [b"" if i in special else bytes(letters[c] for c in name) for i, name in enumerate(names)]
        proto = sentencepiece_model_pb2.ModelProto.FromString(b_proto)
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only vocabularies over unchanged text are supported")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=b_proto)
        proto.normalizer_spec.add_dummy_prefix = False
        self.b = sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.b_bytes = []
        alone = regex.compile(f"[{_ALONE}]")
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
                continue
            self.b_bytes.append(piece.replace(MARK, " ").encode())
            if not (sp.is_control(i) or sp.is_unknown(i)) and (len(PARTS.findall(piece)) != 1 or len(piece) > 1 and alone.search(piece)):
                raise ValueError(f"piece {piece!r} spans a cut")
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        self.recent: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    @staticmethod
    def cuts(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Byte offsets where tokens end, from the bytes of the characters they cover and the bytes they decode to.

        A token that covers characters of which the next one covers none ends where
        they do: a coarse cut. Others end so many decoded bytes after the last coarse cut.
        """
        if not len(spans):
            return np.zeros(0, np.int64)
        coarse = np.append(spans[1:, 0] >= spans[:-1, 1], True) & (spans[:, 1] > spans[:, 0])
        out, decoded = spans[:, 1].copy(), np.cumsum(sizes)
        fine, anchors = np.flatnonzero(~coarse), np.flatnonzero(coarse)
        before = np.searchsorted(anchors, fine) - 1
        last = anchors[np.maximum(before, 0)] if len(anchors) else before
        out[fine] = decoded[fine] + np.where(before >= 0, out[last] - decoded[last], 0)
        return out

    def learn(self, units: list[str]) -> None:
        plain = [u for u in units if PLAIN.fullmatch(u)]
        odd = [u for u in units if not PLAIN.fullmatch(u)]
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)] + [[u] for u in odd]
        texts = ["\n".join(g) for g in groups]
        for group, text, a, b in zip(groups, texts, self.a.encode_batch(texts, add_special_tokens=False), self.b.encode(texts, num_threads=1, return_type="proto"), strict=True):
            whole, ids_a = text.encode(), a.ids
            span_a = np.array(a.offsets, np.int64).reshape(-1, 2)
            if len(whole) > len(text):  # A's spans are of characters, B's of their bytes
                code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                span_a = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])[span_a]
            raw = np.array([(p.id, p.begin, p.end) for p in b.pieces], np.int64).reshape(-1, 3)
            ids_b, span_b = raw[:, 0].tolist(), raw[:, 1:]
            if b"".join([self.a_bytes[i] for i in ids_a]) != whole or b"".join([self.b_bytes[i] for i in ids_b]) != whole:
                if len(group) > 1:
                    raise ValueError(f"tokens of units do not decode to them: {text[:200]!r}")
                self.recent[group[0]] = None
                continue
            self._keep(group, ids_a, self.cuts(span_a, self.a_sizes[ids_a]), ids_b, self.cuts(span_b, self.b_sizes[ids_b]))

    def _keep(self, group: list[str], ids_a: list[int], ends_a: np.ndarray, ids_b: list[int], ends_b: np.ndarray) -> None:
        sizes = np.array([len(u.encode()) for u in group])
        stop = np.cumsum(sizes + 1) - 1
        every = np.union1d(ends_a, ends_b)
        code = np.array(ids_a, np.int64)[np.searchsorted(ends_a, every)] << 32 | np.array(ids_b, np.int64)[np.searchsorted(ends_b, every)]
        both = np.intersect1d(ends_a, ends_b)
        at_a, at_b = (np.searchsorted(e, both) + 1 for e in (ends_a, ends_b))
        if len(np.intersect1d(stop, both)) != len(stop):
            raise ValueError(f"a token spans the end of a unit near {group[0]!r}")
        bounds = [(np.searchsorted(e, stop - sizes, "right").tolist(), (np.searchsorted(e, stop) + 1).tolist()) for e in (ends_a, ends_b, both, every)]
        at_a, at_b = [0, *at_a.tolist()], [0, *at_b.tolist()]
        text_a, text_b = list(map(str, ids_a)), list(map(str, ids_b))
        for k, unit in enumerate(group):
            (a0, a1), (b0, b1), (g0, g1), (l0, l1) = [(lo[k], hi[k]) for lo, hi in bounds]
            text = ";".join([f"{','.join(text_a[at_a[g] : at_a[g + 1]])}|{','.join(text_b[at_b[g] : at_b[g + 1]])}" for g in range(g0, g1)])
            self.recent[unit] = (a1 - a0, b1 - b0, g1 - g0, text, code[l0:l1].tobytes())

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """For each text: tokens of A, of B, groups, groups as text, and the pair code of each link."""
        recent, older = self.recent, self.older
        cut, new = [], {}
        for text in texts:
            units = UNITS.findall(" " + text) if text else []
            cut.append(units)
            for u in units:
                if u not in recent:
                    if u in older:
                        recent[u] = older[u]
                    else:
                        new[u] = None
        if new:
            self.learn(list(new))
        out = []
        for units in cut:
            found = [recent[u] for u in units]
            if not found or None in found:
                out.append((0, 0, 0, "", np.zeros(0, np.int64)))
                continue
            n_a, n_b, n_groups, groups, links = zip(*found, strict=True)
            out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), np.frombuffer(b"".join(links), np.int64)))
        if len(recent) > REMEMBERED:
            self.older, self.recent = recent, {}
        return out

    def compare(self, text: str, found: tuple[int, int, int, str, np.ndarray]) -> None:
        """Stop if the libraries encode a whole text otherwise than its units."""
        if not found[2]:
            return
        sides = [x.split("|") for x in found[3].split(";")]
        own = [[int(i) for side in sides for i in side[k].split(",")] for k in (0, 1)]
        if own[0] != self.a.encode(" " + text, add_special_tokens=False).ids or own[1] != self.whole.encode(text):
            raise ValueError(f"the libraries encode a whole text otherwise: {text[:200]!r}")


#: One for each worker process, kept between its tasks.
_ALIGNERS: dict[bytes, Aligner] = {}


def aligner(a_json: str, b_proto: bytes) -> Aligner:
    key = hashlib.sha256(a_json.encode() + b_proto).digest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a_json, b_proto)
    return _ALIGNERS[key]


def align_batches(models: Callable[[], tuple[str, bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*models())
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            found = own.align(texts)
            if texts:
                own.compare(texts[0], found[0])
            pairs = [np.unique(x[4], return_counts=True) for x in found]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p, _ in pairs])]).astype(np.int32)
            flat = [np.concatenate([x[k] for x in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *[pa.array([x[k] for x in found], pa.int64()) for k in range(3)], pa.array([len(x[4]) for x in found], pa.int64()), pa.array([x[3] for x in found], pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(flat[0], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(flat[1].astype(np.int32), pa.int32())),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
            )

    return run


def tokenizer_files(a_path: str | None = None, b_path: str | None = None) -> tuple[str, bytes]:
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


def spans(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), pairs and times (links by pair).

    A pair is coded as A's id times 2**32 plus B's. Texts are aligned whole, with one
    space before. Null and empty texts, and texts whose tokens do not decode to them
    (those that hold U+2581), have no tokens. Rows that repeat each give a row; other
    columns are ignored; an empty table gives no rows. The files are read by the driver
    and travel with the job.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_files(a_path, b_path))  # two files, 5 MB, whatever the table
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_rows(docs.select("doc_id", "text"), ROWS).mapInArrow(
        align_batches(lambda: sent.value), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<int>"
    )


def linked(aligned: DataFrame) -> DataFrame:
    """Per row of spans, with row a number of its own: n_best and count_sum by the corpus-wide counts of its pairs.

    A pair with a large share of all links, of which there are few, meets its rows as a
    broadcast table. No other pair has more than FREQUENT_SHARE of all links, so the
    join that the rest takes has no hot key.
    """
    each = aligned.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "n"))
    counts = stored(each.groupBy("pair").agg(F.sum("n").alias("links")), "span-counts")
    b = F.col("pair").bitwiseAND(2**32 - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))  # a row for each id of B: its vocabulary bounds them
    known = stored(counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "links", (F.col("links") == F.col("most")).cast("int").alias("best")), "span-known")
    total = known.agg(F.sum("links")).first()[0] or 0
    often, rest = known.filter(F.col("links") > max(1, total * FREQUENT_SHARE)), known.filter(F.col("links") <= max(1, total * FREQUENT_SHARE))
    parts = [each.join(F.broadcast(often), "pair"), each.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(rest.hint("merge"), "pair")]
    sums = [p.groupBy("row").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum")) for p in parts]
    return sums[0].unionByName(sums[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """spans with n_best and count_sum, and groups as groups_sha256 (empty without tokens)."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = stored(spans(docs, a_path, b_path).withColumn("groups_sha256", digest).drop("groups").withColumn("row", F.monotonically_increasing_id()), "spans")
    sums = linked(aligned)
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
