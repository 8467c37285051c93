"""SentencePiece encoding and decoding for merge-type vocabularies.

Merging follows a score-ordered agenda of adjacent symbol pairs: all pairs whose
joined text is in the vocabulary wait in a heap, best score first and leftmost
among equals; a merge adds the pairs that it makes with its neighbours.

Pieces of such a vocabulary do not mix letters with other characters, and have the
space mark only in front (both are verified for each piece when a model is loaded).
So a text may be cut where letters begin or end and before each run of space marks,
and the parts merge independently. Parts repeat, so each worker keeps their ids. What
these decode to is compared with the part, and kept only where it is another text.
Every part that a worker has no result for is also encoded by the sentencepiece
library, in one call for an Arrow batch, as is one whole text of each batch; a
difference stops the job.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from sessile.llm.common import arrow_rows, table

MARK = "▁"
#: Parts that a worker remembers in each of two generations, texts that it takes at once, and parts that it learns at once.
REMEMBERED, TEXTS, LEARNED = 200_000, 250, 10_000
#: Letters, or other characters, after space marks if any; or space marks alone.
PARTS = regex.compile(r"▁*[\p{L}\p{M}]+|▁*[^\p{L}\p{M}▁]+|▁+")
#: The same with spaces for marks: parts are remembered so, as a mark takes a string to two bytes a character.
SPACED = regex.compile(PARTS.pattern.replace(MARK, " "))


class MergeModel:
    """A merge-type vocabulary with byte fallback, read from a serialised model."""

    def __init__(self, proto: bytes) -> None:
        bare = sentencepiece_model_pb2.ModelProto.FromString(proto)
        if bare.normalizer_spec.name != "identity" or bare.normalizer_spec.remove_extra_whitespaces or not bare.normalizer_spec.add_dummy_prefix:
            raise ValueError("only vocabularies over unchanged text are supported")
        bare.normalizer_spec.add_dummy_prefix = False
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())  # for parts within a text
        n = sp.get_piece_size()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = [b""] * n
        self.byte_ids: dict[int, int] = {}
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            if self.is_byte[i]:
                self.byte_ids[int(piece[3:5], 16)] = i
            elif sp.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                self.surface[i] = piece.replace(MARK, " ").encode()
                if not PARTS.fullmatch(piece) or len(PARTS.findall(piece)) != 1:
                    raise ValueError(f"piece {piece!r} spans a cut")
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.eos = sp.eos_id()
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}  # parts that decode to another text than their own, with it

    def merge(self, part: str) -> list[str]:
        """The symbols that are left when no adjacent pair is in the vocabulary."""
        symbols, scores, n = list(part), self.scores, len(part)
        agenda = []
        for i in range(n - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None:
                agenda.append((-score, i, i + 1, 2))
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            _, left, right, length = pop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != length:
                continue  # one of the two has merged since
            symbols[left] = a = a + b
            symbols[right] = ""
            after[left] = follow = after[right]
            if follow < n:
                before[follow] = left
                score = scores.get(a + symbols[follow])
                if score is not None:
                    push(agenda, (-score, left, follow, len(a) + len(symbols[follow])))
            lead = before[left]
            if lead >= 0:
                score = scores.get(symbols[lead] + a)
                if score is not None:
                    push(agenda, (-score, lead, left, len(symbols[lead]) + len(a)))
        return [s for s in symbols if s]

    def part_ids(self, part: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(part):
            i = self.ids.get(s)
            out.extend([i] if i is not None else [self.byte_ids[b] for b in s.encode()])
        return out

    def decode_ids(self, ids: list[int]) -> bytes:
        """Surface text of ids; broken byte sequences become U+FFFD, one for each byte as the library has it."""
        out: list[bytes] = []
        run = bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run.append(int(self.library.id_to_piece(i)[3:5], 16))
                continue
            if run:
                out.append(self._text_of(bytes(run)))
                run.clear()
            if i >= 0:
                out.append(self.surface[i])
        return b"".join(out)

    @staticmethod
    def _text_of(run: bytes) -> bytes:
        try:
            run.decode()
            return run
        except UnicodeDecodeError:
            return run.decode("utf-8", "replace").encode()

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """For each text its ids as little-endian 32-bit integers, an end id last, and the text they decode to."""
        recent, older, split = self.recent, self.older, SPACED.findall
        cut, new = [], {}
        for text in texts:
            parts = split(" " + text.replace(MARK, " ")) if text else []
            cut.append(parts)
            for p in parts:
                if p not in recent:
                    if p in older:
                        recent[p] = older[p]
                    else:
                        new[p] = None
        parts = list(new)
        for at in range(0, len(parts), LEARNED):
            self.learn(parts[at : at + LEARNED])
        end, other = self.eos.to_bytes(4, "little"), self.other
        ids, back = [], []
        for parts in cut:
            ids.append(b"".join([recent[p] for p in parts]) + end)
            decoded = b"".join([other[p] if p in other else p.encode() for p in parts]) if other else "".join(parts).encode()
            back.append(decoded[1:])  # without the space put before the text
        if len(recent) > REMEMBERED:
            self.older, self.recent = recent, {}
            self.other = {p: x for p, x in other.items() if p in recent}
        return ids, back

    def learn(self, parts: list[str]) -> None:
        """Merge parts, compare them with the library's encoding, and remember them."""
        surface, byte_ids = self.surface, set(self.byte_ids.values())
        marked = [p.replace(" ", MARK) for p in parts]
        theirs = self.bare.encode(marked, num_threads=1)
        for part, with_marks, other in zip(parts, marked, theirs, strict=True):
            own = self.part_ids(with_marks)
            if own != other:
                raise ValueError(f"{part!r} encodes as {own}, the library has {other}")
            back = b"".join([surface[i] for i in own]) if byte_ids.isdisjoint(own) else self.decode_ids(own)
            if back != part.encode():
                self.other[part] = back
            self.recent[part] = struct.pack(f"<{len(own)}i", *own)


def encode_batches(proto: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = MergeModel(proto)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids, back = model.encode(texts)
            if texts and (theirs := model.library.encode(texts[0], add_eos=True)) != np.frombuffer(ids[0], "<i4").tolist() or texts and model.library.decode(theirs).encode() != back[0]:
                raise ValueError(f"the library encodes a whole text otherwise: {texts[0][:200]!r}")
            flat = np.frombuffer(b"".join(ids), "<i4")
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), pa.array(back, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per document: doc_id, ids (an end id last), decoded (the text of these ids).

    A null text counts as empty: it has the end id alone and decodes to empty text.
    Texts are encoded whole, whatever their length. Other columns are ignored; an
    empty table gives no rows. The model file is read by the driver and travels
    with the job.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    with open(model_path, "rb") as f:
        proto = f.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_rows(docs.select("doc_id", "text"), TEXTS).mapInArrow(encode_batches(proto), f"doc_id {kind}, ids array<int>, decoded string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(encode(table(spark, sf_dir, "documents")))


def digested(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
