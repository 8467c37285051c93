"""Manifest, languages and token spans against brute force, numeric gradients and held-out accuracy; edge cases."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sessile.llm import merkle, recurrent, spans

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, at int, tree string, g string, size int, pairs string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, "z", "w") for r in rows], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def fold_tree(hashes, fan=2):
    """Root, and for each leaf its steps (hashes before, hashes after)."""
    steps, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i in range(len(hashes)):
            run = at[i] // fan * fan
            steps[i].append(("".join(level[run : at[i]]), "".join(level[at[i] + 1 : run + fan])))
            at[i] //= fan
        level = [sha("".join(level[k : k + fan])) for k in range(0, len(level), fan)]
    return level[0], steps


def brute_manifest(rows, fan=2):
    def leaf(doc_id, text, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))

    groups = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n = r
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        groups[lang].append((doc_id, leaf(*r), leaf(doc_id, text, lang, source, None if n is None else n + 1) if hit else leaf(*r)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [fold_tree([x[1] for x in groups[g]], fan) for g in langs]
    root, above = fold_tree([t[0] for t in trees], fan)
    out = []
    for k, g in enumerate(langs):
        for (doc_id, h, told), steps in zip(groups[g], trees[k][1], strict=True):
            path, folded = steps + above[k], told
            for before, after in path:
                folded = sha(before + folded + after)
            out.append((str(doc_id), h, trees[k][0], root, sha("".join(b + a for b, a in path)), folded, folded == root))
    return sorted(out)


ROWS = [(None, None, None, None, None), (None, "a", None, "s", 1), (3, "é\n", "fr", None, 2), (3, "é\n", "fr", None, 2), (14, "x" * 300_000, "fr", "t", 300_000), (5, "", "", "s", 0), (-7, "b", "en", "s", None)]
ROWS += [(k * 11 % 97, f"text {k}", ("en", "de", None)[k % 3 % (1 + k % 3)], "s", k) for k in range(61)]


@pytest.mark.parametrize(("fan", "digits"), [(2, 8), (2, 1), (2, 3), (3, 2)])
def test_manifest_equals_brute_force(spark, monkeypatch, fan, digits):
    monkeypatch.setattr(merkle, "FAN", fan)
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rows = ROWS if digits > 1 else ROWS[:20]
    got = []
    for r in merkle.manifest(frame(spark, rows)).collect():
        got.append((str(r.doc_id), r.leaf, r.subroot, r.root, sha("".join(s.before + s.after for s in r.path)), r.folded_root, r.verified))
    assert sorted(got) == brute_manifest(rows, fan)
    assert any(not x[-1] for x in got)


def test_manifest_of_one_row_and_of_none(spark):
    (one,) = merkle.manifest(frame(spark, [(None, "t", "en", "s", 1)])).collect()
    assert one.leaf == one.subroot == one.root and one.path == [] and one.verified
    assert merkle.manifest(frame(spark, [])).collect() == []


def test_manifest_forms_no_pair_of_rows_by_joining(spark):
    rows = merkle.numbered(merkle.leaves(frame(spark, ROWS)), ["doc_id", "leaf"])
    trees = merkle.rounds(rows.select("g", "at", "size", merkle.F.struct(merkle.F.col("leaf").alias("hash"), "doc_id", "tampered").alias("node")), merkle.largest(rows))
    top = trees[-1].select("g", "at", merkle.F.array().cast(f"array<{merkle._STEP}>").alias("path"), merkle.F.struct(merkle.F.lit("r").alias("root")).alias("roots"))
    assert "Join" not in merkle.spread(trees, top)._jdf.queryExecution().executedPlan().toString()


def test_gradient_by_differences():
    net, rng = recurrent.Network.start(["a", "b", "c"]), np.random.default_rng(0)
    for a in net.arrays():
        a += rng.normal(0, 0.3, a.shape)
    x, y = rng.integers(0, 257, (9, 5)), rng.integers(0, 3, 5)
    _, slopes = net.loss(x, y)
    for a, s in zip(net.arrays(), slopes, strict=True):
        for _ in range(12):
            i = tuple(int(rng.integers(0, n)) for n in a.shape)
            i = (int(x[rng.integers(0, 9), rng.integers(0, 5)]), i[1]) if len(a) == 257 else i
            was, sides = a[i], []
            for step in (1e-6, -1e-6):
                a[i] = was + step
                sides.append(net.loss(x, y)[0])
            a[i] = was
            assert abs((sides[0] - sides[1]) / 2e-6 - s[i]) < 1e-7


def test_pooling_equals_a_plain_recurrence():
    """Each text alone, byte by byte in plain loops, against many windows at a time; the last window is short."""
    net, rng = recurrent.Network.start(["a", "b", "c"]), np.random.default_rng(3)
    for a in net.arrays():
        a += rng.normal(0, 0.3, a.shape)

    def logistic(v):
        return 1 / (1 + np.exp(-v))

    def states(layer, codes):
        h, out, n = np.zeros(recurrent.STATES), [], recurrent.STATES
        for c in codes:
            a, u = layer.of_byte[c] + layer.base, layer.of_state @ h
            z, r = logistic(a[:n] + u[:n]), logistic(a[n : 2 * n] + u[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * u[2 * n :])
            out.append(h)
        return out

    texts = [b"", b"x", bytes(rng.integers(0, 256, 64).astype(np.uint8)), bytes(rng.integers(0, 256, 301).astype(np.uint8))]
    got, labelled = net.pooled(texts)
    for text, p, n in zip(texts, got, labelled, strict=True):
        want, count = np.zeros(3), np.zeros(3, int)
        for k in range(0, len(text), recurrent.WINDOW):
            codes = list(text[k : k + recurrent.WINDOW])
            codes += [recurrent.PAD] * (recurrent.WINDOW - len(codes))
            sides = [states(net.layers[0], codes), states(net.layers[1], codes[::-1])[::-1]]
            for t in range(min(recurrent.WINDOW, len(text) - k)):
                v = np.exp(net.outs[0] @ sides[0][t] + net.outs[1] @ sides[1][t] + net.base)
                want += v / v.sum()
                count[np.argmax(v)] += 1
        assert np.allclose(p, want / max(1, len(text)), atol=1e-6) and list(n) == list(count)


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = recurrent.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and abs(sum(r.pooled.values()) - 1) < 1e-3 for r in rows)


def test_languages_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "STEPS", 30)
    rows = [(k, ("the cat and the dog " if k % 2 else "el perro y la niña ") * (1 + k % 5), ("en", "es")[k % 2 == 0], "s", 1) for k in range(60)]
    odd = [(None, "the dog", "en", "s", 1), (70, None, "en", "s", 1), (71, "", None, None, None), (72, "12 34 .", "es", "s", 1), (73, "the " * 50_000, None, "s", 1), (1, "the cat", "en", "s", 1), (1, "the cat", "en", "s", 1)]
    got = recurrent.languages(frame(spark, rows + odd)).collect()
    assert len(got) == len(rows + odd)
    by = {r.doc_id: r for r in got}
    assert {by[k].lang_pred for k in (70, 71, 72)} == {"und"} and by[71].score == 0
    assert by[73].lang_pred in ("en", "es") and sum(by[73].labelled.values()) == 200_000
    assert recurrent.languages(frame(spark, [])).collect() == []
    alone = recurrent.languages(frame(spark, [(k, "abc", "xx", "s", 1) for k in range(9)])).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("xx", 1.0)}
    assert {r.lang_pred for r in recurrent.languages(frame(spark, [(k, "abc", None, "s", 1) for k in range(9)])).collect()} == {"und"}


def test_windows_span_the_whole_text():
    text = bytes(range(256)) * 40
    cut = recurrent.windows_of(text)
    assert len(cut) == recurrent.WINDOWS and cut[0] == text[:64] and cut[-1] == text[-64:]
    assert recurrent.windows_of(b"") == [] and recurrent.windows_of(b"ab") == [b"ab"]


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
POOL = [" ", "  ", "\n", "\n\n", "\t", " \n ", "\r", "\r\n", "a", "the", "Ünter", "é", "é", "日本", "語", "😀", "👩‍👩‍👧", "'s", "'", "don't", "'ll", "123", "²", ".", ",", ");", "\xa0", " ", "　", "\x1c", "▁",
        "<|endoftext|>", "</s>", "<0x41>", "<unk>", "\x00", "__", "{\r", "ß", "ﬁ", "가", "हिन्दी", "—", "“x”", "Th", "tion", "\x85", "ABC", "𝔘", "٣", "ʰ", "﻿", "�"]


@pytest.fixture(scope="module")
def aligner():
    return spans.Aligner(*spans.tokenizer_files())


def brute_spans(aligner, text):
    """n_a, n_b, n_groups, groups and a count of links, by the libraries' encoding of the whole text and decoded bytes."""
    whole = (" " + text).encode()
    ids = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.whole.encode(text)
    cut = [[table[i] for i in x] for table, x in zip((aligner.a_bytes, aligner.b_bytes), ids, strict=True)]
    if not text or any(b"".join(x) != whole for x in cut):
        return 0, 0, 0, "", Counter()
    ends = [np.cumsum([len(t) for t in x]).tolist() for x in cut]
    links, groups, at = Counter(), [], (0, 0)
    for i, e in enumerate(ends[0]):
        for j, f in enumerate(ends[1]):
            if f - len(cut[1][j]) < e and e - len(cut[0][i]) < f:
                links[ids[0][i] << 32 | ids[1][j]] += 1
    for e in sorted(set(ends[0]) & set(ends[1])):
        to = ends[0].index(e) + 1, ends[1].index(e) + 1
        groups.append("|".join(",".join(map(str, ids[k][at[k] : to[k]])) for k in (0, 1)))
        at = to
    return len(ids[0]), len(ids[1]), len(groups), ";".join(groups), links


def test_spans_equal_brute_force(aligner):
    rng = random.Random(4)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    for text, got in zip(texts, aligner.align(texts), strict=True):
        assert (*got[:4], Counter(got[4].tolist())) == brute_spans(aligner, text), repr(text)


def test_alignment_counts_over_the_corpus(spark, aligner, monkeypatch):
    monkeypatch.setattr(spans, "FREQUENT_SHARE", 1 / 50)  # so that both joins have rows
    rng = random.Random(9)
    texts = [None, "", "a▁b", "the " * 60_000, "the cat", "the cat", *["".join(rng.choice(POOL) for _ in range(8)) for _ in range(40)]]
    rows = [(None if k == 7 else k // 2, t, "en", "s", 1) for k, t in enumerate(texts)]
    known = {t: brute_spans(aligner, t or "") for t in texts if t is None or len(t) < 1000}
    long = aligner.align([texts[3]])[0]
    known[texts[3]] = (*long[:4], Counter(long[4].tolist()))
    total = Counter()
    for t in texts:
        total.update(known[t][4])
    most = Counter()
    for pair, n in total.items():
        most[pair & 0xFFFFFFFF] = max(most[pair & 0xFFFFFFFF], n)
    want = []
    for doc_id, t, *_ in rows:
        n_a, n_b, n_groups, groups, links = known[t]
        best = sum(n for p, n in links.items() if total[p] == most[p & 0xFFFFFFFF])
        want.append((str(doc_id), n_a, n_b, n_groups, sum(links.values()), best, sum(n * total[p] for p, n in links.items()), sha(groups) if groups else ""))
    got = [(str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in spans.align(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want)
    assert spans.align(frame(spark, [])).collect() == []
