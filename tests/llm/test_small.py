"""Pure parts of the operators: containers, trees of pages, tokens, pieces, pseudonyms, indexes."""

import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from sessile.llm import density, jaccard, maxent, ogg, pieces, pseudonyms, quality, tokens, toxicity


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_checksum():
    assert ogg.checksum(b"OggS hello") == slow_crc(b"OggS hello")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 255, 4096, 4097, 25500, 25536, 200_000])
def test_ogg_round_trip(n):
    payload = ogg.padded("x" * n)
    found = ogg.read(ogg.write(payload))
    assert ogg.payload_of(found) == payload and len(payload) % 64 == 0 and payload
    assert (found.bad_pages, found.lost_packets) == (0, 0)
    assert sum(s.granule for s in found.streams) == len(payload)
    assert all(s.seconds == sorted(s.seconds) and len(s.seconds) == len(s.packets) for s in found.streams)


def test_ogg_finds_damage_and_reads_the_rest():
    media = bytearray(ogg.write(os.urandom(64_000)))
    media[len(media) // 2] ^= 1
    found = ogg.read(bytes(media))
    assert found.bad_pages == 1 and found.pages > 1
    assert ogg.read(b"").streams == [] and ogg.read(b"OggS").streams == []


PAGE = """<html><body><header><a href=/>Site</a></header><div id="sidebar"><ul><li><a>x y z</a></li></ul></div><div><div class="post"><h1>Title here</h1>
<p>One two three four five &amp; six.</p><section><p>Another par <a href=x>link</a> text goes on &nbsp; and on.</p><ul><li>item one<li>item two</ul></section></div></div>
<form><p>Subscribe now to this great thing please do it</p></form><div class="comments"><p>First! great post thanks for sharing it all</p></div><footer>c 2020</footer></body></html>"""


def test_density_main_text():
    assert density.main_text(PAGE) == "Title here\n\nOne two three four five & six.\n\nAnother par link text goes on and on.\n\nitem one\n\nitem two"


@pytest.mark.parametrize(("given", "want"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>a", "a"), ("<p>x<b>y</p>z", "xy\n\nz"), ("<body></body>", ""), ("&lt;<br>&amp;", "< &"), ("<script>var a='<p>no</p>'</script>yes", "yes"), ("<style>p{}", "")])
def test_density_edges(given, want):
    assert density.main_text(given) == want


def test_density_survives_broken_markup():
    random.seed(3)
    for _ in range(300):
        density.main_text("".join(random.choice(["<p>", "</p>", "<div", ">", '"', "'", "<a href=", "</", "<!--", "-->", "<li>", "text ", "&amp;", "<table>", "</td>", "<script>"]) for _ in range(40)))
    assert density.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def words_of(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


TEXTS = ["", " ", "a", "A a", "a b c d e", "a b c d e f a b c d e f", "é É x", "one\x0btwo\x0cthree four five six", "w " * 500, "".join(random.Random(1).choices("ab \n", k=5000))]


def test_words_and_shingles():
    h, n = tokens.word_hashes([t.encode() for t in TEXTS])
    assert n.tolist() == [len(words_of(t)) for t in TEXTS]
    flat = [w for t in TEXTS for w in words_of(t)]
    assert len(set(h.tolist())) == len(set(flat))
    assert len({(a, b) for a, b in zip(flat, h.tolist(), strict=True)}) == len(set(flat))
    assert [len(s) for s in tokens.shingle_sets([t.encode() for t in TEXTS])] == [len(shingles_of(t)) for t in TEXTS]


def test_word_hashes_do_not_depend_on_chunks():
    alone = [tokens.word_hashes([t.encode()])[0].tolist() for t in TEXTS]
    assert sum(alone, []) == tokens.word_hashes([t.encode() for t in TEXTS])[0].tolist()


def test_first_elements_are_enough():
    for n in range(1, 300):
        k = jaccard.first_length(n)
        assert n - k < 0.75 * n <= n - k + 1


def test_count_forest_equals_all_pairs():
    rng = np.random.default_rng(0)
    p = rng.poisson(3, (200, 32))
    p = np.vstack([p, np.maximum(p[:100] + rng.integers(-1, 2, (100, 32)) * (rng.random((100, 32)) < 0.1), 0)])
    c = np.arange(len(p))
    c[:40] = 7
    tree = rng.integers(0, 3, len(p)) * 5
    may = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if c[i] != c[j] and np.minimum(p[i], p[j]).sum() >= jaccard.least_shared(p[i].sum(), p[j].sum())}
    forest = jaccard.CountForest(tree, c, p)
    pairs = lambda first, second: {(min(a, b), max(a, b)) for x, y, _ in forest.pairs(np.array(first), np.array(second)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert pairs([0, 5, 10], [0, 5, 10]) == {(i, j) for i, j in may if tree[i] == tree[j]} != set()
    assert pairs([0, 3], [10, 5]) == {(i, j) for i, j in may if {tree[i], tree[j]} == {0, 10}} != set()


def test_blocks_give_fewer_links_than_members():
    """A group of near copies: all pairs are candidates, links only connect them; a repeated row adds nothing."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[20:], rng.integers(0, 2**63, 10).astype(np.uint64)])) for _ in range(60)]
    sets += [sets[3]] * 1000
    node = [*range(60), *[3] * 1000]
    order = np.argsort(node, kind="stable")
    columns = {"lead": [0] * len(sets), "i": [0] * len(sets), "j": [0] * len(sets), "side": [0] * len(sets), "node": [node[k] for k in order], "component": [node[k] for k in order]}
    batch = pa.RecordBatch.from_arrays([*[pa.array(v, pa.int64()) for v in columns.values()], pa.array([sets[k].view(np.int64) for k in order], pa.list_(pa.int64()))], [*columns, "items"])
    links = [p for out in jaccard.link_batches(iter([batch.slice(0, 700), batch.slice(700)])) for p in zip(*(out.column(c).to_pylist() for c in "ab"), strict=True)]
    assert len(links) == 59 and {x for p in links for x in p} == set(range(60))


@pytest.fixture(scope="module")
def model():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("piece_bpe_32k.model"), "rb") as f:
        return pieces.MergeModel(f.read())


def test_pieces_equal_the_library(model):
    rng = random.Random(2)
    texts = ["", " a", "  a  b ", "▁x", "a\0b", "<s>hi</s>", "日本", "a\tb\nc", "\xa0x", "   ", "x_y __a 1a a1", "don't ### x##y 😀", "</s>", "<0x41>", "a" * 300]
    texts += ["".join(rng.choice("ab é_1.▁ \n#$日😀́²") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    ids, back = model.encode(texts)
    theirs = model.library.encode(texts, add_eos=True)
    assert [np.frombuffer(i, "<i4").tolist() for i in ids] == theirs
    assert [b.decode() for b in back] == model.library.decode(theirs)


def test_pieces_notice_a_difference(model, monkeypatch):
    monkeypatch.setattr(model, "part_ids", lambda part: [5])
    model.recent, model.older = {}, {}
    with pytest.raises(ValueError, match="the library has"):
        model.encode(["some words"])


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    f = pseudonyms.Feistel(b"k")
    y = [f.permute(x, size, b"t") for x in range(size)]
    assert sorted(y) == list(range(size)) and [f.permute(v, size, b"t", True) for v in y] == list(range(size))


VALUES = ["+1 (743) 555-3824", "415-555-1234", "4539578763621486", "4539 5787 6362 1486", "233.233.171.252", "a.19@mail5.example.com", "2001-02-28", "31/12/1999", "5 May 1990", "DE89 3704 0044 0532 0130 00", "123-45-6789", 'token = "11acdfb36bb72224148e6160f674b4be45601bff"', "password=b7db7aa4a5fcc78305"]


@pytest.mark.parametrize("value", VALUES)
def test_pseudonyms_keep_format_and_links(value):
    f = pseudonyms.Feistel(b"k")
    one, spans = pseudonyms.replace(f"x {value} y", f)
    two, _ = pseudonyms.replace(f"{value}; {value}", f)
    new = one[2:-2]
    assert value not in one and len(spans) == 1 and two == f"{new}; {new}"
    if "May" not in value:
        shape = lambda s: re.sub("[a-z]", "a", re.sub("[0-9a-f]" if "token" in s else "[0-9]", "9", s))
        assert shape(new) == shape(value) or "." in value or "password" in value
    assert pseudonyms.replace(one, f, True)[0] == f"x {value} y"
    assert pseudonyms.replace(f"x {value} y", pseudonyms.Feistel(b"other"))[0] != one


@pytest.mark.parametrize("text", ["", "none here", "4539578763621487", "300.1.1.1", "1.2.3.4.5", "30.02.2000", "000-12-3456", "Version 3.11.2", "1111111111111111"])
def test_what_does_not_validate_stays(text):
    assert pseudonyms.replace(text, pseudonyms.Feistel(b"k")) == (text, [])


def plain_toxicity(examples, queries):
    """Scores by dictionaries and all pairs: (sorted cosines, vote) of each query (terms to counts, own example or None)."""
    n, share = len(examples), sum(y for y, _ in examples) / len(examples)
    df, df1 = {}, {}
    for y, counts in examples:
        for t in counts:
            df[t] = df.get(t, 0) + 1
            df1[t] = df1.get(t, 0) + y

    def vector(counts, own):
        out = {}
        for t, c in counts.items():
            d, d1 = df.get(t, 0), df1.get(t, 0)
            if own is not None:
                d, d1 = d - 1, d1 - examples[own][0]
            if d > 0:
                lift = max(0, (d1 + toxicity.SHRINK * share) / (d + toxicity.SHRINK) - share) / (1 - share)
                out[t] = (1 + math.log(c)) * math.log(1 + n / d) * (toxicity.FLOOR + lift)
        norm = math.sqrt(sum(w * w for w in out.values())) or 1.0
        return {t: w / norm for t, w in out.items()}

    vectors = [vector(c, None) for _, c in examples]
    empty = [y for y, c in examples if not c]
    prior = (sum(empty) + 0.5 * share) / (len(empty) + 0.5)
    told = []
    for counts, own in queries:
        q = vector(counts, own)
        near = sorted(((sum(w * v.get(t, 0) for t, w in q.items()), i) for i, v in enumerate(vectors) if i != own), key=lambda x: (-x[0], x[1]))
        near = [x for x in near if x[0] > 1e-6][: toxicity.NEIGHBOURS]
        weights = [1 / (1.1 - s) for s, _ in near] + [1 / 1.1] * (toxicity.NEIGHBOURS - len(near))
        labels = [examples[i][0] for _, i in near] + [prior] * (toxicity.NEIGHBOURS - len(near))
        told.append(([s for s, _ in near], sum(w * y for w, y in zip(weights, labels, strict=True)) / sum(weights)))
    return told


@pytest.mark.parametrize("frequent", [512, 10])
def test_toxicity_equals_all_cosines(frequent, monkeypatch):
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    rng = np.random.default_rng(3)
    examples = []
    for i in range(500):
        y = int(rng.random() < 0.3)
        terms = np.unique(np.concatenate([rng.zipf(1.4, rng.integers(0, 12)), rng.integers(10_000, 10_004 + 60 * (1 - y), rng.integers(0, 3))])).astype(np.uint64)
        examples.append((i, y, i * 7, terms, rng.integers(1, 4, len(terms))))
    index = toxicity.Index(examples)
    by_id = {e[0]: e[3:] for e in examples}
    index.calibrate([by_id[i] for i in index.ids])
    queries = [(e[3], e[4], e[2], e[0]) for e in examples[:120]] + [(np.unique(rng.zipf(1.4, 6)).astype(np.uint64), None, -5, None) for _ in range(80)]
    want = plain_toxicity([(e[1], dict(zip(e[3].tolist(), e[4].tolist(), strict=True))) for e in examples], [(dict(zip(t.tolist(), (c if c is not None else np.ones(len(t), int)).tolist(), strict=True)), own) for t, c, _, own in queries])
    agree = 0
    for (t, c, d, _), (cosines, vote) in zip(queries, want, strict=True):
        score, got, near = (x[0] for x in index.scores([d], [(t, c if c is not None else np.ones(len(t), np.int64))]))
        assert np.allclose(got[near >= 0], cosines, atol=2e-6)
        # Equal cosines may be met in another order at the last place, so a vote may differ there.
        agree += math.isclose(score, 1 / (1 + math.exp(-index.slope * vote - index.offset)), abs_tol=1e-4)
    assert index.fitted and agree >= 0.8 * len(queries)
    empty = toxicity.Index([])
    assert empty.scores([0], [(np.zeros(0, np.uint64), np.zeros(0, np.int64))])[0].tolist() == [0]


def test_terms_are_words_and_stems():
    texts = ["", None, "Trash, TRASH! pathetic 1x", "é réeuxment_réeuxaux"]
    got = list(toxicity.terms_of(texts))
    assert [int(c.sum()) for _, c in got] == [0, 0, 5, 5] and [len(t) for t, _ in got] == [0, 0, 4, 4]


def test_features_of_empty_and_odd_texts():
    x = quality.features([b"", b" \n", b"a", b"!!!", "é".encode() * 1000, b"x " * 10_000])
    assert np.isfinite(x).all() and not x[0].any() and x[5][quality.NAMES.index("distinct_words")] == 1 / 10_000


def test_ranking_learns_an_order():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.NAMES)))
    y = (x[:, 3] < 0.8).astype(int)
    m = quality.learn(x, y)
    assert ((m.score(x) >= quality.THRESHOLD) == (y == 1)).mean() > 0.95
    assert (quality.learn(x[:0], y[:0]).score(x[:3]) >= 0).all()
    assert len(set(quality.learn(x, np.ones(600, int)).score(x).tolist())) == 1


def test_log_softmax_sums_to_one():
    sizes = maxent.Sizes(256, 64, 256)
    w = np.random.default_rng(0).normal(size=(sizes.rows, sizes.classes))
    assert np.allclose(np.exp(maxent.log_softmax(w, np.array([0, 5, 70, 65535]), sizes)).sum(axis=1), 1)


def test_contexts_start_anew_in_each_text():
    one, two = maxent.before(np.array([3, 4, 5, 6, 7]), np.array([0, 3, 4, 5]))
    assert one.tolist() == [0, 3, 4, 0, 0] and two.tolist() == [0, 0, 3, 0, 0]


def test_fold_matches_crc():
    assert zlib.crc32(b"12") % 7 == 0x4F5344CD % 7


def test_slices_are_bounded_by_rows_and_bytes():
    import pyarrow as pa

    from sessile.llm.common import in_slices

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 2500)], ["text"])
    assert [b.num_rows for b in in_slices(iter([batch]), 1000)] == [1000, 1000, 500]
    parts = list(in_slices(iter([batch]), 1000, 100_000))
    assert sum(b.num_rows for b in parts) == 2500 and max(b.num_rows for b in parts) <= 100
    assert [b.num_rows for b in in_slices(iter([batch.slice(0, 0)]), 1000)] == [0]
