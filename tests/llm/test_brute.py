"""Plain versions, written apart from the operators: page density, pseudonym spans, ranking, and the stages of the pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sessile.llm import density, mixing, pseudonyms, quality, toxicity

# Pages as trees (tag, class, children); texts are strings.


def make_page(rng, depth=0):
    tag = rng.choice(["div", "div", "section", "p", "p", "article", "nav", "aside", "ul"]) if depth else "body"
    name = rng.choice(["", "", "", "ad", "main-text", "sidebar", "no-sidebar", "post comments"]) if depth else ""
    kids = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if depth < 4 and kind < 0.5 and tag != "p":
            kids.append(make_page(rng, depth + 1))
        elif kind < 0.65:
            kids.append(("a", "", [" ".join(rng.choices(["link", "more", "home"], k=rng.randint(1, 3)))]))
        elif kind < 0.7:
            kids.append(("script", "", ["var x = 1"]))
        else:
            kids.append(" ".join(rng.choices(["word", "and", "another", "longer-one"], k=rng.randint(1, 25))))
    return (tag, name, kids)


def render(node):
    if isinstance(node, str):
        return node
    tag, name, kids = node
    return f"<{tag}" + (f' class="{name}"' if name else "") + ">" + "".join(map(render, kids)) + f"</{tag}>"


class Plain:
    def __init__(self, node, up=None, in_article=False, in_link=False):
        tag, name, kids = node
        self.tag, self.up, self.node = tag, up, node
        words = [set(re.split("[^a-z]+", one)) for one in name.split()]
        named = any(not w & density.STATE_WORD and w & density.MARK_WORD for w in words) and tag not in ("article", "body")
        self.mark = tag in density.MARK_TAG or named
        link = in_link or tag == "a"
        self.texts = [(k.strip(), link) for k in kids if isinstance(k, str)]
        self.kids = [Plain(k, self, in_article or tag == "article", link) for k in kids if not isinstance(k, str) and k[0] not in density.NEVER_TAG]

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()

    def below_mark(self):
        return self.mark or (self.up is not None and self.up.below_mark())

    def chars(self):
        return sum(len(t) for n in self.walk() for t, _ in n.texts)

    def links(self):
        return sum(len(t) for n in self.walk() for t, link in n.texts if link or n.below_mark())

    def plain_chars(self):
        return sum(len(t) for n in self.walk() for t, link in n.texts if not link)


def plain_text(page):
    body = Plain(page)
    nodes = list(body.walk())
    while True:
        outer = [n for n in nodes if n.mark and not (n.up and n.up.below_mark()) and n.plain_chars()]
        if not outer or body.plain_chars() - sum(n.plain_chars() for n in outer) >= density.LEAST_UNMARKED * body.plain_chars():
            break
        max(outer, key=lambda n: (n.plain_chars(), -nodes.index(n))).mark = False
    total, linked = body.chars(), body.links()

    def dense(n):
        c, lc = n.chars(), n.links()
        inner = list(n.walk())[1:]
        t, lt = len(inner), sum(k.tag == "a" or k.below_mark() for k in inner)
        plain = c / (t or 1)
        if not c or not linked:
            return plain
        base = math.log(c / ((c - lc) or 1) * lc + linked / total * c + math.e)
        return plain * math.log(max(1.0, c / (lc or 1) * (t or 1) / (lt or 1))) / math.log(base)

    def total_of(n):
        return sum(map(dense, n.kids)) if n.tag in density.CONTAINER else 0.0

    def best(n):
        top = n
        for k in reversed(n.kids):
            under = best(k)
            if total_of(under) > total_of(top):
                top = under
        return top

    core = best(body)
    threshold, n = dense(body), core
    while n is not body:
        threshold, n = min(threshold, dense(n)), n.up
    chosen = set()

    def descend(n):
        if n.below_mark():
            return
        if dense(n) >= threshold and n.chars():
            chosen.add(id(best(n)))
            for k in n.kids:
                descend(k)

    descend(body)
    blocks, state = [[]], {"content": False}

    def collect(node, plain, content, marked):
        content, marked = content or id(plain) in chosen, marked or plain.mark
        kids = iter(plain.kids)
        block = plain.tag in density.BLOCK
        if block:
            blocks.append([])
        for k in node[2]:
            if isinstance(k, str):
                if content and not marked:
                    blocks[-1].append(k)
            elif k[0] not in density.NEVER_TAG:
                collect(k, next(kids), content, marked)
        if block:
            blocks.append([])

    collect(page, body, state["content"], False)
    return "\n\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def test_density_equals_a_plain_version():
    rng = random.Random(11)
    changed = some = 0
    for _ in range(300):
        page = make_page(rng)
        got = density.main_text("<html>" + render(page) + "</html>")
        assert got == plain_text(page), render(page)
        some += bool(got)
        # Words of all texts in page order: what is left when density decides nothing.
        changed += sorted(got.split()) != sorted(" ".join(t for n in Plain(page).walk() for t, _ in n.texts).split())
    assert some > 250 and changed > 200


ARTICLE = "<h1>Title here</h1><p>" + "Long paragraph of words. " * 12 + "</p><p>" + "More of the story. " * 9 + "</p><p>Ok.</p>"


@pytest.mark.parametrize("name", ["page no-sidebar", "content has-sidebar", "layout with-nav", "post-content ad-free", "container widget-area", "newsletter-issue", "banner-story", "entry comments-open"])
@pytest.mark.parametrize("tag", ["article", "div", "form"])
def test_wrappers_keep_their_article(name, tag):
    page = f'<body><nav><a href=x>home</a> <a href=y>about us</a></nav><div class="{name}"><div class=sidebar>Some side text here</div><{tag}>{ARTICLE}</{tag}></div><footer>foot text</footer></body>'
    got = density.main_text(page)
    assert got.startswith("Title here\n\nLong") and got.endswith("\n\nOk.") and "side" not in got and "foot" not in got


def test_comments_longer_than_the_article_go():
    page = f"<body><article>{ARTICLE}</article><section id=comments>{'<article class=comment><p>' + 'I think so too. ' * 9 + '</p></article>'}{'<div><p>' + 'Me as well, and more. ' * 60 + '</p></div>'}</section></body>"
    assert "think" not in density.main_text(page) and density.main_text(page).endswith("Ok.")


PARTS = ["+1 (743) 555-3824", "415-555-1234", "4539578763621486", "233.233.171.252", "a.19@mail5.example.com", "2001-02-28", "31/12/1999", "DE89 3704 0044 0532 0130 00", 'token = "11acdfb36bb72224148e6160f674b4be"', "plain words", "12", "2001-02-28 415-555-1234", "password=415-555-1234"]


def test_spans_equal_comparing_all_pairs():
    rng, f = random.Random(9), pseudonyms.Feistel(b"k")
    for _ in range(200):
        text = rng.choice([" ", ", ", ""]).join(rng.choices(PARTS, k=rng.randint(1, 12)))
        found = []
        for kind, pattern, change in pseudonyms.KINDS:
            for m in re.finditer(pattern, text):
                if all(m.end() <= a or m.start() >= b for a, b, _, _ in found) and (new := change(f, m, False)) is not None:
                    found.append((m.start(), m.end(), kind, new))
        out = text
        for a, b, _, new in sorted(found, reverse=True):
            out = out[:a] + new + out[b:]
        assert pseudonyms.replace(text, f) == (out, [(k, a, b) for a, b, k, _ in sorted(found)])
        assert pseudonyms.replace(out, f, True)[0] == text or "password=" in text or len(found) != len(pseudonyms.replace(out, f)[1])


def test_ranking_equals_plain_loops():
    rng = np.random.default_rng(2)
    x, y = rng.random((40, len(quality.NAMES))), (rng.random(40) < 0.7).astype(int)
    steps, rate, ridge = 15, 0.5, 1e-4
    model = quality.learn(x, y, steps=steps, rate=rate, ridge=ridge)
    draw = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rare, other = (good, bad) if len(good) < len(bad) else (bad, good)
    n = max(quality.PAIRS * len(rare), len(other))
    first = np.resize(draw.permutation(rare), n).tolist()
    second = [i for _ in range(-(-n // len(other))) for i in draw.permutation(other).tolist()][:n]
    pairs = [(a, b) if y[a] == 1 else (b, a) for a, b in zip(first, second, strict=True)]
    bins = [[sum(v >= e for e in model.edges[f]) for f, v in enumerate(row)] for row in x.tolist()]
    w = [[0.0] * quality.BINS for _ in quality.NAMES]
    speed = [[0.0] * quality.BINS for _ in quality.NAMES]
    for _ in range(steps):
        rank = [sum(w[f][b] for f, b in enumerate(row)) for row in bins]
        slope = [[-ridge * v for v in row] for row in w]
        for win, lose in pairs:
            push = 1 / (1 + math.exp(rank[win] - rank[lose])) / n
            for f in range(len(w)):
                slope[f][bins[win][f]] += push
                slope[f][bins[lose][f]] -= push
        for f in range(len(w)):
            for b in range(quality.BINS):
                speed[f][b] = 0.9 * speed[f][b] + slope[f][b]
                w[f][b] += rate * speed[f][b]
    assert np.allclose(model.weights, w, atol=1e-9)
    rank = [sum(w[f][b] for f, b in enumerate(row)) for row in bins]
    z = [model.slope * (r - model.threshold) + math.log(quality.THRESHOLD / (1 - quality.THRESHOLD)) for r in rank]
    assert np.allclose(model.score(x), [1 / (1 + math.exp(-v)) for v in z], atol=1e-9)


def plain_terms(text):
    words = re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())
    return collections.Counter([(0, w) for w in words] + [(1, w[: toxicity.STEM]) for w in words if len(w) > toxicity.STEM])


def test_stages_equal_plain_versions(spark, tmp_path):
    from tests.llm.test_small import plain_toxicity

    sentencepiece, public = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    rng = random.Random(12)
    plain = ["".join(rng.choices("abcdef", k=rng.randint(3, 9))) for _ in range(150)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        rows.append((i, " ".join(rng.choices(plain, k=rng.randint(5, 60)) + (rng.choices(["vile", "nastyness", "nastying"], k=2) if bad else [])), rng.choice(["s1", "s2", None])))
        if i % 3:
            labels.append((i, int(bad)))
    labels += [(i, int(i % 6 == 0)) for i in range(0, 240, 3)] + [(9_000 + i, 1) for i in range(50)]
    rows += [(None, None, "s1"), (500, "", "s2"), (501, rows[6][1], "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.without_toxic(spark, docs, str(tmp_path))
    known = dict(labels)
    text_of = {r[0]: r[1] for r in rows}
    ids = [i for i in sorted(text_of, key=lambda v: (v is None, v)) if i in known and zlib.crc32(str(i).encode()) % 4 != 2]
    own = {}
    for place, i in enumerate(ids):
        own.setdefault(text_of[i], place)
    index = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert sorted(index.ids) == ids
    told = plain_toxicity([(known[i], plain_terms(text_of[i])) for i in ids], [(plain_terms(r[1]), own.get(r[1] or "")) for r in rows])
    score = [1 / (1 + math.exp(-index.slope * vote - index.offset)) for _, vote in told]
    sure = [abs(s - toxicity.THRESHOLD) > 0.02 for s in score]
    want = collections.Counter(r for r, s, clear in zip(rows, score, sure, strict=True) if s < toxicity.THRESHOLD and clear)
    got = collections.Counter(map(tuple, kept.collect()))
    assert sum(sure) > 0.9 * len(rows) and not want - got
    assert not collections.Counter(r for r, s, clear in zip(rows, score, sure, strict=True) if s >= toxicity.THRESHOLD and clear) & got
    # Mixing repeats each row as often as the mix says.
    mixed = collections.Counter(map(tuple, corpus_pipeline.mixed(spark, docs, "").collect()))
    times = collections.Counter()
    for r in mixing.mix(docs).collect():
        times[r.doc_id] += r.taken // r.size if r.size else r.copies
    assert {r[0]: n for r, n in mixed.items()} == {i: n for i, n in times.items() if n}
    # Encoding gives the library's ids.
    library = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    encoded = corpus_pipeline.encoded(spark, docs, "").collect()
    mine = collections.Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.ids_sha256) for r in encoded)
    theirs = [(r[0], tuple(library.encode(r[1] or "", add_eos=True))) for r in rows]
    assert mine == collections.Counter((i, t, len(t), hashlib.sha256(" ".join(map(str, t)).encode()).hexdigest()) for i, t in theirs)
