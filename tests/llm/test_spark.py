"""Operators on small tables against brute force, with nulls, ties, copies, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessile.llm import density, exact_dedup, jaccard, maxent, mixing, ogg, pieces, pseudonyms, quality, registry, toxicity
from sessile.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _score string, _id string, kept string, row string, n string"


def make_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    texts = [None, "", " \n", "a", "one two", "One  two", "one\ttwo"]
    for _ in range(40):
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(3, 120))))
    for base in texts[8:20]:
        for _ in range(rng.randint(1, 4)):
            words = base.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [texts[30]] * 25 + ["The " + texts[31]] * 3 + [" ".join(rng.choices(vocabulary, k=6000))]
    rows = [(i, t, "en", rng.choice(["s1", "s2", "S0", None, "é"]), None) for i, t in enumerate(texts)]
    rows += [rows[9], rows[40], (None, "no id here at all my friend", "en", "s1", None), (None, None, None, None, None)]
    return [(*r, "x", "y", "z", "0", "1") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def labels(spark, rows):
    out = [(r[0], (r[0] or 0) % 2, int("one" in (r[1] or ""))) for r in rows[:60]]
    return spark.createDataFrame([*out, (None, 1, 1), (3, None, None), (4, 1, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def set_of(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def brute_components(rows):
    """Least id that links reach, for each row."""
    sets = [set_of(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            parent[root(j)] = root(i)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[root(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(r[0], len(sets[i]), least[root(i)]) for i, r in enumerate(rows)]


def test_exact_dedup(docs, rows):
    groups = collections.defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact_dedup.dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_digest_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, "index_of_test", buckets=4)
    index.drop()
    a = spark.createDataFrame([(5, "x  y"), (3, "x y"), (9, "z")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "x y"), (2, "new"), (4, "new")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.dedup(a, index, 0).collect()} == {(5, 3, False), (3, 3, True), (9, 9, True)}
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.dedup(b, index, 1).collect()} == {(1, 3, False), (2, 2, True), (4, 2, False)}
    assert index.rows().count() == 3 and index.rows().filter("batch = 1").count() == 1
    index.drop()


def test_whole_tables_go_through_the_index_in_batches(spark, monkeypatch):
    seen = []
    append = exact_dedup.DigestIndex.append

    def noted(self, digested, batch):
        groups = append(self, digested, batch)
        seen.append((batch, groups.count(), self.rows().filter(f"batch = {batch}").count()))
        return groups

    monkeypatch.setattr(exact_dedup.DigestIndex, "append", noted)
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(100)] + [(None, "text 1"), (None, "own")], "doc_id long, text string")
    got = exact_dedup.dedup(docs).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is not None} == {(i, i % 30, len(range(i % 30, 100, 30)) + (i % 30 == 1), i < 30) for i in range(100)}
    assert {(r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is None} == {(1, 5, False), (None, 1, True)}
    # Later batches meet what earlier ones left, and add what is new alone.
    assert len(seen) == exact_dedup.BATCHES and sum(s[1] for s in seen) > 31 == sum(s[2] for s in seen)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]
    texts = docs.withColumn("doc_id", F.format_string("%03d", "doc_id"))
    assert texts.count() == exact_dedup.dedup(texts).count()


def test_ngram_join(docs, rows):
    got = [tuple(r) for r in jaccard.join(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows), key=str)


def test_ngram_join_in_small_blocks(docs, rows, monkeypatch):
    for name, value in (("BLOCK", 3), ("MANY", 2), ("SEEN", 0), ("TREE_GROUPS", 16), ("LEAF", 2)):
        monkeypatch.setattr(jaccard, name, value)
    got = [tuple(r) for r in jaccard.join(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows), key=str)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    name = {n: n for e in edges for n in e}
    for _ in range(70):
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    assert got == {n: name[n] for a, b in edges for n in (a, b) if n in got} and set(got) >= {n for a, b in edges if a != b for n in (a, b)}


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    sources = collections.Counter()
    for r in rows:
        sources[r[3]] += size(r[1])
    order = sorted((s for s in sources if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sources.values()) - sum(3 * sources[s] for s in capped)
        target = {s: 3.0 * sources[s] if s in capped else left * weight[s] / sum(weight[t] for t in order if t not in capped) for s in order}
        new = {s for s in order if target[s] > 3 * sources[s] and s not in capped}
        if not new:
            break
        capped |= new
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sources[r.source] and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= max(1, largest[s]) for s in order)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = collections.Counter(r.doc_id for r in mixing.mixed_rows(docs).collect())
    assert mixed == collections.Counter({i: c for i, c in sum((collections.Counter({r.doc_id: r.copies}) for r in got), collections.Counter()).items() if c})


def test_toxicity(docs, labels, rows):
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2)


def test_toxicity_learns_words(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choices("abcdef", k=4)) for _ in range(200)]
    data = []
    for i in range(400):
        bad = i % 5 == 0
        data.append((i, " ".join(rng.choices(plain, k=40) + (rng.choices(["vile", "nasty"], k=2) if bad else [])), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert all(got[i].predicted == y for i, _, y in data)
    assert got[0].evidence and {e.label for e in got[0].evidence} == {1}
    hidden = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.classify(docs, hidden).collect()} == {i: r.score for i, r in got.items()}


def test_quality(docs, labels, rows):
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_classifiers_without_labels(docs, labels, rows):
    for m in (toxicity, quality):
        assert len(m.classify(docs, labels.limit(0)).collect()) == len(rows)


def test_media(docs, rows):
    media = ogg.to_media(docs)
    got = ogg.from_media(media).collect()
    assert sorted(r.payload for r in got) == sorted(ogg.padded(r[1]) for r in rows)
    packets = ogg.packets(media).filter("doc_id = 9").collect()
    assert {p.serial for p in packets} <= {1, 2} and packets


def test_pieces(docs, rows):
    pytest.importorskip("public_tokenizers")
    got = pieces.encode(docs).collect()
    assert sorted(r.decoded for r in got) == sorted(r[1] or "" for r in rows)
    assert all(r.ids[-1] == 2 for r in got) and [2] in [r.ids for r in got]


def test_pseudonyms(spark):
    docs = spark.createDataFrame([(1, "call +1 (743) 555-3824"), (2, None), (3, ""), (4, "x +1 (743) 555-3824 y")], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs).collect()}
    assert got[2].text is None and got[3].text == "" and got[1].text[5:] == got[4].text[2:-2] != "+1 (743) 555-3824"
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymise(spark.createDataFrame([(r.doc_id, r.text) for r in got.values()], "doc_id long, text string"), back=True).collect()}
    assert back[1] == "call +1 (743) 555-3824"


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 1), (1, "u", "<p>a</p>", 1), (2, None, None, 1)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, density.extract(pages).collect()), key=str) == [(1, "u", "a"), (1, "u", "a"), (2, None, "")]


@pytest.mark.parametrize("frequent", [200_000, 3])
def test_lm_scoring(docs, rows, frequent, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", frequent)
    got = maxent.score(docs).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = lambda t: [*words_of(t), None]
    c = collections.Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r[1])), 6)) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.held_out == held(r.doc_id) for r in got)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)


def test_lm_probabilities_sum_to_one(docs, rows):
    model, words, _ = maxent.fit(docs.select("text"))
    assert int(model.class_tokens.sum()) == model.tokens == words.agg(F.sum("c")).first()[0]
    # Known words take (count + 1) / (tokens + words + 1) of their class; the rest is for unknown ones.
    known = (model.class_tokens + model.class_words) / (model.class_tokens + model.class_words + 1)
    assert ((0 <= known) & (known < 1)).all()


def test_empty_tables(empty, labels):
    for out in (exact_dedup.dedup(empty), jaccard.join(empty), mixing.mix(empty), mixing.mixed_rows(empty), toxicity.classify(empty, labels), quality.classify(empty, labels), ogg.from_media(ogg.to_media(empty)), pieces.encode(empty), pseudonyms.pseudonymise(empty), maxent.score(empty)):
        assert out.count() == 0


def test_pipeline_stages(spark, docs, rows, labels, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_join", "mixing", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.collect()]
        out = stage(spark, now, str(tmp_path))
        after = [tuple(r) for r in out.collect()]
        if name != "sentencepiece":
            assert out.columns == now.columns
        key = lambda r: str(r)
        if name == "toxicity":
            score = toxicity.classify(now, labels).filter("predicted = 0").count()
            assert len(after) == score and set(after) <= set(before)
        elif name == "exact_dedup":
            norm = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
            least = {}
            for r in before:
                if r[0] is not None:
                    least[norm(r)] = min(least.get(norm(r), r[0]), r[0])
            assert sorted(after, key=key) == sorted((r for r in before if r[0] == least.get(norm(r))), key=key)
        elif name == "ngram_join":
            want = [r for r, (i, _, least) in zip(before, brute_components(before), strict=True) if i == least]
            assert sorted(after, key=key) == sorted(want, key=key)
        elif name == "mixing":
            assert set(after) <= set(before)
        else:
            assert len(after) == len(before)
        if name != "sentencepiece":
            now = spark.createDataFrame(after, now.schema)


def test_queries_without_the_folder_are_optional():
    import __spark_entry__

    assert set(registry.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = registry.QUERIES[name](spark, sf)
    want = c.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(str([r[x] for x in columns]) for r in got.collect()) == sorted(str(list(r)) for r in want.fetchall())
