"""Each operator against brute force, an independent formula or held-out rows, and the awkward tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import decontaminate as D
from tideline.llm import langid, mixing, ppm, quality, sharding, textops, toxicity
from tideline.llm.exact_dedup import exact_dedup
from tideline.llm.features import as_arrow

ODD = [(1, None), (2, ""), (3, "  \n"), (4, "Ü Ä"), (5, "word"), (6, "word"), (6, "word"), (7, "x" * 50_000 + " y " * 5000), (8, "WORD"), (9, "..!! 12")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, 0, "clash", 1.0, 5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, size int")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").cache()


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# -- 1 exact dedup


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, docs, keep):
    import hashlib

    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(10_000 + k, "The SAME" if k % 2 else "the same") for k in range(600)] + [(20_000, "É"), (20_001, "é"), (20_002, None), (20_003, "")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    got = {r["doc_id"]: r for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), keep=keep).collect()}
    assert len(got) == len(rows)
    for text, ids in groups.items():
        best = max(ids) if keep == "max" else min(ids)
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (best, len(ids), i == best)
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_odd(odd):
    got = exact_dedup(odd).collect()
    assert len(got) == len(ODD) and {r["doc_id"] for r in got if r["kept"]} == {2, 3, 4, 7, 8, 9}
    assert exact_dedup(odd.limit(0)).count() == 0


# -- 4 decontamination


def test_decontamination(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijklmnop") * rng.randint(1, 3)
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 4, 5, 9, 20, 60])))) for k in range(40)] + [(40, None), (41, ""), (42, "?!")]
    texts = []
    for k in range(120):
        body = [word() for _ in range(rng.choice([0, 10, 300, 3000]))]
        if k % 2:
            words = items[rng.randrange(40)][1].split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + rng.choice(["", ",", "!"]) for w in words]
        texts.append((k, " ".join(body)))
    want = set()
    for i, t in texts:
        own = D.shingles(t.encode())
        for j, x in items:
            width, q = D.item_shingles((x or "").encode())
            shared = len(q & (own if width == 5 else D.shingles(t.encode(), width)))
            if q and shared / len(q) >= 0.8 - 1e-12:
                want.add((i, j, shared, len(q)))
    a = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r)[:4] for r in D.contamination(a, b).collect()} == want and len(want) > 15
    assert {1, 3, 4, 5} <= {len((items[j][1] or "").split()) for _, j, *_ in want}
    assert {r["doc_id"] for r in D.decontaminate(a, b).collect()} == {i for i, _ in texts} - {w[0] for w in want}


def test_decontamination_in_blocks_and_odd(spark, odd, monkeypatch):
    items = spark.createDataFrame([(1, "word"), (2, " ".join("y" for _ in range(9))), (3, None)], "item_id long, text string")
    whole = sorted(map(tuple, D.contamination(odd, items).collect()))
    assert [r[:2] for r in whole] == [(5, 1), (6, 1), (6, 1), (7, 2), (8, 1)]
    monkeypatch.setattr(D, "BLOCK_BYTES", 4)
    assert sorted(map(tuple, D.contamination(odd, items).collect())) == whole
    assert [r["doc_id"] for r in D.decontaminate(odd, items).orderBy("doc_id").collect()] == [1, 2, 3, 4, 9] and D.decontaminate(odd, items).columns == odd.columns
    assert D.contamination(odd.limit(0), items).count() == D.contamination(odd, items.limit(0)).count() == 0


# -- 5 language model


def test_trie_is_a_distribution():
    text = b"abracadabra abracadabra the cat sat on the mat the cat"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 20, len(text)])
    keys, first, end = ppm.coded(data, offsets)
    keys = keys[np.concatenate([np.arange(a, b) for a, b in zip(first, end)])]
    for least in (1, 2):
        counts = []
        for k in range(ppm.ORDER + 1):
            kk, n = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
            counts.append((kk[n >= least], n[n >= least]))
        trie = ppm.Trie(counts)
        for ctx in [0, *(int(x) >> 8 for x in keys[::7]), 0x7A7A7A7A7A]:
            every = (np.uint64(ctx) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
            assert (10 ** trie.log_probability(every)).sum() == pytest.approx(1, abs=1e-9)


def test_lm_scores(spark, docs):
    train = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) != 2)
    got = {r["doc_id"]: r for r in ppm.score_corpus(docs, train).collect()}
    rows = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    c = Counter(w for i, ws in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    for i, ws in rows.items():
        tokens = [*ws, None]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens))
        assert got[i]["score"] < 0


@pytest.mark.parametrize("share, part", [(None, None), (1e-3, None), (1e-3, 40)])
def test_lm_knows_every_string(docs, monkeypatch, share, part):
    """Against one trie of all strings, however few of them are frequent and however small the parts of the trie."""
    if share:
        monkeypatch.setattr(ppm, "SHARE", share)
    if part:
        monkeypatch.setattr(ppm, "LEAST_PART", part)
        monkeypatch.setattr(ppm, "partitions", lambda spark, df=None: 4 if df is not None else 1000)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    learned = {i: t for i, t in texts.items() if i % 5}
    coded = lambda ts: ppm.coded(np.frombuffer(b"".join(ts), np.uint8), np.cumsum([0, *map(len, ts)]))
    keys, first, end = coded(list(learned.values()))
    keys = keys[np.concatenate([np.arange(a, b) for a, b in zip(first, end)])]
    trie = ppm.Trie([np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(ppm.ORDER + 1)])
    keys, first, end = coded(list(texts.values()))
    got = {r["doc_id"]: r["score"] for r in ppm.score_corpus(docs, docs.where("doc_id % 5 <> 0")).collect()}
    for i, a, b in zip(texts, first, end, strict=True):
        assert got[i] == pytest.approx(trie.log_probability(keys[a:b]).sum(), abs=1e-6)


def test_lm_odd(odd):
    got = ppm.score_corpus(odd, odd.limit(0)).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r["train_tokens"] == 0 and r["n_known"] == 0
    empty = next(r for r in got if r["doc_id"] == 2)
    assert (empty["n_tokens"], empty["base_score"], empty["score"]) == (1, 0.0, pytest.approx(-math.log10(256)))
    assert len(ppm.score_corpus(odd, odd).collect()) == len(ODD) and ppm.score_corpus(odd.limit(0), odd).count() == 0


# -- 3, 7, 8: classifiers


def words_of(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_toxicity_learns_words_and_stems():
    rng = random.Random(3)
    make = lambda: words_of(rng, "abcdefghij", rng.randint(5, 90)).split()
    texts, y = [], []
    for k in range(700):
        words = make()
        if k % 3 == 0:
            words.insert(rng.randint(0, len(words)), rng.choice(["Zork", "quux" + words_of(rng, "abc", 1)]))
        texts.append(" ".join(words).encode())
        y.append(int(k % 3 == 0))
    model = toxicity.train(texts[:500], y[:500])
    score = np.concatenate([toxicity.score_block(model, d, o) for _, _, d, o in textops.blocks(as_arrow(texts[500:]))])
    assert ((score >= 0.3) == np.array(y[500:], bool)).mean() > 0.9
    one = np.concatenate([toxicity.score_block(model, d, o) for _, _, d, o in textops.blocks(as_arrow(texts[500:501]))])
    assert one[0] == pytest.approx(score[0], abs=1e-5)


def test_toxicity_gradients():
    model = toxicity.Model.fresh(1)
    for name in ("word", "char", "attend", "out"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.inp, model.rec, model.bias = ([w.astype(np.float64) for w in x] for x in (model.inp, model.rec, model.bias))
    data = b"one two three four five six"
    words = toxicity.read_words(toxicity.spaced(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
    places, real, _ = toxicity.windows(words)
    y = np.ones(1)
    seen = {}
    model.move = lambda weight, grad, name, rate: seen.update({name: grad})
    model.spread = lambda *a: None
    model.step(words, places, real, y, 0.0)

    def loss():
        return float(np.log1p(np.exp(-model.logits(words)[0][0])))

    for name, weight in (("out", model.out), ("attend", model.attend), ("rec0", model.rec[0]), ("rec1", model.rec[1]), ("inp0", model.inp[0]), ("bias1", model.bias[1])):
        at = np.unravel_index(np.abs(seen[name]).argmax(), weight.shape)
        old = weight[at]
        weight[at] = old + 0.05
        up = loss()
        weight[at] = old - 0.05
        down = loss()
        weight[at] = old
        assert (up - down) / 0.1 == pytest.approx(float(seen[name][at]), rel=0.05, abs=2e-5)


def test_languages():
    rng = random.Random(5)
    alphabets = {"en": "abcdefg", "de": "abcdefü", "fr": "klmnopé", "es": "klmnopñ", "xx": "rstuvw"}
    rows = [(words_of(rng, a, rng.randint(8, 40)).encode(), lang) for lang, a in alphabets.items() for _ in range(120)]
    rng.shuffle(rows)
    model = langid.train([t for t, _ in rows[:400]], [x for _, x in rows[:400]])
    assert model.families == ["germanic", "romance", "xx"] and len(model.pairs) == 2
    margin = np.concatenate([langid.score_block(model, d, o) for _, _, d, o in textops.blocks(as_arrow([t for t, _ in rows[400:]]))])
    lang, score = model.predict(margin)
    assert np.mean([model.langs[x] == y for x, (_, y) in zip(lang, rows[400:])]) > 0.95 and (0 <= score).all() and (score <= 1).all()


def test_ordinal_grades():
    rng = random.Random(6)
    rows = []
    for _ in range(600):
        g = rng.randint(0, 3)
        rows.append((" ".join(rng.choice("good" if rng.random() < g / 3 else "bad ") for _ in range(40)).replace("g", "fine ").replace("b", "poor ").encode(), g))
    model = quality.train([t for t, _ in rows[:450]], [g for _, g in rows[:450]])
    assert (np.diff(model.thresholds) > 0).all()
    tails = np.concatenate([model.tails(model.value(quality.read_block(d, o))) for _, _, d, o in textops.blocks(as_arrow([t for t, _ in rows[450:]]))])
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(tails.sum(1), [g for _, g in rows[450:]])[0, 1] > 0.8


def test_classifiers_odd(spark, odd, docs, labels):
    tox = toxicity.toxicity_scores(odd, toxicity.fit(docs, labels)).collect()
    assert len(tox) == len(ODD) and all(0 <= r["score"] <= 1 for r in tox) and {r["score"] < 0.3 for r in tox if r["doc_id"] in (1, 2, 3)} == {True}
    assert toxicity.reject_toxic(odd, toxicity.Model.fresh()).columns == odd.columns
    named = {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(odd, langid.fit(docs)).collect()}
    assert {i for i, x in named.items() if x == "und"} == {1, 2, 3, 9}
    model = quality.fit(docs, labels, F.col("quality"), ["quality"])
    graded = quality.grade_documents(odd, model, 1).collect()
    assert len(graded) == len(ODD) and all(0 <= r["tail_prob"] <= 1 and r["kept"] == (r["tail_prob"] >= 0.5) for r in graded)
    none = labels.limit(0)
    assert toxicity.toxicity_scores(odd, toxicity.fit(docs, none)).count() == len(ODD)
    assert {r["lang_pred"] for r in langid.predict_languages(odd, langid.fit(docs.limit(0))).collect()} == {"und"}
    assert quality.grade_documents(odd.limit(0), quality.fit(docs, none, F.col("quality"), ["quality"]), 1).count() == 0


# -- 6 mixing


def test_rates_are_the_projected_gradient_optimum(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    t = rng.integers(1, 500, 400)
    members = spark.createDataFrame([(k, int(t[k]), [float(x) for x in p[k]]) for k in range(400)], "doc_id long, n_tokens long, posterior array<double>")
    rates = mixing.fit_rates(members, ["a", "b", "c"], {"a": 0.7, "b": 0.25, "c": 0.05})
    made = {r["doc_id"]: (r["rate"], r["copies"]) for r in mixing.with_copies(members, rates).collect()}
    r = np.ones(400)
    for step in rates.steps:
        r = np.maximum(0, r - p @ step)
    assert np.allclose(r, [made[k][0] for k in range(400)], atol=1e-9) and (r >= 0).all() and (r == 0).any()
    assert np.allclose((r * t) @ p / t.sum(), [0.7, 0.25, 0.05], atol=1e-4)
    assert all(math.floor(x) <= c <= math.floor(x) + 1 for x, c in made.values())


def test_mix(spark, docs, labels, odd):
    model = mixing.fit_domains(docs, labels, F.when(F.col("quality") == 1, F.col("lang")).otherwise("poor"), ["quality"])
    mixed = mixing.mix(docs, model, {"de": 0.5, "en": 0.5})
    assert mixed.columns == docs.columns and mixed.count() > 0
    members = mixing.memberships(odd, model).collect()
    assert all(sum(r["posterior"]) == pytest.approx(1) for r in members) and {r["doc_id"]: r["n_tokens"] for r in members}[2] == 0
    assert mixing.mix(odd.limit(0), model, {"en": 1.0}).count() == 0 and mixing.mix(odd, model, {}).count() == len(ODD)


def test_long_texts_are_read_in_pieces(spark, docs, labels, monkeypatch):
    model = mixing.fit_domains(docs, labels, F.when(F.col("quality") == 1, F.col("lang")).otherwise("poor"), ["quality"])
    some = [(r["doc_id"], r["text"]) for r in docs.limit(40).collect()]
    odd = ["", None, " ", "one", " two\n", "a" * 50, "a" * 7 + " " * 7 + "b", "\u00e9\U0001f600 " * 9, "x\ny\n", "abcdefg", "abcdef ", "abcdefg hijklm"]
    rows = spark.createDataFrame(some + list(enumerate(odd, 10**6)), "doc_id long, text string")
    want = {r["doc_id"]: (r["n_tokens"], r["posterior"]) for r in mixing.memberships(rows, model).collect()}
    monkeypatch.setattr(mixing, "PIECE", 7)
    got = {r["doc_id"]: (r["n_tokens"], r["posterior"]) for r in mixing.memberships(rows, model).collect()}
    assert got == want and any(n > 100 for n, _ in got.values())
    longest = rows.select(F.array_max(F.transform(mixing.word_pieces(F.col("text")), lambda p: F.size(mixing.word_buckets(p)))).alias("n")).agg(F.max("n")).first()[0]
    assert longest <= 8
    again = mixing.fit_domains(docs, labels, F.when(F.col("quality") == 1, F.col("lang")).otherwise("poor"), ["quality"])
    assert again.names == model.names and (again.weights == model.weights).all()


# -- 10 sharding


@pytest.mark.parametrize("bits", [2, 3])
def test_hilbert_curve(bits):
    axes = np.indices((1 << bits,) * 3).reshape(3, -1).T
    order = np.argsort(sharding.hilbert_index(axes, bits))
    assert sorted(sharding.hilbert_index(axes, bits)) == list(range(len(axes))) and (np.abs(np.diff(axes[order], axis=0)).sum(1) == 1).all()


def test_shards(docs, odd):
    got = sharding.shard(docs, 16).collect()
    n = len(got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(map(len, by.values())) <= {n // 16, n // 16 + 1} and sorted(by) == list(range(16))
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by.values())
    flat = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert flat == sorted(flat)
    index = dict(zip(map(tuple, np.indices((32,) * 3).reshape(3, -1).T.tolist()), sharding.hilbert_index(np.indices((32,) * 3).reshape(3, -1).T, 5).tolist()))
    places = []
    for values in ([r["source"] for r in got], [r["lang"] for r in got]):
        ordered, cuts = sorted(v for v in values if v is not None), set()
        for v in set(ordered):
            upto = sum(x <= v for x in ordered)
            if upto * 32 // len(ordered) > (upto - ordered.count(v)) * 32 // len(ordered) and upto < len(ordered):
                cuts.add(v)
        places.append([0 if v is None else sum(c < v for c in cuts) for v in values])
    for r, a, b in zip(got, *places):  # the third axis by the curve itself: quantiles of numbers are Spark's own
        assert r["curve"] in {index[a, b, c] for c in range(32)}
    sizes = defaultdict(set)
    inverse = {v: k for k, v in index.items()}
    for r in got:
        sizes[inverse[r["curve"]][2]].add(r["size"])
    spans = [(min(v), max(v)) for _, v in sorted(sizes.items())]
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:])) and len(spans) > 20
    small = sharding.shard(odd, 16).collect()
    assert len(small) == len(ODD) and len({(r["shard"], r["slot"]) for r in small}) == len(ODD) and {r["doc_id"]: r["size"] for r in small}[1] == 1
    assert sharding.shard(odd.limit(0)).count() == 0


def test_shards_of_one_long_opening_a_hot_cell_and_one_id(spark):
    rows = [(None if k % 3 else 7, f"https://a-common-opening/{'xyz'[k % 3]}", "en", "same text") for k in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), 16).collect()
    assert len({(r["shard"], r["slot"]) for r in got}) == 900 and len({(r["source"], r["curve"]) for r in got}) == 3 == len({r["curve"] for r in got})
    counts = Counter(r["shard"] for r in got)
    assert set(counts.values()) <= {56, 57} and all(r["slot"] < counts[r["shard"]] for r in got)


def test_a_bare_table_of_nulls_shards(spark):
    got = sharding.shard(spark.createDataFrame([(None, None, None, None)] * 40, "doc_id long, source string, lang string, text string"), 16).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [2] * 8 + [3] * 8


# -- shared pieces


def test_blocks_and_nulls(monkeypatch):
    monkeypatch.setattr(textops, "BLOCK", 10)
    texts = ["abc", None, "", "a" * 25, "é", None]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts]).slice(1)):
        back = [bytes(data[a:b]) for _, _, data, offsets in textops.blocks(column) for a, b in zip(offsets[:-1], offsets[1:])]
        assert back == [(t or "").encode() for t in texts]


def test_pipeline_stages_chain(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(out.columns) and 0 < out.count()
