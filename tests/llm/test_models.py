import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from patternfold.llm import attention_lm, blocks, components, jaccard_regions, language_bits, ordinal_quality, word_counts
from patternfold.llm.byte_tokens import default_vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(900, None), (901, ""), (902, " \n"), (903, "12 34 !!"), (904, "x"), (904, "x"), (905, "wort " * 5000), (None, "no id here at all")]


@pytest.fixture(scope="module")
def docs(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    return d.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], d.schema)).cache()


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


# --- languages


def test_languages(docs):
    model = language_bits.learn(docs, F.col("doc_id").isNotNull() & ~language_bits.held_out())
    rows = language_bits.predict(docs.withColumn("score", F.lit("clash")), model).collect()
    held = [r for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (900, 901, 902, 903)} == {"und"}
    none = language_bits.learn(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_bits.predict(docs.limit(3), none).collect()} == {"und"}


def test_filter_is_a_bloom_filter():
    counts = np.zeros((70, language_bits.CODES), np.int64)
    r = np.random.default_rng(0)
    for i in range(70):
        counts[i, r.integers(0, language_bits.CODES, 500)] += 1
    f = language_bits.LanguageFilter.build([str(i) for i in range(70)], counts)
    for i in (0, 3, 69):
        own = np.flatnonzero(counts[i])
        assert ((f.masks(own)[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
        other = r.integers(0, language_bits.CODES, 20000)
        other = other[counts[i, other] == 0]
        wrong = ((f.masks(other)[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
        assert wrong < 3 * f.false_rate[i] + 1e-3


def test_shares_equal_a_plain_count(docs):
    """Prediction by sets: of each text's n-grams, those that a language holds, less the expected false ones."""
    r = np.random.default_rng(5)
    counts = np.zeros((5, language_bits.CODES), np.int64)
    texts = ["The quick brown fox", "xyzzy plugh", "Ein Wörtchen mit Ä", "a", "12 b3", "", None]
    codes, per, _, _ = language_bits.grams(pa.array(texts))
    for i in range(5):
        counts[i, r.choice(codes, 30)] += 3
        counts[i, r.integers(0, language_bits.CODES, 200)] += 1
    counts[4] = counts[3]  # a tie
    f = language_bits.LanguageFilter.build(list("abcde"), counts)
    got = f.shares(codes, per)
    share = counts / counts.sum(axis=1, keepdims=True)
    held = [{c for c in np.flatnonzero(counts[i]).tolist() if share[i, c] >= language_bits.RATE and share[i, c] * language_bits.KIN >= share[:, c].max()} for i in range(5)]
    bits = [{(k, int(p)) for k in range(language_bits.K) for p in language_bits._positions(np.array(sorted(h)), k)} for h in held]
    at = np.cumsum(per) - per
    for d in range(len(texts)):
        own = codes[at[d] : at[d] + per[d]].tolist()
        for i in range(5):
            every = {p for _, p in bits[i]}
            hits = sum(all(int(language_bits._positions(np.array([c]), k)[0]) in every for k in range(language_bits.K)) for c in own)
            rate = (len(every) / language_bits.POSITIONS) ** language_bits.K
            assert got[d, i] == pytest.approx(min(max((hits / len(own) - rate) / (1 - rate), 0), 1))
    names, score, _ = f.predict(pa.array(texts))
    for d, t in enumerate(texts):
        letters = any(c.isalpha() for c in t or "")
        assert names[d] == ("abcde"[int(np.argmax(got[d]))] if letters else "und")
        assert score[d] == pytest.approx(got[d].max() / got[d].sum() if letters and got[d].sum() else 0)


# --- language model


def test_gradients():
    m = attention_lm.Attention.fresh()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    r = np.random.default_rng(0)
    x = r.integers(0, attention_lm.SUBWORDS, (3, attention_lm.WINDOW)).astype(np.int32)
    y = r.integers(0, attention_lm.SUBWORDS, (3, attention_lm.STRIDE)).astype(np.int32)
    y[0, 5:] = -1
    _, d = m.gradients(x, y)
    for k, g in d.items():
        i = int(np.abs(g).argmax())
        old = m.w[k].flat[i]
        m.w[k].flat[i] = old + 1e-3
        up = m.gradients(x, y)[0]
        m.w[k].flat[i] = old - 1e-3
        down = m.gradients(x, y)[0]
        m.w[k].flat[i] = old
        assert g.flat[i] == pytest.approx((up - down) / 2e-3, rel=1e-3)


def test_windows_score_each_subword_once():
    ids, sizes = np.arange(100, dtype=np.int32), np.array([1, 59, 40])
    x, y, start, per = attention_lm.windows(ids, sizes)
    got = np.concatenate([y[s + attention_lm.BACK : s + attention_lm.WINDOW] for s in start])
    assert sorted(got[got >= 0].tolist()) == list(range(100)) and per.tolist() == [-(-n // attention_lm.STRIDE) for n in sizes]
    m = attention_lm.Attention.fresh()
    assert m.score(ids, sizes)[1] == pytest.approx(m.score(ids[1:60], np.array([59]))[0], rel=1e-4)
    every = np.arange(attention_lm.SUBWORDS + 1, dtype=np.int32)
    total = np.exp(m.log_probs(np.full((len(every), attention_lm.WINDOW), 5, np.int32), every[:, None].repeat(attention_lm.STRIDE, 1))).reshape(-1, attention_lm.STRIDE)[:, 0].sum()
    assert total == pytest.approx(1, rel=1e-3)


def test_windows_equal_plain_loops():
    A = attention_lm
    r = np.random.default_rng(2)
    texts = [np.append(r.integers(0, A.SUBWORDS, n), A.END).astype(np.int32) for n in (0, 18, 19, 0, 20, 39, 57)]
    x, y, start, per = A.windows(np.concatenate(texts), np.array([len(t) for t in texts]))
    want = [(t, first) for t in texts for first in range(0, len(t), A.STRIDE)]
    assert len(start) == len(want) == per.sum()
    for s, (t, first) in zip(start, want):
        places = range(first - A.BACK, first + A.STRIDE)
        assert x[s : s + A.WINDOW].tolist() == [t[i - 1] if 0 < i < len(t) else A.END for i in places]
        assert y[s + A.BACK : s + A.WINDOW].tolist() == [t[i] if i < len(t) else -1 for i in places[A.BACK :]]


def test_subwords_equal_plain_loops():
    s = attention_lm.Subwords(default_vocabulary(), np.zeros(1, np.int64))
    assert (s.size > 1).any() and (s.size == 1).any()
    r = np.random.default_rng(4)
    one = np.flatnonzero(s.size == 1)
    for pool in (np.arange(len(s.size)), one):
        texts = [r.choice(pool, n) for n in (0, 0, 7, 1, 60, 0, 33, 0)]
        got, sizes = s.streams(np.concatenate(texts).astype(np.uint16), np.array([len(t) for t in texts]))
        want = [[int(p) for i in t for p in s.parts[s.first[i] : s.first[i] + s.size[i]]] + [attention_lm.END] for t in texts]
        assert got.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]


def test_words_of_ids_are_those_of_texts(docs):
    texts = ["it's we'll 12ab3 ?! naïve 東京 \u3000x\u00a0  x", "", None, " \n\t ", "a" * 3000 + " A", "\x00\x7f \U0001f600\ufffd <|endoftext|>"]
    texts += [r.text for r in docs.select("text").collect()]
    own = attention_lm.kept(default_vocabulary())
    ids, sizes = own.streams(pa.array(texts, pa.string()))
    rows = [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    got, row = attention_lm.id_words(default_vocabulary())(pa.record_batch({"ids": pa.array(rows, pa.binary())}))
    want = [(i, w) for i, x in enumerate(texts) for w in words(x)]
    assert row.tolist() == [i for i, _ in want]
    assert len(set(zip(got.tolist(), (w for _, w in want)))) == len(set(got.tolist())) == len({w for _, w in want})
    none = attention_lm.id_words(default_vocabulary())(pa.record_batch({"ids": pa.array([b"", b""], pa.binary())}))
    assert [len(x) for x in none] == [0, 0]


def test_memory_goes_back_once_a_task(monkeypatch):
    """A slice takes over what the one before it freed: clearing those pages again cost a quarter of that stage's time."""
    trims = []
    monkeypatch.setattr(blocks, "trim", lambda: trims.append(1))
    batch = pa.record_batch({"doc_id": pa.array([1, 2, 3]), "text": ["wort " * 220_000] * 3, "hash": pa.array([4, 5, 6]), "train": [True, True, False]})
    rows = [r for b in word_counts._stage(4)(iter([batch, batch])) for r in b.to_pylist()]
    assert sum(r["kind"] == word_counts._DOCS for r in rows) == 6 and len(trims) == 1
    assert len(list(blocks.slices(batch))) == 3 and len(trims) == 4


def plain_score(w, ids):
    """log10 probability of one text by loops over windows, positions and choices, in float64."""
    A = attention_lm
    w, total = {k: v.astype(float) for k, v in w.items()}, 0.0
    for first in range(0, len(ids), A.STRIDE):
        inputs = [ids[i - 1] if 0 < i < len(ids) else A.END for i in range(first - A.BACK, first + A.STRIDE)]
        h = [w["e"][i] + w["p"][k] for k, i in enumerate(inputs)]
        for place, target in enumerate(ids[first : first + A.STRIDE], A.BACK):
            q = h[place] @ w["q"] / A.WIDTH**0.5
            logits = np.array([q @ h[j] for j in range(place + 1)])
            weight = np.exp(logits - logits.max())
            values = [np.append((h[j] @ w["v"])[:-1], 1) for j in range(place + 1)]
            c = sum(a * v for a, v in zip(weight / weight.sum(), values))
            g = np.append(np.tanh(c + h[place - 1] @ w["b"] + h[place])[:-1], 1)
            one, two, three = target // (A.FAN[1] * A.FAN[2]), target // A.FAN[2] % A.FAN[1], target % A.FAN[2]
            for u, pick in ((w["u1"], one), (w["u2"][one], two), (w["u3"][one * A.FAN[1] + two], three)):
                l = g @ u
                total += l[pick] - l.max() - np.log(np.exp(l - l.max()).sum())
    return total / np.log(10)


@pytest.mark.parametrize("larger", [1, 8, 100])
def test_scores_equal_plain_loops(larger):
    """Also where logits are far beyond what exp takes."""
    m = attention_lm.Attention.fresh()
    for k in ("q", "u1", "u2", "u3"):
        m.w[k] = m.w[k] * np.float32(larger)
    r = np.random.default_rng(3)
    texts = [np.append(r.integers(0, attention_lm.SUBWORDS, n), attention_lm.END).astype(np.int32) for n in (0, 1, 19, 20, 47)]
    got = m.score(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert np.isfinite(got).all() and np.allclose(got, [plain_score(m.w, t) for t in texts], rtol=2e-3)


def test_word_ids_are_the_library_s(docs):
    path = default_vocabulary()
    own, library = attention_lm.WordIds(path), Tokenizer.from_file(path)
    texts = ["it's we'll 12ab3 ?! naïve 東京 ñ \u3000x\u00a0", "aaaaabaabcabab" * 40, "w" * 3000, "", None, "\x00\x7f \U0001f600\ufffd"]
    texts += [r.text for r in docs.select("text").collect()]
    ids, sizes = own.streams(pa.array(texts, pa.string()))
    want = [[i for w in words(x) for i in library.encode(" " + w, add_special_tokens=False).ids] for x in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_subwords_spell_words():
    path = default_vocabulary()
    own = attention_lm.WordIds(path)
    texts = ["Thnatble the thnatble xqj", None, "the"]
    ids, sizes = own.streams(pa.array(texts))
    library = Tokenizer.from_file(path)
    tokens = {i: t for t, i in library.get_vocab(with_added_tokens=False).items()}
    for counts in (np.bincount(ids, minlength=len(own.width)), np.zeros(len(own.width), np.int64), np.arange(len(own.width))):
        s = attention_lm.Subwords(path, counts)
        small, n = s.streams(ids, sizes)
        number = {int(s.parts[s.first[i]]): tokens[i] for i in range(len(s.size)) if s.size[i] == 1}
        assert small.max() == attention_lm.END and n[1] == 1 and n.sum() == len(small) and len(number) == attention_lm.SUBWORDS
        spelled = [[number[i] for i in small[b - k : b].tolist() if i != attention_lm.END] for b, k in zip(np.cumsum(n), n)]
        assert ["".join(x) for x in spelled] == ["".join(tokens[i] for i in ids[b - k : b].tolist()) for b, k in zip(np.cumsum(sizes), sizes)]
    once = attention_lm.Subwords(path, np.bincount(ids, minlength=len(own.width)))
    assert (once.size[ids] == 1).all()


def test_scores(docs):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    rows = docs.select("doc_id", "text").collect()
    counts = Counter()
    for r in rows:
        if not held(r.doc_id):
            counts.update([*words(r.text), None])
    n, v = sum(counts.values()), len(counts)
    got: dict = {}
    for r in attention_lm.score_documents(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for r in rows:
        tokens = [*words(r.text), None]
        for g in got[r.doc_id]:
            assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r.doc_id), len(tokens), sum(counts[t] > 0 for t in tokens), n)
            assert g.base_score == pytest.approx(sum(np.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel=1e-9)
            assert g.score < 0 and np.isfinite(g.score)
    out = [g for gs in got.values() for g in gs if g.held_out]
    assert sum(g.score for g in out) / sum(g.n_tokens for g in out) > -5.5


def test_every_training_text_is_learned_from_once(spark):
    texts = [f"wort{i} und noch ein text" for i in range(2000)] + ["die kopie"] * 1000
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("hash", F.xxhash64("text")).withColumn("held_out", F.lit(False))
    encoded, counts = attention_lm.encode(rows, default_vocabulary())
    subwords = attention_lm.Subwords(default_vocabulary(), counts)
    ids, sizes = attention_lm.WordIds(default_vocabulary()).streams(pa.array(texts))
    assert (counts == np.bincount(ids, minlength=len(counts))).all()
    assert attention_lm.fit(encoded, len(texts), subwords).learned == len(subwords.streams(ids, sizes)[0])


def test_a_step_for_every_windows_of_a_batch(monkeypatch):
    monkeypatch.setattr(attention_lm, "CHUNK", 5000)
    sizes = np.array([1, 30, 4000, 20000, 7, 40000])
    ids = np.random.default_rng(1).integers(0, attention_lm.SUBWORDS, int(sizes.sum())).astype(np.int32)
    t = attention_lm.Trainer(attention_lm.Attention.fresh(), len(sizes), 0, fresh=True)
    seen = []
    old = t.model.gradients
    t.model.gradients = lambda x, y: (seen.extend(y[y >= 0].tolist()), old(x, y))[1]
    for a, n in zip(np.cumsum(sizes) - sizes, sizes):
        t.add(ids[a : a + n], np.array([n]))
    t.flush()
    assert sorted(seen) == sorted(ids.tolist()) and t.subwords == len(ids) and t.texts == len(sizes)
    assert t.step >= -(-len(ids) // (attention_lm.STRIDE * attention_lm.MOST_BATCH)) and np.isfinite(t.flat).all()


# --- Jaccard regions


def brute(texts, near=75):
    """Sizes and least reachable ids by comparing all pairs."""
    sets = {}
    for i, t in texts:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= near * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_regions_equal_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    passage = [r.choice(vocabulary) for _ in range(60)]
    for family in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 7, 40, 120]))] + (passage if family % 3 == 0 else [])
        for copy in range(r.choice([1, 2, 8])):
            text = list(base)
            for _ in range(r.choice([0, 1, 2, 5])):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            texts.append(" ".join(text))
    texts += ["", None, " ", "A b c d e", "a B c d E", "a b", "a b"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_regions.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("leaf, levels, pivots", [(4, 6, 4), (4, 1, 4), (16, 6, 16), (8, 6, 0)])
def test_large_regions_equal_brute_force(spark, monkeypatch, leaf, levels, pivots):
    """Split by pivots at several bounds; pairs of blocks where there are no levels or no pivots."""
    monkeypatch.setattr(jaccard_regions, "LEAF", leaf)
    monkeypatch.setattr(jaccard_regions, "LEVELS", levels)
    monkeypatch.setattr(jaccard_regions, "PIVOTS", pivots)
    r = random.Random(1)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for family in range(6):
        base = passage[: 10 * family] + [f"v{r.randrange(1000)}" for _ in range(100 - 10 * family)]
        for _ in range(20):
            text = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                text[r.randrange(100)] = f"n{r.randrange(40)}"
            rows.append((len(rows), " ".join(text)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_regions.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_distances():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 40, 20)).astype(np.uint64) for _ in range(9)]
    n = np.array([len(s) + k % 3 for k, s in enumerate(sets)])
    got = jaccard_regions.distances(n, sets, n[:4], sets[:4])
    for i in range(9):
        for j in range(4):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            assert got[i, j] == pytest.approx(1 - both / (n[i] + n[j] - both))


def test_regions_odd_rows(spark, docs):
    rows = jaccard_regions.join_components(docs.withColumn("n_shingles", F.lit("clash"))).collect()
    assert len(rows) == docs.count()
    by = {x.doc_id: x for x in rows}
    assert by[900].n_shingles == 0 and by[901].component_id == 901 and by[904].component_id == 904
    assert jaccard_regions.join_components(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(50)] + [(100 + i, 100) for i in range(1, 20)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x.node: x.component for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- ordinal regression


def test_ordinal_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = ordinal_quality.graded(spark.read.parquet(f"{folder}/labels.parquet"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = ordinal_quality.fit(docs, labels.where("doc_id % 3 != 0"))
    assert (np.diff(model.thresholds) > 0).all()
    rest = docs.join(labels.where("doc_id % 3 = 0"), "doc_id")
    rows = ordinal_quality.grade(rest, model).collect()
    kept = lambda g: np.mean([r.kept for r in rows if r.grade == g])
    assert kept(2) > 0.95 and kept(0) < 0.25 and kept(1) < 0.4
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_good <= 1 for r in rows)


def test_ordinal_likelihood_falls_along_the_gradient():
    """On two features the fit comes near the best of a grid of weights, and thresholds ascend."""
    r = np.random.default_rng(0)
    grades = r.integers(0, 3, 600)
    feature = np.where(r.random(600) < np.array([0.1, 0.5, 0.9])[grades], 11, 22)
    model = ordinal_quality.OrdinalModel.fit(feature, np.ones(600, np.int64), grades)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def loss(a, b, t):
        s = np.where(feature == 11, a, b)
        edges = np.array([-40, *t, 40.0])
        return -np.log(np.maximum(sig(edges[grades + 1] - s) - sig(edges[grades] - s), 1e-12)).mean()

    best = min(loss(d / 2, -d / 2, (u, u + v)) for d in np.arange(0, 6, 0.25) for u in np.arange(-3, 1, 0.25) for v in np.arange(0.25, 4, 0.25))
    assert model.thresholds[0] < model.thresholds[1]
    assert loss(model.weights[11], model.weights[22], model.thresholds) < best + 0.03
    tails = model.tails(np.array([0.3]))[0]
    assert tails.tolist() == pytest.approx([1 - sig(t - 0.3) for t in model.thresholds])


def test_ordinal_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 0), (3, 0, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in ordinal_quality.graded(labels).collect()} == {1: 1, 3: 1}
    model = ordinal_quality.fit(docs, ordinal_quality.graded(labels))
    assert ordinal_quality.grade(docs.withColumn("kept", F.lit(1)), model).count() == docs.count()
    none = ordinal_quality.fit(docs, ordinal_quality.graded(labels.limit(0)))
    assert ordinal_quality.grade(docs.limit(0), none).count() == 0
