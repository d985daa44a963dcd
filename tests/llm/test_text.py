import hashlib
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patternfold.llm import attention_lm, blocks, content_store, jaccard_regions, licences, ogg, packing, rank_bpe, shared, weak_rules
from patternfold.llm.byte_tokens import ByteTokenizer, default_vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Null, empty, blank, short, odd white space, added tokens, long, repeated.
TEXTS = [None, "", " \n\t ", "one", "Das ist ein Satz.\nDas ist ein Satz.\n", "a  b\t\tc\r\nd", "x y   z\x85q", "a <|endoftext|> b", "<|startoftext|>Hi", "Σίσυφος É é İ", "w " * 4000, "long" * 3000, "one"]


@pytest.fixture()
def docs(spark):
    rows = [(i, t, "en", "src0", 0) for i, t in enumerate(TEXTS)] + [(3, "one", None, None, None), (None, "no id", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture()
def empty(docs):
    return docs.limit(0)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\né中.", max_size=30)), max_size=8))
def test_words_and_windows(texts):
    w = blocks.words(pa.array(texts, pa.string()), lower=True)
    want = [words((t or "").translate(LOWER)) for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    seen = {}
    for h, x in zip(w.hash.tolist(), [y for x in want for y in x]):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    h, counts = blocks.windows(w)
    assert counts.tolist() == [max(1, len(x) - 4) if x else 0 for x in want] and len(h) == counts.sum()


def test_hash_index():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(1, 2**63, 5000, dtype=np.uint64))
    index = blocks.HashIndex(4)
    index.add(keys[:100])
    index.add(keys[100:])
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1)) < 0).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", "'s", " ", "  ", "\n", "\n\n", "\t", ".", "7", "é", "中", " ", " ", "<|endoftext|>", "<|", "\x1c", "don't", "#"]), max_size=20))
def test_byte_encoding_equals_the_library(parts):
    tokenizer = _byte()
    text = "".join(parts)
    ids, counts = tokenizer.encode(pa.array([text, None, "x " + text], pa.string()))
    want = [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", "x " + text)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


_KEPT = []


def _byte():
    if not _KEPT:
        _KEPT.append(ByteTokenizer(default_vocabulary()))
    return _KEPT[0]


def thue_morse(n):
    """A word of two letters, and its complement: polynomial hashes modulo a power of two take them for one."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_of_like_hashes(spark, n):
    one, two = thue_morse(n)
    texts = [one, two, f"x {two} {one}"]
    assert len(set(blocks.words(pa.array(texts[:2])).hash.tolist())) == 2
    ids, _ = _byte().encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in _byte().tokenizer.encode(t, add_special_tokens=False).ids]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, library = _bpe()
    for r in rank_bpe.token_digests(rows, rank_bpe.word_vocabulary()).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, library.encode(texts[r.doc_id], add_special_tokens=False).ids)).encode()).hexdigest()
    assert [r.component_id for r in jaccard_regions.join_components(rows).orderBy("doc_id").collect()] == [0, 1, 2]
    path = shared.fresh(spark, "t")
    content_store.write_store(rows, path)
    for r in content_store.verify(spark, path).collect():
        assert r.verified and r.ids_crc32 == zlib.crc32(np.array(_byte().tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4").tobytes())
    check_packing(rows, packing.pack(rows).collect(), 1024)


def test_caches_survive_colliding_hashes(monkeypatch):
    """With three bits of hash nearly all words meet; bytes decide."""
    old = blocks._piece_hashes
    monkeypatch.setattr(blocks, "_piece_hashes", lambda *a: old(*a) & np.uint64(7))
    texts = ["the quick brown fox jumps over", "lazy dogs and incomprehensibilities incomprehensibilitiez", None, "the lazy the", "w" * 70 + "a " + "w" * 70 + "b"]
    t = ByteTokenizer(default_vocabulary())
    ids, _ = t.encode(pa.array(texts))
    assert ids.tolist() == [i for x in texts for i in t.tokenizer.encode(x or "", add_special_tokens=False).ids]
    own = attention_lm.WordIds(default_vocabulary())
    together = own.streams(pa.array(texts))[0].tolist()
    assert together == [i for x in texts for w in words(x) for i in attention_lm.WordIds(default_vocabulary()).streams(pa.array([w]))[0].tolist()]
    _, library = _bpe()
    rows = rank_bpe._Words(rank_bpe.word_vocabulary()).rows(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), "text")
    assert [r[1] for r in rows] == [hashlib.sha256(" ".join(map(str, library.encode(x or "", add_special_tokens=False).ids)).encode()).hexdigest() for x in texts]


def test_byte_encoding_forgets(monkeypatch):
    monkeypatch.setattr(ByteTokenizer, "MOST", 50)
    t = ByteTokenizer(default_vocabulary())
    for k in range(6):
        texts = [f"word{k}{i} the and {i}" for i in range(30)]
        ids, counts = t.encode(pa.array(texts))
        assert ids.tolist() == [i for x in texts for i in t.tokenizer.encode(x, add_special_tokens=False).ids]


# --- Ogg


def test_ogg_pages():
    assert ogg.page_crc(b"") == 0
    crc = 0
    for b in b"some page":
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    assert ogg.page_crc(b"some page") == crc
    packets = [b"h", b"", b"x" * 255, b"y" * 70000, b"z" * 510]
    data = ogg.mux([(1, packets, [0, 1, 2, 3, 4]), (2, [b"other"], [9])])
    streams, wrong = ogg.demux(data)
    assert not wrong and streams[1].packets == packets and streams[2].packets == [b"other"] and streams[1].granules[-1] == 4 and streams[1].ended
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 255
    assert any("checksum" in w for w in ogg.demux(bytes(bad))[1])
    assert ogg.demux(data[:-3])[1] and ogg.demux(b"junk" + data)[0][2].packets == [b"other"]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_ogg_round_trip(data):
    x = ogg.load(ogg.store(data))
    assert x["payload"] == data + b"\xff" * (-len(data) % 576 if data else 576) and x["n_bytes"] == len(data)


def test_ogg_columns(docs, empty):
    got = {r.doc_id: r for r in ogg.read_column(ogg.media_column(docs.withColumn("media", F.lit(1)).withColumn("feature", F.lit("clash"))).select("doc_id", "text", "media")).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = ogg.payload_of(raw)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert ogg.read_column(ogg.media_column(empty)).count() == 0
    damaged = docs.limit(1).select("doc_id", F.lit(b"OggSx").alias("media"))
    assert ogg.read_column(damaged).collect()[0].errors


def test_damaged_media(spark, docs):
    """Media with right checksums but missing parts, and all single-byte damage, give errors and never raise."""
    text = b"some text" * 100
    good = ogg.store(text)
    serial = zlib.crc32(ogg.payload_of(text))
    head = b"\x7fPCM8" + (8000).to_bytes(4, "little") + (576).to_bytes(2, "little")
    audio, size = (serial, [head, ogg.payload_of(text)], [0, 1]), (1, [b"\x7fSIZE", len(text).to_bytes(8, "little")], [0, 1])
    bad = [
        b"", b"OggS", good[:100], ogg.mux([audio]), ogg.mux([audio, (1, [b"\x7fSIZE"], [0])]), ogg.mux([(serial, [head], [0]), size]), ogg.mux([(serial, [head[:7], b"x"], [0, 1]), size]),
        ogg.mux([(serial, [head[:5] + bytes(6), b"x"], [0, 1]), size]), ogg.mux([audio, (1, [b"\x7fSIZE", b"123"], [0, 1])]), ogg.mux([audio, (1, [b"\x7fSIZE", b"\xff" * 8], [0, 1])]), ogg.mux([]),
        *(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :] for i in range(0, len(good), 37)),
    ]
    for media in bad:
        x = ogg.load(media)
        assert x["errors"] and x["payload"] is None
    rows = spark.createDataFrame([(i, m) for i, m in enumerate([*bad[:11], None, good])], "doc_id long, media binary")
    got = {r.doc_id: r for r in ogg.read_column(rows).collect()}
    assert len(got) == 13 and all(got[i].errors and got[i].payload_sha256 is None for i in range(12)) and got[12].errors == "" and got[12].n_bytes == len(text)


def test_stored_form(docs):
    got = {r.doc_id: r for r in ogg.read_column(ogg.media_column(docs.select("doc_id", "text"))).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        media, payload = ogg.store(raw), ogg.payload_of(raw)
        assert (got[i].media_bytes, got[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        streams, _ = ogg.demux(media)
        frames = len(payload) // 576
        assert got[i].seconds == pytest.approx(len(payload) / 8000) and f"packets={frames + 3};" in got[i].feature
        sound = next(s for s in streams.values() if len(s.packets) == frames + 1 and s.packets[0][1:5] == b"PCM8")
        ends = [g for g in sound.granules if g > 0]
        assert ends == sorted(ends) and ends[-1] == len(payload) and f"low={min(payload)};high={max(payload)};mean={sum(payload) / len(payload):.6f}" in got[i].feature


# --- content store


def _without(spark, path, kind, condition):
    """Rewrites a table of the store without some rows."""
    rows = spark.read.parquet(f"{path}/{kind}").where(f"not coalesce({condition}, false)").collect()
    schema = spark.read.parquet(f"{path}/{kind}").schema
    shared.remove(spark, f"{path}/{kind}")
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{kind}")


def test_store_shows_what_is_lost(spark, docs):
    whole = shared.fresh(spark, "t")
    content_store.write_store(docs, whole)
    copy = lambda: (p := shared.fresh(spark, "t"), shutil.copytree(whole, p))[0]
    verified = lambda p: {r.doc_id: r.verified for r in content_store.verify(spark, p).collect() if r.doc_id != 3}
    n = len(verified(whole))
    lost = copy()
    _without(spark, lost, "kind=recipe", "doc_id = 4")
    got = verified(lost)
    assert len(got) == n and [d for d, v in got.items() if not v] == [4]
    chunk = spark.read.parquet(f"{whole}/kind=recipe").where("doc_id = 10").first().digests[:16]
    gone = copy()
    _without(spark, gone, "kind=chunk", f"digest = X'{bytes(chunk).hex()}'")
    assert [d for d, v in verified(gone).items() if not v] == [10]
    assert content_store.reconstruct(spark, gone, [10]).first().ids is None
    short = copy()
    _without(spark, short, "ordered", "doc_id = 4")
    part = {r.part for r in spark.read.parquet(f"{whole}/ordered").where("doc_id = 4").collect()}
    others = {r.doc_id for r in spark.read.parquet(f"{whole}/ordered").collect() if r.part in part}
    got = verified(short)
    assert len(got) == n - 1 and all(got[d] == (d not in others) for d in got)
    none = copy()
    _without(spark, none, "manifest", "part = -1")
    assert not any(verified(none).values())


def test_wide_ids(spark, monkeypatch):
    """Ids of 4 bytes, as for a vocabulary over 65,536."""
    monkeypatch.setattr(_byte(), "id_bytes", 4)
    ids = np.array([70000, 1, 2**31 - 1, 2], np.uint32)
    part = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["x"])], ["doc_id", "text"])
    recipe, chunk = content_store._rows(part, ids[:-1], np.array([3]), 2, 4)
    assert np.frombuffer(chunk.column("ids")[0].as_py(), "<u4").tolist() == ids.tolist()
    facts = next(content_store._chunk_facts(4)(iter([pa.RecordBatch.from_arrays([chunk.column("digest"), chunk.column("ids")], ["digest", "ids"])])))
    assert facts.column("crc")[0].as_py() == zlib.crc32(ids.astype("<u4").tobytes()) and facts.column("good")[0].as_py()


def test_store(spark, docs, empty):
    path = shared.fresh(spark, "t")
    content_store.write_store(docs, path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.verified) for r in content_store.verify(spark, path).collect())
    t = _byte().tokenizer
    rows = sorted(((i, x) for i, x in [*enumerate(TEXTS), (3, "one")]), key=lambda r: r[0])
    assert len(got) == len(rows) + 1 and all(g[4] for g in got) and got[0][1] is None
    start = got[0][2]
    for (at, doc, n, crc, _), (i, x) in zip(got[1:], rows):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert (at, doc, n, crc) == (start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    back = {r.doc_id: r.ids for r in content_store.reconstruct(spark, path, [4, 10]).collect()}
    assert back[4] == t.encode(TEXTS[4], add_special_tokens=False).ids + [2] and len(back[10]) > 4000
    assert content_store.part_roots(spark, path).agg(F.sum("documents")).collect()[0][0] == len(got)
    chunks = spark.read.parquet(f"{path}/kind=chunk")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_cuts_are_of_the_content():
    r = np.random.default_rng(1)
    body = r.integers(0, 50000, 3000).astype(np.uint16)
    a, b = np.concatenate([r.integers(0, 50000, 70).astype(np.uint16), body]), body
    chunks = lambda ids: [ids[s:e].tobytes() for s, e in zip([0, *content_store.cut_points(ids, np.array([len(ids)]))[0]], content_store.cut_points(ids, np.array([len(ids)]))[0])]
    assert len(set(chunks(a)) & set(chunks(b))) > 0.8 * len(chunks(b)) and b"".join(chunks(a)) == a.tobytes()
    assert max(len(c) for c in chunks(np.zeros(5000, np.uint16))) <= 2 * content_store.MOST


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=20), st.lists(st.integers(0, 70000), min_size=1, max_size=20))
def test_crc_join(a, b):
    raw = lambda x: np.array(x, "<u4").tobytes()
    one, two = (np.array([zlib.crc32(raw(x))], np.uint32) for x in (a, b))
    assert int(content_store.crc_join(one, two, np.array([len(b)]))[0]) == zlib.crc32(raw(a) + raw(b))


def test_merkle():
    for n in range(18):
        leaves = [bytes([i]) for i in range(n)]
        stream = content_store.MerkleStream()
        for leaf in leaves:
            stream.add(leaf)
        assert stream.root() == content_store.merkle_root(leaves)
    assert content_store.merkle_root([b"a"]) == b"a" and content_store.merkle_root([b"a", b"b"]) != content_store.merkle_root([b"b", b"a"])


# --- BPE


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", "'s", " ", "\n", ".", "42", "é", "é", "中", " ", "<|endoftext|>", "Σ", "İ", "don't", "#", "ing", "😀"]), max_size=20))
def test_rank_bpe_equals_the_library(parts):
    bpe, library = _bpe()
    text = "".join(parts)
    want = library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == want and bpe.decode(want) == library.decode(want, skip_special_tokens=False)


_BPE = []


def _bpe():
    if not _BPE:
        from tokenizers import Tokenizer

        _BPE.extend([rank_bpe.RankBpe(rank_bpe.word_vocabulary()), Tokenizer.from_file(rank_bpe.word_vocabulary())])
    return _BPE


def test_long_words():
    bpe, library = _bpe()
    for text in ("ab" * 2000, "thequickbrown" * 200, "z" * 1025):
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert bpe.text(bpe.encode("Hello wörld 12")) == "hello wörld 1 2"


def test_digests(docs, empty):
    _, library = _bpe()
    got = [r for r in rank_bpe.token_digests(docs, rank_bpe.word_vocabulary()).collect()]
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is not None:
            ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert rank_bpe.token_digests(empty, rank_bpe.word_vocabulary()).count() == 0
    assert rank_bpe.encode_column(docs.withColumn("ids", F.lit(1)), rank_bpe.word_vocabulary()).where("doc_id = 1").collect()[0].ids == []


# --- packing


def check_packing(docs, rows, window):
    by: dict = {}
    for r in docs.collect():
        by.setdefault(r.doc_id, []).append(_byte().tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0])
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= window
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc, lists in by.items():
        if len(lists) == 1:
            at = 0
            for r in sorted(pieces[doc], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(lists[0]) and r.ids_crc32 == zlib.crc32(np.array(lists[0][at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(lists[0])
        else:
            assert sum(r.length for r in pieces[doc]) == sum(map(len, lists))
    return [sum(n for _, n in s) for s in sequences.values()]


def test_packing(spark, docs, empty, small):
    check_packing(docs, packing.pack(docs).collect(), 1024)
    real = spark.read.parquet(f"{small}/documents.parquet")
    sizes = check_packing(real, packing.pack(real).collect(), 1024)
    assert sum(1024 - n for n in sizes if n & n - 1) < 2048
    assert packing.pack(empty).count() == 0


class Corpus:
    """Statistics of a few texts, counted exactly."""

    def __init__(self, terms, words):
        self.documents, self.mean = len(terms), max(words.mean(), 1.0)
        self.df = Counter(t for own in terms for t in own.tolist())

    def idf(self, terms):
        df = np.array([self.df[t] for t in terms.tolist()], float)
        return np.log1p((self.documents - df + 0.5) / (df + 0.5)).clip(0)


def some_texts(n, seed=2):
    r = np.random.default_rng(seed)
    terms = [np.unique(r.integers(0, 60, 20)).astype(np.uint64) for _ in range(n)]
    tfs = [r.integers(1, 4, len(t)).astype(np.uint32) for t in terms]
    return terms, tfs, np.array([t.sum() for t in tfs], float)


def bm25(corpus, terms, tfs, words, i, j):
    idf = dict(zip(terms[j].tolist(), corpus.idf(terms[j])))
    return sum(idf[t] * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * words[j] / corpus.mean)) for t, f in zip(terms[j].tolist(), tfs[j].astype(float)) if t in terms[i])


def test_neighbours_are_the_best():
    terms, tfs, words_ = some_texts(30)
    corpus = Corpus(terms, words_)
    shard = packing.Shard(terms, tfs, words_, corpus)
    for i in range(30):
        assert np.allclose(shard.scores(i), [bm25(corpus, terms, tfs, words_, i, j) for j in range(30)], atol=1e-4)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fill_is_greedy(monkeypatch, seed):
    """Window by window as a plain loop does it: the seed, then its unused neighbours in order, the first too large one cut last. Every other text is a copy, so there are ties."""
    monkeypatch.setattr(packing, "NEIGHBOURS", 5)
    terms, tfs, words_ = (x for x in some_texts(20, seed))
    terms, tfs, words_ = terms + terms, tfs + tfs, np.concatenate([words_, words_])
    corpus = Corpus(terms, words_)
    left = np.random.default_rng(seed).integers(1, 60, 40)
    own = left.copy()
    want = []
    while own.any():
        first = int(np.flatnonzero(own)[0])
        taken, room = [(first, int(own[first]))], 64 - int(own[first])
        own[first] = 0
        rest = sorted(np.flatnonzero(own).tolist(), key=lambda d: (-round(bm25(corpus, terms, tfs, words_, first, d), 5), d))
        cut, k = None, 5
        while room and rest:
            for d in rest[:k]:
                if room and own[d] and own[d] <= room:
                    taken.append((d, int(own[d])))
                    room -= int(own[d])
                    own[d] = 0
                elif own[d] and cut is None and room:
                    cut = d
            if room and cut is not None:
                taken.append((cut, room))
                own[cut] -= room
                room = 0
            if k >= len(rest):
                break
            k *= 4
        want.append(taken)
    got = list(packing.fill(packing.Shard(terms, tfs, words_, corpus), left, 64))
    assert not left.any() and sum(len(w) for w in got) >= 40
    assert all(sum(n for _, n in w) <= 64 for w in got) and all(sum(n for _, n in w) == 64 for w in got[:-1])
    assert [w[0][0] for w in got] == [w[0][0] for w in want] and got[0] == want[0]


def test_sketch_is_never_below(spark):
    texts = [f"wort{i} und wort{i % 7}" for i in range(300)]
    sums = np.zeros((packing.SKETCH << packing.SKETCH_BITS) + 2, np.int64)
    part = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["doc_id", "text"])
    packing._stage_rows(part, _byte().encode_pieces(part.column("text")), 1024, 0, sums)
    s = packing.Statistics(sums)
    true = Counter(w for t in texts for w in set(t.split()))
    got = s.frequency(blocks.words(pa.array(list(true))).hash)
    assert s.documents == 300 and (got >= list(true.values())).all() and (got == list(true.values())).mean() > 0.99


def test_tails_are_routed_once(spark, small, monkeypatch):
    """Shards' borders come from some of the tails' keys: all tails go through _route a single time."""
    monkeypatch.setattr(packing, "SHARD_ROWS", 64)
    seen, route = spark.sparkContext.accumulator(0), packing._route

    def counting(*args):
        run = route(*args)

        def counted(batches):
            def each():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            return run(each())

        return counted

    monkeypatch.setattr(packing, "_route", counting)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs).collect()
    check_packing(docs, rows, 1024)
    tokens = {(r.doc_id, r.doc_tokens) for r in rows}
    assert len(tokens) > 128 and seen.value == sum(n % 1024 != 0 for _, n in tokens)
    shards = {r.sequence_id >> 33 for r in rows if r.sequence_id & 1}
    assert 2 < len(shards) <= -(-len(tokens) // 64)


class Held:
    def __init__(self, value):
        self.value = value


def test_routes_and_borders():
    r = np.random.default_rng(4)
    terms = [np.unique(r.integers(1, 40, 6)).astype(np.uint64) << np.uint64(1) for _ in range(300)] + [np.zeros(0, np.uint64), np.array([2**40], np.uint64)]
    tfs = [r.integers(1, 3, len(t)).astype(np.uint32) for t in terms]
    words_ = np.array([t.sum() for t in tfs], np.int64)
    corpus = Corpus(terms, words_)
    corpus.frequency = lambda t: np.array([corpus.df[x] for x in t.tolist()], np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in terms]), pa.array([t.tobytes() for t in tfs]), pa.array(words_), pa.array(range(302), pa.int64())], ["terms", "tfs", "words", "row"])
    route, second = packing._routes(batch, corpus)
    for i, (own, f) in enumerate(zip(terms, tfs)):
        weight = packing._weights(f.astype(float), np.full(len(f), words_[i]), corpus.idf(own), corpus.mean)
        best = [t >> 1 for _, t in sorted((-w, t) for w, t in zip(weight.tolist(), own.tolist()) if corpus.df[t] > 1)]
        assert [route[i], second[i]] == (best + [0, 0])[:2]
    keys = packing._keyed(route, second, np.arange(302))
    out = next(packing._route(Held(corpus), Held(packing._borders(keys, 5)))([batch]))
    shard = out.column("shard").to_numpy()[np.argsort(keys, order=["route", "second", "row"])]
    assert (np.diff(shard) >= 0).all() and np.bincount(shard).tolist() == [60, 60, 61, 60, 61]
    assert not len(packing._borders(keys[:0], 5)) and len(packing._borders(keys[:2], 5)) == 2


# --- native operators


def test_counts_of_texts(docs, empty):
    got = {r.doc_id: r for r in weak_rules.judge(docs.withColumn("words", F.lit(1))).collect() if r.doc_id is not None}
    for i, t in enumerate(TEXTS):
        w = words(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else set(grams)
        covered = {k + j for k, g in enumerate(grams) if g in twice for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered)), i
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert weak_rules.judge(empty).count() == 0


def test_posterior_equals_plain_em(spark, docs, small):
    """The model and every posterior by a loop over documents, from the votes."""
    names = [n for n, _, _ in weak_rules.RULES]
    d = docs.unionByName(spark.read.parquet(f"{small}/documents.parquet"))
    rows = [r.asDict() for r in weak_rules.judge(d).collect()]
    prior, rules = 0.85, {n: (0.02, 0.5) for n in names}
    logit = lambda p: np.log(p / (1 - p))
    clip = lambda x, b: min(max(x, b[0]), b[1])

    def good(r):
        odds = logit(prior)
        for n, (g, b) in rules.items():
            v = r[f"vote_{n}"]
            odds += np.log(g / b) if v == -1 else np.log((1 - g) / (1 - b)) if v == 1 else 0
        return 1 / (1 + np.exp(-odds))

    for _ in range(weak_rules.ITERATIONS):
        p = [good(r) for r in rows]
        old = [logit(x) for x in (prior, *(y for x in rules.values() for y in x))]
        new = {}
        for n in names:
            s = {(k, c): sum(x if c else 1 - x for x, r in zip(p, rows) if r[f"vote_{n}"] == -1 or (k and r[f"vote_{n}"])) for k in (0, 1) for c in (0, 1)}
            new[n] = (clip((s[0, 1] + 0.1) / (s[1, 1] + 5), weak_rules.BAD_IF_GOOD), clip((s[0, 0] + 2) / (s[1, 0] + 4), weak_rules.BAD_IF_BAD))
        prior, rules = clip((sum(p) + 1) / (len(p) + 2), (0.05, 0.98)), new
        if max(abs(a - logit(b)) for a, b in zip(old, (prior, *(y for x in rules.values() for y in x)))) < weak_rules.SETTLED:
            break
    for r in rows:
        assert r["quality"] == pytest.approx(good(r), abs=1e-6) and r["kept"] == (not r["base_failed"] and good(r) >= 0.5)
    symbols = Counter((r.doc_id, len(re.findall(r"[#*$%&|<>]", r.text or ""))) for r in d.collect())
    assert symbols == Counter((r["doc_id"], r["n_symbols"]) for r in rows)


def test_rules_learn_labels(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    rows = weak_rules.judge(d).select("doc_id", "kept", "base_failed").join(d.select("doc_id", "quality"), "doc_id").collect()
    right = [r.kept == bool(r.quality) for r in rows if not r.base_failed]
    assert sum(right) >= 0.95 * len(right)


def test_licences(spark, docs, empty):
    texts = [(0, "Prose of no use here.\nReleased under the MIT License.\nMore prose."), (1, licences.TEMPLATES["GPL-3.0"][1].upper()), (2, "a license"), (3, None), (4, "x\n\nLicensed under CC BY-NC 4.0.\n")]
    got = {r.doc_id: (r.licence, r.dice, r.n_units) for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[0] == ("MIT", 1.0, 1) and got[1][:2] == ("GPL-3.0", 1.0) and got[2] == (None, 0.0, 0) and got[3] == (None, 0.0, 0) and got[4][0] == "CC-BY-NC-4.0"
    assert licences.scan(docs).count() == len(TEXTS) + 2 and licences.scan(empty).count() == 0


def test_native_plans(docs):
    for df in (licences.scan(docs), weak_rules.text_counts(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
