"""Operators 11 to 13 against tiktoken and plain loops."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from wordloom.llm import byte_bpe as B
from wordloom.llm import queries as Q
from wordloom.llm.importance import resampled
from wordloom.llm.prefix_trie import SlotTable, accumulate, distinct, prefix_trie

from .fixtures import documents, empty

DIR = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")
PIECES = ["'", "'s", "'re", "'v", "'ll", "l", "e", "r", "s", " ", "  ", "\n", "\t", " ", "　", " ", "1", "٣", "é", "ß", "漢", "😀", "!", "_", "\x00", "\x1c", "A", "ve", "d", "m", "'LL", "ab", "́", "ᲊ"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return B.Vocabulary(f.read())


@pytest.fixture(scope="module")
def peer(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 20])
def test_any_text_at_any_window(vocabulary, peer, monkeypatch, window):
    monkeypatch.setattr(B, "WINDOW", window)
    rng = random.Random(window)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + [None, "", "a" * 400, "'" * 300, "\n" * 200, "ab" * 300]
    ids, ends = B.encode_texts(pa.array(texts), vocabulary, B.codepoint_classes())
    assert ids.to_pylist() == [peer.encode_ordinary(t or "") for t in texts]
    assert B.decode_tokens(ids, ends, vocabulary).to_pylist() == [(t or "").encode() for t in texts]


def test_very_long_pieces(vocabulary, peer):
    texts = ["a" * 20_000, "'" * 5_000, "é" * 7_000, "\n" * 3_000, "abc" * 9_000, "x" + " " * 4_000]
    assert B.encode_texts(pa.array(texts), vocabulary, B.codepoint_classes())[0].to_pylist() == [peer.encode_ordinary(t) for t in texts]


def test_forgotten_pieces_are_merged_again(vocabulary, peer, monkeypatch):
    monkeypatch.setattr(B, "PIECES", 3)
    for text in ("some words here, some words there", "some words here"):
        assert B.encode_texts(pa.array([text]), vocabulary, B.codepoint_classes())[0].to_pylist() == [peer.encode_ordinary(text)]


def test_offsets_must_fit(vocabulary):
    ids, ends = B.encode_texts(pa.array(["one two"]), vocabulary, B.codepoint_classes())
    with pytest.raises(ValueError, match="belong"):
        B.decode_tokens(ids, pa.array([[1] * len(ids[0])], pa.list_(pa.int32())), vocabulary)


def test_tables_of_texts(spark, peer):
    docs = documents(spark)
    tokens = B.encoded(docs, keep=("doc_id", "text", "h", "size"))
    rows = B.decoded(tokens, keep=("doc_id", "text", "ids", "ends")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == peer.encode_ordinary(r.text or "") and bytes(r.data) == (r.text or "").encode() and (not r.ids or r.ends[-1] == len(r.data))
    assert B.decoded(B.encoded(empty(spark))).collect() == []
    with pytest.raises(ValueError, match="twice"):
        B.encoded(docs.withColumnRenamed("h", "ids"), keep=("ids",))


def test_registered_encoding(spark, peer):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    found = {r.doc_id: r for r in Q.queries()["op11_byte_bpe"](spark, DIR).collect()}
    assert len(found) == len(docs)
    for r in docs:
        ids = peer.encode_ordinary(r.text or "")
        expected = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()
        assert tuple(found[r.doc_id])[1:] == expected


def feature_words(text):
    low = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    return bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else 32 for b in low).split()


def brute_resampled(docs, target, n, buckets, percent, least):
    def counts(text):
        w = feature_words(text)
        return Counter(zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1))

    own, corpus, wanted = [counts(t) for _, t in docs], Counter(), Counter()
    for c in own:
        corpus.update(c)
    for t in target:
        wanted.update(counts(t))
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((corpus[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for (i, text), c in zip(docs, own):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        out.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(feature_words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize(("n", "percent"), [(1, 10), (3, 35), (2, 100)])
def test_resampling(spark, n, percent):
    lines = [(600 + i, t) for i, t in enumerate(["one\ntwo\n\nthree", "one two\nthree\nfour five six\n" * 4, "\n\n", "ÄÖ é1\x0bB-b\nB", "x\n" * 40])]
    docs = documents(spark, extra=[(i, t, "aa") for i, t in lines])
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    target = ["abc de one two", "three\nfour B", None, rows[2][1]]
    found = resampled(docs, spark.createDataFrame([(t, "clash") for t in target], "text string, doc_id string"), n=n, buckets=97, percent=percent, least_words=5)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_resampled(rows, target, n, 97, percent, 5)


def test_resampling_of_nothing(spark):
    none = empty(spark)
    assert resampled(none, documents(spark)).collect() == []
    rows = resampled(documents(spark), none).collect()
    assert len(rows) == documents(spark).count() and sum(r.rank is not None for r in rows) == sum(r.n_words >= 20 for r in rows) // 10


def test_slots(monkeypatch):
    rng = np.random.default_rng(3)
    key = distinct(*(np.concatenate([c, c[:50]]) for c in (rng.integers(0, 9, 5000), rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64))))
    table = SlotTable(*key)
    assert sorted(table.slots(*key)) == list(range(len(key[0]))) == list(range(5000))
    assert (table.slots(key[0], key[1], key[2] + np.uint64(1)) == -1).all()
    monkeypatch.setattr(SlotTable, "_hash", staticmethod(lambda d, p0, p1: p0 % np.uint64(40)))  # most keys share a hash
    few = [c[:300] for c in key]
    table = SlotTable(*few)
    assert sorted(table.slots(*few)) == list(range(300))
    assert (table.slots(few[0] + 100, few[1], few[2]) == -1).all()


def test_sums_go_up():
    depth = np.array([0, 1, 1, 2, 3])
    key = (depth, np.arange(5).astype(np.uint64), np.zeros(5, np.uint64))
    table = SlotTable(*key)
    slot = table.slots(*key)
    parent, count = np.full(5, -1), np.zeros(5, np.int64)
    parent[slot[1:]] = slot[[0, 0, 1, 3]]
    count[slot] = [1, 10, 100, 1000, 10_000]
    accumulate(table, parent, count)
    assert count[slot].tolist() == [11_111, 11_010, 100, 11_000, 10_000]


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members = defaultdict(list)
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    leaves, saved, children = Counter(), Counter(), Counter(k[:-1] for k in members if k)
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1].encode().split()) if k else 0
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(whole[c]) == len(k)).encode()).hexdigest()
    return sorted(repr((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children[k], leaves[k], saved[k], sha(k))) for k, cs in members.items())


@pytest.mark.parametrize("segment", [2, 5, 1 << 16])
def test_trie(spark, segment):
    rng = random.Random(9)
    rows = []
    for c in [*range(-25, 90), 2**40, 2**40 + 1]:
        shared = rng.choice(["a", "b"])
        rows += [(c, k, rng.choice(["u", "v", None]), rng.choice([shared, "x y", None, "long words here"])) for k in range(rng.randint(1, 7))]
    rows += [(c, k, "u", f"same {k}") for c in (200, 201, 202, 217) for k in range(23)]  # long, and equal but for borrowed turns
    rows += [(7, None, "u", "first"), (7, None, "u", "first"), (8, 2, "u", "tie"), (8, 2, "t", "tie"), (None, 1, "u", "nobody's"), (300, 0, "", "")]
    table = spark.createDataFrame([(*r, 1, "p", 5) for r in rows], "conv_id long, turn long, role string, text string, n int, p0 string, depth int")
    found = sorted(repr(tuple(r)) for r in prefix_trie(table, segment=segment).collect())
    assert found == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


