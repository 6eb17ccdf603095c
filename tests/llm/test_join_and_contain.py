import random

import numpy as np
from wordloom.llm import ngram_join as N
from wordloom.llm.decontaminate import contained_items, decontaminated
from wordloom.llm.words import U64

from .fixtures import documents, empty, shingle_set, tokens, words


def brute_components(rows, k, threshold):
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None) if sets[i] else doc))
    return sorted(out, key=repr)


def found_components(docs, k, threshold):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.ngram_jaccard_join(docs, k, threshold).collect()), key=repr)


def test_join_equals_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, threshold in ((3, 90), (5, 80)):
        assert found_components(docs, k, threshold) == brute_components(rows, k, threshold)


def test_join_of_nothing(spark):
    assert found_components(empty(spark), 3, 90) == []


def test_large_family_in_many_trees(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAVES", 8)
    rng = random.Random(1)
    base = words(rng, 120)
    rows = []
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 8])):
            copy[k] = f"x{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_components(docs, 3, 90) == brute_components(rows, 3, 90)


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    for threshold in (80, 90):
        for n in (1, 4, 5, 9, 10, 19, 40, 100, 333, 1000):
            a = rng.permutation(10 * n + 20)[:n]
            for _ in range(20):
                drop, add = rng.integers(0, (100 - threshold) * n // 100 + 1), rng.integers(0, max(1, (100 - threshold) * n // 100))
                b = np.unique(np.append(rng.permutation(a)[drop:], 10 * n + 20 + rng.integers(0, 99, add)))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= threshold * (len(a) + len(b) - both):
                    first = [np.sort(x)[: N.prefix_lengths(np.array([len(x)]), threshold)[0]] for x in (a, b)]
                    assert len(np.intersect1d(*first))


def with_passage(spark, n):
    """n texts without links that share a passage and lines, in pairs and all of them."""
    rng = random.Random(n)
    passage = words(rng, 60)
    lines = [words(rng, 12) for _ in range(20)]
    rows = [(i, " ".join(words(rng, 30, "klmnopqrstuvwxyz") + passage + rng.choice(lines) + words(rng, 30, "klmnopqrstuvwxyz"))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_work_grows_with_the_texts(spark, monkeypatch):
    """Sets that trees are made of, copies included: twice the texts make twice the sets at most, plus nothing for a common passage."""
    monkeypatch.setattr(N, "LEAVES", 32)
    made, trees = [], N._trees
    monkeypatch.setattr(N, "_trees", lambda rows, threshold: made.append(rows.count()) or trees(rows, threshold))
    found = {}
    for n in (500, 1000):
        made.clear()
        assert all(r.doc_id == r.component_id for r in N.ngram_jaccard_join(with_passage(spark, n), 5, 80).collect())
        found[n] = sum(made)
    assert found[1000] <= max(2 * found[500], 100)


def test_work_grows_with_texts_whose_shingles_recur(spark, monkeypatch):
    """Texts of 100 of 25 words share prefix shingles with many others, so a family is the table: twice the texts make about twice the sets in trees."""
    monkeypatch.setattr(N, "FEW", 1)  # no pairs, so that all sets are counted
    monkeypatch.setattr(N, "LEAVES", 64)
    made, trees = [], N._trees
    monkeypatch.setattr(N, "_trees", lambda rows, threshold: made.append(rows.count()) or trees(rows, threshold))
    rng = random.Random(7)
    vocabulary = words(rng, 25)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(100)) for _ in range(3000)]
    texts[700], texts[2900] = texts[5] + " more", texts[5]
    found = {}
    for n in (1500, 3000):
        made.clear()
        rows = N.ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string"), 3, 90).collect()
        assert {r.doc_id: r.component_id for r in rows if r.doc_id != r.component_id} == {k: 5 for k in (700, 2900) if k < n}
        found[n] = sum(made)
    assert made and found[3000] <= 2.2 * found[1500] <= 2.2 * 16 * 1500


def test_join_of_a_driver_table(spark):
    """Against brute force on all pairs: recall and precision 1."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for k, threshold in ((3, 90), (5, 80)):
        assert found_components(docs.repartition(5), k, threshold) == brute_components(rows, k, threshold)


def test_tree_prunes_no_link():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 300).astype(U64))
    sets = [np.unique(np.append(rng.permutation(base)[k:], rng.integers(0, 2**63, k).astype(U64))) for k in range(0, 60, 2)]
    sets += [np.unique(rng.integers(0, 2**63, n).astype(U64)) for n in (5, 50, 290, 310, 3000)]
    sets.sort(key=len)
    i, j = N.SignatureTree(sets).leaf_pairs(80)
    seen = set(zip(i.tolist(), j.tolist()))
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in seen
    assert len(seen) < len(sets) * (len(sets) - 1) / 2


def brute_contained(docs, items):
    out = []
    for doc, text in docs:
        for item, t in items:
            k = min(len(tokens(t)), 5)
            own, q = shingle_set(text, k or 5), shingle_set(t, 5)
            if q and 100 * len(q & own) >= 80 * len(q):
                out.append((doc, item, len(q), len(q & own)))
    return sorted(out, key=repr)


def with_items(spark):
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate((5, 6, 12, 14, 30, 59, 200))] + [(90, None), (91, ""), (92, "one two"), (None, " ".join(words(rng, 20)))]
    long = words(rng, 5000)
    items += [(94, long[70]), (95, " ".join(long[2498:2500])), (96, "qq\tid  AT"), (97, " ".join(long[20:24])), (98, "absent words here now")]
    extra = [(900, "so qq id at", "aa"), (901, "qq id", "aa"), (902, "at", None)]
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        extra.append((600 + k, " ".join(long[:2500] + w + long[2500:]), "aa"))
        extra.append((700 + k, " ".join(long[:100] + [x.upper() for x in w[: -max(1, len(w) // 8)]] + long[100:200]), "aa"))
        extra.append((800 + k, " ".join(long[:50] + w[: len(w) // 2] + long[50:90]), "aa"))
    return documents(spark, extra), spark.createDataFrame(items, "item_id long, text string")


def test_containment_equals_brute_force(spark):
    docs, items = with_items(spark)
    expected = brute_contained([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    found = sorted((tuple(r) for r in contained_items(docs, items).collect()), key=repr)
    assert found == expected and len(found) > 10
    hit = {d for d, *_ in expected}
    left = [r.doc_id for r in decontaminated(docs, items).collect()]
    assert sorted(map(repr, left)) == sorted(repr(r.doc_id) for r in docs.collect() if r.doc_id not in hit)


def test_containment_of_nothing(spark):
    docs, items = with_items(spark)
    assert contained_items(empty(spark), items).count() == 0
    assert contained_items(docs, items.limit(0)).count() == 0
    assert decontaminated(docs, items.limit(0)).count() == docs.count()


def test_items_in_blocks(spark, monkeypatch):
    from wordloom.llm import decontaminate

    docs, items = with_items(spark)
    whole = sorted(map(repr, contained_items(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    assert sorted(map(repr, contained_items(docs, items).collect())) == whole


def test_words_are_those_of_the_contract():
    assert tokens("A\x0bb\x0c É\xa0x\r\n z") == [b"a", b"b", "É\xa0x".encode(), b"z"]
