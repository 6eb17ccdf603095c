import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from wordloom.llm import kneser_ney as K
from wordloom.llm import pitman_yor as P
from wordloom.llm import token_blocks as B
from wordloom.llm.language_id import identify_languages, in_training, infer, language_model, trigrams
from wordloom.llm.mixing import capped_targets, mixed, multipliers

from .fixtures import documents, empty, tokens


def held(doc, m, k):
    return doc is not None and zlib.crc32(str(doc).encode()) % m == k


# language


def test_languages(spark):
    docs = documents(spark, [(900, " ".join(["abad cafe bead faded"] * 30 + ["vzyx wuwu xyzm kilt"] * 20), None)])
    found = identify_languages(docs, docs.where(in_training(F.col("doc_id"))), keep=("doc_id", "lang", "text")).collect()
    assert len(found) == docs.count()
    for r in found:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.languages, r.fit) == ("und", 0.0, [], None)
        else:
            assert r.lang_pred in ("aa", "zz") and 0 < r.score <= 1 and math.isclose(sum(r.shares), 1)
    long = [r for r in found if r.text and len(r.text) > 60 and r.lang]
    assert all(r.lang_pred == r.lang for r in long)
    both = next(r for r in found if r.doc_id == 900)
    assert both.languages == ["aa", "zz"] and 0.5 < both.score < 0.8


def test_languages_without_labels(spark):
    docs = documents(spark)
    assert {r.lang_pred for r in identify_languages(docs, docs.where("lang = 'none'")).collect()} == {"und"}
    assert identify_languages(empty(spark), docs).count() == 0
    assert language_model(empty(spark))[0] == []


def test_mixture_maximises_likelihood():
    rng = np.random.default_rng(1)
    model = rng.dirichlet(np.full(1 << 16, 0.05), 2).T + 1e-9
    grams = np.concatenate([rng.choice(1 << 16, 3000, p=model[:, k] / model[:, k].sum()) for k in (0, 0, 1)])
    best, share, _ = infer(grams, model)
    assert best.tolist() == [0, 1] and abs(share[0] - 2 / 3) < 0.02
    like = lambda s: np.log(model[grams] @ [s, 1 - s]).sum()
    assert like(share[0]) >= max(like(s) for s in np.linspace(0.01, 0.99, 99)) - 0.5
    assert len(trigrams(np.zeros(0, np.uint8))) == 0


def test_shares_and_sets_equal_brute_force():
    """Of documents of one, two and three of four languages: the set by penalised likelihood over all sets, and shares by steps on the simplex."""
    from itertools import combinations

    from wordloom.llm import language_id as L

    rng = np.random.default_rng(4)
    model = rng.dirichlet(np.full(1 << 16, 0.02), 4).T + 1e-9
    model /= model.sum(0)
    for parts in ({0: 900}, {1: 700, 3: 300}, {0: 500, 2: 300, 3: 200}):
        grams = np.concatenate([rng.choice(1 << 16, n, p=model[:, k]) for k, n in parts.items()])
        best, share, _ = infer(grams, model)

        def like(s, p):
            return np.log(p @ np.maximum(s, 1e-12)).sum()

        def most(own):
            p = model[grams][:, own]
            s = np.full(len(own), 1 / len(own))
            for width in (0.2, 0.05, 0.01, 0.002):
                while True:
                    near = [s]
                    for i in range(len(own)):
                        for j in range(len(own)):
                            if i != j and s[i] >= width:
                                near.append(s + width * (np.eye(len(own))[j] - np.eye(len(own))[i]))
                    k = int(np.argmax([like(x, p) for x in near]))
                    if k == 0:
                        break
                    s = near[k]
            return s, like(s, p)

        cost = L.PENALTY * math.log(len(grams) + 1)
        every = {own: most(list(own)) for k in (1, 2, 3, 4) for own in combinations(range(4), k)}
        winner = max(every, key=lambda own: 2 * every[own][1] - cost * (len(own) - 1))
        assert set(best.tolist()) == set(winner) == set(parts)
        assert all(abs(dict(zip(best.tolist(), share))[k] - x) < 0.01 for k, x in zip(winner, every[winner][0]))


def test_many_languages(spark):
    """More labels than a table of full width would hold, and signs that are no letters."""
    rows = [(k, f"{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'klmnop'[k % 6]} " * 20, f"x{k:03d}") for k in range(300)] + [(1000, "²½ ① 12", "x001")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, model = language_model(docs)
    assert len(langs) == 301 - 1 and model.shape == (1 << 15, 300) and np.allclose(model.sum(0), 1)
    found = {r.doc_id: r.lang_pred for r in identify_languages(docs, docs).collect()}
    assert found[1000] == "und" and found[3] in langs


# language models


def test_pitman_yor_contract(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    count = Counter()
    for doc, text in rows:
        if doc is None or not held(doc, 5, 1):
            count.update([*tokens(text), "end"])
    n, v = sum(count.values()), len(count)
    expected = []
    for doc, text in rows:
        w = [*tokens(text), "end"]
        expected.append((doc, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)))
    found = P.score_texts(docs, ~P.held_out(F.col("doc_id"))).collect()
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))) for r in found)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_pitman_yor_of_nothing(spark):
    assert P.score_texts(empty(spark), F.lit(True)).count() == 0
    docs = documents(spark)
    assert all(math.isfinite(r.score) for r in P.score_texts(docs, F.lit(False)).collect())


def test_stirling_numbers():
    """Against sums over all partitions, and those for many customers against the recursion."""
    d = 0.7

    def partitions(n):
        if not n:
            yield []
            return
        for p in partitions(n - 1):
            yield [*p, 1]
            for k in range(len(p)):
                yield [*p[:k], p[k] + 1, *p[k + 1 :]]

    for c in range(1, 8):
        sums = Counter()
        for p in partitions(c):
            sums[len(p)] += math.prod(math.prod(j - d for j in range(1, k)) for k in p)
        assert all(math.isclose(math.exp(P.stirling(d)[c, t]), sums[t], rel_tol=1e-9) for t in range(1, c + 1))
    for d in (0.2, 0.4, 0.75, 0.9):  # at 250 of 256 customers: within a tenth, and the ratios that decide within a hundredth but for the last
        off = P.stirling_many(np.full(250, 250), np.arange(1, 251), d) - P.stirling(d)[250, 1:251]
        assert np.abs(off).max() < 0.13 and np.abs(np.diff(off[:240])).max() < 0.1
    assert np.allclose(P.lgamma(np.array([0.25, 1, 2.5, 10, 1e6])), [math.lgamma(x) for x in (0.25, 1, 2.5, 10, 1e6)])


def test_draws_follow_the_conditional():
    rng = np.random.default_rng(2)
    n, d, p, others = 40_000, 0.75, 0.1, 3
    fill = lambda x: np.full(n, x)
    for c in (1, 2, 5):
        found = P.draw_tables(fill(c), fill(1), fill(others), fill(np.log(p)), d, rng)
        weight = [math.exp(P.stirling(d)[c, t]) * p**t * math.prod(P.STRENGTH + d * (others + i) for i in range(t)) for t in range(1, c + 1)]
        share = np.bincount(found, minlength=c + 1)[1:] / n
        assert np.abs(share - np.array(weight) / sum(weight)).max() < 0.01
    n = 400
    mean = []
    for limit in (256, 512):  # three hundred customers by steps, and by the recursion
        old, P.EXACT = P.EXACT, limit
        P.stirling.cache_clear()
        t = fill(20)
        for _ in range(20):
            t = P.draw_tables(fill(300), t, fill(others), fill(np.log(p)), d, rng)
        mean.append(t.mean())
        P.EXACT = old
        P.stirling.cache_clear()
    assert abs(mean[0] - mean[1]) < 0.06 * mean[1]


def test_blocks_follow_from_rows_alone(monkeypatch):
    import pyarrow as pa
    from wordloom.llm import words as W

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(W, "TaskContext", Task)
    rng = np.random.default_rng(7)
    texts = [None if k % 9 == 0 else "x" * int(n) for k, n in enumerate(rng.choice([0, 1, 5, 30, 200], 300))]
    whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    def cuts(sizes):
        at, parts = 0, []
        for n in sizes:
            parts.append(whole.slice(at, n))
            at += n
        return [(k, b.column("text").to_pylist()) for k, b in W.blocks(iter(parts), "text", 64)]

    one = cuts([300])
    assert one == cuts([1] * 300) == cuts([7] * 42 + [6]) and [t for _, b in one for t in b] == texts
    assert all(sum(len(t or "") for t in b) <= 64 or len([t for t in b if t]) == 1 for _, b in one) and [k for k, _ in one] == [(3 << 32) + k for k in range(len(one))]


def trained(spark, docs):
    learned = docs.select("text")
    shards = B.n_shards(learned)
    contexts, n_tokens = B.contexts_of(learned, shards)
    return contexts, n_tokens, B.pair_counts(learned, contexts, shards)


def pairs_in(contexts, text):
    """(hash of the word, its context) of each token, and the end's."""
    import pyarrow as pa

    h, _ = B.tokens(pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["text"]))
    h = np.append(h, B.END)
    return list(zip(h.tolist(), np.append(contexts.end, contexts.of(h[:-1])).tolist()))


def test_counts_equal_brute_force(spark):
    docs = documents(spark)
    contexts, n_tokens, counts = trained(spark, docs)
    expected = Counter(x for r in docs.collect() for x in pairs_in(contexts, r.text))
    found = {}
    for r in counts.collect():
        words, of, context, c = B.opened(r.asDict())
        found |= {(int(words[o]), int(x)): int(k) for o, x, k in zip(of, context, c)}
    assert found == expected and n_tokens == sum(expected.values())
    many = Counter(w for w, _ in expected.elements())
    stats, words = B.context_stats(counts, contexts.n), B.word_stats(counts)
    assert stats[0].sum() == n_tokens and [s.sum() for s in stats[1:5]] == [sum(c == k for c in expected.values()) for k in (1, 2, 3, 4)]
    assert words["types"] == len(many) and words["fans"] == len(expected)


def test_pitman_yor_score_equals_brute_force(spark):
    """Ten documents, by the samples' numbers of tables and plain loops; and the probabilities of all words after a context sum to one."""
    docs = documents(spark)
    train = docs.where(~P.held_out(F.col("doc_id")))
    contexts, _, counts = trained(spark, train)
    stats, words = B.context_stats(counts, contexts.n), B.word_stats(counts)
    levels = P.Levels(stats[0], sum(stats[1:]), P.discount(stats[1].sum(), stats[2].sum()), P.discount(words["k1"], words["k2"]), words["types"])
    model, backs, totals = P.sampled(counts, levels, contexts.n)
    pair, single = {}, {}
    for r in model.collect():
        hashes, of, context, c = B.opened(r.asDict())
        s = [B.unsqueeze(x).astype(float) for x in r.samples]
        t = np.ones(len(c))
        t[c > 1] = np.mean(s[0::3], 0)
        assert all(((1 <= x) & (x <= c[c > 1])).all() for x in s[0::3])
        pair |= {(int(hashes[o]), int(x)): (int(k), float(y)) for o, x, k, y in zip(of, context, c, t)}
        single |= {int(w): list(zip(*rest)) for w, *rest in zip(hashes, np.stack(s[1::3], 1), np.stack(s[2::3], 1))}
        for m, w in zip(s[1::3], s[2::3]):
            assert ((1 <= w) & (w <= m)).all()
    d, e, v = levels.own, levels.parent, words["types"]

    def probability(w, x):
        c, t = pair.get((w, x), (0, 0.0))
        low = [(m - e * k + (P.STRENGTH + e * tables) / (v + 1)) / (P.STRENGTH + seated) for (m, k), (seated, tables) in zip(single.get(w, [(0, 0)] * len(totals)), totals)]
        return (c - d * t) / (P.STRENGTH + stats[0][x]) + sum(b[x] * p for b, p in zip(backs, low)) / len(backs)

    for x in (contexts.end, 0, 5, contexts.n - 1):
        assert math.isclose(sum(probability(w, x) for w in single) + probability(-1, x), 1, rel_tol=1e-9)
    found = {r.doc_id: r.score for r in P.score_texts(docs, ~P.held_out(F.col("doc_id"))).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc in (0, 1, 2, 3, 101, 120, 200, 401, 404, 500):
        assert math.isclose(found[doc], sum(math.log10(probability(w, x)) for w, x in pairs_in(contexts, texts[doc])), rel_tol=1e-6)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """A word is frequent by its share of the whole table, even one that a block has rarely."""
    monkeypatch.setattr(B, "MIN_SHARE", 2e-3)
    docs = documents(spark)
    learned = docs.select("text")
    counted = Counter(w for r in docs.collect() for w, _ in pairs_in(B.Contexts(np.zeros(0, np.uint64)), r.text))
    least = 2e-3 * sum(counted.values())
    for parts in (1, 8):
        contexts, n_tokens = B.contexts_of(learned.repartition(parts), 5)
        assert n_tokens == sum(counted.values())
        assert set(contexts.words.tolist()) == {w for w, k in counted.items() if k >= least} - {int(B.END)}
    scored = [sorted(P.score_texts(docs.repartition(k), ~P.held_out(F.col("doc_id"))).collect(), key=repr) for k in (1, 8)]
    assert scored[0] == scored[1]
    scored = [sorted(K.perplexities(docs.repartition(k), docs.where("doc_id % 2 = 0").repartition(k)).collect(), key=repr) for k in (1, 8)]
    assert scored[0] == scored[1]


def test_context_sums_over_a_tree(spark, monkeypatch):
    """Sums of shards by twos and threes equal those taken at once."""
    _, _, counts = trained(spark, documents(spark))
    expected = np.zeros((6, B.CONTEXTS), np.int64)
    for r in counts.collect():
        _, _, context, c = B.opened(r.asDict())
        np.add.at(expected[0], context, c)
        np.add.at(expected, (np.minimum(c, 5), context), 1)
    for fan in (2, 3, 64):
        monkeypatch.setattr(B, "FAN", fan)
        assert (B.context_stats(counts, B.CONTEXTS) == expected).all()
    assert (B.context_stats(counts.limit(0), B.CONTEXTS) == 0).all()


def test_kneser_ney_equals_brute_force(spark):
    docs = documents(spark)
    trusted = docs.where("doc_id % 2 = 0")
    contexts, _, _ = trained(spark, trusted)
    pair = Counter(x for r in trusted.collect() for x in pairs_in(contexts, r.text))
    d = K.discounts(*(sum(v == k for v in pair.values()) for k in (1, 2, 3, 4)))
    total, cont, taken = Counter(), Counter(), Counter()
    for (w, u), v in pair.items():
        total[u] += v
        cont[w] += 1
        taken[u] += d[min(v, 3)]
    e = K.discounts(*(sum(v == k for v in cont.values()) for k in (1, 2, 3, 4)))
    spare = sum(e[min(v, 3)] for v in cont.values()) / len(pair) / (len(cont) + 1)

    def probability(w, u):
        low = (cont[w] - e[min(cont[w], 3)]) / len(pair) + spare
        own, back = ((pair[w, u] - d[min(pair[w, u], 3)]) / total[u], taken[u] / total[u]) if total[u] else (0.0, 1.0)
        return own + back * low

    for u in (contexts.end, 3, contexts.n - 1):
        assert math.isclose(sum(probability(w, u) for w in cont) + probability(-1, u), 1, rel_tol=1e-9)
    expected = []
    for r in docs.collect():
        tokens_ = pairs_in(contexts, r.text)
        expected.append((r.doc_id, r.lang, len(tokens_), sum(math.log10(probability(w, u)) for w, u in tokens_)))
    found = [(r.doc_id, r.lang, r.n_tokens, r.log10_prob) for r in K.perplexities(docs, trusted).collect()]
    key = lambda x: (str(x[0]), str(x[1]), *x[2:])
    assert len(expected) == len(found)
    for a, b in zip(sorted(expected, key=key), sorted(found, key=key)):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9)


def test_quality_thresholds(spark):
    docs = documents(spark)
    labels = docs.where("doc_id < 200").select("doc_id", F.when(F.col("doc_id") % 7 == 0, 0).otherwise(1).alias("quality")).distinct()
    found = K.quality(docs, labels, quantile=0.9).collect()
    assert len(found) == docs.count()
    trusted = [r for r in found if r.trusted]
    assert trusted and all(r.doc_id % 7 for r in trusted)
    assert all(r.keep == (r.perplexity <= r.threshold) for r in found)
    # the least perplexity that so many of a language's calibration rows have at most
    held_out = {r.doc_id for r in docs.select("doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(K.CALIBRATION)) == 0).collect()}
    calibration = [(r.lang, r.perplexity) for r in trusted if r.doc_id in held_out]
    for lang in {r.lang for r in found}:
        own = sorted(p for k, p in calibration if k == lang) or sorted(p for _, p in calibration)
        assert {r.threshold for r in found if r.lang == lang} == {own[max(0, math.ceil(0.9 * len(own)) - 1)]}
    assert all(r.keep and r.threshold is None for r in K.quality(docs, labels.limit(0)).collect())
    assert K.quality(empty(spark), labels).count() == 0


# mixing


def filled(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, fixed = {}, {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        target = fixed | {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > cap * sizes[s]]
        if not over:
            return target
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, None: 50}, {"a": 1, "b": 1000, "c": 1, "d": 5, "e": 300}, {"a": 7}, {"a": 0, "b": 9}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in capped_targets(rows).collect()}
    assert found.keys() == sizes.keys() and all(math.isclose(found[s], t, abs_tol=1e-9) for s, t in filled(sizes).items())


def test_dual_equals_brute_force(spark):
    """Fifty documents of four sources: the multipliers by bisection on plain sums, and rates that no shift between two documents betters."""
    rng = np.random.default_rng(6)
    sizes = {s: rng.integers(1, 300, n).tolist() for s, n in (("a", 20), ("b", 15), ("c", 10), ("d", 5))}
    wanted = {"a": 0.3, "b": 1.0, "c": 2.2, "d": 3.0}
    classes = spark.createDataFrame([(s, k, 1) for s, own in sizes.items() for k in own], "source string, size long, n long")
    targets = spark.createDataFrame([(s, sum(own), wanted[s] * sum(own), len(own)) for s, own in sizes.items()], "source string, source_size long, target double, n_docs long")
    found = {r.source: r.multiplier for r in multipliers(classes, targets).collect()}
    rate = lambda m, k: 3.0 if m * k >= math.log(3) else math.exp(m * k)
    for s, own in sizes.items():
        taken = sum(k * rate(found[s], k) for k in own)
        assert math.isclose(taken, wanted[s] * sum(own), rel_tol=1e-6)
        low, high = -1.0, 5.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(k * rate(middle, k) for k in own) < wanted[s] * sum(own) else (low, middle)
        assert s == "d" or math.isclose(found[s], low, rel_tol=1e-5, abs_tol=1e-9)
    own, m = sizes["a"], found["a"]
    cost = lambda rates: sum(r * math.log(r) - r for r in rates)  # noqa: E731  # relative entropy to one copy each
    best = [rate(m, k) for k in own]
    for i, j in ((0, 1), (3, 7), (5, 11)):
        for e in (1e-3, -1e-3):  # as many words moved from one to the other
            other = list(best)
            other[i], other[j] = other[i] + e / own[i], other[j] - e / own[j]
            assert cost(other) >= cost(best) - 1e-12


def test_mix(spark):
    docs = documents(spark)
    found = mixed(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(tokens(r.text))
    target = filled(sizes)
    by_target = {round(t, 6): s for s, t in target.items()}
    assert len(found) == docs.count()
    taken = Counter()
    for r in found:
        source = by_target[round(r.target, 6)]
        assert r.source_size == sizes[source] and r.taken == r.copies * r.size and r.taken <= 3 * r.size
        taken[source] += r.taken
    own = {s: sorted(len(tokens(r.text)) for r in docs.collect() if r.source == s and tokens(r.text)) for s in sizes}
    for s, t in target.items():  # what whole copies of the largest document leave over may be more than three copies of all others
        spare = max(0, own[s][-1] / 2 - sum(own[s][:-1]))
        assert abs(taken[s] - t) <= 0.01 * t + own[s][0] + spare, (s, taken[s], t, own[s])
    key = lambda rows: sorted(map(repr, rows))
    assert key(found) == key(mixed(docs.repartition(7)).collect())
    assert mixed(empty(spark)).count() == 0


def test_mix_of_documents_without_ids(spark):
    """All ids are null and most sizes equal: no group has more rows than classes, and targets are met."""
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("source"), F.when(F.col("id") % 50 == 0, "five words are in here").otherwise("just three words").alias("text"))
    found = mixed(rows).groupBy("source_size", "target", "size").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()
    assert sum(r.n for r in found) == 30_000 and len({r.target for r in found}) == 3
    for target in {r.target for r in found}:
        assert abs(sum(r.taken for r in found if r.target == target) - target) <= 0.01 * target
    assert all(r.most - r.least <= 1 and r.most <= 3 for r in found)
