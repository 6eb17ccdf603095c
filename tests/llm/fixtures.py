"""Documents with nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h long, node string, item string, label string, _text string, `size` int"


def words(rng, n, letters="abcdefghij"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(n)]


def documents(spark, extra=()):
    rng = random.Random(5)
    texts = [(i, " ".join(words(rng, rng.randint(20, 60))), "aa") for i in range(30)]
    texts += [(100 + i, " ".join(words(rng, rng.randint(20, 60), "uvwxyzklmn")), "zz") for i in range(30)]
    base = words(rng, 200)
    texts.append((200, " ".join(base), "aa"))
    for i in range(1, 6):  # near copies: i words differ
        copy = list(base)
        for k in range(i):
            copy[20 * k + 7] = "changed"
        texts.append((200 + i, " ".join(copy), "aa"))
    texts += [(300, texts[3][1], "aa"), (300, texts[3][1], "aa"), (301, texts[3][1].upper().replace(" ", "\t\n"), None)]  # copies, a row given twice
    texts += [(400, None, "aa"), (401, "", "zz"), (402, " \n\t ", "aa"), (403, "one", "aa"), (404, "one two", "aa"), (405, "ONE two", "zz"), (406, "12 34 --", None)]
    texts += [(None, "no id at all here " + texts[0][1], "aa"), (None, texts[5][1], None)]
    texts.append((500, " ".join(words(rng, 20_000)), "aa"))
    texts += list(extra)
    sources = ["a", "b", None, "é"]
    rows = [(i, t, lang, sources[k % 4], None if t is None else len(t), 0.5, 7, "n", "i", "l", "t", 3) for k, (i, t, lang) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()


def shingle_set(text, k):
    w = tokens(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
