import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from prefscale.llm import toxicity as X

BAD = ["loser", "idiot", "moron", "pathetic", "scum"]


def corpus():
    r = random.Random(1)
    docs, labels = [], []
    for i in range(800):
        words = ["".join(r.choice(["th", "er", "on", "ing", "an", "st", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(r.choice([8, 60]))]
        toxic = int(i % 8 == 0)
        for _ in range(3 * toxic):
            words[r.randrange(len(words))] = r.choice(BAD)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    return X.learned(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def chars(words):
    n = Counter(g for w in words for w in [f"^^{w}$"] for g in (w[i : i + 3] for i in range(len(w) - 2)))
    return X.CharModel(n)


@pytest.mark.parametrize("told,want", [("1d10t", "idiot"), ("l0s3r", "loser"), ("$cum", "scum"), ("m.o.r.o.n", "moron"), ("scuuuum", "scum"), ("p@th3t1c", "pathetic"), ("idiot", "idiot")])
def test_decode(told, want):
    assert X.decode(told, chars(BAD * 5 + ["the", "other", "string"])) == want


def cost_of(path, m):
    """Letters between breaks and signs that stand for themselves are words of their own; those before a sign have no end."""
    total, word = -sum(c for _, c in path), ""

    def close(end):
        text = "^^" + word + ("$" if end and word else "")
        return sum(m.log(*text[i : i + 3]) for i in range(len(text) - 2))

    for x, _ in path:
        if x == " " or x and x[0] in X.LEET and not x[0].isalpha():
            total, word = total + close(x == " "), ""
        else:
            word += x
    return total + close(True)


@pytest.mark.parametrize("word", ["1d10t", "l1sp!", "0110a", "aab", "mp3", "4th", "7up1", "$cum", "l 1 s p", "b3st5"])
def test_viterbi_finds_the_best_of_all_paths(word):
    import itertools

    m = chars(BAD + ["ioio", "lisp", "best", "mp", "up"])
    best = max(itertools.product(*X.lattice(word)), key=lambda p: cost_of(p, m))
    assert X.decode(word, m) == "".join(x for x, _ in best)


@pytest.mark.parametrize("word", ["mp3", "4th", "covid19", "b2", "80s", "idiot5"])
def test_digits_at_the_ends_of_words_stay(word):
    m = chars(BAD * 5 + ["the", "other", "string", "covid", "map", "mope", "lamp", "empty", "bath", "math"])
    assert X.decode(word, m) == word


def test_scores_against_plain_loops(spark):
    import math

    docs, labels = corpus()
    truth = dict(labels)
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    kinds = {d: {("", w) for w in t.split()} | {(n, w[:n]) for w in t.split() for n in (4, 5, 6) if len(w) > n} for d, t in docs}
    sample = [d for d, _ in docs if not held(d)]
    n1 = Counter(f for d in sample if truth[d] for f in kinds[d])
    n0 = Counter(f for d in sample if not truth[d] for f in kinds[d])
    t1, t0 = sum(truth[d] for d in sample), sum(1 - truth[d] for d in sample)
    weight = {}
    for f in n1 | n0:
        a, b, p = n1[f], n0[f], t1 / (t1 + t0)
        lift = ((a + 0.5) / (t1 + 1)) / ((b + 0.5) / (t0 + 1))
        g = 2 * sum(c * math.log(c / ((a + b) * q)) for c, q in ((a, p), (b, 1 - p)) if c)
        if lift > 3 and g > 2 * math.log(len(n1 | n0)):
            weight[f] = math.log(lift)
    x = {d: math.log1p(sum(weight.get(f, 0) for f in kinds[d])) for d, _ in docs}
    a, b = 0.0, 0.0
    for _ in range(200):  # Newton's steps, halved
        p = [1 / (1 + math.exp(-(a * round(x[d], 2) + b))) for d in sample]
        e = [q - truth[d] for q, d in zip(p, sample)]
        ga, gb = sum(v * round(x[d], 2) for v, d in zip(e, sample)) + 0.1 * a, sum(e) + 0.01 * b
        v = [q * (1 - q) for q in p]
        haa, hab, hbb = sum(w * round(x[d], 2) ** 2 for w, d in zip(v, sample)) + 0.1, sum(w * round(x[d], 2) for w, d in zip(v, sample)), sum(v) + 0.01
        det = haa * hbb - hab * hab
        a, b = a - 0.5 * (hbb * ga - hab * gb) / det, b - 0.5 * (haa * gb - hab * ga) / det
    rows = X.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(abs(r.score - 1 / (1 + math.exp(-(a * x[r.doc_id] + b)))) < 1e-6 for r in rows)


def test_restore_keeps_offsets():
    m = chars(BAD * 9)
    rows = pa.array(["you l0s3r now", None, "", "ß i d i o t!", "plain é", "SCUUUM.", "a b", "x@y.com 12"])
    buf, off = X.restore(rows, m, {})
    got = [buf[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:])]
    assert got[0] == "you loser now" and got[1:3] == ["", ""] and got[4] == "plain é" and got[5] == "scum" and got[6] == "a b"


def test_digest(spark):
    docs, labels = corpus()
    odd = [(900, None), (901, ""), (902, "x " * 60_000 + "1d10t l0ser m0ron"), (903, "an i d i o t and a l.o.s.e.r"), (903, "ouer"), (None, "l0ser and m0ron")]
    df = spark.createDataFrame([(d, t, 9.0) for d, t in docs + odd], "doc_id long, text string, score double")
    rows = X.digest(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == len(docs) + len(odd) and len(held) > 100
    assert all(r.predicted == truth[r.doc_id] for r in held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    got = Counter((r.doc_id, r.predicted) for r in rows if r.doc_id is None or r.doc_id >= 900)
    assert got == Counter([(None, 1), (900, 0), (901, 0), (902, 1), (903, 1), (903, 0)])


def test_filter_and_no_labels(spark, model):
    df = spark.createDataFrame([(1, "you idiot loser scum", 1.0), (2, None, 2.0)], "doc_id long, text string, _toxicity double")
    assert [tuple(r) for r in X.without_toxic(df, model).collect()] == [(2, None, 2.0)]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in X.digest(df, none).collect()] == [0.0, 0.0]
    assert X.digest(df.where("doc_id = 5"), none).count() == 0


@pytest.mark.parametrize("told,want", [
    ("so i d 1 0 t now", "so idiot now"), ("1 d 1 0 t", "idiot"), ("$ t u p 1 d", "stupid"), ("s t u p i d!", "stupid"), ('you "s t u p i d", ok', "you stupid ok"),
    ("a s t u p i d", "a stupid"), ("i d i o t l o s e r", "idiot loser"), ("s t u p 1 d! l 0 s e r.", "stupid loser"), ("1 2 3 4", "1 2 3 4"),
])
def test_spaced_words_with_signs_marks_and_neighbours(told, want):
    m = chars((BAD + ["stupid"]) * 9 + ["a", "you", "so", "now"] * 5)
    buf, off = X.restore(pa.array([told, None, told]), m, {})
    assert [buf[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:])] == [want, "", want]
