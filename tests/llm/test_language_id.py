import random
import zlib

import numpy as np
import pytest
from prefscale.llm import common as C
from prefscale.llm import language_id as L


def corpus():
    r = random.Random(1)
    bits = {"en": ["th", "ing", "er", "on"], "de": ["sch", "ung", "ß", "ein"], "fr": ["eau", "é", "oi", "que"]}
    out = []
    for i in range(300):
        lang = r.choice(list(bits))
        words = ["".join(r.choice(bits[lang]) for _ in range(r.randint(1, 5))) for _ in range(r.choice([1, 5, 60]))]
        out.append((i, " ".join(words).title(), lang))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(900, None, "en"), (901, "", "de"), (902, "12 … !!", "fr"), (903, "zzz qqq", None), (904, "ÉAU " * 40_000, None), (903, "zzz qqq", None), (None, "the thing", "en")]
    return spark.createDataFrame(corpus() + odd, "doc_id long, text string, lang string")


def test_digest(docs):
    rows = L.digest(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count()
    held = [(by[i], lang) for i, t, lang in corpus() if by[i].held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(held) > 30
    assert sum(r.lang_pred == lang for r, lang in held) >= 0.97 * len(held)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[904].lang_pred == "fr" and all(0 <= r.score <= 1 for r in rows)


def slow(rows, max_words=L.MAX_WORDS):
    """Predictions by plain loops; only the hash of an n-gram to its slot is the operator's."""
    import math
    import re
    import unicodedata
    from collections import Counter, defaultdict

    def words(t):
        low = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (t or "").lower())
        return low.split()

    def slot(gram):
        p = np.array([ord(c) for c in gram], np.uint64) + np.uint64(1)
        return int(C.span_hash(C.prefix_hash(C.mix(p)), np.array([0]), np.array([len(p)]))[0]) >> 47

    def grams(w, n):
        w = f" {w} "
        return [slot(w[i : i + n]) for i in range(len(w) - n + 1)]

    train = [(t, g) for d, t, g in rows if t is not None and g is not None and d is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    langs = sorted({g for _, g in train})
    known, table = defaultdict(Counter), {n: defaultdict(Counter) for n in range(1, 6)}
    for t, g in train:
        for w in words(t):
            known[w][g] += 1
            for n in table:
                for x in grams(w, n):
                    table[n][x][g] += 1
    h = lambda w: np.uint64(_hash(w)).astype(np.int64)
    _hash = lambda w: int(C.span_hash(C.prefix_hash(C.mix(np.array([ord(c) for c in w], np.uint64) + np.uint64(1))), np.array([0]), np.array([len(w)]))[0])
    known = dict(sorted(known.items(), key=lambda x: (-sum(x[1].values()), h(x[0])))[:max_words])

    def logs(t):
        total = {g: sum(c[g] for c in t.values()) for g in langs}
        return {x: {g: math.log((c[g] + 0.5) / (total[g] + 0.5 * max(1, len(t)))) for g in langs} for x, c in t.items()}

    known, table = logs(known), {n: logs(t) for n, t in table.items()}
    out = []
    for _, t, _ in rows:
        ws, votes = words(t), Counter({g: 0.0 for g in langs})
        if not re.search(r"[^\W\d_]", t or ""):
            out.append(("und", 0.0))
            continue
        for w in ws:
            if w in known:
                votes.update(known[w])
                continue
            for n in (5, 4, 3, 2, 1):
                seen = [x for x in grams(w, n) if x in table[n]]
                if seen:
                    votes.update({g: sum(table[n][x][g] for x in seen) / n for g in langs})
                    break
        best = max(langs, key=lambda g: (votes[g], [-ord(c) for c in g]))
        z = {g: math.exp((votes[g] - votes[best]) / math.sqrt(len(ws))) for g in langs}
        out.append((best, z[best] / sum(z.values())))
    return out


@pytest.mark.parametrize("most", [L.MAX_WORDS, 40])
def test_against_plain_loops(spark, most):
    rows = [*corpus()[:150], (900, None, "en"), (902, "12 … !!", "fr"), (903, "zung thing 漢字 «éau»nbsp\u00a0sch", None), (904, "x", None), (905, "漢字かな", "ja"), (906, "漢字 かな漢", "ja"), (None, "the sch", "de"), (7000, "e\u0301te\u0301 Ünd", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in L.identify(df, L.fit(df.where(~L.held_out(4, 2)), max_words=most)).collect()}
    for (d, t, _), (lang, score) in zip(rows, slow(rows, most)):
        assert got[d, t][0] == lang and abs(got[d, t][1] - score) < 1e-4, (d, t, lang, score, got[d, t])


def test_code_points():
    import pyarrow as pa

    points, off = L._points(pa.array(["aß€😀", None, "", "É"]))
    assert [[chr(c) for c in points[a:b]] for a, b in zip(off[:-1], off[1:])] == [[" ", *"aß€😀", " "], [" ", " "], [" ", " "], [" ", "é", " "]]
    s, e, first, _ = L._words(*L._points(pa.array(["«mot»…fin\u00a0x", "e\u0301"])))
    assert (e - s).tolist() == [3, 3, 1, 2] and first.tolist() == [0, 3, 4]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.digest(df).collect()] == [("und", 0.0)]
    assert L.digest(df.where("doc_id = 2")).count() == 0


def test_other_columns_stay(docs):
    out = L.identify(docs.withColumn("score", docs["lang"]), L.fit(docs))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
