import hashlib
import random
import re

import pyarrow as pa

from prefscale.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, bench):
    wins = {}
    for item, text in bench:
        w = WORD.findall(low(text))
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, items = WORD.findall(low(text)), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit.update(range(i, i + k))
                    items |= wins[tuple(w[i : i + k])]
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def fixture():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abßé1") for _ in range(r.randint(1, 3)))
    bench = [(i, " ".join(word() for _ in range(r.choice([1, 5, 13, 20, 40])))) for i in range(12)] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for d in range(40):
        t = [word() for _ in range(r.choice([0, 3, 30, 300]))]
        if d % 2:
            t[len(t) // 2 : len(t) // 2] = [bench[d % 12][1].upper().replace("SS", "ß")]
        docs.append((d, r.choice([" ", ", ", "\n"]).join(t)))
    return docs + [(100, None), (100, None), (101, ""), (102, "zz " * 50_000 + bench[3][1])], bench


def test_digest_is_brute_force(spark):
    docs, bench = fixture()
    d = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert sorted(map(tuple, D.digest(d, b).collect()), key=str) == brute(docs, bench)


def test_blocks_of_a_large_benchmark_give_the_same(spark):
    docs, bench = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    one, many = (D.hits(d, b, block_bytes=x).select("doc_id", "_hits.*").collect() for x in (1 << 20, 200))
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_clean(spark):
    docs, bench = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    bad = {x[0] for x in brute(docs, bench) if x[5]}
    assert {r.doc_id for r in D.clean(d, b).collect()} == {x[0] for x in docs} - bad
    cut = D.clean(d, b, mode="span").collect()
    assert len(cut) == len(docs) and sum(len(r.text or "") for r in cut) < sum(len(t or "") for _, t in docs)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.digest(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in D.digest(one, b).collect()] == [(1, 2, 0, 0)]


def test_spans_are_cut_exactly(spark):
    bench = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "tiny item")]
    docs = [(1, "Before, ONE two three four five six seven eight nine ten eleven-twelve thirteen! after", "x"), (2, "a Tiny  item, and tiny items", "y"), (3, None, "z"), (None, "é tiny.item é", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, _hits string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = [(1, "Before, ! after", "x"), (2, "a , and tiny items", "y"), (3, None, "z"), (None, "é  é", None)]
    for size in (1 << 20, 20):
        out = D.clean(d, b, mode="span", block_bytes=size)
        assert out.columns == d.columns and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    kept = D.clean(d, b).collect()
    assert sorted(map(tuple, kept), key=str) == [docs[2]]


def test_a_large_benchmark_has_a_small_index():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(20_000)]
    items = [(i, " ".join(r.choices(words, k=200))) for i in range(6_000)] + [(9_000 + i, "the same boiler plate " * 50) for i in range(50)]
    size = sum(len(t) for _, t in items)
    index = D.Index(items, 13)
    assert size > 7_000_000 and index.nbytes() < 6 * size
    found = D._scanned(pa.record_batch({"text": pa.array(["x " + items[5][1].title(), "the same boiler plate " * 4])}), index)
    assert [x["n_hit"] for x in found] == [200, 16] and found[0]["items"] == ["5"] and len(found[1]["items"]) == 50
