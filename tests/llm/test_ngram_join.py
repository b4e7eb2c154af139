import random
import re

import numpy as np
import pytest
from prefscale.llm import ngram_join as J
from prefscale.llm.components import components


def union_find(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def brute(docs, k, percent):
    sets = []
    for d, t in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append((d, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    links = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    root = union_find([d for d, _ in docs], links)
    return sorted((d, len(s), root[d]) for d, s in sets)


def corpus(seed):
    r = random.Random(seed)
    line = "a very common line that stands in many documents".split()
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([1, 2, 3, 12, 60, 300]))] for _ in range(30)]
    out = []
    for _ in range(220):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 8])):
            i = r.randrange(len(w) + 1)
            w[i : i + r.choice([0, 1])] = [f"w{r.randint(0, 400)}"]
        if r.random() < 0.4:
            w[len(w) // 2 : len(w) // 2] = line
        out.append(r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.2 else " ".join(w))
    out += [None, "", " \n", "x " * 30_000, "x " * 30_001 + "Y"]
    ids = list(range(len(out)))
    r.shuffle(ids)
    return list(zip(ids, out))


@pytest.mark.parametrize("seed,k,percent,hot", [(1, 3, 90, 1000), (2, 3, 90, 5), (3, 5, 80, 3), (4, 1, 60, 4)])
def test_classes_are_brute_force(spark, monkeypatch, seed, k, percent, hot):
    monkeypatch.setattr(J, "BLOCK", 16)
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n int")
    got = sorted(map(tuple, J.classes(df, k, percent, hot).collect()))
    assert got == brute(docs, k, percent)


def test_tree_drops_no_pair_that_links():
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = []
    for _ in range(150):
        if sets and r.random() < 0.6:
            s = np.unique(np.concatenate([sets[r.integers(len(sets))][r.random() > 0.03 :], r.choice(pool, r.integers(1, 4))]))
        else:
            s = np.unique(r.choice(pool, r.choice([1, 5, 40, 700])))
        sets.append(s)
    sets.sort(key=len)
    bits, n = [J.bitmap_of(s) for s in sets], np.array([len(s) for s in sets])
    links, seen = set(), []
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                links.add((i, j))
    forest = J.bucket_forest(n, np.arange(len(sets)), bits, 80, lambda i, j: seen.append((i, j)) or (min(i, j), max(i, j)) in links)
    want, got = union_find(range(len(sets)), links), union_find(range(len(sets)), forest)
    assert got == want and len(forest) == len(sets) - len(set(want.values())) and len(seen) < len(sets) ** 2 / 8


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(4000, 4100)]
    want = union_find({x for e in edges for x in e}, edges)
    got = {x.id: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(k in got for k in want if any(k in e and e[0] != e[1] for e in edges))


def test_first_of_each_and_empty(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "x"), (1, "A b c d e f", "y"), (7, None, "z"), (7, None, "z")], "doc_id long, text string, component_id string")
    assert sorted(map(tuple, J.first_of_each(df).collect())) == [(1, "A b c d e f", "y"), (7, None, "z"), (7, None, "z")]
    assert J.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_of_each_keeps_clean_rows_of_null_and_reused_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    near = text(1) + " more"
    rows = [(3, text(1), "a"), (7, text(2), "b"), (7, near, "c"), (7, text(3), "d"), (7, text(3), "d"), (9, text(3) + " end", "e")]
    rows += [(None, text(4), "f"), (None, text(4) + " z", "f"), (None, text(2), "g"), (None, text(5), "h"), (None, None, "i"), (None, "", "i"), (11, "", "j"), (11, None, "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    got = sorted((r.tag for r in J.first_of_each(df).collect()))
    assert got == ["a", "b", "d", "f", "h", "i", "i", "j", "j"]


def test_null_and_shared_ids(spark):
    docs = [x for x in corpus(6)[:60]]
    docs += [(None, docs[0][1]), (None, docs[5][1]), (docs[3][0], docs[4][1]), (docs[3][0], docs[3][1]), (None, "only here at all"), (None, "only here at all"), (None, None)]
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, _row int")
    rows = brute([(k, t) for k, (_, t) in enumerate(docs)], 3, 90)
    least = {}
    for k, _, root in rows:
        least[root] = min([x for x in (least.get(root), docs[k][0]) if x is not None], default=None)
    want = [(docs[k][0], n, least[root]) for k, n, root in rows]
    assert sorted(map(tuple, J.classes(df, 3, 90).collect()), key=str) == sorted(want, key=str)
    kept = J.first_of_each(df, 3, 90)
    assert kept.columns == df.columns and kept.count() == len({root for _, _, root in rows})


def test_whole_groups_in_any_batches():
    import pyarrow as pa
    from prefscale.llm import common as C

    key = [1] * 3 + [2] + [5] * 7 + [6, 7, 7]
    for step in (1, 2, 3, 5, 14):
        batches = [pa.record_batch({"k": pa.array(key[a : a + step], pa.int64())}) for a in range(0, len(key), step)]
        got = [t.column("k").to_pylist() for t in C.whole_groups(iter(batches), "k")]
        assert sum(got, []) == key and all(a[-1] != b[0] for a, b in zip(got, got[1:]))
