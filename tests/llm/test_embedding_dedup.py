import logging

import numpy as np
import pytest
from prefscale.llm import embedding_dedup as E


def brute(rows, t=0.95):
    x = []
    for _, v in rows:
        a = np.array([np.nan if y is None else y for y in v], float) if v else np.zeros(4)
        ok = np.isfinite(a).all() and np.abs(a).max() > 0
        a = a / np.abs(a).max() if ok else np.full(len(a), np.nan)
        x.append(a / np.linalg.norm(a))
    n = len(rows)
    link = [[j for j in range(n) if j != i and len(x[i]) == len(x[j]) and x[i] @ x[j] >= t - 1e-12] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(link[i]), root, rows[i][0] == root))
    return sorted(out)


def vectors(n=700, dim=16):
    r = np.random.default_rng(6)
    base = r.normal(size=(n, dim))
    rows = []
    for i in range(n):
        v = base[i] if r.random() < 0.6 else base[r.integers(0, 60)] + r.normal(size=dim) * 0.12
        rows.append(v)
    rows += [base[3] * 2] * 40 + [base[4] + r.normal(size=dim) * 0.05 for _ in range(150)]
    ids = r.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(ids, rows)]


def test_classes_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL", 60)
    monkeypatch.setattr(E, "BLOCK", 64)
    monkeypatch.setattr(E, "MOST_CELL", 100)
    dim = 16
    rows = vectors(dim=dim)
    odd = [(9000, None), (9001, []), (9002, [0.0] * dim), (9003, [None] + [1.0] * (dim - 1)), (9004, [float("nan")] * dim), (9005, [float("inf")] + [0.0] * (dim - 1))]
    df = spark.createDataFrame([(*x, 1) for x in rows + odd], "vec_id long, embedding array<float>, n_links int")
    got = sorted(tuple(r)[:4] for r in E.classes(df).collect())
    want = sorted(brute(rows) + [(i, 0, i, True) for i, _ in odd])
    assert got == want


def test_odd_rows(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.99, 0.01, 0.0], [0.0, 1.0, 0.0]
    rows = [(7, a), (3, b), (7, c), (9, c), (3, b), (4, a[:2]), (5, a[:2]), (6, [1.0]), (8, [-1.0]), (10, [1e300, 1e300, 0.0]), (11, [1e-300, 1e-300, 0.0])]
    df = spark.createDataFrame([*rows, (None, a), (None, None), (None, a)], "vec_id long, embedding array<double>")
    got = [tuple(r)[:4] for r in E.classes(df).collect()]
    assert sorted(x for x in got if x[0] is not None) == brute(rows)
    assert [x for x in got if x[0] is None] == [(None, 0, None, True)] * 3


def test_a_large_tight_group_is_counted_by_its_core(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 50)
    monkeypatch.setattr(E, "MOST_CELL", 40)
    monkeypatch.setattr(E, "MOST_PART", 90)
    r = np.random.default_rng(9)
    centre = r.normal(size=24)
    rows = [(i, [float(x) for x in centre + r.normal(size=24) * w]) for i, w in enumerate([0.05] * 300 + [0.25] * 200)]
    got = sorted(tuple(x)[:4] for x in E.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == brute(rows)


def test_rounds_raise_recall(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL", 30)
    r = np.random.default_rng(8)
    x = r.normal(size=(500, 4)) @ r.normal(size=(4, 16))  # few true dimensions, as real embeddings have
    verts = E.unit_vectors(spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    u = {v.id: np.frombuffer(v.u) for v in verts.collect()}
    ids = list(u)
    s = np.stack([u[i] for i in ids])
    s = s @ s.T
    np.fill_diagonal(s, -2)
    best = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i])[:5]}

    def recall(rounds):
        g = E.neighbour_graph(verts, len(ids), 16, 1, k=8, tables=2, rounds=rounds).collect()
        return len(best & {(r.a, r.b) for r in g}) / len(best)

    low, high = recall(0), recall(4)
    assert high > low + 0.1 and high > 0.8, (low, high)


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (2, [2.0, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r)[:4] for r in E.classes(df).collect()) == [(2, 2, 2, True), (5, 2, 2, False), (5, 2, 2, False), (7, 0, 7, True)]
    assert E.classes(df.where("vec_id = 99")).count() == 0


def test_full_lists_still_meet_other_packs(spark):
    r = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v)
    hot = unit(r.normal(size=32))
    rows = []
    for _ in range(12):
        centre = unit(hot + 0.17 * unit(r.normal(size=32)))
        rows += [[float(np.float32(x)) for x in centre + 0.02 * unit(r.normal(size=32))] for _ in range(15)]
    rows += [[float(np.float32(x)) for x in r.normal(size=32)] for _ in range(60)]
    rows = list(enumerate(rows))
    got = sorted(tuple(r)[:4] for r in E.classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == brute(rows) and [g[1] for g in got[:180]] == [179] * 180


def test_tables_grow_with_the_bits():
    for n in (1, 2_000, 1_000_000, 20_000_000):
        meet = (1 - np.arccos(0.95) / np.pi) ** E._bits(n)
        assert (1 - meet) ** E.tables_of(n, 0.95) <= E.MISS and E.tables_of(n, 0.95) >= E.TABLES


def test_lost_links_are_told(spark, monkeypatch, caplog):
    # A large group, and small ones of which the graph loses all links: most queries lose theirs, most links are found.
    e = np.eye(40)
    rows = [(50 * i, [float(x) for x in e[0] + 0.01 * e[1 + i % 30] + 0.001 * i * e[31]]) for i in range(9)]
    rows += [(1000 * (i + 1) + 50 * j, [float(x) for x in e[i + 1] + 0.1 * j * e[0]]) for i in range(15) for j in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    with caplog.at_level(logging.INFO, logger=E.__name__):
        assert sorted(tuple(r)[:4] for r in E.classes(df).collect()) == brute(rows)
    assert "recall 1.0000 over 39 vectors" in caplog.text
    whole = E.neighbour_graph
    monkeypatch.setattr(E, "neighbour_graph", lambda *a, **k: whole(*a, **k).where("s > 0.998"))
    monkeypatch.setattr(E, "MOST_DRAWS", 1)
    with pytest.raises(RuntimeError, match="recall of links is 0.231 over 39"):
        E.classes(df)
