import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from prefscale.llm import suffix_dedup as S


def brute(docs, length=100):
    first, raw = {}, [(d, (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (d, i):
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ß\n") for _ in range(r.randint(1, 9)))
    base = ["".join(word() for _ in range(r.choice([3, 20, 60, 200]))) for _ in range(20)]
    lines = ["".join(word() for _ in range(k)) for k in (18, 20, 22, 30, 60)]
    out = []
    for _ in range(n):
        t = r.choice(base) if r.random() < 0.6 else "".join(word() for _ in range(80))
        for _ in range(r.choice([0, 1, 2])):
            i = r.randrange(len(t) + 1)
            t = t[:i] + r.choice([r.choice(lines), word(), t[:150]]) + t[i + r.choice([0, 1, 5]) :]
        out.append(t)
    out += [None, "", "a" * 99, "a" * 100, "a" * 101, "ab" * 400, "x" * 5_000]
    ids = list(range(len(out)))
    r.shuffle(ids)
    return list(zip(ids, out))


@pytest.mark.parametrize("seed,merge,slots,kinds", [(1, 1 << 22, 1 << 16, 1 << 12), (2, 2_000, 64, 3), (3, 1, 1, 1), (7, 1, 1 << 16, 2)])
def test_digest_is_brute_force(spark, monkeypatch, seed, merge, slots, kinds):
    monkeypatch.setattr(S, "MERGE_BYTES", merge)
    monkeypatch.setattr(S, "KINDS", kinds)
    monkeypatch.setattr(S, "REMEMBERED", slots)
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_bytes int")
    assert sorted(map(tuple, S.digest(df).collect())) == brute(docs)


def test_refined_merge_is_the_order_of_suffixes():
    r = np.random.default_rng(4)
    text = r.integers(97, 99, (40, 30)).astype(np.uint8)
    right = np.ascontiguousarray(text[:, 12:]).view("S18").ravel()
    for per in (40, 20, 7):
        parts = [S.Shard(right[a : a + per]) for a in range(0, 40, per)]
        z, place, lcp = S.merge(parts)
        order = np.array([parts[k].order[p] + k * per for k, p in zip(z, place)])
        for t in range(12):
            rows = [text[i, 12 - t :].tobytes() for i in order]
            assert rows == sorted(rows)
            for a, b, n in zip(rows, rows[1:], lcp[1:]):
                assert a[:n] == b[:n] and (n == len(a) or a[n] != b[n])
            order, lcp = S.refine(order, lcp, text[order, 11 - t].astype(np.int16))


def test_anchors_hit_every_window():
    r = np.random.default_rng(5)
    for buf in (r.integers(0, 3, 1000), np.zeros(300), r.integers(0, 255, 100)):
        pos, fp, ctx = S.anchors(buf.astype(np.uint8), 100, 32)
        for i in range(len(buf) - 99):
            assert ((pos >= i) & (pos <= i + 68)).any()


def test_sorted_stream_in_any_batches():
    import pyarrow as pa

    r = np.random.default_rng(6)
    rows = sorted((int(a), int(b), int(c), int(d)) for a, b, c, d in r.integers(0, 4, (200, 4)))
    want = Counter()
    for fp in {x[0] for x in rows}:
        kinds = sorted({x[1] for x in rows if x[0] == fp})
        for ctx in kinds:
            own = [x[2:] for x in rows if x[:2] == (fp, ctx)]
            part = kinds.index(ctx) // 3
            want.update([(None, part, *x) for x in own[1:] if x != own[0]] + [(fp, part, *own[0])] * (len(kinds) > 1))
    known = [(None, 0, 7, k) for k in range(5)]
    want.update((None, 0, 7, k) for k in range(5))
    for step in (1, 2, 3, 7, 50, 205):
        cols = [[x[k] for x in known + rows] for k in range(4)]
        it = (pa.RecordBatch.from_arrays([pa.array(c[a : a + step], pa.int64()) for c in cols], names=["fp", "ctx", "doc_id", "at"]) for a in range(0, 205, step))
        got = [tuple(x.values()) for b in S._repeats(it, 3) for x in b.to_pylist()]
        assert Counter(got) == want


@pytest.mark.parametrize("slots", [1, 8, 1 << 10])
def test_remembered_contexts_are_repeats_and_the_first_stays(slots):
    r = np.random.default_rng(slots)
    seen, rows, told, all_known = S.Remembered(slots), [], [], []
    least: dict[tuple, list] = {}
    for _ in range(30):
        part = r.integers(0, [3, 4, 30, 5], (40, 4))
        part[:, 1] += 4 * part[:, 0]  # with slots enough, each context has its own
        rows += map(tuple, part.tolist())
        told += seen.repeats(*part.T).tolist()
        for f, c, *place in part.tolist():
            least[f, c] = min(least.get((f, c), place), place)
        all_known += [place > least[f, c] for f, c, *place in part.tolist()]
    if slots > 8:
        assert told == all_known
    assert all(place > least[f, c] for (f, c, *place), again in zip(rows, told) if again)


def test_parts_of_an_anchor_meet_in_any_batches():
    import pyarrow as pa

    r = np.random.default_rng(8)
    rows = [(None, 5, k, k + 100) for k in range(4)] + sorted((*map(int, x), int(x[2]) + 100) for x in r.integers(0, 6, (150, 3)))
    least = {}
    for h, *place in rows:
        least.setdefault(h, place)
    want = Counter(tuple(x) for h, *x in rows if h is None or x[:2] != least[h][:2])
    for step in (1, 2, 9, 154):
        it = (pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows[a : a + step]], pa.int64()) for k in range(4)], names=["h", "doc_id", "at", "to"]) for a in range(0, 154, step))
        assert Counter(tuple(x.values()) for b in S._across(it) for x in b.to_pylist()) == want


def test_repeated_rows_and_empty(spark):
    t = "".join(chr(97 + i % 23) + str(i) for i in range(200))
    df = spark.createDataFrame([(1, t), (1, t), (1, "z" + t[::-1]), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in S.digest(df).collect())
    assert got == [(1, len(t), 0), (1, len(t), 0), (1, len(t) + 1, 0), (2, len(t), len(t))]
    assert S.digest(df.where("doc_id = 9")).count() == 0


def test_rows_without_an_id_stand_at_a_hash(spark):
    from pyspark.sql import functions as F

    docs = corpus(9, 60)
    docs = [(None if k % 3 == 0 else d, t) for k, (d, t) in enumerate(docs)]
    docs = [x for k, x in enumerate(docs) if x[0] is not None or x not in docs[:k]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    place = {(r.doc_id, r.text): r.p for r in df.withColumn("p", F.coalesce("doc_id", F.xxhash64("text"))).collect()}
    told = {d: x for d, *x in brute([(place[x], x[1]) for x in docs])}
    want = [(d, *told[place[d, t]]) for d, t in docs]
    assert sorted(map(tuple, S.digest(df).collect()), key=str) == sorted(want, key=str)
