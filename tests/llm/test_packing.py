import random
import zlib

import numpy as np
import public_tokenizers
from prefscale.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in bins if r >= n]
        if fit:
            r = min(fit)
            bins.remove(r)
            bins.append(r - n)
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_runs_are_best_fit_decreasing():
    r = random.Random(1)
    for capacity in (1, 7, 64, 500):
        for _ in range(60):
            lengths = [r.randint(1, capacity) for _ in range(r.choice([0, 1, 5, 80, 400]))]
            counts = {n: lengths.count(n) for n in set(lengths)}
            runs, n_bins = P.best_fit_decreasing(counts, capacity)
            bins, placed = {}, {}
            for length, first, pieces, b, per, offset in runs:
                assert first == placed.get(length, 0)
                placed[length] = first + pieces
                for k in range(pieces):
                    bins.setdefault(b + k // per, []).append((offset + k % per * length, length))
            assert placed == counts and sorted(bins) == list(range(n_bins))
            for own in bins.values():
                at = 0
                for offset, length in sorted(own):
                    assert offset == at
                    at += length
                assert at <= capacity
            assert sorted(capacity - sum(n for _, n in own) for own in bins.values()) == plain_best_fit(lengths, capacity)


def docs():
    r = random.Random(2)
    texts = ["", None, "a", "<|endoftext|> x<|startoftext|>y", "It's 123 ÀÉ́ ﬃ \x1c\x85 Σας\t 'll", "\n\n  \n", "x" * 9000, "ok " * 5000]
    texts += [" ".join(r.choice(["the", "Der", "ñandú", "don't", "12", "…", "一二"]) for _ in range(r.randint(1, 6000))) for _ in range(30)]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again")]


def test_pieces_are_the_tokenizer_s(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    got = P.pieces(spark.createDataFrame(docs(), "doc_id long, text string"), PATH, 100, with_ids=True).collect()
    want = []
    for d, t in docs():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 100)):
            own = ids[at : at + 100]
            want.append((d, k, at, len(own), zlib.crc32(own.tobytes()), own.tolist()))
    assert sorted(map(tuple, got)) == sorted(want)


def test_small_cache_gives_the_same(monkeypatch):
    import pyarrow as pa
    from prefscale.llm import common as C

    small, large = P.Encoder(PATH), P.Encoder(PATH)
    for _ in range(2):
        for _, t in docs():
            rows = C.buffer_of(pa.array([t, "the x", t, None]))
            monkeypatch.setattr(P, "CACHE_WORDS", 3)
            a = small(*rows)
            monkeypatch.setattr(P, "CACHE_WORDS", 10**6)
            b = large(*rows)
            assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_digest_fills_sequences_without_gaps(spark):
    rows = P.digest(spark.createDataFrame(docs(), "doc_id long, text string"), PATH, 128).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by) == len(plain_best_fit([r.length for r in rows], 128))
    assert P.digest(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
