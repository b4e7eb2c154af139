import random

import corpus_pipeline
import pytest
from prefscale.llm import packing, pii, toxicity
from tests.llm import test_decontaminate, test_ngram_join, test_packing


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["th", "er", "on", "ing", "an", "st", "ou"]) for _ in range(r.randint(1, 4)))
    bench = [(i, " ".join(word() for _ in range(25))) for i in range(5)]
    docs, labels = [], []
    for i in range(400):
        w = [word() for _ in range(r.choice([30, 120]))]
        toxic = int(i % 8 == 0)
        for _ in range(3 * toxic):
            w[r.randrange(len(w))] = r.choice(["loser", "idiot", "moron"])
        if i % 11 == 0:
            w[5:5] = bench[i % 5][1].split()
        if i % 7 == 0:
            w.append("a.b@mail1.example.com +1 (386) 555-3733")
        if i % 5 == 0 and i:
            w = docs[i - 3][1].split()
            w[0] = w[0] + "x"
        docs.append((i, " ".join(w), "en", "s", len(" ".join(w))))
        labels.append((i, 1, toxic))
    docs += [(400, None, None, None, None), (401, "", "en", "s", 0), (402, "l " * 20_000, "en", "s", 1), (403, docs[3][1], "fr", "t", 3), (403, docs[3][1], "fr", "t", 3)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, bench


def test_stages_are_their_brute_force(spark, tables):
    d, docs, bench = tables
    df = spark.read.parquet(f"{d}/documents.parquet")
    steps = [df]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], d).persist())
    rows = [[tuple(r) for r in s.collect()] for s in steps]
    assert all(s.columns == df.columns for s in steps[:-1])
    # toxicity: by the operator's own scores, which its tests judge
    model = toxicity.learned(df, spark.read.parquet(f"{d}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.judged(df, model).where("toxicity >= 0.5").collect()}
    assert sorted(rows[1], key=str) == sorted((r for r in rows[0] if r[0] not in bad), key=str) and len(bad) >= 40
    # near duplicates
    kept = {x for x, _, c in test_ngram_join.brute([r[:2] for r in rows[1]], 5, 80) if x == c}
    assert sorted({r[0] for r in rows[2]}) == sorted(kept) and len(rows[2]) == len(kept) < len(rows[1])
    # contamination
    hit = {x[0] for x in test_decontaminate.brute([r[:2] for r in rows[2]], bench) if x[5]}
    assert sorted(rows[3], key=str) == sorted((r for r in rows[2] if r[0] not in hit), key=str) and hit
    # personal data
    assert {r[0] for r in rows[4]} == {r[0] for r in rows[3]}
    for a, b in zip(sorted(rows[3], key=str), sorted(rows[4], key=str)):
        want = a[1] and a[1].replace("a.b@mail1.example.com", "[EMAIL]").replace("+1 (386) 555-3733", "[PHONE]")
        assert b == (a[0], want, *a[2:])
    # packing
    lengths = [r.length for r in steps[5].collect()]
    assert {r.doc_id for r in steps[5].collect()} == {r[0] for r in rows[4]}
    assert len({r.sequence_id for r in steps[5].collect()}) == len(test_packing.plain_best_fit(lengths, 4096))


def test_run_is_its_stages(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert out.columns[:5] == packing._PIECE.names and out.count() > 100
    assert pii.find(out.selectExpr("'x' as text")).count() == out.count()
