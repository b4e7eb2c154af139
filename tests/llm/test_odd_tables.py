"""Every operator and pipeline stage over nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import corpus_pipeline as P
import public_tokenizers
import pytest
from prefscale.llm import decontaminate, embedding_dedup, html_text, language_id, maxent_lm, ngram_join, packing, pii, suffix_dedup, toxicity

TOKENS = public_tokenizers.path("word_bpe_49k.json")
LONG = ("word " + "x" * 997 + " ") * 1000  # a million bytes
SAME = "equal words in every copy of this text, and enough of them to count for all that look at runs of them " * 3
CLASH = ["_row", "_hits", "_toxicity", "pii", "_found", "toxicity", "block", "score", "component_id", "n_links", "lang_pred", "id", "x", "u"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, SAME), (2, SAME), (2, SAME), (3, None), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG), (None, SAME), (None, None), (None, "mail a@b.org"), (-8, "été 漢字 🙂 \u0000 nul"), (9, "a"), (10, "a")]
    rows = [(*r, "en" if k % 2 else None, None if k % 3 else "src", None) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *(f"'kept' AS `{c}`" for c in CLASH)).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, SAME[:200]), (1, None), (None, "a"), (2, ""), (3, "mail a b org")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, None, None), (None, 1, 1), (6, 1, 0), (6, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")


def ops(docs, bench, labels):
    return {
        "op1": suffix_dedup.digest(docs),
        "op2": toxicity.digest(docs, labels),
        "op4": packing.digest(docs, TOKENS),
        "op5": ngram_join.classes(docs, words=3, percent=90),
        "op7": language_id.digest(docs),
        "op8": decontaminate.digest(docs, bench),
        "op9": maxent_lm.digest(docs),
        "op10": pii.digest(docs),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op7", "op8", "op9", "op10"])
def test_operators_give_every_row(spark, docs, bench, labels, name):
    got = ops(docs, bench, labels)[name].collect()
    want = [r.doc_id for r in docs.select("doc_id").collect()]
    have = [r.doc_id for r in got if name != "op4" or r.piece == 0]
    assert sorted(have, key=str) == sorted(want, key=str)
    none = docs.where("doc_id = 77")
    assert ops(none, bench, labels)[name].count() == 0
    for field in {"op2": ["held_out", "score", "predicted"], "op7": ["held_out", "lang_pred", "score"], "op9": ["held_out", "score", "base_score"]}.get(name, []):
        assert all(r[field] is not None for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(tuple(r)[1:])
    if name == "op1":  # the copies of 1 go but for their last bytes; equal rows are one document
        assert by[1][0][1] == 204 and by[2][0][1] == by[2][1][1] == len(SAME) and by[7][0][1] == len(LONG)
    if name == "op5":
        assert [x[1] for x in by[1] + by[2]] == [1, 1, 1] and by[7][0][1] == 6 and sorted(x[1] is None for x in by[None]) == [False, True, True] and by[10][0][1] == 9
    if name == "op8":
        assert by[1][0][1] > 0 and by[3][0][:2] == (0, 0)
    if name == "op10":
        assert sorted(x[0] for x in by[None]) == [0, 0, 1]


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [1.0]), (9, [1.0, 0.0, 0.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<float>, kept string").selectExpr("*", "1 AS id", "2 AS u", "3 AS root")
    got = sorted((tuple(r)[:4] for r in embedding_dedup.classes(df).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, True), *((k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 9))]
    assert got == sorted(want, key=str) and embedding_dedup.classes(df.where("vec_id = 99")).count() == 0


def test_pages(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "", ""), (3, "u", "<p>" + LONG), (4, "u", "<div " * 50_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, text string")
    assert sorted(((r.page_id, r.n_chars) for r in html_text.digest(df).collect()), key=str) == sorted([(1, 1), (1, 1), (None, 0), (2, 0), (3, len(LONG) - 1), (4, 0)], key=str)
    assert html_text.digest(df.where("page_id = 9")).count() == 0


def test_stages(spark, docs, bench, labels, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == "kept" for r in rows for c in CLASH) and stage(spark, docs.where("doc_id = 77"), str(tmp_path)).count() == 0, name
        ids = sorted((r.doc_id for r in rows), key=str)
        every = sorted((r.doc_id for r in docs.collect()), key=str)
        if name == "pii":
            assert ids == every and {r.text for r in rows if r.doc_id is None} == {None, SAME, "mail [EMAIL]"}
        elif name == "decontaminate":
            gone = {r.doc_id for r in decontaminate.digest(docs, bench).where("contaminated").collect()}
            assert {1, 2} <= gone and set(every) - gone <= set(ids)
        elif name == "ngram_join":
            assert sorted(x for x in ids if x is not None) == [-8, 1, 3, 3, 4, 5, 6, 9] and len(ids) == 10
        else:
            assert len(ids) > 0
    name, stage = P.STAGES[-1]
    assert stage(spark, docs, str(tmp_path)).where("piece = 0").count() == docs.count()
    assert stage(spark, docs.where("doc_id = 77"), str(tmp_path)).count() == 0
