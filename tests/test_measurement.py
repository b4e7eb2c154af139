import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefscale.functions import decisions as D
from prefscale.functions import distributions as P
from prefscale.operators import agreement, alt_test, annotations, bt_alt_test, classify, costs, dawid_skene, graph, judge, laplacian, ordinal, pairing, reward, scoring
from prefscale.plans import registry
from prefscale.plans.session import Measurement, build
from prefscale.sources import tables
from prefscale.streaming import decisions as stream

CYCLE = [(f"item_{i % 8}", f"item_{(i + 1) % 8}", "Text1" if i % 2 == 0 else "Text2") for i in range(20)]


def long(spark, rows, cols="pair_id int, item1 string, item2 string, rater string, decision string"):
    return spark.createDataFrame(rows, cols)


def raters(spark, n=60, seed=1, names=("h1", "h2", "h3", "decision"), noise=(0.1, 0.2, 0.3, 0.1), ties=True):
    r = random.Random(seed)
    rows = []
    for p in range(n):
        a, b = r.sample(range(12), 2)
        for name, q in zip(names, noise):
            d = "Text1" if a > b else "Text2"
            d = r.choice(["Text1", "Text2"]) if r.random() < q else "Tie" if ties and abs(a - b) == 1 else d
            rows.append((p, f"i{a}", f"i{b}", name, None if r.random() < 0.1 and name != "decision" else d))
    return rows


# ---------------------------------------------------------------- pairing


@pytest.mark.parametrize("n,k", [(2, 1), (5, 2), (7, 3), (10, 3), (25, 10), (9, 8)])
def test_pair_degrees(spark, n, k):
    items = spark.range(n).select(F.concat(F.lit("x"), "id").alias("item_id"))
    p = [(r.item1, r.item2) for r in pairing.pair_items(items, k).collect()]
    deg = {}
    for a, b in p:
        assert a < b
        deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
    assert len(set(p)) == len(p) == math.ceil(n * k / 2)
    assert sorted(deg.values()) == sorted([k] * (n - n * k % 2) + [k + 1] * (n * k % 2))


def test_pairing_edges(spark):
    one = spark.createDataFrame([("a",)], "item_id string")
    assert pairing.pair_items(one).count() == 0
    with pytest.warns(UserWarning):
        assert pairing.pair_items(spark.range(4).withColumnRenamed("id", "item_id"), 10).count() == 6
    items = spark.range(40).withColumnRenamed("id", "item_id")
    p = pairing.generate_pairings(items, 4, make_splits=True, include_mixed=True, number_mixed=6).collect()
    assert {r.item1_split for r in p} == {"train", "eval", "test"}
    assert sum(r.item1_split != r.item2_split for r in p) == 6 and len({(r.item1, r.item2) for r in p}) == len(p)
    assert pairing.split_items(items).groupBy("split").count().where("split = 'test'").first()["count"] == 6
    with pytest.raises(ValueError):
        pairing.split_items(items, 0.5, 0.5)
    with pytest.raises(ValueError):
        pairing.new_pairs(items, items)


# ---------------------------------------------------------------- decisions and judges


def test_dialects(spark):
    df = spark.createDataFrame([(x,) for x in ("Text1", "Text2", "Tie", "tie", "0", "1", "2", "0.5", "1.0", "ERROR x", None)], "d string")
    want = {
        "score": ["Text1", "Text2", "Tie", "Tie", "Text1", "Text2", "Tie", "Tie", "Text2", None, None],
        "alt_test": ["Text1", "Text2", "Tie", None, "Text1", "Text2", None, "Tie", "Text2", None, None],
        "irr": ["Text1", "Text2", "Tie", "Tie", "Text1", "Text2", "Tie", None, "Text2", None, None],
        "transitivity": ["Text1", "Text2", "Tie", None, "Text2", "Text1", None, None, "Text1", None, None],
        "append": ["Text1", "Text2", "Tie", "tie", "Text1", "Text2", "2", "0.5", "Text2", "ERROR x", None],
        "reward": ["Text1", "Text2", None, None, None, "Text1", "Text2", None, "Text1", None, None],
    }
    for name, codes in want.items():
        assert [r[0] for r in df.select(D.normalize("d", name)).collect()] == codes, name


def test_answers(spark):
    df = spark.createDataFrame([("FINAL ANSWER: Description 2\nx",), ("**Final Answer**\n\nTIE",), ("so, Description 1!",), ("Description 1 or so",), ("the final answer: qualities",)], "r string")
    assert [r[0] for r in df.select(D.extract_answer(F.col("r"), True)).collect()] == ["Text2", "Tie", "Text1", None, "Tie"]
    assert [r[0] for r in df.select(D.extract_answer(F.col("r"), False, True)).collect()] == ["Text2", None, "Text1", "Text1", None]
    assert [r[0] for r in spark.createDataFrame([("a b  c",), (" ",), (None,)], "t string").select(D.token_estimate(F.col("t"))).collect()] == [3, 0, 0]
    assert D.score_column() == "Bradley_Terry_Score" and D.score_column("decision_x", "full") == "Bradley_Terry_Score_full_x"


@pytest.mark.parametrize("model,provider", [("gemini-2.5-flash", "google"), ("gpt-4o", "openai"), ("o3-mini", "openai"), ("claude-3-haiku", "anthropic"), ("llama3", "ollama"), ("x:7b", "ollama"), ("org/model", "huggingface"), ("gpt-oss", "ollama"), ("other", "ollama")])
def test_providers(model, provider):
    assert judge.provider_of(model) == provider


def test_reasoning():
    f = judge.reasoning_fields
    assert f("openai", True) == {"reasoning_effort": "medium"} and f("google", 5) == {"thinking_config": {"thinking_budget": 5}}
    assert f("anthropic", "high") == {"thinking": {"type": "adaptive"}, "output_config": {"effort": "high"}} and f("ollama", {"think": "low"}) == {"think": "low"}
    assert f("huggingface", {"a": 1}) == {"extra_body": {"a": 1}} and f("google", False)["thinking_config"] == {"thinking_budget": 0}
    for bad in (("anthropic", 5), ("ollama", {"x": 1})):
        with pytest.raises(ValueError):
            f(*bad)
    with pytest.raises(TypeError):
        f("openai", 3)


@pytest.mark.parametrize("provider, names", [("google", ["GEMINI_API_KEY", "GOOGLE_API_KEY", "GENAI_API_KEY"]), ("openai", ["OPENAI_API_KEY"]), ("anthropic", ["ANTHROPIC_API_KEY"]), ("huggingface", ["HUGGINGFACE_API_KEY", "HF_TOKEN"])])
def test_keys_in_order(monkeypatch, provider, names):
    for own in judge.KEY_VARIABLES.values():
        for v in own:
            monkeypatch.delenv(v, raising=False)
    with pytest.raises(ValueError, match=names[0]):
        judge.Judge("m", provider=provider)
    late = judge.Judge("m", provider=provider, check=False)
    with pytest.raises(ValueError, match="needs a key"):
        late.ask("x")
    assert judge.Judge("m", provider=provider, api_key="given").api_key == "given"
    for v in reversed(names):
        monkeypatch.setenv(v, v.lower())
        assert judge.Judge("m", provider=provider).api_key == v.lower()
    monkeypatch.setenv(names[0], "")
    if len(names) > 1:
        assert judge.Judge("m", provider=provider).api_key == names[1].lower()
    with pytest.raises(ValueError, match="unknown provider"):
        judge.Judge("m", provider="other")


def test_a_connector_is_made_once(monkeypatch):
    made = []
    monkeypatch.setattr(judge, "connector", lambda j: made.append(j) or (lambda *a, **k: "yes"))
    j = judge.Judge("only-once", provider="openai", api_key="k")
    assert [j.ask("a"), j.ask("b"), judge.Judge("only-once", provider="openai", api_key="k").ask("c")] == ["yes"] * 3 and len(made) == 1


def test_judge_retries_without_temperature():
    seen = []

    def send(prompt, system, temperature, max_tokens, **fields):
        seen.append(temperature)
        if temperature is not None:
            raise ValueError("temperature is not supported")
        return "ok"

    j = judge.Judge("gpt-x", send, api_key="k")
    with pytest.warns(UserWarning):
        assert j.ask("a") == "ok"
    assert j.ask("b") == "ok" and seen == [0.0, None, None]


def test_compare_asks_twice_and_keeps_errors(spark):
    def send(prompt, system, temperature, max_tokens, **fields):
        if "boom" in prompt:
            raise RuntimeError("boom")
        if "Which of" in prompt:
            return "Description 2, I say" if "hm" in prompt else "?"
        return "hm" if "hm" in prompt else "eh" if "eh" in prompt else "FINAL ANSWER: Description 1"

    df = spark.createDataFrame([("a", "b"), ("hm", "b"), ("eh", "b"), ("boom", "b")], "text1 string, text2 string")
    got = {r.text1: r.decision for r in judge.compare(df, judge.Judge("m", send), "x").collect()}
    assert got["a"] == "Text1" and got["hm"] == "Text2" and got["eh"].startswith("ERROR") and got["boom"] == "ERROR"
    with pytest.raises(ValueError):
        judge.comparison_prompt("a", "b", "c", template="{text1_breakdown}")
    with pytest.raises(ValueError):
        judge.check_prompts(["no text"])


def test_merge_human(spark):
    pairs = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f")], "item1 string, item2 string")
    ann = spark.createDataFrame([("a", "b", "h", "0", 0), ("d", "c", "h", "Text1", 1), ("c", "d", "h", "Text1", 2), ("a", "b", "h", None, 3)], "item1 string, item2 string, rater string, decision string, ord int")
    got = {(r.item1, r.item2): r.decision for r in annotations.merge_human(pairs, ann).collect()}
    assert got == {("a", "b"): None, ("c", "d"): "Text2", ("e", "f"): None}


# ---------------------------------------------------------------- scores


def test_bradley_terry_golden(spark):
    rows = [(i, a, b, "decision", d) for i, (a, b, d) in enumerate(CYCLE)]
    items = spark.createDataFrame([(f"item_{i}",) for i in range(8)], "item_id string")
    want = [0.991346, 0, 1, 0, 0.991346, 0.150319, 0.982210, 0.150319]
    for edges in (100, 0):
        got = {r.item_id: r for r in scoring.bradley_terry(long(spark, rows), items, driver_edges=edges).collect()} if edges else None
        if got:
            assert [round(got[f"item_{i}"].score, 6) for i in range(8)] == want and all(r.se > 0 for r in got.values())
    with pytest.raises(ValueError):
        scoring.bradley_terry(long(spark, rows), items, scale=(1, 0))


def test_bradley_terry_joins_agree(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    d = long(spark, [r for r in raters(spark, 30, ties=False) if r[4] and r[3] == "h1"])
    w = scoring.wins(d, by=("rater",)).toPandas()
    names = sorted(set(w.winner) | set(w.loser))
    items = spark.createDataFrame([(x,) for x in names], "item_id string")
    got = {r.item_id: r.raw for r in scoring._bradley_terry_joins(scoring.wins(d, by=("rater",)), items, "rater", None, "item_id", rounds=3).collect()}
    want = scoring.fit_bradley_terry(np.searchsorted(names, w.winner), np.searchsorted(names, w.loser), w.n.to_numpy(float), len(names), rounds=3)
    assert all(abs(got[x] - y) < 1e-9 for x, y in zip(names, want))


def test_fixed_point_residual():
    r = np.random.default_rng(1)
    w, l = r.integers(0, 30, 300), r.integers(0, 30, 300)
    w, l = w[w != l], l[w != l]
    s = np.exp(scoring.fit_bradley_terry(w, l, np.ones(len(w)), 30))
    s /= s.mean()
    f = 1 / (s[w] + s[l])
    flow = np.bincount(w, f * s[l], 30) - np.bincount(l, f * s[l], 30)
    assert np.abs(flow - 0.1 * 30 * (s - 1)).max() < 1e-8


def test_fits_that_don_t_converge_are_errors(monkeypatch):
    monkeypatch.setattr(scoring, "ROUNDS", 3)
    with pytest.raises(RuntimeError, match="still move"):
        scoring.fit_bradley_terry(np.array([0, 1, 2]), np.array([1, 2, 3]), np.array([9.0, 2.0, 5.0]), 4)
    scoring.fit_bradley_terry(np.array([0, 1, 2]), np.array([1, 2, 3]), np.array([9.0, 2.0, 5.0]), 4, rounds=3)


def test_davidson_is_the_likelihood_s_top():
    r = np.random.default_rng(2)
    true = r.normal(size=8)
    i, j = np.array([p for p in itertools.combinations(range(8), 2)]).T
    e = np.exp(true)
    d = e[i] + e[j] + 0.8 * np.sqrt(e[i] * e[j])
    wi, wj, t = 200 * e[i] / d, 200 * e[j] / d, 200 * 0.8 * np.sqrt(e[i] * e[j]) / d
    s, tau = scoring.fit_davidson(i, j, wi, wj, t, 8)
    assert np.abs(s - (true - true[0])).max() < 1e-4 and abs(tau - math.log(0.4)) < 1e-4
    s, _ = scoring.fit_davidson(np.array([0]), np.array([1]), np.array([3.0]), np.array([1.0]), np.array([0.0]), 3)
    assert s[2] == 0 and abs(s[0] - s[1] - math.log(3)) < 1e-6


def test_score_items_picks_models(spark):
    d = long(spark, raters(spark))
    items = spark.createDataFrame([(f"i{k}",) for k in range(13)], "item_id string")
    got = scoring.score_items(d.where("rater = 'h1' or (rater = 'h2' and decision <> 'Tie')"), items).collect()
    assert {(r.rater, r.model) for r in got} == {("h1", "Davidson"), ("h2", "Bradley_Terry")} and len(got) == 26
    assert all(0 <= r.score <= 1 for r in got)
    one = scoring.summarize(spark.createDataFrame([(float(x), str(x)) for x in range(5)], "score double, t string"), text="t").first()
    assert (one.mean, one.median, one.q25, one.top_text, one.bottom_text) == (2, 2, 1, "4", "0")


# ---------------------------------------------------------------- agreement


def test_transitivity_golden(spark):
    for third, want in ((("A", "C", "Text1"), (1.0, 0, 1)), (("C", "A", "Text1"), (0.0, 1, 1))):
        rows = [(0, "A", "B", "r", "Text1"), (1, "B", "C", "r", "Text1"), (2, *third[:2], "r", third[2])]
        r = agreement.transitivity(long(spark, rows)).first()
        assert (r.score, r.violations, r.triples) == want


def test_irr_golden(spark):
    cols = {"human1": "Text1 Text2 Text1 Tie Text2", "human2": "Text1 Text1 Text2 Tie Text1", "llm1": "Text1 Text2 Text1 Tie Text1", "llm2": "Text1 Text2 Text1 Tie Text1"}
    rows = [(i, "a", "b", c, d) for c, v in cols.items() for i, d in enumerate(v.split())]
    got = {r.group: r for r in agreement.irr(long(spark, rows), {"human": ["human1", "human2"], "llm": ["llm1", "llm2"], "all": list(cols)}).collect()}
    assert got["llm"].score == 1.0 and got["human"].method == "cohens_kappa" and got["all"].method == "krippendorff_alpha"
    a, b = (agreement.krippendorff_alpha(long(spark, rows), compat=c).first().alpha for c in (True, False))
    assert abs(a - (0.75 + 0.25 * b)) < 1e-9
    with pytest.raises(ValueError):
        agreement.krippendorff_alpha(long(spark, rows), "none")


def test_icc_of_equal_and_textbook_ratings(spark):
    m = [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]]
    rows = [(i, "a", "b", f"r{j}", str(v)) for i, r in enumerate(m) for j, v in enumerate(r)]
    got = agreement.icc(long(spark, rows), mapping={str(k): float(k) for k in range(11)}).first()
    assert abs(got.icc - 0.29) < 0.005 and abs(got.f_stat - 11.03) < 0.01 and got.p_value < 0.001


# ---------------------------------------------------------------- replacing raters


def test_distributions():
    assert abs(P.t_cdf(-2.228138851964939, 10) - 0.025) < 1e-10 and abs(P.t_cdf(1.0, 1) - 0.75) < 1e-12
    assert abs(P.f_sf(4.964602743730711, 1, 10) - 0.05) < 1e-9 and abs(P.f_ppf(0.95, 1, 10) - 4.9646027) < 1e-6
    assert P.t_test(3, -1.0, 0.0, 0.0) == 0.0 and math.isnan(P.t_test(3, 0.0, 0.0, 0.0))
    assert P.wilcoxon([1, 2, 3], "less") == 1.0 and P.wilcoxon([-1, -2, -3], "less") == 0.125 and P.wilcoxon([1, 2, 3], "two-sided") == 0.25
    assert abs(P.correlation(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]), "kendall") - 2 / 3) < 1e-12


@pytest.mark.parametrize("scoring_", ["accuracy", "neg_rmse"])
def test_alt_test_is_leave_one_out(spark, scoring_):
    rows = raters(spark, 80)
    d = long(spark, rows)
    v = {"Text1": 0.0, "Text2": 1.0, "Tie": 0.5}
    by = {}
    for p, _, _, r, x in rows:
        if x:
            by.setdefault(p, {})[r] = v[x]
    f = (lambda a, o: sum(a == y for y in o) / len(o)) if scoring_ == "accuracy" else (lambda a, o: -math.sqrt(sum((a - y) ** 2 for y in o) / len(o)))
    want = {}
    for own in by.values():
        llm, hum = own["decision"], {k: y for k, y in own.items() if k != "decision"}
        for h, y in hum.items():
            o = [z for k, z in hum.items() if k != h]
            if o:
                a, b = f(llm, o), f(y, o)
                want.setdefault(h, []).append((a >= b - 1e-12, b >= a - 1e-12))
    got = {r.rater: r for r in alt_test.stats(d.where("rater like 'h%'"), d.where("rater = 'decision'"), 1, scoring=scoring_).collect()}
    for h, x in want.items():
        assert got[h].n == len(x) and abs(got[h].advantage - np.mean([a for a, _ in x])) < 1e-12
        assert abs(got[h].mean_diff - np.mean([b - a for a, b in x])) < 1e-12


def test_alt_test_and_sweep(spark):
    d = long(spark, raters(spark, 200))
    h, m = d.where("rater like 'h%'"), d.where("rater = 'decision'")
    r = alt_test.alt_test(h, m, 0.2).first()
    assert r.tested == 3 and 0 <= r.winning_rate <= 1 and 0.5 < r.advantage <= 1
    s = alt_test.epsilon_sweep(h, m, -0.1, 0.25, 0.02).orderBy("epsilon").collect()
    assert len(s) == 19 and abs(s[-1].epsilon - 0.26) < 1e-9 and s[0].winning_rate <= s[-1].winning_rate
    with pytest.raises(ValueError):
        alt_test.stats(h, m, scoring="x")


def test_dawid_skene(spark):
    d = long(spark, raters(spark, 300, names=("h1", "h2", "h3", "decision"), noise=(0.1, 0.3, 0.8, 0.1), ties=False))
    got = {r.rater: r for r in dawid_skene.ranking(d, ["h1", "h2", "h3", "decision"], align=True).collect()}
    assert got["h1"].reliability > got["h2"].reliability > got["h3"].reliability and got["decision"].type == "LLM"
    t = dawid_skene.alt_test(d, ["h1", "h2", "h3"], "decision").collect()
    assert {r.rater for r in t} == {"h1", "h2", "h3"} and {r.rater: r.p_value for r in t}["h3"] < 0.01
    with pytest.raises(ValueError):
        dawid_skene.ranking(long(spark, raters(spark)), ["h1", "h2"])
    post, rel, conf, n = dawid_skene.fit(np.array([[0, 0, -1], [1, 1, 1], [0, -1, 0], [1, 0, -1], [-1, -1, -1]]), np.ones(5), seed=1)
    assert post.shape == (5, 2) and conf.shape == (3, 2, 2) and not np.isnan(post).any() and not np.isnan(rel).any() and n <= 100


def test_bt_alt_test(spark):
    r = random.Random(4)
    score = [r.gauss(0, 3) for _ in range(12)]
    rows = [(k, f"i{a}", f"i{b}", h, "Text1" if score[a] - score[b] + r.gauss(0, s) > 0 else "Text2") for k, (a, b) in enumerate(itertools.combinations(range(12), 2)) for h, s in (("h1", 1), ("h2", 1), ("decision", 1))]
    got = bt_alt_test.bt_alt_test(long(spark, rows), ["h1", "h2"], "decision", bootstraps=20).first()
    assert got.pivots == 2 and got.llm_human > 0.7 and got.ci_lo <= got.ci_hi and 0 <= got.advantage <= 1
    assert bt_alt_test.bt_alt_test(long(spark, rows), ["h1", "h2"], "decision", least_common=50).count() == 0
    with pytest.raises(ValueError):
        bt_alt_test.bt_alt_test(long(spark, rows), ["h1"], "decision")


# ---------------------------------------------------------------- ordinal ratings


def test_ordinal(spark):
    r = random.Random(3)
    rows = [(f"u{u}", i, r.randint(0, 5), k) for k, (u, i) in enumerate((u, i) for u in range(6) for i in r.sample(range(15), 8))]
    df = spark.createDataFrame(rows, "user string, item int, level int, k int")
    own = ordinal.levels(df, "item", "level", "user", "k")
    lv = {(x[1], x[0]): float(x[2]) for x in rows}
    mean = {i: np.mean([v for (j, _), v in lv.items() if j == i]) for i in {j for j, _ in lv}}
    shared = {tuple(sorted((a, b))) for u in range(6) for a, b in itertools.combinations([i for (i, x) in lv if x == f"u{u}"], 2)}
    assert {(x.item1, x.item2) for x in ordinal.candidate_pairs(own, "all", 1).collect()} == {p for p in shared if abs(mean[p[0]] - mean[p[1]]) >= 1}
    for method in ("random", "adjacent"):
        got = [(x.item1, x.item2) for x in ordinal.candidate_pairs(own, method, most=3).collect()]
        n = {i: sum(i in p for p in got) for i in mean}
        assert max(n.values()) <= 3 and len({tuple(sorted(p)) for p in got}) == len(got) and {tuple(sorted(p)) for p in got} <= shared
        free = [p for p in shared if p not in {tuple(sorted(q)) for q in got} and n[p[0]] < 3 and n[p[1]] < 3]
        assert not [p for p in free if method == "random" or abs(round(mean[p[0]]) - round(mean[p[1]])) == 1]
    d = ordinal.decisions(ordinal.shared_pairs(own), own).collect()
    assert all(x.decision == ("Text1" if lv[x.item1, x.rater] > lv[x.item2, x.rater] else "Text2" if lv[x.item1, x.rater] < lv[x.item2, x.rater] else "Tie") for x in d)
    p = ordinal.prune(ordinal.decisions(ordinal.shared_pairs(own), own), 2, 10)
    assert all(x["count"] >= 10 for x in p.groupBy("rater").count().collect()) and all(x["count"] >= 2 for x in p.groupBy("item1", "item2").count().collect())
    with pytest.raises(ValueError):
        ordinal.candidate_pairs(own, "none")


# ---------------------------------------------------------------- graph, classes, rewards


def test_graph(spark):
    d = long(spark, [(0, "a", "b", "r", "Text1"), (1, "b", "c", "r", "Text1"), (2, "c", "a", "r", "Text2"), (3, "x", "y", "r", "Tie"), (4, "d", "c", "r", "0")])
    assert {r.id: r.component for r in graph.components(d).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    assert graph.largest_component(d).count() == 4
    e = graph.directed(d)
    assert {(r.src, r.dst) for r in e.collect()} == {("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")}
    pr = {r.id: r.pagerank for r in graph.pagerank(e).collect()}
    assert abs(sum(pr.values()) - 1) < 1e-6 and max(pr, key=pr.get) == "c"
    assert {r.id: r.betweenness for r in graph.betweenness(e).collect()}["a"] == 0
    line = spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")
    assert {r.id: r.betweenness for r in graph.betweenness(line).collect()} == {1: 0, 2: 0.5, 3: 0}
    assert {r.id: (r.out_degree, r.in_degree) for r in graph.degrees(e).collect()}["c"] == (0, 3)
    assert graph.eigenvector(e, rounds=5).count() == 4


def test_classes(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([0, 0.1, 5, 5.1, 9, 9.2])] + [(9, None)], "item_id int, score double")
    got = {r.item_id: r.cluster for r in classify.classify(df).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 9: -1}
    assert {r.cluster for r in classify.classify(df, method="mean").collect()} == {0, 1, -1}
    assert {r.cluster for r in classify.classify(df, method="gmm", classes=2).collect()} == {0, 1, -1}
    assert [r.row for r in classify.dotplot(df).orderBy("score").collect()] == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        classify.classify(df, method="x")


def test_costs(spark):
    items = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    assert costs.price_of("gpt-5-mini-2025") == (0.25, 2.0) and costs.price_of("gpt-5") == (1.25, 10.0)
    assert all(costs.price_of(f"x/{name.upper()}@y") == price for name, price in costs.PRICES.items()) and len(costs.PRICES) == 60
    assert costs.price_of("gpt-5.6-sol") == (4.0, 20.0) and costs.price_of("unknown") is None
    r = costs.estimate(items, None, ["gpt-5"], ["p {text}"], "breakdown").first()
    assert r.tokens_out == 200 and r.cost > 0
    with pytest.raises(ValueError):
        costs.estimate(items, None, ["llama3"], ["p"])


def test_reward(spark, tmp_path):
    r = random.Random(5)
    texts = [(f"i{k}", " ".join(["good"] * k + ["bad"] * (10 - k) + [r.choice("abc")])) for k in range(11)]
    d = [(0, f"i{a}", f"i{b}", "h", "Text1" if a > b else "Text2") for a, b in itertools.permutations(range(11), 2)]
    p = reward.reward_pairs(long(spark, d), spark.createDataFrame(texts, "item_id string, text string"))
    assert reward.split_pairs(p).select("split").distinct().count() == 3
    m = reward.RewardModel(256).fit(p)
    e = m.evaluate(p.withColumn("margin", F.rand(1))).first()
    assert e.accuracy > 0.95 and e.loss < 0.69
    m.save(str(tmp_path / "m"))
    a, b = (reward.rescaled(x.score(spark.createDataFrame(texts, "item_id string, text string"))).orderBy("item_id").collect() for x in (m, reward.RewardModel.load(str(tmp_path / "m"))))
    assert a == b and min(x.reward for x in a) == 0


# ---------------------------------------------------------------- the whole


def test_session(spark, tmp_path):
    data = spark.createDataFrame([(f"item_{i}", "word " * (i + 1)) for i in range(10)], "id string, body string")
    m = Measurement("length", data, "id", "body", judges=[judge.Judge("offline", judge.offline_send)], save_dir=str(tmp_path / "run"))
    assert m.renamed == {"id": "item_id", "body": "text"}
    m.set_prompts(["Read {text}"])
    assert build(m, 4, ties=True) == {} and m.pairwise.count() == 20
    human = m.pairwise.select(F.col("item2").alias("item1"), F.col("item1").alias("item2"), F.when(F.col("decision") == "Text1", "1").otherwise("0").alias("human_a"))
    m.append_human(human)
    with pytest.raises(ValueError):
        m.append_human(human)
    k = m._of(["decision", "human_a"])
    assert agreement.cohen_kappa(k, "decision", "human_a").first().observed == 1.0
    s = {r.item_id: r.score for r in m.score().where("rater = 'decision'").collect()}
    assert s["item_9"] > s["item_0"] and m.transitivity().count() == 2
    n = m.add_items(spark.createDataFrame([("item_99", "word " * 50)], "item_id string, text string"), ties=True)
    assert {r.item_id: r.score for r in n.where("rater = 'decision'").collect()}["item_99"] > 0.9
    m.save()
    again = Measurement.load(spark, str(tmp_path / "run"))
    assert again.pairwise.count() == m.pairwise.count() and again.judges[0].model == "offline" and again.models == ["decision"]
    assert again.breakdowns.count() == m.breakdowns.count() == 11 - 1 and again.pairs.count() == m.pairs.count()
    n = again.pairwise.count()
    again.save(str(tmp_path / "run"))
    again.classify("decision", classes=2)
    again.save(str(tmp_path / "run"))
    third = Measurement.load(spark, str(tmp_path / "run"))
    assert third.data.count() == 11 and third.pairwise.count() == n and third.scored.where("cluster is not null").count() == 11
    assert again.alt_test(all_models=True, least_humans=1).count() == 1
    assert m.test_clients("x") == {"offline": True} and m.clients_info(spark).count() == 1
    assert m.network().count() == 11 and m.estimate_costs(price=(1.0, 1.0)).count() == 2 and m.wide().columns == ["item1", "item2", "human_a", "decision"]
    with pytest.raises(IndexError):
        m.pick(3)
    with pytest.raises(ValueError):
        Measurement("", data)
    with pytest.raises(ValueError):
        Measurement("x", data)


def test_from_pairs_and_sources(spark, tmp_path):
    t = spark.createDataFrame([("a", "b", "x", "yy", "Text1", "Text2")], "r1 string, r2 string, t1 string, t2 string, decision_h string, m string")
    with pytest.warns(UserWarning):
        m = Measurement.from_pairs("c", t, ("r1", "r2"), ("t1", "t2"), ["decision_h"], ["m"])
    assert m.humans == ["annotator_decision_h"] and m.models == ["decision_m"] and m.pairwise.count() == 2 and m.data.count() == 2
    t.toPandas().to_csv(tmp_path / "a.csv", index=False)
    assert tables.read_annotations(spark, str(tmp_path / "a.csv")).count() == 1
    for path, error in (("x.txt", ValueError), (str(tmp_path / "no.csv"), FileNotFoundError)):
        with pytest.raises(error):
            tables.read_annotations(spark, path)
    for path, error in (("x.pkl", ValueError), (str(tmp_path), FileNotFoundError)):
        with pytest.raises(error):
            tables.load_run(spark, path)
    tables.save_run("file://" + str(tmp_path / "r"), {"models": ["a"], "api_keys": ["s"]}, {"data": m.data})
    meta, got = tables.load_run(spark, str(tmp_path / "r"))
    assert "api_keys" not in meta and meta["version"] == "1.0" and got["scored"] is None
    with pytest.raises(ValueError):
        tables.load_run(spark, str(tmp_path / "r"), api_keys=["a", "b"])


def test_stream_of_decisions(spark, tmp_path):
    d = long(spark, raters(spark))
    d.write.parquet(str(tmp_path / "in"))
    q = stream.win_counts(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = stream.totals(spark.read.parquet(str(tmp_path / "out"))).agg(F.sum("n")).first()[0]
    assert got == scoring.wins(d).agg(F.sum("n")).first()[0]


def test_entry_imports():
    import __spark_entry__ as e

    assert "bt_scores" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_components_of_long_chains_take_few_rounds(spark, monkeypatch, local):
    """Ordered chains were shortened by two nodes a round."""
    cut, seen = graph.checkpointed, []
    monkeypatch.setattr(graph, "checkpointed", lambda df: seen.append(1) or cut(df))
    e = spark.range(1, 400).where("id % 100 <> 0").select(F.col("id").alias("item1"), (F.col("id") - 1).alias("item2"))
    e = e.union(spark.createDataFrame([(500, 500), (None, 7)], "item1 long, item2 long"))
    got = {r.id: r.component for r in graph.components(e, local_edges=local).collect()}
    want = {k: k // 100 * 100 for k in range(400)} | {500: 500}
    assert {k: got[k] for k in want} == want and len(seen) < 20


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_capped_pairs_are_those_of_a_scan_and_are_not_stored_as_a_whole(spark, monkeypatch, local):
    """All candidates were stored at the start, and for every round again."""
    cut, stored = ordinal.checkpointed, []
    monkeypatch.setattr(ordinal, "checkpointed", lambda df: (out := cut(df), stored.append(out.count()))[0])
    c = spark.range(60).select(F.col("id").alias("item1")).crossJoin(spark.range(60, 120).select(F.col("id").alias("item2")))
    c = c.withColumns({"level1": F.col("item1") * 1.0, "level2": F.lit(0.0)})
    order = c.select("item1", "item2").orderBy(pairing.order_key(7, "item1", "item2")).collect()
    has, want = {}, set()
    for a, b in order:
        if has.get(a, 0) < 2 and has.get(b, 0) < 2:
            has[a], has[b] = has.get(a, 0) + 1, has.get(b, 0) + 1
            want.add((a, b))
    got = [(r.item1, r.item2) for r in ordinal._capped(c, 2, 7, local).collect()]
    assert len(got) == len(want) and set(got) == want and max(stored) < 1000
    stored.clear()
    assert ordinal._capped(c, 60, 7, local).count() == 3600 and not stored


def test_a_cap_above_the_number_of_items_asks_for_no_scan(spark, monkeypatch):
    monkeypatch.setattr(ordinal, "_capped", lambda *a: pytest.fail("candidates were counted or stored"))
    own = ordinal.levels(spark.range(6).select("id", (F.col("id") % 2).alias("v")), "id", "v")
    assert ordinal.candidate_pairs(own, "adjacent", most=6).count() == 9
    assert ordinal.candidate_pairs(own, "random", 1, most=6).count() == 9


def test_decisions_on_all_pairs_are_those_on_shared_pairs(spark):
    r = random.Random(3)
    own = spark.createDataFrame([(i, a, float(r.randint(1, 4))) for i in range(15) for a in "uvw" if r.random() < 0.6] + [(99, None, 1.0)], "item long, annotator string, level double")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(ordinal.decisions(None, own)) == rows(ordinal.decisions(ordinal.shared_pairs(own), own))
    assert "Aggregate" not in ordinal.decisions(None, own)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("rows", [7, 150_000])
def test_shared_pairs_are_whole_and_neither_shuffled_nor_stored(spark, monkeypatch, kind, rows):
    """Pairs were made distinct by a shuffle of every pair of every annotator."""
    r = random.Random(5)
    lv = {(i, a): r.randint(1, 9) * 1.0 for i in range(40) for a in "uvwxyz" if r.random() < 0.4} | {(i, "t"): 2.0 for i in (60, 61)}
    lv[62, "lone"] = lv[63, None] = lv[None, "u"] = 5.0
    own = spark.createDataFrame([(i, a, v) for (i, a), v in lv.items()], "item long, annotator string, level double").withColumn("item", F.col("item").cast(kind))
    own = own.union(own.where("item = 60"))
    monkeypatch.setattr(ordinal, "BATCH_PAIRS", 5)
    name = (lambda i: i) if kind == "long" else str
    mean = {name(i): np.mean([v for (j, _), v in lv.items() if j == i]) for i in {i for i, _ in lv} - {None}}
    want = {tuple(sorted((name(i), name(j)))) for (i, a), (j, b) in itertools.combinations([x for x in lv if x[0] is not None and x[1]], 2) if a == b}
    cut, stored = ordinal.checkpointed, []
    monkeypatch.setattr(ordinal, "checkpointed", lambda df: (out := cut(df), stored.append(out.count()))[0])
    for gap in (0, 1.5):
        c = ordinal._shared(own, ordinal._rated_levels(own), gap, rows)
        got = [(x.item1, x.item2, x.level1, x.level2) for x in c.collect()]
        assert len(got) == len(set(got)) and {x[:2] for x in got} == {p for p in want if abs(mean[p[0]] - mean[p[1]]) >= gap}
        assert all(x[2:] == (mean[x[0]], mean[x[1]]) for x in got)
        assert "Aggregate" not in c._jdf.queryExecution().optimizedPlan().toString()
    assert max(stored) <= len(lv) < len(want)
    assert sorted((x.item1, x.item2) for x in ordinal.shared_pairs(own).collect()) == sorted(want)
    assert ordinal.shared_pairs(own.where("annotator is null")).isEmpty()


def test_more_ranges_make_no_more_blocks(spark, monkeypatch):
    """Every range was a block, so that pairs of blocks grew with the square of the ranges."""
    own = spark.range(300).select(F.col("id").alias("item"), (F.col("id") % 3).alias("annotator"), F.lit(1.0).alias("level"))
    ranges = type(own).repartitionByRange
    monkeypatch.setattr(type(own), "repartitionByRange", lambda self, n, *c: ranges(self, max(n, 60), *c))
    c = ordinal._shared(own, ordinal._rated_levels(own), 0, 100)
    assert c.rdd.getNumPartitions() == 6
    assert sorted((x.item1, x.item2) for x in c.collect()) == [(i, j) for i in range(300) for j in range(i + 3, 300, 3)]


def test_half_up_is_round(spark):
    r = random.Random(1)
    v = [k / 2 for k in range(60)] + [np.nextafter(k / 2, d) for k in range(1, 60) for d in (0, 99)] + [r.uniform(0, 50) for _ in range(500)] + [1e300, math.inf, math.nan]
    x = spark.createDataFrame([(float(y),) for y in v], "x double")
    assert x.select(registry._half_up(F.col("x")).alias("x")).exceptAll(x.select(F.round("x"))).isEmpty()


def test_davidson_takes_raters_of_more_pairs_than_joins_begin_at(spark, monkeypatch):
    """Beyond so many pairs, it was an error."""
    d, items = long(spark, raters(spark)), spark.range(12).select(F.concat(F.lit("i"), "id").alias("item_id"))
    want = sorted(map(tuple, scoring.davidson(d, items).collect()))
    monkeypatch.setattr(scoring, "DRIVER_EDGES", 3)
    assert sorted(map(tuple, scoring.davidson(d, items).collect())) == want and len(want) == 48


def circle(n: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Pairs of items five steps on a circle or less, of which the longer wins but for 5 %, and near ones tie."""
    r = np.random.default_rng(seed)
    size, on = r.integers(0, 1000, n), r.permutation(n)
    i, j = np.concatenate([on] * 5), np.concatenate([np.roll(on, -s) for s in range(1, 6)])
    tie, first = np.abs(size[i] - size[j]) <= 25, (size[i] > size[j]) ^ (r.random(len(i)) < 0.05)
    return i, j, first & ~tie, ~first & ~tie, tie


def test_davidson_fits_of_long_circles_end_at_the_top():
    """Steps of single items pass the strengths on along the circle so slowly that the fit took 5,000 and ended below."""
    n = 4000
    i, j, wi, wj, t = (x.astype(float) if x.dtype == bool else x for x in circle(n))
    s, tau = scoring.fit_davidson(i, j, wi, wj, t, n)
    u = (s[i] - s[j]) / 2
    top = np.logaddexp(np.logaddexp(u, -u), tau + math.log(2))
    p, e = np.exp(u - top), np.exp(tau + math.log(2) - top)
    left = wi + t / 2 - p - e / 2
    assert np.abs(np.bincount(i, left, n) - np.bincount(j, left, n)).max() < 5e-4
    assert abs(t.sum() - e.sum()) < 5e-4 and s[0] == 0


def test_davidson_doesn_t_depend_on_the_order_of_pairs():
    i, j, wi, wj, t = (x.astype(float) if x.dtype == bool else x for x in circle(500, 3))
    at = np.random.default_rng(1).permutation(len(i))
    a, tau = scoring.fit_davidson(i, j, wi, wj, t, 500)
    b, other = scoring.fit_davidson(i[at], j[at], wi[at], wj[at], t[at], 500)
    c, third = scoring.fit_davidson(j, i, wj, wi, t, 500)
    assert np.abs(a - b).max() < 1e-6 and abs(tau - other) < 1e-9
    assert np.abs(a - c).max() < 1e-6 and abs(tau - third) < 1e-9


def test_davidson_parts_of_a_graph():
    """The first item is 0, in other parts the mean is; items without comparisons are 0."""
    i, j, one, none = np.array([0, 2, 3, 5]), np.array([1, 3, 4, 5]), np.array([2.0, 2.0, 3.0, 1.0]), np.array([1.0, 1.0, 1.0, 1.0])
    s, _ = scoring.fit_davidson(i, j, one, none, none, 7)
    assert s[0] == 0 and s[1] < 0 and abs(s[2:5].sum()) < 1e-9 and s[2] > s[3] > s[4] and s[5] == s[6] == 0


@pytest.mark.parametrize("most", [None, 0])
def test_laplacian_is_solved(most):
    r = np.random.default_rng(5)
    for n, m in ((1, 0), (2, 1), (60, 45), (61, 90), (300, 300)):
        i, j = r.integers(0, n, m), r.integers(0, n, m)
        i, j = np.concatenate([i, i[:9]]), np.concatenate([j, j[:9]])
        _, level = laplacian.levels(i, j, n)
        order = np.argsort(level, kind="stable")
        place = np.argsort(order)
        i, j = place[i], place[j]
        w, full = r.uniform(0.1, 2, len(i)), 1e-3 * np.eye(n)
        for a, b, x in zip(i, j, w):
            if a != b:
                full[[a, b], [a, b]] += x
                full[[a, b], [b, a]] -= x
        right = full @ r.normal(size=(n, 2))
        got = laplacian.Laplacian(i, j, level[order], most)
        assert got.narrow == (most is None) and np.abs(full @ got.solve(w, right, 1e-3) - right).max() < 1e-8


def test_davidson_counts_pairs_that_are_judged_often(spark, monkeypatch):
    rows = [(k, "a", "b", "h", "Text1" if k % 3 else "Text2") for k in range(60)] + [(k, "b", "c", "h", "Tie" if k % 2 else "Text1") for k in range(60)] + [(0, None, "c", "h", "Text1")]
    d, items = long(spark, rows), spark.createDataFrame([(x,) for x in "abcd"], "item_id string")
    want = {r.item_id: r.raw for r in scoring.davidson(d, items).collect()}
    raw, _ = scoring.fit_davidson(np.array([0, 1]), np.array([1, 2]), np.array([40, 30]), np.array([20, 0]), np.array([0, 30]), 4)
    assert all(abs(want[k] - x) < 1e-6 for k, x in zip("abcd", raw)) and len(want) == 4
    monkeypatch.setattr(scoring, "PAIRS_AT_ONCE", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.item_id: r.raw for r in scoring.davidson(d, items).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bt_alt_test_scores_each_rater_on_its_own_items(spark):
    """Of a rater whose pairs fall apart only the largest part is scored, in one pass for all raters; before, each rater
    took searches for components of its own."""
    r = random.Random(8)
    score = [r.gauss(0, 2) for _ in range(50)]

    def judged(h: str, pairs: list) -> list:
        return [(0, f"i{a:02}", f"i{b:02}", h, "Tie" if r.random() < 0.2 else "Text1" if score[a] + r.gauss(0, 1) > score[b] else "Text2") for a, b in pairs]

    near = [(a, b) for a in range(50) for b in range(a + 1, min(a + 6, 50))]
    apart = [(a, b) for a, b in near if (a < 20) == (b < 20)]
    rows = judged("h1", near) + judged("h2", apart) + judged("h3", near) + [(0, "i01", "i02", "other", "Text1")]
    got = bt_alt_test.rater_scores(long(spark, rows), ["h1", "h2", "h3"]).collect()
    own = {h: {x.item_id for x in got if x.rater == h} for h in ("h1", "h2", "h3")}
    assert len(got) == 130 and len(own["h1"]) == len(own["h3"]) == 50 and own["h2"] == {f"i{k}" for k in range(20, 50)}
    alone = scoring.score_items(long(spark, [x for x in rows if x[3] == "h2" and x[1] >= "i20"]), spark.createDataFrame([(x,) for x in sorted(own["h2"])], "item_id string"), scale=None)
    want = {x.item_id: x.raw for x in alone.collect()}
    assert all(abs(want[x.item_id] - x.raw) < 1e-6 for x in got if x.rater == "h2")
    few = [x for x in rows if x[3] != "h2" or x[1] < "i10" or x[1] > "i45"]
    with pytest.raises(ValueError, match="h2 fall apart"):
        bt_alt_test.rater_scores(long(spark, few), ["h1", "h2", "h3"])


def test_ranks_of_a_rater_are_taken_once(monkeypatch):
    """Before, both columns were ranked anew for each pair of raters, in either order."""
    taken, ranks = [], bt_alt_test.P.average_ranks
    monkeypatch.setattr(bt_alt_test.P, "average_ranks", lambda x: taken.append(1) or ranks(x))
    wide = np.random.default_rng(3).normal(size=(40, 5))
    lh, hh = bt_alt_test._pivots(wide, 4, "spearman", 10)
    assert len(taken) == 5 and len(lh) == len(hh) == 4
    want = [np.mean([bt_alt_test.P.correlation(wide[:, i], wide[:, j], "spearman") for j in range(4) if j != i]) for i in range(4)]
    assert np.allclose(hh, want, atol=1e-12)


def test_score_items_of_a_long_circle_are_at_the_top(spark):
    """Before, the fit ended after 5,000 steps, with up to 3e-3 of an item's score not accounted for."""
    n = 4000
    i, j, wi, _, t = circle(n)
    rows = [(0, f"{a:04}", f"{b:04}", "h", "Tie" if c else "Text1" if w else "Text2") for a, b, w, c in zip(i.tolist(), j.tolist(), wi, t)]
    got = scoring.score_items(long(spark, rows), spark.createDataFrame([(f"{k:04}",) for k in range(n)], "item_id string"), scale=None).orderBy("item_id").collect()
    _, tau = scoring.fit_davidson(i, j, *(x.astype(float) for x in (wi, ~wi & ~t, t)), n)
    s = np.array([r.raw for r in got])
    u = (s[i] - s[j]) / 2
    top = np.logaddexp(np.logaddexp(u, -u), tau + math.log(2))
    left = wi + t / 2 - np.exp(u - top) - np.exp(tau + math.log(2) - top) / 2
    assert {r.model for r in got} == {"Davidson"} and np.abs(np.bincount(i, left, n) - np.bincount(j, left, n)).max() < 5e-4
