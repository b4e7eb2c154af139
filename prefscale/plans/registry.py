"""Named queries over the test tables, and the SQL that gives the same rows.

Items are documents; pairs come from the pairing graph; four people and two models judge by length, each with its own
share of slips that a hash decides, so that any engine gives the same decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefscale.functions import decisions as D
from prefscale.operators import agreement, alt_test, annotations, bt_alt_test, classify, costs, dawid_skene, graph, judge, ordinal, pairing, reward, scoring

HUMANS = {"human_1": 5, "human_2": 12, "human_3": 20, "human_4": 30}
MODELS = {"decision": 8, "decision_b": 35}
RATERS = HUMANS | MODELS
MISSING = 10
NEAR = 25

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- shared inputs


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("n_chars").cast("double").alias("score"), "text")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_items(items(spark, d), 10)


def _hash(at: int, *cols):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), at, 8), 16, 10).cast("long")


def decided(spark: SparkSession, d: str, raters: dict[str, int] = RATERS) -> DataFrame:
    n = items(spark, d).groupBy("item_id").agg(F.max("score").alias("score"))
    p = pairs(spark, d)
    for k in ("1", "2"):
        p = p.join(n.select(F.col("item_id").alias(f"item{k}"), F.col("score").alias(f"n{k}")), f"item{k}")
    r = F.explode(F.array(*(F.struct(F.lit(x).alias("rater"), F.lit(y).alias("noise")) for x, y in raters.items()))).alias("r")
    p = p.select("item1", "item2", "n1", "n2", r).select("*", "r.*")
    key = ("rater", F.col("item1").cast("string"), F.col("item2").cast("string"))
    own = F.when(F.abs(F.col("n1") - F.col("n2")) <= NEAR, "Tie").when(F.col("n1") > F.col("n2"), "Text1").otherwise("Text2")
    slip, gone = _hash(1, *key) % 100 < F.col("noise"), _hash(9, *key) % 100 < MISSING
    decision = F.when(gone & F.col("rater").startswith("human"), F.lit(None)).when(slip, D.swapped(own)).otherwise(own)
    pair_id = F.md5(F.concat_ws("|", F.col("item1").cast("string"), F.col("item2").cast("string")))
    # Most queries read decisions several times.
    return graph.checkpointed(p.select(pair_id.alias("pair_id"), "item1", "item2", "rater", decision.alias("decision")))


def untied(spark: SparkSession, d: str) -> DataFrame:
    return decided(spark, d).where("decision in ('Text1', 'Text2')")


def _pos(seed: int, ids: str, table_: str) -> str:
    return f"SELECT {ids} AS id, row_number() OVER (ORDER BY md5('{seed}|' || {ids}), {ids}) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT {ids} FROM {table_})"


PAIRS_SQL = f"""pos AS ({_pos(42, 'doc_id', 'documents')}),
pairs AS (SELECT least(a.id, b.id) AS item1, greatest(a.id, b.id) AS item2 FROM (SELECT *, unnest(range(1, 6)) AS step FROM pos) a JOIN pos b ON b.pos = (a.pos + a.step) % a.n)"""
DECISIONS_SQL = f"""{PAIRS_SQL},
len_ AS (SELECT doc_id, max(n_chars) AS n FROM documents GROUP BY doc_id),
raters AS (SELECT * FROM (VALUES {', '.join(f"('{r}', {n})" for r, n in RATERS.items())}) t(rater, noise)),
base AS (SELECT item1, item2, rater, noise, md5(rater || '|' || item1 || '|' || item2) AS h,
         CASE WHEN abs(a.n - b.n) <= {NEAR} THEN 'Tie' WHEN a.n > b.n THEN 'Text1' ELSE 'Text2' END AS own
         FROM pairs JOIN len_ a ON a.doc_id = item1 JOIN len_ b ON b.doc_id = item2 CROSS JOIN raters),
decided AS (SELECT md5(item1 || '|' || item2) AS pair_id, item1, item2, rater,
  CASE WHEN rater LIKE 'human%' AND CAST('0x' || substr(h, 9, 8) AS BIGINT) % 100 < {MISSING} THEN NULL
       WHEN CAST('0x' || substr(h, 1, 8) AS BIGINT) % 100 < noise THEN CASE own WHEN 'Text1' THEN 'Text2' WHEN 'Text2' THEN 'Text1' ELSE own END
       ELSE own END AS decision FROM base)"""


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + F.lit(0.0), 6) for c in cols})


# ---------------------------------------------------------------- pairing


@query(f"WITH {PAIRS_SQL} SELECT item1, item2 FROM pairs")
def pair_items_k10(spark, d):
    return pairs(spark, d)


@query(f"""WITH pos AS ({_pos(42, 'doc_id', 'documents')}),
e AS (SELECT id, n, (pos + 1) % n AS p FROM pos UNION ALL SELECT id, n, (pos + n // 2) % n FROM pos WHERE n % 2 = 0 AND pos < n // 2
      UNION ALL SELECT id, n, (pos + (n - 1) // 2) % n FROM pos WHERE n % 2 = 1 AND pos <= (n - 1) // 2)
SELECT least(e.id, b.id) AS item1, greatest(e.id, b.id) AS item2 FROM e JOIN pos b ON b.pos = e.p""")
def pair_items_k3(spark, d):
    return pairing.pair_items(items(spark, d), 3)


@query(f"""WITH pos AS ({_pos(7, 'n_nationkey', 'nation')}),
e AS (SELECT id, n, (pos + 1) % n AS p FROM pos UNION ALL SELECT id, n, (pos + (n - 1) // 2) % n FROM pos WHERE pos <= (n - 1) // 2)
SELECT least(e.id, b.id) AS item1, greatest(e.id, b.id) AS item2 FROM e JOIN pos b ON b.pos = e.p""")
def pair_items_odd(spark, d):
    return pairing.pair_items(table(spark, d, "nation"), 3, 7, "n_nationkey")


_SPLIT = """p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('split42|' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents)),
c AS (SELECT doc_id, pos, n, CAST(ceil(n * 0.15) AS BIGINT) AS t, CAST(ceil((n - ceil(n * 0.15)) * 0.15 / (1 - 0.15)) AS BIGINT) AS e FROM p),
split AS (SELECT doc_id AS item_id, CASE WHEN pos < t THEN 'test' WHEN pos < t + e THEN 'eval' ELSE 'train' END AS split FROM c)"""


@query(f"WITH {_SPLIT} SELECT item_id, split FROM split")
def split_items(spark, d):
    return pairing.split_items(items(spark, d).select("item_id").distinct())


@query(f"""WITH {_SPLIT},
pos AS (SELECT item_id AS id, split, row_number() OVER (PARTITION BY split ORDER BY md5('42|' || item_id), item_id) - 1 AS pos, count(*) OVER (PARTITION BY split) AS n FROM split)
SELECT least(a.id, b.id) AS item1, greatest(a.id, b.id) AS item2, a.split AS item1_split, a.split AS item2_split
FROM (SELECT *, unnest(range(1, 4)) AS step FROM pos) a JOIN pos b ON b.split = a.split AND b.pos = (a.pos + a.step) % a.n""")
def split_pairs(spark, d):
    return pairing.generate_pairings(items(spark, d), 6, make_splits=True)


@query(f"""WITH {_SPLIT},
pos AS (SELECT item_id AS id, split, row_number() OVER (PARTITION BY split ORDER BY md5('42|' || item_id), item_id) - 1 AS pos, count(*) OVER (PARTITION BY split) AS n FROM split),
own AS (SELECT DISTINCT least(a.id, b.id) AS item1, greatest(a.id, b.id) AS item2 FROM (SELECT *, unnest(range(1, 4)) AS step FROM pos) a JOIN pos b ON b.split = a.split AND b.pos = (a.pos + a.step) % a.n),
most AS (SELECT coalesce(max(n), 0) AS most FROM (SELECT count(*) AS n FROM (SELECT item1 AS i FROM own UNION ALL SELECT item2 FROM own) GROUP BY i)),
m AS (SELECT * FROM (SELECT item_id AS id, split, row_number() OVER (PARTITION BY split ORDER BY md5('mix42|' || item_id), item_id) - 1 AS pos FROM split), most WHERE pos < 2 + most),
x AS (SELECT least(a.id, b.id) AS item1, greatest(a.id, b.id) AS item2, a.split AS split_a, b.split AS split_b FROM m a JOIN m b ON a.split < b.split),
f AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.item1 = x.item1 AND own.item2 = x.item2))
SELECT item1, item2, split_a, split_b FROM (SELECT *, row_number() OVER (PARTITION BY split_a, split_b ORDER BY md5('mixed42|' || item1 || '|' || item2), item1, item2) AS k FROM f) WHERE k <= 3""")
def mixed_pairs(spark, d):
    split = pairing.split_items(items(spark, d).select("item_id").distinct())
    own = pairing.pair_items(split, 6, within=("split",))
    return pairing.mixed_pairs(split, own.drop("split"))


@query(f"""WITH pos AS ({_pos(42, 'id', '(SELECT s_suppkey AS id FROM supplier UNION ALL SELECT -1 - r_regionkey FROM region)')})
SELECT DISTINCT least(a.id, b.id) AS item1, greatest(a.id, b.id) AS item2 FROM (SELECT *, unnest(range(1, 3)) AS step FROM pos) a JOIN pos b ON b.pos = (a.pos + a.step) % a.n
WHERE a.id < 0 OR b.id < 0""")
def added_item_pairs(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("item_id"))
    return pairing.new_pairs(old, table(spark, d, "region").select((-1 - F.col("r_regionkey")).cast("long").alias("item_id")), 4)


# ---------------------------------------------------------------- decisions


@query(f"WITH {DECISIONS_SQL} SELECT * FROM decided")
def judge_decisions(spark, d):
    return decided(spark, d)


@query(f"""WITH {PAIRS_SQL}, t AS (SELECT doc_id, max(text) AS text FROM documents GROUP BY doc_id)
SELECT item1, item2, 'offline' AS model, CASE WHEN length(a.text) > length(b.text) THEN 'Text1' WHEN length(b.text) > length(a.text) THEN 'Text2' ELSE 'Tie' END AS decision
FROM pairs JOIN t a ON a.doc_id = item1 JOIN t b ON b.doc_id = item2""")
def compare_pairs(spark, d):
    t = items(spark, d).groupBy("item_id").agg(F.max("text").alias("text"))
    p = annotations.attach(pairs(spark, d), t, "item_id", "text")
    return judge.compare(p, judge.Judge("offline", judge.offline_send), "length", ties=True).select("item1", "item2", "model", "decision")


@query("""WITH t AS (SELECT doc_id AS item_id, coalesce(max(text), 'None') AS text FROM documents GROUP BY doc_id),
a AS (SELECT *, 'note ' || substr(md5('What is ' || text), 1, 8) AS a1 FROM t)
SELECT item_id, 'offline' AS model, 'Original Text: ' || text || chr(10) || a1 || chr(10) || 'note ' || substr(md5('More on ' || text || ' after ' || a1), 1, 8) AS breakdown FROM a""")
def breakdowns(spark, d):
    t = items(spark, d).groupBy("item_id").agg(F.max("text").alias("text"))
    return judge.breakdowns(t, ["What is {text}", "More on {text} after {previous_answers}"], judge.Judge("offline", judge.offline_send))


_ANSWERS = {0: "FINAL ANSWER: Description 1", 1: "**final answer:**\\nDescription 2.", 2: "so it is a Tie", 3: "Final  Answer is qualities", 4: "Description 1 it may be, or not", 5: "no idea"}


@query(
    """WITH a AS (SELECT conv_id, turn, text || CASE (conv_id * 7 + turn) % 6 """
    + " ".join(f"WHEN {k} THEN ' ' || '" + v.replace("\\n", "' || chr(10) || '") + "'" for k, v in _ANSWERS.items())
    + r""" END AS r FROM conversations),
x AS (SELECT conv_id, turn, lower(coalesce(nullif(regexp_extract(r, '(?is)FINAL\s+ANSWER.*?(Description 1|Description 2|Tie)', 1), ''),
  nullif(regexp_extract(r, '(?i)(Description 1|Description 2|Tie)[^a-zA-Z0-9]*\z', 1), ''))) AS f FROM a)
SELECT conv_id, turn, CASE f WHEN 'description 1' THEN 'Text1' WHEN 'description 2' THEN 'Text2' WHEN 'tie' THEN 'Tie' END AS decision FROM x"""
)
def extract_answer(spark, d):
    c, k = table(spark, d, "conversations"), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(6))
    tail = None
    for n, v in _ANSWERS.items():
        own = F.lit(" " + v.replace("\\n", "\n"))
        tail = F.when(k == n, own) if tail is None else tail.when(k == n, own)
    return c.select("conv_id", "turn", D.extract_answer(F.concat("text", tail), True).alias("decision"))


@query(f"""WITH {DECISIONS_SQL},
n AS (SELECT *, CAST('0x' || substr(md5(rater || item1 || item2), 1, 8) AS BIGINT) % 3 AS k FROM decided WHERE rater LIKE 'human%'),
ann AS (SELECT CASE WHEN k = 0 THEN item2 ELSE item1 END AS item1, CASE WHEN k = 0 THEN item1 ELSE item2 END AS item2, rater, decision, 0 AS ord FROM n WHERE k < 2
        UNION ALL SELECT item1, item2, rater, 'Tie', 1 FROM n WHERE k = 1 AND item1 % 5 = 0),
f AS (SELECT item1, item2, rater, decision, 0 AS r, ord FROM ann UNION ALL
      SELECT item2, item1, rater, CASE decision WHEN 'Text1' THEN 'Text2' WHEN 'Text2' THEN 'Text1' ELSE decision END, 1, ord FROM ann),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item1, item2, rater ORDER BY r DESC, ord DESC) AS q FROM f) WHERE q = 1)
SELECT p.item1, p.item2, h.rater, l.decision FROM pairs p CROSS JOIN (SELECT rater FROM raters WHERE rater LIKE 'human%') h
LEFT JOIN l ON l.item1 = p.item1 AND l.item2 = p.item2 AND l.rater = h.rater""")
def merge_human(spark, d):
    n = decided(spark, d, HUMANS).withColumn("k", _hash(1, F.concat("rater", F.col("item1").cast("string"), F.col("item2").cast("string"))) % 3)
    turn = F.col("k") == 0
    ann = n.where("k < 2").select(F.when(turn, F.col("item2")).otherwise(F.col("item1")).alias("item1"), F.when(turn, F.col("item1")).otherwise(F.col("item2")).alias("item2"), "rater", "decision", F.lit(0).alias("ord"))
    more = n.where("k = 1 and item1 % 5 = 0").select("item1", "item2", "rater", F.lit("Tie"), F.lit(1))
    return annotations.merge_human(pairs(spark, d), ann.union(more)).select("item1", "item2", "rater", "decision")


@query(f"WITH {DECISIONS_SQL} SELECT rater, count(*) AS n, count(*) FILTER (decision = 'Tie') AS ties, round(count(*) FILTER (decision = 'Tie') / count(decision), 6) AS share, count(decision) AS rated FROM decided GROUP BY rater")
def tie_share(spark, d):
    return _round(agreement.tie_share(decided(spark, d)), "share")


# ---------------------------------------------------------------- agreement


@query(f"""WITH {DECISIONS_SQL},
e AS (SELECT rater, item1 AS a, item2 AS b, CASE decision WHEN 'Text1' THEN 1.0 WHEN 'Text2' THEN 0.0 ELSE 0.5 END AS r FROM decided WHERE decision IS NOT NULL),
t AS (SELECT x.rater, x.r AS x, y.r AS y, z.r AS z FROM e x JOIN e y ON y.rater = x.rater AND y.a = x.b JOIN e z ON z.rater = x.rater AND z.a = x.a AND z.b = y.b)
SELECT rater, round(1 - count(*) FILTER (bad) / count(*), 6) AS score, count(*) FILTER (bad) AS violations, count(*) AS triples
FROM (SELECT rater, (x = y AND z <> x) OR (x = 0.5 AND y <> 0.5 AND z <> y) OR (y = 0.5 AND x <> 0.5 AND z <> x) AS bad FROM t) GROUP BY rater""")
def transitivity(spark, d):
    return _round(agreement.transitivity(decided(spark, d)), "score")


_HIST = f"""WITH {DECISIONS_SQL},
h AS (SELECT pair_id, count(*) AS n, count(*) FILTER (decision = 'Text1') AS c0, count(*) FILTER (decision = 'Text2') AS c1, count(*) FILTER (decision = 'Tie') AS c2
      FROM decided WHERE decision IS NOT NULL GROUP BY pair_id)"""


@query(f"""WITH {DECISIONS_SQL},
c AS (SELECT a.decision AS a, b.decision AS b, count(*) AS n FROM decided a JOIN decided b ON a.pair_id = b.pair_id AND a.rater = 'human_1' AND b.rater = 'human_2'
      WHERE a.decision IS NOT NULL AND b.decision IS NOT NULL GROUP BY 1, 2),
s AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) AS same FROM c),
x AS (SELECT sum(p.x * q.y) AS xy FROM (SELECT a AS k, sum(n) AS x FROM c GROUP BY a) p JOIN (SELECT b AS k, sum(n) AS y FROM c GROUP BY b) q USING (k))
SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS observed, round(xy / (CAST(n AS DOUBLE) * n), 6) AS expected,
  round((same / n - xy / (CAST(n AS DOUBLE) * n)) / (1 - xy / (CAST(n AS DOUBLE) * n)), 6) AS kappa FROM s, x""")
def cohen_kappa(spark, d):
    return _round(agreement.cohen_kappa(decided(spark, d), "human_1", "human_2"), "observed", "expected", "kappa")


@query(_HIST + """, s AS (SELECT count(*) AS n, CAST(sum(c0 * c0 + c1 * c1 + c2 * c2) AS DOUBLE) AS sq, CAST(sum(c0) AS DOUBLE) AS c0, CAST(sum(c1) AS DOUBLE) AS c1, CAST(sum(c2) AS DOUBLE) AS c2 FROM h WHERE n = 6),
p AS (SELECT n, (sq - n * 6.0) / (n * 6.0 * 5) AS po, (c0 * c0 + c1 * c1 + c2 * c2) / (n * 36.0 * n) AS pe FROM s)
SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM p""")
def fleiss_kappa(spark, d):
    return _round(agreement.fleiss_kappa(decided(spark, d), 6), "observed", "expected", "kappa")


def _alpha(scale: int) -> str:
    return _HIST + f""", s AS (SELECT count(*) AS units, sum((2.0 * (c0 * c1 + c0 * c2 + c1 * c2)) / (n - 1)) AS off, CAST(sum(n) AS DOUBLE) AS n,
  CAST(sum(c0) AS DOUBLE) AS c0, CAST(sum(c1) AS DOUBLE) AS c1, CAST(sum(c2) AS DOUBLE) AS c2 FROM h WHERE n >= 2),
p AS (SELECT units, off / n AS o, {scale} * 2 * (c0 * c1 + c0 * c2 + c1 * c2) / (n * (n - 1)) AS e FROM s)
SELECT units, round(o, 6) AS observed, round(e, 6) AS expected, round(1 - o / e, 6) AS alpha FROM p"""


@query(_alpha(4))
def krippendorff_alpha(spark, d):
    return _round(agreement.krippendorff_alpha(decided(spark, d)), "observed", "expected", "alpha")


@query(_alpha(1))
def krippendorff_standard(spark, d):
    return _round(agreement.krippendorff_alpha(decided(spark, d), compat=False), "observed", "expected", "alpha")


def _band_sql(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {least} THEN '{name}'" for least, name in D.KAPPA_BANDS) + " ELSE 'poor' END"


def _alpha_of(where: str) -> str:
    return f"""(SELECT 1 - (off / n) / (4 * 2 * (c0 * c1 + c0 * c2 + c1 * c2) / (n * (n - 1))) AS score FROM (
  SELECT sum((2.0 * (c0 * c1 + c0 * c2 + c1 * c2)) / (n - 1)) AS off, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(c0) AS DOUBLE) AS c0, CAST(sum(c1) AS DOUBLE) AS c1, CAST(sum(c2) AS DOUBLE) AS c2
  FROM (SELECT count(*) AS n, count(*) FILTER (decision = 'Text1') AS c0, count(*) FILTER (decision = 'Text2') AS c1, count(*) FILTER (decision = 'Tie') AS c2
        FROM decided WHERE decision IS NOT NULL AND {where} GROUP BY pair_id) WHERE n >= 2))"""


@query(f"""WITH {DECISIONS_SQL},
k AS (SELECT a.decision AS a, b.decision AS b, count(*) AS n FROM decided a JOIN decided b ON a.pair_id = b.pair_id AND a.rater = 'decision' AND b.rater = 'decision_b' GROUP BY 1, 2),
s AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n) FILTER (a = b) AS DOUBLE) AS same FROM k),
x AS (SELECT CAST(sum(p.x * q.y) AS DOUBLE) AS xy FROM (SELECT a AS v, sum(n) AS x FROM k GROUP BY a) p JOIN (SELECT b AS v, sum(n) AS y FROM k GROUP BY b) q USING (v)),
o AS (SELECT 'human' AS "group", 'krippendorff_alpha' AS method, score FROM {_alpha_of("rater LIKE 'human%'")}
  UNION ALL SELECT 'llm', 'cohens_kappa', (same / n - xy / (n * n)) / (1 - xy / (n * n)) FROM s, x
  UNION ALL SELECT 'all', 'krippendorff_alpha', score FROM {_alpha_of("true")})
SELECT "group", method, round(score, 6) AS score, {_band_sql("score")} AS interpretation FROM o""")
def irr(spark, d):
    return _round(agreement.irr(decided(spark, d), {"human": list(HUMANS), "llm": list(MODELS), "all": list(RATERS)}), "score")


_ICC = f"""WITH {DECISIONS_SQL},
r AS (SELECT pair_id, rater, CASE decision WHEN 'Text1' THEN 0.0 WHEN 'Text2' THEN 1.0 ELSE 0.5 END::DOUBLE AS v, count(*) OVER (PARTITION BY pair_id) AS m FROM decided WHERE decision IS NOT NULL),
o AS (SELECT * FROM r WHERE m >= 2), g AS (SELECT avg(v) AS g, count(*) AS cells FROM o),
n AS (SELECT count(DISTINCT pair_id) AS n, count(DISTINCT rater) AS k FROM o),
ssr AS (SELECT sum((x - g) * (x - g)) AS s FROM (SELECT avg(v) AS x FROM o GROUP BY pair_id), g),
ssc AS (SELECT sum((x - g) * (x - g)) AS s FROM (SELECT avg(v) AS x FROM o GROUP BY rater), g),
sst AS (SELECT sum((v - g) * (v - g)) AS s FROM o, g),
c AS (SELECT n, k, k * ssr.s / (n - 1) AS msr, n * ssc.s / (k - 1) AS msc, (sst.s - k * ssr.s - n * ssc.s) / ((n - 1) * (k - 1)) AS mse FROM n, ssr, ssc, sst)"""


@query(_ICC + " SELECT n, k, round(msr, 6) AS msr, round(msc, 6) AS msc, round(mse, 6) AS mse FROM c")
def icc_components(spark, d):
    return _round(agreement.icc_components(decided(spark, d)), "msr", "msc", "mse")


@query(_ICC + " SELECT n, k, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc, round(msr / mse, 4) AS f_stat FROM c")
def icc_point(spark, d):
    return _round(agreement.icc(decided(spark, d)), "icc").select("n", "k", "icc", F.round("f_stat", 4).alias("f_stat"))


@query()
def icc(spark, d):
    return _round(agreement.icc(decided(spark, d)), "icc", "f_stat", "p_value", "ci_lo", "ci_hi")


# ---------------------------------------------------------------- scores


@query(f"""WITH {DECISIONS_SQL} SELECT rater, CASE decision WHEN 'Text1' THEN item1 ELSE item2 END AS winner, CASE decision WHEN 'Text1' THEN item2 ELSE item1 END AS loser, count(*) AS n
FROM decided WHERE decision IN ('Text1', 'Text2') GROUP BY 1, 2, 3""")
def bt_wins(spark, d):
    return scoring.wins(decided(spark, d), by=("rater",))


@query()
def bt_scores(spark, d):
    return _round(scoring.bradley_terry(untied(spark, d), items(spark, d)), "raw", "score", "se")


@query(f"""WITH {DECISIONS_SQL}, i AS (SELECT count(DISTINCT doc_id) AS n FROM documents)
SELECT rater, n, 0.0::DOUBLE AS residual FROM (SELECT DISTINCT rater FROM decided WHERE decision IN ('Text1', 'Text2')), i""")
def bt_residual(spark, d):
    """How far, at most, the strengths of a rater are from the fixed point: what an item wins less what it loses, less
    the pull towards the mean; to six digits, none."""
    x = untied(spark, d)
    s = graph.checkpointed(scoring.bradley_terry(x, items(spark, d)).select("rater", "item_id", F.exp("raw").alias("w")))
    of = s.groupBy("rater").agg(F.avg("w").alias("mean"), F.count("*").alias("n"))
    s = s.join(F.broadcast(of), "rater").select("rater", "item_id", "n", (F.col("w") / F.col("mean")).alias("w"))
    e = scoring.wins(x, by=("rater",)).withColumns({c: F.col(c).cast("string") for c in ("winner", "loser")}).withColumnRenamed("n", "k")
    for c in ("winner", "loser"):
        e = e.join(s.select("rater", F.col("item_id").alias(c), F.col("w").alias(f"w_{c}")), ["rater", c])
    f = F.col("k") * F.col("w_loser") / (F.col("w_winner") + F.col("w_loser"))
    flow = e.select("rater", F.explode(F.array(F.struct(F.col("winner").alias("i"), f.alias("f")), F.struct(F.col("loser").alias("i"), (-f).alias("f")))).alias("x")).groupBy("rater", F.col("x.i").alias("item_id")).agg(F.sum("x.f").alias("f"))
    gap = F.coalesce("f", F.lit(0.0)) - scoring.ALPHA * F.col("n") * (F.col("w") - 1)
    return _round(s.join(flow, ["rater", "item_id"], "left").groupBy("rater", "n").agg(F.max(F.abs(gap)).alias("residual")), "residual")


@query()
def davidson_scores(spark, d):
    return _round(scoring.davidson(decided(spark, d), items(spark, d)), "raw", "score", "tie_log")


@query()
def score_items(spark, d):
    return _round(scoring.score_items(decided(spark, d), items(spark, d)), "raw", "score", "se")


_STATS = "count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS median, round(stddev_samp(n_chars), 6) AS std, CAST(min(n_chars) AS DOUBLE) AS min, CAST(max(n_chars) AS DOUBLE) AS max, round(quantile_cont(n_chars, 0.25), 6) AS q25, round(quantile_cont(n_chars, 0.75), 6) AS q75"


@query(f"SELECT {_STATS} FROM documents")
def score_summary(spark, d):
    return _round(scoring.summarize(items(spark, d)), "mean", "median", "std", "q25", "q75")


@query("""WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents),
b AS (SELECT CAST(least(floor((n_chars - lo) * 30 / (hi - lo)), 29) AS INT) AS bin, lo, hi FROM documents, e)
SELECT bin, round(lo + bin * ((hi - lo) / 30), 6) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / 30), 6) AS bin_hi, count(*) AS n FROM b GROUP BY bin, lo, hi""")
def score_histogram(spark, d):
    return _round(scoring.histogram(items(spark, d)), "bin_lo", "bin_hi")


@query("SELECT doc_id AS item_id, n_chars::DOUBLE AS score, CAST(n_chars > (SELECT avg(n_chars) FROM documents) AS INT) AS cluster FROM documents")
def cluster_mean(spark, d):
    return classify.classify(items(spark, d).drop("text"), method="mean")


@query()
def cluster_gmm(spark, d):
    return classify.classify(items(spark, d).drop("text"), method="gmm", classes=2)


@query()
def cluster_kmeans(spark, d):
    return classify.classify(items(spark, d).drop("text"))


@query(f"SELECT CAST(n_chars > (SELECT avg(n_chars) FROM documents) AS INT) AS cluster, {_STATS.replace('AS median', 'AS q50')} FROM documents GROUP BY 1")
def cluster_describe(spark, d):
    return _round(classify.describe(cluster_mean(spark, d)), "mean", "std", "q25", "q50", "q75")


@query("SELECT doc_id AS item_id, n_chars::DOUBLE AS score, row_number() OVER (ORDER BY n_chars, doc_id) AS row FROM documents")
def dotplot(spark, d):
    return classify.dotplot(items(spark, d).drop("text"))


# ---------------------------------------------------------------- replacing raters


def _humans_and_model(spark, d, model="decision"):
    x = decided(spark, d)
    return x.where(F.col("rater").startswith("human")), x.where(F.col("rater") == model)


def _alt_sql(wins: str) -> str:
    return f"""WITH {DECISIONS_SQL},
y AS (SELECT pair_id, rater, CASE decision WHEN 'Text1' THEN 0.0 WHEN 'Text2' THEN 1.0 ELSE 0.5 END::DOUBLE AS y FROM decided WHERE decision IS NOT NULL),
h AS (SELECT a.pair_id, a.rater, a.y, m.y AS l, avg(CAST(b.y = a.y AS INT)) AS ha, avg(CAST(b.y = m.y AS INT)) AS la,
        round(-avg((a.y - b.y) * (a.y - b.y)), 9) AS hr, round(-avg((m.y - b.y) * (m.y - b.y)), 9) AS lr
      FROM y a JOIN y b ON a.pair_id = b.pair_id AND a.rater <> b.rater JOIN y m ON m.pair_id = a.pair_id AND m.rater = 'decision'
      WHERE a.rater LIKE 'human%' AND b.rater LIKE 'human%' GROUP BY 1, 2, 3, 4),
w AS (SELECT rater, {wins} FROM h)
SELECT rater, count(*) AS n, round(avg(hw - lw), 6) AS mean_diff, round(var_samp(hw - lw), 6) AS var_diff, round(avg(lw), 6) AS advantage FROM w GROUP BY rater HAVING count(*) >= 30"""


@query(_alt_sql("CAST(la >= ha AS INT) AS lw, CAST(ha >= la AS INT) AS hw"))
def alt_test_stats(spark, d):
    return _round(alt_test.stats(*_humans_and_model(spark, d)), "mean_diff", "var_diff", "advantage")


@query(_alt_sql("CAST(lr >= hr AS INT) AS lw, CAST(hr >= lr AS INT) AS hw"))
def alt_test_rmse_stats(spark, d):
    return _round(alt_test.stats(*_humans_and_model(spark, d), scoring="neg_rmse"), "mean_diff", "var_diff", "advantage")


@query()
def alt_test_result(spark, d):
    return _round(alt_test.alt_test(*_humans_and_model(spark, d)), "winning_rate", "advantage")


@query()
def epsilon_sweep(spark, d):
    return _round(alt_test.epsilon_sweep(*_humans_and_model(spark, d)), "epsilon", "winning_rate")


@query("""WITH t AS (SELECT source, doc_id, CAST('0x' || substr(md5('p' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 * CASE WHEN doc_id % 3 = 0 THEN 0.001 ELSE 1 END AS p FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, doc_id) AS i, count(*) OVER (PARTITION BY source) AS m FROM t),
h AS (SELECT *, sum(1.0 / i) OVER (PARTITION BY source) AS hm FROM r), k AS (SELECT *, max(CASE WHEN p <= i / m * (0.05 / hm) THEN i END) OVER (PARTITION BY source) AS top FROM h)
SELECT source, doc_id, coalesce(i <= top, false) AS rejected FROM k""")
def benjamini_yekutieli(spark, d):
    p = _hash(1, F.concat(F.lit("p"), F.col("doc_id").cast("string"))) / F.lit(4294967296.0) * F.when(F.col("doc_id") % 3 == 0, 0.001).otherwise(1.0)
    t = table(spark, d, "documents").select("source", "doc_id", p.alias("p_value"))
    return alt_test.benjamini_yekutieli(t, 0.05, ("source",)).select("source", "doc_id", "rejected")


@query(f"""WITH {DECISIONS_SQL}, v AS (SELECT pair_id, list(coalesce(CASE decision WHEN 'Text1' THEN 0 WHEN 'Text2' THEN 1 WHEN 'Tie' THEN 2 END, -1) ORDER BY rater) AS labels
FROM decided WHERE rater LIKE 'human%' GROUP BY pair_id) SELECT array_to_string(labels, ',') AS labels, count(*) AS n FROM v GROUP BY 1""")
def ds_patterns(spark, d):
    return dawid_skene.patterns(decided(spark, d), list(HUMANS)).select(F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), "n")


@query()
def ds_ranking(spark, d):
    return _round(dawid_skene.ranking(decided(spark, d), list(RATERS), classes=3), "reliability")


@query()
def ds_alt_test(spark, d):
    return _round(dawid_skene.alt_test(decided(spark, d), list(HUMANS), "decision", classes=3), "mean_diff", "p_value")


@query()
def bt_alt_test_result(spark, d):
    return _round(bt_alt_test.bt_alt_test(decided(spark, d), list(HUMANS), "decision", bootstraps=50), "llm_human", "human_human", "advantage", "p_value", "ci_lo", "ci_hi")


# ---------------------------------------------------------------- ordinal ratings


_LEVELS = """own AS (SELECT l_partkey AS item, l_suppkey AS annotator, CAST(arg_max(l_quantity, {o: l_orderkey, q: l_quantity}) AS DOUBLE) AS level
FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1, 2)"""


def _ratings(spark, d):
    return ordinal.levels(table(spark, d, "lineitem"), "l_partkey", "l_quantity", "l_suppkey", "l_orderkey")


def _half_up(x):
    """round(x) of doubles that aren't negative, without the decimals that the built-in one makes of each."""
    return F.rint(x) + F.when(x - F.rint(x) == 0.5, 1.0).otherwise(0.0)


@query(f"WITH {_LEVELS} SELECT * FROM own")
def ordinal_levels(spark, d):
    return _ratings(spark, d)


@query(f"""WITH {_LEVELS} SELECT CAST(a.annotator AS VARCHAR) AS rater, count(*) AS n, count(*) FILTER (a.level > b.level) AS first, count(*) FILTER (a.level < b.level) AS second, count(*) FILTER (a.level = b.level) AS ties
FROM own a JOIN own b ON a.annotator = b.annotator AND a.item < b.item GROUP BY 1""")
def ordinal_decisions(spark, d):
    x = ordinal.decisions(None, _ratings(spark, d))
    return x.groupBy("rater").agg(F.count("*").alias("n"), *(F.count_if(F.col("decision") == v).alias(k) for k, v in (("first", "Text1"), ("second", "Text2"), ("ties", "Tie"))))


@query(f"""WITH {_LEVELS}, m AS (SELECT item, avg(level) AS level FROM own GROUP BY item)
SELECT round(abs(a.level - b.level)) AS gap, count(*) AS n FROM (SELECT DISTINCT x.item AS i, y.item AS j FROM own x JOIN own y ON x.annotator = y.annotator AND x.item < y.item) s
JOIN m a ON a.item = s.i JOIN m b ON b.item = s.j WHERE abs(a.level - b.level) >= 5 GROUP BY 1""")
def ordinal_all(spark, d):
    c = ordinal.candidate_pairs(_ratings(spark, d), "all", 5)
    return c.groupBy(_half_up(F.abs(F.col("level1") - F.col("level2"))).alias("gap")).agg(F.count("*").alias("n"))


@query()
def ordinal_adjacent(spark, d):
    return _round(ordinal.candidate_pairs(ordinal.levels(table(spark, d, "supplier"), "s_suppkey", "s_nationkey"), "adjacent"), "level1", "level2")


@query("""WITH m AS (SELECT s_suppkey AS item, arg_max(s_nationkey, s_nationkey)::DOUBLE AS level FROM supplier WHERE s_nationkey IS NOT NULL GROUP BY 1)
SELECT a.item AS item1, b.item AS item2, a.level AS level1, b.level AS level2 FROM m a JOIN m b ON round_even(a.level, 0) = round_even(b.level, 0) + 1""")
def ordinal_adjacent_all(spark, d):
    own = ordinal.levels(table(spark, d, "supplier"), "s_suppkey", "s_nationkey")
    return ordinal.candidate_pairs(own, "adjacent", most=1_000_000)


@query("""WITH m AS (SELECT s_suppkey AS item, max(s_nationkey)::DOUBLE AS level FROM supplier WHERE s_nationkey IS NOT NULL GROUP BY 1)
SELECT a.item AS item1, b.item AS item2, a.level AS level1, b.level AS level2 FROM m a JOIN m b ON a.item < b.item AND abs(a.level - b.level) >= 20""")
def ordinal_random_all(spark, d):
    own = ordinal.levels(table(spark, d, "supplier"), "s_suppkey", "s_nationkey")
    return ordinal.candidate_pairs(own, "random", 20, most=1_000_000)


@query(f"""WITH {_LEVELS}, m AS (SELECT item, avg(level) AS level FROM own GROUP BY item), p AS (SELECT DISTINCT l_partkey AS item1, l_partkey + 1 AS item2 FROM lineitem)
SELECT p.item1, p.item2, round(a.level, 6) AS level1, round(b.level, 6) AS level2 FROM p LEFT JOIN m a ON a.item = p.item1 LEFT JOIN m b ON b.item = p.item2""")
def ordinal_provided(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item1"), (F.col("l_partkey") + 1).alias("item2")).distinct()
    return ordinal.candidate_pairs(_ratings(spark, d), "provided", provided=p).select("item1", "item2", F.round("level1", 6).alias("level1"), F.round("level2", 6).alias("level2"))


def _prune_sql(rounds: int) -> str:
    step = ""
    for k in range(rounds):
        step += f""", b{k} AS (SELECT * FROM p{k} WHERE rater IN (SELECT rater FROM p{k} GROUP BY rater HAVING count(*) >= 50)),
p{k + 1} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY item1, item2) AS c FROM b{k}) WHERE c >= 2)"""
        step = step.replace(f"p{k + 1} AS (SELECT * FROM", f"p{k + 1} AS (SELECT item1, item2, rater, decision FROM")
    return step


@query(f"""WITH own AS (SELECT o_custkey AS item, o_orderstatus AS annotator, max(CAST(trunc(o_totalprice / 50000) AS INT))::DOUBLE AS level FROM orders GROUP BY 1, 2),
p0 AS (SELECT a.item AS item1, b.item AS item2, a.annotator AS rater, CASE WHEN a.level > b.level THEN 'Text1' WHEN b.level > a.level THEN 'Text2' ELSE 'Tie' END AS decision
       FROM own a JOIN own b ON b.item = a.item + 1 AND a.annotator = b.annotator){_prune_sql(6)} SELECT * FROM p6""")
def ordinal_pruned(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("annotator"), (F.col("o_totalprice") / 50_000).cast("int").alias("level"))
    own = ordinal.levels(o, "item", "level", "annotator")
    near = own.select(F.col("item").alias("item1"), (F.col("item") + 1).alias("item2")).distinct()
    return ordinal.prune(ordinal.decisions(near, own), 2, 50)


# ---------------------------------------------------------------- graph


@query(f"""WITH {DECISIONS_SQL}, e AS (SELECT DISTINCT CASE decision WHEN 'Text1' THEN item1 ELSE item2 END AS src, CASE decision WHEN 'Text1' THEN item2 ELSE item1 END AS dst
FROM decided WHERE rater = 'decision' AND decision IN ('Text1', 'Text2'))
SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree
FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id""")
def win_loss_degree(spark, d):
    return graph.degrees(_won(spark, d))


def _won(spark, d):
    return graph.directed(decided(spark, d, {"decision": MODELS["decision"]}))


@query()
def pagerank(spark, d):
    return _round(graph.pagerank(_won(spark, d)), "pagerank")


_WON_SQL = f"""{DECISIONS_SQL}, e AS (SELECT DISTINCT CASE decision WHEN 'Text1' THEN item1 ELSE item2 END AS src, CASE decision WHEN 'Text1' THEN item2 ELSE item1 END AS dst
FROM decided WHERE rater = 'decision' AND decision IN ('Text1', 'Text2')), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""


def _pagerank_sql(rounds: int) -> str:
    out = f"""WITH {_WON_SQL}, k AS (SELECT src, count(*) AS k FROM e GROUP BY src), n AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS MATERIALIZED (SELECT id, 1 / n AS r FROM v, n)"""
    for i in range(rounds):
        out += f""", g{i} AS MATERIALIZED (SELECT v.id, coalesce(x.got, 0) AS got FROM v LEFT JOIN (SELECT dst AS id, sum(r / k) AS got FROM e JOIN r{i} ON r{i}.id = e.src JOIN k ON k.src = e.src GROUP BY dst) x USING (id)),
r{i + 1} AS MATERIALIZED (SELECT id, 0.15 / n + 0.85 * (got + (1 - (SELECT sum(got) FROM g{i})) / n) AS r FROM g{i}, n)"""
    return out + f" SELECT id, round(r, 6) AS pagerank FROM r{rounds}"


@query(_pagerank_sql(8))
def pagerank_rounds(spark, d):
    return _round(graph.pagerank(_won(spark, d), rounds=8, tol=0.0), "pagerank")


def _eigenvector_sql(rounds: int) -> str:
    out = f"WITH {_WON_SQL}, x0 AS MATERIALIZED (SELECT id, 1 / (SELECT count(*) FROM v)::DOUBLE AS x FROM v)"
    for i in range(rounds):
        out += f""", y{i} AS MATERIALIZED (SELECT a.id, a.x + coalesce(b.got, 0) AS y FROM x{i} a LEFT JOIN (SELECT dst AS id, sum(x) AS got FROM e JOIN x{i} ON x{i}.id = e.src GROUP BY dst) b USING (id)),
x{i + 1} AS MATERIALIZED (SELECT id, y / (SELECT sqrt(sum(y * y)) FROM y{i}) AS x FROM y{i})"""
    return out + f" SELECT id, round(x, 6) AS eigenvector FROM x{rounds}"


@query(_eigenvector_sql(6))
def eigenvector_rounds(spark, d):
    return _round(graph.eigenvector(_won(spark, d), rounds=6, tol=0.0), "eigenvector")


@query()
def betweenness(spark, d):
    p = pairing.pair_items(table(spark, d, "supplier"), 4, 42, "s_suppkey")
    return _round(graph.betweenness(p.select(F.col("item1").alias("src"), F.col("item2").alias("dst"))), "betweenness")


_CHAINS = """WITH RECURSIVE e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM (SELECT doc_id, lag(doc_id) OVER (PARTITION BY lang, doc_id % 50 ORDER BY doc_id) AS p FROM documents) x
  JOIN documents a ON a.doc_id = x.doc_id JOIN documents b ON b.doc_id = x.p),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS c FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.c),
c AS (SELECT id, min(c) AS component FROM r GROUP BY id)"""


def _chains(spark, d):
    w = Window.partitionBy("lang", F.col("doc_id") % 50).orderBy("doc_id")
    return table(spark, d, "documents").select(F.col("doc_id").alias("item1"), F.lag("doc_id").over(w).alias("item2")).where("item2 is not null")


@query(_CHAINS + " SELECT id, component FROM c")
def components(spark, d):
    return graph.components(_chains(spark, d))


@query(_CHAINS + """, best AS (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
SELECT a AS item1, b AS item2 FROM e JOIN c ON c.id = e.a WHERE c.component = (SELECT component FROM best)""")
def largest_component(spark, d):
    return graph.largest_component(_chains(spark, d))


# ---------------------------------------------------------------- costs and rewards


_TOKENS = r"CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '[ \t\n\r\x0B\f]+')) END"


@query(f"SELECT lang, CAST(sum(CAST(floor({_TOKENS} * 1.33) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_cost(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(D.token_estimate(F.col("text"))).alias("tokens"))


@query(f"""WITH {PAIRS_SQL}, t AS (SELECT count(*) AS n, sum(CAST(floor({_TOKENS} * 1.33) AS BIGINT)) AS t FROM documents), m AS (SELECT count(*) AS m FROM pairs),
p AS (SELECT * FROM (VALUES ('gpt-4o-mini', 0.15::DOUBLE, 0.60::DOUBLE), ('gemini-2.5-flash-lite', 0.10::DOUBLE, 0.40::DOUBLE)) x(model, i, o)),
r AS (SELECT model, i, o, 'breakdown' AS stage, CAST({int(len(judge.SYSTEM.split()) * 1.33)} * n + 3 * n + t AS BIGINT) AS tokens_in, CAST(200 * n AS BIGINT) AS tokens_out FROM p, t
  UNION ALL SELECT model, i, o, 'pairwise', CAST({int(len(judge.SYSTEM.split()) * 1.33)} * m + 100 * m + 400 * m AS BIGINT), CAST(50 * m AS BIGINT) FROM p, m)
SELECT model, stage, tokens_in, tokens_out, round((tokens_in * i + tokens_out * o) / 1e6, 6) AS cost FROM r""")
def cost_estimate(spark, d):
    return _round(costs.estimate(items(spark, d), pairs(spark, d), ["gpt-4o-mini", "gemini-2.5-flash-lite"], ["What is {text}?"]), "cost")


@query(f"""WITH {DECISIONS_SQL}, t AS (SELECT doc_id, max(n_chars) AS n, max(text) AS text FROM documents GROUP BY doc_id)
SELECT item1, item2, md5(CASE decision WHEN 'Text1' THEN a.text ELSE b.text END) AS w, md5(CASE decision WHEN 'Text1' THEN b.text ELSE a.text END) AS l,
  CASE decision WHEN 'Text1' THEN a.n - b.n ELSE b.n - a.n END::DOUBLE AS margin
FROM decided JOIN t a ON a.doc_id = item1 JOIN t b ON b.doc_id = item2 WHERE rater = 'human_1' AND decision IN ('Text1', 'Text2')""")
def reward_pairs(spark, d):
    i = items(spark, d).groupBy("item_id").agg(F.max("score").alias("score"), F.max("text").alias("text"))
    p = reward.reward_pairs(decided(spark, d, {"human_1": HUMANS["human_1"]}), i.select("item_id", "text"), i.select("item_id", "score"))
    return p.select("item1", "item2", F.md5("text_w").alias("w"), F.md5("text_l").alias("l"), "margin")
