"""The comparison graph: components, degrees, page rank, eigenvector and betweenness centrality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscale.functions import decisions as D

#: Edges up to which betweenness is computed; its work is the product of nodes and edges.
BETWEENNESS_EDGES = 200_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder of the session; a folder of our own only where none is set and the
    master is local, as executors of a cluster share no local folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or "/tmp/prefscale-checkpoints")
    return df.checkpoint()


#: Edges, contracted or not, from which one task finds the components that are left.
LOCAL_EDGES = 1_000_000


def components(edges: DataFrame, a: str = "item1", b: str = "item2", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component): the smallest id that is reachable, by hooking to the smallest neighbour, following the hooks to
    their end and contraction, each of which leaves at most half of the nodes; few edges are left to one task."""
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null")
    e = checkpointed(e.distinct())
    members = e.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    e = e.where("a < b")
    while (n := e.count()) > 0:
        up = _roots_in_one(e) if n <= local_edges else _roots(e)
        members = checkpointed(members.join(up.withColumnRenamed("v", "component"), "component", "left").select("id", F.coalesce("r", "component").alias("component")))
        if n <= local_edges:
            break
        e = e.join(up.select(F.col("v").alias("a"), F.col("r").alias("ra")), "a").join(up.select(F.col("v").alias("b"), F.col("r").alias("rb")), "b")
        e = checkpointed(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct())
    return members


def _roots(e: DataFrame) -> DataFrame:
    """(v, r): where the hooks of each end of an edge to its smallest neighbour lead; every jump doubles their length."""
    both = e.union(e.select("b", "a"))
    up = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("r")))
    while True:
        jump = up.select(F.col("v").alias("r"), F.col("r").alias("s"))
        far = checkpointed(up.join(jump, "r").select("v", F.col("s").alias("r"), (F.col("r") != F.col("s")).alias("moved")))
        up = far.drop("moved")
        if far.where("moved").isEmpty():
            return up


def _roots_in_one(e: DataFrame) -> DataFrame:
    """(v, r): the smallest id that each end of an edge reaches, in one task."""
    kind = e.schema["a"].dataType.simpleString()

    def roots(batches):
        rows = [x for x in batches if len(x)]
        if not rows:
            return
        rows = pd.concat(rows)
        n = len(rows)
        names, at = np.unique(np.concatenate([rows.a.to_numpy(), rows.b.to_numpy()]), return_inverse=True)
        lo, hi, p = at[:n], at[n:], np.arange(len(names))
        while len(lo):
            np.minimum.at(p, hi, lo)
            while not np.array_equal(far := p[p], p):
                p = far
            x, y = p[lo], p[hi]
            apart = x != y
            lo, hi = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        yield pd.DataFrame({"v": names, "r": names[p]})

    return checkpointed(e.repartition(1).mapInPandas(roots, f"v {kind}, r {kind}"))


def largest_component(decisions: DataFrame) -> DataFrame:
    """The rows whose items lie in the largest component; of equal ones that of the smallest id."""
    c = components(decisions.select("item1", "item2"))
    best = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    ids = c.join(F.broadcast(best), "component", "left_semi").select("id")
    return decisions.join(ids.withColumnRenamed("id", "item1"), "item1", "left_semi").select(*decisions.columns)


def directed(decisions: DataFrame, decision: str = "decision") -> DataFrame:
    """Distinct (src, dst) from the winner to the loser; ties and unknown codes are left out."""
    d = D.normalize(decision, "network")
    one = d == "Text1"
    return decisions.where(d.isin("Text1", "Text2")).select(F.when(one, F.col("item1")).otherwise(F.col("item2")).alias("src"), F.when(one, F.col("item2")).otherwise(F.col("item1")).alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree), degrees also as shares of the other nodes."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    g = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return g.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """(id, pagerank): each node passes its rank to those it points to, that is to the losers; nodes without edges out
    pass theirs to all. Rounds are a join and an aggregation."""
    nodes = checkpointed(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    n = nodes.count()
    out = checkpointed(edges.join(edges.groupBy("src").agg(F.count("*").alias("k")), "src"))
    rank = nodes.withColumn("pagerank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        sent = out.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pagerank") / F.col("k")).alias("got"))
        new = rank.join(sent, "id", "left").select("id", F.col("pagerank").alias("before"), F.coalesce("got", F.lit(0.0)).alias("got"))
        new = checkpointed(new)
        lost = 1.0 - (new.agg(F.sum("got")).first()[0] or 0.0)
        rank = new.select("id", ((1 - damping) / n + damping * (F.col("got") + lost / n)).alias("pagerank"), "before")
        step = rank.agg(F.sum(F.abs(F.col("pagerank") - F.col("before")))).first()[0] or 0.0
        rank = rank.drop("before")
        if step < n * tol:
            break
    return rank


def eigenvector(edges: DataFrame, rounds: int = 1000, tol: float = 1e-6) -> DataFrame:
    """(id, eigenvector): power iteration on edges in, with the node's own value kept in."""
    nodes = checkpointed(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    n = nodes.count()
    x = nodes.withColumn("v", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        sent = edges.join(x.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("v").alias("got"))
        new = checkpointed(x.join(sent, "id", "left").select("id", F.col("v").alias("before"), (F.col("v") + F.coalesce("got", F.lit(0.0))).alias("v")))
        norm = (new.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 1.0) ** 0.5
        new = new.withColumn("v", F.col("v") / norm)
        step = new.agg(F.sum(F.abs(F.col("v") - F.col("before")))).first()[0] or 0.0
        x = new.drop("before")
        if step < n * tol:
            break
    return x.withColumnRenamed("v", "eigenvector")


def betweenness(edges: DataFrame) -> DataFrame:
    """(id, betweenness) by breadth-first search from every node; sources are dealt over tasks, each with all edges, of
    which there may be BETWEENNESS_EDGES at most."""
    rows = edges.limit(BETWEENNESS_EDGES + 1).toPandas()
    if len(rows) > BETWEENNESS_EDGES:
        raise ValueError(f"betweenness takes {BETWEENNESS_EDGES} edges at most")
    names = np.array(sorted(set(rows.src) | set(rows.dst)))
    n = len(names)
    adj: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(np.searchsorted(names, rows.src), np.searchsorted(names, rows.dst)):
        adj[a].append(int(b))

    def brandes(batches):
        total = np.zeros(n)
        for batch in batches:
            for s in batch.id:
                order, preds, sigma, dist = [], [[] for _ in range(n)], np.zeros(n), np.full(n, -1)
                sigma[s], dist[s], queue = 1, 0, [int(s)]
                for v in queue:
                    order.append(v)
                    for w in adj[v]:
                        if dist[w] < 0:
                            dist[w] = dist[v] + 1
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            sigma[w] += sigma[v]
                            preds[w].append(v)
                delta = np.zeros(n)
                for w in reversed(order):
                    for v in preds[w]:
                        delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
                    if w != s:
                        total[w] += delta[w]
        yield pd.DataFrame({"k": range(n), "x": total})

    spark = edges.sparkSession
    got = spark.range(n).repartition(8).mapInPandas(brandes, "k long, x double").groupBy("k").agg(F.sum("x").alias("x"))
    kind = edges.schema["src"].dataType.simpleString()
    ids = spark.createDataFrame(list(enumerate(names.tolist())), f"k long, id {kind}")
    return ids.join(got, "k").select("id", (F.col("x") / F.lit(float(max(1, (n - 1) * (n - 2))))).alias("betweenness"))
