"""Connected components of an edge table, by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) for every end of an edge (a, b): root is the smallest id that is reachable.

    Each round points every vertex at its smallest neighbour, follows pointers, and contracts the edges; the longest
    chain shrinks by a constant factor a round. Every step is an aggregate or an equi-join; nothing is collected but
    one count. Contracted edges are distinct pairs, so that a large component isn't a hot key. No edges, no rows.
    """
    e = C.staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-edges")
    members = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root"))
        up = C.staged(up, f"{name}-hooks")
        for _ in range(2):
            to = up.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
            up = up.join(to, F.col("root") == F.col("_i")).select("id", F.col("_r").alias("root"))
        up = C.staged(up, f"{name}-roots")
        if members is None:
            members = up
        else:
            to = up.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
            members = C.staged(members.join(to, F.col("root") == F.col("_i"), "left").select("id", F.coalesce("_r", "root").alias("root")), f"{name}-members")
        ra, rb = (up.select(F.col("id").alias(f"_{x}"), F.col("root").alias(f"_r{x}")) for x in "ab")
        e = e.join(ra, F.col("a") == F.col("_a")).join(rb, F.col("b") == F.col("_b"))
        e = e.select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")).where("a < b").distinct()
        e = C.staged(e, f"{name}-edges")
    if members is None:
        return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return members
