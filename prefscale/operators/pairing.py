"""Sparse comparison graphs: near-regular pairs, splits, mixed pairs and additions."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Leading hex digits of the order key that make a bucket of the ranking.
_DIGITS = 3


def order_key(seed: int | str, *cols: Column | str) -> Column:
    """A pseudo-random order that any engine reproduces: md5 of the seed and the values, joined by bars."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols)))


def ranked(df: DataFrame, key: Column, *ties: str, into: str = "pos", within: tuple[str, ...] = ()) -> DataFrame:
    """df with the place (from 0) of each row by a hash key. Buckets by leading digits are ranked apart and offset by
    the sizes of the buckets before, so that no task holds all rows."""
    out = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, _DIGITS))
    sizes = out.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most 4096 rows for each group of ``within``.
    sizes = sizes.select(*within, "_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*within, "_bucket").orderBy("_key", *ties)
    out = out.withColumn("_k", F.row_number().over(own)).join(sizes, [*within, "_bucket"])
    return out.withColumn(into, F.col("_before") + F.col("_k") - 1).select(*df.columns, into)


def degree(n: int, pairs_per_item: int | None) -> int:
    k = pairs_per_item or max(3, min(6, int(n**0.5)))
    if k >= n:
        warnings.warn(f"num_pairs_per_item ({k}) is not below the number of items ({n}); {n - 1} is taken", stacklevel=3)
        k = n - 1
    if n * k % 2:
        warnings.warn(f"{n} items of degree {k} are impossible as both are odd; one item gets {k + 1}", stacklevel=3)
    return k


def _steps(k: int, n: Column) -> Column:
    """(start, step) pairs that leave position ``pos``, by the size n of its circle: 1 to k/2; if k is odd, half way
    round for an even n, and for an odd n the middle step from the first half, the last position closing the ring."""
    base = F.sequence(F.lit(1), F.lit(k // 2)) if k // 2 else F.array().cast("array<int>")
    base = F.transform(base, lambda s: s.cast("long"))
    if k % 2 == 0:
        return base
    half, s = F.floor(n / 2), F.floor((n - 1) / 2)
    even = F.when(F.col("pos") < half, F.array(half)).otherwise(F.array().cast("array<long>"))
    odd = F.when((F.col("pos") < s) | (F.col("pos") == s), F.array(s)).otherwise(F.array().cast("array<long>"))
    return F.concat(base, F.when(n % 2 == 0, even).otherwise(odd))


def pair_items(items: DataFrame, pairs_per_item: int | None = 10, seed: int = 42, id_col: str = "item_id", within: tuple[str, ...] = ()) -> DataFrame:
    """(item1, item2) of a graph in which every item has ``pairs_per_item`` pairs: items stand on a circle in a
    pseudo-random order and meet those a few steps on. ``within`` makes a circle for each of its groups."""
    ids = items.select(F.col(id_col).alias("id"), *within).where(F.col("id").isNotNull()).distinct()
    sizes = ids.groupBy(*within).agg(F.count("*").alias("n"))
    counts = [r.n for r in sizes.collect()]
    big = [n for n in counts if n >= 2]
    if not big:
        return ids.where(F.lit(False)).select(F.col("id").alias("item1"), F.col("id").alias("item2"), *within)
    pos = ranked(ids, order_key(seed, "id"), "id", within=within)
    pos = pos.join(sizes, list(within)) if within else pos.withColumn("n", F.lit(counts[0]))
    degrees = {n: degree(n, pairs_per_item) for n in set(big)}
    steps = None
    for n, k in degrees.items():
        own = _steps(k, F.col("n"))
        steps = F.when(F.col("n") == n, own) if steps is None else steps.when(F.col("n") == n, own)
    # In an odd ring of odd degree, the middle one meets the last, which is as many steps on.
    edges = pos.where("n >= 2").withColumn("step", F.explode(steps)).select(*within, F.col("id").alias("a"), ((F.col("pos") + F.col("step")) % F.col("n")).alias("pos"))
    to = pos.select(*within, F.col("id").alias("b"), "pos")
    out = edges.join(to, [*within, "pos"])
    return out.select(F.least("a", "b").alias("item1"), F.greatest("a", "b").alias("item2"), *within)


def split_items(items: DataFrame, test_size: float = 0.15, eval_size: float = 0.15, seed: int = 42, id_col: str = "item_id") -> DataFrame:
    """items with ``split``: exact shares of a pseudo-random order, test first, then eval of what is left."""
    if test_size <= 0 or eval_size <= 0 or test_size + eval_size >= 1:
        raise ValueError("test_size and eval_size must be positive and sum to less than 1")
    n = items.count()
    n_test = math.ceil(n * test_size)
    n_eval = math.ceil((n - n_test) * eval_size / (1 - test_size))
    out = ranked(items, order_key(f"split{seed}", id_col), id_col, into="_pos")
    split = F.when(F.col("_pos") < n_test, "test").when(F.col("_pos") < n_test + n_eval, "eval").otherwise("train")
    return out.withColumn("split", split).drop("_pos")


def mixed_pairs(split: DataFrame, pairs: DataFrame, number: int = 10, seed: int = 42, id_col: str = "item_id") -> DataFrame:
    """For each two splits, max(1, number // 3) pairs across them that aren't paired yet. Candidates are the first of
    either split in a pseudo-random order, as many as are sure to leave enough: no product of the splits is built."""
    per = max(1, number // 3)
    taken = pairs.select(F.least("item1", "item2").alias("item1"), F.greatest("item1", "item2").alias("item2")).distinct()
    # Each item has few partners, so that a corner of this side holds per free pairs or all there are.
    most = taken.select(F.explode(F.array("item1", "item2")).alias("i")).groupBy("i").count().agg(F.max("count")).first()[0] or 0
    side = int(math.isqrt(per)) + 1 + int(most)
    pos = ranked(split.select(F.col(id_col).alias("id"), "split"), order_key(f"mix{seed}", "id"), "id", within=("split",)).where(F.col("pos") < side)
    a, b = pos.select(F.col("id").alias("a"), F.col("split").alias("sa")), pos.select(F.col("id").alias("b"), F.col("split").alias("sb"))
    cross = a.join(F.broadcast(b), F.col("sa") < F.col("sb")).select(F.least("a", "b").alias("item1"), F.greatest("a", "b").alias("item2"), "sa", "sb")
    free = cross.join(taken, ["item1", "item2"], "left_anti")
    w = Window.partitionBy("sa", "sb").orderBy(order_key(f"mixed{seed}", "item1", "item2"), "item1", "item2")
    return free.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per).select("item1", "item2", F.col("sa").alias("split_a"), F.col("sb").alias("split_b"))


def generate_pairings(
    items: DataFrame, pairs_per_item: int = 10, seed: int = 42, make_splits: bool = False, test_size: float = 0.15, eval_size: float = 0.15,
    include_mixed: bool = False, number_mixed: int = 10, id_col: str = "item_id",
) -> DataFrame:
    """(item1, item2, item1_split, item2_split): pairs inside splits, and some across them. Sizes other than the
    defaults ask for splits."""
    if not make_splits and (test_size, eval_size) == (0.15, 0.15):
        none = F.lit(None).cast("string")
        return pair_items(items, pairs_per_item, seed, id_col).withColumns({"item1_split": none, "item2_split": none})
    split = split_items(items.select(id_col).distinct(), test_size, eval_size, seed, id_col)
    own = pair_items(split, pairs_per_item, seed, id_col, within=("split",)).withColumns({"item1_split": F.col("split"), "item2_split": F.col("split")}).drop("split")
    if include_mixed:
        more = mixed_pairs(split, own, number_mixed, seed, id_col).select("item1", "item2")
        for side in ("item1", "item2"):
            own_split = split.select(F.col(id_col).alias(side), F.col("split").alias(f"{side}_split"))
            more = more.join(own_split, side)
        own = own.unionByName(more)
    return own


def new_pairs(items: DataFrame, new_ids: DataFrame, pairs_per_item: int = 10, seed: int = 42, id_col: str = "item_id") -> DataFrame:
    """Pairs of the enlarged set of items that touch a new one."""
    overlap = items.select(id_col).intersect(new_ids.select(id_col)).limit(1).count()
    if overlap:
        raise ValueError("some new items are there already")
    fresh = new_ids.select(F.col(id_col).alias("_id")).distinct()
    pairs = pair_items(items.select(id_col).unionByName(new_ids.select(id_col)), pairs_per_item, seed, id_col)
    a = pairs.join(fresh, F.col("item1") == F.col("_id"), "left_semi")
    b = pairs.join(fresh, F.col("item2") == F.col("_id"), "left_semi")
    return a.union(b).distinct()
