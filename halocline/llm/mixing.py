"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree of domain, language and source. A token budget runs down the tree: each node gives its
children shares by weight, none more than its subtree can supply (its tokens times `max_epochs`). What a child cannot
take is shared among its siblings by weight first; only what a whole subtree cannot take has reached the level above,
since the subtree's supply was the limit there. All sums are whole numbers.

A leaf's documents are put in a seeded random order for each epoch. It takes whole epochs while its budget holds them,
then the first tokens of the next epoch's order, to the token: the document in which the budget ends is taken in part, so that
every leaf spends what it was given.

No order is ever built: the prefix's end is found from token sums per leaf and hash bucket, then among the documents of
the one bucket in which it ends. What is joined to the documents is one row per leaf.

Defined results: null text has 0 tokens; null domain, language or source is a value of its own; weights that aren't
given are 1; leaves without tokens get no budget and none of their documents stays; repeated rows share their place in
the order and are taken together, in equal parts (rounded down) where the budget ends in them; an empty table gives an empty result; other columns pass through untouched, and a
result column whose name is taken gets underscores before it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, fresh, small_side, written

LEVELS = ("domain", "lang", "source")
BUCKET_DIGITS = 3  # hexadecimal, of the order key


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def weight_of(level: str, weights: Mapping[str, Mapping[str, int]] | None) -> Column:
    given = (weights or {}).get(level, {})
    out = F.lit(1)
    for value, weight in given.items():
        out = F.when(F.col(level) == value, F.lit(int(weight))).otherwise(out)
    return out.cast("decimal(38,0)")


def shared_out(nodes: DataFrame, parent: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Column `budget` for nodes (parent's `given`, own `weight` and `supply`), filling siblings level by level.

    Siblings are taken in order of supply by weight. One whose supply is within its share of what is left by those
    before it is filled; the others share the rest by weight, rounded down.
    """
    ratio = F.col("supply").cast("double") / F.col("weight").cast("double")
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = by.orderBy(ratio, *order).rowsBetween(Window.unboundedPreceding, -1)
    after = by.orderBy(ratio, *order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    seen = nodes.withColumns({"taken": F.coalesce(F.sum("supply").over(before), F.lit(0).cast("decimal(38,0)")), "left_weight": F.sum("weight").over(after)})
    full = F.col("supply") * F.col("left_weight") <= F.col("weight") * (F.col("given") - F.col("taken"))
    marked = seen.withColumn("full", full)
    # From the first that isn't full on, none is: the fill level is that one's.
    first = by.orderBy(ratio, *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.min(F.when(~F.col("full"), F.struct(ratio.alias("r"), *order, F.col("taken").alias("t"), F.col("left_weight").alias("w")))).over(first)
    exact = F.expr("cast((weight * (given - level.t)) div level.w as decimal(38,0))")
    return marked.withColumn("level", level).withColumn("budget", F.when(F.col("full"), F.col("supply")).otherwise(exact)).drop("taken", "left_weight", "full", "level")


def leaf_budgets(leaves: DataFrame, budget: int, weights: Mapping | None = None, max_epochs: int = 1, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Budgets for leaves (the levels, tokens): adds supply and budget, both decimal."""
    d = "decimal(38,0)"
    base = leaves.withColumn("supply", (F.col("tokens") * max_epochs).cast(d)).where("supply > 0")
    given = None
    for depth, level in enumerate(levels, 1):
        keys, parent = levels[:depth], levels[: depth - 1]
        nodes = base.groupBy(*keys).agg(F.sum("supply").cast(d).alias("supply")).withColumn("weight", weight_of(level, weights)).where("weight > 0")
        if given is None:
            nodes = nodes.withColumn("given", F.lit(budget).cast(d))
        else:
            up = given.select(*[F.col(k).alias(f"up_{k}") for k in parent], F.col("budget").alias("given"))
            on = [F.col(k).eqNullSafe(F.col(f"up_{k}")) for k in parent]
            nodes = nodes.join(up, on).drop(*[f"up_{k}" for k in parent])
        given = shared_out(nodes, parent, (level,))
    return given.select(*levels, "supply", "budget")


def mixed(docs: DataFrame, budget: int | None = None, share: float = 0.5, weights: Mapping | None = None, max_epochs: int = 1, seed: int = 0, tokens: Column | None = None, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """`docs` (with doc_id and the levels of the tree) repeated by the epochs that take them, in two further columns
    mix_epoch and mix_tokens (those taken: of one document a leaf, only the first). The budget is `budget` tokens, or `share` of all."""
    count = words(F.col("text")) if tokens is None else tokens
    own = [f"l{i}" for i in range(len(levels))]  # the levels' names inside
    inside = {f"l{i}": (weights or {}).get(level, {}) for i, level in enumerate(levels)}
    same = lambda prefix, left=own: [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(left)]
    named = lambda prefix: [F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(own)]
    light = written(docs.select("doc_id", *[F.col(k).alias(o) for k, o in zip(levels, own, strict=True)], count.alias("tokens")), "mix-tokens")
    leaves = written(light.groupBy(*own).agg(F.sum("tokens").cast("long").alias("tokens")), "mix-leaves")
    if budget is None:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    cut = leaf_budgets(leaves, budget, inside, max_epochs, tuple(own)).join(leaves.select(*named("a"), "tokens"), same("a"))
    cut = written(cut.select(*own, F.expr("cast(budget div tokens as int)").alias("whole"), F.expr("cast(budget % tokens as bigint)").alias("part")), "mix-cuts")
    keyed = light.join(small_side(cut.select(*named("c"), "whole", "part"), 200), same("c")).where("part > 0").select("doc_id", *own, "tokens", "part", order_key(seed, F.col("whole"), F.col("doc_id")).alias("key"))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*own, "bucket").agg(F.sum("tokens").alias("t"), F.first("part").alias("part"))
    running = F.sum("t").over(Window.partitionBy(*own).orderBy("bucket"))
    # The first bucket that passes the budget, and what is left for it.
    ends = sums.withColumn("upto", running).where("upto > part").groupBy(*own).agg(F.min(F.struct("bucket", (F.col("part") - F.col("upto") + F.col("t")).alias("room"))).alias("e"))
    ends = written(ends.select(*own, "e.bucket", "e.room"), "mix-ends")
    rest = keyed.withColumnRenamed("bucket", "at").join(small_side(ends.select(*named("e"), "bucket", "room"), 200), same("e")).where("at = bucket")
    upto = F.sum("tokens").over(Window.partitionBy(*own).orderBy("key"))  # rows of equal key count together
    rest = rest.groupBy(*own, "key", "room").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).withColumn("upto", upto)
    # The last key that fits, and the next one, in which the budget ends, with the tokens a row that are left for it.
    edge = F.min(F.when(F.col("upto") > F.col("room"), F.struct("key", F.floor((F.col("room") - F.col("upto") + F.col("tokens")) / F.col("rows")).cast("bigint").alias("cut"))))
    last = rest.groupBy(*own).agg(F.max(F.when(F.col("upto") <= F.col("room"), F.col("key"))).alias("key"), edge.alias("edge"))
    # Keys up to `stop` are taken: the last that fits, else all before the end's bucket.
    stops = ends.join(last.select(*named("s"), "key", "edge"), same("s"), "left").select(*named("t"), F.coalesce("key", "bucket").alias("stop"), F.col("edge.key").alias("at"), F.col("edge.cut").alias("cut"))
    plan = written(cut.join(stops, same("t"), "left").select(*own, "whole", "stop", "at", "cut"), "mix-plan")
    drop_written(light, leaves, cut, ends)
    # One row a leaf meets the documents, under names that none of their columns has.
    name = {k: fresh(docs.columns, f"mix_{k}") for k in (*own, "whole", "stop", "at", "cut", "key", "times", "epoch", "tokens")}
    joined = docs.join(small_side(plan.select(*[F.col(k).alias(name[k]) for k in (*own, "whole", "stop", "at", "cut")]), 240), [F.col(k).eqNullSafe(F.col(name[o])) for k, o in zip(levels, own, strict=True)])
    keyed = joined.withColumn(name["key"], order_key(seed, F.col(name["whole"]), F.col("doc_id")))
    partly = F.coalesce((F.col(name["key"]) == F.col(name["at"])) & (F.col(name["cut"]) > 0), F.lit(False))
    times = F.col(name["whole"]) + (F.coalesce(F.col(name["key"]) <= F.col(name["stop"]), F.lit(False)) | partly).cast("int")
    out = keyed.withColumn(name["times"], times).where(F.col(name["times"]) > 0)
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.col(name["times"]) - 1)).alias(name["epoch"]))
    taken = F.when(partly & (F.col(name["epoch"]) == F.col(name["whole"])), F.least(count, F.col(name["cut"]))).otherwise(count)
    return out.select(*docs.columns, name["epoch"], taken.alias(name["tokens"]))


def first_words(text: Column, n: Column) -> Column:
    """A text's beginning with its first n words (n >= 1); the whole text if it has no more."""
    space = r"[ \t\n\x0B\f\r]+"
    # What a split into n + 1 pieces leaves for the last is all behind n words; white space in front makes a piece of its own.
    leading = text.rlike(f"^{space}").cast("int")
    behind = F.element_at(F.split(text, space, (n + leading + 1).cast("int")), -1)
    return F.when(words(text) > n, F.regexp_replace(F.substring(text, F.lit(1), F.char_length(text) - F.char_length(behind)), f"{space}$", "")).otherwise(text)
