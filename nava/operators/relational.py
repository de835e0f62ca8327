"""Splits, groups, keyed choices, samples, budgets, ledgers and table comparison.

Order always comes from explicit keys. Running sums over a whole table are two-level: sums of hash or range parts first, then
within the part, so no operator needs all rows in one task.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nava.session import stored
from nava.sources.files import merged


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(w)).where("__row = 1").drop("__row")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_wins(df, keys, [F.col(c).desc() for c in order])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(w)).where(F.col("__row") <= k).drop("__row")


def argmax(df: DataFrame, keys: list[str], value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*by)).alias(value))


def rebuild_splits(validated: DataFrame, dev: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """split, key: test as given; dev of what is validated and not test; train of what is validated and neither."""
    ids = lambda df: df.select(key).distinct()
    own_dev = ids(validated).join(ids(dev), key, "left_semi").join(ids(test), key, "left_anti")
    train = ids(validated).join(ids(test), key, "left_anti").join(ids(dev), key, "left_anti")
    named = [(n, d) for n, d in (("test", ids(test)), ("dev", own_dev), ("train", train))]
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("split"), key) for n, d in named])


def hash_unit(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from 52 bits of a digest; equal in every engine."""
    text = F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long") / float(1 << 52)


def stable_split(df: DataFrame, group: Column, seed: str, shares: dict[str, float]) -> DataFrame:
    """A split by group digest: all rows of a group share it."""
    unit, out, bound = hash_unit(seed, group), None, 0.0
    names = list(shares)
    for name in names[:-1]:
        bound += shares[name]
        out = F.when(unit < bound, name) if out is None else out.when(unit < bound, name)
    return df.withColumn("split", out.otherwise(names[-1]) if out is not None else F.lit(names[-1]))


def complete_groups(children: DataFrame, usable: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """group, total, rows, complete: whether every child's key is usable."""
    mark = usable.select(key).distinct().withColumn("__usable", F.lit(True))
    return children.join(mark, key, "left").groupBy(group).agg(
        F.sum(value).alias("total"), F.count("*").alias("rows"), F.bool_and(F.coalesce("__usable", F.lit(False))).alias("complete")
    )


def running_sum(df: DataFrame, order: Column, value: str, tie: list[str], parts: int = 256) -> DataFrame:
    """Adds running (the sum up to and with the row), by an order key in hex or number text whose first characters spread evenly.

    order must be a string; its first two characters are the part, so sums of parts are added to sums within.
    """
    rows = df.withColumn("__order", order).withColumn("__part", F.substring("__order", 1, 2))
    sums = rows.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sums = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy("__order", *tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__within", F.sum(value).over(within)).join(F.broadcast(sums), "__part")
    return rows.withColumn("running", F.col("__before") + F.col("__within")).drop("__part", "__before", "__within")


def closest_prefix(groups: DataFrame, key: str, value: str, target: float, seed: str) -> DataFrame:
    """Groups in seeded order up to the first running sum that reaches the target; the last goes if the sum before was at least as close.

    Never empty while there are groups. The order is by SHA-256 of seed, a zero byte and the key.
    """
    if target <= 0:
        raise ValueError("the target must be positive")
    order = F.sha2(F.concat(F.lit(seed), F.lit("\0"), F.col(key).cast("string")), 256)
    rows = running_sum(groups, order, value, [key]).withColumn("before", F.col("running") - F.col(value))
    kept = rows.where(F.col("before") < target)
    crossing = (F.col("running") >= target) & (F.col("before") > 0) & (target - F.col("before") <= F.col("running") - target)
    return kept.where(~crossing).drop("__order", "before")


def ordered_sum(df: DataFrame, keys: list[str | Column], value: str | Column, name: str = "running") -> DataFrame:
    """Adds the sum up to and with the row, in the order of any keys.

    Rows are range-partitioned by the keys and written out; sums of partitions are added up (a row for each partition), and rows within.
    """
    order = [F.col(k) if isinstance(k, str) else k for k in keys]
    dealt = df.withColumn("__value", value if isinstance(value, Column) else F.col(value)).repartitionByRange(*order)
    rows = stored(dealt.withColumn("__part", F.spark_partition_id()), "ordered-sum")
    sums = rows.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__within", F.coalesce(F.sum("__value").over(within), F.lit(0))).join(F.broadcast(sums), "__part")
    return rows.withColumn(name, F.col("__before") + F.col("__within")).drop("__value", "__part", "__before", "__within")


def budget_stop(df: DataFrame, keys: str | list[str | Column], value: str, limit: int) -> DataFrame:
    """Rows in key order before the first that would exceed the limit; smaller later rows aren't let in."""
    return ordered_sum(df, keys if isinstance(keys, list) else [keys], value).where(F.col("running") <= limit)


def positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the row's place from 0 in its group's order; a group of any size is dealt to many tasks."""
    rows = ordered_sum(df, [*group, *order], F.lit(1), "__running")
    starts = rows.groupBy(*group).agg(F.min("__running").alias("__first"))
    starts = starts.select(*[F.col(g).alias(f"__start.{g}") for g in group], "__first")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"`__start.{g}`")) for g in group])
    return rows.join(starts, same).withColumn(name, (F.col("__running") - F.col("__first")).cast("long")).select(*df.columns, name)


def cohorts(df: DataFrame, order: list[str], size: int, group: list[str]) -> DataFrame:
    """Fixed-size batches in arrival order within groups."""
    return positions(df, group, order, "__at").withColumn("cohort", F.floor(F.col("__at") / size).cast("long")).drop("__at")


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """At most n rows, uniform and equal in every run."""
    return df.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def balanced_sample(df: DataFrame, flag: Column, key: str, n: int, seed: str) -> DataFrame:
    """n rows, half of each class; what one class lacks the other gives."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    rows = df.withColumn("__flag", flag).withColumn("__order", order)
    picked = [rows.where(c).orderBy("__order", key).limit(n) for c in ("__flag", "not __flag")]  # at most 2 * n rows
    both = picked[0].unionByName(picked[1])
    rank = F.row_number().over(Window.partitionBy("__flag").orderBy("__order", key))
    have = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(Window.partitionBy())
    both = both.withColumn("__rank", rank).withColumn("__yes", have(F.col("__flag"))).withColumn("__no", have(~F.col("__flag")))
    half = n // 2
    yes_quota = F.greatest(F.lit(half), n - F.least(F.col("__no"), F.lit(n - half)))
    no_quota = n - F.least(F.col("__yes"), yes_quota)
    return both.where(F.col("__rank") <= F.when(F.col("__flag"), yes_quota).otherwise(no_quota)).drop("__flag", "__order", "__rank", "__yes", "__no")


def preferred_else_all(df: DataFrame, group: list[str], preferred: Column, usable: Column, order: list[str]) -> DataFrame:
    """Per group the first preferred row; in groups without one, every usable row."""
    w = Window.partitionBy(*group)
    ranked = Window.partitionBy(*group, preferred).orderBy(*order)
    rows = df.withColumn("__any", F.max(preferred.cast("int")).over(w)).withColumn("__rank", F.row_number().over(ranked))
    return rows.where((preferred & (F.col("__rank") == 1)) | ((F.col("__any") == 0) & usable)).drop("__any", "__rank")


def weighted_choice(df: DataFrame, unit: Column, choices: list[tuple[str, float]], name: str) -> DataFrame:
    """A choice by cumulative weights; the list is fixed and small, so it becomes one expression."""
    total, bound, out = sum(w for _, w in choices), 0.0, None
    for value, weight in choices[:-1]:
        bound += weight / total
        out = F.when(unit < bound, value) if out is None else out.when(unit < bound, value)
    return df.withColumn(name, out.otherwise(choices[-1][0]) if out is not None else F.lit(choices[-1][0]))


def variants(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def date_spine(keys: DataFrame, first: Column, last: Column) -> DataFrame:
    return keys.withColumn("day", F.explode(F.sequence(first, last)))


# Ledgers


def reuse(work: DataFrame, prior: DataFrame, key: str, same: list[str]) -> DataFrame:
    """work with reused: a prior row that isn't an operational failure and agrees in the columns of `same`."""
    old = prior.select(key, *[F.col(c).alias(f"__{c}") for c in same], F.col("operational").alias("__operational"))
    rows = work.join(old, key, "left")
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same])
    known = F.col("__operational").isNotNull() & ~F.coalesce("__operational", F.lit(True))
    return rows.withColumn("reused", known & equal).select(*work.columns, "reused")


def upsert_groups(prior: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Prior rows of groups without new rows, and all new rows."""
    return prior.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def overlay(prior: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union of rows by key; where a new row exists its values win, nulls too."""
    old = prior.select(key, F.struct(*[c for c in prior.columns if c != key]).alias("__old"))
    fresh = new.select(key, F.struct(*[c for c in new.columns if c != key]).alias("__new"))
    rows = old.join(fresh, key, "full")
    pick = lambda c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c)
    return rows.select(key, *[pick(c) for c in prior.columns if c != key])


def stale(derived: DataFrame, upstream: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose upstream digest is another by now, or whose upstream is gone."""
    now = upstream.select(key, F.col(digest).alias("__now"))
    return derived.join(now, key, "left").where(~F.col(digest).eqNullSafe(F.col("__now"))).drop("__now")


def fingerprint(df: DataFrame, key: str, value: str) -> DataFrame:
    """One digest of a whole table, whatever its order: sums of 128-bit row digests."""
    text = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col(value).cast("string")), 256)
    word = lambda i: F.conv(F.substring(text, i, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.concat_ws("-", F.hex(F.pmod(F.sum(word(1)), F.lit(1 << 48)).cast("long")), F.hex(F.pmod(F.sum(word(13)), F.lit(1 << 48)).cast("long"))).alias("fingerprint"))


def not_existing(work: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Work whose output isn't there yet or is empty."""
    return work.join(listing.where("length > 0").select(key), key, "left_anti")


# Comparison


def table_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, side: only_left, only_right or changed."""
    a = left.select(key, F.struct(*columns).alias("__a"))
    b = right.select(key, F.struct(*columns).alias("__b"))
    rows = a.join(b, key, "full")
    side = F.when(F.col("__b").isNull(), "only_left").when(F.col("__a").isNull(), "only_right").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return rows.select(key, side.alias("side")).where("side is not null")


def ordered_differences(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Ordinals at which two ordered tables of equal columns differ; different columns raise."""
    if left.columns != right.columns:
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    return table_diff(left, right, ordinal, [c for c in left.columns if c != ordinal])


def labelled_union(tables: dict[str, DataFrame], label: str = "dataset") -> DataFrame:
    parts = [df.withColumn(label, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# Orders and pairings


def resumable_order(df: DataFrame, key: str, seed: str, epoch: int, skip: int = 0) -> DataFrame:
    """Adds position: a permutation by seed and epoch, from which the first `skip` rows are left out."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.lit(str(epoch)), F.col(key).cast("string")), 256)
    rows = running_sum(df.withColumn("__one", F.lit(1)), order, "__one", [key])
    return rows.where(F.col("running") > skip).withColumn("position", (F.col("running") - 1).cast("long")).drop("__one", "__order", "running")


def dealt(df: DataFrame, key: str, hands: int, seed: str) -> DataFrame:
    """Adds hand: rows in seeded order are dealt in turn, so hands differ by one row at most."""
    rows = resumable_order(df, key, seed, 0)
    return rows.withColumn("hand", F.pmod("position", F.lit(hands)).cast("int")).drop("position")


def zipped(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Rows of equal ordinals; an ordinal that only one side has is an error."""
    alone = left.select(ordinal).join(right.select(ordinal), ordinal, "left_anti").unionByName(right.select(ordinal).join(left.select(ordinal), ordinal, "left_anti"))
    if rows := alone.take(3):
        raise ValueError(f"ordinals without a partner: {[r[0] for r in rows]}")
    return left.join(right, ordinal)


def readable_until(df: DataFrame, key: str, readable: Column, n: int, seed: str) -> DataFrame:
    """The first n readable rows in seeded order."""
    return seeded_sample(df.where(readable), key, n, seed)


def lookup(df: DataFrame, name: Column, table: dict[str, dict[str, str | int]], fields: list[str]) -> DataFrame:
    """Fields of a fixed dimension as columns, by a name; null for other names."""
    for field in fields:
        pairs = [F.lit(x) for k, v in table.items() for x in (k, v[field])]
        df = df.withColumn(field, F.try_element_at(F.create_map(*pairs), name))
    return df


def longest(df: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """The longest text of each group; of equally long ones the first in order."""
    first = F.struct(-F.length(text), F.col(order))
    return df.groupBy(*keys).agg(F.min_by(text, first).alias(text))


def pool_choice(df: DataFrame, pool: DataFrame, key: str, unit: Column) -> DataFrame:
    """Adds key: one of the pool's, drawn with replacement by a number in [0, 1)."""
    own = ordered_sum(pool.select(key), [key], F.lit(1), "__at").withColumn("__at", (F.col("__at") - 1).cast("long"))
    n = pool.count()
    return df.withColumn("__at", F.floor(unit * n).cast("long")).join(own, "__at").drop("__at")


def choose_profile(df: DataFrame, unit: Column, defaults: dict, profiles: list[dict]) -> DataFrame:
    """Adds profile, drawn by weight, and settings: JSON of the defaults with the profile's overrides merged in depth."""
    names = [(p.get("name", "unnamed"), p.get("weight", 1.0)) for p in profiles] or [("legacy", 1.0)]
    rows = weighted_choice(df, unit, names, "profile")
    merged_ = {p.get("name", "unnamed"): merged(defaults, {k: v for k, v in p.items() if k not in ("name", "weight", "description")}) for p in profiles}
    pairs = [F.lit(x) for name, _ in names for x in (name, json.dumps(merged_.get(name, defaults), sort_keys=True))]
    return rows.withColumn("settings", F.create_map(*pairs)[F.col("profile")])


def facts_agree(recorded: DataFrame, found: DataFrame, key: str, equal: list[str], near: dict[str, float]) -> DataFrame:
    """key, reason: missing, or the first column in which what was found differs from what was recorded; null if all agree."""
    other = found.select(key, F.lit(True).alias("__there"), *[F.col(c).alias(f"__{c}") for c in [*equal, *near]])
    rows = recorded.join(other, key, "left")
    reason = F.when(F.col("__there").isNull(), "missing")
    for c in equal:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), c)
    for c, tolerance in near.items():
        reason = reason.when(~F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance, F.lit(False)), c)
    return rows.select(key, reason.alias("reason"))


def canonical_digest(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted names and without spaces; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def gate_problem(found: Column, wanted: Column, force: Column) -> Column:
    """"refused" where stored results have another configuration's digest and nothing forces them."""
    return F.when(found.isNotNull() & (found != wanted) & ~force, "refused")


def expected_checksum(path: Column, state_path: Column, state_checksum: Column, manifest_path: Column, manifest_checksum: Column) -> Column:
    """What a file should have: by the state, then by the manifest, each only if it speaks of the same path."""
    return F.coalesce(F.when(state_path == path, state_checksum), F.when(manifest_path == path, manifest_checksum))


def checkpoints(entries: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    """keys, done: whether none of a key's entries failed."""
    return entries.groupBy(*keys).agg((~F.bool_or(F.coalesce(failed, F.lit(False)))).alias("done"))


def undiscovered(work: DataFrame, state: DataFrame, key: str, status: str, done: str) -> DataFrame:
    """Work whose key has no state of being done; failed keys come again."""
    return work.join(state.where(F.col(status) == done).select(key).distinct(), key, "left_anti")


def digest_mismatches(found: DataFrame, recorded: DataFrame, key: str, digest: str) -> DataFrame:
    """key, problem: files without a recorded digest, or with another one."""
    other = recorded.select(key, F.col(digest).alias("__digest"))
    problem = F.when(F.col("__digest").isNull(), "missing").when(F.col("__digest") != F.col(digest), "changed")
    return found.join(other, key, "left").select(key, problem.alias("problem")).where("problem is not null")
