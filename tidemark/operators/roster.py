"""Small lookups of identities: rosters, profiles, consensus of candidates and picks that have to be clear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def actors(tracks: DataFrame, roster: DataFrame, assigned: DataFrame, track: str) -> DataFrame:
    """tracks with actor: the roster's (columns track, actor, order; the last one wins), else the assignment's."""
    last = roster.groupBy(track).agg(F.max_by("actor", "order").alias("_roster"))
    other = assigned.groupBy(track).agg(F.min("actor").alias("_assigned"))
    return tracks.join(last, track, "left").join(other, track, "left").withColumn("actor", F.coalesce("_roster", "_assigned")).drop("_roster", "_assigned")


def merged_profiles(old: DataFrame, new: DataFrame, match: str) -> DataFrame:
    """Detected rosters (match, id, name, team) with the names that users gave before; a match without a fresh roster
    keeps its old one."""
    names = old.select(match, "id", F.nullif(F.trim("name"), F.lit("")).alias("_name"))
    fresh = new.join(names, [match, "id"], "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")
    kept = old.join(new.select(match).distinct(), match, "left_anti")
    return fresh.unionByName(kept)


def same_members(a: DataFrame, b: DataFrame, keys: list[str], member: str) -> DataFrame:
    """keys, same: whether both sides list exactly the same members."""
    x = a.select(*keys, member).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys, member).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, [*keys, member], "full")
    return both.groupBy(*keys).agg(F.min((F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("int")).alias("_s")).select(*keys, (F.col("_s") == 1).alias("same"))


def consensus(candidates: DataFrame, keys: list[str], tie: str, points: str, score: str, radius: float) -> DataFrame:
    """Per key, the element-wise median of the largest neighbourhood: the candidates within radius (root mean square
    distance of their points, an array of numbers) of one; then the one with the greater score, then the smaller tie.

    A key is one scene with a bounded number of sampled frames; its candidates are paired with each other.
    """
    a, b = (candidates.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in (tie, points, score))) for p in "ab")
    apart = F.aggregate(F.zip_with(f"a_{points}", f"b_{points}", lambda x, y: (x - y) ** 2), F.lit(0.0), lambda s, x: s + x)
    near = a.join(b, keys).filter(F.sqrt(apart / (F.size(f"a_{points}") / 2)) <= radius)
    sizes = near.groupBy(*keys, f"a_{tie}", f"a_{score}").agg(F.count("*").alias("support"))
    best = sizes.groupBy(*keys).agg(F.max_by(F.struct(f"a_{tie}", "support"), F.struct("support", f"a_{score}", -F.col(f"a_{tie}"))).alias("_best"))
    chosen = near.join(best, keys).filter(F.col(f"a_{tie}") == F.col(f"_best.a_{tie}"))
    flat = chosen.select(*keys, F.col("_best.support").alias("support"), F.posexplode(f"b_{points}").alias("_i", "_x"))
    middle = flat.groupBy(*keys, "support", "_i").agg(F.percentile("_x", F.lit(0.5)).alias("_m"))
    return middle.groupBy(*keys, "support").agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v")).select(*keys, "support", F.col("_v._m").alias(points))


def clear_best(df: DataFrame, keys: list[str], score: str, tie: str, margin: float) -> DataFrame:
    """The best row of each key, unless the next one comes within margin of it."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie)
    rows = df.withColumns({"_rank": F.row_number().over(w), "_next": F.lead(score).over(w)})
    return rows.filter((F.col("_rank") == 1) & (F.col("_next").isNull() | (F.col(score) - F.col("_next") >= margin))).drop("_rank", "_next")


def top_per_side(df: DataFrame, keys: list[str], side: str, area: Column, tie: str, n: int) -> DataFrame:
    """The n largest rows of each side of each key, for keys that fill both sides."""
    w = Window.partitionBy(*keys, side).orderBy(area.desc(), tie)
    best = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    full = best.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") == 2 * n).drop("_n")
    return best.join(full, keys, "left_semi")
