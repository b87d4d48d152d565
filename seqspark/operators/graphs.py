"""Homology graphs: edges, maximal independent sets, covers, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch


def settled(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back; iterations then start from files that outlive executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, once each, without loops."""
    some = edges.select("a", "b").where("a <> b")
    return some.unionByName(some.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def degrees(edges: DataFrame, unique: bool = False) -> DataFrame:
    """(v, degree); edges that are unique already (a < b, each once) are counted before they are shuffled."""
    if unique:
        return edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
    return undirected(edges).groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("degree"))


def pendants(edges: DataFrame) -> DataFrame:
    """(v, neighbour) of the vertices with one edge."""
    return undirected(edges).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("neighbour"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def completeness(vertices: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """(by, n, m, complete, empty): of each group of vertices the numbers of vertices and edges (a < b), and whether all or none are there."""
    n = vertices.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    m = edges.groupBy(by).agg(F.count(F.lit(1)).alias("m"))
    both = n.join(m, by, "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return both.select(by, "n", "m", (2 * F.col("m") == F.col("n") * (F.col("n") - 1)).alias("complete"), (F.col("m") == 0).alias("empty"))


def dump_adjacency(edges: DataFrame, path: str) -> None:
    """A line for each vertex a: itself and its neighbours b, in order, parted by blanks."""
    lists = edges.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("b"))
    lists.select(F.concat_ws(" ", F.col("a").cast("string"), F.array_join(F.col("b").cast("array<string>"), " "))).write.text(path)


def load_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) of the lines of dump_adjacency."""
    ids = F.transform(F.split("value", " "), lambda x: x.cast("long"))
    return spark.read.text(path).select(F.get(ids, 0).alias("a"), F.explode(F.slice(ids, 2, F.size(ids) - 1)).alias("b"))


def independent_set(vertices: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """A maximal independent set of (v), the same for every partitioning.

    Rounds: a vertex whose (degree, hash by seed, id) is least among its neighbours joins, its neighbours leave. Vertices without
    edges join at once. The number of rounds is logarithmic in expectation; each round is two narrow joins."""
    both = settled(undirected(edges))
    rank = both.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("d")).select("v", F.struct("d", F.xxhash64("v", F.lit(seed)).alias("h"), "v").alias("r"))
    live = settled(both.join(rank.select(F.col("v").alias("a"), F.col("r").alias("ra")), "a").join(rank.select(F.col("v").alias("b"), F.col("r").alias("rb")), "b").select("a", "b", "ra", "rb"))
    out = [vertices.select("v").distinct().join(both.select(F.col("a").alias("v")).distinct(), "v", "left_anti")]
    left = settled(both.select(F.col("a").alias("v")).distinct())
    while not left.isEmpty():
        beaten = live.where("rb < ra").select(F.col("a").alias("v")).distinct()
        won = settled(left.join(beaten, "v", "left_anti"))
        out.append(won)
        lost = live.join(won.withColumnRenamed("v", "a"), "a", "left_semi").select(F.col("b").alias("v"))
        gone = settled(won.unionByName(lost).distinct())
        left = settled(left.join(gone, "v", "left_anti"))
        live = settled(live.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def independent_in_groups(vertices: DataFrame, members: DataFrame, seed: int = 0) -> DataFrame:
    """A maximal set of (v) no two of which are in one group of members (v, g; each once), the same for every partitioning.

    As independent_set on the graph in which members of a group are neighbours, without its edges, whose number grows with the square
    of groups: a vertex is least among its neighbours if it is in each of its groups. Its rank starts with the sum of its groups' other
    members, which counts a neighbour for each group in common. A round shuffles the memberships that are left."""
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Sizes are estimated before rows become many, so what would be broadcast is far larger than it looks, and the driver holds it: all joins merge.
    held = settled(members.select("v", "g").join(sizes.hint("merge"), "g"))
    rank = held.groupBy("v").agg(F.sum(F.col("n") - 1).alias("d"))
    live = settled(held.join(rank.hint("merge"), "v").select("g", "d", "v"))
    r = F.struct("d", F.xxhash64("v", F.lit(seed)).alias("h"), "v")
    out = [vertices.select("v").distinct().join(held.select("v").distinct().hint("merge"), "v", "left_anti")]
    while not live.isEmpty():
        least = live.groupBy("g").agg(F.min(r).alias("m"))
        first = live.join(least.hint("merge"), "g").groupBy("v").agg(F.bool_and(r == F.col("m")).alias("won")).where("won")
        won = settled(first.select("v"))
        out.append(won)
        taken = live.join(won.hint("merge"), "v", "left_semi").select("g").distinct()
        gone = live.join(taken.hint("merge"), "g", "left_semi").select("v").distinct()
        live = settled(live.join(gone.hint("merge"), "v", "left_anti"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def vertex_cover(vertices: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """The rest of a maximal independent set: every edge has an end in it."""
    return vertices.select("v").distinct().join(independent_set(vertices, edges, seed), "v", "left_anti")


def maximal_sets(members: DataFrame, group: str, member: str) -> DataFrame:
    """Groups whose set of members isn't part of another group's; of equal sets the one with the least group stays.

    A set is part of another only if that one has its rarest member, too: there whole sets meet and are compared, and no pairs are shuffled."""
    sets = members.groupBy(F.col(group).alias("g")).agg(F.collect_set(member).alias("all"), F.bool_or(F.col(member).isNull()).alias("void"))
    sets = sets.withColumn("n", F.size("all") + F.col("void").cast("int"))
    each = sets.select("g", F.explode("all").alias("m"))
    often = each.groupBy("m").agg(F.count(F.lit(1)).alias("f"))
    rarest = each.join(often, "m").groupBy("g").agg(F.min(F.struct("f", "m")).alias("r")).select("g", F.col("r.m").alias("m"))
    a = sets.where("NOT void").join(rarest, "g").select("g", "m", "all", "n")  # a null is in no other set
    b = sets.select(F.col("g").alias("h"), F.explode("all").alias("m"), F.col("all").alias("of"), F.col("n").alias("k"))
    part = a.join(b.hint("merge"), (a["m"] == b["m"]) & (F.col("g") != F.col("h")) & ((F.col("k") > F.col("n")) | ((F.col("k") == F.col("n")) & (F.col("h") < F.col("g")))) & (F.size(F.array_except("all", "of")) == 0), "left_semi")
    return sets.join(part.select("g"), "g", "left_anti").select(F.col("g").alias(group), F.col("n").cast("long").alias("n"))
