"""Generators of sequences under constraints: barcodes, spacers, fragments, motifs; validated tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from random import Random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from . import fuzzy, graphs
from .filters import motif_conflicts


def walk(spark: SparkSession, length: int, seed: int = 0) -> DataFrame:
    """(step, n): all numbers under 4 ** length in an order by seed; each step of the first quarter brings four that mirror each other."""
    total = 4**length
    quarter = spark.range(total // 4)
    four = F.array(F.col("id"), total - 1 - F.col("id"), total // 2 + F.col("id"), total // 2 - 1 - F.col("id"))
    return quarter.select(F.xxhash64("id", F.lit(seed)).alias("step"), F.explode(four).alias("n"))


def multimers(spark: SparkSession, length: int) -> DataFrame:
    return spark.range(4**length).select(F.col("id").alias("n"), S.from_number(F.col("id"), length).alias("s"))


def barcodes(spark: SparkSession, length: int, distance: int, motifs: list[str] = (), seed: int = 0) -> DataFrame:
    """(s): barcodes of a length, each two at least distance apart, free of motifs, none could be added from the same space.

    All candidates that pass the filters are vertices, those closer than distance are edges, and a maximal independent set is the
    design: it doesn't depend on partitions."""
    free = multimers(spark, length).where(F.size(motif_conflicts(F.col("s"), list(motifs))) == 0) if motifs else multimers(spark, length)
    free = graphs.settled(free)
    near = fuzzy.hamming_pairs(free, "n", "s", length, distance - 1).select("a", "b") if distance > 1 else spark.createDataFrame([], "a long, b long")
    chosen = graphs.independent_set(free.select(F.col("n").alias("v")), near, seed)
    return free.join(chosen.withColumnRenamed("v", "n"), "n", "left_semi").select("s")


def fill(constraint: str, context: str, motifs: list[str], seed: int) -> str | None:
    """A sequence of the constraint, before a context, without any motif; depth-first with backtracking, letters by seed."""
    draw = Random(seed).random
    choices = [sorted(S.IUPAC[c], key=lambda _: draw()) for c in constraint]
    ends = tuple(motifs)
    context = context[max(0, len(context) - max(map(len, ends), default=0)) :]  # no motif reaches further back
    out: list[str] = []
    now = context
    at = [0] * (len(choices) + 1)
    while len(out) < len(choices):
        i = len(out)
        if at[i] == len(choices[i]):
            at[i] = 0
            if not i:
                return None
            out.pop()
            now = now[:-1]
            continue
        letter = choices[i][at[i]]
        at[i] += 1
        if not (now + letter).endswith(ends):
            out.append(letter)
            now += letter
    return "".join(out)


def spacers(df: DataFrame, key: str, length: Column, context: str, motifs: list[str], seed: int = 0) -> DataFrame:
    """(key, spacer): for each row a stretch of the needed length that makes no motif with what stands before it; null if none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["spacer"] = [fill("N" * max(0, int(n)), c, motifs, seed + int(k)) for k, n, c in zip(rows["k"], rows["need"], rows["before"], strict=True)]
            yield rows[["k", "spacer"]]

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), length.cast("long").alias("need"), F.col(context).alias("before")).mapInPandas(run, f"k {kind}, spacer string").withColumnRenamed("k", key)


def fragments(s: Column, size: int, overlap: int) -> Column:
    """(i, piece): pieces of a size, each but the first starting overlap letters before the end of the one before."""
    step = size - overlap
    n = F.ceil(F.greatest(F.length(s) - overlap, F.lit(1)) / step)
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.struct(i.alias("i"), F.substring(s, i * step + 1, F.lit(size)).alias("piece")))


def padded(piece: Column, left: str, right: str, size: int, fillers: str = "A") -> Column:
    """Primers to both sides of a piece, and letters outside of them up to a size, half on each side."""
    core = F.concat(F.lit(left), piece, F.lit(right))
    gap = F.greatest(F.lit(size) - F.length(core), F.lit(0))
    first = F.floor(gap / 2).cast("int")
    return F.concat(F.repeat(F.lit(fillers), first), core, F.repeat(F.lit(fillers), (gap - first).cast("int")))


def checked_table(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df, if its key is unique and without nulls and all columns are DNA; otherwise ValueError says what is wrong."""
    bad = [F.count(F.when(F.col(c).isNull() | ~S.is_dna(F.col(c)), 1)).alias(c) for c in columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("keys"), *bad).first()
    if not row["n"]:
        raise ValueError("the table is empty")
    if row["keys"] != row["n"]:
        raise ValueError(f"{key} isn't unique")
    if wrong := [c for c in columns if row[c]]:
        raise ValueError(f"not DNA: {wrong}")
    return df


def make_parts(constraint: str, count: int, homology: int, accept: Callable[[str], bool] = lambda s: True, seed: int = 0, most: int = 10_000) -> list[str]:
    """Parts of one constraint that share no homology-mer with each other, on either strand. Sequential by nature: each part excludes
    pieces from all later ones, so it runs on the driver for one constraint; most bounds the tries."""
    table = str.maketrans(*S.COMPLEMENT)
    used: set[str] = set()
    out: list[str] = []
    for k in range(most):
        if len(out) == count:
            break
        order = Random(f"{seed}:{k}")
        part = "".join(order.choice(S.IUPAC[c]) for c in constraint)
        own = [min(x, x.translate(table)[::-1]) for x in (part[i : i + homology] for i in range(len(part) - homology + 1))]
        if len(set(own)) == len(own) and not used & set(own) and accept(part):
            used |= set(own)
            out.append(part)
    return out


def split_statistics(df: DataFrame, seq: Column, size: int, overlap: int) -> DataFrame:
    """(i, least, n, melting, kinds): of each fragment over all rows its least length, how many rows have it, and the mean melting
    temperature and number of different overlaps with the next fragment."""
    step = size - overlap
    each = df.select(F.length(seq).alias("_n"), seq.alias("_s"), F.inline(fragments(seq, size, overlap)))
    shared = F.when(F.col("_n") >= (F.col("i") + 1) * step + overlap, F.substring("_s", (F.col("i") + 1) * step + 1, F.lit(overlap)))
    each = each.select("i", F.length("piece").alias("n"), shared.alias("o"))
    return each.groupBy("i").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("n"), F.avg(S.melting_temperature(F.col("o"))).alias("melting"), F.countDistinct("o").alias("kinds"))


def sites_within(df: DataFrame, seq: Column, enzymes: list[tuple[str, str]]) -> DataFrame:
    """df with a row for each enzyme (name, site) whose site the sequence holds: enzyme, forward and reverse places of the site."""
    table = F.array(*[F.struct(F.lit(n).alias("enzyme"), F.lit(s).alias("site")) for n, s in enzymes])
    each = df.withColumn("_e", F.explode(table)).withColumn("enzyme", F.col("_e.enzyme"))
    each = each.where(seq.contains(F.col("_e.site")) | seq.contains(S.reverse_complement(F.col("_e.site"))))  # most hold none, which is soon seen
    out = each.withColumn("forward", S.places(seq, F.col("_e.site"))).withColumn("reverse", S.places(seq, S.reverse_complement(F.col("_e.site"))))
    return out.drop("_e").where("size(forward) + size(reverse) > 0")
