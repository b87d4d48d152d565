"""Counting of reads: filter, fold equal reads, find anchors, look up barcodes, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from . import fuzzy
from .alignment import Associate, Element, extracted
from .filters import read_filter
from .graphs import settled


def packed(reads: DataFrame, seq: str, least: int, most_unknown: int = 10) -> tuple[DataFrame, DataFrame]:
    """(seq, freq) of the reads that pass, each once, and (reason, n) for all. Equal reads meet before anything costly is done."""
    marked = reads.withColumn("reason", read_filter(F.col(seq), least, most_unknown))
    folded = marked.groupBy(F.col(seq).alias("seq"), "reason").agg(F.count(F.lit(1)).alias("freq"))
    return folded.where("reason = 'ok'").select("seq", "freq"), folded.groupBy("reason").agg(F.sum("freq").alias("n"))


def merged_mates(r1: Column, r2: Column, least: int, most: int) -> Column:
    """Two mates as one read, if the end of the first equals the start of the second's reverse complement over least to most letters,
    the longest overlap first; otherwise both, parted by a gap mark."""
    other = S.reverse_complement(r2)
    out = F.concat_ws("-----", r1, r2)
    for n in range(least, most + 1):
        out = F.when((F.length(r1) >= n) & (F.length(other) >= n) & (F.right(r1, F.lit(n)) == F.left(other, F.lit(n))), F.concat(r1, F.substring(other, F.lit(n + 1), F.length(other)))).otherwise(out)
    return out


def oriented(s: Column, anchor: str) -> Column:
    """The strand that holds the anchor; null if none or both do."""
    forward, backward = s.contains(anchor), S.reverse_complement(s).contains(anchor)
    return F.when(forward & ~backward, s).when(backward & ~forward, S.reverse_complement(s))


def between(s: Column, prefix: str, suffix: str, gap: int = 0) -> Column:
    """What stands after the last prefix and before the first suffix that follows; null if either is missing."""
    after = F.substring_index(s, prefix, -1)
    inner = F.substring_index(after, suffix, 1)
    whole = s.contains(prefix) & after.contains(suffix)
    return F.when(whole, F.substring(inner, F.lit(gap + 1), F.length(inner)))


def counted(packs: DataFrame, barcodes: DataFrame, anchor: str, prefix: str, suffix: str) -> tuple[DataFrame, DataFrame]:
    """(id, n) by barcode, '-' for reads whose barcode isn't known, and (outcome, n). packs has (seq, freq), barcodes (id, barcode)."""
    read = packs.withColumn("read", oriented(F.col("seq"), anchor)).withColumn("barcode", between(F.col("read"), prefix, suffix))
    known = read.join(barcodes, "barcode", "left")
    outcome = F.when(F.col("read").isNull(), "no anchor").when(F.col("barcode").isNull(), "no barcode").when(F.col("id").isNull(), "not mapped").otherwise("counted")
    marked = known.withColumn("outcome", outcome)
    counts = marked.where("barcode IS NOT NULL").groupBy(F.coalesce(F.col("id").cast("string"), F.lit("-")).alias("id")).agg(F.sum("freq").alias("n"))
    return counts, marked.groupBy("outcome").agg(F.sum("freq").alias("n"))


def counted_tuples(packs: DataFrame, elements: dict[str, Element], known: dict[str, DataFrame], associates: dict[str, Associate] | None = None) -> tuple[DataFrame, DataFrame]:
    """(name ..., n): how many reads hold each combination of ids, one column an element, '-' where a read has no known barcode of it; and
    (outcome, n) for all reads. packs has (seq, freq), known[name] (id, barcode) and, for those with an associate, associate.

    Reads are looked at once, for all elements together. Barcodes are looked up each once: equal ones by a join, the others within
    the element's errors, where two that are as near give none. A read whose barcode is known but that doesn't hold the associate of its id isn't
    counted. Repeated ids of one barcode count as one (the least); null reads have no anchor."""
    associates = associates or {}
    # Reads are small but cost much: left to their size, they would go to a few tasks.
    tasks = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = settled(extracted(packs.select("seq", "freq").repartition(tasks), "seq", elements, associates))
    for name, e in elements.items():
        codes = found.select(F.col(name).alias("code")).where("code IS NOT NULL").distinct()
        once = known[name].groupBy("barcode").agg(F.min_by(F.struct("*"), "id").alias("k")).select("k.*")
        ids = fuzzy.lookup(codes, once, e.errors).select(F.col("code").alias(name), F.col("id").alias(f"{name}_id"))
        if name in associates:
            ids = ids.join(once.select(F.col("id").alias(f"{name}_id"), F.col("associate").alias(f"{name}_associate")), f"{name}_id")
        found = found.join(ids, name, "left")
    none = lambda suffix: F.coalesce(*[F.col(f"{n}{suffix}") for n in elements]).isNull()
    wrong = F.lit(False)
    for name, a in associates.items():
        found = fuzzy.associate_matches(found, f"{name}_region", f"{name}_associate", a.errors).withColumnRenamed("matched", f"{name}_matched")
        wrong = wrong | (F.col(f"{name}_id").isNotNull() & ~F.coalesce(f"{name}_matched", F.lit(False)))
    some_id = F.coalesce(*[F.col(f"{n}_id").cast("string") for n in elements])
    outcome = F.when(none("_read"), "no anchor").when(none(""), "no barcode").when(some_id.isNull(), "not mapped").when(wrong, "associate").otherwise("counted")
    marked = settled(found.select("freq", outcome.alias("outcome"), *[F.coalesce(F.col(f"{n}_id").cast("string"), F.lit("-")).alias(n) for n in elements]))
    return marked.where("outcome = 'counted'").groupBy(*elements).agg(F.sum("freq").alias("n")), marked.groupBy("outcome").agg(F.sum("freq").alias("n"))


def filtered_by(df: DataFrame, callback, columns: list[str], preflight: int = 1000) -> DataFrame:
    """Rows for which a callback of pandas Series gives True. It is tried on a few rows first and must give booleans."""
    import pandas as pd
    from pyspark.sql.types import BooleanType

    trial = df.select(*columns).limit(preflight).toPandas()
    got = pd.Series(callback(*[trial[c] for c in columns]))
    if len(got) != len(trial) or (len(got) and got.dtype != bool):
        raise TypeError("the callback must give one boolean a row")
    return df.where(F.pandas_udf(lambda *s: pd.Series(callback(*s), dtype="bool"), BooleanType(), F.PandasUDFType.SCALAR)(*columns))
