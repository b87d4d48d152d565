"""Parts of one constraint that share no k-mer with each other or a background, made in rounds of proposals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from . import kmers
from .graphs import settled

#: Letters that a proposal may take back before it gives up, for each of its own.
BACK = 50
#: Rounds in a row without a new part after which no more are looked for, and the most proposals of a round.
IDLE, MOST_PROPOSALS = 5, 1 << 22
_PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}
_TABLE = str.maketrans(*S.COMPLEMENT)

Local = Callable[[str], "bool | tuple[bool, int]"]


def pairs_of(structure: str) -> dict[int, int]:
    """The opening place of each closing one; raises ValueError for brackets without a partner and other signs."""
    open_, out = [], {}
    for i, c in enumerate(structure):
        if c == "(":
            open_.append(i)
        elif c == ")":
            if not open_:
                raise ValueError(f"place {i} closes nothing")
            out[i] = open_.pop()
        elif c not in ".x":
            raise ValueError(f"place {i} has {c!r}")
    if open_:
        raise ValueError(f"place {open_[-1]} isn't closed")
    return out


def checked_constraint(constraint: str, structure: str | None, count: int, k: int) -> None:
    """Raises ValueError if no set can be made: letters that aren't a nucleotide code, a structure that doesn't fit or whose pairs can't be,
    parts shorter than a k-mer, a window that allows fewer k-mers than parts are asked for, or more k-mers in all than there are."""
    if wrong := set(constraint) - set(S.IUPAC):
        raise ValueError(f"not a code: {sorted(wrong)}")
    if k < 1 or k > len(constraint):
        raise ValueError("a part is shorter than a k-mer")
    pairs = {}
    if structure is not None:
        if len(structure) != len(constraint):
            raise ValueError("constraint and structure have different lengths")
        pairs = pairs_of(structure)
        for j, i in pairs.items():
            if not {_PAIR[c] for c in S.IUPAC[constraint[i]]} & set(S.IUPAC[constraint[j]]):
                raise ValueError(f"places {i} and {j} can't pair")
    for at in range(len(constraint) - k + 1):
        free = 1
        for j in range(at, at + k):
            free *= 1 if pairs.get(j, -1) >= at else len(S.IUPAC[constraint[j]])
        if free < count:
            raise ValueError(f"the {k} letters from place {at} allow {free} parts only")
    if count * (len(constraint) - k + 1) > 4**k:
        raise ValueError(f"there are fewer k-mers than {count} parts have")


def proposed(constraint: str, k: int, order: Random, pairs: dict[int, int], local: Local | None) -> str | None:
    """One part by backtracking: each place tries its letters in random order, and a k-mer that the part has already, on either strand, a
    letter that doesn't pair or a prefix that local refuses is taken back. local may also name the place to go back to. None if too
    much was taken back."""
    n, part, held = len(constraint), [], set()
    own: list[str | None] = []  # the k-mer that ends at each place
    choices: list[list[str]] = []
    left = BACK * n

    def back(to: int) -> None:
        while len(part) > to:
            part.pop()
            choices.pop() if len(choices) > len(part) + 1 else None
            if (kmer := own.pop()) is not None:
                held.discard(kmer)

    while len(part) < n:
        at = len(part)
        if len(choices) == at:
            letters = [c for c in S.IUPAC[constraint[at]] if at not in pairs or c == _PAIR[part[pairs[at]]]]
            order.shuffle(letters)
            choices.append(letters)
        if not choices[at]:
            choices.pop()
            if at == 0 or left <= 0:
                return None
            left -= 1
            back(at - 1)
            continue
        part.append(choices[at].pop())
        text = "".join(part[-k:])
        kmer = min(text, text.translate(_TABLE)[::-1]) if len(text) == k else None
        fresh = kmer is None or kmer not in held
        own.append(kmer if fresh else None)
        if fresh and kmer is not None:
            held.add(kmer)
        verdict = (fresh, at) if not fresh or local is None else local("".join(part))
        good, to = verdict if isinstance(verdict, tuple) else (verdict, at)
        if not good:
            if (left := left - 1) <= 0:
                return None
            back(max(0, min(at, to)))
    return "".join(part)


def made_parts(spark: SparkSession, constraint: str, count: int, k: int, background: DataFrame | None = None, structure: str | None = None, local: Local | None = None, accept: Callable[[str], bool] | None = None, seed: int = 0) -> DataFrame:
    """(id, part): count parts with ids from 0, none of which holds a k-mer twice, shares one with another part or holds one of the
    background (kmer, canonical), both strands considered. The same for every partitioning.

    In each round tasks propose parts, each from its own seed; accept may refuse whole ones. Proposals with k-mers of the background or
    of parts made before are dropped by a join. Of those that share a k-mer the one with the least number goes on if
    it is the least at all of its k-mers; winners are a written table. Fewer parts come back if several rounds in a row make none."""
    checked_constraint(constraint, structure, count, k)
    pairs = pairs_of(structure) if structure else {}
    empty = spark.createDataFrame([], "id long, part string")
    known = [settled(background.select("kmer"))] if background is not None else []
    done: list[DataFrame] = []
    have, idle, turn, tries = 0, 0, 0, 2.0
    while have < count and idle < IDLE:
        n = min(MOST_PROPOSALS, int(tries * (count - have)) + 16)

        def run(batches: Iterator[pa.RecordBatch], turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, parts = batch.column("id").to_pylist(), []
                for i in ids:
                    part = proposed(constraint, k, Random(f"{seed}:{turn}:{i}"), pairs, local)
                    parts.append(part if part is not None and (accept is None or accept(part)) else None)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "part": pa.array(parts, pa.string())})

        asked = settled(spark.range(n).mapInArrow(run, "id long, part string").where("part IS NOT NULL"))
        pieces = settled(kmers.exploded(asked, "id", F.col("part"), k, "canonical"))
        free = pieces
        for store in known:
            free = free.join(pieces.join(store, "kmer", "left_semi").select("id").distinct(), "id", "left_anti")
        free = settled(free)
        beaten = free.join(free.groupBy("kmer").agg(F.min("id").alias("least")), "kmer").where("id > least").select("id").distinct()
        won = settled(asked.join(free.select("id").distinct(), "id", "left_semi").join(beaten, "id", "left_anti").orderBy("id").limit(count - have))
        new = won.count()
        if new:
            known.append(settled(pieces.join(won.select("id"), "id", "left_semi").select("kmer")))
            # Ids are numbers of winners: by rank within a table of count rows at most.
            done.append(won.select(F.struct(F.lit(turn).alias("turn"), "id").alias("at"), "part"))
        tries = min(64.0, max(2.0, 1.3 * n / max(1, new)))
        have, turn, idle = have + new, turn + 1, 0 if new else idle + 1
    if not done:
        return empty
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return settled(numbered(every, "at").select("id", "part"))


def numbered(df: DataFrame, by: str) -> DataFrame:
    """df with id: the rank of a row by a unique column, from 0. Rows are cut into ranges; each is numbered on its own and shifted by what
    the ranges before hold."""
    from pyspark.sql import Window

    ranges = settled(df.repartitionByRange(F.col(by)).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return ranges.withColumn("_own", own).join(before, "_range").withColumn("id", (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_range")


def verified(parts: DataFrame, key: str, part: str, constraint: str, k: int, background: DataFrame | None = None) -> DataFrame:
    """(key, length, legal, shared, known), worked out anew: whether each part fits the constraint, how many of its canonical k-mers occur
    again in it or in another part, and how many the background holds. Null parts have no length and aren't legal."""
    pattern = "^" + "".join(f"[{S.IUPAC[c]}]" for c in constraint) + "$"
    all_ = parts.select(F.col(key).alias(key), F.transform(S.kmers(F.col(part), k), S.canonical).alias("_k")).select(key, F.explode("_k").alias("kmer"))
    often = all_.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n"))
    marked = all_.distinct().join(often, "kmer")
    if background is not None:
        marked = marked.join(background.select("kmer", F.lit(True).alias("_known")), "kmer", "left")
    else:
        marked = marked.withColumn("_known", F.lit(None).cast("boolean"))
    sums = marked.groupBy(key).agg(F.count(F.when(F.col("_n") > 1, 1)).alias("shared"), F.count("_known").alias("known"))
    rows = parts.select(key, F.length(part).alias("length"), F.coalesce(F.col(part).rlike(pattern), F.lit(False)).alias("legal")).join(sums, key, "left")
    return rows.select(key, "length", "legal", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("known", F.lit(0)).alias("known"))
