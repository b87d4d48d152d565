"""Searches with several objectives: fronts, selection, a seeded evolutionary loop, primers, and the order of design steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constraints as C
from ..functions import sequences as S
from . import design, kmers
from .filters import edge_motifs, insert_column, motif_conflicts, row_concat


def dominates(a: tuple, b: tuple) -> bool:
    """a is nowhere worse and somewhere better; all objectives are to be small."""
    return all(x <= y for x, y in zip(a, b, strict=True)) and any(x < y for x, y in zip(a, b, strict=True))


def fronts(scores: list[tuple]) -> list[list[int]]:
    """Places of scores in fronts: none of a front is dominated by those that are left."""
    left, out = set(range(len(scores))), []
    while left:
        front = sorted(i for i in left if not any(dominates(scores[j], scores[i]) for j in left))
        out.append(front)
        left -= set(front)
    return out


def crowding(scores: list[tuple], front: list[int]) -> dict[int, float]:
    """How far the neighbours of each member of a front lie, summed over objectives; ends are infinite."""
    gap = dict.fromkeys(front, 0.0)
    for k in range(len(scores[0]) if scores else 0):
        order = sorted(front, key=lambda i: (scores[i][k], i))
        span = scores[order[-1]][k] - scores[order[0]][k] or 1.0
        gap[order[0]] = gap[order[-1]] = float("inf")
        for a, i, b in zip(order, order[1:], order[2:], strict=False):
            gap[i] += (scores[b][k] - scores[a][k]) / span
    return gap


def select(scores: list[tuple], n: int) -> list[int]:
    """The n to keep: whole fronts first, then those of the next front that stand most alone."""
    out: list[int] = []
    for front in fronts(scores):
        gap = crowding(scores, front)
        out += sorted(front, key=lambda i: (-gap[i], i))[: n - len(out)]
        if len(out) == n:
            break
    return out


def evolve(spark: SparkSession, score: Callable[[list[int]], tuple], length: int, letters: int, size: int = 20, rounds: int = 5, crossover: float = 0.65, mutation: float = 0.25, seed: int = 0) -> list[tuple[list[int], tuple]]:
    """The first front after some rounds of two-point crossover, mutation and selection. The population is small and stays on the
    driver; its scores, which cost most, are worked out by tasks."""
    rng = Random(seed)
    people = [[rng.randrange(letters) for _ in range(length)] for _ in range(size)]

    def scored(group: list[list[int]]) -> list[tuple]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"i": b["i"], "score": [[float(x) for x in score(list(g))] for g in b["genes"]]})

        df = spark.createDataFrame(list(enumerate(group)), "i long, genes array<int>")
        return [tuple(r["score"]) for r in df.mapInPandas(run, "i long, score array<double>").orderBy("i").collect()]

    values = scored(people)
    for _ in range(rounds):
        young = []
        for _ in range(size):
            a, b = list(rng.choice(people)), rng.choice(people)
            if rng.random() < crossover:
                i, j = sorted((rng.randrange(length + 1), rng.randrange(length + 1)))
                a[i:j] = b[i:j]
            if rng.random() < mutation:
                a[rng.randrange(length)] = rng.randrange(letters)
            young.append(a)
        people, values = people + young, values + scored(young)
        keep = select(values, size)
        people, values = [people[i] for i in keep], [values[i] for i in keep]
    best = fronts(values)[0]
    return sorted((people[i], values[i]) for i in best)


def primers(spark: SparkSession, constraint: str, melting: tuple[float, float], motifs: list[str] = (), background: DataFrame | None = None, paired: str | None = None, k: int = 6, tries: int = 2000, seed: int = 0) -> DataFrame:
    """(s, tm): sequences of a constraint within melting bounds, without motifs, inner repeats, palindromes or k-mers of the background,
    and with at most five letters in common with a paired primer. Candidates are drawn by seed and pass built-in filters, cheap ones first."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "s": ["".join(Random(f"{seed}:{i}").choice(S.IUPAC[c]) if len(S.IUPAC[c]) == 1 else S.IUPAC[c][Random(f"{seed}:{i}:{p}").randrange(len(S.IUPAC[c]))] for p, c in enumerate(constraint)) for i in b["id"]]})

    s = F.col("s")
    rows = spark.range(tries).mapInPandas(draw, "id long, s string").dropDuplicates(["s"])
    if motifs:
        rows = rows.where(F.size(motif_conflicts(s, list(motifs))) == 0)
    own = F.transform(S.kmers(s, k), S.canonical)
    rows = rows.where(F.size(F.array_distinct(own)) == F.size(own)).where(~F.exists(S.kmers(s, k), lambda x: x == S.reverse_complement(x)))
    if paired:
        rows = rows.where(C.longest_common(s, F.lit(paired), 6) <= 5)
    rows = rows.withColumn("tm", S.melting_temperature(s)).where(F.col("tm").between(*melting))
    if background is not None:
        rows = kmers.clear_of(rows, "id", kmers.exploded(rows, "id", s, k, "canonical"), background)
    return rows.orderBy("id").select("s", "tm")


STEPS = ("background", "variants", "motifs", "primers", "barcodes", "spacers", "final", "split", "pad")


def design_table(variants: DataFrame, key: str, spec: dict) -> tuple[DataFrame | None, dict]:
    """Runs the steps that spec names in their fixed order over a table of variants (key, Variant); each step adds or changes columns.
    Returns the table and a status; a step that isn't feasible ends the run there with no table."""
    spark = variants.sparkSession
    columns = ["Variant"]
    df, status = variants, {"steps": [], "status": "Design Complete"}
    known = None
    for step in STEPS:
        if step not in spec and step != "final":
            continue
        opt = spec.get(step, {})
        if step == "background":
            known = kmers.background(kmers.exploded(opt["table"], opt["key"], F.col(opt["seq"]), opt["k"], "canonical"))
        elif step == "variants":
            df = design.checked_table(df, key, columns)
        elif step == "motifs":
            df, columns = df.withColumn("Motif", F.lit(opt["motif"])), insert_column(columns, "Motif", left="Variant")
            if opt.get("excluded") and df.where(F.size(edge_motifs(F.col("Variant"), F.col("Motif"), opt["excluded"])) > 0).limit(1).count():
                return None, status | {"status": "Design Infeasible", "at": step}
        elif step == "primers":
            found = primers(spark, opt["constraint"], opt["melting"], opt.get("excluded", []), known, k=opt.get("k", 6), seed=opt.get("seed", 0)).limit(1).collect()
            if not found:
                return None, status | {"status": "Design Infeasible", "at": step}
            df, columns = df.withColumn("Primer", F.lit(found[0]["s"])), ["Primer", *columns]
        elif step == "barcodes":
            codes = design.barcodes(spark, opt["length"], opt["distance"], opt.get("excluded", []), opt.get("seed", 0))
            n, have = df.count(), codes.count()
            if have < n:
                return None, status | {"status": "Design Infeasible", "at": step}
            ranked = [r["s"] for r in codes.orderBy("s").limit(n).collect()]  # one for each variant: as many as the design table has rows
            ids = [r[0] for r in df.select(key).orderBy(key).collect()]
            df, columns = df.join(spark.createDataFrame(list(zip(ids, ranked, strict=True)), f"{key} {dict(df.dtypes)[key]}, Barcode string"), key), [*columns, "Barcode"]
        elif step == "spacers":
            need = F.greatest(F.lit(opt["limit"]) - F.length(row_concat(columns)), F.lit(0))
            made = design.spacers(df.withColumn("_before", row_concat(columns)), key, need, "_before", opt.get("excluded", []), opt.get("seed", 0))
            df, columns = df.join(made.withColumnRenamed("spacer", "Spacer"), key), [*columns, "Spacer"]
        elif step == "final":
            df = df.withColumn("Oligo", row_concat(columns)).withColumn("OligoLength", F.length("Oligo").cast("long"))
        elif step == "split":
            df = df.withColumn("Fragments", design.fragments(F.col("Oligo"), opt["size"], opt["overlap"]))
        elif step == "pad":
            df = df.withColumn("Padded", F.transform("Fragments", lambda x: design.padded(x["piece"], opt["left"], opt["right"], opt["size"])))
        status["steps"].append(step)
    return df, status
