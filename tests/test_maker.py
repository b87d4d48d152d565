"""Repeats of any length and made parts, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict
from random import Random

import pytest
from pyspark.sql import functions as F

from seqspark.functions import sequences as S
from seqspark.operators import kmers, maker

TABLE = str.maketrans("ACGT", "TGCA")


def other(s):
    return s.translate(TABLE)[::-1]


def plain_repeats(rows, k, both):
    held = defaultdict(list)
    for key, s in rows:
        for strand, t in ((0, s), (1, other(s))) if both and s else ((0, s),):
            for i in range(len(t or "")):
                for n in range(k, len(t) - i + 1):
                    place = i if strand == 0 else len(t) - i - n
                    held[t[i : i + n]].append((key, place, t[i - 1] if i else None, t[i + n] if i + n < len(t) else None))
    out = set()
    for w, at in held.items():
        b, a = {x[2] for x in at}, {x[3] for x in at}
        n = len({x[:2] for x in at})
        if n > 1 and (len(b) > 1 or None in b) and (len(a) > 1 or None in a) and (not both or w <= other(w)):
            out.add((w, len(w), len({x[0] for x in at}), n))
    return out


def strings(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    rows = [base, base, base[10:50] + "T", other(base[5:45]), "A" * 10, "ACGT" * 3, "AC", "", None, "GATTACA" + base[20:33] + "GATTACA" + base[18:40], "ACGTACGTAC"]
    return list(enumerate(rows))


@pytest.mark.parametrize("both, ahead", [(True, 20)])
def test_repeats_equal_all_substrings(spark, both, ahead):
    rows = strings(1)
    df = spark.createDataFrame(rows, "id int, s string").withColumn("of", F.lit(1)).withColumn("length", F.lit(2)).withColumn("at", F.lit(3)).repartition(3)
    got = [tuple(r) for r in kmers.repeats(df, "id", F.col("s"), 8, both, ahead).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_repeats(rows, 8, both)


def test_repeats_without_any(spark):
    df = spark.createDataFrame([(1, "ACGTT"), (2, None)], "id int, s string")
    assert kmers.repeats(df, "id", F.col("s"), 4, both=False).collect() == [] == kmers.repeats(df.limit(0), "id", F.col("s"), 4).collect()
    one = spark.createDataFrame([(1, "ACGT")], "id int, s string")  # its other strand is itself: one place
    assert kmers.repeats(one, "id", F.col("s"), 4).collect() == []
    rows = strings(2)[2:]
    assert {tuple(r) for r in kmers.repeats(spark.createDataFrame(rows, "id int, s string"), "id", F.col("s"), 12, both=False).collect()} == plain_repeats(rows, 12, False)
    rng = random.Random(3)
    long = "".join(rng.choice("ACGT") for _ in range(700))
    got = kmers.repeats(spark.createDataFrame([(1, long), (2, long)], "id int, s string"), "id", F.col("s"), 300, both=False).collect()
    assert [(r["length"], r["n"]) for r in got] == [(700, 2)]


def canonical(s, k):
    return [min(x, other(x)) for x in (s[i : i + k] for i in range(len(s) - k + 1))]


def test_proposals_are_what_a_full_search_allows():
    """Every part of a small space is found, and no others."""
    constraint, k = "NWSN", 2
    every = {a + b + c + d for a in "ACGT" for b in "AT" for c in "CG" for d in "ACGT"}
    want = {s for s in every if len(set(canonical(s, k))) == 3 and "AA" not in s}
    got = {maker.proposed(constraint, k, Random(i), {}, lambda s: not s.endswith("AA")) for i in range(3000)}
    assert got - {None} == want
    pairs = maker.pairs_of("((....))")
    for i in range(50):
        s = maker.proposed("N" * 8, 5, Random(i), pairs, None)
        assert s and s[0] == other(s[7]) and s[1] == other(s[6])
    assert maker.proposed("AAAA", 2, Random(0), {}, None) is None  # AA would be there twice
    assert maker.proposed("NNNNNN", 3, Random(0), {}, lambda s: (False, 0)) is None
    seen = []
    maker.proposed("N" * 6, 6, Random(1), {}, lambda s: seen.append(len(s)) or ((False, 2) if len(s) == 5 and len(seen) < 9 else True))
    assert seen[5:7] == [3, 4]  # gone back to the place that was named


def test_made_parts_share_nothing(spark):
    rng = random.Random(2)
    known = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(30)]
    background = spark.createDataFrame([(x,) for s in known for x in set(canonical(s, 6))], "kmer string").distinct()
    make = lambda n: maker.made_parts(spark, "NNNNNNNNSWNN", 40, 6, background.repartition(n), accept=lambda s: s[0] != "T", seed=5)
    rows = [tuple(r) for r in make(2).orderBy("id").collect()]
    assert [i for i, _ in rows] == list(range(40)) and rows == [tuple(r) for r in make(5).orderBy("id").collect()]
    held = [x for _, s in rows for x in canonical(s, 6)]
    assert len(held) == len(set(held)) and not set(held) & {x for s in known for x in canonical(s, 6)}
    assert all(s[0] != "T" and s[8] in "CG" and s[9] in "AT" for _, s in rows)
    told = maker.verified(spark.createDataFrame(rows, "id long, part string"), "id", "part", "NNNNNNNNSWNN", 6, background).collect()
    assert {tuple(r)[1:] for r in told} == {(12, True, 0, 0)}


def test_made_parts_run_out(spark):
    """There are 16 canonical 3-mers without palindromes of odd length: 32; parts of four letters take two each."""
    rows = [r["part"] for r in maker.made_parts(spark, "NNNN", 20, 3).collect()]
    held = [x for s in rows for x in canonical(s, 3)]
    assert 5 <= len(rows) <= 16 and len(held) == len(set(held))
    assert maker.made_parts(spark, "ACGT", 1, 4).count() == 1 and maker.made_parts(spark, "NNNN", 2, 3, accept=lambda s: False).count() == 0
    assert maker.made_parts(spark, "NNNN", 0, 3).count() == 0


@pytest.mark.parametrize(
    "constraint, structure, count, k",
    [("ACGJ", None, 1, 2), ("NNNN", None, 1, 5), ("NNNN", "(..", 1, 2), ("NNNN", "((.)", 1, 2), ("NNNN", ".)..", 1, 2), ("ANNA", "(..)", 1, 2), ("AAAANNNN", None, 2, 4), ("NNNN", None, 30, 2), ("NNNN", "(()", 1, 2)],
)
def test_constraints_are_checked(constraint, structure, count, k):
    with pytest.raises(ValueError):
        maker.checked_constraint(constraint, structure, count, k)


def test_verified_counts_what_is_wrong(spark):
    rows = [(1, "ACGTTGCA"), (2, "ACGTCCCC"), (3, None), (4, "GGNA"), (5, "AAAAAA"), (6, "")]
    df = spark.createDataFrame(rows, "id int, part string")
    known = spark.createDataFrame([("CGTC",)], "kmer string").select(F.lit("CGTC").alias("kmer"))
    got = {r["id"]: tuple(r)[1:] for r in maker.verified(df, "id", "part", "NNNNNNNN", 4, known).collect()}
    assert got[1] == (8, True, 1, 0) and got[2] == (8, True, 1, 1) and got[3] == (None, False, 0, 0) and got[4] == (4, False, 0, 0) and got[5] == (6, False, 1, 0) and got[6] == (0, False, 0, 0)


@pytest.mark.parametrize("both, held, ahead", [(True, 3, 5), (False, 65_536, 4)])
def test_repeats_of_large_and_small_classes(spark, both, held, ahead, monkeypatch):
    monkeypatch.setattr(kmers, "_TOGETHER", 7)
    rows = [r for r in strings(4) if r[0] not in (1, 9)]
    got = [tuple(r) for r in kmers.repeats(spark.createDataFrame(rows, "id int, s string"), "id", F.col("s"), 8, both, ahead, held).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_repeats(rows, 8, both)


def test_repeats_of_short_rows_are_shuffled_once_and_not_written(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(30))) for i in range(200)] + [(200, "ÄÖ" * 6), (201, "ÄÖ" * 4 + "A\0"), (202, "A^" * 5)]
    out = kmers.repeats(spark.createDataFrame(rows, "id int, s string"), "id", F.col("s"), 4, both=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("Exchange hash") == 1 and "Join" not in plan
    assert set(map(tuple, out.collect())) == plain_repeats(rows, 4, False)


def shuffled_records(df):
    """Records that each shuffle of a table wrote, once it is collected."""
    nodes, out = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        elif name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        if name == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
    return out


@pytest.mark.parametrize("both, k", [(True, 10), (False, 9)])
def test_neighbouring_places_of_repeats_are_shuffled_together(spark, both, k):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(32))) for i in range(300)]
    out = kmers.repeats(spark.createDataFrame(rows, "id int, s string"), "id", F.col("s"), k, both)
    assert set(map(tuple, out.collect())) == plain_repeats(rows, k, both)
    places = len(rows) * (33 - k) * (1 + both)
    assert [0 < n < places / (5 if both else 2) for n in shuffled_records(out)] == [True]


@pytest.mark.parametrize("both, k, held, crowd, meet", [(True, 10, 12, 2, [True, False]), (True, 5, 65_536, 16, [False, False]), (False, 3, 12, 1, [True, True])])
def test_repeats_where_many_places_meet(spark, both, k, held, crowd, meet, monkeypatch):
    """Parts that are dealt one by one, with and without large classes; letters whose other strand has the same one, or that have none; stretches of long rows."""
    seen, crowds = [], kmers._crowds
    monkeypatch.setattr(kmers, "_crowds", lambda *a: seen.append(crowds(*a)) or seen[-1])
    monkeypatch.setattr(kmers, "_CROWD", crowd)
    monkeypatch.setitem(globals(), "TABLE", str.maketrans(*S.COMPLEMENT))
    rng = random.Random(7)
    some = lambda i, n: "".join(rng.choice("ACGTU" if i % 3 else "ACGTN") for _ in range(n))
    rows = [(i, some(i, 8) + "GATTACA" + some(i, 8)) for i in range(90)] if any(meet) else [(i, some(i, 200)) for i in range(4)]
    rows += [(100, "ÄÖacgu" * 3), (101, "ugÄÖac" * 3), (102, "A" * k), (103, None), (104, "\0\0AAAAAAA")]
    got = [tuple(r) for r in kmers.repeats(spark.createDataFrame(rows, "id int, s string"), "id", F.col("s"), k, both, 40, held).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_repeats(rows, k, both)
    assert [x is not None for x in seen[0]] == meet
