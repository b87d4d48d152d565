"""Folding hook, searches, primers and the design driver."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from seqspark.functions import constraints as C
from seqspark.functions import sequences as S
from seqspark.operators import design, folding, learning, search


def test_best_stem():
    energy, structure = folding.best_stem("GGGCAAAAGCCC")
    assert structure == "((((....))))" and energy == -12.0
    assert folding.best_stem("AAAA") == (0.0, "....")


def test_folded_windows_and_flags(spark):
    df = spark.createDataFrame([(1, "GGGCAAAAGCCCAA"), (2, "AAAAAAAAAAAAAA"), (3, None)], "id int, s string")
    folds = folding.folded(df, "id", "s", window=12)
    assert folds.where("id = 1").count() == 3
    got = {r["id"]: r["longest"] for r in folding.hairpin_flags(folds, "id", stems=(3,), energies=(-10.0,)).collect()}
    assert got == {1: 4, 2: 0}


def test_base_pairs_and_back(spark):
    for s in ("((..)).", "....", "(())()"):
        r = spark.createDataFrame([(s,)], "s string").withColumn("p", C.base_pairs(F.col("s"))).select("p", C.dot_bracket(F.col("p"), F.length("s")).alias("d")).first()
        assert r["d"] == s
    assert r["p"] == [(1, 4), (2, 3), (5, 6)]


def test_fronts_and_selection():
    scores = [(1, 5), (2, 2), (5, 1), (3, 3), (6, 6)]
    assert search.fronts(scores) == [[0, 1, 2], [3], [4]]
    assert search.select(scores, 4) == [0, 2, 1, 3]


def test_evolve_is_seeded_and_improves(spark):
    score = lambda g: (sum(g), -max(g))
    a = search.evolve(spark, score, 5, 4, size=6, rounds=3, seed=1)
    assert a == search.evolve(spark, score, 5, 4, size=6, rounds=3, seed=1)
    assert not any(search.dominates(x[1], y[1]) for x, y in itertools.permutations(a, 2))


def test_primers_and_driver(spark):
    got = search.primers(spark, "N" * 18, (30.0, 70.0), ["GAATTC"], tries=200).collect()
    assert got and all(30 <= r["tm"] <= 70 and "GAATTC" not in r["s"] for r in got)
    variants = spark.createDataFrame([(1, "ACGTACGTAA"), (2, "TTGGCCATAC")], "ID int, Variant string")
    spec = {"variants": {}, "motifs": {"motif": "GG", "excluded": ["GAATTC"]}, "primers": {"constraint": "N" * 18, "melting": (30.0, 70.0)}, "barcodes": {"length": 4, "distance": 3}, "spacers": {"limit": 40}, "split": {"size": 25, "overlap": 10}, "pad": {"left": "AC", "right": "GT", "size": 30}}
    df, status = search.design_table(variants, "ID", spec)
    rows = df.collect()
    assert status["status"] == "Design Complete" and status["steps"][-1] == "pad"
    assert all(r["OligoLength"] == 40 and len(r["Padded"][0]) == 30 for r in rows)
    assert search.design_table(variants, "ID", {"barcodes": {"length": 1, "distance": 1, "excluded": ["A", "C", "G"]}})[0] is None


def test_forest_search_and_importance(spark):
    rows = [(float(i % 10), float(i % 3), float(i % 10 > 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = learning.best_of(df, ["a", "b"], "y", {"numTrees": [3, 5], "maxDepth": [2]})
    importance = dict(learning.permutation_importance(learning.forest(df, ["a", "b"], "y", 5, 3), df, ["a", "b"], "y"))
    assert model.transform(df).where("prediction = y").count() == 200
    assert set(importance) == {"a", "b"}


def test_walk_meets_every_number_once(spark):
    assert sorted(r["n"] for r in design.walk(spark, 3).collect()) == list(range(64))
    assert spark.createDataFrame([(0,), (27,)], "n long").select(S.from_number(F.col("n"), 3)).collect()[1][0] == "GTC"


def test_no_row_is_scored_by_a_model_that_saw_it(spark):
    df = spark.createDataFrame([(i // 2 if i < 60 else None, float(i)) for i in range(70)], "k int, x double").repartition(3)
    seen = []

    def use(train, rest):
        a, b = ({r["k"] for r in d.collect()} for d in (train, rest))
        seen.append(a & b)
        return rest

    assert sorted(r["x"] for r in learning.out_of_fold(df, "k", use, 3).collect()) == [float(i) for i in range(70)] and seen == [set()] * 3
    assert learning.out_of_fold(df.limit(0), "k", lambda train, rest: rest).collect() == []


def test_fill_looks_back_only_as_far_as_motifs_reach():
    class Long(str):
        def __add__(self, other):
            raise AssertionError("the whole context is joined again for each letter")

    got = design.fill("NNRY", Long("A" * 50 + "GAATT"), ["GAATTC", "T"], 3)
    assert len(got) == 4 and "T" not in got and got[0] != "C" and got[2] in "AG" and got[3] == "C"
