"""Expressions against plain Python, with the published golden values."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqspark.functions import sequences as S
from seqspark.functions import special
from seqspark.operators import fuzzy, rules


def rows(spark, values, kind="s string"):
    return spark.createDataFrame([(v,) for v in values], kind)


def test_reverse_complement_is_its_own_inverse(spark):
    s = ["ACGTTGCA", "AAAA", "", "NRYK"]
    got = [r[0] for r in rows(spark, s).select(S.reverse_complement(S.reverse_complement(F.col("s")))).collect()]
    assert got == s
    a = rows(spark, ["ACCGT"]).select(S.canonical(F.col("s")), S.canonical(S.reverse_complement(F.col("s")))).first()
    assert a[0] == a[1]


def test_kmers_of_short_and_null_strings(spark):
    got = [r[0] for r in rows(spark, ["ACGT", "AC", "", None]).select(S.kmers(F.col("s"), 3)).collect()]
    assert got == [["ACG", "CGT"], [], [], []]
    assert rows(spark, ["AC"]).select(S.spectrum(F.col("s"), 3)).first()[0] == ["AC"]


def test_places_overlap(spark):
    assert rows(spark, ["AAAA"]).select(S.places(F.col("s"), F.lit("AA"))).first()[0] == [0, 1, 2]


@pytest.mark.parametrize("s, passes", [("A" * 18 + "GG", False), ("A" * 15 + "G" * 5, False), ("A" * 16 + "G" * 4, True)])
def test_composition_golden(spark, s, passes):
    assert rows(spark, [s]).select(rules.composition_passes(F.col("s"), 20, 0.10, 0.25)).first()[0] == passes


def test_spacing_penalty_golden(spark):
    got = rows(spark, [5, 3, 7], "s int").select(S.spacing_penalty(F.col("s"))).collect()
    assert [round(r[0], 3) for r in got] == [0.0, 1.525, 0.672]


def test_tolerance_golden(spark):
    got = rows(spark, [8, 15, 16, 20, 21], "s int").select(S.tolerated_mismatches(F.col("s"))).collect()
    assert [r[0] for r in got] == [0, 1, 2, 2, 3]


def test_success_rate_golden():
    assert special.success_rate(1, 100) == 2 / 102


def test_tails_of_known_distributions():
    assert special.f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert special.t_tail(2.2281, 10) == pytest.approx(0.05, abs=1e-5)
    assert special.t_tail(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)


def test_balance_names_places(spark):
    b = rows(spark, ["(()z)("]).select(S.balance(F.col("s")).alias("b")).first()["b"]
    assert (b["unclosed"], b["unopened"], b["invalid"]) == ([6], [], [4])
    assert rows(spark, [")("]).select(S.balance(F.col("s")).alias("b")).first()["b"]["unopened"] == [1]


def test_hairpins_with_mismatches(spark):
    h = rows(spark, ["ACGTATTTTTACGT"]).select(F.size(rules.hairpins(F.col("s"), 4, (6, 6))), F.size(rules.hairpins(F.col("s"), 4, (6, 6), 1))).first()
    assert (h[0], h[1]) == (1, 1)


@given(st.text("ACGT", max_size=8), st.text("ACGT", max_size=12))
@settings(max_examples=60, deadline=None)
def test_infix_distance(pattern, text):
    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    best = min(edit(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert fuzzy.infix_distance(pattern, text, 99) == best
