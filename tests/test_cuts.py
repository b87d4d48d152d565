"""Cuts shared by all rows, against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqspark.functions import sequences as S
from seqspark.operators import cuts

TABLE = str.maketrans("ACGT", "TGCA")


def plain_melting(s):
    h, t = (sum(round(10 * table[s[i : i + 2]]) for i in range(len(s) - 1)) for table in (S.NEAREST_ENTHALPY, S.NEAREST_ENTROPY))
    return 100 * h / (t / 10 + 0.368 * math.log(0.05) * (len(s) - 1) + 1.987 * math.log(5e-8 / 4)) - 273.15


def apart(rows, r, q):
    return min(sum(x != y for x, y in zip(a[r:q], b[r:q], strict=True)) for i, a in enumerate(rows) for b in rows[:i])


def plain_overlaps(rows, regions, melting, distance, span, most):
    length, out = min(map(len, rows)), {}
    for start, end in regions:
        for q in range(start + span, min(end, length) + 1):
            for r in range(q - span, max(start, q - most) - 1, -1):
                if min(plain_melting(s[r:q]) for s in rows) >= melting and apart(rows, r, q) >= distance:
                    out[q] = r
                    break
    return out


def plain_cuts(found, length, limit):
    """All ways, the fewest fragments first, then the rightmost."""

    def ways(start, last):
        if start + limit >= length:
            yield []
            return
        for q, r in found.items():
            if last < q <= start + limit and r >= last and r > start:
                for rest in ways(r, q):
                    yield [(r, q), *rest]

    return min(ways(0, 0), key=lambda w: (len(w), [-q for _, q in w]), default=None)


def variants(seed, n, sizes=(20, 26, 10, 30, 14)):
    """Constant and variable stretches by turns."""
    rng = random.Random(seed)
    draw = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    fixed = [draw(k) for k in sizes]
    return ["".join(c if i % 2 == 0 else draw(len(c)) for i, c in enumerate(fixed)) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, s string").repartition(3)


def test_entropy_and_regions(spark):
    rows = ["AACA", "ACGA", "AGT", "ATA", None, ""]
    got = {r["at"]: (r["n"], r["entropy"]) for r in cuts.column_entropy(table(spark, rows), "s").collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 4, 1: 4, 2: 4, 3: 2}
    for at in range(4):
        held = Counter(s[at] for s in rows if s and len(s) > at)
        assert got[at][1] == pytest.approx(-sum(c / held.total() * math.log(c / held.total(), 4) for c in held.values()))
    vary = spark.createDataFrame([(i, float(c)) for i, c in enumerate("0110111001")], "at int, entropy double")
    found = lambda gap, span: sorted(tuple(r) for r in cuts.variable_regions(vary, gap, span).collect())
    assert found(0, 1) == [(1, 3), (4, 7), (9, 10)] and found(1, 2) == [(1, 7)] and found(2, 1) == [(1, 10)] and found(0, 4) == []
    assert cuts.column_entropy(table(spark, rows).limit(0), "s").count() == 0


@pytest.mark.parametrize("seed, melting, distance", [(1, 20.0, 3), (2, 35.0, 1), (3, 30.0, 5)])
def test_overlaps_and_cuts_equal_brute_force(spark, seed, melting, distance):
    rows = variants(seed, 25)
    df = table(spark, rows)
    regions = sorted((r["start"], r["end"]) for r in cuts.variable_regions(cuts.column_entropy(df, "s"), 0, 8).collect())
    known = plain_overlaps(rows, regions, melting, distance, 8, 14)
    found = cuts.Overlaps(df, "s", len(rows), 100, regions, melting, distance, 8, 14)
    some = cuts.Overlaps(df, "s", len(rows), 100, regions, melting, distance, 8, 14)
    assert all(found.found[q] >= r for q, r in known.items())
    found.settle(list(range(101)))
    assert found.found == known and known
    for limit in (40, 46, 60):
        assert cuts.fewest_cuts(known, 100, limit) == some.cuts(100, limit) == plain_cuts(known, 100, limit)


def test_fragments_join_to_the_sequences(spark):
    rows = variants(5, 40)
    out, status = cuts.split_shared(table(spark, rows), "s", 50, 20.0, 2, 8, 14)
    at = status["overlaps"]
    for r in out.collect():
        parts = [p.translate(TABLE)[::-1] if i % 2 else p for i, p in enumerate(r["fragments"])]
        joined = parts[0]
        for (a, b), p in zip(at, parts[1:], strict=True):
            assert joined.endswith(p[: b - a])
            joined += p[b - a :]
        assert joined == rows[r["id"]] and max(map(len, parts)) <= 50
    assert all(apart(rows, a, b) >= 2 and min(plain_melting(s[a:b]) for s in rows) >= 20 for a, b in at)


def test_near_rows_and_copies(spark):
    s = "ACGTTGCAACGGTACCATGCAACGTTGCATTG"
    rows = [s, s[:9] + "T" + s[10:], s.translate(TABLE)]
    assert cuts.too_near(table(spark, rows), "s", [(8, 8), (12, 8), (32, 32), (32, 20)], 2) == {8, 12, 32}
    assert cuts.too_near(table(spark, rows), "s", [(12, 8)], 1) == set() and cuts.too_near(table(spark, [s] * 500), "s", [(12, 8)], 1) == {12}
    assert cuts.too_near(table(spark, rows), "s", [], 3) == set()


def test_reasons(spark):
    rows = variants(6, 30)
    reason = lambda rows, *a: cuts.split_shared(table(spark, rows), "s", *a)[1]["reason"]
    assert reason(rows, 200, 20.0, 2, 8, 14) == "sequences are shorter than the limit"
    assert reason([*rows, rows[0] + "A" * 45], 50, 20.0, 2, 8, 14) == "lengths differ too much"
    assert reason([*rows, rows[0] + "A" * 20], 50, 20.0, 2, 8, 14) == "sequences need different numbers of fragments"
    assert reason([rows[0]] * 3, 50, 20.0, 2, 8, 14) == "no variable region is long enough"
    assert reason(rows, 27, 20.0, 2, 8, 14) == "the first variable region is too far from the beginning"
    assert reason([*rows, rows[0]], 50, 20.0, 2, 8, 14) == "no overlaps meet both limits"
    assert reason(rows, 50, 90.0, 2, 8, 14) == "no overlaps meet both limits"
    assert cuts.reach_reason([(0, 20), (60, 90)], 100, 50, 8) == "variable regions are too far apart"
    assert cuts.reach_reason([(0, 20)], 100, 50, 8) == "the last variable region is too far from the end"
    for bad in ([], [None], ["ACGN" * 30]):
        with pytest.raises(ValueError):
            cuts.split_shared(table(spark, bad), "s", 50, 20.0, 2, 8, 14)
