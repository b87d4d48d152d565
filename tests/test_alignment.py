"""Approximate places, mates, strands, barcodes and counts by combinations, against plain tables of edits."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqspark.operators import alignment as A
from seqspark.operators import fuzzy, reads


def ends_of(pattern, text, from_start=False):
    """Least distance of a pattern to a substring of text for each end, by a full table."""
    row = [j if from_start else 0 for j in range(len(text) + 1)]
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return row


def plain(pattern, text, from_start=False):
    row = ends_of(pattern, text, from_start)[1:]
    if not pattern:
        return 0, 0, len(text), len(text) + 1
    if not row:
        return len(pattern), 0, 0, 0
    at = [j + 1 for j, v in enumerate(row) if v == min(row)]
    return min(row), at[0], at[-1], len(at)


def some_letters(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def spoiled(rng, s, edits):
    for _ in range(edits):
        k, kind = rng.randrange(len(s)), rng.randrange(3)
        s = s[:k] + ("" if kind == 0 else rng.choice("ACGT") + (s[k:] if kind == 1 else s[k + 1 :])) if kind else s[:k] + s[k + 1 :]
    return s


@pytest.mark.parametrize("from_start", [False, True])
def test_infix_equals_the_full_table(from_start):
    rng = random.Random(1)
    patterns, texts = [], []
    for _ in range(500):
        t = some_letters(rng, rng.choice((0, 1, 4, 30, 150)))
        n = rng.choice((0, 1, 3, 10, 63, 64, 65, 130))
        k = rng.randrange(len(t) + 1)
        p = t[k : k + n] if rng.random() < 0.6 else some_letters(rng, n)
        patterns.append(spoiled(rng, p, rng.randrange(4)) if len(p) > 4 else p + rng.choice(("", "é", "N")))
        texts.append(t)
    got = A.infix(patterns, texts, from_start)
    for i, (p, t) in enumerate(zip(patterns, texts, strict=True)):
        assert (got.distance[i], got.first[i], got.last[i], got.count[i]) == plain(p, t, from_start)
    assert len(A.infix([], []).distance) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ACG", max_size=12), st.text("ACG", max_size=20)), min_size=1, max_size=9))
def test_infix_of_any_rows(pairs):
    got = A.infix([p for p, _ in pairs], [t for _, t in pairs])
    for i, (p, t) in enumerate(pairs):
        assert (got.distance[i], got.first[i], got.last[i], got.count[i]) == plain(p, t)


def test_starts_are_leftmost():
    rng = random.Random(2)
    patterns, texts = [some_letters(rng, 6) for _ in range(200)], [some_letters(rng, 25) for _ in range(200)]
    found = A.infix(patterns, texts)
    got = A.starts(patterns, texts, found.first)
    for p, t, d, e, s in zip(patterns, texts, found.distance, found.first, got, strict=True):
        whole = lambda a, e=e, t=t, p=p: ends_of(p, t[a:e], True)[-1]
        assert s == min(a for a in range(e + 1) if whole(a) == d)


def plain_overlap(x, y):
    """(length, edits) of the overlap, or None."""
    if len(x) < 10:
        return None
    d, end, _, n = plain(x[-10:], y)
    if d > 4 or n > 10 or end < 10 or end > len(x):
        return None
    h = sum(a != b for a, b in zip(x[-end:], y[:end], strict=True))
    return (end, h) if h <= 10 and plain(y[:end], x)[0] >= h else None


def plain_merge(x, y, q, r, inward=True):
    mixed = lambda a, b, s, t: "".join(d if c != d and u < v else c for c, d, u, v in zip(a, b, s, t, strict=True))
    found = {True: plain_overlap(x, y), False: plain_overlap(y, x)}
    read = {}
    for kind, o in found.items():
        if o:
            n = o[0]
            read[kind] = x[:-n] + mixed(x[-n:], y[:n], q[-n:], r[:n]) + y[n:] if kind else mixed(x[:n], y[-n:], q[:n], r[-n:])
    a, b = found[inward], found[not inward]
    if a and a[1] == 0 or a and not b:
        return read[inward]
    if b and not a:
        return read[not inward]
    return None if not a or a[1] == b[1] else read[inward] if a[1] < b[1] else read[not inward]


def mates(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        f = some_letters(rng, 60)
        x, y = (f[:40], f[22:]) if i % 4 else (f[22:], f[:40])
        if i % 11 == 0:
            y = some_letters(rng, 38)
        x, y = spoiled(rng, x, rng.randrange(3)), spoiled(rng, y, rng.randrange(3))
        out.append((x, y, some_letters(rng, len(x), "#5FI"), some_letters(rng, len(y), "#5FI")))
    a, b = some_letters(rng, 30), "AC" * 20
    return out + [(a, a, "I" * 30, "F" * 30), (b, b, "I" * 40, "I" * 40), ("", "", "", ""), ("ACGT", "ACGT", "IIII", "IIII"), ("A" * 40, "A" * 40, "I" * 40, "I" * 40)]


@pytest.mark.parametrize("inward", [True, False])
def test_mates_merge_as_plainly(inward):
    rows = mates(300)
    got = A.merge(*map(list, zip(*rows, strict=True)), inward)
    assert got == [plain_merge(*r, inward) for r in rows]
    assert sum(x is not None for x in got) > 120


def test_merged_tables_and_order_of_kinds(spark):
    rows = mates(120, 3)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(900, "ACGTACGTACGT", None, "IIII", None), (901, None, "ACGT", None, "I"), (902, None, None, None, None)], "i int, a string, b string, qa string, qb string").repartition(3)
    assert A.inward_first(df, "a", "b") and not A.inward_first(df.select("i", F.col("b").alias("a"), F.col("a").alias("b")), "a", "b")
    got = {r["i"]: r["merged"] for r in A.merged(df, "a", "b", "qa", "qb").collect()}
    assert [got[i] for i in range(len(rows))] == [plain_merge(*r) for r in rows]
    assert (got[900], got[901], got[902]) == ("ACGTACGTACGT", None, None)
    assert A.merged(df.limit(0), "a", "b", "qa", "qb").collect() == []
    numbers = df.withColumn("qa", F.transform(F.split("qa", ""), F.ascii)).withColumn("qb", F.transform(F.split("qb", ""), F.ascii))
    assert {r["i"]: r["merged"] for r in A.merged(numbers, "a", "b", "qa", "qb", True).collect()} == got


def plain_strand(s, anchor, errors):
    if s is None or len(s) < len(anchor) - errors:
        return None
    back = A.other_strand(s)
    if anchor in s or anchor in back:
        return None if anchor in s and anchor in back else s if anchor in s else back
    f, r = plain(anchor, s)[0], plain(A.other_strand(anchor), s)[0]
    return None if f == r or min(f, r) > errors else s if f < r else back


def plain_cut(s, const, errors, prefix):
    if not s or len(s) < len(const) - errors:
        return None
    if const in s:
        return s.rpartition(const)[2] if prefix else s.partition(const)[0]
    d, first, last, _ = plain(const, s)
    if d > errors:
        return None
    if prefix:
        return s[last:]
    return s[: min(a for a in range(first + 1) if ends_of(const, s[a:first], True)[-1] == d)]


def test_strands_and_barcodes_equal_full_tables():
    rng = random.Random(4)
    pre, suf = "GATTACAGT", "CTTGACCAT"
    data = [None, "", "ACG", pre + suf, pre + A.other_strand(pre), suf, pre, pre + "AC" + suf + "G" * 50_000]
    for i in range(400):
        s = some_letters(rng, 4) + spoiled(rng, pre, rng.randrange(4)) + some_letters(rng, 8) + spoiled(rng, suf, rng.randrange(4)) + some_letters(rng, 6)
        data.append(s if i % 3 else A.other_strand(s))
    short = [s if s is None or len(s) < 99 else s[:99] for s in data]
    strands = [plain_strand(s, pre, 2) for s in short]
    assert A.oriented(short, pre, 2) == strands
    after = [plain_cut(s, pre, 2, True) for s in strands]
    assert A.Element(pre, None, 8, 1, 2).barcodes(short) == (strands, [(s[:9] or None) if s else None for s in after])
    assert A.Element(pre, suf, 8, 1, 2).barcodes(short)[1] == [(plain_cut(s, suf, 2, False) or None) if s else None for s in after]
    gapped = [x[2:-1] if x and len(x) > 3 else None for x in (plain_cut(s, suf, 2, False) if s else None for s in after)]
    assert A.Element(pre, suf, 8, 1, 2, pre_gap=2, post_gap=1).barcodes(short)[1] == gapped
    turned = [plain_strand(s, suf, 2) for s in short]
    assert A.Element(None, suf, 8, 1, 2).barcodes(short) == (turned, [(c[-9:] or None) if c else None for c in (plain_cut(s, suf, 2, False) for s in turned)])
    assert A.Element(pre, suf, 8, 1, 2).barcodes(data)[1][7] == "AC"  # a long read


def test_within_takes_the_shorter_as_pattern(spark):
    rng = random.Random(5)
    rows = [(some_letters(rng, rng.randrange(1, 12)), some_letters(rng, rng.randrange(1, 30)), rng.randrange(4)) for _ in range(200)] + [(None, "A", 1), ("A", None, 1), ("A", "C", None), ("", "ACG", 0)]
    df = spark.createDataFrame(rows, "a string, b string, e int")
    got = [r["w"] for r in df.select(A.within("a", "b", F.col("e")).alias("w")).collect()]
    assert got == [None if None in r else (plain(r[0], r[1]) if len(r[0]) <= len(r[1]) else plain(r[1], r[0]))[0] <= r[2] for r in rows]
    same = spark.createDataFrame([("ACGTACGTACGT", "ACTTACGTTCGT")], "a string, b string")  # of one length
    assert [fuzzy.associate_matches(same, "a", "b", n).first()["matched"] for n in (1, 2)] == [False, True]


def test_lookup_takes_equal_codes_first_and_none_of_two_as_near(spark):
    known = spark.createDataFrame([(1, "AAAACCCC"), (2, "AAAACCCG"), (3, "GGTTGGTT"), (4, None)], "id int, barcode string")
    codes = spark.createDataFrame([("AAAACCCC",), ("AAAACCCT",), ("GGTTGGT",), ("GGTTGGTTA",), ("TTTTTTTT",)], "code string")
    assert {r["code"]: r["id"] for r in fuzzy.lookup(codes, known, 1).collect()} == {"AAAACCCC": 1, "GGTTGGT": 3, "GGTTGGTTA": 3}
    assert {r["code"]: r["id"] for r in fuzzy.lookup(codes, known, 0).collect()} == {"AAAACCCC": 1}


def test_counts_by_combinations(spark):
    c = ("ACGGTTACATGCAG", "TTGACCATGAGGCA", "CAGTACCGTTAGGA", "GGATTCACTCGATA")
    a, b = {1: "AACCAACCGGTT", 2: "TTGGTTGGAACA"}, {"x": "CATCATCATGGG"}
    first, second = lambda k: c[0] + a[k] + c[1], c[2] + b["x"] + c[3]
    rows = [
        (first(1) + "GGG" + second + "TTTACGT", 5),
        (A.other_strand(first(1) + "GGG" + second + "TTTACGT"), 2),  # the other strand
        (first(1).replace("CCAACC", "CCATCC") + "GGG" + second + "TTTACCT", 3),  # an error in the barcode, one in the associate
        (first(1) + "GGG" + second + "GGGGGG", 4),  # another associate
        (first(2), 6),  # no second barcode: its associate isn't asked for
        (c[0] + "GTGTGTGTGTGT" + c[1] + second, 7),  # an unknown first barcode
        (c[0] + "GTGTGTGTGTGT" + c[1], 8),
        (c[0] + c[1], 9),
        ("GATTACA", 10),
        (None, 11),
    ]
    packs = spark.createDataFrame(rows, "seq string, freq long").withColumn("id", F.lit("clash"))
    known = {"a": spark.createDataFrame([(k, v, "ACGT" if k == 1 else None) for k, v in [*a.items(), (1, a[1])]], "id int, barcode string, associate string"), "b": spark.createDataFrame(list(b.items()), "id string, barcode string")}
    elements = {"a": A.Element(c[0], c[1], 12, 1, 1), "b": A.Element(c[2], c[3], 12, 1, 1)}
    counts, outcomes = reads.counted_tuples(packs, elements, known, {"a": A.Associate(c[3], None, 1, 1)})
    assert {(r["a"], r["b"]): r["n"] for r in counts.collect()} == {("1", "x"): 10, ("-", "x"): 7}
    assert {r["outcome"]: r["n"] for r in outcomes.collect()} == {"counted": 17, "associate": 10, "not mapped": 8, "no barcode": 9, "no anchor": 21}
    plain_counts, _ = reads.counted_tuples(packs, elements, known)
    assert {(r["a"], r["b"]): r["n"] for r in plain_counts.collect()} == {("1", "x"): 14, ("2", "-"): 6, ("-", "x"): 7}
    empty, none = reads.counted_tuples(packs.limit(0), elements, known)
    assert empty.collect() == [] == none.collect() and empty.columns == ["a", "b", "n"]


def test_long_reads_do_not_need_tables_of_their_square():
    found = A.infix(["ACGGTTACATGC"] * 2, ["G" * 300_000 + "ACGGTTACTTGC" + "G" * 1000, ""])
    assert (found.distance[0], found.first[0], found.distance[1]) == (1, 300_012, 12) and isinstance(found.distance, np.ndarray)
