"""Operators on small tables: invariants, nulls, empty tables, ties."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from seqspark.operators import design, filters, fuzzy, graphs, kmers, reads, scoring, statistics, windows
from seqspark.sources import files


def test_filters_and_antifilters_part_the_table(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    lists = {"k": ["a"]}
    assert filters.in_lists(df, lists).count() + filters.not_in_lists(df, lists).count() == 3
    with pytest.raises(ValueError):
        filters.checked_lists(df, {"k": ["a", "z"]})


def test_insert_column_orders():
    assert filters.insert_column(["a", "b"], "n", left="a") == ["a", "n", "b"]
    assert filters.insert_column(["a", "b"], "n", right="a") == ["n", "a", "b"]
    assert filters.insert_column(["a", "b"], "n") == ["a", "b", "n"]


def test_runs_of_places(spark):
    df = spark.createDataFrame([("x", p) for p in (1, 2, 3, 7, 8, 20)], "k string, p int")
    got = sorted(tuple(r)[1:] for r in windows.runs(df, ["k"], "p").collect())
    assert got == [(1, 3, 3), (7, 8, 2), (20, 20, 1)]


def test_split_places_takes_motifs_literally(spark):
    df = spark.createDataFrame([("a.b.c", "."), ("none", ".")], "t string, m string")
    assert [r["places"] for r in windows.split_places(df, "t", "m").collect()] == [[1, 3], []]


def test_independent_set_is_independent_and_maximal(spark):
    pairs = [(a, b) for a, b in itertools.combinations(range(30), 2) if (a * 7 + b * 3) % 5 == 0]
    vertices = spark.range(35).withColumnRenamed("id", "v")
    edges = spark.createDataFrame(pairs, "a long, b long")
    chosen = {r["v"] for r in graphs.independent_set(vertices, edges).collect()}
    assert not any(a in chosen and b in chosen for a, b in pairs)
    near = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in range(35)}
    assert all(v in chosen or near[v] & chosen for v in range(35))
    again = {r["v"] for r in graphs.independent_set(vertices.repartition(7), edges.repartition(3)).collect()}
    assert again == chosen
    cover = {r["v"] for r in graphs.vertex_cover(vertices, edges).collect()}
    assert all(a in cover or b in cover for a, b in pairs)


def test_independent_set_without_edges(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert graphs.independent_set(spark.range(3).withColumnRenamed("id", "v"), none).count() == 3


def test_maximal_sets(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b"), (4, "c")], "g int, m string")
    assert sorted(r["g"] for r in graphs.maximal_sets(df, "g", "m").collect()) == [1, 4]


def test_hamming_pairs_equal_brute_force(spark):
    words = ["AACC", "AACG", "AATT", "TTTT", "AACC", "GGCC"]
    df = spark.createDataFrame(list(enumerate(words)), "k long, s string")
    got = {(r["a"], r["b"], r["distance"]) for r in fuzzy.hamming_pairs(df, "k", "s", 4, 2).collect()}
    d = lambda x, y: sum(a != b for a, b in zip(x, y, strict=True))
    assert got == {(i, j, d(words[i], words[j])) for i, j in itertools.combinations(range(6), 2) if d(words[i], words[j]) <= 2}


def test_best_match_rejects_ties(spark):
    known = spark.createDataFrame([("k1", "ACGTACGT"), ("k2", "ACGTACGA")], "label string, s string")
    asked = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACGTACGG"), (3, "CGTACGT"), (4, "TTTTTTTT")], "id int, q string")
    got = {(r["id"], r["label"], r["distance"]) for r in fuzzy.best_match(asked, known, "id", "q", "label", "s", 2).collect()}
    assert got == {(1, "k1", 0), (3, "k1", 1)}


def test_longest_agreeing_never_falls_back_past_ambiguity(spark):
    known = spark.createDataFrame([("x", "AAACCC"), ("y", "AAACCG")], "label string, s string")
    corpus = fuzzy.substring_corpus(known, "label", "s", 4, 6)
    asked = spark.createDataFrame([(1, "AAACC"), (2, "AAACCC")], "id int, q string")
    got = {(r["id"], r["label"]) for r in fuzzy.longest_agreeing(asked, corpus, "id", "q", "label", 4, 6).collect()}
    assert got == {(2, "x")}


def test_associates(spark):
    df = spark.createDataFrame([("AACCGGTT", "CCGG"), ("AACCGGTT", "CCTG"), ("AACCGGTT", "TGTGTG"), (None, "A")], "r string, a string")
    assert [r["matched"] for r in fuzzy.associate_matches(df, "r", "a", 1).collect()] == [True, True, False, None]


def test_shared_pairs_and_background(spark):
    df = spark.createDataFrame([(1, "ACGTAC"), (2, "GTACGG"), (3, "TTTTTT"), (4, None)], "id int, s string")
    k = kmers.exploded(df, "id", F.col("s"), 4)
    assert {(r["a"], r["b"], r["shared"]) for r in kmers.shared_pairs(k, "id").collect()} == {(1, 2, 1)}
    known = kmers.background(spark.createDataFrame([("TTTT",)], "kmer string"))
    assert sorted(r["id"] for r in kmers.clear_of(df, "id", k, known).collect()) == [1, 2, 4]


def test_barcodes_keep_their_distance(spark):
    got = [r["s"] for r in design.barcodes(spark, 4, 3, ["AAA"]).collect()]
    assert got and all(sum(a != b for a, b in zip(x, y, strict=True)) >= 3 for x, y in itertools.combinations(got, 2))
    assert not any("AAA" in s for s in got)


def test_fill_and_parts():
    s = design.fill("NNNNNN", "GAATT", ["GAATTC", "AA"], 3)
    assert len(s) == 6 and "AA" not in "T" + s and not ("GAATT" + s).count("GAATTC")
    assert design.fill("AA", "", ["AA"], 0) is None
    parts = design.make_parts("NNNNNNNNNN", 5, 6, seed=2)
    pieces = [p[i : i + 6] for p in parts for i in range(5)]
    assert len(parts) == 5 and len(set(pieces)) == len(pieces)


def test_fragments_overlap(spark):
    df = spark.createDataFrame([("ABCDEFGHIJ",)], "s string")
    got = [r["piece"] for r in df.select(F.inline(design.fragments(F.col("s"), 4, 1))).collect()]
    assert got == ["ABCD", "DEFG", "GHIJ"]


def test_checked_table_says_what_is_wrong(spark):
    with pytest.raises(ValueError, match="unique"):
        design.checked_table(spark.createDataFrame([(1, "A"), (1, "C")], "id int, s string"), "id", ["s"])
    with pytest.raises(ValueError, match="DNA"):
        design.checked_table(spark.createDataFrame([(1, "AX")], "id int, s string"), "id", ["s"])


def test_reads_are_merged_oriented_and_counted(spark):
    df = spark.createDataFrame([("AACCGG", "TTCCGG"), ("AAAA", "CCCC")], "a string, b string")
    assert [r[0] for r in df.select(reads.merged_mates(F.col("a"), F.col("b"), 2, 6)).collect()] == ["AACCGGAA", "AAAA-----CCCC"]
    packs = spark.createDataFrame([("AACCGGTTACACGTTTGG", 3), ("GGGG", 2)], "seq string, freq long")
    known = spark.createDataFrame([("b1", "ACGT")], "id string, barcode string")
    counts, outcome = reads.counted(packs, known, "AACCGGTTAC", "AACCGGTTAC", "TTGG")
    assert {tuple(r) for r in counts.collect()} == {("b1", 3)}
    assert {tuple(r) for r in outcome.collect()} == {("counted", 3), ("no anchor", 2)}


def test_callbacks_are_tried_first(spark):
    df = spark.range(10)
    assert reads.filtered_by(df, lambda s: s > 6, ["id"]).count() == 3
    with pytest.raises(TypeError):
        reads.filtered_by(df, lambda s: s, ["id"])


def test_models_bind_columns_and_skip_what_is_done(spark):
    models = scoring.Models()
    models.add(lambda x, k=2.0: x * k, "twice")
    df = spark.createDataFrame([(1, 3.0), (2, None)], "id int, X double")
    got = {r["id"]: r["prediction"] for r in models.predict(df, "id").collect()}
    assert got[1] == 6.0
    done = spark.createDataFrame([(1, "twice")], "id int, model string")
    assert [r["id"] for r in models.predict(df, "id", done).collect()] == [2]
    with pytest.raises(ValueError):
        models.add(lambda y: y, "twice")
    assert not (models - ["twice"]).functions


def test_mad_of_zero_marks_all_others(spark):
    df = spark.createDataFrame([("g", 1.0)] * 5 + [("g", 2.0)], "g string, v double")
    assert sorted(r["outlier"] for r in statistics.mad_outliers(df, ["g"], "v").collect()) == [False] * 5 + [True]


def test_kendall_with_ties(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 2, 2), ("g", 3, 3), ("g", 3, 1)], "g string, x int, y int")
    assert statistics.kendall(df, ["g"], "x", "y").first()["kendall"] == pytest.approx((3 - 1) / 5)


def test_fasta_fastq_and_genbank(spark, tmp_path):
    import gzip

    (tmp_path / "a.fa").write_text(">one\nACGT\nAC\n>two\nGG\n")
    assert {tuple(r) for r in files.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {("one", "ACGTAC"), ("two", "GG")}
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\nIIII\n@r2\nNN\n+\n!!\n")
    got = {r["read_id"]: (r["seq"], r["qual"]) for r in files.read_fastq(spark, str(tmp_path / "r.fastq.gz")).collect()}
    assert got == {"r1": ("ACGT", [40] * 4), "r2": ("NN", [0, 0])}
    back = {r["read_id"]: r["seq"] for r in files.read_fastq(spark, str(tmp_path / "r.fastq.gz"), invert=True).collect()}
    assert back["r1"] == "ACGT"
    (tmp_path / "g.gb").write_text('LOCUS       X1 10 bp\nFEATURES             Location/Qualifiers\n     CDS             2..4\n                     /label="p"\nORIGIN\n        1 acgtacgtac\n//\n')
    r = files.read_genbank(spark, str(tmp_path / "g.gb")).first()
    assert (r["locus"], r["kind"], r["start"], r["end"], r["label"], r["seq"]) == ("X1", "CDS", 1, 4, "p", "CGT")
    with pytest.raises(ValueError):
        files.read_table(spark, "x.pickle")


def test_stems_against_plain_loops(spark):
    from random import Random

    from seqspark.functions import constraints as C

    draw = Random(5)
    rows = ["".join(draw.choice("((..))") for _ in range(draw.randrange(1, 40))) for _ in range(60)] + ["", "....", "((()))", None]

    def pairs(s):
        held, out = [], []
        for i, c in enumerate(s, 1):
            if c == "(":
                held.append(i)
            elif c == ")" and held:
                out.append((held.pop(), i))
        return sorted(out)

    def stems(s):
        known, out = set(pairs(s)), []
        for i, j in sorted(known):
            if (i - 1, j + 1) not in known:
                n = 1
                while (i + n, j - n) in known:
                    n += 1
                out.append((i, j, n))
        return out

    df = spark.createDataFrame([(s,) for s in rows], "s string").select("s", C.stems(F.col("s")).alias("t"), C.kinetic_score(F.col("s")).alias("k"))
    for r in df.collect():
        if r.s:
            assert [tuple(x) for x in r.t] == stems(r.s), r.s
            widest = max((j - i for i, j in pairs(r.s)), default=0)
            assert r.k.score == widest / len(r.s) and r.k.chance == pytest.approx(widest**-1.44 if widest else 1.0, rel=1e-12)


def test_capacity_and_stores(spark):
    from seqspark.operators import kmers

    parts = spark.createDataFrame([(12, 3), (4, 9), (7, None)], "n int, w int")
    assert tuple(kmers.capacity(parts, F.col("n"), F.col("w"), 5).first()) == (512, None, False)
    assert tuple(kmers.capacity(parts.where("w IS NOT NULL"), F.col("n"), F.col("w"), 5).first()) == (512, 25, True)
    assert tuple(kmers.capacity(parts.limit(0), F.col("n"), F.col("w"), 5).first()) == (512, 0, True)
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "kmer string")
    store = kmers.removed(kmers.added(words("AA", "AC", "AA"), words("AC", "GG")), words("AA"))
    assert sorted(r.kmer for r in store.collect()) == ["AC", "GG"]
    assert sorted(map(tuple, kmers.checked(store, words("GG", "TT")).collect())) == [("GG", True), ("TT", False)]


def test_splittable_edges(spark):
    from seqspark.functions import constraints as C

    regions = "array<struct<start:int,end:int>>"
    rows = [([(0, 20)], 30), ([(35, 60)], 80), ([(10, 30), (52, 60)], 80), ([(10, 20), (50, 70)], 90), ([], 10), ([(10, 20)], 51)]
    df = spark.createDataFrame(rows, f"r {regions}, n int").select(C.splittable(F.col("r"), F.col("n"), 40, 10).alias("ok"))
    assert [r.ok for r in df.collect()] == [True, False, False, False, False, False]


def test_read_filter_counts_letters(spark):
    rows = ["ACGT", "AACCGG", "ACGN", "ABCDEFG", "AAAAAAAAAAAA", "", None, "NNNNNNNNNNNACGT", "AAC" * 20_000, "AACG" * 20_000 + "T"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in rows], "s string").select(filters.read_filter(F.col("s"), 3)).collect()]
    want = ["ok" if s is None else "ambiguous" if s.count("N") > 10 else "short" if len(s) < 3 else "ambiguous" if len(set(s)) < 4 else "ok" for s in rows]
    assert got == want
