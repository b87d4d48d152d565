"""What must not grow with the square of the input, or be made by one task: results by brute force, and the plans that give them."""

from __future__ import annotations

import itertools
import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from seqspark.operators import fuzzy


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hamming_pairs_of_any_letters_without_folding_candidates(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ACGT" if i % 3 else "ACN-") for _ in range(8)) for i in range(120)] + ["ACGTACGT", "ACGTACGT", "NNNNNNNN", "NNNNNNNA"]
    df = spark.createDataFrame([*enumerate(words), (999, None)], "k long, s string")
    out = fuzzy.hamming_pairs(df, "k", "s", 8, 2)
    d = lambda x, y: sum(a != b for a, b in zip(x, y, strict=True))
    known = sorted((i, j, d(words[i], words[j])) for i, j in itertools.combinations(range(len(words)), 2) if d(words[i], words[j]) <= 2)
    assert sorted(tuple(r) for r in out.collect()) == known
    assert "Aggregate" not in plan(out) and "Broadcast" not in plan(out)


def test_guides_meet_foldings_of_beginnings_not_all_of_them(spark):
    from math import exp

    from seqspark.functions import sequences as S
    from seqspark.plans.joins import j12

    part, supplier = spark.range(40).withColumnRenamed("id", "p_partkey"), spark.range(7).withColumnRenamed("id", "s_suppkey")
    out = j12(SimpleNamespace(part=part, supplier=supplier))
    dna = lambda df, key: [r[0] for r in df.select(S.derived_dna(key)).collect()]
    e = lambda s, g: sum(0.5 + j * 0.1 for j in range(1, 9) if s[j - 1] != g[j - 1])
    sites = [s[:8] for s in dna(part, F.col("p_partkey"))]
    for r, g in zip(sorted(out.collect()), dna(supplier, F.col("s_suppkey") + 500), strict=True):
        assert abs(r["z"] - 1 - sum(exp(-e(s, g) / 0.6) for s in sites)) < 2e-6 and abs(r["least"] - min(e(s, g) for s in sites)) < 2e-6
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_shared_pairs_are_told_without_a_shuffle_of_pairs(spark):
    from seqspark.operators import graphs, kmers

    rng = random.Random(2)
    texts = ["".join(rng.choice("ACGT") for _ in range(20)) for _ in range(60)] + ["ACGNNACG", "CGNNAC", "ACGTACGTAAAA", "A"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    out = kmers.shared_pairs(kmers.exploded(df, "id", F.col("s"), 4), "id")
    own = [{s[i : i + 4] for i in range(len(s) - 3)} for s in texts]
    known = sorted((i, j, len(own[i] & own[j])) for i, j in itertools.combinations(range(len(texts)), 2) if own[i] & own[j])
    assert sorted(tuple(r) for r in out.collect()) == known
    top = plan(out)
    assert top.index("SortMergeJoin") < top.index("Aggregate")  # nothing is folded after the pairs meet
    degree = {r["v"]: r["degree"] for r in graphs.degrees(out, unique=True).collect()}
    assert degree == {v: n for v in range(len(texts)) if (n := sum(v in p[:2] for p in known))}


def test_independent_in_groups(spark):
    from seqspark.operators import graphs

    rng = random.Random(3)
    members = sorted({(v, rng.randrange(60)) for v in range(80) for _ in range(3)} | {(v, 99) for v in range(0, 80, 2)})
    df, vertices = spark.createDataFrame(members, "v long, g long"), spark.range(90).withColumnRenamed("id", "v")
    chosen = {r["v"] for r in graphs.independent_in_groups(vertices, df).collect()}
    near = lambda v: {u for u, g in members if (v, g) in set(members)} - {v}
    assert all(not near(v) & chosen for v in chosen) and all(near(v) & chosen for v in set(range(90)) - chosen)
    assert chosen == {r["v"] for r in graphs.independent_in_groups(vertices, df.repartition(7)).collect()}


def test_repeats_within_rows_are_counted_by_key_and_not_shuffled(spark):
    from collections import Counter

    from seqspark.operators import kmers

    rows = [(1, "ACGTACGTACG"), (1, "CGTAC"), (2, "AAAAAA"), (3, "AC"), (4, None), (None, "ACACAC"), (5, "ACGGT")]
    out = kmers.internal_repeats(spark.createDataFrame(rows, "id int, s string"), "id", F.col("s"), 3)
    known = Counter((k, min(p, p.translate(str.maketrans("ACGT", "TGCA"))[::-1])) for k, s in rows for i in range(len(s or "") - 2) for p in [s[i : i + 3]])
    assert Counter({(r["id"], r["kmer"]): r["n"] for r in out.collect()}) == Counter({x: n for x, n in known.items() if n > 1})
    assert "kmer" not in plan(out).rsplit("Exchange", 1)[1]  # what is shuffled are rows, not their k-mers


def test_maximal_repeats_fold_rows_before_kmers(spark):
    from seqspark.operators import kmers

    rows = [(1, "AACGT"), (2, "TACGA"), (2, "TACGA"), (3, "GGACG"), (4, "CCCC"), (None, "TTTT"), (5, "TTTT")]
    out = kmers.maximal_repeats(spark.createDataFrame(rows, "id int, s string"), "id", F.col("s"), 3)
    assert sorted(tuple(r) for r in out.collect()) == [("ACG", 3, 4), ("CCC", 1, 2), ("TTT", 1, 4)]
    assert "Expand" not in plan(out)


def test_lookup_asks_equal_queries_once(spark):
    known = spark.createDataFrame([("a", "ACGTAC"), ("b", "ACGTAA"), ("c", "TTTTTT")], "label string, s string")
    asked = spark.createDataFrame([(k, q) for k in range(30) for q in ["ACGTAC"]] + [(30, "ACGTAG"), (31, "TTTTT"), (32, None), (33, "TTTTTA"), (33, "TTTTTT")], "id long, q string")
    out = fuzzy.best_match(asked, known, "id", "q", "label", "s", 2)
    assert sorted(tuple(r) for r in out.collect()) == [(k, "a", 0) for k in range(30)] + [(31, "c", 1), (33, "c", 0)]
    assert "Window" not in plan(out)


def test_maximal_sets_meet_at_their_rarest_member(spark):
    from seqspark.operators import graphs

    rng = random.Random(4)
    sets = {g: {rng.randrange(9) for _ in range(rng.randrange(1, 5))} | {99} for g in range(60)}
    rows = [(g, m) for g, s in sets.items() for m in s] + [(100, None), (101, 5), (101, None), (102, 5), (102, 5)]
    sets |= {100: {None}, 101: {5, None}, 102: {5}}
    out = graphs.maximal_sets(spark.createDataFrame(rows, "g long, m long"), "g", "m")
    part = lambda g, h: g != h and None not in sets[g] and sets[g] <= sets[h] and (sets[g] < sets[h] or h < g)
    assert sorted(tuple(r) for r in out.collect()) == sorted((g, len(s)) for g, s in sets.items() if not any(part(g, h) for h in sets))


def test_rows_of_narrow_files_are_spread(spark, tmp_path):
    from seqspark.plans import feasible, joins, more, pipelines, scoring

    folder = str(tmp_path)
    spark.range(500).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(folder + "/part.parquet")
    spark.range(500).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(folder + "/customer.parquet")
    queries = {"k14_longest_common": more, "f39_sites_within": feasible, "f28_stem_conflicts": feasible, "r04_hairpins": scoring, "j09_contextual_membership": more, "f27_sufficient_windows": more, "n08_windowed_folding": pipelines, "r05_tandem": scoring, "g01_edges": joins}
    for name, module in queries.items():
        made = plan(module.QUERIES[name](spark, folder))
        assert "REPARTITION_BY_NUM" in made and "md5" not in made.rsplit("REPARTITION_BY_NUM", 1)[1], name


def test_groups_meet_their_fit_in_many_tasks(spark):
    from seqspark.operators import statistics

    df = spark.range(300).select(F.lit("A").alias("g"), F.col("id").cast("double").alias("x"), (2 * F.col("id") + 1).cast("double").alias("y"))
    out = statistics.subgroup_report(df, "g", "x", "y")
    assert {r["subgroup"]: (r["n"], round(r["slope"], 6), round(r["rmse"], 6)) for r in out.collect()} == {"A": (300, 2.0, 0.0), "ALL": (300, 2.0, 0.0)}
    assert "_copy" in plan(out)


def test_best_spacing_is_found_within_a_row(spark):
    from seqspark.plans.scoring import m09

    out = m09(SimpleNamespace(part=spark.range(9).withColumnRenamed("id", "p_partkey")))
    assert out.count() == 9 and "Generate" not in plan(out)


def test_windows_of_many_narrow_rows_are_not_broadcast(spark, tmp_path):
    from seqspark.operators import cuts
    from seqspark.plans.feasible import variants

    spark.range(300).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = variants(SimpleNamespace(part=spark.read.parquet(str(tmp_path / "part.parquet"))))
    assert "REPARTITION_BY_NUM" in plan(rows)
    pairs = cuts.near_pairs(rows, "s", [(40, 15)], 2)
    assert "SortMergeJoin" in plan(pairs) and "Broadcast" not in plan(pairs)


def test_streams_are_written_by_executors(spark, tmp_path):
    from seqspark.streaming import counts as ST

    folder = str(tmp_path / "t")
    for n in (3, 5):
        spark.range(n).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id")).alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    one = lambda: spark.readStream.schema("k long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    out = ST.drained(ST.counts(one(), ["k"]), "complete")
    assert sorted(tuple(r) for r in out.collect()) == [(0, 5), (1, 3)] and "FileScan" in plan(out)
    state = str(tmp_path / "state")
    first = lambda: ST.drained(ST.first_of(one(), "ts", ["k"], "1 day"), "append", state)
    assert sorted(r["k"] for r in first().collect()) == [0, 1] and first().count() == 0


def test_contamination_spells_out_few_places(spark):
    from seqspark.plans.joins import j08

    words = [f"w{i}" for i in range(40)]
    item = " ".join(words[:20])
    texts = [item, f"x  {item}\t{item} y", " ".join([*words[:12], "z"]), " ".join([*words[:4], "z", *words[5:20]]), " ".join(words[8:40]), "", None, " ".join(words[:13]), " ".join(words[:13])]
    docs = spark.createDataFrame([(min(i, 7), s) for i, s in enumerate(texts)], "doc_id long, text string")
    out = j08(SimpleNamespace(documents=docs, benchmark=spark.createDataFrame([(1, item), (2, item), (3, "w1"), (4, None)], "item_id long, text string")))
    assert sorted(tuple(r) for r in out.collect()) == [(0, 8), (1, 8), (3, 3), (7, 1)]
    assert "FileScan" in plan(out) and "array_distinct" not in plan(out)  # places were found and written before texts are spelt out


def test_validity_of_a_set_broadcasts_no_table_that_grows(spark, tmp_path, monkeypatch):
    from seqspark.operators import graphs
    from seqspark.plans import joins

    plans, settled = [], graphs.settled
    monkeypatch.setattr(graphs, "settled", lambda df: plans.append(plan(df)) or settled(df))
    spark.range(2000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path) + "/part.parquet")
    out = joins.QUERIES["g05_validity"](spark, str(tmp_path))
    assert [(r["vertices"], r["conflicts"], r["left_out"]) for r in out.collect()] == [(2000, 0, 0)]
    assert len(plans) > 3 and all("BroadcastHashJoin" not in p for p in [*plans, plan(out)])


def test_lookup_finds_empty_strings_and_knows_what_has_no_label(spark):
    words = ["".join(w) for n in range(5) for w in itertools.product("AB", repeat=n)]
    d = lambda x, y: len(x) + len(y) if not x or not y else min(d(x[1:], y) + 1, d(x, y[1:]) + 1, d(x[1:], y[1:]) + (x[0] != y[0]))
    for known in ([("e", "")], [("e", ""), ("f", "ABAB")], [(None, "AAA"), ("g", "AAAA")], [(None, ""), ("g", "")]):
        out = fuzzy.best_match(spark.createDataFrame(list(enumerate(words)), "id long, q string"), spark.createDataFrame(known, "label string, s string"), "id", "q", "label", "s", 2)
        want = []
        for i, q in enumerate(words):
            near = [(d(q, s), label) for label, s in known if d(q, s) <= 2]
            least = min((n for n, _ in near), default=None)
            labels = {label for n, label in near if n == least} - {None}
            if len(labels) == 1:
                want.append((i, labels.pop(), least))
        assert sorted(tuple(r) for r in out.collect()) == want, known


def test_made_parts_bear_the_keys_of_suppliers(spark):
    from seqspark.plans.reading import d10

    t = SimpleNamespace(spark=spark, part=spark.range(30).withColumnRenamed("id", "p_partkey"), supplier=spark.range(0, 700, 100).withColumnRenamed("id", "s_suppkey"))
    assert sorted(tuple(r) for r in d10(t).collect()) == [(i, 30, True, 0, 0) for i in range(0, 700, 100)]


def test_hot_kmers_meet_in_blocks(spark, monkeypatch):
    from seqspark.operators import kmers

    monkeypatch.setattr(kmers, "_AT_ONCE", 50)
    rng = random.Random(5)
    held = sorted({(v, "ACG" + rng.choice("ACGTN") + rng.choice("ACGT")) for v in range(90) for _ in range(4)} | {(v, "TTTTT") for v in range(0, 90, 2)} | {(v, "AAAAA") for v in range(80)})
    df = spark.createDataFrame([(f"v{v:03}", k) for v, k in held] + [(None, "AAAAA"), ("w", "GGGGG")], "id string, kmer string")
    own = {f"v{v:03}": {k for u, k in held if u == v} for v in range(90)}
    known = sorted((x, y, n) for x, y in itertools.combinations(sorted(own), 2) if (n := len(own[x] & own[y])))
    for meeting in (7, 4096):
        out = kmers.shared_pairs(df, "id", meeting)
        assert sorted(tuple(r) for r in out.collect()) == known
    assert "array_intersect" not in plan(out) and "BroadcastHashJoin" not in plan(out)


def test_edges_are_made_by_groups_and_leave_out_parts_with_repeats(spark):
    from collections import defaultdict
    from hashlib import md5

    from seqspark.plans.joins import g01

    out = g01(SimpleNamespace(part=spark.range(3000).withColumnRenamed("id", "p_partkey")))
    held = defaultdict(set)
    for v in range(3000):
        s = md5(str(v).encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGT" * 4))
        own = [min(x, x.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for x in (s[i : i + 10] for i in range(23))]
        for x in own if len(set(own)) == 23 else []:
            held[x].add(v)
    known = {p for g in held.values() for p in itertools.combinations(sorted(g), 2)}
    assert len(known) > 100 and sorted(tuple(r) for r in out.collect()) == sorted(known)
    assert "MapInArrow" in plan(out) and "array_intersect" not in plan(out)
