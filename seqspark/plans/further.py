"""Queries of files, parts of sequences, ranks and checks that stand alone."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constraints as C
from ..functions import sequences as S
from ..operators import fuzzy, graphs, kmers, reads, rules
from ..operators import scoring as O
from ..operators import windows as W
from ..sources import files
from .base import Group

group = Group()
query = group.query
DNA = "translate(md5(CAST({} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
PART = f"d AS (SELECT p_partkey, {DNA.format('p_partkey')} AS s FROM part)"
MOTIFS = ("GATC", "ACGT", "TTT")
_MOTIFS = "(SELECT unnest(['GATC', 'ACGT', 'TTT']) AS motif)"


def dna(t):
    return t.part.select("p_partkey", S.derived_dna(F.col("p_partkey")).alias("s"))


def motifs(t):
    return t.spark.createDataFrame([(m,) for m in MOTIFS], "motif string")


# Files: written to the shared folder and read back.


@query("s04_fasta_scan", f"SELECT CAST(p_partkey AS VARCHAR) AS name, {DNA.format('p_partkey')} AS seq FROM part")
def s04(t):
    path = files.scratch(t.spark, "fasta")
    files.write_fasta(dna(t).select(F.col("p_partkey").cast("string").alias("name"), F.col("s").alias("seq")), path)
    return files.read_fasta(t.spark, path)


@query("s05_line_scan", "SELECT s_name AS seq FROM supplier")
def s05(t):
    path = files.scratch(t.spark, "lines")
    t.supplier.select("s_name").write.text(path)
    return files.read_lines(t.spark, path)


@query("s07_fastq_scan", f"SELECT CAST(p_partkey AS VARCHAR) AS read_id, {DNA.format('p_partkey')} AS seq, 32 AS n, (40 * 32 - length({DNA.format('p_partkey')}) + length(replace({DNA.format('p_partkey')}, 'G', '')))::BIGINT AS total FROM part")
def s07(t):
    path = files.scratch(t.spark, "fastq")
    quality = F.translate("s", "ACGT", "IIHI")
    dna(t).select(F.concat(F.lit("@"), F.col("p_partkey").cast("string"), F.lit(" 1\n"), "s", F.lit("\n+\n"), quality)).write.text(path)
    got = files.read_fastq(t.spark, path)
    return got.select("read_id", "seq", F.size("qual").alias("n"), F.aggregate("qual", F.lit(0), lambda a, x: a + x).alias("total"))


@query("w08_genbank", f"WITH d AS (SELECT 'N' || n_nationkey AS locus, {DNA.format('n_nationkey')} AS s FROM nation) SELECT locus, 'gene' AS kind, 0 AS \"start\", 10 AS \"end\", '+' AS strand, 'head' AS label, substr(s, 1, 10) AS seq FROM d UNION ALL SELECT locus, 'CDS', 10, 32, '-', 'tail', substr(s, 11) FROM d")
def w08(t):
    path = files.scratch(t.spark, "genbank")
    part = lambda kind, a, b, strand, label: F.struct(F.lit(kind).alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(strand).alias("strand"), F.lit(label).alias("label"))
    rows = t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("locus"), S.derived_dna(F.col("n_nationkey")).alias("seq"), F.array(part("gene", 0, 10, "+", "head"), part("CDS", 10, 32, "-", "tail")).alias("features"))
    files.write_genbank(rows, path)
    return files.read_genbank(t.spark, path)


@query("s01_table_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s01(t):
    path = files.scratch(t.spark, "table") + ".csv"
    files.write_table(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.read_table(t.spark, path, "n_nationkey long, n_name string, n_regionkey long")


@query("s15_zipped_csv", "SELECT r_regionkey, r_name FROM region")
def s15(t):
    path = files.scratch(t.spark, "zipped") + ".csv"
    t.region.select("r_regionkey", "r_name").write.option("header", True).option("compression", "gzip").csv(path)
    return files.read_table(t.spark, path, "r_regionkey long, r_name string")


@query("w02_by_model", "SELECT o_orderpriority AS model, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def w02(t):
    path = files.scratch(t.spark, "models") + ".parquet"
    files.write_table(t.orders.select(F.col("o_orderpriority").alias("model"), "o_orderkey"), path, ["model"])
    return files.read_table(t.spark, path).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("w09_adjacency", "SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem")
def w09(t):
    path = files.scratch(t.spark, "adjacency")
    graphs.dump_adjacency(t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), path)
    return graphs.load_adjacency(t.spark, path)


@query("w10_json", "SELECT n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS json FROM nation")
def w10(t):
    return t.nation.select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("json"))


@query("s12_random_reads", f"SELECT i AS id, {DNA.format(chr(39) + '7:' + chr(39) + ' || i')} AS seq FROM range(500) r(i)")
def s12(t):
    return t.spark.range(500).select("id", S.derived_dna(F.concat(F.lit("7:"), F.col("id").cast("string"))).alias("seq"))


# Columns and texts.


@query("f08_column_subset", "SELECT n_nationkey, n_name FROM nation")
def f08(t):
    names = ("n_nationkey", "n_name", "missing")
    return t.nation.select(*[c for c in names if c in t.nation.columns])


@query("f11_constant_column", "SELECT p_partkey, 'AAGG' AS site FROM part")
def f11(t):
    return t.part.select("p_partkey", F.lit("AAGG").alias("site"))


@query("p02_plain_text", r"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g')) AS plain FROM documents")
def p02(t):
    return t.documents.select("doc_id", F.md5(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "").cast("binary")).alias("plain"))


@query("l11_seeded_stream", "SELECT n_nationkey AS seed, i, ('0x' || substr(md5(n_nationkey || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM nation, range(20) r(i)")
def l11(t):
    rows = t.nation.select(F.col("n_nationkey").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    return rows.withColumn("u", F.conv(F.substring(F.md5(F.concat_ws(":", "seed", "i").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0))


# Motifs, k-mers and sequences.


@query("f17_suffix_motifs", f"WITH {PART} SELECT p_partkey, len(list_filter(range(1, 33), lambda i: " + " OR ".join(f"suffix(substr(s, 1, i), '{m}')" for m in MOTIFS) + "))::BIGINT AS n FROM d")
def f17(t):
    ends = lambda i: F.array_contains(F.transform(F.array(*[F.lit(m) for m in MOTIFS]), lambda m: F.endswith(F.substring("s", F.lit(1), i), m)), True)
    return dna(t).select("p_partkey", F.size(F.filter(F.sequence(F.lit(1), F.length("s")), ends)).alias("n"))


@query("f19_edge_effects", f"WITH {PART}, m AS (SELECT motif, unnest(range(1, length(motif))) AS j FROM {_MOTIFS}) SELECT p_partkey, motif, j::BIGINT AS j, substr(motif, j + 1) AS forbidden FROM d JOIN m ON right(s, j) = left(motif, j)")
def f19(t):
    cut = motifs(t).select("motif", F.explode(F.sequence(F.lit(1), F.length("motif") - 1)).alias("j"))
    cut = cut.select("motif", "j", F.left("motif", F.col("j")).alias("end"), F.substring("motif", F.col("j") + 1, F.length("motif")).alias("forbidden"))
    ends = dna(t).select("p_partkey", F.explode(F.array(*[F.right("s", F.lit(j)) for j in range(1, max(map(len, MOTIFS)))])).alias("end"))
    return ends.join(cut, "end").select("p_partkey", "motif", "j", "forbidden")


@query("j15_pattern_places", f"WITH {PART}, h AS (SELECT p_partkey, motif, s, unnest(range(0, 33 - length(motif))) AS place FROM d, {_MOTIFS}) SELECT p_partkey, motif, place::BIGINT AS place FROM h WHERE substr(s, place + 1, length(motif)) = motif")
def j15(t):
    each = dna(t).select("p_partkey", F.explode(F.array(*[F.struct(F.lit(m).alias("motif"), S.places(F.col("s"), F.lit(m)).alias("places")) for m in MOTIFS])).alias("x"))
    return each.select("p_partkey", "x.motif", F.explode("x.places").alias("place"))


@query("k01_kmer_stream", f"WITH {PART} SELECT p_partkey, i::BIGINT AS at, substr(s, i + 1, 9) AS kmer FROM (SELECT *, unnest(range(24)) AS i FROM d)")
def k01(t):
    return dna(t).select("p_partkey", F.posexplode(S.kmers(F.col("s"), 9)).alias("at", "kmer"))


@query("u05_distinct_background", f"WITH {PART} SELECT DISTINCT substr(s, i + 1, 7) AS kmer FROM (SELECT *, unnest(range(26)) AS i FROM d)")
def u05(t):
    return kmers.background(kmers.exploded(dna(t), "p_partkey", F.col("s"), 7))


@query("k09_blocked", f"SELECT s_nationkey, count(DISTINCT substr({DNA.format('s_suppkey')}, 1, 1)) = 4 AS blocked FROM supplier GROUP BY 1")
def k09(t):
    return t.supplier.groupBy("s_nationkey").agg(F.collect_set(F.left(S.derived_dna(F.col("s_suppkey")), F.lit(1))).alias("x")).select("s_nationkey", C.blocked(F.col("x")).alias("blocked"))


@query("k29_oriented", f"WITH {PART}, r AS (SELECT *, reverse(translate(s, 'ACGT', 'TGCA')) AS b FROM d) SELECT p_partkey, CASE WHEN contains(s, 'GATTA') AND NOT contains(b, 'GATTA') THEN s WHEN contains(b, 'GATTA') AND NOT contains(s, 'GATTA') THEN b END AS read FROM r")
def k29(t):
    return dna(t).select("p_partkey", reads.oriented(F.col("s"), "GATTA").alias("read"))


@query("k33_between", f"WITH {PART}, a AS (SELECT p_partkey, s, CASE WHEN contains(s, 'AC') THEN list_last(string_split(s, 'AC')) END AS r FROM d) SELECT p_partkey, CASE WHEN contains(r, 'T') THEN string_split(r, 'T')[1] END AS barcode FROM a")
def k33(t):
    return dna(t).select("p_partkey", reads.between(F.col("s"), "AC", "T").alias("barcode"))


@query("k34_associates", f"WITH {PART} SELECT p_partkey, contains(s, left({DNA.format('p_partkey % 97')}, 3)) AS matched FROM d")
def k34(t):
    known = dna(t).withColumn("a", F.left(S.derived_dna(F.col("p_partkey") % 97), F.lit(3)))
    return fuzzy.associate_matches(known, "s", "a", 0).select("p_partkey", "matched")


@query("k37_adjusted_structure", "SELECT p_partkey, rpad(repeat('.', p_size % 20), 16, 'x') AS spec FROM part")
def k37(t):
    return t.part.select("p_partkey", F.rpad(F.expr("repeat('.', CAST(p_size % 20 AS INT))"), 16, "x").alias("spec"))


@query("x01_corpus", f"WITH d AS (SELECT n_nationkey AS k, {DNA.format('n_nationkey')} AS s FROM nation), p AS (SELECT DISTINCT k, substr(s, i + 1, n) AS piece FROM d, range(4, 7) a(n), range(0, 29) b(i) WHERE i + n <= 32) SELECT piece, CASE WHEN count(*) = 1 THEN min(k) END AS label FROM p GROUP BY 1")
def x01(t):
    return fuzzy.substring_corpus(t.nation.select(F.col("n_nationkey").alias("label"), S.derived_dna(F.col("n_nationkey")).alias("s")), "label", "s", 4, 6)


@query("m01_gc_content", f"WITH {PART} SELECT p_partkey, (32 - length(regexp_replace(s, '[GC]', '', 'g'))) / 32.0::DOUBLE AS gc, (32 - length(regexp_replace(s, '[AT]', '', 'g'))) / 32.0::DOUBLE AS at FROM d")
def m01(t):
    return dna(t).select("p_partkey", S.gc_content(F.col("s")).alias("gc"), S.share_of(F.col("s"), "AT").alias("at"))


_RUNS = "|".join(f"{c}{{{n},}}" for c, n in (("A", 4), ("C", 3), ("G", 3), ("T", 4)))


@query("r02_interior_runs", f"WITH {PART} SELECT p_partkey, regexp_matches(substr(s, 2, 30), '{_RUNS}') AS hit FROM d")
def r02(t):
    return dna(t).select("p_partkey", rules.blacklisted_run(F.col("s"), {"A": 3, "C": 2, "G": 2, "T": 3}).alias("hit"))


@query("r08_lumped_score", f"WITH {PART}, f AS (SELECT p_partkey, length(s) - length(regexp_replace(s, '[GC]', '', 'g')) > 18 AS gc, regexp_matches(substr(s, 2, 30), '{_RUNS}') AS run, contains(s, 'GATC') AS site FROM d) SELECT p_partkey, gc::INT + 2 * run::INT + 4 * site::INT AS score, array_to_string(list_filter([CASE WHEN gc THEN 'gc' END, CASE WHEN run THEN 'run' END, CASE WHEN site THEN 'site' END], lambda x: x IS NOT NULL), ';') AS flags FROM f")
def r08(t):
    s = F.col("s")
    flags = {"gc": S.gc_content(s) > 18 / 32, "run": rules.blacklisted_run(s, {"A": 3, "C": 2, "G": 2, "T": 3}), "site": s.contains("GATC")}
    score = sum((c.cast("int") * 2**i for i, c in enumerate(flags.values())), F.lit(0))
    return dna(t).select("p_partkey", score.alias("score"), F.concat_ws(";", *[F.when(c, n) for n, c in flags.items()]).alias("flags"))


# Ranks, containers and scales.


@query("n13_average_ranks", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) + (count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) - 1) / 2.0::DOUBLE AS r FROM customer")
def n13(t):
    return t.customer.select("c_custkey", W.average_rank("c_mktsegment", ["c_nationkey"]).alias("r"))


@query("t06_min_with_index", "SELECT p_brand, p_retailprice, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part) WHERE r = 1")
def t06(t):
    return W.argmin(t.part, ["p_brand"], "p_retailprice", ["p_partkey"])


@query("u02_vertical_concat", "SELECT 'c' AS kind, c_custkey AS k, c_mktsegment AS segment FROM customer UNION ALL SELECT 's', s_suppkey, NULL FROM supplier")
def u02(t):
    return files.append(t.customer.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), t.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("k")))


@query("u03_containers", "SELECT 'both' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'left', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def u03(t):
    both = t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()
    left = t.customer.select(F.col("c_custkey").alias("k")).exceptAll(t.orders.select(F.col("o_custkey").alias("k")).distinct())
    return both.select(F.lit("both").alias("op"), "k").unionByName(left.select(F.lit("left").alias("op"), "k"))


@query("m06_rates", "SELECT p_partkey, round(2.5 * exp(-0.05 * p_size), 9) AS rate FROM part")
def m06(t):
    return t.part.select("p_partkey", F.round(O.rate(F.col("p_size"), 2.5, 0.05), 9).alias("rate"))


@query("m12_success", "SELECT p_brand, (count(*) FILTER (WHERE p_size < 25) + 1) / (count(*) + 2)::DOUBLE AS p, (2 * ceil(ln(0.01) / ln(1 - (count(*) FILTER (WHERE p_size < 25) + 1) / (count(*) + 2)::DOUBLE)))::BIGINT AS retries FROM part GROUP BY 1")
def m12(t):
    got = t.part.groupBy("p_brand").agg(((F.count(F.when(F.col("p_size") < 25, 1)) + 1) / (F.count(F.lit(1)) + 2)).alias("p"))
    return got.select("p_brand", "p", (2 * F.ceil(F.log(F.lit(0.01)) / F.log(1 - F.col("p")))).cast("long").alias("retries"))


@query("m15_scales", "SELECT p_partkey, round(log10(p_retailprice), 9) AS lg, round(ln(p_retailprice), 9) AS ln, round(ln(2) / p_size, 9) AS half_life, round(pow(10, p_size / 10.0), 6) AS back FROM part")
def m15(t):
    return t.part.select("p_partkey", F.round(F.log10("p_retailprice"), 9).alias("lg"), F.round(F.log("p_retailprice"), 9).alias("ln"), F.round(F.log(F.lit(2.0)) / F.col("p_size"), 9).alias("half_life"), F.round(F.pow(F.lit(10.0), F.col("p_size") / 10), 6).alias("back"))


@query("g06_pendants", "WITH e AS (SELECT DISTINCT o_custkey AS a, -1 - (o_orderkey % 1500) AS b FROM orders), v AS (SELECT a AS v, b AS w FROM e UNION ALL SELECT b, a FROM e), p AS (SELECT v, min(w) AS w FROM v GROUP BY 1 HAVING count(*) = 1) SELECT v, w AS neighbour FROM p")
def g06(t):
    return graphs.pendants(t.orders.select(F.col("o_custkey").alias("a"), (-1 - F.col("o_orderkey") % 1500).alias("b")))


@query("g04_complete_groups", "WITH r AS (SELECT DISTINCT s_nationkey AS g, s_suppkey % 5 AS v FROM supplier), e AS (SELECT x.g, count(*) AS m FROM r x JOIN r y ON x.g = y.g AND x.v < y.v AND (x.v + y.v) % 3 <> 0 GROUP BY 1), n AS (SELECT g, count(*) AS n FROM r GROUP BY 1) SELECT n.g AS s_nationkey, n, coalesce(m, 0) AS m, coalesce(m, 0) = n * (n - 1) // 2 AS complete, coalesce(m, 0) = 0 AS empty FROM n LEFT JOIN e USING (g)")
def g04(t):
    v = t.supplier.select(F.col("s_nationkey").alias("g"), (F.col("s_suppkey") % 5).alias("v")).distinct()
    # Five vertices a group at most, so pairs are few.
    e = v.join(v.withColumnRenamed("v", "w"), "g").where("v < w AND (v + w) % 3 <> 0").select("g", F.col("v").alias("a"), F.col("w").alias("b"))
    return graphs.completeness(v, e, "g").withColumnRenamed("g", "s_nationkey")


@query("l12_learning_curve", "WITH h AS (SELECT l_extendedprice AS y, l_quantity AS x, ('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 2))::INT AS h FROM lineitem), f AS (SELECT k, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, count(*) AS n FROM h, (SELECT unnest([12, 24, 48, 96, 192]) AS k) WHERE h < k GROUP BY k) SELECT k, n, round(sqrt(avg((y - a * x - b) * (y - a * x - b))), 3) AS rmse FROM h, f WHERE h >= 192 GROUP BY k, n")
def l12(t):
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber").cast("binary")), 1, 2), 16, 10).cast("int")
    rows = t.lineitem.select(F.col("l_extendedprice").cast("double").alias("y"), F.col("l_quantity").cast("double").alias("x"), h.alias("h"))
    sizes = F.array(*[F.lit(k) for k in (12, 24, 48, 96, 192)])
    learnt = rows.select("y", "x", F.explode(F.filter(sizes, lambda k: F.col("h") < k)).alias("k"))
    fits = learnt.groupBy("k").agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.count(F.lit(1)).alias("n"))
    miss = F.col("y") - F.col("a") * F.col("x") - F.col("b")
    asked = rows.where("h >= 192").withColumn("k", F.explode(sizes)).join(F.broadcast(fits), "k")  # five fits
    return asked.groupBy("k", "n").agg(F.round(F.sqrt(F.avg(miss * miss)), 3).alias("rmse"))


@query("t08_seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':7'), o_orderkey LIMIT 100")
def t08(t):
    return t.orders.orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":7")).cast("binary")), "o_orderkey").limit(100).select("o_orderkey")


QUERIES, ORACLE = group.queries, group.sql
