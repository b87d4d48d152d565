"""Queries of filters, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import filters as P
from ..operators import windows as N
from .base import Group

group = Group()
query = group.query

DNA = "translate(md5(CAST({} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
MOTIFS = ["ACGT", "GGCC", "TTAA"]
LISTED = "(" + ", ".join(f"'{m}'" for m in MOTIFS) + ")"
FLAGS = {"l_returnflag": ["A", "R"], "l_linestatus": ["F"]}


@query("f01_inlist_filter", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus IN ('F') GROUP BY 1, 2")
def f01(t):
    return P.in_lists(t.lineitem, FLAGS).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("f02_antifilter", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE NOT (l_returnflag IN ('A', 'R') AND l_linestatus IN ('F')) GROUP BY 1, 2")
def f02(t):
    return P.not_in_lists(t.lineitem, FLAGS).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("f03_ordered_lookup", "SELECT k.place::BIGINT AS place, k.n_name, n.n_nationkey FROM (VALUES (0, 'FRANCE'), (1, 'NOWHERE'), (2, 'BRAZIL'), (3, 'FRANCE')) k(place, n_name) LEFT JOIN nation n USING (n_name)")
def f03(t):
    keys = t.spark.createDataFrame([(0, "FRANCE"), (1, "NOWHERE"), (2, "BRAZIL"), (3, "FRANCE")], "place long, n_name string")
    return P.ordered_lookup(keys, t.nation, ["n_name"]).select("place", "n_name", "n_nationkey")


@query("f04_checked_filter", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def f04(t):
    return P.checked_lists(t.orders, {"o_orderstatus": ["F", "O"]}).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("f05_disjunctive_quality", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE NOT (l_quantity < 5 OR l_discount > 0.08 OR l_tax > 0.06 OR l_extendedprice < 1000)")
def f05(t):
    kept = P.drop_if_any(t.lineitem, F.col("l_quantity") < 5, F.col("l_discount") > 0.08, F.col("l_tax") > 0.06, F.col("l_extendedprice") < 1000)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("f06_numeric_coercion", "SELECT event_type, count(*) AS n, count(x) AS numeric FROM (SELECT event_type, TRY_CAST(regexp_extract(props, '([0-9]+)') AS BIGINT) AS x FROM events) GROUP BY 1")
def f06(t):
    x = F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS bigint)")
    return t.events.select("event_type", x.alias("x")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("numeric"))


@query("f07_invalid_mask", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount IS NULL OR isnan(l_discount) OR isinf(l_discount) OR l_discount = 0) AS invalid FROM lineitem GROUP BY 1")
def f07(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(P.invalid_number(F.col("l_discount")).cast("long")).alias("invalid"))


@query("f09_nonzero_columns", "SELECT sum(l_quantity)::BIGINT AS l_quantity, count(*) AS n FROM lineitem")
def f09(t):
    rows = t.lineitem.withColumn("zero", F.lit(0.0))
    kept = P.nonzero_columns(rows, ["l_quantity", "zero"])
    return rows.agg(*[F.sum(c).cast("long").alias(c) for c in kept], F.count(F.lit(1)).alias("n"))


@query("f10_derived", "SELECT p_partkey, p_brand || '+' || p_type AS subgroup, length(p_name)::BIGINT AS start_pos, 37.0::DOUBLE AS temp FROM part")
def f10(t):
    return t.part.select("p_partkey", F.concat_ws("+", "p_brand", "p_type").alias("subgroup"), F.length("p_name").cast("long").alias("start_pos"), F.lit(37.0).alias("temp"))


@query("f12_positioned_insert", "SELECT p_partkey, p_name, 'GG' AS spacer, p_brand FROM part")
def f12(t):
    order = P.insert_column(["p_partkey", "p_name", "p_brand"], "spacer", left="p_name")
    return t.part.withColumn("spacer", F.lit("GG")).select(*order)


@query("f13_row_concat", "SELECT p_partkey, replace(p_name || p_brand || p_type, '-', '') AS joined FROM part")
def f13(t):
    return t.part.select("p_partkey", P.row_concat(["p_name", "p_brand", "p_type"]).alias("joined"))


@query("f14_is_dna", f"SELECT p_partkey, regexp_full_match({DNA.format('p_partkey')}, '[-ACGTacgt]*') AS dna, regexp_full_match(p_name, '[-ACGTacgt]*') AS name_dna FROM part")
def f14(t):
    return t.part.select("p_partkey", S.is_dna(S.derived_dna(F.col("p_partkey"))).alias("dna"), S.is_dna(F.col("p_name")).alias("name_dna"))


@query(
    "f15_excluded_motif",
    f"WITH d AS (SELECT o_orderkey, {DNA.format('o_orderkey')} AS s FROM orders) SELECT o_orderkey, len(c)::BIGINT AS n, coalesce(array_to_string(c, ','), '') AS causes FROM (SELECT o_orderkey, list_filter({list(MOTIFS)}, lambda m: contains(s, m)) AS c FROM d)",
)
def f15(t):
    causes = P.motif_conflicts(S.derived_dna(F.col("o_orderkey")), MOTIFS)
    return t.orders.select("o_orderkey", F.size(causes).cast("long").alias("n"), F.array_join(causes, ",").alias("causes"))


@query(
    "f16_motif_positions",
    f"WITH d AS (SELECT doc_id, text, unnest(['the ', 'de la', 'und']) AS motif FROM documents) SELECT doc_id, motif, len(p)::BIGINT AS n, p[1]::BIGINT AS first, p[len(p)]::BIGINT AS last FROM (SELECT doc_id, motif, list_filter(range(0, length(text) - length(motif) + 1), lambda i: substr(text, i + 1, length(motif)) = motif) AS p FROM d WHERE contains(text, motif))",
)
def f16(t):
    docs = t.documents.select("doc_id", "text", F.explode(F.array(*map(F.lit, ["the ", "de la", "und"]))).alias("motif")).where(F.col("text").contains(F.col("motif")))
    # Matches of these motifs can't overlap, so the pieces between them give the places in one pass.
    return N.split_places(docs, "text", "motif").select("doc_id", "motif", F.size("places").cast("long").alias("n"), F.element_at("places", 1).cast("long").alias("first"), F.element_at("places", -1).cast("long").alias("last"))


@query(
    "f18_edge_effect",
    f"WITH d AS (SELECT p_partkey, {DNA.format('p_partkey')} AS l, {DNA.format('p_partkey + 1')} AS r FROM part) SELECT p_partkey, coalesce(array_to_string(list_filter({list(MOTIFS)}, lambda m: contains(right(l, length(m) - 1) || left(r, length(m) - 1), m)), ','), '') AS motifs FROM d",
)
def f18(t):
    return t.part.select("p_partkey", F.array_join(P.edge_motifs(S.derived_dna(F.col("p_partkey")), S.derived_dna(F.col("p_partkey") + 1), MOTIFS), ",").alias("motifs"))


_READ = f"{DNA.format('l_orderkey')}[1:12]"
_READ = "substr(translate(md5(CAST(l_orderkey AS VARCHAR)), '0123456789abcdef', 'AACCGGTTACGTNNNN'), 1, (4 + l_linenumber * 4)::INT)"
_REASON = f"CASE WHEN length(s) - length(replace(s, 'N', '')) > 5 THEN 'ambiguous' WHEN length(s) < 12 THEN 'short' WHEN len(list_distinct(string_split(s, ''))) < 4 THEN 'ambiguous' ELSE 'ok' END"


def _reads(t):
    s = F.translate(F.md5(F.col("l_orderkey").cast("string").cast("binary")), "0123456789abcdef", "AACCGGTTACGTNNNN")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.substring(s, F.lit(1), (4 + F.col("l_linenumber") * 4).cast("int")).alias("s"))


@query("f20_read_filter", f"WITH r AS (SELECT l_orderkey, l_linenumber, {_READ} AS s FROM lineitem) SELECT l_orderkey, l_linenumber, {_REASON} AS reason FROM r")
def f20(t):
    return _reads(t).select("l_orderkey", "l_linenumber", P.read_filter(F.col("s"), 12, 5).alias("reason"))


@query("a03_reason_counts", f"WITH r AS (SELECT {_READ} AS s FROM lineitem) SELECT {_REASON} AS reason, count(*) AS n, sum(length(s))::BIGINT AS letters FROM r GROUP BY 1")
def a03(t):
    return _reads(t).groupBy(P.read_filter(F.col("s"), 12, 5).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("letters"))


@query("f21_mean_quality", "SELECT o_orderkey, list_avg([ascii(c) for c in string_split(md5(CAST(o_orderkey AS VARCHAR)), '')]) >= 70 AS passes FROM orders")
def f21(t):
    codes = F.transform(F.filter(F.split(F.md5(F.col("o_orderkey").cast("string").cast("binary")), "", -1), lambda c: c != ""), lambda c: F.ascii(c).cast("double"))
    return t.orders.select("o_orderkey", P.mean_quality_passes(codes, 70.0).alias("passes"))


_LOW = "list_sort([length(s) - length(replace(s, c, '')) for c in ['A', 'C', 'G', 'T']])"


@query(
    "f22_low_complexity",
    f"WITH d AS (SELECT c_custkey, left({DNA.format('c_custkey')}, 8) AS s FROM customer), c AS (SELECT c_custkey, length(s) AS n, {_LOW} AS k FROM d) SELECT c_custkey, CASE WHEN k[4] + k[3] >= 0.75 * n THEN 'di' WHEN k[4] >= 0.5 * n THEN 'mono' WHEN k[4] + k[3] + k[2] = n THEN 'tri' ELSE 'none' END AS kind FROM c",
)
def f22(t):
    return t.customer.select("c_custkey", P.low_complexity(F.left(S.derived_dna(F.col("c_custkey")), F.lit(8))).alias("kind"))


@query("f23_gc_range", f"SELECT p_partkey FROM (SELECT p_partkey, {DNA.format('p_partkey')} AS s FROM part) WHERE length(regexp_replace(s, '[^GC]', '', 'g')) / length(s) BETWEEN 0.4 AND 0.6")
def f23(t):
    return t.part.where(P.gc_between(S.derived_dna(F.col("p_partkey")), 0.4, 0.6)).select("p_partkey")


@query("f24_regex_exclusion", f"SELECT p_partkey FROM part WHERE NOT regexp_matches({DNA.format('p_partkey')}, 'A{{3}}|G[AT]G')")
def f24(t):
    return t.part.where(~S.derived_dna(F.col("p_partkey")).rlike("A{3}|G[AT]G")).select("p_partkey")


@query("f25_constraint_legality", "SELECT p_brand, array_to_string(list_sort(list_distinct(list_filter(string_split(p_brand, ''), lambda c: NOT contains('ACGTRYSWKMBVDHN', c)))), '') AS illegal FROM part GROUP BY 1")
def f25(t):
    return t.part.select("p_brand").distinct().select("p_brand", F.array_join(S.illegal_letters(F.col("p_brand")), "").alias("illegal"))


@query(
    "f26_structure_balance",
    "WITH d AS (SELECT c_custkey, translate(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 12), '0123456789abcdef', '(((((.....)))))x') AS s FROM customer), e AS (SELECT c_custkey, s, unnest(range(1, 13)) AS i FROM d), f AS (SELECT c_custkey, i, sum(CASE substr(s, i, 1) WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY c_custkey ORDER BY i) AS d FROM e), g AS (SELECT c_custkey, greatest(0, -min(d)) AS unopened, max(d) FILTER (WHERE i = 12) AS total FROM f GROUP BY 1) SELECT c_custkey, (total + unopened)::BIGINT AS unclosed, unopened::BIGINT AS unopened FROM g",
)
def f26(t):
    s = F.translate(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 12), "0123456789abcdef", "(((((.....)))))x")
    b = S.balance(s)
    return t.customer.select("c_custkey", F.size(b["unclosed"]).cast("long").alias("unclosed"), F.size(b["unopened"]).cast("long").alias("unopened"))


@query("f30_relabel", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS status, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def f30(t):
    rows = t.orders.where(F.col("o_orderpriority") != "5-LOW")
    return rows.groupBy(F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("f31_free_space", "SELECT min(80 - n)::BIGINT AS least, max(80 - n)::BIGINT AS most, count(*) FILTER (WHERE n > 80) AS infeasible FROM (SELECT length(p_name || p_brand || p_type) AS n FROM part)")
def f31(t):
    n = F.length(F.concat("p_name", "p_brand", "p_type"))
    return t.part.select(n.alias("n")).agg((80 - F.max("n")).cast("long").alias("least"), (80 - F.min("n")).cast("long").alias("most"), F.count(F.when(F.col("n") > 80, 1)).alias("infeasible"))


QUERIES, ORACLE = group.queries, group.sql
