"""Queries of whole jobs: read counting, streams, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import folding, learning, reads, search, statistics
from ..streaming import counts as ST
from .base import Group, spread

group = Group()
query = group.query

_TEXT = "translate(md5(CAST({} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_READ = f"CASE WHEN l_linenumber % 4 = 0 THEN reverse(translate(f, 'ACGT', 'TGCA')) WHEN l_linenumber % 4 = 3 THEN substr(f, 1, 20) ELSE f END"
_READS = f"WITH b AS (SELECT s_suppkey AS id, substr({_TEXT.format('s_suppkey')}, 1, 12) AS barcode FROM supplier), f AS (SELECT l_linenumber, 'AACCGGTTAC' || substr({_TEXT.format('l_suppkey + (l_linenumber = 5)::INT * 1000000')}, 1, 12) || 'TTGGCCAATG' AS f FROM lineitem), r AS (SELECT {_READ} AS s FROM f), p AS (SELECT s, count(*) AS freq FROM r GROUP BY 1), o AS (SELECT freq, CASE WHEN contains(s, 'AACCGGTTAC') AND NOT contains(reverse(translate(s, 'ACGT', 'TGCA')), 'AACCGGTTAC') THEN s WHEN contains(reverse(translate(s, 'ACGT', 'TGCA')), 'AACCGGTTAC') AND NOT contains(s, 'AACCGGTTAC') THEN reverse(translate(s, 'ACGT', 'TGCA')) END AS t FROM p), c AS (SELECT freq, t, CASE WHEN contains(t, 'AACCGGTTAC') AND contains(substr(t, 11), 'TTGGCCAATG') THEN split_part(substr(t, 11), 'TTGGCCAATG', 1) END AS barcode FROM o), m AS (SELECT * FROM c LEFT JOIN b USING (barcode))"


def barcoded(t):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.substring(S.derived_dna(F.col("s_suppkey")), 1, 12).alias("barcode"))
    key = F.col("l_suppkey") + F.when(F.col("l_linenumber") == 5, 1000000).otherwise(0)
    f = F.concat(F.lit("AACCGGTTAC"), F.substring(S.derived_dna(key), 1, 12), F.lit("TTGGCCAATG"))
    n = F.col("l_linenumber") % 4
    rows = t.lineitem.select("l_linenumber", f.alias("f")).select(F.when(n == 0, S.reverse_complement(F.col("f"))).when(n == 3, F.substring("f", 1, 20)).otherwise(F.col("f")).alias("s"))
    return reads.counted(reads.packed(rows, "s", 10)[0], s, "AACCGGTTAC", "AACCGGTTAC", "TTGGCCAATG")


@query("s_read_pipeline", _READS + " SELECT coalesce(CAST(id AS VARCHAR), '-') AS id, sum(freq)::BIGINT AS n FROM m WHERE barcode IS NOT NULL GROUP BY 1")
def read_pipeline(t):
    return barcoded(t)[0]


@query("s_read_outcomes", _READS + " SELECT CASE WHEN t IS NULL THEN 'no anchor' WHEN barcode IS NULL THEN 'no barcode' WHEN id IS NULL THEN 'not mapped' ELSE 'counted' END AS outcome, sum(freq)::BIGINT AS n FROM m GROUP BY 1")
def read_outcomes(t):
    return barcoded(t)[1]


@query("st_counts", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_counts(t):
    return ST.drained(ST.counts(ST.stream(t.spark, f"{t.folder}/events.parquet"), ["user_id", "event_type"]), "complete")


@query("st_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_tumbling(t):
    out = ST.drained(ST.tumbling(ST.stream(t.spark, f"{t.folder}/events.parquet"), "ts", "1 day", ["event_type"]), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st_session", "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '6 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS \"end\", count(*) AS n FROM r GROUP BY user_id, s")
def st_session(t):
    out = ST.drained(ST.sessions(ST.stream(t.spark, f"{t.folder}/events.parquet"), "ts", "6 hours", "user_id", "30 days"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("st_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def st_dedup(t):
    events = ST.stream(t.spark, f"{t.folder}/events.parquet")
    return ST.drained(ST.first_of(events, "ts", ["user_id", "event_type"], "60 days"), "append").agg(F.count(F.lit(1)).alias("n"))


def features(t):
    d = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), S.share_of(F.col("text"), "#*$%&|<>").alias("symbols"), S.share_of(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"))
    return d.join(t.labels, "doc_id").select("doc_id", "n_chars", F.coalesce("symbols", F.lit(0.0)).alias("symbols"), F.coalesce("upper", F.lit(0.0)).alias("upper"), F.col("quality").cast("double").alias("quality"))


_NAMES = ["n_chars", "symbols", "upper"]


@query("l01_forest")
def l01(t):
    return learning.out_of_fold(features(t), "doc_id", lambda train, rest: learning.chance(learning.forest(train, _NAMES, "quality"), rest, ["doc_id"]))


@query("l02_contributions")
def l02(t):
    return learning.out_of_fold(features(t), "doc_id", lambda train, rest: learning.contributions(learning.forest(train, _NAMES, "quality"), rest, "doc_id", _NAMES))


@query("l07_boosted_chain")
def l07(t):
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("name"), "p_retailprice", (F.col("p_size") % 7).cast("double").alias("mid"))
    use = lambda train, rest: learning.boosted_chain(train, rest, ["size", "name"], ["mid"], "p_retailprice").select("p_partkey", "guess_mid", "prediction")
    return learning.out_of_fold(rows, "p_partkey", use)


@query("l08_one_hot")
def l08(t):
    from pyspark.ml.functions import vector_to_array

    out = learning.one_hot(t.part.select("p_partkey", "p_brand"), ["p_brand"])
    return out.select("p_partkey", "p_brand", F.array_max(vector_to_array("p_brand_hot")).alias("hot"))


@query("l12_classifier_report")
def l12(t):
    p = learning.out_of_fold(features(t), "doc_id", lambda train, rest: learning.chance(learning.forest(train, _NAMES, "quality"), rest, ["doc_id", "quality"]))
    scores = statistics.confusion_scores(p, F.col("quality") == 1, F.col("prediction") == 1)
    return scores.crossJoin(statistics.roc(p, "chance", F.col("quality") == 1))


def dna(t):
    return spread(t.part.select("p_partkey")).select("p_partkey", S.derived_dna(F.col("p_partkey")).alias("Variant"))


@query("n08_windowed_folding")
def n08(t):
    folds = folding.folded(dna(t), "p_partkey", "Variant", window=20, step=4)
    return folding.hairpin_flags(folds, "p_partkey", stems=(3, 5, 7), energies=(-8.0, -12.0, -16.0))


@query("d02_primers")
def d02(t):
    return search.primers(t.spark, "N" * 20, (45.0, 60.0), ["GAATTC", "GGTCTC"])


@query("d09_design")
def d09(t):
    spec = {"variants": {}, "motifs": {"motif": "GAATTC"}, "primers": {"constraint": "N" * 20, "melting": (40.0, 65.0)}, "spacers": {"limit": 80, "excluded": ["GAATTC"]}, "split": {"size": 50, "overlap": 20}, "pad": {"left": "GGTCTC", "right": "GAGACC", "size": 70}}
    df, _ = search.design_table(dna(t), "p_partkey", spec)
    return df.select("p_partkey", "Oligo", "OligoLength", F.transform("Fragments", lambda x: x["piece"]).alias("pieces"), "Padded")


@query("d12_evolved_arrays")
def d12(t):
    best = search.evolve(t.spark, lambda g: (float(sum(g)), float(-len(set(g)))), 6, 8, size=10, rounds=3)
    return t.spark.createDataFrame([(g, list(v)) for g, v in best], "genes array<int>, objectives array<double>")


@query("l05_permutation_importance")
def l05(t):
    train, rest = learning.folds(features(t), "doc_id")[0]
    return t.spark.createDataFrame(learning.permutation_importance(learning.forest(train, _NAMES, "quality", 5, 4), rest, _NAMES, "quality"), "feature string, loss double")


QUERIES, ORACLE = group.queries, group.sql
