"""A pipeline over documents: language, near-duplicates, secrets, mixture, tokens. Each stage calls one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from seqspark.llm.bpe import encode, tokenizer_path
from seqspark.llm.common import settle, table
from seqspark.llm.jaccard import jaccard_components
from seqspark.llm.langid import UNKNOWN, identify
from seqspark.llm.mixing import mix
from seqspark.llm.secrets import fresh, redact, scan

#: Mean probability of the best language under which a document's language counts as not known.
LEAST_SCORE = 0.3
#: Words that a Python worker remembers while it encodes: few, as its executor has been through four stages.
WORKER_WORDS = 80_000


# Every stage keeps the columns of documents and any others, whatever their names, and gives no rows for an empty table.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) and those whose language isn't clear. Repeated rows fare alike."""
    out = identify(docs, keep=docs.columns).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return out.select(*[F.col(f"keep_{c}").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component, once; rows without id stay. Of rows
    with one id that with the least hash of its text stays, then the least of the other columns. Near copies share 80 % of their
    five-word shingles; three words and 90 % bind only the query op9_jaccard."""
    kept = jaccard_components(docs, k=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    rank = fresh(docs, "rank")
    order = [F.xxhash64("text"), "text", *(f.name for f in docs.schema.fields if f.name != "text" and not isinstance(f.dataType, MapType))]
    one = docs.join(kept, "doc_id", "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    return one.where(F.col(rank) == 1).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; all rows stay, null texts as they are."""
    spans = fresh(docs, "spans")
    found = scan(docs, out=spans)
    clean = found.withColumn("text", redact(F.col("text"), F.col(spans)))
    return clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says; rows without id are taken once, rows with one id alike."""
    copies, copy = fresh(docs, "copies"), fresh(docs, "copy")
    taken = mix(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").alias(copies))
    often = docs.join(taken, "doc_id", "left").withColumn(copies, F.coalesce(copies, F.lit(1)).cast("int"))
    return often.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text (none for null), and digests of ids and decoded text; all rows stay."""
    return encode(docs, tokenizer_path(), decoded=False, most_words=WORKER_WORDS).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]
#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
