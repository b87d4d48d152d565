"""Sources and sinks of sequence files: FASTA, lines, FASTQ, GenBank, CSV, archives of parquet."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Only a session on one machine may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="seqspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/seqspark/{tag}-{uuid.uuid4().hex}"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): records are split at '>' by the reader, so a file is read in splits; sequence lines are joined."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    lines = F.split("value", "\r?\n", -1)
    return raw.select(F.trim(F.element_at(lines, 1)).alias("name"), F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), "").alias("seq"))


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq): one sequence a line, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("seq")).where("seq <> ''")


def fastq_records(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    it = iter(lines)
    for head in it:
        if not head:
            continue
        try:
            seq, plus, qual = next(it), next(it), next(it)
        except StopIteration:
            raise ValueError("the file ends within a record") from None
        if head[0] != "@" or plus[:1] != "+" or len(seq) != len(qual):
            raise ValueError(f"not a FASTQ record: {head[:40]}")
        yield head[1:].split(" ", 1)[0], seq, qual


def read_fastq(spark: SparkSession, path: str, invert: bool = False) -> DataFrame:
    """(read_id, seq, qual, file), qual being Phred scores. A task takes whole files, since records can't be told apart in the middle
    of one; compressed files can't be split anyway. Files are streamed, not loaded. invert gives the other strand."""
    import gzip

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    table = str.maketrans("ACGTN", "TGCAN")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for name in (p for b in batches for p in b["path"]):
            system, inner = fs.FileSystem.from_uri(name)
            with system.open_input_stream(inner, compression=None) as raw, gzip.open(raw, "rt") if name.endswith(".gz") else __import__("io").TextIOWrapper(raw) as text:
                rows = []
                for read_id, seq, qual in fastq_records(line.rstrip("\r\n") for line in text):
                    scores = [ord(c) - 33 for c in qual]
                    rows.append((read_id, seq.translate(table)[::-1], scores[::-1], name) if invert else (read_id, seq, scores, name))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["read_id", "seq", "qual", "file"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["read_id", "seq", "qual", "file"])

    return files.select("path").mapInPandas(run, "read_id string, seq string, qual array<int>, file string")


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by read id, never by position: (read_id, r1, q1, r2, q2)."""
    a = first.select("read_id", F.col("seq").alias("r1"), F.col("qual").alias("q1"))
    return a.join(second.select("read_id", F.col("seq").alias("r2"), F.col("qual").alias("q2")), "read_id")


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(locus, kind, start, end, strand, label, seq): features of GenBank files with 0-based half-open places."""
    import re

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for content in (c for b in batches for c in b["content"]):
            rows = []
            for entry in bytes(content).decode("utf-8", "replace").split("\n//"):
                locus = re.search(r"^LOCUS\s+(\S+)", entry, re.M)
                if not locus:
                    continue
                seq = "".join(re.findall("[a-zA-Z]+", entry.split("\nORIGIN", 1)[-1].split("\n", 1)[-1])) if "\nORIGIN" in entry else ""
                part = entry.split("\nFEATURES", 1)[-1].split("\nORIGIN", 1)[0]
                for m in re.finditer(r"^ {5}(\S+)\s+(complement\()?<?(\d+)\.\.>?(\d+)\)?\n((?: {21}.*\n?)*)", part, re.M):
                    label = re.search(r"/label=\"?([^\"\n]+)", m[5])
                    a, b = int(m[3]) - 1, int(m[4])
                    rows.append((locus[1], m[1], a, b, "-" if m[2] else "+", label[1] if label else None, seq[a:b].upper()))
            yield pd.DataFrame(rows, columns=["locus", "kind", "start", "end", "strand", "label", "seq"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "locus string, kind string, start long, end long, strand string, label string, seq string")


def write_genbank(df: DataFrame, path: str, locus: str = "locus", seq: str = "seq", features: str = "features") -> None:
    """GenBank entries of rows with an array of features (kind, start, end, strand, label), places being 0-based and half-open."""
    place = lambda f: F.concat((f["start"] + 1).cast("string"), F.lit(".."), f["end"].cast("string"))
    where = lambda f: F.when(f["strand"] == "-", F.concat(F.lit("complement("), place(f), F.lit(")"))).otherwise(place(f))
    entry = lambda f: F.concat(F.lit(" " * 5), F.rpad(f["kind"], 16, " "), where(f), F.lit("\n" + " " * 21 + '/label="'), f["label"], F.lit('"\n'))
    head = F.concat(F.lit("LOCUS       "), F.col(locus), F.lit("\nFEATURES             Location/Qualifiers\n"))
    df.select(F.concat(head, F.array_join(F.transform(features, entry), ""), F.lit("ORIGIN\n        1 "), F.lower(seq), F.lit("\n//")).alias("value")).write.text(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV or parquet, by suffix; anything else is refused."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    raise ValueError(f"can't read .{kind}")


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """CSV or parquet, by suffix, in folders by columns if asked for."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    writer = df.write.partitionBy(*by) if by else df.write
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"can't write .{kind}")


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def line_numbers(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Adds line, 0-based within each group by."""
    return df.withColumn("line", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
