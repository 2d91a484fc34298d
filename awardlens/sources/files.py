"""File sources and sinks: columnar, CSV, JSON documents and lines, the latest of several files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardlens.operators.order import numbered
from pyspark.sql.types import StructType

from awardlens.functions import text as fn
from awardlens.functions.text import column_variant

#: Header variants of the procurement export; the first that a file has counts.
HEADERS = {
    "reference_number": ["reference number", "reference no", "ref no", "refno", "reference_number"],
    "title": ["title", "project title", "procurement title", "description"],
    "procuring_entity": ["procuring entity", "agency", "pe", "procuring_entity"],
    "contractor_name": ["contractor", "awardee", "winning bidder", "supplier", "awarded_to"],
    "amount": ["amount", "contract amount", "approved budget", "abc", "bid amount"],
    "procurement_method": ["procurement method", "method", "procurement_method", "mode of procurement"],
    "award_date": ["award date", "date awarded", "award_date", "date of award"],
    "status": ["status", "procurement status", "award status"],
}


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A columnar table; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Comma-separated rows with a header; text columns unless a schema is given."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def json_document(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """One JSON document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """One JSON object per line, blank lines skipped."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A worksheet as text columns, where a reader for it is installed; the file fits the driver by its format's limit of rows."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, dtype=str))


def latest(spark: SparkSession, pattern: str, by: str = "name") -> str | None:
    """The last file of a pattern by name or by its time of change; None for none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    files = [(f.getPath().getName(), f.getModificationTime(), f.getPath().toString()) for f in (found or [])]
    key = (lambda f: (f[0], f[1])) if by == "name" else (lambda f: (f[1], f[0]))
    return max(files, key=key)[2] if files else None


def detected(df: DataFrame, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """The logical columns found under any of their header variants; absent ones are null."""
    wanted = headers or HEADERS
    found = {name: column_variant(df.columns, variants) for name, variants in wanted.items()}
    return df.select(*((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(name) for name, c in found.items()))


def export_records(df: DataFrame, source_file: str) -> DataFrame:
    """Normalised records of an export; rows without a reference or a procuring entity are left out."""
    raw = detected(df)
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    status = F.lower(F.trim(F.coalesce(F.col("status").cast("string"), F.lit("active"))))
    rows = raw.select(*(text(c).alias(c) for c in ("reference_number", "title", "procuring_entity", "contractor_name")), fn.money(F.col("amount").cast("string")).alias("amount"), fn.method_class(F.col("procurement_method")).alias("procurement_method"), fn.parsed_date(F.col("award_date").cast("string")).alias("award_date"), status.alias("status"), F.lit(source_file).alias("source_file"))
    return rows.where("reference_number <> '' AND procuring_entity <> ''")


def location(df: DataFrame, default: str | None = "Unspecified") -> DataFrame:
    """Adds office (the province) and region from a struct, a JSON string or flat columns named location.*.

    Empty and missing ones are named by the default, or null.
    """
    kinds = dict(df.dtypes)
    if kinds.get("location", "").startswith("struct"):
        place = F.col("location")
    elif "location" in kinds:
        place = F.from_json("location", "province string, region string")
    else:
        flat = [F.col(f"`location.{c}`") if f"location.{c}" in kinds else F.lit(None) for c in ("province", "region")]
        place = F.struct(flat[0].cast("string").alias("province"), flat[1].cast("string").alias("region"))
    named = df.withColumn("_p", place)
    text = lambda c, kind: F.coalesce(F.nullif(F.col(f"_p.{c}"), F.lit("")), F.lit(f"{default} {kind}" if default else None))
    return named.withColumn("office", text("province", "office")).withColumn("region", text("region", "region")).drop("_p")


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines, replacing what was there."""
    df.write.mode("overwrite").json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """One JSON array in one file, an element on each line, in the order of the elements' text.

    Tasks write their pieces of the document, brackets and commas included; the pieces are then copied
    one after the other into the file, as streams, so neither a task nor the driver holds it.
    """
    spark, pieces = df.sparkSession, f"{path}.pieces"
    rows = df.select(F.to_json(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))).alias("value"))
    placed = numbered(rows, [F.col("value")], "place")
    n = placed.count()
    line = F.concat(F.when(F.col("place") == 1, "[").otherwise(","), "value", F.when(F.col("place") == n, "]").otherwise(""))
    placed.repartitionByRange("place").sortWithinPartitions("place").select(line.alias("value")).write.mode("overwrite").text(pieces)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(pieces)
    fs = folder.getFileSystem(conf)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
    try:
        if not n:
            out.write(bytearray(b"[]\n"))
        for name in sorted(str(s.getPath()) for s in fs.listStatus(folder)):
            if name.rsplit("/", 1)[1].startswith("part-"):
                part = fs.open(jvm.org.apache.hadoop.fs.Path(name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                finally:
                    part.close()
    finally:
        out.close()
    fs.delete(folder, True)


def write_stamped(df: DataFrame, folder: str, name: str, stamp: str) -> str:
    """JSON lines under a name with a time stamp, so that earlier exports stay."""
    path = f"{folder.rstrip('/')}/{name}_{stamp}.jsonl"
    df.write.mode("errorifexists").json(path)
    return path


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as tables under one folder, edges split by type."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
