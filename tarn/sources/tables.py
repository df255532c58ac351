"""Scans and sinks: JSON manifests, directories, tolerant logs, chunk indexes, daily traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERMIT = (
    "id string, nama_perizinan string, kategori string, url_sumber string, persyaratan array<string>, mekanisme_pelayanan array<struct<nomor:int,deskripsi:string>>, "
    "dasar_hukum array<struct<nomor:int,referensi:string>>, keterangan struct<estimasi_selesai:string,masa_berlaku:string,biaya:string>"
)


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of the files of a folder that match a pattern, by any file system Spark reaches."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def questions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the array `questions` of a file with other keys besides."""
    return spark.read.schema(f"questions array<struct<{schema}>>").option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.*")


def tolerant_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; lines that can't be read are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def manifest(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (filename, ...) whose file is there, and the others with reason file_missing."""
    names = found.select(F.col("name").alias("filename")).distinct()
    return rows.join(names, "filename", "left_semi"), rows.join(names, "filename", "left_anti").withColumn("reason", F.lit("file_missing"))


def table_rows(cells: DataFrame) -> DataFrame:
    """Rows (page, cells) of scanned tables without repeated headings; a null first cell continues a row and stays."""
    return cells.where(F.coalesce(F.upper(F.trim(F.col("cells")[0])), F.lit("")) != "NO")


def merged_rows(rows: DataFrame) -> DataFrame:
    """(place, number, name, rest) with rows without a number folded into the row before, unless their name is a lettered
    entry; what comes before the first row is dropped. rows (doc, place, number, name, rest) are cut by doc."""
    from pyspark.sql import Window

    starts = F.coalesce(F.trim("number") != "", F.lit(False)) | F.coalesce(F.trim("name").rlike(r"^[a-z]\.\s"), F.lit(False))
    island = F.sum(starts.cast("int")).over(Window.partitionBy("doc").orderBy("place"))
    part = F.sort_array(F.collect_list(F.struct("place", "number", "name", "rest")))
    whole = rows.withColumn("island", island).where("island > 0").groupBy("doc", "island").agg(part.alias("p"))
    join = lambda c, sep: F.array_join(F.filter(F.transform("p", lambda x: x[c]), lambda s: s.isNotNull() & (s != "")), sep)
    return whole.select("doc", F.col("p")[0]["place"].alias("place"), F.col("p")[0]["number"].alias("number"), join("name", " ").alias("name"), join("rest", "\n").alias("rest"))


def unified(parts: dict[str, DataFrame]) -> DataFrame:
    """Chunk tables of several domains as one, with domain and an id that carries it."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("id", F.concat(F.lit(f"{name}:"), F.col("id").cast("string"))).withColumn("domain", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_index(chunks: DataFrame, path: str, wipe: bool = True) -> int:
    """Write a chunk table by domain; returns how many rows were written, counted as they pass."""
    from pyspark.sql import Observation

    seen = Observation()
    chunks.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("domain").mode("overwrite" if wipe else "append").parquet(path)
    return seen.get["n"]


def append_traces(rows: DataFrame, path: str) -> None:
    """Append trace rows (ts, ...) as JSON, a folder a day."""
    rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)
