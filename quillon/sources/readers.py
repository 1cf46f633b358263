"""Tolerant readers. Schemas are explicit; torn lines are skipped, not fatal."""

from __future__ import annotations

import csv

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.errors import AnalysisException


def jsonl(spark: SparkSession, path: str | list[str], schema: str, with_file: bool = False) -> DataFrame:
    """JSON lines of this schema; blank and torn lines go, a missing path gives no rows."""
    kind = T._parse_datatype_string(schema)
    full = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    try:
        rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kind if not with_file else T.StructType([*kind.fields, T.StructField("file", T.StringType())]))
    if with_file:
        rows = rows.withColumn("file", F.col("_metadata.file_path"))
    # cached scans aside, the corrupt column must be kept with the others while filtering
    return rows.filter(F.col("_bad").isNull()).drop("_bad")


def first_rows(rows: DataFrame, key: str, order: list, present: DataFrame | None = None) -> DataFrame:
    """First row of each key in the given order; with ``present``(key), only keys it lists."""
    kept = rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
    return kept.join(present.select(key).distinct(), key, "left_semi") if present is not None else kept


ENTRIES = "array<struct<type:string,start:double,end:double,word:string>>"
WRAPPERS = ("segments", "words", "alignment", "result")


def alignments(files: DataFrame, text: str = "value") -> DataFrame:
    """Adds entries: a bare JSON list, or the list in the first of the known wrappers; anything else is an error."""
    listed = F.from_json(text, ENTRIES)
    wrapped = [F.from_json(F.get_json_object(text, f"$.{w}"), ENTRIES) for w in WRAPPERS]
    found = F.when(F.ltrim(F.col(text)).startswith("["), listed).otherwise(F.coalesce(*wrapped))
    return files.withColumn("entries", F.coalesce(found, F.raise_error(F.lit("no list of entries in the alignment")).cast(ENTRIES)))


def sniffed_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header whose delimiter is told from its first kilobytes."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(20).collect())
    try:
        sep = csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        sep = ","
    return spark.read.csv(path, header=True, sep=sep)


def widest(rows: DataFrame, name: str = "transcript") -> DataFrame:
    """Adds the longest of a row's text columns."""
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    best = F.array_max(F.array(*(F.struct(F.coalesce(F.length(c), F.lit(-1)).alias("n"), F.col(c).alias("t")) for c in texts)))
    return rows.withColumn(name, best["t"])


def embedded_json(pages: DataFrame, element: str, schema: str, html: str = "html") -> DataFrame:
    """(page columns but html, key, value) from a JSON map in the script element of this id."""
    raw = F.regexp_extract(html, rf'(?s)<script[^>]*id="{element}"[^>]*>(.*?)</script>', 1)
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.explode(F.from_json(raw, f"map<string,{schema}>")).alias("key", "value"))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, href): every link of a page."""
    return pages.select("page_id", F.explode(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, bytes) of the files below a folder."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def paired(files: DataFrame, suffix: str = ".json") -> DataFrame:
    """Files that have a companion named like them plus the suffix."""
    return files.join(files.select(F.col("path").alias("companion")), F.concat(F.col("path"), F.lit(suffix)) == F.col("companion"))


def setting(settings: DataFrame, key: str, default: float) -> float:
    """A numeric setting, or the default."""
    row = settings.filter(F.col("key") == key).select("value").head()
    return float(row.value) if row is not None and row.value is not None else default


def embedded_clips(pages: DataFrame, html: str = "html", kind: str = "audio/mpeg") -> DataFrame:
    """(page columns but html, id, seconds, clip binary): clips that a page carries as base64 in {"id", "dur", "src"} objects."""
    pattern = rf'\{{"id": "(\w+)", "dur": ([\d.]+), "src": "data:{kind};base64,([A-Za-z0-9+/=]+)"\}}'
    part = lambda n: F.regexp_extract_all(html, F.lit(pattern), F.lit(n))
    rest = [c for c in pages.columns if c != html]
    rows = pages.select(*rest, F.explode(F.arrays_zip(part(1).alias("id"), part(2).alias("dur"), part(3).alias("src"))).alias("_c"))
    return rows.select(*rest, F.col("_c.id").alias("id"), F.col("_c.dur").cast("double").alias("seconds"), F.unbase64("_c.src").alias("clip"))


def id_list(spark: SparkSession, path: str | list[str], columns: tuple[str, ...] = ("id",)) -> DataFrame:
    """Lines of tab-separated keys, each once; blank lines go, missing fields are null."""
    parts = F.split(F.trim("value"), "\t")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(*(F.trim(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(columns))).distinct()


def labelled_csv(spark: SparkSession, path: str | list[str], labels: str = "labels") -> DataFrame:
    """CSV with a header, its comma-separated label column as an array of trimmed labels."""
    rows = spark.read.csv(path, header=True)
    return rows.withColumn(labels, F.filter(F.transform(F.split(F.coalesce(F.col(f"`{labels}`"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def half_matrix(spark: SparkSession, path: str, index: str, size: int, schema: str) -> DataFrame:
    """Rows of a file of half-precision vectors beside their JSON lines: the index's columns and embedding array<float>.

    The file is read as records of fixed length, so it may have any size; the n-th
    record goes with the n-th line.
    """
    sc = spark.sparkContext
    numbered = lambda rdd: rdd.zipWithIndex().map(lambda x: (x[1], x[0]))
    vectors = spark.createDataFrame(numbered(sc.binaryRecords(path, 2 * size)), "_row long, _raw binary")
    lines = spark.createDataFrame(numbered(sc.textFile(index)), "_row long, _line string")

    @F.pandas_udf("array<float>")
    def single(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: np.frombuffer(b, np.float16).astype(np.float32))

    return lines.join(vectors, "_row").select(F.from_json("_line", schema).alias("_j"), single("_raw").alias("embedding")).select("_j.*", "embedding")


def sql_table(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options) -> DataFrame:
    """A table of a database by JDBC; with a key its range is read in parts at a time."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()
