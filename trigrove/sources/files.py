"""Text files, triple files and graph scripts as tables, and back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.functions import text as tx

#: Header of the triple file, comment lines of the script, encodings in the order in which they are tried.
CSV_HEADER = ("实体1", "关系", "实体2")
SCRIPT_HEAD = ("// 企业知识图谱CQL导入脚本", "// 自动生成，请勿手动修改", "")
ENCODINGS = ("utf-8", "gbk", "gb2312", "gb18030", "latin-1")
MARK = "﻿"


def decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return ""


def read_text_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt",)) -> DataFrame:
    """path, ext, text, n_chars, status (ok, empty, unsupported) of every file under ``path``.

    Valid UTF-8 is decoded without Python; only other files go through the list of encodings. Line ends become ``\\n``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).alias("ext"), "content")
    known = files.where(F.col("ext").isin(*extensions))
    plain = known.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", "ext", F.col("content").cast("string").alias("raw"))

    @F.pandas_udf("string")
    def other(content: pd.Series) -> pd.Series:
        return content.map(decode)

    odd = known.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path", "ext", other("content").alias("raw"))
    text = F.regexp_replace(F.regexp_replace("raw", f"^{MARK}", ""), r"\r\n?", "\n")
    read = plain.unionByName(odd).select("path", "ext", text.alias("text"))
    read = read.withColumn("status", F.when(tx.is_blank(F.col("text")), "empty").otherwise("ok"))
    rest = files.where(~F.col("ext").isin(*extensions)).select("path", "ext", F.lit(None).cast("string").alias("text"), F.lit("unsupported").alias("status"))
    return read.unionByName(rest).select("path", "ext", "text", F.length("text").cast("long").alias("n_chars"), "status")


def read_triples_csv(spark: SparkSession, path: str, na_tokens: tuple[str, ...] = ()) -> DataFrame:
    """e1, rel, e2 of a CSV with a header; rows with a missing part go; a missing path is an empty table.

    All parts are strings; empty fields and ``na_tokens`` are missing.
    """
    schema = "e1 string, rel string, e2 string"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("enforceSchema", True).csv(path)
    for c in ("e1", "rel", "e2"):
        rows = rows.withColumn(c, F.when(F.col(c).isin("", *na_tokens), None).otherwise(F.col(c)))
    return rows.dropna()


def merged_triples(new: DataFrame, existing: DataFrame, mode: str) -> DataFrame:
    """``overwrite``: the new rows as they are. ``append``: old rows, then new ones, each exact triple once (its first ordinal)."""
    if mode == "overwrite":
        return new
    both = existing.select("e1", "rel", "e2", F.lit(0).alias("late"), "ordinal").unionByName(new.select("e1", "rel", "e2", F.lit(1).alias("late"), "ordinal"))
    return both.groupBy("e1", "rel", "e2").agg(F.min(F.struct("late", "ordinal")).alias("at")).select("e1", "rel", "e2", "at.late", "at.ordinal")


def write_triples(new: DataFrame, path: str, mode: str = "append") -> bool:
    """Write a Parquet triple table; nothing is written for empty input. In ``append`` mode only triples that are not there yet are added."""
    if new.isEmpty():
        return False
    spark = new.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    if mode == "append":
        fresh = new.groupBy("e1", "rel", "e2").agg(F.min("ordinal").alias("ordinal")).select("e1", "rel", "e2", "ordinal")
        if there:
            fresh = fresh.join(spark.read.parquet(path).select("e1", "rel", "e2"), ["e1", "rel", "e2"], "left_anti")
        fresh.write.mode("append").parquet(path)
    else:
        new.select("e1", "rel", "e2", "ordinal").write.mode("overwrite").parquet(path)
    return True


def export_triples_csv(triples: DataFrame, path: str) -> bool:
    """Null-free triples as CSV part files, each with the byte-order mark and the header; nothing for no rows."""
    rows = triples.select("e1", "rel", "e2").dropna()
    if rows.isEmpty():
        return False
    rows.toDF(MARK + CSV_HEADER[0], *CSV_HEADER[1:]).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
    return True


def graph_script_lines(triples: DataFrame) -> DataFrame:
    """ordinal, line: one MERGE statement for each triple."""
    e1, e2, rel = tx.escape_value(F.col("e1")), tx.escape_value(F.col("e2")), tx.escape_relation(F.col("rel"))
    line = F.concat(F.lit("MERGE (a:Entity {name: '"), e1, F.lit("'}) MERGE (b:Entity {name: '"), e2, F.lit("'}) MERGE (a)-[:"), rel, F.lit("]->(b);"))
    return triples.select("ordinal", line.alias("line"))


def write_graph_script(triples: DataFrame, path: str) -> bool:
    """The statements as text part files in the order of ``ordinal``; the first part starts with two comment lines and a blank one."""
    if triples.isEmpty():
        return False
    spark = triples.sparkSession
    head = spark.createDataFrame([(-len(SCRIPT_HEAD) + k, line) for k, line in enumerate(SCRIPT_HEAD)], "ordinal long, line string")
    rows = head.unionByName(graph_script_lines(triples).withColumn("ordinal", F.col("ordinal").cast("long")))
    rows.orderBy("ordinal").select("line").write.mode("overwrite").text(path)
    return True


STATEMENT = r"^MERGE \(a:Entity \{name: '((?:[^'\\]|\\.)*)'\}\) MERGE \(b:Entity \{name: '((?:[^'\\]|\\.)*)'\}\) MERGE \(a\)-\[:(`(?:[^`]|``)*`|[a-zA-Z_][a-zA-Z0-9_]*)\]->\(b\);$"


def parse_graph_script(lines: DataFrame) -> DataFrame:
    """``lines(value)`` -> e1, rel, e2 of each statement; blank and comment lines go."""
    value = tx.trim(F.col("value"))
    rows = lines.select(value.alias("value")).where("value != '' and not startswith(value, '//')").where(F.col("value").rlike(STATEMENT))
    part = lambda k: F.regexp_extract("value", STATEMENT, k)
    rel = F.when(part(3).startswith("`"), F.replace(F.regexp_replace(part(3), "^`|`$", ""), F.lit("``"), F.lit("`"))).otherwise(part(3))
    return rows.select(tx.unescape_value(part(1)).alias("e1"), rel.alias("rel"), tx.unescape_value(part(2)).alias("e2"))


def read_graph_script(spark: SparkSession, path: str) -> DataFrame:
    return parse_graph_script(spark.read.text(path))
