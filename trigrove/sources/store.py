"""A table of keyed rows on files that merges by touched buckets and shows only what was committed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Others committed first, as often as was tried."""


class KeyedStore:
    """Rows with unique ``keys`` under ``path``, in Parquet folders ``data/store_folder=.../store_bucket=.../`` and commits ``commits/<number>``.

    A commit is one small file that names all live folders, and only its creation makes a merge visible: what a
    failed job has written is never read. A number can be taken once, so of two merges at a time the second finds
    it gone and looks for its rows among the other's before it tries again; none is added twice. This needs a file
    system whose rename fails where the new name is taken, as HDFS has; elsewhere one merge at a time is safe.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.columns = spark.createDataFrame([], schema).schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _commits(self) -> list[str]:
        top = self._path(f"{self.path}/commits")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def snapshot(self) -> tuple[int, list[str]]:
        """Number of the last commit (0: none) and the folders that it names."""
        names = self._commits()
        if not names:
            return 0, []
        stream = self._fs.open(self._path(f"{self.path}/commits/{names[-1]}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(names[-1]), json.loads(text)

    def _commit(self, number: int, folders: list[str]) -> bool:
        """Whether this number was still free. The content is written aside first, so that no half commit is read."""
        aside, final = self._path(f"{self.path}/aside-{uuid.uuid4().hex}"), self._path(f"{self.path}/commits/{number:012d}")
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            return False
        return True

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.columns).withColumn("store_bucket", F.lit(0))
        schema = self.columns.simpleString()[7:-1].replace(",", ", ").replace(":", " ") + ", store_folder string, store_bucket int"
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{f}" for f in folders])
        return read.drop("store_folder")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All committed rows, or those of some buckets (only their files are opened)."""
        rows = self._rows(self.snapshot()[1])
        return (rows if buckets is None else rows.where(F.col("store_bucket").isin(buckets))).drop("store_bucket")

    def _write(self, rows: DataFrame) -> str:
        folder = f"store_folder={uuid.uuid4().hex}"
        # each bucket is written by a few tasks, whatever its size
        spread = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        dealt = rows.repartition(F.col("store_bucket"), F.pmod(F.xxhash64(*self.keys, F.lit("spread")), F.lit(spread)))
        dealt.write.partitionBy("store_bucket").parquet(f"{self.path}/data/{folder}")
        return folder

    def _drop(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.path}/data/{folder}"), True)

    def merge(self, rows: DataFrame, tries: int = 5) -> int:
        """Add the rows whose keys are not there yet, each key once (its smallest row); returns the number of the commit that has them.

        Only buckets that the new rows touch are read, and only of their key columns. Rows with a null key go.
        ``rows`` is evaluated once for each try, and once for its buckets.
        """
        rest = [c for c in self.columns.names if c not in self.keys]
        new = rows.select(self.columns.names).dropna(subset=self.keys)
        first = F.min(F.struct(*rest)).alias("_r") if rest else F.count(F.lit(1)).alias("_r")
        new = new.groupBy(*self.keys).agg(first).select(*self.keys, *[f"_r.{c}" for c in rest]).withColumn("store_bucket", self._bucket())
        touched = [r["store_bucket"] for r in new.select("store_bucket").distinct().collect()]
        if not touched:
            return self.snapshot()[0]
        for _ in range(tries):
            number, folders = self.snapshot()
            old = self._rows(folders).where(F.col("store_bucket").isin(touched)).select("store_bucket", *self.keys)
            folder = self._write(new.join(old, ["store_bucket", *self.keys], "left_anti").select(*self.columns.names, "store_bucket"))
            if not list(self._fs.listStatus(self._path(f"{self.path}/data/{folder}"), self._jvm.org.apache.hadoop.fs.GlobFilter("store_bucket=*"))):
                self._drop(folder)
                return number
            if self._commit(number + 1, [*folders, folder]):
                return number + 1
            self._drop(folder)
        raise Conflict(f"{tries} tries")

    def compact(self) -> bool:
        """Put all live folders into one; False if another commit came first. The old folders stay for readers that have begun."""
        number, folders = self.snapshot()
        return len(folders) < 2 or self._commit(number + 1, [self._write(self._rows(folders))])
