"""Shared folder, scratch tables and small helpers of the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and all work is in one process (tests) a temporary
    folder is made; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="helixframe-")
    return _OWN[app]


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/helixframe/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._hf_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._hf_path)
            path.getFileSystem(conf).delete(path, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit_long(x: int) -> Column:
    return F.lit(x).cast("long")


def chi2_cdf_even(x: float, dof: int) -> float:
    """Distribution function of chi-squared for an even number of degrees of freedom."""
    half, term, total = x / 2.0, 1.0, 0.0
    for i in range(dof // 2):
        total += term
        term *= half / (i + 1)
    return 1.0 - math.exp(-half) * total


def chi2_quantile_even(p: float, dof: int) -> float:
    lo, hi = 0.0, 1.0
    while chi2_cdf_even(hi, dof) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf_even(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2
