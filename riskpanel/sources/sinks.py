"""Sinks (S10): tables as parquet/csv, ordered samples, and datasets that are whole or absent.

A dataset is written aside and moved to its name in one rename, with a manifest of its data files (name and length). A
reader compares the manifest with the files that are there, so that a dataset which lost a file, or was written by a job
that died, is an error and never a shorter table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"  # hidden from readers of the folder itself


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_sample(df: DataFrame, path: str, n: int = 20, order: str | list[str] = "date", fmt: str = "csv") -> None:
    """head(N) sample: ``orderBy(...).limit(N)`` (a TakeOrdered, not a full sort). Give an order that is unique."""
    by = [order] if isinstance(order, str) else order
    write_table(df.orderBy(*by).limit(n).coalesce(1), path, fmt=fmt)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return bool(fs.exists(p))


def _data_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of each data file under ``path``; nothing is read of them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return found.select(F.substring_index("path", "/", -1).alias("name"), "length")


def write_dataset(df: DataFrame, root: str, name: str, order: list[str] | None = None) -> bool:
    """Write ``root/name`` as parquet unless it is there already; whether it was written.

    With ``order`` the files hold ranges of it, each sorted. The files and their manifest are made in a folder of their own
    beside it; the rename is the last step, so that a lost driver leaves no half dataset under the name."""
    spark = df.sparkSession
    target = f"{root.rstrip('/')}/{name}"
    if _exists(spark, target):
        return False
    aside = f"{root.rstrip('/')}/_pending-{uuid.uuid4().hex}"
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.parquet(aside)
    _data_files(spark, aside).write.json(f"{aside}/{MANIFEST}")
    fs, source = _folder(spark, aside)
    if _exists(spark, target) or not fs.rename(source, _folder(spark, target)[1]):
        fs.delete(source, True)
        raise FileExistsError(f"{target} was written by another job meanwhile")
    return True


def read_dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A dataset of ``write_dataset``; an error if it is absent, has no manifest, or its files are not those of the manifest."""
    path = f"{root.rstrip('/')}/{name}"
    if not _exists(spark, path):
        raise FileNotFoundError(f"missing datasets: {[name]}")
    if not _exists(spark, f"{path}/{MANIFEST}"):
        raise ValueError(f"dataset {name} has no manifest")
    listed = spark.read.schema("name string, length long").json(f"{path}/{MANIFEST}")
    there = _data_files(spark, path)
    odd = listed.join(there, ["name", "length"], "left_anti").unionByName(there.join(listed, ["name", "length"], "left_anti")).first()
    if odd is not None:
        raise ValueError(f"dataset {name} is not as it was written: {odd.name}")
    return spark.read.parquet(path)


def ensure_datasets(spark: SparkSession, frames: dict[str, DataFrame], root: str, required: list[str] | None = None,
                    order: list[str] | None = None) -> list[str]:
    """Write each named dataset under ``root`` unless it is there, then check that the required ones (all of ``frames``
    if none are named) are there and whole. A required dataset may have been written by other means: without a
    manifest it must be readable as parquet."""
    for name, df in frames.items():
        write_dataset(df, root, name, order)
    missing = []
    for name in required or list(frames):
        path = f"{root.rstrip('/')}/{name}"
        if _exists(spark, f"{path}/{MANIFEST}"):
            read_dataset(spark, root, name)
            continue
        try:
            spark.read.parquet(path).schema
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            missing.append(name)
    if missing:
        raise FileNotFoundError(f"missing datasets: {missing}")
    return sorted(frames)
