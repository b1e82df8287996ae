"""Sinks: materialised extracts, the long experiment table, the text report."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_extract(df: DataFrame, path: str, partition_col: str | None = None, refreshed=()) -> None:
    """Daily-refreshed extract: the partitions present in ``df`` are replaced, at once.

    ``refreshed`` lists the partition values (a few days) that ``df`` was computed for; those
    of them without a row lose their old partition.

    ``df`` runs once, into a version folder of its own. A manifest then names the version of
    each partition; readers follow the newest manifest (``read_extract``), so they see the
    extract as it was before or after a refresh, and a refresh that dies leaves the old one.
    Versions that neither the new nor the last manifest names are removed.
    """
    spark = df.sparkSession
    files, root = _files(spark, path)
    number, old = _manifest(spark, path)
    version = f"version-{uuid.uuid4().hex[:12]}"
    w = df.write.partitionBy(partition_col) if partition_col else df.write
    w.parquet(f"{path}/{version}")
    found = [x.getPath().getName() for x in files.listStatus(root(version)) if x.isDirectory()] if partition_col else ["."]
    gone = {f"{partition_col}={v}" for v in refreshed}
    kept = {k: v for k, v in old["partitions"].items() if partition_col and k not in gone}
    new = {"schema": df.schema.jsonValue(), "partitions": kept | dict.fromkeys(found, version)}
    draft, name = root(f"_draft-{version}"), root(f"_manifest-{number + 1:09d}")
    out = files.create(draft)
    out.write(json.dumps(new).encode())
    out.close()
    if files.exists(name) or not files.rename(draft, name):
        raise RuntimeError(f"another refresh of {path} finished first; run this one again")
    named = set(new["partitions"].values()) | set(old["partitions"].values()) | {version}
    for x in files.listStatus(root(".")):
        folder = x.getPath().getName()
        if folder.startswith("version-") and folder not in named:
            files.delete(x.getPath(), True)


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """The extract as its newest manifest has it."""
    _, manifest = _manifest(spark, path)
    if "schema" not in manifest:
        raise FileNotFoundError(f"no extract at {path}")
    schema = StructType.fromJson(manifest["schema"])
    folders: dict[str, list[str]] = {}
    for part, version in sorted(manifest["partitions"].items()):
        folders.setdefault(version, []).append(part)
    frames = [spark.read.schema(schema).option("basePath", f"{path}/{v}").parquet(*[f"{path}/{v}/{p}" if p != "." else f"{path}/{v}" for p in parts])
              for v, parts in folders.items()]
    return functools.reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and paths below it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, lambda name: root if name == "." else jvm.org.apache.hadoop.fs.Path(root, name)


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest (0 and no partitions without one)."""
    files, root = _files(spark, path)
    names = sorted(x.getPath().getName() for x in files.listStatus(root(".")) if x.getPath().getName().startswith("_manifest-")) if files.exists(root(".")) else []
    if not names:
        return 0, {"partitions": {}}
    stream = files.open(root(names[-1]))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return int(names[-1].rpartition("-")[2]), json.loads(text)


def write_report(lines: DataFrame, path: str) -> None:
    """Write a ``(line_no, line)`` report as ordered text: the part files, by name, hold the lines in order.

    The sort is distributed; a report of a few thousand lines is one file.
    """
    lines.orderBy("line_no").select("line").write.mode("overwrite").text(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    return d


def write_scratch_csv(df: DataFrame) -> str:
    """Write ``df`` as CSV with a header into a new folder under the shared checkpoint
    folder (the warehouse, which is shared too, where none is set) and return its path."""
    path = scratch_folder(df.sparkSession, "csv")
    df.write.option("header", True).csv(path)
    return path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, or under the warehouse where none is set."""
    d = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
         or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch")
    return f"{d}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: what was numbered or drawn stays so."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).

    Without a configured folder the frame is returned as it is (recomputable
    from lineage); a machine-local folder is never chosen here.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            return df
        sc.setCheckpointDir(d)
    return df.checkpoint(eager=True)
