"""Small files in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; of this machine only if the session runs on it alone and names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: executors of a cluster need a shared folder for files")
        found = tempfile.mkdtemp(prefix="polescale-")
    found = found if "://" in found or found.startswith("file:") else f"file://{found}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def work_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to a shared folder and read back, for what several later steps read; it goes when the process ends."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}  # shuffle files go with the write
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def delete() -> None:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; its folder is cleaned by whoever owns it
            pass

    atexit.register(delete)
    return spark.read.schema(df.schema).parquet(folder)


def write_files(files: DataFrame, folder: str) -> int:
    """Write ``files`` (name, content) to ``folder``, each under a temporary name first; their number. Names are distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{root}/{name}"
                store.create_dir(path.rsplit("/", 1)[0])
                part = f"{path.rsplit('/', 1)[0]}/._{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return sum(r["n"] for r in files.selectExpr("cast(name as string) name", "cast(content as binary) content").mapInArrow(run, "n long").collect())  # a number for each batch
