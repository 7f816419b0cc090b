"""Notes as Markdown files in a folder."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.durable import durable

_BATCH_BYTES = 16 << 20


def read_vault(spark: SparkSession, folder: str, also: Sequence[str] = ()) -> DataFrame:
    """(path, content) of every '.md' file below ``folder``, zero-byte ones included.

    Only those files are opened, by the tasks. See ``list_files`` for names that are passed
    over. Bytes that are no UTF-8 become U+FFFD.
    """
    notes = _listed(spark, folder, also).filter(F.endswith("path", F.lit(".md")))
    # Folders differ in size, so the files are dealt anew before they are read.
    dealt = notes.select("path", "size").repartition(F.col("path"))
    address = _address(_qualified(spark, folder)[1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(address)
        for batch in batches:
            paths, contents, held = [], [], 0
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                content = b""
                if size:
                    with store.open_input_stream(f"{base}/{path}", compression=None) as file:
                        content = file.read()
                paths.append(path)
                contents.append(content)
                held += len(content)
                if held >= _BATCH_BYTES:
                    yield _note_batch(paths, contents)
                    paths, contents, held = [], [], 0
            if paths:
                yield _note_batch(paths, contents)

    content = F.make_valid_utf8(F.col("content").cast("string"))
    return dealt.mapInArrow(read, "path string, content binary").select("path", content.alias("content"))


def list_files(spark: SparkSession, folder: str, also: Sequence[str] = ()) -> DataFrame:
    """(path) of every file below ``folder``, of any kind and size. None is opened.

    As in Spark's readers, names that start with '.' or '_' are passed over; such folders,
    the trash for one, are named in ``also`` where they are wanted.
    """
    return _listed(spark, folder, also).select("path")


def write_vault(notes: DataFrame, folder: str) -> DataFrame:
    """Write each note as a file below ``folder``; returns (written) per batch.

    ``folder`` is an address as Spark takes it; one that has files already is
    refused. Tasks write whole files, so a repeated task leaves the same result.
    Nothing is written until the returned rows are used.
    """
    spark = notes.sparkSession
    filesystem, root = _qualified(spark, folder)
    if filesystem.exists(root) and len(filesystem.listStatus(root)):
        raise FileExistsError(f"not empty: {folder}")
    address = _address(root)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pyarrow.fs.FileSystem.from_uri(address)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                target = f"{base}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target, compression=None) as out:
                    out.write(content.encode("utf-8"))
            yield pd.DataFrame({"written": [len(batch)]})

    return notes.select("path", "content").mapInPandas(write, "written bigint")


def _listed(spark: SparkSession, folder: str, also: Sequence[str]) -> DataFrame:
    """(path, size) of the files below the folder, listed by tasks, one level of folders after another.

    Only the number of folders of a level comes back to the driver.
    """
    filesystem, root = _qualified(spark, folder)
    address = _address(root)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    hidden = [name.strip("/") for name in also]
    starts = ["", *(name for name in hidden if filesystem.exists(jvm_path(f"{root.toString()}/{name}")))]
    open_ = spark.createDataFrame([(name,) for name in dict.fromkeys(starts)], "path string")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(address)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = store.get_file_info(pyarrow.fs.FileSelector(f"{base}/{path}".rstrip("/")))
                shown = [info for info in found if not info.base_name.startswith((".", "_"))]
                prefix = f"{path}/" if path else ""
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([prefix + info.base_name for info in shown], pa.string()),
                        pa.array([info.size for info in shown], pa.int64()),
                        pa.array([info.type == pyarrow.fs.FileType.Directory for info in shown], pa.bool_()),
                    ],
                    ["path", "size", "is_folder"],
                )

    levels = []
    while True:
        level = durable(open_.repartition("path").mapInArrow(entries, "path string, size bigint, is_folder boolean"))
        levels.append(level.filter("NOT is_folder").select("path", "size"))
        open_ = level.filter("is_folder").select("path")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionAll, levels).distinct()


def _note_batch(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])


def _address(root) -> str:
    """The same store by the names that tasks know it under."""
    address = re.sub(r"^s3[an]:", "s3:", root.toUri().toString())
    return re.sub(r"^file:/+", "file:///", address)


def _qualified(spark: SparkSession, folder: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    filesystem = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return filesystem, filesystem.makeQualified(jvm_path)
