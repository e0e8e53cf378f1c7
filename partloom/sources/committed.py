"""Sinks that commit: ``partloom_rows``, whole files of rows, and ``partloom_files``, files of bytes.

Tasks write below ``_aside``; what they wrote moves to its place when all have ended.  A task
that fails, is repeated or runs twice leaves nothing that is read, and a job that fails
leaves no trace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from partloom.sources.stored import Aside, opened


@dataclass
class Wrote(WriterCommitMessage):
    """What a task wrote: the parts of each file, or of its rows."""

    parts: dict[str, list[str]] = field(default_factory=dict)


class RowWriter(DataSourceArrowWriter):
    """A part for each task, whatever number of files its rows are of; one rename shows all parts."""

    def __init__(self, path: str, job: str | None = None) -> None:
        self.aside = Aside(path, job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        system, _ = opened(self.aside.path)
        folder, out, writer = self.aside.attempt(), Wrote(), None
        for batch in iterator:
            if batch["file"].null_count:
                raise ValueError("a row without a file")
            kept = batch.drop_columns(["error"])
            if writer is None:
                part = f"{folder}/part-{folder.rsplit('-', 1)[-1]}.parquet"
                writer, out.parts["rows"] = pq.ParquetWriter(part, kept.schema, filesystem=system), [part]
            writer.write_batch(kept)
        if writer is not None:
            writer.close()
        return out

    def commit(self, messages: list[Wrote | None]) -> None:
        parts = [p for m in filter(None, messages) for p in m.parts.get("rows", [])]
        if parts:
            self.aside.publish(parts, f"rows/{self.aside.job}")
        self.aside.clear()

    def abort(self, messages: list[Wrote | None]) -> None:
        self.aside.clear()


class RowSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "partloom_rows"

    def writer(self, schema, overwrite: bool) -> RowWriter:
        if not {"file", "error"} <= set(schema.fieldNames()):
            raise ValueError("rows need the columns file and error")
        return RowWriter(self.options["path"], self.options.get("job"))


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.aside = Aside(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        system, _ = opened(self.aside.path)
        folder, out = self.aside.attempt(), Wrote()
        for batch in iterator:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                part = f"{folder}/{len(out.parts):06d}"
                with system.open_output_stream(part) as f:
                    f.write(content.as_buffer())
                out.parts.setdefault(name.as_py(), []).append(part)
        return out

    def commit(self, messages: list[Wrote | None]) -> None:
        system, root = opened(self.aside.path)
        for m in filter(None, messages):
            for name, parts in m.parts.items():
                system.create_dir(f"{root}/{name}".rsplit("/", 1)[0])
                system.move(parts[-1], f"{root}/{name}")
        self.aside.clear()

    def abort(self, messages: list[Wrote | None]) -> None:
        self.aside.clear()


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "partloom_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def load_files(rows: DataFrame, path: str, checks: dict[str, Column]) -> None:
    """Add the rows of each file (column file) that has none yet, whole or, where a row
    fails a check, not at all.

    A row fails with the first check that isn't true of it.  Rows of a file may
    lie in any tasks; a file that has been loaded before stays as it is.  Rows are put
    aside and judged by file; the log, moved last, is what makes a load count.
    """
    spark = rows.sparkSession
    spark.dataSource.register(RowSink)
    error = F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()), F.lit(None).cast("string"))
    file = F.coalesce(F.col("file").cast("string"), F.raise_error(F.lit("a row without a file")).cast("string"))
    aside = Aside(path)
    at = f"{path.rstrip('/')}/_aside/{aside.job}"
    try:
        rows.withColumns({"file": file, "error": error}).write.parquet(f"{at}/staged")
        staged = spark.read.parquet(f"{at}/staged")
        files = staged.groupBy("file").agg(F.count("*").alias("n_rows"), F.min("error").alias("error"))
        known = load_log(spark, path).where("status = 'completed'").select("file", F.lit(True).alias("known"))
        status = F.when(F.col("error").isNotNull(), "failed").when(F.col("known"), "loaded before").otherwise("completed")
        files.join(known, "file", "left").select("file", "n_rows", status.alias("status"), "error").write.parquet(f"{at}/log")
        new = spark.read.schema(_LOG).parquet(f"{at}/log").where("status = 'completed'")
        kept = staged.join(new.select("file"), "file", "left_semi")
        kept.write.format("partloom_rows").mode("append").option("path", path).option("job", f"{aside.job}-rows").save()
        system, root = opened(path)
        system.create_dir(f"{root}/log")
        system.move(aside.folder("log"), f"{root}/log/{aside.job}")
    finally:
        aside.clear()


_LOG = "file string, n_rows long, status string, error string"


def _loads(path: str, kind: str) -> list[str]:
    """The loads that a folder keeps: those with a log, or those with rows."""
    system, root = opened(path)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(f"{root}/{kind}", allow_not_found=True)))


def _read(spark: SparkSession, schema: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def loaded_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file and the columns of schema, of all files that were loaded."""
    told = {f"{job}-rows" for job in _loads(path, "log")}  # rows whose load ended before its log don't count
    return _read(spark, f"{schema}, file string", [f"{path}/rows/{job}" for job in _loads(path, "rows") if job in told])


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """file, n_rows, status, error of every file of every load."""
    return _read(spark, _LOG, [f"{path}/log/{job}" for job in _loads(path, "log")])


def write_files(files: DataFrame, path: str) -> None:
    """Files (name, content) below a folder, all at the end of the job or none; of equal names the last one."""
    files.sparkSession.dataSource.register(FileSink)
    files.select("name", "content").write.format("partloom_files").mode("append").option("path", path).save()


def truncated(path: str) -> None:
    """Forget all rows and logs of a folder: everything that a load has added."""
    system, root = opened(path)
    for name in ("rows", "log", "_aside"):
        if system.get_file_info(f"{root}/{name}").type.name != "NotFound":
            system.delete_dir(f"{root}/{name}")
