"""Data sources for spark.read.format and write.format: question sets and folders of evaluation runs.

`question_sets` reads JSON arrays of questions, a file a partition. `evaluation_runs` reads and writes a folder of
runs: tasks write Parquet files of their own, and a run is there once its list of files is; a write that fails takes
its files with it. Filters on `run` leave out the other runs' files before anything is read.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: What names a run's list of files within its folder.
LISTED = "_run.json"


def _place(path: str):
    from pyarrow import fs

    found, inner = fs.FileSystem.from_uri(path)
    return found, inner.rstrip("/")


def _files(path: str, end: str, below: bool = False) -> list[str]:
    """Files below a folder (or the one file) whose names end so, in order; none if the folder isn't there."""
    from pyarrow import fs

    where, inner = _place(path)
    if where.get_file_info(inner).type == fs.FileType.File:
        return [inner]
    found = where.get_file_info(fs.FileSelector(inner, recursive=below, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(end))


@dataclass
class Files(InputPartition):
    path: str
    run: str | None = None


class QuestionSets(DataSource):
    """Options: path, a file or a folder of *.json, as `readers.questions` reads them."""

    @classmethod
    def name(cls):
        return "question_sets"

    def schema(self):
        return "id string, question string, answer string, type string, level string, supporting array<string>, context array<string>"

    def reader(self, schema):
        return _QuestionReader(self.options["path"])


class _QuestionReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [Files(f) for f in _files(self.path, ".json")]

    def read(self, partition):
        if partition is None:  # a folder without files still has one task
            return
        where, _ = _place(self.path)
        with where.open_input_stream(partition.path) as f:
            rows = json.loads(f.read())
        for q in rows:
            first = lambda name: [x[0] for x in q.get(name) or [] if x]  # noqa: B023, E731
            key = q.get("_id") if q.get("_id") is not None else q.get("id")
            told = lambda name, none: none if q.get(name) is None else str(q[name])  # noqa: B023, E731
            key = None if key is None else str(key)
            yield (key, told("question", None), told("answer", ""), told("type", "unknown"), told("level", "unknown"), first("supporting_facts"), first("context"))


class EvaluationRuns(DataSource):
    """Options: path, the folder of runs; run, the name of the run that is written; runs, a comma-separated list of
    those that are read (all, if not given).

    Reading gives the column `run` and those the newest run was written with; what an older run lacks is null.
    """

    @classmethod
    def name(cls):
        return "evaluation_runs"

    def schema(self):
        runs = _runs(self.options["path"])
        if not runs:
            raise FileNotFoundError(f"no run in {self.options['path']}")
        return T.StructType([T.StructField("run", T.StringType()), *T.StructType.fromJson(runs[max(runs)]["schema"]).fields])

    def reader(self, schema):
        return _RunReader(self.options["path"], schema, self.options.get("runs"))

    def writer(self, schema, overwrite):
        run = self.options.get("run", "")
        if not run or "/" in run or run.startswith("_"):
            raise ValueError("option run names the run that is written")
        return _RunWriter(self.options["path"], run, schema, overwrite)


def _runs(path: str) -> dict[str, dict]:
    """The list of every run that was committed, by its name."""
    where, _ = _place(path)
    out = {}
    for f in _files(path, f"/{LISTED}", below=True):
        with where.open_input_stream(f) as stream:
            out[f.split("/")[-2]] = json.loads(stream.read())
    return out


class _RunReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, some: str | None):
        self.path, self.fields, self.some = path, schema, some and {r.strip() for r in some.split(",")}

    def partitions(self):
        _, inner = _place(self.path)
        some = {r: told for r, told in _runs(self.path).items() if not self.some or r in self.some}
        return [Files(f"{inner}/{r}/{f}", r) for r, told in sorted(some.items()) for f in told["files"]]

    def read(self, partition):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:
            return
        where, _ = _place(self.path)
        wanted = to_arrow_schema(self.fields)
        with where.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=2000):
                told = {c: batch.column(c) for c in batch.schema.names} | {"run": pa.array([partition.run] * len(batch), pa.string())}
                columns = [told[c.name].cast(c.type) if c.name in told else pa.nulls(len(batch), c.type) for c in wanted]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class _RunWriter(DataSourceArrowWriter):
    """Tasks write into a folder of this write's own, which `abort` removes under those that are still at it. A run is
    written by one writer at a time."""

    def __init__(self, path: str, run: str, schema: T.StructType, overwrite: bool):
        if not overwrite and run in _runs(path):
            raise FileExistsError(f"run {run} is there")
        self.path, self.run, self.schema, self.job = path, run, schema, f"data-{uuid.uuid4().hex}"
        where, folder = self._folder()
        where.create_dir(f"{folder}/{self.job}", recursive=True)

    def _folder(self):
        where, inner = _place(self.path)
        return where, f"{inner}/{self.run}"

    def write(self, iterator):
        import pyarrow.parquet as pq

        # a task that is tried again writes another file; only listed files count
        where, folder = self._folder()
        name, out = f"{self.job}/part-{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            if out is None:
                out = pq.ParquetWriter(f"{folder}/{name}", batch.schema, filesystem=where)
            out.write_batch(batch)
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def commit(self, messages):
        where, folder = self._folder()
        files = sorted(m.file for m in messages if m is not None and m.file)
        # the list comes last and is put in place at once: readers see the run before or after, not between
        draft = f"{folder}/{self.job}/{LISTED}.draft"
        with where.open_output_stream(draft) as f:
            f.write(json.dumps({"files": files, "schema": self.schema.jsonValue()}).encode())
        where.move(draft, f"{folder}/{LISTED}")
        for other in self._below(folder, where):
            if other.split("/")[-1].startswith("data-") and not other.endswith(self.job):
                _gone(where, other)
        listed = {f.split("/")[-1] for f in files}
        for f in self._below(f"{folder}/{self.job}", where):
            if f.split("/")[-1] not in listed:
                where.delete_file(f)

    def abort(self, messages):
        where, folder = self._folder()
        _gone(where, f"{folder}/{self.job}")
        if not self._below(folder, where):
            _gone(where, folder)

    @staticmethod
    def _below(folder: str, where) -> list[str]:
        from pyarrow import fs

        return [f.path for f in where.get_file_info(fs.FileSelector(folder, allow_not_found=True))]


def _gone(where, folder: str) -> None:
    """Remove a folder in which a task may still be opening its file."""
    for wait in (0.1, 0.5, 2.0, None):
        try:
            return where.delete_dir(folder)
        except FileNotFoundError:
            return None
        except OSError:
            if wait is None:
                raise
            time.sleep(wait)


FORMATS = (QuestionSets, EvaluationRuns)


def registered(spark: SparkSession) -> list[str]:
    """Make the formats known to a session; their names."""
    for cls in FORMATS:
        spark.dataSource.register(cls)
    return sorted(cls.name() for cls in FORMATS)
