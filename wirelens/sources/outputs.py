"""Many outputs of different columns in one job, committed together.

Every output's rows are packed, batch by batch, as Arrow messages, so all
outputs share one plan and one write. A task opens a file for each output it
meets, in a staging folder. The driver's commit first writes a manifest of all
files under one new name: that rename is the commit. Then the files move to
their places, and files that were there before go. If the driver dies before the
rename, no output has changed; if it dies after it, ``recover`` (which every
later write calls) moves the rest from the manifest.

Layout: ``<path>/<output>/[<into>/]part-....parquet`` beside ``_staged`` and
``_commits``, whose names Spark's readers skip.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wirelens.sources.captures import store_of

FORMATS = ("parquet", "csv")
PACKED = "output string, data binary"
#: Rows of one message that a task hands on at once are cut to about this size.
PACK_ROWS = 20_000


def _pack(output: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, PACK_ROWS))
                data = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([output]), data], ["output", "data"])

    return run


def _writer(fmt: str, sink, schema: pa.Schema):
    if fmt == "csv":
        from pyarrow import csv

        return csv.CSVWriter(sink, schema)
    from pyarrow import parquet

    return parquet.ParquetWriter(sink, schema)


class _Files(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files  # (output, staged path)


def _files_in(store, folder: str) -> list[str]:
    from pyarrow import fs

    return [f.path for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File]


def _put(store, path: str, content: bytes) -> None:
    """A file that is there whole or not at all."""
    with store.open_output_stream(path + ".tmp") as out:
        out.write(content)
    store.move(path + ".tmp", path)


def _finish(store, root: str, manifest: str) -> None:
    """Move a committed write's files to their places, drop what it replaces, and forget the manifest."""
    from pyarrow import fs

    with store.open_input_stream(manifest) as f:
        told = json.loads(f.read())
    for staged, final in told["files"]:
        # a file that an earlier attempt has moved is no longer staged
        if store.get_file_info(staged).type == fs.FileType.File:
            store.create_dir(final.rpartition("/")[0])
            store.move(staged, final)
    keep = {final for _, final in told["files"]}
    for folder in told["replaced"]:
        for path in _files_in(store, folder):
            if path not in keep:
                store.delete_file(path)
    if store.get_file_info(told["staging"]).type == fs.FileType.Directory:
        store.delete_dir(told["staging"])
    store.delete_file(manifest)


def recover(path: str) -> int:
    """Finish committed writes that were cut off; returns their number."""
    store, root = store_of(path)
    manifests = [m for m in _files_in(store, f"{root}/_commits") if m.endswith(".json")]
    for manifest in manifests:
        _finish(store, root, manifest)
    return len(manifests)


class OutputsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.into, self.format = options["path"], options.get("into") or "", options.get("kind") or "parquet"
        self.schemas = json.loads(options["schemas"])
        self.job = uuid.uuid4().hex[:12]

    def _schema(self, output: str) -> pa.Schema:
        return pa.ipc.read_schema(pa.py_buffer(base64.b64decode(self.schemas[output])))

    def _new_file(self, store, root: str, output: str, part: int):
        folder = f"{root}/_staged/{self.job}/{output}"
        store.create_dir(folder)
        path = f"{folder}/part-{part:05d}-{uuid.uuid4().hex[:12]}.{self.format}"
        sink = store.open_output_stream(path)
        return path, sink, _writer(self.format, sink, self._schema(output))

    def write(self, iterator):
        from pyspark import TaskContext

        store, root = store_of(self.path)
        part, held = TaskContext.get().partitionId(), {}
        for batch in iterator:
            for output, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if output not in held:
                    held[output] = self._new_file(store, root, output, part)
                with pa.ipc.open_stream(data.as_buffer()) as rows:
                    for packed in rows:
                        held[output][2].write_table(pa.Table.from_batches([packed]).cast(self._schema(output)))
        for _, sink, writer in held.values():
            writer.close()
            sink.close()
        return _Files([(output, path) for output, (path, _, _) in held.items()])

    def _empty(self, store, root: str, output: str) -> tuple[str, str]:
        """A file without rows, so that an output that never had any can be read."""
        path, sink, writer = self._new_file(store, root, output, 0)
        writer.write_table(self._schema(output).empty_table())
        writer.close()
        sink.close()
        return output, path

    def commit(self, messages):
        from pyarrow import fs

        store, root = store_of(self.path)
        recover(self.path)
        staged = [f for m in messages if m is not None for f in m.files]
        for output in sorted(set(self.schemas) - {o for o, _ in staged}):
            if not self.into or store.get_file_info(f"{root}/{output}").type == fs.FileType.NotFound:
                staged.append(self._empty(store, root, output))
        place = lambda output: "/".join(p for p in (root, output, self.into) if p)
        told = {
            "files": [[path, f"{place(output)}/{path.rpartition('/')[2]}"] for output, path in staged],
            "replaced": [place(output) for output in self.schemas],
            "staging": f"{root}/_staged/{self.job}",
        }
        store.create_dir(f"{root}/_commits")
        manifest = f"{root}/_commits/{self.job}.json"
        _put(store, manifest, json.dumps(told).encode())
        _finish(store, root, manifest)

    def abort(self, messages):
        from pyarrow import fs

        store, root = store_of(self.path)
        folder = f"{root}/_staged/{self.job}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class OutputsSink(DataSource):
    @classmethod
    def name(cls):
        return "wirelens_outputs"

    def schema(self):
        return PACKED

    def writer(self, schema, overwrite):
        return OutputsWriter(self.options)


def write_outputs(spark: SparkSession, outputs: dict[str, DataFrame], path: str, into: str = "", fmt: str = "parquet") -> None:
    """Write all ``outputs`` (by folder name) under ``path`` in one job; each replaces what was in its folder ``into``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if fmt not in FORMATS:
        raise ValueError(f"outputs are written as {' or '.join(FORMATS)}, not {fmt}")
    if not outputs:
        return
    spark.dataSource.register(OutputsSink)
    schemas = {n: base64.b64encode(to_arrow_schema(df.schema).serialize().to_pybytes()).decode() for n, df in outputs.items()}
    packed = reduce(DataFrame.unionAll, [df.mapInArrow(_pack(n), PACKED) for n, df in outputs.items()])
    writer = packed.write.format("wirelens_outputs").mode("append").option("schemas", json.dumps(schemas))
    writer.option("into", into).option("kind", fmt).save(path)
