"""A sink that publishes each batch of a result once, as a whole.

Tasks write a file per batch under a folder of their run that readers of Parquet
pass over. When all tasks have ended well, each batch's files are moved to
``batch_id=k`` and a mark is left that the batch is published. What an interrupted
run leaves is not marked: it is removed when its batch is published by a later one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ridgemill.sources.flat import opened

#: Folders that readers of Parquet pass over.
PENDING, PUBLISHED = "_pending", "_published"


def _entries(folder: str) -> tuple:
    from pyarrow import fs

    store, root = opened(folder)
    return store, root, {f.base_name: f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))}


def clear(folder: str) -> set[int]:
    """Remove what is in the folder."""
    store, root, entries = _entries(folder)
    for name, entry in entries.items():
        store.delete_dir(f"{root}/{name}") if not entry.is_file else store.delete_file(f"{root}/{name}")
    return set()


def published(folder: str, told: str) -> set[int]:
    """The batches that are published; an error where a run of other parameters did."""
    store, root, marks = _entries(f"{folder}/{PUBLISHED}")
    for name in marks:
        with store.open_input_file(f"{root}/{name}") as mark:
            if mark.read().decode() != told:
                raise ValueError(f"{folder} holds batches of a run with other parameters")
    return {int(name) for name in marks}


@dataclass
class _Written(WriterCommitMessage):
    files: list


class BatchSink(DataSource):
    """``df.write.format("ridge_batches")``: rows with batch_id. Options: folder, with
    its scheme, and told, the parameters of the run, which the marks hold."""

    @classmethod
    def name(cls) -> str:
        return "ridge_batches"

    def writer(self, schema, overwrite):
        return _BatchWriter(self.options["folder"], self.options["told"], uuid.uuid4().hex)


class _BatchWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, told: str, run: str) -> None:
        self.folder, self.told, self.run = folder, told, run

    def write(self, iterator):
        from pyarrow import parquet

        store, root = opened(self.folder)
        here, writers, files = f"{root}/{PENDING}/{self.run}", {}, []
        store.create_dir(here, recursive=True)
        for batch in iterator:
            for k in pc.unique(batch.column("batch_id")).to_pylist():
                part = pa.Table.from_batches([batch.filter(pc.equal(batch.column("batch_id"), k))]).drop_columns(["batch_id"])
                if k not in writers:
                    files.append((k, f"{uuid.uuid4().hex}.parquet"))
                    writers[k] = parquet.ParquetWriter(f"{here}/{files[-1][1]}", part.schema, filesystem=store)
                writers[k].write_table(part)
        for writer in writers.values():
            writer.close()
        return _Written(files)

    def commit(self, messages):
        store, root = opened(self.folder)
        by_batch = {}
        for k, file in (f for m in messages if m is not None for f in m.files):
            by_batch.setdefault(k, []).append(file)
        store.create_dir(f"{root}/{PUBLISHED}", recursive=True)
        for k, files in by_batch.items():
            place = f"{root}/batch_id={k}"
            store.create_dir(place, recursive=True)
            store.delete_dir_contents(place)
            for file in files:
                store.move(f"{root}/{PENDING}/{self.run}/{file}", f"{place}/{file}")
            with store.open_output_stream(f"{root}/{PUBLISHED}/{k}") as mark:
                mark.write(self.told.encode())
        self._tidy()

    def abort(self, messages):
        self._tidy()

    def _tidy(self) -> None:
        store, root, pending = _entries(f"{self.folder}/{PENDING}")
        if self.run in pending:
            store.delete_dir(f"{root}/{self.run}")
