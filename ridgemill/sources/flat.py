"""Flat pieces of bytes in the shared folder: tasks write them, tasks read the ones they need."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridgemill.tables import keep, qualified, shared_folder


def opened(path: str):
    """The store of a path with a scheme, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def shelve(pieces: DataFrame) -> DataFrame:
    """Write the bytes of `pieces` (key, data), a file per partition: (key, file,
    at, size). Each attempt of a task has a file of its own, and only those of
    attempts that ended well are listed."""
    folder = qualified(pieces.sparkSession, shared_folder(pieces.sparkSession))

    def run(batches):
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        name, at = f"{uuid.uuid4().hex}.flat", 0
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                keys, places, sizes = batch.column("key").to_pylist(), [], []
                for data in batch.column("data"):
                    raw = data.as_buffer()
                    out.write(raw)
                    places.append(at)
                    sizes.append(raw.size)
                    at += raw.size
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([f"{folder}/{name}"] * len(keys), pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "file", "at", "size"])

    listed = keep(pieces.selectExpr("cast(key as long) as key", "data").mapInArrow(run, "key long, file string, at long, size long"))
    listed.pieces_path = folder
    return listed


class Shelf:
    """Pieces by key: mapped into memory where the store is a file system, else
    read, each when it is asked for."""

    def __init__(self, listed: DataFrame) -> None:
        table = listed.toArrow()
        self.files = table.column("file").combine_chunks().dictionary_encode()
        self.files, which = self.files.dictionary.to_pylist(), self.files.indices.to_numpy(zero_copy_only=False)
        keys, at, size = (table.column(c).to_numpy() for c in ("key", "at", "size"))
        self.places = {int(k): (int(w), int(a), int(s)) for k, w, a, s in zip(keys, which, at, size, strict=True)}
        self.mapped: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return {"files": self.files, "places": self.places, "mapped": {}}

    def read(self, key: int, kind: str) -> np.ndarray | None:
        """The piece of `key` as numbers; None if there is none."""
        if key not in self.places:
            return None
        which, at, size = self.places[key]
        file = self.files[which]
        if not file.startswith("file:"):
            store, path = opened(file)
            with store.open_input_file(path) as source:
                return np.frombuffer(source.read_at(size, at), kind)
        if which not in self.mapped:
            self.mapped[which] = np.memmap(opened(file)[1], np.uint8, "r")
        return self.mapped[which][at : at + size].view(kind)
