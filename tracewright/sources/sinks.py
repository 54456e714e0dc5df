"""Named files written by the executors."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.scratch import written
from tracewright.shipping import ship


def named_files(rows: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """(keys, paths): of each row (keys, name, texts by ending) the files ``folder``/name.ending, and where they are.

    Each task writes the files of its rows, to any store that Arrow can open; a file gets its name when it is whole, so a
    task that is run again only writes the same files again. The rows with the paths are written to the shared folder,
    which makes this one job and not a lazy one. Two rows of one name are an error.
    """
    twice = rows.groupBy("name").count().filter("count > 1").select("name").limit(1).collect()
    if twice:
        raise ValueError(f"two files of the name {twice[0]['name']!r}")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder)) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            paths = []
            for row in batch.select(["name", "texts"]).to_pylist():
                done = {}
                for ending, text in row["texts"]:
                    path = f"{root.rstrip('/')}/{row['name']}.{ending}"
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    with store.open_output_stream(part) as out:
                        out.write((text or "").encode())
                    store.move(part, path)
                    done[ending] = path
                paths.append(list(done.items()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(paths, pa.map_(pa.string(), pa.string()))], [*keys, "paths"])

    kinds = dict(rows.dtypes)
    ship(rows.sparkSession)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", paths map<string,string>"
    return written(rows.select(*keys, "name", "texts").mapInArrow(put, schema), "paths")
