"""Files that tasks write to a folder which all machines share."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and its path there."""
    if not urlsplit(uri).scheme:
        uri = f"file://{uri}"
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def put(folder: str, name: str, data: bytes) -> None:
    """Write under a temporary name, then rename.

    A task that runs twice writes the same bytes under the same name, so either copy may win.
    """
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    temporary = f"{path}/_tmp-{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    try:
        store.move(temporary, f"{path}/{name}")
    except OSError:  # some stores don't rename onto a file
        if store.get_file_info(f"{path}/{name}").size != len(data):
            raise
        store.delete_file(temporary)


def get(folder: str, name: str, n_bytes: int) -> bytes:
    """The bytes of a file that a manifest lists; an error if it is missing or of another size."""
    store, path = filesystem(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        data = f.read()
    if len(data) != n_bytes:
        raise ValueError(f"{name} has {len(data)} bytes, its manifest says {n_bytes}")
    return data


def dealt(manifest: DataFrame, most: int = 20_000) -> DataFrame:
    """A manifest with a task for each file, up to ``most`` tasks."""
    return manifest.repartition(max(1, min(most, manifest.count())))
