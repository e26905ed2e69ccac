"""Files in the shared folder, opened from tasks by URI."""

from __future__ import annotations

import pyarrow.fs


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store named by ``uri`` and the path in it; a bare path is a mounted folder."""
    return pyarrow.fs.FileSystem.from_uri(uri)


def create(uri: str):
    """Open ``uri`` for writing; its folder is made where the store has folders."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_random(uri: str):
    """Open ``uri`` for reading at any offset."""
    store, path = filesystem(uri)
    return store.open_input_file(path)


def listed(uri: str, suffix: str) -> list[str]:
    """Paths, to be opened like ``uri``, of the folder's files that end in ``suffix``, in order."""
    store, path = filesystem(uri)
    files = store.get_file_info(pyarrow.fs.FileSelector(path))
    return sorted(f"{uri.rstrip('/')}/{f.base_name}" for f in files if f.is_file and f.base_name.endswith(suffix))
