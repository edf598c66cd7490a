"""Files below the shared folder, from inside tasks, by URI (file, hdfs, s3, gs, ...)."""

from __future__ import annotations


def filesystem(uri: str):
    """(file system, path on it)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))
    return system, path


def create(uri: str):
    """Output stream to a new file; missing folders are made."""
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def mapped(uri: str, dtype: str):
    """A file's values as an array: memory-mapped if the file system is mounted, else read."""
    import numpy as np
    from pyarrow import fs

    system, path = filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        import os

        return np.memmap(path, dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)
