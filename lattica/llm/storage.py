"""Byte streams of executors in the shared folder, whatever store it is in."""

from __future__ import annotations

import pyarrow.fs as fs


def _place(uri: str):
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def open_output(uri: str):
    store, path = _place(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_input(uri: str):
    store, path = _place(uri)
    return store.open_input_stream(path, compression=None)
