"""Opening files of the shared folder on executors, by URI: local paths directly, other stores through pyarrow."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def open_write(uri: str):
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")  # noqa: SIM115
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def open_read(uri: str):
    """A seekable file."""
    path = _local(uri)
    if path is not None:
        return open(path, "rb")  # noqa: SIM115
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def make_folder(uri: str) -> None:
    path = _local(uri)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)


def list_files(uri: str, suffix: str) -> list[str]:
    """URIs of the files of a folder, in order of name; of a file: itself."""
    path = _local(uri)
    if path is not None:
        if os.path.isfile(path):
            return [path]
        return sorted(os.path.join(path, x) for x in os.listdir(path) if x.endswith(suffix))
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type == fs.FileType.File:
        return [uri]
    return sorted(f"{uri.rstrip('/')}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(suffix))
