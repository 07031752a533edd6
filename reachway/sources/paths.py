"""Files that readers open at any place, on any store: plain paths and file: URIs are local, other URIs (hdfs, s3, gs, abfs) go through Arrow's file systems, on the driver and on workers alike."""

from __future__ import annotations

import urllib.parse
import uuid


def located(path: str):
    """(file system, path within it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = urllib.parse.unquote(urllib.parse.urlparse(path).path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    """A binary file that can be read and sought; use it in a with statement."""
    system, own = located(path)
    return system.open_input_file(own)


def size(path: str) -> int | None:
    """Bytes of a file; None where there is none."""
    system, own = located(path)
    return system.get_file_info(own).size


def exists(path: str) -> bool:
    from pyarrow.fs import FileType

    system, own = located(path)
    return system.get_file_info(own).type is not FileType.NotFound


def write_bytes(path: str, data: bytes) -> None:
    """One file, with the folders above it."""
    system, own = located(path)
    system.create_dir(own.rpartition("/")[0], recursive=True)
    with system.open_output_stream(own) as out:
        out.write(data)


def replace_bytes(path: str, data: bytes) -> None:
    """One file that readers see whole or not at all: written beside its place and moved there."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    write_bytes(beside, data)
    system, own = located(path)
    system.move(located(beside)[1], own)


def read_bytes(path: str) -> bytes | None:
    """A file's content; None where there is none."""
    if not exists(path):
        return None
    with opened(path) as f:
        return f.read()


def delete(path: str) -> None:
    """A folder or file with all that it holds; nothing where there is none."""
    from pyarrow.fs import FileType

    system, own = located(path)
    kind = system.get_file_info(own).type
    if kind is FileType.Directory:
        system.delete_dir(own)
    elif kind is not FileType.NotFound:
        system.delete_file(own)
