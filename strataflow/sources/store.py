"""Files of a shared folder, through pyarrow's file systems: a path or a URL of file, HDFS, S3 or GCS."""

from __future__ import annotations

import json
import uuid

import pyarrow.fs as pafs


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, path.rstrip("/")


def files_in(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files right in a folder, by name; none if it does not exist."""
    fs, path = opened(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File)


def write_json(folder: str, name: str, value: object) -> None:
    """A small JSON file, which appears whole or not at all."""
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(json.dumps(value, indent=1, sort_keys=True).encode())
    fs.move(part, f"{path}/{name}")


def read_json(folder: str, name: str) -> object | None:
    """The value of a JSON file, or None if it does not exist."""
    fs, path = opened(folder)
    if fs.get_file_info(f"{path}/{name}").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
        return json.loads(f.read())


def removed(fs: pafs.FileSystem, path: str) -> None:
    """Deletes a folder, or a file, if it is there."""
    kind = fs.get_file_info(path).type
    if kind == pafs.FileType.Directory:
        fs.delete_dir(path)
    elif kind == pafs.FileType.File:
        fs.delete_file(path)
