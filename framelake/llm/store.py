"""Binary files in the shared folder, for executors and the driver; any scheme that pyarrow opens."""

from __future__ import annotations

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    system, path = _open(uri)
    system.create_dir(path, recursive=True)


def writer(uri: str):
    system, path = _open(uri)
    return system.open_output_stream(path)


def reader(uri: str):
    system, path = _open(uri)
    return system.open_input_file(path)


def put(uri: str, data: bytes) -> None:
    with writer(uri) as out:
        out.write(data)


def get(uri: str) -> bytes:
    with reader(uri) as file:
        return file.read()


def exists(uri: str) -> bool:
    system, path = _open(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def remove(uri: str) -> None:
    """Delete a folder; it may be gone already."""
    system, path = _open(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
