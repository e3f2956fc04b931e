"""Files by path or URI.  A resolver, given as 'module:function', may stand in for all of this: it takes a path and
returns a seekable binary file."""

from __future__ import annotations

import importlib
from typing import Any

import pyarrow.fs as pafs


def at(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def open_file(path: str, resolver: str = "") -> Any:
    if resolver:
        module, _, name = resolver.partition(":")
        return getattr(importlib.import_module(module), name)(path)
    fs, inner = at(path)
    return fs.open_input_file(inner)


def size(path: str) -> int | None:
    """The file's size; none if there is no such file."""
    fs, inner = at(path)
    info = fs.get_file_info(inner)
    return info.size if info.type == pafs.FileType.File else None


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """The file itself, or the files of a directory by name, with their sizes."""
    fs, inner = at(path)
    info = fs.get_file_info(inner)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = fs.get_file_info(pafs.FileSelector(inner))
    return sorted((scheme + i.path, i.size) for i in inside if i.type == pafs.FileType.File and i.path.endswith(suffix))


def sibling(path: str, name: str) -> str:
    head, slash, _ = path.rpartition("/")
    return f"{head}{slash}{name}"


def make_dirs(path: str) -> None:
    fs, inner = at(path)
    fs.create_dir(inner, recursive=True)


def move(source: str, target: str) -> None:
    fs, inner = at(source)
    fs.move(inner, at(target)[1])


def remove(path: str) -> None:
    fs, inner = at(path)
    if fs.get_file_info(inner).type == pafs.FileType.File:
        fs.delete_file(inner)


def writer(path: str) -> Any:
    fs, inner = at(path)
    return fs.open_output_stream(inner)


def drop(out: Any, paths: list[str]) -> None:
    """Closes a file that isn't wanted any more and removes what was written."""
    if out:
        out.close()
    for p in filter(None, paths):
        remove(p)
