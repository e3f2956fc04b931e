"""Paths in archives as column expressions.  A path that is refused becomes null; path_error says why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve(path: Column) -> Column:
    """Splits at either separator, drops empty and `.` parts; `.` if none is left; null if refused."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: (p != "") & (p != "."))
    bad = F.exists(parts, lambda p: (p == "..") | p.contains(":"))
    return F.when(~bad, F.when(F.size(parts) == 0, F.lit(".")).otherwise(F.array_join(parts, "/")))


def resolve_error(path: Column) -> Column:
    parts = F.split(path, r"[/\\]")
    return F.when(F.exists(parts, lambda p: p == ".."), "parent").when(F.exists(parts, lambda p: p.contains(":")), "prefix")


def sanitize(path: Column) -> Column:
    """A path of the platform without its root and `.` parts; null if it has a `..` part or nothing is left."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.when(~F.exists(parts, lambda p: p == "..") & (F.size(parts) > 0), F.array_join(parts, "/"))


def sanitize_error(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.when(F.exists(parts, lambda p: p == ".."), "parent").when(F.size(parts) == 0, "empty")


def to_archive(path: Column) -> Column:
    return F.translate(path, "/", "\\")


def from_archive(path: Column) -> Column:
    return sanitize(F.translate(path, "\\", "/"))


def joined(directory: Column, name: Column, separator: str) -> Column:
    """The directory, if there is one, then the name; with a separator unless the directory ends in one."""
    head = F.when(directory.isNull(), "").when(directory.rlike(r"[/\\]$"), directory).otherwise(F.concat(directory, F.lit(separator)))
    return F.concat(head, name)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """What stands before the last part; empty if there is only one."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def stem(name: Column) -> Column:
    """The name without its last extension; a leading dot starts none."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def is_root(parent_: Column) -> Column:
    return (parent_ == "") | (parent_ == ".")
