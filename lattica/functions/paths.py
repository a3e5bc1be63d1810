"""File names as column functions, and one for plain strings."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F


def join(folder: Column, name: Column) -> Column:
    """folder/name, with one slash between them."""
    return F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), name)


def folder(path: Column) -> Column:
    """What stands before the last slash; . where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def without_folder(path: Column) -> Column:
    """What stands after the last slash."""
    return F.regexp_extract(path, "([^/]*)$", 1)


def with_extension(path: Column, extension: str) -> Column:
    """The path with another extension; a dot of a folder is none."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(extension))


def file_name(uri: str) -> str:
    return unquote(uri.rpartition("/")[2])
