"""Paths and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = (".jpg", ".jpeg", ".png")


def extension_set(names) -> set[str]:
    """In lower case, with a leading dot."""
    return {n if n.startswith(".") else f".{n}" for n in (x.strip().lower() for x in names) if n}


def extension(path: Column) -> Column:
    """The last name's suffix in lower case; empty without one. A leading dot begins no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def has_extension(path: Column, names=EXTENSIONS) -> Column:
    return extension(path).isin(sorted(extension_set(names)))


def clean_path(path: Column) -> Column:
    r"""Without the long-path prefixes \\?\UNC\ and \\?\."""
    return F.regexp_replace(F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\"), r"^\\\\\?\\", "")


def is_unc(path: Column) -> Column:
    return path.startswith("\\\\") | path.startswith("//")


def is_network_path(path: Column) -> Column:
    """On another machine by its form: a share, or a URI of another scheme than file."""
    return is_unc(path) | (path.rlike("^[A-Za-z][A-Za-z0-9+.-]+:/") & ~F.lower(path).startswith("file:"))


def normalize_key(path: Column) -> Column:
    """Without empty and . parts, and with .. parts folded; a leading slash stays, and what leads above it goes."""
    parts = F.filter(F.split(clean_path(path), "/"), lambda p: (p != "") & (p != "."))
    rooted = path.startswith("/")
    step = lambda done, p: F.when(
        p != "..", F.concat(done, F.array(p))
    ).when((F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.concat(done, F.array(p)))
    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(F.size(done) == 0, F.when((p == "..") & rooted, done).otherwise(F.array(p))).otherwise(step(done, p))), "/")
    return F.when(rooted, F.concat(F.lit("/"), folded)).when(folded == "", ".").otherwise(folded)


def thumb_name(key: Column) -> Column:
    return F.concat(F.sha1(key.cast("binary")), F.lit(".jpg"))


def family_of(path: Column) -> Column:
    """The last name, up to its first underscore."""
    return F.split(F.element_at(F.split(path, "/"), -1), "_")[0]
