"""Properties of catalog rows as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.functions.scalar import apply_chain

#: Suffixes of archives whose members have a path ``<archive>:<member>``.
ARCHIVES = ["zip", "cbz", "epub", "ods", "odt", "odp", "docx", "xlsx", "pptx", "xps"]
_ANY = "|".join([*ARCHIVES, *(a.upper() for a in ARCHIVES)])
_MEMBER = rf"^(.*\.(?:{_ANY})):(.*)$"


def _path(path: Column | None) -> Column:
    return F.col("path") if path is None else path


def is_archived(path: Column | None = None) -> Column:
    return _path(path).rlike(_MEMBER)


def is_archive(path: Column | None = None) -> Column:
    """Whether a path is an archive itself; members of archives are not."""
    return ~is_archived(path) & _path(path).rlike(rf"\.(?:{_ANY})$")


def archive(path: Column | None = None) -> Column:
    """Path of the containing archive, empty outside; the last marker wins."""
    return F.regexp_extract(_path(path), _MEMBER, 1)


def member(path: Column | None = None) -> Column:
    return F.regexp_extract(_path(path), _MEMBER, 2)


def container(path: Column | None = None) -> Column:
    """The file that holds the item: its archive, or itself."""
    return F.when(is_archived(path), archive(path)).otherwise(_path(path))


def name(path: Column | None = None) -> Column:
    inner = F.when(is_archived(path), member(path)).otherwise(_path(path))
    return F.substring_index(inner, "/", -1)


def suffix(path: Column | None = None) -> Column:
    return F.regexp_extract(name(path), r"\.([^.]*)$", 1)


def complete_base_name(path: Column | None = None) -> Column:
    return F.regexp_replace(name(path), r"\.[^.]*$", "")


def dir_path(path: Column | None = None) -> Column:
    """The archive of a member, else what precedes the last slash."""
    return F.when(is_archived(path), archive(path)).otherwise(F.regexp_extract(_path(path), r"^(.*)/[^/]*$", 1))


def rel_path(path: Column, root: str) -> Column:
    head = root.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substr(path, F.lit(len(head) + 1))).otherwise(path)


def compression_ratio() -> Column:
    w, h, size = F.col("width"), F.col("height"), F.col("file_size")
    return F.when(size > 0, w * h * 3 / size).otherwise(F.lit(1.0))


def first_tag(meta: Column, *tags: str) -> Column:
    """First non-null of several metadata keys; the family prefix is optional and upper-cased at its front."""
    found = []
    for tag in tags:
        found += [meta[tag], meta[tag[:1].upper() + tag[1:]]]
    return F.coalesce(*found)


def properties() -> dict[str, Column]:
    """Registry of property names; columns are built when asked for."""
    return {
        **{n: F.col(n) for n in ("id", "md5", "type", "path", "width", "height", "score", "modified", "created")},
        "contentType": F.col("content_type"),
        "matchFlags": F.col("match_flags"),
        "isWeed": F.col("match_flags").bitwiseAND(16) != 0,
        "isValid": F.col("id") != 0,
        "name": name(),
        "suffix": suffix(),
        "completeBaseName": complete_base_name(),
        "dirPath": dir_path(),
        "archive": archive(),
        "isArchived": is_archived(),
        "fileSize": F.col("file_size"),
        "aspectRatio": F.col("width") / F.when(F.col("height") > 0, F.col("height")),
        "resolution": F.col("width") * F.col("height"),
        "res": F.greatest("width", "height"),
        "compressionRatio": compression_ratio(),
    }


def expression(text: str) -> Column:
    """``prop#func,arg#func`` as a column; ``exif#Tag`` and its like read the metadata map."""
    head, *chain = text.split("#")
    if head in ("exif", "iptc", "xmp", "ffmeta", "text"):
        tags, *chain = chain
        prefix = {"exif": "Exif.", "iptc": "Iptc.", "xmp": "Xmp."}.get(head, "")
        keys = [k if k.startswith(prefix) else prefix + k[:1].upper() + k[1:] for k in tags.split(",")]
        return apply_chain(first_tag(F.col("meta"), *keys), chain)
    known = properties()
    if head not in known:
        raise ValueError(f"unknown property: {head}")
    return apply_chain(known[head], chain)
