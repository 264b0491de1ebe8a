"""Opening files by the paths Spark reports, on the executors."""

from __future__ import annotations

from urllib.parse import quote


def open_store(path: str):
    """The file system of a path and the path within it.

    Spark's paths are plain: a blank, ``%`` or ``#`` in a name stands for itself.
    """
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        scheme, rest = "file", path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if rest.startswith("/") else rest
    if scheme in ("s3a", "s3n"):
        scheme = "s3"
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")
