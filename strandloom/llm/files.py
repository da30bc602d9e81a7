"""Files in the shared folder, from driver and executors alike."""

from __future__ import annotations

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file given as a URI or an absolute path."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
