"""Files through a file-system interface, whatever holds them."""

from __future__ import annotations

import re

from pyarrow import fs


def filesystem_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; a path without a scheme is local."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def first_bytes(path: str, size: int, start: int = 0) -> bytes | None:
    """``size`` bytes from ``start`` on, fewer at the file's end; None if they can't be read."""
    try:
        system, place = filesystem_of(path)
        with system.open_input_file(place) as file:
            file.seek(start)
            return file.read(size)
    except (OSError, ValueError):
        return None
