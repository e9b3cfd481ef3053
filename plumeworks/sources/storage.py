"""Files of any store that Arrow knows, by path or URI."""

from __future__ import annotations

import re

from pyarrow.fs import FileSystem


def storage(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI as Spark names it, and the path in it."""
    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path)))
