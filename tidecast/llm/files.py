"""Files of our own formats in the shared folder, written and read by tasks through Arrow's file systems."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pfs


def located(uri: str) -> tuple[pfs.FileSystem, str]:
    """File system and path of a URI or an absolute path; Hadoop's names for object stores are understood."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    uri = re.sub(r"^file:/(?=[^/])", "file:///", uri)
    return pfs.FileSystem.from_uri(uri)


def new_file(folder: str, part: int, ending: str):
    """A stream to a file that no other attempt of a task writes, and its URI.

    Only the rows of an attempt that succeeded name its files, so what a lost executor left behind is never read.
    """
    uri = f"{folder.rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex}.{ending}"
    system, path = located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None), uri


def open_file(uri: str):
    """A file to read ranges of."""
    system, path = located(uri)
    return system.open_input_file(path)
