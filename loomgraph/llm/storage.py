"""Byte files in the shared folder, from Python workers.

Spark has no sink for plain bytes, so archives are written through Arrow's file
systems under the uri of the shared folder (file, hdfs and s3 alike).  Names hold
a random part and are reported in a committed table: files of lost or repeated
task attempts are never read.
"""

from __future__ import annotations


def open_fs(uri: str):
    """(file system, path) of a uri or an absolute path."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
