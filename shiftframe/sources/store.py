"""Files of any store that pyarrow can open, from tasks and from the driver, in bounded pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from ..errors import IntegrityError

PIECE = 1 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is a local one."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def require_shared(spark: SparkSession, folder: str) -> str:
    """The folder as a URI that all machines see. Local paths are refused on a cluster, but for those below the folders that it shares."""
    uri = str(folder)
    uri = (uri if "://" in uri else "file://" + uri.removeprefix("file:")).rstrip("/")
    if uri.startswith("file://") and not spark.sparkContext.master.startswith("local["):
        shared = [spark.conf.get(x, None) for x in ("spark.checkpoint.dir", "spark.sql.warehouse.dir")]
        tops = ["file:///" + x.removeprefix("file:").strip("/") for x in shared if x and x.startswith(("file:", "/"))]
        if not any(uri == top or uri.startswith(top + "/") for top in tops):
            raise IntegrityError(f"{uri} is a folder of one machine; give one that all machines share")
    return uri


def pieces(path: str, size: int = PIECE) -> Iterator[bytes]:
    fs, at = opened(path)
    with fs.open_input_stream(at, compression=None) as f:
        while part := f.read(size):
            yield part


def digest(path: str) -> tuple[int, str]:
    """Bytes and SHA-256 of a file, read in pieces."""
    n, sha = 0, hashlib.sha256()
    for part in pieces(path):
        n += len(part)
        sha.update(part)
    return n, sha.hexdigest()


def read_text(path: str) -> str:
    return b"".join(pieces(path)).decode()


def write_text(path: str, text: str) -> None:
    fs, at = opened(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as f:
        f.write(text.encode())


def names(folder: str) -> list[str]:
    """Paths of all files below a folder, relative to it; none if there is no folder. Names are driver work, contents are not."""
    fs, at = opened(folder)
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True, recursive=True))
    return sorted(x.path.removeprefix(at.rstrip("/") + "/") for x in found if x.type == pafs.FileType.File and not x.base_name.startswith("."))


def remove(path: str) -> None:
    fs, at = opened(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        fs.delete_file(at)
