"""Random-access files on local disk or any filesystem that pyarrow reaches (gs://, hdfs://, s3://).

Remote reads go through a window of 4 MiB that is fetched anew only on a miss.
"""

from __future__ import annotations

import contextlib
import logging
import os
import posixpath
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs

from cellstrata.format.errors import FormatError

log = logging.getLogger("cellstrata.storage")
WINDOW = 4 << 20


def log_requests() -> None:
    """Has this process tell every read of storage on its standard error."""
    if not log.handlers:
        told = logging.StreamHandler()
        told.setFormatter(logging.Formatter("%(name)s: %(message)s"))
        log.addHandler(told)
        log.setLevel(logging.DEBUG)


def split_bucket(path: str) -> tuple[str, str] | None:
    """(bucket, object) of a gs:// path, or None for any other; a path without a bucket is none."""
    if not path.startswith("gs://"):
        return None
    bucket, _, name = path[5:].partition("/")
    return (bucket, name) if bucket else None


def join_path(base: str, *parts: str) -> str:
    """Remote parts are joined as they are, local ones cleaned."""
    if "://" in base:
        return "/".join([base.rstrip("/"), *[p.strip("/") for p in parts]])
    return os.path.normpath(os.path.join(base, *parts))


_schemes: dict[str, Callable[[str], tuple[pafs.FileSystem, str]]] = {}


def register_scheme(scheme: str, opener: Callable[[str], tuple[pafs.FileSystem, str]]) -> None:
    """Has paths of a scheme opened by ``opener``, which gives a filesystem and the path on it."""
    _schemes[scheme] = opener


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    scheme = path.split("://")[0] if "://" in path else ""
    if scheme in _schemes:
        return _schemes[scheme](path)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(path)
    return pafs.FileSystem.from_uri(path)


class RandomAccess:
    """Reads byte ranges of one file; closes with its ``with`` block."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.path, self._f = path, fs.open_input_file(at)
        self.size = self._f.size()
        self._window = WINDOW if "://" in path and not path.startswith("file:") else 0
        self._at, self._held = 0, b""

    def read_at(self, offset: int, n: int) -> bytes:
        if offset < 0 or n < 0 or offset + n > self.size:
            raise FormatError(f"{n} bytes at {offset} of a file of {self.size}")
        if not self._window:
            return self._fetch(offset, n)
        if not (self._at <= offset and offset + n <= self._at + len(self._held)):
            self._at, self._held = offset, self._fetch(offset, min(max(n, self._window), self.size - offset))
        return self._held[offset - self._at : offset - self._at + n]

    def _fetch(self, offset: int, n: int) -> bytes:
        began = time.perf_counter()
        out = self._f.read_at(n, offset)
        log.debug("read %d bytes at %d of %s in %.3f s", n, offset, self.path, time.perf_counter() - began)
        if len(out) != n:
            raise FormatError("file cut short")
        return out

    def close(self) -> None:
        self._f.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class InMemory:
    """The same over bytes."""

    def __init__(self, data: bytes, path: str = "<memory>"):
        self.data, self.path, self.size = data, path, len(data)

    def read_at(self, offset: int, n: int) -> bytes:
        if offset < 0 or n < 0 or offset + n > self.size:
            raise FormatError(f"{n} bytes at {offset} of a file of {self.size}")
        return self.data[offset : offset + n]

    def close(self) -> None:
        pass


def read_file(path: str) -> bytes | None:
    """A whole small file, or None if there is none."""
    fs, at = filesystem(path)
    if fs.get_file_info(at).type != pafs.FileType.File:
        return None
    with fs.open_input_file(at) as f:
        return f.readall()


@contextlib.contextmanager
def writing(path: str) -> Iterator[pa.NativeFile]:
    """A stream that is the file once it ends well: written beside and renamed, so a task that is run twice leaves one whole file."""
    fs, at = filesystem(path)
    fs.create_dir(posixpath.dirname(at), recursive=True)
    beside = f"{at}.{os.getpid()}.{time.time_ns()}.tmp"
    try:
        with fs.open_output_stream(beside) as f:
            yield f
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(beside)
        raise
    fs.move(beside, at)


def write_file(path: str, data: bytes) -> None:
    with writing(path) as f:
        f.write(data)


def list_dir(path: str) -> list[str]:
    """Names of the files of one level."""
    fs, at = filesystem(path)
    return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if i.type == pafs.FileType.File)


def list_sizes(path: str) -> list[tuple[str, int]]:
    """A file itself, or the files of a folder and below that do not start with a dot or underscore, with their sizes."""
    fs, at = filesystem(path)
    own = fs.get_file_info(at)
    if own.type == pafs.FileType.File:
        return [(path, own.size)]
    found = [i for i in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if i.type == pafs.FileType.File]
    keep = sorted((i.path, i.size) for i in found if not any(p[0] in "._" for p in posixpath.relpath(i.path, at).split("/")) and not i.path.endswith(".tmp"))
    prefix = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return [(prefix + f, size) for f, size in keep]


def list_files(path: str) -> list[str]:
    return [f for f, _ in list_sizes(path)]
