"""Files by path or URI, local or on any file system the workers can reach."""

import fnmatch
import uuid
from urllib.parse import urlparse

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if urlparse(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path or uri
    return pafs.FileSystem.from_uri(uri)


def exists(uri: str) -> bool:
    fs, at = opened(uri)
    return fs.get_file_info(at).type != pafs.FileType.NotFound


def is_folder(uri: str) -> bool:
    fs, at = opened(uri)
    return fs.get_file_info(at).type == pafs.FileType.Directory


def read(uri: str) -> bytes:
    """FileNotFoundError if there is no such file."""
    fs, at = opened(uri)
    with fs.open_input_file(at) as f:
        return f.read()


def write(uri: str, data: bytes) -> None:
    """A file whole or not at all: a sibling of a unique name, then moved; the sibling is removed on an error."""
    fs, at = opened(uri)
    part = f"{at}.{uuid.uuid4().hex}.tmp"
    fs.create_dir(at.rpartition("/")[0] or "/", recursive=True)
    try:
        with fs.open_output_stream(part) as f:
            f.write(data)
        fs.move(part, at)
    except BaseException:
        if fs.get_file_info(part).type != pafs.FileType.NotFound:
            fs.delete_file(part)
        raise


def matching(pattern: str) -> list[str]:
    """Paths that match a pattern whose folders may hold * ? and []; sorted. A path without these is itself."""
    if not any(c in pattern for c in "*?["):
        return [pattern]
    scheme = f"{urlparse(pattern).scheme}://" if urlparse(pattern).scheme else ""
    fs, at = opened(pattern)
    found = ["/" if at.startswith("/") else "."]
    for part in [p for p in at.split("/") if p]:
        if any(c in part for c in "*?["):
            found = [i.path for f in found if fs.get_file_info(f).type == pafs.FileType.Directory for i in fs.get_file_info(pafs.FileSelector(f)) if fnmatch.fnmatchcase(i.base_name, part)]
        else:
            found = [p for f in found if fs.get_file_info(p := f"{f.rstrip('/')}/{part}").type != pafs.FileType.NotFound]
    return sorted(scheme + f for f in found)
