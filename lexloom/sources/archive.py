"""Documentation archives: JSON files in archives inside an archive, unpacked when the archive has changed."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

from pyarrow import fs as arrow_fs

from lexloom.sources.files import opened

TAG = ".etag"


def entries(archive: io.BufferedIOBase) -> Iterator[tuple[str, bytes]]:
    """Base name and content of the JSON files of an archive and of those inside it."""
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if name.endswith(".zip"):
                yield from entries(io.BytesIO(z.read(name)))
            elif name.endswith(".json"):
                yield posixpath.basename(name), z.read(name)


def refreshed(archive: str, target: str, tag: str | None = None) -> bool:
    """Unpack the archive into a folder, unless that was made from the archive as it is; whether it was unpacked. tag: what tells
    versions of the archive apart, such as a server's entity tag; its size and time by default. The tag is written last."""
    fs, path, _ = opened(archive)
    out, folder, _ = opened(target)
    info = fs.get_file_info(path)
    tag = tag or f"{info.size}-{info.mtime_ns}"
    mark = posixpath.join(folder, TAG)
    if out.get_file_info(mark).type == arrow_fs.FileType.File:
        with out.open_input_stream(mark) as f:
            if f.read().decode() == tag:
                return False
    if out.get_file_info(folder).type == arrow_fs.FileType.Directory:
        out.delete_dir_contents(folder)
    out.create_dir(folder, recursive=True)
    with fs.open_input_file(path) as f:
        for name, content in entries(f):
            with out.open_output_stream(posixpath.join(folder, name)) as o:
                o.write(content)
    with out.open_output_stream(mark) as o:
        o.write(tag.encode())
    return True
