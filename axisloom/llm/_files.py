"""Files of numpy arrays in the shared folder, written by tasks and mapped into memory by tasks."""

from __future__ import annotations

import struct
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs



def _local(base: str) -> str | None:
    """The folder as a path, if it is one that is mounted."""
    if base.startswith("file:"):
        return "/" + base[5:].lstrip("/")
    return base if base.startswith("/") else None


def write_arrays(base: str, name: str, arrays: list[np.ndarray]) -> None:
    body = struct.pack("<q", len(arrays))
    heads, at = [], 8 + 40 * len(arrays)
    for a in arrays:
        at = at + 63 & ~63
        heads.append(struct.pack("<qq24s", at, len(a), a.dtype.str.encode()))
        at += a.nbytes
    body += b"".join(heads)
    fs, root = (pafs.LocalFileSystem(), path) if (path := _local(base)) else pafs.FileSystem.from_uri(base)
    fs.create_dir(root, recursive=True)
    part = f"{root}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(body)
        at = len(body)
        for a in arrays:
            out.write(b"\0" * (-at % 64))
            at += -at % 64 + a.nbytes
            out.write(np.ascontiguousarray(a).tobytes())
    fs.move(part, f"{root}/{name}")


def mapped_arrays(base: str, name: str) -> list[np.ndarray]:
    """The file's arrays, mapped; a file of a remote store is first copied to an unlinked one."""
    if path := _local(base):
        whole = np.memmap(f"{path}/{name}", np.uint8, "r")
    else:
        fs, root = pafs.FileSystem.from_uri(base)
        with tempfile.TemporaryFile() as copy, fs.open_input_stream(f"{root}/{name}") as src:
            while chunk := src.read(1 << 22):
                copy.write(chunk)
            copy.flush()
            whole = np.memmap(copy, np.uint8, "r")
    (n,) = struct.unpack("<q", whole[:8].tobytes())
    out = []
    for i in range(n):
        at, size, kind = struct.unpack("<qq24s", whole[8 + 40 * i : 48 + 40 * i].tobytes())
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        out.append(whole[at : at + size * dtype.itemsize].view(dtype))
    return out
