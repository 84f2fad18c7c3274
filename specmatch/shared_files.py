"""Files in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np


def local(path: str) -> str | None:
    """The path as the operating system has it, if the shared folder is mounted."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def write(path: str, parts: list[np.ndarray]) -> None:
    """Write whole or not at all: a retried or duplicated task replaces the file by the same bytes."""
    there = local(path)
    if there is not None:
        os.makedirs(os.path.dirname(there), exist_ok=True)
        temporary = f"{there}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            for part in parts:
                f.write(np.ascontiguousarray(part).tobytes())
        os.replace(temporary, there)
        return
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    temporary = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as f:
        for part in parts:
            f.write(np.ascontiguousarray(part).tobytes())
    system.move(temporary, at)


def mapped(path: str) -> np.ndarray:
    """The file's bytes, memory-mapped. From a store that is not mounted a copy is fetched once, mapped and unlinked."""
    there = local(path)
    if there is not None:
        return np.memmap(there, np.uint8, "r") if os.path.getsize(there) else np.zeros(0, np.uint8)
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with tempfile.NamedTemporaryFile() as copy, system.open_input_stream(at) as f:
        while block := f.read(1 << 24):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, np.uint8, "r") if copy.tell() else np.zeros(0, np.uint8)
