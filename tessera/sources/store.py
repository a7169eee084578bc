"""Files written and read by executors: local paths, and stores that Arrow's file systems know."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator


@contextlib.contextmanager
def open_out(uri: str) -> Iterator:
    """A file that appears under its name when it is complete, so that a second attempt replaces it whole."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if uri.startswith("/") or "://" not in uri:
        os.makedirs(os.path.dirname(uri) or ".", exist_ok=True)
        made = f"{uri}.{uuid.uuid4().hex}.tmp"
        with open(made, "wb") as f:
            yield f
        os.replace(made, uri)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    made = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(made) as f:
        yield f
    store.move(made, path)


def read_bytes(uri: str) -> bytes | None:
    """A whole file, or None if there is none."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    try:
        if uri.startswith("/") or "://" not in uri:
            with open(uri, "rb") as f:
                return f.read()
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(path) as f:
            return f.read()
    except (FileNotFoundError, IsADirectoryError):
        return None
