"""Whole files in the shared folder from Python workers: local paths, or any store that pyarrow knows."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


class Store:
    """Files below a path or URI; a file appears under its name only when it is complete."""

    def __init__(self, top: str):
        self.top, self.fs = top.rstrip("/"), None
        scheme = urlparse(top).scheme
        if scheme in ("", "file"):
            self.root = unquote(urlparse(top).path) if scheme else self.top
            self.root = self.root.rstrip("/")
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(self.top)

    def create(self):
        """A new temporary file: (name, writable)."""
        name = f"{self.root}/.tmp-{uuid.uuid4().hex}"
        if self.fs:
            self.fs.create_dir(self.root, recursive=True)
            return name, self.fs.open_output_stream(name)
        os.makedirs(self.root, exist_ok=True)
        return name, open(name, "wb")  # noqa: SIM115

    def commit(self, temporary: str, name: str) -> None:
        """Give a temporary file its name; a repeated task puts the same bytes there again."""
        if self.fs:
            self.fs.move(temporary, f"{self.root}/{name}")
        else:
            os.replace(temporary, f"{self.root}/{name}")

    def open(self, name: str):
        if self.fs:
            return self.fs.open_input_file(f"{self.root}/{name}")
        return open(f"{self.root}/{name}", "rb")  # noqa: SIM115
