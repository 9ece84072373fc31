"""Small files of the catalog and of snapshots, on any file system that Arrow knows."""

from __future__ import annotations

import json
import os
import uuid

from pyarrow import fs


class Folder:
    """A folder by path or URI; files are written whole and then moved into place."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self.system, self.path = fs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (fs.LocalFileSystem(), self.uri)

    def sub(self, name: str) -> Folder:
        return Folder(f"{self.uri}/{name}")

    def read(self, name: str):
        """The JSON value of a file; None if there is none."""
        at = f"{self.path}/{name}"
        if self.system.get_file_info(at).type == fs.FileType.NotFound:
            return None
        with self.system.open_input_stream(at) as f:
            return json.loads(f.read())

    def write(self, name: str, value) -> None:
        self.system.create_dir(self.path, recursive=True)
        with self.system.open_output_stream(f"{self.path}/{name}.new") as f:
            f.write(json.dumps(value, ensure_ascii=False).encode())
        self.system.move(f"{self.path}/{name}.new", f"{self.path}/{name}")

    def create(self, name: str, value, spark=None) -> bool:
        """Write a file unless it exists; of several writers at once one succeeds.  False if it exists.

        Local files are linked into place; elsewhere the session's Hadoop file system creates the file exclusively."""
        raw = json.dumps(value, ensure_ascii=False).encode()
        self.system.create_dir(self.path, recursive=True)
        if isinstance(self.system, fs.LocalFileSystem):
            mine = f"{self.path}/{name}.{uuid.uuid4().hex}"
            with open(mine, "wb") as f:
                f.write(raw)
            try:
                os.link(mine, f"{self.path}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(mine)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")
        system = at.getFileSystem(conf)
        if system.exists(at):
            return False
        try:
            out = system.create(at, False)
        except Exception:  # a Java exception: another writer was faster, or the folder can't be written
            if system.exists(at):
                return False
            raise
        out.write(bytearray(raw))
        out.close()
        return True

    def names(self, prefix: str) -> list[str]:
        found = self.system.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.startswith(prefix))

    def delete(self) -> None:
        if self.system.get_file_info(self.path).type == fs.FileType.Directory:
            self.system.delete_dir(self.path)
