"""Lists of addresses as a stream whose offsets are positions in the log: the name of a file, and bytes in it.

A list is a folder of text files, or folders of them, in the order of their names (what write_uri_list() wrote, one after the other, a
dump's logs, or one file that grows). Files before the last are whole; the last may grow, and a line counts once its end is there. A stream that is stopped goes on behind the last
line that it has taken, so each line comes once. Only the ends of files are looked at to see how far the log goes; executors read the
lines, by ranges of bytes. The folder has to be in a store that pyarrow reads (local, S3, HDFS ...).
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a range that one task reads, and of a look at a file's end.
RANGE, LOOK = 64 << 20, 1 << 16
SCHEMA = "file string, byte long, uri string"


@dataclass
class Piece(InputPartition):
    """Lines of a file that start at a byte from `first` on and before `end`."""

    name: str
    first: int
    end: int


def pieces(name: str, first: int, end: int) -> list[Piece]:
    return [Piece(name, at, min(at + RANGE, end)) for at in range(first, end, RANGE)]


class UriLogReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def _files(self) -> list[tuple[str, int]]:
        """Names below the folder and sizes of the log's files, in order; hidden ones and marks are none."""
        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        return sorted((f.path[len(root) :].lstrip("/"), f.size) for f in found if f.is_file and f.size and f.base_name[0] not in "._")

    def _last_line_end(self, name: str, size: int) -> int:
        store, root = self._store()
        with store.open_input_file(f"{root}/{name}") as f:
            upto = size
            while upto:
                f.seek(low := max(0, upto - LOOK))
                cut = f.read(upto - low).rfind(b"\n")
                if cut >= 0:
                    return low + cut + 1
                upto = low
        return 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "byte": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self._files()
        if not files:
            return self.initialOffset()
        name, size = files[-1]
        return {"file": name, "byte": self._last_line_end(name, size)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for name, size in self._files():
            if start["file"] <= name <= end["file"]:
                out += pieces(name, start["byte"] if name == start["file"] else 0, end["byte"] if name == end["file"] else size)
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        store, root = self._store()
        with io.BufferedReader(store.open_input_file(f"{root}/{partition.name}")) as f:
            at = partition.first
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the rest of a line that began before
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                spot = at
                for part in re.split(b"(\r)", line.rstrip(b"\n")):
                    uri = part.decode("utf-8", "replace")
                    if uri.strip() and not uri.startswith("#"):
                        yield partition.name, spot, uri
                    spot += len(part)
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class UriLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "uri_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> UriLogReader:  # noqa: N802
        return UriLogReader(self.options["path"])


def follow_list(spark: SparkSession, path: str):
    """file, byte, uri of each address of a list, as a stream; (file, byte) is its position in the log."""
    spark.dataSource.register(UriLog)
    return spark.readStream.format("uri_log").option("path", path).load()
