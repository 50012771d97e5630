"""A Python data source: `spark.read.format("tidelog")` reads one stream of a log from an offset, `readStream` follows it.

Options: log (the folder of an engine's log, its `messages` folder, or a folder of message files, on any
file system that Arrow knows), path (the stream), offset (default: from the start). Of an engine's log,
committed batches since the stream's creation are read. A log or stream without messages gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset string, nbytes int, data binary"


class LogFile(InputPartition):
    """The messages of one file past an offset, up to another where that is given; no file: none."""

    def __init__(self, file: str | None, after: str, upto: str | None = None) -> None:
        self.file, self.after, self.upto = file, after, upto


class Folder:
    """What of a log's files holds a stream's messages."""

    def __init__(self, log: str, path: str) -> None:
        from pyarrow.fs import FileSystem

        uri = log.rstrip("/")
        self.files, self.root = FileSystem.from_uri(uri.replace("file:///", "/").replace("file:/", "/")) if uri.startswith("file:") else FileSystem.from_uri(uri)
        if not self._below(f"{self.root}/current") and self._below(f"{self.root.rpartition('/')[0]}/current") and self.root.endswith("/messages"):
            self.root = self.root.rpartition("/")[0]
        self.path = path

    def _below(self, folder: str) -> list[str]:
        from pyarrow.fs import FileSelector, FileType

        found = self.files.get_file_info(FileSelector(folder, allow_not_found=True, recursive=True))
        return sorted(f.path for f in found if f.type == FileType.File and f.path.endswith(".parquet"))

    def _rows(self, file: str, columns: list[str], filters=None) -> list[dict]:
        import pyarrow.parquet as pq

        return pq.read_table(file, columns=columns, filters=filters, filesystem=self.files, partitioning=None).to_pylist()

    def _streams(self) -> tuple[dict[int, str], list[dict]] | None:
        """Of an engine's log: its committed versions by number, and what the last one knows of the stream; None: a plain folder."""
        entries = self._below(f"{self.root}/current")
        if not entries:
            return None
        versions = {r["n"]: r["version"] for f in entries for r in self._rows(f, ["n", "version"])}
        last = self._below(f"{self.root}/streams/{versions[max(versions)]}")
        return versions, [r for f in last for r in self._rows(f, ["path", "born", "current_offset"], [("path", "=", self.path)])]

    def message_files(self) -> list[str]:
        known = self._streams()
        if known is None:
            return self._below(self.root)
        versions, mine = known
        return [f for r in mine for n, v in sorted(versions.items()) if n >= r["born"] for f in self._below(f"{self.root}/messages/version={v}")]

    def tail(self) -> str:
        """The offset of the stream's last message; empty where it has none."""
        known = self._streams()
        if known is not None:
            return max((r["current_offset"] for r in known[1]), default="")
        found = (r["offset"] for f in self._below(self.root) for r in self._rows(f, ["offset"], [("path", "=", self.path)]))
        return max(found, default="")

    def messages(self, part: LogFile) -> Iterator[tuple]:
        wanted = [("path", "=", self.path)] + ([("offset", ">", part.after)] if part.after else []) + ([("offset", "<=", part.upto)] if part.upto is not None else [])
        for r in sorted(self._rows(part.file, ["path", "offset", "nbytes", "data"], wanted), key=lambda r: r["offset"]):
            yield (r["path"], r["offset"], r["nbytes"], r["data"])


def start_of(options: dict) -> str:
    given = options.get("offset", "-1")
    return "" if given in ("", "-1") else given


class LogReader(DataSourceReader):
    """One partition a file; statistics of offsets let row groups be skipped."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[LogFile]:
        found = Folder(self.options["log"], self.options["path"]).message_files()
        return [LogFile(f, start_of(self.options)) for f in found] or [LogFile(None, "")]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        return iter(()) if partition.file is None else Folder(self.options["log"], self.options["path"]).messages(partition)


class LogFollower(DataSourceStreamReader):
    """Progress is the offset of the last message, so a restart goes on where it stopped. The driver learns the tail; files are read by tasks."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def _folder(self) -> Folder:
        return Folder(self.options["log"], self.options["path"])

    def initialOffset(self) -> dict:
        return {"offset": start_of(self.options)}

    def latestOffset(self) -> dict:
        return {"offset": max(self._folder().tail(), start_of(self.options))}

    def partitions(self, start: dict, end: dict) -> list[LogFile]:
        return [LogFile(f, start["offset"], end["offset"]) for f in self._folder().message_files()] or [LogFile(None, "")]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        return iter(()) if partition.file is None else self._folder().messages(partition)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogFollower:
        return LogFollower(self.options)
