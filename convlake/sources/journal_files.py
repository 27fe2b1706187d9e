"""Lines of journals that are appended to, rotated and truncated, as a streaming data source.

A file is known by its first whole line, not by its name: a rotated file keeps what was read of it under its new name, and a file that
begins anew is a new one. Offsets are bytes behind the last whole line, so a line that is still being written is held back until its end
is there. A batch is the same bytes whenever it is read again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, offset long, line string"
#: Bytes of a file that one task reads, and that are looked at at once when a line's end is sought.
PART_BYTES, LOOK_BYTES = 64 << 20, 1 << 16


class Piece(InputPartition):
    """The lines that begin at low or later and before high; the file's lines of this batch end at stop."""

    def __init__(self, name: str, identity: str, first: int, low: int, high: int, stop: int):
        self.name, self.identity, self.first, self.low, self.high, self.stop = name, identity, first, low, high, stop


class Journals:
    """The files of a folder whose names begin with a prefix, in any file system that Arrow knows."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
        self.folder, _, self.prefix = path.rpartition("/")

    def names(self) -> list[str]:
        from pyarrow import fs

        infos = self.fs.get_file_info(fs.FileSelector(self.folder or "/", allow_not_found=True))
        return sorted(i.path for i in infos if i.type == fs.FileType.File and i.base_name.startswith(self.prefix))

    def read(self, name: str, low: int, n: int) -> bytes:
        try:
            with self.fs.open_input_file(name) as f:
                size = f.size()
                return f.read_at(min(n, size - low), low) if low < size else b""
        except FileNotFoundError:
            return b""

    def identity(self, name: str) -> str | None:
        """A digest of the first whole line; None if there is none yet."""
        digest, at = hashlib.sha256(), 0
        while block := self.read(name, at, LOOK_BYTES):
            end = block.find(b"\n")
            digest.update(block[: end + 1] if end >= 0 else block)
            if end >= 0:
                return digest.hexdigest()[:32]
            at += len(block)
        return None

    def whole_lines(self, name: str) -> int:
        """Bytes up to the last line's end."""
        info = self.fs.get_file_info(name)
        to = info.size or 0
        while to > 0:
            low = max(0, to - LOOK_BYTES)
            found = self.read(name, low, to - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            to = low
        return 0

    def ends(self) -> dict[str, list]:
        """By identity the name and the bytes of whole lines; of files with one identity (a copy in a rotation) the longest."""
        out: dict[str, list] = {}
        for name in self.names():
            identity = self.identity(name)
            if identity is not None:
                end = self.whole_lines(name)
                if identity not in out or out[identity][1] < end:
                    out[identity] = [name, end]
        return out


class JournalReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri, self.part_bytes = options["path"], int(options.get("partbytes", PART_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": Journals(self.uri).ends()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for identity, (name, stop) in sorted(end["files"].items()):
            first = start["files"].get(identity, [name, 0])[1]
            first = 0 if first > stop else first  # the same first line, but less behind it: it began anew
            pieces += [Piece(name, identity, first, low, min(low + self.part_bytes, stop), stop) for low in range(first, stop, self.part_bytes)]
        return pieces

    def read(self, partition: Piece) -> Iterator[tuple]:
        journals, name = Journals(self.uri), partition.name
        if journals.identity(name) != partition.identity:  # renamed since the offset was taken
            name = next((n for n in journals.names() if journals.identity(n) == partition.identity and journals.whole_lines(n) >= partition.stop), None)
            if name is None:
                raise FileNotFoundError(f"the journal {partition.name} was rotated away before bytes {partition.low} to {partition.high} were read")
        at, held = partition.low, b""
        if partition.low > partition.first:  # the line that is under way belongs to the piece before
            at, held = partition.low - 1, None
        while at < partition.stop:
            block = journals.read(name, at, min(LOOK_BYTES, partition.stop - at))
            if not block:
                raise EOFError(f"{name} became shorter while it was read")
            at += len(block)
            if held is None:
                end = block.find(b"\n")
                if end < 0:
                    continue
                block, held = block[end + 1 :], b""
            *lines, rest = (held + block).split(b"\n")
            begin = at - len(held) - len(block)
            for line in lines:
                if begin >= partition.high:
                    return
                if line.strip():
                    yield partition.identity, begin, line.decode("utf-8", "replace")
                begin += len(line) + 1
            held = rest
            if begin >= partition.high:
                return

    def commit(self, end: dict) -> None:
        pass


class JournalSource(DataSource):
    """Format "journal": option path is a folder and the beginning of the files' names, partbytes the bytes that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> JournalReader:  # noqa: N802
        return JournalReader({k.lower(): v for k, v in self.options.items()})


def journal_lines(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """A stream of (file, offset, line): each whole line of each journal once; blank lines are passed over."""
    spark.dataSource.register(JournalSource)
    return spark.readStream.format("journal").option("partbytes", part_bytes).load(path)


def journal_events(lines: DataFrame, schema: str) -> DataFrame:
    """The lines that are JSON objects, as columns; others are left out, fields that are missing or of another kind are null."""
    parsed = lines.withColumn("_json", F.try_parse_json("line")).where(F.schema_of_variant("_json").startswith("OBJECT"))
    return parsed.select("file", "offset", F.from_json("line", schema).alias("_event")).select("file", "offset", "_event.*")


def position(checkpoint_offset: str) -> dict[str, int]:
    """Bytes read of each file, from an offset as a checkpoint keeps it."""
    return {identity: end for identity, (_, end) in json.loads(checkpoint_offset)["files"].items()}
