"""A streaming source over append-only logs of chunks, and a sink whose triggers are committed as a whole.

``spark.dataSource.register(ChunkLog)`` makes both known as the format ``chunk_log``. The source's offsets are bytes a file, so
that a replay reads exactly the lines of the first time. The sink's files count only once the driver has written the
trigger's list of them: a trigger that fails leaves nothing, and one that is run again after its commit changes nothing.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

CHUNKS = "key string, at long, seq long, chunk string, is_exit boolean"
KINDS = pa.schema([("key", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("chunk", pa.string()), ("is_exit", pa.bool_())])
#: Bytes of a file that a task reads, lines that it gives at a time, bytes that are looked through backwards for a line's end.
PIECE, LINES, TAIL = 16 << 20, 10_000, 1 << 16
#: Files that a task of the sink keeps open.
OPEN = 64


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, which driver and executors share, and the path on it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def row_of(line: bytes) -> tuple:
    """key, at, seq, chunk, is_exit; a line that isn't such an object gives its text as a chunk without a key."""
    try:
        r = json.loads(line)
        row = (r["key"], r["at"], r["seq"], r.get("chunk", ""), r.get("is_exit", False))
        if all(type(v) is t for v, t in zip(row, (str, int, int, str, bool), strict=True)) and all(-(1 << 63) <= v < 1 << 63 for v in row[1:3]):
            return row
    except (ValueError, KeyError, TypeError, AttributeError):
        pass
    return None, None, None, line.decode("utf-8", "replace"), None


@dataclass
class Piece(InputPartition):
    """Lines that begin in [begin, end) of a file."""

    file: str
    begin: int
    end: int


class LogFolder:
    """The files ``*.jsonl`` of a folder, by name."""

    def __init__(self, options: dict):
        self.path, self.piece = options["path"], int(options.get("pieceBytes", PIECE))

    def ends(self, known: dict[str, int]) -> dict[str, int]:
        """Where each file's last whole line ends; files that haven't grown beyond ``known`` aren't opened."""
        system, root = opened(self.path)
        out = {}
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.is_file and f.base_name.endswith(".jsonl"):
                start = known.get(f.base_name, 0)
                if f.size < start:
                    raise ValueError(f"{f.base_name} is shorter than what was read of it: logs may only grow")
                out[f.base_name] = start if f.size == start else self.last_line(system, f, start)
        return out

    @staticmethod
    def last_line(system: fs.FileSystem, f: fs.FileInfo, start: int) -> int:
        with system.open_input_file(f.path) as file:
            end = f.size
            while end > start:
                begin = max(start, end - TAIL)
                file.seek(begin)
                at = file.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return start

    def pieces(self, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
        out = []
        for name, stop in sorted(end.items()):
            for a in range(start.get(name, 0), stop, self.piece):
                out.append(Piece(name, a, min(a + self.piece, stop)))
        return out

    def rows(self, p: Piece) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        with system.open_input_file(posixpath.join(root, p.file)) as file:
            at = max(0, p.begin - 1)
            file.seek(at)
            held, lines = b"", []
            skip = p.begin > 0  # up to the end of the line that the byte before belongs to
            while at < p.end or held:
                got = file.read(1 << 20)
                if not got and not held:
                    break
                *whole, held_next = (held + got).split(b"\n")
                base = at
                for w in whole:
                    begin, base = base, base + len(w) + 1
                    if skip:
                        skip = False
                    elif begin < p.end and w.strip():
                        lines.append(row_of(w))
                    if begin >= p.end:
                        break
                if base >= p.end or not got:
                    break
                at, held = base, held_next
                while len(lines) >= LINES:
                    yield self.batch(lines[:LINES])
                    lines = lines[LINES:]
        for i in range(0, len(lines), LINES):
            yield self.batch(lines[i : i + LINES])

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS.types, strict=True)], schema=KINDS)


class ChunkStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.seen = LogFolder(options), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.seen |= self.folder.ends(self.seen)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.seen = {k: max(v, self.seen.get(k, 0)) for k, v in end.items()}
        return self.folder.pieces(start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        """Logs stay as they are; whoever writes them may drop what is committed."""


class ChunkTable(DataSourceReader):
    """All whole lines there are now."""

    def __init__(self, options: dict):
        self.folder = LogFolder(options)

    def partitions(self) -> list[Piece]:
        return self.folder.pieces({}, self.folder.ends({}))

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class CommittedSink(DataSourceStreamArrowWriter):
    """Parquet files below ``data``, a subfolder for each value of the column that the option ``by`` names, and below
    ``commits`` a list of files for each trigger."""

    def __init__(self, options: dict):
        self.path, self.by = options["path"], options.get("by")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        writers: dict[str, pq.ParquetWriter] = {}
        files: list[str] = []

        def put(folder: str, rows: pa.Table) -> None:
            if folder not in writers:
                if len(writers) >= OPEN:
                    writers.pop(next(iter(writers))).close()
                name = posixpath.join("data", folder, uuid.uuid4().hex + ".parquet")
                system.create_dir(posixpath.join(root, "data", folder), recursive=True)
                files.append(name)
                writers[folder] = pq.ParquetWriter(posixpath.join(root, name), rows.schema, filesystem=system)
            writers[folder].write_table(rows)

        try:
            for b in iterator:
                rows = pa.Table.from_batches([b])
                if not self.by:
                    put("", rows)
                    continue
                codes = rows[self.by].combine_chunks().dictionary_encode()
                for i, v in enumerate([*codes.dictionary.to_pylist(), None]):
                    at = pc.is_null(codes.indices) if v is None and i == len(codes.dictionary) else pc.equal(codes.indices, i)
                    own = rows.filter(at)
                    if own.num_rows:
                        put(f"{self.by}={'__HIVE_DEFAULT_PARTITION__' if v is None else str(v).replace('/', '%2F')}", own)
        except BaseException:
            for w in writers.values():
                w.close()
            self.remove(files)
            raise
        for w in writers.values():
            w.close()
        return Written(files)

    def remove(self, files: list[str]) -> None:
        system, root = opened(self.path)
        for f in files:
            at = posixpath.join(root, f)
            if system.get_file_info(at).type != fs.FileType.NotFound:
                system.delete_file(at)

    def commit(self, messages: list, batchId: int) -> None:
        system, root = opened(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        to = posixpath.join(root, "commits", f"{batchId}.json")
        if system.get_file_info(to).type != fs.FileType.NotFound:  # committed before, but the query ended before it knew
            self.remove(files)
            return
        system.create_dir(posixpath.dirname(to), recursive=True)
        part = posixpath.join(root, f"{uuid.uuid4().hex}.part")
        with system.open_output_stream(part) as out:
            out.write("".join(json.dumps({"batch": batchId, "file": f}) + "\n" for f in files).encode())
        system.move(part, to)

    def abort(self, messages: list, batchId: int) -> None:
        self.remove([f for m in messages if m is not None for f in m.files])


class ChunkLog(DataSource):
    """Format ``chunk_log``. Options: ``path``; of the source ``pieceBytes``; of the sink ``by``."""

    @classmethod
    def name(cls) -> str:
        return "chunk_log"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> ChunkTable:
        return ChunkTable(self.options)

    def streamReader(self, schema) -> ChunkStream:
        return ChunkStream(self.options)

    def streamWriter(self, schema, overwrite: bool) -> CommittedSink:
        return CommittedSink(self.options)


def chunk_log(spark: SparkSession, folder: str, piece: int = PIECE) -> DataFrame:
    """The stream of a folder's chunks: (key, at, seq, chunk, is_exit). Lines that aren't chunks come without a key."""
    spark.dataSource.register(ChunkLog)
    return spark.readStream.format("chunk_log").option("path", folder).option("pieceBytes", piece).load()


def committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What a sink's triggers have committed. The lists are read by Spark; a file's name is held by the driver, as with any read."""
    system, root = opened(folder)
    if system.get_file_info(posixpath.join(root, "commits")).type == fs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    names = spark.read.schema("batch long, file string").json(f"{folder}/commits/*.json").select("file").collect()
    return spark.read.schema(schema).parquet(*[f"{folder}/{r.file}" for r in names]) if names else spark.createDataFrame([], schema)
