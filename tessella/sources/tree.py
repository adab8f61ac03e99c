"""Trees of text files as a Spark data source: spark.read.format("source_tree") and df.write.format("source_tree").

Reading gives a row for each file (file_idx, path, text, error) in the order of
path components. The tree is listed folder by folder, several at a time, when
the scan is planned, and files travel to the tasks in shares of like size; a
task reads its own. What can't be read or is not UTF-8 has a typed error and no
text; a folder that is missing or can't be listed has no files. Paths may be
anything that pyarrow has a file system for (local, s3://, gs://, hdfs://).

Options: path; extension; exclude, a JSON list of globs; ignore_files, a JSON
list of names of ignore files; mentions, a JSON list of names of which a file
must hold one to be read at all; push, whether filters are pushed, which must be
spark.sql.python.filterPushdown.enabled. Then a filter that `text` contains something, or on
what `path` is, starts or ends with, is pushed into the scan: files that can't
pass are not sent to Python's decoder or not even opened.

Writing takes (path, content) rows. Tasks put files that differ from what is
there into a hidden folder of the write; when all tasks are done they are moved
to their places, and if one fails the folder is removed, so the old tree stays as
it was. A file with equal bytes is not touched.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from tessella.session import ship
from tessella.sources.ignore import Rule, excluding, ignored, parsed

#: Bytes and files that a task reads, about.
SHARE_BYTES, SHARE_FILES = 4 << 20, 512
#: Folders that are listed at a time.
LISTERS = 16


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


@dataclass(frozen=True)
class Folder:
    at: str
    parts: tuple[str, ...]
    layers: tuple[tuple[int, tuple[Rule, ...]], ...]  # (depth, rules) of the ignore files above
    seen: frozenset[str]  # real folders above, so that links cannot lead round in a circle


def listed(root: str, extension: str, exclude: list[str] = (), ignore_files: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], int]]:
    """(path components, bytes) of the files under root, or of root itself, in component order.

    Excludes come first; then the deepest ignore file that says something decides;
    then names with a leading dot go. Links are followed, but not in circles.
    """
    files, base = file_system(root)
    here = files.get_file_info(base)
    if here.type == pafs.FileType.File:
        ok = base.endswith(extension) and not ignored(root, False, excluding(list(exclude)))
        return [((), here.size or 0)] if ok else []
    top = excluding(list(exclude))

    def real(path: str) -> str:
        return os.path.realpath(path) if isinstance(files, pafs.LocalFileSystem) else path

    def visit(folder: Folder) -> tuple[list[tuple[tuple[str, ...], int]], list[Folder]]:
        try:
            entries = files.get_file_info(pafs.FileSelector(folder.at, allow_not_found=True))
        except OSError:
            return [], []
        layers = folder.layers
        for name in ignore_files:
            if any(e.base_name == name and e.type == pafs.FileType.File for e in entries):
                try:
                    with files.open_input_stream(posixpath.join(folder.at, name)) as f:
                        layers = (*layers, (len(folder.parts), tuple(parsed(f.read().decode(errors="replace").splitlines()))))
                except OSError:
                    pass
        found, below = [], []
        for e in entries:
            parts = (*folder.parts, e.base_name)
            is_folder = e.type == pafs.FileType.Directory
            said = ignored("/".join(parts), is_folder, top) or None
            for depth, rules in reversed(layers):
                if said is None:
                    said = ignored("/".join(parts[depth:]), is_folder, list(rules))
            if said or (said is None and e.base_name.startswith(".")):
                continue
            if is_folder:
                if real(e.path) not in folder.seen:
                    below.append(Folder(e.path, parts, layers, folder.seen | {real(e.path)}))
            elif e.type == pafs.FileType.File and e.base_name.endswith(extension):
                found.append((parts, e.size or 0))
        return found, below

    out, level = [], [Folder(base, (), (), frozenset({real(base)}))]
    with ThreadPoolExecutor(LISTERS) as pool:
        while level:
            done = list(pool.map(visit, level))
            out += [f for found, _ in done for f in found]
            level = [f for _, below in done for f in below]
    return sorted(out)


def undecodable(data: bytes, e: UnicodeDecodeError) -> str:
    """What is wrong from which byte on, and its line and column."""
    what = "incomplete utf-8 byte sequence" if e.reason == "unexpected end of data" else f"invalid utf-8 sequence of {e.end - e.start} bytes"
    line = data[: e.start].rpartition(b"\n")[2].decode()
    return f"invalid-utf8: {what} from index {e.start} ({data.count(bytes([10]), 0, e.start) + 1}:{len(line) + 1})"


class Share(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.extension = options.get("extension", "")
        self.exclude, self.ignore_files, self.mentions = (json.loads(options.get(n, "[]")) for n in ("exclude", "ignore_files", "mentions"))
        self.contains: list[str] = []
        self.paths: list[tuple[str, str]] = []

    def wanted(self, path: str) -> bool:
        tests = {"EqualTo": path.__eq__, "StringStartsWith": path.startswith, "StringEndsWith": path.endswith}
        return all(tests[kind](value) for kind, value in self.paths)

    def partitions(self) -> list[Share]:
        shares, held, size = [], [], 0
        for i, (parts, n) in enumerate(listed(self.root, self.extension, self.exclude, tuple(self.ignore_files))):
            path = "/".join(parts)
            if not self.wanted(path):
                continue
            if held and (size + n > SHARE_BYTES or len(held) == SHARE_FILES):
                shares.append(Share(held))
                held, size = [], 0
            held.append((i, path))
            size += n
        return [*shares, Share(held)]

    def read(self, partition: Share) -> Iterator[tuple]:
        files, base = file_system(self.root)
        any_of, all_of = [n.encode() for n in self.mentions], [n.encode() for n in self.contains]
        for i, path in partition.files:
            try:
                with files.open_input_stream(posixpath.join(base, path) if path else base) as f:
                    data = f.read()
            except OSError as e:
                if not all_of:
                    yield i, path, None, f"read-error: {e.strerror or type(e).__name__}"
                continue
            if any_of and not any(n in data for n in any_of) or not all(n in data for n in all_of):
                continue
            try:
                yield i, path, data.decode(), None
            except UnicodeDecodeError as e:
                if not all_of:
                    yield i, path, None, undecodable(data, e)


class PushingReader(TreeReader):
    """Spark takes a reader with pushFilters only while filters are pushed to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, StringContains) and f.attribute == ("text",):
                self.contains.append(f.value)
            elif isinstance(f, (EqualTo, StringStartsWith, StringEndsWith)) and f.attribute == ("path",):
                self.paths.append((type(f).__name__, f.value))
            else:
                yield f


@dataclass
class Staged(WriterCommitMessage):
    moves: list[tuple[str, str]]  # (staged, target)


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        files, base = file_system(self.root)
        # made here, once: a task that outlives its write finds no folder any more and leaves nothing
        self.staging = posixpath.join(base, f".writing-{uuid.uuid4().hex}")
        files.create_dir(self.staging, recursive=True)

    def write(self, iterator: Iterator) -> Staged:
        files, base = file_system(self.root)
        moves: list[tuple[str, str]] = []
        for row in iterator:
            target, data = posixpath.join(base, row["path"]), row["content"].encode()
            if files.get_file_info(target).type == pafs.FileType.File:
                with files.open_input_stream(target) as f:
                    if f.read() == data:
                        continue
            # a name of its own, as a task may be tried twice at once
            staged = posixpath.join(self.staging, uuid.uuid4().hex)
            with files.open_output_stream(staged) as f:
                f.write(data)
            moves.append((staged, target))
        return Staged(moves)

    def commit(self, messages: list[Staged | None]) -> None:
        files, _ = file_system(self.root)

        def move(staged_target: tuple[str, str]) -> None:
            files.create_dir(posixpath.dirname(staged_target[1]), recursive=True)
            files.move(*staged_target)

        with ThreadPoolExecutor(LISTERS) as pool:
            list(pool.map(move, [m for x in messages if x for m in x.moves]))
        files.delete_dir(self.staging)

    def abort(self, messages: list[Staged | None]) -> None:
        files, _ = file_system(self.root)
        if files.get_file_info(self.staging).type == pafs.FileType.Directory:
            files.delete_dir(self.staging)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "file_idx int, path string, text string, error string"

    def reader(self, schema) -> TreeReader:
        return (PushingReader if self.options.get("push") == "true" else TreeReader)(self.options)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SourceTree)


def whole(path: str) -> str:
    """The path as other processes understand it, whose working folder may be another."""
    return path if "://" in path else os.path.abspath(path)


PUSH = "spark.sql.python.filterPushdown.enabled"


def tree(spark: SparkSession, root: str, extension: str, exclude: list[str] = (), ignore_files: list[str] = (), mentions: list[str] = ()) -> DataFrame:
    """(file_idx, path, text, error) of the files under a folder; filters are pushed if the session pushes them to Python sources."""
    register(spark)
    lists = {"exclude": exclude, "ignore_files": ignore_files, "mentions": mentions}
    return spark.read.format("source_tree").option("extension", extension).option("push", spark.conf.get(PUSH, "false")).options(**{n: json.dumps(sorted(v)) for n, v in lists.items()}).load(whole(root))


def write_tree(files: DataFrame, root: str) -> None:
    """Put (path, content) rows under a folder, all of them or none; files with equal bytes stay untouched."""
    register(files.sparkSession)
    files.select("path", "content").write.format("source_tree").mode("append").save(whole(root))
