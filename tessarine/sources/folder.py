"""A data source for folders of many files: partitions pack small files by bytes, and each kind of file has a parser of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Rows: a page each, with what its parser says of it as JSON. Bytes of a partition; what a file counts beyond its own, for opening it.
SCHEMA = "path string, kind string, page int, text string, stats string, modified_us long"
PART_BYTES, OPEN_BYTES = 32 << 20, 64 << 10
Parser = Callable[[bytes], list[tuple[int, str, str | None]]]


def plain_text(raw: bytes) -> list[tuple[int, str, str | None]]:
    """A file of text is one page."""
    return [(1, raw.decode("utf-8", "replace"), None)]


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


def packed(files: list[tuple[str, int, int]], most: int, extra: int = OPEN_BYTES) -> list[Files]:
    """Files (path, bytes, modified) dealt into partitions, the largest first, each to the fullest that it fits into beside the last few."""
    open_: list[tuple[int, list]] = []
    done: list[list] = []
    for f in sorted(files, key=lambda f: (-f[1], f[0])):
        size = f[1] + extra
        k = next((k for k, (held, _) in enumerate(open_) if held + size <= most), None)
        if k is None:
            open_.append((size, [f]))
            if len(open_) > 8:
                done.append(open_.pop(0)[1])
        else:
            held, some = open_[k]
            some.append(f)
            open_[k] = (held + size, some)
    return [Files(sorted(some)) for some in [*done, *(x for _, x in open_)]]


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def listed(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """Path, bytes and time of change of the files below a folder with one of the suffixes; none if there is no folder. Names that begin with a dot or _ are left out."""
    from pyarrow import fs

    system, folder = _system(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
    return sorted((f.path, f.size, f.mtime_ns // 1000) for f in found if f.is_file and f.base_name[0] not in "._" and f.base_name.lower().endswith(suffixes))


def pages(path: str, files: list[tuple[str, int, int]], parsers: dict[str, Parser]) -> Iterator[tuple]:
    """The pages of files; one that its parser can't read has a row without a page, whose stats name the error."""
    import json

    system, _ = _system(path)
    for name, _, modified in files:
        suffix = next(s for s in parsers if name.lower().endswith(s))
        with system.open_input_stream(name) as stream:
            raw = stream.read()
        try:
            for page, text, stats in parsers[suffix](raw):
                yield name, suffix.lstrip("."), page, text, stats, modified
        except Exception as e:  # noqa: BLE001 -- a broken file is a row, not the end of the job
            yield name, suffix.lstrip("."), None, None, json.dumps({"error": str(e)}), modified


def folder_source(parsers: dict[str, Parser], part_bytes: int = PART_BYTES) -> type[DataSource]:
    """A data source of this name and these parsers by suffix, for spark.dataSource.register()."""
    suffixes = tuple(parsers)

    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.path = path

        def partitions(self) -> list[InputPartition]:
            return packed(listed(self.path, suffixes), part_bytes)

        def read(self, partition: Files) -> Iterator[tuple]:
            yield from pages(self.path, partition.files if partition else [], parsers)

    class StreamReader(DataSourceStreamReader):
        """New and changed files in the order of their times; a file that appears with a time before the last batch's is not seen."""

        def __init__(self, path: str):
            self.path = path

        def initialOffset(self) -> dict:
            return {"us": -1, "path": ""}

        def latestOffset(self) -> dict:
            last = max(((m, p) for p, _, m in listed(self.path, suffixes)), default=(-1, ""))
            return {"us": last[0], "path": last[1]}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            low, high = (start["us"], start["path"]), (end["us"], end["path"])
            return packed([f for f in listed(self.path, suffixes) if low < (f[2], f[0]) <= high], part_bytes)

        def read(self, partition: Files) -> Iterator[tuple]:
            yield from pages(self.path, partition.files, parsers)

        def commit(self, end: dict) -> None:
            pass

    class Folder(DataSource):
        @classmethod
        def name(cls) -> str:
            return "folder"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["path"])

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(self.options["path"])

    return Folder


TEXTS: dict[str, Parser] = {".md": plain_text, ".markdown": plain_text, ".txt": plain_text}


def read_folder(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None, part_bytes: int = PART_BYTES, stream: bool = False) -> DataFrame:
    """Pages (SCHEMA) of the files below a folder that all executors see, as a table or as a stream. Only files with a parser's suffix are read."""
    spark.dataSource.register(folder_source(parsers or TEXTS, part_bytes))
    return (spark.readStream if stream else spark.read).format("folder").option("path", path).load()
