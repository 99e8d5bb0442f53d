"""ISO 10303-21 exchange files: a splittable Spark data source, the same scan over any binary column, and writing parts back.

A record is ``#id=TYPE(...);``. Strings and comments are skipped when references are gathered; a complex record has type CPLX. A record's
``row`` is the byte at which it starts, which keeps file order without counting.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, row long, id long, type string, len int, text binary, refs array<long>"
HEAD = re.compile(rb"#(\d+)=\s*([A-Za-z0-9_]*)\s*\(")
BODY = re.compile(rb"'(?:[^']|'')*'|/\*.*?\*/|#(\d+)|;", re.S)
OPENING = re.compile(rb"['#;]|/\*")
LINE = re.compile(rb"\n#\d+=")
DATA = b"\nDATA;"
COMPLEX = "CPLX"
CHUNK = 32 << 20


class Unterminated(ValueError):
    """A record has no end before the data's end."""


def records(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, str, int, bytes, list[int]]]:
    """(start, id, type, length, text, references) of the records that begin in data[start:end]; the last may go on beyond ``end``."""
    end = len(data) if end is None else end
    at = start
    while (head := HEAD.search(data, at)) and head.start() < end:
        refs, p = [], head.end()
        while True:
            mark = OPENING.search(data, p)
            token = BODY.match(data, mark.start()) if mark else None
            if mark is None or (token is None and mark.group() != b"#"):
                raise Unterminated(f"record #{int(head.group(1))} at byte {head.start()}")
            p = token.end() if token else mark.end()
            if token and token.group(1) and int(token.group(1)) < 1 << 32:
                refs.append(int(token.group(1)))
            if mark.group() == b";":
                break
        yield head.start(), int(head.group(1)), head.group(2).decode("ascii") or COMPLEX, p - head.start(), data[head.start() : p], refs
        at = p


def data_start(data: bytes) -> int:
    at = data.find(DATA)
    return at + len(DATA) if at >= 0 else 0


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], chunk: int):
        self.paths, self.chunk = paths, chunk

    def partitions(self) -> list[Span]:
        """Byte ranges of every file's data; a range owns the records that begin in it, on a line of their own."""
        spans = []
        for path in self.paths:
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                head = f.read(1 << 20)
            begin = data_start(head)
            spans += [Span(path, a, min(size, a + self.chunk)) for a in range(begin, max(size, begin + 1), self.chunk)]
        return spans

    def read(self, span: Span) -> Iterator[tuple]:
        """Records from the first line-leading one at or after the range's start, to the first line-leading one at or after its end."""
        with open(span.path, "rb") as f:
            first = span.start == data_start(f.read(1 << 20))
            base = span.start if first else span.start - 1
            f.seek(base)
            data = f.read(span.end - base)
            last = len(data)
            stop = None
            while stop is None:
                hit = LINE.search(data, max(0, last - 1))
                if hit:
                    stop = hit.start() + 1
                elif block := f.read(1 << 16):
                    data += block
                else:
                    stop = len(data)
            lead = 0
            if not first:
                hit = LINE.search(data)
                lead = hit.start() + 1 if hit else stop
            if lead < stop:
                for at, id_, kind, n, text, refs in records(data[:stop], lead):
                    yield span.path, base + at, id_, kind, n, text, refs


class Part21(DataSource):
    """spark.dataSource.register(Part21); spark.read.format("part21").option("path", glob).option("chunk", bytes).load()"""

    @classmethod
    def name(cls) -> str:
        return "part21"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        paths = sorted(glob.glob(self.options["path"]))
        if not paths:
            raise FileNotFoundError(self.options["path"])
        return Reader(paths, int(self.options.get("chunk", CHUNK)))


def scan(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """The same rows from a frame of whole files, such as spark.read.format("binaryFile") gives from any store; one task holds one file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch[name], batch[content]):
                rows = [(path, at, id_, kind, n, text, refs) for at, id_, kind, n, text, refs in records(bytes(data), data_start(bytes(data)))]
                yield pd.DataFrame(rows, columns=["file", "row", "id", "type", "len", "text", "refs"])

    return files.select(name, content).mapInPandas(run, SCHEMA)


def part_text(rows: DataFrame, head: str, foot: str) -> DataFrame:
    """(part, content, entities, bytes): one exchange file per part, its records in source order. ``rows``: (part, row, text)."""
    told = rows.select("part", "row", F.col("text").cast("string").alias("text"))
    body = told.groupBy("part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), "\n").alias("_body"), F.count("*").alias("entities"))
    content = F.concat(F.lit(head), "_body", F.lit(foot))
    return body.select("part", content.alias("content"), "entities", F.octet_length(content).cast("bigint").alias("bytes"))


def write_parts(rows: DataFrame, folder: str, head: str, foot: str) -> None:
    """One folder of text files per part; records of a part are written by one task in source order."""
    part_text(rows, head, foot).select("part", F.col("content").alias("value")).repartition("part").write.partitionBy("part").text(folder)
