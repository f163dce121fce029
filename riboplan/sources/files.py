"""Readers and writers registered with Spark as the formats ``fastq`` and ``bam``.

A file is one partition, read front to back in bounded memory: order within a file is what ordinals
mean. Paths may be a comma-separated list; every executor must be able to open them.
"""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import bgzf

FASTQ_SCHEMA = "ordinal long, name string, seq string, plus string, qual string, file string"
BAM_SCHEMA = (
    "sample string, file_ordinal long, qname string, flag int, rname string, pos0 int, mapq int, cigar string, "
    "rnext string, pnext0 int, tlen int, seq string, qual string, tags map<string,string>"
)


@dataclass
class File(InputPartition):
    number: int
    path: str


def listed(options: dict) -> list[str]:
    paths = [p for p in options.get("path", "").split(",") if p]
    out: list[str] = []
    for p in paths:
        at = Path(p.removeprefix("file://"))
        if not at.exists():
            raise FileNotFoundError(f"no such file: {at}")
        out += sorted(str(x) for x in at.iterdir() if x.is_file() and x.name[0] not in "._") if at.is_dir() else [str(at)]
    return out


def fastq_records(path: str) -> Iterator[tuple[str, str, str, str]]:
    """(name, seq, plus, qual) of four-line records; ends at an empty name or quality line."""
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "rt") as f:
        while True:
            name, seq, plus, qual = (f.readline().rstrip("\r\n") for _ in range(4))
            if not name or not qual:
                return
            if name[0] != "@":
                raise ValueError(f"{path}: a record does not begin with @: {name[:50]!r}")
            yield (name[1:].split() or [""])[0], seq, plus, qual


class FastqReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = listed(options)

    def partitions(self) -> list[File]:
        return [File(i, p) for i, p in enumerate(self.paths)]

    def read(self, partition: File) -> Iterator[tuple]:
        for n, r in enumerate(fastq_records(partition.path)):
            yield (partition.number << 40 | n, *r, partition.path)


class Fastq(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return FASTQ_SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = listed(options)
        self.coordinate = options.get("requirecoordinateorder", options.get("requireCoordinateOrder", "false")) == "true"

    def partitions(self) -> list[File]:
        return [File(i, p) for i, p in enumerate(self.paths)]

    def read(self, partition: File) -> Iterator[tuple]:
        reader = bgzf.Reader(partition.path)
        if self.coordinate and not reader.coordinate_sorted():
            raise ValueError(f"{partition.path} is not sorted by coordinate")
        sample = os.path.basename(partition.path).removesuffix(".bam").removesuffix(".sorted")
        for r in reader:
            yield (sample, *r.values())


def probe_bam(*paths: str) -> None:
    """Opens each BAM file and reads its first record, if it has one; a file that can't be read raises by name."""
    for p in listed({"path": ",".join(paths)}):
        try:
            next(iter(bgzf.Reader(p)), None)
        except Exception as e:
            raise ValueError(f"BAM file can't be read: {p}: {e}") from e


@dataclass
class Written(WriterCommitMessage):
    path: str


class BamWriter(DataSourceWriter):
    """A complete BAM file of each partition; ``references`` is name:length,..."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"].removeprefix("file://")
        pairs = (x.rpartition(":") for x in options.get("references", "").split(",") if x)
        self.references = [(a, int(b)) for a, _, b in pairs]
        self.order = options.get("order", "unsorted")

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.bam"
        with open(os.path.join(self.folder, f".{name}"), "wb") as f:
            write_records(f, self.references, (r.asDict() for r in rows), self.order)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                os.rename(os.path.join(self.folder, f".{m.path}"), os.path.join(self.folder, m.path))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                Path(self.folder, f".{m.path}").unlink(missing_ok=True)


def write_records(out, references: list[tuple[str, int]], records, order: str = "unsorted") -> None:
    ids = {n: i for i, (n, _) in enumerate(references)}
    w = bgzf.Writer(out)
    w.write(bgzf.header(references, order))
    for r in records:
        w.write(bgzf.encode(r, ids))
    w.close()


class Bam(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return BAM_SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Fastq)
    spark.dataSource.register(Bam)
