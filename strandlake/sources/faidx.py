"""Indexes of FASTA and FASTQ files: name, length, offset, line_bases, line_width and, for FASTQ, qual_offset."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def index_of(data: bytes) -> Iterator[tuple]:
    """Index rows of one file's bytes. Lines of one record must be equally long but for the last."""
    at, record, fastq, quality = 0, None, False, False
    for line in data.splitlines(keepends=True):
        width, bases = len(line), len(line.rstrip(b"\r\n"))
        if quality:
            if record[1] > record[6]:
                if record[5] is None:
                    record[5] = at
                record[6] += bases
            if record[6] >= record[1]:
                quality = False
                yield tuple(record[:6])
                record = None
        elif line[:1] in (b">", b"@") and (record is None or not fastq):
            if record is not None:
                yield tuple(record[:6])
            fastq = line[:1] == b"@"
            record = [line[1:].split()[0].decode() if line[1:].split() else "", 0, at + width, 0, 0, None, 0]
            short = False
        elif fastq and line[:1] == b"+":
            quality = True
        elif bases:
            if record is None:
                raise ValueError("a sequence without a name")
            if not record[3]:
                record[3], record[4] = bases, width
            elif short or bases > record[3]:
                raise ValueError(f"{record[0]}: lines of different length")
            short = bases < record[3]
            record[1] += bases
        at += width
    if record is not None:
        yield tuple(record[:6])


def build(spark: SparkSession, path: str) -> DataFrame:
    """An index row per record of the files under ``path``, with the file's name."""
    schema = "file string, name string, length long, offset long, line_bases long, line_width long, qual_offset long"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(file, *r) for r in index_of(data)]
                kinds = (pa.string(), pa.string(), *[pa.int64()] * 5)
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def byte_range(beg, stop):
    """Columns (first byte, bytes) of bases [beg, stop) of an index row."""
    place = lambda i: F.col("offset") + F.floor(i / F.col("line_bases")) * F.col("line_width") + i % F.col("line_bases")
    return place(beg), place(stop - 1) + 1 - place(beg)
