"""What sources and sinks of files share: file systems, byte ranges, folders written by many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def open_path(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def listed(path: str, endings: tuple[str, ...]) -> list[str]:
    """The file at ``path``, or the files in that folder that end so."""
    from pyarrow import fs

    system, inner = open_path(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [inner]
    return sorted(x.path for x in system.get_file_info(fs.FileSelector(inner)) if x.path.endswith(endings) and not x.base_name.startswith((".", "_")))


def shared_folder(spark, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share; a local one where that is unset and all runs in one process."""
    import tempfile
    import uuid

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class ByteRange(InputPartition):
    """Records that begin in [start, stop) of a file."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def byte_ranges(path: str, endings: tuple[str, ...], size: int) -> list[ByteRange]:
    system, _ = open_path(path)
    out = []
    for p in listed(path, endings):
        n = system.get_file_info(p).size
        out += [ByteRange(p, i, min(i + size, n)) for i in range(0, max(n, 1), size)]
    return out


class Indexed:
    """For readers of files that may have indexes: what was asked for becomes the chunks that the index names."""

    #: The columns of contig and position (from 1), and what was asked for of them: contigs and [beg, stop), or None.
    place = ("contig", "pos")
    pushed: tuple[list[str], int, int] | None = None

    def chunks(self, system, path: str, names: list[str], size: int) -> list[tuple[int, int]] | None:
        """What must be read of a file for the filters, in ranges of virtual offsets; None if there is nothing to go by. ``names``: its contigs, unless the index has them."""
        from .index import candidates, planned, read_index

        if self.pushed is None:
            return None
        found = next((c for c in candidates(path) if system.get_file_info(c).is_file), None)
        if found is None:
            return None
        with system.open_input_file(found) as f:
            index = read_index(f.read())
        numbers = {n: i for i, n in enumerate(index.names or names)}
        asked, beg, stop = self.pushed
        return planned([x for n in asked if n in numbers and beg < stop for x in index.hits(numbers[n], beg, stop)], size)


class Pushing:
    """Filters on contig and position are taken from the plan. Spark refuses such readers unless spark.sql.python.filterPushdown.enabled is true, so sources make them only with option ``pushdown``.

    Filters stay with Spark too, as chunks may hold more than was asked for.
    """

    def pushFilters(self, filters):
        names, beg, stop = None, 0, 1 << 40
        bounds = {"EqualTo": (-1, 0), "GreaterThan": (0, None), "GreaterThanOrEqual": (-1, None), "LessThan": (None, -1), "LessThanOrEqual": (None, 0)}
        for f in filters:
            kind, column = type(f).__name__, getattr(f, "attribute", None)
            if column == (self.place[0],) and kind in ("EqualTo", "In"):
                these = {f.value} if kind == "EqualTo" else set(f.value)
                names = these if names is None else names & these
            elif column == (self.place[1],) and kind in bounds:
                low, high = bounds[kind]
                beg = beg if low is None else max(beg, f.value + low)
                stop = stop if high is None else min(stop, f.value + high)
        if names is not None:
            self.pushed = sorted(x for x in names if x is not None), beg, stop
        return filters


def flag(options: dict, name: str) -> bool:
    return options.get(name, "").lower() == "true"


class Written(WriterCommitMessage):
    def __init__(self, name: str, final: str):
        self.name, self.final = name, final


class FolderWriter(DataSourceWriter):
    """One file per partition, made by ``parts`` from its rows; files get their names when all tasks are done, so a lost task leaves nothing."""

    def __init__(self, path: str, extension: str, parts: Callable[[Iterator], Iterator[bytes]]):
        self.path, self.extension, self.parts = path, extension, parts

    def write(self, iterator):
        import uuid

        from pyspark import TaskContext

        system, inner = open_path(self.path)
        system.create_dir(inner, recursive=True)
        name = f"{inner}/.{uuid.uuid4().hex}"
        with system.open_output_stream(name) as f:
            for data in self.parts(iterator):
                f.write(data)
        return Written(name, f"{inner}/part-{TaskContext.get().partitionId():05d}.{self.extension}")

    def commit(self, messages):
        system, _ = open_path(self.path)
        for m in messages:
            if m is not None:
                system.move(m.name, m.final)

    def abort(self, messages):
        system, _ = open_path(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.name)


class BatchFolderWriter(FolderWriter, DataSourceArrowWriter):
    """Likewise; ``parts`` gets a task's rows as Arrow batches."""


def line_parts(header: str, packed: bool, batches: Iterator) -> Iterator[bytes]:
    """A file of the lines of Arrow batches' first column, in parts, block-compressed if ``packed``."""
    import pyarrow.compute as pc

    from .bam import slices, spread
    from .bgzf import BLOCK, compress, compress_block

    held = header.encode()
    for batch in batches:
        for part in slices(batch.select([0])):
            if part.column(0).null_count:
                raise ValueError("a line is null")
            held += spread(pc.binary_join_element_wise(part.column(0), "", "\n"))[0].tobytes()
            whole = len(held) // BLOCK * BLOCK if packed else len(held)
            yield b"".join(compress_block(held[i : i + BLOCK]) for i in range(0, whole, BLOCK)) if packed else held
            held = held[whole:]
    yield compress(held) if packed else held


class LineSource(DataSource):
    """A sink for SAM, VCF and other lines, each file with the same header.

    spark.dataSource.register(LineSource); df.select("line").write.format("lines").option("header", text)
    .option("extension", "sam").mode("append").save(folder). Extensions that end in gz are block-compressed.
    """

    @classmethod
    def name(cls):
        return "lines"

    def schema(self):
        return "line string"

    def writer(self, schema, overwrite):
        header, extension = self.options.get("header", ""), self.options.get("extension", "txt")

        return BatchFolderWriter(self.options["path"], extension, lambda batches: line_parts(header, extension.endswith("gz"), batches))


class FastqReader(DataSourceReader):
    """Records of four lines each, from any byte range: a record begins at a line with '@' whose second next line begins with '+', with as many qualities as bases."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("splitbytes", 32 << 20))

    def partitions(self):
        return byte_ranges(self.path, ("fq", "fastq"), self.size)

    @staticmethod
    def _starts(lines: list[bytes]) -> bool:
        a, b, c, d = (x.rstrip(b"\r\n") for x in lines)
        return a.startswith(b"@") and c.startswith(b"+") and len(b) == len(d)

    def read(self, partition):
        system, _ = open_path(self.path)
        with system.open_input_file(partition.path) as raw:
            import io

            f = io.BufferedReader(_Raw(raw), 1 << 20)
            f.seek(max(partition.start - 1, 0))
            if partition.start:
                f.readline()  # ends the line before, of which at least the last byte was read
            held: list[bytes] = []
            at = f.tell()
            first = partition.start > 0
            while at < partition.stop or held:
                while len(held) < 4 and (line := f.readline()):
                    held.append(line)
                if not held or not any(x.strip() for x in held):
                    return
                if len(held) < 4 or not self._starts(held):
                    if first and len(held) < 4:
                        return
                    if not first:
                        raise ValueError(f"{partition.path} at {at}: not a record of four lines")
                    at += len(held.pop(0))
                    if at >= partition.stop:
                        return
                    continue
                first = False
                if at >= partition.stop:
                    return
                name, _, definition = held[0][1:].rstrip(b"\r\n").decode().partition(" ")
                yield (name, definition or None, held[1].rstrip(b"\r\n").decode(), held[3].rstrip(b"\r\n").decode(), at)
                at += sum(map(len, held))
                held = []


class _Raw:
    """An Arrow file as what io.BufferedReader needs."""

    def __new__(cls, file):
        import io

        class Raw(io.RawIOBase):
            def readable(self):
                return True

            def seekable(self):
                return True

            def seek(self, at, whence=0):
                return file.seek(at, whence)

            def tell(self):
                return file.tell()

            def readinto(self, buffer):
                data = file.read(len(buffer))
                buffer[: len(data)] = data
                return len(data)

        return Raw()


class FastqSource(DataSource):
    """spark.dataSource.register(FastqSource); spark.read.format("fastq").load(path). Files whose sequences have several lines go through sources.text.read_fastq."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return "name string, definition string, seq string, qual string, rec_idx long"

    def reader(self, schema):
        return FastqReader({k.lower(): v for k, v in self.options.items()})
