"""Sorted files with indexes as Spark jobs: made by range partitioning, indexed by byte ranges, read by tables of regions.

An index of a part of a file is an index too, and those of consecutive parts merge; so files are indexed by as many tasks as
they have ranges, and a sorted file is put together from pieces that were indexed when they were written.
"""

from __future__ import annotations

import pickle
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import interval_join
from . import bam, bcf
from .bgzf import BLOCK, END, BgzfReader, block_size, compress_block
from .files import byte_ranges, listed, open_path, removed, shared_folder
from .index import PRESETS, Index, bai_bytes, candidates, csi_bytes, line_span, lines_of, planned, read_index, tbi_bytes

#: Kinds of files: their extension, and that of their index and how it is made.
KINDS: dict[str, tuple[str, str, Callable[[Index], bytes]]] = {
    "bam": (".bam", "bai", bai_bytes), "bcf": (".bcf", "csi", csi_bytes), "vcf": (".vcf.gz", "tbi", tbi_bytes),
    "bed": (".bed.gz", "tbi", lambda x: tbi_bytes(x, 0x10000, (1, 2, 3))), "gff": (".gff.gz", "tbi", lambda x: tbi_bytes(x, 0, (1, 4, 5))), "sam": (".sam.gz", "tbi", lambda x: tbi_bytes(x, 1, (3, 4, 0), "@")),
}


def _bam_spans(f, start: int, stop: int) -> tuple[list[str], Iterator[tuple[str | None, int, int, int, int]]]:
    """(contigs, (contig, beg, stop, begin, end) of each record that begins in a range of bytes)."""
    blocks = bam.Blocks(f)
    _, references = bam.read_header(blocks)
    names = [n for n, _ in references]
    at = bam.first_record(f, start, lambda data, i: bam.plausible(data, i, len(names))) if start else blocks.tell()

    def spans() -> Iterator:
        blocks = bam.Blocks(f, at)
        while (here := blocks.tell()) < stop << 16 and (n := blocks.int()) is not None:
            body = blocks.read(n)
            rid, pos, ln, _, _, n_ops = struct.unpack_from("<iiBBHH", body)
            ops = struct.unpack_from(f"<{n_ops}I", body, 32 + ln)
            yield names[rid] if rid >= 0 and pos >= 0 else None, pos, pos + sum(o >> 4 for o in ops if o & 15 in (0, 2, 3, 7, 8)), here, blocks.tell()

    return names, spans() if at is not None else iter(())


def _bcf_spans(f, start: int, stop: int) -> tuple[list[str], Iterator]:
    blocks = bam.Blocks(f)
    d = bcf.Dictionary(bcf.bcf_header(blocks))
    at = bam.first_record(f, start, lambda data, i: bcf.plausible(data, i, d)) if start else blocks.tell()
    of = {i: n for n, i in d.contigs.items()}

    def spans() -> Iterator:
        blocks = bam.Blocks(f, at)
        while (here := blocks.tell()) < stop << 16 and (n := blocks.int()) is not None:
            body = blocks.read(n + blocks.int())
            contig, pos, length = struct.unpack_from("<iii", body)
            yield of[contig], pos, pos + max(length, 1), here, blocks.tell()

    return list(d.contigs), spans() if at is not None else iter(())


def _line_spans(f, start: int, stop: int, preset: str) -> tuple[list[str], Iterator]:
    reader = BgzfReader({"path": ""})
    f.seek(0, 2)
    n = f.tell()
    at = reader._first(f, start, n) if start else 0

    def spans() -> Iterator:
        skip = start > 0 and at < n and not reader._ends_line(f, at)
        for line, here, end in lines_of(bam.Blocks(f, at << 16)) if at < n else ():
            if here >= stop << 16:
                return
            if not skip and line and not line.startswith(PRESETS[preset][4]):
                contig, beg, last = line_span(line, preset)
                yield None if contig == "*" else contig, beg, last, here, end
            skip = False

    return [], spans()


def partial_index(f, kind: str, start: int, stop: int) -> Index:
    """The index of the records that begin in bytes [start, stop) of an open file."""
    names, spans = (_bam_spans if kind == "bam" else _bcf_spans if kind == "bcf" else lambda *x: _line_spans(*x, kind))(f, start, stop)
    out = Index()
    for n in names:
        out.number(n)
    for contig, beg, last, here, end in spans:
        if contig is not None:
            out.put(contig, beg, last, here, end)
    return out


def build_indexes(spark: SparkSession, path: str, kind: str, size: int = 64 << 20) -> DataFrame:
    """Writes an index beside each file of ``kind`` at ``path`` (a file or a folder); returns file, index and chunks of each.

    Each range of ``size`` bytes is indexed by a task of its own; the ranges' indexes, which together are about as large as the file's
    one, are merged in order. Files that aren't sorted by coordinate are an error.
    """
    extension, ending, encode = KINDS[kind]
    ranges = spark.createDataFrame([(r.path, r.start, r.stop) for r in byte_ranges(path, (extension,), size)], "file string, start long, stop long")

    def one(batches: Iterator) -> Iterator:
        system, _ = open_path(path)
        for b in batches:
            for file, start, stop in zip(*b.to_pydict().values(), strict=True):
                with system.open_input_file(file) as f:
                    part = pickle.dumps(partial_index(f, kind, start, stop))
                yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "part": pa.array([part], pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        system, _ = open_path(path)
        out, file = Index(), table.column("file")[0].as_py()
        for part in table.column("part"):
            out.extend(pickle.loads(part.as_py()))
        name = f"{file}.{ending}"
        _put(system, name, encode(out))
        return pa.table({"file": [file], "index": [name], "chunks": pa.array([sum(1 for _ in out.rows())], pa.int64())})

    parts = ranges.repartition("file", "start").mapInArrow(one, "file string, start long, part binary")
    done = parts.groupBy("file").applyInArrow(merged, "file string, index string, chunks long")
    return spark.createDataFrame(done.collect(), done.schema)  # a row per file


def _put(system, name: str, data: bytes) -> None:
    """Under a name of its own first, so that a task that is run twice leaves a whole file."""
    folder, _, base = name.rpartition("/")
    held = f"{folder}/.{base}-{uuid.uuid4().hex}"
    with system.open_output_stream(held) as f:
        f.write(data)
    system.move(held, name)


class _Piece:
    """Records packed into blocks, and the index of their places."""

    def __init__(self, names: list[str]):
        self.index, self.held, self.raw, self.starts, self.size = Index(), b"", 0, [0], 0
        for n in names:
            self.index.number(n)
        self.waiting: list[tuple] = []

    def _offset(self, raw: int) -> int:
        return self.starts[raw // BLOCK] << 16 | raw % BLOCK

    def add(self, data: bytes, contig: str | None, beg: int, stop: int) -> Iterator[bytes]:
        start = self.raw
        self.raw += len(data)
        self.held += data
        self.waiting.append((contig, beg, stop, start, self.raw))
        while len(self.held) >= BLOCK:
            yield self._block(self.held[:BLOCK])
            self.held = self.held[BLOCK:]

    def _block(self, data: bytes) -> bytes:
        out = compress_block(data)
        self.size += len(out)
        self.starts.append(self.size)
        at = next((i for i, w in enumerate(self.waiting) if w[4] // BLOCK >= len(self.starts)), len(self.waiting))
        for contig, beg, stop, start, end in self.waiting[:at]:
            if contig is not None:
                self.index.put(contig, beg, stop, self._offset(start), self._offset(end))
        self.waiting = self.waiting[at:]
        return out

    def finish(self) -> bytes:
        """The last block. What ends with it ends where the next piece begins."""
        waiting, self.waiting = self.waiting, []
        out = self._block(self.held) if self.held else b""
        for contig, beg, stop, start, end in waiting:
            if contig is not None:
                self.index.put(contig, beg, stop, self._offset(start), self.size << 16 if end == self.raw else self._offset(end))
        return out


def _encoder(kind: str, header: str) -> tuple[bytes, list[str], Callable[[dict], tuple[bytes, str | None, int, int]]]:
    """(header's bytes, contigs, row -> its bytes and place)."""
    if kind == "bam":
        from ..functions.kernels import operations

        references = bam.references_of(header)
        ids = {n: i for i, (n, _) in enumerate(references)}

        def read(r: dict) -> tuple:
            r["aux"] = {k: v for k, v in r.get("aux") or ()}
            span = sum(n for n, o in operations(r["cigar"]) if o in "MDN=X")
            mapped = r["rname"] in ids and r["pos"]
            return bam.encode_record(r, ids), r["rname"] if mapped else None, (r["pos"] or 0) - 1, (r["pos"] or 0) - 1 + span

        return bam.header_bytes(header, references), list(ids), read
    if kind == "bcf":
        d = bcf.Dictionary(header)
        head = header.encode() + b"\0"

        def record(r: dict) -> tuple:
            data = bcf.encode_line(r["line"], d)
            contig, pos, length = struct.unpack_from("<iii", data, 8)
            return data, bcf_names[contig], pos, pos + max(length, 1)

        bcf_names = {i: n for n, i in d.contigs.items()}
        return b"BCF\x02\x02" + struct.pack("<I", len(head)) + head, list(d.contigs), record
    return header.encode(), [], lambda r: (r["line"].encode() + b"\n", *line_span(r["line"], kind))


def write_sorted(rows: DataFrame, path: str, header: str, kind: str) -> DataFrame:
    """One file of ``rows`` sorted by coordinate at ``path``, with its index beside it; returns path, size and records.

    bam: rows as BamSource has them; vcf, bcf: ``line``. Contigs come in the header's order, reads without a place last. Rows are dealt by
    ranges of (contig, position) and a hash, so that one position isn't one task; each task packs a piece and indexes it. One task then
    puts the pieces' bytes together, without unpacking them, and merges their indexes, both in the ranges' order.
    """
    spark = rows.sparkSession
    ending, encode = KINDS[kind][1:]
    system, inner = open_path(path)
    folder, listing = shared_folder(spark, "pieces"), shared_folder(spark, "pieces-list")
    contigs = [n for n, _ in bam.references_of(header)] if kind == "bam" else [x.split("ID=", 1)[1].split(",")[0].rstrip(">") for x in header.splitlines() if x.startswith("##contig=")]
    ids = F.create_map(*[x for i, n in enumerate(contigs) for x in (F.lit(n), F.lit(i))])
    last = F.lit(len(contigs))
    if kind == "bam":
        key = [F.coalesce(F.try_element_at(ids, "rname"), last), F.coalesce("pos", F.lit(0).cast("long")), F.xxhash64("qname", "flag", "cigar", "seq")]
    else:
        part = F.split("line", "\t", 3)
        key = [F.coalesce(F.try_element_at(ids, part[0]), last), part[1].cast("long"), F.xxhash64("line")]
    keys = ["__a", "__b", "__c"]
    dealt = rows.withColumns(dict(zip(keys, key, strict=True))).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)

    def pieces(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        out, inside = open_path(folder)
        out.create_dir(inside, recursive=True)
        _, names, record = _encoder(kind, header)
        piece, n, name = _Piece(names), 0, f"{inside}/{uuid.uuid4().hex}"
        with out.open_output_stream(name) as f:
            for b in batches:
                for r in b.to_pylist():
                    n += 1
                    for data in piece.add(*record(r)):
                        f.write(data)
            f.write(piece.finish())
        yield pa.RecordBatch.from_pydict({"n": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "size": [piece.size], "records": pa.array([n], pa.int64()), "part": pa.array([pickle.dumps(piece.index)], pa.binary())})

    dealt.mapInArrow(pieces, "n int, name string, size long, records long, part binary").write.parquet(listing)

    def put_together(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        source, _ = open_path(folder)
        head, names, _ = _encoder(kind, header)
        place, _, base = inner.rpartition("/")
        system.create_dir(place, recursive=True)
        held, index = f"{place}/.{base}-{uuid.uuid4().hex}", Index()
        for n in names:
            index.number(n)
        with system.open_output_stream(held) as f:
            size = 0
            for i in range(0, len(head), BLOCK):
                size += f.write(compress_block(head[i : i + BLOCK]))
            for name, part in zip(table.column("name").to_pylist(), table.column("part"), strict=True):
                with source.open_input_file(name) as g:
                    index.extend(pickle.loads(part.as_py()).shifted(size))
                    while data := g.read(8 << 20):
                        size += f.write(data)
            f.write(END)
        # What ends with the data ends with the file.
        for c in index.contigs:
            for number, chunks in c.bins.items():
                c.bins[number] = [(lo, size + len(END) << 16 if hi == size << 16 else hi) for lo, hi in chunks]
        system.move(held, inner)
        _put(system, f"{inner}.{ending}", encode(index))
        return pa.table({"path": [inner], "size": pa.array([size + len(END)], pa.int64()), "records": pa.array([sum(table.column("records").to_pylist())], pa.int64())})

    done = spark.read.parquet(listing).groupBy(F.lit(0).alias("__all")).applyInArrow(put_together, "path string, size long, records long")
    found = done.collect()  # one row
    for x in (folder, listing):
        removed(spark, x)
    return spark.createDataFrame(found, done.schema)


_INDEX = "file string, shift int, depth int, contig string, bin long, window long, lo long, hi long"


def index_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The chunks (contig, bin, lo, hi) and the linear parts (contig, window, lo) of all files' indexes; a file without one is an error."""
    files = spark.createDataFrame([(x,) for x in listed(path, (KINDS[kind][0],))], "file string").repartition("file")

    def rows(batches: Iterator) -> Iterator:
        system, _ = open_path(path)
        for b in batches:
            for file in b.column("file").to_pylist():
                found = next((c for c in candidates(file) if system.get_file_info(c).is_file), None)
                if found is None:
                    raise ValueError(f"no index beside {file}")
                with system.open_input_file(found) as f:
                    index = read_index(f.read())
                if not index.names:
                    with system.open_input_file(file) as f:
                        index.names = _bam_spans(f, 0, 0)[0] if kind == "bam" else _bcf_spans(f, 0, 0)[0]
                out = [(index.names[i], number, None, lo, hi) for i, number, lo, hi in index.rows()]
                out += [(index.names[i], None, w, o, None) for i, c in enumerate(index.contigs) for w, o in c.linear.items()]
                columns = zip(*out, strict=True) if out else [()] * 5
                kinds = (pa.string(), *[pa.int64()] * 4)
                head = [pa.array([x] * len(out), t) for x, t in ((file, pa.string()), (index.shift, pa.int32()), (index.depth, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*head, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in _INDEX.split(", ")])

    return files.mapInArrow(rows, _INDEX)


def _bins(shift: int, depth: int) -> DataFrame:
    """All bins of an index that may hold records of [beg, stop), as a column."""
    out, first, bits = [], 0, shift + 3 * depth
    stop = F.least("stop", F.lit(1 << bits)) - 1
    for level in range(depth + 1):
        out.append(F.sequence(F.shiftright("beg", bits) + first, F.greatest(F.shiftright(stop, bits), F.shiftright("beg", bits)) + first))
        first, bits = first + (1 << 3 * level), bits - 3
    return F.concat(*out)


def region_parts(spark: SparkSession, path: str, kind: str, regions: DataFrame, size: int = 32 << 20) -> DataFrame:
    """file, task, start, stop: what of the files must be read for a table of regions (contig, beg, stop), by virtual offsets; tasks of about ``size`` bytes.

    Indexes and regions are joined by contig and bin; chunks that no region's window reaches are left out, the others are merged over
    all regions, so that nothing is read twice, and cut where a record is known to begin.
    """
    index = index_rows(spark, path, kind)
    asked = regions.select("contig", F.greatest("beg", F.lit(0)).cast("long").alias("beg"), F.col("stop").cast("long").alias("stop")).where("contig is not null and beg < stop").distinct()
    wanted = None
    for r in index.select("shift", "depth").distinct().collect():  # one kind of index, or a few
        each = asked.where(F.col("beg") < 1 << r["shift"] + 3 * r["depth"]).select("contig", F.explode(_bins(r["shift"], r["depth"])).alias("bin"), F.shiftright("beg", r["shift"]).alias("window"), F.lit(r["shift"]).alias("shift"), F.lit(r["depth"]).alias("depth"))
        wanted = each if wanted is None else wanted.unionByName(each)
    schema = "file string, task long, start long, stop long"
    if wanted is None:
        return spark.createDataFrame([], schema)
    # Of the regions that a bin serves, the one that begins first reaches back the furthest.
    wanted = wanted.groupBy("contig", "bin", "shift", "depth").agg(F.min("window").alias("window"))
    chunks = index.where("bin is not null").drop("window").join(wanted, ["contig", "bin", "shift", "depth"])
    linear = index.where("bin is null").select("file", "contig", "window", F.col("lo").alias("least"))
    chunks = chunks.join(linear, ["file", "contig", "window"], "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long")))
    chunks = chunks.where("hi > least").select("file", F.greatest("lo", "least").alias("lo"), "hi").distinct()

    def plan(table: pa.Table) -> pa.Table:
        parts = planned(list(zip(table.column("lo").to_pylist(), table.column("hi").to_pylist(), strict=True)), size)
        tasks, task, used = [], 0, 0
        for lo, hi in parts:
            if used >= size:
                task, used = task + 1, 0
            tasks.append(task)
            used += (hi >> 16) - (lo >> 16) + 1
        return pa.table({"file": [table.column("file")[0].as_py()] * len(parts), "task": pa.array(tasks, pa.int64()), "start": pa.array([x[0] for x in parts], pa.int64()), "stop": pa.array([x[1] for x in parts], pa.int64())})

    return chunks.groupBy("file").applyInArrow(plan, schema)


def read_regions(spark: SparkSession, path: str, kind: str, regions: DataFrame, size: int = 32 << 20) -> DataFrame:
    """The records of indexed files that overlap any of a table of regions, each once: reads as BamSource has them, or ``line`` and ``rec_idx``.

    Only the parts that the indexes name are read (region_parts); what lies beside the regions there goes in a semi join.
    """
    parts = region_parts(spark, path, kind, regions, size)
    fields = bam.SCHEMA if kind == "bam" else "line string, rec_idx long"
    names = [x.split()[0] for x in fields.replace("map<string,struct<type:string,value:string>>", "map").split(", ")]
    tag = pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())]))
    types = {"flag": pa.int32(), "mapq": pa.int32(), "tlen": pa.int32(), "pos": pa.int64(), "pnext": pa.int64(), "rec_idx": pa.int64(), "aux": tag, "aux_order": pa.list_(pa.string())}

    def rows(batches: Iterator) -> Iterator:
        system, _ = open_path(path)
        for b in batches:
            for file, start, stop in zip(*(b.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
                with system.open_input_file(file) as f:
                    held = []
                    for row in _records(f, kind, start, stop):
                        held.append(row)
                        if len(held) == 4096:
                            yield batch(held)
                            held = []
                    yield batch(held)

    def batch(held: list) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) if held else [()] * (len(names) + 3)
        kinds = [types.get(n, pa.string()) for n in names] + [pa.string(), pa.int64(), pa.int64()]
        columns = [[None if x is None else [(k, {"type": t, "value": v}) for k, (t, v) in x.items()] for x in c] if k == tag else c for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*names, "contig", "beg", "stop"])

    found = parts.repartition("file", "task").sortWithinPartitions("file", "start").mapInArrow(rows, fields + ", contig string, beg long, stop long")
    found = interval_join(found.withColumn("stop", F.greatest("stop", F.col("beg") + 1)), regions.select("contig", "beg", "stop"), "left_semi")
    return found.select(*names)


def _records(f, kind: str, start: int, stop: int) -> Iterator[tuple]:
    """Rows and their place (contig, beg, stop) between two virtual offsets."""
    if kind == "bam":
        from ..functions.kernels import operations

        _, references = bam.read_header(bam.Blocks(f))
        blocks = bam.Blocks(f, start)
        while (at := blocks.tell()) < stop and (n := blocks.int()) is not None:
            row = bam.decode_record(blocks.read(n), references)
            beg = (row[3] or 0) - 1
            yield *row, at, row[2], beg, beg + sum(n for n, o in operations(row[5]) if o in "MDN=X")
    elif kind == "bcf":
        d = bcf.Dictionary(bcf.bcf_header(bam.Blocks(f)))
        for line, at in bcf.records(bam.Blocks(f, start), d):
            if at >= stop:
                return
            yield line, at, *line_span(line, "vcf")
    else:
        for line, at, _ in lines_of(bam.Blocks(f, start)):
            if at >= stop:
                return
            if line and not line.startswith(PRESETS[kind][4]):
                yield line, at, *line_span(line, kind)
