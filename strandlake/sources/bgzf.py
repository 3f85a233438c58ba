"""Block gzip: a codec and a source that reads blocks in parallel.

A file is a row of gzip members of at most 64 KiB of data each; an extra field holds each member's
size, so members can be found without inflating them, and a reader can start at any of them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import Indexed, Pushing, flag

#: Data in one block, and the empty block that ends a file. Fixed values.
BLOCK = 0xFF00
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def compress_block(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = len(body) + 26
    if size > 0x10000:
        return compress_block(data, 0) if level else b"".join(compress_block(data[i : i + BLOCK // 2], 1) for i in range(0, len(data), BLOCK // 2))
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, size - 1)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def compress(data: bytes, level: int = 6) -> bytes:
    return b"".join(compress_block(data[i : i + BLOCK], level) for i in range(0, len(data), BLOCK)) + END


def block_size(head: bytes) -> int | None:
    """The size of the block that starts with these (18 or more) bytes; None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(len(head), 12 + extra):
        a, b, n = struct.unpack_from("<BBH", head, at)
        if (a, b, n) == (66, 67, 2):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def blocks(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(compressed offset, offset of its data, data) of each block."""
    at = done = 0
    while at < len(data):
        n = block_size(data[at : at + 64])
        if n is None:
            raise ValueError(f"no block at {at}")
        out = zlib.decompress(data[at : at + n], 31)
        yield at, done, out
        at, done = at + n, done + len(out)


def decompress(data: bytes) -> bytes:
    return b"".join(b for _, _, b in blocks(data))


def ends_well(data: bytes) -> bool:
    """Whether the block that ends a file is there."""
    return data.endswith(END)


def gzi(data: bytes) -> list[tuple[int, int]]:
    """(compressed offset, data offset) of each block but the first and empty ones."""
    return [(c, u) for c, u, b in blocks(data) if c and b]


def gzi_bytes(entries: list[tuple[int, int]]) -> bytes:
    return struct.pack("<Q", len(entries)) + b"".join(struct.pack("<QQ", *e) for e in entries)


def read_gzi(data: bytes) -> list[tuple[int, int]]:
    return [struct.unpack_from("<QQ", data, 8 + 16 * i) for i in range(struct.unpack_from("<Q", data)[0])]


class Split(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class Chunk(Split):
    """Lines that begin between two virtual offsets."""


class BgzfReader(Indexed, DataSourceReader):
    """Lines of a block-gzip file; each task takes the blocks that start in its byte range, and the lines that start in them.

    Options ``region`` (contig:from-to) and ``preset`` (sam, vcf, bed, gff): only lines that meet the region, from the chunks
    that the file's index names, or from all of the file where there is no index. With ``positions`` lines have contig and pos (NULL in
    comments) beside them, and filters on these are looked up in the index with ``pushdown`` (see Pushing).
    """

    def __init__(self, options: dict):
        self.positions = flag(options, "positions")
        self.path = options["path"]
        self.size = int(options.get("splitbytes", 16 << 20))
        self.region, self.preset = options.get("region"), options.get("preset", "vcf")

    def _file(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        return system.open_input_file(path)

    def partitions(self):
        if self.region:
            from .files import open_path
            from .index import region_chunks

            system, inner = open_path(self.path)
            chunks = region_chunks(system, inner, self.region)
            if chunks is not None:
                return [Chunk(self.path, lo, hi) for lo, hi in chunks]
        elif self.pushed:
            from .files import open_path

            system, inner = open_path(self.path)
            if (chunks := self.chunks(system, inner, [], self.size)) is not None:
                return [Chunk(self.path, lo, hi) for lo, hi in chunks]
        with self._file() as f:
            n = f.size()
        return [Split(self.path, i, min(i + self.size, n)) for i in range(0, n, self.size)]

    @staticmethod
    def _first(f, start: int, n: int) -> int:
        """The first place from ``start`` on where a block starts: its size leads to another one or to the end."""
        f.seek(start)
        window = f.read(min(n - start, 2 * 0x10000 + 64))
        for at in range(len(window)):
            size = block_size(window[at : at + 64])
            if size and (start + at + size == n or block_size(window[at + size : at + size + 64])):
                return start + at
        return n

    def read(self, partition):
        if partition is None:  # nothing to read
            return
        from .index import PRESETS, line_meets, placed

        if not self.region:
            for (line,) in self._chunk(partition) if isinstance(partition, Chunk) else self._lines(partition):
                yield (line, *placed(line, self.preset)) if self.positions else (line,)
            return

        for (line,) in self._chunk(partition) if isinstance(partition, Chunk) else self._lines(partition):
            if line and not line.startswith(PRESETS[self.preset][4]) and line_meets(line, self.preset, self.region):
                yield (line,)

    def _chunk(self, partition):
        from .bam import Blocks
        from .index import lines_of

        with self._file() as f:
            for line, start, _ in lines_of(Blocks(f, partition.start)):
                if start >= partition.stop:
                    return
                yield (line,)

    def _lines(self, partition):
        with self._file() as f:
            n = f.size()
            at = 0 if partition.start == 0 else self._first(f, partition.start, n)
            held, skip, first = b"", partition.start > 0, at
            if skip and at < n:
                skip = not self._ends_line(f, at)
            done = False
            while at < n and not done:
                f.seek(at)
                head = f.read(64)
                size = block_size(head)
                if size is None:
                    raise ValueError(f"no block at {at}")
                f.seek(at)
                data = zlib.decompress(f.read(size), 31)
                inside = at < partition.stop
                lines = (held + data).split(b"\n")
                held = lines.pop()
                if not inside and at != first:
                    # Only what finishes the last line that began inside.
                    if lines:
                        if not skip:
                            yield (lines[0].decode(),)
                        held, done = b"", True
                    at += size
                    continue
                if at == first and not inside:
                    return
                for line in lines:
                    if skip:
                        skip = False
                        continue
                    yield (line.decode(),)
                at += size
                if at >= partition.stop and not held:
                    done = True
            if held and not skip and not done:
                yield (held.decode(),)

    def _ends_line(self, f, at: int) -> bool:
        """Whether the data before the block at ``at`` ends with a line break; found by inflating the block before it."""
        back = max(0, at - 0x10000)
        f.seek(back)
        window = f.read(at - back)
        for i in range(len(window) - 1, -1, -1):
            if block_size(window[i : i + 64]) == len(window) - i:
                data = zlib.decompress(window[i:], 31)
                return data.endswith(b"\n") if data else self._ends_line(f, back + i)
        return True


class PushedBgzfReader(Pushing, BgzfReader):
    pass


class BgzfSource(DataSource):
    """spark.dataSource.register(BgzfSource); spark.read.format("bgzf").load(path)"""

    @classmethod
    def name(cls):
        return "bgzf"

    def schema(self):
        return "line string" + (", contig string, pos long" if flag(self.options, "positions") else "")

    def reader(self, schema):
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushedBgzfReader if flag(options, "pushdown") else BgzfReader)(options)


def detect(head: bytes) -> tuple[str, str]:
    """(format, compression) of a file by its first bytes; compressed ones are looked into once."""
    from ..functions.scalars import MAGIC

    def exact(data: bytes) -> str:
        for name, magic in MAGIC.items():
            if data.startswith(magic) and name != "gzip":
                return name
        first = next((x for x in data.split(b"\n") if x.strip()), b"")
        tests = ((lambda x: x.startswith((b"@HD", b"@SQ")), "SAM"), (lambda x: x.startswith(b"##fileformat=VCF"), "VCF"), (lambda x: x.startswith(b">"), "FASTA"), (lambda x: x.startswith(b"@"), "FASTQ"), (lambda x: x.startswith(b"##gff-version"), "GFF"))
        for test, name in tests:
            if test(first):
                return name
        parts = first.split(b"\t")
        return "BED" if len(parts) >= 3 and parts[1].isdigit() and parts[2].strip().isdigit() else "unknown"

    if not head.startswith(MAGIC["gzip"]):
        return exact(head), "none"
    kind = "bgzf" if block_size(head[:64]) else "gzip"
    return exact(zlib.decompressobj(31).decompress(head)), kind
