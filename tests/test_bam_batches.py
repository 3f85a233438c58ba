"""Records of a batch are encoded and decoded together, with the same bytes and rows as one by one."""

import io
import random

import pyarrow as pa

from strandlake.sources import bam, files

HEADER = "@SQ\tSN:a\tLN:900000\n@SQ\tSN:b\tLN:900000\n"
AUX = {"aux": pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())])), "aux_order": pa.list_(pa.string())}


def made(n):
    rng = random.Random(3)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 2, 7, 40])
        tags = {"NM": ("i", str(rng.randrange(-3, 70000))), "XB": ("B", "s,1,-2"), "XZ": ("Z", "a\tb"), "XF": ("f", "0.5"), "XA": ("A", "q")}
        keys = rng.sample(list(tags), rng.randrange(5))
        out.append({
            "qname": rng.choice([None, "", f"r{i}", "longer" * 9]), "flag": rng.randrange(65536), "rname": rng.choice([None, "a", "b", "other"]), "pos": rng.choice([None, 0, 1, 16384, 700000]), "mapq": rng.choice([None, 0, 60, 255]),
            "cigar": rng.choice([None, "*", "40M", "3S20M5D9N17M", "5H40M"]), "rnext": rng.choice([None, "a"]), "pnext": rng.choice([None, 0, 9]), "tlen": rng.choice([None, -5, 70000]), "seq": rng.choice([None, ""]) if not size else "".join(rng.choice("ACGTNacgtR=.") for _ in range(size)),
            "qual": rng.choice([None, "".join(chr(33 + rng.randrange(94)) for _ in range(size))]), "aux": rng.choice([None, {}]) if not keys else {k: tags[k] for k in keys}, "aux_order": rng.choice([None, [], keys, keys[::-1], keys[:1]]),
        })
    return out


def batch_of(rows):
    plain = [r | {"aux": r["aux"] and [(k, {"type": t, "value": v}) for k, (t, v) in r["aux"].items()]} for r in rows]
    kind = {"flag": pa.int32(), "mapq": pa.int32(), "tlen": pa.int32(), "pos": pa.int64(), "pnext": pa.int64()} | AUX
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in plain], kind.get(k, pa.string())) for k in rows[0]], names=list(rows[0]))


def test_a_batch_is_coded_at_once(tmp_path, monkeypatch):
    rows = made(3000)
    one = [r | {"aux": {k: {"type": t, "value": v} for k, (t, v) in (r["aux"] or {}).items()}} for r in rows]
    ids = {"a": 0, "b": 1}
    for lot in (one[:1], one[:50], one):
        data = b"".join(bam.encode_record(r, ids) for r in lot)
        assert bam.encode_batch(batch_of(rows[: len(lot)]), list(rows[0]), ids) == data
        assert bam.encode_batch(batch_of([rows[7], *rows[: len(lot)]]).slice(1), list(rows[0]), ids) == data
    refs = bam.references_of(HEADER)
    want = bam.write_bam(HEADER, one)
    blocks, last = bam.Blocks(io.BytesIO(want)), []
    bam.read_header(blocks)
    while (at := blocks.tell()) and (n := blocks.int()) is not None:
        last.append((*bam.decode_record(blocks.read(n), refs), at))
    fail = lambda *_: 1 / 0
    monkeypatch.setattr(bam, "encode_record", fail)
    monkeypatch.setattr(bam, "decode_record", fail)
    assert b"".join(bam.bam_parts(HEADER, [batch_of(rows[:900]), batch_of(rows[900:])], list(rows[0]))) == want
    (tmp_path / "x.bam").write_bytes(want)
    for together, size in ((1 << 22, 1 << 30), (1, 1 << 30), (1 << 22, 20_000)):
        monkeypatch.setattr(bam, "TOGETHER", together)
        reader = bam.BamReader({"path": str(tmp_path / "x.bam"), "splitbytes": str(size)})
        back = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [(*x[:11], {k: tuple(v.values()) for k, v in x[11]}, *x[12:]) for x in back] == last


def test_files_are_listed_once(tmp_path, monkeypatch):
    """Byte ranges of many files: the folder isn't listed again for each of them."""
    for i in range(9):
        (tmp_path / f"{i}.bam").write_bytes(bam.write_bam(HEADER, []))
    calls, one = [], files.listed
    for module in (bam, files):
        monkeypatch.setattr(module, "listed", lambda *x: calls.append(x) or one(*x))
    assert len(bam.BamReader({"path": str(tmp_path)}).partitions()) == 9 and len(calls) == 1
