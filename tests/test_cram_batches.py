"""Containers are encoded by columns: every record comes back, and no Python object is made for a number of each record."""

import io
import random

import pyarrow as pa

from strandlake.sources import bam, cram

HEADER = "@SQ\tSN:a\tLN:900000\n@SQ\tSN:b\tLN:900000\n"


def made(n):
    rng, out = random.Random(4), []
    for i in range(n):
        cigar, size = rng.choice([("40M", 40), ("3S20M5D9N17M", 40), ("5H10M2I20M3P8M4S", 44), (None, 0), ("7S", 7)])
        seq = "" if rng.random() < 0.2 else "".join(rng.choice("ACGTN") for _ in range(size))
        tags = {"NM": ("i", str(rng.randrange(-3, 70000))), "XB": ("B", "s,1,-2"), "XZ": ("Z", "a\tb"), "XA": ("A", "q")}
        keys = rng.sample(list(tags), rng.randrange(4))
        out.append({
            "qname": f"r{i}", "flag": rng.choice([0, 16, 4, 99]), "rname": rng.choice([None, "a", "b"]), "pos": rng.choice([None, 1, 200, 700000]), "mapq": rng.choice([None, 0, 60]), "cigar": cigar, "rnext": rng.choice([None, "a"]), "pnext": rng.choice([None, 9]),
            "tlen": rng.choice([0, -5, 70000]), "seq": seq, "qual": "".join(chr(33 + rng.randrange(94)) for _ in seq) if seq and rng.random() < 0.5 else None, "aux": {k: tags[k] for k in keys}, "aux_order": keys,
        })
    return out


def test_containers_by_columns(tmp_path, monkeypatch):
    rows, calls = made(2500), []
    monkeypatch.setattr(cram, "RECORDS", 1000)
    one = cram.itf8
    monkeypatch.setattr(cram, "itf8", lambda n: calls.append(n) or one(n))
    batches = [bam.batch_of(rows[:700]), bam.batch_of(rows[700:1900]), bam.batch_of(rows[1900:])]
    data = b"".join(cram.cram_batches(HEADER, batches, bam.COLUMNS[:-1]))
    assert len(calls) < 2 * len(rows)
    assert [c.n for c in cram.containers(io.BytesIO(data), len(data))] == [1000, 1000, 500]
    (tmp_path / "x.cram").write_bytes(data)
    reader = cram.CramReader({"path": str(tmp_path / "x.cram")})
    found = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(isinstance(b, pa.RecordBatch) for b in found)
    back = [r for b in found for r in b.to_pylist()]
    for r, x in zip(rows, back, strict=True):
        r = r | {"cigar": "*", "mapq": 0} if r["flag"] & 4 else r | {"cigar": r["cigar"] or "*"}
        assert {**x, "aux": {k: tuple(v.values()) for k, v in x["aux"]}, "rec_idx": 0} == {**r, "rec_idx": 0}
