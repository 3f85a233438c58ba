"""Removing alleles from VCF lines: which values of a field belong to which allele goes by the field's name."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fields with a value per ALT (A), per allele (R), per genotype (G), or so many per ALT; L: of the alleles that LAA names. Fixed values.
INFO = {"AC": "A", "AF": "A", "CN": "A", "RN": "A", "SVLEN": "A", "AD": "R", "CIEND": 2, "CIPOS": 2, "CILEN": 2, "CICN": 2, "MEINFO": 4, "METRANS": 4}
FORMAT = {"AD": "R", "EC": "A", "PL": "G", "LAD": "LR", "LEC": "LA", "LPL": "LG"}
#: Fields of tandem repeats: a value per repeat (RN of them per ALT), and one per copy of a repeat (RUC). Fixed values.
PER_REPEAT, PER_COPY = ("RUS", "RUL", "RB", "RUC"), ("RUB",)


def _items(value: str | None) -> list[str]:
    return [] if value in (None, "", ".") else value.split(",")


def _numbers(items: list[str]) -> list[int]:
    return [int(x) if x.isdigit() else 0 for x in items]


def genotypes(kept: Sequence[int]) -> list[int]:
    """Places of the genotypes of kept alleles among those of all: i/j (i <= j) is at j * (j + 1) / 2 + i."""
    return [j * (j + 1) // 2 + i for j in kept for i in kept if i <= j]


def places(kind: str | int, kept: Sequence[int], n: int, n_alleles: int) -> list[int]:
    """Which of a field's ``n`` values stay."""
    if kind == "R" or kind == "G" and n == n_alleles:  # a haploid genotype is an allele
        return list(kept)
    if kind == "G":
        return genotypes(kept)
    size = 1 if kind == "A" else int(kind)
    return [(i - 1) * size + k for i in kept if i for k in range(size)]


def _chosen(items: list[str], at: Sequence[int]) -> str | None:
    return ",".join(items[i] for i in at if i < len(items)) or None


def _runs(items: list[str], sizes: list[int], kept: Sequence[int]) -> str | None:
    """Of consecutive runs of the given sizes, one per ALT, those of kept ALTs."""
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    return _chosen(items, [k for i in kept if 0 < i <= len(sizes) for k in range(ends[i - 1] - sizes[i - 1], ends[i - 1])])


def _info(text: str, kept: list[int], n_alleles: int, more: dict) -> str:
    pairs = [(k, v if mark else None) for k, mark, v in (x.partition("=") for x in text.split(";"))] if text != "." else []
    given = dict(pairs)
    repeats = _numbers(_items(given.get("RN")))
    copies, at = [], 0
    for n in repeats:
        copies.append(sum(_numbers(_items(given.get("RUC")))[at : at + n]))
        at += n
    out = []
    for key, value in pairs:
        kind = (INFO | more).get(key)
        if value is not None and key in PER_REPEAT + PER_COPY:
            value = _runs(_items(value), repeats if key in PER_REPEAT else copies, kept)
        elif value is not None and kind:
            items = _items(value)
            value = _chosen(items, places(kind, kept, len(items), n_alleles))
        elif value is None:
            out.append(key)
        if value is not None:
            out.append(f"{key}={value}")
    return ";".join(out) or "."


def _sample(keys: list[str], text: str, kept: list[int], n_alleles: int, new: dict[int, int], more: dict) -> str:
    values = dict(zip(keys, text.split(":"), strict=False))
    laa = values.get("LAA")
    local = list(range(n_alleles)) if laa is None else [0, *map(int, _items(laa))]
    local_kept = [i for i, a in enumerate(local) if a in new]
    out = []
    for key in keys:
        value, kind = values.get(key, "."), (FORMAT | more).get(key)
        items = _items(value)
        if key == "GT":
            value = re.sub(r"\d+", lambda m: str(new.get(int(m[0]), ".")), value)
        elif key == "LAA":
            value = ",".join(str(new[int(a)]) for a in items if int(a) in new) or "."
        elif kind and str(kind).startswith("L"):
            value = _chosen(items, places(kind[1:], local_kept, len(items), len(local))) or "."
        elif kind:
            value = _chosen(items, places(kind, kept, len(items), n_alleles)) or "."
        out.append(value)
    return ":".join(out)


def without_alleles(line: str, gone: Sequence[int], info: dict | None = None, format: dict | None = None) -> str:
    """A VCF line without ALTs ``gone`` (from 1). Removed alleles in genotypes become '.'; INFO fields without values go, FORMAT values become '.'.

    ``info`` and ``format``: kinds (A, R, G, LA, LR, LG or a number per ALT) of fields besides the usual ones.
    """
    f = line.split("\t")
    alts = _items(f[4])
    if any(not 0 < g <= len(alts) for g in gone):
        raise ValueError(f"no such allele: {list(gone)} of {len(alts)}")
    kept = [i for i in range(len(alts) + 1) if i not in gone]
    new = {a: i for i, a in enumerate(kept)}
    f[4] = ",".join(alts[i - 1] for i in kept if i) or "."
    f[7] = _info(f[7], kept, len(alts) + 1, info or {})
    if len(f) > 9:
        f[9:] = [_sample(f[8].split(":"), x, kept, len(alts) + 1, new, format or {}) for x in f[9:]]
    return "\t".join(f)


def remove_alleles(lines: DataFrame) -> DataFrame:
    """``lines`` (line, gone: array of ALT numbers, and other columns) with the lines shortened; a NULL ``gone`` removes nothing."""
    names = lines.columns
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in lines.schema)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            out = [x if not g else without_alleles(x, g) for x, g in zip(b.column("line").to_pylist(), b.column("gone").to_pylist(), strict=True)]
            columns = [pa.array(out, pa.string()) if n == "line" else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return lines.mapInArrow(run, schema)
