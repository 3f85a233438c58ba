"""Edits of variant records as columns, headers, sample translation, times, bit sets and texts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_filter(filters: Column, name: str) -> Column:
    """PASS goes when another filter comes; a filter is there once; PASS replaces all."""
    if name == "PASS":
        return F.array(F.lit("PASS"))
    others = F.filter(filters, lambda x: x != "PASS")
    return F.when(F.array_contains(others, name), others).otherwise(F.array_append(others, F.lit(name)))


def remove_filter(filters: Column, name: str) -> Column:
    """The last filter's removal leaves PASS."""
    left = F.array_remove(filters, F.lit(name))
    return F.when((F.size(left) == 0) & F.array_contains(filters, name), F.array(F.lit("PASS"))).otherwise(left)


def has_filter(filters: Column, name: str) -> Column:
    """'.' and PASS both stand for a record that passes."""
    return F.array_contains(filters, name) | (F.lit(name in ("PASS", ".")) & ((F.size(filters) == 0) | F.array_contains(filters, "PASS")))


def set_info(info: Column, key: str, value: Column | None) -> Column:
    """A key's value replaced, added, or (None) removed; nothing left is '.'."""
    parts = F.filter(F.split(info, ";"), lambda x: (x != ".") & (x != ""))
    mine = lambda x: (x == key) | x.startswith(f"{key}=")
    if value is None:
        out = F.filter(parts, lambda x: ~mine(x))
    else:
        new = F.concat(F.lit(f"{key}="), value)
        out = F.when(F.exists(parts, mine), F.transform(parts, lambda x: F.when(mine(x), new).otherwise(x))).otherwise(F.array_append(parts, new))
    return F.coalesce(F.nullif(F.array_join(out, ";"), F.lit("")), F.lit("."))


def set_format(keys: Column, samples: Column, key: str, values: Column) -> tuple[Column, Column]:
    """(keys, samples) with a FORMAT key's value per sample replaced or added; shorter samples are padded with '.'."""
    at = F.array_position(keys, key)
    new_keys = F.when(at > 0, keys).otherwise(F.array_append(keys, F.lit(key)))

    def one(sample: Column, value: Column) -> Column:
        padded = F.concat(sample, F.array_repeat(F.lit("."), F.greatest(F.size(new_keys) - F.size(sample), F.lit(0))))
        return F.transform(padded, lambda x, i: F.when(i == F.when(at > 0, at - 1).otherwise(F.size(keys)), value).otherwise(x))

    return new_keys, F.zip_with(samples, values, one)


@dataclass
class VcfHeader:
    """Identifiers of a header by kind, with their attributes in order."""

    lines: list[str] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)
    ids: dict[str, dict[str, dict[str, str]]] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> VcfHeader:
        out = cls()
        for line in text.splitlines():
            if line.startswith("#CHROM"):
                out.samples = line.split("\t")[9:]
            elif line.startswith("##"):
                out.add(line)
        return out

    def add(self, line: str) -> None:
        m = re.fullmatch(r"##(\w+)=<(.*)>", line)
        if m:
            attributes = {k: v.strip('"') for k, v in re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)', m[2])}
            if "ID" not in attributes:
                raise ValueError(f"no ID: {line}")
            if attributes["ID"] in self.ids.setdefault(m[1], {}):
                return  # the first one stays
            self.ids[m[1]][attributes["ID"]] = attributes
        self.lines.append(line)

    def remove(self, kind: str, ident: str) -> bool:
        if ident not in self.ids.get(kind, {}):
            return False
        del self.ids[kind][ident]
        self.lines = [x for x in self.lines if not re.match(rf"##{kind}=<ID={re.escape(ident)}[,>]", x)]
        return True

    def missing_from(self, other: VcfHeader) -> list[tuple[str, str]]:
        """Identifiers that ``other`` lacks: records with them can't be translated to it."""
        return [(k, i) for k in ("contig", "INFO", "FORMAT", "FILTER") for i in self.ids.get(k, {}) if i not in other.ids.get(k, {}) and i != "PASS"]

    def text(self) -> str:
        head = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
        return "\n".join([*self.lines, "\t".join(head + (["FORMAT", *self.samples] if self.samples else []))]) + "\n"


def sample_order(source: list[str], target: list[str]) -> list[int | None]:
    """For each target sample its place in the source, None where it has none."""
    return [source.index(s) if s in source else None for s in target]


def translate_samples(samples: Column, order: list[int | None]) -> Column:
    """Samples in the order of another header; missing ones are '.'."""
    none = F.array(F.lit("."))
    return F.array(*[none if i is None else F.coalesce(F.try_element_at(samples, F.lit(i + 1)), none) for i in order])


def append_to_sam_header(header: str, kind: str, tags: dict[str, str]) -> str:
    """A header with a line of its own type appended; HD comes first and once, names are unique."""
    line = "\t".join([f"@{kind}", *(f"{k}:{v}" for k, v in tags.items())])
    lines = header.splitlines()
    name = {"SQ": "SN", "RG": "ID", "PG": "ID"}.get(kind)
    if kind == "HD":
        if any(x.startswith("@HD") for x in lines):
            raise ValueError("there is an @HD line")
        lines.insert(0, line)
    else:
        if name and any(x.startswith(f"@{kind}\t") and f"{name}:{tags.get(name)}" in x.split("\t") for x in lines):
            raise ValueError(f"{tags.get(name)} is there")
        lines.append(line)
    return "\n".join(lines) + "\n"


def utc_seconds(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since 1970 of a UTC time whose parts may lie outside their ranges; a time before 1970 is an error."""
    months = year * 12 + month - 1
    first = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    out = (F.unix_date(first).cast("long") + day - 1) * 86400 + hour * 3600 + minute * 60 + second
    return F.when(out < 0, F.raise_error(F.lit("before 1970")).cast("long")).otherwise(out)


def bit_set(values: Column, words: int) -> Column:
    """Numbers as bits of an array of 64-bit words."""
    one = lambda w: F.aggregate(F.filter(values, lambda v: F.shiftright(v.cast("long"), 6) == w), F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v.cast("int"), F.lit(64)))))
    return F.array(*[one(i) for i in range(words)])


def bits_both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def bits_either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def bits_count(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))


def find_text(text: Column, part: Column) -> Column:
    """0-based place of the first occurrence, NULL without one."""
    return F.nullif(F.instr(text, part) - 1, F.lit(-1)) if isinstance(part, str) else F.nullif(F.position(part, text) - 1, F.lit(-1))


def escaped(text: Column, most: int | None = None) -> Column:
    r"""A text with \n, \t, \r, \\ and quotes escaped; longer ones than ``most`` are cut and end in '...'."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ('"', '\\"')):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out if most is None else F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 3), F.lit("..."))).otherwise(out)


def rand48(seed: int, n: int) -> list[float]:
    """The first n numbers of the 48-bit linear congruential generator."""
    x, out = (seed & 0xFFFFFFFF) << 16 | 0x330E, []
    for _ in range(n):
        x = (0x5DEECE66D * x + 0xB) & (1 << 48) - 1
        out.append(x / 2.0**48)
    return out


#: Message styles that a log line may break. Fixed values.
STYLES = {"newline": r"\n$", "full_stop": r"\.\s*$", "lower_case": r"^[a-z]"}


def log_style(message: Column) -> Column:
    """The names of the styles that a message breaks."""
    return F.filter(F.array(*[F.when(message.rlike(p), F.lit(n)) for n, p in STYLES.items()]), lambda x: x.isNotNull())


def read_group_libraries(header: str) -> dict[str, str]:
    """Read group -> library of a SAM header's @RG lines; those without LB have none."""
    found = {}
    for line in header.splitlines():
        if line.startswith("@RG\t"):
            f = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
            if "ID" in f and "LB" in f:
                found.setdefault(f["ID"], f["LB"])
    return found


def with_library(reads: DataFrame, header: str) -> DataFrame:
    """``reads`` with library: that of the read group which the RG tag names, else NULL. A header's read groups become a literal map."""
    groups = read_group_libraries(header)
    entries = [x for k, v in groups.items() for x in (F.lit(k), F.lit(v))]
    known = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return reads.withColumn("library", F.try_element_at(known, F.col("aux")["RG"]["value"]))
