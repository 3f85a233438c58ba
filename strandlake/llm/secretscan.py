"""Secret scans: fixed patterns, and the entropy of a window that slides over candidate strings.

Native: columns only. Places of all matches of a pattern come from the pieces between them (split) and the
matches themselves, summed up by windows. Candidate strings are the long runs of a character class. The sum
of c * log2(c) over a window's character counts c gives its entropy; it is kept incrementally: a character
that enters adds what its count grows by, one that leaves takes off what its count shrinks by, and both
depend only on how often it occurs in the characters next to it. Sums are integers, so results are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scope, rows_only

# Fixed values.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"

#: What matches may be too short in: characters of group 2 of an assignment, of an access key, of a hexadecimal run.
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_token"]

#: Characters in a window, and by class: its characters, and bits per character from which a window counts.
WINDOW = 20
CLASSES = {"entropy_hex": ("0-9A-Fa-f", 3.0), "entropy_token": ("A-Za-z0-9+/_-", 3.7)}

#: Candidates that are none: numbers, single words, UUIDs, paths of words, placeholders, alphabets and rows of digits.
ALLOWED = (
    "^[0-9]+$",
    "^[A-Za-z]?[a-z]+$|^[A-Z]+$",
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^/?[a-z]+[0-9]?(/[a-z_-]+[0-9]?)+/?$",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]|[Rr][Ee][Dd][Aa][Cc][Tt][Ee][Dd]|[Xx]{6}",
    "[Aa][Bb][Cc][Dd][Ee][Ff][Gg]|0123456|1234567",
)

#: Windows that begin in one block of a candidate.
BLOCK = 4096

#: c * log2(c) for counts c up to WINDOW, in millionths of a bit.
WEIGHTS = [0, *(round(c * math.log2(c) * 1e6) for c in range(1, WINDOW + 1))]


def limit(bits: float) -> int:
    """The largest sum of WEIGHTS over a window's counts with that many bits of entropy per character or more."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1e6)


def _matches(text: Column, kind: int, pattern: str, keep, with_text: bool) -> Column:
    """All matches, null if there are none, as structs: kind, number, characters between the match before and this one, its length, whether it is kept, its text."""
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda z: z["1"].isNotNull())
    found = F.transform(
        pairs,
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(z["0"]).cast("long").alias("gap"), F.length(z["1"]).cast("long").alias("len"), keep(z["1"]).alias("keep"), (z["1"] if with_text else F.lit(None).cast("string")).alias("s")
        ),
    )
    return F.when(text.rlike(pattern), found)


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """start, end of rows that touch or overlap joined, by ``keys``; both grow together."""
    order = Window.partitionBy(*keys).orderBy("start")
    rows = rows.withColumn("fresh", F.coalesce(F.col("start") > F.lag("end").over(order), F.lit(True)).cast("long"))
    rows = rows.withColumn("island", F.sum("fresh").over(order))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _dense(found: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """row, kind, start, end: stretches of candidates that windows of high entropy cover."""
    s = F.col("s")
    for pattern in allowed:
        found = found.where(~s.rlike(pattern))
    # Blocks overlap by a window less one character, so each is searched alone.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length("s") - WINDOW) / BLOCK).cast("int")), lambda b: F.struct((b * BLOCK).alias("at"), F.substr(s, b * BLOCK + 1, F.lit(BLOCK + WINDOW - 1)).alias("s")))
    found = found.select("row", "kind", "start", F.explode(blocks).alias("b")).select("row", "kind", (F.col("start") + F.col("b.at")).alias("at"), F.col("b.s").alias("s"))
    block = ["row", "kind", "at"]
    chars = found.repartition(*block).select(*block, F.posexplode(F.split("s", "")).alias("pos", "char")).where("char <> ''")
    same = Window.partitionBy(*block, "char").orderBy("pos")
    weights = F.array(*[F.lit(b - a) for a, b in zip(WEIGHTS, WEIGHTS[1:], strict=False)])
    grows = F.get(weights, F.count("*").over(same.rangeBetween(1 - WINDOW, -1)).cast("int"))
    shrinks = F.get(weights, F.count("*").over(same.rangeBetween(1, WINDOW - 1)).cast("int"))
    chars = chars.select(*block, "pos", grows.alias("grows"), shrinks.alias("shrinks"))
    order = Window.partitionBy(*block).orderBy("pos")
    left = F.coalesce(F.sum("shrinks").over(order.rowsBetween(Window.unboundedPreceding, -WINDOW)), F.lit(0))
    chars = chars.withColumn("sum", F.sum("grows").over(order.rowsBetween(Window.unboundedPreceding, 0)) - left)
    most = F.element_at(F.create_map(*[x for k, (_, bits) in CLASSES.items() for x in (F.lit(KINDS.index(k)), F.lit(limit(bits)))]), F.col("kind"))
    dense = chars.where((F.col("pos") >= WINDOW - 1) & (F.col("sum") <= most))
    dense = dense.select(*block, (F.col("at") + F.col("pos") + 1 - WINDOW).alias("start"), (F.col("at") + F.col("pos") + 1).alias("end"))
    return _islands(_islands(dense, block).select("row", "kind", "start", "end"), ["row", "kind"])


def find_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, spans: per row the places of secrets, by start and kind: structs of kind (of KINDS), start, end (code points, end exclusive).

    Per kind, matches are leftmost and don't overlap; a match that is too short is dropped after it has been
    taken. Entropy spans are stretches of candidate strings (runs of a class of at least WINDOW characters) that windows with enough
    bits per character cover, unless the candidate matches a pattern of ``allowed``. Null and empty texts hold none; repeated rows and
    null doc_ids keep a row each; other columns are ignored. A span of one kind may lie within one of another.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    long = lambda n: lambda m: F.length(m) >= n
    every = lambda m: F.lit(True)
    kinds = [
        _matches(text, 0, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGN, False),
        # These patterns take whole runs, so the long ones can be asked for at once.
        _matches(text, 1, ACCESS.replace("+", f"{{{LEAST_ACCESS - 4},}}"), every, False),
        _matches(text, 2, HEX.replace("+", f"{{{LEAST_HEX},}}"), every, False),
        *[_matches(text, KINDS.index(k), f"[{chars}]{{{WINDOW},}}", every, True) for k, (chars, _) in CLASSES.items()],
    ]
    none = F.array().cast("array<struct<kind:int,i:int,gap:bigint,len:bigint,keep:boolean,s:string>>")
    with Scope(docs.sparkSession) as scope:
        rows = rows_only(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*[F.coalesce(k, none) for k in kinds]).alias("found"))
        rows = rows.select("row", "doc_id", F.explode_outer("found").alias("m")).select("row", "doc_id", "m.*")
        order = Window.partitionBy("row", "kind").orderBy("i")
        start = F.sum("gap").over(order) + F.coalesce(F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("start", start).withColumn("end", F.col("start") + F.col("len"))
        found = scope.table(rows.select("row", "doc_id", "kind", "start", "end", "keep", "s"), "matches")
        base = found.select("row", "doc_id", F.when(F.col("keep") & F.col("s").isNull(), F.struct("start", "kind", "end")).alias("span"))
        dense = _dense(found.where("s is not null"), allowed).select("row", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.struct("start", "kind", "end").alias("span"))
        spans = F.sort_array(F.collect_list("span"))
        names = F.array(*map(F.lit, KINDS))
        spans = F.transform(spans, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        out = base.unionByName(dense).groupBy("row").agg(F.max("doc_id").alias("doc_id"), spans.alias("spans")).select("doc_id", "spans")
        return scope.result(out, "secrets")


def joined(spans: Column) -> Column:
    """kind:start:end of spans, between commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
