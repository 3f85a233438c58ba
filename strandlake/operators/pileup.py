"""Pileups: what reads show at each reference position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import ON_READ, ON_REFERENCE, cigar_parts, flag_filter
from ..functions.kernels import local_nm_at, with_local_nm

#: Unmapped, secondary, failed and duplicate reads aren't counted. A fixed value.
EXCLUDED = 0x704
#: Reads whose cells, and rows of islands, that one task takes, about.
READS, ROWS = 50_000, 500_000


def _tasks(df: DataFrame, each: int) -> int:
    """As many tasks as give one about ``each`` rows of ``df``, so that what a task holds doesn't grow with the input; the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // each))


def selected(reads: DataFrame, require: int = 0, exclude: int = EXCLUDED, min_mapq: int = 0, keep_orphans: bool = True) -> DataFrame:
    """Reads that a pileup counts; orphans are paired reads that aren't in a proper pair."""
    flag = F.col("flag")
    out = reads.where(flag_filter(flag, require, exclude) & (F.coalesce("mapq", F.lit(255)) >= min_mapq))
    return out if keep_orphans else out.where((flag.bitwiseAND(1) == 0) | (flag.bitwiseAND(2) != 0))


def operations(cigar: Column) -> Column:
    """CIGAR operators with the offsets on reference and read where they start."""
    empty = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("read"), F.array().cast("array<struct<op:string,len:int,ref:int,read:int>>").alias("done"))

    def add(s: Column, p: Column) -> Column:
        here = F.struct(p["op"].alias("op"), p["len"].alias("len"), s["ref"].alias("ref"), s["read"].alias("read"))
        on = lambda ops: F.when(F.instr(F.lit(ops), p["op"]) > 0, p["len"]).otherwise(0)
        return F.struct((s["ref"] + on(ON_REFERENCE)).alias("ref"), (s["read"] + on(ON_READ)).alias("read"), F.concat(s["done"], F.array(here)).alias("done"))

    return F.aggregate(cigar_parts(cigar), empty, add, lambda s: s["done"])


def position_of(pos: Column, cigar: Column, offset: Column) -> Column:
    """The reference position under a read's base; NULL for inserted and clipped ones."""
    own = F.filter(operations(cigar), lambda o: o["op"].isin("M", "=", "X") & (o["read"] <= offset) & (offset < o["read"] + o["len"]))
    return F.try_element_at(F.transform(own, lambda o: pos + o["ref"] + offset - o["read"]), F.lit(1))


def _followed(ops: Column, seq: Column, reverse: Column) -> Column:
    """Operations with ``after``: the text of an insertion or deletion that follows a matched one, +n(bases) or -n(N); the reverse strand in small letters."""

    def text(o: Column) -> Column:
        n = F.try_element_at(F.filter(ops, lambda x: (x["ref"] == o["ref"] + o["len"]) & x["op"].isin("I", "D")), F.lit(1))
        inserted = F.substr(seq, n["read"] + 1, n["len"])
        inserted = F.concat(F.lit("+"), n["len"].cast("string"), F.when(reverse, F.lower(inserted)).otherwise(F.upper(inserted)))
        deleted = F.concat(F.lit("-"), n["len"].cast("string"), F.repeat(F.when(reverse, "n").otherwise("N"), n["len"]))
        return F.coalesce(F.when(o["op"].isin("M", "=", "X"), F.when(n["op"] == "I", inserted).when(n["op"] == "D", deleted)), F.lit(""))

    return F.transform(ops, lambda o: F.struct(*[o[c].alias(c) for c in ("op", "len", "ref", "read")], text(o).alias("after")))


def cells(reads: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A row per read and reference position: the read's columns ``keep`` (all), rname, position, base ('*' deleted, '>' or '<' skipped), offset in the read, head, tail, next_base (the offset, or that of the next base), the character of that base's quality (shown, if reads have qual) and after (the text of an indel that follows).

    A read's operations, and what follows each, are worked out once; what is exploded are single cells, so neither bases nor
    qualities are copied to them whole.
    """
    keep = reads.columns if keep is None else keep
    strand = F.col("flag").bitwiseAND(16) != 0
    rows = reads.withColumn("__ops", operations(F.col("cigar"))).withColumn("__ops", F.filter(_followed(F.col("__ops"), F.col("seq"), strand), lambda o: o["op"].isin(*ON_REFERENCE) & (o["len"] > 0)))
    texts = [c for c in ("seq", "qual") if c in reads.columns]

    def each(o: Column) -> Column:
        real = o["op"].isin("M", "=", "X")
        chars = lambda t: F.when(real, F.split(F.substr(t, o["read"] + 1, o["len"]), "")).otherwise(F.array_repeat(F.substr(t, o["read"] + 1, F.lit(1)), o["len"]))
        zipped = F.arrays_zip(F.sequence(F.lit(0), o["len"] - 1), *[chars(F.coalesce(F.col(t), F.lit(""))) for t in texts])

        def cell(z: Column) -> Column:
            i, c = z["0"], F.coalesce(z["1"], F.lit(""))
            skipped = F.when(o["op"] == "D", "*").when(o["op"] == "N", F.when(strand, "<").otherwise(">"))
            return F.struct(
                (o["ref"] + i).alias("place"), F.coalesce(skipped, F.when(strand, F.lower(c)).otherwise(F.upper(c))).alias("base"), F.when(real, o["read"] + i).alias("offset"),
                (o["read"] + F.when(real, i).otherwise(0)).alias("next_base"), F.when(i == o["len"] - 1, o["after"]).otherwise("").alias("after"), *([z["2"].alias("shown")] if len(texts) > 1 else []),
            )

        return F.transform(F.filter(zipped, lambda z: z["0"].isNotNull()), cell)

    span = F.aggregate("__ops", F.lit(0), lambda s, o: s + o["len"])
    at = rows.select(*keep, F.col("rname").alias("__rname"), F.col("pos").alias("__pos"), span.alias("__span"), F.explode(F.flatten(F.transform("__ops", each))).alias("__c"))
    place = F.col("__c.place")
    own = [F.col("__c." + c) for c in ("base", "offset", "next_base", "after", *(["shown"] if len(texts) > 1 else []))]
    return at.select(*keep, *([] if "rname" in keep else [F.col("__rname").alias("rname")]), (F.col("__pos") + place).alias("position"), (place == 0).alias("head"), (place == F.col("__span") - 1).alias("tail"), *own)


def quality_cells(reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """cells with quality: that of the read's base, or of the next one where it has none; 255 without qualities.

    Reads of one name (and of one value of ``by``) on both strands are set against each other in each column that both show, in order of rec_idx. Of
    equal bases (or two deletions, or two skips) one gets the sum, 200 at most, of equal qualities of different bases 0.8 of
    it, and the other 0; a hash of the name says which. Of different qualities the better one keeps 0.8 and the other gets
    0. A deletion beside a base gets the sum, the base 0.8 of its own, and again one of the two becomes 0.
    """
    c = cells(reads, ["rec_idx", "rname", "qname", "flag", "mapq", *by])
    names = ["rname", "qname", *by]
    c = c.withColumn("quality", F.when(F.coalesce("shown", F.lit("")) == "", 255).otherwise(F.ascii("shown") - 33)).drop("shown")
    strand = F.col("flag").bitwiseAND(16) != 0
    both = reads.groupBy(*names).agg(F.min(strand).alias("low"), F.max(strand).alias("high")).where("low <> high").select(*names)
    alone = c.join(both, names, "left_anti").select(*c.columns)
    shared = c.join(both, names, "left_semi")
    one = F.struct("rec_idx", strand.alias("reverse"), F.upper("base").alias("shown"), "quality", F.struct(*c.columns).alias("row"))
    groups = shared.groupBy("position", *names).agg(F.array_sort(F.collect_list(one)).alias("m"))
    settled = groups.select(F.explode(_settled(F.col("m"), F.col("qname"))).alias("x"))
    again = [F.col(f"x.row.{n}") if n != "quality" else F.col("x.quality") for n in c.columns]
    return alone.unionByName(settled.select(*[a.alias(n) for a, n in zip(again, c.columns, strict=True)]))


def _settled(m: Column, name: Column) -> Column:
    """The rows of one name in a column after each pair of them on different strands, in order, was set against one another."""
    from ..functions.scalars import wang, x31

    first = wang(x31(name)).bitwiseAND(1) == 1
    part = lambda q: F.floor(q * F.lit(0.8)).cast("int")
    mark = lambda r, q: F.struct(r["rec_idx"].alias("rec_idx"), r["reverse"].alias("reverse"), r["shown"].alias("shown"), q.cast("int").alias("quality"), r["row"].alias("row"))

    def meet(a: Column, b: Column) -> Column:
        """struct(a, b): the two qualities that are left."""
        x, y = a["quality"], b["quality"]
        total = F.least(x + y, F.lit(200))
        gone_a, gone_b = a["shown"] == "*", b["shown"] == "*"
        kind = lambda s: F.when(s.isin("<", ">"), ">").otherwise(s)
        p = F.when(gone_a != gone_b, F.when(gone_a, total).otherwise(part(x))).when(kind(a["shown"]) == kind(b["shown"]), total).when(x == y, part(x))
        q = F.when(gone_a != gone_b, F.when(gone_b, total).otherwise(part(y))).when(kind(a["shown"]) == kind(b["shown"]), total).when(x == y, part(y))
        better = F.struct(F.when(x > y, part(x)).otherwise(0).alias("a"), F.when(y > x, part(y)).otherwise(0).alias("b"))
        by_name = F.struct(F.when(first, p).otherwise(0).alias("a"), F.when(first, 0).otherwise(q).alias("b"))
        return F.when(p.isNull(), better).otherwise(by_name)

    def against(rows: Column, i: Column, j: Column) -> Column:
        a, b = F.element_at(rows, i), F.element_at(rows, j)
        left = meet(a, b)
        return F.when(a["reverse"] == b["reverse"], rows).otherwise(F.transform(rows, lambda r, k: F.when(k == i - 1, mark(r, left["a"])).when(k == j - 1, mark(r, left["b"])).otherwise(mark(r, r["quality"]))))

    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(m)), lambda i: F.transform(F.filter(F.sequence(F.lit(1), F.size(m)), lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    start = F.transform(m, lambda r: mark(r, r["quality"]))
    return F.aggregate(pairs, start, lambda rows, p: against(rows, p["i"], p["j"]))


def depth(reads: DataFrame, by: tuple[str, ...] = ("rname",)) -> DataFrame:
    """by, position, depth wherever it is over 0, deletions and skips included.

    A difference array: +1 where a read starts and -1 after its end, summed along each contig in blocks of
    positions, so that neither positions of reads nor contigs are one task's work.
    """
    span = F.aggregate(F.filter(cigar_parts(F.col("cigar")), lambda p: F.instr(F.lit(ON_REFERENCE), p["op"]) > 0), F.lit(0).cast("long"), lambda s, p: s + p["len"])
    r = reads.select(*by, F.col("pos").cast("long").alias("beg"), (F.col("pos") + span).alias("stop")).where("stop > beg")
    width = 1 << 14
    # In each block that a read meets: where it starts there and where it ends there.
    b = r.select(*by, "beg", "stop", F.explode(F.sequence(F.floor(F.col("beg") / width), F.floor((F.col("stop") - 1) / width))).alias("block"))
    low, high = F.greatest("beg", F.col("block") * width), F.least("stop", (F.col("block") + 1) * width)
    ends = b.select(*by, "block", F.explode(F.array(F.struct(low.alias("position"), F.lit(1).alias("d")), F.struct(high.alias("position"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*by, "block", "e.position").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*by, "block").orderBy("position")
    runs = steps.select(*by, "position", F.sum("d").over(w).alias("depth"), F.lead("position").over(w).alias("next"))
    runs = runs.where("depth > 0 and next > position")
    return runs.select(*by, F.explode(F.sequence(F.col("position"), F.col("next") - 1)).alias("position"), "depth")


def base_counts(reads: DataFrame) -> DataFrame:
    """rname, position, base (as in cells), n. An operation's bases are exploded as they are, without the rest of a cell."""
    strand = F.col("flag").bitwiseAND(16) != 0
    rows = reads.select("rname", "pos", "seq", strand.alias("__s"), F.explode(operations(F.col("cigar"))).alias("o")).where(F.col("o.op").isin(*ON_REFERENCE) & (F.col("o.len") > 0))
    piece = F.coalesce(F.substr("seq", F.col("o.read") + 1, F.col("o.len")), F.lit(""))
    piece = F.when(F.col("__s"), F.lower(piece)).otherwise(F.upper(piece))
    each = F.when(F.length(piece) == F.col("o.len"), F.split(piece, "")).otherwise(F.transform(F.sequence(F.lit(1), F.col("o.len")), lambda i: F.substr(piece, i, F.lit(1))))
    gap = F.when(F.col("o.op") == "D", "*").when(F.col("o.op") == "N", F.when(F.col("__s"), "<").otherwise(">"))
    bases = F.when(gap.isNotNull(), F.array_repeat(gap, F.col("o.len"))).otherwise(each)
    at = rows.select("rname", (F.col("pos") + F.col("o.ref")).alias("__first"), F.posexplode(bases).alias("__i", "base"))
    return at.select("rname", (F.col("__first") + F.col("__i")).alias("position"), "base").groupBy("rname", "position", "base").agg(F.count("*").alias("n"))


def columns(reads: DataFrame, by: tuple[str, ...] = (), block: int = 1 << 20) -> DataFrame:
    """rname, position, ``by``, depth, bases and, if reads have qual, quals: the texts of each column, reads in order of rec_idx.

    ^ and the mapping quality's character before a read's first base, $ after its last, insertions as +n(bases)
    and deletions as -n() after the base before them. quals: a character for each read's quality (see quality_cells).
    A column is put together from the texts of ``block`` numbers of rec_idx each, so that a deep one isn't a single list of reads.
    """
    with_quality = "qual" in reads.columns
    c = quality_cells(reads, by) if with_quality else cells(reads, ["rec_idx", "rname", "mapq", *by]).withColumn("quality", F.lit(0))
    start = F.when(F.col("head"), F.concat(F.lit("^"), F.char(F.least(F.coalesce("mapq", F.lit(255)), F.lit(93)) + 33))).otherwise("")
    text = F.concat(start, "base", "after", F.when(F.col("tail"), "$").otherwise(""))
    quality = F.char(F.least(F.col("quality") + 33, F.lit(126)))
    place = ["rname", "position", *by]
    # One shuffle by place serves both steps.
    rows = c.select(*place, F.floor(F.col("rec_idx") / block).alias("part"), F.struct("rec_idx", text.alias("t"), quality.alias("q")).alias("x")).repartition(_tasks(reads, READS), "rname", "position")
    joined = lambda x, n: F.array_join(F.col(x)[n], "")
    parts = rows.groupBy(*place, "part").agg(F.count("*").alias("depth"), F.sort_array(F.collect_list("x")).alias("x"))
    parts = parts.select(*place, "depth", F.struct("part", joined("x", "t").alias("t"), joined("x", "q").alias("q")).alias("x"))
    out = parts.groupBy(*place).agg(F.sum("depth").alias("depth"), F.sort_array(F.collect_list("x")).alias("x"))
    out = out.select(*place, "depth", joined("x", "t").alias("bases"), joined("x", "q").alias("quals"))
    return out if with_quality else out.drop("quals")


def synchronized(reads: DataFrame, inputs: int, by: str = "input") -> DataFrame:
    """rname, position, depth, and per input (the numbers from 0 of column ``by``) depth_i, bases_i and, if reads have qual, quals_i: the columns of several inputs side by side, 0 and empty where one shows nothing."""
    c = columns(reads, (by,))
    texts = [n for n in ("bases", "quals") if n in c.columns]
    mine = lambda i, n: F.max(F.when(F.col(by) == i, F.col(n)))
    each = [x for i in range(inputs) for x in (F.coalesce(mine(i, "depth"), F.lit(0)).alias(f"depth_{i}"), *[F.coalesce(mine(i, n), F.lit("")).alias(f"{n}_{i}") for n in texts])]
    return c.groupBy("rname", "position").agg(F.sum("depth").alias("depth"), *each)


def local_nm_cells(reads: DataFrame, keep: list[str], halo: int = 50, clip: int = 60) -> DataFrame:
    """``keep``, rname, position, next_base, nm_local and homopolymer: per read and reference position what speaks against the read there (see kernels.local_nm_of).

    reads: seq, qual, cigar, pos, md. A cell shows the score and the run of the base after its own; cells take single values along, not the arrays.
    """
    rows = with_local_nm(reads, halo, clip).withColumn("__ops", operations(F.col("cigar")))

    def each(o: Column) -> Column:
        def cell(i: Column) -> Column:
            base = o["read"] + F.when(o["op"].isin("D", "N"), 0).otherwise(i)
            score, run = local_nm_at(base)
            return F.struct((o["ref"] + i).alias("place"), base.alias("next_base"), score.alias("nm_local"), run.alias("homopolymer"))

        return F.transform(F.sequence(F.lit(0), o["len"] - 1), cell)

    ops = F.filter("__ops", lambda o: o["op"].isin(*ON_REFERENCE) & (o["len"] > 0))
    at = rows.select(*keep, F.col("rname").alias("__rname"), F.col("pos").alias("__pos"), F.explode(F.flatten(F.transform(ops, each))).alias("__c"))
    return at.select(*keep, F.col("__rname").alias("rname"), (F.col("__pos") + F.col("__c.place")).alias("position"), "__c.next_base", "__c.nm_local", "__c.homopolymer")


def islands(reads: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Consecutive reads of one name get one number: island, by order of rec_idx within each contig.

    A read starts an island if the one before it has another name. Rows are ordered within blocks of ``width`` numbers
    of rec_idx; only a row per block is ordered within a contig, to say how the block before it ends.
    """
    tasks = _tasks(reads, ROWS)
    blocks = reads.withColumn("__block", F.floor(F.col("rec_idx") / width)).repartition(tasks, "rname", "__block")
    w = Window.partitionBy("rname", "__block").orderBy("rec_idx")
    own = F.when(F.row_number().over(w) == 1, F.lit(0)).when(F.col("qname").eqNullSafe(F.lag("qname").over(w)), 0).otherwise(1)
    rows = blocks.withColumn("__new", own).withColumn("__n", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = blocks.groupBy("rname", "__block").agg(F.min_by(F.struct("qname"), "rec_idx").alias("a"), F.max_by(F.struct("qname"), "rec_idx").alias("z"))
    inner = rows.groupBy("rname", "__block").agg(F.sum("__new").alias("k"))
    before = ends.join(inner, _same("rname", ends, inner) & (ends["__block"] == inner["__block"])).select(ends["rname"].alias("__r"), ends["__block"].alias("__b"), "a", "z", "k")
    order = Window.partitionBy("__r").orderBy("__b")
    starts = F.when(F.col("a.qname").eqNullSafe(F.lag("z.qname").over(order)) & F.lag("z").over(order).isNotNull(), 0).otherwise(1)
    before = before.withColumn("__starts", starts).withColumn("__base", F.sum(F.col("__starts") + F.col("k")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("k"))
    both = rows.join(before.select("__r", "__b", "__base"), F.col("rname").eqNullSafe(F.col("__r")) & (F.col("__block") == F.col("__b")))
    return both.withColumn("island", F.col("__base") + F.col("__n")).select(*reads.columns, "island").repartition(tasks, "rname", "island")


def _same(name: str, a: DataFrame, b: DataFrame) -> Column:
    return a[name].eqNullSafe(b[name])


def template_lengths(reads: DataFrame) -> DataFrame:
    """Template lengths anew for islands of two or more reads: the span from the leftmost start to the rightmost end; plus for the leftmost (the first read of equals), minus for the others."""
    span = F.aggregate(F.filter(cigar_parts(F.col("cigar")), lambda p: F.instr(F.lit(ON_REFERENCE), p["op"]) > 0), F.lit(0).cast("long"), lambda s, p: s + p["len"])
    rows = islands(reads.withColumn("__end", F.col("pos") + span))
    w = Window.partitionBy("rname", "island")
    n, length = F.count("*").over(w), F.max("__end").over(w) - F.min("pos").over(w)
    first = F.row_number().over(w.orderBy("pos", (F.col("flag").bitwiseAND(64) == 0), "rec_idx")) == 1
    return rows.withColumn("tlen_new", F.when(n < 2, 0).otherwise(F.when(first, length).otherwise(-length))).drop("__end")


def mates(reads: DataFrame) -> DataFrame:
    """qname, rname and the structs a, b of two mapped mates on one contig, a the left one; names with more or fewer reads have none."""
    flag = F.col("flag")
    r = reads.where((flag.bitwiseAND(1) != 0) & (flag.bitwiseAND(12) == 0))
    both = F.array_sort(F.collect_list(F.struct("pos", "rec_idx", *[c for c in reads.columns if c not in ("pos", "rec_idx", "qname", "rname", "aux")])))
    # A name that is on more reads than a pair is counted first, so its rows are never gathered.
    pairs = r.groupBy("qname", "rname").agg(F.count("*").alias("n")).where("n = 2").drop("n")
    found = r.join(pairs, ["qname", "rname"]).groupBy("qname", "rname").agg(both.alias("m"))
    return found.select("qname", "rname", F.col("m")[0].alias("a"), F.col("m")[1].alias("b"))


def overlap_qualities(reads: DataFrame) -> DataFrame:
    """rec_idx and qual_new (array) of mates that overlap: a base that both show counts once.

    Equal bases: the sum, 200 at most, goes to one mate and 0 to the other; a hash of the name says which. Different
    bases: the better one keeps 0.8 of its quality, of equals that of the same mate, and the other gets 0.
    """
    import pyarrow as pa

    from ..functions.kernels import operations as parts

    def cells_of(pos: int, cigar: str) -> dict[int, int]:
        out, at, i = {}, pos, 0
        for n, o in parts(cigar):
            if o in "M=X":
                out |= {at + k: i + k for k in range(n)}
            at += n * (o in ON_REFERENCE)
            i += n * (o in ON_READ)
        return out

    def run(batches):
        for b in batches:
            ids, quals = [], []
            for keep, x, y in zip(b.column("keep").to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                p, q = cells_of(x["pos"], x["cigar"]), cells_of(y["pos"], y["cigar"])
                qx, qy = ([ord(c) - 33 for c in r["qual"]] for r in (x, y))
                for at in p.keys() & q.keys():
                    i, j = p[at], q[at]
                    u, v = qx[i], qy[j]
                    if x["seq"][i] == y["seq"][j]:
                        best, first = min(u + v, 200), keep
                    else:
                        best, first = int(0.8 * max(u, v)), u > v or (u == v and keep)
                    qx[i], qy[j] = (best, 0) if first else (0, best)
                ids += [x["rec_idx"], y["rec_idx"]]
                quals += [qx, qy]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(quals, pa.list_(pa.int32()))], names=["rec_idx", "qual_new"])

    from ..functions.scalars import wang, x31

    slim = mates(reads.select("rec_idx", "qname", "rname", "pos", "flag", "cigar", "seq", "qual"))
    return slim.select((wang(x31(F.col("qname"))).bitwiseAND(1) == 0).alias("keep"), "a", "b").mapInArrow(run, "rec_idx long, qual_new array<int>")
