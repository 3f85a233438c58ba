"""Prefix trie of conversations, in which the smallest member of a node owns it.

A conversation's path runs from the root over its turns. The nodes that it owns, where no smaller conv_id
comes by, are a suffix of its path: from the first owned node on, all deeper ones are its own too. So a
node is told by its owner and its depth, and what a subtree holds is summed without walking it: each member
brings the tokens of its path's turns from the node down (occurrences) less those of the nodes it owns,
and a flag if it owns a leaf. Occurrences less owned ones are what sharing each node once would save.

Prefixes are told apart by the exclusive or of 128-bit hashes of (turn, depth) down the path, a running
sum, so that one very long conversation can be cut into blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scope, join_heavy, lean, rows_only

#: Turns of a conversation that one window holds at a time.
BLOCK = 4096
#: conv_ids of one text in what is hashed for a node's ends.
IDS = 4096

KEY = ["ka", "kb", "depth"]


def positions(scope: Scope, turns: DataFrame) -> DataFrame:
    """conv_id, i (from 0, by turn, null first, then by the md5 of role and text), mark (that md5), nb (UTF-8 bytes of the text).

    One range partitioning orders all turns, so that a conversation of any length is spread over tasks. Null role
    or text is empty; rows without a conv_id take no part.
    """
    rows = rows_only(turns, "conv_id", "turn", "role", "text").where("conv_id is not null")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"), F.octet_length(text).cast("long").alias("nb"))
    order = ["conv_id", "turn", "mark", "row"]
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = scope.table(rows.select("conv_id", "mark", "nb", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "turns")
    piece = Window.partitionBy("conv_id", "part")
    rows = rows.withColumn("i", F.col("seq") - F.min("seq").over(piece))
    # A partition continues at most one conversation, so there are fewer such pieces than partitions.
    pieces = rows.groupBy("conv_id", "part").count()
    before = F.sum("count").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("conv_id", "part", before.alias("before")).where("before is not null")
    rows = rows.join(F.broadcast(pieces), ["conv_id", "part"], "left")
    return scope.table(rows.select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "mark", "nb"), "positions")


def branched(rows: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Positions of rebuilt conversations: the first h turns of conversation c - c % ``group``, then c's own turns after its first h; h = crc32(c) % ``most``.

    ``i`` keeps the order, but has a gap where the other conversation is shorter than h. Remainders have the sign of c.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % group
    taken = rows.select("conv_id").distinct().where((base != F.col("conv_id")) & (h > 0))
    taken = taken.select(base.alias("base"), F.explode(F.sequence(F.lit(0).cast("long"), h - 1)).alias("i"), "conv_id")
    first = rows.where(F.col("i") < most).withColumnRenamed("conv_id", "base")
    own = rows.where((base == F.col("conv_id")) | (F.col("i") >= h))
    return own.unionByName(taken.join(first, ["base", "i"]).select("conv_id", "i", "mark", "nb"))


def _over_blocks(rows: DataFrame, sums: dict[str, Column], back: dict[str, Column]) -> DataFrame:
    """``rows`` beside sums over all earlier (``sums``) and later (``back``) blocks of their conversation; null where there are none."""
    order = Window.partitionBy("conv_id").orderBy("block")
    blocks = rows.groupBy("conv_id", "block").agg(*[v.alias(k) for k, v in (sums | back).items()])
    combine = {k: F.bit_xor(k) if k[0] == "k" else F.sum(k) for k in sums | back}
    carried = blocks.select(
        "conv_id", "block", *[combine[k].over(order.rowsBetween(Window.unboundedPreceding, -1)).alias(k) for k in sums], *[combine[k].over(order.rowsBetween(1, Window.unboundedFollowing)).alias(k) for k in back]
    )
    carried = carried.where(" or ".join(f"{k} is not null" for k in sums | back))
    return rows.join(carried, ["conv_id", "block"], "left")


def occurrences(scope: Scope, rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, block, depth, nb, ka and kb (of the node), pa and pb (of its parent), path (bytes down to it), ends: a row per conversation and node on its path, the root too.

    ``rows``: conv_id, i, mark, nb; ``conversations``: all conv_ids, as some may have no turns.
    """
    rows = rows.unionByName(conversations.select("conv_id", F.lit(-1).cast("long").alias("i"), F.lit("").alias("mark"), F.lit(0).cast("long").alias("nb")))
    rows = rows.withColumn("block", F.floor((F.col("i") + 1) / BLOCK).cast("long"))
    order = Window.partitionBy("conv_id", "block").orderBy("i")
    rows = _over_blocks(rows, {"before": F.count("*")}, {})
    rows = rows.select("conv_id", "block", (F.row_number().over(order) - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("depth"), "mark", "nb")
    rows = rows.withColumns({"xa": F.xxhash64("mark", "depth"), "xb": F.xxhash64(F.lit(1), "mark", "depth")})
    rows = scope.table(rows.drop("mark"), "steps")
    rows = _over_blocks(rows, {"ka": F.bit_xor("xa"), "kb": F.bit_xor("xb"), "path": F.sum("nb")}, {"later": F.count("*")})
    order = Window.partitionBy("conv_id", "block").orderBy("depth")
    zero = F.lit(0).cast("long")
    down = {
        "ka": F.bit_xor("xa").over(order).bitwiseXOR(F.coalesce("ka", zero)),
        "kb": F.bit_xor("xb").over(order).bitwiseXOR(F.coalesce("kb", zero)),
        "path": F.sum("nb").over(order) + F.coalesce("path", zero),
        "ends": F.lead("depth").over(order).isNull() & F.col("later").isNull(),
    }
    rows = rows.select("conv_id", "block", "depth", "nb", "xa", "xb", *[v.alias(k) for k, v in down.items()])
    rows = rows.withColumns({"pa": F.col("ka").bitwiseXOR(F.col("xa")), "pb": F.col("kb").bitwiseXOR(F.col("xb"))})
    return scope.table(rows.drop("xa", "xb"), "occurrences")


def _joined(batches: Iterator) -> Iterator:
    """Sorted (ka, kb, depth, conv_id) -> ids of up to IDS conversations as one text each."""
    names = [*KEY, "first", "ids"]
    for b in batches:
        key = [*zip(*(b.column(c).to_pylist() for c in KEY), strict=True)]
        ids, out, start = b.column("conv_id").to_pylist(), [], 0
        for i in range(1, len(key) + 1):
            if i == len(key) or key[i] != key[start] or i - start == IDS:
                out.append((*key[start], ids[start], ",".join(map(str, ids[start:i]))))
                start = i
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "ids" else pa.int64()) for n, x in zip(names, zip(*out, strict=True) if out else [[]] * 5, strict=True)], names=names)


def _digests(batches: Iterator) -> Iterator:
    """Texts sorted by node and first id -> the SHA-256 of a node's texts, taken as they come."""
    node, state, out = None, None, []
    for b in batches:
        for ka, kb, d, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if (ka, kb, d) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (ka, kb, d), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield _digest_rows(out)
        out = []
    if node:
        yield _digest_rows([(*node, state.hexdigest())])


def _digest_rows(out: list[tuple]) -> pa.RecordBatch:
    names = [*KEY, "ends_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "ends_sha256" else pa.int64()) for n, x in zip(names, zip(*out, strict=True) if out else [[]] * 4, strict=True)], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """ka, kb, depth, ends_sha256 of the nodes at which conversations (``ends``) end: SHA-256 of their conv_ids, ascending, between commas.

    Ids are put into texts of up to IDS where a range partitioning has ordered them, so what one task hashes in turn is a
    few rows even for a node at which a large part of all conversations end; none are gathered in memory.
    """
    order = [*KEY, "conv_id"]
    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    texts = texts.mapInArrow(lean(_joined), "ka long, kb long, depth long, first long, ids string")
    texts = texts.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return texts.mapInArrow(lean(_digests), "ka long, kb long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, branch: tuple[int, int] | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node.

    A node is a distinct sequence of (role, text) that conversations of ``turns`` (conv_id, turn, role, text) begin with;
    conv_id is its smallest member. Tokens are UTF-8 bytes. With ``branch`` (group, most) conversations are first rebuilt as
    in ``branched``, of which some may be left without turns: they end at the root. Turns come by ``turn``, null first; of equal
    turns and of repeated rows, each one a turn, by md5 of role and text. Null role or text counts as empty; rows without a conv_id
    take no part; no rows, no nodes. Other columns are ignored.
    """
    with Scope(turns.sparkSession) as scope:
        rows = positions(scope, turns)
        seen = occurrences(scope, branched(rows, *branch) if branch else rows, rows.select("conv_id").distinct())
        ends = seen.where("ends").select("conv_id", *KEY, "block", "path")
        nodes = seen.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.max("path").alias("path"), F.max("nb").alias("nb"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), (F.sum(F.col("ends").cast("long")) == F.count("*")).alias("leaf"))
        nodes = scope.table(nodes, "nodes")
        # What a conversation owns begins at its smallest owned depth; bytes above that are of nodes that others own.
        first = F.min(F.struct("depth", (F.col("path") - F.col("nb")).alias("above")))["above"]
        owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(first.alias("above"), F.max("leaf").cast("long").alias("leaf"))
        members = ends.join(owned, "conv_id", "left").select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("block"), F.coalesce("above", "path").alias("above"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))
        # A member's turns from the node down, less those it owns: the bytes from the node to its first owned one.
        shared = F.greatest(F.lit(0).cast("long"), F.col("above") - F.col("path") + F.col("nb"))
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        parts = seen.join(members, ["conv_id", "block"]).select(*KEY, one.alias("convs"), none.alias("children"), "leaf", shared.alias("saved"))
        up = nodes.where("depth > 0").select(F.col("pa").alias("ka"), F.col("pb").alias("kb"), (F.col("depth") - 1).alias("depth"), none.alias("convs"), one.alias("children"), none.alias("leaf"), none.alias("saved"))
        sums = parts.unionByName(up).groupBy(*KEY).agg(F.sum("convs").alias("n_convs"), F.sum("children").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        found = scope.table(nodes.select(*KEY, "owner", "pa", "pb").join(sums, KEY).join(end_digests(ends), KEY, "left"), "sums")
        above = found.where("n_children > 0").select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"), F.col("n_children").alias("brood"))
        below = join_heavy(found.where("depth > 0"), above, ["pa", "pb", "depth"], "brood", nodes.count())
        found = below.drop("brood").unionByName(found.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
        out = found.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
        return scope.result(out, "trie")
