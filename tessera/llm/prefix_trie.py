"""The trie of conversations by shared first turns: van Emde Boas recursion.

Sequences are cut at fixed depths: a sequence taller than a block is cut in blocks, and the sequence of its whole blocks is
an upper trie of far smaller depth, named and totalled by the same functions. Its names are the names of the cut prefixes,
from which the lower forests of all blocks are built in parallel; inside a block, a task cuts at half the depth again and
again, down to single turns. Totals go the other way: those of the lower forests come to the cut nodes, the upper trie
grafts them upward, and each block adds what it gets at its lower end to the nodes above.

A name is 128 bits of hash of the cut prefix's name and the turns since the cut, so equal prefixes get equal names wherever
they are; nothing is joined to name them. A conversation's nodes of which it is the smallest member are the last ones of its
path, so it alone reports their values, and every value is counted once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import scratch

#: Turns of one conversation that a task holds at once; ids in one packed piece of a node's ends.
LOCAL, PIECE = 256, 1024
#: The root's turn.
ROOT = bytes(16)
_EMPTY = hashlib.sha256(b"").hexdigest()
_TOTALS = ("leaves", "saved")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), sym (128 bits of hash of role and text) and chars (code points of the text) of every turn.

    Turns stand in the order of turn (null first), equal ones in that of sym. Null role or text is empty. Rows without
    conv_id belong to no conversation and are left out. Repeated rows are turns of their own. A conversation of any length
    is numbered in parallel: equal rows are counted first, a range exchange cuts the order, counts of the ranges say where
    each one starts.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    sym = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", sym.alias("sym"), F.length(text).cast("long").alias("chars"))
    counted = rows.groupBy("conv", "turn", "sym", "chars").agg(F.count("*").alias("copies"))
    cuts = scratch.cut(counted.repartitionByRange(scratch.shuffle_width(spark), "conv", "turn", "sym").withColumn("run", F.spark_partition_id()))
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = cuts.groupBy("conv", "run").agg(F.sum("copies").alias("n")).select("conv", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv", "run").orderBy("turn", "sym").rowsBetween(Window.unboundedPreceding, 0)
    placed = cuts.withColumn("end", F.sum("copies").over(inside)).join(starts, ["conv", "run"])
    first = F.col("start") + F.col("end") - F.col("copies")
    return placed.select("conv", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("pos"), "sym", "chars")


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % 100, then its own after its first h; h = crc32 of the decimal c, modulo 6. Also (conv, pos -1, null sym) for each, as a rebuilt one may have no turns."""
    turns = scratch.cut(turns)
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).alias("h")
    base = F.col("conv") - F.col("conv") % 100
    convs = turns.where("pos = 0").select("conv", h, base.alias("base"))
    heads = turns.where((F.col("conv") % 100 == 0) & (F.col("pos") < 5)).select(F.col("conv").alias("base"), "pos", "sym", "chars")
    taken = convs.where("h > 0").join(heads, "base").where("pos < h").select("conv", "pos", "sym", "chars")
    many = heads.groupBy("base").agg(F.count("*").alias("many"))
    short = convs.join(many, "base", "left").select("conv", (F.col("h") - F.coalesce("many", F.lit(0))).alias("shift")).where("shift > 0")
    own = turns.where(F.col("pos") >= h).join(short, "conv", "left").select("conv", (F.col("pos") - F.coalesce("shift", F.lit(0))).alias("pos"), "sym", "chars")
    empty = convs.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("sym"), F.lit(0).cast("long").alias("chars"))
    return empty.unionByName(taken).unionByName(own)


def _height(depth: int) -> int:
    """The block height for sequences of that many turns: all of them, or half of the depth's bits if they are more than a task holds."""
    return LOCAL if depth <= LOCAL else min(LOCAL, 1 << (((depth - 1).bit_length() + 1) // 2))


def _names(tree: bytes, turns: list[bytes], height: int, cut: bytes | None) -> list[bytes]:
    """The name of every prefix below a tree; the last one of a whole block has the name by which the next block knows it."""
    out: list[bytes] = []

    def forest(tree: bytes, at: int, height: int) -> None:
        if height == 1:
            out.append(hashlib.md5(tree + turns[at], usedforsecurity=False).digest())
            return
        half = height // 2
        forest(tree, at, half)
        if len(turns) > at + half:
            forest(hashlib.md5(tree + b"".join(turns[at : at + half]), usedforsecurity=False).digest(), at + half, half)

    forest(tree, 0, height)
    if cut is not None:
        out[-1] = cut
    return out


def _named(seqs: DataFrame, depth: int) -> DataFrame:
    """conv, depth, name, parent (the name above; empty for the root) and chars for the rows (conv, depth, sym, chars) of sequences of at most `depth` turns."""
    height = _height(depth)
    blocks = seqs.groupBy("conv", F.expr(f"depth div {height}L").alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "sym", "chars"))).alias("items"))
    none = F.lit(None).cast("binary")
    if depth <= height:
        blocks = blocks.select("conv", F.lit(b"").alias("tree"), none.alias("cut"), "items")
    else:
        blocks = scratch.cut(blocks)
        joined = F.unhex(F.md5(F.aggregate("items", F.lit(b""), lambda acc, x: F.concat(acc, x["sym"]))))
        whole = blocks.where(F.size("items") == height).select("conv", F.col("block").alias("depth"), joined.alias("sym"), F.lit(0).cast("long").alias("chars"))
        upper = scratch.cut(_named(whole, -(-depth // height)))
        of = upper.select("conv", F.col("depth").alias("block"), F.col("name").alias("cut"), none.alias("tree"))
        after = upper.select("conv", (F.col("depth") + 1).alias("block"), none.alias("cut"), F.col("name").alias("tree"))
        both = of.unionByName(after).groupBy("conv", "block").agg(F.max("cut").alias("cut"), F.max("tree").alias("tree"))
        blocks = blocks.join(both, ["conv", "block"], "left").select("conv", F.coalesce("tree", F.lit(b"")).alias("tree"), "cut", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                found = _names(r["tree"], [x["sym"] for x in r["items"]], height, r["cut"])
                out += [(r["conv"], x["depth"], n, p, x["chars"]) for x, n, p in zip(r["items"], found, [r["tree"], *found], strict=False)]
            yield _batch(out, [("conv", pa.int64()), ("depth", pa.int64()), ("name", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64())])

    return blocks.mapInArrow(run, "conv long, depth long, name binary, parent binary, chars long")


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _summed(name: str) -> Column:
    zero = F.lit(0).cast("long")
    return F.aggregate("items", zero, lambda acc, x: acc + F.coalesce(x[name], zero))


def _grafted(rows: DataFrame, depth: int) -> DataFrame:
    """depth, name and the sums of leaves and saved over each node's subtree, for rows (conv, depth, name, parent, leaves, saved) whose values are null but at the node's smallest member."""
    height = _height(depth)
    item = F.struct("depth", "name", "parent", *_TOTALS)
    blocks = rows.groupBy("conv", F.expr(f"depth div {height}L").alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    last = F.element_at("items", -1)
    blocks = blocks.withColumn("more", F.struct(*[F.lit(0).cast("long").alias(t) for t in _TOTALS]))
    if depth > height:
        blocks = scratch.cut(blocks)
        forests = blocks.where("block > 0").select((F.col("block") - 1).alias("depth"), F.get("items", F.lit(0))["parent"].alias("name"), *[_summed(t).alias(t) for t in _TOTALS])
        forests = forests.groupBy("depth", "name").agg(*[F.sum(t).alias(t) for t in _TOTALS])
        whole = blocks.where(F.size("items") == height).select("conv", F.col("block").alias("depth"), last["name"].alias("name"), F.get("items", F.lit(0))["parent"].alias("parent"), last["leaves"].isNotNull().alias("own"))
        owned = whole.where("own").join(forests, ["depth", "name"], "left").select("conv", "depth", "name", "parent", *[F.coalesce(t, F.lit(0)).alias(t) for t in _TOTALS])
        other = whole.where("not own").select("conv", "depth", "name", "parent", *[F.lit(None).cast("long").alias(t) for t in _TOTALS])
        upper = _grafted(scratch.cut(owned.unionByName(other)), -(-depth // height))
        upper = upper.select(F.col("depth").alias("block"), F.col("name").alias("cut"), F.struct(*_TOTALS).alias("grafted"))
        cut = F.when((F.size("items") == height) & last["leaves"].isNotNull(), last["name"])
        blocks = blocks.withColumn("cut", cut).join(upper, ["block", "cut"], "left").withColumn("more", F.coalesce("grafted", "more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                leaves, saved = (r["more"][t] for t in _TOTALS)
                for x in reversed(r["items"]):  # above its own nodes a conversation adds the sum of them to each
                    leaves += x["leaves"] or 0
                    saved += x["saved"] or 0
                    out.append((x["depth"], x["name"], leaves, saved))
            yield _batch(out, [("depth", pa.int64()), ("name", pa.binary()), ("leaves", pa.int64()), ("saved", pa.int64())])

    own = blocks.where(last["leaves"].isNotNull()).select("items", "more")
    return own.mapInArrow(run, "depth long, name binary, leaves long, saved long").groupBy("depth", "name").agg(*[F.sum(t).alias(t) for t in _TOTALS])


def _ends(rows: DataFrame) -> DataFrame:
    """depth, name and ends_sha256: SHA-256 of the ids of the conversations that end at a node, ascending and joined by commas.

    Ids are packed in pieces by ranges of PIECE ids; the pieces of a node pass one task in order, one at a time.
    """
    last = rows.groupBy("conv").agg(F.max(F.struct("depth", "name")).alias("end")).select("conv", "end.*")
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = last.groupBy("depth", "name", F.floor(F.col("conv") / PIECE).alias("piece")).agg(text.alias("ids"))
    width = scratch.shuffle_width(rows.sparkSession)
    spread = pieces.repartition(width, "depth", "name").sortWithinPartitions("depth", "name", "piece").select("depth", "name", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("depth", pa.int64()), ("name", pa.binary()), ("ends_sha256", pa.string())]
        node, state = None, hashlib.sha256()
        for b in batches:
            out = []
            for d, name, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node == (d, name):
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (d, name), hashlib.sha256(ids.encode())
            yield _batch(out, fields)
        if node is not None:
            yield _batch([(*node, state.hexdigest())], fields)

    return spread.mapInArrow(run, "depth long, name binary, ends_sha256 string")


def _child(name: str) -> Column:
    return F.col(f"n.{name}")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns: the nodes of the trie of all conversations.

    turns: conv, pos (from 0, gapless in each conversation), sym (what tells turns apart) and chars (its weight), as
    ordered_turns gives them; a row of pos -1 stands for a conversation that may have no turns. Nulls in conv are not
    expected; an empty table gives no rows, not even a root.

    Returns conv_id (smallest member), depth (root: 0), parent_conv_id (root: null), n_convs (members), n_children, n_leaves
    (childless nodes in the subtree, itself included), saved_tokens (over the subtree: (n_convs - 1) * chars of the last
    turn) and ends_sha256 (of the members without further turns).

    Members of a node are counted with partial sums, so a prefix that most conversations share costs no single task; only
    the join of nodes with their parents has such a prefix as a key, which Spark splits at run time. A task holds a block of
    LOCAL turns of a conversation, never a whole one.
    """
    root = F.lit(ROOT)
    starts = turns.where("pos <= 0").select("conv").distinct().select("conv", F.lit(0).cast("long").alias("depth"), root.alias("sym"), F.lit(0).cast("long").alias("chars"))
    seqs = scratch.cut(starts.unionByName(turns.where("pos >= 0").select("conv", (F.col("pos") + 1).alias("depth"), "sym", "chars")))
    depth = (seqs.agg(F.max("depth")).first()[0] or 0) + 1
    rows = scratch.cut(_named(seqs, depth))
    nodes = scratch.cut(rows.groupBy("depth", "name").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.max("chars").alias("chars")))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = scratch.cut(nodes.join(kids, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    values = nodes.select("conv", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    totals = _grafted(rows.join(values, ["conv", "depth"], "left").select("conv", "depth", "name", "parent", *_TOTALS), depth)
    above = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    found = nodes.alias("n").join(totals, ["depth", "name"]).join(_ends(rows), ["depth", "name"], "left").join(above, ["depth", "parent"], "left")
    return found.select(
        _child("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        _child("n_convs"),
        _child("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
