"""Hilbert-curve sharding, with DataFrame operations only.

Several metadata dimensions are quantised, the rows are sorted by their index on a Hilbert curve, and
the order is cut into runs. Rows that are near in all dimensions share a run, so the minimum and
maximum of each dimension in a run's file prune it for a filter on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import scratch

BITS = 6
#: Tasks among which the copies of one text are dealt when they meet its dimensions.
WAYS = 32


def _steps(dims: int) -> list[int]:
    """The curve as an automaton: for state (entry corner, axis) and a cell's corner bits, the digit and the next state.

    The entry is (state * 2**dims + corner) -> digit * states + next state, with state = corner * dims + axis,
    by the Gray-code construction of Hamilton (2006).
    """
    n, mask = dims, (1 << dims) - 1
    turn = lambda x, k: ((x >> (k % n)) | (x << (n - k % n))) & mask
    out = []
    for entry in range(1 << n):
        for axis in range(n):
            for corner in range(1 << n):
                code = turn(corner ^ entry, axis + 1)
                digit = 0
                for k in range(n):
                    digit ^= code >> k
                start = 0 if digit == 0 else ((digit - 1) // 2 * 2) ^ ((digit - 1) // 2)
                ones = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  trailing ones
                side = 0 if digit == 0 else ones(digit - 1 if digit % 2 == 0 else digit) % n
                out.append(digit * ((1 << n) * n) + (entry ^ turn(start, n - (axis + 1) % n)) * n + (axis + side + 1) % n)
    return out


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The index on the Hilbert curve of a cell given by one number in 0 .. 2**bits - 1 for each dimension."""
    n = len(cells)
    states = (1 << n) * n
    table = F.array(*[F.lit(x) for x in _steps(n)])
    levels = F.array(*[F.lit(k) for k in range(bits - 1, -1, -1)])

    def step(acc: Column, level: Column) -> Column:
        corner = F.lit(0)
        for i, c in enumerate(cells):
            corner = corner + F.call_function("shiftright", c, level).bitwiseAND(F.lit(1)) * F.lit(1 << i)
        found = F.get(table, acc["state"] * F.lit(1 << n) + corner)
        return F.struct(
            (acc["index"] * F.lit(1 << n) + F.floor(found / F.lit(states))).cast("long").alias("index"),
            (found % F.lit(states)).cast("int").alias("state"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("int").alias("state"))
    return F.aggregate(levels, start, step, lambda acc: acc["index"])


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType | T.BooleanType | T.TimestampType)


def _value(df: DataFrame, name: str) -> Column:
    """What the cells of a dimension are cut from: numbers and times as numbers, other values as whole strings."""
    return F.col(name).cast("double" if _is_number(df, name) else "string")


def _cuts(keyed: DataFrame, name: str) -> list:
    """2**BITS - 1 values that cut a dimension into parts of about equal row counts, in its own order; equal ones where a value is that frequent.

    Numbers: approximate quantiles of all rows. Strings: exact quantiles of all rows, from the counts of the values, sorted by a range
    exchange and ranked by the sums of its partitions; they are compared as strings, so a prefix that all values share does not matter.
    """
    parts = 1 << BITS
    if dict(keyed.dtypes)[name] == "double":
        return keyed.agg(F.percentile_approx(name, [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    spark = keyed.sparkSession
    counts = keyed.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("c"))
    runs = scratch.cut(counts.repartitionByRange(scratch.shuffle_width(spark), name).withColumn("run", F.spark_partition_id()))
    each = runs.groupBy("run").agg(F.sum("c").alias("n"))  # one row for each partition of the sort
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    upto = F.sum("c").over(Window.partitionBy("run").orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    ranked = runs.join(F.broadcast(starts), "run").withColumn("upto", F.col("start") + upto)
    low, high = f"(upto - c) * {parts}L div total", f"upto * {parts}L div total"
    every = F.explode(F.sequence(F.expr(f"{low} + 1"), F.expr(high)))  # the cuts at whose quantile rows of this value stand
    return [r[0] for r in ranked.where(f"{low} < {high}").select(name, every.alias("cut")).where(F.col("cut") < parts).orderBy("cut").select(name).collect()]


def _cell(c: Column, cuts: list) -> Column:
    """How many of the ascending cuts do not exceed the value; none for a null."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= c)) if cuts else F.lit(0)


def hilbert_shards(docs: DataFrame, shards: int = 40, dims: tuple[str, str] = ("source", "lang"), carry: tuple[str, ...] = ()) -> DataFrame:
    """Deal all rows to shards whose row counts differ by one at most (law ``rows``).

    The dimensions are the two given columns and the size of the text, each quantised in its own order by 63 approximate
    quantiles (a null is the least value; strings are compared whole), so that the ranges of a shard's values are narrow in all three.
    Rows of equal text take the cells of the row with the smallest doc_id among them, so
    copies stand together in the order and only a cut can part them. Ties on the curve go by the text's hash, then
    doc_id. A null text has size 16 and the checksum of the empty text; a null doc_id stands first among its equals;
    repeated rows are placed each; an empty table gives no rows. Columns other than doc_id, text, dims and the carried ones
    (whose names must not clash with those below) are not read.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), hilbert and the carried columns.

    The sort is a range exchange with all tie-breakers in its key, so that one hot cell of the curve spreads over many
    tasks. It is written once; counts of its partitions then give every row its rank without a global window.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        *[_value(docs, d).alias(f"__{k}") for k, d in enumerate(dims)],
        *carry,
    )
    keyed = keyed.withColumn("__2", F.col("size").cast("double"))
    cells = [_cell(F.col(c), _cuts(keyed, c)).alias(f"__c{k}") for k, c in enumerate(("__0", "__1", "__2"))]
    keyed = keyed.select("*", *cells).drop("__0", "__1", "__2")
    same = ["text_key", "text_crc32", "size"]
    # cells that differ between equal texts are those of the least doc_id; only texts that need it are joined back
    own = F.struct("__c0", "__c1")
    least = keyed.groupBy(*same).agg(F.min(F.struct("doc_id", "__c0", "__c1")).alias("rep"), F.min(own).alias("low"), F.max(own).alias("high"))
    ways = F.lit(WAYS)
    # a text with very many copies is met in several tasks
    moved = least.where("low <> high").select(*same, F.col("rep.__c0").alias("__x"), F.col("rep.__c1").alias("__y"), F.explode(F.sequence(F.lit(0), ways - 1)).alias("__way"))
    placed = keyed.withColumn("__way", F.pmod(F.xxhash64("doc_id"), ways).cast("int")).join(moved, [*same, "__way"], "left")
    placed = placed.withColumn("hilbert", hilbert_index([F.coalesce("__x", "__c0"), F.coalesce("__y", "__c1"), F.col("__c2")])).drop("__c0", "__c1", "__c2", "__x", "__y", "__way")
    order = ["hilbert", "text_key", "doc_id"]
    runs = scratch.cut(placed.repartitionByRange(scratch.shuffle_width(spark), *order).withColumn("run", F.spark_partition_id()))
    each = runs.groupBy("run").agg(F.count("*").alias("n"))  # one row for each partition of the sort
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("run").orderBy(*order)) - 1
    ranked = runs.join(F.broadcast(starts), "run").withColumn("rank", rank.cast("long"))
    exact = F.expr(f"cast(rank * {int(shards)}L div total as long)")
    return ranked.withColumn("shard_l", exact).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard_l").cast("int").alias("shard"),
        F.expr(f"cast(rank - (shard_l * total + {int(shards) - 1}L) div {int(shards)}L as long)").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
        *carry,
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, dims: tuple[str, str] = ("source", "lang")) -> None:
    """Write docs as one folder of Parquet files for each shard (shard=0, ..), in the order of the curve.

    The files' own minima and maxima of the dimensions let a reader skip files for a filter on any of them. All columns of docs
    are written as they are, with shard, slot and hilbert; one of these three whose name docs has already gets an underscore before it.
    """
    names = {}
    for own in ("shard", "slot", "hilbert"):
        names[own] = own
        while names[own] in docs.columns:
            names[own] = "_" + names[own]
    found = hilbert_shards(docs.withColumn("__own", F.struct(*docs.columns)), shards, dims, ("__own",))
    spread = found.repartitionByRange(shards, "shard", "hilbert").sortWithinPartitions("shard", "hilbert", "slot")
    spread.select("__own.*", *[F.col(a).alias(b) for a, b in names.items()]).write.partitionBy(names["shard"]).parquet(path)
