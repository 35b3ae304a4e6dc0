"""Walks over a graph and lookups of names: written frontiers, and an index of character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import tables

#: Characters of the n-grams by which names are found.
GRAM = 3
#: Bytes of terms up to which they and their n-grams meet the nodes by broadcasts; beyond that they are shuffled.
TERM_BYTES = 1 << 20


def walk(edges: DataFrame, start: DataFrame, depth: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, hops): what each key of start (keys, id) reaches within `depth` undirected steps, at the least number of them.

    Breadth first: every step meets the edges with the ids that the step before reached for the first time, and takes off
    those already visited. Frontiers are written to the shared folder, so a step's plan is the same at any depth, a lost executor
    costs its tasks alone, and the walk ends when nothing new is reached. Null ids and edges with a null end reach nothing; repeated edges, loops
    and cycles change nothing; depth 0 gives the start.
    """
    ends = edges.where("src is not null and dst is not null")
    both = tables.cut(ends.select("src", "dst").union(ends.select("dst", "src")).where("src <> dst").distinct())
    first = start.where("id is not null").select(*keys, "id").distinct().withColumn("hops", F.lit(0))
    paths = [tables.write(first)]
    on = [*keys, "id"]
    for hop in range(1, depth + 1):
        edge = tables.read(first, paths[-1]).select(*keys, F.col("id").alias("src"))
        if keys:
            near = edge.join(both, "src").select(*keys, F.col("dst").alias("id")).distinct()
        else:
            near = both.join(edge, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        new = near.join(tables.read(first, *paths), on, "left_anti").select(*on, F.lit(hop).alias("hops"))
        path = tables.write(new)
        if tables.read(first, path).isEmpty():
            break
        paths.append(path)
    return tables.read(first, *paths)


def neighborhood(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 2, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(nodes with hops, edges between them): the `most` nearest nodes within `depth` steps of the start ids, ties to the smaller id.

    The edges are all that the kept nodes have among each other, each once for its (src, dst, type).
    """
    near = walk(edges, start, depth).join(nodes.select("id").distinct(), "id", "left_semi").orderBy("hops", "id").limit(most)
    kept = tables.cut(near)
    inside = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(kept, "id"), inside.select(*edges.columns).dropDuplicates(["src", "dst", "type"])


def _fields(nodes: DataFrame) -> list[Column]:
    """What a search looks at: the name, and the attributes where there are any (a map as JSON)."""
    found = [F.lower("name")]
    if "attributes" in nodes.columns:
        kind = nodes.schema["attributes"].dataType.typeName()
        found.append(F.lower(F.col("attributes") if kind == "string" else F.to_json("attributes")))
    return [F.coalesce(c, F.lit("")) for c in found]


def holds(nodes: DataFrame, term: Column) -> Column:
    """Whether a node's name or attributes hold the lower-case term."""
    out = F.lit(False)
    for c in _fields(nodes):
        out = out | F.contains(c, term)
    return out


def _grams(text: Column, n: Column) -> Column:
    """The distinct n-grams of a text; for n = 0 the empty one."""
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(n == 0, F.array(F.lit(""))).when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n))))


def search_terms(nodes: DataFrame, terms: DataFrame, most: int = 10) -> DataFrame:
    """(term, id, rank): for each term the best `most` nodes whose name or attributes hold it in any case.

    Best is the higher quality_score, then confidence, then the smaller id. An inverted table of the nodes' character
    trigrams is met with each term's rarest trigram, and what it gives is compared whole; terms of two, one or no
    characters are met by n-grams of their own length. So no term is compared with every node, and none is missed. A null
    term finds nothing, the empty one every node. The table of n-grams is many times the nodes and is never broadcast.
    """
    wanted = tables.cut(terms.where("term is not null").select(F.lower("term").alias("term")).distinct().withColumn("n", F.least(F.lit(GRAM), F.length("term"))))
    sizes = wanted.groupBy("n").agg(F.sum(F.octet_length("term")).alias("bytes")).collect()  # four lengths at most
    lengths = [r.n for r in sizes]
    few = sum(r.bytes for r in sizes) <= TERM_BYTES
    of_terms = F.broadcast if few else lambda df: df.hint("merge")
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")  # a few MB of names are many n-grams
    texts = _fields(nodes)
    every = [F.coalesce(_grams(t, F.lit(n)), F.array().cast("array<string>")) for t in texts for n in lengths]
    posted = nodes.select("id", "quality_score", "confidence", F.array(*texts).alias("texts"), F.explode(F.array_distinct(F.concat(*every)) if every else F.array().cast("array<string>")).alias("gram"))
    asked = wanted.select("term", F.explode(_grams(F.col("term"), F.col("n"))).alias("gram"))
    counts = posted.join(of_terms(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("many"))
    rare = asked.join(of_terms(counts), "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "gram")).alias("r")).where("r.many > 0").select("term", "r.gram")
    hits = posted.join(of_terms(rare), "gram").where(F.exists("texts", lambda t: F.contains(t, F.col("term"))))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("quality_score"), F.desc("confidence"), "id"))
    return hits.select("term", "id", rank.alias("rank")).where(F.col("rank") <= most)
