"""Scores and explanations of answers from graph and vector contexts (everything but the model call)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import mean_of, word_count
from tessera.operators.graph import dedupe_entities, extract_entities
from tessera.operators.traversal import search_terms, walk


def answer_confidence(entities: Column, relations: Column, graph_confidence: Column, similarity: Column, answer: Column) -> Column:
    """The mean of what there is: the graph's part (if it has entities), the mean similarity (if not null), the answer's length."""
    one = lambda c: F.least(c, F.lit(1.0))
    graph = F.when(entities > 0, graph_confidence * 0.5 + one(entities / 10) * 0.3 + one(relations / 5) * 0.2)
    return mean_of(F.array(graph, similarity, one(word_count(answer) / 50)), 0.5)


def result_quality(entities: Column, graph_confidence: Column, similarity: Column, confidence: Column) -> Column:
    has_graph, has_vector = entities > 0, similarity.isNotNull()
    context = F.when(has_graph & has_vector, 1.0).when(has_graph | has_vector, 0.7).otherwise(0.3)
    return mean_of(F.array(context, F.when(has_graph, graph_confidence), similarity, confidence))


def reasoning_path(entities: Column, relations: Column, excerpts: Column, similarity: Column) -> Column:
    has_graph, has_vector = entities > 0, excerpts > 0
    last = F.when(has_graph & has_vector, "Combined graph and vector contexts for comprehensive answer").when(has_graph, "Used primarily knowledge graph context").when(has_vector, "Used primarily document vector context").otherwise("Limited context available - answer may be incomplete")
    return F.array_compact(
        F.array(
            F.when(has_graph, F.format_string("Found %d relevant entities and %d relationships in knowledge graph", entities, relations)),
            F.when(has_vector, F.format_string("Retrieved %d relevant document excerpts", excerpts)),
            F.when(has_vector, F.format_string("Average document similarity: %.2f", similarity)),
            last,
        )
    )


def coverage_score(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, coverage): the share of a query's distinct entity names (asked) among those found; 0 if none is found."""
    names = lambda df: df.select("query_id", F.lower("name").alias("n")).distinct()
    hit = names(asked).join(names(found).withColumn("hit", F.lit(1)), ["query_id", "n"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("coverage"))


def answer_sources(entities: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(query_id, kind, source, excerpt): entities' documents, and documents' first 200 characters with an ellipsis."""
    one = entities.select("query_id", F.lit("graph").alias("kind"), F.col("doc_id").cast("string").alias("source"), F.lit(None).cast("string").alias("excerpt"))
    two = excerpts.select("query_id", F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("source"), F.concat(F.substring("text", 1, 200), F.lit("...")).alias("excerpt"))
    return one.unionByName(two)


def graph_context(asked: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 1, most: int = 10) -> DataFrame:
    """(query_id, id): for each name asked the best nodes that hold it in any case, and what they reach in `depth` steps.

    Distinct names meet the nodes by an index of n-grams (traversal.search_terms); all of them walk at once, each with its own
    visited nodes.
    """
    names = asked.select("query_id", F.lower("name").alias("term"))
    best = search_terms(nodes, names.select("term"), most).select("term", "id")
    return names.join(walk(edges, best, depth, ("term",)), "term").select("query_id", "id").distinct()


def context_edges(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, src, dst, type, ..): the edges that the nodes (query_id, id) reached for a query have among each other, each once."""
    ends = reached.select("query_id", "id").distinct()
    inside = edges.join(ends.withColumnRenamed("id", "src"), "src").join(ends.withColumnRenamed("id", "dst"), ["query_id", "dst"], "left_semi")
    return inside.select("query_id", *edges.columns).dropDuplicates(["query_id", "src", "dst", "type"])


def _listed(rows: DataFrame, line: Column, order: list[Column | str], most: int, name: str) -> DataFrame:
    """(query_id, name): the lines of the first `most` rows of each query, joined."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    top = rows.select("query_id", line.alias("line"), rank.alias("rank")).where(F.col("rank") <= most)
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias(name))


def answer_prompt(questions: DataFrame, reached: DataFrame, edges: DataFrame, excerpts: DataFrame, most_nodes: int = 1000, most_edges: int = 10, most_excerpts: int = 3, length: int = 500) -> DataFrame:
    """(query_id, prompt): each question (query_id, question) with what the graph and the documents say.

    Of the graph: the nodes (query_id, id, name, type) by id, `most_nodes` of them at most, and the first `most_edges` edges between them (src,
    dst, type) by these columns. Of the documents: the `most_excerpts` nearest excerpts (query_id, doc_id, text, similarity), ties by
    doc_id, cut at `length` characters. A part that a question has nothing for is left out.
    """
    names = reached.select("query_id", "id", F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("type", F.lit("Entity")).alias("type")).dropDuplicates(["query_id", "id"])
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(")"))
    nodes = _listed(names, line, ["id"], most_nodes, "nodes")
    ends = lambda side: names.select("query_id", F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
    named = context_edges(names, edges.select("src", "dst", "type")).join(ends("src"), ["query_id", "src"]).join(ends("dst"), ["query_id", "dst"])
    related = _listed(named, F.concat_ws(" ", F.lit("-"), "src_name", F.coalesce("type", F.lit("RELATED_TO")), "dst_name"), ["src", "dst", "type"], most_edges, "related")
    text = F.coalesce("text", F.lit(""))
    shown = F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)
    found = _listed(excerpts, F.concat(F.lit("[similarity "), F.format_string("%.2f", F.coalesce("similarity", F.lit(0.0))), F.lit("] "), shown), [F.desc("similarity"), "doc_id"], most_excerpts, "found")
    every = questions.select("query_id", "question")
    for part in (nodes, related, found):
        every = every.join(part, "query_id", "left")
    section = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{title}\n"), F.col(c)))
    prompt = F.concat_ws(
        "\n\n",
        F.concat(F.lit("QUESTION: "), F.coalesce("question", F.lit(""))),
        section("ENTITIES:", "nodes"),
        section("RELATIONSHIPS:", "related"),
        section("DOCUMENTS:", "found"),
        F.lit("Answer from the entities, relationships and documents above and name those used. Say so where they are not enough. End with your confidence: High, Medium or Low."),
    )
    return every.select("query_id", prompt.alias("prompt"))


def query_entities(queries: DataFrame) -> DataFrame:
    """(query_id, name, type) of the entities that each query's text names."""
    found = extract_entities(queries.select(F.col("query_id").alias("doc_id"), "text"))
    return dedupe_entities(found).select(F.col("doc_id").alias("query_id"), "name", "type")


def avg_confidence(found: DataFrame) -> DataFrame:
    """(query_id, avg_confidence): a missing confidence counts 0."""
    return found.groupBy("query_id").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("avg_confidence"))


def graph_rag_query(queries: DataFrame, asked: DataFrame, nodes: DataFrame, edges: DataFrame, excerpts: DataFrame, answers: DataFrame, depth: int = 1) -> DataFrame:
    """One row for each query: entities, relations, avg_confidence, excerpts, similarity, coverage, confidence, quality, reasoning_path.

    queries (query_id), asked (query_id, name; query_entities gives it), excerpts (query_id, similarity) of a vector search and
    answers (query_id, answer) of a model, as batch_inference writes them. The graph context of all queries is one plan.
    """
    reached = graph_context(asked, nodes, edges, depth).join(nodes.select("id", "name", "confidence"), "id")
    graph = reached.groupBy("query_id").agg(F.count("*").alias("entities"))
    relations = context_edges(reached, edges).groupBy("query_id").agg(F.count("*").alias("relations"))
    named = coverage_score(asked, reached.select("query_id", "name"))
    vector = excerpts.groupBy("query_id").agg(F.count("*").alias("excerpts"), F.avg("similarity").alias("similarity"))
    every = queries.select("query_id").distinct()
    for part in (graph, relations, avg_confidence(reached), named, vector, answers.select("query_id", "answer")):
        every = every.join(part, "query_id", "left")
    every = every.na.fill(0, ["entities", "relations", "excerpts"]).na.fill(0.0, ["avg_confidence"]).na.fill({"coverage": 1.0, "answer": ""})
    n, e, c, s = F.col("entities"), F.col("relations"), F.col("avg_confidence"), F.col("similarity")
    sure = every.withColumn("confidence", answer_confidence(n, e, c, s, F.col("answer")))
    return sure.withColumn("quality", result_quality(n, c, s, F.col("confidence"))).withColumn("reasoning_path", reasoning_path(n, e, F.col("excerpts"), s)).drop("answer")
