"""Knowledge graph: nodes (id, name, type, confidence, mentions, quality_score), edges (src, dst, type, confidence, strength)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.functions.text import issues
from tessera.operators.traversal import holds, walk

# Fixed values: (type, confidence, ignore case, pattern) in order.
PATTERNS = (
    ("Person", 0.8, False, r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"),
    ("Person", 0.8, False, r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]+ [A-Z][a-z]+\b"),
    ("Person", 0.8, False, r"\b[A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+\b"),
    ("Place", 0.7, False, r"\b[A-Z][a-z]+ (?:City|County|State|Province|Country)\b"),
    ("Place", 0.7, False, r"\b(?:New York|Los Angeles|Chicago|Houston|Phoenix|Philadelphia|San Antonio|San Diego|Dallas|San Jose)\b"),
    ("Place", 0.7, False, r"\b[A-Z][a-z]+ University\b"),
    ("Place", 0.7, False, r"\b[A-Z][a-z]+ Hospital\b"),
    ("Place", 0.7, False, r"\b[A-Z][a-z]+ Street\b"),
    ("Place", 0.7, False, r"\b[A-Z][a-z]+ Avenue\b"),
    ("Organization", 0.75, False, r"\b[A-Z][a-z]+ (?:Inc|Corp|LLC|Ltd|Company|Corporation)\b"),
    ("Organization", 0.75, False, r"\b[A-Z][a-z]+ & [A-Z][a-z]+\b"),
    ("Organization", 0.75, False, r"\b(?:Apple|Google|Microsoft|Amazon|Facebook|Tesla|Netflix)\b"),
    ("Concept", 0.6, True, r"\b(?:artificial intelligence|machine learning|deep learning|neural network|algorithm)\b"),
    ("Concept", 0.6, True, r"\b(?:blockchain|cryptocurrency|bitcoin|ethereum)\b"),
    ("Concept", 0.6, True, r"\b(?:climate change|global warming|renewable energy|solar power)\b"),
    ("Concept", 0.6, True, r"\b[A-Z][a-z]+ (?:Theory|Principle|Law|Effect|Syndrome)\b"),
)
NOT_PERSONS = ("The Company", "This Report", "Last Year", "Next Month", "First Time", "New York", "United States", "North America")
NODE_COLORS = {"Person": "#FF6B6B", "Place": "#4ECDC4", "Thing": "#45B7D1", "Concept": "#96CEB4", "Event": "#FFEAA7", "Organization": "#DDA0DD", "Entity": "#95A5A6"}


def required_words(pattern: str, ignore_case: bool = False) -> tuple[str, ...]:
    """Words one of which every match of the pattern holds, in lower case if the case is ignored; none if the pattern doesn't say.

    Read from the parsed pattern: runs of literals and alternatives of plain literals that no match can do without. Of several
    such requirements the one whose shortest word is longest counts.
    """
    import re._parser as parser  # the standard library's own, as re has no public one

    def literal(items: object) -> str | None:
        items = list(items)
        return "".join(chr(x) for _, x in items) if items and all(op is parser.LITERAL for op, _ in items) else None

    def inside(items: object) -> list[tuple[str, ...]]:
        found, run = [], ""
        for op, x in [*items, (None, None)]:
            if op is parser.LITERAL:
                run += chr(x)
                continue
            lead, run = run, ""
            if lead:
                found.append((lead,))
            if op is parser.SUBPATTERN and not x[1] and not x[2]:
                found += inside(x[3])
            elif op is parser.BRANCH:
                words = [literal(b) for b in x[1]]
                if all(words):  # what the alternatives have in common at the start was put before them
                    found.append(tuple(lead + w for w in words))
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and x[0] > 0:
                found += inside(x[2])
        return found

    import re

    try:
        parsed = parser.parse(pattern)
    except (re.error, RecursionError):
        return ()
    if parsed.state.flags & re.IGNORECASE and not ignore_case:  # the pattern itself says so
        return ()
    found = inside(parsed)
    best = max(found, key=lambda w: min(map(len, w)), default=())
    if not ignore_case:
        return best
    return tuple(w.lower() for w in best) if all(map(str.isascii, best)) else ()  # beyond ASCII, case has more than two forms


def extract_entities(docs: DataFrame, patterns: tuple = PATTERNS) -> DataFrame:
    """doc_id, pattern, position, name, type, confidence, context (50 characters on both sides) of every match.

    Positions of all matches need finditer, so Python runs the patterns over a text; a pattern whose required words
    the text does not hold cannot match there and is not run.
    """
    import re

    found = [(k, t, c, re.compile(p, re.IGNORECASE if ic else 0), bool(ic), required_words(p, bool(ic))) for k, (t, c, ic, p) in enumerate(patterns)]
    skip = set(NOT_PERSONS)

    def run(text: str | None) -> list[tuple]:
        out: list[tuple] = []
        if not text:
            return out
        low = text.lower() if text.isascii() else None  # beyond ASCII, case has more than two forms
        for k, kind, sure, p, ic, needed in found:
            held = low if ic else text
            if needed and held is not None and not any(w in held for w in needed):
                continue
            for m in p.finditer(text):
                name = m.group().strip()
                if kind != "Person" or (len(name) > 3 and name not in skip):
                    out.append((k, m.start(), name, kind, sure, text[max(0, m.start() - 50) : m.end() + 50]))
        return out

    return tables.per_text(docs.select("doc_id", "text"), run, "pattern int, position int, name string, type string, confidence double, context string")


def pattern_table(patterns: DataFrame, most: int = 10_000) -> tuple:
    """The rows (type, confidence, ignore_case, pattern) of a table as extract_entities takes them, in the order of these columns.

    Null confidences count .5, null ignore_case is false; rows without a type or a pattern name nothing and are left out. A table of more
    than `most` rows is no list of patterns and raises a ValueError: the patterns travel with every task.
    """
    rows = patterns.where("type is not null and pattern is not null").select("type", F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)), F.coalesce("ignore_case", F.lit(False)), "pattern").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns")
    return tuple(sorted(tuple(r) for r in rows))


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """The best of each (doc_id, lower-case name, type): confidence, then pattern, then position."""
    w = Window.partitionBy("doc_id", F.lower("name"), "type").orderBy(F.desc("confidence"), "pattern", "position")
    return entities.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


# Fixed values: (type, words between the two names) of relations.
VERBS = (
    ("WORKS_FOR", r"works for|employed by|works at"),
    ("LEADS", r"(?:is the|serves as)\s+(?:CEO|president|director|manager)\s+of"),
    ("FOUNDED", r"founded|established|created"),
    ("LOCATED_IN", r"located in|based in|situated in"),
    ("OWNS", r"owns|acquired|purchased"),
    ("PARTNERED_WITH", r"partnered with|collaborated with|worked with"),
    ("ASSOCIATED_WITH", r"and"),
)


def pattern_relations(docs: DataFrame, entities: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, src_id, dst_id, type, confidence, strength, context) where a run of words is `entity verb entity`.

    Sides are whole runs between punctuation marks, split at the last verb phrase with words on both sides; a side counts
    if it is an entity's name (doc_id, eid, name, pattern, position) in any case, the last such entity of the document.
    Parts on both sides of `&` are paired two by two. Linear in the text: no nested repetition is matched. Columns of the
    entities to carry come out as src_<name> and dst_<name>. Both tables grow with the texts and neither is broadcast.
    """
    run = docs.select("doc_id", F.explode(F.split("text", r"(?U)[^\w\s&]+")).alias("run"))
    plain = run.select("doc_id", F.explode(F.split("run", "&")).alias("r")).select("doc_id", F.trim(F.regexp_replace("r", r"(?U)\s+", " ")).alias("r"))
    # one pass over the runs: the left side first, which is empty where the verb is missing; the right side only where it is not
    # and no pattern at all where the run holds none of its words, in any case that the pattern takes for the same letter
    low = F.lower(F.translate("r", "\u017f\u0131\u0130\u212a", "siik"))
    sides = []
    for kind, verbs in VERBS:
        held = F.lit(False)
        for w in required_words(verbs, True):
            held = held | F.contains("low", F.lit(w))
        sides.append(F.when(held, F.lit(kind)))
    likely = plain.withColumn("low", low).select("doc_id", "r", F.explode(F.array_compact(F.array(*sides))).alias("type"))
    part = lambda n: F.coalesce(*[F.when(F.col("type") == k, F.regexp_extract("r", rf"(?isU)^(.*\w)\s+(?:{v})\s+(\w.*)$", n)) for k, v in VERBS])
    left = likely.withColumn("a", part(1)).where("a <> ''")
    found = [left.select("doc_id", F.lower("a").alias("a"), F.lower(part(2)).alias("b"), "type", F.col("r").alias("context"))]
    parts = run.where(F.contains("run", F.lit("&"))).select("doc_id", F.transform(F.split("run", "&"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))).alias("p"))
    pairs = parts.select("doc_id", "p", F.explode(F.sequence(F.lit(0), F.floor(F.size("p") / 2).cast("int") * 2 - 2, F.lit(2))).alias("k"))
    found.append(pairs.select("doc_id", F.get("p", "k").alias("a"), F.get("p", F.col("k") + 1).alias("b"), F.lit("ASSOCIATED_WITH").alias("type"), F.concat_ws(" & ", F.get("p", "k"), F.get("p", F.col("k") + 1)).alias("context")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    last = entities.groupBy("doc_id", F.lower("name").alias("n")).agg(F.max(F.struct("pattern", "position", "eid", *carry)).alias("e"))
    end = lambda c, side: last.select("doc_id", F.col("n").alias(c), F.col("e.eid").alias(f"{side}_id"), *[F.col(f"e.{x}").alias(f"{side}_{x}") for x in carry]).hint("merge")
    joined = every.withColumns({"a": F.lower("a"), "b": F.lower("b")}).join(end("a", "src"), ["doc_id", "a"]).join(end("b", "dst"), ["doc_id", "b"])
    kept = [f"{s}_{c}" for s in ("src", "dst") for c in carry]
    return joined.where("src_id <> dst_id").select("doc_id", "src_id", "dst_id", "type", F.lit(0.7).alias("confidence"), F.lit(0.8).alias("strength"), "context", *kept)


def proximity(entities: DataFrame, gap: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """CO_OCCURS between entities (doc_id, eid, position) of a document whose positions differ by less than `gap`.

    A band join by equality: positions fall into buckets of `gap`, and each row meets its own bucket and the next one. Both sides
    grow with the entities, which Spark underestimates, so neither is broadcast. Columns of the entities to carry come out as src_<name> and dst_<name>.
    """
    at = lambda s: entities.select("doc_id", F.col("eid").alias(f"{s}_id"), F.col("position").alias(f"{s}_pos"), *[F.col(c).alias(f"{s}_{c}") for c in carry])
    left = at("src").withColumn("bucket", F.explode(F.array(F.floor(F.col("src_pos") / gap), F.floor(F.col("src_pos") / gap) + 1)))
    right = at("dst").withColumn("bucket", F.floor(F.col("dst_pos") / gap))
    pairs = left.join(right.hint("merge"), ["doc_id", "bucket"])
    d = F.col("dst_pos") - F.col("src_pos")
    ordered = (d > 0) | ((d == 0) & (F.col("src_id") < F.col("dst_id")))
    kept = [f"{s}_{c}" for s in ("src", "dst") for c in carry]
    return pairs.where(ordered & (d < gap)).select("doc_id", "src_id", "dst_id", d.alias("distance"), F.lit("CO_OCCURS").alias("type"), F.lit(0.4).alias("confidence"), F.lit(0.3).alias("strength"), *kept)


def entity_coverage(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, coverage): distinct letters and digits of the names over those of the text; 0 without entities or letters."""
    chars = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), ""), lambda x: x != ""))
    names = entities.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set(chars(F.col("name"))))).alias("n"))
    both = docs.select("doc_id", chars(F.coalesce("text", F.lit(""))).alias("t")).join(names, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("n").isNull() | (F.size("t") == 0), F.lit(0.0)).otherwise(F.size("n") / F.size("t")).alias("coverage"))


def relationship_coverage(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: distinct ends of edges over nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.count_distinct("id").alias("ends"))
    total = nodes.agg(F.count("*").alias("nodes"))
    return ends.join(F.broadcast(total), F.lit(True)).select(F.when(F.col("nodes") > 0, F.col("ends") / F.col("nodes")).otherwise(F.lit(0.0)).alias("coverage"))


def extraction_quality(entity_confidence: Column, relation_confidence: Column, entity_types: Column, relation_types: Column, entity_cover: Column, relation_cover: Column) -> Column:
    one = lambda c: F.least(c, F.lit(1.0))
    return entity_confidence * 0.25 + relation_confidence * 0.25 + one(entity_types / 5) * 0.15 + one(relation_types / 8) * 0.15 + one(entity_cover) * 0.1 + one(relation_cover) * 0.1


def recommendations(quality: Column, entities: Column, relations: Column, types: Column, confidence: Column) -> Column:
    return issues(
        (quality < 0.5, F.lit("Overall quality is low. Consider re-processing with different parameters.")),
        (entities < 5, F.lit("Few entities extracted. Text might need preprocessing or different extraction methods.")),
        (relations == 0, F.lit("No relationships found. Consider using more sophisticated relationship extraction.")),
        (types < 3, F.lit("Low entity type diversity. Consider expanding entity type recognition.")),
        (confidence < 0.6, F.lit("Low average entity confidence. Consider manual review and validation.")),
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """The latest row of each key by `order`; of equal ones the larger row."""
    rest = [c for c in old.columns if c not in keys and c != order]
    every = old.unionByName(new)
    return every.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("r")).select(*keys, "r.*").select(*old.columns)


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def by_type(nodes: DataFrame, kind: str, most: int = 50) -> DataFrame:
    return nodes.where(F.col("type") == kind).orderBy(F.desc("quality_score"), F.desc("mentions"), "id").limit(most)


def search(nodes: DataFrame, term: str, most: int = 20) -> DataFrame:
    """Nodes whose name or attributes hold the term in any case, best first. (Many terms at once: traversal.search_terms.)"""
    return nodes.where(holds(nodes, F.lit(term.lower()))).orderBy(F.desc("quality_score"), F.desc("confidence"), "id").limit(most)


def k_hop(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(id, hops) of the nodes within `depth` undirected steps of the start ids; each at its least distance."""
    return walk(edges, start, depth)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): counts by node type and edge type with totals, by one rollup for each."""
    count = lambda df, kind: df.rollup("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.coalesce("type", F.lit("total")).alias("name"), "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def quality_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average, least and largest quality, average confidence, density 2E / (N (N - 1))."""
    n = nodes.agg(F.count("*").alias("nodes"), F.avg("quality_score").alias("avg_quality"), F.min("quality_score").alias("min_quality"), F.max("quality_score").alias("max_quality"), F.avg("confidence").alias("avg_confidence"))
    both = n.join(F.broadcast(edges.agg(F.count("*").alias("edges"))), F.lit(True))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return both.withColumn("density", F.when(pairs > 0, 2 * F.col("edges") / pairs).otherwise(F.lit(0.0)))


def visual_nodes(nodes: DataFrame, most: int = 100) -> DataFrame:
    color = F.create_map(*[F.lit(x) for p in NODE_COLORS.items() for x in p])
    size = F.least(F.lit(50), F.greatest(F.lit(10), F.col("mentions") * 5))
    return nodes.orderBy(F.desc("quality_score"), F.desc("mentions"), "id").limit(most).select("id", "name", "type", size.alias("size"), F.coalesce(F.element_at(color, F.col("type")), F.lit(NODE_COLORS["Entity"])).alias("color"))


def visual_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    q = F.col("quality_score")
    color = F.when(q >= 0.8, "#27AE60").when(q >= 0.6, "#F39C12").when(q >= 0.4, "#E67E22").otherwise("#E74C3C")
    return with_ends(edges, shown).withColumn("color", color)


def merge_duplicates(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after each duplicate of pairs (primary, duplicate) went into its primary.

    Mentions add up. Edges move to the primary as RELATED_TO unless the two ends already have an edge; an edge between
    duplicates of one primary would be a loop and is dropped.
    """
    gone = F.col("duplicate").isNotNull()
    own = pairs.select("primary", "duplicate").dropDuplicates(["duplicate"])
    extra = nodes.join(own, nodes["id"] == own["duplicate"]).groupBy("primary").agg(F.sum("mentions").alias("more"))
    left = nodes.join(own.select(F.col("duplicate").alias("id")), "id", "left_anti").join(extra.withColumnRenamed("primary", "id"), "id", "left")
    merged = left.withColumn("mentions", F.col("mentions") + F.coalesce("more", F.lit(0))).select(*nodes.columns)
    moved = edges.join(own.select(F.col("duplicate").alias("src"), F.col("primary").alias("ps")), "src", "left").join(own.select(F.col("duplicate").alias("dst"), F.col("primary").alias("pd")), "dst", "left")
    touched = F.col("ps").isNotNull() | F.col("pd").isNotNull()
    stay = moved.where(~touched).select(*edges.columns)
    new = moved.where(touched).withColumns({"src": F.coalesce("ps", "src"), "dst": F.coalesce("pd", "dst"), "type": F.lit("RELATED_TO")}).where("src <> dst").select(*edges.columns)
    first = new.groupBy("src", "dst", "type").agg(F.max(F.struct(*[c for c in edges.columns if c not in ("src", "dst", "type")])).alias("r")).select("src", "dst", "type", "r.*")
    fresh = first.join(stay.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return merged, stay.unionByName(fresh.select(*edges.columns))


def find_duplicates(nodes: DataFrame) -> DataFrame:
    """(primary, duplicate) of nodes with one lower-case name and type; the primary has the most mentions, then the least id. (A placeholder in the reference.)"""
    key = [F.lower("name").alias("k"), F.col("type").alias("t")]
    top = nodes.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct((-F.col("mentions")).alias("m"), "id"))["id"].alias("primary")).where("n > 1")
    return nodes.select("id", *key).join(top, ["k", "t"]).where("id <> primary").select("primary", F.col("id").alias("duplicate"))


def remove_low_quality(nodes: DataFrame, edges: DataFrame, confidence: float = 0.5, strength: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges at their thresholds or above; edges also lose what their removed ends held. (A placeholder in the reference.)"""
    good = nodes.where(F.col("confidence") >= confidence)
    return good, with_ends(edges.where(F.col("strength") >= strength), good)


def strengthen(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type) with strength 1 - product(1 - strength) and the count of evidence. (A placeholder; the rule is ours.)"""
    doubt = F.exp(F.sum(F.ln(F.greatest(F.lit(1e-12), F.lit(1.0) - F.col("strength")))))
    return edges.groupBy("src", "dst", "type").agg((F.lit(1.0) - doubt).alias("strength"), F.count("*").alias("evidence"))


def update_quality(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """quality_score by id from scores (id, score) where given."""
    return nodes.join(scores.groupBy("id").agg(F.max("score").alias("score")), "id", "left").withColumn("quality_score", F.coalesce("score", "quality_score")).select(*nodes.columns)


def optimize(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts by stage): low quality goes, duplicates merge, parallel edges strengthen each other."""
    count = lambda stage, n, e: n.agg(F.count("*").alias("nodes")).join(F.broadcast(e.agg(F.count("*").alias("edges"))), F.lit(True)).select(F.lit(stage).alias("stage"), "nodes", "edges")
    good, kept = remove_low_quality(nodes, edges)
    merged, moved = merge_duplicates(good, kept, find_duplicates(good))
    strong = strengthen(moved)
    stages = count("before", nodes, edges).unionByName(count("cleaned", good, kept)).unionByName(count("after", merged, strong))
    return merged, strong, stages


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, order: str = "updated_at") -> DataFrame:
    """The latest row of each (src, dst, type) of both tables whose two ends are nodes."""
    return with_ends(upsert(old, new, ["src", "dst", "type"], order), nodes)


def upsert_docs(old: DataFrame, new: DataFrame, order: str = "updated_at") -> DataFrame:
    """The latest row of each document."""
    return upsert(old, new, ["doc_id"], order)


def link_mentions(mentions: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, doc_id, context): one edge for each node and document that exist, with the latest context (of equal times the larger)."""
    known = mentions.join(nodes.select("id").distinct(), "id", "left_semi").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return known.groupBy("id", "doc_id").agg(F.max(F.struct("created_at", "context"))["context"].alias("context"))


def recompute_quality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with quality_score = .5 confidence + .3 min(mentions / 10, 1) + .2 min(edges / 5, 1). (A placeholder in the reference; the rule is ours.)"""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("__n"))
    part = lambda c, n: F.least(F.coalesce(c, F.lit(0)) / n, F.lit(1.0))
    score = F.coalesce("confidence", F.lit(0.0)) * 0.5 + part(F.col("mentions"), 10) * 0.3 + part(F.col("__n"), 5) * 0.2
    return nodes.join(ends, "id", "left").withColumn("quality_score", score).select(*nodes.columns)
