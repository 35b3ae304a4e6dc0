"""Quality gates of instruction rows (seq, instruction, input, output), categories, diversity and data-set metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import contains_any, issues, word_count, words
from tessera.operators.similarity import jaccard_of, largest_rouge_l, word_set

# Fixed values.
BLACKLIST = (
    "image", "images", "graph", "graphs", "picture", "pictures", "file", "files", "map", "maps", "draw", "plot", "go to", "video", "audio",
    "music", "flowchart", "diagram", "chart", "download", "upload", "click", "button", "website", "url",
)
HARMFUL = ("violence", "illegal", "harmful", "dangerous", "inappropriate")
PLACEHOLDERS = ("[insert", "[add", "[fill", "xxx", "yyy", "zzz")
LANGUAGES = ("spanish", "french", "german", "chinese", "japanese")
LIST_MARKS = ("1.", "2.", "-", "•", "\n")
CATEGORIES = {
    "generation": ("creative writing", "explanations", "summaries", "stories"),
    "analysis": ("text analysis", "comparison", "evaluation", "critique"),
    "transformation": ("translation", "formatting", "conversion", "rewriting"),
    "reasoning": ("math problems", "logic puzzles", "inference", "problem solving"),
    "classification": ("categorization", "sentiment", "topic detection", "labeling"),
    "instruction": ("how-to guides", "tutorials", "step-by-step", "procedures"),
    "qa": ("question answering", "factual queries", "explanations", "clarifications"),
}
FIRST_WORDS = {
    "generation": ("explain", "describe", "define"),
    "analysis": ("analyze", "compare", "evaluate"),
    "transformation": ("translate", "convert", "rewrite"),
    "reasoning": ("calculate", "solve", "determine"),
    "classification": ("classify", "categorize", "identify"),
    "instruction": ("list", "provide", "give"),
}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def length_issues() -> Column:
    a, b = word_count(_text("instruction")), word_count(_text("output"))
    return issues(
        (a < 3, F.format_string("Instruction too short: %d words", a)),
        (a > 150, F.format_string("Instruction too long: %d words", a)),
        (b < 1, F.lit("Output is empty")),
        (F.length(_text("output")) > 1000, F.format_string("Output too long: %d characters", F.length(_text("output")))),
    )


def content_issues() -> Column:
    """An empty instruction neither starts with a capital letter nor ends with punctuation."""
    first = F.substring(_text("instruction"), 1, 1)
    harm = [(F.contains(F.lower(_text("instruction")), F.lit(k)) | F.contains(F.lower(_text("output")), F.lit(k)), F.lit(f"Contains potentially harmful content: {k}")) for k in HARMFUL]
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    return issues(*harm, (~capital, F.lit("Instruction should start with capital letter")), (~_text("instruction").rlike(r"[.?!]\s*$"), F.lit("Instruction should end with proper punctuation")))


def format_issues() -> Column:
    empty = lambda c: ~c.rlike(r"\S")
    held = [(F.contains(F.lower(_text("instruction")), F.lit(p)) | F.contains(F.lower(_text("output")), F.lit(p)), F.lit(f"Contains placeholder text: {p}")) for p in PLACEHOLDERS]
    return issues((~empty(_text("input")) & empty(_text("output")), F.lit("Missing output for input-based instruction")), *held)


def blacklist_issues(whole_word: bool = False) -> Column:
    """By substring, so `profile` holds `file`; or by whole word."""
    low = F.lower(_text("instruction"))
    return issues(*[(low.rlike(rf"\b{t}\b") if whole_word else F.contains(low, F.lit(t)), F.lit(f"Contains blacklisted term: {t}")) for t in BLACKLIST])


def coherence_issues() -> Column:
    low = F.lower(_text("instruction"))
    return issues(
        (F.contains(low, F.lit("translate")) & ~contains_any(low, LANGUAGES) & ~contains_any(F.lower(_text("output")), LANGUAGES), F.lit("Translation instruction but no clear target language")),
        (F.contains(low, F.lit("list")) & ~contains_any(_text("output"), LIST_MARKS), F.lit("List instruction but output not formatted as list")),
    )


GATES = {"length": length_issues, "content": content_issues, "format": format_issues, "blacklist": blacklist_issues, "coherence": coherence_issues}


def gate(rows: DataFrame, *names: str) -> DataFrame:
    """Adds <name>_issues and <name>_passed for the gates named, and accepted if all of them pass."""
    names = names or tuple(GATES)
    out = rows.withColumns({f"{n}_issues": GATES[n]() for n in names}).withColumns({f"{n}_passed": F.size(f"{n}_issues") == 0 for n in names})
    every = F.lit(True)
    for n in names:
        every = every & F.col(f"{n}_passed")
    return out.withColumn("accepted", every)


def category(instruction: Column) -> Column:
    low = F.lower(F.coalesce(instruction, F.lit("")))
    first = F.get(words(low), F.lit(0))
    found = [F.when(contains_any(low, terms), c) for c, terms in CATEGORIES.items()] + [F.when(first.isin(*terms), c) for c, terms in FIRST_WORDS.items()]
    return F.coalesce(*found, F.lit("general"))


def diversity(batch: DataFrame, accepted: DataFrame, last: int = 50, threshold: float = 0.7, by: str = "jaccard") -> DataFrame:
    """Adds similarity (the largest to the last accepted rows) and diverse; every row of the batch comes out once.

    The comparison set is a constant: by Jaccard it is broadcast as one row, by ROUGE-L its rows travel with the tasks.
    A row of the batch that is itself among the accepted ones is not compared with itself (by seq, if the batch has it).
    """
    recent = accepted.orderBy(F.desc("seq")).limit(last).select("seq", "instruction")
    if by == "rouge":
        own = "seq" in batch.columns
        known = [(r.s if own else "another", r.instruction) for r in recent.select(F.col("seq").cast("string").alias("s"), "instruction").collect()]
        scored = batch.withColumn("similarity", largest_rouge_l(known, F.col("instruction"), F.col("seq").cast("string") if own else F.lit("")))
        return scored.withColumn("diverse", F.col("similarity") <= threshold)
    known = recent.agg(F.collect_list(F.struct("seq", word_set(F.col("instruction")).alias("w"))).alias("recent"))
    each = batch.join(F.broadcast(known), F.lit(True))
    others = F.filter("recent", lambda r: ~r["seq"].eqNullSafe(F.col("seq"))) if "seq" in batch.columns else F.col("recent")
    # through an array of one, so that a row's own words are split once and not for each comparison
    best = F.transform(F.array(word_set(F.col("instruction"))), lambda own: F.array_max(F.transform(others, lambda r: jaccard_of(own, r["w"]))))
    return each.withColumn("similarity", F.coalesce(F.get(best, F.lit(0)), F.lit(0.0))).drop("recent").withColumn("diverse", F.col("similarity") <= threshold)


def validate_batch(rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Passed, failed and pass rate of each batch."""
    return gate(rows).groupBy(batch).agg(F.count("*").alias("total"), F.count_if("accepted").alias("passed"), F.count_if(~F.col("accepted")).alias("failed")).withColumn("pass_rate", F.col("passed") / F.greatest(F.col("total"), F.lit(1)))


def category_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy(category(F.col("instruction")).alias("category")).agg(F.count("*").alias("n"))


def dataset_metrics(rows: DataFrame) -> DataFrame:
    a, b = word_count(_text("instruction")), word_count(_text("output"))
    first = F.lower(F.get(words(_text("instruction")), F.lit(0)))
    given = F.count_if(_text("input").rlike(r"\S"))
    n = F.greatest(F.count("*"), F.lit(1))
    return rows.agg(
        F.count("*").alias("total_examples"),
        F.count_distinct(_text("instruction")).alias("unique_instructions"),
        (F.count_distinct(_text("instruction")) / n).alias("uniqueness_ratio"),
        F.count_distinct(first).alias("unique_first_words"),
        (F.count_distinct(first) / n).alias("verb_diversity"),
        F.avg(a).alias("instruction_mean"),
        F.min(a).alias("instruction_min"),
        F.max(a).alias("instruction_max"),
        F.avg(b).alias("output_mean"),
        F.min(b).alias("output_min"),
        F.max(b).alias("output_max"),
        given.alias("with_input"),
        (F.count("*") - given).alias("without_input"),
    )


def gate_sequential(rows: DataFrame, *names: str) -> DataFrame:
    """One row for each gate in order: what it saw (the survivors), passed, and its pass rate."""
    names = names or tuple(GATES)
    flags = gate(rows, *names)
    seen, parts = F.lit(True), []
    for k, n in enumerate(names):
        parts.append(F.struct(F.lit(k).alias("step"), F.lit(n).alias("gate"), seen.alias("seen"), (seen & F.col(f"{n}_passed")).alias("ok")))
        seen = seen & F.col(f"{n}_passed")
    return flags.select(F.inline(F.array(*parts))).groupBy("step", "gate").agg(F.count_if("seen").alias("seen"), F.count_if("ok").alias("passed")).withColumn("pass_rate", F.col("passed") / F.greatest(F.col("seen"), F.lit(1)))


def guide_filters(rows: DataFrame) -> DataFrame:
    """Rows of 4 to 150 words that neither ask for a program nor start with punctuation or a non-ASCII character."""
    n = word_count(_text("instruction"))
    return rows.where((n > 3) & (n <= 150) & ~_text("instruction").startswith("Write a program") & _text("instruction").rlike(r"^[A-Za-z0-9]"))


def repetition_ratio(text: Column) -> Column:
    """One less the share of distinct words. (The formula is ours; only the name is given.)"""
    w = words(text)
    return F.when(F.size(w) > 0, F.lit(1.0) - F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0))


def dedup_exact(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest `order` of each `key`; partial minima, so a frequent key costs a row a task."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min(F.struct(order, *others)).alias("r")).select("r.*", key).select(*rows.columns)


def balance(rows: DataFrame, quota: int, order: str = "seq") -> DataFrame:
    """At most `quota` rows of each category, the first by `order`."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= quota)


def quality_decision(score: Column, critical: Column, penalty: Column) -> Column:
    """accept at .8 without a critical issue, review at .6, else reject; after penalties."""
    net = F.greatest(F.lit(0.0), score - penalty)
    return F.when((net >= 0.8) & ~critical, "accept").when(net >= 0.6, "review").otherwise("reject")


def checklist_score(rows: DataFrame) -> DataFrame:
    """Adds checklist: .3 for five words or more, .2 for another start than `write a program` or `create a`, .3 if input and output are both there or both missing, .2 without harm."""
    low = F.lower(_text("instruction"))
    parts = [
        F.when(word_count(_text("instruction")) >= 5, 0.3),
        F.when(~low.startswith("write a program") & ~low.startswith("create a"), 0.2),
        F.when((_text("input") != "") == (_text("output") != ""), 0.3),
        F.when(~contains_any(low, HARMFUL[:3]), 0.2),
    ]
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return rows.withColumn("checklist", total)


def dataset_checklist(rows: DataFrame, least: int = 1000, largest_share: float = 0.5, duplicates: float = 0.05) -> DataFrame:
    """(item, value, ok, weight) of a data set: its size, the share of its largest category, its duplicate rate and its rows' format; over all rows.

    A balanced set has no category with more than `largest_share` of the rows (the rule is ours). A duplicate repeats the instruction, input and output of
    another row. A row is well formed if it has an instruction and an output that are not blank, and an input that is no null.
    """
    held = lambda c: _text(c).rlike(r"\S")
    n = F.greatest(F.sum("n"), F.lit(1))
    each = rows.groupBy("instruction", "input", "output").agg(F.count("*").alias("n"), F.first(category(F.col("instruction"))).alias("category"))
    good = held("instruction") & held("output") & F.col("input").isNotNull()
    one = each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("size"), ((F.sum("n") - F.count("*")) / n).alias("repeated"), (F.sum(F.when(good, F.col("n")).otherwise(0)) / n).alias("formed"))
    share = each.groupBy("category").agg(F.sum("n").alias("n")).agg((F.max("n") / n).alias("share"))
    item = lambda name, c, ok, weight: F.struct(F.lit(name).alias("item"), F.coalesce(c, F.lit(0.0)).alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(weight).alias("weight"))
    every = F.array(
        item("size", F.col("size"), F.col("size") >= least, 0.2),
        item("balance", F.col("share"), F.col("share") <= largest_share, 0.3),
        item("duplicates", F.col("repeated"), F.col("repeated") < duplicates, 0.3),
        item("format", F.col("formed"), F.col("formed") == 1, 0.2),
    )
    return one.join(F.broadcast(share), F.lit(True)).select(F.inline(every))


def forbidden_filter(rows: DataFrame, phrases: tuple[str, ...]) -> DataFrame:
    """Rows without a forbidden phrase, with an instruction of 15 characters or more and an output of 50 to 2000."""
    held = contains_any(F.lower(_text("instruction")), phrases) | contains_any(F.lower(_text("output")), phrases)
    return rows.where(~held & (F.length(_text("instruction")) >= 15) & F.length(_text("output")).between(50, 2000))


def sample_context_seed(wanted: DataFrame, contexts: DataFrame, seed: int = 1) -> DataFrame:
    """One context for each wanted seq, drawn by a hash of seq: contexts need a gapless `k` from 0."""
    n = contexts.agg(F.count("*").alias("n"))
    drawn = wanted.join(F.broadcast(n), F.lit(True)).withColumn("k", F.pmod(F.xxhash64("seq", F.lit(seed)), F.col("n"))).drop("n")
    return drawn.join(contexts, "k").drop("k")


def select_diverse_seeds(seeds: DataFrame, used: DataFrame, most: int = 3) -> DataFrame:
    """Seeds (seq, category) of categories not used yet first, then others, in a fixed pseudo-random order."""
    known = used.select("category").distinct().withColumn("used", F.lit(1))
    return seeds.join(known, "category", "left").orderBy(F.coalesce("used", F.lit(0)), F.xxhash64("seq"), "seq").limit(most).drop("used")


def training_data_check(rows: DataFrame, least: int = 1000) -> DataFrame:
    """One row: rows, rows with a missing field, and whether both are as they should be. All rows are checked."""
    missing = F.count_if(F.col("instruction").isNull() | F.col("input").isNull() | F.col("output").isNull())
    return rows.agg(F.count("*").alias("n"), missing.alias("missing")).withColumn("ok", (F.col("n") >= least) & (F.col("missing") == 0))


def generation_checklist(rows: DataFrame, target: int, least_parsed: float = 0.8, least_diverse: float = 0.7) -> DataFrame:
    """(item, value, ok, critical): parsed share, share of distinct instructions, and whether the target was met."""
    n = F.greatest(F.count("*"), F.lit(1))
    parsed = F.count_if(F.col("instruction").isNotNull() & F.col("output").isNotNull()) / n
    one = rows.agg(parsed.alias("p"), (F.count_distinct("instruction") / n).alias("d"), F.count("*").cast("double").alias("n"))
    item = lambda name, c, ok, critical: F.struct(F.lit(name).alias("item"), F.col(c).alias("value"), ok.alias("ok"), F.lit(critical).alias("critical"))
    return one.select(F.inline(F.array(item("parse_success", "p", F.col("p") > least_parsed, True), item("diversity", "d", F.col("d") > least_diverse, False), item("target", "n", F.col("n") >= target, True))))


def generation_loop(generate: Callable[[int, int], DataFrame], write: Callable[[DataFrame], DataFrame], target: int, batch: int = 20, least_rate: float = 0.1) -> DataFrame:
    """Accepted rows (seq, instruction, input, output) of batches that generate(round, how many) makes, until the target.

    Each batch passes the gates and is compared with rows accepted in earlier batches, never with itself. The loop ends
    early when a batch's pass rate falls below `least_rate`; otherwise every round accepts a row at least. write stores the accepted rows so far and reads them again,
    so that no round computes the ones before it anew.
    """
    accepted, have, k = None, 0, 0
    while have < target:
        want = min(batch, target - have)
        rows = gate(generate(k, want)).where("accepted").select("seq", "instruction", "input", "output")
        if accepted is not None:
            rows = diversity(rows, accepted).where("diverse").select("seq", "instruction", "input", "output")
        accepted = write(rows if accepted is None else accepted.unionByName(rows))
        now = accepted.count()
        if (now - have) / want < least_rate:
            break
        have, k = now, k + 1
    return accepted


def run_statistics(rows: DataFrame, target: int, started: str = "started_at", ended: str = "ended_at") -> DataFrame:
    """One row: generated, target, completion_rate and seconds from the first start to the last end."""
    took = F.unix_timestamp(F.max(ended)) - F.unix_timestamp(F.min(started))
    return rows.agg(F.count("*").alias("generated"), F.lit(target).alias("target"), (F.count("*") / F.lit(max(1, target))).alias("completion_rate"), F.coalesce(took, F.lit(0)).cast("long").alias("seconds"))
