"""Scores of model outputs (model, task, score, ts), scoreboards, the registry and model selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.functions.text import contains_any, word_count

# Fixed values: (substrings, score) in order; the first hit counts, also on parts of a larger number.
SPEED = ((("0.5b", "1b", "1.8b"), 0.95), (("2b", "3b"), 0.85), (("7b", "8b"), 0.6), (("13b", "14b", "15b"), 0.4), (("30b", "34b", "70b"), 0.2), (("phi", "gemma"), 0.8), (("llama", "mistral"), 0.6))
SIZE = ((("70b", "65b"), 1.0), (("30b", "34b"), 0.9), (("13b", "14b", "15b"), 0.8), (("7b", "8b"), 0.7), (("3b", "2b"), 0.5), (("1b", "0.5b"), 0.3))
EMBEDDERS = ("embed", "bge", "e5-", "minilm", "gte")
WEIGHTS = {"fact_extraction": 1.0, "concept_extraction": 1.0, "analytical_qa": 1.2}
CONFIDENCE_WORDS = {"high": 0.9, "medium": 0.7, "low": 0.5}


def _tier(text: Column, *steps: tuple[int, float]) -> Column:
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    out = F.lit(0.0)
    for least, score in sorted(steps):
        out = F.when(n >= least, F.lit(score)).otherwise(out)
    return out


def fact_score(content: Column, context: Column, confidence: Column) -> Column:
    return _tier(content, (10, 0.4), (5, 0.2)) + _tier(context, (10, 0.3), (5, 0.15)) + F.coalesce(confidence.cast("double"), F.lit(0.5)) * 0.3


def concept_score(name: Column, definition: Column, examples: Column, relationships: Column) -> Column:
    held = lambda a: F.when(F.size(a) > 0, 0.2).otherwise(0.0)
    return _tier(name, (3, 0.2)) + _tier(definition, (20, 0.4), (10, 0.2)) + held(examples) + held(relationships)


def qa_score(instruction: Column, output: Column) -> Column:
    return _tier(instruction, (10, 0.5), (5, 0.25)) + _tier(output, (50, 0.5), (20, 0.25))


def _longer(text: Column, n: int, score: float) -> Column:
    return F.when(F.length(F.coalesce(text, F.lit(""))) > n, score).otherwise(0.0)


def fact_score_v2(content: Column, context: Column, kind: Column, confidence: Column) -> Column:
    typed = F.when(F.coalesce(kind, F.lit("")).isin("", "general"), 0.0).otherwise(0.2)
    return _longer(content, 10, 0.4) + _longer(context, 5, 0.3) + typed + F.when(confidence > 0.5, 0.1).otherwise(0.0)


def concept_score_v2(name: Column, definition: Column, examples: Column, confidence: Column) -> Column:
    return _longer(name, 3, 0.3) + _longer(definition, 10, 0.4) + F.when(F.size(examples) > 0, 0.2).otherwise(0.0) + F.when(confidence > 0.5, 0.1).otherwise(0.0)


def qa_score_v2(instruction: Column, output: Column) -> Column:
    asks = F.when(F.contains(F.coalesce(instruction, F.lit("")), F.lit("?")), 0.2).otherwise(0.0)
    return _longer(instruction, 10, 0.3) + _longer(output, 20, 0.4) + asks + F.when(word_count(output) > 10, 0.1).otherwise(0.0)


def fact_points_v3(content: Column, context: Column, kind: Column, confidence: Column) -> Column:
    """Of five points."""
    typed = F.when(kind == "general", 0.5).when(F.coalesce(kind, F.lit("")) == "", 0.0).otherwise(1.0)
    return _tier(content, (20, 2.0), (10, 1.0)) + _tier(context, (10, 1.0)) + typed + F.coalesce(confidence.cast("double"), F.lit(0.5))


def concept_points_v3(name: Column, definition: Column, examples: Column, relationships: Column, confidence: Column) -> Column:
    """Of six points."""
    real = lambda a: F.size(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.length(F.trim(x)) >= 3))
    shown = F.when(real(examples) >= 2, 1.0).when(real(examples) >= 1, 0.5).otherwise(0.0)
    return _tier(name, (3, 1.0)) + _tier(definition, (50, 2.0), (20, 1.0), (5, 0.5)) + shown + F.when(real(relationships) >= 1, 1.0).otherwise(0.0) + F.coalesce(confidence.cast("double"), F.lit(0.5))


#: Words of an instruction that ask for an analysis.
ANALYTICAL = ("compare", "contrast", "analyze", "relationship", "difference", "similarity")


def qa_points_v3(instruction: Column, output: Column) -> Column:
    """Of four points: a valid instruction (3 words or more), a valid output (5 or more), a pair in which both hold and differ, and depth.

    What makes an instruction, an output and a pair valid is ours; only that they count is given.
    """
    good, full = word_count(instruction) >= 3, word_count(output) >= 5
    point = lambda c, x: F.when(c, x).otherwise(0.0)
    asks = contains_any(F.lower(instruction), ANALYTICAL)
    return point(good, 1.0) + point(full, 1.0) + point(good & full & (F.lower(F.trim(instruction)) != F.lower(F.trim(output))), 1.0) + point(asks & (output != ""), 0.5) + point((word_count(output) >= 30) & (instruction != ""), 0.5)


def score_by_model(items: DataFrame, points: Column, most: float = 1.0, expected: int | None = None) -> DataFrame:
    """(model, score): the mean share of the points, 1 at most; with an expected count .8 of it and .2 of the share of items there are."""
    share = F.least(F.avg(points) / most, F.lit(1.0))
    if expected:
        share = share * 0.8 + F.least(F.count("*") / expected, F.lit(1.0)) * 0.2
    return items.groupBy("model").agg(share.alias("score"))


def model_type(model: Column) -> Column:
    low = F.lower(model)
    return F.when(contains_any(low, EMBEDDERS) | F.contains(low, F.lit("bert")), "embedding").otherwise("text_generation")


def suitable_models(models: DataFrame, preferred: tuple[str, ...]) -> DataFrame:
    """Models whose name holds a preferred family; all models if there is none."""
    marked = models.withColumn("fits", contains_any(F.lower("model"), preferred))
    some = marked.agg(F.coalesce(F.bool_or("fits"), F.lit(False)).alias("some"))
    return marked.join(F.broadcast(some), F.lit(True)).where(F.col("fits") | ~F.col("some")).select(*models.columns)


def confidence_value(text: Column) -> Column:
    """A word or a number as a confidence; anything else counts .5."""
    named = F.create_map(*[F.lit(x) for p in CONFIDENCE_WORDS.items() for x in p])
    return F.coalesce(F.element_at(named, F.lower(F.trim(text))), text.try_cast("double"), F.lit(0.5))


def latest_scores(scores: DataFrame) -> DataFrame:
    """(model, task, score, evaluations): the latest score of each pair, the larger on a tie."""
    return scores.groupBy("model", "task").agg(F.max(F.struct("ts", "score"))["score"].alias("score"), F.count("*").alias("evaluations"))


def registry(scores: DataFrame) -> DataFrame:
    """(model, overall_score, tasks, evaluations): the mean of the latest task scores."""
    return latest_scores(scores).groupBy("model").agg(F.avg("score").alias("overall_score"), F.count("*").alias("tasks"), F.sum("evaluations").alias("evaluations"))


def registry_lookup(wanted: DataFrame, latest: DataFrame, overall: DataFrame) -> DataFrame:
    """(model, task, score): the task's score, else the model's overall score, else .5."""
    found = wanted.join(latest.select("model", "task", "score"), ["model", "task"], "left").join(overall.select("model", "overall_score"), "model", "left")
    return found.select("model", "task", F.coalesce("score", "overall_score", F.lit(0.5)).alias("score"))


def scoreboard(models: DataFrame, tasks: DataFrame, scores: DataFrame, largest: float) -> DataFrame:
    """(model, total, possible, percent) of each model over all tasks: a task without a score counts 0."""
    best = latest_scores(scores).select("model", "task", "score").join(tasks.select("task").distinct(), "task", "left_semi")
    sums = best.groupBy("model").agg(F.sum("score").alias("total"))
    many = tasks.agg((F.count_distinct("task") * F.lit(largest)).alias("possible"))  # one row
    board = models.select("model").distinct().join(sums, "model", "left").join(F.broadcast(many), F.lit(True))
    return board.select("model", F.coalesce("total", F.lit(0.0)).alias("total"), "possible").withColumn("percent", F.col("total") / F.col("possible") * 100)


def ranking(board: DataFrame) -> DataFrame:
    """Adds rank by total, ties by model."""
    return tables.numbered(board, "rank", F.desc("total"), F.col("model")).withColumn("rank", F.col("rank").cast("int"))


def task_performance(latest: DataFrame) -> DataFrame:
    """(task, best_model, best_score, worst_model, worst_score, average); ties to the smaller model."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "model"))
    worst = F.min(F.struct("score", "model"))
    return latest.groupBy("task").agg(best["model"].alias("best_model"), (-best["s"]).alias("best_score"), worst["model"].alias("worst_model"), worst["score"].alias("worst_score"), F.avg("score").alias("average"))


def performance_summary(latest: DataFrame, models: DataFrame) -> DataFrame:
    """(task, models_evaluated, coverage_percent)."""
    total = models.agg(F.count_distinct("model").alias("all"))
    return latest.groupBy("task").agg(F.count_distinct("model").alias("models_evaluated")).join(F.broadcast(total), F.lit(True)).select("task", "models_evaluated", (F.col("models_evaluated") / F.col("all") * 100).alias("coverage_percent"))


def weighted_score(latest: DataFrame, weights: DataFrame) -> DataFrame:
    """(model, weighted): the mean of the task scores by the weights (task, weight); an unknown task weighs 1."""
    w = F.coalesce("weight", F.lit(1.0))
    return latest.join(weights, "task", "left").groupBy("model").agg((F.sum(w * F.col("score")) / F.sum(w)).alias("weighted"))


def _family(model: Column, steps: tuple, hosted: tuple, default: float) -> Column:
    name = F.lower(F.when(F.contains(model, F.lit(":")), F.regexp_replace(model, "^[^:]*:", "")).otherwise(model))
    own = F.when(model.startswith("openai:"), F.when(F.contains(name, F.lit(hosted[0][0])), hosted[0][1]).when(F.contains(name, F.lit(hosted[1][0])), hosted[1][1]).otherwise(0.8))
    for terms, score in steps:
        own = own.when(contains_any(name, terms), score)
    return own.otherwise(default)


def speed_score(model: Column) -> Column:
    return _family(model, SPEED, (("gpt-3.5", 0.9), ("gpt-4", 0.7)), 0.5)


def size_bonus(model: Column) -> Column:
    return _family(model, SIZE, (("gpt-4", 0.9), ("gpt-3.5", 0.7)), 0.6)


STRATEGIES = ("performance", "balanced", "speed", "quality")


def select_model(scored: DataFrame) -> DataFrame:
    """(task, strategy, model, value) for four strategies over (task, position, model, score); the first of equals wins."""
    p, v, s = F.col("score"), speed_score(F.col("model")), size_bonus(F.col("model"))
    each = F.array(*[F.struct(F.lit(n).alias("strategy"), F.round(x, 9).alias("value")) for n, x in zip(STRATEGIES, (p, p * 0.6 + v * 0.4, v, p * 0.8 + s * 0.2), strict=True)])
    flat = scored.select("task", "position", "model", F.inline(each))
    best = F.min(F.struct((-F.col("value")).alias("v"), "position", "model"))
    return flat.groupBy("task", "strategy").agg(best.alias("b")).select("task", "strategy", "b.model", (-F.col("b.v")).alias("value"))


def model_recommendations(scored: DataFrame) -> DataFrame:
    """(task, the model that each strategy selects, models: how many distinct ones there are to select from); a task without models has no row."""
    many = scored.groupBy("task").agg(F.count_distinct("model").alias("models"))
    chosen = select_model(scored).groupBy("task").agg(*[F.max(F.when(F.col("strategy") == n, F.col("model"))).alias(n) for n in STRATEGIES])
    return chosen.join(many, "task")


def performance_report(ratios: DataFrame, *names: str) -> DataFrame:
    """Adds overall, the mean of the ratios, and status by bands."""
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n)
    mean = total / len(names)
    return ratios.withColumn("overall", mean).withColumn("status", F.when(mean >= 0.9, "excellent").when(mean >= 0.7, "good").when(mean >= 0.5, "fair").otherwise("poor"))


def model_subset_analysis(board: DataFrame, subset: DataFrame, helped: DataFrame) -> DataFrame:
    """Models of subset in the order of their total: (model, total, percent, assistance), assistance being how often helped names the model."""
    help_ = helped.groupBy("model").agg(F.count("*").alias("assistance"))
    own = board.join(subset.select("model").distinct(), "model", "left_semi").join(help_, "model", "left")
    return own.select("model", "total", "percent", F.coalesce("assistance", F.lit(0)).cast("long").alias("assistance"))


def evaluation_recommendations(board: DataFrame, latest: DataFrame) -> DataFrame:
    """(kind, model, score): the best model over all (the least name on a tie), and the best of each task that has a score above 0."""
    best = board.agg(F.min(F.struct((-F.col("total")).alias("low"), "model")).alias("b")).where("b is not null").select(F.lit("overall").alias("kind"), "b.model", (-F.col("b.low")).alias("score"))
    each = latest.where("score > 0").groupBy("task").agg(F.min(F.struct((-F.col("score")).alias("low"), "model")).alias("b"))
    return best.unionByName(each.select(F.col("task").alias("kind"), "b.model", (-F.col("b.low")).alias("score")))
