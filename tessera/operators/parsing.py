"""Structured data out of model responses (case, response)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.chunking import strip_boilerplate, strip_reasoning_tags

# Criteria of each task and what each is worth.
CRITERIA = {
    "fact_extraction": {"accuracy": 0.3, "specificity": 0.25, "completeness": 0.2, "relevance": 0.15, "clarity": 0.1},
    "concept_extraction": {"definition_quality": 0.35, "examples_relevance": 0.25, "relationships": 0.2, "domain_accuracy": 0.15, "completeness": 0.05},
    "analytical_qa": {"question_quality": 0.25, "answer_accuracy": 0.35, "analytical_depth": 0.25, "coherence": 0.15},
}
NUMBER = r"([0-9]*\.?[0-9]+)"


def _valid(text: Column) -> Column:
    """The text if it is a JSON object or array, else null. In brackets, for the parser lets text after the first value pass."""
    trimmed = F.trim(text, F.lit(" \n\r\t"))
    return F.when(trimmed.rlike(r"^[\[{]") & F.try_parse_json(F.concat(F.lit("["), trimmed, F.lit("]"))).isNotNull(), trimmed)


@F.pandas_udf(T.StringType())
def _scan(texts: pd.Series) -> pd.Series:
    """The first {..} or [..] that is JSON, tried from every bracket; null for a null text. A value nested deeper than the parser goes is none."""
    import json
    import re

    opening, run = re.compile(r"[{\[]"), re.compile(r"[\[\s]*")
    decode = json.JSONDecoder().raw_decode

    def too_deep(text: str, at: int) -> bool:
        try:
            decode(text, at)
        except RecursionError:
            return True
        except ValueError:
            pass
        return False

    def one(text: str | None) -> str | None:
        start = opening.search(text or "")
        while start:
            at = start.start()
            try:
                return text[at : decode(text, at)[1]]
            except ValueError:
                at += 1
            except RecursionError:  # each bracket of a run of [ lies one deeper than the next, so the first that may do is found by halving
                own = [k for k in range(at, run.match(text, at).end()) if text[k] == "["] or [at]
                at = own[bisect_left(own, True, key=lambda k: not too_deep(text, k))] if not too_deep(text, own[-1]) else own[-1] + 1
            start = opening.search(text, at)
        return None

    return texts.map(one)


def extract_json(responses: DataFrame) -> DataFrame:
    """Adds json and strategy: whole text, fenced block, greedy brackets, cleaned text, then a bracket scan on what is left.

    The native strategies are an array that is filtered once, and the scan gets a null where one of them applied. json is
    null if none does.
    """
    r = F.coalesce("response", F.lit(""))
    cleaned = strip_boilerplate(F.trim(strip_reasoning_tags(r)))
    steps = {
        "whole": r,
        "fenced": F.regexp_extract(r, r"(?s)```(?:json)?\s*(.*?)```", 1),
        "array": F.when(F.contains(r, F.lit("]")), F.regexp_extract(r, r"(?s)(\[.*\])", 1)),  # without a closing bracket every opening one would be tried to the end
        "object": F.when(F.contains(r, F.lit("}")), F.regexp_extract(r, r"(?s)(\{.*\})", 1)),
        "cleaned": cleaned,
        "from_bracket": F.regexp_extract(cleaned, r"(?s)([\[{].*)$", 1),
    }
    tried = F.array(*[F.struct(c.alias("json"), F.lit(n).alias("strategy")) for n, c in steps.items()])
    found = F.get(F.filter(F.transform(tried, lambda t: F.struct(_valid(t["json"]).alias("json"), t["strategy"].alias("strategy"))), lambda t: t["json"].isNotNull()), F.lit(0))
    first = responses.withColumn("__f", found)
    both = first.withColumn("__s", _scan(F.when(F.col("__f").isNull(), r)))
    return both.select(*responses.columns, F.coalesce("__f.json", "__s").alias("json"), F.coalesce("__f.strategy", F.when(F.col("__s").isNotNull(), "scan")).alias("strategy"))


def first_array_or_object(text: Column) -> Column:
    """The greedy array or object of a text without tags and fences; `[]` without one."""
    plain = F.regexp_replace(strip_reasoning_tags(text), r"```(?:json)?", "")
    found = F.regexp_extract(plain, r"(?s)(\[.*\]|\{.*\})", 1)
    return F.when(found == "", "[]").otherwise(found)


def parse_instruction(text: Column) -> Column:
    """struct(instruction, input, output) from JSON between the outer braces, else from labelled lines; null without an instruction and an output."""
    kind = "struct<instruction:string,input:string,output:string>"
    json = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), kind)
    part = lambda n: F.trim(F.regexp_extract(text, rf"(?is)(?:^|\n)\s*{n}:[ \t]*(.*?)(?=\n\s*(?:instruction|input|output):|$)", 1))
    lines = F.struct(part("instruction").alias("instruction"), part("input").alias("input"), part("output").alias("output"))
    held = json["instruction"].isNotNull() & json["input"].isNotNull() & json["output"].isNotNull()
    made = F.when(held, json).otherwise(lines)
    return F.when((F.coalesce(made["instruction"], F.lit("")) != "") & (F.coalesce(made["output"], F.lit("")) != ""), made)


def valid_facts(json: Column) -> Column:
    """Whether a JSON array's items all have the four keys, and a confidence that is a known word or a number in [0, 1]."""
    items = F.from_json(json, "array<map<string,string>>")
    keys = ("content", "context", "fact_type", "confidence")
    sure = lambda m: F.lower(m["confidence"]).isin("high", "medium", "low") | F.coalesce(m["confidence"].try_cast("double").between(0, 1), F.lit(False))
    return F.coalesce(F.forall(items, lambda m: F.size(F.array_intersect(F.map_keys(m), F.array(*map(F.lit, keys)))).eqNullSafe(4) & F.coalesce(sure(m), F.lit(False))), F.lit(False))


def total_score(text: Column, task: str) -> Column:
    """`TOTAL SCORE: x`, 1 at most; without it the sum of the criteria named, each at most what it is worth."""
    number = lambda name: F.regexp_extract(text, rf"(?i){name}:\s*{NUMBER}", 1).try_cast("double")
    capped = lambda name, most: F.when(number(name).isNotNull(), F.least(number(name), F.lit(most)))
    parts = [F.coalesce(capped(n, w), F.lit(0.0)) for n, w in CRITERIA[task].items()]
    every = parts[0]
    for p in parts[1:]:
        every = every + p
    return F.coalesce(capped("TOTAL SCORE", 1.0), every)


def consistency_scores(text: Column) -> Column:
    """struct of three named scores, each .5 if it is missing."""
    return F.struct(*[F.coalesce(F.regexp_extract(text, rf"(?i){n.upper()}:\s*{NUMBER}", 1).try_cast("double"), F.lit(0.5)).alias(n) for n in ("format_consistency", "quality_stability", "response_pattern")])


def train_template(rows: DataFrame) -> DataFrame:
    """Adds prompt: the training template with or without an input."""
    a = "Below is an instruction that describes a task"
    b = "Write a response that appropriately completes the request."
    given = F.concat(F.lit(f"{a}, paired with an input that provides further context. {b}\n\n### Instruction:\n"), F.col("instruction"), F.lit("\n\n### Input:\n"), F.col("input"), F.lit("\n\n### Response:\n"))
    alone = F.concat(F.lit(f"{a}. {b}\n\n### Instruction:\n"), F.col("instruction"), F.lit("\n\n### Response:\n"))
    return rows.withColumn("prompt", F.when(F.trim(F.coalesce("input", F.lit(""))) != "", given).otherwise(alone))


def generation_prompt(contexts: DataFrame) -> DataFrame:
    """Adds prompt to (context, topics, seed): the first 300 characters of the context, five topics and an example."""
    text = F.concat_ws(
        "\n",
        F.lit("Write one new instruction with its input and output as JSON with the keys instruction, input, output."),
        F.concat(F.lit("Context: "), F.substring("context", 1, 300)),
        F.concat(F.lit("Topics: "), F.array_join(F.slice("topics", 1, 5), ", ")),
        F.concat(F.lit("Example: "), F.col("seed")),
    )
    return contexts.withColumn("prompt", text)


def scoring_prompt(rows: DataFrame, task: str) -> DataFrame:
    """Adds prompt to (text, response): the criteria of the task, the document's first 2000 characters, the response."""
    criteria = "\n".join(f"{n.upper()}: 0.0 to {w}" for n, w in CRITERIA[task].items())
    return rows.withColumn("prompt", F.concat(F.lit(f"Score this response.\n{criteria}\nTOTAL SCORE: the sum\n\nDOCUMENT:\n"), F.substring("text", 1, 2000), F.lit("\n\nRESPONSE:\n"), F.col("response")))


def batch_inference(prompts: DataFrame, model: Callable[[list[str]], list[str]], tries: int = 3, partitions: int | None = None) -> DataFrame:
    """Adds response and error to rows with a prompt, by the given model, a batch at a time; a batch that fails `tries` times keeps its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(tries):
                try:
                    out, error = model(b["prompt"].tolist()), None
                    break
                except Exception as e:
                    out, error = [None] * len(b), str(e)
            yield b.assign(response=out, error=error)

    rows = prompts.repartition(partitions) if partitions else prompts
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return rows.mapInPandas(run, f"{schema}, response string, error string")


def valid_concepts(json: Column) -> Column:
    """Whether a JSON array's items all are objects with the four keys, and examples and relationships, where given, arrays."""
    items = F.from_json(json, "array<map<string,variant>>")
    keys = F.array(*map(F.lit, ("name", "definition", "domain", "confidence")))
    listed = lambda m, k: F.coalesce(F.schema_of_variant(m[k]).startswith("ARRAY"), F.lit(True))
    return F.coalesce(F.forall(items, lambda m: F.size(F.array_intersect(F.map_keys(m), keys)).eqNullSafe(4) & listed(m, "examples") & listed(m, "relationships")), F.lit(False))


def explode_facts(parsed: DataFrame, most: int = 5) -> DataFrame:
    """parsed's columns but json, with pos (from 0), content, context, fact_type and confidence of the first facts of its array; missing ones get defaults."""
    items = F.slice(F.from_json("json", "array<struct<content:string,context:string,fact_type:string,confidence:string>>"), 1, most)
    rest = [c for c in parsed.columns if c != "json"]
    each = parsed.select(*rest, F.posexplode(items).alias("pos", "f"))
    given = {"content": "", "context": "", "fact_type": "general", "confidence": "0.5"}
    return each.select(*rest, "pos", *[F.coalesce(F.col("f")[k], F.lit(v)).alias(k) for k, v in given.items()])


def explode_concepts(parsed: DataFrame, most: int = 3) -> DataFrame:
    """The same for concepts: name, definition, domain, confidence, examples and relationships."""
    items = F.slice(F.from_json("json", "array<struct<name:string,definition:string,domain:string,confidence:string,examples:array<string>,relationships:array<string>>>"), 1, most)
    rest = [c for c in parsed.columns if c != "json"]
    each = parsed.select(*rest, F.posexplode(items).alias("pos", "f"))
    given = {"name": "", "definition": "", "domain": "", "confidence": "medium"}
    none = F.array().cast("array<string>")
    return each.select(*rest, "pos", *[F.coalesce(F.col("f")[k], F.lit(v)).alias(k) for k, v in given.items()], *[F.coalesce(F.col("f")[k], none).alias(k) for k in ("examples", "relationships")])
