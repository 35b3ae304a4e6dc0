"""Repair of conversations (conv_id, turn, role, text) and their conversion to prompts and instruction rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
ROLES = ("user", "assistant", "system")
DEFAULT, GREETING, BLANK = "Hello, please respond.", "Hello", "Please respond."
FILLERS = {"user": ("assistant", "I understand. Please continue."), "other": ("user", "Please continue.")}


def sanitize(messages: DataFrame) -> DataFrame:
    """Messages with a role and a text; an unknown role becomes user, a blank text a request to respond."""
    kept = messages.where(F.col("role").isNotNull() & F.col("text").isNotNull())
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    return kept.select("conv_id", "turn", role.alias("role"), F.when(F.col("text").rlike(r"\S"), F.col("text")).otherwise(BLANK).alias("text"))


def with_default(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """A conversation without a message gets one from the user."""
    empty = conversations.select("conv_id").distinct().join(messages.select("conv_id").distinct(), "conv_id", "left_anti")
    return messages.unionByName(empty.select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(DEFAULT).alias("text")))


def user_first(messages: DataFrame) -> DataFrame:
    """A greeting before the first message, one turn earlier, where that isn't the user's."""
    first = messages.groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("f")).where(F.col("f.role") != "user")
    return messages.unionByName(first.select("conv_id", (F.col("f.turn") - 1).alias("turn"), F.lit("user").alias("role"), F.lit(GREETING).alias("text")))


def alternate(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text): a filler (part 0) stands before a message of the same role as the one before it."""
    last = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    user = F.col("role") == "user"
    filler = F.struct(F.lit(0).alias("part"), F.when(user, FILLERS["user"][0]).otherwise(FILLERS["other"][0]).alias("role"), F.when(user, FILLERS["user"][1]).otherwise(FILLERS["other"][1]).alias("text"))
    own = F.struct(F.lit(1).alias("part"), F.col("role").alias("role"), F.col("text").alias("text"))
    return messages.withColumn("last", last).select("conv_id", "turn", F.inline(F.when(F.col("last") == F.col("role"), F.array(filler, own)).otherwise(F.array(own))))


def to_prompt(messages: DataFrame) -> DataFrame:
    """(conv_id, prompt): one line `Role: text` for each message in order."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("text"))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


def append_if_absent(messages: DataFrame, prompts: DataFrame) -> DataFrame:
    """Each conversation's prompt (conv_id, text) as a last user message, unless one of its messages has that text."""
    new = prompts.join(messages.select("conv_id", "text").distinct(), ["conv_id", "text"], "left_anti")
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("m"))
    return messages.unionByName(new.join(last, "conv_id", "left").select("conv_id", F.coalesce(F.col("m") + 1, F.lit(0)).cast("long").alias("turn"), F.lit("user").alias("role"), "text"))


def to_instructions(messages: DataFrame) -> DataFrame:
    """(seq, conv_id, instruction, input, output): each user message with the assistant's that follows it. seq orders rows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = messages.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("output"))
    pairs = turns.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    return pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "conv_id", F.col("text").alias("instruction"), F.lit("").alias("input"), "output")
