"""Chunks, topics and text cleaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.functions.text import words

# Words that are no topics.
STOP_WORDS = (
    "that", "this", "with", "from", "they", "been", "have", "their", "said", "each", "which", "them", "than", "many", "some", "time", "very", "when",
    "much", "new", "two", "may", "first", "also", "after", "back", "other", "well", "large", "should", "come", "could", "state", "over", "think",
    "its", "during", "without", "again", "place", "around", "however", "home", "small", "found", "mrs", "thought", "went", "say", "part", "once",
    "general", "high", "upon", "school", "every", "don", "does", "got", "united", "left", "number", "course", "war", "until", "always", "away",
    "something", "fact", "though", "water", "less", "public", "put", "almost", "hand", "enough", "far", "took", "head", "yet", "government", "system",
    "better", "set", "told", "nothing", "night", "end", "why", "called", "didn", "eyes", "find", "going", "look", "asked", "later", "knew", "point",
    "next", "week", "room", "came", "turn", "start", "might", "show", "move", "live", "seem", "country", "help", "talk", "where", "problem",
    "american", "about", "against", "between", "before", "under", "among",
)
REASONING_TAGS = ("think", "thinking", "reasoning", "analysis")


def sentence_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """doc_id, chunk_index, start_char, text: chunks of `size` characters, drawn back to a sentence's end, with an overlap.

    A text of `size` characters at most is one chunk as it is; other chunks are stripped, and empty ones dropped. A chunk's
    end moves back to just after the last of `.!?` among its last 100 characters (half of the chunk at most). The last
    chunk may lie in the one before. A null text gives no chunk. Each start needs the end before it, so Python cuts a text.
    """

    def cut(text: str | None) -> list[tuple[int, int, str]]:
        if text is None:
            return []
        if len(text) <= size:
            return [(0, 0, text)]
        found, start = [], 0
        while start < len(text):
            end = start + size
            if end < len(text):
                least = max(start + size // 2, end - 100) + 1
                stop = max(text.rfind(mark, least, end + 1) for mark in ".!?")
                end = stop + 1 if stop >= 0 else end
            if piece := text[start:end].strip():
                found.append((len(found), start, piece))
            start = end - overlap
        return found

    return tables.per_text(docs.select("doc_id", "text"), cut, "chunk_index int, start_char int, text string")


def word_chunks(docs: DataFrame, size: int = 500) -> DataFrame:
    """doc_id, chunk_index, text, start_word, end_word: windows of `size` words side by side, joined by one space."""
    cut = docs.select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))
    each = F.transform(starts, lambda k: F.struct(F.array_join(F.slice(F.col("w"), k * size + 1, size), " ").alias("text"), (k * size).alias("start_word"), F.least(F.size("w"), (k + 1) * size).alias("end_word")))
    return cut.select("doc_id", F.posexplode(each).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.text", "c.start_word", "c.end_word")


def chunk_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks_count"), F.sum(F.length("text")).alias("text_length"))


def topics(docs: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, topics: the most frequent words of four ASCII letters or more, ties by first appearance; documents without one are absent.

    A document is one row, so its words are counted in its row: nothing is shuffled. An accent is no edge of a word.
    """
    return with_topics(docs.select("doc_id", "text"), most).where(F.size("topics") > 0)


def with_topics(rows: DataFrame, most: int = 10) -> DataFrame:
    """rows with topics (an array, empty for a null text) in place of their last column, text."""
    return tables.per_text(rows.withColumn("text", F.lower("text")), _frequent(most), "topics array<string>")


def _frequent(most: int) -> Callable[[str | None], list[tuple[list[str]]]]:
    """The topics of a text in lower case, as one row; none for a null."""
    import re
    from collections import Counter

    find, skip = re.compile(r"(?<!\w)[a-z]{4,}(?!\w)").findall, frozenset(STOP_WORDS)

    def run(t: str | None) -> list[tuple[list[str]]]:
        count = Counter(find(t or ""))
        for w in skip & count.keys():
            del count[w]
        return [([w for w, _ in count.most_common(most)],)]

    return run


def document_context(docs: DataFrame, size: int = 500) -> DataFrame:
    """doc_id, length, n_chunks and topics of every document with words: everything a prompt about it needs but the texts. One pass over the rows."""
    base = docs.where(F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0)
    chunks = F.ceil(F.size(words(F.col("text"))) / size).cast("long")
    own = base.select("doc_id", F.length("text").alias("length"), chunks.alias("n_chunks"), "text")
    return with_topics(own).withColumn("topics", F.array_join("topics", ","))


def paragraph_chunks(docs: DataFrame, size: int = 1000, most: int = 5) -> DataFrame:
    """doc_id, chunk_index, text: whole paragraphs put together up to about `size` characters, the first `most` chunks. (Built from a description.)

    A paragraph goes to the bucket in which the sum of the lengths before it falls; buckets without one are left out, and the
    running sum stops with the last chunk that is wanted. Paragraphs stand between blank lines; those of spaces alone are none.
    """
    import re

    split = re.compile(r"\n[ \t\n\x0b\f\r]*\n").split

    def cut(text: str | None) -> list[tuple[int, str]]:
        found: list[list[str]] = []
        before, bucket = 0, -1
        for p in split(text or ""):
            if not p.strip(" "):
                continue
            if before // size != bucket:
                if len(found) == most:
                    break
                bucket = before // size
                found.append([])
            found[-1].append(p)
            before += len(p)
        return [(k, "\n\n".join(own)) for k, own in enumerate(found)]

    return tables.per_text(docs.select("doc_id", "text"), cut, "chunk_index int, text string")


def strip_reasoning_tags(text: Column) -> Column:
    for tag in REASONING_TAGS:
        text = F.regexp_replace(text, rf"(?is)<{tag}>.*?</{tag}>", "")
    return text


def strip_reasoning_preamble(text: Column) -> Column:
    """Drop a lead-in such as `Okay` up to the first bracket."""
    return F.regexp_replace(text, r"(?is)^\s*(?:Looking at|Okay|Let me|I need to|First)\b.*?(?=[\[{])", "")


def strip_boilerplate(text: Column) -> Column:
    """Drop the usual openings and closings around JSON."""
    openings = (r"Here is the JSON:?\s*", r"The JSON is:?\s*", r"JSON:?\s*", r"Response:?\s*", r"Output:?\s*", r"Okay,.*?JSON.*?:?\s*", r"Looking.*?document.*?:?\s*")
    for p in openings:
        text = F.regexp_replace(text, f"(?i)^{p}", "")
    for p in (r"\s*That's the JSON\.?", r"\s*Hope this helps\.?"):
        text = F.regexp_replace(text, f"(?i){p}$", "")
    return text


def clean_answer(text: Column) -> Column:
    """Without reasoning tags, disclaimers and bullets. (Built from its tests; the body is not given.)"""
    text = strip_reasoning_tags(text)
    text = F.regexp_replace(text, r"(?im)^\s*(?:as an ai[^.\n]*|please note[^.\n]*|disclaimer:?[^.\n]*)\.?\s*", "")
    return F.trim(F.regexp_replace(text, r"(?m)^\s*[-*•]\s+", ""))
