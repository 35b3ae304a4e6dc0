"""Similarity of instructions: ROUGE-L and ROUGE-N, word sets, and near duplicates by a prefix-filter join."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import tables
from tessera.functions.text import words

_TOKENS = re.compile("[a-z0-9]+").findall


def _common_subsequence(places: dict[str, int], n: int, other: list[str]) -> int:
    """The length of the longest common subsequence with a text of n words whose places are given as bits.

    One number holds a row of the table: its zeros are the places where the row grows by one. Adding the matches carries
    each of them to the next growth, so a word costs a few operations on n bits.
    """
    full = row = (1 << n) - 1
    for w in other:
        if met := row & places.get(w, 0):
            row = ((row + met) | (row - met)) & full
    return n - row.bit_count()


def _places(own: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, w in enumerate(own):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _f(common: int, a: int, b: int) -> float:
    return 2 * common / (a + b) if common else 0.0


@F.pandas_udf(T.DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """The F measure of the longest common subsequence of the lower-case runs of ASCII letters and digits; 0 for a null or a text without them."""
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = _TOKENS((x or "").lower()), _TOKENS((y or "").lower())
        out.append(_f(_common_subsequence(_places(p), len(p), q), len(p), len(q)))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.StructType([T.StructField(x, T.DoubleType()) for x in ("rouge1", "rouge2")]))
def rouge_n(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The F measures of common words and pairs of words (no stemming)."""

    def f(x: list, y: list) -> float:
        return _f(sum((Counter(x) & Counter(y)).values()), len(x), len(y))

    out = []
    for x, y in zip(a, b, strict=True):
        p, q = _TOKENS((x or "").lower()), _TOKENS((y or "").lower())
        out.append((f(p, q), f(list(zip(p, p[1:], strict=False)), list(zip(q, q[1:], strict=False)))))
    return pd.DataFrame(out, columns=["rouge1", "rouge2"])


def largest_rouge_l(recent: list[tuple[str | None, str | None]], text: Column, seq: Column) -> Column:
    """The largest ROUGE-L of a text to the given (seq, text) rows but one of its own seq; 0 without any.

    A pair is left out if its lengths, or else the words that both have, already bound it by the best one so far.
    """
    known = [(s, own, _places(own), Counter(own)) for s, t in recent for own in [_TOKENS((t or "").lower())]]

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series, seqs: pd.Series) -> pd.Series:
        out = []
        for text, seq in zip(texts, seqs, strict=True):
            q, best = _TOKENS((text or "").lower()), 0.0
            own, n = Counter(q), len(q)
            for s, p, places, count in sorted(known, key=lambda k: abs(len(k[1]) - n)):
                m = len(p)
                if not n or not m or 2 * min(m, n) <= best * (m + n):
                    break  # those that follow differ more in length
                if s == (None if pd.isna(seq) else seq):
                    continue
                if 2 * sum((own & count).values()) > best * (m + n):
                    best = max(best, _f(_common_subsequence(places, m, q), m, n))
            out.append(best)
        return pd.Series(out, dtype="float64")

    return run(text, seq)


def word_set(text: Column) -> Column:
    """The distinct words of a text in lower case; none for a null."""
    return F.array_distinct(words(F.lower(text)))


def jaccard_of(x: Column, y: Column) -> Column:
    """The share of common words among all of two sets; 0 if one has none."""
    common = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(common / F.size(F.array_union(x, y)))


def jaccard(a: Column, b: Column) -> Column:
    """The same of two texts."""
    return jaccard_of(word_set(a), word_set(b))


#: Rounds in which sets are compared with the first set of each of their prefix words, before the full join.
LEADER_ROUNDS = 5
_SLACK = 1e-9  # products of thresholds and sizes that are whole numbers must not be rounded away from them


def dedup_near(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows but those whose instruction has a word-set Jaccard similarity of `threshold` or more with that of a row of smaller seq.

    Rows of one word set are copies: the one of the smallest seq stays, of equal ones the smallest row. A null seq counts as
    larger than any other; rows of equal or null seq don't remove each other unless their sets are equal. Instructions without words (null ones
    too) are copies of each other.

    An exact set-similarity join. Words are ordered by how many sets hold them, the rarest first; two sets of the given similarity share one
    of their first |w| - ceil(threshold |w|) + 1 words, so only sets that meet there are candidates, and lengths and places rule
    out most of these. Copies come first: in a few rounds each set is compared with the first set of each of its words alone, which takes
    away a group of near copies in linear time; the full join is for the sets that are left. No candidate is dropped.
    """
    names = rows.columns
    own = F.array_sort(F.array_distinct(words(F.lower(F.coalesce("instruction", F.lit(""))))))
    keyed = rows.select(F.struct(*names).alias("row"), own.alias("w")).withColumn("key", F.unhex(F.md5(F.array_join("w", " ").cast("binary"))))
    order = F.struct(F.col("row.seq").isNull().alias("none"), F.col("row.seq").alias("seq"))
    kinds = dict(rows.dtypes)
    plain = [c for c in names if not kinds[c].startswith(("map", "variant"))]  # what can be ordered
    least = F.min_by("row", F.struct(order, F.struct(*[F.col(f"row.`{c}`") for c in plain])))
    firsts = tables.cut(keyed.groupBy("key").agg(F.min(order).alias("first"), F.min("w").alias("w"), least.alias("row")))

    sets = firsts.where(F.size("w") > 0)
    held = sets.select("key", F.explode("w").alias("word"))
    count = held.groupBy("word").agg(F.count("*").alias("n"))
    sized = held.join(count, "word").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("by"))
    size = F.size("by")
    prefix = size - F.ceil(size * threshold - _SLACK) + 1
    first = sets.select("key", "first")
    posted = sized.select("key", size.alias("size"), F.posexplode(F.slice("by", 1, F.greatest(prefix, F.lit(1)).cast("int"))).alias("at", "item"))
    posted = tables.cut(posted.join(first, "key").select("key", "first", "size", "at", F.col("item.word").alias("word")))

    def near(pairs: DataFrame) -> DataFrame:
        """The keys of the pairs (key, other) that are as similar as asked."""
        w = sets.select("key", "w")
        both = pairs.join(w, "key").join(w.select(F.col("key").alias("other"), F.col("w").alias("v")), "other")
        common = F.size(F.array_intersect("w", "v"))
        return both.where(common + _SLACK >= threshold * (F.size("w") + F.size("v") - common)).select("key").distinct()

    alive, gone = posted, []
    for _ in range(LEADER_ROUNDS):
        leaders = alive.groupBy("word").agg(F.min(F.struct("first", "key")).alias("lead"))
        pairs = alive.join(leaders, "word").where(F.col("lead.first") < F.col("first")).select("key", F.col("lead.key").alias("other")).distinct()
        found = tables.cut(near(pairs))
        if found.isEmpty():
            break
        gone.append(found)
        alive = tables.cut(alive.join(found, "key", "left_anti"))
    a, b = F.col("l.size"), F.col("r.size")
    common = F.ceil(threshold / (1 + threshold) * (a + b) - _SLACK)
    reach = F.least("l.at", "r.at") + 1 + F.least(a - F.col("l.at"), b - F.col("r.at")) - 1
    fits = (F.col("r.first") < F.col("l.first")) & (F.least(a, b) + _SLACK >= threshold * F.greatest(a, b)) & (reach >= common)
    pairs = alive.alias("l").join(posted.alias("r"), "word").where(fits).select(F.col("l.key").alias("key"), F.col("r.key").alias("other")).distinct()
    gone.append(near(pairs))
    every = gone[0]
    for more in gone[1:]:
        every = every.unionByName(more)
    return firsts.join(every.distinct(), "key", "left_anti").select("row.*").select(*names)
