"""Benchmark decontamination by spaced seeds, with DataFrame operations only.

A mask takes some of the next words of a position and ignores the others, so a substitution on an ignored position does
not change the hash. Hashes of test items and of documents meet in a join; each hit lines an item up with a document, and
the words on both sides of it are compared, tolerating substitutions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: the word counts, 0: it is ignored. The masks ignore places at distances 3, 1 and 2, so each of the 78 pairs of
#: substitutions in 13 words, and each single one in 10 words or more, leaves a seed.
MASKS = ("11011011", "11100111", "11010111")
#: The masks of ORACLE_SQL, which is kept as it was: it misses two substitutions at distance 2 and items of few words.
ORACLE_MASKS = MASKS[:2]
#: Items of fewer words also have whole seeds of all their words or, if the rule allows a substitution (from SPLIT words
#: on), of both their halves, of which one is then equal.
SHORT, SPLIT = 10, 7
#: Words of the compared window, and how many of them must be equal.
WINDOW, EQUAL = 13, 11
#: Most seeds of test items (20 bytes each) and most bytes of their texts that are broadcast. Beyond either, seeds of both
#: sides are shuffled by hash, without words, and words are joined to the hits.
BROADCAST_SEEDS, BROADCAST_BYTES = 500_000, 64 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = ".,;:!?\"'()[]{}|*#%$&-_/\\<>`~^+=@"


def _words(text: Column) -> Column:
    """Lower-case words (A-Z only) without ASCII punctuation."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _MARKS, _UPPER.lower() + " " * len(_MARKS))
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _seeded(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each mask and each position where it fits: keep, words, at (from 0), mask, seed."""
    span = len(MASKS[0])
    places = F.when(F.size("words") >= span, F.sequence(F.lit(0), F.size("words") - span))
    placed = rows.select(*keep, "words", F.explode(places).alias("at"))
    seeds = [F.xxhash64(F.lit(n), *(F.get("words", F.col("at") + k) for k, bit in enumerate(mask) if bit == "1")) for n, mask in enumerate(MASKS)]
    return placed.select(*keep, "words", "at", F.explode(F.array(*seeds)).alias("seed"))


def _whole(at: Column, n: int) -> Column:
    """The seed of n words from a place on."""
    return F.xxhash64(F.lit(-n), *(F.get("words", at + k) for k in range(n)))


def _parts(n: int) -> list[tuple[int, int]]:
    """(place, words) of the whole seeds of an item of n words."""
    return [(0, n)] if n < SPLIT else [(0, n // 2), (n // 2, n - n // 2)]


def _short_items(test: DataFrame, lengths: list[int]) -> DataFrame:
    """The whole seeds of items of these numbers of words, like _seeded."""
    given = F.lit(None)
    for n in lengths:
        given = F.when(F.size("words") == n, F.array(*[F.struct(F.lit(at).alias("at"), _whole(F.lit(at), m).alias("seed")) for at, m in _parts(n)])).otherwise(given)
    return test.select("item_id", "words", F.inline(given)).select("item_id", "words", "at", "seed")


def _short_seeds(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """The seeds of documents that the whole seeds of such items can meet, like _seeded."""
    sizes = sorted({m for n in lengths for _, m in _parts(n)})
    placed = rows.select("doc_id", "words", F.explode(F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))).alias("at"))
    at = F.col("at")
    # no function with a lambda here: it would part the explosions, and all rows of a document would wait between them
    seeds = F.array(*[F.when(at + m <= F.size("words"), _whole(at, m)) for m in sizes])
    return placed.select("doc_id", "words", "at", F.explode(seeds).alias("seed"))


def _lined(rows: DataFrame, own: DataFrame, test: DataFrame, small: bool) -> DataFrame:
    """A row for each alignment of a document and an item that a seed found: the words of both where they lie over each other (a, b)."""
    named = test.withColumn("item", F.xxhash64("words"))
    seeds = named.select("seed", "item_id", "item", F.col("at").alias("item_at")).distinct()
    items = named.select("item", F.col("words").alias("item_words")).dropDuplicates(["item"])
    shift = (F.col("at") - F.col("item_at")).alias("first_word")
    if small:
        hits = own.join(F.broadcast(seeds), "seed").join(F.broadcast(items), "item").select("doc_id", "item_id", shift, "words", "item_words")
    else:
        found = own.select("doc_id", F.xxhash64("words").alias("text"), "at", "seed").join(seeds, "seed").select("doc_id", "text", "item_id", "item", shift).distinct()
        texts = rows.select(F.col("doc_id").alias("own_id"), F.xxhash64("words").alias("text"), "words")
        hits = found.join(items, "item").join(texts, ["text"]).where(F.col("doc_id").eqNullSafe(F.col("own_id")))
    low = F.greatest(F.col("first_word"), F.lit(0))
    return hits.select(
        "doc_id",
        "item_id",
        "first_word",
        F.slice("words", low + 1, F.least(F.col("first_word") + F.size("item_words"), F.size("words")) - low).alias("a"),
        F.slice("item_words", low - F.col("first_word") + 1, F.least(F.size("item_words"), F.size("words") - F.col("first_word"))).alias("b"),
        F.size("item_words").alias("n"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, most_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row (doc_id, item_id, matched, first_word) for each test item that a document holds.

    An item is held if, on some alignment that a seed found, `EQUAL` of `WINDOW` consecutive words are equal (of all words
    in the same proportion, for an item shorter than that). matched is the number of equal words on the best alignment,
    first_word the place where the item would begin in the document on it (from 0; the least one on a tie; negative if
    the item's begin is cut off). Texts without words and null texts match nothing; rows with a null id are compared like
    others; rows with equal ids are taken together. Empty tables give no rows. Whole texts are compared; columns other
    than doc_id, item_id and text are not read.

    Documents are not shuffled while the test items are few (`most_seeds` seeds and BROADCAST_BYTES at most): their seeds,
    and their words once for each item, are broadcast, and only the hits go on. Of more test items, the seeds of both sides
    meet in a shuffled join of narrow rows (hash, id, place), and words are joined to the distinct alignments. The rows
    that come out are the same.
    """
    test = benchmark.select("item_id", _words(F.col("text")).alias("words"))
    rows = docs.select("doc_id", _words(F.col("text")).alias("words"))
    seeded = _seeded(test, ["item_id"])
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    small = size <= BROADCAST_BYTES and seeded.limit(most_seeds + 1).count() <= most_seeds
    lined = _lined(rows, _seeded(rows, ["doc_id"]), seeded, small)
    lengths = sorted(r[0] for r in test.select(F.size("words").alias("n")).where(F.col("n").between(1, SHORT - 1)).distinct().collect())
    if lengths:
        lined = lined.unionByName(_lined(rows, _short_seeds(rows, lengths), _short_items(test, lengths), small))
    # an alignment has many hits; the maximum also keeps the comparison out of the join, whose rows hold whole documents
    lined = lined.groupBy("doc_id", "item_id", "first_word", "n").agg(F.max(F.struct("a", "b")).alias("pair")).select("doc_id", "item_id", "first_word", "n", "pair.a", "pair.b")
    equal = F.zip_with("a", "b", lambda x, y: F.when(x == y, 1).otherwise(0))
    wide = F.least(F.lit(WINDOW), F.col("n"))
    need = F.ceil(wide * EQUAL / WINDOW)
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    seen = lined.select("doc_id", "item_id", "first_word", "n", equal.alias("equal")).where(F.size("equal") >= wide)
    found = seen.where(F.exists(F.sequence(F.lit(1), F.size("equal") - wide + 1), lambda k: total(F.slice(F.col("equal"), k, wide)) >= need))
    best = found.select("doc_id", "item_id", total(F.col("equal")).alias("matched"), "first_word")
    return best.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", (-F.col("first_word")).alias("back"))).alias("best")).select("doc_id", "item_id", "best.matched", (-F.col("best.back")).alias("first_word"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER + _MARKS.replace("'", "''")}', '{_UPPER.lower() + " " * len(_MARKS)}'), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER + _MARKS.replace("'", "''")}', '{_UPPER.lower() + " " * len(_MARKS)}'), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM benchmark
), m AS (
  SELECT * FROM (VALUES {", ".join(f"({n}, [{', '.join(str(k) for k, bit in enumerate(mask) if bit == '1')}])" for n, mask in enumerate(ORACLE_MASKS))}) AS v(mask, taken)
), ds AS (
  SELECT doc_id, w, i, mask, list_transform(taken, lambda k : w[i + k + 1]) AS seed FROM (SELECT doc_id, w, unnest(range(0, len(w) - {len(MASKS[0]) - 1})) AS i FROM d), m
), bs AS (
  SELECT item_id, w, i, mask, list_transform(taken, lambda k : w[i + k + 1]) AS seed FROM (SELECT item_id, w, unnest(range(0, len(w) - {len(MASKS[0]) - 1})) AS i FROM b), m
), hit AS (
  SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS first_word, ds.w AS dw, bs.w AS bw FROM ds JOIN bs USING (mask, seed)
), eq AS (
  SELECT doc_id, item_id, first_word, len(bw) AS n,
    list_transform(range(greatest(0, -first_word), least(len(bw), len(dw) - first_word)), lambda k : CASE WHEN dw[first_word + k + 1] = bw[k + 1] THEN 1 ELSE 0 END) AS e FROM hit
), ok AS (
  SELECT doc_id, item_id, first_word, list_sum(e) AS matched FROM eq, unnest(range(1, len(e) - least({WINDOW}, n) + 2)) AS u(k)
  WHERE list_sum(list_slice(e, k, k + least({WINDOW}, n) - 1)) >= ceil(least({WINDOW}, n) * {EQUAL} / {WINDOW})
)
SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched, CAST(arg_min(first_word, (-matched, first_word)) AS INTEGER) AS first_word FROM ok GROUP BY doc_id, item_id"""
