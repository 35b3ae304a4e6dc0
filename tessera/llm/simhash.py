"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within `radius` bits differ in some segment by at
most radius // segments bits, so it is enough to enumerate that small Hamming ball in each segment,
fetch the table's entries under these keys, and verify the whole distance. A ball of radius two is
shared out: the keys of either side reach one bit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch, words
from tessera.llm.components import components
from tessera.llm.words import distinct, mix

BITS = 64


def _majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The bits that over half of the rows (or of their weight) set, packed, most significant first."""
    bits = np.unpackbits(np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(len(hashes), -1), axis=1)
    if weights is None:
        return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits))
    return np.packbits(2 * (weights @ bits) > weights.sum())


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text's word shingles with repeats; 0 without words."""
    import xxhash

    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return 0
    grams = map(b" ".join, zip(*(own[k:] for k in range(shingle)), strict=False)) if len(own) >= shingle else [b" ".join(own)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, 42) for x in grams], dtype=np.uint64)
    return int.from_bytes(_majority(hashes).tobytes(), "big")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, f0): the fingerprint of every text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _signed([fingerprint(x, shingle) for x in b.column(1).to_pylist()])], ["doc_id", "f0"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f0 long")


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << k for k in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _keys(fps: DataFrame, segments: list[tuple[int, int]], radius: int) -> DataFrame:
    """A row for each segment and each key in the ball around the fingerprint's bits there."""
    parts = []
    for at, (shift, width) in enumerate(segments):
        word, low = divmod(shift, 64)
        got = F.shiftrightunsigned(F.col(f"f{word}"), low)
        if low + width > 64:
            got = got.bitwiseOR(F.shiftleft(F.col(f"f{word + 1}"), 64 - low))
        got = got.bitwiseAND(F.lit((1 << width) - 1))
        # a key holds its segment's number above the segment's bits; widths are 40 bits at most
        parts += [F.lit(at << 40).bitwiseOR(got.bitwiseXOR(F.lit(m))) for m in _masks(width, radius)]
    return fps.select("*", F.explode(F.array(*parts)).alias("key"))


def segments_of(bits: int, count: int) -> list[tuple[int, int]]:
    cuts = [bits * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _distance(parts: int) -> Column:
    return sum((F.bit_count(F.col(f"l.f{k}").bitwiseXOR(F.col(f"r.f{k}"))) for k in range(parts)), F.lit(0))


def close_pairs(fps: DataFrame, bits: int, radius: int, segments: int, extra: Column | None = None, confirm: Callable[[DataFrame], DataFrame] = lambda pairs: pairs, linked: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of rows (node, f0, .. and what extra asks for) whose fingerprints differ in `radius` bits at most and that confirm keeps.

    Links that are known before (linked) come out too, and pairs in one of their components are not searched for.

    A large group of close fingerprints would give all its pairs. So each table entry is first linked with the smallest
    of its bucket, if that is truly close; only pairs that these links leave in different components come out of the
    second search. The components are those of all pairs.
    """
    cut = segments_of(bits, segments)
    reach = radius // segments
    near = _distance(bits // 64) <= radius
    if extra is not None:
        near = near & extra
    cols = [F.col(c) for c in fps.columns]
    table = _keys(fps, cut, 0)
    least = table.groupBy("key").agg(F.min(F.struct("node", *[c for c in fps.columns if c != "node"])).alias("s")).select("key", "s.*")
    stars = scratch.cut(confirm(table.alias("l").join(least.alias("r"), "key").where((F.col("l.node") > F.col("r.node")) & near).select(F.col("r.node").alias("a"), F.col("l.node").alias("b")).distinct()))
    if linked is not None:
        stars = scratch.cut(stars.unionByName(linked))
    roots = components(stars)
    known = fps.join(roots, "node", "left").select(*cols, F.coalesce("root", "node").alias("root"))
    probes = _keys(known, cut, reach - reach // 2)
    entries = _keys(known, cut, reach // 2)
    found = probes.alias("l").join(entries.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root")) & near)
    return stars.unionByName(confirm(found.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))))


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, segments: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, f0 (the fingerprint) and component_id, the smallest doc_id reachable by links.

    Fingerprints link at `radius` or fewer differing bits; equal ones always. Texts without words (null and empty ones
    too) have fingerprint zero and link like any other. Repeated rows each come out. A null doc_id counts for a group
    only if it has no other: its component_id is then null. An empty table gives no rows. Other columns are not read.

    Copies are one node, a fingerprint; so a group of copies costs one row. Very long texts are fingerprinted whole.
    """
    each = scratch.cut(fingerprints(docs, shingle))
    fps = scratch.cut(each.groupBy("f0").agg(F.min("doc_id").alias("least")))
    roots = components(close_pairs(fps.select(F.col("f0").alias("node"), "f0"), BITS, radius, segments))
    rooted = fps.join(roots.withColumnRenamed("node", "f0"), "f0", "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.join(tops, "root").select("f0", "component_id")
    return each.join(members, "f0").select("doc_id", "f0", "component_id")


#: Wide fingerprints of a text's distinct words, weighted by the root of their counts, for candidates of near copies: texts
#: whose shingles agree in 0.8 differ in about 8 of 128 bits if the edits are scattered, in more if they are in one block. A
#: wider ball finds more of these, but also all pairs of texts that share a passage; the sketches below find the rest.
WIDE = {"bits": 128, "radius": 7, "segments": 4}
#: Sketches of a text's shingles, which find near copies whatever the kind of edit: so many bands of so many least hashes.
#: Texts of similarity J share a band with probability 1 - (1 - J**5)**30, which is 0.99999 at 0.8.
BANDS, DEPTH = 30, 5
_FACTORS = mix(np.arange(1, BANDS * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
#: Standard deviations below the least similarity from which on the share of equal least hashes rules a pair out.
DEVIATIONS = 6
#: Most ids whose texts are found by a broadcast; beyond it the texts are shuffled.
BROADCAST_IDS = 200_000
#: Texts whose shingles are hashed at once.
COMPARED = 256
#: Most rows of a bucket whose pairs are joined one by one. A larger bucket is cut into parts of so many rows, and so many
#: shingles, and each two parts are compared in one task, which hands on links alone.
PAIRED, PART_ROWS, PART_SHINGLES = 8, 256, 1 << 18
#: Shingles that meet in one matrix product.
COLUMNS = 4096


def _shingle_hashes(each: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of the shingles of a text whose words have these hashes; one for a text of fewer words."""
    size = min(size, len(each))
    grams = np.full(max(1, len(each) - size + 1), size, dtype=np.uint64)
    for k in range(size):
        grams = mix(grams + each[k : len(each) - size + k + 1])
    return distinct(grams)


def _word_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """The digests of the words of each text, in lower case (A-Z)."""
    for a, b, data, offsets in words.texts(column):
        w = words.split(data, offsets, lower=True)
        digests = w.digests()
        for k in range(b - a):
            yield digests[w.bound[k] : w.bound[k + 1]]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * DEPTH hash functions over the hashes of a text's shingles, in 32 bits."""
    low = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1024):
        low = np.minimum(low, (_FACTORS[:, None] * shingles[None, at : at + 1024]).min(axis=1))
    return mix(low).astype(np.uint32)


def bands(sketched: Column) -> list[Column]:
    """A key for each band of a sketch."""
    return [F.xxhash64(F.lit(b), *[F.get(sketched, F.lit(DEPTH * b + k)) for k in range(DEPTH)]) for b in range(BANDS)]


def _wide(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, c0, c1: hash of the set of shingles, f0, f1: wide fingerprint, n: distinct shingles, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows, sketches = [], []
            for each in _word_hashes(b.column(1)):
                own, count = np.unique(each[:, 0], return_index=True, return_counts=True)[1:] if len(each) else (np.zeros(0, np.int64),) * 2
                bits = _majority(each[own].reshape(-1, 2), np.sqrt(count.astype(float))) if len(own) else np.zeros(16, np.uint8)
                shingles = _shingle_hashes(each[:, 0], shingle)
                sketches.append(sketch(shingles).view(np.int32))
                rows.append((*divmod(xxhash.xxh3_128_intdigest(shingles.tobytes(), 7), 1 << 64), *bits.view(">u8").tolist(), len(shingles)))
            c0, c1, f0, f1, n = zip(*rows, strict=True) if rows else ((),) * 5
            width = BANDS * DEPTH
            keys = pa.ListArray.from_arrays(pa.array(range(0, width * len(rows) + 1, width), pa.int32()), pa.array(np.concatenate(sketches) if sketches else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(_signed(list(x)) for x in (c0, c1, f0, f1)), pa.array(n, pa.int64()), keys], ["doc_id", "c0", "c1", "f0", "f1", "n", "sketch"])
            scratch.release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, c0 long, c1 long, f0 long, f1 long, n long, sketch array<int>")


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a symmetric matrix of links: fewer than it has rows."""
    new, out = np.ones(len(links), bool), []
    for start in range(len(links)):
        new[start], ahead = False, [start]
        while ahead:
            at = ahead.pop()
            found = np.flatnonzero(links[at] & new)
            new[found] = False
            out += [(at, k) for k in found.tolist()]
            ahead += found.tolist()
    return out


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of these sets of distinct values have in common."""
    size = len(sets)
    row = np.repeat(np.arange(size), [len(x) for x in sets])
    column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    met = count > 1
    row, column = row[met[column]], (np.cumsum(met) - 1)[column[met[column]]]
    order = np.argsort(column, kind="stable")
    row, column, common = row[order], column[order], np.zeros((size, size))
    for at in range(0, int(met.sum()), COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        some = np.zeros((size, COLUMNS), np.float32)  # counts stay far below 2**24, so they are exact
        some[row[a:b], column[a:b] - at] = 1
        common += some @ some.T
    common[np.arange(size), np.arange(size)] = [len(x) for x in sets]
    return common


def block_links(sets: list[np.ndarray], roots: np.ndarray, sides: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Links that span those of all pairs of different roots (and sides) whose sets have this Jaccard similarity or more."""
    able = roots[:, None] != roots
    if sides is not None:
        able &= sides[:, None] != sides
    if not able.any():
        return []
    common, sizes = shared(sets), np.array([len(x) for x in sets])
    return forest(able & (common >= similarity * (sizes[:, None] + sizes - common)))


def _parts() -> Column:
    """Into how many parts a bucket of a table (key, node, n, ..) is cut."""
    return F.greatest(F.ceil(F.count("*") / PART_ROWS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int")


def sketch_pairs(nodes: DataFrame, extra: Column, confirm: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) of rows (node, n, sketch) that share a band and that extra and confirm keep; large groups as in close_pairs.

    Pairs that are still apart in a bucket of more than PAIRED rows don't come out as rows: compare gets the rows of such buckets
    (key, node, root, parts) and gives links that connect the same nodes as those of all pairs.
    """
    table = nodes.select("node", "n", F.explode(F.array(*bands(F.col("sketch")))).alias("key"))
    least = table.groupBy("key").agg(F.min(F.struct("node", "n")).alias("s")).select("key", "s.*")
    pair = [F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")]
    led = scratch.cut(table.alias("l").join(least.alias("r"), "key").where((F.col("l.node") > F.col("r.node")) & extra).select(*pair).distinct())
    # one pair for each node first: in a large group of near copies that leaves few of the others apart
    first = scratch.cut(confirm(led.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")))
    home = components(first)
    of = lambda c: home.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    apart = led.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    stars = scratch.cut(first.unionByName(confirm(apart)).distinct())
    known = table.join(components(stars), "node", "left").select("node", "n", "key", F.coalesce("root", "node").alias("root"))
    # a bucket that is one component has no pair left
    mixed = known.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c"), _parts().alias("parts")).where("x <> y").select("key", "c", "parts")
    known = scratch.cut(known.join(mixed, "key"))
    few = known.where(F.col("c") <= PAIRED)
    found = few.alias("l").join(few.alias("r"), "key").where((F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root")) & extra)
    return stars.unionByName(confirm(found.select(*pair).distinct())).unionByName(compare(known.where(F.col("c") > PAIRED)))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for each row of docs with an integer doc_id: the smallest doc_id of its group of near copies.

    Texts of the same set of word shingles (A-Z in lower case) are copies. Other texts link if the Jaccard similarity of their
    distinct word shingles is `similarity` or more: candidates come from sketches of the shingles and from wide SimHash
    fingerprints by multi-index hashing. Pairs whose sketches agree in a share that lies DEVIATIONS standard deviations below
    `similarity` are ruled out; the similarity of the others is then computed from the 64-bit hashes of all shingles of the
    whole texts. Texts of fewer shingles than could differ and still be so similar only have copies. Texts without words (null
    ones too) are copies of each other. Rows with a null doc_id take no part; repeated rows come out each; an empty table gives
    no rows; other columns are not read.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    each = scratch.cut(_wide(named, shingle))
    nodes = scratch.cut(each.groupBy("c0", "c1").agg(F.min("doc_id").alias("node"), F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    width = BANDS * DEPTH
    agree = max(0, math.floor(width * similarity - DEVIATIONS * math.sqrt(width * similarity * (1 - similarity))))
    sketches = nodes.select("node", "sketch")

    def shingles(ids: DataFrame) -> DataFrame:
        """(doc_id, grams): the hashes of the shingles of each of these texts."""
        small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        texts = named.select("doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        return scratch.cut(texts.mapInArrow(run, "doc_id long, grams array<long>"))

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("s")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("t")), "b")
        same = F.size(F.filter(F.zip_with("s", "t", lambda x, y: x == y), lambda x: x))
        likely = scratch.cut(both.where(same >= agree).select("a", "b"))
        ids = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        own = shingles(ids)
        both = likely.join(own.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))  # row by row in the JVM, so a long text is held once for each task
        return both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")

    def compare(large: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        dealt = large.select("key", "node", "root", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        cells = dealt.select("key", "node", "root", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
        own = shingles(large.select(F.col("node").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "node")
        return scratch.cut(cells.join(own, "node").groupBy("key", "x", "y").applyInArrow(cell, "a long, b long").distinct())

    def cell(key: tuple, rows: pa.Table) -> pa.Table:
        node, root, side = (rows.column(c).to_numpy() for c in ("node", "root", "part"))
        grams = rows.column("grams").combine_chunks()
        flat, offsets = grams.flatten().to_numpy(), np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy())])
        sets = [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        links = np.array(block_links(sets, root, side if key[1] != key[2] else None, similarity), np.int64).reshape(-1, 2)
        ends = node[links]
        return pa.table({"a": ends.min(axis=1), "b": ends.max(axis=1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COMPARED):
                own = batch.slice(at, COMPARED)
                grams = [_shingle_hashes(x[:, 0], shingle).view(np.int64) for x in _word_hashes(own.column(1))]
                offsets = pa.array(np.cumsum([0, *map(len, grams)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(grams)))], ["doc_id", "grams"])

    alike = (F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * similarity)
    least = int(similarity / (1 - similarity)) if similarity < 1 else 1
    search = nodes.where(F.col("n") >= least)
    links = scratch.cut(sketch_pairs(search, alike, confirm, compare))
    homes = components(links).withColumnRenamed("root", "home")
    rest = scratch.cut(search.join(homes, "node", "left").select("node", "f0", "f1", "n", F.coalesce("home", "node").alias("home")))
    roots = components(close_pairs(rest, WIDE["bits"], WIDE["radius"], WIDE["segments"], alike & (F.col("l.home") != F.col("r.home")), confirm, links))
    members = nodes.join(roots, "node", "left").select("c0", "c1", F.coalesce("root", "node").alias("component_id"))
    return each.join(members, ["c0", "c1"]).select("doc_id", "component_id")
