"""Periodic runs, the conversation trie and token counts against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import periodic, prefix_trie, queries, token_counts

SF = "/root/testdata/sf0.001"
WORDS = token_counts.regex.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# ---- 11 -----------------------------------------------------------------------------------------
def brute_runs(w, least=6, exponent=4):
    found = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, exponent * q) and not any(q % d == 0 and all(w[k] == w[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("block", [3, 1024])
def test_runs_of_small_texts(monkeypatch, block):
    monkeypatch.setattr(periodic, "BLOCK", block)
    r = random.Random(block)
    for _ in range(400):
        given = [[r.randrange(r.choice([1, 2, 3])) for _ in range(r.randint(0, 40))] for _ in range(3)]
        given.append(([r.randrange(4) for _ in range(r.randint(1, 9))] * 12)[: r.randint(5, 80)])
        least, exponent = r.choice([(6, 4), (2, 2), (5, 3)])
        ends = np.cumsum([len(g) for g in given])
        word = np.array([t * 10 + x for t, g in enumerate(given) for x in g], dtype=np.int64)
        last = np.array([z for z, g in zip(ends, given) for _ in g], dtype=np.int64)
        want = sorted((s + int(z) - len(g), n, q) for z, g in zip(ends, given) for s, n, q in brute_runs(g, least, exponent))
        assert sorted(periodic.runs(word, last, least, exponent)) == want


def expected_report(doc_id, text, planted=True):
    w = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


EDGE = [(1, None), (2, ""), (3, " \n\t"), (None, "x " * 9), (4, "ha " * 50), (4, "ha " * 50), (5, "a b c d " * 7 + "e"), (6, "\x1c \x1c \x1c \x1c \x1c \x1c é"), (7, "one " * 5), (8, "a b " * 4 + "c d " * 4), (9, "q " + "é ü é ü é " * 6), (10, "z " * 3000)]


def test_runs_of_texts(spark):
    names = ["n_words", "runs", "kept_text", "start", "run"]
    docs = spark.createDataFrame([(i, t, *names) for i, t in EDGE + [(k, " ".join(random.Random(k).choice("ab") for _ in range(30))) for k in range(100, 160)]], ["doc_id", "text", *names])
    for planted in (False, True):
        given = periodic.with_planted_runs(docs) if planted else docs
        got = periodic.digests(periodic.periodic_runs(given)).collect()
        want = [expected_report(r.doc_id, r.text, planted) for r in docs.collect()]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    full = periodic.periodic_runs(docs.limit(7), carry=("start",))
    assert full.columns == ["doc_id", "start", "n_words", "runs", "kept_text"] and full.count() == 7
    assert periodic.digests(periodic.periodic_runs(docs.limit(0))).count() == 0


def test_runs_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 4000").collect()
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert all(got[r.doc_id] == expected_report(r.doc_id, r.text) for r in docs)


# ---- 12 -----------------------------------------------------------------------------------------
def brute_trie(rows, rebuilt):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    seq = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        seq[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in sorted(seq):
        for d in range(len(seq[c]) + 1):
            members[tuple(seq[c][:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += kids[k] == 0
    ends = {k: ",".join(str(c) for c in m if len(seq[c]) == len(k)) for k, m in members.items()}
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()), key=str)


def as_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.select(names).collect()), key=str)


@pytest.fixture(scope="module")
def talks():
    r = random.Random(3)
    rows = [(c if r.random() > 0.01 else None, None if r.random() < 0.1 else r.randrange(9), r.choice(["u", "a", None]), r.choice(["x", "yy", "é", None, ""])) for c in [*range(60), 100, 101, 7, 7, 205, 3000] for _ in range(r.choice([1, 2, 3, 6, 25]))]
    long = [(c, i, "u", "x" if i < n else "y") for c, n in ((500, 70), (501, 50), (502, 64)) for i in range(70)]
    return [*rows, *long, *[(503, 3, "u", "x")] * 40]


@pytest.mark.parametrize("local", [4, 256])
def test_trie_of_conversations(spark, monkeypatch, talks, local):
    monkeypatch.setattr(prefix_trie, "LOCAL", local)  # sequences of 70 turns are cut in blocks, more than once
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    df = spark.createDataFrame([(*t, "other") for t in talks], "conv_id long, turn long, role string, text string, name string")
    turns = prefix_trie.ordered_turns(df)
    assert as_rows(prefix_trie.prefix_trie(turns)) == brute_trie(talks, False)
    if local > 4:
        assert as_rows(prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns))) == brute_trie(talks, True)
        assert prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.ordered_turns(df.limit(0)))).count() == 0


def test_names_of_equal_prefixes_are_equal():
    r = random.Random(1)
    for height in (4, 8, 32):
        a = [bytes([r.randrange(3)]) for _ in range(height)]
        for n in range(1, height + 1):
            assert prefix_trie._names(b"t", a[:n], height, None) == prefix_trie._names(b"t", a, height, None)[:n]
        b = [*a[:2], b"other", *a[3:]]
        both = zip(prefix_trie._names(b"t", a, height, None), prefix_trie._names(b"t", b, height, None))
        assert [x == y for x, y in both] == [True, True, *[False] * (height - 2)]


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(queries.op12_prefix_trie(spark, SF)) == brute_trie(rows, True)


# ---- 13 -----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_whole_tokens_are_one_token(library):
    whole = sorted(token_counts.whole_tokens(VOCABULARY))
    assert len(whole) > 30_000
    plain = [w for w in whole if library.normalizer.normalize_str(w) == w and len(library.pre_tokenizer.pre_tokenize_str(w)) == 1]
    assert len(plain) > 30_000 and all(len(e.ids) == 1 for e in library.encode_batch(plain, add_special_tokens=False))


def test_counts_equal_the_library(spark, library):
    r = random.Random(1)
    signs = "aAbé'stmdlvre19²½ _-<|>. \x1c\x85́ͅΣİ\U0001fae8՘中﻿\U00011de0"
    texts = [None, "", "   ", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|><|endoftext|>", "it's they'LL 12³½", "x" * 5000, "aé" * 300, "'" * 10 + "s", "Å K ſ ß ẞ ΑΣ Σ", "\x1d x\x1ey", "word " * 2100]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    docs = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)] + [(None, "hello", None), (3, "again", "x")], "doc_id long, text string, n_tokens string")
    got = token_counts.token_counts(docs, VOCABULARY).collect()
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in given]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    assert token_counts.token_counts(docs.limit(0), VOCABULARY).count() == 0


def test_counts_with_little_memory(monkeypatch, library):
    monkeypatch.setattr(token_counts, "KEPT", 5)
    r = random.Random(2)
    counter = token_counts.Counter(VOCABULARY, token_counts.whole_tokens(VOCABULARY))
    for _ in range(50):
        text = " ".join("".join(r.choice("abcdezqé") for _ in range(r.choice([1, 3, 9, 80]))) for _ in range(20))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(counter) <= 5 and len(counter.older) <= 5 and len(counter.merged) <= 5


def test_counts_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_token_counts(spark, SF).collect()
    assert len(got) == len(texts) and all(r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in got)
