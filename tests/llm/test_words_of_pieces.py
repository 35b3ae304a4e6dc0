"""Byte-level BPE: pieces are put together from words, and each word meets the merge table once."""

import numpy as np
import public_tokenizers as p
import pyarrow as pa
import pytest

from tessera.llm import bpe

TEXTS = ["(zqxvkj) zqxvkj, zqxvkj. the the", None, "", "the", "  ", "a  ", "\u3000\u3000b zqxvkj\n\n x\t", "\u2003zqxvkj's 12345 \U0001f600", " ", "x\u00a0", "\u00e9t\u00e9 zqxvkj;"]


@pytest.mark.parametrize("portion", [8, 1 << 21])
def test_each_word_is_merged_once(monkeypatch, portion):
    monkeypatch.setattr(bpe, "PORTION", portion)
    with bpe.Tokenizer(p.path("byte_bpe_50k.tiktoken"), p.PATTERN) as tok:
        merged, plain = [], tok._encoded
        monkeypatch.setattr(tok, "_encoded", lambda words: merged.extend(words) or plain(words))
        got = [(i, d) for _, _, ids, texts in tok.encode(pa.array(TEXTS)) for i, d in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
        of = {t: i for i, t in tok.token.items()}
        alone = {w: [of[w.encode()]] if w.encode() in of else tok._long(w.encode()) for t in TEXTS for w in tok.words(t or "")}
    assert [list(np.frombuffer(i, "<u4")) for i, _ in got] == [[k for w in tok.words(t or "") for k in alone[w]] for t in TEXTS]
    assert [d.decode() for _, d in got] == [t or "" for t in TEXTS]
    assert len(merged) == len(set(merged)) and b" zqxvkj" in merged and not of.keys() & set(merged)


def test_patterns_that_leave_characters_out():
    with bpe.Tokenizer(p.path("byte_bpe_50k.tiktoken"), r"\p{L}+") as tok:
        found = [d for *_, texts in tok.encode(pa.array(["zq the, zq", "12 3", " a"])) for d in texts.to_pylist()]
    assert found == [b"zqthezq", b"", b"a"]
