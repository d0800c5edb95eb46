"""Texts built so that linear hashes meet: every operator that compares by hash must tell them apart."""

import zlib

import numpy as np
import pytest

from ledgerline.llm import near_dup, quality_rules, substring_dup, token_shards
from ledgerline.llm.textbatch import Words
from tests.llm import brute

DOCS = "doc_id long, text string"


def _built(size):
    """A word of a and b, and its complement, whose letters have equal sums of powers of any odd base modulo 2**64."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1024, 4096])
def test_built_words_are_told_apart(spark, size):
    from tokenizers import Tokenizer

    a, b = _built(size)
    rows = [(1, f"{a} " * 30), (2, f"{b} " * 30), (3, f"x {a} y {b}\n" * 2), (4, f"x {b} y {a}\n" * 2)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute.near_dup(rows)
    removed = {r.doc_id: r.n_removed for r in substring_dup.repeated_spans(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 0, 4: 0}
    lines = [(1, f"{a}\n{b}"), (2, f"{a}\n{a}")]
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.line_rules(spark.createDataFrame(lines, DOCS)).collect()} == {1: 0, 2: 1}
    tokenizer = Tokenizer.from_file(token_shards.default_tokenizer())
    sums = {r.doc_id: r.ids_crc32 for r in token_shards.read_documents(token_shards.write_shards(docs)).collect()}
    assert sums == {d: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()) for d, t in rows}


def test_hashes_of_words_and_windows_are_those_of_their_bytes():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("ab"), n)) for n in (1, 7, 8, 9, 16, 17, 63, 64, 65, 200) for _ in range(30)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(60)]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    found = Words(np.frombuffer(data, dtype=np.uint8), offsets)
    split = [t.split() for t in texts]
    flat = [w for x in split for w in x]
    assert len(set(found.hash.tolist())) == len(set(flat)) == len(set(zip(flat, found.hash.tolist())))
    for size in (1, 3, 5, 13):
        want = [tuple(x[k : k + size]) for x in split for k in range(len(x) - size + 1)]
        _, got = found.windows(size)
        assert len(set(got.tolist())) == len(set(want)) == len(set(zip(want, got.tolist())))
    doc, got = found.shingles(5)
    assert np.bincount(doc).tolist() == [len({tuple(x[k : k + 5]) for k in range(36)}) for x in split]
