import random

import pytest

from ledgerline.llm import near_dup as nd
from tests.llm import brute

SCHEMA = "doc_id long, text string, component string, a int"


def _rows(spark, docs):
    df = nd.near_duplicates(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA))
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def _corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 30, 120, 400]))
        docs.append(list(base))
        for _ in range(rng.choice([0, 1, 25])):
            copy = list(rng.choice(docs[-3:]))
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(copy)
    texts = [" ".join(x) for x in docs]
    texts += [texts[0].upper(), None, "", " \t\n", "one two", "One  TWO", "one two three", "Été", "été"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def test_matches_brute_force(spark):
    docs = _corpus()
    want = brute.near_dup(docs)
    got = _rows(spark, docs)
    assert {d: x[:2] for d, x in got.items()} == want
    assert all(kept == (d == c) for d, (_, c, kept) in got.items())


def test_empty_table(spark):
    assert _rows(spark, []) == {}
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_keep_one_of_each_returns_input_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (3, None, "z", 3)], SCHEMA)
    kept = nd.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"t{k}" for k in range(200)]
    docs = []
    for d in range(600):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(200)] = f"edit{rng.randrange(10**6)}"
        docs.append((d, " ".join(copy)))
    assert {d: x[:2] for d, x in _rows(spark, docs).items()} == brute.near_dup(docs)


def test_rows_of_one_id_and_of_none(spark):
    text = " ".join(f"t{k}" for k in range(40))
    other = " ".join(f"u{k}" for k in range(40))
    rows = [(5, text), (5, other), (7, text + " more"), (9, other), (None, text), (None, "alone in the world of texts"), (None, None)]
    got = nd.near_duplicates(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, 0, True), (0, 2, 0, True), (0, 36, 5, False), (5, 36, 5, True), (5, 36, 5, True), (7, 37, 5, False), (9, 36, 5, False)
    ]
    docs = spark.createDataFrame([(d, t, "x", k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, kept_id string, row int")
    kept = nd.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["row"] for r in kept.collect()) == [0, 1, 4, 5, 6]


@pytest.mark.parametrize("way", ["prefixes", "blocks"])
def test_a_family_that_is_not_similar(spark, monkeypatch, way):
    """Texts that share 60 % of their shingles, with some links among them, however they are finished."""
    monkeypatch.setattr(nd, "FINISH_PAIRS", 0 if way == "prefixes" else 10**12)
    monkeypatch.setattr(nd, "PAIRS_PER_SHINGLE", 0)
    monkeypatch.setattr(nd, "TURNS", 1)
    made = {}
    if way == "prefixes":
        monkeypatch.setattr(nd, "remaining_pairs", None)  # prefixes make fewer pairs, so blocks are not asked
        pairs = nd.prefix_pairs
        monkeypatch.setattr(nd, "prefix_pairs", lambda *a: made.setdefault("pairs", pairs(*a).cache()))
    rng = random.Random(2)
    shared = [f"s{k}" for k in range(60)]
    docs = [(d, " ".join([*shared, *(f"x{d}y{k}" for k in range(20))])) for d in range(400)]
    for d in range(400, 440):
        words = rng.choice(docs)[1].split()
        words[-1] = f"z{d}"
        docs.append((d, " ".join(words)))
    assert {d: x[:2] for d, x in _rows(spark, docs).items()} == brute.near_dup(docs)
    if made:
        assert made["pairs"].count() < 500  # of 96,000


def test_a_large_family_needs_few_pairs(spark, monkeypatch):
    """1,500 texts that share 60 % of their shingles: a million pairs that are never made."""
    monkeypatch.setattr(nd, "PAIRS_PER_SHINGLE", 0)
    shared = [f"s{k}" for k in range(64)]
    docs = [(d, " ".join([*shared, *(f"x{d}y{k}" for k in range(16))])) for d in range(1500)]
    docs += [(d + 1500, t.replace("y15", "y16")) for d, t in docs[::50]]
    got = _rows(spark, docs)
    assert all(got[d][1] == (d if d < 1500 else d - 1500) for d, _ in docs)
