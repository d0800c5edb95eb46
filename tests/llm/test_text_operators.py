"""Line rules, mixing, token shards and repeated substrings against plain Python, with the odd cases."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import mixing, quality_rules, substring_dup, token_shards
from ledgerline.llm.textbatch import Words, text_buffers
from ledgerline.llm.textstats import Lines, phrase_pattern
from tests.llm.brute import WORD

DOCS = "doc_id long, text string, source string, size int, part string"


def _docs(spark, rows, source=None):
    return spark.createDataFrame([(d, t, source(d) if source else "s", 0, "x") for d, t in rows], DOCS)


ODD = [None, "", " \t\n", "word", "\n\n", "é\xa0ü", "a\x00b", "x " * 60, "\x0b\x0c", "tab\tand\r\nline", "emoji 😀 end", "no space"]


# ---- grammars


def test_copies_of_a_text_need_few_codes():
    seq = np.tile(np.random.default_rng(1).integers(1, 50_000, 500), 1000).astype(np.uint16)
    codes, rules, lengths = token_shards.re_pair(seq)
    assert len(codes) < 2000 and lengths.max() > 500
    assert (token_shards.Grammar(rules, lengths).decode(codes) == seq).all()


# ---- line rules


def _rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = {}
    for k in range(len(w) - 2):
        windows.setdefault(tuple(w[k : k + 3]), []).append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_dup = sum(x in lines[:k] for k, x in enumerate(lines))
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), n_dup, len(repeated), failed


def test_counts_match_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["a", "bb", "the", "#tag", "x|y", "éé", "<b>", "end.", "100%"]
    texts = ODD + ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.choice([2, 20, 80, 300]))) for _ in range(60)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in quality_rules.line_rules(_docs(spark, rows + [(0, None)])).collect()}
    assert {d: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for d, r in got.items()} == {d: _rules(t) for d, t in rows}
    assert all(r.kept == (not r.base_failed and 100 * r.n_words_removed <= 50 * r.n_words) for r in got.values())


def test_line_verdicts(spark):
    told = lambda name: "\n".join(" ".join(f"{name}{k}x{j}" for j in range(12)) + "." for k in range(8))
    prose = told("word")
    texts = {
        1: prose, 2: prose + "\nHome\nAbout us\nRead more » | | |", 3: "\n".join(f"Home{k} | About{k} | Item{k} | »" for k in range(40)),
        4: prose + "\nAccept cookies to go on.\n" + told("remark"), 5: "\n".join(f"$$$ win{k} ###{k} now{k} !!! ***" for k in range(30)),
    }
    got = {r.doc_id: r for r in quality_rules.line_rules(_docs(spark, list(texts.items()))).collect()}
    assert {d: r.kept for d, r in got.items()} == {1: True, 2: True, 3: False, 4: True, 5: False}
    assert got[2].text == prose and got[2].n_lines_removed == 3
    assert "cookies" not in got[4].text and got[4].n_lines_removed == 1
    assert quality_rules.line_rules(_docs(spark, [])).collect() == []


@pytest.mark.parametrize("line", ["Mentions LÉGALES ici", "tous droits réservés.", "Política de Privacidad", "Zum Inhalt springen", "Datenschutzerklärung lesen", "All Rights Reserved 2020", "CONDITIONS D'UTILISATION"])
def test_boilerplate_of_several_languages(line):
    data = f"{line}\nan ordinary line".encode()
    lines = Lines(Words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)])))
    assert lines.boilerplate().tolist() == [True, False]
    assert duckdb.connect().execute(f"SELECT regexp_matches('{line.replace(chr(39), chr(39) * 2)}', '(?i){phrase_pattern().replace(chr(39), chr(39) * 2)}')").fetchall() == [(True,)]


# ---- mixing


def _fill(sizes, weights, epochs=3):
    """Targets by plain water-filling: clamp what is above its cap, share the rest again."""
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = {s: weights[s] for s in sizes if s not in capped}
        level = (total - sum(capped.values())) / sum(open_.values()) if open_ else 0
        over = {s: epochs * sizes[s] for s in open_ if epochs * sizes[s] < level * weights[s]}
        if not over:
            return capped | {s: min(level * w, epochs * sizes[s]) for s, w in open_.items()}
        capped |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(1)
    names = ["b", "a", None, "ä", "Z", ""]
    source = lambda d: names[d % 23 % 6]
    rows = [(d, " ".join("w" * rng.choice([0, 1, 5, 40]))) for d in range(900)] + [(900 + k, t) for k, t in enumerate(ODD)]
    got = mixing.mix(_docs(spark, rows, source)).collect()
    assert sorted(r.doc_id for r in got) == [d for d, _ in rows]
    ranked = sorted({source(d) for d, _ in rows}, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(ranked)}
    sizes = {s: sum(len(WORD.findall(t or "")) for d, t in rows if source(d) == s) for s in ranked}
    targets = _fill(sizes, weights)
    taken = dict.fromkeys(ranked, 0)
    for r in got:
        assert r.source == source(r.doc_id) and r.size == len(WORD.findall(dict(rows)[r.doc_id] or ""))
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.size * r.times and 0 <= r.times <= 3
        taken[r.source] += r.taken
    for s in ranked:
        assert abs(taken[s] - targets[s]) <= 40
    again = mixing.mix(_docs(spark, rows[::-1], source).repartition(3)).collect()
    assert sorted((r.doc_id, r.times) for r in again) == sorted((r.doc_id, r.times) for r in got)


def test_mix_of_little(spark):
    assert mixing.mix(_docs(spark, [])).collect() == []
    assert [(r.target, r.taken) for r in mixing.mix(_docs(spark, [(1, None), (2, "")])).collect()] == [(0.0, 0), (0.0, 0)]
    one = mixing.mix(_docs(spark, [(1, "a b c")])).collect()
    assert [(r.target, r.taken, r.times) for r in one] == [(3.0, 3, 1)]
    repeated = _docs(spark, [(7, "a b"), (7, "c d e")])
    assert sorted(r.taken for r in mixing.mix(repeated).collect()) == [2, 3]


def test_mixed_documents_repeat_rows(spark):
    rows = [(d, "w " * (50 if d % 10 else 5)) for d in range(200)]
    docs = _docs(spark, rows, lambda d: "small" if d % 10 == 0 else "large")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = {r.doc_id: r.times for r in mixing.mix(docs).collect()}
    counts: dict[int, int] = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {d: n for d, n in times.items() if n}


def test_mix_cuts_finer_ranges_to_the_same_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_DOCS", 4)
    monkeypatch.setattr(mixing, "LEVEL_BITS", 3)
    rows = [(d, "w " * (d % 37)) for d in range(700)]
    got = mixing.mix(_docs(spark, rows, lambda d: "abc"[d % 7 % 3])).collect()
    assert sorted(r.doc_id for r in got) == list(range(700))
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 20 and max(r.times for r in own) - min(r.times for r in own) <= 1


def test_mixed_rows_of_repeated_and_null_ids(spark):
    columns = "doc_id long, text string, source string, _time int, _times int, name string, place long, row string, extra long, low long"
    rows = [(7, "a b", "s"), (7, "c d e", "s"), (7, "a b", "s"), (None, "x y", "s"), (None, None, None), (8, "", "s")] + [(d, "w " * 40, "t") for d in range(100, 130)]
    docs = spark.createDataFrame([(*r, k, -k, "n", 5, "r", 1, 0) for k, r in enumerate(rows)], columns)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts: dict[int, int] = {}
    for r in mixed.collect():
        assert (r.doc_id, r.text, r.source) == rows[r._time] and r._times == -r._time
        counts[r._time] = counts.get(r._time, 0) + 1
    times = sorted((r.doc_id is None, r.doc_id or 0, r.size, r.times) for r in mixing.mix(docs).collect() if r.times)
    assert times == sorted((rows[k][0] is None, rows[k][0] or 0, len((rows[k][1] or "").split()), n) for k, n in counts.items())
    assert all(n <= 3 for n in counts.values()) and {k for k in counts if k < 4} == {0, 1, 2, 3}


def test_empty_documents_get_no_fourth_copy(spark):
    rows = [(d, "w w" if d < 4 else "") for d in range(40)] + [(d, "w " * 500) for d in range(100, 110)]
    got = mixing.mix(_docs(spark, rows, lambda d: "a" if d < 40 else "b")).collect()
    assert max(r.times for r in got) == 3


# ---- token shards


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_shards.default_tokenizer())


def test_units_encode_as_whole_texts_do(tokenizer):
    rng = random.Random(3)
    pieces = ["word", " ", "  ", "\n", "\t", "é", "日本", "don't", "'s", "😀", "\xa0", "12", "...", "Ω", " ", "á", "\x00", "!", "ſ", "'", "_", ".", ",", '"', "Word", "\n\n", "?!"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(pieces, k=rng.choice([1, 4, 30]))) for _ in range(600)]
    encoder = token_shards.Encoder(token_shards.default_tokenizer())
    ids, sizes = encoder.encode(*text_buffers(pa.array(texts)))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_shards_round_trip(spark, tokenizer, monkeypatch):
    rng = random.Random(6)
    rows = [(d * 7, " ".join(rng.choices(["the", "cat", "sat", "on", "mats,", "é"], k=rng.choice([0, 3, 200])))) for d in range(120)]
    rows += [(10_000 + k, t) for k, t in enumerate(ODD)]
    rng.shuffle(rows)
    shards = token_shards.write_shards(_docs(spark, rows))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_shards.read_documents(shards).collect()}
    start, want, whole = 0, {}, {}
    for d, t in sorted(rows):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[d], whole[d] = (start, len(ids), zlib.crc32(ids.tobytes())), ids
        start += len(ids)
    assert got == want
    for shard in shards.collect():
        shard = shard.asDict()
        flat = np.concatenate([whole[d] for d in shard["doc_ids"]])
        for low, n in ((0, 1), (0, len(flat)), (len(flat) // 2, 17), (len(flat) - 1, 1), (5, 0)):
            assert token_shards.decode_range(shard, low, n).tolist() == flat[low : low + n].tolist()


def test_re_pair_compresses_and_expands():
    rng = np.random.default_rng(1)
    for seq in (rng.integers(0, 50, 0), np.zeros(1), np.zeros(5000), np.tile(rng.integers(0, 60_000, 40), 300), rng.integers(0, 65_536, 3000), np.array([7, 7, 7] * 50)):
        codes, rules, lengths = token_shards.re_pair(seq.astype(np.uint16))
        grammar = token_shards.Grammar(rules, lengths)
        assert grammar.decode(codes).tolist() == seq.tolist()
        assert int(grammar.sizes(codes).sum()) == len(seq)
        if len(rules):
            assert len(codes) < len(seq) and (rules < token_shards.FIRST_RULE + np.arange(len(rules))[:, None]).all()


def test_units_of_one_hash_are_told_apart(tokenizer, monkeypatch):
    monkeypatch.setattr(token_shards, "span_hash", lambda data, start, end: np.full(len(start), 9, dtype=np.uint64))
    texts = ["one two one", "two three", "", "three one four"]
    ids, sizes = token_shards.Encoder(token_shards.default_tokenizer()).encode(*text_buffers(pa.array(texts)))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert (sizes.tolist(), ids.tolist()) == ([len(x) for x in want], [i for x in want for i in x])


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = token_shards.default_tokenizer().replace("byte_bpe_50k", "word_bpe_49k")
    texts = [t or "" for t in ODD] + ["Lower-Case, it's two  words\nand more.", "A", "B"]
    ids, sizes = token_shards.Encoder(path).encode(*text_buffers(pa.array(texts)))
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert (sizes.tolist(), ids.tolist()) == ([len(x) for x in want], [i for x in want for i in x])


def test_null_and_repeated_ids_keep_their_entries(spark):
    shards = token_shards.write_shards(_docs(spark, [(2, "b"), (None, "a"), (2, "c"), (1, None)]), part_bytes=1)
    rows = sorted(token_shards.read_documents(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2] and [r.start for r in rows] == [0, 2, 3, 5] and sum(r.n_tokens for r in rows) == 7


def test_no_documents_no_shards(spark):
    shards = token_shards.write_shards(_docs(spark, []))
    assert shards.count() == 0 and token_shards.read_documents(shards).collect() == []


# ---- repeated substrings


def _repeats(rows, k=13):
    words = {d: WORD.findall(t or "") for d, t in rows}
    least: dict[tuple, int] = {}
    for d in sorted(words):
        for j in range(len(words[d]) - k + 1):
            least.setdefault(tuple(words[d][j : j + k]), d)
    out = {}
    for d, w in words.items():
        gone = {j + x for j in range(len(w) - k + 1) if least[tuple(w[j : j + k])] < d for x in range(k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def _passages(rng):
    passages = [rng.choices([f"w{k}" for k in range(50)], k=n) for n in (12, 13, 14, 40, 90)]
    rows = [(900 + k, t) for k, t in enumerate(ODD)]
    for d in rng.sample(range(500), 70):
        text = []
        for _ in range(rng.randint(1, 3)):
            text += rng.choices([f"v{k}" for k in range(30)], k=rng.choice([0, 5, 20]))
            passage = rng.choice(passages)
            low = rng.choice([0, 0, 3, 20])
            text += passage[low : low + rng.choice([100, 25, 60])]
        rows.append((d, rng.choice([" ", "\n", "  "]).join(text)))
    return rows + [(d, "x " * 30) for d in (601, 600)] + [(-5, " ".join(passages[3])), (700, "y " * 40)]


def _small_tasks(monkeypatch):
    for name, size in (("ANCHOR_BYTES", 4000), ("BUCKET_BYTES", 2000), ("PART_BYTES", 900), ("COMPARED_BYTES", 2000)):
        monkeypatch.setattr(substring_dup, name, size)


@pytest.mark.parametrize("small", [False, True])
def test_spans_match_brute_force(spark, monkeypatch, small):
    if small:
        _small_tasks(monkeypatch)
    rows = _passages(random.Random(9))
    got = {r.doc_id: r for r in substring_dup.repeated_spans(_docs(spark, rows)).collect()}
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in got.items()} == _repeats(rows)
    assert all(sum(b - a for a, b in zip(r.starts, r.ends)) == r.n_removed for r in got.values())
    assert got[700].n_removed == 0  # repeats inside one document stay


def test_windows_of_other_words_stay(spark, monkeypatch):
    """With ten bits of a hash, edges of other words meet: the comparison keeps them."""
    _small_tasks(monkeypatch)
    rows = _passages(random.Random(4))
    want = _repeats(rows)
    got = {r.doc_id: r for r in substring_dup.repeated_spans(_docs(spark, rows), bits=10).collect()}
    assert set(got) == set(want) and all(0 <= r.n_removed <= want[d][1] and r.n_words == want[d][0] for d, r in got.items())
    texts = dict(rows)
    for d, r in got.items():
        gone = {k for a, b in zip(r.starts, r.ends) for k in range(a, b)}
        kept = " ".join(w for k, w in enumerate(WORD.findall(texts[d] or "")) if k not in gone)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert sum(r.n_removed for r in got.values()) < sum(x[1] for x in want.values())


def test_rows_of_one_id_and_of_none(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, passage), (1, passage), (1, f"x {passage} y"), (2, f"{passage} z"), (None, passage), (None, f"q {passage}"), (3, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dup.repeated_spans(_docs(spark, rows)).collect())
    assert got == [(False, 1, 20, 0), (False, 1, 20, 0), (False, 1, 22, 0), (False, 2, 21, 20), (False, 3, 0, 0), (True, 0, 20, 0), (True, 0, 21, 0)]
    assert substring_dup.repeated_spans(_docs(spark, [])).collect() == []


def _edges(rows, k=4):
    """{edge of words: smallest (document, place)} of the edges that several documents have."""
    places: dict[tuple, list] = {}
    for d, t in rows:
        w = WORD.findall(t)
        for j in range(len(w) - k + 1):
            places.setdefault(tuple(w[j : j + k]), []).append((d, j))
    return {e: min(x) for e, x in places.items() if len({d for d, _ in x}) > 1}


def test_paths_are_the_graphs(spark, monkeypatch):
    _small_tasks(monkeypatch)
    text = {1: "a b c d e f g h", 2: "c d e f g h i j k l m", 3: "z i j k l m n", 4: "h i j k l m n o", 5: "a b c d e f Q R", 6: "e f g h i j x f g h i j", 7: "s t u v s t u v s t", 8: "t u v s t u v s t u"}
    rows = list(text.items())
    owned, words = _edges(rows), {d: t.split() for d, t in rows}
    spans = substring_dup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), k=4)
    pieces = substring_dup.paths(spans).collect()
    edge_of = lambda p, j: tuple(words[p.doc_id][p.start + j : p.start + j + 4])
    assert sorted(edge_of(p, j) for p in pieces for j in range(p.n)) == sorted(owned)
    leave, enter = collections.Counter(e[:3] for e in owned), collections.Counter(e[1:] for e in owned)
    through = lambda v: leave[v] == enter[v] == 1
    joined: dict[int, list] = {}
    for p in sorted(pieces, key=lambda p: p.offset):
        joined.setdefault(p.path, []).extend((p.offset + j, edge_of(p, j)) for j in range(p.n))
    ends = 0
    for path in joined.values():
        edges = [e for _, e in path]
        if [n for n, _ in path] == list(range(len(path))):  # not a circle of several pieces
            assert all(a[1:] == b[:3] and through(b[:3]) for a, b in zip(edges, edges[1:]))
            ends += (not through(edges[0][:3]) or edges[0][:3] == edges[-1][1:]) and (not through(edges[-1][1:]) or edges[0][:3] == edges[-1][1:])
        else:
            ends += all(through(e[:3]) for e in edges)
    assert ends == len(joined) < len(owned)
