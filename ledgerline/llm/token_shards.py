"""Token ids in Re-Pair compressed shards (operator 7).

Documents are range-partitioned by id, so a shard holds a run of consecutive
documents. Each shard's id sequence is compressed by Re-Pair: in rounds, the most
frequent pairs of neighbouring symbols are replaced by nonterminals, left to right.

The file format is a Parquet table of shards, one row each:

====================  =========================================================
part, shard           order of the shards (range partition, number within it)
doc_ids, doc_tokens   the shard's documents and their numbers of ids, in order
n_tokens              ids in the shard
rules                 pairs of symbols; rule k makes symbol FIRST_RULE + k
lengths               ids that each rule expands to
low, high             the code sequence: 16 low bits and 8 high bits of each symbol
marks                 ids before every 1,024th code, for random access
====================  =========================================================
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import bound_batches, materialize, table
from ledgerline.llm.textbatch import chunks, heads, span_hash

END_ID = 0
#: Symbols from here on are nonterminals; above every id of a byte-level vocabulary.
FIRST_RULE = 1 << 16
SHARD_TOKENS = 1 << 20
#: Times that a pair must occur to be replaced: a rule takes twelve bytes and saves three a
#: use. A shard of 983,065 ids takes 1.73 MB at 12, and 1.76, 1.87, 2.05, 2.81 at 6, 4, 3, 2.
LEAST_COUNT = 12
MARK_EVERY = 1024
#: Text bytes of a range of documents, which one task encodes shard by shard.
PART_BYTES = 16 << 20
#: Encoded units that a worker remembers, and units handed to the tokenizer at once.
CACHE_UNITS, CACHE_BYTES, LEARN_UNITS = 1_000_000, 64 << 20, 2048
_TABLE_BITS = 18
_SLOTS = 1 << 22

SHARDS = (
    "part int, shard int, doc_ids array<long>, doc_tokens array<long>, n_tokens long, "
    "rules array<int>, lengths array<int>, low binary, high binary, marks array<long>"
)


def default_tokenizer() -> str:
    """Path of the byte-level vocabulary that the installed collection describes."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Exact ids of whole texts by a tokenizer, with units of text encoded once.

    Byte-level pre-tokens never span the place before a space that a letter or other
    printable character follows, nor those between a letter and closing punctuation or a
    line feed, nor around a single line feed before a letter. A text's ids are those of
    the units between such places; units repeat, so most are already known. They are
    looked up by hash and compared byte by byte. Any other pre-tokenizer has whole texts
    as its units.
    """

    def __init__(self, path: str):
        # tasks are Spark's parallelism: one thread each
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._cuts = _cuts_bytes(json.loads(self._tokenizer.to_str()))
        self._clear()

    def _clear(self) -> None:
        # open addressing: a unit's hash, and its number, in the first free slot from the hash on
        self._hash, self._number = np.zeros(_SLOTS, dtype=np.uint64), np.zeros(_SLOTS, dtype=np.int32)
        # of each unit: its bytes and its ids, as places in the two stores, and its first eight bytes
        self._head = np.zeros(0, dtype=np.uint64)
        self._raw_at, self._length, self._raw = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
        self._at, self._size, self._ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint16)

    def _learn(self, units: list[bytes]) -> np.ndarray:
        """The numbers of new units."""
        parts, sizes = [], []
        for low in range(0, len(units), LEARN_UNITS):
            texts = [u.decode() for u in units[low : low + LEARN_UNITS]]
            found = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes += map(len, found)
            parts.append(np.array([i for x in found for i in x], dtype=np.int64))
        ids, size = np.concatenate(parts), np.array(sizes, dtype=np.int64)
        if len(ids) and ids.max() >= FIRST_RULE:
            raise ValueError(f"ids must be below {FIRST_RULE}")
        number = len(self._at) + np.arange(len(size))
        length, raw = np.array([len(u) for u in units], dtype=np.int64), np.frombuffer(b"".join(units), dtype=np.uint8)
        first = np.cumsum(length) - length
        self._head = np.concatenate((self._head, heads(raw, first, length)))
        self._raw_at = np.concatenate((self._raw_at, len(self._raw) + first))
        self._length, self._raw = np.concatenate((self._length, length)), np.concatenate((self._raw, raw))
        self._at = np.concatenate((self._at, len(self._ids) + np.cumsum(size) - size))
        self._size, self._ids = np.concatenate((self._size, size)), np.concatenate((self._ids, ids.astype(np.uint16)))
        return number

    def _keep(self, hashes: np.ndarray, number: np.ndarray) -> None:
        """Make units found by these hashes."""
        slot = (hashes % _SLOTS).astype(np.int64)
        while len(hashes):
            first = np.unique(slot, return_index=True)[1]
            first = first[self._hash[slot[first]] == 0]
            self._hash[slot[first]], self._number[slot[first]] = hashes[first], number[first]
            rest = np.ones(len(hashes), dtype=bool)
            rest[first] = False
            hashes, number, slot = hashes[rest], number[rest], (slot[rest] + 1) % _SLOTS

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of units by hash; -1 if unknown."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        at, slot = np.arange(len(hashes)), (hashes % _SLOTS).astype(np.int64)
        while len(at):
            held = self._hash[slot]
            hit = held == hashes[at]
            out[at[hit]] = self._number[slot[hit]]
            on = np.flatnonzero(~hit & (held != 0))
            at, slot = at[on], (slot[on] + 1) % _SLOTS
        return out

    def _differ(self, data: np.ndarray, start: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which of the units that make up ``data`` are not those of their numbers."""
        size = np.diff(np.append(start, len(data)))
        out = (self._length[number] != size) | (self._head[number] != heads(data, start, size))
        long = np.flatnonzero(~out & (size > 8))
        if len(long):
            n = size[long]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            bad = self._raw[np.repeat(self._raw_at[number[long]], n) + step] != data[np.repeat(start[long], n) + step]
            out[long] = np.logical_or.reduceat(bad, np.cumsum(n) - n)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), from UTF-8 bytes and the texts' offsets."""
        if len(self._at) > CACHE_UNITS or len(self._raw) > CACHE_BYTES:
            self._clear()
        if not len(data):
            return self._ids[:0], np.zeros(len(offsets) - 1, dtype=np.int64)
        cut = np.zeros(len(data), dtype=bool)
        begins = offsets[:-1][offsets[:-1] < len(data)]
        if self._cuts:
            before, after = data[:-1], data[1:]
            cut[:-1] = (before == 32) & _VISIBLE[after]
            cut[begins[1:] - 1] = False  # the next text is not what follows
            letter = _LETTER[before]
            letter[1:] |= (data[:-2] == 0xC3) & _ACCENTED[before[1:]]
            cut[1:] |= letter & _CLOSING[after]
            cut[2:] |= _SOLID[data[:-2]] & (data[1:-1] == 10) & _LETTER[data[2:]]
        cut[begins] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        hashes = np.maximum(span_hash(data, start, end), np.uint64(1))
        number = self._find(hashes)
        raw = data.tobytes()
        bytes_of = lambda units: [raw[a:b] for a, b in zip(start[units].tolist(), end[units].tolist(), strict=True)]
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            self._keep(fresh, self._learn(bytes_of(new[first])))
            number[new] = self._find(hashes[new])
        clash = np.flatnonzero(self._differ(data, start, number))
        if len(clash):  # another unit has this hash: encoded each time
            number[clash] = self._learn(bytes_of(clash))
        sizes = self._size[number]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = self._ids[np.repeat(self._at[number] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(start, offsets)])


def _cuts_bytes(tokenizer: dict) -> bool:
    """Whether a tokenizer splits texts as the byte-level pattern does, with no step before."""
    split = tokenizer.get("pre_tokenizer") or {}
    plain = not tokenizer.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokenizer.get("added_tokens", ()))
    special = all(t["content"].startswith("<|") and t["content"].endswith("|>") for t in tokenizer.get("added_tokens", ()))
    return plain and special and split.get("type") == "ByteLevel" and bool(split.get("use_regex")) and not split.get("add_prefix_space")


def _bytes(*runs: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in runs:
        out[low : high + 1] = True
    return out


#: First bytes of visible characters up to U+03FF; visible ASCII; ASCII letters; second
#: bytes of the letters of Latin-1.
_VISIBLE, _SOLID, _LETTER = _bytes((0x21, 0x7E), (0xC3, 0xCF)), _bytes((0x21, 0x7E)), _bytes((65, 90), (97, 122))
_ACCENTED = _bytes((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))
#: Line feeds and ASCII punctuation, but for apostrophes, and what stands after a letter in special tokens.
_CLOSING = _bytes((10, 10), *((ord(c), ord(c)) for c in "!\"#$%&()*+,-./:;<=?@[\\]^_`{}~"))
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """This process's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def re_pair(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, rules, expansion lengths) of a sequence of ids below FIRST_RULE.

    Each round leaves out pairs whose slot of a hashed table shows that they are too few,
    counts the others exactly, gives each that occurs LEAST_COUNT times a nonterminal (the
    most frequent first, ties by the pair itself) and replaces them, until none is left.
    """
    seq = seq.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.zeros(0, dtype=np.int64)
    while len(seq) > 1:
        slot = ((seq[:-1] * np.uint32(0x9E3779B1)) ^ (seq[1:] * np.uint32(0x85EBCA77))) >> np.uint32(32 - _TABLE_BITS)
        counts = np.bincount(slot, minlength=1 << _TABLE_BITS)
        at = np.flatnonzero((counts >= LEAST_COUNT)[slot])
        pair = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        found, which, n = np.unique(pair, return_inverse=True, return_counts=True)
        best = np.lexsort((found, -n))
        best = best[n[best] >= LEAST_COUNT]
        if not len(best):
            break
        rank = np.full(len(found), -1, dtype=np.int64)
        rank[best] = np.arange(len(best))
        hit = rank[which] >= 0
        at, symbol = at[hit], rank[which][hit]
        # of overlapping places, take the first, third, ... of each run
        place = np.arange(len(at))
        begins = np.append(True, np.diff(at) != 1)
        taken = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
        at, symbol = at[taken], symbol[taken]
        base = sum(map(len, rules))
        made = np.stack(((found[best] >> np.uint64(32)).astype(np.int64), (found[best] & np.uint64(0xFFFFFFFF)).astype(np.int64)), axis=1)
        size = np.ones(made.shape, dtype=np.int64)
        inner = made >= FIRST_RULE
        size[inner] = lengths[made[inner] - FIRST_RULE]
        lengths = np.concatenate((lengths, size.sum(axis=1)))
        rules.append(made)
        seq[at] = (FIRST_RULE + base + symbol).astype(np.uint32)
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq = seq[keep]
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64), lengths


class Grammar:
    """A shard's rules, expanded once; decodes any range of ids."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray):
        self._size = lengths
        self._at = np.cumsum(lengths) - lengths
        self._ids = np.zeros(int(lengths.sum()), dtype=np.uint32)
        low = 0
        while low < len(rules):  # rules only refer to earlier ones: expand runs that need none of their own
            inner = np.flatnonzero((rules[low:] >= FIRST_RULE + low).any(axis=1))
            high = low + (int(inner[0]) if len(inner) else len(rules) - low)
            self._ids[self._at[low] : self._at[high - 1] + lengths[high - 1]] = self.decode(rules[low:high].ravel())
            low = high

    def sizes(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones(len(codes), dtype=np.int64)
        rule = codes >= FIRST_RULE
        out[rule] = self._size[codes[rule] - FIRST_RULE]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        sizes = self.sizes(codes)
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
        rule = codes >= FIRST_RULE
        out[(ends - sizes)[~rule]] = codes[~rule]
        n = sizes[rule]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat((ends - sizes)[rule], n) + step] = self._ids[np.repeat(self._at[codes[rule] - FIRST_RULE], n) + step]
        return out


def _planes(codes: np.ndarray) -> tuple[bytes, bytes]:
    return (codes & 0xFFFF).astype("<u2").tobytes(), (codes >> 16).astype("u1").tobytes()


def codes_of(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, dtype="<u2").astype(np.uint32) | (np.frombuffer(high, dtype="u1").astype(np.uint32) << 16)


def _pack(part: int, shard: int, doc_ids: list, parts: list[np.ndarray], counts: list[int]) -> dict:
    seq = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint16)
    codes, rules, lengths = re_pair(seq)
    if len(rules) + FIRST_RULE > 1 << 24:
        raise ValueError("too many rules for 24-bit codes")
    sizes = np.ones(len(codes), dtype=np.int64)
    inner = codes >= FIRST_RULE
    sizes[inner] = lengths[codes[inner] - FIRST_RULE]
    marks = (np.cumsum(sizes) - sizes)[::MARK_EVERY]
    low, high = _planes(codes)
    return {
        "part": part, "shard": shard, "doc_ids": doc_ids, "doc_tokens": counts, "n_tokens": len(seq),
        "rules": rules.ravel().tolist(), "lengths": lengths.tolist(), "low": low, "high": high, "marks": marks.tolist(),
    }


_ARROW_SHARDS = pa.schema(
    [
        ("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()),
        ("rules", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("low", pa.binary()), ("high", pa.binary()), ("marks", pa.list_(pa.int64())),
    ]
)


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> DataFrame:
    """The shard table of all documents in ascending doc_id order, as written and read back.

    Null texts are empty: they hold the end id only. Repeated doc_ids keep one entry
    each, in no set order among themselves; null ids come first. An empty table gives no
    shards. Documents are dealt to as many ranges as their bytes need.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        part = TaskContext.get().partitionId()
        shard, ids, parts, counts, held = 0, [], [], [], 0
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                flat, sizes = encoder.encode(data, offsets)
                end = np.cumsum(sizes)
                whole = np.insert(flat, end, end_id)  # one end id after each document
                begin = 0
                for doc, n in zip(batch.column("doc_id").slice(low, high - low).to_pylist(), (sizes + 1).tolist(), strict=True):
                    ids.append(doc)
                    counts.append(n)
                    held += n
                    parts.append(whole[begin : begin + n])
                    begin += n
                    if held >= SHARD_TOKENS:
                        yield pa.RecordBatch.from_pylist([_pack(part, shard, ids, parts, counts)], _ARROW_SHARDS)
                        shard, ids, parts, counts, held = shard + 1, [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_pack(part, shard, ids, parts, counts)], _ARROW_SHARDS)

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = docs.select("doc_id", "text").repartitionByRange(max(1, -(-total // part_bytes)), "doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(encode, SHARDS), "token-shards")


def decode_range(shard: dict, start: int, n: int) -> np.ndarray:
    """Ids [start, start + n) of a shard row, expanding only the codes that cover them."""
    codes = codes_of(shard["low"], shard["high"])
    rules, lengths = np.array(shard["rules"], dtype=np.int64).reshape(-1, 2), np.array(shard["lengths"], dtype=np.int64)
    marks = np.array(shard["marks"], dtype=np.int64)
    first = max(int(np.searchsorted(marks, start, "right")) - 1, 0)
    last = int(np.searchsorted(marks, start + n, "left"))
    part, before = codes[first * MARK_EVERY : last * MARK_EVERY].astype(np.int64), int(marks[first]) if len(marks) else 0
    while True:  # open the rules one level at a time, and leave out what lies outside
        rule = part >= FIRST_RULE
        sizes = np.ones(len(part), dtype=np.int64)
        sizes[rule] = lengths[part[rule] - FIRST_RULE]
        ends = before + np.cumsum(sizes)
        low, high = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + n, "left")) + 1
        before = int(ends[low - 1]) if low else before
        part, rule = part[low:high], rule[low:high]
        if not rule.any():
            return part[start - before : start - before + n].astype(np.uint32)
        at = np.cumsum(np.where(rule, 2, 1)) - np.where(rule, 2, 1)
        opened = np.zeros(len(part) + int(rule.sum()), dtype=np.int64)
        opened[at[~rule]] = part[~rule]
        opened[at[rule]], opened[at[rule] + 1] = rules[part[rule] - FIRST_RULE].T
        part = opened


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            grammar = Grammar(np.array(row["rules"], dtype=np.int64).reshape(-1, 2), np.array(row["lengths"], dtype=np.int64))
            ids = grammar.decode(codes_of(row["low"], row["high"])).astype("<u4")
            counts = np.array(row["doc_tokens"], dtype=np.int64)
            ends = np.cumsum(counts)
            if len(ids) != row["n_tokens"] or len(ids) != ends[-1]:
                raise ValueError("a shard does not decode to its recorded size")
            sums = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends, counts, strict=True)]
            k = len(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array([row["part"]] * k, pa.int32()),
                    pa.array([row["shard"]] * k, pa.int32()),
                    pa.array(ends - counts),
                    pa.array(counts),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "part", "shard", "at", "n_tokens", "ids_crc32"],
            )


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, shard) decoded from a shard table.

    ``start`` counts the ids of all documents before: shard totals are summed within
    each range partition and partition totals across them.
    """
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("shard_start"))
    starts = starts.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    docs = shards.mapInArrow(_digest, "doc_id long, part int, shard int, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "shard"
    )


def op7_re_pair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(table(spark, sf_dir, "documents"))
    return read_documents(shards).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_re_pair_tokens": op7_re_pair_tokens}
#: Byte-pair encoding: tested by exact round trip against the tokenizer itself instead.
SQL: dict[str, str] = {}
