"""Removal of long repeated word sequences over a De Bruijn graph (operator 8).

Edges are the windows of ``k`` words, vertices the k - 1 words that neighbouring windows
share. A document's repeated edges are those that also start in a smaller document; the
smallest document, at its first such place, owns the edge: its source coordinates.

1. Anchors. The least of the hashes of its runs of six words names a window; equal windows
   have equal anchors. Buckets of the anchors' hashes find those of several documents: only
   windows with such an anchor, few in most corpora, can repeat and go on as edges.
2. Edges. Buckets of their anchors find each edge's owner and answer every document
   with its repeated edges and their source coordinates, and owners with what they own.
3. Paths. Owned edges are the graph. Vertices where edges meet or part end a path; stretches
   of neighbouring edges of an owner are cut there, and those that go on in another document
   are joined by following links in rounds of Spark joins, each twice as far as the last.
4. Verification. Every repeated run is compared, word by word, with the words at its source
   coordinates, along the paths that it follows. A window whose words differ is not removed.
5. What is left of the words is digested.

Within a task's documents, repeats are answered at once and send one edge on, so no
bucket grows with a group of copies. A source that many runs name is compared in shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import bound_batches, materialize, small, table
from ledgerline.llm.textbatch import CHUNK_BYTES, Words, chunks, mix, text_buffers

WINDOW_WORDS, ANCHOR_WORDS = 13, 6
#: Text bytes per bucket of anchors (a fifth as many as windows) and per bucket of edges.
ANCHOR_BYTES, BUCKET_BYTES = 64 << 20, 20 << 20
#: Text bytes of a slab, and about as many of a part of the documents.
SLAB_BYTES, PART_BYTES = 12 << 20, 16 << 20
#: Bytes of run words that are compared in one group.
COMPARED_BYTES = 8 << 20

#: What tasks send each other: ``to`` is a bucket or a part; the rest are packed arrays.
ENTRY, ANSWER, TEXT = 0, 1, 2
MESSAGE = "to int, kind int, part int, docs binary, uids binary, counts binary, keys binary, at binary, src_docs binary, src_uids binary, src_at binary, text binary"
_MESSAGE = pa.schema([(c.split()[0], {"int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in MESSAGE.split(", ")])
SPANS = (
    "doc_id long, uid long, n_words long, n_removed long, kept_sha256 string, starts array<int>, ends array<int>, windows array<struct<start:int,n:int>>, "
    "runs array<struct<start:int,n:int,src_doc:bigint,src_uid:bigint,src_at:int,words:binary>>, owned array<struct<start:int,n:int,words:binary,vertices:array<bigint>>>"
)
_WINDOW = [("start", pa.int32()), ("n", pa.int32())]
_SPANS = pa.schema(
    [
        *((c, pa.int64()) for c in ("doc_id", "uid", "n_words", "n_removed")), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
        ("windows", pa.list_(pa.struct(_WINDOW))),
        ("runs", pa.list_(pa.struct([*_WINDOW, ("src_doc", pa.int64()), ("src_uid", pa.int64()), ("src_at", pa.int32()), ("words", pa.binary())]))),
        ("owned", pa.list_(pa.struct([*_WINDOW, ("words", pa.binary()), ("vertices", pa.list_(pa.int64()))]))),
    ]
)


class Documents:
    """Documents of a batch: ids (those of null are not known), content digests, words."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.known = ids, known
        self.words = Words(data, offsets)
        # rows of one id are told apart by their texts
        self.uids = np.array([int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8).digest(), "little") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.uint64)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, anchor) of every window of known documents."""
        w = self.words
        at = w.windows(k)[0]
        at = at[self.known[w.doc[at]]]
        part, short = w.windows(min(ANCHOR_WORDS, k))
        value = np.full(len(w.start), np.uint64(0xFFFFFFFFFFFFFFFF))
        value[part] = short
        best = value[at].copy()
        for j in range(1, k - min(ANCHOR_WORDS, k) + 1):
            np.minimum(best, value[at + j], out=best)
        return w.doc[at], at, best


    def names(self) -> list[tuple[int, int]]:
        return list(zip(self.ids.tolist(), self.uids.tolist(), strict=True))

    def list_of(self, j: int) -> list[bytes]:
        w = self.words
        low, high = w.first[j], w.first[j + 1]
        base, raw = int(w.offsets[j]), w.text(j)
        return [raw[a:b] for a, b in zip((w.start[low:high] - base).tolist(), (w.end[low:high] - base).tolist(), strict=True)]

    def text_of(self, j: int) -> bytes:
        """The words of a document joined by one space."""
        return b" ".join(self.words.text(j).split(None))


def _batch(batch: pa.RecordBatch | pa.Table) -> Iterator[Documents]:
    ids = batch.column("doc_id")
    known = np.asarray(ids.is_valid())
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for low, high, data, offsets in chunks(batch.column("text")):
        yield Documents(ids[low:high], known[low:high], data, offsets)


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


_FIELDS = {"keys": "<u8", "at": "<u4", "src_docs": "<i8", "src_uids": "<u8", "src_at": "<u4"}


def _messages(to: np.ndarray, kind: int, doc: np.ndarray, uid: np.ndarray, columns: dict[str, np.ndarray], part: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Entries dealt to their targets: a message each, with runs of one document put together."""
    if not len(to):
        return
    order = np.lexsort((uid, doc, to))
    to, doc, uid = to[order], doc[order], uid[order]
    columns = {c: x[order] for c, x in columns.items()}
    part = np.full(len(to), -1) if part is None else part[order]
    rows = []
    edges = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    for low, high in zip(edges, np.append(edges[1:], len(to)), strict=True):
        new = np.flatnonzero(np.append(True, (doc[low + 1 : high] != doc[low : high - 1]) | (uid[low + 1 : high] != uid[low : high - 1])))
        row = {"to": int(to[low]), "kind": kind, "part": int(part[low])}
        row |= {"docs": doc[low:high][new].astype("<i8").tobytes(), "uids": uid[low:high][new].astype("<u8").tobytes(), "counts": np.diff(np.append(new, high - low)).astype("<u4").tobytes()}
        rows.append(row | {c: x[low:high].astype(_FIELDS[c]).tobytes() for c, x in columns.items()})
    yield pa.RecordBatch.from_pylist(rows, _MESSAGE)


def _entries(rows: list[dict], columns: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """(doc, uid, columns ...) of messages, an element an entry."""
    if not rows:
        return tuple(np.zeros(0, dtype=d) for d in ("<i8", "<u8", *(_FIELDS[c] for c in columns)))
    held = []
    for row in rows:
        counts = np.frombuffer(row["counts"], "<u4")
        held.append((np.repeat(np.frombuffer(row["docs"], "<i8"), counts), np.repeat(np.frombuffer(row["uids"], "<u8"), counts), *(np.frombuffer(row[c], _FIELDS[c]) for c in columns)))
    return tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by the keys, first the one to group by; begin of each group in it)."""
    order = np.lexsort(keys[::-1])
    key = keys[0][order]
    return order, np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)


# ---- 1. anchors


def _anchors(batches: Iterator[pa.RecordBatch], k: int, buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        for docs in _batch(batch):
            doc, _, anchor = docs.windows(k)
            order, new = _groups(doc, anchor)
            d, a = doc[order], anchor[order]
            first = np.append(True, (d[1:] != d[:-1]) | (a[1:] != a[:-1])) if len(d) else np.zeros(0, dtype=bool)
            held.append((docs.ids[d[first]], docs.uids[d[first]], a[first]))
            size += len(docs.words.data)
            if size >= SLAB_BYTES:
                yield from _anchor_slab(held, buckets, parts)
                held, size = [], 0
    yield from _anchor_slab(held, buckets, parts)


def _anchor_slab(held: list[tuple[np.ndarray, ...]], buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Anchors of several documents here are told to these, and sent on once, marked by at = 1."""
    if not held:
        return
    doc, uid, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
    shared, leads = _several(doc, anchor)
    told = np.flatnonzero(shared)
    yield from _through(buckets, part_of(doc[told], parts), doc[told], uid[told], {"keys": anchor[told]})
    on = np.flatnonzero(~shared | leads)
    yield from _messages(_bucket_of(anchor[on], buckets), ENTRY, doc[on], uid[on], {"keys": anchor[on], "at": shared[on].astype(np.int64)})


def _through(buckets: int, part: np.ndarray, doc: np.ndarray, uid: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Answers that are known before the buckets and only pass them: a message a part."""
    for found in _messages(part, ANSWER, doc, uid, columns, part):
        yield found.set_column(0, "to", pa.array(found.column("part").to_numpy() % buckets, pa.int32()))


def _several(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether an entry's key is in several documents, whether it is the first of its key)."""
    shared, leads = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    order, new = _groups(key, doc)
    if len(order):
        d = doc[order]
        several = np.maximum.reduceat(d, new) != np.minimum.reduceat(d, new)
        shared[order] = np.repeat(several, np.diff(np.append(new, len(order))))
        leads[order[new]] = True
    return shared, leads


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _sorted_out(batches: Iterator[pa.RecordBatch], held: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
    """The answers that only pass through; entries are put into ``held`` by bucket."""
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        passing = batch.filter(pa.array(kind == ANSWER))
        if len(passing):
            yield passing.set_column(0, "to", passing.column("part"))
        for row in batch.filter(pa.array(kind != ANSWER)).to_pylist():
            held.setdefault(row["to"], []).append(row)


def _shared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Answers: the anchors of each document that others have."""
    held: dict[int, list[dict]] = {}
    yield from _sorted_out(batches, held)
    for rows in held.values():
        doc, uid, key, known = _entries(rows, ("keys", "at"))
        shared, _ = _several(doc, key)
        order, new = _groups(key, doc)
        marked = np.zeros(len(key), dtype=bool)
        marked[order] = np.repeat(np.maximum.reduceat(known[order], new) > 0, np.diff(np.append(new, len(order))))
        told = np.flatnonzero((shared | marked) & (known == 0))
        part = part_of(doc[told], parts)
        yield from _messages(part, ANSWER, doc[told], uid[told], {"keys": key[told]}, part)


# ---- the documents of a part, packed for its task


def _texts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Documents, a slab at a time, compressed, to their parts."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    held: list[pa.RecordBatch] = []

    def dealt() -> Iterator[pa.RecordBatch]:
        slab = pa.Table.from_batches(held)
        ids, texts = slab.column("doc_id").combine_chunks(), slab.column("text")
        known = np.asarray(ids.is_valid())
        number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = part_of(number, parts)
        order = np.argsort(part, kind="stable")
        data, offsets = text_buffers(texts)
        begins = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
        rows = []
        for own in np.split(order, begins[1:]):
            rows.append(
                {
                    "to": int(part[own[0]]), "kind": TEXT, "part": int(part[own[0]]), "docs": number[own].astype("<i8").tobytes(), "uids": known[own].tobytes(),
                    "counts": (offsets[own + 1] - offsets[own]).astype("<u4").tobytes(),
                    "text": squeeze(b"".join([data[a:b].tobytes() for a, b in zip(offsets[own].tolist(), offsets[own + 1].tolist(), strict=True)])),
                }
            )
        yield pa.RecordBatch.from_pylist(rows, _MESSAGE)

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(b.nbytes for b in held) >= SLAB_BYTES:
            yield from dealt()
            held = []
    if held:
        yield from dealt()


def _received(batches: Iterator[pa.RecordBatch]) -> tuple[list[dict], list[Documents]]:
    """(answers, documents) of a part."""
    answers, texts = [], []
    for row in _rows(batches):
        (answers if row["kind"] == ANSWER else texts).append(row)
    expand = zstandard.ZstdDecompressor().decompress
    docs: list[Documents] = []
    held: list[tuple[np.ndarray, ...]] = []

    def read() -> None:
        ids, known, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
        docs.append(Documents(ids, known, data, np.concatenate(([0], np.cumsum(sizes)))))
        held.clear()

    size = 0
    for row in texts:
        data = np.frombuffer(expand(row["text"]), dtype=np.uint8)
        held.append((np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["uids"], bool), np.frombuffer(row["counts"], "<u4").astype(np.int64), data))
        row["text"], size = b"", size + len(data)
        if size >= CHUNK_BYTES:
            read()
            size = 0
    if held:
        read()
    return answers, docs


def _lookup(doc: np.ndarray, uid: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """Ranges of entries, sorted by document, by (doc, uid)."""
    if not len(doc):
        return {}
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (uid[1:] != uid[:-1])))
    return dict(zip(zip(doc[new].tolist(), uid[new].tolist(), strict=True), zip(new.tolist(), [*new[1:].tolist(), len(doc)], strict=True), strict=True))


# ---- 2. edges


def _candidates(batches: Iterator[pa.RecordBatch], k: int, buckets: int, parts: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Edges with a shared anchor: what repeats inside the part is answered, the rest goes to its bucket."""
    answers, docs = _received(batches)
    doc, uid, key = _entries(answers, ("keys",))
    order = np.lexsort((uid, doc))
    doc, uid, key = doc[order], uid[order], key[order]
    told = _lookup(doc, uid)
    held: list[tuple[np.ndarray, ...]] = []
    for d in docs:
        own, at, anchor = d.windows(k)
        bounds = np.searchsorted(own, np.arange(d.words.n_docs + 1))
        picked = []
        for j, name in enumerate(d.names()):
            if name in told and bounds[j] < bounds[j + 1]:
                low, high = told[name]
                picked.append(bounds[j] + np.flatnonzero(np.isin(anchor[bounds[j] : bounds[j + 1]], key[low:high])))
        if picked:
            pick = np.concatenate(picked)
            every, edge = d.words.windows(k)
            edge = edge[np.searchsorted(every, at[pick])] >> np.uint64(64 - bits)
            held.append((d.ids[own[pick]], d.uids[own[pick]], edge, at[pick] - d.words.first[own[pick]], anchor[pick]))
    if not held:
        return
    doc, uid, edge, at, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
    lead, later = _owners(doc, uid, edge, at)
    hit = np.flatnonzero(later)
    yield from _through(buckets, part_of(doc[hit], parts), doc[hit], uid[hit], _with_source(doc, uid, at, hit, lead))
    repeated = np.zeros(len(edge), dtype=np.int64)
    repeated[lead[hit]] = 1
    on = np.flatnonzero(~later)
    # equal edges have equal anchors, which neighbours share: a document's entries stay together
    yield from _messages(_bucket_of(anchor[on], buckets), ENTRY, doc[on], uid[on], {"keys": edge[on], "at": at[on], "src_at": repeated[on]})


def _owners(doc: np.ndarray, uid: np.ndarray, edge: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first entry of the smallest document with each entry's edge, whether an entry's document is larger)."""
    order, new = _groups(edge, doc, uid, at)
    lead = np.empty(len(edge), dtype=np.int64)
    lead[order] = np.repeat(order[new], np.diff(np.append(new, len(order))))
    return lead, doc > doc[lead]


def _with_source(doc: np.ndarray, uid: np.ndarray, at: np.ndarray, hit: np.ndarray, lead: np.ndarray) -> dict[str, np.ndarray]:
    """Places of edges with the coordinates of their owners."""
    return {"at": at[hit], "src_docs": doc[lead[hit]], "src_uids": uid[lead[hit]], "src_at": at[lead[hit]]}


def _sources(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Answers: a document's repeated edges with their owners' coordinates; owners have their own."""
    held: dict[int, list[dict]] = {}
    yield from _sorted_out(batches, held)
    for rows in held.values():
        doc, uid, edge, at, known = _entries(rows, ("keys", "at", "src_at"))
        lead, later = _owners(doc, uid, edge, at)
        owned = np.zeros(len(edge), dtype=bool)
        owned[lead[later | (known > 0)]] = True
        hit = np.flatnonzero(later | owned)
        part = part_of(doc[hit], parts)
        yield from _messages(part, ANSWER, doc[hit], uid[hit], _with_source(doc, uid, at, hit, lead), part)


# ---- 3. runs and owned stretches of a part's documents


def _stretches(at: np.ndarray, *beside: np.ndarray) -> list[tuple[int, int]]:
    """[low, high) of places that follow each other, with what stands beside them."""
    if not len(at):
        return []
    new = np.diff(at) != 1
    for x, step in beside:
        new |= np.diff(x) != step
    cuts = np.flatnonzero(np.append(True, new)).tolist()
    return list(zip(cuts, [*cuts[1:], len(at)], strict=True))


def _differing(own: list[bytes], source: list[bytes], k: int) -> np.ndarray:
    """The windows of a run whose words are not those of its source."""
    if own == source:
        return np.zeros(0, dtype=np.int64)
    wrong = np.array([a != b for a, b in zip(own, source, strict=False)] + [True] * max(len(own) - len(source), 0))
    total = np.concatenate(([0], np.cumsum(wrong)))
    return np.flatnonzero(total[k:] > total[:-k])


def _without(start: int, n: int, bad: np.ndarray) -> list[tuple[int, int]]:
    """(start, n) of what is left of ``n`` windows."""
    good = np.setdiff1d(np.arange(start, start + n), bad)
    return [(int(good[x]), y - x) for x, y in _stretches(good)]


def _cut(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """SPANS of a part's documents. Sources in the part are compared here; the others' runs go on with their words."""
    answers, docs = _received(batches)
    found = _entries(answers, ("at", "src_docs", "src_uids", "src_at"))
    order = np.lexsort((found[2], found[1], found[0]))
    doc, uid, at, src, src_uid, src_at = (x[order] for x in found)
    told = _lookup(doc, uid)
    here = {name: (d, j) for d in docs for j, name in enumerate(d.names())}
    words: dict[tuple[int, int], list[bytes]] = {}

    def words_of(name: tuple[int, int]) -> list[bytes]:
        if name not in words:
            d, j = here[name]
            words[name] = d.list_of(j)
        return words[name]

    for d in docs:
        rows = []
        vertices = None
        for j, name in enumerate(d.names()):
            n = int(d.words.counts[j])
            gone, runs, owned, windows = np.zeros(n, dtype=bool), [], [], []
            if name in told and d.known[j]:
                low, high = told[name]
                first = np.append(True, at[low + 1 : high] != at[low : high - 1])
                pick = low + np.flatnonzero(first)
                own = (src[pick] == name[0]) & (src_uid[pick] == np.uint64(name[1])) & (src_at[pick] == at[pick])
                mine, theirs = pick[own], pick[~own]
                text = words_of(name)
                if len(mine) and vertices is None:
                    vertices = d.words.windows(k - 1)
                for a, b in _stretches(at[mine].astype(np.int64)):
                    begin, size = int(at[mine[a]]), b - a
                    place = np.searchsorted(vertices[0], d.words.first[j] + begin)
                    owned.append({"start": begin, "n": size, "words": b" ".join(text[begin : begin + size + k - 1]), "vertices": vertices[1][place : place + size + 1].view(np.int64).tolist()})
                where = at[theirs].astype(np.int64)
                for a, b in _stretches(where, (src[theirs], 0), (src_uid[theirs].view(np.int64), 0), (src_at[theirs].astype(np.int64), 1)):
                    one, begin, size = theirs[a], int(where[a]), b - a
                    source = (int(src[one]), int(src_uid[one]))
                    good = [(begin, size)]
                    if source in here:
                        bad = _differing(text[begin : begin + size + k - 1], words_of(source)[src_at[one] : src_at[one] + size + k - 1], k)
                        good = _without(begin, size, bad + begin) if len(bad) else good
                    else:
                        runs.append({"start": begin, "n": size, "src_doc": source[0], "src_uid": _signed(source[1]), "src_at": int(src_at[one]), "words": b" ".join(text[begin : begin + size + k - 1])})
                    for x, y in good:
                        windows.append({"start": x, "n": y})
                        gone[x : x + y + k - 1] = True
            rows.append(_told(None if not d.known[j] else name[0], name[1], d.list_of(j) if gone.any() else None, d.text_of(j), gone) | {"windows": windows, "runs": runs, "owned": owned})
        yield pa.RecordBatch.from_pylist(rows, _SPANS)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _told(doc: int | None, uid: int, words: list[bytes] | None, whole: bytes, gone: np.ndarray) -> dict:
    """The digest columns of a document; ``whole``: its words joined by one space, if all are kept."""
    kept = whole if words is None else b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    return {
        "doc_id": doc, "uid": _signed(uid), "n_words": len(gone), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(),
        "starts": edge[::2].tolist(), "ends": edge[1::2].tolist(),
    }


# ---- 4. paths of the graph, and comparison along them


def paths(spans: DataFrame) -> DataFrame:
    """The compacted graph: (doc_id, uid, stretch, start, n, path, offset) of each piece of a path.

    A piece is a run of ``n`` edges from word ``start`` of the document that owns them,
    in its owned stretch from word ``stretch`` on; it is the part of its path from edge
    ``offset`` on. Paths that close on themselves
    begin at their smallest piece.
    """
    stretch = ["doc_id", "uid", "start", "n"]
    stretches = spans.select("doc_id", "uid", F.explode("owned").alias("o")).select("doc_id", "uid", "o.start", "o.n", "o.vertices")
    vertices = stretches.select(*stretch, F.posexplode("vertices").alias("i", "v"))
    degrees = vertices.groupBy("v").agg(F.count_if(F.col("i") < F.col("n")).alias("leave"), F.count_if(F.col("i") > 0).alias("enter"))
    branching = materialize(degrees.where("leave > 1 or enter > 1").select("v"), "branching")
    inner = vertices.where("i > 0 and i < n").join(small(branching), "v", "left_semi").groupBy(*stretch).agg(F.array_sort(F.collect_list("i")).alias("cuts"))
    ends = F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("n"))
    begins = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")))
    pieces = stretches.join(inner, stretch, "left").select("doc_id", "uid", "start", "vertices", F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("z"))
    pieces = pieces.select("doc_id", "uid", F.col("start").alias("stretch"), (F.col("start") + F.col("z.a")).alias("start"), (F.col("z.b") - F.col("z.a")).alias("n"), F.get("vertices", F.col("z.a")).alias("first"), F.get("vertices", F.col("z.b")).alias("last"))
    pieces = materialize(pieces.select(F.monotonically_increasing_id().alias("piece"), "*"), "pieces")
    links = pieces.select(F.col("piece").alias("up"), F.col("last").alias("v"), F.col("n").alias("off").cast("long")).join(pieces.select("piece", F.col("first").alias("v")), "v")
    links = links.where("up <> piece").join(small(branching), "v", "left_anti").select("piece", "up", "off")
    return pieces.join(small(_followed(links)), "piece", "left").select(
        "doc_id", "uid", "stretch", "start", "n", F.coalesce("root", "piece").alias("path"), F.coalesce("off", F.lit(0)).cast("long").alias("offset")
    )


def _followed(links: DataFrame) -> DataFrame:
    """(piece, root, off) from links (piece, up, off): where a piece's path begins, and edges before it.

    Each round follows every open link to where its own target points, twice as far as
    before. Links that are still open after as many rounds as their number allows run in
    a circle, whose smallest piece they have all seen by then.
    """
    state = materialize(links.withColumn("root", F.lit(None).cast("long")).withColumn("low", F.least("piece", "up")), "links")
    many, reach = state.count(), 1
    while reach <= 2 * many:
        # a target without a link of its own is the root
        of = state.select(F.col("piece").alias("up"), F.col("up").alias("up_2"), F.col("off").alias("off_2"), F.col("root").alias("root_2"), F.col("low").alias("low_2"))
        open_ = state.where("root is null").join(of, "up", "left")
        moved = open_.select(
            "piece", F.when(F.col("up_2").isNull() | F.col("root_2").isNotNull(), F.col("up")).otherwise(F.col("up_2")).alias("up"), (F.col("off") + F.coalesce("off_2", F.lit(0))).alias("off"),
            F.when(F.col("up_2").isNull(), F.col("up")).otherwise(F.col("root_2")).alias("root"), F.least("low", F.coalesce("low_2", "low")).alias("low"),
        )
        state = materialize(state.where("root is not null").select(*moved.columns).unionByName(moved), "links")
        reach *= 2
        if state.where("root is null").isEmpty():
            break
    circle = F.col("root").isNull()
    return materialize(state.select("piece", F.coalesce("root", "low").alias("root"), F.when(circle, F.lit(0)).otherwise(F.col("off")).alias("off")), "roots")


def compared(spans: DataFrame, k: int) -> DataFrame:
    """(doc_id, uid, start, n, bad, path, offset) of every run whose source is in another part.

    ``bad`` are the windows whose words are not those at the source; ``path`` and
    ``offset`` say where on its path the run begins.
    """
    source = ["src_doc", "src_uid"]
    runs = spans.select("doc_id", "uid", F.explode("runs").alias("r")).select("doc_id", "uid", "r.*")
    loads = runs.groupBy(*source).agg(F.sum(F.octet_length("words") + 64).alias("load"))
    loads = materialize(loads, "loads")
    cells = -(-(loads.agg(F.sum("load")).first()[0] or 0) // COMPARED_BYTES) or 1
    shares = small(loads.select(*source, F.ceil(F.col("load") / COMPARED_BYTES).cast("int").alias("shares")))
    cell = F.pmod(F.xxhash64("src_doc", "src_uid", "share"), F.lit(cells)).cast("int").alias("cell")
    runs = runs.join(shares, source).withColumn("share", F.pmod(F.xxhash64("doc_id", "uid", "start"), F.col("shares")).cast("int")).select("*", cell)
    passages = spans.select(F.col("doc_id").alias("src_doc"), F.col("uid").alias("src_uid"), F.explode("owned").alias("o"))
    passages = passages.select(*source, F.col("o.start").alias("start"), F.col("o.n").alias("n"), F.col("o.words").alias("words"))
    pieces = paths(spans).groupBy(F.col("doc_id").alias("src_doc"), F.col("uid").alias("src_uid"), F.col("stretch").alias("start"))
    pieces = pieces.agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("start"), "n", "path", "offset"))).alias("pieces"))
    passages = passages.join(pieces, [*source, "start"]).join(shares, source).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("*", cell).drop("shares", "share")
    fields = "doc_id long, uid long, start int, n int, bad array<int>, path long, offset long"
    return passages.groupBy("cell").cogroup(runs.drop("shares", "share").groupBy("cell")).applyInArrow(lambda left, right: _compare(left, right, k), fields)


_COMPARED = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("bad", pa.list_(pa.int32())), ("path", pa.int64()), ("offset", pa.int64())])


def _compare(passages: pa.Table, runs: pa.Table, k: int) -> pa.Table:
    held: dict[tuple[int, int], dict[int, tuple[list[bytes], list[dict]]]] = {}
    for p in passages.to_pylist():
        held.setdefault((p["src_doc"], p["src_uid"]), {})[p["start"]] = p["words"].split(b" "), p["pieces"]
    begins = {name: np.sort(np.array(list(x))) for name, x in held.items()}
    out = []
    for r in runs.to_pylist():
        name = r["src_doc"], r["src_uid"]
        begin = int(begins[name][np.searchsorted(begins[name], r["src_at"], "right") - 1])
        source, pieces = held[name][begin]
        skip = r["src_at"] - begin
        bad = _differing(r["words"].split(b" "), source[skip : skip + r["n"] + k - 1], k) + r["start"]
        piece = next(p for p in reversed(pieces) if p["start"] <= r["src_at"])
        out.append({"doc_id": r["doc_id"], "uid": r["uid"], "start": r["start"], "n": r["n"], "bad": bad.tolist(), "path": piece["path"], "offset": piece["offset"] + r["src_at"] - piece["start"]})
    return pa.Table.from_pylist(out, _COMPARED)


# ---- 5. the operator


def _recut(texts: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """SPANS of documents some of whose windows are not their sources' words."""
    told = {(r["doc_id"], r["uid"]): r for r in rows.to_pylist()}
    out = []
    for docs in _batch(texts):
        for j, (doc, uid) in enumerate(docs.names()):
            r = told.get((doc, _signed(uid)))
            if r is None:
                continue
            gone, windows = np.zeros(int(docs.words.counts[j]), dtype=bool), []
            for w in r["windows"]:
                windows += [{"start": x, "n": y} for x, y in _without(w["start"], w["n"], np.array(r["bad"]))]
            for w in windows:
                gone[w["start"] : w["start"] + w["n"] + k - 1] = True
            out.append(_told(doc, uid, docs.list_of(j), b"", gone) | {"windows": windows, "runs": [], "owned": []})
    return pa.Table.from_pylist(out, _SPANS)


def repeated_spans(docs: DataFrame, k: int = WINDOW_WORDS, bits: int = 64) -> DataFrame:
    """Per row: words, words in repeated spans, the spans, and a digest of the kept words.

    Spans (starts, ends) are half-open word ranges; ``windows`` are the repeated edges,
    ``runs`` those with sources in another part of the documents, ``owned`` the row's part
    of the graph. Null, empty and short texts have no windows. The smallest doc_id keeps a
    passage; repeats inside one document stay, and so do those of rows of one id; rows
    without an id keep all and take nothing away. Other columns are ignored; an empty
    table gives no rows. Edges are told apart by ``bits`` of their hashes: fewer than 64
    only serve to test the comparison.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rough, fine, parts = (max(1, -(-total // n)) for n in (ANCHOR_BYTES, BUCKET_BYTES, PART_BYTES))

    def sent(df: DataFrame, to: int, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str = MESSAGE) -> DataFrame:
        return df.repartitionById(to, F.col("to")).mapInArrow(run, schema)

    texts = docs.mapInArrow(lambda rows: _texts(rows, parts), MESSAGE)
    shared = sent(docs.mapInArrow(lambda rows: _anchors(rows, k, rough, parts), MESSAGE), rough, lambda rows: _shared(rows, parts))
    edges = sent(shared.union(texts), parts, lambda rows: _candidates(rows, k, fine, parts, bits))
    answers = sent(edges, fine, lambda rows: _sources(rows, parts))
    spans = materialize(sent(answers.union(texts), parts, lambda rows: _cut(rows, k), SPANS), "spans")
    wrong = materialize(compared(spans, k).where("size(bad) > 0").select("doc_id", "uid", F.explode("bad").alias("bad")), "wrong-windows")
    if wrong.isEmpty():
        return spans
    wrong = materialize(wrong.groupBy("doc_id", "uid").agg(F.collect_set("bad").alias("bad")), "wrong-windows")
    rows = spans.join(small(wrong), ["doc_id", "uid"]).select("doc_id", "uid", "windows", "bad")
    again = docs.join(small(materialize(wrong.select("doc_id").distinct(), "wrong-documents")), "doc_id", "left_semi").groupBy("doc_id")
    again = again.cogroup(rows.groupBy("doc_id")).applyInArrow(lambda left, right: _recut(left, right, k), SPANS)
    return spans.join(small(wrong), ["doc_id", "uid"], "left_anti").select(*again.columns).unionByName(again)


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_repeated_substrings": op8_repeated_substrings}
SQL: dict[str, str] = {
    "op8_repeated_substrings": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, pos, array_to_string(w[pos : pos + 12], ' ') AS edge
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM words WHERE len(w) >= 13)
), repeated AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY edge) AS low FROM windows) WHERE low < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS p FROM repeated
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
}
