"""Removal of long repeats by sorting suffixes (deep-shallow sorting, after Manzini and Ferragina).

A byte goes if a LENGTH-byte string over it also starts in a document with a smaller id. What is equal is decided by one
sort alone: suffixes are put into buckets by their first symbol of eight bytes, multikey quicksort orders them to a shallow
depth, and blind tries order the groups that still agree, to LENGTH bytes. Only suffixes that can repeat are sorted: each
LENGTH-byte window has an anchor, the least hashed GRAM of bytes within it, and equal windows have equal anchors, so a
window whose anchor occurs in one document alone is unique. Steps, each settled in the shared folder:

1. whole texts that equal an earlier one are set aside: all their windows repeat, and they are never needed as a source
2. anchors meet by their hash; those that several documents have are told to these documents
3. documents sort the suffixes under shared anchors, a piece of text at a time. Windows that a smaller document of the
   piece has too are decided there; the bytes under the others go to the bucket of their anchor's hash
4. buckets sort what reaches them, and the windows that a smaller document has become spans
5. spans are cut out of the texts

Decided spans travel by their document. Anchors of more than HOT documents are dealt out by whole windows, first to one of
SALTS buckets, whose least documents alone go on to the window's own. So no task holds all documents with a common
passage. A task works on its buckets one after another, so the number of partitions stays below MOST_PARTITIONS however
large the input, and buckets have one size.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import few, settle, table, tidy

LENGTH = 50
GRAM = 24
_SPAN = LENGTH - GRAM + 1
#: Bytes of text sorted at once, of text whose anchors a bucket has, and of windows whose suffixes a bucket sorts.
PIECE, TEXT_PER_BUCKET, WINDOWS_PER_BUCKET = 1 << 21, 32 << 20, 4 << 20
BUCKETS_A_TASK, MOST_PARTITIONS = 3, 8192
#: Anchors of more documents than this are dealt out by windows, over SALTS buckets first.
HOT, SALTS = 50_000, 64
#: Multikey quicksort ends here; blind tries go on to LENGTH.
SHALLOW = 24
#: Distinct strings of a group that are found for all groups at once, before tries take them one by one.
AT_ONCE = 4
#: An Arrow batch of texts.
BATCH = "16m"
#: A row's place among the different texts of one id stands above this bit of a position.
_PART = 40


def _constants() -> tuple[np.ndarray, list[np.uint64]]:
    rng = np.random.default_rng(404)
    base, powers = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1, []
    for n in (1, 3, 6, 12):
        powers.append(np.uint64(pow(base, n, 1 << 64)))
    return rng.integers(0, 1 << 64, 256, dtype=np.uint64), powers


_BYTE, _POWERS = _constants()
_POSITION = np.uint64((1 << 24) - 1)


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes of data, well mixed."""
    c1, c3, c6, c12 = _POWERS
    one = _BYTE[data]
    h = one[:-1] * c1 + one[1:]
    h = h[:-1] * c1 + one[2:]
    h = h[:-3] * c3 + h[3:]
    h = h[:-6] * c6 + h[6:]
    h = h[:-12] * c12 + h[12:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of grams, for each window of data the place of its anchor): the first of its least grams."""
    h = grams(data)
    v = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    for n in (1, 2, 4, 8):
        v = np.minimum(v[:-n], v[n:])
    v = np.minimum(v[: len(v) - (_SPAN - 16)], v[_SPAN - 16 :])
    return h, (v & _POSITION).astype(np.int64)


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, rows, where their bytes start, where these start in their text) of pieces of PIECE bytes, about; a long
    text comes in several, each with the windows that start in it."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    parts, size = [], 0
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at = 0
        while b - a - at >= LENGTH:
            take = min(b - a - at, PIECE + LENGTH - 1)
            parts.append((k, at, a + at, take))
            size += take
            at += PIECE
            if size >= PIECE:
                yield _join(data, parts)
                parts, size = [], 0
    if parts:
        yield _join(data, parts)


def _join(data: np.ndarray, parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, at, begin, sizes = (np.array(x, dtype=np.int64) for x in zip(*parts, strict=True))
    flat = np.concatenate([data[a : a + n] for a, n in zip(begin, sizes, strict=True)])
    return flat, rows, np.r_[0, np.cumsum(sizes)], at


def _windows(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, part, first window, last window) of each anchor of the parts that lie one after another in flat."""
    h, at = anchors(flat)
    inside = np.zeros(len(at) + LENGTH, dtype=bool)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        inside[a : b - LENGTH + 1] = True
    window = np.flatnonzero(inside)
    at = at[window]
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])
    tail = np.r_[head[1:] - 1, len(at) - 1]
    part = np.searchsorted(starts, window[head], side="right") - 1
    return h[at[head]], part, window[head], window[tail]


def _hash_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(8)).view(np.int64)


_ENTRY = np.dtype([("hash", "<i8"), ("doc", "<i8")])
_KINDS = "bucket int, kind int, block binary"
_SPAN_COLUMNS = "doc_id bigint, start bigint, end bigint"


def _rows(buckets: list[np.ndarray], kinds: list[np.ndarray], blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
    bucket, kind = np.concatenate(buckets), np.concatenate(kinds)
    for lo in range(0, len(blocks), 256):
        arrays = [pa.array(bucket[lo : lo + 256], pa.int32()), pa.array(kind[lo : lo + 256], pa.int32()), pa.array(blocks[lo : lo + 256], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "kind", "block"])


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, the buckets that occur, where each begins in that order, where it ends)."""
    order = np.argsort(bucket, kind="stable")
    own, heads = np.unique(bucket[order], return_index=True)
    return order, own, heads, np.r_[heads, len(order)][1:]


def _bucketwise(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, pa.Scalar]]]:
    """(kind, block) of one bucket after another, from rows sorted by bucket."""
    held: list[tuple[int, pa.Scalar]] = []
    last = None
    for b in batches:
        for bucket, kind, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if bucket != last and held:
                yield held
                held = []
            last = bucket
            held.append((kind, block))
    if held:
        yield held


def _entries(buckets: int):
    """Rows (bucket, kind, block). Kind 0: (hash, document) where the batch has one document with the hash; 1: (hash,
    number of documents) where it has more, all of which it tells itself, in rows of kind 2, which go by their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = b.column(0).to_numpy(zero_copy_only=False), []
            for flat, rows, starts, _ in _pieces(b.column(1)):
                h, part, _, _ = _windows(flat, starts)
                pair = np.empty(len(h), dtype=_ENTRY)
                pair["hash"], pair["doc"] = _hash_of(h), ids[rows[part]]
                found.append(pair)
            if not found:
                continue
            pair = np.concatenate(found)
            pair = pair[np.lexsort((pair["doc"], pair["hash"]))]
            pair = pair[np.r_[True, (pair["hash"][1:] != pair["hash"][:-1]) | (pair["doc"][1:] != pair["doc"][:-1])]]
            head = np.flatnonzero(np.r_[True, pair["hash"][1:] != pair["hash"][:-1]])
            n = np.diff(np.r_[head, len(pair)])
            many = pair[head[n > 1]].copy()
            many["doc"] = n[n > 1]
            out: tuple[list, list, list] = ([], [], [])
            for kind, rows, by in ((0, pair[head[n == 1]], "hash"), (1, many, "hash"), (2, pair[np.repeat(n > 1, n)], "doc")):
                order, own, begin, end = _by_bucket(rows[by] % buckets)
                rows = rows[order]
                out[0].append(own)
                out[1].append(np.full(len(own), kind))
                out[2].extend(rows[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist(), strict=True))
            yield from _rows(*out)

    return run


def _shared(hot: int):
    """Rows (doc_id, hash) of shared anchors, and (null, hash) of those in more than `hot` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bucketwise(batches):
            held: list[list[np.ndarray]] = [[], [], []]
            for kind, block in rows:
                held[kind].append(np.frombuffer(block.as_buffer(), dtype=_ENTRY))
            one, many, known = (np.concatenate(x) if x else np.empty(0, dtype=_ENTRY) for x in held)
            yield from told(known["doc"], known["hash"])
            key = np.concatenate([one["hash"], many["hash"]])
            if not len(key):
                continue
            count = np.concatenate([np.ones(len(one), dtype=np.int64), many["doc"]])
            order = np.argsort(key, kind="stable")
            head = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            total = np.add.reduceat(count[order], head)
            is_shared = np.repeat(total > 1, np.diff(np.r_[head, len(key)]))
            of_one = order[is_shared & (order < len(one))]
            yield from told(one["doc"][of_one], one["hash"][of_one])
            yield from told(None, key[order][head[total > hot]])

    def told(docs: np.ndarray | None, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(hashes), 1 << 16):
            h = pa.array(hashes[lo : lo + (1 << 16)].astype(np.int64))
            d = pa.nulls(len(h), pa.int64()) if docs is None else pa.array(docs[lo : lo + (1 << 16)].astype(np.int64))
            yield pa.RecordBatch.from_arrays([d, h], names=["doc_id", "hash"])

    return run


def _told(column: pa.Array) -> np.ndarray:
    """(row, hash) of a column of lists of hashes, sorted."""
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    return np.unique(np.rec.fromarrays([row, flat], names="row,hash"))


def _spread(head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """head[k], head[k] + 1, ... of size[k] numbers, for one k after another."""
    return np.repeat(head - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _route(grams_at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number of the windows that start at first, from the hashes of their first and last grams."""
    with np.errstate(over="ignore"):
        mixed = (grams_at[first] ^ (grams_at[first + _SPAN - 1] >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
    return _hash_of(mixed)


def _contexts(buckets: int):
    """Rows (bucket, kind, block) for documents (doc_id, part, text, hashes, hot hashes). Kind 0: bytes under the windows of
    a shared anchor that no smaller document of the piece has, 1: the same, a window each, of hot anchors; 2: decided
    spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lead = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            shared, hot = _told(b.column(3)), _told(b.column(4))
            sent: tuple[list, list] = ([], [])
            spans = []
            for flat, rows, starts, at in _pieces(b.column(2)):
                h, part, first, last = _windows(flat, starts)
                h, r = _hash_of(h), rows[part]
                good = np.flatnonzero(_find(shared, r, h))
                h, part, first, last, r = h[good], part[good], first[good], last[good], r[good]
                shift = (at - starts[:-1])[part] + (lead[r].astype(np.int64) << _PART)
                doc = ids[r]
                # windows whose anchor several documents of the piece have are sorted here
                by = np.lexsort((doc, h))
                meets = np.zeros(len(by), dtype=bool)
                if len(by):
                    head = np.flatnonzero(np.r_[True, h[by][1:] != h[by][:-1]])
                    tail = np.r_[head[1:], len(by)] - 1
                    meets[by] = np.repeat(doc[by][head] != doc[by][tail], tail - head + 1)
                size = last - first + 1
                run_of = np.repeat(np.arange(len(first)), size)
                window = _spread(first, size)
                gone = np.zeros(len(window), dtype=bool)
                local = np.flatnonzero(meets[run_of])
                gone[local] = _later(flat, window[local], doc[run_of[local]])
                if gone.any():
                    spans.append(_joined(doc[run_of[gone]], (window + shift[run_of])[gone]))
                burning = _find(hot, r, h) if len(hot) else np.zeros(len(h), dtype=bool)
                stays = np.flatnonzero(~gone)
                lone = burning[run_of[stays]]
                if lone.any():
                    alone = stays[lone]
                    own = run_of[alone]
                    route = _route(grams(flat), window[alone]) + doc[own] % SALTS
                    sent[1].append((flat[_spread(window[alone], np.full(len(alone), LENGTH))], np.full(len(alone), LENGTH), doc[own], (window + shift[run_of])[alone], route % buckets))
                stays = stays[~lone]
                if len(stays):
                    new = np.flatnonzero(np.r_[True, (run_of[stays][1:] != run_of[stays][:-1]) | (window[stays][1:] != window[stays][:-1] + 1)])
                    begin, own = window[stays[new]], run_of[stays[new]]
                    wide = np.diff(np.r_[new, len(stays)]) + LENGTH - 1
                    sent[0].append((flat[_spread(begin, wide)], wide, doc[own], begin + shift[own], h[own] % buckets))
            yield from _sent(buckets, sent, spans)

    return run


def _find(shared: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which pairs of row and hash stand in shared."""
    order = np.lexsort((np.r_[shared["hash"], hashes], np.r_[shared["row"], rows]))
    row, value = np.r_[shared["row"], rows][order], np.r_[shared["hash"], hashes][order]
    group = np.cumsum(np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])]) - 1
    has = np.zeros(len(order) + 1, dtype=bool)
    has[group[order < len(shared)]] = True
    out = np.empty(len(order), dtype=bool)
    out[order] = has[group]
    return out[len(shared) :]


def _later(data: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which suffixes of data at starts agree to LENGTH bytes with one of a smaller document."""
    gone = np.zeros(len(starts), dtype=bool)
    if len(starts):
        order, group = sort_suffixes(data, starts)
        own = doc[order]
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        gone[order] = own > np.repeat(np.minimum.reduceat(own, head), np.diff(np.r_[head, len(order)]))
    return gone


def _joined(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the spans that the windows starting at start make."""
    by = np.lexsort((start, doc))
    d, s = doc[by], start[by]
    begin = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + LENGTH)])
    last = np.r_[begin[1:] - 1, len(d) - 1]
    return d[begin], s[begin], s[last] + LENGTH


def _held(block: bytes) -> int:
    """How many contexts a block holds."""
    return int.from_bytes(block[:4], "little")


def _sent(buckets: int, contexts: tuple[list, list], spans: list) -> Iterator[pa.RecordBatch]:
    """The rows of _contexts. contexts: by kind lists of (bytes, sizes, documents, starts, buckets)."""
    out: tuple[list, list, list] = ([], [], [])
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for kind, parts in enumerate(contexts):
        if not parts:
            continue
        own, size, doc, start, route = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, some, begin, end = _by_bucket(route)
        own = own[_spread((np.cumsum(size) - size)[order], size[order])]
        size, doc, start = size[order], doc[order], start[order]
        byte = np.r_[0, np.cumsum(size)]
        for x, y in zip(begin.tolist(), end.tolist(), strict=True):
            block = b"".join(((y - x).to_bytes(4, "little"), doc[x:y].tobytes(), start[x:y].tobytes(), size[x:y].astype(np.uint8).tobytes(), own[byte[x] : byte[y]].tobytes()))
            out[2].append(squeeze(block))
        out[0].append(some)
        out[1].append(np.full(len(some), kind))
    if spans:
        doc, start, end = (np.concatenate(x) for x in zip(*spans, strict=True))
        order, some, begin, stop = _by_bucket(doc % buckets)
        rows = np.stack([doc[order], start[order], end[order]], axis=1)
        out[0].append(some)
        out[1].append(np.full(len(some), 2))
        out[2].extend(squeeze(rows[x:y].tobytes()) for x, y in zip(begin.tolist(), stop.tolist(), strict=True))
    if out[2]:
        yield from _rows(*out)


def _opened(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, sizes, documents, starts) of blocks of contexts."""
    parts = []
    for block in blocks:
        n = _held(block)
        wide = np.frombuffer(block, np.uint8, n, 4 + 16 * n).astype(np.int64)
        parts.append((np.frombuffer(block, np.uint8, offset=4 + 17 * n), wide, np.frombuffer(block, "<i8", n, 4), np.frombuffer(block, "<i8", n, 4 + 8 * n)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _repeats(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, start, end) of spans whose windows a smaller document has too, and (bucket, kind, block) of hot windows
    (kind 1) that no smaller document of their bucket has, for the windows' own buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze = zstandard.ZstdDecompressor().decompress
        for rows in _bucketwise(batches):
            plain: list[list[bytes]] = [[], [], []]
            for kind, block in rows:
                plain[kind].append(unsqueeze(block.as_buffer()))
            del rows
            for block in plain[2]:
                yield from spans(*np.frombuffer(block, "<i8").reshape(-1, 3).T)
            if plain[0] or plain[1]:
                hot = len(plain[1])
                own, size, doc, start = _opened(plain[1] + plain[0])
                n_hot = sum(_held(x) for x in plain[1]) if hot else 0
                plain.clear()
                yield from judged(own, size, doc, start, n_hot)

    def judged(own: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, n_hot: int) -> Iterator[pa.RecordBatch]:
        begin, n = np.cumsum(size) - size, size - LENGTH + 1
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        suffix = _spread(begin, n)
        gone = _later(own, suffix, doc[row])
        if gone.any():
            row_gone = row[gone]
            yield from spans(*_joined(doc[row_gone], start[row_gone] + suffix[gone] - begin[row_gone]))
        on = np.flatnonzero(~gone[:n_hot])  # hot contexts come first and are of one window
        if len(on):
            route = _route(grams(own[: n_hot * LENGTH]), on * LENGTH) % buckets
            whole = own[: n_hot * LENGTH].reshape(-1, LENGTH)[on].ravel()
            for b in _sent(buckets, ([], [(whole, size[on], doc[on], start[on], route)]), []):
                yield out(b, None)

    def spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(doc), 1 << 16):
            yield out(None, [pa.array(x[lo : lo + (1 << 16)].astype(np.int64)) for x in (doc, start, end)])

    def out(sent: pa.RecordBatch | None, found: list[pa.Array] | None) -> pa.RecordBatch:
        n = len(sent) if sent else len(found[0])
        left = found or [pa.nulls(n, pa.int64())] * 3
        right = sent.columns if sent else [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays([*left, *right], names=["doc_id", "start", "end", "bucket", "kind", "block"])

    return run


class BlindTrie:
    """Orders strings of one length. Inner nodes hold the depth at which strings differ and the bytes there; what lies
    between is never looked at on the way down, but compared once with the leaf that the way leads to."""

    def __init__(self, first: bytes, member: int):
        self.root: list = [len(first), first, [member]]  # a leaf: depth, string, members

    def insert(self, own: bytes, member: int) -> None:
        node = self.root
        while isinstance(node[1], dict):
            node = node[1].get(own[node[0]]) or next(iter(node[1].values()))
        if own == node[1]:
            node[2].append(member)
            return
        depth = next(k for k, (x, y) in enumerate(zip(own, node[1], strict=True)) if x != y)
        other, above = node[1][depth], None
        node = self.root
        while node[0] < depth:
            above, node = node, node[1][own[node[0]]]
        leaf = [len(own), own, [member]]
        if isinstance(node[1], dict) and node[0] == depth:
            node[1][own[depth]] = leaf
            return
        fork = [depth, {other: node, own[depth]: leaf}]
        if above is None:
            self.root = fork
        else:
            above[1][own[above[0]]] = fork

    def leaves(self) -> Iterator[list[int]]:
        """Members of equal strings, in the strings' order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node[1], dict):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                yield node[2]


def _symbols(data: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there, as a number that compares as they do."""
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    out = np.empty(len(data) + 8, dtype=np.uint64)
    for k in range(8):
        n = len(out[k::8])
        out[k::8] = padded[k : k + 8 * n].view(">u8")[:n]
    return out


def _quicksorted(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): the suffixes at starts by their first SHALLOW bytes, and where groups of equal ones begin.

    The first symbol deals the suffixes into buckets. Multikey quicksort goes on in all buckets at once: each has a pivot,
    the middle one of three symbols, and falls into three parts, of which the equal one goes on to the next symbol."""
    n = len(starts)
    first = symbols[starts]
    order = np.argsort(first)
    first = first[order]
    is_head = np.r_[True, first[1:] != first[:-1]]
    lo = np.flatnonzero(is_head)
    size = np.diff(np.r_[lo, n])
    lo, size = lo[size > 1], size[size > 1]
    depth = np.full(len(lo), 8)
    if SHALLOW <= 8:
        lo = lo[:0]
    while len(lo):
        at = _spread(lo, size)
        own = order[at]
        ends = np.cumsum(size)
        begin = ends - size
        of = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        v = symbols[starts[own] + depth[of]]
        a, b, c = v[begin], v[begin + size // 2], v[ends - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[of]
        less, more = v < pivot, v > pivot
        parts = [np.flatnonzero(x) for x in (less, ~(less | more), more)]
        counts = np.stack([np.bincount(of[x], minlength=len(lo)) for x in parts], axis=1)
        offset = np.cumsum(counts, axis=1) - counts
        for k, x in enumerate(parts):
            to = (lo + offset[:, k] - (np.cumsum(counts[:, k]) - counts[:, k]))[of[x]] + np.arange(len(x))
            order[to] = own[x]
        lo = (lo[:, None] + offset).ravel()
        size = counts.ravel()
        is_head[lo[size > 0]] = True
        depth = np.stack([depth, depth + 8, depth], axis=1).ravel()
        goes_on = (size > 1) & (depth < SHALLOW)
        lo, size, depth = lo[goes_on], size[goes_on], depth[goes_on]
    return order, np.flatnonzero(is_head)


def sort_suffixes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the suffixes of data at starts in the order of their first LENGTH bytes, and for each in that order
    the number of its group of equal ones.

    In a group that agrees to SHALLOW bytes, the first suffix is the blind trie's first leaf; what agrees with a leaf to
    LENGTH bytes goes there, compared for all groups at once; the first that does not is the next leaf. After AT_ONCE
    leaves the rest are inserted one by one. Only groups with more than one leaf need a trie."""
    if not len(starts):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    symbols = _symbols(data)
    order, head = _quicksorted(symbols, starts)
    size = np.diff(np.r_[head, len(order)])
    deep = np.flatnonzero(size > 1)
    at = _spread(head[deep], size[deep])
    of = np.repeat(np.arange(len(deep)), size[deep])
    leaf = np.zeros(len(at), dtype=np.int64)
    left = np.arange(len(at))
    places = (*range(SHALLOW, LENGTH - 8, 8), LENGTH - 8)
    for k in range(AT_ONCE):
        if not len(left):
            break
        first = np.flatnonzero(np.r_[True, of[left][1:] != of[left][:-1]])
        lead = np.repeat(left[first], np.diff(np.r_[first, len(left)]))
        one, two = starts[order[at[left]]], starts[order[at[lead]]]
        same = np.ones(len(left), dtype=bool)
        for d in places:
            same &= symbols[one + d] == symbols[two + d]
        leaf[left[same]] = k
        left = left[~same]
    leaf[left] = AT_ONCE + np.arange(len(left))
    mixed = np.zeros(len(deep), dtype=bool)
    mixed[of[leaf > 0]] = True
    is_head = np.zeros(len(order), dtype=bool)
    is_head[head] = True
    if mixed.any():
        part = np.flatnonzero(mixed[of])
        by = part[np.lexsort((leaf[part], of[part]))]
        new = np.flatnonzero(np.r_[True, (of[by][1:] != of[by][:-1]) | (leaf[by][1:] != leaf[by][:-1])])
        rank = np.empty(len(new), dtype=np.int64)
        raw, lead, group = data.tobytes(), starts[order[at[by[new]]]].tolist(), of[by[new]]
        ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1
        x = 0
        for y in ends.tolist():
            trie = BlindTrie(raw[lead[x] + SHALLOW : lead[x] + LENGTH], x)
            for u in range(x + 1, y):
                trie.insert(raw[lead[u] + SHALLOW : lead[u] + LENGTH], u)
            for k, leaves in enumerate(trie.leaves()):
                rank[leaves] = k
            x = y
        own = np.repeat(rank, np.diff(np.r_[new, len(by)]))
        final = np.lexsort((own, of[by]))
        order[at[part]] = order[at[by[final]]]
        rows, own = of[by[final]], own[final]
        is_head[at[part]] = np.r_[True, (rows[1:] != rows[:-1]) | (own[1:] != own[:-1])]
    return order, np.cumsum(is_head) - 1


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch become one."""
    if not len(starts):
        return starts, ends
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, part, text, spans in zip(*[b.column(k).to_pylist() for k in range(3)], b.column(3), strict=True):
            own = spans.values.field(0).to_numpy() >> _PART == part
            base = part << _PART
            x, y = merged(spans.values.field(0).to_numpy()[own] - base, spans.values.field(1).to_numpy()[own] - base)
            kept = b"".join(text[a:z] for a, z in zip([0, *y.tolist()], [*x.tolist(), len(text)], strict=True))
            out.append((doc, part, int((y - x).sum()), len(x), hashlib.sha256(kept).hexdigest(), kept))
        columns = zip(*out, strict=True) if out else ((),) * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "part", "n_removed", "n_spans", "kept_sha256", "kept"])


def _free(spark: SparkSession) -> None:
    """Shuffle files go when the driver finds that nothing refers to them; this makes it look now, between steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _buckets(size: int, each: int) -> tuple[int, int]:
    """(buckets, partitions)."""
    buckets = max(1, -(-size // each))
    return buckets, min(MOST_PARTITIONS, -(-buckets // BUCKETS_A_TASK))


def _dealt(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("bucket")


def _shared_anchors(long: DataFrame, size: int) -> DataFrame:
    buckets, partitions = _buckets(size, TEXT_PER_BUCKET)
    entries = _dealt(long.select("doc_id", "t").mapInArrow(tidy(_entries(buckets)), _KINDS), partitions)
    return settle(entries.mapInArrow(tidy(_shared(HOT)), "doc_id bigint, hash bigint"), "shared-anchors", BATCH)


def _repeated_spans(long: DataFrame, shared: DataFrame) -> DataFrame:
    told, hot = shared.where("doc_id is not null"), shared.where("doc_id is null").select("hash", F.lit(True).alias("hot"))
    any_hot = not hot.isEmpty()
    told = told.join(few(hot), "hash", "left") if any_hot else told.withColumn("hot", F.lit(None).cast("boolean"))
    buckets, partitions = _buckets(told.count() * (LENGTH + _SPAN // 2), WINDOWS_PER_BUCKET)
    # at most one hash for each of the document's bytes
    hashes = told.groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"), F.collect_list(F.when(F.col("hot"), F.col("hash"))).alias("hot"))
    ids = few(settle(shared.where("doc_id is not null").select("doc_id").distinct(), "ids"))
    asked = long.join(ids, "doc_id", "left_semi").join(hashes, "doc_id").select("doc_id", "part", "t", "hashes", "hot")
    sent = _dealt(asked.mapInArrow(tidy(_contexts(buckets)), _KINDS), partitions)
    found = settle(sent.mapInArrow(tidy(_repeats(buckets)), f"{_SPAN_COLUMNS}, {_KINDS}"), "spans", BATCH)
    spans = found.where("doc_id is not null").select("doc_id", "start", "end")
    if any_hot:
        again = _dealt(found.where("block is not null").select("bucket", "kind", "block"), partitions)
        again = settle(again.mapInArrow(tidy(_repeats(buckets)), f"{_SPAN_COLUMNS}, {_KINDS}"), "hot-spans", BATCH)
        spans = spans.union(again.where("doc_id is not null").select("doc_id", "start", "end"))
    return spans


def _clashes(light: DataFrame) -> DataFrame:
    """(doc_id, sha, part): the place of each different text of an id that has several."""
    ids = light.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("sha")).alias("shas")).where("size(shas) > 1")
    return settle(ids.select("doc_id", F.posexplode("shas").alias("part", "sha")), "id-clashes")


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and kept (binary) if with_text.

    Ids are whole numbers. Rows of one id are one document: they lose nothing for each other's sake, each loses what
    smaller ids have, and equal rows have equal results. A row without an id neither loses bytes nor makes others lose any.
    Null texts are empty. Texts shorter than LENGTH bytes stay as they are. An empty table gives an empty result.
    """
    source = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("t"))
    light = settle(source.select("doc_id", F.length("t").cast("bigint").alias("n_bytes"), F.sha2("t", 256).alias("sha")), "texts")
    clash = _clashes(light)
    if clash.isEmpty():
        same = ["doc_id"]
        parted = lambda df: df.withColumn("part", F.lit(0))
    else:
        same = ["doc_id", "sha"]
        parted = lambda df: (df if "sha" in df.columns else df.withColumn("sha", F.sha2("t", 256))).join(few(clash), same, "left").withColumn("part", F.coalesce("part", F.lit(0)))
    least = light.where(f"doc_id is not null and n_bytes >= {LENGTH}").groupBy("sha", "n_bytes").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("most > least")
    least = settle(least.drop("most"), "copies")
    copies = settle(light.join(few(least), ["sha", "n_bytes"]).where("doc_id > least").select("doc_id", "sha").distinct(), "later-copies")
    long = parted(source.where(f"doc_id is not null and length(t) >= {LENGTH}")).join(few(copies.select(*same)), same, "left_anti").select("doc_id", "part", "t")
    shared = _shared_anchors(long, light.agg(F.sum("n_bytes")).first()[0] or 0)
    _free(docs.sparkSession)
    spans = _repeated_spans(long, shared)
    _free(docs.sparkSession)
    ids = few(settle(spans.select("doc_id").distinct(), "ids"))
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = long.join(ids, "doc_id", "left_semi").join(by_doc, "doc_id").select("doc_id", "part", "t", "spans")
    cut = cut.mapInArrow(tidy(_cut), "doc_id bigint, part int, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    cut = (cut if with_text else cut.drop("kept")).dropDuplicates(["doc_id", "part"])
    base = light if not with_text else source.select("doc_id", F.length("t").cast("bigint").alias("n_bytes"), F.sha2("t", 256).alias("sha"), "t")
    base = parted(base).join(copies.withColumn("copy", F.lit(True)), ["doc_id", "sha"], "left").join(cut, ["doc_id", "part"], "left")
    whole = F.coalesce("copy", F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("bigint")
    return base.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "t")).alias("kept")] if with_text else []),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
#: The same by the least document of every window.
ORACLES = {"op3_suffix_dedup": f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (SELECT doc_id, i, h[2 * i + 1:2 * i + {2 * LENGTH}] AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM h WHERE length(h) >= {2 * LENGTH})
), gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id
), marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM gone
), numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked
), spans AS (SELECT doc_id, k, min(i) AS a, max(i) + {LENGTH} AS z FROM numbered GROUP BY ALL
), gaps AS (SELECT doc_id, k, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM spans
), cut AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY k) || substr(any_value(h), (2 * max(z) + 1)::BIGINT) AS kept FROM gaps JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM h LEFT JOIN cut USING (doc_id)
"""}
