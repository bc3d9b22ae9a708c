"""Token ids in binary files: independent zstandard frames with a trailing seek table.

File: data frames, an index in a skippable frame, and a seek table in the public zstd seekable layout (a skippable
frame of compressed size, content size and checksum per frame). A data frame holds whole documents: their number, ids,
token counts and then all their token ids, two bytes each where the vocabulary allows it. A reader finds a document's
frame in the index, decompresses that frame alone and checks it by the seek table's checksum (low half of XXH64).

Documents are range-partitioned by id, or by an order given (of training, say), a file per partition under a name of its
own, so a repeated task leaves only an orphan that no manifest names. A frame's index entry has its least and greatest id.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import fresh_path, kept, settle, table, tidy, trim

END_ID = 2
#: Stands in the files for a missing document id; such documents come first.
NO_ID = -(1 << 63)
#: Bytes of token ids in a frame, about; a longer document has a frame of its own.
FRAME_BYTES = 1 << 18
LEVEL = 1
#: Bytes of text in a file at most, about.
FILE_TEXT = 1 << 28
#: Space-separated pieces, and characters of them, that a worker remembers the ids of; then it forgets them all. A text with a
#: longer piece goes to the library whole.
MOST_KNOWN, MOST_CHARS, LONGEST_PIECE = 600_000, 1 << 24, 200
NEAR = 8_000
#: Stands before a text's first piece; no text holds a lone surrogate.
_START = "\ud800"
_PLAIN = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,!?:;]?")
_SKIP_INDEX, _SKIP_SEEK, _SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_INDEX = struct.Struct("<qqQI")
_ENTRY = struct.Struct("<III")
_TAIL = struct.Struct("<IBI")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The tokenizers library over whole texts, with the ids of recurring pieces remembered.

    The byte-level pattern never joins a space to what stands before it, nor a line's end to what stands on either side,
    except inside a run of white space; so a text without such runs is the sum of its pieces split before each space and
    around each line's end. Other texts, those in which white space of any kind follows a line's end and those that hold an
    added token's string among them, go to the library whole. A new piece that is a plain word goes straight to the library's model: the pattern would split it at most before its
    last mark, across which no token of the vocabulary reaches.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pattern = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        self.splits = pattern.get("type") == "ByteLevel" and pattern.get("use_regex") and not pattern.get("add_prefix_space") and self.tokenizer.normalizer is None
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (k for k in range(256) if k not in plain)
        self.letters = {k: chr(k) for k in plain} | {k: chr(256 + n) for n, k in enumerate(rest)}
        # a token that holds the end of a Latin-1 letter and a mark after it
        across = re.compile(r"([A-Za-z]|\u00c3.|^[^\x21-\x7e\u0120])[.,!?:;]")
        self.plain = None if any(map(across.search, self.tokenizer.get_vocab())) else _PLAIN
        self.forget()

    def forget(self) -> None:
        self.near: dict[str, int] = {}  # the first batch's commonest: small enough for a processor's cache
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.begin, self.size, self.risky = (np.zeros(1 << 14, dtype=t) for t in (np.int64, np.int64, bool))
        self.used = self.chars = 0

    def _learn(self, new: list[str]) -> None:
        """Numbers the pieces in an order of its own."""
        plain = list(filter(self.plain.fullmatch, new)) if self.plain else []
        chosen = set(plain)
        other = [p for p in new if p not in chosen]
        ids: list[int] = []
        sizes: list[int] = []
        if plain:
            tokenize = self.tokenizer.model.tokenize
            for word in "\x00".join(plain).encode().decode("latin1").translate(self.letters).split(self.letters[0]):
                tokens = tokenize(word)
                ids += [t.id for t in tokens]
                sizes.append(len(tokens))
        if other:
            encoded = self.tokenizer.encode([p.removeprefix(_START) for p in other], is_pretokenized=True, add_special_tokens=False)
            ids += encoded.ids
            sizes += np.bincount(np.array(encoded.word_ids, dtype=np.int64), minlength=len(other)).tolist()
        pieces, first, more = plain + other, len(self.known), len(ids)
        while self.used + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while first + len(pieces) > len(self.begin):
            self.begin, self.size, self.risky = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.risky))
        last, n = first + len(pieces), np.array(sizes, dtype=np.int64)
        self.ids[self.used : self.used + more] = ids
        self.begin[first:last], self.size[first:last] = self.used + np.cumsum(n) - n, n
        self.risky[first + len(plain) : last] = [p != "\n" and (p in ("", " ") or p[-1].isspace() or (p[0].isspace() and p[0] != " ")) for p in other]
        self.used += more
        self.chars += sum(map(len, pieces))
        self.known.update(zip(pieces, range(first, last), strict=True))

    def _places(self, pieces: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.near.get, pieces, itertools.repeat(-1)), dtype=np.int64, count=len(pieces))
        missed = np.flatnonzero(at < 0)
        rest = list(itertools.compress(pieces, (at < 0).tolist()))
        found = np.fromiter(map(self.known.get, rest, itertools.repeat(-1)), dtype=np.int64, count=len(rest))
        if (found < 0).any():
            fresh = list(itertools.compress(rest, (found < 0).tolist()))
            self._learn(list(dict.fromkeys(fresh)))
            found[found < 0] = np.fromiter(map(self.known.__getitem__, fresh), dtype=np.int64, count=len(fresh))
        at[missed] = found
        if not self.near:
            self.near = {p: self.known[p] for p, _ in Counter(pieces).most_common(NEAR)}
        return at

    def _split(self, text: str) -> list[str]:
        """A text's pieces: a line's end alone, and what stands between spaces, each with the space before it. A text that
        can't be split is one empty piece, which is risky."""
        if "\x1f" in text or any(a in text for a in self.added):
            return [""]
        pieces = text.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f").split("\x1f")
        if max(map(len, pieces)) > LONGEST_PIECE:
            return [""]
        pieces[0] = _START + pieces[0]
        return pieces

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        if not self.splits:
            return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(list(texts), add_special_tokens=False)]
        if len(self.known) > MOST_KNOWN or self.chars > MOST_CHARS:
            self.forget()
        split = list(map(self._split, texts))
        at = self._places(list(itertools.chain.from_iterable(split)))
        sizes = self.size[at]
        shift = self.begin[at] - (np.cumsum(sizes) - sizes)
        flat = self.ids[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]
        ends = np.cumsum([len(s) for s in split])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        risky = np.concatenate([[0], np.cumsum(self.risky[at])])
        out = []
        for t, a, b in zip(texts, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            whole = risky[b] == risky[a]  # else a run of white space may be torn
            out.append(flat[upto[a] : upto[b]] if whole else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32))
        return out


@kept
def encoder(path: str) -> Encoder:
    return Encoder(path)


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder or file that all executors share."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


class Writer:
    """Writes documents in the order given; close() adds index and seek table."""

    def __init__(self, out, wide: bool):
        self.out, self.kind = out, "<u4" if wide else "<u2"
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.index: list[tuple] = []
        self.seek: list[tuple] = []
        self.tokens = self.docs = 0
        self._start()

    def _start(self) -> None:
        self.ids: list[int] = []
        self.parts: list[np.ndarray] = []
        self.pending = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.parts.append(ids)
        self.pending += ids.nbytes
        if self.pending >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.ids:
            return
        head = struct.pack("<I", len(self.ids)) + np.array(self.ids, dtype="<i8").tobytes() + np.array([len(p) for p in self.parts], dtype="<u8").tobytes()
        content = head + np.concatenate(self.parts).astype(self.kind).tobytes()
        frame = self.zstd.compress(content)
        self.index.append((min(self.ids), max(self.ids), self.tokens, len(self.ids)))
        self.seek.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.tokens += sum(map(len, self.parts))
        self.docs += len(self.ids)
        self.out.write(frame)
        self._start()

    def close(self) -> None:
        self.flush()
        index = struct.pack("<I", 4 if self.kind == "<u4" else 2) + b"".join(_INDEX.pack(*x) for x in self.index)
        self.out.write(struct.pack("<II", _SKIP_INDEX, len(index)) + index)
        table = b"".join(_ENTRY.pack(*x) for x in self.seek) + _TAIL.pack(len(self.seek), 0x80, _SEEK_END)
        self.out.write(struct.pack("<II", _SKIP_SEEK, len(table)) + table)


@dataclass
class Frame:
    at: int
    size: int
    content: int
    checksum: int
    first: int
    last: int
    start: int
    docs: int


class Reader:
    """Random access to a file; source has size() and read_at(n, offset)."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, flags, magic = _TAIL.unpack(source.read_at(_TAIL.size, end - _TAIL.size))
        if magic != _SEEK_END or flags != 0x80:
            raise ValueError("no seek table")
        at = end - _TAIL.size - n * _ENTRY.size
        seek = list(_ENTRY.iter_unpack(source.read_at(n * _ENTRY.size, at)))
        data = sum(s[0] for s in seek)
        magic, size = struct.unpack("<II", source.read_at(8, data))
        if magic != _SKIP_INDEX or size != 4 + n * _INDEX.size:
            raise ValueError("no index")
        raw = source.read_at(size, data + 8)
        self.width = struct.unpack_from("<I", raw)[0]
        places = itertools.accumulate((s[0] for s in seek), initial=0)
        self.frames = [Frame(p, *s, *x) for p, s, x in zip(places, seek, _INDEX.iter_unpack(raw[4:]), strict=False)]

    def documents(self, frame: Frame) -> Iterator[tuple[int, int, np.ndarray]]:
        """(id, start in this file, token ids) of a frame's documents."""
        content = zstandard.ZstdDecompressor().decompress(self.source.read_at(frame.size, frame.at), max_output_size=frame.content)
        if len(content) != frame.content or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != frame.checksum:
            raise ValueError(f"frame at {frame.at} is damaged")
        n = struct.unpack_from("<I", content)[0]
        ids = np.frombuffer(content, "<i8", n, 4)
        sizes = np.frombuffer(content, "<u8", n, 4 + 8 * n).astype(np.int64)
        tokens = np.frombuffer(content, f"<u{self.width}", offset=4 + 16 * n)
        ends = np.cumsum(sizes)
        for d, a, b in zip(ids, ends - sizes, ends, strict=True):
            yield int(d), frame.start + int(a), tokens[a:b]

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The token ids of every document with this id; only frames that may hold it are read."""
        return [t for f in self.frames if f.first <= doc_id <= f.last for d, _, t in self.documents(f) if d == doc_id]


def open_reader(uri: str) -> Reader:
    fs, path = store(uri)

    class Source:
        def __init__(self):
            self.file = fs.open_input_file(path)
            self.size = self.file.size
            self.read_at = self.file.read_at

    return Reader(Source())


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, id: str = "doc_id", text: str = "text", order: Sequence[Column] = ()) -> DataFrame:
    """Writes the files under folder and returns their manifest (part, path, docs, tokens), settled. Documents stand by
    `order`, if it is given, then by id.

    Null texts are empty: the end id alone. Rows without an id come first and keep a null id. Rows with one id stand by a
    hash of their texts; an empty table writes no file. Other columns are ignored."""
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.coalesce(F.col(f"`{id}`").cast("bigint"), F.lit(NO_ID)).alias("i"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), *[c.alias(f"k{n}") for n, c in enumerate(order)])
    by = [*[f"k{n}" for n in range(len(order))], "i", "o"]
    files = -(-(docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0) // FILE_TEXT)
    more = [files] if files > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    rows = rows.withColumn("o", F.xxhash64("t")).repartitionByRange(*more, *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, writer = encoder(tokenizer), None, None
        part = TaskContext.get().partitionId()
        uri = f"{folder}/tokens-{part:05d}-{uuid.uuid4().hex}.zst"
        fs, path = store(uri)
        end = np.array([end_id], dtype=np.uint32)
        for b in batches:
            if b.num_rows and out is None:
                fs.create_dir(os.path.dirname(path), recursive=True)
                out = fs.open_output_stream(path, compression=None)
                writer = Writer(out, enc.wide)
            ids = b.column(0).to_pylist()
            for lo, hi in _runs(b.column(1)):
                for d, tokens in zip(ids[lo:hi], enc.encode(b.column(1)[lo:hi].to_pylist()), strict=True):
                    writer.add(d, np.concatenate([tokens, end]))
            trim()  # lists of pieces take many times their text
        if out is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [uri], "docs": pa.array([writer.docs], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64())})

    return settle(rows.select("i", "t").mapInArrow(tidy(run, encoder), "part int, path string, docs bigint, tokens bigint"), "token-manifest")


def _runs(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about `most` bytes together."""
    sizes = np.array([len(t.as_buffer()) for t in texts.cast(pa.large_binary())], dtype=np.int64)
    lo = 0
    while lo < len(sizes):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + 4096]), most, side="right")))
        yield lo, min(hi, len(sizes))
        lo = hi


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the manifest's files, read frame by frame."""
    n = max(1, manifest.count())
    base = F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")  # one row per file
    files = manifest.select("path", base.alias("base")).repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = open_reader(path)
                for group in itertools.batched(reader.frames, 16):
                    rows = [(None if d == NO_ID else d, base + at, len(t), zlib.crc32(t.astype("<u4").tobytes())) for f in group for d, at, t in reader.documents(f)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(tidy(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_digest(spark: SparkSession, docs: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    return read_tokens(write_tokens(docs, fresh_path(spark, "tokens"), order=order))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return token_digest(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_token_output": op9_token_output}
ORACLES: dict[str, str] = {}
