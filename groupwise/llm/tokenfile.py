"""Token-id files: patched frame-of-reference blocks.

A file is a Parquet table of segments, each some hundred documents in order of id. A
segment's ``ids`` blob holds, little-endian unless said otherwise:

    magic "PFR1", ids u32, blocks u32, block starts u32 each (bytes from the end of this index)
    per block of BLOCK ids: minimum u32, width u8, exceptions u16,
        (id - minimum) of all ids, ``width`` bits each, high bit first, exceptions as 0,
        positions u16 and differences u32 of the exceptions

The width is that of the PERCENTILE-th difference by size, so rare large ids cost an
exception entry and not a wider block. Block starts give any block without reading others.

Range partitioning by id keeps the order without one task seeing all; each part records how
many ids stand before its segments, and only one sum per part is cumulated over parts.

Defined results: null text encodes as empty and still has its end id; null ids come first;
rows with one id are in order of a hash of their text; an empty table makes an empty file.
Other columns are not read.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _OTHER_SPACE, CACHE, TEXTS, Codec, Vocabulary, laid

BLOCK = 4096
PERCENTILE = 95
#: Words encoded in one call; bounds the text and the ids held at a time.
RUN = 10_000
#: Bytes of text encoded together, or one text if it has more; bounds the words held at a time.
GROUP = 1 << 23
#: Ids remembered, which bounds long chunks as CACHE bounds their number.
IDS = 8 * CACHE
MAGIC = b"PFR1"
SEGMENT = "part int, base long, n_ids long, doc_ids array<bigint>, sizes array<bigint>, ids binary"


def _pack(values: np.ndarray, width: int) -> bytes:
    wide = 16 if width <= 16 else 32
    bits = np.unpackbits(values.astype(f">u{wide // 8}").view(np.uint8)).reshape(-1, wide)
    return np.packbits(bits[:, wide - width :]).tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    wide = 16 if width <= 16 else 32
    bits = np.zeros((n, wide), np.uint8)
    bits[:, wide - width :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(bits).view(f">u{wide // 8}").astype(np.uint32)


def pack_ids(ids: np.ndarray) -> bytes:
    """One segment's blob."""
    blocks, starts, at = [], [], 0
    for i in range(0, len(ids), BLOCK):
        part = ids[i : i + BLOCK].astype(np.uint32)
        least = int(part.min())
        over = part - np.uint32(least)
        width = int(np.partition(over, k := min(len(over) - 1, len(over) * PERCENTILE // 100))[k]).bit_length()
        odd = np.flatnonzero(over >> width) if width < 32 else np.empty(0, np.int64)
        kept = over.copy()
        kept[odd] = 0
        block = struct.pack("<IBH", least, width, len(odd)) + (_pack(kept, width) if width else b"") + odd.astype("<u2").tobytes() + over[odd].astype("<u4").tobytes()
        blocks.append(block)
        starts.append(at)
        at += len(block)
    return MAGIC + struct.pack("<II", len(ids), len(blocks)) + np.array(starts, "<u4").tobytes() + b"".join(blocks)


def block_ids(blob: bytes, k: int) -> np.ndarray:
    """Ids of block ``k`` alone."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token-id segment")
    n, blocks = struct.unpack_from("<II", blob, 4)
    size = min(BLOCK, n - k * BLOCK)
    at = 12 + 4 * blocks + struct.unpack_from("<I", blob, 12 + 4 * k)[0]
    least, width, odd = struct.unpack_from("<IBH", blob, at)
    at += 7
    end = at + (size * width + 7) // 8
    out = _unpack(blob[at:end], size, width) if width else np.zeros(size, np.uint32)
    where = np.frombuffer(blob, "<u2", odd, end)
    out[where] = np.frombuffer(blob, "<u4", odd, end + 2 * odd)
    return out + np.uint32(least)


def unpack_ids(blob: bytes) -> np.ndarray:
    blocks = struct.unpack_from("<I", blob, 8)[0]
    return np.concatenate([block_ids(blob, k) for k in range(blocks)]) if blocks else np.empty(0, np.uint32)


def solver(encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes]) -> Callable:
    """``solve`` of a Codec, by the library's ``encode`` of many texts.

    A call has a cost of its own, so words of letters and digits alone are encoded RUN at a
    time: those after a space as one text, since the pattern always cuts before a space that
    stands between two of them, and those without with a line feed between, which is a piece
    and a token of its own there. Other words are encoded one by one.
    """
    opens = np.fromiter((t[:1] == b" " for t in token_bytes), bool, len(token_bytes))
    feed = token_bytes.index(b"\n")

    def together(head: str, run: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.array(encode([head + (head or "\n").join(run)])[0], np.uint32)
        if head:
            starts = np.flatnonzero(opens[flat])
        else:
            feeds = np.flatnonzero(flat == feed)
            flat = np.delete(flat, feeds)
            starts = np.concatenate([[0], feeds - np.arange(len(feeds))])
        if len(starts) != len(run):
            raise ValueError("a token lies across two words")
        return flat, np.concatenate([starts[1:], [len(flat)]])

    def solve(head: str, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        whole = [w for w in words if w.isalnum()]
        odd = [w for w in words if not w.isalnum()]
        found = [together(head, whole[i : i + RUN]) for i in range(0, len(whole), RUN)]
        found.append(laid(encode([head + w for w in odd])))
        before = np.cumsum([0, *(len(flat) for flat, _ in found)])
        return whole + odd, np.concatenate([flat for flat, _ in found]), np.concatenate([ends + at for (_, ends), at in zip(found, before)])

    return solve


def _picked(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, end to end."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return flat[at]


class Store:
    """Lists of ids by number, in arrays that double as they fill; ``uses`` is for the caller to count."""

    def __init__(self):
        self.n, self.flat, self.ends, self.uses = 0, np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def add(self, flat: np.ndarray, ends: np.ndarray) -> range:
        """Take in the lists that end at ``ends`` of ``flat``; their numbers."""
        at, n = int(self.ends[self.n]), self.n + len(ends)
        self.flat, self.ends, self.uses = self._room(self.flat, at + len(flat)), self._room(self.ends, n + 1), self._room(self.uses, n)
        self.flat[at : at + len(flat)] = flat
        self.ends[self.n + 1 : n + 1] = ends + at
        before, self.n = self.n, n
        return range(before, n)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])

    def __getitem__(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the lists of these numbers end to end, and how many each has."""
        starts = self.ends[numbers]
        sizes = self.ends[numbers + 1] - starts
        return _picked(self.flat, starts, sizes), sizes


class Encoder(Codec):
    """Encodes many texts at once; each different chunk between spaces is looked up once for all of them.

    Texts where cutting at spaces isn't safe, or with special tokens, are cut by the pattern, one
    by one. Of the chunks remembered, those found again and again outlast the others.
    """

    def __init__(self, vocabulary: Vocabulary, solve: Callable):
        super().__init__(vocabulary, solve)
        space = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _OTHER_SPACE) + "]"
        self.loose = f"^ | $|  | {space}|{space} "
        self.known = ({}, {})  # numbers of chunks after a space, and as they are
        self.store = self._specials()

    def _specials(self) -> Store:
        """A store whose first lists are the special tokens."""
        store = Store()
        store.add(*laid([[i] for i in self.v.special.values()]))
        return store

    def _forget(self) -> None:
        """Keep only the chunks found in most groups of texts, half of CACHE and of IDS at most."""
        old, self.store = self.store, self._specials()
        numbers = [np.fromiter(known.values(), np.int64, len(known)) for known in self.known]
        every = np.concatenate(numbers)
        uses, sizes, least = old.uses[every], old.ends[every + 1] - old.ends[every], 0
        for weights, most in ((np.ones(len(every)), CACHE // 2), (sizes, IDS // 2)):
            as_often = np.bincount(uses, weights)[::-1].cumsum()[::-1]  # of chunks with so many uses or more
            least = max(least, int(np.searchsorted(-as_often, -most)))
        for known, of in zip(self.known, numbers):
            keep = old.uses[of] >= least
            words, of = list(compress(known, keep.tolist())), of[keep]
            flat, sizes = old[of]
            now = self.store.add(flat, np.cumsum(sizes))
            self.store.uses[now.start : now.stop] = old.uses[of] // 2
            known.clear()
            known.update(zip(words, now))

    def _learn_words(self, spaced: set[str], plain: set[str]) -> None:
        """Take in single pieces of the pattern, after a space and as they are."""
        for known, head, some in zip(self.known, (" ", ""), (spaced, plain)):
            if some := some.difference(known):
                order, flat, ends = self.solve(head, list(some))
                known.update(zip(order, self.store.add(flat, ends)))

    def _pieces(self, words: list[str]) -> np.ndarray:
        """Numbers of single pieces, their spaces included."""
        after, alone = self.known
        behind = np.fromiter((w[0] == " " for w in words), bool, len(words))
        spaced, plain = [w[1:] for w in words if w[0] == " "], [w for w in words if w[0] != " "]
        self._learn_words(set(spaced), set(plain))
        out = np.empty(len(words), np.int64)
        out[behind] = np.fromiter(map(after.__getitem__, spaced), np.int64, len(spaced))
        out[~behind] = np.fromiter(map(alone.__getitem__, plain), np.int64, len(plain))
        self.store.uses[out] += 1
        return out

    def _learn(self, spaced: list[str], plain: list[str]) -> None:
        """Take in chunks after a space, cut as one text since the pattern cuts before each of the spaces, and as they are."""
        self._learn_words({c for c in spaced if c.isalpha()}, set())
        spaced = [c for c in spaced if not c.isalpha()]
        words = self.v.pattern.findall(" ".join(["", *spaced]))
        cuts = [k for k, w in enumerate(words) if w[0] == " "]
        if len(cuts) != len(spaced):
            raise ValueError("a piece lies across two chunks")
        for c in plain:
            cuts.append(len(words))
            words += self.v.pattern.findall(c)
        flat, sizes = self.store[self._pieces(words)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[[*cuts[1:], len(words)]]
        numbers = self.store.add(flat, ends)
        self.known[0].update(zip(spaced, numbers))
        self.known[1].update(zip(plain, numbers[len(spaced) :]))

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chunks of all texts, which are cut at spaces, and how many each text has."""
        after, alone = self.known
        cut = pc.split_pattern(texts, pattern=" ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        codes, chunks = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts = offsets[:-1]
        behind = np.ones(len(codes), bool)
        behind[firsts] = False
        used = np.zeros(len(chunks), bool)
        used[codes[behind]] = True
        used = np.flatnonzero(used)
        spaced = chunks if len(used) == len(chunks) else [chunks[k] for k in used.tolist()]
        plain = [chunks[k] for k in codes[firsts].tolist()]
        number = np.fromiter(map(after.get, spaced, repeat(-1)), np.int64, len(spaced))
        new = np.flatnonzero(number < 0)
        unknown = [spaced[k] for k in new.tolist()]
        if unknown or not alone.keys() >= set(plain):
            self._learn(unknown, list(set(plain).difference(alone)))
            number[new] = list(map(after.__getitem__, unknown))
        numbers = np.zeros(len(chunks), np.int64)
        numbers[used] = number
        out = numbers[codes]
        out[firsts] = first = np.fromiter(map(alone.__getitem__, plain), np.int64, len(plain))
        for seen in (number, first):
            self.store.uses[seen] += 1
        return out, np.diff(offsets)

    def _piecewise(self, text: str) -> np.ndarray:
        """Numbers of the pieces and special tokens of one text."""
        special = {i: k for k, i in enumerate(self.v.special.values())}
        out = []
        for part in self._parts(text):
            if isinstance(part, str):
                out.append(self._pieces(self.v.pattern.findall(part)))
            else:
                out.append(np.array([special[part]]))
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) end to end, and how many each has."""
        if max(map(len, self.known)) > CACHE or self.store.ends[self.store.n] > IDS:
            self._forget()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.loose)
        for s in self.v.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        numbers, counts = self._cut(texts.filter(pc.invert(odd)))
        if odd.true_count:
            odd = odd.to_numpy(zero_copy_only=False)
            pieces = [self._piecewise(t) for t in texts.filter(odd).to_pylist()]
            cut, counts, chunks = counts, np.empty(len(odd), np.int64), numbers
            counts[~odd], counts[odd] = cut, list(map(len, pieces))
            whose = np.repeat(odd, counts)
            numbers = np.empty(len(whose), np.int64)
            numbers[~whose], numbers[whose] = chunks, np.concatenate(pieces)
        flat, sizes = self.store[numbers]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return flat, np.diff(before[np.concatenate([[0], np.cumsum(counts)])])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        flat, sizes = self.encode_all(pa.array(texts, pa.string()))
        yield from np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else ()


@lru_cache(2)
def library_codec(path: str) -> Encoder:
    """The worker's codec whose words are encoded by the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    v = Vocabulary(path, merging=False)

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    return Encoder(v, solver(encode, v.token_bytes))


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts of a batch that hold GROUP bytes of text or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP, "right")))
        yield at, stop - at
        at = stop


def write(docs: DataFrame, out: str, path: str, end_id: int = 0) -> None:
    """Encode ``docs`` and write their ids, ``end_id`` after each document, as token-id files in ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, base = library_codec(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, n in _groups(batch.column(1)):
                group = batch.slice(first, n)
                ids, sizes = codec.encode_all(group.column(1))
                ends = np.cumsum(sizes)
                flat = np.insert(ids, ends, end_id)
                sizes = sizes + 1
                ends = np.concatenate([[0], np.cumsum(sizes)])
                for at in range(0, n, TEXTS):
                    own = flat[ends[at] : ends[min(at + TEXTS, n)]]
                    rows = group.column(0).slice(at, TEXTS).to_pylist()
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "base": [base], "n_ids": [len(own)], "doc_ids": pa.array([rows], pa.list_(pa.int64())), "sizes": pa.array([sizes[at : at + TEXTS]], pa.list_(pa.int64())), "ids": pa.array([pack_ids(own)], pa.binary())})
                    base += len(own)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    # the hash is part of the ranges, so that rows of one id, or of none, are many tasks' work
    ordered = rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th")
    ordered.select("doc_id", "text").mapInArrow(run, SEGMENT).write.option("compression", "none").parquet(out)


def _documents(segments: DataFrame) -> DataFrame:
    """(part, doc_id, local, n_tokens, ids) of every document; ``local`` counts from the start of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, base, _, doc_ids, sizes, blob = (batch.column(c)[k] for c in range(6))
                ids = unpack_ids(blob.as_buffer()).astype("<u4")
                sizes = sizes.values
                size = sizes.to_numpy(zero_copy_only=False)
                ends = np.cumsum(size)
                cut = pa.array(np.concatenate([[0], ends * 4]).astype(np.int32)).buffers()[1]
                blobs = pa.Array.from_buffers(pa.binary(), len(ends), [None, cut, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(ends), part.as_py(), np.int32)), "doc_id": doc_ids.values, "local": pa.array(ends - size + base.as_py()), "n_tokens": sizes, "ids": blobs})

    return segments.mapInArrow(run, "part int, doc_id long, local long, n_tokens long, ids binary")


def _started(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """``docs`` with ``start``, the ids of all documents before, in place of ``local`` and ``part``."""
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.groupBy(F.col("part").alias("of")).agg(F.sum("n_ids").alias("ids_here")).select("of", F.coalesce(F.sum("ids_here").over(before), F.lit(0)).alias("offset"))
    return docs.join(offsets, docs["part"] == offsets["of"]).withColumn("start", F.col("offset") + F.col("local")).drop("of", "offset", "local", "part")


def read(spark: SparkSession, source: str) -> DataFrame:
    """(doc_id, n_tokens, ids, start) of every document in the files in ``source``; ids as little-endian u32."""
    segments = spark.read.schema(SEGMENT).parquet(source)
    return _started(_documents(segments), segments)


def digests(spark: SparkSession, source: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files in ``source``; digests move between tasks, ids don't."""
    segments = spark.read.schema(SEGMENT).parquet(source)
    hashed = _documents(segments).select("part", "doc_id", "local", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return _started(hashed, segments).select("doc_id", "start", "n_tokens", "ids_crc32")
