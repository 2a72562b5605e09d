"""Byte-level BPE encoding and decoding by speculation and verification.

A word's greedy longest match over the vocabulary is only a guess. BPE keeps a sequence of
tokens exactly if each token encodes to itself and no merge crosses any of its adjacent
pairs, so all distinct pairs of a batch are tested at once over arrays: the right edge of
the first token passes through the pieces of its right spine, the left edge of the second
through its left spine, and a merge of two pieces that coexist at its rank breaks the pair
(at equal ranks the merge further left comes first). Words with a broken pair, and those
alone, are merged exactly.

Words are runs between single spaces and are remembered up to CACHE entries in each worker,
then forgotten together, so memory stays bounded. Texts where a space touches other white
space are cut by the whole pre-tokenisation pattern instead.

Defined results: null text encodes as empty; strings of special tokens become their ids, as
the tokenizers library does by default; decoding replaces what isn't UTF-8 by U+FFFD and
skips ids outside the vocabulary. Repeated rows, ties and other columns are of no matter.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 800_000
#: Words of more bytes than this are guessed, and where broken merged, one by one.
SHORT = 48
#: Fixed value: marks that often end a word; any of them after letters is a piece of its own.
MARKS = frozenset(",.;:!?")
#: Texts encoded together; bounds the words held at a time.
TEXTS = 256
NEVER = 1 << 30
#: White space of the pattern other than the space itself.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c != " " and regex.match(r"\s", c)]


def _loose(part: str) -> bool:
    """Whether a space stands at an end or beside other white space, so that cutting at spaces isn't safe."""
    if part[0] == " " or part[-1] == " " or "  " in part:
        return True
    return any(f" {c}" in part or f"{c} " in part for c in _OTHER_SPACE if c in part)


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Table:
    """A read-only map of int64 keys to ints, looked up over arrays; -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, self.reach = self._slot(keys), 0
        left = np.arange(len(keys))
        while len(left):
            self.reach += 1
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], -1)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        for _ in range(self.reach):
            if not len(left):
                break
            slot[left] = slot[left] + 1 & self.mask
            seen = self.keys[slot[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out


class Vocabulary:
    """Tokens, merge ranks and spines of one vocabulary file of the tokenizers library.

    With ``merging`` False only what cuts texts and decodes ids is read in.
    """

    def __init__(self, path: str, merging: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, model = byte_chars(), spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(chars[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.pattern = regex.compile(PATTERN)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        if merging:
            self._merging(ids, model["merges"], size)

    def _merging(self, ids: dict[str, int], merges: list, size: int) -> None:
        self.ids = {self.token_bytes[i]: i for i in ids.values()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        rank = np.full(size, -1, np.int64)
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = ids[a], ids[b], ids[a + b]
            self.merges[x, y] = (r, z)
            if rank[z] < 0:
                rank[z], left[z], right[z] = r, x, y
        pairs = np.fromiter((x << 32 | y for x, y in self.merges), np.int64, len(self.merges))
        self.pair_rank = Table(pairs, np.fromiter((r for r, _ in self.merges.values()), np.int32, len(self.merges)))
        self.product = np.fromiter((z for _, z in self.merges.values()), np.int64, len(self.merges))
        self.right_spine = self._spine(right, rank)
        self.left_spine = self._spine(left, rank)
        self._trie()

    @staticmethod
    def _spine(child: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Levels of (piece, rank of the merge that ends it) from each whole token inwards; piece -1 past the end."""
        piece, ends = np.arange(len(child)), np.full(len(child), NEVER)
        levels = []
        while (piece >= 0).any():
            levels.append((piece, ends))
            at = np.maximum(piece, 0)
            piece, ends = np.where(piece >= 0, child[at], -1), np.where(piece >= 0, rank[at], -1)
        return levels

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether no merge crosses from each ``first`` token into its ``second``."""
        good = np.ones(len(first), bool)
        for x_piece, x_ends in self.right_spine:
            x, xe = x_piece[first], x_ends[first]
            if not (x >= 0).any():
                break
            for y_piece, y_ends in self.left_spine:
                y, ye = y_piece[second], y_ends[second]
                live = np.flatnonzero(good & (x >= 0) & (y >= 0))
                if not len(live):
                    break
                r = self.pair_rank[x[live] << 32 | y[live]]
                good[live[(r >= 0) & (r < xe[live]) & (r <= ye[live])]] = False
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one word: the lowest rank first, leftmost among equals."""
        parts = [self.byte_ids[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merges.get
        heap = [(m[0], i, parts[i], parts[i + 1], m[1]) for i in range(n - 1) if (m := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:
                continue
            parts[i], parts[j] = z, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := get((z, parts[k])):
                    heapq.heappush(heap, (m[0], i, z, parts[k], m[1]))
            h = before[i]
            if h >= 0 and (m := get((parts[h], z))):
                heapq.heappush(heap, (m[0], h, parts[h], z, m[1]))
        return [p for p in parts if p >= 0]

    def _trie(self) -> None:
        """Byte transitions of all tokens that merging gives back for their own bytes; others are never proposed."""
        nodes: dict[bytes, int] = {b"": 0}
        ends = {0: -1}
        edges: dict[int, int] = {}
        for t, i in self.ids.items():
            if len(t) > 1 and self.merge(t) != [i]:
                continue
            for n in range(1, len(t) + 1):
                if t[:n] not in nodes:
                    nodes[t[:n]] = len(nodes)
                    edges[nodes[t[: n - 1]] << 8 | t[n - 1]] = nodes[t[:n]]
            ends[nodes[t]] = i
        self.edges = edges
        self.edge = Table(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.token_at = np.full(len(nodes), -1, np.int64)
        self.token_at[list(ends)] = list(ends.values())

    def greedy(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest match, again and again, of all words at once: word, first byte and token of each guess, in order."""
        word, at = np.arange(len(start)), start.copy()
        node, began, best, stop = np.zeros(len(start), np.int64), start.copy(), np.full(len(start), -1), start.copy()
        out = []
        while len(word):
            inside = at < end[word]
            child = np.full(len(word), -1, np.int64)
            child[inside] = self.edge[node[inside] << 8 | flat[at[inside]]]
            alive = child >= 0
            node = np.where(alive, child, 0)
            at = np.where(alive, at + 1, stop)
            token = self.token_at[node]
            full = alive & (token >= 0)
            best, stop = np.where(full, token, best), np.where(full, at, stop)
            if not alive.all():
                dead = ~alive
                out.append((word[dead], began[dead], best[dead]))
                began = np.where(dead, stop, began)
                more = alive | (stop < end[word])
                word, at, node, began, best, stop = word[more], at[more], node[more], began[more], best[more], stop[more]
        words, first, token = map(np.concatenate, zip(*out))
        order = np.argsort(first, kind="stable")
        return words[order], first[order], token[order]

    def longest(self, word: bytes) -> list[int]:
        """Longest match, again and again, of one long word, which in arrays would hold up all others."""
        out, at, get, token_at = [], 0, self.edges.get, self.token_at
        while at < len(word):
            node, best, stop = 0, -1, at
            for here in range(at, len(word)):
                if (child := get(node << 8 | word[here])) is None:
                    break
                node = child
                if token_at[node] >= 0:
                    best, stop = int(token_at[node]), here + 1
            out.append(best)
            at = stop
        return out

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact BPE of short words, one merge of each at a time."""
        size = np.array([len(w) for w in words])
        out: list[list[int]] = [[]] * len(words)
        for low, high in ((0, 10), (10, 16), (16, 24), (24, SHORT)):
            rows = np.flatnonzero((size > low) & (size <= high))
            if not len(rows):
                continue
            wide = int(size[rows].max())
            raw = np.frombuffer(b"".join(words[i].ljust(wide, b"\0") for i in rows.tolist()), np.uint8).reshape(-1, wide)
            part = np.where(np.arange(wide) < size[rows, None], np.array(self.byte_ids)[raw], -1)
            rank = np.full(part.shape, NEVER)
            rank[:, :-1] = self._ranks(part[:, :-1], part[:, 1:])
            live = np.arange(len(rows))
            done = part.copy()
            cols = np.arange(wide)
            while len(live):
                at = rank.argmin(1)
                least = rank[np.arange(len(live)), at]
                over = least >= NEVER
                if over.any():
                    done[live[over]] = part[over]
                    live, part, rank, at, least = live[~over], part[~over], rank[~over], at[~over], least[~over]
                    if not len(live):
                        break
                here = np.arange(len(live))
                part[here, at] = self.product[least]
                take = np.minimum(cols + (cols > at[:, None]), wide - 1)
                part, rank = np.take_along_axis(part, take, 1), np.take_along_axis(rank, take, 1)
                part[:, -1], rank[:, -1] = -1, NEVER
                rank[here, at] = self._ranks(part[here, at], part[here, np.minimum(at + 1, wide - 1)])
                rank[here[at == wide - 1], wide - 1] = NEVER
                before = here[at > 0]
                rank[before, at[before] - 1] = self._ranks(part[before, at[before] - 1], part[before, at[before]])
            for i, row in zip(rows.tolist(), done.tolist()):
                out[i] = row[: row.index(-1)] if row[-1] < 0 else row
        return out

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        pair = np.where((x >= 0) & (y >= 0), x << 32 | y, -2).ravel()
        r = self.pair_rank[pair].astype(np.int64)
        return np.where(r < 0, NEVER, r).reshape(x.shape)

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words: guesses, checked together, the broken ones merged exactly."""
        raw = [w.encode() for w in words]
        out: list[list[int]] = [[]] * len(raw)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        short = np.flatnonzero((size > 0) & (size <= SHORT))
        long = np.flatnonzero(size > SHORT)
        some = np.concatenate([short, long])
        if not len(some):
            return out
        owner, token = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(short):
            flat = np.frombuffer(b"".join(raw[i] for i in short.tolist()), np.uint8).astype(np.int64)
            end = np.cumsum(size[short])
            owner, _, token = self.greedy(flat, end - size[short], end)
        if len(long):
            guesses = [self.longest(raw[i]) for i in long.tolist()]
            owner = np.concatenate([owner, np.repeat(np.arange(len(short), len(some)), list(map(len, guesses)))])
            token = np.concatenate([token, *guesses])
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(token[inner] << 32 | token[inner + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        broken = np.unique(owner[inner[~good[back]]])
        cuts = np.searchsorted(owner, np.arange(len(some) + 1)).tolist()
        token = token.tolist()
        for k, i in enumerate(some.tolist()):
            out[i] = token[cuts[k] : cuts[k + 1]]
        again = some[broken]
        for i in again[size[again] > SHORT].tolist():
            out[i] = self.merge(raw[i])
        again = again[size[again] <= SHORT].tolist()
        for i, ids in zip(again, self.merge_all([raw[i] for i in again])):
            out[i] = ids
        return out


def laid(found: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words end to end, and where each word's ids end."""
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    return np.fromiter(chain.from_iterable(found), np.uint32), ends


class Codec:
    """Encodes and decodes texts, remembering words.

    ``solve`` is given what stands before each word (a space or nothing) and distinct words;
    it returns the words in an order of its own, their ids end to end, and where the ids of
    each end. By default this is done by speculation.
    """

    def __init__(self, vocabulary: Vocabulary, solve=None):
        self.v = vocabulary
        self.solve = solve or (lambda head, words: (words, *laid(vocabulary.words([head + w for w in words]))))
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # after a space, and as they are

    def _learn(self, spaced: Iterable[str], plain: Iterable[str]) -> None:
        """``_take_in`` without searches for reference cycles: it makes hundreds of thousands of containers, none in a cycle."""
        searching = gc.isenabled()
        gc.disable()
        try:
            self._take_in(spaced, plain)
        finally:
            if searching:
                gc.enable()

    def _take_in(self, spaced: Iterable[str], plain: Iterable[str]) -> None:
        """Take in the ids of chunks after a space, and as they are; letters with one mark behind need no pattern.

        A word is a chunk of its own, so the words that chunks are cut into are remembered as such.
        """
        after, alone = self.known
        new: tuple[set[str], set[str]] = (set(), set())
        marked: list[tuple[dict[str, bytes], str]] = []
        cuts: list[tuple[dict[str, bytes], str, Sequence[str]]] = []
        for chunks, head, known, own in ((spaced, " ", after, new[0]), (plain, "", alone, new[1])):
            for c in chunks:
                if c.isalpha():
                    own.add(c)
                elif c[-1:] in MARKS and c[:-1].isalpha():
                    own.add(c[:-1])
                    marked.append((known, c))
                else:
                    words = self.v.pattern.findall(head + c)
                    cuts.append((known, c, words))
                    new[0].update([w[1:] for w in words if w[0] == " "])
                    new[1].update([w for w in words if w[0] != " "])
        new[1].update(MARKS)
        for known, head, some in ((after, " ", new[0]), (alone, "", new[1])):
            if some := some.difference(known):
                words, flat, ends = self.solve(head, list(some))
                blob, ends = flat.astype("<u4").tobytes(), (ends * 4).tolist()
                known.update(zip(words, [blob[i:j] for i, j in zip([0, *ends], ends)]))
        for known, c in marked:
            known[c] = known[c[:-1]] + alone[c[-1]]
        for known, c, words in cuts:
            known[c] = b"".join([after[w[1:]] if w[0] == " " else alone[w] for w in words])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids (little-endian uint32) of each text."""
        for at in range(0, len(texts), TEXTS):
            for known in self.known:
                if len(known) > CACHE:
                    known.clear()
            plans, spaced, plain = [], set(), set()
            for text in texts[at : at + TEXTS]:
                plan: list[int | tuple[list[str], bool]] = []
                for part in self._parts(text or ""):
                    if isinstance(part, str):
                        loose = _loose(part)
                        chunks = self.v.pattern.findall(part) if loose else part.split(" ")
                        plain.update(chunks if loose else chunks[:1])
                        if not loose:
                            spaced.update(chunks[1:])
                        plan.append((chunks, loose))
                    else:
                        plan.append(part)
                plans.append(plan)
            after, alone = self.known
            self._learn(spaced.difference(after), plain.difference(alone))
            for plan in plans:
                out = []
                for part in plan:
                    if isinstance(part, int):
                        out.append(part.to_bytes(4, "little"))
                    elif part[1]:
                        out.extend(map(alone.__getitem__, part[0]))
                    else:
                        chunks = iter(part[0])
                        out.append(alone[next(chunks)])
                        out.extend(map(after.__getitem__, chunks))
                yield np.frombuffer(b"".join(out), "<u4")

    def _parts(self, text: str) -> Iterator[str | int]:
        at = 0
        if self.v.cut is not None:
            for m in self.v.cut.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()]
                yield self.v.special[m[0]]
                at = m.end()
        if at < len(text):
            yield text[at:]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included."""
        return b"".join(map(self.v.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary file."""
    return Codec(Vocabulary(path))


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """``docs`` with columns ``ids`` (array of int) and ``n_tokens``, which replace any of these names.

    With ``decoded``, also ``decoded_sha256``: the digest of the text that the ids decode to.
    """
    made = ("ids", "n_tokens", *(("decoded_sha256",) if decoded else ()))
    names = [c for c in docs.columns if c not in made]
    kinds = (T.ArrayType(T.IntegerType()), T.LongType(), T.StringType())
    schema = T.StructType([*[docs.schema[c] for c in names], *[T.StructField(c, k) for c, k in zip(made, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids = list(c.encode(part.column("text").to_pylist()))
                size = np.array([len(x) for x in ids], np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))
                back = [pa.array([hashlib.sha256(c.decode(x.tolist()).encode()).hexdigest() for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], lists, pa.array(size), *back], names=[*names, *made])

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with column ``decoded``, the text of its column ``ids`` (null ids: empty)."""
    names = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*[encoded.schema[c] for c in names], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        names = [str(i) for i in range(len(c.v.token_bytes))]
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            sizes, hashes, back = [], [], []
            for ids in c.encode(batch.column(1).to_pylist()):
                ids = ids.tolist()
                sizes.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
