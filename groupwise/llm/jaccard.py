"""N-gram Jaccard join by parity sketches.

Sets: the distinct WORDS-word shingles of each whole text, as 64-bit hashes; equal sets are
one set from there on. Sketch: shingles toggle the bits of a long parity sketch, cut into
parts; a shingle in only one of two sets changes at most one part, so the number of unequal
parts is at most their symmetric difference. (A part is wide and sparse; what is stored of
it is the XOR of the 64-bit codes of its set bits.) Similarity of at least ``percent`` bounds the
difference by (100 - percent) / (100 + percent) of both sizes, so in a size band whose
sketches have more parts than that bound, similar sets agree in some part: they meet in the
bucket of that part's content.

Empty parts say nothing and make no bucket. A set with more parts in use than its bound has
a part in use in common with every partner. So only two sets that both lack this can miss
each other, and both also join a next scheme with more parts; the last one uses all shingles
and, for the few sets that still lack it, empty parts as well. The first two schemes leave
out shingles that very many sets contain (passages found everywhere): leaving out the same
shingles everywhere never adds to a difference, so no pair is lost whatever is left out,
and such passages fill no buckets. They are found by counting in every task over all
shingles, keeping those that recur there, and summing.

Buckets propose pairs in rounds: first each set against one leader of each of its buckets
that is in another component so far, its likeliest leaders verified; after ROUNDS of these, all pairs of
different components that still share a bucket. A short parity sketch of each set goes with
it: where two of them differ in more bits than the bound, so do the sets, and the pair goes
no further. Alike sets share hundreds of buckets, so each set also carries the LEAST least of
its keys: a pair with some of these in common is made in the first of them and in no other
bucket (a pair with none, in each). All pairs made are verified exactly on their sets.
Within a component nothing more is tried, so a group of copies costs a star and not all
pairs, and every link between components is found.

Defined results: null or wordless text has no shingles and links with nothing; texts of
fewer words than a shingle have one, their whole sequence; rows with one id each count, and
null ids are grouped with what they equal (their component is the least id that isn't null,
else null). A row is known by its id and a 64-bit hash of its text, so that rows with one id,
or with none, do not meet. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, scratch, stored
from .components import components

#: Bytes of text that are hashed together.
BATCH = 1 << 18
#: Shingles counted together in a task, how often one must recur there, and how often in sum to be left out.
COUNTED = 4_000_000
RECURS = 3
HOT = 24
#: Shingles left out at most, the most frequent ones.
MOST_HOT = 250_000
ROUNDS = 3
#: Leaders verified for each set, in the first round and later ones.
LEADERS = (1, 3)
#: 64-bit words of the short sketch by which proposed pairs are tested.
SHORT = 8
#: Least keys that a set carries into the last round.
LEAST = 16
#: Rows of buckets in an Arrow batch, sets remembered in a task.
ROWS_OUT = 100_000
#: Texts taken out of an Arrow batch at a time.
TEXTS = 200
SEEN = 500_000
#: Bits of the filters that keep texts and sets out of a join; their size is fixed, more ids only make them pass more.
FILTER_BITS = 1 << 20
#: Bits of one value of Spark's bitmap_construct_agg.
BITMAP = 8 * 4096
GROWTH = 1.5

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for an ordinary batch are kept."""
    return tuple(x[:n] for x in _usual_powers(2 * BATCH)) if n <= 2 * BATCH else _count_powers(n)


@lru_cache(1)
def _usual_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _count_powers(n)


def _count_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode().lower() for t in texts]  # bytes: A-Z alone change
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < BATCH):
            size += len(raw[end]) + 1
            end += 1
        yield from _sets(raw[at:end], words)
        at = end


def _sets(raw: list[bytes], words: int) -> Iterator[np.ndarray]:
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    up, down = _powers(len(flat) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[flat] * up[: len(flat)])])
    space = _IS_SPACE[flat]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    word = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    bounds = np.searchsorted(first, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]))
    n = len(word)
    gram = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        gram = gram * _ODD + word[k : k + len(gram)]
    gram = mix(gram)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            yield np.unique(gram[a : b - words + 1])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for w in word[a:b]:
                short = short * _ODD + w
            yield mix(short ^ _BASE)
        else:
            yield np.empty(0, np.uint64)


def set_id(h: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed integer."""
    return int(np.add.reduce(mix(h ^ _BASE)).view(np.int64)) if len(h) else 0


class Sketches:
    """Buckets of a set: size bands, parts of each scheme, and the shingles left out of the first two."""

    def __init__(self, percent: int, hot: np.ndarray):
        self.percent, self.hot = percent, np.sort(hot)
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] * GROWTH)))

    def bound(self, a: int, b: int) -> int:
        """Greatest symmetric difference of linked sets of these sizes."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    @lru_cache(200)
    def parts(self, band: int) -> tuple[int, ...]:
        """Parts of the sketches of a band, for each scheme."""
        most = self.edges[band + 1] - 1
        bound = self.bound(most, most)
        p = bound + 1
        while p < most and p * (1 - math.exp(-most / p)) - 3 * math.sqrt(p * math.exp(-most / p)) <= bound:
            p += max(1, p // 64)
        return p, max(p, most), 2 * most, bound + 1

    def bands(self, n: int) -> range:
        """Bands of the larger sets that a set of n shingles may link with, its own first."""
        top = n * 100 // self.percent
        low = high = np.searchsorted(self.edges, n, "right") - 1
        while self.edges[high + 1] <= top:
            high += 1
        return range(int(low), int(high) + 1)

    def buckets(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        rare = h
        if len(self.hot) and n:
            at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
            rare = h[self.hot[at] != h]
        out = []
        for band in self.bands(n) if n else ():
            most = self.edges[band + 1] - 1
            bound = min(self.bound(most, most), self.bound(n, n * 100 // self.percent))
            if bound == 0:
                continue  # only equal sets, and these are one already
            for scheme, p in enumerate(self.parts(band)):
                used = rare if scheme < 2 else h
                part = (used >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)  # rises with the hash
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(used) else np.empty(0, np.int64)
                content = np.bitwise_xor.reduceat(mix(used), cut) if len(cut) else np.empty(0, np.uint64)
                place = part[cut] if len(cut) else np.empty(0, np.uint64)
                if scheme == 3:
                    full = np.zeros(p, np.uint64)
                    full[place.astype(np.int64)] = content
                    content, place = full, np.arange(p, dtype=np.uint64)
                out.append(mix(content ^ mix(place + np.uint64((band << 36) + (scheme << 34)))))
                if len(cut) > bound:
                    break
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


class Recurring:
    """Hashes of many sets, counted COUNTED at a time."""

    def __init__(self):
        self.held, self.n = np.empty(COUNTED, np.uint64), 0

    def add(self, h: np.ndarray) -> Iterator[bytes]:
        """Take in a set; what recurred, whenever the room is used up."""
        while len(h):
            part, h = h[: COUNTED - self.n], h[COUNTED - self.n :]
            self.held[self.n : self.n + len(part)] = part
            self.n += len(part)
            if self.n == COUNTED:
                yield from self.flush()

    def flush(self) -> Iterator[bytes]:
        """Hashes held RECURS times or more, and how often, as int64 pairs."""
        if not self.n:
            return
        h = self.held[: self.n]
        h.sort()
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(first, append=self.n)
        often = times >= RECURS
        yield np.stack([h[first[often]].view(np.int64), times[often]]).tobytes()
        self.n = 0


SUMMARY = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("hot", pa.binary())])


def _summary(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, th, n, sid, hot): a row for each document, and rows with hashes and counts of recurring shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counted = Recurring()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                rows = batch.slice(at, TEXTS)
                sizes, names, hot = [], [], []
                for h in shingle_sets(rows.column(1).to_pylist(), words):
                    sizes.append(len(h))
                    names.append(set_id(h))
                    if len(h) and names[-1] not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(names[-1])
                        hot += counted.add(h)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.nulls(len(sizes), pa.binary())], schema=SUMMARY)
                yield from map(told, hot)
        yield from map(told, counted.flush())

    def told(blob: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"hot": blob}], schema=SUMMARY)

    return docs.select("doc_id", "text", "th").mapInArrow(run, "doc_id long, th long, n long, sid long, hot binary")


def _hot(summary: DataFrame) -> np.ndarray:
    """Shingles that recur in many sets."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                h, n = np.frombuffer(blob, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h), "times": pa.array(n)})

    sums = summary.where("hot is not null").select("hot").mapInArrow(spread, "h long, times long").groupBy("h").agg(F.sum("times").alias("times"))
    top = sums.where(F.col("times") >= HOT).orderBy(F.desc("times"), "h").limit(MOST_HOT).select("h").toArrow()
    return top["h"].to_numpy().astype(np.int64).view(np.uint64)


def _buckets(docs: DataFrame, words: int, sketches: Sketches) -> DataFrame:
    """(key, sid, n) of every bucket of every set; a task emits a set once (or once in SEEN sets)."""

    def told(found: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        size = [len(k) for k, *_ in found]
        return pa.RecordBatch.from_pydict({
            "key": np.concatenate([k for k, *_ in found]).view(np.int64),
            "sid": np.repeat(np.array([s for _, s, _ in found], np.int64), size),
            "n": np.repeat(np.array([n for *_, n in found], np.int64), size),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found, held = [], 0
            for at in range(0, batch.num_rows, TEXTS):
                for h in shingle_sets(batch.column(0).slice(at, TEXTS).to_pylist(), words):
                    sid = set_id(h)
                    if not len(h) or sid in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sid)
                    found.append((sketches.buckets(h), sid, len(h)))
                    held += len(found[-1][0])
                    if held >= ROWS_OUT:
                        yield told(found)
                        found, held = [], 0
            if held:
                yield told(found)

    return docs.select("text").mapInArrow(run, "key long, sid long, n long")


def _filtered(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the ids (one column): all that are, and few others.

    The filter is a bitmap of FILTER_BITS bits over hashes, built by aggregation as rows of
    BITMAP bits. Those few rows are broadcast; their size doesn't depend on the number of ids.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    found = ids.select(bit(F.col(ids.columns[0])).alias("bit"))
    maps = found.groupBy((F.col("bit") - F.col("bit") % BITMAP).alias("start")).agg(F.bitmap_construct_agg(F.col("bit") % BITMAP).alias("bits"))
    at = bit(df[column]) % BITMAP
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1
    return df.join(F.broadcast(maps), (bit(df[column]) - at == maps["start"]) & there, "left_semi")


def short_sketch(h: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each of 64 * SHORT places, as SHORT words."""
    odd = np.bincount((mix(h ^ _ODD) % np.uint64(64 * SHORT)).astype(np.int64), minlength=64 * SHORT) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _apart(a: str, b: str) -> Column:
    """Bits in which the short sketches k{a}0.. and k{b}0.. differ: their sets differ in as many shingles at least."""
    return sum((F.bit_count(F.col(f"k{a}{i}").bitwiseXOR(F.col(f"k{b}{i}"))) for i in range(SHORT)), F.lit(0))


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sid, h, k0, k1, ..) of the wanted (sid, rep): its set and short sketch; more than once where rows repeat."""
    schema = pa.schema([("sid", pa.int64()), ("h", pa.list_(pa.int64())), *((f"k{i}", pa.int64()) for i in range(SHORT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1).to_pylist()
            for at in range(0, len(asked), TEXTS):
                sets = list(shingle_sets(batch.column(0).slice(at, TEXTS).to_pylist(), words))
                good = [(s, h.view(np.int64)) for s, h in zip(asked[at : at + TEXTS], sets) if set_id(h) == s]
                short = np.array([short_sketch(h.view(np.uint64)) for _, h in good], np.int64).reshape(-1, SHORT)
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in good], pa.int64()), pa.array([h for _, h in good], pa.list_(pa.int64())), *map(pa.array, short.T.copy())], schema=schema)

    named = wanted.select("sid", F.col("rep.th").alias("rep_th"), F.col("rep.none").alias("none"), F.col("rep.id").alias("id"))
    near = _filtered(docs, "th", named.select("rep_th"))
    same = (near["th"] == named["rep_th"]) & (near["doc_id"].isNull() == named["none"]) & (F.coalesce(near["doc_id"], F.lit(0)) == named["id"])
    rows = near.join(named.hint("merge"), same).select("text", "sid")
    return rows.mapInArrow(run, "sid long, h array<long>, " + ", ".join(f"k{i} long" for i in range(SHORT)))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """The pairs (a, b) that link."""
    pairs = stored(pairs, "pairs", folder)
    left, right = (_filtered(sets, "sid", pairs.select(x)).select(F.col("sid").alias(x), F.col("h").alias(f"h{x}")) for x in "ab")
    common = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(100 * common >= percent * (F.size("ha") + F.size("hb") - common)).select("a", "b")


def _row() -> Column:
    """A row as (none, id, th): in order of id, null last, then of its text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), "th")


def rows_of_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, th, n_shingles, first): every row, and the first row of its group (itself, where it has no words), each as ``_row``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    with scratch(docs.sparkSession, "jaccard") as folder:
        summary = stored(_summary(docs, words), "summary", folder)
        of = summary.where("hot is null").select("doc_id", "th", "n", "sid")
        reps = stored(of.where("n > 0").groupBy("sid").agg(F.min(_row()).alias("rep")), "reps", folder)
        found = _linked(docs, _hot(summary), reps, words, percent, folder)
        named = lambda x: reps.select(F.col("sid").alias(x), F.col("rep").alias(f"rep_{x}")).hint("merge")
        label = components(found.join(named("a"), "a").join(named("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
        first = reps.join(label.hint("merge"), reps["rep"] == label["id"], "left").select("sid", F.coalesce("component", "rep").alias("first"))
        # copies share a sid: a hot one is split as a skewed join, and wordless rows, which all have sid 0, take no part
        full = of.where("n > 0").join(first.hint("merge"), "sid").select("doc_id", "th", F.col("n").alias("n_shingles"), "first")
        bare = of.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), _row().alias("first"))
        return stored(full.unionByName(bare), "groups")


def _linked(docs: DataFrame, hot: np.ndarray, reps: DataFrame, words: int, percent: int, folder: str) -> DataFrame:
    """Links (a, b) between sets, enough of them to connect every group."""
    keep = lambda df, name="table": stored(df, name, folder)
    bucket = Window.partitionBy("key")
    rows = _buckets(docs, words, Sketches(percent, hot))
    least, most = F.min("sid").over(bucket), F.max("sid").over(bucket)
    rows = rows.withColumn("least", least).withColumn("most", most).where("least <> most").select("key", "sid", "n").distinct()
    members = [F.count("sid").over(bucket).alias("m0"), *(F.sum(F.xxhash64(F.lit(k), "sid") % (1 << 40)).over(bucket).alias(f"m{k}") for k in (1, 2))]
    shared = _one_key_each(keep(rows.select("*", *members), "buckets"), folder)
    wanted = keep(reps.join(shared.select("sid").distinct().hint("merge"), "sid"))
    sets = keep(_sets_of(docs, wanted, words), "sets")
    short = keep(sets.groupBy("sid").agg(*(F.first(f"k{i}").alias(f"k{i}") for i in range(SHORT))))

    found: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        if found is None:
            rows = shared.withColumn("component", F.col("sid"))
        else:
            label = components(found)
            rows = shared.join(label.hint("merge"), shared["sid"] == label["id"], "left").withColumn("component", F.coalesce("component", "sid")).drop("id")
            mixed = F.min("component").over(bucket) != F.max("component").over(bucket)
            rows = keep(rows.withColumn("mixed", mixed).where("mixed").drop("mixed"))
            if rows.isEmpty():
                break
            shared = rows.select("key", "sid", "n")
        pairs = _led(rows, short, turn, percent) if turn < ROUNDS else _all_pairs(rows, short, percent, keep)
        new = _verified(pairs, sets, percent, folder)
        found = keep(new if found is None else found.unionByName(new))
    return found


def _sketched(df: DataFrame, short: DataFrame, of: str, x: str) -> DataFrame:
    """``df`` with the short sketch k{x}0.. of the set named in column ``of``."""
    return df.join(short.select(F.col("sid").alias(of), *(F.col(f"k{i}").alias(f"k{x}{i}") for i in range(SHORT))).hint("merge"), of)


def _led(rows: DataFrame, short: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a set with its likeliest leaders: of each bucket, the first of another component."""
    bucket = Window.partitionBy("key")
    me = F.struct(F.xxhash64(F.lit(turn), "sid").alias("order"), "sid", "n", "component")
    led = rows.withColumn("first", F.min(me).over(bucket))
    led = led.withColumn("second", F.min(F.when(F.col("component") != F.col("first.component"), me)).over(bucket))
    other = F.when(F.col("component") != F.col("first.component"), F.col("first")).otherwise(F.col("second"))
    pairs = led.withColumn("other", other).select("sid", F.col("n").alias("na"), F.col("other.sid").alias("lead"), F.col("other.n").alias("nb"))
    pairs = _near(pairs.distinct(), percent)
    pairs = _sketched(_sketched(pairs, short, "lead", "b"), short, "sid", "a").withColumn("apart", _apart("a", "b"))
    pairs = pairs.where(_within("apart", percent)).select("sid", "lead", "apart")
    best = Window.partitionBy("sid").orderBy("apart", "lead")
    pairs = pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= LEADERS[min(turn, len(LEADERS) - 1)])
    return pairs.select(F.greatest("sid", "lead").alias("a"), F.least("sid", "lead").alias("b")).distinct()


def _all_pairs(rows: DataFrame, short: DataFrame, percent: int, keep) -> DataFrame:
    """All pairs (a, b) of different components that share a bucket and may link, each from one bucket as a rule."""
    first = rows.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LEAST).alias("keys"))
    rows = keep(rows.join(keep(short.join(first.hint("merge"), "sid")).hint("merge"), "sid"))
    left, right = (rows.select("key", *(F.col(c).alias(f"{c[0]}{x}{c[1:]}" if c in _K else f"{c}_{x}") for c in rows.columns if c != "key")) for x in "ab")
    left, right = (df.withColumnsRenamed({f"sid_{x}": x, f"n_{x}": f"n{x}"}) for df, x in ((left, "a"), (right, "b")))
    met = F.array_min(F.array_intersect("keys_a", "keys_b"))
    pairs = left.join(right.hint("merge"), "key").where("a > b and component_a <> component_b")
    return _near(pairs, percent).where(_within(_apart("a", "b"), percent)).where(F.coalesce(met, F.col("key")) == F.col("key")).select("a", "b").distinct()


_K = frozenset(f"k{i}" for i in range(SHORT))


def _one_key_each(rows: DataFrame, folder: str) -> DataFrame:
    """(key, sid, n) without buckets whose members (their number m0 and sums m1, m2 of their hashes) are those of another bucket.

    Members of a family share hundreds of parts, which would propose the same pairs as often.
    """
    kept = rows.groupBy("m0", "m1", "m2").agg(F.min("key").alias("key")).select("key")
    return stored(rows.join(kept.hint("merge"), "key", "left_semi").select("key", "sid", "n"), "buckets", folder)


def _within(apart: Column | str, percent: int) -> Column:
    """Whether sets of na and nb shingles that differ in ``apart`` of them at least can link."""
    apart = F.col(apart) if isinstance(apart, str) else apart
    return (100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes na and nb let them link."""
    return pairs.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the least id reachable by links."""
    groups = rows_of_groups(docs, words, percent)
    return groups.select("doc_id", "n_shingles", F.when(~F.col("first.none"), F.col("first.id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each group, by id (null last) and hash of its text, and every row without words; columns unchanged.

    Rows alike in id and text are one group; of these, one is taken before the shuffle.
    """
    first = rows_of_groups(docs, words, percent).where("n_shingles > 0").select("first.*").distinct()
    first = first.select(F.col("none").alias("first_none"), F.col("id").alias("first_id"), F.col("th").alias("first_th"))
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keys = [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("th")]
    rows = docs.where(worded).select(whole, *keys)
    turn = F.row_number().over(Window.partitionBy("none", "id", "th").orderBy("th"))
    rows = rows.withColumn("turn", turn).where("turn = 1")
    kept = rows.join(first.hint("merge"), (rows["none"] == first["first_none"]) & (rows["id"] == first["first_id"]) & (rows["th"] == first["first_th"]), "left_semi")
    return kept.select("row.*").unionByName(docs.where(~worded))
