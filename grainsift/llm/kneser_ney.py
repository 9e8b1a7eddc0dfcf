"""Quality classifier: an interpolated modified Kneser-Ney bigram model.

In back-off form the log probability of a text is a sum of one term for each word
(its unigram probability, and its weight as a context) and one for each pair of
words that the training texts hold. So the model is two tables, from words and from
pairs to numbers, in shards; counting, estimating and scoring are joins with them,
on packed blocks of keys instead of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.functions.kernels import mix, pieces, span_hashes, utf8
from grainsift.llm._common import WIDE_KEY, cut, keep_columns, prepare, renamed, small, table, tidied

BITS = 32
"""Words are told apart by hashes of so many bits: of a million words 0.02 % share one."""
END = 0
QUANTILE = 0.998
"""Of the perplexities of trusted texts that the model hasn't seen, by language."""
MARGIN = 1.05
TRAIN_SHARE = 0.5
"""Of the trusted texts; the rest calibrates."""
SPREAD_TEXTS = 50
"""A language's spread is its own with the weight of its trusted texts, and that of
all languages with the weight of so many."""
HOT_PAIRS, HOT_WORDS = 1 << 20, 1 << 18
"""At most so many of the most frequent ones are broadcast (12 and 3 MB); shards are
asked for the rest."""
SPARE_BITS = 12
"""Keys of pairs have so many bits more than their number needs: one unknown pair in
2**12 at most is taken for another one."""
SHARD_DOCS = 8_192
MAX_BITS = 12
"""There are at most 2**MAX_BITS shards: with more of them a block's requests to each
would be single keys. Beyond 33 million documents shards grow instead."""
BLOCK_TOKENS = 500_000
KEYS_A_ROW = 128
"""Blocks are so large that each shard gets about so many keys of them."""
BLOCK_DOCS = 4_096
_DOC_BITS = 12

_KIND = np.array([0] * 33 + [2] * 95 + [1] * 128, np.uint8)
for _b in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    _KIND[_b] = 1


def tokenize(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a batch of texts as numbers, each text closed by END, and the n + 1
    places where texts begin. Tokens are runs of letters and digits, or of other
    visible characters; case counts."""
    n = len(raw)
    kinds = _KIND[raw]
    edge = np.ones(n, bool)
    edge[1:] = kinds[1:] != kinds[:-1]
    inner = offsets[1:-1]
    edge[inner[inner < n]] = True
    starts = np.flatnonzero(edge)
    ends = np.r_[starts[1:], n]
    real = kinds[starts] > 0
    starts, ends = starts[real], ends[real]
    h = span_hashes(raw, starts, ends)
    ids = h >> np.uint64(64 - BITS)
    ids[ids == END] = 1
    first = np.searchsorted(starts, offsets)
    return np.insert(ids, first[1:], END), first + np.arange(len(offsets))


def _low(n: int) -> np.uint64:
    return np.uint64((1 << n) - 1)


class Grid:
    """Pairs (v, w) in 2**a x 2**b shards by the high bits of v and w, so that
    neither a frequent v nor a frequent w fills a shard; words in as many parts by
    their high bits. A key holds the shard on top."""

    def __init__(self, docs: int):
        self.bits = min(MAX_BITS, max(3, math.ceil(math.log2(max(1, docs) / SHARD_DOCS))))
        self.a, self.b = (self.bits + 1) // 2, self.bits // 2

    def key(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        a, b = np.uint64(BITS - self.a), np.uint64(BITS - self.b)
        top = ((v >> a) << np.uint64(self.b)) | (w >> b)
        return (top << np.uint64(2 * BITS - self.bits)) | ((v & _low(BITS - self.a)) << b) | (w & _low(BITS - self.b))

    def split(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.uint64(BITS - self.a), np.uint64(BITS - self.b)
        top = key >> np.uint64(2 * BITS - self.bits)
        return ((top >> np.uint64(self.b)) << a) | ((key >> b) & _low(BITS - self.a)), ((top & _low(self.b)) << b) | (key & _low(BITS - self.b))

    def short(self, key: np.ndarray, width: int) -> np.ndarray:
        """The shard, and of the rest a hash that makes up ``width`` bits with it."""
        free = np.uint64(width - self.bits)
        return ((key >> np.uint64(2 * BITS - self.bits)) << free) | (mix(key) >> (np.uint64(64) - free))


# --- packed columns --------------------------------------------------------

_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(*columns: np.ndarray) -> bytes:
    """Unsigned numbers or 32-bit floats, packed: bytes of equal rank lie together, so
    that high ones pack to nothing."""
    head, planes = [len(columns)], []
    for c in columns:
        wide = c.view(np.uint32).astype(np.uint64) if c.dtype == np.float32 else c.astype(np.uint64)
        width = (int(wide.max()).bit_length() + 7) // 8 if len(wide) else 0
        head += [len(wide), width]
        planes.append(wide.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    plain = np.array(head, "<i8").tobytes() + b"".join(planes)
    return len(plain).to_bytes(8, "little") + _ZSTD.compress(plain, asbytes=True)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    plain = np.frombuffer(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little")), np.uint8)
    n = int(plain[:8].view("<i8")[0])
    sizes = plain[8 : 8 + 16 * n].view("<i8").reshape(n, 2)
    at, out = 8 + 16 * n, []
    for size, width in sizes.tolist():
        full = np.zeros((size, 8), np.uint8)
        full[:, :width] = plain[at : at + size * width].reshape(width, size).T
        out.append(full.view("<u8").ravel())
        at += size * width
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def _climb(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def _floats(bits: np.ndarray) -> np.ndarray:
    return bits.astype(np.uint32).view(np.float32)


def encode(keys: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> bytes:
    """Ascending keys with counts; ``docs`` holds a document for each count (or
    nothing), as steps: a key that all documents ask for takes next to no room."""
    return squeeze(_steps(keys), counts, np.diff(docs.astype(np.uint16), prepend=np.uint16(0)))


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts, docs = unsqueeze(data)
    return _climb(keys), counts, np.cumsum(docs.astype(np.uint16), dtype=np.uint16)


ROW = "shard long, kind int, block long, data binary"
TABLE, REQUEST, HEADER, OF_CONTEXTS, OF_WORDS, HOT = range(6)
WORDS = 1 << 40
"""Added to the number of a part of the words, where pairs have their shard."""


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["shard", "kind", "block", "data"])


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)] if len(values) else np.zeros(1, np.int64)


# --- counts ----------------------------------------------------------------


def _count(grid: Grid):
    """Kernel: texts to counts of pairs, by shard."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            key = np.sort(np.concatenate(keys))
            keys.clear()
            at = _starts(key)
            key, count = key[at[:-1]], np.diff(at).astype(np.uint64)
            shard = (key >> np.uint64(2 * BITS - grid.bits)).astype(np.int64)
            cuts = _starts(shard)
            return _rows([(int(shard[a]), TABLE, 0, encode(key[a:b], count[a:b], key[:0])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for i, j in pieces(offsets):
                ids, _ = tokenize(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                inside = ids[:-1] != END
                keys.append(grid.key(ids[:-1][inside], ids[1:][inside]))
                if sum(map(len, keys)) >= 4 * BLOCK_TOKENS:
                    yield flush()
        if keys:
            yield flush()

    return run


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = _starts(k)[:-1]
    return k[at], np.add.reduceat(c, at) if len(at) else c


@tidied
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over rows sorted by shard: one row of summed counts for each shard."""
    shard, keys, counts = None, [], []
    for batch in batches:
        for s, d in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
            if s != shard and keys:
                yield _rows([(shard, TABLE, 0, encode(*_sum(keys, counts), np.zeros(0, np.uint64)))])
                keys, counts = [], []
            shard = s
            k, c, _ = decode(d.as_py())
            keys.append(k)
            counts.append(c)
            if len(keys) > 64:
                k, c = _sum(keys, counts)
                keys, counts = [k], [c]
    if keys:
        yield _rows([(shard, TABLE, 0, encode(*_sum(keys, counts), np.zeros(0, np.uint64)))])


# --- estimation ------------------------------------------------------------

_BINS = 48


def _histogram(counts: np.ndarray) -> np.ndarray:
    """How often 1, 2, 3 and 4 occur, how many there are and their sum; then how
    many lie between each power of two and the next."""
    few = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5]
    powers = np.bincount(np.frexp(counts.astype(np.float64))[1] - 1, minlength=_BINS)[:_BINS] if len(counts) else np.zeros(_BINS)
    return np.r_[few, len(counts), counts.sum() if len(counts) else 0, powers].astype(np.int64)


def _frequent(powers: np.ndarray, most: int) -> int:
    """The least power of two that at most ``most`` of the counts reach."""
    above = np.cumsum(powers[::-1])[::-1]
    return 1 << int(np.argmax(above <= most)) if (above <= most).any() else 1 << _BINS


SUMMARY = "side int, numbers array<long>"


def _summary(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([s for s, _ in rows], pa.int32()), pa.array([n.tolist() for _, n in rows], pa.list_(pa.int64()))], ["side", "numbers"])


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums of summaries, place by place: a row of fixed length for each side."""
    flat = parts.select("side", F.posexplode("numbers").alias("place", "n")).groupBy("side", "place").agg(F.sum("n").alias("n"))
    out: dict[int, np.ndarray] = {}
    for r in flat.collect():
        out.setdefault(r["side"], np.zeros(6 + _BINS, np.int64))[r["place"]] = r["n"]
    return out


@tidied
def _of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _summary([(0, _histogram(decode(d.as_py())[1])) for d in batch.column(3)])


PARTIAL = "part long, side int, shard long, data binary"


def _sides(grid: Grid):
    """Kernel: shards of counts to what they add to the statistics of their words, a
    row for each part of the words: of contexts v the sums and the numbers of counts
    1, 2 and more, of words w the numbers of different v."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(BITS - grid.bits)
        for batch in batches:
            rows: list[tuple[int, int, int, bytes]] = []
            for s, d in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                keys, counts, _ = decode(d.as_py())
                v, w = grid.split(keys)
                at = _starts(v)[:-1]
                sums = [np.add.reduceat(x.astype(np.uint64), at) for x in (counts, counts == 1, counts == 2, counts > 2)]
                words, times = np.unique(w, return_counts=True)
                for side, ids, columns in ((0, v[at], sums), (1, words, [times.astype(np.uint64)])):
                    part = (ids >> shift).astype(np.int64)
                    cuts = _starts(part)
                    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                        rows.append((int(part[x]), side, s, squeeze(_steps(ids[x:y]), *[c[x:y] for c in columns])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["part", "side", "shard", "data"])

    return run


def _totals(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Words of a part, their five statistics, and for each row its side, shard and
    the places of its words."""
    sides, shards = group.column("side").to_pylist(), group.column("shard").to_pylist()
    read = [unsqueeze(d.as_py()) for d in group.column("data")]
    ids = [_climb(r[0]) for r in read]
    words = np.unique(np.concatenate(ids))
    stats = np.zeros((5, len(words)), np.int64)
    places = []
    for side, shard, own, r in sorted(zip(sides, shards, ids, read, strict=True), key=lambda x: x[:2]):
        at = np.searchsorted(words, own)
        for k, c in enumerate(r[1:]):
            stats[4 * side + k, at] += c.astype(np.int64)
        places.append((side, shard, at))
    return words, stats, places


def _of_words(group: pa.Table) -> pa.Table:
    _, stats, _ = _totals(group)
    return pa.Table.from_batches([_summary([(1, _histogram(stats[4][stats[4] > 0])), (2, _histogram(stats[0][stats[0] > 0]))])])


def discounts(times: np.ndarray) -> np.ndarray:
    """Of counts 0, 1, 2 and more, from how often counts 1 to 4 occur; 0.75 where
    those are too few to tell."""
    n = np.r_[0, times[:4]].astype(np.float64)
    out = np.array([0.0, 0.75, 0.75, 0.75])
    if (n[1:5] > 0).all():
        y = n[1] / (n[1] + 2 * n[2])
        found = np.array([1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]])
        good = (found > 0) & (found < np.array([1, 2, 3]))
        out[1:] = np.where(good, found, out[1:])
    return out


@dataclass(frozen=True)
class Constants:
    """Numbers of the whole model: discounts of pairs and of words, all continuations,
    the probability of an unknown word, the width of a pair's key, and from which
    counts pairs and contexts are hot."""

    pair: np.ndarray
    word: np.ndarray
    whole: int
    unknown: float
    width: int
    hot_pair: int
    hot_word: int


def constants(pairs: np.ndarray, words: np.ndarray, contexts: np.ndarray, grid: Grid) -> Constants:
    lower = discounts(words)
    n, whole = int(words[4]), int(words[5])
    taken = float(lower[1] * words[0] + lower[2] * words[1] + lower[3] * (n - words[0] - words[1]))
    # one more word stands for all unknown ones
    unknown = taken / whole / (n + 1) if whole else 1.0
    width = min(64 - _DOC_BITS, max(int(pairs[4]).bit_length() + SPARE_BITS, grid.bits + 8))
    return Constants(discounts(pairs), lower, whole, unknown, width, _frequent(pairs[6:], HOT_PAIRS), _frequent(contexts[6:], HOT_WORDS))


def estimate(stats: np.ndarray, c: Constants) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the five statistics of words: log of mass times back-off weight as a
    context, log probability, and what a token of it adds to a text's log
    probability beyond that of an unknown word that is no context."""
    sums, kinds, times = stats[0].astype(np.float64), stats[1:4].astype(np.float64), stats[4]
    left = (c.pair[1:, None] * kinds).sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_mass = np.log(left)
        log_gamma = np.where(sums > 0, log_mass - np.log(sums), 0.0)
    log_p = np.log(np.maximum(times - c.word[np.minimum(times, 3)], 0) / max(c.whole, 1) + c.unknown)
    return log_mass, log_p, log_p - math.log(c.unknown) + log_gamma


def _tables(keys: np.ndarray, values: np.ndarray, shift: int, base: int) -> list[tuple[int, int, int, bytes]]:
    """Ascending keys and their values as tables, by the bits above ``shift``."""
    shard = (keys >> np.uint64(shift)).astype(np.int64)
    cuts = _starts(shard)
    return [(base + int(shard[a]), TABLE, 0, squeeze(_steps(keys[a:b]), values[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _settle(grid: Grid, c: Constants):
    """Kernel over the parts of the words: the table of a part, its hot words, and for
    each shard what its pairs need of their words."""

    def run(group: pa.Table) -> pa.Table:
        words, stats, places = _totals(group)
        part = group.column("part")[0].as_py()
        log_mass, log_p, value = estimate(stats, c)
        hot = stats[0] >= c.hot_word
        rows = [(WORDS + part, HOT, 0, squeeze(_steps(words[hot]), value[hot].astype(np.float32)))]
        rows += _tables(words, value.astype(np.float32), BITS - grid.bits, WORDS)
        rows += [(shard, OF_WORDS if side else OF_CONTEXTS, part, squeeze((log_p if side else log_mass)[at].astype(np.float32))) for side, shard, at in places]
        return pa.Table.from_batches([_rows(rows)])

    return run


def _finish(grid: Grid, c: Constants):
    """Kernel over rows sorted by shard, kind and part: counts and what their words
    say, to the table of the shard's pairs and its hot pairs."""

    def made(shard: int, data: bytes, context: list[np.ndarray], word: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts, _ = decode(data)
        v, w = grid.split(keys)
        log_mass = np.repeat(np.concatenate(context).astype(np.float64), np.diff(_starts(v)))
        log_p = np.concatenate(word).astype(np.float64)[np.unique(w, return_inverse=True)[1]]
        value = np.log1p((counts - c.pair[np.minimum(counts, 3).astype(np.int64)]) * np.exp(-log_mass - log_p)).astype(np.float32)
        short = grid.short(keys, c.width)
        order = np.argsort(short, kind="stable")
        order = order[_starts(short[order])[:-1]]
        hot = order[counts[order] >= c.hot_pair]
        return _rows([*_tables(short[order], value[order], c.width - grid.bits, 0), (shard, HOT, 0, squeeze(_steps(short[hot]), value[hot]))])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, data = None, b""
        sides: dict[int, list[np.ndarray]] = {OF_CONTEXTS: [], OF_WORDS: []}
        for batch in batches:
            for s, kind, _, d in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if s != shard:
                    if shard is not None:
                        yield made(shard, data, *sides.values())
                    shard, sides = s, {OF_CONTEXTS: [], OF_WORDS: []}
                if kind == TABLE:
                    data = d
                else:
                    sides[kind].append(_floats(unsqueeze(d)[0]))
        if shard is not None:
            yield made(shard, data, *sides.values())

    return run


@dataclass(frozen=True)
class Hot:
    """The most frequent words and pairs of the model, and what texts need of it."""

    words: np.ndarray
    word_values: np.ndarray
    pairs: np.ndarray
    pair_values: np.ndarray
    log_unknown: float
    width: int


def _routed(df: DataFrame) -> DataFrame:
    """Rows to the task of their shard, sorted. Shards are dealt out in turn (words
    from the other end), so tasks are even; headers go by their block."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard, block = F.col("shard"), F.col("block")
    turn = F.when(shard < 0, F.pmod(F.xxhash64(block), F.lit(parts))).when(shard >= WORDS, parts - 1 - F.pmod(shard, F.lit(parts))).otherwise(F.pmod(shard, F.lit(parts)))
    return df.repartitionById(parts, turn.cast("int")).sortWithinPartitions("shard", "kind", "block")


def train(texts: DataFrame, grid: Grid) -> tuple[DataFrame, Hot]:
    """The tables of words and pairs (written to the shared folder), and the hot part.

    Four joins by shard: counts are summed; their statistics are summed by word; what
    words say goes back to the shards whose pairs hold them; pairs get their numbers.
    The driver sees sums of fixed length and at most HOT_PAIRS and HOT_WORDS entries.
    """
    counts = cut(_routed(texts.mapInArrow(_count(grid), ROW)).mapInArrow(_merge, ROW))
    sides = counts.mapInArrow(_sides(grid), PARTIAL)
    none = np.zeros(6 + _BINS, np.int64)
    found = _added(counts.mapInArrow(_of_pairs, SUMMARY)) | _added(sides.groupBy("part").applyInArrow(_of_words, SUMMARY))
    c = constants(found.get(0, none), found.get(1, none), found.get(2, none), grid)
    settled = cut(sides.groupBy("part").applyInArrow(_settle(grid, c), ROW))
    kept = settled.where(F.col("kind").isin(TABLE, HOT))
    finished = _routed(counts.unionByName(settled.where(F.col("kind").isin(OF_CONTEXTS, OF_WORDS)))).mapInArrow(_finish(grid, c), ROW)
    model = cut(kept.unionByName(finished))
    hot: dict[bool, list[list[np.ndarray]]] = {False: [], True: []}
    for r in model.where(F.col("kind") == HOT).toLocalIterator():
        hot[r["shard"] >= WORDS].append(unsqueeze(bytes(r["data"])))
    columns = []
    for side in (True, False):
        keys = np.concatenate([np.zeros(0, np.uint64), *[_climb(k) for k, _ in hot[side]]])
        values = np.concatenate([np.zeros(0, np.float32), *[_floats(v) for _, v in hot[side]]])
        order = np.argsort(keys)
        columns += [keys[order], values[order]]
    return model.where(F.col("kind") == TABLE), Hot(*columns, math.log(c.unknown), c.width)


# --- scoring ---------------------------------------------------------------


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among ascending keys, and whether they are there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def _requests(keys: np.ndarray, docs: np.ndarray, shift: int, base: int, block: int) -> list[tuple[int, int, int, bytes]]:
    """One encoded list for each shard."""
    packed = np.sort((keys << np.uint64(_DOC_BITS)) | docs)
    key = packed >> np.uint64(_DOC_BITS)
    shard = (key >> np.uint64(shift)).astype(np.int64)
    cuts, out = _starts(shard), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = _starts(key[a:b])
        out.append((base + int(shard[a]), REQUEST, block, encode(key[a:b][at[:-1]], np.diff(at).astype(np.uint64), packed[a:b] & _low(_DOC_BITS))))
    return out


def _ask(grid: Grid, hot):
    """Kernel: texts to what hot words and pairs say of them, and to the words and
    pairs that shards are asked for, block by block."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Hot = hot.value
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 32
        asked: list[list[np.ndarray]] = [[], [], [], []]
        head: list[pa.RecordBatch] = []
        docs = tokens = 0
        most = max(BLOCK_TOKENS, KEYS_A_ROW << grid.bits)

        def flush() -> pa.RecordBatch:
            words, word_docs, keys, key_docs = [np.concatenate([np.zeros(0, np.uint64), *x]) for x in asked]
            rows = _requests(words, word_docs, BITS - grid.bits, WORDS, block) + _requests(keys, key_docs, m.width - grid.bits, 0, block)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for h in head:
                    out.write_batch(h)
            for x in [*asked, head]:
                x.clear()
            return _rows([*rows, (-1, HEADER, block, sink.getvalue().to_pybytes())])

        for batch in batches:
            raw, offsets = utf8(batch.column(3))
            for i, j in pieces(offsets):
                for a in range(i, j, BLOCK_DOCS):
                    b = min(j, a + BLOCK_DOCS)
                    if head and (tokens >= most or docs + b - a > BLOCK_DOCS):
                        yield flush()
                        block, docs, tokens = block + 1, 0, 0
                    ids, first = tokenize(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    owner = np.repeat(np.arange(b - a), np.diff(first))
                    who = (owner + docs).astype(np.uint64)
                    at, hit = _find(m.words, ids)
                    base = np.diff(first) * m.log_unknown + np.bincount(owner[hit], m.word_values[at[hit]], b - a)
                    asked[0].append(ids[~hit])
                    asked[1].append(who[~hit])
                    inside = ids[:-1] != END
                    keys, owner, who = grid.short(grid.key(ids[:-1][inside], ids[1:][inside]), m.width), owner[:-1][inside], who[:-1][inside]
                    at, hit = _find(m.pairs, keys)
                    base += np.bincount(owner[hit], m.pair_values[at[hit]], b - a)
                    asked[2].append(keys[~hit])
                    asked[3].append(who[~hit])
                    head.append(pa.record_batch([*[batch.column(c).slice(a, b - a) for c in range(3)], pa.array(np.diff(first) - 1), pa.array(base)], ["doc_id", "h", "lang", "tokens", "base"]))
                    docs += b - a
                    tokens += len(ids)
        if head:
            yield flush()

    return run


@tidied
def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over rows sorted by shard and kind: a table, then the blocks that ask. A
    block gets the sum for each of its documents; headers pass."""
    shard, known, values = None, np.zeros(0, np.uint64), np.zeros(0, np.float32)
    for batch in batches:
        out: list[tuple[int, int, int, bytes]] = []
        for s, kind, block, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if s != shard:
                shard, known, values = s, np.zeros(0, np.uint64), np.zeros(0, np.float32)
            if kind == TABLE:
                steps, bits = unsqueeze(data)
                known, values = _climb(steps), _floats(bits)
                continue
            if kind == REQUEST:
                keys, times, docs = decode(data)
                at, hit = _find(known, keys)
                if not hit.any():
                    continue
                times = times.astype(np.int64)
                sums = np.bincount(docs[np.repeat(hit, times)], np.repeat(values[at[hit]], times[hit]))
                some = np.flatnonzero(sums)
                data = some.astype("<u2").tobytes() + sums[some].astype("<f4").tobytes()
            out.append((s, kind, block, data))
        yield _rows(out)


SCORE = "doc_id long, h long, lang string, tokens long, logp double"


def _close(group: pa.Table) -> pa.Table:
    """One block: its header and the shards' sums, in the order of the shards."""
    group = group.sort_by([("shard", "ascending")])
    kinds, data = group.column("kind").to_pylist(), group.column("data")
    head = pa.ipc.open_stream(data[kinds.index(HEADER)].as_py()).read_all()
    total = head.column("base").to_numpy().copy()
    for kind, d in zip(kinds, data, strict=True):
        if kind == REQUEST:
            raw = d.as_py()
            n = len(raw) // 6
            total[np.frombuffer(raw, "<u2", n).astype(np.int64)] += np.frombuffer(raw, "<f4", n, 2 * n)
    return pa.table([*[head.column(k) for k in range(4)], pa.array(total)], ["doc_id", "h", "lang", "tokens", "logp"])


# --- classifier ------------------------------------------------------------


def trusted_ids(labels: DataFrame, train_share: float = TRAIN_SHARE) -> DataFrame:
    """``(tid, train)``: documents always labelled good and never toxic; by a hash of
    the id ``train_share`` of them train the model, the others calibrate."""
    rows = keep_columns(labels, "doc_id", "quality", "toxic").where("doc_id is not null")
    good = rows.groupBy(F.col("doc_id").cast("long").alias("tid")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0")
    return good.select("tid", (F.pmod(F.xxhash64("tid"), F.lit(1 << 20)) < round(train_share * (1 << 20))).alias("train"))


def scores(docs: DataFrame, labels: DataFrame, train_share: float = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, h, lang, tokens, logp)`` for every row of ``docs`` (``h`` is the
    text's hash), and the trusted ids, both written to the shared folder."""
    spark = docs.sparkSession
    prepare(spark)
    inner, at = renamed(docs)
    grid = Grid(docs.count())
    text = F.col(at["text"]).cast("string")
    rows = inner.select(F.col(at["doc_id"]).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(at["lang"]).cast("string").alias("lang"), text.alias("text"))
    trusted = cut(trusted_ids(labels, train_share))
    learn = small(trusted.where("train").select("tid"), trusted.count())
    model, hot = train(rows.where("text is not null").join(learn, F.col("doc_id") == F.col("tid"), "left_semi").select("text"), grid)
    asked = rows.mapInArrow(_ask(grid, spark.sparkContext.broadcast(hot)), ROW).unionByName(model)
    return cut(_routed(asked).mapInArrow(_answer, ROW).groupBy("block").applyInArrow(_close, SCORE)), trusted


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, train_share: float = TRAIN_SHARE) -> DataFrame:
    """``(doc_id, h, lang, tokens, perplexity, threshold, keep)`` for every row.

    The model is trained on ``train_share`` of the trusted texts (labelled good, not
    toxic), all of those and whole; ``threshold`` is the ``quantile`` of the
    perplexities of the others in the row's language, times ``margin``. It is the
    language's own at every size: its mean, and its own spread above that, to which
    the spread of all languages adds, ever less as its trusted texts get more.
    Languages without trusted texts have no threshold, and their rows stay. The
    perplexity is the document's own, its end counted as a token. Scoring asks the
    shards for the words and pairs of whole blocks of documents, but for the hottest
    ones, which all tasks hold.

    A null language is a language of its own. Texts that are null or hold no token
    have perplexity null and go. Rows are judged by their text, whatever their id;
    repeated rows get the same answer. Without trusted texts nothing with tokens
    goes (the threshold is null). Extra columns, whatever their names, don't matter.
    An empty table gives none.
    """
    scored, trusted = scores(docs, labels, train_share)
    rated = scored.withColumn("score", -F.col("logp") / (F.col("tokens") + 1))  # END is predicted too
    held = rated.where("tokens > 0").join(trusted.where("not train"), F.col("doc_id") == F.col("tid"), "left_semi")
    means = held.groupBy(F.col("lang").alias("ml")).agg(F.avg("score").alias("mean"))
    over = held.join(F.broadcast(cut(means)), F.col("lang").eqNullSafe(F.col("ml"))).withColumn("over", F.col("score") - F.col("mean"))  # a row for each language
    pick = F.percentile_approx("over", F.lit(quantile), F.lit(100_000))
    own = cut(over.groupBy(F.col("lang").alias("ll"), F.col("mean").alias("level")).agg(pick.alias("own"), F.count("*").alias("held")))
    every = over.agg(pick.alias("every")).first()["every"]
    # few texts seldom hold the rare ones: the less of them, the more of the common spread is added
    spread = F.col("own") + F.greatest(F.lit(every) - F.col("own"), F.lit(0.0)) * SPREAD_TEXTS / (F.col("held") + SPREAD_TEXTS)
    limits = F.broadcast(own.select("ll", (F.col("level") + spread).alias("limit")))
    threshold = F.exp("limit") * margin
    perplexity = F.when(F.col("tokens") > 0, F.exp("score"))
    keep = (F.col("tokens") > 0) & F.coalesce(perplexity <= threshold, F.lit(True))
    return rated.join(limits, F.col("lang").eqNullSafe(F.col("ll")), "left").select("doc_id", "h", "lang", "tokens", perplexity.alias("perplexity"), threshold.alias("threshold"), keep.alias("keep"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns; nulls, empty
    and repeated texts as there. Rejected keys (id and text) are broadcast while
    that takes less than 192 MB, else joined by key."""
    gone = cut(judge(docs, labels, quantile).where("not keep").select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct())
    gone = small(gone, gone.count(), WIDE_KEY)
    inner, at = renamed(docs)
    same = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.col(at["text"]).cast("string")) == F.col("gone_h"))
    return inner.join(gone, same, "left_anti").toDF(*docs.columns)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept, with their perplexities and thresholds."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("keep").drop("h", "keep")
