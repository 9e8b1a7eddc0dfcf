"""Sparse n-grams: the tokens of the index.

Each pair of neighbouring bytes has a weight, its CRC-32. A byte range is a token
if it is two or three bytes long, or if its first and its last pair outweigh every
pair between. Whether a range is a token depends on its own bytes only, so every
token of a literal is a token of any text that holds the literal.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from grainsift.functions.kernels import mix, pieces, plain_hashes, short_hashes, span_hashes, unmix, utf8
from grainsift.functions.ship import ship

MAX_BYTES = 100
"""Tokens beyond this length aren't indexed; literals of a plan are no longer."""

_weights: list[np.ndarray] = []
BORDER, END = 1 << 16, 1 << 17


def pair_weights(raw: np.ndarray) -> np.ndarray:
    """Ranks of the pairs' CRC-32, all different: only their order counts."""
    if not _weights:
        crc = np.array([zlib.crc32(bytes((a, b))) for a in range(256) for b in range(256)], np.int64)
        _weights.append(np.unique(crc, return_inverse=True)[1].astype(np.int32))
    return _weights[0][raw[:-1].astype(np.uint16) << np.uint16(8) | raw[1:]]


NEIGHBOURS = 8
"""So many neighbours are compared place by place before pointers are followed."""


def _reaching(w: np.ndarray, far: int, equal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that outweigh the next one, ascending, and for each the nearest to the
    right that weighs as much or more, if it lies in the same text and at most ``far``
    away; with ``equal`` also if both weigh the same.

    Everything between i and its candidate weighs less than i, so a lighter
    candidate may be replaced by its own candidate: pointers double like that.
    """
    n = len(w)
    heavy = np.append(w, np.full(NEIGHBOURS, END, np.int32))
    lighter = heavy[1 : n + 1] < w
    first = np.flatnonzero(lighter)
    passed = np.ones(n, np.uint8)
    for k in range(2, NEIGHBOURS + 1):
        passed += lighter.view(np.uint8)
        lighter &= heavy[k : n + k] < w
    nxt = np.arange(n) + passed
    open_ = np.flatnonzero(lighter)
    own, at = w[open_], nxt[open_]
    while len(open_):
        target = nxt[at]
        nxt[open_] = target
        keep = np.flatnonzero((heavy[target] < own) & (target - open_ <= far))
        open_, own, at = open_[keep], own[keep], target[keep]
    last = nxt[first]
    weight = heavy[last]
    good = (weight < BORDER) & (last - first <= far)
    keep = np.flatnonzero(good if equal else good & (weight != w[first]))
    return first[keep], last[keep]


def _marked(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Weights of all pairs of a batch; those that reach into the next text are BORDER."""
    w = pair_weights(raw)
    border = offsets[1:-1] - 1
    w[border[(border >= 0) & (border < len(w))]] = BORDER
    return w


def _wide(w: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last pairs of the tokens of more than three bytes, once per place."""
    up, up_last = _reaching(w, far, True)
    # equal ends are met from both sides
    down, down_first = (len(w) - 1 - x[::-1] for x in _reaching(np.ascontiguousarray(w[::-1]), far, False))
    return np.concatenate([up, down_first]), np.concatenate([up_last, down])


def spans(raw: np.ndarray, offsets: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of each text in a batch, once per place."""
    if len(raw) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = _marked(raw, offsets)
    far = len(w) if limit is None else limit - 2  # from the first to the last pair
    inside = w < BORDER
    first, last = _wide(w, far)
    two = np.flatnonzero(inside) if far >= 0 else first[:0]
    three = np.flatnonzero(inside[:-1] & inside[1:]) if far >= 1 else first[:0]
    return np.concatenate([two, three, first]), np.concatenate([two + 2, three + 3, last + 2])


def fnv1a32(data: bytes) -> int:
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def fnv1a64_hex(text: str) -> str:
    """The name of an index for a root path."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


FNV, FNV_PRIME = np.uint32(0x811C9DC5), np.uint32(0x01000193)
SHARED = 24
"""First bytes whose hashes are made for all places at once."""
FEW = 64
"""So few ranges aren't continued a byte at a time any more, but each as a whole."""


def _fnv_continued(h: np.uint32, data: np.ndarray) -> np.uint32:
    """The FNV-1a state ``h`` after ``data``, without a step for each byte.

    The low eight bits of the states depend on nothing above them, and each bit is a
    running XOR once those below it are known. With them every XOR of a byte is the
    addition of a known number, so the whole is a polynomial in the prime.
    """
    low = np.zeros(len(data), np.uint8)  # of the states after the XOR
    for k in range(8):
        bit = np.uint8(k)
        turn = (data ^ low * np.uint8(0x93)) >> bit & np.uint8(1)
        before = np.bitwise_xor.accumulate(turn) ^ turn ^ np.uint8(int(h) >> k & 1)
        low |= (before ^ data >> bit & np.uint8(1)) << bit
    added = low.astype(np.uint32) - (low ^ data)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(len(data), FNV_PRIME))
        return (added * powers[::-1]).sum(dtype=np.uint32) + h * powers[-1]


def _fnv_ranges(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """32-bit FNV-1a of each range: those of up to SHARED bytes by place, longer ones
    a byte at a time while there are many, the last few by ``_fnv_continued``."""
    size = ends - starts
    out = np.full(len(starts), FNV)
    kind = np.minimum(size, SHARED + 1).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    bounds = np.searchsorted(kind[order], np.arange(SHARED + 2))
    h = np.full(len(raw), FNV)
    for k in range(min(SHARED, len(raw))):
        h = (h[: len(raw) - k] ^ raw[k:]) * FNV_PRIME
        own = order[bounds[k + 1] : bounds[k + 2]] if k + 1 < SHARED + 1 else order[:0]
        out[own] = h[starts[own]]
    own = order[bounds[SHARED + 1] :]
    if not len(own):
        return out
    own = own[np.argsort(-size[own], kind="stable")]
    state, at = h[starts[own]], starts[own].astype(np.int64) + SHARED
    left = size[own] - SHARED
    ascending = np.ascontiguousarray(left[::-1])
    done = 0
    while True:
        n = len(left) - int(np.searchsorted(ascending, done, "right"))
        if n <= FEW:
            break
        state[:n] = (state[:n] ^ raw[at[:n] + done]) * FNV_PRIME
        done += 1
    for i in range(n):
        end = int(at[i] + left[i])
        for a in range(int(at[i]) + done, end, 1 << 20):
            state[i] = _fnv_continued(state[i], raw[a : min(a + (1 << 20), end)])
    out[own] = state
    return out


def ngrams(data: bytes) -> list[bytes]:
    """The tokens of one text, repeats kept."""
    raw = np.frombuffer(data, np.uint8)
    return [data[a:b] for a, b in zip(*spans(raw, np.array([0, len(raw)])), strict=True)]


def covering(data: bytes) -> list[bytes]:
    """Tokens that tile a literal: from the left, the longest at each place. What is
    shorter than two bytes is its own tile, so the last may be one byte long."""
    if len(data) < 2:
        return [data]
    longest: dict[int, int] = {}
    for a, b in zip(*spans(np.frombuffer(data, np.uint8), np.array([0, len(data)])), strict=True):
        longest[int(a)] = max(longest.get(int(a), 0), int(b))
    out, at = [], 0
    while at < len(data):
        end = longest.get(at, len(data))
        out.append(data[at:end])
        at = end
    return out


def index_hash(data: bytes) -> int:
    """The hash that the index holds of a token, as a signed number."""
    raw = np.frombuffer(data, np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0])


PIECE = 1 << 18
"""Bytes of texts whose tokens are found at once: arrays of some 3 tokens a byte."""


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text of each start."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[starts]


def fnv_tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit hash and the text of each token, whatever its length."""
    starts, ends = spans(raw, offsets)
    return _fnv_ranges(raw, starts, ends), owners(starts, offsets)


def _kernel(fnv: bool, repeats: bool, texts: bool):
    """Kernel over (id, text): a row per token, or per different hash of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets, PIECE):
                own, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends = spans(own, at, None if fnv else MAX_BYTES)
                owner = owners(starts, at)
                h = _fnv_ranges(own, starts, ends).astype(np.int64) if fnv else span_hashes(own, starts, ends).view(np.int64)
                if not repeats:
                    order = np.lexsort((h, owner))
                    h, owner = h[order], owner[order]
                    keep = np.ones(len(h), bool)
                    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                    h, owner = h[keep], owner[keep]
                columns = {"doc_id": batch.column(0).slice(i, j - i).take(pa.array(owner)), "hash": pa.array(h)}
                if texts:
                    columns["start"] = pa.array(starts - at[owner])
                    columns["ngram"] = pa.array([bytes(own[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary())
                yield pa.record_batch(list(columns.values()), list(columns))

    return run


def ngram_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, hash, start, ngram)``: every token of every text, with the 32-bit
    FNV-1a hash. For inspection; the index uses ``pairs``."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).where(F.col(text_col).isNotNull())
    return source.mapInArrow(_kernel(True, True, True), "doc_id long, hash long, start long, ngram binary")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, hash, times)`` with the 32-bit FNV-1a hash. Tokens are counted text by
    text inside the kernel; counts are added up by a shuffle only if ids repeat."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets, PIECE):
                h, owner = fnv_tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys = owner.astype(np.uint64) << np.uint64(32) | h
                keys.sort()
                first = np.ones(len(keys), bool)
                first[1:] = keys[1:] != keys[:-1]
                at = np.flatnonzero(first)
                keys, times = keys[at], np.diff(np.r_[at, len(keys)])
                ids = batch.column(0).slice(i, j - i).take(pa.array((keys >> np.uint64(32)).astype(np.int64)))
                yield pa.record_batch([ids, pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(times)], ["doc_id", "hash", "times"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where(F.col("text").isNotNull())
    counts = source.mapInArrow(run, "doc_id long, hash long, times long")
    if source.groupBy("doc_id").count().where("count > 1").isEmpty():
        return counts
    return counts.groupBy("doc_id", "hash").agg(F.sum("times").alias("times"))


def pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fnv: bool = False) -> DataFrame:
    """``(doc_id, hash)``, different ones only: found per text inside the kernel, so
    nothing has to be shuffled to remove repeats."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).where(F.col(text_col).isNotNull())
    return source.mapInArrow(_kernel(fnv, False, False), "doc_id long, hash long")


STEP = 1 << 16
"""Bytes of texts of which the index' tokens are found at once: arrays that caches hold."""


def index_tokens(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The index' hash and the text of each token; with ``wanted``, of those only."""
    plain = None if wanted is None else unmix(wanted.view(np.uint64))
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in pieces(offsets, STEP):
        own = raw[offsets[i] : offsets[j]]
        if len(own) < 2:
            continue
        w = _marked(own, offsets[i : j + 1] - offsets[i])
        inside = w < BORDER
        first, last = _wide(w, MAX_BYTES - 2)
        two, three = short_hashes(own)
        for h, good, starts in ((two, inside, None), (three, inside[:-1] & inside[1:], None), (plain_hashes(own, first, last + 2), None, first)):
            if plain is not None:  # mixing is one to one, so what is wanted is known before it
                asked = np.isin(h, plain, kind="sort")
                good = asked if good is None else asked & good
            if good is not None:
                at = np.flatnonzero(good)
                h, starts = h[at], at if starts is None else starts[at]
            hashes.append(h)
            places.append(starts + offsets[i])
    found = np.concatenate(places)
    text = owners(found, offsets) if wanted is None else (np.searchsorted(offsets, found, "right") - 1).astype(np.int32)
    return mix(np.concatenate(hashes)).view(np.int64), text


def forward_tokens(docs: DataFrame, keys: str | list[str] = "doc_id", text_col: str = "text", wanted: list[int] | None = None) -> DataFrame:
    """``(keys, hashes)``: each row with the different hashes of its text, ascending,
    without a shuffle; with ``wanted``, those among them. A null text has none."""
    ship(docs.sparkSession)
    keys = [keys] if isinstance(keys, str) else keys
    some = None if wanted is None else np.array(sorted(wanted), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            raw, offsets = utf8(batch.column(at))
            for i, j in pieces(offsets, PIECE):
                h, owner = index_tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], some)
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                sizes = np.bincount(owner[keep], minlength=j - i)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(h[keep]))
                yield pa.record_batch([*[c.slice(i, j - i) for c in batch.columns[:at]], lists], [*batch.schema.names[:at], "hashes"])

    inner = docs.select(*keys, F.col(text_col).cast("binary")).toDF(*[f"c{i}" for i in range(len(keys) + 1)])
    schema = StructType([*inner.schema.fields[:-1], StructField("hashes", ArrayType(LongType()))])
    return inner.mapInArrow(run, schema).toDF(*keys, "hashes")


def partial_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs_per_shard: int = 1 << 62, bases: list[int] | None = None, wanted: list[int] | None = None) -> DataFrame:
    """``(hash, shard_id, doc_ids)``: posting lists of a batch of texts each, grouped
    in the kernel, so that fewer and shorter rows are shuffled than pairs. Shards
    are of so many documents, or begin at ``bases``. With ``wanted`` there are lists of
    these hashes only."""
    ship(docs.sparkSession)

    starts_at = np.array(bases or [0], np.int64)
    some = None if wanted is None else np.array(sorted(wanted), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in pieces(offsets):
                found = []
                # tokens by smaller pieces than lists: a byte takes hundreds of bytes of arrays
                for a, b in pieces(offsets[i : j + 1], PIECE):
                    a, b = i + a, i + b
                    h, owner = index_tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], some)
                    found.append((h, ids[a:b][owner]))
                h, doc = (np.concatenate(c) for c in zip(*found, strict=True))
                shard = doc // docs_per_shard if bases is None else np.searchsorted(starts_at, doc, "right") - 1
                order = np.lexsort((doc, h, shard))
                h, doc, shard = h[order], doc[order], shard[order]
                group = np.ones(len(h), bool)
                group[1:] = (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])
                fresh = group.copy()
                fresh[1:] |= doc[1:] != doc[:-1]
                begin = np.flatnonzero(group[fresh])
                if not len(begin):
                    continue
                lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, fresh.sum()], pa.int32()), pa.array(doc[fresh]))
                yield pa.record_batch([pa.array(h[group]), pa.array(shard[group]), lists], ["hash", "shard_id", "doc_ids"])

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    return source.mapInArrow(run, "hash long, shard_id long, doc_ids array<long>")
