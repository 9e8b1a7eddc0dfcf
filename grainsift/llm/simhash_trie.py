"""SimHash near-duplicates by a binary-trie self-join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainsift.functions.kernels import mix, pieces, utf8
from grainsift.llm._common import Words, cut, keep_columns, prepare, renamed, small, table, tidied
from grainsift.llm.components import connected_components

MAX_BITS = 10
"""Hamming budget on the 64 bits made from single words."""
MAX_PAIR_BITS = 16
"""Hamming budget on the further 64 bits made from word pairs."""
BUCKET_ROWS, BUCKET_MOST = 50_000, 1_000_000
"""Prints of a bucket's own, and how many it may have before prefixes get longer: a
task holds six times as many, of 24 bytes each."""
_LEAF = 24
_CHUNK = 1 << 20
WORD = r"[0-9A-Za-z[^\x00-\x7f]]"


# --- fingerprints ----------------------------------------------------------


def _signs(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """64-bit SimHash of each owner's set of hashes; ties give 0."""
    keep = np.uint64(n - 1).item().bit_length()
    keys = (owner.astype(np.uint64) << np.uint64(64 - keep)) | (hashes >> np.uint64(keep)) if keep else hashes.copy()
    order = np.argsort(keys)
    keys, hashes, owner = keys[order], hashes[order], owner[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    hashes, owner = hashes[fresh], owner[fresh]
    total = np.zeros((n, 64), np.int64)
    for at in range(0, len(hashes), 1 << 18):
        part, who = hashes[at : at + (1 << 18)], owner[at : at + (1 << 18)]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        begin = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        count = np.diff(np.r_[begin, len(who)])
        total[who[begin]] += 2 * ones - count[:, None]
    return np.packbits(total > 0, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def simhash(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints from the sets of words and of neighbouring word pairs, and
    whether a text has words at all. A text of one word uses it as its pair."""
    n = len(words.offsets) - 1
    owner = words.owner()
    h = words.hashes
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    same = owner[1:] == owner[:-1]
    lone = np.flatnonzero(np.diff(words.first) == 1)
    pair_hash = np.concatenate([pairs[same], h[words.first[lone]]])
    pair_owner = np.concatenate([owner[1:][same], lone])
    filled = np.diff(words.first) > 0
    return _signs(h, owner, n), _signs(pair_hash, pair_owner, n), filled


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, a, b)`` for every document with an id and at least one word."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                a, b, filled = simhash(words)
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i).filter(pa.array(filled)), pa.array(a[filled].view(np.int64)), pa.array(b[filled].view(np.int64))],
                    ["doc_id", "a", "b"],
                )

    prepare(docs.sparkSession)
    source = keep_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.where("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, a long, b long")


# --- trie self-join --------------------------------------------------------


_BLOCKS = (11, 11, 11, 11, 10, 10)
"""The bits of a key in six blocks; two neighbours are a pair."""
_FROM = tuple(sum(_BLOCKS[:i]) for i in range(6))


def _rotate(keys: np.ndarray, first: int) -> np.ndarray:
    """The order of bits for one pass: block ``first``, the other one of its pair, then
    the rest."""
    order = [first, first ^ 1, *[k for k in range(6) if k // 2 != first // 2]]
    out, at = np.zeros_like(keys), 64
    for k in order:
        at -= _BLOCKS[k]
        out |= ((keys >> np.uint64(64 - _FROM[k] - _BLOCKS[k])) & np.uint64((1 << _BLOCKS[k]) - 1)) << np.uint64(at)
    return out


def _budget(depth: int, bits: int, first: int) -> int:
    """Errors allowed once ``depth`` bits are read. Of ``bits`` errors at most a third
    fall in the best pair of blocks, and at most half of these, a sixth, in its better
    block; the six passes try each, so nothing within ``bits`` is lost."""
    size = _BLOCKS[first]
    return bits // 3 // 2 if depth <= size else bits // 3 if depth <= 2 * size else bits


def reach(top: int, bits: int, first: int) -> np.ndarray:
    """Differences of prefixes of ``top`` bits that stay within the budget at every
    depth: so many buckets, about half of them, a print is sent to in a pass."""
    found = np.zeros(1, np.int64)
    for depth in range(1, top + 1):
        found = np.concatenate([2 * found, 2 * found + 1])
        found = found[np.bitwise_count(found) <= _budget(depth, bits, first)]
    return np.sort(found)


def depth_of(rows: int) -> int:
    """Bits at which the trie is split: buckets of BUCKET_ROWS prints while the prefix
    lies in one block, where a print is sent to at most 36 buckets over all passes;
    then buckets grow to BUCKET_MOST, and only beyond that does the prefix."""
    wanted = math.ceil(math.log2(max(1, rows) / BUCKET_ROWS)) if rows else 0
    return max(3, min(wanted, 10) if rows <= BUCKET_MOST << 10 else min(16, math.ceil(math.log2(rows / BUCKET_MOST))))


def trie_pairs(keys: np.ndarray, bits: int, top: int, own: int | None, first: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted ``keys`` (bits in the order of the pass) whose
    difference stays within the budget at every depth.

    Two nodes of the trie (ranges of ``keys`` with a common prefix) are walked down
    together with the number of differing bits so far; a pair of nodes is dropped
    as soon as the budget is exceeded. ``own``: the prefix of ``top`` bits that one
    side must have; None for all. ``first`` is the block that the pass begins with.
    """
    n = len(keys)
    if n < 2:
        return
    ones_below: dict[int, np.ndarray] = {}

    def ones(depth: int) -> np.ndarray:
        if depth not in ones_below:
            c = np.zeros(n + 1, np.int32)
            np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), out=c[1:])
            ones_below[depth] = c
        return ones_below[depth]

    def leaf(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        na, nb = f[1] - f[0], f[3] - f[2]
        size = na.astype(np.int64) * nb
        which = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        width = nb[which]
        i, j = f[0][which] + k // width, f[2][which] + k % width
        good = i < j
        good &= np.bitwise_count(keys[i] ^ keys[j]) <= bits
        return i[good], j[good]

    if own is None:
        start, depth = np.array([[0], [n], [0], [n], [0]], np.int32), 0
    else:
        prefix = (keys >> np.uint64(64 - top)).astype(np.int64)
        values, lo = np.unique(prefix, return_index=True)
        hi = np.r_[lo[1:], n]
        at = np.flatnonzero(values == own)
        if not len(at):
            return
        err = np.bitwise_count((values ^ own).astype(np.uint64)).astype(np.int64)
        use = np.flatnonzero((values >= own) & np.isin(values ^ own, reach(top, bits, first)))
        a = np.full(len(use), at[0])
        start, depth = np.array([lo[a], hi[a], lo[use], hi[use], err[use]], np.int32), top
    stack = [(depth, start)]
    while stack:
        depth, f = stack.pop()
        na, nb = (f[1] - f[0]).astype(np.int64), (f[3] - f[2]).astype(np.int64)
        done = (na * nb <= _LEAF) | (depth == 64)
        if done.any():
            g = f[:, done]
            size = np.cumsum((g[1] - g[0]).astype(np.int64) * (g[3] - g[2]))
            begin = 0
            while begin < len(size):  # expanded in bounded parts
                base = size[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(size, base + 4 * _CHUNK, "right")))
                yield leaf(g[:, begin:end])
                begin = end
            f = f[:, ~done]
        if not f.shape[1]:
            continue
        if f.shape[1] > _CHUNK:
            half = f.shape[1] // 2
            stack += [(depth, f[:, half:]), (depth, f[:, :half])]
            continue
        c = ones(depth)
        a_mid, b_mid = f[1] - (c[f[1]] - c[f[0]]), f[3] - (c[f[3]] - c[f[2]])
        same = f[0] == f[2]
        children = []
        allowed = _budget(depth + 1, bits, first)
        for alo, ahi, blo, bhi, extra in ((f[0], a_mid, f[2], b_mid, 0), (a_mid, f[1], b_mid, f[3], 0), (f[0], a_mid, b_mid, f[3], 1), (a_mid, f[1], f[2], b_mid, 1)):
            err = f[4] + extra
            ok = (ahi > alo) & (bhi > blo) & (err <= allowed)
            if extra and alo is a_mid:
                ok &= ~same  # the mirror of the pair before
            if not extra:
                ok &= ~(same & (ahi - alo < 2))
            children.append(np.array([alo[ok], ahi[ok], blo[ok], bhi[ok], err[ok]], np.int32))
        stack.append((depth + 1, np.concatenate(children, axis=1)))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index connected with each of ``n`` nodes."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def near_edges(prints: DataFrame, bits: int = MAX_BITS, pair_bits: int = MAX_PAIR_BITS, rows: int | None = None, top: int | None = None) -> DataFrame:
    """``(u, v)`` edges whose components are those of all pairs of ``prints(id, a,
    b)`` with at most ``bits`` different bits in ``a`` and ``pair_bits`` in ``b``.

    Six passes, one for each block of ``a`` read first. A pass splits the trie at
    ``top`` bits (by the number of prints); a bucket receives its own prints and those
    of the buckets above it within the budget, so every pair of nodes meets in one
    task. Each task replaces its pairs by a spanning forest. A bucket into which many
    more prints fall than into others is still one task: prints are equal only once,
    so it holds different ones, of 24 bytes, and its pairs are expanded in bounded
    parts.
    """
    top = depth_of(prints.count() if rows is None else rows) if top is None else top
    far = [reach(top, bits, first) for first in range(6)]

    @tidied
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for first in range(6):
                turned = _rotate(a.view(np.uint64), first)
                home = (turned >> np.uint64(64 - top)).astype(np.int64)
                bucket = home[:, None] ^ far[first][None, :]
                row, col = np.nonzero(bucket <= home[:, None])
                yield pa.record_batch(
                    [pa.array((first << top) + bucket[row, col]), pa.array(turned[row].view(np.int64)), pa.array(b[row]), pa.array(ids[row])], ["task", "key", "b", "id"]
                )

    def join(key: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
        k = frame.column("key").to_numpy().view(np.uint64)
        b = frame.column("b").to_numpy().view(np.uint64)
        ids = frame.column("id").to_numpy()
        order = np.argsort(k, kind="stable")
        k, b, ids = k[order], b[order], ids[order]
        label = np.arange(len(k))
        task = key[0].as_py()
        for i, j in trie_pairs(k, bits, top, task & ((1 << top) - 1), task >> top):
            near = np.bitwise_count(b[i] ^ b[j]) <= pair_bits
            i, j = label[i[near]], label[j[near]]
            if (i != j).any():
                label = forest(len(k), i[i != j], j[i != j])[label]
        moved = np.flatnonzero(label != np.arange(len(k)))
        return pa.table({"u": ids[moved], "v": ids[label[moved]]})

    tasks = prints.select("id", "a", "b").mapInArrow(spread, "task long, key long, b long, id long")
    return tasks.groupBy("task").applyInArrow(join, "u long, v long")


def _resolve(docs: DataFrame, bits: int, pair_bits: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, a, b, copies)`` and ``(doc_id, group_id)``, both cut."""
    prints = cut(fingerprints(docs).groupBy("doc_id", "a", "b").agg(F.count("*").alias("copies")))
    distinct = cut(prints.groupBy("a", "b").agg(F.min("doc_id").alias("id")))
    # equal fingerprints; one id with several texts links their fingerprints too
    equal = prints.join(distinct, ["a", "b"]).select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    edges = near_edges(distinct, bits, pair_bits).unionByName(equal).where("u <> v")
    groups = connected_components(cut(edges.distinct()))
    return prints, cut(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group_id")))


def near_groups(docs: DataFrame, bits: int = MAX_BITS, pair_bits: int = MAX_PAIR_BITS) -> DataFrame:
    """``(doc_id, group_id, group_size, copies)`` for every document that has a near
    copy; ``group_id`` is the least doc_id of the group, ``copies`` the number of
    rows with this doc_id.

    Two documents are near copies if their fingerprints differ in at most ``bits``
    and ``pair_bits`` bits; groups are the connected components. Rows without id,
    and texts that are null or hold no word, are never compared and not returned.
    Repeated rows are one document. An empty table gives an empty result.
    """
    prints, groups = _resolve(docs, bits, pair_bits)
    sizes = cut(groups.groupBy("group_id").agg(F.count("*").alias("group_size")))  # written, so that the join can split a hot group
    copies = prints.groupBy("doc_id").agg(F.sum("copies").alias("copies"))
    return groups.join(sizes, "group_id").join(copies, "doc_id").select("doc_id", "group_id", "group_size", "copies")


def drop_near_copies(docs: DataFrame, bits: int = MAX_BITS, pair_bits: int = MAX_PAIR_BITS) -> DataFrame:
    """``docs`` with one document of each group, the one with the least doc_id, and
    all its columns; of repeated rows of a doc_id the one with the least text
    stays. Rows without id, and texts that are null or hold no word, stay."""
    prints, groups = _resolve(docs, bits, pair_bits)
    gone = cut(groups.where("doc_id <> group_id").select(F.col("doc_id").alias("gone")))
    gone = small(gone, gone.count())
    inner, at = renamed(docs)
    ident, text = F.col(at["doc_id"]).cast("long"), F.col(at["text"])
    kept = inner.join(gone, ident == F.col("gone"), "left_anti")
    repeated = cut(prints.groupBy(F.col("doc_id").alias("again")).agg(F.sum("copies").alias("n")).where("n > 1").select("again"))
    n = repeated.count()
    if not n:
        return kept.toDF(*docs.columns)
    repeated = small(repeated, n)
    wordy = text.isNotNull() & text.rlike(WORD)
    order = Window.partitionBy(ident).orderBy(text, *[c for c in inner.columns if c not in (at["doc_id"], at["text"])])
    one = kept.join(repeated, (ident == F.col("again")) & wordy, "left_semi").withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    return kept.join(repeated, (ident == F.col("again")) & wordy, "left_anti").unionByName(one).toDF(*docs.columns)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
