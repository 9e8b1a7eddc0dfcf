"""Posting lists by ranges of hashes: pairs of hash and text go through the shuffle in
packed blocks, and lists are made, counted or measured range by range in a kernel.

A block holds the different pairs of a group of texts whose hashes lie in one range:
gaps of hashes, the length of each list and gaps of ids, byte plane by byte plane, so
that the planes of leading zeros compress to nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsift.functions.kernels import pieces, utf8
from grainsift.functions.ngrams import PIECE, fnv_tokens
from grainsift.functions.ship import ship

RANGE_BYTES = 2 << 20
"""Bytes of texts for which there is a range of hashes; a byte gives about one pair."""
GROUP_PAIRS = 4 << 20
SECTION_IDS = 1 << 20
"""Documents in a section: a hash that all of them hold has no more ids in memory."""
OUT_ROWS = 1 << 18
HALF = np.uint64(32)
LOW = np.uint64(0xFFFFFFFF)


def fresh(keys: np.ndarray) -> np.ndarray:
    """Where a sorted array takes another value than before."""
    out = np.ones(len(keys), bool)
    out[1:] = keys[1:] != keys[:-1]
    return out


def gaps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences to the value before; whole where ``first`` holds."""
    out = values.copy()
    out[1:] -= np.where(first[1:], values.dtype.type(0), values[:-1])
    return out


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums that begin anew after each ``sizes`` values; undoes ``gaps``."""
    total = np.cumsum(values)
    begin = np.cumsum(sizes) - sizes
    return total - np.repeat(total[begin] - values[begin], sizes)


def planes(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def unplanes(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate([p.T for p in parts])
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view("<u8").ravel()


class Layout:
    """``bits`` of a hash give its range, ``low`` and ``width`` an id's section."""

    def __init__(self, bits: int, low: int, width: int):
        self.bits, self.low, self.width = bits, np.uint64(low & (1 << 64) - 1), np.uint64(width)
        self.id_bytes = max(1, -(-(width - 1).bit_length() // 8))

    def blocks(self, keys: list[np.ndarray], ids: list[np.ndarray], tokens: int) -> pa.RecordBatch:
        """A row per range and section of ``keys``: hash above the place of the text in
        its own array of ``ids``."""
        known, place = np.unique(np.concatenate(ids), return_inverse=True)
        bases = np.cumsum([0, *map(len, ids)])
        own = np.concatenate([k & ~LOW | place[base + (k & LOW).astype(np.int64)].astype(np.uint64) for k, base in zip(keys, bases, strict=False)])
        own.sort()
        own = own[fresh(own)]
        offset = known.astype(np.int64).view(np.uint64) - self.low
        section, inside = offset // self.width, offset % self.width
        rows: list[tuple[int, int, bytes]] = []
        present = np.unique(section)
        for s in present:
            k = own if len(present) == 1 else own[section[(own & LOW).astype(np.int64)] == s]
            h = k >> HALF
            which = (h >> np.uint64(32 - self.bits)).astype(np.int64)
            at = np.flatnonzero(fresh(h))
            hs, ranges = h[at], which[at]
            counts = np.diff(np.r_[at, len(k)])
            new = np.zeros(len(k), bool)
            new[at] = True
            d = planes(gaps(inside[(k & LOW).astype(np.int64)], new), self.id_bytes)
            h4, c4 = planes(gaps(hs, fresh(ranges)), 4), planes(counts, 4)
            begin = np.flatnonzero(fresh(ranges))
            ends = np.r_[begin[1:], len(hs)]
            firsts = np.r_[at, len(k)]
            for b, a, e, p, q in zip(ranges[begin].tolist(), begin.tolist(), ends.tolist(), firsts[begin].tolist(), firsts[ends].tolist(), strict=True):
                rows.append((b, int(s), (e - a).to_bytes(4, "little") + h4[:, a:e].tobytes() + c4[:, a:e].tobytes() + d[:, p:q].tobytes()))
        if not rows:  # texts without tokens
            return pa.record_batch([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["range", "section", "tokens", "block"])
        ranges_, sections_, blocks_ = zip(*rows, strict=True)
        tokens_ = [tokens] + [0] * (len(rows) - 1)
        return pa.record_batch([pa.array(ranges_, pa.int32()), pa.array(sections_, pa.int64()), pa.array(tokens_, pa.int64()), pa.array(blocks_, pa.binary())], ["range", "section", "tokens", "block"])

    def opened(self, section: int, blocks: list[pa.Buffer]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and ids of the different pairs of one range and section, in order."""
        hs, cs, ds, n = [], [], [], []
        for block in blocks:
            m = int(np.frombuffer(block, "<u4", 1)[0])
            n.append(m)
            hs.append(np.frombuffer(block, np.uint8, 4 * m, 4).reshape(4, m))
            cs.append(np.frombuffer(block, np.uint8, 4 * m, 4 + 4 * m).reshape(4, m))
            ds.append(np.frombuffer(block, np.uint8, -1, 4 + 8 * m).reshape(self.id_bytes, -1))
        counts = unplanes(cs).astype(np.int64)
        h = np.repeat(sums(unplanes(hs), np.array(n)), counts)
        inside = sums(unplanes(ds), counts)
        if self.id_bytes <= 4:
            keys = h << HALF | inside
            keys.sort()
            keys = keys[fresh(keys)]
            h, inside = keys >> HALF, keys & LOW
        else:
            order = np.lexsort((inside, h))
            h, inside = h[order], inside[order]
            keep = fresh(h) | fresh(inside)
            h, inside = h[keep], inside[keep]
        return h.view(np.int64), (inside + self.low + np.uint64(section) * self.width).view(np.int64)


def layout(docs: DataFrame, id_col: str, text_col: str, docs_per_shard: int | None, whole: bool) -> Layout:
    """By the bytes of the texts, and their ids. Sections begin where shards do; if
    lists are to be ``whole`` there is one."""
    kept = F.col(text_col).isNotNull() & F.col(id_col).isNotNull()
    size, count, low, high = docs.where(kept).agg(F.sum(F.octet_length(text_col)), F.count("*"), F.min(id_col), F.max(id_col)).first()
    if not count:
        return Layout(1, 0, 1)
    per = docs_per_shard or 1
    low = low // per * per
    sections = 1 if whole else -(-count // SECTION_IDS)
    width = -(-(high + 1 - low) // (sections * per)) * per
    return Layout(min(31, max(1, (size // RANGE_BYTES).bit_length())), low, min(width, (1 << 64) - 1))


Reducer = Callable[[Layout], Callable[[Iterator[tuple[int, int, list[pa.Buffer], int]]], Iterator[pa.RecordBatch]]]


def by_range(docs: DataFrame, reducer: Reducer, schema: str, id_col: str = "doc_id", text_col: str = "text", docs_per_shard: int | None = None, whole: bool = False) -> DataFrame:
    """What ``reducer`` makes of the blocks of each range and section, in order. Null
    ids and null texts have no tokens."""
    ship(docs.sparkSession)
    plan = layout(docs, id_col, text_col, docs_per_shard, whole)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, pairs, tokens = [], [], 0, 0
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            docs_ = batch.column(0).to_numpy()
            for i, j in pieces(offsets, PIECE):
                h, owner = fnv_tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                k = h.astype(np.uint64) << HALF | owner.astype(np.uint64)
                k.sort()
                tokens += len(k)
                k = k[fresh(k)]
                keys.append(k)
                ids.append(docs_[i:j])
                pairs += len(k)
                if pairs >= GROUP_PAIRS:
                    yield plan.blocks(keys, ids, tokens)
                    keys, ids, pairs, tokens = [], [], 0, 0
        if keys:
            yield plan.blocks(keys, ids, tokens)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[int, int, list[pa.Buffer], int]]:
            at, held, tokens = None, [], 0
            for batch in batches:
                # blocks stay where they are: buffers, no copies
                for r, s, t, block in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3), strict=True):
                    if (r, s) != at:
                        if held:
                            yield *at, held, tokens
                        at, held, tokens = (r, s), [], 0
                    held.append(block.as_buffer())
                    tokens += t
            if held:
                yield *at, held, tokens

        yield from reducer(plan)(groups())

    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    blocks = texts.mapInArrow(pack, "range int, section long, tokens long, block binary")
    return blocks.repartition("range").sortWithinPartitions("range", "section").mapInArrow(reduce, schema)


def _lists(docs_per_shard: int | None) -> Reducer:
    def reducer(plan: Layout):
        def run(groups: Iterator[tuple[int, int, list[pa.Buffer], int]]) -> Iterator[pa.RecordBatch]:
            for _, section, blocks, _ in groups:
                h, ids = plan.opened(section, blocks)
                shard = ids // docs_per_shard if docs_per_shard else np.zeros(len(ids), np.int64)
                begin = np.flatnonzero(fresh(h) | fresh(shard))
                ends = np.r_[begin[1:], len(ids)]
                for a, e in slices(begin, ends):
                    at = begin[a]
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[begin[a:e], ends[e - 1]] - at, pa.int32()), pa.array(ids[at : ends[e - 1]]))
                    columns = {"hash": pa.array(h[begin[a:e]])} | ({"shard_id": pa.array(shard[begin[a:e]])} if docs_per_shard else {}) | {"doc_ids": lists}
                    yield pa.record_batch(list(columns.values()), list(columns))

        return run

    return reducer


def slices(begin: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lists with at most OUT_ROWS ids together (one list at least)."""
    a = 0
    while a < len(begin):
        e = max(a + 1, int(np.searchsorted(ends, begin[a] + OUT_ROWS, "right")))
        yield a, e
        a = e


def varint_sizes(values: np.ndarray) -> np.ndarray:
    """As ``varint_size`` of columns; gaps come unsigned."""
    return 1 + sum((values >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))


def _sizes(plan: Layout):
    """Per range: hashes, numbers of documents, bytes of their lists, tokens. Sections
    come in order of id, so only the gap between two of them is still to be measured."""

    def run(groups: Iterator[tuple[int, int, list[pa.Buffer], int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        at, parts, tokens = None, [], 0
        for r, section, blocks, t in groups:
            if r != at and parts:
                yield *measured(parts), tokens
                parts, tokens = [], 0
            at = r
            tokens += t
            h, ids = plan.opened(section, blocks)
            first = fresh(h)
            begin = np.flatnonzero(first)
            inner = np.where(first, 0, varint_sizes(gaps(ids, first).view(np.uint64)))
            parts.append((h[begin], np.diff(np.r_[begin, len(h)]), np.add.reduceat(inner, begin), ids[begin], ids[np.r_[begin[1:], len(h)] - 1]))
        if parts:
            yield *measured(parts), tokens

    def measured(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, n, inner, low, high = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, n, inner, low, high = (c[order] for c in (h, n, inner, low, high))
        new = fresh(h)
        gap = (low - np.r_[0, high[:-1]]).view(np.uint64)
        inner = inner + np.where(new, varint_sizes(low), varint_sizes(gap))
        begin = np.flatnonzero(new)
        df = np.add.reduceat(n, begin)
        return h[begin], df, np.where(df == 1, 0, np.add.reduceat(inner, begin) + varint_sizes(df))

    return run


def _per_hash(name: str, column: int) -> Reducer:
    def reducer(plan: Layout):
        def run(groups: Iterator[tuple[int, int, list[pa.Buffer], int]]) -> Iterator[pa.RecordBatch]:
            for found in _sizes(plan)(groups):
                for a in range(0, len(found[0]), OUT_ROWS):
                    yield pa.record_batch([pa.array(found[0][a : a + OUT_ROWS]), pa.array(found[column][a : a + OUT_ROWS])], ["hash", name])

        return run

    return reducer


def _totals(plan: Layout):
    def run(groups: Iterator[tuple[int, int, list[pa.Buffer], int]]) -> Iterator[pa.RecordBatch]:
        for _, df, size, tokens in _sizes(plan)(groups):
            row = {"pairs": tokens, "unique_pairs": int(df.sum()), "lookup_rows": len(df), "inline_singletons": int((df == 1).sum()), "payload_bytes": int(size.sum())}
            yield pa.record_batch([pa.array([v], pa.int64()) for v in row.values()], list(row))

    return run


def fnv_postings(docs: DataFrame, docs_per_shard: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(hash, doc_ids)``, ascending and without repeats; with ``docs_per_shard`` also
    ``shard_id``: a list then holds one range of documents, so no cell grows with the
    corpus."""
    shard = "shard_id long, " if docs_per_shard else ""
    return by_range(docs, _lists(docs_per_shard), f"hash long, {shard}doc_ids array<long>", id_col, text_col, docs_per_shard, not docs_per_shard)


def fnv_document_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return by_range(docs, _per_hash("df", 1), "hash long, df long", id_col, text_col)


def fnv_posting_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(hash, bytes)``: the size of a list as a count and gaps of varints; lists of
    one document are kept in the lookup and take none."""
    return by_range(docs, _per_hash("bytes", 2), "hash long, bytes long", id_col, text_col)


def fnv_index_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: pairs, different pairs, lookup rows, inline singletons, payload."""
    names = ("pairs", "unique_pairs", "lookup_rows", "inline_singletons", "payload_bytes")
    rows = by_range(docs, _totals, ", ".join(f"{n} long" for n in names), id_col, text_col)
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
