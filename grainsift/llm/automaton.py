"""Substring deduplication with suffix automata of reference shards."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.functions.kernels import pieces, utf8
from grainsift.llm._common import Words, cut, keep_columns, prepare, renamed, rolling, sliding_min, small, table, tidied

MIN_WORDS = 50
"""Shared spans of at least so many words go."""
ANCHOR_WORDS = 25
"""Words hashed into an anchor; every span of MIN_WORDS holds one."""
SHARD_DOCS = 400
HOT_DOCS = 10_000
"""Anchors that more documents share are settled by windows instead of an automaton,
so that no shard holds the surroundings of a passage that a third of them have."""
REFERENCE_BYTES = 48 << 20
"""Automata of a reference are broadcast in parts of at most this size, a pass each."""
SHARD_WORDS = 100_000
"""Words of a reference in one automaton."""


class Automaton:
    """Suffix automaton of any number of sequences of integers."""

    __slots__ = ("length", "link", "next")

    def flat(self) -> bytes:
        """Links, lengths and transitions as arrays: 12 bytes a state and 8 a transition."""
        degree = np.fromiter(map(len, self.next), np.int32, len(self.next))
        edges = int(degree.sum())
        symbols = np.fromiter((c for t in self.next for c in t), np.uint32, edges)
        targets = np.fromiter((q for t in self.next for q in t.values()), np.int32, edges)
        columns = (np.array(self.link, np.int32), np.array(self.length, np.int32), degree, symbols, targets)
        return b"".join(len(x).to_bytes(8, "little") + x.tobytes() for x in columns)

    @classmethod
    def of(cls, data: bytes) -> Automaton:
        at, parts = 0, []
        for kind in (np.int32, np.int32, np.int32, np.uint32, np.int32):
            n = int.from_bytes(data[at : at + 8], "little")
            parts.append(np.frombuffer(data, kind, n, at + 8))
            at += 8 + 4 * n
        link, length, degree, symbols, targets = parts
        out = cls()
        out.link, out.length = link.tolist(), length.tolist()
        symbols, targets, ends = symbols.tolist(), targets.tolist(), np.cumsum(degree).tolist()
        out.next = [dict(zip(symbols[a:b], targets[a:b], strict=True)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def add(self, sequence: Sequence[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        p = 0
        for c in sequence:
            q = nxt[p].get(c)
            if q is not None:
                p = q if length[q] == length[p] + 1 else self._split(p, c, q)
                continue
            made = len(nxt)
            nxt.append({})
            length.append(length[p] + 1)
            link.append(0)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = made
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[made] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            p = made

    def holds(self, sequence: Sequence[int]) -> bool:
        """Whether the whole sequence is one match."""
        s: int | None = 0
        for c in sequence:
            s = self.next[s].get(c)
            if s is None:
                return False
        return True

    def spans(self, sequence: Sequence[int], least: int) -> list[list[int]]:
        """The union of all matches of at least ``least`` symbols, from the matching
        statistics of the sequence."""
        nxt, link, length = self.next, self.link, self.length
        found: list[list[int]] = []
        s = size = 0
        for i, c in enumerate(sequence):
            n = nxt[s].get(c)
            while n is None and s:
                s = link[s]
                size = length[s]
                n = nxt[s].get(c)
            if n is None:
                size = 0
                continue
            s = n
            size += 1
            if size >= least:
                if found and i + 1 - size <= found[-1][1]:
                    found[-1][1] = i + 1
                else:
                    found.append([i + 1 - size, i + 1])
        return found


# --- anchors ---------------------------------------------------------------


def anchors(words: Words, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the winnowed ``k``-grams: of every ``span`` words in one
    text all k-grams with the least hash, so equal spans have equal anchors."""
    h = rolling(words.hashes, k)
    w = span - k + 1
    n = len(h) - w + 1
    if n <= 0:
        return h[:0], np.zeros(0, np.int64)
    least = sliding_min(h, w)
    ends = words.first[1:][words.owner()]
    least[np.arange(n) + span > ends[:n]] = 0
    # the greatest minimum of the spans that hold a k-gram is its own hash if one chose it
    padded = np.zeros(n + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + n] = least
    chosen = np.flatnonzero(~sliding_min(~padded, w) == h)
    return h[chosen], chosen


def anchor_rows(docs: DataFrame, span: int, k: int) -> DataFrame:
    """``(fp, doc_id)``, once per text."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in pieces(offsets):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h, at = anchors(words, span, k)
                owner = np.searchsorted(words.first, at, "right") - 1
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                yield pa.record_batch([pa.array(h[fresh].view(np.int64)), pa.array(ids[i:j][owner[fresh]])], ["fp", "doc_id"])

    source = keep_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.where("doc_id is not null and text is not null").mapInArrow(run, "fp long, doc_id long")


# --- contexts --------------------------------------------------------------


def _shared(text: str | None, span: int, k: int, fps: np.ndarray, owners: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """A text's words, where they start, and of its anchors among ``fps`` the first
    words and the owners."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]))
    h, at = anchors(words, span, k)
    order = np.argsort(fps)
    fps, owners = fps[order], owners[order]
    where = np.minimum(np.searchsorted(fps, h.view(np.int64)), len(fps) - 1)
    hit = fps[where] == h.view(np.int64)
    return words, np.r_[words.starts, len(data)], at[hit], owners[where[hit]]


def _windows(span: int, k: int):
    """Kernel: every window of ``span`` words around a document's anchors, with its
    hash and its bytes."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for r in range(batch.num_rows):
                pairs = lists[r].values
                words, starts, at, _ = _shared(batch.column(2)[r].as_py(), span, k, pairs.field(0).to_numpy(zero_copy_only=False), pairs.field(1).to_numpy(zero_copy_only=False))
                n = len(words.starts) - span + 1
                first = np.unique((at[:, None] - np.arange(span - k + 1)[None, :]).ravel())
                first = first[(first >= 0) & (first < n)]
                ident = [batch.column(c).slice(r, 1).take(pa.array(np.zeros(len(first), np.int64))) for c in (0, 1)]
                h = rolling(words.hashes, span)[first].view(np.int64) if n > 0 else np.zeros(0, np.int64)
                yield pa.record_batch([pa.array(h), *ident, pa.array(starts[first]), pa.array(starts[first + span])], ["w", "doc_id", "h", "start", "stop"])

    return run


def _contexts(span: int, k: int, shards: int):
    """Kernel: the words around a document's shared anchors, a row for each run of
    anchors with the same first owner."""

    def one(text: str | None, fps: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes, int]]:
        words, starts, at, own = _shared(text, span, k, fps, owners)
        order = np.lexsort((at, own))
        at, own = at[order], own[order]
        if not len(at):
            return
        n = len(words.starts)
        low, high = np.maximum(at - (span - k), 0), np.minimum(at + span, n)
        breaks = np.flatnonzero((own[1:] != own[:-1]) | (low[1:] > high[:-1])) + 1
        short = (words.hashes >> np.uint64(32)).astype(np.uint32)
        for a, b in zip(np.r_[0, breaks], np.r_[breaks, len(at)], strict=True):
            x, y = int(low[a]), int(high[b - 1])
            gaps = np.diff(starts[x : y + 1]).astype(np.uint32)
            yield int(own[a]) % shards, int(starts[x]), short[x:y].tobytes(), gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), y - x

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h = batch.column(0), batch.column(1)
            text, lists = batch.column(2), batch.column(3)
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for r in range(batch.num_rows):
                pairs = lists[r].values
                for shard, start, body, gaps, _ in one(text[r].as_py(), pairs.field(0).to_numpy(zero_copy_only=False), pairs.field(1).to_numpy(zero_copy_only=False)):
                    for column, value in zip(out, (shard, ids[r].as_py(), h[r].as_py(), start, body, gaps), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["shard", "doc_id", "h", "start", "words", "gaps"])

    return run


def _stream(span: int):
    """Kernel over rows sorted by shard and document: each document is streamed
    through the automaton of the documents before it, then added where it is new."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen, shard, doc, waiting = Automaton(), set(), None, None, []
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for s, d, h, start, body, gaps in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if s != shard:
                    automaton, seen, shard, doc, waiting = Automaton(), set(), s, None, []
                if d != doc:
                    for other in waiting:
                        seen.add(other)
                        automaton.add(np.frombuffer(other, np.uint32).tolist())
                    doc, waiting = d, []
                n = len(body) // 4
                if body in seen:
                    found = [[0, n]]
                else:
                    symbols = np.frombuffer(body, np.uint32).tolist()
                    found = automaton.spans(symbols, span)
                    # spans merge: runs across the seam of two matches are new
                    if found != [[0, n]] or not automaton.holds(symbols):
                        waiting.append(body)
                if found:
                    at = start + np.r_[0, np.cumsum(np.frombuffer(gaps, np.uint8).reshape(4, n).T.copy().view(np.uint32).ravel(), dtype=np.int64)]
                    for x, y in found:
                        for column, value in zip(out, (d, h, int(at[x]), int(at[y])), strict=True):
                            column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["doc_id", "h", "start", "stop"])

    return run


def _without(text: F.Column, spans: F.Column) -> F.Column:
    """The text without its byte ranges (start, stop), in one pass over them sorted."""
    data = text.cast("binary")
    begin = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("out"))

    def step(acc: F.Column, s: F.Column) -> F.Column:
        part = F.when(s["start"] > acc["pos"], F.substr(data, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))).otherwise(F.lit(b""))
        return F.struct(F.greatest(acc["pos"], s["stop"]).alias("pos"), F.concat(acc["out"], part).alias("out"))

    done = F.aggregate(F.array_sort(spans), begin, step, lambda acc: F.concat(acc["out"], F.substr(data, (acc["pos"] + 1).cast("int"))))
    return done.cast("string")


def _runs(spans: F.Column) -> F.Column:
    """How many runs the spans make up together."""
    begin = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: F.Column, s: F.Column) -> F.Column:
        return F.struct(F.greatest(acc["end"], s["stop"]).alias("end"), (acc["n"] + (s["start"] > acc["end"]).cast("long")).alias("n"))

    return F.aggregate(F.array_sort(spans), begin, step, lambda acc: acc["n"])


SPANS = "doc_id long, h long, start long, stop long"


def _keyed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., ``doc_id`` and the text's hash ``h``."""
    inner, at = renamed(docs)
    return inner.withColumns({"doc_id": F.col(at["doc_id"]).cast("long"), "h": F.xxhash64(F.col(at["text"]).cast("string"))}), at


def _sent(ids: DataFrame) -> DataFrame:
    """A table of ids, written to the shared folder; broadcast while it is small."""
    ids = cut(ids)
    return small(ids, ids.count())


def shared_spans(docs: DataFrame, span: int = MIN_WORDS, k: int = ANCHOR_WORDS, hot_docs: int = HOT_DOCS) -> DataFrame:
    """``(doc_id, h, start, stop)``: the bytes of each text that an earlier document
    shares, overlapping ones too.

    Only texts with a shared anchor are shuffled. Anchors are counted with map-side
    combine; the joins with what is shared are of two written tables, so a hot
    anchor or document is split by adaptive execution.
    """
    prepare(docs.sparkSession)
    rows, at = _keyed(docs)
    shards = max(16, math.ceil(docs.count() / SHARD_DOCS))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = anchor_rows(docs, span, k)
    owners = fps.groupBy("fp").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("times")).where("owner < last")
    owners = cut(owners.select(F.col("fp").alias("ofp"), "owner", (F.col("times") > hot_docs).alias("hot")))
    hits = cut(fps.join(owners, F.col("fp") == F.col("ofp")).groupBy("doc_id").agg(F.collect_list(F.struct("fp", "owner", "hot")).alias("hits")))
    texts = rows.select("doc_id", "h", F.col(at["text"]).cast("string").alias("text"))

    def near(hot: bool) -> DataFrame:
        own = hits.select(F.col("doc_id").alias("hit_id"), F.transform(F.filter("hits", lambda x: x["hot"] == hot), lambda x: F.struct(x["fp"], x["owner"])).alias("hits")).where(F.size("hits") > 0)
        ids = _sent(own.select("hit_id"))
        return texts.join(ids, F.col("doc_id") == F.col("hit_id"), "left_semi").join(own, F.col("doc_id") == F.col("hit_id")).select("doc_id", "h", "text", "hits")

    contexts = near(False).mapInArrow(_contexts(span, k, shards), "shard long, doc_id long, h long, start long, words binary, gaps binary")
    found = contexts.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "h", "start").mapInArrow(_stream(span), SPANS)
    if owners.where("hot").isEmpty():
        return found
    windows = near(True).mapInArrow(_windows(span, k), "w long, " + SPANS)
    first = windows.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = cut(first.select(F.col("w").alias("fw"), "first"))
    return found.unionByName(windows.join(first, (F.col("w") == F.col("fw")) & (F.col("doc_id") > F.col("first"))).select("doc_id", "h", "start", "stop"))


def remove_spans(docs: DataFrame, spans: DataFrame, changed_only: bool = False) -> DataFrame:
    """``docs`` without the bytes of ``spans(doc_id, h, start, stop)``. Only changed
    rows are joined with their spans; the others pass without a shuffle while the
    ids of changed ones fit a broadcast."""
    rows, at = _keyed(docs)
    spans = cut(spans.groupBy(F.col("doc_id").alias("span_id"), F.col("h").alias("span_h")).agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    # one long as the key of the larger tables: rows that only share its hash have no spans
    keys = _sent(spans.select(F.xxhash64("span_id", "span_h").alias("key")).distinct())
    own = F.xxhash64("doc_id", "h") == F.col("key")
    same = F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("h") == F.col("span_h"))
    inner = [f"c{i}" for i in range(len(docs.columns))]
    changed = rows.join(keys, own, "left_semi").join(spans, same, "inner" if changed_only else "left")
    out = [(F.when(F.col("spans").isNull(), F.col(c)).otherwise(_without(F.col(c), F.col("spans"))) if c == at["text"] else F.col(c)).alias(c) for c in inner]
    if changed_only:
        return changed.select(*out, _runs(F.col("spans")).alias("__n")).toDF(*docs.columns, "removed_spans")
    return rows.join(keys, own, "left_anti").select(*inner).unionByName(changed.select(*out)).toDF(*docs.columns)


def remove_shared(docs: DataFrame, span: int = MIN_WORDS, k: int = ANCHOR_WORDS, changed_only: bool = False, hot_docs: int = HOT_DOCS) -> DataFrame:
    """``docs`` with every word taken out of ``text`` that lies in a run of at least
    ``span`` words which also occurs in a document with a smaller doc_id.

    Words are runs of letters and digits without ASCII case; a removed run goes with
    what follows it up to the next word. The first document keeps its text, so
    nothing is lost from the corpus. With ``changed_only`` just the changed
    documents, with the number of removed runs, ``removed_spans``, added.

    Spans are exact: anchors (winnowed 25-grams, at least one in any 50 words) lead
    to the documents that may share a run; the words around them go to the shard of
    the anchor's first owner, whose suffix automaton gives the matching statistics
    of each document against all earlier ones. Of an anchor that more than
    ``hot_docs`` documents share all windows of ``span`` words around it are joined
    by hash instead, with the same result. Documents without a shared anchor pass
    untouched. Rows with one doc_id are one document and never matched with each
    other, so repeated rows both stay; a null id is never matched; null, empty and
    shorter texts stay as they are. Extra columns, whatever their names, are kept.
    An empty table stays empty.
    """
    return remove_spans(docs, shared_spans(docs, span, k, hot_docs), changed_only)


# --- a given reference -----------------------------------------------------


def _word_ids(text: str | None) -> tuple[list[int], np.ndarray]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]))
    return (words.hashes >> np.uint64(32)).astype(np.uint32).tolist(), np.r_[words.starts, len(data)]


def _build(shard_words: int):
    """Kernel: reference texts to automata of about so many words (one text at least),
    each with its anchors."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, size = Automaton(), 0
        for batch in batches:
            for value in batch.column(0):
                ids, _ = _word_ids(value.as_py())
                if size and size + len(ids) > shard_words:
                    yield pa.record_batch([pa.array([automaton.flat()], pa.binary())], ["data"])
                    automaton, size = Automaton(), 0
                automaton.add(ids)
                size += len(ids)
        if size:
            yield pa.record_batch([pa.array([automaton.flat()], pa.binary())], ["data"])

    return run


def _match(sent, anchors_sent, span: int, k: int):
    """Kernel: the bytes of texts that some automaton holds. A text without an anchor
    of the reference holds no run of it, and isn't streamed."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: list[Automaton] = []
        known = anchors_sent.value
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            out: tuple[list, ...] = ([], [], [], [])
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in pieces(offsets):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h, at = anchors(words, span, k)
                near = np.unique(np.searchsorted(words.first, at[np.isin(h, known)], "right") - 1)
                symbols = (words.hashes >> np.uint64(32)).astype(np.uint32)
                for r in near.tolist():
                    loaded = loaded or [Automaton.of(d) for d in sent.value]
                    a, b = int(words.first[r]), int(words.first[r + 1])
                    own = symbols[a:b].tolist()
                    starts = np.r_[words.starts[a:b], words.offsets[r + 1]] - words.offsets[r]
                    for automaton in loaded:
                        for x, y in automaton.spans(own, span):
                            for column, value in zip(out, (ids[i + r], hashes[i + r], int(starts[x]), int(starts[y])), strict=True):
                                column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["doc_id", "h", "start", "stop"])

    return run


def reference_spans(docs: DataFrame, reference: DataFrame, span: int = MIN_WORDS, k: int = ANCHOR_WORDS, shard_words: int = SHARD_WORDS, limit: int = REFERENCE_BYTES) -> DataFrame:
    """``(doc_id, h, start, stop)``: the bytes of each text in runs of at least ``span``
    words that ``reference(text)`` holds."""
    spark = docs.sparkSession
    prepare(spark)
    texts = keep_columns(reference, "text").select(F.col("text").cast("string").alias("text")).where("text is not null")
    built = cut(texts.mapInArrow(_build(shard_words), "data binary"))
    rows, at = _keyed(docs)
    source = rows.select("doc_id", "h", F.col(at["text"]).cast("string").alias("text")).where("text is not null")
    marks = cut(anchor_rows(texts.select(F.lit(0).cast("long").alias("doc_id"), "text"), span, k).select("fp").distinct())
    groups: list[list[bytes]] = [[]]
    found = None

    def scanned(group: list[bytes]) -> DataFrame:
        return source.mapInArrow(_match(spark.sparkContext.broadcast(group), known, span, k), SPANS)

    known = spark.sparkContext.broadcast(np.sort(np.array([r["fp"] for r in marks.toLocalIterator()], np.int64).view(np.uint64)))
    for r in built.toLocalIterator():
        data = bytes(r["data"])
        if groups[0] and sum(map(len, groups[0])) + len(data) > limit:
            part = scanned(groups.pop())
            found = part if found is None else found.unionByName(part)
            groups.append([])
        groups[0].append(data)
    part = scanned(groups[0])
    return part if found is None else found.unionByName(part)


def remove_reference(docs: DataFrame, reference: DataFrame, span: int = MIN_WORDS, shard_words: int = SHARD_WORDS, limit: int = REFERENCE_BYTES, changed_only: bool = False) -> DataFrame:
    """``docs`` without the runs of at least ``span`` words that occur in
    ``reference(text)``: suffix automata of its shards are built by tasks and
    broadcast, and documents are streamed through each for their matching statistics.

    Automata go out in parts of at most ``limit`` bytes (one automaton at least), with
    a scan of the documents each, so a reference of any size works. Documents without
    a winnowed anchor of the reference aren't streamed: they can't hold a run. Null
    texts stay null; empty texts, an empty reference and an empty table change
    nothing; null ids don't matter. Repeated rows are each cleaned; extra columns,
    whatever their names, are kept.
    """
    return remove_spans(docs, reference_spans(docs, reference, span, min(ANCHOR_WORDS, max(1, span // 2)), shard_words, limit), changed_only)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_shared(table(spark, sf_dir, "documents").select("doc_id", "text"), changed_only=True)


def reference_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold passages of the benchmark, without these."""
    return remove_reference(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), changed_only=True)
