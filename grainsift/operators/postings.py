"""The inverted index as tables: posting lists, statistics, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainsift.functions.ngrams import partial_postings
from grainsift.plans.regex import Plan

PLAN_BYTES = 8 << 20
DOCS_PER_RANGE = 256
MAX_ARRAYS = 64
"""Hashes of a plan up to which they are tested one by one, and lists of up to
MAX_BRANCHES branches intersected as arrays: the answer is the same beyond, by a join."""
MAX_BRANCHES = 16


def postings(pairs: DataFrame, docs_per_shard: int | None = None) -> DataFrame:
    """``(hash, doc_ids)``, ascending and without repeats; with ``docs_per_shard``
    also ``shard_id``: a list then holds one range of documents, so no cell grows
    with the corpus."""
    keys = ["hash"]
    if docs_per_shard:
        pairs = pairs.withColumn("shard_id", F.floor(F.col("doc_id") / docs_per_shard))
        keys.append("shard_id")
    return pairs.groupBy(*keys).agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def text_postings(docs: DataFrame, docs_per_shard: int, text_col: str = "text", bases: list[int] | None = None, wanted: list[int] | None = None) -> DataFrame:
    """``(hash, shard_id, doc_ids)`` of texts: lists are grouped batch by batch before
    the one shuffle and joined after it. Rows come sorted by hash within ranges of
    hashes (their high bits, which are uniform, so no sampling is needed); there are
    the more ranges the more documents, so a range's size doesn't grow.

    ``wanted`` are the hashes that will be looked up, if lists are made for one search:
    Spark pushes that filter below the shuffle, but can't push it into the kernel."""
    bits = max(8, (docs.count() // DOCS_PER_RANGE).bit_length())
    parts = partial_postings(docs, "doc_id", text_col, docs_per_shard, bases, wanted).withColumn("range", F.shiftright("hash", 64 - bits))
    joined = F.flatten(F.collect_list("doc_ids"))
    lists = parts.repartition("range").groupBy("range", "hash", "shard_id").agg(joined.alias("ids"))
    # one text's repeats are gone; rows of one id may still repeat
    ids = F.when(F.size("ids") == 1, F.col("ids")).otherwise(F.sort_array(F.array_distinct("ids")))
    return lists.sortWithinPartitions("hash", "shard_id").select("hash", "shard_id", ids.alias("doc_ids"))


def forward_postings(forward: DataFrame, docs_per_shard: int | None = None) -> DataFrame:
    """The lists of documents that are given with their tokens, ``(doc_id, hashes)``."""
    return postings(forward.select("doc_id", F.explode("hashes").alias("hash")), docs_per_shard)


def payload_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(doc_id, bytes)``: what each document adds to the payload of the lists, at two
    bytes a token (gaps take one to five)."""
    tokens = partial_postings(docs, "doc_id", text_col).select(F.explode("doc_ids").alias("doc_id"))
    return tokens.groupBy("doc_id").agg((F.count("*") * 2).alias("bytes"))


def varint_size(value: Column) -> Column:
    """Bytes of a number in groups of seven bits."""
    size = F.lit(1)
    for limit in (1 << 7, 1 << 14, 1 << 21, 1 << 28):
        size = size + (value >= limit).cast("int")
    return size.cast("long")


# --- candidates ------------------------------------------------------------


def plan_rows(spark, plan: Plan) -> DataFrame:
    rows = [(b, len(hashes), h) for b, hashes in enumerate(plan.branches) for h in hashes]
    df = spark.createDataFrame(rows, "branch int, n int, hash long")
    return F.broadcast(df) if 16 * len(rows) <= PLAN_BYTES else df


def candidates(lists: DataFrame, plan: Plan, docs: DataFrame) -> DataFrame:
    """``(doc_id)`` that hold all hashes of some branch. Hashes reach the scan as an
    ``In`` filter, and row groups are sorted by hash.

    Short plans meet by shard: one shuffle of a row for each hash and shard, lists
    intersected as arrays of bounded length. Long ones are counted per branch and
    document.
    """
    if plan.kind == "all":
        return docs.select("doc_id")
    if plan.kind == "never":
        return docs.select("doc_id").limit(0)
    wanted = plan.hashes
    # equalities prune row groups one by one; a long In is pushed as its least and greatest
    few = len(wanted) <= MAX_ARRAYS
    found = lists.where(" OR ".join(f"hash = {h}" for h in wanted) if few else f"hash IN ({', '.join(map(str, wanted))})")
    if "shard_id" not in lists.columns or len(wanted) > MAX_ARRAYS or len(plan.branches) > MAX_BRANCHES:
        hits = found.join(plan_rows(lists.sparkSession, plan), "hash").select("branch", "n", "hash", F.explode("doc_ids").alias("doc_id"))
        whole = hits.groupBy("branch", "n", "doc_id").agg(F.count_distinct("hash").alias("found")).where("found = n")
        return whole.select("doc_id").distinct()
    by_shard = found.groupBy("shard_id").agg(F.map_from_entries(F.collect_list(F.struct("hash", "doc_ids"))).alias("lists"))
    none = F.array().cast("array<long>")
    union = None
    for branch in plan.branches:
        parts = [F.coalesce(F.try_element_at("lists", F.lit(h).cast("long")), none) for h in branch]
        both = parts[0]
        for other in parts[1:]:
            both = F.array_intersect(both, other)
        union = both if union is None else F.array_union(union, both)
    return by_shard.select(F.explode(union).alias("doc_id"))


def forward_predicate(hashes: Column, plan: Plan) -> Column:
    """The same test on a document's own hashes."""
    if plan.kind != "union":
        return F.lit(plan.kind == "all")
    test = F.lit(False)
    for branch in plan.branches:
        own = F.array(*[F.lit(h).cast("long") for h in branch])
        test = test | (F.size(F.array_intersect(own, hashes)) == len(set(branch)))
    return test


# --- sets and shards -------------------------------------------------------


def array_difference(old: Column, new: Column) -> Column:
    """``struct(removed, added)``, both ascending."""
    return F.struct(F.sort_array(F.array_except(old, new)).alias("removed"), F.sort_array(F.array_except(new, old)).alias("added"))


def shard_plan(sizes: DataFrame, target: int) -> DataFrame:
    """``(shard_id, doc_base, doc_count, bytes)`` of ``sizes(doc_id, bytes)``: ranges
    of documents that begin with each ``target`` bytes.

    Running sums are taken in two levels, within ranges of ids and over their
    totals, so that no window holds all documents.
    """
    parts = sizes.withColumn("part", F.floor(F.col("doc_id") / 100_000))
    totals = parts.groupBy("part").agg(F.sum("bytes").alias("t"), F.count("*").alias("c"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(over), F.lit(0)).alias("c0"))
    within = Window.partitionBy("part").orderBy("doc_id")
    before = F.sum("bytes").over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = parts.withColumn("b", F.coalesce(before, F.lit(0))).withColumn("r", F.row_number().over(within) - 1).join(totals, "part")
    shard = F.floor((F.col("t0") + F.col("b")) / target)
    grouped = rows.groupBy(shard.alias("s")).agg(F.min(F.col("c0") + F.col("r")).alias("doc_base"), F.count("*").alias("doc_count"), F.sum("bytes").alias("bytes"))
    # shards are few: numbered without gaps
    return grouped.select((F.row_number().over(Window.orderBy("s")) - 1).cast("long").alias("shard_id"), F.col("doc_base").cast("long").alias("doc_base"), "doc_count", "bytes")


def manifest_errors(manifest: DataFrame, total_docs: int) -> DataFrame:
    """``(shard_id, error)`` for what is wrong with ``(shard_id, doc_base, doc_count)``:
    ids not counted from 0, bases not the sums before them, another total."""
    order = Window.orderBy("shard_id")
    rows = manifest.select(
        "shard_id",
        "doc_base",
        (F.row_number().over(order) - 1).alias("expected_id"),
        F.coalesce(F.sum("doc_count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("expected_base"),
    )
    errors = rows.select("shard_id", F.explode(F.array_compact(F.array(F.when(F.col("shard_id") != F.col("expected_id"), "shard id"), F.when(F.col("doc_base") != F.col("expected_base"), "doc base")))).alias("error"))
    total = manifest.agg(F.coalesce(F.sum("doc_count"), F.lit(0)).alias("n")).where(F.col("n") != total_docs)
    return errors.select(F.col("shard_id").cast("long"), "error").unionByName(total.select(F.lit(None).cast("long").alias("shard_id"), F.lit("total").alias("error")))
