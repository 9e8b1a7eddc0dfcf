"""Verification: the lines on which a pattern matches, as native expressions.

A pattern is matched against the whole text, and each line on which a match begins
is reported once. A marker put before every match changes just the lines where
matches begin, so comparing the lines with and without markers gives the answer
inside code generation, without Python. Patterns on which a backtracking engine
could recurse or take more than linear time get their markers from a linear-time
engine on Arrow batches instead; the rest is the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex as unicode_regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from grainsift.functions.kernels import pieces, utf8
from grainsift.functions.ship import ship
from grainsift.plans.regex import GUARDED, NATIVE, Regex, compile_regex, python_form

MARK = "␞"
BINARY_PROBE = 8192
MAX_BYTES = 2 << 30


def is_binary(content: Column) -> Column:
    """A NUL among the first 8,192 bytes."""
    return F.contains(F.substring(content, 1, BINARY_PROBE), F.lit(b"\0"))


def indexable(content: Column) -> Column:
    """Neither binary nor over 2 GiB (a cell holds no more)."""
    return content.isNotNull() & ~is_binary(content) & (F.octet_length(content) <= MAX_BYTES - 1)


PIECE = 1 << 20
"""Bytes of texts that are marked at once."""

GUARD_SECONDS = 60
"""A text on which a guarded pattern takes longer fails the job, with its reason."""


def _lines(docs: DataFrame, marked: Column, test: Column | None, keys: list[str], text_col: str) -> DataFrame:
    """``test`` is part of the generator: unlike a filter, nothing pushes it below a
    join that leaves documents out."""
    lines = F.arrays_zip(F.split(F.col(text_col), "\n", -1).alias("line"), F.split(marked, "\n", -1).alias("marked"))
    rows = docs.select(*keys, F.posexplode(lines if test is None else F.when(test, lines)).alias("pos", "z"))
    # "\n" inside a marker's place never moves lines: markers hold none
    rows = rows.where(F.col("z.line") != F.col("z.marked"))
    return rows.select(*keys, (F.col("pos") + 1).cast("long").alias("line_no"), F.regexp_replace("z.line", r"\r\z", "").alias("line"))


def _hits(docs: DataFrame, java: str, test: Column, keys: list[str], text_col: str) -> DataFrame:
    return _lines(docs, F.regexp_replace(F.col(text_col), java, MARK + "$0"), test, keys, text_col)


def _marker(linear: str, guarded: str | None):
    """Kernel: rows whose last column, the text, matches, with the marked text added."""
    python = unicode_regex.compile(guarded, unicode_regex.V1) if guarded else None

    def mark(texts: pa.Array) -> pa.Array:
        if python is None:
            return pc.replace_substring_regex(texts, linear, MARK + r"\0")
        plain = pc.replace_substring_regex(texts, linear, MARK + r"\0").to_pylist()
        for i in pc.indices_nonzero(pc.invert(pc.string_is_ascii(texts).fill_null(True))).to_pylist():
            plain[i] = python.sub(lambda m: MARK + m.group(), texts[i].as_py(), timeout=GUARD_SECONDS)
        return pa.array(plain, texts.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.num_columns - 1
            # by pieces: what is read, kept and marked would all be held for a whole batch
            for i, j in pieces(utf8(whole.column(at))[1], PIECE):
                batch = whole.slice(i, j - i)
                if python is None:
                    batch = batch.filter(pc.match_substring_regex(batch.column(at), linear).fill_null(False))
                if batch.num_rows:
                    yield pa.record_batch([*batch.columns, mark(batch.column(at))], [*batch.schema.names, "marked"])

    return run


def regex_hits(docs: DataFrame, pattern: str | Regex, keys: str | list[str] = "doc_id", text_col: str = "text") -> DataFrame:
    """``(keys, line_no, line)``. A null text has no lines. The time is linear in the
    text for every pattern but those with a Unicode word boundary and an unbounded
    repetition."""
    regex = compile_regex(pattern) if isinstance(pattern, str) else pattern
    keys = [keys] if isinstance(keys, str) else keys
    text = F.col(text_col)
    if regex.plan.kind == "never":
        return _hits(docs.limit(0), regex.java, F.lit(False), keys, text_col)
    sure = text.contains(regex.literals[0]) if regex.literals and len(regex.literals) == 1 and len(regex.literals[0]) >= 2 else None
    if sure is not None:
        docs = docs.where(sure)  # reaches the scan as StringContains; a plain search is cheap below a join too
    if regex.engine == NATIVE:
        return _hits(docs, regex.java, text.rlike(regex.java), keys, text_col)
    ship(docs.sparkSession)
    source = docs.select(*keys, text)
    inner = source.toDF(*[f"c{i}" for i in range(len(source.columns))])
    schema = StructType([*inner.schema.fields, StructField("marked", StringType())])
    marked = inner.mapInArrow(_marker(regex.linear, python_form(regex.java) if regex.engine == GUARDED else None), schema)
    found = _lines(marked, F.col("marked"), None, inner.columns[:-1], inner.columns[-1])
    return found.toDF(*keys, "line_no", "line")


def literal_hits(docs: DataFrame, literal: str, keys: str | list[str] = "doc_id", text_col: str = "text") -> DataFrame:
    """The same for a plain string."""
    if not literal:
        raise ValueError("empty search text")
    keys = [keys] if isinstance(keys, str) else keys
    quoted = "".join(f"\\x{{{ord(c):X}}}" for c in literal)
    return _hits(docs, quoted, F.col(text_col).contains(literal), keys, text_col)


def verify_contents(docs: DataFrame, pattern: str | Regex, keys: str | list[str] = "doc_id", content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Hits in files given as bytes, and ``(keys, error)`` for those that aren't UTF-8."""
    keys = [keys] if isinstance(keys, str) else keys
    content = F.col(content_col)
    good = F.is_valid_utf8(content.cast("string"))
    texts = docs.where(good).select(*keys, content.cast("string").alias("text"))
    errors = docs.where(content.isNotNull() & ~good).select(*keys, F.lit("invalid utf-8 sequence").alias("error"))
    return regex_hits(texts, pattern, keys), errors


# --- presentation ----------------------------------------------------------


def display_path(path: Column, root: str) -> Column:
    """``./rest`` under the root, else the path with forward slashes."""
    root = root.rstrip("/")
    rest = F.substring(path, len(root) + 2, 1 << 30)
    shown = F.when(path == root, "./").when(path.startswith(root + "/"), F.concat(F.lit("./"), rest)).otherwise(path)
    return F.replace(shown, F.lit("\\"), F.lit("/"))


def sanitize(line: Column) -> Column:
    """Tabs as four spaces, other control characters as one."""
    return F.regexp_replace(F.replace(line, F.lit("\t"), F.lit("    ")), r"\p{Cc}", " ")


def highlight_spans(line: Column, query: str) -> Column:
    """The line in parts, ``array<struct<text, hit>>``: occurrences of the literal
    query and what lies between; empty parts are left out."""
    if not query:
        return F.array(F.struct(line.alias("text"), F.lit(False).alias("hit")))
    parts = F.split(line, re.escape(query) if query.isalnum() else "".join(f"\\x{{{ord(c):X}}}" for c in query), -1)
    pairs = F.transform(
        parts,
        lambda p, i: F.array(F.struct(p.alias("text"), F.lit(False).alias("hit")), F.struct(F.when(i < F.size(parts) - 1, query).otherwise("").alias("text"), F.lit(True).alias("hit"))),
    )
    return F.filter(F.flatten(pairs), lambda s: s["text"] != "")


def format_hits(hits: DataFrame, keys: str | list[str] = "doc_id", path_col: str = "path") -> DataFrame:
    """Printed form: ``(keys, row, text)``, the path with a colon as row 0 of each
    document, then a row for each hit."""
    keys = [keys] if isinstance(keys, str) else keys
    heads = hits.select(*keys, F.lit(0).cast("long").alias("row"), F.concat(path_col, F.lit(":")).alias("text")).distinct()
    body = hits.select(*keys, F.col("line_no").alias("row"), F.concat(F.lpad(F.col("line_no").cast("string"), 8, " "), F.lit(": "), sanitize(F.col("line"))).alias("text"))
    return heads.unionByName(body)


def capped_rows(hits: DataFrame, max_rows: int, key: str = "doc_id") -> DataFrame:
    """The first ``max_rows`` printed rows; every document's header counts as one.

    Documents are taken in order of ``key``: the top rows come from a limited sort
    (no global window), headers are added and the limit is taken again.
    """
    more = [c for c in hits.columns if c not in (key, "line_no", "line")]
    heads = hits.select(key, *more).distinct().orderBy(key).limit(max_rows).select(key, F.lit(0).cast("long").alias("line_no"), F.lit("header").alias("kind"), F.lit(None).cast("string").alias("line"), *more)
    body = hits.select(key, "line_no", F.lit("hit").alias("kind"), "line", *more).orderBy(key, "line_no").limit(max_rows)
    return heads.unionByName(body).orderBy(key, "line_no").limit(max_rows)
