"""Line-first cleaning: rules per line, then a rule on what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.llm._common import renamed, table

MIN_KEPT = 0.5
"""A document goes if less than this share of its characters is left."""
MAX_SYMBOLS = 0.1
MAX_CAPITALS = 0.5

# Patterns that Java and RE2 read alike; lines are trimmed before.
TRIM = r"^[ \t\r]+|[ \t\r]+$"
PUNCTUATION = r"[.!?…][\"'”’)]? |[.!?…:;\"'”’»)\]。！？]$"
NAVIGATION = (
    r"(?i)^(home|menu|search|next|previous|back|back to top|top|log ?in|log ?out|sign (in|up)|register|read more|more|share|tweet|print|"
    r"contact( us)?|about( us)?|help|faq|sitemap|skip to (main )?content|click here|toggle navigation)[.!:]?$|^[*•·–>»-] ?[^ ]+( [^ ]+){0,2}$|([|»›·•>].*){3}"
)
BOILERPLATE = (
    r"(?i)(all rights reserved|©|\(c\) ?[0-9]{4}|cookie (policy|settings|notice)|use[sd]? cookies|privacy policy|terms (of (use|service)|and conditions)|"
    r"enable javascript|javascript is (disabled|required)|lorem ipsum|subscribe to (our|the)|sign up for (our|the)|follow us on|powered by|released under the)"
)
SYMBOL, CAPITAL = r"[#$%&*|~^_=<>{}\\/@]", r"\p{Lu}"
SYMBOLS, CAPITALS = r"[^#$%&*|~^_=<>{}\\/@]", r"[^\p{Lu}]"  # what else there is, for the SQL
# every boilerplate phrase holds one of these, in lower case
SIGNS = ("rights reserved", "©", "(c)", "cookie", "privacy policy", "terms ", "javascript", "lorem ipsum", "subscribe to", "sign up for", "follow us on", "powered by", "released under")


def line_passes(line: Column) -> Column:
    """Whether a trimmed line with text passes every rule. Plain searches decide
    whether the phrases have to be tried at every place."""
    size, lower = F.length(line), F.lower(line)
    signs = lower.contains(SIGNS[0])
    for s in SIGNS[1:]:
        signs = signs | lower.contains(s)
    return (
        line.rlike(PUNCTUATION)
        & (F.regexp_count(line, F.lit(SYMBOL)) <= MAX_SYMBOLS * size)
        & (F.regexp_count(line, F.lit(CAPITAL)) <= MAX_CAPITALS * size)
        & ~line.rlike(NAVIGATION)
        & ~(signs & line.rlike(BOILERPLATE))
    )


def clean_lines(docs: DataFrame, min_kept: float = MIN_KEPT, report: bool = False) -> DataFrame:
    """The documents that keep at least ``min_kept`` of their characters, with the
    lines that pass, in order, as ``text`` and all other columns as they were.

    A line fails if it neither ends in punctuation nor holds the end of a sentence, is a navigation entry or a row of
    separators, holds a boilerplate phrase, or is more than a tenth symbols or half
    capitals. Lines are trimmed; blank ones are dropped and count for nothing, so a
    text that is null, empty or blank has nothing left and goes. Rows are judged on
    their own: repeated rows stay repeated, null ids stay. With ``report`` the
    columns ``lines`` and ``lines_removed`` are added. An empty table stays empty.
    One pass without shuffle or Python.
    """
    inner, at = renamed(docs)
    text = F.col(at["text"])
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, TRIM, "")), lambda x: x != "")
    # bound once, in an array of one; the generator keeps the filter below from being pushed down and the rules from running twice
    judged = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), F.filter(x, line_passes).alias("kept")))
    staged = inner.where(text.isNotNull()).select("*", F.explode(judged).alias("__judged"))
    lines, kept = F.col("__judged.lines"), F.col("__judged.kept")

    def size(x: Column) -> Column:  # without line ends
        return F.aggregate(x, F.lit(0), lambda n, line: n + F.length(line))

    staged = staged.where((F.size(kept) > 0) & (size(kept) >= F.lit(min_kept) * size(lines)))
    out = [F.array_join(kept, "\n").alias(c) if c == at["text"] else F.col(c) for c in inner.columns]
    if report:
        out += [F.size(lines).cast("long").alias("__n"), (F.size(lines) - F.size(kept)).cast("long").alias("__r")]
    return staged.select(*out).toDF(*docs.columns, *(["lines", "lines_removed"] if report else []))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SQL = f"""
WITH split AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, {_sql(TRIM)}, '', 'g')), lambda l: l <> '') AS lines
  FROM documents),
judged AS (
  SELECT doc_id, lines, list_filter(lines, lambda l: regexp_matches(l, {_sql(PUNCTUATION)}) AND NOT regexp_matches(l, {_sql(NAVIGATION)})
    AND NOT regexp_matches(l, {_sql(BOILERPLATE)})
    AND length(regexp_replace(l, {_sql(SYMBOLS)}, '', 'g')) <= {MAX_SYMBOLS}::DOUBLE * length(l)
    AND length(regexp_replace(l, {_sql(CAPITALS)}, '', 'g')) <= {MAX_CAPITALS}::DOUBLE * length(l)) AS kept
  FROM split)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, len(lines)::BIGINT AS lines, (len(lines) - len(kept))::BIGINT AS lines_removed
FROM judged
WHERE len(kept) > 0
  AND list_sum(list_transform(kept, lambda l: length(l))) >= {MIN_KEPT}::DOUBLE * list_sum(list_transform(lines, lambda l: length(l)))
"""
