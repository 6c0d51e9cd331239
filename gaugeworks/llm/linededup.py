"""Cross-site line removal by distinct-site spread.

Every line of every document gives its hash and its document's site.  One
aggregation merges a HyperLogLog sketch of the sites of each line; lines whose
estimate is near the threshold are counted exactly, lines far above it need no
more.  A line seen on ``sites`` sites or more stays in the document of least
id that has it, and goes from all others.

Lines are compared without blanks at their ends; blank lines are never
removed.  Null texts stay null, a text that loses all lines becomes empty.  A
null site counts as none.  Rows with one id count as one document; a null id is
never the least, and a line that only rows without id have stays.  An empty table gives no rows.  Every column of the input is
returned, whatever its name; only ``text`` changes.

Everything is SQL functions.  Sketches combine before the shuffle, so that a
line in a third of the documents is one row per task, and joins have skewed
keys split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.llm.base import query, staged, table

SITES = 6

#: Sketch size (log2 of the registers) and the relative error allowed for; the
#: standard error at this size is 1.6 %.
LOG_REGISTERS, ERROR = 12, 0.1


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def spread(lines: DataFrame, sites: int) -> DataFrame:
    """(line, first_id) of the lines (line, site, id) on ``sites`` sites or more."""
    sketched = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("about"),
        F.min("id").alias("first_id"))
    wide = staged(sketched.filter(F.col("about") >= sites * (1 - ERROR) - 1), "wide-lines")
    sure = wide.filter(F.col("about") > sites * (1 + ERROR) + 1)
    near = wide.filter(F.col("about") <= sites * (1 + ERROR) + 1)
    exact = (lines.join(near.select("line"), "line", "left_semi")
             .groupBy("line", "site").agg(F.lit(1).alias("one"))
             .groupBy("line").agg(F.count("site").alias("n")).filter(F.col("n") >= sites))
    return (sure.select("line", "first_id")
            .unionByName(near.join(exact, "line", "left_semi").select("line", "first_id")))


def dedup_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, ...) as column ``doc``, and the
    number of lines each lost as ``removed``."""
    held = docs.select(
        F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"),
        F.col("text").cast("string").alias("body"), F.col("source").cast("string").alias("site"))
    keyed = held.withColumn("copy", F.xxhash64("body"))
    # Short rows, written once: read by the sketches, the exact counts and the
    # join that finds each document's lines.
    filled = F.filter(_lines(F.col("body")), lambda x: F.trim(x) != "")
    lines = staged(
        keyed.select("id", "copy", "site", F.explode(F.array_distinct(F.transform(filled, _key))).alias("line")),
        "lines")
    common = staged(spread(lines.select("line", "site", "id"), sites), "common-lines")
    # A document's lines; copies with one id fall together.
    lost = (lines.select("id", "copy", "line").join(common, "line")
            .filter(~F.col("id").eqNullSafe(F.col("first_id")))
            .groupBy("id", "copy").agg(F.collect_set("line").alias("lost")))
    joined = keyed.join(
        lost.select(F.col("id").alias("l_id"), F.col("copy").alias("l_copy"), "lost"),
        F.col("id").eqNullSafe(F.col("l_id")) & (F.col("copy") == F.col("l_copy")), "left")
    kept = F.filter(_lines(F.col("body")), lambda x: ~F.array_contains(F.col("lost"), _key(x)))
    text = F.when(F.col("lost").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n"))
    gone = F.when(F.col("lost").isNull(), 0).otherwise(F.size(_lines(F.col("body"))) - F.size(kept))
    return joined.select(F.col("doc").withField("text", text).alias("doc"),
                         gone.cast("long").alias("removed"))


@query("op10_line_dedup", f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
common AS (
  SELECT trim(line, ' ') AS key, min(doc_id) AS first_id FROM lines WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {SITES}),
kept AS (
  SELECT l.doc_id,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key IS NULL OR l.doc_id = first_id), '') AS text,
         count(*) FILTER (WHERE key IS NOT NULL AND l.doc_id <> first_id) AS removed
  FROM lines l LEFT JOIN common ON trim(line, ' ') = key GROUP BY l.doc_id)
SELECT d.doc_id, kept.text, cast(coalesce(removed, 0) AS BIGINT) AS removed
FROM documents d LEFT JOIN kept USING (doc_id)
""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "removed")
