"""Boilerplate lines by how many pages of their host contain them.

Lines are compared without surrounding spaces. A host's line is boilerplate if more than RATIO of
the host's pages contain it. Exact copies of a page count as one page: else a page copied
often would be boilerplate itself, and all its copies would lose their whole text. For the same
reason a line must be on LEAST pages: on a host of one page every line is on all pages.
Counts are aggregated before they are shuffled by line, so neither a frequent line nor a large
host meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import inputs, numbered, place
from docframe.session import cut

#: Lines repeated over a host fall off from 13 to 9 % of its pages for the most frequent one (sf0.1) to under 5 % for all others.
RATIO, LEAST = 0.05, 2


def _hashes(text: Column) -> Column:
    """Hashes of a text's lines, in order."""
    return F.transform(F.split(text, "\n"), lambda x: F.xxhash64(F.trim(x)))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``host, lines``: hashes of each host's boilerplate lines. A host has fewer of them than its pages
    have lines on average, divided by ``ratio``. Pages without a host are one host; null texts
    are no pages, blank lines no lines. An empty table gives no rows."""
    rows = inputs(pages, **{host: "string", text: "string"}).toDF("host", "text").where("text is not null").withColumn("page", F.xxhash64("text"))
    total = rows.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    line = F.explode(F.array_distinct(F.transform(F.split("text", "\n"), F.trim))).alias("line")
    seen = rows.select("host", "page", line).where("line <> ''").select("host", "page", F.xxhash64("line").alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= least)
    often = counts.alias("c").join(total.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy(F.col("c.host").alias("host")).agg(F.collect_set("line").alias("lines"))


def line_dedup(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``pages`` with ``text`` less its host's boilerplate lines, and ``n_lines`` and ``n_dropped`` after
    all other columns (in place of columns of those names).

    A null text stays null with no lines; an empty text is one empty line and stays. Blank lines
    are never dropped. Repeated rows are one page and get a row each; an empty table gives no
    rows. Other columns stay, whatever their names. The lists are written first, so that their size
    decides between broadcast and shuffle. A page's lines meet the host's list once, as sets; what
    they share is all that single lines are compared with."""
    lists = cut(boilerplate(pages, host, text, ratio, least)).toDF("b_host", "b_lines")
    flat, t = numbered(pages), F.col(f"c{place(pages, text)}").cast("string")
    joined = flat.join(lists, F.col(f"c{place(pages, host)}").cast("string").eqNullSafe(F.col("b_host")), "left")
    joined = joined.withColumn("b_mine", F.when(F.col("b_lines").isNotNull(), F.array_intersect(_hashes(t), F.col("b_lines"))))
    found = F.coalesce(F.size("b_mine"), F.lit(0)) > 0
    kept = F.filter(F.split(t, "\n"), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("b_mine"), F.xxhash64(F.trim(x))))
    counts = F.coalesce(F.size(F.split(t, "\n")), F.lit(0)).cast("long")
    dropped = F.when(found, F.size(F.split(t, "\n")) - F.size(kept)).otherwise(0).cast("long")
    stay = [i for i, c in enumerate(pages.columns) if c not in ("n_lines", "n_dropped")]
    fresh = {place(pages, text): F.when(found, F.array_join(kept, "\n")).otherwise(t)}
    out = joined.select(*(fresh.get(i, F.col(f"c{i}")) for i in stay), counts, dropped)
    return out.toDF(*(pages.columns[i] for i in stay), "n_lines", "n_dropped")


#: DuckDB's words for line_dedup over documents, with the default ratio and pages.
SQL = f"""
WITH page AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
total AS (SELECT source, count(*) AS pages FROM page GROUP BY source),
line AS (SELECT DISTINCT source, text, trim(x) AS line FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS x FROM page)),
n AS (SELECT source, line, count(*) AS n FROM line WHERE line <> '' GROUP BY source, line),
often AS (
  SELECT n.source, list(n.line) AS lines FROM n JOIN total ON n.source IS NOT DISTINCT FROM total.source
  WHERE n.n >= {LEAST} AND n.n > {RATIO} * total.pages GROUP BY n.source),
cut AS (
  SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS xs, coalesce(o.lines, []) AS lines
  FROM documents d LEFT JOIN often o ON d.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, source,
  CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(list_filter(xs, lambda x: trim(x) = '' OR NOT list_contains(lines, trim(x))), chr(10)), '') END AS text,
  coalesce(len(xs), 0) AS n_lines,
  coalesce(len(list_filter(xs, lambda x: trim(x) <> '' AND list_contains(lines, trim(x)))), 0) AS n_dropped
FROM cut
"""
