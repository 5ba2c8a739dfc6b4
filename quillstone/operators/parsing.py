"""Structure in plain text: lines, headings carried forward, sections between markers, mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.text import unified_newlines
from quillstone.operators.running import carried_forward, islands

#: Headings of laws, policies and memos: a word for the level, then its number (fixed values).
HEADING = r"(?iu)^(chương|mục|điều|khoản|phụ lục|chapter|section|article|annex|annexe|§)\s*(\d+)"


#: The levels of a provision from the top down, each by patterns whose group is its number or letter (fixed values).
LEVELS = {
    "part": (r"^(?:phần|part)\s*(\d+)",), "chapter": (r"^(?:chương|chapter)\s*(\d+)", r"^第(\d+)章"), "section": (r"^(?:mục|section|§)\s*(\d+)",),
    "article": (r"^(?:điều|article)\s*(\d+)", r"^第(\d+)条"), "clause": (r"^(?:khoản|clause)\s*(\d+)", r"^(\d+)[.)]\s"), "point": (r"^(?:điểm\s+)?([a-zđ])\)",)}


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line, text``: the lines of each text that aren't blank, numbered from 1 with the blank ones counted."""
    split = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(unified_newlines(F.col(text_col)), "\n")).alias("line", "text"))
    return split.where(F.length(F.trim("text")) > 0).select("id", (F.col("line") + 1).alias("line"), "text")


def headed(lined: DataFrame) -> DataFrame:
    """Lines with ``level`` and ``number`` of the heading that they are under; null before the first heading."""
    level = F.lower(F.regexp_extract("text", HEADING, 1))
    own = lined.withColumns({"is_heading": level != "", "level": F.when(level != "", level),
                             "number": F.when(level != "", F.regexp_extract("text", HEADING, 2).cast("int"))})
    return carried_forward(own, ["id"], ["line"], ["level", "number"])


def levelled(lined: DataFrame) -> DataFrame:
    """Lines with one column for each of ``LEVELS``: what they stand under. A level is carried forward until it is named anew or
    a level above it begins; null where there is none.

    Windows are over the lines of one text.
    """
    whole = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = {n: F.coalesce(*(F.nullif(F.regexp_extract("text", "(?iu)" + p, 1), F.lit("")) for p in patterns)) for n, patterns in LEVELS.items()}
    rows = lined.withColumns({f"own_{n}": c for n, c in own.items()})
    within, above = {}, F.lit(False)
    for n in LEVELS:
        within[f"in_{n}"] = F.sum(above.cast("int")).over(whole)
        above = above | F.col(f"own_{n}").isNotNull()
    rows = rows.withColumns(within)
    carried = {n: F.last(f"own_{n}", ignorenulls=True).over(Window.partitionBy("id", f"in_{n}").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) for n in LEVELS}
    return rows.withColumns(carried).drop(*(f"{x}_{n}" for n in LEVELS for x in ("own", "in")))


def sections(lined: DataFrame) -> DataFrame:
    """``id, section, first_line, lines, characters, content``: the lines from one heading to the next, joined by line ends."""
    marked = islands(lined, ["id"], ["line"], F.col("text").rlike(HEADING), "section")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return marked.groupBy("id", "section").agg(F.min("line").alias("first_line"), F.count("*").cast("int").alias("lines"), joined.alias("content")).select(
        "id", "section", "first_line", "lines", F.length("content").alias("characters"), F.sha2("content", 256).alias("content_hash"))


def mentions(df: DataFrame, id_col: str, text_col: str, pattern: str, group: int = 1) -> DataFrame:
    """``id, mention``: what a pattern finds in each text, each once."""
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(pattern), group))).alias("mention"))
