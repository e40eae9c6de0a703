"""Text operators for report texts: paragraphs and line statistics.

Both explode each text into its pieces inside the scan stage (``posexplode``
of ``split``); whole texts are processed, one row per piece, with no
per-group collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import py_strip

# Markdown marks removed from report paragraphs, in the order they are removed.
MARKDOWN_MARKS = ("**", "###", "##", "#")


def markdown_paragraphs(texts: DataFrame, id_cols, text_col: str = "text") -> DataFrame:
    """Split on blank lines, keep pieces that are not blank after stripping,
    strip them, then remove the markdown marks.  The blank test comes before
    the marks are removed and nothing is stripped afterwards, so '## T'
    becomes ' T' and a lone '**' gives an empty paragraph that stays."""
    parts = texts.select(*id_cols, F.posexplode(F.split(F.col(text_col), "\n\n", -1))
                         .alias("paragraph_no", "_raw"))
    kept = parts.select(*id_cols, "paragraph_no", py_strip("_raw").alias("_stripped"))
    kept = kept.where(F.col("_stripped") != "")
    cleaned = F.col("_stripped")
    for mark in MARKDOWN_MARKS:
        cleaned = F.replace(cleaned, F.lit(mark), F.lit(""))
    return kept.select(*id_cols, "paragraph_no", cleaned.alias("paragraph"))


def text_lines_stats(texts: DataFrame, id_cols, text_col: str = "text") -> DataFrame:
    """One row per line: stripped text, blank flag, and the raw length of the
    whole text taken before stripping."""
    lines = texts.select(*id_cols, F.char_length(F.col(text_col)).alias("raw_chars"),
                         F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "_raw"))
    stripped = py_strip("_raw")
    return lines.select(*id_cols, "raw_chars", "line_no", stripped.alias("line"),
                        (stripped == "").alias("is_blank"))
