"""Exact duplicates by content-defined chunk recipes (operator 9), in DataFrame functions only.

Texts are equal when they are identical without ASCII white space. The normalised text is cut where
its own nearby characters say so (`CUT`), every chunk gets an identifier, and documents are compared
by their ordered lists of identifiers (recipes) in place of their texts:

1. one pass over the texts gives each row its recipe, sizes and digest; the table is written once;
2. the identifiers are verified over the chunks of all texts: distinct (identifier, chunk) pairs are
   found, with partial distinct rows in each task before the one shuffle of chunk texts. If two
   chunks share an identifier, both steps are repeated with a wider one. Once no two chunks do,
   equal recipes and equal texts are the same thing;
3. recipes are grouped. Of a group the row with the most code points in its original text stays,
   then the smallest id, then the earliest row.

Long texts move once, as chunks, and equal chunks of a task move once together; afterwards only
lists of identifiers move. A group is never gathered: its size and best row are partial aggregates,
and its rows get them by a join that adaptive execution may split.

Defined cases: a null text counts as empty, and all empty texts are one group; a null id sorts last
among equals; rows that repeat an id are separate rows, of which one stays; an empty table gives no
rows; other columns are ignored by `duplicates` and kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import durable

WHITE_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
# A chunk ends after a sign that follows one of these characters, which a fifth of the sentences do;
# a text without such a place is one chunk.
CUT = "(?<=[ahlo0-4いのん][.!?;:。！？|])"

Identifier = Callable[[Column], Column]
IDENTIFIERS: tuple[Identifier, ...] = (F.xxhash64, lambda chunk: F.sha2(chunk, 256))


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, "")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _rows(df: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), row.alias("row"),
        F.char_length(text).alias("points"), normalised(F.col(text_col)).alias("norm"),
    )


def recipes(df: DataFrame, identifier: Identifier, id_col: str, text_col: str, row: Column) -> DataFrame:
    """doc_id, row, points, text_sha256, recipe of each row."""
    chunks = F.split("norm", CUT)
    return _rows(df, id_col, text_col, row).select(
        "doc_id", "row", "points", F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks, lambda c: identifier(c)).alias("recipe"))


def clashes(df: DataFrame, identifier: Identifier, text_col: str = "text") -> DataFrame:
    """Identifiers that two different chunks have."""
    cut = df.select(F.explode(F.split(normalised(F.col(text_col)), CUT)).alias("chunk"))
    distinct = cut.select(identifier(F.col("chunk")).alias("identifier"), "chunk").distinct()
    return distinct.groupBy("identifier").agg(F.count("*").alias("chunks")).where("chunks > 1")


def verified_recipes(df: DataFrame, id_col: str, text_col: str, identifiers: Sequence[Identifier], row: Column) -> DataFrame:
    for identifier in identifiers:
        if durable(clashes(df, identifier, text_col), "clashes").isEmpty():
            return durable(recipes(df, identifier, id_col, text_col, row), "recipes")
    raise ValueError("every kind of identifier has two chunks with the same value")


def _marked(df: DataFrame, id_col: str, text_col: str, identifiers: Sequence[Identifier], row: Column) -> DataFrame:
    """Each row's number, group and digest; `best` is the row of its group that stays."""
    found = verified_recipes(df, id_col, text_col, identifiers, row)
    # The smallest of (-points, id is null, id, row) is the row that stays.
    order = F.struct((-F.col("points")).alias("minus"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    groups = found.groupBy("recipe").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return found.join(durable(groups, "groups"), "recipe").select(
        "doc_id", "row", "best", "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               identifiers: Sequence[Identifier] = IDENTIFIERS) -> DataFrame:
    """One row per row of the table: doc_id, keep_id, group_size, kept, text_sha256."""
    marked = _marked(df, id_col, text_col, identifiers, F.monotonically_increasing_id())
    return marked.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", "kept", "text_sha256")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                identifiers: Sequence[Identifier] = IDENTIFIERS) -> DataFrame:
    """The rows that stay, with all their columns. The numbered rows are written once, so that both reads agree."""
    number = free_name(df, "row_number_of_table")
    numbered = durable(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    dropped = _marked(numbered, id_col, text_col, identifiers, F.col(number)).where(~F.col("kept"))
    rows = durable(dropped.select(F.col("row").alias(number)), "dropped")
    return numbered.join(rows, number, "left_anti").drop(number)
