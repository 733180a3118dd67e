"""Document fingerprints by a Merkle tree over paragraphs and sections (operator 12), in DataFrame functions only.

A text is cut into paragraphs after each line feed, and paragraphs are gathered into sections. A section
ends with a paragraph that says so itself: an empty one, or one whose digest is divisible by SECTION.
So the same run of paragraphs makes the same section wherever it stands, and an edit changes the sections
it touches and no others. A node's digest is the SHA-256 of its children's digests, a paragraph's that
of its text; the root is the fingerprint, and two texts are equal when their roots are.

Two trees are compared from the top. Equal roots end it. Otherwise `edited_span` passes over
equal sections from either side, then over equal paragraphs of the section that differs, and so
names the code points within which the texts differ. `likeness` is the part of both texts, in
code points, that their trees have in common, whatever its place; so that an edit within a long paragraph
counts as what it is, paragraphs are refined to sentences for it (`marks`), and each occurrence counts once.

`neighbours` gives each document the next one in descending order of ids. Texts are not sorted for
that: ids, digests and lengths are (a few numbers per document, by ranges), and then a document
sends as much of its beginning as the one before asks for, with the marks of its sentences.

Defined cases: a null text is empty; the empty text has one empty paragraph; rows that are equal in id and
text follow each other, and rows with equal ids follow by digest; null ids come last; the
document after the last is the first, which may be itself; an empty table gives no rows; other columns
are ignored. Memory: one text with its tree, per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import durable

SECTION = 8  # paragraphs in a section, on average
DIGITS = 32  # of the digests of inner nodes
PARAGRAPH = "(?<=\n)"
SENTENCE = "(?<=[.!?;。！？；])"


def plain(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _short(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, DIGITS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraphs(text: Column) -> Column:
    """array of (digest, points) of a text's paragraphs; the last may be empty."""
    return F.transform(F.split(text, PARAGRAPH), lambda p: F.struct(
        _short(p).alias("digest"), F.char_length(p).alias("points")))


def _closes(leaf: Column) -> Column:
    """A blank line, or a digest divisible by SECTION (a power of two up to 16)."""
    return (leaf["points"] <= 1) | (F.conv(F.substring(leaf["digest"], DIGITS, 1), 16, 10).cast("int") % SECTION == 0)


def sections(leaves: Column) -> Column:
    """array of (digest, points, leaves): runs of paragraphs, each up to one that ends a section."""

    def runs(leaf: Column) -> Column:
        n = F.size(leaf)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | _closes(F.element_at(leaf, i)))
        return let(ends, lambda end: F.transform(end, lambda e, k: let(
            F.when(k == 0, F.lit(0)).otherwise(F.get(end, k - 1)), lambda begin: F.slice(leaf, begin + 1, e - begin))))

    return F.transform(let(leaves, runs), lambda part: F.struct(
        _short(F.array_join(part["digest"], "")).alias("digest"), _points(part).alias("points"), part.alias("leaves")))


def tree(text: Column) -> Column:
    return sections(paragraphs(text))


def root(nodes: Column) -> Column:
    """The fingerprint: 64 hexadecimal digits."""
    return F.sha2(F.array_join(nodes["digest"], ""), 256)


def marks(text: Column) -> Column:
    """A string for each sentence of each paragraph: digest, points and which occurrence it is."""
    sentences = F.flatten(F.transform(F.split(text, PARAGRAPH), lambda p: F.split(p, SENTENCE)))
    coded = F.transform(F.filter(sentences, lambda s: s != ""), lambda s: F.concat(
        F.substring(F.sha2(s, 256), 1, 12), F.lit(":"), F.char_length(s).cast("string")))
    return let(coded, lambda c: F.when(
        F.size(F.array_distinct(c)) == F.size(c), F.transform(c, lambda m: F.concat(m, F.lit(":1")))).otherwise(
        let(F.array_sort(c), _numbered)))


def _numbered(coded: Column) -> Column:
    """Sorted strings, equal ones told apart by their number."""
    n = F.size(coded)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(coded, i) != F.get(coded, i - 1)))
    return let(starts, lambda start: F.flatten(F.transform(start, lambda a, k: F.transform(
        F.sequence(F.lit(1), F.coalesce(F.get(start, k + 1), n) - a),
        lambda i: F.concat(F.get(coded, a), F.lit(":"), i.cast("string"))))))


def likeness(marks_a: Column, points_a: Column, marks_b: Column, points_b: Column, equal: Column) -> Column:
    """Share of the code points of both texts in sentences that both have; 1 for equal texts."""
    common = F.aggregate(F.array_intersect(marks_a, marks_b), F.lit(0).cast("long"),
                         lambda n, m: n + F.get(F.split(m, ":"), F.lit(1)).cast("long"))
    return F.when(equal, F.lit(1.0)).otherwise(2.0 * common / F.greatest(points_a + points_b, F.lit(1)))


def _points(nodes: Column) -> Column:
    return F.aggregate(nodes["points"], F.lit(0), lambda n, x: n + x)


def _agreeing(a: Column, b: Column) -> Column:
    """How many of the first nodes of two lists are equal."""
    least = F.least(F.size(a), F.size(b))
    differing = F.filter(F.sequence(F.lit(0), least), lambda i: (i == least) | (
        F.get(a, i)["digest"] != F.get(b, i)["digest"]))
    return F.get(differing, F.lit(0))


def _shared_start(a: Column, b: Column) -> Column:
    """Code points at the start of a that b begins with, by whole branches."""
    def of_leaves(x: Column, y: Column) -> Column:
        return F.coalesce(_points(F.slice(x, F.lit(1), _agreeing(x, y))), F.lit(0))

    return let(_agreeing(a, b), lambda k: _points(F.slice(a, F.lit(1), k)) + of_leaves(
        F.get(a, k)["leaves"], F.get(b, k)["leaves"]))


def _turned(nodes: Column) -> Column:
    return F.transform(F.reverse(nodes), lambda s: F.struct(
        s["digest"].alias("digest"), s["points"].alias("points"), F.reverse(s["leaves"]).alias("leaves")))


def edited_span(a: Column, b: Column) -> Column:
    """(start, end) in code points of a: outside of it a agrees with b; null where the trees are equal."""
    after = let(_turned(a), lambda x: let(_turned(b), lambda y: _shared_start(x, y)))
    span = let(_shared_start(a, b), lambda start: F.struct(start.cast("long").alias("start"), (
        _points(a) - F.least(after, _points(a) - start, _points(b) - start)).cast("long").alias("end")))
    return F.when(root(a) != root(b), span)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, tree, fingerprint of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), plain(F.col(text_col)).alias("text"))
    trees = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), tree(F.col("text")).alias("tree"))
    return trees.withColumn("fingerprint", root(F.col("tree")))


def _known(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, text, copies: equal rows (of the same id and text) once, with their number."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), plain(F.col(text_col)).alias("text"))
    # A null id takes part as the smallest; the flag keeps it apart from a real one.
    keyed = rows.select(F.col("doc_id").isNull().alias("unknown"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
                        F.sha2("text", 256).alias("digest"), "text")
    return keyed.groupBy("unknown", "doc_id", "digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


KEY = ["unknown", "doc_id", "digest"]


def neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each distinct row its key, n_chars, copies, the key of the one before and of the one after it.

    Only keys and numbers are sorted. A range is one task; its last row gets the first of the next range.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), plain(F.col(text_col)).alias("text"))
    facts = rows.select(
        F.col("doc_id").isNull().alias("unknown"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
        F.sha2("text", 256).alias("digest"), F.char_length("text").alias("n_chars"),
    ).groupBy(*KEY, "n_chars").agg(F.count("*").alias("copies"))
    order = [F.asc("unknown"), F.desc("doc_id"), F.asc("digest")]
    ranged = durable(facts.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "document_order")

    whole = F.struct(*KEY, "n_chars")
    within = Window.partitionBy("range").orderBy(*order)
    place = F.struct(F.col("unknown").alias("a"), F.bitwise_not("doc_id").alias("b"), F.col("digest").alias("c"))
    edges = ranged.groupBy("range").agg(F.min_by(whole, place).alias("first"), F.max_by(whole, place).alias("last"))
    ranges = Window.orderBy("range")  # one row per range
    everything = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    linked = durable(edges.select(
        "range", F.coalesce(F.lead("first").over(ranges), F.first("first").over(everything)).alias("next_range"),
        F.coalesce(F.lag("last").over(ranges), F.last("last").over(everything)).alias("range_before")), "range_edges")
    ordered = ranged.withColumns({"after": F.lead(whole).over(within), "before": F.lag(whole).over(within)})
    return ordered.join(linked, "range").select(
        *KEY, "n_chars", "copies", F.coalesce("after", "next_range").alias("after"),
        F.coalesce("before", "range_before").alias("before"))


def document_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    and edit (start and end of the code points in which the edited text differs, by whole paragraphs)."""
    order = durable(neighbours(df, id_col, text_col), "neighbours")
    texts = _known(df, id_col, text_col).drop("copies").join(order, KEY)
    wanted = F.floor(F.col("before.n_chars") / 3).cast("int")  # what the document before replaces
    sent = texts.select(
        *[F.col(f"before.{c}").alias(c) for c in KEY], F.substring("text", F.lit(1), wanted).alias("next_start"),
        F.col("n_chars").alias("next_points"), marks(F.col("text")).alias("next_marks"))
    met = texts.join(sent, KEY)

    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 3).cast("int")
    # Copies of a row follow each other, so that all but the last are followed by their own text.
    variants = F.when(F.col("copies") == 1, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    spread = met.select(
        F.when(~F.col("unknown"), F.col("doc_id")).alias("doc_id"), "text", "n_chars", "copies", "digest", "next_marks",
        "next_start", "next_points", F.col("after.digest").alias("next_digest"), F.explode(variants).alias("own"))
    both = spread.select(
        "doc_id", "text", "n_chars", "copies", "own", "next_marks", "next_points", kept.alias("kept"),
        ((F.col("digest") == F.col("next_digest")) | F.col("own")).alias("same_next"),
        F.concat(F.substring("text", F.lit(1), kept), F.when(
            F.col("own"), F.substring("text", F.lit(1), F.col("n_chars") - kept)).otherwise(F.col("next_start"))).alias("edited"))
    trees = both.select(
        "*", tree(F.col("text")).alias("a"), tree(F.col("edited")).alias("b"),
        marks(F.col("text")).alias("marks"), marks(F.col("edited")).alias("edited_marks"))
    result = trees.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        root(F.col("a")).alias("fingerprint"), root(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("n_chars"), F.col("edited_marks"), F.char_length("edited"),
                 F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("marks"), F.col("n_chars"), F.col("next_marks"), F.col("next_points"),
                 F.col("same_next")).alias("near_next"),
        edited_span(F.col("a"), F.col("b")).alias("edit"),
        F.when(F.col("own"), F.col("copies") - 1).otherwise(F.lit(1)).cast("int").alias("times"))
    return result.select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_")).drop("_", "times")
