"""Problem 7: lines that one source repeats over its documents.

Method: lines are parsed into templates by a token tree of fixed depth. Tokens are pieces of WIDTH letters, not words, since
lines count as equal whatever their spacing, digits, case or signs. A path is source, the first DEPTH pieces, a slot, and
the last TAIL pieces; the slot is empty for lines that the pieces cover, else the wildcard <*>, which holds any letters:
"Tell the Courier desk about this letter" and "... about this invoice" differ within one slot. Each partition counts its own
tree; the trees are merged by the sum of equal paths.

A template covers every line that it holds, so that a line in enough documents is in a template that covers enough. The
templates that do are opened. repeated_lines() reports the lines that are often enough by themselves, counted exactly;
templates() and template_lines() take the whole template, with the variants in its slot.

Defined results: null texts have no lines; lines without letters are no cases; a line counts once a document, and all its
places are reported; a document of a null source belongs to the source null; every row counts as a document of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.session import stage

DEPTH, WIDTH, TAIL = 3, 5, 2
SLOT = "<*>"
_PATH = ("head", "slot", "tail")


def letters(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def parsed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """source, id, line_no, key (64 bits of the letters) and the path of each line with letters."""
    at = F.posexplode(F.transform(F.split(F.col(text_col), "\n"), letters)).alias("pos", "let")
    rows = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), at).filter("let <> ''")
    head, tail, size = DEPTH * WIDTH, TAIL * WIDTH, F.length("let")
    return rows.select(
        "source",
        "id",
        (F.col("pos") + 1).cast("int").alias("line_no"),
        F.xxhash64("let").alias("key"),
        F.substring("let", 1, head).alias("head"),
        F.when(size > head + tail, SLOT).otherwise("").alias("slot"),
        F.substr(F.col("let"), F.greatest(F.lit(head + 1), size - tail + 1)).alias("tail"),
    )


def _least(share: float, least: int) -> Column:
    return F.greatest(F.lit(float(least)), F.lit(share) * F.col("docs"))


def _opened(docs: DataFrame, id_col: str, text_col: str, source_col: str, share: float, least: int) -> DataFrame:
    """A written table of the lines (source, id, line_no, key, path, docs of the source) in templates that may cover enough.

    Lines of a document are summed, so that a template's count bounds its documents from above.
    """
    lines = parsed(docs, id_col, text_col, source_col)
    sizes = stage(docs.groupBy(F.col(source_col).alias("of")).agg(F.count("*").alias("docs")), "line-sources")
    tree = lines.groupBy("source", *_PATH).agg(F.count("*").alias("covered")).filter(F.col("covered") >= least)
    kept = tree.join(sizes, F.col("source").eqNullSafe(F.col("of"))).filter(F.col("covered") >= _least(share, least))
    found = stage(kept.select("source", *_PATH, "docs"), "line-templates")
    on = [F.col("l.source").eqNullSafe(F.col("f.source")), *[F.col(f"l.{c}") == F.col(f"f.{c}") for c in _PATH]]
    inside = lines.alias("l").join(found.alias("f"), on)
    return stage(inside.select("l.source", "l.id", "l.line_no", "l.key", *[f"l.{c}" for c in _PATH], "f.docs"), "line-inside")


def _often(inside: DataFrame, share: float, least: int, *by: str) -> DataFrame:
    """source, the columns by, documents: what occurs in enough documents."""
    return (
        inside.select("source", *by, "docs", "id").distinct()
        .groupBy("source", *by, "docs").agg(F.count("*").alias("documents"))
        .filter(F.col("documents") >= _least(share, least))
        .drop("docs")
    )


def _hit(inside: DataFrame, often: DataFrame, *by: str) -> DataFrame:
    on = [F.col("i.source").eqNullSafe(F.col("e.source")), *[F.col(f"i.{c}") == F.col(f"e.{c}") for c in by]]
    return inside.alias("i").join(often.alias("e"), on, "left_semi").select("id", "line_no")


def templates(
    docs: DataFrame, id_col: str = "id", text_col: str = "article_text", source_col: str = "source_name", share: float = 0.05, least: int = 5
) -> DataFrame:
    """source, template, documents: the templates that cover least documents of the source and that share of them."""
    often = _often(_opened(docs, id_col, text_col, source_col, share, least), share, least, *_PATH)
    return often.select("source", F.concat(*_PATH).alias("template"), "documents")


def template_lines(
    docs: DataFrame, id_col: str = "id", text_col: str = "article_text", source_col: str = "source_name", share: float = 0.05, least: int = 5
) -> DataFrame:
    """id, line_no of the lines of these templates, for without_lines()."""
    inside = _opened(docs, id_col, text_col, source_col, share, least)
    return _hit(inside, stage(_often(inside, share, least, *_PATH), "line-often"), *_PATH)


def repeated_lines(
    docs: DataFrame,
    id_col: str = "id",
    text_col: str = "article_text",
    source_col: str = "source_name",
    share: float = 0.05,
    least: int = 5,
) -> DataFrame:
    """id, line_no of the lines that are in least documents of the source and in that share of them."""
    inside = _opened(docs, id_col, text_col, source_col, share, least)
    return _hit(inside, stage(_often(inside, share, least, "key"), "line-exact"), "key")


def without_lines(docs: DataFrame, found: DataFrame, id_col: str = "id", text_col: str = "article_text") -> DataFrame:
    """id and text of every document without its found lines."""
    gone = found.groupBy(F.col("id").alias("of")).agg(F.collect_set("line_no").alias("gone"))
    left = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = F.filter(
        F.split("text", "\n"), lambda line, i: ~F.coalesce(F.array_contains(F.col("gone"), (i + 1).cast("int")), F.lit(False))
    )
    return left.join(gone, left["id"] == gone["of"], "left").select(
        "id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    )
