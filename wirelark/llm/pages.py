"""Passes over articles that the page operators share: residue, furniture and the word sets of stories.

Each pass reads a text once and writes what it saw; residue that only the counts over all pages show (residue.late) is
joined to it afterwards, from narrow columns. Null and repeated rows are as in residue and body; other columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.functions import url
from wirelark.llm import body, residue, sets
from wirelark.session import stage

#: What a pass notes of a field for residue.late.
_NOTED = "residue boolean, asks array<bigint>, apart boolean, title string, host string"


def with_recurrent(articles: DataFrame, url_col: str = "url", text_col: str = "article_text", *keep: str) -> DataFrame:
    """The columns keep, host, and the keys of the boilerplate of each row's host.

    The table of boilerplate is written first: its size is then known, and the planner sends it to all executors if
    it is small and joins by host if not.
    """
    often = stage(residue.recurrent_lines(articles, url_col, text_col), "recurrent")
    return articles.select(*keep, F.coalesce(url.host(F.col(url_col)), F.lit("")).alias("host")).join(often, "host", "left")


def _titled(articles: DataFrame) -> DataFrame:
    """articles, with null titles if it has none; notices by counts are then not looked for."""
    return articles if "title" in articles.columns else articles.withColumn("title", F.lit(None).cast("string"))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _noted(batch: pa.RecordBatch, seen: tuple[np.ndarray, list, np.ndarray]) -> list[pa.Array]:
    return [pa.array(seen[0]), pa.array(seen[1], pa.list_(pa.int64())), pa.array(seen[2]), _column(batch, "title"), _column(batch, "host")]


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _hosts(b: pa.RecordBatch) -> residue.Hosts:
    return residue.Hosts(_column(b, "host"), _column(b, "keys"))


def residue_found(articles: DataFrame) -> DataFrame:
    """id, field_name: the fields article_text and abstract that hold residue instead of content (problem 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = _hosts(b)
            for f in ("article_text", "abstract"):
                seen = residue.judge(_column(b, f), hosts, _column(b, "title"))
                made = pa.record_batch([_column(b, "id"), pa.array([f] * len(b)), *_noted(b, seen)], names=["id", "field_name", *_names(_NOTED)])
                yield made.filter(pa.array(seen[0] | np.array([x is not None for x in seen[1]], dtype=bool)))

    df = with_recurrent(_titled(articles), "url", "article_text", "id", "article_text", "abstract", "title")
    noted = stage(df.mapInArrow(run, f"id bigint, field_name string, {_NOTED}"), "residue")
    return noted.filter("residue").select("id", "field_name").unionByName(residue.late(noted))


def furniture_found(articles: DataFrame) -> DataFrame:
    """id, field_name, line_no: the non-blank lines that are not of the story (problem 5).

    Fields with residue are left out, and both fields of an article whose text is residue.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, n = _hosts(b), len(b)
            out = np.zeros(n, dtype=bool)
            for f in ("article_text", "abstract"):
                seen = residue.judge(_column(b, f), hosts, _column(b, "title"))
                out = seen[0] if f == "article_text" else out
                blk, bad = body.furniture(_column(b, f))
                hit = np.flatnonzero(bad & ~(seen[0] | out)[blk.doc])
                ends = np.searchsorted(blk.doc[hit], np.arange(n + 1)).astype(np.int32)
                lines = pa.ListArray.from_arrays(pa.array(ends), pa.array(blk.no[hit].astype(np.int32)))
                some = (np.diff(ends) > 0) | np.array([x is not None for x in seen[1]], dtype=bool)
                cols = [_column(b, "id"), pa.array([f] * n), lines, *_noted(b, seen)]
                yield pa.record_batch(cols, names=["id", "field_name", "lines", *_names(_NOTED)]).filter(pa.array(some))

    df = with_recurrent(_titled(articles), "url", "article_text", "id", "article_text", "abstract", "title")
    noted = stage(df.mapInArrow(run, f"id bigint, field_name string, lines array<int>, {_NOTED}"), "furniture")
    late = stage(residue.late(noted), "late")
    left = noted.select("id", "field_name", "lines").join(late, ["id", "field_name"], "left_anti")
    left = left.join(late.filter("field_name = 'article_text'").select("id"), "id", "left_anti")
    return left.select("id", "field_name", F.explode("lines").alias("line_no"))


#: Names of string columns, and what makes them of a batch.
Made = tuple[tuple[str, ...], Callable[[pa.RecordBatch], list[pa.Array]]]
_NONE: Made = ((), lambda _: [])


def story_runner(id_col: str, text_col: str, judged: bool, extra: tuple[str, ...] = (), also: Made = _NONE) -> Callable:
    """A pass that gives for each row its id, what residue.late needs (nothing if not judged), the columns extra and also, and
    the word sets of its story."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = sets.Maker()
        for b in batches:
            texts, n = _column(b, text_col), len(b)
            seen = residue.judge(texts, _hosts(b), _column(b, "title")) if judged else (np.zeros(n, dtype=bool), [], [])
            main = body.join_story(body.furniture(texts), n)
            cols = [_column(b, id_col), *(_noted(b, seen) if judged else []), *(_column(b, x) for x in extra), *also[1](b), *maker.arrays(main, seen[0])]
            yield pa.record_batch(cols, names=["id", *(_names(_NOTED) if judged else []), *extra, *also[0], *sets.NAMES])

    return run


def judged_stories(articles: DataFrame, extra: tuple[str, ...] = (), also: Made = _NONE) -> tuple[DataFrame, DataFrame]:
    """A written table (id, residue, extra, also and the word sets of the main text of each article, see sets.Maker), and a
    small one with the ids whose text is residue by residue.late only.

    articles: id, url, title, article_text and the columns extra (strings).
    """
    df = with_recurrent(_titled(articles), "url", "article_text", "id", "article_text", "title", *extra)
    more = "".join(f"{x} string, " for x in (*extra, *also[0]))
    made = stage(df.mapInArrow(story_runner("id", "article_text", True, extra, also), f"id bigint, {_NOTED}, {more}{sets.DDL}"), "stories")
    late = stage(residue.late(made.withColumn("field_name", F.lit("article_text"))).select("id"), "late")
    return made, late


def story_sets(articles: DataFrame) -> DataFrame:
    """id and the word sets of the main text of each article that is not residue."""
    made, late = judged_stories(articles)
    return made.filter("not residue").join(late, "id", "left_anti").select("id", *sets.NAMES)
