"""The queries of the ten problems, and SQL where SQL can say the same over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelark.llm import best, canon, encode, history, names, near, pack, pages, repeats
from wirelark.session import spread, stage, table


def _stories(spark: SparkSession, d: str) -> DataFrame:
    return pages.story_sets(spread(table(spark, d, "articles")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near.pairs_of(near.groups(_stories(spark, d)))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every article with its group; an article of no group is its own."""
    docs = _stories(spark, d)
    g = near.groups(docs)
    return docs.select("id").join(g, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(spread(table(spark, d, "articles")), spread(table(spark, d, "candidates")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _stories(spark, d)
    groups = stage(near.groups(docs), "groups")
    return best.survivors(groups, spread(table(spark, d, "articles")), table(spark, d, "sources"), docs)


def p3_consensus(spark: SparkSession, d: str) -> DataFrame:
    groups = stage(near.groups(_stories(spark, d)), "groups")
    return best.consensus(groups, spread(table(spark, d, "articles")), "title")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.residue_found(spread(table(spark, d, "articles")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.furniture_found(spread(table(spark, d, "articles")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked(spread(table(spark, d, "articles")), table(spark, d, "organisations"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_lines(spread(table(spark, d, "articles")))


def p7_templates(spark: SparkSession, d: str) -> DataFrame:
    return repeats.templates(spread(table(spark, d, "articles"))).withColumnRenamed("source", "source_name")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(spread(table(spark, d, "documents")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    ids = encode.encoded(spread(table(spark, d, "documents")))
    return pack.packed(stage(ids.select("doc_id", F.size("ids").alias("n_tokens")), "sizes"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.same_looking(spread(table(spark, d, "documents")))


def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canon.canonical_texts(spread(table(spark, d, "documents"))).select(F.col("id").alias("doc_id"), "canonical_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p2_found, p3_found, p3_consensus, p4_found, p5_found, p6_found, p7_found, p7_templates, p8_ids,
        p9_containers, p10_found, p10_canonical,
    )
}

SQL: dict[str, str] = {
    "p7_found": r"""
        with l as (
            select source_name, id, generate_subscripts(string_split(article_text, chr(10)), 1) as line_no,
                   unnest(string_split(article_text, chr(10))) as line
            from articles where article_text is not null
        ),
        k as (select source_name, id, line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') as let from l),
        n as (select source_name, count(*) as docs from articles group by source_name),
        often as (
            select k.source_name, k.let from k join n on k.source_name is not distinct from n.source_name
            where k.let <> '' group by k.source_name, k.let, n.docs
            having count(distinct k.id) >= 5 and count(distinct k.id) >= 0.05 * n.docs
        )
        select k.id, cast(k.line_no as integer) as line_no
        from k join often on k.source_name is not distinct from often.source_name and k.let = often.let
    """,
    "p7_templates": r"""
        with l as (
            select source_name, id, regexp_replace(lower(unnest(string_split(article_text, chr(10)))), '[^\p{L}]+', '', 'g') as let
            from articles where article_text is not null
        ),
        k as (
            select source_name, id, substring(let, 1, 15) || case when length(let) > 25 then '<*>' else '' end
                   || case when length(let) > 15 then right(substring(let, 16), 10) else '' end as template
            from l where let <> ''
        ),
        n as (select source_name, count(*) as docs from articles group by source_name)
        select k.source_name, k.template, count(distinct k.id) as documents
        from k join n on k.source_name is not distinct from n.source_name
        group by k.source_name, k.template, n.docs
        having count(distinct k.id) >= 5 and count(distinct k.id) >= 0.05 * n.docs
    """,
}
