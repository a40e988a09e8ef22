"""Problem 3: one surviving record for each group of duplicates.

Two operators. survivors() chooses each field's value by the rules that TESTDATA.md states for the result p3_found; a
vote over tokens cannot give them (it knows no source priority, no dates and no completeness), so its method is another
one: the best row of each field by a partial maximum. consensus() is the method named for the problem, token-level
consensus, for fields without such rules, here titles.

consensus(): the distinct values of a group, weighted by how often they occur, are aligned progressively into a profile
of columns; each column is decided by the weight of its tokens; the existing value closest to the outcome is emitted.
A group's values are aligned in chunks of CHUNK values, and the profiles of the chunks are merged the same way level by
level, so that no task ever holds a large group.

Defined results: unusable times (null, before 2000, after the record was stored) never win a date; ties go to the
smallest id, in consensus() to the more frequent and then the smaller value; null and blank values do not vote; a group
without any value has no row.
"""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.session import stage

CHUNK = 32


def usable(published: Column, created: Column) -> Column:
    """The time of publication where it is credible, else null."""
    ok = (published >= F.lit("2000-01-01 00:00:00").cast("timestamp")) & ((published <= created) | created.isNull())
    return F.when(ok, published)


def survivors(groups: DataFrame, articles: DataFrame, sources: DataFrame, words: DataFrame) -> DataFrame:
    """group_id, field_name, id of the row whose value is kept.

    groups: id, group_id. words: id, words of the main text. A hot group is reduced by partial maxima.
    """
    a = articles.select("id", "source_name", usable(F.col("published_at"), F.col("created_at")).alias("ts"))
    s = sources.select("source_name", "source_priority")
    rows = groups.join(a, "id").join(words.select("id", "words"), "id").join(s, "source_name", "left")
    first = -F.col("id")
    best = rows.groupBy("group_id").agg(
        F.max(F.struct("source_priority", "ts", first)).alias("source_name"),
        F.max(F.struct("words", first)).alias("article_text"),
        F.max(F.when(F.col("ts").isNotNull(), F.struct("ts", first))).alias("published_at"),
    )
    fields = [
        F.struct(F.lit("source_name").alias("field_name"), (-F.col("source_name.col3")).alias("id")),
        F.struct(F.lit("article_text").alias("field_name"), (-F.col("article_text.col2")).alias("id")),
        F.struct(F.lit("published_at").alias("field_name"), (-F.col("published_at.col2")).alias("id")),
    ]
    return best.select("group_id", F.explode(F.array(*fields)).alias("f")).select("group_id", "f.*").filter("id is not null")


def align(profile: list[dict[str, float]], other: list[dict[str, float]]) -> list[dict[str, float]]:
    """One profile of two: columns that agree in their heaviest token are merged, others stand side by side."""
    top = lambda col: max(col.items(), key=lambda kv: (kv[1], kv[0]))[0]
    x, y = [top(c) for c in profile], [top(c) for c in other]
    out: list[dict[str, float]] = []
    gap_x, gap_y = _weight(profile), _weight(other)

    def merged(a: dict[str, float], b: dict[str, float]) -> dict[str, float]:
        return {k: a.get(k, 0.0) + b.get(k, 0.0) for k in (*a, *(k for k in b if k not in a))}

    for tag, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag == "equal" or tag == "replace" and i2 - i1 == j2 - j1:
            out += [merged(a, b) for a, b in zip(profile[i1:i2], other[j1:j2])]
        else:
            out += [merged(c, {"": gap_y}) for c in profile[i1:i2]] + [merged({"": gap_x}, c) for c in other[j1:j2]]
    return out


def _weight(profile: list[dict[str, float]]) -> float:
    return sum(profile[0].values()) if profile else 0.0


def _progressive(profiles: list[list[dict[str, float]]]) -> list[dict[str, float]]:
    made = profiles[0]
    for p in profiles[1:]:
        made = align(made, p)
    return made


def consensus(groups: DataFrame, values: DataFrame, field: str) -> DataFrame:
    """group_id and the existing value of field that is closest to the consensus of its group. values: id, field."""
    rows = groups.join(values.select("id", F.col(field).alias("value")), "id").filter(F.trim("value").rlike(r"\S"))
    own = stage(rows.groupBy("group_id", "value").agg(F.count("*").alias("w")), "best-values")

    def chunks(df: DataFrame) -> DataFrame:
        n = df.groupBy("group_id").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
        return df.join(n, "group_id").withColumn("chunk", F.pmod(F.xxhash64("order"), "parts").cast("int"))

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "value"], ascending=[False, True])
        made = [[{t: float(w)} for t in v.split()] for v, w in zip(pdf["value"], pdf["w"])]
        return pd.DataFrame({"group_id": [pdf["group_id"].iat[0]], "order": [int(pdf["chunk"].iat[0])], "profile": [json.dumps(_progressive(made))]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order")
        made = _progressive([json.loads(p) for p in pdf["profile"]])
        return pd.DataFrame({"group_id": [pdf["group_id"].iat[0]], "order": [int(pdf["chunk"].iat[0])], "profile": [json.dumps(made)]})

    schema = "group_id bigint, order bigint, profile string"
    level = chunks(own.withColumn("order", F.xxhash64("value"))).groupBy("group_id", "chunk").applyInPandas(start, schema)
    level = stage(level, "best-profiles")
    while not level.groupBy("group_id").count().filter("count > 1").isEmpty():
        level = stage(chunks(level).groupBy("group_id", "chunk").applyInPandas(merge, schema), "best-profiles")

    @F.pandas_udf("double")
    def closeness(value: pd.Series, profile: pd.Series) -> pd.Series:
        out, memo = [], {}
        for v, p in zip(value, profile):
            if p not in memo:
                memo.clear()
                tops = [max(c.items(), key=lambda kv: (kv[1], kv[0]))[0] for c in json.loads(p)]
                memo[p] = [t for t in tops if t]
            out.append(SequenceMatcher(None, v.split(), memo[p], autojunk=False).ratio())
        return pd.Series(out)

    judged = own.join(level.select("group_id", "profile"), "group_id").select(
        "group_id", "value", "w", closeness("value", "profile").alias("close")
    )
    first = F.min(F.struct((-F.col("close")).alias("c"), (-F.col("w")).alias("w"), "value"))
    return judged.groupBy("group_id").agg(first.alias("m")).select("group_id", F.col("m.value").alias(field))
