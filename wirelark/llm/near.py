"""Problem 1: groups of records that carry one text with edits, by a token-group matrix.

Method: similar documents are partitioned into groups; each group keeps the union of its tokens; for a query document
the union bounds the overlap with every member, and only groups that pass the bound are opened and compared exactly.

Steps, all of them joins and aggregations:
1. Documents with equal sets are linked to the first of them without a comparison; only that one goes on.
2. A first partition: documents that share one of the FIRST locality keys are compared exactly with the first document of
   the key's bucket (one candidate a document and bucket). Components of what agrees are the groups of the matrix.
3. The matrix: wherever several groups meet in a bucket, of whatever key, the documents of all but one are queries to the
   others. The bound is computed from 1,024-bit rows: tokens of the query whose bit the union lacks are surely missing. Only
   groups that can reach the limit are opened; their members are compared exactly. No true link that a bucket holds is lost.
   Groups that a link joins are one group for the next pass over the buckets that are still open, until none is joined: a
   larger group is also opened to those who meet another of its members.
4. Components over all links.

A group of copies that holds a third of all rows is one document after step 1. A bucket in which many groups meet is a hot
key of the join in step 3, which adaptive execution splits; pairs_of() splits hot groups itself. Defined results: null texts
and texts of fewer than three words have empty sets and are linked to nothing; repeated ids count once; ties cannot occur,
since links are symmetric and a component's label is its smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.llm.sets import LONGS
from wirelark.operators.graph import connected_components
from wirelark.session import stage

LIMIT = 0.5
#: Keys that make the first partition; the others only bring groups together for the matrix.
FIRST = 3
#: Members of a block of a group when pairs are written.
BLOCK = 256
_BITS = [f"b{i}" for i in range(LONGS)]


def missing(of: str, to: str) -> Column:
    """The number of marked bits of one row that another lacks."""
    total = F.lit(0)
    for b in _BITS:
        total = total + F.bit_count(F.col(f"{of}.{b}").bitwiseAND(F.bitwise_not(F.col(f"{to}.{b}"))))
    return total


def similar(a: Column, b: Column, limit: float) -> Column:
    """Exact Jaccard similarity of two token arrays is limit at least."""
    both = F.size(F.array_intersect(a, b))
    return both >= F.lit(limit) * (F.size(a) + F.size(b) - both)


def possible(a: str, b: str, limit: float) -> Column:
    """What sizes and bitmaps allow; false only where the similarity is surely under the limit."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(na - missing(a, b), nb - missing(b, a))
    return (F.least(na, nb) >= F.lit(limit) * F.greatest(na, nb)) & (most >= F.lit(limit) * (na + nb - most))


def compare(pairs: DataFrame, docs: DataFrame, limit: float, left: str = "x", right: str = "y", parts: int | None = None) -> DataFrame:
    """The pairs (left, right: ids) whose documents are similar. docs: id, n, set_hash, toks, bits.

    Bitmaps go first; token sets are fetched only for pairs that can still agree. Equal sets need no fetch. parts: the number
    of buckets by id of docs, if it is a bucketed table; see fetched.
    """
    light = ("n", "set_hash", *_BITS)
    a, b = fetched(docs, pairs, left, parts, *light).alias("a"), fetched(docs, pairs, right, parts, *light).alias("b")
    met = (
        pairs.alias("p").join(a, F.col(f"p.{left}") == F.col("a.id"))
        .join(b, F.col(f"p.{right}") == F.col("b.id"))
        .filter(possible("a", "b", limit))
        .select(left, right, (F.col("a.set_hash") == F.col("b.set_hash")).alias("same"))
    )
    met = stage(met, "near-met")
    return met.filter("same").select(left, right).unionByName(agreed(met.filter("not same"), docs, limit, left, right, parts))


def agreed(met: DataFrame, docs: DataFrame, limit: float, left: str = "x", right: str = "y", parts: int | None = None) -> DataFrame:
    """The pairs that are similar by their token sets."""
    t1, t2 = (fetched(docs, met, c, parts, "toks").select(F.col("id").alias(c), F.col("toks").alias(t)) for c, t in ((left, "t1"), (right, "t2")))
    return met.join(t1, left).join(t2, right).filter(similar(F.col("t1"), F.col("t2"), limit)).select(left, right)


def fetched(docs: DataFrame, pairs: DataFrame, by: str, parts: int | None, *columns: str) -> DataFrame:
    """id and columns of the docs that pairs name in the column by.

    From a table in buckets by id only the wanted rows move: their distinct ids go to the buckets and are held there, at most
    as many as a bucket has rows, however often pairs name them; the joins with pairs that follow can spill.
    """
    own = docs.select("id", *columns)
    if not parts:
        return own
    ids = pairs.select(F.col(by).alias("id")).distinct().repartition(parts, "id")
    return own.join(ids.hint("shuffle_hash"), "id", "left_semi")


def copies(docs: DataFrame) -> DataFrame:
    """x, y: each document and the first one of an equal set."""
    own = docs.filter("n > 0").select("set_hash", "n", "id")
    first = own.groupBy("set_hash", "n").agg(F.min("id").alias("x"), F.count("*").alias("m")).filter("m > 1")
    return own.join(first, ["set_hash", "n"]).filter("id > x").select("x", F.col("id").alias("y"))


def buckets(docs: DataFrame) -> DataFrame:
    """band, key, id, head of the buckets with two documents at least."""
    rows = docs.filter("n > 0").select("id", F.posexplode("keys").alias("band", "key"))
    many = rows.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).filter("head <> last").select("key", "head")
    return stage(rows.join(many, "key").select(F.col("band").cast("tinyint").alias("band"), "key", "id", "head"), "near-buckets")


def groups(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """id, group_id for every document with a link; group_id is the smallest id of the group.

    docs: a written table with the columns of sets.Maker.
    """
    same = stage(copies(docs), "near-copies")
    one = docs.join(same.select(F.col("y").alias("id")).distinct(), "id", "left_anti")
    met = buckets(one)
    star = met.filter((F.col("band") < FIRST) & (F.col("id") != F.col("head"))).select(F.col("head").alias("x"), F.col("id").alias("y"))
    first = stage(compare(star.distinct(), docs, limit), "near-links")
    part = stage(connected_components(first, "x", "y"), "near-first")
    of = met.join(part, met["id"] == part["node"], "left").select("key", "id", F.coalesce("component", "id").alias("g"))
    # buckets in which several groups meet
    several = lambda df: df.join(df.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 <> g1").select("key"), "key")
    left = stage(several(stage(of, "near-parts")), "near-open")
    links = first
    while True:
        found = matrix_links(left, part, one, docs, limit)
        if found.isEmpty():
            break
        links = stage(links.unionByName(found), "near-links")
        part = stage(connected_components(links, "x", "y"), "near-first")
        left = left.select("key", "id").join(part, left["id"] == part["node"], "left").select("key", "id", F.coalesce("component", "id").alias("g"))
        left = stage(several(stage(left, "near-parts")), "near-open")
    whole = connected_components(links.unionByName(same), "x", "y")
    return whole.select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def matrix_links(left: DataFrame, part: DataFrame, one: DataFrame, docs: DataFrame, limit: float) -> DataFrame:
    """x, y: links between documents of different groups that meet in a bucket. left: key, id, g; part: node, component."""
    queries = left.select("key", F.col("id").alias("x"), F.col("g").alias("own"))
    others = left.select("key", "g").distinct()
    asked = stage(queries.join(others, "key").filter("own > g").select("x", "g").distinct(), "near-asked")
    # the token-group matrix: a row of bits for each group that is asked about
    wanted = asked.select("g").distinct()
    held = part.join(wanted, part["component"] == wanted["g"]).select(F.col("node").alias("id"), "g")
    alone = wanted.join(part, wanted["g"] == part["node"], "left_anti").select(F.col("g").alias("id"), "g")
    member = stage(one.select("id", "n", *_BITS).join(stage(held.unionByName(alone), "near-members"), "id"), "near-rows")
    matrix = member.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"), *[F.bit_or(b).alias(b) for b in _BITS])
    q, m = docs.select("id", "n", *_BITS).alias("q"), matrix.alias("m")
    bound = F.col("q.n") - missing("q", "m")
    passed = (
        asked.join(q, F.col("x") == F.col("q.id"))
        .join(m, asked["g"] == F.col("m.g"))
        .filter(
            (bound >= F.lit(limit) * F.col("q.n"))
            & (F.col("m.most") >= F.lit(limit) * F.col("q.n"))
            & (F.col("m.least") * F.lit(limit) <= F.col("q.n"))
        )
        .select("x", asked["g"].alias("g"))
    )
    opened = passed.join(member.select("g", F.col("id").alias("y")), "g").select("x", "y").distinct()
    return stage(compare(opened, docs, limit), "near-found")


def pairs_of(groups: DataFrame) -> DataFrame:
    """id_a, id_b: all pairs within the groups, as the result of p1_found asks for.

    A large group is cut into blocks; each document meets the blocks of its group one by one, so that no task holds them all.
    """
    groups = stage(groups, "near-groups")
    n = groups.groupBy("group_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = groups.join(n, "group_id")
    a = rows.select("group_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("id_a"))
    b = rows.select("group_id", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.col("id").alias("id_b"))
    return a.join(b, ["group_id", "block"]).filter("id_a < id_b").select("id_a", "id_b")
