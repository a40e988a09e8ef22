"""Problem 6: the organisation that each spelling of a name means.

Method: merging and re-matching. Every organisation starts as a record with its own name. In the first round only sure
matches are merged (SURE edits or fewer); a merged spelling joins the record's profile: its spellings, and its initials, are
the union of both. Richer records enter blocking again with their whole profile; what is still open is compared with every
spelling of it, with all tolerance, so that a name that is far from the official one is found by a spelling between them.
Rounds go on until one merges nothing; there is no last round.

Only distinct spellings are compared, as lists of words. Spellings meet records by keys that every agreement shares: their
rare words with as many letters deleted as edits are allowed, the first letters of the whole, initials, and a first
partner; typing errors across words are found by lengths and the built-in edit distance, against all organisations, also
those of common words only (words of LEAST_COMMON organisations or more, which open no block by themselves; a single one
means no organisation). In later rounds a spelling first needs the rare words of an organisation, or its initials, before it
meets that organisation's profile, and one that a name itself is nearer to than any profile can be meets none.

Two spellings agree word by word, whatever the order: equal, abbreviated, or with few edits (transpositions count one); edits
are counted on a folded form in which sounds that are typed alike are one. Of organisations that a spelling fits equally
well the one of the row's category is meant, if that is one, else none. Not exact: profiles of later rounds are met by keys
alone, so a spelling whose only agreement with a merged one is by edits across words may be missed.

Defined results: null, blank and general words match nothing; a spelling that is exactly an organisation's name means
that one and is no case; rows repeat as they do in the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.session import stage

LEAST_COMMON, SURE = 6, 1.0
#: Letters that a shortened name has at least.
LEAST_PREFIX = 10
#: A match by a merged spelling costs so much more than one by the name itself.
FARTHER = 2.0
# Legal forms, which a spelling may leave out, and words around a name that are not of it.
LEGAL = frozenset("ltd limited inc incorporated corp corporation company co plc llc llp lp gmbh ag sa group holdings holding partners".split())
_AROUND = re.compile(r"^(?:(?:the|staff at|staff of|employees of|employees at|customers of|officials at|workers at|users of)\s+)+|\s+(?:group|and others)$")
_SPELT = {"limited": "ltd", "corporation": "corp", "incorporated": "inc", "co": "company", "and": "&", "st": "saint", "uni": "university"}
_LINK = frozenset(("of", "the", "for", "&", "and"))


def words(name: str) -> list[str]:
    s = re.sub(r"\([^)]*\)", " ", name.lower()).replace("s/w", "software")
    s = re.sub(r"[\s_\-\"'“”‘’.,;:/|*]+", " ", re.sub(r"(?<=\w)&(?=\w)|(?<=\w)&|&(?=\w)", " & ", s)).strip()
    for _ in range(3):
        s = _AROUND.sub("", s).strip()
    return [_SPELT.get(w, w) for w in s.split()]


@lru_cache(1 << 16)
def fold(w: str) -> str:
    """Sounds that are typed alike as one."""
    for a, b in (("ck", "k"), ("th", "t"), ("ph", "f"), ("ou", "u"), ("ea", "e"), ("ie", "i")):
        w = w.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", w)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, now = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = now, [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, now = last, row
    return min(now[-1], most + 1)


@lru_cache(1 << 18)
def near(a: str, b: str, most: int) -> int:
    """Edits between two words as they stand or folded, whichever are fewer."""
    d = edits(a, b, most)
    return d if d <= 1 else min(d, edits(fold(a), fold(b), most))


def _short(a: str, b: str) -> bool:
    """a abbreviates b: its start, or its letters in order from the first."""
    if len(a) >= len(b) or a[0] != b[0]:
        return False
    if b.startswith(a):
        return len(a) == 1 or len(a) >= 3
    if len(a) < 3 or len(b) - len(a) < 2:
        return False
    it = iter(b)
    return all(x in it for x in a)


def initials(ws: list[str]) -> set[str]:
    """With and without the words of and the like, and with and without the last legal form of a longer name."""
    out = set()
    for link in (True, False):
        own = [w for w in ws if w != "&" and (link or w not in _LINK)]
        out.add("".join(w[0] for w in own))
        if len(own) > 3 and own[-1] in LEGAL:
            out.add("".join(w[0] for w in own[:-1]))
    return out


def _cost(a: list[str], b: list[str], common: frozenset[str], city: str) -> float:
    """Edits that lead from one word list to the other, 99 if they do not mean the same."""
    if city in a and city not in b:
        a = [w for w in a if w != city]
    flat_a, flat_b = fold("".join(a)), fold("".join(b))
    best = 99.0
    if not a:
        return best
    if len(a) == 1 and "&" in b and len(b[0]) > 4 and near(a[0], b[0], 1) <= 1:
        return 0.8 + near(a[0], b[0], 1)  # a firm by its first partner
    if len(flat_a) >= LEAST_PREFIX and flat_b.startswith(flat_a) and 4 * len(flat_a) >= 3 * len(flat_b) and len(a) < len(b):
        best = 0.5
    if abs(len(flat_a) - len(flat_b)) <= 3:
        d = edits(flat_a, flat_b, 3)
        # joined words and typing errors, as long as the rare words stand
        if d <= (1 if len(flat_b) < 10 else 2 if len(flat_b) < 16 else 3) and _rare_stand(flat_a, b, common):
            best = min(best, float(d))
    open_b = list(b)
    total, rare = 0.0, False
    for w in sorted(a, key=lambda w: (w in common, -len(w))):
        found, at = 99.0, -1
        for i, v in enumerate(open_b):
            if w == v:
                c = 0.0
            elif v in common or v in LEGAL:
                if v == "&" or w == "&":
                    c = 99.0
                elif _short(w, v) or len(v) > 4 and w.startswith(v):
                    c = 0.1
                else:
                    c = float(near(w, v, 2))
                    c = c if c <= (2 if len(v) > 5 else 1) else 99.0
            elif len(w) == 1 and v.startswith(w):
                c = 0.4
            else:
                c = float(near(w, v, 2))
                c = c if c <= (0 if len(v) < 4 else 1 if len(v) < 7 else 2) else 99.0
            if c < found:
                found, at = c, i
        if at < 0 or found > 2:
            if w == city or w in LEGAL and not total:
                continue
            return best
        v = open_b.pop(at)
        if v not in common and v not in LEGAL and len(w) > 1:
            rare = True
        total += found
    left = [v for v in open_b if v not in LEGAL and v not in _LINK]
    if not rare:
        return best
    if left:
        # only a company's own word may stand for the whole, or its name without the legal form; with two edits it is any word
        if total > 1.9 or not any(v in LEGAL for v in b) or any(v not in common for v in left) or len(left) > 1:
            return best
        total += 0.6
    if any(v in LEGAL for v in open_b):
        total += 0.2
    if "&" in open_b:
        total += 0.2
    return min(best, total) if total <= 3.2 else best


def _rare_stand(flat: str, b: list[str], common: frozenset[str]) -> bool:
    """Each rare word of b is in flat with two edits at most (one if short)."""
    for v in b:
        f = fold(v)
        if v in common or v in LEGAL or v in _LINK or f in flat:
            continue
        n, most = len(f), 1 if len(f) < 7 else 2
        if not any(edits(flat[i : i + k], f, most) <= most for k in range(max(1, n - most), n + most + 1) for i in range(len(flat) - k + 1)):
            return False
    return True


def _variants(w: str, most: int) -> set[str]:
    """w, as it stands and folded, with up to most letters deleted: words of that many edits share one."""
    out = last = {w, fold(w)}
    for _ in range(most):
        last = {f[:i] + f[i + 1 :] for f in last for i in range(len(f))}
        out = out | last
    return out


def without(ws: list[str]) -> dict[str, list[str]]:
    """The words, and the words without each of them, by what is left out: a place may stand in any spelling."""
    return {"": ws} | {w: [v for v in ws if v != w] for w in ws}


def keys(ws: list[str], common: frozenset[str], record: bool) -> set[str]:
    """What a spelling, or a record, is met by. Words of a record of 4 letters may have an edit, of 7 two."""
    out: set[str] = set()
    for w in ws:
        if w in common or w in LEGAL or w in _LINK or len(w) < 2:
            continue
        n = len(w) + (0 if record else 2 if len(w) > 4 else 1)
        out |= {"w" + x for x in _variants(w, 0 if n < 4 else 1 if n < 7 else 2)}
        f = fold(w)
        if len(f) > 4:
            out |= {"p" + f[:4], "s" + f[-4:]}
    parts = [ws] if record else list(without(ws).values())
    for part in parts:
        flat = fold("".join(part))
        if len(flat) >= LEAST_PREFIX:
            out.add("f" + flat[:LEAST_PREFIX])
        if not record and len("".join(part)) > 1:
            out.add("i" + "".join(part))
        first = part[0] if part and (len(part) == 1 or record and "&" in part) else ""
        if len(first) > (4 if record else 3):
            out |= {"&" + x for x in _variants(first, 1)}
    if record:  # a record is also found by its initials
        out |= {"i" + x for x in initials(ws)}
    return out


def matched(names: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """name, org_id of the spellings (column name, distinct) that mean an organisation, and of those that fit several.

    orgs: org_id, org_name, city. The words that many organisations share are counted first; they are fewer than the
    organisations' words divided by LEAST_COMMON and are given to the tasks as a list.
    """
    spelt = F.explode(F.array_distinct(F.split(F.lower("org_name"), r"[\s.,]+"))).alias("w")
    counted = orgs.select(spelt).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COMMON)
    counted = counted.join(orgs.select(F.lower("city").alias("w")), "w", "left_anti")  # places tell names apart
    common = frozenset(_SPELT.get(r["w"], r["w"]) for r in counted.collect()) | _LINK

    def parsed(at: int):
        """With the words of a name, joined by blanks, in place of it, and the rows without any left out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = pa.array([" ".join(words(n or "")) or None for n in b.column(at).to_pylist()], pa.string())
                yield b.append_column("form", made).filter(made.is_valid())

        return run

    def blocked(record: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, ks = [], []
                for i, form in enumerate(b.column(b.schema.get_field_index("form")).to_pylist()):
                    own = keys(form.split(), common, record)
                    rows += [i] * len(own)
                    ks += sorted(own)
                took = b.take(pa.array(rows, pa.int64()))
                yield took.append_column("key", pa.array(ks, pa.string()))

        return run

    def flats(record: bool):
        """The folded whole of each form; of spellings also without each of their words."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, out, flat = [], [], []
                for i, form in enumerate(b.column(b.schema.get_field_index("form")).to_pylist()):
                    ws = form.split()
                    for left, part in ({"": ws} if record else without(ws)).items():
                        rows.append(i)
                        out.append(left)
                        flat.append(fold("".join(part)))
                took = b.take(pa.array(rows, pa.int64()))
                yield took.append_column("left", pa.array(out, pa.string())).append_column("flat", pa.array(flat, pa.string()))

        return run

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stands = lru_cache(1 << 16)(lambda flat, own: _rare_stand(flat, own.split(), common))
        first = lru_cache(1 << 16)(lambda form: initials(form.split()))
        for b in batches:
            cost = []
            for name, spelling, own, city, far in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                x = name.split()
                city = (city or "").lower()
                letters = "".join(w for w in x if w != city)
                if len(letters) > 1 and letters in first(spelling):
                    c = 1.0
                elif far and not stands(fold("".join(x)), own):
                    c = 99.0
                else:
                    c = _cost(x, spelling.split(), common, city)
                # a merged spelling vouches for its initials, and for what is near to it and has the rare words of the name
                cost.append(c + FARTHER if far else c)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cost, pa.float64())], names=["name", "org_id", "cost"])

    def standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The spellings and organisations whose rare words, or initials, agree: no other profile can change a result."""
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in (0, 2, 3)))
            fit = [letters or _rare_stand(fold(name.replace(" ", "")), own.split(), common) for name, own, letters in rows]
            yield b.select(["name", "org_id"]).filter(pa.array(fit, pa.bool_()))

    spelt_as = stage(names.select("name").filter("name is not null").mapInArrow(parsed(0), "name string, form string"), "names-forms")
    forms = stage(spelt_as.select("form").distinct(), "names-distinct")
    open_ = stage(forms.mapInArrow(blocked(False), "form string, key string").withColumnRenamed("form", "name"), "names-keys")
    base = orgs.select("org_id", F.col("org_name"), "city").mapInArrow(parsed(1), "org_id bigint, org_name string, city string, form string")
    base = stage(base.select("org_id", "form", F.col("form").alias("own"), "city", F.lit(False).alias("far")), "names-base")
    schema = "org_id bigint, form string, own string, city string, far boolean"
    records = stage(base.mapInArrow(blocked(True), f"{schema}, key string"), "names-records")
    pair = ["name", "org_id", "form", "own", "city", "far"]
    # spellings and names of organisations that few edits of the whole lead to; a swap is two edits of the built-in distance
    typed = forms.mapInArrow(flats(False), "form string, left string, flat string").withColumnRenamed("form", "name")
    typed = typed.withColumn("length", F.explode(F.sequence(F.length("flat") - 3, F.length("flat") + 3)))
    to = base.mapInArrow(flats(True), f"{schema}, left string, flat string").withColumnsRenamed({"flat": "whole"}).drop("left")
    to = to.withColumns({"length": F.length("whole"), "left": F.lower("city")})
    many = F.when(F.col("length") < 10, 2).when(F.col("length") < 16, 4).otherwise(6)
    typed = typed.filter("left = ''").drop("left").join(to.drop("left"), "length").unionByName(
        typed.filter("left <> ''").join(to, ["length", "left"]).drop("left")
    ).filter(F.levenshtein("flat", "whole", 6).between(0, many)).select(*pair)
    pairs = open_.join(records, "key").select(*pair).unionByName(typed).distinct()
    found = before = None
    while True:
        scored = pairs.mapInArrow(judge, "name string, org_id bigint, cost double").filter("cost < 50")
        if before is not None:  # what a name was near to before still counts, so that a later record settles no tie
            scored = scored.unionByName(before)
        best = stage(scored.groupBy("name", "org_id").agg(F.min("cost").alias("cost")), "names-scored")
        fit = (
            best.groupBy("name")
            .agg(F.min("cost").alias("least"), F.collect_list(F.struct("cost", "org_id")).alias("all"))
            .withColumn("orgs", F.transform(F.filter("all", lambda s: s["cost"] == F.col("least")), lambda s: s["org_id"]))
        )
        sure = fit.filter(F.size("orgs") == 1)
        if found is None:
            sure = sure.filter(F.col("least") <= SURE)
        one = stage(sure.select("name", F.col("orgs")[0].alias("org_id")), "names-merged")
        first = found is None
        found = one if first else found.unionByName(one)
        if not first and one.isEmpty():
            break
        settled = one.select("name").unionByName(fit.filter(F.col("least") < FARTHER).select("name")).distinct()
        open_ = stage(open_.join(settled, "name", "left_anti"), "names-keys")
        before = best.join(one.select("name"), "name", "left_anti")
        richer = one.join(base.select("org_id", "own", "city"), "org_id").filter("name <> own")
        richer = richer.select("org_id", F.col("name").alias("form"), "own", "city", F.lit(True).alias("far"))
        records = stage(richer.mapInArrow(blocked(True), f"{schema}, key string"), "names-records")
        asked = open_.join(records.select("key", "org_id", "own").distinct(), "key").groupBy("name", "org_id", "own")
        asked = asked.agg(F.max(F.col("key").startswith("i")).alias("letters")).mapInArrow(standing, "name string, org_id bigint")
        pairs = stage(asked, "names-asked").join(open_, "name").join(records, ["key", "org_id"]).select(*pair).distinct()
    tied = fit.filter(F.size("orgs") > 1).select("name", F.explode("orgs").alias("org_id"))
    by_name = lambda df: stage(spelt_as.join(df.withColumnRenamed("name", "form"), "form").select("name", "org_id"), "names-found")
    return by_name(found), by_name(tied)


def linked(
    articles: DataFrame, orgs: DataFrame, id_col: str = "id", name_col: str = "victim_name", category_col: str = "victim_category"
) -> DataFrame:
    """id, org_id of the rows whose name means an organisation without being exactly its name. Both tables may lack category_col."""
    kind = lambda df: (F.col(category_col) if category_col in df.columns else F.lit(None).cast("string")).alias("category")
    rows = articles.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), kind(articles))
    rows = rows.filter(F.col("name").isNotNull())
    exact = orgs.select(F.col("org_name").alias("name"))
    names = rows.select("name").distinct().join(exact, "name", "left_anti")
    found, tied = matched(names, orgs)
    own = tied.join(orgs.select("org_id", kind(orgs)), "org_id")
    one = own.groupBy("name", "category").agg(F.min("org_id").alias("org_id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return rows.join(found, "name").select("id", "org_id").unionByName(rows.join(one, ["name", "category"]).select("id", "org_id"))
