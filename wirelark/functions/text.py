"""Text functions as Column expressions: normal forms, hash keys, title terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
TOPIC_ALIASES = {
    "agencies": "agency", "days": "day", "federal": "government", "govt": "government", "firm": "company",
    "flaw": "vulnerability", "flaws": "vulnerability", "vulnerabilities": "vulnerability", "patched": "patch",
    "patches": "patch", "patching": "patch", "takes": "take",
}
TOPIC_STOP = (
    "about after against amid and are from has have into its new news of on says said the this to using with "
    "warns warning cyber cybersecurity security attack attacks attacked campaign campaigns hackers malware "
    "microsoft phishing systems users windows"
).split()
KNOWN_ENTITIES = "acme cisa deepseek google meta microsoft nso openai whatsapp".split()
SOURCE_SUFFIX = r"(?U)\s+-\s+[\p{L}\p{N}_ .,&'()]{2,80}$"
PREFIX = 4000


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize(c: Column) -> Column:
    """Lower case with single blanks: the form that is hashed. Null stays null."""
    return squeeze(F.lower(c))


def content_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def fingerprint(title: Column, text: Column) -> Column:
    """Of the title and the first 3000 characters, cut before they are normalised."""
    return F.sha2(normalize(F.concat(title, F.lit(" "), F.substring(text, 1, 3000))), 256)


def incident_entity(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "))


def incident_key(victim: Column, attack: Column) -> Column:
    return F.sha2(F.concat_ws("|", incident_entity(victim), incident_entity(attack)), 256)


def similarity_text(c: Column) -> Column:
    """Lower case, URLs and all but a-z and 0-9 as blanks."""
    c = F.regexp_replace(F.lower(c), r"(?U)https?://\S+", " ")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def _aliased(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TOPIC_ALIASES.items() for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))


def topic_text(c: Column) -> Column:
    return F.array_join(_aliased(F.split(similarity_text(c), " ")), " ")


def without_source(title: Column) -> Column:
    """Without a trailing " - Source name"."""
    return F.regexp_replace(title, SOURCE_SUFFIX, "")


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def similarity_document(title: Column, abstract: Column, text: Column, prefix: int = PREFIX) -> Column:
    return _joined(
        similarity_text(without_source(title)), similarity_text(abstract), similarity_text(F.substring(text, 1, prefix))
    )


def topic_document(title: Column, abstract: Column, text: Column, prefix: int = PREFIX) -> Column:
    """The title counts twice."""
    t = topic_text(without_source(title))
    return _joined(t, t, topic_text(abstract), topic_text(F.substring(text, 1, prefix)))


def salient_terms(title: Column) -> Column:
    words = F.split(topic_text(without_source(title)), " ")
    stop = F.array(*[F.lit(x) for x in TOPIC_STOP])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def shared_terms(left: Column, right: Column) -> Column:
    """Sorted common terms of two term sets if they are two at least or a quarter of the union, else none."""
    both = F.array_intersect(left, right)
    jaccard = F.size(both) / F.greatest(F.size(F.array_union(left, right)), F.lit(1))
    return F.when((F.size(both) >= 2) | ((F.size(both) > 0) & (jaccard >= 0.25)), F.array_sort(both)).otherwise(
        F.array().cast("array<string>")
    )


def entity_terms(title: Column) -> Column:
    """Names in a title: all capitals, a capital inside, or a known one."""
    head = F.regexp_replace(title, r"(?s)^(.*) - .*$", "$1")
    known = F.array(*[F.lit(x) for x in KNOWN_ENTITIES])
    found = F.regexp_extract_all(head, F.lit(r"\b[A-Z][A-Za-z0-9&.-]{2,}\b|\b[A-Z]{2,}\b"), F.lit(0))

    def low(t: Column) -> Column:
        return F.lower(F.regexp_replace(t, r"^[.,:;!?()\[\]{}]+|[.,:;!?()\[\]{}]+$", ""))

    kept = F.filter(
        found,
        lambda t: (F.length(low(t)) > 2)
        & ((F.upper(t) == t) | F.substring(t, 2, 1 << 20).rlike("[A-Z]") | F.array_contains(known, low(t))),
    )
    return F.array_distinct(F.transform(kept, low))


def shared_entities(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_intersect(left, right))


def lead(text: Column) -> Column:
    """The first four sentences, 1500 characters at most."""
    return F.substring(F.array_join(F.slice(F.split(text, r"(?U)(?<=[.!?])\s+"), 1, 4), " "), 1, 1500)


def clip(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def iso_or_unknown(ts: Column) -> Column:
    """ISO form with offset; microseconds only where there are any; null is 'unknown'."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss+00:00")
    part = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00")
    return F.coalesce(F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(part), F.lit("unknown"))
