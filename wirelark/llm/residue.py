"""Problem 4: fields that hold template residue, filler, error pages or script notices instead of content.

Method: lines are normalised and counted by host; lines that recur over a host's pages are boilerplate and are
subtracted; what is left of a field is judged by the evidence it holds. A line is normalised to its first and last four
words without numbers, so that "Tell the Courier desk" lines that differ in one word are one line. A placeholder counts
wherever it stands; other evidence counts only if no sentence of a story is left. Evidence is of two kinds: the wording of
a line (EVIDENCE), and counts over all hosts (notices()): a sentence that is all that is left of pages on several hosts
whose titles have nothing in common with it or each other is a notice whatever it says.

Defined results: null, empty and white-space fields are no cases; a page of boilerplate alone is none either; a text is
read whole, however long it is. A line that is evidence itself is never subtracted as boilerplate. Rows without a host
count as one host "". Repeated rows count as pages of their own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.functions import url
from wirelark.llm.blocks import EDITORIAL, split_lines, squeeze
from wirelark.session import stage

#: A line is boilerplate of a host if this share of its pages, and so many of them, have it.
SHARE, LEAST = 0.05, 5

_FIELD = (
    r"(?:(?:article|first|last|full|user|victim|attack|company|teaser|meta|source|author|page|post|event|city|lead|short|long|image|product)"
    r"[ _.-]?)?(?:name|date|city|company|victim|amount|author|body|title|headline|summary|abstract|excerpt|lead|teaser|text|"
    r"description|quote|spokesperson|type|source|url|link|content|caption|country|number|email|sender|recipient|subject|"
    r"time|place|person|figure|value|field|placeholder|variable)"
)
PLACEHOLDER = (
    r"\{\{-?\s*[\pL_][\w.\-]*(?:\s*\|[^{}]*)?\s*-?\}\}|\$\{\s*[\pL_][\w.\-]*\s*\}|<%[=\-]?\s*[\pL_@][\w.\- ]*[\-]?%>|%%[\pL_][\w.]*%%|"
    r"(?:^|[\s(\"'“‘,;:/-])%[\pL_]{3,}%|@@[\w.]+@@|##[\pL_][\w.]*##|__[\pL][\w.]*__|<<[\pL_][\w.]*>>|<!--\s*[\w.\-]+\s*-->|"
    r"\{[\pL_][\w.]*\}|\[\[[\pL_][\w. ]*\]\]|\[[A-Z]+[_.][A-Z_.]+\]|\[[a-z]+_[a-z_]+\]|"
    rf"\[(?:insert |your |enter |add )?{_FIELD}(?: here)?\]|\[(?i:insert|your|enter|add) [\w ]+\]|\[{_FIELD.upper()}\]|"
    r"\bTKTK\b|\bTK-[A-Z_]+\b|\bTK TK\b|(?:^|[\s(\"'“,;:/-])#[\pL_]{3,}#|<[A-Z]+_[A-Z_]+>|<[\pL_]\w*(?: [\w ]*)? here>|"
    r"\{%-?\s*[\pL_][\w. ]*-?%\}|\*\|\w+\|\*|\[%[=\-]?\s*[\w. ]+%\]|\(\([A-Z_]{3,}\)\)|<(?:no|empty|missing|insert|your|add) [a-z ]+>|(?:^|\s)\$[A-Z_]{3,}\$"
)
_SAFE = r"\[(?:CONTINUE|MORE|READ MORE|UPDATED?|QUOTE ENDS|VIDEO|LIVE|SIC)\]"
#: Lines that say by themselves that there is no content; they are matched from their start.
EVIDENCE = (
    r"(?i)^\W*(?:"
    # filler, samples, words for no value
    r"lorem ipsum\b|dolor sit amet|asdf\b|qwerty\b|x{3,}\b|test(?:ing)? test|test (?:article|post|page|story|entry|text|content)\b|"
    r"(?:this is )?(?:a |some )?sample (?:article|post|page|story|text|content|copy)\b|replace (?:it|this) with your own\b|dummy (?:article|post|page|story|text|content)\b|"
    r"(?:this is )?(?:a )?placeholder\b|(?:lead|first|second|third|next|last|opening|closing)? ?(?:paragraph|sentence|quote|text|summary|headline|title|"
    r"body|caption|content|abstract|description|teaser|intro\w*)s? goes here|(?:add|write|enter|insert|provide|type) (?:a |an |your |the |some )?(?:short |brief |long )?"
    r"(?:description|abstract|summary|text|teaser|title|headline|caption|content|excerpt)\b|"
    r"(?:undefined|null|none|nil|nan|n/?a|tba|tbc|tbd|tk|todo|fixme|void|empty|missing|unknown|no (?:content|text|data|summary|abstract|description|title|excerpt)"
    r"(?: (?:yet|available|set|provided|found))?|not (?:available|applicable|provided)|coming soon|-+|\?+|\.+)\W*$|n/?a todo\b|todo:? \w+|\[object object\]|"
    # errors
    r"(?:http )?(?:error|fehler|erreur)[ :]*\d{3}\b|(?:server )?error \d{3}\b|[45]\d\d\b[ \-–:]*(?:not found|forbidden|unauthori[sz]ed|bad gateway|bad request|gone|"
    r"internal|service|server|gateway|too many|unavailable|access|error|request|payload|conflict)|oops\b|whoops\b|sorry, (?:the|this|that|we|but)|"
    r"(?:the |this |that )?(?:requested )?(?:page|file|resource|article|document|url|address) (?:you \w+ )?(?:\w+ )?(?:was |is |could |can |cannot |does |has |no |not |never )*(?:be )?"
    r"(?:not|no longer|moved|removed|gone|found|available|exist|cannot|unavailable)|page not found|not found\b|(?:we )?(?:could|can|did)(?: ?not|n't) (?:find|locate|load|open|display) (?:the|this|that|your|any|what)\b|"
    r"(?:use|try) the search\b|go back to the (?:front|home)|return to the (?:front|home)|the (?:web ?)?server (?:could|cannot|can't|is|was|has|encountered|did|returned)|"
    r"exception (?:while|in|at|during)\b|(?:fatal|internal|unexpected|runtime|syntax|parse|application|database|uncaught|critical)\b.{0,20}\b(?:error|exception)\b|"
    r"at (?:async )?[\w.$<>]+ ?\(\S+:\d+(?::\d+)?\)|traceback \(most|stack trace\b|warning: \w+\(|notice: undefined|(?:database|connection|query|request)\b.{0,12} (?:failed|refused|timed out|reset|error)|"
    r"connection (?:failed|refused|timed out)|timed? ?out\b|\S+ (?:took|is taking) too long|an? (?:unexpected |internal |unknown )?error (?:has )?occurred|something went wrong|"
    r"try again (?:in|later)|please try again|(?:reference|check|request|incident|error|ray|trace|case|kennung|event) ?(?:id|no|number|code|:)?:? [0-9a-f]{6,}\b|"
    r"access (?:to .{1,60} )?(?:is |was |has been )?(?:denied|forbidden|blocked|restricted)|zugriff verweigert|acc[eè]s (?:refus|interdit)|acceso denegado|"
    r"you (?:do not|don't) have (?:permission|access)|you are not authori[sz]ed|you have been blocked|your (?:ip|request|access) (?:has been|was|is)|"
    r"die (?:angeforderte )?seite\b|seite nicht gefunden|la page demand\w+|page introuvable|p[aá]gina no encontrada|"
    # maintenance, sign-in, pay walls
    r"\S+ (?:is|are) (?:currently |temporarily )?(?:down|offline|unavailable|closed|undergoing|under) ?(?:for|due|because)?\b.{0,30}maintenance|(?:scheduled|planned) maintenance|"
    r"(?:this |the |our )?(?:site|website|service|page|system) (?:is|are) (?:currently |temporarily )?(?:down|offline|unavailable|undergoing|under)|"
    r"we(?:'ll| will| are|'re)? (?:be |)(?:back|performing|working|carrying|doing|updating|currently)\b|thank you for your patience|under construction|"
    r"session (?:has )?(?:expired|timed)|your session|(?:please )?(?:sign|log) ?in (?:to (?:keep|continue|read|view|see|access)|or|first|again|required|with)|"
    r"(?:please )?(?:log ?in|sign in|register|subscribe) to (?:keep|continue|read|view|see|access|unlock)|you must (?:be )?(?:log|sign|subscri|register)|"
    r"(?:this|the) (?:article|story|content|page) is (?:for|only|reserved|available) .{0,20}(?:subscribers|members|only)|already a (?:member|subscriber)|"
    r"you have (?:used|read|reached|hit) (?:all |up )?(?:of )?your|(?:subscribers?|members?) only|"
    # scripts and browser checks
    r"(?:please |you (?:must|need to|should) )?(?:enable|activate|allow|switch on|turn on) (?:your )?(?:java ?scripts?|scripts?|cookies|scripting)|"
    r"java ?scripts? (?:is|are|must|needs?|has|appears|seems|required|disabled)|(?:this|the|our) [\w ]{0,30}(?:needs?|requires?|uses|relies on) (?:java ?)?script\w*|"
    r"veuillez activer|bitte (?:aktivieren|schalten)|(?:por favor,? )?(?:active|habilite) java|your browser (?:is|does|has|must|will|cannot|can't|needs|may)|(?:to|without) .{0,40}enable java ?script|"
    r"(?:one|just a) moment|please wait\b|(?:we are |we're )?(?:checking|verifying) (?:that |your |if |the |you )|(?:please )?(?:confirm|verify|prove) (?:that )?you(?:'re| are)|"
    r"are you (?:a )?(?:human|robot)|unusual traffic|complete the (?:captcha|check|security)|solve the (?:puzzle|captcha)|you will be (?:sent|redirected)|"
    r"(?:i'?m|i am) not a robot|ddos protection|attention required|this (?:process|check) is automatic|loading\b.{0,30}$|performance (?:&|and) security by"
    r")"
)
#: A line of more words than this is judged sentence by sentence, since a story may begin with the words of a notice.
LINE, PROSE = 20, 9
#: Filler that no story begins with: all of its line is filler, however long.
FILLER = r"(?i)^\W*(?:lorem ipsum\b|dolor sit amet|asdf\b|(?:qwerty\W+){2}|(?:x{3,}\W+){2}|test(?:ing)? test\b|\[object object\])"
#: Sentences that no story has, however long: stack traces, status codes with their phrase, orders to switch scripts on.
NOTICE = (
    r"(?i)^\W*(?:at (?:async )?[\w.$<>]+ ?\(\S+:\d+(?::\d+)?\)|traceback \(most|warning: \w+\(|notice: undefined|"
    r"(?:http )?(?:error )?[45]\d\d\b[ \-–:]*(?:not found|forbidden|unauthori[sz]ed|bad gateway|bad request|gone|internal server error|"
    r"service (?:temporarily )?unavailable|gateway time-?out|too many requests)(?:\W*$| ?[.:;|–\-]| (?:nginx|apache|the (?:requested|server)|you|your|request|reference)\b)|"
    r"(?:please |you (?:must|need to|should) )?(?:enable|activate|allow|switch on|turn on) (?:your )?(?:java ?scripts?|cookies|scripting)\b|"
    r"(?:to|without) .{0,40}\benable java ?script|veuillez activer|bitte aktivieren|(?:por favor,? )?(?:active|habilite) java|"
    r"java ?script (?:is|must be|needs to be) (?:required|disabled|enabled|turned o\w+|switched o\w+|activated)\b.{0,20}\b(?:your|to (?:use|view|see|read|continue|run|display))\b|"
    r"(?:we are |we're )?(?:checking|verifying) (?:that |if )?(?:your (?:browser|connection)|you are (?:a )?human)|ddos protection by)"
)
#: A notice found by counts: titles and hosts at least, words at most, titles a page at least, and the share of its pages that
#: may have a word in common, with each other's titles or between sentence and title.
PAGES, HOSTS, NOTICE_WORDS, TITLES, SHARED = 5, 3, 40, 0.8, 0.4
#: All that is no letter, and the words with digits that whole lines are compared without.
_GAP, _NUMBER = r"[^\p{L}]+", r"\S*\d\S*"


def letters_of(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), _GAP, " "))


def ends_of(t: Column) -> Column:
    return F.concat_ws(" ", F.substring_index(t, " ", 4), F.substring_index(t, " ", -4))


def normal_line(line: Column) -> Column:
    """The first and last four words of a line in lower case, without numbers; a blank for a line without letters."""
    return ends_of(letters_of(line))


def line_key(line: Column) -> Column:
    """64 bits of normal_line(); null for a line without letters."""
    t = normal_line(line)
    return F.when(t != " ", F.xxhash64(t))


def line_keys(lines: pa.Array, whole: bool = False) -> np.ndarray:
    """line_key() of an array of lines, or the same of whole lines; 0 for lines without letters."""
    t = pc.utf8_lower(lines)
    t = pc.utf8_trim(pc.replace_substring_regex(pc.replace_substring_regex(t, _NUMBER, " ") if whole else t, _GAP, " "), " ")
    if not whole:
        first = pc.replace_substring_regex(t, r"^(\S+ \S+ \S+ \S+) .*$", r"\1")
        t = pc.binary_join_element_wise(first, pc.replace_substring_regex(t, r"^.* (\S+ \S+ \S+ \S+)$", r"\1"), " ")
    d = t.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(x.encode(), seed=42) if x.strip() else 0 for x in d.dictionary.to_pylist()], dtype=np.uint64)
    return own.view(np.int64)[d.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(len(t), dtype=np.int64)


def recurrent_lines(articles: DataFrame, url_col: str, text_col: str, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """host, keys: the lines that recur over the pages of a host.

    Lines are counted once a page; counts are summed on the map side first. The list of a host is short by its
    definition: at most the lines of a page divided by share.
    """
    host = F.coalesce(url.host(F.col(url_col)), F.lit(""))
    # normal_line() in two steps, since a lambda would evaluate the first one twice
    texts = F.array_distinct(F.transform(F.transform(F.split(F.col(text_col), "\n"), letters_of), ends_of))
    rows = articles.select(host.alias("host"), F.explode(texts).alias("line")).filter("line <> ' '")
    lines = rows.select("host", F.xxhash64("line").alias("key"))
    pages = articles.groupBy(host.alias("host")).agg(F.count("*").alias("pages"))
    often = lines.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return (
        often.join(pages, "host")
        .filter(F.col("n") >= share * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("key").alias("keys"))
    )


_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[^\W_a-z])")


def _matches(t: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(t, pattern).to_numpy(zero_copy_only=False)


def _words(t: pa.Array) -> np.ndarray:
    return pc.count_substring(t, " ").to_numpy(zero_copy_only=False) + 1


def evident_lines(t: pa.Array) -> np.ndarray:
    """Whether each line says that there is no content.

    A long line that begins with evidence is judged as if each of its sentences stood on a line of its own: one is evidence and none is prose.
    """
    out = _matches(t, EVIDENCE)
    long = np.flatnonzero(out & (_words(t) > LINE))
    if not len(long):
        return out
    lines = t.take(pa.array(long))
    filler = _matches(lines, FILLER)
    cut = [_SENTENCE.split(x) for x in lines.to_pylist()]
    of = np.repeat(np.arange(len(long)), [len(x) for x in cut])
    one = pa.array([x for c in cut for x in c], pa.string())
    n = _words(one)
    says = _matches(one, NOTICE) | _matches(one, EVIDENCE) & (n <= LINE)
    some = np.bincount(of[says], minlength=len(long)) > 0
    prose = np.bincount(of[~says & (n >= PROSE)], minlength=len(long)) > 0
    out[long] = filler | some & ~prose
    return out


class Hosts:
    """The boilerplate of the hosts of a batch: a number for each row's host, and the keys of each number."""

    def __init__(self, host: pa.Array, keys: pa.Array) -> None:
        d = pc.fill_null(host, "").dictionary_encode()
        self.of = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, first = np.unique(self.of, return_index=True)
        self.keys = [np.array(keys[int(i)].as_py() or (), dtype=np.int64) for i in first]

    def gone(self, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether each line (row number, key) is boilerplate of its row's host."""
        out = np.zeros(len(key), dtype=bool)
        at = self.of[doc]
        for h, known in enumerate(self.keys):
            if len(known):
                own = np.flatnonzero(at == h)
                out[own] = np.isin(key[own], known)
        return out


_WORDS4 = re.compile(r"[^\W\d_]{4,}")
#: A sentence of a story ends as one, or goes on after a sentence for more than the words of a link or poll.
_PROSE = r"""[.!?…。！？।؟]["”’')\]]*$|\pL{2}[.!?…]["”’')\]]*\s+\S+(?:\s+\S+){4,}$"""


def judge(texts: pa.Array, hosts: Hosts | None = None, titles: pa.Array | None = None) -> tuple[np.ndarray, list, np.ndarray]:
    """For each text: whether it is a case, the keys of the sentences that may be a notice by notices(), and whether
    none of them shares a word with the title. The keys are None for texts that cannot be one."""
    line, doc, _ = split_lines(texts)
    n = len(texts)
    keep = np.flatnonzero(_matches(line, r"[^\s\x{a0}\x{200b}]"))
    asks: list = [None] * n
    apart = np.zeros(n, dtype=bool)
    if not len(keep):
        return np.zeros(n, dtype=bool), asks, apart
    line, doc = line.take(pa.array(keep)), doc[keep]
    t = pc.utf8_trim(squeeze(line), " |*»")
    holder = _matches(t, r"[{}<>%#\[$@_(]|TK")
    if holder.any():
        holder[holder] = _matches(t.filter(pa.array(holder)), PLACEHOLDER)
        rest = pc.replace_substring_regex(t.filter(pa.array(holder)), f"(?i){_SAFE}", "")
        holder[holder] = _matches(rest, PLACEHOLDER)
    evident = evident_lines(t)
    words = _words(t)
    prose = ~evident & (words >= PROSE)
    some = np.flatnonzero(prose)
    if len(some):
        own = t.take(pa.array(some))
        prose[some] = _matches(own, _PROSE) & ~_matches(own, EDITORIAL)
        if hosts is not None:
            prose[some] &= ~hosts.gone(doc[some], line_keys(own))
    count = lambda m: np.bincount(doc[m], minlength=n)
    held, sure, told = count(holder) > 0, count(evident) > 0, count(prose)
    out = held | sure & (told == 0)
    maybe = ~out & (told > 0) & (told <= 2) & (count(prose & (words > NOTICE_WORDS)) == 0)
    rows = np.flatnonzero(prose & maybe[doc])
    said: dict[int, list[int]] = {}
    key = dict(zip(rows.tolist(), line_keys(t.take(pa.array(rows)), whole=True).tolist()))
    for k in key:
        said.setdefault(int(doc[k]), []).append(k)
    for d, ks in said.items():
        asks[d] = sorted({key[k] for k in ks})
        own = set(_WORDS4.findall(" ".join(t[k].as_py() for k in ks).lower()))
        apart[d] = titles is not None and own.isdisjoint(_WORDS4.findall((titles[d].as_py() or "").lower()))
    return out, asks, apart


def notices(asked: DataFrame) -> DataFrame:
    """key of the sentences that are notices by their counts. asked: asks, apart, title, host, a row for each field.

    Only fields of which one or two sentences are left ask, so that the counts are small; they are summed by key and title
    first, so that a sentence that a third of all rows share is no group of a task.
    """
    rows = asked.select(F.explode("asks").alias("key"), "title", "host", F.col("apart").cast("int").alias("apart"))
    some = rows.groupBy("key", "title", "host").agg(F.count("*").alias("n"), F.sum("apart").alias("apart"))
    one = some.groupBy("key", "title").agg(F.sum("n").alias("n"), F.sum("apart").alias("apart"))
    at = some.select("key", "host").distinct().groupBy("key").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= HOSTS)
    all_ = one.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("titles"), F.sum("apart").alias("apart"))
    all_ = all_.filter(
        (F.col("titles") >= PAGES) & (F.col("titles") >= TITLES * F.col("n")) & (F.col("apart") >= (1 - SHARED) * F.col("n"))
    )
    # copies of one story have words of their titles in common, whatever the titles
    said = F.explode(F.array_distinct(F.split(F.lower("title"), r"[^\p{L}]+"))).alias("w")
    word = one.join(all_.select("key"), "key").select("key", "n", said).filter(F.length("w") >= 4)
    most = word.groupBy("key", "w").agg(F.sum("n").alias("m")).groupBy("key").agg(F.max("m").alias("most"))
    return all_.join(at, "key").join(most, "key", "left").filter(F.coalesce("most", F.lit(0)) <= SHARED * F.col("n")).select("key")


def late(asked: DataFrame) -> DataFrame:
    """id, field_name of the fields all of whose sentences are notices. asked: a written table, see notices()."""
    own = asked.filter("asks is not null")
    known = stage(notices(own), "notices")
    rows = own.select("id", "field_name", F.size("asks").alias("n"), F.explode("asks").alias("key")).join(known, "key")
    return rows.groupBy("id", "field_name", "n").agg(F.count("*").alias("m")).filter("m >= n").select("id", "field_name")


def flags(texts: pa.Array, hosts: Hosts | None = None) -> np.ndarray:
    """Whether each text is a case by its own lines."""
    return judge(texts, hosts)[0]
