"""Flat text blocks: every line of a page as a block with features of its own and of its neighbours.

A page is cut at line ends. A block's features are its word count, its link density, the same of the blocks before and
after it, whether it ends a sentence, its list marker, and whether it stands in a run of lines below a heading of links.
All of them are computed over whole Arrow arrays, not line by line.

Link density is the share of a block's words that are in links. Stored texts have no markup, so links are told by their
wording: the fixed phrases below are what pages link, prompt with or put under every story, in general English. A phrase
counts with the words that it covers, so that a menu has density 1, a comment with its reply link some 0.2, and a
sentence that only mentions cookies or a home page 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Phrases of links, prompts and notices, as patterns for RE2 (linear time); not of any one site.
_SECTION = (
    r"(?:home|world|business|events|jobs|local|health|fraud|schools?|reports?|opinion|archive|about(?: us)?|contact(?: us)?|"
    r"video|podcasts?|threats|policy|directory|tools|premium|news|politics|sports?|tech(?:nology)?|science|culture|travel|"
    r"weather|markets|money|lifestyle|entertainment|education|research|alerts|topics|sections|subscribe|search|menu|login|"
    r"log in|sign in|register|newsletters?|advertise|careers|help|faq|sitemap|rss|privacy|terms|imprint|magazine|photos?|"
    r"live|latest|trending|more|services|advisories|analysis|features|interviews?|editorial|community|shop|partners)"
)
NAV = rf"(?i)^\W*{_SECTION}(?:(?:\s*[>|·•,/»:-]\s*|\s{{2,}}|\s+){_SECTION})*\W*$"
CRUMB = r"(?i)^\W*(?:home|start|front page|index|you are here:?)\s*(?:[>/»›|]|::)\s*\S.*"
BYLINE = (
    r"(?i)^\W*(?:(?:by|words|text|story|report|written by|reported by|posted by|author|edited by|compiled by)\b:? +"
    r"[^\s.,]+ +[^\s.,]+(?: [^\s.,]+)?(?:(?:,| for| \||  )[^.]*)?|[^\s,.|]+ [^\s,.|]+(?:, (?:staff|senior|chief|crime|security|"
    r"business)? ?(?:writer|reporter|correspondent|editor)| \| [^|.]+))[^\w.!?]*$"
)
PROMPT = (
    r"(?i)^\W*(?:search (?:this|the|our) |skip to |jump to the |accessibility |log ?in to |sign in to |download (?:our|the) app|"
    r"back to (?:the )?top|get (?:the|our) .*(?:newsletter|app|alerts)|sign up\b|subscribe\b|join our|follow us|share(?: (?:this|on|via|with|the (?:story|article))\b|:|\W*$)|"
    r"tell a friend|print this|e-?mail this|save for later|enjoying this|like what you read|did you like|support .* from \d|"
    r"have you seen .* tell |do you know more|poll:|vote:|quiz:|free guide|webinar:|event:|upcoming event|register now|"
    r"advert|- ?sponsored|sponsored|promoted|promotion|paid post|(?:story|article) continues|continue reading|"
    r"click here|read (?:more|also|next|on)\b|see also|previous (?:story|article)|next(?: (?:story|article|up))?:|up next|"
    r"filed under|posted in|tags?:|tagged|topics?:|keywords?:|categor(?:y|ies):|in this section|\d+ (?:comments?|shares?|replies)|"
    r"leave a (?:comment|reply)|comments?\W*$|rate this|report this|menu\W*$|close\W*$|loading\W*$|play video|photo:|image:)"
)
LEGAL = (
    r"(?i)(?:^\W*(?:©|\(c\)|copyright\b|all rights reserved|terms (?:of|and)|privacy policy|the material on |"
    r"your privacy choices|cookies? (?:help|policy|notice|settings)|contact [^.]*@|published by)|\ball rights reserved|"
    r"\bcookies\b.{0,40}\b(?:accept|agree|settings|choices|measure|consent)|\buse of cookies|\baccept all\b|\bmanage choices|"
    r"\bstore data on your device|\bremembers your visit|\bnot responsible for the content|\bmay not be (?:republished|reproduced)|"
    r" - terms - |\bsend corrections to\b|\bcorrections to \S+@|\bhome page\W*$|\btell the .{2,60} desk\W*$|"
    r"\bpass it on\. \d|\byour inbox\b|\bregister now\W*$|\bcopy link\W*$|\breply\W+report\W*$|\bwhole or in part\b)"
)
EDITORIAL = (
    r"(?i)^\W*(?:figures in this (?:story|article|report)|reporting pooled|additional reporting|this (?:item|story|article|report|piece) "
    r"(?:first|was|has been|originally|is part|appeared)|part of (?:the|our|a) .* series|corrected after|an earlier version|"
    r"editor'?s note|updated (?:to|after|on|at)\b|clarification:|first published|translated from|with (?:files|material) from)"
)
COMMENT = r"(?i)^\W*\S+(?: \S+){0,3},? (?:\d+|an?|one|two|three) (?:minutes?|hours?|days?|weeks?|months?) ago\b"
# A whole sentence and then an invitation; after half a sentence it only marks where a story was cut.
TEASER_END = (
    r"(?i)[.!?…][\"”’')\]]*\s+(?:\[(?:continue|more|read more|read on)\]|\.\.\. ?more|…\s*more|read more|full story ?>?|"
    r"read on ?>?|continue reading)\W*$"
)
WIDGET = r"(?i)(?:-?\d+ ?°[CF]\b|\bindex -?\d+[.,]\d+\W*$|^\W*(?:yes \d+%|no vote))"
HEADING = (
    r"(?i)^\W*(?:in other news|related (?:coverage|stories|articles|posts|news)|you may (?:also )?like|you might (?:also )?like|"
    r"most (?:read|popular|viewed|shared)|more (?:from|stories|news|on|in)\b.{0,60}|also (?:on|in) .{0,40}|editors?'? picks?|"
    r"trending(?: now)?|latest (?:news|stories|headlines)|recommended(?: for you)?|elsewhere(?: on .*)?|from our partners|"
    r"don'?t miss|what (?:others|people) (?:read|are reading)|readers also (?:read|liked))\W*$"
)
#: What is taken for links.
PHRASES = (NAV, CRUMB, BYLINE, HEADING, PROMPT, LEGAL, EDITORIAL, COMMENT, TEASER_END, WIDGET)
#: Words that a line of a run has at most; word counts above MANY_WORDS are alike for the tree.
RUN_WORDS, MANY_WORDS = 16, 12
#: Name of each feature, in the order of the columns.
FEATURES = (
    "words", "link_density", "words_before", "words_after", "link_before", "link_after", "ends_sentence", "marker", "in_run",
)


@dataclass
class Blocks:
    """The lines of a batch of pages."""

    line: pa.Array  # as they stand
    doc: np.ndarray  # position of the page in the batch
    no: np.ndarray  # line number from 1
    full: np.ndarray  # whether the line has a visible sign
    x: np.ndarray  # features of the non-blank lines, in order


def _hit(a: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(a, pattern).to_numpy(zero_copy_only=False)


def squeeze(a: pa.Array) -> pa.Array:
    """Runs of white space as one blank; only lines that have any are rewritten."""
    odd = pc.match_substring_regex(a, r"\s\s|[\t\r\f\v]")
    if not pc.any(odd).as_py():
        return a
    return pc.replace_with_mask(a, odd, pc.replace_substring_regex(a.filter(odd), r"\s+", " "))


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lines, page and line number. Null texts have no lines."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), count)
    start = np.repeat(np.cumsum(count) - count, count)
    return pc.list_flatten(lists), doc, np.arange(len(doc)) - start + 1


def _shift(v: np.ndarray, doc: np.ndarray, by: int, edge: float) -> np.ndarray:
    """The value of the line before (1) or after (-1) on the same page."""
    out = np.full(len(v), edge, dtype=float)
    if len(v) > 1:
        if by > 0:
            same = doc[1:] == doc[:-1]
            out[1:][same] = v[:-1][same]
        else:
            same = doc[:-1] == doc[1:]
            out[:-1][same] = v[1:][same]
    return out


def blocks(texts: pa.Array) -> Blocks:
    """Splits and describes pages."""
    line, doc, no = split_lines(texts)
    t = pc.utf8_trim(line, " \t\r\u00a0|*\u00bb\u200b")
    t = pc.utf8_trim(pc.replace_substring_regex(t, r"[ \t ]+(\. *)?$|^[. ]+", ""), " ")
    full = _hit(line, r"[^\s\x{a0}\x{200b}]")
    keep = np.flatnonzero(full)
    raw, t, d = line.take(pa.array(keep)), t.take(pa.array(keep)), doc[keep]
    wide = pc.replace_substring_regex(t, r" {2,}", "  ")
    t = squeeze(t)
    n = len(keep)
    if n == 0:
        return Blocks(line, doc, no, full, np.zeros((0, len(FEATURES))))
    count = lambda a: pc.count_substring_regex(a, r"\S+").to_numpy(zero_copy_only=False).astype(float)
    words = np.maximum(count(t), 1.0)
    linked = np.zeros(n)
    for p in PHRASES:  # the words that a phrase covers, by the phrase that covers most
        hit = _hit(wide if p is NAV else t, p)
        if hit.any():
            some = t.filter(pa.array(hit))
            left = count(pc.replace_substring_regex(wide.filter(pa.array(hit)) if p is NAV else some, p, " "))
            linked[hit] = np.maximum(linked[hit], words[hit] - left)
    link = np.where(linked > 0, np.maximum(linked, 0.5), 0.0) / words
    heading = _hit(t, HEADING)
    ends = _hit(t, r"[.!?…][\"”’')\]]*$")
    marker = np.where(_hit(raw, r"^\s*(?:•|\d+[.)] )"), 2.0, np.where(_hit(raw, r"^\s*[-*–] "), 1.0, 0.0))
    own = words - (marker == 2)
    # a run lasts from its heading to the next sentence, list item of a story, long line or line with links of its own
    first = np.r_[True, d[1:] != d[:-1]]
    prose = (link == 0) & ((ends & (words >= 7)) | (own > RUN_WORDS))
    at = np.arange(n)
    opened = np.maximum.accumulate(np.where(heading, at, -1))
    broken = np.maximum.accumulate(np.where(first | prose | (marker == 1) | (link > 0) & ~heading, at, -1))
    run = (opened >= 0) & (opened >= broken) & ~heading
    some = np.minimum(own, MANY_WORDS)
    x = np.column_stack([
        some, link, _shift(some, d, 1, 0), _shift(some, d, -1, 0), _shift(link, d, 1, 1), _shift(link, d, -1, 1), ends, marker, run,
    ])
    return Blocks(line, doc, no, full, x)
