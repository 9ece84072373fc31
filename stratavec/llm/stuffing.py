"""Pages of repeated keywords, bare link lists or product tags instead of sentences.

The words of a page are looked at as a sequence, segment by segment: a segment is a passage (paragraph), or adjacent ones
that are short or low in function words, for blank lines may stand between repetitions.  Templates, headings, footnotes,
comments and redirects are left out of what can be spam, not out of the page's size.  Around each word, in a window of WINDOW words:

* positional autocorrelation: for each lag window (BAND lags up to LAG), the share of words that have an equal that far
  away; the highest of them is the window's *peak*.  Slots that are filled from few keywords show at a multiple of their
  period, which moves a little where keywords have one or two words;
* regularity of recurrence gaps: the share of words whose gap to the last equal is that to the next one, or that of the
  neighbouring word; there is no limit to the gap, so copies of long blocks show too;
* function words: their share, for prose of any of the known languages has many; and whether the word is in a sentence, for
  prose of other languages has these.

A word stands in stuffing if one of the two measures reaches a limit that is higher among function words and in sentences; or in
a run of bare links or tags; or in a long list of short entries without function words, all different or not.  Navigation,
tables, template remnants and lists whose entries are explained aren't such lists.  A page is flagged when more than half of its
white-space-separated words do.

All words of an Arrow batch are measured at once, on arrays of code points.  Lags are only tried in segments where enough
words have an equal within LAG words, which is an upper bound of every peak.

Defined results: null, empty and blank texts aren't flagged; a page's score doesn't depend on other pages, so copies
score alike; texts of any length are read whole, and time is linear in length, but for the sorting of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the corpus' languages.
FUNCTION_WORDS = frozenset(
    "the of a an and or to in on at by for from with as is was were be been it its that this which who how when than not no has had have but if so only their there more "
    "der die das den dem des und oder in im von zu mit auf für an am aus bei nach ist war wurde wird nicht ein eine einen einem auch als wo seit noch weder dann ob obwohl um rund "
    "le la les l un une des du de et ou dans par pour sur au aux en que qui ne ni si est fut était avec où après puis depuis entre mais "
    "el los las un una unos del y o en por para con sin que se su al lo como es fue era ni no si desde donde tras entre pero".split()
)
#: Longest lag, lags that are looked at together, words of a window, and what counts as few function words.
LAG, BAND, WINDOW, FUNCTION_SHARE = 48, 3, 24, 0.1
#: Limits of the peak and of the regularity where function words are few; and that of both in sentences, and in repeated
#: phrases that hold some function words ("bolsas de viaje"), up to which share of them.
PEAK, REGULAR, SENTENCE, PHRASE_FUNCTION_SHARE, PHRASE = 0.2, 0.4, 0.5, 0.35, 0.8
#: Words of a sentence at least, and what ends one before a blank.
SENTENCE_WORDS, ENDERS = 5, ".!?…。！？؟।"
#: A list of distinct entries: at least so many entries of at most so many words; and what must recur in one that has
#: neither links nor tags, for tables and navigation have short entries too.  One of DISTINCT_ENTRIES needs neither.
LIST_ENTRIES, ENTRY_WORDS, LIST_RECURRING, DISTINCT_ENTRIES = 8, 5, 0.12, 12
#: Characters that are measured at once; a longer text is measured by itself.
PART_CHARS = 1 << 20

_WORD = re.compile(r"[^\W_]+")
_GAP = re.compile(r"\n[ \t\r]*\n\s*")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>(?:(?!<ref\b).)*?</ref\s*>", re.S)
_HEADING = re.compile(r"^[ \t]*=+[^=\n]+=+[ \t]*$", re.M)
_REDIRECT = re.compile(r"\A\s*#[^\W\d_]+[ \t]*:?[ \t]*\[\[[^\n]*\]\]")
_BRACES = re.compile(r"\{{2,}|\}{2,}")
_URL = re.compile(r"(?:https?:)?//\S+|\bwww\.\S+")
#: A link or a tag.
_MARK = re.compile(r"(?:https?:)?//\S|\bwww\.\S|(?:^|\s)#[^\W\d_]")
_TAG_NAME = re.compile(r"</?[a-zA-Z][\w-]*")
_LINK_LINE = re.compile(r"\s*(?:[*#•-]+\s*|\d+[.)]\s*)?(?:\[?(?:https?:)?//\S+\]?)\s*\Z")
_ENTRY_SPLIT = re.compile(r"\s[•/|;–-]\s|[,;\n]|(?=#[^\W\d_])|\]\]\s*(?=\[\[)")
_DELIMITER = re.compile(r"\s[•/|;»–-]\s|[,;]\s")
_LIST_SPLIT = re.compile(r"\s[•·/|;»–-]\s|;\s|,(?!\d)|\n")
_EXPLAINED = re.compile(r"\w\S*\s+[–—-]\s+\w|\w\S*:\s+\S")
_LETTER = re.compile(r"[^\W\d_]")


def _blank(m: re.Match) -> str:
    """As many blanks as characters, line ends kept: offsets stay what they were."""
    return re.sub(r"[^\n]", " ", m.group())


def _without_templates(text: str) -> str:
    """Balanced templates of any depth blanked out, in one pass; what isn't closed stays."""
    open_: list[int] = []  # places of pairs of opening braces
    spans: list[tuple[int, int]] = []
    for m in _BRACES.finditer(text):
        if text[m.start()] == "{":
            open_.extend(range(m.start() + len(m.group()) % 2, m.end(), 2))
        else:
            for end in range(m.start() + 2, m.end() + 1, 2):
                if open_:
                    start = open_.pop()
                    while spans and spans[-1][0] > start:
                        spans.pop()
                    spans.append((start, end))
    out, at = [], 0
    for start, end in spans:
        out += [text[at:start], re.sub(r"[^\n]", " ", text[start:end])]
        at = end
    return "".join([*out, text[at:]])


def _without_markup(text: str) -> str:
    """Lower case; neutral parts and names of tags blanked out, place by place."""
    text = text.lower()
    if "<" in text:
        if "<!--" in text:
            text = _COMMENT.sub(_blank, text)
        if "<ref" in text:
            text = _REF.sub(_blank, text)
        text = _TAG_NAME.sub(_blank, text)
    if "=" in text:
        text = _HEADING.sub(_blank, text)
    if "#" in text and text.lstrip().startswith("#"):
        text = _REDIRECT.sub(_blank, text)
    return _without_templates(text) if "}}" in text else text


# ---------------------------------------------------------------- words as arrays


@cache
def _kinds() -> np.ndarray:
    """0 other, 1 part of a word, 2 white space, of each character of the basic plane."""
    return np.array([1 if c.isalnum() else 2 if c.isspace() else 0 for c in map(chr, range(1 << 16))], np.uint8)


def _kinds_of(points: np.ndarray) -> np.ndarray:
    out = _kinds()[points & 0xFFFF]
    for k in np.flatnonzero(points > 0xFFFF):
        out[k] = 1 if chr(points[k]).isalnum() else 0
    return out


_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(1 << 12, _FACTOR, np.uint64))


def _word_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words at [start, end) of the code points."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    owner = np.repeat(np.arange(len(start)), length)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    h = (points[np.repeat(start, length) + inside].astype(np.uint64) + np.uint64(1)) * _POWERS[inside % len(_POWERS)] ^ (inside // len(_POWERS)).astype(np.uint64)
    total = np.add.reduceat(h, np.cumsum(length) - length)
    return (total ^ total >> np.uint64(29)) * np.uint64(_FACTOR)


@cache
def _function_hashes() -> np.ndarray:
    words = sorted(FUNCTION_WORDS)
    points = np.array([ord(c) for w in words for c in w], np.uint32)
    length = np.array([len(w) for w in words])
    end = np.cumsum(length)
    return np.sort(_word_hashes(points, end - length, end))


def _gaps(codes: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, how far back and ahead its nearest equal in the segment is; 0 if there is none."""
    n = len(codes)
    order = np.lexsort((codes, segment))  # stable: equals stay in the order of their places
    same = (codes[order[1:]] == codes[order[:-1]]) & (segment[order[1:]] == segment[order[:-1]])
    step = np.diff(order)
    back, ahead = np.zeros(n, np.int64), np.zeros(n, np.int64)
    back[order[1:][same]] = step[same]
    ahead[order[:-1][same]] = step[same]
    return back, ahead


def regularity(back: np.ndarray, ahead: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Whether a word recurs evenly: the gap before it is the one behind it, or is that of a neighbour too."""
    out = (back == ahead) & (back > 0)
    inside = segment[1:] == segment[:-1]
    for gap in (back, ahead):
        pair = (gap[1:] == gap[:-1]) & (gap[1:] > 0) & inside
        out[1:] |= pair
        out[:-1] |= pair
    return out


def _in_sentences(points: np.ndarray, kind: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each word is one of SENTENCE_WORDS or more of a line that end with a full stop or the like."""
    ender = np.isin(points, np.array([ord(c) for c in ENDERS], np.uint32)) & np.r_[kind[1:] == 2, True]
    stops = np.flatnonzero(ender | (points == 10))
    unit = np.searchsorted(stops, start)
    closed = np.r_[ender[stops], False]
    return closed[unit] & (np.bincount(unit)[unit] >= SENTENCE_WORDS)


class _Windows:
    """Of each word, the window of WINDOW words around it that its segment has room for."""

    def __init__(self, segment: np.ndarray, width: int = WINDOW):
        n = len(segment)
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if n else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, n])
        begin, end = np.repeat(first, size), np.repeat(first + size, size)
        self.low = np.clip(np.arange(n) - width // 2, begin, np.maximum(begin, end - width))
        self.high = np.minimum(self.low + width, end)

    def share(self, flags: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(flags)]
        return (c[self.high] - c[self.low]) / (self.high - self.low)


def autocorrelation(codes: np.ndarray, segment: np.ndarray, lag: int = LAG, band: int = BAND) -> np.ndarray:
    """Of each word's window, the highest share of words that have an equal l to l + band - 1 words away, l <= lag."""
    n = len(codes)
    peak, windows = np.zeros(n), _Windows(segment)
    seen: list[np.ndarray] = []  # of the last ``band`` lags
    for step in range(1, min(lag, n - 1) + 1):
        equal = (codes[step:] == codes[:-step]) & (segment[step:] == segment[:-step])
        flags = np.zeros(n, bool)
        flags[step:] = equal
        flags[:-step] |= equal
        seen = [*seen[-band + 1 :], flags] if band > 1 else [flags]
        near = np.logical_or.reduce(seen)
        if near.any():
            np.maximum(peak, windows.share(near), out=peak)
    return peak


# ---------------------------------------------------------------- lists


def _lists_links(passage: str) -> bool:
    """A bare link list: most lines are nothing but a link, or short entries of links and tags without a sentence."""
    if not _MARK.search(passage):
        return False
    lines = [x for x in passage.split("\n") if x.strip()]
    if len(lines) >= 2 and sum(bool(_LINK_LINE.match(x)) for x in lines) > 0.6 * len(lines):
        return True
    entries = [e for e in _ENTRY_SPLIT.split(passage) if _WORD.search(e)]
    if len(entries) < LIST_ENTRIES or sum(len(_WORD.findall(_URL.sub(" ", e))) <= ENTRY_WORDS for e in entries) < 0.9 * len(entries):
        return False
    marked = sum(bool(_URL.search(e)) or e.lstrip().startswith("#") and len(e) > 1 for e in entries)
    return marked > 0.5 * len(entries)


def _is_table(passage: str) -> bool:
    return "||" in passage or passage.lstrip().startswith("{|")


def _short_entries(passage: str) -> bool:
    """Short entries between delimiters, outside of tables."""
    if _is_table(passage):
        return False
    entries = [e for e in _DELIMITER.split(passage) if _WORD.search(e)]
    return len(entries) >= LIST_ENTRIES and sum(len(_WORD.findall(e)) <= ENTRY_WORDS for e in entries) >= 0.9 * len(entries)


def _distinct_entries(passage: str) -> bool:
    """A long list of short entries that may be all different; no table, template, navigation or list with explanations."""
    if _is_table(passage) or "{{" in passage or "}}" in passage:
        return False
    entries = [e for e in _LIST_SPLIT.split(passage) if _WORD.search(e)]
    if len(entries) < DISTINCT_ENTRIES or sum(len(_WORD.findall(e)) <= ENTRY_WORDS for e in entries) < 0.9 * len(entries):
        return False
    lines = [x for x in passage.split("\n") if x.strip()]
    if sum(x.lstrip()[0] in "|!" for x in lines) > 0.5 * len(lines) or len(lines) >= LIST_ENTRIES and sum(bool(_EXPLAINED.search(x)) for x in lines) > 0.5 * len(lines):
        return False
    other = sum("[[" in e or "]]" in e or "=" in e or not _LETTER.search(e) for e in entries)
    return other <= 0.5 * len(entries)


def _runs(places: np.ndarray, joins: np.ndarray, doc: np.ndarray) -> Iterator[list[int]]:
    """Places of adjacent passages of a document that join; one alone is a run too."""
    run: list[int] = []
    for i in places.tolist():
        if run and (i != run[-1] + 1 or doc[i] != doc[run[-1]]):
            yield run
            run = []
        if joins[i]:
            run.append(i)
    if run:
        yield run


# ---------------------------------------------------------------- pages


def measure_pages(texts: list[str | None]) -> list[tuple[int, int, float, float, float]]:
    """Of each text (white-space-separated words, those in stuffing; and in the mean of the words in stuffing the peak of the
    autocorrelation, the regularity of gaps and the share of function words)."""
    totals = [len(t.split()) if t else 0 for t in texts]
    stuffed, measures = np.zeros(len(texts), np.int64), np.zeros((len(texts), 3))
    plain = [_without_markup(t) if t else "" for t in texts]
    whole = "\n\n".join(plain)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds_of(points)
    edges = np.flatnonzero(np.diff(np.r_[0, kind == 1, 0].astype(np.int8)))
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        return list(zip(totals, stuffed.tolist(), *measures.T.tolist()))
    codes = _word_hashes(points, start, end)
    known = _function_hashes()
    function = known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes

    # passages, and the document of each
    cuts = np.array([m.end() for m in _GAP.finditer(whole)], np.int64)
    ends_of_docs = np.cumsum([len(p) + 2 for p in plain])
    word_passage = np.searchsorted(cuts, start, "right")
    passages, passage = np.unique(word_passage, return_inverse=True)
    bounds = np.r_[0, cuts, len(whole)]
    span = [(int(bounds[p]), int(bounds[p + 1])) for p in passages]
    first_word = np.searchsorted(passage, np.arange(len(passages)))
    doc = np.searchsorted(ends_of_docs, start[first_word], "right")
    words = np.bincount(passage)
    share = np.bincount(passage, weights=function) / words
    low = share <= FUNCTION_SHARE
    of = lambda i: whole[span[i][0] : span[i][1]]
    small = low | (words < WINDOW)
    for i in np.flatnonzero(small):
        small[i] = not _is_table(of(i))
    joined = np.r_[False, small[1:] & small[:-1] & (doc[1:] == doc[:-1])]
    segment = (np.cumsum(~joined) - 1)[passage]

    back, ahead = _gaps(codes, segment)
    windows = _Windows(segment)
    function_share = windows.share(function)
    recurs = windows.share(((back > 0) & (back <= LAG)) | ((ahead > 0) & (ahead <= LAG)))
    few, some = function_share <= FUNCTION_SHARE, function_share <= PHRASE_FUNCTION_SHARE
    hopeful = np.bincount(segment, weights=(few & (recurs >= PEAK)) | (some & (recurs >= PHRASE)))[segment] > 0
    peak = np.zeros(len(codes))
    peak[hopeful] = autocorrelation(codes[hopeful], segment[hopeful])
    even = windows.share(regularity(back, ahead, segment))
    enough = np.bincount(segment)[segment] >= 6
    sentence = _in_sentences(points, kind, start)
    spam = enough & ((few & ((peak >= np.where(sentence, SENTENCE, PEAK)) | (even >= np.where(sentence, SENTENCE, REGULAR)))) | (some & ((peak >= PHRASE) | (even >= PHRASE))))

    # lists, which only passages low in function words can be
    at = np.flatnonzero(low & (words > np.bincount(passage, weights=function)))
    marked = np.bincount(passage, weights=spam) == words
    again = np.bincount(passage, weights=(back > 0) | (ahead > 0)) / words
    listed = np.zeros(len(passages), bool)
    for i in at:
        if not marked[i]:
            text = of(i)
            listed[i] = _lists_links(text) or _distinct_entries(text) or again[i] >= LIST_RECURRING and _short_entries(text)
    near = np.flatnonzero(small)
    for run in _runs(near, small, doc):
        if len(run) > 1 and not all(listed[i] or marked[i] for i in run):
            text = whole[span[run[0]][0] : span[run[-1]][1]]
            if 1 - np.average(share[run], weights=words[run]) < 1 - FUNCTION_SHARE:
                run = [i for i in run if low[i]]  # a short sentence between entries is none
                text = "\n".join(of(i) for i in run)
            if len(run) > 1 and _lists_links(text):
                for i in run:
                    listed[i] |= bool(_MARK.search(of(i)))
            if len(run) > 1 and _distinct_entries(text):
                for i in run:
                    listed[i] |= all(len(_WORD.findall(e)) <= ENTRY_WORDS and "[[" not in e for e in _LIST_SPLIT.split(of(i)))
    spam |= listed[passage]

    # white-space-separated words: one without a letter or digit goes with the one before it, in its passage
    begins = np.flatnonzero((kind != 2) & np.r_[True, kind[:-1] == 2])
    owner = np.searchsorted(begins, start, "right") - 1
    hit = np.zeros(len(begins), bool)
    hit[owner[spam]] = True
    has = np.zeros(len(begins), np.int64)
    has[owner] = 1
    token_passage = np.searchsorted(cuts, begins, "right")
    before = np.maximum.accumulate(np.where(has, np.arange(len(begins)), -1))
    after = np.minimum.accumulate(np.where(has, np.arange(len(begins)), len(begins))[::-1])[::-1]
    source = np.where((before >= 0) & (token_passage[before] == token_passage), before, np.minimum(after, len(begins) - 1))
    hit = hit[source] & (token_passage[source] == token_passage)
    token_doc = np.searchsorted(ends_of_docs, begins, "right")
    stuffed[:] = np.bincount(token_doc, weights=hit, minlength=len(texts))
    in_doc = doc[passage]
    count = np.maximum(1, np.bincount(in_doc, weights=spam, minlength=len(texts)))
    for k, value in enumerate((peak, even, function_share)):
        measures[:, k] = np.bincount(in_doc, weights=value * spam, minlength=len(texts)) / count
    return list(zip(totals, stuffed.tolist(), *measures.T.tolist()))


def measure(text: str | None) -> tuple[int, int, float, float, float]:
    """measure_pages of one text."""
    return measure_pages([text])[0]


def score_pages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, stuffed_words, share, autocorrelation, regular_gaps, function_share) of every page; one narrow pass."""
    kind = documents.schema[doc_id].dataType.simpleString()
    names = [doc_id, "words", "stuffed_words", "share", "autocorrelation", "regular_gaps", "function_share"]

    def parts(texts: list[str | None]) -> Iterator[list[str | None]]:
        part, size = [], 0
        for t in texts:
            if part and size + len(t or "") > PART_CHARS:
                yield part
                part, size = [], 0
            part.append(t)
            size += len(t or "")
        yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for part in parts(batch.column(1).to_pylist()) for r in measure_pages(part)]
            words, stuffed, *measures = (list(c) for c in zip(*rows)) if rows else [[]] * 5
            share = [s / w if w else 0.0 for s, w in zip(stuffed, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(stuffed, pa.int64()), *(pa.array(c, pa.float64()) for c in (share, *measures))], names=names)

    doubles = ", ".join(f"{c} double" for c in names[3:])
    return documents.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, words long, stuffed_words long, {doubles}")


def stuffed_pages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", over: float = 0.5) -> DataFrame:
    """The scores of the pages whose share is over ``over``."""
    return score_pages(documents, doc_id, text).where(F.col("share") > over)
