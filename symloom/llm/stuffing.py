"""Problem 8: pages of stuffed keywords, link lists or product tags.

Method: a page is cut into stretches. In each stretch of words the places of every term are looked at: the
gaps at which it comes again, how regular these gaps are, and the autocorrelation of the places within
windows of lags, as far as it lies above what the terms' frequencies alone would give. Prose repeats words
at irregular, wide gaps; stuffed text at short and regular ones. The second sign is a list of many different
terms that almost no function word joins. Links and tags are judged by their form. A page is a case if most
of its characters stand in such stretches. No list of selling words and no list of host endings is used.

Defined results: null and empty texts are no cases; each doc_id gives at most one row; rows with the
same text have the same result; tables, logs, code and index rows are honest whatever they repeat.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from symloom.llm import common

#: Most of the text: the share of characters in spam stretches from which a page is a case.
MOST = 0.5
#: A term that comes again within so many terms comes again soon.
NEAR = 8
#: The share of terms that come again soon in stuffed text, and the least regularity or autocorrelation with it.
AGAIN, REGULAR, PEAK = 0.32, 0.1, 0.02
#: Windows of so many lags are looked at together.
WINDOW = 3
#: Least terms of a stretch that is judged, least items of a list, and its share of function words at most.
LEAST, ITEMS, FEW = 8, 6, 0.2
#: Terms from which words with few function words are a list, though nothing separates its items.
LONG = 20
#: Most words of a sentence; what runs on for longer is none.
LONGEST = 60
#: A line of so many characters that no stop ends may go on in the next.
WRAP = 48
#: Stands for an empty line in a stretch.
_BREAK = "\0"

# Frequent function words of the languages met.
FUNCTION = frozenset(
    (
        "the a an of to and in is it when with by as at from that this be are not no its if before after while until because or on for "
        "der die das und ist nicht den des dem ein eine wenn mit nach vor zu sie "
        "le la les et est un une dans pas pour que qui avant sans du au "
        "el los las y que en se una con por del al antes sin "
        "o os e um uma do da com para antes sem na no "
        "het een en van niet wordt zodra met voor zonder "
        "i w z na nie po jest przed bez gdy się tylko oraz jeśli każdy "
        "ve bir bu için olarak ile her sonra önce "
        "и в на не с по из для без как если при это затем"
    ).split()
)
_WORD = re.compile(r"[^\W\d_]+")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿]")
#: The spaced-out and bracketed ways to write the dot of a host.
_DOT = r" ?(?:\[dot\]|\(dot\)| dot ) ?"
_LINK = re.compile(rf"<a\s[^>]*>[^<]*</a>|\[[^\]\n]*\]\(\S+?\)|(?:https?://|www\.)\S+|\b[\w-]{{1,63}}(?:\.[\w-]{{1,63}}){{0,8}}\.([a-z]{{2,24}})\b(?:/\S*)?|\b[\w-]{{1,63}}{_DOT}[a-z]{{2,24}}\b", re.I)
_HOST = re.compile(r"\.[A-Za-z]")
#: Product tags: hash tags, article numbers, names with a price, words joined by hyphens.
_TAG = re.compile(r"#[^\W_]\w*|\b[A-Z][A-Z ]*\b[A-Z]{2,5}-\d+|\b[A-Z]{2,5}-\d+|(?:[a-z]+ ){0,3}[$€£¥]\d+(?:\.\d\d)?|\b(?:[a-z]{1,12} )?[a-z]{1,40}\d{0,9}(?:-[a-z]{1,40}){1,9}\b")
_SOLD = re.compile(r"#\w|\b[A-Z]{2,5}-\d{3}|[$€£¥]\d")
_DATE = re.compile(r"\d{4}-\d\d-\d\d")
_BULLET = re.compile(r"^(?:[>*•-] )+")
_CELLS = re.compile(r"\t| {2,}")
#: Characters of the cells of a table on the average, and of a row of another form, at most.
CELL, ROW = 60, 400
_KEY = re.compile(r"\b[CM]-\w\b")
_NAME = re.compile(r"\S*\w_\w\S*|--\w\S*|`[^`]*`|[\w/-]+\.[A-Za-z]\w*")
_STOP = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])")
_SEPARATOR = re.compile(r"\s*(?:[,;|/•·»→*–—]|\s-\s|\.\s|!\s|\n)\s*")


@lru_cache(maxsize=1)
def _endings() -> frozenset[str]:
    """Endings of file names, which are no hosts: those of the registered languages and of common texts."""
    from symloom.operators.languages import REGISTRY

    return frozenset(e.lower() for s in REGISTRY.specs.values() for e in s.extensions) | frozenset("txt tags html htm log cfg conf csv ini bak tmp".split())


def links_of(s: str) -> list[re.Match]:
    """Links in a line; a name with the ending of a source file is none."""
    if not ("." in s and _HOST.search(s) or "://" in s or "](" in s or "<a" in s or "dot" in s):
        return []
    return [m for m in _LINK.finditer(s) if m.group(1) is None or m.group(1).lower() not in _endings() and "_" not in m.group().split("/")[0]]


def autocorrelation(ids: np.ndarray) -> np.ndarray:
    """For each lag the number of places that hold the same term as the place so many terms before. Exact.

    Terms with few places are paired; those with more than the root of the length go over a Fourier transform.
    """
    n = len(ids)
    out = np.zeros(n, np.int64)
    order = np.argsort(ids, kind="stable")
    term = ids[order]
    most = max(32, int(n**0.5))
    count = np.bincount(ids)
    rare = count[term] <= most
    pos, term_ = order[rare], term[rare]
    for k in range(1, min(most, len(pos))):
        same = term_[k:] == term_[:-k]
        if not same.any():
            break
        out += np.bincount((pos[k:] - pos[:-k])[same], minlength=n)
    often = np.flatnonzero(count > most)
    if len(often):
        size = 1 << (2 * n - 1).bit_length()
        power = np.zeros(size // 2 + 1)
        for i in often:
            power += np.abs(np.fft.rfft(ids == i, size)) ** 2
        out += np.rint(np.fft.irfft(power, size)[:n]).astype(np.int64)
    out[0] = 0
    return out


def gaps(ids: np.ndarray) -> tuple[float, float, float]:
    """Of a sequence of terms: the share that comes again within ``NEAR`` terms, the share that comes again at
    all, and the share of places whose term comes three times or more at regular gaps.

    Gaps are regular if they vary by less than half of their mean; those of a term strewn at random vary by
    about the mean itself.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    term = ids[order]
    same = term[1:] == term[:-1]
    g = (order[1:] - order[:-1])[same]
    if not len(g):
        return 0.0, 0.0, 0.0
    of = term[1:][same]
    k = np.bincount(of).astype(float)
    mean = np.bincount(of, g) / np.maximum(k, 1)
    var = np.bincount(of, g.astype(float) ** 2) / np.maximum(k, 1) - mean**2
    regular = (k >= 2) & (var <= 0.25 * mean**2)
    return float((g <= NEAR).sum() / n), len(g) / n, float((k[regular] + 1).sum() / n)


def peak(ids: np.ndarray) -> float:
    """The highest mean autocorrelation of a window of ``WINDOW`` lags, less what the frequencies alone give.

    Lags go up to the length, as far as the terms after them are ``LEAST`` or more and can be ``AGAIN`` of all.
    """
    n = len(ids)
    lags = n - max(LEAST, int(AGAIN * n))
    if lags < WINDOW:
        return 0.0
    rate = autocorrelation(ids)[1 : lags + 1] / (n - np.arange(1, lags + 1))
    sums = np.cumsum(np.concatenate([[0.0], rate]))
    p = np.bincount(ids) / n
    return float((sums[WINDOW:] - sums[:-WINDOW]).max() / WINDOW - (p**2).sum())


def soon(ids: np.ndarray) -> bool:
    """Whether terms come again too soon and too regularly for prose, closed as sentences or not."""
    near, _, regular = gaps(ids)
    return near >= AGAIN and (regular >= REGULAR or peak(ids) >= PEAK)


def in_turn(ids: np.ndarray) -> bool:
    """Whether a list of terms comes round at a long period, which the lags tell."""
    return gaps(ids)[1] >= AGAIN and peak(ids) >= AGAIN / 2


class Stretch:
    """Words between links, tags, rows of other forms and plain prose: judged together."""

    def __init__(self) -> None:
        self.size = self.n = 0
        self.index: dict[str, int] = {}
        self.ids: list[int] = []
        self.parts: list[str] = []

    def add(self, part: str, words: list[str]) -> None:
        self.size += len(part)
        self.n += len(words)
        self.ids += [self.index.setdefault(w, len(self.index)) for w in words if w not in FUNCTION]
        self.parts.append(part)

    def spam(self) -> int:
        """The characters of the stretch if it is stuffed or a bare list of terms, else 0."""
        content = len(self.ids)
        if content < LEAST:
            return 0
        ids = np.array(self.ids)
        if soon(ids):
            return self.size
        # Sentences may be wrapped over the lines of a paragraph.
        paragraphs = " ".join(self.parts).split(_BREAK)
        sentences = [x.strip() for p in paragraphs for x in _STOP.split(p) if x.strip()]
        if sum(len(x) for x in sentences if _sentence(x, _WORD.findall(x.lower()))) * 2 >= self.size:
            return 0
        if in_turn(ids):
            return self.size
        if 1 - content / self.n > FEW:
            return 0
        if content >= LONG and len(self.index) * 2 >= LONG:
            return self.size
        items = sum(1 for p in self.parts for x in _SEPARATOR.split(p) if x.strip())
        return self.size if items >= ITEMS and content <= 5 * items else 0


def _sentence(part: str, w: list[str]) -> bool:
    """Closed like a sentence, long enough for one, and no row of separated items."""
    items = len(_SEPARATOR.findall(part))
    if len(_DENSE.findall(part)) > 10:
        return (items + part.count(" ")) * 8 < len(part)
    return part[-1] in ".?:" and 5 <= len(w) <= LONGEST and items * 3 <= len(w)


def _prose(part: str, w: list[str]) -> bool:
    """A sentence that function words join and whose other words hardly come again."""
    dense = len(_DENSE.findall(part))
    if dense > 10:
        return part[-1] in "。？" and len(w) * 6 <= dense
    f = sum(x in FUNCTION for x in w)
    if len(w) < 6 or f < 0.25 * len(w):
        return False
    content = len(w) - f
    return len({x for x in w if x not in FUNCTION}) * 10 >= content * 7


def _structured(line: str, s: str) -> bool:
    """Forms of rows that are no text: tables, leaders, logs, commands, code, key names, option names.

    ``s`` is the line without blanks at its ends.
    """
    if ("\t" in s or "  " in s) and len(s) <= CELL * len(_CELLS.split(s)):
        return True
    if len(s) <= ROW:
        if line.startswith("    ") or "...." in s or s[-1] in "{}" or s[-2:] == ");" or s.startswith(("$ ", "```")):
            return True
        if s[0] == "|" and s[-1] == "|" or s[0].isdigit() and _DATE.match(s) or "-" in s and _KEY.search(s):
            return True
    named = "_" in s or "`" in s or "--" in s or "." in s and _HOST.search(s)  # hosts were taken before
    return named and sum(len(m.group()) for m in _NAME.finditer(s)) * 2 >= len(s)


def _plain(w: list[str]) -> bool:
    """Words of a line that is prose throughout: function words join them, and hardly one comes again soon."""
    content = [x for x in w if x not in FUNCTION]
    if len(w) < 6 or len(content) > 0.72 * len(w):
        return False
    last: dict[str, int] = {}
    soon = 0
    for i, x in enumerate(content):
        soon += last.get(x, -NEAR - 1) >= i - NEAR
        last[x] = i
    return soon <= AGAIN / 2 * len(content)


def _described(rest: str) -> bool:
    """Text beside a link that describes it: a sentence, not a phrase."""
    dense = len(_DENSE.findall(rest))
    if dense:
        return dense >= 8
    w = _WORD.findall(rest.lower())
    return len(w) >= 5 and (rest.rstrip()[-1:] in ".!?" or sum(x in FUNCTION for x in w) >= 2)


def _unwrapped(lines: list[str]) -> list[str]:
    """Lines of a paragraph that break off within a sentence joined with those that follow."""
    out: list[str] = []
    broken = False
    for x in lines:
        x = _BULLET.sub("", x, count=1) if x[:1] in ">*•-" else x
        if broken:
            out[-1] += " " + x
        else:
            out.append(x)
        broken = len(x) >= WRAP and x[-1] not in ".!?:。！？"
    return out


def spam_share(text: str) -> float:
    """The share of the text's characters that stand in keyword, link or tag stretches."""
    total = spam = 0
    held = Stretch()
    run: list[str] = []

    def flush() -> None:
        """The lines of a paragraph go to the stretch; plain prose ends it."""
        nonlocal spam
        for s in _unwrapped(run) if run else ():
            if _plain(_WORD.findall(s.lower())):
                spam += close()
                continue
            for part in filter(None, _STOP.split(s)):
                w = _WORD.findall(part.lower())
                if _prose(part, w):
                    spam += close()
                elif w:
                    held.add(part, w)
        run.clear()

    def close() -> int:
        nonlocal held
        got = held.spam() if held.n else 0
        held = Stretch()
        return got

    for line in text.split("\n"):
        s = line.strip()
        if not s:
            flush()
            if held.n:
                held.parts.append(_BREAK)
            continue
        total += len(s)
        if links := links_of(s):
            flush()
            spam += close()
            rest = s
            for m in reversed(links):
                rest = f"{rest[: m.start()]} {rest[m.end() :]}"
            if len(links) == 1 and _described(rest):
                continue
            # Prose beside the links of one line is no link text.
            prose = sum(len(x) for x in _STOP.split(rest) if _described(x)) if len(rest) > 60 else 0
            spam += len(s) - prose
            continue
        if ("#" in s or "$" in s or "€" in s or "£" in s or "¥" in s or "-" in s) and _SOLD.search(s):
            if sum(len(m.group()) for m in _TAG.finditer(s)) * 2 >= len(s):
                flush()
                spam += close() + len(s)
                continue
        elif _structured(line, s):
            flush()
            spam += close()
            continue
        elif "-" in s and _TAG.fullmatch(s):
            spam += len(s)
            continue
        run.append(s)
    flush()
    spam += close()
    return spam / total if total else 0.0


def is_spam(text: str | None) -> bool:
    return bool(text) and spam_share(text) > MOST


def spam_pages(documents: DataFrame) -> DataFrame:
    """``doc_id`` of each page most of whose text is search phrases, links or product tags. One narrow pass."""

    def make():
        def f(doc_id, text):
            if is_spam(text):
                yield (doc_id,)

        return f

    rows = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    return common.map_rows(rows, "doc_id long", make, scan=True).distinct()
