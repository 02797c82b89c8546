"""Problem 4: natural language in comments and string literals.

Method: comments and strings are taken by one regular expression per family of delimiters, adjacent
comment lines merged, split into sentences, and each sentence classified by the distance between its
ranked n-grams and the profile of each language, with rejection.

The profiles are fitted on a bounded sample (``SAMPLE_DOCS`` texts a language) of labelled documents;
texts that lie nearer to another language's profile than to their label's are dropped and the profiles
fitted again, as some labels are wrong.

Defined results: null or empty contents give no rows; a file read twice counts once; a sentence too far
from every profile has no language; characters are those of the file as read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm import common
from symloom.llm.docpairs import unescape

#: The languages asked for.
LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "pl", "ru", "tr", "ja", "zh")
SAMPLE_DOCS, SAMPLE_CHARS, PROFILE = 100, 1500, 600
MIN_WORDS, MIN_DENSE = 5, 10
#: Languages whose distances differ by less than this share are told apart by the rest of the file.
CLOSE = 0.1

_DENSE = re.compile(r"[぀-ヿ㐀-鿿]")
_KANA = re.compile(r"[぀-ヿ]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?](?=\s|$)|[。！？]")
# Lines that are tags or holders, not text.
_TAGS = re.compile(r"^.*(?:spdx-license-identifier|copyright\b|©|\(c\)\s*\d|-\*-).*$|^\s*(?:licen[cs]e|terms)\s*:.*$|^.*https?://\S+\s*>?\s*$", re.I | re.M)
_CODE_LINE = re.compile(
    r"^\s*(?:oneway\s+)?[\w.]+(?:\s*<.*>)?\s+\w+\s*\(.*\).*[,;]?\s*$|^\s*\d+\s*:\s*\w+|[{};]\s*$|^\s*[('`]+\s*[\w-]+(?:\s|\))|^\s*\"(?:[^\"\\]|\\.)*\"\s*\)*\s*$|\)\)\s*$|^\s*(?:namespace|include|const|struct|typedef|enum)\s+\w"
)
_IDENT = re.compile(r"\w*[_/\\]\w*|[a-z]+[A-Z]\w*|<[^>\s]*>|`[^`]*`|%\w|@\w+|\w+(?:-\w+){2,}|\S+\(\)")


def ngrams(text: str) -> list[str]:
    """The 1- to 3-grams of the words of ``text``, most frequent first, ties in order of the text."""
    c: Counter[str] = Counter()
    for w, n in Counter(_LETTERS.findall(text.lower())).items():
        for g in _of_word(w):
            c[g] += n
    return [g for g, _ in c.most_common()]


def _of_word(w: str) -> list[str]:
    p = f"_{w}_"
    return [*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))]


class Profiles:
    """Ranked n-gram profiles of several languages, and the nearest of them."""

    def __init__(self, texts: Iterable[tuple[str, str]], limit: float | None = None) -> None:
        pairs = [(lang, t) for lang, t in texts if lang in LANGUAGES and t]
        self._fit(pairs)
        kept = [(lang, t) for lang, t in pairs if self.nearest(t)[0][0] == lang]
        self._fit(kept)
        if limit is None:
            d = [self.nearest(s)[0][1] for _, t in kept for s, _ in sentences(t)]
            limit = float(np.quantile(d, 0.995)) * 1.08 if d else 1.0
        self.limit = limit

    def _fit(self, pairs: list[tuple[str, str]]) -> None:
        by: dict[str, list[str]] = {}
        for lang, t in pairs:
            by.setdefault(lang, []).append(t)
        self.langs = [x for x in LANGUAGES if x in by]
        tops = [ngrams("\n".join(by[x]))[:PROFILE] for x in self.langs]
        self.index = {g: i for i, g in enumerate(sorted({g for t in tops for g in t}))}
        self.rank = np.full((len(self.index), max(1, len(self.langs))), PROFILE, np.int32)
        for k, t in enumerate(tops):
            for r, g in enumerate(t):
                self.rank[self.index[g], k] = r
        self.words: dict[str, tuple[list[int], int]] = {}

    def _word(self, w: str) -> tuple[list[int], int]:
        """Known n-grams of a word and the number of the others; words come again and again, so they are kept."""
        if (got := self.words.get(w)) is None:
            if len(self.words) > 200_000:
                self.words.clear()
            g = _of_word(w)
            known = [i for x in g if (i := self.index.get(x)) is not None]
            got = self.words[w] = (known, len(g) - len(known))
        return got

    def nearest(self, text: str) -> list[tuple[str, float]]:
        """Languages by distance per n-gram, as a share of the largest distance possible; nearest first."""
        known: list[int] = []
        strange = 0
        for w in _LETTERS.findall(text.lower()):
            k, n = self._word(w)
            known += k
            strange += n
        if not known or not self.langs:
            return [("", 1.0)]
        # Counter keeps the order of the text for ties, as the ranks need it.
        top = [i for i, _ in Counter(known).most_common(PROFILE)]
        rank = self.rank[top]
        d = np.abs(rank - np.arange(len(top), dtype=np.int32)[:, None])
        d[rank == PROFILE] = PROFILE
        total = (d.sum(0) + strange * PROFILE) / ((len(top) + strange) * PROFILE)
        order = np.argsort(total, kind="stable")[:3]
        return [(self.langs[k], float(total[k])) for k in order]

    def languages(self, sentence: str) -> tuple[str, ...]:
        """The nearest language first, then those almost as near; empty if all are too far or the script does not fit."""
        near = [(lang, d) for lang, d in self.nearest(sentence) if lang and d <= self.limit]
        if not near:
            return ()
        if _KANA.search(sentence):
            return ("ja",)
        dense, cyrillic = bool(_DENSE.search(sentence)), bool(_CYRILLIC.search(sentence))
        fits = [lang for lang, d in near if d <= near[0][1] * (1 + CLOSE) and (lang == "ru") == cyrillic and (lang in ("ja", "zh")) == dense]
        return tuple(fits)


def sentences(text: str) -> Iterator[tuple[str, int]]:
    """Whole sentences of a text: the sentence in one line, and its characters without blanks at the ends."""
    pos = 0
    for m in _STOP.finditer(text):
        s = text[pos : m.end()]
        pos = m.end()
        flat = " ".join(s.split())
        dense = len(_DENSE.findall(flat))
        if dense * 2 > len(_LETTERS.sub("", flat)) and dense >= MIN_DENSE or len(_WORD.findall(_IDENT.sub(" ", flat))) >= MIN_WORDS:
            yield flat, len(s.strip())


_QUOTED = re.compile(r'\\(["\'\\ntr])')
_PLAIN = {"n": "\n", "t": "\t", "r": "\r"}


def texts_of(contents: str, kind: str) -> Iterator[str]:
    """Texts of a file that may hold sentences: comment blocks without code and tags, and string values."""
    for _, _, block, _ in common.comments(contents, kind):
        if len(block) < MIN_DENSE:
            continue
        block = _TAGS.sub("\n\n", block)
        lines = block.split("\n")
        if any(_CODE_LINE.search(x) for x in lines):
            lines = _without_code(lines)
        for para in re.split(r"\n\s*\n", "\n".join(lines)):
            if len(para) >= MIN_DENSE:
                yield unescape(para)
    for m in common.LEXERS[kind].finditer(contents):
        s = m.group()
        if s[0] in "\"'" and len(s) >= MIN_DENSE:
            yield unescape(_QUOTED.sub(lambda x: _PLAIN.get(x.group(1), x.group(1)), s[1:-1]).replace("\r", ""))


def _without_code(lines: list[str]) -> list[str]:
    """Commented-out code falls away; a form of several lines falls away up to where it is closed."""
    out, depth = [], 0
    for x in lines:
        if depth > 0 or re.match(r"\s*\((?:[\w-]+)[\s)]", x):
            bare = re.sub(r'"(?:\\.|[^"\\])*"', "", x)
            depth = max(0, depth + bare.count("(") - bare.count(")"))
            out.append("")
        elif _CODE_LINE.search(x):
            out.append("")
        else:
            out.append(x)
    return out


def sample_texts(documents: DataFrame) -> list[tuple[str, str]]:
    """At most about ``SAMPLE_DOCS`` labelled texts a language, the first ``SAMPLE_CHARS`` characters of each.

    Which rows are taken hangs on a hash of their id alone, so it does not change with the partitions.
    """
    return common.sampled(documents.where(F.col("lang").isin(*LANGUAGES)), "lang", "doc_id", "text", SAMPLE_DOCS, SAMPLE_CHARS, 200)


def language_shares(files: DataFrame, documents: DataFrame) -> DataFrame:
    """``file_id, lang, sentences, share``: whole sentences of each language in a file's comments and
    strings, and the share of the file's characters that they take.

    One narrow pass over the files with the fitted profiles (a few thousand n-grams) sent to the tasks.
    """
    fitted = Profiles(sample_texts(documents))

    def make():
        seen: dict[str, tuple[str, ...]] = {}

        def f(file_id, path, contents):
            n: dict[str, list[int]] = {}
            open_: list[tuple[tuple[str, ...], int]] = []
            for text in texts_of(contents, common.suffix_of(path)):
                for s, size in sentences(text):
                    langs = seen.get(s)
                    if langs is None:
                        if len(seen) > 50_000:
                            seen.clear()
                        langs = seen[s] = fitted.languages(s)
                    if len(langs) == 1:
                        c = n.setdefault(langs[0], [0, 0])
                        c[0] += 1
                        c[1] += size
                    elif langs:
                        open_.append((langs, size))
            sure = {k: c[0] for k, c in n.items()}
            # Proper names pull a sentence of the first language away from it; between others the file decides.
            for langs, size in open_:
                c = n.setdefault(max(langs, key=lambda k: (k == LANGUAGES[0], sure.get(k, 0), -langs.index(k))), [0, 0])
                c[0] += 1
                c[1] += size
            for lang, (k, size) in n.items():
                yield file_id, lang, k, size / max(1, len(contents))

        return f

    found = common.map_rows(files.select("file_id", "path", "contents"), "file_id long, lang string, sentences int, share double", make, scan=True)
    return found.dropDuplicates(["file_id", "lang"])
