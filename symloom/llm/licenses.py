"""Problem 1: the licence of each file and repository.

Method: comment blocks are extracted, copyright lines (years and holders) masked, and the sentences
that can state terms kept; identical blocks are grouped, each distinct block is identified once, and
the labels are joined back to the files.

Defined results: a file without contents has no row (it has another row that was read); null or empty
texts state nothing; repeated rows of a file count once; a file whose repo is missing and that states
nothing is UNKNOWN; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm import common
from symloom.storage import materialize

UNKNOWN, CONFLICT = "UNKNOWN", "CONFLICT"

# A notice of years and holder, up to the end of its sentence or line: masked, what stands beside it stays.
_HOLDER = re.compile(r"(?:\(c\)\s*)?(?:\bcopyright\b|©|\(c\)\s*\d)(?-i:(?:[^\n.]|\.(?![ \t]+[A-Z]\w* \w))*)(?:\.|$)", re.I | re.M)
_TAG = re.compile(r"^\s*SPDX-License-Identifier\s*:\s*(.*?)\s*$", re.I | re.M)
_FIELD = re.compile(r"^\s*(?:License|Licence)\s*:\s*(.*?)\s*$", re.I | re.M)
_URL = re.compile(r"https?://[^\s<>\"')]+")
_CUE = re.compile(
    r"licen[cs]|spdx|under\b|terms|commons|public|claim|clause|rights|confiden|internal use|permi|reuse|used|offered|available|provided|dedicat|source|conditions|accord|pursuant|subject to|\bmay (?:be|not|pass)\b",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[\w)+>\"][\w)+>\"][.!])\s+(?=[A-Z(<\"]|[a-z]+[A-Z])|(?<=[\d)+][.!])\s+(?=[A-Z]|[a-z]+[A-Z])")
_VERB = re.compile(r"\b(?:licen[sc]ed|released|distributed|offered|available|published|provided|governed|copy (?:this|the)|use (?:this|the)|dedicated|covered|take it|free)\b", re.I)
_CHOICE = re.compile(r"\bdual|\bchoose between|\bat your (?:choice|option)\b(?!,? any (?:later )?version)|\beither\b.*\bor\b|\bor else\b|\bas you like\b|\bwhichever\b", re.I | re.S)
_OWN = re.compile(
    r"\bconfidential\b|\binternal use only\b|\buse is subject to\b|\bwritten (?:permit|permission|consent)\b|\bmay not be (?:copied|used|handed|passed|distributed)\b|\bproprietary\b|\bno licen[sc]e is (?:granted|given)\b",
    re.I,
)
_PAST = re.compile(r"\b(?:was|were|used to be|formerly|no longer|labelled|compare|skips)\b", re.I)
_LATER = re.compile(r"\+|\bor[ -](?:any )?later\b|\bany later\b|\blater versions?\b|\bversion after\b|\bany version\b", re.I)
_ONLY = re.compile(r"\bonly\b|\bno (?:later\b|other version)|\bexact(?:ly)?\b", re.I)
# What leads from a statement to the name of its licence.
_UNDER = re.compile(r"\bunder\b|\baccording to\b|\bin accordance with\b|\bpursuant to\b|\bon the terms of\b|\bby the terms of\b|\bsubject to\b", re.I)
_NUM = {"one": "1", "two": "2", "three": "3"}
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(w: list[str]) -> set[tuple[str, str]]:
    return set(zip(w, w[1:], strict=False))


class Book:
    """The rows of ``licenses``, by family (rows with the same title), and how texts name them."""

    def __init__(self, rows: list[tuple]) -> None:
        """rows: license_id, title, revision, aliases, notice, url."""
        self.rows = [tuple(r) for r in rows]
        self.ids = {r[0].lower(): r[0] for r in rows}
        self.urls = {(r[5] or "").rstrip("/").lower(): r[0] for r in rows if r[5]}
        self.exact = self.ids | {a.strip().lower(): r[0] for r in rows for a in r[3] or []}
        common_words = {"public", "license", "free", "dedication", "the", "lesser", "clause", "two", "three"}
        self.family: dict[str, list[tuple]] = {}
        # An early word of the title names the family; so does the short form at the start of the id.
        for r in rows:
            stem = re.split(r"[-\d]", r[0])[0].lower()
            self.family.setdefault(stem, []).append(r)
        self.names: list[tuple[re.Pattern, str]] = []
        for stem, own in self.family.items():
            w = [x for x in words(own[0][1]) if x not in common_words]
            lead = "lesser " if own[0][1].lower().startswith("lesser ") else ""
            alts = [rf"\b{lead}{w[0]}\b" if w else "", rf"\b{stem}(?=[\W\dv_]|$)"]
            self.names.append((re.compile("|".join(a for a in alts if a), re.I), stem))
        # The longer title first, so that a lesser licence is not read as the plain one.
        self.names.sort(key=lambda x: -len(self.family[x[1]][0][1]))
        self.notice: dict[str, set] = {}
        for stem, own in self.family.items():
            self.notice[stem] = set.intersection(*[_grams(self._first(r[4])) for r in own])

    @staticmethod
    def _first(notice: str) -> list[str]:
        return words(_SENTENCE.split(notice or "")[0].replace("This work", ""))

    def pick(self, stem: str, text: str) -> str:
        """The one row of a family that version and 'only'/'or later' in the text leave, else UNKNOWN."""
        own = self.family[stem]
        text = " ".join(_NUM.get(x.lower(), x) for x in re.split(r"[\s-]+", text))
        seen = set(re.findall(r"(?<![\w.])v?\.?(\d+(?:\.\d+)*)", re.sub(r"(?i)\b[a-z]{2,}?v?(?=\d)", " ", text)))
        if seen and any(re.search(r"\d", r[2] or "") for r in own):
            own = [r for r in own if any(self._same(r[2], v) for v in seen)]
        if len(own) > 1:
            kind = "only" if _ONLY.search(text) and not re.search(r"\bonly\b.{0,3}\+", text) else "later" if _LATER.search(text) else ""
            if kind:
                own = [r for r in own if kind in r[0].lower()] or own
        return own[0][0] if len(own) == 1 else UNKNOWN

    @staticmethod
    def _same(revision: str, v: str) -> bool:
        a, b = ([*map(int, x.split("."))] for x in (revision, v))
        n = max(len(a), len(b))
        return a + [0] * (n - len(a)) == b + [0] * (n - len(b))

    def named(self, text: str) -> str:
        """The licence that a short name means; UNKNOWN if it names none or not exactly one; '' if it names nothing."""
        t = " ".join(text.split()).strip(" .,;:<>()")
        if t.lower() in self.exact:
            return self.exact[t.lower()]
        if m := _URL.search(t):
            return self.urls.get(m.group().rstrip("/.").lower(), UNKNOWN)
        for pattern, stem in self.names:
            if pattern.search(t):
                return self.pick(stem, t)
        return ""

    def offered(self, text: str) -> list[str]:
        """Each licence that a sentence about a choice names, in its order."""
        parts = re.split(r"\bor (?:else\b|under\b)|,\s*or\b|\bor (?=[A-Z])|:\s|;|\band\b(?= [A-Z])", text)
        return [x for x in dict.fromkeys(self.named(p) for p in parts) if x]

    def expression(self, text: str) -> str:
        """The verdict of an identifier expression: an id, 'X OR Y', CONFLICT (joined by AND) or UNKNOWN."""
        parts = re.split(r"\s+(OR|AND)\s+", text.strip().strip("()"), flags=re.I)
        got = [self.ids.get(p.strip(" ()").lower()) or (self.named(p) or UNKNOWN) for p in parts[::2]]
        if UNKNOWN in got:
            return UNKNOWN
        got = sorted(set(got))
        if len(got) == 1:
            return got[0]
        return " OR ".join(got) if all(p.upper() == "OR" for p in parts[1::2]) else CONFLICT

    def by_notice(self, sentence: str) -> str:
        """The licence whose notice the sentence is, wording changed a little; '' if it is none."""
        w = words(sentence)
        grams = _grams(w)
        best, score = "", 0.0
        for stem, need in self.notice.items():
            s = len(need & grams) / len(need)
            if s > score:
                best, score = stem, s
        if score < 0.55:
            return ""
        own = self.family[best]
        if any("." in (r[2] or "") and r[2] in r[4] for r in own):
            seen = set(re.findall(r"\d+(?:\.\d+)+", sentence))
            own = [r for r in own if r[2] in seen] if seen else own
        if not own:
            return UNKNOWN
        # Wordings that differ in a clause: the one of whose own word pairs the sentence holds most.
        pairs = [_grams(self._first(r[4])) for r in own]
        shared = set.intersection(*pairs)
        rest = [p - shared for p in pairs]
        held = [len(p & grams) / len(p) if p else 0.0 for p in rest]
        if len(own) == 1 or max(held) == 0.0 and min(map(len, rest)) > 0:
            return own[0][0] if len(own) == 1 else UNKNOWN
        top = max(held)
        if top < 0.5 and not all(rest):  # the wording without the clause
            return own[min(range(len(own)), key=lambda i: len(rest[i]))][0]
        return own[held.index(top)][0] if held.count(top) == 1 else UNKNOWN

    def states(self, core: str) -> list[str]:
        """What one block states: ids, 'X OR Y' or UNKNOWN, each once; nothing for mentions and pointers."""
        found: list[str] = []
        for m in _TAG.finditer(core):
            found.append(self.expression(m.group(1)))
        core = _TAG.sub("\n", core)
        for m in _FIELD.finditer(core):
            found.append(self.named(m.group(1)) or UNKNOWN)
        core = _FIELD.sub("\n", core)
        for line in core.split("\n"):
            if (m := _URL.search(line)) and m.group().rstrip("/.").lower() in self.urls:
                found.append(self.urls[m.group().rstrip("/.").lower()])
            elif line.strip():
                found += self._sentence(line)
        return list(dict.fromkeys(found))

    def _sentence(self, s: str) -> list[str]:
        if by := self.by_notice(s):
            return [by]
        if _OWN.search(s):
            return [UNKNOWN]
        if _PAST.search(s) and not _CHOICE.search(s):
            return []
        if _CHOICE.search(s) and len(got := self.offered(s)) > 1:
            return [UNKNOWN if UNKNOWN in got else " OR ".join(sorted(got))]
        if _VERB.search(s) and (_UNDER.search(s) or re.search(r"\bcommons\b", s, re.I)):
            if name := self.named(_UNDER.split(s, maxsplit=1)[-1]):
                return [name]
            if re.search(r"\bunder (?:its|their|our|special|separate) (?:own )?terms\b", s, re.I):
                return [UNKNOWN]
        return []


def core_of(block: str) -> str:
    """The part of a block that can state terms: tag and URL lines, and sentences with a cue, one a line."""
    block = _HOLDER.sub("\n", block)
    kept: list[str] = []
    prose: list[str] = []

    def flush() -> None:
        for s in _SENTENCE.split(" ".join(" ".join(prose).split())):
            if _CUE.search(s):
                kept.append(s)
        prose.clear()

    for line in block.split("\n"):
        if _TAG.match(line) or _FIELD.match(line) or _URL.search(line):
            flush()
            kept.append(line.strip())
        elif not line.strip():
            flush()
        else:
            prose.append(line)
    flush()
    return "\n".join(kept)


def cores(text: str, kind: str) -> Iterator[str]:
    for _, _, block, _ in common.comments(text, kind):
        if core := core_of(block):
            yield core


def verdict_of(stated: list[str]) -> str | None:
    """Of all that a subject states: None for nothing; see TESTDATA for the forms.

    Terms that fit no licence make it UNKNOWN; otherwise single ids inside an offered choice confirm it.
    """
    s = set(stated)
    if not s:
        return None
    if UNKNOWN in s:
        return UNKNOWN
    choices = {x for x in s if " OR " in x}
    single = s - choices - {CONFLICT}
    if CONFLICT in s or len(choices) > 1:
        return CONFLICT
    if choices:
        (c,) = choices
        return c if single <= set(c.split(" OR ")) else CONFLICT
    return single.pop() if len(single) == 1 else CONFLICT


def repo_verdict(book: Book, text: str | None, declared: str | None) -> str:
    """A text that fits no licence is UNKNOWN; a declaration that names no single licence adds nothing."""
    stated: list[str] = []
    if text and text.strip():
        body = _HOLDER.sub("\n", text)
        for para in re.split(r"\n\s*\n", body):
            for s in _SENTENCE.split(" ".join(para.split())):
                stated += book._sentence(s)
        ids = sorted({x for x in stated if x != UNKNOWN and " OR " not in x})
        head = "\n".join(x for x in body.split("\n") if not re.match(r"\s*\d\.", x))
        if len(ids) == 2 and _CHOICE.search(re.sub(r"(?is)or,\s+at\s+your\s+choice,\s+any\s+version", " ", head)):
            stated = [" OR ".join(ids)]
        if not stated and len(words(body)) > 3:
            stated = [UNKNOWN]
    d = (declared or "").strip()
    if d:
        e = book.expression(d) if re.search(r"\s(?:OR|AND)\s", d) else book.named(d)
        if e and e != UNKNOWN:
            stated = [x for x in stated if x != UNKNOWN] + [e]
    return verdict_of(stated) or UNKNOWN


def book_rows(licenses: DataFrame) -> list[tuple]:
    """The licence table (a fixed list of known licences, not data that grows) as tuples."""
    return [tuple(r) for r in licenses.select("license_id", "title", "revision", "aliases", "notice", "url").where("license_id is not null").collect()]


def license_verdicts(files: DataFrame, repos: DataFrame, licenses: DataFrame) -> DataFrame:
    """``subject_kind, subject_id, verdict`` of every file and repository.

    Plan: one scan of the sources writes (file, repo, core) rows, a small table; cores are made distinct
    with map-side combining; labels come back through a join that spreads measured hot blocks, and so do the
    repositories' verdicts; what a file states is a set of a few labels.
    """
    rows = book_rows(licenses)

    def extract():
        def f(file_id, repo_id, path, contents):
            got = list(dict.fromkeys(cores(contents, common.suffix_of(path))))
            for core in got or [None]:
                yield file_id, repo_id, core

        return f

    found = common.map_rows(files.select("file_id", "repo_id", "path", "contents"), "file_id long, repo_id int, core string", extract, scan=True)
    found = materialize(found.withColumn("core_id", F.unhex(F.md5("core"))), "license-cores")

    def identify():
        book = Book(rows)

        def f(core_id, core):
            yield core_id, book.states(core)

        return f

    distinct = found.where("core is not null").groupBy("core_id").agg(F.any_value("core").alias("core"))
    labels = materialize(common.map_rows(distinct.select("core_id", "core"), "core_id binary, stated array<string>", identify), "license-labels")
    joined = common.hot_join(found.select("file_id", "repo_id", "core_id"), labels.where(F.size("stated") > 0), "core_id", "file_id")
    per_file = joined.groupBy("file_id").agg(F.min("repo_id").alias("repo_id"), F.array_distinct(F.flatten(F.collect_set("stated"))).alias("stated"))

    def judge():
        def f(file_id, repo_id, stated):
            yield file_id, repo_id, verdict_of(stated)

        return f

    own = materialize(common.map_rows(per_file, "file_id long, repo_id int, verdict string", judge), "license-files")

    def judge_repo():
        book = Book(rows)

        def f(repo_id, text, declared):
            yield repo_id, repo_verdict(book, text, declared)

        return f

    of_repo = common.map_rows(repos.where("repo_id is not null").select("repo_id", "license_text", "declared_license"), "repo_id int, verdict string", judge_repo)
    of_repo = of_repo.groupBy("repo_id").agg(F.min("verdict").alias("repo_verdict"))
    # Only files that state nothing take their repository's verdict.
    taken = common.hot_join(own.where("verdict is null").drop("verdict"), of_repo, "repo_id", "file_id").select("file_id", F.col("repo_verdict").alias("verdict"))
    by_file = own.where("verdict is not null").select("file_id", "verdict").unionByName(taken)
    by_file = by_file.select(F.lit("file").alias("subject_kind"), F.col("file_id").alias("subject_id"), F.coalesce("verdict", F.lit(UNKNOWN)).alias("verdict"))
    by_repo = of_repo.select(F.lit("repo").alias("subject_kind"), F.col("repo_id").cast("long").alias("subject_id"), F.col("repo_verdict").alias("verdict"))
    return by_file.unionByName(by_repo)
