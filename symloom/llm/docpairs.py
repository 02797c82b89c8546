"""Problem 2: functions paired with their documentation.

Method: one packrat parsing-expression grammar a language keeps source offsets; actions over its
captures emit (function, documentation) pairs; pairs without informative documentation are dropped.

Defined results: text outside the grammar is skipped, so broken files give the functions that can still
be read; brackets may nest to any depth; null contents give nothing; a file read twice gives its functions once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from symloom.llm import common
from symloom.llm.peg import Grammar, balanced

# The Skip terminals read on to the next place where another alternative can begin.
THRIFT = r"""
File     <- (Comment / String / Service / Skip / Any)*
Service  <- ~/service\b/ Sp Name (Sp 'extends' Sp Name)? Sp? '{' Body '}'?
Body     <- (Doc / Comment / Function / String / Junk)*
Doc@     <- Block / Lines
Block    <- ~/\/\*(?:.*?\*\/)/
Lines    <- Line (~/\n[ \t]*(?=\/\/|#)/ Line)*
Line     <- ~/(?:\/\/|#)[^\n]*/
Comment  <- Block / Line
Function@ <- ('oneway' Sp)? Type Sp FuncName Sp? Parens (Sp? 'throws' Sp? Parens)? (Sp? Parens)? ~/\s*[,;]?/
FuncName@ <- ~/[A-Za-z_]\w*/
Type     <- ~/[A-Za-z_][\w.]*/ (~/\s*/ Angles)?
Name     <- ~/[A-Za-z_][\w.]*/
String   <- ~/"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'/
Sp       <- (~/\s+/ / Comment)+
Junk     <- ~/[^}\/#"'\w]+|\w+|[\/"']/
Skip     <- ~/(?:[^"'\/#s]|(?<=\w)s|s(?!ervice\b))+/
Any      <- ~/./
"""
ELISP = r"""
File     <- (Comment / String / Def / Skip / Any)*
Def@     <- '(' ~/(?:cl-)?def(?:un|macro|subst)(?=\s)/ Sp FuncName Sp Args (~/\s*/ Doc)?
FuncName@ <- ~/[^\s()\[\]"',`;#]+/
Args     <- 'nil' / List
Doc@     <- String
Comment  <- ~/;[^\n]*/
String   <- ~/"(?:\\.|[^"\\])*"/
Sp       <- (~/\s+/ / Comment)+
Skip     <- ~/(?:[^;"?(\\]|\\.|(?<![\w-])\?(?:\\.|[^\s\\])|(?<=[\w-])\?|\((?!(?:cl-)?def(?:un|macro|subst)\s))+/
Any      <- ~/./
"""
# Brackets with all that nests in them; strings and comments hold none.
MATCHERS = {
    "Angles": balanced("<", ">", r"[^<>]+"),
    "Parens": balanced("(", ")", r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|/\*.*?\*/|//[^\n]*|#[^\n]*'),
    "List": balanced("(", ")", r'"(?:\\.|[^"\\])*"|;[^\n]*|(?<![\w-])\?(?:\\.|\S)|\\.'),
}
#: Articles of the languages met in comments.
ARTICLES = frozenset("a an the der die das den dem ein eine einen le la les un une des el los las una o os as um uma het een de l".split())
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_WORD = re.compile(r"[^\W\d_][\w'’-]*")
_CODE = re.compile(r"^\s*(?:oneway\s+)?[\w.]+(?:\s*<.*>)?\s+\w+\s*\(.*\)?\s*(?:throws\b.*)?[,;]?\s*$|^\s*\d+\s*:\s|[{};]\s*$|^\s*\(?(?:defun|setq|let)\b")


def parts_of(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)} | {name.lower()}


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), text) if "\\u" in text else text


def informative(doc: str, name: str) -> bool:
    """At least four words (ten characters in a script without blanks), not all of them articles or of the name."""
    doc = unescape(doc)
    dense = len(_DENSE.findall(doc))
    w = _WORD.findall(doc)
    if dense * 2 > sum(map(len, w)):
        return sum(1 for ch in doc if ch.isalnum()) >= 10
    return sum(any(c.isalnum() for c in x) for x in doc.split()) >= 4 and not {x.lower() for x in w} <= ARTICLES | parts_of(name)


def commented_code(text: str) -> bool:
    """All its lines read as code."""
    lines = [x for x in text.split("\n") if x.strip()]
    return bool(lines) and all(_CODE.search(x) for x in lines)


def own_lines(text: str, start: int, end: int) -> int | None:
    """Where the part of a comment begins that shares no line with code; None if there is none.

    A line comment behind code is a comment of its own, the line comments below it are another.
    """
    if not text[text.rfind("\n", 0, start) + 1 : start].strip(" \t\r\ufeff"):
        return start
    below = text.find("\n", start, end) + 1
    if text.startswith("/*", start) or not below:
        return None
    return below + len(text[below:end]) - len(text[below:end].lstrip(" \t"))


class Pairs:
    """Both grammars, compiled once a task."""

    def __init__(self) -> None:
        self.grammar = {"thrift": Grammar(THRIFT, MATCHERS), "el": Grammar(ELISP, MATCHERS)}

    def of(self, text: str, kind: str) -> Iterator[tuple[int, str, int, int, str]]:
        """name's line, name, start and end of the function, documentation."""
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        yield from getattr(self, kind)(text, lambda p: bisect_right(starts, p))

    def thrift(self, text: str, line) -> Iterator[tuple[int, str, int, int, str]]:
        above: tuple | None = None
        for cap in self.grammar["thrift"].parse(text):
            if cap[0] == "Doc":
                above = cap
                continue
            _, start, end, inner = cap
            name = next(c for c in inner if c[0] == "FuncName")
            if above and line(above[2] - 1) == line(start) - 1:
                begin = own_lines(text, above[1], above[2])
                doc = "" if begin is None else common.without_marks(text[begin : above[2]].replace("\r", ""))
                if not commented_code(doc) and informative(doc, text[name[1] : name[2]]):
                    yield line(name[1]), text[name[1] : name[2]], start, end, doc.strip()
            above = None

    def el(self, text: str, line) -> Iterator[tuple[int, str, int, int, str]]:
        for _, start, end, inner in self.grammar["el"].parse(text):
            caps = {c[0]: c for c in inner}
            if "Doc" in caps:
                name = text[caps["FuncName"][1] : caps["FuncName"][2]]
                doc = re.sub(r'\\(["\\])', r"\1", text[caps["Doc"][1] + 1 : caps["Doc"][2] - 1]).replace("\r", "")
                if informative(doc, name):
                    yield line(caps["FuncName"][1]), name, start, end, doc.strip()


_SEXP = re.compile(r'"(?:\\.|[^"\\])*"|;[^\n]*|\?\\?.|[()]', re.S)


def form_end(text: str, start: int) -> int:
    """The end of the balanced form at ``start``; the end of the text if it is not closed."""
    depth = 0
    for m in _SEXP.finditer(text, start):
        if (c := m.group()) == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return m.end()
    return len(text)


def documented_functions(files: DataFrame, with_code: bool = True) -> DataFrame:
    """``file_id, line_no, func_name`` and, with code, ``doc, code``: one row for each documented function.

    One narrow pass over the files; only the found rows are shuffled, to make rows of repeated reads one.
    """

    def make():
        pairs = Pairs()

        def f(file_id, path, contents):
            kind = common.suffix_of(path)
            for no, name, start, end, doc in pairs.of(contents, kind):
                if not with_code:
                    yield file_id, no, name
                else:
                    yield file_id, no, name, doc, contents[start : form_end(contents, start) if kind == "el" else end]

        return f

    schema = "file_id long, line_no long, func_name string" + ", doc string, code string" * with_code
    return common.map_rows(files.select("file_id", "path", "contents"), schema, make, scan=True).dropDuplicates(["file_id", "line_no", "func_name"])
