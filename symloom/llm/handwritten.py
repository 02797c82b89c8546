"""Problem 5: generated, minified, vendored and data files among C sources.

Method: an inverted index of the hashes of rare lines of known other projects gives the exact share of
each reference file's rare lines that a source file holds (copies with edits keep most of them). A copy that
names its project with a release or an address is found by the project names of the reference table, an
output by the file it was made from or by what it says of itself; token-composition rules judge the rest.

Defined results: null contents give no row; an empty file is no case; a file read twice counts once; with
no reference files only the rules speak.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm import common
from symloom.storage import materialize

#: A line is rare if at most this share of the reference files (but two at least) hold it.
RARE_SHARE = 1 / 8
#: A copy holds this share of a reference file's rare lines: unrelated files share next to none of them.
CONTAINED = 0.5
MIN_LINE = 8
LONG_LINE, LONG_SHARE = 250, 0.5
DATA_SHARE = 0.7

#: Names of directories that hold other projects, as whole path segments.
THIRD_PARTY = frozenset("third_party third-party thirdparty 3rdparty vendor vendored vendors external externals extern deps gnulib contrib bundled node_modules".split())
# How files say, in the languages of the collection, that a tool wrote them or that they are not to be edited.
_WRITTEN = re.compile(
    r"\bauto(?:matically)?[\s-]*(?:generated|produced|created|written)\b|\bgenerated (?:by|from|with)\b|@generated\b|\bmachine[- ](?:written|generated|made)\b|\bdo not (?:edit|modify)\b(?! the)"
    r"|automatisch (?:erzeugt|generiert|erstellt|gegenereerd|aangemaakt)|nicht (?:bearbeiten|ändern|editieren)|niet (?:bewerken|wijzigen|aanpassen)"
    r"|ne pas (?:modifier|éditer)|(?:produit|généré|créé) (?:automatiquement|par)|(?:creado|generado) (?:automáticamente|por)|no (?:lo )?(?:edite|editar|modificar)\b"
    r"|(?:gerado|criado) (?:automaticamente|por)|não (?:edite|editar|altere)|wygenerowan|utworzon\w+ (?:automatycznie|przez)|nie (?:edytować|edytuj|zmieniać)"
    r"|создан\w* (?:программой|автоматически)|сгенерирован|не (?:править|редактировать|изменять)|otomatik olarak|tarafından (?:oluşturul|üretil)|düzenlemeyin|自動生成|自动生成|編集しないで|请勿(?:编辑|修改)|不要(?:编辑|修改)",
    re.I,
)
#: A file that is neither C nor a document, named at the head of a C file: what it was made from.
_SOURCE = re.compile(r"(?<![\w/.@-])[\w./-]*\w\.(?!(?:c|h|cc|hh|cpp|hpp|cxx|hxx|txt|md|rst|html?|pdf|log|org|com|net|example|test|invalid)\b)[a-z]{1,8}\b(?![./\w@(])")
_NOT_NOW = re.compile(r"\bused to be\b|\bno longer\b|\bkept by hand\b|\bformerly\b|\bnot generated\b|\bat start-?up\b|\bat run ?time\b", re.I)
#: What stands beside the name of another project where a copy tells its origin: a release or an address.
_ORIGIN = re.compile(r"\b[a-z][\w+-]*[ (,v]+\d+\.\d+|\brelease \d|://", re.I)
_TOKEN = re.compile(r"[^\W\d_][\w+-]*")
# Constructs that only tools write, one a family of tools.
_TOOL_CODE = re.compile(
    r"^[ \t]*#[ \t]*line \d+ \"|\basso_values\b|\bMAX_HASH_VALUE\b|\bconvert_ptr ?\(args, &argp\d+|\bzzevaluate_rule|\bpcc_thunk_t\b|\byy(?:pact|defact|pgoto|defgoto|translate)\d*\[\]",
    re.M,
)
_BLANK = re.compile(r"(?:\s+|/\*.*?\*/|//[^\n]*|#[^\n]*)*", re.S)
_NUMBER = re.compile(r"-?(?<![\w.])(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:e[+-]?\d+)?)[uUlLfF]*\b[,\s]*")
_STRING = re.compile(r'"((?:\\.|[^"\\\n])*)"')
_PROSE = re.compile(r"[A-Za-z_]+(?:[ -][A-Za-z_]+)*\Z")


def outer_comments(text: str) -> Iterator[str]:
    """Comments before the first or after the last code, each in one line, but for those that take back what they say."""
    first = _BLANK.match(text).end()
    tail = text.rstrip()
    for start, end, block, _ in common.comments(text, "c"):
        if start < first or end >= len(tail):
            flat = " ".join(block.split())
            if not _NOT_NOW.search(flat):
                yield flat


def self_description(text: str) -> str:
    """'generated' if a comment before the first or after the last code says so of the file or names what it was made from, else ''."""
    return "generated" if any(_WRITTEN.search(x) or _SOURCE.search(x) for x in outer_comments(text)) else ""


def origin_words(text: str) -> set[str]:
    """Lower-case words of the outer comments that give a release or an address: the name of another project may be among them."""
    return {w.lower() for x in outer_comments(text) if _ORIGIN.search(x) for w in _TOKEN.findall(x)}


def composition(text: str) -> str:
    """'generated', 'minified' or 'data' by the tokens of the code, else ''."""
    code = common.LEXERS["c"].sub(lambda m: m.group() if m.group()[0] in "\"'" else " ", text)
    lines = [x for x in code.split("\n") if x.strip()]
    total = sum(map(len, lines))
    if not total:
        return ""
    bare = _STRING.sub('""', code)
    if _TOOL_CODE.search(re.sub(r'^([ \t]*#[ \t]*line \d+ )""', r'\1"x"', bare, flags=re.M)):
        return "generated"
    strings = [m.group() for m in _STRING.finditer(code) if len(m.group()) > 16 and not _PROSE.match(m.group(1))]
    # Opaque strings make data; a list of words or a sentence does not.
    opaque = sum(len(s) for s in strings if " " not in s or not re.search(r"[a-z]{3,} [a-z]{2,}", s))
    numbers = sum(len(m) for m in _NUMBER.findall(bare))
    if (numbers + opaque) / total >= DATA_SHARE:
        return "data"
    long = sum(len(x) for x in lines if len(_STRING.sub('""', x)) > LONG_LINE)
    return "minified" if long / total >= LONG_SHARE else ""


def reason_of(path: str, text: str) -> str:
    segments = {s.lower() for s in path.replace("\\", "/").split("/")[:-1]}
    if segments & THIRD_PARTY:
        return "vendored"
    text = text.replace("\r", "").lstrip("﻿")
    return self_description(text) or composition(text)


def line_hashes(df: DataFrame, key: str) -> DataFrame:
    """``key, h``: a hash of each line without its blanks, lines of fewer than ``MIN_LINE`` characters left out."""
    line = F.explode(F.split(F.col("contents"), "\n")).alias("line")
    flat = F.regexp_replace("line", r"\s+", "")
    return df.select(key, line).select(key, flat.alias("line")).where(F.length("line") >= MIN_LINE).select(key, F.xxhash64("line").alias("h"))


def contained(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """``file_id, upstream_id, share``: files that hold at least ``CONTAINED`` of a reference file's rare lines.

    The index keeps rare lines only, so no posting is long; a file's lines meet it in one equi-join that
    Spark broadcasts while the index is small and shuffles beyond that (the session's threshold decides).
    """
    ref = line_hashes(upstream.where("contents is not null"), "upstream_id").distinct()
    n = upstream.where("contents is not null").agg(F.greatest(F.lit(2.0), F.count(F.lit(1)) * F.lit(RARE_SHARE)).alias("most"))
    rare = ref.groupBy("h").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where("df <= most").select("h")  # one row
    index = ref.join(rare, "h")
    sizes = index.groupBy("upstream_id").agg(F.count(F.lit(1)).alias("lines"))
    hits = line_hashes(files, "file_id").join(index, "h").distinct().groupBy("file_id", "upstream_id").agg(F.count(F.lit(1)).alias("held"))
    return hits.join(sizes, "upstream_id").select("file_id", "upstream_id", (F.col("held") / F.col("lines")).alias("share")).where(F.col("share") >= CONTAINED)


def not_handwritten(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """``file_id, reason``: reason is 'generated', 'minified', 'data', 'vendored' or 'copied'; the least by name if several."""

    def make():
        def f(file_id, path, contents):
            if reason := reason_of(path or "", contents):
                yield file_id, reason, None
            else:
                for word in origin_words(contents.replace("\r", "").lstrip("\ufeff")):
                    yield file_id, None, word

        return f

    looked = common.map_rows(files.select("file_id", "path", "contents"), "file_id long, reason string, word string", make, scan=True)
    looked = materialize(looked, "looked")
    ruled = looked.where("reason is not null").select("file_id", "reason")
    # Copies that name their project: the names are those of the reference table, in one word.
    names = upstream.where("project is not null").select(F.lower(F.regexp_replace(F.trim("project"), r"\s+", "-")).alias("word")).distinct()
    named = looked.where("word is not null").select("file_id", "word").join(names, "word", "left_semi").select("file_id", F.lit("vendored").alias("reason"))
    copies = contained(files.select("file_id", "contents"), upstream).select("file_id", F.lit("copied").alias("reason"))
    return copies.unionByName(ruled).unionByName(named).groupBy("file_id").agg(F.min("reason").alias("reason"))
