"""Built-in languages as declarative rules.

Each is written for the constructs that its kinds name, at the level of lines and brackets; comments and
strings are blanked first where the language has them. Macros, preprocessor branches and types are not
resolved. ``COVERED`` in the catalog lists what is here; other languages can be defined by option files.
"""

from __future__ import annotations

import re
from dataclasses import replace

from symloom.operators.spec import Kind, LanguageSpec, Registry, Rule

C_HIDE = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|/\*.*?(?:\*/|\Z)|//[^\n]*'
C_COMMENT = r"/\*.*?(?:\*/|\Z)|//[^\n]*"
# Code that the preprocessor never passes on.
IF0 = r"(?:^[ \t]*#[ \t]*if[ \t]+0\b.*?^[ \t]*#[ \t]*(?:endif|else|elif)\b)|"
HASH = r"(?m:(?:^|(?<=\s))#[^\n]*)"
QUOTES = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
SEMI = r";[^\n]*"
DASHES = r"--[^\n]*"
XML_HIDE = r"<!--.*?(?:-->|\Z)"
W = r"([A-Za-z_]\w*)"
_NOT = r"(?!(?:if|else|for|while|switch|return|do|case|catch|sizeof|new|delete|throw|typeof|using|lock|foreach|elsif|elseif|unless|until|when|with|function|await|assert)\b)"


def R(pattern: str, kind: str, name: str = r"\1", **more) -> Rule:
    for k in ("scope", "fields", "action", "guest"):
        if k in more and isinstance(more[k], str):
            more[k] = tuple(more[k].split())
    return Rule(pattern, name, kind, **more)


def kinds(text: str) -> tuple[Kind, ...]:
    """``f:function l:local- c:class/role1,role2``: a minus switches a kind off."""
    out = []
    for item in text.split():
        letter, name = item.split(":", 1)
        name, _, roles = name.partition("/")
        out.append(Kind(letter, name.rstrip("-"), name.rstrip("-"), not name.endswith("-"), tuple(roles.split(",")) if roles else ()))
    return tuple(out)


REGISTRY = Registry()


def lang(name: str, kind_text: str, ext: str = "", rules: list[Rule] = (), **more) -> LanguageSpec:
    multi = tuple(more.pop("multi", ()))
    return REGISTRY.add(
        LanguageSpec(
            name, kinds(kind_text), tuple(ext.split()), tuple(more.pop("patterns", "").split()), tuple(more.pop("aliases", "").split()),
            line_rules=tuple(rules), multi_rules=multi, **more,
        )
    )


def _braces(parents: tuple[str, ...]):
    """Scopes by brackets: entries that end later than another begins hold it, innermost first."""

    def set_scopes(host) -> None:
        order = sorted(range(len(host.entries)), key=lambda i: (host.entries[i]["line"], host.entries[i].get("offset", 0)))
        open_: list[int] = []
        for i in order:
            e = host.entries[i]
            while open_ and (host.entries[open_[-1]].get("end") or 0) < e["line"]:
                open_.pop()
            if open_ and e.get("scope_id") is None:
                e["scope_id"] = open_[-1] + 1
            if e.get("end") and e["kind_letter"] in parents:
                open_.append(i)

    return set_scopes


def nested(name: str, kind_text: str, ext: str, multi: list[Rule], parents: str, hide: str = C_HIDE, sep: str = ".", **more) -> LanguageSpec:
    """A language whose rules see the whole text and whose scopes follow from where brackets close."""
    rules = tuple(multi)
    scope = _braces(tuple(parents))

    def run(host) -> None:
        host.multi(rules)
        host.entries.sort(key=lambda e: e["offset"])
        scope(host)

    return lang(name, kind_text, ext, function=run, hide=hide, default_separator=sep, **more)


# --- C family -----------------------------------------------------------------------------------------

_TYPE = r"(?:[A-Za-z_][\w:]*(?:<[^;{}()]*>)?[\s*&]+)+"
_C_RULES = [
    R(r"^[ \t]*#[ \t]*define[ \t]+(\w+)", "d", file_scope=""),
    R(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", "h", role="system"),
    R(r"^(static\s+)?(?:inline\s+|extern\s+|const\s+)*(" + _TYPE + r")" + _NOT + r"([A-Za-z_]\w*)\s*(\((?:[^;{}()]|\([^()]*\))*\))\s*(?:const\s*)?(?=\{)", "f", r"\3", mgroup=3, block="{", file_scope=r"\1", typeref=r"\2", signature=r"\4"),
    R(r"^[ \t]*(?:typedef\s+)?struct\s+(\w+)\s*\{", "s", block="{"),
    R(r"^[ \t]*(?:typedef\s+)?union\s+(\w+)\s*\{", "u", block="{"),
    R(r"^[ \t]*(?:typedef\s+)?enum\s+(\w+)\s*\{", "g", block="{"),
    R(r"^[ \t]*typedef\s+[^;{}]*?\b(\w+)\s*;", "t"),
    R(r"^\}\s*(\w+)\s*;", "t"),
    R(r"^(static\s+)?(?:const\s+)?(" + _TYPE + r")(?!return\b)(\w+)(?:\s*\[[^\]\n]*\])*\s*(?:=[^;]*)?;", "v", r"\3", mgroup=3, file_scope=r"\1", typeref=r"\2"),
]


def _c_members(host) -> None:
    """Members of structs and enumerators, inside the brackets of their entries."""
    for i, e in enumerate(list(host.entries)):
        if e["kind_letter"] not in "sug" or not e.get("end") or e["kind"] == "signature":
            continue
        lo = host.seen.find("{", e["offset"]) + 1
        hi = host.starts[e["end"] - 1] + host.line_text(e["end"]).find("}") if e["end"] != e["line"] else host.seen.find("}", lo)
        body = host.seen[lo:hi]
        if e["kind_letter"] == "g":
            for m in re.finditer(r"(?:^|,)\s*([A-Za-z_]\w*)", body):
                host.add(R("", "e"), (m.group(), m.group(1)), lo + m.start(1))
                host.entries[-1]["scope_id"] = i + 1
        else:
            for m in re.finditer(r"([\w\s*]+?[\s*])(\w+)(?:\s*\[[^\]]*\]|\s*:\s*\d+)?\s*;", body):
                host.add(R("", "m", r"\2", typeref=r"\1"), (m.group(), m.group(1), m.group(2)), lo + m.start(2))
                host.entries[-1]["scope_id"] = i + 1


_C_KINDS = "d:macro e:enumerator f:function g:enum h:header/system,local l:local- m:member p:prototype- s:struct t:typedef u:union v:variable x:externvar- z:parameter- L:label- D:macroparam-"


def _c_family(name: str, kind_text: str, ext: str, more_rules: list[Rule], **more) -> None:
    rules = tuple(_C_RULES + more_rules)
    scope = _braces(tuple("csguni"))

    def run(host) -> None:
        # Header names stand in quotes, which are blanked; they are read from the source.
        host.multi(rules)
        _c_members(host)
        host.entries.sort(key=lambda e: e["offset"])
        number = {id(e): i for i, e in enumerate(host.entries, 1)}
        for e in host.entries:
            e.pop("scope_id", None) if e["kind_letter"] not in "em" else None
            if e["kind_letter"] in "em":
                e["scope_id"] = None
        scope(host)
        del number

    lang(name, kind_text, ext, function=run, hide=IF0 + C_COMMENT + r"|\"(?:\\.|[^\"\\\n])*\"(?=\s*[;,)+])|'(?:\\.|[^'\\\n])*'", default_separator="::", **more)


_c_family("C", _C_KINDS, "c h", [])
_CPP = [
    R(r"^[ \t]*(?:template\s*<[^;{}]*>\s*)?class\s+(\w+)(?:\s+final)?(?:\s*:\s*[^;{]+)?\s*\{", "c", block="{"),
    R(r"^[ \t]*namespace\s+(\w+)\s*\{", "n", block="{"),
    R(r"^[ \t]+(?:virtual\s+|static\s+|inline\s+|explicit\s+)*(?:" + _TYPE + r")?" + _NOT + r"(~?\w+)\s*(\((?:[^;{}()]|\([^()]*\))*\))\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?::[^;{}]*)?(?=\{)", "f", block="{", signature=r"\2"),
    R(r"^(?:" + _TYPE + r")?(\w+)::(~?\w+)\s*(\((?:[^;{}()]|\([^()]*\))*\))\s*(?:const\s*)?(?::[^;{}]*)?(?=\{)", "f", r"\2", mgroup=2, block="{", signature=r"\3"),
    R(r"^[ \t]*using\s+(\w+)\s*=", "A"),
]
_c_family("C++", _C_KINDS + " c:class n:namespace A:alias- N:name- U:using- Z:tparam- M:module P:partition", "c++ cc cp cpp cxx h++ hh hp hpp hxx inl C H CPP CXX", _CPP)
_c_family("CUDA", _C_KINDS, "cu cuh", [R(r"^__(?:global|device|host)__\s+(" + _TYPE + r")(\w+)\s*(\([^;{}]*\))\s*(?=\{)", "f", r"\2", mgroup=2, block="{", typeref=r"\1", signature=r"\3")])
lang("CPreProcessor", "d:macro h:header/system,local D:parameter-", "", [R(r"^\s*#\s*define\s+(\w+)", "d"), R(r"^\s*#\s*include\s*<([^>]+)>", "h", role="system"), R(r'^\s*#\s*include\s*"([^"]+)"', "h", role="local")])
_METHOD = r"^[ \t]*(?:(?:public|protected|private|internal|static|final|abstract|virtual|override|sealed|async|synchronized|native|extern|unsafe|partial|default|new)\s+)*(?:<[^<>]*>\s*)?([\w.<>\[\],? ]+?)\s+" + _NOT + r"(\w+)\s*(\((?:[^;{}()]|\([^()]*\))*\))\s*(?:throws\s+[\w., ]+)?\s*(?=[{;])"
_CLASS = r"^[ \t]*(?:(?:public|protected|private|internal|static|final|abstract|sealed|partial|strictfp)\s+)*"
_FIELD = r"^[ \t]+(?:(?:public|protected|private|internal|static|final|volatile|transient|readonly|const)\s+)+([\w.<>\[\],? ]+?)\s+(\w+)\s*(?:=[^;]*)?;"
nested(
    "Java", "a:annotation c:class e:enumConstant f:field g:enum i:interface l:local- m:method p:package r:record", "java",
    [R(r"^[ \t]*package\s+([\w.]+)\s*;", "p"), R(_CLASS + r"class\s+(\w+)", "c", block="{"), R(_CLASS + r"interface\s+(\w+)", "i", block="{"), R(_CLASS + r"enum\s+(\w+)", "g", block="{"),
     R(_CLASS + r"@interface\s+(\w+)", "a", block="{"), R(_CLASS + r"record\s+(\w+)", "r", block="{"), R(_METHOD, "m", r"\2", mgroup=2, block="{", typeref=r"\1", signature=r"\3"), R(_FIELD, "f", r"\2", mgroup=2, typeref=r"\1")],
    "cigar",
)
nested(
    "C#", "c:class d:macro e:enumerator E:event f:field g:enum i:interface l:local- m:method n:namespace p:property s:struct t:typedef", "cs",
    [R(r"^[ \t]*namespace\s+([\w.]+)", "n", block="{"), R(_CLASS + r"class\s+(\w+)", "c", block="{"), R(_CLASS + r"interface\s+(\w+)", "i", block="{"), R(_CLASS + r"struct\s+(\w+)", "s", block="{"), R(_CLASS + r"enum\s+(\w+)", "g", block="{"),
     R(_METHOD, "m", r"\2", mgroup=2, block="{", typeref=r"\1", signature=r"\3"), R(r"^[ \t]+(?:(?:public|protected|private|internal|static|virtual|override|abstract)\s+)+([\w.<>\[\],?]+)\s+(\w+)\s*\{\s*(?:get|set)\b", "p", r"\2", mgroup=2, typeref=r"\1"),
     R(r"^[ \t]+(?:\w+\s+)*event\s+[\w<>.]+\s+(\w+)\s*;", "E"), R(_FIELD, "f", r"\2", mgroup=2, typeref=r"\1"), R(r"^[ \t]*#[ \t]*define\s+(\w+)", "d")],
    "cisgn", aliases="csharp",
)
nested(
    "D", "a:alias c:class g:enum e:enumerator x:externvar- f:function i:interface l:local- m:member X:mixin M:module n:namespace p:prototype- s:struct T:template u:union v:variable V:version", "d di",
    [R(r"^module\s+([\w.]+)\s*;", "M"), R(_CLASS + r"class\s+(\w+)", "c", block="{"), R(_CLASS + r"interface\s+(\w+)", "i", block="{"), R(_CLASS + r"struct\s+(\w+)", "s", block="{"), R(_CLASS + r"union\s+(\w+)", "u", block="{"), R(_CLASS + r"enum\s+(\w+)", "g", block="{"),
     R(r"^[ \t]*(?:mixin\s+)?template\s+(\w+)", "T", block="{"), R(r"^[ \t]*alias\s+(\w+)\s*=", "a"), R(r"^[ \t]*version\s*=\s*(\w+)", "V"), R(_METHOD, "f", r"\2", mgroup=2, block="{", typeref=r"\1", signature=r"\3")],
    "cisuT",
)
nested("Vera", "c:class d:macro e:enumerator f:function g:enum i:interface l:local- m:member p:program s:signal t:task T:typedef v:variable h:header", "vr vri vrh", [R(r"^\s*(?:virtual\s+)?class\s+(\w+)", "c", block="{"), R(r"^\s*program\s+(\w+)", "p", block="{"), R(r"^\s*interface\s+(\w+)", "i", block="{"), R(r"^\s*(?:\w+\s+)*task\s+(?:\w+::)?(\w+)", "t", block="{"), R(r"^\s*(?:\w+\s+)*function\s+\w+\s+(?:\w+::)?(\w+)", "f", block="{"), R(r"^\s*enum\s+(\w+)", "g", block="{"), R(r"^\s*#define\s+(\w+)", "d")], "cip")
nested(
    "ObjectiveC", "i:interface I:implementation P:protocol m:method c:class v:var E:field f:function p:property t:typedef s:struct e:enum M:macro C:category", "mm m h",
    [R(r"^@interface\s+(\w+)\s*\(\s*(\w+)\s*\)", "C", r"\2"), R(r"^@interface\s+(\w+)", "i"), R(r"^@implementation\s+(\w+)", "I"), R(r"^@protocol\s+(\w+)\s*(?:<|$)", "P"), R(r"^-\s*\([^)]*\)\s*(\w+)", "m"), R(r"^\+\s*\([^)]*\)\s*(\w+)", "c"), R(r"^@property\s*(?:\([^)]*\))?\s*[\w<>\s*]+?\b(\w+)\s*;", "p"), R(r"^\s*#\s*define\s+(\w+)", "M"), R(r"^\s*struct\s+(\w+)\s*\{", "s", block="{"), R(r"^\s*(?:typedef\s+)?enum\s+(\w+)\s*\{", "e", block="{")],
    "sie", aliases="objc objective-c",
)
_JS_HIDE = C_HIDE + r"|`(?:\\.|[^`\\])*`"
_JS = [
    R(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*(\([^)]*\))", "f", block="{", signature=r"\2"),
    R(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*\s*(\w+)\s*(\([^)]*\))", "G", block="{", signature=r"\2"),
    R(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "c", block="{"),
    R(r"^[ \t]*(?:export\s+)?const\s+(\w+)\s*(?::[^=\n]+)?=(?!\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=\n]+)?=>)(?!\s*function)", "C"),
    R(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b[^(]*|(?=\([^)]*\)\s*(?::[^=\n]+)?=>|\w+\s*=>))(\([^)]*\))?", "f", block="{", signature=r"\2"),
    R(r"^(?:export\s+)?(?:let|var)\s+(\w+)\b(?!\s*=\s*(?:async\s*)?(?:function|\([^)]*\)\s*=>|\w+\s*=>))", "v"),
    R(r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|abstract)\s+)*" + _NOT + r"(\w+)\s*(\([^;{}]*?\))\s*(?::\s*[^={;\n]+)?(?=\{)", "m", block="{", signature=r"\2"),
    R(r"^[ \t]+(?:static\s+)?get\s+(\w+)\s*\(\s*\)\s*(?=[:{])", "m", block="{"),
    R(r"^(\w+(?:\.\w+)*)\.prototype\.(\w+)\s*=\s*function\s*(\([^)]*\))", "m", r"\2", mgroup=2, block="{", signature=r"\3"),
]
nested("JavaScript", "f:function c:class m:method p:property C:constant v:variable g:generator- G:generator2 S:setter M:field".replace("g:generator- G:generator2", "G:generator"), "js jsx mjs", _JS, "cf", _JS_HIDE, aliases="js node nodejs seed gjs v8")
nested(
    "TypeScript", "f:function c:class i:interface g:enum e:enumerator m:method n:namespace z:parameter- p:property v:variable l:local- C:constant G:generator a:alias", "ts tsx",
    [*_JS, R(r"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+(\w+)", "i", block="{"), R(r"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(\w+)", "g", block="{"), R(r"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+([\w.]+)", "n", block="{"), R(r"^[ \t]*(?:export\s+)?type\s+(\w+)(?:<[^>]*>)?\s*=", "a"),
     R(r"^[ \t]+(?:(?:public|private|protected|static|readonly)\s+)*(\w+)\??\s*:\s*([^;={}()\n]+)[;=]", "p", typeref=r"\2")],
    "cign", _JS_HIDE,
)
nested(
    "PHP", "c:class d:define f:function i:interface l:local- n:namespace t:trait v:variable a:alias", "php php3 php4 php5 php7 phtml",
    [R(r"^\s*namespace\s+([\w\\]+)", "n"), R(_CLASS + r"class\s+(\w+)", "c", block="{"), R(r"^\s*interface\s+(\w+)", "i", block="{"), R(r"^\s*trait\s+(\w+)", "t", block="{"), R(r"^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*function\s+&?\s*(\w+)\s*(\([^{;]*?\))", "f", block="{", signature=r"\2"),
     R(r"^\s*define\s*\(\s*['\"](\w+)['\"]", "d"), R(r"^\s*(?:(?:public|protected|private)\s+)?const\s+(\w+)\s*=", "d"), R(r"^\s*(?:(?:public|protected|private|static|var)\s+)+(?:\??[\w\\]+\s+)?\$(\w+)", "v"), R(r"^\s*use\s+[\w\\]+\s+as\s+(\w+)", "a")],
    "cit", C_COMMENT + "|" + HASH, sep="\\",
)
nested("Zephir", "c:class d:define f:function i:interface n:namespace v:variable", "zep", [R(r"^\s*namespace\s+([\w\\]+)", "n"), R(_CLASS + r"class\s+(\w+)", "c", block="{"), R(r"^\s*interface\s+(\w+)", "i", block="{"), R(r"^\s*(?:\w+\s+)*function\s+(\w+)\s*(\([^{;]*?\))", "f", block="{", signature=r"\2"), R(r"^\s*const\s+(\w+)\s*=", "d"), R(r"^\s*(?:public|protected|private)\s+(?:static\s+)?(\w+)\s*[;={]", "v")], "ci", sep="\\")
nested(
    "Go", "p:package f:func c:const t:type v:var s:struct i:interface m:member M:anonMember n:methodSpec Y:unknown P:packageName a:talias R:receiver-", "go",
    [R(r"^package\s+(\w+)", "p"), R(r"^func\s+(\w+)\s*(?:\[[^\]]*\])?(\([^{]*?\))", "f", block="{", signature=r"\2"), R(r"^func\s+\(\s*\w*\s*\*?(\w+)[^)]*\)\s*(\w+)\s*(\([^{]*?\))", "f", r"\2", mgroup=2, block="{", signature=r"\3"), R(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b", "s", block="{"), R(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b", "i", block="{"),
     R(r"^type\s+(\w+)\s*=\s*", "a"), R(r"^type\s+(\w+)\s+(?!struct\b|interface\b)([\w.*\[\]]+)", "t", typeref=r"\2"), R(r"^const\s+(\w+)", "c"), R(r"^var\s+(\w+)\s+", "v"), R(r"^\t(\w+)(?:\s+\w+)?\s*=\s*(?:iota|\d|\")", "c"), R(r"^\t(\w+)\s+([\w.*\[\]]+)\s*(?:`[^`\n]*`)?\s*$", "m", typeref=r"\2"), R(r"^\t(\w+)(\([^)\n]*\))[^{\n]*$", "n", signature=r"\2")],
    "si", C_COMMENT,
)
nested(
    "Rust", "n:module s:struct i:interface c:implementation f:function g:enum t:typedef v:variable M:macro m:field e:enumerator P:method C:constant", "rs",
    [R(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*\{", "n", block="{"), R(r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "s", block="{"), R(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)", "i", block="{"), R(r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>', ]+\s+for\s+)?(\w+)", "c", block="{"), R(r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "g", block="{"),
     R(r"^(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+(\w+)\s*(?:<[^>]*>)?(\([^{;]*?\))", "f", block="{", signature=r"\2"), R(r"^[ \t]+(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)\s*(?:<[^>]*>)?(\([^{;]*?\))", "P", block="{", signature=r"\2"),
     R(r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)", "t"), R(r"^\s*(?:pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?(\w+)", "v"), R(r"^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+(\w+)\s*:", "C"), R(r"^\s*macro_rules!\s*(\w+)", "M", block="{"), R(r"^[ \t]+(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*([^,;{}()\n]+),\s*$", "m", typeref=r"\2")],
    "nsicg", r'"(?:\\.|[^"\\])*"|/\*.*?(?:\*/|\Z)|//[^\n]*', sep="::",
)
nested(
    "Kotlin", "p:package i:interface c:class o:object m:method T:typealias C:constant v:variable", "kt kts",
    [R(r"^\s*package\s+([\w.]+)", "p"), R(r"^\s*(?:\w+\s+)*interface\s+(\w+)", "i", block="{"), R(r"^\s*(?:(?:public|private|internal|open|abstract|sealed|data|inner|enum|annotation|value)\s+)*class\s+(\w+)", "c", block="{"), R(r"^\s*(?:companion\s+)?(?:data\s+)?object\s+(\w+)", "o", block="{"), R(r"^\s*(?:(?:public|private|internal|protected|open|override|suspend|inline|operator|infix|tailrec|abstract|final)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w<>?.]+\.)?(\w+)\s*(\([^{=]*?\))", "m", block="{", signature=r"\2"), R(r"^\s*typealias\s+(\w+)", "T"), R(r"^\s*(?:(?:public|private|internal|protected|override|const|lateinit)\s+)*val\s+(\w+)", "C"), R(r"^\s*(?:(?:public|private|internal|protected|override|lateinit)\s+)*var\s+(\w+)", "v")],
    "ico",
)
nested("Odin", "p:package f:proc c:const v:var s:struct e:enum u:union m:member n:enumerator t:type g:foreign i:importName", "odin", [R(r"^package\s+(\w+)", "p"), R(r"^(\w+)\s*::\s*(?:inline\s+)?proc\b[^(]*(\([^{]*?\))", "f", block="{", signature=r"\2"), R(r"^(\w+)\s*::\s*struct\b", "s", block="{"), R(r"^(\w+)\s*::\s*enum\b", "e", block="{"), R(r"^(\w+)\s*::\s*union\b", "u", block="{"), R(r"^(\w+)\s*::\s*distinct\b", "t"), R(r"^(\w+)\s*::\s*(?!\s|(?:inline\s+)?proc\b|struct\b|enum\b|union\b|distinct\b)", "c"), R(r"^(\w+)\s*:(?:\s*\w+\s*)?=", "v"), R(r"^\t(\w+)\s*:\s*([^,\n]+),", "m", typeref=r"\2")], "seu")
nested("V", "f:fn p:module v:variable c:const s:struct m:field n:method e:enumerator g:enum a:alias i:interface u:union", "v", [R(r"^module\s+(\w+)", "p"), R(r"^(?:pub\s+)?fn\s+(\w+)\s*(\([^{]*?\))", "f", block="{", signature=r"\2"), R(r"^(?:pub\s+)?fn\s+\([^)]*\)\s*(\w+)\s*(\([^{]*?\))", "n", block="{", signature=r"\2"), R(r"^(?:pub\s+)?struct\s+(\w+)", "s", block="{"), R(r"^(?:pub\s+)?enum\s+(\w+)", "g", block="{"), R(r"^(?:pub\s+)?interface\s+(\w+)", "i", block="{"), R(r"^(?:pub\s+)?union\s+(\w+)", "u", block="{"), R(r"^(?:pub\s+)?type\s+(\w+)\s*=", "a"), R(r"^(?:pub\s+)?const\s+(\w+)\s*=", "c"), R(r"^\t(\w+)\s+([\w\[\]&?.]+)\s*(?:=.*)?$", "m", typeref=r"\2")], "sgiu")
nested("TypeSpec", "n:namespace g:enum o:operation i:interface m:model u:union a:alias p:property e:enumerator", "tsp", [R(r"^\s*namespace\s+([\w.]+)", "n", block="{"), R(r"^\s*enum\s+(\w+)", "g", block="{"), R(r"^\s*interface\s+(\w+)", "i", block="{"), R(r"^\s*model\s+(\w+)", "m", block="{"), R(r"^\s*union\s+(\w+)", "u", block="{"), R(r"^\s*alias\s+(\w+)\s*=", "a"), R(r"^\s*(?:op\s+)(\w+)\s*\(", "o"), R(r"^[ \t]+(\w+)\??\s*:\s*([^;,\n]+)[;,]", "p", typeref=r"\2")], "ngimu")
nested("Haxe", "m:method c:class e:enum v:variable i:interface t:typedef", "hx", [R(r"^\s*(?:\w+\s+)*class\s+(\w+)", "c", block="{"), R(r"^\s*(?:\w+\s+)*interface\s+(\w+)", "i", block="{"), R(r"^\s*enum\s+(?:abstract\s+)?(\w+)", "e", block="{"), R(r"^\s*typedef\s+(\w+)", "t"), R(r"^\s*(?:\w+\s+)*function\s+(\w+)\s*(\([^{;]*?\))", "m", block="{", signature=r"\2"), R(r"^\s*(?:\w+\s+)*(?:var|final)\s+(\w+)", "v")], "cie")
nested("Flex", "f:function c:class i:interface P:package m:method p:property v:variable l:localvar- C:constant I:import x:mxtag", "as mxml", [R(r"^\s*package\s+([\w.]+)", "P", block="{"), R(r"^\s*(?:\w+\s+)*class\s+(\w+)", "c", block="{"), R(r"^\s*(?:\w+\s+)*interface\s+(\w+)", "i", block="{"), R(r"^\s*(?:\w+\s+)*function\s+(\w+)\s*(\([^{;]*?\))", "f", block="{", signature=r"\2"), R(r"^\s*(?:\w+\s+)*const\s+(\w+)", "C"), R(r"^\s*(?:\w+\s+)*var\s+(\w+)", "v"), R(r"^\s*import\s+([\w.*]+)", "I", role="imported")], "Pci")
nested(
    "Protobuf", "p:package m:message f:field e:enumerator g:enum s:service r:rpc o:oneof G:group D:protodef", "proto",
    [R(r"^[ \t]*package\s+([\w.]+)\s*;", "p"), R(r"^[ \t]*message\s+(\w+)", "m", block="{"), R(r"^[ \t]*enum\s+(\w+)", "g", block="{"), R(r"^[ \t]*service\s+(\w+)", "s", block="{"), R(r"^[ \t]*oneof\s+(\w+)", "o", block="{"), R(r"(?:^|(?<=[{;]))[ \t]*rpc\s+(\w+)\s*\(", "r"), R(r"^[ \t]*(?:(?:optional|required|repeated)\s+)?group\s+(\w+)", "G", block="{"),
     R(r"(?:^|(?<=[{;]))[ \t]*(?:(?:optional|required|repeated)\s+)?((?!(?:option|return|package|reserved|extensions|syntax|import)\b)[\w.]+|map\s*<[^>]*>)\s+(\w+)\s*=\s*\d+", "f", r"\2", mgroup=2, typeref=r"\1"), R(r"(?:^|(?<=[{;]))[ \t]+((?!option\b)\w+)\s*=\s*-?(?:0x)?\d+\s*(?:\[[^\]]*\])?\s*;", "e")],
    "mgsoG",
)
nested(
    "Thrift", "s:struct x:exception u:union n:namespace e:enumerator g:enum m:member C:const t:typedef v:service f:function z:parameter- Z:throwsparam- T:thriftFile", "thrift",
    [R(r"^[ \t]*namespace\s+(?:[\w*.]+)\s+([\w.]+)", "n"), R(r"^[ \t]*struct\s+(\w+)", "s", block="{"), R(r"^[ \t]*exception\s+(\w+)", "x", block="{"), R(r"^[ \t]*union\s+(\w+)", "u", block="{"), R(r"^[ \t]*enum\s+(\w+)", "g", block="{"), R(r"^[ \t]*service\s+(\w+)", "v", block="{"), R(r"^[ \t]*typedef\s+([\w.<>, ]+?)\s+(\w+)\s*$", "t", r"\2", mgroup=2, typeref=r"\1"),
     R(r"^[ \t]*const\s+([\w.]+(?:\s*<[^=\n]*>)?)\s+(\w+)\s*=", "C", r"\2", mgroup=2, typeref=r"\1"), R(r"^[ \t]*\d+\s*:\s*(?:(?:required|optional)\s+)?([\w.]+(?:\s*<[^\n;]*?>+)?)\s+(\w+)", "m", r"\2", mgroup=2, typeref=r"\1"),
     R(r"^[ \t]+(?:oneway\s+)?((?!(?:struct|service|throws)\b)[A-Za-z_][\w.]*(?:\s*<[^()\n]*>)?)\s+(\w+)\s*(\([^)]*\))", "f", r"\2", mgroup=2, typeref=r"\1", signature=r"\3"), R(r"^[ \t]+([A-Z]\w*)\s*(?:=\s*-?\d+)?\s*[,;]?[ \t]*$", "e")],
    "sxugv", C_HIDE + r"|#[^\n]*",
)
nested("Varlink", "i:interface m:method s:struct f:field g:enum e:enumerator E:error", "varlink", [R(r"^interface\s+([\w.]+)", "i"), R(r"^method\s+(\w+)\s*(\([^)]*\))", "m", signature=r"\2"), R(r"^type\s+(\w+)\s*\(", "s", block="("), R(r"^error\s+(\w+)", "E"), R(r"^[ \t]+(\w+)\s*:\s*([^,\n)]+)", "f", typeref=r"\2")], "s", r"#[^\n]*")

# --- scripting languages ------------------------------------------------------------------------------

PY_HIDE = r'"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*'


def _python(host) -> None:
    rules = (
        R(r"^([ \t]*)class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:", "c", r"\2", mgroup=2, block="indent"),
        R(r"^([ \t]*)(?:async\s+)?def\s+(\w+)\s*(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))(?:\s*->\s*([^:\n]+))?\s*:", "f", r"\2", mgroup=2, block="indent", signature=r"\3", typeref=r"\4"),
        R(r"^(\w+)\s*(?::\s*([^=\n]+))?=(?!=)", "v", typeref=r"\2"),
        R(r"^import\s+([\w.]+)\s*$", "i", role="imported"),
        R(r"^from\s+([\w.]+)\s+import\b", "i", role="namespace"),
        R(r"^import\s+[\w.]+\s+as\s+(\w+)", "I"),
    )
    host.multi(rules)
    host.entries.sort(key=lambda e: e["offset"])
    _braces(("c", "f"))(host)
    for e in host.entries:
        up = host.entries[e["scope_id"] - 1] if e.get("scope_id") else None
        if e["kind_letter"] == "f" and up and up["kind_letter"] in "cm" and up["kind"] == "class":
            e["kind"], e["kind_letter"] = "member", "m"


lang("Python", "c:class f:function m:member v:variable I:namespace i:module/imported,namespace,indirectlyImported Y:unknown z:parameter- l:local-", "py pyw pyx pxd pxi scons wsgi", function=_python, hide=PY_HIDE, aliases="python[23]* scons")
nested("GDScript", "c:class m:method v:variable C:const g:enum e:enumerator z:parameter- l:local- s:signal", "gd", [R(r"^(?:class_name|class)\s+(\w+)", "c"), R(r"^\s*(?:static\s+)?func\s+(\w+)\s*(\([^)]*\))", "m", block="indent", signature=r"\2"), R(r"^(?:@?\w+\s+)*var\s+(\w+)", "v"), R(r"^const\s+(\w+)", "C"), R(r"^enum\s+(\w+)", "g"), R(r"^signal\s+(\w+)", "s")], "m", PY_HIDE)


def _ends(openers: str, kinds_: tuple[str, ...]):
    """Ends by ``end`` keywords: each opener at a line's begin waits for the ``end`` with its indentation."""
    close = re.compile(r"^([ \t]*)end\b", re.M)

    def run(host) -> None:
        ends = [(host.line_of(m.start()), len(m.group(1).expandtabs())) for m in close.finditer(host.seen)]
        for e in host.entries:
            if e["kind_letter"] in kinds_ and not e.get("end"):
                own = host.line_text(e["line"])
                depth = len(own.expandtabs()) - len(own.expandtabs().lstrip())
                e["end"] = next((n for n, d in ends if n >= e["line"] and d == depth), None)

    return run


def keyword_nested(name: str, kind_text: str, ext: str, multi: list[Rule], parents: str, hide: str, sep: str = ".", **more) -> None:
    rules, ends, scope = tuple(multi), _ends("", tuple(parents)), _braces(tuple(parents))

    def run(host) -> None:
        host.multi(rules)
        host.entries.sort(key=lambda e: e["offset"])
        ends(host)
        scope(host)

    lang(name, kind_text, ext, function=run, hide=hide, default_separator=sep, **more)


keyword_nested(
    "Ruby", "c:class f:method m:module S:singletonMethod C:constant A:accessor a:alias L:library", "rb ruby",
    [R(r"^[ \t]*class\s+((?:\w+::)*\w+)", "c"), R(r"^[ \t]*module\s+((?:\w+::)*\w+)", "m"), R(r"^[ \t]*def\s+(?:self|\w+)\.([\w?!=]+)", "S"), R(r"^[ \t]*def\s+(?!self\.)([\w?!=+\-*/<>\[\]]+)\s*(\([^)\n]*\))?", "f", signature=r"\2"), R(r"^[ \t]*([A-Z]\w*)\s*=(?!=)", "C"), R(r"^[ \t]*attr_(?:reader|writer|accessor)\s+:(\w+)", "A"), R(r"^[ \t]*alias(?:_method)?\s+:?([\w?!=]+)", "a"), R(r"^[ \t]*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", "L", role="required")],
    "cmfS", r"(?m:^=begin.*?^=end)|" + HASH,
)
keyword_nested("Elixir", "p:protocol m:module f:function c:callback d:delegate e:exception g:guard i:implementation a:macro o:operator r:record t:test y:type", "ex exs", [R(r"^\s*defmodule\s+([\w.]+)", "m"), R(r"^\s*defprotocol\s+([\w.]+)", "p"), R(r"^\s*defimpl\s+([\w.]+)", "i"), R(r"^\s*defp?\s+([a-z_]\w*[?!]?)\s*(\([^)\n]*\))?", "f", signature=r"\2"), R(r"^\s*defmacrop?\s+(\w+[?!]?)", "a"), R(r"^\s*defguardp?\s+(\w+)", "g"), R(r"^\s*defdelegate\s+(\w+)", "d"), R(r"^\s*defexception\s+(\w+)", "e"), R(r"^\s*@callback\s+(\w+)", "c"), R(r"^\s*@(?:type|typep|opaque)\s+(\w+)", "y"), R(r"^\s*test\s+\"([^\"]+)\"", "t"), R(r"^\s*defrecordp?\s+:(\w+)", "r")], "mpi", r'""".*?"""|' + HASH)
keyword_nested("Lua", "f:function Y:unknown-", "lua", [R(r"^\s*(?:local\s+)?function\s+([\w.:]+)\s*(\([^)]*\))", "f", signature=r"\2"), R(r"^\s*(?:local\s+)?([\w.]+)\s*=\s*function\s*(\([^)]*\))", "f", signature=r"\2")], "f", r"--\[\[.*?\]\]|--[^\n]*")
keyword_nested("Julia", "c:constant f:function g:field m:macro n:module s:struct t:type Y:unknown", "jl", [R(r"^\s*(?:bare)?module\s+(\w+)", "n"), R(r"^\s*function\s+([\w.!]+)\s*(\([^)]*\))", "f", signature=r"\2"), R(r"^([\w.!]+)(\([^)=\n]*\))\s*=(?!=)", "f", signature=r"\2"), R(r"^\s*macro\s+(\w+)", "m"), R(r"^\s*(?:mutable\s+)?struct\s+(\w+)", "s"), R(r"^\s*(?:abstract|primitive)\s+type\s+(\w+)", "t"), R(r"^\s*const\s+(\w+)\s*=", "c")], "nsf", r'"""(?:\\.|[^\\])*?"""|' + HASH)
keyword_nested("MatLab", "f:function v:variable c:class", "m", [R(r"^\s*function\s+(?:[^=\n]*=\s*)?([\w.]+)", "f"), R(r"^\s*classdef\s+(?:\([^)]*\)\s*)?(\w+)", "c"), R(r"^\s*(\w+)\s*=(?!=)", "v")], "fc", r"%[^\n]*")
keyword_nested("Falcon", "c:class f:function m:member v:variable i:namespace", "fal ftd", [R(r"^\s*class\s+(\w+)", "c"), R(r"^\s*function\s+(\w+)", "f"), R(r"^\s*(?:load|import)\s+([\w.]+)", "i", role="imported"), R(r"^\s*(?:const|global|static)\s+(\w+)", "v")], "cf", C_COMMENT)
_PERL_HIDE = r"(?m:^=\w+.*?(?:^=cut\b[^\n]*|\Z))|(?m:^\s*#[^\n]*)"
lang("Perl", "c:constant f:format l:label p:package/used s:subroutine d:subroutineDeclaration- M:module- h:heredoc-", "pl pm ph plx perl", [R(r"^\s*package\s+([\w:']+)", "p", scope="set"), R(r"^\s*sub\s+([\w:']+)\s*(?:\([^)]*\)\s*)?(?:\{|$)", "s", scope="ref", block="{"), R(r"^\s*sub\s+([\w:']+)\s*(?:\([^)]*\)\s*)?;", "d"), R(r"^\s*use\s+constant\s+(\w+)", "c"), R(r"^\s*format\s+(\w+)\s*=", "f"), R(r"^\s*([A-Z_]+):\s*(?!:)", "l"), R(r"^\s*use\s+([A-Za-z][\w:]*)", "M", role="used")], hide=_PERL_HIDE, default_separator="::", aliases="cperl")
_RAKU = [R(r"^\s*(?:my\s+|our\s+)?class\s+([\w:]+)", "c", block="{"), R(r"^\s*(?:my\s+|our\s+)?grammar\s+([\w:]+)", "g", block="{"), R(r"^\s*(?:my\s+|our\s+)?role\s+([\w:]+)", "r", block="{"), R(r"^\s*(?:unit\s+)?module\s+([\w:]+)", "o", block="{"), R(r"^\s*(?:unit\s+)?package\s+([\w:]+)", "p", block="{"), R(r"^\s*(?:multi\s+|proto\s+|only\s+)?method\s+([\w-]+)", "m", block="{"), R(r"^\s*(?:multi\s+|proto\s+|only\s+|my\s+|our\s+)*sub\s+([\w-]+)", "s", block="{"), R(r"^\s*submethod\s+([\w-]+)", "b", block="{"), R(r"^\s*(?:multi\s+|proto\s+)?token\s+([\w-]+)", "t", block="{"), R(r"^\s*(?:multi\s+|proto\s+)?(?:rule|regex)\s+([\w-]+)", "u", block="{")]
nested("Raku", "c:class g:grammar m:method o:module p:package r:role u:rule b:submethod s:subroutine t:token", "raku rakumod rakutest rakudoc pm", _RAKU, "cgrop", _PERL_HIDE, sep="::")
nested("Perl6", "c:class g:grammar m:method o:module p:package r:role u:rule b:submethod s:subroutine t:token", "p6 pm6 pl6 t6", _RAKU, "cgrop", _PERL_HIDE, sep="::")
_SH = [R(r"^\s*(?:function\s+)?([\w:.+-]+)\s*\(\s*\)\s*(?=[{(]|$)", "f", block="{"), R(r"^\s*function\s+([\w:.+-]+)\s*(?=\{|$)", "f", block="{"), R(r"^\s*alias\s+([\w.-]+)=", "a"), R(r"^\s*(?:\.|source)\s+([^\s;#]+)", "s", role="loaded"), R(r"<<-?\s*['\"\\]?(\w+)['\"]?", "h")]
for _n, _e, _a in (("Sh", "sh SH bsh bash ksh ash", "sh bash ksh ash dash shell-script"), ("Zsh", "zsh", "zsh")):
    nested(_n, "a:alias f:function s:script/loaded h:heredoc", _e, _SH, "f", HASH, aliases=_a)
lang("Bats", "t:test S:script/loaded", "bats", [R(r"^@test\s+['\"]?(.+?)['\"]?\s*\{", "t"), R(r"^\s*load\s+['\"]?([^\s'\"]+)", "S", role="loaded")])
lang("Awk", "f:function", "awk gawk mawk", [R(r"^\s*func(?:tion)?\s+(\w+)\s*(\([^)]*\))?", "f", signature=r"\2", block="{")], hide=HASH, aliases="gawk mawk")
nested("Tcl", "p:procedure n:namespace z:parameter-", "tcl tk wish exp", [R(r"^\s*proc\s+([\w:.-]+)", "p"), R(r"^\s*namespace\s+eval\s+([\w:]+)", "n", block="{")], "n", r"(?m:^\s*#[^\n]*)", sep="::", aliases="expect tclsh")
nested("TclOO", "c:class m:method", "", [R(r"^\s*oo::class\s+create\s+([\w:]+)", "c", block="{"), R(r"^\s*method\s+(\w+)", "m")], "c", r"(?m:^\s*#[^\n]*)", sep="::")
nested("ITcl", "c:class m:method v:variable C:common p:procedure", "itcl", [R(r"^\s*(?:itcl::)?class\s+([\w:]+)", "c", block="{"), R(r"^\s*(?:(?:public|protected|private)\s+)?method\s+(\w+)", "m"), R(r"^\s*(?:(?:public|protected|private)\s+)?proc\s+(\w+)", "p"), R(r"^\s*(?:(?:public|protected|private)\s+)?variable\s+(\w+)", "v"), R(r"^\s*(?:(?:public|protected|private)\s+)?common\s+(\w+)", "C")], "c", r"(?m:^\s*#[^\n]*)", sep="::")
nested("PowerShell", "f:function v:variable c:class i:filter g:enum e:enumlabel", "ps1 psm1", [R(r"^\s*function\s+(?:\w+:)?([\w-]+)", "f", icase=True, block="{"), R(r"^\s*filter\s+([\w-]+)", "i", icase=True, block="{"), R(r"^\s*class\s+(\w+)", "c", icase=True, block="{"), R(r"^\s*enum\s+(\w+)", "g", icase=True, block="{"), R(r"^\s*(?:\[[^\]]+\]\s*)?\$(?:\w+:)?(\w+)\s*=(?!=)", "v")], "cfg", r"<#.*?#>|" + HASH)
lang("R", "f:function l:library/attached s:source g:globalVar v:functionVar z:parameter- c:vector L:list d:dataframe n:nameattr", "r R s q", [R(r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*(\([^)]*\))?", "f", exclusive=True, block="{", signature=r"\2"), R(r"^([\w.]+)\s*(?:<-|=)\s*list\s*\(", "L", exclusive=True), R(r"^([\w.]+)\s*(?:<-|=)\s*c\s*\(", "c", exclusive=True), R(r"^([\w.]+)\s*(?:<-|=)\s*data\.frame\s*\(", "d", exclusive=True), R(r"^([\w.]+)\s*(?:<-|=)(?!=)", "g", exclusive=True), R(r"^\s*(?:library|require)\s*\(\s*['\"]?([\w.]+)", "l", role="attached"), R(r"^\s*source\s*\(\s*['\"]([^'\"]+)", "s", role="source")], hide=HASH)


def _r6(host) -> None:
    """Classes, and in their lists methods, fields and active bindings."""
    s = host.seen
    for c in re.finditer(r"([\w.]+)\s*(?:<-|=)\s*R6(?:::R6)?Class\s*\(", s):
        host.add(R("", "c"), (c.group(), c.group(1)), c.start(1))
        owner, depth, part, at = len(host.entries), 1, "", 0
        for m in re.finditer(r"[()]|\b(public|private|active)\s*=\s*list\s*\(|([\w.]+)\s*=(?!=)\s*(function\b)?", s[c.end() :]):
            if m.group(1):
                depth += 1
                part, at = m.group(1), depth
            elif m.group(2):
                if part and depth == at:
                    host.add(R("", "a" if part == "active" else "m" if m.group(3) else "f"), (m.group(), m.group(2)), c.end() + m.start(2))
                    host.entries[-1]["scope_id"] = owner
            else:
                depth += 1 if m.group() == "(" else -1
                if depth < at:
                    part = ""
                if not depth:
                    break


lang("R6Class", "c:class m:method f:field a:activeBindingFunc", "", function=_r6, hide=r"(?m:#[^\n]*)")
lang("S4Class", "c:class r:repr g:generic m:method", "", [R(r"setClass\s*\(\s*['\"]([\w.]+)", "c"), R(r"setGeneric\s*\(\s*['\"]([\w.]+)", "g"), R(r"setMethod\s*\(\s*['\"]([\w.]+)", "m")])
_VIM = [R(r"^\s*:?\s*(?:export\s+)?(?:fu(?:nction)?!?|def)\s+([\w:.#]+)\s*(\([^)]*\))", "f", signature=r"\2"), R(r"^\s*com(?:mand)?!?\s+(?:-\S+\s+)*(\w+)", "c"), R(r"^\s*aug(?:roup)?!?\s+(?!END\b)(\S+)", "a"), R(r"^\s*(?:let|var)\s+([\w:#]+)\s*=", "v"), R(r"^\s*const\s+([\w:#]+)\s*=", "C"), R(r"^\s*[nvxsoilc]?(?:nore)?map!?\s+(?:<\w+>\s*)*(\S+)", "m")]
lang("Vim", "a:augroup c:command f:function m:map v:variable n:filename C:constant h:heredoc- k:class", "vim vba", _VIM, patterns="vimrc [._]vimrc gvimrc [._]gvimrc", hide=r'(?m:^\s*"[^\n]*)')
lang("Rake", "t:task n:namespace f:File d:directory m:multitask x:xtask", "rake", [R(r"^\s*task\s+[:'\"]?(\w+)", "t"), R(r"^\s*namespace\s+:?(\w+)", "n"), R(r"^\s*file\s+['\"]([^'\"]+)", "f"), R(r"^\s*directory\s+['\"]([^'\"]+)", "d"), R(r"^\s*multitask\s+:?(\w+)", "m"), R(r"^\s*xtask\s+:?(\w+)", "x")], patterns="Rakefile")
lang("RSpec", "d:describe c:context i:it", "", [R(r"^\s*(?:RSpec\.)?describe\s+['\"]?([^'\"\n]+?)['\"]?(?:,|\s+do)", "d"), R(r"^\s*context\s+['\"]([^'\"]+)", "c"), R(r"^\s*it\s+['\"]([^'\"]+)", "i")])
lang("GemSpec", "g:gem/runtimeDep,develDep", "gemspec", [R(r"\.name\s*=\s*['\"]([^'\"]+)", "g"), R(r"\.add_(?:runtime_)?dependency\s*\(?\s*['\"]([^'\"]+)", "g", role="runtimeDep"), R(r"\.add_development_dependency\s*\(?\s*['\"]([^'\"]+)", "g", role="develDep")])
lang("Moose", "c:class m:method a:attribute w:wrapper r:role", "", [R(r"^\s*has\s+['\"]?\+?(\w+)", "a"), R(r"^\s*(?:before|after|around)\s+['\"]?(\w+)", "w"), R(r"^\s*with\s+['\"]([\w:]+)", "r", role="with")])
lang("FunctionParameters", "m:method f:fun", "", [R(r"^\s*fun\s+(\w+)", "f"), R(r"^\s*method\s+(\w+)", "m")])

# --- Lisp and functional languages --------------------------------------------------------------------

_EL = r'"(?:\\.|[^"\\])*"|;[^\n]*'


def _lisp_forms(name: str, kind_text: str, ext: str, table: str, hide: str = _EL, **more) -> None:
    """``form:kind`` pairs: the name follows the form."""
    rules = [R(rf"^[ \t]*\({re.escape(form)}\s+['(]?([^\s()\"']+)(?:\s+(\([^()]*(?:\([^()]*\)[^()]*)*\)))?", letter, block="(", signature=r"\2" if letter in "fmsi" else "") for form, letter in (x.split("=") for x in table.split())]

    def run(host) -> None:
        host.multi(tuple(rules))
        host.entries.sort(key=lambda e: e["offset"])

    lang(name, kind_text, ext, function=run, hide=hide, **more)


_lisp_forms("EmacsLisp", "Y:unknown f:function v:variable c:const m:macro a:alias V:varalias s:subst i:inline e:error M:minorMode D:derivedMode C:custom G:group H:face T:theme", "el", "defun=f cl-defun=f defvar=v defvar-local=v defconst=c defmacro=m cl-defmacro=m defalias=a defvaralias=V defsubst=s define-inline=i define-error=e define-minor-mode=M define-derived-mode=D defcustom=C defgroup=G defface=H deftheme=T", patterns=".emacs", aliases="emacs-lisp")
_lisp_forms("Lisp", "Y:unknown f:function v:variable m:macro c:const t:type C:class s:struct M:method G:generic p:parameter", "cl clisp lisp lsp", "defun=f DEFUN=f defvar=v defmacro=m defconstant=c deftype=t defclass=C defstruct=s defmethod=M defgeneric=G defparameter=p", aliases="clisp")
_lisp_forms("Scheme", "Y:unknown f:function s:set", "SCM SM sch scheme scm sm rkt", "define=f set!=s", aliases="gosh guile racket")
_lisp_forms("Clojure", "Y:unknown f:function n:namespace m:macro", "clj cljs cljc", "defn=f defn-=f ns=n defmacro=m")
lang("Haskell", "t:type c:constructor f:function m:module", "hs", [R(r"^module\s+([\w.]+)", "m"), R(r"^(?:data|newtype|type|class)\s+(?:\([^)]*\)\s*=>\s*|\w+\s+\w+\s*=>\s*)?([A-Z]\w*)", "t"), R(r"^([a-z_][\w']*)\s*::", "f"), R(r"^\s*(?:\||=)\s*([A-Z]\w*)", "c")], hide=r"\{-.*?-\}|--[^\n]*")
lang("LiterateHaskell", "t:type c:constructor f:function m:module", "lhs", [R(r"^>\s*module\s+([\w.]+)", "m"), R(r"^>\s*(?:data|newtype|type|class)\s+([A-Z]\w*)", "t"), R(r"^>\s*([a-z_][\w']*)\s*::", "f")])
lang("Elm", "m:module n:namespace t:type c:constructor a:alias p:port f:function", "elm", [R(r"^(?:port\s+)?module\s+([\w.]+)", "m"), R(r"^import\s+[\w.]+\s+as\s+(\w+)", "n"), R(r"^type\s+alias\s+(\w+)", "a"), R(r"^type\s+(?!alias\b)(\w+)", "t"), R(r"^\s+(?:=|\|)\s*([A-Z]\w*)", "c"), R(r"^port\s+(?!module)(\w+)", "p"), R(r"^([a-z]\w*)\s*:(?!:)", "f")], hide=r"\{-.*?-\}|--[^\n]*")
lang("OCaml", "c:class m:method M:module v:var p:val t:type f:function C:Constructor r:RecordField e:Exception", "ml mli aug", [R(r"^\s*module\s+(?:type\s+)?(\w+)", "M"), R(r"^\s*(?:and|type)\s+(?:'\w+\s+|\([^)]*\)\s*)?([a-z_]\w*)\s*=", "t"), R(r"^\s*exception\s+(\w+)", "e"), R(r"^\s*class\s+(?:virtual\s+)?(\w+)", "c"), R(r"^\s*method\s+(?:private\s+|virtual\s+)*(\w+)", "m"), R(r"^\s*(?:let|and)\s+(?:rec\s+)?([a-z_][\w']*)\s+(?!=)[^=\n]*=", "f"), R(r"^\s*let\s+([a-z_][\w']*)\s*(?::[^=\n]+)?=", "v"), R(r"^\s*val\s+([a-z_][\w']*)\s*:", "p"), R(r"^\s*\|\s*([A-Z]\w*)(?!.*->)", "C")], hide=r"\(\*.*?\*\)", aliases="tuareg caml")
lang("SML", "e:exception f:function c:functor s:signature r:structure t:type v:value", "sml sig", [R(r"^\s*exception\s+(\w+)", "e"), R(r"^\s*fun\s+(?:'\w+\s+)?(\w+)", "f"), R(r"^\s*functor\s+(\w+)", "c"), R(r"^\s*signature\s+(\w+)", "s"), R(r"^\s*structure\s+(\w+)", "r"), R(r"^\s*(?:data|eq|abs)?type\s+(?:'\w+\s+)?(\w+)", "t"), R(r"^\s*val\s+(?:rec\s+)?(\w+)", "v")], hide=r"\(\*.*?\*\)")
lang("Erlang", "d:macro f:function m:module r:record t:type", "erl ERL hrl HRL", [R(r"^-module\(\s*(\w+)", "m"), R(r"^-define\(\s*(\w+)", "d"), R(r"^-record\(\s*(\w+)", "r"), R(r"^-(?:type|opaque)\s+(\w+)", "t"), R(r"^([a-z]\w*)\s*\(", "f")], hide=r"%[^\n]*")
lang("Prolog", "p:predicate g:grammar m:module", "pro prolog", [R(r"^:-\s*module\(\s*(\w+)", "m"), R(r"^([a-z]\w*)(?:\([^)]*\))?\s*-->", "g", exclusive=True), R(r"^([a-z]\w*)\s*(?:\(|:-|\.)", "p")], hide=r"%[^\n]*|/\*.*?\*/", aliases="swipl gprolog yap")
lang("Myrddin", "f:function c:constant v:var t:type r:trait p:pkg", "myr", [R(r"^\s*pkg\s+(\w+)", "p"), R(r"^\s*(?:generic|const)\s+(\w+)\s*=\s*\{", "f", exclusive=True), R(r"^\s*const\s+(\w+)", "c"), R(r"^\s*var\s+(\w+)", "v"), R(r"^\s*type\s+(\w+)", "t"), R(r"^\s*trait\s+(\w+)", "r")], hide=C_COMMENT)
lang("Inko", "o:class m:method t:trait a:attribute c:constant r:reopen", "inko", [R(r"^\s*(?:class|type)\s+(?:pub\s+)?(?:\w+\s+)?([A-Z]\w*)", "o", block="{"), R(r"^\s*trait\s+(?:pub\s+)?([A-Z]\w*)", "t", block="{"), R(r"^\s*impl\s+(?:[\w\[\], ]+\s+for\s+)?([A-Z]\w*)", "r", block="{"), R(r"^\s*(?:static\s+|async\s+|fn\s+)+(?:pub\s+)?(?:mut\s+|move\s+)?(\w+\??)", "m", block="{"), R(r"^\s*let\s+(?:pub\s+)?@(\w+)", "a"), R(r"^\s*let\s+(?:pub\s+)?([A-Z]\w*)\s*=", "c")], hide=HASH)

# --- line-oriented languages and formats -----------------------------------------------------------------


def _ini(host) -> None:
    current = None
    for n, at in enumerate(host.starts):
        s = host.line_text(n + 1)
        if not s or s[0].isspace() or s[0] in "#;" or s.startswith("//"):
            continue
        if m := re.match(r"\[([^\]]*(?:\]\][^\]]*)*)\]", s):
            if current:
                host._close(current, n)
            current = host.add(R("", "s"), (m.group(), m.group(1)), at)
        elif m := re.match(r"([\w.\-][^=:\s]*)\s*[=:]", s):
            k = host.add(R("", "k"), (m.group(), m.group(1)), at)
            if k:
                host.entries[k - 1]["scope_id"] = current
    if current:
        host._close(current, host.last)


lang("Iniconf", "s:section k:key", "ini conf", function=_ini)


def _sections(marks, fence: str = ""):
    """Documents with nested sections: ``marks(line, before) -> (level, title)``; a section closes those at or below it."""

    def run(host) -> None:
        open_: list[tuple[int, int]] = []
        inside, before = "", ""
        letters = [k.letter for k in host.spec.kinds]
        for n, at in enumerate(host.starts):
            s = host.line_text(n + 1)
            if fence and (m := re.match(fence, s)):
                mark = m.group(1)[:3]
                inside = "" if inside == mark else inside or mark
                before = ""
                continue
            found = None if inside else marks(s, before)
            if found:
                level, title, back = found
                while open_ and open_[-1][0] >= level:
                    host._close(open_.pop()[1], n - back)
                k = host.add(R("", letters[min(level, len(letters) - 1)]), (s, title), host.starts[n - back])
                if k:
                    host.entries[k - 1]["scope_id"] = open_[-1][1] if open_ else None
                    open_.append((level, k))
            before = s
        for _, k in open_:
            host._close(k, host.last)

    return run


def _md(s: str, before: str):
    if m := re.match(r" {0,3}(#{1,6})[ \t]+(.*?)(?:\s+#+)?\s*$", s):
        return len(m.group(1)) - 1, m.group(2), 0
    if re.match(r" {0,3}(=+|-+)\s*$", s) and before.strip() and not re.match(r"\s{4}|[-*+#>]|\d+\.", before):
        return (0 if "=" in s else 1), before.strip(), 1
    return None


lang("Markdown", "c:chapter s:section S:subsection t:subsubsection T:l4subsection u:l5subsection n:footnote h:hashtag", "md markdown", [R(r"^\[\^([^\]]+)\]:", "n")], function=_sections(_md, r"\s{0,3}(`{3,}|~{3,})"), default_separator='""')


def _prefix(pattern: str, base: int = 1):
    p = re.compile(pattern)
    return lambda s, before: (len(m.group(1)) - base, m.group(2).strip(), 0) if (m := p.match(s)) else None


_MARKS = ("RDoc", "h:L1Header i:L2Header j:L3Header k:L4Header l:L5Header m:L6Header", "rdoc", r"(={1,6})\s*(\S.*)"), ("Asciidoc", "c:chapter s:section S:subsection t:subsubsection T:l4subsection u:l5subsection a:anchor", "asc adoc asciidoc", r"(={1,6})\s+(\S.*?)(?:\s+=+)?$"), ("Org", "p:part c:chapter s:section u:subsection b:subsubsection P:paragraph G:subparagraph d:definition", "org", r"(\*{1,7})\s+(\S.*)"), ("Pod", "c:chapter s:section S:subsection t:subsubsection", "pod", None), ("Txt2tags", "s:section", "t2t", r"()=+\s*([^=]+?)\s*=+(?:\[\S+\])?\s*$"), ("Scdoc", "s:section S:subsection t:title", "scd", r"(#{1,2})\s+(\S.*)"), ("Abc", "s:section", "abc", r"()T:\s*(.+)")
for _n, _k, _e, _p in _MARKS:
    lang(_n, _k, _e, function=_sections(_prefix(_p) if _p else (lambda s, before: (int(m.group(1)) - 1, m.group(2).strip(), 0) if (m := re.match(r"=head([1-4])\s+(.+)", s)) else None)))
_RST_ORDER = "=-~^\"'+*#"


def _rst(host) -> None:
    seen: list[str] = []

    def marks(s: str, before: str):
        if len(s) >= 3 and len(set(s)) == 1 and s[0] in _RST_ORDER + "`:.<>_" and before.strip() and len(before.rstrip()) <= len(s) + 1 and not before[:1].isspace():
            if s[0] not in seen:
                seen.append(s[0])
            return seen.index(s[0]), before.strip(), 1
        return None

    _sections(marks)(host)


lang("ReStructuredText", "H:title c:chapter s:section S:subsection t:subsubsection C:citation T:target d:substdef h:subtitle", "rest reST rst", [R(r"^\.\.\s+_([^:]+):", "T"), R(r"^\.\.\s+\[([^\]]+)\]", "C"), R(r"^\.\.\s+\|([^|]+)\|", "d")], function=_rst)
_TEX_LEVELS = {"part": 0, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
lang(
    "Tex", "p:part c:chapter s:section u:subsection b:subsubsection P:paragraph G:subparagraph l:label i:xinput B:bibitem C:command o:operator e:environment t:theorem N:counter", "tex",
    [R(r"\\label\{([^}]+)\}", "l"), R(r"\\(?:input|include)\{([^}]+)\}", "i", role="included"), R(r"\\bibitem(?:\[[^\]]*\])?\{([^}]+)\}", "B"), R(r"\\(?:re)?newcommand\*?\{?\\(\w+)\}?", "C"), R(r"\\DeclareMathOperator\*?\{\\(\w+)\}", "o"), R(r"\\(?:re)?newenvironment\{(\w+)\}", "e"), R(r"\\newtheorem\*?\{(\w+)\}", "t"), R(r"\\newcounter\{(\w+)\}", "N")],
    function=_sections(lambda s, before: (_TEX_LEVELS[m.group(1)], m.group(2), 0) if (m := re.match(r"\s*\\(part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{([^}]*)\}", s)) else None),
)
lang("TeXBeamer", "f:frametitle g:framesubtitle", "", [R(r"\\frametitle\{([^}]+)\}", "f"), R(r"\\framesubtitle\{([^}]+)\}", "g")])
lang("BibTeX", "a:article b:book B:booklet c:conference i:inbook I:incollection j:inproceedings m:manual M:mastersthesis n:misc p:phdthesis P:proceedings s:string t:techreport u:unpublished", "bib", [R(rf"^\s*@{w}\s*\{{\s*([^,\s]+)", k, icase=True) for k, w in (x.split(":") for x in "a:article b:book B:booklet c:conference i:inbook I:incollection j:inproceedings m:manual M:mastersthesis n:misc p:phdthesis P:proceedings t:techreport u:unpublished".split())] + [R(r"^\s*@string\s*\{\s*(\w+)", "s", icase=True)])
lang("BibLaTeX", "A:artwork B:audio C:bibnote D:bookinbook G:collection H:commentary I:dataset J:image L:jurisdiction M:legislation N:legal O:letter P:movie Q:music o:online r:report t:thesis", "", [R(rf"^\s*@{w}\s*\{{\s*([^,\s]+)", k, icase=True) for k, w in (x.split(":") for x in "A:artwork B:audio C:bibnote D:bookinbook G:collection H:commentary I:dataset J:image L:jurisdiction M:legislation N:legal O:letter P:movie Q:music o:online r:report t:thesis".split())], base="")
lang("BETA", "f:fragment p:pattern- s:slot v:virtual", "bet", [R(r"^\s*-+\s*(\w+)\s*:", "f"), R(r"<<\s*SLOT\s+(\w+)", "s", icase=True), R(r"^\s*(\w+)\s*:<", "v"), R(r"^\s*(\w+)\s*:\s*\(#", "p")])
lang("Man", "t:title s:section S:subsection", "man 1 2 3 4 5 6 7 8 9 3pm 3stap 7stap", [R(r'^\.TH\s+"?([^"\s]+)', "t"), R(r'^\.SH\s+"?([^"]+?)"?\s*$', "s"), R(r'^\.SS\s+"?([^"]+?)"?\s*$', "S")])
lang("Diff", "m:modifiedFile n:newFile d:deletedFile h:hunk", "diff patch", [R(r"^---\s+(?:a/)?(?!/dev/null)([^\t\n]+)", "m"), R(r"^@@\s+(.*?)\s+@@", "h")])
lang("DosBatch", "l:label v:variable b:batchfile", "bat cmd", [R(r"^\s*:([A-Za-z_0-9]+)\s*$", "l"), R(r"^\s*set\s+(?:/[ap]\s+)?\"?(\w+)=", "v", icase=True), R(r"^\s*call\s+([\w.\\-]+\.(?:bat|cmd))", "b", icase=True, role="called")])
lang("OptionFile", "l:langdef k:kind", "", [R(r"^--langdef=([^{\s]+)", "l", scope="set"), R(r"^--kinddef-\S+?=.,([^,]+)", "k", scope="ref"), R(r"^--regex-\S+?=.*/.,([\w ]+)", "k", scope="ref")])
lang("Make", "m:macro t:target I:makefile/included", "mak mk", [R(r"^\s*(?:export\s+|override\s+)?([\w.-]+)\s*(?:::?|\?|\+|!)?=", "m", exclusive=True), R(r"^\s*define\s+(\S+)", "m"), R(r"^((?![.]PHONY\b)[^\s:=#$][^\s:=#]*)\s*::?(?!=)", "t"), R(r"^\s*-?s?include\s+(\S+)", "I", role="included")], patterns="[Mm]akefile GNUmakefile", hide=HASH, aliases="makefile makefile-gmake")
lang("Automake", "d:directory P:program M:man T:ltlibrary L:library S:script D:data c:condition s:subdir p:pseudodir-", "am", [R(r"^\s*(\w+)dir\s*=", "d"), R(r"^\s*\w+_PROGRAMS\s*\+?=\s*(\S+)", "P"), R(r"^\s*\w+_LTLIBRARIES\s*\+?=\s*(\S+)", "T"), R(r"^\s*\w+_LIBRARIES\s*\+?=\s*(\S+)", "L"), R(r"^\s*\w+_SCRIPTS\s*\+?=\s*(\S+)", "S"), R(r"^\s*\w+_DATA\s*\+?=\s*(\S+)", "D"), R(r"^\s*if\s+(\w+)", "c", role="branched"), R(r"^\s*SUBDIRS\s*=\s*(\S+)", "s", role="subdir")], patterns="Makefile.am GNUmakefile.am", aliases="makefile-automake")
lang("Autoconf", "p:package t:template m:macro w:optwith e:optenable s:subst c:condition d:definition", "ac", [R(r"^\s*AC_INIT\(\s*\[?([^\],)]+)", "p"), R(r"^\s*AC_ARG_WITH\(\s*\[?([^\],)]+)", "w"), R(r"^\s*AC_ARG_ENABLE\(\s*\[?([^\],)]+)", "e"), R(r"^\s*AC_SUBST\(\s*\[?(\w+)", "s"), R(r"^\s*AM_CONDITIONAL\(\s*\[?(\w+)", "c"), R(r"^\s*AC_DEFINE(?:_UNQUOTED)?\(\s*\[?(\w+)", "d"), R(r"^\s*A[CU]_DEFUN\(\s*\[?(\w+)", "m"), R(r"^\s*AH_TEMPLATE\(\s*\[?(\w+)", "t")], patterns="configure.in", hide=r"(?m:\bdnl\b[^\n]*)")
lang("M4", "d:macro I:macrofile/included", "m4 spt", [R(r"^\s*(?:m4_)?(?:define|defun)\(\s*[`\[]?(\w+)", "d"), R(r"\b(?:m4_)?s?include\(\s*[`\[]?([^'\])]+)", "I", role="included")], hide=r"(?m:\bdnl\b[^\n]*)")
lang("CMake", "f:function m:macro t:target v:variable D:option p:project M:module", "cmake", [R(r"^\s*function\s*\(\s*(\w+)", "f", icase=True), R(r"^\s*macro\s*\(\s*(\w+)", "m", icase=True), R(r"^\s*add_(?:executable|library|custom_target)\s*\(\s*([\w.\-]+)", "t", icase=True), R(r"^\s*set\s*\(\s*(\w+)", "v", icase=True), R(r"^\s*option\s*\(\s*(\w+)", "D", icase=True), R(r"^\s*project\s*\(\s*([\w.\-]+)", "p", icase=True), R(r"^\s*(?:include|find_package)\s*\(\s*(\w+)", "M", icase=True, role="included")], patterns="CMakeLists.txt", hide=HASH)
lang("Meson", "P:project V:variable S:subdir B:build c:custom t:test b:benchmark r:run m:module D:cfgdata C:cfgvar", "", [R(r"^\s*project\s*\(\s*'([^']+)'", "P"), R(r"^\s*(\w+)\s*=(?!=)", "V"), R(r"^\s*subdir\s*\(\s*'([^']+)'", "S"), R(r"\b(?:executable|library|static_library|shared_library)\s*\(\s*'([^']+)'", "B"), R(r"\bcustom_target\s*\(\s*'([^']+)'", "c"), R(r"^\s*test\s*\(\s*'([^']+)'", "t"), R(r"^\s*benchmark\s*\(\s*'([^']+)'", "b"), R(r"\brun_target\s*\(\s*'([^']+)'", "r"), R(r"\bimport\s*\(\s*'([^']+)'", "m", role="imported")], patterns="meson.build", hide=HASH)
lang("MesonOptions", "s:string b:boolean c:combo i:integer a:array f:feature", "", multi=[R(rf"option\s*\(\s*'([^']+)'[^)]*?type\s*:\s*'{t}'", k) for k, t in (x.split(":") for x in "s:string b:boolean c:combo i:integer a:array f:feature".split())], patterns="meson_options.txt")
lang("Kconfig", "c:config m:menu M:mainMenu k:kconfig C:choice v:variable", "", [R(r"^\s*(?:menu)?config\s+(\w+)", "c"), R(r'^\s*menu\s+"([^"]+)"', "m"), R(r'^\s*mainmenu\s+"([^"]+)"', "M"), R(r'^\s*source\s+"?([^"\s]+)', "k", role="source"), R(r"^\s*choice\s+(\w+)", "C"), R(r"^(\w[\w-]*)\s*:?=", "v")], patterns="Kconfig*", hide=HASH)
lang("PkgConfig", "N:name p:pkg v:var", "pc", [R(r"^Name:\s*(\S.*?)\s*$", "N"), R(r"^(?:Requires|Requires\.private|Conflicts):\s*([\w.+-]+)", "p", role="requires"), R(r"^(\w+)=", "v")], hide=HASH)
lang("JavaProperties", "k:key", "properties", [R(r"^\s*(?![#!])([^\s=:]+)\s*[=:]", "k")])
lang("Passwd", "u:username", "", [R(r"^([^:#]+):[^:]*:\d+:\d+:([^:]*):([^:]*):([^:]*)", "u")], patterns="passwd")
lang("Gdbinit", "d:definition D:document- t:toplevelVariable l:localVariable-", "gdb", [R(r"^\s*define\s+(\S+)", "d"), R(r"^\s*document\s+(\S+)", "D"), R(r"^set\s+\$(\w+)", "t")], patterns=".gdbinit", hide=HASH)
lang("Forth", "w:word v:variable c:constant", "fth forth fs 4th", [R(r"^\s*:\s+(\S+)", "w"), R(r"^\s*(?:2|f)?variable\s+(\S+)", "v", icase=True), R(r"\S+\s+(?:2|f)?constant\s+(\S+)", "c", icase=True)], hide=r"(?m:(?:^|\s)\\ [^\n]*)")
_FORTRAN = [R(r"^\s*program\s+(\w+)", "p", icase=True), R(r"^\s*module\s+(?!procedure\b)(\w+)", "m", icase=True), R(r"^\s*submodule\s*\([^)]*\)\s*(\w+)", "S", icase=True), R(r"^\s*(?:(?:pure|elemental|recursive|impure)\s+)*subroutine\s+(\w+)\s*(\([^)]*\))?", "s", icase=True, signature=r"\2"), R(r"^\s*(?:(?:pure|elemental|recursive|integer|real|logical|complex|character|double\s+precision|type\s*\([^)]*\))(?:\s*\([^)]*\))?\s+)*function\s+(\w+)\s*(\([^)]*\))?", "f", icase=True, signature=r"\2"), R(r"^\s*(?:abstract\s+)?interface\s+(\w+)", "i", icase=True), R(r"^\s*type(?:\s*,[^:\n]*)?\s*(?:::)?\s*(?!\()(\w+)\s*$", "t", icase=True), R(r"^\s*namelist\s*/(\w+)/", "n", icase=True), R(r"^\s*common\s*/(\w+)/", "c", icase=True), R(r"^\s*block\s*data\s+(\w+)", "b", icase=True), R(r"^\s*entry\s+(\w+)", "e", icase=True), R(r"^\s*(?:integer|real|logical|complex|character|type\s*\(\s*\w+\s*\))(?:\s*\([^)]*\))?(?:\s*,[^:\n]*)?\s*::\s*(\w+)", "v", icase=True), R(r"^\s*(\d+)\s+\w", "l")]
lang("Fortran", "b:blockData c:common e:entry E:enum f:function i:interface k:component l:label L:local- m:module M:method n:namelist N:enumerator p:program P:prototype- s:subroutine t:type v:variable S:submodule", "f for ftn f77 f90 f95 f03 f08 f15 F FOR FTN F77 F90 F95 F03 F08 F15", _FORTRAN, hide=r"(?m:![^\n]*)|(?m:^[cC*][^\n]*)")
lang("Fypp", "m:macro", "fy", [R(r"^\s*#:def\s+(\w+)", "m")])
lang("Pascal", "f:function p:procedure", "p pas", [R(r"^\s*(?:class\s+)?function\s+([\w.]+)", "f", icase=True), R(r"^\s*(?:class\s+)?(?:procedure|constructor|destructor)\s+([\w.]+)", "p", icase=True)], hide=r"\{.*?\}|\(\*.*?\*\)|//[^\n]*")
lang("Ada", "P:packspec p:package t:type u:subtype c:component l:literal v:variable n:constant x:exception r:subprogram k:task o:protected", "adb ads Ada ada", [R(r"^\s*package\s+body\s+([\w.]+)", "p", icase=True), R(r"^\s*package\s+(?!body\b)([\w.]+)", "P", icase=True), R(r"^\s*(?:overriding\s+)?(?:procedure|function)\s+(\w+)", "r", icase=True), R(r"^\s*type\s+(\w+)", "t", icase=True), R(r"^\s*subtype\s+(\w+)", "u", icase=True), R(r"^\s*task\s+(?:body\s+|type\s+)?(\w+)", "k", icase=True), R(r"^\s*protected\s+(?:body\s+|type\s+)?(\w+)", "o", icase=True), R(r"^\s*(\w+)\s*:\s*exception", "x", icase=True), R(r"^\s*(\w+)\s*:\s*constant\b", "n", icase=True)], hide=DASHES)
lang("Eiffel", "c:class f:feature l:local-", "e", [R(r"^\s*(?:deferred\s+|expanded\s+|frozen\s+)*class\s+(\w+)", "c", icase=True), R(r"^\t(\w+)(?:\s*\([^)]*\))?(?:\s*:\s*\w+)?\s*(?:is\b|do\b|$)", "f")], hide=DASHES)
lang("Basic", "c:constant f:function l:label t:type v:variable g:enum n:namespace", "bas bi bm bb pb", [R(r"^\s*(?:declare\s+)?(?:function|sub)\s+(\w+)", "f", icase=True), R(r"^\s*(?:const|#define)\s+(\w+)", "c", icase=True), R(r"^\s*type\s+(\w+)", "t", icase=True), R(r"^\s*enum\s+(\w+)", "g", icase=True), R(r"^\s*dim\s+(?:shared\s+)?(\w+)", "v", icase=True), R(r"^\s*namespace\s+(\w+)", "n", icase=True), R(r"^\s*(\w+):\s*$", "l")], hide=r"(?m:'[^\n]*)")
lang("Asp", "d:constant c:class f:function s:subroutine v:variable", "asp asa", [R(r"^\s*(?:public\s+|private\s+)?function\s+(\w+)", "f", icase=True), R(r"^\s*(?:public\s+|private\s+)?sub\s+(\w+)", "s", icase=True), R(r"^\s*class\s+(\w+)", "c", icase=True), R(r"^\s*const\s+(\w+)", "d", icase=True), R(r"^\s*dim\s+(\w+)", "v", icase=True)])
lang("AutoIt", "f:func r:region g:global l:local S:script/included", "au3 AU3 aU3 Au3", [R(r"^\s*func\s+(\w+)\s*(\([^)]*\))", "f", icase=True, signature=r"\2"), R(r"^\s*#region\s+(.+)", "r", icase=True), R(r"^\s*global\s+(?:const\s+)?(\$\w+)", "g", icase=True), R(r"^\s*local\s+(?:const\s+)?(\$\w+)", "l", icase=True), R(r"^\s*#include\s+[<\"]([^>\"]+)", "S", icase=True, role="included")])
lang("REXX", "s:subroutine", "rexx rx", [R(r"^\s*(\w+)\s*:", "s")], hide=r"/\*.*?\*/")
lang("SLang", "f:function n:namespace", "sl", [R(r"^\s*define\s+(\w+)", "f"), R(r"^\s*(?:implements|use_namespace)\s*\(\s*\"(\w+)", "n")], hide=r"%[^\n]*")
lang("Abaqus", "p:part a:assembly s:step", "inp", [R(r"^\*part,\s*name=([^,\s]+)", "p", icase=True), R(r"^\*assembly,\s*name=([^,\s]+)", "a", icase=True), R(r"^\*step,\s*name=([^,\s]+)", "s", icase=True)])
lang("SINEX", "b:block", "snx sinex", [R(r"^\+(\S+)", "b")])
lang("NSIS", "s:section f:function v:variable d:definition m:macro S:sectionGroup p:macroparam- l:langstr i:script", "nsi nsh", [R(r'^\s*section\s+(?:/o\s+)?"?([^"\n]+?)"?(?:\s+\w+)?\s*$', "s", icase=True), R(r"^\s*function\s+([\w.]+)", "f", icase=True), R(r"^\s*var\s+(?:/global\s+)?(\w+)", "v", icase=True), R(r"^\s*!define\s+(?:/\w+\s+)*(\w+)", "d", icase=True), R(r"^\s*!macro\s+(\w+)", "m", icase=True), R(r"^\s*sectiongroup\s+(?:/e\s+)?\"?([^\"\n]+)", "S", icase=True), R(r"^\s*langstring\s+(\w+)", "l", icase=True), R(r"^\s*!include\s+\"?([^\"\s]+)", "i", icase=True, role="included")], hide=r"(?m:^\s*[;#][^\n]*)")
lang("Asm", "d:define l:label m:macro t:type z:parameter-", "asm ASM s S", [R(r"^([A-Za-z_.$][\w.$@]*):", "l"), R(r"^\s*([A-Za-z_]\w*)\s+equ\b", "d", icase=True), R(r"^\s*#\s*define\s+(\w+)", "d"), R(r"^\s*\.?macro\s+(\w+)", "m", icase=True), R(r"^\s*(\w+)\s+macro\b", "m", icase=True), R(r"^\s*(\w+)\s+struc?\b", "t", icase=True)], hide=r"/\*.*?\*/")
lang("DTS", "p:phandler l:label", "dts dtsi", [R(r"^\s*(\w+)\s*:\s*[\w@,-]+\s*\{", "l"), R(r"&(\w+)\s*\{", "p")], hide=C_COMMENT)
lang("WindRes", "d:dialog m:menu i:icon b:bitmap c:cursor f:font v:version a:accelerators", "rc", [R(rf"^\s*(\w+)\s+{w}\b", k, icase=True) for k, w in (x.split("=") for x in "d=DIALOG(?:EX)? m=MENU(?:EX)? i=ICON b=BITMAP c=CURSOR f=FONT v=VERSIONINFO a=ACCELERATORS".split())], hide=C_COMMENT)
_COBOL = [R(r"^.{0,7}\s*program-id\.\s*([\w-]+)", "P", icase=True), R(r"^.{0,7}\s*([\w-]+)\s+division\s*\.", "D", icase=True), R(r"^.{0,7}\s*([\w-]+)\s+section\s*\.", "s", icase=True), R(r"^.{0,7}\s*[fs]d\s+([\w-]+)", "f", icase=True), R(r"^.{0,7}\s*01\s+([\w-]+)", "g", icase=True), R(r"^.{0,7}\s*(?!01)\d\d\s+(?!filler\b)([\w-]+)", "d", icase=True), R(r"^.{6} {1,4}([\w-]+)\s*\.\s*$", "p", icase=True), R(r"\bcopy\s+[\"']?([\w.-]+)", "S", icase=True, role="copied")]
for _n, _e in (("cbl", "cbl cob CBL COB"), ("CobolFree", ""), ("CobolVariable", "")):
    lang(_n, "f:fd g:group P:program s:section D:division p:paragraph d:data S:sourcefile", _e, _COBOL)
_VERILOG = [R(r"^\s*(?:macro)?module\s+(\w+)", "m"), R(r"^\s*`define\s+(\w+)", "d"), R(r"^\s*function\s+(?:automatic\s+)?(?:[\w:\[\]$ ]+\s+)?(\w+)\s*[;(]", "f"), R(r"^\s*task\s+(?:automatic\s+)?(\w+)", "t"), R(r"^\s*(?:input|output|inout)\s+(?:(?:wire|reg|logic|signed)\s+)*(?:\[[^\]]*\]\s*)?(\w+)", "p"), R(r"^\s*reg\s+(?:\[[^\]]*\]\s*)?(\w+)", "r"), R(r"^\s*(?:wire|tri|wand|wor)\s+(?:\[[^\]]*\]\s*)?(\w+)", "n"), R(r"^\s*(?:parameter|localparam)\s+(?:\w+\s+)?(?:\[[^\]]*\]\s*)?(\w+)\s*=", "c"), R(r"^\s*event\s+(\w+)", "e"), R(r"\bbegin\s*:\s*(\w+)", "b")]
lang("Verilog", "c:constant d:define e:event f:function m:module n:net p:port r:register t:task b:block i:instance", "vh", _VERILOG, hide=C_COMMENT)
lang("SystemVerilog", "c:constant d:define e:event f:function m:module n:net p:port r:register t:task b:block i:instance A:assert C:class V:covergroup E:enum I:interface M:modport K:package P:program R:property S:struct T:typedef", "sv svh svi", [*_VERILOG, R(r"^\s*(?:virtual\s+)?class\s+(\w+)", "C"), R(r"^\s*interface\s+(\w+)", "I"), R(r"^\s*package\s+(\w+)", "K"), R(r"^\s*program\s+(\w+)", "P"), R(r"^\s*covergroup\s+(\w+)", "V"), R(r"^\s*modport\s+(\w+)", "M"), R(r"^\s*property\s+(\w+)", "R"), R(r"^\s*\}\s*(\w+)\s*;", "T")], hide=C_COMMENT)
lang("VHDL", "c:constant t:type T:subtype r:record e:entity C:component- d:prototype- f:function p:procedure P:package l:local- a:architecture q:port g:generic s:signal Q:process v:variable A:alias", "vhdl vhd", [R(r"^\s*entity\s+(\w+)", "e", icase=True), R(r"^\s*architecture\s+(\w+)", "a", icase=True), R(r"^\s*package\s+(?:body\s+)?(\w+)", "P", icase=True), R(r"^\s*(?:pure\s+|impure\s+)?function\s+(\w+)", "f", icase=True), R(r"^\s*procedure\s+(\w+)", "p", icase=True), R(r"^\s*constant\s+(\w+)", "c", icase=True), R(r"^\s*type\s+(\w+)", "t", icase=True), R(r"^\s*subtype\s+(\w+)", "T", icase=True), R(r"^\s*signal\s+(\w+)", "s", icase=True), R(r"^\s*(\w+)\s*:\s*process\b", "Q", icase=True), R(r"^\s*(?:shared\s+)?variable\s+(\w+)", "v", icase=True), R(r"^\s*alias\s+(\w+)", "A", icase=True)], hide=DASHES)
lang("TTCN", "M:module t:type c:const d:template f:function s:signature C:testcase a:altstep G:group v:var T:timer p:port", "ttcn ttcn3", [R(rf"^\s*{w}\s+(?:\w+\s+)?(\w+)\s*[({{=;]?", k) for k, w in (x.split(":") for x in "M:module f:function C:testcase a:altstep s:signature G:group T:timer".split())] + [R(r"^\s*type\s+(?:record|set|union|enumerated|component|port)\s+(?:of\s+\w+\s+)?(\w+)", "t"), R(r"^\s*const\s+\w+\s+(\w+)", "c"), R(r"^\s*template\s+\w+\s+(\w+)", "d"), R(r"^\s*var\s+\w+\s+(\w+)", "v")], hide=C_COMMENT)
_SQL_KINDS = "C:ccflag D:domain E:field L:label P:package R:service S:schema T:trigger U:publication V:view b:database c:cursor d:prototype- e:event f:function i:index k:type l:local- n:synonym p:procedure r:record- s:subtype t:table u:user v:variable x:mltable y:mlconn z:mlprop"
_SQL = [R(rf"^\s*(?:create|alter)\s+(?:or\s+replace\s+)?(?:global\s+|local\s+|temp(?:orary)?\s+|unique\s+|materialized\s+|editionable\s+)*{w}\s+(?:if\s+not\s+exists\s+)?[`\"\[]?(?:\w+[`\"\]]?\.[`\"\[]?)?(\w+)", k, icase=True) for k, w in (x.split(":") for x in "t:table V:view f:function p:procedure i:index T:trigger S:schema b:database D:domain k:type P:package n:synonym e:event u:user U:publication".split())]
lang("SQL", _SQL_KINDS, "sql", [*_SQL, R(r"^\s*(?:declare\s+)?cursor\s+(\w+)", "c", icase=True), R(r"^\s*function\s+(\w+)", "f", icase=True), R(r"^\s*procedure\s+(\w+)", "p", icase=True), R(r"^\s*<<(\w+)>>", "L")], hide=r"/\*.*?\*/|--[^\n]*", aliases="pgsql")
lang("RpmSpec", "t:tag m:macro p:package g:global P:patch b:bcond", "spec", [R(r"^\s*([A-Z]\w*)\s*:", "t"), R(r"^\s*%define\s+(\w+)", "m"), R(r"^\s*%global\s+(\w+)", "g"), R(r"^\s*%package\s+(?:-n\s+)?(\S+)", "p"), R(r"^\s*%bcond_(?:with|without)\s+(\w+)", "b"), R(r"^\s*%patch\s*(\d+)", "P", role="decl")], hide=HASH, aliases="rpm-spec")
lang("RpmMacros", "m:macro", "rpmmacros", [R(r"^%(\w+)(?:\([^)]*\))?\s", "m")], hide=HASH)
lang("SystemdUnit", "u:unit/Requires,Wants,After,Before,RequiredBy,WantedBy", "service socket device mount automount swap target path timer snapshot slice", [R(rf"^{r}\s*=\s*(\S+)", "u", role=r) for r in ("Requires", "Wants", "After", "Before", "RequiredBy", "WantedBy")])
lang("DBusService", "n:name", "", [R(r"^Name\s*=\s*(\S+)", "n")])
lang("YumRepo", "r:repoid", "repo", [R(r"^\[([^\]]+)\]", "r")])
lang("PythonEntryPoints", "c:console g:gui", "", multi=[R(r"^\[console_scripts\][^\[]*?^(\w[\w-]*)\s*=", "c"), R(r"^\[gui_scripts\][^\[]*?^(\w[\w-]*)\s*=", "g")], patterns="entry_points.txt")
lang("PythonLoggingConfig", "L:loggerSection q:qualname", "", [R(r"^\[logger_(\w+)\]", "L"), R(r"^qualname\s*=\s*(\S+)", "q")])
lang("Robot", "t:testcase k:keyword v:variable", "robot", [R(r"^([$@&]\{[^}]+\})", "v")], multi=[R(r"^\*+\s*Test Cases?\s*\**[ \t]*\n(?:(?:[ \t#].*)?\n)*^(\w[^\n]*)", "t"), R(r"^\*+\s*Keywords?\s*\**[ \t]*\n(?:(?:[ \t#].*)?\n)*^(\w[^\n]*)", "k")])
lang("GoMod", "m:module", "", [R(r"^module\s+(\S+)", "m"), R(r"^\s*(?:require\s+)?([\w.\-]+\.[\w./\-]+)\s+v\d", "m", role="required")], patterns="go.mod", hide=r"//[^\n]*")


def _toml(host) -> None:
    current = None
    for n, at in enumerate(host.starts):
        s = host.line_text(n + 1)
        if m := re.match(r"\s*(\[\[?)\s*([^\]]+?)\s*\]\]?", s):
            if current:
                host._close(current, n)
            current = host.add(R("", "a" if m.group(1) == "[[" else "t"), (m.group(), m.group(2)), at)
        elif m := re.match(r"\s*([\w\"'.-]+)\s*=", s):
            for letter in "kK":
                k = host.add(R("", letter), (m.group(), m.group(1).strip("\"'")), at)
                if k:
                    host.entries[k - 1]["scope_id"] = current
    if current:
        host._close(current, host.last)


lang("TOML", "k:key- t:table a:arraytable K:qkey", "toml", function=_toml)
lang("Cargo", "p:package c:crate/dep", "", multi=[R(r"^\[package\][^\[]*?^name\s*=\s*\"([^\"]+)\"", "p"), R(r"^\[(?:dev-|build-)?dependencies\.([\w-]+)\]", "c", role="dep")], patterns="Cargo.toml")
lang("Yaml", "a:anchor/alias", "yml yaml", [R(r"(?:^|\s)&(\w+)", "a"), R(r"(?:^|\s)\*(\w+)", "a", role="alias")], hide=HASH)
lang("YamlFrontMatter", "t:title", "", multi=[R(r"\A---\n(?:.*\n)*?title:\s*[\"']?([^\"'\n]+)", "t")])
lang("FrontMatter", "t:title", "", multi=[R(r"\A---\n(?:.*\n)*?title:\s*[\"']?([^\"'\n]+)", "t")])
lang("AnsiblePlaybook", "p:play", "", [R(r"^\s*-\s+name:\s*(.+?)\s*$", "p")])
lang("OpenAPI", "d:schema p:path R:response P:parameter t:title s:server T:tag", "", [R(r"^\s+(/[^\s:]*):\s*$", "p"), R(r"^\s+title:\s*(.+)$", "t"), R(r"^\s+-\s+url:\s*(\S+)", "s")], patterns="openapi.yaml")
lang("I18nRubyGem", "k:key m:keyInMiddle- l:locale-", "", [R(r"^(\w{2}(?:-\w+)?):\s*$", "l"), R(r"^\s+(\w+):\s*\S", "k"), R(r"^\s+(\w+):\s*$", "m")])


def _json(host) -> None:
    """Keys of objects with the kind of their values; scopes are the objects and arrays around them."""
    token = re.compile(r'"((?:\\.|[^"\\])*)"\s*(:)?|([{\[])|([}\]])|(-?\d[\d.eE+-]*)|(true|false)|(null)')
    stack: list[tuple[int | None, list]] = []
    key: tuple[str, int] | None = None
    for m in token.finditer(host.text):
        string, colon, open_, close, number, boolean, null = m.groups()
        if string is not None and colon:
            key = (string, m.start())
            continue
        if close:
            if stack:
                k, _ = stack.pop()
                if k:
                    host.entries[k - 1]["end"] = host.line_of(m.start())
            continue
        letter = {"{": "o", "[": "a"}.get(open_ or "") or ("s" if string is not None else "n" if number else "b" if boolean else "z")
        up = next((k for k, _ in reversed(stack) if k), None)
        made = None
        name = key[0] if key else str(stack[-1][1][0]) if stack and stack[-1][1] is not None and stack[-1][1] != [] else None
        if stack and stack[-1][1]:
            stack[-1][1][0] += 1
        if name is not None and (key or stack):
            made = host.add(R("", letter), (name, name), key[1] if key else m.start())
            if made:
                host.entries[made - 1]["scope_id"] = up
        key = None
        if open_:
            stack.append((made, [0] if open_ == "[" else []))


lang("JSON", "o:object a:array n:number s:string b:boolean z:null", "json", function=_json)
nested("CSS", "c:class s:selector i:id", "css", [R(r"(?:^|[\s,}])\.([A-Za-z_][\w-]*)(?=[^{};]*\{)", "c"), R(r"(?:^|[\s,}])#([A-Za-z_][\w-]*)(?=[^{};]*\{)", "i"), R(r"^([A-Za-z][\w-]*)(?=\s*[,{])", "s")], "", C_HIDE)
nested("SCSS", "m:mixin f:function v:variable c:class P:placeholder i:id z:parameter n:namespace M:module", "scss", [R(r"^\s*@mixin\s+([\w-]+)\s*(\([^)]*\))?", "m", block="{", signature=r"\2"), R(r"^\s*@function\s+([\w-]+)\s*(\([^)]*\))?", "f", block="{", signature=r"\2"), R(r"^\s*\$([\w-]+)\s*:", "v"), R(r"^\s*\.([\w-]+)", "c", block="{"), R(r"^\s*%([\w-]+)", "P", block="{"), R(r"^\s*#([A-Za-z][\w-]*)", "i", block="{"), R(r"^\s*@use\s+[\"']([^\"']+)", "M", role="used")], "mc", r"/\*.*?\*/|//[^\n]*")
nested("LdScript", "S:section s:symbol v:version i:inputSection", "lds scr ld ldi", [R(r"^\s*(\.[\w.]+)\s*(?:\d\w*)?\s*:\s*", "S", block="{"), R(r"^\s*(?:PROVIDE(?:_HIDDEN)?\s*\(\s*)?([A-Za-z_]\w*)\s*[+-]?=", "s"), R(r"^(\w+)\s*\{", "v")], "S", patterns="*.lds.S *.ld.S ld.script", aliases="ld-script")
nested("Nftables", "t:table c:chain s:set m:map D:definition C:counter l:limit Q:quota", "nft", [R(r"^\s*(?:add\s+)?table\s+(?:\w+\s+)?(\w+)", "t", block="{"), R(r"^\s*(?:add\s+)?chain\s+(?:\w+\s+\w+\s+)?(\w+)", "c", block="{"), R(r"^\s*set\s+(\w+)", "s", block="{"), R(r"^\s*map\s+(\w+)", "m", block="{"), R(r"^\s*define\s+(\w+)", "D"), R(r"^\s*counter\s+(\w+)\s*\{", "C"), R(r"^\s*limit\s+(\w+)\s*\{", "l"), R(r"^\s*quota\s+(\w+)\s*\{", "Q")], "t", HASH)
nested("PuppetManifest", "c:class d:definition n:node r:resource v:variable p:param V:vresource t:type", "pp", [R(r"^\s*class\s+([\w:]+)", "c", block="{"), R(r"^\s*define\s+([\w:]+)", "d", block="{"), R(r"^\s*node\s+['\"]?([\w.-]+)", "n", block="{"), R(r"^\s*(?![@$])(?:[a-z][\w:]*)\s*\{\s*['\"]([^'\"]+)['\"]\s*:", "r"), R(r"^\s*@\w[\w:]*\s*\{\s*['\"]([^'\"]+)['\"]\s*:", "V"), R(r"^\s*\$(\w+)\s*=", "v"), R(r"^\s*type\s+([\w:]+)\s*=", "t")], "cdn", HASH, sep="::")
nested("Terraform", "r:resource d:data v:variable p:provider m:module o:output l:local", "tf", [R(r'^\s*resource\s+"[^"]+"\s+"([^"]+)"', "r", block="{"), R(r'^\s*data\s+"[^"]+"\s+"([^"]+)"', "d", block="{"), R(r'^\s*variable\s+"([^"]+)"', "v", block="{"), R(r'^\s*provider\s+"([^"]+)"', "p", block="{"), R(r'^\s*module\s+"([^"]+)"', "m", block="{"), R(r'^\s*output\s+"([^"]+)"', "o", block="{")], "", r"/\*.*?\*/|//[^\n]*|" + HASH)
lang("TerraformVariables", "v:variable", "tfvars", [R(r"^\s*([\w-]+)\s*=", "v", role="assigned")], hide=HASH)
nested("SystemTap", "p:probe f:function v:variable m:macro", "stp stpm", [R(r"^\s*probe\s+([^\s{=,]+)", "p", block="{"), R(r"^\s*(?:private\s+)?function\s+(\w+)", "f", block="{"), R(r"^\s*global\s+(\w+)", "v"), R(r"^\s*@define\s+(\w+)", "m")], "", C_COMMENT + "|" + HASH, aliases="stap")
lang("SELinuxInterface", "i:interface t:template", "if", [R(r"^\s*interface\(\s*`(\w+)'", "i"), R(r"^\s*template\(\s*`(\w+)'", "t")])
lang("SELinuxTypeEnforcement", "m:module t:type a:alias T:attr r:role R:rattr b:tunable u:user", "te", [R(r"^\s*policy_module\(\s*(\w+)", "m"), R(r"^\s*type\s+(\w+)", "t"), R(r"\balias\s+\{?\s*(\w+)", "a"), R(r"^\s*attribute\s+(\w+)", "T"), R(r"^\s*role\s+(\w+)", "r"), R(r"^\s*attribute_role\s+(\w+)", "R"), R(r"^\s*gen_tunable\(\s*(\w+)", "b")], hide=HASH)
lang("GPerf", "k:keyword h:hfunc l:lfunc c:class s:strpool", "perf gperf", [R(r"^%define\s+hash-function-name\s+(\w+)", "h"), R(r"^%define\s+lookup-function-name\s+(\w+)", "l"), R(r"^%define\s+class-name\s+(\w+)", "c"), R(r"^%define\s+string-pool-name\s+(\w+)", "s")], multi=[])
lang("YACC", "t:token l:label", "y", [R(r"^\s*%token\s+(?:<[^>]+>\s*)?(\w+)", "t"), R(r"^([A-Za-z_][\w.]*)\s*:", "l")], hide=C_COMMENT, multi=[Rule(r"^%\{(.*?)^%\}".replace(".*?", r"[\s\S]*?"), guest=("C", (1, "start"), (1, "end")))])
lang("LEX", "r:regex c:cond", "lex", [R(r"^%[xs]\s+(\w+)", "c"), R(r"^([A-Z_][\w]*)\s+\S", "r")], multi=[Rule(r"^%\{([\s\S]*?)^%\}", guest=("C", (1, "start"), (1, "end")))])
lang("QemuHX", "q:qmp i:infoitem c:commands", "", [R(r"^\s*\.name\s*=\s*\"([^\"]+)\"", "c"), R(r"^(?:@item\s+|\s*``)info\s+([\w-]+)", "i")], multi=[R(r"^SQMP\n([\w-]+)\n-+$", "q")])
lang("IPythonCell", "c:cell", "", [R(r"^#\s*%%\s*(\S.*)$", "c"), R(r"^##\s+(\S.*)$", "c")], base="Python")
lang("RMarkdown", "l:chunklabel", "rmd", [R(r"^```\{\w+[ ,]+([\w-]+)", "l")], base="")
lang("Quarto", "l:chunklabel", "qmd", [R(r"^```\{\w+[ ,]+([\w-]+)", "l"), R(r"^#\|\s*label:\s*(\S+)", "l")])


def _moc(host) -> None:
    """Properties, and the functions declared in the sections for slots and signals."""
    host.multi((R(r"\bQ_PROPERTY\s*\(\s*[\w:*&<> ]+?\s+(\w+)", "p"),))
    section = ""
    for m in re.finditer(r"(?m)^\s*(?:(?:public|protected|private)\s+)?(slots|Q_SLOTS|signals|Q_SIGNALS|public|protected|private)\s*:|^\s*(?:[\w:<>,*&]+\s+)+[*&]?(\w+)\s*\([^;{]*\)[^;{]*[;{]|^\s*\}", host.seen):
        if m.group(1):
            section = {"slots": "s", "Q_SLOTS": "s", "signals": "S", "Q_SIGNALS": "S"}.get(m.group(1), "")
        elif not m.group(2):
            section = ""
        elif section:
            host.add(R("", section), (m.group(), m.group(2)), m.start(2))


lang("QtMoc", "s:slot S:signal p:property", "", function=_moc, hide=C_COMMENT)
lang("JNI", "m:method", "", [R(r'\{\s*"(\w+)"\s*,\s*"\([^"]*\)[^"]*"\s*,', "m")])
lang("DTD", "E:entity p:parameterEntity X:externalEntity U:unparsedEntity e:element a:attribute n:notation", "dtd mod", multi=[R(r"<!ELEMENT\s+([\w:.-]+)", "e"), R(r"<!ENTITY\s+%\s+([\w:.-]+)", "p"), R(r"<!ENTITY\s+(?!%)([\w:.-]+)\s+(?:SYSTEM|PUBLIC)", "X"), R(r"<!ENTITY\s+(?!%)([\w:.-]+)\s+[\"']", "E"), R(r"<!ATTLIST\s+[\w:.%;-]+\s+([\w:.-]+)", "a"), R(r"<!NOTATION\s+([\w:.-]+)", "n")], hide=XML_HIDE)

# --- markup: elements and attributes ----------------------------------------------------------------------


def xml(name: str, kind_text: str, ext: str, table: str, **more) -> None:
    """``element@attribute=kind[/role]`` pairs; ``#`` as the attribute takes the element's text."""
    rules = []
    for item in table.split():
        path, letter = item.split("=")
        letter, _, role = letter.partition("/")
        element, _, attr = path.partition("@")
        start = r"<(?:\w+:)?" + (r"[\w:.-]+" if element == "*" else re.escape(element)) + r"\b"
        rules.append(R(start + (r"[^>]*>\s*([^<]*?)\s*</" if attr == "#" else rf"[^>]*?\s{re.escape(attr)}\s*=\s*[\"']([^\"'<>]*)[\"']"), letter, role=role))
    lang(name, kind_text, ext, multi=rules, hide=more.pop("hide", XML_HIDE), **more)


xml("Ant", "p:project t:target P:property i:antfile", "ant", "project@name=p target@name=t property@name=P import@file=i/imported", patterns="build.xml")
xml("DBusIntrospect", "a:arg i:interface m:method s:signal p:property n:node", "", "interface@name=i method@name=m signal@name=s property@name=p arg@name=a node@name=n")
xml("Glade", "c:class h:handler", "glade", "object@id=c signal@handler=h/handler")


def _maven(host) -> None:
    """Coordinates, the names of properties and the ids of repositories."""
    host.multi(_MAVEN)
    for block in re.finditer(r"<properties>(.*?)</properties>", host.seen, re.S):
        for m in re.finditer(r"<([\w.-]+)>[^<]*</\1>", block.group(1)):
            host.add(R("", "p"), (m.group(), m.group(1)), block.start(1) + m.start())


_MAVEN = (
    R(r"<groupId>\s*([^<]*?)\s*</groupId>", "g"),
    R(r"<artifactId>\s*([^<]*?)\s*</artifactId>", "a"),
    R(r"<(?:pluginR|r)epository>(?:(?!</(?:pluginR|r)epository>)[\s\S])*?<id>\s*([^<]*?)\s*</id>", "r"),
)
lang("Maven2", "g:groupId a:artifactId p:property r:repositoryId", "pom", function=_maven, hide=XML_HIDE, patterns="pom.xml")
xml("PlistXML", "k:key", "plist", "key@#=k")
xml("RelaxNG", "e:element a:attribute n:namedPattern", "rng", "element@name=e attribute@name=a define@name=n")
xml("SVG", "d:def", "svg", "*@id=d")
xml("XML", "i:id n:nsprefix", "xml", "*@id=i")
xml("XRC", "o:object", "xrc", "object@name=o")
xml("XSLT", "s:stylesheet p:parameter m:matchedTemplate n:namedTemplate v:variable", "xsl xslt", "import@href=s/imported include@href=s/included param@name=p template@match=m template@name=n variable@name=v")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _html(host) -> None:
    """Titles and headings with the text of all below them, classes, ids, anchors and linked files."""
    tag = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
    attr = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
    letters = {"title": "t", "h1": "h", "h2": "i", "h3": "j", "h4": "k", "h5": "l", "h6": "m"}
    text, pos, open_ = host.text, 0, None
    while m := tag.search(text, pos):
        pos = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if m.group(1):
            if open_:
                # The first closing tag at the heading's own level decides whether it has a text.
                if open_[2]:
                    open_[2].pop()
                else:
                    if open_[0] == name:
                        title = " ".join(re.sub(r"<[^>]*>", "", re.sub(r"<!--.*?-->", "", text[open_[1] : m.start()], flags=re.S)).split())
                        if title:
                            host.add(R("", letters[name]), (title, title), m.start())
                    open_ = None
            continue
        found = {k.lower(): next((x for x in v if x), "") for k, *v in attr.findall(m.group(3) or "")}
        for c in found.get("class", "").split():
            host.add(R("", "c", role="attribute"), (c, c), m.start())
        if found.get("id"):
            host.add(R("", "I"), (found["id"], found["id"]), m.start())
        if name == "a" and found.get("name"):
            host.add(R("", "a"), (found["name"], found["name"]), m.start())
        if name == "script" and found.get("src"):
            host.add(R("", "J", role="extFile"), (found["src"], found["src"]), m.start())
        if name == "link" and "stylesheet" in found.get("rel", "").lower() and found.get("href"):
            host.add(R("", "C", role="extFile"), (found["href"], found["href"]), m.start())
        if name in ("script", "style"):
            end = re.compile(rf"</{name}\s*>", re.I).search(text, pos)
            stop = end.start() if end else len(text)
            if text[pos:stop].strip():
                host.promises.append(("JavaScript" if name == "script" else "CSS", pos, stop))
            pos = end.end() if end else len(text)
            continue
        if open_ and name not in _VOID and not (m.group(3) or "").rstrip().endswith("/"):
            open_[2].append(name)
        elif open_ is None and name in letters:
            open_ = [name, pos, []]


lang("HTML", "a:anchor c:class/attribute t:title h:heading1 i:heading2 j:heading3 k:heading4 l:heading5 m:heading6 C:stylesheet/extFile I:id J:script/extFile", "htm html", function=_html)


def areas(name: str, *found: tuple[str, str | int, int]) -> None:
    REGISTRY.add(replace(REGISTRY.specs[name], areas=found))


# Where other languages stand: blocks that name theirs, and regions that are always of one.
areas("Markdown", (r"^[ ]{0,3}(?:```|~~~)[ \t]*\{?([\w+#-]+)[^\n]*\n([\s\S]*?)^[ ]{0,3}(?:```|~~~)", 1, 2), (r"\A---\n(?:[\s\S]*?\n)?---\n", "FrontMatter", 0))
areas("RMarkdown", (r"^```\{(\w+)[^\n]*\n([\s\S]*?)^```", 1, 2))
areas("Quarto", (r"^```\{(\w+)[^\n]*\n([\s\S]*?)^```", 1, 2))
areas("ReStructuredText", (r"^\.\.[ ]+(?:code-block|code|sourcecode)::[ \t]*([\w+#-]+)\n(?:[ \t]+:[^\n]*\n)*\n?((?:[ \t]+[^\n]*\n|\n)+)", 1, 2))
areas("Org", (r"^[ \t]*#\+BEGIN_SRC[ \t]+([\w+#-]+)[^\n]*\n([\s\S]*?)^[ \t]*#\+END_SRC", 1, 2))
areas("Asciidoc", (r"^\[source,[ ]*([\w+#-]+)[^\n]*\]\n----\n([\s\S]*?)^----", 1, 2))
areas("PHP", (r"(?:\A|\?>)((?:(?!<\?(?:php|=))[\s\S])+)(?=<\?(?:php|=)|\Z)", "HTML", 1))
areas("SQL", (r"\bDO[ \t]+(\$\w*\$)([\s\S]*?)\1[ \t]*LANGUAGE[ \t]+pl(?=python)", "Python", 2), (r"(\$\w*\$)([\s\S]*?)\1[ \t\n]*LANGUAGE[ \t]+plperlu?\b", "Perl", 2), (r"(\$\w*\$)([\s\S]*?)\1[ \t\n]*LANGUAGE[ \t]+pltclu?\b", "Tcl", 2))
areas("Sh", (r"\b(python3?|perl|ruby|awk|tclsh)\b[^\n<]*<<-?[ ]*['\"]?(\w+)['\"]?[^\n]*\n([\s\S]*?)^\t*\2$", 1, 3))
areas("Perl", (r"^=(?!cut\b)[a-z]\w*[\s\S]*?(?:^=cut\b|\Z)", "Pod", 0))
areas("Raku", (r"^=(?!cut\b)(?:pod|head|begin)\w*[\s\S]*?(?:^=(?:cut|end)\b|\Z)", "Pod", 0))
areas("Ruby", (r"^=begin[^\n]*\n([\s\S]*?)^=end", "RDoc", 1))
areas("Fypp", (r"\A[\s\S]+\Z", "Fortran", 0))
areas("GPerf", (r"^%\{\n?([\s\S]*?)^%\}", "C", 1))
areas("XML", (r"<style\b[^>]*>([\s\S]*?)</style>", "CSS", 1), (r"<script\b[^>]*>([\s\S]*?)</script>", "JavaScript", 1))
areas("SVG", (r"<style\b[^>]*>([\s\S]*?)</style>", "CSS", 1))
REGISTRY.add(replace(REGISTRY.specs["XML"], multi_rules=(*REGISTRY.specs["XML"].multi_rules, R(r"\sxmlns:([\w.-]+)\s*=", "n"))))
COVERED = tuple(sorted(REGISTRY.specs))
