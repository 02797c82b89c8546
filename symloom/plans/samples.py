"""Programs of the script language with their results, one or more for each operator.

They run in the context of one match: the text ``def foo bar`` (groups ``foo`` and ``bar``) at line 1 of a file
``input``, whose entries are 1: ``outer``, kind ``c``, lines 1 to 9, and 2: ``foo``, kind ``d``, line 3, the current one.
"""

from __future__ import annotations

# Operator, program, what the stack (after a bar: the output) holds in the end, separated by blanks.
SCRIPTS = [
    ("add", "1 2 add", "3"), ("sub", "1 2 sub", "-1"), ("mul", "3 4 mul", "12"), ("idiv", "7 -2 idiv", "-3"), ("mod", "-7 2 mod", "-1"), ("abs", "-5 abs", "5"), ("neg", "5 neg", "-5"),
    ("bitshift", "1 3 bitshift 8 -2 bitshift", "8 2"), ("eq", "1 1 eq (a) (b) eq", "true false"), ("ne", "1 1 ne", "false"), ("ge", "2 2 ge", "true"), ("gt", "2 2 gt", "false"), ("le", "1 2 le", "true"), ("lt", "(a) (b) lt", "true"),
    ("and", "true false and 12 10 and", "false 8"), ("or", "true false or 12 10 or", "true 14"), ("xor", "true true xor 12 10 xor", "false 6"), ("not", "true not 0 not", "false -1"), ("true", "true", "true"), ("false", "false", "false"), ("null", "null", "null"),
    ("pop", "1 2 pop", "1"), ("dup", "1 dup", "1 1"), ("exch", "1 2 exch", "2 1"), ("clear", "1 2 clear", ""), ("count", "7 8 count", "7 8 2"), ("index", "1 2 3 2 index", "1 2 3 1"), ("roll", "1 2 3 3 1 roll 4 5 2 -1 roll", "3 1 2 5 4"),
    ("mark", "mark count exch pop", "1"), ("cleartomark", "1 mark 2 3 cleartomark", "1"), ("counttomark", "mark 7 8 counttomark 4 1 roll cleartomark", "2"), ("[", "[ 1 2 ]", "[1 2]"), ("]", "[ ] length", "0"), ("<<", "<< /a 1 >> /a get", "1"), (">>", "<< /a 1 /b 2 >> length", "2"),
    ("array", "3 array length", "3"), ("dict", "5 dict length", "0"), ("string", "4 string type", "/stringtype"), ("astore", "1 2 2 array astore", "[1 2]"), ("aload", "[ 1 2 ] aload pop", "1 2"),
    ("begin", "<< /q 4 >> begin q end", "4"), ("end", "<< /q 4 >> begin end countdictstack", "1"), ("def", "/x 5 def x x mul", "25"), ("load", "/x 5 def /x load", "5"), ("undef", "<< /a 1 >> dup /a undef length", "0"), ("known", "<< /a 1 >> dup /a known exch /b known", "true false"),
    ("where", "/x 5 def /x where exch pop /nowhere where", "true false"), ("store", "/x 5 def /x 6 store x", "6"), ("currentdict", "currentdict type", "/dicttype"), ("countdictstack", "countdictstack", "1"), ("dictstack", "4 array dictstack length", "1"), ("cleardictstack", "<< >> begin cleardictstack countdictstack", "1"),
    ("_strstr", "(abcb) (b) _strstr", "(abcb) 1 true"), ("_strrstr", "(abcb) (b) _strrstr", "(abcb) 3 true"), ("_strchr", "(abcb) 98 _strchr", "(abcb) 1 true"), ("_strrchr", "(abcb) 98 _strrchr", "(abcb) 3 true"), ("_strpbrk", "(abc) (xcb) _strpbrk", "(abc) 1 true"), ("_strstr", "(abc) (x) _strstr", "(abc) false"),
    ("exec", "{1 2 add} exec", "3"), ("if", "true {1} if false {2} if", "1"), ("ifelse", "false {1} {2} ifelse", "2"), ("repeat", "0 3 {1 add} repeat", "3"), ("loop", "0 {1 add dup 4 eq {exit} if} loop", "4"), ("exit", "5 {exit 6} repeat", ""), ("for", "0 1 1 4 {add} for", "10"), ("forall", "0 [ 1 2 3 ] {add} forall", "6"),
    ("stop", "{1 stop 2} stopped", "1 true"), ("stopped", "{1} stopped", "1 false"), ("quit", "1 quit 2", "1"), ("_newerror", "{1 0 idiv} stopped clear _newerror", "true"), ("_errorname", "{1 0 idiv} stopped clear _errorname", "/undefinedresult"),
    ("countexecstack", "countexecstack {countexecstack} exec", "1 2"), ("execstack", "{8 array execstack} exec length", "2"), ("type", "1 type (a) type /a type [ ] type true type", "/integertype /stringtype /nametype /arraytype /booleantype"),
    ("cvn", "(ab) cvn", "/ab"), ("cvs", "12 8 string cvs", "(12)"), ("cvx", "(1 2 add) cvx exec", "3"), ("bind", "{1} bind exec", "1"), ("copy", "1 2 3 2 copy", "1 2 3 2 3"), ("length", "(abc) length [ 1 2 ] length", "3 2"), ("get", "[ 7 8 ] 1 get (abc) 0 get", "8 97"), ("put", "[ 7 8 ] dup 0 9 put", "[9 8]"),
    ("putinterval", "[ 1 2 3 ] dup 1 [ 8 9 ] putinterval", "[1 8 9]"), ("_copyinterval", "(abcdef) 1 3 0 string _copyinterval", "(bcd)"), ("=", "(a) =", "| a"), ("==", "(a) ==", "| (a)"), ("===", "/a ===", "| /a"), ("====", "7 ====", "| 7"), ("=+", "(a) =+ (b) =+", "| ab"), ("==+", "(a) ==+", "| (a)"),
    ("pstack", "1 (b) pstack", "1 (b) | (b) 1"), ("_matchstr", "1 _matchstr 9 _matchstr", "(foo) true false"), ("_matchloc", "1 /start _matchloc type", "/matchloctype"), ("_matchloc2line", "2 _matchloc _matchloc2line", "1"), ("_tagloc", "2 _tagloc _matchloc2line", "3"),
    ("_tag", "(n) /d 1 _matchloc _tag :name", "(n)"), ("_reftag", "(n) /d /used 1 _matchloc _reftag :roles", "[/used]"), ("_foreigntag", "(n) /Other /d 1 _matchloc _foreigntag :language", "/Other"), ("_foreignreftag", "(n) /Other /d /used 1 _matchloc _foreignreftag :roles", "[/used]"), ("_commit", "(n) /d 1 _matchloc _tag _commit", "3"),
    ("_scopetop", "_scopetop", "1 true"), ("_scopepush", "2 _scopepush _scopedepth", "2"), ("_scopepop", "_scopepop _scopetop", "false"), ("_scopeclear", "_scopeclear _scopedepth", "0"), ("_scopeset", "2 _scopeset _scopetop", "2 true"), ("_scopedepth", "_scopedepth", "1"), ("_scopeNth", "2 _scopepush 1 _scopeNth", "1"), ("_scoperef", ". _scoperef . :scope", "1"),
    ("_tenter", "/t _tenter _acted", "[/tenter /t]"), ("_tentercont", "/t /u _tentercont _acted", "[/tenter /t /u]"), ("_tleave", "_tleave _acted", "[/tleave]"), ("_tjump", "/t _tjump _acted", "[/tjump /t]"), ("_treset", "/t _treset _acted", "[/treset /t]"), ("_tquit", "_tquit _acted", "[/tquit]"),
    ("_extraenabled", "/qualified _extraenabled /guest _extraenabled", "true false"), ("_markextra", ". /guest _markextra . :extras", "[/guest]"), ("_assignrole", ". /used _assignrole . :roles", "[/used]"), ("_unassignrole", ". /used _assignrole . /used _unassignrole . :roles", "[]"), ("_markplaceholder", ". _markplaceholder . :placeholder", "true"),
    ("_advanceto", "2 /end _matchloc _advanceto _advanced", "11"), ("_traced", "_traced", "false"), ("_repl", "_repl", ""), ("_param", "/known _param /unknown _param", "(value) true false"), ("_makepromise", "(Other) 1 /start _matchloc 2 /end _matchloc _makepromise", "1 true"), ("_makepromise", "(Other) 2 /end _matchloc 1 /start _matchloc _makepromise", "false"),
    ("_intervaltab", "2 _intervaltab [ 4 ] _intervaltab [ 20 ] _intervaltab", "1 true 1 true false"), ("_anongen", "(__anon) /d _anongen length", "18"), ("_ndup", "5 3 _ndup", "5 5 5"), ("_dedup", "1 1 _dedup 2 3 _dedup", "1 2 3"), ("_dedup_spaces", "32 32 _dedup_spaces", "32"), ("_buildstring", "mark 65 (bc) _buildstring", "(Abc)"),
    ("_putlast!", "(ab) dup 99 _putlast!", "(abc)"), ("_tr!", "(a-b) dup (-_) _tr!", "(a_b)"), ("_normalize_spaces!", "(a   b) dup _normalize_spaces!", "(a b)"), ("_chop", "(abc) _chop", "(ab)"), ("_chop_space", "(ab  ) _chop_space", "(ab)"), ("_isstring", "(a) _isstring exch pop 1 _isstring exch pop", "true false"), ("_amember", "[ /a /b ] /b _amember", "true"), ("_aindex", "[ /a /b ] /b _aindex [ /a ] /z _aindex", "1 true false"),
    (":name", ". :name", "(foo)"), ("name:", ". (other) name: . :name", "(other)"), (":line", ". :line", "3"), ("line:", ". 5 line: . :line", "5"), (":kind", ". :kind", "/d"), ("end:", ". 8 end: . :end", "8"), (":end", "1 :end", "9"), ("signature:", ". ((a)) signature: . :signature", "((a))"), ("access:", ". (public) access: . :access", "(public)"), ("inherits:", ". (base) inherits: . :inherits", "(base)"), ("typeref:", ". (int) typeref: . :typeref", "[(typename) (int)]"), ("scope:", ". 1 scope: . :scope", "1"),
    ("\\1", "\\1 \\2", "(foo) (bar)"), (".", ".", "2"),
]

#: Language, a small source, and entries of it: kind, name, line.
LANGUAGES: list[tuple[str, str, list[tuple[str, str, int]]]] = [
    ("C", "#define A 1\nstruct s {\n  int m;\n};\nstatic int f (int a)\n{\n  return a;\n}\nenum e { X };\ntypedef int t;\nint v;\n", [("macro", "A", 1), ("struct", "s", 2), ("member", "m", 3), ("function", "f", 5), ("enum", "e", 9), ("enumerator", "X", 9), ("typedef", "t", 10), ("variable", "v", 11)]),
    ("C++", "namespace n {\nclass C {\npublic:\n  int m;\n};\n}\nint f (int a)\n{\n  return a;\n}\nusing namespace n;\n", [("namespace", "n", 1), ("class", "C", 2), ("function", "f", 7)]),
    ("CUDA", "__global__ void k(int *a)\n{\n}\n", [("function", "k", 1)]),
    ("CPreProcessor", "#define A 1\n#include <b.h>\n#include \"c.h\"\n", [("macro", "A", 1), ("header", "b.h", 2), ("header", "c.h", 3)]),
    ("C#", "namespace N\n{\n  public class C\n  {\n    public int F(int a)\n    {\n      return a;\n    }\n  }\n  interface I\n  {\n  }\n}\n", [("namespace", "N", 1), ("class", "C", 3), ("method", "F", 5), ("interface", "I", 10)]),
    ("Java", "package p.q;\npublic class C {\n  private int x;\n  public void m(int a) {\n  }\n}\ninterface I {\n}\n", [("package", "p.q", 1), ("class", "C", 2), ("field", "x", 3), ("method", "m", 4), ("interface", "I", 7)]),
    ("D", "module m;\nclass C {\n}\nstruct S {\n}\n", [("module", "m", 1), ("class", "C", 2), ("struct", "S", 4)]),
    ("Vera", "class c {\n}\nprogram p {\n}\n", [("class", "c", 1), ("program", "p", 3)]),
    ("ObjectiveC", "@interface I : NSObject\n@end\n@implementation M\n@end\n@protocol P\n@end\n", [("interface", "I", 1), ("implementation", "M", 3), ("protocol", "P", 5)]),
    ("JavaScript", "function f(a) {\n}\nclass C {\n  m(x) {\n  }\n}\nvar v = 1;\nconst K = 2;\n", [("function", "f", 1), ("class", "C", 3), ("method", "m", 4), ("variable", "v", 7), ("constant", "K", 8)]),
    ("TypeScript", "interface I {\n}\nenum E {\n}\nclass C {\n}\nfunction f(a: number) {\n}\n", [("interface", "I", 1), ("enum", "E", 3), ("class", "C", 5), ("function", "f", 7)]),
    ("PHP", "<?php\nnamespace N;\nclass C {\n  public function m($a) {\n  }\n}\ninterface I {\n}\nfunction f() {\n}\ndefine('K', 1);\n", [("namespace", "N", 2), ("class", "C", 3), ("interface", "I", 7), ("function", "f", 9), ("define", "K", 11)]),
    ("Zephir", "namespace N;\nclass C {\n  public function f(a) {\n  }\n}\n", [("namespace", "N", 1), ("class", "C", 2), ("function", "f", 3)]),
    ("Go", "package main\nfunc F(a int) int {\n\treturn 1\n}\ntype S struct {\n\tx int\n}\nconst K = 1\nvar V = 2\n", [("package", "main", 1), ("func", "F", 2), ("struct", "S", 5), ("const", "K", 8), ("var", "V", 9)]),
    ("Rust", "mod m {\n}\npub fn f(x: i32) -> i32 {\n  x\n}\nstruct S;\nenum E {\n}\ntrait T {\n}\n", [("module", "m", 1), ("function", "f", 3), ("struct", "S", 6), ("enum", "E", 7)]),
    ("Kotlin", "package p\nclass C {\n}\ninterface I {\n}\nobject O {\n}\nfun f(a: Int) {\n}\nval k = 1\nvar v = 2\n", [("package", "p", 1), ("class", "C", 2), ("interface", "I", 4), ("object", "O", 6), ("constant", "k", 10), ("variable", "v", 11)]),
    ("Odin", "package p\nf :: proc(a: int) {\n}\nS :: struct {\n}\n", [("package", "p", 1), ("proc", "f", 2), ("struct", "S", 4)]),
    ("V", "module m\nfn f(a int) {\n}\nstruct S {\n}\n", [("module", "m", 1), ("fn", "f", 2), ("struct", "S", 4)]),
    ("TypeSpec", "namespace N {\n}\nmodel M {\n}\nenum E {\n}\ninterface I {\n}\n", [("namespace", "N", 1), ("model", "M", 3), ("enum", "E", 5), ("interface", "I", 7)]),
    ("Haxe", "class C {\n}\ninterface I {\n}\nenum E {\n}\ntypedef T = Int;\n", [("class", "C", 1), ("interface", "I", 3), ("enum", "E", 5), ("typedef", "T", 7)]),
    ("Flex", "package p {\nclass C {\n}\ninterface I {\n}\n}\n", [("package", "p", 1), ("class", "C", 2), ("interface", "I", 4)]),
    ("Protobuf", "package a.b;\nmessage M {\n  optional int32 x = 1;\n  enum E { Z = 0; }\n}\nservice S {\n  rpc R (M) returns (M);\n}\n", [("package", "a.b", 1), ("message", "M", 2), ("field", "x", 3), ("enum", "E", 4), ("service", "S", 6), ("rpc", "R", 7)]),
    ("Thrift", "namespace java q\nstruct T {\n  1: required i32 f,\n}\nservice V {\n  void g(1: i32 a),\n}\n", [("namespace", "q", 1), ("struct", "T", 2), ("member", "f", 3), ("service", "V", 5), ("function", "g", 6)]),
    ("Varlink", "interface org.x\ntype S (\n  a: int\n)\nmethod M(a: int) -> ()\nerror E ()\n", [("interface", "org.x", 1), ("struct", "S", 2), ("method", "M", 5), ("error", "E", 6)]),
    ("Python", "import os\nclass C(object):\n    def m(self):\n        pass\ndef f():\n    return 1\nV = 2\n", [("class", "C", 2), ("member", "m", 3), ("function", "f", 5), ("variable", "V", 7)]),
    ("GDScript", "class_name C\nfunc f(a):\n\tpass\nvar v = 1\nsignal s\n", [("class", "C", 1), ("method", "f", 2), ("variable", "v", 4)]),
    ("Ruby", "module M\n  class C\n    def m(a)\n    end\n  end\nend\n", [("module", "M", 1), ("class", "C", 2), ("method", "m", 3)]),
    ("Elixir", "defmodule M do\n  def f(a) do\n  end\n  defp g(a) do\n  end\n  defmacro h(a) do\n  end\nend\n", [("module", "M", 1), ("function", "f", 2), ("macro", "h", 6)]),
    ("Lua", "function a.b(x)\nend\nlocal c = function() end\n", [("function", "a.b", 1), ("function", "c", 3)]),
    ("Julia", "module M\nfunction f(a)\nend\nstruct S\nend\nend\n", [("module", "M", 1), ("function", "f", 2), ("struct", "S", 4)]),
    ("MatLab", "function y = f(x)\n", [("function", "f", 1)]),
    ("Falcon", "class C\nend\nfunction f(a)\nend\n", [("class", "C", 1), ("function", "f", 3)]),
    ("Perl", "package P::Q;\nuse constant K => 1;\nsub s1 {\n}\n", [("package", "P::Q", 1), ("subroutine", "s1", 3)]),
    ("Raku", "class K {\n  method m($x) { }\n  token t { \\d+ }\n}\nsub f { }\n", [("class", "K", 1), ("method", "m", 2), ("token", "t", 3), ("subroutine", "f", 5)]),
    ("Perl6", "grammar G {\n  rule r { a }\n}\nrole R { }\n", [("grammar", "G", 1), ("rule", "r", 2), ("role", "R", 4)]),
    ("Sh", "f() {\n}\nfunction g {\n}\nalias ll='ls'\n", [("function", "f", 1), ("function", "g", 3), ("alias", "ll", 5)]),
    ("Zsh", "f() {\n}\nalias ll='ls'\n", [("function", "f", 1), ("alias", "ll", 3)]),
    ("Bats", "@test \"adds two\" {\n}\nload helper\n", [("test", "adds two", 1), ("script", "helper", 3)]),
    ("Awk", "function f(a, b) {\n}\n", [("function", "f", 1)]),
    ("Tcl", "proc p {a} {\n}\nnamespace eval n {\n}\n", [("procedure", "p", 1), ("namespace", "n", 3)]),
    ("TclOO", "oo::class create C {\n  method m {} {\n  }\n}\n", [("class", "C", 1), ("method", "m", 2)]),
    ("ITcl", "itcl::class C {\n  public method m {} {\n  }\n}\n", [("class", "C", 1), ("method", "m", 2)]),
    ("PowerShell", "function Get-It {\n}\nclass C {\n}\nenum E {\n}\n$v = 1\n", [("function", "Get-It", 1), ("class", "C", 3), ("enum", "E", 5)]),
    ("R", "f <- function(a) {\n}\nlibrary(stats)\nl <- list(1)\n", [("function", "f", 1), ("library", "stats", 3), ("list", "l", 4)]),
    ("R6Class", "C <- R6Class(\"C\",\n  public = list(\n    x = NULL,\n    m = function(a = 1) { b = 2 }\n  ),\n  active = list(\n    y = function() 1\n  )\n)\n", [("class", "C", 1), ("field", "x", 3), ("method", "m", 4), ("activeBindingFunc", "y", 7)]),
    ("S4Class", "setClass(\"C\")\nsetGeneric(\"g\")\nsetMethod(\"m\", \"C\")\n", [("class", "C", 1), ("generic", "g", 2), ("method", "m", 3)]),
    ("Vim", "function! F(a)\nendfunction\naugroup g\ncommand! C call F(1)\nlet v = 1\n", [("function", "F", 1), ("augroup", "g", 3), ("command", "C", 4), ("variable", "v", 5)]),
    ("Rake", "task :build do\nend\nnamespace :db do\nend\nfile 'out.o' do\nend\n", [("task", "build", 1), ("namespace", "db", 3), ("File", "out.o", 5)]),
    ("RSpec", "describe \"Thing\" do\n  context \"when new\" do\n    it \"works\" do\n    end\n  end\nend\n", [("describe", "Thing", 1), ("context", "when new", 2), ("it", "works", 3)]),
    ("GemSpec", "s.name = 'gem1'\ns.add_dependency 'dep1'\n", [("gem", "gem1", 1), ("gem", "dep1", 2)]),
    ("Moose", "has 'attr' => ();\nbefore 'm' => sub { };\nwith 'Role';\n", [("attribute", "attr", 1), ("wrapper", "m", 2), ("role", "Role", 3)]),
    ("FunctionParameters", "fun f($a) {\n}\nmethod m($b) {\n}\n", [("fun", "f", 1), ("method", "m", 3)]),
    ("EmacsLisp", "(defvar a 1)\n(defun b (x)\n  x)\n(defmacro c () nil)\n(defconst k 2)\n", [("variable", "a", 1), ("function", "b", 2), ("macro", "c", 4)]),
    ("Lisp", "(defun f (x) x)\n(defmacro m () nil)\n(defvar v 1)\n", [("function", "f", 1), ("macro", "m", 2), ("variable", "v", 3)]),
    ("Scheme", "(define (f x) x)\n(define k 1)\n", [("function", "f", 1)]),
    ("Clojure", "(ns my.space)\n(defn f [x] x)\n", [("namespace", "my.space", 1), ("function", "f", 2)]),
    ("Haskell", "module M where\ndata T = A\nf :: Int -> Int\n", [("module", "M", 1), ("type", "T", 2), ("function", "f", 3)]),
    ("LiterateHaskell", "> module M where\n> data T = A\n> f :: Int\n", [("module", "M", 1), ("type", "T", 2), ("function", "f", 3)]),
    ("Elm", "module M exposing (..)\ntype alias A = Int\ntype T\n  = X\n", [("module", "M", 1), ("alias", "A", 2), ("type", "T", 3), ("constructor", "X", 4)]),
    ("OCaml", "module M = struct end\ntype t = int\nexception E\nlet f x = x\n", [("module", "M", 1), ("type", "t", 2), ("Exception", "E", 3)]),
    ("SML", "structure S = struct end\nfun f x = x\nexception E\n", [("structure", "S", 1), ("function", "f", 2), ("exception", "E", 3)]),
    ("Erlang", "-module(m).\n-define(D, 1).\n-record(r, {}).\nf(X) -> X.\n", [("module", "m", 1), ("macro", "D", 2), ("record", "r", 3), ("function", "f", 4)]),
    ("Prolog", ":- module(m, []).\np(X) :- q(X).\ng --> [].\n", [("module", "m", 1), ("predicate", "p", 2), ("grammar", "g", 3)]),
    ("Myrddin", "pkg p =\nconst k = 1\nvar v = 2\ntype t = int\n", [("pkg", "p", 1), ("constant", "k", 2), ("var", "v", 3), ("type", "t", 4)]),
    ("Inko", "class C {\n}\ntrait T {\n}\n", [("class", "C", 1), ("trait", "T", 3)]),
    ("Iniconf", "[s]\nk = v\n", [("section", "s", 1), ("key", "k", 2)]),
    ("Markdown", "# A\n## B\n[^f]: note\n", [("chapter", "A", 1), ("section", "B", 2), ("footnote", "f", 3)]),
    ("ReStructuredText", "Title\n=====\n\nSub\n---\n\n.. _tgt: x\n", [("title", "Title", 1), ("target", "tgt", 7)]),
    ("Asciidoc", "= Doc\n\n== Part\n\n=== Small\n", [("chapter", "Doc", 1), ("section", "Part", 3), ("subsection", "Small", 5)]),
    ("Org", "* One\n** Two\n", [("part", "One", 1), ("chapter", "Two", 2)]),
    ("Pod", "=head1 One\n\n=head2 Two\n", [("chapter", "One", 1), ("section", "Two", 3)]),
    ("RDoc", "= One\n== Two\n", [("L1Header", "One", 1), ("L2Header", "Two", 2)]),
    ("Txt2tags", "= One =\n== Two ==\n", [("section", "One", 1), ("section", "Two", 2)]),
    ("Scdoc", "# ONE\n## Two\n", [("section", "ONE", 1), ("subsection", "Two", 2)]),
    ("Abc", "X:1\nT:The Song\n", [("section", "The Song", 2)]),
    ("Tex", "\\section{One}\n\\label{l1}\n\\subsection{Two}\n", [("section", "One", 1), ("label", "l1", 2), ("subsection", "Two", 3)]),
    ("TeXBeamer", "\\frametitle{F}\n\\framesubtitle{G}\n", [("frametitle", "F", 1), ("framesubtitle", "G", 2)]),
    ("BibTeX", "@article{a1,\n}\n@book{b1,\n}\n", [("article", "a1", 1), ("book", "b1", 3)]),
    ("BibLaTeX", "@online{o1,\n}\n@thesis{t1,\n}\n", [("online", "o1", 1), ("thesis", "t1", 3)]),
    ("BETA", "-- f: attributes --\nv :< w\n", [("fragment", "f", 1), ("virtual", "v", 2)]),
    ("Man", ".TH NAME 1\n.SH SYNOPSIS\n.SS Sub\n", [("title", "NAME", 1), ("section", "SYNOPSIS", 2), ("subsection", "Sub", 3)]),
    ("Diff", "--- a/x.c\n+++ b/x.c\n@@ -1,2 +1,3 @@\n", [("modifiedFile", "x.c", 1), ("hunk", "-1,2 +1,3", 3)]),
    ("DosBatch", ":start\nset v=1\n", [("label", "start", 1), ("variable", "v", 2)]),
    ("OptionFile", "--langdef=Foo\n--kinddef-Foo=a,alpha,alphas\n", [("langdef", "Foo", 1), ("kind", "alpha", 2)]),
    ("Make", "A = 1\nall: x\ninclude foo.mk\n", [("macro", "A", 1), ("target", "all", 2), ("makefile", "foo.mk", 3)]),
    ("Automake", "bin_PROGRAMS = prog\nSUBDIRS = sub\n", [("program", "prog", 1), ("subdir", "sub", 2)]),
    ("Autoconf", "AC_INIT([pkg], [1])\nAC_ARG_WITH([lib], [x])\nAC_SUBST(VAR)\n", [("package", "pkg", 1), ("optwith", "lib", 2), ("subst", "VAR", 3)]),
    ("M4", "define(`m', `x')\ninclude(`f.m4')\n", [("macro", "m", 1), ("macrofile", "f.m4", 2)]),
    ("CMake", "function(f a)\nmacro(m)\nadd_executable(t a.c)\nset(v 1)\nproject(p)\n", [("function", "f", 1), ("macro", "m", 2), ("target", "t", 3), ("variable", "v", 4), ("project", "p", 5)]),
    ("Meson", "project('p')\nv = 1\nsubdir('s')\n", [("project", "p", 1), ("variable", "v", 2), ("subdir", "s", 3)]),
    ("MesonOptions", "option('o', type : 'boolean')\n", [("boolean", "o", 1)]),
    ("Kconfig", "config FOO\nmenu \"M\"\nsource \"sub/Kconfig\"\n", [("config", "FOO", 1), ("menu", "M", 2), ("kconfig", "sub/Kconfig", 3)]),
    ("PkgConfig", "prefix=/usr\nName: lib\nRequires: other\n", [("var", "prefix", 1), ("name", "lib", 2), ("pkg", "other", 3)]),
    ("JavaProperties", "a.b=1\n# no=2\n", [("key", "a.b", 1)]),
    ("Passwd", "root:x:0:0:root:/root:/bin/sh\n", [("username", "root", 1)]),
    ("Gdbinit", "define cmd\nend\nset $v = 1\n", [("definition", "cmd", 1), ("toplevelVariable", "v", 3)]),
    ("Forth", ": word 1 ;\nvariable v\n3 constant c\n", [("word", "word", 1), ("variable", "v", 2), ("constant", "c", 3)]),
    ("Fortran", "program p\nend program\nsubroutine s(a)\nend\nmodule m\nend module\n", [("program", "p", 1), ("subroutine", "s", 3), ("module", "m", 5)]),
    ("Fypp", "#:def m(a)\n#:enddef\n", [("macro", "m", 1)]),
    ("Pascal", "function f(a: integer): integer;\nprocedure p;\n", [("function", "f", 1), ("procedure", "p", 2)]),
    ("Ada", "package P is\nend P;\npackage body P is\nend P;\n", [("packspec", "P", 1), ("package", "P", 3)]),
    ("Eiffel", "class C\n", [("class", "C", 1)]),
    ("Basic", "function f(a)\nconst K = 1\ntype t\n", [("function", "f", 1), ("constant", "K", 2), ("type", "t", 3)]),
    ("Asp", "function f(a)\nsub s()\nclass C\nconst K = 1\n", [("function", "f", 1), ("subroutine", "s", 2), ("class", "C", 3), ("constant", "K", 4)]),
    ("AutoIt", "Func f($a)\nEndFunc\nGlobal $g = 1\n", [("func", "f", 1), ("global", "$g", 3)]),
    ("REXX", "sub1: procedure\n", [("subroutine", "sub1", 1)]),
    ("SLang", "define f (a)\n{\n}\nimplements (\"n\");\n", [("function", "f", 1), ("namespace", "n", 4)]),
    ("Abaqus", "*Part, name=p1\n*Assembly, name=a1\n*Step, name=s1\n", [("part", "p1", 1), ("assembly", "a1", 2), ("step", "s1", 3)]),
    ("SINEX", "+SITE/ID\n-SITE/ID\n", [("block", "SITE/ID", 1)]),
    ("NSIS", "Section \"Main\"\nSectionEnd\nFunction f\nFunctionEnd\nVar v\n", [("section", "Main", 1), ("function", "f", 3), ("variable", "v", 5)]),
    ("Asm", "start:\nK equ 1\n.macro m\n", [("label", "start", 1), ("define", "K", 2), ("macro", "m", 3)]),
    ("DTS", "lab: node@1 {\n};\n&ref {\n};\n", [("label", "lab", 1), ("phandler", "ref", 3)]),
    ("WindRes", "D1 DIALOG 0, 0\nM1 MENU\nI1 ICON \"a.ico\"\n", [("dialog", "D1", 1), ("menu", "M1", 2), ("icon", "I1", 3)]),
    ("CobolFree", "PROGRAM-ID. PROG.\n", [("program", "PROG", 1)]),
    ("Verilog", "`define D 1\nmodule m;\nendmodule\n", [("define", "D", 1), ("module", "m", 2)]),
    ("SystemVerilog", "class C;\nendclass\npackage p;\nendpackage\ninterface i;\nendinterface\n", [("class", "C", 1), ("package", "p", 3), ("interface", "i", 5)]),
    ("VHDL", "entity e is\nend e;\narchitecture a of e is\nbegin\nend a;\npackage p is\nend p;\n", [("entity", "e", 1), ("architecture", "a", 3), ("package", "p", 6)]),
    ("TTCN", "module M {\nfunction f() {\n}\ntestcase t() {\n}\n}\n", [("module", "M", 1), ("function", "f", 2), ("testcase", "t", 4)]),
    ("SQL", "CREATE TABLE t (a int);\ncreate or replace view v as select 1;\n", [("table", "t", 1), ("view", "v", 2)]),
    ("RpmSpec", "Name: pkg\n%define m 1\n%global g 2\n%package devel\n", [("tag", "Name", 1), ("macro", "m", 2), ("global", "g", 3), ("package", "devel", 4)]),
    ("RpmMacros", "%name value\n", [("macro", "name", 1)]),
    ("SystemdUnit", "[Unit]\nRequires=a.service\n", [("unit", "a.service", 2)]),
    ("DBusService", "[D-BUS Service]\nName=org.x\n", [("name", "org.x", 2)]),
    ("YumRepo", "[fedora]\nname=x\n", [("repoid", "fedora", 1)]),
    ("PythonEntryPoints", "[console_scripts]\ncmd = pkg:main\n", [("console", "cmd", 2)]),
    ("PythonLoggingConfig", "[logger_root]\nqualname=q\n", [("loggerSection", "root", 1), ("qualname", "q", 2)]),
    ("Robot", "*** Variables ***\n${V}  1\n*** Test Cases ***\nFirst One\n    Log  x\n", [("variable", "${V}", 2), ("testcase", "First One", 4)]),
    ("GoMod", "module example.org/m\nrequire example.org/d v1.0.0\n", [("module", "example.org/m", 1), ("module", "example.org/d", 2)]),
    ("TOML", "[t]\n[[arr]]\n", [("table", "t", 1), ("arraytable", "arr", 2)]),
    ("Cargo", "[package]\nname = \"c\"\n", [("package", "c", 2)]),
    ("Yaml", "a: &anc 1\nb: *anc\n", [("anchor", "anc", 1)]),
    ("YamlFrontMatter", "---\ntitle: The One\n---\n", [("title", "The One", 2)]),
    ("FrontMatter", "---\ntitle: The One\n---\n", [("title", "The One", 2)]),
    ("AnsiblePlaybook", "- name: Set up\n  hosts: all\n", [("play", "Set up", 1)]),
    ("OpenAPI", "info:\n  title: Api\npaths:\n  /a/b:\n    get: x\n", [("title", "Api", 2), ("path", "/a/b", 4)]),
    ("I18nRubyGem", "en:\n  greet: \"Hi\"\n", [("key", "greet", 2)]),
    ("JSON", "{\"a\": {\"b\": [1, \"x\"]}, \"c\": null}", [("object", "a", 1), ("array", "b", 1), ("null", "c", 1)]),
    ("CSS", ".a, #b { color: red }\nh1 { }\n", [("class", "a", 1), ("id", "b", 1), ("selector", "h1", 2)]),
    ("SCSS", "@mixin m($a) {\n}\n@function f($b) {\n}\n$v: 1;\n", [("mixin", "m", 1), ("function", "f", 3), ("variable", "v", 5)]),
    ("LdScript", ".text : {\n}\nsym = 1;\n", [("section", ".text", 1), ("symbol", "sym", 3)]),
    ("Nftables", "table inet filter {\n  chain input {\n  }\n}\n", [("table", "filter", 1), ("chain", "input", 2)]),
    ("PuppetManifest", "class c::d {\n}\ndefine e::f {\n}\nnode 'n1' {\n}\n", [("class", "c::d", 1), ("definition", "e::f", 3), ("node", "n1", 5)]),
    ("Terraform", "resource \"aws\" \"r1\" {\n}\nvariable \"v1\" {\n}\noutput \"o1\" {\n}\n", [("resource", "r1", 1), ("variable", "v1", 3), ("output", "o1", 5)]),
    ("TerraformVariables", "v1 = 2\n", [("variable", "v1", 1)]),
    ("SystemTap", "global g\nprobe begin {\n}\nfunction f(a) {\n}\n", [("variable", "g", 1), ("probe", "begin", 2), ("function", "f", 4)]),
    ("SELinuxInterface", "interface(`i1',`\n')\ntemplate(`t1',`\n')\n", [("interface", "i1", 1), ("template", "t1", 3)]),
    ("SELinuxTypeEnforcement", "policy_module(m, 1.0)\ntype t1;\nattribute a1;\n", [("module", "m", 1), ("type", "t1", 2), ("attr", "a1", 3)]),
    ("GPerf", "%define hash-function-name h1\n%define class-name C1\n", [("hfunc", "h1", 1), ("class", "C1", 2)]),
    ("YACC", "%token NUM\n%%\nexpr: NUM ;\n", [("token", "NUM", 1), ("label", "expr", 3)]),
    ("LEX", "%x STR\nDIGIT [0-9]\n", [("cond", "STR", 1), ("regex", "DIGIT", 2)]),
    ("QemuHX", "    {\n        .name       = \"info\",\nSQMP\nquit\n----\n@item info version\n", [("commands", "info", 2), ("qmp", "quit", 4), ("infoitem", "version", 6)]),
    ("IPythonCell", "# %% first\n", [("cell", "first", 1)]),
    ("RMarkdown", "```{r chunk1}\n```\n", [("chunklabel", "chunk1", 1)]),
    ("Quarto", "```{r}\n#| label: fig1\n```\n", [("chunklabel", "fig1", 2)]),
    ("QtMoc", "class C : public QObject {\n  Q_PROPERTY(int width READ width)\npublic slots:\n  void go(int a);\nsignals:\n  void gone();\nprivate:\n  int no();\n};\n", [("property", "width", 2), ("slot", "go", 4), ("signal", "gone", 6)]),
    ("JNI", "{\"m1\", \"(I)V\", (void *)m1},\n", [("method", "m1", 1)]),
    ("DTD", "<!ELEMENT e (a)>\n<!ENTITY % p \"x\">\n", [("element", "e", 1), ("parameterEntity", "p", 2)]),
    ("Ant", "<project name=\"p\">\n<target name=\"t\"/>\n<property name=\"q\" value=\"1\"/>\n</project>\n", [("project", "p", 1), ("target", "t", 2), ("property", "q", 3)]),
    ("DBusIntrospect", "<node>\n<interface name=\"org.x\">\n<method name=\"m\"/>\n<signal name=\"s\"/>\n</interface>\n</node>\n", [("interface", "org.x", 2), ("method", "m", 3), ("signal", "s", 4)]),
    ("Glade", "<object class=\"GtkWindow\" id=\"w1\">\n<signal name=\"x\" handler=\"h1\"/>\n</object>\n", [("class", "w1", 1), ("handler", "h1", 2)]),
    ("Maven2", "<project>\n<groupId>g</groupId>\n<artifactId>a</artifactId>\n<properties>\n<p.q>1</p.q>\n</properties>\n<repository><id>r1</id></repository>\n</project>\n", [("groupId", "g", 2), ("artifactId", "a", 3), ("property", "p.q", 5), ("repositoryId", "r1", 7)]),
    ("PlistXML", "<dict>\n<key>k1</key>\n</dict>\n", [("key", "k1", 2)]),
    ("RelaxNG", "<define name=\"d1\">\n<element name=\"e1\"/>\n</define>\n", [("namedPattern", "d1", 1), ("element", "e1", 2)]),
    ("SVG", "<svg>\n<g id=\"i1\"/>\n</svg>\n", [("def", "i1", 2)]),
    ("XML", "<a id=\"i1\">\n</a>\n", [("id", "i1", 1)]),
    ("XRC", "<object class=\"wxFrame\" name=\"f1\">\n</object>\n", [("object", "f1", 1)]),
    ("XSLT", "<xsl:template match=\"a/b\"/>\n<xsl:template name=\"t\"><xsl:param name=\"p\"/></xsl:template>\n", [("matchedTemplate", "a/b", 1), ("namedTemplate", "t", 2), ("parameter", "p", 2)]),
    ("Markdown", "---\ntitle: Front\n---\n# A\n```python\ndef f():\n    pass\n```\n", [("title", "Front", 2), ("chapter", "A", 4), ("function", "f", 6)]),
    ("ReStructuredText", "Top\n===\n\n.. code-block:: c\n\n   #define M 1\n", [("title", "Top", 1), ("macro", "M", 6)]),
    ("Org", "* One\n#+BEGIN_SRC sh\nf() {\n}\n#+END_SRC\n", [("part", "One", 1), ("function", "f", 3)]),
    ("Perl", "package P;\n=head1 Name\n\nText\n\n=cut\nsub s {\n}\n", [("package", "P", 1), ("chapter", "Name", 2), ("subroutine", "s", 7)]),
    ("Ruby", "class C\nend\n=begin\n= Doc\n=end\n", [("class", "C", 1), ("L1Header", "Doc", 4)]),
    ("PHP", "<h1>Top</h1>\n<?php\nfunction f() {\n}\n?>\n<h2>Low</h2>\n", [("heading1", "Top", 1), ("function", "f", 3), ("heading2", "Low", 6)]),
    ("Sh", "python <<EOF\ndef f():\n    pass\nEOF\ng() {\n}\n", [("function", "f", 2), ("function", "g", 5)]),
    ("SQL", "CREATE FUNCTION q() AS $$\nsub s {\n}\n$$ LANGUAGE plperl;\n", [("function", "q", 1), ("subroutine", "s", 2)]),
    ("Fypp", "#:def m(a)\nsubroutine s(b)\nend\n", [("macro", "m", 1), ("subroutine", "s", 2)]),
    ("GPerf", "%{\n#define M 1\n%}\n%define class-name C1\n", [("macro", "M", 2), ("class", "C1", 4)]),
    ("RMarkdown", "```{r chunk1}\nf <- function(a) {\n}\n```\n", [("chunklabel", "chunk1", 1), ("function", "f", 2)]),
    ("XML", "<a xmlns:q=\"u\">\n<style>.c { }</style>\n</a>\n", [("nsprefix", "q", 1), ("class", "c", 2)]),
    ("HTML", "<title>T</title>\n<h1 class=\"x\" id=\"i\">H</h1>\n", [("title", "T", 1), ("heading1", "H", 2), ("class", "x", 2), ("id", "i", 2)]),
]
