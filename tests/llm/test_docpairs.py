"""Grammars and informativeness of documentation."""

import pytest

from symloom.llm import docpairs as D
from symloom.llm.peg import Grammar


def test_packrat():
    g = Grammar(r"""
Sum@ <- Num ('+' Num)* !~/./
Num@ <- ~/\d+/ / '(' Sum2 ')'
Sum2 <- Num ('+' Num)*
""")
    (cap,) = g.parse("1+(2+3)+4")
    assert cap[:3] == ("Sum", 0, 9) and [c[1:3] for c in cap[3]] == [(0, 1), (2, 7), (8, 9)]
    assert g.parse("1+") == []


THRIFT = """/** This service does a lot of things. */
service S extends base.X {
  /** Counts all the open files. */
  i32 alpha(1: string a, 2: map<string, list<i32>> b) throws (1: E e),
  // Reads the next line
  // when it is asked to.
  oneway void beta (),
  # TODO
  void gamma();
  // i32 old(1: i32 a, 2: string b),
  void delta(),
  i32 eps(),  // Shares its line with some code.
  void zeta(),

  /** Not directly above this one here. */

  void eta(),
  /** The theta ray. */
  void thetaRay(),
  /** The gamma theta ray gun. */
  void gammaThetaRayGun(),
  /*
   * 通常、この関数は空の欄を確認します。
   */
  map<string, i32>
  iota(1: i32 x);
}
struct T { /** A struct field is no function. */ 1: i32 f }
"""


def test_thrift():
    got = [(no, name) for no, name, *_ in D.Pairs().of(THRIFT, "thrift")]
    assert got == [(4, "alpha"), (7, "beta"), (26, "iota")]
    assert [x[1] for x in D.Pairs().of(THRIFT.replace("\n", "\r\n"), "thrift")] == ["alpha", "beta", "iota"]


EL = r"""(defun a (x y)
  "Count the words in X."
  x)
;; (defun no (x) "Old words that nobody reads any more." x)
(when t
  (cl-defun b (&optional (q "d") &key (z ?\)))
    "Say \"hello\" to (defun inner (v) \"no no no no no\")."
    1))
(defun c () (interactive) "This string is no docstring at all.")
(defvar v 1 "A variable with a documentation string.")
(defmacro d (x) "Do it.")
(defsubst e nil "Give back the end of it.")
(defun f (x)
  ;; "A comment with words in it is none."
  x)
(defun g () "外側のループは閉じます")
(defun h (broken "
"""


def test_elisp():
    assert [(no, name) for no, name, *_ in D.Pairs().of(EL, "el")] == [(1, "a"), (6, "b"), (12, "e"), (16, "g")]


@pytest.mark.parametrize(("doc", "name", "want"), [("", "f", False), ("----------", "f", False), ("see above", "f", False), ("No description yet", "f", False), ("The entry port of the", "entryPort", True), ("The entry port the a", "entryPort", False), ("Reads it and goes on.", "f", True), ("通常読みます。", "f", False), ("检查所有有效的名称然后保存", "f", True)])
def test_informative(doc, name, want):
    assert D.informative(doc, name) is want


def test_deep_nesting_and_long_texts():
    p = D.Pairs()
    assert list(p.of("(defun x " + "(" * 30_000, "el")) == []
    assert len(list(p.of(EL.replace('(defun h (broken "\n', "") + "; pad\n" * 50_000, "el"))) == 4
    assert list(p.of("", "thrift")) == [] and list(p.of("service S {" + "<" * 5000, "thrift")) == []


def test_run(spark):
    rows = [(1, "a.thrift", THRIFT, "x"), (1, "a.thrift", THRIFT, "x"), (2, "b.EL", EL, None), (3, "c.el", "", None)]
    f = spark.createDataFrame(rows, "file_id long, path string, contents string, func_name string")
    got = D.documented_functions(f)
    assert got.count() == 7
    code = {r.func_name: r.code for r in got.collect()}
    assert code["a"].endswith("x)") and code["alpha"].startswith("i32 alpha")
    assert D.documented_functions(f.limit(0), with_code=False).columns == ["file_id", "line_no", "func_name"]


def test_comment_behind_code():
    text = """service S { // This one stands behind the brace.
  // Opens the first of them.
  void alpha(), // This one is behind the code.
  // Reads all of the options
    # and gives them back.
  string beta(), # One more behind the code.
  void gamma(), /* A block behind the code here. */
  void delta(), /* A block behind the code here. */
  // Closes the last of them.
  void eps(), // This one is behind the code.
  // i32 old(1: i32 a),
  void zeta()
}
"""
    for t in (text, text.replace("\n", "\r\n")):
        got = {name: doc for _, name, _, _, doc in D.Pairs().of(t, "thrift")}
        assert got == {"alpha": "Opens the first of them.", "beta": "Reads all of the options\nand gives them back.", "eps": "Closes the last of them."}


def test_deep_nesting_loses_nothing():
    from symloom.llm.docpairs import Pairs

    deep = "(" * 60_000 + ")" * 60_000
    el = f'(defun good (x) "Gives the sum of both numbers." x)\n(setq a \'{deep})\n(defun odd (&optional {deep}) "Keeps the first of all the rows." nil)\n(defun last (x) "Drops what comes after the end." x)\n'
    assert [(n, name) for n, name, *_ in Pairs().of(el, "el")] == [(1, "good"), (3, "odd"), (4, "last")]
    thrift = "service S {\n  // Gives the first of the rows.\n  " + "list<" * 30_000 + "i32" + ">" * 30_000 + " rows(1: i32 a),\n  // Drops all rows of the table.\n  void drop(),\n}\n"
    assert [(n, name) for n, name, *_ in Pairs().of(thrift, "thrift")] == [(3, "rows"), (5, "drop")]
