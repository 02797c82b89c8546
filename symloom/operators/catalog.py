"""What the engine offers, as tables: fields, extras, header kinds, regex flags, formats, operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.functions.dsl import OPERATORS, VARIABLES
from symloom.functions.script import OPS
from symloom.operators.spec import Registry
from symloom.operators.writers import MODES

# Letter, name, type and default of the built-in fields.
FIELDS = [
    ("N", "name", "string", True), ("F", "input", "string", True), ("P", "pattern", "string or false", True), ("C", "compact", "string", False), ("f", "file", "boolean", True),
    ("K", None, "string", False), ("k", None, "string", True), ("l", "language", "string", False), ("n", "line", "integer", False), ("s", None, "string", True), ("t", "typeref", "string", True),
    ("z", "kind", "string", False), ("i", "inherits", "string or false", False), ("a", "access", "string", False), ("m", "implementation", "string", False), ("S", "signature", "string", False),
    ("R", None, "string", False), ("Z", "scope", "string", False), ("p", "scopeKind", "string", False), ("r", "roles", "string", False), ("E", "extras", "string", False), ("x", "xpath", "string", False),
    ("e", "end", "integer", False), ("T", "epoch", "integer", True), ("o", "nth", "integer", False),
]
# Letter, name and default of the extras.
EXTRAS = [("F", "fileScope", True), ("f", "inputFile", False), ("p", "pseudo", True), ("q", "qualified", False), ("r", "reference", False), ("g", "guest", False), ("s", "subparser", True), (None, "anonymous", True), ("z", "nulltag", False)]
FORMATS = (*MODES, "etags", "xref", "json")
REGEX_FLAGS = ("basic", "extend", "icase", "exclusive", "postrun", "scope", "placeholder", "mgroup", "_advanceTo", "_guest", "_language", "_extra", "_field", "_role", "_anonymous", "fatal", "warning", "tenter", "tleave", "tjump", "treset", "tquit")


class Catalog:
    def __init__(self, spark: SparkSession, registry: Registry) -> None:
        self.spark, self.registry = spark, registry

    def kinds(self) -> DataFrame:
        return self.registry.catalog(self.spark)

    def maps(self) -> DataFrame:
        return self.registry.langmap(self.spark)

    def languages(self) -> DataFrame:
        rows = [(s.name, s.base or None, len(s.kinds)) for s in self.registry.specs.values()]
        return self.spark.createDataFrame(rows, "language string, base string, kinds int")

    def aliases(self) -> DataFrame:
        return self.spark.createDataFrame([(s.name, a) for s in self.registry.specs.values() for a in s.aliases], "language string, alias string")

    def roles(self) -> DataFrame:
        return self.spark.createDataFrame([(s.name, k.name, r) for s in self.registry.specs.values() for k in s.kinds for r in k.roles], "language string, kind string, role string")

    def params(self) -> DataFrame:
        return self.spark.createDataFrame([(s.name, p, v) for s in self.registry.specs.values() for p, v in s.params], "language string, param string, value string")

    def subparsers(self) -> DataFrame:
        return self.spark.createDataFrame([(s.base, s.name, s.direction) for s in self.registry.specs.values() if s.base], "base string, language string, direction string")

    def fields(self) -> DataFrame:
        return self.spark.createDataFrame(FIELDS, "letter string, name string, type string, enabled boolean")

    def extras(self) -> DataFrame:
        return self.spark.createDataFrame(EXTRAS, "letter string, name string, enabled boolean")

    def formats(self) -> DataFrame:
        return self.spark.createDataFrame([(f,) for f in FORMATS], "format string")

    def regex_flags(self) -> DataFrame:
        return self.spark.createDataFrame([(f,) for f in REGEX_FLAGS], "flag string")

    def operators(self) -> DataFrame:
        rows = [("query", k) for k in OPERATORS] + [("query", "$" + k) for k in VARIABLES] + [("script", k) for k in OPS]
        return self.spark.createDataFrame(rows, "language string, operator string")
