"""Licence statements: forms, mentions, choices, conflicts, own terms; whole runs over small tables."""

import os

import pytest

from symloom.llm import licenses as L

ROWS = [
    ("AAA-1.0-only", "Alder Public License", "1.0", ["AAA1-only", "Alder Public License v1.0 only"], "This work is offered under the Alder Public License, version 1.0, and no other version of it. Pass it on.", "https://l.example/a/1/only"),
    ("AAA-1.0-or-later", "Alder Public License", "1.0", ["AAA1+"], "This work is offered under the Alder Public License, version 1.0, or, at your choice, any version after it. Pass it on.", "https://l.example/a/1/later"),
    ("BBB-2", "Birch Two-Clause License", "2", ["birch-2"], "This work may be reused in source or built form provided that (1) source copies keep this notice and (2) built copies show it. No promise.", "https://l.example/b/2"),
    ("BBB-3", "Birch Three-Clause License", "3", ["birch-3"], "This work may be reused in source or built form provided that (1) source copies keep this notice and (2) built copies show it and (3) the names of the makers are not used for praise. No promise.", "https://l.example/b/3"),
    ("CCC-1.0", "Cedar License", "1.0", ["cedar"], "This work may be studied, sold and folded into other works by anyone who keeps this paragraph with it. As it is.", "https://l.example/c"),
]


@pytest.fixture(scope="module")
def book():
    return L.Book(ROWS)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("// SPDX-License-Identifier: AAA-1.0-only\n", ["AAA-1.0-only"]),
        ("// spdx-license-identifier:BBB-2 OR CCC-1.0\n", ["BBB-2 OR CCC-1.0"]),
        ("// SPDX-License-Identifier: XYZ-9\n", ["UNKNOWN"]),
        ("/* Copyright 2019 Some Works\n * License: AAAv1+\n */\n", ["AAA-1.0-or-later"]),
        ("// Released under the two-clause Birch license; no other terms apply.\n", ["BBB-2"]),
        ("// Licensed under the AAA; the team has not decided on a version so far.\n", ["UNKNOWN"]),
        ("// Dual-licensed: take it under AAA 1.0 (no later version) or under the Cedar terms, as you like.\n", ["AAA-1.0-only OR CCC-1.0"]),
        ("/* https://l.example/b/3 */\n", ["BBB-3"]),
        ("/* This file is offered under the Alder Public License,\n * version 1.0, or, at your choice, any version after\n * it. Pass it on. */\n", ["AAA-1.0-or-later"]),
        ("/* THIS FILE MAY BE USED AGAIN IN SOURCE OR BUILT FORM PROVIDED THAT (1) SOURCE COPIES KEEP THIS NOTICE AND (2) BUILT COPIES SHOW IT. */\n", ["BBB-2"]),
        ("/* the thing may be reused in soruce or built form provided that (1) source copies keep this notice and (2) built copies show it and (3) the names of the makers are not used for praise. */\n", ["BBB-3"]),
        ("// Older dumps of this table were labelled AAA-1.0-only by mistake.\n", []),
        ("// The importer skips every record whose tag is BBB-2.\n", []),
        ("// This file is covered by the same license as the rest of the repository.\n", []),
        ("// Copyright (c) 2020 The Cedar License Authors\n", []),
        ("// Copyright (c) 2020 Foo Authors. Licensed under BBB-2.\n", ["BBB-2"]),
        ("// Licensed under BBB-2. Copyright 2019, 2020 Foo Inc.\n", ["BBB-2"]),
        ("// Distributed according to BBB-2.\n", ["BBB-2"]),
        ("// Released under AAAv1+; no other terms apply.\n", ["AAA-1.0-or-later"]),
        ("// Licensed under AAA1+. The filter hides the name only if the caller asks.\n", ["AAA-1.0-or-later"]),
        ("// All rights reserved. Use is subject to the agreement signed with the vendor.\n", ["UNKNOWN"]),
        ("// Licensed under birch-2. someName may be studied, sold and folded into other works by anyone who keeps this paragraph with it.\n", ["BBB-2", "CCC-1.0"]),
        ("// This file is confidential and may not be handed to third parties.\n", ["UNKNOWN"]),
        ('string x = "SPDX-License-Identifier: BBB-2";\n', []),
        ("", []),
    ],
)
def test_statements(book, text, want):
    assert [x for c in L.cores(text, "proto") for x in book.states(c)] == want


@pytest.mark.parametrize(("stated", "want"), [([], None), (["A", "A"], "A"), (["A", "B"], "CONFLICT"), (["A OR B"], "A OR B"), (["A OR B", "A"], "A OR B"), (["A OR B", "C"], "CONFLICT"), (["A", "UNKNOWN"], "UNKNOWN")])
def test_verdicts(stated, want):
    assert L.verdict_of(stated) == want


@pytest.mark.parametrize(
    ("text", "declared", "want"),
    [(None, None, "UNKNOWN"), ("", "AAA1+", "AAA-1.0-or-later"), (None, "AAA", "UNKNOWN"), (None, "other", "UNKNOWN"), (None, "BBB-2 OR CCC-1.0", "BBB-2 OR CCC-1.0"), ("1. Scope. The work may be studied, sold and folded into other works\nby anyone who keeps this paragraph with it.\n", " ", "CCC-1.0"), ("The work may be studied, sold and folded into other works by anyone who keeps this paragraph with it.", "BBB-3", "CONFLICT"), ("This file is confidential.", None, "UNKNOWN")],
)
def test_repositories(book, text, declared, want):
    assert L.repo_verdict(book, text, declared) == want


def test_run(spark):
    files = spark.createDataFrame(
        [(1, 7, "a.proto", "// SPDX-License-Identifier: BBB-2\n", "x"), (1, 7, "a.proto", "// SPDX-License-Identifier: BBB-2\n", "x"), (2, 7, "b.thrift", "# nothing\n", None), (3, 9, "c.xsl", "<!-- License: cedar --><!-- License: birch-2 -->", "x"), (4, None, "d.proto", "", "x"), (5, 7, "e.proto", None, "x")],
        "file_id long, repo_id int, path string, contents string, verdict string",
    ).where("contents is not null")
    repos = spark.createDataFrame([(7, None, "AAA1+"), (8, "confidential, and nothing else", None), (None, "x", "y"), (7, None, "AAA1+")], "repo_id int, license_text string, declared_license string")
    lic = spark.createDataFrame([(*r[:5], "body", r[5]) for r in ROWS], "license_id string, title string, revision string, aliases array<string>, notice string, body string, url string")
    got = {(r[0], r[1]): r[2] for r in L.license_verdicts(files, repos, lic).collect()}
    assert got == {("file", 1): "BBB-2", ("file", 2): "AAA-1.0-or-later", ("file", 3): "CONFLICT", ("file", 4): "UNKNOWN", ("repo", 7): "AAA-1.0-or-later", ("repo", 8): "UNKNOWN"}
    assert L.license_verdicts(files.limit(0), repos.limit(0), lic).count() == 0


def test_one_block_in_most_files(spark):
    rows = [(i, 1, f"{i}.proto", "// SPDX-License-Identifier: CCC-1.0\n") for i in range(300)]
    lic = spark.createDataFrame([(*r[:5], "body", r[5]) for r in ROWS], "license_id string, title string, revision string, aliases array<string>, notice string, body string, url string")
    got = L.license_verdicts(spark.createDataFrame(rows, "file_id long, repo_id int, path string, contents string"), spark.createDataFrame([], "repo_id int, license_text string, declared_license string"), lic)
    assert got.where("verdict = 'CCC-1.0'").count() == 300


@pytest.mark.parametrize("hot", [10, 10**6])
def test_hot_keys_are_spread(spark, monkeypatch, hot):
    from symloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = spark.createDataFrame([(i, "a" if i % 3 == 0 else "b" if i % 3 == 1 and i < 40 else None if i % 5 == 0 else f"k{i}") for i in range(300)], "id long, k string")
    table = spark.createDataFrame([("a", 1), ("b", 2), ("k8", 3), ("unused", 4)], "k string, v int")
    got = common.hot_join(rows, table, "k", "id")
    assert got.columns == ["id", "k", "v"] or set(got.columns) == {"id", "k", "v"}
    want = sorted((r.id, {"a": 1, "b": 2, "k8": 3}.get(r.k)) for r in rows.collect())
    assert sorted((r.id, r.v) for r in got.collect()) == want
    assert common.hot_join(rows.limit(0), table, "k", "id").count() == 0


def test_package_stands_alone():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for base, _, names in os.walk(os.path.join(root, "symloom")):
        if os.sep + "llm" in base:
            continue
        for n in names:
            if n.endswith(".py"):
                assert "symloom.llm" not in open(os.path.join(base, n)).read()
