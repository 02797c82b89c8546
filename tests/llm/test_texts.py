"""Natural language in code, hand-written sources, stuffed pages."""

import random

import pytest

from symloom.llm import handwritten as H
from symloom.llm import naturaltext as N
from symloom.llm import stuffing as S

TEXTS = {
    "en": "The little house stands on the hill. When the rain comes, nobody walks along the road. We open the window and listen to the wind for a while. The children were playing with their old toys in the garden.",
    "de": "Das kleine Haus steht auf dem Hügel. Wenn der Regen kommt, geht niemand auf der Straße. Wir öffnen das Fenster und hören eine Weile dem Wind zu. Die Kinder spielten mit ihren alten Sachen im Garten.",
    "fr": "La petite maison se trouve sur la colline. Quand la pluie arrive, personne ne marche sur la route. Nous ouvrons la fenêtre et écoutons le vent pendant un moment. Les enfants jouaient avec leurs vieux jouets dans le jardin.",
    "ru": "Маленький дом стоит на холме. Когда идёт дождь, никто не гуляет по дороге. Мы открываем окно и слушаем ветер некоторое время. Дети играли со своими старыми игрушками в саду.",
    "zh": "小房子在山上。下雨的时候，没有人在路上走。我们打开窗户，听一会儿风声。孩子们在花园里玩旧玩具。",
    "ja": "小さな家は丘の上にあります。雨が降ると、誰も道を歩きません。窓を開けて、しばらく風の音を聞きます。子供たちは庭で古いおもちゃで遊んでいました。",
}


@pytest.fixture(scope="module")
def profiles():
    return N.Profiles([(k, v) for k, v in TEXTS.items() for _ in range(2)], limit=0.95)


def test_profiles(profiles):
    for k, v in TEXTS.items():
        assert profiles.nearest(v)[0][0] == k
    assert profiles.languages("Als der Regen kam, war niemand auf der Straße mehr zu sehen.")[0] == "de"
    assert profiles.languages("家の中で古い本を読みました。") == ("ja",)
    assert N.Profiles([]).languages("A text of five words here.") == ()


def test_what_is_text():
    thrift = '// SPDX-License-Identifier: A-1\n// Copyright 2020 The Many Long Words Authors\n// A sentence that runs\n// over two lines here.\n// i32 old(1: i32 a),\nconst string S = "One more sentence is in here."\nconst string P = "/a/path/to/some/file.txt"\n/* label */\n'
    got = [s for t in N.texts_of(thrift, "thrift") for s, _ in N.sentences(t)]
    assert got == ["A sentence that runs over two lines here.", "One more sentence is in here."]
    el = ';; (defun no (x)\n;;   "This text is in code that was commented out."\n;;   x)\n(defvar a "\\u5c0f\\u623f\\u5b50\\u5728\\u5c71\\u4e0a\\u9762\\u7684\\u5730\\u65b9\\u3002")\n'
    assert [s for t in N.texts_of(el, "el") for s, _ in N.sentences(t)] == ["小房子在山上面的地方。"]
    assert [s for s, _ in N.sentences("Only four words here. 小房子。 No end to this one here")] == []


def test_language_run(spark):
    docs = spark.createDataFrame([(i, v * 2, k, "s") for i, (k, v) in enumerate(list(TEXTS.items()) * 3)] + [(99, None, "en", None), (98, "x", None, "s")], "doc_id long, text string, lang string, share string")
    f = spark.createDataFrame([(1, "a.thrift", "// The little house stands on the old hill.\n// Das kleine Haus steht auf dem Hügel dort.\n"), (1, "a.thrift", "// The little house stands on the old hill.\n// Das kleine Haus steht auf dem Hügel dort.\n"), (2, "b.el", ""), (3, "c.el", "(a)")], "file_id long, path string, contents string")
    got = {(r.file_id, r.lang): r.share for r in N.language_shares(f, docs).collect()}
    assert set(got) == {(1, "en"), (1, "de")} and all(0.3 < x < 0.6 for x in got.values())
    assert N.language_shares(f.limit(0), docs).count() == 0
    assert N.language_shares(f, docs.limit(0)).count() == 0


CODE = '#include "a.h"\n\n/* Adds the two numbers and gives back the sum. */\nstatic int add (int a, int b)\n{\n\treturn a + b;\n}\n\nint main (void)\n{\n\tprintf ("/* Generated by x, do not edit. */\\n");\n\treturn add (1, 2);\n}\n'


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("src/a.c", CODE, ""),
        ("src/a.c", "", ""),
        ("src/vendor_tools/a.c", CODE, ""),
        ("./vendor/x/a.c", CODE, "vendored"),
        ("src/a.c", "/* Generated by mk from a.y, do not edit. */\n" + CODE, "generated"),
        ("src/a.c", "/* Copyright 2020 X */\n// Automatisch erzeugt aus a.y, bitte nicht bearbeiten.\n" + CODE, "generated"),
        ("src/a.c", CODE + "\n/* このファイルは a.y から自動生成されました。編集しないでください。 */\n", "generated"),
        ("src/a.c", "/* This used to be auto-generated; it is kept by hand now. */\n" + CODE, ""),
        ("src/a.c", CODE.replace("int main", "/* The table is generated by hand, @generated mark. */\nint main"), ""),
        ("src/a.c", "/* mk2c 4.5 wove this from a_b.peg */\n" + CODE, "generated"),
        ("src/a.c", "/* See README.txt, a.h and https://x.example/y.html */\n" + CODE, ""),
        ("src/a.c", '#line 3 "a.y"\nint f (void) { return 1; }\n', "generated"),
        ("src/a.c", "const unsigned char x[] = {\n" + "  0x14, 0x8f, 0x89, 0x00,\n" * 50 + "};\n", "data"),
        ("src/a.c", CODE + "static const int t[] = { 1, 2, 3 };\n", ""),
        ("src/a.c", "static void a(int b){" + "c=d(b);if(c>2){e(c);}" * 60 + "}\n", "minified"),
        ("src/a.c", CODE + 'static const char *w = "' + "plain words in a long list " * 30 + '";\n', ""),
    ],
)
def test_reasons(path, text, want):
    assert H.reason_of(path, text) == want


def test_containment(spark):
    rng = random.Random(2)
    line = lambda: f"\tv{rng.randint(0, 10**9)} = f{rng.randint(0, 10**9)} ();"
    ref = {u: [line() for _ in range(40)] + ["return NULL;  ", "break;"] * 3 for u in range(10)}
    up = spark.createDataFrame([(u, "p", "\n".join(x)) for u, x in ref.items()] + [(77, "p", None)], "upstream_id int, project string, contents string")
    own = [line() for _ in range(40)]
    files = [
        (1, "src/a.c", "\n".join(x.replace("\t", "    ") for x in ref[3][5:])),
        (2, "src/b.c", "\n".join(own + ref[4][:8])),
        (3, "src/c.c", "\n".join(own)),
        (4, "src/d.c", ""),
    ]
    f = spark.createDataFrame(files * 2, "file_id long, path string, contents string")
    assert [tuple(r) for r in H.not_handwritten(f, up).collect()] == [(1, "copied")]
    assert H.not_handwritten(f, up.limit(0)).count() == 0 and H.not_handwritten(f.limit(0), up).count() == 0


def test_copies_that_name_their_project(spark):
    up = spark.createDataFrame([(1, "libx", "int x;"), (2, "Big Tree", ""), (3, None, None)], "upstream_id int, project string, contents string")
    files = [
        (1, "src/a.c", "/* Imported unchanged from libx 2.0. */\n" + CODE),
        (2, "src/a.c", "/* A piece of LIBX as of spring, see https://libx.example/. */\n" + CODE),
        (3, "src/a.c", "/* Reads what libx writes. */\n" + CODE),
        (4, "src/a.c", CODE.replace("int main", "/* libx 2.0 */\nint main")),
        (5, "src/a.c", "/* This used to be libx 2.0 and was written anew. */\n" + CODE),
        (6, "src/a.c", CODE + "\n/* from the Big-Tree project, release 4.2 */\n"),
    ]
    f = spark.createDataFrame(files * 2, "file_id long, path string, contents string")
    assert sorted(tuple(r) for r in H.not_handwritten(f, up).collect()) == [(1, "vendored"), (2, "vendored"), (6, "vendored")]


PROSE = "The parser reads the next line and keeps it. When the file ends, the index is written to the disk. "
SPAM = [
    "tag cleaner / free tag cleaner / tag cleaner / new tag cleaner / tag cleaner / free tag cleaner / tag cleaner / tag cleaner",
    "Pro tag plugin for windows tag plugin crack code browser! No ads tag plugin for buy tag plugin near me tag plugin. Best tag plugin for free tag plugin sale tag plugin.",
    "\n".join(f"https://a{i}b.example/x_{i}" for i in range(20)),
    " • ".join(f"www.step-flag{i}.test" for i in range(20)),
    "\n".join(f"Some Name - node-token{i} dot example" for i in range(20)),
    "\n".join(f'<a href="http://x{i}.test/">sign flush</a>' for i in range(20)),
    "#buyregexhelper\nINDEX BOOSTER SKU-34015\nsale-regex-helper\ncode browser $82.99\n" * 5,
    "official split sign • coupon pivot • buy pack • free ring • byte • pro quote • online track • loop • fast pull • cheap nest • queue • best port",
]
HONEST = [
    PROSE * 4,
    "",
    "Die Abfrage öffnet den Schlüssel. Das Werkzeug ersetzt das Ende der Datei nur bei eingeschalteter Option. " * 4,
    "外側のループは行の順番を変えずに有効な名前すべてを飛ばします。" * 8,
    "\n".join(f"* [name {i}](https://wiki.example/p{i}) - The parser reads the next line and keeps it." for i in range(12)),
    "\n".join(f"fn_name_{i}\tkind.c\t/^static int x (void)$/;\"\tm\tline:{i}" for i in range(20)),
    "\n".join(f"2024-02-26 23:5{i % 10} WARN tree_stack range={i}" for i in range(20)),
    "\n".join(f"tag_reset_{i} .......... {i}" for i in range(20)),
    "\n".join(f"C-{c} d    limit peek {c}" for c in "abcdefghij"),
    "One name hides the next token. A name rewrites the sort key. The name renames its own options. Every name merges the value. A name skips the comment above it.",
    "We tried a free plugin next to the theme last week, and the file keeps the entry. Is there a cheap plugin for Windows that splits the input line? Nobody here would buy a viewer which checks every role.",
]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert S.is_spam(text) and S.is_spam("Some title\n\n" + text + "\n\n" + PROSE)


@pytest.mark.parametrize("text", HONEST)
def test_honest(text):
    assert not S.is_spam(text)


def test_repetition():
    import numpy as np

    near, again, regular = S.gaps(np.array([0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1]))
    assert near > 0.8 and again > 0.8 and regular == 1.0
    assert S.gaps(np.arange(100)) == (0.0, 0.0, 0.0) and S.peak(np.arange(100)) <= 0 and S.peak(np.arange(2)) == 0
    # Terms strewn at random come again at irregular gaps, stuffed ones at regular ones.
    rng = np.random.default_rng(1)
    assert S.gaps(rng.integers(0, 200, 400))[2] < 0.3 and not S.soon(rng.integers(0, 200, 400))
    assert S.soon(np.array([0, 1, 2, 0, 1, 3, 0, 1, 4, 0, 1, 5, 6, 0, 1, 7]))


def test_pages(spark):
    rows = [(i, x, "t") for i, x in enumerate(SPAM)] + [(100 + i, x, None) for i, x in enumerate(HONEST)] + [(0, SPAM[0], "t"), (500, None, None), (None, SPAM[0], None), (501, "a-" * 200_000, None), (502, "word " * 100_000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, title string")
    got = sorted(r[0] for r in S.spam_pages(d).collect())
    assert [x for x in got if x < 500] == list(range(len(SPAM)))
    assert S.spam_pages(d.limit(0)).count() == 0


# Words that come from no list of this module.
NOUNS = "kettle toaster mixer blender grill freezer cooker heater fan lamp shelf table drawer carpet mirror vase pillow blanket mattress curtain ladder hammer drill wrench bucket hose shovel rake barrow fence".split()
LISTS = [
    ", ".join(NOUNS),
    " ".join(NOUNS),
    "\n".join(f"{a} {b}" for a, b in zip(NOUNS, NOUNS[1:] + NOUNS[:1], strict=True)),
    ", ".join(NOUNS[:20] * 3),
    " / ".join(f"{a} {b} for {c} {d}" for a, b, c, d in [NOUNS[i : i + 4] for i in range(0, 28, 4)] * 3),
]
#: Sentences wrapped over lines, whose function words are not in the fixed list.
WRAPPED = "Сначала входной буфер считает ключ\nсортировки, потому что так требовал старый\nформат. После ошибки внешний цикл сортирует\nвсе допустимые имена, как только файл\nзакрыт. Обычно стек областей сортирует\nключ сортировки перед выходом из блока. Сначала\nфильтр имён заменяет пустое поле, потому что\nтак требовал старый формат.\n"


@pytest.mark.parametrize("text", LISTS)
def test_lists_of_any_words(text):
    assert not hasattr(S, "SELLING") and not any(w in S.FUNCTION for w in NOUNS)
    assert S.is_spam(text) and S.is_spam("Some title\n\n" + text + "\n\n" + PROSE)


def test_wrapped_prose():
    assert not S.is_spam(WRAPPED) and not S.is_spam(WRAPPED * 4)


def test_whole_page_repetition():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, k in [(5, 2), (40, 3), (300, 4), (300, 100), (3000, 5), (3000, 2000)]:
        ids = rng.integers(0, k, n)
        got = S.autocorrelation(ids)
        assert all(got[lag] == (ids[lag:] == ids[:-lag]).sum() for lag in range(1, n))
    ids = np.tile(np.arange(40), 3)
    assert S.gaps(ids)[1] > 0.6 and S.peak(ids) > 0.3 and S.in_turn(ids) and not S.soon(ids)


#: Stuffed sentences, short lists and hosts whose words and endings no list holds.
OTHER = [
    "Kettle lamp with kettle lamp grand kettle lamp. Kettle lamp and mirror drill kettle lamp. Grand mirror drill is kettle lamp mirror drill! " * 3,
    "kettle lamp | mirror | grand drill | rake lamp | mirror hose | vase | grand fence | grand lamp | drill | hose mirror | vase drill",
    "\n".join(f"Kettle Lamp {i} - shop{i}.garden/{i}" for i in range(12)),
    "how to rake for lamp / how to rake for vase / how to rake for lamp / how to drill for lamp / how to rake for hose / how to rake for lamp / how to drill for vase",
    "my_option " + "kettle lamp grand kettle lamp mirror kettle lamp " * 20,
]


@pytest.mark.parametrize("text", OTHER)
def test_no_list_is_needed(text):
    assert S.is_spam(text) and S.is_spam("Some title\n\n" + text + "\n\n" + PROSE)


def test_file_names_are_no_hosts():
    assert not S.is_spam("\n".join(f"src{i}.c, parser{i}.py" for i in range(20)))
