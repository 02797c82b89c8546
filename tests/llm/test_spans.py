"""Shared spans against brute force."""

import random

import numpy as np
import pytest

from symloom.llm import sharedspans as S


def brute(texts):
    pairs = set()
    grams = {k: {t[i : i + 200] for i in range(len(t) - 199)} for k, t in texts.items()}
    for a in texts:
        for b in texts:
            if a < b and grams[a] & grams[b]:
                pairs.add((a, b))
    return pairs


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢\U0001f600 \n") for _ in range(rng.randint(1, 9)))
    make = lambda k: "".join(word() for _ in range(k))[:900]
    shared = [make(80)[: rng.choice([199, 200, 201, 260, 450])] for _ in range(8)]
    out = {}
    for i in range(n):
        t = make(rng.randint(0, 120))
        if rng.random() < 0.6:
            at = rng.randint(0, len(t))
            t = t[:at] + rng.choice(shared) + t[at:]
        out[i] = t
    out[n], out[n + 1] = out[3], out[3]  # copies
    out[n + 2] = "ab" * 300
    out[n + 3] = "x" + "ab" * 400
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs(spark, seed):
    texts = corpus(seed)
    rows = [(k, v, k) for k, v in texts.items()] + [(0, texts[0], 9), (None, "x" * 500, 1), (99, None, 1)]
    d = spark.createDataFrame(rows, "id long, text string, cls int")
    got = [(r.file_a, r.file_b) for r in S.shared_pairs(d).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts)


def test_shared_characters(spark):
    texts = corpus(5, 20)
    d = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r.id: (r.shared_chars, [(s.start, s.stop) for s in r.spans]) for r in S.shared_spans(d).collect()}
    for k, t in texts.items():
        elsewhere = {u[i : i + 200] for j, u in texts.items() if j != k for i in range(len(u) - 199)}
        held = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if t[i : i + 200] in elsewhere:
                held[i : i + 200] = True
        assert got[k][0] == held.sum()
        assert sum(b - a for a, b in got[k][1]) == held.sum()


def test_automaton():
    a = S.Automaton("abcbcx")
    assert a.spans("zbcbczabcb", 3) == [(1, 4), (6, 4)]
    assert a.spans("", 1) == [] and S.Automaton("").spans("abc", 1) == []


def test_long_references_are_cut(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 700)
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh") for _ in range(3000))
    d = spark.createDataFrame([(1, base), (2, "q" * 300 + base[650:1250] + "w" * 300), (3, base[1000:1199])], "id long, text string")
    assert [tuple(r) for r in S.shared_pairs(d).collect()] == [(1, 2)]
    assert {r.id: r.shared_chars for r in S.shared_spans(d).collect()} == {1: 600, 2: 600, 3: 0}


def test_hot_group(spark):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefgh") for _ in range(260))
    rows = [(i, "".join(rng.choice("ijklmnop") for _ in range(300)) + shared) for i in range(90)] + [(1000 + i, "".join(rng.choice("qrstuv") for _ in range(300))) for i in range(30)]
    d = spark.createDataFrame(rows, "id long, text string")
    assert S.shared_pairs(d).count() == 90 * 89 // 2


def test_hot_fingerprints_are_counted(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRED", 3)
    texts = corpus(8, 30)
    d = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r.id: r.shared_chars for r in S.shared_spans(d).collect()}
    for k, t in texts.items():
        elsewhere = {u[i : i + 200] for j, u in texts.items() if j != k for i in range(len(u) - 199)}
        held = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if t[i : i + 200] in elsewhere:
                held[i : i + 200] = True
        assert got[k] == held.sum()


def test_empty(spark):
    d = spark.createDataFrame([], "id long, text string")
    assert S.shared_pairs(d).count() == 0 and S.shared_spans(d).count() == 0
