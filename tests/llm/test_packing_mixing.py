"""Containers and mixtures: invariants against brute force."""

import random

import numpy as np
import pytest

from symloom.llm import mixing, packing
from symloom.llm.tokens import RANKS

ranks = pytest.mark.skipif(not __import__("os").path.exists(RANKS), reason="no tokenizer")


def best_fit(items, capacity, sep):
    """Best fit, largest first, by looking at all containers; the latest of equals."""
    bins = []
    for size, _, c in sorted(items, key=lambda x: -x[0]):
        fit = [i for i, (left, cs) in enumerate(bins) if left >= size + sep and (c is None or c not in cs)]
        if fit:
            i = min(fit, key=lambda i: bins[i][0])
            bins[i] = (bins[i][0] - size - sep, bins[i][1] | {c})
        else:
            bins.append((capacity - size, {c}))
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_best_fit(seed):
    rng = random.Random(seed)
    cap, sep = rng.choice([(50, 0), (64, 1), (100, 3)])
    items = [(rng.randint(0, cap), rng.choice("ab"), bytes([rng.randint(0, 40)])) for _ in range(300)]
    where, bins = packing.pack(items, cap, sep)
    used = {}
    for (size, _, c), b in zip(items, where, strict=True):
        used.setdefault(b, []).append((size, c))
    for b, xs in used.items():
        assert sum(s for s, _ in xs) + sep * (len(xs) - 1) + bins.left[b] == cap
        assert len({c for _, c in xs}) == len(xs)
    want = best_fit(items, cap, sep)
    assert abs(len(want) - len(used)) <= max(1, len(want) // 50)


def test_hot_cluster_is_waived():
    where, bins = packing.pack([(1, None, b"same")] * 900 + [(1, None, bytes([i % 250])) for i in range(900)], 100, 0)
    assert len(bins.left) <= 20


def test_sources_apart():
    where, _ = packing.pack([(10, "a", None), (10, "b", None)] * 5, 100, 0, [("a", "b")])
    assert set(where[::2]).isdisjoint(where[1::2])
    assert packing.pack([], 10, 1)[0] == []


@ranks
def test_containers(spark):
    docs = [(i, f"word{i} " * (i % 40), "Src ", "x") for i in range(120)] + [(1000, "long text here " * 400, None, "x"), (1001, "", None, None), (1002, None, "s", None), (None, "a", "s", None), (5, "again", None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, spec_id string")
    specs = spark.createDataFrame([(1, 64, 1), (2, 500, 0), (3, None, 1), (4, 0, 1)], "spec_id int, capacity_tokens long, separator_tokens long")
    rows = packing.packed(d, specs).collect()
    assert {r.spec_id for r in rows} == {1, 2}
    sizes = {}
    for spec, cap, sep in ((1, 64, 1), (2, 500, 0)):
        by, per = {}, {}
        for r in (r for r in rows if r.spec_id == spec):
            by.setdefault(r.container, []).append(r)
            per.setdefault(r.doc_id, []).append(r)
        assert set(per) == {*range(120), 1000, 1001}
        for xs in by.values():
            assert sum(r.tokens for r in xs) + sep * (len(xs) - 1) + xs[0].container_free == cap and len({r.container_free for r in xs}) == 1
        for k, xs in per.items():
            if k != 5:
                assert len(xs) == 1 or sum(r.tokens for r in xs) > cap
                sizes.setdefault(k, set()).add(sum(r.tokens for r in xs))
    assert all(len(x) == 1 for x in sizes.values())
    assert {r.spec_id for r in packing.unused(packing.packed(d, specs), specs).collect()} == {1, 2}
    assert packing.packed(d.limit(0), specs).count() == 0


@ranks
def test_mix(spark):
    rng = random.Random(1)
    texts = {"big": "the report says nothing new ", "small": "version fixed the bug ", "mid": "question about answers "}
    rows = [(i, texts[s] * rng.randint(3, 30), s.upper() if i % 5 else s + " ", None) for i, s in enumerate(["big"] * 600 + ["small"] * 40 + ["mid"] * 150)]
    rows += [(2000 + i, texts["small"] * 10, None, None) for i in range(5)] + [(3000, "other", "unknown", None), (3001, None, "big", None), (None, "x", "big", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, repeats int")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 4), ("mid", 0.3, 2), ("absent", 0.0, 1)], "mix_source string, target_share double, max_repeats int")
    m = mixing.Mix(d, t)
    used = m.chosen().collect()
    assert len({r.doc_id for r in used}) == len(used) and all(1 <= r.repeats <= {"big": 1, "small": 4, "mid": 2}[r.mix_source] for r in used)
    shares = {r.mix_source: r for r in m.shares().collect()}
    for s, goal in (("big", 0.5), ("small", 0.2), ("mid", 0.3), ("absent", 0.0)):
        assert abs(shares[s].actual_share - goal) < 0.02
    assert {r.mix_source for r in used if 2000 <= r.doc_id < 2005} == {"small"}
    assert mixing.Mix(d.limit(0), t).chosen().count() == 0


def test_classifier():
    rows = [("a", f"subject line {i} of a mail") for i in range(30)] + [("b", f"version {i} of the notes") for i in range(30)]
    c = mixing.Classifier(rows)
    assert c.posterior("subject of another mail").argmax() == c.labels.index("a")
    assert np.isclose(c.posterior("").sum(), 1)
    assert mixing.Classifier([]).labels == []


def test_sample_is_never_empty(spark):
    from symloom.llm import common

    rows = spark.createDataFrame([(i, "ab"[i % 2], f"text {i}") for i in range(4000)] + [(None, "a", "x"), (9000, None, "x"), (9001, "a", None)], "id long, s string, text string")
    got = common.sampled(rows, "s", "id", "text", 100)
    assert sorted(got) == sorted(common.sampled(rows.repartition(7), "s", "id", "text", 100))
    for label in "ab":
        assert 60 < sum(s == label for s, _ in got) < 150
    # The share of a label's rows is a whole number of parts that does not sink to nothing, however many rows there are.
    assert all(common._HASH_RANGE * 100 // n > 0 for n in (10**8, 10**12, 10**15))
    assert common.sampled(rows.limit(0), "s", "id", "text", 100) == []


def test_posteriors_are_calibrated():
    rng = random.Random(4)
    rows = []
    for _ in range(900):
        s = rng.choice("abc")
        # A fifth of the texts looks like another source's: no classifier can be surer than that.
        look = s if rng.random() < 0.8 else rng.choice("abc".replace(s, ""))
        rows.append((s, {"a": "# ", "b": "- ", "c": "> "}[look] + f"word {rng.random()}"))
    c = mixing.Classifier(rows)
    assert 0.7 < c.accuracy < 0.9 and abs(c.accuracy - c.confidence) < 0.08
    assert mixing.Classifier(rows).accuracy == c.accuracy
