"""Problem 7: mixing sources to target weights.

Method: soft membership. A classifier fitted on a bounded, labelled sample (about ``SAMPLE_DOCS`` texts a
source) gives rows without a source posteriors over the sources; a row with a source is that source. A part
of the sample is held out first: on it the posteriors are calibrated and the accuracy is measured. Distributed
projected-gradient least squares then fits a nonnegative rate for each document, at most its source's
number of uses, whose expected tokens by source match the targets. Documents with the same posterior have
the same rate at every step, so a step is one small aggregation over groups of equal posterior.

Rates become whole numbers of uses: the whole part, and one more for documents whose hash lies under a
threshold at which the tokens under it are the wanted share; that threshold comes from a histogram of the hashes.

Defined results: rows with null ids or texts are left out; sources without a target are not used; a
source without rows stays at zero and the others are mixed for the largest total that they allow.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm import common
from symloom.llm.tokens import RANKS, count_tokens, encoding
from symloom.storage import materialize

SAMPLE_DOCS, TERMS = 400, 800
#: One text of the sample in so many is held out for calibration.
HELD_OUT = 4
#: Posteriors are kept in steps of one part in so many.
GRID = 20
#: The fit ends when it is this near to the targets or no longer moves; more steps than this is an error.
STEPS, NEAR = 400, 2e-4
BINS = 1 << 16
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def terms(text: str) -> set[str]:
    """How the lines of a text begin, end and are set, and how long they are: what tells one kind of page from another."""
    found: set[str] = set()
    lines = text.split("\n")
    longest = filled = 0
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            found.add("empty")
            continue
        filled += 1
        longest = max(longest, len(line))
        head = _DIGITS.sub("0", s.split(" ", 1)[0])
        shape = _LETTERS.sub(lambda m: "A" if m.group().isupper() else "Aa" if m.group()[0].isupper() else "a", head)
        found |= {"word:" + head[:40], "shape:" + shape[:40], "end:" + ("a" if s[-1].isalnum() else s[-1])}
        if line[0] == " ":
            found.add("indented")
        if i == 0:
            found |= {"first:" + head[:40], "first shape:" + shape[:40], f"first words:{min(6, len(s.split()))}"}
    return found | {f"size:{len(text).bit_length()}", f"longest:{longest.bit_length()}", f"lines:{filled.bit_length()}"}


class Classifier:
    """Multinomial logistic regression over the presence of terms, with a calibrated temperature.

    ``accuracy`` and ``confidence`` (mean of the highest posterior) are those on the held-out part of the sample.
    """

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        rows = sorted(rows, key=lambda r: zlib.crc32(r[1].encode("utf-8", "replace")))
        self.labels = sorted({s for s, _ in rows})
        self.temperature, self.accuracy, self.confidence = 1.0, None, None
        if not rows:  # nothing is known: no row without a source is placed
            return
        at = {s: i for i, s in enumerate(self.labels)}
        y = np.array([at[s] for s, _ in rows])
        held = [terms(t) for _, t in rows]
        count = Counter(x for f in held for x in f)
        best = sorted((x for x, n in count.items() if n >= 3), key=lambda x: (-count[x], x))[:TERMS]
        self.index = {x: i for i, x in enumerate(best)}
        x = np.zeros((len(rows), len(best) + 1), np.float32)
        x[:, -1] = 1
        for i, f in enumerate(held):
            x[i, [k for t in f if (k := self.index.get(t)) is not None]] = 1
        out = np.arange(len(rows)) % HELD_OUT == 0
        if out.sum() >= 10 * len(self.labels):
            self.weights = self._fit(x[~out], y[~out])
            score, true = x[out] @ self.weights, y[out]
            loss = lambda t: -np.log(_softmax(score / t)[np.arange(len(true)), true] + 1e-12).mean()
            self.temperature = min((0.5 * 1.1**k for k in range(25)), key=loss)
            p = _softmax(score / self.temperature)
            self.accuracy, self.confidence = float((p.argmax(1) == true).mean()), float(p.max(1).mean())
        self.weights = self._fit(x, y)

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> np.ndarray:
        """Gradient descent with moments; labels weigh by their rows, so they are the prior."""
        w = np.zeros((x.shape[1], len(self.labels)), np.float32)
        want = np.eye(len(self.labels), dtype=np.float32)[y]
        m, v = np.zeros_like(w), np.zeros_like(w)
        for k in range(1, steps + 1):
            g = x.T @ (_softmax(x @ w) - want) / len(x) + ridge * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return w

    def posterior(self, text: str) -> np.ndarray:
        known = [i for x in terms(text) if (i := self.index.get(x)) is not None]
        score = self.weights[known].sum(0) + self.weights[-1]
        return _softmax(score[None, :] / self.temperature)[0]


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _source() -> Column:
    return F.lower(F.trim("source"))


def fit_classifier(documents: DataFrame, labels: list[str]) -> Classifier:
    """Fitted on about ``SAMPLE_DOCS`` whole texts a source; which ones hangs on a hash of the id alone."""
    rows = documents.withColumn("s", _source()).where(F.col("s").isin(labels))
    return Classifier(common.sampled(rows, "s", "doc_id", "text", SAMPLE_DOCS))


class Mix:
    """The stages of one run; ``shares`` are the targets by source, ``uses`` the most uses of a row."""

    def __init__(self, documents: DataFrame, targets: DataFrame, ranks_path: str = RANKS, total: int | None = None) -> None:
        spark = documents.sparkSession
        goals = sorted((r[0], float(r[1]), int(r[2])) for r in targets.where("mix_source is not null").select(F.lower(F.trim("mix_source")), "target_share", "max_repeats").collect())
        self.labels = labels = [g[0] for g in goals]
        share, caps = np.array([g[1] for g in goals]), np.array([float(g[2]) for g in goals])
        model = self.model = fit_classifier(documents, labels)
        column = [model.labels.index(x) if x in model.labels else -1 for x in labels]

        def make():
            encode = encoding(ranks_path).encode_ordinary
            at = {x: i for i, x in enumerate(labels)}

            def f(doc_id, source, text):
                if source in at:
                    grid = [0] * len(labels)
                    grid[at[source]] = GRID
                elif source is None and model.labels:
                    p = model.posterior(text)
                    p = np.array([p[c] if c >= 0 else 0.0 for c in column])
                    grid = np.floor(p * GRID).astype(int)
                    grid[int(p.argmax())] += GRID - grid.sum()
                    grid = grid.tolist()
                else:
                    return
                yield doc_id, labels[int(np.argmax(grid))], len(encode(text)), grid

            return f

        rows = documents.where("doc_id is not null and text is not null").select("doc_id", _source().alias("source"), "text")
        self.docs = materialize(common.map_rows(rows, "doc_id long, mix_source string, tokens long, grid array<int>", make, scan=True), "mix-docs")
        # Equal posteriors move together: the groups are a small table, and stay a distributed one.
        groups = materialize(self.docs.groupBy("grid").agg(F.sum("tokens").alias("tokens")), "mix-groups")
        part = lambda i: F.col("grid")[i] / F.lit(float(GRID))
        n = len(labels)
        scale = np.array([x or 0.0 for x in groups.agg(*[F.sum(part(i) * F.col("tokens")) for i in range(n)]).first()]) if n else np.zeros(0)
        reach = [scale[i] * caps[i] / share[i] for i in range(n) if share[i] > 0 and scale[i] > 0]
        self.total = float(total if total is not None else (min(reach) if reach else 0.0))
        goal = share * self.total
        top = sum((part(i) * F.lit(float(caps[i])) for i in range(n)), F.lit(0.0))
        # The state of a group is its rate; each step writes a new one as an expression of the last miss.
        state = groups.select("grid", "tokens", top.alias("top")).withColumn("rate", F.least(F.col("top"), F.lit(1.0)))
        moves: list[np.ndarray] = []
        last = np.full(n, np.inf)
        for k in range(STEPS + 1):
            got = state.agg(*[F.sum(part(i) * F.col("tokens") * F.col("rate")) for i in range(n)]).first() if n else []
            miss = np.array([x or 0.0 for x in got]) - goal
            # Near enough, or at the bounds: a further step changes nothing that counts.
            if k == STEPS:
                raise RuntimeError(f"the rates did not settle in {STEPS} steps; misses: {miss.tolist()}")
            if not n or min(np.abs(miss).max(), np.abs(miss - last).max()) <= NEAR * max(1.0, self.total):
                break
            last = miss
            step = miss / np.maximum(scale, 1.0)
            moves.append(step)
            move = sum((part(i) * F.lit(float(step[i])) for i in range(n)), F.lit(0.0))
            state = state.withColumn("rate", F.greatest(F.lit(0.0), F.least(F.col("top"), F.col("rate") - move)))
            if k % 8 == 7:
                state = materialize(state, "mix-state")
        self.steps = len(moves)
        self.rates = materialize(state.select("grid", "rate"), "mix-rates")
        self.targets = spark.createDataFrame([(x, float(s), int(c)) for x, s, c in goals], "mix_source string, target_share double, max_repeats int")

    def chosen(self) -> DataFrame:
        """``doc_id, mix_source, tokens, repeats``: the rows used at least once."""
        return self._used().drop("grid")

    def _used(self) -> DataFrame:
        u = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(BINS))
        # Nine posteriors hold nearly all rows: they are spread.
        rows = common.hot_join(self.docs, self.rates, "grid", "doc_id").select("doc_id", "mix_source", "tokens", "grid", "rate", u.alias("u"))
        rows = materialize(rows, "mix-rows")
        frac = F.col("rate") - F.floor("rate")
        # The tokens under each hash bin, for every group: at most BINS rows a group, whatever its size.
        bins = rows.groupBy("grid", F.col("u").cast("int").alias("bin")).agg(F.sum("tokens").alias("t"), F.first("rate").alias("rate"))
        from pyspark.sql import Window

        w = Window.partitionBy("grid")
        run = bins.select("grid", "bin", "rate", "t", F.sum("t").over(w.orderBy("bin")).alias("upto"), F.sum("t").over(w).alias("all"))
        goal = (F.col("rate") - F.floor("rate")) * F.col("all")
        # Bins are taken as long as they fit; of those behind, the ones that fit into the rest come on top.
        first = run.groupBy("grid").agg(F.max(F.when(F.col("upto") <= goal, F.col("bin") + 1)).alias("cut"), F.max(goal).alias("goal"), F.max(F.when(F.col("upto") <= goal, F.col("upto"))).alias("base"))
        first = first.select("grid", F.coalesce("cut", F.lit(0)).alias("cut"), (F.col("goal") - F.coalesce("base", F.lit(0))).alias("gap"))
        more = bins.join(first, "grid").where((F.col("bin") >= F.col("cut")) & (F.col("t") <= F.col("gap")))
        more = more.withColumn("sum", F.sum("t").over(w.orderBy("bin"))).where("sum <= gap").groupBy("grid").agg(F.collect_list("bin").alias("more"))  # at most BINS numbers
        cut = materialize(first.join(more, "grid", "left").select("grid", "cut", "more"), "mix-cuts")
        extra = F.when((frac > 1e-9) & ((F.col("u") < F.col("cut")) | F.coalesce(F.array_contains("more", F.col("u").cast("int")), F.lit(False))), 1).otherwise(0)
        used = common.hot_join(rows, cut, "grid", "doc_id").select("doc_id", "mix_source", "tokens", "grid", (F.floor(F.col("rate") + 1e-9) + extra).cast("int").alias("repeats"))
        caps = F.broadcast(self.targets.select("mix_source", "max_repeats"))
        return used.join(caps, "mix_source").select("doc_id", "mix_source", "tokens", "grid", F.least("repeats", "max_repeats").alias("repeats")).where("repeats > 0")

    def shares(self) -> DataFrame:
        """Per source: target and real share of the mixed tokens, rows used, most uses of a row.

        ``actual_share`` counts a row under its likeliest source, ``expected_share`` under each by its posterior.
        """
        chosen = self._used()
        names = self.targets.sparkSession.createDataFrame(list(enumerate(self.labels)), "i int, mix_source string")
        soft = chosen.select((F.col("tokens") * F.col("repeats")).alias("t"), F.posexplode("grid").alias("i", "g")).where("g > 0")
        soft = soft.groupBy("i").agg((F.sum(F.col("t") * F.col("g")) / GRID).alias("soft")).join(F.broadcast(names), "i").drop("i")  # one row a source
        per = chosen.groupBy("mix_source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("rows_used"), F.max("repeats").alias("most_repeats"))
        from pyspark.sql import Window

        every = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())  # one row a target source
        joined = self.targets.join(per, "mix_source", "left").join(soft, "mix_source", "left")
        return joined.select(
            "mix_source",
            "target_share",
            (F.coalesce("tokens", F.lit(0)) / F.greatest(every, F.lit(1))).alias("actual_share"),
            (F.coalesce("soft", F.lit(0)) / F.greatest(every, F.lit(1))).alias("expected_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("rows_used", F.lit(0)).alias("rows_used"),
            "max_repeats",
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
