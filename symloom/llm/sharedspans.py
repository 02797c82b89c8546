"""Problem 3: long exact spans shared between records.

Method: suffix automata of reference shards; documents are streamed through them for matching
statistics, and the maximal spans of at least ``MIN_SPAN`` characters are kept. Automata of a whole
collection grow with it, so they are not broadcast: each document goes to the automata of just those
references with which it shares a selected fingerprint. Fingerprints are minima of rolling hashes over
windows laid out so that every run of ``MIN_SPAN`` characters holds one whole window: no shared run
is missed, whatever its place, and the automaton alone decides.

Defined results: equal texts form one class that is matched once and expanded at the end; texts shorter
than ``MIN_SPAN`` share nothing; null texts give no row; a record read twice is one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from symloom.llm import common
from symloom.sources.parallel import slices
from symloom.storage import materialize

MIN_SPAN = 200
GRAM = 100
#: A window of so many grams spans MIN_SPAN characters, so each run that long has a whole window.
WINDOW = MIN_SPAN - GRAM + 1
#: Characters in one automaton; a longer reference is cut into shards that overlap by MIN_SPAN - 1.
SHARD = 50_000
#: Classes that share one fingerprint and are still paired where only the shared characters are asked for.
PAIRED = 64
#: Partners matched in one task against one reference; the reference goes to as many tasks as needed.
PARTNERS = 64

_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


class Hasher:
    """Hashes of all grams of a text at once; powers are kept and grow with the longest text seen."""

    def __init__(self, base: int = _BASE) -> None:
        self.base = base
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            m = max(n, 2 * len(self.power))
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, self.base, np.uint64)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, pow(self.base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)

    def grams(self, text: str, k: int = GRAM) -> np.ndarray:
        """One 64-bit hash for each run of ``k`` characters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes)
        if n < k:
            return np.empty(0, np.uint64)
        self._grow(n + 1)
        with np.errstate(over="ignore"):
            mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * self.power[:n], dtype=np.uint64)])
            h = (total[k:] - total[:-k]) * self.inverse[: n - k + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        return h

    def selected(self, text: str) -> np.ndarray:
        """The distinct least gram hashes of all windows of the text; empty for texts under ``MIN_SPAN``."""
        return np.unique(self.windows(text))

    def windows(self, text: str) -> np.ndarray:
        """The least gram hash of the window at each place where ``MIN_SPAN`` characters begin."""
        h = self.grams(text)
        if len(h) < WINDOW:
            return np.empty(0, np.uint64)
        # Sliding minimum: each window is the end of one block and the beginning of the next.
        pad = -len(h) % WINDOW
        full = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, WINDOW)
        left = np.minimum.accumulate(full, axis=1).ravel()
        right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(right[: len(h) - WINDOW + 1], left[WINDOW - 1 : len(h)])


class Automaton:
    """The suffix automaton of one text: the least automaton that reads all its substrings."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [0]
        nxt, link, length, end = self.next, self.link, self.length, self.end
        last = 0
        for i, ch in enumerate(text):
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            end.append(i + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in nxt[p]:
                nxt[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][ch]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    end.append(end[q])
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(ch) == q:
                        nxt[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def spans(self, text: str, least: int = MIN_SPAN) -> list[tuple[int, int]]:
        """The maximal spans (start, length) of ``text``, at least so long, that stand in the automaton's text."""
        found: list[tuple[int, int]] = []
        state = n = 0
        nxt, link, length = self.next, self.link, self.length
        for i, ch in enumerate(text):
            if ch in nxt[state]:
                state = nxt[state][ch]
                n += 1
                continue
            if n >= least:
                found.append((i - n, n))
            while state and ch not in nxt[state]:
                state = link[state]
            if ch in nxt[state]:
                n = length[state] + 1
                state = nxt[state][ch]
            else:
                state, n = 0, 0
        if n >= least:
            found.append((len(text) - n, n))
        return found


def covered(spans: list[tuple[int, int]]) -> int:
    """Characters in the union of spans."""
    total = reach = 0
    for s, n in sorted(spans):
        total += max(0, s + n - max(s, reach))
        reach = max(reach, s + n)
    return total


class Sharing:
    """The stages of one run over ``records(id, text)``; texts are moved once a stage, by a 16-byte key."""

    def __init__(self, records: DataFrame, paired: int | None = None) -> None:
        """``paired``: fingerprints of more classes are left to :meth:`counted`; None pairs them all."""
        base = records.where("text is not null and id is not null").select("id", "text", F.unhex(F.md5("text")).alias("cls"))
        self.members = materialize(base.select("id", "cls", F.length("text").alias("n")).distinct(), "span-members")
        one = base.select("cls", "text").where(F.length("text") >= MIN_SPAN)

        def make():
            hasher = Hasher()

            def f(cls, text):
                for h in hasher.selected(text).view(np.int64).tolist():
                    yield cls, h

            return f

        marks = common.map_rows(one.select("cls", "text"), "cls binary, h long", make, scan=True).distinct()
        # Posting lists of one class are dropped before any join; the counts combine on the map side.
        marks = materialize(marks, "span-marks")
        shared = marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        self.hot = marks.join(shared.where(F.col("n") > paired).select("h"), "h") if paired else None
        marks = marks.join((shared.where(F.col("n") <= paired) if paired else shared).select("h"), "h")
        # A pair joins once for each window it shares; made distinct before any text moves.
        pairs = marks.select("h", F.col("cls").alias("ref")).join(marks, "h").where("ref < cls").select("ref", "cls").distinct()
        self.candidates = materialize(pairs, "span-candidates")
        self.texts = one.dropDuplicates(["cls"])

    def matched(self, both: bool) -> DataFrame:
        """``ref, cls, spans``: maximal spans of class ``cls`` in each shard of ``ref``; with ``both`` also the other way round."""
        pairs = self.candidates
        if both:
            pairs = pairs.unionByName(pairs.select(F.col("cls").alias("ref"), F.col("ref").alias("cls")))
        slots = pairs.groupBy("ref").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("slots"))
        wide = pairs.join(slots, "ref").withColumn("slot", F.pmod(F.xxhash64("cls"), F.col("slots")).cast("int"))
        needed = pairs.select("cls").union(pairs.select("ref")).distinct()
        texts = self.texts.join(needed, "cls", "left_semi")
        # A task holds one shard of one reference; a run that crosses shards stands whole in their overlap.
        step = SHARD - (MIN_SPAN - 1)
        last = lambda n: F.ceil(F.greatest(n - (MIN_SPAN - 1), F.lit(1)) / step).cast("int") - 1
        refs = slots.withColumnRenamed("ref", "cls").join(texts, "cls").withColumn("shard", F.explode(F.sequence(F.lit(0), last(F.length("text")))))
        refs = refs.select(F.col("cls").alias("ref"), "shard", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(None).cast("binary").alias("cls"), F.substr("text", F.col("shard") * step + 1, F.lit(SHARD)).alias("text"))
        sizes = texts.select(F.col("cls").alias("ref"), last(F.length("text")).alias("last"))
        docs = wide.join(sizes, "ref").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).join(texts, "cls").select("ref", "shard", "slot", "cls", "text")
        # A shard comes before the documents streamed through it; nothing but its automaton is held.
        rows = refs.unionByName(docs).repartition("ref", "shard", "slot").sortWithinPartitions("ref", "shard", "slot", F.col("cls").asc_nulls_first())
        schema = StructType.fromDDL("ref binary, cls binary, spans array<struct<start:int,length:int>>")
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton: Automaton | None = None
            for b in slices(batches):
                out: list[dict] = []
                for ref, cls, text in zip(b["ref"].to_pylist(), b["cls"].to_pylist(), b["text"].to_pylist(), strict=True):
                    if cls is None:
                        automaton = Automaton(text)
                        continue
                    if spans := automaton.spans(text):
                        out.append({"ref": ref, "cls": cls, "spans": [{"start": s, "length": n} for s, n in spans]})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

        return rows.mapInArrow(run, schema)

    def counted(self) -> DataFrame:
        """``cls, start, stop``: runs of ``MIN_SPAN`` characters that stand in several classes, among those whose
        window has a fingerprint of more than ``paired`` classes. Runs are counted by a 128-bit hash with
        map-side combining; no pair is formed, so a group of any size takes time in proportion to its texts."""
        own = self.hot.groupBy("cls").agg(F.collect_set("h").alias("hs"))  # a text's own windows
        docs = own.join(self.texts, "cls").select("cls", "hs", "text")

        def make():
            first, second = Hasher(), Hasher(_OTHER)

            def f(cls, hs, text):
                at = np.flatnonzero(np.isin(first.windows(text).view(np.int64), np.array(hs, np.int64)))
                a, b = first.grams(text, MIN_SPAN)[at], second.grams(text, MIN_SPAN)[at]
                for i, x, y in zip(at.tolist(), a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True):
                    yield cls, i, x, y

            return f

        runs = materialize(common.map_rows(docs, "cls binary, start int, a long, b long", make), "span-runs")
        several = runs.groupBy("a", "b").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("a", "b")
        return runs.join(several, ["a", "b"], "left_semi").select("cls", "start", (F.col("start") + MIN_SPAN).alias("stop"))


def shared_pairs(records: DataFrame) -> DataFrame:
    """``file_a, file_b`` with file_a < file_b: all pairs of records that share a run of ``MIN_SPAN`` characters.

    The result itself asks for pairs; inside, only classes of equal texts are paired, and members come last.
    """
    s = Sharing(records)
    m = s.members.where(F.col("n") >= MIN_SPAN).select("id", "cls")
    other = m.select(F.col("id").alias("id_b"), F.col("cls").alias("cls_b"))
    links = materialize(s.matched(both=False).select("ref", "cls").distinct(), "span-links")
    across = links.join(m.withColumnRenamed("cls", "ref"), "ref").join(other.withColumnRenamed("cls_b", "cls"), "cls").select("id", "id_b")
    within = m.join(other, F.col("cls") == F.col("cls_b")).where("id < id_b").select("id", "id_b")
    return across.unionByName(within).select(F.least("id", "id_b").alias("file_a"), F.greatest("id", "id_b").alias("file_b"))


def shared_spans(records: DataFrame) -> DataFrame:
    """One row a record: ``id, n_chars, copies`` (records with the same text), ``shared_chars`` (its characters
    that stand elsewhere in a run of ``MIN_SPAN`` or more) and ``spans``, the stretches themselves, merged."""
    s = Sharing(records, PAIRED)
    copies = s.members.groupBy("cls").agg(F.count_distinct("id").alias("copies"))
    found = s.matched(both=True)

    # Spans of one class come from all its partners; they are cut to distinct ones, then merged per class.
    spans = found.select("cls", F.explode("spans").alias("x")).select("cls", "x.start", (F.col("x.start") + F.col("x.length")).alias("stop"))
    spans = spans.unionByName(s.counted()).distinct()
    from pyspark.sql import Window

    w = Window.partitionBy("cls").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(w)).groupBy("cls", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    per = runs.groupBy("cls").agg(F.sum(F.col("stop") - F.col("start")).alias("part"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    rows = s.members.join(copies, "cls").join(per, "cls", "left")
    whole = (F.col("copies") > 1) & (F.col("n") >= MIN_SPAN)
    return rows.select(
        "id",
        F.col("n").alias("n_chars"),
        "copies",
        F.when(whole, F.col("n").cast("long")).otherwise(F.coalesce("part", F.lit(0)).cast("long")).alias("shared_chars"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("stop")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>"))).alias("spans"),
    )
