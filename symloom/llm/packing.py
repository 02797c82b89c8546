"""Problem 6: filling containers of fixed capacity.

Method: conflict-constrained best fit. The open containers are ordered by the space left; each carries a
bitmap of the sources and one of the duplicate clusters it holds. For an item, largest first, the
successor search starts at the least space that is enough and goes on until a compatible container is
found; else a new one is opened.

The items are spread over shards of about ``SHARD_ROWS`` by a hash of their id and each shard is packed by
itself: a shard loses at most a part of a container, and no group grows with the data.

Conflicts: two copies of one text do not share a container. Where a cluster has more copies than the shard
needs containers, a container holds as few of them as an even spread gives: sets of as many copies as there
are containers needed, of which no two meet. Pairs of sources that must not meet are an argument (none by default).

Defined results: an item larger than the capacity is split into full pieces and a rest, no other is split;
null texts are not placed; empty texts take no tokens but their separator; repeated ids are placed as often
as they stand in the table.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.tokens import RANKS, count_tokens
from symloom.storage import materialize

SHARD_ROWS = 20_000


class Bins:
    """Open containers by the space left, with what each holds."""

    def __init__(self, capacity: int, separator: int, apart: dict[int, int] | None = None) -> None:
        self.capacity, self.separator = capacity, separator
        self.apart = apart or {}
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.present = 0  # bit r: some container has r tokens left

    def _move(self, b: int, new: int) -> None:
        old = self.left[b]
        self.by_left[old].remove(b)
        if not self.by_left[old]:
            self.present &= ~(1 << old)
        self._put(b, new)

    def _put(self, b: int, left: int) -> None:
        self.left[b] = left
        self.by_left[left].append(b)
        self.present |= 1 << left

    def add(self, size: int, source: int = 0, cluster: int = 0) -> int:
        """Places an item; ``source`` and ``cluster`` are bits (0: none). Returns its container."""
        need = size + self.separator
        foes = self.apart.get(source, 0)
        if need <= self.capacity:
            ahead = self.present >> need
            while ahead:
                step = (ahead & -ahead).bit_length() - 1
                need_left = need + step
                for b in reversed(self.by_left[need_left]):
                    if not (self.clusters[b] & cluster or self.sources[b] & foes):
                        self._move(b, need_left - need)
                        self.clusters[b] |= cluster
                        self.sources[b] |= source
                        return b
                ahead = self.present >> (need_left + 1)
                need_left += 1
                if not ahead:
                    break
                # Go on with the next tighter-first space; positions are counted from ``need``.
                ahead <<= need_left - need
        b = len(self.left)
        self.left.append(0)
        self.sources.append(source)
        self.clusters.append(cluster)
        self._put(b, self.capacity - size)
        return b


def pack(items: Sequence[tuple[int, str | None, bytes | None]], capacity: int, separator: int, apart: Sequence[tuple[str, str]] = ()) -> tuple[list[int], Bins]:
    """Containers of ``(size, source, cluster)`` items, in their order; each size is at most the capacity."""
    bit: dict[str, int] = {}
    for s in sorted({s for _, s, _ in items if s is not None}):
        bit[s] = 1 << len(bit)
    foes: dict[int, int] = {}
    for a, b in apart:
        if a in bit and b in bit:
            foes[bit[a]] = foes.get(bit[a], 0) | bit[b]
            foes[bit[b]] = foes.get(bit[b], 0) | bit[a]
    copies: dict[bytes, int] = {}
    for _, _, c in items:
        if c is not None:
            copies[c] = copies.get(c, 0) + 1
    least = -(-sum(s for s, _, _ in items) // capacity) if capacity else 0
    # Copies that are more than the containers needed anyway go into as many sets of that size as it takes; two
    # of one set do not meet, so a container holds as few copies as an even spread allows.
    bit_of: dict[tuple[bytes, int], int] = {}
    met: dict[bytes, int] = {}
    cluster = [0] * len(items)
    for i, (_, _, c) in enumerate(items):
        if c is not None and copies[c] > 1 and least > 1:
            k = met[c] = met.get(c, -1) + 1
            cluster[i] = bit_of.setdefault((c, k // least), 1 << len(bit_of))
    bins = Bins(capacity, separator, foes)
    where = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, source, _ = items[i]
        where[i] = bins.add(size, bit.get(source, 0), cluster[i])
    return where, bins


def packed(documents: DataFrame, specs: DataFrame, ranks_path: str = RANKS, apart: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """One row a piece: ``spec_id, container, doc_id, piece, tokens, container_free``.

    Texts are read and counted once; from then on only ids, sizes and 16-byte keys are moved.
    """
    rows = documents.where("doc_id is not null and text is not null")
    rows = rows.select("doc_id", F.lower(F.trim("source")).alias("source"), F.unhex(F.md5("text")).alias("cluster"), "text")
    sized = materialize(count_tokens(rows, "text", ranks_path), "pack-sizes")
    cap = F.col("capacity_tokens")
    runs = sized.join(F.broadcast(specs.where("capacity_tokens > 0").select("spec_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator_tokens"))))
    last = F.when(F.col("tokens") <= cap, 0).otherwise(F.floor((F.col("tokens") - 1) / cap)).cast("int")
    pieces = runs.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    pieces = pieces.withColumn("size", F.when(F.col("piece") < last, cap).otherwise(F.col("tokens") - cap * last).cast("long"))
    # Full pieces fill a container by themselves; they are placed without being gathered anywhere.
    whole = pieces.where((F.col("size") == cap) & (F.col("tokens") > cap))
    rest = pieces.where(~((F.col("size") == cap) & (F.col("tokens") > cap)))
    full = whole.select("spec_id", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), "doc_id", "piece", F.col("size").alias("tokens"), F.lit(0).cast("long").alias("container_free"))
    # Shards of about SHARD_ROWS items; the count is one pass over the sizes.
    shards = max(1, -(-sized.count() // SHARD_ROWS))
    spread = rest.select("spec_id", "capacity_tokens", "separator_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "piece", "size", "source", "cluster")
    pairs = tuple(apart)

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        col = {c: group[c].to_pylist() for c in ("spec_id", "capacity_tokens", "separator_tokens", "shard", "doc_id", "piece", "size", "source", "cluster")}
        where, bins = pack(list(zip(col["size"], col["source"], col["cluster"], strict=True)), col["capacity_tokens"][0], col["separator_tokens"][0], pairs)
        shard = col["shard"][0]
        return pa.table(
            {
                "spec_id": pa.array(col["spec_id"], pa.int32()),
                "container": pa.array([f"{shard}-{b}" for b in where], pa.string()),
                "doc_id": pa.array(col["doc_id"], pa.int64()),
                "piece": pa.array(col["piece"], pa.int32()),
                "tokens": pa.array(col["size"], pa.int64()),
                "container_free": pa.array([bins.left[b] for b in where], pa.int64()),
            }
        )

    schema = "spec_id int, container string, doc_id long, piece int, tokens long, container_free long"
    return spread.groupBy("spec_id", "shard").applyInArrow(fill, schema).unionByName(full.select(F.col("spec_id").cast("int"), "container", "doc_id", F.col("piece").cast("int"), "tokens", "container_free"))


def unused(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per run: containers, tokens placed, tokens left over (separators apart), and the least containers that could do."""
    per = placed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("tokens"), F.min("container_free").alias("free"))
    total = per.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("free").alias("unused_tokens"))
    return total.join(F.broadcast(specs), "spec_id").select("spec_id", "containers", "tokens", "unused_tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"))
