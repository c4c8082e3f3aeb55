"""Problem 9: documents packed into containers of a fixed number of tokens.

Only how many items there are of each length matters for the packing, and there are at most ``capacity`` lengths. So the plan
is made on that histogram, whatever the size of the corpus: lengths are taken from the largest down, the gap each
leaves is looked up among single, pair and triple sums of the lengths still available, exact fills are consumed as often
as the counts allow, and what remains is placed best-fit. The plan is a few thousand intervals of ranks; a document finds
its container by its rank among the documents of its length. Ranks are counted in buckets whose number follows that of the
items, so no task holds a whole length, however many documents have it.

Defined results: a document longer than the capacity is cut into full pieces and a rest, others are never cut; documents
without tokens (null, empty) take no space and are spread over the containers (over container 0 where there is none); a null id is kept; repeated rows are items of
their own; an empty table gives no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.encoding import token_counts
from lexweave.session import cut

CAPACITY = 4096
#: Items of one length that a task ranks, at most about so many.
BUCKET = 200_000


class Stock:
    """How many items there are of each length below the capacity, with the sums of two and three available lengths."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(counts)
        self.singles = sum(1 << n for n in counts)
        self.stale, self._pairs = True, 0

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.singles &= ~(1 << length)
            self.stale = True

    def pairs(self) -> int:
        """Bit s is set where two available lengths sum to s (a length with itself only where there are two)."""
        if self.stale:
            mask, out = (1 << (self.capacity + 1)) - 1, 0
            for n, k in self.left.items():
                out |= (self.singles if k > 1 else self.singles & ~(1 << n)) << n
            self._pairs, self.stale = out & mask, False
        return self._pairs

    def pair(self, total: int, less: dict[int, int]) -> tuple[int, int] | None:
        """Two available lengths that sum to ``total``, the larger as large as can be; ``less`` is set aside."""
        have = lambda n: self.left.get(n, 0) - less.get(n, 0)
        for a in self.lengths_below(total):
            if 2 * a < total:
                return None
            b = total - a
            if self.singles >> b & 1 and have(a) > 0 and have(b) > (a == b):
                return a, b
        return None

    def lengths_below(self, total: int) -> Iterator[int]:
        bits = self.singles & ((1 << total) - 1)
        while bits:
            n = bits.bit_length() - 1
            yield n
            bits ^= 1 << n

    def filling(self, gap: int, length: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill ``gap`` exactly beside an item of ``length``."""
        less = {length: 1}
        if self.left.get(gap, 0) - less.get(gap, 0) > 0:
            return (gap,)
        if self.pairs() >> gap & 1 and (two := self.pair(gap, less)):
            return two
        pairs = self.pairs()
        for a in self.lengths_below(gap):
            if 3 * a < gap:
                break
            if self.left[a] - less.get(a, 0) > 0 and pairs >> (gap - a) & 1 and (two := self.pair(gap - a, {length: 1} | {a: 1 + (a == length)})):
                return (a, *two)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one container, largest first) and how many containers follow each."""
    stock = Stock({n: k for n, k in counts.items() if 0 < n < capacity and k > 0}, capacity)
    out: list[tuple[tuple[int, ...], int]] = [((capacity,), counts[capacity])] if counts.get(capacity) else []
    rest: dict[int, int] = {}
    for length in range(capacity - 1, 0, -1):
        while (k := stock.left.get(length, 0)) and (fill := stock.filling(capacity - length, length)):
            pattern = (length, *fill)
            uses = {n: pattern.count(n) for n in pattern}
            times = min(stock.left[n] // u for n, u in uses.items())
            if not times:
                break
            for n, u in uses.items():
                stock.take(n, times * u)
            out.append((tuple(sorted(pattern, reverse=True)), times))
        if k := stock.left.get(length, 0):
            rest[length] = k
            stock.take(length, k)
    # best fit of what is left: containers alike in content are one group
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    open_gaps = 0
    for length in sorted(rest, reverse=True):
        k = rest[length]
        while k:
            fits = open_gaps >> length
            if fits:
                gap = length + (fits & -fits).bit_length() - 1
                content, many = groups[gap].pop()
                if not groups[gap]:
                    open_gaps &= ~(1 << gap)
                used = min(k, many)
                if many > used:
                    groups.setdefault(gap, []).append((content, many - used))
                    open_gaps |= 1 << gap
                content, gap, many = (*content, length), gap - length, used
                k -= used
            else:
                per = capacity // length
                many, per = (k // per, per) if k >= per else (1, k)
                content, gap = (length,) * per, capacity - per * length
                k -= many * per
            groups.setdefault(gap, []).append((content, many))
            open_gaps |= 1 << gap
    return out + [g for gap in sorted(groups) for g in groups[gap]]


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``length, first rank, ranks, per container, first container`` for every length of every pattern."""
    out, used, base = [], {}, 0
    for content, many in patterns:
        for n in dict.fromkeys(content):
            per = content.count(n)
            out.append((n, used.get(n, 0), many * per, per, base))
            used[n] = used.get(n, 0) + many * per
        base += many
    return out


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """From ``doc_id, n_tokens``: ``doc_id, piece_no, start_token, n_tokens, container_id``."""
    spark = sizes.sparkSession
    pieces = sizes.select(
        "doc_id",
        F.explode(F.expr(f"CASE WHEN n_tokens > 0 THEN sequence(1, cast(ceil(n_tokens / {capacity}) as int)) ELSE array(1) END")).alias("piece_no"),
        F.col("n_tokens").alias("whole"),
    )
    start = F.greatest(F.lit(0), (F.col("piece_no") - 1) * capacity)
    pieces = pieces.select("doc_id", "piece_no", start.alias("start_token"), F.least(F.lit(capacity), F.col("whole") - start).alias("n_tokens"))
    pieces = cut(pieces.withColumn("h", F.xxhash64("doc_id", "piece_no", F.monotonically_increasing_id())))
    histogram = pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity + 1 rows
    counts = {r.n_tokens: r.n for r in histogram if r.n_tokens > 0}
    buckets = -(-max((r.n for r in histogram), default=1) // BUCKET)
    pieces = pieces.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    patterns = plan(counts, capacity)
    total = sum(many for _, many in patterns)
    slots = pd.DataFrame(intervals(patterns), columns=["n_tokens", "first", "ranks", "per", "base"]).sort_values(["n_tokens", "first"])
    by_length = {int(n): (g["first"].to_numpy(), g["per"].to_numpy(), g["base"].to_numpy()) for n, g in slots.groupby("n_tokens")}
    held = spark.sparkContext.broadcast(by_length)  # a few intervals for each length up to the capacity
    sizes_of = pieces.where("n_tokens > 0").groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # the buckets of one length
    offsets = sizes_of.select("n_tokens", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.pandas_udf("long")
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        out = pd.Series(0, index=length.index, dtype="int64")
        for n, at in length.groupby(length).groups.items():
            first, per, base = held.value[int(n)]
            r = rank.loc[at].to_numpy()
            i = first.searchsorted(r, "right") - 1
            out.loc[at] = base[i] + (r - first[i]) // per[i]
        return out

    rank = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece_no", "h")) - 1
    sized = pieces.where("n_tokens > 0").withColumn("rank", rank).join(offsets, ["n_tokens", "bucket"])
    placed = sized.select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), F.col("start_token").cast("int").alias("start_token"), F.col("n_tokens").cast("int").alias("n_tokens"), container(F.col("n_tokens"), F.col("before") + F.col("rank")).alias("container_id"))
    spread = F.pmod(F.col("h"), F.lit(max(1, total))).cast("long")
    none = pieces.where("n_tokens = 0").select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), F.lit(0).alias("start_token"), F.lit(0).alias("n_tokens"), spread.alias("container_id"))
    return placed.unionByName(none)


def containers(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents, sized by the public tokenizer, in containers."""
    return pack(token_counts(documents), capacity)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """``containers, tokens, fill, lower_bound``: the share of the space used, and how few containers could do."""
    c = packed.where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return c.agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), (F.sum("t") / (F.count(F.lit(1)) * capacity)).alias("fill"), F.ceil(F.sum("t") / capacity).alias("lower_bound"))


def check(packed: DataFrame, capacity: int) -> DataFrame:
    """``n_docs, n_overfull, n_cut``: the documents in containers, the containers above capacity, and the documents cut without need (none should be)."""
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.coalesce(F.sum((F.col("t") > capacity).cast("long")), F.lit(0)).alias("n_overfull"))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("t"))
    docs = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(((F.col("k") > 1) & (F.col("t") <= capacity)).cast("long")), F.lit(0)).alias("n_cut"))
    return docs.crossJoin(F.broadcast(over))  # one row
