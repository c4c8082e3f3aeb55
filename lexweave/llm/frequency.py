"""Problem 7: rows and files of every distinct term, by burst-trie counting.

Distinct (term, file) cells are formed first, combined on the map side, so that a term with a third of all rows is spread
by its files. Each task then counts its cells in a burst trie: a node holds a small table of suffixes until it bursts into
one child per character, so hot prefixes get deep paths and rare ones stay shallow. A task sends its leaf tables with the
prefix they stand under, front-coded; an adaptive router of the prefixes that are heavy over all tasks sends each term where
all its counters meet, whatever the depth of its leaf, and matching subtrees are merged there. A term's counters are one number pair per task by then.

Defined results: rows without term or file are left out; the empty text is a term; terms and files are compared as they
stand; the rows of an instance delivered twice count twice; ``rare`` goes before ``common``; an empty table gives no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import cut

BURST = 256
MAX_DEPTH = 64


class BurstTrie:
    """Counters (occurrences, records) by term. ``root`` is a table until it bursts; a burst node maps a character to its child."""

    __slots__ = ("burst", "root")

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.root: Leaf | Node = Leaf()

    def add(self, term: str, occurrences: int, records: int) -> None:
        """Add to a term's counters, bursting the leaf it falls into when that grew too large."""
        node, parent, at = self.root, None, 0
        while type(node) is Node:
            if at == len(term):
                node.occurrences += occurrences
                node.records += records
                node.ends = True
                return
            parent = node
            node = parent.children.get(term[at])
            if node is None:
                node = parent.children[term[at]] = Leaf()
            at += 1
        suffix = term[at:]
        pair = node.table.get(suffix)
        if pair is not None:
            pair[0] += occurrences
            pair[1] += records
            return
        node.table[suffix] = [occurrences, records]
        if len(node.table) > self.burst and at < MAX_DEPTH:
            new = Node()
            for s, (o, r) in node.table.items():
                if s:
                    new.children.setdefault(s[0], Leaf()).table[s[1:]] = [o, r]
                else:
                    new.occurrences, new.records, new.ends = o, r, True
            if parent is None:
                self.root = new
            else:
                parent.children[term[at - 1]] = new

    def leaves(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """Every (prefix, table), in no special order; a burst node's own term comes as the empty suffix."""
        todo: list[tuple[str, Leaf | Node]] = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if type(node) is Leaf:
                if node.table:
                    yield prefix, node.table
            else:
                if node.ends:
                    yield prefix, {"": [node.occurrences, node.records]}
                todo += [(prefix + c, child) for c, child in node.children.items()]


class Leaf:
    __slots__ = ("table",)

    def __init__(self):
        self.table: dict[str, list[int]] = {}


class Node:
    __slots__ = ("children", "ends", "occurrences", "records")

    def __init__(self):
        self.children: dict[str, Leaf | Node] = {}
        self.occurrences = self.records = 0
        self.ends = False


def front_coded(suffixes: list[str]) -> tuple[list[int], list[str]]:
    """Sorted suffixes as lengths shared with the one before, and what follows."""
    shared, rest, last = [], [], ""
    for s in suffixes:
        n = 0
        top = min(len(s), len(last))
        while n < top and s[n] == last[n]:
            n += 1
        shared.append(n)
        rest.append(s[n:])
        last = s
    return shared, rest


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie = BurstTrie()
    for batch in batches:
        # the batch's own repetitions first
        sums = batch.groupby("term", sort=False)["n"].agg(["sum", "size"])
        for term, o, r in zip(sums.index, sums["sum"].tolist(), sums["size"].tolist(), strict=True):
            trie.add(term, o, r)
    out: list[tuple] = []
    for prefix, table in trie.leaves():
        suffixes = sorted(table)
        shared, rest = front_coded(suffixes)
        out.append((prefix, shared, rest, [table[s][0] for s in suffixes], [table[s][1] for s in suffixes]))
        if len(out) >= 2000:
            yield pd.DataFrame(out, columns=_BLOCK)
            out = []
    if out:
        yield pd.DataFrame(out, columns=_BLOCK)


_BLOCK = ["prefix", "shared", "rest", "occurrences", "records"]
_BLOCK_DDL = "prefix string, shared array<int>, rest array<string>, occurrences array<long>, records array<long>"


def shortest(term: str, heavy: frozenset[str]) -> str:
    """Where a term is merged: its shortest prefix that is not heavy. It depends on nothing but the term."""
    k = 1
    while k < len(term) and term[:k] in heavy:
        k += 1
    return term[:k]


def _routed(batches: Iterator[pd.DataFrame], heavy: frozenset[str]) -> Iterator[pd.DataFrame]:
    """Blocks with their route. Tasks burst to unequal depths, so a leaf that stands above its terms' routes is split by them."""
    for batch in batches:
        out: list[tuple] = []
        for prefix, shared, rest, occurrences, records in zip(*(batch[c] for c in _BLOCK), strict=True):
            route = shortest(prefix, heavy)
            if route and route not in heavy:
                out.append((prefix, shared, rest, occurrences, records, route))
                continue
            parts: dict[str, list[tuple[str, int, int]]] = {}
            last = ""
            for n, tail, o, r in zip(shared, rest, occurrences, records, strict=True):
                last = last[:n] + tail
                parts.setdefault(shortest(prefix + last, heavy), []).append((last, int(o), int(r)))
            for route, part in parts.items():
                out.append((prefix, *front_coded([x[0] for x in part]), [x[1] for x in part], [x[2] for x in part], route))
        yield pd.DataFrame(out, columns=[*_BLOCK, "route"])


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie = BurstTrie(4 * BURST)
    for batch in batches:
        for prefix, shared, rest, occurrences, records in zip(*(batch[c] for c in _BLOCK), strict=True):
            last = ""
            for n, tail, o, r in zip(shared, rest, occurrences, records, strict=True):
                last = last[:n] + tail
                trie.add(prefix + last, int(o), int(r))
    for part in _sized(trie):
        yield pd.DataFrame(part, columns=["term", "n_rows", "n_files"])


def _sized(trie: BurstTrie, size: int = 20_000) -> Iterator[list[tuple[str, int, int]]]:
    out: list[tuple[str, int, int]] = []
    for prefix, table in trie.leaves():
        out += [(prefix + s, o, r) for s, (o, r) in table.items()]
        if len(out) >= size:
            yield out
            out = []
    if out:
        yield out


def count_terms(df: DataFrame, term: str = "cand_match", file: str = "file_name", pieces: int | None = None) -> DataFrame:
    """``term, n_rows, n_files`` for every distinct non-null term.

    The router is the set of prefixes under which more than one of ``pieces`` parts of all entries stand (by default four for
    each shuffle partition): fewer than ``pieces`` of each length up to the depth of a trie, whatever the size of the table.
    """
    spark = df.sparkSession
    pieces = pieces or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = df.where(F.col(term).isNotNull() & F.col(file).isNotNull()).groupBy(F.col(term).alias("term"), F.col(file).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    blocks = cut(cells.select("term", "n").mapInPandas(_count, _BLOCK_DDL))
    entries = blocks.select("prefix", F.size("rest").alias("n"))
    total = entries.agg(F.sum("n").alias("total"))  # one row
    # the weight of a prefix is that of all leaves on or below it; terms of heavy ones are passed on, one character deeper
    paths = entries.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.length("prefix") > 0)
    weights = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("prefix")), lambda k: F.substring(F.col("prefix"), F.lit(1), k))).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    heavy = frozenset(r.p for r in weights.crossJoin(F.broadcast(total)).where(F.col("n") * pieces > F.col("total")).select("p").collect())  # below pieces x MAX_DEPTH
    router = spark.sparkContext.broadcast(heavy)
    routed = blocks.mapInPandas(lambda batches: _routed(batches, router.value), f"{_BLOCK_DDL}, route string")
    return routed.repartition("route").drop("route").mapInPandas(_merge, "term string, n_rows long, n_files long")


def marked(df: DataFrame, term: str = "cand_match", file: str = "file_name", rare: int = 2, common: float = 0.01) -> DataFrame:
    """Counts with ``mark``: rare with at most ``rare`` files, else common with more than the share ``common`` of all files, else null."""
    files = df.where(F.col(file).isNotNull()).select(F.col(file).alias("f")).distinct().agg(F.count(F.lit(1)).alias("n_all"))
    counts = count_terms(df, term, file).crossJoin(F.broadcast(files))  # one row
    return counts.select("term", "n_rows", "n_files", F.when(F.col("n_files") <= rare, "rare").when(F.col("n_files") / F.col("n_all") > common, "common").alias("mark"))
