"""Problem 6: train, validation and test sets that keep related files together.

Authors and threads are nodes, each file that names both is an edge. Borůvka rounds contract every component along its
smallest edge; the chosen edges are the spanning forest, kept in the checkpoint folder round by round and given out by
``forest`` or written for good by ``save_forest``. Nothing but counts reaches the driver: joins of nodes and edges are merge
joins, as no size of them is bounded. Roots are put into bands of size; within a band they are dealt to the splits at even steps, the
largest bands first, each band correcting what the larger ones left.

Defined results: file names are read whatever their spelling (case, separators, folders, endings, zeros); ``anon`` and a
missing number link nothing; files with neither number, and groups without an author, have no group author; a null file
name is left out; repeated names count once as files but each row counts in the size of its group; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import cut

PARTS = {"train": 0.8, "validation": 0.1, "test": 0.1}
GOLDEN = 0.6180339887498949


def number_in(file_name: Column, letter: str) -> Column:
    """The number behind ``letter`` where it stands as a part of its own; null when there is none."""
    return F.nullif(F.regexp_extract(file_name, rf"(?i)(?:^|[^a-z0-9]){letter}(\d{{1,18}})(?![a-z0-9])", 1), F.lit("")).cast("long")


@dataclass
class Forest:
    """``labels``: node, root. ``edges``: the spanning forest, author and thread. Nodes are 2 x author and 2 x thread + 1."""

    labels: DataFrame
    edges: DataFrame
    rounds: int


def _by(df: DataFrame) -> DataFrame:
    """A side that is not to be broadcast; hot keys are left to the adaptive skew join."""
    return df.hint("merge")


def spanning_forest(pairs: DataFrame, most_rounds: int = 60) -> Forest:
    """Contract the graph of distinct (author, thread) pairs.

    Edges are ordered by a hash, then by their ends, so no two are equal and no cycle can close. Every component at least
    doubles in a round. Grouping for the smallest edge combines on the map side; joins on a hub are split by the
    adaptive skew join, as only the side of the edges is large.
    """
    a, t = F.col("author") * 2, F.col("thread") * 2 + 1
    edges = cut(pairs.where("author is not null and thread is not null").select("author", "thread").distinct().select(a.alias("u"), t.alias("v"), F.struct(F.xxhash64("author", "thread").alias("h"), F.col("author").alias("a"), F.col("thread").alias("t")).alias("w")))
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    labels = cut(nodes.select("node", F.col("node").alias("root")))
    chosen: DataFrame | None = None
    for done in range(most_rounds):  # noqa: B007
        both = edges.select(F.col("u").alias("c"), F.col("v").alias("o"), "w").union(edges.select(F.col("v").alias("c"), F.col("u").alias("o"), "w"))
        least = cut(both.groupBy("c").agg(F.min(F.struct("w", "o")).alias("m")).select("c", F.col("m.o").alias("p"), F.col("m.w").alias("w")))
        if least.isEmpty():
            break
        picked = least.select(F.col("w.a").alias("author"), F.col("w.t").alias("thread"))
        chosen = picked if chosen is None else chosen.union(picked)
        # of two components that chose the same edge the smaller becomes the root
        back = least.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        up = least.select("c", "p").join(_by(back), "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        up = cut(up)
        for _ in range(most_rounds):  # pointer doubling
            above = up.select(F.col("c").alias("p"), F.col("p").alias("q"))
            nxt = cut(up.join(_by(above), "p").select("c", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            moved = not nxt.where("moved").isEmpty()
            up = nxt.select("c", "p")
            if not moved:
                break
        labels = cut(labels.join(_by(up.select(F.col("c").alias("root"), F.col("p").alias("r"))), "root", "left").select("node", F.coalesce("r", "root").alias("root")))
        ru, rv = up.select(F.col("c").alias("u"), F.col("p").alias("ru")), up.select(F.col("c").alias("v"), F.col("p").alias("rv"))
        moved_edges = edges.join(_by(ru), "u").join(_by(rv), "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"), "w")
        edges = cut(moved_edges.groupBy("u", "v").agg(F.min("w").alias("w")))
    else:
        raise RuntimeError("the contraction did not end")
    empty = pairs.select("author", "thread").limit(0)
    return Forest(labels, (chosen if chosen is not None else empty).distinct(), done)


def file_groups(df: DataFrame, file: str = "file_name") -> DataFrame:
    """``file_name, n_rows, author, thread, root, group_author`` for every distinct file name; root is null without any number."""
    files = df.where(F.col(file).isNotNull()).groupBy(F.col(file).alias("file_name")).agg(F.count(F.lit(1)).alias("n_rows"))
    files = cut(files.select("file_name", "n_rows", number_in(F.col("file_name"), "u").alias("author"), number_in(F.col("file_name"), "t").alias("thread")))
    forest = spanning_forest(files)
    # a node without a partner is its own root
    node = F.coalesce(F.col("thread") * 2 + 1, F.col("author") * 2)
    known = files.withColumn("node", node)
    placed = known.join(_by(forest.labels), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lone = files.where("author is not null and thread is null").select("author").distinct()
    authors = forest.labels.where("node % 2 = 0").select("root", F.expr("node div 2").alias("a")).union(lone.join(forest.labels.where("node % 2 = 0").select(F.expr("node div 2").alias("author")), "author", "left_anti").select(F.col("author") * 2, "author"))
    least = authors.groupBy("root").agg(F.min("a").alias("group_author"))
    return placed.join(_by(least), "root", "left").select("file_name", "n_rows", "author", "thread", "root", "group_author")


def _edges(df: DataFrame, file: str) -> Forest:
    names = df.where(F.col(file).isNotNull()).select(file).distinct()
    return spanning_forest(names.select(number_in(F.col(file), "u").alias("author"), number_in(F.col(file), "t").alias("thread")))


def forest(df: DataFrame, file: str = "file_name") -> DataFrame:
    """``author, thread, root``: the edges of the spanning forest with the tree they belong to."""
    f = _edges(df, file)
    return f.edges.join(_by(f.labels.where("node % 2 = 0").select(F.expr("node div 2").alias("author"), "root")), "author").select("author", "thread", "root")


def tree_sizes(df: DataFrame, file: str = "file_name") -> DataFrame:
    """``group_author, n_nodes, n_edges`` of every tree: one edge less than it has authors and threads."""
    f = _edges(df, file)
    nodes = f.labels.groupBy("root").agg(F.min(F.when(F.col("node") % 2 == 0, F.expr("node div 2"))).alias("group_author"), F.count(F.lit(1)).alias("n_nodes"))
    author = f.labels.where("node % 2 = 0").select(F.expr("node div 2").alias("author"), "root")
    edges = f.edges.join(_by(author), "author").groupBy("root").agg(F.count(F.lit(1)).alias("n_edges"))
    return nodes.join(_by(edges), "root").select("group_author", "n_nodes", "n_edges")


def save_forest(df: DataFrame, path: str, file: str = "file_name") -> None:
    """The edges of the forest as a table, for later runs."""
    forest(df, file).write.mode("overwrite").parquet(path)


def found(df: DataFrame, file: str = "file_name") -> DataFrame:
    """``file_name, group_author`` of the groups with an author."""
    return file_groups(df, file).where("group_author is not null").select("file_name", "group_author")


def _plan(bands: list[tuple[int, int, int]], parts: dict[str, float]) -> dict[int, list[float]]:
    """For each band (number, groups, rows) the upper ends of the splits' intervals in [0, 1), largest band first."""
    total, names = sum(r for _, _, r in bands), list(parts)
    given, left, out = dict.fromkeys(names, 0.0), float(total), {}
    for band, n, rows in sorted(bands, reverse=True):
        lack = [max(0.0, parts[x] * total - given[x]) for x in names]
        whole = sum(lack) or 1.0
        ends, at = [], 0.0
        for x in lack:
            at += x / whole
            ends.append(at)
        ends[-1] = 1.0
        out[band] = ends
        hits = [0] * len(names)
        if n <= 10_000:
            for r in range(n):
                x = (r * GOLDEN) % 1.0
                hits[next(i for i, e in enumerate(ends) if x < e)] += 1
        else:
            hits = [n * (e - b) for e, b in zip(ends, [0.0, *ends], strict=False)]
        for x, h in zip(names, hits, strict=True):
            given[x] += rows * h / n
        left -= rows
    return out


def assign_splits(df: DataFrame, file: str = "file_name", parts: dict[str, float] | None = None, buckets: int = 256) -> DataFrame:
    """``file_name, root, split``: every distinct file name with its group and split.

    The rank within a band is counted in ``buckets`` pieces and offset by the pieces before, so that no task holds a band.
    Files without any number form groups of their own name.
    """
    spark = df.sparkSession
    parts = parts or PARTS
    files = cut(file_groups(df, file).withColumn("group", F.coalesce(F.col("root").cast("string"), F.concat(F.lit("f:"), "file_name"))))
    roots = files.groupBy("group").agg(F.sum("n_rows").alias("size")).select("group", "size", F.floor(F.log2("size")).cast("int").alias("band"), F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int").alias("bucket"))
    roots = cut(roots)
    pieces = roots.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("rows")).collect()  # at most 63 x buckets rows
    before, at, sums = [], {}, {}
    for p in sorted(pieces, key=lambda p: (p.band, p.bucket)):
        before.append((p.band, p.bucket, at.get(p.band, 0)))
        at[p.band] = at.get(p.band, 0) + p.n
        sums[p.band] = sums.get(p.band, 0) + p.rows
    plan = _plan([(b, at[b], sums[b]) for b in at], parts)
    names = list(parts)
    offsets = spark.createDataFrame([(*x, *[float(e) for e in plan[x[0]]]) for x in before], "band int, bucket int, before long, " + ", ".join(f"e{i} double" for i in range(len(names))))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("band", "bucket").orderBy(F.xxhash64(F.lit(7), "group"), "group")) - 1
    x = (F.col("before") + F.col("rank")) * GOLDEN
    x = x - F.floor(x)
    choice = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        choice = F.when(x < F.col(f"e{i}"), names[i]).otherwise(choice)
    dealt = roots.withColumn("rank", rank).join(F.broadcast(offsets), ["band", "bucket"]).select("group", choice.alias("split"))
    return files.join(_by(dealt), "group").select("file_name", "root", "group_author", "split")


def check(assigned: DataFrame) -> DataFrame:
    """``n_files, n_torn``: how many file names are assigned, and how many groups stand in more than one split (none should)."""
    torn = assigned.where("root is not null").groupBy("root").agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.coalesce(F.sum((F.col("a") != F.col("b")).cast("long")), F.lit(0)).alias("n_torn"))
    return assigned.agg(F.count("split").alias("n_files")).crossJoin(F.broadcast(torn))  # one row
