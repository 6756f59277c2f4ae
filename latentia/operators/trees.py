"""Dependency trees as node tables: validity and structural selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def two_cycles(nodes: DataFrame) -> DataFrame:
    """``sent_id`` of sentences with a self-loop or a cycle of two."""
    back = nodes.select(F.col("sent_id").alias("_s"), F.col("idx").alias("_h"), F.col("head").alias("_i"))
    loops = nodes.where("idx = head").select("sent_id")
    return loops.union(nodes.join(back, (F.col("sent_id") == F.col("_s")) & (F.col("idx") == F.col("_i")) & (F.col("head") == F.col("_h"))).select("sent_id")).distinct()


def validity(nodes: DataFrame) -> DataFrame:
    """Per sentence: nodes, roots (head 0), heads that do not exist, and whether it has no cycle of one or two."""
    heads = nodes.select(F.col("sent_id").alias("_s"), F.col("idx").alias("_i")).distinct()
    seen = nodes.join(heads, (F.col("sent_id") == F.col("_s")) & (F.col("head") == F.col("_i")), "left")
    per = seen.groupBy("sent_id").agg(F.count("*").alias("n"), F.count_if(F.col("head") == 0).alias("roots"), F.count_if((F.col("head") != 0) & F.col("_i").isNull()).alias("dangling"))
    bad = two_cycles(nodes).withColumn("bad", F.lit(True))
    return per.join(bad, "sent_id", "left").select("sent_id", "n", "roots", "dangling", F.col("bad").isNull().alias("no_short_cycle"))


def reaches_root(heads: list[int]) -> bool:
    """Every node of a 1-based head list gets to 0 without a cycle."""
    state = [0] * (len(heads) + 1)
    for i in range(1, len(heads) + 1):
        path = []
        while i and not state[i]:
            state[i] = 1
            path.append(i)
            i = heads[i - 1] if 0 <= heads[i - 1] <= len(heads) else -1
            if i < 0:
                return False
        if i and state[i] == 1:
            return False
        for p in path:
            state[p] = 2
    return True


def depths(nodes: DataFrame) -> DataFrame:
    """``sent_id, idx, depth`` of the nodes that reach a root, inside the row: one shuffle by sentence, JVM only.

    Pointer doubling: in each round every node follows its pointer as far as that node's own pointer goes and adds up the
    steps; after ceil(log2 n) rounds all nodes of a tree point to 0. Nodes on or below cycles never do.
    """
    per = nodes.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("idx", "head"))).alias("a")).withColumn("ids", F.transform("a", lambda x: x["idx"]))
    at = lambda x: F.when(x["head"] == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position("ids", x["head"]).cast("int"), F.lit(0)), F.lit(-1)))
    per = per.withColumn("p", F.transform("a", at)).withColumn("c", F.transform("a", lambda _: F.lit(1)))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("p") + 1)).cast("int"))
    on = lambda s: F.struct(
        F.transform(s["p"], lambda q: F.when(q > 0, s["p"][q - 1]).otherwise(q)).alias("p"),
        F.transform(s["c"], lambda v, i: F.when(s["p"][i] > 0, v + s["c"][s["p"][i] - 1]).otherwise(v)).alias("c"),
    )
    done = F.aggregate(rounds, F.struct("p", "c"), lambda s, _: on(s))
    each = per.select("sent_id", "ids", done.alias("d")).select("sent_id", F.explode(F.arrays_zip(F.col("ids").alias("idx"), F.col("d.p").alias("p"), F.col("d.c").alias("depth"))).alias("x"))
    return each.where("x.p = 0").select("sent_id", "x.idx", "x.depth")


def acyclic(rows: DataFrame) -> DataFrame:
    """``sent_id, acyclic, connected`` from one pass over each sentence's heads (JVM only).

    Pointer doubling: after ceil(log2 n) rounds of following heads twice as far, every node of a tree is at 0.
    """
    per = rows.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("idx", "head"))).alias("a"), F.count_if(F.col("head") == 0).alias("roots"), F.max("idx").alias("last"))
    heads = F.transform("a", lambda x: x["head"])
    tidy = per.select("sent_id", "roots", (F.size("a") == F.col("last")).alias("gapless"), heads.alias("h"))
    follow = lambda h: F.transform(h, lambda i: F.when(i == 0, 0).when(i > F.size(h), -1).when(i < 0, -1).otherwise(h[F.greatest(i - 1, F.lit(0))]))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("h") + 1)).cast("int"))
    top = F.aggregate(rounds, F.col("h"), lambda h, _: follow(h))
    return tidy.select("sent_id", (F.col("gapless") & F.forall(top, lambda i: i == 0)).alias("acyclic"), (F.col("roots") == 1).alias("connected"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's head."""
    heads = nodes.select(F.col("sent_id"), F.col("head").alias("idx")).distinct()
    return nodes.join(heads, ["sent_id", "idx"], "left_anti")


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("head = 0")


def edges(nodes: DataFrame, to_root: bool | None = None) -> DataFrame:
    """``sent_id, parent, child, rel``; all, only those into the artificial root, or only the others."""
    e = nodes.select("sent_id", F.col("head").alias("parent"), F.col("idx").alias("child"), "rel")
    return e if to_root is None else e.where("parent = 0" if to_root else "parent <> 0")


def fan_out(nodes: DataFrame) -> DataFrame:
    return edges(nodes, to_root=False).groupBy("sent_id", "parent").agg(F.count("*").alias("children"))
