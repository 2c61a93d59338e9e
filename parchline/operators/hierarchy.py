"""Parent-child rows to full hierarchies by heavy-path decomposition.

1. Rows are reduced to one per node and numbered; parents that are not in the table are cut.
2. Subtree sizes come from ancestor doubling: in round k every node knows its 2^k-th ancestor and the number
   of its descendants nearer than 2^k. Only nodes that have such an ancestor take part, so the work shrinks
   with depth; a round that settles no node leaves exactly the nodes on or under a loop, which are set apart.
3. The child with the largest subtree continues its parent's chain; all other nodes head chains of their own.
   A path crosses at most log2(n) chains.
4. Chain heads and positions, then the chain tree, are resolved by pointer jumping over ever fewer rows.

The number of rounds grows with the logarithm of the deepest path, never with the number of rows. Every
round is a written table. Where many nodes ask for one (a wide parent, a root with much of a tree below it), the askers
are dealt out over salted parts (``lookup``). Paths are glued from blocks of ``BLOCK`` ids of a chain, so no chain is ever one value.

Defined results: a node without parent, with an empty parent, or whose parent is not in the table is its own
root with depth 0; a node that names itself is a loop; nodes on a loop or leading into one have root ''
and depth -1 and no path; repeated rows count once (of several parents for one id the smallest); a null id
is dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchline.functions.partitions import hot_keys, lookup
from parchline.functions.refs import norm_ref
from parchline.session import Scratch

#: ids of a chain that are kept together
BLOCK = 64


class Hierarchy:
    """The decomposition of a forest given as (tree, id, parent).

    Frames: ``nodes`` (nid, tree, id, looped, root_nid, depth, size, head, pos), ``chains`` (head, segments):
    the chain intervals above a head as an array of (head, upto), at most log2(n) of them.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame, tree: str = "tree", node: str = "id", parent: str = "parent", keep_segments: bool = True):
        """``keep_segments``: carry the chain intervals, which only ``paths``, ``intervals`` and ``descendants`` read."""
        self.spark, self.keep_segments = spark, keep_segments
        self.scratch = Scratch(spark, "hierarchy")
        self._number(rows.select(F.col(tree).alias("tree"), F.col(node).cast("string").alias("id"), norm_ref(F.col(parent).cast("string")).alias("parent")))
        self._sizes()
        self._chains()

    def _number(self, rows: DataFrame) -> None:
        own = rows.where("id IS NOT NULL").groupBy("tree", "id").agg(F.min("parent").alias("parent")).withColumn("nid", F.monotonically_increasing_id())
        self.ids = self.scratch.save(own, "ids")
        up = self.ids.select("tree", F.lower(F.trim("id")).alias("parent"), F.col("nid").alias("up"))
        below = self.ids.where("parent IS NOT NULL").select("tree", "parent", "nid")
        wide = hot_keys(below.groupBy("tree", "parent").agg(F.count("*").alias("n")), "n", self.ids.count())
        linked = lookup(below, up, ["tree", "parent"], wide)
        # ids that differ only in case would give a node two parents: keep one
        self.edges = self.scratch.save(linked.groupBy("nid").agg(F.min("up").alias("up")), "edges")

    def _sizes(self) -> None:
        active = self.edges.select("nid", F.col("up").alias("anc"), F.lit(1).cast("bigint").alias("size"))
        left, mine, gains = self.edges.count(), [], []
        while True:
            gain = self.scratch.save(active.groupBy("anc").agg(F.sum("size").alias("gain"), F.count("*").alias("n")), "gain")
            gains.append(gain)
            if not left:
                break
            wide = hot_keys(gain, "n", left).select(F.col("anc").alias("via"))
            step = lookup(active.select("nid", F.col("anc").alias("via"), "size"), active.select(F.col("nid").alias("via"), "anc"), ["via"], wide)
            step = step.join(gain.select(F.col("anc").alias("nid"), "gain"), "nid", "left")
            nxt = self.scratch.save(step.select("nid", "anc", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")), "active")
            mine.append(nxt)
            now = nxt.count()
            if len(mine) > 1:
                self.scratch.drop(mine[-2])
            active = nxt
            if now == left:
                break
            left = now
        self.looped = active.select("nid") if left else None
        grown = gains[0]
        for g in gains[1:]:
            grown = grown.unionAll(g)
        self.sizes = self.scratch.save(grown.groupBy(F.col("anc").alias("nid")).agg((F.sum("gain") + 1).alias("size")), "sizes")
        self.wide = self.scratch.save(hot_keys(gains[0], "n", self.edges.count()).select(F.col("anc").alias("up")), "wide")
        self.scratch.drop(*gains)

    def _chains(self) -> None:
        edges = self.edges if self.looped is None else self.edges.join(self.looped, "nid", "left_anti")
        sized = edges.join(self.sizes, "nid", "left").select("nid", "up", F.coalesce("size", F.lit(1)).alias("size"))
        best = sized.groupBy("up").agg(F.max(F.struct("size", F.negative("nid").alias("neg"))).alias("b"))
        heavy = self.scratch.save(best.select((-F.col("b.neg")).alias("nid"), "up", F.lit(1).cast("bigint").alias("pos")), "heavy")
        self.placed = self._jump(heavy, "pos", "heavy")  # (nid, up = head of its chain, pos)
        light = edges.join(self.placed.select("nid"), "nid", "left_anti")
        above = lookup(light, self.placed.select(F.col("nid").alias("up"), F.col("up").alias("chain"), "pos"), ["up"], self.wide, "left")
        chains = above.select(
            "nid", F.coalesce("chain", "up").alias("up"), (F.coalesce("pos", F.lit(0)) + 1).alias("dist"),
            *[F.array(F.struct(F.coalesce("chain", "up").alias("head"), F.coalesce("pos", F.lit(0)).alias("upto"))).alias("segments")] * self.keep_segments,
        )
        self.attached = self._jump(self.scratch.save(chains, "chains"), "dist", "chains", "segments" if self.keep_segments else None)

    def _jump(self, start: DataFrame, length: str, name: str, path: str | None = None) -> DataFrame:
        """Pointer jumping: ``up`` of each row of (nid, up, length) becomes the last one reached, lengths add up."""
        extra = [path] if path else []
        done, active = [], start
        known = start
        while True:
            look = known.select(F.col("nid").alias("up"), F.col("up").alias("up2"), F.col(length).alias("more"), *[F.col(c).alias("before") for c in extra])
            joined = active.join(look, "up", "left")
            moved = self.scratch.save(
                joined.select(
                    "nid", F.coalesce("up2", "up").alias("up"), (F.col(length) + F.coalesce("more", F.lit(0))).alias(length),
                    *[F.when(F.col("before").isNotNull(), F.concat("before", c)).otherwise(F.col(c)).alias(c) for c in extra],
                    F.col("up2").isNotNull().alias("open"),
                ),
                name,
            )
            done.append(moved.where("NOT open").drop("open"))
            active = moved.where("open").drop("open")
            known = active
            for d in done:
                known = known.unionAll(d)
            if not active.head(1):
                break
        out = done[0]
        for d in done[1:]:
            out = out.unionAll(d)
        return out

    def located(self) -> DataFrame:
        """(nid, head, pos, top, above): chain and position of every acyclic node that has a parent, the head
        of the topmost chain, and the depth of its own chain's head."""
        placed = self.placed.select("nid", F.col("up").alias("head"), "pos")
        chain = self.attached.select(F.col("nid").alias("head"), F.col("up").alias("top"), F.col("dist").alias("above"))
        inner = placed.join(chain, "head", "left").select("nid", "head", "pos", F.coalesce("top", "head").alias("top"), F.coalesce("above", F.lit(0)).alias("above"))
        heads = self.attached.select("nid", F.col("nid").alias("head"), F.lit(0).cast("bigint").alias("pos"), F.col("up").alias("top"), F.col("dist").alias("above"))
        return inner.unionByName(heads)

    def nodes(self) -> DataFrame:
        """(tree, node_id, root_id, depth): one row per node."""
        at = self.located().select("nid", "top", (F.col("pos") + F.col("above")).cast("int").alias("depth"))
        if self.looped is not None:
            at = at.unionAll(self.looped.select("nid", F.lit(-1).cast("bigint"), F.lit(-1)))
        own = self.ids.select("tree", "id", "nid").join(at, "nid", "left")
        alone = own.where("top IS NULL").select("tree", "id", F.col("id").alias("root_id"), F.lit(0).alias("depth"))
        names = self.ids.select(F.col("nid").alias("top"), F.col("id").alias("name"))
        large = hot_keys(at.groupBy("top").agg(F.count("*").alias("n")), "n", self.edges.count())
        below = lookup(own.where("top IS NOT NULL"), names, ["top"], large, "left").select("tree", "id", F.coalesce("name", F.lit("")), "depth")
        return alone.unionAll(below).withColumnRenamed("id", "node_id")

    def paths(self, separator: str = "/") -> DataFrame:
        """(tree, node_id, path, n_descendants): the path from the root to the node, both included, glued from the
        chain intervals it crosses. Null for nodes on or under a loop."""
        at = self._at()
        runs = at.join(self.ids.select("nid", "id"), "nid").groupBy("head", F.floor(F.col("pos") / BLOCK).alias("block"))
        runs = self.scratch.save(runs.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("run")), "runs")

        def glued(asked: DataFrame) -> DataFrame:
            """(who, part): the ids of the chains ``head`` from the top to the position ``upto``, in the order of ``k``."""
            size = F.least(F.lit(BLOCK).cast("bigint"), F.col("upto") + 1 - F.col("block") * BLOCK).cast("int")
            met = asked.join(runs, "head").where(F.col("block") * BLOCK <= F.col("upto"))
            pieces = met.select("who", F.struct("k", "block", F.array_join(F.slice("run", 1, size), separator).alias("part")).alias("x"))
            return pieces.groupBy("who").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), separator).alias("part"))

        before = glued(self.attached.select(F.col("nid").alias("who"), F.posexplode("segments").alias("k", "s")).select("who", "k", F.col("s.head").alias("head"), F.col("s.upto").alias("upto")))
        near = at.where(F.col("pos") < BLOCK).join(runs.where("block = 0"), "head").select("nid", "head", F.array_join(F.slice("run", 1, (F.col("pos") + 1).cast("int")), separator).alias("part"))
        deep = at.where(F.col("pos") >= BLOCK)
        far = glued(deep.select(F.col("nid").alias("who"), F.lit(0).alias("k"), "head", F.col("pos").alias("upto")))
        far = deep.select("nid", "head").join(far.withColumnRenamed("who", "nid"), "nid")
        own = near.unionByName(far).join(before.select(F.col("who").alias("head"), F.col("part").alias("before")), "head", "left")
        out = own.select("nid", F.concat_ws(separator, "before", "part").alias("path"))
        return (
            self.ids.select("tree", F.col("id").alias("node_id"), "nid")
            .join(out, "nid", "left")
            .join(self.sizes, "nid", "left")
            .select("tree", "node_id", "path", F.when(F.col("path").isNotNull(), F.coalesce(F.col("size") - 1, F.lit(0))).alias("n_descendants"))
        )

    def _at(self) -> DataFrame:
        """(nid, head, pos) of every acyclic node."""
        roots = self.ids.select("nid").join(self.edges.select("nid"), "nid", "left_anti").select("nid", F.col("nid").alias("head"), F.lit(0).cast("bigint").alias("pos"))
        return self.scratch.save(self.located().select("nid", "head", "pos").unionByName(roots), "at")

    def intervals(self) -> DataFrame:
        """(tree, node_id, chain_head, upto, own): the node lies below every node of the chain at positions 0 to ``upto``. A node has
        one own row, for the chain that it is on at position ``upto`` + 1, and one row for each chain above. So the descendants of v
        are the nodes with a row of v's chain and ``upto`` of at least v's position; with at most log2(n) rows a node, no
        pairs are written. Nodes on or under a loop have none."""
        at = self._at()
        cross = self.attached.select(F.col("nid").alias("below"), F.explode("segments").alias("s"))
        above = at.select("nid", F.col("head").alias("below")).join(cross, "below").select("nid", "s.head", "s.upto", F.lit(False).alias("own"))
        rows = at.select("nid", "head", (F.col("pos") - 1).alias("upto"), F.lit(True).alias("own")).unionByName(above)
        heads = self.ids.select(F.col("nid").alias("head"), F.col("id").alias("chain_head"))
        return rows.join(heads, "head").join(self.ids.select("nid", "tree", F.col("id").alias("node_id")), "nid").select("tree", "node_id", "chain_head", "upto", "own")

    def descendants(self, of: DataFrame) -> DataFrame:
        """(tree, node_id, descendant_id) for the nodes in ``of`` (tree, node_id), from chain intervals: a node lies
        below v if it is further down v's chain, or its path leaves v's chain at or below v."""
        at = self._at()
        named = self.ids.select("tree", F.col("id").alias("node_id"), "nid")
        asked = of.select("tree", "node_id").distinct().join(named, ["tree", "node_id"]).join(at, "nid").select("tree", "node_id", "head", F.col("pos").alias("from"))
        same = asked.join(at, "head").where("pos > from").select("tree", "node_id", "nid")
        cross = self.attached.select(F.col("nid").alias("below"), F.explode("segments").alias("s")).select("below", F.col("s.head").alias("head"), F.col("s.upto").alias("upto"))
        under = asked.join(cross, "head").where("upto >= from").select("tree", "node_id", "below").join(at.select("nid", F.col("head").alias("below")), "below").select("tree", "node_id", "nid")
        return same.unionAll(under).join(self.ids.select("nid", F.col("id").alias("descendant_id")), "nid").select("tree", "node_id", "descendant_id")
