"""Reachability in commit graphs by chains.

Each commit follows one of its parents, which makes a forest; in it every commit goes on in the child with
most commits above it. So commits lie on chains, by position from the bottom, and a path down the forest
changes chains at most log(n) times. What a head reaches is then one label for each chain that it
touches: all commits up to a position. Tests for ancestors, common ancestors and counts of new versions
compare labels; no row for a head and an ancestor is ever made.

Labels grow along the edges between chains: a round takes the edges that leave what the round before
added, so there are as many rounds as changes of chains, not as commits. Common ancestors are looked for
from both heads until they meet, without the labels of what lies below. Chains are found by following
pointers within blocks of commits that lie near each other in the edges as they come, and by doubling only those
that lead on from block to block. Rounds are written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from factweave.operators.ordering import scanned
from factweave.operators.shared import stored, stored_counting

#: Edges that leave one chain are dealt out so many ways when labels meet them.
SLICES = 8

#: Commits of a block, in which pointers are followed at once.
BLOCK = 1 << 18


def _doubled(state: DataFrame) -> DataFrame:
    """Pointers (n, at, pos, open) twice as long: ``at`` is where they get to, ``pos`` how far it is. Those that
    got to an end aren't dealt out to look for more."""
    on = state.select(F.col("n").alias("at"), F.col("at").alias("far"), F.col("pos").alias("more"), F.col("open").alias("on"))
    moved = state.where("open").join(on, "at").select("n", F.col("far").alias("at"), (F.col("pos") + F.col("more")).alias("pos"), F.col("on").alias("open"))
    return moved.unionByName(state.where("not open"))


def _to_ends(state: DataFrame, open_ends: int) -> DataFrame:
    while open_ends:
        state, open_ends = stored_counting(_doubled(_doubled(state)), "links", "open")
    return state


def _ranked(links: DataFrame) -> DataFrame:
    """n, bottom, pos for (n, to, step): the last that links lead to, and the sum of their steps. Each ``to`` is
    an ``n``."""
    start = links.select("n", F.coalesce("to", "n").alias("at"), F.when(F.col("to").isNull(), 0).otherwise(F.col("step")).cast("long").alias("pos"), F.col("to").isNotNull().alias("open"))
    return _to_ends(*stored_counting(start, "links", "open")).select("n", F.col("at").alias("bottom"), "pos")


def _ranked_near(links: DataFrame) -> DataFrame:
    """``_ranked`` for (n, to, place) with steps of one: rows whose places are near are followed in one block. What
    blocks lead to is ranked by itself: of a history in some order that is a row or so for each block."""
    blocks = links.repartitionByRange(F.col("place")).sortWithinPartitions("place").select("n", "to")
    state, open_ends = stored_counting(blocks.mapInArrow(_followed, "n long, at long, pos long, open boolean"), "links", "open")
    if open_ends:
        hops, open_hops = stored_counting(state.where("open").select(F.col("at").alias("n")).distinct().join(state, "n"), "hops", "open")
        hops = _to_ends(hops, open_hops).select(F.col("n").alias("at"), F.col("at").alias("far"), F.col("pos").alias("more"))
        state = state.join(hops, "at", "left").select("n", F.coalesce("far", "at").alias("at"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"))
    return state.select("n", F.col("at").alias("bottom"), "pos")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, at, pos, open for (n, to), block by block: where links within the block get to; open where one leaves it."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield from _follow(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield from _follow(pa.Table.from_batches(held))


def _follow(block: pa.Table) -> list[pa.RecordBatch]:
    n, on = block["n"].to_numpy(), block["to"].is_valid().to_numpy()
    to = np.where(on, block["to"].fill_null(0).to_numpy(), n)
    order = np.argsort(n)
    at = order[np.minimum(np.searchsorted(n, to, sorter=order), len(n) - 1)]
    inside = on & (n[at] == to)
    at, pos = np.where(inside, at, np.arange(len(n))), inside.astype(np.int64)
    while pos[at].any():  # until all have got to rows that don't go on in the block
        at, pos = at[at], pos + pos[at]
    return pa.table({"n": n, "at": to[at], "pos": pos + on[at], "open": on[at]}).to_batches(max_chunksize=10_000)


def _subtree_sizes(tree: DataFrame) -> DataFrame:
    """n, up, size for (n, up, weight): the weight of all that come down to each along ``up``, and its own."""
    state, open_ends = stored_counting(tree.select("n", "up", F.col("up").alias("to"), F.col("weight").alias("size")), "sizes", "to IS NOT NULL")
    while open_ends:
        more = state.where("to IS NOT NULL").groupBy(F.col("to").alias("n")).agg(F.sum("size").alias("more"))
        far = state.select(F.col("n").alias("to"), F.col("to").alias("far"))
        grown = state.join(more, "n", "left").join(far, "to", "left").select("n", "up", F.col("far").alias("to"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        state, open_ends = stored_counting(grown, "sizes", "to IS NOT NULL")
    return state.drop("to")


def _check(c: str) -> Column:
    """A second hash of an id."""
    return F.xxhash64(F.lit(1), F.reverse(c))


@dataclass
class Chains:
    """members: n, chain, pos of each commit by its number. cross: chain, pos, to_chain, to_pos of edges between
    chains, if there are any. names: id, n."""

    members: DataFrame
    cross: DataFrame
    crosses: bool
    names: DataFrame
    number: Callable[[Column], Column] | None

    @staticmethod
    def of(edges: DataFrame, more: DataFrame | None = None, named: bool = True, number: Callable[[Column], Column] | None = F.xxhash64) -> Chains:
        """``edges``: id, parent. ``more``: further ids, that may have none; heads that are asked about later should be
        there or in the edges. Without ``named`` edges are kept as numbers, for uses that give no ids back.

        Commits are numbered by a hash, so that ids needn't be joined to numbers. Whether two of them share one
        is told by a second hash; if any do, all is done again with numbers that are looked up. Runs of commits
        between forks are found first; which run goes on in which is settled on these alone."""
        edges = edges.where("parent IS NOT NULL").select("id", "parent")
        edges = edges if number and not named else stored(edges, "edges")
        return Chains._of(edges, more, named, number) or Chains._of(edges, more, named, None)

    @staticmethod
    def _of(edges: DataFrame, more: DataFrame | None, named: bool, number: Callable[[Column], Column] | None) -> Chains | None:
        ids = edges.select(F.explode(F.array("id", "parent")).alias("id"))  # in one scan, so that most repeats end before the shuffle
        names = (ids if more is None else ids.union(more.select("id").where("id IS NOT NULL"))).distinct()
        if number:
            names = names.withColumn("n", number(F.col("id")))
            edges = edges.select(number(F.col("id")).alias("n"), number(F.col("parent")).alias("up"), _check("id").alias("check"), _check("parent").alias("up_check"))
            edges = edges if named else stored(edges, "edges")
            alone = None if more is None else more.where("id IS NOT NULL").select(number(F.col("id")).alias("n"), _check("id").alias("check"))
        else:
            names = stored(names.withColumn("n", F.monotonically_increasing_id()), "names")
            look = lambda c, to: names.select(F.col("id").alias(c), F.col("n").alias(to))
            edges = stored(edges.join(look("id", "n"), "id").join(look("parent", "up"), "parent").select("n", "up", F.lit(0).alias("check"), F.lit(0).alias("up_check")), "edges")
            alone = names.select("n", F.lit(0).alias("check"))
        tree, found = Chains._tree(edges, alone)
        if found["shared"]:
            return None
        links, at_forks = tree.select("n", F.col("up").alias("to"), "place"), None
        if found["forks"]:
            forks = tree.where("fork").select(F.col("n").alias("up"), F.lit(True).alias("cut"))
            at_forks = stored(tree.join(forks, "up").select("n", "up"), "forks")
            links = tree.join(forks, "up", "left").select("n", F.when(F.col("cut").isNull(), F.col("up")).alias("to"), "place")
        runs = _ranked_near(links).withColumnRenamed("bottom", "run")
        members = runs.select("n", F.col("run").alias("chain"), "pos")
        # only edges at forks and those of commits with several parents can leave a chain
        leaving = []
        if found["forks"]:
            below = stored(at_forks.join(runs.withColumnRenamed("n", "up"), "up").select(F.col("n").alias("run"), F.col("run").alias("on"), "pos"), "below")
            joined = stored(Chains._joined(below, runs), "joined")
            members = stored(runs.join(joined, "run").select("n", "chain", (F.col("pos") + F.col("offset")).alias("pos")), "members")
            on = joined.select(F.col("run").alias("on"), F.col("chain").alias("to_chain"), F.col("offset").alias("to_offset"))
            leaving.append(below.join(joined, "run").join(on, "on").select("chain", F.col("offset").alias("pos"), "to_chain", (F.col("pos") + F.col("to_offset")).alias("to_pos")))
        if found["merges"]:
            merges = stored(edges.join(tree.where("merge").select("n"), "n", "left_semi").select("n", "up"), "merges")
            ends = stored(merges.select(F.explode(F.array("n", "up")).alias("n")).distinct().join(members, "n"), "ends")
            leaving.append(merges.join(ends, "n").join(ends.toDF("up", "to_chain", "to_pos"), "up").select("chain", "pos", "to_chain", "to_pos"))
        cross, n = None, 0
        if leaving:
            cross = (leaving[0] if len(leaving) == 1 else leaving[0].union(leaving[1])).where("chain != to_chain")
            cross, n = stored_counting(cross.distinct(), "cross")
        cross = cross if n else edges.sparkSession.createDataFrame([], "chain long, pos long, to_chain long, to_pos long")
        return Chains(members, cross, n > 0, names, number)

    @staticmethod
    def _tree(edges: DataFrame, alone: DataFrame | None) -> tuple[DataFrame, dict[str, int]]:
        """n, up, fork, merge, place for all commits, and how many are shared by ids, forks and merges, in one aggregation.
        ``up`` is the parent that the forest takes; a fork has several children by any edge; the place is where a commit
        comes first in the edges."""
        none = F.lit(None).cast("long")
        row = lambda n, up, kid, check: F.struct(F.col(n).alias("n"), up.alias("up"), kid.alias("kid"), F.col(check).alias("check"))
        both = F.array(row("n", F.col("up"), none, "check"), row("up", none, F.col("n"), "up_check"))
        rows = edges.withColumn("place", F.monotonically_increasing_id()).select("place", F.inline(both))
        if alone is not None:
            rows = rows.unionByName(alone, allowMissingColumns=True)
        ends = [f(c).alias(f"{name}_{c}") for c in ("up", "kid", "check") for name, f in (("min", F.min), ("max", F.max))]
        differ = lambda c: F.coalesce(F.col(f"min_{c}") != F.col(f"max_{c}"), F.lit(False))
        nodes = rows.groupBy("n").agg(*ends, F.min("place").alias("place"))
        nodes = nodes.select("n", F.col("min_up").alias("up"), differ("kid").alias("fork"), differ("up").alias("merge"), differ("check").alias("shared"), F.coalesce("place", "n").alias("place"))
        seen = Observation()
        counts = [F.count_if(F.col(c)).alias(name) for c, name in (("shared", "shared"), ("fork", "forks"), ("merge", "merges"))]
        return stored(nodes.observe(seen, *counts).drop("shared"), "tree"), seen.get

    def numbered(self, rows: DataFrame, to: str = "n") -> DataFrame:
        """``rows`` with the number of their ``id``; without those of unknown ids."""
        if self.number:
            return rows.withColumn(to, self.number(F.col("id"))).where("id IS NOT NULL")
        return rows.join(self.names.withColumnRenamed("n", to), "id")

    @staticmethod
    def _joined(below: DataFrame, runs: DataFrame) -> DataFrame:
        """run, chain, offset: a run goes on from the run below it if it has most commits above it. ``below`` has run and
        on, the run below; a run is named by its first commit."""
        sizes = runs.groupBy("run").agg((F.max("pos") + 1).alias("weight"))
        graph = stored(sizes.join(below, "run", "left").select(F.col("run").alias("n"), F.col("on").alias("up"), "weight"), "forks")
        heavy = _subtree_sizes(graph).where("up IS NOT NULL").groupBy("up").agg(F.max_by("n", F.struct("size", "n")).alias("n"))
        step = graph.select(F.col("n").alias("up"), F.col("weight").alias("step"))
        ranked = _ranked(graph.select("n").join(heavy, "n", "left").join(step, "up", "left").select("n", F.col("up").alias("to"), "step"))
        return ranked.select(F.col("n").alias("run"), F.col("bottom").alias("chain"), F.col("pos").alias("offset"))

    def labels(self, heads: DataFrame) -> DataFrame:
        """head, chain, pos for (head, id) or (head, n): each head reaches the chain's commits up to ``pos``."""
        new = stored((heads if "n" in heads.columns else self.numbered(heads)).join(self.members, "n").groupBy("head", "chain").agg(F.max("pos").alias("pos")).withColumn("below", F.lit(-1).cast("long")), "labels")
        have = new.select("head", "chain", "pos")
        while self.crosses:
            met = self._left(new).join(have.withColumnRenamed("pos", "below"), ["head", "chain"], "left").where("below IS NULL OR pos > below")
            new, n = stored_counting(met.select("head", "chain", "pos", F.coalesce("below", F.lit(-1)).cast("long").alias("below")), "labels")
            if not n:
                break
            have = stored(have.unionByName(new.select("head", "chain", "pos")).groupBy("head", "chain").agg(F.max("pos").alias("pos")), "labels")
        return have

    def _left(self, labels: DataFrame) -> DataFrame:
        """head, chain, pos that labels get to by one edge from positions in (below, pos]."""
        slices = F.explode(F.array(*(F.lit(n) for n in range(SLICES)))).alias("slice")
        asks = labels.select("head", "chain", F.col("pos").alias("top"), "below", slices)
        dealt = self.cross.withColumn("slice", F.pmod(F.xxhash64("pos"), F.lit(SLICES)).cast("int"))
        met = asks.join(dealt, ["chain", "slice"]).where("pos <= top AND pos > below")
        return met.groupBy("head", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("pos"))

    def best_common(self, pairs: DataFrame, window: int = 1024) -> DataFrame:
        """pair, base for (pair, local, remote): the common ancestor that no other common one reaches; of
        several the smallest id. Pairs without one are left out.

        Both sides go down in steps of a window that widens, and stop wherever they have met: what lies below a
        common commit can't be a best one. So a pair costs what its two histories differ by, not what they share.
        A best common ancestor is always met, as no commit on the way to it is common; what was met besides,
        where one side came by a way that the other had left out, is told by being reached from a better one."""
        common = self._meetings(pairs, window)
        # first by a child that is common too, which settles most
        child = self.cross.select(F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"), F.col("chain").alias("from_chain"), F.col("pos").alias("from_pos"))
        above = common.select("pair", F.col("chain").alias("from_chain"), F.col("pos").alias("top"))
        under = common.join(child, ["chain", "pos"]).join(above, ["pair", "from_chain"]).where("from_pos <= top").select("pair", "chain", "pos").distinct()
        best = stored(common.join(under, ["pair", "chain", "pos"], "left_anti").join(self.members, ["chain", "pos"]).join(self.names, "n").select("pair", "chain", "pos", "id"), "best")
        several = stored(best.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(best, "pair").drop("n"), "several")
        if self.crosses and not several.isEmpty():
            heads = stored(several.select("id").distinct().withColumn("head", F.monotonically_increasing_id()), "heads")
            up = self.labels(heads).select("head", "chain", F.col("pos").alias("top")).join(heads.withColumnRenamed("id", "by"), "head")
            lower = several.join(up, "chain").where("pos <= top AND id != by").join(several.select("pair", F.col("id").alias("by")), ["pair", "by"]).select("pair", "id").distinct()
            best = best.join(lower, ["pair", "id"], "left_anti")
        return best.groupBy("pair").agg(F.min("id").alias("base"))

    def _meetings(self, pairs: DataFrame, window: int) -> DataFrame:
        """pair, chain, pos: up to where both sides of a pair were seen to reach on a chain."""
        sides = pairs.where("local IS NOT NULL AND remote IS NOT NULL").select("pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("local").alias("id")), F.struct(F.lit(1).alias("side"), F.col("remote").alias("id")))).alias("h"))
        have = stored(self.numbered(sides.select("pair", "h.side", "h.id")).join(self.members, "n").select("pair", "side", "chain", "pos"), "labels")
        todo, left = have.select("pair", "side", "chain", F.lit(-1).cast("long").alias("lo"), F.col("pos").alias("hi")), 1
        both = lambda: have.groupBy("pair", "chain").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
        while self.crosses and left:
            met = both().select("pair", "chain", F.col("pos").alias("met"))
            todo = todo.join(met, ["pair", "chain"], "left").withColumn("lo", F.greatest("lo", F.coalesce("met", F.lit(-1)))).where("lo < hi")
            cut = F.greatest(F.col("lo"), F.col("hi") - window)
            now = stored(todo.select("pair", "side", "chain", "lo", cut.alias("cut"), "hi"), "pieces")
            flow = self._left(now.select(F.struct("pair", "side").alias("head"), "chain", F.col("hi").alias("pos"), F.col("cut").alias("below"))).select("head.pair", "head.side", "chain", "pos")
            old = have.withColumnRenamed("pos", "lo")
            more = flow.join(old, ["pair", "side", "chain"], "left").where("lo IS NULL OR pos > lo").select("pair", "side", "chain", F.coalesce("lo", F.lit(-1)).cast("long").alias("lo"), F.col("pos").alias("hi"))
            rest = now.where("lo < cut").select("pair", "side", "chain", "lo", F.col("cut").alias("hi"))
            todo, left = stored_counting(more.withColumn("fresh", F.lit(True)).unionByName(rest.withColumn("fresh", F.lit(False))), "todo")
            have = stored(have.unionByName(todo.where("fresh").select("pair", "side", "chain", F.col("hi").alias("pos"))).groupBy("pair", "side", "chain").agg(F.max("pos").alias("pos")), "labels")
            todo, window = todo.drop("fresh"), window * 8
        return stored(both(), "common")

    def new_each(self, pairs: DataFrame) -> DataFrame:
        """pair, n for (pair, old, new): how many commits new reaches and old doesn't. Without an old head
        all that new reaches counts."""
        both, up = self._labelled(pairs, "old", "new")
        of = lambda c: both.select("pair", F.col(c).alias("head")).join(up, "head").select("pair", "chain", F.col("pos").alias(c))
        fresh = of("new").join(of("old"), ["pair", "chain"], "left").groupBy("pair").agg(F.sum(F.greatest(F.col("new") - F.coalesce("old", F.lit(-1)), F.lit(0))).alias("n"))
        return both.select("pair").join(fresh, "pair", "left").select("pair", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def is_ancestor(self, pairs: DataFrame) -> DataFrame:
        """pair, is_ancestor for (pair, old, new): whether new reaches old; every commit reaches itself."""
        both, up = self._labelled(pairs, "old", "new")
        on = both.select("pair", F.col("old").alias("n")).join(self.members, "n").select("pair", "chain", F.col("pos").alias("at"))
        met = both.select("pair", F.col("new").alias("head")).join(up, "head").join(on, ["pair", "chain"]).select("pair", (F.col("at") <= F.col("pos")).alias("ok"))
        return both.select("pair").join(met, "pair", "left").select("pair", F.coalesce("ok", F.lit(False)).alias("is_ancestor"))

    def _labelled(self, pairs: DataFrame, *sides: str) -> tuple[DataFrame, DataFrame]:
        """pairs with their heads as numbers, and the labels of each different head."""
        both = pairs.select("pair", *sides)
        for c in sides:
            if self.number:
                both = both.withColumn(c, F.when(F.col(c).isNotNull(), self.number(F.col(c))))
            else:
                both = both.join(self.names.select(F.col("id").alias(c), F.col("n").alias("__n")), c, "left").withColumn(c, F.col("__n")).drop("__n")
        both = stored(both, "pairs")
        heads = both.select(F.explode(F.array(*sides)).alias("n")).where("n IS NOT NULL").distinct()
        return both, self.labels(heads.withColumn("head", F.col("n")))

    def least_reaching(self, sources: DataFrame) -> DataFrame:
        """id, rank: the smallest rank of a source (id, rank) that reaches each commit. A chain's commits
        take the smallest rank from above by a running minimum that is split over tasks; edges between chains
        hand on what improves, until nothing does."""
        edges = stored(self.cross.withColumn("edge", F.monotonically_increasing_id()), "cross")
        rank_type = sources.schema["rank"].dataType
        none = F.lit(None).cast(rank_type)
        have = stored(self.numbered(sources).join(self.members, "n").groupBy("chain", "pos").agg(F.min("rank").alias("rank")), "ranks")
        starts = edges.select("chain", "pos", "edge", F.lit(1).alias("kind"), none.alias("rank"))
        ends = edges.select(F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"), "edge", F.lit(2).alias("kind"), none.alias("rank"))
        while self.crosses:
            held = have.select("chain", "pos", F.lit(-1).cast("long").alias("edge"), F.lit(0).alias("kind"), "rank")
            seen = self._from_above(held.unionByName(starts).unionByName(ends)).where("kind > 0")
            got = seen.groupBy("edge").agg(F.min(F.when(F.col("kind") == 1, F.col("least"))).alias("rank"), F.min(F.when(F.col("kind") == 2, F.col("least"))).alias("old"))
            better = got.where("rank IS NOT NULL AND (old IS NULL OR rank < old)").join(edges, "edge").select(F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"), "rank")
            better, n = stored_counting(better.groupBy("chain", "pos").agg(F.min("rank").alias("rank")), "better")
            if not n:
                break
            have = stored(have.unionByName(better).groupBy("chain", "pos").agg(F.min("rank").alias("rank")), "ranks")
        held = have.select("chain", "pos", F.lit(0).alias("kind"), "rank", F.lit(None).cast("long").alias("n"))
        asks = self.members.select("chain", "pos", F.lit(1).alias("kind"), none.alias("rank"), "n")
        return self._from_above(held.unionByName(asks), "n").where("kind = 1 AND least IS NOT NULL").join(self.names, "n").select("id", F.col("least").alias("rank"))

    @staticmethod
    def _from_above(rows: DataFrame, tie: str = "edge") -> DataFrame:
        order: list[Column] = [F.col("pos").desc(), F.col("kind"), F.col(tie)]
        return scanned(rows, ["chain"], order, F.col("rank"), "least", "min")
