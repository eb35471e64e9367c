"""Parent-child links to full hierarchies (problem 3), by heavy-path decomposition.

Cycles are separated first, on the graph of all links: a node with one link is contracted into what it leads to
(pointer jumping, so a chain takes a logarithmic number of rounds), nodes that lead nowhere are taken away, and what
remains is a small core whose strongly connected components are found directly.

The forest follows each node's first resolvable link. Subtree sizes are summed by doubling; every node's heaviest child
continues its chain; chains are numbered so that a chain, and a subtree, is an interval. A path is the concatenation of
the chain segments above the node, of which there are at most log2(n) whatever its depth; it is kept as these segments
and written out on request (``paths``). Descendants are the interval behind the node. No chain, path or set of
children is ever gathered in one row or task.

Links to ids without a row are ignored, as are null ids. Repeated rows of a node are one (the earliest). Nodes that are
in, or follow, a loop of first links have no root, depth, path or interval. Empty input gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lessonloom.runtime import materialize

#: Links up to which a contracted core is solved in one task; a larger one is contracted and coloured further.
CORE_LINKS = 1_000_000
#: Parts in which the children of one node are ordered.
CHILD_PARTS = 64


def links(rows: DataFrame, *, node: str, parents: str, arrival: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (v), and links (v, p, pos) to nodes that exist, each link once at its first position."""
    keyed = rows.filter(F.col(node).isNotNull()).select(F.col(node).alias("v"), F.col(parents).alias("ps"), *([F.col(arrival).alias("at")] if arrival else [F.lit(0).alias("at")]))
    one = keyed.groupBy("v").agg(F.min_by("ps", "at").alias("ps"))
    one = materialize(one, "nodes")
    nodes = one.select("v")
    each = one.select("v", F.posexplode("ps").alias("pos", "p")).filter("p IS NOT NULL").groupBy("v", "p").agg(F.min("pos").alias("pos"))
    return nodes, materialize(each.join(nodes.select(F.col("v").alias("p")), "p", "left_semi").select("v", "p", "pos"), "links")


def _climb(up: DataFrame, rounds: int = 64) -> DataFrame:
    """Doubling over pointers (v, a), one row per node, a null at a top: (v, top, dist, size, loose).

    ``top`` is the last node above v, ``dist`` the steps to it, ``size`` the nodes at or below v. Nodes whose pointers
    never end (in or behind a loop) are ``loose``; no end is reached from them once the step exceeds their number.
    """
    at = materialize(up.select("v", "a", F.when(F.col("a").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.coalesce("a", "v").alias("top"), F.lit(1).cast("long").alias("size")), "climb")
    step = 1
    for _ in range(rounds):
        moving = at.filter("a IS NOT NULL").count()
        if not moving:
            break
        if step > moving and at.filter("a IS NOT NULL").join(at.filter("a IS NULL").select(F.col("v").alias("a")), "a", "left_semi").isEmpty():
            break
        above = at.select(F.col("v").alias("a"), F.col("a").alias("a2"), F.col("dist").alias("d2"), F.col("top").alias("t2"))
        below = at.filter("a IS NOT NULL").groupBy("a").agg(F.sum("size").alias("more")).withColumnRenamed("a", "v")
        at = at.join(above, "a", "left").select("v", F.col("a2").alias("a"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"), F.coalesce("t2", "top").alias("top"), "size")
        at = materialize(at.join(below, "v", "left").select("v", "a", "dist", "top", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "climb")
        step *= 2
    else:
        raise RuntimeError(f"pointers not ended after {rounds} rounds")
    return at.select("v", "top", "dist", "size", F.col("a").isNotNull().alias("loose"))


def _runs(single: DataFrame, rounds: int = 64) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """For nodes with one link (v, p): the pointers after 1, 2, 4, ... steps, where the runs end (v, t), and their loops (v, cycle_id).

    A run ends at its first node that isn't in ``single``. Runs into a loop have no end; a loop's nodes are what its
    pointers still hit once no pointer under way can reach an end and the step exceeds their number.
    """
    inside = single.select(F.col("v").alias("t"), F.lit(True).alias("live"))
    at = single.select("v", F.col("p").alias("t"), F.least("v", "p").alias("least")).join(inside, "t", "left")
    at = materialize(at.select("v", "t", "least", F.coalesce("live", F.lit(False)).alias("live")), "runs")
    levels, step = [at], 1
    for _ in range(rounds):
        n = at.filter("live").count()
        if not n:
            break
        # The start of a long run is under way until its pointer has passed the whole of it.
        if step > n and at.filter("live").join(at.filter("NOT live").select(F.col("v").alias("t")), "t", "left_semi").isEmpty():
            break
        # A live pointer stands on a node with one link, whose own pointer takes it twice as far.
        ahead = at.select(F.col("v").alias("t"), F.col("t").alias("t2"), F.col("least").alias("l2"), F.col("live").alias("live2"))
        moved = at.filter("live").join(ahead, "t").select("v", F.col("t2").alias("t"), F.least("least", "l2").alias("least"), F.col("live2").alias("live"))
        at = materialize(moved.unionByName(at.filter("NOT live")), "runs")
        levels.append(at)
        step *= 2
    else:
        raise RuntimeError(f"runs not ended after {rounds} rounds")
    going = at.filter("live")
    loops = going.select(F.col("t").alias("v")).distinct().join(going.select("v", F.col("least").alias("cycle_id")), "v")
    return levels, at.filter("NOT live").select("v", "t"), loops


def _components(edges: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strongly connected components with more than one node, or a link to itself, of the links of one task."""
    frames = [e for e in edges if len(e)]
    if not frames:
        return
    pdf = pd.concat(frames)
    ids, flat = np.unique(pd.concat([pdf["v"], pdf["p"]]).to_numpy(dtype=object).astype(str), return_inverse=True)
    src, dst = flat[: len(pdf)], flat[len(pdf) :]
    n = len(ids)

    def order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.argsort(a, kind="stable")
        return np.searchsorted(a[k], np.arange(n + 1)), b[k]

    # Two passes: finishing order on the links, then gathering on the reversed links.
    head, to = order(src, dst)
    seen, finish = np.zeros(n, bool), []
    for r in range(n):
        if seen[r]:
            continue
        seen[r] = True
        stack = [(r, head[r])]
        while stack:
            v, k = stack.pop()
            if k < head[v + 1]:
                stack.append((v, k + 1))
                w = to[k]
                if not seen[w]:
                    seen[w] = True
                    stack.append((w, head[w]))
            else:
                finish.append(v)
    back, frm = order(dst, src)
    label = np.full(n, -1)
    for r in reversed(finish):
        if label[r] < 0:
            label[r], todo = r, [r]
            while todo:
                v = todo.pop()
                for w in frm[back[v] : back[v + 1]]:
                    if label[w] < 0:
                        label[w] = r
                        todo.append(w)
    size = np.bincount(label, minlength=n)
    keep = size[label] > 1
    keep[src[src == dst]] = True
    at = np.nonzero(keep)[0]
    if len(at):
        yield pd.DataFrame({"v": ids[at], "scc": ids[label[at]]})


def _core(edges: DataFrame) -> DataFrame:
    """(v, cycle_id) of a bounded core, in one task."""
    found = edges.select(F.col("v").cast("string"), F.col("p").cast("string")).coalesce(1).mapInPandas(_components, "v string, scc string")
    return found.join(found.groupBy("scc").agg(F.min("v").alias("cycle_id")), "scc").select("v", "cycle_id")


def _coloured(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(v, cycle_id) of a core of any size without nodes to contract: least labels forward, confirmed backward, until no link is left."""
    out = None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        label = materialize(edges.select(F.col("v").alias("x")).unionByName(edges.select(F.col("p").alias("x"))).distinct().select("x", F.col("x").alias("l")), "colour")
        while True:
            least = edges.join(label, F.col("v") == F.col("x")).groupBy("p").agg(F.min("l").alias("m"))
            new = materialize(label.join(least, F.col("x") == F.col("p"), "left").select("x", F.least("l", F.coalesce("m", "l")).alias("l"), (F.col("m") < F.col("l")).alias("new")), "colour")
            label = new.select("x", "l")
            if new.filter("new").isEmpty():
                break
        same = materialize(edges.join(label.select(F.col("x").alias("v"), F.col("l").alias("lv")), "v").join(label.select(F.col("x").alias("p"), F.col("l").alias("lp")), "p").filter("lv = lp").select("v", "p", F.col("lv").alias("l")), "same")
        found = materialize(same.filter("p = l").select("v", "l").distinct().unionByName(same.select(F.col("l").alias("v"), "l").distinct()).distinct(), "back")
        while True:
            more = materialize(same.join(found.select(F.col("v").alias("p")), "p", "left_semi").select("v", "l").distinct().join(found, ["v", "l"], "left_anti"), "back")
            if more.isEmpty():
                break
            found = materialize(found.unionByName(more), "back")
        real = found.join(same.filter("p = l").select("l").distinct(), "l", "left_semi").select("v", F.col("l").alias("cycle_id"))
        out = real if out is None else out.unionByName(real)
        edges = materialize(edges.join(found.select("v"), "v", "left_anti").join(found.select(F.col("v").alias("p")), "p", "left_anti"), "edges")
    else:
        raise RuntimeError(f"components not finished after {rounds} rounds")
    return out if out is not None else edges.select("v", F.col("p").alias("cycle_id"))


def cycles(edges: DataFrame, *, core_links: int = CORE_LINKS) -> DataFrame:
    """(v, cycle_id) of every node that a way of links leads back to; ``edges`` has v, p as strings. cycle_id is the least id of its component."""
    edges = materialize(edges.filter("v IS NOT NULL AND p IS NOT NULL").select("v", "p").distinct(), "edges")
    itself = edges.filter("v = p").select("v", F.col("v").alias("cycle_id"))
    found = materialize(_separate(edges.filter("v <> p"), core_links, 0).unionByName(itself), "cycles")
    return found.groupBy("v").agg(F.min("cycle_id").alias("cycle_id"))


def _separate(edges: DataFrame, core_links: int, level: int) -> DataFrame:
    """(v, member id) pairs of all components, one level of contraction at a time."""
    out = edges.groupBy("v").agg(F.count(F.lit(1)).alias("k"), F.min("p").alias("p"))
    single = materialize(out.filter("k = 1").select("v", "p"), "single")
    many = edges.join(single.select("v"), "v", "left_anti")
    if single.isEmpty():
        return _core(edges) if edges.count() <= core_links else _coloured(edges)
    levels, ends, loops = _runs(single)
    # A link leads to the end of the run it enters; runs into loops or to nodes without links end nowhere.
    alive = many.select(F.col("v").alias("t")).distinct()
    to = ends.join(alive, "t", "left_semi").select(F.col("v").alias("p"), "t")
    kept = many.join(alive.select(F.col("t").alias("p")), "p", "left_semi").select("v", "p", F.col("p").alias("t"))
    moved = materialize(many.join(to, "p").select("v", "p", "t").unionByName(kept), "moved")
    rest = materialize(moved.filter("v <> t").select("v", F.col("t").alias("p")).distinct(), "rest")
    if rest.isEmpty():
        inner = None
    else:
        inner = materialize(_core(rest) if rest.count() <= core_links else _separate(rest, core_links, level + 1), "inner")
    own = moved.filter("v = t").select("v", F.col("v").alias("cycle_id"))
    comp = own if inner is None else inner.unionByName(own.join(inner.select("v"), "v", "left_anti"))
    comp = materialize(comp.distinct(), "comp")
    # Links inside a component: every node of the runs they enter belongs to it.
    into = moved.join(comp, "v").join(comp.select(F.col("v").alias("t"), F.col("cycle_id").alias("ct")), "t").filter("cycle_id = ct AND p <> t").select(F.col("p").alias("v"), "cycle_id").distinct()
    marked = materialize(into.join(single.select("v"), "v", "left_semi"), "marked")
    for hop in reversed(levels) if not marked.isEmpty() else ():
        ahead = marked.join(hop.filter("live").select("v", "t"), "v").select(F.col("t").alias("v"), "cycle_id")
        marked = materialize(marked.unionByName(ahead).distinct(), "marked")
    # The least id may lie in a run.
    all_ = comp.unionByName(marked)
    least = all_.groupBy("cycle_id").agg(F.min("v").alias("least"))
    return all_.join(least, "cycle_id").select("v", F.col("least").alias("cycle_id")).unionByName(loops)


def hierarchy(nodes: DataFrame, edges: DataFrame, *, core_links: int = CORE_LINKS) -> DataFrame:
    """(v, parent, root, depth, segments, descendants, enter, leave, heavy_head, pos, cycle_id), one row per node.

    ``segments`` is the path as (head, upto) pairs: of each chain from its head to the node at that place.

    ``nodes`` has v, ``edges`` v, p, pos. The descendants of a node are the nodes of its root with enter above the node's
    own and up to its leave.
    """
    first = edges.groupBy("v").agg(F.min_by("p", "pos").alias("a"))
    up = materialize(nodes.join(first, "v", "left").select("v", "a"), "up")
    climbed = _climb(up)
    tree = materialize(up.join(climbed.filter("NOT loose"), "v"), "tree")
    # Heavy child: the largest subtree, the smaller id of equals.
    heavy = tree.filter("a IS NOT NULL").groupBy("a").agg(F.min_by("v", F.struct(-F.col("size"), F.col("v"))).alias("h"), F.max("size").alias("heavy_size"))
    kids = tree.join(heavy, "a").withColumn("heavy", F.col("v") == F.col("h"))
    kids = materialize(kids.select("v", "a", "size", "heavy", "heavy_size"), "kids")
    chain = _climb(tree.select("v").join(kids.filter("heavy").select("v", "a"), "v", "left").select("v", "a")).select("v", F.col("top").alias("head"), F.col("dist").alias("pos"))
    chain = materialize(chain, "chains")
    # Where each light child's subtree begins behind its parent: sums over parts of the children, then inside a part.
    light = kids.filter("NOT heavy").withColumn("part", F.pmod(F.xxhash64("v"), F.lit(CHILD_PARTS)))
    parts = light.groupBy("a", "part").agg(F.sum("size").alias("s")).withColumn("before", F.sum("s").over(W.partitionBy("a").orderBy("part")) - F.col("s")).drop("s")
    inside = F.sum("size").over(W.partitionBy("a", "part").orderBy("v")) - F.col("size")
    offset = light.withColumn("inside", inside).join(parts, ["a", "part"]).select(F.col("v").alias("head"), F.col("a").alias("attach"), (1 + F.col("heavy_size") + F.col("before") + F.col("inside")).alias("offset"))
    offset = offset.join(chain.select(F.col("v").alias("attach"), F.col("head").alias("on"), F.col("pos").alias("on_pos")), "attach")
    offset = materialize(offset, "offsets")
    done = materialize(tree.filter("a IS NULL").select(F.col("v").alias("head"), F.lit(0).cast("long").alias("start"), F.array().cast("array<struct<head:string,upto:bigint>>").alias("above")), "placed")
    placed = [done]
    for _ in range(64):  # a light link at least halves the subtree
        nxt = offset.join(done.select(F.col("head").alias("on"), "start", "above"), "on")
        done = materialize(nxt.select("head", (F.col("start") + F.col("on_pos") + F.col("offset")).alias("start"), F.array_append("above", F.struct(F.col("on").alias("head"), F.col("on_pos").alias("upto"))).alias("above")), "placed")
        if done.isEmpty():
            break
        placed.append(done)
    all_placed = placed[0]
    for d in placed[1:]:
        all_placed = all_placed.unionByName(d)
    at = tree.join(chain, "v").join(all_placed, "head")
    at = at.select("v", F.col("top").alias("root"), F.col("dist").alias("depth"), F.array_append("above", F.struct("head", F.col("pos").alias("upto"))).alias("segments"), (F.col("size") - 1).alias("descendants"), (F.col("start") + F.col("pos")).alias("enter"), (F.col("start") + F.col("pos") + F.col("size") - 1).alias("leave"), F.col("head").alias("heavy_head"), "pos")
    return up.withColumnRenamed("a", "parent").join(at, "v", "left").join(cycles(edges, core_links=core_links), "v", "left")


def paths(tree: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(v, path): the nodes from the root to v, written out from the chain segments, of all nodes or those ``wanted`` (v).

    The result has as many elements as the depths add up to; ask for what is needed of a deep tree.
    """
    asked = tree.filter("segments IS NOT NULL").select("v", "segments")
    asked = asked if wanted is None else asked.join(wanted.select("v").distinct(), "v", "left_semi")
    each = asked.select("v", F.posexplode("segments").alias("k", "s")).select("v", "k", F.col("s.head").alias("head"), F.col("s.upto").alias("upto"))
    chain = tree.filter("heavy_head IS NOT NULL").select(F.col("heavy_head").alias("head"), "pos", F.col("v").alias("node"))
    nodes = each.join(chain, "head").filter("pos <= upto")
    return nodes.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "pos", "node"))), lambda x: x["node"]).alias("path"))


def descendants(tree: DataFrame, *, block: int = 1 << 16) -> DataFrame:
    """(ancestor, descendant, distance): every node below another, read off the intervals."""
    own = tree.filter("root IS NOT NULL")
    spans = own.filter("descendants > 0").select("root", F.col("v").alias("ancestor"), F.col("depth").alias("d"), "leave", F.explode(F.sequence(F.col("enter") + 1, F.col("leave"), F.lit(block).cast("long"))).alias("lo"))
    each = spans.select("root", "ancestor", "d", F.explode(F.sequence("lo", F.least("leave", F.col("lo") + block - 1))).alias("enter"))
    return each.join(own.select("root", "enter", F.col("v").alias("descendant"), "depth"), ["root", "enter"]).select("ancestor", "descendant", (F.col("depth") - F.col("d")).alias("distance"))
