"""Exact near-duplicate vectors by cover trees and dual traversal.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c). Vectors descend a tree of nested balls with halving radii;
two balls, or a vector and a ball, further apart than their radii and that distance cannot hold a pair. What is left meets in blocks of
bounded size, each of which is searched by a dual traversal of two trees of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import saved
from docsieve.llm.components import components

#: Vectors, over all labels, whose balls route the others (they change the speed, never the result); most vectors of a block;
#: members below which a node is not split.
SAMPLE = 2048
BLOCK = 1024
LEAF = 96
#: Ball of the vectors of a group of which none was sampled: the whole group.
UNROUTED = -1
#: More than the rounding of distances, the square root of that of squares.
_SLACK = 1e-7


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, scaled first so that no square overflows."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2.0 * (x @ centres.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _cover(x: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
    """Members in balls of that radius around some of them, first come, first served; each ball's centre comes first."""
    balls = []
    while len(members):
        near = _distances(x[members], x[members[:1]])[:, 0] <= radius
        near[0] = True
        balls.append(members[near])
        members = members[~near]
    return balls


def nested_balls(sample: np.ndarray, least: float) -> tuple[np.ndarray, list[float], list[list[int]]]:
    """(centres, radii, children) of nested balls over a sample, as plain data for the workers.

    Ball 0 is the origin, which covers every unit vector; the levels below have radius 1, 1/2, 1/4 ... down to ``least``.
    """
    centres, radii, children = [np.zeros(sample.shape[1])], [1.0], [[]]
    todo = [(0, np.arange(len(sample)), 1.0)]
    while todo:
        parent, members, radius = todo.pop()
        for ball in _cover(sample, members, radius):
            children[parent].append(len(centres))
            centres.append(sample[ball[0]])
            radii.append(radius)
            children.append([])
            if len(ball) > 1 and radius / 2 >= least:
                todo.append((len(centres) - 1, ball, radius / 2))
    return np.array(centres), radii, children


def home_ball(balls: tuple[np.ndarray, list[float], list[list[int]]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The deepest ball each vector reaches, going to the nearest ball that covers it, and its distance from the centre."""
    centres, radii, children = balls
    node, distance = np.zeros(len(x), np.int64), np.sqrt((x * x).sum(axis=1))
    todo = [(0, np.arange(len(x)))]
    while todo:
        parent, members = todo.pop()
        below = np.array(children[parent], np.int64)
        if not len(below) or not len(members):
            continue
        d = _distances(x[members], centres[below])
        best = d.argmin(axis=1)
        nearest = d[np.arange(len(members)), best]
        covered = nearest <= radii[below[0]]
        node[members[covered]] = below[best[covered]]
        distance[members[covered]] = nearest[covered]
        for k in np.unique(best[covered]):
            todo.append((int(below[k]), members[covered & (best == k)]))
    return node, distance


class Tree:
    """Cover tree of one side of a block: a node's members, its centre, the radius that covers them, and children of half the radius."""

    def __init__(self, x: np.ndarray, members: np.ndarray, radius: float):
        self.members, self.centre = members, x[members[0]]
        self.radius = float(_distances(x[members], self.centre[None, :]).max())
        self.children: list[Tree] = []
        while len(members) > LEAF and radius > _SLACK:
            radius /= 2
            balls = _cover(x, members, radius)
            if len(balls) > len(members) // 4:
                break  # too scattered for balls to rule anything out
            if len(balls) > 1:
                self.children = [Tree(x, ball, radius) for ball in balls]
                break


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with x[i] . y[j] >= threshold by dual traversal; with ``same``, each pair of rows of x once."""
    none = np.empty(0, np.int64)
    if not len(x) or not len(y):
        return none, none
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK
    first = Tree(x, np.arange(len(x)), 2.0)
    todo = [(first, first if same else Tree(y, np.arange(len(y)), 2.0))]
    left, right = [none], [none]
    while todo:
        a, b = todo.pop()
        if a is not b and float(np.linalg.norm(a.centre - b.centre)) > a.radius + b.radius + reach:
            continue
        if not a.children and not b.children:
            i, j = np.nonzero(x[a.members] @ y[b.members].T >= threshold)
            i, j = a.members[i], b.members[j]
            if same and a is b:
                i, j = i[i < j], j[i < j]
            left.append(i)
            right.append(j)
        elif same and a is b:
            todo += [(c, d) for k, c in enumerate(a.children) for d in a.children[k:]]
        elif a.children and (not b.children or a.radius >= b.radius):
            todo += [(c, b) for c in a.children]
        else:
            todo += [(a, c) for c in b.children]
    return np.concatenate(left), np.concatenate(right)


def _routing(routers, least: float, occupied=None):
    """UDF over (group, vector): home ball and distance; with ``occupied`` (broadcast), the balls of the group it can reach."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for groups, vectors in batches:
            names = np.array(groups.to_pylist(), object)
            nodes, distances = np.full(len(names), UNROUTED), np.ones(len(names))
            reached: list[list[dict]] = [[] for _ in names]
            for name in set(names.tolist()):
                at = np.flatnonzero(names == name)
                x = unit_rows(np.array(vectors.take(pa.array(at)).to_pylist(), np.float64))
                router = routers.value.get(name)
                if occupied is None:
                    if router is not None:
                        nodes[at], distances[at] = home_ball(router, x)
                    continue
                balls, radii, blocks = occupied.value[name]
                within = _distances(x, router[0][balls]) <= radii[None, :] + least
                for row, hit in zip(at, within):
                    reached[row] = [{"ball": int(balls[k]), "blocks": int(blocks[k])} for k in np.flatnonzero(hit)]
            if occupied is None:
                yield pa.StructArray.from_arrays([pa.array(nodes), pa.array(distances)], ["ball", "distance"])
            else:
                yield pa.array(reached, pa.list_(pa.struct([("ball", pa.int64()), ("blocks", pa.int64())])))

    kind = "ball long, distance double" if occupied is None else "array<struct<ball: long, blocks: long>>"
    return F.arrow_udf(run, kind).asNondeterministic()


def _block_links(threshold: float):
    """One block pair: for each vector with links there, the number of vectors it links, and the least vector joined to it."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        side, ids, weights = side[order], table["rep"].to_numpy()[order], table["m"].to_numpy()[order]
        x = unit_rows(np.array(table["vector"].to_pylist(), np.float64)[order])
        cut, n = int((side == 0).sum()), len(ids)
        same = table["a"][0] == table["b"][0] and table["i"][0] == table["j"][0]
        left, right = close_pairs(x, x, threshold, True) if same else close_pairs(x[:cut], x[cut:], threshold, False)
        right = right if same else right + cut
        linked = np.bincount(left, weights[right], n) + np.bincount(right, weights[left], n)
        root = np.arange(n)
        by_id = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # rank of each id, so that the least id wins
        rank = by_id.copy()
        while True:
            low = np.minimum(rank[left], rank[right])
            new = rank.copy()
            np.minimum.at(new, left, low)
            np.minimum.at(new, right, low)
            if (new == rank).all():
                break
            rank = new
        root = np.sort(ids)[rank]
        keep = linked > 0
        return pa.table({"rep": ids[keep], "links": linked[keep].astype(np.int64), "root": root[keep]})

    return run


def linked_vectors(
    embeddings: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of equal, non-null label with a cosine of at least ``threshold``.

    Equal vectors of a label are one class named by its smallest id, and copies go no further than that. Class vectors descend nested
    balls around a sample of at most ``sample`` of them; per label, the balls that hold vectors and their measured radii tell which
    balls a vector can have partners in. Large balls are cut into blocks by hash, so a task sees two blocks at most, whatever the share
    of a label or ball. A block pair sends on a count and one edge a vector, not its pairs. The result does not depend on the sample.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows with a null label or id, link with nothing;
    vectors of one label but different lengths do not link. Rows with one id count as one vector. No rows: no rows.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label"))
    sound = "label is not null and vec_id is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vector, x -> x <> 0)"
    rows = rows.withColumn("g", F.when(F.expr(f"coalesce({sound}, false)"), F.concat_ws(":", F.size("vector"), "label")))
    valid = rows.where("g is not null")
    classes = saved(valid.groupBy("g", "vector").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("m")), "vectors")

    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK
    drawn: dict[str, list] = {}
    for row in classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("g", "vector").collect():
        drawn.setdefault(row["g"], []).append(row["vector"])
    routers = spark.sparkContext.broadcast({g: nested_balls(unit_rows(np.array(v, np.float64)), reach / 2) for g, v in drawn.items()})
    routed = classes.withColumn("r", _routing(routers, reach)(F.col("g"), F.col("vector")))
    routed = saved(routed.select("g", "rep", "m", "vector", "r.ball", "r.distance"), "routed")

    held = routed.groupBy("g", "ball").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
    # at most one ball for each sampled vector and level; groups without a sampled vector, any number of them, stay in a table
    balls: dict[str, list] = {}
    for row in sorted(held.where(F.col("ball") != UNROUTED).collect(), key=lambda r: r["ball"]):
        balls.setdefault(row["g"], []).append((row["ball"], row["radius"], -(-row["n"] // block)))
    occupied = spark.sparkContext.broadcast({g: tuple(np.array(column) for column in zip(*each)) for g, each in balls.items()})
    near = routed.where(F.col("ball") != UNROUTED).withColumn("near", _routing(routers, reach, occupied)(F.col("g"), F.col("vector")))
    blocks = F.ceil(F.col("n") / block).cast("long")
    whole = held.where(F.col("ball") == UNROUTED).select("g", F.array(F.struct("ball", blocks.alias("blocks"))).alias("near"))
    near = near.unionByName(routed.where(F.col("ball") == UNROUTED).join(whole, "g"))
    near = near.withColumn("own", F.expr("filter(near, t -> t.ball = ball)[0].blocks"))
    near = near.withColumn("block", F.expr("pmod(xxhash64(rep), own)")).select("g", "rep", "m", "vector", "ball", "block", F.explode("near").alias("t"))
    other = near.withColumn("other", F.explode(F.expr("sequence(0L, t.blocks - 1)")))
    forward = "(ball < t.ball or (ball = t.ball and block <= other))"
    meeting = other.selectExpr(
        "g", "rep", "m", "vector", f"if({forward}, 0, 1) side", "least(ball, t.ball) a", "greatest(ball, t.ball) b",
        f"if({forward}, block, other) i", f"if({forward}, other, block) j",
    )
    found = saved(meeting.groupBy("g", "a", "b", "i", "j").applyInArrow(_block_links(threshold), "rep long, links long, root long"), "vector-links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found, "rep", "root").withColumnRenamed("node", "rep")
    named = classes.join(links, "rep", "left").join(joined, "rep", "left")
    named = named.selectExpr("g", "vector", "m - 1 + coalesce(links, 0) n_links", "coalesce(component, rep) component_id")
    linked = valid.join(named, ["g", "vector"]).select("vec_id", "n_links", "component_id")
    out = linked.unionByName(rows.where("g is null").selectExpr("vec_id", "0L n_links", "vec_id component_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
