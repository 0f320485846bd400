"""Typed property graphs as two tables: nodes(uid, node_type, ...) and edges(src, dst, edge_type, ...).

Traversals advance a frontier by equi-joins, one stored table a round, and end when it is empty.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions.lexicons import EDGE_CONSTRAINTS
from tessera.storage import materialize

#: Nodes and links of all sources that paths are followed from together.
AT_ONCE = 1 << 21
#: Sources times links followed in one task, and tasks of one ball at most.
SHARE_WORK, SHARES = 200_000_000, 256


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``: keyed inserts where the later write wins."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("__row")).select("__row.*")


def remove_nodes(nodes: DataFrame, edges: DataFrame, uids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of ``uids`` (uid) and without edges that touch them."""
    gone = uids.select("uid").distinct()
    kept = edges.join(gone.withColumnRenamed("uid", "src"), "src", "left_anti").join(gone.withColumnRenamed("uid", "dst"), "dst", "left_anti")
    return nodes.join(gone, "uid", "left_anti"), kept


def filter_edges(edges: DataFrame, src: str | None = None, dst: str | None = None, types: list[str] | None = None) -> DataFrame:
    """Edges by any of the three; empty values do not filter."""
    for name, value in (("src", src), ("dst", dst)):
        edges = edges.where(F.col(name) == value) if value else edges
    return edges.where(F.col("edge_type").isin(*types)) if types else edges


def _steps(edges: DataFrame, direction: str, types: list[str] | None) -> DataFrame:
    kept = filter_edges(edges, types=types).where("src is not null and dst is not null")
    out = kept.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    back = kept.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction}")
    return (out if direction == "out" else back if direction == "in" else out.unionByName(back)).distinct()


def neighbours(edges: DataFrame, uids: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(uid, neighbour): distinct neighbours of each uid."""
    steps = _steps(edges, direction, types)
    return uids.select(F.col("uid").alias("at")).distinct().join(steps, "at").select(F.col("at").alias("uid"), F.col("to").alias("neighbour"))


def bfs(edges: DataFrame, sources: DataFrame, depth: int | None = None, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(root, uid, depth, parent): every node within ``depth`` steps of each source (uid), the source
    itself at depth 0; the parent is the smallest id one step nearer.  Loops end by themselves."""
    steps = materialize(_steps(edges, direction, types), "steps")
    seen = materialize(sources.select(F.col("uid").alias("root")).where("root is not null").distinct().select("root", F.col("root").alias("uid"), F.lit(0).alias("depth"), F.lit(None).cast(sources.schema["uid"].dataType).alias("parent")), "seen")
    frontier, level = seen, 0
    parts = [seen]
    while depth is None or level < depth:
        level += 1
        reached = frontier.select("root", F.col("uid").alias("at")).join(steps, "at").groupBy("root", F.col("to").alias("uid")).agg(F.min("at").alias("parent"))
        for part in parts:
            reached = reached.join(part.select("root", "uid"), ["root", "uid"], "left_anti")
        frontier = materialize(reached.select("root", "uid", F.lit(level).alias("depth"), "parent"), "frontier")
        if frontier.isEmpty():
            break
        parts = [materialize(_union(parts), "seen")] if len(parts) > 4 else parts
        parts.append(frontier)
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def induced_edges(edges: DataFrame, uids: DataFrame) -> DataFrame:
    """Edges with both ends in ``uids`` (uid)."""
    kept = uids.select("uid").distinct()
    return edges.join(kept.withColumnRenamed("uid", "src"), "src", "left_semi").join(kept.withColumnRenamed("uid", "dst"), "dst", "left_semi")


def influence_network(edges: DataFrame, root: DataFrame, depth: int = 2, direction: str = "both", types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes within ``depth`` of the root over edges of ``types``, all edges among them)."""
    found = bfs(edges, root, depth, direction, types or ["influences"])
    return found, induced_edges(edges, found)


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = 6, types: list[str] | None = None) -> DataFrame:
    """(src, dst, path, hops): all directed paths without repeated nodes of at most ``max_depth`` edges.
    Parallel edges count once; a node is no path to itself."""
    steps = materialize(_steps(edges, "out", types), "steps")
    goal = targets.select(F.col("uid").alias("dst")).distinct()
    # Only steps to nodes from which a target can still be reached are taken.
    near = materialize(goal.select(F.col("dst").alias("to"), F.lit(0).alias("left")), "near")
    reached = [near]
    for left in range(1, max_depth):
        near = materialize(steps.join(near.select("to"), "to", "left_semi").select(F.col("at").alias("to")).distinct().join(_union(reached).select("to"), "to", "left_anti").withColumn("left", F.lit(left)), "near")
        if near.isEmpty():
            break
        reached.append(near)
    steps = materialize(steps.join(_union(reached), "to"), "steps")
    paths = sources.select(F.col("uid").alias("src")).distinct().select("src", F.col("src").alias("at"), F.array("src").alias("path"))
    found = []
    for hops in range(1, max_depth + 1):
        paths = materialize(paths.join(steps, "at").where(~F.array_contains("path", F.col("to")) & (F.col("left") <= max_depth - hops)).select("src", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path")), "paths")
        if paths.isEmpty():
            break
        found.append(paths.join(goal, F.col("at") == F.col("dst")).select("src", "dst", "path", F.lit(hops).alias("hops")))
    if not found:
        return paths.select("src", F.col("at").alias("dst"), "path", F.lit(0).alias("hops")).limit(0)
    return _union(found)


def shortest_paths(edges: DataFrame, root: DataFrame, target: str, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(root, path, hops): a shortest path from each root to ``target``, through the smallest ids where
    several are as short; no row where there is none."""
    tree = materialize(bfs(edges, root, None, direction, types), "tree")
    walk = tree.where(F.col("uid") == target).select("root", "depth", F.col("uid").alias("at"), "parent", F.array("uid").alias("path"))
    far = walk.agg(F.max("depth")).first()[0] or 0
    for _ in range(far):
        up = tree.select("root", F.col("uid").alias("parent"), F.col("parent").alias("next"))
        walk = walk.join(up, ["root", "parent"], "left").select("root", "depth", F.col("parent").alias("at"), F.col("next").alias("parent"), F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), "path")).alias("path"))
    return walk.select("root", "path", F.col("depth").alias("hops"))


def narrower_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything from which the roots can be reached (child -> broader edges)."""
    return bfs(edges, roots, None, "in").where("depth > 0")


def broader_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything that can be reached from the roots (child -> broader edges)."""
    return bfs(edges, roots, None, "out").where("depth > 0")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("uid")).unionByName(edges.select(F.col("dst").alias("uid"))).where("uid is not null").distinct()


def depth_from_roots(edges: DataFrame) -> DataFrame:
    """(uid, depth): steps from the nearest node without incoming edges; -1 where none leads there."""
    nodes = vertices(edges)
    steps = materialize(_steps(edges, "out", None), "steps")
    frontier = materialize(nodes.join(steps.select(F.col("to").alias("uid")), "uid", "left_anti").select("uid", F.lit(0).alias("depth")), "seen")
    parts, level = [frontier], 0
    while not frontier.isEmpty():
        level += 1
        reached = frontier.select(F.col("uid").alias("at")).join(steps, "at").select(F.col("to").alias("uid")).distinct()
        for part in parts:
            reached = reached.join(part.select("uid"), "uid", "left_anti")
        frontier = materialize(reached.select("uid", F.lit(level).alias("depth")), "frontier")
        parts = [materialize(_union(parts), "seen")] if len(parts) > 4 else parts
        parts.append(frontier)
    return nodes.join(_union(parts), "uid", "left").select("uid", F.coalesce("depth", F.lit(-1)).alias("depth"))


def degrees(edges: DataFrame) -> DataFrame:
    """(uid, in_degree, out_degree) over distinct (src, dst)."""
    once = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    ends = once.select(F.col("src").alias("uid"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(once.select(F.col("dst").alias("uid"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("uid").agg(F.sum("i").cast("bigint").alias("in_degree"), F.sum("o").cast("bigint").alias("out_degree"))


def edge_type_distribution(edges: DataFrame) -> DataFrame:
    """(uid, relation, n): outgoing edges by relation, incoming ones as inv_relation; null is unknown."""
    relation = F.coalesce("edge_type", F.lit("unknown"))
    out = edges.select(F.col("src").alias("uid"), relation.alias("relation"))
    back = edges.select(F.col("dst").alias("uid"), F.concat(F.lit("inv_"), relation).alias("relation"))
    return out.unionByName(back).where("uid is not null").groupBy("uid", "relation").agg(F.count(F.lit(1)).alias("n"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(uid, rank) after ``rounds`` power iterations; the rank of nodes without outgoing edges is spread
    over all nodes."""
    once = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    out = once.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = materialize(once.join(out, "src"), "links")
    nodes = materialize(vertices(once).join(out.withColumnRenamed("src", "uid"), "uid", "left"), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("uid", F.lit(0.0).alias("rank"))
    ranks = nodes.select("uid", "out", F.lit(1.0 / n).alias("rank"))
    loose = nodes.where("out is null").count() / n
    for i in range(rounds):
        sent = links.join(ranks.select(F.col("uid").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("uid")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        ranks = nodes.join(sent, "uid", "left").select("uid", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("rank"))
        if i < rounds - 1:
            # What is spread in the next round is summed while this one is written.
            seen = Observation()
            ranks = materialize(ranks.observe(seen, F.sum(F.when(F.col("out").isNull(), F.col("rank"))).alias("loose")), "ranks")
            loose = seen.get["loose"] or 0.0
    return ranks.select("uid", "rank")


def _numbered(pairs: list[tuple]) -> tuple[list, np.ndarray, np.ndarray]:
    """(names in order, and of every link the lower and the higher number)."""
    names = sorted({x for p in pairs for x in p})
    index = {x: i for i, x in enumerate(names)}
    ends = np.array([(index[a], index[b]) for a, b in pairs], dtype=np.int64).reshape(-1, 2)
    return names, *_links(ends[:, 0], ends[:, 1])


def _links(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, higher number) of every link between two nodes, once."""
    low, high = np.minimum(src, dst), np.maximum(src, dst)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = low != high
    new[1:] &= (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[new], high[new]


def _branches(n: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paths that branches send through each node, its weight, whether it stays).

    Nodes with one neighbour are taken off again and again, and each stands in its neighbour as a
    weight: what lies on the only path between two branches is counted from their sizes."""
    degree = np.bincount(np.concatenate((low, high)), minlength=n).tolist()
    #: Numbers of all neighbours that are left, in one: of one neighbour its own.
    last = [0] * n
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        last[a] ^= b
        last[b] ^= a
    #: Squares of the sizes of the branches taken off at each node.
    weight, squares = [1] * n, [0] * n
    order, up, off = [i for i in range(n) if degree[i] == 1], [-1] * n, [False] * n
    for v in order:
        if not degree[v]:
            continue
        off[v], u = True, last[v]
        up[v] = u
        last[u] ^= v
        weight[u] += weight[v]
        squares[u] += weight[v] ** 2
        degree[u] -= 1
        if degree[u] == 1:
            order.append(u)
    stays = ~np.array(off, dtype=bool)
    inner = stays[low] & stays[high]
    first = list(range(n))

    def find(v: int) -> int:
        while first[v] != v:
            first[v] = v = first[first[v]]
        return v

    for a, b in zip(low[inner].tolist(), high[inner].tolist(), strict=True):
        a, b = find(a), find(b)
        first[max(a, b)] = min(a, b)
    size = [0] * n
    for v in range(n):
        if not off[v]:
            size[find(v)] += weight[v]
    for v in range(n):
        size[v] = size[find(v)] if not off[v] else 0
    for v in reversed(order):
        size[v] = size[up[v]] if off[v] else size[v]
    # Ordered pairs of which one end at least lies in a branch taken off here, or beyond it.
    score = [float((weight[v] - 1) ** 2 - squares[v] + 2 * (weight[v] - 1) * (size[v] - weight[v])) for v in range(n)]
    return np.array(score), np.array(weight, dtype=np.int64), stays


def _passing(low: np.ndarray, high: np.ndarray, weight: np.ndarray, share: int = 0, shares: int = 1) -> np.ndarray:
    """Shortest paths through every node, as they weigh, from the sources of one of ``shares``; every node
    has a link.  Many sources are followed at once."""
    n = len(weight)
    score = np.zeros(n)
    src, dst = np.concatenate((low, high)), np.concatenate((high, low))
    order = np.lexsort((dst, src))
    dst, starts = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    degree = np.diff(starts)
    sources = np.arange(share, n, shares)
    some = max(1, AT_ONCE // max(1, n + len(dst)))
    place = np.zeros(some * n, dtype=np.int64)
    for part in np.split(sources, np.arange(some, len(sources), some)):
        dist = np.full(len(part) * n, -1, dtype=np.int32)
        paths, flow = np.zeros(len(dist)), np.zeros(len(dist))
        # Node v of the i-th source is i * n + v.
        front = np.arange(len(part)) * n + part
        dist[front], paths[front], steps, level = 0, 1.0, [], 0
        while len(front):
            level += 1
            v = front % n
            times = degree[v]
            at = np.repeat(np.arange(len(front)), times)
            to = (front - v)[at] + dst[np.arange(len(at)) + np.repeat(starts[v] - np.cumsum(times) + times, times)]
            further = dist[to] < 0
            to, at = to[further], at[further]
            dist[to] = level
            place[to] = np.arange(len(to))
            reached = to[place[to] == np.arange(len(to))]
            place[reached] = np.arange(len(reached))
            paths[reached] = np.bincount(place[to], weights=paths[front[at]], minlength=len(reached))
            steps.append((front, at, to))
            front = reached
        for front, at, to in reversed(steps):
            sent = (weight[to % n] + flow[to]) / paths[to]
            flow[front] = np.bincount(at, weights=sent, minlength=len(front)) * paths[front]
        flow[np.arange(len(part)) * n + part] = 0.0
        score += weight[part] @ flow.reshape(len(part), n)
    return score


def betweenness(pairs: list[tuple]) -> dict:
    """Normalised betweenness of the nodes of an undirected graph.

    Paths are followed only among the nodes that are left without branches (``_branches``)."""
    names, low, high = _numbered(pairs)
    n = len(names)
    score, weight, stays = _branches(n, low, high)
    inner = stays[low] & stays[high]
    core, ends = np.unique(np.concatenate((low[inner], high[inner])), return_inverse=True)
    score[core] += _passing(*np.split(ends, 2), weight[core])
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return dict(zip(names, (score * scale).tolist(), strict=True))


def _communities(n: int, low: np.ndarray, high: np.ndarray) -> list[int]:
    """The least node of the community of every node: the two whose union gains most modularity are joined
    while there is a gain, of equal ones the first.

    A gain times 2 m^2, m the number of links, is the whole number 2 m l - d e, where l links join
    communities of d and e link ends.  A community keeps its links by l, least e first; the community
    of fewer links moves into the other.  While l stays a gain only falls, so what is kept is never less than it
    is, and what comes out first is put back until it is as it was kept."""
    twice = 2 * len(low)
    ends = np.bincount(np.concatenate((low, high)), minlength=n).tolist()
    label, up, near = list(range(n)), list(range(n)), [{} for _ in range(n)]
    kept: list[dict[int, list]] = [{} for _ in range(n)]
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        near[a][b] = near[b][a] = 1
        a, b = (a, b) if ends[a] >= ends[b] else (b, a)
        kept[a].setdefault(1, []).append((ends[b], b, b))

    def known(a: int, links: int) -> tuple | None:
        """What joins the community ``a`` best by so many links."""
        heap = kept[a][links]
        while heap:
            e, _, b = heap[0]
            if near[a].get(b) != links:
                heapq.heappop(heap)
            elif ends[b] != e:
                heapq.heapreplace(heap, (ends[b], label[b], b))
            else:
                return ends[a] * e - twice * links, min(label[a], label[b]), max(label[a], label[b]), a, links, b
        return None

    for heaps in kept:
        for heap in heaps.values():
            heapq.heapify(heap)
    best = [known(a, 1) for a in range(n) if kept[a]]
    heapq.heapify(best)
    while best and best[0][0] < 0:
        top = heapq.heappop(best)
        owner, links = top[3:5]
        now = known(owner, links) if up[owner] == owner else None
        if now != top:
            if now:
                heapq.heappush(best, now)
            continue
        a, b = (owner, now[5]) if len(near[owner]) >= len(near[now[5]]) else (now[5], owner)
        up[b], label[a] = a, min(label[a], label[b])
        ends[a] += ends[b]
        del near[a][b], near[b][a]
        for c, more in near[b].items():
            del near[c][b]
            both = near[a][c] = near[c][a] = near[a].get(c, 0) + more
            heap = kept[a].setdefault(both, [])
            heapq.heappush(heap, (ends[c], label[c], c))
            if heap[0][2] == c:
                heapq.heappush(best, known(a, both))
        near[b], kept[b] = {}, {}
        if a == owner and (rest := known(a, links)):
            heapq.heappush(best, rest)
    found = []
    for v in range(n):
        while up[v] != v:
            up[v] = v = up[up[v]]
        found.append(label[v])
    return found


def modularity_communities(pairs: list[tuple]) -> list[set]:
    """Communities (``_communities``) of an undirected graph, the largest first."""
    names, low, high = _numbered(pairs)
    groups: dict[int, set] = {}
    for x, least in zip(names, _communities(len(names), low, high), strict=True):
        groups.setdefault(least, set()).add(x)
    return sorted(groups.values(), key=lambda g: (-len(g), min(map(str, g))))


def concept_cluster(edges: DataFrame, root: DataFrame, depth: int = 2, types: list[str] | None = None, most_edges: int | None = None) -> DataFrame:
    """(root, uid, community, centrality): the ball around each root over conceptual edges, with
    modularity communities and betweenness inside it.

    Balls of any size are measured: communities and branches of a ball in one task, on numbers, the paths among
    the other nodes in tasks of some sources each.  A ball of at most two nodes is one community with
    centrality 0.  Only where ``most_edges`` is given both are null in balls of more edges.
    """
    types = types or ["extends", "subsumes", "analogous_to", "opposes", "translates_to"]
    ball = materialize(bfs(edges, root, depth, "both", types).select("root", "uid"), "ball")
    inside = edges.join(ball.select("root", F.col("uid").alias("src")), "src").join(ball.select("root", F.col("uid").alias("dst")), ["root", "dst"]).select("root", "src", "dst").distinct()
    sizes = ball.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"))
    if most_edges is not None:
        inside = materialize(inside, "inside")
        counted = sizes.join(inside.groupBy("root").agg(F.count(F.lit(1)).alias("edges")), "root", "left")
        sizes = materialize(counted.withColumn("nodes", F.when(F.coalesce("edges", F.lit(0)) <= most_edges, F.col("nodes"))).drop("edges"), "sizes")
    kind = edges.schema["src"].dataType.simpleString()
    order = Window.partitionBy("root").orderBy("uid")
    numbers = materialize(ball.join(sizes.where("nodes > 2"), "root").select("root", "uid", "nodes", (F.row_number().over(order) - 1).alias("node")), "numbers")
    number = lambda end: numbers.select("root", F.col("uid").alias(end), F.col("node").alias(f"{end}_node"))
    links = inside.join(number("src"), ["root", "src"]).join(number("dst"), ["root", "dst"]).select("root", F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        """A row for every node, then one for every link among those without branches."""
        low, high = _links(pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64))
        n = int(max(pdf["src"].max(), pdf["dst"].max())) + 1
        score, weight, stays = _branches(n, low, high)
        inner = stays[low] & stays[high]
        a, b = low[inner], high[inner]
        nodes = pd.DataFrame({"node": np.arange(n), "other": -1, "weight": weight, "other_weight": 0, "least": _communities(n, low, high), "score": score})
        core = pd.DataFrame({"node": a, "other": b, "weight": weight[a], "other_weight": weight[b], "least": 0, "score": 0.0})
        return pd.concat([nodes, core]).assign(root=pdf["root"].iat[0])

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["node"].to_numpy(), pdf["other"].to_numpy()
        nodes, at, ends = np.unique(np.concatenate((a, b)), return_index=True, return_inverse=True)
        weight = np.concatenate((pdf["weight"], pdf["other_weight"]))[at]
        share, shares = int(pdf["share"].iat[0]), int(pdf["shares"].iat[0])
        return pd.DataFrame({"root": pdf["root"].iat[0], "node": nodes, "share": share, "passed": _passing(*np.split(ends, 2), weight, share, shares)})

    measured = materialize(links.groupBy("root").applyInPandas(measure, f"root {kind}, node int, other int, weight bigint, other_weight bigint, least int, score double"), "measured")
    nodes, core = measured.where("other < 0").select("root", "node", "least", "score"), measured.where("other >= 0").drop("least", "score")
    work = core.groupBy("root").agg((F.count(F.lit(1)) * F.count_distinct("node")).alias("work"))
    shared = core.join(work.select("root", F.greatest(F.lit(1), F.least(F.lit(SHARES), F.ceil(F.col("work") / SHARE_WORK))).cast("int").alias("shares")), "root")
    each = shared.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    passed = each.groupBy("root", "share").applyInPandas(follow, f"root {kind}, node int, share int, passed double")
    # Added up in order, so that the sum is always the same.
    passed = passed.groupBy("root", "node").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("share", "passed"))), F.lit(0.0), lambda x, y: x + y["passed"]).alias("passed"))
    named = nodes.join(numbers, ["root", "node"])
    groups = named.groupBy("root", "least").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("uid").cast("string")).alias("name"))
    groups = groups.select("root", "least", (F.row_number().over(Window.partitionBy("root").orderBy(F.desc("n"), "name")) - 1).alias("community"))
    central = (F.col("score") + F.coalesce("passed", F.lit(0.0))) / ((F.col("nodes") - 1) * (F.col("nodes") - 2))
    found = named.join(groups, ["root", "least"]).join(passed, ["root", "node"], "left").select("root", "uid", "community", F.round(central, 6).alias("centrality"))
    rows = ball.join(found, ["root", "uid"], "left").join(sizes, "root")
    known = F.col("nodes").isNotNull()
    return rows.select("root", "uid", F.when(known, F.coalesce("community", F.lit(0))).alias("community"), F.when(known, F.coalesce("centrality", F.lit(0.0))).alias("centrality"))


def constraint_violations(nodes: DataFrame, edges: DataFrame, constraints: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """(src, dst, edge_type, src_type, dst_type): edges between known nodes whose types the edge type
    does not allow; edge types without a rule are free."""
    constraints = constraints or EDGE_CONSTRAINTS
    kinds = nodes.select("uid", "node_type")
    typed = edges.select("src", "dst", "edge_type").join(kinds.select(F.col("uid").alias("src"), F.col("node_type").alias("src_type")), "src").join(kinds.select(F.col("uid").alias("dst"), F.col("node_type").alias("dst_type")), "dst")
    allowed = [f"{t}\t{a}\t{b}" for t, pairs in constraints.items() for a, b in pairs]
    ruled = F.col("edge_type").isin(*constraints)
    return typed.where(ruled & ~F.concat_ws("\t", "edge_type", "src_type", "dst_type").isin(*allowed)).select("src", "dst", "edge_type", "src_type", "dst_type")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type, missing): edge ends that no node has."""
    known = nodes.select("uid")
    lost = [edges.select("src", "dst", "edge_type", F.col(c).alias("missing")).join(known.withColumnRenamed("uid", "missing"), "missing", "left_anti") for c in ("src", "dst")]
    return lost[0].unionByName(lost[1]).select("src", "dst", "edge_type", "missing")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n): nodes and edges in all (kind null) and by type."""
    count = lambda df, part, c: df.rollup(F.coalesce(F.col(c), F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return count(nodes, "nodes", "node_type").unionByName(count(edges, "edges", "edge_type"))


def overlap(members: DataFrame, links: DataFrame | None, a: str, b: str) -> DataFrame:
    """(member_type, n_a, n_b, n_shared, jaccard, analogous) of two collections.

    ``members``: (collection, member, member_type); ``links``: (src, dst) between members, counted from
    the first collection to the second.  Two empty sets have Jaccard 0.
    """
    rows = members.where(F.col("collection").isin(a, b)).select("collection", "member", "member_type").distinct()
    sides = rows.groupBy("member_type", "member").agg(F.max((F.col("collection") == a).cast("int")).alias("a"), F.max((F.col("collection") == b).cast("int")).alias("b"))
    sizes = sides.groupBy("member_type").agg(F.sum("a").cast("bigint").alias("n_a"), F.sum("b").cast("bigint").alias("n_b"), F.sum(F.col("a") * F.col("b")).cast("bigint").alias("n_shared"), F.count(F.lit(1)).alias("n"))
    result = sizes.select("member_type", "n_a", "n_b", "n_shared", F.when(F.col("n") > 0, F.round(F.col("n_shared") / F.col("n"), 6)).otherwise(0.0).alias("jaccard"))
    if links is None:
        return result.withColumn("analogous", F.lit(0).cast("bigint"))
    side = lambda name, c: rows.where(F.col("collection") == name).select(F.col("member").alias(c), F.col("member_type").alias(f"{c}_type")).distinct()
    pairs = links.select("src", "dst").distinct().join(side(a, "src"), "src").join(side(b, "dst"), "dst").groupBy(F.col("src_type").alias("member_type")).agg(F.count(F.lit(1)).alias("analogous"))
    return result.join(pairs, "member_type", "left").withColumn("analogous", F.coalesce("analogous", F.lit(0)))


def year_bins(start: int, end: int, size: int = 50) -> Column:
    """Array of (year_start, year_end) from start to end; the last is clipped."""
    return F.array(*[F.struct(F.lit(y).alias("year_start"), F.lit(min(y + size, end)).alias("year_end")) for y in range(start, end, size)])


def temporal_bins(spans: DataFrame, first: str, last: str, start: int, end: int, size: int = 50, closed: bool = True) -> DataFrame:
    """Rows of ``spans`` with year_start and year_end, one for each bin that their years touch.

    Bins are closed at both ends, so a boundary year is in two; ``closed=False`` leaves the end out.
    Rows with a null or zero year touch none.
    """
    a, b = F.col(f"`{first}`"), F.col(f"`{last}`")
    touches = lambda x: (a <= x["year_end"]) & (b >= x["year_start"]) if closed else (a < x["year_end"]) & (b >= x["year_start"])
    known = spans.drop("year_start", "year_end").where(a.isNotNull() & b.isNotNull() & (a != 0) & (b != 0))
    return known.withColumn("__bin", F.explode(F.filter(year_bins(start, end, size), touches))).select("*", "__bin.*").drop("__bin")


def genealogy(concepts: DataFrame, similar: DataFrame, threshold: float = 0.4) -> DataFrame:
    """(earlier, later): related concepts of which one period ends before the other starts.

    ``concepts``: (concept_id, start, end); ``similar``: (anchor, concept_id, score).  Concepts at
    ``threshold`` or above count, the anchor included; a missing start sorts last, a missing end never
    precedes.
    """
    kept = similar.where(F.col("score") >= threshold).select("anchor", "concept_id").unionByName(similar.select("anchor", F.col("anchor").alias("concept_id"))).distinct()
    dated = kept.join(concepts, "concept_id").select("anchor", "concept_id", F.coalesce("start", F.lit(9999)).alias("start"), "end")
    x, y = dated.alias("x"), dated.alias("y")
    met = x.join(y, (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.end") <= F.col("y.start")) & (F.col("x.concept_id") != F.col("y.concept_id")))
    return met.select(F.col("x.anchor").alias("anchor"), F.col("x.concept_id").alias("earlier"), F.col("y.concept_id").alias("later"))


