"""Hierarchies against walking up one step at a time."""

import random

from tessera.operators.hierarchy import descendants, hierarchy


def walk(parents):
    result = {}
    for node in parents:
        seen, at = [], node
        while at is not None and at not in seen:
            seen.append(at)
            at = parents[at]
        if at is None:
            result[node] = (seen[-1], len(seen) - 1)
        else:
            loop = seen[seen.index(at) :]
            result[node] = (min(loop), -1 if node in loop else -2)
    return result


def tree(spark, rows):
    return hierarchy(spark.createDataFrame(rows, "id string, up string"), "id", "up")


def test_random_forests(spark):
    rng = random.Random(5)
    for size in (1, 40, 120):
        ids = [f"n_{i:03}" for i in range(size)]
        parents = {x: rng.choice([*ids, None]) if rng.random() < 0.3 else (ids[i - 1] if i else None) for i, x in enumerate(ids)}
        rows = [(x, p and rng.choice([p, p.upper(), f" {p.replace('_', ' - ')}\t"])) for x, p in parents.items()]
        found = {r.node: (r.root, r.depth) for r in tree(spark, rows + rows[:3]).collect()}
        assert found == walk(parents)


def test_paths_and_descendants(spark):
    t = tree(spark, [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("e", "nowhere"), ("f", "")])
    paths = {r.node: r.path for r in t.collect()}
    assert paths["c"] == ["a", "b", "c"] and paths["e"] == ["e"] and paths["x"] is None
    pairs = {(r.ancestor, r.descendant, r.distance) for r in descendants(t).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
    loops = {r.node: (r.root, r.depth) for r in t.where("depth < 0").collect()}
    assert loops == {"x": ("x", -1), "y": ("x", -1), "z": ("x", -2), "s": ("s", -1)}


def test_empty_and_null(spark):
    assert tree(spark, []).count() == 0
    assert [r.node for r in tree(spark, [(None, "a"), ("a", None)]).collect()] == ["a"]
