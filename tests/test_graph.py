"""Graph operators against plain Python on small graphs."""

import random
from collections import deque

from reachbase.operators import graph


def table(spark, pairs, kinds=None):
    return spark.createDataFrame([(m, g, (kinds or {}).get((m, g), "ad_group")) for m, g in pairs], "member_key string, group_key string, edge_kind string")


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def reach(pairs, start):
    seen, queue = {}, deque([start])
    while queue:
        at = queue.popleft()
        for m, g in pairs:
            if m == at and g not in seen:
                seen[g] = seen.get(at, 0) + 1
                queue.append(g)
    return seen


def plain_components(pairs):
    nodes = {x for p in pairs for x in p}
    far = {n: set(reach(pairs, n)) for n in nodes}
    out = {}
    for n in nodes:
        both = {m for m in far[n] if n in far[m] and m != n} | {n}
        if len(both) > 1:
            out[n] = min(both)
    return out


def plain_loop(pairs, start, inside):
    """The first in order of the shortest ways from start back to it."""
    level = [[start]]
    while True:
        level = [[*way, g] for way in level for m, g in sorted(pairs) if m == way[-1] and g in inside and (g == start or g not in way)]
        ends = sorted(w for w in level if w[-1] == start)
        if ends:
            return ends[0]


def random_pairs(seed, n, m):
    draw = random.Random(seed)
    return sorted({(f"n{draw.randrange(n):02}", f"n{draw.randrange(n):02}") for _ in range(m)})


def test_components_and_loops(spark):
    ring = [(f"r{k:03}", f"r{(k + 1) % 12:03}") for k in range(12)] + [("r000", "x1"), ("x1", "r005"), ("s", "s"), ("p", "r001")]
    cases = [[*random_pairs(1, 12, 20), *ring], [("a", "b"), ("b", "c")]]
    for pairs in cases:
        real = [(m, g) for m, g in pairs if m != g]
        want = plain_components(real)
        assert {r["key"]: r["component"] for r in graph.components(table(spark, pairs)).collect()} == want
        found = {r["cycle_id"]: r for r in graph.cycles(table(spark, pairs)).collect()}
        assert set(found) == set(want.values())
        for cycle, r in found.items():
            inside = {n for n, c in want.items() if c == cycle}
            assert r["members"] == sorted(inside) and r["size"] == len(inside)
            assert r["loop"] == plain_loop(real, cycle, inside)


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    ring = [(f"k{i:05}", f"k{(i + 1) % 300:05}") for i in range(300)]
    rounds = []
    monkeypatch.setattr(graph, "cut", lambda rows, cut=graph.cut: rounds.append(1) or cut(rows))
    got = graph.cycles(table(spark, ring)).collect()
    assert len(got) == 1 and got[0]["size"] == 300 and len(got[0]["loop"]) == 301 and len(rounds) < 150  # tables written, where single steps would take some for each of 300 nodes


def test_expand_keeps_shortest_paths_and_says_why_it_stops(spark):
    pairs = random_pairs(3, 20, 40) + [("n00", "end"), ("end", "far")]
    kinds = {pairs[0]: graph.FOREIGN, pairs[5]: graph.FOREIGN, ("end", "far"): graph.FOREIGN}
    roots = ["n00", "n03", "nobody"]
    nodes, summary = graph.expand(table(spark, pairs, kinds), keys(spark, roots), down=False)
    got = {}
    for r in nodes.collect():
        got.setdefault(r["root"], {})[r["key"]] = r
    for root in roots:
        want = {k: d for k, d in reach(pairs, root).items() if k != root}
        assert {k: r["depth"] for k, r in got.get(root, {}).items()} == want
        for k, r in got.get(root, {}).items():
            assert r["path"][0] == root and r["path"][-1] == k and len(r["path"]) == r["depth"] + 1
            assert r["foreign"] == any(kinds.get(p) for p in zip(r["path"], r["path"][1:]))
    assert all(r["truncation"] == [] for r in summary.collect())

    star = [("hub", f"g{k:02}") for k in range(9)] + [("g00", "deep"), ("deep", "deeper")]
    limits = {"max_depth": dict(max_depth=2), "max_nodes": dict(max_nodes=4), "max_edges": dict(max_edges=5)}
    for reason, limit in limits.items():
        nodes, summary = graph.expand(table(spark, star), keys(spark, ["hub"]), False, **limit)
        s = summary.collect()[0]
        assert s["truncation"] == [reason]
        assert nodes.count() == s["nodes"] == {"max_depth": 10, "max_nodes": 4, "max_edges": 5}[reason]
    assert graph.expand(table(spark, star), keys(spark, ["hub"]), False, max_depth=3)[1].collect()[0]["truncation"] == []


def plain_paths(pairs, root, target):
    out, level = [], [[root]]
    while level:
        level = [[*w, g] for w in level for m, g in set(pairs) if m == w[-1] and g not in w]
        out += [w for w in level if w[-1] == target]
        level = [w for w in level if w[-1] != target]
    return sorted(out, key=lambda w: (len(w), w))


def test_find_paths(spark):
    pairs = random_pairs(6, 9, 20)
    asked = [(a, b) for a in ("n00", "n01", "n05") for b in ("n02", "n07", "none")]
    rows = spark.createDataFrame(asked, "root string, target string")
    paths, summary = graph.find_paths(table(spark, pairs), rows)
    got = {}
    for r in paths.collect():
        got.setdefault((r["root"], r["target"]), []).append(r["path"])
    for a, b in asked:
        assert sorted(got.get((a, b), []), key=lambda w: (len(w), w)) == plain_paths(pairs, a, b)
    assert {(r["root"], r["target"]): (r["paths"], r["truncation"]) for r in summary.collect()} == {(a, b): (len(plain_paths(pairs, a, b)), []) for a, b in asked}
    few, summary = graph.find_paths(table(spark, pairs), rows, max_paths=2)
    for r in summary.collect():
        want = plain_paths(pairs, r["root"], r["target"])
        assert r["paths"] == min(2, len(want)) and r["truncation"] == (["max_paths"] if len(want) > 2 else [])
    chain = table(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    for depth, reasons in ((1, ["max_depth"]), (2, ["max_depth"]), (3, [])):
        _, summary = graph.find_paths(chain, spark.createDataFrame([("a", "d")], "root string, target string"), max_depth=depth)
        assert [r["truncation"] for r in summary.collect()] == [reasons]


def test_longest_chains(spark):
    diamonds = [(f"m{k}{s}", f"m{k + 1}{t}") for k in range(14) for s in "ab" for t in "ab"]  # 2^15 chains
    loop = [("x", "y"), ("y", "z"), ("z", "x"), ("m0a", "x"), ("z", "top")]
    got = {r["key"]: r["path"] for r in graph.longest_chains(table(spark, diamonds + loop)).collect()}
    assert got["m14b"] == ["m14b", *(f"m{k}a" for k in reversed(range(14)))]
    assert got["x"] == ["x", "z", "y"] and got["y"] == ["y", "x", "m0a"] and got["z"] == ["z", "y", "x", "m0a"] and got["top"] == ["top", "z", "y", "x", "m0a"] and got["m0b"] == ["m0b"]
