"""Membership graphs: closure, paths, cycles and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions.tables import cut


def neighbours(edges: DataFrame, keys: DataFrame, down: bool) -> DataFrame:
    """key, neighbour: direct members (down) or direct groups (up) of the keys."""
    here, there = ("group_key", "member_key") if down else ("member_key", "group_key")
    return keys.select("key").distinct().join(edges.select(F.col(here).alias("key"), F.col(there).alias("neighbour")), "key").distinct()


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """member_key, group_key, depth: every group reached, with the least number of steps.

    Only groups are closed over, level by level with what is known taken out, until nothing is new; members that
    are no groups themselves are joined to their groups' closure once, at the end.
    """
    pairs = cut(edges.select("member_key", "group_key").distinct())
    groups = pairs.select(F.col("group_key").alias("member_key")).distinct()
    core = cut(pairs.join(groups, "member_key", "left_semi"))
    levels = [cut(core.withColumn("depth", F.lit(1)))]
    step = core.select(F.col("member_key").alias("group_key"), F.col("group_key").alias("next"))
    known = levels[0]
    while (max_depth is None or len(levels) < max_depth) and not levels[-1].isEmpty():
        found = levels[-1].join(step, "group_key").select("member_key", F.col("next").alias("group_key")).distinct()
        levels.append(cut(found.join(known, ["member_key", "group_key"], "left_anti").withColumn("depth", F.lit(len(levels) + 1))))
        known = known.unionByName(levels[-1])
    leaves = pairs.join(groups, "member_key", "left_anti")
    above = known.select(F.col("member_key").alias("group_key"), F.col("group_key").alias("far"), "depth")
    through = leaves.join(above, "group_key").select("member_key", F.col("far").alias("group_key"), (F.col("depth") + 1).alias("depth"))
    everything = known.unionByName(leaves.withColumn("depth", F.lit(1))).unionByName(through)
    out = everything.groupBy("member_key", "group_key").agg(F.min("depth").alias("depth"))
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def truncated(edges: DataFrame, max_depth: int) -> DataFrame:
    """member_key: principals that reach further groups beyond the depth, whose answers are a lower bound."""
    return closure(edges).where(F.col("depth") > max_depth).select("member_key").distinct()


def simple_paths(edges: DataFrame, start: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """start, target, path: every chain of groups without repetition from a start up to a target, of at most ``max_depth`` steps where that is given; ``find_paths`` says what a bound leaves out."""
    step = edges.select(F.col("member_key").alias("at"), F.col("group_key").alias("next")).distinct()
    ends = targets.select(F.col("key").alias("at")).distinct()
    walk = cut(start.select(F.col("key").alias("start"), F.col("key").alias("at"), F.array("key").alias("path")).distinct())
    found = []
    while max_depth is None or len(found) < max_depth:
        walk = cut(walk.join(step, "at").where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path")))
        if walk.isEmpty():
            break
        found.append(walk.join(ends, "at", "left_semi").select("start", F.col("at").alias("target"), "path"))
        walk = walk.join(ends, "at", "left_anti")
    if not found:
        return walk.select("start", F.col("at").alias("target"), "path").limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def chains(edges: DataFrame, start: DataFrame, down: bool, max_depth: int | None = None) -> DataFrame:
    """start, key, depth, path: every chain without repetition, in one direction, of at most ``max_depth`` steps where that is given."""
    here, there = ("group_key", "member_key") if down else ("member_key", "group_key")
    step = edges.select(F.col(here).alias("key"), F.col(there).alias("next")).distinct()
    walk = start.select(F.col("key").alias("start"), "key", F.lit(0).alias("depth"), F.array("key").alias("path")).distinct()
    levels = []
    while max_depth is None or len(levels) < max_depth:
        walk = cut(walk.join(step, "key").where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("key"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("next")).alias("path")))
        if walk.isEmpty():
            break
        levels.append(walk)
    out = levels[0] if levels else walk
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def longest_chains(edges: DataFrame) -> DataFrame:
    """key, path: the longest chain of members below each group, the first in order among equals; nodes without members are a chain of one.

    A group is settled once all its members are, from the bottom up, so stacked diamonds cost their edges and not their
    chains.  Only what lies on or above a cycle is walked chain by chain, without repetition, and goes on with what is settled.
    """
    pairs = cut(edges.where("group_key <> member_key").select("group_key", "member_key").distinct())
    best = lambda path: F.min(F.struct((-F.size(path)).alias("less"), path.alias("path")))["path"]
    settled = cut(pairs.select(F.col("member_key").alias("key")).distinct().join(pairs.select(F.col("group_key").alias("key")).distinct(), "key", "left_anti").select("key", F.array("key").alias("path")))
    many, new, open_ = pairs.groupBy("group_key").agg(F.count("*").alias("n")), settled, pairs
    while not new.isEmpty():
        below = open_.join(settled.withColumnsRenamed({"key": "member_key", "path": "below"}), "member_key")
        ready = below.groupBy("group_key").agg(F.count("*").alias("ready"), best(F.col("below")).alias("below")).join(many, "group_key").where("ready = n")
        new = cut(ready.select(F.col("group_key").alias("key"), F.concat(F.array("group_key"), "below").alias("path")))
        settled = settled.unionByName(new)
        open_ = cut(open_.join(new.select(F.col("key").alias("group_key")), "group_key", "left_anti"))
    if open_.isEmpty():
        return settled
    groups = open_.select("group_key").distinct()
    around = open_.join(groups.select(F.col("group_key").alias("member_key")), "member_key", "left_semi")
    walks = chains(around, groups.select(F.col("group_key").alias("key")), down=True, max_depth=None).select("start", F.col("key").alias("group_key"), F.col("path").alias("way"))
    walks = walks.unionByName(groups.select(F.col("group_key").alias("start"), "group_key", F.array("group_key").alias("way")))
    out_of = open_.join(settled.withColumnsRenamed({"key": "member_key", "path": "below"}), "member_key").groupBy("group_key").agg(best(F.col("below")).alias("below"))
    ways = walks.join(out_of, "group_key", "left").select(F.col("start").alias("key"), F.concat("way", F.coalesce("below", F.array().cast("array<string>"))).alias("path"))
    return settled.unionByName(ways.groupBy("key").agg(best(F.col("path")).alias("path")))


def _contracted(edges: DataFrame, fixed: DataFrame | None, every: bool) -> DataFrame:
    """``edges`` (a, b, inner) with the chains drawn together: inner has the nodes between a and b.

    A node with one edge in and one out is passed through whatever happens around it, so it moves into its edge;
    of neighbours the one of least hash goes first, which takes a share of every chain in each round.  Nodes that
    nothing leads to, or that lead nowhere, lie on no cycle and go with their edges.  ``fixed`` (key) nodes stay.
    Without ``every``, of parallel edges only the shortest stays, the first in order among equals.
    """
    live = cut(edges)
    while True:
        outs, ins = live.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("n_out"), F.first("b").alias("to")), live.groupBy(F.col("b").alias("key")).agg(F.count("*").alias("n_in"), F.first("a").alias("from"))
        nodes = outs.join(ins, "key", "full_outer")
        if fixed is not None:
            nodes = nodes.join(fixed.select("key", F.lit(True).alias("fixed")), "key", "left")
        dead = F.col("n_out").isNull() | F.col("n_in").isNull()
        chain = (F.col("n_out") == 1) & (F.col("n_in") == 1) & (F.col("to") != F.col("key"))
        kind = F.when(dead, "dead").when(chain if fixed is None else chain & F.col("fixed").isNull(), "chain")
        nodes = cut(nodes.select("key", "from", "to", kind.alias("kind")).where("kind IS NOT NULL"))
        if nodes.isEmpty():
            return live
        chained = nodes.where("kind = 'chain'").select("key", "from", "to")
        seats = chained.select(F.col("key").alias("near"), F.xxhash64("key").alias("seat"), F.lit(True).alias("too"))
        around = chained.withColumn("mine", F.xxhash64("key")).join(seats.withColumnsRenamed({"near": "from", "seat": "s1", "too": "t1"}), "from", "left").join(seats.withColumnsRenamed({"near": "to", "seat": "s2", "too": "t2"}), "to", "left")
        less = lambda seat, key: F.col(seat).isNull() | (F.struct(F.col("mine"), F.col("key")) < F.struct(F.col(seat), F.col(key)))
        going = cut(around.where(less("s1", "from") & less("s2", "to")).select("key"))
        dropped = nodes.where("kind = 'dead'").select("key")
        kept = live.join(dropped.select(F.col("key").alias("a")), "a", "left_anti").join(dropped.select(F.col("key").alias("b")), "b", "left_anti")
        into, out_of = kept.join(going.select(F.col("key").alias("b")), "b").select("a", F.col("b").alias("via"), F.col("inner").alias("i1")), kept.join(going.select(F.col("key").alias("a")), "a").select(F.col("a").alias("via"), "b", F.col("inner").alias("i2"))
        through = into.join(out_of, "via").select("a", "b", F.concat("i1", F.array("via"), "i2").alias("inner"))
        rest = kept.join(going.select(F.col("key").alias("a")), "a", "left_anti").join(going.select(F.col("key").alias("b")), "b", "left_anti").select("a", "b", "inner")
        live = rest.unionByName(through)
        if not every:
            live = live.groupBy("a", "b").agg(F.min(F.struct(F.size("inner").alias("n"), F.col("inner").alias("inner"))).alias("x")).select("a", "b", "x.inner")
        live = cut(live)


def components(edges: DataFrame) -> DataFrame:
    """key, component: nodes on a cycle of two or more, with the least node of those that reach each other.

    Chains are drawn together first, so long rings take a number of rounds that grows with their logarithm.  In what
    is left every node learns the greatest node that reaches it; the nodes of one colour that reach their
    colour's own node are a component, which is taken out, and the rest goes on.
    """
    pairs = edges.where("group_key <> member_key").select(F.col("member_key").alias("a"), F.col("group_key").alias("b")).distinct()
    core = _contracted(pairs.withColumn("inner", F.array().cast("array<string>")), None, every=True)
    live, found = cut(core.select("a", "b").distinct()), []
    while not live.isEmpty():
        colour = cut(live.select(F.col("a").alias("key")).union(live.select("b")).distinct().withColumn("colour", F.col("key")))
        moved = True
        while moved:  # the greatest node that reaches each
            further = live.join(colour.withColumnRenamed("key", "a"), "a").groupBy(F.col("b").alias("key")).agg(F.max("colour").alias("other"))
            both = cut(colour.join(further, "key", "left").select("key", F.greatest("colour", "other").alias("colour"), (F.col("other") > F.col("colour")).alias("moved")))
            moved = not both.where("moved").isEmpty()
            colour = both.select("key", "colour")
        within = live.join(colour.withColumnsRenamed({"key": "a", "colour": "ca"}), "a").join(colour.withColumnsRenamed({"key": "b", "colour": "cb"}), "b").where("ca = cb").select("a", "b", F.col("ca").alias("colour"))
        within = cut(within)
        known = frontier = cut(colour.where("key = colour"))
        while not frontier.isEmpty():  # back from each colour's own node
            back = within.join(frontier.select(F.col("key").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("key"), "colour").distinct()
            frontier = cut(back.join(known, ["key", "colour"], "left_anti"))
            known = known.unionByName(frontier)
        known = cut(known)
        found.append(known)
        live = cut(live.join(known.select(F.col("key").alias("a")), "a", "left_anti").join(known.select(F.col("key").alias("b")), "b", "left_anti"))
    if not found:
        return pairs.select(F.col("a").alias("key"), F.col("a").alias("component")).limit(0)
    coloured = found[0]
    for more in found[1:]:
        coloured = coloured.unionByName(more)
    c = coloured.select("key", "colour")
    across = core.join(c.withColumnsRenamed({"key": "a", "colour": "ca"}), "a").join(c.withColumnsRenamed({"key": "b", "colour": "cb"}), "b").where("ca = cb")
    on_cycle = cut(across.select(F.explode(F.concat(F.array("a", "b"), "inner")).alias("key"), F.col("ca").alias("colour")).distinct())
    least = on_cycle.groupBy("colour").agg(F.min("key").alias("component"))
    return on_cycle.join(least, "colour").select("key", "component")


def cycles(edges: DataFrame) -> DataFrame:
    """cycle_id, members, size, loop: groups that each reach all others, and a shortest loop from the least of them, the first in order.

    The loop runs from member to group.  It is searched from all cycles' least nodes at once with the way so far as
    pointer, over edges that hold the chains they stand for.
    """
    member = cut(components(edges))
    inside = edges.where("group_key <> member_key").select(F.col("member_key").alias("a"), F.col("group_key").alias("b")).distinct()
    inside = inside.join(member.withColumnsRenamed({"key": "a", "component": "ca"}), "a").join(member.withColumnsRenamed({"key": "b", "component": "cb"}), "b").where("ca = cb")
    starts = member.select(F.col("component").alias("key")).distinct()
    step = cut(_contracted(inside.select("a", "b", F.array().cast("array<string>").alias("inner")), starts, every=False))
    best = cut(starts.select(F.col("key").alias("start"), F.col("key").alias("at"), F.array("key").alias("way")))
    frontier, closed = best, None
    short = lambda ways: F.min(F.struct(F.size(ways).alias("n"), F.col(ways).alias("way")))
    while not frontier.isEmpty():
        moved = cut(frontier.join(step, F.col("at") == F.col("a")).select("start", F.col("b").alias("at"), F.concat("way", "inner", F.array("b")).alias("way")))
        ends = moved.where("at = start")
        closed = cut((ends if closed is None else closed.unionByName(ends)).groupBy("start", "at").agg(short("way").alias("x")).select("start", "at", "x.way"))
        further = moved.where("at <> start").groupBy("start", "at").agg(short("way").alias("x")).select("start", "at", "x.way")
        bound = closed.select("start", F.size("way").alias("most"))
        old = best.withColumnRenamed("way", "old")
        better = further.join(old, ["start", "at"], "left").join(bound, "start", "left").where(
            (F.col("old").isNull() | (F.struct(F.size("way"), F.col("way")) < F.struct(F.size("old"), F.col("old")))) & (F.col("most").isNull() | (F.size("way") < F.col("most")))
        )
        frontier = cut(better.select("start", "at", "way"))
        best = cut(best.unionByName(frontier).groupBy("start", "at").agg(short("way").alias("x")).select("start", "at", "x.way"))
    sets = member.groupBy(F.col("component").alias("cycle_id")).agg(F.array_sort(F.collect_set("key")).alias("members"))
    if closed is None:
        return sets.withColumns({"size": F.size("members"), "loop": F.col("members")})
    return sets.join(closed.select(F.col("start").alias("cycle_id"), F.col("way").alias("loop")), "cycle_id", "left").select("cycle_id", "members", F.size("members").alias("size"), "loop")


#: Kind of an edge whose member stands for a principal of another domain.
FOREIGN = "foreign_security_principal"


def expand(edges: DataFrame, roots: DataFrame, down: bool, max_depth: int | None = 64, max_nodes: int | None = 50_000, max_edges: int | None = 200_000) -> tuple[DataFrame, DataFrame]:
    """(root, key, depth, path, foreign) and (root, nodes, edges, depth_reached, truncation): search from many ``roots`` (key) at once.

    A node's path is a shortest one, the first in order.  ``foreign`` says that it leads through a principal of
    another domain.  A root whose bounds are met keeps what it has, takes the first nodes or edges of the level in order up to the
    bound, and stops; its truncation names max_depth (only if something lies beyond), max_nodes or max_edges.  None is no bound.
    """
    here, there = ("group_key", "member_key") if down else ("member_key", "group_key")
    foreign = F.coalesce(F.col("edge_kind") == FOREIGN, F.lit(False)) if "edge_kind" in edges.columns else F.lit(False)
    step = cut(edges.select(F.col(here).alias("at"), F.col(there).alias("key"), foreign.alias("taint")).groupBy("at", "key").agg(F.max("taint").alias("taint")))
    start = cut(roots.select(F.col("key").alias("root")).distinct())
    own = start.select("root", F.col("root").alias("key"), F.lit(0).alias("depth"), F.array("root").alias("path"), F.lit(False).alias("foreign"))
    frontier, nodes, depth, capped = own, own, 0, max_nodes is not None or max_edges is not None
    spent, stopped = start.select("root", F.lit(0).cast("long").alias("nodes"), F.lit(0).cast("long").alias("edges")), []
    first = lambda rows, order, most: rows.withColumn("seat", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where(F.col("seat") <= most)
    while max_depth is None or depth < max_depth:
        depth += 1
        tried = frontier.select("root", F.col("key").alias("at"), F.col("path").alias("way"), F.col("foreign").alias("so_far")).join(step, "at").select("root", "way", "key", (F.col("so_far") | F.col("taint")).alias("foreign"))
        if max_edges is not None:
            tried = cut(tried.join(spent, "root"))
            over = cut(tried.groupBy("root").agg((F.first("edges") + F.count("*")).alias("would")).where(F.col("would") > max_edges).select("root"))
            within = first(tried.join(over, "root", "left_semi"), ["way", "key"], max_edges).where(F.col("seat") + F.col("edges") <= max_edges).drop("seat")
            tried = cut(tried.join(over, "root", "left_anti").unionByName(within).drop("nodes", "edges"))
            stopped.append(over.withColumn("reason", F.lit("max_edges")))
        new = tried.join(nodes.select("root", "key"), ["root", "key"], "left_anti").groupBy("root", "key").agg(F.min(F.struct("way", "foreign")).alias("x"))
        new = cut(new.select("root", "key", F.lit(depth).alias("depth"), F.concat("x.way", F.array("key")).alias("path"), "x.foreign"))
        if max_nodes is not None:
            counted = new.join(spent.select("root", "nodes"), "root")
            many = cut(counted.groupBy("root").agg((F.first("nodes") + F.count("*")).alias("would")).where(F.col("would") > max_nodes).select("root"))
            within = first(counted.join(many, "root", "left_semi"), ["path"], max_nodes).where(F.col("seat") + F.col("nodes") <= max_nodes).drop("seat")
            new = cut(counted.join(many, "root", "left_anti").unionByName(within).drop("nodes"))
            stopped.append(many.withColumn("reason", F.lit("max_nodes")))
        if capped:
            added = tried.groupBy("root").agg(F.count("*").alias("more_edges")).join(new.groupBy("root").agg(F.count("*").alias("more_nodes")), "root", "left")
            spent = cut(spent.join(added, "root", "left").select("root", (F.col("nodes") + F.coalesce("more_nodes", F.lit(0))).alias("nodes"), (F.col("edges") + F.coalesce("more_edges", F.lit(0))).alias("edges")))
        nodes = nodes.unionByName(new)
        frontier = new
        for rows in stopped[-2:] if capped else []:
            frontier = frontier.join(rows, "root", "left_anti")
        if frontier.isEmpty():
            break
    else:
        beyond = frontier.select("root", F.col("key").alias("at")).join(step, "at").join(nodes.select("root", "key"), ["root", "key"], "left_anti").select("root").distinct()
        stopped.append(beyond.withColumn("reason", F.lit("max_depth")))
    if not capped:
        out = step.groupBy(F.col("at").alias("key")).agg(F.count("*").alias("n"))
        spent = nodes.join(out, "key", "left").groupBy("root").agg((F.count("*") - 1).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    reasons = start.limit(0).withColumn("reason", F.lit(""))
    for rows in stopped:
        reasons = reasons.unionByName(rows)
    reasons = reasons.groupBy("root").agg(F.array_sort(F.collect_set("reason")).alias("truncation"))
    reached = nodes.groupBy("root").agg(F.max("depth").alias("depth_reached"))
    summary = spent.join(reached, "root").join(reasons, "root", "left").select("root", "nodes", "edges", "depth_reached", F.coalesce("truncation", F.array().cast("array<string>")).alias("truncation"))
    return nodes.where("depth > 0"), summary


def find_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 64, max_paths: int = 100) -> tuple[DataFrame, DataFrame]:
    """(root, target, path) and (root, target, paths, truncation): chains of groups without repetition from root to target, per pair (root, target).

    Only nodes that lie between the two are walked: reached from the root, and reaching the target.  Paths come level by level, shorter ones
    first and then in order; a pair stops at ``max_paths`` and says so if a further path exists, or at ``max_depth`` if walks remain.
    """
    up, up_ends = expand(edges, pairs.select(F.col("root").alias("key")), False, max_depth, None, None)
    back, back_ends = expand(edges, pairs.select(F.col("target").alias("key")), True, max_depth, None, None)
    asked = cut(pairs.select("root", "target").where("root <> target").distinct())
    own = lambda rows, end: rows.select(F.col("root").alias(end), "key").unionByName(asked.select(end, F.col(end).alias("key")).distinct())
    between = cut(asked.join(own(up, "root"), "root").join(own(back, "target"), ["target", "key"]).select("root", "target", F.col("key").alias("next")))
    step = cut(edges.select(F.col("member_key").alias("at"), F.col("group_key").alias("next")).distinct())
    walk = cut(asked.select("root", "target", F.col("root").alias("at"), F.array("root").alias("path")))
    spent = cut(asked.withColumn("n", F.lit(0).cast("long")))
    found, full = [], []
    for _ in range(max_depth):
        moved = walk.join(step, "at").join(between, ["root", "target", "next"]).where(~F.array_contains("path", F.col("next")))
        moved = cut(moved.select("root", "target", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path")))
        if moved.isEmpty():
            walk = moved
            break
        ends = moved.where("at = target").join(spent, ["root", "target"])
        ends = cut(ends.withColumn("seat", F.row_number().over(Window.partitionBy("root", "target").orderBy("path"))).where(F.col("seat") <= max_paths + 1).withColumn("seat", F.col("seat") + F.col("n")))
        found.append(ends.where(F.col("seat") <= max_paths).select("root", "target", "path"))
        over = cut(ends.where(F.col("seat") > max_paths).select("root", "target").distinct())
        full.append(over.withColumn("reason", F.lit("max_paths")))
        spent = cut(spent.join(ends.groupBy("root", "target").agg(F.max("seat").alias("most")), ["root", "target"], "left").select("root", "target", F.when(F.col("most").isNotNull(), F.least("most", F.lit(max_paths))).otherwise(F.col("n")).alias("n")))
        walk = cut(moved.where("at <> target").join(over, ["root", "target"], "left_anti"))
    full.append(walk.select("root", "target").distinct().withColumn("reason", F.lit("max_depth")))
    # Neither search met the other's end and both stopped at the depth: a longer path cannot be ruled out.
    cut_off = lambda ends, name: ends.where(F.array_contains("truncation", "max_depth")).select(F.col("root").alias(name))
    unmet = asked.join(cut_off(up_ends, "root"), "root").join(cut_off(back_ends, "target"), "target").join(up.select("root", F.col("key").alias("target")), ["root", "target"], "left_anti")
    full.append(unmet.select("root", "target").withColumn("reason", F.lit("max_depth")))
    paths, reasons = found[0] if found else walk.select("root", "target", "path").limit(0), full[0]
    for rows in found[1:]:
        paths = paths.unionByName(rows)
    for rows in full[1:]:
        reasons = reasons.unionByName(rows)
    reasons = reasons.groupBy("root", "target").agg(F.array_sort(F.collect_set("reason")).alias("truncation"))
    return paths, spent.join(reasons, ["root", "target"], "left").select("root", "target", F.col("n").alias("paths"), F.coalesce("truncation", F.array().cast("array<string>")).alias("truncation"))


def without_edge(edges: DataFrame, removed: DataFrame, root: str) -> DataFrame:
    """removed_group, removed_member, group_key: what the root still reaches after each removal, one at a time."""
    gone = removed.select(F.col("group_key").alias("removed_group"), F.col("member_key").alias("removed_member")).distinct()
    step = edges.select("member_key", "group_key").distinct()
    frontier = known = cut(gone.withColumn("group_key", F.lit(root)))
    while not frontier.isEmpty():
        further = frontier.withColumnRenamed("group_key", "member_key").join(step, "member_key")
        further = further.where((F.col("member_key") != F.col("removed_member")) | (F.col("group_key") != F.col("removed_group")))
        frontier = cut(further.select("removed_group", "removed_member", "group_key").distinct().join(known, ["removed_group", "removed_member", "group_key"], "left_anti"))
        known = known.unionByName(frontier)
    return known.where(F.col("group_key") != root)


def degrees(principals: DataFrame, edges: DataFrame) -> DataFrame:
    """principal_key, direct_members, direct_groups; zero where there are none."""
    members = edges.groupBy(F.col("group_key").alias("principal_key")).agg(F.count_distinct("member_key").alias("direct_members"))
    groups = edges.groupBy(F.col("member_key").alias("principal_key")).agg(F.count_distinct("group_key").alias("direct_groups"))
    out = principals.select("principal_key").join(members, "principal_key", "left").join(groups, "principal_key", "left")
    return out.fillna(0, ["direct_members", "direct_groups"])


def lint(principals: DataFrame, edges: DataFrame) -> DataFrame:
    """issue, key: endpoints that nobody described, and members of things that are no groups."""
    known = principals.select(F.col("principal_key").alias("key"), "kind")
    ends = edges.select(F.col("group_key").alias("key"), F.lit("dangling_group").alias("issue")).unionByName(edges.select(F.col("member_key").alias("key"), F.lit("dangling_member").alias("issue")))
    dangling = ends.distinct().join(known, "key", "left_anti")
    wrong = edges.select(F.col("group_key").alias("key")).distinct().join(known.where("kind NOT IN ('group', 'well_known')"), "key", "left_semi").withColumn("issue", F.lit("not_a_group"))
    own = edges.where("group_key = member_key").select(F.col("group_key").alias("key"), F.lit("self_membership").alias("issue"))
    return dangling.unionByName(wrong).unionByName(own).distinct()
