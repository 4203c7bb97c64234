import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reachbase.functions import keys, masks
from reachbase.operators import access, acl, alerts, governance, graph, history, operations, risk, simulate
from reachbase.plans.estate import Estate
from reachbase.sources import contract

ACE = "resource_key string, trustee_key string, ace_type string, access_mask long, ace_flags int, order_index int, ace_key string"


def entries(spark, rows):
    return spark.createDataFrame([(r, t, k, m, f, o, f"{r}{t}{k}{m}{f}") for r, t, k, m, f, o in rows], ACE)


def test_masks(spark):
    rows = spark.createDataFrame([(masks.GENERIC_ALL,), (masks.GENERIC_READ | 2,), (0x1301BF,), (0x100000,), (0x4,), (0x1F01FF,), (0x20089 | 0x116,)], "m long")
    got = rows.select(masks.expand_generic(F.col("m")).alias("e"), masks.category(F.col("m")).alias("c"), masks.categories(F.col("m")).alias("all"), masks.extra_bits(F.col("m")).alias("x")).collect()
    assert [r["e"] for r in got[:3]] == [0x1F01FF, 0x12008B, 0x1301BF]
    assert [r["c"] for r in got[2:]] == ["modify", "none", "special", "full_control", "write"]
    assert got[6]["all"] == ["write", "read"] and got[4]["x"] == 4 and got[5]["all"] == ["full_control"]
    assert spark.range(1).select(masks.minus(F.lit(0xFFFFFFFF), F.lit(1))).first()[0] == 0xFFFFFFFE


def test_keys(spark):
    row = spark.createDataFrame([("\\\\Srv\\Share\\a\\b",)], "p string").select(
        keys.resource_key(F.col("p")).alias("k"), keys.parent_key(keys.resource_key(F.col("p"))).alias("up"), keys.ancestors(keys.resource_key(F.col("p"))).alias("all"),
        keys.principal_key(F.lit("S-1-5-32-544"), F.lit("SRV")).alias("local"), keys.rid(F.lit("S-1-5-21-1-2-3-513")).alias("rid"), keys.is_privileged(F.lit("h|S-1-5-32-544")).alias("high"),
    ).first()
    assert row["k"] == "\\\\srv\\share\\a\\b" and row["up"] == "\\\\srv\\share\\a" and [a["distance"] for a in row["all"]] == [1, 2] and row["all"][1]["key"] == "\\\\srv\\share"
    assert row["local"] == "srv|S-1-5-32-544" and row["rid"] == "513" and row["high"]


def fold(rows):
    granted = denied = 0
    for kind, mask in rows:
        if kind == "allow":
            granted |= mask & ~denied
        else:
            denied |= mask & ~granted
    return granted


def test_fold_is_ordered_and_sound(spark):
    draw = random.Random(1)
    lists = {f"r{i}": [(draw.choice(["allow", "deny"]), draw.randrange(1, 512)) for _ in range(draw.randrange(0, 8))] for i in range(200)}
    aces = entries(spark, [(r, f"t{k}", kind, mask, 0, k) for r, rows in lists.items() for k, (kind, mask) in enumerate(rows)])
    got = {r["resource_key"]: r["f"] for r in aces.groupBy("resource_key").agg(acl.fold(acl.ordered_entries()).alias("f")).collect()}
    differs = 0
    for r, rows in lists.items():
        if rows:
            assert got[r]["granted"] == fold(rows)
            allowed = [m for k, m in rows if k == "allow"]
            assert got[r]["granted"] & ~(0 if not allowed else __import__("functools").reduce(int.__or__, allowed)) == 0
            differs += got[r]["granted"] != got[r]["canonical"]
    assert differs > 0


def test_inheritance_table(spark):
    cases = {0: [], 1: [(0x1, 16 | 1 | 8)], 2: [(0x1, 16 | 2)], 3: [(0x1, 16 | 3)], 6: [(0x1, 16)], 5: [], 10: [(0x1, 16 | 2)], 4: []}
    got = acl.projected(entries(spark, [(f"r{f}", "t", "allow", 1, f, 0) for f in cases])).collect()
    for f, want in cases.items():
        assert [(r["access_mask"], r["ace_flags"]) for r in got if r["resource_key"] == f"r{f}"] == want
    split = acl.projected(entries(spark, [("g", "t", "allow", masks.GENERIC_ALL, 3, 0), ("c", keys.CREATOR_OWNER, "allow", 1, 2, 0)])).orderBy("resource_key", "order_index").collect()
    assert [(r["resource_key"], r["access_mask"], r["ace_flags"]) for r in split] == [("c", 1, 26), ("g", masks.FILE_ALL, 16), ("g", masks.GENERIC_ALL, 27)]


def test_unordered_digest_ignores_row_order(spark):
    res = spark.createDataFrame([("a", True, False), ("b", True, False), ("n", False, False), ("e", True, False)], "resource_key string, dacl_present boolean, dacl_protected boolean")
    rows = [("a", "t", "allow", 1, 0, None), ("a", "u", "deny", 2, 0, 3), ("b", "u", "deny", 2, 0, 3), ("b", "t", "allow", 1, 0, None)]
    got = {r["resource_key"]: r["acl_hash"] for r in acl.digests(res, entries(spark, rows)).collect()}
    assert got["a"] == got["b"] and got["n"] != got["e"] != got["a"]


def brute_reach(edges, start):
    seen, todo = {}, [(start, 0)]
    while todo:
        at, d = todo.pop(0)
        for m, g in edges:
            if m == at and g not in seen:
                seen[g] = d + 1
                todo.append((g, d + 1))
    return seen


def test_closure_paths_and_cycles_on_random_graphs(spark):
    draw = random.Random(3)
    pairs = sorted({(f"n{draw.randrange(14)}", f"n{draw.randrange(14)}") for _ in range(26)})
    pairs = [p for p in pairs if p[0] != p[1]]
    edges = spark.createDataFrame([(g, m, "x") for m, g in pairs], "group_key string, member_key string, edge_kind string")
    got = {(r["member_key"], r["group_key"]): r["depth"] for r in graph.closure(edges).collect()}
    nodes = {n for p in pairs for n in p}
    want = {(n, g): d for n in nodes for g, d in brute_reach(pairs, n).items()}
    assert got == want
    sets = {tuple(r["members"]) for r in graph.cycles(edges).collect()}
    mutual = {n: tuple(sorted({n} | {m for m in nodes if (n, m) in want and (m, n) in want})) for n in nodes}
    assert sets == {c for c in mutual.values() if len(c) > 1}

    def paths(at, end, path, most):
        out = []
        for m, g in pairs:
            if m == at and g not in path:
                out += [path + (g,)] if g == end else paths(g, end, path + (g,), most) if len(path) < most else []
        return out

    start, end = pairs[0][0], pairs[-1][1]
    if start != end:
        one = lambda k: spark.createDataFrame([(k,)], "key string")
        # Bounded to eight steps, and all of them: a bound is the caller's and never the default's.
        assert sorted(tuple(r["path"]) for r in graph.simple_paths(edges, one(start), one(end), 8).collect()) == sorted(paths(start, end, (start,), 8))
        assert sorted(tuple(r["path"]) for r in graph.simple_paths(edges, one(start), one(end)).collect()) == sorted(paths(start, end, (start,), 99))


def estate(spark):
    s = spark.createDataFrame
    people = s([("u1", "user", "Ann", True), ("u2", "user", "Bo", False), ("g1", "group", "G", None), ("g2", "group", "H", None)], "principal_key string, kind string, name string, enabled boolean")
    edges = s([("g1", "u1", "x"), ("g2", "g1", "x"), ("g2", "u2", "x")], "group_key string, member_key string, edge_kind string")
    res = s([("\\\\s\\a\\x", "\\\\s\\a", "s", "s|a", 1, True, False, None), ("\\\\s\\a\\n", "\\\\s\\a", "s", "s|a", 1, False, False, None), ("\\\\s\\b\\y", "\\\\s\\b", "s", "s|b", 1, True, False, None)], "resource_key string, parent_key string, server_key string, share_key string, depth int, dacl_present boolean, dacl_protected boolean, owner_key string")
    share = s([("s|a", "g2", "allow", "change", "k")], "share_key string, trustee_key string, ace_type string, permission string, ace_key string")
    aces = entries(spark, [("\\\\s\\a\\x", "g2", "allow", 0x1F01FF, 0, 1), ("\\\\s\\a\\x", "g1", "deny", 0x2, 0, 0), ("\\\\s\\b\\y", "u1", "allow", 0x1200A9, 0, 0)])
    return Estate(people, edges, s([("s",)], "server_key string"), s([("s|a", "s", "a")], "share_key string, server_key string, name string"), share, res, aces)


def test_access_crosses_layers_and_keeps_uncertainty(spark):
    reach, principals = access.matrix(estate(spark))
    got = {(r["principal_key"], r["resource_key"]): r for r in reach.join(principals, "class_key").collect()}
    assert got["u1", "\\\\s\\a\\x"]["rights"] == 0x1301BF & ~0x2 and got["u1", "\\\\s\\a\\x"]["limited_by"] == "both"
    assert got["u2", "\\\\s\\a\\x"]["rights"] == 0x1301BF and got["u2", "\\\\s\\a\\n"]["rights"] == 0x1301BF
    assert got["u1", "\\\\s\\b\\y"]["certainty"] == "at_most" and got["u1", "\\\\s\\b\\y"]["verdict"] == "granted"
    assert ("u2", "\\\\s\\b\\y") not in got


def test_overlay_equals_changed_estate(spark):
    e = estate(spark)
    planned = simulate.with_entries(e, removed=e.ntfs_aces.where("ace_type = 'deny'").select("ace_key"))
    changed = e.with_(ntfs_aces=e.ntfs_aces.where("ace_type = 'allow'"))
    one, two = (sorted(r["rights"] for r in access.matrix(x)[0].collect()) for x in (planned, changed))
    assert one == two
    assert {r["direction"] for r in simulate.entry_impact(e, planned).where("direction <> 'same'").collect()} == {"expand"}
    added = entries(spark, [("\\\\s\\a\\x", "u2", "deny", 1, 0, 0)]).drop("order_index")
    first = simulate.with_entries(e, added=added).ntfs_aces.where("resource_key = '\\\\\\\\s\\\\a\\\\x'").orderBy("order_index").first()
    assert first["trustee_key"] == "u2"


def test_disabled_is_not_unknown(spark):
    got = [r["member_key"] for r in risk.disabled_with_access(estate(spark)).collect()]
    assert got == ["u2"]


def test_empty_group_needs_enumeration(spark):
    e = estate(spark)
    bare = e.with_(edges=e.edges.where("group_key <> 'g1'"))
    none = spark.createDataFrame([], "trustee_key string")
    assert risk.empty_groups(bare, none).count() == 0
    assert [r[0] for r in risk.empty_groups(bare, spark.createDataFrame([("g1",)], "trustee_key string")).collect()] == ["g1"]


def test_versions_hold_their_invariants(spark):
    draw, t0 = random.Random(9), datetime(2024, 1, 1)
    seen = [("k", f"o{draw.randrange(5)}", "c", t0 + timedelta(hours=draw.randrange(200)), draw.choice(["a", "b", None])) for _ in range(300)]
    log = history.versions(spark.createDataFrame(seen, "kind string, key string, container string, observed_at timestamp_ntz, state string"))
    assert history.violations(log).count() == 0
    again = history.versions(spark.createDataFrame(seen + seen, "kind string, key string, container string, observed_at timestamp_ntz, state string"))
    assert sorted(map(str, log.collect())) == sorted(map(str, again.collect()))
    ask = spark.createDataFrame([("k", "o0"), ("k", "nobody")], "kind string, key string")
    got = {r["key"]: r["present"] for r in history.presence(ask, log, F.lit("2024-02-01").cast("timestamp_ntz")).collect()}
    assert got["nobody"] is None and got["o0"] is not None


def test_alert_machine(spark):
    t0 = datetime(2024, 1, 1)
    steps = [("x", 0, False, True), ("x", 1, False, True), ("y", 2, False, True), ("z", 30, False, True), ("z", 31, True, True), ("z", 32, False, True), ("w", 33, False, False)]
    events = spark.createDataFrame([("a", i, t0 + timedelta(hours=h), d, e, on) for i, (d, h, e, on) in enumerate(steps)], "alert string, seq long, at timestamp_ntz, digest string, ends boolean, enabled boolean")
    got = alerts.decide(events, 86_400).orderBy("seq").collect()
    assert [r["transition"] for r in got] == ["raised", "suppressed_identical", "suppressed_cooldown", "repeated", "resolved", "reopened", "suppressed_disabled"]
    assert got[3]["folds"] == 3


def test_audit_chain_finds_the_first_break(spark):
    chain = governance.chained(spark.createDataFrame([("c", i, f"p{i}") for i in range(1, 8)], "chain string, index long, payload string"))
    assert governance.broken_links(chain).count() == 0
    bad = chain.withColumn("payload", F.when(F.col("index") == 4, "forged").otherwise(F.col("payload")))
    assert governance.broken_links(bad).first()["first_broken"] == 4


def test_contract_takes_a_batch_once_and_names_what_it_forbids(spark, tmp_path):
    doc = '{"run_id":"r","batch_id":"b%d","sequence":%d,"is_final":false,"observations":[{"kind":"ntfs_ace","observed_at":"2024-01-01T00:00:00Z","path":"\\\\\\\\S\\\\Sh\\\\d","trustee_sid":"S-1-5-32-544","ace_type":"allow","access_mask":%d,"ace_flags":3}]}'
    for i, (b, q, m) in enumerate([(0, 0, 1), (0, 0, 1), (2, 2, 5_000_000_000)]):
        (tmp_path / f"{i}.json").write_text(doc % (b, q, m))
    batches = contract.claimed(contract.read_batches(spark, str(tmp_path)))
    rows = contract.observations(batches)
    assert rows.count() == 2 and [r["problem"] for r in contract.rejected(rows).collect()] == ["mask_out_of_range"]
    ace = contract.ntfs_aces(rows).where("access_mask = 1").first()
    assert ace["trustee_key"] == "s|S-1-5-32-544" and ace["ace_key"] == "\\\\s\\sh\\d|s|S-1-5-32-544|allow|0x00000001|0x03"
    assert contract.run_totals(batches).first()["first_missing"] == 1


def test_streamed_versions_count_late_contradictions(spark, tmp_path):
    from reachbase.streaming import ingest

    schema = "key string, state string, observed_at timestamp, arrival long"
    rows = [("k", "a", datetime(2024, 1, 5), 1), ("k", "a", datetime(2024, 1, 3), 2), ("k", "b", datetime(2024, 1, 4), 3), ("k", "b", datetime(2024, 1, 6), 4), ("k", "b", datetime(2024, 1, 7), 5)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = ingest.versions(stream).writeStream.format("memory").queryName("versions_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["outcome"] for r in spark.table("versions_out").collect()) == ["extended", "extended_back", "opened", "stale", "superseded"]


def test_streamed_batches_are_written_once(spark, tmp_path):
    from reachbase.streaming import ingest

    (tmp_path / "land").mkdir()
    doc = '{"run_id":"r","batch_id":"b","sequence":0,"is_final":true,"observations":[{"kind":"principal","observed_at":"2024-01-01T00:00:00Z","sid":"S-1-5-21-1","principal_kind":"user","display_name":"A"}]}'
    for i in range(2):
        (tmp_path / "land" / f"{i}.json").write_text(doc)
    q = ingest.to_tables(ingest.batches(spark, str(tmp_path / "land")), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/principals").count() == 1


@pytest.mark.parametrize("name", ["matrix"])
def test_plans_hold_no_cartesian_product_and_no_python(spark, name):
    reach, _ = access.matrix(estate(spark).with_())
    plan = reach._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan
    assert operations.facets(spark.createDataFrame([("a",)], "s string"), "s", ["a", "b"]).count() == 2


def test_paths_of_all_spellings_share_a_key(spark):
    from pyspark.sql import functions as F

    from reachbase.functions import keys

    spellings = ["\\\\Srv\\Share\\A\\b", "//srv/share/a/b/", "\\\\srv\\share\\\\a\\.\\b", "\\\\?\\UNC\\srv\\share\\a\\B\\", " \\\\SRV\\share\\a\\b "]
    rows = spark.createDataFrame([(s,) for s in spellings], "path string").select(keys.resource_key(F.col("path")))
    assert {r[0] for r in rows.collect()} == {"\\\\srv\\share\\a\\b"}


def test_moves_begin_a_new_version(spark):
    from datetime import datetime

    from reachbase.operators import history

    rows = [("f", "k", c, datetime(2024, 1, d), "s") for d, c in ((1, "a"), (2, "b"), (3, "a"))]
    log = history.versions(spark.createDataFrame(rows, "kind string, key string, container string, observed_at timestamp_ntz, state string"))
    assert [(r["container"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day) for r in log.orderBy("valid_from").collect()] == [("a", 1, 2), ("b", 2, 3), ("a", 3, None)]
