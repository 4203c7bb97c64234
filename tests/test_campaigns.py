"""Campaigns, affirmations, drift and lookups in cases that the estate does not hold."""

from pyspark.sql import functions as F

from reachbase.functions import keys
from reachbase.operators import access, campaigns, intake, lookup
from reachbase.plans.estate import Estate

U, G, H = "S-1-5-21-9-9-9-1", "S-1-5-21-9-9-9-2", "S-1-5-21-9-9-9-3"


def estate(spark, aces=(), share_aces=(), people=((U, "user", "ann"), (G, "group", "staff")), edges=(), resources=None) -> Estate:
    """Two shares whose names begin alike, on a server whose name another begins with."""
    paths = resources or [("\\\\fs1\\fin", 0), ("\\\\fs1\\fin\\hr", 1), ("\\\\fs1\\fin\\hr-archive", 1), ("\\\\fs1\\finance", 0), ("\\\\fs11\\fin", 0)]
    rows = [(p, None, p.split("\\")[2], f"{p.split(chr(92))[2]}|{p.split(chr(92))[3]}", d, True, False, None) for p, d in paths]
    made = spark.createDataFrame
    return Estate(
        principals=made([(*p, True) for p in people], "principal_key string, kind string, name string, enabled boolean"),
        edges=made([(g, m, "ad_group") for g, m in edges], "group_key string, member_key string, edge_kind string"),
        servers=made([("fs1",), ("fs11",)], "server_key string"),
        shares=made([("fs1|fin", "fs1", "fin"), ("fs1|finance", "fs1", "finance"), ("fs11|fin", "fs11", "fin")], "share_key string, server_key string, name string"),
        share_aces=made([(s, t, k, p, f"{s}|{t}|{k}|{p}") for s, t, k, p in share_aces], "share_key string, trustee_key string, ace_type string, permission string, ace_key string"),
        resources=made(rows, "resource_key string, parent_key string, server_key string, share_key string, depth int, dacl_present boolean, dacl_protected boolean, owner_key string"),
        ntfs_aces=made([(r, t, k, m, f, i, f"{r}|{t}|{k}|{m}|{f}|{i}") for i, (r, t, k, m, f) in enumerate(aces)], "resource_key string, trustee_key string, ace_type string, access_mask long, ace_flags int, order_index int, ace_key string"),
    )


def scopes(spark, *rows):
    return spark.createDataFrame(rows, "campaign string, focus string, scope_kind string, scope_key string")


def picked(rows):
    return sorted((r.campaign, r.target_key) for r in rows.collect())


READ = 0x120089


def test_a_tree_holds_itself_and_what_lies_below_and_no_sibling(spark):
    e = estate(spark, [(p, U, "allow", READ, 0) for p in ("\\\\fs1\\fin", "\\\\fs1\\fin\\hr", "\\\\fs1\\fin\\hr-archive", "\\\\fs1\\finance", "\\\\fs11\\fin")], [("fs1|fin", U, "allow", "read")])
    ask = scopes(spark, ("a", "resource", "directory_tree", "//FS1/fin/HR/"), ("b", "resource", "directory_tree", "\\\\fs1\\fin"), ("c", "resource", "server", "FS1"), ("d", "resource", "share", "fs1|fin"), ("d", "resource", "server", "fs11"), ("d", "resource", "directory_tree", "\\\\fs1\\fin\\hr"))
    assert picked(campaigns.selected(e, ask)) == sorted(
        [("a", "\\\\fs1\\fin\\hr"), ("b", "\\\\fs1\\fin"), ("b", "\\\\fs1\\fin\\hr"), ("b", "\\\\fs1\\fin\\hr-archive")]
        + [("c", t) for t in ("\\\\fs1\\fin", "\\\\fs1\\fin\\hr", "\\\\fs1\\fin\\hr-archive", "\\\\fs1\\finance", "fs1|fin")]
        + [("d", t) for t in ("\\\\fs1\\fin", "\\\\fs1\\fin\\hr", "\\\\fs1\\fin\\hr-archive", "\\\\fs11\\fin", "fs1|fin")]
    )


def test_a_principal_is_named_itself_and_scopes_of_another_focus_give_nothing(spark):
    e = estate(spark, [("\\\\fs1\\fin", G, "allow", READ, 0), ("\\\\fs1\\fin", U, "allow", READ, 0)], [("fs1|fin", U, "allow", "read")], edges=[(G, U)])
    ask = scopes(spark, ("p", "principal", "principal", U), ("q", "principal", "server", "fs1"), ("r", "resource", "principal", U))
    assert picked(campaigns.selected(e, ask)) == [("p", "\\\\fs1\\fin"), ("p", "fs1|fin")]


def test_reasons_are_tried_in_order_and_options_let_entries_in(spark):
    rows = spark.createDataFrame([("c", keys.EVERYONE, "deny", True), ("c", keys.EVERYONE, "deny", False), ("c", U, "deny", False), ("c", "not an identifier", "allow", False), ("c", U, "allow", False)], "campaign string, principal_key string, ace_type string, inherited boolean")
    count = lambda options: {r.reason: r.n for r in campaigns.tally(campaigns.with_reason(rows, options)).collect()}
    assert count(campaigns.Options()) == {"inherited": 1, "builtin_trustee": 1, "deny": 1, "included": 2}
    assert count(campaigns.Options(inherited=True)) == {"builtin_trustee": 2, "deny": 1, "included": 2}
    assert count(campaigns.Options(True, True, True)) == {"included": 5}


def test_an_item_is_as_certain_as_its_weakest_entry_and_its_digest_has_no_order(spark):
    def built(order):
        entries = [("c", "resource", "r", U, k, "allow", "0x1", False, c, None) for k, c in order]
        rows = spark.createDataFrame(entries, "campaign string, target_kind string, target_key string, principal_key string, entry_key string, ace_type string, rights string, inherited boolean, certainty string, reason string")
        return campaigns.items(rows, spark.createDataFrame([(H, "other")], "principal_key string, name string")).collect()

    one, two = built([("a", "observed"), ("b", "inferred")]), built([("b", "inferred"), ("a", "observed")])
    assert one == two and (one[0].certainty, one[0].complex, one[0].grants, one[0].principal_name) == ("inferred", True, 2, None)
    assert built([("a", "backfilled"), ("b", "observed")])[0].certainty == "backfilled"
    assert built([("a", "observed")])[0].certainty == "observed"


def test_the_newest_assignment_that_covers_an_item_holds_it_and_revoked_ones_count_for_nobody(spark):
    e = estate(spark)
    items = spark.createDataFrame([("c", "resource", "\\\\fs1\\fin\\hr", U), ("c", "resource", "\\\\fs11\\fin", U), ("c", "share", "fs1|finance", G), ("x", "resource", "\\\\fs1\\fin", U)], "campaign string, target_kind string, target_key string, principal_key string")
    asks = spark.createDataFrame(
        [("all", "c", None, None, 1, "r1", 9, False), ("fs1", "c", "server", "FS1", 2, "r2", 5, False), ("about", "c", "principal", G, 3, "r2", 4, True), ("tree", "c", "directory_tree", "\\\\fs1\\fin\\hr", 2, "r1", 3, False)],
        "assignment_id string, campaign string, scope_kind string, scope_key string, assigned_at int, reviewer string, due_at int, revoked boolean",
    )
    rows = campaigns.assigned(e, items, asks)
    assert {(r.target_key, r.assignment_id) for r in rows.collect()} == {("\\\\fs1\\fin\\hr", "tree"), ("\\\\fs11\\fin", "all"), ("fs1|finance", "about"), ("\\\\fs1\\fin", None)}
    running = spark.createDataFrame([("c", "active"), ("x", "draft")], "campaign string, status string")
    queue = campaigns.queue(rows.withColumn("decided", F.col("target_key") == "\\\\fs11\\fin"), asks, running).collect()
    assert [tuple(r) for r in queue] == [("r1", "c", 2, 1, 3)]


def test_claims_are_refused_in_order_and_the_newest_counts(spark):
    claims = spark.createDataFrame([("new", "d", 5), ("old", "d", 5), ("moved", "d", 5), ("loose", "d", 5), ("gone", "d", 5), ("same", "x", 4), ("same", "d", 5), ("nothing", None, 5)], "key string, digest string, observed_at int")
    stored = spark.createDataFrame([("old", None), ("moved", "e"), ("loose", "d"), ("gone", "d"), ("same", "d"), ("nothing", "d")], "key string, digest string")
    log = spark.createDataFrame([("r", k, None, s, 1, 2, e) for k, s, e in (("loose", "s", 3), ("gone", None, None), ("same", "s", None), ("same", "t", 1), ("nothing", "s", None))] + [("a", "e1", "same", "s", 1, 2, None), ("a", "e2", "same", None, 1, 2, None), ("a", "e3", "gone", "s", 1, 2, None)], "kind string, key string, container string, state string, valid_from int, last_seen_at int, valid_to int")
    out = intake.affirmations(claims, stored, log, "r")
    assert {r.key: r.outcome for r in out.collect()} == {"new": "unknown_object", "old": "no_stored_digest", "moved": "digest_mismatch", "loose": "untracked", "gone": "absent", "same": "applied", "nothing": "digest_mismatch"}
    seen = {(r.kind, r.key, r.state): r.last_seen_at for r in intake.confirm(log, out, "r", "a").collect()}
    assert seen == {("r", "loose", "s"): 2, ("r", "gone", None): 2, ("r", "same", "s"): 5, ("r", "same", "t"): 2, ("r", "nothing", "s"): 2, ("a", "e1", "s"): 5, ("a", "e2", None): 2, ("a", "e3", "s"): 2}


def test_deltas_since_the_last_reconciliation_of_the_same_scope(spark):
    runs = spark.createDataFrame([(1, "full", 10), (2, "delta", 20), (3, "delta", 20), (4, "delta", None), (5, "full", 30), (6, "delta", 40)], "run_id int, mode string, completed_at int")
    where = spark.createDataFrame([(n, "server", "fs1", n in (1, 5)) for n in range(1, 7)] + [(6, "server", "fs11", True)], "run_id int, scope_kind string, scope_key string, reconciled boolean")
    fixed = spark.createDataFrame([(5, "server", "fs1", 7, 2)], "run_id int, scope_kind string, scope_key string, marked_absent long, revived long")
    assert sorted(tuple(r) for r in intake.drift(where, runs, fixed).collect()) == [(1, "server", "fs1", 0, 0, 0), (5, "server", "fs1", 7, 2, 2), (6, "server", "fs11", 0, 0, 1)]


def test_starts_replay_only_what_is_the_same(spark):
    kind = "run_id int, source string, mode string, job string, started_at string, scopes array<string>"
    stored = spark.createDataFrame([(1, "s", "full", None, "t", ["a", "b"]), (2, "s", "full", None, "t", ["a"])], kind)
    sent = spark.createDataFrame([(1, "s", "full", None, "t", ["b", "a", "b"]), (2, "s", "full", "null", "t", ["a"]), (3, "s", "full", None, "t", None), (3, "s", "full", None, "t", []), (4, "s", "full", None, "t", ["a"]), (4, "s", "delta", None, "t", ["a"])], kind)
    assert {r.run_id: r.outcome for r in intake.started(stored, sent).collect()} == {1: "replayed", 2: "conflict", 3: "created", 4: "conflict"}
    rows = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", None, 10)], "name string, n int, run_id int")
    assert len({r.d for r in rows.select(intake.state_digest(rows).alias("d")).collect()}) == 2


def test_shapes_of_what_people_type(spark):
    texts = [("s-1-5-18 ", "sid"), ("\\\\FS1", "server"), ("//fs1/", "server"), ("\\\\fs1\\fin", "path"), ("fin", "name"), ("S-1-", "name"), (" ", None), (None, None), ("\\\\", None)]
    rows = spark.createDataFrame(texts, "text string, want string").select("text", "want", lookup.shape(F.col("text")).alias("got")).collect()
    assert [(r.text, r.got) for r in rows] == texts


def test_search_knows_no_wildcards_and_says_what_it_cut(spark):
    e = estate(spark, people=[(f"{U}{n:02}", "user", f"50%_off {n:02}") for n in range(12)] + [(H, "user", "50 off"), (G, "group", None)])
    ask = spark.createDataFrame([(1, "50%_OFF"), (2, "\\\\fs1"), (3, "\\\\fs1\\fin"), (4, H.lower()), (5, "5_")], "search_no int, text string")
    rows = lookup.search(e, ask).collect()
    assert {(r.search_no, r.category, r.truncated) for r in rows} == {(1, "identities", True), (2, "servers", False), (2, "shares", False), (2, "directories", False), (3, "shares", False), (3, "directories", False), (4, "identities", False)}
    assert [r.seat for r in rows if r.search_no == 1] == list(range(1, 11))
    assert {r.key for r in rows if r.search_no == 2 and r.category == "servers"} == {"fs1", "fs11"}
    assert {r.key for r in rows if r.search_no == 3} == {"fs1|fin", "fs1|finance", "\\\\fs1\\fin", "\\\\fs1\\fin\\hr", "\\\\fs1\\fin\\hr-archive", "\\\\fs1\\finance"}


def test_a_group_reaches_what_names_it_or_what_it_holds(spark):
    e = estate(spark, [("\\\\fs1\\fin", G, "allow", READ, 0), ("\\\\fs1\\finance", H, "allow", READ, 0), ("\\\\fs1\\fin\\hr", keys.EVERYONE, "allow", READ, 0), ("\\\\fs11\\fin", U, "allow", READ, 0)], [("fs1|fin", G, "allow", "read"), ("fs1|finance", U, "allow", "full")], people=[(U, "user", "ann"), (G, "group", "staff"), (H, "group", "all")], edges=[(G, U), (H, G)])
    groups = spark.createDataFrame([(G,)], "group_key string")
    rows = {r.resource_key: (r.ntfs_rights, r.remote, r.names_group) for r in access.group_impact(e, groups).collect()}
    assert rows == {"\\\\fs1\\fin": (READ, READ, True), "\\\\fs1\\finance": (READ, 0, False), "\\\\fs1\\fin\\hr": (READ, READ, True)}
    assert [tuple(r) for r in access.membership_impact(e, groups).collect()] == [(G, 1, 1, 1)]
    shares = {r.share_key: (r.root_key, r.remote, r.verdict) for r in access.shares_reached(e, groups.withColumnRenamed("group_key", "principal_key")).collect()}
    assert shares == {"fs1|fin": ("\\\\fs1\\fin", READ, "granted")}
