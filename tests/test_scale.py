"""What must not grow: rows and joins that larger tables would multiply."""

from pyspark.sql import functions as F

from reachbase.functions import keys
from reachbase.operators import access, acl, campaigns, causality, changes, closing, evidence, risk, simulate
from tests.test_access import READ, estate


def joins(rows):
    return [x for x in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]


def test_one_principal_of_a_class_is_asked_for_shares_and_resources(spark, monkeypatch):
    users = [f"u{i}" for i in range(40)]
    lists = {"\\\\srv\\s": [("u7", "deny", 1), ("g", "allow", READ)], "b": [(keys.EVERYONE, "allow", READ)]}
    e = estate(spark, lists, users=users, edges=[("g", u) for u in users[:30]], shares=[("srv|s", "g", "allow", "full"), ("srv|s", "u35", "allow", "read")])
    asked, plain = [], access.pair_access
    monkeypatch.setattr(access, "pair_access", lambda estate, pairs: asked.append(pairs.count()) or plain(estate, pairs))
    e = e.with_(resources=e.resources.replace("s", "srv|s", ["share_key"]))
    got = {r["principal_key"]: r["remote"] for r in access.shares_reached(e, e.principals.where("kind = 'user'")).collect()}
    assert set(got) == {*users[:30], "u35"}
    assert asked == [3]
    assert got["u1"] == READ and got["u7"] == READ & ~1 and got["u35"] == 0
    on_b = {r["principal_key"] for r in access.principals_on(e, e.resources.where("resource_key = 'b'")).collect()}
    assert on_b == set(users) and asked[1] <= 3


def test_entries_meet_tokens_in_the_row_of_their_pair(spark):
    e = estate(spark, {"a": [("g", "allow", READ)]}, edges=[("g", "u1")])
    pairs = spark.createDataFrame([("u1", "a")], "principal_key string, resource_key string")
    rows = access.pair_access(e, pairs)
    assert [r["remote"] for r in rows.collect()] == [READ]
    assert not [x for x in joins(rows) if "principal_key" in x and "trustee_key" in x]


def test_entries_are_not_multiplied_by_their_bits_and_one_of_equal_members_is_walked(spark, monkeypatch):
    users = [f"u{i}" for i in range(20)]
    e = estate(spark, {"a": [("h", "allow", READ), ("g", "deny", 1)]}, users=users, edges=[("g", u) for u in users] + [("h", "g")])
    walked, plain = [], causality.expand
    monkeypatch.setattr(causality, "expand", lambda edges, roots, *more: walked.append(roots.count()) or plain(edges, roots, *more))
    lost = {tuple(r) for r in causality.surviving(e.edges, e.principals.where("kind = 'user'").select("principal_key")).collect()}
    assert lost == {x for u in users for x in ((u, "g", u, "g"), (u, "g", u, "h"), (u, "h", "g", "h"))} and walked == [1]
    pairs = spark.createDataFrame([("u1", "a")], "principal_key string, resource_key string")
    rows = causality.entry_removals(*causality.evidence(e, pairs))
    assert {r["edge_key"]: (r["rights_removed"], r["rights_added"]) for r in rows.where("kind = 'ntfs_ace'").collect()} == {"a:0": (READ, 0), "a:1": (0, 0)}
    assert "sequence(" not in rows._jdf.queryExecution().analyzed().toString()


def crowded(spark):
    """Twenty classes that differ by a trustee of their own, which only list a names."""
    users = [f"u{i:02}" for i in range(20)]
    lists = {"a": [("u03", "deny", 1), ("g", "allow", READ)] + [(u, "allow", 2) for u in users], "b": [("h", "deny", 8), (keys.EVERYONE, "allow", READ)]}
    return users, estate(spark, lists, users=users, edges=[("g", u) for u in users[:12]] + [("h", u) for u in users[10:]])


def test_lists_are_evaluated_for_bases_and_opened_to_the_same_rights(spark, monkeypatch):
    users, e = crowded(spark)
    b = {u: READ & ~8 if u >= "u10" else READ for u in users}
    a = {u: (READ if u < "u12" else 0) & (~1 if u == "u03" else -1) | 2 for u in users}
    for few in (0, 8, 100):
        monkeypatch.setattr(access, "FEW", few)
        rows, principals = access.matrix(e)
        got = {(r["principal_key"], r["resource_key"]): r["rights"] for r in rows.join(principals, "class_key").collect()}
        assert got == {(u, "a"): a[u] for u in users} | {(u, "b"): b[u] for u in users}
    monkeypatch.setattr(access, "FEW", 8)
    shared, single, _, _ = access.matrix_by_base(e)
    assert shared.where("resource_key = 'b'").count() == 3 and {r["resource_key"] for r in single.collect()} == {"a"}


def test_reach_is_counted_by_bases(spark, monkeypatch):
    users, e = crowded(spark)
    monkeypatch.setattr(access, "opened", None)  # no pair of class and list is made
    got = {r["resource_key"]: (r["principals"], r["holding"]) for r in access.reach_counts(e, READ).collect()}
    assert got == {"a": (20, 11), "b": (20, 10)}


def test_before_and_after_meet_where_the_list_lies(spark):
    users, e = crowded(spark)
    gone = e.ntfs_aces.where(f"resource_key = 'b' AND trustee_key = '{keys.EVERYONE}'")
    rows = simulate.entry_impact(e, simulate.with_entries(e, removed=gone.select("ace_key")), gone.select("resource_key"))
    assert not [x for x in joins(rows) if "FullOuter" in x]
    got = sorted((r["before"], r["after"], r["direction"]) for r in rows.collect())
    assert got == [(READ & ~8, 0, "lose")] * 10 + [(READ, 0, "lose")] * 10


def test_removals_are_measured_in_the_row_of_their_pair(spark):
    e = estate(spark, {"a": [("h", "allow", READ), ("g", "deny", 1)]}, users=["u1"], edges=[("g", "u1"), ("h", "g")])
    rows = causality.measured_removals(e, spark.createDataFrame([("u1", "a")], "principal_key string, resource_key string"))
    got = {(r["kind"], r["edge_key"]): (r["rights_removed"], r["revokes_all"]) for r in rows.collect()}
    assert got == {("ntfs_ace", "a:0"): (READ, True), ("ntfs_ace", "a:1"): (0, False), ("share_ace", f"s|{keys.EVERYONE}|allow|full"): (READ, True), ("membership", "g->u1|*"): (READ, True), ("membership", "h->g|*"): (READ, True)}
    assert not [x for x in joins(rows) if "trustee_key" in x]


def test_changes_of_a_plan_meet_only_what_their_action_asks_for(spark):
    e = estate(spark, {"a": [("u1", "allow", 1)]}, users=["u1", "u2"], edges=[("u2", "u1")])
    kinds = "change_no string, action string, target string, member string, value long"
    plan = [("1", "remove_entry", "a:0", None, None), ("2", "remove_entry", "a:0", None, None), ("3", "modify_entry", "a:0", None, 1), ("4", "modify_entry", "x", None, 1), ("5", "add_entry", "a:0", "a", 1), ("6", "add_entry", "n", "a", 1), ("7", "add_entry", "n", "b", 1)]
    plan += [("8", "add_member", "u2", "u1", None), ("9", "remove_member", "u1", "u2", None), ("10", "add_member", "u2", "x", None), ("11", "other", "u2", "u1", None), ("12", None, None, None, None)]
    rows = simulate.applicability(e, spark.createDataFrame(plan, kinds))
    assert {r["change_no"]: r["outcome"] for r in rows.collect()} == {
        "1": "applied", "2": "repeated", "3": "mask_unchanged", "4": "target_unknown", "5": "already_present", "6": "applied", "7": "target_unknown", "8": "already_present", "9": "already_absent", "10": "target_unknown", "11": None, "12": None,
    }
    assert "md5" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_what_was_selected_and_seen_meets_in_one_grouping(spark):
    scopes = spark.createDataFrame([("s", "ntfs", "directory_tree", "\\\\srv\\s\\a", None, True)], "scope_no string, collector string, scope_kind string, scope_key string, domains array<string>, complete boolean")
    objects = [("ntfs_resource", k, "srv", "s", k, None, None, None) for k in ("\\\\srv\\s\\a", "\\\\srv\\s\\a\\b", "\\\\srv\\s\\ab")] + [("ntfs_ace", "e1", None, None, "\\\\srv\\s\\a\\b", None, None, None), ("ntfs_ace", "e1", None, None, "\\\\srv\\s\\a\\b", None, None, None), ("ntfs_ace", "e2", None, None, "\\\\srv\\s\\a", None, None, None)]
    objects = spark.createDataFrame(objects, "kind string, key string, " + ", ".join(f"{c} string" for c in closing.COLUMNS))
    observed = spark.createDataFrame([("s", "ntfs_ace", "e2"), ("s", "ntfs_resource", "\\\\srv\\s\\a")], "scope_no string, kind string, key string")
    rows = closing.closed(scopes, objects, observed)
    assert sorted(tuple(r) for r in rows.collect()) == [("s", "ntfs_ace", "e1"), ("s", "ntfs_resource", "\\\\srv\\s\\a\\b")]
    assert not [x for x in joins(rows) if "LeftAnti" in x]


def test_sets_of_groups_are_counted_where_the_list_lies(spark):
    users = [f"u{i}" for i in range(6)]
    edges = [("g", u) for u in users[:4]] + [("h", u) for u in users[2:]] + [("k", u) for u in users[3:5]]
    e = estate(spark, {"a": [("g", "allow", 1), ("h", "allow", 1), ("k", "allow", 1), ("g", "allow", 2)], "b": [("g", "allow", 1), ("h", "deny", 1)]}, users=users, edges=edges)
    rows = risk.redundant_paths(e)
    assert [tuple(r) for r in rows.collect()] == [("a", 3, 3)]
    assert [tuple(r) for r in risk.redundant_paths(e, 3).collect()] == [("a", 1, 3)] and sorted(tuple(r) for r in risk.redundant_paths(e, 1).collect()) == [("a", 6, 3), ("b", 4, 1)]
    grouped = [x.split("]")[0] for x in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [resource_key" in x]
    assert grouped and not [x for x in grouped if "set" in x]


def test_both_sides_of_a_list_are_gathered_at_once(spark):
    e = estate(spark, {"a": [("u1", "allow", 1), ("u2", "deny", 2)], "b": [("u1", "allow", 1), ("u2", "deny", 2)], "c": [("u1", "allow", 1)]})
    place = "CASE WHEN resource_key = 'a' AND trustee_key = 'u1' THEN NULL WHEN resource_key = 'b' THEN 7 - order_index WHEN resource_key = 'c' THEN 4 END AS order_index"
    after = e.ntfs_aces.selectExpr("resource_key", "trustee_key", "ace_type", "access_mask", "ace_flags", place, "ace_key").unionByName(e.ntfs_aces.limit(1).withColumn("resource_key", F.lit("new")))
    rows = changes.order_changes(e.resources, e.ntfs_aces, after)
    assert {r["resource_key"]: r["material"] for r in rows.collect()} == {"a": True, "b": True, "c": False}
    assert len(joins(rows)) == 1


def test_assigned_items_are_not_joined_to_themselves(spark):
    e = estate(spark, {"a": [("u1", "allow", 1)]})
    items = spark.createDataFrame([("c", "resource", "a", "u1", 3)], "campaign string, target_kind string, target_key string, principal_key string, grants int")
    asks = spark.createDataFrame([("one", "c", None, None, 1)], "assignment_id string, campaign string, scope_kind string, scope_key string, assigned_at int")
    rows = campaigns.assigned(e, items, asks)
    assert [tuple(r) for r in rows.collect()] == [("c", "resource", "a", "u1", 3, "one")]
    assert len([x for x in joins(rows) if "Inner" in x]) <= 2


def test_cited_evidence_is_gathered_once(spark):
    cited = spark.createDataFrame([("f", "ntfs_resource", "a", '{"dacl_present":false}')], "finding_key string, kind string, key string, record string")
    rows = evidence.reproduced(spark.createDataFrame([("f", "everyone_broad_access", "critical")], "finding_key string, rule string, severity string"), cited)
    assert [tuple(r) for r in rows.collect()] == [("f", "reproduced", "critical")]
    assert "Aggregate [finding_key" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_held_by_kind_and_not_by_pair(spark, monkeypatch):
    monkeypatch.setattr(access, "tokens", None)
    users = [f"u{i}" for i in range(20)]
    e = estate(spark, {"a": [("h", "allow", READ), ("u7", "deny", 1)], "b": [(keys.EVERYONE, "allow", READ)]}, users=users, edges=[("g", u) for u in users] + [("h", "g"), ("g", "h"), ("k", "x")])
    of, held = access.tokens_by_kind(e, e.principals.select("principal_key"))
    assert of.count() == 20 and [{(x["sid"], x["origin"]) for x in r["token"]} for r in held.collect()] == [{("g", "membership"), ("h", "membership"), (keys.EVERYONE, "assumed"), (keys.AUTHENTICATED, "assumed")}]
    pairs = spark.createDataFrame([("u1", "a"), ("u7", "a"), ("g", "b"), ("nobody", "b"), ("u7", "b")], "principal_key string, resource_key string")
    assert {(r["principal_key"], r["resource_key"]): r["remote"] for r in access.pair_access(e, pairs).collect()} == {("u1", "a"): READ, ("u7", "a"): READ, ("g", "b"): 0, ("nobody", "b"): 0, ("u7", "b"): READ}
    got = {(r["principal_key"], r["kind"], r["edge_key"]): r["rights_removed"] for r in causality.measured_removals(e, pairs.where("resource_key = 'a'")).collect()}
    assert got["u1", "ntfs_ace", "a:0"] == got["u7", "membership", "g->u7|*"] == got["u7", "membership", "h->g|*"] == READ and got["u7", "ntfs_ace", "a:1"] == 0


def test_entries_are_not_shuffled_to_find_lists_that_are_too_long(spark, monkeypatch):
    monkeypatch.setattr(acl, "MAX_ENTRIES", 1)
    e = estate(spark, {"a": [("u1", "allow", READ), ("u2", "allow", READ)], "b": [("u1", "allow", READ)]})
    rows = acl.considered(e.ntfs_aces)
    assert sorted(r["ace_key"] for r in rows.collect()) == ["a:0", "b:0"]
    assert len(joins(rows)) == 2 and all("strategy=broadcast" in x for x in joins(rows))


def test_impact_of_groups_is_told_where_the_list_lies(spark, monkeypatch):
    for name in ("candidates", "pair_access"):
        monkeypatch.setattr(access, name, None)  # no pair of group and list is written or shuffled
    monkeypatch.setattr(acl, "MAX_ENTRIES", 2)
    lists = {"a": [("h", "allow", READ), ("g", "deny", 1)], "b": [(keys.EVERYONE, "allow", READ), ("g", "allow", 2)], "c": [("u1", "allow", READ)], "d": [("u1", "allow", 1), ("u2", "allow", 1), ("g", "allow", READ)]}
    e = estate(spark, lists, edges=[("g", "u1"), ("h", "g")], open_=("o",), shares=[("s", keys.EVERYONE, "allow", "full"), ("s", "h", "allow", "read")])
    rows = access.group_impact(e, e.principals.where("kind = 'group'").select(F.col("principal_key").alias("group_key")))
    got = {(r["group_key"], r["resource_key"]): (r["remote"], r["verdict"], r["names_group"]) for r in rows.collect()}
    full = 0x1F01FF
    assert got == {
        ("g", "a"): (READ, "granted", True), ("g", "b"): (READ | 2, "granted", True), ("g", "d"): (0, "indeterminate", True), ("g", "o"): (full, "granted", False),
        ("h", "a"): (READ, "granted", True), ("h", "b"): (READ, "granted", True), ("h", "o"): (full, "granted", True),
    }


def test_two_versions_of_lists_meet_in_the_row_of_their_pair(spark):
    e = estate(spark, {"a": [("u1", "allow", READ), ("u2", "deny", 1), (keys.EVERYONE, "allow", 1)]}, open_=("o",))
    pairs = spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u2", "o"), ("nobody", "a")], "principal_key string, resource_key string")
    rows = access.remote_under(e, {"before": e.ntfs_aces.where("order_index = 0"), "after": e.ntfs_aces.where("order_index > 0")}, pairs)
    assert {(r["principal_key"], r["resource_key"]): (r["before"], r["after"]) for r in rows.collect()} == {("u1", "a"): (READ, 1), ("u2", "a"): (0, 0), ("u2", "o"): (0x1F01FF, 0x1F01FF), ("nobody", "a"): (0, 0)}


def test_rows_of_classes_are_copied_and_not_worked_out(spark, monkeypatch):
    users, e = crowded(spark)
    b = {u: READ & ~8 if u >= "u10" else READ for u in users}
    a = {u: (READ if u < "u12" else 0) & (~1 if u == "u03" else -1) | 2 for u in users}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for seats, gathered, bytes_ in ((62, 10_000, threshold), (1, 10_000, threshold), (62, 2, "-1")):
        monkeypatch.setattr(access, "SEATS", seats)
        monkeypatch.setattr(access, "GATHERED", gathered)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bytes_)
        try:
            rows, principals = access.matrix(e)
            got = {(r["principal_key"], r["resource_key"]): r["rights"] for r in rows.join(principals, "class_key").collect()}
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        assert got == {(u, "a"): a[u] for u in users} | {(u, "b"): b[u] for u in users}
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if "exists(" in x or "Window [" in x and "subset" in x]


def test_classes_are_told_by_kinds(spark, monkeypatch):
    users, e = crowded(spark)
    e = e.with_(edges=e.edges.union(spark.createDataFrame([("k", "u05", "ad_group"), ("u05", "u06", "ad_group")], e.edges.schema)))
    some = e.principals.where("name < 'u07'").select("principal_key")
    for trustees in (e.ntfs_aces.select("trustee_key"), spark.createDataFrame([(x,) for x in ("g", "k", "u05", "u11", None)], "trustee_key string")):
        for only in (None, some):
            held = access.tokens(e) if only is None else access.tokens(e).join(only, "principal_key", "left_semi")
            wanted = [sorted(map(tuple, x.collect())) for x in access.classes(held, trustees)]
            with monkeypatch.context() as m:
                m.setattr(access, "tokens", None)  # no token is opened for each principal
                assert [sorted(map(tuple, x.collect())) for x in access.estate_classes(e, trustees, only)] == wanted
