"""Access in the cases that the projected estate does not hold, against plain evaluation."""

import random

import pytest

from reachbase.functions import keys
from reachbase.operators import access, acl, causality, changes, closing, risk, simulate
from reachbase.plans.estate import Estate

PRINCIPALS = "principal_key string, kind string, name string, enabled boolean"
EDGES = "group_key string, member_key string, edge_kind string"
RESOURCES = "resource_key string, parent_key string, server_key string, share_key string, depth int, dacl_present boolean, dacl_protected boolean, owner_key string"
ACES = "resource_key string, trustee_key string, ace_type string, access_mask long, ace_flags int, order_index int, ace_key string"
SHARES = "share_key string, trustee_key string, ace_type string, permission string, ace_key string"


def estate(spark, aces, users=("u1", "u2", "u3"), edges=(), shares=(("s", keys.EVERYONE, "allow", "full"),), owner=None, open_=()):
    """Lists by resource: {resource: [(trustee, type, mask)]}; resources in ``open_`` have no list at all."""
    groups = sorted({g for g, _ in edges})
    people = [(u, "user", u, True) for u in users] + [(g, "group", g, None) for g in groups]
    rows = [(r, t, kind, mask, 0, i, f"{r}:{i}") for r, entries in aces.items() for i, (t, kind, mask) in enumerate(entries)]
    places = [(r, None, "srv", "s", 0, r not in open_, False, owner) for r in {*aces, *open_}]
    frame = spark.createDataFrame
    return Estate(
        frame(people, PRINCIPALS), frame([(g, m, "ad_group") for g, m in edges], EDGES), frame([("srv",)], "server_key string"), frame([("s", "srv", "s")], "share_key string, server_key string, name string"),
        frame([(*x, "|".join(x)) for x in shares], SHARES), frame(places, RESOURCES), frame(rows, ACES),
    )


def rights(rows):
    return {(r["principal_key"], r["resource_key"]): r for r in rows.collect()}


FULL, READ = 0x1F01FF, 0x120089
DOMAIN = "S-1-5-21-7-7-7-"


def test_who_can_reach_a_list_of_everyone_and_one_that_is_missing(spark):
    e = estate(spark, {"a": [(keys.EVERYONE, "allow", FULL)], "b": [("u1", "allow", READ)]}, open_=("c",))
    got = rights(access.principals_on(e, e.resources))
    assert set(got) == {(u, r) for u in ("u1", "u2", "u3") for r in ("a", "c")} | {("u1", "b")}
    assert got["u2", "a"]["remote"] == got["u3", "c"]["remote"] == FULL and got["u1", "b"]["remote"] == READ


def test_owner_rights_network_and_interactive(spark):
    lists = {"a": [(keys.NETWORK, "deny", 1), (keys.INTERACTIVE, "allow", 2), (keys.EVERYONE, "allow", 1)], "b": [(keys.OWNER_RIGHTS, "allow", READ)], "c": []}
    e = estate(spark, lists, edges=[("owners", "u1")], owner="owners")
    pairs = spark.createDataFrame([(u, r) for u in ("u1", "u2") for r in lists], "principal_key string, resource_key string")
    got = rights(access.pair_access(e, pairs))
    assert (got["u2", "a"]["local"], got["u2", "a"]["remote"]) == (3, 0)
    assert got["u1", "b"]["remote"] == READ and not got["u1", "b"]["owner"] and got["u2", "b"]["remote"] == 0
    assert got["u1", "c"]["remote"] == access.OWNER_BITS and got["u1", "c"]["owner"] and got["u2", "c"]["remote"] == 0


def test_entries_behind_the_last_considered_do_not_count(spark, monkeypatch):
    monkeypatch.setattr(acl, "MAX_ENTRIES", 3)
    e = estate(spark, {"a": [("x1", "allow", 1), ("x2", "allow", 1), ("x3", "allow", 1), ("u1", "allow", FULL)], "b": [("u1", "allow", READ)]})
    _, members = access.classes(access.tokens(e), e.ntfs_aces.select("trustee_key"))
    assert {r["resource_key"]: r["granted"] for r in access.ntfs_rights(members, e.ntfs_aces).collect()} == {"b": READ}
    pairs = spark.createDataFrame([("u1", "a"), ("u1", "b")], "principal_key string, resource_key string")
    got = rights(access.pair_access(e, pairs))
    assert (got["u1", "a"]["remote"], got["u1", "a"]["certainty"], got["u1", "a"]["verdict"]) == (0, "uncertain", "indeterminate") and got["u1", "b"]["certainty"] == "certain"


def test_certainty_says_which_way_an_answer_may_be_wrong(spark):
    ghost = DOMAIN + "404"
    e = estate(spark, {"a": [("u1", "allow", READ), (ghost, "allow", FULL)], "b": [("u1", "allow", READ)]})
    pairs = spark.createDataFrame([(u, r) for u in ("u1", "u2") for r in ("a", "b")], "principal_key string, resource_key string")
    say = lambda rows: {k: (r["certainty"], r["verdict"]) for k, r in rights(rows).items()}
    assert say(access.pair_access(e, pairs)) == {("u1", "a"): ("at_least", "granted"), ("u2", "a"): ("at_least", "indeterminate"), ("u1", "b"): ("certain", "granted"), ("u2", "b"): ("certain", "no_grant")}
    unread = e.with_(share_aces=e.share_aces.limit(0))
    assert say(access.pair_access(unread, pairs))["u1", "a"] == ("uncertain", "granted") and say(access.pair_access(unread, pairs))["u1", "b"] == ("at_most", "granted")


def walk(entries, gone=None, held=None):
    granted = denied = 0
    for i, (trustee, kind, mask) in enumerate(entries):
        if i == gone or (held is not None and trustee not in held):
            continue
        if kind == "allow":
            granted |= mask & ~denied
        else:
            denied |= mask & ~granted
    return granted


def test_removals_equal_evaluating_anew(spark):
    draw = random.Random(4)
    names = ["u1", "g1", "g2", "g3", keys.EVERYONE, "u2"]
    lists = {f"r{k}": [(draw.choice(names), draw.choice(["allow", "allow", "deny"]), draw.randrange(1, 64)) for _ in range(draw.randrange(1, 8))] for k in range(40)}
    edges = [("g1", "u1"), ("g2", "u1"), ("g3", "g1"), ("g3", "g2"), ("g2", "u2")]
    e = estate(spark, lists, users=("u1", "u2"), edges=edges)
    pairs = spark.createDataFrame([("u1", r) for r in lists], "principal_key string, resource_key string")
    got = {(r["resource_key"], r["kind"], r["edge_key"]): r for r in causality.measured_removals(e, pairs).collect()}

    def token(gone=None):
        held, todo = {"u1", keys.EVERYONE, keys.AUTHENTICATED}, ["u1"]
        while todo:
            at = todo.pop()
            for g, m in edges:
                if m == at and (g, m) != gone and g not in held:
                    held.add(g)
                    todo.append(g)
        return held

    for r, entries in lists.items():
        before = walk(entries, held=token())
        for i, (trustee, _, _) in enumerate(entries):
            if trustee in token():
                after = walk(entries, i, token())
                row = got[r, "ntfs_ace", f"{r}:{i}"]
                assert (row["rights_removed"], row["rights_added"], row["rights_after"]) == (before & ~after, after & ~before, after)
        for edge in edges[:4]:
            row = got.get((r, "membership", f"{edge[0]}->{edge[1]}|*"))
            after = walk(entries, held=token(edge))
            assert (row["rights_after"], row["revokes_all"]) == (after, before != 0 and after == 0) if row else before == after


@pytest.mark.parametrize("keep", [True, False])
def test_protection_overlay(spark, keep):
    e = estate(spark, {"\\\\s\\a": [("u1", "allow", READ)]})
    child = spark.createDataFrame([("\\\\s\\a\\b", "\\\\s\\a", "srv", "s", 1, True, False, None)], RESOURCES)
    rows = spark.createDataFrame([("\\\\s\\a\\b", "u2", "allow", 1, 0, 0, "own"), ("\\\\s\\a\\b", "u1", "allow", READ, 19, 1, "down"), ("\\\\s\\a", "u3", "allow", 4, 3, 1, "handed")], ACES)
    e = e.with_(resources=e.resources.unionByName(child), ntfs_aces=e.ntfs_aces.unionByName(rows))
    change = lambda protected: simulate.with_protection(e, spark.createDataFrame([("\\\\s\\a\\b", protected, keep)], "resource_key string, protected boolean, keep boolean"))
    held = lambda x: sorted((r["trustee_key"], r["ace_flags"], r["order_index"]) for r in x.ntfs_aces.where("resource_key = '\\\\\\\\s\\\\a\\\\b'").collect())
    assert held(change(True)) == ([("u1", 3, 1), ("u2", 0, 0)] if keep else [("u2", 0, 0)])
    assert held(change(False)) == [("u2", 0, 0), ("u3", 19, 1)]


def test_order_is_material_where_the_normal_form_moves(spark):
    e = estate(spark, {"a": [("u1", "allow", 1), ("u2", "deny", 2)], "b": [("u1", "allow", 1), ("u2", "deny", 2)], "c": [("u1", "allow", 1)]})
    turned = e.ntfs_aces.selectExpr("resource_key", "trustee_key", "ace_type", "access_mask", "ace_flags", "CASE resource_key WHEN 'a' THEN 5 - order_index ELSE order_index + 3 END AS order_index", "ace_key")
    assert {r["resource_key"]: r["material"] for r in changes.order_changes(e.resources, e.ntfs_aces, turned).collect()} == {"a": True, "b": False, "c": False}


def test_rules_must_hang_on_what_is_selected(spark):
    with pytest.raises(ValueError, match="smb_share"):
        closing.rule_table(spark, (closing.Rule("smb", "server", "smb_ace", "via_parent", "share_key", "smb_share"),))


def test_evaluating_what_a_run_concerns_equals_a_full_pass(spark):
    lists = {f"r{k}": [((keys.EVERYONE, DOMAIN + "513", "u1")[k % 3], "allow", FULL if k % 2 else READ)] for k in range(9)}
    before = estate(spark, lists, edges=[(DOMAIN + "513", "u1")])
    after = estate(spark, {**lists, "r0": [("u2", "allow", 1)], "r4": [(keys.EVERYONE, "allow", READ)]}, edges=[(DOMAIN + "513", "u1")])
    whole = lambda e: {tuple(r) for r in risk.broad_access(e).collect()}
    changed = spark.createDataFrame([("ntfs_resource", "r0"), ("ntfs_resource", "r4")], "kind string, key string")
    touched = risk.resources_affected(after, changed)
    part = after.with_(ntfs_aces=after.ntfs_aces.join(touched, "resource_key", "left_semi"), resources=after.resources.join(touched, "resource_key", "left_semi"))
    old = before.with_(ntfs_aces=before.ntfs_aces.join(touched, "resource_key", "left_anti"), resources=before.resources.join(touched, "resource_key", "left_anti"))
    assert whole(part) | whole(old) == whole(after) != whole(before)
