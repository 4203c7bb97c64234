"""Evidence, reproduction, filters and events in cases that the estate does not hold."""

import pytest

from reachbase.operators import changes, evidence


def test_digest_knows_no_order_and_no_repeats_and_every_record(spark):
    kind = "finding_key string, kind string, key string, record string"
    items = [("f", "ntfs_ace", "b", "2"), ("f", "ntfs_ace", "a", "1"), ("f", "ntfs_resource", "a", "3")]
    digest = lambda rows: [tuple(r) for r in evidence.digests(spark.createDataFrame(rows, kind)).collect()]
    assert digest(items) == digest(items[::-1] + items[:1]) and digest(items)[0][1] == 3
    assert digest(items) != digest(items[:2]) and digest(items) != digest([*items[:2], ("f", "ntfs_resource", "a", None)])
    assert digest([]) == []


def test_a_finding_comes_back_from_what_it_cites_alone(spark):
    entry = '{"trustee_key":"S-1-1-0","ace_type":"%s","access_mask":%d,"ace_flags":0,"order_index":%d}'
    full, read = 0x1F01FF, 0x1200A9
    findings = spark.createDataFrame([(k, "everyone_broad_access", s) for k, s in (("whole", "critical"), ("denied", "critical"), ("less", "critical"), ("none", "critical"), ("open", "critical"))], "finding_key string, rule string, severity string")
    cited = [("whole", "ntfs_ace", "1", entry % ("allow", full, 0)), ("denied", "ntfs_ace", "1", entry % ("allow", full, 1)), ("denied", "ntfs_ace", "0", entry % ("deny", full, 0)), ("less", "ntfs_ace", "1", entry % ("allow", read, 0)), ("open", "ntfs_resource", "r", '{"dacl_present":false}'), ("whole", "ntfs_resource", "r", '{"dacl_present":true}'), ("stranger", "ntfs_ace", "1", entry % ("allow", full, 0))]
    out = evidence.reproduced(findings, spark.createDataFrame(cited, "finding_key string, kind string, key string, record string"))
    assert {r.finding_key: (r.outcome, r.severity_now) for r in out.collect()} == {"whole": ("reproduced", "critical"), "denied": ("unreproduced", None), "less": ("changed_severity", "high"), "none": ("unreproduced", None), "open": ("reproduced", "critical")}


def test_filters_hold_all_that_lies_in_a_place_and_nothing_beside_it(spark):
    rows = spark.createDataFrame([(n, "open", "r", "high", "low", p, who, n) for n, (p, who) in enumerate([("\\\\fs1\\fin", "U"), ("\\\\fs1\\fin\\hr", None), ("\\\\fs1\\finance", "u"), ("\\\\fs11\\fin", "v")])] + [(9, None, "r", "high", "low", "\\\\fs1\\fin", "u", 9)], "n int, status string, rule string, severity string, confidence string, resource_key string, principal_key string, first_detected int")
    found = lambda **k: sorted(r.n for r in evidence.matching(rows, **k).collect())
    assert found() == [0, 1, 2, 3] and found(place="FS1") == [0, 1, 2] and found(place="fs1|fin") == [0, 1] and found(place="//fs1/fin/") == [0, 1]
    assert found(principal=" u ") == [0, 2] and found(severities=("low",)) == [] and found(statuses=("resolved",)) == []


def test_events_open_at_the_threshold_and_end_at_any(spark):
    rows = spark.createDataFrame([("a", "r", "critical", "opened"), ("b", "r", "high", "opened"), ("a", "r", "low", "resolved"), ("c", "r", "critical", "reaffirmed"), ("d", "r", None, "opened")], "finding_key string, resource_key string, severity string, outcome string").selectExpr("*", "1 AS at", "'d' AS digest")
    got = evidence.events(rows).collect()
    assert sorted((r.finding_key, r.ends) for r in got) == [("a", False), ("a", True)] and len({r.alert for r in got}) == 1
    assert {r.finding_key for r in evidence.events(rows, "high").collect()} == {"a", "b"}


def test_severities_are_admitted_by_rank(spark):
    rows = spark.createDataFrame([("critical", "added"), ("info", "added"), ("high", "removed"), (None, "added")], "severity string, action string")
    assert sorted(r.severity for r in changes.admitted(rows, "medium").collect()) == ["critical", "high"]
    assert [r.severity for r in changes.admitted(rows, "medium", ("added",)).collect()] == ["critical"]
    with pytest.raises(ValueError):
        changes.admitted(rows, "info", ())
