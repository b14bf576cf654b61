"""Change operators and directory payload parsing on literal rows."""

import json

import pytest

from permgrid.operators.changes import RejectedChange, add_workspaces, bulk_change, delete_grants, seed_users, update_grants
from permgrid.operators.principals import names_beyond, scan_memberships
from permgrid.schemas import GRANTS, USERS, WORKSPACES

KEY = ("USER", "u1", "w", "c", "s", "v", "/a/")


def _g(spark, rows):
    return spark.createDataFrame(rows, GRANTS)


def _changes(spark, rows):
    return spark.createDataFrame(rows, "seq long, principal_type string, principal_id string, workspace_id string, "
                                       "uc_catalog string, uc_schema string, volume string, folder_path string, "
                                       "permission string, scope string")


def test_update_last_wins_and_no_match(spark):
    g = _g(spark, [(*KEY, "READ", "x", None, "FOLDER"), (*KEY, "READ", "y", None, None)])
    ch = _changes(spark, [(1, "user", "u1", "w", "c", "s", "v", "/a/", "DOWNLOAD", "folder"),
                          (2, "USER", "u1", "w", "c", "s", "v", "/a/", "READ", "FOLDER_TREE"),
                          (3, "USER", "u9", "w", "c", "s", "v", "/a/", "DOWNLOAD", None)])
    users = spark.createDataFrame([], USERS)
    nxt, rej = update_grants(g, ch, users, "admin", "2026-01-01 00:00:00")
    rows = nxt.collect()
    assert len(rows) == 2 and all(r.permission == "READ" and r.scope == "FOLDER_TREE" for r in rows)
    assert rej.count() == 0


def test_bulk_and_delete(spark):
    g = _g(spark, [(*KEY, "READ", "x", None, "FOLDER"), ("USER", "u2", "w", "c", "s", "v", None, "READ", "x", None, None)])
    ch = _changes(spark, [(1, None, "u1", "w", "c", "s", "v", "/a/", None, None),
                          (2, "", "u2", "w", "c", "s", "v", None, "READ", None)])
    after, applied = bulk_change(g, ch, "admin")
    nxt = after.collect()
    assert applied.first()[0] == 2
    # the NULL-folder grant is not deleted (SQL equality), the NULL-folder change is inserted
    from collections import Counter
    assert Counter((r.principal_id, r.folder_path, r.scope) for r in nxt) == \
        Counter([("u2", None, "FOLDER"), ("u2", None, None)])
    kept, rejected = delete_grants(g, ch)
    assert kept.count() == 1
    assert [(r.seq, r.reason) for r in rejected.collect()] == [(2, "missing_field")]
    after, applied = bulk_change(g, ch.limit(0), "admin")
    assert after.count() == 2 and applied.first()[0] == 0


def test_a_quote_fails_the_whole_bulk_change(spark):
    g = _g(spark, [(*KEY, "READ", "x", None, "FOLDER")])
    ch = _changes(spark, [(1, "USER", "u1", "w", "c", "s", "v", "/a/", None, None),
                          (2, "USER", "o'neil", "w", "c", "s", "v", "/a/", "READ", None),
                          (3, "robot", "u2", "w", "c", "s", "v", "/a/", "READ", None)])
    with pytest.raises(RejectedChange):
        bulk_change(g, ch, "admin")
    _, rejected = delete_grants(g, ch)
    assert sorted((r.seq, r.reason) for r in rejected.collect()) == [(2, "quote_in_principal"), (3, "bad_principal_type")]


def test_seed_users_strips_and_skips_blank(spark):
    users = spark.createDataFrame([("kid", "Kim", "kim@x.com", False)], USERS)
    admins = spark.createDataFrame([(" kim@x.com ", "K"), ("  ", "Nobody"), ("a.b@x.com", " "), (None, "None")], "email string, name string")
    rows = sorted((r.user_id, r.display_name, r.sso_email, r.is_admin) for r in seed_users(users, admins).collect())
    assert rows == [("a_b", "a.b@x.com", "a.b@x.com", True), ("kid", "Kim", "kim@x.com", False)]


def test_add_workspaces_first_wins(spark):
    ws = spark.createDataFrame([("ws1", "One", "h")], WORKSPACES)
    cand = spark.createDataFrame([(1, " ws2 ", "Two", "h"), (2, "ws2", "Again", "h"), (3, "ws1", "Dup", "h"),
                                  (4, "  ", "Blank", "h"), (5, "ws3", "It's", "h")],
                                 "seq long, workspace_id string, display_name string, host_url string")
    nxt, d = add_workspaces(ws, cand)
    assert sorted(r.workspace_id for r in nxt.collect()) == ["ws1", "ws2"]
    assert {r.seq: r.reason for r in d.collect()} == {1: None, 2: "exists", 3: "exists", 4: "missing_id",
                                                     5: "quote_in_field"}


def test_group_payloads(spark):
    many = json.dumps({"groups": [{"display": f"g{i}"} for i in range(501)]})
    rows = [("u1", json.dumps({"groups": []})), ("u2", "{not json"), ("u3", json.dumps(
        {"groups": [{"display": "b"}, {"display": ""}, {"display": "a"}, {"display": "b"}, {}]})), ("u4", many),
        ("u5", None)]
    m = scan_memberships(spark.createDataFrame(rows, "user_id string, payload string")).collect()
    by = {}
    for r in m:
        by.setdefault(r.user_id, []).append((r.position, r.group_name))
    assert "u1" not in by and "u2" not in by and "u5" not in by
    assert sorted(by["u3"]) == [(1, "b"), (2, "a")]
    assert len(by["u4"]) == 501 and max(by["u4"])[1] == "g500"  # no cap unless asked for
    df = spark.createDataFrame([("u4", many)], "user_id string, payload string")
    assert scan_memberships(df, cap=500).count() == 500
    assert df.select(names_beyond(500)).first()[0] == 1


def test_expand_to_users_splits_exactly(spark):
    from permgrid.operators.skew import expand_to_users
    principals = spark.createDataFrame(
        [(f"u{i}", "GROUP", "big") for i in range(300)] + [(f"u{i}", "GROUP", "small") for i in range(3)]
        + [("u1", "USER", "u1")], "user_id string, principal_type string, principal_id string")
    rows = spark.createDataFrame([("GROUP", "big", f"/f{j}/") for j in range(7)] + [("GROUP", "small", "/s/"),
                                 ("USER", "u1", "/u/"), ("GROUP", "none", "/n/")],
                                 "principal_type string, principal_id string, folder string")
    plain = rows.join(principals, ["principal_type", "principal_id"])
    split = expand_to_users(rows, principals, rows_per_task=7)
    assert split.count() == 7 * 300 + 3 + 1
    assert plain.exceptAll(split.select(*plain.columns)).count() == 0
    assert split.select(*plain.columns).exceptAll(plain).count() == 0
