"""Cover test: literal cases and the probe equi-join against a plain Python
restatement of the rule on random folders."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from permgrid.functions.cover import scope_cover
from permgrid.operators.authorise import covering_grants, effective_permission


def covers(scope, grant_folder, folder):
    s = scope or "FOLDER"
    if s == "VOLUME":
        return True
    if s == "FOLDER_TREE":
        return grant_folder is not None and folder.startswith(grant_folder)
    return folder == grant_folder


LITERAL = [
    ("FOLDER_TREE", "/flu", "/flushot/", True),
    ("FOLDER_TREE", "/a/", "/a/b/", True),
    ("FOLDER_TREE", "/a_b/", "/axb/", False),
    ("FOLDER_TREE", "/a%/", "/abc/", False),
    ("VOLUME", "/", "/anything/deep/", True),
    ("VOLUME", None, "/x/", True),
    ("FOLDER", "/a/", "/a/b/", False),
    ("FOLDER", "/a/", "/a/", True),
    (None, "/a/", "/a/", True),
    ("", "/a/", "/a/b/", False),
    ("volume", "/a/", "/a/b/", False),
    ("BOGUS", "/a/", "/a/", True),
    ("FOLDER_TREE", "", "/a/", True),
    ("FOLDER_TREE", None, "/a/", False),
    ("FOLDER_TREE", "y1", "y12/", True),
]


def _grant(scope, folder, perm="READ", pid="u1"):
    return Row(principal_type="USER", principal_id=pid, workspace_id="w", uc_catalog="c",
               uc_schema="s", volume="v", folder_path=folder, permission=perm, scope=scope)


GRANT_SCHEMA = ("principal_type string, principal_id string, workspace_id string, uc_catalog string, "
                "uc_schema string, volume string, folder_path string, permission string, scope string")
REQ_SCHEMA = ("request_id long, user_id string, workspace_id string, uc_catalog string, uc_schema string, "
              "volume string, folder string, action string")


def test_row_level_cover(spark):
    rows = [(s, g, f) for s, g, f, _ in LITERAL]
    df = spark.createDataFrame(rows, "scope string, g string, f string")
    got = [r.c for r in df.select(scope_cover(F.col("scope"), F.col("g"), F.col("f")).alias("c")).collect()]
    assert got == [c for *_, c in LITERAL]


def test_equi_join_cover_literal(spark):
    grants = spark.createDataFrame([_grant(s, g) for s, g, _, _ in LITERAL], GRANT_SCHEMA)
    for i, (s, g, f, want) in enumerate(LITERAL):
        one = grants.limit(0).union(spark.createDataFrame([_grant(s, g)], GRANT_SCHEMA))
        req = spark.createDataFrame([(1, "u1", "w", "c", "s", "v", f, "browse")], REQ_SCHEMA)
        mem = spark.createDataFrame([], "user_id string, group_name string")
        got = effective_permission(req, mem, one).collect()[0].effective
        assert (got != "DENIED") == want, (s, g, f)


def _random_folder(rng):
    depth = rng.randint(0, 3)
    parts = [rng.choice(["a", "ab", "b", "a_b", "y199", "y1995"]) for _ in range(depth)]
    lead = "" if rng.random() < 0.1 else "/"
    trail = "" if rng.random() < 0.2 else "/"
    body = "/".join(parts)
    return (lead + body + trail) if body else "/"


def test_equi_join_matches_python_rule(spark):
    rng = random.Random(7)
    scopes = ["VOLUME", "FOLDER_TREE", "FOLDER", None, "", "odd"]
    grants = []
    for i in range(120):
        g = _random_folder(rng)
        if rng.random() < 0.3:
            g = g[: rng.randint(0, len(g))]
        grants.append(_grant(rng.choice(scopes), g, rng.choice(["READ", "DOWNLOAD", None]),
                             rng.choice(["u1", "g1"])).asDict())
    for g in grants:
        if g["principal_id"] == "g1":
            g["principal_type"] = "GROUP"
    folders = sorted({_random_folder(rng) for _ in range(80)})
    reqs = [(i, "u1", "w", "c", "s", "v", f, "browse") for i, f in enumerate(folders)]
    gdf = spark.createDataFrame([Row(**g) for g in grants], GRANT_SCHEMA)
    rdf = spark.createDataFrame(reqs, REQ_SCHEMA)
    mem = spark.createDataFrame([("u1", "g1")], "user_id string, group_name string")
    got = {r.request_id: r.effective for r in effective_permission(rdf, mem, gdf).collect()}
    pairs = {(r.request_id, r.folder_path, r.scope, r.permission)
             for r in covering_grants(rdf, mem, gdf).collect()}
    for i, f in enumerate(folders):
        cov = [g for g in grants if covers(g["scope"], g["folder_path"], f)]
        want = "DENIED" if not cov else ("DOWNLOAD" if any(g["permission"] == "DOWNLOAD" for g in cov) else "READ")
        assert got[i] == want, (f, cov)
        assert {(i, g["folder_path"], g["scope"], g["permission"]) for g in cov} == \
            {p for p in pairs if p[0] == i}


def test_no_key_holds_folders_that_no_grant_names(spark):
    """Raw prefixes below one parent meet the folders they cover, not all folders of the parent."""
    from permgrid.operators.authorise import MATCH, grant_match_rows, probe_rows
    from permgrid.schemas import VOL_KEY
    grants = spark.createDataFrame([_grant("FOLDER_TREE", f"/p{i:03d}") for i in range(200)], GRANT_SCHEMA)
    folders = spark.createDataFrame([("w", "c", "s", "v", f"/p{i:03d}x{j}/") for i in range(200) for j in range(20)], "workspace_id string, "
                                    "uc_catalog string, uc_schema string, volume string, folder string")
    rules = grant_match_rows(grants)
    met = probe_rows(folders, rules).join(rules, [*VOL_KEY, *MATCH])
    assert met.count() == 4000  # every pair that meets is a cover
    assert met.groupBy("match_key").count().agg(F.max("count")).first()[0] == 20


def test_grants_that_say_the_same_meet_a_request_once(spark, monkeypatch):
    """Equal grants are one row with a number before the join, in pieces, and as many rows after it."""
    from permgrid.operators import authorise as A
    monkeypatch.setattr(A, "REPEATS", 3)
    said = [_grant("VOLUME", None, "READ", "u1")] * 7 + [_grant("VOLUME", None, "DOWNLOAD", "u1")] * 3 + [_grant(None, "/a/", None, "u1")] * 2
    gdf = spark.createDataFrame(said, GRANT_SCHEMA)
    rules = A.repeated_rules(A.grant_match_rows(gdf, "folder_path", "scope", "permission").drop("rank"))
    assert sorted((r.permission or "", r.n) for r in rules.collect()) == [("", 2), ("DOWNLOAD", 3), ("READ", 1), ("READ", 3), ("READ", 3)]
    rdf = spark.createDataFrame([(1, "u1", "w", "c", "s", "v", "/a/", "browse"), (2, "u1", "w", "c", "s", "v", "/b/", "browse"),
                                 (3, None, "w", "c", "s", "v", "/a/", "browse")], REQ_SCHEMA)
    got = covering_grants(rdf, spark.createDataFrame([], "user_id string, group_name string"), gdf)
    assert got.columns == ["request_id", "principal_type", "principal_id", "folder_path", "scope", "permission"]
    of = lambda i, path: [(i, None, "VOLUME", "READ")] * 7 + [(i, None, "VOLUME", "DOWNLOAD")] * 3 + [(i, "/a/", None, None)] * (2 if path else 0)
    rows = [(r.request_id, r.folder_path, r.scope, r.permission) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(of(1, True) + of(2, False), key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(array_repeat") < plan.index("Join ") < plan.rindex("Aggregate [")
