"""Access decisions: which grants cover a folder, the strongest permission,
and the action gate.

Plan shape (all equi-joins, without a residual):

    requests --distinct question--> (user, VOL_KEY, folder)
        --join lengths of the volume's tree grants-->
        --explode folder probes--> (.., match_kind, match_key)
        --join principals on user_id-->
        --join collapsed grants on (principal, VOL_KEY, match_kind, match_key)-->
        --max(rank) per question--> left join back to requests

A tree grant covers a folder that starts with its path, at a '/' or not.  A folder is probed with its
prefixes of the lengths that tree grants of its volume have, so a probe meets covering grants only: no
prefix that many folders share is a key unless a grant names it.

Pre-aggregation: grants are collapsed to their strongest permission per
(principal, volume, kind, key) and requests to distinct questions, so a
user asking the same folder a million times costs one probe.  A hot group or
volume shows up as a skewed join key; AQE's skew join splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.functions.cover import grant_match_keys, permission_rank, rank_to_permission
from permgrid.functions.paths import folder_probes
from permgrid.operators.principals import principal_table
from permgrid.schemas import VOL_KEY

PRINCIPAL = ["principal_type", "principal_id"]
MATCH = ["match_kind", "match_key"]
REPEATS = 10_000


def grant_match_rows(grants: DataFrame, *extra: str) -> DataFrame:
    """Grants as equi-join keys: principal, VOL_KEY, match kind and key, rank."""
    return (grants.select(*PRINCIPAL, *VOL_KEY, *grant_match_keys(),
                          permission_rank().alias("rank"), *extra)
            .where(F.col("match_key").isNotNull()))


def collapse_grants(grants: DataFrame) -> DataFrame:
    """One row per distinct match key with the strongest permission (partial
    aggregation happens map-side before the shuffle)."""
    return (grant_match_rows(grants)
            .groupBy(*PRINCIPAL, *VOL_KEY, *MATCH)
            .agg(F.max("rank").alias("rank")))


def prefix_lengths(rules: DataFrame) -> DataFrame:
    """(VOL_KEY, lengths): the lengths of the tree grants' paths in each volume, from match rows;
    at most one per character of the longest path."""
    tree = rules.where(F.col("match_kind") == "T").select(*VOL_KEY, F.length("match_key").alias("_n")).distinct()
    return tree.groupBy(*VOL_KEY).agg(F.sort_array(F.collect_list("_n")).alias("lengths"))


def probe_rows(df: DataFrame, rules: DataFrame, folder: str = "folder") -> DataFrame:
    """Add the folder probes of ``folder`` as rows; ``rules`` are the match rows they shall meet."""
    probes = df.join(prefix_lengths(rules), VOL_KEY, "left")
    return probes.select(*df.columns, F.inline(folder_probes(folder, "lengths")))


def request_principals(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """Principals of the users that appear in ``requests``."""
    ids = requests.select("user_id").distinct()
    return principal_table(ids, memberships.join(ids, "user_id", "left_semi"))


def question_ranks(questions: DataFrame, principals: DataFrame, grants: DataFrame) -> DataFrame:
    """``questions`` = distinct (user_id, VOL_KEY, folder) ->
    (user_id, VOL_KEY, folder, rank) for questions with a covering grant."""
    q = probe_rows(questions, grant_match_rows(grants))
    qp = q.join(principals, "user_id")
    g = collapse_grants(grants)
    cov = qp.join(g, [*PRINCIPAL, *VOL_KEY, *MATCH])
    return cov.groupBy("user_id", *VOL_KEY, "folder").agg(F.max("rank").alias("rank"))


def effective_permission(requests: DataFrame, memberships: DataFrame, grants: DataFrame,
                         principals: DataFrame | None = None) -> DataFrame:
    """J3 for every request: adds ``effective`` in {DOWNLOAD, READ, DENIED}."""
    if principals is None:
        principals = request_principals(requests, memberships)
    questions = requests.select("user_id", *VOL_KEY, "folder").distinct()
    ranks = question_ranks(questions, principals, grants)
    out = requests.join(ranks, ["user_id", *VOL_KEY, "folder"], "left")
    return (out.withColumn("effective", F.coalesce(rank_to_permission("rank"), F.lit("DENIED")))
            .drop("rank"))


def action_allowed(effective: str = "effective", action: str = "action") -> F.Column:
    """browse / list / preview need any covering grant; download needs DOWNLOAD."""
    e, a = F.col(effective), F.col(action)
    return F.coalesce((e == "DOWNLOAD") | ((e == "READ") & (a != "download")), F.lit(False))


def action_gate(requests: DataFrame, memberships: DataFrame, grants: DataFrame) -> DataFrame:
    d = effective_permission(requests, memberships, grants)
    return d.select("request_id", "action", "effective", action_allowed().alias("allowed"))


def strongest_permission(requests: DataFrame, memberships: DataFrame, grants: DataFrame) -> DataFrame:
    """A1 per distinct question that has at least one covering grant."""
    principals = request_principals(requests, memberships)
    questions = requests.select("user_id", *VOL_KEY, "folder").distinct()
    r = question_ranks(questions, principals, grants)
    return r.select("user_id", *VOL_KEY, "folder", rank_to_permission("rank").alias("effective"))


def repeated_rules(rules: DataFrame) -> DataFrame:
    """(columns of ``rules``, n): equal rows once with their number, in pieces of at most ``REPEATS``."""
    said = rules.groupBy(*rules.columns).agg(F.count(F.lit(1)).alias("_n"))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / REPEATS)))
    return said.withColumn("_i", pieces).select(*rules.columns, F.least(F.lit(REPEATS), F.col("_n") - F.col("_i") * REPEATS).cast("int").alias("n"))


def covering_grants(requests: DataFrame, memberships: DataFrame, grants: DataFrame) -> DataFrame:
    """Every (request, grant row) pair where the grant covers the request
    (scope_cover), grant duplicates included.

    Grants that say the same meet a request once, with their number, and are repeated after the last shuffle."""
    principals = request_principals(requests, memberships)
    g = repeated_rules(grant_match_rows(grants, "folder_path", "scope", "permission").drop("rank"))
    q = probe_rows(requests.select("request_id", "user_id", *VOL_KEY, "folder"), g)
    qp = q.join(principals, "user_id")
    cov = qp.join(g, [*PRINCIPAL, *VOL_KEY, *MATCH]).select("request_id", *PRINCIPAL, "folder_path", "scope", "permission", "n")
    # a stated number of partitions: adaptive execution would merge them by their small size
    spread = cov.repartition(int(cov.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cov.columns)
    return spread.withColumn("n", F.explode(F.array_repeat(F.lit(True), F.col("n")))).drop("n")
