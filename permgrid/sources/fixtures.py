"""Entitlement inputs derived from the driver's TPC-H-style tables.

Every fixture is a projection (plus, where stated, a join) over a *whole*
driver table: no row subsets.  Each one has a DuckDB twin in
``permgrid.plans.oracle`` written independently in SQL; the driver compares them.

* users        <- customer       one user per customer, every 25th an admin
* memberships  <- customer       two groups per user: nat-<nation>, seg-<segment>
* workspaces   <- nation         ws0..ws24; grants also name ws25, ws26 (orphans)
* grants       <- orders x customer
* files        <- lineitem       the file inventory
* requests     <- events         every non-signup event is an access request
* mints        <- events         signup events are session (token) mints
* removals     <- events         error events are group removals
* import_rows  <- orders         an uploaded CSV, all text, with dirty values
* payloads     <- customer       identity-directory JSON group payloads
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Number of workspace ids used by grants, files and requests; workspaces exist
# for nation keys 0..24, so ids 25 and 26 are orphans.
WORKSPACE_IDS = 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _uid(c: Column | str) -> Column:
    return F.concat(F.lit("user_"), _s(c), F.lit("_x"))


def _email(c: Column | str, local: str = "user.") -> Column:
    return F.concat(F.lit(local), _s(c), F.lit("-x@example.com"))


def _vol_cols(k: Column) -> list[Column]:
    return [F.concat(F.lit("ws"), _s(k % WORKSPACE_IDS)).alias("workspace_id"),
            F.concat(F.lit("cat"), _s(k % 2)).alias("uc_catalog"),
            F.concat(F.lit("sch"), _s(k % 3)).alias("uc_schema"),
            F.concat(F.lit("vol"), _s(_vol_number(k))).alias("volume")]


def _vol_number(k: Column) -> Column:
    """Two thirds of all rows name one of four hot volumes, the others one of a thousand."""
    return F.when(k % 3 != 1, k % 4).otherwise(F.lit(4) + F.floor(k / 32) % 1000)


def _grantee(k: Column) -> Column:
    """Every other order names one of the 150 busiest customers, the rest its own."""
    return F.when(k % 2 == 0, F.col("o_custkey") % 150).otherwise(F.col("o_custkey"))


def _mm(ts: Column) -> Column:
    return F.lpad(_s(F.month(ts)), 2, "0")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(_uid("c_custkey").alias("user_id"),
                    F.col("c_name").alias("display_name"),
                    _email("c_custkey").alias("sso_email"),
                    (F.col("c_custkey") % 25 == 0).alias("is_admin"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 7 != 3)  # the others have no group
    nat = c.select(_uid("c_custkey").alias("user_id"),
                   F.concat(F.lit("nat-"), _s("c_nationkey")).alias("group_name"))
    seg = c.select(_uid("c_custkey").alias("user_id"),
                   F.concat(F.lit("seg-"), F.lower("c_mktsegment")).alias("group_name"))
    return nat.unionByName(seg)


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("ws"), _s("n_nationkey")).alias("workspace_id"),
                    F.col("n_name").alias("display_name"),
                    F.concat(F.lit("https://ws"), _s("n_nationkey"), F.lit(".example.com"))
                    .alias("host_url"))


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k = F.col("o_orderkey")
    is_group = ((k % 18) < 6) | (F.col("o_custkey") % 49 == 3)
    year = _s(F.year("o_orderdate"))
    vol = _vol_cols(k)
    ws_group = F.concat(F.lit("ws"), _s((F.col("c_nationkey") + k % 4) % WORKSPACE_IDS))
    return j.select(
        F.when(is_group, F.lit("GROUP")).otherwise(F.lit("USER")).alias("principal_type"),
        F.when(is_group, F.concat(F.lit("nat-"), _s("c_nationkey")))
         .when(k % 13 == 0, _email(_grantee(k)))
         .otherwise(_uid(_grantee(k))).alias("principal_id"),
        F.when(is_group, ws_group).otherwise(vol[0]).alias("workspace_id"),
        vol[1], vol[2], vol[3],
        F.when(k % 7 == 0, F.lit("/"))
         .when((k % 7).isin(1, 2), F.concat(F.lit("/y"), year, F.lit("/")))
         .when(k % 7 == 6, F.concat(F.lit("/y"), F.substr(year, F.lit(1), F.lit(3))))
         .otherwise(F.concat(F.lit("/y"), year, F.lit("/m"), _mm(F.col("o_orderdate")), F.lit("/")))
         .alias("folder_path"),
        F.when(k % 97 == 0, F.lit("WRITE")).when(F.col("o_orderstatus") == "F", F.lit("DOWNLOAD"))
         .otherwise(F.lit("READ")).alias("permission"),
        F.when(k % 11 == 0, F.lit("bootstrap")).otherwise(F.lit("user_0_x")).alias("granted_by"),
        F.col("o_orderdate").alias("granted_at"),
        F.when(k % 89 == 0, F.lit("SUBTREE")).when(k % 7 == 0, F.lit("VOLUME"))
         .when((k % 7).isin(1, 2, 6), F.lit("FOLDER_TREE"))
         .when((k % 7).isin(3, 4), F.lit("FOLDER")).alias("scope"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    year = _s(F.year("l_shipdate"))
    return li.select(
        *_vol_cols(k),
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("/y"), year, F.lit("/")))
         .otherwise(F.concat(F.lit("/y"), year, F.lit("/m"), _mm(F.col("l_shipdate")), F.lit("/")))
         .alias("folder"),
        F.concat(F.lit("f_"), _s(k), F.lit("_"), _s("l_linenumber"), F.lit("_"), _s("l_partkey"),
                 F.lit(".csv")).alias("name"),
        (F.col("l_quantity").cast("bigint") * 4096).alias("size"),
        F.col("l_shipdate").alias("modified"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_events(table(spark, sf_dir, "events"))


def requests_from_events(events: DataFrame) -> DataFrame:
    """Access requests of an events DataFrame (batch or one stream micro-batch)."""
    e = events.where(F.col("event_type") != "signup")
    k = F.col("event_id")
    year = _s(F.lit(1995) + k % 7)
    return e.select(
        k.alias("request_id"), "ts", F.when(k % 211 != 0, _uid("user_id")).alias("user_id"), *_vol_cols(k),
        F.when(k % 5 == 0, F.concat(F.lit("/y"), year, F.lit("/")))
         .otherwise(F.concat(F.lit("/y"), year, F.lit("/m"),
                             F.lpad(_s(F.lit(1) + k % 12), 2, "0"), F.lit("/"))).alias("folder"),
        F.when(F.col("event_type") == "purchase", F.lit("download"))
         .when(F.col("event_type") == "click", F.lit("preview"))
         .otherwise(F.lit("browse")).alias("action"),
    )


def mints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return e.select(F.when(F.col("event_id") % 211 != 0, _uid("user_id")).alias("user_id"), F.col("ts").alias("minted_at"),
                    F.col("event_id").alias("mint_id"))


def removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error event stands for removing the user from a directory group."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return e.select(F.when(F.col("event_id") % 211 != 0, _uid("user_id")).alias("user_id"), F.col("ts").alias("removed_at"),
                    F.col("event_id").alias("removal_id"))


def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uploaded grants CSV, as text, one row per order, in order-key order.

    New e-mails collide: with each other (one local part at several domains), with
    the ids of existing users, and with suffixed ids of other new e-mails.  Some names hold
    quotes, a comma and a line break.
    """
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cust, house = _s("o_custkey"), _s(F.floor(F.col("o_custkey") / 8))
    other = F.concat(F.lit("@d"), _s(F.floor(k / 30) % 4), F.lit(".example.com"))
    email = (F.when(k % 30 == 0, F.concat(F.lit("new."), house, other))
             .when(k % 30 == 10, F.concat(F.lit("user."), house, F.lit("-x"), other))
             .when(k % 30 == 20, F.concat(F.lit("user."), house, F.lit("-x-"), _s(F.lit(1) + k % 3), other))
             .otherwise(_email(F.col("o_custkey"))))
    vol = _vol_cols(k)
    return o.select(
        k.alias("row_no"),
        F.when(k % 70 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), email, F.lit(" "))).alias("email"),
        F.when(k % 45 == 0, F.concat(F.lit('Imported "'), cust, F.lit('",\nsecond line')))
         .otherwise(F.concat(F.lit("Imported "), cust)).alias("display_name"),
        vol[0], vol[1], vol[2],
        F.when(k % 110 == 0, F.lit(" ")).otherwise(F.concat(F.lit("vol"), _s(_vol_number(k)))).alias("volume"),
        F.concat(F.lit("/y"), _s(F.year("o_orderdate")), F.lit("/")).alias("folder_path"),
        F.when(F.col("o_orderstatus") == "F", F.lit(" download")).otherwise(F.lit("Read "))
         .alias("permission"),
        F.when(k % 50 == 0, F.lit("volume")).when(k % 50 == 10, F.lit("folder_tree"))
         .when(k % 50 == 20, F.lit("bogus")).when(k % 50 == 30, F.lit("")).alias("scope"),
        F.when(k % 40 == 0, F.lit("group")).when(k % 60 == 0, F.lit("robot")).alias("principal_type"),
        F.when(k % 80 == 0, F.lit("nat-1")).alias("principal_id"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity-directory answers per user: JSON ``{"groups":[{"display":..}]}``.

    Every 5th user lists the nation group twice; every 11th has an entry with
    an empty name; every 97th answer is not valid JSON; every 1000th user is in
    600 more groups.
    """
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    nat = F.concat(F.lit("nat-"), _s("c_nationkey"))
    seg = F.concat(F.lit("seg-"), F.lower("c_mktsegment"))
    entries = F.concat(
        F.array(F.struct(nat.alias("display"))),
        F.when(k % 11 == 0, F.array(F.struct(F.lit("").alias("display"))))
         .otherwise(F.array().cast("array<struct<display:string>>")),
        F.array(F.struct(seg.alias("display"))),
        F.when(k % 5 == 0, F.array(F.struct(nat.alias("display"))))
         .otherwise(F.array().cast("array<struct<display:string>>")),
        F.when(k % 1000 == 7, F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.struct(
            F.concat(F.lit("team-"), _s(i)).alias("display"))))
         .otherwise(F.array().cast("array<struct<display:string>>")),
    )
    body = F.to_json(F.struct(entries.alias("groups")))
    return c.select(_uid(k).alias("user_id"),
                    F.when(k % 97 == 0, F.lit("{groups: oops")).otherwise(body).alias("payload"))


def principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from permgrid.operators.principals import principal_table
    return principal_table(users(spark, sf_dir).select("user_id"), memberships(spark, sf_dir))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grant change requests, one per order, applied in order-key order.

    Keys follow the grants' rule but name the year folder, so some hit
    existing keys and some do not; the type is sometimes lower case or empty;
    the permission is sometimes NULL or empty (delete only in a bulk change).
    """
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k = F.col("o_orderkey")
    is_group = (k % 18) < 6
    vol = _vol_cols(k)
    ws_group = F.concat(F.lit("ws"), _s((F.col("c_nationkey") + k % 4) % WORKSPACE_IDS))
    return j.select(
        k.alias("seq"),
        F.when(k % 101 == 0, F.lit("robot"))
         .when(is_group, F.when(k % 4 == 0, F.lit("group")).otherwise(F.lit("GROUP")))
         .when(k % 9 == 0, F.lit("")).otherwise(F.lit("USER")).alias("principal_type"),
        F.when(k % 103 == 0, F.lit("o'neil")).when(k % 107 == 0, F.lit(" "))
         .when(is_group, F.concat(F.lit("nat-"), _s("c_nationkey")))
         .when(k % 13 == 0, _email(_grantee(k)))
         .otherwise(_uid(_grantee(k))).alias("principal_id"),
        F.when(is_group, ws_group).otherwise(vol[0]).alias("workspace_id"),
        vol[1], vol[2], vol[3],
        F.concat(F.lit("/y"), _s(F.year("o_orderdate")), F.lit("/")).alias("folder_path"),
        F.when(k % 4 == 1, F.lit(None).cast("string")).when(k % 4 == 2, F.lit(""))
         .when(F.col("o_orderpriority").startswith("1"), F.lit("DOWNLOAD"))
         .otherwise(F.lit("READ")).alias("permission"),
        F.when(k % 5 == 0, F.lit("volume")).when(k % 5 == 1, F.lit("FOLDER_TREE"))
         .when(k % 5 == 3, F.lit("folder")).alias("scope"),
    )


def workspace_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspaces to add, one per nation in key order: padded ids, blank ids,
    ids that exist, repeats inside the batch and a quote in a name."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.cast("long").alias("seq"),
        F.when(k % 6 == 5, F.lit("  "))
         .otherwise(F.concat(F.lit(" ws"), _s(F.lit(20) + k % 15), F.lit(" "))).alias("workspace_id"),
        F.when(k % 9 == 4, F.concat("n_name", F.lit("'s"))).otherwise(F.col("n_name")).alias("display_name"),
        F.concat(F.lit("https://new"), _s(k), F.lit(".example.com")).alias("host_url"))


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One login per user seen in events; some users are not provisioned."""
    e = table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    return e.select(
        F.when(u % 7 == 3, F.concat(F.lit("guest."), _s(u), F.lit("@example.com")))
         .otherwise(_email(u)).alias("email"),
        F.when(u % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("Guest "), _s(u))).alias("preferred_name"))


def admin_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admins to seed, one per nation: even nations name existing users, some
    e-mails and names are padded or blank."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        F.when(k % 8 == 5, F.lit("  ")).when(k % 2 == 0, F.concat(F.lit(" "), _email(k))).otherwise(
            F.concat(F.lit("admin."), _s("n_regionkey"), F.lit("@example.com "))).alias("email"),
        F.when(k % 5 == 1, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("n_name"))).alias("name"))


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by each download request: the files of one order, of which only
    those in the request's own folder exist there, and a name that no folder has."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    r = e.select(F.col("event_id").alias("request_id"), F.col("event_id").alias("o"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.concat(
        F.lit("f_"), _s("l_orderkey"), F.lit("_"), _s("l_linenumber"), F.lit("_"), _s("l_partkey"), F.lit(".csv")).alias("name"))
    named = r.join(li, "o").select("request_id", "name")
    return named.unionByName(r.select("request_id", F.lit("none.csv").alias("name")))


def facet_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter requests on the grants listing, one per event: every subset of the five filters occurs, some
    values are empty (no filter) and some name nothing."""
    e = table(spark, sf_dir, "events")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    k = F.col("event_id")
    return e.join(c, "user_id", "left").select(
        k.alias("selection_id"),
        F.when(k % 2 == 0, F.when(k % 11 == 0, F.lit("")).otherwise(F.col("c_name"))).alias("display_name"),
        F.when(F.floor(k / 2) % 2 == 0, F.concat(F.lit("NATION_"), _s(k % 26))).alias("workspace_name"),
        F.when(F.floor(k / 4) % 2 == 0, F.concat(F.lit("cat"), _s(k % 3))).alias("uc_catalog"),
        F.when(F.floor(k / 8) % 2 == 0, F.concat(F.lit("vol"), _s(k % 9))).alias("volume"),
        F.when(F.floor(k / 16) % 2 == 0, F.when(k % 3 == 0, F.lit("READ")).otherwise(F.lit("DOWNLOAD"))).alias("permission"))
