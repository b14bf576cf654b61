"""The entitlement of principals and folders, kept up to date under grant changes.

For every principal, inventory folder and rank the *support* is the number of grants that cover the folder
with that rank; a principal's strongest rank on a folder is the largest one with support.  A change of grants
becomes plus and minus rows (how often each cover rule came or went), these are joined to the folders they
cover, and the support is added up: no other folder is looked at, and a removed grant uncovers whatever
weaker grant is left.

``MaintainedMatrix`` keeps grants, folders and support in buckets of volumes (``sources.buckets``).  A change
reads and rewrites only the buckets its rows name.  Beside a bucket's support stands a fingerprint of the
grants it was made from.  A change that finds another one there, since an earlier run was lost between the two
writes, makes that bucket's support anew from the grants.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permgrid.operators.authorise import MATCH, PRINCIPAL, grant_match_rows, probe_rows
from permgrid.operators.skew import key_counts, split_join
from permgrid.schemas import GRANTS, VOL_KEY
from permgrid.session import saved
from permgrid.sources.buckets import BUCKETS, bucket_of, buckets_named, read_buckets, read_notes, replace_buckets, write_buckets

FOLDER_KEY = [*VOL_KEY, "folder"]
RULE = [*PRINCIPAL, *VOL_KEY, *MATCH, "rank"]
STATE_KEY = [*PRINCIPAL, *FOLDER_KEY, "rank"]
_TEXT = T.StringType()
FOLDERS = T.StructType([T.StructField(c, _TEXT) for c in FOLDER_KEY])
SUPPORT = T.StructType([*(T.StructField(c, _TEXT) for c in [*PRINCIPAL, *FOLDER_KEY]),
                        T.StructField("rank", T.IntegerType()), T.StructField("n", T.LongType())])


def cover_rules(grants: DataFrame) -> DataFrame:
    """(cover rule, n): how many grants say the same."""
    return grant_match_rows(grants).groupBy(*RULE).agg(F.count(F.lit(1)).alias("n"))


def grant_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(cover rule, n): what ``after`` has more (or, below zero, fewer) of than ``before``."""
    gone = cover_rules(before).withColumn("n", -F.col("n"))
    return cover_rules(after).unionByName(gone).groupBy(*RULE).agg(F.sum("n").alias("n")).where("n <> 0")


def support(folders: DataFrame, rules: DataFrame) -> DataFrame:
    """(principal, folder key, rank, n): the rules' counts added up on the folders they cover."""
    on = [*VOL_KEY, *MATCH]
    rules = saved(rules)
    probes = saved(probe_rows(folders.select(*FOLDER_KEY), rules))
    expected = (key_counts(probes, on, "_f").join(key_counts(rules, on, "_g"), on)
                .select(*on, (F.col("_f") * F.col("_g")).alias("rows"), F.col("_f").alias("lefts")))
    met = split_join(probes, rules, on, expected)
    return met.groupBy(*STATE_KEY).agg(F.sum("n").alias("n"))


def merged(state: DataFrame, change: DataFrame) -> DataFrame:
    """Support after a change; rows whose last grant went are gone."""
    return state.unionByName(change).groupBy(*STATE_KEY).agg(F.sum("n").alias("n")).where("n > 0")


def strongest(state: DataFrame) -> DataFrame:
    """(principal, folder key, rank): the strongest rank that still has support."""
    return state.groupBy(*PRINCIPAL, *FOLDER_KEY).agg(F.max("rank").alias("rank"))


def fingerprints(grants: DataFrame, buckets: int) -> DataFrame:
    """(bucket, note): what the cover rules of a bucket's grants are, as one short text."""
    rules = cover_rules(grants).withColumn("bucket", bucket_of(buckets))
    mixed = [F.bit_xor(F.xxhash64(F.lit(seed), *RULE, "n")).cast("string") for seed in ("one", "two")]
    return rules.groupBy("bucket").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *mixed).alias("note"))


class MaintainedMatrix:
    """Grants, inventory folders and their support below one shared folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.grants_path, self.folders_path, self.support_path = (os.path.join(root, x) for x in ("grants", "folders", "support"))

    def build(self, grants: DataFrame, folders: DataFrame) -> None:
        """Fills all three tables from scratch."""
        write_buckets(grants.select(*GRANTS.fieldNames()), self.grants_path, self.buckets)
        write_buckets(folders.select(*FOLDER_KEY).distinct(), self.folders_path, self.buckets)
        kept = self.grants()
        write_buckets(support(self.folders(), cover_rules(kept)), self.support_path, self.buckets, fingerprints(kept, self.buckets))

    def grants(self, named: list[int] | None = None) -> DataFrame:
        return read_buckets(self.spark, self.grants_path, GRANTS, named)

    def folders(self, named: list[int] | None = None) -> DataFrame:
        return read_buckets(self.spark, self.folders_path, FOLDERS, named)

    def support(self, named: list[int] | None = None) -> DataFrame:
        return read_buckets(self.spark, self.support_path, SUPPORT, named)

    def change(self, changes: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Applies ``transform`` (old grants -> new grants) to the buckets of the volumes that ``changes``
        name, and returns their numbers.  A transform may only touch grants of these volumes, as all change
        operators of ``operators.changes`` and the import do."""
        named = buckets_named(changes, self.buckets)
        if not named:
            return named
        before = self.grants(named)
        after = saved(transform(before).select(*GRANTS.fieldNames()))
        made_from = read_notes(self.spark, self.support_path, SUPPORT, named)
        have = {r["bucket"]: r["note"] for r in fingerprints(before, self.buckets).collect()}
        good = [b for b in named if made_from.get(b) == have.get(b)]
        stale = [b for b in named if b not in good]
        delta = support(self.folders(good), grant_delta(self.grants(good), after.where(bucket_of(self.buckets).isin(good))))
        state = merged(self.support(good), delta)
        if stale:
            state = state.unionByName(support(self.folders(stale), cover_rules(after.where(bucket_of(self.buckets).isin(stale)))))
        replace_buckets(state, self.support_path, named, self.buckets, fingerprints(after, self.buckets))
        replace_buckets(after, self.grants_path, named, self.buckets)
        return named
