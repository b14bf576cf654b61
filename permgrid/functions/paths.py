"""Column expressions over volume paths and folders.

Folders are plain strings such as ``/y1995/m03/``.  All functions are built-in
Spark expressions (higher-order array functions included), so they stay in the
JVM and need no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from permgrid.schemas import VOLUME_ROOT


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slash_prefixes(folder: Column | str) -> Column:
    """Every prefix of ``folder`` that ends at a '/', shortest first.

    ``/a/b/`` -> [``/``, ``/a/``, ``/a/b/``]; ``a/b`` -> [``a/``]; NULL -> NULL.
    """
    f = _c(folder)
    idx = F.filter(F.sequence(F.lit(1), F.greatest(F.length(f), F.lit(1))),
                   lambda i: F.substr(f, i, F.lit(1)) == F.lit("/"))
    return F.transform(idx, lambda i: F.substr(f, F.lit(1), i))


def folder_probes(folder: Column | str, lengths: Column | str) -> Column:
    """Probe rows of a folder F for the equi-join cover test: ``('T', prefix of F)`` for every length
    that a tree grant of its volume has and F reaches, and ``('E', F)``.  A grant (see
    ``cover.grant_match_keys``) covers F exactly when it equals a probe.  NULL lengths mean none."""
    f, ls = _c(folder), _c(lengths)
    reached = F.filter(F.coalesce(ls, F.array().cast("array<int>")), lambda n: n <= F.length(f))
    tree = F.transform(reached, lambda n: F.struct(F.lit("T").alias("match_kind"), F.substr(f, F.lit(1), n).alias("match_key")))
    exact = F.array(F.struct(F.lit("E").alias("match_kind"), f.alias("match_key")))
    return F.when(f.isNotNull(), F.concat(tree, exact))


def folder_ancestors(folder: Column | str) -> Column:
    """Proper ancestors (what repeated "Up" reaches): '/'-ending prefixes shorter
    than the folder itself.  ``/a/b/c/`` -> [``/``, ``/a/``, ``/a/b/``]."""
    f = _c(folder)
    return F.filter(slash_prefixes(f), lambda p: F.length(p) < F.length(f))


def volume_path(uc_catalog: Column | str, uc_schema: Column | str, volume: Column | str,
                folder: Column | str, name: Column | str | None = None) -> Column:
    """``/Volumes/<catalog>/<schema>/<volume><folder><file>``."""
    parts = [F.lit(VOLUME_ROOT + "/"), _c(uc_catalog), F.lit("/"), _c(uc_schema), F.lit("/"),
             _c(volume), _c(folder)]
    if name is not None:
        parts.append(_c(name))
    return F.concat(*parts)


# scheme (file:, dbfs:, abfss://host) is optional in front of /Volumes
_VOLUME_PATH_RE = (r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?)?/Volumes/"
                   r"([^/]+)/([^/]+)/([^/]+)(/(?:.*/)?)([^/]*)$")


def parse_volume_path(path: Column | str) -> list[Column]:
    """Split a volume file path into catalog, schema, volume, folder, name."""
    p = _c(path)
    names = ["uc_catalog", "uc_schema", "volume", "folder", "name"]
    return [F.nullif(F.regexp_extract(p, _VOLUME_PATH_RE, i + 1), F.lit("")).alias(n)
            if n != "name" else F.regexp_extract(p, _VOLUME_PATH_RE, i + 1).alias(n)
            for i, n in enumerate(names)]


def child_path(folder: Column | str, name: Column | str) -> Column:
    """folder + name without trailing '/' + '/'."""
    return F.concat(_c(folder), F.regexp_replace(_c(name), "/+$", ""), F.lit("/"))


def entry_folder(scope: Column | str, folder_path: Column | str) -> Column:
    """Where browsing a grant starts: the volume root for VOLUME, else its folder."""
    from permgrid.functions.cover import scope_default
    return F.when(scope_default(_c(scope)) == "VOLUME", F.lit("/")).otherwise(_c(folder_path))


def bundle_name(folder: Column | str, day: Column) -> Column:
    """Folder without outer '/', inner '/' -> '_', then ``_YYYYMMDD.zip``."""
    slug = F.replace(F.btrim(_c(folder), F.lit("/")), F.lit("/"), F.lit("_"))
    return F.concat(slug, F.lit("_"), F.date_format(day, "yyyyMMdd"), F.lit(".zip"))
