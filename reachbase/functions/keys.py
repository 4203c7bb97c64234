"""Keys of principals, groups, shares, paths and entries, and tests on security identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reachbase.functions.masks import hex_mask

SEPARATOR = "\\"
EVERYONE, AUTHENTICATED, ANONYMOUS, NETWORK, INTERACTIVE, SYSTEM = "S-1-1-0", "S-1-5-11", "S-1-5-7", "S-1-5-2", "S-1-5-4", "S-1-5-18"
NOBODY, CREATOR_OWNER, CREATOR_GROUP, OWNER_RIGHTS = "S-1-0-0", "S-1-3-0", "S-1-3-1", "S-1-3-4"
WORLD = (EVERYONE, AUTHENTICATED, ANONYMOUS)
# Who counts as broad and as privileged.
BROAD_SIDS = (EVERYONE, ANONYMOUS, AUTHENTICATED, "S-1-5-15", "S-1-5-32-545", "S-1-5-32-546", "S-1-5-113", "S-1-5-114", "S-1-15-2-1")
BROAD_RIDS = ("513", "514", "515")
PRIVILEGED_SIDS = ("S-1-5-32-544", "S-1-5-32-547", "S-1-5-32-551")
PRIVILEGED_RIDS = ("512", "518", "519", "520", "526", "527")


def principal_key(sid: Column, host: Column, kind: Column | None = None) -> Column:
    """The identifier; before that the host, for groups that each machine has of its own.

    A described principal is such a group by its kind; of a trustee only the identifier is known, and tells.
    """
    local = sid.startswith("S-1-5-32-") if kind is None else F.coalesce(kind == "local_group", F.lit(False)) | sid.startswith("S-1-5-32-")
    return F.when(local & host.isNotNull(), F.concat_ws("|", F.lower(host), sid)).otherwise(sid)


def sid_of(key: Column) -> Column:
    return F.substring_index(key, "|", -1)


def rid(key: Column) -> Column:
    """The last number of an identifier that a domain issued; empty for others."""
    return F.regexp_extract(sid_of(key), r"^S-1-5-21-(?:\d+-)+(\d+)$", 1)


def is_broad(key: Column) -> Column:
    return sid_of(key).isin(*BROAD_SIDS) | rid(key).isin(*BROAD_RIDS)


def is_privileged(key: Column) -> Column:
    return sid_of(key).isin(*PRIVILEGED_SIDS) | rid(key).isin(*PRIVILEGED_RIDS)


def is_well_known(key: Column) -> Column:
    return ~sid_of(key).startswith("S-1-5-21-")


def edge_key(group: Column, member: Column, kind: Column) -> Column:
    return F.concat(group, F.lit("->"), member, F.lit("|"), kind)


def share_key(server: Column, share: Column) -> Column:
    return F.concat_ws("|", F.lower(server), F.lower(share))


def resource_key(path: Column) -> Column:
    """One key for all spellings of a path: either slash, doubled or trailing ones, ``.`` segments, ``\\\\?\\UNC\\`` and letter case."""
    names = F.filter(F.split(F.translate(F.lower(F.trim(path)), "/", SEPARATOR), r"\\"), lambda x: (x != "") & (x != "."))
    long = (F.get(names, F.lit(0)) == "?") & (F.get(names, F.lit(1)) == "unc")
    return F.concat(F.lit("\\\\"), F.array_join(F.when(long, F.slice(names, 3, 1 << 20)).otherwise(names), SEPARATOR))


def ntfs_ace_key(resource: Column, trustee: Column, kind: Column, mask: Column, flags: Column) -> Column:
    """The order of an entry isn't part of its identity; its mask and flags are."""
    return F.concat_ws("|", resource, trustee, kind, hex_mask(mask), hex_mask(flags, 2))


def share_ace_key(share: Column, trustee: Column, kind: Column, right: Column) -> Column:
    return F.concat_ws("|", share, trustee, kind, right)


def parts(key: Column) -> Column:
    """The names of a path: ``\\\\server\\share\\a`` has server, share, a."""
    return F.split(F.substring(key, 3, 1 << 20), r"\\")


def parent_key(key: Column) -> Column:
    """The path one level up; null for a share's root."""
    names = parts(key)
    return F.when(F.size(names) > 2, F.concat(F.lit("\\\\"), F.array_join(F.slice(names, 1, F.size(names) - 1), SEPARATOR)))


def ancestors(key: Column) -> Column:
    """array(struct(distance, key)): every path above, nearest first, down to the share's root."""
    names = parts(key)
    at = F.sequence(F.lit(1), F.size(names) - 2)
    above = F.transform(at, lambda d: F.struct(d.alias("distance"), F.concat(F.lit("\\\\"), F.array_join(F.slice(names, F.lit(1), F.size(names) - d), SEPARATOR)).alias("key")))
    return F.when(F.size(names) > 2, above).otherwise(F.array().cast("array<struct<distance:int,key:string>>"))


def under(key: Column, root: str) -> Column:
    """In the subtree of a root; never by LIKE, whose wildcards occur in names."""
    return (key == root) | key.startswith(root + SEPARATOR)
