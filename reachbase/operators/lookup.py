"""Finding things by what a person types: principals by identifier, listings by kind and prefix, and a search over four categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.functions import keys
from reachbase.functions.tables import cut, first_by
from reachbase.operators.access import SUBJECT_KINDS
from reachbase.plans.estate import Estate

GROUP_KINDS = ("group", "local_group")
#: Hits shown in a category.
HITS = 10
_SID = r"^S-1(-\d+)+$"


def included(kind: Column, inclusion: str) -> Column:
    """Whether a principal of a kind belongs in a listing of ``users``, ``non_groups`` or ``all``.

    An unknown kind (null) is kept but for users: a trustee that nothing describes is what a reader must see.
    """
    if inclusion == "all":
        return F.lit(True)
    if inclusion == "users":
        return F.coalesce(kind.isin(*SUBJECT_KINDS), F.lit(False))
    if inclusion == "non_groups":
        return F.coalesce(~kind.isin(*GROUP_KINDS), F.lit(True))
    raise ValueError(f"no inclusion {inclusion}: users, non_groups or all")


def listing(principals: DataFrame, kinds: tuple[str, ...], term: str | None = None) -> DataFrame:
    """Principals of these kinds whose identifier or name starts with a term; a blank one stands for all.

    A term that starts like an identifier is matched with identifiers, another with names, letter case aside and without a domain before a backslash.
    No character is a wildcard.
    """
    rows = principals.where(F.col("kind").isin(*kinds))
    text = (term or "").strip()
    if text.upper().startswith("S-1-"):
        return rows.where(keys.sid_of(F.col("principal_key")).startswith(text.upper()))
    name = text.rsplit("\\", 1)[-1].lower()
    return rows.where(F.lower("name").startswith(name)) if text else rows


def resolved(asked: DataFrame, principals: DataFrame) -> DataFrame:
    """identifier, host, principal_key, outcome, candidates: exact, ambiguous or unknown.

    With a host, a bare identifier means that host's own principal if there is one.  Then a key as it stands counts.  Last, a bare identifier
    without a host may be one that several hosts have: one makes it exact, more make it ambiguous, and ``candidates`` lists them in order.
    ``asked``: identifier, host (null: any).
    """
    bare = F.upper(F.trim("identifier"))
    rows = asked.select("identifier", "host").distinct().withColumns({"_sid": F.when(bare.rlike(_SID), bare)})
    rows = rows.withColumns({"_scoped": F.concat_ws("|", F.lower("host"), F.when(F.col("host").isNotNull(), F.col("_sid"))), "_key": F.coalesce("_sid", F.trim("identifier"))})
    have = principals.select("principal_key").distinct()
    scoped = have.select(F.col("principal_key").alias("_scoped"), F.col("principal_key").alias("_by_host"))
    plain = have.select(F.col("principal_key").alias("_key"), F.col("principal_key").alias("_by_key"))
    wanted = rows.where("_sid IS NOT NULL AND host IS NULL").select("_sid").distinct()
    # Hosts of an identifier: as many as the answer lists.
    others = have.withColumn("_sid", keys.sid_of(F.col("principal_key"))).join(wanted, "_sid", "left_semi").groupBy("_sid").agg(F.array_sort(F.collect_list("principal_key")).alias("_others"))
    found = rows.join(scoped, "_scoped", "left").join(plain, "_key", "left").join(others, "_sid", "left")
    several = F.when(F.col("host").isNull(), F.coalesce("_others", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    one = F.coalesce(F.when(F.col("host").isNotNull(), F.col("_by_host")), F.col("_by_key"), F.when(F.size(several) == 1, several[0]))
    outcome = F.when(one.isNotNull(), "exact").when(F.size(several) > 1, "ambiguous").otherwise("unknown")
    return found.select("identifier", "host", one.alias("principal_key"), outcome.alias("outcome"), F.when(one.isNull(), several).otherwise(F.array().cast("array<string>")).alias("candidates"))


def shape(text: Column) -> Column:
    """What a text may mean: sid, path (server, share and perhaps folders), server (two backslashes and a name), name, or null if blank."""
    t = F.trim(text)
    names = F.size(F.filter(F.split(F.translate(t, "/", "\\"), r"\\"), lambda x: x != ""))
    unc = F.translate(F.substring(t, 1, 2), "/", "\\") == "\\\\"
    return F.when(F.coalesce(t, F.lit("")) == "", None).when(F.upper(t).rlike(_SID), "sid").when(unc & (names == 1), "server").when(unc & (names > 1), "path").when(~unc, "name")


def _starting(rows: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """Rows whose column starts with a term (search_no, term), each with search_no.

    Every row offers its prefixes of just those lengths that some term has, so this is an equi-join and no comparison of all with all.
    """
    lengths = terms.agg(F.collect_set(F.length("term")).alias("l")).scalar()  # as many as there are lengths of what people type
    offered = rows.withColumn("_lengths", lengths).withColumn("_length", F.explode(F.filter("_lengths", lambda n: n <= F.length(column))))
    return offered.withColumn("term", F.substring(F.col(column), F.lit(1), F.col("_length"))).join(terms, "term").drop("_lengths", "_length", "term")


def search(e: Estate, searches: DataFrame, limit: int = HITS) -> DataFrame:
    """search_no, category, seat, key, label, truncated for searches (search_no, text): at most ``limit`` hits in each category, and whether there were more.

    A name is looked for at the start of principals', servers' and shares' names; an identifier is compared whole, whichever host has it; a
    server (``\\\\fs01``) finds servers that start so, all its shares and all its folders; a path finds the shares of its server that start
    like its share and folders whose path starts with it.  A blank text finds nothing.  Hits come by label and key, servers, shares and folders by key.
    """
    asked = cut(searches.select("search_no", F.trim("text").alias("text"), shape(F.col("text")).alias("shape")).where("shape IS NOT NULL"))
    of = lambda kind, term: asked.where(F.col("shape") == kind).select("search_no", term.alias("term"))
    path = keys.resource_key(F.col("text"))
    server = keys.parts(path)[0]
    people = e.principals.select("principal_key", "name", F.lower("name").alias("_n"), keys.sid_of(F.col("principal_key")).alias("term"))
    name = of("name", F.lower("text"))
    hit = lambda rows, category, key, label: rows.select("search_no", F.lit(category).alias("category"), F.col(key).alias("key"), F.col(label).alias("label"))
    out = hit(_starting(people, "_n", name), "identities", "principal_key", "name").unionByName(hit(people.join(of("sid", F.upper("text")), "term"), "identities", "principal_key", "name"))
    out = out.unionByName(hit(_starting(e.servers, "server_key", name.unionByName(of("server", server))), "servers", "server_key", "server_key"))
    shares = e.shares.withColumn("_n", F.lower("name"))
    on_server = F.concat(F.col("server_key"), F.lit("|"), F.lower("name"))
    of_path = of("path", F.concat(server, F.lit("|"), keys.parts(path)[1]))
    hits = _starting(shares, "_n", name).drop("_n").unionByName(shares.drop("_n").join(of("server", server).withColumnRenamed("term", "server_key"), "server_key").select(*e.shares.columns, "search_no"))
    hits = hits.unionByName(_starting(e.shares.withColumn("_k", on_server), "_k", of_path).drop("_k"))
    out = out.unionByName(hit(hits, "shares", "share_key", "share_key"))
    folders = e.resources.select("resource_key", "server_key")
    below = folders.join(of("server", server).withColumnRenamed("term", "server_key"), "server_key")
    out = out.unionByName(hit(below, "directories", "resource_key", "resource_key")).unionByName(hit(_starting(folders, "resource_key", of("path", path)), "directories", "resource_key", "resource_key"))
    # Of each category one hit more than is shown; Spark keeps that many before it shuffles.
    by = ["search_no", "category"]
    first = first_by(out, by, [F.col("label").asc_nulls_last(), F.col("key").asc()], limit + 1)
    seats = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("label").isNull().alias("_last"), "label", "key"))).alias("h"))
    return seats.select(*by, (F.size("h") > limit).alias("truncated"), F.posexplode(F.slice("h", 1, limit)).alias("at", "x")).select(*by, (F.col("at") + 1).alias("seat"), "x.key", "x.label", "truncated")
