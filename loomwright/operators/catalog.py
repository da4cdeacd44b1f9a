"""Versions, grants, reconciliation, writes without MERGE, and audit rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import broadcast_if_small, written


def active_versions(ledger: DataFrame, doc: str, version: str) -> DataFrame:
    """(doc, active, next): the greatest version of each document and the one to write next."""
    return ledger.groupBy(doc).agg(F.max(version).alias("active_version"), (F.max(version) + 1).alias("next_version"))


def only_active(rows: DataFrame, active: DataFrame, doc: str, version: str) -> DataFrame:
    """Rows whose version is the active one; documents that the ledger lacks, and null ones, pass."""
    a = active.select(F.col(doc).alias("_doc"), "active_version")
    return rows.join(a, F.col(doc) == F.col("_doc"), "left").where(F.col("active_version").isNull() | (F.col(version) == F.col("active_version"))).drop("_doc", "active_version")


def expired(ledger: DataFrame, doc: str, version: str, keep: int) -> DataFrame:
    """Versions that retention removes: those at or under the greatest less `keep`."""
    top = F.max(version).over(W.partitionBy(doc))
    return ledger.withColumn("_top", top).where(F.col(version) <= F.col("_top") - keep).drop("_top")


def insert_ignore(new: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of new to append: keys that existing lacks, the first row of each key by `order`."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(existing.select(*keys), keys, "left_anti")


def upsert(new: DataFrame, existing: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """existing with the rows of new in place of those of the same keys; of rows of new that share a key, the last by `order`."""
    last = new
    if order:
        by = [F.col(c).desc() for c in order]
        last = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(last)


def reconcile(truth: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """One row: ids in both, ids that the store lacks, and ids that only it has."""
    t = truth.select(F.col(key).alias("k"), F.lit(1).alias("t")).distinct()
    s = store.select(F.col(key).alias("k"), F.lit(1).alias("s")).distinct()
    x = t.join(s, "k", "full_outer")
    return x.agg(F.count(F.when(F.col("t").isNotNull() & F.col("s").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("s").isNull(), 1)).alias("missing"), F.count(F.when(F.col("t").isNull(), 1)).alias("orphan"))


#: Users of one set of roles that meet documents at a time, and documents that they meet, about.
CELL = 512
#: Rows that a task lists, about.
LISTED = 1 << 19


def _listed(reach: DataFrame, users: DataFrame) -> DataFrame:
    """(tenant, user_id, doc_id) of reach(tenant, roles, doc_id) and users(tenant, roles, user_id), both without repeats.

    Documents and users of the same roles meet in cells of about CELL each, dealt to as many tasks as there are LISTED rows
    to come: however many hold a role, a task lists few rows, holds a few cells, and none of the rows is shuffled.
    """
    at = ["tenant", "roles"]
    sizes = reach.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).join(users.groupBy(*at).agg(F.count(F.lit(1)).alias("m")), at)
    sizes = written(sizes.select(*at, (F.col("n") * F.col("m")).alias("rows"), F.ceil(F.col("n") / CELL).alias("parts"), F.ceil(F.col("m") / CELL).alias("blocks")), "sizes")
    n = (sizes.agg(F.sum("rows")).first()[0] or 0) // LISTED + 1
    each, cell = broadcast_if_small(sizes.drop("rows")), [*at, "block", "part"]
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    deal = lambda key, c: F.pmod(F.xxhash64(key), F.col(c))
    docs = reach.join(each, at).select(*at, deal("doc_id", "parts").alias("part"), every("blocks").alias("block"), "doc_id")
    held = users.join(each, at).groupBy(*at, deal("user_id", "blocks").alias("block"), "parts").agg(F.collect_list("user_id").alias("_users"))
    held = held.select(*at, "block", every("parts").alias("part"), "_users")
    return docs.repartition(n, *cell).join(held.repartition(n, *cell), cell).select("tenant", F.explode("_users").alias("user_id"), "doc_id")


def readable(docs: DataFrame, users: DataFrame, grants: DataFrame, permission: str = "read") -> DataFrame:
    """(tenant, user_id, doc_id): what users may read in their tenant.

    docs(doc_id, tenant, owner), users(user_id, tenant, role, superadmin), grants(doc_id, principal_type, principal_id,
    permission). A user reads own documents and those that a grant of that permission gives to the user or to a role of
    theirs. Documents without an owner are open to all of their tenant: one row each, with a null user_id, rather than
    one for each user. A superadmin has one row with a null doc_id: no filter. Each way is an equi-join.

    What roles let read is by far the most. It is listed by users' whole sets of roles, each document once for a set, so
    that it has no repeats; own and granted documents that a role gives as well are taken out before. Repeats are looked
    for among the rest alone.
    """
    d = docs.select("doc_id", "tenant", "owner")
    who = written(users.where("not superadmin").groupBy("tenant", "user_id").agg(F.sort_array(F.collect_set("role")).alias("roles")), "who")
    sets = written(who.where("tenant is not null and size(roles) > 0").select("tenant", "roles").distinct(), "role-sets")
    names, at = ["tenant", "user_id", "doc_id"], ["tenant", "roles"]
    g = grants.where(F.col("permission") == permission).select("doc_id", "principal_type", "principal_id")
    to_role = g.where("principal_type = 'role'").select("doc_id", F.col("principal_id").alias("role"))
    sets = sets.select(*at, F.explode("roles").alias("role"))
    to_role = to_role.join(broadcast_if_small(sets.select("role").distinct()), "role", "left_semi").join(d.select("doc_id", "tenant"), "doc_id")
    reach = written(to_role.join(broadcast_if_small(sets), ["role", "tenant"]).select(*at, "doc_id").distinct(), "reach")
    own = d.withColumnRenamed("owner", "user_id").join(who, ["user_id", "tenant"]).select(*names, "roles")
    by_user = g.where("principal_type = 'user'").withColumnRenamed("principal_id", "user_id").join(d.select("doc_id", "tenant"), "doc_id").join(who, ["user_id", "tenant"]).select(*names, "roles")
    direct = own.unionByName(by_user).join(reach, [*at, "doc_id"], "left_anti").select(*names)
    none = lambda of, c: F.lit(None).cast(of.schema[c].dataType).alias(c)
    nameless = reach.join(who.where("user_id is null").select(*at), at).select("tenant", none(users, "user_id"), "doc_id")
    everyone = d.where("owner is null").select("tenant", none(users, "user_id"), "doc_id")
    admins = users.where("superadmin").select("tenant", "user_id", none(docs, "doc_id"))
    few = direct.unionByName(nameless).unionByName(everyone).unionByName(admins).distinct()
    return few.unionByName(_listed(reach, who.where("user_id is not null")))


def visible(requests: DataFrame, may_read: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id): the documents that each request's search may look at: what its user may read, and its scope, in its tenant.

    requests(query_id, tenant, user_id, scope), may_read as `readable` gives it, docs(doc_id, tenant). scope is an array of
    doc_ids: null is no restriction, an empty one leaves nothing.
    """
    asks = requests.select("query_id", "tenant", "user_id", "scope")
    free = may_read.where("doc_id is null").select("tenant", "user_id")
    listed = asks.join(may_read.where("doc_id is not null and user_id is not null"), ["tenant", "user_id"]).select("query_id", "scope", "doc_id")
    others = asks.join(free, ["tenant", "user_id"], "left_anti")
    open_ = others.join(may_read.where("user_id is null").select("tenant", "doc_id"), "tenant").select("query_id", "scope", "doc_id")
    all_ = asks.join(free, ["tenant", "user_id"], "left_semi").join(docs.select("tenant", "doc_id"), "tenant").select("query_id", "scope", "doc_id")
    every = listed.unionByName(open_).unionByName(all_)
    return every.where(F.col("scope").isNull() | F.array_contains("scope", F.col("doc_id"))).select("query_id", "doc_id").distinct()


def who(requests: DataFrame, users: DataFrame) -> DataFrame:
    """(tenant, user_id, roles, superadmin) of the users that requests(tenant, user_id) name; unknown ones have no role."""
    known = users.groupBy("tenant", "user_id").agg(F.collect_set("role").alias("roles"), F.bool_or("superadmin").alias("superadmin"))
    x = requests.select("tenant", "user_id").distinct().join(known, ["tenant", "user_id"], "left")
    return x.select("tenant", "user_id", F.coalesce("roles", F.array().cast(known.schema["roles"].dataType)).alias("roles"), F.coalesce("superadmin", F.lit(False)).alias("superadmin"))


def granted(docs: DataFrame, grants: DataFrame, requests: DataFrame, permission: str = "read") -> DataFrame:
    """docs(doc_id, tenant, owner) with to_roles and to_users: which roles, and which of the requests' users, a grant lets at each; null for none."""
    g = grants.where(F.col("permission") == permission)
    roles = g.where("principal_type = 'role'").groupBy("doc_id").agg(F.collect_set("principal_id").alias("to_roles"))
    asking = requests.select(F.col("user_id").alias("principal_id")).distinct()
    users = g.where("principal_type = 'user'").join(asking, "principal_id", "left_semi").groupBy("doc_id").agg(F.collect_set("principal_id").alias("to_users"))
    return docs.select("doc_id", "tenant", "owner").join(roles, "doc_id", "left").join(users, "doc_id", "left")


def seen(requests: DataFrame, docs: DataFrame | None, users: DataFrame | None, grants: DataFrame | None) -> Callable[[DataFrame], DataFrame]:
    """A function that keeps the rows of (query_id, doc_id, ..) whose document that request's user may see: what a search has found is tested, and nothing else is listed.

    requests(query_id, tenant, user_id, scope), docs(doc_id, tenant, owner), users(user_id, tenant, role, superadmin),
    grants(doc_id, principal_type, principal_id, permission). A document is seen in its tenant alone, within the scope
    (null is no restriction, an empty one leaves nothing), by its owner, by those whom a grant to them or a role of theirs
    lets read, by superadmins, and by all if it has no owner. Unknown documents and requests have none. Where one of the
    tables of rights is missing (None), nothing is seen.
    """
    if docs is None or users is None or grants is None:
        return lambda rows: rows.where("false")
    asked = requests.select("query_id", "tenant", "user_id", "scope").join(who(requests, users), ["tenant", "user_id"])
    asked = asked.select("query_id", F.struct("tenant", "user_id", "scope", "roles", "superadmin").alias("_ask"))
    rights = granted(docs, grants, requests).select("doc_id", F.struct("tenant", "owner", "to_roles", "to_users").alias("_doc"))

    def keep(rows: DataFrame) -> DataFrame:
        x = rows.join(broadcast_if_small(written(asked, "requests")), "query_id").join(rights, "doc_id")
        a, d, yes = F.col("_ask"), F.col("_doc"), lambda c: F.coalesce(c, F.lit(False))
        in_scope = a["scope"].isNull() | yes(F.array_contains(a["scope"], F.col("doc_id")))
        lets = a["superadmin"] | d["owner"].isNull() | yes(d["owner"] == a["user_id"]) | yes(F.arrays_overlap(d["to_roles"], a["roles"])) | yes(F.array_contains(d["to_users"], a["user_id"]))
        return x.where(yes(a["tenant"] == d["tenant"]) & in_scope & lets).select(*rows.columns)

    return keep


def may(asked: DataFrame, docs: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """asked(user_id, doc_id, permission) with `allowed`.

    The owner may do all; a document without an owner is open to read; else a grant to the user or to a role of theirs
    decides. Unknown documents are denied. docs(doc_id, owner), users(user_id, role), grants(doc_id, principal_type,
    principal_id, permission). Where docs and users have `tenant`, a document of another tenant is unknown; where users
    have `superadmin`, those may do all, on any document.
    """
    q = asked.select("user_id", "doc_id", "permission").distinct()
    g = grants.select("doc_id", "permission", "principal_type", "principal_id").distinct()
    direct = q.join(g.where("principal_type = 'user'"), ["doc_id", "permission"]).where(F.col("principal_id") == F.col("user_id")).select(*q.columns)
    held = q.join(users.select("user_id", "role"), "user_id").join(g.where("principal_type = 'role'").withColumnRenamed("principal_id", "role"), ["doc_id", "permission", "role"]).select(*q.columns)
    granted = direct.unionByName(held).distinct().withColumn("_granted", F.lit(True))
    tenants = "tenant" in docs.columns and "tenant" in users.columns
    flags = [F.max("tenant").alias("_of")] if tenants else []
    flags += [F.bool_or("superadmin").alias("_admin")] if "superadmin" in users.columns else []
    x = q.join(docs.select("doc_id", F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("_owner"), F.lit(True).alias("_known"), *([F.col("tenant").alias("_in")] if tenants else [])), "doc_id", "left").join(granted, q.columns, "left")
    if flags:
        x = x.join(users.groupBy("user_id").agg(*flags), "user_id", "left")
    free = (F.col("_owner") == "") & (F.col("permission") == "read")
    owned = (F.col("_owner") == F.col("user_id").cast("string")) & (F.col("_owner") != "")
    allowed = F.col("_known").isNotNull() & (owned | free | ((F.col("_owner") != "") & F.col("_granted").isNotNull()))
    if tenants:
        allowed = allowed & F.coalesce(F.col("_in") == F.col("_of"), F.lit(False))
    if "superadmin" in users.columns:
        allowed = allowed | F.coalesce("_admin", F.lit(False))
    return x.select(*q.columns, allowed.alias("allowed"))


def manageable(asked: DataFrame, docs: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """asked(user_id, doc_id) with `may_delete` and `may_manage`: superadmins may do both, owners too, and a grant to `delete` gives the first alone.

    users has superadmin besides what `may` takes. A superadmin needs no document; anyone else is denied an unknown one,
    and, where docs and users have `tenant`, one of another tenant.
    """
    q = asked.select("user_id", "doc_id").distinct()
    own = ["tenant"] if "tenant" in docs.columns and "tenant" in users.columns else []
    known, held = docs.select("doc_id", "owner", *own), users.select("user_id", "role", *own)
    ask = lambda permission, g: may(q.withColumn("permission", F.lit(permission)), known, held, g).select("user_id", "doc_id", F.col("allowed").alias(permission))
    admins = users.where("superadmin").select("user_id", F.lit(True).alias("_admin")).distinct()
    x = ask("delete", grants).join(ask("manage", grants.where("false")), ["user_id", "doc_id"]).join(admins, "user_id", "left")
    admin = F.col("_admin").isNotNull()
    return x.select("user_id", "doc_id", (admin | F.col("delete")).alias("may_delete"), (admin | F.col("manage")).alias("may_manage"))


def stale_tokens(tokens: DataFrame, users: DataFrame) -> DataFrame:
    """tokens(user_id, uv, ..) with `stale`: those without a version, of another version than their user's, or of no known user."""
    known = users.select(F.col("user_id").alias("_user"), "token_version")
    same = F.col("uv").isNotNull() & F.coalesce(F.col("uv") == F.col("token_version"), F.lit(False))
    return tokens.join(known, F.col("user_id") == F.col("_user"), "left").withColumn("stale", ~same).drop("_user", "token_version")


def audit_page(log: DataFrame, allowed: list[str], filters: dict[str, object], order: str, page: int, size: int, by: str | None = None) -> DataFrame:
    """Page `page` (from 1) of the log, newest `order` first, for each `by` if given.

    An action's type is what stands before its first dot; only allowed types show, `*` being all. filters are equalities.
    """
    x = log if "*" in allowed else log.where(F.substring_index("action", ".", 1).isin(*allowed))
    for column, value in filters.items():
        x = x.where(F.col(column) == value)
    if by is None:
        return x.orderBy(F.col(order).desc()).offset((page - 1) * size).limit(size)
    n = F.row_number().over(W.partitionBy(by).orderBy(F.col(order).desc()))
    return x.withColumn("n", n.cast("long")).where((F.col("n") > (page - 1) * size) & (F.col("n") <= page * size))


def rolled_back(ledger: DataFrame, targets: DataFrame, doc: str, version: str) -> DataFrame:
    """The ledger without what is newer than a document's target; a target that is not an older version of it changes nothing."""
    top = ledger.groupBy(doc).agg(F.max(version).alias("_active"))
    held = ledger.select(doc, F.col(version).alias("_target")).distinct()
    ok = targets.select(doc, F.col("target").alias("_target")).join(held, [doc, "_target"], "left_semi").join(top, doc).where((F.col("_target") >= 1) & (F.col("_target") < F.col("_active"))).select(doc, "_target")
    return ledger.join(ok, doc, "left").where(F.col("_target").isNull() | (F.col(version) <= F.col("_target"))).drop("_target")


def listed_versions(ledger: DataFrame, doc: str, version: str) -> DataFrame:
    """The ledger with `active` on the greatest version of each document."""
    return ledger.withColumn("active", F.col(version) == F.max(version).over(W.partitionBy(doc)))


def resolved(docs: DataFrame, ledger: DataFrame, doc: str, version: str, bump: bool) -> DataFrame:
    """docs with `version` to write: the next one, or, without a bump, the active one; 1 for new documents."""
    top = ledger.groupBy(doc).agg(F.max(version).alias("_active"))
    return docs.join(top, doc, "left").withColumn("version", F.coalesce(F.col("_active") + (1 if bump else 0), F.lit(1))).drop("_active")


def repairs(truth: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """(key, action): ids to `add` to the store, and ids to `drop` from it, so that it has those of the truth."""
    t, s = truth.select(key).distinct(), store.select(key).distinct()
    return t.join(s, key, "left_anti").withColumn("action", F.lit("add")).unionByName(s.join(t, key, "left_anti").withColumn("action", F.lit("drop")))


def recorded(chunks: DataFrame, keys: list[str], vector: str = "vector_id") -> DataFrame:
    """A ledger row for each of keys, such as document, strategy and version: how many different vectors it has."""
    return chunks.groupBy(*keys).agg(F.count_distinct(vector).alias("chunk_count"))


def index_status(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, doc: str, vector: str) -> DataFrame:
    """(doc, n_chunks, n_vectors, status) of every document: `missing` without chunks, `partial` while some lack a vector, else `ready`."""
    have = chunks.select(doc, vector).join(vectors.select(F.col(vector).alias("_v")).distinct(), F.col(vector) == F.col("_v"), "left")
    n = have.groupBy(doc).agg(F.count(F.lit(1)).alias("n_chunks"), F.count("_v").alias("n_vectors"))
    x = docs.select(doc).join(n, doc, "left").select(doc, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"))
    return x.withColumn("status", F.when(F.col("n_chunks") == 0, "missing").when(F.col("n_vectors") < F.col("n_chunks"), "partial").otherwise("ready"))


def reusable(corpus: DataFrame, cache: DataFrame, model: str, normalise: bool, dim: int) -> DataFrame:
    """corpus(id, hash) with `embedding` from the cache, null where it must be encoded anew.

    A cached row serves if its model, normalisation, text hash and dimension all agree. cache(id, hash, model, normalise,
    embedding); ids are unique in it.
    """
    fits = cache.where((F.col("model") == model) & (F.col("normalise") == F.lit(normalise)) & (F.size("embedding") == dim)).select("id", "hash", "embedding")
    return corpus.select("id", "hash").join(fits, ["id", "hash"], "left")


def vector_errors(rows: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """rows with `error`: why a vector can't be added (`missing`, `dimension`, `not a number`), null if it can."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return rows.withColumn("error", F.when(F.col(vector).isNull(), "missing").when(F.size(vector) != dim, "dimension").when(bad, "not a number"))


def without(rows: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no deleted key has: a delete, and its cascade to a child table."""
    return rows.join(deleted.select(*keys), keys, "left_anti")


def counted(old: DataFrame, bumps: DataFrame, keys: list[str]) -> DataFrame:
    """Index versions after so many bumps of each key; a key not seen before starts at its bumps."""
    new = bumps.groupBy(*keys).agg(F.count(F.lit(1)).alias("version"))
    return old.select(*keys, F.col("version").cast("long").alias("version")).unionByName(new).groupBy(*keys).agg(F.sum("version").alias("version"))


def missing(expected: DataFrame, stores: dict[str, DataFrame], key: str) -> DataFrame:
    """(store, missing, complete) of each store: how many expected ids it lacks."""
    rows = None
    for name, store in stores.items():
        one = expected.select(key).distinct().join(store.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("missing")).select(F.lit(name).alias("store"), "missing", (F.col("missing") == 0).alias("complete"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def survivors(log: DataFrame, group: str, key: str, at: str, most: int) -> DataFrame:
    """(group, key, last): what a cache of `most` entries a group holds after the log, those used last."""
    last = log.groupBy(group, key).agg(F.max(at).alias("last"))
    return last.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(F.col("last").desc(), F.col(key)))).where(F.col("_n") <= most).drop("_n")


def fingerprint(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, n, digest): a digest of a group's rows in any order, from one hash of each row."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary"), 256), 1, 15), 16, 10).cast("long")
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("digest"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("total"))  # equal rows cancel in an xor, not in a sum


def named_documents(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """asked(name) with `doc_id`: the document that a name means, null if none.

    docs has doc_id (a string) and file_name (a path). In this order a name may be an id, an id with a suffix or
    folders, the end of a path from a slash on, or the name of a file given without its suffix; ties go to the lowest id.
    Each path is known by all its ends, so names are looked up by equality.
    """
    path = F.replace(F.col("file_name"), F.lit("\\"), F.lit("/"))
    parts = F.split(path, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    known = docs.select("doc_id", F.col("doc_id").alias("key"), F.lit("id").alias("kind")).unionByName(
        docs.where("file_name is not null").select("doc_id", F.explode(F.array_distinct(ends)).alias("key"), F.lit("path").alias("kind"))
    )
    stem = F.regexp_replace(F.regexp_extract("name", "[^/]*$", 0), r"^(.+)\.[^.]+$", "$1")
    tries = F.array(*[F.struct(F.lit(i).alias("try"), c.alias("key"), F.lit(kind).alias("kind")) for i, (c, kind) in enumerate([(F.col("name"), "id"), (stem, "id"), (F.col("name"), "path"), (stem, "path")])])
    best = asked.select("name").distinct().select("name", F.explode(tries).alias("t")).select("name", "t.*").join(known, ["key", "kind"]).groupBy("name").agg(F.min_by("doc_id", F.struct("try", "doc_id")).alias("doc_id"))
    return asked.join(best, "name", "left")


def in_order(requests: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the ids that each request(request_id, ids) lists, with `pos`, their place in it from 0; ids that aren't there are passed over."""
    return requests.select("request_id", F.posexplode("ids").alias("pos", key)).join(rows, key)


def denied(requests: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Audit rows of requests(actor, ip, method, path, status) that were refused, but for excluded paths; fields are cut to their columns."""
    said = F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(": "), F.col("method"), F.lit(" "), F.col("path"))
    refused = requests.where(F.col("status").isin(401, 403) & ~F.col("path").isin(*excluded))
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return refused.select(F.lit("authz.denied").alias("action"), F.lit("denied").alias("result"), "actor", cut(F.col("path"), 256).alias("resource"), cut(F.col("ip"), 64).alias("ip"), cut(said, 1024).alias("detail"))


def permission_sets(users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """(user_id, permission), each once: what the roles of users(user_id, superadmin) permit; superadmins have every one of permissions(permission)."""
    held = users.where("not superadmin").select("user_id").join(user_roles.select("user_id", "role"), "user_id").join(broadcast_if_small(role_permissions.select("role", "permission").distinct()), "role")
    every = permissions.select("permission").distinct().agg(F.collect_set("permission").alias("ps"))  # codes of a program
    admins = users.where("superadmin").select("user_id").distinct().withColumn("_one", F.lit(1)).join(F.broadcast(every.withColumn("_one", F.lit(1))), "_one")
    return held.select("user_id", "permission").distinct().unionByName(admins.select("user_id", F.explode("ps").alias("permission")))


def checked_grants(grants: DataFrame, docs: DataFrame, existing: DataFrame) -> DataFrame:
    """grants(doc_id, principal_type, principal_id, permission) with `error`, null for those to append: `principal`, `permission`, `document` or `exists`, the first that holds; repeats but for one exist too."""
    keys = ["doc_id", "principal_type", "principal_id", "permission"]
    n = F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0)))
    x = grants.select(*keys).withColumn("_n", n).join(docs.select("doc_id", F.lit(True).alias("_known")).distinct(), "doc_id", "left").join(existing.select(*keys, F.lit(True).alias("_there")).distinct(), keys, "left")
    error = F.when(~F.coalesce(F.col("principal_type").isin("user", "role"), F.lit(False)), "principal").when(~F.coalesce(F.col("permission").isin("read", "write", "delete"), F.lit(False)), "permission").when(F.col("_known").isNull(), "document").when(F.col("_there").isNotNull() | (F.col("_n") > 1), "exists")
    return x.select(*keys, error.alias("error"))


def keyset_page(rows: DataFrame, key: str, after: object | None, size: int) -> DataFrame:
    """The `size` rows of least key above `after`, in its order: a page by cursor. The bound reaches the scan, and a layout sorted by key is read from there on."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def laid_out(rows: DataFrame, key: str, path: str, files: int | None = None) -> DataFrame:
    """Rows written in files of disjoint ranges of key, sorted in each, and read back: bounds on key skip files and row groups."""
    ranged = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def keyset_pages(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with `page`, from 0: which page of `size` rows a cursor over key would show them on; keys are unique.

    Rows are dealt by range and counted within their part; only a row for each part is summed up.
    """
    part = written(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()), "ranged")  # part number above, row number below bit 33
    own = F.shiftright("_at", 33).alias("_part")
    above = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = part.groupBy(own).agg(F.count(F.lit(1)).alias("_n")).select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_base"))  # a row a part
    number = F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return part.join(broadcast_if_small(base), F.shiftright("_at", 33) == F.col("_of")).withColumn("page", F.floor(number / size).cast("long")).select(*rows.columns, "page")


def continued_ids(new: DataFrame, existing: DataFrame, order: list[str], key: str = "vector_id") -> DataFrame:
    """new with `key`: ids that go on, without gaps and in `order`, from one above the greatest that existing has (0 if it has none).

    Rows are numbered within parts of a range, and the parts are summed up: no task gets all rows.
    """
    start = existing.agg(F.coalesce(F.max(key) + 1, F.lit(0)).cast("long").alias("start")).first().start
    part = written(new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    above = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = part.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_base"))
    number = F.lit(start) + F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return part.join(broadcast_if_small(base), F.shiftright("_at", 33) == F.col("_of")).withColumn(key, number).select(*[c for c in new.columns if c != key], key)


def removed_verified(rows: DataFrame, deleted: DataFrame, keys: list[str], path: str) -> dict[str, int]:
    """Writes rows without those of the deleted keys to path; how many it kept, removed, did not find, and, read again, still has of them.

    Rows are counted in the pass that writes them; only the residue takes another, over the keys of what was written.
    """
    from pyspark.sql import Observation

    gone = deleted.select(*keys).distinct().withColumn("_gone", F.lit(True))
    told = Observation()
    marked = rows.join(broadcast_if_small(gone), keys, "left")
    counted_ = marked.observe(told, F.count(F.lit(1)).alias("all"), F.count("_gone").alias("removed"))
    counted_.where("_gone is null").drop("_gone").write.mode("errorifexists").option("compression", "zstd").parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    residue = back.join(gone, keys, "left_semi").count()
    absent = gone.join(rows.select(*keys), keys, "left_anti").count()
    return {"kept": told.get["all"] - told.get["removed"], "removed": told.get["removed"], "absent": absent, "residue": residue}
