"""Feedback, rule sets, batches and reviews: which rules hold, what to promote, what to run again, which review operations may stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators.quality import detail_categories

# Least feedback by scope, and how wide a scope reaches.
LEAST = {"user": 2, "project": 2, "source_pattern": 2, "document_type": 3, "global": 5, "public": 5}
REACH = {"user": 0, "project": 0, "source_pattern": 0, "document_type": 1, "global": 2, "public": 2}
FIELDS = ["status", "risk_tags", "reason", "confidence"]
STATUSES = ["keep", "discard", "evidence", "review"]
BATCH_FROM, BATCH_TARGET = 80_000, 60_000
# end of fixed values
KEY = ["document_type", "action", "match", "pattern"]


def _of(names: dict, c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c)


def suggestions(items: DataFrame, rejected: DataFrame) -> DataFrame:
    """(document_type, scope, items, least): document types with enough accepted feedback to suggest rules.

    ``items`` is (seq, document_type, action, match, pattern, scope); repeated and rejected keys do not count, the widest scope sets how much is enough.
    """
    known = lambda df: df.where("action IS NOT NULL AND pattern IS NOT NULL AND document_type IS NOT NULL AND document_type <> 'unknown'").withColumn("match", F.coalesce("match", F.lit("literal")))
    fresh = known(items).where("action = 'discard'").join(known(rejected).select(*KEY).distinct(), KEY, "left_anti")
    once = fresh.groupBy(*KEY).agg(F.min_by(F.coalesce("scope", F.lit("user")), "seq").alias("scope"), F.min("seq").alias("seq"))
    ranked = once.groupBy("document_type").agg(F.max(F.struct(F.coalesce(_of(REACH, F.col("scope")), F.lit(0)).alias("reach"), (-F.col("seq")).alias("place"), "scope"))["scope"].alias("scope"), F.count("*").alias("items"))
    return ranked.withColumn("least", F.coalesce(_of(LEAST, F.col("scope")), F.lit(LEAST["user"]))).where("items >= least")


def promotions(entries: DataFrame) -> DataFrame:
    """(document_type, unresolved, unverified, latest, last_reason) from entries (seq, document_type, resolution, status, resolved, reason)."""
    passed, failed = F.col("status") == "passed", F.col("status") == "failed"
    latest = F.when(F.col("resolution"), F.when(passed, "resolved").otherwise("resolution_failed")).otherwise(F.coalesce("status", F.lit("unknown")))
    told = entries.withColumns({"status": F.coalesce("status", F.lit("unknown")), "latest": latest})
    g = told.groupBy("document_type").agg(
        F.count_if(~F.col("resolution") & failed).alias("failed"), F.coalesce(F.sum(F.when(F.col("resolution") & passed, F.when(F.col("resolved") > 0, F.col("resolved")).otherwise(1))), F.lit(0)).alias("solved"),
        F.count_if(F.when(F.col("resolution"), ~passed).otherwise(~passed & ~failed)).alias("unverified"), F.max_by("latest", "seq").alias("latest"), F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("reason"))
    return g.select("document_type", F.greatest(F.col("failed") - F.col("solved"), F.lit(0)).alias("unresolved"), "unverified", "latest", F.when(F.col("latest") != "resolved", F.col("reason")).alias("last_reason"))


def first_of(rows: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of every key in the order of ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rule_union(rules: DataFrame) -> DataFrame:
    """Rules (priority, place, kind, label, pattern) of all routes: words once whatever their case, patterns once by label and pattern, the first route wins."""
    key = F.when(F.col("kind") == "word", F.lower("pattern")).otherwise(F.concat_ws("\u0001", "label", "pattern"))
    return first_of(rules, [F.col("kind"), key], ["priority", "place"])


def merged(existing: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows, and proposed ones whose key they lack, each once."""
    return existing.unionByName(proposed.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def _begins(value: Column, pattern: Column, ends: tuple[str, ...]) -> Column:
    return (value == pattern) | (F.startswith(value, pattern) & F.substring(value, F.length(pattern) + 1, F.lit(1)).isin(*ends))


def source_matches(pattern: Column, identity: Column) -> Column:
    """Whether a source pattern (``field:value`` or a plain value) fits an identity (map field → value)."""
    p = F.lower(F.translate(F.trim(pattern), "\\", "/"))
    field, rest = F.regexp_extract(p, "^([a-z_]+):(.+)$", 1), F.regexp_extract(p, "^([a-z_]+):(.+)$", 2)
    keyed = field.isin("source_domain", "source_url", "input_path", "source_path", "source_name", "source_identity", "site_name")
    words = ("-", "_", ".", " ", "~", "(", "[", "{")

    def fits(k, v, want, plain):
        domain = (v == want) | F.endswith(v, F.concat(F.lit("."), want))
        url = F.lit(False) if plain else _begins(v, want, ("/", "?", "#", "&"))
        path = F.exists(F.split(v, "[\\\\/]+", -1), lambda x: (x != "") & _begins(x, want, words))
        return F.when(k == "source_domain", domain).when(k == "source_url", url).when(k.isin("input_path", "source_path", "source_name", *(("source_identity",) if plain else ())), path).otherwise(_begins(v, want, words))

    entries = F.transform(F.map_entries(identity), lambda e: F.struct(e["key"].alias("k"), F.lower(F.translate(e["value"], "\\", "/")).alias("v")))
    return F.coalesce((p != "") & F.when(keyed, F.exists(entries, lambda e: (e["k"] == field) & fits(e["k"], e["v"], rest, False))).otherwise(F.exists(entries, lambda e: fits(e["k"], e["v"], p, True))), F.lit(False))


def accepted(proposals: DataFrame, document_type: Column, identity: Column) -> DataFrame:
    """Accepted proposals that hold for a document type and a source."""
    right_type = (F.col("scope") != "document_type") | F.col("document_type").isNull() | (F.col("document_type") == document_type)
    right_source = (F.col("scope") != "source_pattern") | source_matches(F.coalesce("source_pattern", F.lit("")), identity)
    return proposals.where((F.col("status") == "accepted") & right_type & right_source)


def manifest(inventory: DataFrame, results: DataFrame, failures: DataFrame) -> DataFrame:
    """(batch, path, status, reason): what became of every listed file; of several results of a path the last counts."""
    last = lambda df, cols: df.groupBy("batch", "path").agg(F.max_by(F.struct(*cols), "seq").alias("x"))
    r = last(results, ["ok", "errors"]).withColumnRenamed("x", "r")
    f = last(failures, ["reason"]).withColumnRenamed("x", "f")
    met = inventory.join(r, ["batch", "path"], "left").join(f, ["batch", "path"], "left")
    status = F.when(F.col("action") == "skip", "skipped_unsupported").when(F.col("r").isNull(), "pending").when(F.col("r.ok") & (F.col("r.errors") == 0), "succeeded").otherwise("failed")
    return met.select("batch", "path", status.alias("status"), F.when(status == "failed", F.coalesce("f.reason", F.lit("failed"))).when(status == "pending", "blocked_before_processing").otherwise("").alias("reason"))


def batch_status(items: DataFrame) -> DataFrame:
    """(batch, succeeded, failed, pending, skipped, status, scope): the state of each batch and what to run again."""
    n = {s: F.count_if(F.col("status") == k) for s, k in (("succeeded", "succeeded"), ("failed", "failed"), ("pending", "pending"), ("skipped", "skipped_unsupported"))}
    g = items.groupBy("batch").agg(*[c.alias(k) for k, c in n.items()])
    status = F.when((F.col("failed") > 0) & (F.col("succeeded") == 0), "failed").when((F.col("failed") > 0) | (F.col("pending") > 0) | (F.col("skipped") > 0), "completed_with_warnings").otherwise("completed")
    scope = F.when((F.col("failed") > 0) & (F.col("pending") > 0), "failed_and_pending").when(F.col("failed") > 0, "failed_only").when(F.col("pending") > 0, "pending_only").otherwise("none")
    return g.withColumns({"status": status, "scope": scope})


def affected(children: DataFrame, selectors: DataFrame) -> DataFrame:
    """Children (id, policy, identity) that any selector (by id, by policy, by part of the identity) names, once each.

    Two equi-joins and a theta join with the selectors that name an identity only: a list typed in by a user.
    """
    by_id = children.join(selectors.where("s_id IS NOT NULL").select(F.col("s_id").alias("id")).distinct(), "id", "left_semi")
    by_policy = children.join(selectors.where("s_policy IS NOT NULL").select(F.col("s_policy").alias("policy")).distinct(), "policy", "left_semi")
    named = selectors.where("s_identity IS NOT NULL AND size(s_identity) > 0").select("s_identity")
    subset = F.forall(F.map_entries("s_identity"), lambda e: F.coalesce(F.try_element_at(F.col("identity"), e["key"]) == e["value"], F.lit(False)))
    by_identity = children.join(F.broadcast(named), subset, "left_semi")
    return by_id.select("id").unionByName(by_policy.select("id")).unionByName(by_identity.select("id")).distinct()


def review_batches(blocks: DataFrame, overhead: int = 100) -> DataFrame:
    """(doc_id, batch, blocks, chars): blocks (doc_id, block_idx, n) of a review, in batches once they are too much for one."""
    rows = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", (F.col("n") + overhead).alias("n")))).alias("b"))
    group = "struct<blocks:int,n:bigint>"
    whole = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    step = lambda a, x: F.when(a["open"]["blocks"].isNotNull() & (a["open"]["n"] + x["n"] <= F.col("limit")), F.struct(a["done"].alias("done"), F.struct((a["open"]["blocks"] + 1).alias("blocks"), (a["open"]["n"] + x["n"]).alias("n")).alias("open"))).otherwise(
        F.struct(F.when(a["open"]["blocks"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])).alias("done"), F.struct(F.lit(1).alias("blocks"), x["n"].cast("long").alias("n")).alias("open")))
    packed = F.aggregate("b", F.struct(F.array().cast(f"array<{group}>").alias("done"), F.lit(None).cast(group).alias("open")), step, lambda a: F.array_append(a["done"], a["open"]))
    limited = rows.withColumn("limit", F.when(whole <= BATCH_FROM, F.lit(1 << 62)).otherwise(F.lit(BATCH_TARGET)))
    return limited.select("doc_id", F.posexplode(packed).alias("batch", "x")).select("doc_id", F.col("batch").cast("long"), F.col("x.blocks").cast("long").alias("blocks"), F.col("x.n").alias("chars"))


def operation_fault() -> Column:
    """Why a review operation (op, path, value, kind of its value) may not stand, null if it may."""
    parts = F.filter(F.split("path", "/", -1), lambda x: x != "")
    field = F.get(parts, F.lit(2))
    value = F.when((field == "risk_tags") & (F.col("op") == "add"), F.when(F.col("kind") != "string", "risk_tags add value must be a string")).when(F.col("op") != "replace", F.concat(F.lit("add is not supported for field "), field)).when(
        field == "status", F.when((F.col("kind") != "string") | ~F.col("value").isin(STATUSES), F.concat(F.lit("invalid status "), F.col("value")))).when(
        field == "risk_tags", F.when(F.col("kind") != "strings", "risk_tags replace value must be a string array")).when(field == "reason", F.when(F.col("kind") != "string", "reason must be a string")).when(
        field == "confidence", F.when((F.col("kind") != "number") | ~F.coalesce(F.expr("try_cast(value AS double) BETWEEN 0 AND 1"), F.lit(False)), "confidence must be a number between 0 and 1"))
    return F.when(~F.col("op").isin("replace", "add"), F.concat(F.lit("unsupported op "), F.col("op"))).when(F.col("path").isNull(), "path must be a string").when((F.size(parts) != 3) | (F.get(parts, F.lit(0)) != "blocks"), F.concat(F.lit("invalid path "), F.col("path"))).when(
        ~field.isin(FIELDS), F.concat(F.lit("field "), field, F.lit(" is not allowed"))).otherwise(value)


def applied(blocks: DataFrame, operations: DataFrame) -> DataFrame:
    """(doc_id, block_id, status, fault) for every status operation (doc_id, seq, block_id, value): the last that may stand decides.

    Blocks that hold details, are protected or of a type to be kept are not discarded.
    """
    each, t = T.read(blocks, "text")
    held = each.withColumn("details", F.size(detail_categories(t, F.col("type"))) > 0)
    met = operations.join(held, ["doc_id", "block_id"], "left")
    fault = F.when(F.col("type").isNull(), "block not found").when(F.col("value") == "discard", F.when(F.col("details"), "cannot discard detail-bearing block").when(F.col("type").isin("code", "table", "image", "formula"), "cannot discard protected type").when(F.col("protected"), "cannot discard protected block"))
    told = met.withColumn("fault", fault)
    return told.groupBy("doc_id", "block_id").agg(F.max_by("value", F.when(F.col("fault").isNull(), F.col("seq"))).alias("new_status"), F.count_if(F.col("fault").isNotNull()).alias("rejected"), F.min("fault").alias("fault"))
