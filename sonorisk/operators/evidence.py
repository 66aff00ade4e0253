"""Evidence bundles and hash chains: canonical form, append, verification, erasure."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sonorisk.scale import fold_sorted

GENESIS = "genesis"


def canonical_json(**fields: Column) -> Column:
    """JSON of a struct with fields in name order (canonical form 1); maps go in as sorted entries."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def sorted_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def bundle_id(**fields: Column) -> Column:
    """Content hash with the two self-referring ids blanked."""
    blank = {**fields, "bundle_id": F.lit(""), "evidence_bundle_id": F.lit("")}
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(**blank), 256))


def append_chain(rows: DataFrame, chain: str, order: list[str], heads: DataFrame | None = None, content: str = "body_sha") -> DataFrame:
    """Add prev_hash and row_hash = sha256(prev + content) along each chain.

    A chain is sequential by definition; chains (tenants) run in parallel, rows stream through with
    constant memory.  ``heads`` (chain, head_hash) continues existing chains.
    """
    src = rows
    if heads is not None:
        src = src.join(heads.select(chain, F.col("head_hash").alias("_head")), chain, "left")
    else:
        src = src.withColumn("_head", F.lit(None).cast("string"))
    schema = T.StructType([*rows.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("row_hash", T.StringType())])

    def step(pdf: pd.DataFrame, prev):
        if prev is None:
            head = pdf["_head"].iloc[0]
            prev = head if isinstance(head, str) else GENESIS
        p, r = [], []
        for c in pdf[content]:
            p.append(prev)
            prev = hashlib.sha256((prev + c).encode()).hexdigest()
            r.append(prev)
        return pdf.drop(columns="_head").assign(prev_hash=p, row_hash=r), prev

    return fold_sorted(src, [chain], order, step, schema)


def verify_links(chain_rows: DataFrame, chain: str, content: str = "body_sha") -> DataFrame:
    """Per row: its hash recomputes and it follows another row (or starts the chain).

    A self equi join on prev_hash = row_hash replaces a global ordered walk.
    """
    prior = chain_rows.select(F.col(chain), F.col("row_hash").alias("prev_hash")).distinct().withColumn("_prior", F.lit(True))
    j = chain_rows.join(prior, [chain, "prev_hash"], "left")
    recomputed = F.sha2(F.concat(F.col("prev_hash"), F.col(content)), 256) == F.col("row_hash")
    linked = (F.col("prev_hash") == GENESIS) | F.col("_prior").isNotNull()
    return j.withColumns({"hash_ok": recomputed, "link_ok": linked}).drop("_prior")


def verify_chains(chain_rows: DataFrame, chain: str, content: str = "body_sha") -> DataFrame:
    """Per chain: valid when every row checks, there is one start and no fork."""
    v = verify_links(chain_rows, chain, content)
    g = v.groupBy(chain).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("hash_ok") & F.col("link_ok"), 0).otherwise(1)).alias("n_bad"),
        F.sum((F.col("prev_hash") == GENESIS).cast("long")).alias("n_start"),
    )
    # a fork repeats a prev_hash: counted by a pre-aggregated group, not by collecting the chain
    forks = v.groupBy(chain, "prev_hash").count().filter("count > 1").groupBy(chain).agg(F.count(F.lit(1)).alias("n_forks"))
    out = g.join(forks, chain, "left").withColumn("n_forks", F.coalesce("n_forks", F.lit(0)))
    return out.withColumn("valid", (F.col("n_bad") == 0) & (F.col("n_start") == 1) & (F.col("n_forks") == 0))


def with_bodies(evidence: DataFrame, bodies: DataFrame, erasures: DataFrame) -> DataFrame:
    """Chain rows with body and erasure record, status and the reason a row fails, if any."""
    j = evidence.drop("body").join(bodies.select("bundle_id", "body"), "bundle_id", "left").join(
        erasures.select("bundle_id", F.lit(True).alias("_erased")), "bundle_id", "left"
    )
    erased = F.coalesce("_erased", F.lit(False))
    failure = (
        F.when(F.col("body").isNull() & ~erased, "body_missing_without_erasure")
        .when(F.col("body").isNotNull() & (F.sha2(F.col("body"), 256) != F.col("body_sha")), "body_hash_mismatch")
    )
    return j.withColumns({"status": F.when(erased, "erased").otherwise("present"), "body_failure": failure}).drop("_erased")


def verification_report(evidence: DataFrame, bodies: DataFrame, erasures: DataFrame, chain: str) -> DataFrame:
    """Failure reason per evidence row: broken hash, broken link, body problems; NULL = verified."""
    b = with_bodies(verify_links(evidence, chain), bodies, erasures)
    reason = F.when(~F.col("hash_ok"), "row_hash_mismatch").when(~F.col("link_ok"), "broken_link").otherwise(F.col("body_failure"))
    return b.withColumns({"failure": reason, "verified": reason.isNull()})


def erase(bodies: DataFrame, erase_ids: DataFrame, erased_at: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(remaining bodies, new erasure records); the chain itself is untouched."""
    ids = erase_ids.select("bundle_id").distinct()
    gone = bodies.join(ids, "bundle_id", "left_semi").select("bundle_id", F.lit(erased_at).alias("erased_at"), F.lit(reason[:200]).alias("reason"))
    return bodies.join(ids, "bundle_id", "left_anti"), gone


def migrate_chain(v1: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """Re-chain an old chain hashed over bodies to one hashed over body hashes; refuses a broken one."""
    bad = verify_chains(v1, chain, "body").filter(~F.col("valid"))
    if bad.limit(1).count():
        raise ValueError("an old chain is broken; refusing to migrate")
    fresh = v1.drop("prev_hash", "row_hash").withColumn("body_sha", F.sha2(F.col("body"), 256))
    return append_chain(fresh, chain, order)
