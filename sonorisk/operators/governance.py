"""Privacy jobs: purposes, payload checks, egress, retention, subject requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sonorisk.functions.identity import host_of
from sonorisk.scale import materialize, null_safe_join, small_or_plain

# fixed values: field names that carry audio or biometrics, and size limits
AUDIO_KEYS = ("pcm", "audio", "wav", "samples", "waveform", "audio_base64", "payload_base64", "embedding", "embeddings", "voiceprint", "centroid")
MAX_NUMERIC_LIST = 64
MAX_OPAQUE_TEXT = 4096
REDACTED = "[redacted:audio]"
DAY_US = 86_400_000_000
MAX_HOLDS = 1 << 18  # held sessions that are sent to every executor
PACK = 1024  # items of one owner that are shuffled as one list
MAX_KEYS = 256  # keys of one owner that are shuffled with each of them


def purpose_check(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    """``allowed`` and ``why`` per request; the first failing rule names the reason.

    requests: purpose, basis, consent_ref, bundled; matrix: purpose, allowed_bases, disabled,
    requires_consent_record, bundling_allowed.
    """
    j = requests.join(small_or_plain(matrix.withColumn("_in", F.lit(True))), "purpose", "left")
    why = (
        F.when(F.col("_in").isNull(), "unknown purpose")
        .when(F.col("disabled"), "purpose is disabled")
        .when(~F.array_contains("allowed_bases", F.col("basis")), "basis not allowed")
        .when(F.col("requires_consent_record") & F.coalesce("consent_ref", F.lit("")).isin(""), "consent reference missing")
        .when(F.col("bundled") & ~F.col("bundling_allowed"), "cannot be bundled")
        .otherwise("ok")
    )
    return j.withColumn("why", why).withColumn("allowed", F.col("why") == "ok").drop("_in")


def may_retain_audio(band: Column, hours: Column, basis: Column, allowed_bases: tuple[str, ...]) -> Column:
    """Raw audio may be kept only for flagged calls, with a positive window and an allowed basis."""
    return (hours > 0) & band.isin("ELEVATED", "HIGH") & basis.isin(*allowed_bases)


def _finding(c: Column, dtype: T.DataType, name: str) -> Column | None:
    """Why a value looks like audio or biometrics (NULL = it does not)."""
    key = name.split(".")[-1].lower() in AUDIO_KEYS
    if isinstance(dtype, T.BinaryType):
        return F.when(F.length(c) > 0, F.lit(f"{name}: binary payload"))
    if isinstance(dtype, T.ArrayType):
        numeric = isinstance(dtype.elementType, T.NumericType)
        hit = F.when(F.size(c) > 0, F.lit(f"{name}: audio/biometric field")) if key else F.lit(None).cast("string")
        return F.coalesce(hit, F.when(F.size(c) > MAX_NUMERIC_LIST, F.lit(f"{name}: numeric array"))) if numeric else hit
    if isinstance(dtype, T.StringType):
        hit = F.when(F.length(c) > 0, F.lit(f"{name}: audio/biometric field")) if key else F.lit(None).cast("string")
        blob = (F.length(c) > MAX_OPAQUE_TEXT) & (F.length(c) % 4 == 0) & c.rlike("^[A-Za-z0-9+/]+={0,2}$")
        return F.coalesce(hit, F.when(blob, F.lit(f"{name}: base64 blob")))
    return None


def _walk(schema: T.StructType, prefix: str = ""):
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        yield path, f.dataType
        if isinstance(f.dataType, T.StructType):
            yield from _walk(f.dataType, path + ".")


def payload_findings(df: DataFrame) -> DataFrame:
    """Add ``findings``: array of reasons over every column and nested field of the schema."""
    checks = [_finding(F.col(p), t, p) for p, t in _walk(df.schema)]
    checks = [c for c in checks if c is not None]
    return df.withColumn("findings", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def scrub(df: DataFrame) -> DataFrame:
    """Replace flagged top-level values by a marker; arrays and structs become JSON text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StructType):
            inner = [x for x in (_finding(F.col(p), t, p) for p, t in _walk(f.dataType, f.name + ".")) if x is not None]
            hit = F.coalesce(*inner) if inner else F.lit(None)
            out.append(F.when(hit.isNotNull(), REDACTED).otherwise(F.to_json(c)).alias(f.name))
            continue
        hit = _finding(c, f.dataType, f.name)
        if hit is None:
            out.append(c)
        elif isinstance(f.dataType, T.ArrayType):
            out.append(F.when(hit.isNotNull(), REDACTED).otherwise(F.to_json(c)).alias(f.name))
        elif isinstance(f.dataType, T.BinaryType):
            out.append(F.when(hit.isNotNull(), REDACTED).otherwise(F.base64(c)).alias(f.name))
        else:
            out.append(F.when(hit.isNotNull(), REDACTED).otherwise(c).alias(f.name))
    return df.select(*out)


def egress_decision(requests: DataFrame, url: str = "url") -> DataFrame:
    """``decision`` per outgoing request: ok, scheme, not_allowlisted or residency (default deny).

    requests carry egress_allowlist (array), offshore and central_processing.
    """
    host = host_of(F.col(url))
    d = requests.withColumns({"host": F.coalesce(host, F.lit("")), "scheme": F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("PROTOCOL")), F.lit("")))})
    listed = F.exists(
        "egress_allowlist",
        lambda a: (F.col("host") == F.lower(F.trim(a))) | (a.startswith("*.") & F.col("host").endswith(F.lower(F.substring(F.trim(a), F.lit(2), F.length(a))))),
    )
    decision = (
        F.when(~F.col("scheme").isin("https", "wss"), "scheme")
        .when(~F.coalesce(listed, F.lit(False)), "not_allowlisted")
        .when(F.col("offshore") & ~F.coalesce("central_processing", F.lit(False)), "residency")
        .otherwise("ok")
    )
    return d.withColumn("decision", decision)


# ---- retention --------------------------------------------------------------------------------


def with_tenant_policy(df: DataFrame, policies: DataFrame, default: dict[str, int]) -> DataFrame:
    """Tenant retention settings, each falling back to the default policy."""
    j = df.join(small_or_plain(policies), "tenant_id", "left")
    return j.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in default.items()})


def expired_evidence(evidence: DataFrame, policies: DataFrame, holds: DataFrame, now_us: int, default: dict[str, int]) -> DataFrame:
    """Evidence past its tenant's window: ``action`` is erase, or held for sessions under legal hold."""
    e = with_tenant_policy(evidence, policies, default)
    old = e.filter(F.col("created_us") < now_us - F.col("evidence_days") * DAY_US)
    h = holds.select("tenant_id", "session_id", F.lit(True).alias("_held")).distinct()
    j = old.join(h, ["tenant_id", "session_id"], "left")
    return j.withColumn("action", F.when(F.col("_held").isNotNull(), "held").otherwise("erase")).drop("_held")


def retention_report(expired: DataFrame, dry_run: bool) -> DataFrame:
    return expired.groupBy("tenant_id").agg(
        F.sum((F.col("action") == "erase").cast("long")).alias("evidence_erased"), F.sum((F.col("action") == "held").cast("long")).alias("held_sessions_skipped")
    ).withColumn("dry_run", F.lit(dry_run))


def longest_window(rows: DataFrame, policies: DataFrame, setting: str, now_us: int, at: str = "created_us") -> DataFrame:
    """Rows of a store without a tenant that are past the longest configured window (never too early)."""
    longest = policies.agg(F.max(setting).alias("_d"))
    return rows.join(F.broadcast(longest)).filter(F.col(at) < now_us - F.col("_d") * DAY_US).drop("_d")


def voiceprint_expiry(prints: DataFrame, policies: DataFrame, now_us: int, default: dict[str, int]) -> DataFrame:
    """Voiceprints to delete, with the reason: expired or inactive."""
    p = with_tenant_policy(prints, policies, default)
    last = F.coalesce("updated_us", "created_us")
    reason = F.when(F.col("expires_us") <= now_us, "expired").when(last < now_us - F.col("voiceprint_inactive_days") * DAY_US, "inactive")
    return p.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def _key_sets(rows: DataFrame, by: list[str], identity: str, number: str, names: tuple[str, str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.collect_set(identity).alias(names[0]), F.collect_set(number).alias(names[1]))


def _meet(units: DataFrame, subjects: DataFrame, on: list[str]) -> DataFrame:
    """Each unit with each subject that shares one of its identities (_ei, _si) or numbers (_en, _sn), once.

    The OR is two equi joins, the second without what the first has, so no nested loop is planned and no pair is shuffled:
    units and subjects are distinct before they meet, and a pair with several matching keys is kept at its least one.
    """

    def pairs(mine: str, theirs: str) -> DataFrame:
        j = units.withColumn("_key", F.explode(mine)).join(small_or_plain(subjects.withColumn("_key", F.explode(theirs))), [*on, "_key"])
        one = (F.size(mine) == 1) | (F.size(theirs) == 1)
        return j.filter(F.when(one, True).otherwise(F.col("_key") == F.array_min(F.array_intersect(mine, theirs))))

    single = (F.size("_ei") <= 1) & (F.size("_si") <= 1)
    same = F.when(single, F.coalesce(F.get("_ei", F.lit(0)) == F.get("_si", F.lit(0)), F.lit(False))).otherwise(F.arrays_overlap("_ei", "_si"))
    cols = ["subject_id", *[c for c in units.columns if c not in ("_ei", "_en")]]
    return pairs("_ei", "_si").select(cols).unionByName(pairs("_en", "_sn").filter(~same).select(cols))


def subject_evidence(evidence: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject_id, bundle_id, session_id, tenant_id): evidence matching a subject's identity or number, each once."""
    e = _key_sets(evidence, ["bundle_id", "session_id", "tenant_id"], "claimed_identity_id", "caller_number", ("_ei", "_en"))
    s = _key_sets(subjects, ["subject_id", "tenant_id"], "identity", "number", ("_si", "_sn"))
    return _meet(e, s, ["tenant_id"]).select("subject_id", "bundle_id", "session_id", "tenant_id")


def _packed(items: DataFrame) -> DataFrame:
    """(_own, items): the items of an owner in lists of about ``PACK``, however many one owner has."""
    n = items.groupBy("_own").agg(F.count(F.lit(1)).alias("_n"))
    x = items.join(n, "_own").withColumn("_list", F.pmod(F.xxhash64("item"), F.ceil(F.col("_n") / PACK)))
    lists = x.repartition("_own", "_list").groupBy("_own", "_list").agg(F.collect_list(F.struct("item")).alias("items"))  # a struct, as bare NULLs would go
    return lists.select("_own", F.col("items.item").alias("items"))


def _held(keys: DataFrame, subjects: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(subject_id, item): the items of each owner that shares a key with a subject; without lists an owner is its own item.

    keys: (_own, _ei, _en), each owner once.  The keys of an owner travel with each of them, so owners of more than ``MAX_KEYS``
    meet the subjects without their keys, and those pairs are made distinct by a shuffle.
    """
    few = F.size("_ei") + F.size("_en") <= MAX_KEYS
    listed = lambda df: df.withColumn("items", F.array("_own")) if lists is None else df.join(lists, "_own")
    one = _meet(listed(keys.filter(few)), subjects, [])
    asked = subjects.select("subject_id", F.explode(F.concat("_si", "_sn")).alias("_key"))
    many = keys.filter(~few).select("_own", F.explode(F.concat("_ei", "_en")).alias("_key")).join(asked, "_key").select("subject_id", "_own").distinct()
    item = F.explode("items").alias("item")
    return one.select("subject_id", item).unionByName(listed(many).select("subject_id", item))


def subject_export(evidence: DataFrame, subjects: DataFrame, stores: dict[str, DataFrame]) -> DataFrame:
    """(subject_id, store, item): everything held about the sessions of each subject's evidence, each once.

    stores: name -> (session_id, item).  Subjects and items meet as in ``subject_evidence``, by keys that name their kind and
    tenant; the keys of an item are those of all evidence of its sessions.  Rows are distinct as they meet, so only keys and lists
    of items are shuffled, never the export itself, which grows with the product of subjects and items.
    """
    own = lambda kind, c: F.concat(F.lit(kind), F.length("tenant_id").cast("string"), F.lit(":"), F.col("tenant_id"), F.col(c).cast("string")).alias(c)
    e = evidence.select("session_id", F.col("bundle_id").cast("string").alias("item"), own("i", "claimed_identity_id"), own("n", "caller_number"))
    of = lambda by: _key_sets(e, [by], "claimed_identity_id", "caller_number", ("_ei", "_en"))
    s = _key_sets(subjects.select("subject_id", own("i", "identity"), own("n", "number")), ["subject_id"], "identity", "number", ("_si", "_sn"))
    sessions = of("session_id")
    parts = [_held(of("item").withColumnRenamed("item", "_own"), s).withColumn("store", F.lit("evidence"))]
    for name, df in stores.items():
        rows = df.select("session_id", F.col("item").cast("string").alias("item"))
        items = rows.groupBy("item").agg(F.min("session_id").alias("_own"), F.max("session_id").alias("_last"))
        alone = _held(sessions.withColumnRenamed("session_id", "_own"), s, _packed(items.filter("_own = _last").select("_own", "item")))
        shared = null_safe_join(rows, items.filter("_own <> _last").select("item"), ["item"], "inner").join(sessions, "session_id")
        key = shared.select(F.col("item").alias("_own"), F.explode(F.concat("_ei", "_en")).alias("_key"))
        kinds = [F.when(F.col("_key").startswith(k), F.col("_key")).alias(c) for k, c in (("i", "_si"), ("n", "_sn"))]
        both = _held(_key_sets(key.select("_own", *kinds), ["_own"], "_si", "_sn", ("_ei", "_en")), s)
        parts.append(alone.unionByName(both).withColumn("store", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).select("subject_id", "store", "item")


def subject_erasure(matches: DataFrame, holds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bundles to erase, outcome per subject): held sessions stay and make the outcome partial."""
    h = materialize(holds.select("tenant_id", "session_id", F.lit(True).alias("_h")).distinct())
    if h.count() <= MAX_HOLDS:
        h = F.broadcast(h)  # there are far more matches, which then stay where they are
    m = matches.join(h, ["tenant_id", "session_id"], "left").withColumn("held", F.col("_h").isNotNull()).drop("_h")
    todo = m.filter(~F.col("held"))
    out = m.groupBy("subject_id").agg(
        F.sum((~F.col("held")).cast("long")).alias("evidence_erased"), F.countDistinct(F.when(F.col("held"), F.col("session_id"))).alias("held_sessions")
    )
    return todo, out.withColumn("outcome", F.when(F.col("held_sessions") > 0, "partial").otherwise("ok"))
