"""Policy, evidence and privacy jobs."""

import pytest
from pyspark.sql import functions as F

from sonorisk.operators import evidence as EV, governance as G, policy as PO


def chain(spark, n=40):
    i = F.col("id")
    return EV.append_chain(spark.range(n).select((i % 2).alias("tenant"), i.alias("seq"), F.concat(F.lit("body"), i.cast("string")).alias("body")).withColumn("body_sha", F.sha2("body", 256)), "tenant", ["seq"])


def valid(df):
    return {r.tenant: r.valid for r in EV.verify_chains(df, "tenant").collect()}


def test_chain_detects_edits_deletions_and_forks(spark):
    c = chain(spark).cache()
    assert valid(c) == {0: True, 1: True}
    assert valid(c.filter("seq <> 10")) == {0: False, 1: True}
    edited = c.withColumn("body_sha", F.when(F.col("seq") == 11, F.sha2(F.lit("x"), 256)).otherwise(F.col("body_sha")))
    assert valid(edited) == {0: True, 1: False}
    fork = c.unionByName(c.filter("seq = 4").withColumn("row_hash", F.lit("other")))
    assert valid(fork)[0] is False


def test_chain_continues_from_its_head(spark):
    c = chain(spark).cache()
    heads = c.groupBy("tenant").agg(F.max_by("row_hash", "seq").alias("head_hash"))
    i = F.col("id") + 100
    more = EV.append_chain(spark.range(6).select((i % 2).alias("tenant"), i.alias("seq"), F.lit("b").alias("body")).withColumn("body_sha", F.sha2("body", 256)), "tenant", ["seq"], heads)
    assert valid(c.unionByName(more)) == {0: True, 1: True}


def test_broken_chain_is_never_migrated(spark):
    v1 = EV.append_chain(spark.range(10).select(F.lit(1).alias("tenant"), F.col("id").alias("seq"), F.col("id").cast("string").alias("body")), "tenant", ["seq"], content="body")
    assert EV.verify_chains(EV.migrate_chain(v1, "tenant", ["seq"]), "tenant").collect()[0].valid
    with pytest.raises(ValueError):
        EV.migrate_chain(v1.filter("seq <> 3"), "tenant", ["seq"])


def session(spark, **kw):
    d = dict(session_id=1, profile="bfsi-default-v1", shadow_mode=True, state="LOW", risk_score=0, p_max=0.0, p_mean=0.0, abstain_ratio=0.0, speaker_mismatch=0.0, intent_risk=0.0, metadata_risk=0.0, transaction_risk=0.0, tier="medium", watermark_present=False) | kw
    s = spark.createDataFrame([tuple(d.values())], list(d)).withColumns({"labels": F.array(*[F.lit(x) for x in kw.get("lab", [])]).cast("array<string>"), "drivers": F.array().cast("array<string>")})
    return PO.decide(s.drop("lab"), PO.profile_table(spark), PO.label_action_table(spark)).collect()[0]


def test_abstain_is_never_safe_and_context_overrides_it(spark):
    r = session(spark, state="ABSTAIN", risk_score=99)
    assert r.band == "ABSTAIN" and r.actions == [] and "NOT a sign" in r.agent_prompt and "not an indication of safety" in r.rationale
    assert session(spark, state="ABSTAIN", intent_risk=0.9).band == "HIGH"


def test_tiers_change_the_band_and_the_watermark_forces_a_callback(spark):
    assert session(spark, risk_score=50, tier="low").band == "LOW"
    assert session(spark, risk_score=50, tier="high").band == "HIGH"
    assert session(spark, watermark_present=True).actions == ["agent_banner", "force_callback"]


def test_scrub_and_findings(spark):
    df = spark.createDataFrame([(1, [0.1] * 65, "ok", bytearray(b"x")), (2, [0.1], "ok", None)], "id int, values array<double>, note string, raw binary")
    f = {r.id: r.findings for r in G.payload_findings(df).collect()}
    assert len(f[1]) == 2 and f[2] == []
    s = {r.id: r for r in G.scrub(df).collect()}
    assert s[1]["values"] == G.REDACTED and s[2]["values"] == "[0.1]" and s[1].raw == G.REDACTED


def test_egress_is_denied_by_default(spark):
    rows = [("https://a.ok.org/x", ["*.ok.org"], False, False), ("https://ok.org.evil.com", ["*.ok.org"], False, False), ("http://a.ok.org", ["*.ok.org"], False, False), ("https://a.ok.org", ["a.ok.org"], True, False), ("https://a.ok.org", [], False, True)]
    d = G.egress_decision(spark.createDataFrame(rows, "url string, egress_allowlist array<string>, offshore boolean, central_processing boolean"))
    assert [r.decision for r in d.collect()] == ["ok", "not_allowlisted", "scheme", "residency", "not_allowlisted"]


def test_held_sessions_make_an_erasure_partial(spark):
    m = spark.createDataFrame([(1, "b1", 10, "t"), (1, "b2", 11, "t")], "subject_id long, bundle_id string, session_id long, tenant_id string")
    h = spark.createDataFrame([("t", 11)], "tenant_id string, session_id long")
    todo, out = G.subject_erasure(m, h)
    assert [r.bundle_id for r in todo.collect()] == ["b1"] and out.collect()[0].outcome == "partial"


def test_subject_matches_are_distinct_without_shuffling_pairs(spark):
    """Repeated rows, NULL keys and several matching keys give each pair once, and nothing is dealt after the joins."""
    from sonorisk.operators import governance as G

    ev = [("b1", 1, "t", "i1", "n1"), ("b1", 1, "t", "i1", "n1"), ("b1", 1, "t", "i2", "n2"), ("b2", 2, "t", None, "n1"), ("b3", 3, "u", "i1", "n1"), ("b4", 4, None, "i1", "n1"), (None, 5, "t", "i9", "n9")]
    su = [(7, "t", "i1", "n1"), (7, "t", "i2", "n1"), (7, "t", "i1", "n1"), (8, "t", None, "n2"), (None, "t", "i9", None), (9, "u", "i2", "n3")]
    e = spark.createDataFrame(ev, "bundle_id string, session_id long, tenant_id string, claimed_identity_id string, caller_number string")
    s = spark.createDataFrame(su, "subject_id long, tenant_id string, identity string, number string")
    want = {(k, b, x, t) for b, x, t, i, n in ev for k, u, j, m in su if t is not None and t == u and ((i is not None and i == j) or (n is not None and n == m))}
    got = G.subject_evidence(e, s)
    rows = [tuple(r) for r in got.select("subject_id", "bundle_id", "session_id", "tenant_id").collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") == 0


def test_exports_are_distinct_without_shuffling_them(spark, monkeypatch):
    """NULL and repeated keys, items of several sessions, subjects and bundles of two tenants, lists cut short and owners of many keys."""
    import re

    ev = [("b1", 1, "t", "i1", "n1"), ("b1", 1, "t", "i1", "n2"), ("b1", 2, "u", "i1", "n1"), ("b2", 2, "t", None, "n1"), ("b3", 3, "u", "i2", "n1"), ("b4", 4, None, "i1", "n1"), (None, 5, "t", "i9", "n9"), ("b6", None, "t", "i1", "n3")]
    su = [(7, "t", "i1", "n1"), (7, "u", "i1", "n1"), (7, "t", "i1", "n2"), (8, "t", None, "n2"), (None, "t", "i9", None), (9, "u", "i2", "n1"), (9, None, "i1", "n1")]
    tl = [(k % 6, k % 40) for k in range(60)] + [(1, None), (2, None), (None, 99), (1, 99), (1, 99), (None, None), (3, 98), (5, 97)]
    e = spark.createDataFrame(ev, "bundle_id string, session_id long, tenant_id string, claimed_identity_id string, caller_number string")
    s = spark.createDataFrame(su, "subject_id long, tenant_id string, identity string, number string")
    t = spark.createDataFrame(tl, "session_id long, item long")
    met = {(k, b, x) for b, x, t_, i, n in ev for k, u, j, m in su if t_ is not None and t_ == u and ((i is not None and i == j) or (n is not None and n == m))}
    want = {(k, "evidence", b) for k, b, _ in met} | {(k, "timeline", None if i is None else str(i)) for k, _, x in met for y, i in tl if x is not None and x == y}
    for pack, keys in ((1024, 256), (2, 1), (3, 0)):
        monkeypatch.setattr(G, "PACK", pack)
        monkeypatch.setattr(G, "MAX_KEYS", keys)
        got = G.subject_export(e, s, {"timeline": t})
        rows = [tuple(r) for r in got.select("subject_id", "store", "item").collect()]
        assert len(rows) == len(want) and set(rows) == want, (pack, keys)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in re.findall(r"Aggregate \[([^\]]*)\]", plan) if "subject_id" in x and "item" in x]
