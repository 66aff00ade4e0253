"""Corpus gates, splits, reports and samples.

All random draws are orders by a seeded hash of the row id: repeatable, independent of partitioning and
exact.  Ranks inside a group come from ``ordered_index``, which spreads a group that holds a large
share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from sonorisk.functions.identity import order_hash, unit_hash
from sonorisk.scale import fold_sorted, materialize, ordered_index, prefix_sums, small_or_plain

SPLITS = ("train", "dev", "eval")
MAX_PICKS = 1 << 14  # ranks per group that are sent to every executor


def license_violations(rows: DataFrame, registry: DataFrame, allow_noncommercial: bool, purpose: str = "train") -> DataFrame:
    """(utt_id, problem): unregistered corpus, eval-only corpus in training, non-commercial data."""
    reg = registry.select(F.col("name").alias("source_corpus"), F.col("commercial_use").alias("_c"), F.col("eval_only").alias("_e"), F.lit(True).alias("_reg"))
    j = rows.join(small_or_plain(reg), "source_corpus", "left")
    known = F.col("_reg").isNotNull()
    probs = F.array(
        F.when(~known, "not_in_registry"),
        F.when(known & F.lit(purpose == "train") & F.col("_e"), "eval_only"),
        F.when(known & F.lit(not allow_noncommercial) & ~(F.col("commercial_use") & F.col("_c")), "non_commercial"),
    )
    return j.select("utt_id", F.explode(F.filter(probs, lambda p: p.isNotNull())).alias("problem"))


def check_policy(lineage: str, allow_noncommercial: bool) -> None:
    """A commercial lineage can never allow non-commercial data; both settings must be explicit."""
    if lineage not in ("research", "commercial"):
        raise ValueError(f"unknown lineage {lineage!r}")
    if not isinstance(allow_noncommercial, bool):
        raise ValueError("allow_noncommercial must be a boolean")
    if lineage == "commercial" and allow_noncommercial:
        raise ValueError("commercial lineage cannot allow non-commercial data")


def enforce_license(rows: DataFrame, registry: DataFrame, lineage: str, allow_noncommercial: bool, purpose: str = "train") -> DataFrame:
    """The rows, or an error naming the first 20 violations and their count."""
    check_policy(lineage, allow_noncommercial)
    v = license_violations(rows, registry, allow_noncommercial, purpose)
    head, n = error_report(v, "utt_id", 20)
    if n:
        raise ValueError(f"license gate failed for {n} rows: " + "; ".join(f"{r.utt_id}: {r.problem}" for r in head))
    return rows


def error_report(problems: DataFrame, key: str, first: int) -> tuple[list, int]:
    """The first few problems by key and how many there are in all."""
    n = problems.count()
    return (problems.orderBy(key, "problem").limit(first).collect() if n else []), n


def consent_flags(rows: DataFrame, corpora: DataFrame, speakers: DataFrame, today: Column) -> DataFrame:
    """``allowed``: an approved corpus, or a speaker with unexpired consent (two equi joins)."""
    c = corpora.select(F.col("name").alias("source_corpus"), F.lit(True).alias("_c")).distinct()
    s = speakers.filter(F.col("expires").isNull() | (F.col("expires") >= today)).select("speaker_id", F.lit(True).alias("_s")).distinct()
    j = rows.join(small_or_plain(c), "source_corpus", "left").join(s, "speaker_id", "left")
    return j.withColumn("allowed", F.coalesce("_c", "_s", F.lit(False))).drop("_c", "_s")


def assign_splits(rows: DataFrame, registry: DataFrame, holdout: Sequence[str], seed: int = 1337, dev: float = 0.1, eval_: float = 0.1) -> DataFrame:
    """Speaker-disjoint splits: eval-only corpora and held-out families pin their speakers to eval."""
    e = registry.filter("eval_only").select(F.col("name").alias("source_corpus"), F.lit(True).alias("_e"))
    r = rows.join(small_or_plain(e), "source_corpus", "left")
    forced = F.coalesce("_e", F.lit(False)) | F.coalesce(F.col("generator_family").isin(*holdout) if holdout else F.lit(False), F.lit(False))
    r = r.withColumn("_f", forced)
    pinned = r.filter("_f").select("speaker_id", F.lit(True).alias("_p")).distinct()
    u = unit_hash(F.col("speaker_id"), seed)
    split = F.when(F.col("_f") | F.col("_p").isNotNull() | (u < eval_), "eval").when(u < eval_ + dev, "dev").otherwise("train")
    return r.join(pinned, "speaker_id", "left").withColumn("split", split).drop("_e", "_f", "_p")


def leaking_speakers(split_rows: DataFrame) -> DataFrame:
    """Speakers found in more than one split, with the pairs (empty when splits are disjoint)."""
    g = split_rows.groupBy("speaker_id").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return g.filter(F.size("splits") > 1)


def greedy_speaker_splits(rows: DataFrame, group: str, fracs: dict[str, float], seed: int) -> DataFrame:
    """(group, speaker_id, split): each speaker goes where it fills the per-label quota best.

    Works on per-speaker label counts, in hash order within a group (a language).  The state is one table of running
    fills, splits by labels.  A split is closed to a speaker who would lift one of its labels over one and a half
    quotas; among the open ones the largest share of still unfilled quota wins, and without any the speaker trains.
    """
    per = rows.groupBy(group, "speaker_id").agg(
        F.sum((F.col("label") == "bona_fide").cast("long")).alias("nb"), F.sum((F.col("label") == "spoof").cast("long")).alias("ns")
    )
    tot = per.groupBy(group).agg(F.sum("nb").alias("tb"), F.sum("ns").alias("ts"))
    src = per.join(small_or_plain(tot), group).withColumn("_h", order_hash(F.col("speaker_id"), seed))
    names = np.array(["train", *[s for s in fracs if s != "train"]])
    share = np.array([[fracs[s]] for s in names[1:]])

    def step(pdf: pd.DataFrame, fill):
        fill = np.zeros((len(share), 2)) if fill is None else fill
        totals = pdf[["tb", "ts"]].to_numpy(float)[0]
        quota, there = share * totals, totals > 0
        chosen = []
        for counts in pdf[["nb", "ns"]].to_numpy(float):
            after = fill + counts
            closed = (after > 1.5 * quota)[:, there].any(axis=1)
            gain = np.where(closed, 0.0, (np.clip(quota - fill, 0, counts) / np.maximum(totals, 1))[:, there].sum(axis=1))
            best = int(gain.argmax()) if len(gain) and gain.max() > 0 else -1
            if best >= 0:
                fill[best] = after[best]
            chosen.append(best + 1)
        return pdf[[group, "speaker_id"]].assign(split=names[chosen]), fill

    schema = T.StructType([src.schema[group], src.schema["speaker_id"], T.StructField("split", T.StringType())])
    return fold_sorted(src, [group], ["_h", "speaker_id"], step, schema)


def corpus_hours(rows: DataFrame) -> DataFrame:
    """Hours by language, family and codec, with the grand total (NULL keys)."""
    from sonorisk.functions.identity import codec_key

    r = rows.select(
        "language", F.when(F.col("label") == "spoof", F.coalesce("generator_family", F.lit("?"))).otherwise("bona_fide").alias("family"), codec_key(F.col("codec_chain")).alias("codec"), "duration_s", "label"
    )
    g = r.groupingSets([[F.col("language"), F.col("family"), F.col("codec")], []], F.col("language"), F.col("family"), F.col("codec"))
    return g.agg(
        (F.sum("duration_s") / 3600).alias("hours"),
        (F.sum(F.when(F.col("label") == "spoof", F.col("duration_s")).otherwise(0.0)) / 3600).alias("spoof_hours"),
        F.count(F.lit(1)).alias("n_utts"),
    )


def import_report(rows: DataFrame) -> DataFrame:
    """Counts per split: classes, speakers, and mean duration."""
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("label") == "bona_fide").cast("long")).alias("bona_fide"),
        F.sum((F.col("label") == "spoof").cast("long")).alias("spoof"),
        F.countDistinct("speaker_id").alias("speakers"),
        F.countDistinct("generator_family").alias("generators"),
        F.avg("duration_s").alias("mean_duration_s"),
    )


def source_speaker_leaks(rows: DataFrame) -> DataFrame:
    """Converted rows whose source speaker sits in another split than the row."""
    where = rows.select(F.col("speaker_id").alias("source_speaker"), F.col("split").alias("_s")).distinct()
    return rows.filter(F.col("source_speaker").isNotNull()).join(where, "source_speaker").filter(F.col("_s") != F.col("split")).drop("_s")


# ---- sampling ---------------------------------------------------------------------------------


def group_key() -> Column:
    return F.when(F.col("label") == "bona_fide", "bona_fide").otherwise(F.concat(F.lit("spoof:"), F.coalesce("generator_family", F.lit("-"))))


def ranked(rows: DataFrame, keys: Sequence[str], seed: int, id_col: str = "utt_id", name: str = "rank", limit: int | None = None) -> DataFrame:
    """(keys, id, rank): exact hash-order rank per group, carrying only ids through the shuffle."""
    ids = rows.select(*keys, id_col, order_hash(F.col(id_col), seed).alias("_h"))
    return ordered_index(ids, keys, ["_h", id_col], name, limit).drop("_h")


def first_ranked(rows: DataFrame, keys: Sequence[str], n: int, seed: int, id_col: str = "utt_id") -> DataFrame:
    """The first ``n`` of ``ranked`` per group.  Map tasks keep their own first ``n``, so only those are shuffled."""
    ids = rows.select(*keys, id_col, order_hash(F.col(id_col), seed).alias("_h"))
    r = ids.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("_h", id_col))).filter(F.col("rank") <= n)
    return r.withColumn("rank", F.col("rank").cast("long")).drop("_h")


def proportional_sample(rows: DataFrame, keys: Sequence[str], n: int, seed: int, id_col: str = "utt_id") -> DataFrame:
    """About n rows, each group proportional and at least one (group share rounded half to even)."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_g"))
    total = sizes.agg(F.sum("_g").alias("_t"))
    quota = sizes.join(F.broadcast(total)).withColumn("_k", F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_g") / F.col("_t")).cast("long")))
    r = ranked(rows, keys, seed, id_col)
    return r.join(small_or_plain(quota.select(*keys, "_k")), list(keys)).filter(F.col("rank") <= F.col("_k")).drop("_k")


def capped_sample(rows: DataFrame, keys: Sequence[str], cap: Column | int, seed: int, id_col: str = "utt_id") -> DataFrame:
    """At most ``cap`` rows per group (a cap column may depend on the group keys)."""
    c = F.lit(cap) if isinstance(cap, int) else cap
    return ranked(rows, keys, seed, id_col).filter(c.isNull() | (F.col("rank") <= c))


def replay_quotas(family_sizes: DataFrame, n_spoof: int) -> DataFrame:
    """Equal share per family with shortfall passed on to later families (families in name order).

    family_sizes: (family, size).  The remainder is carried through the families in one sorted stream of one row a
    family; ``leftover`` is what no family could take.
    """
    families = family_sizes.agg(F.count(F.lit(1))).first()[0]

    def step(pdf: pd.DataFrame, carried):
        left, waiting = carried or (n_spoof, families)
        quota = []
        for size in pdf["size"]:
            quota.append(min(left // waiting, int(size)))
            left, waiting = left - quota[-1], waiting - 1
        return pdf[["family"]].assign(quota=quota), (left, waiting)

    stream = family_sizes.select(F.lit(1).alias("all"), "family", "size")
    q = materialize(fold_sorted(stream, ["all"], ["family"], step, "family string, quota long"))
    return q.withColumn("leftover", F.lit(n_spoof - (q.agg(F.sum("quota")).first()[0] or 0)).cast("long"))


def replay_selection(rows: DataFrame, n_bona: int, n_spoof: int, seed: int, id_col: str = "utt_id") -> DataFrame:
    """Bona fide up to n_bona, spoof by family quota, then the leftover from the rest."""
    fam = rows.filter("label = 'spoof'").withColumn("family", F.coalesce("generator_family", F.lit("-")))
    q = replay_quotas(fam.groupBy("family").agg(F.count(F.lit(1)).alias("size")), n_spoof)
    r = ranked(fam, ["family"], seed, id_col).join(small_or_plain(q), "family")
    first = r.filter(F.col("rank") <= F.col("quota")).select(id_col, F.lit("quota").alias("reason"))
    rest = r.filter(F.col("rank") > F.col("quota")).select(id_col, "leftover", F.lit("rest").alias("_all"))
    fill = ranked(rest, ["_all", "leftover"], seed + 1, id_col).filter(F.col("rank") <= F.col("leftover")).select(id_col, F.lit("fill").alias("reason"))
    bona = ranked(rows.filter("label = 'bona_fide'").withColumn("_all", F.lit("b")), ["_all"], seed, id_col).filter(F.col("rank") <= n_bona)
    return bona.select(id_col, F.lit("bona").alias("reason")).unionByName(first).unionByName(fill)


def balanced_epoch(rows: DataFrame, num_samples: int, seed: int, id_col: str = "utt_id") -> DataFrame:
    """Half bona fide, the rest equal over families; short groups repeat their rows in turn.

    Each row is emitted as often as its group's quota asks (``sequence`` over repeats), so the
    repeats never meet in one task.
    """
    r = rows.withColumn("grp", group_key())
    sizes = r.groupBy("grp").agg(F.count(F.lit(1)).alias("_size"))
    fams = sizes.filter("grp <> 'bona_fide'")
    # the place of a family in name order says who gets the odd rows
    count = sizes.agg(F.count(F.when(F.col("grp") == "bona_fide", 1)).alias("bona"), F.count(F.when(F.col("grp") != "bona_fide", 1)).alias("fams")).first()
    n_bona = (num_samples // 2 if count.fams else num_samples) if count.bona else 0
    each, odd = divmod(num_samples - n_bona, max(1, count.fams))
    place = ordered_index(fams, [], ["grp"], "place")
    share = place.select("grp", "_size", (F.lit(each) + (F.col("place") <= odd).cast("long")).alias("quota"))
    q = share.unionByName(sizes.filter("grp = 'bona_fide'").select("grp", "_size", F.lit(n_bona).cast("long").alias("quota")))
    j = ranked(r, ["grp"], seed, id_col).join(small_or_plain(q), "grp")
    times = F.floor(F.col("quota") / F.col("_size")) + F.when(F.col("rank") <= F.col("quota") % F.col("_size"), 1).otherwise(0)
    return j.withColumn("_t", times).filter("_t > 0").select("grp", id_col, F.explode(F.sequence(F.lit(1), F.col("_t").cast("int"))).alias("draw"))


def sample_until(units: DataFrame, keys: Sequence[str], size: str, target: int, seed: int, id_col: str) -> DataFrame:
    """Units in hash order until ``target`` rows are reached (the unit that crosses is kept)."""
    u = units.withColumn("_h", order_hash(F.col(id_col), seed))
    run = prefix_sums(u, keys, ["_h", id_col], {"_run": size})
    return run.filter(F.col("_run") - F.col(size) < target).drop("_h", "_run")


# ---- plans ------------------------------------------------------------------------------------


def generation_plan(refs: DataFrame, generators: DataFrame, per_generator: int, seed: int) -> DataFrame:
    """Reference utterances per generator, and another speaker's utterance as conversion source.

    ``generators`` is registry-sized, so it is an array on each reference row.  Sources: speakers are
    put in hash order on a ring; a reference takes the first utterance of the next speaker, which
    always differs and needs no pairing of utterances.
    """
    g = generators.select(F.struct("name", "family", "kind", F.col("license").alias("g_license"), F.col("commercial_use").alias("g_commercial")).alias("g"))
    all_g = g.agg(F.collect_list("g").alias("_g"))
    r = refs.filter("label = 'bona_fide'").drop("source_speaker")
    x = r.join(F.broadcast(all_g)).withColumn("g", F.explode("_g")).drop("_g")
    x = x.withColumns({"generator": F.col("g.name"), "task_id": F.concat_ws("__", F.col("g.name"), F.col("utt_id"))})
    pick = first_ranked(x, ["generator"], per_generator, seed, "task_id").select("task_id", "rank")
    t = x.join(F.broadcast(pick) if per_generator <= MAX_PICKS else pick, "task_id")
    speakers = r.groupBy("speaker_id").agg(F.min("utt_id").alias("first_utt"))
    ring = ordered_index(speakers.withColumns({"_h": order_hash(F.col("speaker_id"), seed), "_k": F.lit(1)}), ["_k"], ["_h", "speaker_id"], "pos")
    n = ring.agg(F.max("pos").alias("_n"))
    nxt = ring.join(F.broadcast(n)).select((F.when(F.col("pos") == 1, F.col("_n")).otherwise(F.col("pos") - 1)).alias("pos"), F.col("first_utt").alias("source_utt"), F.col("speaker_id").alias("source_speaker"))
    src = ring.select("speaker_id", "pos").join(nxt, "pos").drop("pos")
    return t.join(src, "speaker_id", "left").withColumns(
        {"source_utt": F.when(F.col("g.kind") == "vc", F.col("source_utt")), "source_speaker": F.when(F.col("g.kind") == "vc", F.col("source_speaker"))}
    )


def derived_rows(plan: DataFrame) -> DataFrame:
    """Manifest rows of planned clones: lineage is the AND of both sides, the speaker is kept."""
    return plan.select(
        F.col("task_id").alias("utt_id"), F.lit("spoof").alias("label"), F.col("g.family").alias("generator_family"), F.col("g.name").alias("generator_name"), "language", "speaker_id",
        F.concat_ws(" + ", "license", "g.g_license").alias("license"), (F.col("commercial_use") & F.col("g.g_commercial")).alias("commercial_use"),
    )


# fixed values: channel step probabilities, codec weights and loss rates
CHANNEL_STEPS = (("rir", 0.3), ("noise", 0.6), ("agc", 0.3), ("ns", 0.3))
CODEC_WEIGHTS = {"amr_nb": 1.0, "clean": 1.0, "g711a": 1.0, "g711u": 2.0, "gsm": 0.5, "opus": 2.0}
LOSS_RATES = (0.01, 0.03, 0.05)
OPUS_KBPS = (6, 12, 16, 24)


def channel_plan(rows: DataFrame, copies: int, seed: int = 0, id_col: str = "utt_id") -> DataFrame:
    """Channel chain per utterance and copy, drawn from the utterance id only (never the label)."""
    x = rows.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    x = x.withColumn("copy_id", F.concat(F.col(id_col).cast("string"), F.lit("__ch"), F.col("copy").cast("string")))
    draw = lambda name: unit_hash(F.concat(F.col("copy_id"), F.lit(f":{name}")), seed)
    total, acc, codec = sum(CODEC_WEIGHTS.values()), 0.0, None
    u = F.col("_u_codec")
    for name, w in CODEC_WEIGHTS.items():
        acc += w
        codec = F.when(u < acc / total, name) if codec is None else codec.when(u < acc / total, name)
    codec = codec.otherwise(list(CODEC_WEIGHTS)[-1])
    pick = lambda vals, d: F.element_at(F.array(*[F.lit(str(v)) for v in vals]), (F.floor(d * len(vals)) + 1).cast("int"))
    x = x.withColumn("_u_codec", draw("codec")).withColumn("codec", codec)
    steps = [F.when(draw(n) < p, F.lit(n)) for n, p in CHANNEL_STEPS]
    coded = F.when(F.col("codec") == "opus", F.concat(F.lit("codec:opus"), pick(OPUS_KBPS, draw("kbps")))).when(F.col("codec") != "clean", F.concat(F.lit("codec:"), F.col("codec")))
    loss = F.when(draw("loss") < 0.5, F.concat(F.lit("loss:"), pick(LOSS_RATES, draw("rate"))))
    jitter = F.when(draw("jitter") < 0.2, F.lit("jitter"))
    chain = F.filter(F.array(*steps, coded, loss, jitter), lambda s: s.isNotNull())
    return x.select(id_col, "copy", "copy_id", chain.alias("codec_chain"))
