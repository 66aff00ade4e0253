"""Queries: manifests, gates, splits, sampling and corpus plans over the document table."""

from pyspark.sql import functions as F

from sonorisk.functions.math import r6
from sonorisk.operators import corpus as C
from sonorisk.plans.fixtures import cte, sql, table
from sonorisk.plans.registry import query
from sonorisk.sources import manifest as M
from sonorisk.scale import literal_table

CHAINS = [["codec:g711u", "noise:10"], ["codec:opus"], ["noise:5"], []]
_CH_SQL = "[" + ", ".join("[" + ", ".join(f"'{c}'" for c in ch) + "]" for ch in CHAINS) + "]"
cte(
    "mani",
    f"""SELECT 'u' || doc_id AS utt_id, doc_id, CASE WHEN doc_id % 3 = 1 THEN 'spoof' ELSE 'bona_fide' END AS label, CASE WHEN doc_id % 3 = 1 THEN 'fam' || (doc_id % 4) END AS generator_family,
    lang AS language, 'spk' || (doc_id * 7 % 211) AS speaker_id, source AS source_corpus, 'lic' || (doc_id % 3) AS license, doc_id % 5 <> 0 AS commercial_use, {_CH_SQL}[doc_id % 4 + 1] AS codec_chain,
    n_chars / 64.0 AS duration_s, CASE WHEN doc_id % 6 = 1 THEN 'spk' || (doc_id % 211) END AS source_speaker FROM documents""",
)
cte("registry", "SELECT name, CASE WHEN name <> 'src5' THEN length(name) = 5 END AS commercial_use, name IN ('src3', 'src7') AS eval_only FROM (SELECT DISTINCT source AS name FROM documents WHERE source <> 'src19')")


def manifest(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    chains = F.array(*[F.array(*[F.lit(x) for x in c]).cast("array<string>") for c in CHAINS])
    return d.select(
        F.concat(F.lit("u"), s(i)).alias("utt_id"), i, F.when(i % 3 == 1, "spoof").otherwise("bona_fide").alias("label"),
        F.when(i % 3 == 1, F.concat(F.lit("fam"), s(i % 4))).alias("generator_family"), F.col("lang").alias("language"), F.concat(F.lit("spk"), s(i * 7 % 211)).alias("speaker_id"),
        F.col("source").alias("source_corpus"), F.concat(F.lit("lic"), s(i % 3)).alias("license"), (i % 5 != 0).alias("commercial_use"), F.element_at(chains, (i % 4 + 1).cast("int")).alias("codec_chain"),
        (F.col("n_chars") / 64.0).alias("duration_s"), F.when(i % 6 == 1, F.concat(F.lit("spk"), s(i % 211))).alias("source_speaker"),
    )


def registry(spark, sf):
    n = table(spark, sf, "documents").filter("source <> 'src19'").select(F.col("source").alias("name")).distinct()
    return n.select("name", F.when(F.col("name") != "src5", F.length("name") == 5).alias("commercial_use"), F.col("name").isin("src3", "src7").alias("eval_only"))


# ---- sources ----------------------------------------------------------------------------------


def manifest_lines(spark, sf):
    """JSONL lines of manifest rows, some broken on purpose."""
    m = manifest(spark, sf)
    i = F.col("doc_id")
    full = m.select(
        i,
        F.struct(
            "utt_id", F.lit("a.flac").alias("path"), "label", F.when(i % 41 == 1, F.lit(None)).otherwise(F.col("generator_family")).alias("generator_family"), "language", "speaker_id", "source_corpus", "license",
            "commercial_use", "codec_chain", F.when(i % 37 == 0, -1.0).otherwise(F.col("duration_s")).alias("duration_s"), F.lit(16000).alias("sample_rate"), F.when(i % 29 == 0, "x").alias("colour"),
        ).alias("r"),
    )
    line = F.when(i % 53 == 0, "{broken").otherwise(F.to_json("r"))
    return full.select(line.alias("value"))


@query(
    "SRC01",
    sql(
        """SELECT problems, count(*) AS n FROM (SELECT CASE WHEN doc_id % 53 = 0 THEN 'not a JSON object' ELSE array_to_string(list_filter([CASE WHEN doc_id % 29 = 0 THEN 'unknown field colour' END,
        CASE WHEN doc_id % 37 = 0 OR duration_s <= 0 THEN 'duration_s' END, CASE WHEN doc_id % 41 = 1 AND label = 'spoof' THEN 'spoof without generator_family' END], lambda x: x IS NOT NULL), ',') END AS problems FROM mani) GROUP BY 1""",
        "mani",
    ),
)
def src01(spark, sf):
    p = M.parse_manifest_lines(manifest_lines(spark, sf))
    return p.groupBy(F.array_join("problems", ",").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


@query("SRC02", "SELECT 'u' || (doc_id % 900) AS utt_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def src02(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("u"), (F.col("doc_id") % 900).cast("string")).alias("utt_id"))
    return M.duplicate_ids(d).withColumnRenamed("count", "n")


@query("SRC03", sql("SELECT language, count(*) AS n FROM mani GROUP BY 1", "mani"))
def src03(spark, sf):
    from sonorisk.scale import shared_path

    path = shared_path(spark, "manifest")
    M.write_manifest(manifest(spark, sf), path)
    return spark.read.json(path).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


_CODEC = "['-', 'g711', 'opus', 'amr'][l_linenumber % 4 + 1]"
cte(
    "proto",
    f"""SELECT 'S' || l_suppkey AS spk, 'U' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS utt, ['F', 'M', '-'][l_partkey % 3 + 1] AS g, {_CODEC} AS c, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE CAST(l_linenumber AS VARCHAR) END AS q,
    CASE WHEN l_partkey % 4 = 0 THEN '-' ELSE 'tag' || (l_partkey % 4) END AS tag, 'A' || (l_partkey % 7) AS att, CASE WHEN l_returnflag = 'R' THEN 'spoof' ELSE 'bonafide' END AS key FROM lineitem""",
)


def protocol(spark, sf):
    li = table(spark, sf, "lineitem")
    s = lambda c: c.cast("string")
    pick = lambda vals, k: F.element_at(F.array(*[F.lit(v) for v in vals]), (k + 1).cast("int"))
    return li.select(
        F.concat(F.lit("S"), s(F.col("l_suppkey"))).alias("spk"), F.concat_ws("_", F.concat(F.lit("U"), s(F.col("l_orderkey"))), s(F.col("l_linenumber")), s(F.col("l_partkey"))).alias("utt"),
        pick(["F", "M", "-"], F.col("l_partkey") % 3).alias("g"), pick(["-", "g711", "opus", "amr"], F.col("l_linenumber") % 4).alias("c"),
        F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise(s(F.col("l_linenumber"))).alias("q"), F.when(F.col("l_partkey") % 4 == 0, "-").otherwise(F.concat(F.lit("tag"), s(F.col("l_partkey") % 4))).alias("tag"),
        F.concat(F.lit("A"), s(F.col("l_partkey") % 7)).alias("att"), F.when(F.col("l_returnflag") == "R", "spoof").otherwise("bonafide").alias("key"),
    )


@query(
    "SRC04",
    sql(
        """SELECT 'asv5_' || utt AS utt_id, CASE WHEN key = 'spoof' THEN 'spoof' ELSE 'bona_fide' END AS label, CASE WHEN key = 'spoof' THEN att END AS generator_family, CASE WHEN key = 'spoof' THEN CASE WHEN tag <> '-' THEN att || '/' || tag ELSE att END END AS generator_name,
        CASE g WHEN 'F' THEN 'female' WHEN 'M' THEN 'male' ELSE 'unknown' END AS gender, 'asv5_' || spk AS speaker_id, CASE WHEN c = '-' THEN '' ELSE 'codec:' || c || CASE WHEN q <> '-' THEN 'q' || q ELSE '' END END AS codecs FROM proto""",
        "proto",
    ),
)
def src04(spark, sf):
    lines = protocol(spark, sf).select(F.concat_ws("  ", "spk", "utt", "g", "c", "q", F.lit("seed"), "tag", "att", "key", F.lit("-")).alias("value"))
    r = M.import_wide_protocol(lines)
    return r.select("utt_id", "label", "generator_family", "generator_name", "gender", "speaker_id", F.array_join("codec_chain", ",").alias("codecs"))


@query("SRC05", sql("SELECT 'asv19la_' || utt AS utt_id, CASE WHEN key = 'spoof' THEN 'spoof' ELSE 'bona_fide' END AS label, CASE WHEN key = 'spoof' THEN att END AS generator_family, 'asv19la_' || spk AS speaker_id FROM proto", "proto"))
def src05(spark, sf):
    lines = protocol(spark, sf).select(F.concat_ws(" ", "spk", "utt", F.lit("-"), "att", "key").alias("value"))
    return M.import_narrow_protocol(lines).select("utt_id", "label", "generator_family", "speaker_id")


@query(
    "SRC06",
    """SELECT 'isyn_hi_' || substr(sha256('unit' || (doc_id % 7) || ':' || doc_id), 1, 12) AS utt_id, 'spoof' AS label, 'model' || (doc_id % 3) AS generator_family, CASE doc_id % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'unknown' END AS gender,
    'kb_hi_' || (doc_id % 40) AS speaker_id, round(round_even(n_chars / 100.0, 3), 6) AS duration_s FROM documents WHERE doc_id % 11 <> 0 AND n_chars >= 100
    UNION ALL SELECT 'kb_hi_f' || doc_id, 'bona_fide', NULL, CASE doc_id % 2 WHEN 0 THEN 'female' ELSE 'male' END, CASE WHEN doc_id % 9 = 0 THEN 'kb_hi_x' || doc_id ELSE 'kb_hi_' || (doc_id % 30) END, round(round_even(n_chars / 100.0, 3), 6) FROM documents WHERE n_chars >= 100""",
)
def src06(spark, sf):
    d = table(spark, sf, "documents")
    i, s = F.col("doc_id"), lambda c: c.cast("string")
    syn = d.select(
        F.concat(F.lit("unit"), s(i % 7)).alias("unit"), i.alias("row"), F.concat(F.lit(" Model"), s(i % 3), F.lit(" ")).alias("model"), F.concat(s(i % 40), F.lit(".0")).alias("target_speaker"), s(i % 50).alias("source_speaker"),
        F.when(i % 3 == 0, "F").when(i % 3 == 1, " Male").alias("gender"), (F.col("n_chars") / 100.0).alias("seconds"), (i % 11 != 0).alias("has_audio"),
    )
    nat = d.select(
        F.concat(F.lit("dir/f"), s(i), F.lit(".wav")).alias("fname"), F.when(i % 9 == 0, F.concat(F.lit("x"), s(i))).otherwise(s(i % 30)).alias("speaker"), F.when(i % 2 == 0, "female").otherwise("m").alias("gender"),
        (F.col("n_chars") / 100.0).alias("seconds"), F.lit(True).alias("has_audio"),
    )
    return M.import_corpora(syn, nat, "hi").select("utt_id", "label", "generator_family", "gender", "speaker_id", r6(F.col("duration_s")).alias("duration_s"))


@query("SRC07", "SELECT DISTINCT l_orderkey % 5000 AS utt_id FROM lineitem WHERE l_suppkey % 10 > 3")
def src07(spark, sf):
    c = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("part"), (F.col("l_orderkey") % 5000).alias("utt_id"))
    done = table(spark, sf, "supplier").select((F.col("s_suppkey") % 4).alias("part"))
    return M.new_parts(c, done).select("utt_id")


@query("SRC08", sql("SELECT name, 'missing commercial_use' AS problem FROM registry WHERE commercial_use IS NULL UNION ALL SELECT name, 'duplicate name' FROM (SELECT name FROM registry UNION ALL SELECT name FROM registry WHERE name IN ('src1', 'src2')) GROUP BY 1 HAVING count(*) > 1", "registry"))
def src08(spark, sf):
    r = registry(spark, sf)
    return M.registry_problems(r.unionByName(r.filter("name in ('src1', 'src2')")))


@query("SRC09")
def src09(spark, sf):
    files = spark.createDataFrame([("tpch", "region.parquet", None), ("tpch", "nation.parquet", "0" * 64), ("tpch", "absent.parquet", "0" * 64)], "dataset string, name string, sha256 string")
    found = M.file_hashes(spark, sf, "*.parquet")
    pinned = found.select(F.lit("all").alias("dataset"), "name", "sha256")
    return M.verify_files(files.unionByName(pinned), found).select("dataset", "name", "status")


# ---- gates ------------------------------------------------------------------------------------

cte(
    "viol",
    """SELECT utt_id, 'not_in_registry' AS problem FROM mani WHERE source_corpus = 'src19' UNION ALL SELECT utt_id, 'eval_only' FROM mani WHERE source_corpus IN ('src3', 'src7')
    UNION ALL SELECT m.utt_id, 'non_commercial' FROM mani m JOIN registry r ON r.name = m.source_corpus WHERE NOT (m.commercial_use AND r.commercial_use)""",
    "mani", "registry",
)


@query("FLT05", sql("SELECT utt_id, problem FROM viol", "viol"))
def flt05(spark, sf):
    return C.license_violations(manifest(spark, sf), registry(spark, sf), allow_noncommercial=False)


@query("TOP12", sql("SELECT utt_id, problem, n_problems FROM (SELECT *, count(*) OVER () AS n_problems FROM viol) ORDER BY utt_id, problem LIMIT 20", "viol"))
def top12(spark, sf):
    v = C.license_violations(manifest(spark, sf), registry(spark, sf), allow_noncommercial=False)
    n = v.agg(F.count(F.lit(1)).alias("n_problems"))
    return v.orderBy("utt_id", "problem").limit(20).join(F.broadcast(n))


@query("FLT06", "SELECT lineage, allow, CASE WHEN lineage = 'commercial' AND allow THEN 'refused' ELSE 'ok' END AS outcome, n FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'commercial' ELSE 'research' END AS lineage, doc_id % 3 = 0 AS allow, count(*) AS n FROM documents GROUP BY 1, 2)")
def flt06(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 2 == 0, "commercial").otherwise("research").alias("lineage"), (F.col("doc_id") % 3 == 0).alias("allow"))
    bad = (F.col("lineage") == "commercial") & F.col("allow")
    return d.groupBy("lineage", "allow").agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.when(bad, "refused").otherwise("ok"))


@query("FLT07", sql("SELECT utt_id, source_corpus IN ('src1', 'src2') OR speaker_id IN (SELECT 'spk' || k FROM (SELECT DISTINCT s_suppkey AS k FROM supplier) WHERE k % 3 = 0 OR k % 5 = 0) AS allowed FROM mani", "mani"))
def flt07(spark, sf):
    corpora = registry(spark, sf).filter("name in ('src1', 'src2')").select("name")
    k = F.col("s_suppkey")
    sp = table(spark, sf, "supplier").select(
        F.concat(F.lit("spk"), k.cast("string")).alias("speaker_id"), F.when(k % 3 == 0, F.lit("2030-01-01")).when(k % 5 == 0, F.lit(None)).otherwise(F.lit("2020-01-01")).cast("date").alias("expires")
    )
    return C.consent_flags(manifest(spark, sf), corpora, sp, F.lit("2026-01-01").cast("date")).select("utt_id", "allowed")


# ---- splits -----------------------------------------------------------------------------------

_U = "CAST(('0x' || substr(sha256('1337:' || m.speaker_id), 1, 16)) AS UHUGEINT) / 18446744073709551616.0"
cte(
    "split",
    f"""SELECT m.*, CASE WHEN m.speaker_id IN (SELECT speaker_id FROM mani WHERE source_corpus IN ('src3', 'src7') OR generator_family = 'fam3') OR {_U} < 0.1 THEN 'eval' WHEN {_U} < 0.2 THEN 'dev' ELSE 'train' END AS split FROM
    (SELECT * FROM mani) m""",
    "mani",
)


def split_rows(spark, sf):
    return C.assign_splits(manifest(spark, sf), registry(spark, sf), ["fam3"])


@query("FN11", sql("SELECT utt_id, speaker_id, split FROM split", "split"))
def fn11(spark, sf):
    return split_rows(spark, sf).select("utt_id", "speaker_id", "split")


@query("SET02", sql("SELECT speaker_id, string_agg(DISTINCT s, ',' ORDER BY s) AS splits FROM (SELECT speaker_id, CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'eval' END AS s FROM mani) GROUP BY 1 HAVING count(DISTINCT s) > 1", "mani"))
def set02(spark, sf):
    # a row-wise split leaks speakers; the check must find exactly those
    m = manifest(spark, sf).withColumn("split", F.when(F.col("doc_id") % 10 < 7, "train").otherwise("eval"))
    return C.leaking_speakers(m).select("speaker_id", F.array_join("splits", ",").alias("splits"))


@query("JON19", sql("SELECT utt_id FROM mani WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", "mani"))
def jon19(spark, sf):
    ids = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return manifest(spark, sf).join(ids, "doc_id", "left_semi").select("utt_id")


@query("JON15", sql("SELECT DISTINCT s.utt_id FROM split s JOIN split t ON t.speaker_id = s.source_speaker WHERE t.split <> s.split", "split"))
def jon15(spark, sf):
    return C.source_speaker_leaks(split_rows(spark, sf)).select("utt_id").distinct()


@query("AGG27", sql("SELECT language, family, codec, round(sum(duration_s) / 3600, 6) AS hours, round(sum(CASE WHEN label = 'spoof' THEN duration_s ELSE 0 END) / 3600, 6) + 0.0 AS spoof_hours, count(*) AS n_utts FROM (SELECT language, label, duration_s, CASE WHEN label = 'spoof' THEN generator_family ELSE 'bona_fide' END AS family, coalesce(nullif(array_to_string(list_transform(list_filter(codec_chain, lambda c: starts_with(c, 'codec:')), lambda c: substr(c, 7)), '+'), ''), 'clean') AS codec FROM mani) GROUP BY GROUPING SETS ((language, family, codec), ())", "mani"))
def agg27(spark, sf):
    h = C.corpus_hours(manifest(spark, sf))
    return h.select("language", "family", "codec", r6(F.col("hours")).alias("hours"), r6(F.col("spoof_hours")).alias("spoof_hours"), "n_utts")


@query("AGG28", sql("SELECT split, count(*) AS n, count(*) FILTER (label = 'bona_fide') AS bona_fide, count(*) FILTER (label = 'spoof') AS spoof, count(DISTINCT speaker_id) AS speakers, count(DISTINCT generator_family) AS generators, round(avg(duration_s), 6) AS mean_duration_s FROM split GROUP BY 1", "split"))
def agg28(spark, sf):
    r = C.import_report(split_rows(spark, sf))
    return r.withColumn("mean_duration_s", r6(F.col("mean_duration_s")))


def _gain(s):
    return f"((CASE WHEN tb > 0 THEN least(nb, greatest(0, 0.1 * tb - r.{s}b)) / greatest(tb, 1) ELSE 0 END) + (CASE WHEN ts > 0 THEN least(ns, greatest(0, 0.1 * ts - r.{s}s)) / greatest(ts, 1) ELSE 0 END))"


def _full(s):
    return f"((tb > 0 AND r.{s}b + nb > 1.5 * (0.1 * tb)) OR (ts > 0 AND r.{s}s + ns > 1.5 * (0.1 * ts)))"


_PICK = f"CASE WHEN NOT {_full('e')} AND {_gain('e')} > CASE WHEN {_full('d')} THEN 0 ELSE {_gain('d')} END THEN 'eval' WHEN NOT {_full('d')} AND {_gain('d')} > 0 THEN 'dev' ELSE 'train' END"
GREEDY_SQL = f""", sp AS (SELECT *, sum(nb) OVER (PARTITION BY language) AS tb, sum(ns) OVER (PARTITION BY language) AS ts, row_number() OVER (PARTITION BY language ORDER BY sha256('1337:' || speaker_id), speaker_id) AS rn FROM (
  SELECT language, language || '_' || speaker_id AS speaker_id, count(*) FILTER (label = 'bona_fide') AS nb, count(*) FILTER (label = 'spoof') AS ns FROM mani GROUP BY 1, 2)),
 r AS (SELECT language, CAST(0 AS BIGINT) AS rn, '' AS speaker_id, '' AS split, CAST(0 AS HUGEINT) AS db, CAST(0 AS HUGEINT) AS ds, CAST(0 AS HUGEINT) AS eb, CAST(0 AS HUGEINT) AS es FROM (SELECT DISTINCT language FROM sp)
  UNION ALL SELECT language, rn, speaker_id, split, db + CASE WHEN split = 'dev' THEN nb ELSE 0 END, ds + CASE WHEN split = 'dev' THEN ns ELSE 0 END, eb + CASE WHEN split = 'eval' THEN nb ELSE 0 END, es + CASE WHEN split = 'eval' THEN ns ELSE 0 END FROM (
    SELECT sp.language, sp.rn, sp.speaker_id, sp.nb, sp.ns, r.db, r.ds, r.eb, r.es, {_PICK} AS split FROM r JOIN sp ON sp.language = r.language AND sp.rn = r.rn + 1))
 SELECT language, speaker_id, split FROM r WHERE rn > 0"""


@query("JOB19", sql("@@", "mani").replace("WITH ", "WITH RECURSIVE ", 1).replace("@@", GREEDY_SQL))
def job19(spark, sf):
    m = manifest(spark, sf).withColumn("speaker_id", F.concat_ws("_", "language", "speaker_id"))
    return C.greedy_speaker_splits(m, "language", {"train": 0.8, "dev": 0.1, "eval": 0.1}, 1337)


@query("SET06", sql("SELECT DISTINCT a.f AS held_out, b.f AS train_family FROM (SELECT DISTINCT generator_family AS f FROM mani WHERE generator_family IS NOT NULL) a JOIN (SELECT DISTINCT generator_family AS f FROM mani WHERE generator_family IS NOT NULL) b ON a.f <> b.f", "mani"))
def set06(spark, sf):
    from sonorisk.operators.protocols import held_out_folds

    return held_out_folds(manifest(spark, sf), "generator_family")


@query("SET05", sql("SELECT condition, count(*) AS n FROM (SELECT 'clean' AS condition FROM mani UNION ALL SELECT 'spoof_only' FROM mani WHERE label = 'spoof' UNION ALL SELECT 'codec' FROM mani) GROUP BY 1", "mani"))
def set05(spark, sf):
    from sonorisk.operators.protocols import stack_conditions

    m = manifest(spark, sf).select("utt_id", "label")
    return stack_conditions({"clean": m, "spoof_only": m.filter("label = 'spoof'"), "codec": m}).groupBy("condition").agg(F.count(F.lit(1)).alias("n"))


# ---- samples ----------------------------------------------------------------------------------

_G = "CASE WHEN label = 'bona_fide' THEN 'bona_fide' ELSE 'spoof:' || generator_family END"
_CK = "coalesce(nullif(array_to_string(list_filter(codec_chain, lambda c: starts_with(c, 'codec:')), '+'), ''), 'none')"
cte("rk", f"SELECT *, {_G} AS grp, {_CK} AS codec FROM mani", "mani")


def _rk(keys, seed):
    return f"row_number() OVER (PARTITION BY {keys} ORDER BY sha256('{seed}:' || utt_id), utt_id)"


def strata(spark, sf):
    m = manifest(spark, sf)
    codec = F.coalesce(F.nullif(F.array_join(F.filter("codec_chain", lambda c: c.startswith("codec:")), "+"), F.lit("")), F.lit("none"))
    return m.withColumns({"grp": C.group_key(), "codec": codec, "family": F.coalesce("generator_family", F.lit("-"))})


@query("TOP05", sql(f"SELECT label, family, codec, utt_id FROM (SELECT label, coalesce(generator_family, '-') AS family, codec, utt_id, {_rk('label, generator_family, codec', 3)} AS r, greatest(1, round_even(200.0 * count(*) OVER (PARTITION BY label, generator_family, codec) / count(*) OVER (), 0)) AS k FROM rk) WHERE r <= k", "rk"))
def top05(spark, sf):
    return C.proportional_sample(strata(spark, sf), ["label", "family", "codec"], 200, 3).select("label", "family", "codec", "utt_id")


@query("TOP06", sql(f"SELECT label, utt_id FROM (SELECT label, utt_id, {_rk('label', 5)} AS r FROM rk) WHERE r <= 50", "rk"))
def top06(spark, sf):
    return C.capped_sample(manifest(spark, sf), ["label"], 50, 5).select("label", "utt_id")


@query("TOP07", sql(f"SELECT grp, utt_id FROM (SELECT grp, utt_id, {_rk('grp', 7)} AS r FROM rk) WHERE r <= CASE WHEN grp = 'bona_fide' THEN 120 ELSE 30 END", "rk"))
def top07(spark, sf):
    return C.capped_sample(strata(spark, sf), ["grp"], F.when(F.col("grp") == "bona_fide", 120).otherwise(30), 7).select("grp", "utt_id")


@query(
    "TOP08",
    sql(
        f"""SELECT utt_id, reason FROM (SELECT utt_id, 'bona' AS reason FROM (SELECT utt_id, {_rk('label', 9)} AS r FROM mani WHERE label = 'bona_fide') WHERE r <= 100
        UNION ALL SELECT utt_id, 'quota' FROM (SELECT utt_id, generator_family, {_rk('generator_family', 9)} AS r FROM mani WHERE label = 'spoof') WHERE r <= 40)""",
        "mani",
    ),
)
def top08(spark, sf):
    # 160 spoof rows over four families of more than 40 rows each: every family gives 40
    return C.replay_selection(manifest(spark, sf), 100, 160, 9).select("utt_id", "reason")


@query("TOP09", sql(f"SELECT grp, utt_id FROM (SELECT grp, utt_id, {_rk('grp', 11)} AS r FROM rk) WHERE r <= 25", "rk"))
def top09(spark, sf):
    return C.capped_sample(strata(spark, sf), ["grp"], 25, 11).select("grp", "utt_id")


@query(
    "TOP10",
    sql(
        f"""SELECT grp, utt_id, draw FROM (SELECT grp, utt_id, unnest(range(1, CAST(q // sz + CASE WHEN r <= q % sz THEN 1 ELSE 0 END AS BIGINT) + 1)) AS draw FROM (
        SELECT grp, utt_id, {_rk('grp', 13)} AS r, count(*) OVER (PARTITION BY grp) AS sz, CASE WHEN grp = 'bona_fide' THEN 601 ELSE 150 + CASE WHEN grp = 'spoof:fam0' THEN 1 ELSE 0 END END AS q FROM rk))""",
        "rk",
    ),
)
def top10(spark, sf):
    # 1,202 draws: 601 bona fide, 601 over four families (the first one takes the odd row)
    return C.balanced_epoch(manifest(spark, sf), 1202, 13)


@query("TOP11", "SELECT s_suppkey, n FROM (SELECT *, sum(n) OVER (ORDER BY sha256('17:' || s_suppkey), s_suppkey) AS run FROM (SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem GROUP BY 1)) WHERE run - n < 20000")
def top11(spark, sf):
    u = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    return C.sample_until(u, [], "n", 20000, 17, "s_suppkey")


# ---- plans ------------------------------------------------------------------------------------

GENS = [("xtts", "tts_xtts", "tts", "CPML", False), ("openvc", "vc_open", "vc", "MIT", True)]


def plan(spark, sf):
    g = literal_table(spark, GENS, "name string, family string, kind string, license string, commercial_use boolean")
    return C.generation_plan(manifest(spark, sf), g, 150, 21)


cte(
    "gplan",
    """SELECT * FROM (SELECT m.*, g.name, g.family, g.kind, g.lic AS g_lic, g.com, g.name || '__' || utt_id AS task_id, row_number() OVER (PARTITION BY g.name ORDER BY sha256('21:' || g.name || '__' || utt_id), g.name || '__' || utt_id) AS r
    FROM mani m, (VALUES ('xtts', 'tts_xtts', 'tts', 'CPML', false), ('openvc', 'vc_open', 'vc', 'MIT', true)) g(name, family, kind, lic, com) WHERE label = 'bona_fide') WHERE r <= 150""",
    "mani",
)
cte("ring", "SELECT *, row_number() OVER (ORDER BY sha256('21:' || speaker_id), speaker_id) AS pos, count(*) OVER () AS n FROM (SELECT speaker_id, min(utt_id) AS first_utt FROM mani WHERE label = 'bona_fide' GROUP BY 1)", "mani")


@query(
    "JON16",
    sql("SELECT task_id, name AS generator, CASE WHEN kind = 'vc' THEN b.first_utt END AS source_utt, CASE WHEN kind = 'vc' THEN b.speaker_id <> p.speaker_id END AS other_speaker FROM gplan p JOIN ring a ON a.speaker_id = p.speaker_id JOIN ring b ON b.pos = a.pos % a.n + 1", "gplan", "ring"),
)
def jon16(spark, sf):
    return plan(spark, sf).select("task_id", "generator", "source_utt", (F.col("source_speaker") != F.col("speaker_id")).alias("other_speaker"))


@query("FN37", sql("SELECT task_id AS utt_id, family AS generator_family, speaker_id, license || ' + ' || g_lic AS license, commercial_use AND com AS commercial_use FROM gplan", "gplan"))
def fn37(spark, sf):
    return C.derived_rows(plan(spark, sf)).select("utt_id", "generator_family", "speaker_id", "license", "commercial_use")


def _u(name):
    return f"(CAST(('0x' || substr(sha256('0:' || cid || ':{name}'), 1, 16)) AS UHUGEINT) / 18446744073709551616.0)"


def _codec_sql():
    acc, tot, out = 0.0, sum(C.CODEC_WEIGHTS.values()), "CASE "
    for k, w in C.CODEC_WEIGHTS.items():
        acc += w
        out += f"WHEN {_u('codec')} < CAST({acc!r} AS DOUBLE) / {tot!r} THEN '{k}' "
    return out + "ELSE 'opus' END"


@query(
    "SIG06",
    sql(
        f"""SELECT copy_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {_u(n)} < {p} THEN '{n}' END" for n, p in C.CHANNEL_STEPS)},
        CASE codec WHEN 'opus' THEN 'codec:opus' || ['6', '12', '16', '24'][CAST(floor({_u('kbps')} * 4) AS INT) + 1] WHEN 'clean' THEN NULL ELSE 'codec:' || codec END,
        CASE WHEN {_u('loss')} < 0.5 THEN 'loss:' || ['0.01', '0.03', '0.05'][CAST(floor({_u('rate')} * 3) AS INT) + 1] END, CASE WHEN {_u('jitter')} < 0.2 THEN 'jitter' END], lambda x: x IS NOT NULL), '|') AS chain
        FROM (SELECT *, {_codec_sql()} AS codec FROM (SELECT utt_id || '__ch' || k AS copy_id, utt_id || '__ch' || k AS cid FROM mani, (VALUES (0), (1)) c(k)))""",
        "mani",
    ),
)
def sig06(spark, sf):
    return C.channel_plan(manifest(spark, sf), 2).select("copy_id", F.array_join("codec_chain", "|").alias("chain"))


ROLES = ["CFO", "CEO", "managing director", "director", "COO", "chairman"]


@query(
    "SRC18",
    """SELECT item_id AS template_id, count(*) AS n, min(length(t)) AS min_len FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sha256('7:' || t), t) AS r FROM (SELECT DISTINCT item_id,
    replace(replace(text || CASE WHEN item_id % 2 = 0 THEN ' the {role} wants {amount}' ELSE ' ask the {role}' END, '{role}', r.v), '{amount}', a.v) AS t FROM benchmark,
    (SELECT unnest(['CFO', 'CEO', 'managing director', 'director', 'COO', 'chairman']) AS v) r, (SELECT DISTINCT o_orderpriority AS v FROM orders) a)) WHERE r <= 22 GROUP BY 1""",
)
def src18(spark, sf):
    i = F.col("item_id")
    t = table(spark, sf, "benchmark").select(i.alias("template_id"), F.concat("text", F.when(i % 2 == 0, " the {role} wants {amount}").otherwise(" ask the {role}")).alias("text"))
    slots = {"role": spark.createDataFrame([(r,) for r in ROLES], "value string"), "amount": table(spark, sf, "orders").select(F.col("o_orderpriority").alias("value")).distinct()}
    return M.expand_templates(t, slots, 22, 7).groupBy("template_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("text")).alias("min_len"))
