"""Corpus manifests: strict JSONL read and write, protocol and corpus importers, registry checks."""

from __future__ import annotations

import ctypes
import math
import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sonorisk.functions.identity import order_hash
from sonorisk.scale import literal_table

PIECE_OF_FILE = 128 << 20  # a longer file is hashed piece by piece

MANIFEST = T.StructType(
    [
        T.StructField("utt_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("generator_family", T.StringType()),
        T.StructField("generator_name", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("accent", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("speaker_id", T.StringType()),
        T.StructField("source_corpus", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("commercial_use", T.BooleanType()),
        T.StructField("codec_chain", T.ArrayType(T.StringType())),
        T.StructField("snr_db", T.DoubleType()),
        T.StructField("rir_id", T.StringType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("sample_rate", T.IntegerType()),
    ]
)
FIELDS = [f.name for f in MANIFEST.fields]
REQUIRED = ("utt_id", "path", "label", "language", "speaker_id", "source_corpus", "license", "commercial_use", "duration_s", "sample_rate")


def row_problems() -> Column:
    """Reasons a manifest row breaks its contract; empty when it is valid."""
    c = F.col
    rules = [
        *[F.when(c(f).isNull(), F.lit(f"missing {f}")) for f in REQUIRED],
        F.when(~c("label").isin("bona_fide", "spoof"), "label"),
        F.when(~F.coalesce(c("gender"), F.lit("unknown")).isin("female", "male", "other", "unknown"), "gender"),
        F.when(c("duration_s") <= 0, "duration_s"),
        F.when(c("sample_rate") <= 0, "sample_rate"),
        F.when((c("label") == "spoof") & F.coalesce(c("generator_family"), F.lit("")).isin(""), "spoof without generator_family"),
        F.when((c("label") == "bona_fide") & ~F.coalesce(c("generator_family"), F.lit("")).isin(""), "bona fide with generator_family"),
    ]
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def parse_manifest_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Parsed rows with ``problems``: unknown keys, bad JSON and contract breaks (nothing is dropped)."""
    known = F.array(*[F.lit(f) for f in FIELDS])
    p = lines.filter(F.trim(F.col(text)) != "").withColumns(
        {"_m": F.from_json(text, MANIFEST), "_keys": F.json_object_keys(text)}
    )
    flat = p.select("*", "_m.*")
    extra = F.transform(F.array_except(F.coalesce("_keys", F.array().cast("array<string>")), known), lambda k: F.concat(F.lit("unknown field "), k))
    bad = F.when(F.col("_keys").isNull(), F.array(F.lit("not a JSON object"))).otherwise(F.concat(extra, row_problems()))
    return flat.withColumn("problems", bad).drop("_m", "_keys", text)


def read_manifest(spark: SparkSession, glob: str, strict: bool = True) -> DataFrame:
    """JSONL rows matching a glob; strict mode fails with file context on the first bad rows."""
    lines = spark.read.text(glob).withColumn("file", F.col("_metadata.file_path"))
    rows = parse_manifest_lines(lines)
    if not strict:
        return rows
    bad = rows.filter(F.size("problems") > 0).select("file", "utt_id", "problems").limit(5).collect()
    if bad:
        raise ValueError("invalid manifest rows: " + "; ".join(f"{r.file}: {r.utt_id}: {', '.join(r.problems)}" for r in bad))
    return rows.drop("problems")


def duplicate_ids(rows: DataFrame, key: str = "utt_id") -> DataFrame:
    """Ids seen more than once; partial counts keep a hot id to one row per map task."""
    return rows.groupBy(key).count().filter(F.col("count") > 1)


def read_manifests(spark: SparkSession, glob: str) -> DataFrame:
    rows = read_manifest(spark, glob)
    if duplicate_ids(rows).limit(1).count():
        raise ValueError("duplicate utt_id across manifests")
    return rows


def write_manifest(rows: DataFrame, path: str, fmt: str = "json", files_per_language: int = 16) -> None:
    """Write by language; a salt spreads a language that holds most rows over several writers."""
    out = rows.repartition("language", F.pmod(F.xxhash64("utt_id"), F.lit(files_per_language)))
    out.write.mode("overwrite").partitionBy("language").format(fmt).save(path)


def import_wide_protocol(lines: DataFrame, prefix: str = "asv5", corpus: str = "asvspoof5") -> DataFrame:
    """Whitespace protocol with speaker, utterance, gender, codec, quality, seed, tag, attack, key."""
    p = F.split(F.trim("value"), r"\s+")
    r = lines.select(p.alias("p")).filter(F.size("p") >= 9)
    at = lambda i: F.element_at("p", i + 1)
    spoof = at(8) == "spoof"
    codec = F.when(at(3) == "-", F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("codec:"), at(3), F.when(at(4) != "-", F.concat(F.lit("q"), at(4))).otherwise("")))
    )
    return r.select(
        F.concat(F.lit(f"{prefix}_"), at(1)).alias("utt_id"),
        F.when(spoof, "spoof").otherwise("bona_fide").alias("label"),
        F.when(spoof, at(7)).alias("generator_family"),
        F.when(spoof & (at(6) != "-"), F.concat_ws("/", at(7), at(6))).when(spoof, at(7)).alias("generator_name"),
        F.lit("en").alias("language"),
        F.when(at(2) == "F", "female").when(at(2) == "M", "male").otherwise("unknown").alias("gender"),
        F.concat(F.lit(f"{prefix}_"), at(0)).alias("speaker_id"),
        F.lit(corpus).alias("source_corpus"),
        codec.alias("codec_chain"),
    )


def import_narrow_protocol(lines: DataFrame, prefix: str = "asv19la", corpus: str = "asvspoof2019_la") -> DataFrame:
    """Five-column protocol: speaker, utterance, unused, system, key."""
    p = F.split(F.trim("value"), r"\s+")
    r = lines.select(p.alias("p")).filter(F.size("p") >= 5)
    at = lambda i: F.element_at("p", i + 1)
    spoof = at(4) == "spoof"
    return r.select(
        F.concat(F.lit(f"{prefix}_"), at(1)).alias("utt_id"),
        F.when(spoof, "spoof").otherwise("bona_fide").alias("label"),
        F.when(spoof, at(3)).alias("generator_family"),
        F.when(spoof, at(3)).alias("generator_name"),
        F.concat(F.lit(f"{prefix}_"), at(0)).alias("speaker_id"),
        F.lit(corpus).alias("source_corpus"),
    )


def _gender(c: Column) -> Column:
    g = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(g.isin("f", "female"), "female").when(g.isin("m", "male"), "male").otherwise("unknown")


def _speaker(iso: str, c: Column) -> Column:
    n = c.try_cast("double").cast("long").cast("string")
    return F.concat(F.lit(f"kb_{iso}_"), F.coalesce(n, F.nullif(F.trim(c), F.lit("")), F.lit("unknown")))


def import_corpora(synthetic: DataFrame, natural: DataFrame, iso: str, min_seconds: float = 1.0) -> DataFrame:
    """Two source schemas as one manifest; empty and too short recordings are left out.

    synthetic: (unit, row, model, target_speaker, source_speaker, gender, seconds, has_audio);
    natural: (fname, speaker, gender, seconds, has_audio).
    """
    keep = F.col("has_audio") & (F.col("seconds") >= min_seconds)
    family = F.lower(F.trim("model"))
    s = synthetic.filter(keep).select(
        F.concat(F.lit(f"isyn_{iso}_"), F.substring(F.sha2(F.concat_ws(":", "unit", F.col("row").cast("string")), 256), 1, 12)).alias("utt_id"),
        F.lit("spoof").alias("label"), family.alias("generator_family"), _gender(F.col("gender")).alias("gender"),
        _speaker(iso, F.col("target_speaker")).alias("speaker_id"), F.when(F.col("source_speaker").isNotNull(), _speaker(iso, F.col("source_speaker"))).alias("source_speaker"),
        F.lit("indicsynth").alias("source_corpus"), F.bround("seconds", 3).alias("duration_s"),
    )
    n = natural.filter(keep).select(
        F.concat(F.lit(f"kb_{iso}_"), F.regexp_replace(F.regexp_extract("fname", r"([^/]*)$", 1), r"\.[^.]*$", "")).alias("utt_id"),
        F.lit("bona_fide").alias("label"), F.lit(None).cast("string").alias("generator_family"), _gender(F.col("gender")).alias("gender"),
        _speaker(iso, F.col("speaker")).alias("speaker_id"), F.lit(None).cast("string").alias("source_speaker"),
        F.lit("kathbath").alias("source_corpus"), F.bround("seconds", 3).alias("duration_s"),
    )
    return s.unionByName(n)


def new_parts(candidates: DataFrame, done: DataFrame, part: str = "part", key: str = "utt_id") -> DataFrame:
    """Rows of parts not imported yet, one row per id (idempotent re-import)."""
    return candidates.join(done.select(part).distinct(), part, "left_anti").dropDuplicates([key])


def registry_problems(registry: DataFrame) -> DataFrame:
    """Entries without a boolean ``commercial_use`` and duplicated names; empty when valid."""
    missing = registry.filter(F.col("commercial_use").isNull()).select("name", F.lit("missing commercial_use").alias("problem"))
    twice = registry.groupBy("name").count().filter("count > 1").select("name", F.lit("duplicate name").alias("problem"))
    return missing.unionByName(twice)


def verify_files(registry_files: DataFrame, found: DataFrame) -> DataFrame:
    """ok, missing, mismatch or unpinned per registered file.

    registry_files: (dataset, name, sha256); found: (name, sha256), for instance from ``file_hashes``.
    """
    j = registry_files.join(found.select("name", F.col("sha256").alias("found_sha")), "name", "left")
    status = (
        F.when(F.col("found_sha").isNull(), "missing").when(F.col("sha256").isNull(), "unpinned").when(F.col("sha256") == F.col("found_sha"), "ok").otherwise("mismatch")
    )
    return j.withColumn("status", status)


def file_hashes(spark: SparkSession, path: str, pattern: str = "*", piece: int = PIECE_OF_FILE) -> DataFrame:
    """(name, sha256) of files below a folder, hashed where they are read.

    A file of more than ``piece`` bytes (a multiple of 128) is read piece by piece, each in a task that goes on from the
    state of the one before; such files run side by side, when this is called.  Files that Hadoop would unpack, by their
    suffix, and all files where OpenSSL's library is not shared, are one buffer each, under 2 GiB.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name, meta = F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("_metadata")
    whole = files.select(name, F.sha2("content", 256).alias("sha256"))
    cut = (meta["file_size"] > piece) & ~F.lower(meta["file_name"]).rlike(r"^_|\.(gz|bz2|deflate|snappy|lz4|zst|zstd)$")
    long = files.filter(cut).select(name, "path", "length").collect() if _sha256_library() else []
    if not long:
        return whole
    with ThreadPoolExecutor(min(len(long), 8)) as pool:
        shas = [*pool.map(lambda f: _sha256_by_pieces(spark.sparkContext, f.path, f.length, piece), long)]
    rows = literal_table(spark, [(f.name, sha) for f, sha in zip(long, shas, strict=True)], "name string, sha256 string")
    return whole.filter(~cut).unionByName(rows)


def _sha256_by_pieces(sc: SparkContext, path: str, size: int, piece: int) -> str:
    """SHA-256 of one file, each piece in its own task; only the state of the hash goes from task to task.

    Hadoop reads whole records alone, and its last split is up to 1.1 pieces long, so ever smaller pieces follow, and at
    the end records that divide the file.
    """
    at = re.sub(r"([\\\[\]{}*?])", r"\\\1", path).replace(",", r"{\,}")  # neither a pattern nor a list
    state, done, least = _sha256_from(None, b""), 0, piece // 128
    for split, record in ((piece, least), (piece // 8, least), (least, least), (least, math.gcd(size, least))):
        if done == size:
            break
        conf = {"fixedlengthinputformat.record.length": str(record)} | {f"mapreduce.input.fileinputformat.split.{m}size": str(split) for m in ("min", "max")}
        rdd = sc.newAPIHadoopFile(at, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
        n = rdd.getNumPartitions()
        for i in range(done // split, n if size % record == 0 else n - 1):
            state, done = sc.runJob(rdd, _feed(state, done, max(1, (1 << 20) // record)), [i])
    if done != size:
        raise RuntimeError(f"{path}: {done} bytes read of {size}")
    return _sha256_from(state, b"", end=True).hex()


def _feed(state: bytes, done: int, at_once: int) -> Callable[[Iterable[tuple[int, bytes]]], tuple[bytes, int]]:
    """The state, and the count of the bytes that it has seen, after the records of a piece."""

    def run(records: Iterable[tuple[int, bytes]]) -> tuple[bytes, int]:
        now, seen, values = state, done, (v for _, v in records)
        while part := b"".join(islice(values, at_once)):
            now, seen = _sha256_from(now, part), seen + len(part)
        return now, seen

    return run


def _sha256_library() -> ctypes.CDLL | None:
    """The OpenSSL library behind ``hashlib``, whose own objects cannot be carried to another task."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        return lib if lib.SHA256_Init and lib.SHA256_Final else None
    except (ImportError, AttributeError, OSError):
        return None


def _sha256_from(state: bytes | None, part: bytes, end: bool = False) -> bytes:
    """The state (or at the end the digest) after more bytes; OpenSSL's SHA256_CTX, 112 bytes, holds all of it."""
    lib, ctx, out = _sha256_library(), ctypes.create_string_buffer(state or b"", 112), ctypes.create_string_buffer(32)
    if state is None:
        lib.SHA256_Init(ctx)
    lib.SHA256_Update(ctx, part, len(part))
    if end:
        lib.SHA256_Final(out, ctx)
    return out.raw if end else ctx.raw


def expand_templates(templates: DataFrame, slots: dict[str, DataFrame], per_template: int, seed: int) -> DataFrame:
    """Slot values filled into templates, distinct, at most ``per_template`` per template in hash order.

    ``slots``: name -> one-column DataFrame ``value``.  Only the slots a template names are joined, so
    the expansion is by slot presence and never a blind product over unused slots.
    """
    from pyspark.sql.window import Window as W

    out = templates
    for name, values in slots.items():
        mark = "{" + name + "}"
        has = out.withColumn("_slot", F.when(F.col("text").contains(mark), F.lit(name)))
        v = values.select(F.lit(name).alias("_slot"), F.col("value").alias("_v"))
        j = has.join(v, "_slot", "left")
        out = j.withColumn("text", F.when(F.col("_v").isNotNull(), F.replace(F.col("text"), F.lit(mark), F.col("_v"))).otherwise(F.col("text"))).drop("_slot", "_v")
    out = out.dropDuplicates(["template_id", "text"])
    w = W.partitionBy("template_id").orderBy(order_hash(F.col("text"), seed), "text")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_template).drop("_r")
