"""Identifiers, hashes, phone numbers, versions and other small string rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unit_hash(key: Column, seed: Column | int) -> Column:
    """Uniform number in [0, 1) from sha256 of ``seed:key`` (first 8 bytes, big endian)."""
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    h = F.sha2(F.concat(s, F.lit(":"), key.cast("string")), 256)
    return F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def order_hash(key: Column, seed: int) -> Column:
    """Hex hash used as a repeatable, partition-independent random order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def pseudonym(value: Column, salt: str) -> Column:
    return F.concat(F.lit("h:"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), value.cast("string")), 256), 1, 24))


def e164(raw: Column) -> Column:
    """Phone number in E.164 (+91 assumed for ten digits), NULL if it cannot be one."""
    c = F.regexp_replace(F.trim(raw), r"[\s\-().]+", "")
    full = (
        F.when(c.startswith("+"), c)
        .when(c.rlike(r"^\d{10}$"), F.concat(F.lit("+91"), c))
        .when(c.rlike(r"^91\d{10}$"), F.concat(F.lit("+"), c))
        .otherwise(F.concat(F.lit("+"), c))
    )
    return F.when((raw != "") & full.rlike(r"^\+[1-9]\d{6,14}$"), full)


def number_key(raw: Column) -> Column:
    """Last ten digits, the lookup key of call history."""
    return F.right(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\D", ""), F.lit(10))


def sip_identity(headers: Column) -> Column:
    """Caller identity from the first usable identity header."""
    get = lambda k: F.nullif(F.regexp_extract(headers[k], r"(?:sip:|tel:)([+\w\-.@]+)", 1), F.lit(""))
    return F.coalesce(*[get(k) for k in ("P-Asserted-Identity", "p-asserted-identity", "From", "from")])


# fixed values: content-type fragments and the codec they mean, in order of precedence
CODEC_HINTS = [
    (("mulaw", "pcmu", "g711u"), "g711u"),
    (("alaw", "pcma", "g711a"), "g711a"),
    (("g729",), "g729"),
    (("amr",), "amrnb"),
    (("opus",), "opus"),
    (("evs",), "evs"),
    (("pcm", "l16", "wav"), "pcm"),
]


def codec_hint(content_type: Column, sample_rate: Column) -> Column:
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    out = None
    for parts, codec in CODEC_HINTS:
        cond = ct.contains(parts[0])
        for p in parts[1:]:
            cond = cond | ct.contains(p)
        out = F.when(cond, codec) if out is None else out.when(cond, codec)
    return out.when(sample_rate == 8000, "g711u").when(sample_rate == 16000, "pcm").otherwise("unknown")


def codec_key(chain: Column) -> Column:
    """Joined codec names of a channel chain, ``clean`` when there is none."""
    names = F.transform(F.filter(chain, lambda c: c.startswith("codec:")), lambda c: F.regexp_replace(c, "^codec:", ""))
    return F.coalesce(F.nullif(F.array_join(names, "+"), F.lit("")), F.lit("clean"))


def channel_condition(sample_rate: Column) -> Column:
    return F.when(sample_rate <= 8000, "narrowband").otherwise("wideband")


def slug(s: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("x"))


def run_id(blob: Column) -> Column:
    return F.concat(F.lit("r"), F.substring(F.sha2(blob, 256), 1, 8))


def row_id(run: Column, protocol: Column, slice_: Column) -> Column:
    return F.concat_ws(".", run, protocol, slug(slice_))


# fixed values: version formats
VERSION_PATTERN = r"^([A-Fa-z]+)@([a-z0-9\-]+)-([a-z0-9\-]+)-v(\d+\.\d+\.\d+)$"
CALIBRATION_PATTERN = r"^cal-\d{4}-\d{2}-\d{2}$"
CALIBRATION_SENTINELS = ("stub-cal-v0.1", "none")


def version_parts(v: Column) -> Column:
    """struct<head, frontend, backend, semver>, NULL when the format is wrong."""
    g = lambda i: F.regexp_extract(v, VERSION_PATTERN, i)
    return F.when(v.rlike(VERSION_PATTERN), F.struct(g(1).alias("head"), g(2).alias("frontend"), g(3).alias("backend"), g(4).alias("semver")))


def versions_compatible(a: Column, b: Column) -> Column:
    major = lambda x: F.split_part(x["semver"], F.lit("."), F.lit(1))
    return (a["head"] == b["head"]) & (a["frontend"] == b["frontend"]) & (major(a) == major(b))


def calibration_version_ok(v: Column) -> Column:
    return v.rlike(CALIBRATION_PATTERN) | v.isin(*CALIBRATION_SENTINELS)


def window_at(seconds: Column, window_count: Column, hop_s: float = 1.0, window_s: float = 3.0) -> Column:
    """0-based window id for a playback time, -1 outside the call."""
    idx = F.floor(F.greatest(F.lit(0.0), seconds - window_s) / hop_s)
    return F.when((window_count <= 0) | (seconds < 0), -1).otherwise(F.least(idx, window_count - 1)).cast("long")


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))
