"""Transcript rules, one row per case."""

from pyspark.sql import functions as F

from sonorisk.functions import identity as I, text as X
from sonorisk.operators import liveness as LV


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).collect()[0].x


def test_redaction_precedence_and_kinds():
    t, kinds = X.redact_text("mail a.b@c.org otp is 482 913 card 4111 1111 1111 1111 pan ABCDE1234F call +91 98765 43210")
    assert kinds == ["email", "otp", "card_number", "pan", "phone"]
    assert "4111" not in t and "[OTP]" in t and "98765" not in t
    assert X.redact_text("code ABCDE1234F")[1] == ["pan"]  # the PAN claims its digits before the code rule
    assert X.redact_text("card 4111 1111 1111 1112")[1] != ["card_number"]  # fails the check digit
    assert X.redact_text("one two three four five")[1] == ["spoken_digits"]
    assert X.redact_text("one two three and four") == ("one two three and four", [])
    assert X.redact_text(None) == (None, [])


def test_intents_in_three_languages(spark):
    hits = lambda t: [h.label for h in one(spark, t, X.intent_hits)]
    assert set(hits("This is the CFO, don't tell the team, wire 18 lakh right now")) == {"authority_pressure", "secrecy_demand", "payment_request", "manufactured_urgency"}
    assert "credential_request" in hits("turant OTP batao")
    assert "secrecy_demand" in hits("किसी को मत बताना")
    assert hits("I would like to check my balance") == []


def test_language_rules(spark):
    rows = [("मुझे अपना पता बदलना है", None), ("मला हे काय आहे", None), ("yeh mera khata hai please help", None), ("12 34", "ta-IN"), ("hello there नमस्ते जी", "hi")]
    d = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(rows)], "i int, t string, h string")
    r = {x.i: x for x in X.detect_language(d, "t", "h").collect()}
    assert [r[i].language for i in range(5)] == ["hi", "mr", "hi", "ta", "hi"]
    assert r[4].code_switched and r[4].switches == 1 and not r[0].code_switched


def test_phone_numbers(spark):
    cases = {"98765 43210": "+919876543210", "919876543210": "+919876543210", "+44 (20) 7946-0958": "+442079460958", "abc": None, "": None}
    for raw, want in cases.items():
        assert one(spark, raw, I.e164) == want
    assert one(spark, "+91 98765 43210", I.number_key) == "9876543210"


def test_unit_hash_matches_a_plain_computation(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"7:spk").digest()[:8], "big") / 2**64
    assert abs(one(spark, "spk", lambda c: I.unit_hash(c, 7)) - want) < 1e-15


def test_ordered_match_is_a_longest_common_subsequence():
    exp = [["one", "ek"], ["two"], ["three"]]
    assert LV.ordered_match(exp, ["ek", "uh", "two", "three"]) == 1.0
    assert LV.ordered_match(exp, ["three", "two", "one"]) == 1 / 3
    assert LV.ordered_match(exp, []) == 0.0


def test_reply_parser_clamps_and_filters(spark):
    raw = 'x {"labels":[{"label":"secrecy_demand","confidence":3},{"label":"nope","confidence":1}]} y'
    h = one(spark, raw, X.parse_intent_reply)
    assert [(x.label, x.confidence) for x in h] == [("secrecy_demand", 1.0)]
    assert one(spark, "no json", X.parse_intent_reply) == []


def test_load_episodes_do_not_depend_on_chunks():
    import random

    import numpy as np

    from sonorisk.operators.monitoring import load_episodes, smoothed

    rng = random.Random(3)
    values, ts = np.array([rng.choice([0, 100, 240, 700]) for _ in range(400)], dtype=float), np.cumsum([rng.randrange(1, 4) for _ in range(400)])
    mean, want, begun, calm = smoothed(values, 0.3, 0.0), [], None, 0
    for m, t in zip(mean, ts, strict=True):
        if begun is None:
            begun, calm = (t, 0) if m > 300 else (None, 0)
        else:
            calm = calm + 1 if m < 250 else 0
            if calm >= 3 and t - begun >= 12:
                begun = None
        want.append(begun is not None)
    for size in (400, 1, 7, 50):
        got, carry, before = [], (None, 0), 0.0
        for a in range(0, 400, size):
            part = smoothed(values[a : a + size], 0.3, before)
            flags, carry = load_episodes(part, ts[a : a + size], carry, 300, 250, 3, 12)
            got, before = got + flags.tolist(), part[-1]
        assert got == want and any(want) and not all(want)


def test_voice_gate_in_many_tasks(spark):
    from pyspark.sql import functions as F

    from sonorisk.operators.monitoring import voice_activity

    frames = spark.range(400).select((F.col("id") % 2).alias("session_id"), F.floor(F.col("id") / 2).alias("frame_id"), (-30 - (F.col("id") * 7) % 23).cast("double").alias("energy_db"))
    one, many = (sorted(map(tuple, voice_activity(frames, hangover=2, limit=n).collect())) for n in (None, -1))
    assert one == many and len({v for _, _, v in one}) == 2


def test_intent_scan_passes_whatever_a_pattern_matches(spark):
    """the scan before the patterns loses no match, odd letters, digits and spaces included."""
    texts = ["urgent", "tell me the PİN", "ſend money", "KEEP THIS SECRET, Keep it", "१२ lakh  x transfer", "५ लाख", "within १० minutes", "5 crore to pay", "read out otp", "[otp]", None, "", "ıt'ſ the ceo", "₹ pay ₹", "9,00,000 rs y\nsend"]
    texts += [t + " " + u for t in texts[:6] for u in texts[6:12] if u]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain = F.filter(F.array(*[F.coalesce(*[X._first(F.col("t"), p) for p in pats]) for pats in X.L.INTENT_PATTERNS.values()]), lambda x: x.isNotNull())
    r = d.select(X.intent_hits(F.col("t")).alias("h"), plain.alias("e")).collect()
    assert [[h.evidence for h in x.h] for x in r] == [x.e for x in r] and sum(map(len, (x.e for x in r))) > 30
    assert X._possible(X.pa.array(["plain words", "urgent", None])).to_pylist() == [0, 1, 0]


def test_disfluency_is_counted_once_for_each_language(spark):
    """rates of every lexicon, from counts that stand in a projection of their own."""
    rows = [("um I went I go the the x- um um", "en"), ("matlab paise matlab", "hi-IN"), ("matlab ok", "ta"), ("vandhu ok you know", "ta"), ("um um", None), ("", "en")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, lang string").withColumn("ws", X.spoken_words(F.col("t")))
    d = d.select("i", F.size("ws").alias("n"), X.disfluency_counts(F.col("ws"), F.col("lang")).alias("c"))
    got = {r.i: r for r in d.select("i", "c.*", *[v.alias(k) for k, v in X.disfluency(F.col("c"), F.col("n"), F.lit(0.5)).items()]).collect()}
    assert [tuple(got[i])[1:4] for i in range(6)] == [(3, 1, 2), (2, 0, 0), (0, 0, 0), (2, 0, 0), (2, 0, 0), (0, 0, 0)]
    assert got[0].disfluency_per_min == 12.0 and got[0].filler_per_min == 6.0 and got[5].filler_per_min is None
