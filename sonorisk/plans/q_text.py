"""Queries: transcript rules over whole documents and conversation turns."""

from pyspark.sql import functions as F

from sonorisk.functions import identity as I, lexicon as L, text as X
from sonorisk.functions.math import r6
from sonorisk.operators import context as C
from sonorisk.plans.fixtures import cte, re4, sql, table
from sonorisk.plans.registry import query
from sonorisk.scale import spread

# Phrases appended to real rows so that every rule fires somewhere in the tables.
PHRASES = [
    "This is the CFO, wire 18 lakh to the new vendor account right now and don't tell the team.",
    "Sir main director bol raha hoon, paise bhejo turant, kisi ko mat batana.",
    "मैं पुलिस से बोल रहा हूँ, तुरंत ओटीपी बताइए, किसी को मत बताना।",
    "My OTP is 482913 and my card 4111 1111 1111 1111, phone +91 98765 43210.",
    "Reach me at caller.one@example.com or caller@ybl, PAN ABCDE1234F, IFSC HDFC0ABC123.",
    "Call back mat karo, use whatsapp or AnyDesk, updated bank details, send crypto.",
    "मला हे काय आहे ते तुम्ही सांगा नाही, ম ৰ অসম, வணக்கம் நன்றி.",
    "um I went I go you know the the account is one two three four five six nine.",
    "aadhaar 1234 5678 9012 account 123456789012345 ek do teen char paanch",
    "yeh mera khata hai aur mujhe paise chahiye please help me now with this account",
    "I would like to check my balance please.",
]


def _arr(i):
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (i % len(PHRASES) + 1).cast("int"))


def _sql_arr(i):
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + f"][{i} % {len(PHRASES)} + 1]"


def docs(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", "lang", "source", F.concat_ws(" ", "text", _arr(F.col("doc_id"))).alias("text"))


cte("docs", f"SELECT doc_id, lang, source, text || ' ' || {_sql_arr('doc_id')} AS text FROM documents")


def segments(spark, sf):
    """Transcript segments: one per conversation turn, with times, overlaps and partials."""
    c = table(spark, sf, "conversations")
    start = F.col("turn") * 4000
    return c.select(
        F.col("conv_id").alias("session_id"),
        "turn",
        start.alias("start_ms"),
        (start + 3000 + (F.col("conv_id") * 37 + F.col("turn") * 11) % 1500).alias("end_ms"),
        F.concat_ws(" ", "text", _arr(F.col("conv_id") + F.col("turn"))).alias("text"),
        ((F.col("conv_id") + F.col("turn")) % 6 != 0).alias("final"),
        "role",
    )


cte(
    "segments",
    f"""SELECT conv_id AS session_id, turn, turn * 4000 AS start_ms, turn * 4000 + 3000 + (conv_id * 37 + turn * 11) % 1500 AS end_ms,
    text || ' ' || {_sql_arr('(conv_id + turn)')} AS text, (conv_id + turn) % 6 <> 0 AS final, role FROM conversations""",
)


def _q(p):
    return p.replace("'", "''")


def _intent_sql(label):
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{_q(p)}', 0, 'i'), '')" for p in L.INTENT_PATTERNS[label]) + ")"


cte(
    "intent_hits",
    " UNION ALL ".join(f"SELECT doc_id, '{lab}' AS label, 0.8 AS confidence, {_intent_sql(lab)} AS evidence FROM docs" for lab in L.INTENT_WEIGHT),
    "docs",
)
WEIGHT_SQL = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.INTENT_WEIGHT.items()) + " ELSE 0.3 END"


@query("FN21", sql("SELECT doc_id, label, evidence FROM intent_hits WHERE evidence IS NOT NULL", "intent_hits"))
def fn21(spark, sf):
    d = docs(spark, sf).select("doc_id", F.explode(X.intent_hits(F.col("text"))).alias("h"))
    return d.select("doc_id", "h.label", "h.evidence")


@query(
    "AGG38",
    sql(
        f"""SELECT d.doc_id, coalesce(risk, 0.0) AS intent_risk FROM docs d LEFT JOIN (SELECT doc_id, {re4('1 - product(1 - w * 0.8) * CASE WHEN count(*) >= 3 THEN 0.5 ELSE 1.0 END')} AS risk
        FROM (SELECT doc_id, label, CAST({WEIGHT_SQL} AS DOUBLE) AS w FROM intent_hits WHERE evidence IS NOT NULL) GROUP BY 1) r ON r.doc_id = d.doc_id""",
        "intent_hits",
    ),
)
def agg38(spark, sf):
    d = docs(spark, sf).withColumn("h", X.intent_hits(F.col("text")))
    return d.select("doc_id", X.intent_risk_from_hits(F.col("h")).alias("intent_risk"))


def model_reply(c):
    """A JSON reply of a text model, as it would arrive in a column."""
    return F.concat(
        F.lit('note {"labels": [{"label": "'),
        F.element_at(F.array(*[F.lit(x) for x in [*L.INTENT_WEIGHT, "not_a_label"]]), (c % 9 + 1).cast("int")),
        F.lit('", "confidence": '),
        (c % 15 / F.lit(10.0)).cast("string"),
        F.lit(', "evidence": "quoted"}]} end'),
    )


MODEL_LABEL = "[" + ", ".join(f"'{x}'" for x in [*L.INTENT_WEIGHT, "not_a_label"]) + "][doc_id % 9 + 1]"


@query(
    "FN36",
    sql(
        f"SELECT doc_id, {MODEL_LABEL} AS label, least(1.0, CAST(doc_id % 15 AS DOUBLE) / 10) AS confidence, 'quoted' AS evidence FROM documents WHERE doc_id % 9 <> 8 AND doc_id % 4 <> 0"
    ),
)
def fn36(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit("no json here")).otherwise(model_reply(F.col("doc_id"))).alias("raw")
    )
    h = d.select("doc_id", F.explode(X.parse_intent_reply(F.col("raw"))).alias("h"))
    return h.select("doc_id", "h.label", "h.confidence", "h.evidence")


@query(
    "SET01",
    sql(
        f"""SELECT doc_id, label, confidence, source FROM (SELECT doc_id, label, CAST(confidence AS DOUBLE) AS confidence, 'rules' AS source FROM intent_hits WHERE evidence IS NOT NULL
        UNION ALL SELECT doc_id, {MODEL_LABEL}, least(1.0, CAST(doc_id % 15 AS DOUBLE) / 10), 'model' FROM documents WHERE doc_id % 9 <> 8)""",
        "intent_hits",
    ),
)
def set01(spark, sf):
    rules = docs(spark, sf).select("doc_id", F.explode(X.intent_hits(F.col("text"))).alias("h"))
    model = table(spark, sf, "documents").select("doc_id", F.explode(X.parse_intent_reply(model_reply(F.col("doc_id")))).alias("h"))
    return rules.unionByName(model).select("doc_id", "h.label", "h.confidence", "h.source")


PII_DUCK = [(k, p, ic) for k, p, ic, _ in L.PII_PATTERNS]


@query(
    "FN17",
    sql("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{_q(p)}', 0{', ' + chr(39) + 'i' + chr(39) if ic else ''})) AS n_{k}" for k, p, ic in PII_DUCK) + " FROM docs", "docs"),
)
def fn17(spark, sf):
    return docs(spark, sf).select("doc_id", *[c.cast("long").alias(f"n_{k}") for k, c in X.pii_counts(F.col("text")).items()])


@query("FN18")
def fn18(spark, sf):
    r = docs(spark, sf).withColumn("r", X.redact(F.col("text")))
    return r.select("doc_id", F.array_join("r.kinds", ",").alias("kinds"), F.length("r.text").alias("n_chars"), F.sha2(F.col("r.text"), 256).alias("text_sha"))


LUHN_SQL = """(list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN CAST(d[i] AS INT)
  ELSE CASE WHEN CAST(d[i] AS INT) > 4 THEN CAST(d[i] AS INT) * 2 - 9 ELSE CAST(d[i] AS INT) * 2 END END)) % 10 = 0)"""


@query("FN19", f"SELECT o_orderkey, {LUHN_SQL} AS valid FROM (SELECT o_orderkey, CAST(o_orderkey * 7919 + 4000000 AS VARCHAR) AS d FROM orders)")
def fn19(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", X.luhn_valid((F.col("o_orderkey") * 7919 + 4000000).cast("string")).alias("valid"))


NUM_SQL = "[" + ", ".join(f"'{w}'" for w in L.NUMBER_WORDS) + "]"


@query(
    "FN20",
    sql(
        f"""SELECT doc_id, len(regexp_extract_all(array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[\\s,.;:!?]+'), lambda t: t <> ''),
        lambda t: CASE WHEN list_contains({NUM_SQL}, lower(t)) OR regexp_matches(t, '^[0-9]$') THEN '1' ELSE '0' END), ''), '1{{4,}}')) AS runs FROM docs""",
        "docs",
    ),
)
def fn20(spark, sf):
    return docs(spark, sf).select("doc_id", X.spoken_digit_runs(F.col("text")).cast("long").alias("runs"))


# ---- language ---------------------------------------------------------------------------------

_SC = "regexp_extract(t, '[\\x{0600}-\\x{06FF}\\x{0900}-\\x{0D7F}]', 0)"
_CASE = " ".join(f"WHEN c >= '{a}' AND c <= '{b}' THEN '{k}'" for a, b, k in L.SCRIPT_BLOCKS)
_MR = ", ".join(f"'{m}'" for m in L.MARATHI_MARKERS)
_HG = ", ".join(f"'{m}'" for m in L.HINGLISH)
cte(
    "tok",
    """SELECT doc_id, hint, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, lang AS hint,
    regexp_extract_all(text, '[\\p{L}\\p{Nl}\\p{No}\\x{0600}-\\x{06FF}\\x{0900}-\\x{0DFF}]+') AS w FROM docs)""",
    "docs",
)
cte(
    "toklang0",
    f"""SELECT doc_id, hint, t, pos, CASE WHEN c <> '' THEN CASE WHEN s = 'hi' AND t IN ({_MR}) THEN 'mr' WHEN s = 'bn' AND regexp_matches(t, '[{L.ASSAMESE_CHARS}]') THEN 'as' ELSE s END
    WHEN regexp_matches(t, '^[A-Za-z]+$') THEN CASE WHEN lower(t) IN ({_HG}) THEN 'hi-Latn' ELSE 'en' END END AS l FROM
    (SELECT *, CASE {_CASE} END AS s FROM (SELECT *, {_SC} AS c FROM tok))""",
    "tok",
)
cte(
    "toklang",
    "SELECT doc_id, hint, t, pos, CASE WHEN l = 'hi' AND bool_or(l = 'mr') OVER (PARTITION BY doc_id) THEN 'mr' ELSE l END AS l FROM toklang0 WHERE l IS NOT NULL",
    "toklang0",
)


@query("FN22", sql("SELECT doc_id, l AS language, count(*) AS n_tokens, count(DISTINCT t) AS n_distinct FROM toklang0 WHERE l IS NOT NULL GROUP BY 1, 2", "toklang0"))
def fn22(spark, sf):
    t = docs(spark, sf).select("doc_id", F.explode(X.words(F.col("text"))).alias("t")).withColumn("language", X.token_language(F.col("t")))
    return t.filter("language is not null").groupBy("doc_id", "language").agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("t").alias("n_distinct"))


cte("tokbase", "SELECT doc_id, split_part(l, '-', 1) AS b, count(*) AS n, min(pos) AS first_pos FROM toklang GROUP BY 1, 2", "toklang")
cte(
    "doclang",
    """SELECT d.doc_id, d.lang AS hint, coalesce(n, 0) AS n, top, hl, sw, over_n,
    CASE WHEN top = 'en' AND hl / n >= 0.3 THEN 'hi' ELSE top END AS dom FROM docs d
    LEFT JOIN (SELECT doc_id, sum(n) AS n, first(b ORDER BY n DESC, first_pos) AS top FROM tokbase GROUP BY 1) a ON a.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, count(*) FILTER (l = 'hi-Latn') AS hl FROM toklang GROUP BY 1) h ON h.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, count(*) FILTER (pb IS NOT NULL AND pb <> b) AS sw FROM (SELECT doc_id, split_part(l, '-', 1) AS b, lag(split_part(l, '-', 1)) OVER (PARTITION BY doc_id ORDER BY pos) AS pb FROM toklang) GROUP BY 1) s ON s.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, count(*) AS over_n FROM (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS sh FROM tokbase) WHERE sh >= 0.15 GROUP BY 1) o ON o.doc_id = d.doc_id""",
    "tokbase",
)
_CNT = "coalesce((SELECT n FROM tokbase t WHERE t.doc_id = x.doc_id AND t.b = {0}), 0)"


@query(
    "FN23",
    sql(
        f"""SELECT doc_id, CASE WHEN n = 0 THEN coalesce(split_part(hint, '-', 1), 'unknown') WHEN hint IS NOT NULL AND {_CNT.format("split_part(hint, '-', 1)")} = {_CNT.format('dom')} THEN split_part(hint, '-', 1) ELSE dom END AS language,
        n > 0 AND coalesce(over_n, 0) >= 2 AS code_switched FROM doclang x""",
        "doclang",
    ),
)
def fn23(spark, sf):
    return X.detect_language(docs(spark, sf), "text", "lang").select("doc_id", "language", "code_switched")


@query("WIN18", sql("SELECT doc_id, coalesce(sw, 0) AS switches FROM doclang", "doclang"))
def win18(spark, sf):
    return X.detect_language(docs(spark, sf), "text", "lang").select("doc_id", "switches")


cte("words", "SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\x{0900}-\\x{0DFF}''-]+') AS ws FROM docs", "docs")
_LEX = lambda lang: "[" + ", ".join(f"'{x}'" for x in X._lexicon_for(lang) if " " not in x) + "]"
_LEXC = "CASE lang WHEN 'hi' THEN " + _LEX("hi") + "".join(f" WHEN '{k}' THEN {_LEX(k)}" for k in ("ta", "te", "bn", "mr")) + " ELSE " + _LEX("en") + " END"


@query(
    "FN24",
    sql(
        """SELECT doc_id, round(f / m, 6) + 0.0 AS filler_per_min, round(r / m, 6) + 0.0 AS repetition_per_min, round(s / m, 6) + 0.0 AS restart_per_min, round((f + r + s) / m, 6) + 0.0 AS disfluency_per_min FROM (
        SELECT doc_id, greatest(len(ws) * 300 / 60000, 1e-6) AS m,
        len(list_filter(ws, lambda w: list_contains(lex, w))) + len(regexp_extract_all(array_to_string(ws, ' '), 'you know')) + len(regexp_extract_all(array_to_string(ws, ' '), 'i mean')) AS f,
        len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1] AND NOT list_contains(lex, ws[i]))) AS r,
        len(list_filter(ws, lambda w: suffix(w, '-') AND length(w) > 1)) + len(list_filter(range(1, len(ws) - 2), lambda i: ws[i] = ws[i + 2] AND ws[i + 1] <> ws[i + 3] AND NOT list_contains(lex, ws[i]))) AS s
        FROM (SELECT doc_id, ws, """
        + _LEXC
        + """ AS lex FROM words))""",
        "words",
    ),
)
def fn24(spark, sf):
    d = docs(spark, sf).withColumn("ws", X.spoken_words(F.col("text")))
    d = d.select("doc_id", F.size("ws").alias("n"), X.disfluency_counts(F.col("ws"), F.col("lang")).alias("c"))
    c = X.disfluency(F.col("c"), F.col("n"), F.col("n") * 300 / 60000.0)
    return d.select("doc_id", *[r6(v).alias(k) for k, v in c.items()])


@query(
    "WIN19",
    sql(
        """SELECT doc_id, len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS repetitions,
        len(list_filter(range(1, len(ws) - 2), lambda i: ws[i] = ws[i + 2] AND ws[i + 1] <> ws[i + 3])) AS restarts FROM words""",
        "words",
    ),
)
def win19(spark, sf):
    d = docs(spark, sf).withColumn("ws", X.spoken_words(F.col("text")))
    return d.select("doc_id", *[v.alias(k) for k, v in X.repetition_counts(F.col("ws")).items()])


_IND = ", ".join(f"'{x}'" for x in L.INDIC)


@query("FN29", f"SELECT doc_id, lower(split_part(l, '-', 1)) AS base, CASE WHEN lower(split_part(l, '-', 1)) IN ({_IND}) THEN 220.0 ELSE 150.0 END AS min_pause_ms FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Hi-IN' ELSE lang || '-XX' END AS l FROM documents)")
def fn29(spark, sf):
    lang = F.when(F.col("doc_id") % 3 == 0, "Hi-IN").otherwise(F.concat("lang", F.lit("-XX")))
    return table(spark, sf, "documents").select("doc_id", X.base_language(lang).alias("base"), X.min_pause_ms(lang).alias("min_pause_ms"))


@query(
    "FN33",
    sql(
        """SELECT session_id, start_ms AS segment_ms, pos - 1 AS pos, token, CAST(floor(start_ms + (pos - 1) * ((end_ms - start_ms) / n)) AS BIGINT) AS token_start_ms, CAST(floor(start_ms + pos * ((end_ms - start_ms) / n)) AS BIGINT) AS token_end_ms
        FROM (SELECT session_id, start_ms, end_ms, len(p) AS n, unnest(p) AS token, generate_subscripts(p, 1) AS pos FROM
        (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS p FROM segments))""",
        "segments",
    ),
)
def fn33(spark, sf):
    return C.segment_tokens(segments(spark, sf))


@query(
    "FN35",
    sql(
        """SELECT doc_id, position('account' IN lower(text)) AS at_account, position('please' IN lower(text)) AS at_please,
        (CASE WHEN position('account' IN lower(text)) > 0 THEN 1 ELSE 0 END + CASE WHEN position('please' IN lower(text)) > 0 THEN 1 ELSE 0 END) AS n_spans FROM docs""",
        "docs",
    ),
)
def fn35(spark, sf):
    d = docs(spark, sf).withColumn("spans", X.highlight_spans(F.col("text"), F.array(F.lit("account"), F.lit("please"))))
    at = lambda n: F.coalesce(F.get(F.filter(F.col("spans"), lambda s: s["len"] == n), F.lit(0))["at"], F.lit(0)).cast("long")
    return d.select("doc_id", at(7).alias("at_account"), at(6).alias("at_please"), F.size("spans").cast("long").alias("n_spans"))


# ---- transcript joins -------------------------------------------------------------------------

cte(
    "sess_text",
    "SELECT session_id, string_agg(text, ' ' ORDER BY turn) AS text FROM (SELECT *, max(end_ms) OVER (PARTITION BY session_id) AS last_ms FROM segments) WHERE end_ms >= last_ms - 120000 GROUP BY 1",
    "segments",
)
cte(
    "seg_hits",
    " UNION ALL ".join(f"SELECT session_id, '{lab}' AS label, {_intent_sql(lab)} AS evidence FROM sess_text" for lab in L.INTENT_WEIGHT),
    "sess_text",
)


def session_text(spark, sf):
    """Transcript text of the last two minutes per session, so a session's array has a bounded length."""
    seg = segments(spark, sf)
    ends = seg.groupBy("session_id").agg(F.max("end_ms").alias("_last"))
    s = seg.join(ends, "session_id").filter(F.col("end_ms") >= F.col("_last") - 120_000)
    g = s.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_s"))
    return g.select("session_id", F.array_join("_s.text", " ").alias("text"))


@query(
    "JON10",
    sql(
        """SELECT session_id, label, min(start_ms) AS start_ms FROM (SELECT h.session_id, h.label, s.start_ms FROM seg_hits h JOIN segments s
        ON s.session_id = h.session_id AND contains(lower(s.text), lower(h.evidence)) WHERE h.evidence IS NOT NULL) GROUP BY 1, 2""",
        "seg_hits",
    ),
)
def jon10(spark, sf):
    h = session_text(spark, sf).select("session_id", F.explode(X.intent_hits(F.col("text"))).alias("h")).select("session_id", "h.label", "h.evidence")
    return C.first_evidence_segment(h, segments(spark, sf).select("session_id", "start_ms", "text")).select("session_id", "label", "start_ms")


WIN11_SQL = """WITH RECURSIVE seg0 AS ({segments}), f AS (SELECT session_id, start_ms, end_ms, length(text) AS len, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, end_ms) AS rn FROM seg0 WHERE final),
 fold AS (SELECT session_id, start_ms, end_ms, len, rn, true AS accepted, end_ms AS last_end FROM f WHERE rn = 1
   UNION ALL SELECT f.session_id, f.start_ms, f.end_ms, f.len, f.rn, f.start_ms >= last_end - 50, CASE WHEN f.start_ms >= last_end - 50 THEN f.end_ms ELSE last_end END
   FROM fold JOIN f ON f.session_id = fold.session_id AND f.rn = fold.rn + 1)
 SELECT a.session_id, a.start_ms, a.end_ms, a.accepted, (SELECT count(*) FROM fold b WHERE b.session_id = a.session_id AND b.rn <= a.rn AND b.accepted AND b.end_ms >= a.last_end - 12000) AS n_held FROM fold a"""


def _seg_sql():
    from sonorisk.plans.fixtures import CTE

    return CTE["segments"][1]


@query("WIN11", WIN11_SQL.replace("{segments}", _seg_sql()))
def win11(spark, sf):
    return C.rolling_transcript(segments(spark, sf), keep_ms=12_000).select("session_id", "start_ms", "end_ms", "accepted", "n_held")


# ---- identifiers ------------------------------------------------------------------------------

RAW_NUMBERS = ["98765{n}", "9198765{n}", "+91 (98765) {n}", "022-{n}", "+44 20 {n}", "abc", ""]


def raw_number(i):
    n = F.lpad((i % 100000).cast("string"), 5, "0")
    forms = [F.concat(F.lit("98765"), n), F.concat(F.lit("9198765"), n), F.concat(F.lit("+91 (98765) "), n), F.concat(F.lit("022-"), n), F.concat(F.lit("+44 20 "), n), F.lit("abc"), F.lit("")]
    return F.element_at(F.array(*forms), (i % 7 + 1).cast("int"))


def raw_number_sql(i):
    n = f"lpad(CAST({i} % 100000 AS VARCHAR), 5, '0')"
    return f"['98765' || {n}, '9198765' || {n}, '+91 (98765) ' || {n}, '022-' || {n}, '+44 20 ' || {n}, 'abc', ''][{i} % 7 + 1]"


@query(
    "FN14",
    f"""SELECT event_id, CASE WHEN raw <> '' AND regexp_matches(c, '^\\+[1-9]\\d{{6,14}}$') THEN c END AS e164, right(regexp_replace(raw, '\\D', '', 'g'), 10) AS key10 FROM (
    SELECT event_id, raw, CASE WHEN starts_with(s, '+') THEN s WHEN regexp_matches(s, '^\\d{{10}}$') THEN '+91' || s ELSE '+' || s END AS c FROM (
    SELECT *, regexp_replace(trim(raw), '[\\s\\-().]+', '', 'g') AS s FROM (SELECT event_id, {raw_number_sql('event_id')} AS raw FROM events)))""",
)
def fn14(spark, sf):
    r = raw_number(F.col("event_id"))
    return table(spark, sf, "events").select("event_id", I.e164(r).alias("e164"), I.number_key(r).alias("key10"))


@query(
    "FN15",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'u' || user_id || '@a.example' WHEN 1 THEN '+9198' || user_id WHEN 2 THEN 'x' || user_id || '@b.example' END AS identity FROM events""",
)
def fn15(spark, sf):
    u = F.col("user_id").cast("string")
    e = table(spark, sf, "events")
    hdr = (
        F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("P-Asserted-Identity"), F.concat(F.lit("<sip:u"), u, F.lit("@a.example>")), F.lit("From"), F.lit("sip:no@c.example")))
        .when(F.col("event_id") % 4 == 1, F.create_map(F.lit("p-asserted-identity"), F.concat(F.lit("tel:+9198"), u)))
        .when(F.col("event_id") % 4 == 2, F.create_map(F.lit("From"), F.concat(F.lit('"A" <sip:x'), u, F.lit("@b.example>;tag=1"))))
        .otherwise(F.create_map(F.lit("Via"), F.lit("sip:z@d.example")))
    )
    return e.select("event_id", I.sip_identity(hdr).alias("identity"))


_CT = "['audio/PCMU', 'audio/x-alaw', 'audio/G729', 'audio/amr', 'audio/opus; rate=48000', 'audio/EVS', 'audio/L16', 'application/octet', NULL]"


@query(
    "FN16",
    f"""SELECT event_id, CASE WHEN ct LIKE '%mulaw%' OR ct LIKE '%pcmu%' OR ct LIKE '%g711u%' THEN 'g711u' WHEN ct LIKE '%alaw%' OR ct LIKE '%pcma%' OR ct LIKE '%g711a%' THEN 'g711a'
    WHEN ct LIKE '%g729%' THEN 'g729' WHEN ct LIKE '%amr%' THEN 'amrnb' WHEN ct LIKE '%opus%' THEN 'opus' WHEN ct LIKE '%evs%' THEN 'evs'
    WHEN ct LIKE '%pcm%' OR ct LIKE '%l16%' OR ct LIKE '%wav%' THEN 'pcm' WHEN sr = 8000 THEN 'g711u' WHEN sr = 16000 THEN 'pcm' ELSE 'unknown' END AS codec
    FROM (SELECT event_id, lower({_CT}[event_id % 9 + 1]) AS ct, [8000, 16000, 44100][event_id % 3 + 1] AS sr FROM (SELECT event_id, event_id % 3 FROM events))""",
)
def fn16(spark, sf):
    cts = ["audio/PCMU", "audio/x-alaw", "audio/G729", "audio/amr", "audio/opus; rate=48000", "audio/EVS", "audio/L16", "application/octet", None]
    ct = F.element_at(F.array(*[F.lit(c).cast("string") for c in cts]), (F.col("event_id") % 9 + 1).cast("int"))
    sr = F.element_at(F.array(*[F.lit(x) for x in (8000, 16000, 44100)]), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", I.codec_hint(ct, sr).alias("codec"))


@query("FN10", "SELECT event_id, round(CAST(('0x' || substr(sha256('1337:' || event_id), 1, 16)) AS UHUGEINT) / 18446744073709551616.0, 9) AS u FROM events")
def fn10(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(I.unit_hash(F.col("event_id"), 1337), 9).alias("u"))


@query("FN12", "SELECT event_id, 'h:' || substr(sha256('audit-salt:' || user_id), 1, 24) AS pseudonym FROM events")
def fn12(spark, sf):
    return table(spark, sf, "events").select("event_id", I.pseudonym(F.col("user_id"), "audit-salt").alias("pseudonym"))


_CH = "[['codec:g711u', 'noise:10'], ['codec:opus', 'rir:1', 'codec:amr'], ['noise:5'], []]"


@query("FN30", f"SELECT doc_id, coalesce(nullif(array_to_string(list_transform(list_filter({_CH}[doc_id % 4 + 1], lambda c: starts_with(c, 'codec:')), lambda c: substr(c, 7)), '+'), ''), 'clean') AS codec FROM documents")
def fn30(spark, sf):
    chains = [["codec:g711u", "noise:10"], ["codec:opus", "rir:1", "codec:amr"], ["noise:5"], []]
    arr = F.array(*[F.array(*[F.lit(x) for x in c]).cast("array<string>") for c in chains])
    return table(spark, sf, "documents").select("doc_id", I.codec_key(F.element_at(arr, (F.col("doc_id") % 4 + 1).cast("int"))).alias("codec"))


@query("FN32", "SELECT doc_id, 'r' || substr(sha256(lang || ':' || source), 1, 8) AS run_id, 'r' || substr(sha256(lang || ':' || source), 1, 8) || '.overall.' || coalesce(nullif(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'x') AS row_id FROM documents")
def fn32(spark, sf):
    d = table(spark, sf, "documents").withColumn("run_id", I.run_id(F.concat_ws(":", "lang", "source")))
    return d.select("doc_id", "run_id", I.row_id(F.col("run_id"), F.lit("overall"), F.col("text")).alias("row_id"))


_VER = "['A@wav-net-v1.2.' || (event_id % 9), 'B@dsp-gbdt-v2.0.0', 'bad version', 'A@wav-net-v2.0.1'][event_id % 4 + 1]"


@query(
    "FN34",
    f"""SELECT event_id, nullif(regexp_extract(v, '{I.VERSION_PATTERN}', 1), '') AS head, nullif(regexp_extract(v, '{I.VERSION_PATTERN}', 4), '') AS semver,
    CASE WHEN regexp_matches(v, '{I.VERSION_PATTERN}') THEN regexp_extract(v, '{I.VERSION_PATTERN}', 1) = 'A' AND regexp_extract(v, '{I.VERSION_PATTERN}', 2) = 'wav' AND split_part(regexp_extract(v, '{I.VERSION_PATTERN}', 4), '.', 1) = '1' END AS compatible,
    event_id % 3 <> 2 AS calibration_ok FROM (SELECT event_id, {_VER} AS v FROM events)""",
)
def fn34(spark, sf):
    e = F.col("event_id")
    v = F.element_at(F.array(F.concat(F.lit("A@wav-net-v1.2."), (e % 9).cast("string")), F.lit("B@dsp-gbdt-v2.0.0"), F.lit("bad version"), F.lit("A@wav-net-v2.0.1")), (e % 4 + 1).cast("int"))
    cal = F.element_at(F.array(F.lit("cal-2026-01-31"), F.lit("none"), F.lit("cal-31-01")), (e % 3 + 1).cast("int"))
    p = I.version_parts(v)
    ref = I.version_parts(F.lit("A@wav-net-v1.0.0"))
    return table(spark, sf, "events").select("event_id", p["head"].alias("head"), p["semver"].alias("semver"), I.versions_compatible(p, ref).alias("compatible"), I.calibration_version_ok(cal).alias("calibration_ok"))


@query("FN38", "SELECT event_id, CASE WHEN sr <= 8000 THEN 'narrowband' ELSE 'wideband' END AS condition FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 8000 WHEN 1 THEN 16000 END AS sr FROM events)")
def fn38(spark, sf):
    sr = F.when(F.col("event_id") % 3 == 0, 8000).when(F.col("event_id") % 3 == 1, 16000)
    return table(spark, sf, "events").select("event_id", I.channel_condition(sr).alias("condition"))


@query("JON12", "SELECT event_id, CASE WHEN n <= 0 OR s < 0 THEN -1 ELSE least(CAST(floor(greatest(0.0, s - 3)) AS BIGINT), n - 1) END AS window_id FROM (SELECT event_id, value - CAST(2 AS DOUBLE) AS s, event_id % 20 AS n FROM events)")
def jon12(spark, sf):
    return table(spark, sf, "events").select("event_id", I.window_at(F.col("value") - 2.0, F.col("event_id") % 20).alias("window_id"))
