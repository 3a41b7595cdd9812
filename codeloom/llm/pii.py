"""Personal data in whole texts; DataFrame operations only.

Regular expressions propose spans, validators confirm them (part ranges for IP
addresses, Luhn for cards, digit counts for phone numbers, modulo 97 for IBANs) and
words in the CONTEXT characters before a span, back to the kind's last proposal at most,
raise its score. Base kinds (email, ip, card, phone) that pass their validator are always
reported. Further kinds are reported
from a score of REPORT per cent: an IBAN that passes its check does by itself, a
number shaped like a national identifier only with a fitting word nearby.

A pattern's matches are leftmost and do not overlap; a match that fails is dropped
without another try inside it. An IBAN has its country's length, in groups that end where
a word ends. Positions are code points, end exclusive. Work is linear in a text and its
matches: starts are sums over blocks of BLOCK matches and blocks of those.

The patterns for the JVM use possessive loops and a guard before the first character,
which change no match but keep long runs of digits or letters linear and off the stack.

Defined results: null and empty texts have no spans; spans of different kinds may
overlap; repeated rows have equal results; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
REPORT = 60
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id")
#: Patterns, as plain regular expressions and as the JVM runs them.
PATTERN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
JVM = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PATTERN["phone"],
    "national_id": PATTERN["national_id"],
}
#: Characters of an IBAN by country.
IBAN_LENGTH = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 "
    "IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 "
    "SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}

def _iban(before: str, after: str) -> str:
    """Country, check digits and the rest of its length; a space may stand before each character but the first four."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTH.items():
        by_length.setdefault(n, []).append(country)
    kinds = "|".join(rf"(?:{'|'.join(c)})[0-9][0-9](?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))
    return rf"{before}(?:{kinds}){after}"


PATTERN["iban"] = _iban(r"\b", r"\b")
JVM["iban"] = _iban("(?=[A-Z][A-Z][0-9][0-9])(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])")
BLOCK, MASKED = 32, 256
#: Texts that lack this cannot match; cheaper than the pattern.
HINT = {"email": "@", "phone": "+", "national_id": "-", "ip": "."}
#: Scores in per cent without and with a fitting word nearby.
SCORE = {"email": (80, 95), "ip": (60, 90), "card": (85, 99), "phone": (70, 95), "iban": (90, 99), "national_id": (35, 80)}
WORDS = {
    "email": "mail|contact|write|reach",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta",
    "national_id": "ssn|social|security|national|identity|passport",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1: its first four characters moved to the end, letters as 10 to 35."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$")
    if kind == "card":
        n = F.length(_digits(x))
        return F.when(n.between(16, 19), luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(x, F.lit(" "), F.lit("")))
    return F.lit(True)


def _with(value: Column, body) -> Column:
    """body(value) with value computed once: lambdas compute all that they refer to at every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(x: Column) -> Column:
    """Sums of each BLOCK elements of an array of ints."""
    at = F.sequence(F.lit(0), F.ceil(F.size(x) / BLOCK).cast("int") - 1)
    return F.when(F.size(x) > 0, F.transform(at, lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, BLOCK), F.lit(0), lambda n, y: n + y))).otherwise(F.array().cast("array<int>"))


def _until(x: Column, i: Column) -> Column:
    """Sum of the elements of i's block that stand before place i."""
    return F.aggregate(F.slice(x, F.floor(i / BLOCK).cast("int") * BLOCK + 1, (i % BLOCK).cast("int")), F.lit(0), lambda n, y: n + y)


def before_each(steps: Column) -> Column:
    """For each element of an array of ints, the sum of those before it."""

    def whole(x: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, first, lambda d, y: F.struct((d["n"] + y).alias("n"), F.concat(d["out"], F.array(d["n"])).alias("out")), lambda d: d["out"])

    def place(s: Column, i: Column) -> Column:
        at = F.floor(i / BLOCK).cast("int")
        return F.get(s["c"], F.floor(at / BLOCK).cast("int")) + _until(s["b"], at) + _until(s["a"], i)

    levels = _with(steps, lambda a: _with(_sums(a), lambda b: _with(whole(_sums(b)), lambda c: F.struct(a.alias("a"), b.alias("b"), c.alias("c")))))
    return _with(levels, lambda s: F.transform(F.sequence(F.lit(0), F.size(s["a"]) - 1), lambda i: place(s, i)))


def _proposals(text: Column, kind: str) -> Column:
    """(start, match, before) of every match, from the matches and the stretches between them."""

    parts = F.struct(F.regexp_extract_all(text, F.lit(JVM[kind]), F.lit(0)).alias("m"), F.split(text, JVM[kind], -1).alias("b"))
    empty = F.array().cast("array<struct<start:int,match:string,before:string>>")

    def place(p: Column) -> Column:
        gaps = F.slice(p["b"], 1, F.size(p["m"]))
        starts = before_each(F.zip_with(p["m"], gaps, lambda m, b: F.length(m) + F.length(b)))
        found = F.zip_with(p["m"], gaps, lambda m, b: F.struct(F.length(b).alias("start"), m.alias("match"), F.right(b, F.lit(CONTEXT)).alias("before")))
        both = F.zip_with(found, starts, lambda f, n: F.struct((f["start"] + n).cast("int").alias("start"), f["match"].alias("match"), f["before"].alias("before")))
        return F.when(F.size(p["m"]) > 0, both).otherwise(empty)

    found = _with(parts, place)
    return F.when(F.contains(text, F.lit(HINT[kind])), found).otherwise(empty) if kind in HINT else found


def _confirmed(kind: str) -> Column:
    """Of the proposals in _kind, those that pass, with scores from the words before them."""
    low, high = SCORE[kind]

    def score(p: Column) -> Column:
        points = F.when(F.lower(p["before"]).rlike(rf"(?:^|[^a-z])(?:{WORDS[kind]})(?:[^a-z]|$)"), high).otherwise(low)
        return F.struct(p["start"].alias("start"), (p["start"] + F.length(p["match"])).alias("stop"), points.alias("score"))

    passed = F.transform(F.filter(F.col(f"_{kind}"), lambda p: _valid(kind, p["match"])), score)
    return F.filter(passed, lambda s: s["score"] >= REPORT)


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column for each kind: array of (start, stop, score) in per cent, by start."""
    out = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns({f"_{kind}": _proposals(F.col("_text"), kind) for kind in KINDS})
    return out.withColumns({kind: _confirmed(kind) for kind in KINDS}).drop("_text", *(f"_{k}" for k in KINDS))


def _named(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["stop"]))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, comma-joined."""
    return F.array_join(F.concat(*map(_named, kinds)), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts of the base kinds, a digest of their spans, all spans and their scores."""
    found = spans(docs.select(F.col(id_col), F.col(text_col).alias("text")))
    scores = F.array_join(F.concat(*(F.transform(F.col(k), lambda s: s["score"].cast("string")) for k in KINDS)), ",")
    return found.select(
        F.col(id_col), *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(BASE), 256).alias("base_sha256"), listed(KINDS).alias("spans"), scores.alias("scores"),
    )


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every reported span of the text replaced by its kind in angle brackets; of overlapping spans the first counts."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    found = spans(packed, "_t")

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))

    every = F.array_sort(F.concat(*map(named, KINDS)))

    def put(part: Column):
        def one(done: Column, s: Column) -> Column:
            gap = F.substring(part["text"], done["at"] - part["base"] + 1, s["start"] - done["at"])
            return F.when(s["start"] < done["at"], done).otherwise(F.struct(s["stop"].alias("at"), F.concat(done["out"], gap, F.lit("<"), s["kind"], F.lit(">")).alias("out")))

        return F.aggregate(part["some"], F.struct(part["base"].alias("at"), F.lit("").alias("out")), one)

    def masks(found: Column) -> Column:
        """By blocks of spans, each cut from the text and written once."""

        def block(done: Column, b: Column) -> Column:
            some = F.slice(found, b * MASKED + 1, MASKED)
            stop = F.greatest(F.array_max(F.transform(some, lambda s: s["stop"])), done["at"])
            part = F.struct(some.alias("some"), F.substring(F.col("_t"), done["at"] + 1, stop - done["at"]).alias("text"), done["at"].alias("base"))
            return _with(_with(part, put), lambda new: F.struct(new["at"].alias("at"), F.concat(done["out"], new["out"]).alias("out")))

        blocks = F.sequence(F.lit(0), F.ceil(F.size(found) / MASKED).cast("int") - 1)
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(blocks, start, block, lambda d: F.concat(d["out"], F.substring(F.col("_t"), d["at"] + 1, F.length("_t"))))

    out = F.when(F.size(every) > 0, _with(every, masks)).otherwise(F.col("_t"))
    new = F.when(F.col(f"row.{text_col}").isNotNull(), out)
    return found.select(*((new if c == text_col else F.col(f"row.{c}")).alias(c) for c in docs.columns))


def _sql() -> str:
    proposals, confirmed = [], []
    for k in KINDS:
        proposals.append(f"regexp_extract_all(text, '{PATTERN[k]}') AS m_{k}, regexp_split_to_array(text, '{PATTERN[k]}') AS b_{k}")
        digits = "regexp_replace(m, '[^0-9]', '', 'g')"
        valid = {
            "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CASE WHEN length(ltrim(p, '0')) BETWEEN 1 AND 3 THEN CAST(ltrim(p, '0') AS INT) <= 255 ELSE length(ltrim(p, '0')) = 0 END))",
            "card": f"length({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 1 THEN CAST({digits}[length({digits}) - i] AS INT) * 2 - CASE WHEN CAST({digits}[length({digits}) - i] AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST({digits}[length({digits}) - i] AS INT) END)) % 10 = 0",
            "phone": f"length({digits}) BETWEEN 8 AND 15",
            "iban": "CAST(array_to_string(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '') AS HUGEINT) % 97 = 1",
            "national_id": "true",
        }.get(k, "true")
        low, high = SCORE[k]
        score = f"CASE WHEN regexp_matches(lower(right(b, {CONTEXT})), '(?:^|[^a-z])(?:{WORDS[k]})(?:[^a-z]|$)') THEN {high} ELSE {low} END"
        confirmed.append(
            f"SELECT doc_id, '{k}' AS kind, {KINDS.index(k)} AS o, s, s + length(m) AS e, {score} AS score, ({valid}) AS ok FROM "
            f"(SELECT doc_id, unnest(m_{k}) AS m, unnest(b_{k}[:len(m_{k})]) AS b, unnest(list_transform(range(1, len(m_{k}) + 1), lambda i: CAST(length(array_to_string(b_{k}[:i], '')) + length(array_to_string(m_{k}[:i - 1], '')) AS BIGINT))) AS s FROM x)"
        )
    return f"""
WITH x AS (SELECT doc_id, text, {", ".join(proposals)} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
y AS ({" UNION ALL ".join(confirmed)}),
z AS (SELECT *, kind || ':' || s || ':' || e AS span FROM y WHERE ok AND score >= {REPORT}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
      string_agg(span, ',' ORDER BY o, s) FILTER (o < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY o, s) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY o, s) AS scores FROM z GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""


ORACLE_SQL = _sql()
