"""Personal data: expressions propose spans, checksums confirm, context scores.

DataFrame functions only.  Every kind is one regular expression; its matches
come from ``regexp_extract_all`` and their places from the pieces that
``split`` leaves between them.  Loops in the expressions are possessive and
anchored at the start of a run of their characters (or at the end of the last
match), so the time is linear in the text and no long run of digits can
overflow the matcher's stack.

Base spans (email, ip, card, phone) are always reported.  Further proposals
(IBAN with its mod-97 check, payment cards of 13 to 15 digits passing Luhn)
are added when their score, raised by context words within ``CONTEXT``
characters before or after, reaches ``THRESHOLD``.

Defined results: null and empty texts have no spans; long texts are scanned
whole; repeated rows are scanned alike; of matches that overlap within a kind
the leftmost counts, across kinds all count; extra columns stay, but for those
whose names begin with ``pii_``, which are left out or replaced; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import whole_text

CONTEXT = 40
THRESHOLD = 0.7
LOCAL = "A-Za-z0-9._%+-"

EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The head of an IBAN alone; its group looks ahead at all that may follow, a word behind it included.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))"
OCTET = "(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
IP_VALID = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"

#: kind -> (text that a match must hold, for a cheap first look; expression)
KINDS = {
    "email": ("@", EMAIL),
    "ip": (".", IP),
    "card": (None, DIGITS),
    "phone": ("+", PHONE),
    "iban": (None, IBAN),
}
#: Words that speak for a proposal of the kind.
CONTEXT_WORDS = {
    "card": "(?i)(card|credit|visa|amex|american express|diners|karte|carte|tarjeta)",
    "iban": "(?i)(iban|account|bank|konto|compte|cuenta|bic|swift)",
}
#: Lengths of IBANs by country; other countries may have any from 15 to 34.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}
#: Score without context; context adds 0.3.
PRIOR = {"card": 0.5, "iban": 0.8}
SPAN = "struct<start:int,end:int,value:string>"


def _spans(text: Column, kind: str) -> Column:
    """Matches with their places: array<struct<start, end, value>>, in order."""
    must, pattern = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.when(text.contains(must), found).otherwise(F.array().cast("array<string>")) if must else found


def _placed(text: Column, found: Column, kind: str) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    pairs = F.arrays_zip(F.split(text, KINDS[kind][1], -1).alias("gap"), found.alias("value"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0))).alias("at"),
        F.when(
            x["value"].isNotNull(),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(x["gap"])).alias("start"),
                        (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"),
                        x["value"].alias("value"),
                    )
                ),
            ),
        )
        .otherwise(acc["out"])
        .alias("out"),
    )
    some = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, some).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def term(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + term(i))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN leaves 1 modulo 97, its first four characters moved last."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    number = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda acc, c: (acc * F.when(F.ascii(c) >= 65, 100).otherwise(10) + number(c)) % 97,
    )
    return (rest == 1) & plain.rlike("^[A-Z0-9]{15,34}$")


def _ibans(heads: Column, tails: Column) -> Column:
    """Confirmed IBANs: of a head and the whole words behind it, the words that pass
    mod-97, preferably at the country's length, else the most; none within another."""
    length = F.create_map(*[F.lit(x) for n, countries in IBAN_LENGTHS.items() for c in countries.split() for x in (c, n)])

    def confirmed(head: Column, tail: Column) -> Column:
        words = F.split(F.concat(head["value"], tail), " ")
        some = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
        passed = F.filter(some, mod97)
        usual = F.filter(passed, lambda v: F.length(F.replace(v, F.lit(" "), F.lit(""))) == F.element_at(length, F.substring(v, 1, 2)))
        value = F.coalesce(F.get(usual, F.lit(0)), F.get(passed, F.size(passed) - 1))
        return F.struct(head["start"].alias("start"), (head["start"] + F.length(value)).alias("end"), value.alias("value"))

    found = F.filter(F.zip_with(heads, tails, confirmed), lambda x: x["value"].isNotNull())
    apart = lambda acc, x: F.coalesce(F.get(acc, F.size(acc) - 1)["end"] <= x["start"], F.lit(True))
    return F.aggregate(found, F.array().cast(f"array<{SPAN}>"), lambda acc, x: F.when(apart(acc, x), F.concat(acc, F.array(x))).otherwise(acc))


def _score(text: Column, span: Column, kind: str) -> Column:
    before = F.greatest(span["start"] - CONTEXT, F.lit(0))
    around = F.concat(
        F.substring(text, before + 1, span["start"] - before), F.lit(" "), F.substring(text, span["end"] + 1, F.lit(CONTEXT))
    )
    return F.lit(PRIOR[kind]) + F.when(around.rlike(CONTEXT_WORDS[kind]), 0.3).otherwise(0.0)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``pii_email, pii_ip, pii_card, pii_phone`` (base spans) and
    ``pii_more`` (added spans with kind and score)."""
    text = whole_text(text_col)
    docs = docs.select(*[c for c in docs.columns if not c.startswith("pii_") or c == text_col])
    df = docs.withColumns({f"pii_m_{k}": _spans(text, k) for k in KINDS})
    df = df.withColumns({f"pii_s_{k}": _placed(text, F.col(f"pii_m_{k}"), k) for k in KINDS})
    n = lambda x: F.length(digits_of(x["value"]))
    valid = {
        "email": F.col("pii_s_email"),
        "ip": F.filter("pii_s_ip", lambda x: x["value"].rlike(IP_VALID)),
        "card": F.filter("pii_s_card", lambda x: F.when(n(x).between(16, 19), luhn(digits_of(x["value"]))).otherwise(False)),
        "phone": F.filter("pii_s_phone", lambda x: n(x).between(8, 15)),
    }
    proposals = {
        "card": F.filter("pii_s_card", lambda x: F.when(n(x).between(13, 15), luhn(digits_of(x["value"]))).otherwise(False)),
        "iban": _ibans(F.col("pii_s_iban"), F.regexp_extract_all(text, F.lit(IBAN), F.lit(1))),
    }

    def scored(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _score(text, x, kind).alias("score"))

    added = [F.filter(F.transform(spans, scored(kind)), lambda x: x["score"] >= THRESHOLD) for kind, spans in proposals.items()]
    df = df.withColumns({f"pii_{k}": v for k, v in valid.items()} | {"pii_more": F.concat(*added)})
    return df.drop(*[f"pii_{x}_{k}" for k in KINDS for x in "ms"])


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The text with every confirmed span replaced by its kind, ``<email>`` say;
    of spans that overlap the first one's kind stands for all."""
    found = find_pii(docs.select(F.struct(*docs.columns).alias("all"), whole_text(text_col).alias("pii_text")).select("all", F.col("pii_text").alias("text")), "text")

    def named(kind: Column | None):
        return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["kind"] if kind is None else kind).alias("kind"))

    base = [F.transform(f"pii_{k}", named(F.lit(k))) for k in ("email", "ip", "card", "phone")]
    more = F.transform("pii_more", named(None))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        before = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        fresh = F.concat(acc["out"], before, F.lit("<"), x["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    out = found.withColumn("text", F.aggregate(F.array_sort(F.concat(*base, more)), start, step, rest))
    return out.select(F.col("all").withField(text_col, F.col("text")).alias("all")).select("all.*")


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts, the digest of base spans, all spans and their number."""
    base = ("email", "ip", "card", "phone")
    found = find_pii(docs.select(id_col, text_col), text_col)

    def label(kind: str):
        return lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))

    def place(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"))

    def of_kind(kind: str):
        return lambda x: x["kind"] == kind

    base_list = F.concat(*[F.transform(f"pii_{k}", label(k)) for k in base])
    every = []
    for k in (*base, "iban"):
        own = F.transform(F.filter("pii_more", of_kind(k)), place)
        if k in base:
            own = F.concat(F.transform(f"pii_{k}", place), own)
        every.append(F.transform(F.sort_array(own), label(k)))
    return found.select(
        id_col,
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.concat_ws(",", base_list), 256).alias("base_sha256"),
        F.concat_ws(",", *every).alias("spans"),
        sum((F.size(x) for x in every[1:]), F.size(every[0])).cast("long").alias("n_spans"),
    )
