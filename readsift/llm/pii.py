"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Only DataFrame expressions. Positions come from ``split`` and ``regexp_extract_all`` with one pattern: the pieces
between the matches and the matches alternate, so running sums of their lengths are the offsets, in code points. Both
give the leftmost non-overlapping matches. All repetitions are possessive where nothing that follows could need what
they took, which keeps the matcher from recursing or backtracking over long runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readsift.llm.common import let

#: Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """A country, two digits and as many more letters or digits as the country has, each after a space or not."""
    return "|".join(rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:[\x20]?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())


#: Kinds in the order in which spans that start together are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: The same languages as the plain patterns: a match may begin where the last ended, or not inside a run of its own
#: first characters, where a match from the run's start would have failed or swallowed it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{iban_pattern()})",
    "ssn": r"[0-9]++(?:-[0-9]++)++",
}
#: What a text must contain for the pattern to be tried at all; a pattern of two digits where no one character is needed.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
DIGITS = {"card": r"[0-9][\x20-]?[0-9]", "iban": "[0-9]{2}"}
#: Score of a match, of a passed checksum and of a context word; an added kind needs the threshold.
SCORES = {"email": (0.7, 0.0), "ip": (0.6, 0.0), "card": (0.4, 0.4), "phone": (0.6, 0.0), "iban": (0.3, 0.5), "ssn": (0.5, 0.0)}
CONTEXT_SCORE, THRESHOLD, CONTEXT_CHARS = 0.2, 0.7, 40
#: Words that make a kind likelier when they stand near.
CONTEXT = {
    "email": "mail|email|e-mail|contact|write",
    "ip": "ip|address|host|server|addr",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|transfer",
    "ssn": "ssn|social|security|taxpayer",
}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """Remainder of an IBAN: four characters to the end, letters as 10 to 35, digit by digit."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda acc, c: (acc * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & (_mod97(m) == 1)
    if kind == "ssn":
        return m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


EMPTY = "array<struct<start:int,kind:int,stop:int,score:double>>"


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind, by start: array of struct(start, kind's number, stop, score)."""
    base, checksum = SCORES[kind]
    word = rf"(?i)(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])"

    def collect(v: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            gap, match, after = v["gaps"][i], v["found"][i], v["gaps"][i + 1]
            start = acc["at"] + F.length(gap)
            near = F.concat_ws("\n", F.substring(gap, -CONTEXT_CHARS, CONTEXT_CHARS), F.substring(after, 1, CONTEXT_CHARS))
            score = F.lit(base + checksum) + F.when(near.rlike(word), CONTEXT_SCORE).otherwise(0.0)
            stop = start + F.length(match)
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop"), score.alias("score"))
            keep = _valid(kind, match) & (F.lit(kind in BASE) | (score >= THRESHOLD))
            return F.struct(stop.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY).alias("out"))
        run = F.aggregate(F.sequence(F.lit(0), F.size(v["found"]) - 1), zero, step, lambda acc: acc["out"])
        return F.when(F.size(v["found"]) > 0, run).otherwise(F.array().cast(EMPTY))

    pattern = F.lit(PATTERNS[kind])
    pieces = F.struct(F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"))
    tried = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike(DIGITS[kind])
    return F.when(tried, let(pieces, collect)).otherwise(F.array().cast(EMPTY))


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id and ``pii``, an array of struct(kind, start, stop, score) by start, then kind.

    Offsets are code points, stop exclusive. The base kinds (email, ip, card, phone) are kept whenever their checks
    pass; the added ones (iban by mod 97, ssn by its form) need a score of THRESHOLD, which context words within
    CONTEXT_CHARS, and not beyond a neighbouring candidate of the same kind, can lift. A null text counts as empty;
    repeated rows are answered one by one; other columns are ignored, whatever their names.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    spans = reduce(lambda a, b: F.concat(a, b), [_spans(whole, k) for k in KINDS])
    named = F.transform(
        F.array_sort(spans),
        lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["score"].alias("score")),
    )
    return docs.select(F.col(doc_id).alias("doc_id"), named.alias("pii"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))
