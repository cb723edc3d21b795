"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Built-in SQL functions only. Positions come from cutting a text at the matches
of a pattern: the lengths of the cuts and of the matches add up to the starts.
Patterns are possessive and start where a run of their characters starts, so
that a long run is read once and not from each of its places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
LEAST = 0.6


@dataclass(frozen=True)
class Kind:
    """`given`: a confirmed match counts whatever its score; else the score must reach LEAST."""

    name: str
    pattern: str
    given: bool
    score: float
    context: str


# How long account numbers are, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban() -> str:
    """As many letters and digits as the country's numbers have, so that a word or number behind one is left out."""
    by_length: dict[int, list[str]] = {}
    for country, length in IBAN_LENGTHS.items():
        by_length.setdefault(length, []).append(country)
    forms = [f"(?:{'|'.join(names)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{length - 4}}}" for length, names in sorted(by_length.items())]
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(forms)})(?![A-Za-z0-9])"


# The four patterns up to their anchors, and the order of the kinds.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", True, 0.9, "mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, 0.6, "ip|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", True, 0.8, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", _iban(), False, 0.7, "iban|bank|account"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False, 0.3, "ssn|social security"),
)
CONTEXT_GAIN = 0.3


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points from 0; null if there is none."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cuts = F.split(text, pattern, -1)
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>")

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["cut"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(cuts, 1, F.size(hits)), hits, lambda c, h: F.struct(c.alias("cut"), h.alias("hit")))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda done: done["spans"])
    return F.when(F.size(hits) > 0, spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit at its end."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number, blanks aside, is 1 modulo 97 with its first four characters at the end."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "ssn":
        area = F.substring(value, 1, 3)
        return ~area.isin("000", "666") & ~area.startswith("9") & (F.substring(value, 5, 2) != "00")
    return F.lit(True)


def _spans(text: Column, number: int, kind: Kind, found: Column) -> Column:
    """The confirmed spans of a kind with their scores."""

    def describe(span: Column) -> Column:
        left = F.greatest(span["start"] - CONTEXT, F.lit(0))
        around = F.lower(F.substring(text, left + 1, span["end"] - left + CONTEXT))
        gain = F.when(around.rlike(rf"\b(?:{kind.context})"), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(
            span["start"].alias("start"),
            F.lit(number).alias("number"),
            span["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            span["value"].alias("value"),
            F.least(F.lit(kind.score) + gain, F.lit(1.0)).alias("score"),
            F.lit(kind.given).alias("given"),
        )

    good = F.filter(found, lambda span: _confirmed(kind.name, span["value"]))
    described = F.transform(good, describe)
    return described if kind.given else F.filter(described, lambda span: span["score"] >= LEAST)


SPAN = "struct<start:int,number:int,end:int,kind:string,value:string,score:double,given:boolean>"


def _work(docs: DataFrame) -> DataFrame:
    """row (all columns of `docs`), text and spans, so that no column of `docs` can clash with ours."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = rows.select("*", *(_found(text, k.pattern).alias(k.name) for k in KINDS))
    per_kind = [_spans(text, i, k, F.col(k.name)) for i, k in enumerate(KINDS)]
    empty = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    spans = F.sort_array(F.flatten(F.array(*(F.coalesce(s, empty) for s in per_kind))))
    return raw.select("row", "text", spans.alias("spans"))


def find(docs: DataFrame, name: str = "pii_spans") -> DataFrame:
    """`docs` with an array column of spans, by start and then kind; empty for a null or empty text.

    A span has start, end (code points, end exclusive), kind, value, score and
    given. Rows stay as they are; a column that already bears `name` is
    replaced, all others are unchanged whatever their names. Spans of different
    kinds may overlap.
    """
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    return _work(docs).select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("spans").alias(name))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each found span replaced by its kind in angle brackets; columns unchanged.

    Overlapping spans become one mark, of the kind that starts first. Null
    texts stay null. A column n_chars is set to the new length where the text
    changed.
    """
    text = F.col("text")

    def add(done: Column, span: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        fresh = span["start"] >= done["at"]
        out = F.when(fresh, F.concat(done["out"], gap, F.lit("<"), span["kind"], F.lit(">"))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", begin, add, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))
    hit = F.size("spans") > 0
    made = _work(docs).select("row", hit.alias("hit"), F.when(hit, clean).otherwise(text).alias("clean"))
    columns = []
    for n, kind in docs.dtypes:
        own = F.col("row").getField(n)
        if n == "text":
            own = F.col("clean")
        elif n == "n_chars":
            own = F.when(F.col("hit"), F.length("clean").cast(kind)).otherwise(own)
        columns.append(own.alias(n))
    return made.select(*columns)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
