"""Personal data (operator 7), in DataFrame functions only.

Regular expressions propose spans, checksum validators confirm them (Luhn for
cards, mod-97 for bank account numbers, ranges and digit counts for the rest),
and words near a span adjust its score.  Spans of the base kinds stay whatever
their score; spans of the further kinds stay at ``MIN_SCORE`` or more.

Offsets come from the pieces: the matches of a pattern and the pieces that it
splits a text in alternate, so the prefix sums of their lengths are the
offsets.  Sums are taken in blocks, so thousands of matches in one text cost
no quadratic time.  The patterns equal the base patterns of the contract but
start no attempt inside a run whose start has failed and give nothing back,
which keeps them linear on long runs.

Defined results: a null or empty text has no spans; a null doc_id is returned as
null; repeated rows get equal results.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, documents

#: Code points before and after a span in which context words count.
CONTEXT = 40
#: Score at which a span of a further kind stays.
MIN_SCORE = 0.7
_BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``gate`` is a cheap necessary condition on the text; ``valid`` confirms a
    match; ``base`` kinds stay at any score; the score is ``prior`` plus
    ``boost`` if a context word is near, less ``boost`` if a counter word is.
    """

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    base: bool
    prior: float
    context: str
    counter: str = "(?!)"
    boost: float = 0.25


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of a match pass the Luhn checksum."""
    digits = F.split(F.reverse(_digits(match)), "")
    doubled = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, leaves 1."""
    flat = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _digit_count(match: Column, low: int, high: int) -> Column:
    return F.length(_digits(match)).between(low, high)


def _parts_at_most_255(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_extract(p, "([0-9]{1,3})$", 1).cast("int"), F.lit(0)) <= 255))


_DIGIT = lambda t: t.rlike("[0-9]")

#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """A number of its country's length that no letter or digit follows; else any run of groups."""
    exact = "|".join(f"(?:{n.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(size - 4) // 4}}}" + (f" ?[A-Z0-9]{{{size % 4}}}" if size % 4 else "") for size, n in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{exact})(?![A-Za-z0-9])|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}+(?: ?[A-Z0-9]{{1,3}})?+(?![A-Za-z0-9]))"


#: The base kinds, in the order of the contract, then the further kinds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), lambda m: F.lit(True), True, 0.9, r"(?i)e-?mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), _parts_at_most_255, True, 0.7, r"(?i)\bip\b|address|host|server", r"(?i)version|release"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){15,}+", lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"), lambda m: _digit_count(m, 16, 19) & luhn(m), True, 0.8, r"(?i)card|visa|credit|pay", r"(?i)order|serial|isbn"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"), lambda m: _digit_count(m, 8, 15), True, 0.8, r"(?i)phone|call|tel|mobile|fax"),
    Kind("iban", _iban_pattern(), lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), mod97, False, 0.75, r"(?i)iban|account|bank|konto"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: ~m.rlike("^(?:000|666|9..)|^....00|0000$"), False, 0.5, r"(?i)ssn|social|security|insurance"),
)
BASE = tuple(k.name for k in KINDS if k.base)


def running_sums(steps: str) -> Column:
    """Inclusive prefix sums of an array column of integers, block by block."""
    sums = f"transform(sequence(0, int((size({steps}) - 1) / {_BLOCK})), b -> aggregate(slice({steps}, b * {_BLOCK} + 1, {_BLOCK}), 0, (a, x) -> a + x))"
    scan = lambda array, start: f"aggregate({array}, named_struct('t', {start}, 'o', cast(array() AS array<int>)), (a, x) -> named_struct('t', a.t + x, 'o', concat(a.o, array(a.t + x)))).o"
    return F.expr(
        f"CASE WHEN size({steps}) > 0 THEN flatten(transform(zip_with({scan(sums, '0')}, {sums}, (e, s) -> e - s), "
        f"(z, b) -> {scan(f'slice({steps}, b * {_BLOCK} + 1, {_BLOCK})', 'z')})) ELSE cast(array() AS array<int>) END"
    )


def pii_spans(docs: DataFrame, min_score: float = MIN_SCORE, carry: bool = False) -> DataFrame:
    """doc_id, text and ``spans``: (kind, start, end, score), by kind as listed, then start.

    With ``carry`` the whole row comes along as ``row``.
    """
    rows = documents(docs, carry=carry)
    more = carried(rows)
    rows = rows.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text"))
    none = F.expr("cast(array() AS array<string>)")
    text = F.col("text")
    rows = rows.select("*", *(F.when(k.gate(text), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"m_{k.name}") for k in KINDS))
    rows = rows.select("*", *(F.when(F.size(f"m_{k.name}") > 0, F.split(text, k.pattern, -1)).otherwise(none).alias(f"g_{k.name}") for k in KINDS))
    rows = rows.select("*", *(F.zip_with(f"m_{k.name}", F.slice(f"g_{k.name}", F.lit(1), F.size(f"m_{k.name}")), lambda m, g: F.length(m) + F.length(g)).alias(f"s_{k.name}") for k in KINDS))
    rows = rows.select("*", *(running_sums(f"s_{k.name}").alias(f"e_{k.name}") for k in KINDS))

    def kept(k: Kind) -> Column:
        def span(m: Column, end: Column) -> Column:
            start = end - F.length(m)
            lead = F.greatest(start - CONTEXT, F.lit(0))
            near = F.concat(F.substring(text, lead + 1, start - lead), F.lit(" "), F.substring(text, end + 1, F.lit(CONTEXT)))
            weight = F.lit(k.prior) + F.when(near.rlike(k.context), k.boost).otherwise(0.0) - F.when(near.rlike(k.counter), k.boost).otherwise(0.0)
            score = F.round(F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0)), 2)
            return F.struct(F.lit(k.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"), k.valid(m).alias("valid"))

        found = F.filter(F.zip_with(f"m_{k.name}", f"e_{k.name}", span), lambda s: s["valid"] & (F.lit(k.base) | (s["score"] >= min_score)))
        return F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))

    rows = rows.select("doc_id", *more, "text", *(F.when(F.size(f"m_{k.name}") > 0, kept(k)).otherwise(F.expr("cast(array() AS array<struct<kind:string,start:int,end:int,score:double>>)")).alias(f"k_{k.name}") for k in KINDS))
    return rows.select("doc_id", *more, "text", F.flatten(F.array(*(F.col(f"k_{k.name}") for k in KINDS))).alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets.

    Spans that touch or overlap an earlier one are replaced together with it.
    """
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = "named_struct('lo', -1, 'hi', -1, 'kind', '', 'out', cast(array() AS array<struct<lo:int,hi:int,kind:string>>))"
    step = (
        "(a, s) -> if(s.start < a.hi, named_struct('lo', a.lo, 'hi', greatest(a.hi, s.end), 'kind', a.kind, 'out', a.out), "
        "named_struct('lo', s.start, 'hi', s.end, 'kind', s.kind, 'out', if(a.hi < 0, a.out, concat(a.out, array(named_struct('lo', a.lo, 'hi', a.hi, 'kind', a.kind))))))"
    )
    more = carried(found)
    merged = found.select("doc_id", *more, "text", ordered.alias("ordered")).select(
        "doc_id", *more, "text", F.when(F.size("ordered") > 0, F.expr(f"aggregate(ordered, {start}, {step}, a -> concat(a.out, array(named_struct('lo', a.lo, 'hi', a.hi, 'kind', a.kind))))")).alias("cuts")
    )
    piece = "concat(substring(text, if(i = 0, 0, get(cuts, i - 1).hi) + 1, c.lo - if(i = 0, 0, get(cuts, i - 1).hi)), '<', upper(c.kind), '>')"
    clean = F.expr(f"if(cuts IS NULL, text, concat(array_join(transform(cuts, (c, i) -> {piece}), ''), substring(text, element_at(cuts, -1).hi + 1)))")
    return merged.select("doc_id", *more, clean.alias("text"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The rows of the contract, and the scores of the spans, context included, in their order."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _joined(F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return pii_spans(docs).select("doc_id", *(of(k) for k in BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))
