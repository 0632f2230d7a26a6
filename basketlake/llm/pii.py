"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is a column expression; there is no shuffle. A pattern's matches are marked in the text with a control
character and the text is split there, which gives each match with the text before and after it, and running lengths
give its place in code points. A span stays if its detector's score, plus what its checksum and its context words add,
reaches THRESHOLD. The four base kinds start at the threshold, so context never removes them; failing their check does.

Null texts count as empty and have no spans. An empty table gives no rows. Repeated rows are each searched. Texts of any
length are searched whole. Columns named like the results are not read; `find_pii` returns doc_id and its own columns,
`redact_pii` all of the table's columns with `text` (and `n_chars`, if there is one) replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
#: Code points on either side of a match that are searched for context words.
CONTEXT = 48
#: Pieces of a text whose lengths are summed at a time.
RUN = 256
MARK, OTHER = "\x01", "\x02"

#: The base kinds in the order in which they are listed.
BASE = ("email", "ip", "card", "phone")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _is_ip(m: Column) -> Column:
    part = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return m.rlike(rf"^{part}(\.{part}){{3}}$")


def _luhn(m: Column, least: int, most: int) -> Column:
    digits = _digits(m)
    return F.length(digits).between(least, most) & F.call_function("luhn_check", digits)


def _mod_97(m: Column) -> Column:
    """ISO 7064: four characters moved to the end, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(m, " ", "")
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.length(plain).between(15, 34) & (F.aggregate(moved, F.lit(0), step) == 1)


@dataclass(frozen=True)
class Detector:
    """`check` gives whether a match is valid; where `required`, a match that fails goes, else passing adds to the score."""

    kind: str
    pattern: str
    score: float
    needs: str = ""  # a part of every match; texts without it aren't searched
    begins: str = ""  # a simple pattern that every match has; the same, where there is no such part
    check: object = None
    required: bool = True
    context: str = ""  # words that add to the score


#: Length of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """A listed country's IBAN has its length, so what follows in capitals isn't taken; another's goes as far as it can,
    but not into a listed one."""
    listed = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    known = "|".join(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTHS.items())
    other = rf"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?: ?(?!(?<![A-Za-z0-9])(?:{listed})[0-9]{{2}})[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?:{known}|{other})(?![A-Za-z0-9])"


#: The base patterns are possessive where nothing that follows could take back what was matched, and start only where
#: an earlier start would have matched too; their leftmost matches stay the same and long runs cost linear time.
DETECTORS = (
    Detector("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.6, "@"),
    Detector("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, ".", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", _is_ip),
    Detector("card", r"[0-9](?:[ -]?[0-9])++", 0.6, "", r"[0-9](?:[ -]?[0-9]){15}", lambda m: _luhn(m, 16, 19), context="card|visa|credit|debit|payment|carte|tarjeta|karte"),
    Detector("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "+", "", lambda m: F.length(_digits(m)).between(8, 15), context="phone|tel|call|mobile|fax"),
    Detector("iban", _iban(), 0.5, "", "[A-Z]{2}[0-9]{2} ?[A-Z0-9]", _mod_97, context="iban|account|bank|konto|compte|cuenta"),
    Detector("short_card", r"(?<![0-9])(?<![0-9][ -])[0-9]{4}[ -]?[0-9]{4,6}[ -]?[0-9]{4,5}(?![0-9]|[ -][0-9])", 0.2, "", "[0-9]{4}[ -]?[0-9]{4,6}[ -]?[0-9]{4}", lambda m: _luhn(m, 13, 15), context="card|visa|amex|credit|debit|carte|tarjeta|karte"),
    Detector("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, "-", context="ssn|social security|tax id"),
    Detector("local_phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", 0.2, "", r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", context="phone|tel|call|mobile|fax"),
    Detector("access_key", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", 0.7, "AKIA"),
    Detector("secret", r"(?i)(?<![a-z0-9])(?:password|passwd|secret|api_?key|token)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9+/_.~-]{8,}+\"?", 0.7, "", r"(?i)(?:word|passwd|secret|key|token)\s{0,3}[=:]"),
)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(parts: Column) -> Column:
    """Where each part begins, in code points: running sums, RUN parts at a time so that long lists aren't copied often."""
    empty = F.array().cast("array<int>")

    def run(p: Column, base: Column) -> Column:
        return F.aggregate(p, F.struct(base.alias("at"), empty.alias("out")), lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def block(acc: Column, k: Column) -> Column:
        return _let(run(F.slice(parts, k * RUN + 1, F.lit(RUN)), acc["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), empty.alias("out")), block, lambda acc: acc["out"])


def _spans(text: Column, d: Detector) -> Column:
    """The spans of one detector: array of struct(kind, start, end, score, found)."""

    def at(parts: Column, starts: Column, i: Column) -> Column:
        found = F.element_at(parts, i)
        score = F.lit(d.score)
        keep = F.lit(True)
        if d.check is not None:
            keep = d.check(found)
            score = score + 0.2
        if d.context:
            near = F.lower(F.concat(F.right(F.element_at(parts, i - 1), F.lit(CONTEXT)), F.lit(" "), F.left(F.element_at(parts, i + 1), F.lit(CONTEXT))))
            score = score + F.when(near.rlike(rf"\b(?:{d.context})\b"), 0.3).otherwise(0.0)
        start = F.element_at(starts, i)
        return F.struct(F.lit(d.kind).alias("kind"), start.alias("start"), (start + F.length(found)).alias("end"), F.when(keep, F.least(score, F.lit(1.0))).otherwise(0.0).alias("score"), found.alias("found"))

    kind = "array<struct<kind:string,start:int,end:int,score:double,found:string>>"
    nothing = F.array().cast(kind)

    def listed(parts: Column) -> Column:
        some = _let(_starts(parts), lambda starts: F.filter(F.transform(F.sequence(F.lit(2), F.size(parts) - 1, F.lit(2)), lambda i: at(parts, starts, i)), lambda s: s["score"] >= THRESHOLD))
        return F.when(F.size(parts) < 3, nothing).otherwise(some)

    marked = F.split(F.regexp_replace(text, d.pattern, f"{MARK}$0{MARK}"), MARK)
    may = [F.contains(text, F.lit(d.needs))] * bool(d.needs) + [text.rlike(d.begins)] * bool(d.begins)
    found = _let(marked, listed)
    return (F.when(reduce(lambda a, b: a & b, may), found).otherwise(nothing) if may else found).cast(kind)


def _searched(docs: DataFrame) -> Column:
    """The text; a mark that it has itself becomes another control character, which no pattern matches either."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, and for each detector an array column `pii_<kind>` of struct(kind, start, end, score, found)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _searched(docs).alias("text"))
    return text.select("doc_id", *(_spans(F.col("text"), d).alias(f"pii_{d.kind}") for d in DETECTORS))


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 of their spans, and all spans as text."""
    written = lambda kind: F.transform(f"pii_{kind}", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    found = find_pii(docs)
    listed = found.select("doc_id", *(F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE), F.concat_ws(",", *(written(k) for k in BASE)).alias("base"), F.concat_ws(",", *(written(d.kind) for d in DETECTORS)).alias("spans"))
    return listed.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def redact_pii(docs: DataFrame) -> DataFrame:
    """The table with each span of its texts replaced by its kind in angle brackets. Overlapping spans become the first."""
    text = F.col("text").cast("string")
    hit = docs.withColumn("text", text)
    spans = F.array_sort(F.concat(*(F.transform(_spans(_searched(docs), d), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))) for d in DETECTORS)))

    def cut(acc: Column, s: Column) -> Column:
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(inside)

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1))
    clean = _let(spans, lambda all_: F.when(F.size(all_) == 0, text).otherwise(F.aggregate(all_, begin, cut, rest)))
    out = hit.withColumn("text", F.when(text.isNotNull(), clean))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
