"""Personal data in texts, with SQL functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and value ranges confirm them, and
context words close by adjust each span's score. Places come from the lengths of the stretches
between matches, counted in code points. Repetitions are possessive and tied to the start of their
run, so long runs of one class are read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]


def _run_start(inside: str) -> str:
    """Only where a run of the class starts, or right after the match before."""
    return rf"(?=[{inside}])(?:(?<![{inside}])|\G)"


#: Account numbers: characters in all, by country; the second part is of countries that are not in the standard.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST" + " AO CV GW MZ", 26: "IS TR" + " DZ IR", 27: "BI DJ FR GR IT MC MR SM" + " CF CG CM GA GQ KM MG TD",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV" + " BF BJ CI MA ML NE SN TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account() -> str:
    """The first four characters, and ahead of them, as group 1, the whole number in its country's length.

    Only the four are taken, so a number that fails the checksum hides none that starts within it.
    A code of no country takes the longest run of up to 34 characters.
    """
    more = r"(?:\x20?[A-Z0-9])"
    known = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}{more}{{{n - 4}}}" for n, codes in LENGTHS.items())
    other = rf"(?!{'|'.join(' '.join(LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}{more}{{11,30}}"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{known}|{other})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"


_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": _run_start(_LOCAL) + rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _run_start("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _account(),
}
#: What a text must hold before the pattern is worth trying.
HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){11}[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]"}
#: Words that make a kind likelier within ``CONTEXT_CHARS`` before a span.
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank"),
}
CONTEXT_CHARS = 40
#: No match takes less than two characters, so no more of them reach into ``CONTEXT_CHARS``.
CONTEXT_MATCHES = CONTEXT_CHARS // 2
#: Score of a confirmed span without and with a context word.
SCORES = {"email": (0.9, 1.0), "ip": (0.7, 0.9), "card": (0.8, 1.0), "phone": (0.6, 0.9), "iban": (0.85, 1.0)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running_total(lengths: Column, block: int = 128) -> Column:
    """The sum of all entries before each, in blocks, so that long arrays stay cheap."""
    none = F.array().cast("array<bigint>")

    def within(total: Column, part: Column) -> Column:
        start = F.struct(total.alias("total"), none.alias("sums"))
        return F.aggregate(part, start, lambda a, x: F.struct((a["total"] + x).alias("total"), F.concat(a["sums"], F.array(a["total"])).alias("sums")))

    def step(a: Column, part: Column) -> Column:
        return let(within(a["total"], part), lambda w: F.struct(w["total"].alias("total"), F.concat(a["parts"], F.array(w["sums"])).alias("parts")))

    def total(values: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda i: F.slice(values, i * block + 1, F.lit(block)))
        start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<array<bigint>>").alias("parts"))
        return F.flatten(F.aggregate(parts, start, step, lambda a: a["parts"]))

    return let(lengths, total)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(c: Column, i: Column) -> Column:
        twice = c.cast("int") * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 check."""
    turned = F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))
    digit = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + digit(c)) % 97) == 1


def confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(value, " ", ""))
    return F.lit(True)


SPAN = "array<struct<start: bigint, order: int, end: bigint, kind: string, score: double>>"


def spans_of(kind: str, text: Column) -> Column:
    """All confirmed spans of one kind in order, leftmost and non-overlapping but for account numbers."""
    plain, near = SCORES[kind]
    close = rf"(?i)(?:{'|'.join(CONTEXT[kind])})"
    group = 1 if kind == "iban" else 0

    def taken(v: Column) -> Column:
        return F.substring(v, 1, 4) if kind == "iban" else v

    def before_match(gaps: Column, found: Column, i: Column, n: Column) -> Column:
        """The last n, at most ``CONTEXT_CHARS``, characters before match i."""
        tail = lambda g: F.substring(g, -CONTEXT_CHARS, CONTEXT_CHARS)
        parts = F.transform(F.sequence(F.greatest(i - CONTEXT_MATCHES, F.lit(0)), i), lambda j: F.concat(tail(gaps[j]), F.when(j < i, taken(found[j])).otherwise("")))
        return F.substring(F.array_join(parts, ""), -n, n)

    def place(gaps: Column, found: Column, before: Column) -> Column:
        placed = F.transform(found, lambda v, i: F.struct((before[i] + F.length(gaps[i])).alias("start"), v.alias("v"), i.alias("i")))

        def scored(kept: Column, s: Column, k: Column) -> Column:
            # back to the confirmed span before, whose context words are its own
            back = s["start"] - F.when(k > 0, kept[k - 1]["start"] + F.length(kept[k - 1]["v"])).otherwise(0)
            words = before_match(gaps, found, s["i"], F.greatest(F.least(back, F.lit(CONTEXT_CHARS)), F.lit(0)).cast("int"))
            return F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), (s["start"] + F.length(s["v"])).alias("end"),
                F.lit(kind).alias("kind"), F.when(words.rlike(close), near).otherwise(plain).alias("score"),
            )

        return let(F.filter(placed, lambda s: confirmed(kind, s["v"])), lambda kept: F.transform(kept, lambda s, k: scored(kept, s, k)).cast(SPAN))

    def located(gaps: Column) -> Column:
        return let(
            F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(group)),
            lambda found: let(running_total(F.zip_with(gaps, found, lambda g, v: (F.length(g) + F.coalesce(F.length(taken(v)), F.lit(0))).cast("bigint"))), lambda before: place(gaps, found, before)),
        )

    return F.when(text.rlike(HINTS[kind]), let(F.split(text, PATTERNS[kind], -1), located)).otherwise(F.array().cast(SPAN))


def with_spans(docs: DataFrame, least_score: float = 0.5, text_col: str = "text", to: str = "spans") -> DataFrame:
    """The rows with a column of every confirmed span of every kind, by start, then kind as listed.

    Spans of the base kinds always stay; others stay at ``least_score`` or more. Places are code
    points, ends exclusive. A null or empty text has no span; rows stay as they are, repeated ones
    too; spans of different kinds may overlap, and account numbers where each passes its check.
    """
    text, held = F.coalesce(F.col(text_col), F.lit("")), [f"__{to}_{k}" for k in KINDS]
    found = docs.withColumns({c: spans_of(k, text) for c, k in zip(held, KINDS, strict=True)})
    every = F.array_sort(F.concat(*(F.col(c) for c in held)))
    return found.withColumn(to, F.filter(every, lambda s: (s["order"] < len(BASE)) | (s["score"] >= least_score))).drop(*held)


def find(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans; see ``with_spans``."""
    return with_spans(id_and_text(docs, id_col, text_col), least_score)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as one string."""

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["order"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        shown = F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(new, shown).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    whole = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
