"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All of it is column expressions: for each kind, ``regexp_extract_all`` gives the matches and
``split`` at the same pattern the text between them, so that lengths add up to positions.  Possessive
quantifiers and anchors at run starts keep the matcher linear and off the call stack for any length;
they match what the plain patterns match.

Base kinds keep every span that its validator confirms.  The kinds added by this method (bank account
by mod-97, national number by its context) are kept if prior, checksum and context words within
``CONTEXT`` characters reach ``THRESHOLD``.

Null texts count as empty and have no spans; a null id stays null; repeated rows give repeated rows;
columns other than the named ones play no part, a column called spans of the input is not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

CONTEXT, THRESHOLD, CHUNK = 40, 0.6, 256


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether 14 to 19 digits pass Luhn's check."""
    plain = F.reverse(digits(match))
    doubled = F.translate(plain, "0123456789", "0246813579")
    at = lambda text, i: F.substring(text, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(plain)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, at(plain, i)).otherwise(at(doubled, i)))
    return F.when(F.length(plain).between(14, 19), total % 10 == 0).otherwise(False)


def mod97(match: Column) -> Column:
    """Whether an account number's remainder by 97 is 1, letters counted from 10."""
    text = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    code = lambda c: F.ascii(c)
    step = lambda acc, c: F.when(code(c) >= 65, (acc * 100 + code(c) - 55) % 97).otherwise((acc * 10 + code(c) - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), lambda acc, i: step(acc, F.substring(moved, i, F.lit(1)))) == 1


PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.  ``gate`` is a text that each match holds; ``context`` a pattern of nearby words."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    base: bool
    prior: float
    context: str
    gate: str | None = None


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), True, 0.9, r"mail|contact|correo|courriel|kontakt", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: F.rlike(m, F.lit(rf"^{PART}(?:\.{PART}){{3}}$")), True, 0.7, r"\bip\b|host|server|address|addr", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", luhn, True, 0.8, r"card|visa|credit|tarjeta|carte|karte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(10, 15), True, 0.7, r"phone|call|tel|mobile|fax|telefon|movil", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", mod97, False, 0.7, r"iban|account|konto|compte|cuenta|bank"),
    Kind("ssn", r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])", lambda m: F.lit(True), False, 0.3, r"ssn|social|security|national|tax", "-"),
)


def _add(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda acc, x: acc + x)


def _with_starts(df: DataFrame, name: str) -> DataFrame:
    """Adds the length of the text before each match, without the piece right before it, in code points.

    Sums run in two levels, within chunks and over chunks, so that many matches stay cheap.  The levels
    are columns of their own, each used twice, as the optimizer then computes them once a row.
    """
    matches, pieces, chunks, sums = (F.col(f"_{name}_{x}") for x in ("matches", "pieces", "chunks", "sums"))
    lengths = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
    df = df.withColumn(f"_{name}_lengths", F.when(F.size(matches) > 0, lengths))
    own = F.col(f"_{name}_lengths")
    cut_up = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / CHUNK).cast("int")), lambda c: F.slice(own, c * CHUNK + 1, F.lit(CHUNK)))
    df = df.withColumn(f"_{name}_chunks", F.when(F.size(own) > 0, cut_up))
    df = df.withColumn(f"_{name}_sums", F.when(F.size(chunks) > 0, F.transform(chunks, _add)))
    df = df.withColumn(f"_{name}_before", F.when(F.size(sums) > 0, F.transform(sums, lambda x, c: _add(F.slice(sums, F.lit(1), c)))))
    before = F.col(f"_{name}_before")
    starts = F.transform(chunks, lambda part, c: F.transform(part, lambda x, i: F.get(before, c) + _add(F.slice(part, F.lit(1), i))))
    return df.withColumn(f"_{name}_starts", F.when((F.size(chunks) > 0) & (F.size(before) > 0), F.flatten(starts)))


def _spans(order: int, kind: Kind) -> Column:
    """Confirmed spans of a kind from the columns with its matches, the text between them and their positions."""
    matches, pieces, starts = (F.col(f"_{kind.name}_{x}") for x in ("matches", "pieces", "starts"))

    def span(m: Column, i: Column) -> Column:
        before, own = F.get(pieces, i), F.get(starts, i) + F.length(F.get(pieces, i))
        near = F.lower(F.concat_ws(" ", F.right(before, F.lit(CONTEXT)), F.left(F.get(pieces, i + 1), F.lit(CONTEXT))))
        score = F.least(F.lit(1.0), F.lit(kind.prior) + F.when(F.rlike(near, F.lit(kind.context)), 0.3).otherwise(0.0))
        return F.struct(own.alias("start"), F.lit(order).alias("rank"), (own + F.length(m)).alias("end"), F.lit(kind.name).alias("kind"), m.alias("text"), kind.valid(m).alias("valid"), F.lit(kind.base).alias("base"), score.alias("score"))

    kept = F.filter(F.transform(matches, span), lambda s: s["valid"] & (s["base"] | (s["score"] >= THRESHOLD)))
    return F.when(F.size(matches) > 0, kept).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start: int, rank: int, end: int, kind: string, text: string, valid: boolean, base: boolean, score: double>>"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): spans sorted by start, then by kind as listed; start and end count code points, end exclusive."""
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text, none = F.col("_text"), F.array().cast("array<string>")
    found = {f"_{k.name}_matches": F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)) for k in KINDS}
    gated = {c: F.when(F.contains(text, F.lit(k.gate)), e).otherwise(none) if k.gate else e for (c, e), k in zip(found.items(), KINDS, strict=True)}
    df = df.withColumns(gated)
    df = df.withColumns({f"_{k.name}_pieces": F.when(F.size(f"_{k.name}_matches") > 0, F.split(text, k.pattern, -1)) for k in KINDS})
    for k in KINDS:
        df = _with_starts(df, k.name)
    spans = F.array_sort(F.concat(*(_spans(i, k) for i, k in enumerate(KINDS))))
    return df.select(F.col(id_col), spans.alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every confirmed span of its text replaced by its kind in brackets; null texts stay null.

    Kind follows kind in the listed order, each from the text between its matches, so the cost stays
    linear.  All other columns are kept.
    """
    for kind in KINDS:
        docs = _redact_kind(docs, kind, text_col)
    return docs


def _redact_kind(docs: DataFrame, kind: Kind, text_col: str) -> DataFrame:
    names = [fresh(f"_{kind.name}_{x}", docs.columns) for x in ("matches", "pieces")]
    text, matches, pieces = F.col(text_col), *map(F.col, names)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    docs = docs.withColumn(names[0], F.when(F.contains(text, F.lit(kind.gate)), found) if kind.gate else found)
    docs = docs.withColumn(names[1], F.when(F.size(matches) > 0, F.split(text, kind.pattern, -1)))

    def put(m: Column, i: Column) -> Column:
        near = F.lower(F.concat_ws(" ", F.right(F.get(pieces, i), F.lit(CONTEXT)), F.left(F.get(pieces, i + 1), F.lit(CONTEXT))))
        sure = F.lit(True) if kind.base else F.lit(kind.prior) + F.when(F.rlike(near, F.lit(kind.context)), 0.3).otherwise(0.0) >= THRESHOLD
        return F.concat(F.get(pieces, i), F.when(kind.valid(m) & sure, F.lit(f"[{kind.name.upper()}]")).otherwise(m))

    joined = F.concat(F.array_join(F.transform(matches, put), ""), F.element_at(pieces, -1))
    return docs.withColumn(text_col, F.when(F.size(matches) > 0, joined).otherwise(text)).drop(*names)


def listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k.name)).cast("long").alias(f"n_{k.name}")
    of = lambda own: [count(k) for k in KINDS if k.base == own]
    return found.select("doc_id", *of(True), F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"), *of(False))


QUERIES = {"op8_pii": op8_pii}
