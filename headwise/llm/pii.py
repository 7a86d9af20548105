"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a built-in Spark expression over one row, so nothing is shuffled and nothing leaves the JVM. The patterns
use possessive repeats and look-behinds where the plain form would try each place of a long run again: they match the
same spans in time linear in the text.

A pattern's matches and the pieces between them come from the text; their lengths give the places. Spans are code
points, the end exclusive. Base kinds are email, ip, card and phone; the added kind is iban (mod 97). Base spans that
pass their check are kept whatever their score; added ones need ``threshold``. The registered query and ``redact`` use
``EVERY``, so that context adjusts the score of a confirmed span but never drops it.

An account number has the length that its country registered, so what follows it does not matter; with a country code
outside the registry it is the longest run of whole words that mod 97 confirms. Every place where one may start is tried.

Edge cases: a null text is empty and has no spans; spans of different kinds, and account numbers, may overlap and are all listed, and are
replaced together as one stretch when a text is redacted; equal starts follow the order of the kinds; repeated rows
and other columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import fresh, text_of


@dataclass(frozen=True)
class Kind:
    """A pattern, the text that any match must contain, the score of a confirmed match, and words that raise it.

    A pattern that is ``ahead`` consumes one character and takes its match, group 1, by looking ahead, so that a match
    does not hide one that starts inside it.
    """

    name: str
    pattern: str
    needs: str | None
    score: float
    words: str
    ahead: bool = False


#: Characters of an account number by country code (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_REGISTERED = "|".join(IBAN_LENGTHS.values())
_EXACT = "|".join(rf"(?:{codes})[0-9]{{2}}(?:[\x20]?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
_IBAN = (
    r"(?=[A-Z]{2}[0-9]{2})(?<![A-Za-z0-9])(?=("
    rf"(?:{_EXACT})(?![A-Za-z0-9])"
    rf"|(?!{_REGISTERED})[A-Z]{{2}}[0-9]{{2}}(?:[\x20]?[A-Z0-9]){{11,30}}+[A-Za-z0-9]?+"
    r"))[A-Z]"
)

KINDS = (
    # \G is the end of the match before: a match may start there, inside a run, as in the plain pattern.
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write|address"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", None, 0.7, "card|visa|credit|payment|number"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", _IBAN, None, 0.6, "iban|bank|account|konto|transfer", ahead=True),
)
BASE = tuple(k.name for k in KINDS[:4])
#: Code points on each side of a span that are searched for its words.
NEAR = 40
#: The threshold that keeps every confirmed span.
EVERY = 0.0
#: What a nearby word adds to the score, and an example marker takes from it.
WORD_ADDS, EXAMPLE_TAKES = 0.3, 0.2
_EXAMPLE = "(?i)\\b(?:example|sample|dummy|test)\\b"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def mod_97(found: Column) -> Column:
    """Remainder of an account number by 97: first four characters last, letters as 10 to 35."""
    compact = F.replace(found, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    letters = F.split(turned, "")

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        digit = code < 58
        return F.when(digit, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), step)


def confirmed(kind: str, found: Column) -> Column:
    """The check of a kind: number ranges, Luhn, digit counts, mod 97."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(found)
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(found, F.lit(" "), F.lit(""))).between(15, 34) & (mod_97(found) == 1)
    return F.lit(True)


def whole_number(run: Column) -> Column:
    """The account number that a run of capitals and digits begins with: all of it where the country's length is known,
    else its longest confirmed part that ends with a word, or the run itself where none is."""
    cut = F.transform(
        F.filter(
            F.transform(F.sequence(F.char_length(run), F.lit(15), F.lit(-1)), lambda n: F.struct(F.left(run, n).alias("part"), F.substring(run, n + 1, F.lit(1)).alias("next"))),
            lambda c: ~c["part"].endswith(" ") & ~c["part"].rlike("[a-z]$") & ~c["next"].rlike("[A-Za-z0-9]"),
        ),
        lambda c: c["part"],
    )
    first = F.get(F.filter(cut, lambda part: confirmed("iban", part)), F.lit(0))
    return F.when(run.rlike(f"^(?:{_REGISTERED})"), run).otherwise(F.coalesce(first, run))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression, so that it is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(lengths: Column) -> Column:
    """Sums of all lengths up to each place, by blocks of about the square root of their number."""
    zero = F.lit(0).cast("long")

    def total(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda a, x: a + x)

    def cut(xs: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(xs))).cast("int")
        last = F.floor((F.size(xs) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * block + 1, block))

    def joined(blocks: Column) -> Column:
        before = _let(F.transform(blocks, total), lambda t: F.transform(t, lambda _, i: total(F.slice(t, F.lit(1), i))))
        return F.flatten(F.zip_with(blocks, before, lambda xs, b: F.transform(xs, lambda _, i: b + total(F.slice(xs, F.lit(1), i + 1)))))

    return _let(lengths, lambda xs: _let(cut(xs), joined))


def find(df: DataFrame, text: str = "text", spans: str = "spans", threshold: float = 0.7) -> DataFrame:
    """Add the array of spans: struct of kind, order of the kind, start, end, score; ordered by start, then kind.

    A column of the name ``spans`` is replaced.
    """
    (found_, piece_, ends_, text_) = fresh(df, "found", "pieces", "ends", "whole_text")
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() != spans.lower()]
    out = df.withColumn(text_, text_of(text))
    kind_type = "array<struct<kind:string,rank:int,start:bigint,end:bigint,score:double>>"
    none = F.array().cast("array<string>")
    # Step 1: matches. Step 2: pieces between them. Step 3: where each match ends. Each is a column of its own, so that
    # none is computed twice.
    matches = {k.name: f"{found_}_{k.name}" for k in KINDS}
    out = out.select(
        "*",
        *[
            (
                F.when(F.contains(F.col(text_), F.lit(k.needs)), F.regexp_extract_all(F.col(text_), F.lit(k.pattern), F.lit(0))).otherwise(none)
                if k.needs
                else F.transform(F.regexp_extract_all(F.col(text_), F.lit(k.pattern), F.lit(1)), whole_number)
                if k.ahead
                else F.regexp_extract_all(F.col(text_), F.lit(k.pattern), F.lit(0))
            ).alias(matches[k.name])
            for k in KINDS
        ],
    )
    pieces = {k.name: f"{piece_}_{k.name}" for k in KINDS}
    out = out.select(
        "*",
        *[F.when(F.size(matches[k.name]) > 0, F.split(F.col(text_), k.pattern, -1)).otherwise(none).alias(pieces[k.name]) for k in KINDS],
    )
    ends = {k.name: f"{ends_}_{k.name}" for k in KINDS}

    def both(k: Kind) -> Column:
        return F.zip_with(
            F.slice(F.col(pieces[k.name]), F.lit(1), F.size(matches[k.name])),
            F.col(matches[k.name]),
            lambda p, m: (F.char_length(p) + (F.lit(1) if k.ahead else F.char_length(m))).cast("long"),
        )

    out = out.select(
        "*",
        *[
            F.when(F.size(matches[k.name]) > 0, _running(both(k))).otherwise(F.array().cast("array<bigint>")).alias(ends[k.name])
            for k in KINDS
        ],
    )

    def spans_of(rank: int, k: Kind) -> Column:
        m, p, e = F.col(matches[k.name]), F.col(pieces[k.name]), F.col(ends[k.name])

        def one(found: Column, i: Column) -> Column:
            end, after = F.get(e, i), F.get(p, i + 1)
            if k.ahead:  # the piece behind the consumed character begins with the rest of the match
                end, after = end - 1 + F.char_length(found), F.substring(after, F.char_length(found), F.lit(NEAR))
            near = F.concat_ws(" ", F.right(F.get(p, i), F.lit(NEAR)), F.left(after, F.lit(NEAR)))
            score = (
                F.lit(k.score)
                + F.when(near.rlike(f"(?i)\\b(?:{k.words})"), WORD_ADDS).otherwise(0.0)
                - F.when(near.rlike(_EXAMPLE), EXAMPLE_TAKES).otherwise(0.0)
            )
            return F.struct(
                F.lit(k.name).alias("kind"),
                F.lit(rank).alias("rank"),
                (end - F.char_length(found)).alias("start"),
                end.alias("end"),
                F.when(confirmed(k.name, found), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("score"),
            )

        keep = (lambda s: s["score"].isNotNull()) if k.name in BASE else (lambda s: s["score"] >= threshold)
        return F.when(F.size(m) > 0, F.filter(F.transform(m, one), keep)).otherwise(F.array()).cast(kind_type)

    all_spans = F.concat(*[spans_of(i, k) for i, k in enumerate(KINDS)])
    ordered = F.transform(
        F.array_sort(F.transform(all_spans, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"], s["score"]))),
        lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")),
    )
    return out.select(*columns, ordered.alias(spans))


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of each span, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(spans: Column) -> Column:
    """The score of each span to two places, in the order of ``listed``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span by its kind in brackets; overlapping spans become one stretch named by the first.

    Finding spans takes time in proportion to the text; cutting them out takes, for a text that has spans, a walk to each.
    """
    (spans,) = fresh(df, "spans")
    found = find(df, text, spans, EVERY)
    stretches = F.aggregate(
        F.col(spans),
        F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["kind"].alias("kind"),
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))),
    )
    (parts,) = fresh(found, "stretches")
    cut = found.withColumn(parts, F.when(F.size(spans) > 0, stretches))
    whole = text_of(text)

    def after(s: Column, i: Column) -> Column:
        following = F.get(F.col(parts), i + 1)["start"]
        tail = F.substring(whole, (s["end"] + 1).cast("int"), (F.coalesce(following, F.char_length(whole).cast("long")) - s["end"]).cast("int"))
        return F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"), tail)

    clean = F.when(
        F.col(parts).isNotNull(),
        F.concat(F.substring(whole, F.lit(1), F.get(F.col(parts), 0)["start"].cast("int")), F.array_join(F.transform(F.col(parts), after), "")),
    ).otherwise(F.col(f"`{text}`"))
    return cut.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
