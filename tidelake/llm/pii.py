"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust a score.

Everything is DataFrame functions. Java's regex engine gives matches and what lies between them, and lengths in code points
add up to offsets. The patterns match the same spans as the contract's plain ones, written so that each text is read once:
a match may start only where a run starts or the last match ended, and runs don't give back what they took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "amex", "ssn")
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # maximal runs of digits and single separators, of 16 to 19 digits; others would be dropped anyway
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # only the first four characters are taken, so that nothing behind them is lost; group 1 is the longest run of groups of four
    # and a shorter last one that ends at a word's end, 35 characters at most
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}",
    "amex": r"(?<![0-9])(?<![0-9][\x20-])3[47](?:[\x20-]?[0-9]){13}+(?![\x20-]?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Lengths of IBANs by country; those of countries not listed have 15 to 34 characters.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
OF_A_LENGTH = "|".join(f"(?:{c.replace(' ', '|')}).{{{n - 2}}}" for n, c in LENGTHS.items())
IBAN = rf"^(?:{OF_A_LENGTH}|(?!{'|'.join(LENGTHS.values()).replace(' ', '|')}).{{15,34}})$"
#: Cheap tests that a text with a match passes.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}+"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "amex": lambda t: t.rlike(r"3[47](?:[\x20-]?[0-9]){13}+"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
#: Words that make a kind likelier when they stand near, and how near (code points before and after).
CONTEXT = {
    "email": "mail|contact|write to", "ip": r"\bip\b|server|host|address", "card": "card|visa|credit|payment", "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|konto|cuenta|compte", "amex": "card|amex|american express|credit|payment", "ssn": r"\bssn\b|social security",
}
NEAR = 40
#: Scores: for a match, a checksum that holds, and a word nearby; added kinds count from ENOUGH on, base kinds always.
MATCHED, CHECKED, NEARBY, ENOUGH = 0.4, 0.4, 0.3, 0.7
#: Items whose outputs are gathered before they are joined; characters in a piece of a long text.
TOGETHER, PIECE = 256, 4096
SPAN = "array<struct<kind:string,start:long,end:long,hit:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), 1, 19).substr(i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has the remainder 1: four first characters moved to the end, letters as 10 to 35."""
    turned = F.concat(iban.substr(F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _holds(kind: str, hit: Column) -> Column:
    """The checks that a match must pass to be a span at all."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind in ("card", "amex"):
        return luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    if kind == "iban":
        bare = F.regexp_replace(hit, " ", "")
        return bare.rlike(IBAN) & mod97(bare)
    return F.lit(True)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once, whatever the optimizer does."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, state: Column, step, nothing: Column) -> Column:
    """What step(state, item) -> (next state, output) puts out for each item in turn; `nothing` is an empty array of outputs.
    Outputs are gathered TOGETHER by TOGETHER and joined at the end, so that long arrays aren't copied for every item."""

    def one(acc: Column, x: Column) -> Column:
        new, out = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def part(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["state"].alias("state"), nothing.alias("out")), one)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def whole(xs: Column) -> Column:
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(TOGETHER))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda i: F.slice(xs, i, F.lit(TOGETHER)))
        return F.aggregate(parts, F.struct(state.alias("state"), F.slice(F.array(nothing), 2, 1).alias("out")), part, lambda acc: F.flatten(acc["out"]))

    return let(items, whole)


def pieces(text: Column) -> Column:
    """A long text in pieces of PIECE characters, so that a place in it is found without reading from its start; short texts
    have none."""
    return F.when(F.length(text) > PIECE, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def between(text: Column, parts: Column, start: Column, end: Column) -> Column:
    """The characters from start to end (exclusive) of a text with these pieces."""
    of = lambda at: F.floor(at / PIECE).cast("int")
    piece = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    low, high = (start - of(start) * PIECE).cast("int"), (end - of(end) * PIECE).cast("int")
    apart = F.concat(F.substr(piece(of(start)), low + 1), F.array_join(F.slice(parts, of(start) + 2, F.greatest(of(end) - of(start) - 1, F.lit(0))), ""), F.substr(piece(of(end)), F.lit(1), high))
    long = F.when(of(start) == of(end), F.substr(piece(of(start)), low + 1, high - low)).otherwise(apart)
    return F.when(F.size(parts) == 0, F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))).otherwise(long)


def ibans(text: Column) -> Column:
    """All leftmost IBANs that don't overlap, with offsets in code points. Capitals and digits after a number look like more of
    it, so every part of a run that ends at a word's end is checked; of several that hold the longest counts."""
    pattern = PATTERNS["iban"]
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda gap, run: F.struct(gap.alias("gap"), run.alias("run")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("end"))

    def longest(run: Column) -> Column:
        words = F.split(run, " ")
        parts = F.transform(words, lambda _, i: F.array_join(F.slice(words, F.lit(1), i + 1), " "))
        return F.try_element_at(F.filter(parts, lambda part: _holds("iban", part)), F.lit(-1))

    def add(acc: Column, x: Column) -> tuple[Column, Column]:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(F.lit("iban").alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), x["hit"].alias("hit"))
        new = x["hit"].isNotNull() & (start >= acc["end"])
        return F.struct((start + 4).cast("long").alias("at"), F.when(new, end).otherwise(acc["end"]).cast("long").alias("end")), F.when(new, span)

    checked = F.transform(pairs, lambda x: F.struct(x["gap"].alias("gap"), longest(x["run"]).alias("hit")))
    found = F.filter(running(checked, zero, add, F.array().cast(SPAN)), lambda s: s.isNotNull())
    return F.when(HINTS["iban"](text), found).otherwise(F.array().cast(SPAN))


def matches(text: Column, kind: str) -> Column:
    """All leftmost matches of a kind that don't overlap, with offsets in code points, before any check (IBANs: after it)."""
    if kind == "iban":
        return ibans(text)
    pattern = PATTERNS[kind]
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    def add(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), x["hit"].alias("hit"))
        return end.cast("long"), F.when(x["hit"].isNotNull(), span)

    found = F.filter(running(pairs, F.lit(0).cast("long"), add, F.array().cast(SPAN)), lambda s: s.isNotNull())
    return F.when(HINTS[kind](text), found).otherwise(F.array().cast(SPAN))


def find(df: DataFrame, text: str = "text", name: str = "_spans") -> DataFrame:
    """Adds _spans (or another name): an array of (kind, start, end, score), by kind as listed in BASE and ADDED, then start; end exclusive.

    A null text counts as empty and has no spans. Rows are taken one by one, so nulls, ties and repeated rows elsewhere
    don't matter; a column of df that is named _spans is replaced, others may have any name. The work grows with a text's
    length, however many spans it has.
    """
    return df.withColumn(name, spans(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def spans(text: Column) -> Column:
    def of_text(t: Column, parts: Column) -> Column:
        kept = []
        for kind in BASE + ADDED:
            scored = F.transform(F.filter(matches(t, kind), _held(kind)), _scored(t, parts, kind))
            kept.append(scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= ENOUGH))
        return F.concat(*kept)

    return let(text, lambda t: let(pieces(t), lambda parts: of_text(t, parts)))


def _held(kind: str):
    return lambda s: _holds(kind, s["hit"])


def _scored(t: Column, parts: Column, kind: str):
    def scored(s: Column) -> Column:
        before = between(t, parts, F.greatest(s["start"] - NEAR, F.lit(0).cast("long")), s["start"])
        near = F.lower(F.concat(before, F.lit(" "), between(t, parts, s["end"], F.least(s["end"] + NEAR, F.length(t).cast("long")))))
        score = MATCHED + (CHECKED if kind in ("card", "amex", "iban", "ip", "phone") else 0) + F.when(near.rlike(CONTEXT[kind]), NEARBY).otherwise(0.0)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    return scored


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Puts [EMAIL], [IP] and so on in the place of every span; of spans that overlap, the first one's name stays. A null
    text stays null; rows are taken one by one, and other columns stay, whatever their names."""

    def masked(t: Column, parts: Column, found: Column) -> Column:
        def add(at: Column, s: Column) -> tuple[Column, Column]:
            name = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.concat(between(t, parts, at, s["start"]), name))

        ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        last = F.array_max(F.transform(found, lambda s: s["end"]))
        return F.concat(F.array_join(running(ordered, F.lit(0).cast("long"), add, F.array().cast("array<string>")), ""), between(t, parts, last, F.length(t).cast("long")))

    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    done = let(whole, lambda t: let(spans(t), lambda found: F.when(F.size(found) > 0, let(pieces(t), lambda parts: masked(t, parts, found)))))
    return df.withColumn(text, F.coalesce(done, F.col(f"`{text}`")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    df = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE))
    return df.select("doc_id", *(of(k).alias(f"n_{k}") for k in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"),
                     F.coalesce(F.array_min(F.transform("_spans", lambda s: s["score"])), F.lit(0.0)).alias("least_score"))
