"""Personal data by native expressions only: regular expressions propose, checksums confirm, context adjusts the score.

Patterns are written so that Java's matcher neither recurses nor rescans a run of characters: possessive quantifiers, and
starts only at the head of a run (or where the last match ended), which finds the same leftmost matches as the plain form.
Positions come from the lengths of the pieces between matches, so they count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAIL = "[A-Za-z0-9._%+-]"
#: kind: pattern, the characters one of which every match holds, score, words before a match that raise it, by how much.
#: The first four are the base kinds, whose spans always stay; the others must reach KEEP.
KINDS = {
    "email": (rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|correo|courriel", 0.1),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address|adresse", 0.3),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "", 0.8, "card|visa|credit|karte|carte|tarjeta", 0.2),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|tel|call|mobile|fax", 0.2),
    "iban": (r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", "", 0.8, "iban|account|konto|compte|cuenta", 0.2),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", 0.3, "ssn|social security", 0.4),
}
BASE = ("email", "ip", "card", "phone")
KEEP = 0.5
CONTEXT_CHARS = 40


def luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, -1 * i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest, char):
        value = F.conv(char, 36, 10).cast("int")
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c))) == 1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _confirmed(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(F.substring(short(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _spans(text: Column, rank: int, kind: str) -> Column:
    """The kind's matches that are confirmed, as an array of structs (start, rank, end, kind, match, score)."""
    pattern, needs, score, words, more = KINDS[kind]
    maybe = text.contains(needs) if needs else F.lit(True)
    if kind != "email":
        maybe = maybe & text.rlike("[0-9]")
    shape = "array<struct<start:int,rank:int,end:int,kind:string,match:string,score:double>>"
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        before = F.lower(F.substring(pair["gap"], -CONTEXT_CHARS, CONTEXT_CHARS))
        total = F.round(F.lit(score) + F.when(before.rlike(words), more).otherwise(0.0), 2)
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["match"].alias("match"), total.alias("score"))
        good = _confirmed(kind, pair["match"])
        good = good if kind in BASE else good & (total >= KEEP)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).cast(shape).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    found = F.aggregate(pairs, empty, step, lambda acc: acc["out"])
    return F.when(maybe & (F.size(matches) > 0), found).otherwise(F.array().cast(shape))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, rank, end, kind, match, score by start, then kind as listed) of every row.

    Null text counts as empty; texts of any length are read whole; repeated rows are treated alike; matches of two kinds at
    one place are both given, in the order of KINDS; an empty table gives an empty result; extra columns are left out.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = text.select("doc_id", *(_spans(F.col("text"), i, k).alias(k) for i, k in enumerate(KINDS)))
    return each.select("doc_id", F.array_sort(F.concat(*KINDS)).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans as kind:start:end joined by commas, of every row; cases as in find."""
    found = find(docs)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
