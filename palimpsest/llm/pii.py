"""Personal data by weak supervision, in DataFrame functions alone.

Base spans, leftmost and not overlapping within a kind, failing matches dropped without a retry: email; ip (four decimal
parts of at most 255); card (14 to 19 digits with single blanks or hyphens, passing Luhn); phone (a plus sign and 10 to 15
digits). The patterns are written so that matching stays linear on any text: runs are possessive, and a match cannot begin
inside a run that has failed.

Method. Candidates are the base matches, those that fail the check of their kind, and looser forms: emails with a written
"at", phone numbers without a plus sign, IPv6 addresses; and secrets (runs of 20 characters or more as keys and tokens have
them), a kind without a base, where all is decided by the votes. Labelers vote on each: the strict pattern, the check, a gazetteer
(common endings of domains, first digits of card issuers, and so on), words before the span that speak for its kind, and
words that speak against it. The first two do not apply to looser forms, which fail both by construction, and say nothing of
them (? in a pattern of votes); the check of a secret is that it mixes letters and digits. For each kind EM estimates the reliability of each labeler from the counts of vote patterns,
and a logistic classifier over the votes is trained on the posteriors. A candidate that overlaps no base span and to which the
classifier gives at least ``threshold`` is added; base spans stay whatever the votes.

Scale. One pass over the texts, no shuffle of them; the spans are written to the shared folder, vote patterns (at most
5 * (3^5 + 3^4)) are counted and fitted on the driver, and the decision returns as a literal of that size.

Positions are code points, end exclusive. Defined results. Null or empty text: no spans, the digest of the empty string.
Repeated rows are judged each. Null ids are carried. Very long texts are matched whole. Empty table: no rows. Other columns
of the input are not carried, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import core, weak

#: Kinds with base spans, and all.
BASIC = ("email", "ip", "card", "phone")
KINDS = (*BASIC, "secret")

# Patterns by kind, base ones and looser ones.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+",
}
#: What a text must hold before a pattern is tried; a cheap test.
NEEDED = {"email": "@", "phone": "+"}
NEEDED_LOOSE = {"email": r"[(\[{]at[)\]}]", "secret": r"[A-Za-z0-9_+/-]{20}"}
#: Words before a span that speak for its kind; matched in the last 40 characters, lower-cased.
FOR = {
    "email": r"(?:e-?mail|contact|write to|reach|mailto|courriel|correo|kontakt)[^a-z]",
    "ip": r"(?:\bip\b|host|server|address|connect|from|adresse|direcci)",
    "card": r"(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)",
    "phone": r"(?:phone|tel|call|mobile|fax|cell|contact|anruf|appel|llam)",
    "secret": r"(?:token|secret|api[ _-]?key|access[ _-]?key|passw|pwd|bearer|credential|auth)[^a-z]*$",
}
#: Words before a span that speak against it, for every kind.
AGAINST = r"(?:version|chapter|section|page|isbn|order no|item no|build|release|serial|sha|hash|uuid|total|sum)[^a-z]*$"
#: Endings of domains, and first digits of card issuers, of private and special networks.
GAZETTEER = {
    "email": r"(?i)[.)\]}\x20](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at|it|nl)$",
    "ip": r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|[1-9][0-9]{0,2}\.|2[0-9a-fA-F]{3}:)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+[1-9]|\(?[2-9])",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]+|sk[-_][A-Za-z0-9_-]+|xox[abprs]-[A-Za-z0-9-]+|eyJ[A-Za-z0-9_-]+)$",
}
#: A digit and a letter, which random strings of that length hold.
MIXED = r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"
FOUND = "array<struct<s:int,k:int,e:int>>"


def _matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, m, b): start, end, match, and up to 40 characters between the match before and this one."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda seg, m: F.struct(seg.alias("seg"), m.alias("m")))
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string,b:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["seg"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("pos"), F.array_append(acc["out"], F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), F.right(x["seg"], F.lit(40)).alias("b"))).alias("out"))

    return F.aggregate(F.filter(pieces, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])


def _guarded(text: Column, needed: str | None, value: Column) -> Column:
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string,b:string>>)")
    return F.when(F.contains(text, F.lit(needed)), value).otherwise(none) if needed else value


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    """The check of the kind, on a match of its base pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(part: Column) -> Column:
            short = F.regexp_replace(part, "^0+(?=[0-9])", "")
            return F.when(F.length(short) <= 3, short.cast("int") <= 255).otherwise(False)

        return F.forall(F.split(m, r"\.", -1), small)
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(m))).otherwise(False)
    return n.between(10, 15)


#: How often each labeler is taken to be right before EM: strict pattern, check, gazetteer, words for, words against.
ACCURACY = (0.8, 0.95, 0.7, 0.9, 0.9)


def _votes(kind: str, m: Column, b: Column, passed: Column | None) -> Column:
    """A character a labeler: strict pattern (for cards, groups of digits), check, gazetteer, words for, words against.

    Looser forms have no ``passed``.
    """
    before = F.lower(b)
    if kind == "card":
        form = F.when(F.rlike(m, F.lit(r"^[0-9]{4}([\x20-])[0-9]{4,6}\1[0-9]{4,5}")), "1").otherwise("-")
    else:
        form = F.lit("?" if passed is None else "1")
    if kind == "secret":
        passed = F.rlike(m, F.lit(MIXED))
    return F.concat(
        form,
        F.lit("?") if passed is None else F.when(passed, "1").otherwise("0"),
        F.when(F.rlike(m, F.lit(GAZETTEER[kind])), "1").otherwise("0"),
        F.when(F.rlike(before, F.lit(FOR[kind])), "1").otherwise("-"),
        F.when(F.rlike(before, F.lit(AGAINST)), "0").otherwise("-"),
    )


def _candidates(text: Column, kind: str) -> Column:
    """Array of (s, k, e, base, votes) of one kind; runs of digits too short for a card are none."""
    k = F.lit(KINDS.index(kind))

    def judged(x: Column, strict: bool) -> Column:
        passed = _passes(kind, x["m"]) if strict else None
        return F.struct(x["s"].alias("s"), k.alias("k"), x["e"].alias("e"), (passed if strict else F.lit(False)).alias("base"), _votes(kind, x["m"], x["b"], passed).alias("votes"))

    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string,b:string>>)")
    parts = []
    if kind in BASE:
        found = _guarded(text, NEEDED.get(kind), _matches(text, BASE[kind]))
        if kind == "card":
            found = F.filter(found, lambda x: F.length(x["m"]) >= 13)
        parts.append(F.transform(found, lambda x: judged(x, True)))
    if kind in LOOSE:
        loose = _matches(text, LOOSE[kind])
        if kind in NEEDED_LOOSE:
            loose = F.when(F.rlike(text, F.lit(NEEDED_LOOSE[kind])), loose).otherwise(none)
        parts.append(F.transform(loose, lambda x: judged(x, False)))
    return F.concat(*parts)


def _decided(candidates: DataFrame, threshold: float) -> list[str]:
    """The keys (kind index and votes) of the candidates to add; all counts are over the whole table."""
    counts: dict[str, dict[str, int]] = {}
    for r in candidates.select(F.explode("found").alias("x")).groupBy("x.k", "x.votes").agg(F.count("*").alias("n")).collect():
        counts.setdefault(str(r["k"]), {})[r["votes"]] = r["n"]
    good = []
    for k, patterns in counts.items():
        posterior = weak.fit(patterns, weak.votes_begin(np.array(ACCURACY)), np.array([0.5, 0.5]))[2]
        good += [k + votes for votes, p in weak.classifier(patterns, posterior).items() if p >= threshold]
    return sorted(good)


def find_pii(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(doc_id, base, spans): arrays of (s, k, e), k the index in ``KINDS``, in order of start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select("doc_id", *[_candidates(text, kind).alias(kind) for kind in KINDS])
    every = parts.select("doc_id", F.concat(*KINDS).alias("every")).withColumn("sure", F.filter("every", lambda x: x["base"]))
    # what overlaps a base span is no candidate
    free = lambda x: ~F.exists("sure", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    found = core.cut(every.select("doc_id", F.filter("every", lambda x: x["base"] | free(x)).alias("found")))
    good = _decided(found, threshold)
    span = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    base = found.withColumn("base", F.array_sort(F.transform(F.filter("found", lambda x: x["base"]), span)))
    if not good:
        return base.select("doc_id", "base", F.col("base").alias("spans"))
    added = F.filter("found", lambda x: ~x["base"] & F.concat(x["k"].cast("string"), x["votes"]).isin(good))
    return base.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", F.transform(added, span)))).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["k"]], x["s"], x["e"])), ",")
