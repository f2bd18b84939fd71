"""Text primitives as Spark columns: tokens, sets, similarity, slugs, prompt kinds."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English function words and filler; pass another list to ``tokens`` where it matters.
STOPWORDS = (
    "a an the and or but if then than so because as of to in on at by for with from into over under i me my we our you your it its this that these those "
    "is are was were be been am do does did have has had can could should would will may might must not no just please thanks ok now there what which who when where why how "
    "all any some other only same new about after before out up off again once always never let make get go want need like also use try"
).split()

#: Prompts that go on with the work at hand.
CONTINUATIONS = [
    "yes", "yep", "yeah", "ok", "okay", "sure", "go ahead", "go on", "continue", "proceed", "do it", "sounds good", "perfect", "thanks", "thank you", "great",
    "nice", "lgtm", "ship it", "approved", "y", "n", "no", "next", "keep going", "carry on", "fix it", "try again", "retry", "again", "same", "done",
]

#: Standing rules, then redirections of the work in progress. ``<`` and ``>`` stand for word boundaries.
STANDING = ["<always>", "<never>", "<from now on>", "<going forward>", "<every time>", "<each time>", "<by default>", "<remember (?:to|that)>", "<don'?t forget>", "<make sure (?:you|to)>", "<in future>", "<stop (?:doing|adding|using)>"]
FIX = ["^(?:no|nope|nah)>", "^(?:actually|instead|wait)>", "<that'?s (?:not|wrong|incorrect)>", "<don'?t (?:do|use|change|touch|edit|remove|add)>", "<you (?:forgot|missed|broke|removed|changed)>", "<why did you>", "<(?:revert|undo) (?:that|this|it)>", "<not what i (?:asked|wanted|meant)>", "<use .{2,40} instead>", "<i (?:said|told you)>"]


def _marker(pattern: str) -> str:
    """ASCII word boundaries, which Java's own are not."""
    return "(?i)" + pattern.replace("<", "(?<![0-9A-Za-z_])").replace(">", "(?![0-9A-Za-z_])")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value standing in the expression once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def tokens(text: Column, stopwords: list[str] | tuple[str, ...] = tuple(STOPWORDS)) -> Column:
    """Lower-case words of two characters at least, without stopwords and numbers, in order."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9_\-.]*"), F.lit(0)), lambda w: F.btrim(w, F.lit("-._")))
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords) & ~w.rlike("^[0-9]+$"))


def meaningful(token: Column) -> Column:
    """Fit to show: 3 to 20 characters, no digit, dot or slash, no hex string of eight or more, no run of four."""
    return F.length(token).between(3, 20) & ~token.rlike(r"[0-9./]") & ~token.rlike("^[a-f]{8,}$") & ~token.rlike(r"(.)\1{3}")


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 for one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def shingles(seq: Column, n: int) -> Column:
    """Runs of n items joined by `` > ``; a shorter sequence is one run, an empty one none."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(seq) - n, F.lit(0))), lambda i: F.array_join(F.slice(seq, i + 1, n), " > "))
    return F.when(F.size(seq) > 0, runs).otherwise(F.array().cast("array<string>"))


def slug(text: Column, longest: int = 60) -> Column:
    def strip(c: Column) -> Column:
        return F.regexp_replace(c, "^-+|-+$", "")

    s = strip(F.substring(strip(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-")), 1, longest))
    return F.when(s == "", F.lit("workflow")).otherwise(s)


def fingerprint(*parts: Column) -> Column:
    """Ten hex digits of the SHA-256 of the parts, each ended by a NUL."""
    ended = [F.concat(F.coalesce(p, F.lit("")), F.lit("\0")) for p in parts]
    return F.substring(F.sha2(F.concat(*ended).cast("binary"), 256), 1, 10)


def truncate(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.trim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)


def first_line(text: Column) -> Column:
    """The first line that is not blank, with white space collapsed."""
    return F.regexp_replace(F.regexp_extract(text, r"(?m)^[ \t\r]*(\S[^\n]*?)[ \t\r]*$", 1), r"\s+", " ")


def is_continuation(text: Column) -> Column:
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, r"^[\s.!?,]+", ""), r"[\s.!?,]+$", ""))
    few = F.size(F.filter(F.split(plain, r"\s+"), lambda w: w != "")) <= 6
    return few & plain.rlike("^(?:" + "|".join(map(re.escape, CONTINUATIONS)) + ")(?:[ ,].*)?$")


def correction_kind(text: Column) -> Column:
    """preference, fix or null."""
    t = F.trim(text)
    said = F.when(t.rlike("|".join(f"(?:{_marker(p)})" for p in STANDING)), F.lit("preference")).when(t.rlike("|".join(f"(?:{_marker(p)})" for p in FIX)), F.lit("fix"))
    return F.when((t != "") & (F.octet_length(t) <= 600), said)


def round3(x: Column) -> Column:
    """Three places, halves up; for values of 0 and more."""
    return F.floor(x * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(x, F.lit(0.0))))


def round2(x: Column) -> Column:
    """Two places, halves up; for values of 0 and more."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def log_lift(v: Column) -> Column:
    """ln v, but 0.05 where v is no more than 1."""
    return F.when(v <= 1, F.lit(0.05)).otherwise(F.log(v))


def top_counted(items: Column, n: int) -> Column:
    """The n most frequent of an array of texts, ties in alphabetical order."""
    counted = F.transform(F.array_distinct(items), lambda x: F.struct((-F.size(F.filter(items, lambda y: y == x))).alias("less"), x.alias("item")))
    return F.slice(F.transform(F.array_sort(counted), lambda c: c["item"]), 1, n)
