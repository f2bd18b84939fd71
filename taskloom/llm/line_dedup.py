"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-cased words. Words are ordered by rarity over all
lines; two sets with a Jaccard similarity of ``threshold`` must share a word in
their prefixes, the rarest words whose number the size fixes. The join on prefix
words applies the length, positional and bitmap bounds; what is left is verified
on the words themselves. A line goes when a line before it, in (key, row, line)
order, is as similar as that, whether or not that one stays.

``similar_lines`` gives the whole join: every verified link between classes of
lines with equal sets, and the members of the classes. ``line_links`` counts the
links: in a large group of near copies most pairs are similar for sure by how far
both are from one line of the group, and such links are counted by size and
distance, not one by one. ``removed_lines`` asks for
less: one similar line before it settles a line. There, lines first try their
neighbours in the postings of a few prefix words; those that no neighbour settles
are joined with every line before them. Words are told by hashes: 48 bits in the
order and in the prefixes, 64 bits in the verification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, dense_runs, dropped, key_filter, stored, with_row_id

#: Rarity is counted in so many buckets of words: the table sent to tasks has a fixed size.
BUCKETS = 1 << 18
_LOW = (1 << 31) - 1
#: Parts that the lines of one key are dealt into where a line tries its neighbours, and neighbours tried.
PARTS, NEIGHBOURS = 4, 3
#: Postings of late lines that may be sent to all tasks, about 100 bytes each; more are shuffled.
SENT = 200_000
#: Lines with the same key from which on they may be a family.
FAMILY = 16


def _plain(text: Column) -> Column:
    """Lower-cased, with single spaces for white space other than line breaks."""
    spaced = text
    for c in "\t\v\f\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    # Few texts hold any of these, and one search is cheaper than four replacements.
    return F.lower(F.when(text.rlike(r"[\t\x0B\f\r]"), spaced).otherwise(text))


def _lines(base: DataFrame) -> DataFrame:
    return base.select("_rid", "k", F.posexplode(F.split("text", "\n")).alias("line", "s"))


def _bucket(hashed: Column) -> Column:
    """The bucket of a word by the high bits of its hash; the low 31 tell words of one level apart."""
    return F.shiftright(hashed, 40).bitwiseAND(BUCKETS - 1).cast("int")


def _frequencies(base: DataFrame) -> Column:
    """How many words of all lines fall into each bucket, in eighths of powers of two, as an array literal by bucket."""
    # Lower-casing is fast on ASCII alone: by lines, more of the text is.
    words = _lines(base).select(F.explode(F.split(_plain(F.col("s")), " ")).alias("w"))
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("bucket")).agg(F.count("*").alias("n"))
    level = F.floor(F.log2("n") * 8) + 1
    runs = dense_runs(counts.select(F.col("bucket").alias("at"), level.alias("value")), BUCKETS)
    joined = {r.run: r.levels for r in runs.select("run", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",").alias("levels")).collect()}  # BUCKETS levels
    return F.split(F.lit(",".join(joined[k] for k in sorted(joined))), ",").cast("array<long>")


def word_set(line: Column, frequencies: Column) -> Column:
    """Distinct words as numbers that sort by rarity: the level of the bucket above 31 bits of the hash."""

    def number(h: Column) -> Column:
        # Without nulls, arrays of longs are sorted and compared unboxed.
        return F.shiftleft(F.coalesce(F.get(frequencies, _bucket(h)), F.lit(0).cast("long")), 31).bitwiseOR(h.bitwiseAND(_LOW))

    hashes = F.array_distinct(F.transform(F.split(_plain(line), " "), lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(F.array_remove(hashes, F.xxhash64(F.lit(""))), number))


#: Sets of more words than this have two bitmaps.
WIDE = 96


def _bitmap(words: Column, n: Column) -> tuple[Column, Column]:
    """64 bits of the 31-bit words of a set, each word turning one of them, and the same of every other word where there are many.

    The exclusive or of both is the first bitmap of the remaining words, so a
    large set has 128 bits in all.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    all_ = F.aggregate(words, zero, lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", one, x)))
    half = F.aggregate(words, zero, lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.shiftright(x, 6).bitwiseAND(1).cast("long"), x)))
    return all_, F.when(n > WIDE, half).otherwise(zero)


def _hashes(line: Column) -> Column:
    """The words of a line, as hashes; the empty word of two white spaces together is one, too, in every line."""
    return F.array_distinct(F.transform(F.split(F.concat(_plain(line), F.lit("  ")), " "), lambda w: F.xxhash64(w)))


def _needed(n: Column, m: Column, threshold: float) -> Column:
    """Common words that sets of n and m words need for the threshold."""
    return F.ceil((n + m) * F.lit(threshold / (1 + threshold)) - 1e-9)


def _fits(a: str, b: str, threshold: float) -> Column:
    """Whether postings a and b of one word, a's line before b's, can belong to lines as similar as that.

    Each word outside the common ones turns one bit of one bitmap, so bitmaps differ in no more bits than there are such words.
    """
    n1, n2, i1, i2 = _size(a), _size(b), _at(a), _at(b)
    need = _needed(n1, n2, threshold)
    near = (_apart(a, b) <= (n1 + n2) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9) & (F.least(n1 - i1, n2 - i2) >= need)
    near = near & (n1 >= n2 * F.lit(threshold) - 1e-9) & (n2 >= n1 * F.lit(threshold) - 1e-9)
    before = F.lit(False)
    for c in ("line", "_rid", "k"):
        before = (F.col(f"{a}.{c}") < F.col(f"{b}.{c}")) | ((F.col(f"{a}.{c}") == F.col(f"{b}.{c}")) & before)
    return near & before


def _apart(a: str, b: str) -> Column:
    """In how many bits the bitmaps differ, of 128 where both sets are large."""
    both = F.col(f"{a}.bits1").bitwiseXOR(F.col(f"{b}.bits1"))
    half = F.col(f"{a}.bits2").bitwiseXOR(F.col(f"{b}.bits2"))
    wide = (_size(a) > WIDE) & (_size(b) > WIDE)
    return F.when(wide, F.bit_count(both.bitwiseXOR(half)) + F.bit_count(half)).otherwise(F.bit_count(both))


def _place(side: str) -> Column:
    return F.struct(*(F.col(f"{side}.{c}").alias(c) for c in ("k", "_rid", "line")))


_POSTING = ["k", "_rid", "line", "n_at", "bits1", "bits2"]


def _packed(at: Column) -> Column:
    """Size and place in one long: postings are most of what is shuffled."""
    return F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(at.cast("long")).alias("n_at")


def _size(side: str) -> Column:
    return F.shiftright(F.col(f"{side}.n_at"), 32)


def _at(side: str) -> Column:
    return F.col(f"{side}.n_at").bitwiseAND((1 << 32) - 1)


def _tried(classes: DataFrame, threshold: float) -> DataFrame:
    """(one, two): of each line, the likest fitting one of the lines just before it among those with the same key.

    A line has two keys, the least and the greatest hash among the rarer half of
    its words: near copies mostly share one of them.
    """
    b = F.struct("k", "_rid", "line", _packed(F.lit(0)), "bits1", "bits2")
    keyed = classes.select(F.posexplode(F.array("least", "most")).alias("which", "word"), F.pmod(F.xxhash64("_rid", "line"), F.lit(PARTS)).alias("part"), "k", "_rid", "line", b.alias("b"))
    keyed = keyed.select(F.xxhash64("which", "word", "part").alias("key"), "k", "_rid", "line", "b")
    order = Window.partitionBy("key").orderBy("k", "_rid", "line")
    seen = keyed.select("b", *(F.lag("b", d).over(order).alias(f"a{d}") for d in range(1, NEIGHBOURS + 1)))
    found = [F.when(_fits(f"a{d}", "b", threshold), F.struct(_apart(f"a{d}", "b").alias("apart"), _place(f"a{d}").alias("one"))) for d in range(1, NEIGHBOURS + 1)]
    best = seen.select(_place("b").alias("two"), F.least(*found).alias("near")).where("near is not null")
    return best.groupBy("two").agg(F.min("near").alias("near")).select("near.one", "two")


def _families(base: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(k, _rid, line, lines, family, m, d, n): the lines that resemble the line which their family is named after.

    A line has two keys, the least and greatest hashes of its rarer and of its
    commoner words. It joins the first line of its keys' lines, or the one that
    this joins. The named line has m words; a member has n words and lacks d of
    the m. A line is in one family or none, and any choice of families is right:
    they only say which links need not be verified one by one.
    """
    line = F.struct("k", "_rid", "line", _packed(F.lit(0)), "bits1", "bits2")
    keyed = classes.select(line.alias("two"), F.explode(F.array(F.xxhash64("least", "most"), F.xxhash64(F.lit(1), "low", "high"))).alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("two").alias("one"), F.count("*").alias("of")).where(F.col("of") >= FAMILY).drop("of")
    named = stored(keyed.join(firsts, "key").groupBy("two").agg(F.min("one").alias("one")))
    further = named.select(F.col("two").alias("one"), F.col("one").alias("next"))
    pairs = named.join(further, "one").select(F.col("next").alias("one"), "two").where(_fits("one", "two", threshold) | (_place("one") == _place("two")))
    pairs = stored(pairs.select(_place("one").alias("one"), _place("two").alias("two")))
    texts = _texts(pairs, base)
    near = _measured(pairs, texts).where(F.col("common") >= _needed(F.col("n1"), F.col("n2"), threshold))
    near = near.select(F.col("two.k").alias("k"), F.col("two._rid").alias("_rid"), F.col("two.line").alias("line"), F.xxhash64("one").alias("family"), F.col("n1").alias("m"), (F.col("n1") - F.col("common")).alias("d"), F.col("n2").alias("n"))
    found = stored(near.join(classes.select("_rid", "line", "lines"), ["_rid", "line"]))
    for t in (named, pairs, texts):
        dropped(t)
    return found


def _sure(a: str, b: str, threshold: float) -> Column:
    """Whether two of a family are similar whatever their words: they share those of the m that neither lacks."""
    m, d1, d2, n1, n2 = (F.col(c) for c in (f"{a}.m", f"{a}.d", f"{b}.d", f"{a}.n", f"{b}.n"))
    return (F.col(f"{a}.family") == F.col(f"{b}.family")) & (m - d1 - d2 >= _needed(n1, n2, threshold))


def _candidates(classes: DataFrame, families: DataFrame, threshold: float) -> DataFrame:
    """(one, two): all pairs of lines that share a prefix word and fit, but for those that their family makes sure."""
    index = classes.select("k", "_rid", "line", F.col("n").alias("size"), "bits1", "bits2", "prefix").join(families.select("_rid", "line", "family", "m", "d", "n"), ["_rid", "line"], "left")
    index = index.select("k", "_rid", "line", "size", "bits1", "bits2", "family", "m", "d", "n", F.posexplode("prefix").alias("at", "word"))
    index = index.select("word", "k", "_rid", "line", F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("n_at"), "bits1", "bits2", "family", "m", "d", "n")
    hit = (F.col("a.word") == F.col("b.word")) & _fits("a", "b", threshold) & ~F.coalesce(_sure("a", "b", threshold), F.lit(False))
    return index.alias("a").join(index.alias("b"), hit).select(_place("a").alias("one"), _place("b").alias("two")).distinct()


def _joined(classes: DataFrame, late: DataFrame, threshold: float) -> DataFrame:
    """(one, two, apart): all fitting pairs of an open line with a line before it."""
    flagged = classes.join(late.select("two._rid", "two.line", F.lit(True).alias("late")), ["_rid", "line"], "left")
    index = flagged.select("late", "k", "_rid", "line", "n", "bits1", "bits2", F.posexplode("prefix").alias("at", "word"))
    index = index.select("late", "word", "k", "_rid", "line", _packed(F.col("at")), "bits1", "bits2")
    open_, gone = index.where("late is null").select("word", *_POSTING), stored(index.where("late").select("word", *_POSTING))

    def pairs(a: DataFrame) -> DataFrame:
        hit = (F.col("a.word") == F.col("b.word")) & _fits("a", "b", threshold)
        return a.alias("a").join(open_.alias("b"), hit).select(_place("a").alias("one"), _place("b").alias("two"), _apart("a", "b").alias("apart"))

    return pairs(open_).union(pairs(F.broadcast(gone) if gone.count() <= SENT else gone)).distinct()


def _texts(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """(_rid, line, s): the lines that the pairs ask for, read again; no other line is shuffled but for a few."""
    sides = (pairs.select(F.col(f"{side}._rid").alias("_rid"), F.col(f"{side}.line").alias("line")).distinct() for side in ("one", "two"))
    asked = stored(next(sides).union(next(sides)).distinct())
    # Texts without such a line aren't even split.
    some = base.where(key_filter(asked.select("_rid").distinct(), "_rid"))
    found = stored(_lines(some).where(key_filter(asked, "_rid", "line")).select("_rid", "line", "s"))
    dropped(asked)
    return found


def _measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (one, two) with the words of both (n1, n2) and those in common."""
    flat = pairs.select(F.col("one._rid").alias("r1"), F.col("one.line").alias("l1"), F.col("two._rid").alias("r2"), F.col("two.line").alias("l2"), "one", "two")
    t1, t2 = (texts.select(F.col("_rid").alias(f"r{i}"), F.col("line").alias(f"l{i}"), F.col("s").alias(f"s{i}")) for i in (1, 2))
    both = flat.join(t2, ["r2", "l2"]).join(t1, ["r1", "l1"]).select("one", "two", _hashes(F.col("s1")).alias("w1"), _hashes(F.col("s2")).alias("w2"))
    return both.select("one", "two", *((F.size(w) - 1).alias(c) for c, w in (("common", F.array_intersect("w1", "w2")), ("n1", F.col("w1")), ("n2", F.col("w2")))))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (one, two) whose word sets are as similar as that."""
    return _measured(pairs, texts).where(F.col("common") >= _needed(F.col("n1"), F.col("n2"), threshold)).select("one", "two")


def _alike(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The ``two`` of the pairs that are as similar as that."""
    return stored(_verified(pairs, texts, threshold).select("two").distinct())


def _base(docs: DataFrame, text: str, key: str) -> DataFrame:
    return with_row_id(docs.select(F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("k"), F.col(text).alias("text"))).where("text is not null")


def _classes(base: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(lines with words, classes of equal sets); a class stands at its first line and counts its lines."""
    sets = _lines(base).select("_rid", "k", "line", word_set(F.col("s"), _frequencies(base)).alias("t"))
    sets = sets.select("_rid", "k", "line", F.xxhash64("t").alias("c1"), F.hash("t").alias("c2"), F.size("t").alias("n"), F.transform("t", lambda x: x.bitwiseAND(_LOW).cast("int")).alias("w"))
    n, (bits1, bits2) = F.col("n"), _bitmap(F.col("w"), F.col("n"))
    prefix = F.slice("w", F.lit(1), n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1)
    half = F.ceil(n / 2).cast("int")
    rarer, other = F.slice("w", F.lit(1), half), F.slice("w", half + 1, n)
    # Lines without words go after the table is written: a filter before it would make every word set twice.
    sets = stored(sets.select("_rid", "k", "line", "c1", "c2", "n", prefix.alias("prefix"), F.array_min(rarer).alias("least"), F.array_max(rarer).alias("most"), F.array_min(other).alias("low"), F.array_max(other).alias("high"), bits1.alias("bits1"), bits2.alias("bits2")))
    some = sets.where("n > 0")
    place, kept = F.struct("k", "_rid", "line"), ["n", "prefix", "least", "most", "low", "high", "bits1", "bits2"]
    classes = some.groupBy("c1", "c2").agg(F.min(F.struct(place.alias("place"), *kept)).alias("first"), F.count("*").alias("lines"))
    return some, stored(classes.select("first.place.*", *(f"first.{c}" for c in kept), "c1", "c2", "lines"))


def similar_lines(docs: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, links): the whole join.

    members has a row for each line with words: its place (k, _rid, line), the
    place ``first`` of the first line with the same words, which stands for the
    class, and ``lines``, the size of the class. links has every pair (one, two)
    of classes, told by their first lines, whose sets are as similar as that,
    ``one`` being before ``two``. Order, nulls, ties, empty tables and other
    columns as in ``removed_lines``.
    """
    members, links, families = _similar(docs, threshold, text, key)
    both = families.alias("a").join(families.alias("b"), _sure("a", "b", threshold) & (_place("a") < _place("b")))
    return members, links.union(both.select(_place("a").alias("one"), _place("b").alias("two")))


def _similar(docs: DataFrame, threshold: float, text: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, families): as ``similar_lines``, links without those that families make sure."""
    base = _base(docs, text, key)
    some, classes = _classes(base, threshold)
    families = _families(base, classes, threshold)
    pairs = stored(_candidates(classes, families, threshold))
    texts = _texts(pairs, base)
    links = stored(_verified(pairs, texts, threshold))
    for t in (pairs, texts):
        dropped(t)
    firsts = classes.select("c1", "c2", F.struct("k", "_rid", "line").alias("first"), "lines")
    return some.select("k", "_rid", "line", "c1", "c2").join(firsts, ["c1", "c2"]).drop("c1", "c2"), links, families


def _sure_links(families: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((first, far, late) of lines, (a, b) of texts): what the sure links say, by size and distance within a family.

    Lines of one size and distance are a cell. Two cells are sure or not as
    wholes, so the lines in a line's sure cells are its links, itself left out
    where its own cell is among them. Each line hangs together with the first
    line of one of its sure cells, and these with each other.
    """
    of = ["family", "m", "d", "n"]
    place = F.struct("k", "_rid", "line")
    cells = stored(families.groupBy(*of).agg(F.sum("lines").alias("lines"), F.min(place).alias("place")))
    both = cells.alias("a").join(cells.alias("b"), _sure("a", "b", threshold))
    own = (F.col("a.d") == F.col("b.d")) & (F.col("a.n") == F.col("b.n"))
    both = stored(both.select(*(F.col(f"a.{c}").alias(c) for c in of), F.col("a.place").alias("here"), F.col("b.place").alias("there"), F.col("b.lines").alias("lines"), own.alias("own")))
    around = both.groupBy(*of).agg(F.sum("lines").alias("all"), F.max("own").alias("own"), F.min("there").alias("there"))
    lines = stored(families.join(around, of).select(place.alias("first"), (F.col("all") - F.when(F.col("own"), F.col("lines")).otherwise(0)).alias("far"), (F.col("there") < place).alias("late"), F.col("_rid").alias("a"), F.col("there._rid").alias("b")))
    return lines.select("first", "far", "late"), lines.select("a", "b").union(both.select(F.col("here._rid").alias("a"), F.col("there._rid").alias("b")))


def line_links(docs: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_rid, removed, n_links, component): one row for each row of docs whose text has a line with words.

    removed holds the line numbers that ``removed_lines`` gives, sorted. n_links
    counts, over the lines of the text, the other lines that are similar, those
    of the same text and equal ones included. Texts with similar lines hang
    together; component is the least _rid of those that do.
    """
    members, links, families = _similar(docs, threshold, text, key)
    members = stored(members)
    sure, held = _sure_links(families, threshold)
    sides = links.select(F.col("one").alias("first"), F.col("two").alias("other")).union(links.select(F.col("two").alias("first"), F.col("one").alias("other")))
    sizes = members.where(F.struct("k", "_rid", "line") == F.col("first")).select(F.col("first").alias("other"), F.col("lines").alias("far"))
    each = sides.join(sizes, "other").select("first", "far", (F.col("other") < F.col("first")).alias("late")).union(sure)
    of_class = each.groupBy("first").agg(F.sum("far").alias("far"), F.max("late").alias("late"))
    lines = members.join(of_class, "first", "left")
    gone = F.col("late") | (F.struct("k", "_rid", "line") != F.col("first"))
    by_text = lines.groupBy("_rid").agg(F.array_sort(F.collect_list(F.when(gone, F.col("line")))).alias("removed"), F.sum(F.coalesce("far", F.lit(0)) + F.col("lines") - 1).alias("n_links"))
    edges = links.select(F.col("one._rid").alias("a"), F.col("two._rid").alias("b")).union(members.select(F.col("first._rid").alias("a"), F.col("_rid").alias("b")))
    parts = connected_components(edges.union(held)).withColumnRenamed("id", "_rid")
    return by_text.join(parts, "_rid", "left").select("_rid", "removed", "n_links", F.coalesce("component", "_rid").alias("component"))


def removed_lines(docs: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_rid, line): the lines to remove, numbered from 0.

    docs must be read from files. Lines without words stay. Order is by key
    (null last), then row, then line, so repeated rows and ties have one. Null
    and empty texts have no line to remove; an empty table gives no rows. Other
    columns of docs, whatever their names, play no part.
    """
    base = _base(docs, text, key)
    some, classes = _classes(base, threshold)
    place = F.struct("k", "_rid", "line")
    tried = stored(_tried(classes, threshold))
    soon = _alike(tried, _texts(tried, base), threshold)
    others = stored(_joined(classes, soon, threshold))
    # The likest of a line's partners first; the rest only for lines that it doesn't settle.
    texts = _texts(others, base)
    best = others.groupBy("two").agg(F.min(F.struct("apart", "one")).alias("near")).select("near.one", "two")
    found = _alike(best, texts, threshold)
    rest = _alike(others.join(found, "two", "left_anti"), texts, threshold)
    late = soon.union(found).union(rest).select("two._rid", "two.line", F.lit(True).alias("late"))
    judged = classes.select("c1", "c2", "k", "_rid", "line", "lines").join(late, ["_rid", "line"], "left").where("late or lines > 1")
    judged = stored(judged.select("c1", "c2", F.struct("k", "_rid", "line").alias("first"), F.coalesce("late", F.lit(False)).alias("late")))
    for t in (classes, tried, others, texts):
        dropped(t)
    return some.select("c1", "c2", "k", "_rid", "line").join(judged, ["c1", "c2"]).where(F.col("late") | (place != F.col("first"))).select("_rid", "line")


def line_dedup(docs: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs with the removed lines gone from ``text``, and the removed line numbers.

    Returns the columns of docs and ``removed_lines`` (array<int>, sorted; empty
    where nothing goes), which takes the place of a column of that name. A text
    that loses all lines is empty; null stays null. Only the removed lines and
    their breaks go. Other columns, whatever their names, come back as they are.
    """
    gone = removed_lines(docs, threshold, text, key).groupBy("_rid").agg(F.array_sort(F.collect_list("line")).alias("gone"))
    rows = with_row_id(docs.select(F.struct("*").alias("row")))
    kept = F.array_join(F.filter(F.split(F.col("row")[text], "\n"), lambda s, i: ~F.array_contains("gone", i)), "\n")
    out = {c: F.col("row")[c] for c in docs.columns if c != "removed_lines"}
    out[text] = F.when(F.col("gone").isNull(), F.col("row")[text]).otherwise(kept)
    out["removed_lines"] = F.coalesce("gone", F.array().cast("array<int>"))
    return rows.join(gone, "_rid", "left").select(*(v.alias(c) for c, v in out.items()))
