"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A line (compared without blanks around it) is dropped where an earlier line, in
the order of document id and place, is equal to it or within ``edits`` edits of
characters, whether that one was dropped or not. Edits are forgiven where they
are a small share of the line: between lines of ``min_chars`` characters or more
(2 * edits * (edits + 1) + 1 at least). Shorter lines are compared for equality,
blank ones stay.

Equal lines are found by their hashes: a line is the first of its hash, or goes.
The lookup of first places is by place, so a line that is everywhere is dealt to
all tasks. For the others, the first lines, a line is cut into
edits + 1 segments of even length: after ``edits`` edits at least one segment
is left whole, within a few characters of its place. So the hashes of a line's
segments, by its length and their number, meet those of the substrings, at the
places still possible, of lines that are up to ``edits`` characters longer.
Lines that share such a key are compared: first each with the earliest line of
the key, then those not dropped by it with the earlier lines that are equal but
for one of more and shorter segments. With one edit allowed, eight segments; where
many lines still meet, the segment in which they differ is cut into eight again,
and at last into characters: lines within one edit are equal without one character
at the same place, or one is equal to the other without some character. A line then
meets only the earliest line of each such key, so that no group of lines gives
all its pairs, and none is passed over. With more edits, lines that aren't dropped
meet the earlier ones that share a key of the rest of the line as well. The comparison is a bit-parallel edit distance over a band of 2 * edits + 1
diagonals, which stops counting beyond ``edits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, scratch, stored

EDITS = 1
#: Shortest line in which an edit is forgiven: one in twenty characters.
MIN_CHARS = 20
#: Lines that are equal but for one segment, from which on it is cut into so many again.
MANY = 8


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits, by a banded bit-parallel edit distance.

    Bit k of a column's vectors is the row ``edits - k`` above the diagonal. The
    distance is followed along the diagonal that ends in the last cell: it grows
    where the diagonal step isn't free, and never shrinks.
    """
    def let(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    long_first = F.char_length(a) >= F.char_length(b)
    both = F.struct(F.split(F.when(long_first, a).otherwise(b), "").alias("rows"), F.split(F.when(long_first, b).otherwise(a), "").alias("columns"))
    return F.coalesce(let(both, lambda t: _within(t["rows"], t["columns"], edits, let)), F.lit(False))


def _within(rows: Column, columns: Column, edits: int, let) -> Column:
    band = (1 << (2 * edits + 1)) - 1
    apart = F.size(rows) - F.size(columns)
    followed = F.get(F.array(*[F.lit(1 << (edits + k)) for k in range(edits + 1)]), apart)

    def step(s: Column, j: Column) -> Column:
        char = F.get(columns, j)
        match = F.lit(0)
        for k in range(2 * edits + 1):
            match = match.bitwiseOR(F.when(F.get(rows, F.when(j + (k - edits) >= 0, j + (k - edits)).otherwise(-1)) == char, 1 << k).otherwise(0))

        def update(x: Column) -> Column:
            free, p, m = x["free"], s["p"], s["m"]
            up = m.bitwiseOR(F.bitwise_not(free.bitwiseOR(p)))
            down = free.bitwiseAND(p)
            moved = F.shiftright(free, 1)
            return F.struct(
                down.bitwiseOR(F.bitwise_not(moved.bitwiseOR(up))).bitwiseAND(band).alias("p"),
                up.bitwiseAND(moved).bitwiseAND(band).alias("m"),
                (s["d"] + F.when(free.bitwiseAND(followed) == 0, 1).otherwise(0)).alias("d"),
            )

        def free_of(y: Column) -> Column:
            p, m = s["p"], s["m"]
            return F.struct((y.bitwiseAND(p) + p).bitwiseXOR(p).bitwiseOR(y).bitwiseOR(m).bitwiseAND(band).alias("free"))

        return F.when(s["d"] > edits, s).otherwise(let(match, lambda y: let(free_of(y), update)))

    start = F.struct(F.lit(band & ~((1 << edits) - 1)).alias("p"), F.lit(0).alias("m"), apart.cast("int").alias("d"))
    end = F.aggregate(F.sequence(F.lit(0), F.size(columns) - 1), start, step)
    return F.when(apart <= edits, end["d"] <= edits).otherwise(False)


def _segments(n: Column, edits: int) -> list[tuple[int, Column, Column, Column]]:
    """(number, length it belongs to, begin, size) of a line's own segments and of its substrings that may be a shorter or equal line's segments."""
    out, parts = [], edits + 1
    for shorter in range(edits + 1):
        length = n - shorter
        longer = length % parts  # the last so many segments have one character more
        least = ((length - longer) / parts).cast("int")
        for i in range(parts):
            size = least + F.when(longer >= parts - i, 1).otherwise(0)
            begin = least * i + F.greatest(longer - (parts - i), F.lit(0)) + 1
            out += [(i, length, begin + shift, size) for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1)]
    return out


def segment_keys(line: Column, n: Column, edits: int) -> Column:
    """Keys of a line's segments and substrings. ``n``: its characters."""
    return F.array(*[F.xxhash64(F.lit(i), length, F.substr(line, begin, size)) for i, length, begin, size in _segments(n, edits)])


def _without_segment(line: Column, n: Column, which: Column, edits: int) -> Column:
    """The line less the segment of its key number ``which``."""
    return F.get(F.array(*[F.concat(F.substr(line, F.lit(1), begin - 1), F.substr(line, begin + size)) for _, _, begin, size in _segments(n, edits)]), which)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), ``line`` as compared (not blank), and its characters ``n``."""
    each = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    line = F.trim("raw")
    return each.select("doc_id", "line_no", line.alias("line"), F.char_length(line).alias("n")).where(F.col("n") > 0)


PLACE = ["doc_id", "line_no"]
HASHES = ["h", "g"]


def _but_for_one(lines: DataFrame) -> DataFrame:
    """Pairs of each line and earlier ones that are candidates to be within one edit. ``lines``: doc_id, line_no and line, each text once.

    ``size`` is the shorter line's length, so that a line takes part with its own
    and one less; what lies before ``lo`` and from ``hi`` on (in the shorter line) is equal.
    """
    place, names = F.struct(*PLACE), [*PLACE, "head_doc", "head_no"]
    n = F.char_length("line")
    rows = lines.select(*PLACE, F.explode(F.array(n, n - 1)).alias("size")).where("size > 0").select(*PLACE, "size", F.lit(0).alias("lo"), F.col("size").alias("hi"))
    found = None
    while True:
        parts = F.transform(F.sequence(F.lit(0), F.lit(MANY - 1)), lambda i: F.struct((F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * i / MANY)).cast("int").alias("lo"), (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * (i + 1) / MANY)).cast("int").alias("hi")))
        cut = rows.select(*PLACE, "size", F.inline(F.filter(parts, lambda x: x["lo"] < x["hi"]))).join(lines, PLACE)
        key = F.xxhash64("size", "lo", "hi", F.substr("line", F.lit(1), F.col("lo")), F.substr("line", n - (F.col("size") - F.col("hi")) + 1))
        keyed = stored(cut.select(*PLACE, "size", "lo", "hi", key.alias("key")))
        groups = stored(keyed.groupBy("key").agg(F.min(place).alias("head"), F.max(place).alias("last"), F.count("*").alias("n")).where("head <> last").select("key", "n"))
        small = keyed.join(groups.where(F.col("n") <= MANY).select("key"), "key", "left_semi").select("key", *PLACE)
        pairs = small.join(small.select("key", F.col("doc_id").alias("head_doc"), F.col("line_no").alias("head_no")), "key").where(F.struct("head_doc", "head_no") < place).select(names)
        crowded = stored(keyed.join(groups.where(F.col("n") > MANY).select("key"), "key", "left_semi").select(*PLACE, "size", "lo", "hi").distinct())
        fine = crowded.where(F.col("hi") - F.col("lo") <= 2)
        made = stored(pairs.union(_met_by_characters(fine, lines)).distinct())
        found = made if found is None else found.union(made)
        rows = crowded.where(F.col("hi") - F.col("lo") > 2)
        if not rows.limit(1).count():
            return found.distinct()


def _met_by_characters(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Each line and the earliest earlier ones within one edit of it between ``lo`` and ``hi``, by its text without one character."""
    place, n = F.struct(*PLACE), F.char_length("line")
    longer = n > F.col("size")
    places = F.sequence(F.col("lo") + 1, F.col("hi") + F.when(longer, 1).otherwise(0))
    less = lambda p: F.xxhash64(F.lit(3), F.concat(F.substr("line", F.lit(1), p - 1), F.substr("line", p + 1)))
    kind = lambda name, key: F.struct(F.lit(name).alias("kind"), key.alias("key"))
    own = F.concat(F.array(kind("whole", F.xxhash64(F.lit(3), "line"))), F.transform(places, lambda p: kind("other", F.xxhash64(p, less(p)))))
    keys = rows.join(lines, PLACE).select(*PLACE, F.inline(F.when(longer, F.transform(places, lambda p: kind("less", less(p)))).otherwise(own))).distinct()
    heads = keys.groupBy("kind", "key").agg(F.min(place).alias("head"))
    # A whole line meets lines that have one character more, and the other way round; lines of one length meet with the same character left out.
    meets = F.when(F.col("kind") == "whole", "less").when(F.col("kind") == "less", "whole").otherwise("other")
    return keys.join(heads.withColumn("kind", meets), ["kind", "key"]).where(F.col("head") < place).select(*PLACE, F.col("head.doc_id").alias("head_doc"), F.col("head.line_no").alias("head_no"))


def repeated_lines(df: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id`` and ``line_no`` of every line to drop."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = _lines(docs)
    lines = every.where(F.col("n") >= max(min_chars, 2 * edits * (edits + 1) + 1))
    place = F.struct(*PLACE)

    hashed = stored(every.select(*PLACE, F.xxhash64("line").alias("h"), F.xxhash64(F.lit(5), "line").alias("g")))
    groups = stored(hashed.groupBy(*HASHES).agg(F.min(place).alias("first"), F.count("*").alias("times")))
    may_repeat = bit_filter(groups.where("times > 1").select(*HASHES))(*map(F.col, HASHES))
    # Lines that the filter lets through though they are alone are first, too.
    firsts = groups.where(may_repeat).select(*HASHES, "first.*")
    equal = stored(hashed.where(may_repeat).join(firsts, [*HASHES, *PLACE], "left_anti").select(*PLACE).distinct())

    keyed = lines.select(*PLACE, segment_keys(F.col("line"), F.col("n"), edits).alias("keys"))
    may_go = bit_filter(equal)(*map(F.col, PLACE))
    kept = keyed.where(~may_go).union(keyed.where(may_go).join(equal, PLACE, "left_anti"))
    postings = stored(kept.select(*PLACE, F.posexplode("keys").alias("which", "key")))
    heads = stored(postings.groupBy("key").agg(F.min(place).alias("head"), F.max(place).alias("last")).where("head <> last").select("key", "head"))
    shared = bit_filter(heads.select("key"))
    met = postings.where(shared(F.col("key"))).join(heads, "key")
    met = stored(met.select("key", "which", *PLACE, F.col("head.doc_id").alias("head_doc"), F.col("head.line_no").alias("head_no")))
    tried = stored(met.where(F.struct("head_doc", "head_no") < place).select(*PLACE, "head_doc", "head_no").distinct())
    near = stored(_near(lines, tried, edits))

    # Lines not dropped yet, and the others of their keys. Without the segment that made them meet, near lines
    # are still near, and so share a key of what is left of them, too.
    late = met.where(F.struct("head_doc", "head_no") < place).join(near.select(*PLACE).distinct(), PLACE, "left_anti").select("key", *PLACE)
    late = stored(late.distinct())
    open_rows = stored(met.join(late.select("key").distinct(), "key", "left_semi").select("key", "which", *PLACE))
    texts = stored(_texts(lines, open_rows))
    if edits == 1:
        pairs = _but_for_one(texts)
    else:
        rest = open_rows.join(texts, PLACE).withColumn("left", _without_segment(F.col("line"), F.char_length("line"), F.col("which"), edits))
        finer = stored(rest.select("key", *PLACE, F.explode(F.array_distinct(segment_keys(F.col("left"), F.char_length("left"), edits))).alias("second")))
        other = finer.select("key", "second", F.col("doc_id").alias("head_doc"), F.col("line_no").alias("head_no"))
        pairs = finer.join(late, ["key", *PLACE], "left_semi").join(other, ["key", "second"]).where(F.struct("head_doc", "head_no") < place).select(tried.columns).distinct()
    new = stored(pairs.join(late.select(*PLACE).distinct(), PLACE, "left_semi").join(tried, tried.columns, "left_anti"))
    return equal.union(near.select(*PLACE)).union(_near(lines, new, edits).select(*PLACE)).distinct()


def _texts(lines: DataFrame, places: DataFrame) -> DataFrame:
    """The lines at these places. The filter keeps the others out of the shuffle."""
    wanted = places.select("doc_id", "line_no").distinct()
    has = bit_filter(wanted)
    return lines.select("doc_id", "line_no", "line").where(has(F.col("doc_id"), F.col("line_no"))).join(wanted, ["doc_id", "line_no"], "left_semi").distinct()


def _near(lines: DataFrame, pairs: DataFrame, edits: int) -> DataFrame:
    """The pairs whose lines are near, by the text of just these lines."""
    texts = stored(_texts(lines, pairs.select("doc_id", "line_no").union(pairs.select("head_doc", "head_no"))))
    heads = texts.select(F.col("doc_id").alias("head_doc"), F.col("line_no").alias("head_no"), F.col("line").alias("head"))
    return pairs.join(texts, ["doc_id", "line_no"]).join(heads, ["head_doc", "head_no"]).where(within(F.col("line"), F.col("head"), edits)).select(*pairs.columns)


def dedup(df: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of ``df``, its ``text`` without the dropped lines, and ``n_lines``, ``n_dropped`` (replacing such columns).

    A null text stays null and has 0 lines, an empty one has one line. Rows with
    a null id stay as they are and drop nothing elsewhere. Rows with one id count
    as one document: equal rows are changed alike, none for another.
    """
    own = "__dropped"
    while own in df.columns:
        own += "_"
    with scratch(df.sparkSession) as keep:
        dropped = keep(repeated_lines(df, edits, min_chars).groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias(own)))
    has = bit_filter(dropped.select("doc_id"))
    rows = df.drop("n_lines", "n_dropped")
    changed = F.coalesce(has(F.col("doc_id").cast("long")), F.lit(False))
    # Only documents that may lose a line are shuffled to their places; as a merge at any size, since both sides grow alike.
    rows = rows.where(changed).join(dropped.hint("merge"), "doc_id", "left").unionByName(rows.where(~changed).withColumn(own, F.lit(None).cast("array<int>")))
    lines, gone = F.split("text", "\n"), F.coalesce(own, F.array().cast("array<int>"))
    begins = F.concat(F.array(F.lit(0)), F.transform(gone, lambda i: i + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(lines, b + 1, e - b)))
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)
    columns = [text.alias("text") if c == "text" else F.col(c) for c in df.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*columns, n.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"))
