"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

The suffixes of all documents' line sequences are sorted together, but only as far as they tie. At depth
h a suffix has a rank, the number of its first h lines among all sequences of h lines that occur more
than once, in sorted order. The rank at depth 2h is the number of the pair (rank at i, rank at i + h):
a join on position i + h, a count per pair and a numbering over range partitions. Suffixes whose pair
occurs once are resolved and leave; neighbours in the order that tie at depth h and not at 2h have a
longest common prefix in [h, 2h), so the suffixes of one rank at depth h are a longest-common-prefix
interval. In every interval of at least ``least`` lines the first place stays and each later one marks
its lines; marks of one document unite to the maximal repeated runs, which are deleted. Up to ``least``
lines the depth grows by one, and intervals of fewer lines mark theirs if the lines hold enough words or
are the whole of two documents.

Everything is DataFrame expressions. Counts and minima are combined before the shuffle; joins are
between tables in the shared folder, so Spark can split a line or pair that a third of all rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceforge.operators.numbering import number_sorted
from paceforge.session import discard, stage

#: Order of a row without doc_id: after all others.
LAST = (1 << 63) - 1
_DOC = ["o", "t"]


def _place() -> Column:
    return F.struct("o", "t", "i")


def _doc_keys() -> list[Column]:
    """A document is its doc_id and text; repeated rows are one document."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("o"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("t"),
    ]


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^ \t\r\x0b\x0c]+"))


def _written(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c")) != ""


def line_positions(docs: DataFrame) -> DataFrame:
    """Places (o, t, i, p) of lines that occur more than once, with the number of the line as rank.

    i counts the lines with a word, p all lines of the document, from 0; m is how many the document has and
    n1 the words of the line. Lines are told apart by 96 hash bits.
    """
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, p: F.struct(
            p.alias("p"), F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"), _words(line).alias("w")
        ),
    )
    places = (
        docs.filter(F.col("text").isNotNull())
        .select(*_doc_keys(), F.filter(lines, lambda x: x["w"] > 0).alias("lines"))
        .select("o", "t", F.size("lines").alias("m"), F.posexplode("lines").alias("i", "e"))
        .select("o", "t", "i", "m", "e.p", "e.h1", "e.h2", F.col("e.w").alias("n1"))
    )
    places = stage(places.distinct() if _repeats_rows(docs) else places, "runs-lines")
    names = places.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first")).filter("n > 1")
    ranked = stage(number_sorted(names.select("h1", "h2", "first"), ["h1", "h2"], "r", "runs-names"), "runs-ranks")
    out = stage(places.join(ranked, ["h1", "h2"]).select("o", "t", "i", "p", "m", "n1", "r", "first"), "runs-places")
    discard(places)
    discard(ranked)
    return out


def _repeats_rows(docs: DataFrame) -> bool:
    """Whether a doc_id occurs more than once; two columns of a count, combined before the shuffle."""
    return bool(docs.groupBy("doc_id").count().filter("count > 1").limit(1).count())


def _deeper(level: DataFrame, shift: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Ranks at ``shift`` lines more; only suffixes that still tie. ``carried`` (up to ``least`` lines, in
    steps of one) keeps m, n1 and n, the words of all lines of the suffix so far."""
    ahead = level.select("o", "t", (F.col("i") - shift).alias("i"), F.col("r").alias("r2"), *[F.col("n").alias("n2")] * bool(carried))
    total = [(F.col("n1") + F.col("n2")).alias("n")] if carried else []
    joined = level.select("o", "t", "i", "r", *[c for c in carried if c != "n"]).join(ahead, ["o", "t", "i"])
    pairs = stage(joined.select("o", "t", "i", "r", "r2", *[c for c in carried if c != "n"], *total), "runs-pairs")
    names = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first")).filter("n > 1")
    ranked = stage(number_sorted(names.select("r", "r2", "first"), ["r", "r2"], "rank", "runs-names"), "runs-ranks")
    out = stage(
        pairs.join(ranked, ["r", "r2"]).select("o", "t", "i", F.col("rank").alias("r"), "first", *carried), "runs-level"
    )
    discard(pairs)
    discard(ranked)
    return out


def _short_copies(level: DataFrame, depth: int, words: int) -> DataFrame:
    """Later copies of runs of fewer than ``least`` lines: long enough in words, or whole documents."""
    at = F.lit(depth).alias("depth")
    wordy = level.filter((F.col("n") >= words) & (_place() != F.col("first"))).select("o", "t", "i", at)
    whole = level.filter((F.col("i") == 0) & (F.col("m") == depth))
    origin = whole.groupBy("r").agg(F.min(F.struct("o", "t")).alias("origin"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = whole.join(origin, "r").filter(F.struct("o", "t") != F.col("origin")).select("o", "t", "i", at)
    return wordy.union(copies)


def later_copies(places: DataFrame, least: int, words: int) -> DataFrame:
    """Suffixes (o, t, i) whose first ``depth`` lines stand at an earlier place and count as a run."""
    depth, level, found = 1, places.withColumn("n", F.col("n1")), None
    while True:
        if depth >= least:
            later = level.filter(_place() != F.col("first")).select("o", "t", "i", F.lit(depth).alias("depth"))
        else:
            later = _short_copies(level, depth, words)
        found = later if found is None else found.union(later)
        shift = 1 if depth < least else depth
        level = _deeper(level, shift, ("m", "n1", "n") if depth + 1 < least else ())
        depth += shift
        if level.limit(1).count() == 0:
            break
    return found


#: Bits a row of the document filter holds (what bitmap_construct_agg fills), and rows: 4 MB in all.
_ROW_BITS, _FILTER_ROWS = 32_768, 1_024


def _filter_row(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 15), F.lit(_FILTER_ROWS))


def _filter_bit(key: Column) -> Column:
    return F.pmod(key, F.lit(_ROW_BITS)).cast("int")


def _document_filter(plan: DataFrame) -> DataFrame:
    """Bitmaps (row, bits) of the documents in ``plan``; at most 1024 rows of 4 KB whatever its size."""
    key = F.xxhash64("o", "t")
    return plan.groupBy(_filter_row(key).alias("row")).agg(F.bitmap_construct_agg(_filter_bit(key)).alias("bits"))


def _may_hold(bits: str) -> Column:
    """Whether the filter has the document's bit; false for a document without a row."""
    bit = _filter_bit(F.xxhash64("o", "t"))
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.bit_get(byte, bit % 8) == 1, F.lit(False))


def remove_repeated_lines(
    docs: DataFrame, least: int = 3, words: int = 50, counts: tuple[str, str] | None = ("_n_lines", "_n_removed")
) -> DataFrame:
    """The rows of ``docs`` without later copies of repeated runs of lines.

    A run is consecutive lines with a word inside one document, equal to the character; blank lines between
    are skipped over and stay. Runs of at least ``least`` lines count, shorter ones if they hold at least
    ``words`` words, and a document whose lines all stand in another as its whole. The first copy, by doc_id
    and then position, stays; runs that repeat inside a document lose their later copies as well.

    Returns every column of ``docs`` with the text shortened, and, under the names in ``counts``, the lines
    with a word and how many of them went. Null text stays null; texts without lines are unchanged; a
    document that repeats another as a whole keeps an empty text (or its blank lines). Null doc_id counts as
    later than any other. Repeated rows (equal doc_id and text) are one document and all keep the same
    lines. Columns of ``docs`` named like the two new ones are replaced, all others pass through whatever
    their names; an empty table gives no rows.
    """
    own = [c for c in docs.columns if counts is None or c not in counts]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"), "doc_id", "text")
    places = line_positions(docs)
    later = later_copies(places, least, words).groupBy(*_DOC, "i").agg(F.max("depth").alias("depth"))
    by_line = Window.partitionBy(*_DOC).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    by_raw = Window.partitionBy(*_DOC).orderBy("p")
    deleted = (
        places.select("o", "t", "i", "p")
        .join(later, [*_DOC, "i"], "left")
        .withColumn("reach", F.max(F.col("i") + F.col("depth")).over(by_line))
        .filter("reach > i")
        .withColumn("before", F.coalesce(F.lag("p").over(by_raw), F.lit(-1)))
    )
    # Lines kept between deleted ones, as (start, length) for slice(); what follows the last is open.
    gap = F.col("p") - F.col("before") - 1
    cut = stage(
        deleted.groupBy(*_DOC)
        .agg(
            F.sort_array(F.collect_list(F.when(gap > 0, F.struct((F.col("before") + 2).alias("at"), gap.alias("n"))))).alias("gaps"),
            F.max("p").alias("last"),
            F.count(F.lit(1)).alias("n_deleted"),
        )
        .select("o", "t", F.struct("gaps", "last", "n_deleted").alias("cut")),
        "runs-plan",
    )
    discard(places)
    lines = F.split("doc.text", "\n")
    kept = F.concat(
        F.flatten(F.transform("cut.gaps", lambda s: F.slice(lines, s["at"], s["n"]))),
        F.slice(lines, F.col("cut.last") + 2, F.greatest(F.size(lines), F.lit(1))),
    )
    # Only documents the filter lets through meet the plan; it grows with the input, so their texts may be shuffled.
    key = F.xxhash64("o", "t")
    marked = docs.select("doc", *_doc_keys()).withColumn("row", _filter_row(key))
    marked = marked.join(F.broadcast(_document_filter(cut)), "row", "left").withColumn("may", _may_hold("bits"))
    marked = marked.select("doc", "o", "t", "may")
    untouched = marked.filter("NOT may").withColumn("cut", F.lit(None).cast(cut.schema["cut"].dataType))
    joined = marked.filter("may").join(cut, _DOC, "left").unionByName(untouched)
    out = [
        F.when(F.col("cut").isNull(), F.col("doc.text")).otherwise(F.array_join(kept, "\n")).alias("text")
        if c == "text"
        else F.col(f"doc.`{c}`").alias(c)
        for c in own
    ]
    if counts is None:
        return joined.select(*out)
    written = F.when(F.col("doc.text").isNull(), 0).otherwise(F.size(F.filter(lines, _written)))
    return joined.select(
        *out, written.cast("long").alias(counts[0]), F.coalesce("cut.n_deleted", F.lit(0)).cast("long").alias(counts[1])
    )
