"""SpotSigs document fingerprints, in DataFrame operations only, and classes of similar documents.

A spot is a common word (a listed one, or any of at most three letters); its signature is the spot with the next content words
after it. A fingerprint holds the number of a document's distinct signatures, the smallest of their hashes in order, and a hash of the whole set
if there are more. Whole sets are compared by Jaccard similarity, which their lengths bound from above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .set_join import similar_components
from .shared import discard, stash, table
from .words import words

#: Common words of more than three letters in English, French, German and Spanish; shorter words are common ones anyway.
SPOTS = (
    "that with this from they have been were which their what when would there about into than them only some could will your such more also "
    "dans pour avec plus elle mais nous vous cette sont comme leur ainsi aussi sans "
    "nicht eine einen einem einer auch sich sind wird nach oder wenn dass werden aber über beim "
    "para como pero este esta esto entre desde sobre hasta donde porque cuando también"
).split()
CHAIN, REACH, KEEP = 2, 8, 128
#: Quantiles of the ids from which ranges are made; there are as many ranges as the session's shuffle partitions ask for.
CUTS = 1024


def _sets(docs: DataFrame, text: str, to: str, chain: int = CHAIN, reach: int = REACH) -> DataFrame:
    """Adds the sorted set of the distinct signatures (hashes of 48 bits). A text without one has those of its words, a text without words that of itself."""
    w = words(F.col(text))
    marked = F.transform(w, lambda t: F.shiftleft(F.xxhash64(t), 1).bitwiseOR(F.when((F.length(t) <= 3) | t.isin(SPOTS), 0).otherwise(1)))
    docs = docs.withColumn("_w", marked)  # even: a spot; odd: a content word
    spots = F.filter(F.transform(F.col("_w"), lambda x, i: F.when(x.bitwiseAND(F.lit(1)) == 0, i)), lambda i: i.isNotNull())

    def at(i: Column) -> Column:
        after = F.slice(F.filter(F.slice(F.col("_w"), i + 2, F.lit(reach)), lambda x: x.bitwiseAND(F.lit(1)) == 1), 1, chain)
        return F.when(F.size(after) > 0, F.shiftrightunsigned(F.xxhash64(F.get(F.col("_w"), i), after), 16))

    sigs = F.array_distinct(F.filter(F.transform(spots, at), lambda x: x.isNotNull()))
    docs = docs.withColumn("_s", sigs)
    alone = F.when(F.size("_w") > 0, F.array_distinct(F.transform(F.col("_w"), lambda x: F.shiftrightunsigned(F.xxhash64(x), 16)))).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 16)))
    return docs.withColumn("_s", F.when(F.size("_s") > 0, F.col("_s")).otherwise(alone)).withColumn(to, F.array_sort("_s")).drop("_w", "_s")


def fingerprint(sigs: Column) -> Column:
    """The number of signatures, the least hashes, and for more than those a hash of them all, in hex."""
    low = F.concat_ws("", F.transform(F.slice(sigs, 1, KEEP), lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")))
    return F.concat_ws(":", F.lower(F.hex(F.size(sigs))), low, F.when(F.size(sigs) > KEEP, F.lpad(F.lower(F.hex(F.xxhash64(sigs))), 16, "0")))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """The Jaccard similarity of two sets; 0 without a comparison where their lengths, or their least and greatest elements, leave less than ``least`` or nothing."""
    both = F.size(F.array_intersect(a, b))
    apart = (F.element_at(a, -1) < F.element_at(b, 1)) | (F.element_at(b, -1) < F.element_at(a, 1))
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    return F.when(a == b, F.lit(1.0)).when(apart | (bound < least), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with a column ``sigs``. A null text counts as empty; equal texts have equal signatures."""
    return _sets(docs, text_col, "sigs")


def similar_classes(docs: DataFrame, least: float = 0.8, cell_cap: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) per row: documents joined by a chain of Jaccard similarities of their signature sets of at least ``least``.

    Sets are parted by length, so that only those of one part or of two that follow each other can be so alike, and matched within a part by an inverted index
    of their rarer signatures; length, shared rare signatures and then the whole sets decide (``set_join``). Null and empty texts are alike.
    class_id is the smallest id of the class; rows without an id take part, and have null if the whole class is without.
    """
    rows = fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    key = F.struct(F.size("sigs"), F.xxhash64("sigs"), F.xxhash64(F.lit(1), "sigs"))
    rows = stash(rows.withColumn("key", key), "signatures")
    heads = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("sigs").alias("s")).withColumn("node", F.monotonically_increasing_id())
    heads = stash(heads, "heads")
    found = similar_components(heads.select("node", "s"), lambda t: t.select("node", "s"), least, cell_cap, native=True)
    by_set = stash(heads.join(found, "node", "left").select("key", "first", F.coalesce("component", "node").alias("component")), "by-set")
    classes = by_set.groupBy("component").agg(F.min("first").alias("class_id"))
    return rows.join(by_set.join(classes, "component").select("key", "class_id"), "key").select("doc_id", "class_id")


def _find(values: list[int], x: Column) -> Column:
    """How many of some ascending numbers are at most x, in two steps of some 30 comparisons."""
    step = 32
    parts = [values[i : i + step] for i in range(0, len(values), step)]
    longs = lambda v: F.array(*map(F.lit, v)).cast("array<bigint>")
    if not parts:
        return F.lit(0)
    part = F.size(F.filter(longs([p[0] for p in parts]), lambda c: c <= x))
    return F.when(part == 0, 0).otherwise((part - 1) * step + F.size(F.filter(F.get(F.array(*map(longs, parts)), part - 1), lambda c: c <= x)))


def _with_range(docs: DataFrame) -> DataFrame:
    """Adds range (int), ascending with (key, h): equal parts of the spans between quantiles of the keys. A key that fills several quantiles is parted by h, a
    hash of the text, which is 0 if there is no such key."""
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = min(CUTS, n)
    row = docs.agg(F.percentile_approx("key", [k / count for k in range(1, count)], 100 * count), F.min("key"), F.max("key")).first()
    if row[0] is None:
        return docs.withColumn("h", F.lit(0).cast("long")).withColumn("range", F.lit(0))
    cuts = sorted({row[1], *row[0]})
    times = [max(1, row[0].count(c)) for c in cuts]
    per = -(-n // count)
    hot = max(times) > 1
    width = [max(1.0, (b - a) / per) for a, b in zip(cuts, [*cuts[1:], row[2] + 1], strict=True)]
    own = [t * per if t > 1 else 0 for t in times]  # ranges of the cut's own key
    base, at = [], 0
    for o in own:
        base.append(at)
        at += o + per
    i = _find(cuts, F.col("key")) - 1
    pick = lambda v, kind: F.get(F.array(*map(F.lit, v)).cast(f"array<{kind}>"), i)
    docs = docs.withColumn("h", F.xxhash64("text") if hot else F.lit(0).cast("long"))
    share = F.col("h").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    by_hash = F.least(F.floor(share * pick(own, "int")).cast("int"), pick(own, "int") - 1)
    by_key = pick(own, "int") + F.least(F.floor((F.col("key").cast("double") - pick(cuts, "bigint").cast("double")) / pick(width, "double")).cast("int"), F.lit(per - 1))
    within = F.when((F.col("key") == pick(cuts, "bigint")) & (pick(own, "int") > 0), by_hash).otherwise(by_key)
    return docs.withColumn("range", pick(base, "int") + within)


def _in_ranges(docs: DataFrame) -> DataFrame:
    """Rows (key, text, ...) dealt to ranges of the key (columns range, h), with the first rows of each range repeated behind the range before it, and those of the
    first one behind the last (column extra: 0, else 1, 2)."""
    docs = _with_range(docs)
    firsts = stash(docs.groupBy("range").agg(F.min(F.struct("key", "h")).alias("first")), "firsts")  # a row per range
    n, last = firsts.agg(F.count("*"), F.max("range")).first()
    to = firsts.select(F.col("range").alias("own"), "first", F.lag("range").over(Window.orderBy("range")).alias("before"))
    to = stash(to.select("own", "first", F.coalesce("before", F.lit(last)).alias("to"), F.when(F.col("before").isNull(), 2).otherwise(1).alias("extra")), "ranges")
    discard(firsts)
    to = F.broadcast(to) if n <= 1_000_000 else to  # 40 bytes a row
    moved = docs.join(to, (F.col("range") == F.col("own")) & (F.col("key") == F.col("first.key")) & (F.col("h") == F.col("first.h")))
    moved = moved.withColumn("range", F.col("to")).drop("own", "first", "to")
    return docs.withColumn("extra", F.lit(0)).unionByName(moved)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose last quarter of code points is replaced by as many from the start of the
    next document (all of a shorter one); documents in ascending order of id, null ids first, rows of one id by a hash of the text if it fills a good part of
    the table, then by text, the first after the last.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text counts as empty.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = fingerprints(_in_ranges(rows).repartition("range"))  # dealt before the sets are made: these aren't shuffled
    order = Window.partitionBy("range").orderBy("extra", "key", "h", "text")
    rows = rows.withColumn("next", F.lead(F.struct("text", "sigs")).over(order)).where("extra = 0")
    n = F.char_length("text").cast("long")
    cut = F.floor(n / 4)
    edited = F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring(F.col("next.text"), F.lit(1), cut.cast("int")))
    rows = _sets(rows.select("doc_id", n.alias("n_chars"), "sigs", F.col("next.sigs").alias("next_sigs"), edited.alias("edited")), "edited", "edited_sigs")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
