"""Document fingerprints by spot signatures, with DataFrame expressions only.

A spot is a common word (an anchor) that a content word follows; its signature is the anchor and the
chain of the next ``CHAIN`` content words, common words in between left out. The start of a text, of a
line and of a sentence are anchors too, so that texts with few common words have spots. Of a run of
anchors the last speaks for the run, so the work is linear in the text. A signature found 2, 4, 8, ...
times counts once more for each doubling, which keeps repetitive texts comparable. The fingerprint is
the sorted set of the signatures' 32-bit hashes, eight hex digits each.

Likeness is the Jaccard similarity of two sets. Sets whose length partitions (powers of 1/threshold)
lie more than one apart can't reach the threshold, which prunes comparisons; ``near_duplicates``
joins only within and between neighbouring partitions, on the rarest signatures of each set.

Null texts count as empty. An empty text has an empty fingerprint; any other text has at least one
signature (of the whole text, if it has no content words). Two empty sets have likeness 1, an
empty and another 0. Equal texts have equal fingerprints; repeated rows are each reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import ident, saved

# Common words of four languages.
ANCHORS = (
    "a al als an and are as at au auch auf aus avec be by con dans das de del dem den der des die do du ein eine el en es est et for from für "
    "had has have he her his im in is ist it la las le les lo los mais mit más nach nicht no not of on or par para pas plus por pour que qui se "
    "sich son su sur that the this to un una und une von was which with y zu"
).split()
CHAIN = 2
MARK, STOP = "\u0001", "\u0002"
#: Doublings that are told apart.
LEVELS = 20
#: Rows of a bucket when documents are put in order; the ordering is by bucket, not in one partition.
BUCKET_ROWS = 2_048
#: A range is cut anew if it holds so many times as many.
MOST_ROWS = 4
#: Classes of one signature that meet in one task.
GROUP_CLASSES = 1_024
BROADCAST_HEADS = 100_000


def signatures(text: Column) -> Column:
    """The sorted distinct signature hashes (32 bits, as long) of a text that isn't null."""
    start = " " + MARK + "^ "
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), "[.!?\n]+", STOP), r"[^\p{L}\p{N}" + STOP + "]+", " ")
    marked = F.regexp_replace(clean, "(?<![^ " + STOP + "])(?:" + "|".join(ANCHORS) + ")(?![^ " + STOP + "])", MARK + "$0")
    marked = F.concat(F.lit(start), F.regexp_replace(marked, "[ " + STOP + "]*" + STOP + "[ " + STOP + "]*", start))
    # possessive repetition: no backtracking, and no recursion on long runs of anchors
    spot = MARK + "(?=([^ ]+ +[^ " + MARK + "][^ ]*(?:(?: +" + MARK + "[^ ]+)*+ +[^ " + MARK + "][^ ]*){0," + str(CHAIN - 1) + "}+))"
    hash32 = lambda *s: F.shiftrightunsigned(F.xxhash64(*s), 32)
    found = F.transform(F.regexp_extract_all(marked, F.lit(spot), F.lit(1)), lambda s: hash32(F.regexp_replace(F.regexp_replace(s, " +" + MARK + "[^ ]+", ""), " +", " ")))
    runs = F.array(*[F.lit(1 << k) for k in range(LEVELS + 1)])
    # in sorted order a signature's nth finding stands n - 1 places after its first
    level = lambda all_, x, i: F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.get(all_, i + F.get(runs, k) - 1) == x)
    first = lambda all_, x, i: (i == 0) | (F.get(all_, i - 1) != x)
    counted = lambda all_: F.flatten(F.transform(all_, lambda x, i: F.when(first(all_, x, i), F.transform(level(all_, x, i), lambda k: F.when(k == 0, x).otherwise(hash32(x, k)))).otherwise(F.array().cast("array<bigint>"))))
    whole = F.when(F.length(text) > 0, F.array(hash32(text))).otherwise(F.array().cast("array<bigint>"))
    every = F.transform(F.array(F.sort_array(found)), lambda a: F.sort_array(F.array_distinct(counted(a))))
    return F.transform(every, lambda x: F.when(F.size(x) > 0, x).otherwise(whole))[0]


def fingerprint(sets: Column) -> Column:
    return F.concat_ws("", F.transform(sets, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.transform(F.array(both), lambda x: x / (F.size(a) + F.size(b) - x))[0])


def length_partition(size: Column, threshold: float) -> Column:
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")).otherwise(F.lit(-1))


def _offset(value: Column, lo: Column, hi: Column) -> Column:
    """value - lo as double, exact where the range allows it; never falls with value."""
    near = F.shiftright(hi, 1) - F.shiftright(lo, 1) < (1 << 61)
    return F.when(near, (value - lo).cast("double")).otherwise(value.cast("double") - lo.cast("double"))


def _bucketed(rows: DataFrame) -> DataFrame:
    """rows: key, tie (long). Adds bucket: paths of ranges of keys, of about BUCKET_ROWS rows however the keys lie.

    Ranges of equal width first; a range that holds too many rows is cut anew within its own bounds, as often as needed, and one
    of a single key is cut by tie. Only rows equal in both can make a larger bucket.
    """
    stats = lambda df: df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("tie").alias("tie_lo"), F.max("tie").alias("tie_hi"))
    cut = F.floor(_offset(F.col("at"), F.col("from"), F.col("to")) / F.col("step")).cast("long")
    of_key = F.col("lo") < F.col("hi")

    def cells(found: DataFrame) -> DataFrame:
        lo, hi = F.when(of_key, F.col("lo")).otherwise(F.col("tie_lo")), F.when(of_key, F.col("hi")).otherwise(F.col("tie_hi"))
        wide = found.withColumn("from", lo).withColumn("to", hi).withColumn("by_key", of_key)
        step = (_offset(F.col("to"), F.col("from"), F.col("to")) + 1) / F.greatest(F.lit(2.0), F.floor(F.col("n") / BUCKET_ROWS).cast("double"))
        return wide.select(F.col("bucket").alias("cell"), "from", "to", "by_key", step.alias("step"))

    narrow, levels = rows.select("key", "tie").withColumn("bucket", F.array().cast("array<bigint>")), []
    apply = lambda df, over: df.join(over, F.col("bucket") == F.col("cell"), "left").withColumn("at", F.when(F.col("by_key"), F.col("key")).otherwise(F.col("tie"))).withColumn("bucket", F.when(F.col("cell").isNotNull(), F.concat("bucket", F.array(cut))).otherwise(F.col("bucket"))).drop("cell", "from", "to", "by_key", "step", "at")
    while True:
        over = stats(narrow).filter((F.col("n") > MOST_ROWS * BUCKET_ROWS) & (of_key | (F.col("tie_lo") < F.col("tie_hi"))))
        over = saved(cells(over))
        n = over.count()
        if not n:
            break
        levels.append(F.broadcast(over) if n <= BROADCAST_HEADS else over)
        narrow = apply(narrow, levels[-1])
    rows = rows.withColumn("bucket", F.array().cast("array<bigint>"))
    for over in levels:
        rows = apply(rows, over)
    return rows


def with_next(rows: DataFrame, carry: list[str]) -> DataFrame:
    """rows: doc_id (long), text, columns carry. Adds next_<column> of the next row by descending doc_id, then a hash of the text; after the last comes the first.

    Ids are cut into ranges of about BUCKET_ROWS rows; the first row of each range is also sent, as a
    guest, to the end of the range before it. Only the ranges' first ids are ordered in one place.
    """
    least = rows.agg(F.min("doc_id")).first()[0]
    least = 0 if least is None else max(least, -(1 << 63) + 1)
    # rows without id come last
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id"), F.lit(least - 1).cast("long"))).withColumn("tie", F.xxhash64("text"))
    rows = _bucketed(rows)
    heads = saved(rows.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("head")))
    order = Window.orderBy(F.col("head").desc())
    last, before = F.last("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lag("bucket").over(order)
    heads = saved(heads.select(F.col("head.key").alias("head_key"), F.col("head.tie").alias("head_tie"), F.coalesce(before, last).alias("host")))
    small = heads.count() <= BROADCAST_HEADS
    rows = rows.join(F.broadcast(heads) if small else heads, (F.col("key") == F.col("head_key")) & (F.col("tie") == F.col("head_tie")), "left")
    places = F.filter(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))), lambda x: x["bucket"].isNotNull())
    rows = rows.withColumn("at", F.explode(places)).drop("bucket", "head_key", "head_tie", "host").select("*", "at.bucket", "at.guest").drop("at")
    w = Window.partitionBy("bucket").orderBy("guest", F.col("key").desc(), F.col("tie").desc(), "text")
    return rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).filter("not guest").drop("guest", "key", "tie", "bucket")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against itself with its last third taken from the next document: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next."""
    rows = docs.select(F.col(ident(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(ident(text_col)), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sigs", signatures(F.col("text"))), ["text", "sigs"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", "sigs", "next_sigs", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b, likeness) of classes of equal fingerprints, each named by its least id, whose likeness is at least threshold; a < b.

    Any two such sets share one of the first n - ceil(threshold n) + 1 signatures of each, rarest first,
    and lie in the same or in neighbouring length partitions.
    """
    sets = docs.select(F.col(ident(id_col)).alias("id"), signatures(F.coalesce(F.col(ident(text_col)), F.lit(""))).alias("sigs")).filter("size(sigs) > 0")
    classes = saved(sets.groupBy("sigs").agg(F.min("id").alias("id")).select("id", "sigs", F.size("sigs").alias("n")))
    each = classes.select("id", "n", F.explode("sigs").alias("sig"))
    counts = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(counts.filter("df > 1"), "sig").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("shared"))
    least = lambda n: F.ceil(F.lit(threshold) * n - 1e-9)
    need = F.greatest(F.lit(0), F.col("n") - least(F.col("n")) + 1 - (F.col("n") - F.size("shared"))).cast("int")
    part = length_partition(F.col("n"), threshold)
    index = saved(ranked.withColumn("prefix", F.slice("shared", 1, need)).select("id", "n", part.alias("part"), F.explode("prefix.sig").alias("sig")))
    # a signature that many classes have is dealt over tasks for pairs of its chunks
    chunks = index.groupBy("part", "sig").agg(F.ceil(F.count(F.lit(1)) / GROUP_CLASSES).cast("int").alias("chunks"))
    index = index.withColumn("own", F.xxhash64("id"))
    probe = index.select(F.col("id").alias("b"), F.col("n").alias("m"), F.explode(F.sequence(F.col("part"), F.col("part") + 1)).alias("part"), "sig", "own").join(chunks, ["part", "sig"])
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    index = index.withColumnRenamed("id", "a").join(chunks, ["part", "sig"]).withColumn("i", F.pmod("own", F.col("chunks")).cast("int")).withColumn("j", every(F.col("chunks"))).drop("own", "chunks")
    probe = probe.withColumn("j", F.pmod("own", F.col("chunks")).cast("int")).withColumn("i", every(F.col("chunks"))).drop("own", "chunks")
    bound = (F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m") - 1e-9) & ((F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b"))))
    pairs = index.join(probe, ["part", "sig", "i", "j"]).filter(bound).select("a", "b").distinct()
    left, right = classes.select(F.col("id").alias("a"), F.col("sigs").alias("x")), classes.select(F.col("id").alias("b"), F.col("sigs").alias("y"))
    near = pairs.join(left, "a").join(right, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("x"), F.col("y")).alias("likeness"))
    return near.filter(F.col("likeness") >= threshold - 1e-12)
