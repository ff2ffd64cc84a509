"""Document fingerprints by SpotSigs. DataFrame operations only.

A signature is an anchor (a common word) followed by the next content words (words that are no anchors), as a chain of
CHAIN words; a document's fingerprint is the set of its signatures, written as the hexadecimal of their sorted 32-bit
hashes. Likeness is the Jaccard of two sets, compared only where the set lengths allow the wanted likeness.

The j-th anchor at word i has i - j content words before it, so the chain that starts there is a slice of the array of
content words: one pass over the words, no nested search.

Defined cases: null text is empty; a text without letters or digits has the signature of its whole text (none if it is
empty), so that equal texts have equal fingerprints and a non-empty text has a non-empty one; two empty sets are alike
(1.0); the text before the first anchor hangs on a virtual anchor at the start; repeated doc_ids keep their rows and
follow each other in the order of their texts, null doc_ids first; columns pass through `with_fingerprint` but for those it
adds (sigs, fingerprint). Rows of one doc_id, and those without any, are one slice of `with_next`: where they are very
many, they are sorted by one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostride.session import materialize, table

#: Content words in a chain.
CHAIN = 3
#: Anchors: common words of English, French, German and Spanish. Fixed values.
ANCHORS = (
    "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their there they this to was were which who will with you "
    "au aux avec ce cette dans de des du elle en est et il la le les leur ne nous on ont ou par pas plus pour qui que se ses son sont sur un une vous y "
    "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch sich sie sind so und von vor war wie wird zu zum zur über "
    "al como con del el ella ellos entre era eran es esta este fue ha la las lo los más muy no o para pero por que se sin sobre su sus también un una y ya"
)
ANCHOR_SET = tuple(dict.fromkeys(ANCHORS.split()))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def signature_set(words: Column, text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct 32-bit signatures of an array of words."""
    spots = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*ANCHOR_SET), i)), lambda i: i.isNotNull())
    content = F.filter(words, lambda w: ~w.isin(*ANCHOR_SET))

    def signature(anchor: Column, rank: Column, content: Column) -> Column:
        return F.hash(anchor, *(F.get(content, rank + k) for k in range(chain)))

    # bound once by transform over an array of one struct, so that no part is computed twice
    parts = F.array(F.struct(spots.alias("spots"), content.alias("content"), words.alias("words")))
    chained = F.flatten(F.transform(parts, lambda p: F.concat(
        F.when(F.size(p["content"]) > 0, F.array(signature(F.lit(""), F.lit(0), p["content"]))).otherwise(F.array().cast("array<int>")),
        F.transform(F.filter(F.transform(p["spots"], lambda i, j: F.struct(i.alias("i"), (i - j).alias("rank"))), lambda s: s["rank"] < F.size(p["content"])), lambda s: signature(F.get(p["words"], s["i"]), s["rank"], p["content"])),
    )))
    whole = F.when(F.length(text) > 0, F.array(F.hash(F.lit("whole"), text))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array(F.array_sort(F.array_distinct(chained))), lambda s: F.when(F.size(s) > 0, s).otherwise(whole))[0]


def as_hex(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def pruned_jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 where their lengths rule out `least` already (the shorter over the longer is the most it
    can be), so that the sets are not intersected."""
    short, long_ = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(long_ == 0, F.lit(1.0)).when((short == 0) | (short / long_ < least), F.lit(0.0)).otherwise(F.transform(F.array(common), lambda c: c / (F.size(a) + F.size(b) - c))[0])


def with_fingerprint(docs: DataFrame, text: str = "text", chain: int = CHAIN) -> DataFrame:
    """Adds sigs (the set) and fingerprint (its hexadecimal)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("sigs", signature_set(words_of(whole), whole, chain)).withColumn("fingerprint", as_hex(F.col("sigs")))


def length_partition(n: Column, least: float) -> Column:
    """Partition of a set length: lengths whose ratio is `least` or more lie in the same or neighbouring partitions."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(least))).cast("int")


#: Likeness from which two texts count as copies of each other.
ALIKE = 0.8


def alike(a: Column, b: Column, least: float = ALIKE) -> Column:
    """Whether two sets have a likeness of `least` or more. Sets whose lengths lie in partitions that don't adjoin are
    apart without more; of the others only those are intersected whose lengths allow it."""
    adjoin = F.abs(length_partition(F.size(a), least) - length_partition(F.size(b), least)) <= 1
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(~both, F.size(a) == F.size(b)).otherwise(adjoin & (pruned_jaccard(a, b, least) >= least))


def fingerprint_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = ALIKE) -> DataFrame:
    """Pairs (a, b, likeness) of distinct fingerprints with likeness >= least, a and b the smallest keys of their
    fingerprint. Sets are partitioned by length; within a partition and its neighbour they meet in their rarest
    signatures, as many as two sets this alike can't all miss, and each pair that has met is compared once, through
    pruned Jaccard."""
    prints = with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text").groupBy("fingerprint").agg(F.min("key").alias("key"), F.first("sigs").alias("sigs"))
    prints = materialize(prints.filter((F.size("sigs") > 0) & F.col("key").isNotNull()).select("key", "sigs"), "spotsigs")
    held = prints.select("key", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    shared = held.groupBy("sig").agg(F.count("*").alias("f")).filter("f > 1")
    own = Window.partitionBy("key")
    ranked = held.join(shared, "sig").withColumn("rank", F.row_number().over(own.orderBy("f", "sig"))).withColumn("shared", F.count("*").over(own))
    # signatures of no other set come first in the order of rarity
    most = F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1
    met = materialize(ranked.filter(F.col("rank") + F.col("n") - F.col("shared") <= most).select("key", "n", "sig", length_partition(F.col("n"), least).alias("part")), "spotsigs-met")
    left = met.select(F.col("key").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = met.select(F.col("key").alias("b"), F.col("n").alias("nb"), "sig", "part")
    alike = F.least("na", "nb") >= F.greatest("na", "nb") * least
    pairs = left.join(right, ["sig", "part"]).filter((F.col("a") != F.col("b")) & alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = lambda k, s: prints.select(F.col("key").alias(k), F.col("sigs").alias(s))
    both = pairs.join(sets("a", "sa"), "a").join(sets("b", "sb"), "b")
    return both.select("a", "b", pruned_jaccard(F.col("sa"), F.col("sb"), least).alias("likeness")).filter(F.col("likeness") >= least)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Adds next_text: the text of the next row in ascending key (then text) order, after the last that of the first; and
    next_<column> for the columns in `also`.

    The rows are cut into slices at quantiles of the key, several for each shuffle partition; each slice's first row is
    also sent to the end of the slice before it. So one exchange of the texts suffices and no task sees all rows."""
    spark = docs.sparkSession
    slices = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the bounds are as many as the slices: their number follows the cluster's setting, not the rows
    bounds = docs.agg(F.percentile_approx(key, [k / slices for k in range(1, slices)], 10 * slices).alias("b")).first()["b"]
    bounds = sorted(set(bounds or []))
    # looked up in two levels, some sqrt(slices) comparisons each
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    value = F.col(key)
    if bounds:
        heads = F.array(*(F.lit(g[0]).cast("long") for g in groups))
        nested = F.array(*(F.array(*(F.lit(x).cast("long") for x in g)) for g in groups))
        at = F.size(F.filter(heads, lambda h: h <= value))
        inner = F.size(F.filter(F.element_at(nested, F.col("_at")), lambda x: x <= value))
        rows = docs.withColumn("_at", F.when(value.isNull(), 0).otherwise(at)).withColumn("_slice", F.when(F.col("_at") == 0, 0).otherwise((F.col("_at") - 1) * width + inner)).drop("_at")
    else:
        rows = docs.withColumn("_slice", F.lit(0))
    order = [F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first()]
    # the first row of each slice. Its key comes from the keys alone; one key a slice goes to the driver, as many as the
    # cluster's setting says. Only the rows with these keys are then read with their texts.
    first_keys = [r["k"] for r in rows.groupBy("_slice").agg(F.min(key).alias("k")).collect() if r["k"] is not None]
    leading = rows.filter(F.col(key).isin(*first_keys) | F.col(key).isNull()) if first_keys else rows
    firsts = leading.groupBy("_slice").agg(F.min(F.struct(F.col(key).alias("k"), F.col(text).alias("t"), *(F.col(c).alias(c) for c in also))).alias("f"))
    by = Window.partitionBy(F.lit(0)).orderBy("_slice")
    before = F.coalesce(F.lag("_slice").over(by), F.max("_slice").over(Window.partitionBy(F.lit(0))))
    ends = firsts.select(before.alias("_slice"), F.col("f.t").alias(text), *(F.col(f"f.{c}").alias(c) for c in also), F.lit(True).alias("_is_end"))
    marked = rows.withColumn("_is_end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    window = Window.partitionBy("_slice").orderBy("_is_end", *order)
    led = {"next_text": F.lead(text).over(window)} | {f"next_{c}": F.lead(c).over(window) for c in also}
    return marked.withColumns(led).filter("not _is_end").drop("_slice", "_is_end")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # a text's own set travels with it to the row before, which would otherwise work it out again
    docs = docs.withColumn("sigs", signature_set(words_of(F.col("text")), F.col("text")))
    rows = with_next(docs, also=("sigs",)).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2)
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half.cast("int"))))
    rows = rows.withColumn("edited_sigs", signature_set(words_of(F.col("edited")), F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_hex(F.col("sigs")).alias("fingerprint"), as_hex(F.col("edited_sigs")).alias("edited_fingerprint"),
        pruned_jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), pruned_jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        alike(F.col("sigs"), F.col("edited_sigs")).alias("alike_edited"), alike(F.col("sigs"), F.col("next_sigs")).alias("alike_next"),
    )
