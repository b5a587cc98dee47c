"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut_lineage

#: The weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
FAN_IN = 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target for each source (null is a source, the last): `share` of all sizes dealt by weight, no
    target above `most` times its source's size, the excess reshared by weight.

    With sources in the order of size / weight, all before some point are at their limit and the others share the
    rest by weight; the point is the first where the share fits. One row per source, so windows over all are small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    up = everything.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(most))
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    per = per.withColumn("rate", left / F.sum("weight").over(after))
    fits = F.when(F.col("rate") * F.col("weight") <= F.col("limit"), F.col("rate"))
    rate = F.first(fits, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select("source", "source_size", F.least("limit", F.coalesce(rate, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _pivot(state: Column, x: Column) -> Column:
    """One step: of the open document in `state` and the document x, one becomes integral and the other stays open.

    Word mass moves between the two, so size_a p_a + size_b p_b stays; each way's chance makes both probabilities
    right in the mean. Sizes are above 0 here."""
    a = state["open"]
    pa, pb, sa, sb = a["p"], x["p"], a["size"].cast("double"), x["size"].cast("double")
    up = F.least((F.lit(1.0) - pa) * sa, pb * sb)  # mass from x to a
    down = F.least(pa * sa, (F.lit(1.0) - pb) * sb)  # mass from a to x
    moved = F.when(x["u"] * (up + down) < down, up).otherwise(-down)
    to_a, to_b = pa + moved / sa, pb - moved / sb
    near = F.lit(1e-9)
    snap = lambda p: F.when(p < near, F.lit(0.0)).when(p > F.lit(1.0) - near, F.lit(1.0)).otherwise(p)
    step = F.struct(snap(to_a).alias("a"), snap(to_b).alias("b"))

    def settle(s: Column) -> Column:
        a_done = (s["a"] == 0.0) | (s["a"] == 1.0)
        put = lambda row, p: row.withField("p", p)
        done, stays = F.when(a_done, put(a, s["a"])).otherwise(put(x, s["b"])), F.when(a_done, put(x, s["b"])).otherwise(put(a, s["a"]))
        return F.struct(F.concat(state["done"], F.array(done)).alias("done"), stays.alias("open"))

    return F.element_at(F.transform(F.array(step), settle), 1)


def pivotal_round(docs: DataFrame, seed: int = 17, fan_in: int = FAN_IN) -> DataFrame:
    """docs (key, grp, size, p in [0, 1), other columns) with p rounded to 0 or 1; sums of size x p stay within one document's size in a group.

    Keys tell all rows apart. A tree: in each group, about `fan_in` documents meet by hash, all but one become integral, and the open ones meet
    again, until a group has one open document, which is rounded by its own chance. Each level is written to the shared
    folder. Levels grow with the logarithm of the largest group.
    """
    names = docs.columns
    row = lambda level: F.struct(*names, (F.pmod(F.xxhash64("key", F.lit(seed), F.lit(level), F.lit(1)), F.lit(1 << 40)) / float(1 << 40)).alias("u"))
    fixed = docs.where((F.col("p") <= 0) | (F.col("p") >= 1) | (F.col("size") <= 0)).withColumn("p", F.when(F.col("p") >= 1, 1.0).otherwise(0.0))
    left = docs.where((F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0))
    largest = left.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    out, level = fixed, 0
    while largest > 0:
        parts = max(1, -(-largest // fan_in))
        part = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(level)), F.lit(parts)) if parts > 1 else F.lit(0)
        groups = left.withColumn("_row", row(level)).groupBy("grp", part.alias("_part")).agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("key", F.lit(seed + 1)).alias("h"), "_row"))).alias("rows"))
        rows = F.transform("rows", lambda x: x["_row"])
        empty = F.filter(rows, lambda x: F.lit(False))
        folded = groups.select(F.aggregate(F.slice(rows, 2, F.greatest(F.size("rows") - 1, F.lit(0))), F.struct(empty.alias("done"), F.element_at(rows, 1).alias("open")), _pivot).alias("s"))
        folded = cut_lineage(folded)
        done = folded.select(F.explode("s.done").alias("r")).select("r.*")
        last = folded.select("s.open.*")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        out = out.unionByName(done.select(*names)).unionByName(last.where(~open_).select(*names))
        left, level = last.where(open_).select(*names), level + 1
        if parts == 1:
            return out.unionByName(last.where(open_).withColumn("p", (F.col("u") < F.col("p")).cast("double")).select(*names))
        largest = left.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    return out


def mix_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, key (see `row_key`).

    size counts words of the whole text (null: 0); copies is 0, 1 or 2, taken = copies x size; a document of size 0 is
    taken by its source's rate rounded down. A source's taken words differ from its target by at most its largest document. Null
    sources are one source; null ids stay null; repeated rows are documents of their own, rounded among themselves first, so that any number
    of them is one row in the tree. The draw depends on ids, sources, texts and the seed only, ties included. Other columns, whatever their
    names, are not read; an empty table gives no rows.
    """
    alike = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key().alias("key")).groupBy("doc_id", "source", "size", "key")
    sized = cut_lineage(alike.agg(F.count(F.lit(1)).alias("rows")))
    targets = cut_lineage(source_targets(sized.select("source", (F.col("size") * F.col("rows")).alias("size")), share, most))
    both = sized.alias("d").join(targets.withColumnRenamed("source", "_source"), F.col("d.source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-9)
    part = F.greatest(rate - whole, F.lit(0.0))
    # rows that are alike are rounded among themselves first: so many are taken whole, and one stays open for what is left
    of_all = F.when(part < 1e-9, 0.0).otherwise(part) * F.col("rows")
    taken = F.floor(of_all + 1e-9)
    open_ = F.greatest(of_all - taken, F.lit(0.0))
    ready = both.select("doc_id", "size", "source_size", "target", "key", "rows", F.col("source").alias("grp"), whole.cast("long").alias("whole"), F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("more"), F.when(open_ < 1e-9, 0.0).otherwise(open_).alias("p"))
    rounded = pivotal_round(ready, seed)
    # each of the rows again; a long series is made in two steps, so that no array holds it whole
    step = 10_000
    blocks = rounded.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("rows") - 1).cast("long"), F.lit(step).cast("long"))))
    each = blocks.withColumn("nth", F.explode(F.sequence(F.col("block") + 1, F.least(F.col("block") + step, F.col("rows")))))
    copies = F.col("whole") + (F.col("nth") <= F.col("more") + F.col("p").cast("long")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "key")


def row_key() -> Column:
    """A hash of what tells documents apart: id, source and text."""
    return F.xxhash64("doc_id", "source", "text")


def repeat_by_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents with their columns, each as often as the mix takes it; of rows repeated in id, source and text one stands for all, as often as all are taken."""
    names = docs.columns
    taken = mix_documents(docs, **options).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")
    keyed = docs.withColumn("_key1", row_key())
    both = keyed.join(cut_lineage(taken), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key1") == F.col("_key")))
    return both.dropDuplicates(["doc_id", "_key"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*names)
