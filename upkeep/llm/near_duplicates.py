"""Near duplicates by bottom-k sketches of word shingles.

A document's set is its distinct shingles of ``size`` words (the whole sequence,
if shorter). One hash function orders all shingles; the sketch of a set is its
``SKETCH`` smallest values. Documents are linked at a Jaccard similarity of
``percent`` / 100 or more:

1. Documents with equal sets are one class (a grouping with map-side minimum);
   only the class's smallest document goes on, so groups of copies of any size
   cost one row.
2. Inverted lists: a retained value with the classes whose sketch holds it.
   Similar classes share about ``percent`` of their sketch and never less than
   half (six standard deviations at 0.8 and 64 values). So each class enters
   the lists of its rarest values only, as many as make it impossible that two
   sketches with half their values in common share none of them (the prefix
   filter). Passages that many documents share make long lists only for
   documents that consist of them.
3. Stars: in every list the class with the most widely shared sketch is the
   hub, compared with all others; where most members share shingles that the hub
   lacks, the member closest to what they share takes its place. Linked members
   leave the list with the hub. ``STARS`` rounds reduce groups of thousands of
   near copies to the few members that are not linked to a hub.
   Members near a hub (d <= 2 * limit) but not linked to it may be linked to those
   that left, or to each other. With R, the hub's shingles and those that more
   than half of its members have besides, |x & y| <= min(|x & R|, |y & R|) + m, m
   the shared shingles outside R. So such pairs are found by joins on the few
   shingles outside R and, for m = 0, on sizes, never by listing a group's pairs:
   near copies of a text share R and little else. What no hub is near to is
   compared pair by pair at the end.
4. Each comparison estimates the similarity from the sketch of the union
   (the smallest values of both sketches) and, if it may reach the limit,
   is confirmed on the full sets.
5. Components of the confirmed links.

Hashes are 64 bits wide; equal sets are told by 128 bits and the size.

Defined cases: null and empty texts have an empty set and link with nothing (each
is its own component); rows that share an id are documents of their own, each
sketched, linked and returned; a component is kept as its row of the smallest id, of
several the one of the smallest hash of the row; an empty table gives no rows;
further columns do not matter. A null id links with nothing and has a null component
and kept.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.llm.components import components
from upkeep.llm.storage import check_columns, handed_back, small_batches, unsorted_buckets, written
from upkeep.llm.words import mix, runs, windows

SKETCH = 64
STARS = 2
SLACK = 0.25
DEAL = 2000


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for lo, hi, block in runs(column, lower=True):
        hashes = block.hashes()
        for i in range(hi - lo):
            own = hashes[block.first[i]:block.first[i + 1]]
            n = len(own)
            yield np.unique(windows(own, size)) if n >= size else mix(windows(own, n) + np.uint64(n)) if n else own


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64) ^ np.int64(-(1 << 63))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, sig1, sig2, sketch): sketch holds the smallest hashes, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, one, two, low = [], [], [], []
            for s in _sets(batch.column(1), size):
                count.append(len(s))
                one.append(np.add.reduce(mix(s)))
                two.append(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))))
                low.append(_signed(s[:SKETCH]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(count, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)),
                pa.array(np.array(two, np.uint64).view(np.int64)), pa.array(low, pa.list_(pa.int64())),
            ], ["doc_id", "n_shingles", "sig1", "sig2", "sketch"])
        handed_back()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sig1 long, sig2 long, sketch array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_signed(s) for s in _sets(batch.column(1), size)], pa.list_(pa.int64()))], ["doc", "shingles"])
        handed_back()

    return docs.mapInArrow(run, "doc long, shingles array<long>")


def _sizes(na: str, nb: str, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _may_link(a: str, b: str, na: str, nb: str, percent: int) -> Column:
    """Whether sizes and the union's sketch leave a similarity of ``percent`` possible."""
    union = f"slice(sort_array(array_union({a}, {b})), 1, {SKETCH})"  # array_sort calls its comparator for every two values
    both = f"array_intersect({a}, {b})"
    estimate = F.expr(f"size(array_intersect({union}, {both})) / size({union})")
    return _sizes(na, nb, percent) & (estimate >= percent / 100 - SLACK)


def _reach(percent: int) -> int:
    """The least similarity, in percent, to a hub of a class linked to one that is linked to the hub."""
    return 100 - 2 * (100 - percent)


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, around: bool = False) -> DataFrame:
    """(a, b, linked, similarity) of the pairs (a, b) that the sketches leave
    possible. ``a`` may occur in very many pairs: they are dealt out over as
    many copies of its set as keep a task at ``DEAL`` pairs. ``around``: all pairs
    down to ``_reach`` and, for those, n (size of b), both (size of the
    intersection), gained (shingles of b that a lacks) and the deal (of deals)."""
    least = _reach(percent) if around else percent
    one = classes.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = classes.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    near = pairs.distinct().join(one, "a").join(two, "b").where(_may_link("s_a", "s_b", "n_a", "n_b", least))
    near = written(near.select("a", "b", "n_a", "n_b"), "pairs")
    deals = near.groupBy("a").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("deals"))
    near = near.join(deals, "a").withColumn("deal", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int"))
    one = (deals.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("t_a")), "a")
           .select("a", "t_a", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal")))
    two = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("t_b"))
    both = F.size(F.array_intersect("t_a", "t_b")).cast("long")
    common = near.join(two, "b").join(one, ["a", "deal"]).select("a", "b", "n_a", "n_b", both.alias("both"), *(["t_a", "t_b", "deal", "deals"] if around else []))
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    out = ["a", "b", (F.col("both") * 100 >= union * percent).alias("linked"), (F.col("both") / union).alias("similarity")]
    if around:
        out += [F.col("n_b").alias("n"), "both", F.when(F.col("both") * 100 >= union * least, F.array_except("t_b", "t_a")).alias("gained"), "deal", "deals"]
    return written(common.select(*out), "links")


def _lists(classes: DataFrame) -> DataFrame:
    """(value, doc, rank): the inverted lists after the prefix filter; the hub of
    a list is its member of highest rank."""
    entries = classes.select("doc", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("freq")).where("freq > 1")
    own = entries.join(shared, "value").groupBy("doc", "k").agg(
        F.sort_array(F.collect_list(F.struct("freq", "value"))).alias("shared"), F.sum("freq").alias("popularity"))
    # k - k/2 + 1 rarest values of the sketch, of which k - size(shared) are in no other sketch
    take = F.expr("greatest(0, (k - cast(ceil(k / 2) AS int) + 1) - (k - size(shared)))")
    kept = own.select("doc", F.struct("popularity", (-F.col("doc")).alias("minus")).alias("rank"), F.explode(F.slice("shared", F.lit(1), take)).alias("e"))
    return kept.select(F.col("e.value").alias("value"), "doc", "rank")


def link_classes(classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links (a, b, linked, similarity) between classes (doc, n, sketch): any two
    classes that are linked are joined by a chain of links. None: no pairs."""
    spark = docs.sparkSession
    lists = written(_lists(classes), "lists")
    involved = written(lists.select("doc").distinct(), "involved")
    classes = written(classes.join(involved, "doc", "left_semi"), "classes")
    # full sets of the classes in lists, bucketed: no comparison shuffles them again
    table = f"near_sets_{uuid.uuid4().hex}"
    # texts are dealt by id, as the buckets are: a bucket is one file, not one a task
    texts = docs.join(involved.withColumnRenamed("doc", "doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text")
    with small_batches(spark), unsorted_buckets(spark):
        full_sets(texts, size).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc").format("parquet").saveAsTable(table)
    try:
        found = list(_rounds(lists, classes, spark.table(table), percent))
    finally:
        spark.sql(f"DROP TABLE {table}")
    return functools.reduce(DataFrame.unionAll, found) if found else None


def _rounds(lists: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> Iterator[DataFrame]:
    members = []
    for turn in range(STARS):
        hubs = lists.groupBy("value").agg(F.max_by("doc", "rank").alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members")
        spokes = written(lists.join(hubs, "value").where("doc <> hub"), "spokes")
        if spokes.isEmpty():
            break
        judged = _confirmed(spokes.select(F.col("hub").alias("a"), F.col("doc").alias("b")), classes, sets, percent, around=True)
        yield judged.select("a", "b", "linked", "similarity")
        related = _related(judged)
        centres = written(_centres(related), "centres")
        if not centres.isEmpty():
            hubs = hubs.join(centres, "hub", "left").select("value", F.coalesce("centre", "hub").alias("hub"))
            spokes = written(lists.join(hubs, "value").where("doc <> hub"), "spokes")
            moved = spokes.join(centres.select(F.col("centre").alias("hub")).distinct(), "hub", "left_semi")
            again = _confirmed(moved.select(F.col("hub").alias("a"), F.col("doc").alias("b")), classes, sets, percent, around=True)
            yield again.select("a", "b", "linked", "similarity")
            old = judged.join(centres.select(F.col("hub").alias("a")), "a", "left_anti").join(centres.select(F.col("centre").alias("a")).distinct(), "a", "left_anti")
            judged = written(old.unionAll(again), "judged")
            related = _related(judged)
        members.append(related.withColumn("turn", F.lit(turn)))
        verdict = judged.where("linked").select(F.col("a").alias("hub"), F.col("b").alias("doc"))
        lists = written(spokes.join(verdict, ["hub", "doc"], "left_anti").select("value", "doc", "rank"), "lists")
    if not members:
        return
    # classes near to one hub meet by what they have besides it, others left in the lists by their sketches
    last = written(lists.select("doc").distinct().withColumn("left", F.lit(True)), "last")
    members = functools.reduce(DataFrame.unionAll, members).join(last, "doc", "left").withColumn("left", F.coalesce("left", F.lit(False)))
    homes = members.where("NOT linked AND left").groupBy("doc").agg(F.min(F.struct("turn", "hub")).alias("h")).select("doc", "h.*")
    others = _compared(lists, classes.join(last, "doc", "left_semi").join(homes, "doc", "left"), percent)
    pairs = written(_possible(members, percent).unionAll(others).distinct(), "across")
    if not pairs.isEmpty():
        yield _confirmed(pairs, classes, sets, percent)


def _related(judged: DataFrame) -> DataFrame:
    """(hub, doc, linked, n, inside, outside) of the classes within reach of a hub
    that has some not linked to it: with R, the hub's shingles and those that more
    than half of these classes have besides, how many shingles of R the class has,
    and its shingles outside R. ``extra`` is the number of shingles that R adds."""
    within = judged.where("gained IS NOT NULL")
    # a hub of very many classes: they stay in the deals in which they were compared
    sizes = within.groupBy("a").agg(F.count("*").alias("members"), F.count_if(~F.col("linked")).alias("near"), F.max("deals").alias("parts")).where("near > 0")
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("deal")
    within = within.join(sizes.select("a", "members", "near", part), ["a", "deal"])
    common = within.select("a", "members", F.explode("gained").alias("e")).groupBy("a", "members", "e").count().where("2 * count > members")
    added = common.groupBy("a").agg(F.collect_list("e").alias("added"))
    added = sizes.join(added, "a", "left").select("a", F.coalesce("added", F.array().cast("array<long>")).alias("added"), part)
    within = within.join(added, ["a", "deal"])
    return written(within.select(
        F.col("a").alias("hub"), F.col("b").alias("doc"), "linked", "n", "members", "near", F.size("added").alias("extra"),
        (F.col("both") + F.size(F.array_intersect("gained", "added"))).alias("inside"), F.array_except("gained", "added").alias("outside")), "related")


def _centres(related: DataFrame) -> DataFrame:
    """(hub, centre): for hubs that lack what most of a large group shares, the
    member with the fewest differences from R."""
    large = related.where("extra > 0 AND near * (members - near) > 4 * members")
    rank = F.struct(F.col("n") - 2 * F.col("inside"), "doc")
    return large.groupBy("hub").agg(F.min(rank).alias("least")).select("hub", F.col("least.doc").alias("centre"))


def _possible(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``_related`` classes that may be linked: a class not linked to
    the hub and one that is, or two that are not and are ``left`` in lists; by the
    shingles outside R that they share or, sharing none, by sizes alone."""
    def side(s: str, *more: str) -> DataFrame:
        limit = F.floor(F.col("inside") * (100 + percent) / percent) - F.col("n")
        return members.where("NOT linked" if s == "a" else "linked OR left").select(
            "turn", "hub", F.col("doc").alias(s), F.col("n").alias(f"n_{s}"), F.col("inside").alias(f"in_{s}"), limit.alias(f"limit_{s}"),
            F.col("linked").alias(f"linked_{s}"), F.col("left").alias(f"left_{s}"), *more)

    met = F.expr("a <> b AND (linked_b OR (left_a AND a < b))")
    outside = F.explode("outside").alias("e")
    shared = (side("a", outside).join(side("b", outside), ["turn", "hub", "e"]).where(met)
              .groupBy("turn", "hub", "a", "b", "n_a", "n_b", "in_a", "in_b").agg(F.count("*").alias("m")))
    both = F.least("in_a", "in_b") + F.col("m")
    shared = shared.where(both * 100 >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")
    # least(in_a, in_b) * (100 + percent) >= percent * (n_a + n_b): n_b <= limit_a and n_a <= limit_b
    sizes = side("b").select("turn", "hub", "n_b").distinct()
    fitting = side("a").join(sizes, ["turn", "hub"]).where("n_b <= limit_a")
    alike = fitting.join(side("b"), ["turn", "hub", "n_b"]).where("n_a <= limit_b").where(met).select("a", "b")
    return shared.unionAll(alike)


def _compared(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a list that the sketches leave possible, but for pairs near to
    one hub; the estimate is part of the join, so other pairs are never put out, and
    a pair comes from the smallest value whose list has both."""
    values = lists.groupBy("doc").agg(F.collect_set("value").alias("values"))
    classes = classes.join(values, "doc")

    def side(s: str) -> DataFrame:
        own = classes.select(F.col("doc").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"),
                             F.coalesce("turn", F.lit(-1)).alias(f"turn_{s}"), F.coalesce("hub", "doc").alias(f"hub_{s}"), F.col("values").alias(f"values_{s}"))
        return lists.select(F.col("value").alias(f"v_{s}"), F.col("doc").alias(s)).join(own, s)

    apart = F.expr("a < b AND (turn_a <> turn_b OR hub_a <> hub_b)")
    first = F.expr("v_a = array_min(array_intersect(values_a, values_b))")
    # the cheap tests first
    on = (F.col("v_a") == F.col("v_b")) & apart & _sizes("n_a", "n_b", percent) & first & _may_link("s_a", "s_b", "n_a", "n_b", percent)
    return side("a").join(side("b"), on).select("a", "b")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(uid, doc_id, text, tie, row), and whether ids are repeated: uid is the id if
    none is, else a number given to the rows of a written copy; row holds all columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), hashed.alias("tie"), row.alias("row"))
    if rows.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty():
        return rows.select(F.col("doc_id").alias("uid"), "*"), False
    return written(rows.select(F.monotonically_increasing_id().alias("uid"), "*"), "numbered"), True


def _labelled(numbered: DataFrame, repeated: bool, size: int, percent: int) -> DataFrame:
    """uid, doc_id, n_shingles, component_id and kept of the rows of ``_numbered``."""
    docs = numbered.select(F.when(F.col("doc_id").isNotNull(), F.col("uid")).alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        rows = written(sketches(docs, size), "sketches")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["n_shingles", "sig1", "sig2"]
    grouped = written(full.groupBy(key).agg(F.min("doc_id").alias("doc"), F.any_value("sketch").alias("sketch"), F.count("*").alias("copies")), "classes")
    links = link_classes(grouped.select("doc", F.col("n_shingles").alias("n"), "sketch"), docs, size, percent)
    label = grouped.select("doc", F.col("doc").alias("component"))
    if links is not None:
        found = components(links.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "doc")
        label = grouped.select("doc").join(found, "doc", "left").select("doc", F.coalesce("component", "doc").alias("component"))
    # copies take the component of their class; classes of one document need no join on the set
    label = written(label, "labels")
    copies = grouped.where("copies > 1").select(*key, "doc").join(label, "doc").select(*key, "component")
    copies = full.select("doc_id", *key).join(copies, key).select("doc_id", "component")
    single = grouped.where("copies = 1").select("doc").join(label, "doc").select(F.col("doc").alias("doc_id"), "component")
    if not repeated:
        out = rows.select("doc_id", "n_shingles").join(copies.unionAll(single), "doc_id", "left")
        component = F.coalesce("component", "doc_id")
        return out.select(F.col("doc_id").alias("uid"), "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    # numbers do not follow the ids: a component's row of the smallest id is found by a map-side minimum
    counts = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("uid"), "n_shingles")
    linked = copies.unionAll(single).select(F.col("doc_id").alias("uid"), "component")
    out = numbered.where("doc_id IS NOT NULL").select("uid", "doc_id", "tie").join(counts, "uid").join(linked, "uid", "left")
    out = written(out.withColumn("component", F.coalesce("component", "uid")), "numbers")
    least = out.groupBy("component").agg(F.min(F.struct("doc_id", "tie", "uid")).alias("least"))
    out = out.join(least, "component").select("uid", "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("uid") == F.col("least.uid")).alias("kept"))
    nameless = rows.where("doc_id IS NULL").select(*(F.lit(None).cast(t).alias(c) for c, t in (("uid", "long"), ("doc_id", "long"))), "n_shingles",
                                                   F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("boolean").alias("kept"))
    return out.unionAll(nameless)


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept
    (the row stands for its component), one row for each row of ``docs``."""
    check_columns(docs, id_col, text_col)
    return _labelled(*_numbered(docs.select(id_col, text_col), id_col, text_col), size, percent).drop("uid")


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id. Rows go only
    if their text is linked to that of a kept one; rows with a null id all stay."""
    check_columns(docs, id_col, text_col)
    numbered, repeated = _numbered(docs, id_col, text_col)
    found = written(_labelled(numbered, repeated, size, percent), "components")
    gone = found.where(~F.col("kept")).select("uid")
    return numbered.join(gone, "uid", "left_anti").select("row.*")
