"""Links between near-duplicate sets: buckets of equal signature bands, exact Jaccard, components.

Members of a bucket are compared with its smallest member first; what that links becomes one component. Only members of
one bucket that are then in different components are paired, and of those only pairs whose sketches agree as far as
linked sets do (small sets are compared without). So copies cost no pairs; the last step still grows with the square of
the members that share a bucket without being linked. A pair is compared once. Every link rests on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.graph import components
from shelfwise.sources.shared import broadcast_if_small, many_groups, write_shared

#: Parts of the buckets whose members are joined one part after another.
PARTS = 4
#: Parts of the bands whose buckets are counted one part after another.
HALVES = 2
#: Members of a bucket up to which they meet in one cell; more are dealt over a grid of cells.
CELL_ROWS = 2048
#: Whether Spark cuts large partitions of a join and joins every piece of one side with every piece of the other.
SKEW_JOIN = "spark.sql.adaptive.skewJoin.enabled"
#: Whether Spark makes one method of a stage; the JVM doesn't compile the one that holds the whole test of two sets.
WHOLE_STAGES = "spark.sql.codegen.wholeStage"
#: Turns the columns ``left, right`` of pairs ``a, b``, as they are stored, into arrays.
ToPairs = Callable[[DataFrame], DataFrame]
#: Turns a column of stored sets, of a row for each ``id``, into arrays; gives both columns.
ToSets = Callable[[DataFrame, str], DataFrame]
#: Whether two rows of marks, given by their prefixes, can be similar enough.
Possible = Callable[[str, str], Column]


def similar(shared: Column, left: Column, right: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, in whole numbers; the intersection, which costs, stands there once."""
    return F.lit(100 + percent) * shared >= F.lit(percent) * (left + right)


def sizes_allow(left: Column, right: Column, percent: int) -> Column:
    return F.lit(100) * F.least(left, right) >= F.lit(percent) * F.greatest(left, right)


def _of_ids(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored sets of some ids, the others not shuffled."""
    return stored.join(broadcast_if_small(ids.distinct()), "id", "left_semi")


def verified(pairs: DataFrame, stored: DataFrame, percent: int, to_pairs: ToPairs | None = None) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets, from ``stored(id, held)``, are similar enough."""
    held = _of_ids(stored, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    left = held.select(F.col("id").alias("a"), F.col("held").alias("left"))
    right = held.select(F.col("id").alias("b"), F.col("held").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    both = to_pairs(both) if to_pairs else both
    shared = F.size(F.array_intersect("left", "right"))
    linked = similar(shared, F.size("left"), F.size("right"), percent)
    # a generated column: as a plain filter the test would move below the sets' own steps and repeat them
    return both.select("a", "b", F.explode_outer(F.array(linked)).alias("linked")).filter("linked").select("a", "b")


def linked_components(
    items: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    percent: int,
    most_unequal_bits: int = 0,
    to_pairs: ToPairs | None = None,
    to_sets: ToSets | None = None,
    possible: Possible | None = None,
    marks_of: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``id, component`` of the items that are linked with another one.

    ``items(id, size, bands, sketch_a, sketch_b)``: distinct sets, the hashes of their bands (the band's number mixed
    in) and 128 signature bits. ``sets_of(ids)`` gives ``id, held`` of the asked items, ``marks_of`` these ``id`` and what
    ``possible`` looks at beside the columns of ``items``. A pair is linked when a band agrees, the marks differ no more
    than ``possible`` allows, or without it the sketches in no more than ``most_unequal_bits`` (tested in the last step), and
    100 * intersection >= ``percent`` * union.
    """
    buckets = items.select("id", F.explode("bands").alias("bucket"))
    with many_groups(items.sparkSession):
        crowds = reduce(DataFrame.unionByName, [write_shared(_crowds(items, half), "crowds") for half in range(HALVES)])
    # most buckets that are shared have two members, known by now
    more = broadcast_if_small(crowds.filter("n > 2").select("bucket", "leader", "n"))
    crowded = write_shared(buckets.join(more, "bucket"), "crowded")
    met = crowded.filter("id <> leader").select(F.col("id").alias("b"), F.col("leader").alias("a"))
    met = met.unionByName(crowds.filter("n = 2 and leader <> last").select(F.col("last").alias("b"), F.col("leader").alias("a")))
    met = write_shared(met.groupBy("b", "a").agg(F.count(F.lit(1)).alias("bands")), "met")
    asked = write_shared(met.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
    stored = write_shared(sets_of(broadcast_if_small(asked)), "sets")
    marks = items.select("id", "size", "bands", "sketch_a", "sketch_b")
    if possible and marks_of:
        marks = _of_ids(items, asked).join(broadcast_if_small(write_shared(marks_of(stored), "counts")), "id")
        marks = write_shared(marks, "marks")
        met = write_shared(_possible_pairs(met, marks.drop("bands"), possible), "met")

    # the leader met in most bands first, then the other leaders, then the rest
    first = met.groupBy("b").agg(F.max(F.struct("bands", (-F.col("a")).alias("a"))).alias("best"))
    first = write_shared(first.select((-F.col("best.a")).alias("a"), "b"), "first")
    links = write_shared(verified(first, stored, percent, to_pairs), "links")
    found = write_shared(components(links), "found")

    # what the other leaders link, then what other members of a bucket link between components
    for step in ("leaders", "members"):
        if step == "leaders":
            others = met.select("a", "b").join(broadcast_if_small(first), ["a", "b"], "left_anti")
            more = verified(write_shared(_apart(others, found), "apart"), stored, percent, to_pairs)
        else:
            more = _links_between(crowded, marks, found, stored, percent, most_unequal_bits, to_sets, possible)
        more = write_shared(more, "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            found = write_shared(components(links), "found")
    return found


def _crowds(items: DataFrame, half: int) -> DataFrame:
    """``bucket, leader, last, n`` of the buckets that items share, for some of the bands: their smallest and largest member."""
    start, end = (F.expr(f"size(bands) * {h} div {HALVES}").cast("int") for h in (half, half + 1))
    buckets = items.select("id", F.explode(F.slice("bands", start + 1, end - start)).alias("bucket"))
    ends = [F.min("id").alias("leader"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")]
    return buckets.groupBy("bucket").agg(*ends).filter("n > 1")


def _possible_pairs(pairs: DataFrame, marks: DataFrame, possible: Possible) -> DataFrame:
    """Those of ``pairs(a, b, ...)`` whose marks don't rule a link out."""
    marks = broadcast_if_small(marks)
    x, y = marks.alias("x"), marks.alias("y")
    both = pairs.alias("p").join(x, F.col("p.a") == F.col("x.id")).join(y, F.col("p.b") == F.col("y.id"))
    return both.filter(possible("x", "y")).select("p.*")


def _component(ids: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    named = found.select(F.col("id").alias(key), F.col("component").alias(name))
    return ids.join(named, key, "left").withColumn(name, F.coalesce(name, key))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    both = _component(_component(pairs, found, "a", "component_a"), found, "b", "component_b")
    return both.filter("component_a <> component_b").select("a", "b")


def _links_between(
    crowded: DataFrame,
    marks: DataFrame,
    found: DataFrame,
    stored: DataFrame,
    percent: int,
    most_unequal_bits: int,
    to_sets: ToSets | None,
    possible: Possible | None,
) -> DataFrame:
    """Links within a bucket between different components, its leader aside.

    The join's condition holds the whole test, so only links leave it: components, sizes and sketches first, then that
    this is the first bucket which the two share, the full sets last. With ``possible``, members that it rules out with
    every other one of their bucket go before. Members meet in cells of bounded size, so that Spark has no partition to
    cut: with full sets in its rows a bucket has many pieces, and pieces meet in pairs, a task each.
    """
    placed = _component(crowded.filter("n > 2 and id <> leader").select("bucket", "id"), found, "id", "component")
    lowest, highest, members = F.min("component"), F.max("component"), F.count(F.lit(1))
    split = placed.groupBy("bucket").agg(lowest.alias("low"), highest.alias("high"), members.alias("n"))
    split = split.filter("low <> high").select("bucket", F.ceil(F.col("n") / F.lit(CELL_ROWS)).cast("int").alias("cells"))
    placed = write_shared(placed.join(split, "bucket"), "placed")
    spark = placed.sparkSession
    before, stages = spark.conf.get(SKEW_JOIN, "true"), spark.conf.get(WHOLE_STAGES, "true")
    spark.conf.set(SKEW_JOIN, "false")
    try:
        if possible and to_sets:
            placed = write_shared(_with_partners(placed, marks.drop("bands"), possible), "partners")
            held = write_shared(_of_ids(stored, placed.select("id")).withColumnRenamed("held", "members"), "members")
            spark.conf.set(WHOLE_STAGES, "false")
            links = []
            for part in range(PARTS):
                p = placed.filter(F.pmod("bucket", F.lit(PARTS)) == part)
                full = to_sets(_of_ids(held, p.select("id")), "members")
                p = p.join(_of_ids(marks, p.select("id")), "id").join(full, "id")
                links.append(write_shared(_links_in(p, percent, possible), "links"))
        else:
            held = _of_ids(stored, placed.select("id")).withColumnRenamed("held", "members")
            placed = write_shared(placed.join(_of_ids(marks, placed.select("id")).join(held, "id"), "id"), "placed")
            # written as they are stored: full sets are larger, and only a part of them is shuffled at a time
            parts = [placed.filter(F.pmod("bucket", F.lit(PARTS)) == part) for part in range(PARTS)]
            links = [write_shared(_links_in(p, percent, unequal_bits(percent, most_unequal_bits)), "links") for p in parts]
    finally:
        spark.conf.set(SKEW_JOIN, before)
        spark.conf.set(WHOLE_STAGES, stages)
    return reduce(DataFrame.unionByName, links)


def _with_partners(placed: DataFrame, marks: DataFrame, possible: Possible) -> DataFrame:
    """The rows of ``placed`` that can be linked with a member of their bucket in another component."""
    dealt = _dealt(placed.join(_of_ids(marks, placed.select("id")), "id"))
    x, y = dealt.alias("x"), dealt.alias("y")
    met = _in_one_cell() & (F.col("x.component") != F.col("y.component")) & possible("x", "y")
    return x.join(y, met, "left_semi").select(*placed.columns).dropDuplicates(["bucket", "id"])


def _dealt(placed: DataFrame) -> DataFrame:
    """``placed`` with ``slot`` and ``cell``: a row stands in the cell of its slot with each slot of its bucket."""
    slot = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int").alias("slot")
    dealt = placed.select("*", slot, F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    return dealt.withColumn("cell", _cell(F.col("slot"), F.col("other"), F.col("cells"))).drop("other")


def _cell(left: Column, right: Column, cells: Column) -> Column:
    return F.least(left, right).cast("long") * cells + F.greatest(left, right)


def _in_one_cell() -> Column:
    return (
        (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.cell") == F.col("y.cell"))
        & (_cell(F.col("x.slot"), F.col("y.slot"), F.col("x.cells")) == F.col("x.cell"))
    )


def unequal_bits(percent: int, most: int) -> Possible:
    """At most so many unequal bits of two sketches, and sizes that allow a link."""

    def possible(x: str, y: str) -> Column:
        bits = [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in ("sketch_a", "sketch_b")]
        return (bits[0] + bits[1] <= most) & sizes_allow(F.col(f"{x}.size"), F.col(f"{y}.size"), percent)

    return possible


def _links_in(placed: DataFrame, percent: int, possible: Possible) -> DataFrame:
    """Links between the members of each bucket, every pair of them in one cell."""
    placed = _dealt(placed)
    x, y = placed.alias("x"), placed.alias("y")
    first_met = F.get(F.array_intersect("x.bands", "y.bands"), F.lit(0)) == F.col("x.bucket")
    shared = F.size(F.array_intersect("x.members", "y.members"))
    linked = similar(shared, F.size("x.members"), F.size("y.members"), percent)
    condition = (
        _in_one_cell()
        & (F.col("x.component") < F.col("y.component"))
        & F.when(possible("x", "y"), F.when(first_met, linked).otherwise(False)).otherwise(False)
    )
    return x.join(y, condition).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
