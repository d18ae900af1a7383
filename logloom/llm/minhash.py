"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import textbatch as tb
from logloom.llm.graph import components
from logloom.llm.shared import unused, written

_GOLDEN = 0x9E3779B97F4A7C15
_EMPTY = np.uint64(2**64 - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, sorted within a row, and their rows."""
    start, end, row = tb.words(data, offsets, tb.NOT_SPACE)
    word = tb.word_hashes(data, start, end, folded=True)
    grams = tb.gram_hashes(word, k)
    full = row[: len(grams)] == row[k - 1 : k - 1 + len(grams)]
    hashes, rows = [grams[full]], [row[: len(grams)][full]]
    counts = tb.row_counts(row, len(offsets) - 1)
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            total = np.full(len(short), n * _GOLDEN % 2**64, np.uint64)
            for j in range(n):
                total = tb.mixed(total ^ word[first[short] + j])
            hashes.append(total)
            rows.append(short)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def sketches(h: np.ndarray, r: np.ndarray, rows: int, t: int) -> np.ndarray:
    """Fast similarity sketching: t coordinates for each row from the hashes of its set.

    Round i throws every element of a set with empty bins into one of the t bins; a bin keeps the least
    (round, value). From round t on, round i throws all into bin i - t, so after 2 t rounds none is empty;
    a set of n elements is full after about t log t / n rounds. Coordinates of two sets agree with the
    probability of their similarity, as concentrated as with full MinHash. Empty sets keep empty bins.
    """
    out = np.full(rows * t, _EMPTY, np.uint64)
    live = np.ones(len(h), bool)
    for i in range(2 * t):
        x, of = (h, r) if i == 0 else (h[live], r[live])
        if len(x) == 0:
            break
        v = tb.mixed(x + np.uint64((i + 1) * _GOLDEN % 2**64))
        # The bin comes from the high bits, the value from the low ones.
        where = ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(v), i - t)
        value = (tb.mixed(v) >> np.uint64(16)) | (np.uint64(i) << np.uint64(48))
        np.minimum.at(out, of * t + where, value)
        if i >= 1 or len(h) < 4 * t * rows:
            open_rows = (out.reshape(rows, t) == _EMPTY).any(axis=1)
            live = open_rows[r]
    return out.reshape(rows, t)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows with the shingle sets of their texts; a long text is worked off in parts."""
    for batch, data, offsets in tb.slices(batches):
        if len(data) <= tb.SLICE_BYTES:
            yield batch, *shingle_sets(data, offsets, k)
        else:
            found = np.zeros(0, np.uint64)
            for a, b in tb.long_parts(data, tb.NOT_SPACE, tb.SLICE_BYTES, k - 1):
                found = np.union1d(found, shingle_sets(data[a:b], np.array([0, b - a]), k)[0])
            yield batch, found, np.zeros(len(found), np.int64)


_SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"


def _sketched(doc_id: pa.Array, h: np.ndarray, r: np.ndarray, bands: int, width: int) -> pa.RecordBatch:
    """The sketch rows of the sets that hold h, by their rows r."""
    n, t = len(doc_id), bands * width
    counts = tb.row_counts(r, n)
    names = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    filled = np.flatnonzero(counts)
    if len(h):
        at = np.searchsorted(r, filled)
        for name, salt in zip(names, (0x5851F42D4C957F2D, 0x14057B7EF767814F), strict=True):
            name[filled] = np.add.reduceat(tb.mixed(h ^ np.uint64(salt)), at)
    s = sketches(h, np.searchsorted(filled, r), len(filled), t).reshape(len(filled), bands, width)
    key = np.zeros((len(filled), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
    for j in range(width):
        key = tb.mixed(key + s[:, :, j])
    edges = np.concatenate(([0], np.cumsum(np.where(counts > 0, bands, 0)))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(key.reshape(-1).view(np.int64)))
    return pa.RecordBatch.from_arrays([doc_id, pa.array(counts), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), lists], ["doc_id", "n_shingles", "s1", "s2", "bands"])


def _sketch_table(docs: DataFrame, k: int, bands: int, width: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (128 bits that name the set), bands (a hash for each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, r in _sets(batches, k):
            yield _sketched(batch.column("doc_id"), h, r, bands, width)

    return docs.mapInArrow(run, _SKETCH)


def _sketch_of_sets(sets: DataFrame, bands: int, width: int) -> DataFrame:
    """The rows of _sketch_table() for doc_id and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                column = batch.column("set")
                h = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                r = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
                yield _sketched(batch.column("doc_id"), h, r, bands, width)

    return sets.select("doc_id", "set").mapInArrow(run, _SKETCH)


def _set_table(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and set (array of long): the full shingle set of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, r in _sets(batches, k):
            edges = np.searchsorted(r, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges), pa.array(h.view(np.int64)))], ["doc_id", "set"])

    return docs.mapInArrow(run, "doc_id long, set array<long>")


def _united(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and set: the union of the shingle sets of all rows of a document."""
    each = _set_table(docs.dropDuplicates(["doc_id", "text"]), k).select("doc_id", F.explode_outer("set").alias("s"))
    return each.groupBy("doc_id").agg(F.collect_set("s").alias("set"))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, shared: sizes of the full sets of each pair and of their intersection."""
    b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b")
    both = b.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
    sizes = (F.size(x).cast("long").alias(y) for x, y in (("set_a", "na"), ("set_b", "nb")))
    return both.select("a", "b", *sizes, F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("shared"))


def _linked(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))


def _labelled(groups: DataFrame, links: DataFrame) -> DataFrame:
    """pivot, rep, component, home of groups, for the pivots whose members aren't all of one component by the links
    so far; home is the group's largest component."""
    label = components(links).select(F.col("node").alias("rep"), "component")
    groups = groups.select("pivot", "rep").join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = groups.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("n"))
    homes = sizes.groupBy("pivot").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("home"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    return groups.join(homes, "pivot").select("pivot", "rep", "component", "home")


def _differences(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pivot, rep, n, d, nd, a: the size of a member's set, its symmetric difference d from the pivot's, with its size
    nd, and a = (100 + percent) nd - (100 - percent) n."""
    held = groups.select("pivot", "rep").join(sets.select(F.col("doc_id").alias("rep"), F.col("set").alias("mine")), "rep").join(sets.select(F.col("doc_id").alias("pivot"), "set"), "pivot")
    differing = F.array_union(F.array_except("mine", "set"), F.array_except("set", "mine"))
    held = held.select("pivot", "rep", F.size("mine").cast("long").alias("n"), differing.alias("d")).withColumn("nd", F.size("d").cast("long"))
    return held.withColumn("a", (100 + percent) * F.col("nd") - (100 - percent) * F.col("n"))


#: Bands, and coordinates of each, of the second sketch: members of a group by what they differ in from the pivot.
NEAR_BANDS, NEAR_WIDTH = 32, 3


def _near_pairs(groups: DataFrame, differences: DataFrame) -> DataFrame:
    """a, b: members of one pivot, of different components, with the first of a band of the sketches of their
    differences; NEAR_BANDS pairs for each member and pivot at most. Two that are linked have many differences in
    common, others of their group few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                column = batch.column("d")
                h = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                r = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
                bands = _sketched(batch.column("rep"), h, r, NEAR_BANDS, NEAR_WIDTH).column("bands")
                yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("rep"), bands], ["pivot", "rep", "bands"])

    banded = differences.filter("nd > 0").select("pivot", "rep", "d").mapInArrow(run, "pivot long, rep long, bands array<long>")
    each = written(banded.join(groups.select("pivot", "rep", "component"), ["pivot", "rep"]).select("pivot", "rep", "component", F.explode("bands").alias("band")), "near")
    first = each.groupBy("pivot", "band").agg(F.min(F.struct("rep", "component")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = each.join(first.select("pivot", "band", F.col("f.rep").alias("first"), F.col("f.component").alias("of")), ["pivot", "band"]).filter("component <> of")
    return pairs.select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()


def _differing_pairs(groups: DataFrame, sets: DataFrame, percent: int, differences: DataFrame | None = None) -> DataFrame:
    """a, b: pairs of members (rep) of one pivot, of different components, that may be linked; exact. differences:
    those of the groups, if they are known already.

    With D the symmetric difference of a set and its pivot's, two sets of x and y elements are linked if and
    only if 2 (100 + percent) |Dx & Dy| >= Ax + Ay, where A = (100 + percent) |D| - (100 - percent) |set|.
    So D is put in an order with the elements first that members of one component alone have, then by
    rarity. If the first common element of two linked members stands at place i of one, then
    Ax + Ay <= 2 (100 + percent) (|Dx| - i): each place has a cap on its partner's A. Elements that can have
    no partner under their caps, by the least A and largest cap of all who have them, drop out before the
    join, so edits that nobody shares, and the pivot's own, which everybody shares, give no pairs.
    Of two members of different components one at least isn't linked to the pivot, so Ax + Ay > 0 and linked
    members do have a common element. One at least isn't of the group's home, and only those (out) look for partners.
    """
    both = 100 + percent
    differences = _differences(groups, sets, percent) if differences is None else differences
    held = groups.select("pivot", "rep", "component", (F.col("component") != F.col("home")).alias("out"))
    held = written(held.join(differences, ["pivot", "rep"]), "differing")
    least = held.groupBy("pivot").agg(F.min("a").alias("floor"))
    each = held.select("pivot", "rep", "component", "out", "nd", "a", F.explode("d").alias("s"))
    common = each.groupBy("pivot", "s").agg(F.count(F.lit(1)).alias("df"), (F.min("component") != F.max("component")).alias("mixed"))
    ranked = each.join(common, ["pivot", "s"]).groupBy("pivot", "rep", "component", "out", "nd", "a").agg(F.array_sort(F.collect_list(F.struct("mixed", "df", "s"))).alias("all"))
    ranked = ranked.select("pivot", "rep", "component", "out", "nd", "a", F.posexplode("all").alias("i", "x")).filter("x.mixed")
    ranked = ranked.select("pivot", "rep", "component", "out", "a", (2 * both * (F.col("nd") - F.col("i")) - F.col("a")).alias("cap"), "x.s")
    ranked = written(ranked.join(least, "pivot").filter("cap >= floor").drop("floor"), "ranked")
    outside = F.col("out")
    partners = ranked.groupBy("pivot", "s").agg(
        F.min("a").alias("least"),
        F.max("cap").alias("most"),
        F.min(F.when(outside, F.col("a"))).alias("least_out"),
        F.max(F.when(outside, F.col("cap"))).alias("most_out"),
    )
    meets = F.when(outside, (F.col("cap") >= F.col("least")) & (F.col("a") <= F.col("most"))).otherwise((F.col("cap") >= F.col("least_out")) & (F.col("a") <= F.col("most_out")))
    some = written(ranked.join(partners.filter("least_out is not null"), ["pivot", "s"]).filter(meets).select("pivot", "s", "rep", "component", "out", "a", "cap"), "meeting")
    left = some.filter("out").select("pivot", "s", "rep", "component", "a", "cap")
    right = some.select("pivot", "s", *(F.col(c).alias(f"{c}_b") for c in ("rep", "component", "out", "a", "cap")))
    pairs = left.join(right, ["pivot", "s"]).filter("component <> component_b and a <= cap_b and a_b <= cap and (not out_b or rep < rep_b)")
    return pairs.select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, width: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    A set holds the distinct k-word shingles of a whole text (words between ASCII white space, A-Z in lower
    case; fewer words are one shingle, none the empty set). Documents are linked when
    100 * |intersection| >= percent * |union| on the full sets; component_id is the least doc_id that links
    reach; kept is doc_id = component_id. Empty sets are linked with nothing. Rows without doc_id take no
    part and have neither component nor a false kept. Rows that repeat a doc_id are one node, with the union
    of their sets if their texts differ, and stay or go together. Other columns are not read; no rows in, no rows out.

    Sets that are equal are one class (by a pre-aggregated key). Class representatives meet in `bands`
    buckets; in a bucket all are compared with one pivot, the member that shares most buckets, so a pivot's
    group are the members of its buckets. Where a group isn't one component yet, a second sketch of what members
    differ in from their pivot links most of them in a number of pairs that grows with the members (_near_pairs);
    for those outside the group's largest component an exact filter (_differing_pairs) gives all other pairs. So no bucket is capped, none
    emits all its pairs, and no link between different components is lost that shares a band: a pair at the
    threshold of 80 % (85 %) shares none of 32 bands of 4 with probability 5e-8 (6e-11).
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    repeated = written(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("copies")).filter("copies > 1"), "repeated")
    united = None
    if not repeated.isEmpty():
        united = written(_united(docs.join(repeated, "doc_id", "left_semi"), k), "united")
        docs = docs.join(repeated, "doc_id", "left_anti")
    table = _sketch_table(docs, k, bands, width)
    if united is not None:
        copies = repeated.select("doc_id", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        table = table.unionByName(_sketch_of_sets(united, bands, width).join(copies.select("doc_id"), "doc_id"))
    table = written(table, "sketch")
    classes = table.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    members = classes.select("rep", F.explode("bands").alias("band"))
    crowded = members.groupBy("band").agg(F.count("rep").alias("n")).filter("n > 1")
    members = members.join(crowded, "band")
    weight = members.groupBy("rep").agg(F.sum("n").alias("weight"))
    members = written(members.select("band", "rep").join(weight, "rep"), "members")
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = _set_table(docs.join(needed, "doc_id", "left_semi"), k)
    if united is not None:
        sets = sets.unionByName(united.join(needed, "doc_id", "left_semi"))
    sets = written(sets, "sets")
    pivots = members.groupBy("band").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("pivot"))
    groups = written(members.join(pivots, "band").filter("rep <> pivot").select("pivot", "rep").distinct(), "groups")
    near = _measured(groups.select(F.col("pivot").alias("a"), F.col("rep").alias("b")), sets).filter(_linked(percent))
    links = written(near.select("a", "b"), "links")
    # A member that shares hardly anything with the pivot may still be near another member: all go on.
    apart = written(_labelled(groups, links), "apart")
    differences = written(_differences(apart, sets, percent), "differences")
    near = _measured(_near_pairs(apart, differences), sets).filter(_linked(percent))
    links = written(links.unionByName(near.select("a", "b")), "links")
    # By now nearly all that belongs together is: what is compared with all others of its group is what is left over.
    apart = written(_labelled(apart, links), "apart")
    last = _measured(_differing_pairs(apart, sets, percent, differences), sets).filter(_linked(percent)).select("a", "b")
    labels = components(links.unionByName(last))
    class_of = classes.select("n_shingles", "s1", "s2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    class_of = class_of.select("n_shingles", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = table.drop("bands").join(class_of, ["n_shingles", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document is kept by near_duplicates(); all columns stay, whatever their names. Rows
    without doc_id stay, and rows that repeat one go or stay together; no rows in, no rows out."""
    (name,) = unused(docs, "gone")
    gone = near_duplicates(docs, k, percent).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
