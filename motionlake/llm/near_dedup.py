"""Near-duplicate documents by Order MinHash, verified by banded alignment.

1. Documents are reduced to word hashes; equal word sequences form one class by an aggregate, and only its least id
   goes on.
2. A bucket holds the documents that agree in a sketch. In each bucket all members are aligned with the least one (a
   star), and those within the threshold are linked. After that only pairs from different components of the links
   count, as others join nothing new.
3. In buckets that still hold several components, every pair from two of them is aligned, whatever the size of the
   bucket: large ones are dealt over blocks of BLOCK members. Of two components one pair is tried first. The only pairs
   that are left out are those that a lower bound of the edits (lengths, then bags of words) puts beyond the threshold.
4. Classes are the connected components of all links, by least-id propagation with written rounds.

Similarity is 1 - word edits / words of the longer text; two documents of a class are joined by links of at least
``similarity``. A class is named by its least doc_id.

Edge cases: documents without words (null, empty, only punctuation) and rows without an id stay alone; repeated rows are
one class; if an id has several texts, its classes are one class, and near copies are sought of one of them; fewer than five words make a single shingle; an empty
table gives no rows; other columns are ignored by ``classes`` and passed on by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order_minhash
from .common import forget, release, sheltered, written

SIMILARITY = 0.8
#: Members of a bucket whose pairs come from a join; those of larger ones come from blocks of about BLOCK members each.
SMALL = 16
BLOCK = 4096
#: One in so many buckets, whose stars are aligned before all others.
FIRST = 8
#: Bins that the bags of words are folded to for a first look.
COARSE_BINS = 64

NOT_WORD = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")
    return F.transform(words, lambda w: F.hash(w))


def sketches(docs: DataFrame, text: str, key: str) -> DataFrame:
    """id, k1 and k2 (equal for equal word sequences), n (words), sketch and bag (of words) of every row."""
    schema = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64())), ("bag", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lo = 0
            sizes_all = whole.column(3).to_numpy()
            while lo < whole.num_rows:  # slices of bounded size
                hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes_all[lo:]), order_minhash.SLICE_WORDS)))
                part = whole.slice(lo, hi - lo)
                words = part.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                found, counts = order_minhash.sketch_lists(words, sizes_all[lo:hi])
                rows = pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), pa.array(found))
                bags = pa.array([b.tobytes() for b in order_minhash.bags(words, sizes_all[lo:hi])], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], rows, bags], schema=schema)
                lo = hi
        release()

    words = docs.select(F.col(key).cast("long").alias("id"), word_hashes(F.col(text)).alias("w"))
    rows = words.select("id", F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(1), "w").alias("k2"), F.size("w").cast("long").alias("n"), "w")
    return rows.mapInArrow(run, "id long, k1 long, k2 long, n long, sketch array<long>, bag binary")


def bag_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), order_minhash.BINS)


def plausible(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that no lower bound of the edits puts beyond the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.maximum(batch.column(2).to_numpy(), batch.column(4).to_numpy())
            near = order_minhash.bag_edits(bag_rows(batch.column(3)), bag_rows(batch.column(5))) <= (1 - similarity) * n + 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(near))

    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bag").alias("ba"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bag").alias("bb"))
    both = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    return both.select("a", "b", "na", "ba", "nb", "bb").mapInArrow(run, "a long, b long")


def block_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: the plausible pairs of different labels in the buckets of members (bucket, size, id, label, mine, n, bag).

    A bucket is cut into blocks by hash; each two blocks meet in a group of their own. mine are all buckets of the id, in
    order: a pair comes out of the least of those that it shares only.
    """

    def run(group: pa.Table) -> pa.Table:
        g = group.combine_chunks()
        of = lambda name: g.column(name).to_numpy()
        ids, labels, n, bags = of("id"), of("label"), of("n"), bag_rows(g.column("bag"))
        own, i, j, bucket = of("block"), of("i")[0], of("j")[0], of("bucket")[0]
        sizes = pc.list_value_length(g.column("mine")).to_numpy()
        mine = np.full((len(sizes), sizes.max()), np.iinfo(np.int64).min)
        mine[np.arange(mine.shape[1]) < sizes[:, None]] = pc.list_flatten(g.column("mine")).to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        right = right[np.argsort(n[right], kind="stable")]
        coarse = bags.reshape(len(bags), -1, order_minhash.BINS // COARSE_BINS).sum(axis=2, dtype=np.int32)
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for x in left:
            lo, hi = np.searchsorted(n[right], [similarity * n[x] - 1e-9, n[x] / similarity + 1e-9])
            other = right[lo : hi + 1]
            other = other[(labels[other] != labels[x]) & ((ids[other] > ids[x]) if i == j else True)]
            for kind in (coarse, bags):  # most pairs fall to the cheaper bound
                other = other[order_minhash.bag_edits(kind[x], kind[other]) <= (1 - similarity) * np.maximum(n[x], n[other]) + 1e-9]
            if len(other):  # the first of the other's buckets that both have
                shared = np.isin(mine[other], mine[x][: sizes[x]]).argmax(axis=1)
                other = other[mine[other, shared] == bucket]
                a.append(np.minimum(ids[x], ids[other]))
                b.append(np.maximum(ids[x], ids[other]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    rows = members.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return rows.select("bucket", "i", "j", "block", "id", "label", "mine", "n", "bag").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def align(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b, edits (null beyond the threshold), na and nb."""
    slack = 1 - similarity
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edits", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits, na, nb = [], [], []
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = (np.asarray(c[i].values.to_numpy(zero_copy_only=False), dtype=np.int64) for c in (left, right))
                edits.append(order_minhash.edit_distance(x, y, int(slack * max(len(x), len(y)) + 1e-9)))
                na.append(len(x))
                nb.append(len(y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (edits, na, nb))], schema=schema)
        release()

    left = texts.select(F.col("id").alias("a"), F.col("w").alias("wa"))
    right = texts.select(F.col("id").alias("b"), F.col("w").alias("wb"))
    # Pairs cost far more than their bytes: merge joins deal them evenly, which a broadcast to the files of texts doesn't.
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "wa", "wb")
    return both.mapInArrow(run, "a long, b long, edits long, na long, nb long")


def is_link(similarity: float) -> Column:
    return F.col("edits").isNotNull() & (F.col("edits") <= (1 - similarity) * F.greatest("na", "nb") + 1e-9)


def linked(docs: DataFrame, reps: DataFrame, text: str, key: str, similarity: float, tell: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """Of representatives (id, k1, n, sketch, bag): a, b, the verified links, if they are to be told; pairs that others join may be
    missing. And id, label: the components of the links."""
    members = reps.select(F.explode("sketch").alias("bucket"), "id")
    shared = members.groupBy("bucket").count().where("count > 1").select("bucket")
    members = written(members.join(shared, "bucket"), "members")
    need = reps.select("id", "k1").join(members.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("need"), "k1")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).join(need, F.col("id") == F.col("need"))
    rows = rows.select("id", "k1", word_hashes(F.col("t")).alias("w")).where(F.xxhash64("w") == F.col("k1"))
    texts = written(rows.dropDuplicates(["id"]).select("id", "w"), "texts")
    reps = reps.select("id", "n", "bag")

    def aligned(pairs: DataFrame, label: str) -> DataFrame:
        return written(align(pairs, texts, similarity), label)

    def untried(pairs: DataFrame) -> DataFrame:
        return pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")

    # The first sketches join most copies; after that a bucket counts only if it holds several components.
    first = star_pairs(members.where(F.pmod("bucket", F.lit(FIRST)) == 0).withColumn("label", F.col("id"))).distinct()
    known = aligned(plausible(first, reps, similarity), "first")
    labels = components(known.where(is_link(similarity)))
    rows = labelled(members, labels, "id", "label")
    mixed = written(rows.join(mixed_buckets(rows), "bucket").select("bucket", "id", "label"), "mixed")
    forget(members)
    members = mixed
    stars = aligned(untried(plausible(star_pairs(members).distinct(), reps, similarity)), "stars")
    gone = [known, stars]
    known, labels = written(known.unionByName(stars), "known"), merged(labels, stars.where(is_link(similarity)))

    # What still is in different components of a bucket is settled pair by pair.
    rows = labelled(members.select("bucket", "id"), labels, "id", "label")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("label").alias("first"), F.max("label").alias("last")).where("first != last")
    rest = written(rows.join(sizes.select("bucket", "size"), "bucket"), "rest")
    small = rest.where(F.col("size") <= SMALL).select("bucket", "id", "label")
    close = small.toDF("bucket", "a", "la").join(small.toDF("bucket", "b", "lb"), "bucket").where("a < b AND la != lb").select("a", "b").distinct()
    large = rest.where(F.col("size") > SMALL)
    large = block_pairs(large.join(large.groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("mine")), "id").join(reps, "id"), similarity)
    open_pairs = untried(plausible(close, reps, similarity).unionByName(large).distinct())
    open_pairs = written(labelled(labelled(open_pairs, labels, "a", "la"), labels, "b", "lb"), "open")
    tried = open_pairs.groupBy(F.least("la", "lb"), F.greatest("la", "lb")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
    tried = aligned(tried, "tried")
    gone += [known, tried]
    known, labels = written(known.unionByName(tried), "known"), merged(labels, tried.where(is_link(similarity)))
    left = labelled(labelled(untried(open_pairs.select("a", "b")), labels, "a", "la"), labels, "b", "lb").where("la != lb")
    settled = aligned(left.select("a", "b"), "settled")
    labels = merged(labels, settled.where(is_link(similarity)))
    links = written(known.unionByName(settled).where(is_link(similarity)).select("a", "b"), "links") if tell else None
    forget(*gone, known, settled, members, texts, rest, open_pairs)
    return links, labels


def star_pairs(members: DataFrame) -> DataFrame:
    """a, b: the least id of each bucket and the other ids, of members (bucket, id, label), that have another label."""
    leaders = members.groupBy("bucket").agg(F.min(F.struct("id", "label")).alias("l"))
    return members.join(leaders, "bucket").where(F.col("label") != F.col("l.label")).select(F.col("l.id").alias("a"), F.col("id").alias("b"))


def mixed_buckets(members: DataFrame) -> DataFrame:
    """Buckets whose members have more than one label."""
    return members.groupBy("bucket").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first != last").select("bucket")


def labelled(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """rows and the component of the id in key; an id without links is its own."""
    own = labels.select(F.col("id").alias("__id"), F.col("label").alias("__label"))
    return rows.join(own, F.col(key) == F.col("__id"), "left").withColumn(name, F.coalesce("__label", key)).drop("__id", "__label")


def components(edges: DataFrame) -> DataFrame:
    """id, label: the least id that each id of the edges (a, b) is connected to."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("further"))
        step = step.join(jump, F.col("label") == F.col("via"), "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        step = written(step, "labels")
        forget(labels)
        labels = step.select("id", "label")
        if step.where("old != label").isEmpty():
            forget(both)
            return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (id, label) once the edges (a, b) are in: only the components that they join are looked at again."""
    new = labelled(labelled(edges.select("a", "b"), labels, "a", "la"), labels, "b", "lb").where("la != lb")
    more = components(new.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    moved = labels.join(more.select(F.col("id").alias("__from"), F.col("label").alias("__to")), F.col("label") == F.col("__from"), "left")
    alone = more.join(labels.select("id"), "id", "left_anti")
    found = written(moved.select("id", F.coalesce("__to", "label").alias("label")).unionByName(alone), "labels")
    forget(labels, more)
    return found


def classes(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of docs: key, class_id (null without a key), n_words and n_rows (rows that have the key)."""
    rows = written(sketches(docs, text, key), "sketches")
    some = rows.where(F.col("id").isNotNull() & (F.col("n") > 0))
    least = some.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    mine = written(some.join(least, ["k1", "k2"]).select("id", "rep").distinct(), "exact")
    one = least.groupBy("rep").agg(F.min(F.struct("k1", "k2")).alias("k")).select("rep", F.col("k.k1").alias("r1"), F.col("k.k2").alias("r2"))
    # Both sides meet by id alone, so dropDuplicates needs no further shuffle.
    same = F.col("k1").bitwiseXOR(F.col("r1")).bitwiseOR(F.col("k2").bitwiseXOR(F.col("r2"))) == 0
    reps = some.join(one, (F.col("id") == F.col("rep")) & same, "left_semi")
    reps = written(reps.dropDuplicates(["id"]).select("id", "k1", "n", "sketch", "bag"), "reps")
    first = mine.groupBy("id").agg(F.min("rep").alias("a"), F.count("*").alias("texts"))
    several = mine.join(first.where("texts > 1"), "id").select("a", F.col("rep").alias("b")).where("a != b")
    labels = merged(linked(docs, reps, text, key, similarity)[1], several)
    label_of = first.join(labels.select(F.col("id").alias("a"), "label"), "a", "left").select(F.col("id").alias("lid"), F.coalesce("label", "a").alias("label"))
    counts = rows.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("cid")).agg(F.count("*").alias("n_rows"))
    named = rows.select("id", "n").join(label_of, F.col("id") == F.col("lid"), "left").join(counts, F.col("id") == F.col("cid"), "left")
    return named.select(F.col("id").alias(key), F.coalesce("label", "id").alias("class_id"), F.col("n").alias("n_words"), F.coalesce("n_rows", F.lit(1)).cast("long").alias("n_rows"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each class, the one of the least id, with all columns; rows without an id stay."""

    def work(docs: DataFrame) -> DataFrame:
        found = classes(docs, similarity, text, key)
        gone = found.where(F.col("class_id") != F.col(key)).select(F.col(key).alias("__gone")).distinct()
        left = docs.join(gone, F.col(key) == F.col("__gone"), "left_anti")
        twice = found.where("n_rows > 1").select(F.col(key).alias("__twice")).distinct()
        if twice.isEmpty():
            return left
        once = left.join(twice, F.col(key) == F.col("__twice"), "left_anti")
        again = left.join(twice, F.col(key) == F.col("__twice"), "left_semi").withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(text)))
        return once.unionByName(again.where("__k = 1").drop("__k"))

    return sheltered(work, docs)
