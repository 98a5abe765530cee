"""Problem 4: records that are alike but for small edits.

Chunks. Rows of equal text are one class, named by a 64-bit hash. A class's distinct sequences of
``SHINGLE`` words give (a) bands of minimum hashes, an index whose equal keys propose pairs, and (b)
a fingerprint of ``BITS`` bits and its row in the pivot table.

The references of the pivot table are all unions of ``PARTS`` disjoint sets of bits, so there are
2 ** PARTS of them. The Hamming distances to all are determined by the numbers of bits held in the
parts, so these are what is stored, and the maximum difference over all references is the sum of
the differences of these numbers. For any two fingerprints the difference of a coordinate is at most
their Hamming distance, and that is at most the number of sequences only one of them holds, so a
pair of similarity t cannot differ by more than (1 - t) / (1 + t) * (a + b) in any coordinate: such
pairs are discarded without loss. Survivors are verified exactly on the texts.

A pivot table says which pairs cannot be alike; to propose pairs with it alone all would have to be
compared with all. The index does that, as an equi-join; two of ``BANDS`` bands must agree. At the
threshold of 0.6 a pair fails this with a probability of 2e-4, at 0.65 with 2e-6. With ``exact``
pairs come from a prefix filter instead, which loses none: similar texts share one of the first
n - ceil(t * n) + 1 sequences in any one order of all sequences. Its cost grows with the square
of the collection where texts are made from the same sentences, so it is not the default.

Subjects. Edit distance is a metric too: distances to reference strings are the coordinates, the
grid cells of the first few propose pairs (neighbouring cells are met by an explode, so this is
exact), the maximum difference over all discards, and the edit distance verifies.

Null and empty texts and texts under ``LEAST_WORDS`` words belong to no pair. Repeated rows count
once. A chunk_id stored with two texts is a member of both classes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.functions.stages import checked_join, cut
from quire.functions.tables import salted_join
from quire.llm.codepoints import DIGIT, LETTER, OTHER_NUMBER, blocks, classes, decode, hash_ranges, mix, runs
from quire.llm.repeated_lines import lower_map

SHINGLE, LEAST_WORDS, SIMILARITY = 3, 30, 0.6
BANDS, ROWS = 80, 4
BITS, PARTS = 2048, 256
#: Band keys that more classes than this share are dealt out by salts; one class of so many is looked at to find them, and so many keys are taken at most.
HOT_CLASSES, HOT_SAMPLE, HOT_KEYS, SALTS = 4096, 64, 10_000, 16
#: Bytes of a (class, key) row and of a task that joins them.
ROW_BYTES, TASK_BYTES = 24, 8 << 20
#: Rows of equal text up to which they may all reach the index, members of a class that meet in one task, and the bits of the frequency sketch of the exact index.
COPIES, CLASS_SLOT, SKETCH_BITS = 256, 10_000, 20
EDITS, SUBJECT_PIVOTS, GRID = 3, 16, 3
_HASHES = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(codes: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of the distinct sequences of ``n`` words of each text, rows ascending, and the words of each row."""
    codes, offsets, _ = lower_map().apply(codes, offsets)
    a, b = runs((classes()[codes] & (LETTER | DIGIT | OTHER_NUMBER)) > 0, offsets)
    rows = np.searchsorted(offsets, a, "right") - 1
    words = np.bincount(rows, minlength=len(offsets) - 1)
    hashes = hash_ranges(codes, a, b)
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), words
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = mix(total + hashes[k : len(total) + k] * np.uint64(2 * k + 3))
    inside = rows[: len(total)] == rows[n - 1 :]
    total, rows = total[inside], rows[: len(inside)][inside]
    order = np.lexsort((total, rows))
    total, rows = total[order], rows[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (rows[1:] != rows[:-1])
    return total[new], rows[new], words


def bands(sequences: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` 64-bit keys for each text, whose sequences begin at ``first``."""
    keys = np.zeros((len(first), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(first), band, np.uint64)
        for row in range(ROWS):
            low = np.minimum.reduceat((sequences * _HASHES[band * ROWS + row]) >> np.uint64(20), first)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
        keys[:, band] = key
    return keys


def coordinates(sequences: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many bits of each text's fingerprint lie in each part; ``rows`` counts the texts from 0 upwards."""
    n = int(rows[-1]) + 1
    held = np.zeros((n, BITS), bool)
    held[rows, (sequences % np.uint64(BITS)).astype(np.int64)] = True
    return held.reshape(n, PARTS, BITS // PARTS).sum(2).astype(np.int16)


def class_texts(chunks: DataFrame) -> DataFrame:
    """(class, text) of every row with a text."""
    return chunks.where("text is not null").select(F.xxhash64("text").alias("class"), "text")


def first_copies(block: pa.RecordBatch) -> pa.RecordBatch:
    """The block with one row for each class: copies are dropped before anything is computed."""
    _, at = np.unique(block.column("class").to_numpy(), return_index=True)
    return block.take(pa.array(np.sort(at)))


def thinned(texts: DataFrame) -> DataFrame:
    """(class, text) with at most ``COPIES`` rows of a class, so that no text meets itself too often in a join.

    Only the classes that have more are looked up, and only their rows are moved.
    """
    many = cut(texts.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") > COPIES).select("class"))
    if not many.limit(1).count():
        return texts
    once = checked_join(texts, many, ["class"], "left_semi").dropDuplicates(["class"])
    return checked_join(texts, many, ["class"], "left_anti").unionByName(once)


def band_keys(texts: DataFrame) -> DataFrame:
    """(class, key): ``BANDS`` rows for each text (class, text) of enough words."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in map(first_copies, blocks(batches, "text")):
            sequences, rows, words = shingles(*decode(block.column("text")))
            keep = (words >= LEAST_WORDS)[rows]
            sequences, rows = sequences[keep], rows[keep]
            if len(rows):
                kept, first = np.unique(rows, return_index=True)
                keys = bands(sequences, first).view(np.int64)
                yield pa.RecordBatch.from_arrays([block.column("class").take(pa.array(np.repeat(kept, BANDS))), pa.array(keys.ravel())], ["class", "key"])

    return texts.mapInArrow(work, "class bigint, key bigint")


def hot_keys(texts: DataFrame) -> DataFrame:
    """(key): the band keys that many classes share, judged by one class of ``HOT_SAMPLE``; at most ``HOT_KEYS``.

    They only say how the work is split; a key that is not among them is joined all the same.
    """
    sample = texts.where(F.pmod("class", F.lit(HOT_SAMPLE)) == 0)
    counts = band_keys(sample).distinct().groupBy("key").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= HOT_CLASSES // HOT_SAMPLE).orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key")


def candidate_pairs(chunks: DataFrame) -> DataFrame:
    """(a, b): classes that share at least two band keys, a < b, each pair once.

    The rows of hot keys are dealt out by salts too. Whether two keys were shared is told by the
    least and the greatest of them, so repeated rows count once and partial sums stay two numbers a pair.
    """
    spark = chunks.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chunks.count() * BANDS * ROW_BYTES // TASK_BYTES))
    texts = thinned(class_texts(chunks))
    hot = cut(hot_keys(texts))
    some_hot = hot.limit(1).count() > 0
    keys = band_keys(texts)

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.withColumnRenamed("class", "a").join(right.withColumnRenamed("class", "b"), on).where("a < b").select("a", "b", "key")

    cold = (keys.join(F.broadcast(hot), "key", "left_anti") if some_hot else keys).repartition(n, "key")
    shared = joined(cold, cold, ["key"])
    if some_hot:
        rows = keys.join(F.broadcast(hot), "key", "left_semi")
        left = rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int"))
        right = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        shared = shared.unionByName(joined(left, right, ["key", "salt"]))
    pairs = shared.groupBy("a", "b").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    return pairs.where("low < high").select("a", "b")


def sketch(chunks: DataFrame) -> np.ndarray:
    """How many blocks of texts hold the sequences of each of 2 ** ``SKETCH_BITS`` hash buckets; as many numbers come to the driver."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in map(first_copies, blocks(batches, "text")):
            sequences, _, _ = shingles(*decode(block.column("text")))
            bucket, n = np.unique(sequences >> np.uint64(64 - SKETCH_BITS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n)], ["bucket", "n"])

    table = np.zeros(1 << SKETCH_BITS, np.int64)
    found = class_texts(chunks).mapInArrow(work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return table


def prefix_pairs(chunks: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): every pair of classes that may reach ``similarity``, a < b, each once; none is lost.

    The order of sequences is by a sketch of their frequency, rare ones first, then by hash. A pair
    whose sizes or whose places in the order leave no room for enough common sequences is dropped in the join.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(sketch(chunks))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in map(first_copies, blocks(batches, "text")):
            sequences, rows, words = shingles(*decode(block.column("text")))
            keep = (words >= LEAST_WORDS)[rows]
            sequences, rows = sequences[keep], rows[keep]
            order = np.lexsort((sequences, shared.value[(sequences >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], rows))
            sequences, rows = sequences[order], rows[order]
            n = np.bincount(rows, minlength=block.num_rows)[rows]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            at = np.flatnonzero(place <= n - np.ceil(similarity * n - 1e-9))
            yield pa.RecordBatch.from_arrays([block.column("class").take(pa.array(rows[at])), pa.array(sequences[at].view(np.int64)), pa.array(n[at], pa.int32()), pa.array(place[at], pa.int32())], ["class", "key", "n", "place"])

    keys = class_texts(chunks).mapInArrow(work, "class bigint, key bigint, n int, place int").dropDuplicates(["key", "class"])
    left, right = keys.toDF("a", "key", "na", "pa"), keys.toDF("b", "key", "nb", "pb")
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-9 - F.least("pa", "pb")
    sizes = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-9
    return left.join(right, "key").where((F.col("a") < F.col("b")) & sizes & room).select("a", "b").distinct()


def pivot_table(texts: DataFrame) -> DataFrame:
    """(class, n, pivots): sequences and pivot coordinates of each class."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in map(first_copies, blocks(batches, "text")):
            sequences, rows, _ = shingles(*decode(block.column("text")))
            kept, first, number = np.unique(rows, return_index=True, return_inverse=True)
            if len(kept):
                pivots = coordinates(sequences, number)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * PARTS, pa.int32()), pa.array(pivots.ravel()))
                yield pa.RecordBatch.from_arrays([block.column("class").take(pa.array(kept)), pa.array(np.diff(np.append(first, len(rows))), pa.int32()), lists], ["class", "n", "pivots"])

    return texts.mapInArrow(work, "class bigint, n int, pivots array<smallint>").dropDuplicates(["class"])


def discard(pairs: DataFrame, table: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs that no pivot coordinate rules out."""
    rows = table.select("class", "n", "pivots")
    both = pairs.join(rows.toDF("a", "na", "pa"), "a").join(rows.toDF("b", "nb", "pb"), "b")
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    # the bound holds for whole numbers; the small term is for the rounding of the division
    return both.where(apart <= F.floor((1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-9)).select("a", "b")


def verify(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): the pairs whose texts (class, text) share at least ``similarity`` of all their sequences, counted exactly."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "ta", "tb"):
            held = []
            for name in ("ta", "tb"):
                sequences, rows, _ = shingles(*decode(block.column(name)))
                held.append((np.bincount(rows, minlength=block.num_rows), mix(sequences + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), rows))
            common = np.isin(held[0][1], held[1][1])
            n = np.bincount(held[0][2][common], minlength=block.num_rows)
            keep = n >= similarity * (held[0][0] + held[1][0] - n) - 1e-9
            yield block.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(work, "a bigint, b bigint")


def class_links(chunks: DataFrame, exact: bool = False) -> DataFrame:
    """(a, b): the verified pairs of classes."""
    pairs = cut(prefix_pairs(chunks) if exact else candidate_pairs(chunks))
    named = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    texts = cut(checked_join(class_texts(chunks), named, ["class"], "left_semi").dropDuplicates(["class"]))
    return verify(discard(pairs, pivot_table(texts)), texts)


def long_classes(texts: DataFrame) -> DataFrame:
    """(class): the classes of enough words, each once."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in map(first_copies, blocks(batches, "text")):
            _, _, words = shingles(*decode(block.column("text")))
            yield block.select(["class"]).filter(pa.array(words >= LEAST_WORDS))

    return texts.mapInArrow(work, "class bigint").distinct()


def members(chunks: DataFrame) -> DataFrame:
    """(class, chunk_id) of all rows with a text, each once."""
    return chunks.where("text is not null and chunk_id is not null").select(F.xxhash64("text").alias("class"), "chunk_id").distinct()


def expanded(links: DataFrame, rows: DataFrame, copied: DataFrame) -> DataFrame:
    """(x, y): the members of linked classes, x < y; a link of a class with itself pairs its members.

    ``copied`` has the classes of several members and their numbers ``n``. A class of more than
    ``CLASS_SLOT`` is cut into slots, and a link into pairs of slots, so no task meets more than
    ``CLASS_SLOT`` members of a class at once.
    """
    slots = F.coalesce("slots", F.lit(1))
    sizes = cut(copied.where(F.col("n") > CLASS_SLOT).select("class", F.ceil(F.col("n") / CLASS_SLOT).cast("int").alias("slots")))
    placed, out = rows.withColumn("slot", F.lit(0)), links.withColumn("slot_a", F.lit(0)).withColumn("slot_b", F.lit(0))
    if sizes.limit(1).count():
        placed = checked_join(rows, sizes, ["class"], "left").select("class", "chunk_id", F.pmod(F.xxhash64("chunk_id"), slots).cast("int").alias("slot"))
        for side in ("a", "b"):
            out = out.join(sizes.withColumnRenamed("class", side), side, "left").withColumn(f"slot_{side}", F.explode(F.sequence(F.lit(0), slots - 1))).drop("slots")
    for side, name in (("a", "x"), ("b", "y")):
        out = out.join(placed.toDF(side, name, f"slot_{side}"), [side, f"slot_{side}"])
    return out.where("x <> y and (a <> b or x < y)").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def found_chunks(chunks: DataFrame, exact: bool = False) -> DataFrame:
    """(key_a, key_b): all pairs of near-duplicate chunks.

    The result is defined as pairs of rows, so links of classes are joined with their members, and
    the copies inside a class are paired. ``chunk_groups`` gives one row a chunk instead.
    """
    links = cut(class_links(chunks, exact))
    rows = cut(members(chunks))
    copied = cut(rows.groupBy("class").agg(F.count("*").alias("n")).where("n > 1"))
    long = cut(long_classes(checked_join(class_texts(chunks), copied.select("class"), ["class"], "left_semi")))
    whole = links.unionByName(long.select(F.col("class").alias("a"), F.col("class").alias("b")))
    return expanded(whole, rows, copied).distinct().toDF("key_a", "key_b")


def found_subjects(manifest: DataFrame, edits: int = EDITS) -> DataFrame:
    """(key_a, key_b): different subjects at most ``edits`` letters apart."""
    names = cut(manifest.select(F.col("metadata.subject").alias("s")).where("s is not null").distinct())
    # references: a fixed number of the subjects, by a hash; the first coordinate is the distance to the empty string
    pivots = [r["s"] for r in names.orderBy(F.xxhash64("s"), "s").limit(SUBJECT_PIVOTS).collect()]
    rows = names.select("s", F.array(F.length("s"), *[F.levenshtein("s", F.lit(p)) for p in pivots]).alias("at"))
    cell = F.transform(F.slice("at", 1, GRID), lambda x: F.floor(x / (edits + 1)).cast("int"))
    # two within reach lie in the same or in neighbouring cells in every coordinate
    near = rows.select(F.col("s").alias("b"), F.col("at").alias("at_b"), cell.alias("cell"))
    moves = F.array(*[F.array(*map(F.lit, m)) for m in product((-1, 0, 1), repeat=GRID)])
    near = near.withColumn("_m", F.explode(moves)).withColumn("cell", F.zip_with("cell", F.slice("_m", 1, F.size("cell")), lambda x, m: x + m)).drop("_m").distinct()
    pairs = rows.select(F.col("s").alias("a"), F.col("at").alias("at_a"), cell.alias("cell")).join(near, "cell").where("a < b")
    apart = F.array_max(F.zip_with("at_a", "at_b", lambda x, y: F.abs(x - y)))
    return pairs.where((apart <= edits) & (F.levenshtein("a", "b") <= edits)).select(F.col("a").alias("key_a"), F.col("b").alias("key_b"))


def found_pairs(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """(kind, key_a, key_b) of chunks and subjects."""
    return found_chunks(chunks).select(F.lit("chunk").alias("kind"), "key_a", "key_b").unionByName(found_subjects(manifest).select(F.lit("subject").alias("kind"), "key_a", "key_b"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(class, group): the least class each one is linked to over any number of links.

    Large-star and small-star rounds on the link table, each cut to the shared folder, until no link
    changes; nothing is collected but one number a round.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).where("a <> b").distinct()
        new = cut(small)
        changed = new.exceptAll(edges).limit(1).count() + edges.exceptAll(new).limit(1).count()
        edges = new
        if not changed:
            break
    return nodes.join(edges.select(F.col("b").alias("class"), F.col("a").alias("m")), "class", "left").select("class", F.coalesce("m", "class").alias("group"))


def chunk_groups(chunks: DataFrame, exact: bool = False) -> DataFrame:
    """(chunk_id, group, n_links): every chunk of enough words once, with its group and the number of other texts it is linked to.

    A group is named by its least chunk_id.
    """
    links = cut(class_links(chunks, exact))
    nodes = long_classes(class_texts(chunks))
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    named = components(nodes, links).join(degree, "class", "left")
    rows = cut(members(chunks).join(named, "class").withColumnRenamed("group", "number"))
    names = rows.groupBy("number").agg(F.min("chunk_id").alias("group"))
    # the names are as many as the groups; a group of many members is spread by the salts
    rows = salted_join(rows.select("chunk_id", "number", "n_links"), names, ["number"])
    return rows.groupBy("chunk_id").agg(F.min("group").alias("group"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))
