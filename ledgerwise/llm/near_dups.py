"""MinHash near-duplicate detection with sequential Bayesian verification.

1. A text becomes the set of hashes of its word runs. Equal sets are one node.
2. MinHash minima are cut into bands; nodes that agree in a whole band are candidates.
3. A candidate pair is compared in batches of signature bits, each as large as all before. After
   each batch it goes if the posterior probability that its similarity reaches the threshold is
   below `miss`.
   It also goes when parity bits of the two sets differ in more places than similar sets can differ
   in elements, which is certain.
4. Survivors are confirmed on their full sets, and links are joined to components.

A bucket is never expanded into all its pairs. Every member is compared to one hub, links are
closed to components, and only pairs that are still in different components are compared then.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.llm import common
from ledgerwise.llm.components import components
from ledgerwise.scale import checked_broadcast, cut_lineage, written

# At similarity 0.8 a pair shares no band with probability (1 - 0.8^5)^32 = 3e-6.
BANDS, BAND_ROWS = 32, 5
# Signature bits are kept in longs; a test follows after so many of them.
LONGS, TESTS = 16, (1, 2, 4, 8, 16)
# Bits that each element of a set flips one of, also kept in longs.
PARITIES = 16
MISS = 1e-5
_HASHES = 64 * LONGS
_FACTORS = np.random.default_rng(20011).integers(0, 1 << 32, _HASHES, np.uint32) | np.uint32(1)

SIGNS = [*(f"s{k}" for k in range(LONGS)), *(f"p{k}" for k in range(PARITIES))]
_ROWS = "doc_id long, n_shingles long, set_hash long, bands array<long>, " + ", ".join(
    f"{name} long" for name in SIGNS
)


def _minima(shingles: np.ndarray) -> np.ndarray:
    """Minima of the shingles' hashes under many orders; each half of a hash serves half of them."""
    least = np.full((2, _HASHES // 2), 0xFFFFFFFF, np.uint32)
    factors = _FACTORS.reshape(2, -1)
    for half, part in enumerate((shingles >> np.uint64(32), shingles)):
        short = part.astype(np.uint32)
        for first in range(0, len(short), 128):
            own = (short[first : first + 128, None] * factors[half]).min(axis=0)
            np.minimum(least[half], own, out=least[half])
    return least.ravel()


def _signatures(words: int):
    def run(batches):
        for part in common.slices(batches):
            sets = common.shingle_sets(common.blobs(part.column("text")), words)
            least = np.stack([_minima(s) for s in sets])
            keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS))
            for k in range(BAND_ROWS):
                column = least[:, k : BANDS * BAND_ROWS : BAND_ROWS].astype(np.uint64)
                keys = common.chain(keys, column)
            bits = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
            flips = np.stack([np.bincount(s % np.uint64(64 * PARITIES), minlength=64 * PARITIES) for s in sets])
            packed = np.packbits(np.hstack((bits, flips & 1)).astype(bool), axis=1).view(np.int64)
            flat = pa.array(np.ascontiguousarray(keys).view(np.int64).ravel())
            bands = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), flat
            )
            marks = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array(marks, np.uint64).view(np.int64)),
                    bands,
                    *[pa.array(np.ascontiguousarray(packed[:, k])) for k in range(len(SIGNS))],
                ],
                ["doc_id", "n_shingles", "set_hash", "bands", *SIGNS],
            )

    return run


def least_agreement(bits: int, threshold: float, miss: float) -> int:
    """Smallest number of equal bits at which a pair stays after `bits` compared bits.

    Two one-bit MinHash signatures agree in a bit with probability r = (1 + similarity) / 2. With
    r uniform on [1/2, 1] beforehand, a pair goes when P(r >= (1 + threshold) / 2) < miss.
    """
    r = np.linspace(0.5, 1, 20_001)[1:-1]
    for agree in range(bits + 1):
        weight = agree * np.log(r) + (bits - agree) * np.log1p(-r)
        weight = np.exp(weight - weight.max())
        if weight[r >= (1 + threshold) / 2].sum() >= miss * weight.sum():
            return agree
    return bits


def _unequal_bits(name: str, n: int, left: str, right: str) -> list[Column]:
    return [
        F.bit_count(F.col(f"{left}.{name}{k}").bitwiseXOR(F.col(f"{right}.{name}{k}"))) for k in range(n)
    ]


def may_be_similar(percent: int, miss: float, left: str = "x", right: str = "y") -> Column:
    """Whether a pair stays: by size and parity, which never err, and by the sequential test.

    Each test of the sequence compares one more batch, and later ones run only for pairs that remain.
    """
    unequal = _unequal_bits("s", LONGS, left, right)
    tests = [
        reduce(lambda a, b: a + b, unequal[:n]) <= 64 * n - least_agreement(64 * n, percent / 100, miss)
        for n in TESTS
    ]
    one, two = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    sizes = 100 * F.least(one, two) >= percent * F.greatest(one, two)
    # Sets of that similarity differ in (1 - s) / (1 + s) of their sizes' sum at most.
    apart = reduce(lambda a, b: a + b, _unequal_bits("p", PARITIES, left, right))
    parity = (100 + percent) * apart <= (100 - percent) * (one + two)
    return reduce(lambda a, b: a & b, [sizes, *tests, parity])


def _sets(words: int):
    def run(batches):
        for part in common.slices(batches):
            sets = common.shingle_sets(common.blobs(part.column("text")), words)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["node", "shingles"],
            )

    return run


def _confirm(percent: int):
    def run(batches):
        for part in common.slices(batches, "left_set"):
            keep = []
            for one, two in zip(part.column("left_set").to_pylist(), part.column("right_set").to_pylist()):
                one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    pairs = cut_lineage(pairs)
    ends = [pairs.select(F.col(end).alias("doc_id")).distinct() for end in ("a", "b")]
    needed = ends[0].union(ends[1]).distinct()
    needed, _ = checked_broadcast(needed)
    sets = docs.join(needed, "doc_id", "left_semi").mapInArrow(_sets(words), "node long, shingles binary")
    sets = written(sets, "near-duplicate-sets")
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left_set")), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right_set")), "b")
    confirmed = met.select("a", "b", "left_set", "right_set").mapInArrow(_confirm(percent), "a long, b long")
    return cut_lineage(confirmed.distinct())


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    miss: float = MISS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links) and kept.

    Documents are linked when 100 * common shingles >= percent * all their shingles. A row is a
    document; equal texts are linked. Texts that are null, empty or without words have no shingles
    and link with nothing, and so do rows without an id, whose component_id is null and kept false.
    Repeated rows all get the same answer. Other columns are not read, whatever their names; an
    empty table gives an empty table.
    """
    docs = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), common.text_bytes(text_column).alias("text")
    )
    rows = written(docs.mapInArrow(_signatures(words), _ROWS), "signatures")
    usable = rows.where("doc_id is not null and n_shingles > 0")
    nodes = cut_lineage(usable.groupBy("set_hash").agg(F.min("doc_id").alias("node")))
    firsts = nodes.select("set_hash", F.col("node").alias("doc_id"))
    nodes_signed = written(
        usable.join(firsts, ["set_hash", "doc_id"]).withColumnRenamed("doc_id", "node").drop("set_hash"),
        "node-signatures",
    )
    signs = ["n_shingles", *SIGNS]
    members = nodes_signed.select("node", F.explode("bands").alias("bucket"))
    # One hub for all buckets of a group, so that a group gives few different pairs.
    hub = F.min("node").alias("hub")
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), hub).where("n > 1")
    shared = cut_lineage(members.join(buckets, "bucket"))

    def signed(pairs: DataFrame) -> DataFrame:
        x, y = nodes_signed.select("node", *signs).alias("x"), nodes_signed.select("node", *signs).alias("y")
        met = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
        return met.where(may_be_similar(percent, miss)).select("a", "b")

    stars = shared.where("node <> hub").select(
        F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")
    )
    links = _confirmed(signed(stars.distinct()).distinct(), docs, words, percent)
    found = components(links)

    # Pairs in one bucket whose components still differ; pairs with the hub were compared above.
    labelled = cut_lineage(
        shared.where("n > 2 and node <> hub")
        .join(found, "node", "left")
        .select("bucket", "node", F.coalesce("component", "node").alias("part"))
    )
    sizes = labelled.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.max_by("part", "size").alias("main")
    )
    open_rows = (
        labelled.join(main.where("parts > 1"), "bucket")
        .join(nodes_signed.select("node", "bands", *signs), "node")
        .withColumn("in_main", F.col("part") == F.col("main"))
        .select("bucket", "node", "part", "in_main", "bands", *signs)
    )
    open_rows = cut_lineage(open_rows)
    across = open_rows.where("not in_main").alias("x").join(
        open_rows.alias("y"),
        (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.part") != F.col("y.part"))
        & (F.col("y.in_main") | (F.col("x.node") > F.col("y.node")))
        & may_be_similar(percent, miss)
        # A pair may share many buckets; it is emitted in the first of them only.
        & (F.array_intersect("x.bands", "y.bands")[0] == F.col("x.bucket")),
    )
    pairs = across.select(
        F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")
    ).distinct()
    late = _confirmed(pairs, docs, words, percent)
    if not late.isEmpty():
        found = components(links.union(late))

    classes = nodes.join(found, "node", "left").select(
        "set_hash", F.coalesce("component", "node").alias("class_id")
    )
    own = F.when(F.col("n_shingles") > 0, F.col("class_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(own, F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", "set_hash").join(classes, "set_hash", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )
