"""How five document filters act together, in every order of application.

Blocks of documents become sparse rows of a document-term matrix (CSR) over a dictionary of the whole
corpus. Sums of a row and its number of stored entries decide the two word filters; the others look at
characters and at copies. What then counts is how many documents fail which set of filters, a table of
at most 128 rows a part, on which all 120 orders are evaluated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.llm import common, dictionary, exact_dups
from ledgerwise.scale import attach_unique, cut_lineage, written

FILTERS = "ABCDE"
BLOCK_BYTES = 1 << 19
# Bounds of the filters.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SIGNS = 100, 80, 10, b"#$%&*|"

_SPACE = dictionary.byte_table(b"\t\n\x0b\x0c\r ")
_UPPER = dictionary.byte_table(bytes(range(65, 91)))
_SIGN = dictionary.byte_table(SIGNS)
_POINT = dictionary.byte_table(bytes([*range(0x80), *range(0xC0, 0x100)]))
_MATRIX = "indptr binary, indices binary, data binary"
_CHARACTERS = "upper array<long>, points array<long>, signs array<boolean>"
_COUNTS = "n_words array<long>, n_distinct array<long>"


class _Block:
    """Documents of one block: their words so far, and counts of their characters."""

    def __init__(self):
        self.parts, self.owners, self.bytes = [], [], 0
        self.upper, self.points, self.signs = [], [], []

    def add(self, text: bytes) -> None:
        row = len(self.upper)
        upper = points = signs = 0
        for data in dictionary.segments(text, _SPACE):
            starts, ends, inside = dictionary.word_spans(data, _SPACE)
            if len(starts):
                self.parts.append(dictionary.packed_words(data[inside], ends - starts))
                self.owners.append((row, len(starts)))
            upper += int(np.count_nonzero(_UPPER[data]))
            points += int(np.count_nonzero(_POINT[data]))
            signs += int(np.count_nonzero(_SIGN[data]))
        self.upper.append(upper)
        self.points.append(points)
        self.signs.append(signs > 0)
        self.bytes += len(text)

    def record(self, kept: dict[str, list]) -> dict:
        codes, words = dictionary.in_hash_order(*dictionary.numbered(self.parts))
        rows = len(self.upper)
        owner = np.repeat(
            np.array([o for o, _ in self.owners], np.int64), np.array([n for _, n in self.owners], np.int64)
        )
        width = max(len(words), 1)
        cells, data = np.unique(owner * width + codes, return_counts=True)
        indptr = np.searchsorted(cells, np.arange(rows + 1) * width)
        spelled, lengths = dictionary.unpacked(words)
        return {
            "block": int(np.random.default_rng().integers(1 << 62)),
            "field": None,
            "words": spelled.tobytes(),
            "lengths": dictionary.compact(lengths),
            "counts": dictionary.compact(np.bincount(codes, minlength=len(words))),
            "indptr": dictionary.compact(indptr),
            "indices": dictionary.compact(cells % width),
            "data": dictionary.compact(data),
            "upper": self.upper,
            "points": self.points,
            "signs": self.signs,
            **kept,
        }


def _blocks(carried: list[str], block_bytes: int):
    """Rows of `text` and carried columns as blocks; small texts are counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, schema = _Block(), {c: [] for c in carried}, None
        fixed = [
            ("block", pa.int64()), ("field", pa.string()), ("words", pa.binary()), ("lengths", pa.binary()),
            ("counts", pa.binary()), ("indptr", pa.binary()), ("indices", pa.binary()), ("data", pa.binary()),
            ("upper", pa.list_(pa.int64())), ("points", pa.list_(pa.int64())), ("signs", pa.list_(pa.bool_())),
        ]
        for batch in batches:
            types = [(c, pa.list_(batch.schema.field(c).type)) for c in carried]
            schema = pa.schema([*fixed, *types])
            for part in common.slices([batch]):
                own = {c: part.column(c).to_pylist() for c in carried}
                for k, text in enumerate(common.blobs(part.column("text"))):
                    block.add(text)
                    for c in carried:
                        kept[c].append(own[c][k])
                    if block.bytes >= block_bytes:
                        yield dictionary.one_row(block.record(kept), schema)
                        common.released()
                        block, kept = _Block(), {c: [] for c in carried}
        if block.upper:
            yield dictionary.one_row(block.record(kept), schema)

    return run


def _global(own: tuple[str, ...]):
    """Replace the local word numbers of a block by those of the dictionary, in plain numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [n for n in batch.schema.names if n not in own]
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in own}
                ids = dictionary.ids_of(row["answers"])
                if ids.max(initial=0) >> 32:
                    raise OverflowError("more than 2^32 different words")
                indptr, data = dictionary.expand(row["indptr"]), dictionary.expand(row["data"])
                made = {
                    "indptr": indptr,
                    "indices": (ids - 1)[dictionary.expand(row["indices"])].astype(np.uint32),
                    "data": data.astype(np.uint32),
                }
                sums = np.concatenate(([0], np.cumsum(data)))
                counts = {"n_words": np.diff(sums[indptr]), "n_distinct": np.diff(indptr)}
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(n).slice(k, 1) for n in rest],
                        *[pa.array([x.tobytes()], pa.binary()) for x in made.values()],
                        *[pa.array([x], pa.list_(pa.int64())) for x in counts.values()],
                    ],
                    [*rest, *made, *counts],
                )
            common.released()

    return run


def document_terms(
    docs: DataFrame, keep: tuple[str, ...] = (), text_column: str = "text", block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of a corpus: CSR shards, and the dictionary that numbers its columns.

    A shard is one row: `indptr` (64 bits, one more than the shard has documents), `indices` (32 bits without
    sign, id - 1 in the dictionary, each once a document), `data` (the same, occurrences), and arrays with an
    entry a document: `n_words` (row sums), `n_distinct` (stored entries), capital letters `upper`, code points
    `points`, whether it holds one of the `signs`, and the columns of `keep`. Words are runs other than ASCII white space, told apart by their
    bytes and case; a null text is an empty row. No documents give no shards.
    """
    named = {c: f"_keep_{k}" for k, c in enumerate(keep)}
    source = docs.select(
        common.text_bytes(text_column).alias("text"), *[F.col(c).alias(n) for c, n in named.items()]
    )
    kinds = [f"{n} array<{t}>" for n, t in source.dtypes if n != "text"]
    schema = ", ".join(
        ["block long, field string, words binary, lengths binary, counts binary", _MATRIX, _CHARACTERS, *kinds]
    )
    blocks = written(source.mapInArrow(_blocks(list(named.values()), block_bytes), schema), "matrix-blocks", compression="zstd")
    answers, entries = dictionary.build(blocks)
    joined = blocks.drop("words", "lengths", "counts", "field").join(answers, "block", "left")
    own = ("answers", "indptr", "indices", "data")
    rest = [(n, t) for n, t in joined.dtypes if n not in own]
    matrix = joined.mapInArrow(_global(own), ", ".join([*[f"{n} {t}" for n, t in rest], _MATRIX, _COUNTS]))
    matrix = matrix.withColumnsRenamed({n: c for c, n in named.items()})
    return matrix, entries.drop("field")


def document_counts(matrix: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document of the CSR shards: n_words, n_distinct, upper, points, signs, `keep`."""
    named = {c: f"_{k}" for k, c in enumerate(("n_words", "n_distinct", "upper", "points", "signs", *keep))}
    return matrix.select(*[F.col(c).alias(n) for c, n in named.items()]).select(
        F.inline(F.arrays_zip(*named.values()))
    ).toDF(*named)


def failing_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part, set of failed filters and label: part, failed, good, toxic, documents.

    `failed` has bit k for filter k of FILTERS. A part is a value of `lang`; null is the empty string.
    A row fails E if a smaller id has the same text anywhere, so neither a row without an id nor one that
    repeats id and text does. Several labels of one id count together: good or toxic if one says so.
    """
    rows = exact_dups.with_content(docs.select("doc_id", "text", "lang"))
    keep = ("doc_id", "lang", exact_dups.CONTENT)
    matrix, _ = document_terms(rows, keep)
    counted = cut_lineage(document_counts(matrix, keep).withColumn("_row", F.monotonically_increasing_id()))
    copies = counted.groupBy(exact_dups.CONTENT).agg(
        F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    copies = copies.where("_n > 1").drop("_n")
    marks = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    known = attach_unique(counted, copies, [exact_dups.CONTENT], "_row")
    known = attach_unique(known, marks, ["doc_id"], "_row")
    fails = [
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"),
        100 * F.col("upper") > MAX_UPPER_PERCENT * F.col("points"),
        F.col("signs"),
        F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)),
    ]
    bits = [F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)]
    return known.groupBy(
        F.coalesce("lang", F.lit("")).alias("part"),
        sum(bits[1:], bits[0]).alias("failed"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    ).agg(F.count(F.lit(1)).alias("documents"))


def filter_orders(sets: DataFrame) -> DataFrame:
    """Evaluate all orders of the filters on the table of `failing_sets`: 600 rows a part."""
    sets = cut_lineage(sets)
    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    at = sets.withColumn("filter_order", F.explode(orders))
    at = at.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def bits(letters):
        found = [F.when(F.contains(letters, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)]
        return sum(found[1:], found[0])

    at = at.withColumn("own", bits(F.substring("filter_order", F.col("step"), F.lit(1))))
    at = at.withColumn("before", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    n, failed = F.col("documents"), F.col("failed")
    own, before = failed.bitwiseAND(F.col("own")) != 0, failed.bitwiseAND(F.col("before")) != 0

    def total(condition):
        return F.sum(F.when(condition, n).otherwise(F.lit(0).cast("long")))

    rows = at.groupBy("part", "filter_order", "step", "own").agg(
        total(~own & ~before).alias("kept"),
        total(own & ~before).alias("removed"),
        total(own & before).alias("redundant"),
        total(failed == F.col("own")).alias("unique_fails"),
        total(own & ~before & F.col("good")).alias("good_lost"),
        total(own & ~before & F.col("toxic")).alias("toxic_lost"),
    )
    shares = rows.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    # Five rows a part, joined to the 600 rows of the part.
    return rows.join(shares, ["part", "own"]).drop("own")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters ABCDE and step: what the step keeps and removes.

    Columns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley, the removals of the step's filter summed over all 120 orders. A document fails A with under
    100 words, B with under 80 % distinct words, C with over 10 % capital letters A-Z among its code
    points, D with one of `#$%&*|`, E with the text of a smaller id. Null texts are empty: they fail A.
    Rows are documents, repeated ones too. Other columns are not read. No documents give no rows.
    """
    return filter_orders(failing_sets(docs, labels))
