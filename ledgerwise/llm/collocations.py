"""Phrases that stick together: counts of word runs in a HAT-trie, and their best collocations.

Blocks of texts of one language write their words as numbers; a dictionary of the corpus gives ids to
words that occur often enough, as no frequent phrase holds another. Tasks count runs of ids in a trie
whose leaves are hash tables. Its largest subtrees are spilled as sorted runs, cut by the hash of a
phrase's first two words, and the runs of each such prefix partition are merged. What is left are the
frequent phrases, which are scored and ranked by DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwise.llm import common, dictionary
from ledgerwise.scale import attach_unique, cut_lineage, written

BLOCK_BYTES = 1 << 19
# Entries of a leaf before it bursts, of a trie before it spills, and of a prefix partition about.
LEAF, HELD, PARTITION = 1 << 16, 1 << 20, 1 << 19
TOP_SLICE = 50_000

_BREAK = dictionary.byte_table(b".,;:!?\n\x0b\x0c\r")
_OUTSIDE = dictionary.byte_table(b".,;:!?\n\x0b\x0c\r\t ")
_BLOCK = pa.schema(
    [
        ("block", pa.int64()), ("field", pa.string()), ("words", pa.binary()), ("lengths", pa.binary()),
        ("counts", pa.binary()), ("tokens", pa.binary()), ("n_words", pa.int64()),
    ]
)


class _Text:
    """Words of one language and the pieces that they lie in."""

    def __init__(self):
        self.parts, self.pieces, self.bytes, self.last = [], [], 0, 0

    def add(self, data: np.ndarray) -> None:
        starts, ends, inside = dictionary.word_spans(data, _OUTSIDE)
        if len(starts):
            self.parts.append(dictionary.packed_words(data[inside], ends - starts))
            piece = np.cumsum(_BREAK[data], dtype=np.int64)[starts] + self.last
            self.pieces.append(piece)
            # The next words lie in another piece.
            self.last = int(piece[-1]) + 1
        self.bytes += len(data)

    def record(self, field: str | None) -> dict:
        """Tokens are word numbers from 1, with a 0 between pieces."""
        codes, words = dictionary.in_hash_order(*dictionary.numbered(self.parts))
        pieces = np.concatenate(self.pieces) if self.pieces else np.empty(0, np.int64)
        after = np.flatnonzero(np.diff(pieces)) + 1
        spelled, lengths = dictionary.unpacked(words)
        return {
            "block": int(np.random.default_rng().integers(1 << 62)),
            "field": field,
            "words": spelled.tobytes(),
            "lengths": dictionary.compact(lengths),
            "counts": dictionary.compact(np.bincount(codes, minlength=len(words))),
            "tokens": dictionary.compact(np.insert(codes + 1, after, 0)),
            "n_words": len(codes),
        }


def _blocks(block_bytes: int):
    """Texts of each language gathered into blocks; texts are cut where a piece ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_texts: dict[str, _Text] = {}
        for part in common.slices(batches):
            for field, text in zip(part.column("field").to_pylist(), common.blobs(part.column("text"))):
                for data in dictionary.segments(text.lower(), _BREAK):
                    own = open_texts.setdefault(field, _Text())
                    own.add(data)
                    if own.bytes >= block_bytes:
                        yield dictionary.one_row(open_texts.pop(field).record(field), _BLOCK)
                        common.released()
            if sum(t.bytes for t in open_texts.values()) >= 8 * block_bytes:
                for field in list(open_texts):
                    yield dictionary.one_row(open_texts.pop(field).record(field), _BLOCK)
        for field, own in open_texts.items():
            yield dictionary.one_row(own.record(field), _BLOCK)

    return run


def phrases_of(tokens: np.ndarray, ids: np.ndarray, bits: int = 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of two and three words of a block: first word, the other two, occurrences.

    `ids` are the global ids of the block's words, 0 for rare ones, which no run may hold. The second and
    third word share a number of 64 bits; a run of two has 0 for its third.
    """
    usable = np.concatenate((np.zeros(1, bool), ids > 0))[tokens]
    two = usable[:-1] & usable[1:]
    three = two[:-1] & usable[2:]
    # The block's usable words, numbered: mostly so few that three numbers fit in 64 bits.
    local = np.zeros(len(ids) + 1, np.int64)
    local[1:][ids > 0] = np.arange(1, np.count_nonzero(ids) + 1)
    spelled = np.concatenate((np.zeros(1, np.int64), ids[ids > 0]))
    own = local[tokens]
    first = np.concatenate((own[:-1][two], own[:-2][three]))
    second = np.concatenate((own[1:][two], own[1:-1][three]))
    third = np.concatenate((np.zeros(np.count_nonzero(two), np.int64), own[2:][three]))
    if len(spelled) < 1 << bits:
        runs, counts = np.unique((first << (2 * bits)) | (second << bits) | third, return_counts=True)
        mask = (1 << bits) - 1
        first, second, third = runs >> (2 * bits), (runs >> bits) & mask, runs & mask
    else:
        pairs, places = np.unique((second << 32) | third, return_inverse=True)
        runs, counts = np.unique((first << 32) | places, return_counts=True)
        first, pairs = runs >> 32, pairs[runs & 0xFFFFFFFF]
        second, third = pairs >> 32, pairs & 0xFFFFFFFF
    return spelled[first], (spelled[second] << 32) | spelled[third], counts


def _second(rest: np.ndarray) -> np.ndarray:
    return (rest >> 32) & 0xFFFFFFFF


class Leaf:
    """An open-addressing hash table of runs, for all prefixes of a range of ids."""

    def __init__(self, capacity: int = 1 << 10):
        self.first = np.zeros(capacity, np.int64)
        self.rest = np.zeros(capacity, np.int64)
        self.counts = np.zeros(capacity, np.int64)
        self.size = 0

    def add(self, first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> None:
        """Count runs, each of which is given once."""
        if 2 * (self.size + len(first)) > len(self.counts):
            self._grow(self.size + len(first))
        mask = np.uint64(len(self.counts) - 1)
        key = common.chain(first.astype(np.uint64), rest.astype(np.uint64))
        place = (key & mask).astype(np.int64)
        while len(first):
            empty = self.counts[place] == 0
            # Of several that claim one empty place the last stays; the others see it and go on.
            self.first[place[empty]], self.rest[place[empty]] = first[empty], rest[empty]
            here = (self.first[place] == first) & (self.rest[place] == rest)
            self.size += int(np.count_nonzero(here & empty))
            self.counts[place[here]] += counts[here]
            on = ~here
            first, rest, counts = first[on], rest[on], counts[on]
            place = (place[on] + 1) & int(mask)

    def _grow(self, size: int) -> None:
        entries = self.entries()
        self.__init__(1 << (2 * size + 1).bit_length())
        if len(entries[0]):
            self.add(*entries)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        used = np.flatnonzero(self.counts)
        return self.first[used], self.rest[used], self.counts[used]


class Node:
    """Children by the id at one position of a run: each covers the ids from its bound to the next."""

    def __init__(self, depth: int):
        self.depth, self.bounds, self.children = depth, [0], [Leaf()]

    @property
    def size(self) -> int:
        return sum(c.size for c in self.children)

    def add(self, first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> None:
        at = first if self.depth == 0 else _second(rest)
        child = np.searchsorted(np.array(self.bounds), at, side="right") - 1
        order = np.argsort(child, kind="stable")
        child = child[order]
        cuts = [0, *(np.flatnonzero(np.diff(child)) + 1).tolist(), len(child)]
        numbers = child[cuts[:-1]].tolist() if len(child) else []
        pieces = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        # From the last child on: bursting puts new children behind the one that bursts.
        for number, piece in zip(reversed(numbers), reversed(pieces)):
            own = self.children[number]
            own.add(first[piece], rest[piece], counts[piece])
            if isinstance(own, Leaf) and own.size > LEAF:
                self._burst(number)

    def _burst(self, number: int) -> None:
        """Split a full leaf at its middle id; if it covers one id, a node of the next id replaces it."""
        first, rest, counts = self.children[number].entries()
        at = first if self.depth == 0 else _second(rest)
        middle = int(np.partition(at, len(at) // 2)[len(at) // 2])
        low = int(at.min())
        if low == int(at.max()):
            if self.depth == 0:
                node = Node(1)
                node.add(first, rest, counts)
                self.children[number] = node
            # Below two words a leaf holds one prefix, and may grow: its runs differ in the third word only.
            return
        # Bounds are such that a frequent id gets a leaf, and in the end a node, of its own.
        bound = middle if middle > low else middle + 1
        halves = []
        for own in (at < bound, at >= bound):
            leaf = Leaf()
            leaf.add(first[own], rest[own], counts[own])
            halves.append(leaf)
        self.children[number : number + 1] = halves
        self.bounds.insert(number + 1, bound)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [c.entries() for c in self.children]
        return tuple(np.concatenate(column) for column in zip(*parts))

    def spill(self, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take whole subtrees, largest first, until a share of all entries is out."""
        wanted, taken = share * self.size, []
        for number in sorted(range(len(self.children)), key=lambda k: -self.children[k].size):
            if wanted <= 0 or not self.children[number].size:
                break
            wanted -= self.children[number].size
            taken.append(self.children[number].entries())
            self.children[number] = Leaf()
        if not taken:
            return tuple(np.empty(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(column) for column in zip(*taken))


def _runs(entries: tuple[np.ndarray, np.ndarray, np.ndarray], partitions: int) -> Iterator[pa.RecordBatch]:
    """Spilled runs, sorted within each prefix partition: the hash of the first two words."""
    first, rest, counts = entries
    prefix = common.chain(first.astype(np.uint64), _second(rest).astype(np.uint64))
    part = (prefix % np.uint64(partitions)).astype(np.int32)
    order = np.lexsort((rest, first, part))
    first, rest, counts, part = first[order], rest[order], counts[order], part[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    spans = list(zip(cuts, cuts[1:]))
    # A few thousand rows at a time.
    for k in range(0, len(spans), 1024):
        own = [(a, b) for a, b in spans[k : k + 1024] if b > a]
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([int(part[a]) for a, _ in own], pa.int32()),
                "first": pa.array([first[a:b].astype(np.uint32).tobytes() for a, b in own], pa.binary()),
                "second": pa.array([_second(rest[a:b]).astype(np.uint32).tobytes() for a, b in own], pa.binary()),
                "third": pa.array([rest[a:b].astype(np.uint32).tobytes() for a, b in own], pa.binary()),
                "counts": pa.array([dictionary.compact(counts[a:b]) for a, b in own], pa.binary()),
            }
        )


def _count(partitions: int):
    """Count the phrases of all blocks of a task in one trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Node(0)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                ids = dictionary.ids_of(row["answers"])
                if ids.max(initial=0) >> 32:
                    raise OverflowError("more than 2^32 frequent words")
                trie.add(*phrases_of(dictionary.expand(row["tokens"]), ids))
                while trie.size > HELD:
                    yield from _runs(trie.spill(0.5), partitions)
            common.released()
        yield from _runs(trie.spill(1.0), partitions)

    return run


def _merge(min_count: int):
    """Merge the sorted runs of one prefix partition; phrases that occur often enough stay."""

    def run(table: pa.Table) -> pa.Table:
        first, second, third = (
            np.frombuffer(b"".join(table.column(n).to_pylist()), np.uint32).astype(np.int64)
            for n in ("first", "second", "third")
        )
        counts = np.concatenate([dictionary.expand(x) for x in table.column("counts").to_pylist()])
        rest = (second << 32) | third
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        heads = np.concatenate(([True], (np.diff(first) != 0) | (np.diff(rest) != 0)))
        starts = np.flatnonzero(heads)
        totals = np.add.reduceat(counts[order], starts)
        own = starts[totals >= min_count]
        common.released()
        return pa.table(
            {
                "w1": pa.array(first[own]),
                "w2": pa.array(_second(rest[own])),
                "w3": pa.array(rest[own] & 0xFFFFFFFF),
                "a": pa.array(totals[totals >= min_count]),
            }
        )

    return run


def frequent_phrases(
    docs: DataFrame,
    min_count: int = 10,
    text_column: str = "text",
    lang_column: str = "lang",
    block_bytes: int = BLOCK_BYTES,
    partition_size: int = PARTITION,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases, frequent words and the number of words of each language.

    Phrases: ids w1, w2, w3 (0 in runs of two) and occurrences a. Words: field (language), id, word
    (bytes), count. Sizes: field, n. Ids belong to one language.
    """
    source = docs.select(
        common.text_bytes(text_column).alias("text"), F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("field")
    )
    schema = "block long, field string, words binary, lengths binary, counts binary, tokens binary, n_words long"
    blocks = written(source.mapInArrow(_blocks(block_bytes), schema), "phrase-blocks", compression="zstd")
    answers, words = dictionary.build(blocks, min_count)
    words = cut_lineage(words)
    sizes = cut_lineage(blocks.groupBy("field").agg(F.sum("n_words").alias("n")))
    # About two runs a word; as many partitions as keep each of one size.
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    partitions = max(1, -(-2 * total // partition_size))
    own = blocks.select("block", "tokens").join(answers, "block")
    runs = own.mapInArrow(
        _count(partitions), "part int, first binary, second binary, third binary, counts binary"
    )
    phrases = runs.groupBy("part").applyInArrow(_merge(min_count), "w1 long, w2 long, w3 long, a long")
    return cut_lineage(phrases), words, sizes


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact: 38 digits hold counts of up to 15 digits."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    top = F.lit(1_000_000).cast("decimal(7,0)") * (a * a)
    return F.call_function("div", top, left * right)


def scored_phrases(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with text, language, occurrences l, r of the parts of their worst cut, and its score.

    Phrases that lie in a longer one with at least half of their occurrences are left out.
    """
    keyed = phrases.withColumn("_row", F.monotonically_increasing_id())
    pairs = phrases.where("w3 = 0")
    triples = phrases.where("w3 > 0")
    known = keyed
    for k in (1, 2, 3):
        own = words.select(
            F.col("id").alias(f"w{k}"), F.col("word").cast("string").alias(f"_word{k}"), F.col("count").alias(f"_f{k}"),
            *([F.col("field").alias("lang")] if k == 1 else []),
        )
        known = attach_unique(known, own, [f"w{k}"], "_row")
    inside = (
        triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
        .groupBy("w1", "w2").agg(F.max("a").alias("_longer"))
    )
    two = known.where("w3 = 0").join(inside, ["w1", "w2"], "left")
    two = two.where(F.col("_longer").isNull() | (100 * F.col("_longer") < 50 * F.col("a"))).select(
        "lang", F.concat_ws(" ", "_word1", "_word2").alias("phrase"), "a",
        F.col("_f1").alias("l"), F.col("_f2").alias("r"), _score(F.col("a"), F.col("_f1"), F.col("_f2")).alias("score"),
    )
    head = pairs.select("w1", "w2", F.col("a").alias("_head"))
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("_tail"))
    three = known.where("w3 > 0").join(head, ["w1", "w2"]).join(tail, ["w2", "w3"])
    early = _score(F.col("a"), F.col("_f1"), F.col("_tail"))
    late = _score(F.col("a"), F.col("_head"), F.col("_f3"))
    three = three.withColumns({"_early": early, "_late": late})
    first = F.col("_early") <= F.col("_late")
    three = three.select(
        "lang", F.concat_ws(" ", "_word1", "_word2", "_word3").alias("phrase"), "a",
        F.when(first, F.col("_f1")).otherwise(F.col("_head")).alias("l"),
        F.when(first, F.col("_tail")).otherwise(F.col("_f3")).alias("r"),
        F.least("_early", "_late").alias("score"),
    )
    return two.unionByName(three)


def top_of_each(df: DataFrame, group: str, order: list[Column], tie: str, k: int, slice_rows: int = TOP_SLICE) -> DataFrame:
    """The first k rows of each group with `rank`, found in slices first, so that no task sorts a group."""
    slices = max(1, -(-df.count() // slice_rows))
    while slices > 1:
        part = Window.partitionBy(group, F.pmod(F.xxhash64(tie), F.lit(slices))).orderBy(*order)
        df = cut_lineage(df.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank"))
        # Each round leaves k rows a slice at most, and half the slices or fewer.
        slices = 1 if slices <= 16 else slices // 16
    whole = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)


def collocations(
    docs: DataFrame,
    min_count: int = 10,
    top: int = 2000,
    text_column: str = "text",
    lang_column: str = "lang",
    **sizes_of,
) -> DataFrame:
    """Each language's strongest phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at `.,;:!?` and line ends into pieces, those at spaces and tabs
    into words. Phrases are runs of two or three words within a piece that occur `min_count` times in their
    language, overlaps included. A phrase's score is the least over its cuts in two of floor(10^6 a a / (l r)),
    with l and r the occurrences of the parts; ties go to the earlier cut. Ranked by score, then a, then the
    phrase by its UTF-8 bytes; n is the number of words of the language. A null text is empty and a null
    language `und`; rows are documents, repeated ones count again; other columns, ids too, are not read.
    A language without a frequent phrase has no row, and no documents give none.
    """
    phrases, words, sizes = frequent_phrases(docs, min_count, text_column, lang_column, **sizes_of)
    scored = cut_lineage(scored_phrases(phrases, words))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_of_each(scored, "lang", order, "phrase", top)
    numbers = sizes.select(F.col("field").alias("lang"), "n").withColumn("_row", F.col("lang"))
    best = attach_unique(best.withColumn("_row", F.col("phrase")), numbers.drop("_row"), ["lang"], "_row").drop("_row")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
