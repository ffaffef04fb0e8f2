"""Brown class-based bigram model: exchange clustering, transitions between classes, emissions.

Every word of the training documents gets one of CLASSES classes. A class is judged by its words'
neighbours: how often each class of word stands before and after them. In an exchange round all
words move to the class that explains their own neighbours best, without their own share in it. The
probability of a word after a word is that of its class after the last class, times that of the word
in its class.

Documents are kept as blocks of word numbers. A block tells shards about its distinct words, once
each, so the most frequent word costs one entry for each block; shards add up and move their words;
and blocks ask shards for the classes of their words. Only tables of CLASSES by 2 CLASSES numbers
go through the driver, and only they are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise.llm import common
from ledgerwise.scale import cut_lineage, written

CLASSES = 64
# Rounds of exchange, first with frequent words as neighbours, then with classes as neighbours.
ROUNDS = (4, 2)
BLOCK_TOKENS = 3 << 18
# What all blocks tell one shard, in bytes, about.
SHARD_BYTES = 24 << 20
# Each block proposes so many of its most frequent words as the first classes.
PROPOSED = 512
ADDED = 0.5
# Weight, in tokens, of the classes' own shares in the transitions from a class.
BACK_OFF = 10.0
# The end of a text counts as a word; no word hashes to it but by a chance of 2^-64.
END = np.uint64(0)
NO_CLASS = 255

_BLOCK = (
    "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, tokens binary, "
    "vocabulary binary"
)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as planes of low to high bytes, which pack well when small numbers are frequent."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _planes_of_long(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _longs(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _blocks(batches):
    ids, held, lengths, words, size = [], [], [], [], 0

    def block():
        flat = np.concatenate(words)
        vocabulary, number, counts = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        name = xxhash.xxh3_64_intdigest(flat.tobytes() + np.array([i or 0 for i in ids], np.int64).tobytes())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([np.uint64(name).astype(np.int64)], pa.int64()),
                pa.array([list(ids)], pa.list_(pa.int64())),
                pa.array([list(held)], pa.list_(pa.bool_())),
                pa.array([list(lengths)], pa.list_(pa.int64())),
                pa.array([_planes(rank[number])], pa.binary()),
                pa.array([vocabulary[order].tobytes()], pa.binary()),
            ],
            ["block", "doc_ids", "held", "lengths", "tokens", "vocabulary"],
        )

    for part in common.slices(batches):
        hashes, bounds = common.hash_words(common.blobs(part.column("text")))
        ends = np.arange(1, part.num_rows + 1)
        words.append(np.insert(hashes, bounds[1:], END))
        lengths += (np.diff(bounds) + 1).tolist()
        ids += part.column("doc_id").to_pylist()
        held += part.column("held_out").to_pylist()
        size += len(hashes) + len(ends)
        if size >= BLOCK_TOKENS:
            yield block()
            common.released()
            ids, held, lengths, words, size = [], [], [], [], 0
    if words:
        yield block()


def _rows(batches):
    """Rows one at a time: a block is large."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]
        common.released()


@dataclass
class Block:
    """The tokens of a block: numbers into its vocabulary, the number before each, and what trains."""

    vocabulary: np.ndarray
    tokens: np.ndarray
    before: np.ndarray
    trains: np.ndarray

    @staticmethod
    def of(row: dict) -> Block:
        # A block's vocabulary times the places is far below 2^31.
        vocabulary, tokens = np.frombuffer(row["vocabulary"], np.uint64), _numbers(row["tokens"]).view(np.int32)
        # Every text ends with END, so that is also what stands before its first word.
        before = np.concatenate((np.flatnonzero(vocabulary == END).astype(np.int32), tokens[:-1]))
        trains = np.repeat(~np.array(row["held"], bool), row["lengths"])
        return Block(vocabulary, tokens, before, trains)


def _proposals(batches):
    for row in _rows(batches):
        own = Block.of(row)
        counts = np.bincount(own.tokens[own.trains], minlength=len(own.vocabulary))
        top = np.argsort(-counts, kind="stable")[:PROPOSED]
        top = top[counts[top] > 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.vocabulary[top].view(np.int64)), pa.array(counts[top], pa.int64())], ["word", "n"]
        )


def _by_shard(hashes: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """Which positions go to which shard."""
    shard = (common.mix64(hashes) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    return [(int(shard[p[0]]), p) for p in np.split(order, cuts) if len(p)]


_NEIGHBOURS = "shard int, words binary, counts binary, sizes binary, places binary, numbers binary"


def _neighbours(block: Block, classes: np.ndarray, shards: int) -> pa.RecordBatch:
    """For each shard: its words of a block, their counts, and counts of classes before and after.

    Place c stands for class c before the word, place CLASSES + c for class c after it.
    """
    now, last = block.tokens[block.trains], block.before[block.trains]
    width, classes = np.int32(2 * CLASSES), classes.astype(np.int32)
    keys = np.concatenate((now * width + classes[last], last * width + np.int32(CLASSES) + classes[now]))
    keys, numbers = np.unique(keys, return_counts=True)
    word, place = keys // width, (keys % width).astype(np.uint8)
    counts = np.bincount(now, minlength=len(block.vocabulary))
    sizes = np.bincount(word, minlength=len(block.vocabulary))
    # END is also before the first word when it ends no training text, so count may be 0 there.
    used = np.flatnonzero((counts > 0) | (sizes > 0))
    starts = np.cumsum(sizes) - sizes
    rows = []
    for shard, picked in _by_shard(block.vocabulary[used], shards):
        own = used[picked]
        entries = np.repeat(starts[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(sizes[own].sum())
        rows.append(
            (
                shard, block.vocabulary[own].tobytes(), counts[own].astype(np.uint32).tobytes(),
                sizes[own].astype(np.uint16).tobytes(), place[entries].tobytes(),
                numbers[entries].astype(np.uint32).tobytes(),
            )
        )
    columns = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
        ["shard", "words", "counts", "sizes", "places", "numbers"],
    )


def _added_up(messages: pa.Table) -> pa.Table:
    """A shard's words with their counts and neighbours, added up over all blocks."""

    def joined(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(messages.column(name).to_pylist()), kind)

    sent, counts, sizes = joined("words", np.uint64), joined("counts", np.uint32), joined("sizes", np.uint16)
    words, number = np.unique(sent, return_inverse=True)
    totals = np.bincount(number, counts, len(words)).astype(np.int64)
    keys = np.repeat(number, sizes) * (2 * CLASSES) + joined("places", np.uint8)
    keys, entry = np.unique(keys, return_inverse=True)
    numbers = np.bincount(entry, joined("numbers", np.uint32), len(keys))
    widths = np.bincount(keys // (2 * CLASSES), minlength=len(words))
    return pa.table(
        {
            "shard": pa.array([messages.column("shard")[0].as_py()], pa.int32()),
            "words": pa.array([words.tobytes()], pa.binary()),
            "counts": pa.array([totals.tobytes()], pa.binary()),
            "sizes": pa.array([widths.astype(np.uint16).tobytes()], pa.binary()),
            "places": pa.array([(keys % (2 * CLASSES)).astype(np.uint8).tobytes()], pa.binary()),
            "numbers": pa.array([_planes_of_long(numbers)], pa.binary()),
            "starting": pa.array([None], pa.binary()),
        }
    )


@dataclass
class Shard:
    """Words of a shard: counts, classes, and sparse neighbour counts as word, place and number."""

    words: np.ndarray
    counts: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    numbers: np.ndarray

    @staticmethod
    def of(row: dict) -> Shard:
        words, sizes = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["sizes"], np.uint16)
        return Shard(
            words,
            np.frombuffer(row["counts"], np.int64),
            np.repeat(np.arange(len(words)), sizes),
            np.frombuffer(row["places"], np.uint8).astype(np.int64),
            _longs(row["numbers"]).astype(float),
        )

    def sums(self, classes: np.ndarray) -> np.ndarray:
        """Neighbour counts of each class."""
        flat = classes[self.owner] * (2 * CLASSES) + self.place
        return np.bincount(flat, self.numbers, CLASSES * 2 * CLASSES).reshape(CLASSES, -1)

    def exchanged(self, classes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Move every word to the class that explains its neighbours best; ties to the first class."""
        totals = table.sum(axis=1) + ADDED * table.shape[1]
        logs = np.log(table + ADDED) - np.log(totals)[:, None]
        own_class = classes[self.owner]
        mass = np.bincount(self.owner, self.numbers, len(self.words))
        # In its own class a word is judged as if it were not there.
        without = table[own_class, self.place] - self.numbers + ADDED
        rest = np.maximum(totals[classes] - mass, ADDED)
        stay = np.bincount(self.owner, self.numbers * np.log(np.maximum(without, ADDED / 2)), len(self.words))
        stay -= mass * np.log(rest)
        out = np.empty(len(self.words), np.int64)
        bounds = np.searchsorted(self.owner, np.arange(0, len(self.words) + 4096, 4096))
        for k, first in enumerate(range(0, len(self.words), 4096)):
            last = min(first + 4096, len(self.words))
            part = slice(bounds[k], bounds[k + 1])
            dense = np.zeros((last - first, 2 * CLASSES))
            dense[self.owner[part] - first, self.place[part]] = self.numbers[part]
            worth = dense @ logs.T
            worth[np.arange(last - first), classes[first:last]] = stay[first:last]
            out[first:last] = worth.argmax(axis=1)
        return out


@dataclass(frozen=True)
class Exchange:
    """How a shard's words come to their classes: seeds, or earlier rounds, then tables of each round."""

    seeds: np.ndarray
    tables: tuple[np.ndarray, ...] = ()

    def starting(self, words: np.ndarray) -> np.ndarray:
        """Seeds have a class each; all other words begin in the last class."""
        order = np.argsort(self.seeds)
        if not len(order):
            return np.full(len(words), CLASSES - 1)
        places = np.minimum(np.searchsorted(self.seeds[order], words), len(order) - 1)
        return np.where(self.seeds[order][places] == words, order[places], CLASSES - 1)

    def classes(self, shard: Shard, starting: bytes | None) -> np.ndarray:
        own = (
            self.starting(shard.words) if starting is None else np.frombuffer(starting, np.uint8).astype(np.int64)
        )
        for table in self.tables:
            own = shard.exchanged(own, table)
        return own


def _class_sums(exchange):
    def run(batches):
        for row in _rows(batches):
            shard = Shard.of(row)
            sums = shard.sums(exchange.value.classes(shard, row["starting"]))
            at = np.flatnonzero(sums.ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array(sums.ravel()[at], pa.float64())], ["at", "n"]
            )

    return run


def _table(spark: SparkSession, shards: DataFrame, exchange: Exchange) -> np.ndarray:
    """Neighbour counts of all classes: CLASSES by 2 CLASSES numbers, whatever the corpus."""
    sent = spark.sparkContext.broadcast(exchange)
    rows = shards.mapInArrow(_class_sums(sent), "at long, n double").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES * 2 * CLASSES)
    for row in rows.collect():
        out[row.at] = row.n
    return out.reshape(CLASSES, -1)


def _with_classes(exchange):
    def run(batches):
        for row in _rows(batches):
            classes = exchange.value.classes(Shard.of(row), row["starting"]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]], pa.int32()),
                    pa.array([row["words"]], pa.binary()),
                    pa.array([row["counts"]], pa.binary()),
                    pa.array([classes.tobytes()], pa.binary()),
                ],
                ["shard", "words", "counts", "classes"],
            )

    return run


def _requests(shards: int):
    def run(batches):
        for row in _rows(batches):
            vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
            parts = _by_shard(vocabulary, shards)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard for shard, _ in parts], pa.int32()),
                    pa.array([row["block"]] * len(parts), pa.int64()),
                    pa.array([vocabulary[p].tobytes() for _, p in parts], pa.binary()),
                ],
                ["shard", "block", "words"],
            )

    return run


def _answers(requests: pa.Table, known: pa.Table) -> pa.Table:
    """Classes and counts of the words that blocks ask a shard for; unknown words have neither."""
    words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    classes = np.empty(0, np.uint8)
    if known.num_rows:
        words = np.frombuffer(known.column("words")[0].as_py(), np.uint64)
        counts = np.frombuffer(known.column("counts")[0].as_py(), np.int64)
        classes = np.frombuffer(known.column("classes")[0].as_py(), np.uint8)
    words, counts = np.append(words, ~np.uint64(0)), np.append(counts, 0)
    classes = np.append(classes, np.uint8(NO_CLASS))
    out = {"block": [], "shard": [], "classes": [], "counts": []}
    for row in requests.to_pylist():
        asked = np.frombuffer(row["words"], np.uint64)
        places = np.searchsorted(words[:-1], asked)
        places = np.where(words[places] == asked, places, len(words) - 1)
        out["block"].append(row["block"])
        out["shard"].append(row["shard"])
        out["classes"].append(classes[places].tobytes())
        out["counts"].append(counts[places].tobytes())
    return pa.table(
        {
            "block": pa.array(out["block"], pa.int64()), "shard": pa.array(out["shard"], pa.int32()),
            "classes": pa.array(out["classes"], pa.binary()), "counts": pa.array(out["counts"], pa.binary()),
        }
    )


def _answered(blocks: DataFrame, classed: DataFrame, shards: int) -> DataFrame:
    """Blocks with the answers of all shards about their vocabularies."""
    requests = blocks.select("block", "vocabulary").mapInArrow(
        _requests(shards), "shard int, block long, words binary"
    )
    answers = requests.groupBy("shard").cogroup(classed.groupBy("shard")).applyInArrow(
        _answers, "block long, shard int, classes binary, counts binary"
    )
    # One answer of each shard at most, together as long as the block's vocabulary.
    gathered = answers.groupBy("block").agg(
        F.collect_list(F.struct("shard", "classes", "counts")).alias("answers")
    )
    return blocks.join(gathered, "block")


def _vocabulary_answers(row: dict, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and counts in the order of a block's vocabulary."""
    vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
    classes, counts = np.full(len(vocabulary), NO_CLASS, np.int64), np.zeros(len(vocabulary), np.int64)
    places = dict(_by_shard(vocabulary, shards))
    for answer in row["answers"]:
        own = places[answer["shard"]]
        classes[own] = np.frombuffer(answer["classes"], np.uint8)
        counts[own] = np.frombuffer(answer["counts"], np.int64)
    return classes, counts


def _first_neighbours(exchange, shards: int):
    def run(batches):
        for row in _rows(batches):
            block = Block.of(row)
            yield _neighbours(block, exchange.value.starting(block.vocabulary), shards)

    return run


def _next_neighbours(shards: int):
    def run(batches):
        for row in _rows(batches):
            classes, _ = _vocabulary_answers(row, shards)
            # Words that no training text holds are no training text's neighbours.
            yield _neighbours(Block.of(row), np.where(classes == NO_CLASS, 0, classes), shards)

    return run


def _restart(shard: pa.Table, before: pa.Table) -> pa.Table:
    """A shard's new neighbour counts, to start from the classes that its words have."""
    if not shard.num_rows:
        return shard
    words = np.frombuffer(shard.column("words")[0].as_py(), np.uint64)
    known = np.frombuffer(before.column("words")[0].as_py(), np.uint64)
    classes = np.frombuffer(before.column("classes")[0].as_py(), np.uint8)
    own = classes[np.searchsorted(known, words)]
    return shard.set_column(
        shard.schema.get_field_index("starting"), "starting", pa.array([own.tobytes()], pa.binary())
    )


_SHARD = (
    "shard int, words binary, counts binary, sizes binary, places binary, numbers binary, starting binary"
)


@dataclass(frozen=True)
class ClassModel:
    """Log10 probabilities of transitions, and per class: tokens and the share of unseen words."""

    tokens: int
    distinct: int
    class_tokens: np.ndarray
    unseen: np.ndarray
    transitions: np.ndarray

    @staticmethod
    def of(tokens: int, distinct: int, class_tokens, singles, table: np.ndarray | None) -> ClassModel:
        """The share of unseen words in a class is that of words seen once, by Good and Turing."""
        unseen = np.where(class_tokens > 0, (singles + 1) / (class_tokens + 2), 1.0)
        share = (class_tokens + 1) / (class_tokens.sum() + len(class_tokens))
        table = np.zeros((CLASSES, CLASSES)) if table is None else table
        smooth = (table + BACK_OFF * share) / (table.sum(axis=1, keepdims=True) + BACK_OFF)
        return ClassModel(tokens, distinct, class_tokens, unseen, smooth)


def _coded(shards: int, model):
    """Per document: the classes of its tokens, and what doesn't depend on their order."""

    def run(batches):
        own = model.value
        for row in _rows(batches):
            classes, counts = _vocabulary_answers(row, shards)
            tokens = _numbers(row["tokens"])
            seen = counts > 0
            inside = np.where(seen, classes, 0)
            emitted = np.where(
                seen,
                np.log10(np.maximum(counts, 1) / np.maximum(own.class_tokens[inside], 1))
                + np.log10(np.maximum(1 - own.unseen[inside], 1e-300)),
                0.0,
            )
            base = np.log10((counts + 1) / (own.tokens + own.distinct + 1))
            sequence = np.where(seen, classes, NO_CLASS).astype(np.uint8)[tokens]
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]

            def per_document(values: np.ndarray, kind) -> np.ndarray:
                return np.add.reduceat(values[tokens].astype(kind), starts)

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["held"], pa.bool_()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array(per_document(seen, np.int64)),
                    pa.array(per_document(base, np.float64)),
                    pa.array(per_document(emitted, np.float64)),
                    pa.array([sequence[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emitted", "sequence"],
            )

    return run


_CODED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, "
    "sequence binary"
)


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all documents of a batch one after the other, and where each begins."""
    texts = batch.column("sequence").to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8).astype(np.int64), np.cumsum(lengths) - lengths


def _transition_counts(end_class: int):
    def run(batches):
        for part in common.slices(batches, "sequence"):
            now, starts = _sequences(part)
            last = np.concatenate(([end_class], now[:-1]))
            last[starts] = end_class
            used = (now != NO_CLASS) & (last != NO_CLASS)
            counts = np.bincount(last[used] * CLASSES + now[used], minlength=CLASSES**2)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["at", "n"])

    return run


def _scores(end_class: int, model):
    """Log10 probabilities. An unseen word may be of any class; the most likely one goes on."""

    def run(batches):
        own = model.value
        unseen = own.transitions @ own.unseen
        guess = (own.transitions * own.unseen).argmax(axis=1)
        logs, unseen = np.log10(own.transitions), np.log10(np.maximum(unseen, 1e-300))
        for part in common.slices(batches, "sequence"):
            now, starts = _sequences(part)
            state, open_places = now.copy(), now == NO_CLASS
            first = np.zeros(len(now), bool)
            first[starts] = True
            # A word of a run of unseen ones is as many guesses away from the last known class as it stands
            # behind it: guesses of 1, 2, 4, ... steps are made from each other.
            places = np.arange(len(now))
            known = np.maximum.accumulate(np.where(open_places & ~first, -1, places))
            steps = np.where(open_places, places - known + (now[known] == NO_CLASS), 0)
            reached = np.where(now[known] == NO_CLASS, end_class, now[known])
            jump = guess
            while steps.any():
                reached = np.where(steps & 1, jump[reached], reached)
                steps, jump = steps >> 1, jump[jump]
            state[open_places] = reached[open_places]
            last = np.concatenate(([end_class], state[:-1]))
            last[first] = end_class
            gained = np.where(now == NO_CLASS, unseen[last], logs[last, np.where(now == NO_CLASS, 0, now)])
            moved = np.add.reduceat(gained, starts) if len(starts) else gained
            total = moved + part.column("emitted").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in _KEPT], pa.array(total, pa.float64())], [*_KEPT, "score"]
            )

    return run


_KEPT = ("doc_id", "held_out", "n_tokens", "n_known", "base_score")


def class_scores(
    docs: DataFrame,
    held_out: str = "held_out",
    id_column: str = "doc_id",
    text_column: str = "text",
    rounds: tuple[int, ...] = ROUNDS,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    A text is its words and one end. The model learns from the rows where `held_out` is false; null
    counts as true. Scores are log10 probabilities of whole texts over the same events as the base:
    the training words and one event for all others. `perplexity` is 10^(-score / n_tokens). A null
    text is one end. Ids may be null or repeated, each row is a document; other columns are not
    read. Without training rows every token is an unseen word and has score 0. No rows give none.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(held_out), F.lit(True)).alias("held_out"),
        common.text_bytes(text_column).alias("text"),
    )
    blocks = written(source.mapInArrow(_blocks, _BLOCK), "token-blocks", compression="zstd")
    # A word's message takes 14 bytes and up to 10 for each of its tokens in the block.
    sent = F.length("vocabulary") / 8 * 14 + F.length("tokens") / 4 * 10
    shards = max(1, -(-int(blocks.agg(F.coalesce(F.sum(sent), F.lit(0.0))).first()[0]) // SHARD_BYTES))
    proposed = blocks.mapInArrow(_proposals, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seeds = proposed.orderBy(F.col("n").desc(), "word").limit(CLASSES - 1).collect()
    exchange = Exchange(np.array([r.word for r in seeds], np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(exchange)
    messages = blocks.mapInArrow(_first_neighbours(sent, shards), _NEIGHBOURS)
    table = written(messages.groupBy("shard").applyInArrow(_added_up, _SHARD), "word-neighbours", compression="zstd")
    for step, n in enumerate(rounds):
        for _ in range(n):
            found = _table(spark, table, exchange)
            exchange = Exchange(exchange.seeds, (*exchange.tables, found))
        sent = spark.sparkContext.broadcast(exchange)
        classed = cut_lineage(
            table.mapInArrow(_with_classes(sent), "shard int, words binary, counts binary, classes binary")
        )
        answered = _answered(blocks, classed, shards)
        if step + 1 < len(rounds):
            messages = answered.mapInArrow(_next_neighbours(shards), _NEIGHBOURS)
            fresh = messages.groupBy("shard").applyInArrow(_added_up, _SHARD)
            table = written(
                fresh.groupBy("shard").cogroup(classed.groupBy("shard")).applyInArrow(_restart, _SHARD),
                "word-neighbours",
                compression="zstd",
            )
            exchange = Exchange(exchange.seeds)
    stats = classed.mapInArrow(_class_stats, "class int, tokens long, words long, singles long, ends long")
    stats = stats.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tokens", "words", "singles", "ends")]).collect()
    tokens, singles = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in stats:
        tokens[row["class"]], singles[row["class"]] = row.tokens, row.singles
    distinct = sum(row.words for row in stats)
    end_class = next((row["class"] for row in stats if row.ends), 0)
    model = ClassModel.of(int(tokens.sum()), distinct, tokens, singles, None)
    coded = written(answered.mapInArrow(_coded(shards, spark.sparkContext.broadcast(model)), _CODED), "coded", compression="zstd")
    counts = coded.where("not held_out").select("sequence").mapInArrow(_transition_counts(end_class), "at long, n long")
    moves = np.zeros(CLASSES**2)
    for row in counts.groupBy("at").agg(F.sum("n").alias("n")).collect():
        moves[row.at] = row.n
    model = ClassModel.of(int(tokens.sum()), distinct, tokens, singles, moves.reshape(CLASSES, CLASSES))
    scored = coded.mapInArrow(
        _scores(end_class, spark.sparkContext.broadcast(model)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def _class_stats(batches):
    """Per class: tokens, words, words seen once, and whether the end of texts is in it."""
    for row in _rows(batches):
        classes = np.frombuffer(row["classes"], np.uint8).astype(np.int64)
        counts = np.frombuffer(row["counts"], np.int64)
        words = np.frombuffer(row["words"], np.uint64)

        def per_class(which: np.ndarray) -> pa.Array:
            return pa.array(np.bincount(classes, which, CLASSES).astype(np.int64))

        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(CLASSES), pa.int32()), per_class(counts), per_class(counts > 0),
                per_class(counts == 1), per_class(words == END),
            ],
            ["class", "tokens", "words", "singles", "ends"],
        )
