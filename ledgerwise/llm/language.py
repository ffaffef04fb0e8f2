"""Language identification by cross-parsing: which language's text explains this text in fewest phrases.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is
parsed from left to right into longest phrases that occur somewhere in that sample. A phrase costs
the logarithm of the sample's length, the size of a pointer into it, and the language with the
least cost per character wins. Texts are parsed whole, in segments of a fixed length that all
advance together, one character at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.llm import common

# Characters of each language that are learned, as whole texts.
LEARNED_POINTS = 64_000
MAX_LANGUAGES = 512
# Cells of a transition table that is laid out in full; a larger one is searched.
FULL_CELLS = 1 << 24
SEGMENT = 256
SLICE_BYTES = 2 << 20
UNKNOWN = "und"
# Symbols: the end of a text, anything but letters, letters that no sample holds; letters follow.
END, GAP, FOREIGN = 0, 1, 2


def lower_letter(point: int) -> str | None:
    """The lower-case form of a letter as one character; nothing for other characters."""
    letter = chr(point)
    if not letter.isalpha():
        return None
    lowered = letter.lower()
    return lowered if len(lowered) == 1 else letter


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of a sequence; 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return moves


@dataclass(frozen=True)
class LanguageModel:
    """Suffix automata by language, over one alphabet. `edges` hold state, symbol and next state."""

    names: list[str]
    alphabet: list[str]
    sizes: list[int]
    states: list[int]
    edges: list[np.ndarray]

    @staticmethod
    def learn(samples: dict[str, list[str]]) -> LanguageModel:
        """Build from texts by language."""
        names = sorted(samples)
        texts = {name: " ".join(samples[name]) for name in names}
        letters = {lower_letter(ord(x)) for text in texts.values() for x in text}
        alphabet = sorted(x for x in letters if x)
        number = {x: k + FOREIGN + 1 for k, x in enumerate(alphabet)}
        sizes, states, edges = [], [], []
        for name in names:
            symbols = [number.get(lower_letter(ord(x)) or "", GAP) for x in texts[name]]
            moves = suffix_automaton(symbols)
            sizes.append(len(symbols))
            states.append(len(moves))
            flat = [(at, symbol, to) for at, row in enumerate(moves) for symbol, to in row.items()]
            edges.append(np.array(flat, np.int32).reshape(-1, 3))
        return LanguageModel(names, alphabet, sizes, states, edges)

    @cached_property
    def symbol_of(self) -> np.ndarray:
        """Symbol of every code point."""
        number = {x: k + FOREIGN + 1 for k, x in enumerate(self.alphabet)}
        lowered = map(lower_letter, range(0x110000))
        symbols = (GAP if x is None else number.get(x, FOREIGN) for x in lowered)
        return np.fromiter(symbols, np.int32, 0x110000)

    @cached_property
    def tables(self) -> list[tuple[np.ndarray, int, np.ndarray | None, np.ndarray]]:
        """Per language: the column of each symbol, the width of a row, keys and next states.

        A key is the state times the width plus the column, and the next state comes times the width; 0 is
        no way. Column 0 is for symbols that the language's sample lacks. Without keys, next states are laid
        out in full.
        """
        out = []
        for states, edges in zip(self.states, self.edges):
            own = np.unique(edges[:, 1])
            column = np.zeros(len(self.alphabet) + FOREIGN + 1, np.int64)
            column[own] = np.arange(1, len(own) + 1)
            width = len(own) + 1
            keys, following = edges[:, 0].astype(np.int64) * width + column[edges[:, 1]], edges[:, 2].astype(np.int64) * width
            if states * width <= FULL_CELLS:
                table = np.zeros(states * width, np.int32)
                table[keys] = following
                out.append((column, width, None, table))
            else:
                order = np.argsort(keys)
                out.append((column, width, np.append(keys[order], 1 << 62), np.append(following[order], 0)))
        return out

    def phrases(self, symbols: np.ndarray) -> np.ndarray:
        """Phrases by language and segment. `symbols` has a row for each place in a segment."""
        out = np.zeros((len(self.names), symbols.shape[1]), np.int64)
        for k, (column, _, keys, table) in enumerate(self.tables):

            def step(at: np.ndarray) -> np.ndarray:
                if keys is None:
                    return table[at]
                places = np.searchsorted(keys, at)
                return np.where(keys[places] == at, table[places], 0)

            state = np.zeros(symbols.shape[1], table.dtype)
            count = np.zeros(symbols.shape[1], np.int32)
            for row in symbols:
                own = column[row]
                following = step(state + own)
                # A phrase begins where the last one can't go on, or where there is none.
                begins = (following == 0) | (state == 0)
                state = np.where(following == 0, step(own), following)
                count += begins & (row != END)
            out[k] = count
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is 1 - least cost / second least cost."""
        symbols = [self.symbol_of[np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)] for t in texts]
        lengths = np.fromiter(map(len, symbols), np.int64, len(texts))
        lettered = np.fromiter(((s > GAP).any() for s in symbols), bool, len(texts))
        counts = -(-lengths // SEGMENT)
        flat = np.zeros(int(counts.sum()) * SEGMENT, np.int32)
        first = np.concatenate(([0], np.cumsum(counts)))
        for at, own in zip((first[:-1] * SEGMENT).tolist(), symbols):
            flat[at : at + len(own)] = own
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not len(flat) or not self.names:
            return names, scores
        by_segment = self.phrases(np.ascontiguousarray(flat.reshape(-1, SEGMENT).T))
        sums = np.concatenate((np.zeros((len(self.names), 1), np.int64), by_segment.cumsum(axis=1)), axis=1)
        phrases = sums[:, first[1:]] - sums[:, first[:-1]]
        costs = phrases * np.log(np.maximum(self.sizes, 2))[:, None] / np.maximum(lengths, 1)
        order = np.argsort(costs, axis=0, kind="stable")
        for k in np.flatnonzero(lettered).tolist():
            least = costs[order[0, k], k]
            second = costs[order[1, k], k] if len(self.names) > 1 else np.inf
            names[k] = self.names[order[0, k]]
            scores[k] = float(1 - least / second) if second > 0 else 0.0
        return names, scores


def learn_languages(labelled: DataFrame, points: int = LEARNED_POINTS) -> LanguageModel:
    """Learn from columns text and lang; rows where text or lang is null are left out.

    Of each language whole distinct texts are drawn by a hash of the text, so ids and the number of copies
    don't matter, as long as they fit into `points` characters together; a text that does not fit is passed
    over. Where every text of a language is longer than that, the shortest one is learned. So the driver
    holds a bounded number of characters, and so of rows, for each of at most MAX_LANGUAGES languages (more
    are an error), beyond that one text.
    """
    usable = labelled.where("text is not null and lang is not null and length(text) > 0").select(
        "lang", "text", F.xxhash64("text", "lang").alias("place"), F.length("text").alias("size")
    )
    fits = F.col("size") <= points
    once = usable.select("lang", "place", "size").distinct()
    totals = once.groupBy("lang").agg(
        F.sum(F.when(fits, F.col("size"))).alias("points"), F.min(F.struct("size", "place")).alias("shortest")
    )
    totals = totals.limit(MAX_LANGUAGES + 1).collect()
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not totals:
        return LanguageModel.learn({})
    # About four times the characters that are learned, so that what is left out can be made up for.
    rates = labelled.sparkSession.createDataFrame(
        [(r.lang, min(1.0, 4 * points / r.points) if r.points else 0.0, r.shortest.place) for r in totals],
        "lang string, rate double, shortest long",
    )
    # At most MAX_LANGUAGES rows are broadcast.
    marked = usable.join(F.broadcast(rates), "lang")
    by_hash = fits & (F.shiftrightunsigned("place", 11) < F.col("rate") * F.lit(float(1 << 53)))
    alone = (F.col("rate") == 0) & (F.col("place") == F.col("shortest"))
    rows = marked.where(by_hash | alone).dropDuplicates(["lang", "place"]).select("lang", "place", "text").collect()
    samples: dict[str, list[str]] = {r.lang: [] for r in totals}
    left = {r.lang: points for r in totals}
    for row in sorted(rows, key=lambda r: (r.lang, common.mix64(np.array([r.place], np.int64).view(np.uint64))[0], r.text)):
        # A character lies between two texts.
        if len(row.text) < left[row.lang] or not samples[row.lang]:
            samples[row.lang].append(row.text)
            left[row.lang] -= len(row.text) + 1
    return LanguageModel.learn({name: texts for name, texts in samples.items() if texts})


_MODELS: dict[int, LanguageModel] = {}


def _predict(model):
    def run(batches):
        # The tables are derived once for each worker, not for each task.
        if model.id not in _MODELS:
            _MODELS.clear()
            _MODELS[model.id] = model.value
        own = _MODELS[model.id]
        for part in common.slices(batches, limit=SLICE_BYTES):
            names, scores = own.predict(common.blobs(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return run


def identified(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred and score between 0 and 1.

    A text that is null or has no letter is `und` with score 0, and so is every text when no
    language was learned. Equal costs go to the first language by code point, with score 0. Ids may
    be null or repeated; only these two columns are read. No rows give no rows.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), common.text_bytes(text_column).alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return source.mapInArrow(_predict(Sent(sent)), f"doc_id {kind}, lang_pred string, score double")


class Sent:
    """A broadcast model and a number that names it in a worker."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().int

    @property
    def value(self) -> LanguageModel:
        return self.broadcast.value
