"""BPE encoding that speculates and verifies, for the vocabulary with word ends.

A word is first cut by greedy longest match. All adjacent token pairs of all new words are then
tested at once against the pairs known to be compatible: a cut is what the merges would give if
and only if every token is what the merges make of its own bytes and no adjacent pair would have
merged otherwise. Only words with a failing pair go through the exact merges.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerwise.llm import common

VOCABULARY = "word_bpe_49k.json"
# Words and tested pairs remembered by a worker; the memory for them is bounded by these numbers.
REMEMBERED, PAIRS = 150_000, 1_000_000
# Words up to so many letters are cut and merged many at a time, longer ones one by one.
LONG, CHUNK = 48, 4096
NO_RANK = 1 << 40
# Symbols of the prefix tree: bytes, the word end, and one that no token has.
WORD_END, NO_SYMBOL, SYMBOLS = 256, 257, 258
SLICE_BYTES = 1 << 20

# Characters whose classes are the same in all versions of Unicode: Latin, Greek, Cyrillic and
# common punctuation. Texts of other characters are split by the tokenizer's own rules.
_PLAIN = re.compile("[\u0000-\u017f\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f\u2010-\u2027\u20ac]*")
_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0250-\u02af\u0391-\u03c9\u0410-\u044f"
_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_BLANK = "\t-\r \u0085\u00a0"
# Fixed by the vocabulary's own description: how such texts are split into words.
_SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+"
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class WordEncoder:
    """Token ids of words, by speculation, verification and exact merging where that fails."""

    def __init__(self, description: str):
        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        content = json.loads(description)
        model = content["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: s for s, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.names |= {i: s for s, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.width = max(self.names) + 1
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        keys = np.array([one * self.width + two for one, two in self.merges], np.int64)
        order = np.argsort(keys)
        self.merge_keys = np.append(keys[order], np.int64(1 << 62))
        values = np.array([*self.merges.values(), (NO_RANK, -1)], np.int64)
        self.merge_ranks, self.merge_made = values[np.append(order, len(order))].T
        self.letters = byte_letters()
        self.bytes = {letter: b for b, letter in enumerate(self.letters)}
        # Tokens that the merges don't make from their own letters can't be guessed.
        self.spelled = [self._symbols(self.names[i]) if i in self.names else [] for i in range(self.width)]
        made = self._merged_all([self.spelled[i] for i in self.ids.values()])
        self._grow_tree({s: i for (s, i), tokens in zip(self.ids.items(), made) if tokens == [i]})
        self.known: dict[str, tuple[int, ...]] = {}
        self.forget()

    def _symbols(self, token: str) -> list[int]:
        """Ids of single letters; the last one carries the word end if the token does."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            letters = [*body[:-1], body[-1] + self.suffix]
        else:
            letters = list(token)
        return [self.ids[x] for x in letters if x in self.ids]

    def _merged(self, symbols: list[int]) -> list[int]:
        """The exact result: the merge of lowest rank first, the leftmost of equals first."""
        n = len(symbols)
        after, before, tokens = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
        queue = []

        def offer(at: int) -> None:
            nxt = after[at]
            if nxt < n and (merge := self.merges.get((tokens[at], tokens[nxt]))):
                heappush(queue, (merge[0], at, tokens[at], tokens[nxt], merge[1]))

        for at in range(n - 1):
            offer(at)
        while queue:
            _, at, one, two, made = heappop(queue)
            nxt = after[at]
            if tokens[at] != one or nxt >= n or tokens[nxt] != two:
                continue
            tokens[at], tokens[nxt] = made, -1
            after[at] = after[nxt]
            if after[nxt] < n:
                before[after[nxt]] = at
            if before[at] >= 0:
                offer(before[at])
            offer(at)
        return [t for t in tokens if t >= 0]

    def _merged_all(self, words: list[list[int]]) -> list[list[int]]:
        """The exact results of many words, one merge of every word at a time."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for first in range(0, len(order), CHUNK):
            rows = order[first : first + CHUNK]
            size = int(lengths[rows[-1]])
            if size > LONG:
                for k in rows.tolist():
                    out[k] = self._merged(words[k])
                continue
            tokens = np.full((len(rows), size + 2), -1, np.int64)
            for at, k in enumerate(rows.tolist()):
                tokens[at, : len(words[k])] = words[k]
            ranks, _ = self._merge_of(tokens[:, :-1], tokens[:, 1:])
            places = np.arange(size + 1)
            active = np.arange(len(rows))
            while len(active):
                own = ranks[active]
                at = own.argmin(axis=1)
                going = own[np.arange(len(at)), at] < NO_RANK
                active, at, own = active[going], at[going], own[going]
                if not len(active):
                    break
                old, line = tokens[active], np.arange(len(active))
                _, made = self._merge_of(old[line, at], old[line, at + 1])
                shift = places + (places > at[:, None])
                now = np.full_like(old, -1)
                now[:, :-1] = old[line[:, None], shift]
                now[line, at] = made
                own = np.where(shift <= size, own[line[:, None], np.minimum(shift, size)], NO_RANK)
                own[line, at] = self._merge_of(made, now[line, at + 1])[0]
                left = np.maximum(at - 1, 0)
                own[line, left] = self._merge_of(now[line, left], now[line, left + 1])[0]
                tokens[active], ranks[active] = now, own
            counts = (tokens >= 0).sum(axis=1).tolist()
            for k, row, n in zip(rows.tolist(), tokens.tolist(), counts):
                out[k] = row[:n]
        return out

    def _merge_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging tokens; NO_RANK where they don't merge."""
        keys = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        places = np.searchsorted(self.merge_keys, keys)
        places = np.where(self.merge_keys[places] == keys, places, len(self.merge_keys) - 1)
        return self.merge_ranks[places], self.merge_made[places]

    def _grow_tree(self, tokens: dict[str, int]) -> None:
        """A prefix tree over the bytes of the tokens; the word end is one more symbol."""
        edges: dict[int, int] = {}
        ends = [-1]
        for token, number in tokens.items():
            body, mark = token, []
            if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
                body, mark = token[: -len(self.suffix)], [WORD_END]
            node = 0
            for symbol in [*(self.bytes.get(x, NO_SYMBOL) for x in body), *mark]:
                key = node * SYMBOLS + symbol
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            ends[node] = number
        self.tree_keys = np.array([*sorted(edges), 1 << 62], np.int64)
        self.tree_to = np.array([*(edges[k] for k in sorted(edges)), 0], np.int64)
        self.tree_ends = np.array(ends, np.int64)

    def _greedy_all(self, words: list[bytes]) -> list[list[int]]:
        """Longest tokens from left to right, all words a symbol at a time; none where it fails."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        order = order[: np.searchsorted(lengths[order], LONG, "right")]
        for first in range(0, len(order), CHUNK):
            rows = order[first : first + CHUNK]
            letters = lengths[rows]
            size = int(letters[-1]) + 2
            symbols = np.full((len(rows), size), NO_SYMBOL, np.int64)
            flat = np.frombuffer(b"".join([words[k] for k in rows.tolist()]), np.uint8)
            symbols[np.arange(size) < letters[:, None]] = flat
            total = letters + bool(self.suffix)
            if self.suffix:
                symbols[np.arange(len(rows)), letters] = WORD_END
            found = np.full((len(rows), size), -1, np.int64)
            node, at, counts = (np.zeros(len(rows), np.int64) for _ in range(3))
            stop, token = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
            active = np.arange(len(rows))
            while len(active):
                keys = node[active] * SYMBOLS + symbols[active, at[active]]
                places = np.searchsorted(self.tree_keys, keys)
                hit = self.tree_keys[places] == keys
                on = active[hit]
                node[on] = self.tree_to[places[hit]]
                at[on] += 1
                # No token ends after the last letter but before the word end.
                ends = self.tree_ends[node[on]]
                good = (ends >= 0) & ((at[on] != letters[on]) | (total[on] == letters[on]))
                stop[on[good]], token[on[good]] = at[on[good]], ends[good]
                off = active[~hit]
                done = off[token[off] >= 0]
                found[done, counts[done]] = token[done]
                counts[done] += 1
                at[off], node[off] = stop[off], 0
                lost = off[token[off] < 0]
                counts[lost] = 0
                token[off] = -1
                over = np.zeros(len(rows), bool)
                over[done[stop[done] >= total[done]]] = True
                over[lost] = True
                active = active[~over[active]]
            for k, row, n in zip(rows.tolist(), found.tolist(), counts.tolist()):
                out[k] = row[:n]
        return out

    def _compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the merges keep both tokens of each pair apart; remembers what it has tested."""
        if len(self.pairs) > PAIRS:
            self.pairs, self.apart = np.empty(0, np.int64), np.empty(0, bool)
        known = np.zeros(len(pairs), bool)
        if len(self.pairs):
            places = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            known = self.pairs[places] == pairs
        fresh = pairs[~known]
        if len(fresh):
            both = [divmod(pair, self.width) for pair in fresh.tolist()]
            made = self._merged_all([self.spelled[one] + self.spelled[two] for one, two in both])
            apart = np.array([tokens == [one, two] for tokens, (one, two) in zip(made, both)], bool)
            every = np.concatenate((self.pairs, fresh))
            order = np.argsort(every)
            self.pairs, self.apart = every[order], np.concatenate((self.apart, apart))[order]
        return self.apart[np.searchsorted(self.pairs, pairs)]

    def forget(self) -> None:
        self.pairs, self.apart = np.empty(0, np.int64), np.empty(0, bool)
        self.known = {}

    def learn(self, words: list[str]) -> None:
        """Encode new words and remember them."""
        spelled = [w.encode() for w in words]
        guesses = self._greedy_all(spelled)
        sizes = np.fromiter(map(len, guesses), np.int64, len(words))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, sizes.sum())
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[:-1] == owner[1:]
        unique, back = np.unique((flat[:-1] * self.width + flat[1:])[inner], return_inverse=True)
        failing = ~self._compatible(unique)[back]
        failures = np.bincount(owner[:-1][inner], failing, len(words))
        exact = np.flatnonzero((sizes == 0) | (failures > 0)).tolist()
        letters, ids, suffix = self.letters, self.ids, self.suffix
        symbols = []
        for k in exact:
            own = [letters[b] for b in spelled[k]]
            own[-1] += suffix
            symbols.append([ids[x] for x in own if x in ids])
        for k, tokens in zip(exact, self._merged_all(symbols)):
            guesses[k] = tokens
        self.known.update(zip(words, map(tuple, guesses)))

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if _PLAIN.fullmatch(text):
            # One letter after the other: no rule for word ends, as for the final sigma.
            lowered = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
            return _SPLIT.findall(lowered)
        normal = self.tokenizer.normalizer.normalize_str(text)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes([self.bytes[x] for x in w]).decode() for w, _ in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts; special tokens in a text are themselves."""
        split: list[list] = []
        for text in texts:
            pieces: list = []
            for piece in self.special_split.split(text):
                if piece in self.special:
                    pieces.append(self.special[piece])
                elif piece:
                    pieces.append(self.words(piece))
            split.append(pieces)
        used = set().union(*(words for pieces in split for words in pieces if isinstance(words, list)))
        fresh = used.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = used
        if fresh:
            self.learn(sorted(fresh))
        find, out = self.known.__getitem__, []
        for pieces in split:
            ids: list[int] = []
            for words in pieces:
                if isinstance(words, list):
                    ids.extend(chain.from_iterable(map(find, words)))
                else:
                    ids.append(words)
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens as the vocabulary writes them, with a space between: it names no decoder."""
        names = self.names
        return " ".join([names[i] for i in ids])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(description: str) -> WordEncoder:
    """One encoder for each vocabulary in a worker."""
    mark = hashlib.sha256(description.encode()).hexdigest()
    if mark not in _ENCODERS:
        _ENCODERS[mark] = WordEncoder(description)
    return _ENCODERS[mark]


def load(spark: SparkSession, path: str):
    """Send a vocabulary file to the executors; it is a few MB whatever the data.

    A name without a folder is one of the installed public vocabularies.
    """
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _texts(part: pa.RecordBatch) -> list[str]:
    return [b.decode("utf-8", "replace") for b in common.blobs(part.column("text"))]


def _digests(encoder: WordEncoder, all_ids: list[list[int]]) -> list[pa.Array]:
    """Number of ids, and SHA-256 of the ids in decimal and of the text that they decode to."""
    counts, ids_hex, texts_hex = [], [], []
    for ids in all_ids:
        counts.append(len(ids))
        ids_hex.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        texts_hex.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(texts_hex, pa.string())]


def _encode(description, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(description.value)
        for part in common.slices(batches, limit=SLICE_BYTES):
            ids = encoder.encode(_texts(part))
            made = {"doc_id": part.column("doc_id")}
            if "ids" in columns:
                made["ids"] = pa.array(ids, pa.list_(pa.int32()))
            if "n_tokens" in columns:
                made |= zip(DIGESTS, _digests(encoder, ids))
            yield pa.RecordBatch.from_pydict(made)
        # The worker may go on to other work, which needs the memory more.
        encoder.forget()
        common.released()

    return run


DIGESTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encoded(
    docs: DataFrame,
    path: str = VOCABULARY,
    id_column: str = "doc_id",
    text_column: str = "text",
    ids: bool = True,
    digests: bool = False,
) -> DataFrame:
    """Per row: doc_id and `ids`, the token ids of the whole text.

    With `digests` also n_tokens, and SHA-256 digests of the ids and of the text that they decode to;
    `ids` may then be left out. Null counts as empty, which has no ids. Ids of documents may be null
    or repeated; each row is answered by itself, and other columns are not read. No rows give no rows.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), common.text_bytes(text_column).alias("text"))
    kinds = {"doc_id": dict(source.dtypes)["doc_id"]}
    kinds |= {"ids": "array<int>"} if ids else {}
    kinds |= DIGESTS if digests else {}
    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    return source.mapInArrow(_encode(load(docs.sparkSession, path), list(kinds)), schema)
