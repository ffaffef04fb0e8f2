"""Quality classification by co-training two views of a document.

The text view sees which words and symbol runs a document holds. The metadata view sees where the
page comes from and how it is laid out: source, language, length, lines, and shares of character
kinds. Each view is a logistic model, fitted on the driver on at most SAMPLE labelled documents. Over some
rounds both views score all other documents of the corpus on Spark, and each hands the other those that it
is most sure of, as many as a tenth of the sample for each class. Both views are then calibrated on labelled
rows that no model has seen, combined, and applied to all documents. Only the two small models are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.llm import common
from ledgerwise.scale import cut_lineage, written

SAMPLE = 10_000
ROUNDS, SURE = 3, 0.95
# A feature has to occur in so many documents of the sample, and at most so many features count.
LEAST_DOCUMENTS, MOST_FEATURES = 3, 50_000
CALIBRATION_SHARE = 5
# Rows of the sample that are worked on at a time, which bounds the driver's memory.
PART = 500
# Steps of the first fit of a view, and of later ones, which start where the last one ended.
STEPS, MORE_STEPS = 300, 100
# Beginnings of words, in bytes, that count like words.
BEGINNINGS = (4, 6)
THRESHOLD = 0.5

_ALNUM = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_MARKS = bytes(b for b in range(33, 127) if b not in _ALNUM)
# Symbols become blanks in words; everything else becomes a blank in symbol runs.
_TO_WORDS = bytes(32 if b in _MARKS else b for b in range(256))
_TO_MARKS = bytes(b if b in _MARKS else 32 for b in range(256))
_KIND = np.zeros(256, np.int64)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_KIND[list(b"0123456789")] = 3
_KIND[list(b".,;:'-")] = 4
_KIND[list(b"\n")] = 5
_KIND[list(b" \t\r\x0b\x0c")] = 6
_KIND[128:] = 7


def _tag(names: list[str]) -> np.ndarray:
    hashes, bounds = common.hash_words([n.replace(" ", "_").encode() for n in names])
    return hashes[bounds[:-1]]


def _level(value: float) -> int:
    """Steps of a share, finer near zero."""
    return int(round(8 * value**0.5))


def text_features(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct hashes of words, their beginnings, symbol runs, and how often words repeat at once."""
    plain = [t.translate(_TO_WORDS) for t in texts]
    words, at = common.hash_words(plain)
    starts = [common.mix64(common.hash_words(plain, n)[0] + np.uint64(n)) for n in BEGINNINGS]
    marks, mark_at = common.hash_words([t.translate(_TO_MARKS) for t in texts])
    marks = common.mix64(marks + np.uint64(1))
    out, repeats = [], []
    for k in range(len(texts)):
        own = words[at[k] : at[k + 1]]
        again = float((own[1:] == own[:-1]).mean()) if len(own) > 1 else 0.0
        repeats.append(f"again={_level(again)}")
        begun = [s[at[k] : at[k + 1]] for s in starts]
        out.append(np.concatenate((own, *begun, marks[mark_at[k] : mark_at[k + 1]])))
    return [_distinct(np.append(f, tag)) for f, tag in zip(out, _tag(repeats))] if texts else []


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Distinct features in 24 bits, of which a model knows few."""
    return np.unique((hashes >> np.uint64(40)).astype(np.uint32))


def packed(features: np.ndarray) -> bytes:
    """Sorted features as the three bytes of their differences, all first bytes first: they pack well."""
    gaps = np.diff(features, prepend=np.uint32(0)).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T[:3].tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    low, middle, high = np.frombuffer(planes, np.uint8).reshape(3, -1).astype(np.uint32)
    return np.cumsum(low | (middle << 8) | (high << 16), dtype=np.uint32)


def page_features(texts: list[bytes], sources: list, langs: list) -> list[np.ndarray]:
    """Hashes of source, language and layout, each as a few levels."""
    names, counts = [], []
    for text, source, lang in zip(texts, sources, langs):
        kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8)
        size = max(1, len(text))
        lines = int(kinds[5]) + 1
        letters = max(1, int(kinds[1] + kinds[2]))
        own = [
            f"source={source}", f"lang={lang}", f"size={len(text).bit_length()}",
            f"lines={lines.bit_length()}", f"line={(size // lines).bit_length()}",
            f"upper={_level(kinds[2] / letters)}", f"digit={_level(kinds[3] / size)}",
            f"stop={_level(kinds[4] / size)}", f"blank={_level(kinds[6] / size)}",
            f"other={_level(kinds[0] / size)}", f"wide={_level(kinds[7] / size)}",
        ]
        names += own
        counts.append(len(own))
    tags, out, at = _tag(names), [], 0
    for n in counts:
        out.append(_distinct(tags[at : at + n]))
        at += n
    return out


@dataclass(frozen=True)
class View:
    """A logistic model over hashed features: sorted hashes, their weights, and a constant."""

    hashes: np.ndarray
    weights: np.ndarray
    constant: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(rows), self.constant)
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate(rows) if rows else np.empty(0, np.uint32)
        places = np.minimum(np.searchsorted(self.hashes, flat), len(self.hashes) - 1)
        worth = np.where(self.hashes[places] == flat, self.weights[places], 0.0)
        return self.constant + np.bincount(np.repeat(np.arange(len(rows)), counts), worth, len(rows))

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """Calibrated log odds."""
        return self.slope * self.margins(rows) + self.shift


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class ViewRows:
    """The sample's rows in one view, on the features that enough of them hold, and a model of them."""

    def __init__(self, rows: list[np.ndarray], before: View | None = None):
        hashes, n = np.empty(0, np.uint32), np.empty(0, np.int32)
        for first in range(0, len(rows), PART):
            own = np.unique(np.concatenate(rows[first : first + PART]), return_counts=True)
            hashes, place = np.unique(np.concatenate((hashes, own[0])), return_inverse=True)
            n = np.bincount(place, np.concatenate((n, own[1])), len(hashes)).astype(np.int32)
        often = np.flatnonzero(n >= LEAST_DOCUMENTS)
        if len(often) > MOST_FEATURES:
            often = np.sort(often[np.argsort(-n[often], kind="stable")[:MOST_FEATURES]])
        self.hashes, self.n = hashes[often], len(rows)
        self.weights, self.constant = np.zeros(len(often)), 0.0
        if before is not None and len(before.hashes):
            # Go on from the last model, whose features may be fewer.
            places = np.minimum(np.searchsorted(before.hashes, self.hashes), len(before.hashes) - 1)
            self.weights = np.where(before.hashes[places] == self.hashes, before.weights[places], 0.0)
            self.constant = before.constant
        # Row within the part and feature of every entry, part by part.
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        for first in range(0, len(rows), PART):
            part = rows[first : first + PART]
            counts = np.fromiter(map(len, part), np.int64, len(part))
            flat, row = np.concatenate(part), np.repeat(np.arange(len(part)), counts)
            column = np.searchsorted(self.hashes, flat)
            own = column < len(self.hashes)
            own[own] = self.hashes[column[own]] == flat[own]
            # PART rows and MOST_FEATURES features have numbers of 16 bits.
            self.parts.append((row[own].astype(np.uint16), column[own].astype(np.uint16)))

    def model(self) -> View:
        return View(self.hashes, self.weights, float(self.constant))

    def margins(self) -> np.ndarray:
        sums = [np.bincount(row, self.weights[column], PART) for row, column in self.parts]
        return self.constant + np.concatenate(sums)[: self.n]

    def fit(self, which: np.ndarray, labels: np.ndarray, steps: int, rate: float, penalty: float = 0.3) -> None:
        """L2-penalised logistic regression by Adam on some of the rows, from the last weights on.

        The step width falls to zero along a straight line.
        """
        size = len(self.parts) * PART
        chosen, y = np.zeros(size, bool), np.zeros(size)
        chosen[which], y[which] = True, labels
        mean, spread = np.zeros(len(self.weights) + 1), np.zeros(len(self.weights) + 1)
        for step in range(1, steps + 1):
            slope = np.append(penalty * self.weights, 0.0)
            for k, (row, column) in enumerate(self.parts):
                own = slice(k * PART, (k + 1) * PART)
                margins = self.constant + np.bincount(row, self.weights[column], PART)
                error = np.where(chosen[own], _sigmoid(margins) - y[own], 0.0)
                slope[:-1] += np.bincount(column, error[row], len(self.weights))
                slope[-1] += error.sum()
            mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
            pace = rate * (1 - (step - 1) / steps)
            move = pace * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
            self.weights, self.constant = self.weights - move[:-1], self.constant - move[-1]


def fit_dense(columns: np.ndarray, labels: np.ndarray, prior: list[float], penalty: float = 2.0) -> np.ndarray:
    """Weights and constant of a logistic model over a few columns, by Newton steps.

    The penalty pulls towards the prior, which decides where there are few rows.
    """
    wide = np.column_stack((columns, np.ones(len(labels))))
    centre = np.array(prior)
    weights = centre.copy()

    def loss(at: np.ndarray) -> float:
        x = wide @ at
        return float((np.logaddexp(0, x) - labels * x).sum() + penalty / 2 * ((at - centre) ** 2).sum())

    for _ in range(50):
        p = _sigmoid(wide @ weights)
        slope = wide.T @ (p - labels) + penalty * (weights - centre)
        curve = (wide * (p * (1 - p))[:, None]).T @ wide + penalty * np.eye(len(weights))
        move, now = np.linalg.solve(curve, slope), loss(weights)
        # Far from the optimum a whole step may go too far.
        while loss(weights - move) > now and np.abs(move).max() > 1e-9:
            move = move / 2
        weights = weights - move
    return weights


@dataclass(frozen=True)
class QualityModel:
    """Two calibrated views and the weights that combine them."""

    text: View
    page: View
    combined: tuple[float, float, float]

    def scores(self, texts: list[bytes], sources: list, langs: list) -> tuple[np.ndarray, ...]:
        """Probabilities of being acceptable: by the text, by the page, by both."""
        text = self.text.logits(text_features(texts))
        page = self.page.logits(page_features(texts, sources, langs))
        a, b, c = self.combined
        return _sigmoid(text), _sigmoid(page), _sigmoid(a * text + b * page + c)


# One view is sure of a document: teacher, supposed label, key, and the document's two rows of features.
Found = tuple[str, int, int, np.ndarray, np.ndarray]


def co_train(
    text_rows: list[np.ndarray],
    page_rows: list[np.ndarray],
    labels: np.ndarray,
    surest: Callable[[dict[str, View], int, set[int]], list[Found]] | None = None,
    rounds: int = ROUNDS,
) -> QualityModel:
    """Fit both views. `labels` is 1 or 0.

    Rows keep their order, which must not depend on the labels. Every CALIBRATION_SHARE-th row is set
    aside for calibration. In each round `surest` is asked for the unlabelled documents that each of the
    views is surest of, at most a tenth of the labelled rows of each class, other than those of given keys.
    With no labelled row of one class, all documents get the share of the other class among the labels, 1
    without labels.
    """
    known = np.arange(len(labels))
    held, used = known[::CALIBRATION_SHARE], np.setdiff1d(known, known[::CALIBRATION_SHARE])
    none = np.empty(0, np.uint32)
    if len(set(labels[used].tolist())) < 2 or len(set(labels[held].tolist())) < 2:
        share = float(labels[known].mean()) if len(known) else 1.0
        odds = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        flat = View(none, np.empty(0), odds)
        return QualityModel(flat, flat, (0.5, 0.5, 0.0))

    rows = {"text": text_rows, "page": page_rows}
    # What the other view has taught each view: supposed labels and features by document.
    taught: dict[str, dict[int, tuple[int, np.ndarray]]] = {"text": {}, "page": {}}
    models: dict[str, View] = {}
    most = max(1, len(used) // 10)
    columns = {}
    for step in range(rounds + 1):
        for name, own in rows.items():
            extra = sorted(taught[name].items())
            view = ViewRows([*own, *[row for _, (_, row) in extra]], models.get(name))
            y = np.concatenate((labels[used], [label for _, (label, _) in extra])).astype(float)
            which = np.concatenate((used, np.arange(len(own), len(own) + len(extra))))
            view.fit(which, y, *((MORE_STEPS, 0.02) if step else (STEPS, 0.1)))
            models[name], columns[name] = view.model(), view.margins()[held]
            del view
        common.released()
        if step == rounds or surest is None:
            break
        known_keys = set(taught["text"]) | set(taught["page"])
        for teacher, label, key, text, page in surest(models, most, known_keys):
            other, row = ("page", page) if teacher == "text" else ("text", text)
            taught[other].setdefault(key, (label, row))
    y = labels[held].astype(float)
    calibrated, logits = {}, []
    for name, model in models.items():
        slope, shift = fit_dense(columns[name][:, None], y, [1.0, 0.0])
        calibrated[name] = View(model.hashes, model.weights, model.constant, float(slope), float(shift))
        logits.append(slope * columns[name] + shift)
    a, b, c = fit_dense(np.column_stack(logits), y, [0.5, 0.5, 0.0])
    return QualityModel(calibrated["text"], calibrated["page"], (float(a), float(b), float(c)))


_FEATURES = "doc_id long, key long, text_features binary, page_features binary"


def _feature_rows(batches):
    for part in common.slices(batches):
        texts = common.blobs(part.column("text"))
        sources, langs = part.column("source").to_pylist(), part.column("lang").to_pylist()
        text, page = text_features(texts), page_features(texts, sources, langs)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("key"),
                pa.array([packed(f) for f in text], pa.binary()),
                pa.array([packed(f) for f in page], pa.binary()),
            ],
            ["doc_id", "key", "text_features", "page_features"],
        )


def _surest_rows(models, most: int, sure: float, without):
    """The documents of a task that each view is surest of, at most `most` of each class."""

    def run(batches):
        best: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        odds = float(np.log(sure / (1 - sure)))
        for part in common.slices(batches, "text_features"):
            keys = part.column("key").to_numpy()
            fresh = ~np.isin(keys, without.value)
            for name, view in models.value.items():
                margins = view.margins([unpacked(f) for f in part.column(f"{name}_features").to_pylist()])
                for label, sign in ((1, 1.0), (0, -1.0)):
                    own = np.flatnonzero((sign * margins >= odds) & fresh)
                    known = best.get((name, label), (np.empty(0, np.int64), np.empty(0)))
                    both = np.concatenate((known[0], keys[own])), np.concatenate((known[1], sign * margins[own]))
                    # Copies have one key and one margin.
                    _, first = np.unique(both[0], return_index=True)
                    first = first[np.lexsort((both[0][first], -both[1][first]))[:most]]
                    best[name, label] = both[0][first], both[1][first]
        for (name, label), (keys, margins) in best.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "teacher": pa.array([name] * len(keys), pa.string()), "label": pa.array([label] * len(keys), pa.int32()),
                    "key": pa.array(keys, pa.int64()), "margin": pa.array(margins, pa.float64()),
                }
            )

    return run


def surest_of(features: DataFrame, sampled: set[int], sure: float):
    """How to ask all documents but the sampled ones for those that the views are surest of."""
    spark = features.sparkSession

    def surest(models: dict[str, View], most: int, known: set[int]) -> list[Found]:
        sent = spark.sparkContext.broadcast(models)
        without = spark.sparkContext.broadcast(np.array(sorted(sampled | known), np.int64))
        rows = cut_lineage(
            features.select("key", "text_features", "page_features").mapInArrow(
                _surest_rows(sent, most, sure, without), "teacher string, label int, key long, margin double"
            ).distinct()
        )
        picked = [
            row
            for name in models
            for label in (1, 0)
            for row in rows.where((F.col("teacher") == name) & (F.col("label") == label))
            .orderBy(F.desc("margin"), "key").limit(most).collect()
        ]
        # At most `most` documents of each class and view, each once.
        wanted = spark.createDataFrame([(k,) for k in sorted({row.key for row in picked})], "key long")
        found = features.join(F.broadcast(wanted), "key").select("key", "text_features", "page_features")
        own = {row.key: row for row in found.dropDuplicates(["key"]).collect()}
        return [
            (
                row.teacher, row.label, row.key, unpacked(own[row.key].text_features),
                unpacked(own[row.key].page_features),
            )
            for row in picked
        ]

    return surest


def _narrow(docs: DataFrame, *more) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        *more,
    )


def learn_quality(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, sure: float = SURE
) -> QualityModel:
    """Learn which documents are acceptable: of quality 1 and not toxic.

    `labels` has doc_id, quality and toxic. A missing quality or toxic leaves the row out; where a
    document has several rows, the worst counts. The `sample` labelled ids with the smallest hashes are
    used, one document of each. All other documents, labelled or not, are the unlabelled side: in each
    round they are scored on Spark. Their features are written once.
    """
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good.cast("int")).alias("label"))
    keyed = _narrow(docs).withColumn("key", F.xxhash64("text", F.col("text").isNull(), "source", F.lit(0), "lang"))
    features = written(keyed.mapInArrow(_feature_rows, _FEATURES), "page-features", compression="zstd")
    # One document of an id, before any row is collected.
    firsts = features.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("key"))
    chosen = known.join(firsts, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = cut_lineage(chosen)
    # At most `sample` rows of three numbers are broadcast, and as many rows of features collected.
    rows = features.join(F.broadcast(chosen), ["doc_id", "key"]).dropDuplicates(["doc_id"])
    got = rows.select("doc_id", "key", "label", "text_features", "page_features").toArrow().combine_chunks()
    text, page = ([unpacked(f) for f in got.column(f"{name}_features").to_pylist()] for name in ("text", "page"))
    ids, known_labels = got.column("doc_id").to_pylist(), np.array(got.column("label").to_pylist(), np.int64)
    order = sorted(range(len(ids)), key=lambda k: hash_order(ids[k]))
    surest = surest_of(features, set(got.column("key").to_pylist()), sure)
    return co_train([text[k] for k in order], [page[k] for k in order], known_labels[order], surest, rounds)


def hash_order(doc_id: int) -> int:
    return int(common.mix64(np.array([doc_id], np.int64).view(np.uint64))[0])


def _score_rows(model, kept: list[str]):
    def run(batches):
        own = model.value
        for part in common.slices(batches):
            scores = own.scores(
                common.blobs(part.column("text")),
                part.column("source").to_pylist(),
                part.column("lang").to_pylist(),
            )
            rest = [n for n in part.schema.names if n not in ("text", "source", "lang")]
            own_columns = [part.column(n).cast(pa.string()) for n in kept]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in rest], *own_columns, *[pa.array(s, pa.float64()) for s in scores]],
                [*rest, *kept, "text_score", "page_score", "score"],
            )

    return run


def scored(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, text_score, page_score, score, and the columns named in `keep`.

    Reads doc_id, text, source and lang, each of which may be null: a null text counts as empty, a
    null source or language as a value of its own. Repeated rows get equal scores; no rows give none.
    """
    kinds = dict(docs.dtypes)
    own = [c for c in keep if c in ("text", "source", "lang")]
    others = [c for c in keep if c not in own]
    source = _narrow(docs, *[F.col(c).alias(f"_keep_{c}") for c in others])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = "".join([*(f", `_keep_{c}` {kinds[c]}" for c in others), *(f", {c} string" for c in own)])
    done = source.mapInArrow(
        _score_rows(sent, own), f"doc_id long{kept}, text_score double, page_score double, score double"
    )
    return done.withColumnsRenamed({f"_keep_{c}": c for c in others})
