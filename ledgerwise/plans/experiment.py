"""From trials to one hold-out result: candidate review, contract, and an evaluation that happens once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.functions.numbers import differing_keys
from ledgerwise.operators import calibration, folds, search, selection
from ledgerwise.operators.search import LABEL, YEAR
from ledgerwise.sources.writers import SealedFolder, exclusive_marker

# Weight of the squared slope in the maps from late scores to probabilities.
MAP_PENALTY = 1e-6


def review_candidates(
    trials: DataFrame,
    table: DataFrame,
    features,
    models: Callable[[DataFrame, tuple, list[int], list[dict]], list[list]],
    size: int = fv.CANDIDATE_REVIEW_SIZE,
    min_positives: int = fv.MIN_POSITIVES_PER_FOLD,
    holdout_fraction: float = fv.CALIBRATION_HOLDOUT,
) -> DataFrame:
    """The best trials once more, with calibrated walk-forward predictions: one row a candidate.

    A fold's map is fitted on the latest of its training years, on scores of a model of the earlier ones; its
    predictions come from a model of all of them. Folds need two training years. All models of all
    candidates and folds are fitted together, and so are all maps. Columns are those that
    `selection.select_candidate` asks for, the trial's own value, parameters, folds and mean metrics.
    """
    # At most `size` rows.
    chosen = selection.top_trials(trials, "value", size).select("number", "value", "parameters").collect()
    sets = [json.loads(row.parameters) for row in chosen]
    # One row a calendar year.
    sizes = sorted((r.year, r.rows, r.positives) for r in folds.year_table(table, YEAR, LABEL).collect())
    years = [y for y in search.usable_years(table, min_positives) if sum(s[0] < y for s in sizes) >= 2]
    starts: dict[int, int] = {}
    for year in years:
        own = [s for s in sizes if s[0] < year]
        start = folds.late_start([(y, n) for y, n, _ in own], holdout_fraction)
        parts = [s for s in own if s[0] < start], [s for s in own if s[0] >= start]
        if all(0 < sum(pos for *_, pos in part) < sum(n for _, n, _ in part) for part in parts):
            starts[year] = start
    wanted = list(dict.fromkeys([*years, *starts.values()]))
    fitted = [dict(zip(wanted, own)) for own in models(table, tuple(features), wanted, sets)] if sets and years else []
    late: dict[int, list] = {}
    for k, year in enumerate(years):
        for y, *_ in sizes:
            if year in starts and starts[year] <= y < year:
                late.setdefault(y, []).extend(
                    (search.slot_of(t, k, len(years)), own[starts[year]]) for t, own in enumerate(fitted)
                )
    maps = {}
    if late and fitted:
        scores = search.slot_scores(table, features, late, {})
        counts = scores.groupBy("slot", "score").agg(
            F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("pos")
        )
        maps = calibration.fit_sigmoids(search.cut_lineage(counts), "slot", smoothed=False, penalty=MAP_PENALTY)
    found = search.evaluate(table, features, years, [[own[y] for y in years] for own in fitted], maps) if fitted else []
    rows = [
        (
            row.number, m["recall_at_5_percent"], m["pr_auc"], m["brier_skill_score"], row.value, row.parameters,
            m["folds"], len(starts), *[m[name] for name in fv.METRICS],
        )
        for row, m in zip(chosen, found)
    ]
    schema = "number int, recall5 double, prauc double, skill double, value double, parameters string, folds int, calibrated_folds int, "
    reviewed = table.sparkSession.createDataFrame(rows, schema + ", ".join(f"{name} double" for name in fv.METRICS))
    return reviewed.withColumn("eligible", selection.is_eligible(F.col("skill")))


class GuardedHoldout:
    """A hold-out evaluation that can happen once, in a folder of its own.

    Its states follow each other: empty, selected, started, scored, sealed. Each but the first is a marker
    that only one driver can create. A run that ends between two of them leaves the last one visible: one
    that was started but not scored stays so, as the hold-out rows have been looked at; one that was scored
    can still be sealed.
    """

    STATES = ("selected", "started", "scored", "sealed")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.folder = SealedFolder(spark, f"{path}/result")

    def state(self) -> str:
        state = "empty"
        for name in self.STATES:
            try:
                self.spark.read.text(f"{self.path}/states/{name}").first()
            except AnalysisException:
                return state
            state = name
        return state

    def _enter(self, state: str, content: dict) -> None:
        exclusive_marker(self.spark, f"{self.path}/states/{state}/marker.json", content)

    def select(self, candidates: DataFrame, contract: DataFrame) -> dict:
        """Keep the winner of a review and the contract it was reviewed under; returns its parameters."""
        choice = selection.select_candidate(candidates).first()
        if choice.selected_trial_number is None:
            raise RuntimeError("no candidate is eligible: the hold-out rows stay unread")
        winner = selection.winner_row(candidates, choice.selected_trial_number).first()
        self._enter(
            "selected",
            {"number": winner.number, "parameters": json.loads(winner.parameters), "contract": contract.first().contract},
        )
        return json.loads(winner.parameters)

    def selected(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/states/selected", wholetext=True).first()[0])

    def evaluate(
        self,
        development: DataFrame,
        holdout: DataFrame,
        contract: DataFrame,
        window: tuple[int, int],
        score: Callable[[dict, DataFrame], tuple[DataFrame, DataFrame]],
    ) -> DataFrame:
        """Score the window once and seal predictions and summary; returns the manifest.

        `score` gets the selected parameters and the rows of the window. Before anything is started, the
        contract must be the one of the selection, and all development years must lie before the window.
        """
        if self.state() != "selected":
            raise RuntimeError(f"hold-out evaluation is {self.state()}, not selected")
        kept = self.selected()
        expected = self.spark.createDataFrame([(kept["contract"],)], "contract map<string,string>")
        other = contract.select("contract").scalar()
        differing = expected.withColumn("_other", other).select(differing_keys(F.col("contract"), F.col("_other"))).first()[0]
        if differing:
            raise RuntimeError("artifact contract mismatch: " + ", ".join(differing))
        latest = development.agg(F.max(YEAR)).first()[0]
        if latest is None or latest >= window[0]:
            raise ValueError("development years must end before the hold-out window")
        self._enter("started", {"window": list(window)})
        self.folder.begin({"window": f"{window[0]}-{window[1]}", "trial": str(kept["number"])})
        predictions, summary = score(kept["parameters"], holdout.where(F.col(YEAR).between(*window)))
        self.folder.write({"predictions": predictions, "summary": summary})
        self._enter("scored", {})
        return self.seal()

    def seal(self) -> DataFrame:
        """Write the manifest of scored tables; also after a run that ended before it could."""
        if self.state() != "scored":
            raise RuntimeError(f"hold-out evaluation is {self.state()}, not scored")
        manifest = self.folder.seal(["predictions", "summary"])
        self._enter("sealed", {})
        return manifest

    def result(self, name: str) -> DataFrame:
        if self.state() != "sealed":
            raise RuntimeError(f"hold-out evaluation is {self.state()}, not sealed")
        return self.spark.read.parquet(f"{self.path}/result/data/{name}")
