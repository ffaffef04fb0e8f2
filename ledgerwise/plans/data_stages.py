"""The ordered data stages, from raw records to development features."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise import fixed_values as fv
from ledgerwise.functions import keys, text
from ledgerwise.operators import (
    features,
    ingest,
    labeling,
    lexicon,
    quality,
    split,
    validation,
)
from ledgerwise.scale import bound_python_batches, union_all, written
from ledgerwise.sources.writers import exclusive_marker

Tables = dict[str, DataFrame]


def _validate(t: Tables) -> Tables:
    checked = validation.filing_errors(t["filings"])
    return {
        "validation": validation.dataset_summary(checked, "filings", fv.REQUIRED_FILING_FIELDS)
    }


def _ingest_filings(t: Tables) -> Tables:
    if "more_filings" not in t:
        return {"combined": t["filings"].withColumn("source", F.lit("filings"))}
    return {"combined": ingest.combine(t["filings"], t["more_filings"])}


def _ingest_periods(t: Tables) -> Tables:
    cleaned = ingest.clean_periods(t["periods"])
    return {"fraud_periods": cleaned.withColumn("cik", keys.company_key(F.col("cik")))}


def _label(t: Tables) -> Tables:
    filings = labeling.prepare_filings(t["combined"])
    return {"labeled": labeling.label_filings(filings, t["fraud_periods"])}


def _clean(t: Tables) -> Tables:
    return {"cleaned": t["labeled"].withColumn("mda", text.clean_text(F.col("mda")))}


def _normalize(t: Tables) -> Tables:
    return {"normalized": t["cleaned"].withColumn("mda", text.normalize_text(F.col("mda")))}


def _quality(t: Tables) -> Tables:
    # What the rules on type and date leave is written once. Words are looked for in that same pass; later
    # stages read the answer and keys, not the text.
    kept = quality.metadata_filter(t["normalized"]).withColumn("_enough", quality.has_enough_words(F.col("mda")))
    return {"checked": written(kept, "checked").where("_enough").drop("_enough")}


def _deduplicate(t: Tables) -> Tables:
    return {"unique": ingest.deduplicate(t["checked"])}


def _split(t: Tables) -> Tables:
    development, holdout = split.split_by_year(t["unique"], t.get("cutoff", fv.HOLDOUT_START_YEAR))
    return {"development": development, "holdout": holdout}


def with_lexicon(filings: DataFrame, raw_lexicon: DataFrame, needed: list[DataFrame]) -> DataFrame:
    """Lexicon densities and text features for filings with a typed reporting date."""
    lookup = lexicon.build_lookup(
        lexicon.prepare_lexicon(raw_lexicon), lexicon.required_keys(needed)
    )
    # Features come first: where the caller does not ask for the text, the join then moves numbers only.
    measured = lexicon.attach_lexicon(features.add_text_features(filings), lookup)
    return measured.select(*[c for c in measured.columns if c not in fv.TEXT_FEATURES], *fv.TEXT_FEATURES)


def keyed(filings: DataFrame) -> DataFrame:
    """Lexicon key columns: digits of the company key, filing and reporting year."""
    return split.with_filing_year(filings).withColumns(
        {
            "cik": keys.company_key_digits(F.col("cik")),
            "reporting_year": F.year("reporting_date"),
        }
    )


def _development_features(t: Tables) -> Tables:
    development = keyed(t["development"])
    return {"features": with_lexicon(development, t["lexicon"], [development])}


def full_features(development: DataFrame, holdout: DataFrame, raw_lexicon: DataFrame) -> DataFrame:
    """Features of both splits in one job, tagged by `dataset`; the lookup is built once."""
    both = union_all(
        [
            keyed(development).withColumn("dataset", F.lit("trainval")),
            keyed(holdout).withColumn("dataset", F.lit("test")),
        ]
    )
    return with_lexicon(both, raw_lexicon, [both])


STAGES: dict[str, Callable[[Tables], Tables]] = {
    "validate-raw": _validate,
    "ingest-firm-years": _ingest_filings,
    "ingest-labels": _ingest_periods,
    "merge-labels": _label,
    "clean-text": _clean,
    "normalize": _normalize,
    "quality-check": _quality,
    "deduplicate": _deduplicate,
    "split": _split,
    "development-features": _development_features,
}


# Tables and settings that a stage reads; with the stage's name they say whether it has to run again.
READS: dict[str, tuple[str, ...]] = {
    "validate-raw": ("filings",),
    "ingest-firm-years": ("filings", "more_filings"),
    "ingest-labels": ("periods",),
    "merge-labels": ("combined", "fraud_periods"),
    "clean-text": ("labeled",),
    "normalize": ("cleaned",),
    "quality-check": ("normalized",),
    "deduplicate": ("checked",),
    "split": ("unique", "cutoff"),
    "development-features": ("development", "lexicon"),
}
# Raised when a stage's result changes with the same inputs.
STAGES_VERSION = 1


def _mark(value) -> str:
    """What an input is known by: the fingerprint of a table's content, or a setting itself."""
    return keys.content_fingerprint(value).first().fingerprint if isinstance(value, DataFrame) else repr(value)


def _stored(store: str, name: str, tables: Tables, marks: dict[str, str]) -> tuple[Tables, dict[str, str]]:
    """Outputs of a stage from the store, and their marks; run and written if they are not there.

    A manifest is written last. What a lost run has left without one is written again.
    """
    spark = next(t for t in tables.values() if isinstance(t, DataFrame)).sparkSession
    read = [STAGES_VERSION, name, {n: marks[n] for n in READS[name] if n in marks}]
    key = hashlib.sha256(json.dumps(read, sort_keys=True).encode()).hexdigest()[:32]
    folder = f"{store}/{name}-{key}"
    try:
        manifest = json.loads(spark.read.text(f"{folder}/manifest", wholetext=True).first()[0])
    except AnalysisException:
        made = STAGES[name](tables)
        manifest = {output: df.schema.jsonValue() for output, df in made.items()}
        for output, df in made.items():
            df.write.mode("overwrite").parquet(f"{folder}/{output}")
        exclusive_marker(spark, f"{folder}/manifest/manifest.json", manifest)
    schemas = {output: T.StructType.fromJson(schema) for output, schema in manifest.items()}
    found = {output: spark.read.schema(schema).parquet(f"{folder}/{output}") for output, schema in schemas.items()}
    return found, {output: f"{name}-{key}" for output in found}


def run_stages(
    tables: Tables, through: str, acknowledge_holdout: bool = False, store: str | None = None
) -> Tables:
    """Run the stages in order up to and including one of them.

    A run that reaches the split produces hold-out rows, so it must be acknowledged. With `store`, a folder,
    outputs are kept there by what they were made from: a later run reads those of stages whose inputs are
    the same and runs the others. The folder is the caller's to remove.
    """
    if through not in STAGES:
        raise ValueError(f"Unknown stage: {through}")
    names = list(STAGES)
    selected = names[: names.index(through) + 1]
    if "split" in selected and not acknowledge_holdout:
        raise RuntimeError("stages from 'split' on write hold-out rows and must be acknowledged")
    # The setting is read when a result is computed, so it stays with the session.
    bound_python_batches(next(t for t in tables.values() if isinstance(t, DataFrame)).sparkSession)
    marks = {}
    if store is not None:
        read = {n for name in selected for n in READS[name]}
        marks = {n: _mark(value) for n, value in tables.items() if n in read}
    for name in selected:
        if store is None:
            made = STAGES[name](tables)
        else:
            made, own = _stored(store, name, tables, marks)
            marks = {**marks, **own}
        tables = {**tables, **made}
    return tables
