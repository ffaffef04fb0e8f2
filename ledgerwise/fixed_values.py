"""Values that results depend on: names, lists, patterns and limits.

Everything in this module is a fixed value. Changing one changes results.
"""

# Columns of a filing record.
FILING_COLUMNS = ("cik", "name", "filing_type", "filing_date", "reporting_date", "fye", "mda")
REQUIRED_FILING_FIELDS = ("cik", "filing_date", "mda", "name", "reporting_date")
FILING_ID_FIELDS = ("cik", "filing_date", "reporting_date", "filing_type")

# Accepted and excluded filing types.
VALID_FILING_TYPES = ("10-K", "10-K/A", "10-K405", "10-K405/A", "10-KT", "10-KT/A")
AMENDED_FILING_TYPES = ("10-K/A", "10-K405/A", "10-KT/A")

# The 44 columns of the headerless enforcement file, in file order.
ENFORCEMENT_COLUMNS = (
    "id", "dateTime", "aaerNo", "releaseNo", "respondents", "respondentsText", "urls",
    "fraud_start", "fraud_end", "cik", "revoked", "certainty_start", "certainty_end",
    "17a", "17a2", "17a3", "17b", "5a", "5b1", "5c", "10b", "13a", "12b20", "12b25",
    "13a1", "13a10", "13a11", "13a13", "13a14", "13a16", "13b2A", "13b2B", "13a15",
    "13b5", "14a", "14c", "19a", "30A", "100a2", "100b", "105c7B", "corruption", "amis", "fsf",
)
REQUIRED_ENFORCEMENT_FIELDS = ("cik", "fraud_end", "fraud_start", "id")
PERIOD_COLUMNS = ("cik", "fraud_start", "fraud_end", "certainty_start", "certainty_end")

# Quality rules.
MIN_WORDS = 200
MIN_REFERENCE_PHRASES = 2
FIRST_FILING_YEAR = 1993
HOLDOUT_START_YEAR = 2019
FINAL_WINDOW = (2019, 2022)
REFERENCE_PHRASES = (
    "incorporated herein by reference",
    "incorporated by reference",
    "management's review",
    "management's discussion",
    "annual report",
    "appearing on pages",
    "set forth on pages",
    "exhibit 13",
)

# Lexicon counts and the density each one yields over N_Words.
LEXICON_COUNTS = (
    "N_Words", "N_Negative", "N_Positive", "N_Uncertainty", "N_Litigious",
    "N_StrongModal", "N_WeakModal", "N_Constraining",
)
LEXICON_DENSITIES = {
    "negative_density": "N_Negative",
    "positive_density": "N_Positive",
    "uncertainty_density": "N_Uncertainty",
    "litigious_density": "N_Litigious",
    "weak_modal_density": "N_WeakModal",
    "strong_modal_density": "N_StrongModal",
    "constraining_density": "N_Constraining",
}

# Names of the 16 text-surface features.
TEXT_FEATURES = (
    "mda_char_count", "mda_word_count", "mda_sentence_count", "mda_avg_sentence_words",
    "mda_log_word_count", "mda_flesch_reading_ease", "mda_flesch_kincaid_grade",
    "mda_gunning_fog", "mda_complex_word_ratio", "mda_digit_ratio",
    "mda_punctuation_ratio", "mda_uppercase_ratio", "mda_avg_word_length",
    "mda_long_sentence_ratio", "mda_lexical_diversity", "mda_text_available",
)
MODEL_FEATURES = tuple(LEXICON_DENSITIES) + TEXT_FEATURES
LONG_SENTENCE_WORDS = 25
COMPLEX_WORD_SYLLABLES = 3

# Evaluation.
METRICS = (
    "roc_auc", "pr_auc", "f1", "f1_macro", "precision", "recall",
    "recall_at_5_percent", "precision_at_5_percent", "mcc", "balanced_acc",
    "brier_score", "naive_brier_score", "brier_skill_score",
)
MIN_POSITIVES_PER_FOLD = 30
CALIBRATION_BINS = 10
CALIBRATION_HOLDOUT = 0.20
REVIEW_PERCENT = 5
DECISION_THRESHOLD = 0.5
SCORE_QUANTILES = (0.50, 0.75, 0.90, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999)
COUNT_THRESHOLDS = (0.01, 0.02, 0.03, 0.05, 0.07, 0.10, 0.15, 0.20, 0.30, 0.50)
MATURITY_QUANTILES = (0.90, 0.95)
CANDIDATE_REVIEW_SIZE = 10
SELECTION_RULE = (
    "positive mean Brier skill score; highest mean Recall@5%; mean PR-AUC tie-breaker"
)
EVALUATION_CONTRACT = "strict-filing-time-v1"

# Upper limits of the effect-size bands for |Cohen's d|.
EFFECT_BANDS = ((0.2, "Negligible"), (0.5, "Small"), (0.8, "Medium"))
TOP_EFFECT_BAND = "Large"
SIGNIFICANCE = 0.05

# The characters Python calls whitespace, and the same set as a regex class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"

# Regex classes for words, digits and ASCII punctuation.
WORD_CHARS = r"\p{L}\p{N}_"
SURFACE_WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
DIGIT_CHARS = (
    r"\p{Nd}²³¹፩-፱᧚⁰⁴-⁹₀-₉"
    r"①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾"
    r"➀-➈➊-➒\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}"
    r"\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
PUNCTUATION_CHARS = r"!-/:-@\[-`{-~"
