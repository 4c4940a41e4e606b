"""Thresholds, code lists and word lists that results must agree on."""

from __future__ import annotations

# --- fixed values: languages and noise codes ---
LANGS = ("es", "en")
CLEAN = "CLEAN"
CLEAN_KEY = "__clean__"
NO_CHAIN = "none"
CANONICAL_LEVELS = ("05", "10", "15")
LEVEL_SNR_DB = {"05": 10.0, "10": 0.0, "15": -5.0, "20": -10.0}
SNR_BANDS_DB = {"05": (8.0, 15.0), "10": (-2.0, 2.0), "15": (-7.0, -3.0)}
SUBTYPES = ("AA", "AB", "AC", "BA", "BB", "BC", "CA", "CB")
BANK_SUBTYPES = ("AA", "AB", "AC", "BA", "BB", "BC", "CA")
SPLITS = ("train", "eval")
SEED = 1337

# --- fixed values: data contract limits ---
MIN_CLIP_S = 3.0
MIN_TRAIN_CLIPS = 10
MIN_EVAL_CLIPS = 4
SNR_TOLERANCE_DB = 0.5
CLEAN_SHARE = 0.30
CLEAN_SHARE_SLACK = 0.05

# --- fixed values: transcript guard ---
NO_SPEECH_PROB_MAX = 0.85
SEGMENT_LOGPROB_MIN = -1.0
REPEAT_NGRAM = 3
REPEAT_TIMES = 3
MIN_SPEECH_RATIO = 0.2
FLAG_LOW_SPEECH = "low_speech_dropped"
FLAG_VAD = "vad_dropped"
FLAG_REPEAT = "repetition_truncated"
FLAG_GATED = "low_speech_gated"
GUARD_FLAGS = (FLAG_REPEAT, FLAG_LOW_SPEECH, FLAG_VAD)

# --- fixed values: noise damage index ---
DAMAGE_WEIGHTS = {"wer": 0.5, "ker": 0.4, "hallucination": 0.1}
BASELINE_FLOOR = 0.01
RATIO_FLOOR = 1e-6

# --- fixed values: policy, gates ---
LATENCY_BUDGET_MS = 400.0
MIN_REL_IMPROVEMENT = 0.03
KER_EPS = 1e-6
CLEAN_HARM = -0.01
MIN_NOISY_IMPROVEMENT = 0.15
MAX_CLEAN_REGRESSION = 0.02
MAX_RECALL_DROP = 0.01
MAX_GENERIC_REGRESSION = 0.02
MAX_LOGPROB_WORSE = 0.1
REQUEST_BUDGET_MS = 3000.0
RESIDUAL_BOOST = 1.5
TEMPERATURE = 0.5

# --- fixed values: feedback loop ---
ROUTE_MIN_CONFIDENCE = 0.8
MIN_EVIDENCE = 5
MIN_PRECISION = 0.9
CONTEXTS_KEPT = 5
CONTEXT_TERMS = 4
HARVEST_LOGPROB = -0.6
HARVEST_MIN_RULES = 2
CONTROL_SHARE = 0.02
HARVEST_CAP = 500
RULE_MIN_WEEKS = 2
RULE_MIN_FIRES = 5
RETRAIN_HOURS = 5.0
JUDGE_MENU_ITEMS = 60
JUDGE_MIN_AGREEMENT = 0.90
JUDGE_MIN_ITEMS = 100

# --- fixed values: operations ---
PSI_BINS = 10
PSI_EPS = 1e-6
PSI_ALERT = 0.2
SHARE_MULTIPLIER = 2.0
STORM_MULTIPLIER = 3.0
BAD_VERDICT_SHARE = 0.15
RATE_WINDOW_S = 60
RATE_LIMIT = 120
RECENT_REQUESTS = 500
RETENTION_DAYS = 90

# --- fixed values: fuzzy lexicon ---
# percent of similarity wanted, by number of words in the term
FUZZY_PERCENT = {1: 92, 2: 90, 3: 90}
MAX_LENGTH_GAP = 3
PROMPT_BUDGET = 200
CONTEXT_REACH = 3
STOPWORDS = {
    "es": (
        "de", "la", "el", "un", "una", "y", "con", "por", "para", "me", "da", "das",
        "que", "los", "las", "en", "al", "lo", "su", "es", "no", "si", "a", "o",
    ),
    "en": (
        "the", "a", "an", "and", "of", "to", "i", "me", "can", "get", "please",
        "with", "for", "is", "it", "my", "you", "do", "have", "want",
    ),
}
