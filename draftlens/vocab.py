"""Vocabularies and thresholds that results depend on. All are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Writing intentions, in the order in which a label is looked for inside a text.
WRITING_INTENTIONS = (
    "Text Production",
    "Visual Formatting",
    "Clarity",
    "Section Planning",
    "Structural",
    "Object Insertion",
    "Cross-reference",
    "Fluency",
    "Idea Generation",
    "Idea Organization",
    "Citation Integration",
    "Coherence",
    "Linguistic Style",
    "Scientific Accuracy",
    "Macro Insertion",
)

# Intentions by group.
INTENTION_GROUPS = {
    "planning": ("Idea Generation", "Idea Organization", "Section Planning"),
    "implementation": ("Text Production", "Object Insertion", "Cross-reference", "Citation Integration", "Macro Insertion"),
    "revision": ("Fluency", "Coherence", "Structural", "Clarity", "Linguistic Style", "Scientific Accuracy", "Visual Formatting"),
}

# Span labels, levels, states (by rank) and flags.
SPAN_LABELS = (
    "injection.naive",
    "injection.topical",
    "injection.contextual",
    "anomaly.missing_revision",
    "anomaly.timestamp_jitter",
    "anomaly.truncation",
    "anomaly.large_diff",
    "anomaly.process_violation",
    "anomaly.no_resource_coupling",
    "assistance.revision_assisted",
)
LEVELS = ("naive", "topical", "contextual")
STATES = ("cold", "warm", "assimilated")
FLAGS = ("none", "low", "medium", "high")
# Tag and colour of each operation of a replayed diff.
REPLAY_MARKS = {1: ("ins", "#82E0AA"), -1: ("del", "#F1948A"), 2: ("ins", "#85C1E9 "), 3: ("ins", "#C39BD3"), 4: ("ins", "#FFBF00")}

# Repairs by way of failure, where no lexicon or marker file is given.
REPAIRS = {
    "lexical_starvation": ("concept", "framework", "element"),
    "syntactic_collapse": ("thus, ", "so, ", "consequently, ", "accordingly, "),
    "cognitive_overflow": ("it ",),
}

# Parts of a placeholder, where no text file is given.
PLACEHOLDER_INTROS = ("This empirical investigation demonstrates",)
PLACEHOLDER_BODIES = ("that the underlying assumptions remain foundational.",)
PLACEHOLDER_CONCLUSIONS = ("Consequently, subsequent research must address these gaps.",)

# Data splits.
SPLITS = ("train", "val", "test", "test_small", "train_small", "val_small", "all_sorted")

# Thresholds.
COUPLING_PLAUSIBLE = 0.5
COUPLING_EARNED_ASSIMILATED = 0.55
COUPLING_ASSIMILATED = 0.7
COUPLING_WARM = 0.4
COUPLING_EARNED_WARM = 0.3
COUPLING_EARNED_HIGH = 0.5
COUPLING_ANOMALY = 0.2
LOCALITY_LOW = 1.0
LOCALITY_HIGH = 3.5
LOCALITY_WARM = 4.5
LOCALITY_ANOMALY = 4.5
SUBSTANTIAL_EDIT = 0.20
NCD_CUT = 0.45
LARGE_DIFF_JACCARD = 0.30
TRUNCATION = 0.40
TRACE_FOR_COUPLING = 5
TRACE_WARM = 3
TRACE_ASSIMILATED = 5
GLUCOSE_TOLERANCE = 0.0001
GLUCOSE_START = 1.0
GLUCOSE_FLOOR = 0.05
GLUCOSE_DECAY = 0.9992
GLUCOSE_STARVED = 0.65
FATIGUE_TOKENS = 12000.0
COLLAPSE_BASE = 4.0
COLLAPSE_FACTOR = 3.5
EROSION_MEDIUM = 0.10
EROSION_HIGH = 0.25
SESSION_GAP_MINUTES = 10
SESSION_COSINE = 0.5

# Upper ends of the gap histogram's bins, in minutes; the last bin is open.
GAP_BINS = (0.5, 1, 5, 10, 20, 30, 60, 120, 1440, 2880, 7200, 14400)

# Phrases of the naive templates.
NAIVE_TEMPLATES = (
    "This is a general academic statement.",
    "This empirical investigation corroborates",
    "methodological constraints delineated",
    "juxtaposition of these findings necessitates",
    "Operationalizing these variables requires",
    "substantive evidence presented here supports",
    "inherent heterogeneity within the dataset",
    "underlying ontological assumptions remain foundational",
    "paradigm shift toward more systematic",
    "epistemological biases can significantly skew",
    "synergistic effects of multi-scalar interventions",
    "notwithstanding the preliminary nature",
    "utilization of advanced computational models",
    "subsequent research must address these identified gaps",
    "necessitates a more nuanced approach",
    "implications for large-scale infrastructure deployment",
    "delineated boundaries of this study warrant",
    "analytical setup provides a stable baseline",
    "the research methodology employed",
    "scholarly analysis reveals",
    "academic literature suggests",
    "furthermore, it is evident that",
    "this approach demonstrates",
    "the findings indicate that",
    "in conclusion, this study",
)

# Discourse markers.
DISCOURSE_MARKERS = (
    "however", "conversely", "nevertheless", "nonetheless", "yet", "still", "on the contrary", "in contrast", "whereas", "while", "although", "though",
    "despite", "notwithstanding", "alternatively", "instead", "rather", "consequently", "therefore", "thus", "hence", "accordingly", "as a result",
    "for this reason", "thereby", "subsequently", "in turn", "furthermore", "moreover", "additionally", "besides", "likewise", "similarly", "in addition",
    "also", "equally", "correspondingly", "admittedly", "granted", "of course", "certainly", "indeed", "naturally", "for example", "for instance",
    "specifically", "particularly", "notably", "in particular", "such as", "including", "firstly", "secondly", "finally", "meanwhile", "initially",
    "ultimately", "in summary", "in conclusion", "to summarize", "arguably", "presumably", "apparently", "seemingly", "ostensibly",
)
#: Markers of the demand estimate where no marker file is given.
DEMAND_MARKERS = ("however", "nevertheless", "consequently", "therefore")

# Openings, bracket words and instruction echoes that betray a prompt.
LEAKAGE_OPENINGS = (
    "sure", "certainly", "here is", "here's", "revised", "modified", "updated", "final", "corrected", "as requested", "the following", "of course", "i have",
    "i've", "understood", "absolutely", "no problem", "glad to help", r"the (?:modified|revised) (?:text|version|span|paragraph|section) is", r"\[TARGET\]",
    r"\[PRECEDING\]", r"\[FOLLOWING\]", r"\[REVISED\]", r"\[SPAN\]", "objective:", "persona:", "setting:", "state of mind:", "background:", "ambient note",
    "internal thought", "---", r"\*\*\*", "###", "####", "REVISED VERSION:", "MODIFIED TEXT:", "REVISION:", "EDIT:",
)
LEAKAGE_BRACKET_WORDS = ("TARGET", "SPAN", "REVISED", "PRECEDING", "FOLLOWING", "MARKER")
LEAKAGE_ECHOES = ("Return ONLY", "meta-commentary", "modified text", "revised text", "without commentary", "no meta-talk", "no quotes")
LEAKAGE_PATTERNS = (r"(?i)\bas an ai\b", r"(?i)^here is\b", r"(?i)^certainly!")

# Patterns of personal data, strict ones first; severity goes with the kind.
PII_STRICT = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(\+\d{1,2}\s?)?(\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
}
PII_HEURISTIC = {
    "potential_name": r"\b[A-Z][a-z]+ [A-Z][a-z]+(?:\s[A-Z][a-z]+)?\b",
    "potential_institution": r"\b(?:University|Institute|College|Laboratory|Dept|Department|School) of [A-Z][a-z]+\b",
    "potential_university": r"\b[A-Z][a-z]+ (?:University|Institute|College)\b",
}
PII_NOT_NAMES = ("Table", "Figure", "Section", "Appendix", "Equation")

# Prompts by level.
PROMPTS = {
    "naive": "Write a scholarly paragraph about academic research. Maintain formal register.",
    "topical": "Write a scholarly paragraph about {topic} in the field of {domain}. Maintain formal register.",
    "contextual": "In the {section} section, write content that bridges the following passages:\n\nPreceding: {preceding}\n\nFollowing: {following}\n\nMaintain formal academic register.",
}

# Vendors of models by the pattern of their ids; the place is the priority, the first that is met counts.
MODEL_VENDORS = {
    "anthropic": r"^anthropic/|^claude",
    "openai": r"^openai/|^gpt-",
    "google": r"^google/|^gemini",
    "meta": r"^meta-llama/|^llama",
    "mistral": r"^mistralai/|^mistral",
    "cohere": r"^cohere/",
    "deepseek": r"^deepseek/",
    "qwen": r"^qwen/",
    "perplexity": r"^perplexity/",
    "nous": r"^nousresearch/|^nous",
}
MODEL_PRIORITY_OTHERS = 99

# Ids that are left out, and what counts for and against an id.
MODELS_EXCLUDED = (r"vision|image|audio|video|embed|moderat", r"instruct-\d+k", r"free$", r"preview|beta|alpha|experimental")
MODEL_SCORES = {
    r"opus|sonnet|4o|gpt-4|pro|ultra|large": 10,
    r"haiku|mini|small|nano|tiny|lite": -5,
    r"latest|turbo|flash": 5,
    r"405b|70b|72b|llama-3\.1": 8,
    r"8b|7b|3b|1b": -3,
}

# Parameters of generation that are known, those that all models take, and by vendor where a model lists none.
MODEL_PARAMETERS_ALWAYS = ("temperature", "max_tokens")
MODEL_PARAMETERS = ("top_p", "top_k", "presence_penalty", "frequency_penalty", "repetition_penalty", "min_p", "seed", "stop")
MODEL_PARAMETERS_OTHERS = ("top_p", "stop")
MODEL_PARAMETERS_BY_VENDOR = {
    "anthropic": ("top_p", "top_k", "stop"),
    "openai": ("top_p", "presence_penalty", "frequency_penalty", "seed", "stop"),
    "google": ("top_p", "top_k", "stop"),
    "meta": ("top_p", "top_k", "repetition_penalty", "stop"),
    "mistral": ("top_p", "presence_penalty", "frequency_penalty", "stop"),
    "cohere": ("top_p", "top_k", "presence_penalty", "frequency_penalty", "stop"),
    "deepseek": ("top_p", "presence_penalty", "frequency_penalty", "stop"),
    "qwen": ("top_p", "top_k", "repetition_penalty", "stop"),
}


def ranked(spark: SparkSession, values: tuple[str, ...], name: str = "label") -> DataFrame:
    """A vocabulary as a table (name, pos), for dense counts and tie-breaks."""
    return spark.createDataFrame([(v, k) for k, v in enumerate(values)], f"{name} string, pos int")
