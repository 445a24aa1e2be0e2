"""Column expressions: scaling, levels, interval relations, demographics, calibrations, rule text.

All are built-in functions, so that they stay within code generation. Missing
values are null; NaN is made null where a value enters (``known``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("low", "medium", "high")

# Level cuts on the unit scale, and the ends of the rating scales of public data sets.
LEVEL_CUTS = {"low": (0.0, 0.33), "medium": (0.33, 0.66), "high": (0.66, 1.0)}
RATING_SCALES = {"CASE": (0.5, 9.5), "K-emoCon": (1.0, 5.0), "CEAP": (-1.0, 1.0), "EmoWorker_v2": (1.0, 9.0), "K-emoCon_external": (1.0, 5.0), "EMBOA": (0.0, 1.0)}

# Label of (arousal level, valence level).
EMOTION_GRID = {
    ("high", "high"): "excited",
    ("high", "medium"): "alert",
    ("high", "low"): "stressed",
    ("medium", "high"): "content",
    ("medium", "medium"): "neutral",
    ("medium", "low"): "upset",
    ("low", "high"): "relaxed",
    ("low", "medium"): "calm",
    ("low", "low"): "sad",
}

# Circumplex weights (valence, arousal) of emotion percentages.
CIRCUMPLEX = {"Happy": (1.0, 0.5), "Sad": (-1.0, -1.0), "Scared": (-1.0, 1.0), "Disgusted": (-1.0, -0.5), "Surprised": (0.2, 1.0), "Angry": (-1.0, 1.0)}

# Window features that become states, and the states' names.
STATE_NAMES = {
    "arousal_norm": "arousal",
    "valence_norm": "valence",
    "eda_mean": "eda",
    "eda_std": "eda_std",
    "eda_max": "eda_max",
    "eda_peaks": "eda_peaks",
    "eda_scr_mean_amp": "eda_scr_amp",
    "eda_scr_auc": "eda_scr_auc",
    "hr_mean": "hr",
    "temp_mean": "temp",
    "hrv_sdnn": "hrv_sdnn",
    "hrv_rmssd": "hrv_rmssd",
    "hrv_pnn50": "hrv_pnn50",
    "hrv_pnn20": "hrv_pnn20",
    "hrv_cvnn": "hrv_cvnn",
    "hrv_cvsd": "hrv_cvsd",
    "hrv_lf_hf_ratio": "hrv_lf_hf",
    "hrv_lfn": "hrv_lfn",
    "hrv_hfn": "hrv_hfn",
}
PHYSIO_VARIABLES = tuple(v for v in STATE_NAMES if not v.endswith("_norm"))


def known(v: Column) -> Column:
    """The value as a double, null for NaN."""
    d = v.cast("double")
    return F.when(~F.isnan(d), d)


def rescale(v: Column, low, high) -> Column:
    """(v - low) / (high - low); not clamped."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return (v - low) / (high - low)


def level_cut(v: Column, cuts: dict | None = None) -> Column:
    """Level in half-open bins, low first; the last bin also takes what is within 0.001 of its end or above; below all bins null.

    cuts: level to (low, high), numbers or columns.
    """
    out = None
    for name, (low, high) in (cuts or LEVEL_CUTS).items():
        inside = (v >= low) & (v < high)
        if name == "high":
            inside = inside | (v >= high - 0.001)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def level_cut_simple(v: Column, low: float = 0.33, high: float = 0.66) -> Column:
    """Level without a lower bound: negatives are low."""
    return F.when(v < low, "low").when(v < high, "medium").when(v.isNotNull(), "high")


def emotion_label(arousal_level: Column, valence_level: Column) -> Column:
    """One of nine labels; null if either level is."""
    cells = F.create_map(*[F.lit(x) for (a, v), name in EMOTION_GRID.items() for x in (f"{a}|{v}", name)])
    return F.try_element_at(cells, F.concat(arousal_level, F.lit("|"), valence_level))


def circumplex(columns: dict[str, Column]) -> tuple[Column, Column]:
    """(arousal, valence) in 0..1 of emotion percentages; missing ones count 0."""

    def axis(i: int) -> Column:
        total = reduce(lambda a, b: a + b, [F.coalesce(known(columns[e]), F.lit(0.0)) * w[i] for e, w in CIRCUMPLEX.items() if e in columns], F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (total + 100) / 200))

    return axis(1), axis(0)


# Calibrations of sensor voltages.
CALIBRATIONS = {
    "ecg": lambda v: (v - 2.8) / 50 * 1000,
    "gsr": lambda v: 24.0 * v - 49.2,
    "skt": lambda v: 21.341 * v - 32.085,
    "bvp": lambda v: 58.962 * v - 115.09,
    "rsp": lambda v: 58.923 * v - 115.01,
    "emg": lambda v: (v - 2) / 4000 * 1e6,
    "joystick": lambda v: 0.5 + 9 * (v + 26225) / 52450,
}


def calibrate(kind: str, v: Column) -> Column:
    return CALIBRATIONS[kind](v)


# --- relations of intervals ----------------------------------------------------------------------

RELATIONS = {"b": "before", "m": "meets", "o": "overlaps", "fi": "is-finished-by", "c": "contains", "=": "equals", "s": "starts"}


def _ordered_relation(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    earlier = F.when(e1 < s2, "b").when(e1 == s2, "m").when(e1 < e2, "o").when(e1 == e2, "fi").otherwise("c")
    return F.when(s1 < s2, earlier).when(e1 == e2, "=").when(e1 < e2, "s").otherwise("fi")


def interval_relation(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """One of seven relations of two intervals, the earlier start taken first."""
    return F.when(s1 > s2, _ordered_relation(s2, e2, s1, e1)).otherwise(_ordered_relation(s1, e1, s2, e2))


def interval_relation_checked(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The validator's variant: before and meets without regard to starts, and ``other``."""
    return (
        F.when(e1 < s2, "before").when(e1 == s2, "meets")
        .when((s1 < s2) & (e1 > s2) & (e1 < e2), "overlaps")
        .when((s1 == s2) & (e1 == e2), "equals")
        .when((s1 == s2) & (e1 < e2), "starts")
        .when((s1 < s2) & (e1 == e2), "is-finished-by")
        .when((s1 < s2) & (e1 > e2), "contains")
        .otherwise("other")
    )


# --- demographics --------------------------------------------------------------------------------


def age_group(age: Column) -> Column:
    """Five-year bands of a number or text; unparsable or from 100 on Unknown."""
    n = F.floor(age.try_cast("double"))
    return F.when(n.isNull(), "Unknown").when(n < 20, "19-19").when(n < 25, "20-24").when(n < 30, "25-29").when(n < 35, "30-34").when(n < 40, "35-39").when(n < 100, "40+").otherwise("Unknown")


def band_midpoint(band: Column) -> Column:
    """'25-29' to 27.0; null if it is no band."""
    parts = F.split(band, "-")
    return (F.try_element_at(parts, F.lit(1)).try_cast("double") + F.try_element_at(parts, F.lit(2)).try_cast("double")) / 2


def young_or_old(age: Column, most_young: int = 25) -> Column:
    return F.when(age <= most_young, "young").when(age.isNotNull(), "old")


def clean_gender(v: Column) -> Column:
    """M or F of the usual spellings, else null."""
    g = F.upper(F.trim(v.cast("string")))
    return F.when(g.isin("M", "MALE", "1", "MAN"), "M").when(g.isin("F", "FEMALE", "2", "WOMAN"), "F")


# --- states and rules as text --------------------------------------------------------------------


#: Skin features that are scaled within a participant. Fixed values.
SKIN_COLUMNS = ("eda_mean", "eda_std", "eda_max", "eda_peaks", "eda_scr_mean_amp", "eda_scr_auc")


def state_feature(state: Column) -> Column:
    """Text before a level suffix; the whole state if it has none."""
    return F.regexp_replace(state, "_(high|medium|low)$", "")


def state_level(state: Column) -> Column:
    found = F.regexp_extract(state, "_(high|medium|low)$", 1)
    return F.when(found == "", "unknown").otherwise(found)


def state_category(state: Column) -> Column:
    """Text before the last underscore."""
    return F.regexp_replace(state, "_[^_]*$", "")


def pattern_pairs(n: Column) -> Column:
    """(i, j) of the upper triangle of n states, row by row, from 1."""
    inner = lambda i: F.when(i < n, F.transform(F.sequence(i + 1, n), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(inner(i), F.expr("cast(array() as array<struct<i:int,j:int>>)"))))


def pattern_text(states: Column, relations: Column) -> Column:
    """``(a)`` of one state, else ``a relation b`` of all pairs joined by AND."""
    names = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    said = F.zip_with(pattern_pairs(F.size(states)), relations, lambda p, r: F.concat_ws(" ", F.try_element_at(states, p["i"]), F.try_element_at(names, r), F.try_element_at(states, p["j"])))
    return F.when(F.size(states) == 1, F.concat(F.lit("("), F.element_at(states, 1), F.lit(")"))).otherwise(F.array_join(said, " AND "))


def pattern_matrix(states: Column, relations: Column) -> Column:
    """``<a>`` of one state, else the states and the square of relations, a line a row: ``=`` on the diagonal and ``-`` below it."""
    n = F.size(states)
    shown = lambda items: F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    place = lambda i, j: ((i - 1) * n - i * (i - 1) / 2 + j - i).cast("int")
    cell = lambda i, j: F.when(i < j, F.try_element_at(relations, place(i, j))).when(i == j, "=").otherwise("-")
    row = lambda i: F.concat(F.lit("  "), shown(F.transform(F.sequence(F.lit(1), n), lambda j: cell(i, j))))
    square = F.array_join(F.transform(F.sequence(F.lit(1), n), row), "\n")
    return F.when(n == 1, F.concat(F.lit("<"), F.element_at(states, 1), F.lit(">"))).otherwise(F.concat(F.lit("States: "), shown(states), F.lit("\nRelations:\n"), square))


def rule_signature(antecedent: Column, consequent: Column) -> Column:
    return F.concat_ws(" => ", antecedent, consequent)


def signature_states(signature: Column) -> Column:
    """State tokens of a signature's text: tokens with an underscore."""
    words = F.split(F.regexp_replace(signature, r"[()]", " "), r"\s+")
    return F.filter(words, lambda w: w.contains("_"))


def relation_count_size(signature: Column) -> Column:
    """Size of a rule by its text: pieces of both sides between precedes, meets, contains and ==."""
    return F.size(F.split(signature, " precedes | meets | contains |==", -1)) + 1


# Prefixes of heart-signal states.
HEART_PREFIXES = ("bvp_std", "bvp_peak_to_peak", "bvp_spectral_power", "hrv_sdnn", "hrv_rmssd", "hrv_pnn50", "hrv_pnn20", "hrv_cvnn", "hrv_cvsd", "hrv_lf_hf", "hrv_lfn", "hrv_hfn", "hr_")
SKIN_PREFIXES = ("eda",)
EMOTION_PREFIXES = ("arousal", "valence", "emo_")
TEMPERATURE_PREFIXES = ("temp",)


def starts_with_any(state: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [state.startswith(p) for p in prefixes])


def only(states: Column, prefixes: tuple[str, ...]) -> Column:
    """All states, of one at least, start with a prefix."""
    return (F.size(states) > 0) & F.forall(states, lambda s: starts_with_any(s, prefixes))


def heart_only(states: Column) -> Column:
    return only(states, HEART_PREFIXES)


def skin_only(states: Column) -> Column:
    return only(states, SKIN_PREFIXES)


def not_cross(states: Column) -> Column:
    """No emotion state, or a temperature state."""
    emotion = F.exists(states, lambda s: starts_with_any(s, EMOTION_PREFIXES))
    warm = F.exists(states, lambda s: starts_with_any(s, TEMPERATURE_PREFIXES))
    return (F.size(states) > 0) & (~emotion | warm)


def single_feature(states: Column) -> Column:
    return (F.size(states) > 0) & (F.size(F.array_distinct(F.transform(states, state_feature))) == 1)


# What levels mean, in words; the first match is replaced first.
STATE_WORDS = {
    "arousal_low": "low emotional arousal (relaxation, sleepiness)",
    "arousal_medium": "moderate arousal (normal alertness)",
    "arousal_high": "high arousal (excitement or stress)",
    "valence_low": "negative valence (unpleasant emotions)",
    "valence_medium": "neutral valence",
    "valence_high": "positive valence (pleasant emotions)",
    "eda_low": "low skin conductance (low stress, relaxation)",
    "eda_medium": "medium skin conductance (normal wakefulness)",
    "eda_high": "high skin conductance (high stress/arousal)",
    "eda_scr_amp_low": "low SCR amplitude (weak emotional responses)",
    "eda_scr_amp_medium": "medium SCR amplitude",
    "eda_scr_amp_high": "high SCR amplitude (strong emotional responses)",
    "eda_scr_auc_low": "low total electrodermal activity (few responses)",
    "eda_scr_auc_medium": "medium total electrodermal activity",
    "eda_scr_auc_high": "high total electrodermal activity (intense responses)",
    "eda_std_low": "low SCR variability (stable signal)",
    "eda_std_medium": "medium SCR variability",
    "eda_std_high": "high SCR variability (unstable signal)",
    "eda_max_low": "low maximum skin conductance",
    "eda_max_medium": "medium maximum skin conductance",
    "eda_max_high": "high maximum skin conductance (strong response)",
    "eda_peaks_low": "low number of SCRs (1-3 SCR/min, relaxation)",
    "eda_peaks_medium": "medium number of SCRs",
    "eda_peaks_high": "high number of SCRs (high sympathetic activity)",
    "hr_low": "low heart rate",
    "hr_medium": "normal heart rate",
    "hr_high": "elevated heart rate",
    "temp_low": "low skin temperature",
    "temp_medium": "normal skin temperature",
    "temp_high": "elevated skin temperature",
    "hrv_sdnn_low": "low heart rate variability (SDNN)",
    "hrv_sdnn_medium": "medium heart rate variability (SDNN)",
    "hrv_sdnn_high": "high heart rate variability (SDNN)",
    "hrv_rmssd_low": "low heart rate variability (RMSSD)",
    "hrv_rmssd_medium": "medium heart rate variability (RMSSD)",
    "hrv_rmssd_high": "high heart rate variability (RMSSD)",
}
RELATION_WORDS = {"equals": "co-occurs with", "before": "precedes", "meets": "immediately precedes", "overlaps": "overlaps with", "contains": "contains", "starts": "starts with", "is-finished-by": "ends with"}


def pattern_words(text: Column) -> Column:
    """A pattern's text in words: states in bold with their meaning, relations in italics, replaced one after the other."""
    out = text
    for state, words in STATE_WORDS.items():
        out = F.replace(out, F.lit(state), F.lit(f"**{state}** ({words})"))
    for relation, words in RELATION_WORDS.items():
        out = F.replace(out, F.lit(relation), F.lit(f"*{words}*"))
    return out


def rule_words(signature: Column) -> Column:
    """``If .., then ..`` of a rule; text without an arrow stays."""
    parts = F.split(signature, "=>")
    said = F.concat(F.lit("If "), pattern_words(F.trim(F.element_at(parts, 1))), F.lit(", then "), pattern_words(F.trim(F.try_element_at(parts, F.lit(2)))))
    return F.when(signature.contains("=>"), said).otherwise(signature)


def valid_ibi(ms: Column) -> Column:
    """Whether an inter-beat interval is plausible: over 300 and under 2000 ms."""
    return (ms > 300) & (ms < 2000)
