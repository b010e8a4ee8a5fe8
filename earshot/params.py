"""Column names, level orders and analysis parameters.

Nothing in the operators names a subject; everything study-specific is a field
of :class:`Params` and can be replaced by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: labels that must be written exactly so for right results ---
CONDITIONS = ["Baseline", "Recovery", "Post HHL", "Recovery 2", "Post 2nd Exposure"]
# Condition is the first pattern that the phase text ends with; else the default.
PHASE_ENDINGS = [
    ("recovery$", "Recovery"),
    ("post-HL$", "Post HHL"),
    ("recovery2$", "Recovery 2"),
    ("post-HL2$", "Post 2nd Exposure"),
]
EXCLUDED_PHASES = [
    "FA correction", "Maintaince", "Error",
    "Training", "Retraining", "Training, tones", "Reset", "BBN Training",
    "Discrimination training", "Tone discrimination training",
    "Tone discrimination", "Discrimination",
    "Post ABR", "Post ABR, post-HL", "Post ABR, post-HL2",
]
# The older rule set keeps these.
DISCRIMINATION_PHASES = [
    "BBN Training",
    "Discrimination training", "Tone discrimination training",
    "Tone discrimination", "Discrimination",
]
STIM_TYPES = ["BBN", "4kHz", "8kHz", "16kHz", "32kHz"]
STIMS = ["BBN", "tone"]
BACKGROUNDS = ["NA", "30", "50"]
RESPONSES = ["C.R.", "F.A.", "Hit", "Miss"]
BACKGROUND_LABELS = {
    ("NA", "NA"): "Quiet",
    ("PNK", "30"): "30dB Pink Noise Background",
    ("PNK", "50"): "50dB Pink Noise Background",
    ("WN", "50"): "50dB White Noise Background",
    ("PKN", "30"): "30dB Pink Noise Background",
    ("PKN", "50"): "50dB Pink Noise Background",
}
NOISE_TITLES = {
    "PNK": "Pink Background Noise",
    "WN": "White Background Noise",
    "NA": "No Background Noise",
}
ABR_CONDITIONS = ["Baseline", "Hearing Loss", "1 day", "1 week", "2 week", "4-5 week"]
ABR_FREQS = ["4", "8", "16", "32", "BBN"]
SESSION_COLUMNS = [
    "Date", "File", "Weight", "WeightChange", "Trials", "Hit", "FA", "Thresholds", "Phase",
]
SESSION_POSITIONS = [0, 1, 2, 3, 5, 6, 7, 20, 23]
# ------------------------------------------------------------------------------

# Grouping keys used by more than one operator.
SUBJECT_KEYS = ["ID", "Sex", "Condition"]
BACKGROUND_KEYS = ["BG_Type", "BG_Intensity"]
HIT_KEYS = ["ID", "Sex", "Condition", "Stim", "BG_Type", "BG_Intensity"]
DPRIME_KEYS = HIT_KEYS + ["Dur"]
CURVE_KEYS = ["ID", "Sex", "Condition", "BG_Type", "BG_Intensity", "Dur", "Type"]
TH_KEYS = ["ID", "Sex", "Condition", "BG_Type", "BG_Intensity", "Dur"]
RXN_KEYS = ["ID", "Sex", "Condition", "BG_Type", "BG_Intensity", "Stim", "Dur", "Freq", "Inten"]


@dataclass(frozen=True)
class Params:
    """Study parameters; the defaults are the published study's."""

    excluded_subjects: tuple[str, ...] = ("Green 2",)
    min_blocks: int = 5
    th_cutoff: float = 1.5
    block_sizes: dict[str, int] = field(default_factory=lambda: {"tone": 40, "BBN": 10})
