"""Thresholds and small vocabularies that fix the results (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass

DISORDER, CHEMICAL = "Disorder", "Chemical or drug"
#: Semantic type codes of the two groups.
DISORDER_TUIS = ("T020", "T190", "T049", "T019", "T047", "T050", "T033", "T037", "T048", "T191", "T046", "T184")
CHEMICAL_TUIS = ("T116", "T195", "T123", "T122", "T103", "T120", "T104", "T200", "T196", "T126", "T131", "T125", "T129", "T130", "T197", "T114", "T109", "T121", "T192", "T127")
GENERIC_WORDS = ("מחלה", "תרופה")
FEATURES = ("match_count", "match_freq", "pred_3_window", "pred_6_window", "pred_10_window", "relatedness")


@dataclass(frozen=True)
class Thresholds:
    """Similarities are strict where the name says ``above``."""

    low_single: float = 0.78
    above_single: float = 0.85
    low_multi: float = 0.83
    above_multi: float = 0.90
    above_occurrence: float = 0.88
    above_relocation: float = 0.82
    label: float = 0.80
    in_place: float = 0.72
    max_words: int = 3
    dedupe_chars: int = 2
    label_chars: int = 3
    lemma_chars: int = 4
    trees: int = 50
    test_share: float = 0.25


T = Thresholds()
