"""Bands, weights and word lists are pinned: a changed constant is a changed measure."""

from textloom.functions import fixed, indic_lexicon as lists, language
from textloom.operators.english import objective_weights


def test_bands_and_weights():
    assert {k: (g, b, w) for k, g, b, _, w in fixed.ENGLISH_BANDS} == {
        "para_cv": (0.18, 0.02, 0.30), "tell_1k": (0.0, 5.0, 0.30), "colon_lists_1k": (0.0, 5.0, 0.25), "passive_ratio": (0.28, 0.04, 0.15),
    }
    assert {k: (g, b, w) for k, g, b, _, w in fixed.INDIC_BANDS} == {
        "sp_punct_1k": (0.5, 29.8, 0.25), "prep_calque_1k": (0.4, 10.7, 0.25), "rel_1k": (0.4, 3.7, 0.25), "comma_1k": (22.0, 72.0, 0.25),
    }
    assert fixed.TARGET == 70.0


def test_objective_leaves_passives_out():
    assert objective_weights(fixed.ENGLISH_BANDS) == {"para_cv": 0.353, "tell_1k": 0.353, "colon_lists_1k": 0.294}
    assert sum(objective_weights(fixed.INDIC_BANDS).values()) == 1.0


def test_tables_are_complete():
    assert (len(fixed.LANGUAGES), len(fixed.SCRIPT_RANGES), len(fixed.SCRIPT_FAMILY)) == (23, 13, 23)
    assert (len(fixed.FILLER), len(fixed.TELLS), len(fixed.HEDGES["en"]), len(fixed.HEDGES["hi"])) == (17, 21, 24, 11)
    assert (len(fixed.OPENERS), len(fixed.REPLACEMENTS), len(fixed.SUGGESTIONS), len(fixed.CLAIM_VERBS)) == (12, 9, 13, 20)
    assert language.CALIBRATED == ("en", "hi")
    assert "sat" not in lists.CONNECTIVES and len(lists.CONNECTIVES["hi"]) == 15
