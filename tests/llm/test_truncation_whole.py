"""What the truncation operator must not leave out."""

import math

import pandas as pd
import pytest

from heaplake.llm import truncation


def test_sample_is_not_lowered():
    assert truncation.SAMPLE_DOCS == 8_000
    assert truncation.fit_endings.__defaults__ == (8_000,)
    assert truncation.truncated.__kwdefaults__["sample_docs"] == 8_000


@pytest.mark.parametrize("share", [0.02, 0.5, 0.9])
def test_prior_follows_the_scores(share):
    """Scores of +-4 in a source where that share of the texts is cut."""
    high = 1 / (1 + math.exp(-4))  # of cut texts, so many score 4, and of whole ones as many -4
    n = [share * high + (1 - share) * (1 - high), share * (1 - high) + (1 - share) * high]
    bins = pd.DataFrame({"source": ["a", "a"], "score": [4.0, -4.0], "n": [round(1e6 * x) for x in n]})
    prior = float(truncation._prior(bins)["prior"].iloc[0])
    assert abs(1 / (1 + math.exp(-prior)) - share) < 0.01
