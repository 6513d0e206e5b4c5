"""Queries without SQL call the operators with their full numbers of rounds, trees and samples."""

import pytest

from workload import learning, numbers


@pytest.fixture
def calls(monkeypatch):
    """Keyword arguments by operator; nothing is computed."""
    seen = {}

    def spy(module, name, out=None):
        monkeypatch.setattr(module, name, lambda *a, **b: (seen.setdefault(name, []).append(b), out)[1])

    class Model:
        def fit(self, df):
            return self

    monkeypatch.setattr(learning, "documents", lambda t: None)
    spy(learning.ml, "boosted_classifier", Model())
    for name in ("permutation_importance", "partial_dependence", "shapley", "background_rows", "local_surrogate"):
        spy(learning.ex, name)
    return seen


def test_boosted_model_has_a_hundred_rounds(calls):
    for query in (learning.permutation_importance, learning.partial_dependence):
        query(None)
    assert calls["boosted_classifier"] == [{"maxIter": 100, "maxDepth": 3}] * 2


def test_explanations_take_the_default_samples(calls):
    learning.sampled_shapley(None)
    learning.local_surrogate(None)
    assert calls["shapley"] == calls["background_rows"] == calls["local_surrogate"] == [{}]


def test_influencers_run_to_convergence(monkeypatch):
    seen = []
    monkeypatch.setattr(numbers, "traded", lambda t: (None, None))
    monkeypatch.setattr(numbers, "cut", lambda df: df)
    monkeypatch.setattr(numbers, "exact_quantiles", lambda *a, **b: type("Row", (), {"first": lambda self: {"drop": 1, "keep": 0}})())
    for name in ("pagerank", "influencers"):
        monkeypatch.setattr(numbers.gr, name, lambda *a, **b: seen.append(b.get("max_iter")))
    numbers.influencers(None)
    assert seen == [None, None]
