"""Whole commands: train, prune and score a model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import to_ids
from ..operators import counts as C
from ..operators import gradient, reestimate
from ..operators import vocab as V
from ..operators.model import Model, estimate, log_prob
from ..session import cut, scratch
from . import optimise as O

SCHEDULE = "prune*0.25 EM EM EM prune*0.5 EM EM EM prune*1.0 EM EM EM prune*1.0 EM EM EM"


@dataclass
class Trained:
    model: Model
    vocab: DataFrame
    params: dict[str, float]
    per_word: float
    inverse: np.ndarray | None = None


def optimise(counts: DataFrame, dev: DataFrame, order: int, num_words: int, params: dict[str, float], inverse: np.ndarray | None = None, most: int = 30) -> tuple[dict[str, float], float, np.ndarray]:
    """The best scales and discounts found from ``params``, the log-probability a word with them, and the inverse Hessian."""
    names, x = O.to_free(params, order)

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        now = O.from_free(names, x)
        with scratch(counts.sparkSession):
            value, grad = gradient.derivatives(counts, dev, order, num_words, *O.split(now, order), cut)
        return -value, -O.free_gradient(names, x, grad)

    found = O.Bfgs(f, x, inverse, most=most)
    best = O.from_free(names, found.x)
    if best[f"order{order}_D1"] < 0.1:
        raise ValueError("the first discount is under 0.1: the held-out text seems to be in the training text")
    return best, -found.values[-1], found.inverse


def train(lines: DataFrame, order: int, num_words: int | None = None, word_list: list[str] | None = None, dev: str = "dev", min_counts: str | None = None, limit_unknown: bool = False,
          fold_dev_into: str | None = None, warm_start_ratio: int | None = None, params: dict[str, float] | None = None, most: int = 30) -> Trained:
    """A tuned model from lines (source, doc, line_no, line), of which source ``dev`` is held out.

    Word counts, weights of sources, vocabulary, n-gram counts, parameters (given ones are taken as they are; else tuned, from a
    first tuning on one in ``warm_start_ratio`` histories if asked for), and the model of all sources.
    """
    held, own = lines.where(F.col("source") == dev), lines.where(F.col("source") != dev)
    words = cut(V.word_counts(own))
    weights = V.unigram_weights(words, V.word_counts(held))
    vocab = cut(V.vocabulary_of_list(lines.sparkSession, word_list) if word_list else V.vocabulary(words, num_words or 20_000, weights))
    size = vocab.count() - 1
    counts = cut(C.int_counts(to_ids(own, vocab), order, limit_unknown))
    dev_counts = cut(C.merge_int_counts(C.int_counts(to_ids(held, vocab), order, limit_unknown)))
    names, lost = sorted(weights), None
    if min_counts:
        counts, lost = C.enforce_min_counts(counts, order, C.parse_min_counts(min_counts, order, names))
        counts, lost = cut(counts), cut(lost)
    per_word, inverse = float("nan"), None
    if params is None:
        start = O.initial(names, order, weights if len(names) > 1 else None)
        if warm_start_ratio and warm_start_ratio > 1:
            start, _, inverse = optimise(cut(C.subset(counts, warm_start_ratio)), cut(C.subset(dev_counts, warm_start_ratio)), order, size, start, most=most)
        params, per_word, inverse = optimise(counts, dev_counts, order, size, start, inverse, most)
    bad = O.problems(params, order)
    if bad:
        raise ValueError("; ".join(bad))
    scales, discounts = O.split(params, order)
    fold = (dev_counts, scales[fold_dev_into]) if fold_dev_into else None
    return Trained(estimate(counts, order, size, scales, discounts, lost, fold).cut(), vocab, params, per_word, inverse)


def parse_steps(given: str) -> list[float | None]:
    """'prune*0.5 EM' as [0.5, None]."""
    out: list[float | None] = []
    for step in given.split():
        if step == "EM":
            out.append(None)
        elif step.startswith("prune*") and float(step[6:]) > 0:
            out.append(float(step[6:]))
        else:
            raise ValueError(f"not a step: {step}")
    if not out or out[0] is None:
        raise ValueError("the first step must prune")
    return out


def prune(model: Model, threshold: float, schedule: str = SCHEDULE) -> tuple[Model, float]:
    """``model`` pruned along the schedule with ``threshold`` times its factors and re-estimated, and what that costs in log-probability a word."""
    stats = reestimate.statistics(model, cut).cut()
    before, _ = reestimate.stats_log_prob(model, stats)
    now, now_stats, last, changes = model, stats, before, 0.0
    for step in parse_steps(schedule):
        now, now_stats, cost = _step(now, now_stats, None if step is None else step * threshold)
        if step is None:
            value, words = reestimate.stats_log_prob(now, now_stats)
            changes, last = changes + value - last, value
        else:
            words = reestimate.stats_log_prob(now, now_stats)[1]
            changes, last = changes + cost / words, last + cost / words
    after, _ = reestimate.stats_log_prob(now, now_stats)
    now.meta |= {"was_pruned": "true", "approximate_divergence": -changes, "divergence": before - after}
    return now, before - after


def _step(model: Model, stats: Model, threshold: float | None) -> tuple[Model, Model, float]:
    """A step's model and statistics, and what a pruning costs in log-probability."""
    if threshold is None:
        return reestimate.maximised(model, stats).cut(), stats, 0.0
    new, cost = reestimate.pruned(model, threshold, cut)
    small, small_stats = reestimate.without_zeros(new, stats)
    return small.cut(), small_stats.cut(), cost


def prune_to(model: Model, ngrams: int, threshold: float = 0.25, most: int = 20) -> Model:
    """``model`` pruned to about ``ngrams`` n-grams (to 5 %), with two steps of re-estimation after each pruning."""
    total = model.counts.count()
    if ngrams >= total * 0.95:
        return model  # it's there already
    unigrams = model.counts.where("ord = 1").count()
    stats = reestimate.statistics(model, cut).cut()
    sizes = O.SizeModel(unigrams, ngrams, threshold)
    sizes.record(total, None)
    states = [(model, stats)]
    for _ in range(most):
        at = sizes.next()
        now = _step(*states[-1], at)[:2]
        for _ in range(2):
            now = _step(*now, None)[:2]
        sizes.record(now[0].counts.count(), at)
        if sizes.reached():
            states.append(now)
            break
        if sizes.overshot():
            if len(states) == 1 and at / 4 < 1e-9:
                raise ValueError("no threshold prunes the model to so many n-grams")
            if len(states) == 1:
                sizes = O.SizeModel(unigrams, ngrams, at / 4)
                sizes.record(total, None)
            else:
                sizes.back()
            continue
        states.append(now)
    else:
        raise ValueError(f"the model isn't within 5 % of {ngrams} n-grams after {most} steps")
    found = states[-1][0]
    found.meta["was_pruned"] = "true"
    return found


def data_log_prob(trained_model: Model, vocab: DataFrame, lines: DataFrame) -> DataFrame:
    """words, logprob, per_word and perplexity of lines (source, doc, line_no, line)."""
    grams = C.merge_int_counts(C.int_counts(to_ids(lines, vocab), trained_model.order))
    return log_prob(trained_model, grams)
