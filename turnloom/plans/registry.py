"""All registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from turnloom.plans import alignment, bayes, captions, evaluation, index, intervals, live, matching, memory, quarantine, retrieval, reviews, rows, segments, sentences, sequence, splits, ticks, tracklets, vectors


def _modules():
    return [intervals, vectors, sequence, retrieval, live, captions, rows, memory, evaluation, matching, ticks, reviews, segments, alignment, sentences, tracklets, bayes, splits, quarantine, index]


def queries() -> dict:
    return {name: query for m in _modules() for name, query in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.oracle_sql().items()}
