"""SQL of folds over long arrays that copy no long array per element."""

from __future__ import annotations


def running(array: str, step: str, zero: str) -> str:
    """SQL of the running fold of an array: element i is the fold of the first i + 1 elements.

    ``step`` is SQL over ``acc`` and ``x``. The array is cut into about the root of its size blocks of that size: the folds of whole blocks
    give each block its start. An empty array gives an empty one.
    """
    width = f"cast(ceil(sqrt(size({array}))) as int)"
    blocks = f"transform(sequence(0, {width} - 1), c -> slice({array}, c * {width} + 1, {width}))"
    grown = lambda a, base: f"aggregate({a}, array({base}), (done, x) -> concat(done, array({_on(step, 'element_at(done, -1)')})))"
    totals = f"transform({blocks}, b -> aggregate(b, {zero}, (acc, x) -> {step}))"
    starts = f"slice({grown(totals, zero)}, 1, {width})"
    return f"CASE WHEN size({array}) = 0 THEN {array} ELSE flatten(zip_with({blocks}, {starts}, (b, base) -> slice({grown('b', 'base')}, 2, size(b)))) END"


def _on(step: str, value: str) -> str:
    return step.replace("acc", value)
