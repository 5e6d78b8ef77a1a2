"""Hyperparameters proposed from the trials so far, by the ratio of two Parzen densities.

Trials are split into a few good ones and the rest. Each parameter has a density among the good
and among the rest: smoothed counts for choices, sums of normal bumps for numbers (on a
logarithmic scale where they span more than a factor of ten). Of some candidates drawn from the
space itself, the one that the good trials make most likely against the rest is proposed.
"""

from __future__ import annotations

import math

#: Trials drawn without a model, candidates drawn for each later one, share of good trials.
STARTUP, CANDIDATES, GOOD_SHARE, MOST_GOOD = 10, 24, 0.1, 25


def _numeric(values: list) -> bool:
    return all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)


def _log_density(value, known: list, drawn: list) -> float:
    """Of a value among known ones; `drawn` shows how far the parameter ranges."""
    if not _numeric([value, *known, *drawn]):
        same = sum(_plain(k) == _plain(value) for k in known)
        return math.log((same + 1) / (len(known) + len({str(_plain(d)) for d in drawn})))
    low, high = min([*known, *drawn]), max([*known, *drawn])
    if low > 0 and high > 10 * low:
        value, low, high, known = math.log(value), math.log(low), math.log(high), [math.log(k) for k in known]
    spread = max(high - low, 1e-12)
    # One wide bump stands for the space itself, so that nothing becomes impossible.
    bumps = [((low + high) / 2, spread), *((k, spread / max(len(known), 1) ** 0.5 / 2) for k in known)]
    total = sum(math.exp(-0.5 * ((value - m) / w) ** 2) / w for m, w in bumps)
    return math.log(max(total / len(bumps), 1e-300))


def _plain(value):
    return tuple(value) if isinstance(value, (list, tuple)) else value


def propose(candidates: list[dict], trials: list[dict], metric: str) -> dict:
    """The candidate most like the good trials and least like the rest; the first of equals."""
    ranked = sorted(trials, key=lambda t: (-t[metric], t["trial"]))
    cut = min(max(math.ceil(GOOD_SHARE * len(ranked)), 1), MOST_GOOD)
    good, rest = ranked[:cut], ranked[cut:]

    def worth(params: dict) -> float:
        out = 0.0
        for name, value in params.items():
            drawn = [c[name] for c in candidates if name in c]
            sides = ([t["params"][name] for t in side if name in t["params"]] for side in (good, rest))
            likely, unlikely = (_log_density(value, known, drawn) for known in sides)
            out += likely - unlikely
        return out

    return max(candidates, key=worth)
