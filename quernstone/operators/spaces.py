"""Spaces of screen configurations: the default one, tighter ones only, and the order of a beam."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from quernstone.operators.screen import BLOCKS, validate

# The profiles beside the base one, and the steps of each gate.
PROFILES = ((0.25, 0.25, 0.25, 0.25), (0.6, 0.15, 0.1, 0.15), (0.2, 0.5, 0.15, 0.15), (0.2, 0.15, 0.5, 0.15))
RAISED = {"min_roe": (0.12, 0.16), "min_cash_conversion": (1.0, 1.2), "min_score": (70.0, 75.0)}
LOWERED = {"max_net_debt_to_cfo": (2.0, 0.0)}
#: The base configuration.
BASE = {"weights": {"quality": 0.4, "value": 0.25, "growth": 0.2, "balance": 0.15}, "min_roe": 0.08, "min_cash_conversion": 0.8, "max_net_debt_to_cfo": 4.0, "min_score": 65.0}


def default_space(base: Mapping = BASE) -> dict[str, list]:
    """Five weight profiles by three steps of each of four gates; a step never loosens a gate of the base.

    A block without a weight in the base has none in any profile.
    """
    on = [b for b in BLOCKS if base["weights"][b] > 0]
    profiles = [dict(base["weights"])]
    for p in PROFILES:
        whole = sum(w for b, w in zip(BLOCKS, p) if b in on)
        profiles.append({b: w / whole if b in on else 0.0 for b, w in zip(BLOCKS, p)})
    steps = {k: [base[k], *(max(base[k], v) for v in more)] for k, more in RAISED.items()} | {k: [base[k], *(min(base[k], v) for v in more)] for k, more in LOWERED.items()}
    return {"weights": profiles, **{k: steps[k] for k in ("min_roe", "min_cash_conversion", "max_net_debt_to_cfo", "min_score")}}


def configurations(space: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of a space, in its order."""
    return [dict(zip(space, values)) for values in product(*space.values())]


def check_space(space: Mapping[str, Sequence], base: Mapping = BASE) -> None:
    """Refuse axes that are unknown or empty, gates looser than the base, and blocks that the base turned off or on."""
    if not space or set(space) - set(base):
        raise ValueError("a space has known axes, and at least one")
    for axis, values in space.items():
        if not values:
            raise ValueError(f"{axis} has no values")
        for v in values:
            if axis == "weights":
                validate(v)
                if [w > 0 for w in v.values()] != [base["weights"][b] > 0 for b in v]:
                    raise ValueError("a block may not be turned on or off")
            elif (v > base[axis]) if axis.startswith("max_") else (v < base[axis]):
                raise ValueError(f"{axis} may only be tightened")


def beam_order(chosen: int, mean_score: float | None, distance: float, target: int) -> tuple:
    """Key of a configuration in a beam, the best first: those that fill the target, then how near they come to it, mean score, nearness to the base.

    One that chooses too few may be all that is left after every tighter step,
    so that it comes last.
    """
    return (chosen < target, abs(chosen - target), -(mean_score if mean_score is not None else -1.0), distance)


def distance(config: Mapping, base: Mapping = BASE) -> float:
    """Sum of the weights' changes and of the gates' changes relative to the base's own values, at least 1 where a value is 0."""
    moved = sum(abs(config["weights"][b] - base["weights"][b]) for b in BLOCKS)
    return moved + sum(abs(config[k] - base[k]) / max(abs(base[k]), 1e-9 if base[k] else 1.0) for k in base if k != "weights")
