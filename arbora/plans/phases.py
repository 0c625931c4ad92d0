"""A runner for phases that depend on one another, with fingerprints to skip what is unchanged."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Phase:
    name: str
    run: Callable[[dict[str, Any]], Any]
    needs: list[str] = field(default_factory=list)
    fingerprint: Callable[[dict[str, Any]], str] | None = None


def phase_order(phases: list[Phase]) -> list[Phase]:
    """Dependencies first, else in list order; needs that are not listed are ignored; cycles and twin names raise."""
    by = {p.name: p for p in phases}
    if len(by) != len(phases):
        raise ValueError("two phases have the same name")
    done: list[Phase] = []
    waiting = list(phases)
    while waiting:
        ready = next((p for p in waiting if all(n not in by or by[n] in done for n in p.needs)), None)
        if ready is None:
            raise ValueError("phases form a cycle: " + ", ".join(p.name for p in waiting))
        waiting.remove(ready)
        done.append(ready)
    return done


def run_phases(phases: list[Phase], state: dict[str, Any] | None = None, known: dict[str, str] | None = None) -> tuple[dict[str, Any], dict[str, float]]:
    """Runs phases in order; each result is stored in state under the phase's name.

    known maps names to fingerprints of an earlier run; a phase whose fingerprint
    is the same is skipped. Returns the state and the seconds of each phase.
    """
    state, known, took = state if state is not None else {}, known if known is not None else {}, {}
    for p in phase_order(phases):
        mark = p.fingerprint(state) if p.fingerprint else None
        if mark is not None and known.get(p.name) == mark:
            continue
        began = time.perf_counter()
        state[p.name] = p.run(state)
        took[p.name] = time.perf_counter() - began
        if mark is not None:
            known[p.name] = mark
    return state, took
