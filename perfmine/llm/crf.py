"""A semi-Markov conditional random field over the atoms of a short stretch of text.

A stretch is cut into atoms. A segmentation labels some runs of atoms as entities;
what is left over scores nothing. An entity's score is the sum of the weights of
features of the whole span, so boundaries and types are chosen together. Entities
have at most ``MOST_ATOMS`` atoms, which bounds the dynamic programme: its work is
linear in the length of the stretch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

MOST_ATOMS = 24


@dataclass(frozen=True)
class Candidate:
    """Atoms ``begin`` to ``end`` (exclusive) as an entity of type ``kind``."""

    begin: int
    end: int
    kind: str
    features: tuple[str, ...]


def log_add(values: Iterable[float]) -> float:
    values = list(values)
    most = max(values)
    return most + math.log(sum(math.exp(v - most) for v in values))


@dataclass
class SemiMarkovField:
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, candidate: Candidate) -> float:
        return sum(self.weights.get(f, 0.0) for f in candidate.features)

    def posteriors(self, n: int, candidates: list[Candidate]) -> list[float]:
        """Probability of each candidate over all segmentations of ``n`` atoms."""
        scores = [self.score(c) for c in candidates]
        ends: dict[int, list[int]] = {}
        begins: dict[int, list[int]] = {}
        for k, c in enumerate(candidates):
            ends.setdefault(c.end, []).append(k)
            begins.setdefault(c.begin, []).append(k)
        forward = [0.0] * (n + 1)
        for i in range(1, n + 1):
            forward[i] = log_add([forward[i - 1], *(forward[candidates[k].begin] + scores[k] for k in ends.get(i, ()))])
        backward = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            backward[i] = log_add([backward[i + 1], *(backward[candidates[k].end] + scores[k] for k in begins.get(i, ()))])
        return [math.exp(min(0.0, forward[c.begin] + s + backward[c.end] - forward[n])) for c, s in zip(candidates, scores)]

    def best(self, n: int, candidates: list[Candidate]) -> list[int]:
        """The candidates of the best segmentation; a tie goes to fewer entities."""
        ends: dict[int, list[int]] = {}
        for k, c in enumerate(candidates):
            ends.setdefault(c.end, []).append(k)
        best, chosen = [0.0] * (n + 1), [-1] * (n + 1)
        for i in range(1, n + 1):
            best[i] = best[i - 1]
            for k in ends.get(i, ()):
                s = best[candidates[k].begin] + self.score(candidates[k])
                if s > best[i]:
                    best[i], chosen[i] = s, k
        out, i = [], n
        while i:
            if chosen[i] < 0:
                i -= 1
            else:
                out.append(chosen[i])
                i = candidates[chosen[i]].begin
        return out[::-1]


def fit(examples: list[tuple[int, list[Candidate], set[int]]], rounds: int = 40, rate: float = 0.5, decay: float = 1e-3) -> SemiMarkovField:
    """Maximise the likelihood of the examples (atoms, candidates, true candidates) by adaptive gradient steps."""
    model, squares = SemiMarkovField(), {}
    for _ in range(rounds):
        for n, candidates, true in examples:
            gradient: dict[str, float] = {}
            for k, p in enumerate(model.posteriors(n, candidates)):
                by = (k in true) - p
                for f in candidates[k].features if abs(by) > 1e-4 else ():
                    gradient[f] = gradient.get(f, 0.0) + by
            for f, g in gradient.items():
                g -= decay * model.weights.get(f, 0.0)
                squares[f] = squares.get(f, 1.0) + g * g
                model.weights[f] = model.weights.get(f, 0.0) + rate * g / math.sqrt(squares[f])
    return model


def candidates_of(
    atoms: list[str], spans: Iterable[tuple[int, int]], describe: Callable[[list[str], int, int], dict[str, tuple[str, ...]]]
) -> list[Candidate]:
    """The types and features that ``describe`` gives the runs of atoms named by ``spans``."""
    return [Candidate(begin, end, kind, f) for begin, end in spans for kind, f in describe(atoms, begin, end).items()]
