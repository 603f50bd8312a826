"""Weighted finite-state transducers: composition, and the best path over a sequence.

An arc turns a symbol into another and weighs the word that bears it: a word of
weight w adds factor * w + bias.  Composition multiplies factors and adds biases;
of several paths the one with the largest sum counts.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Sequence
from dataclasses import dataclass, field

State = Hashable


@dataclass(frozen=True)
class Arc:
    out: str
    to: State
    factor: float = 1.0
    bias: float = 0.0


@dataclass
class Transducer:
    """Arcs by (state, symbol); paths begin in ``start`` and end in one of ``finals``."""

    start: State
    finals: set[State]
    arcs: dict[tuple[State, str], list[Arc]] = field(default_factory=dict)

    @classmethod
    def grown(cls, start: State, symbols: Iterable[str], step: Callable[[State, str], Iterable[Arc]], final: Callable[[State], bool] = lambda s: True) -> Transducer:
        """The transducer of all states that ``step`` reaches from ``start``."""
        symbols, open_, known, arcs = list(symbols), [start], {start}, {}
        while open_:
            state = open_.pop()
            for symbol in symbols:
                made = list(step(state, symbol))
                if made:
                    arcs[state, symbol] = made
                for arc in made:
                    if arc.to not in known:
                        known.add(arc.to)
                        open_.append(arc.to)
        return cls(start, {s for s in known if final(s)}, arcs)

    def outputs(self) -> list[str]:
        return sorted({arc.out for made in self.arcs.values() for arc in made})

    def symbols(self) -> list[str]:
        return sorted({symbol for _, symbol in self.arcs})

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, ``other`` reads."""

        def step(state: tuple[State, State], symbol: str) -> Iterable[Arc]:
            for one in self.arcs.get((state[0], symbol), ()):
                for two in other.arcs.get((state[1], one.out), ()):
                    yield Arc(two.out, (one.to, two.to), one.factor * two.factor, one.bias + two.bias)

        return Transducer.grown((self.start, other.start), self.symbols(), step, lambda s: s[0] in self.finals and s[1] in other.finals)

    def numbered(self) -> Transducer:
        """The same with small numbers for states; of arcs that differ only in what they write one is kept."""
        names: dict[State, int] = {}
        number = lambda s: names.setdefault(s, len(names))
        start = number(self.start)
        arcs = {(number(s), x): list(dict.fromkeys(Arc("", number(a.to), a.factor, a.bias) for a in made)) for (s, x), made in self.arcs.items()}
        return Transducer(start, {number(s) for s in self.finals}, arcs)

    def best(self, words: Sequence[tuple[str, float]]) -> float | None:
        """The largest weight of a path over (symbol, weight) pairs; None if no path takes them all."""
        here = {self.start: 0.0}
        for symbol, weight in words:
            after: dict[State, float] = {}
            for state, so_far in here.items():
                for arc in self.arcs.get((state, symbol), ()):
                    value = so_far + arc.factor * weight + arc.bias
                    if value > after.get(arc.to, float("-inf")):
                        after[arc.to] = value
            here = after
        return max((v for s, v in here.items() if s in self.finals), default=None)
