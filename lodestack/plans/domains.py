"""What the values of a dimension are, and which of them a typed word means."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from lodestack.plans.semantic import RequestError

#: A misspelled text must share this much of its letter pairs with the value it means, and so much more than with the next.
ALIKE, LEAD = 0.7, 0.1

#: Most values named in an error.
MOST_NAMED = 8


@dataclass(frozen=True)
class Reading:
    """A stored value; ``said`` is set if the text was another than the value."""

    value: object
    said: str | None = None

    @property
    def note(self) -> str | None:
        return None if self.said is None else f"“{self.said}” is taken to mean {self.value}."


class Flags:
    """True and false."""

    words = {w: truth for truth, ws in ((True, "true yes y 1 on"), (False, "false no n 0 off")) for w in ws.split()}

    def read(self, text: str, exact: bool = False) -> Reading:
        word = text.lower()
        if word not in self.words:
            raise RequestError(f"{text!r} is neither true nor false")
        return Reading(self.words[word])


class Numbers:
    """Integers and decimal numbers; a number that does not occur is one that matches nothing, not an error."""

    form = re.compile(r"[-+]?(?:\d[\d,]*\.?\d*|\.\d+)")

    def read(self, text: str, exact: bool = False) -> Reading:
        if not self.form.fullmatch(text):
            raise RequestError(f"{text!r} is no number")
        return Reading(float(text.replace(",", "")))


def letters(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text.casefold()))


def pairs(text: str) -> Counter:
    return Counter(zip(text, text[1:]))


def likeness(a: Counter, b: Counter) -> float:
    """Shared letter pairs as a part of all (Dice's coefficient)."""
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


@dataclass
class Names:
    """Texts, found over an index of their spellings, then of the beginnings of their words, then by their letter pairs."""

    values: tuple[str, ...]
    aliases: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.spellings: dict[str, set[str]] = defaultdict(set)
        self.words: dict[str, set[str]] = defaultdict(set)
        for value in self.values:
            self.spellings[letters(value)].add(value)
            for word in letters(value).split():
                self.words[word].add(value)
        for alias, value in self.aliases.items():
            if value in self.values:
                self.spellings[letters(alias)].add(value)

    def read(self, text: str, exact: bool = False) -> Reading:
        if text in self.values:
            return Reading(text)
        if not exact:
            for found in (self.spellings.get(letters(text), set()), self._with_words(text)):
                if found:
                    return self._only(text, found)
            near = self._alike(text)
            if near:
                return self._only(text, near)
        raise RequestError(f"no value {text!r}" + self._hint(text))

    def _with_words(self, text: str) -> set[str]:
        """Values in which every word of the text begins a word."""
        begun = [set().union(*(v for w, v in self.words.items() if w.startswith(part))) for part in letters(text).split()]
        return set.intersection(*begun) if begun else set()

    def _ranked(self, text: str) -> list[tuple[float, str]]:
        own = pairs(letters(text))
        return sorted(((likeness(own, pairs(letters(v))), v) for v in self.values), reverse=True)[:MOST_NAMED]

    def _alike(self, text: str) -> set[str]:
        ranked = self._ranked(text)
        return {v for s, v in ranked if s >= ALIKE and s > ranked[0][0] - LEAD}

    def _only(self, text: str, found: set[str]) -> Reading:
        if len(found) > 1:
            raise RequestError(f"{text!r} may be any of {', '.join(sorted(found)[:MOST_NAMED])}")
        return Reading(next(iter(found)), text)

    def _hint(self, text: str) -> str:
        near = [v for s, v in self._ranked(text) if s >= ALIKE / 2][:3]
        return f"; the nearest are {', '.join(near)}" if near else ""


def domain(values: Iterable, aliases: Mapping[str, str] | None = None) -> Flags | Numbers | Names:
    """The domain that fits the values' type."""
    known = list(values)
    if known and all(isinstance(v, bool) for v in known):
        return Flags()
    if known and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in known):
        return Numbers()
    return Names(tuple(str(v) for v in known), aliases or {})
