"""Many strings looked for in a text at once, over an automaton with fail links."""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick


class Patterns:
    """A bounded set of strings; a text is read once, however many there are. Empty strings are left out."""

    def __init__(self, patterns: Iterable[str]) -> None:
        self._held = ahocorasick.Automaton()
        for p in patterns:
            if p:
                self._held.add_word(p, p)
        if len(self._held):
            self._held.make_automaton()

    def within(self, text: str | None) -> set[str]:
        """The strings that the text contains."""
        return {p for _, p in self._held.iter(text)} if text and len(self._held) else set()
