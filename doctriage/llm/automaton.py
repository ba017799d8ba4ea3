"""A Levenshtein automaton over the trie of a lexicon."""

from __future__ import annotations

_MOST_STATES = 200_000


class Lexicon:
    """Looks up words within one edit of a term, or beginning with a stem.

    The automaton of all terms at once: a state is the set of (trie node, edits left)
    that a beginning of the word leads to.  States are made as words ask for them and kept,
    so a word costs one step for each character until no term is left.
    Terms shorter than ``fuzzy_from`` characters must match exactly.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], fuzzy_from: int = 5):
        self.terms, self.stems, self.fuzzy_from = terms, stems, fuzzy_from
        self.children: list[dict[str, int]] = [{}]
        self.term_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        #: Longest term or stem below a node, so that short ones get no edits.
        self.longest: list[int] = [0]
        for words, ends in ((terms, self.term_at), (stems, self.stem_at)):
            for word in words:
                node = 0
                for c in word:
                    self.longest[node] = max(self.longest[node], len(word))
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.longest.append(0)
                    node = self.children[node][c]
                self.longest[node] = max(self.longest[node], len(word))
                ends[node] = word
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stops: list[tuple[str, int, bool] | None] = []
        self.first = self._state(frozenset({(0, 1)}))

    def _state(self, nodes: frozenset) -> int:
        if nodes not in self.states:
            self.states[nodes] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            self.stops.append(self._stem(nodes))
        return self.states[nodes]

    def _stem(self, nodes: frozenset) -> tuple[str, int, bool] | None:
        found = [(1 - e, self.stem_at[n]) for n, e in nodes if n in self.stem_at and (e == 1 or len(self.stem_at[n]) > self.fuzzy_from)]
        return (min(found)[1], min(found)[0], True) if found else None

    def _next(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def add(node: int, edits: int) -> None:
            if edits or self.longest[node]:
                out[node] = max(edits, out.get(node, -1))

        for node, edits in self.sets[state]:
            below = self.children[node]
            if c in below:
                add(below[c], edits)
            if edits:
                if self.longest[node] >= self.fuzzy_from:
                    add(node, 0)  # a character too many
                for d, child in below.items():
                    if self.longest[child] >= self.fuzzy_from:
                        if d != c:
                            add(child, 0)  # another character
                        if c in self.children[child]:
                            add(self.children[child][c], 0)  # one left out
        return self._state(frozenset(out.items())) if out else -1

    def match(self, word: str) -> tuple[str, int, bool] | None:
        """(term, edits, whether by its stem) of the closest term, or None."""
        if word in self.terms:
            return word, 0, False
        if len(self.sets) > _MOST_STATES:
            self._reset()
        state, stem = self.first, None
        for c in word:
            move = self.moves[state].get(c)
            if move is None:
                move = self.moves[state][c] = self._next(state, c)
            if move < 0:
                return stem
            state = move
            if self.stops[state] and (stem is None or self.stops[state][1] < stem[1]):
                stem = self.stops[state]
        found = []
        for node, edits in self.sets[state]:
            if node in self.term_at and (edits == 1 or len(self.term_at[node]) >= self.fuzzy_from):
                found.append((1 - edits, self.term_at[node]))
            if edits:
                found += [(1, self.term_at[n]) for n in self.children[node].values() if n in self.term_at and len(self.term_at[n]) >= self.fuzzy_from]
        if found and (stem is None or min(found)[0] < stem[1]):
            edits, term = min(found)
            return term, edits, False
        return stem
