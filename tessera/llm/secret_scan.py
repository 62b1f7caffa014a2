"""Secret scanning by inferred grammars (operator 9).

For each labelled format a probabilistic automaton is inferred: labelled
credentials build a prefix tree with counts, and states are merged from the
root outwards while their outgoing and ending frequencies agree within a
Hoeffding bound, so the fixed head of a format stays a chain and its random
body becomes a loop.  Candidates, runs of token characters in a text, are scored
by the log likelihood a character under the best format that spells them against
that under automata inferred in the same way from shapes of ordinary tokens
(words, names, digests, numbers), of which the likeliest explains each piece of a
run.  A run that no format spells as a whole is searched for credentials inside it: the
automata start at each fixed head of a format, and after each separator for formats
without one, all starts in one pass.

A format without a head is told from other runs by likelihood alone, so three
exact checks follow there: the length is one that its examples have, what is left
of the stretch in its alphabet is ordinary, and the run is not base64 of readable
text.  Spans of the base patterns always stay; a candidate is added where its
format likelihood is high enough and it overlaps no base span.  What a base span
leaves of a run is scored too.

The labelled credentials are made by rule from the public shapes of formats;
none is a real one.  Other labelled lists are a parameter.

Defined results: a null or empty text has no spans; a null doc_id is returned as
null; repeated rows get equal results.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import math
import os
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents

#: Fixed by the contract: base kinds in order, patterns and least lengths.
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_KEYWORDS = ("passw", "secret", "token", "api")

#: Confidence of the merge test, and the log likelihood a character over ordinary tokens from which a candidate counts.
ALPHA, MIN_GAIN = 0.05, 0.0
#: What a symbol of a format counts for in a state that has not seen it, and any symbol in ordinary shapes.
SHARE, UNSEEN = 0.2, 0.01
#: The most characters of a format's fixed head that keep their identity; all others count by class.
HEAD = 6
#: The shortest run that is scored.
LEAST = 16
#: Characters after which an embedded credential without a fixed head may start, before which one may end, and that end no credential.
STARTS, ENDS, TRIM = "=/._-", "=/.", ".-_/+"
#: Characters between ordinary tokens, the log odds of another shape without one, and those that a credential starts or ends the run or follows a name and =.
BREAKS, SWITCH, NAMED = "=/._-+", -8.0, 6.0
#: The shortest rest beside a part that is asked whether it is ordinary, and the longest piece whose likelihoods are kept.
REST, LONG = 4, 64
_PIECE, _BREAK = re.compile(r"[=/._+-]|[^=/._+-]+"), math.log(len(BREAKS))
#: Labelled examples of each format.
EXAMPLES = 150
CACHE = 100_000

_UPPER, _LOWER, _DIGIT, _HEXL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
_URL64 = _UPPER + _LOWER + _DIGIT + "-_"
_ALNUM = _UPPER + _LOWER + _DIGIT

#: Public shapes: a format's parts, each fixed text or (alphabet, least, most).
FORMATS = {
    "github": ["ghp_", (_ALNUM, 36, 36)],
    "gitlab": ["glpat-", (_URL64, 20, 20)],
    "slack": ["xoxb-", (_DIGIT, 11, 12), "-", (_DIGIT, 11, 12), "-", (_ALNUM, 24, 24)],
    "stripe": ["sk_live_", (_ALNUM, 24, 32)],
    "google": ["AIza", (_URL64, 35, 35)],
    "jwt": ["eyJ", (_URL64, 20, 40), ".eyJ", (_URL64, 40, 80), ".", (_URL64, 43, 43)],
    "base64key": [(_ALNUM + "+/", 40, 44)],
}


def labelled_credentials(seed: int = 7, examples: int = EXAMPLES) -> list[tuple[str, str]]:
    """(format, credential) pairs made by rule from the public shapes."""
    rng = random.Random(seed)
    part = lambda p: p if isinstance(p, str) else "".join(rng.choices(p[0], k=rng.randint(p[1], p[2])))
    return [(name, "".join(part(p) for p in parts)) for name, parts in FORMATS.items() for _ in range(examples)]


#: Letters with their usual share of English text in a thousand.
_SHARES = {"e": 127, "t": 91, "a": 82, "o": 75, "i": 70, "n": 67, "s": 63, "h": 61, "r": 60, "d": 43, "l": 40, "c": 28, "u": 28,
           "m": 24, "w": 24, "f": 22, "g": 20, "y": 20, "p": 19, "b": 15, "v": 10, "k": 8, "j": 2, "x": 2, "q": 1, "z": 1}


def ordinary_shapes(seed: int = 11, examples: int = 1_200) -> list[tuple[str, str]]:
    """(shape, token) pairs that are no secrets: words, joined names, paths, identifiers, digests, dates, numbers, rules."""
    rng = random.Random(seed)
    letters, weights = list(_SHARES), list(_SHARES.values())
    word = lambda a=3, b=9: "".join(rng.choices(letters, weights, k=rng.randint(a, b)))
    some = lambda make, a=3, b=5: [make() for _ in range(rng.randint(a, b))]
    number = lambda a=1, b=4: "".join(rng.choices(_DIGIT, k=rng.randint(a, b)))
    name = lambda: word().capitalize() + (number(1, 2) if rng.random() < 0.15 else "")
    shapes = {
        "word": lambda: word(3, 30),
        "title": lambda: word(3, 24).capitalize(),
        "capitals": lambda: "".join(some(lambda: word().upper(), 1, 3)),
        "dashed": lambda: rng.choice("-_.").join(some(word)),
        "path": lambda: "/".join(some(word, 3, 6)) + ".html",
        "camel": lambda: "".join(some(name)),
        "acronyms": lambda: "".join(some(lambda: word(2, 4).upper() if rng.random() < 0.3 else word().capitalize())),
        "lower-camel": lambda: word() + "".join(some(name, 1, 4)),
        "numbered": lambda: word() + number(),
        "number": lambda: number(2, 24),
        "date": lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{word(6, 9)}",
        "digest": lambda: "".join(rng.choices(_HEXL, k=rng.choice((8, 12, 16, 31)))),
        "upper-digest": lambda: "".join(rng.choices(_HEXL.upper(), k=rng.choice((8, 12, 32, 40)))),
        "rule": lambda: rng.choice("-=_.+/") * rng.randint(16, 80),
    }
    names = list(shapes)
    return [(names[i % len(names)], shapes[names[i % len(names)]]()) for i in range(examples)]


def ordinary_tokens(seed: int = 11, examples: int = 1_200) -> list[str]:
    """The tokens of the ordinary shapes."""
    return [token for _, token in ordinary_shapes(seed, examples)]


def readable(token: str) -> bool:
    """Whether a token is base64 of readable UTF-8 text, but for a character cut at the end."""
    whole = token[: len(token) // 4 * 4]
    try:
        raw = base64.b64decode(whole, validate=True)
    except (binascii.Error, ValueError):
        return False
    for cut in range(min(4, len(raw))):
        try:
            text = raw[: len(raw) - cut].decode()
        except UnicodeDecodeError:
            continue
        return sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.9 * len(text)
    return False


#: A character's class and its log probability inside the class; other characters stand for themselves.
_CLASS = {c: (s, -math.log(len(group))) for s, group in (("9", _DIGIT), ("h", "abcdef"), ("l", _LOWER[6:]), ("H", "ABCDEF"), ("U", _UPPER[6:])) for c in group}


def symbols(token: str, head: int = 0) -> Iterator[tuple[str, float]]:
    """The symbols of a token and each one's log probability inside its class."""
    for i, c in enumerate(token):
        yield (c, 0.0) if i < head else _CLASS.get(c, (c, 0.0))


class Automaton:
    """A probabilistic automaton inferred from labelled tokens by state merging."""

    def __init__(self, tokens: list[str], alpha: float = ALPHA, share: float = SHARE) -> None:
        self.share = share
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.visits = [0], [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.head = os.path.commonprefix(tokens)[:HEAD]
        for token in tokens:
            state = 0
            self.visits[0] += 1
            for s, _ in symbols(token, len(self.head)):
                self.count[state][s] = self.count[state].get(s, 0) + 1
                state = self.next[state].setdefault(s, len(self.next))
                if state == len(self.next):
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                self.visits[state] += 1
            self.ends[state] += 1
        self.shortest, self.longest = min(map(len, tokens)), max(map(len, tokens))
        body = len(self.head)
        self.alphabet = {s for token in tokens for i, (s, _) in enumerate(symbols(token, body)) if i >= body}
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ends[a], self.visits[a], self.ends[b], self.visits[b]):
                return False
            for s in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(s, 0), self.visits[a], self.count[b].get(s, 0), self.visits[b]):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a tree to a state and, deterministically, to what follows it."""
        todo = [(into, tree)]
        while todo:
            into, tree = todo.pop()
            self.ends[into] += self.ends[tree]
            self.visits[into] += self.visits[tree]
            for s, n in self.count[tree].items():
                self.count[into][s] = self.count[into].get(s, 0) + n
                if s in self.next[into]:
                    todo.append((self.next[into][s], self.next[tree][s]))
                else:
                    self.next[into][s] = self.next[tree][s]

    def _merge(self) -> None:
        red, at = [0], 0
        while at < len(red):
            state = red[at]
            moved = False
            for s, child in sorted(self.next[state].items()):
                if child in red:
                    continue
                for other in red:
                    if self._compatible(other, child):
                        self.next[state][s] = other
                        self._fold(other, child)
                        moved = True
                        break
                else:
                    red.append(child)
            at = 0 if moved else at + 1
        self.states = len(red)
        self._steps: dict[tuple[int | None, str], tuple[float, int | None]] = {}

    def step(self, state: int | None, s: str) -> tuple[float, int | None]:
        """The log likelihood of a symbol and the next state.

        An unseen step has a small share of a state's mass, a symbol of the
        format a larger one.  If the format uses
        the symbol elsewhere, it goes on where most steps from the state go, so
        that one rare letter does not make the rest of a token unreadable; a
        symbol that the format never has leads nowhere.
        """
        if (state, s) not in self._steps:
            n, seen, after = (0, 0, None) if state is None else (self.count[state].get(s, 0), self.visits[state], self.next[state].get(s))
            if after is None and state is not None and s in self.alphabet and self.next[state]:
                after = self.next[state][max(self.count[state].items(), key=lambda x: (x[1], x[0]))[0]]
            share = self.share if s in self.alphabet else UNSEEN
            self._steps[state, s] = math.log((n + share) / (seen + self.share * len(self.alphabet) + 1)), after
        return self._steps[state, s]

    def score(self, token: str) -> float:
        """The log likelihood a character."""
        state: int | None = 0
        total = 0.0
        for s, inner in symbols(token, len(self.head)):
            gain, state = self.step(state, s)
            total += inner + gain
        return total / max(1, len(token))

    def spells(self, token: str) -> bool:
        """Whether the token begins with the format's head and has no symbol that the format never has."""
        state: int | None = 0
        for s, _ in symbols(token, len(self.head)):
            state = self.step(state, s)[1]
            if state is None:
                return False
        return token.startswith(self.head)

    def may_be(self, token: str) -> bool:
        """Whether the format spells the whole token; one without a head only at lengths of its examples, and no readable text."""
        if len(token) < self.shortest or not self.spells(token):
            return False
        return bool(self.head) or len(token) <= self.longest and not readable(token)


class Grammars:
    """An automaton a format, and one a shape of ordinary tokens."""

    def __init__(self, labelled: list[tuple[str, str]], ordinary: list[tuple[str, str]]) -> None:
        self.formats = self._inferred(labelled)
        self.order = {name: i for i, name in enumerate((*BASE, *self.formats))}
        self.shapes = list(self._inferred(ordinary, UNSEEN).values())
        self._seen: dict[str, tuple[float, str]] = {}
        self._pieces: dict[str, list[float]] = {}

    @staticmethod
    def _inferred(pairs: list[tuple[str, str]], share: float = SHARE) -> dict[str, Automaton]:
        by: dict[str, list[str]] = {}
        for name, token in pairs:
            by.setdefault(name, []).append(token)
        return {name: Automaton(tokens, share=share) for name, tokens in sorted(by.items())}

    def ordinary(self, run: str) -> list[float]:
        """For each prefix of a run its log likelihood as ordinary tokens, one after another with a separator between them."""
        out = [0.0]
        for m in _PIECE.finditer(run):
            piece, before = m[0], out[-1]
            if piece in BREAKS:
                out.append(before - _BREAK)
                continue
            if piece not in self._pieces:
                if len(self._pieces) >= CACHE:
                    self._pieces.clear()
                if len(piece) > LONG:
                    out += [before + x for x in self._piece(piece)]
                    continue
                self._pieces[piece] = self._piece(piece)
            out += [before + x for x in self._pieces[piece]]
        return out

    def _piece(self, piece: str) -> list[float]:
        """For each prefix of one token, but the empty one, the likeliest way through the shapes; another may follow anywhere, at a price."""
        out, best = [], -SWITCH
        states: list[int | None] = [0] * len(self.shapes)
        totals = [0.0] * len(self.shapes)
        for c in piece:
            s, inner = _CLASS.get(c, (c, 0.0))
            again = best + SWITCH
            for k, a in enumerate(self.shapes):
                gain, state = a.step(states[k], s)
                gain += totals[k]
                if gain < again:
                    fresh, start = a.step(0, s)
                    if again + fresh > gain:
                        gain, state = again + fresh, start
                totals[k], states[k] = gain + inner, state
            best = max(totals)
            out.append(best)
        return out

    def likelihood(self, token: str) -> tuple[float, str]:
        """The log likelihood a character under the best format against that under ordinary tokens, and that format.

        Formats that can be the whole token come first; where there is none the
        name is empty.
        """
        if token not in self._seen:
            if len(self._seen) >= CACHE:
                self._seen.clear()
            able = [(a.score(token), name) for name, a in self.formats.items() if a.may_be(token)]
            best = max(able or [(a.score(token), name) for name, a in self.formats.items()])
            self._seen[token] = (best[0] - self.ordinary(token)[-1] / max(1, len(token)), best[1] if able else "")
        return self._seen[token]

    def format_of(self, token: str) -> str | None:
        """The format whose likelihood stands out, or None."""
        gain, name = self.likelihood(token)
        return name if name and gain >= MIN_GAIN else None

    def _starts(self, a: Automaton, run: str) -> list[int]:
        if a.head:
            return [m.start() for m in re.finditer(f"(?={re.escape(a.head)})", run)] if a.head in run else []
        named = lambda i: i and run[i - 1] == "="
        return [i for i in range(len(run) - a.shortest + 1) if (i == 0 or run[i - 1] in STARTS) and (run[i] not in TRIM or named(i) and run[i] != ".")]

    def _stands_alone(self, a: Automaton, run: str, usual: list[float], start: int, end: int) -> bool:
        """Whether a part may be a credential of a format without a head.

        What stands next to it in the format's characters, up to its greatest
        length, must be ordinary: a part of a longer random run is no credential.
        """
        if end - start > a.longest or readable(run[start:end]):
            return False
        left, right = start, end
        while left and start - left < a.longest and _CLASS.get(run[left - 1], (run[left - 1],))[0] in a.alphabet:
            left -= 1
        while right < len(run) and right - end < a.longest and _CLASS.get(run[right], (run[right],))[0] in a.alphabet:
            right += 1
        return all(y - x < REST or a.score(run[x:y]) * (y - x) <= usual[y] - usual[x] for x, y in ((left, start), (end, right)))

    def _inside(self, a: Automaton, run: str, usual: list[float]) -> list[tuple[float, int, int]]:
        """(rank, start, end) of the credentials of one format in a run; the rank is the gain and the odds of its place.

        All starts go forward together.  Starts in equal states gain alike from
        there on, so of those that are long enough only the best goes on.
        ``usual`` has the log likelihoods of the run's prefixes as ordinary tokens.
        """
        starts = self._starts(a, run)
        if not starts or len(run) - starts[0] < a.shortest:
            return []
        out, held, at, i = [], {}, 0, starts[0]
        prior = {i: NAMED if i == 0 or run[i - 1] == "=" else 0.0 for i in starts}
        live: list[list] = []  # start, state, gain, gain at the best end, that end, the end's rank
        while i < len(run) and (live or at < len(starts)):
            if not live:
                i = max(i, starts[at])
            if at < len(starts) and starts[at] == i:
                live.append([i, 0, 0.0, -1.0, 0, -math.inf])
                at += 1
            c, stay, held = run[i], [], {}
            s, inner = _CLASS.get(c, (c, 0.0))
            ends = c != "." and (i + 1 == len(run) or run[i + 1] in ENDS)
            for w in live:
                fixed = i - w[0] < len(a.head)
                plus, state = a.step(w[1], c if fixed else s)
                if state is None:
                    last = i
                    while last > w[0] and run[last - 1] in TRIM:
                        last -= 1
                    # A dead state ends a credential too, unless a letter or digit goes on.
                    if not c.isalnum() and last == i and last - w[0] >= a.shortest and w[2] > w[5]:
                        w[3:] = w[2], last, w[2]
                    out.append(w)
                    continue
                w[1], w[2] = state, w[2] + plus + (0.0 if fixed else inner) - (usual[i + 1] - usual[i]) - MIN_GAIN
                if i + 1 - w[0] >= a.shortest:
                    rank = w[2] + (NAMED if not a.head and i + 1 == len(run) else 0.0)
                    if ends and rank > w[5] and (a.head or i + 1 - w[0] <= a.longest):
                        w[3:] = w[2], i + 1, rank
                    if not a.head and i + 1 - w[0] >= a.longest:  # no end lies further on
                        out.append(w)
                        continue
                    other = held.get(w[1])
                    if a.head and other is not None:
                        if other[2] + prior[other[0]] >= w[2] + prior[w[0]]:
                            out.append(w)
                            continue
                        stay.remove(other)
                        out.append(other)
                    held[w[1]] = w
                stay.append(w)
            live = stay
            i += 1
        return [(w[5] + (0.0 if a.head else prior[w[0]]), w[0], w[4]) for w in out + live if w[3] >= 0 and (a.head or self._stands_alone(a, run, usual, w[0], w[4]))]

    def embedded(self, run: str) -> list[tuple[str, int, int]]:
        """(format, start, end) of credentials inside a run, the one that stands out most first, none overlapping."""
        if len(run) < LEAST:
            return []
        usual = self.ordinary(run)
        found = sorted((-gain, start, -end, name) for name, a in self.formats.items() for gain, start, end in self._inside(a, run, usual))
        taken: list[tuple[int, int, str]] = []
        for _, start, end, name in found:
            at = bisect_left(taken, (start,))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= -end):
                taken.insert(at, (start, -end, name))
        return [(name, start, end) for start, end, name in taken]

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed."""
        return [span[:3] for span in self.scored(text)]

    def scored(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(kind, start, end, log likelihood a character over ordinary tokens) by start, then kind as listed.

        Base spans have it too, of the value alone where a name stands before it.
        """
        if not text:
            return []
        found, values = [], {}
        lower = text.lower()
        if any(k in lower for k in _KEYWORDS):
            for m in _ASSIGN.finditer(text):
                if m.end(1) - m.start(1) >= 8:
                    found.append(("assign", m.start(), m.end()))
                    values[found[-1]] = m.start(1)
        runs = [(m.start(), m.end()) for m in _RUN.finditer(text)]
        for a, b in runs:
            if text.find("AKIA", a, b) >= 0:
                found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= 16]
            if b - a >= 32:
                found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text, a, b)]
        covered: list[list[int]] = []  # what base spans cover, as disjoint intervals
        for _, s, e in sorted(found, key=lambda s: s[1]):
            if covered and s <= covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], e)
            else:
                covered.append([s, e])
        taken, at = [], 0
        for a, b in runs:
            while at < len(covered) and covered[at][1] <= a:
                at += 1
            free, place, i = [], a, at
            while i < len(covered) and covered[i][0] < b:
                free.append((place, covered[i][0]))
                place, i = max(place, covered[i][1]), i + 1
            for start, stop in [*free, (place, b)]:
                end, least = stop, stop
                while end > start and text[end - 1] == ".":
                    end -= 1
                while least > start and text[least - 1] in TRIM:
                    least -= 1
                if least - start < LEAST:
                    continue
                # A last - or _ may belong to a credential or to the sentence: with it first.
                parts = self._parts(text[start:end], self.format_of(text[start:end]))
                if not parts and least < end:
                    parts = self._parts(text[start:least], self.format_of(text[start:least]))
                taken += [(k, start + x, start + y) for k, x, y in parts]
        every = [(*span, self.likelihood(text[values.get(span, span[1]) : span[2]])[0]) for span in found + taken]
        return sorted(every, key=lambda s: (s[1], self.order[s[0]]))

    def _parts(self, token: str, kind: str | None) -> list[tuple[str, int, int]]:
        """The token as one credential of the kind, which spells it, or what is embedded in it."""
        whole = [(kind, 0, len(token))] if kind else []
        if kind and self.formats[kind].head:
            return whole
        inside = self.embedded(token)
        # No head: a credential with one inside counts more.
        return ([x for x in inside if self.formats[x[0]].head] if whole else inside) or whole


@lru_cache(maxsize=2)
def default_grammars() -> Grammars:
    return Grammars(labelled_credentials(), ordinary_shapes())


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def secret_spans(docs: DataFrame, labelled: list[tuple[str, str]] | None = None, ordinary: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id and the spans found in the whole text, each with its log likelihood a character over ordinary tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Grammars(labelled or labelled_credentials(), ordinary or ordinary_shapes()) if labelled or ordinary else default_grammars()
        for batch in batches:
            out = [[{"kind": k, "start": a, "end": b, "score": x} for k, a, b, x in held.scored(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPAN)], names=["doc_id", "spans"])

    return documents(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_digest(docs: DataFrame) -> DataFrame:
    """The rows of the contract, and the likelihoods of the spans in their order, to three places."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = default_grammars()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                scored = held.scored(text)
                spans = [s[:3] for s in scored]
                base = [s for s in spans if s[0] in BASE]
                rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), ",".join(f"{s[3]:.3f}" for s in scored)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return documents(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores string")
