"""Secret scans (operator 8): fixed patterns plus probabilistic automata inferred from labelled credentials.

Grammar inference: the labelled credentials of a kind form a prefix tree with counts. Going through the
tree in breadth-first order, a state is merged (with all that lies below it) into an earlier state when
the two are statistically compatible: their symbol and end frequencies differ by less than a Hoeffding
bound, recursively. What is left is a probabilistic automaton, whose loops make strings of other lengths
too; a smoothed law of lengths stands for its end probabilities. Where a kind has very many credentials, executors
count their frequent prefixes, whose tree is merged, and then all credentials' ways through the automaton. Labelled are the fixed patterns' matches in
the corpus and examples of published credential formats.

Candidates are all runs of credentials' characters and all stretches between their separators, of any
length. A candidate's evidence is the logarithm of its likelihood under the best automaton over that under
ordinary text, a bigram model of the runs that no fixed pattern matches; it is a secret where that is enough.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import common

#: Kinds of the fixed patterns, in the order in which spans of one start are listed; then the method's kind.
KINDS = ("assign", "access", "hex")
FORMAT = "format"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Where a credential may start or end inside a run.
_PIECE = re.compile(r"[^=/.]+")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

_UPPER, _LOWER, _DIGITS = _ALPHABET[:26], _ALPHABET[26:52], _ALPHABET[52:62]
_ALNUM, _URLSAFE = _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "_-"
#: Published credential formats: a name, then literals and (symbols, how many of them, from and to). Fixed values.
FORMATS = (
    ("github", "ghp_", (_ALNUM, 36, 36)),
    ("github", "gho_", (_ALNUM, 36, 36)),
    ("github", "ghs_", (_ALNUM, 36, 36)),
    ("gitlab", "glpat-", (_URLSAFE, 20, 20)),
    ("slack", "xoxb-", (_DIGITS, 10, 13), "-", (_DIGITS, 10, 13), "-", (_ALNUM, 24, 24)),
    ("slack", "xoxp-", (_DIGITS, 10, 13), "-", (_DIGITS, 10, 13), "-", (_DIGITS, 10, 13), "-", (_LOWER[:6] + _DIGITS, 32, 32)),
    ("stripe", "sk_live_", (_ALNUM, 24, 24)),
    ("stripe", "rk_live_", (_ALNUM, 24, 24)),
    ("google", "AIza", (_URLSAFE, 35, 35)),
    ("npm", "npm_", (_ALNUM, 36, 36)),
    ("sendgrid", "SG.", (_URLSAFE, 22, 22), ".", (_URLSAFE, 43, 43)),
    ("web token", "eyJ", (_ALNUM, 17, 40), ".eyJ", (_URLSAFE, 40, 120), ".", (_URLSAFE, 43, 43)),
    ("temporary access", "ASIA", (_UPPER + _DIGITS, 16, 16)),
    ("upper hex", (_DIGITS + _UPPER[:6], 32, 64)),
    ("opaque token", (_ALNUM, 32, 64)),
)


def format_examples(formats=FORMATS, each: int = 100, seed: int = 8) -> list[tuple[str, str]]:
    """(name, example): each made-up credentials of each format, the same in every run."""
    made = random.Random(seed)
    part = lambda p: p if isinstance(p, str) else "".join(made.choices(p[0], k=made.randint(p[1], p[2])))
    return [(name, "".join(map(part, parts))) for name, *parts in formats for _ in range(each)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns' matches, leftmost and non-overlapping per kind."""
    found = []
    lower = text.lower()  # only to see that none of the words occurs
    if any(word in lower for word in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def labelled_values(text: str) -> list[tuple[str, str]]:
    """(kind, credential) for each fixed-pattern match: what the automata learn from."""
    found = []
    for start, kind, end in base_spans(text):
        value = _ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
        found.append((KINDS[kind], value))
    return found


class Automaton:
    """A probabilistic automaton merged from the prefix tree of counted strings.

    alpha: confidence of the Hoeffding test; a smaller one merges more. States: list of
    {symbol: next state}, with counts per transition, of ends, and of arrivals.
    """

    def __init__(self, strings: dict[str, int], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.total = [0], [0]
        self.lengths = self._law_of_lengths(Counter(map(len, strings)))
        self._steps: dict[tuple[int, str], tuple[int, float]] = {}
        for string, n in sorted(strings.items()):
            state = 0
            self.total[0] += n
            for symbol in string:
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({}), self.count.append({}), self.ends.append(0), self.total.append(0)
                self.count[state][symbol] = self.count[state].get(symbol, 0) + n
                state = self.next[state][symbol]
                self.total[state] += n
            self.ends[state] += n
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    @classmethod
    def of_prefixes(cls, tree: dict[str, dict[str, int]], sizes: dict[int, int], alpha: float = 0.05) -> Automaton:
        """The automaton of a tree cut to its frequent prefixes: prefix to how many strings go on with each symbol, or end ("").

        What follows a rare prefix is unknown here, so that it loops; tally() and recount() then give every string's share.
        """
        made = cls({}, alpha)
        made.lengths = made._law_of_lengths(sizes)
        place = {"": 0}
        for prefix in sorted(tree, key=lambda p: (len(p), p)):
            state = place[prefix]
            made.total[state], made.ends[state] = sum(tree[prefix].values()), tree[prefix].get("", 0)
            for symbol, n in sorted(tree[prefix].items()):
                if symbol:
                    place[prefix + symbol] = made.next[state][symbol] = len(made.next)
                    made.count[state][symbol] = n
                    made.next.append({}), made.count.append({}), made.ends.append(0), made.total.append(0)
        made._merge_all()
        return made

    def tally(self, string: str, seen: Counter) -> None:
        """Count the string's (state, symbol) and, as "", where it ends. A symbol that a state doesn't know stays there."""
        state = 0
        for symbol in string:
            seen[state, symbol] += 1
            state = self.next[state].get(symbol, state)
        seen[state, ""] += 1

    def recount(self, seen: dict[tuple[int, str], int]) -> None:
        """Take the counts of tally() for those of the tree."""
        self.count = [{} for _ in self.states]
        self.ends, self.total = ([0] * len(self.states) for _ in range(2))
        for (state, symbol), n in sorted(seen.items()):
            self.total[state] += n
            if symbol:
                self.count[state][symbol] = n
                self.next[state].setdefault(symbol, state)
            else:
                self.ends[state] = n
        self._steps = {}

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 and n2 and abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ends[a], self.total[a], self.ends[b], self.total[b]):
                return False
            for symbol in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(symbol, 0), self.total[a], self.count[b].get(symbol, 0), self.total[b]):
                    return False
                if symbol in self.next[a] and symbol in self.next[b]:
                    todo.append((self.next[a][symbol], self.next[b][symbol]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the states from a on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for symbol, n in self.count[b].items():
                self.count[a][symbol] = self.count[a].get(symbol, 0) + n
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], self.next[b][symbol]))
                else:
                    self.next[a][symbol] = self.next[b][symbol]

    def _merge_all(self) -> None:
        """Breadth first; a state that is compatible with its parent becomes a loop, else the latest compatible state takes it in."""
        settled, final = [0], {0}
        edge = deque((0, symbol) for symbol in sorted(self.next[0]))
        queued = set(edge)
        while edge:
            parent, symbol = edge.popleft()
            state = self.next[parent][symbol]
            if state in final:
                continue
            taker = next((s for s in (parent, *reversed(settled)) if self._compatible(s, state)), None)
            if taker is None:
                settled.append(state)
                final.add(state)
                new = [state]
            else:
                self.next[parent][symbol] = taker
                self._fold(taker, state)
                new = settled  # folding may have hung states of the tree under any of them
            for s in new:
                for x in sorted(self.next[s]):
                    if self.next[s][x] not in final and (s, x) not in queued:
                        queued.add((s, x))
                        edge.append((s, x))
            queued.discard((parent, symbol))
        # what the tree had besides is gone
        place = {s: i for i, s in enumerate(settled)}
        self.next = [{x: place[t] for x, t in self.next[s].items()} for s in settled]
        self.count, self.ends, self.total = ([of[s] for s in settled] for of in (self.count, self.ends, self.total))
        self.states = list(range(len(settled)))

    def _law_of_lengths(self, sizes: dict[int, int]) -> list[float]:
        """Bits of each length up to four times the longest: each seen length spreads in a bell over about an eighth of it."""
        top = 4 * max(sizes, default=0)
        mass = np.full(top + 1, 1e-6)
        for size, n in sorted(sizes.items()):
            spread = max(1.0, size / 8)
            low, high = max(0, int(size - 9 * spread)), min(top, int(size + 9 * spread))  # beyond it is far below 1e-6
            bell = np.exp(-0.5 * ((np.arange(low, high + 1) - size) / spread) ** 2)
            mass[low : high + 1] += n * bell / bell.sum()
        return (-np.log2(mass / mass.sum())).tolist()

    def step(self, state: int, symbol: str) -> tuple[int, float]:
        """Next state and the symbol's bits, given that the string goes on. Infinite where the automaton can't make it.

        A symbol that a state hasn't seen counts as seen once where the state has seen at least five others
        of its class (digit, small or capital letter), and leads where most of these lead.
        """
        known = self._steps.get((state, symbol))
        if known is None:
            goes_on = self.total[state] - self.ends[state]
            n = self.count[state].get(symbol)
            if n:
                known = self.next[state][symbol], -math.log2(n / goes_on)
            else:
                like = [x for x in self.count[state] if (x.isdigit(), x.islower(), x.isupper()) == (symbol.isdigit(), symbol.islower(), symbol.isupper())]
                if len(like) < 5 or not symbol.isalnum():
                    known = state, math.inf
                else:
                    leads = Counter()
                    for x in like:
                        leads[self.next[state][x]] += self.count[state][x]
                    known = min(leads, key=lambda t: (-leads[t], t)), math.log2(goes_on + 1)
            self._steps[state, symbol] = known
        return known

    def bits(self, string: str) -> float:
        """-log2 of the string's likelihood: its length's and, given that, its symbols'; infinite where it can't be made."""
        if len(string) >= len(self.lengths):
            return math.inf
        state, cost = 0, self.lengths[len(string)]
        for symbol in string:
            state, more = self.step(state, symbol)
            cost += more
        return cost


#: Chances that a symbol of a class follows one of another in names, paths, slugs and numbers of any kind: lower, upper, digit, separator, end.
#: Prose alone would make capitals and separators so unlikely that any constant or slug looked like a secret. Fixed values.
_FOLLOWS = {
    "end": (0.55, 0.25, 0.15, 0.05, 0.00),
    "lower": (0.76, 0.05, 0.04, 0.10, 0.05),
    "upper": (0.20, 0.62, 0.04, 0.09, 0.05),
    "digit": (0.08, 0.05, 0.64, 0.18, 0.05),
    "separator": (0.40, 0.15, 0.20, 0.22, 0.03),
}
#: Of a symbol within its class: chances that it repeats the last one, follows it in the alphabet, is any; the rest goes by the corpus.
_REPEATS, _NEXT, _ANY = 0.15, 0.08, 0.12


def _class(symbol: str) -> str:
    return "lower" if symbol.islower() else "upper" if symbol.isupper() else "digit" if symbol.isdigit() else "end" if symbol == " " else "separator"


class Ordinary:
    """Bits of symbols in ordinary text after the last one. A space opens and closes a run.

    A symbol's class follows the last one's half by the corpus and half by _FOLLOWS. Within its class a symbol repeats the
    last one, is the next of the alphabet, is any, or goes by the corpus' pairs of letters, whatever their case; separators are alike.
    """

    def __init__(self, pairs: dict[str, int]):
        symbols = _ALPHABET + " "
        members = {c: [s for s in symbols if _class(s) == c] for c in _FOLLOWS}
        classes = {c: Counter() for c in _FOLLOWS}
        folded: dict[str, Counter] = {}
        for (a, b), n in pairs.items():
            classes[_class(a)][_class(b)] += n
            folded.setdefault(a.lower(), Counter())[b.lower()] += n
        single = Counter()
        for seen in folded.values():
            single.update(seen)
        self.table: dict[str, dict[str, float]] = {}
        for a in symbols:
            last, row = _class(a), {}
            total = sum(classes[last].values())
            seen = folded.get(a.lower(), Counter())
            for c, given in zip(("lower", "upper", "digit", "separator", "end"), _FOLLOWS[last], strict=True):
                follows = 0.5 * classes[last][c] / total + 0.5 * given if total else given
                own = members[c]
                weight = {b: 1.0 if c == "separator" else seen[b.lower()] + 8.0 * (single[b.lower()] + 0.5) / (sum(single.values()) + 1) for b in own}
                all_ = sum(weight.values())
                for b in own:
                    rest = 1.0 - _ANY
                    p = _ANY / len(own)
                    if len(own) > 1:
                        same = [x for x in own if x.lower() == a.lower()]
                        nearby = [x for x in own if c != "separator" and ord(x.lower()) == ord(a.lower()) + 1]
                        p += _REPEATS * (b in same) + _NEXT * (b in nearby)
                        rest -= _REPEATS * bool(same) + _NEXT * bool(nearby)
                    p += rest * weight[b] / all_
                    row[b] = -math.log2(max(follows * p, 1e-9))
            self.table[a] = row


class Scanner:
    """Automata by kind and the model of ordinary runs. Small: driver to executors by closure.

    evidence: bits by which a secret's likelihood must lead ordinary text's; a credential's random symbol gives about two.
    Random identifiers of a public shape (UUIDs) are none, whatever they cost. drop: a stretch of a candidate
    that loses so many bits ends the search from its start, as no credential has one.
    """

    def __init__(self, labelled: dict[str, dict[str, int] | Automaton], ordinary: dict[str, int], evidence: float = 30.0, drop: float = 40.0):
        told = (sorted((k, repr((x.next, x.count, x.ends, x.lengths) if isinstance(x, Automaton) else sorted(x.items()))) for k, x in labelled.items()), sorted(ordinary.items()), evidence, drop)
        self.name = hashlib.sha256(repr(told).encode()).hexdigest()
        self.automata = {kind: x if isinstance(x, Automaton) else Automaton(x) for kind, x in sorted(labelled.items()) if x}
        self.ordinary = Ordinary(ordinary)
        self.evidence, self.drop = evidence, drop
        self._bound()

    def _bound(self) -> None:
        """What tells at a glance that a run has no candidate with enough evidence.

        gains: for each (last, symbol) the most bits that the symbol can add to the lead of an automaton that starts with many symbols, in whatever
        state. begins: the first two symbols that the other automata, those of a literal, can start with.
        """
        table = self.ordinary.table
        least = dict.fromkeys(_ALPHABET, math.inf)
        self.begins: set[str] = set()
        for a in self.automata.values():
            first = [x for x in _ALPHABET if a.step(0, x)[1] < math.inf]
            if len(first) > 8:
                for x in _ALPHABET:
                    least[x] = min(least[x], *(a.step(state, x)[1] for state in a.states))
            else:
                self.begins.update(x + y for x in first for y in _ALPHABET if a.step(a.step(0, x)[0], y)[1] < math.inf)
        self.gains = {last: {x: row[x] - least[x] for x in _ALPHABET} for last, row in table.items()}

    def leads(self, run: str, start: int, ends: list[int]) -> list[float]:
        """For each end, the most bits by which some automaton leads ordinary text on run[start:end].

        The text around the run is ordinary for both. An automaton is given up where its lead, without the
        law of lengths, is drop below its best so far.
        """
        table, before = self.ordinary.table, run[start - 1] if start else " "
        found = [-math.inf] * len(ends)
        for a in self.automata.values():
            state, lead, best, last, at = 0, 0.0, 0.0, before, start
            for i, end in enumerate(ends):
                while at < end:
                    state, bits = a.step(state, run[at])
                    lead += table[last][run[at]] - bits
                    last = run[at]
                    at += 1
                    best = max(best, lead)
                    if lead < best - self.drop:
                        break
                else:
                    if end - start < len(a.lengths):
                        found[i] = max(found[i], lead - a.lengths[end - start])
                        continue
                break
        return found

    def is_format(self, candidate: str) -> bool:
        return bool(candidate) and self.leads(candidate, 0, [len(candidate)])[0] >= self.evidence

    def _formats(self, run: str) -> Sequence[tuple[int, int]]:
        """Where a maximal run of credentials' characters has credentials, without overlaps, from left to right.

        Candidates start where the run or a piece between '=', '/' and '.' does, and end where one ends, as it is
        or without '-' at its end; of those of a start the one with the most evidence is taken, of equals
        the longest. A run of which no stretch can gain the evidence, and that starts no literal, has none.
        """
        gains, last, now, best = self.gains, " ", 0.0, 0.0
        for symbol in run:
            now += gains[last][symbol]
            if now < 0.0:
                now = 0.0
            elif now > best:
                best = now
            last = symbol
        if best < self.evidence and run[:2] not in self.begins and not any(run[m.start() : m.start() + 2] in self.begins for m in _PIECE.finditer(run)):
            return _NOTHING
        pieces = [m.span() for m in _PIECE.finditer(run)]
        starts = sorted({0, *(s for s, _ in pieces)})
        stops = sorted({len(run), *(e for _, e in pieces), *(s + len(run[s:e].rstrip("-")) for s, e in pieces)})
        longest = max((len(a.lengths) for a in self.automata.values()), default=0)
        found, done = [], 0
        for start in starts:
            if start < done:
                continue
            ends = stops[bisect_right(stops, start) : bisect_right(stops, start + longest)]
            leads = self.leads(run, start, ends)
            top = max(leads, default=-math.inf)
            if top >= self.evidence:
                done = max(e for e, x in zip(ends, leads, strict=True) if x == top)
                if not _UUID.fullmatch(run, start, done):
                    found.append((start, done))
        return found or _NOTHING

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """Base spans and, apart from them, the method's, by start. Linear in the text for a given model."""
        base = base_spans(text)
        if not self.automata:
            return base
        more, i, known = [], 0, _memo(self)
        by_end = _joined(base)
        for m in _RUN.finditer(text):
            spans = known[m[0]]
            if spans:
                for s, e in spans:
                    start, end = m.start() + s, m.start() + e
                    while i < len(by_end) and by_end[i][1] <= start:
                        i += 1
                    if i == len(by_end) or by_end[i][0] >= end:
                        more.append((start, len(KINDS), end))
        return sorted(base + more) if more else base


#: What most runs have; and, in a worker, the runs that the last scanner looked at.
_NOTHING: tuple = ()
_runs: dict[str, common.TwoGenerations] = {}


def _memo(scanner: Scanner) -> common.TwoGenerations:
    """Runs and where they have credentials: at most 2 x 150,000 of up to 64 characters, kept from task to task of one model."""
    common.sole_memo("secrets", _runs.clear)
    if scanner.name not in _runs:
        _runs.clear()
        _runs[scanner.name] = common.TwoGenerations(scanner._formats, 150_000, 64)
    return _runs[scanner.name]


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The union of sorted spans as disjoint (start, end)."""
    out: list[tuple[int, int]] = []
    for start, _, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def pairs_of(text: str) -> Counter:
    """The (last, symbol) pairs of a text's runs that no fixed pattern touches: what ordinary text is known by."""
    pairs, i = Counter(), 0
    taken = _joined(base_spans(text))
    for m in _RUN.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or taken[i][0] >= m.end():
            run = f" {m[0]} "
            pairs.update(map("".join, zip(run, run[1:])))
    return pairs


_SYMBOLS = " " + _ALPHABET
_CODES = np.zeros(256, np.uint8)
_CODES[[ord(s) for s in _ALPHABET]] = range(1, len(_SYMBOLS))


def pair_counts(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """pairs_of() of many texts with these base spans, as one array of counts by (last, symbol)."""
    width = len(_SYMBOLS)
    counts = np.zeros(width * width, np.int64)
    codes = _CODES[np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("ascii", "replace"), np.uint8)]  # a byte for each code point
    at = 1
    for t, found in zip(texts, spans, strict=True):
        for start, _, end in found:  # all of each run that a span touches
            start, end = at + start, at + end
            while codes[start] and codes[start - 1]:
                start -= 1
            while codes[end - 1] and codes[end]:
                end += 1
            codes[start:end] = 0
        at += len(t) + 1
    for i in range(0, len(codes) - 1, 1 << 20):
        part = codes[i : i + (1 << 20) + 1].astype(np.int64)
        counts += np.bincount(part[:-1] * width + part[1:], minlength=width * width)
    counts[0] = 0
    return counts


#: A kind with more different credentials than WHOLE is learned by the prefixes that at least one in SHARE of them has, up to DEPTH symbols, STEP at a time.
WHOLE, SHARE, DEPTH, STEP = 600, 300, 256, 8


def _prefixes(values: DataFrame, least: int) -> dict[str, dict[str, int]]:
    """For each prefix of at least so many values, how many go on with each symbol, or end (""). At most SHARE prefixes of a length."""
    tree, alive = {}, values
    for depth in range(0, DEPTH, STEP):
        at = F.explode(F.sequence(F.lit(depth), F.least(F.lit(depth + STEP - 1), F.length("value"))))
        rows = alive.select("value", at.alias("at")).groupBy(F.expr("substring(value, 1, at)").alias("prefix"), F.expr("substring(value, at + 1, 1)").alias("symbol")).agg(F.count("*").alias("n"))
        found = rows.groupBy("prefix").agg(F.collect_list(F.struct("symbol", "n")).alias("x"), F.sum("n").alias("n")).where(F.col("n") >= least).collect()
        tree.update({r["prefix"]: {x["symbol"]: x["n"] for x in r["x"]} for r in found})
        deep = [r["prefix"] + x["symbol"] for r in found if len(r["prefix"]) == depth + STEP - 1 for x in r["x"] if x["symbol"] and x["n"] >= least]
        if not deep:
            break
        alive = alive.where(F.substring("value", 1, depth + STEP).isin(deep))
    return tree


def _learned(values: DataFrame, sizes: dict[int, int]) -> Automaton:
    """The automaton of any number of different values (value): its shape from their frequent prefixes, its counts from all."""
    made = Automaton.of_prefixes(_prefixes(values, -(-sum(sizes.values()) // SHARE)), sizes)

    def count(batches):
        seen = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                made.tally(value, seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["state", "symbol", "n"])

    made.recount({(r["state"], r["symbol"]): r["n"] for r in values.mapInArrow(count, "state long, symbol string, n long").groupBy("state", "symbol").agg(F.sum("n").alias("n")).collect()})
    return made


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int | None = None, max_labelled: int | None = None, labelled: list[tuple[str, str]] | None = None) -> Scanner:
    """Learn the automata and the model of ordinary text from all documents and all different credentials in them, each counted once.

    labelled: (kind, credential) examples of one's own beside the corpus' matches of the fixed patterns; by default those of FORMATS.
    For trials only: sample_docs, about so many documents picked by a hash of id and text; max_labelled, so many credentials of each kind, the first by hash.
    """
    known = docs.select(F.col(text).alias("text")).where(F.col(text).isNotNull())
    if sample_docs is not None:
        draw = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 30))
        known = docs.select(F.col(text).alias("text")).where(F.col(text).isNotNull() & (draw * F.lit(float(docs.count())) < F.lit(float(sample_docs << 30))))

    def rows(kinds, values, counts):
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(counts, pa.int64())], names=["kind", "value", "n"])

    def learn(batches):
        pairs = np.zeros(len(_SYMBOLS) ** 2, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = common.texts_of(part, "text")
                spans = [base_spans(t) for t in texts]
                pairs += pair_counts(texts, spans)
                values = list(dict.fromkeys(x for t, found in zip(texts, spans, strict=True) if found for x in labelled_values(t)))
                if values:
                    yield rows([k for k, _ in values], [v for _, v in values], [1] * len(values))
        at = np.flatnonzero(pairs)
        yield rows([None] * len(at), [_SYMBOLS[i // len(_SYMBOLS)] + _SYMBOLS[i % len(_SYMBOLS)] for i in at], pairs[at])

    seen = common.materialize(known.mapInArrow(learn, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "labelled")
    pairs = {r["value"]: r["n"] for r in seen.where("kind is null").collect()}  # of a fixed alphabet
    values = seen.where("kind is not null").select("kind", "value")
    if max_labelled is not None:
        first = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
        values = values.withColumn("at", F.row_number().over(first)).where(F.col("at") <= max_labelled).drop("at")
    own = format_examples() if labelled is None else labelled
    added = [x for x in dict.fromkeys(own) if x[0] in KINDS]
    if added:
        values = values.unionByName(docs.sparkSession.createDataFrame(added, "kind string, value string")).distinct()
    found: dict[str, dict[str, int] | Automaton] = {kind: {} for kind in KINDS}
    sizes: dict[str, dict[int, int]] = {kind: {} for kind in KINDS}
    for r in values.groupBy("kind", F.length("value").alias("size")).agg(F.count("*").alias("n")).collect():
        sizes[r["kind"]][r["size"]] = r["n"]
    few = [kind for kind in KINDS if sum(sizes[kind].values()) <= WHOLE]
    for r in values.where(F.col("kind").isin(few)).collect() if few else []:
        found[r["kind"]][r["value"]] = 1
    for kind in KINDS:
        if kind not in few:
            found[kind] = _learned(values.where(F.col("kind") == kind).select("value"), sizes[kind])
    common.discard(seen)
    for kind, value in own:
        if kind not in KINDS:
            found.setdefault(kind, {})[value] = 1
    return Scanner(found, pairs)


SPANS = T.StructField("secret_spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False), False)


def scan(docs: DataFrame, scanner: Scanner, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with secret_spans: kind, start and end (code points, end exclusive), by start and then kind.

    Kinds: assign, access and hex from the fixed patterns; format for the method's own. Narrow. Null text
    counts as empty: no spans. Repeated rows stay; a column of that name is replaced.
    """
    names = [*KINDS, FORMAT]

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        spans = [scanner.scan(t) if t else [] for t in common.texts_of(part, text)]
        flat = [s for x in spans for s in x]
        ends = [0]
        for x in spans:
            ends.append(ends[-1] + len(x))
        parts = pa.StructArray.from_arrays([pa.array([names[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())], fields=[pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)]

    return common.add_columns(docs, [SPANS], compute, text, keep)


def redact(docs: DataFrame, scanner: Scanner, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret of its texts replaced by mark; of overlapping spans the union goes."""

    def clean(t: str) -> str:
        out, done = [], 0
        for start, _, end in scanner.scan(t):
            if start >= done:
                out += [t[done:start], mark]
            done = max(done, end)
        return "".join([*out, t[done:]]) if out else t

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([None if t is None else clean(t) for t in common.texts_of(part, text)], pa.string())]

    names = docs.columns
    return common.add_columns(docs, [T.StructField(text, T.StringType(), True)], compute, text).select(*names)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of documents: counts, a digest of the base spans, all spans.

    Null and empty texts have none, and the digest of no spans; repeated rows each have their row.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs), keep=["doc_id"])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(kind).alias(f"n_{kind}") for kind in KINDS], F.sha2(shown(F.filter("secret_spans", lambda s: s["kind"] != FORMAT)).cast("binary"), 256).alias("base_sha256"), shown(F.col("secret_spans")).alias("spans"))
