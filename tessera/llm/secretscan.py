"""Secret scans: all rules in one deterministic automaton, run over the bytes of many texts at once.

Each rule's regex is read into a nondeterministic automaton; the reversed rules together, behind any prefix, are made
deterministic by subset construction over classes of bytes and minimised. Its transitions are one array. Run over a text
from its end, it tells at every byte which rules match from there on: one pass finds the starts of all rules. A match's end
is the longest that the rule's own forward automaton, made alike, reaches from a start; the next start counts behind it.

The texts of a task's slice are one row of bytes, parted by 0xFF, which no text holds. It is cut into lanes that advance
together; every lane but the first begins in the initial state, and where the lane before ended in another one, its bytes
are run again until both agree. The result is that of one run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, texts_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `head`, where there is one, then `value`. A match whose value has fewer than `least` characters is
    dropped after it was taken: what stands in it is no match any more. No value may begin as its head ends."""

    kind: str
    value: str
    least: int = 0
    head: str = ""


# The base rules of the contract. {32,} is the bound of the third itself: it takes maximal runs.
BASE = (
    Rule("assign", "[A-Za-z0-9+/_.=-]+", 8, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32,}"),
)
#: Published shapes of keys and tokens of well-known services, and of keys in files.
RULES = BASE + (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 60),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("slack", "xox[abeprs]-[A-Za-z0-9-]+", 20),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", 32),
)
_END = 0xFF
#: Bytes that are run at once, and the least length of a lane.
_PIECE, _LEAST_LANE, _LANES = 1 << 20, 256, 4096


class _Reader:
    """A rule's regex as a tree: ("set", bytes), ("cat", ...), ("or", ...), ("rep", least, most or None, x).

    It knows characters, classes, escapes (\\xhh and \\ before a mark), groups, (?i: ), | and ? * + {m,} {m}; ASCII only.
    """

    def __init__(self, pattern: str) -> None:
        self.text, self.at, self.either = pattern, 0, False

    def tree(self):
        found = self.choice()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} in {self.text!r}")
        return found

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        if self.at > len(self.text):
            raise ValueError(f"unexpected end of {self.text!r}")
        return self.text[self.at - 1]

    def choice(self):
        ways = [self.sequence()]
        while self.peek() == "|":
            self.take()
            ways.append(self.sequence())
        return ("or", *ways) if len(ways) > 1 else ways[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.single()))
        return ("cat", *parts)

    def repeated(self, x):
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                x = ("rep", int(low), int(high) if high else None if comma else int(low), x)
            else:
                x = ("rep", int(sign == "+"), 1 if sign == "?" else None, x)
        return x

    def single(self):
        c = self.take()
        if c == "(":
            before = self.either
            if self.text.startswith("?", self.at):
                head = self.text[self.at : self.text.index(":", self.at) + 1]
                if head not in ("?:", "?i:"):
                    raise ValueError(f"unknown group {head!r}")
                self.at += len(head)
                self.either = before or head == "?i:"
            found = self.choice()
            if self.take() != ")":
                raise ValueError(f"open group in {self.text!r}")
            self.either = before
            return found
        if c == "[":
            return ("set", self.cased(self.members()))
        return ("set", self.cased(frozenset([self.code(c)])))

    def code(self, c: str) -> int:
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        elif not c.isascii() or c in ".^$":
            raise ValueError(f"{c!r} in {self.text!r}")
        return ord(c)

    def members(self) -> frozenset[int]:
        found: set[int] = set()
        while (c := self.take()) != "]":
            low = self.code(c) if c != "." else ord(c)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                found.update(range(low, self.code(self.take()) + 1))
            else:
                found.add(low)
        return frozenset(found)

    def cased(self, codes: frozenset[int]) -> frozenset[int]:
        if not self.either:
            return codes
        return codes | {c ^ 32 for c in codes if 65 <= c & ~32 <= 90}


def turned(tree):
    """The tree of the reversed texts."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return (*tree[:3], turned(tree[3]))
    parts = [turned(x) for x in tree[1:]]
    return (tree[0], *(reversed(parts) if tree[0] == "cat" else parts))


class _Nfa:
    """States with free moves and moves by a set of bytes; accepts: state -> rule."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Joins tree behind start and returns its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start] = (tree[1], end)
            # a state has one move: whatever else begins here does so behind a free move
            return end
        if kind == "cat":
            for x in tree[1:]:
                start = self.add(x, self.behind(start))
            return start
        if kind == "or":
            ends = [self.add(x, self.behind(start)) for x in tree[1:]]
            end = self.state()
            for e in ends:
                self.free[e].append(end)
            return end
        _, least, most, x = tree
        for _ in range(least):
            start = self.add(x, self.behind(start))
        if most is None:
            head = self.behind(start)
            self.free[self.add(x, self.behind(head))].append(head)
            return self.behind(head)
        end = self.state()
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(x, self.behind(start))
        self.free[start].append(end)
        return end

    def behind(self, state: int) -> int:
        new = self.state()
        self.free[state].append(new)
        return new

    def closed(self, states) -> frozenset[int]:
        found, waiting = set(states), list(states)
        while waiting:
            for s in self.free[waiting.pop()]:
                if s not in found:
                    found.add(s)
                    waiting.append(s)
        return frozenset(found)


@dataclass
class Dfa:
    """step[state * width + class of byte] is the next state times width; accepts[state] has a bit for each rule that matches;
    state 0 is the first; dead is a state that nothing leaves and that accepts nothing, or -1."""

    classes: bytes
    width: int
    step: np.ndarray
    accepts: np.ndarray
    dead: int


def _classes(nfa: _Nfa) -> tuple[bytes, list[int]]:
    """Bytes that no move tells apart share a class: the class of each byte, and a byte of each class."""
    sets = {m[0] for m in nfa.moves if m}
    known: dict[tuple, int] = {}
    table = bytes(known.setdefault(tuple(b in s for s in sets), len(known)) for b in range(256))
    return table, [table.index(c) for c in range(len(known))]


def _minimised(step: list[list[int]], accepts: list[int]) -> tuple[list[list[int]], list[int]]:
    """States that accept alike and move alike are one: blocks are parted until none changes. The first stays the first."""
    moves, block = np.array(step), np.unique(accepts, return_inverse=True)[1]
    while True:
        parted = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].reshape(-1)
        if parted.max() == block.max():
            break
        block = parted
    order, first = np.unique(block, return_index=True)
    order = order[np.argsort(first)]
    name = np.empty(len(order), int)
    name[order] = np.arange(len(order))
    first = np.sort(first)
    return [[int(name[block[t]]) for t in step[i]] for i in first], [accepts[i] for i in first]


def compiled(trees: list, anywhere: bool) -> Dfa:
    """One minimal deterministic automaton for all trees; anywhere: a match may begin at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    for rule, tree in enumerate(trees):
        nfa.accepts[nfa.add(tree, nfa.behind(start))] = rule
    table, examples = _classes(nfa)
    first = nfa.closed([start])
    names, waiting, step = {first: 0}, [first], []
    for states in waiting:  # grows meanwhile
        row = []
        for byte in examples:
            reached = [m[1] for s in states if (m := nfa.moves[s]) and byte in m[0]]
            new = nfa.closed(reached + [start] * anywhere)
            if new not in names:
                names[new] = len(names)
                waiting.append(new)
            row.append(names[new])
        step.append(row)
    accepts = [sum({1 << nfa.accepts[s] for s in states if s in nfa.accepts}) for states in waiting]
    step, accepts = _minimised(step, accepts)
    dead = next((i for i, row in enumerate(step) if not accepts[i] and set(row) == {i}), -1)
    width = len(examples)
    return Dfa(table, width, np.array(step, np.int32).ravel() * width, np.array(accepts, np.int64), dead * width)


class Forward:
    """A regex's longest match from a place of a text."""

    def __init__(self, tree) -> None:
        dfa = compiled([tree], anywhere=False)
        self.classes, self.step, self.dead = dfa.classes, dfa.step.tolist(), dfa.dead
        self.accepts = {int(s) * dfa.width for s in np.flatnonzero(dfa.accepts)}

    def end(self, text: bytes, start: int) -> int:
        state, end = 0, start
        for i in range(start, len(text)):
            state = self.step[state + self.classes[text[i]]]
            if state == self.dead:
                break
            if state in self.accepts:
                end = i + 1
        return end


@lru_cache(8)
def automata(rules: tuple[Rule, ...]) -> tuple[Dfa, list[tuple[Forward, Forward | None]]]:
    """The automaton of all reversed rules; of each rule, the forward ones of all of it and of its head."""
    trees = [_Reader(r.head + r.value).tree() for r in rules]
    forward = [(Forward(t), Forward(_Reader(r.head).tree()) if r.head else None) for r, t in zip(rules, trees)]
    return compiled([turned(t) for t in trees], anywhere=True), forward


def states_of(dfa: Dfa, raw: np.ndarray, first: int = 0) -> np.ndarray:
    """The state (times the width) after each byte of raw, from state `first` on."""
    n = len(raw)
    size = max(_LEAST_LANE, -(-n // _LANES))
    lanes = -(-n // size)
    codes = np.frombuffer(raw.tobytes().translate(dfa.classes), np.uint8)
    padded = np.zeros(lanes * size, np.uint8)
    padded[:n] = codes
    columns = np.ascontiguousarray(padded.reshape(lanes, size).T)
    out, now = np.empty((size, lanes), np.int32), np.zeros(lanes, np.int32)
    now[0] = first
    for t in range(size):
        now = dfa.step[now + columns[t]]
        out[t] = now
    flat = np.ascontiguousarray(out.T).reshape(-1)
    for lane in range(1, lanes):
        state = int(flat[lane * size - 1])
        for i in range(lane * size, min((lane + 1) * size, n)) if state else ():
            state = int(dfa.step[state + int(codes[i])])
            if state == flat[i]:
                break
            flat[i] = state
    return flat[:n]


def starts_of(dfa: Dfa, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where matches start in raw, in order, and a bit for each rule that does. dfa reads raw from its end."""
    accepts, state, found = np.repeat(dfa.accepts, dfa.width), 0, []
    for end in range(len(raw), 0, -_PIECE):
        begin = max(0, end - _PIECE)
        states = states_of(dfa, raw[begin:end][::-1], state)
        state = int(states[-1])
        bits = accepts[states][::-1]
        places = np.flatnonzero(bits)
        found.append((places + begin, bits[places]))
    found.reverse()
    return np.concatenate([p for p, _ in found]), np.concatenate([b for _, b in found])


def matches(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Of each text, (start, end, number of the rule) of every match, by start and rule; places count code points."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return found
    reverse, forward = automata(rules)
    places, bits = starts_of(reverse, np.frombuffer(bytes([_END]).join([*texts, b""]), np.uint8))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for number, rule in enumerate(rules):
        starts = places[(bits >> number & 1).astype(bool)]
        whole, head = forward[number]
        at = 0
        while at < len(starts):
            which = int(np.searchsorted(begins, starts[at], side="right")) - 1
            text, start = texts[which], int(starts[at] - begins[which])
            end = whole.end(text, start)
            if end - (head.end(text, start) if head else start) >= rule.least:
                found[which].append((start, end, number))
            at = int(np.searchsorted(starts, begins[which] + end))
    for which, spans in enumerate(found):
        if spans:
            points = np.concatenate([[0], np.cumsum((np.frombuffer(texts[which], np.uint8) & 0xC0) != 0x80)])
            found[which] = sorted(((int(points[a]), int(points[b]), k) for a, b, k in spans), key=lambda s: (s[0], s[2]))
    return found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) of every document's secrets, by start and the order of rules; places count
    code points, the end is exclusive.

    Of each rule the leftmost longest matches that don't overlap count; those of different rules may overlap. A null or empty
    text has none; repeated rows give repeated results; rows without a doc_id take no part; other columns are not read.
    """

    def work(columns: list) -> dict:
        ids, texts = columns
        return {"doc_id": ids, "spans": [[{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in spans] for spans in matches(texts, rules)]}

    plain = texts_of(docs).withColumn("text", F.col("text").cast("binary"))
    return map_rows(plain, work, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def summary(scanned: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their places, and all places."""
    kinds = [r.kind for r in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in kinds), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )
