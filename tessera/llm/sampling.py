"""Sampled segmentations without replacement: Gumbel top-k over the lattice of a text, by perturbed A* search.

Every segmentation of a text has a Gumbel-perturbed log-probability; the k largest are a sample without
replacement. They are found from the top. A region is a set of segmentations that share a prefix of segments and
differ from named spellings in the next one; its bound is the largest perturbed value inside, which is drawn from
its total log-probability, below the bound of the region it came from. The region with the best bound gives the
next sample, exactly at its bound, and what is left of it splits into smaller regions. No lattice is unrolled:
a segment's lattice, of all its spellings, stands for it.

All draws are hashes of the row key, the sample's number and the place, so a row gives the same samples on any
partition and in any batch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held, slices, texts_of
from tessera.llm.lattice import SPACE, Lattice, Pieces, pieces
from tessera.llm.words import Clash, Known, mixed, ranges, told_apart

SAMPLES = 2
ALPHA = 0.5
SCHEMA = (
    "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids binary"
)
_U = np.uint64
_MASK = (1 << 64) - 1


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def word_starts(raw: np.ndarray, bounds: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Where words begin in texts that have a space before them: each word has the spaces before it, and no piece of the
    vocabulary runs on from a word into a space. Signs that never stand behind a letter in a piece begin words as well."""
    cut_ = np.zeros(len(raw) + 1, bool)
    cut_[1:-1] = (raw[1:] == 32) & (raw[:-1] != 32) | _LETTER[raw[:-1]] & apart[raw[1:]]
    cut_[bounds] = True
    return np.flatnonzero(cut_[:-1])


def marked(word: bytes) -> str:
    """A word with space marks for its spaces. A literal space mark becomes another character, which no piece has."""
    return word.decode("utf-8", "surrogatepass").replace(SPACE, _MARK).replace(" ", SPACE)


def cut(pieces_: Trie, words: list[str]) -> tuple[list[str], np.ndarray]:
    """All words' segments in a row, and where each word's begin: a word parts wherever no piece holds the two
    characters side by side, so the lattice of the whole is exactly those of the segments in a row."""
    if not words:
        return [], np.zeros(1, np.int64)
    joined = _END.join([*words, ""])
    codes = _codes(joined)
    pairs = codes[:-1] << 21 | codes[1:]
    known = pieces_.pairs
    inside = known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] == pairs
    is_end = codes == ord(_END)
    starts = np.concatenate([[0], np.flatnonzero(~inside) + 1])  # a word's end is next to no piece, so it parts too
    starts = starts[~is_end[np.minimum(starts, len(codes) - 1)]]
    ends = np.flatnonzero(is_end)
    stops = np.concatenate([starts[1:], [len(codes) - 1]])
    stops -= is_end[stops - 1]
    segments = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
    return segments, np.searchsorted(starts, np.concatenate([[0], ends + 1]))


def stream(keys: np.ndarray, *places: np.ndarray | int) -> np.ndarray:
    """The state of a place's draws, a function of the row key and the place alone."""
    x = keys
    for n, place in enumerate(places):
        x = mixed(x ^ (np.asarray(place).astype(np.uint64) * _U(0x9E3779B97F4A7C15)), n + 1)
    return x


def uniform(state: np.ndarray, step: int = 0) -> np.ndarray:
    """The step-th value of each state, in (0, 1)."""
    return ((mixed(state, 100 + step) >> _U(12)).astype(np.float64) + 0.5) / 2.0**52


def _uniform_one(state: int, step: int = 0) -> float:
    """uniform() of one state."""
    x = (state + 0x9E3779B97F4A7C15 * (101 + step)) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return (((x ^ (x >> 31)) >> 12) + 0.5) / 2.0**52


def row_key(doc_id: int, text: str, seed: int) -> int:
    mark = f"{seed}:{doc_id}:".encode() + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(hashlib.blake2b(mark, digest_size=8).digest(), "little")


#: Stand between segments, and for a literal space mark. Lone surrogates: no text that Spark holds has them.
_END, _MARK = "\ud800", "\ud801"


class Trie:
    """A vocabulary's pieces by their characters, for finding all pieces in a row of code points at once."""

    def __init__(self, vocabulary: Pieces) -> None:
        following: dict[int, int] = {}
        ends = [-1]
        for text, i in vocabulary.ids.items():
            state = 0
            for c in text:
                state = following.setdefault(state << 21 | ord(c), len(following) + 1)
                if state == len(ends):
                    ends.append(-1)
            ends[state] = i
        self.keys = np.array(sorted(following), np.int64)
        self.to = np.array([following[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)
        pairs = {ord(t[i]) << 21 | ord(t[i + 1]) for t in vocabulary.ids for i in range(len(t) - 1)}
        self.pairs = np.array(sorted(pairs), np.int64)
        letters = [c for c in range(128) if _LETTER[c]]
        self.apart = np.array([33 <= c < 127 and c not in letters and not any(a << 21 | c in pairs for a in letters) for c in range(256)])

    def found(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, pieces) of the pieces of 1 character, then 2, and so on. The last code must be _END's."""
        at, state, size = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        while len(at):
            key = state << 21 | codes[at + size]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[i] == key
            at, state, size = at[on], self.to[i[on]], size + 1
            piece = self.ends[state]
            hit = piece >= 0
            yield at[hit], piece[hit]


def trie(vocabulary: Pieces) -> Trie:
    if not hasattr(vocabulary, "trie"):
        vocabulary.trie = Trie(vocabulary)
        vocabulary.log_weights = np.log([*vocabulary.weights, vocabulary.fallback])
    return vocabulary.trie


def _codes(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class _Rows:
    """Arrays side by side that grow at their end."""

    def __init__(self, **kinds: type) -> None:
        self.kinds, self.size, self.room = kinds, 0, 0
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.room = 1 << 16
        for name, kind in self.kinds.items():
            setattr(self, name, np.empty(self.room, kind))

    def add(self, **columns: np.ndarray) -> None:
        end = self.size + len(next(iter(columns.values())))
        while self.room < end:
            self.room *= 2
        for name, values in columns.items():
            held = getattr(self, name)
            if len(held) < self.room:
                setattr(self, name, np.concatenate([held[: self.size], np.empty(self.room - self.size, held.dtype)]))
                held = getattr(self, name)
            held[self.size : end] = values
        self.size = end


#: Shares of steps are summed in so many units of 1, exactly, so that a draw gives the same step whatever stands beside it.
_UNITS = 1 << 30
#: Segments whose lattices are made at once.
_AT_ONCE = 16_384


class Lattices:
    """The lattices of distinct segments side by side: a node for each character, its steps in a row, longest first.

    They are kept for the next batch, with the segments of every word, until there are more than most_steps steps;
    then all begins anew, so memory is bounded. Node 0 is the end of every segment. Backward sums, in logarithms, make
    the steps' probabilities, for all new nodes at the same distance from their segment's end at once.
    """

    def __init__(self, vocabulary: Pieces, most_steps: int = 2_000_000) -> None:
        self.vocabulary, self.trie, self.most_steps = vocabulary, trie(vocabulary), most_steps
        self.nodes = _Rows(first=np.int64)  # a node's first step; one more entry stands behind the last node
        self.steps = _Rows(to=np.int32, piece=np.int32, log=np.float64, others=np.float32, reach=np.uint32)
        self.roots = _Rows(root=np.int64, length=np.int64)  # of each segment
        self.of_words = _Rows(segment=np.int32)
        self.word_starts = _Rows(first=np.int64)  # a word's first segment; one more entry stands behind the last word
        self.clear()

    def clear(self) -> None:
        for rows in (self.nodes, self.steps, self.roots, self.of_words, self.word_starts):
            rows.clear()
        self.words = Known("number")
        self.segments: dict[str, int] = {}
        self.nodes.add(first=np.zeros(2, np.int64))
        self.word_starts.add(first=np.zeros(1, np.int64))

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """The segments of each text."""
        if self.steps.size > self.most_steps:
            self.clear()
        coded = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        text, bounds = b"".join(coded), np.cumsum([0, *map(len, coded)])
        raw = np.frombuffer(text, np.uint8)
        if not len(raw):
            return [np.zeros(0, np.int64) for _ in texts]
        begins = word_starts(raw, bounds, self.trie.apart)
        try:
            word = self._words(text, raw, begins)
        except Clash:  # then the words are taken in one by one, and not found again
            word = self._take_in([text[a:b] for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(text)])])
        starts = self.word_starts.first
        n = starts[word + 1] - starts[word]
        segments = self.of_words.segment[ranges(starts[word], n)].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(begins, bounds)].tolist()
        return [segments[a:b] for a, b in zip(ends, ends[1:])]

    def _words(self, text: bytes, raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The number of every word, of which new ones are taken in."""
        hashes, first, size, which = told_apart(raw, begins)
        old, at = self.words.find(hashes, raw, first, size)
        number = np.empty(len(hashes), np.int64)
        number[old] = self.words.number[at]
        pieces_ = [text[a : a + n] for a, n in zip(first[~old].tolist(), size[~old].tolist())]
        number[~old] = self._take_in(pieces_)
        self.words.add(hashes[~old], pieces_, number=number[~old])
        return number[which]

    def _take_in(self, words: list[bytes]) -> np.ndarray:
        """Numbers for words that are not held yet."""
        segments, first = cut(self.trie, [marked(w) for w in words])
        unseen = list(set(segments).difference(self.segments))
        for at in range(0, len(unseen), _AT_ONCE):
            self._append(unseen[at : at + _AT_ONCE])
        self.segments.update(zip(unseen, range(len(self.segments), len(self.segments) + len(unseen))))
        before = self.word_starts.size - 1
        self.word_starts.add(first=first[1:] + self.of_words.size)
        self.of_words.add(segment=np.fromiter(map(self.segments.__getitem__, segments), np.int64, len(segments)))
        return before + np.arange(len(words))

    def _append(self, every: list[str]) -> None:
        """The lattices of segments that are not held yet."""
        v = self.vocabulary
        joined = _END.join([*every, ""])
        codes = _codes(joined)
        lengths = np.fromiter(map(len, every), np.int64, len(every))
        ends = np.cumsum(lengths + 1) - 1
        found = list(self.trie.found(codes))
        bare = np.ones(len(codes), bool)  # characters without a piece of their own
        bare[found[0][0]] = bare[ends] = False
        bare = np.flatnonzero(bare)
        spells = [v.spelled(SPACE if joined[i] == _MARK else joined[i]) for i in bare.tolist()]
        found[0] = (np.concatenate([found[0][0], bare]), np.concatenate([found[0][1], np.array(spells, np.int64)]))

        # new nodes are numbered by their distance from the end, so steps lead to nodes of smaller numbers; ends are 0
        distance = np.repeat(ends, lengths + 1) - np.arange(len(codes))
        by_distance = np.argsort(distance.astype(np.int32), kind="stable")[len(ends) :]
        number = np.zeros(len(codes), np.int64)
        number[by_distance] = np.arange(len(by_distance))
        counts = np.zeros(len(codes), np.int64)
        for at, _ in found:
            counts[at] += 1
        first = np.concatenate([[0], np.cumsum(counts[by_distance])])
        behind = np.concatenate([first[1:][number], [0]])  # behind each place's last step; filled from there
        behind[ends] = 0
        total, base = int(first[-1]), self.nodes.size - 1
        to, piece = np.empty(total, np.int64), np.empty(total, np.int64)
        is_end = np.zeros(len(codes) + 1, bool)
        is_end[ends] = True
        for size, (at, what) in enumerate(found, 1):
            behind[at] -= 1
            to[behind[at]] = np.where(is_end[at + size], -1, number[at + size])
            piece[behind[at]] = what

        weight = v.log_weights[np.minimum(piece, v.size)]
        sums, share, log = np.zeros(len(by_distance) + 1), np.empty(total), np.empty(total)  # the last sum is of an end
        counts = np.diff(first)
        levels = np.searchsorted(distance[by_distance], np.arange(1, int(lengths.max()) + 2)).tolist()
        for g, h in zip(levels, levels[1:]):
            a, b = int(first[g]), int(first[h])
            at, n = first[g:h] - a, counts[g:h]
            logs = weight[a:b] + sums[to[a:b]]
            top = np.maximum.reduceat(logs, at)
            logs -= np.repeat(top, n)
            mass = np.exp(logs)
            all_ = np.add.reduceat(mass, at)
            log_all = np.log(all_)
            sums[g:h] = top + log_all
            share[a:b] = mass / np.repeat(all_, n)
            log[a:b] = logs - np.repeat(log_all, n)
        # a step's share from the top is never the small rest of a large one: that is summed by itself
        node = np.repeat(np.arange(len(counts)), counts)
        others = 1.0 - share
        large = share > 0.5
        others[large] = np.add.reduceat(np.where(large, 0.0, share), first[:-1])[node[large]]
        units = (share * _UNITS).astype(np.int64)
        sums = np.cumsum(units)
        reach = sums - (sums - units)[first[:-1]][node]
        reach[first[1:] - 1] = _UNITS
        self.roots.add(root=number[ends - lengths] + base, length=lengths)
        self.steps.add(to=np.where(to < 0, 0, to + base), piece=piece, log=log, others=others, reach=reach)
        self.nodes.add(first=first[1:] + (self.steps.size - total))

    def lattice(self, segment: int) -> Lattice:
        """One segment's lattice."""
        first, to, v = self.nodes.first, self.steps.to, self.vocabulary
        root, length = int(self.roots.root[segment]), int(self.roots.length[segment])
        place, waiting = {root: 0, 0: length}, [root]
        out: Lattice = [[] for _ in range(length)]
        while waiting:
            node = waiting.pop()
            a, b = int(first[node]), int(first[node + 1])
            for t, piece, log, others in zip(*(x[a:b].tolist() for x in (to, self.steps.piece, self.steps.log, self.steps.others))):
                wide = len(v.text[piece]) if piece < v.size and piece not in v.byte_of else 1
                if t not in place:
                    place[t] = place[node] + wide
                    waiting.append(t)
                out[place[node]].append((place[t], piece, math.exp(log), others))
        return out

    def walk(self, segment: np.ndarray, keys: np.ndarray, number: int, at: np.ndarray):
        """A spelling for each occurrence (of a segment, in the row with a key, as sample number, at a place):
        (occurrence and piece of every step, in order; log-probability and probability of all else by occurrence)."""
        logs, rest = np.zeros(len(segment)), np.zeros(len(segment))
        first, steps = self.nodes.first, self.steps
        live, node, step = np.arange(len(segment)), self.roots.root[segment], 0
        state = stream(keys, number, at)
        who, what = [], []
        while len(live):
            draw = (mixed(state, 100 + step) >> _U(34)).astype(np.uint32)
            took = first[node]
            more = np.flatnonzero(steps.reach[took] <= draw)
            while len(more):
                took[more] += 1
                more = more[steps.reach[took[more]] <= draw[more]]
            who.append(live)
            what.append(steps.piece[took])
            rest[live] += np.exp(logs[live]) * steps.others[took]
            logs[live] += steps.log[took]
            node = steps.to[took]
            on = np.flatnonzero(node)
            live, node, state, step = live[on], node[on], state[on], step + 1
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), logs, rest
        # the k-th step of an occurrence stands k places behind its first
        counts = np.zeros(len(segment), np.int64)
        for one in who:
            counts[one] += 1
        free = np.cumsum(counts) - counts
        pieces_ = np.empty(int(counts.sum()), np.int64)
        for one, piece in zip(who, what):
            pieces_[free[one]] = piece
            free[one] += 1
        return np.repeat(np.arange(len(segment)), counts), pieces_, logs, rest


def _branches(steps: Lattice, taken: list[tuple[int, ...]]) -> list[tuple[float, tuple[int, ...], int]]:
    """What is left of a segment without some spellings: (probability, pieces before, place, next piece) of each way
    to leave them."""
    out = []
    waiting = [((), 0, 1.0, taken)]
    while waiting:
        before, at, mass, inside = waiting.pop()
        onward: dict[int, list[tuple[int, ...]]] = {}
        for t in inside:
            if len(t) > len(before):
                onward.setdefault(t[len(before)], []).append(t)
        for to, piece, p, _ in steps[at] if at < len(steps) else ():
            if piece in onward:
                waiting.append(((*before, piece), to, mass * p, onward[piece]))
            elif p > 0:
                out.append((mass * p, (*before, piece), to))
    return out


def _other_spelling(steps: Lattice, taken: list[tuple[int, ...]], key: int, number: int, place: int) -> tuple[tuple[int, ...], float, float]:
    """A spelling that is none of taken, in proportion to probability: (pieces, log-probability, what else is left)."""
    ways = _branches(steps, taken)
    state = int(stream(np.full(1, key, np.uint64), number, place, 1)[0])
    draw = _uniform_one(state) * sum(w[0] for w in ways)
    for way in ways:
        draw -= way[0]
        if draw < 0:
            break
    mass, spelled, at = way
    log, done, n = math.log(mass), list(spelled), 0
    while at < len(steps):
        draw = _uniform_one(state, 1 + n)
        for to, piece, p, _ in steps[at]:
            draw -= p
            if draw < 0:
                break
        log, at, n = log + math.log(p), to, n + 1
        done.append(piece)
    chosen = tuple(done)
    return chosen, log, sum(w[0] for w in _branches(steps, [*taken, chosen]))


def _below(bound: float, log_mass: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Gumbel values of given location, below a bound: exp(-G) is exponential, and beyond exp(-bound) still is.
    draws: log(-log(u)) of uniform values."""
    with np.errstate(over="ignore"):
        return -np.logaddexp(-bound, draws - log_mass)


class Sampler:
    """Batches of (doc_id, text) to samples."""

    def __init__(self, vocabulary: Pieces) -> None:
        self.vocabulary, self.lattices = vocabulary, Lattices(vocabulary)

    def __call__(self, rows: list[tuple[int, str]], k: int, seed: int) -> list[dict]:
        held = self.lattices.rows([t for _, t in rows])
        keys = [row_key(d, t, seed) for d, t in rows]
        tops = -np.log(-np.log(uniform(stream(np.array(keys, np.uint64), 1 << 40))))
        state = [_Search(*of_row, self.lattices) for of_row in zip(keys, tops.tolist(), held)]
        for turn in range(k):
            todo = [search for search in state if search.open_best(turn)]
            if not todo:
                break
            lengths = np.array([len(s.held) - s.free for s in todo])
            starts = np.concatenate([[0], np.cumsum(lengths)])
            segment = np.concatenate([s.held[s.free :] for s in todo])
            keys = np.array([s.key for s in todo], np.uint64)
            places = np.arange(starts[-1]) - np.repeat(starts[:-1] - [s.free for s in todo], lengths)
            who, what, logs, rest = self.lattices.walk(segment, np.repeat(keys, lengths), turn, places)
            counts = np.bincount(who, minlength=len(segment))
            steps = np.concatenate([[0], np.cumsum(counts)])[starts].tolist()
            states = stream(keys, turn, 1 << 41)
            draws = uniform(stream(np.repeat(states, lengths), places))
            heads = uniform(stream(states, np.array([s.free - 1 for s in todo])))  # of the place that was spelled otherwise
            with np.errstate(divide="ignore"):
                rest, draws, heads = np.log(rest), np.log(-np.log(draws)), np.log(-np.log(heads))
            for n, (search, a, b) in enumerate(zip(todo, starts[:-1].tolist(), starts[1:].tolist())):
                search.close(what[steps[n] : steps[n + 1]], counts[a:b], logs[a:b], rest[a:b], draws[a:b], heads[n])
        out = []
        for (doc_id, _), search in zip(rows, state):
            out += search.results(doc_id, self.vocabulary)
        return out


class _Search:
    """One text's search: its samples so far and the regions that are left."""

    def __init__(self, key: int, top: float, held: np.ndarray, lattices: Lattices) -> None:
        self.key, self.top, self.held, self.lattices = key, top, held, lattices
        self.leaves: list[dict] = []
        self.regions: list[dict] = []  # of each sample: bounds, by the place where others leave it

    def _best(self) -> tuple[float, int, int]:
        tops = [(float(r["bounds"].max()), n, int(r["bounds"].argmax())) for n, r in enumerate(self.regions) if len(r["bounds"])]
        return max(tops, default=(-math.inf, -1, -1))

    def open_best(self, turn: int) -> bool:
        """Take the best region, if any is left; from the place `free` on, it is still to be spelled."""
        if turn == 0:
            self.now, self.free = {"bound": self.top, "from": None}, 0
            return True
        bound, leaf, at = self._best()
        if bound == -math.inf:
            return False
        base, region = self.leaves[leaf], self.regions[leaf]
        place = region["first"] + at
        taken = [base["spelled"](place)] + (region["taken"] if at == 0 else [])
        other, log, left = _other_spelling(self.lattices.lattice(int(self.held[place])), taken, self.key, turn, place)
        region["bounds"][at] = -math.inf  # this region goes; what is left of it belongs to the new sample
        self.now = {"bound": bound, "from": base, "place": place, "other": other, "log": log, "left": left, "taken": taken}
        self.free = place + 1
        return True

    def close(self, what: np.ndarray, counts: np.ndarray, logs: np.ndarray, log_rest: np.ndarray, draws: np.ndarray, head_draw: float) -> None:
        """The tail has been spelled: the sample is whole, and its region splits by the place of the next difference.
        draws: log(-log(u)) of each place's value, and of the place before the tail."""
        now = self.now
        ends, first, taken = np.cumsum(counts), 0, []
        if now["from"] is not None:
            base, first, taken = now["from"], now["place"], now["taken"]
            head = int(base["ends"][first - 1]) if first else 0
            spelled_to = head + len(now["other"])
            what = np.concatenate([base["pieces"][:head], now["other"], what]).astype(np.int64)
            ends = np.concatenate([base["ends"][:first], [spelled_to], spelled_to + ends])
            logs = np.concatenate([base["logs"][:first], [now["log"]], logs])
            log_rest = np.concatenate([[math.log(now["left"]) if now["left"] > 0 else -math.inf], log_rest])
            draws = np.concatenate([[head_draw], draws])
        sums = np.cumsum(logs)
        mass = (sums - logs)[first:] + log_rest
        bounds = _below(now["bound"], mass, draws)
        bounds[mass == -math.inf] = -math.inf

        def spelled(at: int) -> tuple[int, ...]:
            return tuple(what[(int(ends[at - 1]) if at else 0) : int(ends[at])].tolist())

        log = float(sums[-1]) if len(sums) else 0.0
        self.leaves.append({"bound": now["bound"], "pieces": what, "ends": ends, "logs": logs, "log": log, "spelled": spelled})
        self.regions.append({"bounds": bounds, "first": first, "taken": taken})

    def results(self, doc_id: int, vocabulary: Pieces) -> list[dict]:
        threshold = self._best()[0]
        out = []
        for n, leaf in enumerate(self.leaves):
            log, ids = leaf["log"], leaf["pieces"]
            inclusion = 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(700.0, log - threshold)))
            if len(ids) and ids.max() >= vocabulary.size:
                ids = np.array(vocabulary.expanded(ids.tolist()))
            out.append(
                {
                    "doc_id": doc_id, "sample": n + 1, "n_pieces": len(ids), "log_prob": log, "perturbed": leaf["bound"],
                    "inclusion": inclusion, "ids": ids.astype("<u4").tobytes(),
                }
            )
        return out


def sampler(vocabulary: str, alpha: float) -> Sampler:
    """One sampler for all tasks of a worker."""
    return held(("sampler", vocabulary, alpha), lambda: Sampler(pieces(vocabulary, alpha)))


def sample_segmentations(
    docs: DataFrame, vocabulary: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = 0, decoded: bool = False
) -> DataFrame:
    """k distinct sampled segmentations of every whole text, best perturbed value first: doc_id, sample (from 1),
    n_pieces, log_prob, perturbed, inclusion (probability to be in such a sample, given the next value), ids and, if
    decoded, the text that they are decoded to.

    A text with fewer segmentations gives as many as it has; a null or empty text one, without pieces. Equal rows
    give equal samples, each. Rows without a doc_id take no part; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = SCHEMA + ", text string" * decoded
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = sampler(vocabulary, alpha)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                ids, texts = (c.to_pylist() for c in part.columns)
                rows = draw(list(zip(ids, texts)), k, seed)
                if decoded:
                    for row in rows:
                        row["text"] = draw.vocabulary.decoded(np.frombuffer(row["ids"], "<u4").tolist())
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return texts_of(docs).mapInArrow(run, schema)


def decode_segmentations(samples: DataFrame, vocabulary: str) -> DataFrame:
    """samples with text, decoded from their ids; a column of that name is replaced. A literal space mark in a text is
    spelled by its bytes, so every text comes back as it was. Null ids give a null text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = samples.drop("text")
    schema = kept.withColumn("text", F.lit(None).cast("string")).schema
    arrow, at = to_arrow_schema(schema), kept.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = pieces(vocabulary).decoded
        for batch in batches:
            for part in slices(batch):
                ids = part.column(at).to_pylist()
                texts = pa.array([None if x is None else decoded(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], schema=arrow)

    return kept.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """A row for each sample, with the checksums of its ids and of the text that was decoded from them."""
    return decoded.select(
        "doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", F.crc32("ids").alias("ids_crc32"), F.crc32("text").alias("text_crc32")
    )
