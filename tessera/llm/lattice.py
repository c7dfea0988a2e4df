"""The pieces of a public SentencePiece vocabulary, and the lattice of all ways to spell a segment with them."""

from __future__ import annotations

import math
from functools import lru_cache

SPACE = "▁"
_TINY = 1e-200


class Pieces:
    """Vocabulary: ids of ordinary pieces, and of the byte pieces that spell any other character.

    A character without a piece of its own is spelled by its UTF-8 bytes; in a lattice it has the pseudo-id
    size + code point. A vocabulary of merges holds ranks and no probabilities: a piece's weight is that of a
    Zipf law over the ranks, raised to alpha.
    """

    def __init__(self, path: str, alpha: float = 0.5) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        special = {i for i in range(self.size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.spells = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]
        self.ids = {t: i for i, t in enumerate(self.text) if i not in special}
        self.longest = max(map(len, self.ids))
        self.weights = [(1 / (i + 10)) ** alpha for i in range(self.size)]
        self.fallback = (1 / (self.size + 10)) ** alpha

    def spelled(self, char: str) -> int:
        """The byte piece of a one-byte character, else a pseudo-id."""
        return self.bytes[ord(char)] if ord(char) < 128 else self.size + ord(char)

    def expanded(self, ids: list[int]) -> list[int]:
        """Pseudo-ids replaced by byte pieces."""
        out: list[int] = []
        for i in ids:
            if i < self.size:
                out.append(i)
            else:
                out += [self.bytes[b] for b in chr(i - self.size).encode("utf-8", "surrogatepass")]
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text again: pieces side by side, bytes as they are, the leading space dropped."""
        return b"".join(map(self.spells.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


@lru_cache(2)
def pieces(path: str, alpha: float = 0.5) -> Pieces:
    return Pieces(path, alpha)


#: A lattice: for each position the (next position, id, probability, probability of all others) from there.
Lattice = list[list[tuple[int, int, float, float]]]


def lattice(vocabulary: Pieces, spaces: int, body: str) -> Lattice:
    """All spellings of so many spaces and a body without spaces, by the probability of each step given the place.

    Backward sums over all spellings of the rest make the steps; a running factor keeps them in range.
    """
    text = SPACE * spaces + body
    n, ids, longest, weights = len(text), vocabulary.ids, vocabulary.longest, vocabulary.weights
    literal = spaces + body.find(SPACE) if SPACE in body else n + 1
    sums = [0.0] * n + [1.0]
    out: Lattice = [[] for _ in range(n)]
    for i in range(n - 1, -1, -1):
        found = []
        total = 0.0
        for j in range(i + 1, min(n, i + longest) + 1):
            piece = ids.get(text[i:j])
            if piece is not None and (j <= literal or SPACE not in text[max(i, spaces) : j]):
                mass = weights[piece] * sums[j]
                found.append((j, piece, mass))
                total += mass
        if not found or found[0][0] != i + 1:
            mass = vocabulary.fallback * sums[i + 1]
            found.append((i + 1, vocabulary.spelled(text[i]), mass))
            total += mass
        if len(found) == 1:
            out[i] = [(found[0][0], found[0][1], 1.0, 0.0)]
        else:
            out[i] = [
                (j, piece, mass / total, sum(m for o, _, m in found if o != j) / total) for j, piece, mass in found
            ]
        sums[i] = total
        if total < _TINY:
            for k in range(i, min(n, i + longest) + 1):
                sums[k] /= _TINY
    return out


def spellings(steps: Lattice) -> list[tuple[tuple[int, ...], float]]:
    """Every spelling with its log-probability (for tests and short segments)."""
    found: list[list[tuple[tuple[int, ...], float]]] = [[] for _ in steps] + [[((), 0.0)]]
    for i in range(len(steps) - 1, -1, -1):
        found[i] = [((piece, *rest), math.log(p) + q) for j, piece, p, _ in steps[i] for rest, q in found[j]]
    return found[0]
