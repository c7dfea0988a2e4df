"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability under a
language is the sum over all ways to spell it with pieces, by a forward pass; a text's is the product over its
words, counted. The probabilities come from expectation-maximisation over the same sums.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import chain

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import held, map_rows, saved, texts_of
from tessera.llm.lattice import SPACE, pieces

#: The models are fitted on at most so many documents of each language (those of the smallest hash).
MOST_PER_LANGUAGE = 2_000
ROUNDS = 3
#: Words whose sums are made at once; this bounds memory alone.
_AT_ONCE = 16_384
UNDETERMINED = "und"
_FLOOR = 1e-9
#: Stands between words; no text that Spark holds has a lone surrogate.
_END = "\ud800"
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_ASCII_LETTER = re.compile(r"[A-Za-z]")

Model = tuple[list[str], dict[str, tuple[float, ...]]]


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def word_counts(text: str) -> Counter:
    """Lower-cased words, runs of a-z and of characters beyond ASCII, with their counts."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    counts = Counter(words)
    return Counter({w.decode("utf-8", "surrogatepass"): n for w, n in counts.items()})


class Sums:
    """Sums over all segmentations of many words at once, in logarithms, so that a word may be of any length.

    An Aho-Corasick pass finds all pieces of all words; the places at one distance from their word's start (or end) are
    summed together. A character that is no piece is a step of its own, of a small fixed probability.
    """

    def __init__(self, model: Model) -> None:
        langs, table = model
        self.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, piece in enumerate(table):
            self.finder.add_word(piece, n << 8 | len(piece))
        self.finder.make_automaton()
        self.log_share = np.log(np.vstack([np.array(list(table.values())).reshape(-1, len(langs)), np.full(len(langs), _FLOOR)]))

    def _steps(self, words: list[str]):
        """(where each step starts and ends in the row of all words, its piece), each word's first place, lengths."""
        joined = _END.join([*words, ""])
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lengths + 1) - lengths - 1
        found = np.fromiter(chain.from_iterable(self.finder.iter(joined)), np.int64).reshape(-1, 2)
        size, piece, end = found[:, 1] & 255, found[:, 1] >> 8, found[:, 0] + 1
        bare = np.ones(len(joined), bool)
        bare[(end - 1)[size == 1]] = bare[first + lengths] = False
        bare = np.flatnonzero(bare)
        start = np.concatenate([end - size, bare])
        end = np.concatenate([end, bare + 1])
        piece = np.concatenate([piece, np.full(len(bare), len(self.log_share) - 1)])
        return start, end, piece, first, lengths

    def _passed(self, source: np.ndarray, to: np.ndarray, piece: np.ndarray, depth: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log-sums of all ways from begin to each place, over steps that lead to greater depths."""
        order = np.lexsort((to, depth[to]))
        source, to, piece = source[order], to[order], piece[order]
        sums = np.full((len(depth), self.log_share.shape[1]), -np.inf)
        sums[begin] = 0.0
        edges = np.searchsorted(depth[to], np.arange(1, int(depth.max(initial=0)) + 2)).tolist()
        for a, b in zip(edges, edges[1:]):
            if a < b:
                heads = np.flatnonzero(np.concatenate([[True], to[a + 1 : b] != to[a : b - 1]]))
                ways = sums[source[a:b]] + self.log_share[piece[a:b]]
                top = np.maximum.reduceat(ways, heads)
                ways -= np.repeat(top, np.diff([*heads.tolist(), b - a]), axis=0)
                sums[to[a:b][heads]] = top + np.log(np.add.reduceat(np.exp(ways), heads))
        return sums

    def __call__(self, words: list[str]) -> np.ndarray:
        """Log-probabilities, a row for each word."""
        out = [np.zeros((0, self.log_share.shape[1]))]
        for at in range(0, len(words), _AT_ONCE):
            start, end, piece, first, lengths = self._steps(words[at : at + _AT_ONCE])
            depth = np.arange(lengths.sum() + len(lengths)) - np.repeat(first, lengths + 1)
            out.append(self._passed(start, end, piece, depth, first)[first + lengths])
        return np.concatenate(out)

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each of so many (a column for each language): a row for each
        piece of the model."""
        n = len(self.log_share)
        out = np.zeros((n, self.log_share.shape[1]))
        for at in range(0, len(words), _AT_ONCE):
            start, end, piece, first, lengths = self._steps(words[at : at + _AT_ONCE])
            depth = np.arange(lengths.sum() + len(lengths)) - np.repeat(first, lengths + 1)
            left = np.repeat(lengths, lengths + 1) - depth
            ahead = self._passed(start, end, piece, depth, first)
            back = self._passed(end, start, piece, left, first + lengths)
            word = np.searchsorted(first, start, side="right") - 1
            share = np.exp(ahead[start] + self.log_share[piece] + back[end] - ahead[first + lengths][word])
            share *= counts[at : at + _AT_ONCE][word]
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(piece, share[:, k], minlength=n)
        return out[:-1]


def in_fold(fold: int = 2, of: int = 4):
    return F.crc32(F.col("doc_id").cast("string")) % of == fold


def fit(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS, most: int = MOST_PER_LANGUAGE) -> Model:
    """Languages and the piece probabilities of each, from docs' text and lang.

    At most `most` documents of each language are read: those of the smallest hash of doc_id. What reaches the driver is
    a number for each piece and language: the vocabulary bounds it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    labelled = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), text.alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 62)).alias("mark")
    )
    # a mark below the bar has about 1.2 * most of a language's rows, however many there are: one task orders only those
    bars = labelled.groupBy("lang").agg((F.least(F.lit(1.0), (1.2 * most + 100) / F.count("*")) * float(1 << 62)).alias("bar"))
    low = labelled.join(F.broadcast(bars), "lang").where("mark < bar")  # a row a language, as the model has: no text is shuffled for it
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "text"))
    sample = saved(low.withColumn("nth", nth).where(F.col("nth") <= most).select("lang", "text"), "labelled")
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not langs:
        return [], {}

    def count(columns: list) -> dict:
        found: Counter = Counter()
        for lang, text in zip(*columns):
            for w, n in word_counts(text).items():
                found[lang, w] += n
        return {"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())}

    counted = map_rows(sample, count, "lang string, word string, n long")
    words = saved(counted.groupBy("word").pivot("lang", langs).agg(F.sum("n")).na.fill(0), "words")

    names = list(pieces(vocabulary).ids)
    model: Model = langs, dict.fromkeys(names, (1 / len(names),) * len(langs))
    columns = [f"n{k}" for k in range(len(langs))]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def expect(cols: list) -> dict:
            found = Sums(shared.value).expected([SPACE + w for w in cols[0]], np.array(cols[1:], float).T)
            some = np.flatnonzero(found.any(1))
            return {"piece": some} | {c: found[some, k] for k, c in enumerate(columns)}

        made = map_rows(words, expect, ", ".join(["piece int", *(f"{c} double" for c in columns)]))
        totals = np.zeros((len(names), len(langs)))
        for row in made.groupBy("piece").agg(*(F.sum(c) for c in columns)).collect():
            totals[row[0]] = row[1:]
        totals += 0.01
        model = langs, dict(zip(names, map(tuple, (totals / totals.sum(0)).tolist())))
        shared.unpersist()
    return model


class Scorer:
    """Texts to (language, score). Words are scored once per worker, up to a bound; beyond it, once per batch."""

    def __init__(self, model: Model, most_known: int = 150_000) -> None:
        self.langs, self.most_known = model[0], most_known
        self.sums = Sums(model) if model[0] else None
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.langs)))

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        counted = [word_counts(t) if self.langs and has_letter(t) else Counter() for t in texts]
        new = list(set(chain.from_iterable(counted)).difference(self.rows))
        rows, logs = self.rows, np.vstack([self.logs, self.sums([SPACE + w for w in new])]) if new else self.logs
        if new and len(rows) + len(new) <= self.most_known:
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
            self.logs = logs
        elif new:
            rows = rows | dict(zip(new, range(len(rows), len(rows) + len(new))))
        shares = np.exp(logs - logs.max(1, keepdims=True)) if len(logs) else logs
        shares /= shares.sum(1, keepdims=True)
        out = []
        for counts in counted:
            if not counts:
                out.append((UNDETERMINED, 0.0))
                continue
            at = np.fromiter(map(rows.__getitem__, counts), np.int64, len(counts))
            n = np.fromiter(counts.values(), float, len(counts))
            best = int((n @ logs[at]).argmax())
            out.append((self.langs[best], float(min(1.0, n @ shares[at, best] / n.sum()))))
        return out


def scorer(key: str, model: Model) -> Scorer:
    """One scorer, with what it knows, for all tasks that a worker runs with a model."""
    return held(("scorer", key), lambda: Scorer(model))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every document's whole text; score is the mean share of the predicted language
    among all, over the words.

    A text that is null or has no letter is `und` with score 0; so is any if no language was learned. Equal
    likelihoods go to the first language by name. Repeated rows give repeated results; rows without a doc_id
    take no part; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def work(columns: list) -> dict:
        ids, texts = columns
        found = scorer(key, shared.value)(texts)
        return {"doc_id": ids, "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    return map_rows(texts_of(docs), work, "doc_id long, lang_pred string, score double", keeps=True)


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the documents outside the held-out fold, applied to all."""
    model = fit(docs.where(~in_fold()), vocabulary)
    return predict(docs, model).select("doc_id", in_fold().alias("held_out"), "lang_pred", "score")
