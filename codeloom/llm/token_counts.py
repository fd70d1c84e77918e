"""Token counts under a unigram model: forward scores computed once per shared prefix of a trie of pre-tokens.

The best segmentation of a pre-token's prefix depends on that prefix alone. Distinct pre-tokens go into a trie whose nodes hold
the forward score (best sum of piece scores) and the number of tokens on that path; a new word only costs the nodes that no
earlier word made. Terminals keep the counts, and a text's count is the sum over its pre-tokens.

The model is fitted to the table: a first pass over all texts segments them by prior scores, gathers how often each piece is used,
and the counts, smoothed by the prior, give the scores of the second pass (a step of Viterbi training).
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bpe import default_pattern, pre_tokeniser, vocabulary, vocabulary_path
from codeloom.llm.common import shipped, texts

#: Trie nodes and terminal counts of a task; beyond them either starts anew, which costs time but changes no count.
MAX_NODES, MAX_TERMINALS = 600_000, 500_000
#: Uses that the prior adds for all pieces together, by their prior probabilities.
PRIOR_USES = 100_000
#: Score of a byte that no piece covers.
UNKNOWN = -30.0


@cache
def prior_scores(path: str) -> dict[bytes, float]:
    """The prior's log probabilities, by Zipf's law over the ranks of a vocabulary file: p(rank) in proportion to 1 / (rank + 1)."""
    ranks = vocabulary(path)
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - norm for piece, r in ranks.items()}


class SuffixPieces:
    """Aho-Corasick automaton over the pieces: ``out[state]`` lists (length, score, rank) of the pieces that end there, longest first."""

    def __init__(self, scores: dict[bytes, float], ranks: dict[bytes, int]):
        self.goto: dict[int, int] = {}  # state * 256 + byte -> state
        paths = {b"": 0}
        for piece in scores:
            for size in range(1, len(piece) + 1):
                prefix = piece[:size]
                if prefix not in paths:
                    paths[prefix] = self.goto[paths[prefix[:-1]] * 256 + prefix[-1]] = len(paths)
        self.fail, self.out, self.path = [0] * len(paths), [()] * len(paths), paths
        for prefix, state in sorted(paths.items(), key=lambda x: len(x[0])):
            if prefix:
                self.fail[state] = next(paths[prefix[k:]] for k in range(1, len(prefix) + 1) if prefix[k:] in paths)
                own = ((len(prefix), scores[prefix], ranks[prefix]),) if prefix in scores else ()
                self.out[state] = own + self.out[self.fail[state]]


@cache
def automaton(path: str) -> SuffixPieces:
    """The automaton of a vocabulary file under the prior's scores."""
    return SuffixPieces(prior_scores(path), vocabulary(path))


def fitted_scores(path: str, uses: dict[int, int]) -> dict[bytes, float]:
    """Log probabilities from the uses of pieces by rank, with PRIOR_USES more by the prior."""
    total = sum(uses.values()) + PRIOR_USES
    return {piece: math.log((uses.get(rank, 0) + PRIOR_USES * math.exp(prior_scores(path)[piece])) / total) for piece, rank in vocabulary(path).items()}


_last: dict[str, SuffixPieces] = {}


def fitted(model: str, path: str, uses: dict[int, int]) -> SuffixPieces:
    """The automaton of a fitted model; a worker keeps its last one for its next task."""
    if model not in _last:
        _last.clear()
        _last[model] = rescored(automaton(path), path, uses)
    return _last[model]


def rescored(pieces: SuffixPieces, path: str, uses: dict[int, int]) -> SuffixPieces:
    """The same automaton with fitted scores."""
    ranks, scores, out = vocabulary(path), fitted_scores(path, uses), SuffixPieces.__new__(SuffixPieces)
    out.goto, out.fail, out.path = pieces.goto, pieces.fail, pieces.path
    out.out = [()] * len(pieces.out)
    for prefix, state in sorted(pieces.path.items(), key=lambda x: len(x[0])):
        if prefix:
            own = ((len(prefix), scores[prefix], ranks[prefix]),) if prefix in scores else ()
            out.out[state] = own + out.out[out.fail[state]]
    return out


class Terminals(dict):
    """Counts by word; an unknown word is inserted."""

    def __init__(self, insert: Callable[[str], int]):
        self.insert = insert

    def __missing__(self, word: str) -> int:
        count = self[word] = self.insert(word)
        return count


class UnigramTrie:
    """``insert`` gives a word's terminal node. For each node: the forward score, number of tokens, and the last piece with the node it begins at."""

    def __init__(self, pieces: SuffixPieces, max_nodes: int = MAX_NODES):
        self.pieces, self.max_nodes = pieces, max_nodes
        self.counts = Terminals(self.tokens_of)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.best, self.tokens, self.state = array("d", [0.0]), array("q", [0]), array("q", [0])
        self.begin, self.piece, self.ends = array("q", [0]), array("q", [-1]), array("q", [0])

    def insert(self, word: str) -> int:
        """The node of the word; the best segmentation is the one of fewer tokens where scores are equal.

        A byte that no piece covers is a token of its own with the score UNKNOWN.
        """
        key = word.encode("utf-8", "surrogatepass")
        node, path = 0, [0]
        child, best, tokens, states = self.child, self.best, self.tokens, self.state
        goto, fail, out = self.pieces.goto, self.pieces.fail, self.pieces.out
        for i, byte in enumerate(key, 1):
            edge = node * 256 + byte
            nxt = child.get(edge)
            if nxt is None:
                # forward score of this prefix, from the scores of the prefixes before it
                state = states[node]
                while (to := goto.get(state * 256 + byte)) is None and state:
                    state = fail[state]
                top, count, begin, piece = best[node] + UNKNOWN, tokens[node] + 1, node, -1
                for length, score, rank in out[to or 0]:
                    at = path[i - length]
                    score += best[at]
                    if score > top or score == top and tokens[at] + 1 < count:
                        top, count, begin, piece = score, tokens[at] + 1, at, rank
                nxt = child[edge] = len(best)
                best.append(top), tokens.append(count), states.append(to or 0)
                self.begin.append(begin), self.piece.append(piece), self.ends.append(0)
            node = nxt
            path.append(node)
        return node

    def full(self) -> bool:
        return len(self.best) > self.max_nodes

    def tokens_of(self, word: str) -> int:
        """A trie that has grown to ``max_nodes`` starts anew, so it never holds more than these and one word's."""
        if self.full():
            self.clear()
        if len(self.counts) > MAX_TERMINALS:
            self.counts.clear()
        return self.tokens[self.insert(word)]

    def total(self, words: list[str]) -> int:
        return sum(map(self.counts.__getitem__, words))

    def gather(self, uses: Counter) -> None:
        """Adds the uses of pieces by the words that end here (``ends``), handed down from each node to where its last piece begins; clears the trie."""
        begin, piece, ends = self.begin, self.piece, self.ends
        for node in range(len(ends) - 1, 0, -1):
            if n := ends[node]:
                ends[begin[node]] += n
                if piece[node] >= 0:
                    uses[piece[node]] += n
        self.clear()


def piece_uses(docs: DataFrame, path: str, pattern: str) -> dict[int, int]:
    """How often the best segmentations of all texts use each piece, by rank; as many numbers at most as the vocabulary has pieces.

    A task counts its distinct pre-tokens, MAX_TERMINALS at a time, and hands on only its pieces' counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, trie = pre_tokeniser(pattern), UnigramTrie(automaton(path))
        words: Counter = Counter()
        uses: Counter = Counter()

        def insert() -> None:
            for word, n in words.items():
                if trie.full():
                    trie.gather(uses)
                trie.ends[trie.insert(word)] += n
            words.clear()

        for batch in batches:
            for text in texts(batch.column(0)):
                words.update(split.findall(text))
                if len(words) > MAX_TERMINALS:
                    insert()
        insert()
        trie.gather(uses)
        yield pa.RecordBatch.from_arrays([pa.array(uses.keys(), pa.int32()), pa.array(uses.values(), pa.int64())], names=["rank", "n"])

    counted = shipped(docs).select("text").mapInArrow(run, "rank int, n long").groupBy("rank").agg(F.sum("n").alias("n"))
    return {row["rank"]: row["n"] for row in counted.collect()}


def count_tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None, max_nodes: int = MAX_NODES, uses: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_tokens, n_pretokens), one row per input row.

    ``uses``: counts of pieces that a model was fitted to; without them the model is fitted to ``docs``, all of it. Null and empty texts
    have no token. Repeated rows and rows without doc_id are counted one by one; further columns are ignored. No shuffle of
    texts; a task's memory is bounded by ``max_nodes``, MAX_TERMINALS, one Arrow batch and its longest pre-token.
    """
    path, pattern = path or vocabulary_path(), pattern or default_pattern()
    shared, model = docs.sparkSession.sparkContext.broadcast(piece_uses(docs, path, pattern) if uses is None else uses), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, split = UnigramTrie(fitted(model, path, shared.value), max_nodes), pre_tokeniser(pattern)
        for batch in batches:
            totals, sizes = [], []
            for text in texts(batch.column(1)):
                words = split.findall(text)
                totals.append(trie.total(words))
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens", "n_pretokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return shipped(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pretokens long")


def op1(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) under the unigram model of ``docs`` over the public vocabulary's pieces."""
    return count_tokens(docs)
