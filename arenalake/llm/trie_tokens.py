"""Token counts of a unigram vocabulary by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



SPACE = "▁"
#: Nodes of a worker's trie, and distinct pre-tokens it remembers, before it starts anew.
NODES, MEMORY = 1_000_000, 300_000


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a public vocabulary file with unigram log-probabilities, by Zipf's law on their rank.

    The file's own scores are merge ranks, no probabilities, so the r-th piece gets 1 / (r + 3) of
    the mass, as word frequencies fall by rank. Special and byte pieces are left out: what no piece covers falls back to bytes.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    norm = math.log(sum(1 / (r + 3) for r in range(len(names))))
    return {p: -math.log(r + 3) - norm for r, p in enumerate(names)}


class PieceTrie:
    """A trie of pre-tokens with forward scores.

    A node is a prefix of some pre-token; it holds the best log-probability of the prefix and the
    number of tokens on that path (fewest, among equally likely ones). A pre-token is inserted along
    the nodes that are there already; only the nodes it adds are scored, so a prefix shared by many
    pre-tokens is scored once, whenever they come. The count at a pre-token's last node is its own.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        #: All endings of pieces: what is none can't end a longer piece either.
        self.endings = {p[i:] for p in pieces for i in range(len(p))}
        #: A byte costs more than any piece.
        self.byte = min(pieces.values(), default=-1.0) - 1.0
        self.clear()

    def clear(self) -> None:
        #: Child by parent and character, as one number.
        self.child: dict[int, int] = {}
        self.scores, self.tokens = [0.0], [0]

    def count(self, word: str) -> int:
        child, scores, tokens, pieces, endings = self.child, self.scores, self.tokens, self.pieces, self.endings
        node, path = 0, [0]
        for end, letter in enumerate(word, 1):
            place = node << 21 | ord(letter)
            held = child.get(place)
            if held is None:
                size = len(letter.encode())
                best, fewest = scores[node] + size * self.byte, tokens[node] + size
                for begin in range(end - 1, -1, -1):
                    piece = word[begin:end]
                    if piece not in endings:
                        break
                    gain = pieces.get(piece)
                    if gain is not None:
                        s, n = scores[path[begin]] + gain, tokens[path[begin]] + 1
                        if s > best or s == best and n < fewest:
                            best, fewest = s, n
                held = child[place] = len(scores)
                scores.append(best)
                tokens.append(fewest)
            node = held
            path.append(node)
        return tokens[node]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_tokens. vocabulary: path of its file.

    Pre-tokens are the words between ASCII white space, each with the vocabulary's space mark
    in front. Null and blank texts count zero. Repeated rows and null ids keep their rows; extra
    columns are ignored. Each task grows a trie of the distinct pre-tokens it meets, in batches of
    rows, and remembers their counts; past a bound of nodes or words it starts anew. No row is shuffled.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))  # one vocabulary: fixed size

    @F.pandas_udf(T.StructType().add("n_words", T.LongType()).add("n_tokens", T.LongType()))
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie, known = PieceTrie(pieces.value), {}
        for batch in texts:
            rows = []
            for t in batch:
                words = (t or "").encode().split()
                if len(known) > MEMORY:
                    known.clear()
                if len(trie.scores) > NODES:
                    trie.clear()
                for w in [w for w in set(words) if w not in known]:
                    known[w] = trie.count(SPACE + w.decode())
                rows.append((len(words), sum(map(known.__getitem__, words))))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens"])

    return docs.select("doc_id", count("text").alias("c")).select("doc_id", "c.*")
