"""Token counts under a unigram model, by dynamic programming over a trie.

Each task inserts the distinct pre-tokens of its documents in a trie. The forward score of a node (the best score of any
split of its prefix into pieces) is computed once, from the scores of its ancestors, however many words share the
prefix. The count of the best split is stored at a word's terminal node; a document's count is the sum over its words.
The trie starts anew when it holds ``NODES`` nodes, which bounds memory and changes no result.

Model: the pieces of a public vocabulary with a Zipf score by rank, ``-round(1000 ln(rank + 2))``, so that sums are exact.
A character that is no piece costs its UTF-8 bytes, one token each, at the worst score less 10,000. Of splits with equal
scores the one with fewer tokens counts. A text gets one leading space; pre-tokens are a line feed, or a run without
space and line feed with the space before it, or a space.

Results: a null or empty text has 0 tokens and 0 pre-tokens; repeated rows are counted alike; existing columns of the
outputs' names are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

NODES = 600_000
PRE_TOKENS = re.compile("\n| ?[^ \n]+| ")
#: Bits for the number of a word's tokens.
COUNT = 40
_tries: dict[str, "Trie"] = {}


def scores_of(path: str) -> dict[str, int]:
    """Score of each piece of a SentencePiece vocabulary; control and byte pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    return {name.replace("▁", " "): -round(1000 * math.log(rank + 2)) for rank, name in enumerate(names)}


class Trie(dict):
    """Token counts by word; a missing word is inserted."""

    def __init__(self, scores: dict[str, int]):
        super().__init__()
        self.tails: dict[str, int | None] = {}
        for piece in scores:
            for start in range(len(piece)):
                self.tails.setdefault(piece[start:], None)
        self.tails.update({piece: (score << COUNT) - 1 for piece, score in scores.items()})
        self.worst = min(scores.values()) - 10_000
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}  # by node and character
        # By node: best score times 2**COUNT less its number of tokens, so that the larger one is the better one.
        self.forward: list[int] = [0]

    def step(self, word: str, end: int, path: list[int]) -> int:
        """Best score and count of word[:end], from those of its prefixes."""
        best, tails = None, self.tails
        if tails.get(word[end - 1]) is None:
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            best = path[end - 1] + (size * self.worst << COUNT) - size
        for start in range(end - 1, -1, -1):
            tail = word[start:end]
            if tail not in tails:
                break
            if (score := tails[tail]) is not None:
                found = path[start] + score
                if best is None or found > best:
                    best = found
        return best

    def __missing__(self, word: str) -> int:
        if len(self.forward) > NODES:
            self.reset()
        node, path = 0, [self.forward[0]]
        for end, letter in enumerate(word, 1):
            edge = node << 21 | ord(letter)
            below = self.child.get(edge)
            if below is None:
                below = self.child[edge] = len(self.forward)
                self.forward.append(self.step(word, end, path))
            node = below
            path.append(self.forward[node])
        count = self[word] = -self.forward[node] & ((1 << COUNT) - 1)
        return count


def loaded(path: str) -> Trie:
    if path not in _tries:
        _tries[path] = Trie(scores_of(path))
    return _tries[path]


def token_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add n_tokens and n_pretokens of each whole text."""

    @F.arrow_udf("struct<n_tokens:bigint,n_pretokens:bigint>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = loaded(path)
        for batch in batches:
            tokens, pretokens = [], []
            for value in batch:
                value = value.as_py()
                parts = PRE_TOKENS.findall(" " + value) if value else []
                tokens.append(sum(map(trie.__getitem__, parts)))
                pretokens.append(len(parts))
            yield pa.StructArray.from_arrays(
                [pa.array(tokens, pa.int64()), pa.array(pretokens, pa.int64())], ["n_tokens", "n_pretokens"]
            )

    found = counts(F.col("`" + text.replace("`", "``") + "`"))
    return df.withColumn("n_tokens", found).withColumns(
        {"n_pretokens": F.col("n_tokens.n_pretokens"), "n_tokens": F.col("n_tokens.n_tokens")}
    )
