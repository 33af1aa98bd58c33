"""Token counts of a unigram segmentation by dynamic programming over a shared trie.

A pre-token is a blank-separated chunk with a leading ``▁``. Its tokens are the pieces of the vocabulary that spell it at
the least total cost; at equal cost, the fewest. A piece's cost follows Zipf's law from its rank in the vocabulary; a
character that no piece spells costs a byte piece for each of its UTF-8 bytes. Distinct pre-tokens are inserted in a trie
whose nodes keep the best cost and count of their prefix, so a prefix that words share is solved once; the counts at the
terminal nodes answer for all occurrences.

Each task keeps its own trie over the texts that it reads and starts anew when the trie holds ``NODES`` nodes, so the
work is one map over the documents, without a shuffle and with bounded memory.

Nulls: a null text, like a blank one, has no tokens. Repeated rows are counted once each; words of any length are counted
whole. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, slices

NODES, BYTE_COST = 700_000, 20_000
#: Longer words are solved outside the trie.
WORD = 64


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Costs of the pieces in thousandths of a bit: log2 of rank + 2."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    real = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): round(1000 * math.log2(rank + 2)) for rank, i in enumerate(real)}


@functools.lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    return Trie(vocabulary(path))


class Trie:
    def __init__(self, costs: dict[str, int]) -> None:
        self.costs, self.longest = costs, max(map(len, costs), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.cost, self.tokens = [0], [0]
        self.counts: dict[str, int] = {}

    def step(self, word: str, end: int, cost: list[int], tokens: list[int]) -> tuple[int, int]:
        """Best cost and count of ``word[:end]``, given those of all shorter prefixes."""
        get, best = self.costs.get, None
        for begin in range(max(0, end - self.longest), end):
            price = get(word[begin:end])
            if price is not None:
                found = (cost[begin] + price, tokens[begin] + 1)
                if best is None or found < best:
                    best = found
        if get(word[end - 1]) is None:
            size = len(word[end - 1].encode("utf-8", "replace"))
            found = (cost[end - 1] + size * BYTE_COST, tokens[end - 1] + size)
            if best is None or found < best:
                best = found
        return best

    def insert(self, chunk: str) -> int:
        """Tokens of the chunk's pre-token; new nodes are solved on the way."""
        word = "▁" + chunk
        if len(word) > WORD:
            cost, tokens = [0], [0]
            for end in range(1, len(word) + 1):
                one = self.step(word, end, cost, tokens)
                cost.append(one[0])
                tokens.append(one[1])
            return tokens[-1]
        children, node, cost, tokens = self.children, 0, [0], [0]
        for end, letter in enumerate(word, 1):
            edge = node << 21 | ord(letter)
            child = children.get(edge)
            if child is None:
                one = self.step(word, end, cost, tokens)
                child = children[edge] = len(self.cost)
                self.cost.append(one[0])
                self.tokens.append(one[1])
            node = child
            cost.append(self.cost[node])
            tokens.append(self.tokens[node])
        self.counts[chunk] = tokens[-1]
        return tokens[-1]


def count_tokens(documents: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``n_pretokens`` and ``n_tokens`` of every row's whole text."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        known = trie(model)
        for part in slices(batch, "text"):
            chunks = [(t or "").split() for t in part.column("text").to_pylist()]
            if len(known.cost) > NODES:
                known.clear()
            counts = known.counts
            extra = {c: known.insert(c) for c in sorted({c for some in chunks for c in some}.difference(counts))}
            extra = {c: n for c, n in extra.items() if c not in counts}  # words too long to keep
            value = counts.__getitem__ if not extra else lambda c: extra[c] if c in extra else counts[c]
            yield {"key": part.column("key"), "n_pretokens": [len(some) for some in chunks], "n_tokens": [sum(map(value, some)) for some in chunks]}

    narrow = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return map_batches(narrow, run, f"key {kind}, n_pretokens bigint, n_tokens bigint").withColumnRenamed("key", key)
