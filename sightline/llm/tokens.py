"""Operator 10: unigram token counts by dynamic programming on a trie of distinct pre-tokens.

Texts are split at white space; a pre-token is a word behind the word mark. The distinct pre-tokens of a batch go through
a trie in sorted order, so a forward score is computed once for each shared prefix; a node that ends a pre-token keeps
its token count. Counts are remembered across batches in a bounded memory, then summed per document: no shuffle, and
nothing grows with the corpus. The vocabulary and its order come from a public tokenizer file; a piece's score is the
logarithm of a Zipf prior on its rank. Characters outside the vocabulary cost one byte token per UTF-8 byte.

Null and empty texts count 0. Ties between segmentations go to the one with fewer tokens. Repeated rows give repeated
results, very long texts and words are counted whole, and extra columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sheltered

MARK = "▁"


class Unigram:
    """Pieces with scores, and the forward pass over a trie of pre-tokens."""

    def __init__(self, pieces: Iterable[str]) -> None:
        pieces = list(dict.fromkeys(p for p in pieces if p))
        total = math.log(sum(1.0 / (i + 1) for i in range(len(pieces)))) if pieces else 0.0
        self.score = {p: -math.log(i + 1) - total for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=0)
        self.byte = -math.log(len(pieces) + 256) - total
        #: every proper suffix of a piece: where a string is no suffix of any, longer strings need no look-up
        self.tails = {p[i:] for p in pieces for i in range(len(p))}

    @classmethod
    def from_sentencepiece(cls, path: str) -> Unigram:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return cls(model.id_to_piece(i) for i in sorted(ids, key=lambda i: (-model.get_score(i), i)))

    def _extend(self, word: str, end: int, best: list[tuple[float, int]]) -> tuple[float, int]:
        """Best (score, -tokens) of word[:end], given those of all shorter prefixes."""
        c = word[end - 1]
        score, count = best[end - 1]
        n = len(c.encode("utf-8", "surrogatepass"))
        found = (score + n * self.byte, count - n)
        table, tails = self.score, self.tails
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            piece = word[start:end]
            if piece not in tails:
                break
            own = table.get(piece)
            if own is not None:
                score, count = best[start]
                one = (score + own, count - 1)
                if one > found:
                    found = one
        return found

    def count_all(self, words: Iterable[str]) -> dict[str, int]:
        """Token counts of distinct words. Sorted words walk the trie depth first; `best` is the path from its root."""
        counts: dict[str, int] = {}
        path, best = "", [(0.0, 0)]
        for word in sorted(words):
            full = MARK + word
            shared = 0
            for a, b in zip(full, path):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :]
            for end in range(shared + 1, len(full) + 1):
                best.append(self._extend(full, end, best))
            path = full
            counts[word] = -best[-1][1]
        return counts


_models: dict[str, tuple[Unigram, dict[str, int]]] = {}


def _model(path: str) -> tuple[Unigram, dict[str, int]]:
    """The vocabulary of a Python worker and the counts that it remembers."""
    if path not in _models:
        _models[path] = (Unigram.from_sentencepiece(path), {})
    return _models[path]


def count_tokens(documents: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), remembered: int = 300_000, slice_chars: int = 1 << 20) -> DataFrame:
    """Per row: the kept columns, n_pretokens and n_tokens. vocabulary: path of a SentencePiece model on every node."""
    sheltered(documents, text, *keep)
    kinds = {c: documents.schema[c].dataType.simpleString() for c in keep}
    named = documents.select(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = _model(vocabulary)
        for batch in batches:
            pretokens, tokens = [], []
            at, texts = 0, batch.pop("text").tolist()
            while at < len(texts):
                size, split = 0, []
                while at < len(texts) and (not split or size < slice_chars):
                    t = texts[at]
                    split.append(t.split() if isinstance(t, str) else [])
                    size += len(t) if isinstance(t, str) else 0
                    at += 1
                new = set().union(*split).difference(known)
                if len(known) + len(new) > remembered:
                    known.clear()
                    new = set().union(*split)
                known.update(model.count_all(new))
                get = known.__getitem__
                pretokens += map(len, split)
                tokens += [sum(map(get, words)) for words in split]
            yield batch.assign(n_pretokens=pretokens, n_tokens=tokens)

    schema = "".join(f"k{i} string, " for i in range(len(keep))) + "n_pretokens long, n_tokens long"
    out = named.mapInPandas(count, schema)
    return out.select(*(F.col(f"k{i}").cast(kinds[c]).alias(c) for i, c in enumerate(keep)), "n_pretokens", "n_tokens")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())


QUERIES = {"op10_tokens": op10_tokens}
ORACLES: dict[str, str] = {}
