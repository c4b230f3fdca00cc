"""Language model scores by a weighted backoff automaton.

The states of the automaton are the empty context and one context per word; a state has an arc for each word seen
after its context, and a failure arc, with a weight, to the empty context, where every word has an arc. Scoring
reads a text once from left to right, carries the state, and adds the log-probabilities of the arcs it takes.

Weights come from counts over all training documents. With c the counts, N and V tokens and distinct tokens:
p(w) = (c(w) + 1) / (N + V + 1) for any word, and p(w | h) = (c(h w) + m p(w)) / (c(h) + m): the failure arc of h
weighs m / (c(h) + m), and an arc h -> w already holds its share of p(w). Probabilities of a state add up to one.
Every text ends with one end token; the first token is read from the empty context.

Counts grow with the corpus, so no task holds them all. Documents are dealt into blocks of some megabytes. A block
sends each shard of the codes the sorted distinct words and word pairs that it holds, compressed, with its own
training counts; a shard adds up all blocks and answers each block with the totals for what it asked, and the block
builds the part of the automaton that its documents can reach. Words and pairs are 64-bit codes.

Defined results: null and empty texts consist of the end token; rows that repeat an id are scored each and all
count in training; a document without an id is a training document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.llm.common import mixed, packed, power_of_two, shipped, unpacked, word_codes, words_of
from firmatlas.session import write_stage

PRIOR = 8.0  # m: weight of the shorter context, in tokens
BLOCK_BYTES, SHARD_CODES = 12 << 20, 1_500_000
END = np.uint64(0x1D8E4E27C47D124F)  # code of the end token; words are never empty, so nothing else means it
_LEFT, _PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def token_codes(text: bytes | None) -> np.ndarray:
    words = words_of(text) if text else []
    return np.append(word_codes(words), END)


def pair_codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * _LEFT + (right ^ _PAIR))


class Counted:
    """Sorted codes of a block with what the block and the corpus count."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes, self.counts = codes, counts

    def of(self, codes: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.codes, codes)]


def gathered(texts: list[bytes | None], training: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct words, and distinct pairs, of some texts with their counts in the training texts among them."""
    tokens = [token_codes(t) for t in texts]
    sizes = np.array([len(t) for t in tokens])
    every = np.concatenate(tokens)
    counted = np.repeat(training, sizes)
    last = np.cumsum(sizes) - 1
    inner = np.ones(len(every), dtype=bool)
    inner[last] = False
    left = np.flatnonzero(inner)
    out = []
    for codes, weight in ((every, counted), (pair_codes(every[left], every[left + 1]), counted[left])):
        distinct, at = np.unique(codes, return_inverse=True)
        out.append((distinct, np.bincount(at, weights=weight, minlength=len(distinct)).astype(np.int64)))
    return out


class Automaton:
    """The part of the backoff automaton that some documents reach; log10 weights."""

    def __init__(self, words: Counted, pairs: Counted, tokens: int, vocabulary: int, prior: float = PRIOR) -> None:
        self.words, self.pairs, self.prior = words, pairs, prior
        self.whole = tokens + vocabulary + 1.0
        self.log_word = np.log10((words.counts + 1) / self.whole)

    def read(self, tokens: np.ndarray) -> tuple[float, float, int]:
        """(score, sum of the words' own weights, known tokens) of one text, from left to right."""
        at = np.searchsorted(self.words.codes, tokens)
        own, alone = self.words.counts[at], self.log_word[at]
        seen = self.pairs.of(pair_codes(tokens[:-1], tokens[1:]))
        score = float(alone[0])  # the empty context
        prior, whole = self.prior, self.whole
        log = math.log10
        # state: the word read last, through its count; an arc where the pair was seen, else the failure arc
        for context, pair, word, weight in zip(own[:-1].tolist(), seen.tolist(), own[1:].tolist(), alone[1:].tolist(), strict=True):
            if pair:
                score += log((pair + prior * (word + 1) / whole) / (context + prior))
            elif context:
                score += log(prior / (context + prior)) + weight
            else:
                score += weight
        return score, float(alone.sum()), int((own > 0).sum())


def _asked(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    """What one block asks each shard: codes of words and pairs, and the block's training counts of them."""
    block = int(pdf["block"].iloc[0])
    both = gathered(list(pdf["text"]), (~pdf["held_out"].to_numpy(dtype=bool)).astype(np.int64))
    shift = np.uint64(64 - (shards.bit_length() - 1))
    rows: dict[int, list] = {}
    for kind, (codes, counts) in enumerate(both):
        shard = (codes >> shift).astype(np.int64)
        cuts = [*np.flatnonzero(np.diff(shard, prepend=-1)), len(codes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            row = rows.setdefault(int(shard[a]), [None, None, None, None])
            row[2 * kind : 2 * kind + 2] = packed(codes[a:b]), zstandard.compress(counts[a:b].astype(np.uint32).tobytes(), 1)
    return pd.DataFrame([(block, shard, *row) for shard, row in rows.items()], columns=["block", "shard", "words", "n_words", "pairs", "n_pairs"])


def _totals(codes: pd.Series, counts: pd.Series) -> tuple[list[bytes | None], np.ndarray]:
    """Totals over all blocks for what each block asked, in its order; and the totals themselves."""
    parts = [np.empty(0, np.uint64) if c is None else unpacked(c) for c in codes]
    own = [np.empty(0, np.int64) if c is None else np.frombuffer(zstandard.decompress(c), np.uint32).astype(np.int64) for c in counts]
    distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(own), minlength=len(distinct)).astype(np.int64)
    answers, start = [], 0
    for part in parts:
        answers.append(zstandard.compress(total[at[start : start + len(part)]].tobytes(), 1) if len(part) else None)
        start += len(part)
    return answers, total


def _answered(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: per block the totals, and once the shard's tokens and vocabulary."""
    words, total = _totals(pdf["words"], pdf["n_words"])
    pairs, _ = _totals(pdf["pairs"], pdf["n_pairs"])
    out = pdf[["block", "shard"]].assign(words=words, pairs=pairs, tokens=0, vocabulary=0)
    out.iloc[0, 4], out.iloc[0, 5] = int(total.sum()), int((total > 0).sum())
    return out


def _numbers(cells: pd.Series) -> np.ndarray:
    held = [np.frombuffer(zstandard.decompress(c), np.int64) for c in cells if c is not None]
    return np.concatenate([*held, np.empty(0, np.int64)])


def scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, shard_codes: int = SHARD_CODES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    read = shipped(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), held_out.alias("held_out"))
    volume = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-volume // block_bytes))
    shards = power_of_two(volume / 5 / shard_codes, 16)
    # rows of a block come from anywhere: the id and the text decide, so that a repeated id does not fill one block
    dealt = read.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))).repartition(min(n_blocks, 20_000), "block")
    asked = dealt.groupBy("block").applyInPandas(lambda pdf: _asked(pdf, shards), "block long, shard long, words binary, n_words binary, pairs binary, n_pairs binary")
    answer = "block long, shard long, words binary, pairs binary, tokens long, vocabulary long"
    answers = write_stage(asked.groupBy("shard").applyInPandas(_answered, answer), "model-answers")
    corpus = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
    tokens, vocabulary = int(corpus[0]), int(corpus[1])

    def block(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("shard")
        texts = list(pdf["text"])
        (words, _), (pairs, _) = gathered(texts, np.zeros(len(texts), np.int64)) if texts else ((np.empty(0, np.uint64),) * 2,) * 2
        machine = Automaton(Counted(words, _numbers(told["words"])), Counted(pairs, _numbers(told["pairs"])), tokens, vocabulary)
        rows = []
        for doc, out, data in zip(pdf["doc_id"].tolist(), pdf["held_out"].tolist(), texts, strict=True):
            codes = token_codes(data)
            score, base, known = machine.read(codes)
            rows.append((None if doc != doc else doc, out, len(codes), known, tokens, base, score))
        named = pd.DataFrame(rows, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return named.astype({"doc_id": "Int64"})

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(block, kind)
