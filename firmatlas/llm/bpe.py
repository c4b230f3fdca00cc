"""Byte-level BPE: encoding by longest matches with backtracking, and decoding.

A sequence of tokens is the merge result of its bytes exactly if each token is the merge result of its own
bytes and each neighbouring pair stays apart when its bytes are merged. So a text piece is encoded by taking
the longest token at a position and stepping back where a pair would have merged; a prefix has only one such
sequence, hence a position that failed once never needs another visit, and the work is linear in the piece.

A batch's different pieces are looked up once each. Those that are not remembered are encoded side by side: a walk
down the tree of tokens gives the longest token at each byte of all of them, then every round takes one step in each
piece. Long pieces take the same steps alone, with a pyahocorasick automaton over their bytes as Latin-1. Pair checks
are memoised. A piece that is a token as a whole is that token, as in the tiktoken library. Decoding takes the tokens
of all ids of a batch as one buffer and cuts it at the texts' borders.

Defined results: null and empty texts have no tokens; special tokens are ordinary text; repeated rows are
encoded each; other columns pass through, and one that has the name of the result is replaced.
"""

from __future__ import annotations

import base64
import functools
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from firmatlas.llm.common import rows_in_slices, shipped, with_column

PIECES_KEPT, PAIRS_KEPT, PIECE_BYTES = 250_000, 250_000, 64
GROUP, BORDER = 8192, 256  # pieces encoded side by side; the border is no byte, so no token reaches across it


class Codec:
    """One vocabulary with its pattern. ``ranks`` maps token bytes to ids; the id is the merge order."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces_kept: int = PIECES_KEPT) -> None:
        self.ranks, self.pieces_kept = ranks, pieces_kept
        self.pieces = regex.compile(pattern).findall
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        self.size = [0] * len(self.token)
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for data, rank in ranks.items():
            self.token[rank], self.size[rank] = data, len(data)
            self.matches.add_word(data.decode("latin-1"), rank)
        self.matches.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}
        self._sizes = np.array(self.size, dtype=np.int64)
        self._shorter_of = np.full(len(self.token), -2)
        # beginnings of tokens as a tree: (node, byte) -> node, in order of the keys, and the token that ends at a node
        node = {b"": 0}
        for data in ranks:
            for n in range(1, len(data) + 1):
                node.setdefault(data[:n], len(node))
        steps = sorted((node[p[:-1]] << 9 | p[-1], i) for p, i in node.items() if p)
        self._step_keys, self._step_nodes = np.array([*steps, (1 << 62, 0)], dtype=np.int64).T.copy()
        self._token_at = np.fromiter((ranks.get(p, -1) for p in node), dtype=np.int64, count=len(node))
        self._edges: dict[int, tuple] = {}
        self._known: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes, leave: int = 1) -> list[bytes]:
        """Plain merging, lowest rank and then leftmost first, down to ``leave`` parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > leave:
            rank, i = min((self.ranks.get(a + b, len(self.token)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.token):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edges(self, token: int) -> tuple:
        """(stable, left, right): the parts that stand at its left and right end while a token is being merged,
        each with the rank at which the next part takes its place."""
        known = self._edges.get(token)
        if known is None:
            data, last = self.token[token], len(self.token)
            parts = self.merged(data, 2)
            if len(data) == 1:
                known = (True, [(data, last)], [(data, last)])
            elif len(parts) != 2:
                known = (False, [], [])
            else:
                grown = [self.edges(self.ranks[p]) for p in parts]
                left = [*grown[0][1][:-1], (parts[0], token), (data, last)]
                right = [*grown[1][2][:-1], (parts[1], token), (data, last)]
                ascending = all(self.ranks[p] < until for p, until in left + right) and grown[0][0] and grown[1][0]
                known = (True, left, right) if ascending else (self.merged(data) == [data], [], [])
            self._edges[token] = known
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens gives these two tokens again.

        It does unless the parts at the common border merge with each other before either merges away from it.
        """
        right, left = self.edges(a)[2], self.edges(b)[1]
        if not right or not left:
            return self.merged(self.token[a] + self.token[b]) == [self.token[a], self.token[b]]
        rank_of, last = self.ranks.get, len(self.token)
        for x, until_x in right:
            for y, until_y in left:
                rank = rank_of(x + y, last)
                if rank < until_x and rank <= until_y and rank != last:
                    return False
        return True

    def shorter(self, token: int) -> int:
        """The longest stable token that is a proper prefix of this one, or -1."""
        known = self._shorter.get(token)
        if known is None:
            data, known = self.token[token], -1
            for n in range(len(data) - 1, 0, -1):
                rank = self.ranks.get(data[:n])
                if rank is not None and self.edges(rank)[0]:
                    known = rank
                    break
            self._shorter[token] = known
        return known

    def apart(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a``; -1 stands for the start of a piece."""
        if len(self._pairs) >= PAIRS_KEPT:
            self._pairs.clear()
        known = self._pairs[a << 32 | b] = self.edges(b)[0] and (a < 0 or self.edges(a)[0] and self.stay_apart(a, b))
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        alone = self.ranks.get(piece)
        if alone is not None:
            return (alone,)
        latin = piece.decode("latin-1")
        total, size, pairs, shorter = len(latin), self.size, self._pairs, self._shorter
        longest = [-1] * (total + 1)
        for end, token in self.matches.iter(latin):
            longest[end - size[token] + 1] = token  # ends ascend, so the longest one stays
        failed: set[int] = set()
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        while at < total:
            while token >= 0:
                end = at + size[token]
                if end not in failed:
                    if before < 0:
                        fits = self.edges(token)[0]
                    else:
                        fits = pairs.get(before << 32 | token)
                        if fits is None:
                            fits = self.apart(before, token)
                    if fits:
                        break
                step = shorter.get(token)
                token = self.shorter(token) if step is None else step
            if token >= 0:
                out.append(token)
                at, before, token = end, token, longest[end]
            elif out:
                failed.add(at)
                last = out.pop()
                at -= size[last]
                before = out[-1] if out else -1
                token = self.shorter(last)
            else:
                raise ValueError(f"the vocabulary cannot express {piece[:40]!r}")
        return tuple(out)

    def _may_follow(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        keys = (before << 32 | tokens).tolist()
        known = np.fromiter(map(self._pairs.get, keys, repeat(-1)), dtype=np.int8, count=len(keys))
        for i in np.flatnonzero(known < 0):
            known[i] = self.apart(int(before[i]), int(tokens[i]))
        return known == 1

    def _longest(self, codes: np.ndarray) -> np.ndarray:
        """The longest token that begins at each byte, -1 at borders."""
        longest = np.full(len(codes), -1)
        at = np.arange(len(codes))
        node, done = np.zeros_like(at), 0
        while len(at):
            keys = node << 9 | codes[at + done]
            place = np.searchsorted(self._step_keys, keys)
            hit = np.flatnonzero(self._step_keys[place] == keys)
            at, node, done = at[hit], self._step_nodes[place[hit]], done + 1
            token = self._token_at[node]
            ends = np.flatnonzero(token >= 0)
            longest[at[ends]] = token[ends]
        return longest

    def _shorter_ones(self, tokens: np.ndarray) -> np.ndarray:
        for token in np.unique(tokens[self._shorter_of[tokens] == -2]):
            self._shorter_of[token] = self.shorter(int(token))
        return self._shorter_of[tokens]

    def encode_side_by_side(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """As ``encode_piece``, for many short pieces: every round takes one step in each of them."""
        data = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        stops = np.cumsum(lengths + 1) - 1
        starts = stops - lengths
        codes = np.full(int(stops[-1]) + 1, BORDER)
        codes[np.delete(np.arange(len(codes)), stops)] = np.frombuffer(b"".join(data), dtype=np.uint8)
        longest = self._longest(codes)
        at, depth, token, before = starts.copy(), np.zeros_like(starts), longest[starts], np.full(len(data), -1)
        out, failed = np.empty(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=bool)
        live = np.flatnonzero(at < stops)
        while len(live):
            tried = live[token[live] >= 0]
            back = live[token[live] < 0]
            t = token[tried]
            end = at[tried] + self._sizes[t]
            fits = ~failed[end]
            fits[fits] = self._may_follow(before[tried][fits], t[fits])
            on, off, t_on, end = tried[fits], tried[~fits], t[fits], end[fits]
            out[starts[on] + depth[on]] = before[on] = t_on
            depth[on] += 1
            at[on], token[on] = end, longest[end]
            token[off] = self._shorter_ones(t[~fits])
            if len(back):
                if not depth[back].all():
                    raise ValueError(f"the vocabulary cannot express {pieces[back[depth[back] == 0][0]]!r}")
                failed[at[back]] = True
                depth[back] -= 1
                top = starts[back] + depth[back]
                at[back] -= self._sizes[out[top]]
                before[back] = np.where(depth[back] > 0, out[top - 1], -1)
                token[back] = self._shorter_ones(out[top])
            live = live[at[live] < stops[live]]
        ids = out.tolist()
        return [tuple(ids[a : a + n]) for a, n in zip(starts.tolist(), depth.tolist(), strict=True)]

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        whole = [self.ranks.get(p.encode()) for p in pieces]
        found = [None if rank is None else (rank,) for rank in whole]
        short = [i for i, (p, rank) in enumerate(zip(pieces, whole, strict=True)) if rank is None and len(p) <= PIECE_BYTES]
        for first in range(0, len(short), GROUP):
            group = short[first : first + GROUP]
            for i, ids in zip(group, self.encode_side_by_side([pieces[i] for i in group]), strict=True):
                found[i] = ids
        return [self.encode_piece(p.encode()) if ids is None else ids for p, ids in zip(pieces, found, strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[1].tolist()

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all texts one after the other, as (border of each text, ids).

        Each different piece is looked up once; the ids of its repetitions are copied by numpy.
        """
        split = [self.pieces(t) if t else [] for t in texts]
        pieces = list(chain.from_iterable(split))
        number: dict[str, int] = defaultdict(count().__next__)
        numbers = np.fromiter(map(number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        known = self._known
        found = list(map(known.get, number))
        new = [(i, piece) for i, piece in enumerate(number) if found[i] is None]
        for (i, piece), ids in zip(new, self.encode_pieces([piece for _, piece in new]), strict=True):
            found[i] = ids
            if len(piece) <= PIECE_BYTES and len(known) < self.pieces_kept:
                known[piece] = ids
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        each = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))
        lengths = sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        starts = (np.cumsum(sizes) - sizes)[numbers] - ends[:-1]
        ids = each[np.repeat(starts, lengths) + np.arange(ends[-1])]
        return ends[np.cumsum([0, *map(len, split)])], ids


def listed(borders: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(borders, type=pa.int32()), pa.array(ids, type=pa.int32()))


def bytes_of(ids: pa.ListArray, tokens: pa.BinaryArray) -> pa.BinaryArray:
    """The bytes that each list of ids stands for; a null list has none. Joined tokens are one buffer, cut at the lists' borders."""
    joined = tokens.take(ids.flatten())
    if joined.null_count:
        raise KeyError("an id is not in the vocabulary")
    if not len(joined):
        return pa.array([b""] * len(ids), type=pa.binary())
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    at = np.frombuffer(joined.buffers()[1], dtype=np.int32)[np.concatenate([[0], np.cumsum(lengths)])]
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.tobytes()), joined.buffers()[2]])


def ranks_in(path: str) -> dict[bytes, int]:
    """A vocabulary file: token in base64 and rank on each line. It is installed on every machine."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str, pieces_kept: int = PIECES_KEPT) -> Codec:
    """One codec per worker process and vocabulary file."""
    return Codec(ranks_in(path), pattern, pieces_kept)


@functools.lru_cache(maxsize=2)
def tokens_by_id(path: str) -> pa.BinaryArray:
    """Tokens at their ids; null where the vocabulary has none."""
    token = {rank: data for data, rank in ranks_in(path).items()}
    return pa.array([token.get(rank) for rank in range(max(token, default=-1) + 1)], type=pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for batch in rows_in_slices(batches, text):
            yield with_column(batch, out, listed(*made.encode_all(batch.column(text).to_pylist())))

    return shipped(docs).mapInArrow(run, _with(docs, out, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_by_id(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                yield with_column(part, out, bytes_of(part.column(ids), tokens))

    return shipped(docs).mapInArrow(run, _with(docs, out, T.BinaryType()))


def round_trip(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", pieces_kept: int = 50_000, drop: tuple[str, ...] = ()
) -> DataFrame:
    """``docs`` with the token ids of each text and the bytes that they stand for, in one pass: half the Python workers.

    In the pipeline it runs after other operators, whose memory in the same workers goes back first, and remembers fewer
    pieces. Spark prunes no columns behind the Python workers: what nobody reads is named in ``drop`` and stays there.
    """
    kept = T.StructType([f for f in docs.schema.fields if f.name not in drop])
    names = kept.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        made, tokens = codec(path, pattern, pieces_kept), tokens_by_id(path)
        for batch in rows_in_slices(batches, text, 1 << 20):
            rows = listed(*made.encode_all(batch.column(text).to_pylist()))
            yield with_column(with_column(batch.select(names), ids, rows), decoded, bytes_of(rows, tokens))

    return shipped(docs).mapInArrow(run, _with(_with(kept, ids, T.ArrayType(T.IntegerType())), decoded, T.BinaryType()))


def _with(docs: DataFrame | T.StructType, name: str, kind: T.DataType) -> T.StructType:
    fields = docs.fields if isinstance(docs, T.StructType) else docs.schema.fields
    return T.StructType([f for f in fields if f.name != name] + [T.StructField(name, kind)])
