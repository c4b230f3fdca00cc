"""URL filter: all glob rules at once, as one bit-parallel Shift-And automaton over the bytes of each canonical URL.

The canonical URL is a dot, the host with A-Z in lower case, the path and the query; the fragment is left out. The dot
lets ``.example.org/`` stand for the host and all its subdomains. In a rule ``*`` is any run of bytes without ``/`` and
``?``, ``**`` any run at all; every other byte, also ``?``, stands for itself. A rule covers the whole URL.

Each rule takes one bit for its start and one for each of its bytes, side by side in as many 64-bit words as the rules
need. A bit is set while its rule has been read that far. One byte of a URL moves all rules: shift, keep what the byte
allows next, and keep what may wait in a wildcard. The masks of a byte are rows of two tables, so the cost of a byte is
a few operations a word, whatever the rules are. Many URLs take the step together; those of above ``LONG_URL`` bytes
run alone, with the words joined into one integer.

Defined results: a null URL or one without ``://`` has an empty host, path and query, so the canonical URL is ``.``,
and only a rule that covers that can fit. Of the rules that fit, the one with the greatest ``rank`` decides, then the
earlier one; without one the verdict is the default and the rule null. Repeated rows are judged each. Other columns pass
through; one that has the name of a result is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.llm.common import shipped

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG_URL = 2048
STATE_BYTES = 8 << 20  # of the URLs that take a step together
WORD = 64


@dataclass(frozen=True)
class Rule:
    """``glob`` over the canonical URL, what it decides, how it is reported, and which of several wins."""

    glob: str
    verdict: str
    name: str | None = None
    rank: int = 0


def site_rule(host: str, path: str, verdict: str, rank: int = 1 << 20) -> Rule:
    """A host with its subdomains and a start of the path; the longer rule wins, and any of them over plain globs."""
    if "*" in host + path:
        raise ValueError("hosts and paths are taken as they are; give a Rule for wildcards")
    return Rule(f"*.{host}{path}**", verdict, host + path, rank + len(host + path))


class Automaton:
    """Masks of all rules. Bit ``i`` of ``step[c]``: byte c may be read into state i; of ``wait[c]``: state i may pass over c."""

    def __init__(self, globs: Sequence[str]) -> None:
        step, wait, start, accept = [0] * 256, [0] * 256, 0, []
        bit = 0
        for glob in globs:
            start |= 1 << bit
            literal = glob.encode()
            at = 0
            while at < len(literal):
                if literal[at : at + 1] == b"*":
                    any_byte = literal[at : at + 2] == b"**"
                    for c in range(256):
                        if any_byte or c not in b"/?":
                            wait[c] |= 1 << bit
                    at += 2 if any_byte else 1
                else:
                    bit += 1
                    step[literal[at]] |= 1 << bit
                    at += 1
            accept.append(bit)
            bit += 1
        self.words = max(1, -(-bit // WORD))
        self.start, self.accept = start, accept
        self.step_bits, self.wait_bits = step, wait
        self.step, self.wait = (np.array([self._split(x) for x in table], dtype=np.uint64) for table in (step, wait))

    def _split(self, bits: int) -> list[int]:
        return [bits >> WORD * w & (1 << WORD) - 1 for w in range(self.words)]

    def alone(self, url: bytes) -> int:
        """Set of states after one URL, its words joined."""
        state, step, wait = self.start, self.step_bits, self.wait_bits
        for c in url:
            state = state << 1 & step[c] | state & wait[c]
        return state

    def together(self, urls: list[bytes]) -> np.ndarray:
        """States after each URL, URLs x words. Longest first, so that those still running are the first rows."""
        size = np.fromiter(map(len, urls), dtype=np.int64, count=len(urls))
        order = np.argsort(-size, kind="stable")
        longest = int(size.max(initial=0))
        grid = np.zeros((len(urls), longest), dtype=np.uint8)
        grid[np.arange(longest) < size[order][:, None]] = np.frombuffer(b"".join(urls[i] for i in order), dtype=np.uint8)
        running = len(urls) - np.searchsorted(np.sort(size), np.arange(longest), side="right")
        state = np.tile(np.array(self._split(self.start), dtype=np.uint64), (len(urls), 1))
        one, top = np.uint64(1), np.uint64(WORD - 1)
        for at, n in enumerate(running):
            byte, now = grid[:n, at], state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top  # the carry from word to word
            state[:n] = moved & self.step[byte] | now & self.wait[byte]
        out = np.empty_like(state)
        out[order] = state
        return out

    def first_of(self, urls: list[bytes], priority: Sequence[int]) -> np.ndarray:
        """For each URL the first rule in ``priority`` that covers it, or -1."""
        found = np.full(len(urls), -1, dtype=np.int32)
        short = [i for i, u in enumerate(urls) if len(u) <= LONG_URL]
        most = max(1, STATE_BYTES // (8 * self.words + LONG_URL // 8))
        for a in range(0, len(short), most):
            rows = np.array(short[a : a + most])
            state = self.together([urls[i] for i in rows])
            for rule in reversed(priority):
                word, bit = divmod(self.accept[rule], WORD)
                found[rows[(state[:, word] >> np.uint64(bit)) & np.uint64(1) == 1]] = rule
        for i, url in enumerate(urls):
            if len(url) > LONG_URL:
                state = self.alone(url)
                found[i] = next((rule for rule in priority if state >> self.accept[rule] & 1), -1)
        return found


def split_url(url: Column) -> dict[str, Column]:
    """host, path and query: host up to ``/``, ``?`` or ``#``, path up to ``?`` or ``#``, query with its ``?`` up to ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return {
        "host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^?#]*([^#]*)", 1),
    }


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (the name of the rule that decided; null if it has none) and verdict."""
    priority = sorted(range(len(rules)), key=lambda i: -rules[i].rank)
    made: list[Automaton] = []

    @F.pandas_udf("int")
    def decides(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not made:
            made.append(Automaton([r.glob for r in rules]))
        for batch in urls:
            yield pd.Series(made[0].first_of(batch.tolist(), priority))

    parts = split_url(F.col(url))
    split = shipped(pages).withColumns({"host": parts["host"], "path": parts["path"], "_query": parts["query"]})
    judged = split.withColumn("_decided", decides(F.concat(F.lit("."), "host", "path", "_query").cast("binary")))

    def of_rule(values: list[str | None]) -> Column:  # the first place is for -1, no rule
        return F.element_at(F.array(*[F.lit(x).cast("string") for x in values]), F.col("_decided") + 2)

    return judged.withColumns(
        {"rule": of_rule([None, *[r.name for r in rules]]), "verdict": of_rule([default, *[r.verdict for r in rules]])}
    ).drop("_query", "_decided")
