"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of symbols: insult stems (found by one Aho-Corasick pass), threat verbs, words for a
target, negations, verbs of reported speech, quotation marks. Small transducers rewrite that string one after the
other (their composition): negation and reported speech mark the insults and threats in their scope, a target
marks those beside it, and a threat needs an announcing word and a target. What is left is one matched clause with
a kind and a weight. A document's evidence is the sum of -log(1 - weight) over its clauses; a logistic curve, fitted
on the labelled sample, turns it into the score.

Stems come with seeds and are otherwise learned from labelled rows: beginnings of words that are far more frequent
in toxic texts. Weights of the kinds are shares of toxic rows, drawn towards the grammar's own weights. Both use a
bounded sample (``SAMPLE_ROWS`` rows with the smallest text hash, equal texts once); scoring reads whole texts.

Defined results: null and empty texts, and texts without a matched clause, get the curve's value at no evidence;
without any labels, seeds, the grammar's weights and a standing curve remain. Repeated rows are each
scored; other columns pass through, and those with the names of the results are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmatlas.llm.common import rows_in_slices, shipped, with_column

SAMPLE_ROWS, STEMS_KEPT, SEED_WEIGHT = 8000, 4000, 0.8
STEM_LENGTHS = (4, 5, 6, 7, 8)

# fixed values: words of the grammar, per symbol, for English, German, French and Spanish
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown vollidiot dummkopf abschaum crétin connard imbécile estúpido imbécil basura".split()
THREATS = "kill hurt destroy beat stab shoot töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()
ANNOUNCE = "will shall gonna going should must werde wird sollte vais va dois voy debería".split()
TARGETS = "you your yours he she they them him her his their these those du dich dir dein ihr euch sie er tu toi vous ton votre ils elles tú usted vosotros ustedes ellos ellas".split()
NEGATIONS = "not no never isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says called wrote quoted reported told sagte sagt nannte schrieb dit écrit appelé dijo dice llamó escribió".split()

#: What the grammar itself holds of a kind of clause, before any labels are seen.
KINDS = {"insult": 0.75, "insult_target": 0.9, "insult_negated": 0.3, "insult_reported": 0.35, "threat": 0.9, "threat_negated": 0.25, "threat_reported": 0.35}
PULL = 10  # labelled rows that the grammar's own weight counts as

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")
BORDERS = ".!?;\n"
_BORDER = re.compile(f"[{BORDERS}]")


@dataclass(frozen=True)
class Transducer:
    """States and arcs (state, symbol) -> (state, output); without an arc a symbol passes and the state stays."""

    arcs: dict[tuple[str, str], tuple[str, str]]
    backwards: bool = False
    fades: int = 0  # symbols after which the state falls back to the first one

    def run(self, symbols: list[str]) -> list[str]:
        state, age, out = "start", 0, []
        for symbol in reversed(symbols) if self.backwards else symbols:
            nxt, written = self.arcs.get((state, symbol), (state, symbol))
            age = age + 1 if nxt == state else 0
            state = "start" if self.fades and age >= self.fades else nxt
            out.append(written)
        return out[::-1] if self.backwards else out


def _scope(opener: str, mark: str, hits: tuple[str, ...], **more) -> Transducer:
    """After ``opener``, hits are marked."""
    arcs = {("start", opener): ("open", opener)} | {("open", h): ("open", f"{h}_{mark}") for h in hits}
    return Transducer(arcs, **more)


_MARKED = ("insult", "threat", "insult_negated", "threat_negated")
GRAMMAR = (
    # a threat verb counts after an announcing word, and if a target stands on either side
    Transducer({("start", "announce"): ("open", "announce"), ("open", "hurt"): ("open", "threat?")}, fades=4),
    Transducer({("start", "target"): ("seen", "target"), ("seen", "threat?"): ("seen", "threat")}, fades=8),
    Transducer({("start", "target"): ("seen", "target"), ("seen", "threat?"): ("seen", "threat")}, backwards=True, fades=8),
    _scope("negation", "negated", ("insult", "threat"), fades=3),
    # what follows a verb of saying, or stands between quotation marks, is reported
    Transducer(
        {("start", "report"): ("open", "report"), ("start", "quote"): ("quoted", "quote"), ("open", "quote"): ("quoted", "quote"), ("quoted", "quote"): ("start", "quote")}
        | {(state, hit): (state, f"{hit.split('_')[0]}_reported") for state in ("open", "quoted") for hit in _MARKED}
    ),
    _scope("target", "target", ("insult",), fades=6),
    _scope("target", "target", ("insult",), backwards=True, fades=6),
)


def lower_alike(text: str) -> str:
    """Lower case of the same length, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Grammar:
    """Stems with weights, weights of the clause kinds, and the curve from evidence to score (offset, slope)."""

    stems: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, SEED_WEIGHT))
    kinds: dict[str, float] = field(default_factory=lambda: dict(KINDS))
    curve: tuple[float, float] = (-3.0, 3.0)

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """A grammar ready to read texts; built once per task."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        self.starts = ahocorasick.Automaton()
        for stem in [*grammar.stems, *THREATS]:
            self.starts.add_word(stem, stem)
        self.starts.make_automaton()
        groups = (("hurt", THREATS), ("announce", ANNOUNCE), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS))
        self.symbols = {word: symbol for symbol, words in groups for word in words}

    def symbol(self, word: str, insults: dict[int, str], at: int) -> str:
        if at in insults:
            return "insult"
        return "quote" if len(word) == 1 and not word.isalpha() else self.symbols.get(word, "other")

    def clauses(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, weight) of each matched clause, in order."""
        low = lower_alike(text)
        insults: dict[int, str] = {}
        spots = []
        for end, stem in self.starts.iter(low):
            at = end - len(stem) + 1
            if at and low[at - 1].isalpha():
                continue
            spots.append(at)
            if stem in self.grammar.stems and len(stem) > len(insults.get(at, "")):
                insults[at] = stem
        found, until = [], -1
        for at in sorted(spots):
            if at < until:
                continue
            # the whole clause; what lies before the end of the last one is not looked at again
            start = max(low.rfind(border, max(until, 0), at) for border in BORDERS) + 1
            stop = _BORDER.search(low, at)
            until = stop.start() if stop else len(low)
            words = [(m.start(), m[0]) for m in _TOKEN.finditer(low, start, until)]
            symbols = [self.symbol(word, insults, i) for i, word in words]
            for machine in GRAMMAR:
                symbols = machine.run(symbols)
            for (i, word), symbol in zip(words, symbols, strict=True):
                if symbol in self.grammar.kinds:
                    weight = self.grammar.kinds[symbol] * (self.grammar.stems[insults[i]] if i in insults else 1)
                    found.append((i, i + len(word), symbol, weight))
        return found

    def score(self, clauses: list[tuple[int, int, str, float]]) -> float:
        offset, slope = self.grammar.curve
        return 1 / (1 + math.exp(-min(30.0, offset + slope * evidence(clauses))))


def evidence(clauses: list[tuple[int, int, str, float]]) -> float:
    return -sum(math.log(1 - min(weight, 0.999)) for *_, weight in clauses)


def fit_curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic curve through (evidence, toxic rows, rows), with a few made-up rows that keep it rising."""
    x, bad, n = (np.array(v, dtype=float) for v in zip(*points, (0.0, 0, 2), (2.0, 2, 2), strict=True))
    beta, design = np.zeros(2), np.stack([np.ones_like(x), np.minimum(x, 12)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -30, 30)))
        slope = design @ (bad - n * p) - 0.01 * beta
        bend = (design * (n * p * (1 - p))) @ design.T + 0.01 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(bend, slope), -1, 1)
    return float(beta[0]), float(max(beta[1], 0.0))


CLAUSES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("weight", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("weight", pa.float64())]))


def score(docs: DataFrame, grammar: Grammar, text: str = "text", out: str = "toxicity", clauses: str | None = "toxic_clauses", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the score of each whole text and its matched clauses (None: without them).

    Spark prunes no columns behind the Python workers: what nobody reads is named in ``drop`` and stays there.
    """
    kept = [f for f in docs.schema.fields if f.name not in (out, clauses, *drop)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = grammar.reader()
        for batch in rows_in_slices(batches, text):
            found = [reader.clauses(t) if t else [] for t in batch.column(text).to_pylist()]
            done = with_column(batch.select(names), out, pa.array([reader.score(c) for c in found], type=pa.float64()))
            if clauses is not None:
                listed = pa.array([[dict(zip(("start", "end", "kind", "weight"), c, strict=True)) for c in cs] for cs in found], type=_ARROW)
                done = with_column(done, clauses, listed)
            yield done

    more = [T.StructField(out, T.DoubleType())] + ([T.StructField(clauses, CLAUSES)] if clauses is not None else [])
    return shipped(docs).mapInArrow(run, T.StructType([*kept, *more]))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """Stems and weights from labelled rows. The sample is bounded, so its ids are sent to all executors."""
    marked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("y"))
    ids = marked.orderBy(F.xxhash64(doc_id), doc_id).limit(sample_rows)
    rows = docs.select(doc_id, F.col(text).alias("t")).join(F.broadcast(ids), doc_id)
    rows = rows.where("t is not null").groupBy(F.xxhash64("t").alias("h")).agg(F.first("t").alias("t"), F.max("y").alias("y"))
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")).first()
    n, bad = int(totals["n"]), int(totals["bad"])
    grammar = Grammar()
    if not bad or bad == n:
        return grammar
    words = F.array_distinct(F.split(F.lower("t"), r"[^\p{L}]+"))
    stems = F.flatten(F.transform(words, lambda w: F.transform(F.array(*[F.lit(k) for k in STEM_LENGTHS]), lambda k: F.substring(w, F.lit(1), k))))
    each = rows.select("y", F.explode(F.array_distinct(F.filter(stems, lambda s: F.length(s) >= STEM_LENGTHS[0]))).alias("stem"))
    counted = each.groupBy("stem").agg(F.sum("y").alias("in_bad"), F.count("*").alias("seen"))
    odds = F.log((F.col("in_bad") + 0.5) / (bad + 1)) - F.log((F.col("seen") - F.col("in_bad") + 0.5) / (n - bad + 1))
    # beyond chance: so many toxic rows among those that have the stem
    chance = F.lit(bad / n)
    surprise = (F.col("in_bad") - F.col("seen") * chance) / F.sqrt(F.col("seen") * chance * (1 - chance))
    least = max(3, round(0.004 * bad))
    kept = counted.where((F.col("in_bad") >= least) & (odds >= 3) & (surprise >= 5)).orderBy(F.desc("in_bad"), "stem").limit(STEMS_KEPT).collect()
    learned = {r["stem"]: (r["in_bad"] + 0.5) / (r["seen"] + 1) for r in kept}
    shortest = {s: w for s, w in learned.items() if not any(s[:k] in learned for k in STEM_LENGTHS if k < len(s))}
    seeds = {s: w for s, w in grammar.stems.items() if not any(s.startswith(x) for x in shortest)}
    grammar = replace(grammar, stems=seeds | shortest)
    matched = score(rows, grammar, "t", "s", "c", drop=("h", "t"))
    kinds = F.array_distinct(F.transform("c", lambda c: c["kind"]))
    matched = matched.persist()
    seen = matched.select("y", F.explode(F.when(F.size("c") > 0, kinds).otherwise(F.array(F.lit("")))).alias("kind"))
    shares = {r["kind"]: (int(r["bad"]), int(r["n"])) for r in seen.groupBy("kind").agg(F.sum("y").alias("bad"), F.count("*").alias("n")).collect()}
    weights = {k: (shares.get(k, (0, 0))[0] + PULL * w) / (shares.get(k, (0, 0))[1] + PULL) for k, w in KINDS.items()}
    grammar = replace(grammar, kinds=weights)
    # the clauses' own weights hold the former kind weights: put the learned ones in their place
    ratio = F.create_map(*[F.lit(v) for k in KINDS for v in (k, weights[k] / KINDS[k])])
    told = F.aggregate("c", F.lit(0.0), lambda acc, c: acc - F.log(1 - F.least(c["weight"] * ratio[c["kind"]], F.lit(0.999))))
    points = matched.groupBy(F.round(told, 1).alias("x")).agg(F.sum("y").alias("bad"), F.count("*").alias("n")).orderBy("x").collect()
    matched.unpersist()
    return replace(grammar, curve=fit_curve([(r["x"], int(r["bad"]), int(r["n"])) for r in points]))
