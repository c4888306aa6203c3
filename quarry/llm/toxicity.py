"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, takes compatibility forms apart, drops invisible marks,
turns look-alike letters of other scripts into Latin ones and digits or signs
that stand among letters into the letters they imitate.  All entries, which
begin where a word begins, are found in one pass; entries may be whole words
or stems.  A hit inside an exception phrase doesn't count.  The weights of the
hits are summed, normalised by the number of words, and a logistic curve gives
the score.

Learning: entries and their weights are log ratios of how often a word start
occurs in toxic and in other texts, lowered by their uncertainty; a longer
entry is kept only where it tells more than the shorter one.  Exception phrases are given, and
those around a hit that several texts have and no toxic one are learned.  All these and the
curve are fitted on at most ``SAMPLE`` labelled rows, the first in the order of
a hash of their id.  Nothing but the text enters a score.

Defined results: null text counts as empty; an empty text gets the score of a
text without hits or words; with no labelled rows, or none of one kind, the
lexicon is empty and every score is the share of toxic rows seen (0 if none).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, materialize, quoted, without

#: Labelled rows that a lexicon and its curve are fitted on, at most.
SAMPLE = 12_000
THRESHOLD = 0.7
#: Letters of a stem, least and most; a longer word is an entry as a whole.
STEM = (3, 16)
LEAST_DOCS, LEAST_WEIGHT = 3, 1.5
#: Texts, none of them toxic, that make a phrase around a hit an exception.
LEAST_HARMLESS = 5

# Letters of other scripts and what they look like.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ɪ": "i", "ʀ": "r",
}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
# Harmless phrases around words that are often in a lexicon.
EXCEPTIONS = ("trash can", "trash bin", "pond scum", "clown fish", "class clown", "loser bracket", "sore loser")

_TABLE = {ord(k): v for k, v in LOOK_ALIKES.items()} | dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_ODD = re.compile(f"[{''.join(LOOK_ALIKES)}\xad​-‍⁠﻿̀-ͯ①-ⓩ！-～\U0001d400-\U0001d7ff]")
_AMONG = re.compile(r"(?<=[^\W\d_])[0134578 9@$!|]{1,3}(?=[^\W\d_])".replace(" ", "") + r"|(?<![^\W_])[0134579@$]{1,2}(?=[^\W\d_][^\W_])")
_LETTERS = re.compile(r"[^\W\d_]+")
_AFTER = re.compile(r" [^\W\d_]+")


def fold(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii() and _ODD.search(text):
        text = unicodedata.normalize("NFKC", text).lower().translate(_TABLE)
    return _AMONG.sub(lambda m: "".join(map(SUBSTITUTES.__getitem__, m[0])), text)


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: Of the curve: constant, slopes of the features.
    curve: tuple[float, ...] = (-20.0, 0.0, 0.0, 0.0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "machine"}

    def automaton(self):
        import ahocorasick

        if "machine" not in self.__dict__:
            machine = ahocorasick.Automaton()
            for phrase in self.exceptions:
                machine.add_word(fold(phrase), (len(fold(phrase)), None))
            for entry, weight in self.weights.items():
                machine.add_word(entry, (len(entry), weight))
            if len(machine):
                machine.make_automaton()
            self.machine = machine
        return self.machine

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """Places and weights of the entries that begin a word outside the exceptions, in order; linear but for sorting."""
        machine, found, spans = self.automaton(), {}, []
        if len(machine):
            for end, (size, weight) in machine.iter(folded):
                start = end - size + 1
                if start and folded[start - 1].isalpha():
                    continue
                if weight is None:
                    if end + 1 == len(folded) or not folded[end + 1].isalpha():
                        spans.append((start, end))
                else:
                    found[start] = weight  # a longer entry at this place comes later
        spans.sort()
        out, k, reach = [], 0, -1  # reach: where the exceptions end that begin at or before a place
        for at in sorted(found):
            while k < len(spans) and spans[k][0] <= at:
                reach = max(reach, spans[k][1])
                k += 1
            if at > reach:
                out.append((at, found[at]))
        return out

    def measure(self, text: str | None) -> tuple[float, int, int]:
        """Weight of the hits, number of hits, number of words."""
        folded = fold(text)
        found = self.hits(folded)
        return sum(w for _, w in found), len(found), len(folded.split())

    def phrases(self, text: str | None) -> set[str]:
        """Words with a hit, each with the word before and with the word behind it."""
        folded, out = fold(text), set()
        for at, _ in self.hits(folded):
            end = _LETTERS.match(folded, at).end()
            if after := _AFTER.match(folded, end):
                out.add(folded[at : after.end()])
            if at > 1 and folded[at - 1] == " " and folded[at - 2].isalpha():
                start = at - 1
                while start and at - start < 40 and folded[start - 1].isalpha():
                    start -= 1
                out.add(folded[start:end])
        return out

    @staticmethod
    def features(weight, hits, words) -> np.ndarray:
        weight, hits, words = (np.asarray(x, float) for x in (weight, hits, words))
        rate = np.log((weight + 0.05) / (words + 10))
        return np.stack([np.ones_like(rate), rate, np.log(words + 10), np.log1p(weight)], axis=-1)

    def score(self, text: str | None) -> float:
        z = float(self.features(*self.measure(text)) @ np.array(self.curve))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> np.ndarray:
    """Logistic regression by damped Newton steps."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    centre[0], scale[scale < 1e-9] = 0, 1
    z, beta, hold = (x - centre) / scale, np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (y - p) - hold * beta)
        beta = beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    beta = beta / scale
    beta[0] -= centre @ beta - centre[0] * beta[0]
    return beta


def choose(counts: dict[str, tuple[float, float, int]], toxic_words: float, other_words: float) -> dict[str, float]:
    """Entries and weights from ``start -> (times in toxic texts, in others, toxic texts that have it)``."""
    chosen: dict[str, float] = {}
    for entry in sorted((k for k, v in counts.items() if v[2] >= LEAST_DOCS), key=lambda k: (len(k), k)):
        a, b, _ = counts[entry]
        bound = math.log((a + 0.5) / (toxic_words + 1)) - math.log((b + 0.5) / (other_words + 1)) - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        shorter = max((chosen[entry[:k]] for k in range(STEM[0], len(entry)) if entry[:k] in chosen), default=LEAST_WEIGHT - 0.5)
        if bound >= shorter + 0.5:
            chosen[entry] = bound
    letters = sorted({k[-1] for k in counts})
    whole: dict[str, float] = {}
    for entry, weight in chosen.items():
        # "idi" where nearly all that was seen is "idiot" becomes "idiot".
        while longer := [entry + c for c in letters if counts.get(entry + c, (0,))[0] >= 0.9 * counts[entry][0]]:
            entry = max(longer, key=lambda k: counts[k][0])
        whole[entry] = max(weight, whole.get(entry, weight))
    return whole


def sample(docs: DataFrame, labels: DataFrame, chosen: Column, *, text: str = "text", id: str = "doc_id", label: str = "toxic", size: int = SAMPLE) -> DataFrame:
    """``text, label`` of the labelled rows where ``chosen`` (over the id) holds, ``size`` at most."""
    picked = labels.where(chosen & F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("own_id"), (F.col(label) > 0).cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64(F.col("own_id").cast("string")), "own_id", "label").limit(size)
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("own_id")).select("text", "label")  # ``size`` rows


def learn(rows: DataFrame, exceptions: Iterable[str] = EXCEPTIONS) -> Lexicon:
    """A lexicon, further exceptions and its curve from rows ``text, label``, a bounded sample."""
    spark, rows = rows.sparkSession, materialize(rows)
    least, most = STEM

    def count():
        def own(batch: pa.RecordBatch) -> dict:
            times, texts, words = defaultdict(lambda: [0, 0]), Counter(), [0, 0]
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, starts = Counter(_LETTERS.findall(fold(t))), Counter()
                words[y] += sum(round(1000 * math.log2(1 + n)) for n in found.values())
                for w, n in found.items():
                    for k in {*range(least, min(len(w), most) + 1), *([len(w)] if len(w) > most else [])}:
                        starts[w[:k]] += n
                for s, n in starts.items():
                    times[s][y] += round(1000 * math.log2(1 + n))  # repeats within a text tell less and less
                if y:
                    texts.update(starts.keys())
            out = [(s, n[1], n[0], texts[s]) for s, n in times.items()] + [("", words[1], words[0], 0)]
            return dict(zip(("entry", "toxic", "other", "texts"), zip(*out, strict=True), strict=True))

        return own

    totals = map_batches(rows, "entry string, toxic bigint, other bigint, texts bigint", count).groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.sum("texts").alias("texts"))
    words = totals.where("entry = ''").first()
    if not words or not words.toxic or not words.other:
        share = rows.agg(F.avg("label")).first()[0] or 0.0
        return Lexicon(curve=(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0, 0.0))
    # What isn't three times as frequent in toxic texts can't become an entry.
    able = totals.where(f"entry <> '' and texts >= {LEAST_DOCS} and toxic * {words.other / 1000 + 1} >= 3 * other * {words.toxic / 1000 + 1}")
    weights = choose({r.entry: (r.toxic / 1000, r.other / 1000, r.texts) for r in able.toLocalIterator()}, words.toxic / 1000, words.other / 1000)
    lexicon = Lexicon(weights, exceptions=tuple(exceptions))
    heard = spark.sparkContext.broadcast(lexicon)

    def around():
        own = heard.value

        def one(batch: pa.RecordBatch) -> dict:
            found = [(p, int(y > 0)) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in own.phrases(t)]
            return {"phrase": [p for p, _ in found], "toxic": [y for _, y in found]}

        return one

    phrases = map_batches(rows, "phrase string, toxic bigint", around).groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("texts"))
    harmless = sorted(r.phrase for r in phrases.where(f"toxic = 0 and texts >= {LEAST_HARMLESS}").toLocalIterator())  # bounded by the sample
    lexicon = Lexicon(weights, exceptions=tuple(dict.fromkeys([*exceptions, *harmless])))
    sent = spark.sparkContext.broadcast(lexicon)

    def measure():
        own = sent.value
        return lambda batch: dict(zip(("weight", "hits", "words"), zip(*(own.measure(t.as_py()) for t in batch.column(0)), strict=True), strict=True)) | {"label": batch.column(1)}

    seen = map_batches(rows, "weight double, hits bigint, words bigint, label int", measure).toPandas()  # ``SAMPLE`` rows of four numbers
    seen = seen.sort_values(list(seen.columns))
    lexicon.curve = tuple(fit_curve(Lexicon.features(seen.weight, seen.hits, seen.words), seen.label.to_numpy(float)))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``THRESHOLD`` on); columns that bear these names, in any case, give way."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the sample
    others = without(docs.columns, score, predicted)
    place = others.index(text)
    schema = ", ".join(f"{quoted([f.name])[0]} {f.dataType.simpleString()}" for f in docs.select(quoted(others)).schema) + f", {quoted([score])[0]} double, {quoted([predicted])[0]} int"

    def make():
        own = sent.value

        def one(batch: pa.RecordBatch) -> dict:
            found = [own.score(t.as_py()) for t in batch.column(place)]
            return {n: batch.column(k) for k, n in enumerate(others)} | {score: found, predicted: [int(s >= THRESHOLD) for s in found]}

        return one

    return map_batches(docs.select(quoted(others)), schema, make)
