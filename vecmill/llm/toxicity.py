"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits and signs that stand for letters) and matched by one Aho-Corasick automaton that holds the lexicon's stems and
words and the exception phrases.  A hit inside an exception phrase does not count.
The weighted hits, as such and by length, give the score through a logistic curve.

The lexicon, its weights, the exceptions and the curve are learned from labelled
rows: stems and words frequent in toxic rows and rare in clean ones, chosen by a
greedy cover of the toxic rows, so that words which merely come along with copies of
one toxic text are left out.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved

# Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
# Letters whose plain form is no decomposition (fixed values).
BARE = {"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe"}
# Digits and signs that stand for letters (fixed values).
SUBSTITUTES = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "l"}


class Folding(dict):
    """Code point to folded text, for ``str.translate``; filled as characters occur.

    ``l`` and ``i`` fold to one letter, since ``1``, ``!`` and ``|`` stand for either.
    Accents stay, or go with ``bare``."""

    def __init__(self, bare: bool):
        self.form, self.bare = "NFKD" if bare else "NFKC", bare

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize(self.form, chr(code)).lower():
            c = LOOKALIKES.get(c, SUBSTITUTES.get(c, c))
            c = BARE.get(c, c) if self.bare else c
            kind = unicodedata.category(c[0])
            if kind[0] == "M" or kind in ("Cf", "Cc") and not c.isspace():
                continue
            out += c.replace("l", "i") if c.isalnum() else " "
        self[code] = out
        return out


class Folder:
    def __init__(self):
        import re

        self.table, self.bare = Folding(False), Folding(True)
        # A sign counts as a letter only before a letter; else it ends the word.
        self.sign = re.compile(r"[@$|](?!\w)|!(?!\w)|(?<!\w)!")

    def __call__(self, text: str, bare: bool = False) -> str:
        """Folded text between two spaces; other signs become spaces."""
        if "!" in text or "$" in text or "@" in text or "|" in text:
            text = self.sign.sub(" ", text).replace("!", "i")
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return f" {text.translate(self.bare if bare else self.table)} "


@dataclass
class ToxicityModel:
    """A fitted lexicon.  Entries begin with a space; one that ends with a space is a
    whole word, another a stem."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -4.0
    slopes: tuple[float, ...] = (0.0, 0.0, 0.0)

    def automaton(self, bare: bool = False):
        """All entries, or with ``bare`` the whole words without accents."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            if not bare or term.isascii() and term.endswith(" "):
                a.add_word(term, (len(term), w))
        for phrase in self.exceptions if len(a) else ():
            if phrase not in self.weights:
                a.add_word(phrase, (len(phrase), None))
        if len(a):
            a.make_automaton()
        return a if len(a) else None

    def scores(self, found: np.ndarray) -> np.ndarray:
        x = self.bias + _features(found) @ np.array(self.slopes)
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _features(found: np.ndarray) -> np.ndarray:
    """From (summed weight, greatest weight, words) of each text: all hits, hits by
    length, and the strongest hit."""
    mass, most, words = found.T
    return np.stack([np.log1p(mass), np.minimum(100 * mass / (words + 100), 50), most], 1)


def hits(automaton, folded: str) -> dict[int, float]:
    """Weight of each hit outside exception phrases, by its place, one per word."""
    best: dict[int, float] = {}
    spans = []
    for end, (size, w) in automaton.iter(folded) if automaton is not None else ():
        start = end - size + 1
        if w is None:
            spans.append((start, end))
        elif best.get(start, 0.0) < w:
            best[start] = w
    return {s: w for s, w in best.items() if not any(a <= s < b for a, b in spans)}


def _read(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Summed and greatest weight of the hits and the number of words of each text.

    A text with other than ASCII letters is also read without accents, for entries
    that are whole words without any: an accent may be a disguise."""
    fold, automaton, plain = Folder(), model.automaton(), model.automaton(bare=True)
    for batch in batches:
        out = np.zeros((batch.num_rows, 3))
        for i, text in enumerate(batch.column(1)):
            text = text.as_py() or ""
            folded = fold(text)
            own = list(hits(automaton, folded).values())
            if plain is not None and not text.isascii():
                own = max(own, list(hits(plain, fold(text, True)).values()), key=math.fsum)
            out[i] = math.fsum(own), max(own, default=0.0), folded.count(" ")
        yield batch, out


def score_texts(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Score every whole text, without a shuffle: ``doc_id, score, predicted, hit_weight``.

    Null and empty texts get the score of a text without hits; a null id stays null;
    repeated rows stay; other columns are ignored; an empty table gives an empty result;
    a very long text is read once from end to end."""

    def run(batches):
        for batch, found in _read(batches, model):
            s = model.scores(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(found[:, 0].copy())], names=["doc_id", "score", "predicted", "hit_weight"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, hit_weight double")


def _terms(words: list[str], shortest: int, longest: int) -> set[str]:
    """Whole words and stems of a document, each with its marks of word ends."""
    out = {f" {w} " for w in words if len(w) >= shortest}
    out.update(f" {w[:k]}" for w in words for k in range(shortest, min(len(w), longest + 1)))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_toxic: int = 4000, fit_clean: int = 8000, stem: tuple[int, int] = (4, 8), odds: float = 1.2, seed: int = 17) -> ToxicityModel:
    """Learn a model from labelled rows.

    At most ``fit_toxic`` toxic and ``fit_clean`` clean rows are used, those with the
    least hash of their id: a classifier's bounded sample.  Terms are counted where the
    rows are; the driver sees only terms that pass ``odds`` (lower bound of the
    log-odds of document frequency) and three numbers per sampled row.  Null ids and labels are left out,
    of equal ids one label counts.  Without toxic or clean rows the lexicon is empty.
    """
    marked = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic")).dropna()
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda flag, n: marked.where(F.col("toxic") == flag).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
    chosen = pick(1, fit_toxic).unionByName(pick(0, fit_clean))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # The chosen ids are bounded by the two parameters, hence the broadcast.
    sample = rows.join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull()).select("doc_id", "text", "toxic")

    def fold_rows(batches):
        fold = Folder()
        for batch in batches:
            folded = [fold(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(folded), pa.array([sorted(set(f.split())) for f in folded], pa.list_(pa.string()))], names=["doc_id", "toxic", "folded", "words"])

    sample = saved(sample.mapInArrow(fold_rows, "doc_id long, toxic int, folded string, words array<string>"))
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel()
    least = max(4, n1 // 300)
    lo, hi = stem

    def term_counts(flag: int, among: set[str] | None) -> dict[str, int]:
        def run(batches):
            found: Counter[str] = Counter()
            for batch in batches:
                for words in batch.column(0):
                    terms = _terms(words.as_py(), lo, hi)
                    found.update(terms if among is None else terms & among)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

        counts = sample.where(F.col("toxic") == flag).select("words").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        return {r.term: r.n for r in (counts.where(F.col("n") >= least) if among is None else counts).collect()}

    def log_odds(term: str) -> float:
        """Lower end of a 90 % interval, so rare terms weigh little."""
        x, y = toxic[term] + 0.5, clean.get(term, 0) + 0.5
        return math.log(x / (n1 + 1)) - math.log(y / (n0 + 1)) - 1.64 * math.sqrt(1 / x + 1 / y)

    toxic = term_counts(1, None)
    clean = term_counts(0, set(toxic))
    kept = {t: log_odds(t) for t in toxic if log_odds(t) >= odds}

    def incidence(batches):
        own = set(kept)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_terms(w.as_py(), lo, hi) & own) for w in batch.column(0)], pa.list_(pa.string()))], names=["terms"])

    covers: dict[str, set[int]] = {t: set() for t in kept}
    for i, r in enumerate(sample.where(F.col("toxic") == 1).select("words").mapInArrow(incidence, "terms array<string>").collect()):
        for t in r.terms:
            covers[t].add(i)
    model = ToxicityModel({t: kept[t] for t in _cover(covers, n1, kept)})
    model.exceptions = _exceptions(sample, model)

    def measure(batches):
        for batch, found in _read(batches, model):
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.copy()) for c in found.T)], names=["toxic", "mass", "most", "words"])

    got = sample.select("toxic", F.col("folded").alias("text")).mapInArrow(measure, "toxic int, mass double, most double, words double").toPandas()
    _calibrate(model, got["toxic"].to_numpy(), got[["mass", "most", "words"]].to_numpy())
    return model


def _cover(rows: dict[str, set[int]], n: int, odds: dict[str, float]) -> list[str]:
    """Greedy cover: the term whose rows are least explained so far, times its log-odds,
    comes next.

    A row counts half as much with every chosen term it has, so all of several terms
    that toxic rows share at random are found, while words that occur only together
    with chosen ones, as in copies of one text, gain nothing."""
    weight, chosen = np.ones(n), []
    least = max(1.5, n / 600)
    members = {t: np.fromiter(c, np.int64, len(c)) for t, c in rows.items()}
    gain = {t: len(c) * odds[t] for t, c in rows.items()}
    while gain:
        term = max(gain, key=lambda t: (gain[t], len(rows[t]), len(t), t))
        left = float(weight[members[term]].sum())
        if left < least:
            del gain[term]
        elif left * odds[term] < gain[term] - 1e-9:  # gains only fall: look again when it comes up
            gain[term] = left * odds[term]
        else:
            del gain[term]
            stem = term.rstrip()
            inside = any(stem.startswith(c) for c in chosen if not c.endswith(" "))
            around = any(c.startswith(stem) and len(rows[c]) >= 0.9 * len(rows[term]) for c in chosen)
            if not inside and not around:
                chosen.append(term)
                weight[members[term]] *= 0.5
    return chosen


def _exceptions(sample: DataFrame, model: ToxicityModel, least: int = 3) -> list[str]:
    """Two-word phrases around a hit that clean rows have, and toxic rows never."""

    def run(batches):
        automaton = model.automaton()
        found: Counter[tuple[str, int]] = Counter()
        for batch in batches if automaton is not None else ():
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set()
                for end, (size, _) in automaton.iter(text):
                    start = end - size + 1
                    stop = text.find(" ", start + 1)
                    after, before = text.find(" ", stop + 1), text.rfind(" ", 0, max(start, 0))
                    if stop + 1 < after:
                        own.add(text[start : after + 1])
                    if 0 <= before < start - 1:
                        own.add(text[before : stop + 1])
                found.update((p, label) for p in own)
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], names=["phrase", "toxic", "n"])

    counts = sample.select("toxic", "folded").mapInArrow(run, "phrase string, toxic int, n long")
    clean, toxic = (F.sum(F.when(F.col("toxic") == flag, F.col("n")).otherwise(0)) for flag in (0, 1))
    return sorted(r.phrase for r in counts.groupBy("phrase").agg(clean.alias("clean"), toxic.alias("toxic")).where((F.col("clean") >= least) & (F.col("toxic") == 0)).select("phrase").collect())


def _calibrate(model: ToxicityModel, label: np.ndarray, found: np.ndarray, ridge: float = 0.05) -> None:
    """Ridge logistic regression of the label on the hit features (Newton steps)."""
    x = np.column_stack([np.ones(len(found)), _features(found)])
    w, penalty = np.zeros(4), ridge * np.array([0, 1, 1, 1])
    # Both classes weigh the same in total, so the sample's mix does not matter.
    side = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (side * (p - label)) + penalty * w
        hess = (x * (side * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    model.bias, model.slopes = float(w[0]), tuple(float(v) for v in w[1:])
