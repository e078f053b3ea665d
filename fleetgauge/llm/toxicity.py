"""Toxicity by a learned lexicon that also catches misspellings, read in context.

Words and stems that labelled toxic texts use and others don't form a trie. Distinct words of the texts run through
it together with the states of a Levenshtein automaton, so one walk finds the terms within an edit.
Each place of a term is then read in a window of words: inside quotation marks, or after
words that speak about words, it counts as quotation, else as abuse. A logistic model on these
sums gives the score.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm import bytescan
from fleetgauge.llm.common import BLANKS, named, others, slices, stored, text_map

#: Labelled rows of each label that are learned from, drawn by a hash of key and text.
SAMPLE_ROWS = 20_000
#: A term must stand in this share of the toxic sample, and in MIN_TEXTS texts of it.
MIN_SHARE = 0.01
MIN_TEXTS = 5
#: Toxic share of the texts with a term.
MIN_PRECISION = 0.95
#: Letters of stems; a stem must begin several words.
STEMS = (4, 5, 6)
STEM_WORDS = 5
#: The terms of the largest weight; bounds the trie that is sent to the tasks.
MAX_TERMS = 5000
#: Terms with fewer letters match only exactly.
FUZZY_LETTERS = 5
#: A term with more ordinary words than this within an edit matches only exactly.
MAX_HARMLESS = 2
#: A misspelled term says this much of what the term says; labelled texts may have none to learn it from.
MISSPELLED = 0.7
#: Words to both sides that are read around a term.
WINDOW = 6
#: Weight of the penalty on large weights in the logistic model.
RIDGE = 0.005
#: Words that announce a quotation or speak about a word (fixed values).
SPEAKING = frozenset(
    "said says wrote writes called calls word words term terms quote quotes quoted reads phrase sagte sagt schrieb wort wörter begriff "
    "nannte dit écrit mot mots terme appelé dijo escribió palabra palabras término llamó".split()
)
_PAIRS = ("“”", "„“", "«»", "»«", "‹›")
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‹›…–—¡¿’‘"
_MARKS = re.compile(r"[\W_]+")
#: Signs written for letters (fixed values).
_SIGNS = str.maketrans("013457@$", "oleastas")


def normal(word: str) -> str:
    """Lower case, without punctuation at the ends."""
    return word.lower().strip(_STRIP)


@dataclass
class Lexicon:
    """Terms (a stem ends in *) with weights, as a trie; words known to be harmless though near a term."""

    terms: dict[str, float]
    harmless: frozenset[str] = frozenset()
    literal: frozenset[str] = frozenset()  # terms that match only as they are
    trie: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.trie = {}
        heads, tails = set(), set()
        for term in self.terms:
            node = self.trie
            plain = term.rstrip("*")
            for ch in plain:
                node = node.setdefault(ch, {})
            node["*" if term.endswith("*") else ""] = term
            if self._fuzzy(term):
                half = len(plain) // 2
                # The second: the letters on both sides of the middle changed places.
                heads |= {plain[:half], plain[: half - 1] + plain[half] + plain[half - 1]}
                tails.add(plain[half:])
        self.heads, self.tails = heads, tails
        self.head_sizes, self.tail_sizes = sorted({len(h) for h in heads}), sorted({len(t) for t in tails})
        self.longest = max((len(t) for t in self.terms), default=0) + 1

    def _fuzzy(self, term: str) -> bool:
        return not term.endswith("*") and len(term) >= FUZZY_LETTERS and term not in self.literal

    def _near(self, word: str) -> bool:
        """One edit lies in one half of a term, so the other half stands at its end of the word."""
        return any(word[:k] in self.heads for k in self.head_sizes) or any(word[-k:] in self.tails for k in self.tail_sizes)

    def _exact(self, word: str) -> str | None:
        node, stem = self.trie, None
        for ch in word:
            node = node.get(ch)
            if node is None:
                return stem
            stem = node.get("*", stem)
        return node.get("", stem)

    def _within_one(self, word: str) -> str | None:
        """The term of the largest weight within one edit (a letter more, less or other, or two neighbours changed): states (place in the word, edits) move along the trie."""
        best: str | None = None
        # Third: the letter that must come next after two neighbours changed places.
        stack = [(self.trie, frozenset([(0, 0, ""), (1, 1, "")]))]
        n = len(word)
        while stack:
            node, states = stack.pop()
            term = node.get("")
            if term is not None and self._fuzzy(term) and any(not due and n - i + e <= 1 for i, e, due in states):
                if best is None or (self.terms[term], term) > (self.terms[best], best):
                    best = term
            for ch, child in node.items():
                if len(ch) != 1 or ch == "*":
                    continue
                moved = set()
                for i, e, due in states:
                    if due:
                        if ch == due:
                            moved.add((i, 1, ""))
                        continue
                    if i < n and word[i] == ch:
                        moved.add((i + 1, e, ""))
                    if e == 0:
                        moved |= {(i, 1, ""), (i + 1, 1, "")}  # a letter of the term left out, or another in its place
                        if i + 1 < n and word[i + 1] == ch:
                            moved |= {(i + 2, 1, ""), (i + 2, 1, word[i])}  # one letter too many, or two that changed places
                moved = {x for x in moved if x[0] <= n}
                if moved:
                    stack.append((child, frozenset(moved)))
        return best

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) for a normal word: the exact term or stem, or else a term within one edit."""
        if len(word) > 2 and word not in self.harmless:
            found = self._exact(word)
            if found:
                return found, 0
            plain = word.translate(_SIGNS)
            if plain != word and (found := self._exact(plain)):
                return found, 1
            for own in dict.fromkeys((word, plain)):
                if FUZZY_LETTERS - 1 <= len(own) <= self.longest and self._near(own) and (found := self._within_one(own)):
                    return found, 1
        return None


    def match_any(self, word: str) -> tuple[str, int] | None:
        """What `match` finds for the word, or else for one of its parts between marks: of several the first without an edit."""
        found = self.match(word)
        if found is None and not word.isalnum():
            hits = [h for part in _MARKS.split(word) if part and part != word and (h := self.match(part))]
            found = min(hits, key=lambda h: h[1], default=None)
        return found


def _quoted(text: str, begin: int, end: int, before: list[str]) -> bool:
    """The place stands between quotation marks, or right after a word about words."""
    left, right = text[:begin], text[end:]
    # Straight marks open and close alike: an odd number of them on the left leaves one open.
    between = left.count('"') % 2 == 1 and '"' in right
    between |= any(left.rfind(o) > left.rfind(c) and c in right for o, c in _PAIRS)
    return between or any(w in SPEAKING for w in before[-3:])


FEATURES = 4


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """For each text: weight of terms, that of misspelled ones again, of quoted ones, and unquoted terms per 100 words, on a log scale."""
    found = bytescan.words(texts, bytescan.blank_separated())
    out = np.zeros((len(texts), FEATURES))
    if len(found.hashes) == 0 or not lexicon.terms:
        return out
    _, at = np.unique(found.hashes, return_index=True)
    known: dict[int, tuple[str, int]] = {}
    for i in at:
        hit = lexicon.match_any(normal(found.data[found.starts[i] : found.ends[i]].tobytes().decode("utf-8", "replace")))
        if hit:
            known[int(found.hashes[i])] = hit
    if not known:
        return out
    places = np.flatnonzero(np.isin(found.hashes, np.array(list(known), np.uint64)))
    owner = np.searchsorted(found.first, places, side="right") - 1
    abuse = np.zeros(len(texts))
    for p, t in zip(places.tolist(), owner.tolist(), strict=True):
        a, b = max(int(found.first[t]), p - WINDOW), min(int(found.first[t + 1]), p + WINDOW + 1)
        raw = found.data[found.starts[a] : found.ends[b - 1]].tobytes()
        cut = [int(found.starts[p] - found.starts[a]), int(found.ends[p] - found.starts[a])]
        left, middle, right = raw[: cut[0]].decode(), raw[cut[0] : cut[1]].decode(), raw[cut[1] :].decode()
        term, edits = known[int(found.hashes[p])]
        # Marks at the word's own ends belong to its surroundings.
        core = middle.strip(_STRIP) or middle
        lead = middle.find(core)
        left, right = left + middle[:lead], middle[lead + len(core) :] + right
        quoted = _quoted(left + core + right, len(left), len(left) + len(core), [normal(w) for w in left.split()])
        weight = lexicon.terms[term]
        if quoted:
            out[t, 2] += weight
        else:
            out[t, 0] += MISSPELLED * weight if edits else weight
            out[t, 1] += weight * edits
        abuse[t] += not quoted
    n = np.maximum(1, np.diff(found.first))
    out[:, 3] = np.minimum(20.0, 100 * abuse / n)
    return np.log1p(out)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # of the features, and the constant

    def score(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic model by Newton steps. Weights of term features can't be negative."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.full(len(x), 1 / max(1, len(x)))
    w = np.zeros(x.shape[1])
    penalty = np.diag([RIDGE] * FEATURES + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        w = w - step
        w[:FEATURES] = np.maximum(w[:FEATURES], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, training: Column, text: str, key: str, label: str, rows: int) -> DataFrame:
    """(text, toxic): about `rows` distinct labelled training texts of each label, drawn by a hash."""
    known = labels.where(named(label).isNotNull()).select(named(key).alias("__key"), named(label).cast("int").alias("toxic")).distinct()
    own = docs.where(training & named(text).isNotNull()).select(named(key).alias("__id"), named(text).alias("text"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).where("toxic in (0, 1)").collect()}
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("toxic") == value, min(1.0, rows / n)).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("__key", F.lit("draw")), F.lit(1 << 30)) < share * (1 << 30))
    # The draw bounds what is broadcast; the texts stay where they are read.
    return own.join(F.broadcast(drawn), F.col("__id") == F.col("__key")).select("text", "toxic")


def _terms(sample: DataFrame) -> tuple[dict[str, float], DataFrame]:
    """Terms with weights, and the table of words with the texts of each label that hold them."""
    # Copies of a text would make its rare words look like terms: each text counts once.
    texts = sample.dropDuplicates(["text"])
    totals = texts.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, clean = totals["bad"] or 0, totals["n"] - (totals["bad"] or 0)
    tidy = F.btrim(F.col("w"), F.lit(_STRIP))
    words = (
        texts.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), f"[{BLANKS}]+", -1))).alias("w"))
        .select("toxic", tidy.alias("w")).where("char_length(w) between 3 and 40")
        .groupBy("w").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("clean"))
    )
    need = max(MIN_TEXTS, math.ceil(MIN_SHARE * bad))
    pure = (F.col("bad") >= need) & (F.col("bad") >= MIN_PRECISION * (F.col("bad") + F.col("clean")))
    weight = F.log((F.col("bad") + 0.5) / F.lit(bad + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(clean + 1.0))
    stems = (
        words.select("w", "bad", "clean", F.explode(F.array(*[F.when(F.char_length("w") >= k, F.substring("w", 1, k)) for k in STEMS])).alias("s"))
        .where("s is not null").groupBy("s").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"), F.count_if(F.col("bad") > 0).alias("n"))
        .where(pure & (F.col("n") >= STEM_WORDS)).select(F.concat("s", F.lit("*")).alias("term"), weight.alias("weight"))
    )
    own = words.where(pure).select(F.col("w").alias("term"), weight.alias("weight")).unionAll(stems)
    rows = own.where("weight > 0").orderBy(F.desc("weight"), "term").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        warnings.warn(f"the lexicon is full: terms after the first {MAX_TERMS} by weight are left out", stacklevel=2)
        rows = rows[:MAX_TERMS]
    terms = {r["term"]: float(r["weight"]) for r in rows}
    # A shorter stem says what a longer one and the words that begin with it say.
    covered = {t for t in terms if any(t != s and t.rstrip("*").startswith(s[:-1]) for s in {f"{t[:k]}*" for k in STEMS} & terms.keys())}
    return {t: v for t, v in terms.items() if t not in covered}, words


def fit(docs: DataFrame, labels: DataFrame, training: Column, text: str = "text", key: str = "doc_id", label: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon and weights from training rows with a label (0 or 1; others don't count).

    About `sample_rows` rows of each label are used. The driver gets the terms, at most MAX_TERMS, for each term up to
    two ordinary words near it, and the features of the sample (four numbers a row).
    Without toxic rows nothing is a term, and every score is the same.
    """
    sample = stored(_sample(docs, labels, training, text, key, label, sample_rows), "toxicity")
    terms, words = _terms(sample)
    rough = Lexicon(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [m[0] if m and m[1] else None for m in map(rough.match, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.string())], names=["w", "term"])

    harmful = F.col("bad") >= 0.9 * (F.col("bad") + F.col("clean"))
    suspects = words.where((F.col("clean") > 0) & ~harmful).select("w").mapInArrow(near, "w string, term string").where("term is not null")
    # A term whose neighbours are mostly ordinary words is no word to misspell: it is taken literally.
    beside = suspects.groupBy("term").agg(F.count("*").alias("n"), F.min("w").alias("first"), F.max("w").alias("last")).collect()
    literal = frozenset(r["term"] for r in beside if r["n"] > MAX_HARMLESS)
    harmless = frozenset(w for r in beside if r["term"] not in literal for w in (r["first"], r["last"]))
    lexicon = Lexicon(terms, harmless, literal)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                part = batch.slice(a, b - a)
                x = features(part.column(0), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.select("text", "toxic").mapInArrow(run, "toxic int, x array<double>").collect()
    if not rows:
        return Model(lexicon, np.zeros(FEATURES + 1))
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    order = np.lexsort([*x.T, y])  # sums don't depend on the order of rows
    return Model(lexicon, _logistic(x[order], y[order]))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all) and score (0 to 1) and predicted (1 if score >= 0.5) of the whole texts.

    Null and empty texts, and texts without a term, get the score of a text without terms. Equal texts get
    equal scores; only the text is read.
    """
    keep = others(docs.columns, ("score", "predicted")) if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def function(texts: pa.Array) -> list[pa.Array]:
        p = sent.value.score(features(texts, sent.value.lexicon))
        return [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())]

    return text_map(docs, text, keep, "score double, predicted int", function)

