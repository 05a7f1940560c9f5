"""Toxicity: a lexicon trie met by Levenshtein automata, and scores of the context window.

Terms (words, and stems that any ending may follow) are learned from labelled documents: those that occur in toxic
ones so much more often than by chance that it holds for all the terms tried at once; the words that a stem stands for are
in the trie with the stem's weight, so that their misspellings are met too. A word of a text matches a term
exactly, by its stem, or within one edit, found by walking the trie with the word's Levenshtein automaton. Terms whose neighbours within one
edit are words of clean labelled documents match exactly alone; of terms under five letters one such document is enough, and terms of one or two
letters have no misspellings, as any short word is one edit from them. A match in quotation marks (double ones, or single ones that are no
apostrophes), else one addressed to someone, else one after a word of reporting counts by a factor of its context, learned from how toxic the labelled documents
with such matches are and drawn towards a prior where few have them. The evidence of a
text's matches is turned into a probability by a logistic curve fitted to the same labelled documents. The lexicon holds all terms
that tell; the bounded sample alone limits how many there are.

Labels are read for fitting alone, from a bounded sample: of each class the PER_CLASS documents with the least hash of
their doc_id. Scores depend on the text alone.

Defined results: null and empty texts have no evidence and get the curve's value there; documents without a label
score like others; of several labels of a doc_id the largest counts, null labels don't; if there is no label of
one class all scores are 0; rows that repeat get equal scores; of several terms near a word the first by code point counts; a text is one row of any
length, scored in linear time; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fold, fresh, small_batches
from .simhash import shingle_hashes, words_of

#: Labelled documents of each class that a model is fitted to, at most.
PER_CLASS = 6000
#: Letters of the shortest term that has misspellings, and of the shortest that may have some in common with clean documents.
LEAST_FUZZY, LEAST_SHARED = 3, 5
#: Letters of a stem.
STEMS = range(4, 8)
#: Words before and after a match that make its context.
WINDOW = 4
#: What a match within one edit is worth, beside an exact one.
FUZZY = 0.7
#: Contexts, and what a match counts by its context if no labels tell; labelled documents weigh against so many of the prior.
QUOTED, REPORTED, PLAIN, ADDRESSED = range(4)
CONTEXTS, CONTEXT_PRIOR = (0.35, 0.5, 1.0, 1.25), 100
#: Words of reporting and of address, in four languages.
REPORTING = frozenset("said says wrote writes quote quoted quotes word words term called reported dit écrit mot cité sagte schrieb wort zitat dijo escribió palabra cita".split())
ADDRESS = frozenset("you your you're u are ur tu vous es êtes toi du dich bist ihr sie usted eres tú".split())
QUOTES = "\"“”„«»"
#: Single quotation marks around part of a line: an opening one follows no letter, a closing one precedes none, and those between two letters are apostrophes.
_SINGLE = re.compile(r"(?<!\w)['‘‚](?=\S)(?:[^\n'’‘‚]|(?<=\w)['’](?=\w))*+['’‘](?!\w)")

_TOKEN = re.compile(r"[^\W_](?:[\w@$*!]*[^\W_])?")
_MEMO_MOST = 300_000
#: Odd factors that order word runs anew.
_ODD = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD1B54A32D192ED03]


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


class LexiconTrie:
    """Terms in a trie; find() walks it with the Levenshtein automaton of a word. Terms in exact_only have no misspellings."""

    def __init__(self, words: set[str], stems: set[str], exact_only: frozenset[str] = frozenset()):
        self.words, self.stems = words, stems
        self.root: dict = {}
        met = [w for w in words if len(w) >= LEAST_FUZZY and w not in exact_only]
        for w in met:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.stem_sizes = sorted({len(s) for s in stems}, reverse=True)
        # A word within one edit of a term shares with it itself or what is left of one of them, or of both, without one letter.
        self.cores = {c for w in met for c in self._cores(w)}
        self.shortest = min(map(len, met), default=0)
        self.longest = max(map(len, met), default=0)

    @staticmethod
    def _cores(word: str) -> list[str]:
        return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]

    def near(self, word: str) -> list[str]:
        """The terms within one edit of word, by code points.

        A state is the automaton's row of distances, kept to 0, 1 or 2 (dead); branches whose row is dead are cut.
        """
        if not self.shortest - 1 <= len(word) <= self.longest + 1 or self.cores.isdisjoint(self._cores(word)):
            return []
        found = []
        stack = [(self.root, tuple(min(i, 2) for i in range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            if "" in node and row[-1] <= 1:
                found.append(node[""])
            for c, child in node.items():
                if c:
                    step = [min(row[0] + 1, 2)]
                    for i, x in enumerate(word):
                        step.append(min(row[i] + (x != c), row[i + 1] + 1, step[i] + 1, 2))
                    if min(step) < 2:
                        stack.append((child, tuple(step)))
        return sorted(found)

    def exact(self, word: str) -> str | None:
        """The term that word is, or whose stem it begins with."""
        if word in self.words:
            return word
        return next((word[:n] + "*" for n in self.stem_sizes if len(word) > n and word[:n] in self.stems), None)

    def find(self, word: str) -> tuple[str, bool] | None:
        """The term that word matches, and whether exactly (or by its stem)."""
        term = self.exact(word)
        if term:
            return term, True
        near = self.near(word)
        return (near[0], False) if near else None


def _context(words: list[str], i: int, quoted: bool) -> int:
    """The context of the match that is word i."""
    if quoted:
        return QUOTED
    around = words[max(0, i - WINDOW) : i]
    if ADDRESS.intersection(around):
        return ADDRESSED
    return REPORTED if REPORTING.intersection(around) else PLAIN


class Scorer:
    def __init__(self, model: dict):
        self.weights = model["weights"]
        self.curve = model["curve"]
        self.contexts = model.get("contexts", CONTEXTS)
        self.trie = LexiconTrie({t for t in self.weights if not t.endswith("*")}, {t[:-1] for t in self.weights if t.endswith("*")}, frozenset(model.get("exact_only", ())))
        self.memo: dict[str, tuple[str, bool] | None] = {}

    def matches(self, text: str | None) -> list[tuple[str, str, bool, int]]:
        """Word, term, whether exactly and context of each match, in one pass over the text."""
        words, memo, find, hit = tokens(text), self.memo, self.trie.find, {}
        for w in set(words):
            if w not in memo:
                if len(memo) >= _MEMO_MOST:
                    memo.clear()
                memo[w] = find(w)
            if memo[w]:
                hit[w] = memo[w]
        if not hit:
            return []
        out, low, upto, quotes = [], text.lower(), 0, 0
        singles = _SINGLE.finditer(low)
        single = next(singles, None)
        for i, m in enumerate(_TOKEN.finditer(low)):
            if m[0] in hit:
                # An odd number of quotation marks between the line's start and the match: it is inside of them.
                start = low.rfind("\n", upto, m.start()) + 1
                quotes = (0 if start else quotes) + sum(low.count(q, max(start, upto), m.start()) for q in QUOTES)
                upto = m.start()
                while single and single.end() <= upto:
                    single = next(singles, None)
                out.append((m[0], *hit[m[0]], _context(words, i, quotes % 2 == 1 or (single is not None and single.start() < upto))))
        return out

    def evidence(self, text: str | None) -> tuple[float, list[str]]:
        worth: dict[str, list[float]] = {}
        found = self.matches(text)
        for word, term, exact, context in found:
            worth.setdefault(word, []).append(self.weights[term] * (1 if exact else FUZZY) * self.contexts[context])
        # Each form counts by its best context, and repeats add less and less.
        return sum(max(w) * (1 + math.log(len(w))) for w in worth.values()), sorted({term for _, term, _, _ in found})

    def score(self, evidence: float) -> float:
        if self.curve is None:
            return 0.0
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * evidence))))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, held_out: int, per_class: int) -> DataFrame:
    """Labelled rows (text, toxic) of the other folds: of each class those with the least hash."""
    own = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter("label_id is not null and toxic in (0, 1)")
    own = own.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    if held_out:
        own = own.filter(fold(F.col("label_id"), held_out) != 0)
    order = [F.xxhash64("label_id"), F.col("label_id")]
    own = cut(own)
    own = own.filter("toxic = 1").orderBy(*order).limit(per_class).unionByName(own.filter("toxic = 0").orderBy(*order).limit(per_class))
    # At most 2 * per_class rows of two numbers are broadcast.
    return docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(cut(own)), "label_id").select("text", "toxic")


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """sample without copies and most near copies, whose words would seem typical of their class: one row stays of those that agree in a minimum of hashed word runs."""

    def keyed(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            runs = [shingle_hashes(words_of(t), 5) for t in texts]
            least = [[int((h * np.uint64(k) if len(h) else np.zeros(1, np.uint64)).min() >> np.uint64(1)) for h in runs] for k in _ODD]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in least)], names=["text", "toxic", *(f"h{i}" for i in range(len(_ODD)))])

    rows = sample.select("text", "toxic").mapInArrow(keyed, "text string, toxic int, " + ", ".join(f"h{i} long" for i in range(len(_ODD)))).withColumn("t", F.xxhash64("text"))
    for i in range(len(_ODD)):
        rows = rows.groupBy("toxic", f"h{i}").agg(F.min_by(F.struct("text", "t", *(f"h{j}" for j in range(i + 1, len(_ODD)))), "t").alias("r")).select("toxic", "r.*")
    return rows.select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 5, per_class: int = PER_CLASS) -> dict:
    """The model: weights of terms and the curve. Terms, and the forms of their stems, are words of the bounded sample."""
    small_batches(docs.sparkSession)
    sample = cut(_sample(docs, labels, id_col, text_col, held_out, per_class))
    share = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = cut(_one_of_copies(sample))
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return {"weights": {}, "curve": None, "exact_only": []}

    def units(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = set(tokens(t))
                counts[y].update(own | {w[:k] + "*" for w in own for k in STEMS if len(w) > k})
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield _counted(counts)
                    counts = (Counter(), Counter())
        yield _counted(counts)

    def _counted(counts):
        every = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([counts[1][u] for u in every], pa.int64()), pa.array([counts[0][u] for u in every], pa.int64())], names=["unit", "toxic", "clean"])

    tried = cut(sample.mapInArrow(units, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    prior = n_toxic / (n_toxic + n_clean)
    both = F.col("toxic") + F.col("clean")
    # The log-likelihood ratio of a term must exceed what the best of all the tried ones reaches by chance.
    ratio = F.col("toxic") * F.log(F.col("toxic") / (both * prior)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - prior)))).otherwise(F.lit(0.0))
    bar = math.log(max(2, tried.count())) + 1.5
    good = tried.filter((F.col("toxic") > 1) & (F.col("toxic") > both * prior)).withColumn("ratio", ratio).filter(F.col("ratio") > bar)
    # Nine in ten of the documents with it are toxic, if classes were equally frequent.
    good = good.filter((F.col("toxic") + 0.5) / (n_toxic + 1) > 9 * (F.col("clean") + 0.5) / (n_clean + 1))
    rows = good.collect()
    weights: dict[str, float] = {}
    begun: dict[str, list[int]] = {}  # documents of the words by their beginnings
    for r in rows:
        if not r["unit"].endswith("*"):
            for k in STEMS:
                begun.setdefault(r["unit"][:k], []).append(r["toxic"])
    for r in sorted(rows, key=lambda r: (-r["ratio"], not r["unit"].endswith("*"), len(r["unit"]), r["unit"])):
        u = r["unit"]
        weight = min(6.0, math.log((r["toxic"] + 0.5) / (n_toxic + 1)) - math.log((r["clean"] + 0.5) / (n_clean + 1)))
        # A word or longer stem is left out if it tells little more than a stem that is in, as is a stem of one word alone.
        if any(weight < weights.get(u[:k] + "*", -9.0) + 0.7 for k in STEMS if len(u.rstrip("*")) > k and u[:k] + "*" in weights):
            continue
        if u.endswith("*") and any(abs(x - r["toxic"]) <= 0.02 * r["toxic"] for x in begun.get(u[:-1], ())):
            continue
        weights[u] = weight
    weights |= _forms(tried, weights, prior)
    plain = {"weights": weights, "curve": (0.0, 1.0), "exact_only": []}

    def fuzzy(batches):
        trie, counts = Scorer(plain).trie, (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[y].update({term for w in set(tokens(t)) if not trie.exact(w) for term in trie.near(w)})
        yield _counted(counts)

    # Terms whose neighbours within one edit are words of clean texts are matched exactly alone.
    beside = sample.mapInArrow(fuzzy, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    shared = (F.col("clean") > 1) & (F.col("clean") / n_clean > 0.1 * F.col("toxic") / n_toxic)
    plain["exact_only"] = sorted(r["unit"] for r in beside.filter(shared | (F.col("clean") > 0) & (F.length("unit") < LEAST_SHARED)).collect())

    def contexts(batches):
        scorer, counts = Scorer(plain), (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[y].update({str(context) for _, _, _, context in scorer.matches(t)})
        yield _counted(counts)

    seen = sample.mapInArrow(contexts, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    plain["contexts"] = _factors({int(r["unit"]): (r["toxic"] / n_toxic, r["clean"] / n_clean, r["toxic"] + r["clean"]) for r in seen})

    def evidence(batches):
        scorer = Scorer(plain)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([round(min(60.0, scorer.evidence(t)[0]), 1) for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["x", "toxic"])

    seen = sample.mapInArrow(evidence, "x double, toxic int").groupBy("x", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    # Copies count again for the curve, as far as the classes' sizes go.
    return plain | {"curve": _logistic([(r["x"], r["toxic"], r["n"] * share[r["toxic"]] / n[r["toxic"]]) for r in sorted(seen, key=lambda r: (r["x"], r["toxic"]))])}


def _factors(seen: dict[int, tuple[float, float, int]]) -> tuple[float, ...]:
    """What matches count by context: how toxic documents with such matches are, beside those with plain ones; seen: shares of toxic and of clean documents, and documents."""
    toxic = lambda c: seen[c][0] / (seen[c][0] + seen[c][1])
    if PLAIN not in seen or not seen[PLAIN][0]:
        return CONTEXTS
    ratio = {c: min(1.5, prior * toxic(c) / toxic(PLAIN) if c == ADDRESSED else toxic(c) / toxic(PLAIN)) for c, prior in enumerate(CONTEXTS) if c in seen}
    return tuple((prior * CONTEXT_PRIOR + ratio[c] * seen[c][2]) / (CONTEXT_PRIOR + seen[c][2]) if c in seen and c != PLAIN else prior for c, prior in enumerate(CONTEXTS))


def _forms(tried: DataFrame, weights: dict[str, float], prior: float) -> dict[str, float]:
    """The words of toxic texts that the stems in weights stand for, with the weight of the longest: a misspelling within a stem is near to the word alone."""
    stems = {k: [u[:-1] for u in weights if u.endswith("*") and len(u) == k + 1] for k in STEMS}
    if not any(stems.values()):
        return {}
    under = [F.substring("unit", 1, k).isin(own) & (F.length("unit") > k) for k, own in stems.items() if own]
    covered = under[0]
    for u in under[1:]:
        covered |= u
    rows = tried.filter(~F.col("unit").endswith("*") & covered & (F.col("toxic") > (F.col("toxic") + F.col("clean")) * prior)).select("unit").collect()
    words = {r["unit"] for r in rows} - weights.keys()
    return {w: next(weights[w[:k] + "*"] for k in reversed(STEMS) if len(w) > k and w[:k] + "*" in weights) for w in sorted(words)}


def _logistic(rows: list[tuple[float, int, float]], centre: tuple[float, float] = (-4.0, 1.0), pull: float = 0.007) -> tuple[float, float]:
    """Newton's method for a + b * x, pulled to a centre: labels that any curve separates would put its middle
    far from clean texts, and a text with one plain term would pass as clean."""
    r = 1 + pull * sum(n for _, _, n in rows)
    a, b = centre
    for _ in range(50):
        ga, gb, haa, hab, hbb = r * (centre[0] - a), r * (centre[1] - b), r, 0.0, r
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            v = n * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + n * (y - p), gb + n * (y - p) * x, haa + v, hab + v * x, hbb + v * x * x
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a + da / size, b + db / size
        if abs(da) + abs(db) < 1e-9:
            break
    return a, max(0.0, b)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score, predicted and terms (the matched ones)."""
    small_batches(docs.sparkSession)
    names = [fresh(c, docs.columns) for c in ("score", "predicted", "terms")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType()), T.StructField(names[2], T.ArrayType(T.StringType()))])
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            found = [scorer.evidence(t.as_py()) for t in b.column(at)]
            scores = [scorer.score(e) for e, _ in found]
            added = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([t for _, t in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)
