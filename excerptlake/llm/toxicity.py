"""Toxicity scores: misspelling-tolerant lexicon search, and context that tells quoting from abuse.

Lexicon: on a bounded sample of labelled rows, words and word beginnings whose document rate among
toxic rows far exceeds that among clean ones become terms; a beginning that many different words
share stays a stem, one that a single word dominates becomes that word. Nothing is listed by hand
but the context words below.

Search: the terms form a trie. A Levenshtein automaton's states (trie node, edits so far), kept
only where the node's terms still allow that many edits, are determinised lazily and remembered, so
a word is walked once through the intersection and most words die after a few letters. Terms of 5
letters or more allow one edit, of 9 or more two; stems are met exactly.

Context: each hit looks at a window of words around it: inside quotation marks or beside a
reporting word it counts as quoted, beside a second-person word as addressed. A logistic model
over the weighted hits (plain, quoted, misspelled, addressed, and their density) gives the score.

Bounds (documented parameters): SAMPLE_TOXIC and SAMPLE_CLEAN labelled rows are used to fit, chosen
by a hash of doc_id; MAX_TERMS terms are broadcast. Scoring covers every row and whole texts.

Defined cases: null or empty text has no hits and gets the model's base score; rows with null
doc_id are scored and count as not held out; several labels of one doc_id count as their maximum;
without labels every score is 0; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, extended, map_arrow, table, text_or_empty, work_folder

SAMPLE_TOXIC, SAMPLE_CLEAN, MAX_TERMS = 2500, 5000, 1000
#: States of the automaton (some kB each) a worker holds before it starts anew.
MAX_STATES = 50_000
#: A term stands in MIN_DOCS toxic documents and MIN_RATE of them at least; rarer words are chance.
MIN_DOCS, MIN_RATE, MIN_PRECISION = 4, 0.005, 0.97
THRESHOLD = 0.3
WINDOW = 6
SPLIT = r"[^\pL\pN@$*]+"
WORD = regex.compile(r"[\p{L}\p{N}@$*]+")
#: Context words (fixed values of this model): reporting verbs and second-person words.
REPORTING = frozenset("said says wrote called quoted quote reported claimed sagte schrieb nannte dit écrit dijo escribió llamó".split())
ADDRESSING = frozenset("you your yours youre du dich dir dein deine ihr euch tu te toi vous votre usted vosotros eres".split())
#: Marks that open and close quotations; an apostrophe closes only what a single mark has opened.
OPENS, CLOSES = frozenset('"“„«»‹›‘`'), frozenset('"”“«»‹›`')


def within_quotes(before: str, after: str) -> bool:
    """Whether a mark opens a quotation before a word and one closes it after."""
    if OPENS.isdisjoint(before):
        return False
    return not CLOSES.isdisjoint(after) or ("‘" in before and "’" in after)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


# --- lexicon automaton -----------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    text: str
    weight: float
    stem: bool

    @property
    def edits(self) -> int:
        return 0 if self.stem or len(self.text) < 5 else 1 if len(self.text) < 9 else 2


class LexiconAutomaton:
    """Levenshtein automata of all terms intersected with their trie, determinised on demand."""

    DEAD = -1

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.budget = [0]  # most edits that any term below the node allows
        for t, term in enumerate(terms):
            node = 0
            self.budget[0] = max(self.budget[0], term.edits)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], term.edits)
            self.ends[node].append(t)
        self.alphabet = {c for kids in self.children for c in kids}
        self._clear()

    def _clear(self) -> None:
        """Forget all states; they are made again when asked for."""
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.stem: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0}) if self.terms else self.DEAD

    def _state(self, edits: dict[int, int]) -> int:
        todo = [*edits.items()]
        for node, e in todo:  # letters of the term that the word lacks
            for child in self.children[node].values():
                if e + 1 <= self.budget[child] and e + 1 < edits.get(child, 99):
                    edits[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(edits.items()))
        if not key:
            return self.DEAD
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            hits = [(e, -self.terms[t].weight, t) for n, e in key for t in self.ends[n] if e <= self.terms[t].edits]
            best = min(hits, default=None)
            self.found.append((best[2], best[0]) if best else None)
            stems = [h for h in hits if self.terms[h[2]].stem]
            self.stem.append((min(stems)[2], 0) if stems else None)
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        edits: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.budget[node] and e < edits.get(node, 99):
                edits[node] = e

        for node, e in self.states[state]:
            put(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                put(child, e + (letter != c))
        return self._state(edits)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the closest term within its edit budget, or None."""
        if len(self.states) > MAX_STATES:
            self._clear()
        state = self.start
        if state < 0:
            return None
        known, alphabet = self.next, self.alphabet
        for c in word:
            if c not in alphabet:
                c = ""  # all other letters behave alike
            after = known[state].get(c)
            if after is None:
                after = known[state][c] = self._step(state, c)
            if after < 0:
                return None
            state = after
            if self.stem[state]:
                return self.stem[state]
        return self.found[state]


_built: dict[tuple[Term, ...], LexiconAutomaton] = {}


def automaton_of(terms: list[Term]) -> LexiconAutomaton:
    """A worker's automaton of a lexicon, kept for its later tasks; it holds one lexicon at a time."""
    key = tuple(terms)
    if key not in _built:
        _built.clear()
        _built[key] = LexiconAutomaton(terms)
    return _built[key]


# --- features --------------------------------------------------------------------------------

FEATURES = 5


def document_features(text: str, automaton: LexiconAutomaton) -> list[float]:
    """Features of one lower-cased text: plain, quoted, misspelled, addressed weight; density."""
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    words = [text[a:b] for a, b in spans]
    plain = quoted = misspelled = addressed = 0.0
    hits = 0
    for i, word in enumerate(words):
        got = automaton.match(word)
        if not got:
            continue
        hits += 1
        weight = automaton.terms[got[0]].weight
        around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        before = text[spans[max(0, i - WINDOW)][0] : spans[i][0]]
        after = text[spans[i][1] : spans[min(len(spans) - 1, i + WINDOW)][1]]
        if within_quotes(before, after) or not REPORTING.isdisjoint(around):
            quoted += weight
        elif got[1]:
            misspelled += weight
        else:
            plain += weight
        if not ADDRESSING.isdisjoint(around):
            addressed += weight
    density = min(10.0, 100.0 * hits / max(1, len(words)))
    return [math.log1p(plain), math.log1p(quoted), math.log1p(misspelled), math.log1p(addressed), density]


def batch_features(texts: pa.Array, automaton: LexiconAutomaton) -> np.ndarray:
    """Features of a batch; only texts with a hit among their distinct words are looked at closely."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()))
    words = pc.split_pattern_regex(lowered, SPLIT)
    starts = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    hit = np.array([automaton.match(w) is not None for w in coded.dictionary.to_pylist()], bool)
    out = np.zeros((len(texts), FEATURES))
    if hit.any():
        at = np.flatnonzero(hit[coded.indices.to_numpy()])
        for i in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
            out[i] = document_features(lowered[i].as_py(), automaton)
    return out


# --- fitting ---------------------------------------------------------------------------------


def _items(text: str) -> set[str]:
    """Words and, marked by *, their beginnings of 4 to 6 letters."""
    words = {w for w in WORD.findall(text.lower()) if len(w) > 2}
    return words | {f"{w[:k]}*" for w in words for k in (4, 5, 6) if len(w) > k}


def _item_counts(sample: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """item, docs, toxic_docs over the sample, counted within each task before the shuffle."""

    def run(batches):
        docs: Counter = Counter()
        toxic: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items = _items(text) if wanted is None else _items(text) & wanted
                docs.update(items)
                if label:
                    toxic.update(items)
        names = [*docs]
        if names:
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([docs[x] for x in names], pa.int64()), pa.array([toxic[x] for x in names], pa.int64())],
                names=["item", "docs", "toxic_docs"],
            )

    parts = sample.select("text", "label").mapInArrow(run, "item string, docs long, toxic_docs long")
    return parts.groupBy("item").agg(F.sum("docs").alias("docs"), F.sum("toxic_docs").alias("toxic_docs"))


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[Term]:
    """Terms from (item, docs, toxic_docs); see the module's text."""
    good = {}
    for item, n, t in counts:
        rate, other = t / max(1, toxic), (n - t) / max(1, clean)
        if t >= MIN_DOCS and rate >= MIN_RATE and rate / (rate + other) >= MIN_PRECISION:
            good[item] = (math.log((t + 0.5) / (toxic + 1)) - math.log((n - t + 0.5) / (clean + 1)), t)
    terms: list[Term] = []
    stems: set[str] = set()
    words = sorted((w for w in good if not w.endswith("*")), key=lambda w: -good[w][1])
    for item in sorted((i for i in good if i.endswith("*")), key=lambda i: (len(i), i)):
        stem = item[:-1]
        if any(stem.startswith(s) for s in stems):
            continue
        top = max((good[w][1] for w in words if w.startswith(stem)), default=0)
        if top < 0.6 * good[item][1]:
            stems.add(stem)
            terms.append(Term(stem, good[item][0], True))
    for w in words:
        if not any(w.startswith(s) for s in stems):
            terms.append(Term(w, good[w][0], False))
    return sorted(terms, key=lambda t: (-t.weight, t.text))[:MAX_TERMS]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method with an L2 penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    terms: list[Term]
    weights: np.ndarray | None

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows that aren't held out; reads doc_id and text of docs, no other column."""
    spark = docs.sparkSession
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("label"))
    )
    by_hash = (F.xxhash64("label_id"), "label_id")
    bounds = ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
    chosen = None
    for label, bound in bounds:
        part = known.filter(F.col("label") == label).orderBy(*by_hash).limit(bound)
        chosen = part if chosen is None else chosen.unionByName(part)
    folder = work_folder(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN pairs of numbers: a proven bound for the broadcast
    sample = rows.join(F.broadcast(chosen), rows.doc_id == chosen.label_id).select("text", "label")
    sample = cut(sample, f"{folder}/sample")
    sizes = {int(r.label): r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model([], None)
    # what choose_terms asks of an item's toxic documents; the sample's size bounds how many there are
    first = _item_counts(sample.filter("label = 1"), None).filter((F.col("docs") >= MIN_DOCS) & (F.col("docs") >= MIN_RATE * toxic))
    wanted = frozenset(r.item for r in first.select("item").collect())
    counts = _item_counts(sample, wanted)
    terms = choose_terms([(r.item, r.docs, r.toxic_docs) for r in counts.collect()], toxic, clean)
    totals = {int(r.label): r["count"] for r in known.groupBy("label").count().collect()}

    def make():
        automaton = automaton_of(terms)

        def step(batch):
            x = batch_features(batch.column(0), automaton)
            columns = [pa.array(x[:, k]) for k in range(FEATURES)]
            return pa.RecordBatch.from_arrays([batch.column(1), *columns], names=["label", *(f"x{k}" for k in range(FEATURES))])

        return step

    schema = "label int, " + ", ".join(f"x{k} double" for k in range(FEATURES))
    fitted = np.array([tuple(r) for r in map_arrow(sample, make, schema).collect()], float)
    y = fitted[:, 0]
    weight = np.where(y == 1, totals[1] / toxic, totals[0] / clean)
    return Model(terms, fit_logistic(fitted[:, 1:], y, weight / weight.mean()))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the score of each whole text in an extra column."""
    terms = model.terms

    def make():
        automaton = automaton_of(terms)

        def step(batch):
            texts = batch.column(batch.schema.get_field_index(text)).fill_null("")
            scores = model.score(batch_features(texts, automaton))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, column])

        return step

    kept = docs.select(*[F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != column])
    return map_arrow(kept, make, extended(kept, **{column: "double"}))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ids = F.col("doc_id")
    return (
        score(rows, model)
        .select(
            "doc_id",
            held_out(ids).alias("held_out"),
            "score",
            (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        )
    )
