"""Toxicity by a learned lexicon that also catches misspellings, weighed by the words around each hit.

Terms come from labelled documents: whole words, or stems that any ending may follow. They form a trie; the
trie is intersected with Levenshtein automata whose bound grows with a term's length. The product is made
deterministic as it is walked, so reading a word costs one table look-up a letter, and most words leave the
product after a few. Quotation and mention around a hit lower its weight, direct address raises it; a
logistic curve fitted to the labelled documents turns the sum into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_of_id, map_text, materialise, prepare

#: Labelled documents of each class that the model is fitted to, at most; taken by hash of their ids.
TRAIN_TOXIC, TRAIN_CLEAN = 2000, 3000
#: A term stands in this share of the toxic training documents at least, and in this many.
LEAST_SHARE, LEAST_DOCS = 0.02, 5
#: Share of toxic documents among those of a term, as if both classes were equally many.
PRECISION = 0.9
#: A term keeps its edits if no more words of the clean training documents are that near to it.
MOST_NEAR = 3
#: Log of the ratio of a term's rates in toxic and in clean text that counts as weight 1.
FULL = math.log(500)
#: Terms whose rates differ by less are left out.
LEAST_RATIO = 20
#: Words around a hit that are looked at.
CONTEXT = 6
FUZZY = 0.8
QUOTED, ADDRESSED = 0.25, 1.25
CACHE_WORDS = 400_000
RIDGE = 5e-4
#: Log-odds of a text without a hit, at most: such a text is never predicted toxic.
NO_HIT = -1.0

_WORD = re.compile(r"[^\W_]+(?:[*@$][^\W_]+)*")
_QUOTES = "\"'«»‹›“”„‘’`"
_OPENING, _CLOSING = "\"«“„", "\"»”“"
#: Words that report or mention, and words that address somebody, in the languages of the corpus. Fixed values.
_REPORTING = frozenset("said says wrote called calls quote quoted quotes word words term terms phrase insult insults slur reported alleged sagte schrieb nannte wort zitat dit écrit appelé mot citation dijo escribió llamó palabra cita".split())
_ADDRESS = frozenset("you your youre du dich dir dein ihr tu toi ton vous votre tú usted tuyo".split())


def edits_of(term: str, stem: bool) -> int:
    """Edits that a term may have: none for short ones, since too many other words are near."""
    n = len(term)
    if stem:
        return int(n >= 7)
    return 0 if n < 5 else 1 if n < 9 else 2


@dataclass(frozen=True, order=True)
class Term:
    """A word, or a stem that any ending may follow; the edits it may have and the weight of a hit."""

    text: str
    stem: bool
    edits: int
    weight: float = 1.0


class Lexicon:
    """Trie of terms and its lazily built deterministic product with Levenshtein automata.

    A product state is a set of (trie node, edits, letter that a swap still owes); edits are insertion,
    deletion, substitution and swap of neighbours.
    """

    def __init__(self, terms: Iterable[Term]):
        self.children: list[dict[str, int]] = [{}]
        self.bound: list[int] = [0]  # most edits of any term below
        self.words: list[Term | None] = [None]  # the term that ends at a node, as a whole word or as a stem
        self.stems: list[Term | None] = [None]
        for term in sorted(set(terms)):
            node = 0
            self.bound[0] = max(self.bound[0], term.edits)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.bound.append(0)
                    self.words.append(None)
                    self.stems.append(None)
                node = self.children[node][c]
                self.bound[node] = max(self.bound[node], term.edits)
            (self.stems if term.stem else self.words)[node] = term
        self.reset()

    def reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.whole: list[tuple[float, bool]] = []  # weight if a word ends in a state, and whether exactly
        self.sticky: list[tuple[float, bool]] = []  # the same whatever follows
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set[tuple[int, int, str]]) -> int:
        todo, best = list(items), {}
        while todo:  # deletions: a letter of the term is missing
            node, e, owed = todo.pop()
            if e > self.bound[node] or best.get((node, owed), 99) <= e:
                continue
            best[(node, owed)] = e
            if not owed and e < self.bound[node]:
                todo += [(child, e + 1, "") for child in self.children[node].values()]
        key = frozenset((n, e, o) for (n, o), e in best.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            for ends, out in ((self.words, self.whole), (self.stems, self.sticky)):
                met = [(t.weight * (FUZZY if e else 1.0), not e) for n, e, o in key if not o and (t := ends[n]) and e <= t.edits]
                out.append(max(met, default=(0.0, False)))
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        after: set[tuple[int, int, str]] = set()
        for node, e, owed in self.states[state]:
            if owed:
                if c == owed:
                    after.add((node, e, ""))
                continue
            for letter, child in self.children[node].items():
                if letter == c:
                    after.add((child, e, ""))
                else:
                    after.add((child, e + 1, ""))
                    if c in self.children[child]:  # the two letters are swapped
                        after.add((self.children[child][c], e + 1, letter))
            after.add((node, e + 1, ""))
        out = self._state(after)
        self.moves[state][c] = out
        return out

    def find(self, word: str) -> tuple[float, bool]:
        """Weight of the best term that the word is or nearly is, and whether it is that term exactly."""
        state = self.start
        best = self.sticky[state]
        for c in word:
            moves = self.moves[state]
            state = moves[c] if c in moves else self._move(state, c)
            if not self.states[state]:
                return best
            if self.sticky[state] > best:
                best = self.sticky[state]
        return max(best, self.whole[state])


@dataclass
class Model:
    """Terms, words that are near a term but innocent, and the weights of the logistic curve."""

    terms: list[Term]
    innocent: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (2.0, 0.3, -2.0)
    _lexicon: Lexicon | None = field(default=None, repr=False)
    _weights: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "innocent": self.innocent, "curve": self.curve, "_lexicon": None, "_weights": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def weight(self, word: str) -> float:
        """Weight of a word as a hit, 0 if it is none; kept by word in this process."""
        known = self._weights
        w = known.get(word)
        if w is None:
            if self._lexicon is None:
                self._lexicon = Lexicon(self.terms)
            if len(known) >= CACHE_WORDS:
                known.clear()
            if len(self._lexicon.states) > 100_000:
                self._lexicon.reset()
            w, exact = self._lexicon.find(word)
            known[word] = w = 0.0 if not exact and word in self.innocent else w
        return w

    def hits(self, text: str) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Words of a lower-cased text, and (first character, end, weight, factor of the context) of every hit."""
        words = _WORD.findall(text)
        known, found = self._weights, False
        for word in set(words):
            w = known.get(word)
            if w is None:
                w = self.weight(word)
            if w:
                found = True
        if not found:
            return len(words), []
        out = []
        for i, m in enumerate(_WORD.finditer(text)):
            if w := self.weight(words[i]):
                out.append((m.start(), m.end(), w, self._context(text, words, i, m)))
        return len(words), out

    @staticmethod
    def _context(text: str, words: list[str], i: int, m: re.Match) -> float:
        """Weight of a hit's surroundings: quoted or mentioned, addressed to somebody, or neither."""
        near = words[max(0, i - CONTEXT) : i] + words[i + 1 : i + 1 + CONTEXT]
        before, after = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 40]
        quoted = before[-1:] in _QUOTES and after[:1] in _QUOTES if before[-1:] and after[:1] else False
        if not quoted:
            opened = max(before.rfind(q) for q in _OPENING)
            closed = [k for q in _CLOSING if (k := after.find(q)) >= 0]
            quoted = opened >= 0 and bool(closed) and "\n" not in before[opened:] + after[: min(closed)]
        if quoted or not _REPORTING.isdisjoint(near):
            return QUOTED
        return ADDRESSED if not _ADDRESS.isdisjoint(near) else 1.0

    def of(self, words: int, hits: list[tuple[int, int, float, float]]) -> float:
        """Score of a text with that many words and those hits."""
        x = _features(words, sum(w * f for *_, w, f in hits))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(self.curve, x, strict=True))))))

    def score(self, text: str | None) -> float:
        return self.of(*self.hits((text or "").lower()))


def _features(words: int, mass: float) -> tuple[float, float, float]:
    """What the curve sees: the hits' weight, their weight for each thousand words, and a constant."""
    return math.log1p(mass), math.log1p(1000 * mass / (words + 100)), 1.0


# --- training -----------------------------------------------------------------------------------
#
# Training texts stay on the executors. The driver sees, of at most TRAIN_TOXIC + TRAIN_CLEAN documents, a
# sketch of SKETCH hashes and three numbers each, and counts of the candidate terms.

#: Features whose counts a task holds before it sends them on.
HELD_FEATURES = 1_000_000
SKETCH = 32
#: Shortest and longest words that are learned whole, and shortest and longest stems.
WHOLE, STEM = (3, 24), (4, 10)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, toxic, text) of a bounded number of labelled documents outside the held-out fifth, by hash of their ids."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").where(crc_of_id() % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    picked = marked.where("__toxic = 1").orderBy(order, "doc_id").limit(TRAIN_TOXIC).unionAll(marked.where("__toxic = 0").orderBy(order, "doc_id").limit(TRAIN_CLEAN))
    # at most TRAIN_TOXIC + TRAIN_CLEAN ids, so sending them to all workers is safe at any size
    met = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("__toxic").cast("int").alias("toxic"), F.min("text").alias("text"))
    return met.select(F.xxhash64("doc_id").alias("id"), "toxic", "text")


def features(words: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """What may become a term: whole words, and stems (their first letters)."""
    for w in words:
        if WHOLE[0] <= len(w) <= WHOLE[1]:
            yield w, False
        for k in range(STEM[0], min(len(w), STEM[1]) + 1):
            yield w[:k], True


def _scanned(rows: DataFrame, kept: frozenset[int] | None, schema: str, scan: Callable[[Iterator[tuple[int, int, str]]], Iterator[tuple]]) -> DataFrame:
    """Rows that ``scan`` makes of the kept training documents (id, toxic, lower-cased text) of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, int, str]]:
            for b in batches:
                for i in range(b.num_rows):
                    if kept is None or b.column(0)[i].as_py() in kept:
                        yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py().lower()

        found: list[tuple] = []
        for row in scan(each()):
            found.append(row)
            if len(found) >= 10_000:
                yield _batch(found)
                found = []
        if found:
            yield _batch(found)

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}[x.split()[1]] for x in schema.split(", ")]

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return map_text(rows, run, schema)


def distinct_enough(sketches: list[tuple[int, int, list[int]]]) -> frozenset[int]:
    """Ids of the documents (toxic, id, sketch) that are no near copies of earlier ones."""
    seen: set[int] = set()
    out = []
    for _, i, runs in sorted(sketches):
        known = sum(h in seen for h in runs)
        seen.update(runs)
        if known * 4 <= len(runs):
            out.append(i)
    return frozenset(out)


def _sketches(each: Iterator[tuple[int, int, str]]) -> Iterator[tuple]:
    for i, toxic, text in each:
        words = _WORD.findall(text)
        yield toxic, i, sorted({xxhash.xxh3_64_intdigest(" ".join(words[k : k + 4])) >> 1 for k in range(max(1, len(words) - 3))})[:SKETCH]


def _toxic_counts(each: Iterator[tuple[int, int, str]]) -> Iterator[tuple]:
    """(term, stem, documents) of the toxic documents."""
    counts: Counter = Counter()
    for _, toxic, text in each:
        if toxic:
            counts.update(set(features(set(_WORD.findall(text)))))
            if len(counts) >= HELD_FEATURES:
                yield from ((*f, n) for f, n in counts.items())
                counts.clear()
    yield from ((*f, n) for f, n in counts.items())


@dataclass
class Evidence:
    """Counts of candidate terms: toxic documents that hold each, clean documents, places in either, words of either."""

    held: list[set[int]]
    clean: np.ndarray
    places: tuple[np.ndarray, np.ndarray]
    words: tuple[int, int]
    documents: tuple[int, int]


def _evidence(rows: DataFrame, kept: frozenset[int], candidates: list[tuple[str, bool]], documents: tuple[int, int]) -> Evidence:
    number = {f: i for i, f in enumerate(candidates)}
    sent = rows.sparkSession.sparkContext.broadcast(number)

    def scan(each: Iterator[tuple[int, int, str]]) -> Iterator[tuple]:
        at, sums, total, n = sent.value, np.zeros((3, len(sent.value)), np.int64), [0, 0], 0
        for _, toxic, text in each:
            words = _WORD.findall(text)
            total[toxic] += len(words)
            own: set[int] = set()
            for w, k in Counter(words).items():
                for f in features((w,)):
                    if (i := at.get(f)) is not None:
                        sums[1 if toxic else 2, i] += k
                        own.add(i)
            n += 1
            if toxic:
                yield 1, sorted(own), None, None, None
            else:
                sums[0, list(own)] += 1
        if n:
            yield 0, total, *sums.tolist()

    out = Evidence([set() for _ in candidates], np.zeros(len(candidates), np.int64), (np.zeros(len(candidates), np.int64), np.zeros(len(candidates), np.int64)), (0, 0), documents)
    document = 0
    for r in _scanned(rows, kept, "one int, own array<long>, clean array<long>, toxic_places array<long>, clean_places array<long>", scan).collect():
        if r.one:
            for i in r.own:
                out.held[i].add(document)
            document += 1
        else:
            out.words = (out.words[0] + r.own[1], out.words[1] + r.own[0])
            out.clean += np.array(r.clean, np.int64)
            out.places[0][:] += np.array(r.toxic_places, np.int64)
            out.places[1][:] += np.array(r.clean_places, np.int64)
    return out


def chosen_terms(candidates: list[tuple[str, bool]], e: Evidence) -> list[Term]:
    """Words and stems that tell toxic documents; of a family of prefixes the longest that loses no document."""
    toxic, clean = e.documents
    at = {f: i for i, f in enumerate(candidates)}
    n, against = {f: len(e.held[at[f]]) for f in candidates}, {f: int(e.clean[at[f]]) for f in candidates}

    def telling(n: int, m: int) -> float:
        return (n / toxic) / (n / toxic + (m + 0.05) / max(1, clean))

    good = sorted((f for f in candidates if telling(n[f], against[f]) >= PRECISION), key=lambda f: (-n[f], f[1], -len(f[0]), f[0]))
    chosen: list[tuple[str, bool]] = []
    for f in good:
        if any(t[1] and f[0].startswith(t[0]) for t in chosen):
            continue
        # a wider stem must be as telling in what it adds to the terms that it holds
        within = [t for t in chosen if t[0].startswith(f[0])]
        more = len(e.held[at[f]] - set().union(*(e.held[at[t]] for t in within)))
        more_clean = max(0, against[f] - sum(against[t] for t in within))
        if more >= _least(toxic) and telling(more, more_clean) >= PRECISION:
            chosen = [t for t in chosen if not (f[1] and t[0].startswith(f[0]))] + [f]
    ratio = {f: (e.places[0][at[f]] / (e.words[0] + 1)) / ((e.places[1][at[f]] + 0.5) / (e.words[1] + 1)) for f in chosen}
    return sorted(Term(*f, edits_of(*f), min(1.0, math.log(ratio[f]) / FULL)) for f in chosen if ratio[f] >= LEAST_RATIO)


def _least(toxic: int) -> float:
    return max(LEAST_DOCS, LEAST_SHARE * toxic)


def without_neighbours(terms: list[Term], near: Iterable[str]) -> list[Term]:
    """The terms, without edits for those that many of the clean words ``near`` are near to."""
    out = []
    for t in terms:
        alone = Lexicon([t])
        many = t.edits and sum(alone.find(w)[0] > 0 for w in near) > MOST_NEAR
        out.append(Term(t.text, t.stem, 0, t.weight) if many else t)
    return sorted(out)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn terms, innocent neighbours and the curve from a bounded number of labelled documents.

    Without a toxic label there are no terms, and every score is that of no hits; empty tables are no error.
    Repeated labels of a document count as their largest, repeated documents as one. Words shorter than 3 or
    longer than 24 letters are learned by their stems alone.
    """
    prepare(docs.sparkSession)
    rows = materialise(training_rows(docs, labels).repartition(docs.sparkSession.sparkContext.defaultParallelism))
    sketches = [(r.toxic, r.id, r.runs) for r in _scanned(rows, None, "toxic int, id long, runs array<long>", _sketches).collect()]
    kept = distinct_enough(sketches)
    toxic = sum(y for y, i, _ in sketches if i in kept)
    if not toxic:
        return Model([])
    counted = _scanned(rows, kept, "term string, stem boolean, n long", _toxic_counts).groupBy("term", "stem").agg(F.sum("n").alias("n")).where(F.col("n") >= _least(toxic))
    candidates = sorted((r.term, r.stem) for r in counted.collect())
    terms = chosen_terms(candidates, _evidence(rows, kept, candidates, (toxic, len(kept) - toxic)))
    model = Model(terms)

    def near_words(each: Iterator[tuple[int, int, str]]) -> Iterator[tuple]:
        lexicon, seen = Lexicon(terms), set()
        for _, y, text in each:
            if not y:
                fresh = set(_WORD.findall(text)) - seen
                seen |= fresh
                yield from ((w,) for w in fresh if (x := lexicon.find(w))[0] and not x[1])

    near = [r.word for r in _scanned(rows, kept, "word string", near_words).distinct().collect()] if terms else []
    model = Model(without_neighbours(terms, near))
    lexicon = Lexicon(model.terms)
    model.innocent = frozenset(w for w in near if (x := lexicon.find(w))[0] and not x[1])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def points(each: Iterator[tuple[int, int, str]]) -> Iterator[tuple]:
        for _, y, text in each:
            n, hits = sent.value.hits(text)
            yield y, n, sum(w * f for *_, w, f in hits)

    if model.terms and toxic < len(kept):
        found = [(r.y, r.n, r.mass) for r in _scanned(rows, kept, "y int, n long, mass double", points).collect()]
        a, b, c = _curve(sorted(found))
        model.curve = (a, b, min(c, NO_HIT))
    return model


def _curve(points: list[tuple[int, int, float]]) -> tuple[float, float, float]:
    """Weights of a logistic regression of the label on the features, classes weighed equally, with a slight ridge."""
    y = np.array([p[0] for p in points], float)
    x = np.array([_features(n, mass) for _, n, mass in points])
    sample = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    ridge = RIDGE * np.diag([1.0, 1.0, 0.0])
    beta = np.zeros(3)

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(sample @ (np.logaddexp(0, z) - y * z) + b @ ridge @ b / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (sample * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(3), x.T @ (sample * (p - y)) + ridge @ beta)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return tuple(beta.tolist())


# --- applying -----------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, with_hits: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every document (and its hits on request).

    Null and empty texts have no hits and get the score of that. Each row is scored by itself, so repeated
    rows are scored each and further columns do no harm; a null doc_id counts as empty text for the held-out
    rule; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("weight", pa.float64()), ("context", pa.float64())]))
        for b in batches:
            scores, hits = [], []
            for text in b.column(2):
                words, found = m.hits((text.as_py() or "").lower())
                scores.append(m.of(words, found))
                if with_hits:
                    hits.append([{"first": a, "end": e, "weight": w, "context": f} for a, e, w, f in found])
            columns = [b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(hits, kind)] * with_hits, names=["doc_id", "held_out", "score", "predicted"] + ["hits"] * with_hits)

    rows = docs.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int" + ", hits array<struct<first:long,end:long,weight:double,context:double>>" * with_hits)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all their columns, that are not predicted toxic."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([sent.value.score(t.as_py()) < 0.5 for t in b.column(at)], pa.bool_()))

    return map_text(docs, run, docs.schema)
