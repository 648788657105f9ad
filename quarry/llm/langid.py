"""Language identification: scripts narrow the candidates, then Viterbi labels spans of mixed-language text.

Every word has one score for each language (character n-grams, learned from labelled documents). The best
labelling of a text maximises the sum of the words' scores less a penalty for each change of language.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_of_id, map_text, prepare

#: Training documents of each language, at most (about; a share is taken by hash of ids).
TRAIN_DOCS = 1500
#: n-gram orders of the word model, and what each gram counts before it is seen.
ORDERS, PRIOR = (1, 2, 3, 4), 0.5
#: What a change of language costs, in nats.
SWITCH = 12.0
#: Share of a language's training words that a script needs to count as one of its scripts.
SCRIPT_SHARE = 0.02
#: Characters of a word, at most. A longer run of letters is cut into consecutive words of one script each.
WORD = 32
CACHE_WORDS = 400_000
UNKNOWN = "und"

#: First code point, end and name of scripts. Fixed values.
SCRIPTS = (
    (0x0041, 0x0250, "latin"), (0x0370, 0x0400, "greek"), (0x0400, 0x0530, "cyrillic"), (0x0530, 0x0590, "armenian"),
    (0x0590, 0x0600, "hebrew"), (0x0600, 0x0780, "arabic"), (0x0900, 0x0980, "devanagari"), (0x0980, 0x0A00, "bengali"),
    (0x0B80, 0x0C00, "tamil"), (0x0E00, 0x0E80, "thai"), (0x10A0, 0x1100, "georgian"), (0x1100, 0x1200, "hangul"),
    (0x1E00, 0x1F00, "latin"), (0x1F00, 0x2000, "greek"), (0x3040, 0x3100, "kana"), (0x3400, 0xA000, "han"),
    (0xAC00, 0xD7B0, "hangul"), (0xF900, 0xFB00, "han"), (0x20000, 0x32000, "han"),
)
_NAMES = ["other", *dict.fromkeys(name for _, _, name in SCRIPTS)]
#: Where the script of a code point changes, and the script from there on, as an index of _NAMES.
_BORDERS = np.array([x for start, end, _ in SCRIPTS for x in (start, end)])
_FROM = np.array([0, *(i for _, _, name in SCRIPTS for i in (_NAMES.index(name), 0))])


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """Index of the script of each code point in _NAMES; 0 for one of no listed script."""
    return _FROM[np.searchsorted(_BORDERS, codes, "right")]


def _class(codes: np.ndarray) -> str:
    """Code points as the inside of a character class."""
    cuts = np.flatnonzero(np.diff(codes) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[np.r_[0, cuts + 1]], codes[np.r_[cuts, len(codes) - 1]], strict=True))


def _word_patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Words: letters of one script (Unicode's categories L), with the marks (M) that follow them.

    The second pattern finds the same words in texts without a match of the third, in less time.
    """
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    marks = _class(np.flatnonzero(kinds == "M"))
    letters = np.flatnonzero(kinds == "L")
    script = scripts_of(letters)
    latin = _class(letters[letters < 0x250])
    return re.compile("|".join(f"[{x}][{x}{marks}]{{0,{WORD - 1}}}" for i in sorted(set(script.tolist())) for x in [_class(letters[script == i])])), re.compile(f"[{latin}]{{1,{WORD}}}"), re.compile("[^\0-\u024f\u2000-\u206f]")


_WORD, _LATIN_WORD, _FURTHER = _word_patterns()


def words_of(text: str) -> list[str]:
    """Words of the lower-cased text; every letter is in one."""
    text = text.lower()
    return (_WORD if _FURTHER.search(text) else _LATIN_WORD).findall(text)


def script_of(word: str) -> str:
    return _NAMES[int(scripts_of(np.array([ord(word[0])]))[0])]


def grams_of(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for n in ORDERS for i in range(len(padded) - n + 1)]


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points from each place on."""
    size = max(0, len(codes) - n + 1)
    h = np.full(size, n, np.uint64)
    for j in range(n):
        h = (h * _STEP) + codes[j : j + size]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class GramTable:
    """Rows of grams by hash: buckets by the first bits, each with a few hashes."""

    def __init__(self, grams: list[str]):
        by_order: dict[int, list[int]] = {}
        for i, g in enumerate(grams):
            by_order.setdefault(len(g), []).append(i)
        hashes, rows = np.zeros(len(grams), np.uint64), np.zeros(len(grams), np.int32)
        at = 0
        for n, some in by_order.items():
            codes = np.frombuffer("".join(grams[i] for i in some).encode("utf-32-le"), np.uint32).astype(np.uint64)
            hashes[at : at + len(some)] = _gram_hashes(codes, n)[::n]
            rows[at : at + len(some)] = np.array(some) + 1
            at += len(some)
        self.bits = np.uint64(64 - max(4, int(8 * max(1, len(grams))).bit_length()))
        order = np.argsort(hashes)
        bucket = hashes[order] >> self.bits
        self.first = np.searchsorted(bucket, np.arange((1 << int(64 - self.bits)) + 1, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max(initial=0))
        self.hashes, self.rows = np.append(hashes[order], np.zeros(self.deepest + 1, np.uint64)), np.append(rows[order], np.zeros(self.deepest + 1, np.int32))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, 0 if no gram has it."""
        bucket = (hashes >> self.bits).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.where((self.hashes[at] == hashes) & (at < end), self.rows[at], 0)
        left = np.flatnonzero((out == 0) & (end - at > 1))
        for d in range(1, self.deepest):
            if not len(left):
                break
            here = at[left] + d
            out[left] = np.where((self.hashes[here] == hashes[left]) & (here < end[left]), self.rows[here], 0)
            left = left[(out[left] == 0) & (end[left] - at[left] > d + 1)]
        return out


class Model:
    """Gram scores by language; ``scripts`` lists each language's scripts."""

    def __init__(self, languages: list[str], scripts: list[frozenset[str]], grams: list[str], scores: np.ndarray):
        self.languages, self.scripts, self.grams = languages, scripts, grams
        #: Row 0, of a gram that no language has, says nothing.
        self.scores = np.concatenate([np.zeros((1, len(languages)), np.float32), scores.reshape(len(grams), len(languages)).astype(np.float32)])
        self._open()

    def _open(self) -> None:
        self._table_of_grams = GramTable(self.grams)
        self._rows: dict[str, int] = {}
        self._table = np.zeros((0, len(self.languages) + 1), np.float32)
        self._may = np.array([[name in s for s in self.scripts] for name in _NAMES]).reshape(len(_NAMES), -1)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "scripts": self.scripts, "grams": self.grams, "scores": self.scores}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of words in each language, 0 for the best; one more column: 1 if some language has the script.

        Languages without a word's script are no candidates, unless none has it: then all score 0.
        """
        k = len(self.languages)
        out = np.zeros((len(words), k + 1), np.float32)
        if not words or not k:
            return out
        codes = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le"), np.uint32).astype(np.uint64)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
        begin = np.r_[0, end[:-1]]
        at_place = np.zeros((len(codes), k), np.float32)
        for n in ORDERS:
            row = self._table_of_grams.find(_gram_hashes(codes, n))
            for back in range(1, n):  # grams that would run over the word's end
                row[np.minimum(end - back, len(row) - 1)[end - back < len(row)]] = 0
            at_place[: len(row)] += self.scores[row]
        total = np.add.reduceat(at_place, begin, axis=0) / len(ORDERS)
        allowed = self._may[scripts_of(codes[begin + 1])]
        some = allowed.any(axis=1)
        total = np.where(allowed, total, -np.inf)
        total[some] -= total[some].max(axis=1, keepdims=True)
        # one odd word must not decide a text
        out[:, :k] = np.where(some[:, None], np.maximum(total, -SWITCH), 0)
        out[:, k] = some
        return out

    def rows(self, words: list[str]) -> np.ndarray:
        """Scores of words, one row each; kept by word in this process."""
        known = self._rows
        missing = [w for w in dict.fromkeys(words) if w not in known]
        if missing:
            if len(known) + len(missing) > CACHE_WORDS:
                known.clear()
                missing = list(dict.fromkeys(words))
            first, end = len(known), len(known) + len(missing)
            if end > len(self._table):
                self._table = np.concatenate([self._table[:first], np.zeros((max(4096, 2 * end) - first, len(self.languages) + 1), np.float32)])
            for i in range(0, len(missing), 4096):
                self._table[first + i : first + i + 4096][: len(missing) - i] = self.word_scores(missing[i : i + 4096])
            known.update(zip(missing, range(first, end), strict=True))
        return self._table[list(map(known.__getitem__, words))]

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(first word, end word, index of the language) of the best labelling."""
        words = words_of(text or "")
        if not words or not self.languages:
            return []
        return label(self.rows(words)[:, :-1].astype(np.float64))

    def identify(self, text: str | None) -> tuple[str, float]:
        """Language with most letters on the best labelling, and their share of the text's.

        Letters of words in a script that no language has count for none of them.
        """
        words = words_of(text or "")
        if not words or not self.languages:
            return UNKNOWN, 0.0
        table = self.rows(words)
        size = np.fromiter(map(len, words), np.float64, len(words))
        certain = np.zeros(len(words) + 1)
        np.cumsum(size * table[:, -1], out=certain[1:])
        letters = np.zeros(len(self.languages))
        for a, b, k in label(table[:, :-1].astype(np.float64)):
            letters[k] += certain[b] - certain[a]
        best = int(letters.argmax())
        return self.languages[best], float(min(1.0, letters[best] / size.sum()))


def label(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """Viterbi spans over word scores (words x languages) with SWITCH for each change.

    A constant labelling is known to be best if no run of words gains SWITCH or more by leaving it, even
    if words in the run could change freely; that is checked first, as it holds for most texts.
    """
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    if k == 1 or n == 0:
        return [(0, n, best)] if n else []
    others = np.delete(scores, best, axis=1).max(axis=1) - scores[:, best]
    gain = np.cumsum(others)
    low = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
    if (gain - low).max() <= SWITCH:
        return [(0, n, best)]
    back: list[list[bool]] = []  # was the language changed to before this word?
    tops: list[int] = []
    value = scores[0].tolist()
    tops.append(value.index(max(value)))
    for row in scores[1:].tolist():
        top = tops[-1]
        floor = value[top] - SWITCH
        changed = [v < floor for v in value]
        value = [r + (floor if c else v) for r, c, v in zip(row, changed, value, strict=True)]
        back.append(changed)
        tops.append(value.index(max(value)))
    at, end, out = tops[-1], n, []
    for i in range(n - 1, 0, -1):
        if back[i - 1][at]:
            out.append((i, end, at))
            at, end = tops[i - 1], i
    out.append((0, end, at))
    return out[::-1]


# --- training -----------------------------------------------------------------------------------


def training_rows(docs: DataFrame) -> DataFrame:
    """(lang, text) of about TRAIN_DOCS documents of each language, outside the held-out quarter, by hash of ids."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(crc_of_id() % 4 != 2)
    # one count for each language: as many as the model has columns, so the driver and all workers hold them anyway
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    shares = [(r.lang, math.ceil(1e6 * min(1.0, TRAIN_DOCS / r.n))) for r in counts.collect()]
    share = docs.sparkSession.createDataFrame(shares, "lang string, __share int")
    taken = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1_000_000)) < F.col("__share")
    return known.select("doc_id", "lang", "text").join(F.broadcast(share), "lang").where(taken).select("lang", "text")


def fit(docs: DataFrame) -> Model:
    """Learn the gram scores. Counts of a training document's distinct words are made on the executors."""
    rows = training_rows(docs)
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(set(words_of(text)))
        for lang, words in found.items():
            grams: Counter = Counter()
            for w, n in words.items():
                for g in grams_of(w):
                    grams["g" + g] += n
                grams["s" + script_of(w)] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = map_text(rows, count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n >= 2 or gram like 's%'")
    return build([(r.lang, r.gram, r.n) for r in counted.collect()])


def build(counts: list[tuple[str, str, int]]) -> Model:
    """A model from (language, 'g' + gram or 's' + script, count)."""
    languages = sorted({x for x, _, _ in counts})
    at = {x: i for i, x in enumerate(languages)}
    k = len(languages)
    scripts = [Counter() for _ in languages]
    totals = np.zeros((max(ORDERS) + 1, max(1, k)))
    raw: dict[str, np.ndarray] = {}
    for lang, key, n in counts:
        if key[0] == "s":
            scripts[at[lang]][key[1:]] += n
        else:
            g = sys.intern(key[1:])
            raw.setdefault(g, np.zeros(k))[at[lang]] += n
            totals[len(g), at[lang]] += n
    sizes = Counter(map(len, raw))
    scores = np.array([np.log(c + PRIOR) - np.log(totals[len(g)] + PRIOR * sizes[len(g)]) for g, c in raw.items()])
    return Model(languages, [frozenset(s for s, n in c.items() if n >= SCRIPT_SHARE * sum(c.values())) for c in scripts], list(raw), scores)


# --- applying -----------------------------------------------------------------------------------


def identify(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document (and spans of words on request).

    ``und`` with score 0 if the text is null or has no letter (Unicode's categories L). A text in a script of
    no learned language gets some learned language with score 0. Each row is judged by its whole text alone,
    so repeated rows get the same result each and columns beside doc_id and text do no harm; a null doc_id
    counts as empty text for the held-out rule. Long runs of letters without spaces are cut into words of
    at most ``WORD`` characters, all of which are scored. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for b in batches:
            texts = [t.as_py() for t in b.column(2)]
            found = [m.identify(t) for t in texts]
            columns = [b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            if with_spans:
                columns.append(pa.array([[{"first": a, "end": e, "lang": m.languages[k]} for a, e, k in m.spans(t)] for t in texts], kind))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"] + ["spans"] * with_spans)

    rows = docs.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(rows, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double" + ", spans array<struct<first:long,end:long,lang:string>>" * with_spans)


def keep_known(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents, all their columns, of which ``least`` of the letters at least are in their main language."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([(x := sent.value.identify(t.as_py()))[0] != UNKNOWN and x[1] >= least for t in b.column(at)], pa.bool_()))

    return map_text(docs, run, docs.schema)
