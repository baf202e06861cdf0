"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

A document is contaminated by a benchmark item when some stretch of its words is within
``MAX_EDIT`` of the item in word edit distance (insertions, deletions and replacements,
divided by the item's words).  Words are runs of letters and digits, lower-cased; in scripts without
spaces between words every character is one.

1. Windows.  Every word of every document begins a window of the size of each item
   length class.  An edit changes two pairs of neighbouring words at most, so a window
   within the distance still holds ``n - 1 - 2 * edits`` of an item's pairs; windows with
   fewer pairs of the benchmark are skipped.  That loses none within the distance.
2. CGK embedding.  A walk over the window reads one word per step and moves on by a
   random bit of (step, word); the words read are the embedding.  Two windows at a small
   edit distance read the same words at most steps, so edit distance becomes Hamming
   distance.
3. Bit sampling.  Each of ``TABLES`` independent walks is sampled at ``SAMPLED`` steps;
   equal samples make (window, item) a candidate.  ``TABLES`` is set for a recall of at
   least 0.95 at the largest distance (``tests/llm`` measures it).
4. Every candidate is verified by the exact edit distance of the item to the best
   stretch around the window.

The benchmark is the small side: it is taken in slices of at most ``SLICE_WORDS`` words,
one pass over the documents per slice, so that a slice's tables fit every task.  Documents
are not shuffled; texts are handled in batches of about ``BATCH_WORDS`` words.

5. Items with fewer than ``MIN_WORDS`` words stand in clean texts by chance.  They are found word for
   word and marked ``short``; ``clean`` drops a document for them only where it is nothing but the item.

Defined cases: null and empty texts match nothing; neither do items without words (null and empty ones too);
repeated documents are reported once per row, repeated items once per item_id; a null
doc_id stays null, a null item_id is reported as null; extra columns pass through
``clean``; an empty documents or benchmark table gives no findings.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsift.sources.tables import read_table

MAX_EDIT = 0.2
MIN_WORDS = 5
TABLES, SAMPLED = 32, 3
SLICE_WORDS = 1_000_000
#: a length class holds items from its length to this many times it
CLASS_STEP = 1.15
#: marks kept per pair of neighbouring words, as a power of two, and the most marks
PAIR_SPARE, PAIR_BITS = 6, 24
#: windows embedded at once, and words handled at once (a longer text is taken alone)
CHUNK, BATCH_WORDS = 1024, 1_000_000
#: scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana and Han characters
_SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD, SPACELESS = re.compile(r"[^\W_]+"), re.compile(f"[{_SPACELESS}]")
MIXED = re.compile(rf"[{_SPACELESS}]|(?:(?![{_SPACELESS}])[^\W_])+")
HITS = "array<struct<item_id:long,start_word:int,edits:int,item_words:int>>"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    return (MIXED if SPACELESS.search(low) else WORD).findall(low)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _chain(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each place on."""
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for j in range(n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[j:len(codes) - n + 1 + j])
    return h


def allowed(n: int) -> int:
    return int(MAX_EDIT * n + 1e-9)


class Walks:
    """``TABLES`` random walks of one length class and the steps at which each is sampled."""

    def __init__(self, least: int, rng: np.random.Generator):
        # early steps only: all items of the class have words left there
        self.steps = [rng.choice(max(SAMPLED, int(1.5 * least)), SAMPLED, replace=False) for _ in range(TABLES)]
        self.length = int(max(map(max, self.steps))) + 1
        self.sampled = [np.array([t for t in range(TABLES) if j in self.steps[t]]) for j in range(self.length)]
        self.add, self.times = (rng.integers(0, 2**63, (TABLES, self.length, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
                                for _ in range(2))

    def samples(self, codes: np.ndarray) -> np.ndarray:
        """Per walk and row of ``codes`` (windows, one row each): a hash of the words that the walk
        reads at its sampled steps.  A walk that leaves its window reads 0."""
        n, width = codes.shape
        flat = np.zeros((n, width + self.length), np.uint64)
        flat[:, :width] = codes
        flat = flat.ravel()
        at = np.repeat((np.arange(n) * (width + self.length))[None, :], TABLES, axis=0)
        key = np.repeat(np.arange(1, TABLES + 1, dtype=np.uint64)[:, None], n, axis=1)
        for j in range(self.length):
            word = flat.take(at)
            own = self.sampled[j]
            if len(own):
                key[own] = _mix(key[own] * np.uint64(0x9E3779B97F4A7C15) + word[own])
            # the walk moves on by a random bit of (walk, step, word)
            word += self.add[:, j]
            word *= self.times[:, j]
            word >>= np.uint64(63)
            at += word.view(np.int64)
        return key


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edits, start) of the stretch of ``text`` with the least edit distance to ``item``."""
    n = len(text)
    steps = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), steps.copy()
    for w in item:
        moved = np.empty(n + 1, np.int64)
        moved_start = np.empty(n + 1, np.int64)
        diagonal = cost[:-1] + (text != w)
        up = cost + 1
        moved[0], moved_start[0] = up[0], start[0]
        take = diagonal <= up[1:]
        moved[1:] = np.where(take, diagonal, up[1:])
        moved_start[1:] = np.where(take, start[:-1], start[1:])
        # insertions: the least of all cells to the left plus the distance
        level = moved - steps
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, steps, 0))
        cost, start = low + steps, moved_start[source]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end])


class Index:
    """Word codes and hash tables of one slice of items."""

    def __init__(self, items: list[tuple[int, list[str]]], seed: int = 17):
        short = [(i, w) for i, w in items if 0 < len(w) < MIN_WORDS]
        self.items = [(i, w) for i, w in items if len(w) >= MIN_WORDS]
        self.codes = {x: xxhash.xxh3_64_intdigest(x.encode()) | 1 for x in {x for _, w in self.items + short for x in w}}
        self.short: dict[int, dict[tuple, list]] = {}  # by number of words: the items with these words
        for i, w in short:
            self.short.setdefault(len(w), {}).setdefault(tuple(self.codes[x] for x in w), []).append(i)
        self.coded = [np.array([self.codes[x] for x in w], np.uint64) for _, w in self.items]
        self.short_keys = {n: np.array(sorted(int(_chain(np.array(w, np.uint64), n)[0]) for w in of), np.uint64) for n, of in self.short.items()}
        # pairs of neighbouring words, by hash; a false mark only lets a window through
        bits = max(16, min(PAIR_BITS, sum(map(len, self.coded)).bit_length() + PAIR_SPARE))
        self.pairs, self.shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
        for c in self.coded:
            self.pairs[self._pair(c)] = True
        rng = np.random.default_rng(seed)
        self.classes = []
        order = sorted(range(len(self.items)), key=lambda k: len(self.coded[k]))
        at = 0
        while at < len(order):
            least = len(self.coded[order[at]])
            end = at
            while end < len(order) and len(self.coded[order[end]]) <= least * CLASS_STEP:
                end += 1
            members = order[at:end]
            longest = len(self.coded[members[-1]])
            need = min(len(self.coded[k]) - 1 - 2 * allowed(len(self.coded[k])) for k in members)
            walks = Walks(least, rng)
            rows = np.stack([np.pad(self.coded[k], (0, longest - len(self.coded[k]))) for k in members])
            tables = []
            for own in walks.samples(rows).tolist():
                keys: dict[int, list[int]] = {}
                for k, key in zip(members, own, strict=True):
                    keys.setdefault(key, []).append(k)
                tables.append((np.array(sorted(keys), np.uint64), keys))
            self.classes.append((longest, longest + allowed(longest), need, walks, tables))
            at = end

    def _pair(self, codes: np.ndarray) -> np.ndarray:
        return (_mix(codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]) >> self.shift).astype(np.int64)

    def find(self, texts) -> list[list[tuple[int, int, int, int]]]:
        """Per text: (item_id, first word, edits, item words) of the best stretch of each item found."""
        out: list = []
        held: list[np.ndarray] = []
        size = 0
        get = self.codes.get
        for t in texts:
            held.append(np.array([get(x, 0) for x in words_of(t)], np.uint64))
            size += len(held[-1])
            if size > BATCH_WORDS:
                out += self._find(held)
                held, size = [], 0
        return out + self._find(held)

    def _find(self, held: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """Windows of several texts at once; unknown words between the texts keep them apart."""
        pad = np.zeros(max((c[1] for c in self.classes), default=0), np.uint64)
        codes = np.concatenate([x for h in held for x in (h, pad)]) if held else pad
        sizes = np.array([len(h) for h in held], np.int64)
        firsts = np.cumsum(sizes + len(pad)) - sizes - len(pad)
        n = len(codes)
        known = self.pairs[self._pair(codes)] & (codes[:-1] != 0) & (codes[1:] != 0)
        before = np.concatenate([[0], np.cumsum(known), [0]])  # known pairs that begin before a place
        before[-1] = before[-2]
        candidates: dict[tuple[int, int], list[int]] = {}
        for longest, width, need, walks, tables in self.classes:
            last = np.minimum(np.arange(n) + width - 1, n - 1)
            starts = np.flatnonzero((before[last] - before[:n] >= need) & (codes != 0))
            for c in range(0, len(starts), CHUNK):
                own = starts[c:c + CHUNK]
                place = own[:, None] + np.arange(longest)
                window = np.where(place < n, codes[np.minimum(place, n - 1)], np.uint64(0))
                doc = np.searchsorted(firsts, own, "right") - 1
                for k, (keys, members) in zip(walks.samples(window), tables, strict=True):
                    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                    for row in np.flatnonzero(keys[at] == k):
                        for item in members[int(k[row])]:
                            candidates.setdefault((int(doc[row]), item), []).append(int(own[row] - firsts[doc[row]]))
        out: list[dict] = [{} for _ in held]
        for (doc, item), places in candidates.items():
            best = self._verify(item, held[doc], sorted(set(places)))
            name = self.items[item][0]
            if best and (name not in out[doc] or best < out[doc][name]):
                out[doc][name] = best
        for name, doc, best in self._find_short(codes, firsts, sizes):
            if name not in out[doc] or best < out[doc][name]:
                out[doc][name] = best
        return [sorted(((i, start, edits, n) for i, (edits, start, n) in o.items()),
                       key=lambda h: (h[0] is None, h[0] or 0, h[1:])) for o in out]

    def _find_short(self, codes: np.ndarray, firsts: np.ndarray, sizes: np.ndarray):
        """(item_id, text, (0, first word, words)) of the first place of every short item in every text."""
        for n, items in self.short.items():
            if len(codes) < n:
                continue
            at = np.flatnonzero(np.isin(_chain(codes, n), self.short_keys[n]))
            doc = np.searchsorted(firsts, at, "right") - 1
            for p, d in zip(at.tolist(), doc.tolist(), strict=True):
                if p - firsts[d] + n <= sizes[d]:
                    for i in items.get(tuple(codes[p:p + n].tolist()), ()):
                        yield i, d, (0, int(p - firsts[d]), n)

    def _verify(self, item: int, codes: np.ndarray, places: list[int]):
        coded = self.coded[item]
        n, most = len(coded), allowed(len(coded))
        best, done = None, -1
        for k, p in enumerate(places):
            if p < done:
                continue
            last = p
            for q in places[k:]:  # windows that overlap are verified together, a bounded stretch at a time
                if q - last > most or q - p > 4 * n:
                    break
                last = q
            low, high = max(0, p - most), min(len(codes), last + n + most)
            done = last + 1
            stretch = codes[low:high]
            if np.isin(stretch, coded).sum() < n - most:
                continue
            edits, start = best_stretch(coded, stretch)
            if edits <= most and (best is None or (edits, low + start, n) < best):
                best = (edits, low + start, n)
        return best


def hits_column(index: Index):
    @F.pandas_udf(HITS)
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("item_id", "start_word", "edits", "item_words"), h, strict=True)) for h in hits]
                          for hits in index.find(texts)], dtype=object)
    return of


def leaks_column(index: Index):
    """Whether a document holds an item, or is nothing but a short one."""
    @F.pandas_udf(T.BooleanType())
    def of(texts: pd.Series) -> pd.Series:
        found = index.find(texts)
        return pd.Series([any(n >= MIN_WORDS or len(words_of(t)) == n for _, _, _, n in hits) for t, hits in zip(texts, found, strict=True)],
                         dtype=bool)
    return of


def slices(benchmark: DataFrame) -> list[Index]:
    """Indexes of the benchmark, ``SLICE_WORDS`` words at most in each (a single item may have more)."""
    total = benchmark.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce(F.col("text"), F.lit("")), " "))), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // SLICE_WORDS))
    out = []
    for p in range(parts):
        rows = benchmark.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == p).select(F.col("item_id").cast("long"), "text").collect()
        index = Index(sorted(((r["item_id"], words_of(r["text"])) for r in rows), key=repr))
        if index.items or index.short:
            out.append(index)
    return out


def findings(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, item_id, start_word, edits, item_words and short of every item found in a row of ``docs``."""
    out = None
    for index in slices(benchmark):
        one = docs.select(*keep, F.explode(hits_column(index)(F.col("text"))).alias("_h")).select(*keep, "_h.*")
        out = one if out is None else out.union(one)
    if out is None:
        none = F.explode(F.array().cast(HITS)).alias("_h")
        out = docs.select(*keep, none).select(*keep, "_h.*")
    return out.withColumn("short", F.col("item_words") < MIN_WORDS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    out = docs
    for index in slices(benchmark):
        out = out.filter(~leaks_column(index)(F.col("text")))
    return out


def op8_contaminated_documents(spark, sf_dir):
    """Every (document, benchmark item) pair within the edit distance, with its place."""
    return findings(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_contaminated_documents": op8_contaminated_documents}
