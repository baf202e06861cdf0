"""Order-preserving packing of token streams by dynamic programming.

The documents of an input partition form one token stream, in the order of the
partition; each document ends with ``END``.  The stream is cut into windows of at most
``WINDOW`` tokens, each of which becomes one sequence.  Cuts stand at the ends of
documents (free), at the ends of sentences (``AT_SENTENCE``) or, where a sentence is long,
inside it (``IN_SENTENCE``).  The cuts minimise padding plus these penalties:

    cost(j) = penalty(j) + min over i with pos(j) - pos(i) <= WINDOW of
              cost(i) + WINDOW - (pos(j) - pos(i))

The minimum of ``cost(i) + pos(i)`` over the sliding range of i is kept in a monotone
queue, so a stream with n cut places takes n steps.  The last window of a partition is
split into powers of two, which need no padding, where that costs less.

A task holds ``HELD`` windows of the stream at a time: it settles them up to the best cut
of the last window and carries the rest on.  Texts are tokenized where they are read and
never shuffled; a partition's sequences depend on that partition alone, so a repeated task
gives the same rows.  Sequence ids are the partition's number and a count.

Tokenizing works by white-space chunks: pre-tokens never reach over white space, so the
ids of a chunk do not depend on its neighbours.  Arrow splits a batch and finds its distinct
chunks, each looked up once; new ones are encoded together (words of letters by the fast call, their ids told apart by the ids that end words; others
by the offsets of their ids) and kept for later batches, in a bounded cache.

Defined cases: null and empty texts have one token, the end; repeated rows are packed each
on their own; a null doc_id stays null; extra columns are ignored; an empty table gives an
empty result.  A document larger than a window is cut like any other stretch.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsift.llm import release_memory
from recsift.sources.tables import read_table

WINDOW, END = 4096, 2
AT_SENTENCE, IN_SENTENCE = 4, 32
#: places to cut inside a long sentence are this far apart
STEP = 32
#: windows held by a task; documents added to the stream at a time; chunks in the cache
HELD, DOCS, CACHE = 64, 128, 1_000_000
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
SIGNS = frozenset(".,;:!?")
PLAIN, SIGNED = "^[a-z]+[.,;:!?]?$", "[.,;:!?]$"
DOCUMENT_CUT, SENTENCE_CUT, FORCED_CUT = 0, 1, 2
PENALTY = (0, AT_SENTENCE, IN_SENTENCE)


def default_tokenizer() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


class Encoder:
    """Ids of texts by cached chunks; which ids end a sentence."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends, self.word_ends = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        for word, i in self.tokenizer.get_vocab().items():
            if i <= size and word.removesuffix("</w>")[-1:] in (".", "!", "?"):
                self.ends[i] = True
            if i <= size and word.endswith("</w>"):
                self.word_ends[i] = True
        self._clear()

    def _clear(self):
        # chunk 0 is empty, chunk 1 is the end of a document
        self.index = {"": 0, None: 1}
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.count[1], self.flat[0], self.total = 1, END, 1

    def _learn(self, new: list[str], base: int) -> None:
        """Keep the ids of chunks, which are numbered from ``base``."""
        self.first, self.count = _grown(self.first, base + len(new)), _grown(self.count, base + len(new))
        words, at = pa.array(new, pa.large_string()), np.arange(base, base + len(new))
        signed = np.array(pc.match_substring_regex(words, SIGNED))
        easy = np.array(pc.match_substring_regex(words, PLAIN))
        for n in np.flatnonzero(~easy).tolist():
            easy[n] = _letters(new[n])
        if easy.any():
            # one or two pre-tokens, each ending in a word end
            text = " ".join(compress(new, easy.tolist()))
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.word_ends[ids])[np.cumsum(1 + signed[easy]) - 1] + 1
            self._keep(at[easy], ids, np.diff(stops, prepend=0))
        if not easy.all():
            hard = list(compress(new, (~easy).tolist()))
            encoded = self.tokenizer.encode(" ".join(hard), add_special_tokens=False)
            starts = np.array([o[0] for o in encoded.offsets], np.int64)
            sizes = np.fromiter(map(len, hard), np.int64, len(hard)) + 1
            counts = np.bincount(np.searchsorted(np.cumsum(sizes), starts, "right"), minlength=len(hard))
            self._keep(at[~easy], np.array(encoded.ids, np.uint32), counts)

    def _keep(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.flat = _grown(self.flat, self.total + len(ids))
        self.first[at] = self.total + np.cumsum(counts) - counts
        self.count[at] = counts
        self.flat[self.total:self.total + len(ids)] = ids
        self.total += len(ids)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text, the end included."""
        ids, stops = self.ids(*self.numbers(texts))
        return np.split(ids, stops[:-1]) if len(texts) else [ids]

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chunks of all texts one after another, the ends included; where each text stops."""
        if len(self.index) > CACHE:
            self._clear()
        split = pc.split_pattern(pa.array([_lowered(t or "").replace("\n", " ") for t in texts], pa.large_string()), " ")
        chunks = split.flatten().dictionary_encode()
        base, own = len(self.index), chunks.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.index.get, own, repeat(-1)), np.int64, len(own))
        unknown = number < 0
        if unknown.any():
            new = own[unknown].tolist()
            self._learn(new, base)
            number[unknown] = np.arange(base, base + len(new))
            self.index.update(zip(new, range(base, base + len(new))))  # last: a call that fails leaves no numbers
        stops = np.cumsum(split.value_lengths().to_numpy(), dtype=np.int64)
        return np.insert(number[chunks.indices.to_numpy()], stops, 1), stops + np.arange(1, len(stops) + 1)

    def ids(self, numbers: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered chunks; where each text stops in them."""
        first, count = self.first[numbers], self.count[numbers]
        stop = np.cumsum(count)
        ids = self.flat[np.repeat(first - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, stop[stops - 1]


def _letters(chunk: str) -> bool:
    """Letters, or letters and one sign, in lower case."""
    return chunk.lower() == chunk and (chunk.isalpha() or chunk[-1] in SIGNS and chunk[:-1].isalpha())


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out


def _lowered(text: str) -> str:
    """The text in lower case where the tokenizer's own lower-casing gives the same ids: texts of
    Latin-1 characters without the brackets of special tokens.  Makes the cache smaller."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_places(ids: np.ndarray, stops: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, kind) of the cut places of documents whose ids follow one another, each with its end last."""
    places = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    # after the last of several closing signs
    places = places[np.append(np.diff(places) > 1, True)] if len(places) else places
    places = places[places < stops[np.searchsorted(stops, places)] - 1]
    kinds = np.repeat(np.array([SENTENCE_CUT, DOCUMENT_CUT], np.int8), [len(places), len(stops)])
    places = np.concatenate([places, stops])
    order = np.argsort(places, kind="stable")
    places, kinds = places[order], kinds[order]
    gaps = np.diff(places, prepend=0)
    if (gaps > STEP).any():
        times = (gaps - 1) // STEP
        stop = np.cumsum(times)
        extra = np.repeat(places - gaps - STEP * (stop - times), times) + STEP * np.arange(1, stop[-1] + 1)
        kinds = np.concatenate([kinds, np.full(len(extra), FORCED_CUT, np.int8)])
        places = np.concatenate([places, extra])
        order = np.argsort(places, kind="stable")
        places, kinds = places[order], kinds[order]
    return places, kinds


def best_cuts(places: list[int], kinds: list[int], whole: bool) -> list[int]:
    """Ends of the windows over the cut places (increasing, above 0).  ``whole``: the last place must
    be an end; otherwise the best place of the last window is."""
    n = len(places)
    pos = [0, *places]
    source, value = [0] * (n + 1), [0] * (n + 1)  # value: cost + pos
    more = [WINDOW + p for p in PENALTY]
    queue, head = [0], 0
    i = at = least = 0  # the queue's head, its place and value
    for j, (p, kind) in enumerate(zip(places, kinds, strict=True), 1):
        while at < p - WINDOW:
            head += 1
            i = queue[head]
            at, least = pos[i], value[i]
        source[j] = i
        value[j] = v = least + more[kind]
        while value[queue[-1]] >= v:  # never the head, which is less
            queue.pop()
        queue.append(j)
    j = n
    if not whole:
        low = pos[n] - WINDOW
        last = [k for k in range(n, 0, -1) if pos[k] > low]
        j = min(last, key=lambda k: (value[k] - pos[k], k))
    out = []
    while j:
        out.append(pos[j])
        j = source[j]
    return out[::-1]


def tail_parts(n: int) -> list[int]:
    """Lengths of the last window: as it is, or as powers of two where that costs less than its padding."""
    if n & (n - 1) and (n.bit_count() - 1) * IN_SENTENCE < WINDOW - n:
        return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    return [n]


class _Stream:
    """The token stream of one partition."""

    def __init__(self, with_ids: bool):
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # doc_id, tokens, tokens before the stream's first
        self.places: list[np.ndarray] = []
        self.kinds: list[np.ndarray] = []
        self.size, self.sequence, self.with_ids = 0, TaskContext.get().partitionId() << 32, with_ids

    def add(self, doc_ids: list, ids: np.ndarray, stops: np.ndarray, ends: np.ndarray) -> None:
        """Documents whose ids follow one another and stop at ``stops``."""
        places, kinds = cut_places(ids, stops, ends)
        self.docs += [(doc_id, n, 0) for doc_id, n in zip(doc_ids, np.diff(stops, prepend=0).tolist(), strict=True)]
        self.ids.append(ids)
        self.places.append(places + self.size)
        self.kinds.append(kinds)
        self.size += len(ids)

    def settle(self, whole: bool) -> pd.DataFrame:
        """Pieces of the windows that are settled; the rest of the stream stays."""
        ids, places, kinds = map(np.concatenate, (self.ids, self.places, self.kinds))
        cuts = best_cuts(places.tolist(), kinds.tolist(), whole)
        if whole:
            before = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + (before + np.cumsum(tail_parts(cuts[-1] - before))).tolist()
        stop = cuts[-1]
        left = np.array([d[1] - d[2] for d in self.docs])  # tokens of each document in the stream
        doc_stop = np.cumsum(left)
        doc_first = doc_stop - left
        edges = np.unique(np.concatenate([[0], cuts, doc_stop[doc_stop < stop]]))
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(doc_stop, a, "right")
        window = np.searchsorted(cuts, a, "right")
        window_first = np.concatenate([[0], cuts])[window]
        skipped = np.array([d[2] for d in self.docs])
        ids = np.ascontiguousarray(ids, "<u4")
        out = pd.DataFrame({
            "doc_id": pd.array([self.docs[k][0] for k in doc], dtype="Int64"),
            "start": a - doc_first[doc] + skipped[doc], "length": b - a,
            "ids_crc32": [zlib.crc32(ids[x:y]) for x, y in zip(a, b, strict=True)],
            "doc_tokens": [self.docs[k][1] for k in doc], "sequence_id": self.sequence + window, "offset": a - window_first})
        if self.with_ids:
            out["ids"] = [ids[x:y].astype(np.int64) for x, y in zip(a, b, strict=True)]
        self.sequence += len(cuts)
        keep = int(np.searchsorted(doc_stop, stop, "right"))
        rest = self.docs[keep:]
        if rest and doc_first[keep] < stop:
            d = rest[0]
            rest[0] = (d[0], d[1], d[2] + int(stop - doc_first[keep]))
        self.docs, self.ids, self.size = rest, [ids[stop:]], len(ids) - stop
        later = places > stop
        self.places, self.kinds = [places[later] - stop], [kinds[later]]
        return out


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False, keep_cache: bool = True) -> DataFrame:
    """One row per piece: where it comes from (doc_id, start, length), its checksum, and where it goes
    (sequence_id, offset); with ``with_ids`` also its ids.  ``keep_cache``: a worker keeps its chunks for its next
    partition; otherwise it frees them, for jobs in which other stages need its memory."""
    path = tokenizer or default_tokenizer()

    def packed(batches):
        enc, stream = encoder(path), _Stream(with_ids)
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            numbers, stops = enc.numbers([t if isinstance(t, str) else None for t in texts])
            for k in range(0, len(texts), DOCS):
                first = stops[k - 1] if k else 0
                own = [None if pd.isna(i) else int(i) for i in ids[k:k + DOCS]]
                part = stops[k:k + DOCS]
                stream.add(own, *enc.ids(numbers[first:part[-1]], part - first), enc.ends)
                if stream.size > HELD * WINDOW:
                    yield stream.settle(False)
        if stream.size:
            yield stream.settle(True)
        if not keep_cache:
            stream = None
            enc._clear()
            release_memory()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(packed, PIECES + (", ids array<long>" if with_ids else ""))


def op3_pack_documents(spark, sf_dir):
    """All documents as pieces of sequences of at most 4096 tokens."""
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_pack_documents": op3_pack_documents}
