"""Benchmark decontamination by SimHash of item-sized windows.

Texts are lower-cased (A-Z) and cut into words; an item or window is the multiset of its five-word shingles (all its words as one,
if it has fewer). A window of a document has as many words as the item it is compared with, or is the whole
document if that is shorter. The second and further occurrences of a shingle count as shingles of their own, so that
similarity of multisets is similarity of sets, and a window gets a 512-bit SimHash of that set.

Items are found by a multi-index: the bits are 32 blocks of 16. Of fingerprints within the radius of 119 at least three blocks differ in at most
three bits each: if 30 of them differed in four, that were 120. So an item is a candidate only if three of its blocks are among the
697 values around the window's; these are looked up in a table for each block. The index misses none within the
radius, and 0.4 % of unrelated fingerprints are candidates. Candidates are compared by all bits and then exactly: sum of smaller counts over sum of larger
counts, at least ``threshold``. A pair at 0.8 lies beyond the radius with a probability of at most 6e-6 (sets of 14 or 23 shingles; less
for others); for a document of fewer words than an item of under eight shingles, where it would be more, items come from the shingles it holds.

Windows in which too few shingles occur in items of their length to reach the threshold are left out first; that is exact.

Items are read in blocks of bounded size, with a broadcast and a pass over the documents for each, so neither what is broadcast nor a plan grows with the
benchmark.

Defined results: null, empty and wordless texts match nothing, as do such items; repeated items and repeated documents each count;
of windows with the same similarity the first is reported; whole texts of any length are searched; an empty table gives no match; columns
of documents and benchmark that share names don't meet.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import shared_folder, stored
from gridloom.llm._words import Words, chunks, mix
from gridloom.llm.quality import free_name

MATCHES = "array<struct<item_id:bigint,start:bigint,n_words:bigint,similarity:double>>"


@dataclass(frozen=True)
class DecontaminateConfig:
    shingle: int = 5
    threshold: float = 0.8
    radius: int = 119
    block_words: int = 500_000


WORDS, BLOCKS, SLACK = 8, 32, 3
_SALTS = mix(np.arange(1, WORDS + 1, dtype=np.uint64))
#: What a block's value is combined with to give all values that differ in at most SLACK bits.
_AROUND = np.array([x for x in range(1 << 16) if x.bit_count() <= SLACK], np.uint16)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Rows of shingle hashes in which each occurrence of a shingle has a value of its own, the same in every row."""
    order = np.argsort(hashes, axis=1, kind="stable")
    ranked = np.take_along_axis(hashes, order, 1)
    place = np.arange(hashes.shape[1])
    new = np.ones(hashes.shape, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    occurrence = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    out = np.empty_like(hashes)
    np.put_along_axis(out, order, np.where(occurrence > 0, mix(ranked + mix(occurrence.astype(np.uint64))), ranked), 1)
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    """The 512 bits of each hash, along a new last axis."""
    return np.unpackbits(mix(hashes[..., None] ^ _SALTS).view(np.uint8), axis=-1)


def _folded(sums: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * sums >= n, axis=1).view(np.uint64)


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes."""
    part = max(1, (1 << 15) // max(1, hashes.shape[1]))
    folded = [_folded(_bits(numbered(hashes[a : a + part])).sum(1, dtype=np.int32), hashes.shape[1]) for a in range(0, len(hashes), part)]
    return np.concatenate(folded) if folded else np.zeros((0, WORDS), np.uint64)


def window_fingerprints(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of h[s:s + n] for each start; sums of windows that lie together are differences of running sums."""
    out = np.empty((len(starts), WORDS), np.uint64)
    a = 0
    while a < len(starts):
        b = int(np.searchsorted(starts, starts[a] + 4096))
        far = np.flatnonzero(np.diff(starts[a:b]) > n)
        b = a + int(far[0]) + 1 if len(far) else b
        low = int(starts[a])
        region = h[low : int(starts[b - 1]) + n]
        total = np.zeros((len(region) + 1, 64 * WORDS), np.int32)
        np.cumsum(_bits(region), axis=0, out=total[1:])
        at = starts[a:b] - low
        out[a:b] = _folded(total[at + n] - total[at], n)
        # Windows that hold a shingle twice: some earlier place of a shingle lies in the window.
        order = np.argsort(region, kind="stable")
        before = np.full(len(region), -1)
        again = region[order[1:]] == region[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        if again.any():
            twice = np.flatnonzero(np.array([before[s : s + n].max() >= s for s in at.tolist()]))
            for k in range(0, len(twice), 512):
                some = twice[k : k + 512]
                out[a + some] = fingerprints(region[at[some][:, None] + np.arange(n)])
        a = b
    return out


class HammingIndex:
    """All stored fingerprints within a radius of a queried one, by the pigeonhole principle over blocks of 16 bits."""

    def __init__(self, stored: np.ndarray, radius: int) -> None:
        self.stored, self.radius = stored, radius
        self.least = BLOCKS - radius // (SLACK + 1)  # so many blocks differ in SLACK bits at most
        if self.least < 1:
            raise ValueError(f"no guarantee beyond a radius of {BLOCKS * (SLACK + 1) - 1}")
        self.blocks = []
        for values in np.ascontiguousarray(stored).view(np.uint16).reshape(len(stored), BLOCKS).T:
            head = np.zeros((1 << 16) + 1, np.int32)
            np.cumsum(np.bincount(values, minlength=1 << 16), out=head[1:])
            self.blocks.append((head, np.argsort(values, kind="stable").astype(np.int32)))

    def candidates(self, queried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of positions, of the queried and of the stored fingerprints, that agree in enough blocks."""
        values = np.ascontiguousarray(queried).view(np.uint16).reshape(len(queried), BLOCKS)
        found = []
        for b, (head, order) in enumerate(self.blocks):
            around = (values[:, b, None] ^ _AROUND).astype(np.int32)
            first = head[around]
            q, c = np.nonzero(head[around + 1] > first)
            first, last = first[q, c], head[around[q, c] + 1]
            size = last - first
            place = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else first, size) + np.arange(size.sum())
            found.append(np.repeat(q, size) * len(self.stored) + order[place])
        pair, times = np.unique(np.concatenate(found), return_counts=True) if found and len(self.stored) else (np.zeros(0, np.int64),) * 2
        pair = pair[times >= self.least]
        return pair // max(1, len(self.stored)), pair % max(1, len(self.stored))

    def find(self, queried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of positions of fingerprints within the radius."""
        q, s = self.candidates(queried)
        within = np.bitwise_count(queried[q] ^ self.stored[s]).sum(1) <= self.radius
        return q[within], s[within]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class ItemIndex:
    """A block of benchmark items: their shingles, and the fingerprints of those that have a whole shingle, under one multi-index."""

    def __init__(self, ids: list[int], texts: list[str | None], config: DecontaminateConfig) -> None:
        self.config = config
        words = Words(pa.array(texts, pa.string()), lower=True)
        row, _, h = words.shingles(config.shingle)
        cut = np.searchsorted(row, np.arange(words.rows + 1))
        self.ids, self.length = np.array(ids, np.int64), words.counts
        self.sets = [Counter(h[cut[i] : cut[i + 1]].tolist()) for i in range(words.rows)]
        self.lengths = [n for n in sorted(set(words.counts.tolist())) if n > 0]
        self.row = np.flatnonzero(words.counts >= config.shingle)
        prints = np.zeros((words.rows, WORDS), np.uint64)
        for length in self.lengths:
            if length >= config.shingle:
                rows = np.flatnonzero(words.counts == length)
                prints[rows] = fingerprints(np.stack([h[cut[i] : cut[i + 1]] for i in rows]))
        self.index = HammingIndex(prints[self.row], config.radius)
        self.holders: dict[int, set[int]] = {}  # of items with few shingles: which hold a shingle
        for i in np.flatnonzero(np.diff(cut) < 8).tolist():
            for x in self.sets[i]:
                self.holders.setdefault(x, set()).add(i)
        self.known, place = np.unique(h, return_inverse=True)
        # The lengths of the items that hold each known shingle.
        pair = np.unique(place * (len(self.lengths) + 1) + np.searchsorted(self.lengths, words.counts[row]))
        self.head = np.searchsorted(pair // (len(self.lengths) + 1), np.arange(len(self.known) + 1))
        self.held_by = pair % (len(self.lengths) + 1)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        got = self.filter[(h & np.uint64(0xFFFFF)).astype(np.int64)]
        at = np.flatnonzero(got)
        where = np.minimum(np.searchsorted(self.known, h[at]), max(0, len(self.known) - 1))
        got[at] = self.known[where] == h[at]
        return got

    def matches(self, column: pa.Array) -> Iterator[list[tuple[int, int, int, float]]]:
        """Of each text, the items it holds: item, first word, words, similarity."""
        for a, b in chunks(column):
            words = Words(column[a:b], lower=True)
            found: dict[int, dict[int, tuple[int, int, int, float]]] = {}
            k, t = self.config.shingle, self.config.threshold
            row, at, h = words.shingles(k)
            cut = np.searchsorted(row, np.arange(words.rows + 1))
            hit = self.hits(h) if len(self.known) else np.zeros(len(h), bool)
            for length in self.lengths:
                if length < k:
                    self._short(words, length, found)
            # Places of shingles by the lengths of the items that hold them: a window must have enough of its own length.
            place = np.flatnonzero(hit)
            at_known = np.searchsorted(self.known, h[place])
            size = self.head[at_known + 1] - self.head[at_known]
            of = self.held_by[np.repeat(self.head[at_known] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            place = np.repeat(place, size)
            for x in np.unique(of).tolist():
                length, here = self.lengths[x], place[of == x]
                for i in np.unique(row[here]).tolist() if length >= k else []:
                    n = min(length, int(words.counts[i])) - k + 1
                    if n < 1 or n < t * (length - k + 1):
                        continue
                    a, b = np.searchsorted(here, [cut[i], cut[i + 1]])
                    own = here[a:b]
                    starts = np.arange(max(int(cut[i]), int(own[0]) - n + 1), min(int(cut[i + 1]) - n, int(own[-1])) + 1)
                    least = t / (1 + t) * (n + length - k + 1)
                    starts = starts[np.searchsorted(own, starts + n) - np.searchsorted(own, starts) >= least - 1e-9]
                    if len(starts):
                        self._compare(h, starts, n, length, found.setdefault(i, {}), int(cut[i]))
            for i in range(words.rows):
                yield sorted(found[i].values()) if i in found else []

    def _compare(self, h: np.ndarray, starts: np.ndarray, n: int, length: int, best: dict, first: int) -> None:
        k = self.config.shingle
        for part in range(0, len(starts), 256):
            some = starts[part : part + 256]
            if n < length - k + 1 < 8:
                pairs = [(i, j) for i, s in enumerate(some.tolist()) for j in sorted(set().union(*(self.holders.get(x, ()) for x in h[s : s + n].tolist())))]
            else:
                q, s = self.index.find(window_fingerprints(h, some, n))
                pairs = zip(q.tolist(), self.row[s].tolist(), strict=True)
            windows: dict[int, Counter] = {}
            for i, j in pairs:
                if self.length[j] != length:
                    continue
                if i not in windows:
                    windows[i] = Counter(h[some[i] : some[i] + n].tolist())
                x = similarity(windows[i], self.sets[j])
                item = int(self.ids[j])
                if x >= self.config.threshold and (item not in best or x > best[item][3]):
                    best[item] = item, int(some[i]) - first, n + k - 1, x

    def _short(self, words: Words, length: int, found: dict) -> None:
        """Items of fewer words than a shingle: their words stand in the text."""
        at, h = words.grams(length)
        for p in at[self.hits(h)].tolist():
            for j in self.holders.get(int(words.spans.hash(np.array([p]), np.array([p + length]))[0]), ()):
                if self.length[j] == length:
                    i, item = int(words.row[p]), int(self.ids[j])
                    found.setdefault(i, {}).setdefault(item, (item, int(p - words.first[i]), length, 1.0))


def item_blocks(benchmark: DataFrame, config: DecontaminateConfig) -> Iterator[ItemIndex]:
    ids, texts, n = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        n += r[1].count(" ") + 1
        if n >= config.block_words:
            yield ItemIndex(ids, texts, config)
            ids, texts, n = [], [], 0
    if ids:
        yield ItemIndex(ids, texts, config)


def _matcher(index: Broadcast) -> Callable[[Column], Column]:
    fields = ("item_id", "start", "n_words", "similarity")
    kind = pa.list_(pa.struct(list(zip(fields, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True))))

    @F.arrow_udf(MATCHES)
    def contained(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([[dict(zip(fields, m, strict=True)) for m in ms] for ms in index.value.matches(x)], kind)

    return contained


def contaminated(docs: DataFrame, benchmark: DataFrame, config: DecontaminateConfig = DecontaminateConfig(), folder: str | None = None) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, start (first word), n_words, similarity."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "contaminated")
    out = spark.createDataFrame([], docs.select("doc_id").schema).select("doc_id", F.inline(F.array().cast(MATCHES)))
    for i, block in enumerate(item_blocks(benchmark, config)):
        shared = spark.sparkContext.broadcast(block)
        found = docs.select(F.col("doc_id"), _matcher(shared)(F.col("text").cast("string")).alias("_m")).where(F.size("_m") > 0)
        out = out.union(stored(found.select("doc_id", F.inline("_m")), f"{folder}/matches-{i}"))
        shared.destroy()
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, config: DecontaminateConfig = DecontaminateConfig(), folder: str | None = None) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with. All passes but the last are written to the shared folder."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "decontaminated")
    name = free_name(docs, "matches")
    for i, block in enumerate(item_blocks(benchmark, config)):
        if i:
            docs = stored(docs, f"{folder}/pass-{i}")
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)
        docs = docs.withColumn(name, _matcher(shared)(F.col("text").cast("string"))).where(F.size(name) == 0).drop(name)
    return docs
