"""Repeated long spans by De Bruijn compaction.

Windows of ``window`` consecutive words are the edges of a De Bruijn graph over the corpus; its nodes are the runs of one word less in which
edges meet. Edges aren't stored one by one where they needn't be: a run of consecutive windows that share their minimizer (the smallest hash of
a six-word run inside a window) is a segment. Equal windows have equal minimizers, so all occurrences of an edge lie in segments of one minimizer.

1. One pass over the texts gives the segments: minimizer, digest of the segment's words, source coordinates.
2. Minimizers that occur once can't hold a repeated edge. Of the others, a minimizer with one digest is one long edge: every
   occurrence is the same words. Minimizers with several digests are where paths branch: the first occurrence of each digest is cut into
   single edges, read from the source coordinates in the texts, and grouped by digests of their words; other occurrences repeat the first.
3. The repeated edges, long and single ones, are a graph: each leads from the node of its first words to that of its last. An
   aggregation counts the edges that end and begin in each node. Where one ends and one begins, as often as each other, and the second follows the first at its
   source, they are linked. Links are followed inside blocks of 1024 words of a source first; joins that double the distance at each round bring the
   pieces of paths that cross blocks to the heads of their paths.
4. A join takes the paths to their occurrences, which are verified by their coordinates: a path's edges stand in a document at the same distances as at its source.
   Whole occurrences are one span, others fall back to their edges. Every occurrence of an edge but the first in the corpus is removed.

Digests are BLAKE2b of the words themselves, 64 bits for a segment within its minimizer, 128 bits for a single edge: what is called equal is
so but for a collision of these. Hashes of nodes decide only which edges may be linked, which the coordinates then confirm. Occurrences of hot
segments and edges are met by joins that the engine may split.

Defined results: null, empty and wordless texts have no words; whole texts of any length count; the order of occurrences is (doc_id, start). Rows that
repeat a doc_id with another text are documents of their own, in the order of the texts' hashes; rows that repeat doc_id and text are one document and
lose the same words. Rows without doc_id keep their words and make no other row lose any. An empty table gives an empty result. Other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._shared import removed, shared_folder, stored
from gridloom.llm._words import Words, chunks

#: Words of a source, as a power of two, within which links are followed in one task.
BLOCK_BITS = 10


@dataclass(frozen=True)
class SubstringConfig:
    window: int = 20
    gram: int = 6


def _digest(x: bytes, size: int) -> bytes:
    return hashlib.blake2b(x, digest_size=size).digest()


def segments(words: Words, config: SubstringConfig) -> tuple[np.ndarray, ...]:
    """Row, first window (word number in the slice), windows, minimizer and whether it may hold one edge twice."""
    w, g = config.window, config.gram
    n = len(words.row) - w + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 5
    at = np.arange(len(words.row) - g + 1)
    least = words.spans.hash(at, at + g)
    span, have = w - g + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    least = least[:n]
    same_row = words.row[:n] == words.row[w - 1 :]
    s = np.arange(n)
    edge = words.spans.hash(s, s + w)
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~same_row[:-1]
    opens = np.flatnonzero(new & same_row)
    run = np.cumsum(new)
    size = np.bincount(run[same_row], minlength=run[-1] + 1)[run[opens]]
    twice = np.zeros(n, bool)
    for d in range(1, span):
        twice[:-d] |= (edge[:-d] == edge[d:]) & (run[:-d] == run[d:])
    inner = (size > span) | (np.bincount(run[twice & same_row], minlength=run[-1] + 1)[run[opens]] > 0)
    return words.row[opens], opens, size, least[opens], inner


def _normal(words: Words) -> tuple[bytes, np.ndarray]:
    """All words of a slice, one space after each, and where each begins."""
    raw, parts = words.data.tobytes(), []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if got := raw[a:b].split():
            parts.append(b" ".join(got))
    return b" ".join(parts) + b" ", np.concatenate([[0], np.cumsum(words.end - words.start + 1)])


def _segment_table(docs: DataFrame, config: SubstringConfig) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a, b in chunks(x.column(1)):
                words = Words(x.column(1)[a:b])
                row, first, size, h, inner = segments(words, config)
                text, offset = _normal(words)
                ends = offset[first + size + config.window - 1] - 1 if len(first) else first
                digest = b"".join([_digest(text[i:j], 8) for i, j in zip(offset[first].tolist(), ends.tolist(), strict=True)])
                doc, r = (x.column(i).take(pa.array(row + a, pa.int64())) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64) if len(h) else h, pa.int64()), pa.array(np.frombuffer(digest, np.int64)), doc, r, pa.array((first - words.first[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(inner.astype(bool))], ["h", "c", "doc", "r", "start", "n", "inner"])

    return docs.select("doc", "text", "r").mapInArrow(cut, "h bigint, c bigint, doc bigint, r bigint, start int, n int, inner boolean")


def _edge_table(firsts: DataFrame, docs: DataFrame, config: SubstringConfig) -> DataFrame:
    """Edges of first occurrences given by source coordinates (doc, r, start, n, times): as they are, or, unless they are long, cut into single ones.

    e: digest of a single edge's words; doc, r, start, n, times; u and v: nodes in which the edge begins and ends.
    """
    wanted = firsts.groupBy("doc", "r").agg(F.collect_list(F.struct("start", "n", "times", "long")).alias("at"))  # a document's own places, fewer than its words
    w = config.window

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a, b in chunks(x.column(3)):
                words = Words(x.column(3)[a:b])
                at = np.arange(max(0, len(words.row) - w + 2))
                node = words.spans.hash(at, at + w - 1).view(np.int64)
                text, offset = _normal(words)
                lists = x.column(2).slice(a, b - a)
                row = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy())
                start, n, times, long = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in lists.flatten().flatten())
                size = np.where(long, 1, n)  # edges that an entry becomes
                row, whole, step = np.repeat(row, size), np.repeat(long > 0, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start, n, times = np.repeat(start, size) + step, np.where(whole, np.repeat(n, size), 1), np.repeat(times, size)
                at = words.first[row] + start
                e = [None if whole_ else _digest(text[i:j], 16) for whole_, i, j in zip(whole.tolist(), offset[at].tolist(), (offset[at + w] - 1).tolist(), strict=True)]
                doc, r = (x.column(i).take(pa.array(row + a, pa.int64())) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.binary()), doc, r, *(pa.array(c.astype(np.int32)) for c in (start, n)), *(pa.array(c) for c in (times, node[at], node[at + n]))], ["e", "doc", "r", "start", "n", "times", "u", "v"])

    met = wanted.join(docs, ["doc", "r"]).select("doc", "r", "at", "text")
    return met.mapInArrow(edges, "e binary, doc bigint, r bigint, start int, n int, times bigint, u bigint, v bigint")


_FIRST = ["fd", "fr", "fs"]


def _first() -> Column:
    """The first of a group of occurrences: document, row of a repeated doc_id, and start and windows in one number."""
    return F.min(F.struct("doc", "r", (F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("n")).alias("at"))).alias("first")


def _named(rows: DataFrame, *others: str) -> DataFrame:
    return rows.select(*others, F.col("first.doc").alias("fd"), F.col("first.r").alias("fr"), F.shiftright("first.at", 32).cast("int").alias("fs"), F.col("first.at").bitwiseAND((1 << 32) - 1).cast("int").alias("fn"))


def _links(graph: DataFrame) -> DataFrame:
    """Edges (fd, fr, fs) and the start of the edge before each (before): nodes in which one edge ends and one begins, with the same coordinates and times."""
    ends = graph.select(F.col("v").alias("node"), "fd", "fr", (F.col("fs") + F.col("fn")).alias("fs"), "times", F.col("fs").alias("before"))
    ends = ends.union(graph.select(F.col("u").alias("node"), "fd", "fr", "fs", "times", F.lit(None).cast("int")))
    same = [*_FIRST, "times"]
    degrees = ends.groupBy("node").agg(F.count("*").alias("ends"), F.count("before").alias("into"), F.max("before").alias("before"), *[f(c).alias(f"{f.__name__}_{c}") for c in same for f in (F.min, F.max)])
    return degrees.where(" and ".join(["ends = 2 and into = 1", *[f"min_{c} = max_{c}" for c in same]])).select(*[F.col(f"min_{c}").alias(c) for c in _FIRST], "before")


def _heads(graph: DataFrame, folder: str) -> DataFrame:
    """Edges (fd, fr, fs) and the start of the path that they lie on (ps). graph: fd, fr, fs, fn, times, u, v of each repeated edge."""
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    edges = graph.select(*_FIRST, F.lit(None).cast("int").alias("before")).unionByName(_links(graph)).withColumn("block", block("fs"))
    edges = edges.repartition("fd", "fr", "block").groupBy("fd", "fr", "block", "fs").agg(F.max("before").alias("before"))
    # Links inside a block of a source lead from edge to next edge: at most as many rows as a block has words.
    outside = F.when(block("before") != F.col("block"), F.col("before"))
    opens = F.when(F.col("before").isNull() | outside.isNotNull(), F.col("fs"))
    piece = F.last(opens, ignorenulls=True).over(Window.partitionBy("fd", "fr", "block").orderBy("fs"))
    pieces = stored(edges.select(*_FIRST, piece.alias("ps"), outside.alias("before")), f"{folder}/pieces")
    # Pieces of paths that go on from another block: joins double their reach.
    linked = stored(pieces.where("before is not null").select(*_FIRST, "before"), f"{folder}/linked-pieces")
    state = linked.join(pieces.select("fd", "fr", F.col("fs").alias("before"), "ps"), ["fd", "fr", "before"]).select(*_FIRST, "ps", F.lit(False).alias("done"))
    state = stored(state, f"{folder}/heads-0")
    k = 0
    while not state.where("not done").isEmpty():
        # Those on their way ask distinct pieces, as far off as all rounds before together; what isn't in the table begins a path.
        asked = state.select("fd", "fr", F.col("fs").alias("ps"), F.col("ps").alias("_ps"), F.col("done").alias("_done"))
        gone = state.where("not done").drop("done").join(asked, ["fd", "fr", "ps"], "left").select(*_FIRST, F.coalesce("_ps", "ps").alias("ps"), F.coalesce("_done", F.lit(True)).alias("done"))
        after = stored(state.where("done").unionByName(gone), f"{folder}/heads-{k + 1}")
        removed(graph.sparkSession, f"{folder}/heads-{k}")
        state, k = after, k + 1
    found = state.select("fd", "fr", F.col("fs").alias("ps"), F.col("ps").alias("_ps"))
    return pieces.drop("before").join(found, ["fd", "fr", "ps"], "left").select(*_FIRST, F.coalesce("_ps", "ps").alias("ps"))


def _rows(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """All rows (doc, r, text and doc_id), and the documents (doc, r, text). r: a hash of the text where a doc_id is repeated, else 0."""
    rows = docs.select("doc_id", F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("string").alias("text"))
    repeated = stored(rows.where("doc is not null").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), f"{folder}/repeated")
    if repeated.isEmpty():
        rows = rows.withColumn("r", F.lit(0).cast("bigint"))
        return rows, rows.where("doc is not null").drop("doc_id")
    many = rows.join(repeated, "doc", "left_semi").withColumn("r", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = stored(rows.join(repeated, "doc", "left_anti").withColumn("r", F.lit(0).cast("bigint")).unionByName(many), f"{folder}/rows")
    return rows, rows.where("doc is not null").select("doc", "r", "text").dropDuplicates(["doc", "r"])


def _spans(docs: DataFrame, config: SubstringConfig, folder: str) -> tuple[DataFrame, DataFrame]:
    """Paths and spans of documents (doc, r, text)."""
    spark = docs.sparkSession
    all_ = stored(_segment_table(docs, config), f"{folder}/segments")
    seen = all_.groupBy("h").agg(F.count("*").alias("times"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("inner").alias("inner"), _first()).where("times > 1 or inner")
    seen = stored(_named(seen.withColumn("branching", F.col("inner") | (F.col("lo") != F.col("hi"))), "h", "times", "branching"), f"{folder}/minimizers")
    met = stored(all_.drop("inner").join(seen.drop("fn", "times"), "h"), f"{folder}/occurrences")
    removed(spark, f"{folder}/segments")
    # Branching minimizers: what repeats the first of its digest is a span, the firsts are cut into single edges.
    branching = met.where("branching").select("h", "c", "doc", "r", "start", "n")
    source = [F.col("fd").alias("doc"), F.col("fr").alias("r"), F.col("fs").alias("start"), F.col("fn").alias("n"), "times"]
    firsts = stored(_named(branching.groupBy("h", "c").agg(F.count("*").alias("times"), _first()), "times").select(*source), f"{folder}/firsts")
    copies = branching.select("doc", "r", "start", "n").join(firsts, ["doc", "r", "start"], "left_anti")
    long = seen.where("not branching").select(*source)
    edges = stored(_edge_table(firsts.withColumn("long", F.lit(False)).unionByName(long.withColumn("long", F.lit(True))), docs, config), f"{folder}/edges")
    cut = edges.where("e is not null")
    again = _named(cut.groupBy("e").agg(F.sum("times").alias("times"), _first()).where("times > 1"), "e", "times").drop("fn")
    again = stored(again, f"{folder}/repeated-edges")  # a table of its own, so that the engine can split a hot edge in the join below
    single = stored(cut.drop("times").join(again, "e").drop("e"), f"{folder}/single-edges")
    # The graph of repeated edges, each by its first occurrence, and its paths.
    at_source = (F.col("doc") == F.col("fd")) & (F.col("r") == F.col("fr")) & (F.col("start") == F.col("fs"))
    whole_edges = edges.where("e is null").select(F.col("doc").alias("fd"), F.col("r").alias("fr"), F.col("start").alias("fs"), F.col("n").alias("fn"), "times", "u", "v")
    graph = stored(whole_edges.unionByName(single.where(at_source).select(*_FIRST, F.col("n").alias("fn"), "times", "u", "v")), f"{folder}/graph")
    removed(spark, f"{folder}/edges")
    heads = _heads(graph, folder)
    paths = graph.join(heads, _FIRST).groupBy(F.col("fd").alias("doc"), F.col("fr").alias("r"), F.col("ps").alias("start")).agg(F.sum("fn").alias("n_windows"), F.max("times").alias("times"))
    # An occurrence of a path in a document: its edges stand at the same distances as at the source.
    later = met.where("not branching").select("doc", "r", "start", "n", *_FIRST).unionByName(single.select("doc", "r", "start", "n", *_FIRST)).where(~at_source)
    placed = later.join(heads, _FIRST).select("doc", "r", "start", "n", "fd", "fr", "ps", (F.col("start") - F.col("fs") + F.col("ps")).alias("at"))
    place = Window.partitionBy("doc", "at", "r", "fd", "fr", "ps")  # no more edges than the path has
    held = placed.select("doc", "r", "start", "n", F.min("start").over(place).alias("from"), F.max(F.col("start") + F.col("n")).over(place).alias("to"), F.sum("n").over(place).alias("held"))
    whole = F.col("held") == F.col("to") - F.col("from")
    found = held.where(~whole | (F.col("start") == F.col("from"))).select("doc", "r", "start", F.when(whole, F.col("held").cast("int")).otherwise(F.col("n")).alias("n"))
    return paths, found.unionByName(copies)


def repeated_spans(docs: DataFrame, config: SubstringConfig = SubstringConfig(), folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Paths (doc, r, start, n_windows, times: a repeated nonbranching path by its first occurrence) and spans (doc, r, start, n: windows that occur earlier)."""
    folder = folder or shared_folder(docs.sparkSession, "substring")
    return _spans(_rows(docs, folder)[1], config, folder)


def _without(rows: DataFrame, spans: DataFrame, config: SubstringConfig, texts: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of each row, and with ``texts`` kept_text."""
    at = spans.groupBy(F.col("doc").alias("_doc"), F.col("r").alias("_r")).agg(F.collect_list(F.struct("start", "n")).alias("_at"))  # a document's own spans
    joined = rows.join(at, (F.col("doc") == F.col("_doc")) & (F.col("r") == F.col("_r")), "left").select("doc", "_at", "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for at, text in zip(x.column(1), x.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = 0
                if at.is_valid and len(words):
                    flat = at.values.flatten()
                    start, n = (f.to_numpy() for f in flat)
                    depth = np.zeros(len(words) + 1, np.int32)
                    np.add.at(depth, start, 1)
                    np.subtract.at(depth, start + n + config.window - 1, 1)
                    left = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
                    gone = len(words) - len(left)
                    kept = b" ".join([words[i] for i in left.tolist()])
                else:
                    kept = b" ".join(words)
                n_words.append(len(words))
                n_removed.append(gone)
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = joined.mapInArrow(keep, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    return out if texts else out.drop("kept_text")


def deduplicated(docs: DataFrame, config: SubstringConfig = SubstringConfig(), folder: str | None = None, texts: bool = False) -> DataFrame:
    """What is left of each row: doc_id, n_words, n_removed, kept_sha256, and with ``texts`` kept_text."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "substring")
    rows, documents = _rows(docs, folder)
    _, spans = _spans(documents, config, f"{folder}/work")
    spans = stored(spans, f"{folder}/spans")
    removed(spark, f"{folder}/work")
    return _without(rows, spans, config, texts)
