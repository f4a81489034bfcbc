"""Near-duplicate documents by HyperMinHash registers.

A document is the set of its five-word shingles (lower-cased; all its words as one, if it has fewer). Shingle hashes are dealt into
256 buckets; a bucket keeps the count of leading zeros and ten mantissa bits of its smallest hash, 16 bits in all. An empty bucket
takes the register of another by a fixed probe order, so short documents are compared by set similarity too. Runs of six
registers are the bands; 42 of them miss a pair at 0.85 with probability 2e-9, at 0.8 with 3e-6.

1. Documents with equal sets are one class, named by its smallest doc_id; only classes go on.
2. In each band bucket every class is paired with the bucket's smallest one: as many pairs as members, never all pairs.
3. Pairs whose collision-corrected estimate isn't five deviations below the threshold are confirmed on their full sets. For that the
   texts of a class and of those paired with it meet in one task, in salted parts of bounded size.
4. Components are formed. Buckets whose members are all in one component are done. In the others members in different components are
   compared block by block inside a task by their registers; a member goes on only if the estimate allows it some link there. What goes on meets again
   with its text, block by block, and links are confirmed on the full sets, so only members and links are emitted, never pairs that aren't links. Blocks are bounded by
   members and by shingles. No cap is set anywhere. Comparing registers is quadratic in the members of a bucket that stay unconnected; texts are repeated
   only for members that go on.

Joins of large rows (texts, registers) are sort-merge joins at every size, so a plan tested on little data is the plan for much, and the
engine may split their hot keys; other sides are broadcast only where the engine has measured them to be small.

Defined results: null, empty and wordless texts have no shingle, are linked with nothing and are kept; rows that repeat a doc_id are
one document, share a component and leave one row (of texts that differ, that with the smallest hash); rows without doc_id keep a null component and are
kept; equal sets are one class, whatever their number; whole texts of any length count; empty tables give empty results; other columns aren't touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import shared_folder, stored
from gridloom.llm._words import Words, chunks, mix
from gridloom.llm.components import components

BUCKETS, MANTISSA = 256, 10


@dataclass(frozen=True)
class NearDedupConfig:
    shingle: int = 5
    percent: int = 85
    rows: int = 6
    part: int = 1000
    block: int = 2000
    block_shingles: int = 2_000_000


_PROBES = (mix(np.arange(48 * BUCKETS, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64).reshape(48, BUCKETS)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set of hashes; of an empty set all 0."""
    low = np.full((len(sets), BUCKETS), _NONE, np.uint64)
    if sets:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        h = mix(np.concatenate(sets)) if len(rows) else np.zeros(0, np.uint64)
        np.minimum.at(low.reshape(-1), rows * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64), h >> np.uint64(8))
    share, exponent = np.frexp(low.astype(np.float64))
    zeros = np.clip(57 - exponent, 1, 63).astype(np.uint16)
    out = zeros << MANTISSA | np.minimum((2 * share - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).astype(np.uint16)
    empty = low == _NONE
    out[empty] = 0
    some = np.flatnonzero(empty.any(1) & ~empty.all(1))
    if len(some):
        sub, original = out[some], ~empty[some]
        open_ = ~original
        for probe in _PROBES:
            take = open_ & original[:, probe]
            sub[take] = sub[:, probe][take]
            open_ &= ~take
        for i in np.flatnonzero(open_.any(1)):  # few shingles: the next bucket that has one, going round
            full, at = np.flatnonzero(original[i]), np.flatnonzero(open_[i])
            sub[i, at] = sub[i, full[np.searchsorted(full, at) % len(full)]]
        out[some] = sub
    return out


def bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """Keys of all bands of each row of registers."""
    n = regs.shape[1] // rows
    key = np.broadcast_to(mix(np.arange(n, dtype=np.uint64)), (len(regs), n))
    cut = regs[:, : n * rows].reshape(len(regs), n, rows).astype(np.uint64)
    for i in range(rows):
        key = mix(key ^ cut[:, :, i])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (last axis), less what unrelated minima share by chance.

    The smallest of a and b hashes fall in one cell of an octave's 2**-MANTISSA parts with probability about 0.18 * 4ab/(a+b)**2 * 2**-MANTISSA.
    """
    chance = 0.18 * 4.0 * n_a * n_b / np.maximum(1.0, (n_a + n_b)) ** 2 / (1 << MANTISSA)
    return ((a == b).mean(-1) - chance) / (1 - chance)


def least_estimate(n_a: np.ndarray, n_b: np.ndarray, t: float) -> np.ndarray:
    """Five standard deviations below the threshold; a small set has no more independent registers than members."""
    return t - 5 * np.sqrt(t * (1 - t) / np.minimum(BUCKETS, np.maximum(n_a, n_b)))


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, in order."""
    for a, b in chunks(column):
        row, _, h = Words(column[a:b], lower=True).shingles(k)
        cut = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            yield np.unique(h[cut[i] : cut[i + 1]])


def sketches(docs: DataFrame, config: NearDedupConfig = NearDedupConfig()) -> DataFrame:
    """doc_id, n_shingles, digest of the set, registers of each document. docs: doc_id, text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            counts, digests, regs, held = [], [], [], []
            for s in shingle_sets(x.column(1), config.shingle):
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                held.append(s)
                if len(held) == 256:
                    regs += [r.tobytes() for r in registers(held)]
                    held = []
            regs += [r.tobytes() for r in registers(held)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sketch, "doc_id bigint, n_shingles bigint, digest binary, registers binary")


def _estimated(pairs: DataFrame, classes: DataFrame, config: NearDedupConfig) -> DataFrame:
    """Pairs (a, b) of classes whose estimate allows the threshold."""
    t = config.percent / 100

    @F.arrow_udf("boolean")
    def alike(n_a: pa.Array, n_b: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        n_a, n_b = n_a.to_numpy().astype(float), n_b.to_numpy().astype(float)
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, BUCKETS) for x in (a, b))
        return pa.array((estimate(a, b, n_a, n_b) >= least_estimate(n_a, n_b, t)) & (np.minimum(n_a, n_b) >= t * np.maximum(n_a, n_b) - 1e-9))

    side = lambda x: classes.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    return both.where(alike("n_a", "n_b", "r_a", "r_b")).select("a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, config: NearDedupConfig) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold: u, v. Texts of b come to a's in parts of about ``part`` rows."""
    spread = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / config.part).cast("int").alias("parts"))
    members = pairs.join(spread, "a").select("a", F.pmod(F.hash("b"), F.col("parts")).alias("part"), F.col("b").alias("id"))
    heads = spread.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    met = members.union(heads).join(texts.hint("merge"), "id").select("a", "part", (F.col("a") != F.col("id")).alias("member"), "id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, []
        for x in batches:
            u, v = [], []
            for a, part, member, i, s in zip(*(x.column(c).to_pylist() for c in range(4)), shingle_sets(x.column(4), config.shingle), strict=True):
                if not member:
                    if head != (a, part):
                        head, own = (a, part), []
                    own.append(s)
                elif head == (a, part) and len(s):
                    for o in own:
                        both = len(np.intersect1d(o, s, assume_unique=True))
                        if 100 * both >= config.percent * (len(o) + len(s) - both):
                            u.append(a)
                            v.append(i)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return met.repartition("a", "part").sortWithinPartitions("a", "part", "member").mapInArrow(compare, "u bigint, v bigint")


def _runs(batches: Iterator[pa.RecordBatch], schema: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow one another with the same first three columns, without these."""
    at, held = None, []
    for x in batches:
        for *key, in zip(*(x.column(c).to_pylist() for c in schema), strict=True):
            if at != tuple(key[:3]):
                if held:
                    yield at, held
                at, held = tuple(key[:3]), []
            held.append(tuple(key[3:]))
    if held:
        yield at, held


_MET = "key bigint, i int, j int, block int, id bigint, component bigint, n_shingles bigint, registers binary"


def _across(shared: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, config: NearDedupConfig, folder: str) -> DataFrame:
    """In buckets that hold more than one component, the links between members of different ones: u, v.

    Members meet block by block, first with their registers, which tell who may reach the threshold with whom, then those that may with their texts.
    A pair that shares several buckets is compared in that of its first common band.
    """
    t = config.percent / 100
    placed = shared.join(labels.hint("merge"), shared["id"] == labels["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rows = placed.join(mixed, "key").join(classes.select(F.col("doc_id").alias("id"), "n_shingles", "registers").hint("merge"), "id")
    rows = stored(rows.select("key", "id", "component", "n_shingles", "registers"), f"{folder}/unconnected")
    blocks = rows.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / config.block), F.ceil(F.sum("n_shingles") / config.block_shingles)).cast("int").alias("blocks"))
    rows = rows.join(blocks, "key").withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "n_shingles", "registers")
    names = [c.split()[0] for c in _MET.split(", ")]

    def pairs(key: tuple, held: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        """Positions p and q that may be linked, q after p."""
        block, comp = (np.array([r[c] for r in held]) for c in (0, 2))
        n = np.array([r[3] for r in held], float)
        regs = np.frombuffer(b"".join(r[4] for r in held), np.uint16).reshape(-1, BUCKETS)
        keys = bands(regs, config.rows)
        for p in range(len(held) - 1):
            at = np.flatnonzero((comp[p + 1 :] != comp[p]) & (key[1] == key[2] or block[p + 1 :] != block[p])) + p + 1
            at = at[np.minimum(n[at], n[p]) >= t * np.maximum(n[at], n[p]) - 1e-9]
            if len(at):
                at = at[estimate(regs[at], regs[p], n[at], n[p]) >= least_estimate(n[at], n[p], t)]
            if len(at):
                at = at[keys[p][(keys[at] == keys[p]).argmax(1)] == key[0]]
            if len(at):
                yield p, at

    def going_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _runs(batches, names):
            go = sorted({x for p, at in pairs(key, held) for x in (p, *at.tolist())})
            columns = list(zip(*(key + held[x] for x in go), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names)

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _runs(batches, [*names, "text"]):
            sets = list(shingle_sets(pa.array([r[5] for r in held], pa.string()), config.shingle))
            u, v = [], []
            for p, at in pairs(key, held):
                for q in at.tolist():
                    both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                    if 100 * both >= config.percent * (len(sets[p]) + len(sets[q]) - both):
                        u.append(held[p][1])
                        v.append(held[q][1])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    dealt = lambda x: x.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    going = stored(dealt(rows).mapInArrow(going_on, _MET), f"{folder}/going-on")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    met = going.join(texts.hint("merge"), "id").select(*names, "text")
    return dealt(met).mapInArrow(confirmed, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, config: NearDedupConfig = NearDedupConfig(), folder: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "near-dedup")
    all_ = stored(sketches(docs, config), f"{folder}/sketches")
    usable = all_.where("doc_id is not null and n_shingles > 0")
    class_of = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("class")), f"{folder}/digests")
    member_of = stored(usable.select("doc_id", "digest").join(class_of.hint("merge"), "digest").select("doc_id", "class").distinct(), f"{folder}/members")
    named = usable.join(class_of.select(F.col("digest").alias("_d"), F.col("class").alias("_c")).hint("merge"), (F.col("digest") == F.col("_d")) & (F.col("doc_id") == F.col("_c")))
    # A set of fewer members has no other set as near as the threshold.
    fewest = config.percent / (100 - config.percent) if config.percent < 100 else float("inf")
    classes = stored(named.where(F.col("n_shingles") >= F.lit(fewest - 1e-9)).dropDuplicates(["doc_id", "digest"]).select("doc_id", "n_shingles", "registers"), f"{folder}/classes")

    @F.arrow_udf("array<bigint>")
    def keys(x: pa.Array) -> pa.Array:
        k = bands(np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, BUCKETS), config.rows)
        return pa.FixedSizeListArray.from_arrays(pa.array(k.reshape(-1)), BUCKETS // config.rows).cast(pa.list_(pa.int64()))

    banded = classes.select(F.col("doc_id").alias("id"), F.explode(keys("registers")).alias("key"))
    hubs = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stored(banded.join(hubs.hint("merge"), "key"), f"{folder}/buckets")
    first = stored(_estimated(shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), classes, config), f"{folder}/pairs-1")
    links = stored(_confirmed(first, docs, config), f"{folder}/links-1")
    copies = member_of.where("doc_id <> class").select(F.col("doc_id").alias("u"), F.col("class").alias("v"))
    labels = components(links, f"{folder}/components-1")
    more = stored(_across(shared, labels, classes, docs, config, folder), f"{folder}/links-2")
    labels = stored(components(links.union(more), f"{folder}/components-2"), f"{folder}/labels")
    multiple = member_of.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")  # one id with different texts
    if not multiple.isEmpty():
        labels = components(links.union(more).union(copies).union(member_of.select(F.col("doc_id").alias("u"), F.col("class").alias("v"))), f"{folder}/components-3")
        placed = labels.select(F.col("node").alias("_n"), "component")
    else:
        placed = member_of.join(labels.hint("merge"), member_of["class"] == labels["node"], "left").select(F.col("doc_id").alias("_n"), F.coalesce("component", "class").alias("component"))
    out = all_.select("doc_id", "n_shingles").join(placed.hint("merge"), F.col("doc_id") == F.col("_n"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, config: NearDedupConfig = NearDedupConfig(), folder: str | None = None) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with the columns it came with."""
    folder = folder or shared_folder(docs.sparkSession, "near-dedup")
    seen = near_duplicates(docs, config, folder)
    gone = stored(seen.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), f"{folder}/gone")
    left = docs.join(gone, F.col("doc_id").cast("bigint") == F.col("_gone"), "left_anti")
    ids = docs.select(F.col("doc_id").alias("_repeated")).where("_repeated is not null").groupBy("_repeated").agg(F.count("*").alias("_n")).where("_n > 1")
    repeated = stored(ids.select("_repeated"), f"{folder}/repeated")
    if repeated.isEmpty():
        return left
    # Of rows with one id that of the smallest text hash stays; rows that are equal in that too are told apart by nothing that matters.
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    again = left.join(repeated, F.col("doc_id") == F.col("_repeated"), "left_semi")
    least = again.groupBy(F.col("doc_id").alias("_id")).agg(F.min(mark).alias("_mark"))
    one = again.withColumn("_hash", mark).join(least, (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_mark")), "left_semi").drop("_hash").dropDuplicates(["doc_id"])
    return left.join(repeated, F.col("doc_id") == F.col("_repeated"), "left_anti").unionByName(one)
