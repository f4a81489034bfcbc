"""Mixing to target weights with soft domain membership, in DataFrame functions only.

1. A classifier learned from the labelled table gives every document posteriors over domains: naive Bayes over shape marks (shares of
   symbols and capitals, variety of words, in coarse steps) and over how many telling words of each domain a text has. Telling words are those
   that a bounded labelled sample shows to be several times as frequent in a domain as outside it.
2. Nonnegative document rates are fitted by projected gradient steps so that the expected tokens of each domain, the sum of
   rate * tokens * posterior, come to the target shares of a budget: least squares over the domains, each relative to what it has, from rates of one. A rate depends on
   a document through its posteriors alone, so documents are summed by posteriors in steps of a hundredth, and every step is an aggregation of that table,
   whose size the number of domains bounds.
3. A rate becomes copies: its whole part, and one more with the probability of the rest, decided by a hash of doc_id.

A domain without a target keeps what it has: it is told from the others, but no rate is changed for its sake, and targets are shares of the others' tokens.

The budget is chosen so that documents of the ``anchor`` domain are met with a rate just above one, and with ``keep_anchor`` steps are
projected to rates of at least one where that domain is the likeliest (of at least zero elsewhere): what should stay whole stays whole,
and the other domains are thinned or repeated against it, as often as their targets ask: rates have no upper bound. Fitting ends when the
steps have converged and raises an error if they don't; a target that no rates can meet, with the floor or because domains share their documents, is
reported by a warning with the part that is reached.

What is collected is bounded by parameters: the telling words, the domains' totals. Defined results: null, empty and wordless
texts have 0 tokens, the posteriors of their shape and a rate like any other; repeated rows get the same rate each; without labelled rows all
domains are equally likely; a domain without tokens can't be fitted and is left out of the fit; without any tokens every rate is 1.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import shared_folder, stored

#: Domains of the labels table: name and condition.
DOMAINS = {"clean": "quality = 1 and toxic = 0", "junk": "quality = 0 and toxic = 0", "toxic": "toxic = 1"}


@dataclass(frozen=True)
class MixConfig:
    domains: dict[str, str] = field(default_factory=lambda: dict(DOMAINS))
    targets: dict[str, float] = field(default_factory=lambda: {"clean": 0.92, "junk": 0.04, "toxic": 0.04})
    anchor: str = "clean"
    margin: float = 1.02
    per_domain: int = 1500
    telling: int = 100
    least_g: float = 25.0
    lift: float = 3.0
    keep_anchor: bool = True
    steps: int = 1000
    replayed: int = 12
    tolerance: float = 1e-5


def word_array(text: str = "text") -> Column:
    """All words of the whole text (runs other than ASCII white space)."""
    return F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shape(text: Column, words: Column, distinct: Column) -> Column:
    n = F.greatest(F.length(text), F.lit(1))
    step = lambda name, x: F.concat(F.lit(f"\x01{name}"), F.least(F.lit(9), F.floor(x * 10)).cast("string"))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    size = F.greatest(F.size(words), F.lit(1))
    return F.array(
        step("symbols", 4 * (1 - without("#$%&*|@^~<>{}[]\\") / n)),
        step("capitals", 1 - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n),
        step("shouts", 4 * (1 - without("!?") / n)),
        F.concat(step("variety", F.size(distinct) / size), F.least(F.lit(12), F.floor(F.log2(size))).cast("string")),
    )


def _marks(docs: DataFrame) -> DataFrame:
    """Adds _tokens, the number of words, _set, the distinct lower-cased words, and _shape, the shape marks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.withColumn("_w", F.array_remove(F.split(F.lower(F.translate(text, "\t\n\x0b\f\r", "     ")), " "), ""))
    split = split.withColumn("_tokens", F.size("_w").cast("bigint")).withColumn("_set", F.array_distinct("_w"))
    return split.withColumn("_shape", _shape(text, F.col("_w"), F.col("_set"))).drop("_w")


@dataclass(frozen=True)
class DomainModel:
    """Log priors; telling words of each domain; log probabilities in the domains of each shape mark and each count of telling words."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    words: dict[str, tuple[str, ...]]
    marks: dict[str, tuple[float, ...]]

    def present(self) -> Column:
        """Marks of a text for the columns that _marks adds: its shape, and how many telling words of each domain it has (0, 1, 2, 3 to 5, more)."""
        every = sorted({w for ws in self.words.values() for w in ws})
        if not every:
            return F.col("_shape")
        held = F.array_intersect("_set", F.array(*[F.lit(w) for w in every]))
        count = lambda h, ws: F.size(F.array_intersect(h, F.array(*[F.lit(w) for w in ws])))
        bucket = lambda n: F.when(n < 3, n).when(n < 6, 3).otherwise(6).cast("string")
        counts = F.transform(F.array(held), lambda h: F.array(*[F.concat(F.lit(f"\x01words of {d}:"), bucket(count(h, ws))) for d, ws in self.words.items() if ws]))
        return F.concat("_shape", counts[0])

    def posteriors(self) -> Column:
        """An array of posteriors in steps of a hundredth, for the columns that _marks adds."""
        prior = F.array(*[F.lit(float(p)) for p in self.prior])
        total = prior
        if self.marks:
            logs = F.map_from_arrays(F.array(*[F.lit(k) for k in self.marks]), F.array(*[F.array(*[F.lit(x) for x in v]) for v in self.marks.values()]))
            unseen = F.array(*[F.lit(0.0) for _ in self.domains])
            total = F.aggregate(self.present(), prior, lambda acc, k: F.zip_with(acc, F.coalesce(logs[k], unseen), lambda a, b: a + b))
        raised = F.transform(F.array(total), lambda t: F.transform(t, lambda x: F.exp(F.greatest(x - F.array_max(t), F.lit(-50.0)))))[0]
        return F.transform(F.array(raised), lambda r: F.transform(r, lambda x: F.round(x / F.aggregate(r, F.lit(0.0), lambda a, b: a + b), 2)))[0]


def fit_domains(docs: DataFrame, labels: DataFrame, config: MixConfig = MixConfig(), folder: str | None = None) -> DomainModel:
    """Learns the domains from a bounded sample of the labelled rows: those of each domain with the smallest hashes of doc_id."""
    folder = folder or shared_folder(docs.sparkSession, "mixing")
    names = tuple(config.domains)
    at = range(len(names))
    chosen = [labels.where(c).where("doc_id is not null").select(F.col("doc_id").alias("_id"), F.lit(i).alias("_domain")).orderBy(F.xxhash64("_id"), "_id").limit(config.per_domain) for i, c in enumerate(config.domains.values())]
    few = F.broadcast(reduce(DataFrame.unionByName, chosen))  # at most per_domain rows of two numbers for each domain
    counts = labels.agg(*[F.count(F.when(F.expr(c), 1)) for c in config.domains.values()]).first()
    prior = tuple(math.log((n + 1) / (sum(counts) + len(names))) for n in counts)
    sample = stored(_marks(docs.select(F.col("doc_id").alias("_id"), "text").join(few, "_id")).select("_domain", "_set", "_shape"), f"{folder}/sample")
    sizes = {r[0]: float(r[1]) for r in sample.groupBy("_domain").count().collect()}
    if not sizes:
        return DomainModel(names, tuple([math.log(1 / len(names))] * len(names)), {}, {})
    n = [sizes.get(i, 0.0) for i in at]
    per = [F.sum(F.when(F.col("_domain") == i, 1).otherwise(0)).alias(f"c{i}") for i in at]
    share = lambda i, extra: (F.col(f"c{i}") + 0.5) / F.lit(n[i] + extra)
    # How far a word's counts are from what the domains' sizes would give it (G statistic).
    seen = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in at])
    part = lambda i: F.when(F.col(f"c{i}") > 0, 2 * F.col(f"c{i}") * F.log(F.col(f"c{i}") * sum(n) / (seen * F.lit(n[i] or 1.0)))).otherwise(0.0)
    rows = sample.select("_domain", F.explode("_set").alias("mark")).where("mark <> ''").groupBy("mark").agg(*per).withColumn("g", reduce(lambda a, b: a + b, [part(i) for i in at]))
    lift = lambda i: share(i, 1.0) * (sum(n) - n[i] + 1.0) / (seen - F.col(f"c{i}") + 0.5)
    telling = [rows.where((F.col("g") >= config.least_g) & (lift(i) >= config.lift)).orderBy(F.desc("g"), "mark").limit(config.telling).select("mark").collect() for i in at]
    model = DomainModel(names, prior, {d: tuple(r[0] for r in telling[i]) for i, d in enumerate(names)}, {})
    marks = sample.select("_domain", F.explode(model.present()).alias("mark")).groupBy("mark").agg(*per).select("mark", *[F.log(share(i, 20.0)) for i in at])
    return DomainModel(names, prior, model.words, {r[0]: tuple(r[1:]) for r in marks.limit(1000).collect()})


def fit_rates(cells: DataFrame, config: MixConfig) -> Column:
    """A column that turns posteriors (p) into rates. cells: p and tokens, one row for each value of p.

    Projected gradient steps from rates of one. The loss is the sum over domains of (tokens - goal)^2 / own. Against it a step of one is never too long, as no
    document's posteriors sum to more than one; longer ones come from the curvature along the last step (Barzilai and Borwein), unless the loss has risen above its last five values.
    A step is an aggregation of the cells; the driver holds its gradient, a number for each domain, and a row's rate is found by going through the steps again
    (cells are stored with theirs after every ``replayed`` steps).
    """
    names = list(config.domains)
    d = len(names)
    t, p = F.col("tokens"), F.col("p")
    own = [float(x or 0.0) for x in cells.agg(*[F.sum(t * p[i]) for i in range(d)]).first()]
    anchor = names.index(config.anchor)
    if not own[anchor] or not config.targets.get(config.anchor):
        budget = sum(own)
    else:
        budget = config.margin * own[anchor] / config.targets[config.anchor]
    at = [i for i in range(d) if own[i] > 0 and names[i] in config.targets]
    if not at:
        return F.lit(1.0)
    kept = p[anchor] >= F.array_max("p") if config.keep_anchor else F.lit(False)
    least = F.when(kept, 1.0).otherwise(0.0)
    goal, has = np.array([config.targets[names[i]] * budget for i in at]), np.array([own[i] for i in at])
    allowed = config.tolerance * np.where(goal > 0, goal, has)
    taken: list[np.ndarray] = []

    def down(rate: Column, step: list[Column]) -> Column:
        return F.greatest(least, rate - reduce(lambda a, b: a + b, [p[i] * g for i, g in zip(at, step, strict=True)]))

    def after(rate: Column, steps: list[np.ndarray]) -> Column:
        if not steps:
            return rate
        return F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps]), rate, lambda r, g: down(r, [g[n] for n in range(len(at))]))

    seen, first = cells.select("tokens", "p", F.lit(1.0).alias("start")), 0
    past: list[float] = []
    before: np.ndarray | None = None
    while True:
        last = seen.select("tokens", "p", "start", after(F.col("start"), taken[first:-1]).alias("last"))
        at_hand = last.withColumn("rate", after(F.col("last"), taken[-1:]) if len(taken) > first else F.col("last"))
        got = [float(x or 0.0) for x in at_hand.agg(F.sum(t * F.pow(F.col("rate") - F.col("last"), F.lit(2.0))), *[F.sum(t * F.col("rate") * p[i]) for i in at]).first()]
        now = np.array(got[1:])
        gradient = (now - goal) / has
        move = F.abs(down(F.col("rate"), [F.lit(float(g)) for g in gradient]) - F.col("rate")) / F.greatest(F.col("rate"), F.lit(1.0))
        if (np.abs(now - goal) <= allowed).all() or (at_hand.agg(F.max(move)).first()[0] or 0.0) <= config.tolerance:
            break
        if len(taken) >= config.steps:
            raise RuntimeError(f"rates have not converged in {config.steps} steps; still off their goals by {dict(zip([names[i] for i in at], ((now - goal) / has).tolist(), strict=True))} of what the domains have")
        loss, length = float((now - goal) @ gradient), 1.0
        if before is not None and loss <= max(past[-5:]):
            curved = float(((now - before) ** 2 / has).sum())
            length = min(1e4, max(1.0, got[0] / curved)) if curved > 0 and got[0] > 0 else 1.0
        past.append(loss)
        before = now
        if len(taken) - first >= config.replayed:
            folder = shared_folder(cells.sparkSession, "rates")
            seen, first = stored(at_hand.select("tokens", "p", F.col("rate").alias("start")).coalesce(1), folder), len(taken)
        taken.append(length * gradient)
    missed = {names[i]: f"{n:.0f} of {g:.0f}" for i, n, g, h in zip(at, now, goal, has, strict=True) if abs(n - g) > 1e-3 * (g or h)}
    if missed:
        warnings.warn(f"expected tokens of domains that no rates bring to their targets: {missed}", stacklevel=2)
    return after(F.lit(1.0), taken)


def with_rates(docs: DataFrame, labels: DataFrame, config: MixConfig = MixConfig(), folder: str | None = None) -> DataFrame:
    """doc_id, tokens, p (posteriors) and rate of each document."""
    folder = folder or shared_folder(docs.sparkSession, "mixing")
    model = fit_domains(docs, labels, config, folder)
    seen = stored(_marks(docs.select("doc_id", "text")).select("doc_id", F.col("_tokens").alias("tokens"), model.posteriors().alias("p")), f"{folder}/posteriors")
    cells = stored(seen.groupBy("p").agg(F.sum("tokens").cast("double").alias("tokens")).coalesce(1), f"{folder}/cells")
    return seen.withColumn("rate", fit_rates(cells, config))


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies for a rate: the expected number is the rate."""
    share = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return F.floor(rate + F.coalesce(share, F.lit(0.5))).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, config: MixConfig = MixConfig(), folder: str | None = None) -> DataFrame:
    """The documents, each as often as its rate says, with the columns they came with."""
    names = docs.columns
    folder = folder or shared_folder(docs.sparkSession, "mixing")
    model = fit_domains(docs, labels, config, folder)
    # Written once with their posteriors: what refers to them many times below must not compute them anew.
    marked = _marks(docs.select(F.struct(*names).alias("_row"), "doc_id", "text")).select("_row", F.col("doc_id").alias("_id"), F.col("_tokens").alias("tokens"), model.posteriors().alias("p"))
    marked = stored(marked, f"{folder}/posteriors")
    cells = stored(marked.groupBy("p").agg(F.sum("tokens").cast("double").alias("tokens")).coalesce(1), f"{folder}/cells")
    counted = marked.select("_row", copies(fit_rates(cells, config), F.col("_id")).alias("_n")).where("_n > 0")
    return counted.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).select("_row.*")
