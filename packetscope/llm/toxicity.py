"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed to embedding rows. Filters of several widths slide over the words, each
keeps its highest value in the text, and a logistic layer weighs these. A bounded start is
fitted first; from there all labelled rows are learned from in shards, whose networks are
averaged. Thresholds come from all rows kept for them. Scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetscope.llm.common import giving_back, id_type, text_udf, words_of
from packetscope.session import ship, written

# embedding rows (the row after them pads), and bytes of a word's pieces
ROWS, PIECE = 1 << 17, 5
# labelled rows of each class in the start, and the share of all labelled rows kept to calibrate
SAMPLE_PER_CLASS, CALIBRATION = 3000, 4
# labelled rows that one network learns from before an average, averages on the way through all rows,
# and most passes over them
SHARD, ROUNDS, PASSES = 8192, 2, 8
# rates of the start and of the later rounds, and texts of a step
RATE, LATER_RATE, BATCH = 0.01, 0.003, 32
# steps of a logit that scores are counted in, and parts of one that shards add up in
GRID, FINE = 1 << 8, 1 << 32
WIDTHS, FILTERS, DEPTH = (1, 2, 3), 6, 8
# share of a text's words that a training round hides, and the fewest steps of a training
HIDDEN, LEAST_STEPS = 0.3, 400
# a language needs this many calibration rows of each class for a threshold of its own
LEAST_ROWS = 20


def rows_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of some words, and where each word's rows start.

    A word has a row of its own and one for each of its pieces of five bytes, with a mark
    before and after the word. Pieces let a word that was never seen count like those with
    the same stem.
    """
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    letters = np.frombuffer(b"<" + b"><".join(words) + b">" + bytes(PIECE), np.uint8)
    code = np.zeros(int(sizes.sum()), np.uint64)
    for step in range(PIECE):
        code |= letters[step : step + len(code)].astype(np.uint64) << np.uint64(8 * step)
    hashed = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(ROWS)
    pieces = np.maximum(sizes - PIECE + 1, 0)
    starts = np.cumsum(pieces + 1) - pieces - 1
    rows = np.empty(int((pieces + 1).sum()), np.int64)
    rows[starts] = np.fromiter((zlib.crc32(w) % ROWS for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), pieces)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    rows[starts[word] + 1 + inside] = hashed[(np.cumsum(sizes) - sizes)[word] + inside]
    return rows, starts


def laid_out(texts: list[list[bytes]]) -> Laid:
    """The words of some texts as arrays."""
    number: dict[bytes, int] = {}
    flat: list[int] = []
    starts, closed = [], []
    for words in texts:
        starts.append(len(flat))
        flat += [number.setdefault(w, len(number)) for w in words] or [-1]
        closed.append(len(flat))
        flat += [-1] * (max(WIDTHS) - 1)
    rows, ends = rows_of(list(number))
    return Laid(
        np.asarray(flat, np.int64) % (len(number) + 1),  # the last one is padding
        np.asarray(starts, np.int64),
        (np.asarray(closed, np.int64)[:, None] + np.arange(max(WIDTHS) - 1)).ravel(),
        np.append(rows, ROWS),
        np.append(ends, len(rows)),
    )


@dataclass
class Laid:
    """Texts one after the other, each followed by padding."""

    flat: np.ndarray  # number of the distinct word at each place
    starts: np.ndarray  # where each text starts
    closed: np.ndarray  # places no window may start at
    rows: np.ndarray  # embedding rows of all distinct words
    ends: np.ndarray  # where each distinct word's rows start


@dataclass
class Network:
    """Weights, forward pass and gradient."""

    table: np.ndarray  # (ROWS + 1, DEPTH), the last row stays 0
    filters: dict[int, np.ndarray]  # width -> (width, DEPTH, FILTERS)
    shift: np.ndarray  # of each filter
    weights: np.ndarray
    bias: np.ndarray
    thresholds: dict[str, float] = field(default_factory=dict)  # "" is every other language

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        rnd = np.random.default_rng(seed)
        table = rnd.normal(0, 0.02, (ROWS + 1, DEPTH)).astype(np.float32)
        table[ROWS] = 0
        filters = {
            w: rnd.normal(0, 0.3 / w, (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS
        }
        n = FILTERS * len(WIDTHS)
        weights = rnd.normal(0, 0.2, n).astype(np.float32)
        return cls(table, filters, np.zeros(n, np.float32), weights, np.zeros(1, np.float32))

    def small(self) -> list[np.ndarray]:
        """All parameters but the table."""
        return [*self.filters.values(), self.shift, self.weights, self.bias]

    def flat(self) -> np.ndarray:
        """All parameters as rows of the table's width."""
        small = np.concatenate([p.ravel() for p in self.small()])
        return np.concatenate([self.table, np.append(small, np.zeros(-len(small) % DEPTH, np.float32)).reshape(-1, DEPTH)])

    def copy(self, flat: np.ndarray | None = None) -> Network:
        """A network of its own, with these parameters if they are given as by ``flat``."""
        flat = self.flat() if flat is None else flat
        small = flat[ROWS + 1 :].ravel()
        ends = np.cumsum([p.size for p in self.small()])
        parts = [x.reshape(p.shape).copy() for x, p in zip(np.split(small, ends), self.small())]
        filters = dict(zip(self.filters, parts))
        return Network(flat[: ROWS + 1].copy(), filters, *parts[len(filters) :], dict(self.thresholds))

    def embedded(self, laid: Laid) -> np.ndarray:
        """The vector of each distinct word."""
        return np.add.reduceat(self.table[laid.rows], laid.ends, axis=0)

    def windows(self, laid: Laid, vectors: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Each filter's value at each place."""
        value = (vectors @ f[0])[laid.flat]
        for step in range(1, len(f)):
            value[:-step] += (vectors @ f[step])[laid.flat[step:]]
        value[laid.closed] = -np.inf
        return value

    def gradient(self, laid: Laid, labels: np.ndarray, share: np.ndarray):
        """Gradients of the small parameters; touched rows of the table and their gradients."""
        ends = np.append(laid.starts[1:], len(laid.flat))
        vectors = self.embedded(laid)
        places, highest = [], []
        for f in self.filters.values():
            value = self.windows(laid, vectors, f)
            at = np.stack([s + value[s:e].argmax(axis=0) for s, e in zip(laid.starts, ends)])
            places.append(at)
            highest.append(np.take_along_axis(value, at, axis=0))
        hidden = np.maximum(np.concatenate(highest, axis=1) + self.shift, 0)
        z = hidden @ self.weights + self.bias[0]
        error = (_sigmoid(z) - labels) * share / len(labels)
        back = error[:, None] * self.weights * (hidden > 0)
        grads, of_words = [], np.zeros_like(vectors)
        for number, (at, f) in enumerate(zip(places, self.filters.values())):
            g = back[:, number * FILTERS : (number + 1) * FILTERS]
            grads.append(np.zeros_like(f))
            for step in range(len(f)):
                where = laid.flat[at + step]  # (texts, filters)
                grads[-1][step] = np.einsum("tfd,tf->df", vectors[where], g)
                np.add.at(of_words, where.ravel(), (g[:, :, None] * f[step].T).reshape(-1, DEPTH))
        grads += [back.sum(0), hidden.T @ error, error.sum(keepdims=True)]
        per_row = np.repeat(of_words, np.diff(np.append(laid.ends, len(laid.rows))), axis=0)
        live = np.flatnonzero(per_row.any(axis=1) & (laid.rows != ROWS))
        rows, inverse = np.unique(laid.rows[live], return_inverse=True)
        of_rows = np.zeros((len(rows), DEPTH), np.float32)
        np.add.at(of_rows, inverse, per_row[live])
        return grads, rows, of_rows


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    """Steps of Adam on a network; each step hides a part of each text's words."""

    def __init__(self, net: Network, rate: float, seed):
        self.net, self.rate, self.steps = net, rate, 0
        self.rnd = np.random.default_rng(seed)
        parts = [net.table, *net.small()]
        self.mean, self.power = ([np.zeros_like(p) for p in parts] for _ in range(2))

    def step(self, texts: list[list[bytes]], labels: np.ndarray, share: np.ndarray) -> None:
        net, random = self.net, self.rnd.random
        shown = [[w for w, r in zip(t, random(len(t))) if r >= HIDDEN] for t in texts]
        grads, rows, of_rows = net.gradient(laid_out(shown), labels, share)
        self.steps += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        parts = [(net.table, rows, of_rows), *((p, ..., g) for p, g in zip(net.small(), grads))]
        for (p, where, g), m, v in zip(parts, self.mean, self.power):
            m[where] += 0.1 * (g - m[where])
            v[where] += 0.001 * (g * g - v[where])
            p[where] -= (rate * m[where] / (np.sqrt(v[where]) + 1e-8)).astype(np.float32)


def fit(
    texts: list[list[bytes]], labels: np.ndarray, rounds: int = 6, batch: int = BATCH, seed: int = 7
) -> Network:
    """Fit a network by Adam on rows at hand."""
    net = Network.new(seed)
    if not len(texts) or labels.min() == labels.max():
        net.weights[:] = 0
        net.bias[0] = 0 if not len(texts) else 4 * (2 * labels.max() - 1)
        return net
    share = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    rounds = min(max(rounds, -(-LEAST_STEPS * batch // len(texts))), 40)  # few texts: more rounds
    adam = Adam(net, RATE, seed)
    for _ in range(rounds):
        order = adam.rnd.permutation(len(texts))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            adam.step([texts[i] for i in take], labels[take], share[take])
    return net


class Scorer:
    """Scores texts with a fitted network. What a word adds to each filter is worked out once
    and kept, for a bounded number of words."""

    # words whose parts are kept: about 150 bytes of parts and as much of dictionary each, 20 MB a worker
    KEPT = 1 << 16

    def __init__(self, net: Network):
        self.net = net
        self.parts = np.concatenate(
            [f.transpose(0, 2, 1).reshape(-1, DEPTH) for f in net.filters.values()]
        )
        self.place: dict[bytes, int] = {}
        # (place in a window, filter) x word; word 0 is padding
        self.added = np.zeros((len(self.parts), 1 << 16), np.float32)

    def _learn(self, texts: list[list[bytes]]) -> None:
        place = self.place
        new = {w for words in texts for w in words if w not in place}
        if len(place) + len(new) > self.KEPT:
            place.clear()
            new = {w for words in texts for w in words}
        if not new:
            return
        first = len(place) + 1
        end = first + len(new)
        place.update(zip(new, range(first, end)))
        if end > self.added.shape[1]:
            more = np.zeros((len(self.parts), end + end // 2), np.float32)
            more[:, :first] = self.added[:, :first]
            self.added = more
        rows, starts = rows_of(list(new))
        vectors = np.add.reduceat(self.net.table[rows], starts, axis=0)
        self.added[:, first:end] = self.parts @ vectors.T

    def __call__(self, texts: list[list[bytes]]) -> np.ndarray:
        """The logit of each text."""
        if not texts:
            return np.zeros(0)
        self._learn(texts)
        flat, starts, closed, place = [], [], [], self.place
        pad = [0] * (max(WIDTHS) - 1)
        for words in texts:
            starts.append(len(flat))
            flat += [place[w] for w in words] or [0]
            closed.append(len(flat))
            flat += pad
        flat = np.asarray(flat, np.int64)
        closed = (np.asarray(closed)[:, None] + np.arange(len(pad))).ravel()
        highest, at = [], 0
        for width in self.net.filters:
            for one in range(at, at + FILTERS):
                value = self.added[one].take(flat)
                for step in range(1, width):
                    value[:-step] += self.added[one + step * FILTERS].take(flat[step:])
                value[closed] = -np.inf
                highest.append(np.maximum.reduceat(value, starts))
            at += width * FILTERS
        hidden = np.maximum(np.stack(highest, axis=1) + self.net.shift, 0)
        return (hidden @ self.net.weights + self.net.bias[0]).astype(np.float64)


def best_cut(scores: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The cut with the highest F1, in the middle of the gap it falls into.

    Where ``rows`` are given, a score stands for so many rows, and its label for how many of
    them are of class 1.
    """
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    taken = np.arange(1, len(y) + 1) if rows is None else np.cumsum(rows[order])
    f1 = 2 * hits / (taken + y.sum())
    last = np.append(s[1:] != s[:-1], True)  # equal scores fall on one side
    at = int(np.argmax(np.where(last, f1, -1)))
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at] - 1)


def _calibrated(net: Network, docs: DataFrame, marks: DataFrame) -> Network:
    """Move the bias so that 0.5 is the best cut overall, then find each language's own.

    All rows kept for it are scored where they lie and counted by language and step of the
    logit; only counts come to the driver.
    """
    net.thresholds[""] = 0.5
    scored = docs.where(_calibrating("h")).select("id", "lang", _scored(docs, net, "text", np.asarray).alias("logit"))
    counts = written(
        scored.join(marks.where(_calibrating("h")).select("id", "y"), "id")
        .groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.floor(F.col("logit") * GRID).alias("at"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")),
        "calibration",
    )

    def cut(rows) -> float:
        at, n, y = (np.asarray([r[c] for r in rows], np.float64) for c in ("at", "n", "y"))
        return best_cut((at + 0.5) / GRID, y, n)

    common = counts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()
    if not 0 < sum(r["y"] for r in common) < sum(r["n"] for r in common):
        return net
    moved = cut(common)
    net.bias[0] -= moved
    enough = (
        counts.where("lang <> ''").groupBy("lang")
        .agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
        .where(f"least(y, n - y) >= {LEAST_ROWS}")
        .select("lang")
    )
    by_lang: dict[str, list] = {}
    for r in counts.join(enough, "lang").collect():
        by_lang.setdefault(r["lang"], []).append(r)
    for lang in sorted(by_lang):
        net.thresholds[lang] = float(_sigmoid(cut(by_lang[lang]) - moved))
    return net


def _calibrating(hashed: str) -> Column:
    return F.pmod(F.col(hashed), F.lit(CALIBRATION)) == 0


def _learned(net: Network, docs: DataFrame, marks: DataFrame, counts: dict[int, int]) -> Network:
    """The network after all labelled rows that do not calibrate.

    Rows are dealt by a hash of the id to rounds and shards. In each shard a copy of the
    network learns from its rows in the order of their hashes; what the copies moved is
    averaged, for each embedding row over the shards that met it. Sums are of whole numbers,
    so they are the same in any order. Few rows are gone through several times.
    """
    total = sum(counts.values())
    shards = -(-total // (SHARD * ROUNDS))
    passes = min(-(-LEAST_STEPS * BATCH // total), PASSES)
    share = [0.5 * total / counts[y] for y in (0, 1)]
    deal = F.shiftright("h", 20)
    columns = [f"d{i}" for i in range(DEPTH)]
    kinds = pa.schema([("row", pa.int32()), *((c, pa.int64()) for c in columns)])
    both = (
        # the label of an id comes right before its texts
        marks.select("id", "h", "y", F.lit(None).cast("string").alias("text"))
        .unionByName(docs.select("id", "h", F.lit(None).cast("int").alias("y"), "text"))
        .where(~_calibrating("h"))
        .withColumn("shard", F.pmod(F.floor(deal / ROUNDS), F.lit(shards)).cast("int"))
    )
    for number in range(ROUNDS * passes):
        shared = docs.sparkSession.sparkContext.broadcast(net)

        def run(batches, shared=shared, number=number):
            start = shared.value
            learner = start.copy()
            adam = Adam(learner, LATER_RATE, (number, TaskContext.get().partitionId()))
            for texts, y in _labelled(batches):
                labels = np.asarray(y, np.float32)
                adam.step(texts, labels, np.where(labels > 0, share[1], share[0]).astype(np.float32))
            moved = learner.flat().astype(np.float64) - start.flat()
            rows = np.flatnonzero(moved.any(axis=1))
            whole = np.rint(moved[rows] * FINE).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), *(pa.array(whole[:, i]) for i in range(DEPTH))], schema=kinds
            )

        moved = (
            both.where(F.pmod(deal, F.lit(ROUNDS)) == number % ROUNDS)
            .repartitionById(shards, F.col("shard"))
            .sortWithinPartitions("h", "id", F.col("y").desc_nulls_last(), "text")
            .select("id", "y", "text")
            .mapInArrow(giving_back(run), "row int, " + ", ".join(f"{c} long" for c in columns))
            .groupBy("row")
            .agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in columns))
            .toArrow()
        )
        step = np.stack([moved[c].to_numpy() for c in columns], axis=1) / FINE
        flat = net.flat()
        flat[moved["row"].to_numpy()] += (step / moved["n"].to_numpy()[:, None]).astype(np.float32)
        net = net.copy(flat)
    return net


def _labelled(batches) -> Iterator[tuple[list[list[bytes]], list[int]]]:
    """Words and labels of texts that follow their id's label, a step's worth at a time."""
    known, label = None, None
    texts, labels = [], []
    for batch in batches:
        ids, ys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, (key, y) in enumerate(zip(ids, ys)):
            if y is not None:
                known, label = key, y
            elif key == known:
                texts.append(words_of(batch.column(2)[row].as_py()))
                labels.append(label)
                if len(texts) == BATCH:
                    yield texts, labels
                    texts, labels = [], []
    if texts:
        yield texts, labels


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "toxic",
    sample_per_class: int = SAMPLE_PER_CLASS,
) -> Network:
    """Fit on all labelled rows; the start on at most ``sample_per_class`` rows of each class,
    chosen by a hash of the id.

    Rows held out are never read, nor labels that are null or contradict each other. The
    start's ids and labels are broadcast and its texts come to the driver; both are bounded
    by the parameter. Where it holds all labelled rows, it is all of the fitting. Three in
    four rows are fitted, the others calibrate.
    """
    ship(docs.sparkSession)
    rows = (
        docs.select(
            docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")
        )
        .where("id IS NOT NULL AND text IS NOT NULL")
        .where(~held_out(F.col("id")))
        .withColumn("h", F.xxhash64(F.col("id").cast("string")))
    )
    marks = written(
        labels.select(
            labels[id_col].cast(id_type(docs, id_col)).alias("id"),
            labels[label_col].cast("int").alias("y"),
        )
        .where("id IS NOT NULL AND y IN (0, 1)")
        .where(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.min("y").alias("y"), F.max("y").alias("y2"))
        .where("y = y2")
        .join(rows.select("id"), "id", "left_semi")
        .select("id", "y", F.xxhash64(F.col("id").cast("string")).alias("h")),
        "labelled",
    )
    chosen = [marks.where(f"y = {y}").orderBy("h", "id").limit(sample_per_class) for y in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]).where(~_calibrating("h")).select("id", "y"))
    start = rows.join(sample, "id").select("id", "h", "text", "y").toArrow().to_pylist()
    start.sort(key=lambda r: (r["h"], str(r["id"]), r["text"]))
    once: dict[bytes, bytes] = {}  # equal words are one object
    words = [[once.setdefault(w, w) for w in words_of(r["text"])] for r in start]
    net = fit(words, np.asarray([r["y"] for r in start], np.float32))
    of_class = marks.groupBy("y", _calibrating("h").alias("kept")).count().collect()
    counts = {y: sum(r["count"] for r in of_class if r["y"] == y and not r["kept"]) for y in (0, 1)}
    most = max((sum(r["count"] for r in of_class if r["y"] == y) for y in (0, 1)))
    if most > sample_per_class and min(counts.values()):
        net = _learned(net, rows.select("id", "h", "text"), marks, counts)
    return _calibrated(net, rows, marks)


def _scored(docs: DataFrame, net: Network, text_col: str, of_logits) -> Column:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(net)

    def worker():
        score = Scorer(shared.value)
        return lambda texts: of_logits(score([words_of(t) for t in texts]))

    return text_udf("double", pa.float64(), worker)(docs[text_col])


def toxicity(docs: DataFrame, net: Network, text_col: str = "text") -> Column:
    """Score of a text column between 0 and 1; only the text counts.

    The network is broadcast; its size is fixed by the constants above.
    """
    return _scored(docs, net, text_col, _sigmoid)


def threshold(lang: Column, net: Network) -> Column:
    """The threshold of a language, calibrated on labelled rows, or the common one."""
    chosen = F.lit(net.thresholds[""])
    for name, value in sorted(net.thresholds.items()):
        if name:
            chosen = F.when(lang == name, F.lit(value)).otherwise(chosen)
    return chosen


def score_documents(
    docs: DataFrame,
    net: Network,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, rejected``, a row per row.

    ``predicted`` cuts at 0.5, ``rejected`` at the language's threshold. Null and empty
    texts are scored like a text without known words. Unknown and null languages take the
    common threshold. Repeated rows and null ids come back as they are (a null id counts
    as the empty string in the split); other columns are not read; an empty table gives an
    empty one. Without labels of both classes every text gets the same score.
    """
    texts = docs.select(
        docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")
    )
    scored = texts.select("doc_id", "lang", toxicity(texts, net).alias("score"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        threshold(F.col("lang"), net).alias("threshold"),
        (F.col("score") >= threshold(F.col("lang"), net)).alias("rejected"),
    )
