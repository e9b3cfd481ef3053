"""Toxicity by class-conditional Kneser-Ney models.

Two models over the letters of words, one of toxic and one of ordinary labelled
documents, share the continuation counts to which both back off. Where neither class
has seen a letter after a context, the shared probability cancels, and what is left
is the ratio of the two backoff weights; so the ratio of the likelihoods needs two
tables only. A document is judged by the length-normalised difference of its
log-likelihoods, as a whole and over its most telling words; a logistic curve fitted
on a bounded sample of the labelled rows turns these into a score.

The counts are of all labelled rows and stay in Spark: words are summed by class, then
their n-grams, then the n-grams by context; the driver gets the ratios only, keyed by
64-bit hashes, and passes them on through mapped files, part by part. Of the halves it
gets what the texts of the curve look up.
"""

from __future__ import annotations

import heapq
import math
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import CHUNKS
from .common import checkpoint, fresh, map_batches, small_batches, texts

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
WORD = re.compile(r"[^\W\d_]+")
#: Letters of context; the mark before a word counts as one.
CONTEXT = 7
DISCOUNT = 0.75
MARK, END = "^", "$"
TOP = (1, 2, 4)
#: Words longer than this are cut into parts of this length.
LONGEST = 40
#: Words whose n-grams are looked up at once, and word kinds that a task counts before it hands them on.
BLOCK, KINDS = 20_000, 200_000
#: Labelled ids (17 bytes each) and ratios of n-grams and contexts (12 bytes each) that are sent to the driver and broadcast at most; beyond, they are joined.
BROADCAST, MOST = 4_000_000, 8_000_000
#: A key on more than this share of the rows to be joined is hot; there are fewer than 1 / HOT of them, so that they can be broadcast.
HOT = 1e-5
COUNTS = ("n0", "n1", "n2", "n3")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: The inverse of BASE modulo 2**64.
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The marked words as one row of letters; the places of all n-grams' last letters, and the n-grams' sizes."""
    codes = np.frombuffer("".join([f"{MARK}{w}{END}" for w in words]).encode("utf-32-le"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = np.flatnonzero(inside)
    return codes, last, np.minimum(inside[last], CONTEXT) + 1


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each letter."""
    x = codes.astype(np.uint64) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x * BASE ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def _hashes(codes: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams by the place of the last letter and the size, and of their contexts; 0 for size 0."""
    mixed, out = _mixed(codes), np.zeros(len(last), np.uint64)
    for back in range(int(sizes.max(initial=0)) - 1, -1, -1):
        of = sizes > back
        out[of] = out[of] * BASE + mixed[last[of] - back]
    return out, (out - mixed[last]) * BACK


class Table:
    """Values by sorted 64-bit keys, found by the keys' first bits and from there on by bisection."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(1, len(keys).bit_length() - 2)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
        self.start = np.append(self.start, self.start.dtype.type(len(keys)))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys' values, 0 for those that are not there, and which are."""
        if not len(self.keys):
            return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        part = (keys >> self.shift).astype(np.int64)
        low, high = self.start[part], self.start[part + 1]
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            less = self.keys[np.minimum(middle, len(self.keys) - 1)] < keys
            less &= low < high
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        low = np.minimum(low, len(self.keys) - 1)
        known = self.keys[low] == keys
        return np.where(known, self.values[low], np.float32(0)), known


def _looked_up(rows: DataFrame, table: DataFrame, key: str, counted: DataFrame) -> DataFrame:
    """rows with the columns of table (a row for each key), null where it has none.

    counted: has the keys of rows, and is checkpointed. Hot keys are joined where the
    rows are, so that a word of every text does not meet in one task.
    """
    of = counted.groupBy(key).count()
    least = HOT * counted.count()
    hot = checkpoint(of.where(F.col("count") > least).select(key))
    often = rows.join(F.broadcast(checkpoint(hot.join(table, key, "left"))), key)
    return often.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left"))


def parts(word: str) -> list[str]:
    return [word[k : k + LONGEST] for k in range(0, len(word), LONGEST)]


@dataclass
class Model:
    """Log-likelihood ratios by n-gram, by context alone (sorted hashes and values), and the curve over the features."""

    grams: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    _tables: tuple | None = None
    _memo: dict | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None, "_memo": None}

    def words(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if self._tables is None:
            self._tables = Table(*self.grams), Table(*self.contexts)
        grams, contexts = self._tables
        out = np.zeros(len(words))
        for at in range(0, len(words), BLOCK):
            codes, last, sizes = _letters(words[at : at + BLOCK])
            gram, context = _hashes(codes, last, sizes)
            r, known = grams.find(gram)
            r[~known] = contexts.find(context[~known])[0]
            n = np.fromiter(map(len, words[at : at + BLOCK]), np.int64) + 1
            out[at : at + BLOCK] = np.add.reduceat(r.astype(float), np.cumsum(n) - n)
        return out

    def tokens(self, tokens: list[str]) -> list[tuple[float, int, tuple[float, ...]]]:
        """The ratio, the letters and the words' own ratios of what stands between spaces."""
        words = [[part for w in WORD.findall(t) for part in parts(w)] for t in tokens]
        each, at, out = self.words([w for ws in words for w in ws]).tolist(), 0, []
        for ws in words:
            r = tuple(each[at : at + len(ws)])
            at += len(ws)
            out.append((sum(r), sum(map(len, ws)) + len(ws), r))
        return out

    def features(self, batch: list[str], memo: dict) -> list[list[float]]:
        """The features of each text; memo holds the tokens met before, a bounded number of them."""
        out, splits = [], [text.lower().split() for text in batch]
        new = dict.fromkeys(t for split in splits for t in split)
        if len(memo) + len(new) > CHUNKS:
            memo.clear()
        new = [t for t in new if t not in memo]
        memo.update(zip(new, self.tokens(new)))
        for split in splits:
            parts = [memo[t] for t in split]
            total, letters = sum([p[0] for p in parts]), sum([p[1] for p in parts])
            best = heapq.nlargest(max(TOP), [r for p in parts for r in p[2]])
            best += [0.0] * (max(TOP) - len(best))
            out.append([total / (letters + 20), *(min(sum(best[:k]) / k, 30.0) for k in TOP)])
        return out

    def scores(self, batch: list[str], memo: dict) -> list[float]:
        out = []
        for features in self.features(batch, memo):
            x = [(f - m) / s for f, m, s in zip(features, self.mean, self.scale)]
            z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x))
            out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
        return out


def word_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``word, n0, n1, n2, n3``: the words of all labelled texts with their counts, toxic and ordinary in half 0, toxic and ordinary in half 1.

    The empty word counts the texts. Words over LONGEST letters are counted in their parts.
    Null texts count as empty ones, repeated rows each; without labelled texts there are no rows.
    """
    rows = _with_text(docs, labelled(labels)).select("text", (2 * F.col("half") + 1 - F.col("toxic")).cast("int").alias("column"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(4)]

        def done() -> pa.RecordBatch:
            words = list({}.fromkeys(w for c in counts for w in c))
            out = pa.record_batch([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", *COUNTS])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for text, column in zip(texts(batch), batch.column(1).to_pylist()):
                words = WORD.findall(text.lower())
                counts[column].update(words if max(map(len, words), default=0) <= LONGEST else [p for w in words for p in parts(w)])
                counts[column][""] += 1
                if sum(map(len, counts)) > KINDS:
                    yield done()
        yield done()

    return rows.mapInArrow(run, "word string, " + ", ".join(f"{n} long" for n in COUNTS)).groupBy("word").agg(*[F.sum(n).alias(n) for n in COUNTS])


def gram_counts(words: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``gram, n0, n1, n2, n3``: each letter of the marked words with up to ``context`` letters before it."""
    marked = words.where("word <> ''").select(F.concat(F.lit(MARK), "word", F.lit(END)).alias("m"), *COUNTS)
    last = marked.select("m", *COUNTS, F.explode(F.sequence(F.lit(2), F.length("m"))).alias("last"))
    gram = F.expr(f"substring(m, greatest(1, last - {context}), least(last, {context + 1}))")
    return last.select(gram.alias("gram"), *COUNTS).groupBy("gram").agg(*[F.sum(n).alias(n) for n in COUNTS])


def shared(grams: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``gram, low``: P(last letter | the letters before) of grams of up to ``context`` letters, over continuation counts that both classes share.

    A gram counts once for each letter that stands before it, and a gram at the start
    of a word once. Rows of one context are at most as many as there are letters, so
    that the windows by context stay small.
    """
    ends = F.transform(F.sequence(F.lit(2), F.length("gram")), lambda k: F.substring(F.col("gram"), -k, k))
    kinds = checkpoint(grams.select(F.explode(ends).alias("gram")).distinct())
    again = kinds.where(F.col("gram").startswith(MARK) & (F.length("gram") <= context))
    counts = checkpoint(kinds.select(F.expr("substring(gram, 2)").alias("gram")).union(again).groupBy("gram").agg(F.count("*").alias("n")))
    below, every = None, None
    for k in range(1, context + 1):
        by = W.partitionBy(F.expr(f"substring(gram, 1, {k - 1})"))
        of = counts.where(F.length("gram") == k).select("gram", "n", F.sum("n").over(by).alias("s"), F.count("*").over(by).alias("kinds"))
        if below is None:
            of = of.withColumn("rest", 1 / F.col("kinds"))
        else:
            of = of.join(below.select(F.col("gram").alias("end"), F.col("low").alias("rest")), F.expr("substring(gram, 2)") == F.col("end"))
        below = checkpoint(of.select("gram", ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("rest")) / F.col("s")).alias("low")))
        every = below if every is None else every.union(below)
    return every


def ratios(grams: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``context, hash, r0, r1, r``: log P(toxic) / P(ordinary) by gram, and of the backoff weights by context, from half 0, half 1 and all rows."""
    by = W.partitionBy(F.expr("substring(gram, 1, length(gram) - 1)"))
    n = {c: F.col(f"n{c}") for c in range(4)} | {"t": F.col("n0") + F.col("n2"), "o": F.col("n1") + F.col("n3")}
    of = grams.select("gram", *[v.alias(f"n_{c}") for c, v in n.items()], *[F.sum(v).over(by).alias(f"s_{c}") for c, v in n.items()], *[F.sum((v > 0).cast("long")).over(by).alias(f"k_{c}") for c, v in n.items()], (F.row_number().over(by.orderBy("gram")) == 1).alias("first"))
    low = shared(grams, context).withColumnRenamed("gram", "end")
    of = of.join(low, F.expr(f"right(gram, {context})") == F.col("end"))
    weight = lambda c: F.when(F.col(f"s_{c}") > 0, DISCOUNT * F.col(f"k_{c}") / F.col(f"s_{c}")).otherwise(1.0)
    p = lambda c: F.when(F.col(f"s_{c}") > 0, F.greatest(F.col(f"n_{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"s_{c}")).otherwise(0.0) + weight(c) * F.col("low")
    sides = {"r0": (0, 1), "r1": (2, 3), "r": ("t", "o")}
    of = of.select("gram", "first", *[F.ln(p(t) / p(o)).alias(r) for r, (t, o) in sides.items()], *[F.ln(weight(t) / weight(o)).alias(f"w{r}") for r, (t, o) in sides.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, first = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            codes, last = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4"), np.cumsum(sizes) - 1
            gram, context = _hashes(codes, last, sizes)
            for is_context, hashes, at in ((False, gram, 2), (True, context[first], 5)):
                values = [batch.column(at + k).to_numpy(zero_copy_only=False) for k in range(3)]
                values = [v[first] if is_context else v for v in values]
                yield pa.record_batch([pa.array([is_context] * len(hashes), pa.bool_()), pa.array(hashes.view(np.int64)), *(pa.array(v.astype(np.float32)) for v in values)], names=["context", "hash", *sides])

    return of.mapInArrow(run, "context boolean, hash long, r0 float, r1 float, r float")


def models(table: DataFrame, names: tuple[str, ...] = ("r0", "r1", "r")) -> list[Model]:
    """The models of half 0, of half 1 and of all labelled rows, or of those named, from what ``ratios`` gives; they share their keys.

    Spark orders the rows, and the driver writes them part by part to temporary files
    that it maps, so that its memory holds a part and not the table.
    """
    small_batches(table.sparkSession)
    columns = ("hash", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_context = batch.column(0).to_numpy(zero_copy_only=False)
            for c in (False, True):
                if (of := of_context == c).any():
                    values = [batch.column(k + 1).to_numpy()[of].tobytes() for k in range(len(columns))]
                    yield pa.record_batch([pa.array([c]), *(pa.array([v], pa.binary()) for v in values)], names=["context", *columns])

    unsigned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))
    rows = table.select("context", *columns).orderBy("context", unsigned).mapInArrow(run, "context boolean, " + ", ".join(f"{n} binary" for n in columns))
    files = {(c, n): tempfile.TemporaryFile() for c in (False, True) for n in columns}
    for row in rows.toLocalIterator():
        for n in columns:
            files[row.context, n].write(row[n])

    def mapped(c: bool, name: str) -> np.ndarray:
        dtype = np.uint64 if name == "hash" else np.float32
        with files[c, name] as f:
            return np.asarray(np.memmap(f, dtype, "r")) if f.tell() else np.zeros(0, dtype)

    keys = [mapped(c, "hash") for c in (False, True)]
    return [Model(*[(k, mapped(c, name)) for c, k in zip((False, True), keys)]) for name in names]


def looked_up_by(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of what ``ratios`` gives that the words of rows' ``text`` look up."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = list(dict.fromkeys(p for text in texts(batch) for w in WORD.findall(text.lower()) for p in parts(w)))
        grams, contexts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for at in range(0, len(words), BLOCK):
            for of, hashes in zip((grams, contexts), _hashes(*_letters(words[at : at + BLOCK]))):
                of.append(np.unique(hashes))
        grams, contexts = np.unique(np.concatenate(grams)), np.unique(np.concatenate(contexts))
        of_context = np.repeat([False, True], [len(grams), len(contexts)])
        return pa.record_batch([pa.array(of_context), pa.array(np.concatenate([grams, contexts]).view(np.int64))], names=["context", "hash"])

    return table.join(map_batches(rows.select("text"), run, "context boolean, hash long").distinct(), ["context", "hash"], "left_semi")


@dataclass
class Joined:
    """A model whose table of ratios is too large to be sent about: words are joined with it."""

    table: DataFrame
    curve: Model | None = None

    def features(self, rows: DataFrame) -> DataFrame:
        """``row, f0, f1, f``: the features of each ``row, text`` by the models of half 0, half 1 and all rows."""

        def split(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[], [], []]
            for row, text in zip(batch.column(0).to_pylist(), texts(batch)):
                counts = Counter(p for w in WORD.findall(text.lower()) for p in parts(w))
                counts[""] = 1  # no word; keeps rows without words
                for column, values in zip(out, ([row] * len(counts), counts.keys(), counts.values())):
                    column.extend(values)
            return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["row", "word", "n"])

        def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = batch.column(0).to_pylist()
            codes, last, sizes = _letters(words)
            gram, context = _hashes(codes, last, sizes)
            return pa.record_batch([pa.array(np.repeat(words, [len(w) + 1 for w in words]).tolist(), pa.string()), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], names=["word", "gram", "of"])

        words = checkpoint(map_batches(rows.select("row", "text"), split, "row long, word string, n long"))
        names = ("r0", "r1", "r")
        each = checkpoint(map_batches(words.where("word <> ''").select("word").distinct(), grams, "word string, gram long, of long", rows=4096))
        by_gram = self.table.where("NOT context").select(F.col("hash").alias("gram"), *names)
        by_context = self.table.where("context").select(F.col("hash").alias("of"), *[F.col(n).alias(f"c{n}") for n in names])
        found = _looked_up(_looked_up(each, by_gram, "gram", each), by_context, "of", each)
        ratio = checkpoint(found.groupBy("word").agg(*[F.sum(F.coalesce(n, f"c{n}", F.lit(0.0)).cast("double")).alias(n) for n in names]))
        joined = _looked_up(words, ratio, "word", words)
        some = F.col("word") != ""
        letters = F.sum(F.when(some, F.col("n") * (F.length("word") + 1)).otherwise(0)) + 20
        out = []
        for n, f in zip(names, ("f0", "f1", "f")):
            best = F.slice(F.sort_array(F.flatten(F.collect_list(F.when(some, F.array_repeat(n, F.least("n", F.lit(max(TOP))).cast("int"))))), False), 1, max(TOP))
            tops = [F.least(F.aggregate(F.slice(best, 1, k), F.lit(0.0), lambda x, y: x + y) / k, F.lit(30.0)) for k in TOP]
            out.append(F.array(F.coalesce(F.sum(F.when(some, F.col("n") * F.col(n))), F.lit(0.0)) / letters, *tops).alias(f))
        return joined.groupBy("row").agg(*out)

    def scored(self, docs: DataFrame) -> tuple[DataFrame, str, str]:
        """docs with a score by row, and the names of these two columns."""
        row, score = fresh(docs, "row", "score")
        placed = checkpoint(docs.withColumn(row, F.monotonically_increasing_id()))
        c = self.curve
        z = sum((w * (F.col("f")[k] - m) / s for k, (w, m, s) in enumerate(zip(c.weights[1:], c.mean, c.scale))), F.lit(c.weights[0]))
        of = self.features(placed.select(F.col(row).alias("row"), "text")).select(F.col("row").alias(row), (1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))).alias(score))
        return placed.join(of, row), row, score


def fit(of: DataFrame | Joined, rows: DataFrame, totals: tuple[int, int]) -> Model | Joined:
    """The model of all labelled rows, with a curve fitted on ratios that the other half of them gives.

    of: what ``ratios`` gives, checkpointed, or joined with it. rows: ``text, toxic,
    half``, a sample for the curve, whose features are taken in the executors; the
    curve is moved to the odds of totals (ordinary, toxic rows). With fewer than two
    rows of either label nothing can be told, and every document scores 0 (to 17
    digits).
    """
    rows = checkpoint(rows.select("text", F.col("toxic").cast("int").alias("toxic"), F.col("half").cast("int").alias("half"), F.monotonically_increasing_id().alias("row")))
    shared_halves = None
    if isinstance(of, Joined):
        features = rows.join(of.features(rows), "row").select("toxic", F.when(F.col("half") == 0, F.col("f1")).otherwise(F.col("f0")).alias("f"))
    else:
        shared_halves = rows.sparkSession.sparkContext.broadcast(models(checkpoint(looked_up_by(of, rows)), ("r0", "r1")))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            of, half = texts(batch), batch.column(2).to_pylist()
            got = [m.features(of, {}) for m in shared_halves.value]
            f = [got[1 - h][k] for k, h in enumerate(half)]
            return pa.record_batch([batch.column(1), pa.array(f, pa.list_(pa.float64()))], names=["toxic", "f"])

        features = map_batches(rows, run, "toxic int, f array<double>")
    got = sorted((r.toxic, r.f) for r in features.collect())  # the fit must not depend on the order
    if shared_halves:
        shared_halves.destroy()
    turn = [sum(y == k for y, _ in got) for k in (0, 1)]
    if min(turn) < 2 or min(totals) < 1:
        return silent()
    curve = fit_curve(silent() if isinstance(of, Joined) else models(of, ("r",))[0], np.array([f for _, f in got]), np.array([y for y, _ in got], float))
    curve.weights[0] += math.log(totals[1] / totals[0]) - math.log(turn[1] / turn[0])
    return Joined(of.table, curve) if isinstance(of, Joined) else curve


def silent() -> Model:
    """A model that tells nothing."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    return Model(none, none, [0.0] * (1 + len(TOP)), [1.0] * (1 + len(TOP)), [-40.0, *([0.0] * (1 + len(TOP)))])


def fit_curve(model: Model, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Model:
    """Fit the logistic curve by damped Newton steps; a ridge keeps it finite."""
    model.mean = x.mean(0).tolist()
    model.scale = [s if s > 1e-9 else 1.0 for s in x.std(0)]
    z = np.hstack([np.ones((len(x), 1)), (x - model.mean) / model.scale])
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-3, *([1.0] * (z.shape[1] - 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 2.0 / (1e-9 + float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w.tolist()
    return model


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic, half`` of each labelled doc_id, never a held-out one.

    A doc_id with several labels counts as toxic if any of them says so; rows without
    a label of 0 or 1 are left out. The half is a bit of a hash of doc_id.
    """
    of = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    return of.where(~held_out("doc_id")).withColumn("half", F.xxhash64("doc_id").bitwiseAND(F.lit(1).cast("long")).cast("int"))


def _with_text(docs: DataFrame, of: DataFrame) -> DataFrame:
    """``doc_id, text, toxic, half`` of each row of docs with a label; labels of a checked number are sent to the texts, else the texts are dealt by doc_id."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    return text.join(F.broadcast(of) if of.count() <= BROADCAST else of, "doc_id")


def curve_rows(docs: DataFrame, labels: DataFrame, bound: dict[int, int]) -> DataFrame:
    """``doc_id, text, toxic, half`` of at most ``bound[label]`` labelled doc_ids of each label.

    The ids with the smallest hash are taken, so that the choice does not depend on how
    the tables are read; of an id's texts the smallest.
    """
    of, taken = labelled(labels), None
    for label, n in sorted(bound.items()):
        some = of.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        taken = some if taken is None else taken.union(some)
    # the taken ids are bounded by the parameter, so that they can be broadcast
    return _with_text(docs, checkpoint(taken)).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("half").alias("half"))


def held_out(name: str):
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Texts by label at most on which the curve is fitted.
BOUND = {1: 1000, 0: 1200}
THRESHOLD = 0.3


def train(docs: DataFrame, labels: DataFrame, bound: dict[int, int] | None = None) -> Model | Joined:
    """The model of the labelled rows. Counts are of all labelled texts, each row counting on its own where a doc_id repeats; bound is for the curve.

    A labelled row with a null text counts nothing; labels without a document and empty tables are no error.
    """
    words = checkpoint(word_counts(docs, labels))
    n = words.where("word = ''").select(*COUNTS).first()
    if n is None or not words.where("word <> ''").limit(1).count():
        return silent()
    table = checkpoint(ratios(checkpoint(gram_counts(words))))
    return fit(table if table.count() <= MOST else Joined(table), curve_rows(docs, labels, bound or BOUND), (n.n1 + n.n3, n.n0 + n.n2))


def score_documents(docs: DataFrame, model: Model | Joined, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    docs: has ``doc_id`` and ``text``; other columns are not read. A null or empty
    text has a score too, from features of zero. Repeated rows give a row each, a null
    doc_id stays null and is not held out; an empty table gives none. A model of up to
    MOST ratios is broadcast; with a larger one each word is joined with its n-grams'
    ratios and each document with its words.
    """
    if isinstance(model, Joined):
        of, _, score = model.scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
        return of.select("doc_id", held_out("doc_id").alias("held_out"), F.col(score).alias("score"), (F.col(score) >= threshold).cast("int").alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _scores(shared.value, texts(batch))
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out("doc_id"))
    return map_batches(of, run, SCHEMA)


def drop_toxic(docs: DataFrame, model: Model | Joined, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score stays under the threshold; null and empty texts have one too, repeated rows are each kept or dropped, an empty table stays empty."""
    if isinstance(model, Joined):
        of, _, score = model.scored(docs)
        return of.where(F.col(score) < threshold).select(*[f"`{c}`" for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([s < threshold for s in _scores(shared.value, texts(batch))], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def _scores(model: Model, batch: list[str]) -> list[float]:
    if model._memo is None:
        model._memo = {}
    return model.scores(batch, model._memo)
