"""LM scoring: a hashed maximum-entropy model of words with a class-factored softmax, trained by distributed updates.

P(w | h) = P(c | h) P(w | c, h). The class c of a word has logits that sum rows of a hashed table, one row for each
n-gram or skip feature of the history h. The word within its class has a prior weight and the weight of a hashed feature of
itself and the last known word; the norms of all classes after all these contexts are made once for a model. Words
outside the model's vocabulary share one class, within which the smoothed unigram decides; so the probabilities of all
words and of one unseen word sum to 1.

The vocabulary and both hashed tables grow with the training tokens, up to bounds that keep a model within about 100 MB.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ASCII_LOWER, binary, fold, ready

END = b" "  # no word holds a space
LISTED = 100_000  # most frequent tokens whose counts are broadcast; the others are joined
WORDS = 4096, 65_536  # of these, the model's vocabulary: the least, growing with the root of the tokens to the most
CLASSES = 48  # of known words; one more each for END, for unknown words, and for the start as history
ROWS = 14, 18  # log2 rows of the classes' hashed table, the least and the most
SLOTS = 18, 22  # log2 weights of the words' hashed table
CONTEXTS = 1024  # rows of the last known word, which rare words share
SIGNS = 64  # frequent words whose share in its documents describes a word
MINIBATCH, RATE, HOLD, ROUNDS = 16384, 0.5, 3.0, 2  # HOLD keeps rows that were met once from large steps
DAMP = 2.0  # tokens that a weight of the words' table is held back by
TOKENS_A_LEARNER, LEARNERS = 8_000_000, 4096
FAN_IN = 16
FLUSH = 1 << 18


def words_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").translate(ASCII_LOWER).split(), END]


def token_counts(texts: DataFrame) -> DataFrame:
    """token and its count n over all texts, each text's END included; counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["token", "n"])

        for batch in batches:
            for t in binary(batch.column(0)):
                counts.update(words_of(t))
                if len(counts) > FLUSH:
                    yield flush()
                    counts.clear()
        yield flush()

    return texts.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _summed(blocks: DataFrame, learners: int) -> dict[int, np.ndarray]:
    """The sum of the float arrays of each block, in a tree: no task meets more than FAN_IN arrays."""

    def add(table: pa.Table) -> pa.Table:
        total: np.ndarray | None = None
        for data in table.column("data"):
            x = np.frombuffer(data.as_buffer(), np.float32)
            total = x.copy() if total is None else total + x
        return pa.table({"block": table.column("block").slice(0, 1), "salt": table.column("salt").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    while learners > 1:
        learners = -(-learners // FAN_IN)
        blocks = blocks.withColumn("salt", F.floor(F.col("salt") / FAN_IN)).groupBy("block", "salt").applyInArrow(add, _BLOCK)
    return {b: np.frombuffer(d, np.float32) for b, _, d in blocks.collect()}


def _blocks(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    learner = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in parts], pa.int64()), pa.array([learner] * len(parts), pa.int64()), pa.array([x.astype(np.float32).tobytes() for _, x in parts], pa.binary())],
        ["block", "salt", "data"],
    )


_BLOCK = "block long, salt long, data binary"


@dataclass
class Vocabulary:
    """Counts of the LISTED tokens, and how many tokens and distinct ones there are in all."""

    ids: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int
    words: int

    def grown(self, least: int, most: int, root: int) -> int:
        """From ``least`` at four million tokens up to ``most``, with a root of the tokens."""
        return int(min(most, least * max(1.0, self.total / 4e6) ** (1 / root)))

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed unigram probability."""
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Ids of all tokens of all texts, -1 for those not listed, and where each text begins; and the tokens."""
        get, tokens = self.ids.get, [words_of(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in tokens], dtype=np.int64)])
        ids = np.empty(starts[-1], np.int64)
        for w, a, b in zip(tokens, starts, starts[1:]):
            ids[a:b] = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
        return ids, starts, tokens


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """Lists the tokens whose count is among the largest, as many whole counts as LISTED tokens allow.

    The least count to list comes from a histogram of counts, exact below 1,000 and in steps of a hundredth above,
    so that nothing is sorted and no task meets the candidates of all others.
    """
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    n = F.col("n")
    step = F.when(n < 1000, n).otherwise(F.floor(F.log(n / 1000.0) * 100) + 1000)
    tokens: list[bytes] = []
    n_of: list[int] = []
    if distinct:
        least, room = None, LISTED - 1
        for s, k in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):
            room -= k
            if room < 0:
                break
            least = s
        listed = counts.where((step >= least) if least is not None else F.lit(False)) if room < 0 else counts
        listed = listed.toArrow()
        found = dict(zip(listed.column("token").to_pylist(), listed.column("n").to_pylist()))
        if END not in found:  # the model always knows END
            found[END] = counts.where(F.col("token") == F.lit(bytearray(END))).first()["n"]
        tokens = sorted(found, key=lambda t: (-found[t], t))
        at = min(tokens.index(END), WORDS[0] - 1)
        tokens.remove(END)
        tokens.insert(at, END)
        n_of = [found[t] for t in tokens]
    made = Vocabulary({t: i for i, t in enumerate(tokens)}, np.array(n_of, np.int64), int(total or 0), int(distinct), 0)
    return replace(made, words=min(made.grown(*WORDS, 2), len(tokens)))


def encoded(df: DataFrame, held_out, shared: Broadcast) -> DataFrame:
    """Every row's tokens, as ids of the listed ones and -1, so that later passes read numbers; with what they sum to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        base = np.append(v.base(v.counts), 0.0) if v.total else np.zeros(1)
        for batch in batches:
            ids, starts, tokens = v.encode(binary(batch.column(2)))
            known = (ids >= 0).astype(np.int64)
            sums = [np.add.reduceat(x, starts[:-1]) if len(ids) else [] for x in (known, base[ids])]
            cold = [list(Counter([w[i] for i in np.flatnonzero(ids[a:b] < 0).tolist()]).items()) for w, a, b in zip(tokens, starts, starts[1:])]
            held = [ids[a:b].astype(np.int32).tobytes() for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(starts)), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.float64()), pa.array(held, pa.binary()), pa.array(cold, pa.map_(pa.binary(), pa.int64()))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids", "cold"],
            )

    schema = T.StructType([df.schema["doc_id"]]).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("ids", "binary")
    made = df.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, schema.add("cold", T.MapType(T.BinaryType(), T.LongType(), False)))
    return made.withColumn("row", F.monotonically_increasing_id())


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens of all texts, and where each text begins."""
    held = column.to_pylist()
    starts = np.concatenate([[0], np.cumsum([len(h) // 4 for h in held], dtype=np.int64)])
    return np.frombuffer(b"".join(held), np.int32).astype(np.int64), starts


def learn_classes(texts: DataFrame, vocabulary: Vocabulary, learners: int) -> np.ndarray:
    """A class for each word of the model, by k-means over the mix of frequent words in the documents that hold it."""
    words, end = vocabulary.words, vocabulary.ids.get(END, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((words, SIGNS), np.float32)
        for batch in batches:
            ids, starts = _tokens(batch.column(0))
            for a, b in zip(starts, starts[1:]):
                own = ids[a:b]
                held = np.bincount(own[(own >= 0) & (own < words)], minlength=SIGNS)
                signs = held[:SIGNS].astype(np.float32)
                out[np.flatnonzero(held)] += np.sqrt(signs / max(1.0, signs.sum()))
        yield _blocks([(k, out[k : k + 256]) for k in range(0, words, 256)])

    found = _summed(texts.select("ids").mapInArrow(run, _BLOCK), learners)
    x = np.concatenate([found[k] for k in sorted(found)]).reshape(words, SIGNS).astype(np.float64) if found else np.zeros((words, SIGNS))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rng, weight = np.random.default_rng(3), np.sqrt(vocabulary.counts[:words])[:, None]
    centres = x[rng.permutation(words)[:CLASSES]].copy()
    of = np.zeros(words, np.int64)
    for _ in range(25):
        of = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        for k in range(len(centres)):
            if (of == k).any():
                centres[k] = (x[of == k] * weight[of == k]).sum(axis=0) / weight[of == k].sum()
    of[end] = CLASSES
    return of


OUTPUTS = CLASSES + 2  # END's class and that of unknown words
UNKNOWN, START = CLASSES + 1, CLASSES + 2


@dataclass
class Model:
    classes: np.ndarray  # of each known word
    prior: np.ndarray  # OUTPUTS log priors
    table: np.ndarray  # rows x OUTPUTS
    own: np.ndarray  # each known word's prior weight in its class
    pairs: np.ndarray  # weights of hashed pairs of a context and a word
    norms: np.ndarray  # context x class

    def slots(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        mixed = (context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(len(self.pairs) - 1)).astype(np.int64)

    def normed(self) -> Model:
        """With the log of the sum of all words' weights of each class, after each context."""
        words, order = np.arange(len(self.classes)), np.argsort(self.classes, kind="stable")
        first = np.searchsorted(self.classes[order], np.arange(OUTPUTS + 1))
        norms = np.full((CONTEXTS + 1, OUTPUTS), -np.inf)
        used = np.flatnonzero(np.diff(first))
        for c in range(CONTEXTS + 1):
            weight = np.exp(self.own + self.pairs[self.slots(np.full(len(words), c), words)].astype(np.float64))[order]
            norms[c, used] = np.log(np.add.reduceat(weight, first[used]))
        return replace(self, norms=norms)

    def histories(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each position: known word or the unknown one, its class, rows of its features, context of the last known word."""
        known = len(self.classes)
        word = np.where((ids >= 0) & (ids < known), ids, known)
        of = np.append(self.classes, [UNKNOWN, START])
        n, place = len(ids), np.arange(len(ids))
        begin = np.repeat(starts[:-1], np.diff(starts))

        def back(x: np.ndarray, k: int, start: int) -> np.ndarray:
            out = np.full(n, start, np.int64)
            out[k:] = x[: n - k] if k < n else out[k:]
            out[place - k < begin] = start
            return out

        classes = of[word]
        w1, w2, w3 = (back(word, k, known + 1) for k in (1, 2, 3))
        last = np.maximum.accumulate(np.where(word < known, place, -1)) if n else place
        last = back(last, 1, -1)
        last_word = np.where(last >= begin, word[np.maximum(last, 0)], known + 1)
        c = [back(classes, k, START) for k in (1, 2, 3, 4)]
        mixes = (w1, w1 * 81_919 + w2, w2 * 81_919 + w3, last_word, ((c[0] * 64 + c[1]) * 64 + c[2]) * 64 + c[3])
        shift = np.uint64(64 - (len(self.table).bit_length() - 1))
        rows = np.stack([((m.astype(np.uint64) * np.uint64(8) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> shift for k, m in enumerate(mixes)])
        return word, classes, rows.astype(np.int32), np.where(last_word > known, CONTEXTS, last_word % CONTEXTS)

    def logits(self, rows: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The sum of the features' rows, a row for each position; held are two buffers, of which the first has it then.
        Buffers that are kept cost a twentieth of new ones."""
        z, more = held[:, : rows.shape[1]]
        np.take(self.table, rows[0], axis=0, out=z, mode="clip")
        for r in rows[1:]:
            np.take(self.table, r, axis=0, out=more, mode="clip")
            z += more
        z += self.prior
        return z

    def train(self, ids: np.ndarray, starts: np.ndarray, square: np.ndarray, seen: np.ndarray, counted: np.ndarray) -> None:
        """Minibatch updates of the classes' table, with a step for each row that shrinks by the root of its summed
        squared gradients; and adds to ``counted`` how often each slot's pairs occur and how often the model expects them."""
        word, classes, rows, context = self.histories(ids, starts)
        known = len(self.classes)
        held, grads = np.empty((2, min(len(ids), MINIBATCH), OUTPUTS), np.float32), np.empty((min(len(ids), MINIBATCH), OUTPUTS), np.float32)
        narrow = np.uint16 if len(self.table) <= 1 << 16 else np.int32  # sorts in a sixth of the time
        for lo in range(0, len(ids), MINIBATCH):
            s = slice(lo, lo + MINIBATCH)
            z = self.logits(rows[:, s], held)
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(z)), classes[s]] -= 1
            for r in rows[:, s]:
                order = np.argsort(r.astype(narrow), kind="stable")
                ranked = r[order]
                first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                sizes = np.diff(np.append(first, len(ranked)))
                many = sizes > 1  # rows met once, which are most, are copied; the others' gradients are summed
                once, g = first[~many], grads[: len(first)]
                np.take(z, order[once], axis=0, out=g[: len(once)], mode="clip")
                rest = np.take(z, order[np.repeat(many, sizes)], axis=0, out=held[1, : len(ranked) - len(once)], mode="clip")
                if len(rest):
                    np.add.reduceat(rest, np.append(0, np.cumsum(sizes[many])[:-1]), axis=0, out=g[len(once) :])
                at, sizes = np.append(ranked[once], ranked[first[many]]), np.append(sizes[~many], sizes[many])
                square[at] += np.einsum("ij,ij->i", g, g) / OUTPUTS
                g *= (-RATE / np.sqrt(square[at] + HOLD))[:, None]
                g += np.take(self.table, at, axis=0, out=held[1, : len(g)], mode="clip")
                self.table[at] = g
                seen[at] += sizes
        use = word < known
        pair, n = np.unique(context[use] * known + word[use], return_counts=True)
        c, w = pair // known, pair % known
        slots, of = self.slots(c, w), self.classes[w]
        turns = np.bincount(context[use] * OUTPUTS + classes[use], minlength=(CONTEXTS + 1) * OUTPUTS)
        expected = turns[c * OUTPUTS + of] * np.exp(self.own[w] + self.pairs[slots] - self.norms[c, of])
        np.add.at(counted[0], slots, n)
        np.add.at(counted[1], slots, expected)

    def score(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position the log10 probability, without the share of an unknown word in its class; and which are known."""
        word, classes, rows, context = self.histories(ids, starts)
        known = len(self.classes)
        out = np.empty(len(ids))
        held = np.empty((2, min(len(ids), MINIBATCH), OUTPUTS), np.float32)
        for lo in range(0, len(ids), MINIBATCH):
            s = slice(lo, lo + MINIBATCH)
            z = self.logits(rows[:, s], held)
            z -= z.max(axis=1, keepdims=True)
            own = z[np.arange(len(z)), classes[s]]
            np.exp(z, out=z)
            out[s] = own - np.log(z.sum(axis=1))
        use = word < known
        c, w = context[use], word[use]
        out[use] += self.own[w] + self.pairs[self.slots(c, w)] - self.norms[c, classes[use]]
        return out / np.log(10), use


def train(texts: DataFrame, vocabulary: Vocabulary) -> Model:
    """ROUNDS passes, each over its share of the rows, all texts once in all. Every learner starts from the last round's
    model. Of the classes' table it updates a copy with its rows; a row of weights is averaged by how often each learner met
    it. Of the words' table the learners' gradients are summed, observed and expected counts of each slot, for one step."""
    spark, words = texts.sparkSession, vocabulary.words
    learners = int(min(LEARNERS, max(6, vocabulary.total // TOKENS_A_LEARNER)))
    classes = learn_classes(texts.coalesce(learners), vocabulary, learners)
    counts = vocabulary.counts[:words]
    mass = np.bincount(classes, counts, OUTPUTS)
    mass[UNKNOWN] = vocabulary.total - counts.sum()
    rows, slots = (1 << vocabulary.grown(1 << least, 1 << most, 3).bit_length() - 1 for least, most in (ROWS, SLOTS))
    prior = np.log((mass + 0.5) / (mass.sum() + 0.5 * OUTPUTS)).astype(np.float32)
    model = Model(classes, prior, np.zeros((rows, OUTPUTS), np.float32), np.log(counts + 0.5), np.zeros(slots, np.float32), np.zeros((0, 0))).normed()
    step, wide = 256, 1 << 16
    for turn in range(ROUNDS):
        given = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            own = replace(given.value, table=given.value.table.copy())
            square, seen, counted = np.zeros(rows, np.float32), np.zeros(rows, np.float32), np.zeros((2, slots), np.float32)
            for batch in batches:
                own.train(*_tokens(batch.column(0)), square, seen, counted)
            made = []
            for k in range(0, rows, step):
                w = seen[k : k + step, None]
                if w.any():
                    made.append((k // step, np.concatenate([own.table[k : k + step] * w, w], axis=1)))
            for k in range(0, slots, wide):
                if counted[0, k : k + wide].any():
                    made.append((rows // step + k // wide, counted[:, k : k + wide]))
            if made:
                yield _blocks(made)

        part = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(ROUNDS)) == turn).select("ids")
        found = _summed(part.coalesce(learners).mapInArrow(run, _BLOCK), learners)
        given.unpersist()
        table, pairs = model.table.copy(), model.pairs.copy()
        for b, data in found.items():
            if b < rows // step:
                x = data.reshape(step, OUTPUTS + 1)
                met = x[:, -1] > 0
                table[b * step : (b + 1) * step][met] = x[met, :-1] / x[met, -1:]
            else:
                n, expected = data.reshape(2, -1)
                k = (b - rows // step) * wide
                pairs[k : k + len(n)] += np.log((n + DAMP) / (expected + DAMP))
        model = replace(model, table=table, pairs=pairs).normed()
    return model


def score_texts(df: DataFrame, held_out=None) -> DataFrame:
    """Adds held_out, n_tokens, n_known, train_tokens, base_score and score to doc_id, for every row of df.

    The model and the counts learn from all rows where ``held_out`` (by default: fold 1 of 5 by crc32 of the id) is
    false. base_score sums the smoothed unigram's log10 probabilities over the text's tokens, END last; score sums
    the model's. A null or empty text is END alone. Long texts are scored whole; repeated rows each get their row;
    a null id counts as the empty text for the fold. If no row is left to learn from, every token is unseen and both
    scores follow from the formula. An empty table stays empty. Columns but doc_id and text take no part.
    """
    spark = df.sparkSession
    ready(spark)
    held_out = fold() == 1 if held_out is None else held_out
    df = df.select("doc_id", "text", held_out.alias("held_out"))
    counts = token_counts(df.where("NOT held_out")).checkpoint()
    vocabulary = learn_vocabulary(counts)
    read = encoded(df, F.col("held_out"), spark.sparkContext.broadcast(vocabulary)).checkpoint()
    model = train(read.where("NOT held_out").select("doc_id", "ids"), vocabulary) if vocabulary.total else None
    given = spark.sparkContext.broadcast((model, vocabulary.base(vocabulary.counts) if model else None))
    total, distinct = vocabulary.total, vocabulary.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, base = given.value
        rest = np.log10(max(1 - (10.0 ** base[: len(model.classes)]).sum(), 1e-300)) if model else 0.0
        for batch in batches:
            if not model:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(len(batch)))], ["row", "score"])
                continue
            ids, starts = _tokens(batch.column(1))
            score, use = model.score(ids, starts)
            score[~use] += np.append(base, 0.0)[ids[~use]] - rest
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.add.reduceat(score, starts[:-1]) if len(ids) else [], pa.float64())], ["row", "score"])

    # tokens not listed are rare, each with less than a LISTED-th of all: their counts come by a join without hot keys
    rare = read.select("row", F.explode("cold").alias("token", "count"))
    c = F.coalesce(F.col("n"), F.lit(0))
    log = F.log10((c + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    added = rare.join(counts, "token", "left").groupBy("row").agg(F.sum(log * F.col("count")).alias("more"), F.sum(F.when(c > 0, F.col("count")).otherwise(0)).alias("more_known"))
    scored = read.select("row", "ids").mapInArrow(run, "row long, score double")
    out = read.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score").join(scored, "row").join(added, "row", "left").fillna(0, ["more", "more_known"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("more")).alias("base_score"), (F.col("score") + F.col("more")).alias("score"),
    )
