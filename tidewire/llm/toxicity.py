"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The lexicon is learned: words, and starts of words, that toxic texts hold more often than chance among all the words counted
allows. Counts run in the tasks; trees and calibration are those of Spark's own library.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, fresh, ready, replace_columns

#: Words for the person addressed, in the corpus's languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner deines euch euer eure tu te ti toi ton ta tes "
    "vous votre vos tú tus tuyo tuya usted ustedes vosotros vuestro vuestra".split()
)
#: Signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FOLDS = 5
STARTS = (3, 4, 5, 6)  # code points of the starts of words that are counted
BANDS = (0.0, -3.0, -6.0)  # least evidence of a lexicon's bands, in nats above what chance gives to one of all counted keys
NEAR = 5  # words
SLICE = 1 << 18  # characters of a text that are held as arrays at once
FLUSH = 1 << 22  # keys that a task holds before it sums them up

_WORD = regex.compile(r"[^\W\d_]+")
_STRETCHED = regex.compile(r"(\p{L})\1{2,}")
_BLANK, _BEFORE_WORD = regex.compile(r"\s"), regex.compile(r"\s(?=\w\w)")
_SIGNS = str.maketrans(SIGNS)

FEATURES = [
    "words", *(f"{kind}_{i}" for i in range(len(BANDS)) for kind in ("count", "density")), "strongest", "evidence", "odds", "all_odds", "second_person", "nearest", "near",
    "capitals", "shouted", "exclamation", "question", "punctuation", "repeated", "digits", "disguised", "stretched", "spaced",
]


def slices(text: str) -> Iterator[str]:
    """A text in pieces that end at white space, and where possible not between letters that stand alone."""
    at = 0
    while at < len(text):
        blank = _BEFORE_WORD.search(text, at + SLICE, at + 2 * SLICE) or _BLANK.search(text, at + SLICE)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


@cache
def _kinds() -> dict[str, np.ndarray]:
    """What each code point below 0x30000 is; those above are no letters."""
    chars = [chr(i) for i in range(0x30000)]
    lower = np.fromiter((ord(low) if len(low := c.lower()) == 1 else i for i, c in enumerate(chars)), np.uint64, len(chars))

    def table(test) -> np.ndarray:
        return np.fromiter(map(test, chars), bool, len(chars))

    alpha, space = table(str.isalpha), table(str.isspace)
    return {
        "lower": lower, "alpha": alpha, "space": space, "upper": table(str.isupper) & alpha, "digit": table(str.isdigit), "sign": table(SIGNS.__contains__),
        "mark": table("!?*".__contains__), "punctuation": ~(table(str.isalnum) | space),
    }


_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xA0761D6478BD642F)


class Words:
    """The words (runs of letters) of a piece of text as arrays, with their 64-bit keys.

    ``keys`` has a row for each word: of the whole, and of its start of each length in STARTS (0 where it is shorter). At the
    end come the words that letters in disguise (1d1ot, i.d.i.o.t, i d i o t) or stretched ones (idiooot) stand for; ``place``
    says where each word stands.
    """

    def __init__(self, text: str, hidden: bool = True):
        kinds = _kinds()
        code = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0x2FFFF)
        self.code, self.alpha = code, kinds["alpha"][code]
        edge = np.flatnonzero(np.diff(self.alpha, prepend=False, append=False))
        self.starts, ends = edge[::2], edge[1::2]
        self.lengths = ends - self.starts
        letters = kinds["lower"][code[self.alpha]]
        self.offsets = np.cumsum(self.lengths) - self.lengths
        at = np.arange(len(letters)) - np.repeat(self.offsets, self.lengths)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * _POWERS[at & 63], dtype=np.uint64)])
        base = sums[self.offsets]
        self.keys = np.zeros((len(base), 1 + len(STARTS)), np.uint64)
        self.keys[:, 0] = _mixed(sums[self.offsets + self.lengths] - base, 1)
        for i, k in enumerate(STARTS):
            long = self.lengths >= k
            self.keys[long, i + 1] = _mixed(sums[self.offsets[long] + k] - base[long], 2)
        self.place = np.arange(len(base))
        self.disguised, self.stretched, self.spaced = [], [], []  # where in the piece
        if hidden:
            self._hidden(text, kinds)

    def _hidden(self, text: str, kinds: dict[str, np.ndarray]) -> None:
        code, alpha = self.code, self.alpha
        extra: dict[tuple[int, str], None] = {}
        before, after = np.roll(alpha, 1), np.roll(alpha, -1)
        before[:1] = after[-1:] = False
        sign, blank = kinds["sign"][code], kinds["space"][code]
        follows = np.roll(sign, -1) | after
        found = ~alpha & ~blank & ((before & follows) | (sign & after) | (sign & before & (code != 33)))
        found[-1:] &= sign[-1:] & (code[-1:] != 33)
        if found.any():
            gaps = np.concatenate([[-1], np.flatnonzero(blank), [len(code)]])
            for t in np.unique(np.searchsorted(gaps, np.flatnonzero(found))):
                at, token = gaps[t - 1] + 1, text[gaps[t - 1] + 1 : gaps[t]].lower()
                word = "".join(_WORD.findall(token.strip("!").translate(_SIGNS)))
                if 3 <= len(word) <= 40:
                    extra[int(at), word] = None
            self.disguised = [at for at, _ in extra]
        same = alpha[2:] & (code[2:] == code[1:-1]) & (code[1:-1] == code[:-2])
        for w in np.unique(np.searchsorted(self.starts, np.flatnonzero(same), side="right") - 1) if same.any() else ():
            at = self.starts[w]
            self.stretched.append(int(at))
            extra[int(at), _STRETCHED.sub(r"\1", text[at : at + self.lengths[w]].lower())] = None
        alone = (self.lengths == 1) & (np.diff(self.starts, append=-9) == 2)  # a letter, one sign or blank, and the next word
        run = np.flatnonzero(np.diff(alone, prepend=False, append=False))
        for lo, hi in zip(run[::2], run[1::2]):
            hi += int(hi < len(alone) and self.lengths[hi] == 1)
            if hi - lo > 2:
                self.spaced.append(int(self.starts[lo]))
                extra[int(self.starts[lo]), "".join(text[self.starts[i]] for i in range(lo, hi)).lower()] = None
        if extra:
            more = Words("\n".join(w for _, w in extra), hidden=False)
            at = [p for p, w in extra for _ in _WORD.findall(w)]
            self.keys = np.concatenate([self.keys, more.keys])
            self.place = np.concatenate([self.place, np.searchsorted(self.starts, at)])


def text_keys(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a text, and of each a mask of 64 bits: one for each neighbourhood (word before and after) by hash."""
    keys, masks = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for piece in slices(text):
        w = Words(piece)
        h = np.zeros(len(w.starts) + 2, np.uint64)
        h[1:-1] = w.keys[: len(w.starts), 0]
        bit = np.uint64(1) << (_mixed(h[:-2] * np.uint64(3) + h[2:], 3) >> np.uint64(58))
        if not len(bit):
            continue
        some, mask = w.keys.ravel(), np.repeat(bit[w.place], w.keys.shape[1])
        use = some != 0
        some, mask, _ = _united(some[use].view(np.int64), mask[use])
        keys.append(some)
        masks.append(mask)
    return (keys[1], masks[1]) if len(keys) == 2 else _united(np.concatenate(keys), np.concatenate(masks))[:2]


def _united(keys: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their masks joined, and how often each came."""
    if not len(keys):
        return keys, masks, np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.bitwise_or.reduceat(masks[order], first), np.diff(np.concatenate([first, [len(keys)]]))


class Measure:
    """The features of texts, given the lexicon: a key's evidence and log odds."""

    def __init__(self, lexicon: dict[int, tuple[float, float]]):
        self.keys = np.array(sorted(lexicon), np.int64)
        self.worth = np.array([lexicon[k] for k in self.keys.tolist()]).reshape(-1, 2)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.keys.view(np.uint64) >> np.uint64(44)] = True
        self.people = np.sort(Words(" ".join(sorted(SECOND_PERSON))).keys[:, 0])

    def _evidence(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words that the lexicon knows, by place, the best evidence of each, and the best log odds of its likely keys."""
        row, column = np.nonzero(self.sieve[w.keys >> np.uint64(44)])
        key = w.keys[row, column].view(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        best, odds = np.full(len(w.starts), -np.inf), np.zeros(len(w.starts))
        place, (worth, value) = w.place[row[hit]], self.worth[at[hit]].T
        np.maximum.at(best, place, worth)
        np.maximum.at(odds, place, np.where(worth >= BANDS[1], value, 0))
        known = np.flatnonzero(best > -np.inf)
        return known, best[known], odds[known]

    def _pieces(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Texts, or the slices of long ones, in joined pieces; with each, the numbers of its texts and where these end.

        Two line feeds keep the texts apart: what a text measures doesn't depend on the others.
        """
        held, of, size = [], [], 0
        for i, text in enumerate(texts):
            for part in slices(text):
                held.append(part)
                of.append(i)
                size += len(part) + 2
                if size >= SLICE // 4:
                    yield "\n\n".join(held), np.array(of), np.cumsum([len(p) + 2 for p in held])
                    held, of, size = [], [], 0
        if held:
            yield "\n\n".join(held), np.array(of), np.cumsum([len(p) + 2 for p in held])

    def features(self, texts: list[str]) -> list[list[float]]:
        """The FEATURES of each text."""
        kinds, total, n = _kinds(), np.zeros((len(texts), 11)), np.zeros(len(texts), np.int64)
        people, bands = np.zeros(len(texts)), np.zeros((len(texts), len(BANDS)))
        strongest, summed, odds, all_odds = np.full(len(texts), -10.0), *np.zeros((3, len(texts)))
        likely, persons = [], []
        for piece, of, ends in self._pieces(texts):
            w = Words(piece)

            def each(at, weight=None):
                return np.bincount(np.searchsorted(ends, at, side="right"), weight, len(of))  # noqa: B023

            upper, mark = kinds["upper"][w.code], kinds["mark"][w.code]
            capitals = np.diff(np.concatenate([[0], np.cumsum(upper[w.alpha])])[np.append(w.offsets, w.alpha.sum())])
            shouted = w.starts[(capitals == w.lengths) & (w.lengths > 2)]
            signs = [upper, w.alpha, None, w.code == 33, w.code == 63, kinds["punctuation"][w.code], np.append(mark[1:] & mark[:-1], False), kinds["digit"][w.code]]
            found = [shouted if x is None else np.flatnonzero(x) for x in signs] + [w.disguised, w.stretched, w.spaced]
            np.add.at(total, of, np.stack([each(np.asarray(x, np.int64)) for x in found], axis=1))
            if not len(w.starts):
                continue
            text = np.searchsorted(ends, w.starts, side="right")
            own = np.bincount(text, minlength=len(of))
            where = np.arange(len(w.starts)) - (np.cumsum(own) - own)[text] + n[of[text]]
            at = np.minimum(np.searchsorted(self.people, w.keys[: len(w.starts), 0]), len(self.people) - 1)
            person = np.flatnonzero(self.people[at] == w.keys[: len(w.starts), 0])
            np.add.at(people, of[text[person]], 1)
            persons.append(np.stack([of[text[person]], where[person]]))
            if len(self.keys):
                known, worth, value = self._evidence(w)
                i = of[text[known]]
                for b, least in enumerate(BANDS):
                    np.add.at(bands[:, b], i[worth >= least], 1)
                np.maximum.at(strongest, i, worth)
                np.add.at(summed, i, np.maximum(worth - BANDS[-1], 0))
                np.maximum.at(odds, i, value)
                np.add.at(all_odds, i, value)
                known, i = known[worth >= BANDS[1]], i[worth >= BANDS[1]]
                likely.append(np.stack([i, where[known]]))
            np.add.at(n, of, own)
        nearest, near = np.zeros(len(texts)), np.zeros(len(texts))
        if likely and persons:
            self._proximity(np.concatenate(likely, axis=1), np.concatenate(persons, axis=1), nearest, near)
        words, letters, chars = np.maximum(n, 1), np.maximum(total[:, 1], 1), np.maximum(np.array([len(t) for t in texts]), 1)
        out = [np.log1p(n)]
        for b in range(len(BANDS)):
            out += [np.log1p(bands[:, b]), 100 * bands[:, b] / words]
        out += [strongest, np.log1p(summed), odds, np.log1p(all_odds), 100 * people / words, nearest, 100 * near / words, total[:, 0] / letters, 100 * total[:, 2] / words]
        out += [100 * total[:, j] / chars for j in range(3, 8)] + [100 * total[:, j] / words for j in range(8, 11)]
        return np.stack(out, axis=1).tolist()

    @staticmethod
    def _proximity(likely: np.ndarray, persons: np.ndarray, nearest: np.ndarray, near: np.ndarray) -> None:
        """For each text, the closeness of a likely word to a person's, and how many are within NEAR words of one."""
        far = 1 << 40  # words of different texts are never near
        at, by = np.sort(likely[0] * far + likely[1]), np.sort(persons[0] * far + persons[1])
        if not len(by) or not len(at):
            return
        right = np.searchsorted(by, at)
        distance = np.minimum(np.abs(by[np.minimum(right, len(by) - 1)] - at), np.abs(at - by[np.maximum(right - 1, 0)]))
        text = at // far
        same = distance < far // 2
        np.maximum.at(nearest, text[same], 1 / (1 + distance[same]))
        np.add.at(near, text[distance <= NEAR], 1)


@dataclass
class Toxicity:
    """A learned model: without trees, every text has the score ``share``."""

    share: float = 0.0
    lexicon: dict[int, tuple[float, float]] = field(default_factory=dict)
    trees: object = None
    calibration: object = None


def labelled(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """doc_id, text, toxic and part of about ``most_rows`` labelled rows at most, chosen by the hash of the id; equal texts once.

    A doc_id is toxic if at least half of its labels say so, and a text if at least half of its rows are. Only ids, labels and
    the chosen texts' hashes leave the tasks that read them.
    """
    votes = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("vote"))
    share = min(1.0, most_rows / max(1, votes.count()))
    votes = votes.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < round(share * (1 << 20)))
    votes = F.broadcast(votes.withColumn("vote", (F.col("vote") >= 0.5).cast("double")))  # some 1.1 * most_rows small rows at most
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    once = texts.join(votes, "doc_id").groupBy("hash").agg(F.min("doc_id").alias("doc_id"), (F.avg("vote") >= 0.5).alias("toxic")).checkpoint()
    return texts.join(F.broadcast(once), ["hash", "doc_id"]).select("doc_id", "text", "toxic", F.pmod("hash", F.lit(FOLDS)).cast("int").alias("part"))


def _counted(rows: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """key, part, texts and mask: how many of the rows' texts hold each key, or each of the sorted ``wanted``, and in what
    neighbourhoods; summed in each task first."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, some in held.items():
                key, mask, n = _united(np.concatenate([k for k, _ in some]), np.concatenate([m for _, m in some]))
                yield pa.RecordBatch.from_pydict({"key": key, "part": np.full(len(key), part, np.int32), "texts": n, "mask": mask.view(np.int64)})
            held.clear()

        for batch in batches:
            for text, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, masks = text_keys(text)
                if wanted is not None:
                    use = np.isin(keys, wanted, assume_unique=True)
                    keys, masks = keys[use], masks[use]
                held.setdefault(part, []).append((keys, masks))
                size += len(keys)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    counted = rows.select("text", "part").mapInArrow(run, "key long, part int, texts long, mask long")
    return counted.groupBy("key", "part").agg(F.sum("texts").alias("texts"), F.bit_or("mask").alias("mask"))


def _by_part(column: str, merge=F.sum):
    return [F.coalesce(merge(F.when(F.col("part") == p, F.col(column))), F.lit(0).cast("long")).alias(f"{column}{p}") for p in range(FOLDS)]


def _arrays(table, column: str) -> np.ndarray:
    return table[[f"{column}{p}" for p in range(FOLDS)]].to_numpy(np.int64).T


def neighbourhoods(masks: np.ndarray) -> np.ndarray:
    """How many different neighbourhoods set the bits of these masks, estimated by the bits still unset."""
    unset = 64 - np.bitwise_count(np.bitwise_or.reduce(masks, axis=0).view(np.uint64)).astype(np.int64)
    return 64 * np.log(64 / np.maximum(unset, 0.5))


def evidence(toxic: np.ndarray, clean: np.ndarray, base: float, keys: int) -> np.ndarray:
    """How far, in nats, a key's share of toxic texts is above the base rate, less what the best of all ``keys`` has by chance."""
    n = np.maximum(toxic + clean, 1)
    p, q = np.clip(toxic / n, 1e-12, 1), np.clip(clean / n, 1e-12, 1)
    gain = toxic * np.log(p / base) + clean * np.log(q / (1 - base))
    return np.where(toxic / n > base, gain, 0) - np.log(max(keys, 2))


def lexicons(rows: DataFrame, entries: int) -> list[dict[int, tuple[float, float]]]:
    """A lexicon without each part's texts, and at last one of all; at most ``entries`` keys, those in the most toxic texts.

    Keys are counted over all toxic rows first; only those that could count as evidence, were no clean text to hold them, are then
    counted over the clean ones. A passage that many toxic texts share says little of its words: a key counts once for each
    neighbourhood at most.
    """
    sizes = {(r["toxic"], r["part"]): r["n"] for r in rows.groupBy("toxic", "part").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = ([sizes.get((kind, p), 0) for p in range(FOLDS)] for kind in (True, False))
    if not sum(n_toxic) or not sum(n_clean):
        return [{}] * (FOLDS + 1)
    parted = _counted(rows.where("toxic"), None)
    toxic = parted.groupBy("key").agg(F.sum("texts").alias("all"), *_by_part("texts"), *_by_part("mask", F.max)).where("all > 1").checkpoint()
    keys = toxic.count()
    base = sum(n_toxic) / (sum(n_toxic) + sum(n_clean))
    least = (np.log(max(keys, 2)) + BANDS[-1]) / np.log(1 / base)
    top = toxic.where(F.col("all") >= float(least)).orderBy(F.desc("all"), "key").limit(entries).toPandas().sort_values("key")
    wanted = top["key"].to_numpy(np.int64)
    t, masks = _arrays(top, "texts"), _arrays(top, "mask")
    clean = _counted(rows.where("not toxic"), wanted).groupBy("key").agg(*_by_part("texts")).toPandas()
    c = np.zeros((FOLDS, len(wanted)), np.int64)
    if len(clean):
        c[:, np.searchsorted(wanted, clean["key"].to_numpy(np.int64))] = _arrays(clean, "texts")
    out = []
    for left in range(FOLDS + 1):
        use = [p for p in range(FOLDS) if p != left]
        share = max(sum(n_toxic[p] for p in use), 1) / max(sum(n_toxic[p] + n_clean[p] for p in use), 2)
        held = np.minimum(t[use].sum(axis=0), neighbourhoods(masks[use]))
        others = c[use].sum(axis=0)
        worth = evidence(held, others, share, keys)
        odds = np.log((held + 0.5) / (others + 0.5)) - np.log(share / (1 - share))
        out.append({int(k): (float(w), float(v)) for k, w, v in zip(wanted, worth, odds) if w >= BANDS[-1]})
    return out


def with_features(df: DataFrame, lexicons: list[dict[int, tuple[float, float]]], name: str, part: str | None = None) -> DataFrame:
    """Adds the array of features of each text, by the lexicon of its part, or by the last."""
    shared = df.sparkSession.sparkContext.broadcast(lexicons)

    def start():
        measures: dict[int, Measure] = {}

        def work(texts: pa.Array, parts: pa.Array | None = None) -> list:
            given = [t or "" for t in texts.to_pylist()]
            of = np.array(parts.to_pylist() if parts is not None else [len(shared.value) - 1] * len(given))
            made: list = [None] * len(given)
            for p in np.unique(of).tolist():
                if p not in measures:
                    measures[p] = Measure(shared.value[p])
                at = np.flatnonzero(of == p).tolist()
                for i, row in zip(at, measures[p].features([given[i] for i in at])):
                    made[i] = row
            return [made]

        return work

    return replace_columns(df, ["text"] + ([part] if part else []), f"{name} array<double>", start)


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 50_000, entries: int = 50_000, trees: int = 20, depth: int = 3) -> Toxicity:
    """Lexicon, trees and calibration from at most about ``most_rows`` labelled rows of docs.

    A training row's features come from the lexicon of the other parts, so that its own label isn't among them. Trees learn
    from parts 1 to 4, calibration from part 0. Where there are no labels the model says 0, where all are equal that label.
    """
    ready(docs.sparkSession)
    rows = labelled(docs, labels, most_rows)
    learned = lexicons(rows, entries)
    made = with_features(rows, learned, "features", "part").select("toxic", "part", array_to_vector("features").alias("features")).repartition(4).checkpoint()
    made = made.withColumn("label", F.col("toxic").cast("double"))
    first = made.agg(*[F.count_distinct(F.when(F.col("part") != 0, F.col("label"))).alias("kinds"), F.count_distinct(F.when(F.col("part") == 0, F.col("label"))).alias("held"), F.avg("label").alias("share")]).first()
    if first["kinds"] < 2:
        return Toxicity(first["share"] or 0.0, learned[-1])
    booster = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=3, maxBins=64, seed=7)
    model = booster.fit(made.where("part <> 0"))
    margin = model.transform(made.where("part = 0") if first["held"] == 2 else made).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    return Toxicity(first["share"], learned[-1], model, IsotonicRegression(featuresCol="margin", labelCol="label").fit(margin))


def score_toxicity(df: DataFrame, model: Toxicity) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score is 0.5 or more) to every row, from its whole text alone.

    A null text counts as empty and has a score too. Equal texts have equal scores; an empty table stays empty; columns named
    as an output are replaced, others stay.
    """
    ready(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c.lower() in ("score", "predicted")])
    if model.trees is None:
        out = df.withColumn("score", F.lit(float(model.share)))
    else:
        features, vector, raw, chance, guess, margin, level = (fresh(df, c) for c in ("tox_features", "tox_vector", "tox_raw", "tox_chance", "tox_guess", "tox_margin", "tox_level"))
        made = with_features(df, [model.lexicon], features).withColumn(vector, array_to_vector(features))
        trees = model.trees.setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(chance).setPredictionCol(guess)
        made = trees.transform(made).withColumn(margin, vector_to_array(raw)[1])
        made = model.calibration.setFeaturesCol(margin).setPredictionCol(level).transform(made)
        out = made.withColumn("score", F.least(F.greatest(F.col(level), F.lit(0.0)), F.lit(1.0))).select(*df.columns, "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def detect_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Learn from the labelled rows outside fold 0 and score all rows; adds held_out, score and predicted."""
    held = fold() == 0
    model = learn(docs.where(~held), labels, **options)
    return score_toxicity(docs.drop(*[c for c in docs.columns if c.lower() == "held_out"]), model).withColumn("held_out", held)
