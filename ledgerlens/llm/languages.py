"""Operator 13: language ID by multilingual mixture inference.

Features are n-grams of 1 to ORDER letters of words (lower case, one space at either end), hashed into 2^BITS bins. Spark
counts them over all learning documents of each language; tasks send sums of theirs. A document's likelihood under
proportions p of the languages is the product over its n-grams of sum(p[l] * P(n-gram | l)); the n-grams of a text
overlap, so each counts 1 / ORDER. Expectation-maximisation finds the proportions. A set of languages costs PENALTY
* log(n) for each language beyond the first (n: the text's letters), and the set of the best penalised likelihood is
selected: languages join one by one, the most probable of the mixture of all first. Where even the mixture of all
languages doesn't gain a penalty on the best single one, no larger set can, and that one is selected at once.

Defined results: lang_pred is the selected language of the largest proportion (ties: the first by name), score its
proportion times the posterior of that language among single ones where one is selected; ``languages`` and ``shares``
hold the selected set, largest first. A text that is null or has no letter gets und, score 0 and empty lists, as does every
text where nothing was learned. A language without n-grams is learned with the smoothed frequencies alone. Repeated rows
count each, in learning too; a null doc_id counts as the empty text in the fold. Empty tables give empty tables; further
columns, whatever their names, are ignored. Texts are handled about a megabyte at a time, a longer one alone, with some
100 bytes of arrays a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, only, table, written

#: Letters of the longest n-grams; bins of each order are told apart by the hash.
ORDER, BITS = 4, 16
#: What each language beyond the first must gain, times log(n); added to each bin's count, in parts of a uniform one.
PENALTY, SMOOTH = 6.0, 0.5
#: Rounds of expectation-maximisation at most, and the change of proportions that ends them.
ROUNDS, SETTLED = 60, 1e-4
#: Proportions of all languages together, beside the best one, at which the gain of mixtures is bounded.
SCREENS = (0.03, 0.2)
#: Languages that a model holds at most: 2^BITS numbers each are broadcast.
MOST_LANGUAGES = 1000
FOLDS, HELD = 4, 2
#: Odd multipliers of the n-grams' polynomial hash, and of its last step for each order.
_STEP, *_ENDS = np.random.Generator(np.random.PCG64(13)).integers(0, 2**63, ORDER + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row of each) of the texts' words: letters in lower case, a space before and after each word."""
    plain = pc.replace_substring_regex(pc.utf8_lower(column), r"[^\pL\pM]+", " ")
    n = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    # a space before each text, and one after it
    joined = " " + "  ".join(plain.to_pylist()) + " " if len(plain) else ""
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(n)), n + 2)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32) | (row[1:] != row[:-1])
    return points[keep], row[keep]


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bin, row) of every n-gram of 1 to ORDER characters that isn't a space alone and has a space at its ends only."""
    points, row = letters_of(column)
    space = points == 32
    points = points.astype(np.uint64)
    bins, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    code = np.zeros(len(points), np.uint64)
    bad = np.zeros(len(points), bool)
    for n in range(1, min(ORDER, len(points)) + 1):
        m = len(points) - n + 1
        code = code[:m] * _STEP + points[n - 1 :]
        bad = bad[:m]
        if n > 2:
            bad |= space[n - 2 : n - 2 + m]  # inside an n-gram
        # two spaces beside each other end one text and begin the next
        use = ~(bad | space[:m] & space[n - 1 :]) if n <= 2 else ~bad
        bins.append(((code[use] * _ENDS[n - 1]) >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(row[:m][use])
    return np.concatenate(bins), np.concatenate(rows)


class Model:
    """names: of the languages, in order; log: (languages, bins) logarithms of the frequencies."""

    def __init__(self, names: list[str], log: np.ndarray):
        self.names, self.log = names, log

    @classmethod
    def of_counts(cls, names: list[str], counts: np.ndarray) -> Model:
        smooth = counts + SMOOTH
        return cls(names, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32))


def fit_languages(docs: DataFrame) -> Model:
    """Frequencies of all documents' n-grams by language. docs: text, lang (not null).

    The driver gets a row for each language: its 2^BITS sums.
    """
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in chunks(batches):
            bins, row = grams(part.column("text"))
            lang = part.column("lang").dictionary_encode()
            code = lang.indices.to_numpy()
            names = lang.dictionary.to_pylist()
            found = np.bincount(code[row] * size + bins, minlength=len(names) * size).reshape(len(names), size)
            for name, held in zip(names, found, strict=True):
                sums[name] = sums.get(name, 0) + held
        for name, held in sums.items():
            at = np.flatnonzero(held)
            # a row for the language itself, should it have no n-gram
            columns = [pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(held[at], 0), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bin", "n"])

    counted = only(docs, "text", "lang").withColumn("lang", F.col("lang").cast("string")).mapInArrow(count, "lang string, bin int, n long")
    sums = written(counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    names = [r.lang for r in sums.where("bin = -1").select("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: raise MOST_LANGUAGES if that many models fit the executors")
    names.sort()
    counts = np.zeros((len(names), size))
    at = {name: i for i, name in enumerate(names)}
    for r in sums.where("bin >= 0").groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("found")).collect():  # 2^BITS at most for a language
        bins, n = np.array([(x.bin, x.n) for x in r.found]).T
        counts[at[r.lang], bins] = n
    return Model.of_counts(names, counts)


class Mixtures:
    """Expectation-maximisation for many documents at once, over their distinct n-grams."""

    def __init__(self, model: Model, bins: np.ndarray, row: np.ndarray, n_rows: int):
        key = row << BITS | bins
        if n_rows < 1 << 32 - BITS:
            key = key.astype(np.uint32)
        key, times = np.unique(key, return_counts=True)
        key = key.astype(np.int64)
        self.row, self.bin = key >> BITS, key & ((1 << BITS) - 1)
        self.weight = times / ORDER
        self.n_rows = n_rows
        self.log = model.log[:, self.bin].astype(np.float64)
        self.first = np.searchsorted(self.row, np.arange(n_rows))
        self.total = np.bincount(self.row, self.weight, minlength=n_rows)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums of the n-grams' values (..., n-grams) for each document; documents without any get zero."""
        so_far = np.concatenate([np.zeros((*values.shape[:-1], 1)), np.cumsum(values, axis=-1)], axis=-1)
        return so_far[..., np.append(self.first[1:], len(self.row))] - so_far[..., self.first]

    def single(self) -> np.ndarray:
        """(languages, documents): log likelihoods under each language alone."""
        return self.summed(self.log * self.weight)

    def bound(self, best: np.ndarray, single: np.ndarray) -> np.ndarray:
        """What no mixture's log likelihood exceeds, for each document.

        The likelihood is concave in the proportions, so it stays below its tangent at any of them: at some near the best
        language alone, which has ``single``. The lowest of those at SCREENS is taken.
        """
        out = np.full(self.n_rows, np.inf)
        likely = np.exp((self.log - self.log[best[self.row], np.arange(len(self.row))]).astype(np.float32))
        every = likely.sum(axis=0)
        for rest in SCREENS:
            mix = 1 - rest + rest / len(self.log) * every  # over the likelihood under the best language
            slope = self.summed(likely * (self.weight / mix)).max(axis=0, initial=0.0)
            out = np.minimum(out, single + self.summed(np.log(mix) * self.weight) + slope - self.total)
        return out

    def of(self, rows: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions (languages, rows), log likelihoods) for these documents, each within its allowed (languages, rows) ones."""
        pick = np.concatenate([np.arange(self.first[r], self.first[r + 1] if r + 1 < self.n_rows else len(self.row)) for r in rows]) if len(rows) else np.zeros(0, np.int64)
        place = np.searchsorted(rows, self.row[pick])
        weight, log = self.weight[pick], self.log[:, pick]
        top = log.max(axis=0)
        likely = np.exp(log - top)
        first = np.searchsorted(place, np.arange(len(rows)))
        total = self.total[rows]
        shares = allowed / allowed.sum(axis=0)
        for _ in range(ROUNDS):
            joint = likely * shares[:, place]
            new = np.add.reduceat(joint * (weight / joint.sum(axis=0)), first, axis=1) / total
            moved = np.abs(new - shares).max(initial=0.0)
            shares = new
            if moved < SETTLED:
                break
        with np.errstate(divide="ignore"):
            gained = np.log((likely * shares[:, place]).sum(axis=0)) + top
        return shares, np.add.reduceat(gained * weight, first)

    def selected(self) -> list[tuple[list[int], list[float], float]]:
        """For each document the selected languages, largest share first, their shares, and the score of the first."""
        n_lang = len(self.log)
        single = self.single()
        out: list[tuple[list[int], list[float], float]] = [([], [], 0.0)] * self.n_rows
        rows = np.flatnonzero(self.total > 0)
        if not len(rows) or not n_lang:
            return out
        best = single[:, rows].argmax(axis=0)
        posterior = np.exp(single[:, rows] - single[best, rows])
        posterior = 1 / posterior.sum(axis=0)
        for i, r in enumerate(rows.tolist()):
            out[r] = ([int(best[i])], [1.0], float(posterior[i]))
        cost = PENALTY * np.log(np.maximum(self.total[rows], 1.0) + 1)
        # no set gains more than the mixture of all languages
        open_ = self.bound(single.argmax(axis=0), single.max(axis=0))[rows] - single[best, rows] > cost
        rows, best, cost = rows[open_], best[open_], cost[open_]
        shares, likelihood = self.of(rows, np.ones((n_lang, len(rows))))
        open_ = likelihood - single[best, rows] > cost - 1.0  # 1: what the rounds may have left
        rows, best, cost, shares = rows[open_], best[open_], cost[open_], shares[:, open_]
        order = np.argsort(-shares, axis=0, kind="stable")
        penalised = single[best, rows]
        allowed = np.zeros((n_lang, len(rows)))
        for size in range(1, n_lang + 1):
            allowed[order[size - 1], np.arange(len(rows))] = 1.0
            if size == 1:
                continue
            if not len(rows):
                break
            found, likelihood = self.of(rows, allowed)
            better = likelihood - (size - 1) * cost > penalised
            for i in np.flatnonzero(better).tolist():
                by = np.argsort(-found[:, i], kind="stable")[:size].tolist()
                by = [x for x in by if found[x, i] > 0]
                out[int(rows[i])] = (by, found[by, i].tolist(), float(found[by[0], i]))
            penalised = np.where(better, likelihood - (size - 1) * cost, penalised)
            # a set of this size that gains nothing is not extended, but for the first two languages
            go_on = better | (size == 2)
            rows, cost, penalised, order, allowed = rows[go_on], cost[go_on], penalised[go_on], order[:, go_on], allowed[:, go_on]
        return out


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, languages, shares) of each row: of the texts alone."""
    of = docs.sparkSession.sparkContext.broadcast((model.names, model.log))  # MOST_LANGUAGES times 2^BITS numbers at most

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*of.value)
        for part in chunks(batches):
            text = part.column("text")
            has_letter = pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False)
            found = Mixtures(fitted, *grams(text), len(text)).selected()
            found = [x if ok else ([], [], 0.0) for x, ok in zip(found, has_letter.tolist(), strict=True)]
            names = [[fitted.names[i] for i in x] for x, _, _ in found]
            columns = [part.column("doc_id"), pa.array([x[0] if x else "und" for x in names], pa.string()), pa.array([min(max(s, 0.0), 1.0) for _, _, s in found], pa.float64())]
            columns += [pa.array(names, pa.list_(pa.string())), pa.array([s for _, s, _ in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "languages", "shares"])

    return only(docs, "doc_id", "text").withColumn("doc_id", F.expr("try_cast(doc_id AS long)")).mapInArrow(predict, "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, shares): learned from the rows with lang that aren't held out."""
    model = fit_languages(only(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out()))
    return predict_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "shares")


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
