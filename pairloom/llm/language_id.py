"""Language ID: averaged hashed subword embeddings under a linear softmax.

A text is the average of the vectors of its words' character n-grams, which are hashed
into a fixed number of buckets; a softmax over the average gives the language. Both are
trained by stochastic gradient descent in numpy. A temperature is set on labelled rows that
the descent didn't see, and a rejection threshold on the scores of all labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import bounded_batches, crc_of_id, sliced, stored

BUCKETS, SIZE, LONGEST = 1 << 14, 16, 4
#: A worker holds so many words' rows, and fewer where many languages make rows wide.
WORDS_HELD, WORDS_BYTES = 120_000, 32_000_000
#: The sample's bucket counts that the driver fetches.
SAMPLE_BYTES = 128_000_000
#: Steps of the scores' histogram that sets the rejection threshold.
STEPS = 1000


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of its word) of each n-gram of 1 to ``LONGEST`` characters of the words, their ends marked."""
    marked = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(marked))
    code = np.zeros(len(marked), np.uint64)
    buckets, owners = [], []
    for k in range(1, LONGEST + 1):
        fits = np.flatnonzero(left >= k)
        code[fits] = code[fits] * np.uint64(0x100000001B3) + marked[fits + k - 1] + np.uint64(1)
        mixed = (code[fits] ^ (code[fits] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((mixed >> np.uint64(40)) % np.uint64(BUCKETS))
        owners.append(owner[fits])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode's L); numerals such as ½, ² or Ⅷ are none."""
    return any(map(str.isalpha, text))


def text_buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur in the whole text, and how often."""
    words = Counter(text.lower().split())
    buckets, owner = subwords(list(words))
    counts = np.bincount(buckets, np.fromiter(words.values(), float, len(words))[owner], BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class LanguageModel:
    """Embeddings (BUCKETS, SIZE), weights (SIZE, languages), and what calibration found."""

    languages: list[str]
    embedding: np.ndarray
    weight: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    #: One worker's memory: word -> its row, which sums its n-grams' logits and, last, counts them.
    places: dict = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"places": {}, "rows": None}

    def most_words(self) -> int:
        return max(1, min(WORDS_HELD, WORDS_BYTES // (8 * len(self.languages) + 8)))

    def learn(self, words: list[str], table: np.ndarray) -> None:
        """Remembers the rows of words; when too many are held, only these stay."""
        if len(self.places) > self.most_words():
            self.places, self.rows = {}, None
        fresh = [w for w in words if w not in self.places]
        if not fresh:
            return
        columns = np.zeros((len(fresh), table.shape[1] + 1))
        for at in range(0, len(fresh), 20_000):
            some = fresh[at: at + 20_000]
            buckets, owner = subwords(some)
            for n in range(table.shape[1]):
                columns[at: at + len(some), n] = np.bincount(owner, table[buckets, n], len(some))
            columns[at: at + len(some), -1] = np.bincount(owner, minlength=len(some))
        first = len(self.places)
        self.places.update(zip(fresh, range(first, first + len(fresh))))
        self.rows = columns if self.rows is None else np.concatenate([self.rows, columns])

    def table(self) -> np.ndarray:
        return (self.embedding @ self.weight).astype(np.float64)

    def predict(self, texts: list[str | None], table: np.ndarray) -> tuple[list[str], list[float]]:
        """Language and score of each text: the average over its n-grams of their logits, which equals
        the logits of the average, under the calibrated softmax."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        most, sums, waiting, size = self.most_words(), {}, [], 0

        def add() -> None:
            held = len(self.places) > most
            self.learn(list({w for _, words in waiting for w in words if held or w not in self.places}), table)
            for n, words in waiting:
                own = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
                sums[n] = sums.get(n, 0) + self.rows[own].sum(0)
            waiting.clear()

        # A text of more words than are held is summed in runs of them.
        for n, text in enumerate(texts if self.languages else []):
            words = text.lower().split() if text and has_letter(text) else []
            for at in range(0, len(words), most):
                run = words[at: at + most]
                if size + len(run) > most:
                    add()
                    size = 0
                waiting.append((n, run))
                size += len(run)
        add()
        for n, total in sums.items():
            z = total[:-1] / total[-1] / self.temperature
            p = np.exp(z - z.max())
            names[n] = self.languages[int(p.argmax())]
            scores[n] = float(p.max() / p.sum())
        return names, scores


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 4.0, seed: int = 11) -> LanguageModel:
    """Fits the model to (language, buckets, counts) rows; every fifth row only calibrates."""
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, SIZE)), np.zeros((SIZE, 0)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5:]
    truth = np.array([languages.index(lang) for lang, _, _ in rows])
    share = [counts / counts.sum() for _, _, counts in rows]
    embedding = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE))
    weight = np.zeros((SIZE, len(languages)))
    balance = np.bincount(truth[fit], minlength=len(languages)).astype(float)
    balance = balance.sum() / np.maximum(balance, 1) / len(languages)
    steps, total = 0, epochs * len(fit)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            step = rate * (1 - steps / total)
            steps += 1
            at = rows[i][1]
            mean = share[i] @ embedding[at]
            z = mean @ weight
            p = np.exp(z - z.max())
            p /= p.sum()
            p[truth[i]] -= 1
            p *= min(balance[truth[i]], 5.0)
            back = weight @ p
            weight -= step * np.outer(mean, p)
            embedding[at] -= step * np.outer(share[i], back)
    model = LanguageModel(languages, embedding, weight)
    calibrate(model, [rows[i] for i in held], [share[i] for i in held], truth[held])
    return model


def calibrate(model: LanguageModel, rows: list, share: list, truth: np.ndarray) -> None:
    """Sets the temperature of least log loss."""
    if not rows or len(model.languages) < 2:
        return
    table = model.table()
    z = np.array([s @ table[r[1]] for r, s in zip(rows, share)])

    def scores(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.clip(scores(t)[np.arange(len(z)), truth], 1e-12, 1)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])


def rejection_threshold(model: LanguageModel, clean: DataFrame, kept: float = 0.999) -> float:
    """The score under which a prediction is rejected, from all rows of ``clean`` (lang, text).

    Of the labelled rows that the model gets right, the share ``kept`` has the threshold's score and
    a twentieth more at least, so rejection is for texts unlike all languages learnt.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = model.table(), np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            names, scores = model.predict(batch.column(1).to_pylist(), table)
            right = np.array(names, object) == np.array(batch.column(0).to_pylist(), object)
            counts += np.bincount((np.array(scores)[right] * STEPS).astype(int), minlength=STEPS + 1)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["step", "n"])

    # At most STEPS + 1 rows come to the driver.
    rows = clean.select("lang", "text").mapInArrow(of, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()
    total, below = sum(r["n"] for r in rows), 0
    for r in rows:
        below += r["n"]
        if below > (1 - kept) * total:
            return 0.95 * r["step"] / STEPS
    return 0.0


def within(sample: DataFrame, most_bytes: int) -> DataFrame:
    """The rows of the stored ``sample`` (lang, draw, buckets, counts), or the first by draw of each language, as many as ``most_bytes`` hold."""
    size = F.sum(F.length("buckets") + F.length("counts")).alias("size")
    if (sample.agg(size).first()["size"] or 0) <= most_bytes:
        return sample
    # A language has about as many rows as were asked for, which bounds the groups and the numbers that reach the driver.
    ranked = sample.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))
    ranks, total = 1, 0
    for row in ranked.groupBy("rank").agg(size).orderBy("rank").collect():
        total += row["size"]
        if total > most_bytes:
            break
        ranks = row["rank"]
    return ranked.where(F.col("rank") <= ranks).drop("rank")


def fit_language_model(docs: DataFrame, per_language: int = 800, most_languages: int = 2000, sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """The model of the labelled rows of ``docs``; its caller leaves out what may not be learnt from.

    About ``per_language`` rows of each language are fetched, as bucket counts (at most
    ``BUCKETS`` a row) and not as texts: those under a hash threshold that the language's
    exact count sets, so the sample depends on no order of rows; rows equal in id, text and
    language are one. If their counts take over ``sample_bytes``, every language has as many rows as
    fit, the same number for all that have so many, and one at least. The rejection threshold is
    set on all labelled rows. Null languages and texts without a letter teach nothing. Over
    ``most_languages`` distinct languages are an error: lang then isn't a language.
    """
    bounded_batches(docs.sparkSession)
    clean = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # One number for each language comes to the driver, where each has up to per_language rows anyway.
    sizes = [(r["lang"], r["n"]) for r in clean.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()]
    if not sizes:
        return train([])
    if len(sizes) > most_languages:
        raise ValueError(f"lang has over {most_languages} distinct values")
    share = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, per_language / n)])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("language sample")), 11)
    few = clean.where(draw / float(1 << 53) < share[F.col("lang")]).select("lang", "text", draw.alias("draw")).dropDuplicates(["lang", "draw"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"lang": [], "draw": [], "buckets": [], "counts": []}
            for lang, text, drawn in zip(*[c.to_pylist() for c in batch.columns]):
                if has_letter(text):
                    buckets, counts = text_buckets(text)
                    out["lang"].append(lang)
                    out["draw"].append(drawn)
                    out["buckets"].append(buckets.astype(np.uint16).tobytes())
                    out["counts"].append(counts.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["lang"], pa.string()), pa.array(out["draw"], pa.int64()), *[pa.array(out[c], pa.binary()) for c in ("buckets", "counts")]],
                names=list(out),
            )

    sample = stored(few.mapInArrow(of, "lang string, draw long, buckets binary, counts binary"), "language-sample")
    found = within(sample, sample_bytes).collect()
    rows = [(r["lang"], np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["counts"], np.uint32)) for r in found]
    model = train(sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes())))
    model.reject_below = rejection_threshold(model, clean)
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with columns lang_pred, lang_score and lang_rejected.

    Only the whole text is looked at. A text that is null or has no letter is ``und`` with
    score 0 and rejected, as any is when nothing was learnt; others get the likeliest
    language, and are rejected if its calibrated score is under the model's threshold. Rows
    and other columns pass unchanged, except columns of these three names, which are replaced.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]
    own = docs.select(*names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in sliced(batches):
            pred, score = model.predict(batch.column(names.index("text")).to_pylist(), table)
            rejected = [p == "und" or s < model.reject_below for p, s in zip(pred, score)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*names, "lang_pred", "lang_score", "lang_rejected"],
            )

    schema = T.StructType(own.schema.fields[:])
    schema.add("lang_pred", "string").add("lang_score", "double").add("lang_rejected", "boolean")
    return own.mapInArrow(of, schema)


def language_predictions(docs: DataFrame, per_language: int = 800) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learnt from two thirds of the ids, for every row.

    Rows whose crc32(doc_id as text) mod 3 is 1, or whose doc_id is null, are held out.
    """
    held_out = F.coalesce(crc_of_id() % 3 == 1, F.lit(True))
    model = fit_language_model(docs.where(~held_out), per_language)
    shown = identify(docs.select("doc_id", "text"), model)
    return shown.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"),
    )
