"""Operator 5: a convolutional text classifier for toxicity, trained in numpy.

A word is the mean of hashed embeddings: of itself and of its starts of four to eight letters. Filters of one,
two and three words slide over a text; each filter's maximum over the whole text goes into a logistic output. Since a
filter is linear in the words, a word's share in every filter is a row of a table, and scoring gathers and adds rows.

Training reads at most ``SAMPLE`` labelled rows of ``SAMPLE_BYTES`` in all, drawn by the hash of their id, the same on every
run. Embeddings start from the log-odds of their bucket among the training texts; forward passes and gradients of a step
use the same parameters, and the result is their mean over the second half of the steps. A fifth of the sample is left out of a first fitting; on it
a logistic calibration turns outputs into probabilities, so one cut means the same everywhere, and each language gets the
threshold between the scores of its clean and toxic texts. Languages without toxic rows there take the common one. The
parameters are then fitted once more, on the whole sample.

Scores read texts alone. Null and empty texts score as a text without words. Labels that are null are left out of
training, as are ids that repeat with both labels; of rows that repeat an id the first text by value counts. With fewer
than two classes all scores are the share of toxic labels. Repeated rows get equal scores, empty tables give empty ones.
Other columns are kept; the score's name gets underscores while a column has it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, give_back, own_names, sliced, text_of

SAMPLE, SAMPLE_BYTES = 4000, 128 << 20
BUCKETS, PARTS = 1 << 17, 5
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Texts of a step, passes over the sample, or as many more as give so many steps, and how far a step goes.
BATCH, EPOCHS, STEPS = 64, 3, 250
RATE, EMBEDDING_RATE = 0.02, 0.05
#: Words of a text scored at once.
AT_ONCE = 1 << 15
CUT = 0.3
MARKS = ".,;:!?\"'()[]{}*%&$#|-_<>/\\"


def buckets(word: str) -> list[int]:
    """The embeddings of which a word is the mean."""
    w = word.strip(MARKS).lower()
    parts = [f"={w}", f"4{w[:4]}", f"5{w[:5]}", f"6{w[:6]}", f"8{w[:8]}"]
    return [xxhash.xxh32_intdigest(x) % (BUCKETS - 1) + 1 for x in parts]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    embeddings: np.ndarray  # buckets x dimensions
    filters: list[np.ndarray]  # by width: width x dimensions x filters
    bias: np.ndarray  # all filters
    out: np.ndarray  # all filters, then the constant
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] | None = None
    known: np.ndarray | None = None  # by bucket, 1 or 0

    def words(self, hashed: np.ndarray) -> np.ndarray:
        """The mean of each word's embeddings, without those that training hardly met."""
        total, n = np.zeros((len(hashed), DIMENSIONS), np.float32), np.zeros(len(hashed), np.float32)
        for part in hashed.T:
            known = self.known[part]
            total += self.embeddings[part] * known[:, None]
            n += known
        return total / np.maximum(1, n)[:, None]

    def pooled(self, table: np.ndarray, ids: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The maximum of each filter over a text, and where it is. Id 0 is the blank beyond the text."""
        most = max(1, len(ids))
        best, place = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.int64)
        padded = np.concatenate([ids, np.zeros(max(WIDTHS) - 1 + (len(ids) == 0), ids.dtype)])
        for at in range(0, most, AT_ONCE):
            n = min(AT_ONCE, most - at)
            rows, column = table[:, padded[at : at + n + max(WIDTHS) - 1]], 0
            for f, width in enumerate(WIDTHS):
                value = rows[column : column + FILTERS, :n]
                for k in range(1, width):
                    value = value + rows[column + k * FILTERS : column + (k + 1) * FILTERS, k : k + n]
                column += width * FILTERS
                own = slice(f * FILTERS, (f + 1) * FILTERS)
                if places:
                    top = value.argmax(1)
                    high = value[range(FILTERS), top]
                    place[own] = np.where(high > best[own], at + top, place[own])
                else:
                    high = value.max(1)
                best[own] = np.maximum(best[own], high)
        return best, place if places else None

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out[:-1] + self.out[-1]

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.logits(pooled) + self.shift)


def pooled(model: Model, texts: pa.Array) -> np.ndarray:
    """The maxima of each filter over each text. Arrow splits the texts as ``str.split`` does and numbers their different words."""
    split = pc.utf8_split_whitespace(texts)
    flat = split.flatten()
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(there)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    coded = flat.filter(pa.array(there)).dictionary_encode()
    table = columns_of(model, np.fromiter((h for w in coded.dictionary.to_numpy(zero_copy_only=False) for h in buckets(w)), np.int32, PARTS * len(coded.dictionary)).reshape(-1, PARTS))
    ids = coded.indices.to_numpy().astype(np.int64) + 1
    out = [model.pooled(table, ids[x:y])[0] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.stack(out) if out else np.zeros((0, len(WIDTHS) * FILTERS), np.float32)


def fit(texts: list[str], toxic: np.ndarray, languages: list[str], seed: int = 7, epochs: int = EPOCHS, steps: int = STEPS) -> Model:
    """A model of some texts; with no passes and steps it is the start that training improves."""
    rng = np.random.default_rng(seed)
    total = len(WIDTHS) * FILTERS
    model = Model(np.zeros((BUCKETS, DIMENSIONS), np.float32), [np.zeros((w, DIMENSIONS, FILTERS), np.float32) for w in WIDTHS], np.zeros(total, np.float32), np.zeros(total + 1, np.float32), thresholds={}, known=np.zeros(BUCKETS, np.float32))
    rate = float(np.mean(toxic)) if len(toxic) else 0.0
    if len(set(toxic.tolist())) < 2:
        model.slope, model.shift = 0.0, float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
        return model
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in t.split()], np.int64) for t in texts]
    hashed = np.array([[0] * PARTS, *(buckets(w) for w in vocabulary)])
    order = rng.permutation(len(texts))
    held = order[: max(1, len(texts) // 5)]
    if len(set(toxic[held].tolist())) < 2:
        held = order
    used = np.setdiff1d(order, held) if len(held) < len(order) else order
    if len(set(toxic[used].tolist())) < 2:
        used = order
    descend(model, ids, toxic, hashed, used, rng, epochs, steps)
    logits = model.logits(np.stack([pooled_alone(model, hashed, ids[k]) for k in held]))
    calibrate(model, logits, toxic[held], [languages[k] for k in held])
    if len(used) < len(order):
        descend(model, ids, toxic, hashed, np.sort(order), rng, epochs, steps)
    return model


def descend(model: Model, ids: list[np.ndarray], toxic: np.ndarray, hashed: np.ndarray, used: np.ndarray, rng: np.random.Generator, epochs: int, steps: int) -> None:
    """Train the parameters, from their start, on the texts with the numbers ``used``."""
    start(model, [hashed[np.unique(ids[k])] for k in used], toxic[used], rng)
    parameters = (model.embeddings, *model.filters, model.bias, model.out)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in parameters[1:]]
    drawn = [rng.permutation(used) for _ in range(max(epochs, -(-steps * BATCH // len(used))))]
    batches = [p[at : at + BATCH] for p in drawn for at in range(0, len(used), BATCH)]
    sums, late = [np.zeros_like(x) for x in parameters], len(batches) // 2
    for n, part in enumerate(batches):
        step(model, [ids[k] for k in part], toxic[part], hashed, moments, n + 1)
        if n >= late:
            for total, x in zip(sums, parameters, strict=True):
                total += x
    if batches:
        for total, x in zip(sums, parameters, strict=True):
            x[:] = total / (len(batches) - late)


def pooled_alone(model: Model, hashed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    own, place = np.unique(ids, return_inverse=True)
    return model.pooled(columns_of(model, hashed[own]), place + 1)[0]


def columns_of(model: Model, hashed: np.ndarray) -> np.ndarray:
    """What each word (a row of buckets) adds to each filter at each of its places: a column from id 1 on."""
    words, out, at = model.words(hashed), np.zeros((sum(WIDTHS) * FILTERS, len(hashed) + 1), np.float32), 0
    for f in model.filters:
        for place in f:
            out[at : at + FILTERS, 1:] = (words @ place).T
            at += FILTERS
    return out


def start(model: Model, texts: list[np.ndarray], toxic: np.ndarray, rng: np.random.Generator) -> None:
    """Embeddings whose first dimension is the log-odds of their bucket, and filters of which half read it."""
    counts = np.zeros((2, BUCKETS))
    for own, label in zip(texts, toxic, strict=True):
        counts[int(label), np.unique(own)] += 1
    model.known[:] = counts.sum(0) >= 3
    n = np.array([(toxic == c).sum() for c in (0, 1)])
    odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    model.embeddings[:] = rng.normal(0, 0.05, model.embeddings.shape)
    model.embeddings[:, 0] = odds * np.minimum(1, counts.sum(0) / 8)  # rare ones say little
    model.embeddings[0] = 0
    for w, f in zip(WIDTHS, model.filters, strict=True):
        f[:] = rng.normal(0, 0.3, f.shape)
        f[:, 0, : FILTERS // 2] = 1 / w
    model.bias[:] = -1.5
    model.out[:-1] = 0.3
    model.out[-1] = -2.0


def step(model: Model, texts: list[np.ndarray], toxic: np.ndarray, hashed: np.ndarray, moments: list, n: int) -> None:
    """One step down the gradient of the cross-entropy of some texts, all of it at the same parameters."""
    own, place = np.unique(np.concatenate(texts), return_inverse=True)
    parts = hashed[own]
    table, words = columns_of(model, parts), np.concatenate([np.zeros((1, DIMENSIONS), np.float32), model.words(parts)])
    local = np.split(place + 1, np.cumsum([len(t) for t in texts])[:-1])
    best, at = (np.stack(x) for x in zip(*(model.pooled(table, t, True) for t in local), strict=True))
    active = np.maximum(best + model.bias, 0)
    weight = np.where(toxic == 1, 2.0, 1.0)
    error = weight * (sigmoid(active @ model.out[:-1] + model.out[-1]) - toxic) / len(texts)
    back = error[:, None] * model.out[:-1] * (active > 0)
    gradients, by_word = [np.zeros_like(f) for f in model.filters], np.zeros_like(words)
    padded = [np.concatenate([t, np.zeros(max(WIDTHS), np.int64)]) for t in local]
    for f, width in enumerate(WIDTHS):
        cells = slice(f * FILTERS, (f + 1) * FILTERS)
        for o in range(width):
            seen = np.stack([t[x + o] for t, x in zip(padded, at[:, cells], strict=True)])  # texts x filters
            gradients[f][o] = np.einsum("bfd,bf->df", words[seen], back[:, cells])
            np.add.at(by_word, seen, back[:, cells, None] * model.filters[f][o].T)
    gradients += [back.sum(0), np.append(error @ active, error.sum())]
    known = model.known[parts]
    change = by_word[1:] / np.maximum(1, known.sum(1))[:, None]
    moved = np.flatnonzero(np.abs(change).sum(1))
    np.add.at(model.embeddings, parts[moved], (-EMBEDDING_RATE * BATCH * known[moved])[:, :, None] * change[moved][:, None])
    model.embeddings[0] = 0
    for x, g, (m, v) in zip((*model.filters, model.bias, model.out), gradients, moments, strict=True):
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x -= (RATE * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-7)).astype(x.dtype)


def calibrate(model: Model, logits: np.ndarray, toxic: np.ndarray, languages: list[str]) -> None:
    """Slope and shift by damped Newton steps on the held part, where toxic texts weigh more; a threshold for each language."""
    weight = np.where(toxic == 1, np.sqrt((toxic == 0).sum() / max(1, (toxic == 1).sum())), 1.0)
    y = np.where(toxic == 1, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((1 - toxic).sum() + 2))  # smoothed labels
    scale = max(1e-6, float(np.std(logits)))
    x, beta = np.stack([logits / scale, np.ones(len(logits))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ beta)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta += np.clip(np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 1e-3 * beta), -2, 2)
    model.slope, model.shift = float(max(beta[0], 1e-3) / scale), float(beta[1])
    scores = sigmoid(model.slope * logits + model.shift)

    def between(own: np.ndarray) -> float:
        """The middle of the widest range of thresholds with the fewest errors, weighed by class."""
        s, t = scores[own], toxic[own]
        cuts = np.unique(np.concatenate([[0.0], s, [1.0]]))
        middles = (cuts[1:] + cuts[:-1]) / 2
        wrong = [((s >= c) & (t == 0)).sum() / max(1, (t == 0).sum()) + ((s < c) & (t == 1)).sum() / max(1, (t == 1).sum()) for c in middles]
        least = np.flatnonzero(np.isclose(wrong, min(wrong)))
        return float(middles[least[np.argmax(np.diff(cuts)[least])]])

    everywhere = np.ones(len(toxic), bool)
    model.thresholds = {"": between(everywhere)}
    for language in sorted({x for x in languages if x is not None}):
        own = np.array([x == language for x in languages])
        if toxic[own].sum() >= 3 and (1 - toxic[own]).sum() >= 3:
            model.thresholds[language] = between(own)


def learnable(doc_id: str = "doc_id") -> Column:
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``sample`` labelled rows whose ids aren't held out, of ``most`` bytes in all, by the hash of the id."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("toxic").alias("_a"), F.max("toxic").alias("_b")).where("_a = _b")
    known = known.where(learnable("_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = df.select(F.col("doc_id").cast("long").alias("_doc"), text_of().alias("_text"), F.col("lang").alias("_lang"))
    found = texts.join(F.broadcast(known), F.col("_doc") == F.col("_id")).groupBy("_id", "_a").agg(F.min(F.struct("_text", "_lang")).alias("_row"))
    so_far = F.sum(F.octet_length("_row._text")).over(Window.orderBy(F.xxhash64("_id"), "_id"))  # ``sample`` rows
    rows = found.withColumn("_bytes", so_far).where(F.col("_bytes") <= most).select("_id", "_row._text", "_row._lang", "_a").collect()
    rows.sort(key=lambda r: r["_id"])
    return fit([r["_text"] for r in rows], np.array([r["_a"] for r in rows], np.float64), [r["_lang"] for r in rows])


def score(df: DataFrame, model: Model, name: str = "toxic_score") -> DataFrame:
    """``df`` with ``name`` (0 to 1) at the end."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # about four megabytes, by BUCKETS and DIMENSIONS

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = sliced(pa.RecordBatch.from_arrays([texts], ["text"]))
        scores = [shared.value.probabilities(pooled(shared.value, b.column(0))).astype(np.float64) for b in parts]
        give_back()
        return pa.array(np.concatenate(scores) if scores else np.zeros(0))

    return df.withColumn(own_names(df, name)[0], scored(text_of()))


def threshold(model: Model, language: str) -> Column:
    common = F.lit(model.thresholds.get("", CUT))
    return F.coalesce(*[F.when(F.col(language) == k, F.lit(v)) for k, v in model.thresholds.items() if k], common)


def clean(df: DataFrame, model: Model) -> DataFrame:
    """The rows of ``df`` that score below the threshold of their language."""
    (name,) = own_names(df, "toxic_score")
    return score(df, model, name).where(F.col(name) < threshold(model, "lang")).select(*df.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir)
    model = train(df, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = score(df.select("doc_id", "text", "lang"), model)
    return rated.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= CUT).cast("int").alias("predicted"), (F.col("toxic_score") >= threshold(model, "lang")).alias("rejected"))
