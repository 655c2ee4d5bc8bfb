"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import staged

#: Labelled documents that a model is fitted on at most, drawn by hash of their id, and its features.
MAX_LABELLED, MAX_FEATURES = 20_000, 8_000
#: A feature occurs in so many labelled documents, and is so many standard errors of log-odds from neutral.
MIN_DOCS, SCREEN = 5, 2.0
#: Occurrences of toxic-leaning words from which a toxic document has grade 2, and grade 3.
GRADE_AT, LEANING = (2, 4), 6.0
TOP = 3
PREFIXES = (3, 4, 5)
ROUNDS, RATE, PENALTY = 300, 0.1, 5e-5
REMEMBERED = 500_000

_KEEP = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def word_counts(text: str | None) -> Counter:
    """Counts of the lower-cased words of the whole text, as UTF-8: runs of anything but ASCII non-letters."""
    return Counter((text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split())


def features_of(word: bytes) -> list[str]:
    """The word itself, and its beginnings, which inflected forms share."""
    w = word.decode("utf-8", "replace")
    return [w, *(w[:n] + "*" for n in PREFIXES if len(w) > n)]


def features(counts: Counter) -> dict[str, int]:
    out: dict[str, int] = {}
    for word, n in counts.items():
        for f in features_of(word):
            out[f] = out.get(f, 0) + n
    return out


@dataclass
class Model:
    """Weights shared by all thresholds: P(grade > j) = sigmoid(w . x - cut[j]), cuts in rising order."""

    weights: dict[str, float]
    cuts: np.ndarray
    known: dict[bytes, tuple] = field(default_factory=dict)

    def over(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score and threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.cuts[None, :], -40, 40)))

    def score(self, counts: Counter) -> float:
        found: dict[str, int] = {}
        for word, n in counts.items():
            own = self.known.get(word)
            if own is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                own = self.known[word] = tuple(f for f in features_of(word) if f in self.weights)
            for f in own:
                found[f] = found.get(f, 0) + n
        return float(sum(self.weights[f] * (1 + np.log(n)) for f, n in found.items()))


def fit(sizes: np.ndarray, col: np.ndarray, counts: np.ndarray, toxic: np.ndarray, names: list[str], lean: np.ndarray) -> Model:
    """Maximum likelihood of the cumulative-link model on sparse rows of screened features.

    Row k has sizes[k] entries in turn: numbers of features, `col`, and their counts. names and lean
    describe the features.

    Severity of a toxic document, 1 to 3, goes by how often it uses features that lean clearly to toxic
    documents; others have grade 0. Adam on all rows, with an L2 penalty. Without labels of both
    kinds there is nothing to tell apart: the model then says grade 0.
    """
    n = len(sizes)
    if not n or not 0 < toxic.sum() < n:
        return Model({}, np.full(TOP, 20.0))
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    uses = np.zeros(n, dtype=np.int64)
    clear = lean[col] >= LEANING
    np.maximum.at(uses, row[clear], counts[clear])
    y = np.where(toxic > 0, 1 + (uses >= GRADE_AT[0]) + (uses >= GRADE_AT[1]), 0)
    val = (1 + np.log(counts)).astype(np.float32)
    at = np.arange(n)
    w, first, gaps = np.zeros(len(names)), np.log((y == 0).mean() / (y > 0).mean()), np.zeros(TOP - 1)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, np.zeros(1), gaps)]
    for step in range(1, ROUNDS + 1):
        cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        s = np.bincount(row, weights=w[col] * val, minlength=n)
        p = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -40, 40))), np.zeros((n, 1))])
        mass = np.maximum(p[at, y] - p[at, y + 1], 1e-12)
        slope = p * (1 - p)
        by_cut = np.zeros_like(p)
        by_cut[at, y] -= slope[at, y] / mass
        by_cut[at, y + 1] += slope[at, y + 1] / mass
        on_cuts = by_cut[:, 1 : TOP + 1].mean(axis=0)
        on_gaps = np.array([on_cuts[j + 1 :].sum() * np.exp(gaps[j]) for j in range(TOP - 1)])
        on_score = (slope[at, y] - slope[at, y + 1]) / mass
        ascent = (np.bincount(col, weights=on_score[row] * val, minlength=len(w)) / n - PENALTY * w, np.array([on_cuts.sum()]), on_gaps)
        moved = []
        for (m, v), g in zip(state, ascent):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            moved.append(RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
        w, first, gaps = w + moved[0], first + moved[1][0], gaps + moved[2]
    return Model({f: float(w[k]) for k, f in enumerate(names) if abs(w[k]) > 1e-4}, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of at most `limit` labelled documents, the same ones every time.

    Repeated labels of a document count as toxic if one does; null ids, labels and texts are left out. Of rows
    that share a labelled id one counts, so at most `limit` rows come to the driver.
    The drawn ids, `limit` at most, are broadcast, so documents are scanned and not moved.
    Features are counted and screened on Spark; the MAX_FEATURES that lean most come to the driver, and
    with them the labelled documents reduced to those.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")

    def count(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = [word_counts(text.as_py()) for text in b.column(2)]
            cols = [b.column(0), b.column(1), pa.array([b" ".join(c) for c in rows], pa.binary()), pa.array([np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "y", "words", "counts"])

    sample = texts.join(F.broadcast(drawn), "id").select("id", "y", "text").mapInArrow(count, "id long, y int, words binary, counts binary")
    # One row per id, however often it is repeated, before anything is counted or collected.
    row = F.struct("y", "words", "counts")
    sample = sample.groupBy("id").agg(F.min(row).alias("_r")).select("id", "_r.y", "_r.words", "_r.counts")
    sample = staged(sample, "labelled")
    total, total_bad = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()

    def unpacked(b: pa.RecordBatch) -> Iterable[dict[str, int]]:
        for words, counts in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            yield features(Counter(dict(zip(words.split(), np.frombuffer(counts, np.int32).tolist()))))

    def holders(batches: Iterator[pa.RecordBatch]):
        n, bad = Counter(), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([bad[f] for f in n], pa.int64())], ["feature", "n", "bad"])
            n.clear(), bad.clear()
            return out

        for b in batches:
            for y, fs in zip(b.column(1).to_pylist(), unpacked(b)):
                n.update(fs.keys())
                if y:
                    bad.update(fs.keys())
                if len(n) >= REMEMBERED:
                    yield flush()
        yield flush()

    summed = sample.mapInArrow(holders, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter(F.col("n") >= MIN_DOCS)
    a, b, c, d = F.col("bad") + 0.5, F.col("n") - F.col("bad") + 0.5, F.lit(total_bad) - F.col("bad") + 0.5, F.lit(total - total_bad) - F.col("n") + F.col("bad") + 0.5
    lean = ((F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)).alias("lean")
    picked = summed.select("feature", lean).filter(F.abs("lean") >= SCREEN).orderBy(F.abs("lean").desc(), "feature").limit(MAX_FEATURES)
    leans = {r.feature: r.lean for r in picked.collect()}
    names = sorted(leans)
    shared = docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def reduce(batches: Iterator[pa.RecordBatch]):
        place = shared.value
        for b in batches:
            kept = [[(place[f], n) for f, n in fs.items() if f in place] for fs in unpacked(b)]
            cols = [b.column(0), b.column(1), *(pa.array([np.array([x[i] for x in k], np.int32).tobytes() for k in kept], pa.binary()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "y", "col", "counts"])

    found = sample.mapInArrow(reduce, "id long, y int, col binary, counts binary").toPandas().sort_values("id")
    col, counts = (np.frombuffer(b"".join(found[c]), np.int32) for c in ("col", "counts"))
    sizes = found["col"].map(len).to_numpy(np.int64) // 4
    return fit(sizes, col, counts, found["y"].to_numpy(), names, np.array([leans[f] for f in names]))


def assess(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, grade, toxic) of every row, in one scan without a shuffle.

    expected_severity is the mean grade, 0 to 3; grade the likeliest; toxic: a grade over 0 is
    likelier than not. Null and wordless texts get what the thresholds alone say. The model, of
    MAX_FEATURES weights at most, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))

    def run(batches: Iterator[pa.RecordBatch]):
        local = Model(*shared.value)
        for b in batches:
            scores = np.array([local.score(word_counts(t.as_py())) for t in b.column(1)], dtype=float)
            over = local.over(scores)
            share = np.hstack([np.ones((len(scores), 1)), over]) - np.hstack([over, np.zeros((len(scores), 1))])
            cols = [b.column(0), pa.array(over.sum(axis=1)), pa.array(share.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "expected_severity", "grade", "toxic"])

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(run, "doc_id long, expected_severity double, grade int, toxic boolean")
