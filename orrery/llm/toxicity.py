"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters. Lexicon voters vote "toxic" for a text with their word: those of a general lexicon, and stems of
   words that labelled training texts show to come with toxic ones, which finds inflected words of languages
   that the lexicon lacks. A general word that stands in more clean than toxic ones is dropped. Pattern voters look for insults put to somebody,
   shouted or repeated words, and for texts in which no lexicon stem stands (a vote for "clean").
2. Label model. Votes are taken as noisy signs of an unseen label. Expectation-maximisation estimates the
   share of toxic texts and how often each voter fires on toxic and on clean ones, without labels; the
   correlation of two voters within the estimated classes lowers the weight of both, since voters that
   agree because they look at the same thing count only once. Correlations below 0.2, negative ones among
   them, count as 0: by chance alone two rare voters may agree that much.
3. Classifier. Logistic regression on which voters fire, trained on the label model's posterior labels.

Everything is fitted on at most TRAIN_ROWS labelled training rows; scoring is one pass over all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches, cut, shingle_sets, text_batches

#: Labelled rows that the models are fitted on, at most; the first in the order of a hash of doc_id.
TRAIN_ROWS = 20_000
#: Near copies among the labelled texts are one family, of which one is read: texts that share COMMON_HASHES of
#: their SMALL_HASHES smallest shingle hashes. Else the words of a copied toxic text would look like signs.
FAMILY_WORDS = 3
SMALL_HASHES = 8
COMMON_HASHES = 3
#: The lengths of stems that are tried as voters.
STEM_LENGTHS = range(4, 11)
#: Stems that a task counts, or one text's more, before it reports them and begins anew; the reports are added up.
COUNTED_STEMS = 50_000
#: A mined stem is in so many toxic training texts at least, with such a log odds ratio and log-likelihood
#: ratio (G squared) at least: what chance gives among a million stems.
LEAST_TEXTS = 4
LEAST_LOG_ODDS = 2.5
LEAST_G2 = 28.0

# General words of abuse, four languages; a seed for the voters.
LEXICON = (
    "idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "bastard", "asshole", "bitch", "shit", "fuck", "fucking", "retard", "whore", "slut",
    "abruti", "connard", "salaud", "crétin", "imbécile", "merde",
    "arschloch", "trottel", "blödmann", "scheiße", "abschaum", "wichser",
    "estúpido", "idiota", "imbécil", "gilipollas", "cabrón", "mierda",
)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass(frozen=True)
class Model:
    """Weights of stems for log odds, a weight for each pattern, and the bias."""

    stems: dict[str, float]
    patterns: tuple[float, ...]
    bias: float


class Stems:
    """Which voters' words a text holds: general words as they are, mined stems where they begin a word."""

    def __init__(self, voters):
        self.words = frozenset(voters) & frozenset(LEXICON)
        self.stems = frozenset(voters) - self.words
        self.heads = {s[:3] for s in self.stems}
        self.sizes = sorted({len(s) for s in self.stems})

    def hits(self, words: set[str]) -> dict[str, set[str]]:
        """Words by their voter."""
        found = {w: {w} for w in words & self.words}
        for w in words:
            if w[:3] in self.heads:
                for n in self.sizes:
                    if w[:n] in self.stems and len(w) >= n:
                        found.setdefault(w[:n], set()).add(w)
        return found


_ADDRESSED = r"\b(?:you|your|ihr|du|tu|vous|usted|the|a|by)\s+(?:{})\b"


def pattern_votes(text: str, hits: dict[str, set[str]]) -> tuple[int, ...]:
    """Votes: an insult put to somebody, two of them, a shouted one, and none at all (clean)."""
    words = set().union(*hits.values()) if hits else set()
    if not words:
        return 0, 0, 0, 1
    addressed = re.search(_ADDRESSED.format("|".join(map(re.escape, sorted(words)))), text.lower())
    return int(bool(addressed)), int(len(words) > 1), int(any(w.upper() in text for w in words)), 0


def fit_label_model(votes: np.ndarray, toxic_sign: np.ndarray, rounds: int = 50, prior: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probabilities of label 1 and the voters' weights, from votes (rows, voters) of 0 or 1.

    toxic_sign: for each voter, whether its vote starts out as one for label 1. Without rows: no posterior.
    """
    n, m = votes.shape
    on_toxic, on_clean = np.where(toxic_sign, 0.3, 0.05), np.where(toxic_sign, 0.01, 0.9)
    weight = np.ones(m)
    post = np.full(n, prior)
    if not n:
        return post, weight
    for turn in range(rounds):
        # a voter that doesn't fire abstains
        logit = np.log(prior / (1 - prior)) + votes @ (weight * np.log(on_toxic / on_clean))
        new = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        done = np.abs(new - post).max() < 1e-6 and turn > 4
        post = new
        if done:
            break
        prior = float(np.clip(post.mean(), 1e-4, 0.5))
        on_toxic = np.clip((votes.T @ post + 0.1) / (post.sum() + 0.2), 1e-4, 1 - 1e-4)
        on_clean = np.clip((votes.T @ (1 - post) + 0.1) / ((1 - post).sum() + 0.2), 1e-4, 1 - 1e-4)
        # correlation of what the classes leave unexplained
        rest = votes - post[:, None] * on_toxic - (1 - post)[:, None] * on_clean
        cov = rest.T @ rest / n
        sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        corr = np.clip(cov / sd[:, None] / sd[None, :], 0, 1)
        corr[corr < 0.2] = 0
        np.fill_diagonal(corr, 1)
        weight = 1 / corr.sum(axis=1)
    return post, weight


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels y by Newton steps: weights and bias."""
    n, m = x.shape
    if not n:
        return np.zeros(m), -2.0
    z = np.hstack([x, np.ones((n, 1))]).astype(np.float64)
    w = np.zeros(m + 1)
    penalty = np.full(m + 1, ridge * n)
    penalty[-1] = 1e-6 * n
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ (p - y) + penalty * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def one_of_each_family(least: dict[int, list[int]]) -> set[int]:
    """Of ids with their smallest shingle hashes, the first of each family; a text without shingles is its own."""
    by_hash: dict[int, list[int]] = {}
    for i in sorted(least):
        for h in least[i]:
            by_hash.setdefault(h, []).append(i)
    common = Counter((own[0], i) for own in by_hash.values() for i in own[1:])  # with the first of each list only
    top = {i: i for i in least}

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for (a, b), n in common.items():
        if n >= min(COMMON_HASHES, len(least[a]), len(least[b])):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return {i for i in top if root(i) == i}


def held_out(id_col: str = "doc_id"):
    """True for the fold whose labels are never read: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit the voters, the label model and the classifier on labelled rows outside the held-out fold.

    docs: doc_id, text; labels: doc_id, toxic. Rows without a label or an id don't take part. Of labels that
    contradict each other 1 counts, of texts that share an id the last in their order. Without any training
    row the model rests on the general lexicon alone.
    """
    bounded_batches(docs.sparkSession)
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch):
                least = [(x[:SMALL_HASHES] >> np.uint64(1)).astype(np.int64) for x in shingle_sets(part.column("text"), FAMILY_WORDS)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(least, pa.list_(pa.int64()))], ["doc_id", "least"])

    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), "labelled")
    firsts = one_of_each_family({r["doc_id"]: r["least"] for r in texts.select("doc_id", "text").mapInArrow(smallest, "doc_id long, least array<long>").collect()})
    texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(firsts)], "doc_id long")), "doc_id", "left_semi")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array([toxic[w] for w in every], pa.int64()), pa.array(list(every.values()), pa.int64())], ["stem", "t", "n"])

        toxic, every = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = {w[:n] for w in words_of(text) for n in STEM_LENGTHS if len(w) >= n}
                every.update(own)
                if y:
                    toxic.update(own)
                if len(every) >= COUNTED_STEMS:
                    yield told()
                    toxic.clear()
                    every.clear()
        yield told()

    total = texts.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    n, t = total["n"], total["t"] or 0
    mined: list[str] = []
    if n and 0 < t < n:
        stats = texts.mapInArrow(counted, "stem string, t long, n long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        odds = F.log((F.col("t") + 0.5) / (t + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (n - t + 1.0))
        part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
        k, c = F.col("t"), F.col("n") - F.col("t")
        g2 = 2 * (part(k, F.col("n") * (t / n)) + part(c, F.col("n") * ((n - t) / n)))
        best = stats.where(k >= LEAST_TEXTS).withColumn("odds", odds).withColumn("g2", g2).where((F.col("odds") >= LEAST_LOG_ODDS) & (F.col("g2") >= LEAST_G2))
        # a stem that begins another's words, or is begun by it, says the same; the stronger one stays
        taken, begun = set(LEXICON), {w[:k] for w in LEXICON for k in range(1, len(w) + 1)}
        for r in best.orderBy(F.desc("g2"), F.length("stem"), "stem").collect():  # stems of train_rows texts, far beyond chance
            stem = r["stem"]
            heads = {stem[:k] for k in range(1, len(stem) + 1)}
            if stem not in begun and not heads & taken:
                mined.append(stem)
                taken.add(stem)
                begun |= heads

    def votes_of(batches: Iterator[pa.RecordBatch], voters: list[str]) -> Iterator[pa.RecordBatch]:
        stems = Stems(voters)
        place = {w: i for i, w in enumerate(voters)}
        for batch in batches:
            for part in text_batches(batch):
                out = []
                for text in part.column("text").to_pylist():
                    hits = stems.hits(words_of(text))
                    out.append([place[w] for w in hits] + [len(voters) + i for i, v in enumerate(pattern_votes(text, hits)) if v])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), part.column("toxic")], ["votes", "toxic"])

    def votes_with(voters: list[str]) -> list:
        return texts.mapInArrow(lambda b: votes_of(b, voters), "votes array<int>, toxic int").collect()  # train_rows short lists at most

    voters = sorted({*LEXICON, *mined})
    fired = Counter((v, r["toxic"]) for r in votes_with(voters) for v in r["votes"])
    voters = [w for i, w in enumerate(voters) if fired[i, 1] >= fired[i, 0]]
    rows = votes_with(voters)
    votes = np.zeros((len(rows), len(voters) + 4), np.float32)
    for i, r in enumerate(rows):
        votes[i, r["votes"]] = 1
    sign = np.ones(votes.shape[1], bool)
    sign[-1] = False
    fires = votes.any(axis=0) if len(rows) else np.zeros(votes.shape[1], bool)
    post, _ = fit_label_model(votes[:, fires], sign[fires])
    weights = np.zeros(votes.shape[1])
    w, bias = fit_linear(votes[:, fires], post)
    weights[fires] = w
    # a seed stem that no training text holds weighs as much as the median one that some hold
    seen = [x for x, f in zip(weights[: len(voters)], fires[: len(voters)], strict=True) if f and x > 0]
    usual = float(np.median(seen)) if seen else 3.0
    by_word = {v: float(weights[i]) if fires[i] else usual for i, v in enumerate(voters)}
    return Model(by_word, tuple(map(float, weights[len(voters) :])), bias)


def _score(model: Model, stems: Stems, text: str) -> float:
    hits = stems.hits(words_of(text))
    z = model.bias + sum(model.stems[w] for w in hits) + sum(w * v for w, v in zip(model.patterns, pattern_votes(text, hits), strict=True))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for each row of docs, from its text alone; a null text counts as empty."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = Stems(model.stems)
        for batch in batches:
            for part in text_batches(batch):
                out = [_score(model, stems, text) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(scores, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5) for each row of docs.

    Rows that repeat an id are scored each by its own text; labels, lang, source and ids never enter a
    score; other columns are ignored. An empty docs gives no rows.
    """
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), train_rows)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below threshold, with all their columns."""

    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stems = Stems(model.stems)
        for batch in texts:
            yield pa.array([_score(model, stems, t.as_py() or "") for t in batch], pa.float64())

    return docs.where(F.arrow_udf(scores, "double")(F.col(text_col)) < threshold)
