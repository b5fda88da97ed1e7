"""Toxicity by weak supervision.

1. Voters are mined from labelled training rows: words, word beginnings of three to six letters (patterns for families of
   inflected words), and fixed patterns. A voter abstains unless it occurs in the text. Labels serve here, to choose voters that speak
   for toxic texts; they take no further part.
2. A generative label model sees the votes alone. Voters that go together (correlated by TIED or more, directly or over others) form a
   vocabulary; each has a hidden class of its own, for the words of one language or circle say nothing in another one's texts, and
   a text is toxic if it is so in some vocabulary. Given the class, a vocabulary's voters depend on each other along a tree: each has a
   parent, the voter it goes together with most within the classes (the spanning tree of greatest conditional mutual information), so that
   votes which others explain count little. Expectation-maximisation, begun with all voters equally right, estimates each voter's
   accuracy (how often it speaks in toxic and in clean texts, with its parent and without it); then the tree is drawn anew from the
   posteriors, and the estimation is repeated. In the last posteriors silence weighs SILENCE of a vote, since short texts give a voter no occasion.
3. Posteriors of the label model, which overrule given labels that the votes speak against, are the training labels of a logistic
   regression over words and word beginnings. Its score is the sum over the features of the whole text.

Training rows are a hash-drawn sample of at most about MAX_TRAIN labelled rows (the stated bound), so the votes and the
model have a fixed size; every document is scored over its whole text. Training rows are those whose crc32(doc_id as text)
mod 5 is not 0. Labels, lang, source and doc_id never enter a score.

Defined cases: null text counts as empty; an empty text scores the model's intercept; repeated labels of one doc_id count as their
maximum; a null doc_id is held out; with fewer than two classes to learn from, every score is that class's share (0 without labels);
equal texts have equal scores; empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import small_batches

#: Labelled rows to learn from, at most (in expectation; drawn by hash).
MAX_TRAIN = 12_000
#: Features of the classifier and voters of the label model.
FEATURES, VOTERS = 1500, 200
PREFIXES = (3, 4, 5, 6)
#: Share of the toxic rows in which a voter must occur (TRUST of the rows with it are toxic); share of a voter's rows in which no earlier voter may occur throughout.
SUPPORT, SUBSUMED = 0.02, 0.95
#: Share of the toxic rows in which a feature must occur: with it, candidates are at most 100 times the features of a text.
LEAST_SHARE = 0.01
#: Voters are chosen to be right with this probability at least, with which the label model begins; correlation that ties two voters; weight of an abstention.
TRUST, TIED, SILENCE = 0.8, 0.3, 0.25
_WORD = re.compile(r"[^\W\d_]+")
#: Patterns that vote besides the mined ones.
PATTERNS = (
    r"!{3,}",
    r"\b[A-Z]{4,}\b(?:\W+[A-Z]{4,}\b){2}",
    r"(?i)\b(?:shut up|go to hell|drop dead|get lost|kill yourself)\b",
    r"(?i)\byou(?:'re| are)? (?:all )?(?:such )?an? \w+[!.]",
    r"(?i)\b(?:i|we) (?:hate|despise|loathe) (?:you|them|him|her)\b",
    r"\b\w[@#$%*]{2,}\w*\b",
    r"(?i)\b\w*(\w)\1{3,}\w*\b",
)
_PATTERNS = [re.compile(p) for p in PATTERNS]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features_of(text: str) -> set[str]:
    """Distinct lower-case words, and word beginnings marked by a hyphen."""
    found = set(_WORD.findall(text.lower()))
    return found | {f"{w[:n]}-" for w in found for n in PREFIXES if len(w) > n}


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of the drawn training rows; the drawn labels are at most about `bound` rows of 12 bytes, hence broadcast."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").alias("_label_id")).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, bound / max(usable.count(), 1))
    drawn = usable.filter(F.pmod(F.xxhash64("_label_id", F.lit("toxicity")), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_label_id")).select("text", F.col("toxic").cast("int").alias("toxic"))


def _count_features(batches):
    """Documents per feature and label, summed over the task before they travel."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[int(toxic > 0)].update(features_of(text.as_py() or ""))
    rows = [(f, counts[0][f], n) for f, n in counts[1].items()]
    columns = list(zip(*rows)) or [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["feature", "clean", "toxic"])


def _count_clean(wanted: frozenset):
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                if not toxic:
                    counts.update(features_of(text.as_py() or "") & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "clean"])

    return run


def mine_features(train: DataFrame, n_toxic: int, n_clean: int, features: int = FEATURES) -> list[tuple[str, int, int]]:
    """The features that tell most: (feature, toxic documents, clean documents), by information, ties by name.

    Candidates are those in at least LEAST_SHARE of the toxic rows, a list the sample bounds; clean rows are counted for them only.
    """
    toxic = train.filter("toxic > 0").mapInArrow(_count_features, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("toxic").alias("toxic"))
    common = {r.feature: r.toxic for r in toxic.filter(F.col("toxic") >= max(3, n_toxic * LEAST_SHARE)).collect()}
    clean = train.mapInArrow(_count_clean(frozenset(common)), "feature string, clean long").groupBy("feature").agg(F.sum("clean").alias("clean"))
    seen = dict(clean.collect())
    scored = []
    for f, t in common.items():
        c = seen.get(f, 0)
        p, q = (t + 0.5) / (n_toxic + 1), (c + 0.5) / (n_clean + 1)
        gain = p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q)) if 0 < p < 1 and 0 < q < 1 else 0
        scored.append((-gain, f, t, c))
    return [(f, t, c) for _, f, t, c in sorted(scored)[:features]]


def _rows_of(names: list[str]):
    """Feature numbers and fixed-pattern votes of each training row."""
    index = {f: i for i, f in enumerate(names)}

    def run(batches):
        for batch in batches:
            hits = []
            for text in batch.column(0):
                text = text.as_py() or ""
                hits.append(sorted(index[f] for f in features_of(text) if f in index) + [len(names) + i for i, p in enumerate(_PATTERNS) if p.search(text)])
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch.column(1)], ["hits", "toxic"])

    return run


def _information(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mutual information (in nats, times the weight) of all pairs of votes among rows of these weights."""
    total = weight.sum() + 1e-9
    both = x.T @ (x * weight[:, None].astype(np.float32)).astype(np.float64)
    on = np.diag(both)
    out = np.zeros_like(both)
    for a, b, cell in ((1, 1, both), (1, 0, on[:, None] - both), (0, 1, on[None, :] - both), (0, 0, total - on[:, None] - on[None, :] + both)):
        p, q = (on if a else total - on)[:, None], (on if b else total - on)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(cell > 1e-6, cell * np.log(cell * total / (p * q)), 0)
    return out


def _tree(x: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Each voter's parent in the spanning forest of greatest information given the class; -1 for those that go with no other."""
    v = x.shape[1]
    tie = _information(x, post) + _information(x, 1 - post)
    np.fill_diagonal(tie, 0)
    parent, best, into = np.full(v, -1), np.full(v, -1.0), np.full(v, -1)
    left = np.ones(v, bool)
    while left.any():
        j = int(np.argmax(np.where(left, best, -2)))
        left[j] = False
        parent[j] = into[j] if best[j] > 5 else -1  # far beyond chance: twice this is chi-squared
        closer = left & (tie[j] > best)
        best[closer], into[closer] = tie[j][closer], j
    return parent


def independent(x: np.ndarray, able: list[int], most: int = VOTERS) -> list[int]:
    """Of the features in their order, those that are not mere cases of an earlier one: SUBSUMED of their rows have it."""
    chosen: list[int] = []
    for i in able:
        if len(chosen) == most:
            break
        rows = x[:, i] > 0
        if not chosen or x[rows][:, chosen].mean(axis=0).max() < SUBSUMED:
            chosen.append(i)
    return chosen


def _vocabularies(x: np.ndarray) -> np.ndarray:
    """The number of each voter's vocabulary: connected voters by correlation of TIED or more."""
    v, mean = x.shape[1], x.mean(axis=0).astype(np.float64)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tied = (x.T @ x / len(x) - np.outer(mean, mean)) / np.outer(scale, scale) >= TIED
    label = np.arange(v)
    while True:
        least = np.where(tied | np.eye(v, dtype=bool), label[None, :], v).min(axis=1)
        if (least == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = least


def _two_classes(x: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One vocabulary: posterior per row, P(vote | toxic) and P(vote | clean) per voter, parents."""
    n, v = x.shape
    post = np.full(n, 0.5)
    for drawn in range(3):
        parent = _tree(x, post)
        with_parent = np.where(parent >= 0, x[:, parent], 0).astype(np.float32)
        both = x * with_parent
        if drawn == 0:  # each vote that no parent's vote explains is right with TRUST
            post = 1 - (1 - TRUST) ** (x - both).sum(axis=1).astype(np.float64)
        base = (x.sum(0) - both.sum(0) + 0.5) / (n - with_parent.sum(0) + 1)
        base_led = (both.sum(0) + 0.5) / (with_parent.sum(0) + 1)
        for _ in range(rounds):
            share = float(np.clip(post.mean(), 1e-6, 0.9))
            table = []  # P(vote) without and with the parent's vote, in each class
            for weight in (1 - post, post):
                rows, voted, led, joint = weight.sum(), weight @ x, weight @ with_parent, weight @ both
                table.append([np.clip((hits + 2 * overall) / (seen + 2), 1e-6, 1 - 1e-6) for hits, seen, overall in ((voted - joint, rows - led, base), (joint, led, base_led))])
            (off, off_led), (on, on_led) = table
            on, on_led = np.maximum(on, off), np.maximum(on_led, off_led)  # voters speak for toxicity
            vote, silent = np.log(on / off), np.log((1 - on) / (1 - off))
            vote_led, silent_led = np.log(on_led / off_led), np.log((1 - on_led) / (1 - off_led))
            spoken = x @ vote + both @ (vote_led - vote)
            silence = silent.sum() - x @ silent + with_parent @ (silent_led - silent) - both @ (silent_led - silent)
            posterior = lambda w: 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + spoken + w * silence, -40, 40)))
            new = posterior(1.0)
            moved, post = np.abs(new - post).max(), new
            if moved < 1e-6:
                break
    rates = np.stack([(w @ x + 0.05) / (w.sum() + 0.1) for w in (post, 1 - post)])
    return posterior(SILENCE), rates, parent


def label_model(votes: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic; P(vote | toxic) and P(vote | clean), parent, vocabulary per voter) from a 0/1 vote matrix alone."""
    x = votes.astype(np.float32)
    n, v = x.shape
    clean, rates, parents = np.ones(n), np.zeros((2, v)), np.full(v, -1)
    vocabulary = _vocabularies(x) if n and v else np.zeros(v, np.int64)
    for c in range(vocabulary.max(initial=-1) + 1):
        mine = np.flatnonzero(vocabulary == c)
        post, rates[:, mine], parent = _two_classes(x[:, mine], rounds)
        parents[mine] = np.where(parent >= 0, mine[parent], -1)
        clean *= 1 - post
    return 1 - clean, rates, parents, vocabulary


def fit_linear(x: np.ndarray, target: np.ndarray, l2: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; deterministic."""
    n, d = x.shape
    w, b = np.zeros(d, np.float32), float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6)))
    ahead, t = w.copy(), 1.0
    y = target.astype(np.float32)
    row_norm = float(np.einsum("ij,ij->", x, x, dtype=np.float64)) / n
    rate = 4.0 / (row_norm + 1)
    bias_rate = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead + b, -30, 30)))
        err = p - y
        new = ahead - rate * (x.T @ err / n + l2 * ahead)
        b -= bias_rate * float(err.mean())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w, b


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> dict:
    """The fitted scorer: {"weights": {feature: weight}, "bias": b}, plus the label model's estimates and how many labels it overruled."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, bound).persist()
    try:
        sizes = dict(rows.groupBy((F.col("toxic") > 0).alias("t")).count().collect())
        n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
        if not n_toxic or not n_clean:
            return {"weights": {}, "bias": 40.0 if n_toxic else -40.0, "voters": {}, "overruled": {"to_toxic": 0, "to_clean": 0, "rows": n_toxic + n_clean}}
        mined = mine_features(rows, n_toxic, n_clean)
        names = [f for f, _, _ in mined]
        table = rows.mapInArrow(_rows_of(names), "hits array<int>, toxic int").toArrow()
    finally:
        rows.unpersist()
    width = len(names) + len(PATTERNS)
    hits = table.column("hits").combine_chunks()
    hits = hits if isinstance(hits, pa.Array) else hits.chunk(0)
    lengths = hits.value_lengths().to_numpy()
    x = np.zeros((len(lengths), width), np.uint8)  # as numbers it is four times as large
    x[np.repeat(np.arange(len(lengths)), lengths), hits.flatten().to_numpy()] = 1
    order = np.lexsort(np.packbits(x, axis=1).T)  # the order of arrival does not matter
    x, toxic = x[order], (table.column("toxic").to_numpy() > 0)[order]
    # voters: features and patterns that tell for toxicity, each rare in clean rows
    tells = lambda t, c: t >= max(3, SUPPORT * n_toxic) and t >= TRUST * (t + c)
    able = [i for i, (_, t, c) in enumerate(mined) if tells(t, c)] + [i for i in range(len(names), width) if tells(x[toxic, i].sum(), x[~toxic, i].sum())]
    voters = independent(x, able)
    post, rates, parent, vocabulary = label_model(x[:, voters] > 0)
    w, b = fit_linear(x[:, : len(names)].astype(np.float32), post)
    every = [*names, *PATTERNS]
    led_by = [every[voters[p]] if p >= 0 else None for p in parent]
    estimates = {every[i]: (float(rates[0, k]), float(rates[1, k]), led_by[k], int(vocabulary[k])) for k, i in enumerate(voters)}
    overruled = {"to_toxic": int(((post > 0.5) & ~toxic).sum()), "to_clean": int(((post <= 0.5) & toxic).sum()), "rows": len(toxic)}
    return {"weights": {f: float(v) for f, v in zip(names, w) if v}, "bias": b, "voters": estimates, "overruled": overruled}


class _WordWeights(dict):
    """word -> the model's features it carries, remembered up to a bound."""

    LIMIT = 100_000

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple:
        if len(self) >= self.LIMIT:
            self.clear()
        names = (word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n))
        found = self[word] = tuple(self.index[f] for f in names if f in self.index)
        return found


def _logit(text: str | None, carried: _WordWeights, weights: np.ndarray, bias: float) -> float:
    found: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        if hits := carried[word]:
            found.update(hits)
    return bias + float(weights[sorted(found)].sum()) if found else bias


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted."""
    names = sorted(model["weights"])
    weights, bias = np.array([model["weights"][f] for f in names]), model["bias"]

    def run(batches):
        carried = _WordWeights({f: i for i, f in enumerate(names)})
        for batch in batches:
            z = np.array([_logit(text.as_py(), carried, weights, bias) for text in batch.column(1)], float)
            scores = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return wanted.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic; columns unchanged."""
    model = train(docs, labels)
    names = sorted(model["weights"])
    weights, bias = np.array([model["weights"][f] for f in names]), model["bias"]

    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        carried = _WordWeights({f: i for i, f in enumerate(names)})
        for texts in batches:
            yield pa.array([_logit(text.as_py(), carried, weights, bias) >= 0 for text in texts], pa.bool_())

    small_batches(docs.sparkSession)
    return docs.filter(~F.arrow_udf(toxic, "boolean")(F.col("text")))
