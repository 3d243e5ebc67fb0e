"""op9 -- toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Voters.  A fixed lexicon of insults, terms induced from training labels (words and word
   beginnings that toxic rows hold and clean rows do not) and surface patterns each vote toxic,
   clean or abstain on a bounded sample of labelled training rows.
2. Label model.  EM for a two-class mixture gives every voter's accuracy; pairs of voters that
   agree more than their class explains are correlated, and share their weight.
3. Classifier.  Logistic regression on term presence is trained on the model's posterior labels and
   scores every whole text in one pass.  Only text is an input of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, mix, prefix_hash, span_hash, table, text_blocks
from .linear import fit_logistic, logit, sigmoid

#: Rows of each class that the model is fitted on, at most; everything is scored.
SAMPLE_PER_CLASS = 2000
#: Insults that the lexicon voters know from the start, two words a voter.
INSULTS = (
    ("idiot", "moron"),
    ("stupid", "dumb"),
    ("loser", "clown"),
    ("pathetic", "worthless"),
    ("trash", "scum"),
    ("disgusting", "filthy"),
)
#: Surface patterns that vote toxic where they match a lower-cased text, and abstain elsewhere.
PATTERNS = (r"\byou (are|r) (a|an|such|so)\b", r"\b(shut up|hate you|kill yourself)\b")
PREFIXES = (4, 5, 6)
INDUCED_VOTERS = 10
MAX_TERMS = 4000

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


def terms_of_block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, term)`` of every word and word beginning in a block of lower-cased texts."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | cut))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | cut))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    prefix = prefix_hash(data)
    out_rows, out_terms = [rows], [span_hash(prefix, starts, ends)]
    for k in PREFIXES:
        long = ends - starts > k
        out_rows.append(rows[long])
        out_terms.append(mix(span_hash(prefix, starts[long], starts[long] + k) + np.uint64(k)))
    return np.concatenate(out_rows), np.concatenate(out_terms)


def word_term(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0])


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text: str = "text") -> list:
    """At most ``2 * per_class`` rows ``(text, label)`` whose key's crc32 mod 5 is not 0."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    usable = usable.groupBy("doc_id").agg(F.max(label).alias("y"))
    order = F.xxhash64(F.lit(5), "doc_id")
    picked = None
    for y in (0, 1):
        some = usable.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    ids = picked.select(F.col("doc_id").alias("_id"), "y")
    low = F.lower(F.col(text))
    patterns = [F.when(low.rlike(p), 1).otherwise(0).alias(f"v{k}") for k, p in enumerate(PATTERNS)]
    patterns.append(F.when(F.length(low) < 40, -1).otherwise(0).alias(f"v{len(PATTERNS)}"))
    rows = docs.select("doc_id", text).filter(F.col(text).isNotNull()).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))  # bounded: 2 * per_class rows
    rows = rows.select("doc_id", low.alias("t"), "y", F.array(*patterns).alias("votes")).dropDuplicates(["doc_id"])
    return rows.orderBy("doc_id").limit(2 * per_class).collect()


def term_counts(rows: np.ndarray, terms: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms and in how many rows of class 1 and 0 each stands; pairs are distinct."""
    found, at = np.unique(terms, return_inverse=True)
    return found, np.bincount(at, weights=y[rows], minlength=len(found)), np.bincount(at, weights=1 - y[rows], minlength=len(found))


def induced_terms(rows: np.ndarray, terms: np.ndarray, y: np.ndarray, least: int = 4, odds: float = 3.0) -> np.ndarray:
    """Terms that toxic rows hold at least ``exp(odds)`` times as often as clean ones, best first."""
    found, pos, neg = term_counts(rows, terms, y)
    score = np.log((pos + 0.2) / max(y.sum(), 1)) - np.log((neg + 0.2) / max((1 - y).sum(), 1))
    good = np.flatnonzero((pos >= least) & (score >= odds))
    return found[good[np.argsort(-score[good] * np.sqrt(pos[good]), kind="stable")]][:MAX_TERMS]


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for rows of votes in {1, 0, -1}; EM over class-conditional vote rates.

    Correlations: what two voters' votes share beyond their classes' means.  A voter's log odds are
    divided by one plus its positive correlations, so copies of a voter do not count as many.
    """
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    spoke = (votes == 1).sum(1) - (votes == -1).sum(1)
    post = np.where(spoke > 0, 0.9, prior * 0.2)
    weight = np.ones(votes.shape[1])
    rates = None
    for _ in range(rounds):
        both = np.stack([1 - post, post])
        rates = (np.einsum("cn,njv->cjv", both, onehot) + 0.5) / (both.sum(1)[:, None, None] + 1.5)
        mean = np.einsum("cjv,v->cj", rates, np.array([-1.0, 0.0, 1.0]))
        rest = votes[None] - mean[:, None, :]
        cov = np.einsum("cn,cnj,cnk->jk", both, rest, rest) / len(votes)
        spread = np.sqrt(np.diag(cov)) + 1e-9
        corr = cov / spread[:, None] / spread[None]
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + np.clip(corr, 0, 1).sum(1))
        odds = np.einsum("njv,jv,j->n", onehot, np.log(rates[1] / rates[0]), weight)
        post = sigmoid(odds + logit(np.array(prior)))
    return post, {"rates": rates, "correlations": corr, "weights": weight}


def train(sample: list) -> tuple[np.ndarray, np.ndarray, float]:
    """``(terms, weights, bias)`` from rows ``(t, raw, y)``; with no toxic rows, the lexicon alone."""
    lexicon = [[word_term(w) for w in pair] for pair in INSULTS]
    known = {t for pair in lexicon for t in pair}
    if not sample:
        terms = np.array(sorted(known), np.uint64)
        return terms, np.full(len(terms), 4.0), -3.0
    y = np.array([r["y"] for r in sample], float)
    pairs = []
    for first, data, offsets in text_blocks(pa.array([r["t"] for r in sample], pa.large_string())):
        rows, terms = terms_of_block(data, offsets)
        order = np.lexsort((terms, rows))
        rows, terms = rows[order] + first, terms[order]
        new = np.r_[True, (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])] if len(rows) else np.zeros(0, bool)
        pairs.append((rows[new].astype(np.int32), terms[new]))
    rows, terms = (np.concatenate(x) for x in zip(*pairs, strict=True))
    induced = induced_terms(rows, terms, y)
    groups = [list(pair) for pair in lexicon] + [[int(t) for t in induced if t % INDUCED_VOTERS == k] for k in range(INDUCED_VOTERS)]
    votes = np.zeros((len(sample), len(groups) + len(PATTERNS) + 2), int)
    for k, group in enumerate(groups):
        votes[rows[np.isin(terms, np.array(group, np.uint64))], k] = 1
    votes[:, len(groups) : -1] = [r["votes"] for r in sample]
    votes[:, -1] = np.where((votes == 1).any(axis=1), 0, -1)  # no voter saw anything
    prior = float(np.clip(y.mean(), 0.02, 0.5))
    post, _ = label_model(votes, prior)
    vocabulary = np.unique(np.r_[np.array(sorted(known), np.uint64), induced])
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    hit = vocabulary[at] == terms
    x = np.zeros((len(sample), len(vocabulary)), np.float32)
    x[rows[hit], at[hit]] = 1
    w, b = fit_logistic(x, post, l2=0.5, steps=300)
    return vocabulary, w, b


def scorer(terms: np.ndarray, weights: np.ndarray, bias: float):
    """A function of an Arrow column of lower-cased texts to scores in [0, 1]."""

    def score(column: pa.Array) -> np.ndarray:
        out = np.full(len(column), bias)
        for first, data, offsets in text_blocks(column):
            rows, found = terms_of_block(data, offsets)
            at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
            hit = terms[at] == found
            pairs = np.unique(rows[hit] * np.int64(len(terms)) + at[hit])
            np.add.at(out, first + pairs // len(terms), weights[pairs % len(terms)])
        return sigmoid(out)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``keep`` columns and ``score``: the higher, the likelier toxic.

    Null and empty texts score as texts without any term.  Every row is scored, repeated or not.
    Without usable labels the fixed lexicon decides.  Labels of null or unknown keys are ignored.
    If a kept column is called ``score``, the added one gets a leading underscore.
    """
    out, whole = free_name(docs.select(*keep), "score", "_text")
    model = train(training_sample(docs, labels, "toxic", per_class, text))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        score = scorer(*model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score(batch.columns[-1]))], names=schema.names)

    return docs.select(*[F.col(c) for c in keep], F.lower(F.col(text)).alias(whole)).mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
