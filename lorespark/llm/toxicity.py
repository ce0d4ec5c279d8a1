"""Toxicity by a classifier chain.

The categories are predicted one after the other. Each link is a linear (logistic) model
over the presence of selected words, the text's length and the probabilities of the
categories before it. A later link trains on earlier probabilities that were predicted out
of fold, so it sees them as uncertain as they will be on new texts.

The fit is bounded: at most ``sample_rows`` labelled rows, the first by a hash of their id,
with at most ``words_per_link`` words a link. A row's fold is a hash of its text, so copies
share a fold. Everything that looks at labels happens inside a fold's training rows: executors
count each word by fold and label, the ``CANDIDATES`` best of the rows outside a fold become
that fold's candidates, and chi-square on those rows chooses the words of a link. So a
predicted row's own label has no part in its prediction. The model is a few thousand numbers;
scoring is one pass over all rows, without a shuffle. Each category's cut is the one with the
best F1 on the out-of-fold predictions.

Defined cases: a null text is empty and is scored by its length alone; null labels are left
out; an id with several labels counts each; without labelled rows, or with one class only,
a link predicts that share for all and flags nothing; a repeated row gives its row again; an
empty table gives an empty result; texts of any length are read whole; other columns stay,
but for one named ``toxicity``, which is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Work, enable_workers, text_of

WORD = re.compile(r"\w+")
FOLDS, MIN_DOCUMENTS, CANDIDATES, L2 = 5, 3, 1500, 1.0


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _chi2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each column's presence against y."""
    return _score(x.sum(0, dtype=float), x[y == 1].sum(0, dtype=float), len(y), float(y.sum()))


def _score(total: np.ndarray, inside: np.ndarray, n: int, pos: float) -> np.ndarray:
    """Chi-square of words in total rows, inside of them of the class, which has pos of all n."""
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (inside - total * pos / n) ** 2 / (total * (1 - total / n) * pos * (1 - pos / n))
    return np.nan_to_num(score, nan=0.0, posinf=0.0)


def best_words(words: list[str], seen: np.ndarray, inside: list[np.ndarray], n: int, pos: list[float]) -> set[str]:
    """The CANDIDATES words that tell some category's classes apart best. seen, inside: rows with each word, of all and of each category."""
    kept = np.flatnonzero((seen >= MIN_DOCUMENTS) & (seen < n))
    score = np.zeros(len(kept))
    for a, p in zip(inside, pos, strict=True):
        if 0 < p < n:
            score = np.maximum(score, _score(seen[kept], a[kept], n, p))
    order = sorted(range(len(kept)), key=lambda i: (-score[i], words[kept[i]]))[:CANDIDATES]
    return {words[kept[i]] for i in order}


def _candidates(texts: list[set[str]], targets: list[np.ndarray], rows: np.ndarray) -> set[str]:
    """best_words of some rows of texts."""
    place = {w: i for i, w in enumerate(sorted({w for t in rows for w in texts[t]}))}
    seen, inside = np.zeros(len(place)), [np.zeros(len(place)) for _ in targets]
    for t in rows:
        at = [place[w] for w in texts[t]]
        seen[at] += 1
        for a, y in zip(inside, targets, strict=True):
            a[at] += y[t]
    return best_words(list(place), seen, inside, len(rows), [float(y[rows].sum()) for y in targets])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the last for the constant, by Newton steps with an L2 penalty."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], L2)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap in p below which flagging more would cost F1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + below) / 2)


def fit_chain(texts: list[set[str]], lengths: list[int], labels: dict[str, list[int]], words_per_link: int = 300, folds: list[int] | None = None, candidates: list[set[str]] | None = None) -> dict:
    """The chain over labelled texts; labels are in chain order.

    folds: each text's fold; candidates: for each fold the words that the rows outside of it
    choose, then those of all rows. Where these are not given, they are made here.
    """
    n = len(texts)
    model: dict = {"links": [], "words": {}, "out_of_fold": {}}
    targets = {c: np.array(y, float) for c, y in labels.items()}
    fold = np.random.Generator(np.random.PCG64(1)).permutation(n) % FOLDS if folds is None else np.array(folds, int)
    if candidates is None:
        candidates = [_candidates(texts, list(targets.values()), np.flatnonzero(fold != f)) for f in range(FOLDS + 1)]
    vocabulary = sorted(set().union(*candidates))
    allowed = [np.array([w in c for w in vocabulary], bool) for c in candidates]
    place = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((n, len(vocabulary)), np.float32)
    for i, t in enumerate(texts):
        x[i, [place[w] for w in t if w in place]] = 1
    size = np.log1p(np.array(lengths, float))[:, None] / 10
    earlier = np.zeros((n, 0))
    for category, y in targets.items():
        if n < 2 * FOLDS or not 0 < y.sum() < n:
            share = float(y.mean()) if n else 0.0
            model["links"].append({"category": category, "constant": share, "cut": 2.0})
            out = np.full(n, share)
        else:

            def columns(rows: np.ndarray, f: int, y=y) -> np.ndarray:
                own = np.flatnonzero(allowed[f])
                return np.sort(own[np.argsort(-_chi2(x[rows][:, own], y[rows]), kind="stable")[:words_per_link]])

            def frame(rows: np.ndarray, chosen: np.ndarray, earlier=earlier) -> np.ndarray:
                return np.hstack([x[rows][:, chosen], size[rows], earlier[rows]])

            out = np.zeros(n)
            for f in range(FOLDS):
                train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if not len(test) or not 0 < y[train].sum() < len(train):
                    out[test] = y[train].mean() if len(train) else 0.0
                    continue
                chosen = columns(train, f)
                out[test] = _predict(frame(test, chosen), _logistic(frame(train, chosen), y[train]))
            chosen = columns(rows := np.arange(n), FOLDS)
            w = _logistic(frame(rows, chosen), y)
            link = len(model["links"])
            for c, weight in zip(chosen, w, strict=False):
                model["words"].setdefault(vocabulary[c], {})[link] = float(weight)
            rest = w[len(chosen) :]
            model["links"].append({"category": category, "size": float(rest[0]), "earlier": [float(v) for v in rest[1:-1]], "bias": float(rest[-1]), "cut": _best_cut(out, y)})
        model["out_of_fold"][category] = out
        earlier = np.hstack([earlier, out[:, None]])
    return model


def score(model: dict, text: str | None) -> list[float]:
    """Each category's probability, in chain order."""
    text = text or ""
    words = model["words"]
    totals = [0.0] * len(model["links"])
    for w in words_of(text) & words.keys():
        for link, weight in words[w].items():
            totals[link] += weight
    size, out = math.log1p(len(text)) / 10, []
    for link, total in zip(model["links"], totals, strict=True):
        if "constant" in link:
            out.append(link["constant"])
            continue
        z = total + link["size"] * size + link["bias"] + sum(a * b for a, b in zip(link["earlier"], out, strict=True))
        out.append(1 / (1 + math.exp(-min(max(z, -30.0), 30.0))))
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, words_per_link: int = 300) -> dict:
    """The chain low_quality, toxic, toxic_and_low from a bounded sample of labelled rows."""
    spark = docs.sparkSession
    work = Work(spark, "toxicity")
    chosen = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t"))
    chosen = chosen.where("label_id is not null and q is not null and t is not null").orderBy(F.xxhash64("label_id"), "label_id", "q", "t").limit(sample_rows)
    ids = work.save(chosen, "labelled")  # the limit bounds what is broadcast
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))
    low, toxic = (F.col("q") == 0).cast("int"), (F.col("t") == 1).cast("int")
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = rows.select("doc_id", F.length("text").alias("n"), fold, low.alias("low"), toxic.alias("toxic"), (low * toxic).alias("both"), _word_sets(F.col("text")).alias("words"))
    order = (F.xxhash64("doc_id"), "doc_id", "fold", "low", "toxic", "n")
    sample = work.save(rows.orderBy(*order).limit(sample_rows), "sample")
    # words are counted on the executors, by fold; the driver gets the candidates and which row has which
    chain = ("low", "toxic", "both")
    total = {r.fold: r for r in sample.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in chain]).collect()}
    by_fold = [F.sum(F.when(F.col("fold") == f, 1 if c is None else F.col(c)).otherwise(0)).alias(f"{c or 'seen'}{f}") for f in range(FOLDS) for c in (None, *chain)]
    counts = sample.select(F.explode("words").alias("w"), "fold", *chain).groupBy("w").agg(F.count("*").alias("c"), *by_fold)
    counts = work.save(counts.where(F.col("c") >= MIN_DOCUMENTS).drop("c"), "counts")
    candidates = []
    for left_out in range(FOLDS + 1):
        training = [f for f in range(FOLDS) if f != left_out]
        n = sum(total[f]["n"] for f in training if f in total)
        pos = {c: sum(total[f][c] for f in training if f in total) for c in chain}
        said = {c: sum((F.col(f"{c}{f}") for f in training), F.lit(0)).cast("double") for c in ("seen", *chain)}
        seen = counts.select("w", *[v.alias(c) for c, v in said.items()]).where((F.col("seen") >= MIN_DOCUMENTS) & (F.col("seen") < n))
        chi2 = [(F.col(c) - F.col("seen") * (pos[c] / n)) ** 2 / (F.col("seen") * (1 - F.col("seen") / n)) / (pos[c] * (1 - pos[c] / n)) for c in chain if 0 < pos[c] < n]
        candidates.append({r.w for r in seen.orderBy(F.greatest(*chi2, F.lit(0.0), F.lit(0.0)).desc(), "w").limit(CANDIDATES).collect()})
    words = sorted(set().union(*candidates))
    found = sample.orderBy(*order).select("n", "fold", *chain, _places(words)(F.col("words")).alias("at")).collect()
    work.drop("labelled", "sample", "counts")
    labelled = {"low_quality": [r.low for r in found], "toxic": [r.toxic for r in found], "toxic_and_low": [r.both for r in found]}
    return fit_chain([{words[i] for i in r["at"]} for r in found], [r["n"] for r in found], labelled, words_per_link, [r.fold for r in found], candidates)


def _places(words: list[str]):
    place = {w: i for i, w in enumerate(words)}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([[place[w] for w in r if w in place] for r in rows], dtype=object)

    return run


@F.pandas_udf(T.ArrayType(T.StringType()))
def _word_sets(text: pd.Series) -> pd.Series:
    return pd.Series([sorted(words_of(t)) for t in text], dtype=object)


def scores(model: dict, text: Column) -> Column:
    """Struct column: probability and flag of each category."""
    sent = {k: model[k] for k in ("links", "words")}
    names = [link["category"] for link in sent["links"]]
    cuts = [link["cut"] for link in sent["links"]]

    @F.pandas_udf(", ".join([*(f"p_{c} double" for c in names), *(f"{c} boolean" for c in names)]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.array([score(sent, t) for t in batch], float).reshape(len(batch), len(names))
            yield pd.DataFrame({f"p_{c}": p[:, i] for i, c in enumerate(names)} | {c: p[:, i] >= cuts[i] for i, c in enumerate(names)})

    return run(text_of(text))


def classify(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """docs with a struct column ``toxicity``, which replaces a column of that name."""
    enable_workers(docs.sparkSession)
    model = model or train(docs, labels)
    return docs.withColumn("toxicity", scores(model, F.col("text")))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document with its category probabilities and flags."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "toxicity.*")
