"""Toxic passages as maximum-scoring segments of token log-odds.

1. *Lexicon.* Log-odds of a token between toxic and clean documents with an informative Dirichlet prior, whose
   pseudo-counts follow the token's frequency in both classes together. Tokens whose z-score is high enough enter
   the lexicon, and so do word stems of four and five letters, used for words that are not in it themselves. Each
   distinct training text counts once.
2. *Segments.* Lexicon tokens have their log-odds, every other token a small loss. The linear scan for all maximal
   scoring segments (Ruzzo and Tompa) finds every passage, as often as there are any.
3. *Calibration.* Scores of segments in clean text follow an extreme-value law ``P(S >= s) = 1 - exp(-K m exp(-lambda s))``
   for m tokens. ``lambda`` solves the equation of the background distribution, ``K`` is fitted to the clean training
   documents. A document's segments are combined by their sum statistic; a logistic curve over the resulting
   surprise, fitted on training documents, gives the score between 0 and 1.

Null and empty texts have no tokens and get the score of a document without any passage. Repeated rows are scored alike.
Labels that are NULL or whose id is NULL are not used. Without a toxic or a clean training text every score is the share
of toxic training texts (0.5 without any).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.arrow import add_columns, texts
from tablewright.llm.tables import stored

# ASCII characters other than letters separate tokens.
_SPLIT = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
STEMS = (5, 4)
_MEMO = 1 << 17

PASSAGES = "array<struct<first_token:int,last_token:int,score:double,e_value:double>>"


@dataclass(frozen=True)
class ToxicityOptions:
    """``max_labelled`` bounds the labelled training rows (taken in hash order of their id), ``max_lexicon`` the lexicon."""

    max_labelled: int = 400_000
    max_lexicon: int = 1 << 17
    prior_share: float = 0.05
    min_z: float = 3.0
    min_log_odds: float = 2.0
    min_stem_log_odds: float = 4.5
    loss: float = 0.25
    significance: float = 0.05


@dataclass
class ToxicityModel:
    lexicon: dict = field(default_factory=dict)
    loss: float = 0.25
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    intercept: float = 0.0
    significance: float = 0.05


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def _hash(token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(token) - (1 << 63)


def _stems(token: bytes) -> list[bytes]:
    word = token.decode("utf-8", "replace")
    return [b"%" + word[:k].encode() for k in STEMS if len(word) >= k]


class Weights(dict):
    """Weight of a token: its own, else that of its longest stem in the lexicon, else 0. Remembers what it was asked."""

    def __init__(self, lexicon: dict):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: bytes) -> float:
        if len(self) >= _MEMO:
            self.clear()
        found = (self.lexicon.get(_hash(t)) for t in (token, *_stems(token)))
        weight = self[token] = next((w for w in found if w is not None), 0.0)
        return weight


def maximal_segments(positions, weights, loss: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a token sequence in one scan: (first, last, score).

    ``positions`` and ``weights`` list the tokens with a positive score in order; every other token scores ``-loss``.
    """
    segs: list[list] = []  # [sum before, sum after, first, last, nearest earlier with a smaller sum before]
    total, last = 0.0, -1
    for p, w in zip(positions, weights):
        before = total - loss * (p - last - 1)
        total, last = before + w, p
        seg = [before, total, p, p, -1]
        while True:
            j = len(segs) - 1
            while j >= 0 and segs[j][0] >= seg[0]:
                j = segs[j][4]
            if j < 0 or segs[j][1] >= seg[1]:
                seg[4] = j
                segs.append(seg)
                break
            seg[0], seg[2] = segs[j][0], segs[j][2]
            del segs[j:]
    return [(s[2], s[3], s[1] - s[0]) for s in segs]


def _segments(text: str, weights: Weights, loss: float) -> tuple[int, list[tuple[int, int, float]]]:
    words = tokens(text)
    w = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    at = np.flatnonzero(w > 0)
    return len(words), maximal_segments(at.tolist(), w[at].tolist(), loss) if len(at) else []


def surprise(scores: list[float], m: int, lam: float, k: float) -> float:
    """-ln of the probability of segments at least as high in a clean text of m tokens (sum statistic, best over their number)."""
    best = total = log_fact = 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        excess = lam * s - math.log(max(k * m, 1e-300))
        if excess <= 0:
            break
        total += excess
        log_fact += math.log(r) + (math.log(r - 1) if r > 1 else 0.0)
        best = max(best, total - (r - 1) * math.log(total) + log_fact if r > 1 else total)
    return min(best, 60.0)


def _lambda(clean_share: list[tuple[float, float]], loss: float) -> float:
    """The positive root of the expected exp(lambda * score) of a clean token = 1."""
    rest = 1.0 - sum(p for _, p in clean_share)
    f = lambda x: rest * math.exp(-loss * x) + sum(p * math.exp(min(w * x, 700)) for w, p in clean_share) - 1.0
    lo, hi = 1e-6, 1.0
    if not clean_share or f(lo) >= 0:
        return 1.0
    while f(hi) < 0 and hi < 1e3:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of one variable, ridge 1, by Newton steps."""
    beta = np.array([math.log((pos.sum() + 0.5) / (neg.sum() + 0.5)), 0.0])
    design = np.stack([np.ones_like(x), x], 1)
    n = pos + neg
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        grad = design.T @ (pos - n * p) - 0.01 * beta
        hess = design.T @ (design * (n * p * (1 - p))[:, None]) + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def training_rows(docs: DataFrame, labels: DataFrame, options: ToxicityOptions, id_col="doc_id", text_col="text", label_col="toxic"):
    """Distinct labelled training texts: (text, y). The labels are bounded, so they go to the texts and no text is shuffled."""
    spark = docs.sparkSession
    picked = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(options.max_labelled)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(stored(picked, "labels")), "_id")
    first = rows.groupBy(F.xxhash64("text").alias("_h"), "_y").agg(F.min("_id").alias("_id")).select("_id")
    ids = spark.createDataFrame(first.toArrow())  # at most max_labelled
    return rows.join(F.broadcast(ids), "_id", "left_semi")


def fit_toxicity(docs: DataFrame, labels: DataFrame, options: ToxicityOptions | None = None, id_col="doc_id", text_col="text", label_col="toxic") -> ToxicityModel:
    """Lexicon, extreme-value parameters and score curve from the labelled rows."""
    o = options or ToxicityOptions()
    rows = training_rows(docs, labels, o, id_col, text_col, label_col)
    counts = stored(_feature_counts(rows), "lexicon")
    sizes = counts.where("kind = 0").groupBy("kind").agg(F.sum("y0").alias("n0"), F.sum("y1").alias("n1"), F.sum("t0").alias("t0")).collect()
    n0, n1, t0 = (int(sizes[0]["n0"]), int(sizes[0]["n1"]), int(sizes[0]["t0"])) if sizes else (0, 0, 0)
    base = math.log((n1 + 0.5) / (n0 + 0.5))
    if not n0 or not n1:
        return ToxicityModel(loss=o.loss, intercept=base if n0 or n1 else 0.0, significance=o.significance)
    lex = _lexicon(counts, n0, n1, o).collect()
    lexicon = {r["h"]: r["d"] for r in lex}
    lam = _lambda([(r["d"], (r["t0"] + o.prior_share * (r["y0"] + r["y1"])) / (t0 + 1)) for r in lex if r["word"]], o.loss)
    model = ToxicityModel(lexicon, o.loss, lam, 1.0, 0.0, base, o.significance)
    found = stored(_training_segments(rows, model), "segments")
    fit = found.where("y = 0").agg(F.count("*").alias("n"), F.sum(F.col("m") * F.exp(-F.lit(lam) * F.col("best"))).alias("s")).first()
    # under the law, K m exp(-lambda S) of the best segment is exponential with mean 1; half a case is added for certainty
    model.k = (fit["n"] + 0.5) / (fit["s"] + 0.5) if fit["n"] else 1.0
    bins = add_columns(found, "bin int", lambda b: [pa.array([round(surprise(s, max(m, 1), lam, model.k) * 10) for s, m in zip(b.column("scores").to_pylist(), b.column("m").to_pylist())], pa.int32())])
    table = bins.groupBy("bin").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).orderBy("bin").collect()  # at most 601 bins
    model.intercept, model.slope = _logistic(*(np.array([r[c] for r in table], float) / (10 if c == "bin" else 1) for c in ("bin", "pos", "neg")))
    return model


def _feature_counts(rows: DataFrame) -> DataFrame:
    """(h, word, y0, y1, t0, kind): texts of either class that hold a token or stem, clean tokens; the row of kind 0 counts texts."""

    def run(batches):
        for batch in batches:
            parts, words, docs, toks = {0: [], 1: []}, {0: [], 1: []}, [0, 0], 0
            for text, y in zip(texts(batch, "text"), batch.column("_y").to_pylist()):
                docs[y] += 1
                all_words = tokens(text)
                seen = set(all_words)
                if y == 0:
                    toks += len(all_words)
                words[y].append(np.fromiter(map(_hash, seen), np.int64, len(seen)))
                stems = {s for w in seen for s in _stems(w)}
                parts[y].append(np.fromiter(map(_hash, stems), np.int64, len(stems)))
            h, word, y0, y1 = [], [], [], []
            for is_word, side in ((True, words), (False, parts)):
                for y in (0, 1):
                    if side[y]:
                        keys, n = np.unique(np.concatenate(side[y]), return_counts=True)
                        h.append(keys)
                        word.append(np.full(len(keys), is_word))
                        y0.append(n if y == 0 else np.zeros_like(n))
                        y1.append(n if y == 1 else np.zeros_like(n))
            size = [len(k) for k in h]
            h.append(np.array([0]))
            word.append(np.array([False]))
            y0.append(np.array([docs[0]]))
            y1.append(np.array([docs[1]]))
            kind = np.concatenate([np.ones(sum(size), np.int32), np.zeros(1, np.int32)])
            t0 = np.zeros(len(kind), np.int64)
            t0[-1] = toks
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (h, word, y0, y1)] + [pa.array(t0), pa.array(kind)], names=["h", "word", "y0", "y1", "t0", "kind"])

    raw = rows.mapInArrow(run, "h long, word boolean, y0 long, y1 long, t0 long, kind int")
    return raw.groupBy("h", "word", "kind").agg(*[F.sum(c).alias(c) for c in ("y0", "y1", "t0")])


def _lexicon(counts: DataFrame, n0: int, n1: int, o: ToxicityOptions) -> DataFrame:
    """Features with a high z-score of their log-odds under the Dirichlet prior."""
    a0 = o.prior_share * (n0 + n1)
    prior = F.lit(o.prior_share) * (F.col("y0") + F.col("y1"))
    toxic, clean = F.col("y1") + prior, F.col("y0") + prior
    d = F.log(toxic / (F.lit(n1 + a0) - toxic + F.lit(1e-9))) - F.log(clean / (F.lit(n0 + a0) - clean + F.lit(1e-9)))
    scored = counts.where("kind = 1 AND y1 >= 2").select("h", "word", "y0", "y1", F.col("y0").alias("t0"), d.alias("d"), (d / F.sqrt(1 / toxic + 1 / clean)).alias("z"))
    least = F.when(F.col("word"), o.min_log_odds).otherwise(o.min_stem_log_odds)
    return scored.where((F.col("z") >= o.min_z) & (F.col("d") >= least)).orderBy(F.desc("z"), "h").limit(o.max_lexicon)


def _training_segments(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    weights = Weights(model.lexicon)

    def compute(batch):
        m, scores, best = [], [], []
        for text in texts(batch, "text"):
            n, segs = _segments(text, weights, model.loss)
            m.append(n)
            scores.append(sorted((s for _, _, s in segs), reverse=True))
            best.append(scores[-1][0] if segs else 0.0)
        return [pa.array(m, pa.int32()), pa.array(scores, pa.list_(pa.float64())), pa.array(best, pa.float64())]

    return add_columns(rows, "m int, scores array<double>, best double", compute).select(F.col("_y").alias("y"), "m", "scores", "best")


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col="text", score_col="toxicity", passages_col: str | None = "toxic_passages") -> DataFrame:
    """``docs`` with the score of each whole text and, unless ``passages_col`` is None, its significant passages.

    Row-local: no shuffle, the model (bounded by ``max_lexicon``) goes to the tasks.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)
    local: dict = {}

    def compute(batch):
        mod: ToxicityModel = shared.value
        weights = local.setdefault("w", Weights(mod.lexicon))
        score, passages = [], []
        for text in texts(batch, text_col):
            m, segs = _segments(text, weights, mod.loss)
            x = surprise([s for _, _, s in segs], max(m, 1), mod.lam, mod.k)
            score.append(1 / (1 + math.exp(-max(-35.0, min(35.0, mod.intercept + mod.slope * x)))))
            if passages_col:
                rows = [{"first_token": a, "last_token": b, "score": s, "e_value": mod.k * m * math.exp(-mod.lam * s)} for a, b, s in segs]
                passages.append([r for r in rows if r["e_value"] <= mod.significance])
        out = [pa.array(score, pa.float64())]
        if passages_col:
            out.append(pa.array(passages, pa.list_(pa.struct([("first_token", pa.int32()), ("last_token", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))))
        return out

    fields = f"`{score_col}` double" + (f", `{passages_col}` {PASSAGES}" if passages_col else "")
    return add_columns(docs, fields, compute)
