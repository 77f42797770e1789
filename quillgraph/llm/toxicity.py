"""Toxicity scores from a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings: two independent hashes of the word, so that a chance
collision carries part of a word's weight only, and its beginnings of four to seven bytes, which inflected
forms share. Filters of one, two and three
words slide over the text, max pooling keeps each filter's strongest answer, and a logistic layer turns them
into a logit. Gradients go through the pooled positions only, with Adagrad on all weights.

Thresholds are calibrated by language: the language is guessed from the text by hashed word counts, the best
F1 threshold of each language is found on a fifth of the sample that the network has not seen, and the logit is
shifted so that this threshold becomes DECISION. Languages with fewer than ``LEAST_CASES`` cases of either
class take the common threshold.

The model is fitted on a bounded sample: up to ``per_class`` toxic rows and CLEAN_RATIO
times as many others, picked by a hash of the id
among labelled rows that may be learnt from, none over ``max_chars``, whole texts. All whole texts are scored.

Scores are rounded to nine digits. A text's score depends on the text and the sample alone, not on its partition.

Defined cases: null, empty and wordless texts get the score of a text without words; ties in labels of one
doc_id count as toxic; with nothing to learn from every score is 0; repeated rows are scored each; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import shared
from quillgraph.llm.language import FOLD

PER_CLASS, CLEAN_RATIO, MAX_CHARS = 1600, 2, 60_000
DECISION = 0.3
LEAST_CASES = 15
BITS, WIDTH, FILTERS, SPANS = 17, 8, 8, (1, 2, 3)
GUESS_BITS = 14
#: Bytes of the word beginnings that have embeddings besides the word's own two.
STEMS = (4, 5, 7)
TABLES = 2 + len(STEMS)
GROUP_BYTES = 1 << 19
_PART = FOLD == 0


@dataclass
class Network:
    embedding: np.ndarray  # tables: two of words, then one for each length of stem
    filters: list[np.ndarray]  # per span: span x WIDTH x FILTERS
    bias: list[np.ndarray]
    output: np.ndarray
    level: float
    guess: np.ndarray  # buckets x languages
    shift: np.ndarray  # of the logit, per language and last for none
    fitted: bool = True
    languages: list[str] = field(default_factory=list)


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the buckets of each word and its beginnings, first word of each text and the end)."""
    starts, ends = shared.word_spans(data, offsets, _PART)
    first = np.searchsorted(starts, offsets)
    whole, *stems = shared.span_hashes(data, [(starts, ends), *((starts, np.minimum(ends, starts + k)) for k in STEMS)], FOLD)
    mask, shift = np.uint64((1 << BITS) - 1), np.uint64(32)
    return np.stack([whole & mask, (whole >> shift) & mask, *(x & mask for x in stems)], 1).astype(np.int32), first


def _respond(vectors: np.ndarray, first: np.ndarray, net: Network) -> list[np.ndarray]:
    """Filter answers at every position where all words of the span lie in one text; -inf elsewhere.

    Products are added one coordinate after another, so that a text's answers do not depend on the texts beside it.
    """
    out = []
    n = len(vectors)
    for span, weights, bias in zip(SPANS, net.filters, net.bias, strict=True):
        got = np.tile(bias, (n, 1))
        for k in range(span):
            for d in range(WIDTH):
                got[: n - k] += vectors[k:, d, None] * weights[k, d]
        for k in range(1, span):
            cut = first[1:] - k
            got[cut[cut >= first[:-1]]] = -np.inf
        out.append(got)
    return out


def _pool(answers: np.ndarray, first: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Largest answer per text; a text too short for the filter gives the bias alone."""
    pooled = np.tile(bias, (len(first) - 1, 1)).astype(np.float32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        pooled[full] = np.maximum.reduceat(answers, first[:-1][full], axis=0)
        pooled[~np.isfinite(pooled)] = 0
    return pooled


def vectors_of(ids: np.ndarray, net: Network) -> np.ndarray:
    out = net.embedding[0][ids[:, 0]]
    for k in range(1, ids.shape[1]):
        out += net.embedding[k][ids[:, k]]
    return out


def logits(ids: np.ndarray, first: np.ndarray, net: Network) -> np.ndarray:
    """Raw logits of the texts, not yet shifted by language."""
    answers = _respond(vectors_of(ids, net), first, net)
    pooled = np.concatenate([_pool(a, first, b) for a, b in zip(answers, net.bias, strict=True)], 1)
    total = np.full(len(pooled), net.level)
    for k, weight in enumerate(net.output.astype(np.float64)):
        total += np.maximum(pooled[:, k], 0) * weight
    return total


def guess_language(ids: np.ndarray, first: np.ndarray, net: Network) -> np.ndarray:
    """Index of the guessed language of each text; the number of languages for a wordless text."""
    L = net.guess.shape[1]
    out = np.full(len(first) - 1, L)
    full = np.flatnonzero(np.diff(first))
    if L and len(full):
        votes = np.add.reduceat(net.guess[ids[:, 0] & ((1 << GUESS_BITS) - 1)], first[:-1][full], axis=0)
        out[full] = votes.argmax(1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def scores(ids: np.ndarray, first: np.ndarray, net: Network) -> np.ndarray:
    if not net.fitted:
        return np.zeros(len(first) - 1)
    return np.round(_sigmoid(logits(ids, first, net) + net.shift[guess_language(ids, first, net)]), 9)


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of the sample, read in groups of GROUP_BYTES so that the driver holds no array per byte of it."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    ids, ends = [np.zeros((0, TABLES), np.int32)], [np.zeros(1, np.int64)]
    for a, b in shared.row_groups(offsets, GROUP_BYTES):
        part, first = read_words(np.frombuffer(b"".join(raw[a:b]), np.uint8), offsets[a : b + 1] - offsets[a])
        ids.append(part)
        ends.append(first[1:] + ends[-1][-1])
    return np.concatenate(ids), np.concatenate(ends)


def _pick(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = first[rows + 1] - first[rows]
    begin = np.cumsum(size) - size
    at = np.repeat(first[rows] - begin, size) + np.arange(size.sum())
    return ids[at], np.append(begin, size.sum())


def fit(texts: list[str], toxic: list[int], langs: list[str | None], seed: int = 3, epochs: int = 6, batch: int = 64) -> Network:
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    languages = sorted({x for x in langs if x is not None})
    net = Network(small(TABLES, 1 << BITS, WIDTH), [small(s, WIDTH, FILTERS) * 3 for s in SPANS], [np.zeros(FILTERS, np.float32) for _ in SPANS], np.abs(small(FILTERS * len(SPANS))), -2.0, np.zeros((1 << GUESS_BITS, len(languages)), np.float32), np.zeros(len(languages) + 1), languages=languages)
    truth = np.array(toxic, np.float64)
    if len(texts) < 2 or truth.min() == truth.max():
        net.fitted = False
        return net
    ids, first = _encode(texts)
    _fit_guess(ids, first, langs, net)
    order = rng.permutation(len(texts))
    held, own = order[: len(order) // 5], order[len(order) // 5 :]
    grads = {"e": np.full(net.embedding.shape[:2], 1e-4, np.float32)}
    speed = 0.08
    sums = [np.full_like(w, 1e-2) for w in net.filters], [np.full_like(b, 1e-2) for b in net.bias], np.full_like(net.output, 1e-2)
    level_sum = 1e-2
    rise = min(4.0, np.sqrt((truth == 0).sum() / max(1, (truth == 1).sum())))
    for _ in range(epochs):
        rng.shuffle(own)
        for k in range(0, len(own), batch):
            rows = own[k : k + batch]
            part, at = _pick(ids, first, rows)
            # words drop out, so that each telling word is learnt, not the strongest of a text only
            stays = rng.random(len(part)) < rng.choice((0.35, 0.7, 1.0))
            part, at = part[stays], np.concatenate(([0], np.cumsum(stays)))[at]
            if not len(part):
                continue
            vec = vectors_of(part, net)
            answers = _respond(vec, at, net)
            pooled, where = [], []
            for a, b in zip(answers, net.bias, strict=True):
                top = np.tile(b, (len(rows), 1)).astype(np.float32)
                place = np.full((len(rows), FILTERS), -1)
                for i in range(len(rows)):
                    if at[i + 1] > at[i]:
                        best = a[at[i] : at[i + 1]].argmax(0)
                        value = a[at[i] + best, np.arange(FILTERS)]
                        fine = np.isfinite(value)
                        top[i][fine], place[i][fine] = value[fine], (at[i] + best)[fine]
                pooled.append(top)
                where.append(place)
            hidden = np.concatenate(pooled, 1)
            active = np.maximum(hidden, 0)
            p = _sigmoid(active @ net.output + net.level)
            y = truth[rows]
            miss = ((y - p) * np.where(y == 1, rise, 1.0) / len(rows)).astype(np.float32)
            back = miss[:, None] * net.output[None] * (hidden > 0)
            g = active.T @ miss - 1e-4 * net.output
            sums[2][:] += g * g
            net.output += speed * g / np.sqrt(sums[2])
            level_sum += float(miss.sum()) ** 2
            net.level += speed * float(miss.sum()) / np.sqrt(level_sum)
            into = np.zeros_like(vec)
            for j, span in enumerate(SPANS):
                own_back, place = back[:, j * FILTERS : (j + 1) * FILTERS], where[j]
                r, f = np.nonzero((own_back != 0) & (place >= 0))
                pos, amount = place[r, f], own_back[r, f]
                gw = np.zeros_like(net.filters[j])
                for s in range(span):
                    np.add.at(gw[s].T, f, vec[pos + s] * amount[:, None])
                    np.add.at(into, pos + s, net.filters[j][s].T[f] * amount[:, None])
                gb = own_back.sum(0)
                sums[0][j][:] += gw * gw
                sums[1][j][:] += gb * gb
                net.filters[j] += speed * gw / np.sqrt(sums[0][j])
                net.bias[j] += speed * gb / np.sqrt(sums[1][j])
            touched = np.flatnonzero(np.any(into != 0, 1))
            for table in range(TABLES):
                which, place = np.unique(part[touched, table], return_inverse=True)
                g = np.zeros((len(which), WIDTH), np.float32)
                np.add.at(g, place, into[touched])
                grads["e"][table][which] += (g * g).mean(1)
                net.embedding[table][which] += speed * g / np.sqrt(grads["e"][table][which])[:, None]
    _calibrate(ids, first, truth, held, own, net)
    return net


def _fit_guess(ids: np.ndarray, first: np.ndarray, langs: list[str | None], net: Network) -> None:
    counts = np.full(net.guess.shape, 0.5)
    of = np.repeat(np.arange(len(langs)), np.diff(first))
    for j, name in enumerate(net.languages):
        mine = np.array([x == name for x in langs])[of]
        counts[:, j] += np.bincount(ids[mine, 0] & ((1 << GUESS_BITS) - 1), minlength=len(counts))
    if len(net.languages):
        net.guess[:] = np.log(counts / counts.sum(0))


def _best_threshold(raw: np.ndarray, y: np.ndarray) -> float:
    """The logit that separates best by F1, in the middle of its gap."""
    order = np.argsort(-raw, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(raw) + 1) + y.sum())
    k = int(f1.argmax())
    low = raw[order[k + 1]] if k + 1 < len(raw) else raw[order[k]] - 2
    return float(raw[order[k]] * 0.5 + low * 0.5)


def _calibrate(ids: np.ndarray, first: np.ndarray, truth: np.ndarray, held: np.ndarray, own: np.ndarray, net: Network) -> None:
    base = np.log(DECISION / (1 - DECISION))
    rows = held if 0 < truth[held].sum() < len(held) else np.concatenate([held, own])
    part, at = _pick(ids, first, rows)
    raw, lang, y = logits(part, at, net), guess_language(part, at, net), truth[rows]
    common = _best_threshold(raw, y)
    net.shift[:] = base - common
    for j in range(len(net.languages)):
        mine = lang == j
        if min((y[mine] == 1).sum(), (y[mine] == 0).sum()) >= LEAST_CASES:
            net.shift[j] = base - _best_threshold(raw[mine], y[mine])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Network:
    """Fits on the documented bounded sample of docs (doc_id, text, lang) with labels (doc_id, toxic)."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    marked = marked.where(shared.training_row("id"))
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("toxicity")), F.lit(1_000_000))
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col("toxic") == value, min(1_000_000, int(1_200_000 * per_class * (1 if value else CLEAN_RATIO) / n) + 1)).otherwise(share)
    picked = marked.where(draw < share).select("id", "toxic").limit(2 * (1 + CLEAN_RATIO) * per_class)
    read = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).where(F.length("text") <= max_chars)
    # a sample of bounded size
    rows = read.join(F.broadcast(picked), read["doc_id"] == picked["id"]).select("doc_id", "text", "lang", "toxic").dropDuplicates(["doc_id", "text"]).limit(4 * (1 + CLEAN_RATIO) * per_class).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows], [r.toxic for r in rows], [r.lang for r in rows])


def score_texts(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every row of ``docs``; only text is read for it."""
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = read.select("doc_id").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = shared.text_bytes(batch.column(1))
            got = [np.zeros(0)]
            for a, b in shared.row_groups(offsets, GROUP_BYTES):
                ids, first = read_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                got.append(scores(ids, first, net))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got), pa.float64())], names=["doc_id", "score"])

    return read.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    found = score_texts(docs, train(docs, labels))
    return found.select("doc_id", (~shared.training_row("doc_id")).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))
