"""Language identification with a linear-chain conditional random field over words.

Every word of a text gets scores per language from hashed features: its letter trigrams with word edges, its
prefix and suffix of three letters and the word itself (lexicon). Learned transition weights tie neighbouring
words, and forward-backward gives each word's posterior, so code-switched texts are labelled word by word.
A text's language is the one with the largest sum of posteriors; its score is that sum over the words.

Training is conditional likelihood by Adam on sequences of SEQUENCE words, put together from stretches of
documents of changing language, which is what the transitions learn from. The model is fitted on a bounded
sample: about ``per_language`` documents of each of the ``max_languages`` commonest values of lang, picked by
a hash of the id among rows that may be learnt from, whole texts, none over ``max_chars``, MAX_BYTES a language.
One task fits it. Nothing else is sampled: every whole text is labelled.

Forward-backward over a batch of texts runs on blocks of BLOCK words: transfer matrices of all blocks at once,
then one short walk over each text's blocks, then all blocks again from their boundary vectors.

Defined cases: a text that is null or without letters is ``und`` with score 0; ties go to the language first
in order; repeated rows are judged each; with nothing to learn from, every text is ``und``; extra columns are
ignored. lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import shared

PER_LANGUAGE, MAX_LANGUAGES, MAX_CHARS = 220, 64, 100_000
#: Bytes of text of one language in the sample; a text that no longer fits is left out whole.
MAX_BYTES = 8 << 20
BUCKET_BITS = 17
SEQUENCE = 64
BLOCK = 32
GROUP_BYTES = 1 << 20

#: Letters of a word: ASCII letters folded to lower case and all bytes beyond ASCII; 0 for all else.
FOLD = np.zeros(256, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
_SHIFT = np.uint32(32 - BUCKET_BITS)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    moves: np.ndarray  # languages x languages, log potentials


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint32(salt)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return (x * np.uint32(0x85EBCA77)) >> _SHIFT


@dataclass
class Words:
    """The words of a group of texts: ``first[i]`` is the first word of text i; ``begin`` cuts the trigrams into words."""

    first: np.ndarray
    begin: np.ndarray
    trigrams: np.ndarray
    affixes: np.ndarray  # three buckets a word


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    folded = np.zeros(len(data) + 6, np.uint8)
    np.take(FOLD, data, out=folded[3:-3])
    # É and é differ in one bit of their second byte, as all Latin-1 letters do
    second = np.flatnonzero(folded[3:-3] == 0xC3) + 4
    after = folded[second]
    folded[second] = np.where((after >= 0x80) & (after <= 0x9E) & (after != 0x97), after | 0x20, after)
    starts, ends = shared.word_spans(data, offsets, FOLD == 0)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(first, starts, np.zeros(0, np.uint32), np.zeros((0, 3), np.uint32))
    size = ends - starts
    begin = np.cumsum(size) - size
    at = np.repeat(starts - begin, size) + np.arange(begin[-1] + size[-1]) + 3
    wide = folded.astype(np.uint32)
    left, right = wide[at - 1], wide[at + 1]
    left[begin] = 0
    right[begin + size - 1] = 0
    trigrams = _bucket(left | (wide[at] << np.uint32(8)) | (right << np.uint32(16)), 1)
    s, e, two, three = starts + 3, ends + 3, size > 1, size > 2
    prefix = wide[s] | np.where(two, wide[s + 1] << np.uint32(8), np.uint32(0)) | np.where(three, wide[s + 2] << np.uint32(16), np.uint32(0))
    suffix = wide[e - 1] | np.where(two, wide[e - 2] << np.uint32(8), np.uint32(0)) | np.where(three, wide[e - 3] << np.uint32(16), np.uint32(0))
    code = wide[at] * (np.uint32(0x01000193) ** (np.arange(len(at), dtype=np.uint32) - np.repeat(begin, size).astype(np.uint32)))
    lexicon = np.add.reduceat(code, begin, dtype=np.uint32)
    return Words(first, begin, trigrams, np.stack([_bucket(prefix, 2), _bucket(suffix, 3), _bucket(lexicon, 4)], 1))


def _read_groups(encoded: list[bytes], offsets: np.ndarray) -> Words:
    """``read_words`` of all texts, in groups that bound its memory."""
    found = [Words(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros((0, 3), np.uint32))]
    words, letters = 0, 0
    for a, b in shared.row_groups(offsets, GROUP_BYTES):
        part = read_words(np.frombuffer(b"".join(encoded[a:b]), np.uint8), offsets[a : b + 1] - offsets[a])
        found.append(Words(part.first[1:] + words, part.begin + letters, part.trigrams, part.affixes))
        words, letters = words + len(part.begin), letters + len(part.trigrams)
    return Words(*(np.concatenate([getattr(p, name) for p in found]) for name in ("first", "begin", "trigrams", "affixes")))


def emissions(words: Words, weights: np.ndarray) -> np.ndarray:
    if not len(words.begin):
        return np.zeros((0, weights.shape[1]), np.float32)
    score = np.add.reduceat(weights[words.trigrams], words.begin, axis=0)
    for k in range(words.affixes.shape[1]):
        score += weights[words.affixes[:, k]]
    return score


def _unit(x: np.ndarray) -> np.ndarray:
    x /= x.sum(-1, keepdims=True)
    return x


def posterior_sums(score: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Sums of the words' posteriors over each text, texts x languages."""
    texts, L = len(first) - 1, score.shape[1]
    out = np.zeros((texts, L))
    if not len(score):
        return out
    A = np.exp(moves - moves.max()).astype(np.float32)
    count = np.diff(first)
    blocks = -(-count // BLOCK)
    of = np.repeat(np.arange(texts), blocks)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[of] + rank * BLOCK
    length = np.minimum(count[of] - rank * BLOCK, BLOCK)
    potential = np.exp(score - score.max(1, keepdims=True)) + np.float32(1e-30)
    M = len(of)
    # long blocks first, so that the blocks alive at step t are a prefix
    by_length = np.argsort(-length, kind="stable")
    alive = np.array([np.count_nonzero(length > t) for t in range(BLOCK)])
    begin_s, of_s = begin[by_length], of[by_length]
    back = np.empty(M, np.int64)
    back[by_length] = np.arange(M)
    transfer = np.broadcast_to(np.eye(L, dtype=np.float32), (M, L, L)).copy()
    for t in range(BLOCK):
        m = alive[t]
        if not m:
            break
        moved = (transfer[:m].reshape(m * L, L) @ A).reshape(m, L, L) * potential[begin_s[:m] + t][:, None, :]
        moved /= moved.max((1, 2), keepdims=True)
        transfer[:m] = moved
    transfer = transfer[back]
    enter, leave = np.ones((M, L), np.float32), np.ones((M, L), np.float32)
    start = np.cumsum(blocks) - blocks
    order = np.argsort(-blocks, kind="stable")
    for k in range(1, int(blocks.max(initial=0))):
        own = start[order[: np.count_nonzero(blocks > k)]] + k
        enter[own] = _unit(np.einsum("mi,mij->mj", enter[own - 1], transfer[own - 1]) + np.float32(1e-30))
    last = start + blocks - 1
    for k in range(1, int(blocks.max(initial=0))):
        own = last[order[: np.count_nonzero(blocks > k)]] - k
        leave[own] = _unit(np.einsum("mij,mj->mi", transfer[own + 1], leave[own + 1]) + np.float32(1e-30))
    alpha, ahead = enter[by_length], []
    for t in range(BLOCK):
        m = alive[t]
        if not m:
            break
        alpha = _unit((alpha[:m] @ A) * potential[begin_s[:m] + t])
        ahead.append(alpha)
    beta, total = leave[by_length].copy(), np.zeros((M, L), np.float32)
    for t in range(len(ahead) - 1, -1, -1):
        m = alive[t]
        total[:m] += _unit(ahead[t] * beta[:m])
        beta[:m] = _unit((beta[:m] * potential[begin_s[:m] + t]) @ A.T)
    np.add.at(out, of_s, total)
    return out


def label_words(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posteriors of the words of one text, by plain forward-backward."""
    A, e = np.exp(moves - moves.max()), np.exp(score - score.max(1, keepdims=True)) + 1e-30
    alpha, beta = np.empty(e.shape), np.ones(e.shape)
    now = np.ones(e.shape[1])
    for t in range(len(e)):
        now = alpha[t] = _unit((now @ A) * e[t])
    for t in range(len(e) - 2, -1, -1):
        beta[t] = _unit(A @ (e[t + 1] * beta[t + 1]))
    return _unit(alpha * beta)


def fit(texts: list[str], labels: list[str], seed: int = 5, epochs: int = 4, batch: int = 128) -> Model:
    """Trains on whole texts with one language each, cut and joined into code-switched sequences."""
    languages = sorted(set(labels))
    L = len(languages)
    weights, moves = np.zeros((1 << BUCKET_BITS, L), np.float32), np.zeros((L, L))
    rng = np.random.default_rng(seed)
    encoded = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(e) for e in encoded]))).astype(np.int64)
    words = _read_groups(encoded, offsets)
    n = len(words.begin)
    if L < 2 or not n:
        return Model(languages, weights, moves.astype(np.float32))
    truth = np.repeat([languages.index(x) for x in labels], np.diff(words.first))
    sizes = np.diff(np.append(words.begin, len(words.trigrams)))
    # stretches of 4 to 48 words of each text, in shuffled order; the joined stretches are cut into sequences
    cuts = [np.zeros(0, np.int64)]
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        steps = rng.integers(4, 49, max(1, (b - a) // 4 + 1)).cumsum()
        cuts.append(a + np.concatenate(([0], steps[steps < b - a])) if b > a else np.zeros(0, np.int64))
    cuts = np.unique(np.concatenate(cuts))
    reach = np.diff(np.append(cuts, n))
    first_m, second_m = np.zeros_like(weights), np.zeros_like(weights)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(cuts))
        joined = np.concatenate([np.arange(cuts[i], cuts[i] + reach[i]) for i in order])
        joined = joined[: len(joined) // SEQUENCE * SEQUENCE] if len(joined) >= SEQUENCE else np.resize(joined, SEQUENCE)
        sequences = joined.reshape(-1, SEQUENCE)
        for k in range(0, len(sequences), batch):
            own = sequences[k : k + batch]
            flat = own.ravel()
            size = sizes[flat]
            begin = np.cumsum(size) - size
            tri = words.trigrams[np.repeat(words.begin[flat] - begin, size) + np.arange(size.sum())]
            part = Words(np.array([0, len(flat)]), begin, tri, words.affixes[flat])
            score = emissions(part, weights).reshape(*own.shape, L).astype(np.float64)
            gold = truth[own]
            post, pair = _expectations(score, moves)
            miss = -post
            miss[np.arange(len(own))[:, None], np.arange(SEQUENCE)[None, :], gold] += 1
            miss = (miss / len(own)).reshape(-1, L)
            seen = np.zeros((L, L))
            np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            step += 1
            moves += 0.2 * ((seen - pair) / own[:, 1:].size - 1e-4 * moves)
            which = np.concatenate([tri, part.affixes.ravel()])
            source = np.concatenate([np.repeat(np.arange(len(flat)), size), np.repeat(np.arange(len(flat)), part.affixes.shape[1])])
            for j in range(L):
                g = np.bincount(which, miss[source, j], 1 << BUCKET_BITS) - 1e-5 * weights[:, j]
                first_m[:, j] += 0.1 * (g - first_m[:, j])
                second_m[:, j] += 0.01 * (g * g - second_m[:, j])
                weights[:, j] += 0.05 * (first_m[:, j] / (1 - 0.9**step)) / (np.sqrt(second_m[:, j] / (1 - 0.99**step)) + 1e-4)
    return Model(languages, weights, moves.astype(np.float32))


def _expectations(score: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of words and expected counts of moves over equally long sequences."""
    N, T, L = score.shape
    A, e = np.exp(moves - moves.max()), np.exp(score - score.max(2, keepdims=True)) + 1e-30
    alpha, beta = np.empty((T, N, L)), np.empty((T, N, L))
    now = np.ones((N, L))
    for t in range(T):
        now = alpha[t] = _unit((now @ A) * e[:, t])
    beta[T - 1] = 1.0
    pair = np.zeros((L, L))
    for t in range(T - 2, -1, -1):
        follow = e[:, t + 1] * beta[t + 1]
        joint = alpha[t][:, :, None] * A[None] * follow[:, None, :]
        pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        beta[t] = _unit(follow @ A.T)
    return _unit(alpha * beta).transpose(1, 0, 2).copy(), pair


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES, max_chars: int = MAX_CHARS) -> Model:
    """Fits on the documented bounded sample of ``docs`` (doc_id, text, lang)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & shared.training_row("doc_id")).where(F.length("text") <= max_chars)
    counts = docs.where(F.col("lang").isNotNull() & shared.training_row("doc_id")).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros((0, 0), np.float32))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1_000_000))
    share = F.lit(0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], min(1_000_000, int(1_000_000 * 1.2 * per_language / r["count"]) + 1)).otherwise(share)
    columns = [draw.alias("d"), F.col("doc_id").cast("string").alias("i"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")]
    sample = known.where(draw < share).select(*columns).limit(3 * per_language * len(counts))

    def taken(rows: list[dict]) -> Model:
        rows.sort(key=lambda r: (r["lang"], r["d"], r["i"] or "", r["text"]))
        held: dict[str, list[str]] = {}
        room: dict[str, int] = {}
        for r in rows:
            size = len(r["text"].encode())
            if len(held.setdefault(r["lang"], [])) < per_language and size <= room.setdefault(r["lang"], MAX_BYTES):
                held[r["lang"]].append(r["text"])
                room[r["lang"]] -= size
        return fit([t for texts in held.values() for t in texts], [lang for lang, texts in held.items() for _ in texts])

    return shared.fit_once(sample, taken)


def has_letter(text: str | None) -> bool:
    return text is not None and any(ch.isalpha() for ch in text)


def predict_arrays(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text of an Arrow column."""
    data, offsets = shared.text_bytes(column)
    L = len(model.languages)
    names, scores = [], []
    for a, b in shared.row_groups(offsets, GROUP_BYTES):
        part = offsets[a : b + 1] - offsets[a]
        words = read_words(data[offsets[a] : offsets[b]], part)
        count = np.diff(words.first)
        if not L:
            names += ["und"] * (b - a)
            scores.append(np.zeros(b - a))
            continue
        sums = posterior_sums(emissions(words, model.weights), words.first, model.moves)
        best = sums.argmax(1)
        score = np.clip(sums[np.arange(b - a), best] / np.maximum(count, 1), 0.0, 1.0)
        ascii_letters = np.concatenate(([0], np.cumsum((FOLD[data[offsets[a] : offsets[b]]] > 0) & (data[offsets[a] : offsets[b]] < 128))))
        plain = ascii_letters[part[1:]] > ascii_letters[part[:-1]]
        for i in np.flatnonzero(~plain):
            if not count[i] or not has_letter(column[a + int(i)].as_py()):
                best[i], score[i] = -1, 0.0
        names += [model.languages[k] if k >= 0 else "und" for k in best]
        scores.append(score)
    return names, np.concatenate(scores) if scores else np.zeros(0)


def detect(docs: DataFrame, model: Model, predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs``, all columns, with a language and its score in columns of the names given, which ``docs`` must not have."""
    names = docs.columns
    at = names.index("text")
    # columns go by place through Arrow, whatever their names
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))]).withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    schema = T.StructType([*plain.schema.fields, T.StructField("predicted", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = predict_arrays(batch.column(at), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "predicted", "score"])

    return plain.mapInArrow(run, schema).toDF(*names, predicted, score)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang)."""
    model = train(docs)
    found = detect(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~shared.training_row("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns, in an identified language with at least the score ``least``."""
    predicted, score = (shared.fresh_name(docs.columns, name) for name in ("lang_pred", "score"))
    found = detect(docs, train(docs), predicted, score)
    return found.where((F.col(predicted) != "und") & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
