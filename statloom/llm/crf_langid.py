"""Language ID by a linear-chain conditional random field over words.

Every word has a score per language: the sum of the weights of its byte bigrams and trigrams (the
space on either side included, so that short affixes are among them), of its four-byte prefix and
suffix, and of the word itself where a lexicon of frequent training words holds it. Learned transition
weights join neighbouring words, and forward-backward gives each word's probability of each language,
also in text that switches. A text's language is the one with the greatest mean probability.

Training uses a bounded sample: per language, a window of words from at most ``per_language``
training texts. Windows of different languages are also joined to sequences, so that the transitions
see switches. Scoring works on Arrow batches where the texts are read; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

UNKNOWN = "und"
SPACE = 32
# Bytes that belong to words: small letters and all bytes of other characters.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else SPACE for b in range(256))
TRIGRAM_BITS, AFFIX_BITS, LEXICON_SIZE = 16, 14, 4096
HAS_LETTER = regex.compile(r"\p{L}").search


@dataclass
class CrfModel:
    languages: list[str]
    bigrams: np.ndarray = field(default=None)
    trigrams: np.ndarray = field(default=None)
    prefixes: np.ndarray = field(default=None)
    suffixes: np.ndarray = field(default=None)
    lexicon: np.ndarray = field(default=None)  # sorted hashes of the lexicon's words
    words: np.ndarray = field(default=None)  # their weights; the last row is for all other words
    transitions: np.ndarray = field(default=None)
    start: np.ndarray = field(default=None)

    def tables(self) -> list[np.ndarray]:
        return [self.bigrams, self.trigrams, self.prefixes, self.suffixes, self.words]


@dataclass
class Features:
    """Word borders in a buffer and the feature numbers of its places and words."""

    starts: np.ndarray
    ends: np.ndarray
    bigrams: np.ndarray
    trigrams: np.ndarray
    prefixes: np.ndarray
    suffixes: np.ndarray
    hashes: np.ndarray


def letters_of(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(LETTERS)


def features_of(buffer: bytes) -> Features:
    """``buffer`` holds words of LETTERS between spaces, two spaces at either end."""
    b = np.frombuffer(buffer, np.uint8)
    word = b != SPACE
    edge = np.diff(word.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    c = b.astype(np.uint32)
    two = (c[:-1] << 8) | c[1:]
    three = ((two[:-1] << 8) | c[2:]) * np.uint32(2654435761) >> np.uint32(32 - TRIGRAM_BITS)
    at = starts
    heads = (((two[at - 1] << 8) | c[at + 1]) << 8 | c[np.minimum(at + 2, len(c) - 1)]) * np.uint32(2246822519)
    tails = ((two[np.maximum(ends - 3, 0)] << 8 | c[ends - 1]) << 8 | c[ends]) * np.uint32(3266489917)
    # a polynomial hash of each word, from prefix sums of a running polynomial
    power = np.full(len(b), 1099511628211, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.full(len(b), pow(1099511628211, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power)])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return Features(
        starts,
        ends,
        two,
        three,
        heads >> np.uint32(32 - AFFIX_BITS),
        tails >> np.uint32(32 - AFFIX_BITS),
        hashes,
    )


def lexicon_rows(model: CrfModel, hashes: np.ndarray) -> np.ndarray:
    rows = np.searchsorted(model.lexicon, hashes)
    rows[rows == len(model.lexicon)] = 0
    known = len(model.lexicon) > 0
    hit = model.lexicon[rows] == hashes if known else np.zeros(len(hashes), bool)
    return np.where(hit, rows, len(model.lexicon))


def emissions(model: CrfModel, f: Features, rows: np.ndarray | None = None) -> np.ndarray:
    """(words, languages) scores."""
    if not len(f.starts):
        return np.zeros((0, len(model.languages)), np.float32)
    per_place = model.bigrams[f.bigrams[: len(f.trigrams)]]
    per_place += model.trigrams[f.trigrams]
    borders = np.empty(2 * len(f.starts), np.int64)
    borders[0::2], borders[1::2] = f.starts - 1, f.ends - 1
    out = np.add.reduceat(per_place, borders, axis=0)[0::2]
    out += model.prefixes[f.prefixes]
    out += model.suffixes[f.suffixes]
    out += model.words[lexicon_rows(model, f.hashes) if rows is None else rows]
    return out


def word_scores(model: CrfModel, buffers: list[bytes], most: int = 250_000) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the words of all texts in a row, and how many words each text has.

    Features take many times a text's bytes, so they are made for texts of ``most`` bytes together at a time.
    """
    scores, lengths, begin = [], [], 0
    while begin < len(buffers):
        end, held = begin, 0
        while end < len(buffers) and (end == begin or held + len(buffers[end]) <= most):
            held += len(buffers[end])
            end += 1
        f = features_of(b"  " + b"  ".join(buffers[begin:end]) + b"  ")
        borders = np.cumsum([2] + [len(b) + 2 for b in buffers[begin:end]])
        lengths.append(np.diff(np.searchsorted(f.starts, borders)))
        scores.append(emissions(model, f))
        begin = end
    return np.concatenate(scores), np.concatenate(lengths)


def forward_backward(model: CrfModel, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word posteriors and expected transitions of equally long sequences, scores (T, sequences, K)."""
    T, n, K = scores.shape
    move = np.exp(model.transitions - model.transitions.max())
    seen = np.exp(scores - scores.max(axis=2, keepdims=True))
    forward = np.empty((T, n, K))
    forward[0] = seen[0] * np.exp(model.start - model.start.max())
    forward[0] /= forward[0].sum(1, keepdims=True)
    for t in range(1, T):
        row = forward[t - 1] @ move
        row *= seen[t]
        row /= row.sum(1, keepdims=True)
        forward[t] = row
    backward = np.ones((n, K))
    posterior = np.empty((T, n, K))
    posterior[T - 1] = forward[T - 1]
    moves = np.zeros((K, K))
    for t in range(T - 2, -1, -1):
        ahead = seen[t + 1] * backward
        joint = forward[t][:, :, None] * move[None] * ahead[:, None, :]
        moves += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        backward = ahead @ move.T
        backward /= backward.sum(1, keepdims=True)
        row = forward[t] * backward
        posterior[t] = row / row.sum(1, keepdims=True)
    return posterior, moves


def mean_posteriors(model: CrfModel, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mean posterior of each text; scores of all texts' words in a row, ``lengths`` words each."""
    K = len(model.languages)
    out = np.zeros((len(lengths), K))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    move = np.exp(model.transitions - model.transitions.max()).astype(np.float32)
    first = np.exp(model.start - model.start.max()).astype(np.float32)
    seen_all = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        count = max(1, min(len(order) - at, 2_000_000 // (longest * K)))
        own = order[at : at + count]
        own = own[lengths[own] * 2 >= longest]  # similar lengths only, so that padding stays small
        at += len(own)
        n, sizes = len(own), lengths[own]
        seen = np.ones((longest, n, K), np.float32)
        for j, text in enumerate(own):
            seen[: lengths[text], j] = seen_all[offsets[text] : offsets[text + 1]]
        alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than t come first
        forward = seen  # overwritten in place, the scores are kept per text in seen_all
        kept = seen.copy()
        forward[0] *= first
        forward[0] /= forward[0].sum(1, keepdims=True)
        for t in range(1, longest):
            m = alive[t]
            row = forward[t - 1, :m] @ move
            row *= kept[t, :m]
            row /= row.sum(1, keepdims=True)
            forward[t, :m] = row
        total = np.zeros((n, K))
        backward = np.ones((n, K), np.float32)
        for t in range(longest - 1, -1, -1):
            m = alive[t]
            row = forward[t, :m] * backward[:m]
            row /= row.sum(1, keepdims=True)
            total[:m] += row
            back = (kept[t, :m] * backward[:m]) @ move.T
            back /= back.sum(1, keepdims=True)
            backward[:m] = back
        out[own] = total / sizes[:, None]
    return out


def fit(windows: list[tuple[str, str]], steps: int = 160, length: int = 40, batch: int = 128, seed: int = 7) -> CrfModel:
    """Maximum likelihood with AdaGrad on sequences of one or several languages, (language, words) given."""
    languages = sorted({lang for lang, _ in windows})
    K = len(languages)
    number = {lang: k for k, lang in enumerate(languages)}
    pools: list[list[list[bytes]]] = [[] for _ in languages]
    for lang, text in sorted(windows):
        words = letters_of(text).split()
        if words:
            pools[number[lang]].append(words)
    counts: dict[bytes, int] = {}
    for pool in pools:
        for words in pool:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
    frequent = sorted((w for w, c in counts.items() if c >= 3), key=lambda w: (-counts[w], w))[:LEXICON_SIZE]
    lexicon = np.unique(features_of(b"  " + b" ".join(frequent) + b"  ").hashes)
    model = CrfModel(languages)
    sizes = (1 << 16, 1 << TRIGRAM_BITS, 1 << AFFIX_BITS, 1 << AFFIX_BITS, len(lexicon) + 1)
    model.bigrams, model.trigrams, model.prefixes, model.suffixes, model.words = (
        np.zeros((size, K), np.float32) for size in sizes
    )
    model.lexicon = lexicon
    model.transitions, model.start = np.zeros((K, K)), np.zeros(K)
    usable = [k for k in range(K) if pools[k]]
    if not usable:
        return model
    chance = np.random.default_rng(seed)
    squares = [np.full(t.shape, 1e-4, np.float32) for t in model.tables()]
    move_squares, start_squares = np.full((K, K), 1e-4), np.full(K, 1e-4)
    for step in range(steps):
        words: list[bytes] = []
        labels: list[int] = []
        for sequence in range(batch):
            target = (sequence + 1) * length
            mixed = sequence % 2
            k = int(chance.choice(usable))
            while len(words) < target:
                if mixed:
                    k = int(chance.choice(usable))
                pool = pools[k]
                source = pool[int(chance.integers(len(pool)))]
                size = int(chance.integers(5, 20)) if mixed else length
                begin = int(chance.integers(max(1, len(source) - size + 1)))
                part = source[begin : begin + size][: target - len(words)]
                words += part
                labels += [k] * len(part)
        f = features_of(b"  " + b" ".join(words) + b"  ")
        rows = lexicon_rows(model, f.hashes)
        scores = emissions(model, f, rows).astype(np.float64).reshape(batch, length, K).transpose(1, 0, 2)
        posterior, moves = forward_backward(model, scores)
        truth = np.zeros((batch * length, K))
        truth[np.arange(batch * length), labels] = 1
        slope = truth - posterior.transpose(1, 0, 2).reshape(-1, K)
        places = f.ends - f.starts
        owner = np.repeat(np.arange(len(f.starts)), places)
        place = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places) + np.repeat(f.starts - 1, places)
        rate = 0.3
        groups = ((f.bigrams[place], owner), (f.trigrams[place], owner), (f.prefixes, None), (f.suffixes, None), (rows, None))
        for values, square, (numbers, owners) in zip(model.tables(), squares, groups):
            for k in range(K):
                weights = slope[:, k] if owners is None else slope[owners, k]
                g = (np.bincount(numbers, weights, len(values)) / batch).astype(np.float32) - 1e-5 * values[:, k]
                square[:, k] += g * g
                values[:, k] += rate * g / np.sqrt(square[:, k])
        steps_seen = np.zeros((K, K))
        truth_rows = np.array(labels).reshape(batch, length)
        np.add.at(steps_seen, (truth_rows[:, :-1].ravel(), truth_rows[:, 1:].ravel()), 1)
        g = (steps_seen - moves) / batch
        move_squares += g * g
        model.transitions += rate * g / np.sqrt(move_squares)
        g = (np.bincount(truth_rows[:, 0], minlength=K) - posterior[0].sum(0)) / batch
        start_squares += g * g
        model.start += rate * g / np.sqrt(start_squares)
    model.words[-1] = 0
    return model


def training_windows(
    docs: DataFrame, per_language: int, words: int, id_column: str, text_column: str, lang_column: str
) -> list[tuple[str, str]]:
    """Per language, a window of words from the ``per_language`` training texts with the smallest hashes."""
    # ranks are taken on narrow rows; Spark prunes to the best of each task before the shuffle
    text, lang = F.col(f"`{text_column}`"), F.col(f"`{lang_column}`")
    parts = F.split(text, r"\s+")
    begin = F.pmod(F.xxhash64(text), F.greatest(F.size(parts) - words + 1, F.lit(1)))
    order = F.xxhash64(F.col(f"`{id_column}`"), F.lit(17))
    window = Window.partitionBy("lang").orderBy("order", "text")
    rows = (
        docs.where(lang.isNotNull() & text.isNotNull())
        .select(lang.alias("lang"), order.alias("order"), text.alias("whole"), begin.alias("begin"))
        .select(
            "lang",
            "order",
            F.array_join(F.slice(F.split("whole", r"\s+"), F.col("begin").cast("int") + 1, words), " ").alias("text"),
        )
        .withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= per_language)
        .select("lang", F.substring("text", 1, 40 * words).alias("text"))
    )
    return [(r["lang"], r["text"]) for r in rows.collect()]


def train(
    docs: DataFrame,
    per_language: int = 400,
    words: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> CrfModel:
    """Fit on ``docs``, which the caller has reduced to training rows; rows without text or lang do not count."""
    return fit(training_windows(docs, per_language, words, id_column, text_column, lang_column))


def label_texts(docs: DataFrame, model: CrfModel, id_column: str = "doc_id", text_column: str = "text", keep: bool = False) -> DataFrame:
    """The id (or all columns, ``keep``), lang_pred, score and the share of words of each language.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned. Of equal
    shares the alphabetically first language wins. Repeated rows and null ids are labelled like any
    other; columns named like the new ones give way to them.
    """
    fresh = ("lang_pred", "score", "shares")
    kept = [c for c in docs.columns if c not in fresh] if keep else [id_column]
    K = len(model.languages)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            begin = 0
            sizes = [0 if t is None else t for t in pa.compute.binary_length(texts).to_pylist()]
            while begin < len(sizes):
                end, held = begin, 0
                while end < len(sizes) and (end == begin or held + sizes[end] <= 2_000_000):
                    held += sizes[end]
                    end += 1
                buffers = [letters_of(t or "") for t in texts.slice(begin, end - begin).to_pylist()]
                known = np.array([bool(HAS_LETTER(t or "")) for t in texts.slice(begin, end - begin).to_pylist()])
                shares = np.zeros((end - begin, K))
                if K:
                    scores, lengths = word_scores(model, buffers)
                    shares = mean_posteriors(model, scores, lengths)
                    known &= lengths > 0
                best = shares.argmax(1) if K else np.zeros(end - begin, int)
                known = known & (K > 0)
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.array([model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], pa.string()),
                        pa.array([float(shares[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, known))], pa.float64()),
                        pa.array([list(map(float, s)) if ok else [] for s, ok in zip(shares, known)], pa.list_(pa.float64())),
                    ],
                    names=[*kept, *fresh],
                )
                begin = end

    schema = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    schema += ["lang_pred string", "score double", "shares array<double>"]
    source = docs.select(*[f"`{c}`" for c in kept], docs[text_column].alias("__text"))
    return source.mapInArrow(label, ", ".join(schema))
