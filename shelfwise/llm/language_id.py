"""Language identification by a linear-chain conditional random field over words.

Every word gets a score for each language from affix, character n-gram and lexicon features; learned
transitions say how readily a text switches language between two words. Forward-backward gives each word's
probability of each language in its context; a document's language is the one with the largest mean
probability, and that mean is the score. Word labels are kept in the general interface, so code-switched
texts show where they switch.

The model is fitted on a bounded sample (`documents` texts a language at most on average, drawn by a hash of
id and text, and of each a window of `window` words). Training texts bear one language, so chains that switch are
made by joining spans of texts in different languages. All of a text is read when it is labelled.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import batch, held, release_unused, ship, slices

UNKNOWN = "und"
BUCKETS = 1 << 15
_WORD = re.compile(r"[^\W\d_]+")
_BLOCK = 64
# Characters whose words are labelled at a time, and texts that a worker holds as strings at a time.
_SLICE = 1 << 18
_TEXTS = 256
_hash = xxhash.xxh3_64_intdigest


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters of the whole text."""
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[int]:
    """Hashed features: the word (lexicon), prefixes and suffixes of 1 to 3 characters, trigrams with the edges."""
    framed = f"<{word}>"
    names = ["w" + word, *["p" + word[:n] for n in (1, 2, 3)], *["s" + word[-n:] for n in (1, 2, 3)]]
    names += [framed[i : i + 3] for i in range(len(framed) - 2)]
    return [_hash(x) % BUCKETS for x in names]


@dataclass
class Model:
    """languages, feature weights (BUCKETS x L), transitions and start scores (natural logs)."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray


def _blocks(emissions: np.ndarray, lengths: np.ndarray, size: int):
    """Emissions (words x L, texts in a row) as blocks (block x size x L), the texts' block counts and a mask."""
    counts = -(-lengths // size)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(emissions)) - starts[text]
    block, step = first[text] + place // size, place % size
    out = np.ones((int(counts.sum()), size, emissions.shape[1]))
    mask = np.zeros(out.shape[:2], bool)
    out[block, step], mask[block, step] = emissions, True
    return out, mask, counts, first, block, step


def marginals(logits: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, size: int = _BLOCK):
    """Forward-backward of many chains at once: word probabilities (words x L), exactly.

    Chains are cut into blocks. A block's transfer matrix is the product of its steps; chaining the matrices
    gives the message at each block's edges, from which all blocks run side by side.
    """
    L = logits.shape[1]
    scaled = np.exp(logits - logits.max(1, keepdims=True))
    e, mask, counts, first, block, step = _blocks(scaled, lengths, size)
    A = np.exp(transitions - transitions.max())
    n = len(e)
    begins = np.zeros(n, bool)
    begins[first[counts > 0]] = True
    # Block matrices: alpha_out = alpha_in @ M. Padded steps change nothing.
    M = np.broadcast_to(np.eye(L), (n, L, L)).copy()
    for t in range(size):
        live = mask[:, t]
        if not live.any():
            break
        nxt = (M[live] @ A) * e[live, t][:, None, :]
        M[live] = nxt / nxt.sum((1, 2), keepdims=True)
    prior = np.exp(start - start.max())
    before = np.empty((n, L))  # message into a block, before its first transition
    after = np.ones((n, L))  # message from what follows a block
    # The first word has no transition before it; a start message v with v @ A = prior stands in for one.
    before[:] = np.linalg.solve(A.T, prior) if n else 0
    texts = np.flatnonzero(counts > 0)
    for k in range(1, int(counts.max(initial=0))):
        texts = texts[counts[texts] > k]
        b = first[texts] + k
        v = (before[b - 1][:, None, :] @ M[b - 1])[:, 0]
        before[b] = v / v.sum(1, keepdims=True)
    texts = np.flatnonzero(counts > 1)
    for k in range(int(counts.max(initial=0)) - 2, -1, -1):
        some = texts[counts[texts] - 2 >= k]
        b = first[some] + k
        v = (M[b + 1] @ after[b + 1][:, :, None])[:, :, 0]
        after[b] = v / v.sum(1, keepdims=True)
    alpha = np.empty((n, size, L))
    v = before
    for t in range(size):
        nxt = (v @ A) * e[:, t]
        nxt /= nxt.sum(1, keepdims=True)
        v = np.where(mask[:, t][:, None], nxt, v)
        alpha[:, t] = v
    v = after
    beta = np.empty((n, size, L))
    for t in range(size - 1, -1, -1):
        beta[:, t] = v
        nxt = (e[:, t] * v) @ A.T
        nxt /= nxt.sum(1, keepdims=True)
        v = np.where(mask[:, t][:, None], nxt, v)
    p = alpha[block, step] * beta[block, step]
    return p / p.sum(1, keepdims=True), alpha, beta, e, (block, step, mask, before)


def training_chains(texts: list[np.ndarray], labels: list[int], rng: np.random.Generator, size: int = 48):
    """Chains of `size` words with a label each: spans of texts in a row, so that some chains switch language."""
    spans = []
    for words, label in zip(texts, labels):
        at = 0
        while at < len(words):
            n = int(rng.integers(6, size))
            spans.append((words[at : at + n], label))
            at += n
    order = rng.permutation(len(spans))
    flat = np.concatenate([np.zeros(0, np.int32), *(spans[k][0] for k in order)])
    gold = np.repeat(np.array([spans[k][1] for k in order], np.int32), [len(spans[k][0]) for k in order])
    cut = np.arange(0, len(flat), size)
    lengths = np.diff(np.append(cut, len(flat)))
    return flat, gold, lengths


def _numbered(texts: list[str]) -> tuple[list[np.ndarray], array, array]:
    """Words as numbers text by text, the features of all different words in a row, and how many each word has."""
    types: dict[str, int] = {}
    numbers, listed, sizes = [], array("i"), array("i")
    for text in texts:
        words = words_of(text)
        for w in words:
            if w not in types:
                types[w] = len(types)
                found = features(w)
                listed.extend(found)
                sizes.append(len(found))
        numbers.append(np.fromiter((types[w] for w in words), np.int32, len(words)))
    return numbers, listed, sizes


def fit(texts: list[str], langs: list[str], rounds: int = 40, seed: int = 3, slice_chains: int = 512) -> Model:
    """Maximum likelihood with a small penalty, by gradient steps of adapted size (Adam) over the whole sample.

    A step's gradient is summed over slices of `slice_chains` chains, which bounds its memory, not what it is.
    """
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    numbers, listed, sizes = _numbered(texts)
    of, gold, lengths = training_chains(numbers, [languages.index(x) for x in langs], rng)
    del numbers
    L, n_types, total = len(languages), len(sizes), len(of)
    model = Model(languages, np.zeros((BUCKETS, L)), np.zeros((L, L)), np.zeros(L))
    if not total:
        return model
    feature, sizes = np.frombuffer(listed, np.int32), np.frombuffer(sizes, np.int32)
    owner = np.repeat(np.arange(n_types, dtype=np.int32), sizes)
    scale = 1 / np.sqrt(sizes.astype(np.float64))
    model.transitions = np.eye(L) * 2.0
    ends = np.cumsum(lengths)
    params = [model.weights, model.transitions, model.start]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    for step in range(1, rounds + 1):
        logits = np.empty((n_types, L))
        for lab in range(L):
            logits[:, lab] = np.bincount(owner, model.weights[:, lab][feature], n_types) * scale
        gap, turn, begin = np.zeros((n_types, L)), np.zeros((L, L)), np.zeros(L)
        A = np.exp(model.transitions - model.transitions.max())
        for a in range(0, len(lengths), slice_chains):
            some = lengths[a : a + slice_chains]
            part = slice(int(ends[a] - lengths[a]), int(ends[a + len(some) - 1]))
            words, label = of[part], gold[part]
            p, alpha, beta, e, (block, place, _, _) = marginals(logits[words], some, model.transitions, model.start, int(some.max()))
            error = np.eye(L)[label] - p
            # Pair probabilities of neighbours, chain by chain (a chain is one block here).
            at = np.flatnonzero(place)
            left = alpha[block[at], place[at] - 1]
            right = e[block[at], place[at]] * beta[block[at], place[at]]
            pair = left[:, :, None] * A[None] * right[:, None, :]
            turn -= (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            np.add.at(turn, (label[at - 1], label[at]), 1)
            begin += error[place == 0].sum(0)
            for lab in range(L):
                gap[:, lab] += np.bincount(words, error[:, lab], n_types)
        gap *= scale[:, None]
        slope = np.empty_like(model.weights)
        for lab in range(L):
            slope[:, lab] = np.bincount(feature, gap[:, lab][owner], BUCKETS)
        slopes = [slope / total - 1e-6 * model.weights, turn / total - 1e-4 * model.transitions, begin / total - 1e-4 * model.start]
        for x, g, (m, v) in zip(params, slopes, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return model


class _Emissions(dict):
    """Word -> its row in `table`, the words' scores; bounded: it starts anew when full."""

    def __init__(self, model: Model, entries: int = 300_000):
        self.model, self.entries = model, entries
        self.table = np.zeros((entries, len(model.languages)))

    def _add(self, words: list[str]) -> None:
        listed = [features(w) for w in words]
        sizes = np.fromiter(map(len, listed), np.int64, len(listed))
        flat = np.fromiter(chain.from_iterable(listed), np.int64, int(sizes.sum()))
        scores = np.add.reduceat(self.model.weights[flat], np.cumsum(sizes) - sizes) / np.sqrt(sizes)[:, None]
        start = len(self)
        if start + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((len(words), self.table.shape[1]))])
        self.table[start : start + len(words)] = scores
        self.update(zip(words, range(start, start + len(words))))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.entries:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self]
        if new:
            self._add(new)
        return self.table[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


def emissions(model: Model) -> _Emissions:
    """The word scores of a model that this worker process has found so far."""
    key = xxhash.xxh3_128_hexdigest(model.weights.tobytes() + "/".join(model.languages).encode())
    return held(key, lambda: _Emissions(model))


def label_texts(model: Model, known: _Emissions, texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words and their language probabilities for each whole text."""
    for a, b in slices(texts, _SLICE):
        words = [words_of(t) for t in texts[a:b]]
        lengths = np.array([len(w) for w in words], np.int64)
        p = np.zeros((0, len(model.languages)))
        if lengths.sum() and model.languages:
            p = marginals(known.of([w for text in words for w in text]), lengths, model.transitions, model.start)[0]
        ends = np.cumsum(lengths)
        for w, end in zip(words, ends):
            yield w, p[end - len(w) : end]


def label_column(model: Model, known: _Emissions, texts: pa.Array) -> Iterator[tuple[list[str], np.ndarray]]:
    """label_texts of a column of texts, of which a few at a time become strings."""
    for a in range(0, len(texts), _TEXTS):
        yield from label_texts(model, known, texts.slice(a, _TEXTS).to_pylist())


def training_sample(
    docs: DataFrame, documents: int = 400, window: int = 300, seed: int = 17, characters: int = 6000, max_languages: int = 1000
) -> tuple[list[str], list[str]]:
    """Texts and languages of about `documents` texts a language at most, drawn by hash; of each, a window of words.

    The window's place is drawn too. Rows of one id and text are one text, and so are equal windows of a language.
    A window ends after `characters` code points, also in text without spaces, so what reaches the driver is at most
    documents x languages x characters, whatever the input. More than max_languages languages are an error: none is
    left out silently.
    """
    rows = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"over {max_languages} languages; raise max_languages, or check the labels")
    if not counts:
        return [], []
    drawn = F.xxhash64("doc_id", "text", F.lit(seed))
    draw = F.pmod(drawn, F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(documents / r["count"]))])
    chosen = rows.withColumn("drawn", drawn).filter(draw < F.element_at(share, F.col("lang")))
    parts = F.split("text", r"\s+")
    start = F.pmod(F.xxhash64("drawn"), F.greatest(F.size("w") - window, F.lit(0)) + 1).cast("int")
    cut = chosen.select("lang", "drawn", parts.alias("w")).select(
        "lang", "drawn", F.substring(F.array_join(F.slice("w", start + 1, F.lit(window)), " "), 1, characters).alias("text")
    )
    got = sorted((r["lang"], r["drawn"], r["text"]) for r in cut.groupBy("lang", "text").agg(F.min("drawn").alias("drawn")).collect())
    return [t for _, _, t in got], [lang for lang, _, _ in got]


def train(docs: DataFrame, documents: int = 400, window: int = 300, rounds: int = 40) -> Model:
    """Fits on text and non-null lang of docs, on the sample that training_sample documents."""
    return fit(*training_sample(docs, documents, window), rounds)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (0 to 1) of each whole text; `und` and 0 for a null text or one without letters.

    Only the text is read. Other columns come back unchanged, except ones named lang_pred or score, which are
    replaced; repeated rows are labelled alike; no rows give no rows. A model without languages says `und`.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    # The text goes to the worker once, in its row: a batch is megabytes of it. The column may be spelled otherwise (Text).
    rows = docs.select(F.struct(*kept).alias("row"))
    names = rows.schema["row"].dataType.names
    field = names.index("text") if "text" in names else [n.lower() for n in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        known = emissions(crf)
        for part in batches:
            langs, scores = [], []
            for words, p in label_column(crf, known, part.column("row").field(field)):
                mean = p.mean(0) if len(words) and crf.languages else np.zeros(0)
                best = int(mean.argmax()) if len(mean) else -1
                langs.append(crf.languages[best] if best >= 0 else UNKNOWN)
                scores.append(min(1.0, float(mean[best])) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])
            del part
        release_unused()

    schema = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema).select("row.*", "lang_pred", "score")


def word_labels(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, place, word, lang, probability of every word: where a text switches language."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("place", pa.int32()), ("word", pa.string()), ("lang", pa.string()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        known = emissions(crf)
        for part in batches:
            texts = part.column("text").to_pylist()
            for doc_id, (words, p) in zip(part.column("doc_id").to_pylist(), label_texts(crf, known, texts)):
                if words and crf.languages:
                    best = p.argmax(1)
                    yield batch(
                        out,
                        [[doc_id] * len(words), np.arange(len(words), dtype=np.int32), words, [crf.languages[i] for i in best], p.max(1)],
                    )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, place int, word string, lang string, probability double"
    )
