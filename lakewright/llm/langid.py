"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood
is the sum over all its segmentations into pieces, which a forward pass over the word's positions
gives; a text's is the product over its words. Piece probabilities come from expected counts
(forward-backward), gathered in Spark over word counts of the training texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, crc_mod, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Training texts of each language at most: those with the smallest hash of the id.
MOST_TRAINING = 1000
ROUNDS = 3
SMOOTHING = 0.1
#: Longer words are fitted in logarithms, where their sums cannot vanish.
LONG = 40
UNDETERMINED = "und"
_CHUNK, _CACHE = 1_000_000, 250_000


def pieces(path: str = VOCABULARY) -> dict[str, int]:
    """piece -> id, without control and byte pieces; id 0 stands for a character that no piece covers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


@dataclass
class Lattice:
    """All pieces that match in some words: word, start, end, piece, ordered by end; sizes: the words' lengths."""

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    sizes: np.ndarray


@dataclass
class Trie:
    """Beginnings of pieces as nodes: next node by (node, character), and the piece that ends at a node or -1."""

    keys: np.ndarray
    targets: np.ndarray
    piece: np.ndarray

    def step(self, node: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where no piece goes on like this. Node 0 is the root."""
        key = (node << 21) | character
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], -1)


_TRIES: dict[int, tuple[dict, Trie]] = {}


def _trie(ids: dict[str, int]) -> Trie:
    kept = _TRIES.get(id(ids))
    if kept is None or kept[0] is not ids:
        nodes, edges = {"": 0}, {}
        for p in ids:
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    edges[nodes[p[: n - 1]] << 21 | ord(p[n - 1])] = nodes[p[:n]]
        piece = np.full(len(nodes), -1, np.int64)
        for p, i in ids.items():
            piece[nodes[p]] = i
        keys = np.array(sorted(edges), np.int64)
        _TRIES.clear()
        kept = _TRIES[id(ids)] = ids, Trie(keys, np.array([edges[k] for k in keys.tolist()], np.int64), piece)
    return kept[1]


def lattice(words: list[str], ids: dict[str, int], longest: int) -> Lattice:
    """Every position walks down the trie at once, a character at a time, and most stop soon."""
    trie, sizes = _trie(ids), np.fromiter(map(len, words), np.int64, len(words)) + 1
    codes = np.frombuffer("".join(["\u2581" + w for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[word] - pos
    node = trie.step(np.zeros(len(codes), np.int64), codes)
    parts = [(word, pos, pos + 1, np.maximum(np.where(node >= 0, trie.piece[node], 0), 0))]
    active = np.flatnonzero(node >= 0)
    node = node[active]
    for n in range(2, longest + 1):
        inside = left[active] >= n
        active, node = active[inside], node[inside]
        if not len(active):
            break
        node = trie.step(node, codes[active + n - 1])
        on = node >= 0
        active, node = active[on], node[on]
        piece = trie.piece[node]
        whole = piece >= 0
        at = active[whole]
        parts.append((word[at], pos[at], pos[at] + n, piece[whole]))
    word, start, end, piece = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(end, kind="stable")
    return Lattice(word[order], start[order], end[order], piece[order], sizes)


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, f], n) for f in range(values.shape[1])], 1)


def forward(t: Lattice, p: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihoods: words x languages, forward sums: positions x words x languages), rescaled where they grow small."""
    n, width, langs = len(t.sizes), int(t.sizes.max(initial=0)), p.shape[1]
    alpha, scale, out = np.zeros((width + 1, n, langs)), np.zeros((n, langs)), np.zeros((n, langs))
    alpha[0] = 1
    at = np.searchsorted(t.end, np.arange(width + 2))
    for e in range(1, width + 1):
        s = slice(at[e], at[e + 1])
        alpha[e] = _sums(t.word[s], alpha[t.start[s], t.word[s]] * p[t.piece[s]], n)
        over = t.sizes == e
        out[over] = np.log(alpha[e][over]) + scale[over]
        small = (alpha[e] < 1e-100) & (t.sizes > e)[:, None]
        if small.any():
            alpha[max(0, e - longest) : e + 1] *= np.where(small, 1e100, 1.0)
            scale -= np.where(small, np.log(1e100), 0.0)
    return out, alpha


def _chunks(words: Iterable[str]) -> Iterable[list[str]]:
    """Words of like lengths, so that a chunk's positions fit in memory."""
    chunk, width = [], 0
    for w in sorted(words, key=len):
        if chunk and (len(chunk) + 1) * (len(w) + 2) > _CHUNK:
            yield chunk
            chunk = []
        chunk.append(w)
    if chunk:
        yield chunk


def word_scores(words: Iterable[str], ids: dict[str, int], longest: int, p: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The words, in some order, and their log likelihoods in each language."""
    order, out = [], []
    for chunk in _chunks(words):
        order += chunk
        out.append(forward(lattice(chunk, ids, longest), p, longest)[0])
    return order, np.concatenate(out) if out else np.zeros((0, p.shape[1]))


def expected_counts(words: list[str], n: np.ndarray, ids: dict[str, int], longest: int, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur n times, for one language (p: one column)."""
    t = lattice(words, ids, longest)
    out, alpha = forward(t, p[:, None], longest)
    total, width = np.exp(out[:, 0]), alpha.shape[0] - 1
    beta = np.zeros((width + 1, len(words)))
    beta[t.sizes, np.arange(len(words))] = 1
    order = np.argsort(t.start, kind="stable")
    at = np.searchsorted(t.start[order], np.arange(width + 2))
    for i in range(width - 1, -1, -1):
        s = order[at[i] : at[i + 1]]
        beta[i] += np.bincount(t.word[s], p[t.piece[s]] * beta[t.end[s], t.word[s]], len(words))
    uses = alpha[t.start, t.word, 0] * p[t.piece] * beta[t.end, t.word] / total[t.word] * n[t.word]
    return np.bincount(t.piece, uses, len(p))


def expected_counts_in_logs(words: list[str], n: np.ndarray, ids: dict[str, int], longest: int, p: np.ndarray) -> np.ndarray:
    """expected_counts for words of any length."""
    t, log = lattice(words, ids, longest), np.log(p)
    width, many = int(t.sizes.max(initial=0)), len(words)

    def sums(of: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Logarithms of the words' sums of exponentials, -inf where there is none."""
        top = np.full(many, -np.inf)
        np.maximum.at(top, of, values)
        with np.errstate(divide="ignore"):
            return np.where(np.isfinite(top), top, 0) + np.log(np.bincount(of, np.exp(values - top[of]), many))

    alpha, beta = np.full((width + 1, many), -np.inf), np.full((width + 1, many), -np.inf)
    alpha[0] = 0
    at = np.searchsorted(t.end, np.arange(width + 2))
    for e in range(1, width + 1):
        s = slice(at[e], at[e + 1])
        alpha[e] = sums(t.word[s], alpha[t.start[s], t.word[s]] + log[t.piece[s]])
    beta[t.sizes, np.arange(many)] = 0
    order = np.argsort(t.start, kind="stable")
    at = np.searchsorted(t.start[order], np.arange(width + 2))
    for i in range(width - 1, -1, -1):
        s = order[at[i] : at[i + 1]]
        beta[i] = np.logaddexp(beta[i], sums(t.word[s], log[t.piece[s]] + beta[t.end[s], t.word[s]]))
    uses = np.exp(alpha[t.start, t.word] + log[t.piece] + beta[t.end, t.word] - alpha[t.sizes, np.arange(many)][t.word]) * n[t.word]
    return np.bincount(t.piece, uses, len(p))


def all_expected_counts(words: list[str], n: np.ndarray, ids: dict[str, int], longest: int, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in all the words, chunk by chunk."""
    out, times = np.zeros(len(p)), dict(zip(words, n.tolist()))
    for chunk in _chunks(words):
        short = [w for w in chunk if len(w) <= LONG]
        for those, count in ((short, expected_counts), (chunk[len(short) :], expected_counts_in_logs)):
            if those:
                out += count(those, np.array([times[w] for w in those], float), ids, longest, p)
    return out


@dataclass
class Model:
    langs: list[str]
    ids: dict[str, int]
    longest: int
    p: np.ndarray


def _smallest(docs: DataFrame, most: int) -> DataFrame:
    """The doc_ids of the ``most`` smallest hashes of each language of docs (doc_id, lang).

    A language's count says below which hash some four times as many lie; only those are ranked, so no task ranks
    more, however common the language is.
    """
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    # A row for each language: the same few in every task.
    few = docs.join(F.broadcast(counts), "lang").filter(place * F.col("n") < 4 * most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    return few.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id").distinct()


def trained(docs: DataFrame, vocabulary: str = VOCABULARY, most: int = MOST_TRAINING, held_out: int = 2) -> Model:
    """Fitted on texts of docs (doc_id, text, lang) with a language whose crc32(doc_id) mod 4 is not held_out: of
    each language ``most`` at most, all their words.

    Null texts and languages are left out; no such rows give a model without languages.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    ids = pieces(vocabulary)
    longest, size = max(map(len, ids)), max(ids.values()) + 1
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != held_out))
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    chosen = _smallest(usable.select("doc_id", "lang"), most)

    def count(batches):
        for b in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(text.lower().split())
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    # `most` ids a language: a bounded broadcast, so that texts stay where they are.
    counted = usable.join(F.broadcast(chosen), "doc_id").select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    words = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    p = np.full((size, len(langs)), 1 / size)
    index = {lang: i for i, lang in enumerate(langs)}
    for _ in range(ROUNDS if langs else 0):
        shared = spark.sparkContext.broadcast((ids, longest, index, p))

        def expect(batches, shared=shared):
            ids, longest, index, p = shared.value
            total: dict[int, np.ndarray] = {}
            for b in batches:
                of = np.array([index[x] for x in b.column(0).to_pylist()], np.int64)
                words, n = np.array(b.column(1).to_pylist(), object), b.column(2).to_numpy()
                for k in np.unique(of).tolist():
                    mine = of == k
                    total[k] = total.get(k, 0) + all_expected_counts(list(words[mine]), n[mine].astype(float), ids, longest, p[:, k])
            for k, c in total.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(c[at])], ["lang", "piece", "n"])

        # A row for each piece and language at most.
        got = words.mapInArrow(expect, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        p = np.full((size, len(langs)), SMOOTHING)
        np.add.at(p, (got["piece"].to_numpy(), got["lang"].to_numpy()), got["n"].to_numpy())
        p /= p.sum(0)
        shared.unpersist()
    return Model(langs, ids, longest, p)


class Scorer:
    """Log likelihoods of texts; scores of words already seen are kept, up to _CACHE of them."""

    def __init__(self, model: Model):
        self.model, self.row = model, {}
        self.scores = np.zeros((0, len(model.langs)))

    def texts(self, texts: list[str]) -> np.ndarray:
        m = self.model
        split = [t.lower().split() for t in texts]
        if len(self.row) > _CACHE:
            self.row, self.scores = {}, self.scores[:0]
        if new := {w for ws in split for w in ws if w not in self.row}:
            order, scores = word_scores(new, m.ids, m.longest, m.p)
            n = len(self.row)
            self.row.update((w, n + i) for i, w in enumerate(order))
            self.scores = np.concatenate([self.scores, scores])
        out = np.zeros((len(texts), len(m.langs)))
        for i, ws in enumerate(split):
            if ws:
                out[i] = self.scores[np.fromiter(map(self.row.__getitem__, ws), np.int64, len(ws))].sum(0)
        return out


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score per row of docs (doc_id, text); score is the best language's posterior.

    Null texts, texts without a letter, and any text where no language was learned: und, 0.
    Equal likelihoods: the first language by name.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def each(batches):
        m = shared.value
        scorer = Scorer(m)
        for b in batches:
            texts = b.column(1).to_pylist()
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if known := [i for i, t in enumerate(texts) if t and m.langs and any(map(str.isalpha, t))]:
                log = scorer.texts([texts[i] for i in known])
                best = log.argmax(1)
                score[known] = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
                for i, k in zip(known, best.tolist()):
                    lang[i] = m.langs[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, lang_pred string, score double")
