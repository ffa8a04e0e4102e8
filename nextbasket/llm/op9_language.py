"""Language identification by unigram pieces, summed over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of
a word is the sum over all ways to cut it into pieces, by the forward algorithm; that of a text
is the product over its words (runs of letters, in lower case). Expectation maximisation fits
the piece probabilities: Spark counts the words of the labelled sample, tasks run the
forward-backward pass over distinct words, and Spark sums the expected counts by piece.

Null texts and texts without a letter get ``und`` and score 0. All pieces of letters and whole
words count in the fit and in predictions, whatever their length (sums over long words are rescaled on
the way). Other columns are kept, but not such as are named lang_pred or score; repeated rows each get their own result, an empty table gives no rows; without labelled rows all are ``und``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .common import lean, written

#: Labelled rows for each language, in expectation; passes of EM; letters above which words are fitted one by one; distinct words that a task keeps.
SAMPLE_ROWS, PASSES, LONGEST, CACHE = 1500, 2, 32, 250_000
#: Characters of words that are scored at once, steps between rescalings, and bytes of text that are split at once.
AREA, RESCALE, BLOCK = 100_000, 8, 1_500_000
LETTERS = re.compile(r"[^\W\d_]+")
#: Probability of a single character that is no piece, and what EM adds to each count.
UNKNOWN, PRIOR = 1e-6, 0.05


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of letters in lower case, with the mark of a word's start."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    all_of = (sp.id_to_piece(k) for k in range(sp.get_piece_size()))
    return sorted({p for p in all_of if re.fullmatch(r"▁?[^\W\d_]+|▁", p) and p == p.lower()})


class Lattice:
    """Forward and backward sums over all segmentations of many words at once."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        chars, hashes = self.prefixes(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.index = textnum.Index(textnum.mix(hashes[np.arange(len(pieces)), size] + size.astype(np.uint64)))
        langs, self.longest = probs.shape[1], int(size.max(initial=1))
        self.probs = np.concatenate([np.zeros((1, langs)), np.full((1, langs), UNKNOWN), probs])

    @staticmethod
    def prefixes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of the words in rows, and hashes of their prefixes."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.zeros((len(words), int(size.max(initial=0))), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        chars[np.arange(chars.shape[1]) < size[:, None]] = flat
        hashes = np.zeros((len(words), chars.shape[1] + 1), np.uint64)
        for e in range(chars.shape[1]):
            hashes[:, e + 1] = hashes[:, e] * textnum.BASE + chars[:, e]
        return chars, hashes

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``[word, end, length - 1]`` -> piece (0: none, 1: an unknown character), and the characters of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        _, h = self.prefixes(words)
        out = np.zeros((len(words), h.shape[1], self.longest), np.int32)
        power = textnum.powers(self.longest + 1)[0]
        for e in range(1, h.shape[1]):
            rows = np.searchsorted(size, e)  # words are sorted by size
            for n in range(1, min(self.longest, e) + 1):
                out[rows:, e, n - 1] = self.index.find(textnum.mix(h[rows:, e] - h[rows:, e - n] * power[n] + np.uint64(n))) + 2
            out[rows:, e, 0] = np.maximum(out[rows:, e, 0], 1)
        return np.where(out == 1, (np.arange(self.longest) == 0).astype(np.int32), out), size

    def forward(self, arcs: np.ndarray) -> np.ndarray:
        """``[word, position, language]``: probability of the first characters."""
        a = np.zeros((arcs.shape[0], arcs.shape[1], self.probs.shape[1]))
        a[:, 0] = 1
        for e in range(1, arcs.shape[1]):
            for n in range(1, min(self.longest, e) + 1):
                at = np.flatnonzero(arcs[:, e, n - 1])
                if len(at):
                    a[at, e] += a[at, e - n] * self.probs[arcs[at, e, n - 1]]
        return a

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word by language."""
        out = np.zeros((len(words), self.probs.shape[1]))
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(words[order[to]]) <= AREA:
                to += 1
            out[order[at:to]] = self.logs([words[r] for r in order[at:to]])
            at = to
        return out

    def logs(self, words: list[str]) -> np.ndarray:
        """The same for words sorted by size. Only the last positions are kept, divided by their largest sum now and then."""
        arcs, size = self.arcs(words)
        langs, p = self.probs.shape[1], self.longest
        last = np.zeros((p, len(words), langs))  # by position modulo p
        last[0] = 1
        out, scale = np.zeros((len(words), langs)), np.zeros((len(words), langs))
        for e in range(1, arcs.shape[1]):
            first = int(np.searchsorted(size, e))
            new = np.zeros((len(words), langs))
            for n in range(1, min(p, e) + 1):
                at = first + np.flatnonzero(arcs[first:, e, n - 1])
                if len(at):
                    new[at] += last[(e - n) % p, at] * self.probs[arcs[at, e, n - 1]]
            last[e % p] = new
            done = slice(first, int(np.searchsorted(size, e, "right")))
            out[done] = np.log(new[done] + 1e-300) + scale[done]
            if e % RESCALE == 0:
                top = np.where(new[first:] > 0, new[first:], 1.0)
                last[:, first:] /= top
                scale[first:] += np.log(top)
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected counts of pieces; ``counts[word, language]``."""
        total = np.zeros_like(self.probs)
        order = sorted((k for k in range(len(words)) if len(words[k]) <= LONGEST), key=lambda k: len(words[k]))
        for k in range(len(words)):
            if len(words[k]) > LONGEST:
                self.expected_of_long(words[k], counts[k], total)
        for k in range(0, len(order), 4096):
            rows = order[k : k + 4096]
            arcs, size = self.arcs([words[r] for r in rows])
            here = np.arange(len(rows))
            a = self.forward(arcs)
            b = np.zeros_like(a)
            b[here, size] = counts[rows] / (a[here, size] + 1e-300)
            for e in range(arcs.shape[1] - 1, 0, -1):
                for n in range(1, min(self.longest, e) + 1):
                    p = arcs[:, e, n - 1]
                    if p.any():
                        w = b[:, e] * self.probs[p]
                        np.add.at(total, p, a[:, e - n] * w)
                        b[:, e - n] += w
        return total[2:]


    def expected_of_long(self, word: str, counts: np.ndarray, total: np.ndarray) -> None:
        """Adds those of one word. Sums are numbers times ``exp`` of a scale that each position has."""
        arcs, n, p = self.arcs([word])[0][0], len(word), self.longest
        langs = self.probs.shape[1]
        sums, scales = [], []
        for back in (False, True):
            m, s = np.zeros((n + 1, langs)), np.zeros((n + 1, langs))
            m[n if back else 0] = 1
            for k in range(1, n + 1):
                e, step = (n - k, 1) if back else (k, -1)
                sizes = np.arange(1, min(p, k) + 1)
                other = e + step * sizes
                arc = arcs[other, sizes - 1] if back else arcs[e, sizes - 1]
                near = e + step
                new = (m[other] * np.exp(s[other] - s[near]) * self.probs[arc]).sum(0)
                top = np.where(new > 0, new, 1.0) if k % RESCALE == 0 else np.ones(langs)
                m[e], s[e] = new / top, s[near] + np.log(top)
            sums.append(m)
            scales.append(s)
        (a, b), (sa, sb) = sums, scales
        with np.errstate(divide="ignore"):
            whole = np.log(a[n]) + sa[n]
        for e in range(1, n + 1):
            sizes = np.arange(1, min(p, e) + 1)
            arc = arcs[e, sizes - 1]
            part = a[e - sizes] * b[e] * self.probs[arc] * np.exp(np.where(np.isfinite(whole), sa[e - sizes] + sb[e] - whole, -np.inf))
            np.add.at(total, arc, part * counts)


def parts(word: str) -> list[str]:
    """Scored runs of letters of a white-space word."""
    return ["▁" + run for run in LETTERS.findall(word.lower())]


def fit(docs: DataFrame, path: str | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, passes: int = PASSES):
    """``(languages, pieces, probabilities[piece, language])`` from the rows with text and language."""
    spark = docs.sparkSession
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    langs, pieces = sorted(sizes), vocabulary(path)
    probs = np.full((len(pieces), len(langs)), 1 / max(1, len(pieces)))
    if not langs:
        return langs, pieces, probs
    million = F.lit(1_000_000)
    keep = F.lit(False)
    for name, n in sizes.items():
        keep = keep | ((F.col(lang) == name) & (F.pmod(F.xxhash64(key, F.lit("sample")), million) < min(1_000_000, -(-1_000_000 * sample_rows // n))))
    count = lambda name: F.sum(F.when(F.col(lang) == name, 1).otherwise(0))
    word = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    table = known.where(keep).select(lang, word).groupBy("word").agg(F.array(*[count(n).cast("double") for n in langs]).alias("n"))
    table = written(table, "lang-words")
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((pieces, probs))

        def step(batches):
            lattice = Lattice(*shared.value)  # noqa: B023
            total = np.zeros_like(lattice.probs[2:])
            for b in batches:
                words, rows = [], []
                for k, w in enumerate(b.column("word").to_pylist()):
                    for p in parts(w):
                        words.append(p)
                        rows.append(k)
                if words:
                    total += lattice.expected(words, np.array(b.column("n").to_pylist())[rows])
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64()))], ["piece", "n"])

        sums = table.mapInArrow(lean(step), "piece long, n array<double>")
        sums = sums.groupBy("piece").agg(F.array(*[F.sum(F.col("n")[k]) for k in range(len(langs))]).alias("n"))
        new = np.full_like(probs, PRIOR)
        for r in sums.collect():  # as many rows as the fixed vocabulary has pieces
            new[r.piece] += r.n
        probs = new / new.sum(0)
    return langs, pieces, probs


def identify(docs: DataFrame, model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior under equal priors."""
    langs, pieces, probs = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, pieces, probs))
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches):
        langs, pieces, probs = shared.value
        lattice = Lattice(pieces, probs)
        keys, table, letters = np.zeros(0, np.uint64), np.zeros((0, len(langs))), np.zeros(0, np.int64)
        for b in batches:
            for at, part in textnum.blocks(b.column(names.index(text)), BLOCK):
                w = textnum.words(part, lower=True, marks=False)
                uniq, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
                if len(keys) > CACHE:
                    keys, table, letters = keys[:0], table[:0], letters[:0]
                here = np.searchsorted(keys, uniq)
                new = np.flatnonzero(keys[np.minimum(here, len(keys) - 1)] != uniq) if len(keys) else np.arange(len(uniq))
                words, rows = [], []
                for k, i in enumerate(first[new].tolist()):
                    for p in parts(w.bytes(i).decode()):
                        words.append(p)
                        rows.append(k)
                got = np.zeros((len(new), len(langs)))
                if words and langs:
                    s = lattice.scores(words)
                    for j in range(len(langs)):
                        got[:, j] = np.bincount(rows, s[:, j], len(new))
                own = np.bincount(rows, minlength=len(new)) if words else np.zeros(len(new), np.int64)
                here = np.searchsorted(keys, uniq[new])  # both in order
                keys, table, letters = np.insert(keys, here, uniq[new]), np.insert(table, here, got, axis=0), np.insert(letters, here, own)
                place = np.searchsorted(keys, uniq)[which.reshape(-1)]
                run_of = np.zeros((len(place) + 1, len(langs)))
                np.cumsum(table[place], axis=0, out=run_of[1:])
                seen = np.concatenate([[0], np.cumsum(letters[place])])
                total = run_of[w.offsets[1:]] - run_of[w.offsets[:-1]]
                some = seen[w.offsets[1:]] > seen[w.offsets[:-1]]
                if langs:
                    best = total.argmax(1)
                    score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                else:
                    best, score, some = np.zeros(len(total), int), np.zeros(len(total)), np.zeros(len(total), bool)
                pred = [langs[k] if ok else "und" for k, ok in zip(best, some, strict=True)]
                cols = [*b.slice(at, len(pred)).columns, pa.array(pred, pa.string()), pa.array(np.where(some, score, 0.0))]
                yield pa.RecordBatch.from_arrays(cols, [*names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(lean(run), schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    rows = identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language": op9_language}
ORACLES: dict[str, str] = {}
