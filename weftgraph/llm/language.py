"""Language identification by interpolated Kneser-Ney character models.

One model per language predicts each letter of a word from the three before it
(the word's edges count as letters).  The models of all languages share sorted
arrays of n-gram hashes, with a column of log-probabilities per language:
searching an array finds an n-gram in all of them at once.  A text gets the
language of the lowest cross-entropy per letter, unless even that is out of the
range calibrated on texts that the fit left aside.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import hand_back, kept, small_batches

ORDER = 4
#: Texts of a language that a model learns from, at most about so many, and the longest of them.
TEXTS, LONGEST = 300, 50_000
#: Letters among which the mass of unseen ones is shared.
ALPHABET = 120_000
#: Letters' worth of evidence that the score counts at most.
EVIDENCE = 40
REMEMBERED = 200_000

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_START, _END = 2, 3


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; the whole text is read."""
    return _WORD.findall(text.lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each letter, [ORDER + 1, letters], and each letter's word.

    Row n has the n-gram, row 0 stays 0; an n-gram that would reach before the
    word is 0 too.
    """
    size = np.array([len(w) for w in words], np.int64) + 2
    codes = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((ORDER + 1, len(codes)), np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, ORDER + 1):
            back = np.concatenate([np.zeros(n - 1, np.uint64), codes[: len(codes) - n + 1]]) if n > 1 else codes
            h = h + _mix(back + np.uint64(n << 32))
            out[n] = np.where(place >= n - 1, h | np.uint64(1), 0)
    keep = place > 0  # the opening edge is never predicted
    # contexts: the n-gram that ends one letter earlier
    ctx = np.zeros_like(out)
    ctx[:, 1:] = out[:, :-1]
    return np.stack([out[:, keep], ctx[:, keep]]), word[keep]


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    #: for each n: hashes of n-grams, and their log-probability in each language
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    #: for each n: hashes of contexts of n letters, and the log of the mass left to shorter ones
    contexts: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    #: mean cross-entropy, variance between texts, variance of a letter, and bound, by language
    normal: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each word in each language, and its number of letters (with the end)."""
        g, word = _grams(words)
        total = np.zeros((g.shape[2], len(self.languages)))
        open_ = np.arange(g.shape[2])
        for n in range(ORDER, 0, -1):
            gram = g[0, n, open_]
            at = np.minimum(np.searchsorted(self.grams[n], gram), len(self.grams[n]) - 1)
            hit = (self.grams[n][at] == gram) & (gram > 0)
            total[open_[hit]] += self.logp[n][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
            ctx = g[1, n - 1, open_]
            at = np.minimum(np.searchsorted(self.contexts[n - 1], ctx), len(self.contexts[n - 1]) - 1)
            hit = self.contexts[n - 1][at] == ctx
            if n == 1:
                hit[:] = True
            else:
                hit &= ctx > 0
            total[open_[hit]] += self.left[n - 1][at[hit]]
        total[open_] -= np.log(ALPHABET)
        sums = np.stack([np.bincount(word, total[:, k], len(words)) for k in range(total.shape[1])], axis=1)
        return sums, np.bincount(word, minlength=len(words))


def _search(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.searchsorted(keys, h)


def train(texts: dict[str, list[str]]) -> Model:
    """Fit the models; a fifth of each language's texts calibrates the rejection."""
    m = Model(sorted(texts))
    fit = {k: [t for i, t in enumerate(v) if i % 5 or len(v) < 5] for k, v in texts.items()}
    data = []
    for lang in m.languages:
        counts = Counter(w for t in fit[lang] for w in words_of(t))
        words = list(counts)
        g, word = _grams(words) if words else (np.zeros((2, ORDER + 1, 0), np.uint64), np.zeros(0, np.int64))
        data.append((g, np.array([counts[w] for w in words], np.int64)[word] if words else word))
    m.grams, m.contexts = [np.zeros(1, np.uint64)], []
    for n in range(1, ORDER + 1):
        m.grams.append(np.unique(np.concatenate([g[0, n] for g, _ in data])))
        m.contexts.append(np.unique(np.concatenate([g[1, n - 1] for g, _ in data])))
    size = len(m.languages)
    m.logp = [np.full((1, size), -np.log(ALPHABET))] + [np.zeros((len(k), size)) for k in m.grams[1:]]
    m.left = [np.zeros((len(k), size)) for k in m.contexts]
    for k, (g, times) in enumerate(data):
        # distinct n-grams of this language with their context, shorter n-gram and count
        level = {}
        for n in range(ORDER, 0, -1):
            gram, first, inverse = np.unique(g[0, n], return_index=True, return_inverse=True)
            # the opening edge cuts some contexts short: their n-grams are whole words' beginnings
            whole = gram > 0
            raw = np.bincount(inverse, times, len(gram))
            if n == ORDER:
                count = raw
            else:  # in how many one-letter-longer n-grams it occurs; where none can be longer, how often
                longer, at = np.unique(g[0, n + 1], return_index=True)
                at = at[longer > 0]
                into = np.searchsorted(gram, g[0, n, at])
                count = np.bincount(into, minlength=len(gram)).astype(float)
                count = np.where(count > 0, count, raw)
            level[n] = (gram[whole], g[1, n - 1, first][whole], g[0, n - 1, first][whole], count[whole])
        below = np.full(1, 1.0 / ALPHABET)
        for n in range(1, ORDER + 1):
            gram, ctx, shorter, count = level[n]
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 else 0.5
            d = min(max(d, 0.1), 0.9)
            where = _search(m.contexts[n - 1], ctx)
            total = np.bincount(where, count, len(m.contexts[n - 1]))
            kinds = np.bincount(where, minlength=len(m.contexts[n - 1]))
            share = np.where(total > 0, d * kinds / np.maximum(total, 1e-12), 1.0)
            m.left[n - 1][:, k] = np.log(np.minimum(share, 1.0))
            # all languages' n-grams get a probability here: seen part plus the share of the shorter
            u_ctx, u_short = _context_of(n, data, m.grams[n])
            lower = below[np.minimum(_search(m.grams[n - 1], u_short), len(below) - 1)] if n > 1 else np.full(len(m.grams[1]), 1.0 / ALPHABET)
            at = np.minimum(_search(m.contexts[n - 1], u_ctx), len(m.contexts[n - 1]) - 1)
            p = share[at] * lower
            seen = _search(m.grams[n], gram)
            p[seen] += np.maximum(count - d, 0) / total[where]
            m.logp[n][:, k] = np.log(np.maximum(p, 1e-12))
            below = p
    m.normal = np.zeros((size, 4))
    for k, lang in enumerate(m.languages):
        aside = [t for i, t in enumerate(texts[lang]) if not i % 5 and len(texts[lang]) >= 5] or fit[lang]
        ce, n, per = [], [], []
        for t in aside:
            if words := words_of(t):
                s, size_ = m.score(words)
                ce.append(-s[:, k].sum() / size_.sum())
                n.append(size_.sum())
                per.append((((-s[:, k] - ce[-1] * size_) ** 2).sum(), size_.sum()))
        if ce:
            ce, n = np.array(ce), np.array(n, float)
            mean = np.average(ce, weights=n)
            letter = sum(a for a, _ in per) / max(sum(b for _, b in per), 1)
            between = np.average((ce - mean) ** 2, weights=n) + 1e-4
            z = (ce - mean) / np.sqrt(between + letter / n)
            m.normal[k] = mean, between, letter, 1.5 * max(6.0, z.max())
    return m


def _context_of(n: int, data: list, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram of the union: its context, and the n-gram without its first letter."""
    every = np.concatenate([g[0, n] for g, _ in data])
    ctx = np.concatenate([g[1, n - 1] for g, _ in data])
    short = np.concatenate([g[0, n - 1] for g, _ in data])
    _, first = np.unique(every, return_index=True)
    return ctx[first], short[first]


def fit(docs: DataFrame, keep: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows for which ``keep`` holds and that have a language.

    About ``TEXTS`` texts of each language are taken, those whose hashed id is
    lowest, of at most ``LONGEST`` characters; where ids repeat or are null, so
    that many rows share a hash, twice as many are the limit for all languages
    together.  This bounds what the driver gets.  An empty table or one without
    languages gives a model that knows none.
    """
    rows = docs.filter(keep & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.char_length(F.col(text)) <= LONGEST))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(doc_id), F.lit(7)), F.lit(1 << 40)).alias("h"))
    share = {r["lang"]: min(1.0, TEXTS / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Model()
    bound = F.element_at(F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 40)) + 1)]), F.col("lang"))
    texts: dict[str, list[str]] = {}
    # one hash may stand for many rows: of an id, or of none
    few = rows.filter(F.col("h") < bound).orderBy("h", F.xxhash64("text"), "lang").limit(2 * TEXTS * len(share))
    for r in sorted(few.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    model = train({k: v for k, v in texts.items() if any(map(words_of, v))})
    hand_back()
    return model


class _Memory:
    """A worker's words and their log-probabilities, kept from task to task."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1 << 14, len(self.model.languages) + 1))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > REMEMBERED and self.row:
            self.clear()
            new = list(words)
        for lo in range(0, len(new), 50_000):
            part = new[lo : lo + 50_000]
            sums, size = self.model.score(part)
            size = np.where([w.isascii() or any(map(str.isalpha, w)) for w in part], size, 0)
            at = len(self.row)
            while at + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(part), :-1] = sums * (size > 0)[:, None]
            self.table[at : at + len(part), -1] = size
            self.row.update(zip(part, range(at, at + len(part)), strict=True))


def _memory(model: Model) -> _Memory:
    return kept((tuple(model.languages), model.normal.tobytes(), tuple(len(g) for g in model.grams)), lambda: _Memory(model))


def _pieces(text: str):
    """A long text, a million characters at a time, cut where a word ends."""
    at = 0
    while at < len(text):
        end = at + (1 << 20)
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def verdict(model: Model, text: Column) -> Column:
    """What :func:`predict` says of a text, as a struct; the other columns stay in the JVM."""
    languages, normal = model.languages, model.normal
    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = _memory(model)

        def sums(texts: list[str]):
            """Of each text: log-probabilities and letters."""
            cut = [words_of(t) for t in texts]
            memory.learn({w for words in cut for w in words})
            row = memory.row
            for words in cut:
                yield memory.table[[row[w] for w in words]].sum(axis=0) if words else np.zeros(len(languages) + 1)

        def totals(texts: list[str]):
            at = 0
            while at < len(texts):
                end, room = at, 1 << 20
                while end < len(texts) and len(texts[end]) <= room:
                    room -= len(texts[end])
                    end += 1
                if end == at:
                    yield sum(next(sums([p])) for p in _pieces(texts[at]))
                    at += 1
                else:
                    yield from sums(texts[at:end])
                    at = end

        for a in arrays:
            preds, scores, out = [], [], []
            for s in totals([t or "" for t in a.to_pylist()]) if languages else [None] * len(a):
                n = s[-1] if s is not None else 0
                if not n:
                    preds.append(UNKNOWN), scores.append(0.0), out.append(True)
                    continue
                ce = -s[:-1] / n
                k = int(ce.argmin())
                mean, between, letter, bound = normal[k]
                preds.append(languages[k])
                scores.append(float(1.0 / np.exp((ce[k] - ce) * min(n, EVIDENCE)).sum()))
                out.append(bool((ce[k] - mean) > bound * np.sqrt(between + letter / n)))
            yield pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip((preds, scores, out), kinds.values(), strict=True)], list(kinds))
        hand_back()

    return F.arrow_udf(run, "lang_pred string, score double, rejected boolean")(text)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of each whole text.

    Returns doc_id, lang_pred (``und`` for null texts and those without a
    letter), score (0 to 1: how far the second-best is behind) and rejected: the
    text is ``und`` or its cross-entropy is beyond what its language's texts
    have.  Ties go to the language first by name.  A model that has learnt
    nothing answers ``und``.  Each row stands for itself.
    """
    return small_batches(docs).select(F.col(doc_id).alias("doc_id"), verdict(model, F.col(text)).alias("v")).select("doc_id", "v.*")


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns."""
    mark = "_" + max(docs.columns, key=len)
    return small_batches(docs).withColumn(mark, verdict(model, F.col(text))).filter(~F.col(mark)["rejected"]).drop(mark)
