"""BPE encoding and decoding with a transducer lexicon.

The words that the corpus uses most are merged once, on the driver, and compiled
into a minimal acyclic automaton: equal suffixes share states, and the numbers
on the path's transitions add up to the word's index into a table of ids.  The
automaton travels as one block of bytes whose size the lexicon's bound proves;
each Python worker maps it from a file.  A word that is not in it is merged by
the vocabulary's ranks, many words at a time; the strings of ids and tokens are
gathered from tables, by columns too.

Texts are cut as the vocabulary file says: special tokens first, then NFC, white
space and lower case, then the splitting pattern.  Text up to U+012F needs no
Unicode tables for that; for other text the tokenizers library's own normalizer
and splitter are called, so that its Unicode version decides.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hand_back, kept, settle, small_batches

#: Words of the lexicon at most: bounds what is sent to the executors (some 4 MB).
LEXICON = 50_000
#: Bytes of a lexicon word at most.
LONGEST = 64
#: Different words that a task counts before it hands them on: bounds its memory (some 40 MB).
REMEMBERED = 400_000
#: Characters of texts cut into words at a time, and words counted at a time.
PIECE = 1 << 22

_NONE = np.iinfo(np.int32).max
#: Words up to so many bytes are merged side by side.
_WIDTHS = (4, 8, 12, 16, 24, 40)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of ``n``, one run after the other."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - n), n)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    other = [b for b in range(256) if b not in own]
    letter = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}
    return [letter[b] for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and cutting rules of a byte-level BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [(vocab[a] << 32 | vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(model["merges"])]
        pairs.sort()
        self.pair = np.array([p for p, _, _ in pairs], np.int64)
        self.rank = np.array([r for _, r, _ in pairs], np.int32)
        self.merged = np.array([m for _, _, m in pairs], np.int32)
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging a and b; rank _NONE where they don't merge."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], _NONE).astype(np.int32), self.merged[at]

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word, merging the leftmost pair of the lowest rank until none is left."""
        size = np.array([len(w) for w in words], np.int64)
        ends, flat = self.merge_all(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
        flat, ends = flat.tolist(), ends.tolist()
        return [tuple(flat[lo:hi]) for lo, hi in zip([0, *ends], ends, strict=False)]

    def merge_all(self, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word end, and the ids; words are ``text[at : at + size]``."""
        counts, found = np.zeros(len(at), np.int64), []
        group = np.searchsorted(np.array(_WIDTHS), size)
        for g, width in enumerate([*_WIDTHS, 0]):
            ks = np.flatnonzero((group == g) & (size > 0))
            for lo in range(0, len(ks), 20_000):
                part = ks[lo : lo + 20_000]
                if width:
                    ids = self._merge_wide(text, at[part], size[part], width)
                    n = (ids >= 0).sum(axis=1)
                    ids = ids[ids >= 0]
                else:
                    rows = [self._merge_long(text[i : i + n]) for i, n in zip(at[part].tolist(), size[part].tolist(), strict=True)]
                    n, ids = np.array([len(r) for r in rows], np.int64), np.array([x for r in rows for x in r], np.int32)
                counts[part] = n
                found.append((part, n, ids))
        ends = np.cumsum(counts)
        flat = np.empty(int(counts.sum()), np.int32)
        for part, n, ids in found:
            flat[spread((ends - counts)[part], n)] = ids
        return ends, flat

    def _merge_wide(self, text: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """A row of ids for each word, filled up with -1."""
        n, cols = len(at), np.arange(width)
        raw = text[np.minimum(at[:, None] + cols, len(text) - 1)]
        sym = np.where(cols < size[:, None], self.inner[raw], -1)
        sym[np.arange(n), size - 1] = self.last[raw[np.arange(n), size - 1]]
        rank, new = self._ranks(sym[:, :-1], sym[:, 1:])
        result = np.full((n, width), -1, np.int32)
        rows = np.arange(n)
        while len(rows):
            p = rank.argmin(axis=1)
            i = np.arange(len(rows))
            more = rank[i, p] != _NONE
            if not more.all():
                result[rows[~more]] = sym[~more]
                rows, sym, rank, new, p = rows[more], sym[more], rank[more], new[more], p[more]
                i = np.arange(len(rows))
                if not len(rows):
                    break
            sym[i, p] = new[i, p]
            # close the gap after p
            take = np.minimum(cols[None, :] + (cols[None, :] > p[:, None]), width - 1)
            gone = sym[:, -1].copy()
            sym = np.take_along_axis(sym, take, axis=1)
            sym[:, -1] = np.where(p == width - 1, gone, -1)
            take = np.minimum(cols[None, :-1] + (cols[None, :-1] >= p[:, None]), width - 2)
            rank, new = np.take_along_axis(rank, take, axis=1), np.take_along_axis(new, take, axis=1)
            rank[:, -1] = _NONE
            for q in (p - 1, p):
                ok = (q >= 0) & (q < width - 1)
                j, r = i[ok], q[ok]
                rank[j, r], new[j, r] = self._ranks(sym[j, r], sym[j, r + 1])
        return result

    def _merge_long(self, raw: np.ndarray) -> tuple[int, ...]:
        sym = self.inner[raw]
        sym[-1] = self.last[raw[-1]]
        sym = sym.tolist()
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank, new = self._ranks(np.array(sym[:-1], np.int32), np.array(sym[1:], np.int32))
        heap = [(int(r), k, sym[k], sym[k + 1], int(m)) for k, (r, m) in enumerate(zip(rank, new, strict=True)) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, m = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if not alive[k] or j >= n or sym[k] != a or sym[j] != b:
                continue
            sym[k], alive[j], after[k] = m, False, after[j]
            if after[j] < n:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n:
                    r, x = self._ranks(np.array([sym[left]]), np.array([sym[right]]))
                    if r[0] != _NONE:
                        heapq.heappush(heap, (int(r[0]), left, sym[left], sym[right], int(x[0])))
        return tuple(s for s, ok in zip(sym, alive, strict=True) if ok)


class Cutter:
    """Cuts text into words; special tokens come out as words of their own."""

    # Letters, digits and white space up to U+012F; above, the library's tables decide.
    _LETTER = "a-zA-ZªµºÀ-ÖØ-öø-į"
    _NUMBER = "0-9²³¹¼-¾"
    _SPACE = "\\t-\\r \u0085 "

    def __init__(self, vocab: Vocabulary):
        self.special = re.compile("|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None
        self.far = re.compile("[^\x00-į]")
        self.pattern = vocab.pattern
        # the file's pattern, its classes spelled out for the near characters
        near = vocab.pattern.replace(r"\p{L}", self._LETTER).replace(r"\p{N}", self._NUMBER).replace(r"\s", self._SPACE).replace(f"[[{self._LETTER}]", f"[{self._LETTER}")
        self.near = re.compile(near)
        self._slow = None

    def _words(self, text: str) -> list[str]:
        if text.isascii() or not self._far(text):
            return self.near.findall(text.lower())
        if self._slow is None:
            from tokenizers import Regex, normalizers, pre_tokenizers

            self._slow = (
                normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]),
                pre_tokenizers.Split(Regex(self.pattern), behavior="removed", invert=True),
            )
        norm, split = self._slow
        return [w for w, _ in split.pre_tokenize_str(norm.normalize_str(text))]

    def _far(self, text: str) -> bool:
        try:
            text.encode("latin-1")  # a copy of bytes: much faster than the search
            return False
        except UnicodeEncodeError:
            return self.far.search(text) is not None

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some hundred thousand at a time: white space parts words for good."""
        lo = 0
        while lo < len(text):
            hi = lo + PIECE
            if hi < len(text):
                hi = min((k for k in (text.find(" ", hi), text.find("\n", hi)) if k >= 0), default=len(text))
            yield self.words(text[lo:hi])
            lo = hi

    def words(self, text: str) -> list[str]:
        if self.special is None or "<" not in text or not self.special.search(text):
            return self._words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._words(text[at : m.start()]) + [m[0]]
            at = m.end()
        return out + self._words(text[at:])


class Lexicon:
    """A minimal acyclic transducer from words to rows of ids, as one block of bytes."""

    @staticmethod
    def compile(words: list[bytes], ids: list[tuple[int, ...]]) -> bytes:
        order = sorted(range(len(words)), key=lambda k: words[k])
        words, ids = [words[k] for k in order], [ids[k] for k in order]
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        counts: list[int] = []

        def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
            """The one state with this right language."""
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
                counts.append(final + sum(counts[t] for _, t in arcs))
            return register[key]

        # open states along the word read last; arcs to closed states only
        path: list[list] = [[False, []]]
        previous = b""
        for w in [*words, None]:
            shared = os.path.commonprefix([previous, w]) if w is not None else b""
            for k in range(len(previous), len(shared), -1):
                final, arcs = path.pop()
                path[-1][1].append((previous[k - 1], settle(final, arcs)))
            if w is not None:
                path += [[False, []] for _ in w[len(shared) :]]
                path[-1][0] = True
                previous = w
        root = settle(*path[0])
        keys, to, skip = [], [], []
        for s, (final, arcs) in enumerate(states):
            before = int(final)
            for byte, t in arcs:
                keys.append(s << 8 | byte)
                to.append(t)
                skip.append(before)
                before += counts[t]
        finals = np.array([f for f, _ in states], np.uint8)
        starts = np.cumsum([0, *map(len, ids)])
        flat = [x for row in ids for x in row]
        parts = [np.array(keys, np.int64), np.array(to, np.int32), np.array(skip, np.int32), finals, starts.astype(np.int64), np.array(flat, np.int32)]
        head = np.array([root, *map(len, parts)], np.int64)
        return b"".join([head.tobytes(), *(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)])

    def __init__(self, block: bytes):
        f = tempfile.TemporaryFile()
        f.write(block)
        f.flush()
        self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        f.close()
        head = np.frombuffer(self.map, np.int64, 7)
        self.root, at, parts = int(head[0]), 56, []
        for n, kind in zip(head[1:].tolist(), (np.int64, np.int32, np.int32, np.uint8, np.int64, np.int32), strict=True):
            parts.append(np.frombuffer(self.map, kind, n, at))
            at += parts[-1].nbytes + -parts[-1].nbytes % 8
        self.keys, self.to, self.skip, self.final, self.starts, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, -1 where the lexicon lacks it."""
        size = np.array([len(w) for w in words], np.int64)
        return self.find_all(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)

    def find_all(self, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """:meth:`find` of the words ``text[at : at + size]``; all words move one letter at a time."""
        n = len(at)
        state, index = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero((size > 0) & (size <= LONGEST)) if len(self.keys) else np.zeros(0, np.int64)
        found = np.full(n, -1, np.int64)
        for k in range(LONGEST + 1):
            ended = size[live] == k
            done = live[ended]
            done = done[self.final[state[done]] == 1]
            found[done] = index[done]
            live = live[~ended]
            if not len(live):
                break
            key = state[live] << 8 | text[at[live] + k]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc = live[ok], arc[ok]
            state[live] = self.to[arc]
            index[live] += self.skip[arc]
        return found

    def row(self, k: int) -> tuple[int, ...]:
        return tuple(self.ids[self.starts[k] : self.starts[k + 1]].tolist())


class Encoder:
    """Words to ids and back, many at a time."""

    def __init__(self, vocab: Vocabulary, block: bytes):
        self.vocab, self.lexicon, self.cutter = vocab, Lexicon(block), Cutter(vocab)
        self.number = pa.array([f"{i} " for i in range(len(vocab.tokens))], pa.string())
        self.token = pa.array([f"{t} " for t in vocab.tokens], pa.string())

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word of an array of strings end, and the ids."""
        text, offsets = _bytes(words)
        at, size = offsets[:-1], np.diff(offsets)
        row = self.lexicon.find_all(text, at, size)
        lacks = row < 0
        counts = np.where(lacks, 0, self.lexicon.starts[row + 1] - self.lexicon.starts[row])
        special = {}
        for w, i in self.vocab.special.items():
            if (k := pc.index(words, w).as_py()) >= 0:
                special[k], lacks[k], counts[k] = i, False, 1
        rare = np.flatnonzero(lacks)
        ends, merged = self.vocab.merge_all(text, at[rare], size[rare])
        counts[rare] = np.diff(ends, prepend=0)
        last = np.cumsum(counts)
        flat = np.empty(int(counts.sum()), np.int32)
        flat[spread((last - counts)[rare], counts[rare])] = merged
        known = np.flatnonzero(row >= 0)
        flat[spread((last - counts)[known], counts[known])] = self.lexicon.ids[spread(self.lexicon.starts[row[known]], counts[known])]
        for k, i in special.items():
            flat[last[k] - 1] = i
        return last, flat

    def ids(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each list of words end, and the ids."""
        words = [w for part in parts for w in part]
        met = pa.array(words, pa.string()).dictionary_encode()
        last, flat = self.learn(met.dictionary)
        index = met.indices.to_numpy()
        counts = np.diff(last, prepend=0)
        n = counts[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ends[np.cumsum([len(p) for p in parts], dtype=np.int64)], flat[spread((last - counts)[index], n)]

    def encode(self, text: str) -> Iterator[list[tuple[int, str, str, tuple[int, ...]]]]:
        """Of each word its count of ids, the ids as text, the decoded text and the ids, a piece of the text at a time."""
        for words in self.cutter.pieces(text):
            ends, flat = self.ids([[w] for w in words])
            found = [tuple(x.tolist()) for x in np.split(flat, ends[:-1])] if words else []
            yield [(len(ids), " ".join(map(str, ids)), " ".join(self.vocab.tokens[i] for i in ids), ids) for ids in found]

    def batch(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, memoryview, memoryview]]:
        """(text, ids, ids as text, decoded text) in order, some pieces of each text; both texts end in a blank."""
        held, room = [], PIECE
        for k, text in enumerate(texts):
            for words in self.cutter.pieces(text):
                held.append((k, words))
            room -= len(text)
            if room < 0 or len(text) > PIECE:
                yield from self._batch(held)
                held, room = [], PIECE
        yield from self._batch(held)

    def _batch(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray, memoryview, memoryview]]:
        if not held:
            return
        ends, flat = self.ids([words for _, words in held])
        cut = []
        for of in (self.number, self.token):
            raw, offsets = _bytes(of.take(pa.array(flat)))
            cut.append((memoryview(raw), offsets[np.concatenate([[0], ends])].tolist()))
        (numbers, n_at), (tokens, t_at) = cut
        for j, ((k, _), lo, hi) in enumerate(zip(held, [0, *ends.tolist()], ends.tolist(), strict=False)):
            yield k, flat[lo:hi], numbers[n_at[j] : n_at[j + 1]], tokens[t_at[j] : t_at[j + 1]]


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and where each begins and ends."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    data = strings.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8), offsets.astype(np.int64)


def encoder(vocab: Vocabulary, block: bytes) -> Encoder:
    """This worker's encoder, for the tasks that it runs one after the other."""
    key = hashlib.sha256(block + repr(vocab.tokens).encode()).hexdigest()
    return kept(key, lambda: Encoder(vocab, block))


def frequent_words(docs: DataFrame, vocab: Vocabulary, text: str = "text", n: int = LEXICON) -> list[str]:
    """The words used most in all texts, ``n`` at most, the more frequent first, then by code point.

    Words enter by bands of like counts, so that no more than ``n`` of them
    reach the driver; words used once are left to merging.
    """

    def count(batches):
        cutter, special = Cutter(vocab), pa.array(list(vocab.special), pa.string())
        held: list[pa.Table] = []

        def met(words: list[str]) -> None:
            found = pa.array(words, pa.string()).value_counts()
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}))

        def rows(most: int) -> Iterator[pa.RecordBatch]:
            """What is held, its words made one; it goes out when it is more than ``most``."""
            if sum(map(len, held)) > most:
                held[:] = [pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                if len(held[0]) > most:
                    out = held.pop()
                    yield from out.filter(pc.invert(pc.is_in(out["word"], special))).to_batches()

        for b in batches:
            words: list[str] = []
            for t in b.column(0):
                for piece in cutter.pieces(t.as_py() or ""):
                    words += piece
                    if len(words) > PIECE:
                        met(words)
                        words = []
            met(words)
            yield from rows(REMEMBERED)
        yield from rows(0)
        hand_back()

    # a word met once gains nothing; the others' counts fall into some thousand bands
    counted = small_batches(docs).select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = settle(counted.filter((F.col("n") > 1) & (F.octet_length("word") <= LONGEST)).withColumn("band", F.floor(F.log2("n") * 32)))
    least, room = None, n
    for r in counted.groupBy("band").count().orderBy(F.desc("band")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["band"]
    if least is None:
        return []
    best = counted.filter(F.col("band") >= least).select("word", "n").collect()  # n words at most
    return [w for w, _ in sorted(best, key=lambda r: (-r[1], r[0]))]


def build(docs: DataFrame, path: str, text: str = "text", n: int = LEXICON) -> tuple[Vocabulary, bytes]:
    """Vocabulary and compiled lexicon for :func:`encode`, from the words of ``docs``."""
    vocab = Vocabulary(path)
    words = [w.encode() for w in frequent_words(docs, vocab, text, n)]
    return vocab, Lexicon.compile(words, vocab.merge(words))


def encode(docs: DataFrame, model: tuple[Vocabulary, bytes], doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by blanks)
    and decoded_sha256, and on request ids and decoded.  A null text counts as
    empty: no ids, both digests those of nothing.  Each row stands for itself,
    so ties, repeated rows and null ids change nothing; texts of any length are
    cut a piece at a time.
    """
    vocab, block = model
    kind = dict(docs.select(F.col(doc_id).alias("k")).dtypes)["k"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches):
        enc = encoder(vocab, block)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = np.zeros(len(texts), np.int64)
            digests = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
            found, said = [], [[] for _ in texts]
            for k, ids, numbers, tokens in enc.batch(texts):
                if len(ids):
                    gap = b" " if n[k] else b""
                    for digest, part in zip(digests[k], (numbers, tokens), strict=True):
                        digest.update(gap + part[:-1])
                    n[k] += len(ids)
                    if with_ids:
                        found.append(ids)
                    if with_text:
                        said[k].append(bytes(part[:-1]).decode())
            arrays = [b.column(0), pa.array(n), pa.array([x.hexdigest() for x, _ in digests], pa.string()), pa.array([x.hexdigest() for _, x in digests], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32())))
                names.append("ids")
            if with_text:
                arrays.append(pa.array([" ".join(x) for x in said], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(arrays, names)
        hand_back()

    return small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
