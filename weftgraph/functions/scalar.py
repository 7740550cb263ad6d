"""Scalar functions as Spark columns; Arrow UDFs only where Spark has no equal."""

from __future__ import annotations

import math
import posixpath
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def ascii_lower(c: Column) -> Column:
    """A-Z lowered; other letters stay."""
    return F.translate(c, _UPPER, _UPPER.lower())


# --- identifiers -----------------------------------------------------------


def make_id_text(s: str) -> str:
    """NFKC, runs of anything but letters and numbers to one ``_``, case-folded and composed."""
    s = unicodedata.normalize("NFKC", s)
    out: list[str] = []
    for c in s:
        kind = unicodedata.category(c)
        if kind[0] == "L" or kind in ("Nd", "Nl", "No"):
            out.append(c)
        elif out and out[-1] != "_":
            out.append("_")
    return unicodedata.normalize("NFC", "".join(out).strip("_").casefold())


def make_id(c: Column) -> Column:
    """Identifier of a text; ASCII stays in the JVM, a worker sees only the rest."""
    ascii_ = c.rlike(r"^[\x00-\x7F]*$")
    far = F.udf(lambda s: None if s is None else make_id_text(s), "string", useArrow=True)
    return F.when(ascii_, make_ascii_id(c)).otherwise(far(F.when(~ascii_, c)))


def make_ascii_id(c: Column) -> Column:
    """:func:`make_id` for texts known to be ASCII."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_")), "^_+|_+$", "")


def node_key(id_: Column, file: Column, kind: Column, label: Column) -> Column:
    return F.when(id_ != "", id_).otherwise(make_id(F.concat_ws(":", file, kind, label)))


# --- similarity ------------------------------------------------------------


def entropy_ascii(c: Column) -> Column:
    """Shannon entropy in bits over the characters, which are the bytes of ASCII text."""
    n = F.char_length(c).cast("double")
    chars = F.split(c, "")
    kinds = F.array_sort(F.array_distinct(chars))
    each = F.transform(kinds, lambda k: F.size(F.filter(chars, lambda x: x == k)).cast("double"))
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n))).otherwise(F.lit(0.0))


def shannon_entropy(c: Column) -> Column:
    """Shannon entropy in bits over the UTF-8 bytes."""

    def bits(s: str | None) -> float | None:
        if s is None:
            return None
        raw = s.encode()
        return sum(-k / len(raw) * math.log2(k / len(raw)) for k in (raw.count(b) for b in set(raw))) + 0.0

    return F.when(c.rlike(r"^[\x00-\x7F]*$"), entropy_ascii(c)).otherwise(F.udf(bits, "double", useArrow=True)(c))


def jaro_winkler_bytes(a: str, b: str) -> float:
    """Jaro-Winkler over UTF-8 bytes; half transpositions count, the prefix bonus is never withheld."""
    x, y = a.encode(), b.encode()
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    reach = max(max(len(x), len(y)) // 2 - 1, 0)
    used = [False] * len(y)
    mine = []
    for i, c in enumerate(x):
        for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
            if not used[j] and y[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    other = [c for c, u in zip(y, used, strict=True) if u]
    moved = sum(p != q for p, q in zip(mine, other, strict=True)) / 2
    jaro = (m / len(x) + m / len(y) + (m - moved) / m) / 3
    same = 0
    for p, q in zip(x[:4], y[:4], strict=False):
        if p != q:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def jaro_winkler(a: Column, b: Column) -> Column:
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else jaro_winkler_bytes(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(a, b)


def shingles(c: Column, n: int = 3) -> Column:
    """All substrings of ``n`` characters; a shorter text is its own."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(c) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(n))))


def minhash(grams: Column, slots: int = 16) -> Column:
    def slot(seed: int) -> Column:
        return F.array_min(F.transform(grams, lambda g: F.xxhash64(F.lit(seed), g)))

    return F.array(*[slot(k) for k in range(slots)])


def lsh_bands(signature: Column, bands: int = 4, rows: int = 4) -> Column:
    return F.array(*[F.concat_ws(":", F.lit(k * rows), F.slice(signature, k * rows + 1, rows).cast("array<string>")) for k in range(bands)])


def single_char_substitution(a: Column, b: Column) -> Column:
    """Same length and one differing character (for equal lengths an edit distance of 1 is that)."""
    return (F.char_length(a) == F.char_length(b)) & (F.levenshtein(a, b) == 1)


def fuzzy_merge_blocked(a: Column, b: Column, jw: Column) -> Column:
    """Strict prefixes never merge; short labels only on one substitution and near equality."""
    prefix = a.startswith(b) | b.startswith(a)
    short = (F.greatest(F.octet_length(a), F.octet_length(b)) < 12) & ~((jw >= 0.97) & single_char_substitution(a, b))
    return (a != b) & (prefix | short)


def has_meaningful_entropy(c: Column, least: float = 2.5) -> Column:
    return (F.octet_length(c) >= 3) & (shannon_entropy(c) >= least)


# --- search text -----------------------------------------------------------

_SPLIT = r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
#: Suffixes that a stem loses, the first that fits.
SUFFIXES = ("ing", "tion", "sion", "ers", "ies", "ed", "es", "al", "er", "s")


def lexical_terms(c: Column) -> Column:
    """Distinct lower-case words of three letters and more, camel case split."""
    return F.array_distinct(F.filter(F.transform(F.split(c, _SPLIT), F.lower), lambda t: F.char_length(t) >= 3))


def stem_term(c: Column) -> Column:
    return F.regexp_replace(c, "^(.{4,}?)(?:" + "|".join(SUFFIXES) + ")$", "$1")


def query_term_overlap(query: Column, label: Column) -> Column:
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, label)) / F.size(query))


def contains_ci(text: Column, needle: Column) -> Column:
    """ASCII-insensitive; the empty needle is in every text."""
    return F.contains(ascii_lower(text), ascii_lower(needle))


def label_symbol(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^( \t\n]*", 0)


def bounded_edit_distance(a: Column, b: Column, cap: Column | int) -> Column:
    """Edit distance, ``cap + 1`` beyond ``cap``."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    return F.least(F.levenshtein(a, b), cap + 1)


def leading_identifier(c: Column) -> Column:
    return F.regexp_extract(c, "^[A-Za-z_][A-Za-z0-9_]*", 0)


def is_compound_identifier(c: Column) -> Column:
    return c.rlike("_|[a-z][A-Z]")


def is_capitalized(c: Column) -> Column:
    return c.rlike("^[A-Z]")


# --- budgets ---------------------------------------------------------------


def estimate_tokens(c: Column) -> Column:
    return F.floor((F.octet_length(c) + 3) / 4).cast("long")


def slice_token_cost(label: Column, start: Column, end: Column, end_column: Column) -> Column:
    """Tokens that a node's source lines will take; without a place, those of its label."""
    n = F.greatest(end - start + 1, F.lit(1))
    lines = F.least(n, F.lit(40))
    final = F.when(n <= 40, end_column).otherwise(40)
    chars = F.least(F.lit(2000), F.greatest(F.octet_length(label), (lines - 1) * 40 + final))
    return F.when(start.isNull(), F.greatest(F.lit(1), estimate_tokens(label))).otherwise(F.greatest(F.lit(1), F.floor((chars + 3) / 4))).cast("long")


# --- text forms ------------------------------------------------------------


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, 60), "-+$", "")
    return F.when(s == "", "checkpoint").otherwise(s)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cypher_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def script_escape(c: Column) -> Column:
    return F.replace(c, F.lit("</"), F.lit("<\\/"))


def normalize_sql_ident(c: Column) -> Column:
    """Quoted names keep their case and lose the quotes; others are lower-cased."""
    quoted = c.rlike('^".*"$')
    return F.when(quoted, F.regexp_replace(c, '^"|"$', "")).otherwise(ascii_lower(c))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n")).cast("int")


def _tenths(x: Column) -> Column:
    """A positive number to one decimal, as its exact binary value rounds; Java would round the shortest decimal.

    20x - (2k + 1) has the sign that decides, and is free of error where it is near 0.
    """
    k = F.floor(x * 10)
    over = (x * 16 - (k * 2 + 1)) + x * 4
    up = (over > 0) | ((over == 0) & (k % 2 == 1))
    return F.format_string("%.1f", (k + up.cast("int")) / 10)


def human_duration(ms: Column) -> Column:
    """Whole milliseconds, tenths of seconds or whole minutes; halves of whole numbers go up."""
    minutes = F.floor(ms / 60000 + 0.5).cast("long")
    return (
        F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))).when(ms < 60000, F.concat(_tenths(ms / 1000), F.lit(" s")))
        .otherwise(F.concat(minutes.cast("string"), F.when(minutes == 1, " minute").otherwise(" minutes")))
    )


def iso8601(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso8601(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def join_csv(items: Column, suffix: str = "") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(x.cast("string"), F.lit(suffix))), ",")


# --- hashes ----------------------------------------------------------------


def sha256_hex(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def merkle_leaf(path: Column, file_hash: Column) -> Column:
    """SHA-256 of 0x00, the path's length as four bytes, the path and the file's 32 hash bytes."""
    length = F.unhex(F.lpad(F.hex(F.octet_length(path)), 8, "0"))
    return F.sha2(F.concat(F.unhex(F.lit("00")), length, path.cast("binary"), F.unhex(file_hash)), 256)


def merkle_inner(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def is_valid_content_root(algorithm: Column, sha: Column) -> Column:
    return (algorithm == "sha256-merkle-v1") & sha.rlike("^[0-9a-fA-F]{64}$")


def stable_project_hash(root: str) -> str:
    """FNV-1a of the canonical root, 64 bits, in hex."""
    h = 0xCBF29CE484222325
    for b in root.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


# --- paths -----------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def stem_of(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def normal_path(c: Column) -> Column:
    """Lexical normal form: ``.`` and ``..`` resolved."""
    tidy = F.udf(lambda p: None if p is None else posixpath.normpath(p) if p else "", "string", useArrow=True)
    return F.when(~c.rlike(r"(^|/)\.\.?(/|$)|//|/$"), c).otherwise(tidy(c))


def path_suffixes(path: Column) -> Column:
    """``a/b/c``, ``b/c`` and ``c``: what an ``ends with`` at a slash can match, for an equi-join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


# --- operation statistics --------------------------------------------------

#: Upper bounds of the latency histogram's buckets, in milliseconds.
BUCKETS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)


def latency_bucket(ms: Column) -> Column:
    """Index of the first bound that is greater, 11 beyond all."""
    c = F.when(ms < BUCKETS[0], 0)
    for k, b in enumerate(BUCKETS[1:], 1):
        c = c.when(ms < b, k)
    return c.otherwise(len(BUCKETS)).cast("int")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def modeled_cache_saved_ms(hits: Column, extracted: Column, extract_ms: Column) -> Column:
    """Hits times the mean time of an extraction; null where none was measured."""
    return F.when((hits > 0) & (extracted > 0), hits * extract_ms / extracted)
