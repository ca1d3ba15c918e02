"""Token, chunk and hash functions as columns (TXT, EMB-6). All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is a token, and a part of an identifier.
#: Identifiers and numbers; letters and digits of any script may follow the first sign.
WORD = r"[A-Za-z_$][\p{L}\p{N}_$]*|\p{Nd}+"
SUBWORD = r"[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|[0-9]+"

# The words that carry no content, and the words that say little about code.
STOP_WORDS = (
    "a about an and any are as at be been by can could did do does doing done ever for from give given gives how i if in into is "
    "it its just me my of on or our out please should so some somebody someone that the their them then there these they this those to up "
    "want was we were what when where which while who why will with would you your"
).split()
LOW_SIGNAL = "code function method program snippet solution way".split()

FNV_START, FNV_PRIME = 2166136261, 16777619
PIECE_SEPARATOR = "\u001e"
SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, also where it stands in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strings(*items: str) -> Column:
    return F.array(*[F.lit(x) for x in items])


def subwords(token: Column) -> Column:
    """Lower-cased parts of an identifier: camel case, runs of capitals, digits."""
    return F.transform(F.regexp_extract_all(token, F.lit(SUBWORD), F.lit(0)), F.lower)


def tokens(text: Column, split: bool = True) -> Column:
    """Lower-cased words of a text; an identifier of several parts is followed by its parts. Null gives an empty list."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    if not split:
        return F.transform(words, F.lower)

    def more(t: Column) -> Column:
        def of(parts: Column) -> Column:
            several = (F.size(parts) > 1) | ((F.size(parts) == 1) & (F.element_at(parts, 1) != F.lower(t)))
            return F.when(several, F.concat(F.array(F.lower(t)), parts)).otherwise(F.array(F.lower(t)))

        return let(subwords(t), of)

    def with_parts(t: Column) -> Column:
        # most words are plain and are their own only part
        return F.when(t.rlike("^(?:[a-z]+|[0-9]+)$"), F.array(t)).otherwise(more(t))

    return F.flatten(F.transform(words, with_parts))


def content_tokens(text: Column, split: bool = True) -> Column:
    """Tokens without stop words, low-signal words and single characters; all tokens if none is left."""
    drop = strings(*STOP_WORDS, *LOW_SIGNAL)

    def chosen(every: Column) -> Column:
        kept = F.filter(every, lambda t: ~F.array_contains(drop, t) & (F.length(t) > 1))
        return F.when(F.size(kept) > 0, kept).otherwise(every)

    return let(tokens(text, split), chosen)


def index_terms(text: Column) -> Column:
    """Tokens of more than one character, as they are indexed."""
    return F.filter(tokens(text), lambda t: F.length(t) > 1)


def bigrams(items: Column) -> Column:
    """Neighbouring items joined by an underscore."""
    def pairs(v: Column) -> Column:
        n = F.greatest(F.size(v) - 1, F.lit(0))
        return F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(2), n), lambda a, b: F.concat_ws("_", a, b))

    return let(items, pairs)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash over code points."""
    signs = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    def step(h: Column, c: Column) -> Column:
        return h.bitwiseXOR(F.ascii(c).cast("bigint")) * FNV_PRIME % F.lit(4294967296)

    return F.aggregate(signs, F.lit(FNV_START).cast("bigint"), step)


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def truncated(text: Column, budget: int) -> Column:
    """The first ``budget`` words, joined by single spaces."""
    return F.array_join(F.slice(words(text), 1, budget), " ")


def windows(text: Column, budget: int, overlap: float = 0.25) -> Column:
    """Windows of ``budget`` words that share a part; the last one just reaches the end."""
    step = max(1, int(budget * (1.0 - overlap)))

    def cut(w: Column) -> Column:
        more = F.ceil(F.greatest(F.size(w) - budget, F.lit(0)) / F.lit(float(step))).cast("int")
        return F.transform(F.sequence(F.lit(0), more), lambda i: F.array_join(F.slice(w, i * step + 1, budget), " "))

    return let(words(text), cut)


@dataclass(frozen=True)
class Chunking:
    """How a text is cut before it is encoded: truncate, windows or summary."""

    strategy: str = "truncate"
    budget_tokens: int = 512
    window_overlap: float = 0.25

    def __post_init__(self) -> None:
        if self.strategy not in ("truncate", "windows", "summary"):
            raise ValueError(f"unknown chunk strategy {self.strategy!r}")


def chunks(text: Column, config: Chunking = Chunking()) -> Column:
    if config.strategy == "windows":
        return windows(text, config.budget_tokens, config.window_overlap)
    if config.strategy == "summary":
        from quern.functions.code import summary

        return F.array(truncated(summary(text), config.budget_tokens))
    return F.array(truncated(text, config.budget_tokens))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def vector_key(pieces: Column) -> Column:
    """The key of a vector: the hash of the encoded pieces."""
    return content_hash(F.array_join(pieces, PIECE_SEPARATOR))


def overlap(a: Column, b: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Jaccard similarity of the words of two texts, stop words left out."""
    drop = strings(*stop)
    x, y = (F.array_distinct(F.filter(tokens(t, split=False), lambda w: ~F.array_contains(drop, w))) for t in (a, b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))


def changed_fraction(before: Column, after: Column) -> Column:
    """Share of places at which two texts of equally many tokens differ; null where the numbers differ."""
    a, b = tokens(before, split=False), tokens(after, split=False)
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), differ / F.size(a))


# Fixed value: the paths of tests.
TEST_PATH = r"(^|/)(tests?|__tests__|spec|specs)/|(^|/)test_[^/]*\.py$|_test\.py$|\.(test|spec)\.[cm]?[jt]sx?$"


def is_test_path(path: Column) -> Column:
    return F.translate(path, "\\", "/").rlike(TEST_PATH)


# Fixed value: the line that ends the statement of a task.
STATEMENT_MARK = r"(?i)-{3,}\s*(?:Input|Output|Examples?|Note|Constraints|Sample)"


def without_sections(text: Column) -> Column:
    """A statement up to its input/output sections, unless they begin within the first 40 characters."""
    at = F.regexp_instr(text, F.lit(STATEMENT_MARK))
    return F.when(at > 40, F.trim(F.substring(text, F.lit(1), at - 1))).otherwise(text)


def escaped(text: Column) -> Column:
    """Control characters made visible."""
    out = F.replace(F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "?")
