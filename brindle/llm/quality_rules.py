"""Quality rules by the divergence of a document's histograms from its language's.

Two histograms of each language are gathered from all its documents: of
character classes, and of its most common words. A document whose own
histogram lies too far from its language's, by Jensen-Shannon distance, is not kept.
Documents too short for a histogram are not judged by it.
"""

from __future__ import annotations

import functools
import pickle
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.texts import free_name, lean, quoted, with_fields
from brindle.operators.ordered import broadcast_if_small, written
from brindle.session import checkpoint_folder

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
CLASSES = ("lower", "upper", "letter", "number", "space", "point", "symbol")
#: The most frequent words of a language are its common words, all others are one more entry
#: of the histogram.
COMMON = 64
#: Different words whose counts a task holds at once.
_HELD = 60_000


@dataclass(frozen=True)
class Rules:
    """Distances are square roots of divergences to base 2: 0 to 1.

    ``min_chars`` and ``min_words`` are what a document needs for its histograms to be
    compared; ``min_reference`` are the words that a language's reference needs.
    """

    class_limit: float = 0.25
    word_limit: float = 0.5
    min_chars: int = 200
    min_words: int = 60
    min_reference: int = 2000


@functools.cache
def class_of() -> np.ndarray:
    """The character class of each code point."""
    first = {"L": 2, "M": 2, "N": 3, "Z": 4, "P": 5}
    exact = {"Ll": 0, "Lu": 1, "Lt": 1}
    kinds = map(unicodedata.category, map(chr, range(0x110000)))
    table = np.array([exact.get(k, first.get(k[0], 6)) for k in kinds], dtype=np.uint8)
    table[[ord(c) for c in SPACES]] = 4
    table[[ord(c) for c in SYMBOLS]] = 6
    return table


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return np.bincount(class_of()[points], minlength=len(CLASSES))


def lowered_words(text: str) -> list[bytes]:
    """What stands between ASCII white space, with A-Z lowered, as UTF-8."""
    return text.encode().lower().split()


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    windows = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
               + h[2:])
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= again
    return int(covered.sum())


def base_measures(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = text.encode().split()
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            repeats += line in seen
            seen.add(line)
    again = repeated_words(words)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            repeats, again, len(words) < 50 or 100 * again > 50 * len(words))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms: 0 for the same, 1 without overlap."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(min(max(parts.sum() / 2, 0.0), 1.0)))


class _Places(dict):
    """The place of each common word; all other words have the last one."""

    def __missing__(self, word: bytes) -> int:
        return len(self)


@dataclass(frozen=True)
class Reference:
    """Histograms of one language; ``common`` are its common words, in the words' order."""

    classes: np.ndarray
    common: _Places
    words: np.ndarray
    n_words: int

    @classmethod
    def of(cls, classes: list[int], words: list[tuple[bytes, int]], n_words: int) -> Reference:
        counts = [n for _, n in words]
        return cls(np.array(classes, dtype=float), _Places((w, i) for i, (w, _) in enumerate(words)),
                   np.array([*counts, n_words - sum(counts)], dtype=float), n_words)

    def word_counts(self, words: list[bytes]) -> np.ndarray:
        places = np.fromiter(map(self.common.__getitem__, words), np.int64, len(words))
        return np.bincount(places, minlength=len(self.common) + 1)


@functools.lru_cache(256)
def _read(reference: bytes) -> Reference:
    """A reference as a task gets it beside each text of its language."""
    return Reference.of(*pickle.loads(reference))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of language, word and number; character classes have no word but their number."""
    words: dict = defaultdict(Counter)
    classes: dict = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))

    def flushed() -> Iterator[pa.RecordBatch]:
        rows = chain(((lang, kind, None, n) for lang, found in classes.items()
                      for kind, n in enumerate(found.tolist()) if n),
                     ((lang, None, word, n) for lang, found in words.items()
                      for word, n in found.items()))
        kinds = pa.string(), pa.int32(), pa.binary(), pa.int64()
        while some := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)],
                                             names=["lang", "kind", "word", "n"])
        words.clear()
        classes.clear()

    held = 0
    for batch in batches:
        for text, lang in zip(*batch.columns):
            text, lang = text.as_py() or "", lang.as_py()
            classes[lang] += class_counts(text)
            before = len(words[lang])
            words[lang].update(lowered_words(text))
            held += len(words[lang]) - before + 1
            if held > _HELD:
                yield from flushed()
                held = 0
    yield from flushed()


def references(df: DataFrame, text: str, lang: str, rules: Rules = Rules()) -> DataFrame:
    """Rows of ``lang`` and ``reference``: each language's histograms, over all its documents.

    Tasks add up what they read, and of a language's words only the most frequent of a task go
    on to be compared with others'. Languages of fewer than ``rules.min_reference`` words have
    none; of equally frequent words the first by its bytes is taken. Nothing comes to the driver.
    """
    counts = (df.select(quoted(text), quoted(lang))
              .mapInArrow(lean(_counted), "lang string, kind int, word binary, n long")
              .groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")).checkpoint())
    words = counts.where(F.col("kind").isNull())
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = (words.withColumn("place", F.row_number().over(order)).where(F.col("place") <= COMMON)
           .groupBy(F.col("lang").alias("lang_"))
           .agg(F.array_sort(F.collect_list(F.struct("place", "word", "n"))).alias("words")))
    # the classes' numbers and the words' total, which are few rows
    sums = counts.groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n"))))
        .alias("classes"),
        F.sum(F.when(F.col("kind").isNull(), F.col("n"))).alias("total")).where(
        F.col("total") >= max(rules.min_reference, 1))

    def rows(values: Iterable[tuple]) -> Iterator[tuple]:
        for classes, common, total in values:
            found = dict(classes)
            yield (pickle.dumps(([found.get(k, 0) for k in range(len(CLASSES))],
                                 [(w["word"], w["n"]) for w in common], total)),)

    joined = sums.join(top, F.col("lang").eqNullSafe(F.col("lang_")))
    return with_fields(joined, ["classes", "words", "total"], "reference binary", rows).select(
        "lang", "reference")


def judged(reference: Reference | None, rules: Rules, text: str | None) -> tuple:
    text = text or ""
    base = base_measures(text)
    by_class = by_word = None
    if reference is not None:
        if len(text) >= rules.min_chars:
            by_class = distance(class_counts(text), reference.classes)
        if base[0] >= rules.min_words:
            by_word = distance(reference.word_counts(lowered_words(text)), reference.words)
    far = (by_class or 0) > rules.class_limit or (by_word or 0) > rules.word_limit
    return (*base, by_class, by_word, not base[-1] and not far)


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, class_distance double, word_distance double, kept boolean")


def apply_rules(df: DataFrame, text: str, lang: str, rules: Rules = Rules()) -> DataFrame:
    """``df`` with the measures of each text, its two distances and ``kept``.

    Words stand between ASCII white space. ``base_failed``: under 50 words, or more
    than half of the words repeat in windows of three. ``kept`` is false then, and
    where a distance is beyond its limit. A distance is null where the text or the
    language's reference is too short to compare. Rows without a language are
    a language of their own. A null text has no words: not kept. Repeated rows each
    count in the references and keep their own row. Columns named like a result are
    replaced by it; an empty table gives no rows. Whole texts are read twice, once for the
    references; one shuffle adds up counts. References are a table that is joined by language,
    and broadcast only where a count finds it small.
    """
    checkpoint_folder(df.sparkSession)
    known = broadcast_if_small(written(references(df, text, lang, rules)))
    own, reference = free_name(df, "_lang"), free_name(df, "_reference")
    met = df.join(known.withColumnsRenamed({"lang": own, "reference": reference}),
                  F.col(quoted(lang)).eqNullSafe(F.col(own)), "left").drop(own)

    def rows(values: Iterable[tuple[str | None, bytes | None]]) -> Iterator[tuple]:
        return (judged(r and _read(r), rules, t) for t, r in values)

    return with_fields(met, [text, reference], FIELDS, rows).drop(reference)
