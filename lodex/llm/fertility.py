"""Quality rules by tokeniser fertility.

Public vocabularies measure each whole text: characters per token of two vocabularies (a BPE with byte
fallback and a byte-level BPE for many languages), the share of byte-fallback tokens, and the entropy of the tokens in
bits. Each measure has a band: the median of the texts like it, give or take ``WIDTH`` robust standard
deviations (1.4826 MAD) and no less than ``LEAST_WIDTH``. Texts are alike if they have the same
language and the same octave of tokens, since entropy grows and the spread of the means shrinks with
the length. Equal texts of a language count once, so copies don't shape a band. A class needs
``CLASS_TEXTS`` texts and ``CLASS_SHARE`` of them all, which bounds the number of classes; a text whose
class is smaller is held against its whole language if it is at least as long as that language's median
text (means of shorter ones spread more), with no band for the entropy; what is then left is held against
the ``FIXED`` bands of its script.

A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
Symbols are the characters ``#*$%&|<>``. Repeated lines are lines with a word that equal an earlier line
of the text. Repeated words lie in a window of five words that occurs twice or more in the text. A text
fails the base rules with under ten words, or with over 20 in 100 words repeated.

Nulls: a null text is empty, has no words and fails; a null language is a language of its own; a null
doc_id stays null. Repeated rows are rows of their own. An empty table gives an empty result. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewise import WHITE, numbered, parts, sums, table, words
from .common import cut
from .tokens import lay_out, slices, vocabulary_path

FEWEST_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5
#: Half the width of a band: so many robust standard deviations, and at least so much of each measure.
WIDTH = 6.0
LEAST_WIDTH = {"chars_per_token": 0.08, "chars_per_multi_token": 0.08, "byte_share": 0.02, "entropy": 0.4}
CLASS_TEXTS, CLASS_SHARE = 100, 0.0005
#: Measures are put on a grid before a median is taken, so that a class has few distinct values.
GRID, GREATEST = 512, 32.0

# Bands for texts whose class is too small to have its own (least, greatest).
FIXED = {
    "latin": {"chars_per_token": (1.0, 9.0), "chars_per_multi_token": (1.0, 9.0), "byte_share": (0.0, 0.3), "entropy": (1.5, 32.0)},
    "other": {"chars_per_token": (0.2, 9.0), "chars_per_multi_token": (0.1, 9.0), "byte_share": (0.0, 1.0), "entropy": (1.5, 32.0)},
}
# The first code points of Unicode's blocks of letters, and each one's script.
SCRIPTS = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "kana", "han", "others"]
BLOCKS = [(0x0, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x590, 4), (0x600, 5), (0x700, 12), (0x900, 6), (0xE00, 7), (0xE80, 12), (0x10A0, 9 - 1), (0x1100, 9), (0x1200, 12), (0x1E00, 0), (0x1F00, 1), (0x2000, 12), (0x3040, 10), (0x3100, 12), (0x3400, 11), (0xA000, 12), (0xAC00, 9), (0xD7B0, 12), (0xF900, 11), (0xFB00, 12), (0x20000, 11), (0x30000, 12)]

MEASURES = list(LEAST_WIDTH)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, lang string, th long, " + ", ".join(f"{c} long" for c in COUNTS) + ", n_tokens long, " + ", ".join(f"{m} double" for m in MEASURES) + ", script string"

_WHITE, _SYMBOLS = np.zeros(256, bool), np.zeros(256, bool)
_WHITE[WHITE] = True
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACED = table(WHITE)


def byte_level(path: str):
    """The vocabulary of a file of ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pieces:
    """A sentencepiece vocabulary with byte fallback; kept by the worker between tasks."""

    _own: dict[str, Pieces] = {}

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def encode(self, names: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words in turn, and the bounds of each word's."""
        flat, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i in range(0, len(names), at_once):
            ids = self.model.encode(names[i : i + at_once], num_threads=1)
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.int32, sizes[-1].sum()))
        return np.concatenate(flat), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def repeated_words(codes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Words by text that lie in a window found twice or more in the text. A hash leaves out the windows
    that nothing equals; the others are compared as they are."""
    at = np.flatnonzero(of[WINDOW - 1 :] == of[: len(of) - WINDOW + 1]) if len(of) >= WINDOW else np.empty(0, np.int64)
    mixed = of[at].astype(np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ codes[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    ordered = np.sort(mixed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    place = np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)
    at = at[twice[place] == mixed]
    window = of[at]
    for k in range(WINDOW):
        window = numbered(window, codes[at + k])
    _, window, times = np.unique(window, return_inverse=True, return_counts=True)
    often = times[window] > 1
    marked = np.zeros(len(codes), bool)
    for k in range(WINDOW):
        marked[at[often] + k] = True
    return np.bincount(of[marked], minlength=n)


def repeated_lines(texts: pa.Array, n: int) -> np.ndarray:
    """Lines by text that have a word and equal an earlier line."""
    split = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    coded = split.flatten().dictionary_encode()
    codes, of = np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(n), np.diff(np.asarray(split.offsets)))
    flat, bounds = parts(coded.dictionary)
    worded = (sums(~_WHITE[flat], bounds) > 0)[codes]
    codes, of = codes[worded], of[worded]
    size = len(coded.dictionary) + 1
    return np.bincount(of, minlength=n) - np.bincount(np.unique(of * size + codes) // size, minlength=n)


def script_letters(flat: np.ndarray, bounds: np.ndarray) -> dict[int, np.ndarray]:
    """Letters of each script that occurs, by word; scripts by Unicode's blocks."""
    n, points = len(bounds) - 1, np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(n), sums((flat & 0xC0) != 0x80, bounds))
    latin = (points | 32) - 97 < 26
    far = np.flatnonzero(points >= 0xC0)
    kind = np.array([s for _, s in BLOCKS])[np.searchsorted([b for b, _ in BLOCKS], points[far], side="right") - 1]
    out = {0: np.bincount(of[latin], minlength=n)}
    for s in np.unique(kind):
        out[int(s)] = out.get(int(s), 0) + np.bincount(of[far[kind == s]], minlength=n)
    return out


def entropy(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits of the distribution of ids within each text."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    size = int(ids.max()) + 1 if len(ids) else 1
    keys, often = np.unique(np.repeat(np.arange(n), sizes) * size + ids, return_counts=True)
    of = keys // size
    share = often / np.maximum(sizes, 1)[of]
    return np.abs(np.bincount(of, -share * np.log2(share), minlength=n))


class Lexicon:
    """What is known of distinct words: ids of the first vocabulary, number of ids of the second,
    characters, symbols, letters by script. The words seen last are kept up to ``most``, which saves
    work and changes no result."""

    _own: dict[tuple[str, str], Lexicon] = {}

    def __init__(self, pieces_path: str, ranks_path: str, most: int = 1_000_000):
        self.pieces, self.encoder, self.most = Pieces.of(pieces_path), byte_level(ranks_path), most
        self.names, self.ids, self.bounds, self.others = pa.array([], pa.large_string()), np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int64)

    @classmethod
    def of(cls, *paths: str) -> Lexicon:
        if paths not in cls._own:
            cls._own[paths] = cls(*paths)
        return cls._own[paths]

    def encode(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of the names in turn, their bounds, and the second vocabulary's number of ids."""
        known = pc.index_in(names, self.names)
        new = names.filter(pc.is_null(known))
        ids, bounds = self.pieces.encode(new.to_pylist())
        others = np.array([len(self.encoder.encode_ordinary(" " + w)) for w in new.to_pylist()], np.int64)
        all_ids, all_bounds, all_others = np.concatenate((self.ids, ids)), np.concatenate((self.bounds, self.bounds[-1] + bounds[1:])), np.concatenate((self.others, others))
        at = np.asarray(pc.fill_null(known, -1)).astype(np.int64)
        at[at < 0] = len(self.names) + np.arange(len(new))
        ids, bounds = lay_out(all_ids, all_bounds, at)
        if len(self.names) + len(new) <= self.most:
            self.names, self.ids, self.bounds, self.others = pa.concat_arrays([self.names, new]), all_ids, all_bounds, all_others
        return ids, bounds, all_others[at]


def measure(batches: Iterator[pa.RecordBatch], pieces_path: str, ranks_path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, th, text) to the columns of SCHEMA."""
    lexicon = Lexicon.of(pieces_path, ranks_path)
    for batch in slices(batches, 3, 12 << 20):
        n, texts = batch.num_rows, batch.column(3)
        found = words(*parts(texts), _SPACED)
        flat, bounds = parts(found.names)

        def total(by_name: np.ndarray) -> np.ndarray:
            return np.bincount(found.of, by_name[found.codes], minlength=n).astype(np.int64)

        ids, of_name, others = lexicon.encode(found.names)
        ids, word_bounds = lay_out(ids, of_name, found.codes)
        n_words, word_chars = np.bincount(found.of, minlength=n), total(sums((flat & 0xC0) != 0x80, bounds))
        text_bounds = word_bounds[np.concatenate(([0], np.cumsum(n_words)))]
        n_tokens = np.diff(text_bounds)
        letters = np.zeros((n, len(SCRIPTS)), np.int64)
        for script, by_name in script_letters(flat, bounds).items():
            letters[:, script] = total(by_name)
        made = {
            "n_words": n_words, "word_chars": word_chars, "n_symbols": total(sums(_SYMBOLS[flat], bounds)), "n_dup_lines": repeated_lines(texts, n), "n_repeat_words": repeated_words(found.codes, found.of, n), "n_tokens": n_tokens,
            "chars_per_token": word_chars / np.maximum(n_tokens, 1), "chars_per_multi_token": word_chars / np.maximum(total(others), 1), "byte_share": sums(lexicon.pieces.is_byte[ids], text_bounds) / np.maximum(n_tokens, 1), "entropy": entropy(ids, text_bounds),
        }
        columns = [pa.array(v, pa.float64() if k in MEASURES else pa.int64()) for k, v in made.items()]
        # ties and texts without letters: the first script listed
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, pa.array([SCRIPTS[i] for i in letters.argmax(1)], pa.string())], names=["doc_id", "lang", "th", *made, "script"])


def measured(docs: DataFrame, pieces_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Counts and measures of every row of documents (doc_id, text, lang), with a hash of the text."""
    paths = pieces_path or vocabulary_path("piece_bpe_32k.model"), ranks_path or vocabulary_path("byte_bpe_multi_50k.tiktoken")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(lambda batches: measure(batches, *paths), SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT)


def octave() -> Column:
    return F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")


def class_bands(sound: DataFrame, keys: list[str], texts: int) -> DataFrame:
    """(keys, <measure>_low, <measure>_high) of each class that is large enough. Of a class only counts
    on a grid come together."""
    grid = {m: F.round(F.least(m, F.lit(GREATEST)) * GRID) / GRID for m in MEASURES}
    middle = sound.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile("octave", F.lit(0.5)).alias("middle"), *[F.percentile(grid[m], F.lit(0.5)).alias(f"_{m}") for m in MEASURES])
    middle = middle.where(F.col("_n") >= max(CLASS_TEXTS, CLASS_SHARE * texts)).drop("_n")
    here = same(sound, middle, keys, "inner")
    spread = here.groupBy(*keys).agg(F.first("middle").alias("middle"), *[F.first(f"_{m}").alias(f"_{m}") for m in MEASURES], *[F.percentile(F.abs(grid[m] - F.col(f"_{m}")), F.lit(0.5)).alias(f"_{m}_mad") for m in MEASURES])
    half = {m: F.greatest(F.col(f"_{m}_mad") * (1.4826 * WIDTH), F.lit(LEAST_WIDTH[m])) for m in MEASURES}
    return spread.select(*keys, "middle", *[x for m in MEASURES for x in ((F.col(f"_{m}") - half[m]).alias(f"{m}_low"), (F.col(f"_{m}") + half[m]).alias(f"{m}_high"))])


def same(rows: DataFrame, classes: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows beside their class; there are at most 1 / CLASS_SHARE classes of a kind, so they are sent to all."""
    named = classes.withColumnsRenamed({k: f"_{k}" for k in keys})
    return rows.join(F.broadcast(named), reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), how).drop(*[f"_{k}" for k in keys])


def judge(docs: DataFrame, **paths: str) -> DataFrame:
    """Every document with its counts, measures, ``base_failed``, ``kept`` and ``failed``, the names of
    the measures outside their bands. The measures are written once; bands and verdicts read them."""
    rows = cut(measured(docs, **paths), "fertility")
    sound = rows.where(~base_failed()).dropDuplicates(["th", "lang"])
    sound = cut(sound.select("lang", octave().alias("octave"), *MEASURES), "fertility-distinct")
    texts = sound.count()
    out = rows.withColumn("octave", octave())
    limits = [f"{m}_{end}" for m in MEASURES for end in ("low", "high")]
    for level, keys in (("class", ["lang", "octave"]), ("whole", ["lang"])):
        bands = class_bands(sound, keys, texts)
        out = same(out, bands.select(*keys, F.col("middle").alias(f"{level}_middle"), *[F.col(c).alias(f"{level}_{c}") for c in limits]), keys, "left")
    fixed = {f"{m}_{end}": F.when(F.col("script") == "latin", FIXED["latin"][m][i]).otherwise(FIXED["other"][m][i]) for m in MEASURES for i, end in enumerate(("low", "high"))}
    long_enough = F.col("octave") >= F.col("whole_middle")
    edge = {c: F.coalesce(f"class_{c}", F.when(long_enough & F.lit("entropy" not in c), F.col(f"whole_{c}")), fixed[c]) for c in limits}
    outside = F.array_compact(F.array(*[F.when((F.col(m) < edge[f"{m}_low"]) | (F.col(m) > edge[f"{m}_high"]), F.lit(m)) for m in MEASURES]))
    out = out.withColumn("base_failed", base_failed()).withColumn("failed", outside)
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), F.array_join("failed", ",").alias("failed"), "n_tokens", *MEASURES, "script")
