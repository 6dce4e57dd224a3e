"""Tokenisation of whole texts with the tokenizers library, once for each distinct word of a slice.

The vocabulary's normaliser works character by character apart from NFC, which never composes
across ASCII white space, and its splitter drops white space. So the ids of a text are those of
its white-space-separated words in turn. Arrow splits a slice of texts into words and numbers the
distinct ones; the library encodes only those, and numpy lays the ids out by text.

A plain word (Latin letters, then ASCII marks) is further cut into its lower-cased letters and its
marks, which the splitter separates anyway; such parts need no normaliser and are encoded many at
a time. Every other word goes through the library's whole chain. Vocabularies that work in any
other way are encoded text by text.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes whose words are numbered together. Bounds memory, not results.
SLICE_BYTES = 6 << 20
#: Parts joined for one call of the library.
JOINED = 500
PLAIN = r"^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>[!-&(-/:-@\[-`{-~]*)$"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splits_by_word(tokenizer) -> bool:
    """Whether the vocabulary lower-cases, drops white space and has ends of words, without
    anything that looks across words."""
    import json

    spec = json.loads(tokenizer.to_str())
    kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    first = pre[0] if pre else {}
    return kinds == ["NFC", "Replace", "Lowercase"] and first.get("behavior") == "Removed" and first.get("invert") is True and r"[\p{L}]+" in first.get("pattern", {}).get("Regex", "") and spec["model"].get("end_of_word_suffix") == "</w>" and all(not re.search(r"\s", t["content"]) and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and t["content"][0] == "<" for t in spec.get("added_tokens", []))


def lay_out(flat: np.ndarray, bounds: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` (run k is bounds[k]:bounds[k+1]) in the order of ``index``, and their bounds."""
    sizes = np.diff(bounds)[index]
    out = np.concatenate(([0], np.cumsum(sizes)))
    kind = np.int32 if max(len(flat), out[-1]) < 1 << 31 else np.int64
    at = np.repeat((bounds[:-1][index] - out[:-1]).astype(kind), sizes)
    at += np.arange(out[-1], dtype=kind)
    return flat[at], out


class Encoder:
    """encode(texts) gives all ids of an Arrow array of texts and the bounds of each text's ids."""

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_by_word(self.tokenizer)
        if self.by_word:
            self.of_parts = Tokenizer.from_file(path)
            self.of_parts.normalizer = None
            self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = self.tokenizer.get_vocab()
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's own encoder, kept between tasks."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *got]), np.concatenate(([0], np.cumsum([len(x) for x in got], dtype=np.int64)))

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of non-empty parts, none of which the splitter would cut."""
        words = parts.to_pylist()
        joined = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        got = [np.array(x.ids, dtype=np.uint32) for x in self.of_parts.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate([np.empty(0, np.uint32), *got])
        ends = np.flatnonzero(self.closes[flat]) + 1
        return (flat, np.concatenate(([0], ends))) if len(ends) == len(words) else self._library(words)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.extract_regex(words, PLAIN)
        plain = np.asarray(cut.is_valid())
        odd = np.flatnonzero(~plain)
        flat_odd, of_odd = self._library(words.take(pa.array(odd)).to_pylist())
        cut = cut.filter(pa.array(plain))
        letters, marks = pc.utf8_lower(cut.field(0)).dictionary_encode(), cut.field(1).dictionary_encode()
        n = len(letters.dictionary)
        filled = pc.not_equal(marks.dictionary, "")
        flat, of = self._parts(pa.concat_arrays([letters.dictionary, marks.dictionary.filter(filled)]))
        filled = np.asarray(filled)
        mark_run = np.where(filled, n + np.cumsum(filled) - 1, len(of) - 1)
        # after the parts: one empty run, then the odd words
        of = np.concatenate((of, of_odd + of[-1]))
        flat = np.concatenate((flat, flat_odd))
        empty = len(of) - 1 - len(odd) - 1
        runs = np.full((len(words), 2), empty)
        runs[plain, 0] = np.asarray(letters.indices)
        runs[plain, 1] = np.where(filled, mark_run, empty)[np.asarray(marks.indices)] if len(filled) else empty
        runs[odd, 0] = empty + 1 + np.arange(len(odd))
        flat, bounds = lay_out(flat, of, runs.reshape(-1))
        return flat, bounds[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return self._library(texts.to_pylist())
        if pc.any(pc.match_substring_regex(texts, "[\t\r\f\v]")).as_py():
            split = pc.split_pattern_regex(texts, "[ \n\t\r\f\v]+")
        else:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        flat, of = lay_out(*self._words(coded.dictionary), np.asarray(coded.indices))
        offsets = np.asarray(split.offsets)
        return flat, of[offsets - offsets[0]]


def slices(batches, column: int, most: int = SLICE_BYTES):
    """Arrow batches cut so that a slice's texts stay under ``most`` bytes where single texts allow."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // most
        edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows])) if batch.num_rows else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(int(a), int(b - a))
            pa.default_memory_pool().release_unused()
