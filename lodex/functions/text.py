"""Text operators as Column functions. All are built-in expressions inside code generation; only
NFKC, which Spark lacks, is a pandas UDF, fed nothing but the rows that may need it, and so are the lexical scores,
which look tokens up in a hash set of the text's words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import HASH_BUCKETS, MODULE_SYNONYMS, NOISE_PATTERNS, POST_PATTERNS, PROGRAM_SYNONYMS, SERVICE_SYNONYMS, STOPWORDS

TOKEN = "[a-zA-Z0-9äöüÄÖÜß]{2,}"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Letters beyond ASCII that NFKC leaves as they are.
LATIN = "".join(chr(i) for i in range(0xC0, 0x100) if i not in (0xD7, 0xF7))


def other_signs(x: Column) -> Column:
    """Whether there are signs beyond ASCII and LATIN. By lengths: a regular expression takes many times as long on
    whole texts."""
    left = F.translate(x, LATIN, "")
    return (F.octet_length(x) > F.length(x)) & (F.octet_length(left) > F.length(left))


def nfkc(x: Column | str) -> Column:
    """Unicode NFKC. Rows of ASCII and Latin-1 letters are already normal and skip Python."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    x = col(x)
    return F.coalesce(run(F.when(other_signs(x), x)), x)


def normalize(x: Column | str, with_nfkc: bool = True) -> Column:
    """Lower case, NFKC, white space collapsed and trimmed; null is empty. Inside a lambda, where
    no Python function can stand, the caller brings NFKC text and leaves ``with_nfkc`` out."""
    lower = F.lower(F.coalesce(col(x), F.lit("")))
    return F.trim(F.regexp_replace(nfkc(lower) if with_nfkc else lower, r"(?U)\s+", " "))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for each row. Catalyst would copy their expressions
    into every use, also into lambdas and filters, where they run once for each element; it doesn't
    copy what a generator gives."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_held")
    return df.select("*", one).select(*df.columns, *[F.col("_held")[n].alias(n) for n in columns])


def words_of(normal: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Tokens of text that is already normal, duplicates kept. The stop list becomes a hash set."""
    found = runs_of(normal)
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def runs_of(normal: Column) -> Column:
    """Runs of two or more token characters."""
    return F.regexp_extract_all(normal, F.lit(TOKEN), 0)


def tokenize(x: Column | str, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """T2."""
    return words_of(normalize(x), stopwords)


def phrases(x: Column | str) -> Column:
    """Normalised quoted phrases, blank ones dropped."""
    found = F.regexp_extract_all(nfkc(col(x)), F.lit('"([^"]+)"'), 1)
    return F.filter(F.transform(found, lambda p: normalize(p, False)), lambda p: p != "")


def ngrams(tokens: Column, n: int) -> Column:
    """The distinct n-grams of a token array, in order of appearance."""
    last = F.size(tokens) - n + 1
    shifted = F.arrays_zip(*[F.slice(tokens, k + 1, F.greatest(last, F.lit(0))).alias(f"t{k}") for k in range(n)])
    made = F.transform(shifted, lambda x: F.concat_ws(" ", *[x[f"t{k}"] for k in range(n)]))
    return F.when(last >= 1, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def haystack(text: Column | str, url: Column | str) -> Column:
    return F.concat(normalize(text), F.lit(" "), normalize(url))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


class Haystack:
    """Substring tests of tokens and of neighbouring tokens in one normalised text. Whole words are looked up; what
    isn't one is searched for in the distinct words, as no token reaches over an end of one; neighbours in those pairs of
    which the signs beside the space are the same."""

    def __init__(self, hay: str):
        self.hay, self.words = hay, set(re.findall(TOKEN, hay))
        self.lines, own = "\n".join(self.words), hay.split(" ")
        self.two: dict[str, list[str] | str] = {}
        for a, b in set(zip(own, own[1:])):
            self.two.setdefault(f"{a[-2:]} {b[:2]}", []).append(f"{a} {b}")
        self.three = {f"{a[-2:]} {b} {c[:2]}" for a, b, c in zip(own, own[1:], own[2:])}

    def has(self, token: str) -> bool:
        return token in self.words or token in self.lines

    def has_two(self, a: str, b: str) -> bool:
        key = f"{a[-2:]} {b[:2]}"
        near = self.two.get(key)
        if isinstance(near, list):
            near = self.two[key] = "\n".join(near)
        return near is not None and f"{a} {b}" in near

    def has_three(self, a: str, b: str, c: str) -> bool:
        return f"{a[-2:]} {b} {c[:2]}" in self.three and f"{a} {b} {c}" in self.hay


def _lexical(score: Callable[[str, list[str], Haystack], float]) -> Callable[[Column, Column, Column], Column]:
    @F.pandas_udf("double")
    def run(query: pd.Series, tokens: pd.Series, hay: pd.Series) -> pd.Series:
        out, last = [], Haystack("")
        for q, t, h in zip(query, tokens, hay):  # rows of one document lie together
            last = last if not len(t) or last.hay == h else Haystack(h)
            out.append(min(1.0, max(0.0, score(q, list(t), last))) if len(t) else 0.0)
        return pd.Series(out, dtype="float64")

    return run


def _ratio(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def _tokens_found(tokens: list[str], hay: Haystack) -> tuple[set[str], float]:
    """The distinct tokens that occur, and the share of the long ones, repeats counted."""
    found = {t for t in set(tokens) if hay.has(t)}
    long = [t for t in tokens if len(t) >= 6]
    return found, _ratio(sum(t in found for t in long), len(long))


def _score_f(query: str, tokens: list[str], hay: Haystack) -> float:
    found, long = _tokens_found(tokens, hay)
    return 0.7 * _ratio(len(found), len(tokens)) + (0.2 if len(query) >= 6 and query in hay.hay else 0.0) + 0.1 * long


def _score_b(query: str, tokens: list[str], hay: Haystack) -> float:
    found, long = _tokens_found(tokens, hay)
    two, three = set(zip(tokens, tokens[1:])), set(zip(tokens, tokens[1:], tokens[2:]))
    two_found = {g for g in two if g[0] in found and g[1] in found and hay.has_two(*g)}
    three_found = sum(g[:2] in two_found and g[1:] in two_found and hay.has_three(*g) for g in three)
    return 0.55 * _ratio(len(found), len(tokens)) + 0.25 * _ratio(len(two_found), len(two)) + 0.15 * _ratio(three_found, len(three)) + (0.3 if len(query) >= 6 and query in hay.hay else 0.0) + 0.1 * long


def lexical_f(query: Column, tokens: Column, hay: Column) -> Column:
    """Q1. Columns that are there, see held(): ``query`` is normalised, ``tokens`` are its tokens, ``hay``
    is haystack()."""
    return _lexical(_score_f)(query, tokens, hay)


def lexical_b(query: Column, tokens: Column, hay: Column) -> Column:
    """Q2: unigram, bigram and trigram coverage, phrase and long tokens. A gram can be there only if
    its parts are, so bigrams are looked for where both tokens were found, and trigrams where both
    bigrams were."""
    return _lexical(_score_b)(query, tokens, hay)


def strict_match(tokens: Column, quoted: Column, hay: Column) -> Column:
    """Q3: every quoted phrase, and any token of four letters or more if there is one."""
    core = F.filter(tokens, lambda t: F.length(t) >= 4)
    return F.forall(quoted, lambda p: hay.contains(p)) & ((F.size(core) == 0) | F.exists(core, lambda t: hay.contains(t)))


def expand_f(query: Column | str, programs: dict[str, list[str]] = PROGRAM_SYNONYMS, modules: dict[str, list[str]] = MODULE_SYNONYMS) -> Column:
    """Programme keys as whole words, module keys as substrings; new terms in order."""
    query = col(query)
    normal = normalize(query)
    none = F.array().cast("array<string>")
    hits = [F.when(normal.rlike(rf"(?U)\b{re.escape(k)}\b"), F.array(*map(F.lit, v))).otherwise(none) for k, v in programs.items()]
    hits += [F.when(normal.contains(k), F.array(*map(F.lit, v))).otherwise(none) for k, v in modules.items()]
    terms = F.array_except(F.array_distinct(F.concat(*hits)), words_of(normal))
    return F.when(F.size(terms) > 0, F.concat_ws(" ", query, F.array_join(terms, " "))).otherwise(query)


def expand_b(query: Column | str, synonyms: dict[str, str] = SERVICE_SYNONYMS) -> Column:
    """Substring keys of the lower-cased query; values appended in order."""
    query = col(query)
    lower = F.lower(query)
    return F.concat_ws(" ", query, *[F.when(lower.contains(k), F.lit(v)) for k, v in synonyms.items()])


def variants(query: Column | str) -> Column:
    """The query, its words reversed, its expansion; distinct, in this order."""
    query = col(query)
    words = F.split(F.trim(F.regexp_replace(query, r"(?U)\s+", " ")), " ")
    turned = F.when(F.size(words) > 1, F.array_join(F.reverse(words), " ")).otherwise(query)
    return F.array_distinct(F.array(query, turned, expand_b(query)))


def clean(x: Column | str, patterns: tuple[str, ...] = NOISE_PATTERNS, whole_words: bool = False) -> Column:
    """Boilerplate patterns to a space. ``whole_words`` spares longer words that hold one."""
    edge = r"\b" if whole_words else ""
    text = reduce(lambda c, p: F.regexp_replace(c, f"(?iu){edge}{p}{edge if p[-1].isalnum() else ''}", " "), patterns, col(x))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_post(x: Column | str) -> Column:
    """With dots that match line ends."""
    text = reduce(lambda c, p: F.regexp_replace(c, f"(?isu){p}", " "), POST_PATTERNS, col(x))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def md5_bucket(token: Column, buckets: int = HASH_BUCKETS) -> Column:
    """V4: md5 as a number modulo ``buckets``, folded in 32-bit limbs."""
    digest = F.md5(token)
    out = F.lit(0).cast("long")
    for i in range(4):
        limb = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        out = (out * F.lit(4294967296) + limb) % F.lit(buckets)
    return out


def point_id(key: Column) -> Column:
    """V6: the first 48 bits of md5 as a number."""
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


def contains_any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(w) for w in words])


def stride_chunks(text: Column, size: int, overlap: int) -> Column:
    """Fixed windows of ``size`` characters every ``size - overlap``, but at least one on."""
    step = max(1, size - overlap)
    n = F.length(text)
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    return F.when(n > 0, F.transform(at, lambda i: F.substring(text, i + 1, size))).otherwise(F.array().cast("array<string>"))


def context_header(title: Column, h1: Column, section: Column) -> Column:
    """T24."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    new_section = filled(section) & (section != "Allgemein") & (low(section) != low(title)) & (low(section) != low(h1))
    return F.concat_ws("\n", F.when(filled(title), F.concat(F.lit("Seite: "), title)), F.when(filled(h1) & (low(h1) != low(title)), F.concat(F.lit("Überschrift: "), h1)), F.when(new_section, F.concat(F.lit("Abschnitt: "), section)))


def markdown_table(rows: Column) -> Column:
    """An array of arrays of cells as Markdown, short rows padded to the header."""
    width = F.size(rows[0])
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), 1, width), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    rest = F.when(F.size(rows) > 1, F.concat(F.array(rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))), line))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0])), rest), "\n")).otherwise("")


def url_class(url: Column) -> Column:
    """T37."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return F.when(path.contains("/aktuelles/news/"), "news").when(path.contains("/veranstaltungen/"), "event").when(path.rlike("/studiengaenge|/fakultaet|/hochschule"), "institution").otherwise("page")


def without_thinking(answer: Column) -> Column:
    """Model answers without reasoning, quotes and the marker for unknown."""
    out = F.trim(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""))
    out = F.trim(F.regexp_replace(out, r"^[\"']+|[\"']+$", ""))
    return F.when(F.upper(out).contains("UNBEKANNT"), "").otherwise(out)


def title_case(text: Column) -> Column:
    """A letter after anything but a letter is a capital, any other letter is small."""
    signs = F.split(text, "")
    return F.array_join(F.transform(signs, lambda c, i: F.when((i > 0) & F.get(signs, i - 1).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c))), "")


def upper_signs(text: Column) -> Column:
    """Upper case by single letters: one whose capital is several letters stays (ß is not SS)."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) > F.length(c), c).otherwise(F.upper(c))), "")


def highlight(text: Column, query: str) -> Column:
    """Words over two letters of the query, longest first, in <mark>."""
    words = sorted({w for w in query.split() if len(w) > 2}, key=lambda w: (-len(w), w))
    if not words:
        return text
    return F.regexp_replace(text, "(?iu)(" + "|".join(map(re.escape, words)) + ")", "<mark>$1</mark>")


def snippet(text: Column, query: str, before: int = 20, after: int = 100) -> Column:
    """The text around the query's first word of over three letters."""
    word = next((w for w in query.split() if len(w) > 3), None)
    if word is None:
        return F.substring(text, 1, before + after)
    at = F.instr(F.lower(text), word.lower())
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + after)).otherwise(F.substring(text, 1, before + after))


def to_int(x: Column, default: int = 0) -> Column:
    """T44."""
    return F.coalesce(x.try_cast("int"), F.lit(default))
