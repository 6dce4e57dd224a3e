"""Tokeniser fertility, source divergence and spelling variants against brute force and SQL."""

import collections
import glob
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from lodex.deploy import ship
from lodex.llm import divergence, fertility, sql, variants
from lodex.llm.bytewise import numbered, parts, words
from lodex.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, word string, octave string"
LONG = "Thonble réatti, of the and 12.5 is.\n" * 3000
ODD = [None, "", " \n\t ", "a", "Hello, world! it's <|endoftext|> é ﬁ", LONG, "same text here again", "same text here again", "日本語 テキスト", "12 34", "\x00 nul", "Ünter ÀÉ×÷ÿ Straße ſharp"]


def table(spark, texts, langs=("en", None), sources=("a", "b", None)):
    return spark.createDataFrame([(None if k == 9 else k // 2, t, langs[k % len(langs)], sources[k % len(sources)], 7, "t", "w", "o") for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    return table(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def plain(v):
    return None if v is None or v != v else int(v) if isinstance(v, (float, np.integer)) else v


def rows(pandas):
    return sorted(str(tuple(plain(v) for v in r)) for r in pandas[sorted(pandas.columns)].astype(object).where(pandas[sorted(pandas.columns)].notna(), None).itertuples(index=False, name=None))


def in_duckdb(query, df):
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pandas(df.select("doc_id", "text", "lang", "source").toPandas(), schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])))
    return con.execute(query).df()


@pytest.mark.parametrize("name,query", [("op12_divergence", sql.DIVERGENCE), ("op13_variants", sql.VARIANTS)])
def test_queries_equal_their_sql(spark, sf, name, query):
    ship(spark)
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/documents.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(query).df()
    assert len(got) and rows(got) == rows(want)


# --- bytes


def test_words_by_bytes():
    for mapped, pattern, low in ((fertility._SPACED, r"[^\x20\x09-\x0D]+", False), (divergence._TERMS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", True)):
        texts = pa.array(ODD)
        found = words(*parts(texts), mapped)
        names = found.names.to_pylist()
        got = [[] for _ in ODD]
        for c, k in zip(found.codes, found.of):
            got[k].append(names[c])
        want = [re.findall(pattern, t or "") for t in ODD]
        lowered = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        assert got == [[w.translate(lowered) for w in ws] if low else ws for ws in want]
    assert words(*parts(pa.array([], pa.string())), fertility._SPACED).codes.size == 0
    big = np.array([0, 5 << 38, 5 << 38, 1])
    n = numbered(big, np.array([3, 4 << 30, 4 << 30, 3]))
    assert n[1] == n[2] and len(set(n.tolist())) == 3


# --- op11


def slow_measures(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    repeated = {i + k for i in range(len(found) - 4) if windows[tuple(found[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    pieces = fertility.Pieces.of(public_tokenizers.path("piece_bpe_32k.model")).model
    ids = [i for w in found for i in pieces.encode(w)]
    chars = sum(map(len, found))
    other = fertility.byte_level(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    share = [c / len(ids) for c in collections.Counter(ids).values()]
    return {
        "n_words": len(found), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(repeated), "n_tokens": len(ids),
        "chars_per_token": chars / max(1, len(ids)), "chars_per_multi_token": chars / max(1, sum(len(other.encode_ordinary(" " + w)) for w in found)),
        "byte_share": sum(pieces.is_byte(i) for i in ids) / max(1, len(ids)), "entropy": -sum(p * math.log2(p) for p in share),
    }


def test_measures_equal_brute_force(spark, odd):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["a b c d e f a b c d e", "a a a a a a", "x\ny\nx\n \n \nx ", "日本𠀀 語の"]
    got = fertility.measured(table(spark, texts).withColumn("doc_id", F.monotonically_increasing_id())).orderBy("doc_id").toPandas()
    for text, row in zip(texts, got.to_dict("records")):
        for k, v in slow_measures(text).items():
            assert row[k] == pytest.approx(v, abs=1e-9), (k, text[:80] if text else text)
    assert got.script.tolist()[:2] == ["latin", "latin"] and got.script[8] == "han" or got.script[8] == "kana"


def test_bands_reject_what_is_unlike_its_language(spark):
    rng = random.Random(1)
    clean = {"en": "the of and a to in is you that it he was for on are as with his they at".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}
    made = [(" ".join(rng.choice(clean[lang]) + str(rng.randint(0, 9)) for _ in range(60)), lang) for lang in clean for _ in range(150)]
    junk = " ".join("".join(rng.choice("QXZJKVW#%") for _ in range(9)) for _ in range(60))
    same = " ".join([f"the{i % 3}" for i in range(7)] + [f"of{i}" for i in range(5)])
    texts = [t for t, _ in made] + [junk] * 400 + [same]
    langs = [g for _, g in made] + ["en"] * 400 + ["xx"]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in fertility.judge(df).collect()}
    assert len(got) == len(texts)
    # 400 copies of one text don't shape the band of their language
    assert all(got[i].kept for i in range(300)) and not any(got[i].kept for i in range(300, 700))
    assert "chars_per_token" in got[300].failed and not got[300].base_failed
    assert got[700].kept  # a class of one text is held against the fixed bands


def test_labelled_junk_is_found_and_clean_text_stays(spark):
    ship(spark)
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op11_fertility"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) >= 0.97


def test_fertility_of_odd_rows(spark, odd, none):
    out = fertility.judge(odd)
    assert [c for c, _ in out.dtypes][:8] == ["doc_id", *fertility.COUNTS, "base_failed", "kept"]
    got = out.collect()
    assert len(got) == len(ODD) and all(r.kept is not None and r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert fertility.judge(none).count() == 0


# --- op12


def slow_audit(docs):
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    df, n, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w, c in collections.Counter(terms(text)).items():
            df[lang, w] += 1
            n[lang, source, w] += c
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for (g, w), c in df.items() if g == lang and c >= 10]
        sources = sorted((s for g, s in groups if g == lang), key=lambda s: s.encode())

        def p(count, total):
            return 1 + 10**9 * (count + 2) // (total + 2 * len(kept))

        total = {s: sum(n[lang, s, w] for w in kept) for s in sources}
        side = {s: {w: p(n[lang, s, w], total[s]) for w in kept} for s in sources}
        whole = {w: p(sum(n[lang, s, w] for s in sources), sum(total.values())) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            parts_ = [("pair", t, sum(f(side[s][w], side[t][w]) for w in kept), 1 << 30) for t in sources if t != s]
            parts_ += [("term", w, f(side[s][w], whole[w]), 10) for w in kept if n[lang, s, w] > 0 and side[s][w] > whole[w]]
            for part in ("pair", "term"):
                ordered = sorted((x for x in parts_ if x[0] == part), key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (_, item, value, most) in enumerate(ordered) if i < most]
    return sorted(out)


def test_audit_equals_term_by_term_sums(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "abcdÉé" for b in "xyZ日"]
    docs = [(" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", "é", None, "\x00"])) for _ in range(200)]
    docs += [("lonely words", "fr", "one"), (None, "fr", "two"), ("x", "es", "one")]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df).collect())
    assert got == slow_audit(docs)


@pytest.mark.parametrize("chunk", [1, 2, 1 << 20])
def test_every_pair_of_counts_is_tallied_once(monkeypatch, chunk):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    cells = [("en", [(1, 3), (2, 5), (4, 3)]), ("en", [(2, 5)]), ("en", [(1, 3), (2, 5)]), ("de", [(1, 3), (2, 5)])]
    batch = pa.RecordBatch.from_arrays([pa.array([g for g, _ in cells]), pa.array([[{"g": a, "n": n} for a, n in c] for _, c in cells], pa.list_(pa.struct([("g", pa.int64()), ("n", pa.int64())])))], names=["lang", "cells"])
    got = collections.Counter()
    for out in divergence.tally(iter([batch])):
        for r in out.to_pylist():
            got[r["lang"], r["a"], r["b"], r["ca"], r["cb"]] += r["m"]
    want = collections.Counter((g, a, b, x, y) for g, c in cells for (a, x), (b, y) in itertools.combinations(c, 2))
    assert got == want and got["en", 1, 2, 3, 5] == 2


def test_counts_beyond_64_bits_on_the_way(spark):
    got = spark.range(1).select(divergence.probability(F.lit(90_000_000_000), F.lit(100_000_000_000), F.lit(1000)).alias("p")).first().p
    assert got == 1 + 10**9 * 90_000_000_002 // 100_000_002_000


def test_divergence_of_odd_rows(spark, odd, none):
    assert rows(divergence.audit(odd).toPandas()) == rows(in_duckdb(sql.DIVERGENCE, odd))
    assert divergence.audit(none).count() == 0


# --- op13


def slow_variants(docs):
    n = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 6
    n = {w: c for w, c in n.items() if c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [v for v in n if v != w and near(w, v)] for w in n}
    form = {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_variants_equal_all_pairs(spark):
    rng = random.Random(4)
    bases = ["".join(rng.choice("aabé") for _ in range(rng.randint(5, 8))) for _ in range(30)]
    docs = []
    for k in range(600):
        out = []
        for _ in range(rng.randint(0, 20)):
            w = rng.choice(bases[: rng.choice((2, 6, 30))])
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                i = rng.randrange(len(w))
                w = rng.choice((w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "é" + w[i + 1 :]))
            out.append(w.upper() if rng.random() < 0.1 and "é" not in w else w)
        docs.append((k % 50 if k % 7 else None, rng.choice((" ", "1", "日")).join(out) if k % 11 else None))
    got = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    want = slow_variants(docs)
    assert got == want and len(want) > 100 and any(r[1] != r[2] and r[1] for r in want) and sum(r[4] for r in want) > 200


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_every_neighbour_is_emitted_once(monkeypatch, chunk):
    monkeypatch.setattr(variants, "CHUNK", chunk)  # long words are cut into stretches of places
    held = np.full(8, 255, np.uint8)  # lets all pass
    alphabet = "abé"
    for word in ("aab", "a", "éaéé", "bbbb"):
        got = [w for _, w in variants.neighbours([word], alphabet, held)]
        cut = {word[:i] + word[i + 1 :] for i in range(len(word))}
        put = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
        new = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet} - {word}
        assert len(got) == len(set(got)) and set(got) == cut | put | new


def test_hashes_of_neighbours_are_those_of_words():
    rng = random.Random(6)
    for _ in range(200):
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
        bits = 1 << 20
        near = {w for _, w in variants.neighbours([word], "abcé", np.full(bits // 8, 255, np.uint8))}
        target = rng.choice(sorted(near))
        held = np.zeros(bits // 8, np.uint8)
        for _, points in variants.by_length([target]):
            for probe in range(variants.PROBES):
                bit = int(variants.bits_of(variants.sums(points)[:, -1], bits, probe)[0])
                held[bit >> 3] |= 1 << (bit & 7)
        assert target == "" or target in {w for _, w in variants.neighbours([word], "abcé", held)}


def test_variants_of_odd_rows(spark, odd, none):
    assert rows(variants.group_variants(odd).toPandas()) == rows(in_duckdb(sql.VARIANTS, odd))
    assert variants.group_variants(none).count() == 0


# --- op1 and op6: what must not depend on shares of the texts or on the cluster


def test_pairs_of_rare_words_are_learned():
    from lodex.llm import toxicity

    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(8000):
        own = set(rng.integers(100, 400, 12).tolist())
        a, b = i % 100 < 2, i % 100 in (1, 2)  # each in 2 % of the texts, both in 1 %
        own |= ({1} if a else set()) | ({2} if b else set())
        rows.append(np.array(sorted(own)))
        # alone either of them is as often toxic as any text
        labels.append(float(a and b) if a and b else float(rng.random() < 0.12))
    kept = set(toxicity.choose(rows, np.array(labels), 10).tolist())
    assert {1, 2} <= kept and len(kept) < 40
    assert toxicity.PAIR_SHARE <= 0.01


def test_pairs_are_those_of_all_counts(monkeypatch):
    from lodex.llm import toxicity

    monkeypatch.setattr(toxicity, "PAIR_BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(60) < 0.15) for _ in range(600)]
    labels = np.array([float({3, 7} <= set(r) or {11, 40} <= set(r) or rng.random() < 0.05) for r in rows])
    got = set(toxicity.choose(rows, labels, 6).tolist())
    n, p, want = len(rows), labels.mean(), set()
    has = np.array([[c in set(r) for c in range(60)] for r in rows])
    chi = lambda m: float(toxicity.chi_squared(np.array([labels[m].sum()]), np.array([m.sum()]), n, p)[0])
    for a in range(60):
        if chi(has[:, a]) > toxicity.ALONE and has[:, a].sum() >= toxicity.LEAST_ROWS:
            want.add(a)
        for b in range(a + 1, 60):
            m = has[:, a] & has[:, b]
            if m.sum() >= toxicity.LEAST_ROWS and labels[m].sum() > m.sum() * p and chi(m) > toxicity.TOGETHER + 2 * max(chi(has[:, a]), chi(has[:, b])):
                want |= {a, b}
    assert got == want and {3, 7, 11, 40} <= got


def test_neighbours_of_many_shards(spark, monkeypatch):
    from lodex.llm import neighbours

    monkeypatch.setattr(neighbours, "FEW_ROWS", 500)
    rng = np.random.default_rng(9)
    xs = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "id long, vec array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.search(df, F.col("id") % 50 == 0).collect()}  # six shards
    d = ((xs[::50, None] - xs[None]) ** 2).sum(axis=2)
    want = {(50 * q, int(v)) for q in range(60) for v in [x for x in np.argsort(d[q]) if x != 50 * q][:10]}
    assert len(got & want) / len(want) >= 0.9 and len(got) == 600
