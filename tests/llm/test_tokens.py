"""Periodic runs, alignment of two tokenizers and token files against brute force and on hard rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.llm import alignment, catalog, periodic, tokenfiles
from tablewright.llm.arrow import free_names, spans
from tablewright.session import scratch_path
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, rows, extra):
    """Rows (doc_id, text) with extra columns whose names clash with those of the operators."""
    fields = "doc_id long, text string" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *[f"my {c}" for c in extra]) for r in rows], fields)


def test_names_that_are_taken_get_underscores(spark):
    df = spark.createDataFrame([(1, 2)], "a int, B_ int")
    assert free_names(df, ["a", "b", "b_", "a"]) == ["a_", "b", "b__", "a__"]
    column = pa.array(["x" * 5, None, "", "y" * 50, "z"])
    assert list(spans(column, 6)) == [(0, 3), (3, 1), (4, 1)]


# periodic runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            smaller = any(all(w[k] == w[k - p] for k in range(start + p, start + length)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


loops = st.builds(
    lambda head, loop, times, cut, tail: head + (loop * times)[: len(loop) * times - cut] + tail,
    st.lists(st.sampled_from("ab"), max_size=6), st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 8), st.lists(st.sampled_from("abz"), max_size=6),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), loops, st.lists(st.sampled_from("ab"), max_size=60)), max_size=5), st.sampled_from([" ", "\n\t ", "\x0b"]))
def test_runs_are_those_of_brute_force(texts, gap):
    column = pa.array([None if t is None else gap.join(["", *t]) for t in texts], pa.string())
    runs, rest = periodic._runs_of(column, periodic.RunOptions())
    for t, r, c in zip(texts, runs.to_pylist(), rest.to_pylist()):
        want = brute_runs(t or [])
        assert [(x["start"], x["length"], x["period"]) for x in r] == want
        assert c == collapsed(t or [], want)


def test_runs_of_many_periods_in_long_texts():
    """One repeated word, and long loops of words that are in short loops themselves, at a million words."""
    n = 1_000_000
    runs = periodic.find(np.zeros(n, np.int64), n, periodic.RunOptions())
    assert runs.tolist() == [[0, n, 1]]
    words = np.tile(np.r_[np.zeros(99, np.int64), 1], n // 100)
    runs = periodic.find(words, n, periodic.RunOptions())
    assert len(runs) == 1 + n // 100 and [0, n, 100] in runs.tolist()
    with pytest.raises(ValueError):
        periodic.RunOptions(min_exponent=3)


@pytest.mark.parametrize("exponent", [4, 5, 9])
def test_every_lag_is_in_one_level(exponent):
    lags = [q for m, low, high in periodic.levels(5000, exponent) for q in range(low, high + 1) if 2 * q <= m <= 3 * q]
    assert lags == list(range(1, len(lags) + 1)) and len(lags) >= 5000 // exponent


def test_runs_on_hard_rows(spark):
    loop = "a b c " * 5
    rows = [(1, None), (2, ""), (3, " \n"), (None, loop), (4, loop), (4, loop), (5, "x " * 200_000 + "y"), (6, "\x1c \x1c\xa0 " * 4)]
    docs = rows_of(spark, rows, ["runs", "Collapsed", "start", "n"])
    found = periodic.find_runs(docs)
    assert found.columns == [*docs.columns, "runs_", "collapsed_"]
    got = {(r["doc_id"], r["text"]): r for r in found.collect()}
    assert got[4, loop]["runs"] == "my runs" and [tuple(x) for x in got[4, loop]["runs_"]] == [(0, 15, 3)] and got[4, loop]["collapsed_"] == "a b c"
    assert got[None, loop]["runs_"] == got[4, loop]["runs_"]
    assert [tuple(x) for x in got[5, rows[6][1]]["runs_"]] == [(0, 200_000, 1)] and got[5, rows[6][1]]["collapsed_"] == "x y"
    assert all(got[i, t]["runs_"] == [] and got[i, t]["collapsed_"] == "" for i, t in rows[:3])
    assert len(got[6, rows[7][1]]["runs_"]) == 1  # white space beyond ASCII is part of words
    assert found.count() == len(rows) and periodic.find_runs(docs.limit(0)).count() == 0


def test_longest_run_and_its_ties(spark):
    df = spark.createDataFrame([([(5, 8, 2), (1, 8, 2), (1, 8, 1), (0, 6, 1)],), ([],)], "r array<struct<start:long,length:long,period:long>>")
    assert [tuple(x[0]) if x[0] else None for x in df.select(periodic.longest_run("r")).collect()] == [(1, 8, 1), None]


def test_query_of_runs_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in catalog.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if len(w) > 400:  # brute force is cubic; long texts are in the SQL
            continue
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        runs = brute_runs(w)
        assert got[i]["n_runs"] == len(runs)
        assert got[i]["runs_sha256"] == hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in runs).encode()).hexdigest()
        assert got[i]["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (got[i]["start"], got[i]["length"], got[i]["period"]) == (best or (None, None, None))
        assert got[i]["exponent_milli"] == (1000 * best[1] // best[2] if best else None)


# alignment

SIDES = alignment.AlignOptions(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(SIDES.first_path)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=SIDES.second_path)


def brute_alignment(text, libraries):
    """(tokens of a, of b, groups, links, groups as text, count of each pair), None without tokens."""
    first, second = libraries
    if not text:
        return None
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    spelt_a = [bytes(byte[c] for c in first.id_to_token(i)) for i in a]
    spelt_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
        return None

    def ranges(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends))

    ra, rb = ranges(spelt_a), ranges(spelt_b)
    links = Counter((a[i], b[j]) for i, (x, y) in enumerate(ra) for j, (u, v) in enumerate(rb) if x < v and u < y)
    common = sorted({y for _, y in ra} & {v for _, v in rb})
    groups, low = [], 0
    for end in common:
        inside = lambda ids, rs: ",".join(str(i) for i, (_, y) in zip(ids, rs) if low < y <= end)  # noqa: B023, E731
        groups.append(f"{inside(a, ra)}|{inside(b, rb)}")
        low = end
    return len(a), len(b), len(common), sum(links.values()), ";".join(groups), links


PARTS = [*"abcdeé'st \n\t.,12Ωß", "́", "\x0b", "\x1c", "\x85", "\xa0", "　", " ", "​", "ﬁ", "<|endoftext|>", "<s>", "</s>", "▁", " the", " an", "  ", "😀", "€", "\x00", "naïve", "  \n x"]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=25).map("".join), st.text(max_size=20)), max_size=6))
@pytest.mark.parametrize("apart", [True, False])
def test_alignment_equals_brute_force(apart, libraries, texts):
    aligner = alignment._aligner(SIDES)
    assert aligner.a.apart and aligner.b.apart
    if not apart:  # as with tokenizers whose tokens cross blanks
        aligner = alignment.Aligner.__new__(alignment.Aligner)
        aligner.__dict__.update(alignment._aligner(SIDES).__dict__, apart=False)
    columns = [c.to_pylist() for c in alignment._columns(texts, aligner)]
    for text, *got in zip(texts, *columns):
        want = brute_alignment(text, libraries)
        if want is None:
            assert got == [0, 0, 0, 0, "", []]
        else:
            assert tuple(got[:5]) == want[:5] and {(x["a"], x["b"]): x["n"] for x in got[5]} == want[5]


@pytest.mark.parametrize("broadcast_bytes", [48 << 20, 64, 0])
def test_support_of_links_with_and_without_a_broadcast(spark, libraries, broadcast_bytes):
    rows = [(k, t) for k, t in enumerate(["the cat", "the cat sat", "naïve the", None, "", "x▁y", "the cat", " lead", "tail "])] + [(None, "the end"), (1, "the cat sat")]
    docs = rows_of(spark, rows, ["n_a", "n_best", "pairs", "row", "count", "best", "a", "_b"])
    found = alignment.align_texts(docs, SIDES)
    assert found.columns[-6:] == ["n_a_", "n_b", "n_groups", "n_links", "groups", "pairs_"]
    out = alignment.link_support(found, "pairs_", broadcast_bytes)
    got = sorted(((r["doc_id"], r["groups"], r["n_best_"], r["count_sum"], r["pairs"], r["_b"]) for r in out.collect()), key=repr)
    per = [(i, brute_alignment(t, libraries)) for i, t in rows]
    total = sum((p[5] for _, p in per if p), Counter())
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    want = []
    for i, p in per:
        links = p[5] if p else {}
        want.append((i, p[4] if p else "", sum(n for x, n in links.items() if total[x] == most[x[1]]), sum(n * total[x] for x, n in links.items()), "my pairs", "my _b"))
    assert got == sorted(want, key=repr)
    assert alignment.link_support(alignment.align_texts(docs.limit(0), SIDES), "pairs_").count() == 0


def test_alignment_of_long_texts(spark, libraries):
    random.seed(4)
    long = "".join(random.choice(["word", "Ω", " ", "x", "\n"]) for _ in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, "z" * 100_000), (3, " " * 20_000 + "a")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.align_texts(docs, SIDES).collect()}
    assert got[3]["groups"] == brute_alignment(" " * 20_000 + "a", libraries)[4]
    first, second = libraries
    assert got[1]["n_a"] == len(first.encode(" " + long, add_special_tokens=False).ids) and got[1]["n_b"] == len(second.encode(long))
    assert got[2]["n_a"] == len(first.encode(" " + "z" * 100_000, add_special_tokens=False).ids)


def test_query_of_alignment_equals_brute_force(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in catalog.op12_alignment(spark, SF).collect()}
    # the links of long texts are too many for brute force, so the total comes from the operator there
    pairs = alignment.align_texts(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), SIDES)
    total = {(r["a"], r["b"]): r["n"] for r in pairs.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    assert len(got) == len(docs)
    for i, text in docs:
        if text and len(text) > 3000:
            continue
        p, r = brute_alignment(text, libraries), got[i]
        if p is None:
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == (0, 0, 0, 0, 0, 0, "")
            continue
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == p[:4]
        assert r["groups_sha256"] == hashlib.sha256(p[4].encode()).hexdigest()
        assert r["n_best"] == sum(n for x, n in p[5].items() if total[x] == most[x[1]]) and r["count_sum"] == sum(n * total[x] for x, n in p[5].items())


# token files

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_bits_round_trip(bits, numbers):
    ids = np.array(numbers, "<u4") & np.uint32((1 << bits) - 1 if bits < 32 else 0xFFFFFFFF)
    data = tokenfiles.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8) and tokenfiles.unpack(data, bits, len(ids)).tolist() == ids.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=12), st.integers(1, 17), st.integers(1, 9), st.data())
def test_any_stretch_of_a_file_can_be_read(sizes, bits, block, data):
    ids = np.random.default_rng(len(sizes)).integers(0, 1 << bits, sum(sizes)).astype("<u4")
    keys = pa.array([None if k == 0 else f"k{k}" for k in range(len(sizes))], pa.string())
    file = tokenfiles.TokenFile(tokenfiles.file_image(keys, ids, np.array(sizes, np.int64), bits, block, 3, 17) + b"\n")
    assert (file.part, file.before, file.keys().to_pylist()) == (3, 17, keys.to_pylist())
    start = data.draw(st.integers(0, len(ids)))
    n = data.draw(st.integers(0, len(ids) - start))
    assert file.ids(start, n).tolist() == ids[start : start + n].tolist()
    ends = np.cumsum([0, *sizes])
    assert all(file.document(k).tolist() == ids[ends[k] : ends[k + 1]].tolist() for k in range(len(sizes)))
    with pytest.raises(IndexError):
        file.ids(0, len(ids) + 1)


def test_broken_files_are_refused():
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(b"x" * 200)
    image = tokenfiles.file_image(pa.array([1]), np.arange(9, dtype="<u4"), np.array([9]), 4, 4, 0, 0)
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(image[:-1])


PIECES = [*"ab zé'st'Ré\n\t.,1２Ωß", "́", "̧", "\x0b", "\x1c", "\x85", "\xa0", "　", " ", "ﬁ", "İ", "Σ", "<", "|", ">", "<|endoftext|>", "<|ENDOFTEXT|>.", "<|startoftext|>", "'S", "H̱", "J̌", "क़", "각", "ⅷ", "²", "word.", "Word!?"]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=25).map("".join), st.text(max_size=30)), max_size=5))
def test_remembered_words_have_the_ids_of_the_library(word_library, texts):
    encode = tokenfiles.encoder(WORDS)
    assert encode.apart
    for text, ids in zip(texts, encode(pa.array(texts, pa.string()))):
        assert ids.tolist() == word_library.encode(text or "", add_special_tokens=False).ids


def test_other_tokenizer_files_are_encoded_whole():
    from tokenizers import Tokenizer

    path, text = public_tokenizers.path("byte_bpe_50k.json"), "two  words\n and <|endoftext|> more"
    encode = tokenfiles.encoder(path)
    assert not encode.apart and encode(pa.array([text, None]))[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_files_hold_all_documents_in_order(spark, word_library):
    rows = [(None, "no key"), (7, None), (3, ""), (5, "five five"), (5, "again"), (5, "five five"), (-2, "minus"), (9, "w " * 30_000)] + [(100 + k, f"text {k}") for k in range(60)]
    docs = rows_of(spark, rows, ["key", "part", "n", "bits", "start", "path"]).repartition(5)
    options = tokenfiles.FileOptions(WORDS, block_ids=64, file_bytes=30, ranges=6)
    assert options.bits() == 16
    folder = scratch_path(spark, "ids")
    tokenfiles.write_files(docs, folder, options)
    found = tokenfiles.with_starts(tokenfiles.read_documents(spark, folder)).orderBy("start").collect()
    heads = tokenfiles.manifest(spark, folder)
    assert heads.count() > 10
    assert [r["key"] for r in found] == sorted([r[0] for r in rows], key=lambda k: (k is not None, k))
    want = Counter((i, tuple([*word_library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    assert Counter((r["key"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in found) == want
    everything = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in found])
    at = 0
    for r in found:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]) // 4, zlib.crc32(bytes(r["ids"])))
        at += r["n_tokens"]
    for start, n in ((0, 5), (3, 300), (at - 7, 7), (31_000, 0), (11, at - 11)):
        parts = sorted((r["start"], bytes(r["ids"])) for r in tokenfiles.read_ids(spark, heads, start, n).collect())
        assert np.frombuffer(b"".join(p for _, p in parts), "<u4").tolist() == everything[start : start + n].tolist()


def test_empty_table_and_text_keys(spark):
    folder = scratch_path(spark, "ids")
    tokenfiles.write_files(spark.createDataFrame([], "doc_id string, text string"), folder, tokenfiles.FileOptions(WORDS))
    assert tokenfiles.with_starts(tokenfiles.read_documents(spark, folder, "string")).count() == 0
    folder = scratch_path(spark, "ids")
    docs = spark.createDataFrame([("b", "x"), ("a", "y y"), (None, "z")], "name string, body string")
    tokenfiles.write_files(docs, folder, tokenfiles.FileOptions(WORDS, closing_id=None), "name", "body")
    got = tokenfiles.with_starts(tokenfiles.read_documents(spark, folder, "string", ids=False)).orderBy("start").collect()
    assert [(r["key"], r["start"], r["n_tokens"]) for r in got] == [(None, 0, 1), ("a", 1, 2), ("b", 3, 1)]
    with pytest.raises(Exception, match="in a vocabulary of"):
        tokenfiles.write_files(docs, scratch_path(spark, "ids"), tokenfiles.FileOptions(WORDS, vocabulary=100), "name", "body")


def test_query_of_token_files_equals_the_library(spark, word_library):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in catalog.op13_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    start, want = 0, []
    for i, text in docs:
        ids = [*word_library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
