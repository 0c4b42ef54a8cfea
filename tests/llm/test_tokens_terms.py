import math
import os
import random

import pytest

from marlstone.llm import terms, tokens
from marlstone.llm.posts import distinct_posts

SUBS = "id string, title string, selftext string, r string, term string, length int"


def subs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SUBS)


def test_best_body_wins(spark):
    rows = [("a", "T", "[removed]"), ("a", "T", "body"), ("b", "T", " [deleted] "), ("c", None, None), (None, "T", "x"), ("a", "T", "body"), ("d", "T", ""), ("d", "T", None)]
    got = {r["id"]: (r["title"], r["selftext"]) for r in distinct_posts(subs(spark, rows)).collect()}
    assert got == {"a": ("T", "body"), "b": ("T", " [deleted] "), "c": (None, None), "d": ("T", "")}


def test_scores_follow_the_formula(spark):
    posts = distinct_posts(subs(spark, [("1", "zyx zyx zyx", "lamp"), ("2", "zyx", "lamp lamp"), ("3", None, ""), ("4", "é_1 日本語", "A b")]))
    got = {(r["id"], r["term"]): r for r in terms.distinctiveness(posts).collect()}
    mean, rate = 9 / 4, 4 / 4
    tfn = 3 * math.log2(1 + mean / 4)
    assert got["1", "zyx"]["score"] == pytest.approx((math.log2(1 + rate) + tfn * math.log2((1 + rate) / rate)) / (1 + tfn))
    assert ("4", "日本語") in got and ("4", "é_1") in got and ("4", "a") not in got and got["1", "zyx"]["df"] == 2
    assert [(r["id"], r["term"]) for r in terms.distinctive_terms(terms.distinctiveness(posts)).collect()] == [("1", "zyx")]


def test_common_terms_join_the_same_way(spark, monkeypatch):
    rows = [(str(i), f"all w{i % 7} w{i % 3}", "all " * (i % 4)) for i in range(60)]
    posts = distinct_posts(subs(spark, rows))
    plain = {tuple(r) for r in terms.distinctiveness(posts).collect()}
    monkeypatch.setattr(terms, "COMMON", 8)
    assert {tuple(r) for r in terms.distinctiveness(posts).collect()} == plain


def test_empty_and_very_long_texts(spark):
    assert terms.distinctiveness(distinct_posts(subs(spark, []))).count() == 0
    assert terms.distinctiveness(distinct_posts(subs(spark, [("a", None, " ")]))).count() == 0
    long = distinct_posts(subs(spark, [("a", "x" * 200_000, "word " * 100_000)]))
    assert {r["tf"] for r in terms.distinctiveness(long).collect()} == {1, 100_000}


needs_files = pytest.mark.skipif(not os.path.exists(f"{tokens.DEFAULT_DIR}/byte_bpe_50k.tiktoken"), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PIECES, mergeable_ranks=tokens.load_ranks("byte_bpe_50k"), special_tokens={})


def random_text(rnd):
    parts = ["a", "b", " ", "the ", "é", "\n", "日本", "12", "!!", "<|endoftext|>", "’s", "'ll", "'", "ab", "ing", "\t", "​", "🙂", "  ", "Ünï"]
    return "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50)))


@needs_files
def test_ids_equal_the_reference_encoder(reference):
    coder, rnd = tokens.encoder("byte_bpe_50k"), random.Random(2)
    for text in [random_text(rnd) for _ in range(600)] + ["a" * 20_000, "ab " * 9_000, "=" * 700, " " * 900]:
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert tokens.decode(ids) == text


@needs_files
def test_edits_and_appends(reference):
    coder, rnd = tokens.encoder("byte_bpe_50k"), random.Random(3)
    for _ in range(600):
        old = random_text(rnd)
        at = rnd.randint(0, len(old))
        new = old[:at] + rnd.choice(["", "x", " ", "'l", "12"]) + old[at + rnd.randint(0, 2) :]
        assert coder.reencode(old, coder.encode(old), new) == reference.encode_ordinary(new)
    table, raw = tokens.PrefixTable(coder), "appending".encode()
    for b in raw:
        table.append(bytes([b]))
        assert table.ids() == reference.encode_ordinary(bytes(table.text).decode())
    table.truncate(6)
    table.append(b"dix")
    assert table.ids() == reference.encode_ordinary("appenddix")


@needs_files
def test_corpus_with_nulls(spark, reference):
    docs = spark.createDataFrame([(1, None, "i"), (2, "", "i"), (3, "<|endoftext|> x", "i"), (None, "a", "i"), (3, "<|endoftext|> x", "i")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode_corpus(docs).collect()]
    assert got == [(1, []), (2, []), (3, reference.encode_ordinary("<|endoftext|> x")), (None, reference.encode_ordinary("a")), (3, reference.encode_ordinary("<|endoftext|> x"))]
    assert tokens.encode_corpus(docs.limit(0)).count() == 0
    assert tokens.token_totals(tokens.encode_corpus(docs)).first()["n_docs"] == 5
