import random

import numpy as np
import pytest

from marlstone.llm import leaks, spans

DOCS = "doc_id long, text string, item_id string, doc string"
ITEMS = "item_id long, text string, names string"
ITEM = "Question: how many brass bells does the keeper of Millvane weigh before the long rain if 12 were lost at dawn?"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)


def items(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], ITEMS)


def pairs(hits):
    return {tuple(r) for r in leaks.verbatim_leaks(hits).collect()}


def test_twelve_words_and_not_eleven(spark):
    w = leaks.words_of(ITEM)
    texts = [" ".join(w[3:15]), " ".join(w[3:14]), "foo " + " ".join(w[3:15]).upper() + " bar", "*" + ",\n".join(w[2:14]) + "*", None, "", "​".join([" ".join(w[5:17])]), " ".join(w[3:9]) + " x " + " ".join(w[9:15])]
    assert pairs(leaks.template_hits(docs(spark, texts), items(spark, [ITEM, None, "", "too short"]))) == {(0, 0), (2, 0), (3, 0), (6, 0)}


def test_format_characters_do_not_end_a_word(spark):
    broken = ITEM.replace("keeper", "kee­per").replace("brass", "br​ass").replace("Millvane", "Mill⁠vane")
    assert pairs(leaks.template_hits(docs(spark, [broken]), items(spark, [ITEM]))) == {(0, 0)}


def test_other_numbers_and_names_are_templates(spark):
    changed = ITEM.replace("Millvane", "Stonemere").replace("12", "40")
    hits = leaks.template_hits(docs(spark, [changed]), items(spark, [ITEM, "At noon the dyer of Stonemere slept and 40 bells rang."])).collect()
    assert [(r["doc_id"], r["item_id"], r["verbatim_windows"] < r["renamed_windows"]) for r in hits] == [(0, 0, True)]


def test_slots_must_be_consistent():
    assert leaks.consistent(["a", "b", "a"], ["x", "y", "x"])
    assert not leaks.consistent(["a", "b", "a"], ["x", "y", "z"]) and not leaks.consistent(["a", "b"], ["x", "x"])


def test_against_brute_force_and_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = "red old big Lamp 7 9 km door of the in Rome".split()
    its = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 30))) for _ in range(25)]
    ds = [" ".join([rnd.choice(vocabulary) for _ in range(20)] + its[rnd.randrange(25)].split()[rnd.randint(0, 4) :] + [rnd.choice(vocabulary) for _ in range(9)]) for _ in range(60)]
    want = set()
    for a, t in enumerate(ds):
        w = leaks.words_of(t)
        mine = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for b, s in enumerate(its):
            v = leaks.words_of(s)
            if any(tuple(v[i : i + 12]) in mine for i in range(len(v) - 11)):
                want.add((a, b))
    assert pairs(leaks.template_hits(docs(spark, ds), items(spark, its))) == want
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 60)
    assert pairs(leaks.template_hits(docs(spark, ds), items(spark, its))) == want


def test_empty_tables(spark):
    assert leaks.template_hits(docs(spark, []), items(spark, [ITEM])).count() == 0
    assert leaks.template_hits(docs(spark, [ITEM]), items(spark, [])).count() == 0


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, e in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if c == e else 0
            best = max(best, row[j])
    return best


def corpus():
    rnd = random.Random(6)
    letters = "abcdefgh éß日🙂\n"
    make = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    core = make(900)
    texts = [make(700) for _ in range(6)]
    texts += [make(200) + core[100:500] + make(90), core[101:501], make(5) + core[100:499] + make(5), core, core, core[:450] + make(30)]
    texts += [make(150) + core[500:] + make(20), "x" * 1000, "x" * 401 + "y", "z" * 399, None, "", texts[0] + texts[0], core[380:800]]
    return texts


def test_pairs_equal_brute_force(spark):
    texts = corpus()
    got = {tuple(r) for r in spans.shared_pairs(docs(spark, texts)).collect()}
    want = {(a, b) for b in range(len(texts)) for a in range(b) if texts[a] and texts[b] and min(len(texts[a]), len(texts[b])) >= 400 and longest(texts[a], texts[b]) >= 400}
    assert got == want


def test_large_sets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "SHARD_CHARS", 1500)
    monkeypatch.setattr(spans, "PIECE_CHARS", 600)
    test_pairs_equal_brute_force(spark)


def test_shares_equal_brute_force(spark):
    texts = corpus()
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in spans.shared_share(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        held = np.zeros(len(t or ""), bool)
        others = [s for j, s in enumerate(texts) if j != i and s]
        for a in range(max(0, len(t or "") - 399)):
            if any(t[a : a + 400] in s for s in others):
                held[a : a + 400] = True
        assert got[i] == (len(t or ""), int(held.sum())), i


def test_shares_of_large_sets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spans, "SHARD_CHARS", 1500)
    monkeypatch.setattr(spans, "PIECE_CHARS", 600)
    test_shares_equal_brute_force(spark)


def test_a_banner_in_many_documents(spark):
    rnd = random.Random(2)
    make = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    banner = make(450)
    texts = [make(250) + "#" + banner + "#" + make(150) for _ in range(3000)]
    got = spans.shared_share(docs(spark, texts)).toPandas()
    assert len(got) == 3000 and got["shared_chars"].between(452, 480).all()


def test_templates_do_not_depend_on_blocks(spark, monkeypatch):
    names = "Anna Peter Nadia Oskar Mia Jonas".split()
    asked = [f"Yesterday the baker {n} sold {i + 3} loaves to {names[i - 1]} and kept {i + 9} of them for the {'week' if i % 2 else 'day'}" for i, n in enumerate(names)]
    texts = [t + " and more" for t in asked] + [asked[0].replace("Anna", "Jonas").replace("3", "88"), "nothing here", None]
    both = [docs(spark, texts), items(spark, asked)]
    whole = sorted(map(tuple, leaks.template_hits(*both).collect()))
    assert any(r[3] for r in whole) and any(r[2] for r in whole)
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 25)
    assert sorted(map(tuple, leaks.template_hits(*both).collect())) == whole


def test_anchors_are_shared_by_any_long_stretch():
    rnd = random.Random(8)
    for _ in range(40):
        core = "".join(rnd.choice("abc") for _ in range(400))
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 300))) for _ in range(2))
        x, y = spans.anchors(a + core + b)[0], spans.anchors(b + core + a)[0]
        assert set(x.tolist()) & set(y.tolist())


@pytest.mark.parametrize("n", [0, 399])
def test_short_texts_have_no_anchor(n):
    assert len(spans.anchors("a" * n)[0]) == 0


def test_spans_of_empty_input(spark):
    assert spans.shared_pairs(docs(spark, [])).count() == 0 and spans.shared_share(docs(spark, [None, ""])).count() == 2
    assert spans.shared_stretches(docs(spark, ["q" * 500])).count() == 0
