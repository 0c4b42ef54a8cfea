import random

import numpy as np
import pytest

from marlstone.llm import abuse, personal

POSTS = "id string, title string, selftext string, kind string, score int"


def posts(spark, texts):
    return spark.createDataFrame([(f"p{i}", t, b, "x", 1) for i, (t, b) in enumerate(texts)], POSTS)


@pytest.mark.parametrize(
    "text, kind, start",
    [
        ("write to jo.doe+x@mail.example now", "email", 9),
        ("write to jo [at] mail [dot] example", "email", 9),
        ("write to jo at mail dot example", "email", 9),
        ("call +44 20 7946 0367 today", "phone", 5),
        ("call (212) 555-0147 today", "phone", 5),
        ("call 2 1 2 five five five 0 1 4 7 ok", "phone", 5),
        ("ring 07700 900123.", "phone", 5),
        ("my ssn is 123-45-6789, ok", "id_number", 10),
        ("national no. QQ 12 34 56 C leaked", "id_number", 13),
        ("come to Flat 3, 12 Rose Garden Lane now", "address", 8),
        ("sent to PO Box 123, Foo", "address", 8),
        ("wohnt in der Rosenstraße 12a hier", "address", 13),
        ("au 12 rue Victor Hugo ici", "address", 3),
        ("ask Dr. Smith about it", "name", 8),
        ("ask Mrs Anna van Dyke there", "name", 8),
    ],
)
def test_certain_forms(text, kind, start):
    assert (start, kind) in {(c[0], c[2]) for c in personal.candidates(text) if c[3]}


@pytest.mark.parametrize("text", ["I got 3 @ 13.50 each", "it ran on 2019-03-23 14:22:10", "version 10.4.24.1", "asked @brisk_otter", "isbn 978-0-00-236419-2", "order 4471-2290-31", "the Copper Finch keyboard", "Level 19 of the Rose Lane map", ""])
def test_no_certain_form(text):
    assert not [c for c in personal.candidates(text) if c[3]]


@pytest.mark.parametrize(
    "text, kind, start",
    [
        ("call zero two oh five five five one two three four tonight.", "phone", 5),
        ("call zero two oh five five five one two three four tonight. " + "and so on " * 20 + "7", "phone", 5),
        ("RING SEVEN SEVEN OH NINE ONE TWO THREE", "phone", 5),
        ("ring ſeven ſeven oh nıne one two three", "phone", 5),
        ("JANE.ROE [AT] MAIL [DOT] EXAMPLE", "email", 0),
        ("jane AT mail DOT example", "email", 0),
        ("so: jane At mail Dot example", "email", 4),
        ("by 12 " + "Ros" + "e" * 90 + " Garden Lane now", "address", 3),
        ("Calle de la Virgen Siete Revueltas Mayores, nº 12", "address", 0),
    ],
)
def test_whole_texts_are_searched(text, kind, start):
    assert (start, kind) in {(c[0], c[2]) for c in personal.candidates(text) if c[3]}


WORDS = (
    "12 3a 007 Flat Apt no. N. Rose Green Lane Street st. Calle de la del Via rue du bis Garden PO Box P.O. Postfach Rosenstraße weg 5,Rome n.º É Mr. Dr Señora M. van VON DYKE, Anna J. O'Neil McKay "
    "one two ONE oh sıx ſeven at AT [at] (AT) dot DOT [dot] mail.example jane @ a@b.co +44 (212) 555-0147 1:2 . , ( - \n \t C/ x".split(" ")
)


def test_prefilters_lose_nothing():
    rnd = random.Random(11)
    for _ in range(4000):
        text = "".join(rnd.choice(WORDS) + rnd.choice([" "] * 6 + ["", "\n", "  ", "-"]) for _ in range(rnd.randint(1, 40)))
        low = text.lower()
        runs = [m.span() for m in personal._DIGITS.finditer(text)]
        spans = lambda rx, parts: [m.span() for a, b in parts for m in rx.finditer(text, a, b)]
        near = personal.near_numbers(text, runs)
        hinted = [(a, b) for a, b in near if personal._STREET_HINT.search(text[a:b].lower().translate(personal._FOLD))]
        whole = [(0, len(text))]
        assert spans(personal.ADDRESS, hinted) == spans(personal.ADDRESS, whole), text
        assert spans(personal.LOOSE_ADDRESS, hinted) == spans(personal.LOOSE_ADDRESS, whole), text
        assert spans(personal.NUMBERED_NAME, near) == spans(personal.NUMBERED_NAME, whole), text
        assert [m.span() for m in personal.numbers(text, runs)] == spans(personal.NUMBER, whole), text
        assert personal.may_have_email(text, low) or not personal.EMAIL.search(text), text
        assert personal.may_be_spoken(low, sum(b - a for a, b in runs)) or not personal.SPOKEN.search(text), text
        assert personal._NAME_HINT.search(text) or not any(rx.search(text) for rx in (personal.TITLED, personal.FULL, personal.REVERSED)), text


def test_street_words_lose_no_address():
    rnd = random.Random(12)
    places = [x for y in (personal.STREETS, personal.STREET_ENDS, personal.STREETS_BEFORE, personal.STREETS_FRENCH, personal.BOXES) for x in y]
    for _ in range(6000):
        words = [rnd.choice([rnd.choice(WORDS), rnd.choice(places), rnd.choice(places).upper(), "Haupt" + rnd.choice(personal.STREET_ENDS), "Ada", "Löwen", str(rnd.randint(1, 99999))]) for _ in range(rnd.randint(2, 25))]
        text = "".join(w + rnd.choice([" "] * 8 + [", ", "", "\n", "-"]) for w in words)
        if personal._folds(text):
            continue
        runs = [m.span() for m in personal._DIGITS.finditer(text)]
        near = personal.near_numbers(text, runs)
        hinted = [x for x in near if personal.may_have_street(text.lower(), runs, *x)]
        for rx in (personal.ADDRESS, personal.LOOSE_ADDRESS):
            assert [m.span() for x in hinted for m in rx.finditer(text, *x)] == [m.span() for m in rx.finditer(text)], text


def test_addresses_are_not_tried_where_no_street_is(monkeypatch):
    tried = []

    class Spy:
        def __init__(self, rx):
            self.rx = rx

        def finditer(self, text, a, b):
            tried.append(text[a:b])
            return self.rx.finditer(text, a, b)

    for name in ("ADDRESS", "LOOSE_ADDRESS"):
        monkeypatch.setattr(personal, name, Spy(getattr(personal, name)))
    assert not personal.candidates("just watched 3 of the best first drafts, placed 20 days away from closing")
    assert not tried
    assert {c[2] for c in personal.candidates("just watched 3 drafts at 20 Abbey Road today")} == {"address"} and tried


def test_seeds_and_emails_are_scored_in_the_graph(spark, monkeypatch):
    rows = [(f"write me at once: jo{i}@mail.example please", None) for i in range(40)] + [("write me at once: ann at mail.example please", "look at news.example for more")]
    got = personal.personal_spans(posts(spark, rows)).toPandas()
    assert len(got) == 41 and set(got["kind"]) == {"email"} and (got["field_name"] == "title").all()
    assert got["score"].between(0.9, 1).all() and (got["score"] < 1).any()
    monkeypatch.setattr(personal, "NAMES_AT_ONCE", 1)
    names = spark.createDataFrame([("anna", 0.9, 5), ("kofi", 0.9, 5), ("low", 0.1, 9)], "given string, g double, seen long")
    late = personal.find_learned_names(posts(spark, [("by anna smith and KOFI MENSAH", "low hanging fruit")]), names)
    assert {(r["start_pos"], r["given"]) for r in late.collect()} == {(3, "anna"), (18, "kofi")}


GIVEN, FAMILY = "Anna Kofi Zoe Peter Mei Nadia".split(), "Tassaby Ruvoldt Lorritz Pennova Kellen Haskorn Zellby Marrick".split()


@pytest.fixture(scope="module")
def found(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(240):
        name = f"{rnd.choice(GIVEN)} {rnd.choice(FAMILY)}"
        who = f"Dr. {rnd.choice(FAMILY)}" if i % 6 == 0 else name.lower() if i % 11 == 0 else name
        number = f"{rnd.randint(100, 999)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}" if i % 2 else str(rnd.randint(10**8, 10**9 - 1))
        rows.append((f"The bill was signed by {who} in blue ink.", f"Tax number {number} is on the form. The order number {rnd.randint(10**8, 10**9 - 1)} is open. The Copper Finch keyboard is loud."))
    rows += [(None, None), ("", ""), ("x " * 100_000, None), ("A" * 50_000, "1" * 50_000)]
    return rows, personal.personal_spans(posts(spark, rows)).toPandas()


def test_contexts_find_names_and_bare_numbers(found):
    rows, got = found
    names = got[got["kind"] == "name"]
    assert len(names) >= 0.97 * 240 and (names["field_name"] == "title").all()
    ids = got[got["kind"] == "id_number"]
    assert len(ids) >= 0.99 * 240 and (ids["start_pos"] == 11).all()
    assert set(got["kind"]) <= {"name", "id_number", "phone"} and (got["kind"] == "phone").sum() == 0


def test_masking_keeps_the_rest(spark):
    p = posts(spark, [("mail jo@mail.example 🙂 or (212) 555-0147", None), ("nothing here", "")])
    masked = {r["id"]: (r["title"], r["selftext"]) for r in personal.masked_posts(p, personal.personal_spans(p)).collect()}
    assert masked == {"p0": ("mail <EMAIL> 🙂 or <PHONE>", None), "p1": ("nothing here", "")}


def test_no_posts(spark):
    assert personal.personal_spans(posts(spark, [])).count() == 0


def test_words_are_normalised():
    assert abuse.tokens("You cr3tin, i d i o t!! Cow@rd sooooo") == ["you", "cretin", "idiot", ".", "coward", "soo"]
    assert abuse.tokens(None) == [] and abuse.tokens("  ") == []


@pytest.fixture(scope="module")
def judged():
    rnd = random.Random(9)
    filler = "the lamp is in old garden we found a box near my door and it works".split()
    rude = {"abuse": ["you filthy {}", "what a worthless {}"], "hate": ["all {}s are vermin", "{}s must leave"], "sexual": ["send naked {}", "hardcore {} tonight"]}
    ok = ["the filthy lamp", "naked {} wires", "vermin in the attic", "my worthless {} map"]
    nouns = "zorb quill tamp brog fennel".split()
    rows = []
    for i in range(700):
        body = " ".join(rnd.choice(filler) for _ in range(rnd.randint(5, 60)))
        kind = rnd.choice([*abuse.KINDS, "ok", "ok", "ok"])
        phrase = rnd.choice(rude.get(kind, ok)).format(rnd.choice(nouns))
        verdict = kind if rnd.random() > 0.06 else rnd.choice(["ok", *abuse.KINDS])
        rows.append((kind, (phrase if i % 2 else "", f"{body}. {'' if i % 2 else phrase}. {body}", [verdict])))
    return rows


def test_classifier_on_held_out_posts(judged):
    model = abuse.fit_classifier([r for _, r in judged[:500]])
    hasher = abuse.Hasher()
    scores = model.scores_many([hasher(t, b) for _, (t, b, _) in judged[500:]])
    kinds = [k for k, _ in judged[500:]]
    for k, kind in enumerate(abuse.KINDS):
        truth, hit = np.array([x == kind for x in kinds]), scores[:, k] >= model.thresholds[""][k]
        assert 2 * (truth & hit).sum() / (truth.sum() + hit.sum()) > 0.9


def test_long_and_missing_texts_score(spark, judged):
    model = abuse.fit_classifier([r for _, r in judged[:500]], ["en"] * 500)
    p = posts(spark, [(None, None), ("", ""), ("lamp " * 30_000, "you filthy zorb. " + "lamp " * 30_000)])
    got = {r["id"]: r for r in abuse.content_scores(p, model).collect()}
    assert got["p0"]["abuse"] == got["p1"]["abuse"] == 0 and got["p2"]["is_abuse"]
    assert {tuple(r) for r in abuse.found_kinds(abuse.content_scores(p, model)).collect()} == {("p2", "abuse")}
    assert abuse.content_scores(p.limit(0), model).count() == 0
    sources = spark.createDataFrame([("p2", "s"), ("p0", "s"), ("p0", "t"), ("p9", "t")], "id string, source string")
    rates = {r["source"]: (r["n_posts"], r["abuse_rate"]) for r in abuse.source_rates(abuse.content_scores(p, model), sources).collect()}
    assert rates == {"s": (2, 0.5), "t": (1, 0.0)}


def test_without_labels_nothing_is_found(spark):
    p = posts(spark, [("you filthy zorb", None)])
    assert abuse.found_kinds(abuse.content_scores(p, abuse.fit_classifier([]))).count() == 0
    labels = spark.createDataFrame([("p0", "r1", "abuse"), ("p0", "r2", "ok"), ("p0", "r3", None), (None, "r1", "ok"), ("zz", "r1", "hate")], "id string, reviewer string, verdict string")
    assert [r["verdicts"] for r in abuse.labelled_posts(p, labels).collect()] == [["abuse", "ok"]]
