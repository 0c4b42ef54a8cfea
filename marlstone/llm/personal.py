"""Personal information in free text by bootstrapped contextual extraction.

Every text yields candidates: spans whose form may be an email address, phone number, identity
number, street address or name. Forms that are certain on their own are seeds. The words around
candidates are lexical patterns. Spark scores the graph of patterns and instances in rounds:
patterns by the share of accepted instances among theirs, instances by their best patterns and by
how often their name parts were accepted. Patterns above a confidence bring in candidates whose
form alone says little, such as bare digit strings and names without a form of address. A last
pass looks for the learned names in spellings that are no candidates by form, such as small letters.

Null and empty texts have no cases and stay as they are. Offsets count Unicode code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut

ROUNDS = 4
#: Least score of an accepted candidate, least instances of a pattern, instances that halve a new pattern's score,
#: and how much an open name candidate counts against its patterns.
ACCEPT, SUPPORT, DOUBT, OPEN = 0.6, 2, 0.5, 0.05
#: Learned given names that travel to the tasks at once; more go in further passes over the texts.
NAMES_AT_ONCE = 200_000
#: A pattern, given or family name is frequent if it makes up more than 1 / FREQUENT of the rows: fewer than FREQUENT are.
FREQUENT = 4000
#: How far the form of a seed and its context count: a seed's score is at least the first.
SEED = 0.9
#: Words beside a number between which an address with it lies: no form has so many on one side.
REACH = 10

# ---- fixed values: words of addresses, forms of address and name particles in seven languages
FORMS_OF_ADDRESS = "Mr Mrs Ms Miss Mx Dr Prof Professor Doctor Sir Madam Herr Frau Monsieur Madame Mme Mlle M Señor Señora Sr Sra Don Doña Signor Signora Sig Meneer Mevrouw Dhr Mevr Senhor Senhora Dona".split()
PARTICLES = "van von de der den del della di da dos du la le ter ten zu af el al bin".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct Close Cl Way Place Pl Square Sq Terrace Ter Crescent Cres Parkway Pkwy Highway Hwy Gardens Grove Row Walk Mews Alley Circle Cir Trail Hill Quay Green".split()
STREET_ENDS = "straße strasse str. str weg platz allee gasse ring damm ufer straat laan plein gracht kade".split()
STREETS_BEFORE = "Calle C/ Avda. Avda Avenida Av. Plaza Paseo Camino Carrer Via Viale Piazza Corso Vicolo Rua Travessa Praça Alameda Largo".split()
STREETS_FRENCH = "rue avenue boulevard place chemin impasse allée quai route".split()
UNITS = "Flat Apt Apartment Unit Suite Room Wohnung Appartement Piso Interno Apto".split()
BOXES = ("P.O. Box", "PO Box", "P.O.Box", "P O Box", "Post Office Box", "Postfach", "Apartado de Correos", "Apartado", "Boîte postale", "Casella postale", "Caixa Postal", "Postbus")
DIGIT_WORDS = "zero oh one two three four five six seven eight nine".split()
#: Words that start sentences or stand before nouns and are no part of a name.
ARTICLES = "the a an this that these those every each my your his her its our their some any no der die das den dem ein eine einen mein meine le la les l un une des ce cette mon ma mes el los las una unos mi su il lo gli i uno il mio o os as um uma meu minha de het een mijn".split()
STARTERS = "there what why how when where who if is are was were do does did has have had can could should would will just looking later honestly after before since during nobody somebody everybody anybody someone without with for from to on in at of and or but so then they we you he she it i not one two both either best kind regards thanks dear hello hi yes also all next last look update question".split()
# ---- end of fixed values

_U, _L = "A-ZÀ-ÖØ-ÞĀŁŚŠŽČĆĐ", "a-zß-öø-ÿāłńśšžčćđęążźő"
_CAP = rf"[{_U}](?:[{_L}]+|['’][{_U}][{_L}]+)(?:['’\-][{_U}]?[{_L}]+|[{_U}][{_L}]+)*"
_ALL = rf"[{_U}]{{3,}}(?:['’\-][{_U}]{{2,}})*"
_PART = rf"(?:(?:{'|'.join(PARTICLES)}) ){{1,2}}"
_INITIAL = rf"[{_U}]\."
_EDGE, _END = r"(?<![\w@./'’\-])", r"(?![\w@’'\-]|\.\w)"

_AT = r"(?:\s?@\s?|\s?[\[(<{]\s?at\s?[\])>}]\s?)"
_DOT = r"(?:\.|\s?[\[(<{]\s?dot\s?[\])>}]\s?)"
EMAIL = re.compile(
    rf"(?<![\w.+\-])[\w](?:[\w.+%\-]*[\w])?(?:{_AT}[a-z0-9\-]+(?:{_DOT}[a-z0-9\-]+)*{_DOT}[a-z]{{2,}}| at [a-z0-9\-]+(?: dot [a-z0-9\-]+)* dot [a-z]{{2,}})(?![\w@])",
    re.I,
)
#: Every text with an email address has one of these: an at sign, "at" in brackets, or both words.
_AT_HINT = re.compile(r"[\[(<{]\s?at\s?[\])>}]")
#: Addresses that say "at" with a written domain: their context decides.
LOOSE_EMAIL = re.compile(r"(?<![\w.+\-@])[\w](?:[\w.+%\-]*[\w])? at [a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z]{2,}(?![\w@])", re.I)
URL = re.compile(r"https?://\S+|www\.\S+", re.I)
NUMBER = re.compile(r"(?<![\w.,/\-])(?:[A-Z]{1,2}[ \-]?)?(?:\+|\()?\d(?:[\d]|[ ().\-/:](?=[\d()\-. ])){3,}\d(?: ?[A-Z](?![\w]))?(?![\w%€$£])")
_WORDS = "|".join(DIGIT_WORDS)
SPOKEN = re.compile(rf"(?<![\w\-])(?:(?:\d|{_WORDS})[ \-]){{6,}}(?:\d|{_WORDS})(?![\w\-])", re.I)

_NAME = rf"{_CAP}(?: {_CAP}){{0,3}}"
_TOWN = rf"(?:,? (?:in |à |en |a )?(?:\d{{4,5}} )?{_CAP}(?:,? \d{{4,5}})?)?"
_STREET = "|".join(sorted(map(re.escape, STREETS), key=len, reverse=True))
_UNIT = "|".join(UNITS)
ADDRESS = re.compile(
    "|".join(
        [
            rf"(?:(?:{_UNIT})\.? (?:no\. )?\d+[A-Za-z]?,? )?{_EDGE}\d{{1,5}}[A-Za-z]?,? (?:[NSEW]\.? )?(?:{_CAP}\.? ){{1,3}}(?:{_STREET})(?![\w])",
            rf"{_EDGE}(?i:{'|'.join(map(re.escape, BOXES))}) (?:no\. )?\d{{1,7}}",
            rf"{_EDGE}(?:{_CAP}[ \-])?{_CAP}[ \-]?(?<=[\w \-])(?:{'|'.join(map(re.escape, STREET_ENDS))}) ?\d{{1,4}} ?[a-z]?(?![\w])",
            rf"{_EDGE}[{_U}][{_L}]+(?:{'|'.join(map(re.escape, STREET_ENDS))}) \d{{1,4}}[a-z]?(?![\w])",
            rf"{_EDGE}(?:{'|'.join(map(re.escape, STREETS_BEFORE))}) (?:(?:de|del|da|do|dos|das|della|dei) )?(?:la )?{_NAME},? (?:n[º°o]\.? ?)?\d{{1,4}}(?![\w])",
            rf"{_EDGE}\d{{1,4}}(?: bis| ter)?,? (?:{'|'.join(STREETS_FRENCH)}) (?:(?:de|du|des|d’|d') ?)?(?:la |l’|l')?{_NAME}",
        ]
    )
)
#: Addresses in small or capital letters, and numbers before capitalised words: their context decides.
LOOSE_ADDRESS = re.compile(
    rf"{_EDGE}(?i:(?:(?:{_UNIT})\.? \d+[a-z]?, )?\d{{1,5}}[a-z]? (?:[^\W\d_]+\.? ){{1,2}}(?:{_STREET})(?![\w])|(?:{'|'.join(map(re.escape, STREETS_BEFORE))}) (?:de )?[^\W\d_]+,? \d{{1,4}}(?![\w])"
    rf"|[^\W\d_]+(?:{'|'.join(map(re.escape, STREET_ENDS))}) \d{{1,4}}[a-z]?(?![\w])|\d{{1,4}},? (?:{'|'.join(STREETS_FRENCH)}) [^\W\d_]+)"
)
NUMBERED_NAME = re.compile(rf"{_EDGE}\d{{1,5}}[A-Za-z]? {_CAP}(?: {_CAP}){{0,2}}(?=[,\n.])")
#: Stretches without any of these hold no address of a known form.
_STREET_HINT = re.compile("|".join(re.escape(x) for x in sorted({x.lower() for x in [*STREETS, *STREET_ENDS, *STREETS_BEFORE, *STREETS_FRENCH, *BOXES]}, key=len, reverse=True)))
#: Stretches hold no address either without one of: a street between a blank and a word's end, a form before the
#: name with its blank, or the end of a street right before a number.
_STREET_WORD = re.compile(rf" (?:(?:{_STREET.lower()})(?!\w)|(?:{'|'.join(STREETS_FRENCH)}) )")
_STREET_BEFORE = tuple(f"{x.lower()} " for x in [*STREETS_BEFORE, *BOXES])
_STREET_END = tuple(STREET_ENDS)
#: Texts without this hold no name of two words.
_NAME_HINT = re.compile(rf"[{_U}][\w.'’\-]*,? (?:(?:{'|'.join(PARTICLES)}) )*[{_U}]")
#: What may follow a street: a unit, and a town with its code.
_REST = re.compile(rf"[,.]?[ \n](?:(?:Apt|Unit|Flat|Suite)\.? \d+[A-Za-z]?)?,? ?(?:(?:in |à )?\d{{4,5}} {_CAP}|{_CAP},? \d{{4,5}}|\d{{4,5}})?")
TITLED = re.compile(rf"{_EDGE}(?:{'|'.join(FORMS_OF_ADDRESS)})\.? (?:{_CAP} |{_INITIAL} ?)?(?:{_PART})?(?:{_CAP}|{_ALL}){_END}")
_TITLE = re.compile(rf"(?:{'|'.join(FORMS_OF_ADDRESS)})\.? ")
FULL = re.compile(rf"{_EDGE}(?:{_CAP}|{_INITIAL})(?: ?{_INITIAL})* (?:{_PART}|(?:{_CAP}|{_INITIAL}) ){{0,2}}{_CAP}{_END}")
REVERSED = re.compile(rf"{_EDGE}(?:(?:{'|'.join(x.upper() for x in PARTICLES)}|{'|'.join(PARTICLES)}) )?(?:{_ALL}), {_CAP}(?: {_INITIAL})?{_END}")
_TOKEN = re.compile(r"\n|\d[\d.,:/\-]*|[^\W\d_]+(?:['’\-][^\W\d_]+)*|[^\w\s]")


def number_form(text: str) -> tuple[str, str]:
    """(kind, form) of a number candidate: kind '' where the form alone is not certain."""
    groups = re.findall(r"\d+", text)
    sizes, digits = tuple(map(len, groups)), "".join(groups)
    n, bare = len(digits), text.strip()
    if re.fullmatch(r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]", bare) or re.fullmatch(r"\d{8}[A-Z]|[XYZ]\d{7,8}[A-Z]?|[A-Z]{2}\d{7}", bare) or re.fullmatch(r"\d\d-\d{6}-\d{3}/\d", bare):
        return "id_number", "id"
    if bare[:1].isalpha() or bare[-1:].isalpha():
        return "", "code"
    if re.fullmatch(r"\d{3}([- ])\d\d\1\d{4}", bare):
        return "id_number", "id"
    if ":" in bare or re.match(r"(?:19|20)\d\d-\d\d-\d\d", bare):
        return "", "time"
    if bare.startswith("97") and n == 13:
        return "", "isbn"
    if bare.startswith(("+", "00")) and 9 <= n <= 15:
        return "phone", "phone"
    if sizes in ((3, 3, 4), (1, 3, 3, 4), (3, 3, 2, 2), (1, 3, 3, 2, 2)) and (len(sizes) % 2 or len(sizes) == 4):
        return "phone", "phone"
    if digits.startswith("0") and 9 <= n <= 12 and len(sizes) > 1 and "." not in bare.replace(".", "", 0)[:1]:
        return "phone", "phone"
    if digits.startswith("0") and n in (10, 11) and len(sizes) == 1:
        return "phone", "phone"
    return "", f"digits{n}" if len(sizes) == 1 else "groups"


def _around(text: str, start: int, end: int) -> list[str]:
    """The patterns of a span: words, signs and line breaks beside it; digits are masked."""

    def mask(x: str) -> str:
        return "<n>" if x == "\n" else "0" if x[0].isdigit() else x.lower()

    left = [mask(x) for x in _TOKEN.findall(text[max(0, start - 60) : start])][-3:]
    right = [mask(x) for x in _TOKEN.findall(text[end : end + 60])][:3]
    if start == 0 or not left:
        left = ["<s>"]
    if not right:
        right = ["</s>"]
    l1, r1 = left[-1], right[0]
    out = [f"A {' '.join(left[-2:])} _ {r1}", f"B {l1} _ {' '.join(right[:2])}"]
    if len(left) == 3:
        out.append(f"C {' '.join(left)} _")
    if len(right) == 3:
        out.append(f"D _ {' '.join(right)}")
    return out


def _name_parts(text: str) -> tuple[str, str]:
    """Given and family name of a candidate, in small letters; an initial is no given name."""
    if ", " in text:
        family, _, given = text.partition(", ")
        given = given.split(" ")[0]
    else:
        words = text.split(" ")
        given, family = words[0] if len(words) > 1 else "", words[-1]
    return ("" if given.endswith(".") else given.lower()), family.lower()


_DIGITS, _ASCII_DIGITS = re.compile(r"\d+"), re.compile("[0-9]+")
#: Letters that match others without case; a dotted capital I in small letters is an i and a mark.
_FOLD = str.maketrans({"ı": "i", "İ": "i", "ſ": "s", "K": "k", "\u0307": None})
_FOLDED = ("ı", "İ", "ſ", "\u0307")


def _folds(text: str) -> bool:
    """Whether a text in any case has letters that ``_FOLD`` changes once it is in small letters."""
    if text.isascii():
        return False
    for x in _FOLDED:
        if x in text:
            return True
    return False


def may_have_email(text: str, low: str) -> bool:
    """Whether an email address is possible; ``low`` is the text in small letters."""
    return "@" in text or "at" in low and (" at " in low and " dot " in low or _AT_HINT.search(low) is not None)


def may_be_spoken(low: str, digits: int) -> bool:
    """Whether a number in words is possible: it has seven digits or digit words. ``digits`` counts the text's digits."""
    if _folds(low):
        low = low.translate(_FOLD)
    n = digits
    for w in DIGIT_WORDS:
        if w in low:
            n += low.count(w)
    return n >= 7


def near_numbers(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of ``REACH`` words on both sides of each run of digits, merged where they meet.

    Address forms hold a number and join words by single blanks, so each lies in one of these whole.
    """
    out: list[list[int]] = []
    for start, end in runs:
        a, b = start, end - 1
        for _ in range(REACH):
            a = text.rfind(" ", 0, a)
            if a < 0:
                break
        for _ in range(REACH):
            b = text.find(" ", b + 1)
            if b < 0:
                b = len(text)
                break
        a += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def may_have_street(low: str, runs: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether an address is possible in this stretch of a text in small letters, which has no letters that ``_FOLD`` changes."""
    part = low[a:b]
    if _STREET_WORD.search(part):
        return True
    for x in _STREET_BEFORE:
        if x in part:
            return True
    for start, _ in runs:
        if a < start < b and low.endswith(_STREET_END, a, start - 1 if low[start - 1] == " " else start):
            return True
    return False


def numbers(text: str, runs: list[tuple[int, int]]) -> Iterator[re.Match]:
    """All matches of ``NUMBER``, looked for only where one can start: at most four signs before a run of digits."""
    at = 0
    for start, _ in runs:
        for i in range(max(at, start - 4), start + 1):
            m = NUMBER.match(text, i)
            if m:
                yield m
                at = m.end()
                break


_NO_NAME = frozenset(ARTICLES) | frozenset(STARTERS)
_LAST_WORD = re.compile(r"([^\W\d_]+)['’]? ?\Z")


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without words at its ends that are no part of a name."""
    while " " in text[a:b] and text[a:b].partition(" ")[0].lower() in _NO_NAME:
        a += text[a:b].index(" ") + 1
    while " " in text[a:b] and text[a:b].rpartition(" ")[2].lower() in _NO_NAME - frozenset(PARTICLES):
        b = a + text[a:b].rindex(" ")
    return a, b


def _refuted(text: str, a: int, b: int) -> bool:
    """Whether an article stands before a span: names of things, not of persons."""
    m = _LAST_WORD.search(text[max(0, a - 16) : a])
    return bool(m) and m[1].lower() in ARTICLES and m[1].lower() not in ("i", "o", "as", "no", "su", "de", "any")


def candidates(text: str) -> list[tuple]:
    """(start, end, kind or group, seed, near, alt, refuted, given name, family name, patterns) of all candidates of a text.

    The group of a candidate that needs its context is ``number``, ``name``, ``place`` or ``mail``.
    The whole text is searched; what is skipped cannot hold a case of the kind.
    ``near``: it touches another certain case; ``alt``: the span without its first word is a candidate too.
    """
    taken: list[tuple[int, int]] = []
    out: list[tuple] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def put(a: int, b: int, kind: str, seed: bool, alt: bool = False) -> None:
        named = kind == "name"
        near = named and not alt and any(0 <= x - b <= 3 and not text[b:x].strip(" |;,(:\n\"") or 0 <= a - y <= 3 and not text[y:a].strip(" |;,):\n\"") for x, y in sure)
        out.append((a, b, kind, seed, near, alt, named and _refuted(text, a, b), *(_name_parts(text[a:b]) if named else ("", "")), _around(text, a, b)))

    sure: list[tuple[int, int]] = []
    low = text.lower()
    taken += [m.span() for m in URL.finditer(text)] if "://" in low or "www." in low else []
    if may_have_email(text, low):
        for m in EMAIL.finditer(text):
            if free(*m.span()):
                put(*m.span(), "email", True)
                taken.append(m.span())
    if " at " in low and "." in low:
        for m in LOOSE_EMAIL.finditer(text):
            if free(*m.span()):
                put(*m.span(), "mail", False)
    runs = [m.span() for m in (_ASCII_DIGITS if text.isascii() else _DIGITS).finditer(text)]
    streets = []
    if runs:
        places = near_numbers(text, runs)
        if _folds(text):
            streets = [(a, b) for a, b in places if _STREET_HINT.search(text[a:b].lower().translate(_FOLD))]
        else:
            streets = [(a, b) for a, b in places if may_have_street(low, runs, a, b)]
        for m in (m for a, b in streets for m in ADDRESS.finditer(text, a, b)):
            if free(*m.span()):
                put(*m.span(), "address", True)
                rest = _REST.match(text, m.end())
                taken.append((m.start(), rest.end() if rest else m.end()))
    if may_be_spoken(low, sum(b - a for a, b in runs)):
        for m in SPOKEN.finditer(text):
            if free(*m.span()) and not m[0].replace(" ", "").isdigit():
                put(*m.span(), "phone", True)
                taken.append(m.span())
    if runs:
        for m in numbers(text, runs):
            a, b = m.span()
            while text[b - 1] in " (-./:":
                b -= 1
            if not free(a, b):
                continue
            if text[a] == "(" and ")" not in text[a:b]:
                a += 1
            kind, form = number_form(text[a:b])
            if not kind and form == "code":
                # A letter beside the digits may belong to the sentence, as in "I 555 ...".
                short = text[a:b].rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ ").rstrip()
                if text[a].isdigit() or text[a] in "+(":
                    kind = number_form(short)[0]
                    b = a + len(short) if kind else b
            if kind:
                put(a, b, kind, True)
                taken.append((a, b))
            elif form.startswith("digits") and 7 <= int(form[6:]) <= 13:
                put(a, b, "number", False)
                taken.append((a, b))
            elif form in ("code", "groups") and sum(c.isdigit() for c in text[a:b]) >= 6:
                put(a, b, "number", False)
                taken.append((a, b))
        for m in [*(m for a, b in streets for m in LOOSE_ADDRESS.finditer(text, a, b)), *(m for a, b in places for m in NUMBERED_NAME.finditer(text, a, b))]:
            if free(*m.span()) and (m.start(), "place") not in {(c[0], c[2]) for c in out}:
                put(*m.span(), "place", False)
    if not _NAME_HINT.search(text):
        return out
    sure += [(c[0], c[1]) for c in out if c[3]]
    for m in TITLED.finditer(text):
        a = m.start() + _TITLE.match(m[0]).end()  # type: ignore[union-attr]
        if m[0].startswith("M. ") and re.search(rf"[{_U}][{_L}]+ \Z", text[max(0, m.start() - 30) : m.start()]):
            continue  # a middle initial
        if free(a, m.end()):
            context = _around(text[: m.start()] + text[a:], m.start(), m.start() + m.end() - a)
            out.append((a, m.end(), "name", True, False, False, False, *_name_parts(text[a : m.end()]), context))
            taken.append(m.span())
    for rx in (REVERSED, FULL):
        for m in rx.finditer(text):
            a, b = m.span()
            if rx is FULL:
                a, b = _trimmed(text, a, b)
            words = text[a:b].split(" ")
            if len(words) < 2 or not free(a, b):
                continue
            # A sentence's first word may precede the name: both readings are candidates then.
            both = rx is FULL and len(words) > 2 and words[1].lower() not in PARTICLES
            if both:
                put(a + len(words[0]) + 1, b, "name", False)
            put(a, b, "name", False, both)
            if rx is REVERSED:
                taken.append((a, b))
    return out


_CANDIDATE = "id string, field_name string, start_pos long, end_pos long, kind string, seed boolean, near boolean, alt boolean, refuted boolean, given string, family string, patterns array<string>"
_COLUMNS = ["id", "field_name", "start_pos", "end_pos", "kind", "seed", "near", "alt", "refuted", "given", "family", "patterns"]

def find_candidates(posts: DataFrame) -> DataFrame:
    """All candidates of ``id, title, selftext`` posts; one narrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, title, body in zip(batch["id"], batch["title"], batch["selftext"]):
                for name, text in (("title", title), ("selftext", body)):
                    if text:
                        rows += [(key, name, *c) for c in candidates(text)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return posts.select("id", "title", "selftext").mapInPandas(run, _CANDIDATE)


def _keyed(found: DataFrame) -> DataFrame:
    """Candidates with a number of their own and their patterns as hashes, each within the candidate's group."""
    group = F.when(F.col("kind").isin("phone", "id_number", "number"), "number").when(F.col("kind").isin("address", "place"), "place").when(F.col("kind").isin("email", "mail"), "mail").otherwise(F.lit("name"))
    keyed = found.withColumn("grp", group).withColumn("cid", F.xxhash64("id", "field_name", "start_pos", "end_pos"))
    return keyed.withColumn("patterns", F.transform("patterns", lambda x: F.xxhash64(F.col("grp"), x)))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """``rows`` with ``value`` of their key, null where there is none, whatever the number of rows of one key.

    Frequent keys (fewer than ``FREQUENT``) are broadcast. All other rows are shuffled by their
    key; those that have none, or found it already, by their own number.
    """
    often = table.filter(F.col("seen") > F.lit(total / FREQUENT)).select(key, F.col(value).alias("_often"))
    rare = table.filter(F.col("seen") <= F.lit(total / FREQUENT)).select(F.col(key).alias("_key"), F.col(value).alias("_rare"))
    first = rows.join(F.broadcast(often), key, "left")
    first = first.withColumn("_key", F.when(F.col("_often").isNull() & (F.col(key) != ""), F.col(key)).otherwise(F.concat(F.lit("\u0000"), F.col("cid").cast("string"))))
    return first.join(rare, "_key", "left").withColumn(value, F.coalesce("_often", "_rare")).drop("_often", "_rare", "_key")


def _with_patterns(edges: DataFrame, patterns: DataFrame, total: int) -> DataFrame:
    """Edges joined with their patterns; frequent patterns are broadcast, so none loads one task."""
    often = F.broadcast(patterns.filter(F.col("seen") > F.lit(total / FREQUENT)))
    rare = patterns.filter(F.col("seen") <= F.lit(total / FREQUENT))
    return edges.join(often, "pattern").unionByName(edges.join(often.select("pattern"), "pattern", "left_anti").join(rare, "pattern"))


def learn(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored candidates (``score``, ``as_kind``), pattern scores and given-name scores, from ``_keyed`` candidates.

    Each round aggregates patterns and name parts over all candidates and scores all candidates
    by them, seeds included: their form gives them ``SEED``, their context the rest. Scores are written between rounds.
    """
    start = F.when(F.col("seed"), 1.0).when(F.col("near") & ~F.col("refuted"), 0.8).otherwise(0.0)
    as_kind = F.when(F.col("grp") == "place", "address").when(F.col("grp") == "mail", "email").when(F.col("kind") == "number", F.lit(None).cast("string")).otherwise(F.col("kind"))
    state = found.withColumn("score", start).withColumn("as_kind", as_kind)
    size = found.agg(F.sum(F.size("patterns")).alias("edges"), F.count_if(F.col("grp") == "name").alias("names")).first()
    n_edges, n_names = size["edges"] or 0, size["names"]
    won = F.when(F.col("score") >= ACCEPT, F.col("score")).otherwise(F.lit(0.0))
    # What is not accepted counts against a pattern: fully, or a little where nothing speaks against a name.
    lost = F.when(F.col("score") >= ACCEPT, 0.0).when((F.col("grp") == "name") & ~F.col("refuted"), OPEN).otherwise(1.0)
    for _ in range(rounds):
        edges = state.select("cid", "grp", "seed", "refuted", "alt", "score", "as_kind", F.explode("patterns").alias("pattern"))
        counts = edges.groupBy("grp", "pattern", F.when(won > 0, F.col("as_kind")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(won).alias("won"), F.sum(lost).alias("lost"))
        total = counts.groupBy("grp", "pattern").agg(F.sum("n").alias("n"), F.sum("won").alias("all"), F.sum("lost").alias("lost"), F.max(F.when(F.col("k").isNotNull(), F.struct("won", "k"))).alias("best"))
        p = F.col("best.won") / (F.col("all") + F.col("lost") + DOUBT)
        patterns = total.filter((F.col("n") >= SUPPORT) & F.col("best").isNotNull()).select("grp", "pattern", F.col("best.k").alias("k"), p.alias("p"), F.col("n").alias("seen"))
        patterns = cut(patterns.filter("p > 0.15"), "patterns")
        parts = state.filter("grp = 'name' and not alt")
        share = F.sum(won) / (F.sum(won) + F.sum(lost) + DOUBT)
        given = cut(parts.filter("given <> ''").groupBy("given").agg(share.alias("g"), F.count(F.lit(1)).alias("seen")).filter("g > 0.2"), "given_names")
        family = cut(parts.groupBy("family").agg(share.alias("f"), F.count(F.lit(1)).alias("seen")).filter("f > 0.2"), "family_names")
        heard = _with_patterns(edges.select("cid", "pattern"), patterns.select("pattern", "k", "p", "seen"), n_edges).groupBy("cid", "k").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(0.98)))))).alias("s"), F.max("p").alias("top"))
        heard = heard.groupBy("cid").agg(F.max_by(F.struct("k", "s", "top"), "s").alias("h"))
        scored = _looked_up(_looked_up(state.drop("score", "as_kind").join(heard, "cid", "left"), given, "given", "g", n_names), family, "family", "f", n_names)
        by_context = F.coalesce(F.greatest(F.col("h.top"), F.col("h.s") * 0.8), F.lit(0.0))
        g, f = F.coalesce("g", F.lit(0.0)), F.coalesce("f", F.lit(0.0))
        by_name = F.greatest(g * 0.9 + 0.1 * f, 0.5 * by_context + 0.5 * F.greatest(g, f), 0.6 * g + 0.5 * f)
        name = F.greatest(F.when(F.col("near"), 0.8).otherwise(0.0), by_context * 0.95, by_name)
        name = F.when(F.col("refuted"), 0.0).when(F.col("alt") & (g >= 0.5), F.lit(0.995)).when(F.col("alt"), F.least(name, 0.1 + g)).otherwise(F.least(F.lit(0.99), name))
        score = F.when(F.col("seed"), SEED + (1 - SEED) * by_context).when(F.col("grp") == "name", name).otherwise(by_context)
        kind = F.when(F.col("seed"), F.col("kind")).when(F.col("grp") == "number", F.col("h.k")).when(F.col("grp") == "place", F.lit("address")).when(F.col("grp") == "mail", F.lit("email")).otherwise(F.lit("name"))
        state = cut(scored.select(*found.columns, score.alias("score"), kind.alias("as_kind")), "candidates")
    return state, patterns, given


def _name_blocks(given: DataFrame) -> Iterator[frozenset]:
    """Learned given names in blocks of ``NAMES_AT_ONCE``, read one partition at a time; one empty block if there are none."""
    block: list[str] = []
    first = True
    for r in given.filter("g >= 0.6 and seen >= 2").select("given").orderBy("given").toLocalIterator():
        block.append(r["given"])
        if len(block) == NAMES_AT_ONCE:
            yield frozenset(block)
            block, first = [], False
    if block or first:
        yield frozenset(block)


def find_learned_names(posts: DataFrame, given: DataFrame) -> DataFrame:
    """Candidates that start with a learned given name in small or capital letters: ``find_candidates`` rows.

    Names travel to the tasks in blocks of bounded size, each against all texts.
    """
    word = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
    after = re.compile(rf" (?:(?:{'|'.join(PARTICLES)}) |[^\W\d_]\.? )?({word})(?![\w@.]*@)", re.I)
    split, parts, small = re.compile(word), re.compile(r"[^\W\d_]+"), re.compile("[a-z]+")
    out: DataFrame | None = None
    for known in _name_blocks(given):
        shared = posts.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names = shared.value
            # Most texts have no first part of a name, which is quicker to see than whole words.
            first = {m[0] for x in names if (m := parts.search(x))}
            for batch in batches:
                rows = []
                for key, title, body in zip(batch["id"], batch["title"], batch["selftext"]):
                    for field, text in (("title", title), ("selftext", body)):
                        if not text:
                            continue
                        low = text.lower()
                        if first.isdisjoint((small if low.isascii() else parts).findall(low)) or names.isdisjoint(split.findall(low)):
                            continue
                        mail = [m.span() for m in EMAIL.finditer(text)] if may_have_email(text, low) else []
                        for m in split.finditer(text):
                            if m[0].lower() in names and not (m[0][0].isupper() and m[0][1:].islower()):
                                n = after.match(text, m.end())
                                if n and len(n[1]) > 2 and not any(a < n.end() and m.start() < b for a, b in mail):
                                    rows.append((key, field, m.start(), n.end(), "name", False, False, False, _refuted(text, m.start(), n.end()), m[0].lower(), n[1].lower(), _around(text, m.start(), n.end())))
                yield pd.DataFrame(rows, columns=_COLUMNS)

        part = posts.select("id", "title", "selftext").mapInPandas(run, _CANDIDATE)
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def _score_by(rows: DataFrame, patterns: DataFrame, state: DataFrame, n_edges: int) -> DataFrame:
    """Late name candidates that a confident pattern or a known family name supports."""
    edges = rows.select("cid", F.explode("patterns").alias("pattern"))
    context = _with_patterns(edges, patterns.select("pattern", "p", "seen"), n_edges).groupBy("cid").agg(F.max("p").alias("top"))
    family = state.filter(f"grp = 'name' and score >= {ACCEPT}").groupBy("family").agg(F.lit(0.8).alias("known"), F.count(F.lit(1)).alias("seen"))
    scored = _looked_up(rows.join(context, "cid", "left"), family, "family", "known", n_edges)
    return scored.withColumn("score", F.when(F.col("refuted"), 0.0).otherwise(F.greatest(F.coalesce("top", F.lit(0.0)), F.coalesce("known", F.lit(0.0))))).withColumn("as_kind", F.lit("name"))


def personal_spans(posts: DataFrame) -> DataFrame:
    """``id, field_name, kind, start_pos, end_pos, score`` of every case; cases of a text don't overlap."""
    found = cut(_keyed(find_candidates(posts)), "pii_candidates")
    state, patterns, given = learn(found)
    rows = cut(_keyed(find_learned_names(posts, given)), "pii_names")
    late = _score_by(rows, patterns, state, rows.agg(F.sum(F.size("patterns")).alias("n")).first()["n"] or 0)
    columns = ["id", "field_name", F.col("as_kind").alias("kind"), "start_pos", "end_pos", "score", "seed"]
    best = state.filter(F.col("as_kind").isNotNull() & (F.col("score") >= ACCEPT)).select(*columns)
    best = best.unionByName(late.filter(F.col("score") >= ACCEPT).select(*columns))
    # Cases of one text: the number is bounded by the text. Seeds first, then higher scores, then longer ones.
    of_text = F.sort_array(F.collect_list(F.struct((~F.col("seed")).alias("open"), (-F.col("score")).alias("o"), (F.col("start_pos") - F.col("end_pos")).alias("len"), "start_pos", "end_pos", "kind")))
    keep = F.aggregate(
        "all",
        F.expr("cast(array() as array<struct<open:boolean,o:double,len:bigint,start_pos:bigint,end_pos:bigint,kind:string>>)"),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["start_pos"] < x["end_pos"]) & (x["start_pos"] < y["end_pos"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    one = best.groupBy("id", "field_name").agg(of_text.alias("all")).select("id", "field_name", F.explode(keep).alias("c"))
    return one.select("id", "field_name", "c.kind", "c.start_pos", "c.end_pos", F.round(-F.col("c.o"), 4).alias("score"))


def masked_posts(posts: DataFrame, spans: DataFrame) -> DataFrame:
    """``id, title, selftext`` with each case replaced by its placeholder, such as ``<EMAIL>``; the rest is unchanged."""
    lists = spans.groupBy("id").agg(*[F.sort_array(F.collect_list(F.when(F.col("field_name") == f, F.struct("start_pos", "end_pos", "kind")))).alias(f"_c_{f}") for f in ("title", "selftext")])
    joined = posts.join(lists, "id", "left")

    def masked(field: str):
        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
        cells = F.coalesce(F.col(f"_c_{field}"), F.expr("cast(array() as array<struct<start_pos:bigint,end_pos:bigint,kind:string>>)"))
        acc = F.aggregate(
            cells,
            start,
            lambda a, c: F.struct(c["end_pos"].alias("at"), F.concat(a["done"], F.substring(F.col(field), (a["at"] + 1).cast("int"), (c["start_pos"] - a["at"]).cast("int")), F.lit("<"), F.upper(c["kind"]), F.lit(">")).alias("done")),
        )
        return F.when(F.size(cells) == 0, F.col(field)).otherwise(F.concat(acc["done"], F.substring(F.col(field), (acc["at"] + 1).cast("int"), F.lit(2_000_000_000)))).alias(field)

    return joined.select("id", masked("title"), masked("selftext"))
