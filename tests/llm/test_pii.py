from __future__ import annotations

import json
import random

import pytest

from millrace.llm import pii

GIVEN = ["Alba", "Boris", "Cora", "Dmitri", "Elif", "Farid", "Greta", "Hugo"]
SURNAMES = ["Quillfeather", "O'Marrow", "Vestergård", "Stonely-Price", "Umbermoor", "Tarnwell", "Okonjo", "Brightling"]


def line(rng, k):
    g, s = rng.choice(GIVEN), rng.choice(SURNAMES)
    phone = rng.choice([f"+44 1632 960{rng.randint(100, 999)}", f"(202) 555-01{rng.randint(10, 99)}", f"202-555-01{rng.randint(10, 99)}"])
    ssn = f"9{rng.randint(10, 99)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    spaced = ssn.replace("-", " ")
    mail = f"{g.lower()}.{s.lower().replace(chr(39), '').replace('å', '')}@post.example"
    street = f"{rng.randint(1, 99)} {rng.choice(['Harrow', 'Elm', 'Long Acre'])} {rng.choice(['Street', 'Road', 'Lane'])}"
    return rng.choice([
        (f"Dear Mr. {s}, welcome", {"person_name"}),
        (f"Reviewed by {g} {s}.", {"person_name"}),
        (f"author: {g} {s} <{mail}>", {"person_name", "email"}),
        (f"call {phone}", {"phone"}),
        (f"| {phone} | 7 |", {"phone"}),
        (f"SSN {ssn}", {"id_number"}),
        (f"holder {rng.choice([ssn, f'ZZ{rng.randint(10**6, 10**7 - 1)}'])}", {"id_number"}),
        (f"passport no. ZZ{rng.randint(10**6, 10**7 - 1)}", {"id_number"}),
        (f"holder {spaced}", {"id_number"}),
        (f"write to {mail}", {"email"}),
        (f"reach {mail.replace('@', ' at ').replace('.example', ' dot example')}", {"email"}),
        (f"sent to {street}", {"street_address"}),
        (f"{g} {s} lives at {street}, phone {phone}", {"person_name", "phone", "street_address"}),
        ("The Random Forest was better, see logo@2x.png and v2.555.19", set()),
        (f"x = [{rng.random() * 900:.6f}, {rng.randint(10**8, 10**9 - 1)}] on 2020-01-02", set()),
        ("About 22 Street signs per image; Green Valley river", set()),
        ("seed = 4155550134", set()),
    ])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    docs, want = [(1, None), (2, ""), (3, "   ")], set()
    for d in range(10, 160):
        text = []
        for n in range(1, 9):
            t, kinds = line(rng, n)
            want |= {(d, n, k) for k in kinds}
            text.append(json.dumps(t) + "," if d % 3 == 0 else "# " + t if d % 3 == 1 else t)
        docs.append((d, "\n".join(text)))
    return docs, want


def test_found_lines(spark, corpus):
    docs, want = corpus
    df = spark.createDataFrame([(*r, "clash", 1) for r in docs + docs[10:12]], "doc_id long, text string, kind string, line_no int")
    got = {tuple(r) for r in pii.found_lines(pii.find(df)).collect()}
    assert len(got & want) >= 0.97 * len(want), sorted(want - got)[:10]
    assert len(got & want) >= 0.97 * len(got), sorted(got - want)[:10]


def test_names_without_a_title_are_discovered(spark):
    rows = [(i, f"Prof. {s} said") for i, s in enumerate(SURNAMES[:4])]
    rows += [(100 + i, f"by {g} {s}") for i, (g, s) in enumerate((g, s) for g in GIVEN for s in SURNAMES)]
    rows += [(900 + i, f"by {w}") for i, w in enumerate(["Random Forest", "Green Valley", "Lower Quill"] * 5)]
    got = {r.doc_id for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'person_name'").collect()}
    assert got == {r[0] for r in rows if r[0] < 900}


def test_redaction_changes_nothing_else(spark, corpus):
    docs, _ = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    spans = {}
    for r in pii.find(df).collect():
        spans.setdefault(r.doc_id, []).append((r.first, r.last))
    assert len(out) == len(docs)
    for d, text in docs:
        if d not in spans:
            assert out[d] == text
            continue
        rest, pos = [], 0
        for a, b in sorted(spans[d]):
            if a >= pos:
                rest.append(text[pos:a])
            pos = max(pos, b)
        rest.append(text[pos:])
        left, at = out[d], 0
        for piece in rest:
            at = left.index(piece, at) + len(piece)
        assert len(left.split("\n")) == len(text.split("\n"))


def test_escapes_keep_positions():
    text = json.dumps("Prof. Vestergård\twrites \"x\" to Boris Okonjo \\ 1") + '\\n",\n"Sra. Tarnwell"'
    for a, b, family, *_ in pii.candidates(text):
        assert family == "name" and text[a:b] in {"Prof. Vesterg\\u00e5rd", "Boris Okonjo", "Sra. Tarnwell"}


def test_very_long_lines_and_empty(spark):
    text = "Ab1+/" * 60_000 + " call +44 1632 960123 " + "x" * 50_000
    assert [c[2] for c in pii.candidates(text)] == ["number"]
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pii.redact(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redaction_without_unique_identifiers(spark):
    texts = ["Call Mrs. Hanna Bergstrom at phone +46 8 555 010 20 today", "phone +46 8 555 010 77", "no data of persons in here at all, +46 8 is a prefix only", None]
    ids = [None, "a", "a", None]
    unique = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(list(zip("0123", texts)), "doc_id string, text string")).collect()}
    assert unique["0"] != texts[0] and unique["1"] != texts[1] and unique["2"] == texts[2]
    got = pii.redact(spark.createDataFrame([*zip(ids, texts), (None, texts[0])], "doc_id string, text string")).collect()
    want = [(i, unique[k]) for i, k in zip(ids, "0123")] + [(None, unique["0"])]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("tel 555-1234", "phone", "555-1234"), ("phone 555 0199", "phone", "555 0199"), ("call me 12345678", "phone", "12345678"),
        ("DNI 12345678Z", "id_number", "12345678Z"), ("passport no C01X00T47", "id_number", "C01X00T47"), ("Ausweisnr. L01X00T47", "id_number", "L01X00T47"),
        ("at 12 Old Oak Tree Hill Lane", "street_address", "12 Old Oak Tree Hill Lane"), ("12 rue Victor Hugo", "street_address", "12 rue Victor Hugo"),
        ("Calle de los Tres Reyes Magos 15", "street_address", "Calle de los Tres Reyes Magos 15"),
        ("Figure 3 Supreme Court ruled", None, None), ("see cell 237", None, None), ("call 555 times", None, None),
    ],
)
def test_single_texts(spark, text, kind, span):
    got = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.kind, text[r.first : r.last]) for r in got] == ([(kind, span)] if kind else [])


def test_the_word_before_a_number_goes_before_its_shape(spark):
    rows = [(i, f"phone 303-444-5{i:03d}") for i in range(9)] + [(100, "passport no 303-444-5555"), (101, "303-444-5556")]
    got = {r.doc_id: r.kind for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: "phone" for i in range(9)}, 100: "id_number", 101: "phone"}


def test_short_numbers_after_words_that_mostly_have_full_ones(spark):
    rows = [(i, f"fax 303-444-5{i:03d}") for i in range(3)] + [(10, "fax 4711"), *[(20 + i, f"see cell {i + 7}") for i in range(5)], (30, "cell 202-555-0144")]
    got = {r.doc_id for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0, 1, 2, 10, 30}


def test_rounds_go_on_until_nothing_is_new(spark):
    # a chain in which each step needs the one before: the given names of step i come with the surnames of i and i + 1
    word = lambda kind, i, j: f"{kind}{chr(97 + i)}{'uv'[j]}"
    links = [(word("Giv", i, j), word("Sur", i + k, n)) for i in range(7) for j in range(2) for k in range(2) for n in range(2)]
    rows = [(0, "Mr. Surau said"), (1, "Mr. Surav said")] + [(10 + i, f"by {g} {s}") for i, (g, s) in enumerate(links)]
    got = {r.doc_id for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'person_name'").collect()}
    assert got == {r[0] for r in rows}


def test_names_of_streets_need_a_witness_after_doubtful_words(spark):
    rows = [(i, f"nearly {i + 3} {w} Of Grain") for i, w in enumerate(["Barrels", "Tonnes", "Litres", "Crates", "Spoons", "Grams"])]
    rows += [(20, "nearly 3 Supreme Court rulings"), (21, "lives at 7 Harrow Street"), (22, "post to 9 Harrow Lane"), (23, "nearly 11 Harrow Close"), (24, "sent to 4 Elm Street"), (25, "or 4 Elm Close"), (26, "he met 5 Fern Road"), (27, "by 5 Fern Close"), (28, "at 5 Fern Lane"), (29, "at 4 Elm Road")]
    got = {r.doc_id for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'street_address'").collect()}
    assert got == set(range(21, 30))
