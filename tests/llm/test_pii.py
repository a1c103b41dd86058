"""Personal information: forms, positions, what the corpus teaches, replacement."""

import random

import pytest

from tidemark.llm import pii

GIVEN = [a + b for a in ("Dov", "Kes", "Lo", "Tal", "Ulm", "Vel") for b in ("elle", "ric", "vira", "ith", "en")]
FAMILY = [a + b for a in ("Brask", "Drov", "Møn", "Tolv", "Wex") for b in ("ard", "holt", "ini", "ovic", "wyn")]
KNOWN = [(w, "given") for w in GIVEN if w != "Kesric"] + [(w, "family") for w in FAMILY if w != "Wexholt"]
MODEL = pii.NameModel(KNOWN, ["Loric Tolvini", "Zintra"])


def forms(text, kinds=None):
    t, place = pii.normal_form(text)
    return [(f.kind, place[f.start]) for f in sorted(pii.find_forms(t, MODEL), key=lambda f: f.start) if f.sure and (kinds is None or f.kind in kinds)]


@pytest.mark.parametrize(
    ("text", "kind", "at"),
    [
        ("Mail me: velen.drovini+shop@box.invalid.", "email", "velen"),
        ("You can reach me at velen.drovini (at) example dot org if", "email", "velen"),
        ("reach me at x9034 at box [dot] invalid now", "email", "x9034"),
        ("Kontakt: velen punkt drovini (at) example dot net", "email", "velen"),
        ('mail me: "talith tolvini"@talith.example.', "email", '"talith'),
        ("連絡先はx8281@kontor.exampleです", "email", "x8281"),
        ("to drov&#64;example.net and", "email", "drov"),
        ("(info.drov＠example.net)", "email", "info"),
        ("Tel. +49 (0)30 23125981 bitte", "phone", "+49"),
        ("ring (984) 555-0120 after six", "phone", "(984)"),
        ("1-620-555-0102", "phone", "1-620"),
        ("I rang from +1 908  555 0172 and", "phone", "+1"),
        ("au +33 1 99  00 38 14. Je", "phone", "+33"),
        ("ID card: 00084670 Cheap", "id_number", "00084670"),
        ("Appelez-moi au 06.39.98.25.19.", "phone", "06"),
        ("0044 7700 900710, danke", "phone", "0044"),
        ("電話は090-0000-2487までお願い", "phone", "090"),
        ("my mobile is five five five zero one nine eight", "phone", "five"),
        ("here: QQ 58 24 04  A.", "id_number", "QQ"),
        ("NIR : 2 70 00 99 623 176 95.", "id_number", "2 70"),
        ("SSN: 997174442 Best", "id_number", "997"),
        ("Why do you need my tax id (989-30-0397) for", "id_number", "989"),
        ("Sogar meine IdNr. wollten sie: 00 685 221 012.", "id_number", "00"),
        ("Me pidieron el DNI: X0006533I.", "id_number", "X0006533I"),
        ("I live at 46B Alder Quay Road, Dunmere", "address", "46B"),
        ("an Ziegelstr. 113b schicken", "address", "Ziegelstr"),
        ("Livré au 154 bis chemin des Tanneurs, 00937 N", "address", "154"),
        ("Vivo en Calle de los Curtidores 155<br/>", "address", "Calle"),
        ("Thanks to Velen Drovini for", "person_name", "Velen"),
        ("Best regards, DOVELLE MØNWYN", "person_name", "DOVELLE"),
        ("I spoke with talith braskwyn on", "person_name", "talith"),
        ("Ms Tolvwyn from", "person_name", "Tolvwyn"),
        ("ask for K. Braskini at", "person_name", "K."),
        ("Saluti, Braskini, Loen Dopo", "person_name", "Braskini"),
        ("Viele Grüße, Velric van der Tolvard", "person_name", "Velric"),
        ("Merci, Talric Braskard-Drovholt", "person_name", "Talric"),
        ("Thanks to Velen MÃ¸nini for", "person_name", "Velen"),
        ("Thanks to Velen Dro​vini for", "person_name", "Velen"),
        ("Dr. Tolvini", "person_name", "Tolvini"),
        ("Best regards, M. Tolvini", "person_name", "M."),
        ("Très déçu, plastique bas de gamme. Merci à M. Tolvini pour son aide", "person_name", "Tolvini"),
    ],
)
def test_cases(text, kind, at):
    assert (kind, text.index(at)) in forms(text), forms(text)


@pytest.mark.parametrize(
    ("text", "kind", "at"),
    [
        ("my number: five, five, five, zero, one, two, three, four", "phone", "five"),
        ("my number: five-five-five-zero-one-two-three", "phone", "five"),
        ("my number: FİVE, five, five, zero, one, two, three", "phone", "FİVE"),
        ("write to john ( at ) example.com", "email", "john"),
        ("write to john [ at ] example [ dot ] com", "email", "john"),
    ],
)
def test_forms_behind_gates(text, kind, at):
    assert (kind, text.index(at)) in forms(text), forms(text)


@pytest.mark.parametrize(
    "text",
    [
        "", "   ", "Thank you, Velen! Part one.", "The Loric Tolvini gateway", "I returned Loric Tolvvini TX3", "I spoke with Drovini.",
        "ships as user@3 pairs", "lib@8.4.0", "Thanks @zintra_reviews", "54 @ 11.50 each", "Saffron Lane has a shop", "In der Kupferstraße gibt es 3 Läden",
        "Serial 00-2136-199527, bought on 2/6/2013", "Order no. B4376023447 took 8 days", "barcode 8776598803425", "Part number QX 29 41 60", "firmware v8.19.6",
        "Bought in 2012 for 69.79.", "port 49789", "Une boutique rue du Cuivre vend", "Chambre 276, bâtiment C. Il affiche 18 degrés", "by the way 3 of them",
    ],
)
def test_no_cases(text):
    assert forms(text) == []


def test_positions_in_the_original():
    text = "a&amp;b​ 😀 é MÃ¸n: velen@box.invalid"
    t, place = pii.normal_form(text)
    assert t == "a&b 😀 é Møn: velen@box.invalid" and place[t.index("velen")] == text.index("velen")
    assert list(pii.normal_form("plain")[1]) == list(range(5))


def corpus(seed=1, n=240):
    """Texts in which labels before certain forms teach what the same labels mean before ambiguous ones."""
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choice("123456789") for _ in range(k))
    rows, want = [], set()
    for i in range(n):
        kind = i % 6
        if kind == 0:
            case, text = ("phone", f"+1 {d(3)} 555 {d(4)}"), "Please ring {} after six."
        elif kind == 1:
            case, text = ("phone", f"{d(3)} 555 {d(4)}"), "Please ring {} after six."
        elif kind == 2:
            case, text = None, f"Order no. {d(3)} {d(3)} {d(4)} took 8 days. Order no. B{d(10)} took 3 days."
        elif kind == 3:
            case, text = ("id_number", f"QQ {d(2)} {d(2)} {d(2)} A"), "I had to type {} into the form."
        elif kind == 4:
            case, text = ("id_number", f"{d(3)}-{d(2)}-{d(4)}"), "I had to type {} into the form."
        else:
            case, text = None, f"Part number {d(3)}-{d(2)}-{d(4)} fits. Part number {d(8)}-K too. Part number {d(3)}-{d(2)}-{d(4)} not."
        if case:
            want.add((i, case[0], text.index("{}")))
            text = text.format(case[1])
        rows.append((i, text))
    return rows, want


DOC = "doc_id long, text string, kind string, uid string, terms int"


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOC)
    known = spark.createDataFrame([*KNOWN, (None, "given"), ("Kesric", None)], "word string, word_kind string")
    return docs, known, spark.createDataFrame([("Loric Tolvini",), ("Zintra",), (None,)], "brand string")


def test_the_corpus_tells_ambiguous_numbers_apart(spark):
    rows, want = corpus()
    got = {(r["doc_id"], r["pii_kind"], r["start_pos"]) for r in pii.found(*tables(spark, rows)).collect()}
    assert got == want


def test_unknown_names(spark):
    rows = [(i, f"Best regards, {g} Wexholt") for i, g in enumerate(["Loen", "Velric", "Kesric"])]
    got = {(r["doc_id"], r["pii_kind"], r["start_pos"]) for r in pii.found(*tables(spark, rows)).collect()}
    assert got == {(i, "person_name", 14) for i in range(3)}


def test_replacement_and_odd_rows(spark):
    long = "Nothing here. " * 20_000 + "Mail velen@box.invalid now."
    rows = [(1, "Thanks to Velen Drovini, mail velen@box.invalid or +49 30 23125981."), (2, None), (3, ""), (4, " \n"), (5, long), (6, "plain"), (6, "plain"), (None, "Ms Tolvwyn")]
    args = tables(spark, rows)
    out = pii.sanitised(*args).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["text"] == "Thanks to [PERSON], mail [EMAIL] or [PHONE]." and by[1]["replaced"] == 3
    assert by[2]["text"] is None and by[3]["text"] == "" and by[4]["text"] == " \n" and by[6]["text"] == "plain"
    assert by[5]["text"] == "Nothing here. " * 20_000 + "Mail [EMAIL] now." and by[None]["text"] == "Ms [PERSON]"
    assert pii.found(*tables(spark, [])).count() == 0
    empty = [t.limit(0) for t in args[1:]]
    assert {r["pii_kind"] for r in pii.found(args[0], *empty).collect()} == {"email", "phone"}


@pytest.mark.parametrize("unit", ["a", "ab-", "1", "a.", "+49 30 23125981 ", "Velen Xyzzy ", " at ", "1 a b c d ", "rue de la ", '"', "&", "Ã¸", "calle a b "])
def test_long_texts_take_time_in_proportion(unit):
    import time

    began = time.process_time()
    pii.find_forms(pii.normal_form(unit * (200_000 // len(unit)))[0], MODEL)
    assert time.process_time() - began < 5


def test_the_corpus_can_overrule_a_pattern(spark):
    """What looks like a phone by its pattern stays if the corpus knows what stands there as numbers of things."""
    rows = [(i, f"Order no. X{i:010d} took 8 days") for i in range(300)]
    rows += [(500 + i, f"Please ring +49 30 2312{i:04d} after six.") for i in range(40)]
    rows.append((900, "Order no. (984) 555-0120 took 8 days"))
    got = {(r["doc_id"], r["pii_kind"]) for r in pii.found(*tables(spark, rows)).collect()}
    assert got == {(500 + i, "phone") for i in range(40)}


def test_overlapping_forms_are_one_case(spark, monkeypatch):
    docs, known, items = tables(spark, [(1, "abcdefghijklmnop")])
    found = [(0, "phone", 2, 8, True, [], 1), (0, "id_number", 5, 11, False, [], 1), (0, "email", 11, 13, True, [], 1)]

    def forms(documents, *lists):
        uid = documents.first()["uid"]
        return spark.createDataFrame([(uid, *f[1:]) for f in found], pii.FORMS)

    monkeypatch.setattr(pii, "read_forms", forms)
    monkeypatch.setattr(pii, "THRESHOLD", -1.0)
    assert sorted((r["pii_kind"], r["start_pos"]) for r in pii.found(docs, known, items).collect()) == [("email", 11), ("phone", 2)]
    assert pii.sanitised(docs, known, items).first()["text"] == "ab[PHONE][EMAIL]nop"


@pytest.mark.parametrize("text", ["x" * 60 + " SSN 997174442 " + "y" * 60, "1" + "a" * 50 + " Tel. +49 30 23125981", "0044 7700 900710" + " " * 40 + "0044 7700 900711", "RSSMRA85T10A562S und 1-620-555-0102", "key ABCD-EFAB-12CD" + " " * 30 + "B12345678901"])
def test_numbers_far_from_each_other(text):
    """Looking only near digits finds what a search through the whole text finds."""
    t = pii.normal_form(text)[0]
    for p in (pii.SURE_ID, pii.SURE_PHONE, pii.MAYBE_ID, pii.MAYBE_PHONE, pii.THING):
        whole = [m.span() for m in p.finditer(t)]
        assert [m.span() for a, b in pii.regions_of(t) for m in p.finditer(t, a, b)] == whole


def test_spelled_addresses_with_rare_endings(spark):
    """The corpus decides on an address whose "at" is spelled and whose ending is on no list."""
    rows = [(i, f"Please mail me: velen{i}@box.invalid now") for i in range(30)]
    rows += [(100, "Please mail me: anna at firma dot ch now"), (101, "It had arrived at that point we were glad"), (102, "Order no. X0123456789 at shop dot ch is late")]
    rows += [(200 + i, f"Order no. X{i:010d} at the shop took 8 days") for i in range(30)]
    got = {(r["doc_id"], r["pii_kind"], r["start_pos"]) for r in pii.found(*tables(spark, rows)).collect()}
    assert got == {(i, "email", 16) for i in (*range(30), 100)}
