import pytest

from corpusloom.llm import pii

LEX = pii.Lexicon(
    ["Dagny", "José-Mael", "Émeric", "Zoë", "Viggo", None, " "],
    [f"{p}{s}{e}" for p, s in (("", "Albriv"), ("van ", "Korbzu"), ("O'", "Velkt"), ("de la ", "Ostenk"), ("al-", "Brosazu")) for e in ("aja", "üller", "sson", "quist")] + [None, "Smith"],
)
FINDER = pii.Finder(LEX)


def spans(text):
    return [(s.kind, text[s.start : s.end]) for s in FINDER.find(text)]


CASES = [
    ("write to dagny.albrivaja@dunmarsh.example.com now", [("email", "dagny.albrivaja@dunmarsh.example.com")]),
    ("mailto:fleet.desk@korbeck.example.", [("email", "fleet.desk@korbeck.example")]),
    ("<d_a9+noc (at) tessel.example.net>", [("email", "d_a9+noc (at) tessel.example.net")]),
    ("a-b [at] norvik-hall [dot] corp [dot] example pls", [("email", "a-b [at] norvik-hall [dot] corp [dot] example")]),
    ("dagny7 at zarnow dot example dot org or", [("email", "dagny7 at zarnow dot example dot org")]),
    ("we met at noon; package oskfesol@8.7.8 is pinned, ping @fleet", []),
    ("ring +44 20 7946 0016, or (305) 555-0177, 01.99.00.82.46; 030/23125099", [("phone", "+44 20 7946 0016"), ("phone", "(305) 555-0177"), ("phone", "01.99.00.82.46"), ("phone", "030/23125099")]),
    ("Order 9764478778 and part 249-00-032-560, lot 4704/838960, meter 87235549", []),
    ("call 2125550192 on 2024-05-14 01:47:06", [("phone", "2125550192")]),
    ("SSN: 666-04-4162; passport no. XQ8294980", [("id_number", "666-04-4162"), ("id_number", "XQ8294980")]),
    ("Versicherungsnummer 38123439U, DNI 06 032 450 032", [("id_number", "38123439U"), ("id_number", "06 032 450 032")]),
    ("at Flat 25, 62 Weaver's Way, Mirefield", [("address", "Flat 25, 62 Weaver's Way")]),
    ("in der Alte Ziegelei-straße 98 b; Lindhaingasse 54", [("address", "Alte Ziegelei-straße 98 b"), ("address", "Lindhaingasse 54")]),
    ("vive en Calle de los Tejares 94, 2.º B", [("address", "Calle de los Tejares 94, 2.º B")]),
    ("to 1579 Marsh Ave, Apt 1, Morvemouth 00579 and 209 Osier Rd., Tollen Ridge XQ3 9KM, or 7 Ninth Lane, Velmouth", [("address", "1579 Marsh Ave, Apt 1, Morvemouth 00579"), ("address", "209 Osier Rd., Tollen Ridge XQ3 9KM"), ("address", "7 Ninth Lane")]),
    ("Room 84, South Wing; 12 lanes on the main street; The Row 5", []),
    ("hi, it's dagny al-albrivaja here", [("name", "dagny al-albrivaja")]),
    ("Mrs. van Korbzusson met D. Velktquist", [("name", "van Korbzusson"), ("name", "D. Velktquist")]),
    ("ALBRIVÜLLER, Zoë and É. O'Velktaja", [("name", "ALBRIVÜLLER, Zoë"), ("name", "É. O'Velktaja")]),
    ("José-Mael de la\nOstenksson signed", [("name", "José-Mael de la\nOstenksson")]),
    ("Albriv & Velkt Ltd. and the Albrivsson group", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_mentions(text, want):
    assert spans(text) == want


def test_disguises_map_back_to_the_source():
    text = "mail dagny.аlbrivaja＠dunmarsh．example，or call zero one six three two nine six zero zero four five today"
    assert spans(text.replace("，", " ")) == [
        ("email", "dagny.аlbrivaja＠dunmarsh．example"), ("phone", "zero one six three two nine six zero zero four five"),
    ]
    hidden = "​Dag​ny Albriv­aja rang +44​20 7946 0016"
    assert spans(hidden) == [("name", "Dag​ny Albriv­aja"), ("phone", "+44​20 7946 0016")]


def test_redaction_keeps_the_rest():
    text = "Ask Dagny Albrivaja (dagny@zarnow.example), 62 Weaver's Way, \tthanks."
    assert pii.redact(text, FINDER.find(text)) == "Ask [NAME] ([EMAIL]), [ADDRESS], \tthanks."
    assert pii.redact(None, []) is None and pii.redact("", []) == ""


def test_frames(spark):
    rows = [(1, "Dagny Albrivaja", "x"), (1, "Dagny Albrivaja", "x"), (2, None, "x"), (3, "", "x"), (4, "x " * 100_000 + "SSN 666-04-4162", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    staff = spark.createDataFrame([("Dagny", "Albrivaja"), ("Dagny", "Albrivsson"), ("Zoë", "Velktaja"), ("Zoë", "Velktsson"), (None, None)], "given_name string, family_name string")
    lex = pii.lexicon_of(staff)
    got = sorted((r["doc_id"], r["kind"], r["start_at"]) for r in pii.mentions(docs, lex).collect())
    assert got == [(1, "name", 0), (1, "name", 0), (4, "id_number", 200_004)]
    texts = {r["doc_id"]: (r["text"], r["mentions"]) for r in pii.redacted(docs, lex).collect()}
    assert texts[1] == ("[NAME]", 1) and texts[2] == (None, 0) and texts[3] == ("", 0)
    assert pii.mentions(docs.limit(0), lex).count() == 0
    with pytest.raises(ValueError):
        pii.lexicon_of(staff, most=2)
    assert pii.Finder(pii.Lexicon([], [])).find("a@b.example")[0].kind == "email"


#: People, streets and mailboxes that share no part with the directory. ``{{kind:text}}`` marks a mention.
STRANGERS = r"""
Please ask Mr {{name:Kowalczyk}} about the badge.
Dr. {{name:Nakamura}} will see you at noon.
Herr {{name:Oberhauser}} und Frau {{name:Brandstetter}} sind informiert.
Sra. {{name:Echeverría}} llamó ayer.
Mrs. {{name:O'Callaghan}} signed for the parcel.
Prof. {{name:Lindqvist-Berg}} moved the meeting? No.
Dear {{name:Agnieszka Kowalczyk}},
Dear {{name:Tomasz Wiśniewski}}, your badge is ready.
Hola {{name:Itziar Echeverría}}, gracias por venir.
Hallo {{name:Jürgen Oberhauser}}!
Kind regards,\n{{name:Priya Raghunathan}}
Mit freundlichen Grüßen\n{{name:Jürgen Oberhauser}}
Un saludo,\n{{name:Begoña Urrutia}}
Name: {{name:Oluwaseun Adebayo}}
Contact: {{name:Kenji Nakamura}}, room 4
Ansprechpartner: {{name:Wolfgang Hinterseer}}
Nombre: {{name:Xabier Goikoetxea}}
{{name:Fatima Benali}} <{{email:fatima.benali@orchard-mill.example}}> wrote:
{{name:Dagny Kowalczyk}} and {{name:Zoë Nakamura}} met.
Mr {{name:J. Kowalczyk}} rang.
Mr {{name:Dagny Oberhauser}} rang.
Frau {{name:van Houten}} kommt später.
write to {{email:john dot smith at example dot com}} today
or {{email:j [dot] doe [at] quiet-mill [dot] example}} please
or {{email:kenji.nakamura@bluepost.example.org}} instead
mail {{email:agnes_k+lab{at}stonefort{dot}example}} first
ring {{phone:plus four four two zero seven nine four six zero zero one six}} today
ring {{phone:+49 30 23125 456}} or {{phone:(212) 555-0143}} later
ring {{phone:zero one six three two nine six zero zero four five}} now
her SSN is {{id_number:666-12-3456}}, do not share
passport no. {{id_number:ZK4471102}} expires soon
He lives at {{address:12 Hill Rise}} now.
She moved to {{address:12 Kestrel Broadway}} in May.
Send it to {{address:Flat 3, 88 Juniper Crescent}} please.
Parcels go to {{address:7 Old Tannery Lane}} only.
Er wohnt in der {{address:Buchenhainstraße 14}} seit Mai.
Vive en {{address:Calle del Almendro 22}} desde mayo.
The Fleet Planner met the Wexnysol Board on Monday.
Dear Support Team,
Dear Customer, your order 4471102 is on its way.
Name: Fleet Desk
Contact: Lanrostadt Relay
Kind regards,\nThe Fleet Desk
Ms Excel and Dr. Board are no people.
Herr im Haus, Frau am Steuer.
Room 12 Hill; order no. 212-555-0143; part 4471-102
"""


def test_people_who_are_in_no_directory():
    import collections
    import re

    common = "the fleet planner support team customer excel desk relay order kind people room your this met".split()
    finder = pii.Finder(pii.Lexicon(["Dagny", "José-Mael", "Émeric", "Zoë", "Viggo"], ["Albrivaja", "Korbzuüller", "Velktsson", "Ostenkquist"], common))
    right, found, wanted = collections.Counter(), collections.Counter(), collections.Counter()
    wrong = []
    for line in STRANGERS.strip().split("\n"):
        line = line.replace("\\n", "\n")
        text, want, at = "", set(), 0
        for m in re.finditer(r"\{\{(\w+):(.*?)\}\}(?!\})", line, re.S):
            text += line[at : m.start()]
            want.add((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        text += line[at:]
        got = {(s.kind, s.start, s.end) for s in finder.find(text)}
        wrong += [(k, text[a:b], text) for k, a, b in got ^ want]
        for counter, spans_ in ((right, got & want), (found, got), (wanted, want)):
            counter.update(k for k, _, _ in spans_)
    for kind in pii.KINDS:
        assert right[kind] >= 0.9 * wanted[kind] and right[kind] >= 0.9 * found[kind], (kind, wrong)


def test_words_of_the_documents(spark):
    docs = spark.createDataFrame([(i, "the wharf is Closed, Marta" if i % 2 else "marta The Wharf") for i in range(8)] + [(9, None), (10, "")], "doc_id bigint, text string")
    assert pii.common_words(docs) == pii.common_words_of(r["text"] for r in docs.collect())
    assert {"wharf", "the"} <= pii.common_words(docs) and "closed" not in pii.common_words(docs)
    assert pii.common_words(docs.limit(0)) == set()
