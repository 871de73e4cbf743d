"""Small made-up inputs for rules that ordinary documents don't exercise; persons, numbers and domains are invented."""

from __future__ import annotations

#: (case, rule group, text). Rows whose case begins with "no" hold look-alikes that must find nothing.
TEXTS = (
    ("ssn dashed", "ssn", "Social Security no 219-55-0143 on file"),
    ("ssn spaced", "ssn", "he wrote 219 55 0143 here"),
    ("ssn plain", "ssn", "SSN: 219550143"),
    ("no ssn", "ssn", "serial 219550143 and 000-12-3456 and 219-00-1234"),
    ("date birth", "date", "DOB 04/17/1988"),
    ("date generic", "date", "seen on 4/17/2021 there"),
    ("date long", "date", "on March 3rd, 2020 and 5 May 2019"),
    ("date wrapped", "date", "date of birth 12-22-\n2001."),
    ("no date", "date", "ratio 13/45/2020 and 1/2"),
    ("phone brackets", "phone", "call (212) 555-0147 now"),
    ("phone dotted", "phone", "212.555.0147"),
    ("phone labelled", "phone", "cell 2125550147"),
    ("phone wrapped", "phone", "at 212-\n555-0147 later"),
    ("no phone", "phone", "part 2125550147 and 12-212-555-01478"),
    ("address full", "address", "lives at 12 Elm Street Apt 4, Dayton, OH 45402"),
    ("address box", "address", "P.O. Box 77"),
    ("address located", "address", "the house located at 450 Wexford"),
    ("address glued", "address", "831 hillviewblvd"),
    ("address city", "address", "of Troy, MI 48083"),
    ("no address", "address", "at 1:30 PM and 61 and Summit Drive; at 0304 Hours"),
    ("licence", "licence", "DL: B95674861 DOB 04"),
    ("licence words", "licence", "driver's license number 12 345 678 STATE"),
    ("no licence", "licence", "state ID card holder"),
    ("passport", "passport", "Passport No. X1234567"),
    ("no passport", "passport", "passport control"),
    ("card", "card", "paid 4111 1111 1111 1111 today"),
    ("account", "card", "account # 0012-3456-78"),
    ("no card", "card", "4111 1111 1111 1112 and 0000000000000000"),
    ("vin", "vehicle", "VIN 1HGBH41JXMN109186"),
    ("plate", "vehicle", "plate: KY 2027 Y5C400"),
    ("no vehicle", "vehicle", "registration plates and ABCDEFGHJKLMNPRST"),
    ("justice", "justice", "FBI No. 123456AB7"),
    ("badge", "justice", "Badge #\n4471"),
    ("no justice", "justice", "arrest warrant"),
    ("born in", "birth", "born in San Marcos, Texas then"),
    ("maiden", "birth", "mother's maiden name: Okafor"),
    ("ip", "ip", "from 10.0.0.7 then"),
    ("no ip", "ip", "v1.2.3.4.5 and 300.1.1.1 and ends 1.2.3.4."),
    ("handle label", "handle", "username of kuttaosa and Instagram account big_money502"),
    ("handle export", "handle", "cole.2943 (Instagram: 52256127893)"),
    ("handle line", "handle", "river_stone- hey there"),
    ("handle shape", "handle", "wrote to bella_x55 twice"),
    ("no handle", "handle", "report.pdf 21st 10mm v1.2.3 example.com M22524112 Dear_ 2024-10-31"),
    ("link", "link", "see https://example.com/a?b=1\nc=2&d=3\nthe end."),
    ("link one", "link", "at www.example.org/x."),
    ("mail link", "link", "<mailto:a@example.org>"),
)
#: Found values by case: (case, category, confidence, text). Worked out by hand from the rules; no independent computation.
EXPECTED = (
    ("ssn dashed", "SocialSecurityNumber", 0.98, "219-55-0143"),
    ("ssn spaced", "SocialSecurityNumber", 0.9, "219 55 0143"),
    ("ssn plain", "SocialSecurityNumber", 0.9, "219550143"),
    ("date birth", "DateOfBirth", 0.95, "04/17/1988"),
    ("date generic", "Date", 0.4, "4/17/2021"),
    ("date long", "Date", 0.4, "March 3rd, 2020"),
    ("date long", "Date", 0.4, "5 May 2019"),
    ("date wrapped", "DateOfBirth", 0.95, "12-22-\n2001"),
    ("phone brackets", "PhoneNumber", 0.9, "(212) 555-0147"),
    ("phone dotted", "PhoneNumber", 0.9, "212.555.0147"),
    ("phone labelled", "PhoneNumber", 0.7, "2125550147"),
    ("phone wrapped", "PhoneNumber", 0.9, "212-\n555-0147"),
    ("address full", "Address", 0.95, "12 Elm Street Apt 4, Dayton, OH 45402"),
    ("address box", "Address", 0.9, "P.O. Box 77"),
    ("address located", "Address", 0.7, "450 Wexford"),
    ("address glued", "Address", 0.75, "831 hillviewblvd"),
    ("address city", "Address", 0.75, "Troy, MI 48083"),
    ("licence", "DriverLicense", 0.9, "B95674861"),
    ("licence words", "DriverLicense", 0.9, "12 345 678"),
    ("passport", "PassportNumber", 0.9, "X1234567"),
    ("card", "FinancialAccount", 0.9, "4111 1111 1111 1111"),
    ("account", "FinancialAccount", 0.85, "0012-3456-78"),
    ("vin", "VehicleIdentifier", 0.97, "1HGBH41JXMN109186"),
    ("plate", "VehicleIdentifier", 0.85, "Y5C400"),
    ("justice", "CriminalJusticeIdentifier", 0.85, "123456AB7"),
    ("badge", "CriminalJusticeIdentifier", 0.8, "4471"),
    ("born in", "PlaceOfBirth", 0.8, "San Marcos, Texas"),
    ("maiden", "MaidenName", 0.85, "Okafor"),
    ("ip", "IpAddress", 0.7, "10.0.0.7"),
    ("handle label", "OnlineHandle", 0.9, "kuttaosa"),
    ("handle label", "OnlineHandle", 0.9, "big_money502"),
    ("handle export", "OnlineHandle", 0.95, "cole.2943"),
    ("handle line", "OnlineHandle", 0.85, "river_stone"),
    ("handle shape", "OnlineHandle", 0.7, "bella_x55"),
    ("link", "WebAddress", 0.8, "https://example.com/a?b=1\nc=2&d=3"),
    ("link one", "WebAddress", 0.8, "www.example.org/x"),
    ("mail link", "WebAddress", 0.8, "<mailto:a@example.org>"),
)
GROUPS = {
    "ssn": ("ssn", "ssn plain"),
    "date": ("date m/d/yyyy", "date m/d/yy", "date yyyy/m/d", "date month d yyyy", "date d month yyyy"),
    "phone": ("phone", "phone plain"),
    "address": ("street", "po box", "located at", "glued street", "city line"),
    "licence": ("licence",),
    "passport": ("passport",),
    "card": ("card", "account"),
    "vehicle": ("vin", "plate"),
    "justice": ("justice id", "badge"),
    "birth": ("birth place", "maiden name"),
    "ip": ("ipv4",),
    "handle": ("handle labelled", "handle export account", "handle account", "handle export line", "handle shape"),
    "link": ("link", "mail link"),
}

#: (case, text) and what the name rules find: (case, confidence, text).
NAME_TEXTS = (
    ("titled", "We met Dr. Vela Okoro there."),
    ("role", "Defendant: Rosa Quill Police Department"),
    ("speech", "Marlowe stated that it rained."),
    ("initial", "they saw E. Burbage and left"),
    ("caps", "SMITHE, JOHN A"),
    ("mixed", "Okoro, James went home"),
    ("run", "then Laura Venn Department left"),
    ("alone", "later Laura left"),
    ("no name", "The County Report was on the Table."),
)
NAME_EXPECTED = (
    ("titled", 0.85, "Vela Okoro"),
    ("role", 0.85, "Rosa Quill"),
    ("speech", 0.7, "Marlowe"),
    ("initial", 0.65, "E. Burbage"),
    ("caps", 0.9, "SMITHE, JOHN A"),
    ("mixed", 0.85, "Okoro, James"),
    ("run", 0.8, "Laura Venn"),
    ("alone", 0.6, "Laura"),
)

#: (doc_id, page, text): values on one page that a second page repeats.
TWO_PAGES = (
    ("d1", 1, "Suspect: Marta Molina-Ortiz\nInstagram account quiet_fox9\ncall (212) 555-0147"),
    ("d1", 2, "Ortiz left. Oritz's car. Molina- was seen by quiet_fox9 at 2125550199."),
    ("d2", 1, "Ortiz and 2125550199 and oritz are elsewhere"),
)

#: (case, start, length, category, confidence, seq)
SPANS = (
    ("chain", 0, 10, "Name", 0.6, 1), ("chain", 8, 10, "Address", 0.7, 2), ("chain", 16, 10, "Date", 0.6, 3),
    ("longer", 0, 5, "Name", 0.8, 1), ("longer", 0, 9, "Address", 0.8, 2),
    ("tie", 3, 4, "Name", 0.9, 2), ("tie", 3, 4, "Address", 0.9, 1),
    ("apart", 0, 3, "Name", 0.1, 1), ("apart", 3, 3, "Date", 0.9, 2), ("empty", 5, 0, "Name", 1.0, 1),
)
#: (doc_id, page, idx, text, line, x, y, w, h)
WORDS = (
    ("d1", 1, 0, "alpha", 0, 0.0, 0.0, 25.0, 10.0), ("d1", 1, 1, "beta", 0, 30.0, 0.0, 20.0, 10.0), ("d1", 1, 2, "gamma", 1, 0.0, 12.0, 25.0, 10.0),
    ("d1", 2, 0, "delta", 0, 0.0, 0.0, 25.0, 10.0), ("d2", 1, 0, "omega", 0, 3.0, 1.0, 25.0, 10.0), ("d2", 1, 1, "thin", 0, 40.0, 1.0, 0.4, 10.0),
)
#: (doc_id, page, x, y, w, h, accepted): one rectangle each
BOXES = (("d1", 1, 28.0, 2.0, 10.0, 4.0, True), ("d1", 1, 0.0, 12.0, 5.0, 5.0, False), ("d2", 1, 29.6, 1.0, 5.0, 5.0, True))
#: (case, x, y, w, h, rotation, page_w, page_h)
RECTS = tuple((f"r{a}", 10.0, 20.0, 30.0, 5.0, a, 612.0, 792.0) for a in (0, 90, 180, 270, 45))
#: (doc_id, page, area_id, x, y, w, h)
AREAS = (("d1", 1, 1, 0.0, 0.0, 40.0, 8.0), ("d1", 1, 2, 500.0, 500.0, 20.0, 10.0), ("d2", 1, 3, 0.0, 0.0, 9.0, 20.0))
#: (doc_id, page, start, length, accepted) and (doc_id, page, start, length, accepted, removed, decided_at)
DECIDABLE = (("d1", 1, 0, 5, True), ("d1", 1, 9, 5, True), ("d1", 2, 0, 5, False), ("d2", 1, 0, 5, False))
DECISIONS = (("d1", 1, 0, 5, True, False, 1), ("d1", 1, 0, 5, False, False, 2), ("d1", 1, 9, 5, None, True, 1), ("d2", 1, 0, 5, True, False, 3), ("d2", 1, 0, 5, None, False, 4))
#: (a, b, whether one edit apart)
PAIRS = (("Ortiz", "Oritz", True), ("Ortiz", "Ortis", True), ("Ortiz", "Ortizz", True), ("Ortiz", "Orti", True), ("Ortiz", "ORTIZ", True), ("Ortiz", "Otriiz", False), ("Barrow", "Arrows", False), ("ab", "ba", True), ("abc", "cba", False))
#: (doc_id, page, idx, text, text_start, line, x, y, w, h): a boxed form
FORM = tuple(
    ("f1", 1, i, t, s, line, x, y, 0.6 * 4.4 * len(t), 4.4)
    for i, (t, s, line, x, y) in enumerate((
        ("DATE", 0, 0, 50.0, 100.0), ("OF", 5, 0, 64.0, 100.0), ("BIRTH", 8, 0, 72.0, 100.0), ("SSN", 14, 0, 300.0, 100.0),
        ("04", 18, 1, 52.0, 108.0), ("17", 21, 1, 62.0, 108.0), ("1988", 24, 1, 72.0, 108.0), ("219-55-0143", 29, 1, 300.0, 108.0),
        ("PHONE", 41, 2, 50.0, 150.0), ("none", 47, 3, 50.0, 158.0),
    ))
)
FORM_TEXT = "DATE OF BIRTH SSN\n04 17 1988 219-55-0143\nPHONE none"
FORM_EXPECTED = (("DateOfBirth", 0.95, "04 17 1988"), ("SocialSecurityNumber", 0.95, "219-55-0143"))
PATHS = ("a/report.PDF", "b/notes.txt", "scan.jpeg", "old.doc", "tool.exe", "README")
