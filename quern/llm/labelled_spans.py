"""Labelled spans for the tagger: lines of a bounded sample of documents, and invented sentences.

Nothing here is used when a corpus is searched. Names in documents are labelled
by word lists alone, not by the phrases around them: the list of known name
parts is widened by the words that stand beside known parts (``widened``), and
two or more parts in a row are a name. The other kinds are labelled by their
shapes. Every labelled line is used as it is and again with its items exchanged
for invented ones, and the frames of ``FRAMES`` are filled with invented items,
so that the tagger learns shapes and many surroundings rather than the names.
``HELD_FRAMES`` are never trained on; they measure how well other text is read.
"""

from __future__ import annotations

import random
import re
from collections import Counter

from quern.llm import shapes

_PART = shapes._NAME
_PAIR = re.compile(rf"(?<![\w@'’-])({_PART})(,? )(?:[^\W\d_]\. )?(?=({_PART})(?![\w'’-]))")

#: A word that is no part of an address, a path or a compound name.
_ALONE = re.compile(rf"(?<![\w@'’.+/-]){_PART}(?![\w'’@+/-]|\.\w)")


def widened(texts: list[str], given: set[str], family: set[str], rounds: int = 4, least: int = 3) -> tuple[set[str], set[str]]:
    """The given and family names of a list, in lower case, with words of the texts that behave like them.

    A given name stands before family names, a family name behind given ones; a word counts, whether listed or not, if a fair share
    of its occurrences are such and it is seldom in lower case. So listed ordinary words drop out.
    """
    pairs: Counter = Counter()
    upper: Counter = Counter()
    lower: Counter = Counter()
    for t in texts:
        for w in _ALONE.findall(t):
            (upper if w[0].isupper() else lower)[w.lower()] += 1
        for m in _PAIR.finditer(t):
            a, b = m.group(1), m.group(3)
            if m.group(2) == " " and a[0].isupper() and b[0].isupper():
                pairs[a.lower(), b.lower()] += 1
    given, family = {p.lower() for p in given}, {p.lower() for p in family}
    for _ in range(rounds):
        as_given: dict[str, Counter] = {}
        as_family: dict[str, Counter] = {}
        for (a, b), n in pairs.items():
            if b in family:
                as_given.setdefault(a, Counter())[b] += n
            if a in given:
                as_family.setdefault(b, Counter())[a] += n

        def fits(w: str, partners: Counter) -> bool:
            return len(partners) >= least and partners.total() >= 0.35 * upper[w] and upper[w] >= 4 * lower[w]

        given = {w for w, c in as_given.items() if fits(w, c)}
        family = {w for w, c in as_family.items() if fits(w, c)}
    return given, family


def name_spans(text: str, parts: set[str]) -> list[tuple[int, int]]:
    """Runs of two or more known parts, with initials and one unknown part beside or between them; the case must agree."""
    found = []
    words = [m for m in re.finditer(rf"(?<![\w@.-]){_PART}(?![\w@]|['’]\w)", text)]
    k = 0
    while k < len(words):
        if words[k].group().lower() not in parts:
            k += 1
            continue
        run = [words[k]]
        k += 1
        while k < len(words):
            gap = text[run[-1].end() : words[k].start()]
            w = words[k].group()
            initial = len(w) == 1 and text[words[k].end() : words[k].end() + 1] == "."
            if gap in (" ", ", ", ". ") and (w.lower() in parts or initial) and (gap != ". " or len(run[-1].group()) == 1):
                run.append(words[k])
                k += 1
            else:
                break
        end = run[-1].end() + (1 if len(run[-1].group()) == 1 and text[run[-1].end() : run[-1].end() + 1] == "." else 0)
        if sum(len(m.group()) > 1 for m in run) >= 2:
            found.append((run[0].start(), end))
    return found


def label(text: str, parts: set[str]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items of a text; parts in lower case."""
    spans: list[tuple[int, int, str]] = []

    def add(found: list[tuple[int, int]], kind: str) -> None:
        spans.extend((a, b, kind) for a, b in found if all(b <= x or a >= y for x, y, _ in spans))

    add(shapes.emails(text), "email")
    add(shapes.labelled_identities(text), "id_number")
    add(shapes.addresses(text), "address")
    add(shapes.phones(text), "phone")
    add(name_spans(text, parts), "name")
    return sorted(spans)


# invented text

_SYLLABLES = "ba be bri bro ca cel cor da del dor el en fa fen gar gre ha hel il jo ka kel lo lun ma mor na nor ol pa per qui ra ros sa sel ta tor ul va vel wen xa yor za zel".split()
_CYRILLIC = "ан бо ва ве гри да ев же за ив ка ла ли ма ми на ни ол па ра ро са се та ти фе хо чер ша юр яр".split()
# Common given and family names of many countries.
GIVEN = (
    "James Mary John Linda Robert Susan Michael Karen David Nancy Thomas Emma Daniel Olivia Hannah Lukas Anna Klaus Heike Jürgen Sofía Carlos María José "
    "Lucía Pierre Chloé Jean-Luc Amélie Marco Giulia Luca Ingrid Lars Björn Astrid Mikko Aino Piotr Agnieszka Jan Zuzanna Ivan Olga Dmitri Yuki Haruto Sakura "
    "Wei Li Min Jiho Priya Arjun Ananya Rahul Fatima Omar Layla Ahmed Amara Kwame Chidi Thandi Noah Siobhán Rhys Leila Tariq Nguyet Minh Иван Мария Сергей Анна"
).split()
FAMILY = (
    "Smith Johnson Brown Taylor Miller Wilson Anderson Walker Wright Clarke Murphy O'Neill McDonald Schmidt Müller Weber Fischer Schäfer García Martínez López "
    "Hernández Dubois Moreau Lefèvre Rossi Bianchi Ferrari Hansen Johansson Lindström Korhonen Kowalski Nowak Novák Horvat Popescu Ivanov Petrova Tanaka Suzuki "
    "Watanabe Chen Wang Zhang Kim Park Nguyen Tran Patel Sharma Raman Gupta Khan Hussain Al-Farsi Haddad Okafor Mensah Dlamini Silva Santos Goldberg Cohen Levi "
    "Иванов Смирнова Кузнецов"
).split()
PARTICLES = ["van", "van der", "van den", "von", "von der", "de", "de la", "del", "da", "dos", "di", "bin", "al", "zu", "le"]

FRAMES = """
Please contact {name} about the {w}.
Contact: {name}
Contact person is {name}, phone {phone}
Patient: {name}, born {year}
Dear {name},
Dear Dr. {name},
Met {name} at the {w}
We met {name} and {name} near the {w} yesterday.
{name} joined the call late.
{name} wrote:
On Tuesday {name} presented the {w} to the board.
My colleague {name} will send the {w} tomorrow.
Mr. {name} and Mrs. {name} live at {address}.
The report was written by {name} in {year}.
According to {name}, the {w} needs another {w}.
From: {name} <{email}>
To: {name} <{email}>, {email}
Name: {name}
Name: {name} Phone: {phone}
name={name}; mail={email}; tel={phone}
{name},{email},{phone},{year}
Employee {name} has SSN {id} and lives at {address}
IBAN DE89 3704 0044 0532 0130 00, SSN {id}
Passport {id} was issued to {name} in {year}.
Her social security number is {id}.
His tax ID ({id}) was on the form.
National insurance number: {id}
Driver license {id}, class B
Insurance number {id} belongs to {name}
Identity card no {id}
Ship the parcel to {address} before noon.
I live at {address}; ring {phone} first.
Our new office: {address}
Mailing address: {address}
{name} ({email}) reported the broken {w}.
You can reach me under {phone} or {email}.
Reach out to {email} with questions about the {w}.
Tel {phone}
Mobile: {phone}, fax: {phone}
Phone number {phone} is not in service.
Send an sms to {phone}.
Write to {email}!
E-mail: {email}
Herr {name} wohnt in der {address}.
Ansprechpartner ist {name}, Telefon {phone}
Bitte wenden Sie sich an Frau {name} ({email}).
Die Steuer-ID von {name} lautet {id}.
Mit freundlichen Grüßen, {name}
La señora {name} vive en {address}.
Llame a {name} al {phone}.
El DNI de {name} es {id}.
M. {name} habite au {address}.
Bonjour {name}, merci pour le {w}.
Le numéro de passeport est {id}
Свяжитесь с {name} по телефону {phone}
{name} живёт по адресу {address}
Паспорт {id} выдан на имя {name}
Regards, {name}
Yours sincerely, {name}, {address}
Kind regards {name}
Approved: {name}
Assigned to {name} ({year})
Witness {name} stated that the {w} was open.
interview with {name} about the {w}
# written by {name} for the {w} project
// contact {name} at {email}
-- created {year} by {name}
/* questions: {name}, {phone} */
"customer": "{name}", "mobile": "{phone}"
"address": "{address}", "id_no": "{id}"
user {email} logged in from {ip}
| {name} | {email} | {phone} |
{name} - {phone}
{name} | {address}
speaker: {name}, moderator: {name}
The winner is {name}!
We thank {name}, {name} and {name} for their {w}.
I asked {name} why the {w} was late
guest list: {name}; {name}; {name}
the keys are with {name}, {address}
Dr {name} prescribed it on {year}-03-02.
{name}'s {w} was stolen.
It is {name} who owns the {w}.
"""
HELD_FRAMES = """
Kindly get in touch with {name} regarding the {w}.
Tenant: {name}, flat number pending
Hello {name}, how was the {w}?
Yesterday {name} phoned from {phone}.
The lecture by {name} drew a crowd.
Sent by {name} <{email}> last night
Applicant {name} gave {phone} as a number.
forward everything to {email} please
Deliver to: {address}
She moved to {address} in {year}.
SSN on file: {id}
passport number {id} expired
The book belongs to {name}.
Frau {name} ist unter {phone} erreichbar.
Escriba a {name}, {email}.
Monsieur {name} travaille ici.
Автор письма {name}, почта {email}
{name}, {address}, {phone}
// ping {name} when the {w} breaks
"employee": "{name}", "email": "{email}"
Cheers, {name}
Tax identification number {id} is wrong
"""
PLAIN = """
The {C} {C} is a popular framework for {w}.
New York and San Francisco are far from the {w}.
{C} Studio {n} was released in {year}.
order number {n9} has shipped
Order #{n9} of {year}
build {n9} failed after {n} steps
request id {n9} took {n} ms
commit {hex} broke the {w}
ISBN 978-{n}-{n}-{n}-{n1}
see section {n1}.{n}.{n1} and table {n}
version {n1}.{n}.{n1} of the {w}
git clone git@{host}:team/{w}.git
scp backup deploy@{ip}:/srv/{w}
ssh admin@{ip} -p {n}
server at {ip}:{n} answered in {n} ms
The {C} Team fixed the {w}.
Ask the Platform Team or the Release Crew about the {w}.
{given} wants to sort the {w}.
{given} and {given} play with {n} stones.
Thanks {given}!
@{handle} please look at the {w}
{C} {C} {C}
Pull Request {n} by {handle}
Status: In Progress
Given an array of {n} integers, return the {w}.
GET /api/{w}/{n9} HTTP/1.1
{n} {n} {n} {n} {n9}
timestamp={n9} size={n9}
tracking code {n9}{n} arrived
checksum {n9} differs from {n9}
import {C} from "@{w}/{w}"
Le Petit Chat dort.
Das Große Haus steht leer.
Next {w} is at {n1}:{n} on Monday.
meet at noon in room {n}
Alan said hello; Maria waved.
The Quick Start guide of {C} Server
Copyright {year} {C} Foundation
Price: {n} EUR, invoice {n9}
x = {n9} + {n9}
""" 
#: Words that may stand before an item.
LEADS = {
    "name": "by with from for and Mr. Mrs. Dr. author: name: von Herr Frau señora to said @ (see hi hello with: owner user".split(),
    "phone": "call phone phone: tel. Tel: mobile telephone fax: no. at number under Telefon тел.".split(),
    "id_number": ["SSN", "ssn:", "social security number", "passport", "passport no.", "passport number:", "tax id", "tax number", "TIN", "NI number", "national insurance no.", "national id", "identity card", "driving licence", "driver's license no.", "licence number:", "DNI", "NIE", "Steuer-ID", "Ausweis", "паспорт", "ИНН", "insurance number", "personal number"],
    "address": "at in to: address: lives office: Adresse from near visit ship home: location deliver".split(),
    "email": "mail email: e-mail to from contact at write user: by cc".split(),
}
_WORDS = "report ticket bridge window garden parcel meeting engine backup archive letter printer festival contract sample schedule budget station library form".split()


class Inventor:
    """Invented items of each kind."""

    def __init__(self, seed: int, parts: list[str], words: list[str] = []):
        self.r = random.Random(seed)
        self.parts = parts
        self.words = words or _WORDS

    def word(self) -> str:
        r = self.r
        if self.parts and r.random() < 0.15:
            return r.choice(self.parts)
        w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 4))) + r.choice(["", "", "n", "r", "s", "th", "rd", "wyn", "son", "ova", "el"])
        w = w.replace("a", r.choice("aaaaaáä"), 1).replace("o", r.choice("oooooöø"), 1).replace("e", r.choice("eeeeeéë"), 1)
        if r.random() < 0.12:
            w += "-" + "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 2))).capitalize()
        elif r.random() < 0.06:
            return r.choice("DO") + "'" + w.capitalize()
        return w[0].upper() + w[1:]

    def name(self) -> str:
        r = self.r
        if r.random() < 0.06:
            g, f = (("".join(r.choice(_CYRILLIC) for _ in range(r.randint(2, 4)))).capitalize() for _ in range(2))
            return f"{g} {f}" if r.random() < 0.85 else f"{f}, {g}"
        g = r.choice(GIVEN) if r.random() < 0.45 else self.word()
        f = r.choice(FAMILY) if r.random() < 0.45 else self.word()
        if r.random() < 0.1:
            f = f"{r.choice(PARTICLES)} {f}"
        x = r.random()
        if x < 0.14:
            return f"{f}, {g}" + (f" {r.choice('ABCDEFGHJKLMNOPRSTVW')}." if r.random() < 0.3 else "")
        if x < 0.28:
            g += f" {r.choice('ABCDEFGHJKLMNOPRSTVW')}."
        elif x < 0.4:
            g += " " + (r.choice(GIVEN) if r.random() < 0.5 else self.word())
        elif x < 0.44:
            g = f"{r.choice('ABCDEFGHJKLMNOPRSTVW')}."
        s = f"{g} {f}"
        y = r.random()
        return s.upper() if y < 0.08 else s.lower() if y < 0.15 else f"{f.upper()} {g}" if y < 0.2 else s

    def _digits(self, form: str) -> str:
        r = self.r
        return "".join(r.choice("0123456789") if c == "#" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "@" else c for c in form)

    def phone(self) -> str:
        return self._digits(self.r.choice((
            "+1 ### ### ####", "+## ## #### ####", "(###) ###-####", "###-###-####", "0## #### ####", "+44 (0)## #### ####", "0###/#######", "+1-###-###-####", "0# ## ## ## ##",
            "+7 (###) ###-##-##", "+## ### ######", "00## ## ### ####", "0#### ######", "###.###.####", "+###########", "+##.#.##.##.##.##", "(0#) #### ####", "00##-##-#####-###", "+## ## ##### ###",
        )))

    def id(self) -> str:
        return self._digits(self.r.choice((
            "###-##-####", "### ## ####", "#########", "@@######@", "@@ ## ## ## @", "@########", "@@#######", "##.##.##-###.##", "########@", "## ## ######", "@###-####-####", "####-###-####", "## ### ### ###",
        )))

    def address(self) -> str:
        r = self.r
        s, town, n = self.word().split("-")[0], self.word().split("-")[0], str(r.randint(1, 999)) + r.choice(["", "", "", "a", "b"])
        post = self._digits(r.choice(["#####", "@@## #@@", "@# #@@", "@@# #@@"]))
        form = r.choice((
            f"{n} {s} Street, {town} {post}", f"{n} {s} Road, {town}", f"{n} {s} Ave, {town} {post}", f"{n} {s} {r.choice(['Lane', 'Drive', 'Way', 'Close', 'Terrace', 'Gardens', 'Rd', 'St.', 'Blvd', 'Court'])}, {town}, {post}",
            f"Flat {r.randint(1, 40)}, {n} {s} {r.choice(['Terrace', 'Gardens', 'Street'])}, {town} {post}", f"{n} {s} {r.choice(['Street', 'Avenue', 'Lane'])}", f"{n} {s} Way Apt {r.randint(1, 60)}, {town} {post}",
            f"{s}{r.choice(['straße', 'str.', 'weg', 'gasse', 'platz', 'allee'])} {n}, {self._digits('#####')} {town}", f"{n}, rue {r.choice(['du', 'de la', 'de', 'des'])} {s}, {self._digits('#####')} {town}",
            f"calle {s} {n}, {self._digits('#####')} {town}", f"Calle {s} {n}, {r.randint(1, 9)}.º {r.choice('ABCD')}, {self._digits('#####')} {town}", f"PO Box {r.randint(10, 9999)}, {town} {post}",
            f"ул. {''.join(r.choice(_CYRILLIC) for _ in range(3)).capitalize()}, д. {r.randint(1, 120)}" + r.choice(["", f", кв. {r.randint(1, 200)}", f", {self._digits('######')} г. {''.join(r.choice(_CYRILLIC) for _ in range(3)).capitalize()}"]),
        ))
        return form.upper() if r.random() < 0.06 else form

    def email(self) -> str:
        r = self.r
        a, b = (re.sub(r"[^a-z]", "", self.word().lower()) or "kim" for _ in range(2))
        local = r.choice([f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a[0]}{b}", f"{a}{r.randint(1, 99)}", f"{a}+{b}", f"{a}.{b}{r.randint(1, 99)}", a])
        host, end = r.choice([a, b, "mail", "post", "inbox", f"mail.{b}"]), r.choice("com org net de fr io example test co.uk ru".split())
        x = r.random()
        if x < 0.72:
            s = f"{local}@{host}.{end}"
            return s.title() if r.random() < 0.08 else s
        at, dot = r.choice([(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" AT ", "."), (" AT ", " DOT "), ("{at}", "{dot}")])
        return local + at + f"{host}.{end}".replace(".", dot)

    def varied(self, kind: str, old: str) -> str:
        """Another item of the kind: names anew, others with other digits and words of the same build."""
        r = self.r
        if kind == "name":
            return self.name()
        if r.random() < 0.15:
            return {"phone": self.phone, "id_number": self.id, "address": self.address, "email": self.email}[kind]()
        out = re.sub(r"\d", lambda m: m.group() if m.group() in "0" and r.random() < 0.5 else r.choice("0123456789"), old)
        if kind == "address":
            out = re.sub(r"\b[A-Z][a-z]{5,}(?=\b)", lambda m: m.group() if r.random() < 0.4 or re.fullmatch(shapes._STREET, m.group(), re.I) else self.word().split("-")[0], out)
        if kind == "email":
            out = re.sub(r"^[A-Za-z]+", lambda m: re.sub(r"[^a-z]", "", self.word().lower()) or "x", out, count=1)
        return out

    def placed(self, line: str) -> tuple[str, list[tuple[int, int, str]]]:
        """A line without items into which one or two are put at word ends, sometimes with a word of introduction."""
        r = self.r
        kind, make = r.choice([("name", self.name), ("name", self.name), ("name", self.name), ("phone", self.phone), ("id_number", self.id), ("address", self.address), ("address", self.address), ("email", self.email)])
        gaps = [m.start() for m in re.finditer(r"(?<=\S)(?= )|$|^", line)]
        at = r.choice(gaps)
        lead = r.choice(LEADS[kind]) if r.random() < (0.9 if kind == "id_number" else 0.4) else ""
        if kind != "id_number" and r.random() < 0.25:
            lead = " ".join(r.choice(self.words) for _ in range(r.randint(1, 2))).capitalize() + r.choice(["", "", ":", ","])
        if r.random() < 0.15:
            line, at = "", 0
        item = make()
        before = line[:at] + (" " if at and line[:at].strip() else "") + lead + (" " if lead and r.random() < 0.9 else "")
        after = r.choice(["", "", "", ",", ".", ";", ")", " -", ":", "'s"]) if kind == "name" else r.choice(["", "", ".", ",", ";", ")"])
        rest = line[at:] if line[at : at + 1] == " " or not line[at:] else " " + line[at:]
        return before + item + after + rest, [(len(before), len(before) + len(item), kind)]

    def framed(self, frame: str) -> tuple[str, list[tuple[int, int, str]]]:
        """A frame with its places filled, and the spans of the items."""
        r = self.r
        out, spans, size = [], [], 0
        makers = {"name": ("name", self.name), "phone": ("phone", self.phone), "id": ("id_number", self.id), "address": ("address", self.address), "email": ("email", self.email)}
        plain = {
            "w": lambda: r.choice(_WORDS), "C": lambda: r.choice([r.choice(_WORDS).capitalize(), self.word(), r.choice(_WORDS).capitalize()]), "year": lambda: str(r.randint(1930, 2030)), "n": lambda: str(r.randint(10, 999)), "n1": lambda: str(r.randint(0, 9)),
            "n9": lambda: self._digits("#" * r.randint(7, 13)), "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([7, 12, 40]))), "ip": lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)),
            "host": lambda: f"{r.choice(_WORDS)}.{r.choice(['com', 'org', 'io', 'example'])}", "given": lambda: r.choice([r.choice(GIVEN), self.word()]), "handle": lambda: r.choice(_WORDS) + r.choice(["", "-", "_"]) + r.choice(_WORDS) + str(r.randint(1, 99)),
        }
        for piece in re.split(r"(\{\w+\})", frame):
            slot = piece[1:-1] if piece.startswith("{") and piece.endswith("}") else None
            if slot in makers:
                kind, make = makers[slot]
                piece = make()
                spans.append((size, size + len(piece), kind))
            elif slot in plain:
                piece = plain[slot]()
            out.append(piece)
            size += len(piece)
        text = "".join(out)
        if r.random() < 0.25:
            lead = r.choice(["// ", "# ", "- ", "* ", "  ", "\t", " * ", "> ", "-- "])
            text, spans = lead + text, [(a + len(lead), b + len(lead), k) for a, b, k in spans]
        return text, spans


def exchanged(text: str, spans: list[tuple[int, int, str]], inventor: Inventor) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with every item exchanged for an invented one."""
    out, new, at = [], [], 0
    size = 0
    for a, b, kind in spans:
        item = inventor.varied(kind, text[a:b])
        out += [text[at:a], item]
        size += a - at
        new.append((size, size + len(item), kind))
        size += len(item)
        at = b
    return "".join([*out, text[at:]]), new
