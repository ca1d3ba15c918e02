"""What personal items look like: the shapes used to label training text. Nothing here is used when a corpus is searched."""

from __future__ import annotations

import re

KINDS = ("email", "phone", "id_number", "address", "name")

_NAME = r"[^\W\d_][^\W\d_'’]*(?:['’][^\W\d_]+)?(?:-[^\W\d_][^\W\d_'’]*)*"
_TOWN = r"[^\W\d_]{3,}(?:[- ][^\W\d_]{3,})?"
_STREET = r"street|st\.|road|rd\.?|lane|ln\.?|drive|dr\.?|way|avenue|ave\.?|boulevard|blvd\.?|close|gardens|terrace|court|place|square|crescent|grove|row|mews|walk"

EMAIL = re.compile(
    r"(?<![\w.+@/-])(?:[A-Za-z0-9][\w.+-]*[@＠][A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
    r"|[A-Za-z0-9][\w.+-]*(?: ?\(at\) ?| ?\[at\] ?| ?\{at\} ?| AT )[A-Za-z0-9-]+(?:(?: ?\[dot\] ?| ?\(dot\) ?| ?\{dot\} ?| DOT |\.)[A-Za-z0-9-]+)+"
    r"|[A-Za-z0-9][\w.+-]* at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)(?![\w-])"
)
_LOGIN = re.compile(r"(?:\bssh|\bscp|\brsync)\s+(?:-\w+\s+)*$")

PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,5}){2,6}"
    r"|00\d{2}(?:[ -]\d{2,5}){2,4}"
    r"|\(\d{2,4}\) ?\d{3,4}[ -]\d{4}"
    r"|\d{3}[./-]\d{3}[.-]\d{4}"
    r"|0\d{2,4} \d{3,4} ?\d{3,4}"
    r"|0\d(?: \d\d){4}"
    r"|\d{3}-\d{4}"
    r")(?![\w/]|[.-]\d)"
)

IDENTITY = re.compile(
    r"(?<![\w.+/-])(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{9}|\d{2} \d{3} \d{3} \d{3}|[A-Z]{1,2}\d{7,8}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}[A-Z]"
    r"|\d{2} \d{2} \d{6}|[A-Z]\d{3}-\d{4}-\d{4}|\d{4}-\d{3}-\d{4}|\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2})(?![\w/]|[.-]\d)"
)
IDENTITY_LABEL = re.compile(
    r"(?:\bssn|social security(?: number| no\.?)?|tax id|\btin|passport(?: no\.?| number)?|national id|national insurance(?: no\.?| number)?|\bni number"
    r"|(?:driving|driver'?s) licen[cs]e(?: number| no\.?)?|\bdni|\bnie|паспорт|\bинн|\bснилс|(?:personal)?ausweis(?:-nr\.?)?|steuer-id|insee)[\s:=#\"'«]*$",
    re.I,
)
NO_IDENTITY = re.compile(r"(?:order number|build|isbn|table|section|request id|step|commit)[\s:=#\"']*$", re.I)

ADDRESS = re.compile(
    r"(?<![\w.+/-])(?:"
    rf"(?:(?:flat|apt\.?|unit) \d+[a-z]?, )?\d{{1,5}}[a-z]? (?:[^\W\d_][\w'’-]* ){{1,3}}(?:{_STREET})(?: (?:apt|unit|suite) \d+)?, {_TOWN}(?: (?:\d{{5}}|[A-Z]{{1,2}}\d{{1,2}} \d[A-Z]{{2}}))?"
    rf"|\d{{1,4}}, (?:rue|avenue|place|boulevard) (?:du |de la |des |de )?[^\W\d_][\w'’-]*, \d{{5}} {_TOWN}"
    rf"|calle [^\W\d_][\w'’-]* \d{{1,4}}, (?:\d+\.º [A-Z], )?\d{{5}} {_TOWN}"
    rf"|[^\W\d_]+(?:straße|strasse|str\.|weg|gasse|platz|allee) \d{{1,4}}[a-z]?, \d{{5}} {_TOWN}"
    rf"|P\.?O\.? Box \d+, {_TOWN}(?: \d{{5}})?"
    rf"|ул\. [^\W\d_]+, д\. \d+(?:, кв\. \d+)?(?:, (?:\d{{6}} )?г\. {_TOWN})?"
    r")(?!\w)",
    re.I,
)

NAME = re.compile(rf"{_NAME}, {_NAME}(?: {_NAME}| [^\W\d_]\.)?|{_NAME}(?: [^\W\d_]\.| {_NAME}){{0,2}} {_NAME}")
TITLE = re.compile(r"(?:dr|mr|mrs|ms|prof|herr|frau|sr|sra)\.? ", re.I)


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses, without logins on machines."""
    return [
        m.span() for m in EMAIL.finditer(text)
        if not (text[m.end() : m.end() + 1] == ":" and text[m.end() + 1 : m.end() + 2].strip()) and not _LOGIN.search(text[max(0, m.start() - 40) : m.start()])
    ]


def phones(text: str) -> list[tuple[int, int]]:
    """Numbers of seven or more digits; those without plus or bracket do not stand within a row of numbers."""
    return [
        m.span() for m in PHONE.finditer(text)
        if sum(c.isdigit() for c in m.group()) >= 7
        and (m.group()[0] in "+(" or not re.search(r"\d $", text[max(0, m.start() - 2) : m.start()]) and not re.match(r" \d", text[m.end() : m.end() + 2]))
    ]


def identities(text: str) -> list[tuple[int, int]]:
    """Numbers of the right build that nothing names as an order, build or catalogue number; digits alone need the name of what they are."""
    out = []
    for m in IDENTITY.finditer(text):
        before = text[max(0, m.start() - 40) : m.start()]
        if not NO_IDENTITY.search(before) and (any(c.isalpha() for c in m.group()) or IDENTITY_LABEL.search(before)):
            out.append(m.span())
    return out


def labelled_identities(text: str) -> list[tuple[int, int]]:
    return [s for s in identities(text) if IDENTITY_LABEL.search(text[max(0, s[0] - 40) : s[0]])]


def addresses(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ADDRESS.finditer(text)]
