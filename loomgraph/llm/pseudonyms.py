"""Format-preserving pseudonyms for personal data.

Values are found by pattern, checked (Luhn, mod 97, octets, calendar) and replaced by a keyed permutation
of the set of all values of their format: a Feistel network over the value's number, walked until it lands
inside the set again. The permutation is one cycle through the whole set, so no value is its own pseudonym.
The replacement has the format, length and checksum of what it replaces, and equal values become equal
pseudonyms in every document, however their digits are grouped. Whoever has the key can undo them: it comes
from the caller or the session and is never a constant."""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import bounded_batches, table

#: Session setting of the key, in hex; Spark hides values of such names in its logs and listings.
KEY_SETTING = "spark.loomgraph.pseudonyms.secret"
ROUNDS = 8


def session_key(spark: SparkSession) -> bytes:
    """The session's key; a session without one gets a random one, so values stay linked within it only."""
    got = spark.conf.get(KEY_SETTING, None)
    if got is None:
        got = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, got)
    return bytes.fromhex(got)


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_CLASS = {c: group for group in (_LOWER, _UPPER, _DIGIT) for c in group}
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permute(value: int, size: int, key: bytes, kind: str, inverse: bool = False) -> int:
    """A keyed permutation of range(size): balanced Feistel rounds, repeated while outside of the range."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, tweak = (1 << half) - 1, f"{kind}/{size}".encode()
    width = (half + 7) // 8

    def turn(k: int, x: int) -> int:
        h = hashlib.blake2b(x.to_bytes(width, "big"), key=key[:64], digest_size=min(64, width + 8), salt=bytes([k]), person=hashlib.blake2b(tweak, digest_size=16).digest())
        got = h.digest()
        while len(got) < width:
            got += hashlib.blake2b(got, key=key[:64]).digest()
        return int.from_bytes(got, "big") & mask

    while True:
        left, right = value >> half, value & mask
        if inverse:
            for k in reversed(range(ROUNDS)):
                left, right = right ^ turn(k, left), left
        else:
            for k in range(ROUNDS):
                left, right = right, left ^ turn(k, right)
        value = left << half | right
        if value < size:
            return value


def moved(value: int, size: int, key: bytes, kind: str, inverse: bool = False) -> int:
    """The value's successor in the order that the key gives range(size): one cycle, no value stays."""
    if size < 2:
        return value
    at = permute(value, size, key, kind) + (-1 if inverse else 1)
    return permute(at % size, size, key, kind, inverse=True)


def _digits(number: str, key: bytes, kind: str) -> str:
    """As many digits."""
    return str(moved(int(number), 10 ** len(number), key, kind)).zfill(len(number))


def _filled(shape: str, digits: str) -> str:
    """The shape with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


#: Characters that are permuted as one number; longer values in blocks, each under its own number.
BLOCK = 128


def _letters(text: str, key: bytes, kind: str, alphabet: dict | None = None) -> str:
    """Each letter or digit replaced within its class, all together as one number of mixed radix."""
    if len(text) > BLOCK:
        return "".join(_letters(text[k : k + BLOCK], key, f"{kind} {k}" if k else kind, alphabet) for k in range(0, len(text), BLOCK))
    of = alphabet or _CLASS
    value, size = 0, 1
    for c in text:
        if c in of:
            value, size = value * len(of[c]) + of[c].index(c), size * len(of[c])
    value, out = moved(value, size, key, kind), []
    for c in reversed(text):
        if c in of:
            value, k = divmod(value, len(of[c]))
            c = of[c][k]
        out.append(c)
    return "".join(reversed(out))


_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"} | {c: "ABCDEF" for c in "ABCDEF"}


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def luhn_valid(digits: str) -> Callable[[int, int], bool]:
    """Whether the digits from one place to another end in their check digit: by sums in which every other digit is doubled."""
    doubled = [2 * int(c) - 9 * (c > "4") for c in digits]
    sums = [[0, *accumulate(doubled[k] if k % 2 == odd else int(c) for k, c in enumerate(digits))] for odd in (0, 1)]
    return lambda start, end: (sums[end % 2][end] - sums[end % 2][start]) % 10 == 0


#: Digit groups that cards are printed in; one group alone is one too.
_PRINTED = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}


def _card_spans(text: str, taken) -> list[tuple[int, int]]:
    """Valid cards in every run of digit groups: any whole groups of 13 to 19 digits that pass Luhn, so a number beside a card
    doesn't hide it. Groups as cards are printed go first, then by place, longest first; other spans must not cut a phone number."""
    got: list[tuple[int, int]] = []
    mine, phones = Taken(), None  # phones don't overlap
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 13:
            continue
        groups = [m.span() for m in _GROUP.finditer(text, *run.span())]
        at = [0, *accumulate(e - s for s, e in groups)]  # digits before each group
        valid = luhn_valid("".join(text[s:e] for s, e in groups))
        spans = []
        for i in range(len(groups)):
            for j in range(bisect_left(at, at[i] + 13, i) - 1, len(groups)):
                if at[j + 1] - at[i] > 19:
                    break
                if valid(at[i], at[j + 1]):
                    printed = i == j or tuple(e - s for s, e in groups[i : j + 1]) in _PRINTED
                    spans.append((not printed, i, -j))
        for odd, i, j in sorted(spans):
            s, e = groups[i][0], groups[-j][1]
            if mine(s, e) or taken(s, e):
                continue
            if odd:
                if phones is None:
                    phones = Taken()
                    for m in _PHONE.finditer(text):
                        phones.add(*m.span())
                if phones.inside(s) or phones.inside(e):
                    continue
            got.append((s, e))
            mine.add(s, e)
    return got


def _card(shape: str, key: bytes) -> str:
    payload = _digits(re.sub(r"\D", "", shape)[:-1], key, "card")
    return _filled(shape, payload + luhn_digit(payload))


def _ip(m: re.Match, key: bytes) -> str | None:
    octets = [int(x) for x in m[0].split(".")]
    if max(octets) > 255:
        return None
    got = moved(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, got.to_bytes(4, "big")))


def _phone(m: re.Match, key: bytes) -> str | None:
    d = re.sub(r"\D", "", m[0])
    if not 10 <= len(d) <= 15:
        return None
    head = d[:-10] if len(d) > 10 else ""  # the country's code stays
    return _filled(m[0], head + _digits(d[len(head) :], key, "phone"))


def _ssn(m: re.Match, key: bytes) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    d = m[0].replace("-", "")
    if not valid(d):
        return None
    while True:  # stays inside of the valid numbers
        d = _digits(d, key, "ssn")
        if valid(d):
            return _filled(m[0], d)


def _date(m: re.Match, key: bytes, day_first: bool = True) -> str | None:
    """Year first, or the day before the month where that can be (day_first=False: the month before the day)."""
    parts = [int(x) for x in re.split(r"\D", m[0])]
    year_first = len(re.split(r"\D", m[0])[0]) == 4
    for order in ((0, 1, 2),) if year_first else ((2, 1, 0), (2, 0, 1))[:: 1 if day_first else -1]:
        try:
            day = datetime.date(*(parts[k] for k in order)).toordinal()
        except ValueError:
            continue
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None
        d = datetime.date.fromordinal(_FIRST_DAY + moved(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, key, "date"))
        new = dict(zip(order, (d.year, d.month, d.day)))
        widths = [len(x) for x in re.split(r"\D", m[0])]
        marks = re.findall(r"\D", m[0]) + [""]
        return "".join(str(new[k]).zfill(widths[k]) + marks[k] for k in range(3))
    return None


def _iban(m: re.Match, key: bytes) -> str | None:
    flat = m[0].replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _letters(flat[4:], key, "iban")
    new = flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in m[0])


#: Characters of an address's name and domain, at most.
_NAME, _DOMAIN = 64, 255
_OF_NAME, _AFTER_AT = re.compile(r"[\w.+%-]"), re.compile(r"@[\w-]++(?:\.[\w-]++)+")
_PLAIN_NAME = re.compile(r"[A-Za-z0-9_.+%-]")


def _emails(text: str) -> Iterator[re.Match]:
    """Mail addresses, sought from each @ backwards: a text's length in time, whatever stands before the @.

    The name is what can be one; where that is too long, as in unspaced scripts, its last plain letters."""
    at = until = 0
    while (at := text.find("@", at)) >= 0:
        m = _AFTER_AT.match(text, at)
        start = at
        while m and start > until and at - start <= _NAME and _OF_NAME.match(text[start - 1]):
            start -= 1
        if at - start > _NAME:
            start = at
            while start > until and at - start <= _NAME and _PLAIN_NAME.match(text[start - 1]):
                start -= 1
        at += 1
        if m and 1 < at - start <= _NAME + 1 and m.end() - at <= _DOMAIN:
            yield _EMAIL.match(text, start, m.end())
            at = until = m.end()


def _email(m: re.Match, key: bytes) -> str:
    local, _, domain = m[0].partition("@")
    got = _letters(local, key, "email")
    return f"{got}@{domain}" if got != local else f"{local}@{_letters(domain, key, 'email')}"  # a name without letters


def _secret(m: re.Match, key: bytes) -> str:
    at = m.start(1) - m.start()
    value = m[1]
    same = _HEX if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else None
    return m[0][:at] + _letters(value, key, "secret", same) + m[0][at + len(value) :]


def _access(m: re.Match, key: bytes) -> str:
    return m[0][:4] + _letters(m[0][4:], key, "access", {c: _UPPER + _DIGIT for c in _UPPER + _DIGIT})


_NUMBER = None
_EMAIL = re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+")
_RUN, _GROUP = re.compile(r"(?<![\w+.-])\d++(?:[ -]\d++)*(?!-?\w)"), re.compile(r"\d+")
_PHONE = re.compile(r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!-?\w)|(?<!\w)\+\d[\d ().-]{8,18}\d(?!\w)")
#: kind, of what a text must contain one for it (_NUMBER: any digit; in lower case for secrets), pattern, replacement (None: the value isn't valid and stays)
KINDS = [
    ("email", ("@",), _EMAIL, _email),  # found by _emails
    ("secret", ("token", "secret", "passw", "key"), re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_-]{8,})"), _secret),
    ("access", ("AKIA", "ASIA"), re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)"), _access),
    ("iban", _NUMBER, re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)"), _iban),
    ("date", _NUMBER, re.compile(r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w-])"), _date),
    ("ip", _NUMBER, re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"), _ip),
    ("ssn", _NUMBER, re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _ssn),
    ("card", _NUMBER, _RUN, None),  # its spans are found by _card_spans
    ("phone", _NUMBER, _PHONE, _phone),
]
_ANY_DIGIT = re.compile(r"\d")


class Taken:
    """Places that don't overlap, and whether one more would."""

    def __init__(self):
        self.starts, self.ends = [], {}

    def add(self, start: int, end: int) -> None:
        insort(self.starts, start)
        self.ends[start] = end

    def inside(self, at: int) -> bool:
        """A place has begun before it and goes on after it."""
        k = bisect_left(self.starts, at)
        return bool(k and self.ends[self.starts[k - 1]] > at)

    def __call__(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return bool(k and self.ends[self.starts[k - 1]] > start or k < len(self.starts) and self.starts[k] < end)


def pseudonymised(text: str | None, key: bytes, day_first: bool = True) -> tuple[str | None, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and (kind, start, end, pseudonym) of each value, by original offsets.

    Null stays null. Kinds are sought in a fixed order; a place that one kind has taken is closed to the
    later ones. day_first: how dates are read that can be read in two ways. Not sought, as nothing tells them from other
    numbers and words: phone and social security numbers without marks, IPv6, dates with a month's name. The time grows
    with the text's length, also where it has no blanks."""
    if not text:
        return text, []
    found, taken, folded, digits = [], Taken(), text.casefold(), _ANY_DIGIT.search(text)
    for kind, needs, pattern, of in KINDS:
        if not (digits if needs is _NUMBER else any(x in (folded if kind == "secret" else text) for x in needs)):
            continue
        if kind == "card":
            new = [(kind, s, e, _card(text[s:e], key)) for s, e in _card_spans(text, taken)]
        else:
            new = []
            for m in _emails(text) if kind == "email" else pattern.finditer(text):
                if not taken(*m.span()):
                    got = of(m, key, day_first) if kind == "date" else of(m, key)
                    if got is not None:
                        new.append((kind, *m.span(), got))
        for _, s, e, _ in new:
            taken.add(s, e)
        found += new
    found.sort(key=lambda x: x[1])
    out, at = [], 0
    for _, s, e, new in found:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), found


def pseudonymise(docs: DataFrame, key: bytes, out: str = "found", day_first: bool = True) -> DataFrame:
    """All columns of docs with the text replaced, and `out`: array of (kind, start, end, pseudonym).

    Rows are independent: no shuffle. Null and empty texts have an empty array; a column of docs
    that has the name `out` is replaced; no rows give no rows."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(out)
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{out}` array<struct<kind:string,start:int,end:int,pseudonym:string>>"
    names = [*docs.columns, out]

    def of(batches):
        for b in batches:
            got = [pseudonymised(x.as_py(), key, day_first) for x in b.column(at)]
            cols = list(b.columns)
            cols[at] = pa.array([t for t, _ in got], pa.string())
            found = [[{"kind": k, "start": s, "end": e, "pseudonym": p} for k, s, e, p in f] for _, f in got]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, kind)], names)

    return docs.mapInArrow(of, schema)


def op7_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """doc_id, the text with pseudonyms by the session's key, how many values it had and where, of all documents."""
    got = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return got.select("doc_id", "text", F.size("found").alias("n_found"), "found")
