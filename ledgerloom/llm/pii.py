"""Format-preserving pseudonyms for personal data and secrets.

Values are found by pattern and validated (Luhn, mod 97, octets, calendar, numbering plan); what fails validation stays.
A value is read as a number in the mixed radix of its format and permuted by a keyed Feistel network over exactly that
range (cycle walking), so the pseudonym has the same format and validity, and equal values get equal pseudonyms in
every document. Digits keep the value's own punctuation.

Of US-style phones, bare digit groups follow the numbering plan (area code and exchange begin with 2-9). With
``any_area``, as the queries have it, '+1 (ddd) ddd-dddd' and '(ddd) ddd-dddd' are phones whatever their digits, and such
a form is permuted within all ten-digit numbers.

Cases: null text stays null, empty text empty; a value is replaced wherever it stands, however long the text; repeated
rows give repeated results; every other column, whatever its name, passes unchanged. A permutation over a small range
can map a value to itself (chance 1 / size of the range).
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Recent, fresh, map_batches, table

#: Default key; a deployment passes its own.
KEY = b"change-me"
ROUNDS, MEMO = 8, 100_000
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date", "secret")

#: Patterns start at a border and run possessively, so a scan is linear in the text.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)"
    r"|(?P<secret>(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|(?<![A-Za-z0-9_])(?i:password|passwd|secret|token|api_?key)(?:\s?[=:]\s?)[\"']?(?P<hidden>[A-Za-z0-9_\-]{8,}+))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d\d?-\d\d?|\d\d?(?P<sep>[./])\d\d?(?P=sep)\d{4})(?![\w/-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w.-])(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?![\w-])"
    # digit runs are taken whole, so there is one way to match
    r"|(?<![\w+])\+[2-9]\d*+(?:[ .-]?\(\d++\)?|[ .-]\d++\)?|(?<=\))\d++){0,6}(?![\w-]))"
)
#: A phone whose area code stands in brackets.
BRACKETS = r"(?:\+?1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}"
WRITTEN = re.compile(BRACKETS)
ANY_AREA = re.compile(PATTERN.pattern.replace("(?P<phone>", rf"(?P<phone>(?<![\w.-]){BRACKETS}(?![\w-])|"))
_RUN = re.compile(r"[A-Za-z0-9]++|.", re.DOTALL)
_HINT = re.compile(r"[0-9@]")


def permute(value: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network on enough bits, walked until it is in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    tag = f"{label}:{size}:".encode()
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            mixed = hashlib.blake2b(tag + b"%d:%d" % (r, right), key=key, digest_size=(half + 7) // 8 + 8).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def permute_digits(radix: list[tuple[int, int]], key: bytes, label: str) -> list[int]:
    """Digits of the pseudonym of the mixed-radix number [(digit, base), ...]."""
    value = size = 0
    for digit, base in radix:
        value, size = value * base + digit, (size or 1) * base
    value = permute(value, size, key, label)
    out = []
    for _, base in reversed(radix):
        value, digit = divmod(value, base)
        out.append(digit)
    return out[::-1]


_CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase)


def permute_text(text: str, key: bytes, label: str) -> str:
    """Each digit stays a digit, each small letter a small and each capital a capital letter; the rest stands."""
    alphabets = [next((a for a in _CLASSES if c in a), None) for c in text]
    radix = [(a.index(c), len(a)) for c, a in zip(text, alphabets) if a]
    if not radix:
        return text
    shape = "".join("-" if a is None else str(_CLASSES.index(a)) for a in alphabets)
    digits = iter(permute_digits(radix, key, label + shape))
    return "".join(c if a is None else a[next(digits)] for c, a in zip(text, alphabets))


def _filled(template: str, digits: str) -> str:
    """``template`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


def luhn_digit(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + "".join(map(str, permute_digits([(int(c), 10) for c in digits[1:-1]], key, "card")))
    return _filled(text, body + str(luhn_digit(body)))


def _iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = permute_text(plain[4:], key, "iban")
    made = plain[:2] + f"{98 - _iban_rest(plain[:2] + '00' + body):02d}" + body
    it = iter(made)
    return "".join(c if c == " " else next(it) for c in text)


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    a, g, s = permute_digits([(area - 1 - (area > 666), 898), (group - 1, 99), (serial - 1, 9999)], key, "ssn")
    a += 1 + (a >= 665)
    return f"{a:03d}-{g + 1:02d}-{s + 1:04d}"


def _phone(text: str, key: bytes, any_area: bool = False) -> str | None:
    digits = re.sub(r"\D", "", text)
    if any_area and WRITTEN.fullmatch(text):
        new = permute_digits([(int(c), 10) for c in digits[-10:]], key, "phone-any")
        return _filled(text, digits[:-10] + "".join(map(str, new)))
    if text[0] == "+" and digits[0] != "1":  # other countries: the first two digits, which hold the code, stay
        if not 8 <= len(digits) <= 15:
            return None
        tail = "".join(map(str, permute_digits([(int(c), 10) for c in digits[2:]], key, "phone")))
        return _filled(text, digits[:2] + tail)
    lead, local = digits[:-10], digits[-10:]
    radix = [(int(c) - 2, 8) if i in (0, 3) else (int(c), 10) for i, c in enumerate(local)]
    new = permute_digits(radix, key, "phone")
    return _filled(text, lead + "".join(str(d + 2 if i in (0, 3) else d) for i, d in enumerate(new)))


def _ip(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    return ".".join(map(str, permute_digits([(x, 256) for x in octets], key, "ip")))


def _date(text: str, key: bytes) -> str | None:
    sep = next(c for c in text if not c.isdigit())
    parts = text.split(sep)
    orders = ((0, 1, 2),) if sep == "-" else ((2, 1, 0),) if sep == "." else ((2, 0, 1), (2, 1, 0))
    for order in orders:
        try:
            day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
        for i, n in zip(order, (new.year, new.month, new.day)):
            parts[i] = f"{n:02d}" if len(parts[i]) == 2 else str(n)
        return sep.join(parts)
    return None


def _email(text: str, key: bytes) -> str | None:
    local, _, domain = text.partition("@")
    return permute_text(local, key, "email@" + domain.lower()) + "@" + domain


_MAKERS: dict[str, Callable[[str, bytes], str | None]] = {
    "email": _email,
    "iban": _iban,
    "card": _card,
    "ssn": _ssn,
    "ip": _ip,
    "date": _date,
}


def pseudonym(kind: str, value: str, key: bytes, any_area: bool = False) -> str | None:
    """The pseudonym of a found value; None where it isn't valid."""
    if kind == "phone":
        return _phone(value, key, any_area)
    if kind == "secret":
        head = "AKIA" if value.startswith("AKIA") else ""
        return head + permute_text(value[len(head) :], key, "secret")
    return _MAKERS[kind](value, key)


def replace(
    text: str, known: Callable[[tuple[str, str]], str | None], counts: list[int], pattern: re.Pattern = PATTERN
) -> str:
    """``text`` with pseudonyms; ``counts`` gets the number of values of each of ``KINDS``."""
    if not _HINT.search(text) and "=" not in text and ":" not in text:
        return text
    out, last, at = [], 0, 0
    while m := pattern.search(text, at):
        kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k] is not None)
        group = "hidden" if kind == "secret" and m["hidden"] is not None else kind
        made = known((kind, m[group]))
        if made is not None:
            a, b = m.span(group)
            out += text[last:a], made
            at = last = b
            counts[KINDS.index(kind)] += 1
        else:  # another kind may begin inside it, after this run of digits or letters
            at = _RUN.match(text, m.start()).end()
    return "".join(out) + text[last:] if out else text


def pseudonymise(
    docs: DataFrame, key: bytes = KEY, text: str = "text", counts: bool = True, any_area: bool = False
) -> DataFrame:
    """``docs`` with the text column replaced and, if ``counts``, a column n_<kind> for each of ``KINDS``; ``any_area``:
    phones in brackets have any area code."""
    names = [fresh(docs, f"n_{k}") for k in KINDS] if counts else []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Recent(lambda kv: pseudonym(kv[0], kv[1], key, any_area), MEMO)
        for rows in batches:
            at = rows.schema.get_field_index(text)
            made, found = [], []
            for x in rows.column(at).to_pylist():
                c = [0] * len(KINDS)
                made.append(None if x is None else replace(x, memo.__getitem__, c, ANY_AREA if any_area else PATTERN))
                found.append(c)
            arrays = list(rows.columns)
            arrays[at] = pa.array(made, pa.string())
            arrays += [pa.array([c[k] for c in found], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rows.schema.names, *names])

    fields = [f"`{n}` {t}" for n, t in docs.dtypes] + [f"`{n}` long" for n in names]
    return map_batches(docs, task, ", ".join(fields))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, any_area=True).select("doc_id", *[f"n_{k}" for k in KINDS], "text", F.sha2("text", 256).alias("text_sha256"))
