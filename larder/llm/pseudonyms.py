"""Format-preserving pseudonyms for personal data (operator 7).

Values are found by patterns and then validated: card numbers by their check digit and length, IBANs
by their checksum and country length, IP addresses, dates and social security numbers by their ranges.
A valid value is written as a number in its format's range and permuted there by a keyed Feistel
network; the result has the same format and passes the same validation. The permutation depends on
the key and the format only, so equal values stay linked across documents, whatever signs are put
between their digits, and different values stay different.

    e-mail   letters and digits before the @, each within its alphabet or script; the domain stays
    phone    all digits after the country code of a + number of 8 to 15 digits in any groups (its first one to
             three digits up to a sign, else 1 or two digits), or all ten of a number without a +
    card     all digits but the last, which is computed anew
    iban     digits and letters after the check digits, which are computed anew; countries of the registry
    ssn      all valid numbers; ip  all addresses; date  all days of 1900 to 2099
    secret   hexadecimal or alphanumeric values that are assigned to a token, key or password

The key is a parameter. Texts without a digit or @ are passed on as they are, and each task needs one
batch of texts and a slice of it rewritten. Defined cases: a null text stays null; null ids and repeated ids stay rows; values
that fail validation are left alone, after shorter ends of an account or card number at borders of groups,
the other kinds at the same place and all later places have been tried; overlapping finds go to the first kind in the order above;
further columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.chunk_recipes import free_name
from larder.llm.encoding import give_back, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 8
SLICE_BYTES = 2 << 20  # of texts that are rewritten at once
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
ALPHABET_OF = {c: a for a in ALPHABETS for c in a}
# Lengths of account numbers by country, from the public IBAN registry.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BI=27, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22,
    DJ=27, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FK=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HN=28,
    HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25,
    MC=27, MD=24, ME=22, MK=19, MN=20, MR=27, MT=31, MU=30, NI=28, NL=18, NO=15, OM=23, PK=24, PL=28, PS=29, PT=25, QA=29,
    RO=24, RS=22, RU=33, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, SO=23, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29,
    VA=22, VG=24, XK=20, YE=30)

EMAIL = r"(?<![\w.%+\-])(?P<email>[\w.%+\-]{1,64})@(?=[A-Za-z0-9\-]+\.[A-Za-z0-9])"
SECRET = (r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|key)\b)[\"']?\s*[=:]\s*[\"']?"
          r"(?P<secret>[A-Za-z0-9_\-/+]{12,})")
IBAN = r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,29})(?![A-Za-z0-9])"
SSN = r"(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"
IP = r"(?<![\d.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)"
DATE = (r"(?<![\d./-])(?P<date>(?:19|20)\d\d(?P<s>[-/.])\d{1,2}(?P=s)\d{1,2}|"
        r"\d{1,2}(?P<t>[-/.])\d{1,2}(?P=t)(?:19|20)\d\d)(?![\d/-]|\.\d)")
CARD = r"(?<![\d.])(?P<card>\d(?:[ -]?\d){12,18})(?![\d])"
PHONE = (r"(?<![\w.+])(?P<phone>\+[1-9](?:[ ./-]{0,2}\(?\d\)?){7,14}"
         r"|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]?\d{3,4})(?![\d])")
NUMBERS = {"iban": IBAN, "ssn": SSN, "ip": IP, "date": DATE, "card": CARD, "phone": PHONE}
WORDS = {"email": EMAIL, "secret": SECRET}
PASSES = [(re.compile("|".join(kinds.values())), {k: re.compile(p) for k, p in kinds.items()}) for kinds in (WORDS, NUMBERS)]
KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "secret")
FINDS = "array<struct<kind: string, start: int, length: int>>"


SCRIPTS: dict[str, str] = {}  # letters and digits beyond ALPHABETS, by script and kind; filled at first need


def script(c: str) -> str:
    return f"<{unicodedata.name(c, '').split(' ')[0]} {unicodedata.category(c)}>"


def alphabet_of(c: str) -> str | None:
    """The characters that c may give way to; the script is the first word of its name."""
    if c in ALPHABET_OF or not c.isalnum():
        return ALPHABET_OF.get(c)
    if not SCRIPTS:
        found = defaultdict(list)
        for other in map(chr, range(sys.maxunicode + 1)):
            if other.isalnum() and other not in ALPHABET_OF:
                found[script(other)].append(other)
        SCRIPTS.update((k, "".join(v)) for k, v in found.items())
    return SCRIPTS[script(c)]


class Feistel:
    """A keyed permutation of 0 .. size - 1 for any size; other tweaks give other permutations."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _value(self, tweak: bytes, step: int, x: int, below: int) -> int:
        size = (below.bit_length() + 7) // 8 + 8
        out, counter = b"", 0
        while len(out) < size:
            part = b"%d|%d|%d|%d|" % (step, x, below, counter) + tweak
            out += hashlib.blake2b(part, key=self.key, digest_size=64).digest()
            counter += 1
        return int.from_bytes(out[:size], "big") % below

    def permute(self, value: int, size: int, tweak: bytes) -> int:
        """Both parts of value are changed in turn; results of size and above are permuted again."""
        if size < 2:
            return value
        a = max(2, 1 << ((size - 1).bit_length() + 1) // 2)
        b = -(-size // a)
        while True:
            left, right = value // b, value % b
            for step in range(0, ROUNDS, 2):
                left = (left + self._value(tweak, step, right, a)) % a
                right = (right + self._value(tweak, step + 1, left, b)) % b
            value = left * b + right
            if value < size:
                return value

    def characters(self, text: str, tweak: bytes) -> str:
        """Letters and digits within their alphabets; other characters stay and are part of the format."""
        alphabets = {i: alphabet for i, c in enumerate(text) if (alphabet := alphabet_of(c))}
        value = 0
        size = 1
        form = "".join(str(ALPHABETS.index(ALPHABET_OF[c])) if c in ALPHABET_OF else script(c) if c.isalnum() else c for c in text)
        for i, alphabet in alphabets.items():
            value = value * len(alphabet) + alphabet.index(text[i])
            size *= len(alphabet)
        value = self.permute(value, size, tweak + form.encode())
        out = list(text)
        for i, alphabet in reversed(alphabets.items()):
            value, k = divmod(value, len(alphabet))
            out[i] = alphabet[k]
        return "".join(out)


def check_digit(digits: str) -> str:
    """The digit that makes a card number valid."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def put_digits(shape: str, digits: str) -> str:
    """Replace a value's letters and digits in order; the signs between them stay."""
    fresh = iter(digits)
    return "".join(next(fresh) if c.isalnum() else c for c in shape)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def _email(self, value: str) -> str | None:
        if not any(alphabet_of(c) for c in value):
            return None
        return self.feistel.characters(value, b"email")

    def _secret(self, value: str) -> str | None:
        varied = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        if not varied:
            return None
        if re.fullmatch("[0-9a-f]+", value):
            size = 16 ** len(value)
            return f"{self.feistel.permute(int(value, 16), size, b'hex'):0{len(value)}x}"
        return self.feistel.characters(value, b"secret")

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        if IBAN_LENGTHS.get(plain[:2]) != len(plain) or iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        rest = self.feistel.characters(plain[4:], b"iban" + plain[:2].encode())
        return put_digits(value, plain[:2] + iban_check(plain[:2], rest) + rest)

    def _ssn(self, value: str) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        place = area - 1 - (area > 666)
        n = self.feistel.permute((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"ssn")
        n, serial = divmod(n, 9999)
        place, group = divmod(n, 99)
        area = place + 1 + (place >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _ip(self, value: str) -> str | None:
        parts = [int(x) for x in value.split(".")]
        if any(x > 255 for x in parts):
            return None
        n = self.feistel.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip")
        return ".".join(map(str, n.to_bytes(4, "big")))

    def _date(self, value: str) -> str | None:
        sign = re.search(r"\D", value)[0]
        parts = value.split(sign)
        year_first = len(parts[0]) == 4
        year, one, two = (parts[0], parts[1], parts[2]) if year_first else (parts[2], parts[1], parts[0])
        # Without the year in front it is day, month; if no such day exists, month, day.
        for month, day, turned in ((one, two, False), (two, one, True)):
            try:
                found = datetime.date(int(year), int(month), int(day)).toordinal() - FIRST_DAY
            except ValueError:
                continue
            if turned and year_first:
                return None
            new = datetime.date.fromordinal(FIRST_DAY + self.feistel.permute(found, DAYS, b"date"))
            month, day = f"{new.month:02d}", f"{new.day:02d}"
            if year_first:
                return sign.join((f"{new.year}", month, day))
            return sign.join((month, day, f"{new.year}") if turned else (day, month, f"{new.year}"))
        return None

    def _card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if check_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = self.feistel.permute(int(digits[:-1]), 10 ** (len(digits) - 1), b"card%d" % len(digits))
        body = f"{body:0{len(digits) - 1}d}"
        return put_digits(value, body + check_digit(body))

    def _phone(self, value: str) -> str | None:
        country = re.match(r"\+\d{1,3}(?=\D)|\+1(?=\d{10}$)|\+\d\d", value)
        head = country[0] if country else ""
        digits = re.sub(r"\D", "", value[len(head):])
        if not 7 <= len(digits) <= 13 and not value.startswith("+") or not (head or len(digits) == 10):
            return None
        new = self.feistel.permute(int(digits), 10 ** len(digits), b"phone%d" % len(digits))
        return head + put_digits(value[len(head):], f"{new:0{len(digits)}d}")

    def _at(self, text: str, begin: int, kinds: dict[str, re.Pattern]) -> tuple[int, int, str, str] | None:
        """Start, kind, value and pseudonym of the first kind with a valid value in a match that begins here."""
        for kind, pattern in kinds.items():
            match = pattern.match(text, begin)
            for old in self._ends(kind, match[kind], text[match.end() : match.end() + 64]) if match else ():
                new = getattr(self, f"_{kind}")(old)
                if new is not None:
                    return match.start(kind), KINDS.index(kind), old, new
        return None

    def _ends(self, kind: str, value: str, behind: str) -> Iterator[str]:
        """The value, then its shorter ends at borders of groups that may be valid: what follows may not belong to it."""
        if kind == "phone" and value.startswith("+"):
            yield from self._phone_ends(value, behind)
            return
        yield value
        if kind in ("iban", "card"):
            borders = [m.start() for m in re.finditer(r"[ -]", value)]
            for end in reversed(borders):
                size = sum(c.isalnum() for c in value[:end])
                if size == IBAN_LENGTHS.get(value[:2]) if kind == "iban" else size >= 13:
                    yield value[:end]

    def _phone_ends(self, value: str, behind: str) -> Iterator[str]:
        """A + number has no check: it ends before a group where a value of another kind begins, and +1 has ten digits."""
        for border in re.finditer(r"[ ./-]+(?=\d)", value):
            size = sum(c.isdigit() for c in value[: border.start()])
            if size == 11 and value.startswith("+1") or size >= 8 and any(
                    self._at(value + behind, border.end(), {k: p}) for k, p in PASSES[1][1].items() if k != "phone"):
                yield value[: border.start()]
                return
        yield value

    def replace(self, text: str) -> tuple[str, list[dict]]:
        """The text with pseudonyms, and kind, start and length (in the new text) of each."""
        finds = []
        for anything, kinds in PASSES:
            at = 0
            while match := anything.search(text, at):
                found = self._at(text, match.start(), kinds)
                if found:
                    finds.append(found)
                    at = found[0] + len(found[2])
                else:  # nothing valid begins here, but something may begin inside
                    at = match.start() + 1
        out, places, done, shift = [], [], 0, 0
        for start, kind, old, new in sorted(finds):
            if start < done:
                continue
            out += [text[done:start], new]
            places.append({"kind": KINDS[kind], "start": start + shift, "length": len(new)})
            done, shift = start + len(old), shift + len(new) - len(old)
        return "".join([*out, text[done:]]), places


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", finds_col: str | None = None) -> DataFrame:
    """The same rows with pseudonyms in the text; finds_col names a further column for what was found."""
    place = df.columns.index(text_col)
    finds = free_name(df, "finds_in_text")
    schema = df.withColumn(text_col, F.col(text_col).cast("string")).withColumn(finds, F.lit(None).cast(FINDS)).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonyms(secret)
        give_back()  # what earlier stages have left
        for whole in batches:
            for a, b in slices(whole.column(place), SLICE_BYTES):
                batch = whole.slice(a, b - a)
                texts = batch.column(place)
                worth = pc.fill_null(pc.match_substring_regex(texts, r"@|\d\D{0,3}\d\D{0,3}\d|(?i:token|secret|pass|key|pwd)"), False)
                rows = pc.indices_nonzero(worth).to_pylist()
                found: list = [[] if t else None for t in texts.is_valid().to_pylist()]
                if rows:
                    new = texts.to_pylist()
                    for r in rows:
                        new[r], found[r] = work.replace(new[r])
                    texts = pa.array(new, pa.string())
                columns = [texts if k == place else c for k, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], [*batch.schema.names, finds])
        give_back()

    out = df.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
    return out.withColumnRenamed(finds, finds_col) if finds_col else out.drop(finds)
