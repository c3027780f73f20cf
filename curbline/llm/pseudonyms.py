"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation per format.

Values are found by pattern and validated (Luhn digits, octets, area codes, calendar dates, IBAN
remainders); of a card or account number that does not validate, shorter runs of its groups are
tried; what does not validate stays. Each value is numbered within all valid values of its
format, the number is permuted by a Feistel network with cycle walking, and the result is written
in the same shape. So a card stays a valid card with the same separators, and equal values get
equal pseudonyms in every document and run with the same key (but where that would make numbers
beside each other ambiguous), without any table of values or
shuffle. With the key the permutation can be undone (``reveal``).

Rows are rewritten one by one in their tasks: nothing is collected, and no group matters.

Defined results: NULL texts stay NULL with counts 0, empty texts stay empty; overlapping finds
go to the leftmost, then to the earlier kind in ``KINDS``; repeated rows get the same
result; other columns pass through, columns named like a result are replaced.
"""

from __future__ import annotations

import calendar
import datetime
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 10


def permuted(number: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of the integers below ``size``."""
    if size < 2:
        return number
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    steps = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    while True:  # cycle walking: numbers beyond ``size`` are permuted again
        left, right = number >> half, number & mask
        for r in steps:
            if back:
                left, right = right ^ _round(left, half, key, tweak, r), left
            else:
                left, right = right, left ^ _round(right, half, key, tweak, r)
        number = left << half | right
        if number < size:
            return number


def _round(value: int, bits: int, key: bytes, tweak: str, r: int) -> int:
    length = (bits + 7) // 8
    message = f"{tweak}/{r}/{bits}/{value}".encode()
    out = b""
    while len(out) < length:
        out += hashlib.blake2b(message + len(out).to_bytes(4, "big"), key=key[:64], digest_size=32).digest()
    return int.from_bytes(out[:length], "big") & ((1 << bits) - 1)


def _mixed(parts: list[tuple[int, int]], key: bytes, tweak: str, back: bool) -> list[int]:
    """Permute a list of (value, radix) as one number of mixed radix."""
    number, size = 0, 1
    for value, radix in parts:
        number, size = number * radix + value, size * radix
    number = permuted(number, size, key, tweak, back)
    out = []
    for _, radix in reversed(parts):
        number, value = divmod(number, radix)
        out.append(value)
    return out[::-1]


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def _shaped(text: str, digits: list[int]) -> str:
    """``text`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(chr(48 + next(rest)) if "0" <= c <= "9" else c for c in text)


def _luhn(digits: list[int]) -> int:
    """The check digit that makes ``digits`` plus it valid."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def card(text: str, key: bytes, back: bool = False) -> str | None:
    """13 to 19 digits with a valid Luhn digit; the first digit stays, the check digit is made anew."""
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or digits[0] == 0 or _luhn(digits[:-1]) != digits[-1]:
        return None
    body = [digits[0], *_mixed([(d, 10) for d in digits[1:-1]], key, f"card{len(digits)}-{digits[0]}", back)]
    return _shaped(text, [*body, _luhn(body)])


def phone(text: str, key: bytes, back: bool = False) -> str | None:
    """North American numbers: area and exchange codes start with 2 to 9; a country code stays."""
    digits = _digits(text)
    head = digits[:-10]
    own = digits[-10:]
    if len(own) < 10 or head not in ([], [1]) or own[0] < 2 or own[3] < 2:
        return None
    parts = [(d - 2, 8) if i in (0, 3) else (d, 10) for i, d in enumerate(own)]
    new = [v + 2 if i in (0, 3) else v for i, v in enumerate(_mixed(parts, key, "phone", back))]
    return _shaped(text, head + new)


def address(text: str, key: bytes, back: bool = False) -> str | None:
    """IPv4 addresses."""
    octets = text.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    return ".".join(map(str, _mixed([(int(o), 256) for o in octets], key, "ipv4", back)))


def social(text: str, key: bytes, back: bool = False) -> str | None:
    """Social security numbers: area 001-899 but 666, group and serial not zero."""
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    place, group, serial = _mixed([(place, 898), (group - 1, 99), (serial - 1, 9999)], key, "ssn", back)
    return f"{place + 1 + (place >= 665):03d}{text[3]}{group + 1:02d}{text[6]}{serial + 1:04d}"


_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def date(text: str, key: bytes, back: bool = False) -> str | None:
    """Calendar dates from 1900 to 2099, as year-month-day or day/month/year (month/day/year if only that is one)."""
    parts = re.split(r"[-/.]", text)
    sign = text[len(parts[0])]
    year_first = len(parts[0]) == 4
    numbers = [int(p) for p in parts]
    year, month, day = numbers if year_first else (numbers[2], numbers[1], numbers[0])
    turned = False
    if not year_first and month > 12 >= day:
        month, day, turned = day, month, True
    if not 1900 <= year <= 2099 or not 1 <= month <= 12 or not 1 <= day <= calendar.monthrange(year, month)[1]:
        return None
    # A date read month first must come back as one that cannot be read day first.
    size = _DAYS
    number = datetime.date(year, month, day).toordinal() - _FIRST_DAY
    while True:
        number = permuted(number, size, key, f"date{int(turned)}", back)
        new = datetime.date.fromordinal(number + _FIRST_DAY)
        if not turned or new.day > 12:
            break
    if year_first:
        return f"{new.year:04d}{sign}{new.month:02d}{sign}{new.day:02d}"
    first, second = (new.month, new.day) if turned else (new.day, new.month)
    return f"{first:02d}{sign}{second:02d}{sign}{new.year:04d}"


def _classes(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Letters and digits permuted within their classes; other signs stay."""
    parts, kinds = [], []
    for c in text:
        for base, radix in ((48, 10), (65, 26), (97, 26)):
            if base <= ord(c) < base + radix:
                parts.append((ord(c) - base, radix))
                kinds.append(base)
                break
        else:
            kinds.append(None)
    shape = "".join("." if k is None else chr(k) for k in kinds)
    new = iter(_mixed(parts, key, f"{tweak}{shape}", back))
    return "".join(c if k is None else chr(k + next(new)) for c, k in zip(text, kinds, strict=True))


def iban(text: str, key: bytes, back: bool = False) -> str | None:
    """Account numbers with a valid remainder; the country stays, the check digits are made anew."""
    plain = text.replace(" ", "")
    if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    body = _classes(plain[4:], key, "iban" + plain[:2], back)
    check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    rest = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(rest) for c in text)


def email(text: str, key: bytes, back: bool = False) -> str | None:
    """Mail addresses: the part before the @ is permuted, the host stays."""
    local, _, host = text.rpartition("@")
    return f"{_classes(local, key, 'email' + host, back)}@{host}"


def access_key(text: str, key: bytes, back: bool = False) -> str | None:
    """Cloud access keys: the prefix stays."""
    return text[:4] + _classes(text[4:], key, "key", back)


#: (kind, pattern, function), in order of precedence.
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", email),
    ("access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", access_key),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("ipv4", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])", address),
    ("date", r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\1[0-9]{4})(?![0-9/-])", date),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", social),
    ("card", r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])", card),
    ("phone", r"(?<![0-9])(?:\+?1[ .-]?)?\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])", phone),
)


@functools.lru_cache(maxsize=4)
def _finder(kinds: tuple[str, ...]):
    """One pattern for kinds that hold digits, and whether mail addresses are wanted."""
    own = [(k, p, f) for k, p, f in KINDS if k in kinds]
    parts = [f"(?P<{k}>{p})" for k, p, _ in own]
    # Groups inside patterns shift numbers, so the back reference of dates goes by name.
    joined = "|".join(parts).replace(r"([/.])", r"(?P<sign>[/.])").replace(r"\1", "(?P=sign)")
    plain = "|".join(p for p in parts if not p.startswith("(?P<email>")).replace(r"([/.])", r"(?P<sign>[/.])").replace(r"\1", "(?P=sign)")
    return re.compile(joined), re.compile(plain) if plain else None, {k: (re.compile(p), f) for k, p, f in own}


_HINT = re.compile(r"[0-9@]|AKIA|ASIA")
REACH = 80  # characters; no card or account number with its neighbours in one find is longer
_IBAN = re.compile(next(p for k, p, _ in KINDS if k == "iban"))


def _parts(kind: str, text: str, start: int, end: int):
    """(start, end) of the runs of whole groups that may be a card or account number, leftmost and longest first."""
    if kind not in ("card", "iban"):
        return
    groups, width = [], []
    for m in re.finditer(r"[A-Z0-9]+", text[start:end]):
        groups.append((start + m.start(), start + m.end()))
        width.append(m.end() - m.start())
    for i in range(len(groups)):
        ends, total = [], 0
        for j in range(i, len(groups)):
            total += width[j]
            if total > (19 if kind == "card" else 35):
                break
            if total >= (13 if kind == "card" else 12):
                ends.append(groups[j][1])
        for e in reversed(ends):
            if kind == "card" or _IBAN.fullmatch(text, groups[i][0], e):
                yield groups[i][0], e


def _spans(text: str, key: bytes, finder, functions, back: bool, at: int, stop: int):
    """Values that start from ``at`` and before ``stop``, as [start, end, kind, new], and the finds that did not validate."""
    out, loose, later = [], [], None
    while True:
        match = finder.search(text, at)
        if later and (match is None or match.start() >= later[0]):
            found, later = later, None
        elif match is None or match.start() >= stop:
            return out, loose
        else:
            start, end = match.span()
            kind = next(k for k in functions if match.groupdict().get(k) is not None)
            new = functions[kind][1](match.group(0), key, back)
            found = [start, end, kind, new]
            if new is None:
                found = None
                loose.append((start, end))
                for s, e in _parts(kind, text, start, end):
                    new = functions[kind][1](text[s:e], key, back)
                    if new is not None:
                        if s == start:
                            found = [s, e, kind, new]
                        elif later is None or s < later[0]:
                            later = [s, e, kind, new]
                        break
                names = list(functions)
                for k in names[names.index(kind) + 1 :] if found is None else ():
                    other = functions[k][0].match(text, start)
                    new = functions[k][1](other.group(0), key, back) if other else None
                    if new is not None:
                        found = [start, other.end(), k, new]
                        break
            if found is None:
                at = start + 1
                continue
        out.append(found)
        at = found[1]
        later = None
        if found[0] >= stop:
            return out[:-1], loose


def rewritten(text: str, key: bytes, kinds: tuple[str, ...], back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its values replaced, and how many of each kind.

    A value beside others is permuted on until the new text shows the same values at the same
    places, so that it can be undone; going back takes the values in the opposite order.
    """
    counts: dict[str, int] = {}
    if not _HINT.search(text):
        return text, counts
    every, plain, functions = _finder(kinds)
    finder = every if "@" in text else plain
    if finder is None:
        return text, counts
    found, loose = _spans(text, key, finder, functions, back, 0, len(text) + 1)
    # Stretches of values beside each other or under a find that did not validate, and whether more than one value.
    places = sorted([(s, e, True) for s, e in loose] + [(s, e, False) for s, e, _, _ in found])
    near: list[list] = []
    for s, e, shut in places:
        if near and s <= near[-1][1] + 3:
            near[-1][1], near[-1][2] = max(near[-1][1], e), True
        else:
            near.append([s, e, shut])
    near = [n for n in near if n[2]]
    out, done, k = [], 0, 0
    for first, last, _ in near:
        while k < len(found) and found[k][0] < first:
            out += [text[done : found[k][0]], found[k][3]]
            done, k = found[k][1], k + 1
        group = []
        while k < len(found) and found[k][0] < last:
            group.append(found[k])
            k += 1
        if group:
            out += [text[done:first], _together(text, first, last, group, key, finder, functions, back)]
            done = last
    for s, e, _, new in found[k:]:
        out += [text[done:s], new]
        done = e
    for _, _, kind, _ in found:
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[done:]]), counts


def _together(text: str, first: int, last: int, group: list, key: bytes, finder, functions, back: bool) -> str:
    """``text[first:last]`` with the values of ``group`` replaced, found again at the same places."""
    pieces, at = [text[max(0, first - REACH) : first]], first
    skipped = len(pieces[0])
    for s, e, _, _ in group:
        pieces[-1] += text[at:s]
        pieces += [text[s:e], ""]
        at = e
    pieces[-1] += text[at : last + REACH]

    def shows(i: int) -> bool:
        """Whether value ``i`` and those shortly before it are found at their places; later ones do not depend on it."""
        j, size = i, 0
        while j and (size := size + len(pieces[2 * j]) + len(pieces[2 * j - 1])) <= REACH:
            j -= 1
        gap = pieces[2 * j][-2 * REACH :]
        start = min(skipped, len(gap)) if j == 0 and len(gap) == len(pieces[0]) else min(8, max(0, len(gap) - REACH))
        head = "" if j == 0 else pieces[2 * j - 1][-8:] if len(gap) == len(pieces[2 * j]) else ""
        if head:
            start = 0
        around, want = head + gap, []
        for k in range(j, i + 1):
            want.append((len(around), len(around) + len(pieces[2 * k + 1]), group[k][2]))
            around += pieces[2 * k + 1] + (pieces[2 * k + 2] if k < i else "")
        stop, after = len(around), 2 * i + 2
        while after < len(pieces) and len(around) < stop + REACH:
            around, after = around + pieces[after], after + 1
        seen, _ = _spans(around[: stop + REACH], key, finder, functions, back, len(head) + start, stop)
        return [tuple(x[:3]) for x in seen] == want

    for i in range(len(group)) if back else reversed(range(len(group))):
        sure = shows(i)  # else the walk might not end
        while True:
            pieces[2 * i + 1] = functions[group[i][2]][1](pieces[2 * i + 1], key, back)
            if not sure or shows(i):
                break
    whole = "".join(pieces)
    return whole[skipped : len(whole) - len(text[last : last + REACH])]


ALL_KINDS = tuple(k for k, _, _ in KINDS)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", kinds: tuple[str, ...] = ALL_KINDS, back: bool = False) -> DataFrame:
    """``docs`` with the text rewritten and a column ``n_<kind>`` per kind."""
    names = [f"n_{k}" for k in kinds]
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(kept + [T.StructField(n, T.LongType(), False) for n in names])

    def run(batches):
        for batch in batches:
            out, counts = [], []
            for t in batch.column(text).to_pylist():
                new, found = (t, {}) if t is None else rewritten(t, key, kinds, back)
                out.append(new)
                counts.append(found)
            columns = [pa.array(out, pa.string()) if f.name == text else batch.column(f.name) for f in kept]
            columns += [pa.array([c.get(k, 0) for c in counts], pa.int64()) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.mapInArrow(run, schema)


def reveal(docs: DataFrame, key: bytes, text: str = "text", kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """Undo ``pseudonymise`` with the same key."""
    return pseudonymise(docs, key, text, kinds, back=True)
