"""PII replaced by surrogates.

Entities are found by pattern and check digits, brought to a normal form, and replaced by a keyed surrogate of
the same type: digits by a keyed permutation of the digit strings of that length (a Feistel network, so two
numbers never meet), card numbers and IBANs with valid check digits, addresses with valid octets, names by names of the same
gender and script.  The surrogate is laid into the format of each occurrence: separators, case, length.

Found are mail, IPv4 and IPv6 addresses, IBANs, card and long numbers, phone numbers (international, North American, and
national ones with a leading zero and separators), SSNs, keys and tokens (hexadecimal, of known issuers, JSON web tokens, PEM private
keys), and passwords behind ``password=`` or ``password:`` (the latter only if not just letters).

Names are found by title only: a name that no title precedes anywhere in a text stays.  Of a name that has
one somewhere in a text, its other mentions there, with a capital letter, are replaced too, and a given name
has one gender in a text: the first that a title tells.

The same value has the same surrogate everywhere, whatever its format (coreference).  Distinctness is checked over
the whole corpus: a surrogate that another value of its type has too, or that is itself a value of the
corpus, is drawn again under the next attempt.  Only values that need such an attempt make up the table that
the replacing pass reads.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_staged, stage

BROADCAST_ATTEMPTS = 200_000
ROUNDS = 8
MAX_ATTEMPTS = 200

# fixed values: titles that tell a gender, and names to choose from
MALE = "Mr Herr Monsieur Señor Sr Sir Signor Господин г-н Κύριος"
FEMALE = "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Señorita Signora Госпожа г-жа Κυρία"
NEUTRAL = "Dr Prof"
FIRST = {
    ("LATIN", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul Simon Thomas Victor Walter",
    ("LATIN", "f"): "Anna Bella Clara Diana Emma Flora Greta Helena Irene Julia Karin Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera",
    ("CYRILLIC", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Леонид Максим Никита Олег Павел Роман Степан",
    ("CYRILLIC", "f"): "Анна Белла Вера Галина Дарья Елена Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса София",
    ("GREEK", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Λάμπρος Μάρκος Νίκος Πέτρος Σπύρος Φώτης",
    ("GREEK", "f"): "Άννα Βέρα Γεωργία Δήμητρα Ειρήνη Κλειώ Λήδα Μαρία Νίκη Ρόζα Σοφία Χλόη",
}
SYLLABLES = {
    "LATIN": "bal bren cor dal der fal gar hal kel lan lor mar mel nor pel ran sel tal ver wal",
    "CYRILLIC": "бал бор вер гор дан зор кал лан мар мир нов пет рад сел тал вол",
    "GREEK": "βαλ γαρ δορ καλ λαν μαρ νικ πετ ραν σελ ταλ φιλ",
}
ENDINGS = {"LATIN": "en er in ow", "CYRILLIC": "ов ин ко ич", "GREEK": "ίδης άκης όπουλος ίου"}


TITLES = {x for t in f"{MALE} {FEMALE} {NEUTRAL}".split() for x in (t, t.upper())}


LONGEST_TITLE = max(map(len, TITLES)) + 1


def _titles() -> str:
    return "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))


_NAME = r"[^\W\d_][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_CAPITAL = r"(?-i:(?=[^\W\d_a-zà-þа-яα-ω]))"
#: In order: of two entities that overlap the earlier match wins, at one place the earlier type.
_PARTS = [
    r"(?P<email>[\w%+-][\w.%+-]{0,63}@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,})",
    r"(?P<iban>\b[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?\b)",
    r"(?P<secret>\b(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b"
    r"|\bAKIA[0-9A-Z]{16}\b|(?<=(?i:password)=)[^\s\"'<>&;,]{6,}|(?<=(?i:password)=[\"'])[^\s\"'<>&;,]{6,}"
    r"|(?:(?<=(?i:password):)|(?<=(?i:password): ))(?=[^\W\d_]*[^\s\w\"'<>&;,]|[^\W\d_]*[\d_])[^\s\"'<>&;,]{6,}"
    r"|\beyJ[\w-]{5,}\.[\w-]{5,}\.[\w-]*|\b(?:ghp|gho|xoxb|xoxp|sk)[_-][0-9A-Za-z-]{16,})",
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d))",
    r"(?P<ip6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![\w:]))",
    r"(?P<phone>(?<![\w+.,-])(?:0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}|0\d(?:[ .-]\d{2}){4}|\(0\) ?\d{2,5}[ -]\d{3,4}[ -]\d{3,4})(?![\w]|[-.,]\d)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,5}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\w-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-]))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<![\w.,-])(?<!\d )(?!000|666|9)\d{3} (?!00)\d{2} (?!0000)\d{4}(?![\w-]|[ .,]\d))",
    r"(?P<number>(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|3[47]\d{2}[ -]\d{6}[ -]\d{5})(?![\w]|[-.]\d))",
    rf"(?P<name>(?<!\w)(?:{_titles()})\.? {_CAPITAL}(?!(?:{_titles()})\b){_NAME}(?: {_CAPITAL}(?!(?:{_titles()})\b){_NAME}){{0,2}})",
]
PATTERNS = re.compile("|".join(_PARTS))
_NO_IBAN = re.compile("|".join(x for x in _PARTS if not x.startswith("(?P<iban>")))
_TITLE = re.compile(rf"({_titles()})\.? ")
_BEFORE = re.compile(rf"(?:.*\W)?({_titles()})\.?", re.S)
_PEM = re.compile(r"-----BEGIN (?:[A-Z]{1,12} ){0,2}PRIVATE KEY-----\s*")
_PEM_END = re.compile(r"\s*-----END ")
_OWNED = re.compile(r"['’][sS]$")
_MENTION = re.compile(rf"(?<![^\W_]){_CAPITAL}{_NAME}(?![^\W_])")


_GENDER = {x: g for g, known in (("n", NEUTRAL), ("f", FEMALE), ("m", MALE)) for t in known.split() for x in (t, t.upper())}
_SEED = re.compile(r"[\d@]")
#: What else an entity without a digit or an @ begins with, or stands behind.
_WORDS = (*TITLES, "assword", "ASSWORD", "AKIA", "eyJ", "::", *(x + sign for x in ("ghp", "gho", "xoxb", "xoxp", "sk") for sign in "_-"))


def _lines(text: str) -> list[tuple[int, int]]:
    """The lines that may hold an entity: with a digit, an @, a title, a password or an issuer's prefix.  No entity goes beyond a line."""
    starts = set()
    at = 0
    while m := _SEED.search(text, at):
        starts.add(text.rfind("\n", 0, m.start()) + 1)
        at = text.find("\n", m.end())
        if at < 0:
            break
    for word in _WORDS:
        at = text.find(word)
        while at >= 0:
            starts.add(text.rfind("\n", 0, at) + 1)
            end = text.find("\n", at)
            at = text.find(word, end) if end >= 0 else -1
    return [(x, end if (end := text.find("\n", x)) >= 0 else len(text)) for x in sorted(starts)]


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


#: Characters of an IBAN by country.
IBAN_LENGTHS = {c: int(n) for n, known in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in known.split(",")}
LEAST_IBAN = min(IBAN_LENGTHS.values())


def _iban(found: str) -> tuple[int, str] | None:
    """Length and normal form of the IBAN that ``found`` is or begins with: words behind it may look like its groups.

    The country's length is tried first, then others from the longest on.
    """
    ends = [i for i in range(len(found), 0, -1) if found[i - 1] != " " and not found[i:i + 1].isalnum()]
    tried = [(end, found[:end].replace(" ", "").upper()) for end in ends]
    tried.sort(key=lambda x: len(x[1]) != IBAN_LENGTHS.get(x[1][:2]))
    for end, value in tried:
        if (len(value) >= LEAST_IBAN or end == len(found)) and value[4:].isascii() and _iban_check(value[:2], value[4:]) == value[2:4]:
            return end, value
    return None


def script(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN").split()[0]
    return name if name in SYLLABLES else "LATIN"


def _keys(text: str) -> Iterator[tuple[int, int]]:
    """The bodies of private keys in PEM form, to the end line or the end of the text; the only entities beyond a line."""
    at = text.find("-----BEGIN ")
    while at >= 0:
        m = _PEM.match(text, at)
        if m:
            close = _PEM_END.search(text, m.end())
            end = close.start() if close else len(text.rstrip())
            if end > m.end():
                yield m.end(), end
            at = max(end, m.end())
        at = text.find("-----BEGIN ", at + 1)


def _ip6(found: str) -> str | None:
    """Eight groups without leading zeros; none for what is no address or has fewer than two groups that are not zero."""
    try:
        groups = [f"{int(x, 16):x}" for x in ipaddress.IPv6Address(found).exploded.split(":")]
    except ValueError:
        return None
    return ":".join(groups) if sum(x != "0" for x in groups) > 1 else None


def _matches(text: str, hidden: list[tuple[int, int]]) -> Iterator[tuple[re.Match, int, str]]:
    """Matches outside of ``hidden`` that pass their checks, with their ends and normal forms; after one that fails the search goes on inside it."""
    i = 0
    for at, end in _lines(text):
        while m := PATTERNS.search(text, at, end):
            while i < len(hidden) and hidden[i][1] <= m.start():
                i += 1
            if i < len(hidden) and hidden[i][0] < m.end():
                at = min(end, hidden[i][1])
                continue
            stop, value = m.end(), m[0]
            if m.lastgroup == "iban":
                if iban := _iban(m[0]):
                    stop, value = m.start() + iban[0], iban[1]
                elif m := _NO_IBAN.match(text, at := m.start(), end):
                    stop, value = m.end(), m[0]
                else:
                    at += 1
                    continue
            if m.lastgroup == "ip6":
                value = _ip6(m[0])
                if value is None:
                    at = m.end()
                    continue
            if m.lastgroup in ("phone", "ssn", "number"):
                value = re.sub(r"\D", "", value)
                if m.lastgroup == "phone" and not 7 <= len(value) <= 15:
                    at = m.start() + 1
                    continue
            yield m, stop, value
            at = stop


def _titled(m: re.Match) -> tuple[str, list[tuple[int, int, str]]]:
    """The gender that the titles before a name tell, the first one first, and ``start, end, value`` of its parts."""
    at = _TITLE.match(m[0]).end()
    genders, start = [_GENDER[_TITLE.match(m[0])[1]]], m.start()
    while start and m.string[start - 1] == " ":
        before = m.string[max(0, start - 2 - LONGEST_TITLE):start - 1].rpartition(" ")[2].rpartition("\n")[2]
        title = _BEFORE.fullmatch(before)
        if not title:
            break
        genders.append(_GENDER[title[1]])
        if title.start(1):
            break
        start -= len(before) + 1
    parts = [(m.start() + p.start(), m.start() + p.start() + len(x), x.lower())
             for p in re.finditer(r"\S+", m[0][at:]) for x in (_OWNED.sub("", p[0]),)]
    return next((g for g in reversed(genders) if g != "n"), "n"), [(at + start, at + end, x) for start, end, x in parts]


def _mentions(text: str, taken: list[tuple[int, int]], given: dict[str, str], family: set[str]) -> Iterator[tuple[int, int, str, str]]:
    """Words outside of the spans ``taken`` that are known names; what is both is a given name only before a family name."""
    known, found, i = given.keys() | family, [], 0
    for m in _MENTION.finditer(text):
        whole, pieces = _OWNED.sub("", m[0]), [(m.start(), m[0])]
        if whole.lower() in known:
            pieces = [(m.start(), whole)]
        elif len(whole) < len(m[0]) or re.search(r"['’-]", whole):
            pieces = [(m.start() + p.start(), p[0]) for p in re.finditer(r"[^'’-]+", whole)]
        for start, x in pieces:
            while i < len(taken) and taken[i][1] <= start:
                i += 1
            if x.lower() in known and (i == len(taken) or start + len(x) <= taken[i][0]):
                found.append((start, start + len(x), x.lower()))
    for (start, end, x), (after, _, y) in zip(found, [*found[1:], (-1, -1, "")], strict=False):
        first = x in given and (x not in family or after == end + 1 and text[end] == " " and y in family)
        yield start, end, f"given {given[x]}" if first else "family", x


def entities(text: str | None) -> Iterator[tuple[int, int, str, str]]:
    """``start, end, type, value`` in order; a name gives a given and a family name, with the gender in the type.

    Names are found by title; later and earlier mentions of them in the same text need none.
    """
    text = text or ""
    hidden = list(_keys(text))
    names, out = [], [(start, end, "secret", text[start:end]) for start, end in hidden]
    for m, end, value in _matches(text, hidden):
        kind, found = m.lastgroup, m[0]
        if kind == "email":
            out.append((m.start(), end, kind, found.lower()))
        elif kind in ("iban", "phone", "ssn", "ip6"):
            out.append((m.start(), end, kind, value))
        elif kind == "number":
            out.append((m.start(), end, "card" if luhn(value) else kind, value))
        elif kind == "name":
            names.append(_titled(m))
        else:
            out.append((m.start(), end, kind, found.lower() if kind == "ip" or len(set(found) & set("ghijklmnopqrstuvwxyz")) == 0 else found))
    if names:
        given: dict[str, str] = {}
        for gender, parts in names:
            for *_, x in parts[:-1]:
                given[x] = gender if given.get(x, "n") == "n" else given[x]
        for _, parts in names:
            out += [(start, end, f"given {given[x]}", x) for start, end, x in parts[:-1]] + [(*parts[-1][:2], "family", parts[-1][2])]
        out.sort()
        out += list(_mentions(text, [x[:2] for x in out], given, {parts[-1][2] for _, parts in names}))
    yield from sorted(out)


class Surrogates:
    """Keyed surrogates of normal forms, and their layout in the format of an occurrence."""

    def __init__(self, key: bytes):
        self.key = key

    def _number(self, *what) -> int:
        return int.from_bytes(hmac.new(self.key, json.dumps(what).encode(), hashlib.sha256).digest(), "big")

    def digits(self, kind: str, attempt: int, value: str) -> str:
        """A keyed permutation of the digit strings of this length."""
        if len(value) < 2:
            return str((int(value) + 1 + self._number(kind, attempt, 1) % 9) % 10)
        n = len(value) // 2
        a, b = value[:n], value[n:]
        for r in range(ROUNDS):
            size = len(a)
            c = (int(a) + self._number(kind, attempt, r, len(value), b)) % 10 ** size
            a, b = b, f"{c:0{size}d}"
        return a + b

    def _letters(self, kind: str, attempt: int, value: str, alphabet: str) -> str:
        x, out = self._number(kind, attempt, value), []
        for i, c in enumerate(value):
            if i % 24 == 23:
                x = self._number(kind, attempt, value, i)
            x, d = divmod(x, 36 * 36)
            out.append("0123456789"[d % 10] if c.isdigit() else alphabet[d % len(alphabet)] if c.isalpha() else c)
        return "".join(out)

    def of(self, kind: str, value: str, attempt: int = 0) -> str:
        if kind in ("phone", "ssn", "number", "card"):
            keep = 1 if kind == "phone" and (len(value) > 10 or value[0] == "0") else 0   # the country code's first digit, or the trunk's
            head, tail = value[:keep], value[keep:]
            if kind != "card":
                out = head + self.digits(kind, attempt, tail)
                while kind == "number" and luhn(out):
                    out = head + self.digits(kind, attempt, out[keep:])     # walk the cycle: still a permutation
                return out
            body = self.digits(kind, attempt, value[:-1])
            return next(body + str(d) for d in range(10) if luhn(body + str(d)))
        if kind == "ip":
            a = [int(x) for x in value.split(".")]
            word = f"{(a[0] << 24) + (a[1] << 16) + (a[2] << 8) + a[3]:010d}"
            private = lambda v: v[0] in (10, 127) or v[:2] == [192, 168] or v[0] == 172 and 16 <= v[1] < 32
            while True:   # walk the cycle to an address of the same kind
                word = self.digits(kind, attempt, word)
                if int(word) < 1 << 32:
                    b = list(int(word).to_bytes(4, "big"))
                    if private(b) == private(a):
                        return ".".join(map(str, b))
        if kind == "ip6":   # the first group and the groups of zeros stay; with few addresses of that form left, the zeros go
            first, *rest = value.split(":")
            x = self._number(kind, attempt, value)
            return ":".join([first, *("0" if g == "0" and attempt < 4 else f"{1 + (x >> 16 * i) % 0xffff:x}" for i, g in enumerate(rest))])
        if kind == "secret":   # a prefix that names the issuer stays
            keep = re.match(r"akia|AKIA|eyJ|(?:ghp|gho|xoxb|xoxp|sk)[_-]|", value).end()
            hexadecimal = all(c in "0123456789abcdef" for c in value)
            new = self._letters(kind, attempt, value, "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz")
            return value[:keep] + new[keep:]
        if kind == "iban":
            rest = self._letters(kind, attempt, value[4:], "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
            return value[:2] + _iban_check(value[:2], rest) + rest
        if kind == "email":
            local, _, domain = value.partition("@")
            labels = domain.split(".")
            alphabet = "abcdefghijklmnopqrstuvwxyz"
            new = [self._letters("domain", attempt, x, alphabet) for x in labels[:-1]]
            return f"{self._letters(kind, attempt, f'{local}@{domain}', alphabet)[:len(local)]}@{'.'.join([*new, labels[-1]])}"
        x, s = self._number(kind, attempt, value), script(value)
        if kind == "family":
            parts, ends = SYLLABLES[s].split(), ENDINGS[s].split()
            out = ""
            for _ in range(2 + attempt // 4):
                x, d = divmod(x, len(parts))
                out += parts[d]
            return out + ends[x % len(ends)]
        gender = kind[-1] if kind[-1] in "mf" else "mf"[x % 2]
        pool, out = FIRST[s, gender].split(), []
        for _ in range(1 + attempt // 4):
            x, d = divmod(x, len(pool))
            out.append(pool[d].lower())
        return "-".join(out)

    @staticmethod
    def lay(kind: str, found: str, surrogate: str) -> str:
        """The surrogate in the format of ``found``: its separators and its case."""
        if kind in ("phone", "ssn", "number", "card", "iban"):
            it = iter(surrogate)
            laid = "".join(next(it) if c.isalnum() else c for c in found)
            return laid.lower() if kind == "iban" and found == found.lower() else laid
        if kind == "ip6":
            parts = [f"{int(x, 16):04x}" for x in surrogate.split(":")] if all(len(x) == 4 for x in found.split(":")) else surrogate.split(":")
            surrogate = str(ipaddress.IPv6Address(surrogate)) if "::" in found else ":".join(parts)
        if len(found) > 1 and found == found.upper() and found != found.lower():
            return surrogate.upper()
        return surrogate.title() if kind == "family" or kind.startswith("given") else surrogate

    def replace(self, text: str | None, attempts: dict[tuple[str, str], int]) -> tuple[str | None, int]:
        if text is None:
            return None, 0
        out, at, n = [], 0, 0
        for start, end, kind, value in entities(text):
            out += [text[at:start], self.lay(kind, text[start:end], self.of(kind, value, attempts.get((kind, value), 0)))]
            at, n = end, n + 1
        return "".join([*out, text[at:]]) if n else text, n


def _resolve(found: DataFrame, surrogate: Callable) -> DataFrame:
    """``kind, value, attempt`` of the values whose first surrogate is taken: by another value, or as a value itself.

    A type with no free surrogate left after ``MAX_ATTEMPTS`` draws of one value is an error.
    """
    current = stage(found.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate("kind", "value", "attempt")), "surrogates")
    while True:
        # of the values that share a surrogate the one of fewest attempts keeps it; a surrogate that is a value is nobody's
        owner = current.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("owner"), F.count(F.lit(1)).alias("n"))
        values = found.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("is_value"))
        taken = (owner.join(values, ["kind", "surrogate"], "left").where("n > 1 or is_value")
                 .select("kind", "surrogate", "owner.value", F.coalesce("is_value", F.lit(False)).alias("is_value"))
                 .withColumnRenamed("value", "keeper"))
        judged = current.join(taken, ["kind", "surrogate"], "left")
        again = F.col("keeper").isNotNull() & (F.col("is_value") | (F.col("value") != F.col("keeper")))
        raised = judged.select("kind", "value", "surrogate", again.alias("again"), (F.col("attempt") + again.cast("int")).alias("attempt"))
        if not taken.limit(1).count() or not raised.where("again").limit(1).count():
            return current.where("attempt > 0").select("kind", "value", "attempt")
        if full := [r["kind"] for r in raised.where(F.col("attempt") > MAX_ATTEMPTS).select("kind").distinct().collect()]:   # one row a type
            raise ValueError(f"no free surrogates of type {', '.join(sorted(full))}")
        redrawn = raised.where("again").withColumn("surrogate", surrogate("kind", "value", "attempt"))
        last, current = current, stage(raised.where("not again").unionByName(redrawn).select("kind", "value", "attempt", "surrogate"), "surrogates")
        drop_staged(last)


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with its text replaced and a column ``n_entities`` (replacing one of that name).

    Null texts stay null and texts without entities stay as they are, byte for byte.  Every row is treated on
    its own text, so ids may be null or repeat.  The two passes over the texts are narrow; what is shuffled are
    distinct values.  An empty table gives no rows.  ``key`` must stay secret: it decides all surrogates.
    """
    spark, secret = df.sparkSession, key.encode()

    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def values(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "value": v} for k, v in sorted({(k, v) for _, _, k, v in entities(t)})] for t in texts])

    @F.pandas_udf("string")
    def surrogate(kinds: pd.Series, found: pd.Series, attempts: pd.Series) -> pd.Series:
        s = Surrogates(secret)
        return pd.Series([s.of(k, v, int(a)) for k, v, a in zip(kinds, found, attempts, strict=True)], dtype=object)

    found = stage(df.select(F.explode(values(F.col(text_col))).alias("e")).select("e.kind", "e.value").distinct(), "entities")
    attempts = stage(_resolve(found, surrogate), "attempts")
    if attempts.count() > BROADCAST_ATTEMPTS:
        return _replace_joined(df, secret, text_col, attempts)
    table = spark.sparkContext.broadcast({(r["kind"], r["value"]): r["attempt"] for r in attempts.collect()})

    @F.pandas_udf("text string, n long")
    def replaced(texts: pd.Series) -> pd.DataFrame:
        s = Surrogates(secret)
        return pd.DataFrame([s.replace(t, table.value) for t in texts], columns=["text", "n"])

    return _with(df, replaced(F.col(text_col)), text_col)


def _with(df: DataFrame, new, text_col: str) -> DataFrame:
    out = df.select(F.struct("*").alias("row"), new.alias("new"))
    kept = [F.col("new.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns if c != "n_entities"]
    return out.select(*kept, F.col("new.n").alias("n_entities"))


def _replace_joined(df: DataFrame, secret: bytes, text_col: str, attempts: DataFrame) -> DataFrame:
    """The same beyond the size that may be broadcast: each text gets the attempts of its own values by a join."""
    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def values(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "value": v} for k, v in sorted({(k, v) for _, _, k, v in entities(t)})] for t in texts])

    @F.pandas_udf("text string, n long")
    def replaced(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        s = Surrogates(secret)
        return pd.DataFrame([s.replace(t, {(a["kind"], a["value"]): a["attempt"] for a in (o if o is not None else ())})
                             for t, o in zip(texts, own, strict=True)], columns=["text", "n"])

    text_key = F.sha2(F.col(text_col), 256)
    needed = (df.select(text_key.alias("of"), F.explode(values(F.col(text_col))).alias("e")).select("of", "e.kind", "e.value").distinct()
              .join(attempts, ["kind", "value"]).groupBy("of").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("own")))
    rows = df.select(F.struct("*").alias("row"), text_key.alias("text_key"))
    joined = rows.join(needed, rows["text_key"] == needed["of"], "left")
    out = joined.select("row", replaced(F.col("row")[text_col], F.col("own")).alias("new"))
    kept = [F.col("new.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns if c != "n_entities"]
    return out.select(*kept, F.col("new.n").alias("n_entities"))
