"""Surrogates for personal data and secrets.

Entities found: e-mail addresses, IPv4 and IPv6 addresses, phone, card,
social-security and bank account numbers, keys and passwords, names after a title
or a phrase that introduces one, and given names of the lists with a surname.

An entity is known by a canonical form: an address in lower case, a number without
its separators (a phone number with its country's code), a name case aside. So the
ways to write one entity share a replacement, which is written in the way of each.
It is made with a key and is of the same type and format:

- Strings and numbers go through a keyed permutation without fixed points of all
  strings of the same format (per class of characters: digits, hex digits, cases,
  scripts; letters and digits of any other script by category and block): P is a
  Feistel permutation, and x becomes P's inverse of P(x) + c. So distinct entities
  stay distinct and none stays as it is, however many of a format there are. Card
  numbers keep whether their check digit is right, bank accounts get right ones,
  addresses stay in their kind of network, a phone number's country, e-mail domains
  and key prefixes that name nobody stay. What has nothing to permute is drawn by
  key in a form of its type.
- Given names come from a list of the same gender (of the list that has the name, or
  else by the title) and script, and from the second attempt on get syllables added;
  surnames come from syllables of the same script, of other scripts by permutation.
  A name found is also replaced where it stands alone in that document.

Made-up names and drawn forms may meet, so all distinct entities of the corpus are
checked: where replacements meet, or one equals its original, all but one get the
next attempt, with more room each time, until none meet; only those are made again.
The few entities with another attempt than the first form the exceptions that the
rewriting pass reads.

Defined cases: a null text stays null, an empty text empty; texts without
entities stay as they are; repeated rows stay and are treated alike; an empty
table gives no rows; columns of the input named ``n_entities`` or ``entities`` give
way to the result's, all others stay.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import ipaddress
import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .scratch import Scratch, quoted

#: Up to so many exceptions, under 100 bytes each, go to all executors; beyond, they are joined to their documents.
BROADCAST_EXCEPTIONS = 50_000
#: Attempts that permute within the format; later ones are drawn with more room.
PERMUTATIONS = 4
#: Characters that are permuted together; longer strings go part by part, each under a key of the parts before.
PART = 32

# Given names by script and gender, titles by gender, syllables by script, calling codes of one and two digits.
GIVEN = {
    ("latin", "f"): "Alice Beatrice Clara Diana Elena Fiona Greta Helen Irene Julia Karen Laura Maria Nora Olivia Paula Rosa Sarah Teresa Vera".split(),
    ("latin", "m"): "Adam Bruno Carl David Eric Felix George Henry Ivan James Kevin Louis Martin Noah Oscar Peter Robert Simon Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Надежда Ольга Татьяна".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Максим Николай Олег Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
TITLES = {
    "f": "Mrs. Mrs Ms. Ms Miss Frau Madame Mme Mademoiselle Señora Sra. Signora Госпожа Κυρία".split(),
    "m": "Mr. Mr Herr Monsieur Señor Sr. Signor Господин Κύριος".split(),
    "n": "Dr. Dr Prof. Prof Professor Doctor Доктор Профессор".split(),
}
INTRODUCTIONS = ["my name is", "je m'appelle", "ich heiße", "mein Name ist", "me llamo", "mi nombre es", "меня зовут"]
SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"],
    "greek": [c + v for c in "βγδζκλμνπρστ" for v in "αειου"],
}
CALLING_CODES = {"1", "7"} | set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_GENDER_OF = {name.casefold(): g for (_, g), names in GIVEN.items() for name in names}
_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
_CLASS_OF = {c: (k, i) for k, chars in enumerate(_CLASSES) for i, c in enumerate(chars)}
#: Blocks of code points in which letters or digits of a category form a class; categories with fewer there than LEAST_CLASS form one over all blocks.
BLOCK, LEAST_CLASS = 128, 8


@functools.cache
def _other_classes() -> dict[str, str]:
    """For each class of letters and digits that aren't in _CLASSES, its characters."""
    found: dict[tuple[str, int], list[str]] = {}
    for point in range(0x80, sys.maxunicode + 1):
        c = chr(point)
        if (category := unicodedata.category(c))[0] in "LN" and c not in _CLASS_OF:
            found.setdefault((category, point // BLOCK), []).append(c)
    classes: dict[str, list[str]] = {}
    for (category, block), chars in found.items():
        classes.setdefault(f"{category}{block}" if len(chars) >= LEAST_CLASS else category, []).extend(chars)
    return {name: "".join(chars) for name, chars in classes.items()}


@functools.cache
def _other_class_of() -> dict[str, str]:
    return {c: name for name, chars in _other_classes().items() for c in chars}


def _class(c: str) -> tuple[str, str | None]:
    """The name of a character's class and the class; the character and None if it is no letter or digit."""
    if c in _CLASS_OF:
        k = _CLASS_OF[c][0]
        return str(k), _CLASSES[k]
    if c < "\x80" or (name := _other_class_of().get(c)) is None:
        return c, None
    return f"<{name}>", _other_classes()[name]


_ALNUM = _CLASSES[0] + _CLASSES[1] + _CLASSES[2]

_NAME = r"[^\W\d_][^\W\d_]*(?:['’-][^\W\d_]+)*"
_TITLE = "|".join(re.escape(t) for t in sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_INTRO = "|".join(map(re.escape, INTRODUCTIONS))
_LISTED = "|".join(sorted({n for names in GIVEN.values() for n in names}, key=len, reverse=True))
#: By descending precedence; a pattern's group ``e`` is the entity.
PATTERNS = {
    "secret": re.compile(r"(?<!\w)(?P<e>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]+)(?!\w)"),
    "password": re.compile(r"(?i)(?<![^\W_])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?(?P<e>[^\s\"',;]{6,})"),
    "email": re.compile(r"(?<![\w.+%-])(?P<e>[\w.+%-]+@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+)"),
    "iban": re.compile(r"(?<!\w)(?P<e>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"),
    "ip": re.compile(r"(?<![\w.])(?P<e>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?!\w|\.\d)"),
    "ip6": re.compile(r"(?<![\w:.])(?P<e>[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8})(?![\w:])"),
    "ssn": re.compile(r"(?<![\w-])(?P<e>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"),
    "phone": re.compile(r"(?<![\w+])(?P<e>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w)"),
    "dialled": re.compile(r"(?i)(?<!\w)(?:phone|tel|telephone|call|mobile|cell|fax|sms|whatsapp|téléphone|telefon|teléfono)\b[^\w\n]{0,3}(?:(?:number|no|at|is|me)\b[^\w\n]{0,3}){0,2}(?P<e>[2-9][0-9]{9})(?!\w)"),
    "card": re.compile(r"(?<![\w.-])(?P<e>[0-9](?:[ -]?[0-9]){12,18})(?!\w)"),
}
#: What one of the patterns needs.
_HINT = {"secret": re.compile(r"AKIA|ASIA|gh[pousr]_|xox|sk-|eyJ"), "password": re.compile(r"[:=]"), "email": re.compile("@"), "iban": re.compile(r"[A-Z]{2}\d\d"), "ip": re.compile(r"\d\.\d"), "ip6": re.compile(r":[0-9A-Fa-f]{0,4}:"), "ssn": re.compile(r"\d-\d"), "phone": re.compile(r"[+)\d][ .-]?\d"), "dialled": re.compile(r"[2-9][0-9]{9}"), "card": re.compile(r"\d[ -]?\d[ -]?\d[ -]?\d")}
_TITLED = re.compile(rf"(?<!\w)(?P<title>{_TITLE}|(?i:{_INTRO})) (?P<names>{_NAME}(?: (?!(?:{_TITLE})(?!\w)){_NAME})?)")
_FULL = re.compile(rf"(?<!\w)(?P<given>{_LISTED}) (?P<surname>{_NAME})")
_MAYBE_NAME = re.compile(rf"(?<!\w)(?:{_TITLE}|{_LISTED}|(?i:{_INTRO})) ")
_WORD = re.compile(rf"(?<!\w){_NAME}")
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}


def _luhn(digits: str) -> int:
    """The sum that is 0 if the last digit is right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def script_of(name: str) -> str | None:
    for c in name:
        if "Α" <= c <= "ώ" or c in "άέήίόύώΆΈΉΊΌΎΏ":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if c.isalpha():
            return "latin" if c < "ɐ" else None
    return None


def _capital(word: str) -> bool:
    """Whether a word begins as names do: with a capital, or in a script that has none."""
    return word[0].isupper() or word[0].lower() == word[0].upper()


def canonical(kind: str, value: str) -> str:
    """The form that all ways to write one entity have in common."""
    if kind == "email" or kind == "surname" or kind.startswith("given-"):
        return value.casefold() if kind != "email" else value.lower()
    if kind == "phone":
        digits = re.sub(r"[^0-9]", "", value)
        return f"+{digits}" if value.startswith("+") else f"+1{digits}"
    if kind in ("card", "ssn"):
        return re.sub(r"[^0-9]", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "ip6":
        return str(ipaddress.IPv6Address(value))
    return value


def _fits(kind: str, value: str) -> bool:
    """What the patterns can't tell."""
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "ip6":
        try:
            a = ipaddress.IPv6Address(value)
        except ValueError:
            return False
        return sum(map(bool, value.split(":"))) >= 3 and not (a.is_loopback or a.is_unspecified)
    if kind == "iban":
        return _iban_rest(value.replace(" ", "")) == 1
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in value) <= 15
    if kind == "password":  # prose after a colon has no digit
        return any(c.isdigit() for c in value)
    return True


def detect(text: str) -> list[tuple[int, int, str]]:
    """Start, end and type of all entities, in order and apart from each other."""
    if not text:
        return []
    starts: list[int] = []
    ends: list[int] = []
    kinds: list[str] = []

    def add(start: int, end: int, kind: str) -> None:
        k = bisect.bisect_left(starts, end)  # those before k begin before this one's end
        if not k or ends[k - 1] <= start:
            starts.insert(k, start)
            ends.insert(k, end)
            kinds.insert(k, kind)

    digits = any(c in text for c in "0123456789")
    for kind, pattern in PATTERNS.items():
        if not (digits or kind in ("email", "password", "secret", "ip6")) or not _HINT[kind].search(text):
            continue
        kind = "phone" if kind == "dialled" else kind
        for m in pattern.finditer(text):
            if _fits(kind, m.group("e")):
                add(*m.span("e"), kind)
    if _MAYBE_NAME.search(text):
        _names(text, add)
    return list(zip(starts, ends, kinds, strict=True))


def _names(text: str, add) -> None:
    found: dict[str, str] = {}  # kind of each name by its canonical form

    def take(word: str, at: int, kind: str) -> None:
        add(at, at + len(word), found.setdefault(word.casefold(), kind))

    def given(word: str, gender: str) -> str:
        return f"given-{_GENDER_OF.get(word.casefold(), gender)}"

    for m in _TITLED.finditer(text):
        words, at = m.group("names").split(" "), m.start("names")
        if not _capital(words[0]):
            continue
        if len(words) == 2 and not _capital(words[1]):
            words = words[:1]
        if len(words) == 2:
            take(words[0], at, given(words[0], _TITLE_GENDER.get(m.group("title"), "n")))
            at += len(words[0]) + 1
        take(words[-1], at, "surname")
    for m in _FULL.finditer(text):
        if _capital(m.group("surname")):
            take(m.group("given"), m.start(), given(m.group("given"), "n"))
            take(m.group("surname"), m.start("surname"), "surname")
    if not found:
        return
    for m in _WORD.finditer(text):
        word, at = m.group(), m.start()
        for part in [word] if word.casefold() in found else re.split(r"['’-]", word):
            if part and part[0].isupper() and (kind := found.get(part.casefold())):
                add(at, at + len(part), kind)
            at += len(part) + 1


_NETWORKS = [(0, 8), (10 << 24, 8), (127 << 24, 8), (169 << 24 | 254 << 16, 16), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16), (224 << 24, 3)]


def _ranges() -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The kinds of networks that aren't the open one, as first address and the one after the last; and what is open."""
    closed = [(base, base + (1 << 32 - bits)) for base, bits in _NETWORKS]
    closed = [(a, min(b, 1 << 32)) for a, b in closed]
    edges = [0, *(x for r in closed for x in r), 1 << 32]
    return closed, [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]


_CLOSED, _OPEN = _ranges()


class Surrogates:
    """Replacements under a key."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.of = functools.lru_cache(maxsize=8_000)(self._of)

    def number(self, *what: object, bits: int = 128) -> int:
        return int.from_bytes(hashlib.shake_256(self.key + repr(what).encode()).digest(bits // 8 + 8), "big")

    def permute(self, x: int, n: int, *tweak: object) -> int:
        """A keyed permutation of 0 to n - 1 without fixed points; 0 if there is nothing else."""
        if n < 2:
            return 0
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        bits = a.bit_length()
        shift = 1 + self.number("shift", n, tweak, bits=n.bit_length()) % (n - 1)

        def feistel(x: int, sign: int) -> int:
            while True:
                left, right = divmod(x, b)
                for i in range(6) if sign > 0 else reversed(range(6)):
                    if i % 2:
                        right = (right + sign * self.number(n, i, left, tweak, bits=bits)) % b
                    else:
                        left = (left + sign * self.number(n, i, right, tweak, bits=bits)) % a
                x = left * b + right
                if x < n:
                    return x

        return feistel((feistel(x, 1) + shift) % n, -1)

    def same_format(self, text: str, *tweak: object, alphabet: str | None = None) -> str:
        """Permute the strings of the same classes of characters; what is in no class stays. One alphabet may hold all characters."""
        out, before = [], hashlib.blake2b(digest_size=16)
        for k in range(0, len(text), PART):
            part = text[k : k + PART]
            classes = [(alphabet, alphabet)] * len(part) if alphabet else [_class(c) for c in part]
            x, n = 0, 1
            for c, (_, chars) in zip(part, classes, strict=True):
                if chars is not None:
                    x, n = x * len(chars) + chars.index(c), n * len(chars)
            x = self.permute(x, n, tweak, "".join(name for name, _ in classes), before.hexdigest())
            made = []
            for c, (_, chars) in zip(reversed(part), reversed(classes), strict=True):
                if chars is not None:
                    x, d = divmod(x, len(chars))
                    c = chars[d]
                made.append(c)
            out += reversed(made)
            before.update(part.encode("utf-8", "surrogatepass"))
        return "".join(out)

    def _drawn(self, n: int, alphabet: str, *what: object) -> str:
        return "".join(alphabet[self.number(*what, k) % len(alphabet)] for k in range(n))

    def _syllables(self, n: int, kind: str, attempt: int, value: str, *tweak: object) -> str:
        parts, x = SYLLABLES[script_of(value) or "latin"], self.number(kind, attempt, value, *tweak, bits=8 * n)
        made = ""
        for _ in range(n):
            x, k = divmod(x, len(parts))
            made += parts[k]
        return made

    def _of(self, kind: str, value: str, attempt: int = 0) -> str:
        """The canonical form of the replacement of an entity in its canonical form."""
        tweak = (kind, attempt)
        if kind == "surname" or kind.startswith("given-"):
            if (script := script_of(value)) is None:
                return self.same_format(value, *tweak) if attempt < PERMUTATIONS else self.same_format(value, *tweak) + self.same_format(value, *tweak, "more")
            if kind == "surname":
                return self._syllables(4 + attempt // 2, *tweak, value)
            names = GIVEN[script, kind[-1]] if kind[-1] != "n" else GIVEN[script, "f"] + GIVEN[script, "m"]
            first = names[self.number(*tweak, value) % len(names)].casefold()
            return first if not attempt else f"{first}-{self._syllables(1 + attempt, *tweak, value, 'added')}"
        if kind == "ip":
            return str(ipaddress.IPv4Address(self._ip(int(ipaddress.IPv4Address(value)), tweak)))
        if kind == "ip6":
            a = ipaddress.IPv6Address(value)
            free = 64 if a.is_link_local else 96 if value.startswith("2001:db8:") else 120 if a.is_private else 112
            number = int(a)
            return str(ipaddress.IPv6Address(number >> free << free | self.permute(number & (1 << free) - 1, 1 << free, *tweak, number >> free)))
        if kind == "card":
            return self._card(value, tweak)
        if kind == "ssn":
            return self.same_format(value, *tweak)
        if kind == "iban":
            # A letter or digit stays one; the check digits follow from the rest.
            body = self.same_format(value[4:], *tweak, value[:2])
            return f"{value[:2]}{98 - _iban_rest(value[:2] + '00' + body):02d}{body}"
        if kind == "phone":
            code = next((value[1 : 1 + n] for n in (1, 2) if value[1 : 1 + n] in CALLING_CODES), value[1:4])
            return f"+{code}{self.same_format(value[1 + len(code) :], *tweak, code)}"
        if kind == "email":
            local, _, domain = value.rpartition("@")
            labels = domain.split(".")
            known = 2 if labels[-2] == "example" else 1
            host = ".".join([*(self.same_format(x, *tweak, "host") for x in labels[:-known]), *labels[-known:]])
            if attempt >= PERMUTATIONS or not any(_class(c)[1] for c in local):
                return f"{self._drawn(12 + attempt, _CLASSES[1] + _CLASSES[0], *tweak, value)}@{host}"
            return f"{self.same_format(local, *tweak)}@{host}"
        if kind == "secret":
            head = re.match(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|eyJ", value).group()
            rest = value[len(head) :]
            if head not in ("AKIA", "ASIA") and (attempt >= PERMUTATIONS or not any(_class(c)[1] for c in rest)):
                return head + "".join(c if c == "." else self._drawn(1, _ALNUM, *tweak, value, k) for k, c in enumerate(rest)) + self._drawn(12 + attempt, _ALNUM, *tweak, value)
            return head + self.same_format(rest, *tweak, head)
        if attempt >= PERMUTATIONS:  # a password
            return self._drawn(12 + attempt, _ALNUM, *tweak, value) + self._drawn(1, _CLASSES[0], *tweak, value, "digit")
        for alphabet in ("0123456789abcdef", "0123456789ABCDEF"):
            if all(c in alphabet for c in value):
                return self.same_format(value, *tweak, alphabet=alphabet)
        return self.same_format(value, *tweak)

    def _card(self, digits: str, tweak: tuple) -> str:
        """The check digit follows from the others, or is one of the nine wrong ones."""
        head, last, n = digits[:-1], int(digits[-1]), len(digits)
        right = -_luhn(head + "0") % 10
        if last == right:
            head = f"{self.permute(int(head), 10 ** (n - 1), *tweak, n):0{n - 1}d}"
            return f"{head}{-_luhn(head + '0') % 10}"
        x = self.permute(int(head) * 9 + (last - right) % 10 - 1, 9 * 10 ** (n - 1), *tweak, n, "wrong")
        head = f"{x // 9:0{n - 1}d}"
        return f"{head}{(-_luhn(head + '0') + x % 9 + 1) % 10}"

    def _ip(self, number: int, tweak: tuple) -> int:
        """An address of the same kind of network."""
        for a, b in _CLOSED:
            if a <= number < b:
                return a + self.permute(number - a, b - a, *tweak, a)
        rank, total = 0, sum(b - a for a, b in _OPEN)
        for a, b in _OPEN:
            if number >= b:
                rank += b - a
            elif number >= a:
                rank += number - a
        rank = self.permute(rank, total, *tweak)
        for a, b in _OPEN:
            if rank < b - a:
                return a + rank
            rank -= b - a
        raise AssertionError("a rank is within the open ranges")

    def written(self, kind: str, value: str, made: str) -> str:
        """The replacement in the way its entity is written."""
        if kind in ("phone", "card", "ssn", "iban"):
            signs = [c for c in made if c.isalnum()]
            places = [k for k, c in enumerate(value) if c.isalnum()]
            out = list(value)
            for k, c in zip(places, signs[len(signs) - len(places) :], strict=True):  # without its country's code, a number has fewer
                out[k] = c
            return "".join(out)
        if kind == "surname" or kind.startswith("given-"):
            if value.isupper() and len(value) > 1:
                return made.upper()
            return "-".join(p.capitalize() for p in made.split("-"))
        if kind == "email" and value != value.lower():
            if len(value) == len(made) == len(value.lower()):
                return "".join(m.upper() if v.isupper() and len(m.upper()) == 1 else m for v, m in zip(value, made, strict=True))
            return made.upper() if value.isupper() else made
        return made

    def rewrite(self, text: str | None, exceptions: dict[tuple[str, str], int]) -> tuple[str | None, list[tuple[str, str]]]:
        """The text with its entities replaced, and the type and replacement of each."""
        out, made, last = [], [], 0
        for start, end, kind in detect(text or ""):
            value = text[start:end]
            known = canonical(kind, value)
            new = self.written(kind, value, self.of(kind, known, exceptions.get((kind, known), 0)))
            out += (text[last:start], new)
            made.append((kind, new))
            last = end
        return (text, made) if not made else ("".join([*out, text[last:]]), made)


def entities_of(text: str | None) -> list[tuple[str, str]]:
    """Type and canonical form of each entity."""
    return [(kind, canonical(kind, text[a:b])) for a, b, kind in detect(text or "")]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct entities of each batch."""
    for batch in batches:
        found = {e for text in batch.column(0).to_pylist() for e in entities_of(text)}
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["kind", "value"])


def exceptions(scratch: Scratch, texts: DataFrame, key: str) -> DataFrame | None:
    """kind, value and attempt of all entities whose first replacement isn't theirs alone; None if there are none."""
    entities = scratch.keep(texts.select("text").mapInArrow(_find, "kind string, value string").distinct(), "entities")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for batch in batches:
            kinds, values, attempts = (batch.column(k).to_pylist() for k in range(3))
            family = [k.split("-")[0] for k in kinds]  # given names of all genders are kept apart
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(family, pa.string()), pa.array(map(make.of, kinds, values, attempts), pa.string())], names=["kind", "value", "attempt", "family", "made"])

    def made(rows: DataFrame, name: str) -> DataFrame:
        return scratch.keep(rows.select("kind", "value", "attempt").mapInArrow(replace, "kind string, value string, attempt int, family string, made string"), name)

    def losers(rows: DataFrame, name: str) -> DataFrame:
        """Of those that share a replacement all but one, and those that are their own; each with its next attempt."""
        first = rows.groupBy("family", "made").agg(F.min(F.struct("attempt", "kind", "value")).alias("first"), F.count("*").alias("n"))
        clash = first.where("n > 1").join(rows, ["family", "made"]).where("first.kind != kind OR first.value != value").select("kind", "value", "attempt")
        same = rows.where("made = value").select("kind", "value", "attempt")
        return scratch.keep(clash.unionByName(same).distinct().withColumn("attempt", F.col("attempt") + 1), name)

    base = made(entities.withColumn("attempt", F.lit(0)), "made0")
    again, some, turn = losers(base, "again0"), None, 0
    while not again.isEmpty():
        turn += 1
        new = made(again, f"made{turn}")  # only what has changed is made again
        some = new if some is None else some.join(again, ["kind", "value"], "left_anti").unionByName(new)
        some = scratch.keep(some, f"some{turn}")
        held = base.join(some.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(some)
        rivals = held.join(new.select("family", "made").distinct(), ["family", "made"], "left_semi")
        again = losers(rivals, f"again{turn}")
    return None if some is None else some.select("kind", "value", "attempt")


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with replaced ``text``, and ``n_entities`` and ``entities`` (type and replacement, in text order)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    columns = [c for c in docs.columns if c not in ("text", "n_entities", "entities")]
    docs = docs.select(*map(quoted, columns), F.col("text").cast("string").alias("text"))
    odd = exceptions(scratch, docs, key)
    few: dict[tuple[str, str], int] = {}
    if odd is not None and odd.count() <= BROADCAST_EXCEPTIONS:
        few = {(r.kind, r.value): r.attempt for r in odd.collect()}
    elif odd is not None:
        docs = _with_own_exceptions(docs, odd)
    shared = spark.sparkContext.broadcast(few)
    own_at = len(columns) + 1 if len(docs.columns) > len(columns) + 1 else None
    names = [f"c{k}" for k in range(len(columns))]  # columns may be named anything
    schema = StructType([StructField(name, f.dataType) for name, f in zip(names, docs.schema.fields, strict=False)])
    pair = StructType([StructField("type", StringType()), StructField("surrogate", StringType())])
    schema = schema.add("text", StringType()).add("n_entities", IntegerType()).add("entities", ArrayType(pair))
    made_type = pa.list_(pa.struct([("type", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, known = Surrogates(key), shared.value
        for batch in batches:
            texts, counts, entities = [], [], []
            own = batch.column(own_at).to_pylist() if own_at else [None] * batch.num_rows
            for text, odd_here in zip(batch.column(len(columns)).to_pylist(), own, strict=True):
                here = known | {(x["kind"], x["value"]): x["attempt"] for x in odd_here} if odd_here else known
                new, made = make.rewrite(text, here)
                texts.append(new)
                counts.append(len(made))
                entities.append([{"type": k, "surrogate": v} for k, v in made])
            kept = batch.columns[: len(columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(entities, made_type)], names=schema.names)

    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).mapInArrow(run, schema).toDF(*columns, "text", "n_entities", "entities")


def _with_own_exceptions(docs: DataFrame, odd: DataFrame) -> DataFrame:
    """``docs`` with each row's own exceptions as the last column; a text has as many as it has entities."""
    digest = F.xxhash64("text")

    def per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *e) for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in entities_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["__h", "kind", "value"])

    found = docs.select(digest.alias("__h"), "text").mapInArrow(per_text, "__h long, kind string, value string").distinct()
    own = found.join(odd, ["kind", "value"]).groupBy(F.col("__h").alias("__odd_h")).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("__odd"))
    return docs.join(own, digest == F.col("__odd_h"), "left").select(*map(quoted, docs.columns), "__odd")
