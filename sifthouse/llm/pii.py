"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

Entities: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards, bank accounts (IBAN),
social security numbers, account keys, web tokens, private keys, secrets behind ``password``/``token``/``key``
signs up to their end, and all words of names behind an honorific, here and wherever else the same text
repeats them; particles such as "van der" stay. Texts are searched once: what is found is settled with them. A surrogate is a keyed
permutation of the entity's own letters and digits within its format, so equal entities get equal
surrogates everywhere (coreference) and different ones different surrogates; names are drawn from
pools by gender and script and continued by syllables. A name is one entity whatever stands before
it; one that has more than one gender in the corpus is drawn from the pool of the only gender but
"n" it has, or else of "n". All surrogates of a corpus are then checked against each other and
against the entities found: any that coincide are drawn again, the smallest entity keeping its
first, until none do. Only entities that a document can't draw by itself travel to the documents.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .shared import free_prefix, with_fields

# Honorifics by gender, and given and family names by script and gender.
HONORIFICS = {
    "f": ["Mrs", "Ms", "Miss", "Madam", "Mme", "Mlle", "Madame", "Frau", "Señora", "Sra", "Doña", "Signora", "Госпожа", "Κυρία"],
    "m": ["Mr", "Mister", "Sir", "Monsieur", "Herr", "Herrn", "Señor", "Sr", "Don", "Signor", "Господин", "Κύριος"],
    "n": ["Dr", "Prof", "Professor", "Доктор"],
}
NAMES = {
    ("latin", "f"): ["Adele", "Birgit", "Clara", "Dora", "Elena", "Fiona", "Greta", "Hanna", "Ines", "Julia", "Karin", "Lena", "Maria", "Nora", "Olga", "Paula"],
    ("latin", "m"): ["Albert", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Martin", "Nils", "Oscar", "Peter"],
    ("latin", "n"): ["Alder", "Bergen", "Castor", "Dalton", "Ellis", "Farrow", "Gordon", "Harlow", "Imhof", "Jansen", "Keller", "Lorenz", "Meyer", "Norden", "Ortega", "Palmer"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Лидия", "Мария"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Павел"],
    ("cyrillic", "n"): ["Белый", "Волков", "Громов", "Долин", "Жуков", "Зимин", "Лесной", "Орлов"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία", "Χαρά", "Ζωή", "Δήμητρα"],
    ("greek", "m"): ["Άρης", "Γιάννης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Θάνος", "Μάριος"],
    ("greek", "n"): ["Βασιλείου", "Γεωργίου", "Ιωάννου", "Κωστόπουλος", "Νικολάου", "Παπάς", "Ρήγας", "Σταύρου"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "ru", "sa", "te", "vi", "wo", "za", "ri"],
    "cyrillic": ["ба", "де", "ви", "го", "ку", "ла", "ме", "ни", "ро", "су", "та", "зе", "фи", "жо", "ша", "ри"],
    "greek": ["βα", "δε", "φι", "γο", "κου", "λα", "με", "νι", "ρο", "σα", "τε", "ζι", "πο", "θα", "χε", "ρι"],
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
# End of fixed values.

_GENDER = {h: g for g, words in HONORIFICS.items() for h in words}
_GENDER |= {h.upper(): _GENDER[h] for h in ("Mr", "Mrs", "Ms", "Dr", "Prof")}
#: Small words between the words of a name.
_PARTICLE = r"(?:(?:van|von|vom|zu|de)(?:[  ](?:der|den|dem|la|las|le|los))?|del|della|di|da|dos|du|la|le|el|al|bin|ibn|ben|ter|ten|af|av|y)(?![\w'’])"


def _capitals(*ranges: tuple[int, int]) -> str:
    return "".join(chr(c) for a, b in ranges for c in range(a, b) if chr(c).isupper())


_UPPER = f"[{_capitals((0x41, 0x250), (0x370, 0x530), (0x1E00, 0x2000))}]"
_LETTER = r"[^\W\d_][̀-ͯ]*"
#: A capital and at least one letter, parts behind hyphens and apostrophes, and a part of one letter before an apostrophe.
_NAME = rf"(?:[A-Za-z]['’])?{_UPPER}[̀-ͯ]*(?:{_LETTER})+(?:['’-](?:{_LETTER})+)*"
_INITIAL = rf"{_UPPER}\.?(?!\w)"
_SEP = "[  ]"
_PLAIN_TITLES = "|".join(sorted((h for h in _GENDER if h != "Don"), key=len, reverse=True))
_TITLED = rf"(?:{_PLAIN_TITLES})\b\.?{_SEP}{_UPPER}"
#: The first word of a name, and those that follow it.
_PERSON = (
    rf"(?:{_INITIAL}{_SEP}?){{0,3}}(?:{_PARTICLE}{_SEP}){{0,3}}(?!{_TITLED})(?:{_NAME})"
    rf"(?:{_SEP}(?:{_INITIAL}{_SEP}?)*(?:{_PARTICLE}{_SEP}){{0,3}}(?!{_TITLED})(?:{_NAME}))*")
#: Parts of a name, and words of a text that may repeat one.
_PART = re.compile(rf"(?:{_LETTER})+")
#: A value starts as keys do, or has four letters or digits. It ends at its quote, or else at a blank, a quote or a closing sign.
_REST = r"[^\s\"'`<>,;&|)\]}]"
_FOUR = lambda rest: rf"(?=(?:(?![A-Za-z0-9]){rest})*(?:[A-Za-z0-9](?:(?![A-Za-z0-9]){rest})*){{4}})"
_QUOTED = "|".join(rf"(?<={q}){_FOUR(rest)}{rest}{{6,}}(?={q})" for q, rest in (('"', r"[^\"\n]"), ("'", r"[^'\n]")))
_VALUE = rf"(?:{_QUOTED}|(?:(?={_REST}*[A-Za-z0-9])[A-Za-z0-9_+/-]{{6}}|{_FOUR(_REST)}{_REST}{{6}}){_REST}*(?<![.:!?]))"
PATTERN = re.compile(
    # from a boundary to the at sign, however long: possessive, so that a long word without one is read once; then labels of any number, length and script
    r"(?P<email>(?<![\w.%+-])(?<!\w['’])[.%+-]*+\w(?:[\w.%+-]|['’](?=\w))*+@(?:\w(?:[\w-]*\w)?\.)+[^\W\d_]{2,})"
    r"|(?P<key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"
    r"|(?P<pem>(?<=-----BEGIN PRIVATE KEY-----)[A-Za-z0-9+/=\s]+|(?<=-----BEGIN RSA PRIVATE KEY-----)[A-Za-z0-9+/=\s]+|(?<=-----BEGIN EC PRIVATE KEY-----)[A-Za-z0-9+/=\s]+|(?<=-----BEGIN OPENSSH PRIVATE KEY-----)[A-Za-z0-9+/=\s]+)"
    r"|(?P<token>\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|\bgh[pousr]_[A-Za-z0-9]{20,}|\bgithub_pat_[A-Za-z0-9_]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bsk_live_[A-Za-z0-9]{16,})"
    rf"|(?P<secret>(?i:\b(?:password|passwd|pwd|token|secret|api_?key)\b\s{{0,3}}[=:]\s{{0,3}}[\"']?)(?P<value>{_VALUE}))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ipv6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:.])|(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?(?![\w:.]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9]))"
    r"|(?P<ssn>(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w.])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\w-])"
    r"|(?<![\w.+-])0(?:\d(?:[ .-]\d\d){4}|\d{4}[ -]\d{6}|\d{1,4}[ /-]\d{5,8})(?![\w-]|[.,]\d))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    rf"|(?P<title>\b(?:{'|'.join(sorted(_GENDER, key=len, reverse=True))})\b\.?{_SEP}(?:(?:{'|'.join(HONORIFICS['n'])})\b\.?{_SEP})*)(?P<name>{_PERSON})"
)
#: What says of which kind a token is, and stays.
_TOKEN_HEAD = re.compile("eyJ|gh[pousr]_|github_pat_|xox[abprs]-|sk_live_")
#: A text without any of these holds no entity.
_HINT = re.compile(rf"[@\d]|-----BEGIN|(?i:passw|pwd|token|secret|api_?key)|\b(?:{'|'.join(_GENDER)})\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_check(account: str) -> str:
    """The two check digits of country and account: 98 less the remainder by 97 of their digits, letters counting from 10."""
    digits = "".join(str(int(c, 36)) for c in account[4:] + account[:2] + "00")
    return f"{98 - int(digits) % 97:02d}"


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _name_parts(name: str, at: int) -> Iterator[tuple[int, int, bool]]:
    """``(begin, end, initial)`` of the parts of a name that are replaced: not particles, nor short ends behind an apostrophe."""
    for m in _PART.finditer(name):
        part, before, after = m[0], name[: m.start()], name[m.end() : m.end() + 1]
        if len(part) == 1:
            if part.isupper() and after not in ("'", "’"):
                yield at + m.start(), at + m.end(), True
        elif not (part[0].islower() and (not before or before[-1] in "  " or (before[-1] in "'’" and len(part) < 3))):
            yield at + m.start(), at + m.end(), False


def entities(text: str | None) -> Iterator[tuple[int, int, str, str]]:
    """``(begin, end, kind, value)`` of each entity, in order. ``value`` is the same for all spellings of an entity."""
    if not text or not _HINT.search(text):
        return
    found, names = [], {}
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        if m["email"]:
            found.append((m.start(), m.end(), "email", m["email"].lower()))
        elif m["key"]:
            found.append((m.start(), m.end(), "key", m["key"]))
        elif m["secret"]:
            found.append((m.start("value"), m.end("value"), "secret", m["value"]))
        elif m["pem"] or m["token"]:
            found.append((m.start(), m.end(), "secret", m[0]))
        elif m["ipv6"]:
            groups = m["ipv6"].split(":")
            if len(groups) <= 8:
                found.append((m.start(), m.end(), "ipv6", ipaddress.IPv6Address(m["ipv6"]).exploded))
        elif m["iban"]:
            account = m["iban"].replace(" ", "")
            if account[2:4] == iban_check(account):
                found.append((m.start(), m.end(), "iban", account))
        elif m["ssn"]:
            found.append((m.start(), m.end(), "ssn", m["ssn"]))
        elif m["ip"]:
            found.append((m.start(), m.end(), "ip", ".".join(str(int(x)) for x in m["ip"].split("."))))
        elif m["phone"]:
            found.append((m.start(), m.end(), "phone", re.sub(r"\D", "", m["phone"])))
        elif m["card"]:
            found.append((m.start(), m.end(), "card", re.sub(r"\D", "", m["card"])))
        elif kind:
            gender = _GENDER[m["title"].split()[0].rstrip(".")]
            parts = list(_name_parts(m["name"], m.start("name")))
            several = sum(not initial for _, _, initial in parts) > 1
            for i, (begin, end, initial) in enumerate(parts):
                word = text[begin:end]
                role = "i" if initial else gender if i == 0 and several else "n"
                found.append((begin, end, f"name-{role}-{script_of(word)}", word.lower()))
                if not initial:
                    names.setdefault(word.lower(), found[-1][2])
    if names:
        found = _with_repeats(text, found, names)
    yield from found


def _with_repeats(text: str, found: list[tuple[int, int, str, str]], names: dict[str, str]) -> list[tuple[int, int, str, str]]:
    """``found`` and the bare repeats of names: of the kind of the name before them, or of the first there is."""
    out, at, last = [], 0, dict(names)
    for entity in [*found, (len(text), len(text), "", "")]:
        for m in _PART.finditer(text, at, entity[0]):
            if m[0][0].isupper() and m[0].lower() in names:
                around = text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1]
                if not any(c.isdigit() or c == "_" for c in around):
                    out.append((m.start(), m.end(), last[m[0].lower()], m[0].lower()))
        out.append(entity)
        at = entity[1]
        if entity[3] in names and entity[2].startswith("name"):
            last[entity[3]] = entity[2]
    return out[:-1]


#: Letters of other scripts, permuted among themselves; the kind is none of their own letters.
_OTHER = (("\x01", ALPHABETS["cyrillic"]), ("\x02", ALPHABETS["greek"]))


def _plain_letters(value: str) -> str:
    """Letters without a place in their script's alphabet stand as one of it, so that none stays in a surrogate."""
    known = lambda c: c.isascii() or not c.isalpha() or any(c in alphabet for _, alphabet in _OTHER)
    return "".join(c if known(c) else (letters := ALPHABETS[script_of(c)])[ord(c) % len(letters)] for c in value)


class Surrogates:
    """Keyed surrogates. ``attempt`` redraws one that coincided with another."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _number(self, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=self.key, digest_size=16).digest(), "big")

    def permute(self, symbols: str, alphabet: str, tweak: str) -> str:
        """A keyed permutation of all strings of this length over ``alphabet``: ten Feistel rounds over two halves."""
        n, size = len(symbols), len(alphabet)
        if n == 1:
            return alphabet[(alphabet.index(symbols) + self._number(tweak) % size) % size]
        half = n // 2
        left = [alphabet.index(c) for c in symbols[:half]]
        right = [alphabet.index(c) for c in symbols[half:]]
        for turn in range(10):
            shift = self._number(tweak, n, turn, *right)
            moved = []
            for i, v in enumerate(left):
                shift, r = divmod(shift, size) if i % 24 or not i else divmod(self._number(tweak, n, turn, i, *right), size)
                moved.append((v + r) % size)
            left, right = right, moved
        return "".join(alphabet[v] for v in left + right)

    def within(self, symbols: str, alphabet: str, tweak: str, fits: Callable[[str], bool]) -> str:
        """Permute until the result fits; among strings that fit, as the input does, this is a permutation too."""
        out = self.permute(symbols, alphabet, tweak)
        while not fits(out):
            out = self.permute(out, alphabet, tweak)
        return out

    def format(self, value: str, tweak: str) -> str:
        """Letters and digits of ``value`` permuted among their kind, all else in place."""
        out = list(value)
        shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", value)))
        if not value.isascii():
            shape = "".join(next((k for k, alphabet in _OTHER if c in alphabet), c) for c in shape)
        context = f"{tweak}|{shape}"
        for kind, alphabet in (("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0", "0123456789"), *(_OTHER if not value.isascii() else ())):
            places = [i for i, c in enumerate(shape) if c == kind]
            if places:
                old = "".join(value[i] for i in places)
                for i, c in zip(places, self.permute(old, alphabet, context), strict=True):
                    out[i] = c
                context += "|" + old
        return "".join(out)

    def __call__(self, kind: str, value: str, attempt: int = 0) -> str:
        tweak = f"{kind}|{attempt}"
        if kind == "email":
            local, domain = (_plain_letters(x) for x in value.split("@"))
            body, _, top = domain.rpartition(".")
            more = "".join("abcdefghijklmnopqrstuvwxyz"[self._number(tweak, value, i) % 26] for i in range(attempt - 3))  # where all addresses of the format are taken
            return f"{self.format(local, f'{tweak}|{domain}')}{more}@{self.format(body, tweak + '|domain')}.{top}"
        if kind == "ipv6":
            return ipaddress.IPv6Address(int(self.permute(f"{int(ipaddress.IPv6Address(value)):0128b}", "01", tweak), 2)).exploded
        if kind == "iban":
            account = value[:2] + "00" + self.format(value[4:], tweak + value[:2])
            return account[:2] + iban_check(account) + account[4:]
        if kind == "ssn":  # areas from 100 to 599 are left among themselves
            fits = lambda s: s[0] in "12345" and s[3:5] != "00" and s[5:] != "0000"
            digits = value.replace("-", "")
            new = self.within(digits, "0123456789", tweak, fits) if fits(digits) else self.permute(digits, "0123456789", tweak)
            return f"{new[:3]}-{new[3:5]}-{new[5:]}"
        if kind == "secret" and (head := _TOKEN_HEAD.match(value)):
            return head[0] + self.format(value[head.end() :], tweak + head[0])
        if kind == "secret" and re.fullmatch("[0-9a-f]+", value):
            return self.permute(value, "0123456789abcdef", tweak)
        if kind == "key":
            return value[:4] + self.permute(value[4:], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", tweak)
        if kind == "ip":
            bits = f"{int.from_bytes(bytes(map(int, value.split('.'))), 'big'):032b}"
            new = int(self.within(bits, "01", tweak, lambda b: 0 < int(b[:8], 2) < 224), 2) if 0 < int(value.split(".")[0]) < 224 else int(self.permute(bits, "01", tweak), 2)
            return ".".join(map(str, new.to_bytes(4, "big")))
        if kind == "phone":
            keep = max(len(value) - 10, 0)
            head, rest = value[:keep], value[keep:]
            good = lambda s: s[0] in "23456789"
            return head + (self.within(rest, "0123456789", tweak, good) if good(rest) else self.permute(rest, "0123456789", tweak))
        if kind == "card":
            first, rest = value[0], value[1:]
            if luhn(value):
                return first + self.within(rest, "0123456789", tweak + first, lambda s: luhn(first + s))
            return first + self.permute(rest, "0123456789", tweak + first)
        if kind.startswith("name"):
            _, gender, script = kind.split("-")
            if gender == "i":  # another letter; too few to be redrawn
                letters = ALPHABETS[script]
                return letters[(letters.find(value) + 1 + self._number(kind) % (len(letters) - 1)) % len(letters)]
            pool = NAMES[script, gender]
            number = self._number("name", attempt, value)  # of the name alone: gender and script choose the pool
            name = pool[number % len(pool)].lower()
            number //= len(pool)
            for _ in range(min(attempt, 6)):  # a name that is taken is continued
                name += SYLLABLES[script][number % 16]
                number //= 16
            return name
        return self.format(value, tweak)


def spelled(original: str, surrogate: str, kind: str) -> str:
    """The surrogate in the original's separators and letter case."""
    if kind in ("phone", "card", "iban"):
        symbols = iter(surrogate)
        return "".join(next(symbols) if c.isalnum() else c for c in original)
    if kind.startswith("name"):
        return surrogate.upper() if original.isupper() else surrogate[0].upper() + surrogate[1:] if original[0].isupper() else surrogate
    if kind == "email" and original != original.lower():
        return surrogate.upper() if original.isupper() else surrogate
    return surrogate


def _family(kind: Column) -> Column:
    """What an entity is beside its value: its kind, without the gender of a name."""
    return F.when(kind.startswith("name-"), F.concat(F.lit("name-"), F.substring_index(kind, "-", -1))).otherwise(kind)


def mark_entities(docs: DataFrame, row: str, spans: str) -> DataFrame:
    """``docs`` with a number of each row and the ``entities`` of its text, settled: later passes search no text again."""
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    names = numbered.columns
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip("a b kind value".split(), e, strict=True)) for e in entities(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*names, spans])

    return settle(numbered.mapInArrow(run, with_fields(numbered, f"`{spans}` array<struct<a:int,b:int,kind:string,value:string>>")))


def _drawn(values: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = Surrogates(key)
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("kind", "value", "attempt")]
            made = [draw(k, v, a) for k, v, a in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "value", "attempt", "mixed")), pa.array(made, pa.string())], ["kind", "value", "attempt", "mixed", "surrogate"])

    return values.select("kind", "value", "attempt", "mixed").mapInArrow(run, "kind string, value string, attempt int, mixed boolean, surrogate string")


def redrawn_entities(found: DataFrame, key: bytes, rounds: int = 40) -> DataFrame:
    """``family, value, kind, attempt`` of the entities of ``found(kind, value)`` that a document can't draw by itself.

    These are the names of several genders, and the entities whose first surrogate coincides
    with another's or with an entity of the corpus. Each round redraws all but the smallest
    value of every coincidence. Initials aren't redrawn, as there are too few.
    """
    kind, family = F.col("kind"), F.substring_index("kind", "-", 1)
    one = found.filter(~kind.startswith("name-i-")).groupBy(_family(kind).alias("family"), "value").agg(F.min("kind").alias("least"), F.max("kind").alias("most"), F.bool_or(kind.startswith("name-m-")).alias("m"))
    # of kinds name-f, name-m and name-n: f and m, or all of them, make n
    gender = F.when(F.col("least").startswith("name-f-"), F.when(F.col("m"), "n").otherwise("f")).otherwise("m")
    mixed = F.col("least") < F.col("most")
    values = one.select(
        F.when(mixed, F.concat(F.lit("name-"), gender, F.lit("-"), F.substring_index("most", "-", -1))).otherwise(F.col("least")).alias("kind"),
        "value", F.lit(0).alias("attempt"), mixed.alias("mixed"))
    drawn = settle(_drawn(values, key))
    for _ in range(rounds):
        shared = drawn.groupBy(family.alias("f"), "surrogate").agg(F.min(F.struct("value", "kind")).alias("keeps"), F.count("*").alias("n")).filter("n > 1")
        real = drawn.select(family.alias("f"), F.col("value").alias("surrogate")).distinct()
        clash = drawn.withColumn("f", family).join(shared.select("f", "surrogate", "keeps"), ["f", "surrogate"], "left")
        clash = clash.join(real.withColumn("real", F.lit(True)), ["f", "surrogate"], "left")
        again = (F.col("keeps").isNotNull() & (F.struct("value", "kind") != F.col("keeps"))) | F.col("real").isNotNull()
        marked = settle(clash.select("kind", "value", "attempt", "mixed", "surrogate", F.coalesce(again, F.lit(False)).alias("again")))
        if marked.filter("again").isEmpty():
            break
        redo = _drawn(marked.filter("again").withColumn("attempt", F.col("attempt") + 1), key)
        drawn = settle(marked.filter("not again").drop("again").unionByName(redo))
    else:
        raise RuntimeError(f"surrogates still coincide after {rounds} rounds")
    return drawn.filter("attempt > 0 or mixed").select(_family(kind).alias("family"), "value", "kind", "attempt")


def replace_pii(docs: DataFrame, key: bytes | None = None, prefix: str = "") -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``n_entities`` (occurrences) and ``kinds`` (sorted, distinct) behind ``prefix``.

    ``key`` decides the surrogates, and who has it can undo those of numbers and addresses. None
    takes it from the session's ``spark.sifthouse.pii.key``, or draws a new one for this call
    where that is unset. Null texts stay null, texts without entities stay as they are. Other
    columns are kept, but those named as the new ones. Rows that repeat a ``doc_id`` or lack one
    are treated as any others: surrogates depend on the corpus's entities only.
    """
    if key is None:
        given = docs.sparkSession.conf.get("spark.sifthouse.pii.key", None)
        key = given.encode() if given else secrets.token_bytes(32)
    counted, sorts = f"{prefix}n_entities", f"{prefix}kinds"
    base = docs.drop(counted, sorts)
    own = free_prefix(base, "pii_")
    row, spans, redrawn = f"{own}row", f"{own}spans", f"{own}redrawn"
    marked = mark_entities(base, row, spans)
    held = marked.filter(F.size(spans) > 0)
    found = held.select(F.col(row).alias("row"), F.explode(spans).alias("e")).select("row", "e.kind", "e.value").distinct()
    again = redrawn_entities(found, key)
    none = F.lit(None).cast("array<struct<kind:string,value:string,attempt:int,family:string>>")
    if again.isEmpty():
        given = marked.withColumn(redrawn, none)
    else:
        travels = found.select("row", _family(F.col("kind")).alias("family"), "value").distinct().join(again, ["family", "value"])
        per_row = travels.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("kind", "value", "attempt", "family")).alias(redrawn))
        given = held.join(per_row, row, "left").select(*marked.columns, redrawn).unionByName(marked.filter(F.size(spans) == 0).withColumn(redrawn, none))
    names = base.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = Surrogates(key)
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text, here, others in zip(*(batch.column(c).to_pylist() for c in ("text", spans, redrawn)), strict=True):
                drawn = {(r["family"], r["value"]): (r["kind"], r["attempt"]) for r in others or ()}
                parts, at, seen = [], 0, []
                for e in here:
                    kind, value = e["kind"], e["value"]
                    family = f"name-{kind.rpartition('-')[2]}" if kind.startswith("name-") and not kind.startswith("name-i-") else kind
                    own_kind, attempt = drawn.get((family, value), (kind, 0))
                    parts += [text[at : e["a"]], spelled(text[e["a"] : e["b"]], draw(own_kind, value, attempt), kind)]
                    at = e["b"]
                    seen.append(kind.split("-")[0])
                texts.append("".join([*parts, text[at:]]) if parts else text)
                counts.append(len(seen))
                kinds.append(sorted(set(seen)))
            columns = [pa.array(texts, batch.column("text").type) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(kinds, pa.list_(pa.string()))], [*names, counted, sorts])

    return given.mapInArrow(run, with_fields(base, f"`{counted}` int, `{sorts}` array<string>"))
