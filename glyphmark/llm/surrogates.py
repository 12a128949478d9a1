"""PII: detected entities get keyed, type-consistent surrogates.

Kinds: email (with what stands before a colon in front of it, as in user:pass@host), IPv4 and
IPv6, phone, card, ssn, iban, and a person's name: after one or more titles, after words that
introduce one ("my name is", there also in small letters), after a known given name, and
wherever one of its words stands again in the same text.  A name has any number of words and
particles ("von der", "de la", which stay).  A family name that is also an English word
(COMMON) isn't taken where it begins a sentence before a small letter.  Other names without
any such sign aren't told from other capitalised words, and stay.

A surrogate is drawn by a keyed hash of the kind and the entity's plain form (`plain`): small
letters of an address or a name, digits of a phone or card, the groups of an IPv6 address.  So
one entity has one surrogate in the whole corpus, however it is spelled (coreference), and
`dressed` gives it the spelling of the place: digits for digits, letters for letters of the
same case and script, separators, a phone's country code, an address's top domain, a card's
first digit and Luhn sum, octets below 255; a name keeps the gender of its title, or else of
the known given name, and its number of words.  Given and family names are entities of their
own, so a family keeps its name in every full name, also when one is drawn again.

Collision checks run over the distinct entities of the corpus: a surrogate that two entities
share, or that is itself an entity of the corpus, is drawn again (the one of the smallest
digest keeps its own) until none is left.  From the attempt GROW_AFTER on (for names from the
first) each attempt adds a syllable to a name, a letter to an address and a digit to a phone,
so their room never runs out; the other kinds have 10 ** 9 surrogates or more (an IPv6 address
keeps its groups of zero, so a short one has fewer), and a corpus that uses them up is an
error.  Redrawn entities are usually a handful; up to MAX_BROADCAST they are broadcast, more
are joined to the documents that hold them.

Work tables hold no clear value: entities are keyed digests, beside the value sealed by a
stream of the same key for the next draw.  All tables but the digests of redrawn entities
that are too many to broadcast are removed before the result is given, also after an error.

Null texts stay null; texts without entities stay as they are.  Rows that repeat a doc_id
are treated row by row.  Only `doc_id` and `text` are read; other columns may have any name.
The key is the caller's; the query takes it from the setting spark.surrogates.key and else
uses DEMO_KEY, which is public and protects nothing.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.llm.common import dropped, stored, table, text_key

KEY_SETTING, DEMO_KEY = "spark.surrogates.key", "surrogate-key-1"
MAX_BROADCAST, MAX_ROUNDS = 100_000, 50
GROW_AFTER = 6

#: A character of a word, but for scripts that write no blanks between words.
_W = r"[^\W฀-๿⺀-鿿가-힯豈-﫿]"
_NUMBER = re.compile(
    rf"(?<![.@+\-])(?<!{_W})(?:"
    r"(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))"
    rf"|(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}}(?!{_W}|-))"
    rf"|(?P<card>(?:\d{{13,19}}|\d{{4}}(?:[ \-]\d{{4}}){{3}}|3\d{{3}}[ \-]\d{{6}}[ \-]\d{{4,5}})(?!{_W}))"
    rf"|(?P<phone>(?:\(\d{{3}}\) ?\d{{3}}[\-. ]\d{{4}}|\d{{3}}[\-.]\d{{3}}[\-.]\d{{4}}|\(0\d{{1,5}}\)[ \-]?\d{{3,4}}[ \-]?\d{{3,8}}|0\d{{2,4}}[ \-/]\d{{3,4}}[ \-]?\d{{3,4}}|1[3-9]\d{{9}})(?!{_W}))"
    r"|(?P<far>\+\d++(?:[ .\-/]?\(\d{1,5}\)|(?<=\))\d++|[ .\-/]\d++)*+)"
    r")"
)
#: Country codes of one digit and of two; the others have three.
CODES = {1: "1 7".split(), 2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
#: Words before a colon that say that an address follows.
LABELS = set("mailto email e-mail mail to from cc bcc contact kontakt sip xmpp at reply-to sender".split())
_RIGHT = re.compile(r"[\w\-\u0300-\u036f]++(?:\.[\w\-\u0300-\u036f]+)*\.[^\W\d_]{2,}")
_IPV6 = re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
#: Titles and the gender they tell.
TITLES = {"Mr.": "m", "Mr": "m", "Herr": "m", "Herrn": "m", "Señor": "m", "Sr.": "m", "Monsieur": "m", "Господин": "m", "Mrs.": "f", "Mrs": "f", "Ms.": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Sra.": "f", "Madame": "f", "Mme": "f", "Госпожа": "f", "Dr.": "n", "Dr": "n", "Prof.": "n", "Prof": "n", "Professor": "n", "med.": "n", "Dipl.-Ing.": "n"}
#: Particles inside a name, which stay.
PARTICLES = "von van vom der den de la le du da dos das do di del della zu zur ter ten bin ibn al el".split()
#: Family names that are English words, too.
COMMON = set("young long short small little brown white black green gray grey gold silver king rose hope grace will mark bill may rich price church hill wood woods stone rice bush day power best love strong sharp wise cook baker carpenter fisher hunter mason page park parks field fields rivers lake banks bridges moody noble good bright case law street summer winter snow frost rain major".split())
#: Small words that end a name in small letters.
SMALL = set("a an the and or but so not no i im from is was are in on at of to for as my your his her our it this that these with what who which when where how by if just only also very und aus in ich bin nicht der die das ein eine wie von et de en je suis pas y soy no el la un una и из я не".split())
#: Words that introduce a name.
CUES = ("my name is", "My name is", "Name:", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "me llamo", "Me llamo", "je m'appelle", "Je m'appelle", "меня зовут", "Меня зовут")
#: First names by script and gender, syllables for family names.
NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Lukas Martin Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Anna Berta Clara Diana Elena Flora Greta Helena Irene Julia Karin Laura Maria Nina Olga Paula Rosa Sofia Teresa Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Кирилл Леонид Максим Павел".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Ксения Лариса Мария Ольга".split(),
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ka ke la le lo ma me mo na ne no ra re ro sa se so ta te to va ve".split(), "cyrillic": "ба бе во га да де ка ко ла ле ма мо на не по ра ре са та то".split()}
_GIVEN = {n: f"name-{g}" for (_, g), names in NAMES.items() for n in names}
_ONE = r"\p{Lu}[\p{L}\p{M}]*+(?:['’\-][\p{L}\p{M}]++)*+"
_PART = rf"(?:(?:{'|'.join(PARTICLES)})[ \t]+)"
_FULL = rf"({_PART}*{_ONE}(?:[ \t]+{_PART}*{_ONE})*+)"
_either = lambda words: "|".join(regex.escape(w, literal_spaces=True) for w in sorted(words, key=len, reverse=True))
_TITLE = rf"(?:{_either(TITLES)})(?:(?<=\.)|(?!\w))"
_TITLED = regex.compile(rf"(?<!\w)({_TITLE}(?:[ \t]*+{_TITLE})*+)(?:(?<=\.)[ \t]*+|[ \t]++){_FULL}")
_EACH_TITLE = regex.compile(_TITLE)
_CUED = regex.compile(rf"(?<![\w])(?:{_either(CUES)})[ \t]+{_FULL}")
_SMALL_CUED = regex.compile(rf"(?<![\w])(?:{_either([c for c in CUES if c != 'Name:'])})[ \t]+(\p{{Ll}}[\p{{L}}\p{{M}}'’\-]*+(?:[ \t]+\p{{Ll}}[\p{{L}}\p{{M}}'’\-]*+)*+)")
_KNOWN = regex.compile(rf"(?<![\w.@\-])({_either(_GIVEN)})[ \t]+{_PART}*{_ONE}(?![\w@])")
_WORD = regex.compile(r"(?<![\w@.\-])[\p{L}\p{M}]++(?:['’\-][\p{L}\p{M}]++)*+(?![\w@])")
_TITLE_START = re.compile("|".join(sorted({re.escape(t[:2]) for t in TITLES})))


def _before(text: str, at: int) -> int:
    """Where the local part that ends at an @ begins, however long it is; a combining mark belongs to its letter."""

    def back(k: int) -> int:
        while k and ((c := text[k - 1]).isalnum() or c in "_.%+-'’" or unicodedata.category(c)[0] == "M"):
            k -= 1
        return k

    begin = back(at)
    if begin < at and begin and text[begin - 1] == ":":
        user = back(begin - 1)
        if user < begin - 1 and text[user : begin - 1].lower() not in LABELS:
            begin = user
    while begin < at and text[begin] in ".-%+'’":
        begin += 1
    return begin


def _far(text: str, start: int, end: int) -> int:
    """The end of a phone that begins with +: as many groups as have at most 15 digits together; start if that isn't one."""
    groups = [start + m.end() for m in re.finditer(r"\d+\)?", text[start:end])]
    while groups:
        n = sum(c.isdigit() for c in text[start : groups[-1]])
        if n <= 15:
            whole = not re.match(_W, text[groups[-1] : groups[-1] + 1])
            return groups[-1] if whole and (n >= 8 or n >= 5 and len(groups) >= 3) else start
        groups.pop()
    return start


def _kept(words: list[str]) -> list[str]:
    return [w for w in words if w not in PARTICLES] or words[-1:]


def _bare(text: str, start: int, end: int) -> int:
    """The end without a genitive 's."""
    return end - 2 if end - start > 2 and text[end - 2 : end] in ("'s", "’s") else end


def _names(text: str) -> list[tuple[int, int, str]]:
    out = []
    if _TITLE_START.search(text):
        for m in _TITLED.finditer(text):
            told = [g for g in (TITLES[t] for t in _EACH_TITLE.findall(m[1])) if g != "n"]
            out.append((m.start(2), m.end(2), "name-" + (told[0] if told else "n")))
    out += [(m.start(1), m.end(1), "name-n") for m in _CUED.finditer(text)]
    out += [(m.start(), m.end(), _GIVEN[m[1]]) for m in _KNOWN.finditer(text)]
    for m in _SMALL_CUED.finditer(text):
        size = 0
        for w in re.finditer(r"\S+", m[1]):
            if w[0] in SMALL and not (size and w[0] in PARTICLES):
                break
            if w[0] not in PARTICLES:
                size = w.end()
        if size:
            out.append((m.start(1), m.start(1) + size, "name-n"))
    out = [(s, _bare(text, s, e), kind) for s, e, kind in out]
    return out + _again(text, out) if out else out


def _again(text: str, names: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Where words of the names stand alone: family names, and given names of two letters or more."""
    known: dict[str, str] = {}
    for s, e, kind in names:
        words = _kept(text[s:e].split())
        for k, w in enumerate(words):
            if k + 1 == len(words) or len(w) > 1 and w.lower() not in COMMON:
                role = "name-n" if k + 1 == len(words) else "alone-" + kind[5:]
                for spelling in {w, w.upper(), "-".join(x.capitalize() for x in w.split("-"))}:
                    if known.get(spelling) != "name-n":
                        known[spelling] = role
    out = []
    for m in _WORD.finditer(text):
        end = _bare(text, m.start(), m.end())
        pieces = [(m.start(), end)]
        if text[m.start() : end] not in known:
            pieces = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^'’\-]+", m[0])]
        for s, e in pieces:
            word = text[s:e]
            if word in known and not (word.lower() in COMMON and _begins_plainly(text, s, e)):
                out.append((s, e, known[word]))
    return out


def _begins_plainly(text: str, start: int, end: int) -> bool:
    """Whether a word begins a sentence and a word in small letters follows."""
    k = start
    while k and text[k - 1] in " \t":
        k -= 1
    return (k == 0 or text[k - 1] in ".!?\n") and text[end : end + 1] == " " and text[end + 1 : end + 2].islower()


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all entities, from left to right, without overlaps; the longest of those with one start."""
    out: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        right, start = _RIGHT.match(text, at + 1), _before(text, at)
        if right and start < at:
            out.append((start, right.end(), "email"))
        at = text.find("@", at + 1)
    for m in _NUMBER.finditer(text):
        end = _far(text, m.start(), m.end()) if m.lastgroup == "far" else m.end()
        if end > m.start():
            out.append((m.start(), end, "phone" if m.lastgroup == "far" else m.lastgroup))
    for m in _IBAN.finditer(text):
        out.append((m.start(), m.end(), "iban"))
    if ":" in text:
        out += [(m.start(), m.end(), "ip6") for m in _IPV6.finditer(text) if any(len(g) > 2 for g in m[0].split(":"))]
    out += _names(text)
    out.sort(key=lambda x: (x[0], -x[1], x[2]))
    kept: list[tuple[int, int, str]] = []
    for x in out:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def _groups(address: str) -> list[str]:
    """The eight groups of an IPv6 address, without leading zeros."""
    head, _, tail = address.partition("::")
    left, right = ([g for g in side.split(":") if g] for side in (head, tail))
    return [g.lstrip("0").lower() or "0" for g in left + ["0"] * (8 - len(left) - len(right)) + right]


def _small(text: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def plain(kind: str, value: str) -> str:
    """The form that all spellings of one entity share."""
    if kind == "phone":
        digits = re.sub(r"\D", "", value.replace("(0)", "") if value.startswith("+") else value)
        return "+" + digits if value.startswith("+") else digits
    if kind in ("card", "iban"):
        return "".join(c for c in value if c.isalnum())
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "ip6":
        return ":".join(_groups(value))
    return value if kind == "ssn" else _small(value)


def _role(kind: str, word: str, last: bool) -> str:
    if kind.startswith("name-") and last:
        return "family"
    gender = kind.split("-")[1]
    return f"given-{gender}" if gender != "n" else "given-" + _GIVEN.get(word.capitalize(), "name-n")[5:]


def pieces_of(kind: str, value: str) -> list[tuple[str, str | None]]:
    """(text, kind of the entity or None) that a found value is made of: the words of a name, given ones with the gender; else itself."""
    if not kind.startswith(("name-", "alone-")):
        return [(value, kind)]
    parts = re.split(r"(\s+)", value)
    words = [k for k, w in enumerate(parts) if w and not w.isspace() and w not in PARTICLES] or [len(parts) - 1]
    return [(w, _role(kind, w, k == words[-1]) if k in words else None) for k, w in enumerate(parts)]


def parts_of(kind: str, value: str) -> list[tuple[str, str]]:
    """The entities of a found value, as kind and plain form."""
    return [(k, plain(k, v)) for v, k in pieces_of(kind, value) if k]


class _Draw:
    """A stream of numbers keyed by kind, value and attempt."""

    def __init__(self, key: str, kind: str, value: str, attempt: int):
        self.key, self.turn, self.pool = key.encode()[:64], 0, b""
        self.seed = hashlib.blake2b(f"{kind}\x00{attempt}\x00{value}".encode("utf-8", "surrogatepass"), key=self.key).digest()

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hashlib.blake2b(self.seed + self.turn.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.turn += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n


@lru_cache(maxsize=100_000)
def _same_script(c: str) -> str:
    """The characters near c of its category and script, Latin letters if it is alone."""
    script = lambda x: unicodedata.name(x, "").split(" ")[0].split("-")[0]
    start = ord(c) & ~63
    near = [x for x in map(chr, range(start, start + 64)) if x.isalnum() and unicodedata.category(x) == unicodedata.category(c) and script(x) == script(c)]
    return "".join(near) if len(near) > 1 else "abcdefghijklmnopqrstuvwxyz"


def _alike(c: str, draw: _Draw) -> str:
    if c.isdigit():
        return str(draw.below(10))
    if "a" <= c <= "z":
        return chr(97 + draw.below(26))
    if "A" <= c <= "Z":
        return chr(65 + draw.below(26))
    if "а" <= c <= "я":
        return chr(0x430 + draw.below(32))
    if "А" <= c <= "Я":
        return chr(0x410 + draw.below(32))
    if c.isalpha() and c.lower() in "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ":
        new = "àáâäçèéêëíîïñóôöùúûü"[draw.below(20)]
        return new.upper() if c.isupper() else new
    if c.isalnum():
        pool = _same_script(c)
        return pool[draw.below(len(pool))]
    return c


def _added(attempt: int) -> int:
    return max(0, attempt + 1 - GROW_AFTER)


def _luhn(digits: list[int]) -> int:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10


def _card(value: str, draw: _Draw) -> str:
    old = [int(c) for c in value]
    new = [old[0]] + [draw.below(10) for _ in old[1:]]
    if _luhn(old) == 0:
        new[-1] = 0
        new[-1] = (10 - _luhn(new)) % 10
    return "".join(map(str, new))


def _name_word(kind: str, word: str, key: str, attempt: int) -> str:
    """A given name of the gender, or a family name of syllables; in other scripts letters of the script.  Each attempt makes it longer."""
    script = "cyrillic" if regex.search(r"\p{Cyrillic}", word) else "latin" if regex.search(r"\p{Latin}", word) else ""
    draw = _Draw(key, f"{kind}-{script}", word, attempt)
    if not script:
        return "".join(_alike(c, draw) for c in word + word[-1] * attempt)
    syllables = lambda n: "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(n))
    if kind == "family":
        new = "-".join(syllables(3 + draw.below(2) + (attempt if k == 0 else 0)) for k in range(len(word.split("-"))))
    else:
        gender = kind[6:]
        pool = NAMES[script, gender] if gender != "n" else NAMES[script, "m"] + NAMES[script, "f"]
        new = pool[draw.below(len(pool))].lower() + syllables(attempt)
    return new


def _country(digits: str) -> int:
    return next((n for n, codes in CODES.items() if digits[:n] in codes), 3)


def drawn_for(kind: str, value: str, key: str, attempt: int = 0) -> str:
    """The surrogate, in plain form, of an entity in plain form."""
    draw = _Draw(key, kind, value, attempt)
    if kind == "email":
        local, host = value.rsplit("@", 1)
        labels = host.split(".")
        domain = _Draw(key, "domain", host, 0)
        last = next((c for c in reversed(local) if c.isalpha()), "a")
        return "".join(_alike(c, draw) for c in local + last * _added(attempt)) + "@" + ".".join(["".join(_alike(c, domain) for c in x) for x in labels[:-1]] + labels[-1:])
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "card":
        return _card(value, draw)
    if kind == "family" or kind.startswith("given-"):
        return _name_word(kind, value, key, attempt)
    if kind == "ip6":
        return "".join(f"{draw.below(15) + 1:x}" if c.isalnum() and group != "0" else c for group in re.split("(:)", value) for c in group)
    keep = 0
    if kind == "phone":
        keep = 1 + _country(value[1:]) if value[0] == "+" else int(value[0] == "0")
        value += "0" * _added(attempt)
    elif kind == "iban":
        keep = 2
    return value[:keep] + "".join(_alike(c, draw) for c in value[keep:])


def _like(new: str, old: str) -> str:
    """new with the capitals of old, place by place."""
    return "".join(c.upper() if k < len(old) and old[k].isupper() and len(c.upper()) == 1 else c for k, c in enumerate(new))


def dressed(kind: str, value: str, new: str) -> str:
    """A surrogate in plain form, spelled as the value is."""
    if kind == "email":
        (local, host), (mine, domain) = value.rsplit("@", 1), new.rsplit("@", 1)
        return _like(mine, local) + "@" + _like(domain, host)
    if kind == "family" or kind.startswith("given-"):
        if value == _small(value):
            return new
        return new.upper() if len(value) > 1 and value.isupper() else "-".join(x.capitalize() for x in new.split("-"))
    if kind == "ip6":
        head, gap, tail = value.partition("::")
        groups = new.split(":")
        sides = [(head.split(":") if head else [], 0), (tail.split(":") if tail else [], 8 - len(tail.split(":")))]
        out = [":".join(_like(groups[first + k].rjust(len(g), "0"), "F" * len(g) if g.upper() == g else "") for k, g in enumerate(side)) for side, first in sides]
        return out[0] + gap + out[1]
    if kind in ("phone", "card", "iban"):
        fill, out = iter(new.lstrip("+")), []
        for piece in re.split(r"(\(0\))", value) if value.startswith("+") else [value]:
            out.append(piece if piece == "(0)" else "".join(next(fill) if c.isalnum() else c for c in piece))
        return "".join([*out, *fill])
    return new


def surrogate(kind: str, value: str, key: str, attempt: int = 0) -> str:
    """The surrogate of one entity (a whole email or number, one word of a name), spelled as the value is."""
    return dressed(kind, value, drawn_for(kind, plain(kind, value), key, attempt))


def _rewrite(text: str, attempt_of: Callable[[str, str], int], key: str) -> tuple[str, list[dict]]:
    parts, found, at, size = [], [], 0, 0
    for s, e, kind in find(text):
        new = "".join(surrogate(k, v, key, attempt_of(k, plain(k, v))) if k else v for v, k in pieces_of(kind, text[s:e]))
        parts += [text[at:s], new]
        size += s - at
        found.append({"kind": kind.split("-")[0].replace("alone", "name"), "start": size, "n_chars": len(new)})
        size += len(new)
        at = e
    return "".join([*parts, text[at:]]), found


def replace(text: str, attempts: dict[tuple[str, str], int], key: str) -> tuple[str, list[dict]]:
    """The text with surrogates, and where they stand; attempts: (kind, value) of entities that are drawn again."""
    known = {(k, plain(k, v)): n for (k, v), n in attempts.items()}
    return _rewrite(text, lambda k, v: known.get((k, v), 0), key)


def _entities(text: str) -> set[tuple[str, str]]:
    return {x for s, e, kind in find(text) for x in parts_of(kind, text[s:e])}


def _id(key: str, kind: str, value: str) -> bytes:
    """A keyed digest of an entity; given names of one spelling have one, whatever their gender."""
    return hashlib.blake2b(f"{kind.split('-')[0]}\x00{value}".encode("utf-8", "surrogatepass"), key=key.encode()[:64], person=b"entity", digest_size=16).digest()


def _sealed(key: str, nonce: bytes, data: bytes) -> bytes:
    """data under a stream that only the key gives; the same call opens it."""
    blocks = (hashlib.blake2b(nonce + k.to_bytes(4, "big"), key=key.encode()[:64], person=b"seal").digest() for k in range(len(data) // 64 + 1))
    return bytes(a ^ b for a, b in zip(data, b"".join(blocks), strict=False))


ENTRY = "kind string, id binary, sealed binary, attempt int"


def _list(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({x for t in batch.column("text").to_pylist() if t for x in _entities(t)})
            ids = [_id(key, k, v) for k, v in rows]
            sealed = [_sealed(key, i, v.encode("utf-8", "surrogatepass")) for i, (_, v) in zip(ids, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array(ids, pa.binary()), pa.array(sealed, pa.binary())], names=["kind", "id", "sealed"])

    return run


def _draw_all(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("kind", "id", "sealed", "attempt")), strict=True)
            marks = [_id(key, k, drawn_for(k, _sealed(key, i, v).decode("utf-8", "surrogatepass"), key, a)) for k, i, v, a in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("kind", "id", "sealed", "attempt")), pa.array(marks, pa.binary())], names=["kind", "id", "sealed", "attempt", "mark"])

    return run


def redrawn(docs: DataFrame, key: str) -> DataFrame:
    """kind, id, attempt of the entities whose first surrogate collides; the others stay at attempt 0.  A stored table of digests."""
    held: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        held.append(stored(df, name))
        return held[-1]

    try:
        entities = keep(docs.select("text").mapInArrow(_list(key), "kind string, id binary, sealed binary").distinct().withColumn("attempt", F.lit(0)), "entities")
        for _ in range(MAX_ROUNDS):
            drawn = keep(entities.mapInArrow(_draw_all(key), ENTRY + ", mark binary"), "drawn")
            shared = drawn.groupBy("mark").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "id")).alias("first")).where("n > 1")
            twins = drawn.join(shared, "mark").where(F.col("id") != F.col("first.id")).select("kind", "id")
            taken = drawn.join(drawn.select(F.col("id").alias("mark")).distinct(), "mark").select("kind", "id")
            clash = keep(twins.unionByName(taken).distinct(), "clashes")
            left = [(r["kind"], r["n"]) for r in clash.groupBy("kind").agg(F.count("*").alias("n")).collect()]
            if not left:
                return stored(entities.where("attempt > 0").select("kind", "id", "attempt"), "redrawn")
            before = list(held)
            again = entities.join(clash.withColumn("again", F.lit(1)), ["kind", "id"], "left")
            entities = keep(again.select("kind", "id", "sealed", (F.col("attempt") + F.coalesce("again", F.lit(0))).cast("int").alias("attempt")), "entities")
            dropped(*before)
            held[:] = [entities]
        raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} rounds: {left}")
    finally:
        dropped(*held)


ENTITY = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("n_chars", pa.int64())])


def _replace(attempts_bc, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            own = batch.column("redrawn").to_pylist() if "redrawn" in names else None
            texts, found = [], []
            for r, t in enumerate(batch.column("text").to_pylist()):
                attempts = attempts_bc.value if own is None else {(x["kind"], bytes(x["id"])): x["attempt"] for x in own[r] or ()}
                new, spans = _rewrite(t, lambda k, v, known=attempts: known.get((k, _id(key, k, v)), 0) if known else 0, key) if t else (t, [])
                texts.append(new)
                found.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(ENTITY))], names=["doc_id", "text", "n_entities", "entities"])

    return run


def _held(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, r, k, _id(key, k, v)) for d, r, t in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "text")), strict=True) if t for k, v in _entities(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["doc", "row", "kind", "id"])

    return run


def pseudonymize(docs: DataFrame, key: str, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, text (with surrogates), n_entities, entities (kind, start, n_chars in the new text); a row for each row of docs."""
    if not key:
        raise ValueError("a key is needed")
    again = redrawn(docs, key)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    few = again.limit(max_broadcast + 1).collect()
    context = docs.sparkSession.sparkContext
    if len(few) > max_broadcast:
        keyed = rows.withColumns({"doc": F.coalesce("doc_id", F.lit(-(2**63))), "row": text_key(F.col("text"))})
        held = keyed.select("doc", "row", "text").mapInArrow(_held(key), "doc long, row long, kind string, id binary").join(again, ["kind", "id"])
        held = held.groupBy("doc", "row").agg(F.collect_set(F.struct("kind", "id", "attempt")).alias("redrawn"))
        rows, attempts = keyed.join(held, ["doc", "row"], "left").select("doc_id", "text", "redrawn"), {}
    else:
        attempts = {(r["kind"], bytes(r["id"])): r["attempt"] for r in few}
        dropped(again)
    return rows.mapInArrow(_replace(context.broadcast(attempts), key), "doc_id long, text string, n_entities long, entities array<struct<kind:string,start:long,n_chars:long>>")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, DEMO_KEY))
