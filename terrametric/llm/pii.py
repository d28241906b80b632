"""Personal data replaced by keyed surrogates that keep type, gender, script and format.

Detected entities are reduced to a canonical form, so that one phone number in
two notations, or a surname with and without a title, is one entity. Each
distinct entity of the corpus gets a surrogate of the same shape, derived from
a secret key; each mention is then written in its own notation. Equal entities
therefore have equal surrogates in all documents (coreference).

Collision checks preserve distinctness: a candidate is refused if it is an
original somewhere in the corpus, if it is taken, or if another entity has the
same candidate and a smaller original; those refused derive another one in the
next round, until all are settled. Rounds are joins and aggregations over
distinct entities; nothing about single entities reaches the driver.

Names are split into first names and surnames. A title, a listed first name or
a phrase such as "my name is" starts a name; its surname and first name are
then replaced wherever else they stand in that document. Surrogate names are
built from syllables with an ending that suits the gender, which first names,
titles and the endings of Slavic and Greek surnames tell, in the script of the
original; in scripts without syllables here, from its letters. Capitalised
words without such a sign are no names: headings and places are left alone, as
are runs of hexadecimal digits without a word that says they are secret.

A shape of which all candidates are taken grows longer, digit by digit.

Defined results: null text stays null; texts without entities stay as they are;
rows that share id and text are treated alike; a null id is a value of its own;
an empty table gives an empty result; other columns are carried along, but for
one named like a result column. Where kinds overlap, the one listed first in KINDS wins.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import itertools
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carried, ready_workers

#: Titles by the gender they tell.
TITLES = {"m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mademoiselle", "Госпожа"), "n": ("Dr", "Prof", "Professor")}
#: Frequent first names by gender, which start a name without a title.
FIRST_NAMES = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Steven Andrew Peter Hans Klaus Jürgen Wolfgang Stefan Pierre Jean Jacques François Philippe José Juan Carlos Miguel Javier Иван Алексей Сергей Дмитрий Николай".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Sandra Emily Laura Anna Petra Ursula Monika Sabine Heike Marie Nathalie Isabelle Sophie Catherine María Carmen Ana Lucía Elena Мария Анна Елена Ольга Наталья".split(),
}
_SYLLABLES = {
    "latin": ("ba be bi bo bra da de di do dre fa fe fi ga ge go gra ha he ho ja jo ka ke ki kla la le li lo ma me mi mo na ne ni no pa pe pi ra re ri ro sa se si so sta ta te ti to tra va ve vi wa we wi za".split(), {"m": ("n", "r", "s", "k", "rd", "ld"), "f": ("a", "ia", "na", "ella", "ine"), "n": ("n", "l", "r"), "last": ("son", "ley", "man", "ner", "sen", "ton", "berg")}),
    "greek": ("βα βε γα γι δα δη ζα θε κα κο λα λε μα μι να νι πα πε ρα ρο σα σι τα τε φα χα".split(), {"m": ("ς", "ης", "ος"), "f": ("α", "η", "ία"), "n": ("ν", "ς"), "last-m": ("όπουλος", "ίδης", "άκης"), "last-f": ("οπούλου", "ίδου", "άκη"), "last": ("όπουλος", "ίδης", "άκης")}),
    "cyrillic": ("ба бе ви во га да де жа за зи ка ки ко ла ле ли ма ме ми на не ни но па пе ра ре ри ро са се си та те ти то фа фе ха".split(), {"m": ("н", "р", "с", "й"), "f": ("на", "ия", "ла"), "n": ("н", "л"), "last-m": ("ов", "ев", "ин", "ский"), "last-f": ("ова", "ева", "ина", "ская"), "last": ("енко", "ук", "ян")}),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX, _IP = "[0-9A-Fa-f]{1,4}", rf"(?:{_OCTET}\.){{3}}{_OCTET}"
#: Eight groups, or up to seven around one "::"; the last two may be a dotted address.
_IPV6 = "|".join(
    [rf"(?:{_HEX}:){{6}}{_IP}", rf"(?:{_HEX}:){{7}}{_HEX}"]
    + [rf"{f'{_HEX}(?::{_HEX}){{{n - 1}}}' if n else ''}::(?:{_HEX}:){{0,{5 - n}}}{_IP}" for n in range(6)]
    + [rf"{f'{_HEX}(?::{_HEX}){{{n - 1}}}' if n else ''}::(?:{_HEX}(?::{_HEX}){{0,{6 - n}}})?" for n in range(7)]
    + [rf"{_HEX}(?::{_HEX}){{6}}::"]
)
_NAME = r"[^\W\d_][\w'’-]+"
_ALL_TITLES = sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)
_ALL_FIRST = sorted((x for xs in FIRST_NAMES.values() for x in xs), key=len, reverse=True)
_GENDER = {t: g for g, ts in [*TITLES.items(), *FIRST_NAMES.items()] for t in ts}

#: What is found, in order of precedence. A group named v is the part that is replaced.
KINDS: dict[str, re.Pattern] = {
    "email": re.compile(r"[\w.%+-]*\w@\w[\w-]*(?:\.\w[\w-]*)*\.[^\W\d_]{2,}"),
    "secret": re.compile(r"""(?i:\b(?:token|api[_-]?key|secret|passw(?:or)?d|pwd|access[_-]?key)\b)["']?\s*[:=]\s*["']?(?P<v>[^\s"'<>,;]{6,})|(?P<v2>\bAKIA[0-9A-Z]{16}\b)"""),
    # Without a digit a compressed form may as well be a name in code, such as a::b.
    "ipv6": re.compile(rf"(?<![\w:.])(?:(?=[0-9A-Fa-f:]*[0-9])(?:{_IPV6})|(?:{_HEX}:){{7}}{_HEX})(?![\w:]|\.\d)", re.ASCII),
    "ip": re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "card": re.compile(r"(?<![\d.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d|[.-]\d)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "phone": re.compile(r"(?<![\w+(])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+.-])(?:\+?1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)"),
}
#: Phrases after which a person is named.
_CALLED = r"(?:[Mm]y name is|[Nn]ame\s*[:=]|[Dd]ear|[Ss]igned(?: by)?:?|[Ss]incerely,?|[Rr]egards,?|[Aa]ttn:?|[Cc]ontact:|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Мм]еня зовут|[Νν]α σας συστηθώ:?)"
_PERSON = re.compile(rf"\b(?:(?P<title>{'|'.join(_ALL_TITLES)})\.?[ ](?P<rest>{_NAME}(?:[ ]{_NAME}){{0,2}})|(?P<first>{'|'.join(_ALL_FIRST)})[ ](?P<last>{_NAME})|{_CALLED}\s+(?P<called>{_NAME}(?:[ ]{_NAME}){{1,2}}))")
#: Endings of surnames that tell the gender, by script.
_SURNAMES = {"cyrillic": {"f": ("ова", "ева", "ёва", "ина", "ына", "ская", "цкая", "ая"), "m": ("ов", "ев", "ёв", "ин", "ын", "ский", "цкий", "ой", "ий")}, "greek": {"f": ("ου",), "m": ("ος", "ης", "ας")}}
#: What every text holds that has a mention of the kind: a cheap test before the pattern.
_TWO_DIGITS = re.compile(r"\d\d").search
_NEEDS = {"email": lambda t: "@" in t, "ipv6": lambda t: "::" in t or t.count(":") > 5, "ip": re.compile(r"\d\.\d").search, "iban": _TWO_DIGITS, "card": _TWO_DIGITS, "ssn": _TWO_DIGITS, "phone": _TWO_DIGITS}


@dataclass(frozen=True)
class Mention:
    kind: str
    canonical: str
    start: int
    end: int


def _script(s: str) -> str:
    """The script of the first letter, as its Unicode name tells it; one word in lower case."""
    name = unicodedata.name(s[0], "LATIN").partition(" ")[0].partition("-")[0].lower()
    return "latin" if name in ("digit", "fullwidth") else name


def _named(word: str) -> bool:
    """Whether a word can be a name: it begins with a capital, or in a script that has none is short."""
    return word[0].isupper() or word[0].isalpha() and word[0].lower() == word[0].upper() and len(word) <= 4


def _surname(word: str) -> str:
    """The kind of a surname: its script, and its gender where the ending tells it."""
    script = _script(word)
    for gender, endings in _SURNAMES.get(script, {}).items():
        if word.lower().endswith(endings):
            return f"last-{gender}-{script}"
    return f"last-{script}"


def canonical(kind: str, s: str) -> str:
    """Equal for notations of one entity."""
    if kind == "phone":
        digits = re.sub(r"\D", "", s)
        return digits[-10:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", s)
    if kind == "iban":
        return s.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(s).packed.hex(":", 2)
    return s if kind == "secret" else s.lower()


def _people(text: str) -> Iterator[Mention]:
    parts: dict[str, str] = {}  # the spelling of a name's part -> its kind
    for m in _PERSON.finditer(text):
        if m["title"]:
            words = [w for w in m["rest"].split(" ")]
            names = words[: next((i for i, w in enumerate(words) if not _named(w)), len(words))]
            if not names:
                continue
            gender = _GENDER[m["title"]]
            for first in names[:-1]:
                parts.setdefault(first, f"first-{_GENDER.get(first, gender)}-{_script(first)}")
            parts.setdefault(names[-1], _surname(names[-1]))
        elif m["called"]:
            words = m["called"].split(" ")
            names = words[: next((i for i, w in enumerate(words) if not _named(w)), len(words))]
            if len(names) > 1:
                for first in names[:-1]:
                    parts.setdefault(first, f"first-{_GENDER.get(first, 'n')}-{_script(first)}")
                parts.setdefault(names[-1], _surname(names[-1]))
        elif m["last"][0].isupper():
            parts.setdefault(m["first"], f"first-{_GENDER[m['first']]}-{_script(m['first'])}")
            parts.setdefault(m["last"], _surname(m["last"]))
    if parts:
        for m in re.finditer(rf"\b(?:{'|'.join(sorted(map(re.escape, parts), key=len, reverse=True))})\b", text):
            yield Mention(parts[m.group()], m.group().lower(), m.start(), m.end())


def mentions(text: str | None) -> list[Mention]:
    """What is found in a text, in order, without overlaps."""
    if not text:
        return []
    found: list[Mention] = []
    for kind, pattern in KINDS.items():
        if kind in _NEEDS and not _NEEDS[kind](text):
            continue
        for m in pattern.finditer(text):
            a, b = next(m.span(g) for g in ("v", "v2") if m[g]) if kind == "secret" else m.span()
            found.append(Mention(kind, canonical(kind, text[a:b]), a, b))
    found += _people(text)
    rank = {k: i for i, k in enumerate(KINDS)}
    out: list[Mention] = []  # by place, without overlaps
    for m in sorted(found, key=lambda m: (rank.get(m.kind, len(rank)), m.start)):
        i = bisect(out, m.start, key=lambda x: x.start)
        if (i == 0 or out[i - 1].end <= m.start) and (i == len(out) or m.end <= out[i].start):
            out.insert(i, m)
    return out


class _Stream:
    """Numbers derived from the key, the entity and the round."""

    def __init__(self, key: bytes, *parts: object):
        self.seed, self.n = hashlib.blake2b("\0".join(map(str, parts)).encode(), key=key[:64], digest_size=32).digest(), 0

    def below(self, n: int) -> int:
        self.n += 1
        return int.from_bytes(hashlib.blake2b(self.n.to_bytes(4, "big"), key=self.seed, digest_size=8).digest(), "big") % n

    def pick(self, s):
        return s[self.below(len(s))]


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits))) % 10


def _iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


@functools.cache
def _block(start: int, category: str) -> str:
    return "".join(c for c in map(chr, range(start, start + 128)) if unicodedata.category(c) == category and unicodedata.name(c, "") and c.lower() == c)


def _letters(c: str) -> str:
    """Letters of a letter's script: of its block of 128 characters, or the usual ones."""
    known = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}.get(_script(c))
    return known or _block(ord(c) // 128 * 128, unicodedata.category(c)) or c


def _alike(s: str, draw: _Stream) -> str:
    """Letters for letters of the same case and digits for digits; all else stays."""
    out = []
    hexadecimal = not s.isdigit() and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) is not None
    for c in s:
        if hexadecimal:
            x = draw.pick("0123456789abcdef")
            out.append(x.upper() if s.upper() == s else x)
        elif c.isdigit():
            out.append(draw.pick("0123456789"))
        elif c.isalpha():
            x = draw.pick(_letters(c.lower()))
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


#: Attempts after which a shape counts as full and candidates grow longer.
FULL = 24


def surrogate(kind: str, original: str, key: bytes, attempt: int) -> str:
    """A candidate in canonical form, of the original's shape; from the attempt FULL on of a longer shape.

    A longer shape has a letter or digit more at each further attempt, so that
    there is always one that is free. Addresses, which cannot be longer, are
    then drawn from those that no network has, with as many figures more.
    """
    candidate = _shaped(kind, original, key, attempt)
    if attempt < FULL:
        return candidate
    draw, n = _Stream(key, "longer", kind, original, attempt), attempt - FULL + 1
    if kind == "email":
        return "".join(draw.pick("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) + candidate
    if kind == "ip":
        return f"0.{draw.below(256)}.{draw.below(256)}.{draw.below(256)}" + "".join(str(draw.below(10)) for _ in range(n))
    if kind == "ipv6":
        return "0000" + candidate[4:] + "".join(draw.pick("0123456789abcdef") for _ in range(n))
    if kind.startswith(("first", "last")):
        return "".join(draw.pick(_letters(candidate[0])) for _ in range(n)) + candidate
    return candidate + "".join(str(draw.below(10)) for _ in range(n))


def _shaped(kind: str, original: str, key: bytes, attempt: int) -> str:
    draw = _Stream(key, kind, original, attempt)
    if kind == "email":
        local, _, domain = original.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_alike(local, draw)}@{_alike(host, draw)}.{top}"
    if kind == "ip":
        least, most = {1: 1, 2: 11, 3: 100}, {1: 9, 2: 99, 3: 223}
        lengths = [len(o) if attempt <= 8 else 3 for o in original.split(".")]  # few addresses have short octets only
        octets = [str(least[n] + draw.below(most[n] - least[n] + 1)) for n in lengths]
        return ".".join(["128" if octets[0] == "127" else octets[0], *octets[1:]])
    if kind == "ipv6":
        # Groups of zeros stay, and others as long as they are, until candidates run out.
        lengths = [len(g.lstrip("0")) for g in original.split(":")]
        if attempt > 3:
            lengths = [4 if n else 0 for n in lengths[:-1]] + [4]
        if attempt > 8:
            lengths[0] = 4
        groups = [draw.pick("123456789abcdef") + "".join(draw.pick("0123456789abcdef") for _ in range(n - 1)) if n else "" for n in lengths]
        return ":".join(g.zfill(4) for g in groups)
    if kind == "card":
        body = draw.pick("3456") + _alike(original[1:-1], draw)
        check = next(d for d in "0123456789" if _luhn(body + d) == _luhn(original))  # as valid as the original
        return body + check
    if kind == "phone":
        if len(original) == 10:
            exchange = "555" if original[3:6] == "555" else draw.pick("23456789") + _alike(original[4:6], draw)
            return draw.pick("23456789") + _alike(original[1:3], draw) + exchange + _alike(original[6:], draw)
        return original[:2] + _alike(original[2:], draw)  # the country stays
    if kind == "iban":
        body = _alike(original[4:], draw)
        if _iban_rest(original) != 1:
            return original[:2] + _alike(original[2:4], draw) + body
        return f"{original[:2]}{98 - _iban_rest(original[:2] + '00' + body):02d}{body}"  # valid as the original is
    if kind.startswith(("first", "last")):
        *role, script = kind.split("-")
        if script not in _SYLLABLES:  # letters of the same script, one more after some attempts
            return _alike(original + original[-1] * (attempt > 3), draw)
        syllables, endings = _SYLLABLES[script]
        own = "-".join(role) if role[0] == "last" else role[1]
        own = own if own in endings else "last"
        return "".join(draw.pick(syllables) for _ in range(2 + draw.below(2) + (attempt > 3))) + draw.pick(endings[own])
    return _alike(original, draw)


def _written_ipv6(mention: str, new: str) -> str:
    """Groups as wide as the mention's, "::" and a dotted end where it has them, if the surrogate can be written so."""
    head, dots, tail = mention.partition("::")
    split = lambda s: [w for g in s.split(":") if g for w in ([0, 0] if "." in g else [len(g)])]
    left, right, groups = split(head), split(tail), new.split(":")
    zeros = 8 - len(left) - len(right)
    if any(g != "0000" for g in groups[len(left) : len(left) + zeros]):
        return ipaddress.IPv6Address(new).compressed
    widths = [*left, *[0] * zeros, *right]
    words = [(g.lstrip("0") or "0").zfill(w) for g, w in zip(groups, widths, strict=True)]
    if "." in mention:
        words[6:] = [".".join(str(b) for b in bytes.fromhex(groups[6] + groups[7]))]
    out = ":".join(words[: len(left)]) + "::" + ":".join(words[len(left) + zeros :]) if dots else ":".join(words)
    return out.upper() if mention.upper() == mention and re.search("[A-F]", mention) else out


def written(kind: str, mention: str, new: str) -> str:
    """The surrogate in the notation of a mention."""
    if kind == "ipv6":
        return _written_ipv6(mention, new) if len(new) == 39 else new  # a longer shape is written as it is
    if kind.startswith(("first", "last")):
        return new.upper() if mention.isupper() and len(mention) > 1 else new.capitalize()
    if kind == "phone" and (digits := re.sub(r"\D", "", mention)) and len(digits) == len(new) + 1:
        new = digits[0] + new
    marks = iter(c for c in new if c.isalnum())
    if sum(c.isalnum() for c in mention) != sum(c.isalnum() for c in new):
        return new
    out = [next(marks) if c.isalnum() else c for c in mention]
    return "".join(x.upper() if c.isupper() and kind == "email" else x for x, c in zip(out, mention, strict=True))


def replaced(text: str, new: dict[tuple[str, str], str]) -> tuple[str, list[tuple[str, int, int, int]]]:
    """The text with surrogates, and per mention its kind, place, length and new length."""
    out, at, spans = [], 0, []
    for m in mentions(text):
        s = written(m.kind, text[m.start : m.end], new[m.kind, m.canonical])
        out += [text[at : m.start], s]
        spans.append((m.kind, m.start, m.end - m.start, len(s)))
        at = m.end
    return "".join([*out, text[at:]]), spans


def settled(entities: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, canonical, surrogate) for distinct (kind, canonical): no surrogate twice, none that is an original.

    All kinds of names are one space: the surrogate of a first name is no one's
    surname either. Rounds end, as shapes grow once they are full.
    """
    space = F.when(F.col("kind").startswith("first") | F.col("kind").startswith("last"), F.lit("name")).otherwise(F.col("kind")).alias("space")

    @F.pandas_udf("string")
    def candidate(kind: pd.Series, original: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, o, key, a) for k, o, a in zip(kind, original, attempt, strict=True)], dtype=object)

    originals = entities.select(space, F.col("canonical").alias("surrogate")).distinct()
    done, todo = None, entities
    for k in itertools.count():
        drawn = scratch.save(todo.select("kind", "canonical", candidate("kind", "canonical", F.lit(k)).alias("surrogate")).withColumn("space", space), f"drawn-{k}")
        free = drawn.join(originals, ["space", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        won = free.groupBy("space", "surrogate").agg(F.min(F.struct("canonical", "kind")).alias("w"))
        won = scratch.save(won.select("space", "surrogate", "w.canonical", "w.kind"), f"won-{k}")
        done = won if done is None else done.unionByName(won)
        todo = scratch.save(drawn.select("kind", "canonical").join(won, ["kind", "canonical"], "left_anti"), f"left-{k}")
        if todo.isEmpty():
            return done.select("kind", "canonical", "surrogate")


def with_surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The input rows with surrogates in their texts, and `spans` of what was replaced.

    A span has the kind, start and length in the original text, and the new length.
    """
    spark = docs.sparkSession
    ready_workers(spark)
    scratch = scratch or Scratch(spark, "pii")
    keyed = docs.select(carried(docs, "spans"), F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("text_hash"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in enumerate(b.column(2)):
                rows += [(i, k, c) for k, c in sorted({(m.kind, m.canonical) for m in mentions(text.as_py())})]
            at, kinds, canonicals = zip(*rows, strict=True) if rows else ([], [], [])
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(kinds, pa.string()), pa.array(canonicals, pa.string())], ["id", "text_hash", "kind", "canonical"])

    found = scratch.save(keyed.select("id", "text_hash", F.col("row")[text_col].alias("text")).mapInArrow(find, "id string, text_hash long, kind string, canonical string"), "mentions")
    new = settled(found.groupBy("kind", "canonical").agg(F.count("*").alias("n")).drop("n"), key, scratch)
    # A document's surrogates; copies of a row add the same ones again.
    own = found.join(new, ["kind", "canonical"]).groupBy("id", "text_hash").agg(F.collect_set(F.struct("kind", "canonical", "surrogate")).alias("new"))

    @F.pandas_udf("struct<text string, spans array<struct<kind string, start int, length int, new_length int>>>")
    def write(text: pd.Series, new: pd.Series) -> pd.DataFrame:
        done = [replaced(t, {(x["kind"], x["canonical"]): x["surrogate"] for x in n}) if n is not None else (None, []) for t, n in zip(text, new, strict=True)]
        names = ("kind", "start", "length", "new_length")
        return pd.DataFrame({"text": [t for t, _ in done], "spans": [[dict(zip(names, s, strict=True)) for s in spans] for _, spans in done]})

    own = own.withColumnsRenamed({"id": "own_id", "text_hash": "own_hash"})
    joined = keyed.join(own, keyed["id"].eqNullSafe(own["own_id"]) & (keyed["text_hash"] == own["own_hash"]), "left").select("row", "new")
    text = F.col("row")[text_col]
    done = joined.withColumn("done", write(F.when(F.col("new").isNotNull(), text), F.col("new")))
    return done.select(F.col("row").withField(text_col, F.when(F.col("new").isNotNull(), F.col("done.text")).otherwise(text)).alias("row"), "done.spans").select("row.*", "spans")
