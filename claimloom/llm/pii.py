"""Surrogates for personal data: keyed, of the same type, gender, script and format.

E-mail and IP addresses, phone, card, account and social security numbers, secrets (key
blocks and web tokens among them) and names are found by pattern.  Each gets a surrogate
that depends on the key and its canonical form only, so mentions of one entity stay
mentions of one entity throughout the corpus.  Numbers, addresses and secrets pass through
a keyed permutation of all strings of their format (a Feistel network over mixed digits and
letters), which keeps different entities different; check digits are made anew.  A secret
whose format has next to no room, such as a row of stars, becomes a keyed token of its
length.  Names are drawn from lists of the same script and gender.

A person is known by a title or several (``Mr John Smith``, ``HERR DR. KARL WEBER``, ``mrs Anna
Berg``), with any blank and at most one line end between the words; a capitalised word after
a line end ends a name of one word only if the text has it nowhere in small letters.  Small
particles (``van der``) and initials stay.  Within that text every capitalised mention of a
word of the name is replaced, with a title or without; in all other texts of the corpus the
whole name is, and with it the text's further mentions of its words.  A single word after a
title is the given name of a person of that text, if it is one's, else a family name.  Where
titles of one whole name disagree on the gender, ``m`` goes before ``f``; without any, the
given name decides (lists, then its last letter).  Scripts without case have no capitals to
go by: a Han, kana or Hangul name is the run of up to four letters after the title, the first
three of a longer run, and one in another such script its next two words; it is replaced in
the texts that title it.

A phone number has a plus, brackets or a word such as ``tel`` before it, or the full form of
a national number (415-555-0123, 06 12 34 56 78, 0171 1234567); dates, years and grouped
numbers are none.  Digits in groups are a card only if the check digit is right.

Surrogate names come from pools by script and gender, put together from the parts of real
names by rule; where a pool is used up, double and triple names follow.

Collisions are checked over the whole corpus: entities whose surrogates meet, or whose
surrogate is another entity's original, are drawn again until none is left; secrets get
longer when their format is full.  Where a format of fixed length is full, so that drawing
again frees nothing, ``settle`` raises an error.

Defined cases: a null text stays null and has no entity; an empty text stays empty; texts
of any length are read whole, in time in proportion to their length; repeated rows are each
answered alike, and an id of any type, or null, like any other; overlapping finds go to the leftmost; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, sized, sliced, write_table

_LETTER = "abcdefghijklmnopqrstuvwxyz"
#: Titles, and the gender they tell.
_TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "", "Prof": "", "г-н": "m", "г-жа": "f"}
#: Words inside a name that stay.
_PARTICLES = frozenset("von van der den de la le du di da del dos das al el bin ibn y e zu zum ten ter".split())
#: Parts of given names by script and gender (whole ones; first parts; second parts).
_GIVEN_PARTS = {
    ("LATIN", "f"): ("Alma Berta Clara Diana Elena Flora Greta Helga Irene Julia Karin Laura Maria Nadia Olga Paula Rosa Sofia Tilda Vera", "Adel Edel Ger Her Sieg Wal Irm Kuni Brun Diet Gun Lud Mat Ort Ro Rose Wil", "gard gund hild linde traud burg"),
    ("LATIN", "m"): ("Adam Bruno Carlo David Emil Felix Georg Henri Igor Jakob Karl Louis Marco Niels Oscar Pablo Ruben Simon Tomas Victor", "Adal Al Bern Diet Eber Ek Ger Got Gun Hart Hel Her Lud Os Rein Sieg Wal Wil", "bert fried hard mar mund ram rich wald wig win"),
    ("CYRILLIC", "f"): ("Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Раиса Софья Тамара", "Владимир Бронис Мирос Радос Святос Станис Яр", "лава"),
    ("CYRILLIC", "m"): ("Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Сергей", "Вяче Бронис Миро Радо Свято Станис Яро Брати Все Изя Рости Мсти", "слав"),
    ("GREEK", "f"): ("Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα", "", ""),
    ("GREEK", "m"): ("Αντώνης Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Λευτέρης Μιχάλης Νίκος Πέτρος Σπύρος Χρήστος", "", ""),
    ("ARABIC", "f"): ("أمينة إيمان حنان خديجة رانيا سعاد سلمى عائشة فاطمة ليلى مريم نادية", "", ""),
    ("ARABIC", "m"): ("أحمد إبراهيم حسن خالد سمير طارق عمر فيصل كريم محمود ياسر يوسف", "", ""),
}
#: Parts of family names by script (whole ones; first parts; second parts).
_FAMILY_PARTS = {
    "LATIN": (
        "Abel Bauer Costa Duran Engel Falk Garcia Haas Ibarra Jensen Keller Lopez Moreau Nolan Ortiz Perez Quinn Roussel Silva Thomas Ulrich Vidal Weber Young Zeller",
        "Alten Birken Blumen Breiten Buchen Brunn Eichen Falken Frieden Grün Hohen Kalten Kirch Königs Linden Löwen Mühl Neu Ober Reichen Rosen Schön Silber Stein Tannen Unter Weiden Weissen Wester Wolfs",
        "au bach bauer baum berg berger burg dorf feld felder garten hagen hauser heim hof hofer mann stein tal thaler wald weg",
    ),
    "CYRILLIC": ("Азаров Белов Волков Громов Дубов Ершов Зорин Исаев Котов Лапин Морозов Носков Орлов Панин Рябов Соколов Титов Ушаков", "Черно Бело Красно Ново Старо Добро Криво Сухо Мало Долго", "бородов глазов зубов носов руков усов ногов лобов домов хатов"),
    "GREEK": ("Αγγέλου Βλάχος Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Μακρής Νικολάου Παπαδάκης Παππάς Σταύρου Χατζής", "Παπα Χατζη Καρα", "γεωργίου δημητρίου κωνσταντίνου νικολάου θανασίου μιχαήλ"),
    "ARABIC": ("الأحمد البغدادي الحسن الحلبي الخطيب الدمشقي الراشد الزين السعيد الشامي الصالح العمري الفارس القاسم المصري النجار", "", ""),
}
#: First letters of whole names in scripts that write them without blanks, and letters that follow, by gender.
_RUNS = {
    "CJK": ("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎", {"m": "伟强磊军勇杰涛明超刚平辉鹏飞波斌宇浩凯健俊文志国华建龙峰海林", "f": "芳娜敏静丽艳娟霞秀英玲桂兰红梅燕萍雪琳倩婷颖慧洁莉莹蓉月云凤"}),
    "HANGUL": ("김이박최정강조윤장임한오서신권황안송전홍", {"m": "민준서도현우진건호성재영훈석철기용동태규", "f": "지은수연서윤하예나미혜정선희경아유주영숙"}),
    "HIRAGANA": ("あいうかきさしたなはまやわ", {"m": "おきけしたとひまろや", "f": "えかこなのみよりれゆ"}),
    "KATAKANA": ("アイウカキサシタナハマヤワ", {"m": "オキケシタトヒマロヤ", "f": "エカコナノミヨリレユ"}),
}


def _pool(whole: str, first: str, second: str) -> list[str]:
    return list(dict.fromkeys(whole.split() + [a + b for a in first.split() for b in second.split()]))


_GIVEN = {k: _pool(*parts) for k, parts in _GIVEN_PARTS.items()}
_FAMILY = {k: _pool(*parts) for k, parts in _FAMILY_PARTS.items()}
_GENDER = {name.casefold(): g for (_, g), names in _GIVEN.items() for name in names}
#: How a title may be written: as above, in capitals, in small letters (but the verb ``miss``).
_WRITTEN = {form: g for t, g in _TITLES.items() for form in (t, t.upper(), t.lower()) if form != "miss"}
_GAP = r"[^\S\n]{0,8}\n?[^\S\n]{0,8}"
_TITLED = re.compile(r"(?<![^\W\d_])(?P<titles>(?:(?:" + "|".join(sorted(_WRITTEN, key=len, reverse=True)) + r")(?:\.|(?=\s))" + _GAP + r"){1,4})(?=[^\W\d_])")
_BETWEEN = re.compile(r"[-'’]|\.?" + _GAP)
_CUE = r"(?i:(?:tel|phone|mobile|cell|fax|call|telefon|telephone|téléphone|teléfono|móvil|portable|handy|rufnummer|тел|телефон|电话)\b\.?(?:[ ]?(?:no|nr|number|nummer)\b\.?)?[ ]?[:=]?[ ]?)"
_DATE = r"(?:(?:1[5-9]|20)\d\d[-./ ]\d\d?[-./ ]\d\d?|\d\d?[-./ ]\d\d?[-./ ](?:1[5-9]|20)\d\d)(?!\d)"
_FIND = re.compile(
    r"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
    |(?P<secret>(?<=AKIA)[0-9A-Z]{16}\b|(?<=ASIA)[0-9A-Z]{16}\b
       |(?<![A-Za-z0-9])(?:gh[pousr]_|github_pat_|glpat-|npm_|hf_|sk-|[rsp]k_(?:live|test)_|xox[abprs]-|AIza|ya29\.|SG\.)(?P<coded>[A-Za-z0-9_.-]{15,}[A-Za-z0-9_-])
       |\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}
       |(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}(?:[=:]\s{0,3}["']?|(?:is|was|ist|lautet|est|es)\s{1,3}["']?(?=[^\s"'0-9]{0,64}[0-9]))(?P<value>[^\s"']{4,})
       |\b[0-9a-f]{32,128}\b)
    |(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b)
    |(?P<ssn>\b\d{3}-\d{2}-\d{4}\b)
    |(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))
    |(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]{0,38}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\w:]))
    |(?P<card>(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-]))
    |(?P<phone>(?<![\w.+])(?:\+1[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)
        |\+\d{1,3}[ .-]?(?:\(0?\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,5}){1,4}(?!\w|\.\d)
        |\((?!(?:1[5-9]|20)\d\d\))\d{2,5}\)[ .-]?\d{2,4}[ .-]?\d{2,5}(?:[ .-]?\d{1,4})?(?!\w|\.\d)
        |[2-9]\d\d(?P<sep>[.-])[2-9]\d\d(?P=sep)\d{4}(?![\w-]|\.\d)
        |0[1-9](?:[ .]\d\d){4}(?![\w]|[ .]\d)|0[1-9]\d{1,3}[ /-]\d{6,8}(?![\w-]|\.\d)))
    |(?P<cue>(?<![^\W\d_])"""
    + _CUE
    + r"""(?!"""
    + _DATE
    + r""")(?P<told>\(?\d[\d() ./-]{5,18}\d)(?![\w]|\.\d))""",
    re.VERBOSE,
)
_MAY = re.compile(r"[0-9@]|eyJ|(?i:passw|pwd|secret|token|key)")
_BLOCK = re.compile(r"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----\s*(?P<value>[^-]+)-----END \1-----")
_LETTERS = re.compile(r"[^\W\d_]+")
#: A secret of a format with fewer strings than this gets a token instead of another string of that format.
_ROOM = 10_000
_PIECE = 256


def script(word: str) -> str:
    return unicodedata.name(word[0], "LATIN").split(" ")[0]


def find(text: str, people: dict[str, str] | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of each entity, from left to right.

    ``people`` are whole names, case-folded, known from elsewhere, and their genders.  A
    name gives one entity per word, so a family name alone is still the same family name.
    """
    out, titled = _by_pattern(text)
    if not titled and not people:
        return out
    return sorted(out + _names(text, out, titled, people or {}))


def _by_pattern(text: str) -> tuple[list[tuple[int, int, str, str]], list[tuple[int, str, list[str]]]]:
    """(entities but names, titled names as (place, gender, words))."""
    out, titled, at = [], [], 0
    blocks = [(m.start("value"), m.end("value")) for m in _BLOCK.finditer(text)] if "-----BEGIN " in text else []
    out += [(a, b, "secret", text[a:b]) for a, b in blocks]
    for line in text.split("\n"):
        if _MAY.search(line):
            for m in _FIND.finditer(line):
                if any(a < at + m.end() and at + m.start() < b for a, b in blocks):
                    continue
                own = next((g for g in ("value", "coded", "told") if m[g]), 0)
                kind = "phone" if m["cue"] else "secret" if m["secret"] else m.lastgroup
                start, end = m.span(own)
                canon = canonical(kind, line[start:end])
                if kind == "phone" and not 7 <= len(canon) <= 15:
                    continue
                if kind == "card" and len(canon) < end - start and luhn(canon[:-1]) != int(canon[-1]):
                    continue
                out.append((at + start, at + end, kind, canon))
        at += len(line) + 1
    return sorted(out), _titled(text)


def _cased(word: str) -> bool:
    return word.lower() != word.upper()


def _titled(text: str) -> list[tuple[int, str, list[str]]]:
    """(place, gender, words) of the names after titles."""
    out, small = [], None
    for m in _TITLED.finditer(text):
        titles = [t.rstrip(".") for t in re.split(r"\s+|(?<=\.)", m["titles"]) if t]
        gender = next((g for t in titles if (g := _WRITTEN.get(t, ""))), "")
        words: list[str] = []
        loud = titles[-1].isupper() and len(titles[-1]) > 1
        particles, end, broken = 0, m.end(), False
        for w in _LETTERS.finditer(text, m.end()):
            gap = text[end : w.start()]
            if w.start() > m.end() and not (len(gap) < 20 and gap and _BETWEEN.fullmatch(gap) and ("." not in gap or len(last) == 1)):
                break
            end, last, broken = w.end(), w[0], broken or "\n" in gap
            if words and last in _PARTICLES and particles < 3:
                particles += 1
            elif not _cased(last):
                if script(last) in _RUNS:
                    words.append(last if len(last) < 5 else last[:3])
                    break
                words.append(last)
                if len(words) == 2:
                    break
            elif not last[0].isupper() or loud and not (last.isupper()):
                break
            elif broken and words:
                if small is None:
                    small = {x for x in _LETTERS.findall(text) if x[0].islower()}
                if len(words) == 1 and last.casefold() not in small:
                    words.append(last)
                break
            elif len(last) > 1:
                words.append(last)
                if len(words) == (2 if last.isupper() else 3):
                    break
        if words:
            out.append((m.end(), gender, words))
    return out


def _full(words: list[str]) -> str:
    return " ".join(w.casefold() for w in words)


def _names(text: str, taken: list[tuple[int, int, str, str]], titled, people: dict[str, str]) -> list[tuple[int, int, str, str]]:
    """Mentions of the words of all persons that the text names, outside of other entities."""
    words = [w for w in _LETTERS.finditer(text) if w[0][0].isupper()]
    persons: dict[str, str] = {}
    for _, gender, own in titled:
        if len(own) > 1:
            persons[_full(own)] = max(persons.get(_full(own), ""), gender)
    for k in range(len(words)):  # whole names known from elsewhere
        for n in (2, 3):
            if people and k + n <= len(words) and _next_to(text, words[k : k + n]) and (name := _full([w[0] for w in words[k : k + n]])) in people:
                persons[name] = max(persons.get(name, ""), people[name])
    known: dict[str, str] = {}
    for name in sorted(persons):
        *given, family = name.split(" ")
        for w in given:
            known[w] = f"given:{script(w)}:{persons[name] or _gender(given[0])}"
        known.setdefault(family, f"family:{script(family)}")
    for _, gender, own in titled:
        if len(own) == 1:
            scr = script(own[0])
            known.setdefault(own[0].casefold(), f"given:{scr}:{gender or 'm'}" if scr in _RUNS else f"family:{scr}")
    uncased = sorted((n for n in known if not _cased(n)), key=len, reverse=True)
    if uncased:
        runs = "|".join(re.escape(n) for n in uncased if script(n) in _RUNS and len(n) > 1)
        alone = "|".join(re.escape(n) for n in uncased if script(n) not in _RUNS)
        titled_at = {at for at, _, _ in titled}
        more = list(re.finditer("|".join(filter(None, [runs, alone and rf"(?<![^\W\d_])(?:{alone})(?![^\W\d_])"])), text)) if runs or alone else []
        singles = (_LETTERS.match(text, at) for at in sorted(titled_at) if text[at] in known and script(text[at]) in _RUNS)
        words = sorted([*words, *(m for m in more if m.end() > m.start()), *(m for m in singles if len(m[0]) == 1)], key=lambda m: m.start())
    out, k = [], 0
    for w in words:
        kind = known.get(w[0].casefold())
        if kind is None:
            continue
        while k < len(taken) and taken[k][1] <= w.start():
            k += 1
        if k == len(taken) or taken[k][0] >= w.end():
            out.append((w.start(), w.end(), kind, w[0].casefold()))
    return out


def _next_to(text: str, words: list[re.Match]) -> bool:
    return all(b.start() - a.end() == 1 and text[a.end()] in " -" for a, b in itertools.pairwise(words))


def full_names(text: str) -> set[str]:
    """Neighbouring capitalised words, two or three, that may be a person's whole name."""
    words = [w for w in _LETTERS.finditer(text) if w[0][0].isupper()]
    return {_full([w[0] for w in words[k : k + n]]) for k in range(len(words)) for n in (2, 3) if k + n <= len(words) and _next_to(text, words[k : k + n])}


def _gender(given: str) -> str:
    return _GENDER.get(given.casefold()) or ("f" if given[-1:] in "aeяаηα" else "m")


def canonical(kind: str, form: str) -> str:
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"\D", "", form)
    if kind == "iban":
        return form.replace(" ", "")
    return form.lower() if kind in ("email", "ip6") else form


def _number(key: bytes, *parts: object, bits: int = 448) -> int:
    """A keyed number, of at least so many bits and 64 more."""
    seed = hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha512).digest()
    return int.from_bytes(seed if bits <= 448 else hashlib.shake_256(seed).digest(bits // 8 + 9), "big")


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. n - 1: ten rounds of a Feistel network, walked until it stays inside."""
    if n < 2:
        return x
    a = int(n**0.5) if n < 1 << 50 else 1 << (n.bit_length() // 2)
    a = max(a, 2)
    b = -(-n // a)
    bits = max(a, b).bit_length()
    while True:
        left, right = divmod(x, b)
        for r in range(0, 10, 2):
            left = (left + _number(key, tweak, r, right, bits=bits)) % a
            right = (right + _number(key, tweak, r + 1, left, bits=bits)) % b
        x = left * b + right
        if x < n:
            return x


@functools.lru_cache(4096)
def _like(c: str) -> str:
    """The letters of the same script, case and neighbourhood of 64 codes as a letter that is not ASCII; all of them give the same."""
    start, kind, scr = ord(c) & ~63, unicodedata.category(c), script(c)
    return "".join(d for d in map(chr, range(start, start + 64)) if unicodedata.category(d) == kind and script(d) == scr)


def _alphabets(form: str, hexadecimal: bool) -> list[str]:
    """The characters that may stand at each place; one that stays is its own alphabet."""
    out = []
    for c in form:
        if hexadecimal and c in "0123456789abcdef":
            out.append("0123456789abcdef")
        elif c in "0123456789":
            out.append("0123456789")
        elif c in _LETTER:
            out.append(_LETTER)
        elif c in _LETTER.upper():
            out.append(_LETTER.upper())
        else:
            out.append(_like(c) if c.isalpha() and not c.isascii() else c)
    return out


def _same_form(form: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    """Another string of the format; long ones go piece by piece, each under what stands before it."""
    if len(form) > _PIECE:
        pieces = [form[i : i + _PIECE] for i in range(0, len(form), _PIECE)]
        before, out = hashlib.sha256(), []
        for piece in pieces:
            out.append(_same_form(piece, key, f"{tweak}|{before.hexdigest()}", hexadecimal))
            before.update(piece.encode("utf-8", "surrogatepass"))
        return "".join(out)
    sets = _alphabets(form, hexadecimal)
    shape = "".join(s[0] if len(s) > 1 else s for s in sets)
    x, n = 0, 1
    for c, s in zip(form, sets, strict=True):
        x, n = x * len(s) + s.index(c), n * len(s)
    x = permute(x, n, key, f"{tweak}|{shape}")
    out = []
    for s in reversed(sets):
        x, d = divmod(x, len(s))
        out.append(s[d])
    return "".join(reversed(out))


def _token(form: str, key: bytes, tweak: str, least: int = 8) -> str:
    """Keyed small letters and digits, as many as the form has characters."""
    size = max(least, len(form))
    x, out = _number(key, tweak, form, bits=6 * size), []
    for _ in range(size):
        x, d = divmod(x, 36)
        out.append("0123456789abcdefghijklmnopqrstuvwxyz"[d])
    return "".join(out)


def _secret(form: str, key: bytes, attempt: int) -> str:
    hexadecimal = re.fullmatch(r"[0-9a-f]{8,}", form) is not None
    room = 1
    for s in _alphabets(form, hexadecimal):
        room *= len(s)
        if room >= _ROOM:
            break
    if room < _ROOM:
        return _token(form, key, f"token|{attempt}")
    new = _same_form(form, key, f"secret|{attempt}", hexadecimal)
    return new + _token("", key, f"more|{attempt}|{form}", attempt - 2) if attempt > 2 else new


def luhn(digits: str) -> int:
    """The check digit after ``digits``."""
    total = sum(sum(divmod(int(d) * (2 if k % 2 == 0 else 1), 10)) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def surrogate(kind: str, canon: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of the surrogate."""
    if kind == "secret":
        return _secret(canon, key, attempt)
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        return _same_form(local, key, tweak) + "@" + ".".join([_same_form(".".join(labels[:-1]), key, f"domain|{attempt}"), labels[-1]])
    if kind == "ip":
        x = permute(int.from_bytes(bytes(map(int, canon.split("."))), "big"), 1 << 32, key, tweak)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "ip6":  # short forms have little room: further groups follow
        more = max(0, min(attempt - 2, 7 - len(re.findall(r"[0-9a-f]+", canon)))) if "::" in canon else 0
        return _same_form(canon, key, tweak, hexadecimal=True) + "".join(f":{_number(key, tweak, canon, i) % 65535 + 1:x}" for i in range(more)).removeprefix(":" if canon.endswith("::") else "")
    if kind == "phone":
        fixed = max(0, len(canon) - 10)
        return canon[:fixed] + _same_form(canon[fixed:], key, tweak)
    if kind == "card":
        body = canon[0] + _same_form(canon[1:-1], key, f"{tweak}|{canon[0]}")
        return body + str((luhn(body) + int(canon[-1]) - luhn(canon[:-1])) % 10)
    if kind == "iban":
        rest = _same_form(canon[4:], key, f"{tweak}|{canon[:2]}")
        off = (int(canon[2:4]) - int(_iban_check(canon[:2], canon[4:]))) % 97
        return canon[:2] + f"{(int(_iban_check(canon[:2], rest)) - 2 + off) % 97 + 2:02d}" + rest
    if kind.startswith(("given:", "family:")):
        return _name(kind, canon, key, attempt)
    return _same_form(canon, key, tweak)


def draw(kind: str, canon: str, key: bytes, attempt: int = 0) -> tuple[int, str]:
    """(attempt, surrogate): the first from ``attempt`` on that is not the original itself."""
    while (new := surrogate(kind, canon, key, attempt)) == canon:
        attempt += 1
        if attempt > 200:
            raise ValueError(f"no other string has the format of this {kind}")
    return attempt, new


def _name(kind: str, canon: str, key: bytes, attempt: int) -> str:
    """A name of the pool of its script and gender: single, then double, then triple ones; in other scripts letters near its own."""
    part, scr, *gender = kind.split(":")
    seed = _number(key, kind, canon, attempt)
    if scr in _RUNS:  # the first letter depends on the first letter alone, as far as it can
        first, rest = _RUNS[scr]
        first, rest = first.replace(canon[0], ""), [c for c in rest[gender[0] if gender else "m"] if c not in canon]
        out = [first[_number(key, scr, canon[0], attempt if len(canon) == 1 else 0) % len(first)]]
        for _ in range(max(len(canon) - 1, attempt // 4)):
            seed, d = divmod(seed, len(rest))
            out.append(rest[d])
        return "".join(out)
    pool = _GIVEN.get((scr, gender[0])) if gender else _FAMILY.get(scr)
    if pool:
        out = []
        for _ in range(1 + (attempt > 2) + attempt // 8):
            seed, d = divmod(seed, len(pool))
            out.append(pool[d].casefold())
        if scr == "CYRILLIC" and part == "family" and re.search("(?:ов|ев|ёв|ин|ын)а$", canon):
            out = [name + "а" for name in out]  # the form of the family name for women
        return "-".join(out)
    near = [chr(ord(c) + d) for c in canon for d in range(-8, 9) if script(chr(ord(c) + d)) == scr and chr(ord(c) + d).isalpha()]
    out = []
    for _ in range(max(2, len(canon)) + attempt // 8):
        seed, d = divmod(seed, len(near) or 1)
        out.append(near[d] if near else canon[0])
    return "".join(out)


def render(kind: str, form: str, new: str) -> str:
    """The surrogate in the spacing and case of the mention."""
    if kind in ("card", "phone", "ssn", "iban"):
        left = iter(new)
        return "".join(next(left) if c.isalnum() else c for c in form)
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(form, new, strict=True))
    if kind == "ip6":
        return new.upper() if any(c.isupper() for c in form) else new
    if kind.startswith(("given:", "family:")):
        new = re.sub(r"σ\b", "ς", new)  # the letter that ends a Greek word
        return new.upper() if form.isupper() and len(form) > 1 else "-".join(w.capitalize() for w in new.split("-")) if form[0].isupper() else new
    return new


def replace(text: str, key: bytes, again: dict[tuple[str, str], int] | None = None, people: dict[str, str] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """(text with surrogates, their places in it and types)."""
    parts, spans, at, size = [], [], 0, 0
    for start, end, kind, canon in find(text, people):
        new = render(kind, text[start:end], draw(kind, canon, key, (again or {}).get((kind, canon), 0))[1])
        parts += [text[at:start], new]
        size += start - at
        spans.append((size, size + len(new), kind.split(":")[0]))
        size += len(new)
        at = end
    return "".join([*parts, text[at:]]), spans


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entities of texts, and whole names as of the kind ``person`` and their gender."""
    for batch in sliced(batches):
        found = set()
        for t in batch.column(0).to_pylist():
            if t:
                own, titled = _by_pattern(t)
                found.update((k, c) for _, _, k, c in (own + _names(t, own, titled, {}) if titled else own))
                found.update((f"person:{gender}", _full(words)) for _, gender, words in titled if len(words) > 1)
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.string())], ["kind", "canon"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = [(th, name) for th, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for name in full_names(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["th", "canon"])


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = [draw(k, c, key, a) for k, c, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            attempts, new = pa.array([a for a, _ in got], pa.int32()), pa.array([n for _, n in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], attempts, new], ["kind", "canon", "attempt", "new"])

    return run


def settle(found: DataFrame, key: bytes, patience: int = 40) -> DataFrame | None:
    """(kind, canon, attempt) of the entities that must be drawn again; None if there is none.

    ``found`` is a written table of distinct (kind, canon).  Rounds go on until no surrogate
    meets another or an original; after ``patience`` rounds that leave as many as there
    were, an error tells that a format is full.
    """
    spark = found.sparkSession
    # names of one script must not meet whatever part and gender they have
    space = F.when(F.col("kind").rlike("^(given|family):"), F.regexp_extract("kind", "^[a-z]+:([A-Z]+)", 1)).otherwise(F.col("kind"))
    draw_all = lambda rows: rows.mapInArrow(_drawn(key), "kind string, canon string, attempt int, new string")
    originals = found.select(space.alias("space"), F.col("canon").alias("new")).distinct()
    state, state_path = write_table(draw_all(found.withColumn("attempt", F.lit(0))), "drawn")
    left, stuck = None, 0
    while True:
        placed = state.select(space.alias("space"), "new", "kind", "canon")
        first = placed.groupBy("space", "new").agg(F.min(F.struct("kind", "canon")).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        meet = placed.join(first, ["space", "new"]).where(F.struct("kind", "canon") != F.col("first")).select("kind", "canon")
        meet = meet.union(placed.join(originals, ["space", "new"], "left_semi").select("kind", "canon")).distinct()
        meet, path = write_table(meet, "meeting")
        n = meet.count()
        if not n:
            drop_table(spark, path)
            break
        stuck = stuck + 1 if left is not None and n >= left else 0
        if stuck > patience:
            raise ValueError(f"{n} entities find no surrogate of their own: their format is full")
        left = n
        meeting = sized(meet.withColumn("clash", F.lit(True)), path)
        marked = state.join(meeting, ["kind", "canon"], "left")
        moved = draw_all(marked.where("clash").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
        new, new_path = write_table(marked.where("clash IS NULL").select("kind", "canon", "attempt", "new").unionByName(moved), "drawn")
        drop_table(spark, state_path)
        drop_table(spark, path)
        state, state_path = new, new_path
    if left is None:
        drop_table(spark, state_path)
        return None
    return state.where(F.col("attempt") > 0).select("kind", "canon", "attempt")


def pseudonymize(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text with surrogates, n_entities, entities (start, end, type in the new text)."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = base.withColumn("th", F.xxhash64("text"))
    everything, found_path = write_table(base.select("text").mapInArrow(_entities, "kind string, canon string").distinct(), "entities")
    person = F.col("kind").startswith("person:")
    people = everything.where(person).groupBy("canon").agg(F.max(F.substring("kind", 8, 1)).alias("gender"))
    people, people_path = write_table(people, "people")
    named = keyed.withColumn("people", F.lit(None).cast("array<struct<canon: string, gender: string>>"))
    if people.limit(1).count():  # the texts that hold a whole name of the corpus
        there = keyed.select("th", "text").mapInArrow(_candidates, "th long, canon string").join(sized(people, people_path), "canon")
        there, path = write_table(there.groupBy("th").agg(F.collect_set(F.struct("canon", "gender")).alias("people")), "named-texts")
        named = keyed.join(sized(there, path), "th", "left")
    again = settle(everything.where(~person), key)
    rows = named.withColumn("again", F.lit(None).cast("array<struct<kind: string, canon: string, attempt: int>>"))
    if again is not None:  # each text gets the entries of its own entities
        again, path = write_table(again, "again")
        mine = named.select("th", "text", "people").mapInArrow(_mentions, "th long, kind string, canon string").join(sized(again, path), ["kind", "canon"])
        mine, path = write_table(mine.groupBy("th").agg(F.collect_set(F.struct("kind", "canon", "attempt")).alias("again")), "mentions")
        rows = named.join(sized(mine, path), "th", "left")
    drop_table(spark, found_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, spans = [], []
            for text, own, names in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                new, places = (None, []) if text is None else replace(text, key, {(e["kind"], e["canon"]): e["attempt"] for e in own or ()}, {e["canon"]: e["gender"] for e in names or ()})
                texts.append(new)
                spans.append([{"start": a, "end": b, "type": k} for a, b, k in places])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)], [id_col, text_col, "n_entities", "entities"])

    return rows.select("id", "text", "again", "people").mapInArrow(run, f"`{id_col}` {base.schema['id'].dataType.simpleString()}, `{text_col}` string, n_entities long, entities array<struct<start: int, end: int, type: string>>")


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = [
            (th, k, c)
            for th, t, names in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            if t
            for k, c in {(k, c) for _, _, k, c in find(t, {e["canon"]: e["gender"] for e in names or ()})}
        ]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))], ["th", "kind", "canon"])
