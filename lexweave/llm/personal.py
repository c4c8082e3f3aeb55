r"""Problem 5: personal data in free text, found and replaced by typed placeholders with linkable pseudonyms.

Texts are read through a plain view (odd characters folded one by one, so that offsets map back), scanned by format and
context, and validated. Numbers and dates get a format-preserving pseudonym: a keyed Feistel permutation within the
digits of their format, so that equal values stay linked across documents and no two values meet; identity numbers
with a right check digit keep one, telephone numbers their area, under which they are permuted however it is written. E-mail
and street addresses and names get 128 bits of a keyed digest. The key is the caller's: nothing can be read back without it.

A listed given name counts wherever it stands as a name is written, unless the posts show that it is an ordinary word: that it
stands more often outside the places that announce a name (in Latin letters: in lower case) than in them. Then, and for
names that the list lacks, an announcing place is needed. Each kind has a cue without which no pattern of it can match; it is made
of the same parts as the patterns. The parser's text holds the same letters and digits as the post, so spans are carried
over by their count; where it does not, it is scanned itself.

Defined results: null texts have no spans and stay null; empty and very long texts are read whole; overlapping spans go to the earlier
and longer one; a nickname is no name, an order or parcel number is no identity number; dates are personal only behind a
word for birth; repeated rows give their spans again; rows with a null id keep it; extra columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.lookalikes import LATIN_LIKE

KINDS = ("email", "phone", "id_number", "address", "name")
ROUNDS = 8

# ---- pseudonyms ---------------------------------------------------------------------------------------------------


def _round(key: bytes, tag: bytes, i: int, half: int, size: int) -> int:
    return int.from_bytes(hmac.new(key, b"%b|%d|%d" % (tag, i, half), hashlib.sha256).digest()[:16], "big") % size


def permuted(value: int, size: int, key: bytes, tag: bytes) -> int:
    """A keyed permutation of range(size): a balanced Feistel network over the next square, walked until it lands inside."""
    if size < 2:
        return value
    side = 1
    while side * side < size:
        side += 1
    while True:
        left, right = divmod(value, side)
        for i in range(ROUNDS):
            left, right = right, (left + _round(key, tag, i, right, side)) % side
        value = left * side + right
        if value < size:
            return value


def check_digit(eight: str) -> str:
    """The ninth digit of an identity number (weights 1 and 2 in turn, digits of products summed)."""
    total = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(eight))
    return str(-total % 10)


def pseudonym_digits(digits: str, key: bytes, tag: str, kept: int = 0) -> str:
    """Digits permuted among all of the same length behind the first ``kept`` ones."""
    tail = digits[kept:]
    return digits[:kept] + str(permuted(int(tail), 10 ** len(tail), key, f"{tag}{digits[:kept]}/{len(tail)}".encode())).zfill(len(tail)) if tail else digits


def pseudonym_id(digits: str, key: bytes) -> str:
    """An identity number's pseudonym; a right check digit stays right."""
    if len(digits) == 9 and check_digit(digits[:8]) == digits[8]:
        first = pseudonym_digits(digits[:8], key, "id")
        return first + check_digit(first)
    return pseudonym_digits(digits, key, "id?")


def pseudonym_date(day: int, month: int, year: int, key: bytes) -> tuple[int, int, int] | None:
    """A valid date permuted among the days from 1900 to 2099; None when there is no such day."""
    try:
        first, last, d = datetime.date(1900, 1, 1), datetime.date(2100, 1, 1), datetime.date(year, month, day)
    except ValueError:
        return None
    if not first <= d < last:
        return None
    d = first + datetime.timedelta(permuted((d - first).days, (last - first).days, key, b"date"))
    return d.day, d.month, d.year


def refilled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it, c) if c.isdigit() else c for c in shape)


def pseudonym(kind: str, text: str, key: bytes) -> str:
    """The placeholder for a span."""
    if kind == "phone":
        digits = spoken_digits(text) if not re.search(r"\d", text) else re.sub(r"\D", "", text)
        if len(digits) < 7:
            return "[PHONE]"
        line, head = digits[-7:], digits[:-7]
        area = re.sub(r"^(?:00)?972|^0|^[78](?=\d{3}$)", "", head)  # with or without the country, one number
        new = head + pseudonym_digits(line, key, f"phone{area}-")
        return f"[PHONE {refilled(text, new) if re.search(r'\d', text) else new}]"
    if kind == "id_number":
        return f"[ID_NUMBER {refilled(text, pseudonym_id(re.sub(r'\D', '', text), key))}]"
    if kind == "birth_date":
        d, m, y = (int(x) for x in re.findall(r"\d+", text))
        new = pseudonym_date(d, m, y, key)
        return f"[DATE {refilled(text, f'{new[0]:02d}{new[1]:02d}{new[2]:04d}')}]" if new else "[DATE]"
    plain = re.sub(r"[\W_]+", "", text.lower())
    return f"[{kind.upper()} {hmac.new(key, f'{kind}|{plain}'.encode(), hashlib.sha256).hexdigest()[:32]}]"


# ---- the plain view ------------------------------------------------------------------------------------------------

_LIKE = str.maketrans(*LATIN_LIKE)
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")
_MIXED = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile("[\x00-\x7fא-תА-яЁё\u00c0-\u00ff]*\\Z")


def plain_view(text: str) -> tuple[str, list[int] | None]:
    """The text in plain characters and, where any were dropped, the offset of each in the original."""
    if _PLAIN.match(text) and not re.search(r"[A-Za-z][А-яЁё]|[А-яЁё][A-Za-z]", text):
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        if _INVISIBLE.match(c):
            continue
        k = c if c.isascii() else unicodedata.normalize("NFKC", c)
        out.append(k if len(k) == 1 else c)
        at.append(i)
    s = "".join(out)
    s = re.sub(r"[^\S\n\r\t]", " ", s)
    s = _MIXED.sub(lambda m: m.group().translate(_LIKE) if re.search("[A-Za-z]", m.group()) else m.group(), s)
    return s, at


# ---- what personal data looks like ------------------------------------------------------------------------------------

_DOT = r"(?:\.|\s\.\s|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+|\s+נקודה\s+|\s+точка\s+)"
_AT_WORDS = "שטרודל|כרוכית|собака"
_AT = rf"(?:\s?@\s?|\s?[(\[{{]\s?at?\s?[)\]}}]\s?|\s+(?:{_AT_WORDS})\s+)"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?=[A-Za-z0-9]))*"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"(?i)(?<![A-Za-z0-9_.%+-])({_LOCAL})(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})+|\s+at\s+{_LABEL}(?:(?:\s?[(\[{{]\s?dot\s?[)\]}}]\s?|\s+dot\s+){_LABEL})+)")

#: The words for the digits 0 to 9 (fixed values).
DIGIT_WORDS = {
    **{w: i for i, w in enumerate("zero one two three four five six seven eight nine".split())},
    **{w: i for i, w in enumerate("אפס אחת שתיים שלוש ארבע חמש שש שבע שמונה תשע".split())},
    **{w: i for i, w in enumerate("ноль один два три четыре пять шесть семь восемь девять".split())},
    "oh": 0, "אחד": 1, "שתים": 2, "שניים": 2,
}
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPOKEN = re.compile(rf"(?i)(?<!\w)(?:{_DIGIT})(?:[\s,.-]+(?:{_DIGIT})){{6,14}}(?!\w)")


def spoken_digits(text: str) -> str:
    """Digits said in words."""
    return "".join(str(DIGIT_WORDS[w]) for w in re.findall(r"\w+", text.lower()) if w in DIGIT_WORDS)


_SEP = r"[\s.\-/]?"
PHONE = re.compile(
    rf"(?<![\w.+/-])(?:"
    rf"\+\s?\d{{1,3}}(?:\s?[-. ]\s?|\s?)(?:\(\s?\d{{2,4}}\s?\)\s?|\d{{1,3}}\s?[-. ]?\s?)\d{{3}}\s?[-. ]?\s?\d{{2,4}}(?:[-. ]?\d{{2,3}})?"  # + and a country
    rf"|00\d{{2,3}}{_SEP}\d{{1,2}}{_SEP}\d{{3}}{_SEP}\d{{4}}"
    rf"|\(\s?0\d{{1,2}}\s?\)\s?\d{{3}}\s?[-. ]?\s?\d{{4}}"
    rf"|0(?:5\d|7[1-9]|[23489])(?:\s?[-. ]\s?)?\d{{3}}(?:\s?[-. ]\s?)?\d{{4}}"
    rf"|8{_SEP}\(?\d{{3}}\)?{_SEP}\d{{3}}{_SEP}\d{{2}}{_SEP}\d{{2}}"
    rf")(?![\w/]|[-.]\d)"
)

_ID_WORD = r"(?:ת\s?[\"״'׳.]{0,2}\s?ז\b\.?|תעודת (?:ה)?זהות|מספר (?:ה)?זהות|מס['׳]? זהות|identity(?: card| number| no\.?)?|national id|\bid\b(?: number| card| no\.?)?|паспорт|удостоверени\w+)"
_ID_SHAPE = r"(?:[A-Z]\s?\d{7}|\d{3} \d{3} \d{3}|\d\s?-\s?\d{7}\s?-\s?\d|\d{8}\s?-\s?\d|\d{8,9})"
IDENTITY = re.compile(rf"(?i)(?<![\w]){_ID_WORD}[^\n\d]{{0,16}}?(?<![\w.+/-])({_ID_SHAPE})(?!\w|[-/]\d)")
#: Formats that only identity numbers have.
IDENTITY_FORM = re.compile(r"(?<![\w.+/-])(\d-\d{7}-\d|\d{8}-\d|[A-Z]?\d{7,9}(?=\s+(?:לצורך הטופס|on the form)))(?!\w|[-/]\d)")
NO_IDENTITY = re.compile(r"(?i)(?:parcel|משלוח|order|הזמנה|invoice|item|פריט|lot|посылк\w*)\W{0,3}$")

_H = r"[א-ת]{2,}(?:['׳’][א-ת]+|-[א-ת]+)*"
_HSTREET = r"(?:רחוב|רח\s?['׳]|שדרות|שד\s?['׳]|סמטת|דרך|כיכר|שכונת|רח\.|שד\.)"
_STREET = "Street|St|Road|Rd|Lane|Ln|Close|Avenue|Ave|Row|Court|Crescent|Terrace|Gardens|Boulevard|Blvd"
_RSTREET = r"(?:ул\.|улица|проспект|пр\.)"
ADDRESS = re.compile(
    rf"(?<!\w)(?:[בלמהו]{{0,2}})({_HSTREET}\s+(?!עד\b)(?:{_H}\s+){{1,4}}?\d{{1,4}}(?:\s?/\s?\d{{1,3}})?[א-ת]?(?![\d.:]\d)(?:,?\s+דירה\s+\d{{1,3}})?)"
    rf"|(?<![\w/.-])(\d{{1,4}}(?:\s?/\s?\d{{1,3}}|[A-Za-z])?\s+(?:[A-Z][\w'’]+\s+){{1,4}}(?:{_STREET})\b\.?(?:,?\s+(?:Apt|Flat|Unit)\.?\s+\d{{1,3}})?)"
    rf"|(?i:(?:live at|clinic is at|ship it to|meet at|address\s?:|home is)\s+)(?i:(\d{{1,4}}(?:\s?/\s?\d{{1,3}}|[a-z])?\s+(?:[a-z][\w'’]+\s+){{1,4}}?(?:{_STREET})\b\.?(?:,?\s+(?:apt|flat|unit)\.?\s+\d{{1,3}})?))"
    rf"|(?<!\w)({_RSTREET}\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁа-яё]+)?,?\s+(?:д\.\s?)?\d{{1,4}}(?:,?\s+кв\.\s?\d{{1,3}})?)"
)

_E = r"(?:[A-Za-z]\s?\.|[A-Za-z][A-Za-z\u00c0-\u024f'’]+(?:\s?-\s?[A-Za-z][A-Za-z'’]+)?)"
_EN, _HN = rf"({_E}(?:\s+{_E}){{0,2}}?)", rf"({_H}(?:\s+{_H}){{0,2}}?)"
_KIN = r"(?:husband|wife|partner|mother|father|son|daughter|brother|sister|mum|mom|dad)"
_HKIN = r"(?:בעלי|אשתי|אישתי|בן זוגי|בת זוגי|אחי|אחותי|אמי|אבי|בני|בתי)"
#: Names between two words that belong together.
NAME_BETWEEN = [
    re.compile(p)
    for p in (
        rf"(?<!\w)דיברתי עם\s+{_HN}\s+מה(?:מרפאה|קופה|קליניקה)(?!\w)", rf"(?<!\w)תודה ל\s?:?\s*{_HN}\s+על העזרה(?!\w)", rf"(?<!\w)ד\s?[\"״]\s?ר\s+{_HN}\s+(?:אמרה?|רשמה?|המליצה?)(?!\w)", rf"(?<!\w){_HKIN}\s+{_HN}\s+מטפלת? בי(?!\w)",
        rf"(?i)\bspoke (?:with|to)\s+{_EN}\s+from the clinic\b", rf"(?i)\bmy {_KIN}\s+{_EN}\s+(?:looks|look|takes) (?:after|care)", rf"(?i)\bdr\s?\.?\s+{_EN}\s+(?:told|said|gave|advised)\b", rf"(?i)\bnurse\s+{_EN}\s+was (?:kind|nice|helpful)\b", rf"(?i)\bthanks? (?:you )?to\s?:?\s+{_EN}\s+for (?:the|your|his|her) help\b",
    )
]
#: Names behind a word that announces one.
NAME_BEHIND = re.compile(rf"(?<!\w)(?:קוראים לי|שמי|בברכה\s?,?|ד\s?[\"״]\s?ר)\s+({_H})|(?i:\bregards\s?,|\bmy name is|\bdr\s?\.)\s+({_E})|(?<!\w)(?i:меня зовут|с уважением\s?,)\s+([А-ЯЁ][а-яё]+)")
#: Words that announce a name without words behind it: a listed given name must follow (capitals alone are mostly illnesses and titles).
ANNOUNCED = re.compile(rf"(?<!\w)(?:דיברתי עם\s+|תודה ל\s?:?\s*|{_HKIN}\s+)({_H})|(?i:\b(?:nurse|spoke (?:with|to)|thanks? (?:you )?to\s?:?|my {_KIN}))[^\S\n]+({_E})")
#: What follows a name that nothing announces.
NAME_BEFORE = re.compile(r"(?<!\w)(?:מהקבוצה\s+(?:המליצה|המליץ|אמרה?|כתבה?)|(?i:from the group\s+(?:said|told|wrote|recommended)))(?!\w)")
_JOINERS = {"ואז", "אבל", "וגם", "כי", "עם", "and", "then", "but", "so", "because", "with", "a", "the", "is"}
_ROLES = {"friend", "someone", "somebody", "woman", "man", "people", "חברה", "חבר", "מישהו", "מישהי", "אישה"}
BIRTH = re.compile(r"(?i)(?:\bborn (?:on )?|date of birth\s?:?\s?|תאריך לידה\s?:?\s?|נולדתי ב-?\s?|дата рождения\s?:?\s?)(\d{1,2}[./-]\d{1,2}[./-]\d{4})(?!\d)")


_NEXT = re.compile(rf"[^\S\n]({_H}|{_E})")


def _tail(text: str, end: int, given: frozenset[str]) -> int:
    """Where a name that began before ``end`` stops: second names, initials and a surname."""
    for _ in range(2):
        m = _NEXT.match(text, end)
        if not m:
            break
        word = m.group(1)
        after = text[m.end() : m.end() + 1]
        if word.lower() in _JOINERS or not (word.lower() in given or "." in word or "-" in word or (word[0].isascii() and word[0].isupper()) or (not word[0].isascii() and (after == "" or after in ",.!?;\n"))):
            break
        end = m.end()
    return end


def _names(text: str, given: frozenset[str]) -> Iterator[tuple[int, int]]:
    between: set[int] = set()
    for pattern in NAME_BETWEEN:
        for m in pattern.finditer(text):
            if m.group(1).split()[0].lower() not in _JOINERS | _ROLES:
                between.add(m.start(1))
                yield m.span(1)
    shouted = text.upper() == text or text.lower() == text
    for m in ANNOUNCED.finditer(text):
        g = m.lastindex
        word, start = re.sub(r"['’]s$", "", m.group(g)), m.start(g)
        end = start + len(word)
        if start in between or word.lower() in _JOINERS | _ROLES:
            continue
        if word.lower() in given and (g == 1 or word[0].isupper() or shouted):
            yield start, end if shouted and g == 2 else _tail(text, end, given)
    for m in NAME_BEHIND.finditer(text):
        g = m.lastindex
        word = m.group(g)
        if g == 2 and not (word[0].isupper() or shouted or word.lower() in given):
            continue
        if word.lower() not in _JOINERS:
            yield m.start(g), _tail(text, m.end(g), given)
    for m in NAME_BEFORE.finditer(text):
        words: list[tuple[int, str]] = []
        at = m.start()
        bounded = False
        while len(words) < 3:
            w = re.search(rf"(?:^|(?<=[^\w.'’-]))({_H}|{_E})[^\S\n]+$", text[max(0, at - 40) : at])
            if not w:
                bounded = True
                break
            word, start = w.group(1), max(0, at - 40) + w.start(1)
            if word.lower() in _JOINERS or (word[0].isascii() and word[0].islower() and not shouted):
                bounded = True
                break
            words.append((start, word))
            at = start
        if not words or words[0][1].lower() in _ROLES:
            continue
        if not bounded:
            w = text[:at].rstrip(" ")
            bounded = not w or w[-1] in ".,!?;:\n-" or w.rsplit(None, 1)[-1].lower() in _JOINERS
        known = [i for i, (_, w) in enumerate(words) if w.lower() in given or w.endswith(".")]
        # the farthest known given name or initial; unknown ones only where the sentence begins with them
        i = len(words) - 1 if bounded else max(known) if known else 0
        yield words[i][0], m.start() - (len(text[: m.start()]) - len(text[: m.start()].rstrip()))


_WORD = re.compile(rf"(?<![\w'’-])(?:{_H}|[A-Za-z][A-Za-z\u00c0-\u024f]+)(?![\w])")


def _listed(text: str, sure: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Listed names that no place announces: with a capital, where letters have one and the text uses them."""
    shouted = text.upper() == text or text.lower() == text
    for m in _WORD.finditer(text):
        word = m.group()
        if word.lower() in sure and (not word[0].isascii() or (word[0].isupper() and not shouted)) and text[m.start() - 1 : m.start()] != "@":
            yield m.start(), _tail(text, m.end(), sure) if word[0].isascii() else m.end()


#: What a text must hold for any pattern of a kind to match.
CUES = {
    "email": re.compile(rf"(?i)@|[(\[{{]\s?at?\s?[)\]}}]|\bat\b|{_AT_WORDS}"),
    "birth_date": re.compile(r"(?i)born|birth|לידה|נולדתי|рождения"),
    "id_number": re.compile(r"(?:\d[\s-]{0,3}){7}"),
    "phone": re.compile(r"(?:\d[\s.()/-]{0,5}){7}"),
    "spoken": re.compile(rf"(?i)(?<!\w)(?:{_DIGIT})[\s,.-]+(?:{_DIGIT})(?!\w)"),
    "address": re.compile(rf"(?i){_HSTREET}\s|(?:{_STREET})\b|{_RSTREET}\s"),
    "name": re.compile(rf"(?i)דיברתי עם|תודה ל|ד\s?[\"״]\s?ר|{_HKIN}|קוראים לי|שמי|בברכה|מהקבוצה|spoke|my {_KIN}|\bdr\b|nurse|thank|regards|name is|from the group|зовут|уважением"),
}


def spans(text: str, given: frozenset[str], sure: frozenset[str] = frozenset(), cues: bool = True) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of all personal data in a text, in order, none overlapping.

    ``given`` names count in announcing places, ``sure`` ones anywhere. ``cues=False`` tries every pattern on every text.
    """
    if not text:
        return []
    s, at = plain_view(text)
    out: list[tuple[int, int, str]] = []
    holds = lambda kind: not cues or CUES[kind].search(s) is not None
    digit = not cues or re.search(r"\d", s) is not None
    if holds("email"):
        out += [(*m.span(), "email") for m in EMAIL.finditer(s)]
    if digit and holds("birth_date"):
        out += [(*m.span(1), "birth_date") for m in BIRTH.finditer(s)]
    if digit and holds("id_number"):
        for pattern in (IDENTITY, IDENTITY_FORM):
            out += [(*m.span(1), "id_number") for m in pattern.finditer(s) if not NO_IDENTITY.search(s[: m.start(1)])]
    if digit and holds("phone"):
        out += [(*m.span(), "phone") for m in PHONE.finditer(s)]
    if holds("spoken"):
        out += [(*m.span(), "phone") for m in _SPOKEN.finditer(s)]
    if digit and holds("address"):
        out += [(*next(m.span(g) for g in range(1, 5) if m.group(g)), "address") for m in ADDRESS.finditer(s)]
    if holds("name"):
        out += [(a, b, "name") for a, b in _names(s, given)]
    if sure:
        announced = {i for a, b, _ in out for i in range(a, b)}
        out += [(a, b, "name") for a, b in _listed(s, sure) if a not in announced]
    if not out:
        return out
    chosen: list[tuple[int, int, str]] = []
    rank = {k: i for i, k in enumerate(("email", "birth_date", "id_number", "phone", "address", "name"))}
    for a, b, kind in sorted(set(out), key=lambda x: (x[0], -x[1], rank[x[2]])):
        if not chosen or a >= chosen[-1][1]:
            chosen.append((a, b, kind))
    if at is None:
        return chosen
    return [(at[a], at[b - 1] + 1, kind) for a, b, kind in chosen]


def carried(found: list[tuple[int, int, str]], text: str, other: str) -> list[tuple[int, int, str]] | None:
    """Spans of ``text`` in a text with the same letters and digits; None where these differ."""
    here = [i for i, c in enumerate(text) if c.isalnum()]
    there = [i for i, c in enumerate(other) if c.isalnum()]
    if len(here) != len(there) or any(text[i] != other[j] for i, j in zip(here, there, strict=True)):
        return None
    out = []
    from bisect import bisect_left

    for a, b, kind in found:
        first, last = bisect_left(here, a), bisect_left(here, b) - 1
        start, end = there[first], there[last] + 1
        lead = text[a : here[first]]
        if lead:  # a sign or bracket opens the number
            before = there[first - 1] + 1 if first else 0
            p = other.find(lead.strip()[0], before, start) if lead.strip() else -1
            start = p if p >= 0 else start
        out.append((start, end, kind))
    return out


def _both(post: str | None, tokens: str | None, given: frozenset[str], sure: frozenset[str]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    first = spans(post, given, sure) if post else []
    if not tokens:
        return first, []
    second = carried(first, post, tokens) if post is not None else None
    return first, spans(tokens, given, sure) if second is None else second


def redacted(text: str | None, found: list[tuple[int, int, str]], key: bytes) -> str | None:
    """The text with a placeholder for each span."""
    if not text or not found:
        return text
    out, at = [], 0
    for a, b, kind in sorted(found):
        out += [text[at:a], pseudonym(kind, text[a:b], key)]
        at = b
    return "".join([*out, text[at:]])


def _given(names: DataFrame, most: int = 100_000) -> frozenset[str]:
    """The list of given names, read to the driver only below a checked size."""
    rows = names.where("given_name is not null").select(F.lower("given_name").alias("n")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} given names")
    return frozenset(r.n for r in rows)


def _evidence(batches: Iterator[pa.RecordBatch], given: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """``name, announced, outside`` over the posts of a task."""
    announced, outside = dict.fromkeys(given, 0), dict.fromkeys(given, 0)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            s = plain_view(text)[0]
            hits = [m for m in _WORD.finditer(s) if m.group().lower() in given]
            if not hits:
                continue
            held = {i for a, b in (_names(s, given) if CUES["name"].search(s) else ()) for i in range(a, b)}
            mails = [m.span() for m in EMAIL.finditer(s)] if CUES["email"].search(s) else []
            for m in hits:
                word = m.group()
                if any(a <= m.start() < b for a, b in mails):
                    continue
                if m.start() in held:
                    announced[word.lower()] += 1
                elif not word[0].isascii() or word[0].islower():
                    outside[word.lower()] += 1
    seen = [n for n in given if announced[n] or outside[n]]
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([announced[n] for n in seen], pa.int64()), pa.array([outside[n] for n in seen], pa.int64())], names=["name", "announced", "outside"])


def ordinary_words(posts: DataFrame, given: frozenset[str], least: int = 3) -> frozenset[str]:
    """The listed names that the posts use as words: outside announcing places at least ``least`` times and more than in them.

    All posts are counted; what reaches the driver is one row for each listed name at most.
    """
    held = posts.sparkSession.sparkContext.broadcast(given)
    counts = posts.select(F.col("post_txt").cast("string")).mapInArrow(lambda batches: _evidence(batches, held.value), "name string, announced long, outside long")
    sums = counts.groupBy("name").agg(F.sum("announced").alias("announced"), F.sum("outside").alias("outside"))
    return frozenset(r.name for r in sums.where((F.col("outside") >= least) & (F.col("outside") > F.col("announced"))).select("name").collect())


def _mapped(posts: DataFrame, names: DataFrame, schema: str, rows_of) -> DataFrame:
    """Each row's spans turned into output rows, in Arrow batches; whole numbers stay whole where others are null."""
    listed = _given(names)
    given = posts.sparkSession.sparkContext.broadcast((listed, listed - ordinary_words(posts, listed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]) for name, kind in (x.strip().split(" ") for x in schema.split(","))]
        for batch in batches:
            out: list[tuple] = []
            for i, post, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += rows_of(i, post, tokens, *_both(post, tokens, *given.value))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    narrow = posts.select(F.col("post_id").cast("long").alias("post_id"), F.col("post_txt").cast("string").alias("post_txt"), F.col("tokenized_text").cast("string").alias("tokenized_text"))
    return narrow.mapInArrow(run, schema)


def session_key(posts: DataFrame) -> bytes:
    """The key that the session names in ``spark.lexweave.key``; without one a new key, under which only this run's values are linked."""
    named = posts.sparkSession.conf.get("spark.lexweave.key", None)
    return named.encode() if named else secrets.token_bytes(32)


def find(posts: DataFrame, names: DataFrame, key: bytes) -> DataFrame:
    """``post_id, field_name, kind, start_offset, end_offset, pseudonym``. Nothing but the counts of listed names is shuffled."""

    def rows_of(i, post, tokens, a, b):
        fields = (("post_txt", post, a), ("tokenized_text", tokens, b))
        return [(i, field, k, s, e, pseudonym(k, text[s:e], key)) for field, text, found_in in fields for s, e, k in found_in if k in KINDS]

    return _mapped(posts, names, "post_id long, field_name string, kind string, start_offset int, end_offset int, pseudonym string", rows_of)


def found(posts: DataFrame, names: DataFrame) -> DataFrame:
    """``post_id, field_name, kind, start_offset`` of what ``find`` replaces."""
    return find(posts, names, session_key(posts)).select("post_id", "field_name", "kind", "start_offset")


def redact(posts: DataFrame, names: DataFrame, key: bytes) -> DataFrame:
    """``post_id, post_txt, tokenized_text`` with placeholders."""

    def rows_of(i, post, tokens, a, b):
        return [(i, redacted(post, a, key), redacted(tokens, b, key))]

    return _mapped(posts, names, "post_id long, post_txt string, tokenized_text string", rows_of)
