import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import personal as P

GIVEN = frozenset({"דנה", "hugo", "אור", "rose"})


def kinds(text):
    return [(text[a:b], k) for a, b, k in P.spans(text, GIVEN)]


def test_formats():
    assert kinds("mail <tal.tal@example.com>, or dana (at) inbox [dot] test, or noam at mail dot example!") == [("tal.tal@example.com", "email"), ("dana (at) inbox [dot] test", "email"), ("noam at mail dot example", "email")]
    for p in ("+972-52-555-1234", "00972525551234", "052-5551234", "052.555.1234", "052 555 1234", "0525551234", "(03) 555-1234", "+1 (415) 555-0101", "zero five two, five five five, one two three four", "אפס חמש שתיים, חמש חמש חמש, אחת שתיים שלוש ארבע"):
        assert kinds(f"call {p} now") == [(p, "phone")], p
    for i in ("123456782", "0-0036689-7", "14716870-5", "418 516 331", "M6094225"):
        assert kinds(f"ת.ז. {i} בבקשה") == [(i, "id_number")] and kinds(f"my identity number is {i}.") == [(i, "id_number")], i
    assert kinds("גר ב: רח' הטיילת הישנה 7 דירה 20, כפר") == [("רח' הטיילת הישנה 7 דירה 20", "address")]
    assert kinds("we meet at 122B Thistle Bank Road, Greyford") == [("122B Thistle Bank Road", "address")]


def test_names():
    assert kinds("שמי דנה כהן. ד\"ר אור לוי אמר לי") == [("דנה כהן", "name"), ("אור לוי", "name")]
    assert kinds("it hurts. Will A. O'Darrow from the group said so, Regards, Hugo") == [("Will A. O'Darrow", "name"), ("Hugo", "name")]
    assert kinds("nurse Vera was kind, I spoke with T. Morlenko from the clinic") == [("Vera", "name"), ("T. Morlenko", "name")]
    assert kinds("שמי דנה כהן\nאור לוי מהקבוצה המליצה") == [("דנה כהן", "name"), ("אור לוי", "name")]


def test_other_things_are_left():
    for t in ("parcel 338190440 without an ID", "אישור משלוח 338190431 ללא ת.ז.", "readings 95-92-110", "version 4.12.52", "פגישה 12/03/2044", "@nickname hi", "results came back at 22 and that", "הלכתי ברחוב עד השעה 24.00, 63 צעדים", "there is hope, the roses rose", "כל בוקר יש טל על הדשא", "my clinic nurse advised", "item 904273-7", "", None):
        assert P.spans(t or "", GIVEN) == [], t


def test_odd_characters_keep_offsets():
    t = "וואט​סאפ ０​52-5551234"
    assert [(t[a:b], k) for a, b, k in P.spans(t, GIVEN)] == [("０​52-5551234", "phone")]


def test_carried_to_tokens(spark):
    post, tokens = "Hi. call +972-52-555-1234, (03) 555-1234 x@y.example", "Hi call + 972 - 52 - 555 - 1234 ( 03 ) 555 - 1234 x @ y . example"
    posts = spark.createDataFrame([(1, post, tokens, "k"), (None, None, None, "k"), (2, None, "call 052-5551234", "k"), (3, "a", "other 052-5551234", "k"), (4, post * 3000, None, "k")], "post_id long, post_txt string, tokenized_text string, kind string")
    names = spark.createDataFrame([("Dana",), (None,)], "given_name string")
    rows = P.found(posts, names).collect()
    assert {(r.field_name, r.kind, r.start_offset) for r in rows if r.post_id == 1} == {("post_txt", "phone", post.index("+")), ("post_txt", "phone", post.index("(")), ("post_txt", "email", post.index("x@")), ("tokenized_text", "phone", tokens.index("+")), ("tokenized_text", "phone", tokens.index("(")), ("tokenized_text", "email", tokens.index("x @"))}
    assert {(r.post_id, r.start_offset) for r in rows if r.post_id in (2, 3)} == {(2, 5), (3, 6)}
    assert sum(r.post_id == 4 for r in rows) > 6000
    red = {r.post_id: r for r in P.redact(posts, names, b"key").collect()}
    assert red[None].post_txt is None
    assert re.fullmatch(r"Hi\. call \[PHONE \+972-52-\d{3}-\d{4}\], \[PHONE \(03\) \d{3}-\d{4}\] \[EMAIL [0-9a-f]{32}\]", red[1].post_txt)
    assert re.search(r"\d{7}", red[2].tokenized_text).group() == "".join(re.findall(r"\d", red[1].post_txt.split("]")[0]))[-7:]  # linked
    assert P.found(posts.limit(0), names).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 400), st.binary(min_size=1, max_size=4))
def test_permutations(size, key):
    assert sorted(P.permuted(v, size, key, b"t") for v in range(size)) == list(range(size))


def test_check_digit_and_dates():
    assert P.check_digit("12345678") == "2"
    new = P.pseudonym_id("123456782", b"k")
    assert P.check_digit(new[:8]) == new[8] and new != "123456782"
    assert P.pseudonym_date(31, 2, 2000, b"k") is None and P.pseudonym_date(1, 2, 2000, b"k") == P.pseudonym_date(1, 2, 2000, b"k")
    assert re.search(r"\[DATE \d\d/\d\d/\d{4}\]", P.redacted("born 01/02/1980", P.spans("born 01/02/1980", GIVEN), b"k"))


def test_odd_characters_inside_the_only_cue():
    for t, name in (("ש\u200bמי דנה", "דנה"), ("my na\u200bme is Hugo", "Hugo"), ("my n\u0430me is Hugo", "Hugo")):
        assert kinds(t) == [(name, "name")], t
    assert kinds("tal\uff20example.com") == [("tal\uff20example.com", "email")]
    assert P._both(None, "my na\u200bme is Hugo", GIVEN, frozenset())[1] != [] and P._both("a", "my na\u200bme is Hugo", GIVEN, frozenset())[1] != []


def test_announced_names_without_words_behind():
    for t, name in (
        ("nurse Hugo Cohen told me", "Hugo Cohen"), ("I spoke with Hugo Cohen yesterday", "Hugo Cohen"), ("thanks to Hugo I sleep", "Hugo"), ("my sister Rose's knees", "Rose"), ("my husband Hugo Astle drove", "Hugo Astle"),
        ("דיברתי עם דנה אתמול בערב", "דנה"), ("תודה לדנה שעזרה לי", "דנה"), ("אחותי דנה כהן, והכאב", "דנה כהן"),
    ):
        assert kinds(t) == [(name, "name")], t
    for t in ("the nurse told me", "my clinic nurse Advised", "I spoke with the nurse", "thanks to all of you", "thanks to Juvenile Cramp I rest", "my mother rose early, My knees", "my son is ill", "דיברתי עם הרופא", "תודה לכולם", "אחותי אמרה לי"):
        assert kinds(t) == [], t


SURE = frozenset({"sarah", "dana", "דנה"})


def test_listed_names_anywhere():
    for t, names in (
        ("I am Sarah Cohen, my sister Dana Levi lives near me", ["Sarah Cohen", "Dana Levi"]), ("thanks Dana", ["Dana"]), ("My friend Sarah Cohen helped me", ["Sarah Cohen"]), ("פגשתי את דנה אתמול", ["דנה"]),
        ("@Dana hi", []), ("she said dana", []), ("Danakil", []), ("sarah's DANA", ["DANA"]),
    ):
        assert [t[a:b] for a, b, k in P.spans(t, GIVEN | SURE, SURE) if k == "name"] == names, t


def test_listed_names_that_are_words(spark):
    rows = [(i, "there is hope, Rose said. nurse Dana was kind") for i in range(4)] + [(9, "nurse Hope was kind. Hope rose"), (10, None), (11, "פגשתי את דנה")]
    rows += [(20 + i, "mail rose@x.example. V. Zimbelle from the group said so, dana (a) x.example") for i in range(9)]
    posts = spark.createDataFrame([(i, t, None) for i, t in rows], "post_id long, post_txt string, tokenized_text string")
    assert P.ordinary_words(posts, frozenset({"hope", "rose", "dana", "דנה"})) == {"hope"}
    names = spark.createDataFrame([("Hope",), ("Rose",), ("Dana",), ("דנה",), (None,)], "given_name string")
    found = P.find(posts, names, b"k").where("kind = 'name'").collect()
    text = dict(rows)
    assert {(r.post_id, text[r.post_id][r.start_offset : r.end_offset]) for r in found} == {(i, n) for i in range(4) for n in ("Rose", "Dana")} | {(9, "Hope"), (11, "דנה")} | {(20 + i, "V. Zimbelle") for i in range(9)}


def test_streets_and_other_ways():
    for t, want in (
        ("My home is 12 Elm Crescent", ("12 Elm Crescent", "address")), ("14 Oak Terrace", ("14 Oak Terrace", "address")), ("проспект Мира 12", ("проспект Мира 12", "address")), ("write to dana\uff20mail.com", ("dana\uff20mail.com", "email")),
        ("five two three four five six seven eight", ("five two three four five six seven eight", "phone")), ("irene (a) klinik.example", ("irene (a) klinik.example", "email")), ("ת.ז. שלי, כפי שמופיע ברישום הישן, 123456782", None),
    ):
        assert kinds(t) == ([want] if want else []), t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([
    "dana", "@", "mail.com", "(a)", "[at]", "at", "dot", "שטרודל", "052-5551234", "+972 (52) 555 - 1234", "8 (912) 345-67-89", "00 972", "zero", "five", "אפס", "ноль", "12", "7/3", "Elm", "Oak", "Crescent", "St.", "lane", "רחוב", "שד'", "הרצל", "проспект", "Мира",
    "ת.ז.", "id", "паспорт", "123456782", "0-0036689-7", "A 1234567", "on the form", "born", "date of birth:", "01/02/1980", "nurse", "Hugo", "was kind", "דיברתי עם", "דנה", "מהקבוצה", "כתבה", "שמי", "ד\"ר", "my sister", "regards,", "меня зовут", "Иван", ",", ".", "\n", "\u200b",
]), min_size=1, max_size=12), st.sampled_from(["", " ", "  "]))
def test_no_cue_refuses_a_span(words, gap):
    t = gap.join(words) if gap else " ".join(words).upper()
    assert P.spans(t, GIVEN, SURE) == P.spans(t, GIVEN, SURE, cues=False)


def test_pseudonyms_link_the_same_number_only():
    key = b"k"
    digits = lambda t: re.sub(r"\D", "", P.pseudonym("phone", t, key))[-7:]
    assert digits("052-1234567") == digits("+972-52-123-4567") == digits("00972 52 1234567") == digits("zero five two one two three four five six seven") != digits("03-1234567")
    assert P.pseudonym("phone", "052-1234567", key) != P.pseudonym("phone", "052-1234567", b"other")
    assert len({P.pseudonym("name", f"n{i}", key) for i in range(1000)}) == 1000
