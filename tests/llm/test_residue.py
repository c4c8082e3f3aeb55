from lexweave.llm import residue

BAD = [
    "Hello {{user_name}}, it hurts", "x [[DATE]] y", "a ${member.nick} b", "<%= DATE %> hi", "{% signature %}", "%%body%%", "@@post.title@@", "text __THREAD_TITLE__ more", "so {first_name} said", "[INSERT TEXT HERE]", "[הכנס טקסט כאן] ועוד",
    "404 Not Found", "Please enable JavaScript to view this page.", "  Loading...\n403 Forbidden\nLogin | Register", "xxx xxx xxx", "lorem ipsum dolor sit amet.", "Доступ запрещён. Войдите на форум.\nLogin | Register", "אין לך הרשאה לצפות בהודעה זו. יש להתחבר.\nLogin | Register", "PAGE  NOT  FOUND",
    "Skip to content\nZealosia\n500 Internal Server Error\nLogin | Register",
]
GOOD = [
    "I typed [sigh] and left", "the list {a, b, c} of the doctor", "the form was full of [ ] blanks", "doses {5, 10, 20} mg", "my head hurts <|endoftext|> be well", "room 404 on the fourth floor, and my knees hurt every time I walk", "the clinic site gave me a 404 page again, any idea why it happens to all of us here?",
    "my son learns JavaScript and Python and I am tired of my knees", '"Access denied. You do not have permission to view this topic." that is what the site of my clinic answers me', "Hi\nis there hope for me after the winter and all of the pills I took?\n> Access denied. You do not have permission", "", "  \n", None, "email me at some_name or my_file",
]


def test_cases(spark):
    rows = [(i, t, "d") for i, t in enumerate(BAD)] + [(100 + i, t, "d") for i, t in enumerate(GOOD)] + [(None, "404 Not Found", "d"), (0, BAD[0], "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string")
    found = {r.doc_id for r in residue.found(df).collect()}
    assert {t for i, t in enumerate(BAD) if i not in found} == set()
    assert {GOOD[i - 100] for i in found if i >= 100} == set()
    assert residue.clean(df).count() == len(GOOD) + 1
    assert residue.found(df.limit(0)).count() == 0


def test_blank_slots(spark):
    rows = [(i, f"Hello {{{{n{i}}}}}, you have a new reply in {{{{t}}}}") for i in range(4)] + [(9, "Hello , you have a new reply in "), (10, "I have a new reply in mind")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in residue.found(df).collect()} == {0, 1, 2, 3, 9}


def test_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 200_000), (2, "word " * 100_000 + "{{x}}")], "doc_id long, text string")
    assert [r.doc_id for r in residue.found(df).collect()] == [2]


def test_furniture_joined_on_one_line(spark):
    heads, feet = ["404 Not Found", "503 Service Unavailable", "Access denied", "Database connection failed: too many clients"], ["Request id 00149b", "Powered by board engine, build 91877c", "Return to the index of all boards"]
    rows = [(i, "\n".join([h, *feet])) for i, h in enumerate(heads)]
    rows += [(10, f"{heads[3]}\n{feet[0]} {feet[1]}"), (11, f"{heads[0]}\n{feet[2]} {feet[0]} {feet[1]}"), (12, f"{heads[1]}\n{feet[2]} | {feet[1]} | {feet[0]}")]
    rows += [(20, f"{heads[0]}\n{feet[0]} and my knees hurt all the same since the winter {feet[1]}"), (21, f"{heads[0]}\n{feet[0]} {feet[1]} is what I see when I come here in the evening")]
    # a copied post keeps its message, however often it stands
    rows += [(30 + i, f"{heads[0]}\nthat is what I see when I come here in the evening with my knees") for i in range(5)]
    found = {r.doc_id for r in residue.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0, 1, 2, 3, 10, 11, 12}


def test_blank_forms_outnumber_filled_ones(spark):
    line = "Hello {}, you have a new reply in {}"
    rows = [(i, line.format(f"{{{{n{i}}}}}", "{{t}}")) for i in range(4)] + [(10 + i, line.format("", "")) for i in range(30)]
    # ordinary sentences of the same words outnumber the template and what looks like its blanks
    rows += [(100 + i, "the {{n}} of my knees") for i in range(3)] + [(110, "the  of my knees")] + [(120 + i, "the of my knees") for i in range(5)]
    found = {r.doc_id for r in residue.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {*range(4), *range(10, 40), *range(100, 103)}


def _pages(n: int) -> list[str]:
    cores = ["404 Not Found", "Доступ запрещён. Войдите на форум.", "המערכת בתחזוקה", "Ce forum dort", "Kein Zutritt hier"]
    feet = ["Request id {:06x}", "Login | Register", "Powered by board engine, build {:06x}", "Zurueck"]
    return [f"{cores[i % 5]}\n{feet[i % 4].format(i * 7919)}" + (f"\n{feet[(i + 1) % 4].format(i * 31)}" if i % 3 == 0 else "") for i in range(n)]


def test_pages_are_learned_beyond_the_listed_cues(spark):
    # one listed core; the others share furniture with it. Posts repeat sentences among their own, and copies of a post count once
    rows = list(enumerate(_pages(60)))
    posts = [f"my knees hurt since day {i}x{'abcdefgh'[i % 8]}{i}q\nany advice for me\nthanks in advance" for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(posts)] + [(200 + i, "I sleep badly\nsince the winter came\nand my son is ill") for i in range(9)]
    found = {r.doc_id for r in residue.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == set(range(60))


def test_delimiters_are_learned(spark):
    rows = [(i, f"hello {{{{{n}}}}} there") for i, n in enumerate(("user_name", "date", "title", "body"))] + [(10 + i, f"dear ~{n}~ hi") for i, n in enumerate(("user_name", "date", "title", "board_x"))]
    rows += [(20, "a *sigh* b"), (21, "so *date* it"), (22, "x *much* y"), (23, "z *more* u")]
    found = {r.doc_id for r in residue.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0, 1, 2, 3, 10, 11, 12, 13}


def test_a_bare_name_in_a_slot(spark):
    rows = [(i, f"Hello {{{{user_name}}}}, you have a new reply in topic {i}") for i in range(4)] + [(9, "Hello user name, you have a new reply in topic 8"), (10, "Hello Dana, you have a new reply in topic 8")]
    found = {r.doc_id for r in residue.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0, 1, 2, 3, 9}


def test_bare_numbers_are_no_messages(spark):
    rows = [(1, "404"), (2, "12"), (3, "Thanks all\n12"), (4, "404 Not Found\nb12ea8"), (5, "503 Service Unavailable\n00ff11"), (6, "Access denied\n7c7c7c"), (7, "Access denied\nLogin | Register"), (8, "404 Not Found\nLogin | Register"), (9, "503 Service Unavailable\nLogin | Register"), (10, "503 Service Unavailable\nLogin | Register 9d9d9d")]
    found = {r.doc_id for r in residue.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1, *range(4, 11)}
