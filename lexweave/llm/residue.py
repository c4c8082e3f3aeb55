r"""Problem 10: template residue, filler and error pages in place of posts.

The corpus is read once, in Arrow partitions: texts are cut into lines and segments (lines and sentences), and of each the
static part is kept as a hash, with numbers and ids as slots. Everything else works on these hashes, so that records with
the same static part are aligned over the whole corpus:

* slots that keep a variable name, an instruction or nothing. Some delimiters are known to be those of templates; a name that stands
  in them, or in several kinds of delimiters, is a variable, and delimiters that mostly hold variables are learned as those
  of templates. An aligned line whose slots are empty is a blank form, one that has a variable's bare name there keeps a default.
* whole-page templates, induced by repetition and structure: the segments that repeat and stand mostly in documents which
  consist of nothing else, taken to the fixed point, are the vocabulary of templates; copies of one document count once.
  Listed cues only confirm: what shares pages with a confirmed segment belongs to error pages and notices, in whatever words
  or language. A document of such segments is a page. Beside it, messages with a listed cue are cores also where they
  stand once: segments that stand mostly in pages with a core (over all documents) are page furniture, and a document is a page
  when it has a core and nothing but cores, furniture and a short title, on lines of their own or joined.

Defined results: null and blank texts are no cases; posts that mention or quote a message keep their own sentences and are
no cases; brackets around other things (lists, ``[sigh]``, empty brackets in prose, special tokens) are no placeholders;
repeated documents each count; rows with a null id are left out; extra columns are ignored. A variable's name has at most 61
characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.lookalikes import _quoted
from lexweave.session import cut

_NAME = r"[\p{L}_][\p{L}\p{N}_. -]{0,60}?"
#: Delimiters that only templates use.
STRONG = "|".join(
    (rf"\{{\{{[{{#/&^>]?\s*{_NAME}\s*\}}?\}}\}}", rf"\[\[\s*{_NAME}\s*\]\]", rf"\$\{{\s*{_NAME}\s*\}}", rf"<%[=-]?\s*{_NAME}\s*-?%>", rf"\{{%[=-]?\s*{_NAME}\s*-?%\}}", rf"%%\s*{_NAME}\s*%%", rf"@@\s*{_NAME}\s*@@", rf"(?<![\p{{L}}\p{{N}}_])__{_NAME}__(?![\p{{L}}\p{{N}}_])", r"#\{\s*[\p{L}_][\p{L}\p{N}_.]*\s*\}", r"<<\s*[\p{L}_][\p{L}\p{N}_. ]*>>")
)
#: Brackets that other text uses as well.
WEAK = rf"(?<![\[{{$%#])(?:\{{\s*{_NAME}\s*\}}|\[\s*{_NAME}\s*\]|<\s*[A-Z][A-Z_ ]{{2,40}}>)(?![\]}}])"
#: Any marks around a name: delimiters that may be learned.
ANY_MARKS = rf"(?<![\p{{L}}\p{{N}}])[^\p{{L}}\p{{N}}\s.,;:!?'\"()-]{{1,3}}\s?[\p{{L}}_][\p{{L}}\p{{N}}_.]{{0,60}}(?: [\p{{L}}\p{{N}}_.]+){{0,3}}\s?[^\p{{L}}\p{{N}}\s.,;:!?'\"()-]{{1,3}}(?![\p{{L}}\p{{N}}])"
#: What every delimiter holds.
MARKED = r"[{}\[\]<>|~^$#*=%@\\/‹›«»“”„⟦⟧【】]\s?[\pL_]|__[\pL]"
#: An identifier, or an instruction to the one who fills the form in.
IDENTIFIER = r"^(?:[A-Za-z]+(?:[_.][A-Za-z]+)+|[A-Z]{2,}(?:_[A-Z]+)+)$"
INSTRUCTION = r"(?i)\b(?:insert|enter|type|add|put|write)\b.*\b(?:here|text|name|title|date)\b|\bgoes? here\b|\byour (?:name|text|title|post|message)\b|הכנס|הקלד|הזן|כתוב כאן|вставьте|введите|ins[ée]re[rz]|saisissez|أدخل|اكتب هنا"

#: Cues of messages that stand in place of a post (fixed values).
ERROR = (
    r"\b[45]\d\d\b[ :,-]*(?:not found|forbidden|service unavailable|internal server error|bad gateway|gateway|unauthorized|error)|(?:error|erreur|ошибка|שגיאה|שגיאת|خطأ)[^.!?]{0,25}\b[45]\d\d\b|(?:bad gateway|http(?: error| status)?)\W{0,3}[45]\d\d|^\W*[45]\d\d\W*$"
    r"|page (?:you (?:asked|requested|are looking) .*|was |could )?not (?:be )?found|could not be found|no longer exists|page introuvable|n.existe plus|не найден|тема удален|страница удален|הדף לא נמצא|הדף שביקשת|אינו קיים|الصفحة غير موجودة"
    r"|fatal error|call to undefined|uncaught exception|stack trace|warning: \w+\(\)|supplied argument|database (?:connection|error)|too many (?:clients|connections)|gateway time-?out|upstream|internal server error|שגיאת שרת|erreur interne|внутренняя ошибка|service unavailable|server error"
)
REFUSAL = r"access (?:is )?denied|do not have permission|permission denied|must be (?:a registered|logged)|session has expired|log in again|please log ?in|accès refusé|veuillez vous connecter|доступ запрещ|войдите на|אין לך הרשאה|יש להתחבר|הגישה נדחתה|تم رفض|يجب تسجيل الدخول"
SCRIPTS = r"(?:enable|needs?|requires?|without|turn on|activate|activer|включите|להפעיל|תפעיל|تفعيل)\W+(?:\w+\W+){0,3}?(?:java ?script|scripts?|cookies)|java ?script[^.!?]{0,40}(?:disabled|required|turned off|pour continuer|чтобы|כדי)|scripts? (?:turned off|disabled|enabled|must be)|checking your browser|scripts must be allowed"
FILLER_WORDS = r"xxx+|asdf\w*|qwer\w*|test|тест|בדיקה|foo|bar|blah|tbd|todo"
FILLER_PHRASES = (
    r"lorem ipsum[\p{L} ,.]*|לורם איפסום[\p{IsHebrew} ,.]*|(?:your |the )?(?:post|page|message)? ?content (?:goes )?here|(?:type|write|enter) (?:your )?(?:message|text|post) here|(?:sample|placeholder|dummy|example) text(?: goes here)?|text goes here"
    r"|texte (?:de remplissage|d.exemple)|текст[- ]заполнитель|пример текста|здесь будет текст|טקסט לדוגמה|טקסט לדוגמא|כאן יבוא(?: תוכן ההודעה| טקסט| התוכן)?|تجربة|نص تجريبي"
)
#: Over a whole raw text, for an engine that reads all alternatives at once: any cue, or a status code by itself.
ANY_CUE = (
    rf"(?i)(?:{ERROR}|{REFUSAL}|{SCRIPTS}|{FILLER_PHRASES}".replace(r"\b", "").replace(r"\p{IsHebrew}", r"\p{Hebrew}").replace(" ?", r"\s*").replace(" ", r"\s+")
    + rf"|(?:^|[^\pL])(?:{FILLER_WORDS})(?:$|[^\pL])|(?:^|\D)[45]\d\d(?:\D|$))"
)
#: A blank slot leaves a gap in its line: a mark behind a space, two spaces, or an end behind a space or colon.
GAP = r"[^\S\n][,.!?;]|\S[^\S\n][^\S\n]|(?:[^\S\n]|:)$"


def _re2(pattern: str) -> str:
    """A pattern of listed cues for an engine that reads all alternatives at once and knows word boundaries of ASCII only."""
    return pattern.replace(r"\p{IsHebrew}", r"\p{Hebrew}")


def statement() -> str:
    """The SQL over a batch ``b(k, x)``: what is kept of every document."""
    between, words = r"[^\pL\pN]+", rf"(?i) (?:{FILLER_WORDS}|0|123\d*) "  # every word stands between spaces of its own
    phrases = _re2(f"(?i){FILLER_PHRASES}")
    bare = f"regexp_replace(' ' || regexp_replace(regexp_replace(z.s, {_quoted(phrases)}, ' ', 'g'), {_quoted(between)}, '  ', 'g') || ' ', {_quoted(words)}, ' ', 'g')"
    filler = f"(regexp_matches(z.s, {_quoted(_re2(f'(?i){FILLER_PHRASES}|{FILLER_WORDS}|123'))}) AND trim({bare}) = '')"
    quoted = "substr({}, 1, 1) IN ('>', chr(34), '“', '„', '«')"
    core = f"regexp_matches(z.s, {_quoted(f'(?i)(?:{ERROR}|{REFUSAL}|{SCRIPTS})')}) AND NOT {quoted.format('z.s')} OR {filler}"

    def masked(x: str) -> str:
        return rf"regexp_replace({x}, '\b[0-9a-f]{{6,40}}\b|\d+', '0', 'g')"

    def split(x: str) -> str:
        cut_up = rf"regexp_replace(regexp_replace(regexp_replace({x}, '([.!?…])\s+', '\1' || chr(10), 'g'), '\s+[-–—]\s+', chr(10), 'g'), ' +', ' ', 'g')"
        return rf"list_filter(list_transform(string_split({cut_up}, chr(10)), lambda s: trim(s)), lambda s: regexp_matches(s, '[\pL\pN]'))"

    def kept(parts: str, static: str, text: str, is_core: str) -> str:
        fields = f"'h': (hash(z.k) >> 1)::BIGINT, 'k': {text}, 'w': len(list_filter(string_split(z.s, ' '), lambda t: t NOT IN ('>', '<', '|', '/', '-', '–', '—', '·', '•', '»', '«', '*', '&', '+', '=', '~', '#')))::INTEGER, 'q': {quoted.format('z.s')}, 'core': {is_core}"
        return f"list_transform(list_transform({parts}, lambda s: {{'s': s, 'k': trim({static}, ' .,:;!?')}}), lambda z: {{{fields}}})"

    # numbers and ids become one digit; in the few texts with a cue only behind the cue's own check
    return rf"""
WITH p AS (SELECT k, x, coalesce(regexp_matches(x, {_quoted(MARKED)}), false) AS marked, regexp_matches(x, {_quoted(ANY_CUE)}) AS cue, regexp_replace(translate(lower(x), chr(13), chr(10)), '[^\S\n ]', ' ', 'g') AS y,
    string_split(regexp_replace(lower(regexp_replace(translate(x, chr(13), chr(10)), {_quoted('(?m)' + GAP)}, chr(1) || '\0', 'g')), '[^\pL\n\x01]+', ' ', 'g'), chr(10)) AS ls FROM b),
c AS (SELECT *, list_filter(list_transform(ls, lambda s: {{'s': trim(replace(s, chr(1), '')), 'gap': contains(s, chr(1))}}), lambda z: length(z.s) - length(replace(z.s, ' ', '')) >= 2) AS lz FROM p)
SELECT k AS doc_id, CASE WHEN marked THEN x END AS t,
  CASE WHEN cue THEN {kept(split('y'), masked('s'), 'z.k', core)} ELSE {kept(split(masked('y')), 's', 'NULL::VARCHAR', 'false')} END AS segs,
  list_transform(lz, lambda z: {{'s': substr(md5(z.s), 1, 16), 'gap': z.gap}}) AS lines
FROM c"""


_SCAN = "doc_id long, t string, segs array<struct<h: bigint, k: string, w: int, q: boolean, core: boolean>>, lines array<struct<s: string, gap: boolean>>"


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, t, segs, lines`` of every document, written: hashes of segments and lines, the text only where it may hold a slot."""
    sql = statement()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        seg = pa.struct([("h", pa.int64()), ("k", pa.string()), ("w", pa.int32()), ("q", pa.bool_()), ("core", pa.bool_())])
        line = pa.struct([("s", pa.string()), ("gap", pa.bool_())])
        schema = pa.schema([("doc_id", pa.int64()), ("t", pa.string()), ("segs", pa.list_(seg)), ("lines", pa.list_(line))])
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                con.register("b", pa.Table.from_batches([batch.slice(at, 2000)], schema=pa.schema([("k", pa.int64()), ("x", pa.string())])))
                yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()
                con.unregister("b")

    return cut(docs.select(F.col("doc_id").alias("k"), F.col("t").alias("x")).mapInArrow(run, _SCAN))


def _word_count(segment: Column) -> Column:
    return F.size(F.filter(F.split(segment, r"[^\p{L}\p{N}']+"), lambda w: w != ""))


def placeholders(scan: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """``doc_id`` of the documents with a slot that keeps a variable name or an instruction, and the ``key`` of every variable.

    Delimiters that wrap at least ``least`` different variables, and mostly variables, are learned.
    """
    marked = scan.where("t is not null").select("doc_id", "t")
    found = lambda pattern, kind: F.transform(F.regexp_extract_all("t", F.lit(f"({pattern})"), 1), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("w")))
    wrapped = marked.select("doc_id", F.explode(F.array_distinct(F.concat(found(STRONG, "strong"), found(WEAK, "weak"), found(ANY_MARKS, "any")))).alias("p"))
    outer = r"^[^\p{L}]*|[^\p{L}\p{N}]*$"
    slots = cut(wrapped.select("doc_id", "p.kind", F.trim(F.regexp_replace("p.w", outer, "")).alias("name"), F.regexp_extract("p.w", r"^[^\p{L}\s]+", 0).alias("open"), F.regexp_extract("p.w", r"[^\p{L}\p{N}\s]+$", 0).alias("close")).withColumn("key", F.lower("name")))
    # names that templates' delimiters hold, or that listed brackets wrap in several ways, are variables
    by_name = slots.where("kind <> 'any'").groupBy("key").agg(F.max(F.col("kind") == "strong").alias("known"), F.min("open").alias("a"), F.max("open").alias("b"))
    variables = cut(by_name.where("known or a <> b").select("key"))
    marks = slots.where("kind = 'any'").join(variables.withColumn("is_variable", F.lit(True)), "key", "left").groupBy("open", "close", "key").agg(F.first("is_variable").alias("v")).groupBy("open", "close").agg(F.count("v").alias("held"), F.count(F.lit(1)).alias("all"))
    learned = marks.where((F.col("held") >= least) & (F.col("held") * 2 > F.col("all"))).select("open", "close")
    listed = slots.where("kind <> 'any'").select("open", "close").distinct()
    learned = learned.join(listed, ["open", "close"], "left_anti")  # listed brackets have their own rules
    sure = (F.col("kind") == "strong") | ((F.col("kind") == "weak") & (F.col("name").rlike(IDENTIFIER) | F.col("name").rlike(INSTRUCTION)))
    by_form = slots.where(sure).select("doc_id")
    by_corpus = slots.where((F.col("kind") == "weak") & ~sure).join(variables, "key", "left_semi").select("doc_id")
    by_marks = slots.where("kind = 'any'").join(learned, ["open", "close"], "left_semi").select("doc_id")
    return by_form.unionByName(by_corpus).unionByName(by_marks).distinct(), variables


def _key(static: Column) -> Column:
    return F.substring(F.md5(static), 1, 16)


def blank_forms(scan: DataFrame, variables: DataFrame, least_records: int = 3) -> DataFrame:
    """``doc_id`` of documents with a line that is aligned with a template line but has nothing in its slots, or a variable's bare name."""
    marked = scan.where("t is not null").select("doc_id", F.explode(F.split("t", r"[\n\r]+")).alias("line")).where(F.col("line").rlike(STRONG))
    letters = lambda c: F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}]+", " ")))
    template = cut(marked.select("line", letters(F.regexp_replace("line", f"{STRONG}|{WEAK}", " ")).alias("static")).where(_word_count(F.col("static")) >= 3))
    known = template.groupBy("static").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_records).select(_key(F.col("static")).alias("s"), "n")
    # the same lines with a variable's name where the slot stands; a letter that no text uses marks the slot
    gap = "\u0298"
    shapes = template.select(F.regexp_extract_all("line", F.lit(f"({STRONG})"), 1).alias("w"), letters(F.regexp_replace("line", STRONG, f" {gap} ")).alias("shape")).where(F.size("w") == 1).groupBy("shape").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_records)
    bare = shapes.crossJoin(F.broadcast(_few(variables))).select(_key(F.replace("shape", F.lit(gap), letters(F.col("key")))).alias("s")).distinct()
    lines = scan.select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.s", "x.gap")
    kept_name = lines.join(bare, "s", "left_semi").select("doc_id")
    met = cut(lines.join(known, "s").groupBy("doc_id", "s", "gap").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")))
    # a sentence that often stands without any slot is no template; the blank ones are not counted against it
    counts = met.groupBy("s").agg(F.sum(F.when(F.col("gap"), F.col("k")).otherwise(0)).alias("blanks"), F.sum(F.when(F.col("gap"), 0).otherwise(F.col("k"))).alias("m"))
    blank = met.where("gap").join(counts, "s").where("m < n + blanks").select("doc_id")
    return blank.unionByName(kept_name).distinct()


def _few(variables: DataFrame, most: int = 10_000) -> DataFrame:
    """The variables, checked to be few: templates have no more."""
    if variables.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} variables")
    return variables


def _edged(k: Column) -> Column:
    """A static part without the marks around it, so that pieces of a joined line meet those that stand alone."""
    return F.regexp_replace(k, r"^[^\p{L}\p{N}#]+|[^\p{L}\p{N}#]+$", "")


def joined(parts: DataFrame, furniture: DataFrame) -> DataFrame:
    """``h`` of the segments (``h, k``) that consist of pieces of ``furniture`` (``k``) on one line, however many."""
    pieces = cut(furniture.select(_edged(F.col("k")).alias("k")).where("k <> ''").select(F.xxhash64("k").alias("p"), F.size(F.split("k", " ")).alias("n")).groupBy("p").agg(F.max("n").alias("n")))
    most = pieces.agg(F.max("n")).first()[0]
    if most is None:
        return parts.select("h").limit(0)
    most += 2  # marks between two pieces are words of their own
    w = parts.select("h", F.split("k", " ").alias("w")).where(F.size("w") > 1)
    piece = lambda a, n: F.xxhash64(_edged(F.array_join(F.slice("w", a, n), " ")))
    up_to = lambda n: F.sequence(F.lit(1), F.least(n, F.lit(most)))
    known = pieces.select("p")
    # most prose neither begins nor ends with a piece
    front = w.select("h", F.explode(F.transform(up_to(F.size("w")), lambda n: piece(F.lit(1), n))).alias("p")).join(known, "p", "left_semi").select("h").distinct()
    w = w.join(front, "h", "left_semi")
    back = w.select("h", F.explode(F.transform(up_to(F.size("w")), lambda n: piece(F.size("w") - n + 1, n))).alias("p")).join(known, "p", "left_semi").select("h").distinct()
    w = cut(w.join(back, "h", "left_semi"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda a: F.transform(up_to(F.size("w") - a + 1), lambda n: F.struct((a + n - 1).alias("b"), a.alias("a"), piece(a, n).alias("p")))))
    spans = w.select("h", F.size("w").alias("size"), F.explode(spans).alias("x")).select("h", "size", "x.a", "x.b", "x.p").join(known, "p", "left_semi")
    # places that pieces reach from the line's beginning, in the order of their ends; a piece is never longer than ``most``
    reached = F.aggregate(F.array_sort(F.collect_set(F.struct("b", "a"))), F.array(F.lit(0)), lambda r, x: F.when(F.array_contains(r, x["a"] - 1), F.array_union(F.filter(r, lambda y: y >= x["b"] - most), F.array(x["b"]))).otherwise(r))
    return spans.groupBy("h", "size").agg(reached.alias("r")).where(F.array_contains("r", F.col("size"))).select("h")


def templates(segs: DataFrame, whole: DataFrame, core: DataFrame, title: int = 4, least: int = 3, share: float = 0.5) -> DataFrame:
    """``h`` of the segments of page templates that are confirmed by one in ``core``.

    ``segs`` has one row for each document and segment, ``whole`` one document for all with the same segments. A document is closed
    when all of its segments but a short title are in the vocabulary, and a segment stays in it when it stands in
    ``least`` closed documents and these are ``share`` of all that hold it. The vocabulary only shrinks, so the rounds end.
    """
    s = segs.select("doc_id", "h", "w", "q").join(whole, "doc_id", "left_semi")
    page = cut(s.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    size = page.count()
    while True:
        new = F.col("p").isNull()
        flagged = s.join(page.select("h", F.lit(1).alias("p")), "h", "left").groupBy("doc_id")
        flagged = flagged.agg(F.sum(new.cast("int")).alias("u"), F.max(F.when(new, F.col("w")).otherwise(0)).alias("uw"), F.max(new & F.col("q")).alias("uq"), F.count("p").alias("k"))
        closed = flagged.where((F.col("k") > 0) & ~F.col("uq") & (F.col("u") <= 1) & (F.col("uw") <= title)).select("doc_id")
        s = cut(s.join(closed, "doc_id", "left_semi"))
        held = s.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
        page = cut(page.join(held, "h").where((F.col("c") >= least) & (F.col("c") >= share * F.col("n"))).select("h", "n"))
        before, size = size, page.count()
        if size == before:
            break
    # a segment is confirmed where several, or most, of its closed documents hold a confirmed one
    s = cut(s.join(page.select("h"), "h", "left_semi").select("doc_id", "h"))
    known = cut(page.select("h").join(core, "h", "left_semi"))
    size = known.count()
    while size:
        pages_of = s.join(known, "h", "left_semi").select("doc_id", F.lit(1).alias("l")).distinct()
        near = s.join(pages_of, "doc_id", "left").groupBy("h").agg(F.count("l").alias("l"), F.count(F.lit(1)).alias("n"))
        known = cut(near.where((F.col("l") >= least) | (F.col("l") >= share * F.col("n"))).select("h").unionByName(known).distinct())
        before, size = size, known.count()
        if size == before:
            break
    return known


def pages(scan: DataFrame, long: int = 8, title: int = 4, least_share: float = 0.5) -> DataFrame:
    """``doc_id`` of documents that are nothing but a message, filler and page furniture.

    Furniture is counted in all documents with a core, and only what is left of a line without it is judged. A segment
    of more than ``long`` words is furniture when it stands under different messages; a post that was copied keeps its own.
    """
    # a static part without letters says nothing: a bare status code is a core where it stands, other bare numbers are none
    bare = lambda x: F.coalesce(~x.k.rlike(r"\p{L}"), F.lit(False))
    full = scan.where(F.size("segs") > 0)
    rows = full.select("doc_id", F.array_distinct(F.transform("segs", lambda x: F.struct(x.h.alias("h"), x.k.alias("k"), x.w.alias("w"), x.q.alias("q"), (x.core & bare(x)).alias("own")))).alias("segs"))
    segs = cut(rows.select("doc_id", F.explode("segs").alias("x")).select("doc_id", "x.*"))
    whole = rows.groupBy(F.xxhash64(F.array_sort(F.transform("segs", lambda x: x.h))).alias("g")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    core = cut(full.select(F.explode(F.transform(F.filter("segs", lambda x: x.core & ~bare(x)), lambda x: x.h)).alias("h")).distinct())
    learned = templates(segs, whole, core, title)
    some = segs.join(learned, "h", "left_semi").select("doc_id").distinct()
    made = segs.join(some, "doc_id", "left_semi").join(learned.withColumn("p", F.lit(1)), "h", "left").groupBy("doc_id")
    made = made.agg(F.sum(F.col("p").isNull().cast("int")).alias("u"), F.max(F.when(F.col("p").isNull(), F.col("w")).otherwise(0)).alias("uw"), F.max(F.col("p").isNull() & F.col("q")).alias("uq"), F.count("p").alias("k"))
    of_templates = made.where((F.col("u") == 0) | ((F.col("u") == 1) & (F.col("uw") <= title) & ~F.col("uq") & (F.col("k") > 1))).select("doc_id")

    known = segs.join(core.withColumn("is_core", F.lit(True)), "h", "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)) | F.col("own"))
    held = cut(known.join(segs.join(core, "h", "left_semi").select("doc_id").unionByName(segs.where("own").select("doc_id")).distinct(), "doc_id", "left_semi"))
    held = held.join(held.where("q and not is_core").select("doc_id").distinct(), "doc_id", "left_anti")
    message = held.where("is_core").groupBy("doc_id").agg(F.xxhash64(F.array_sort(F.collect_set("h"))).alias("message"))  # the cores of one document
    parts = cut(held.where("not is_core").join(message, "doc_id"))
    # what stands in one page only is no furniture, and only a short one can be a title
    in_pages = parts.groupBy("h").agg(F.first("k", ignorenulls=True).alias("k"), F.max("w").alias("w"), F.count(F.lit(1)).alias("in_pages"), F.min("message").alias("a"), F.max("message").alias("b"))
    able = in_pages.where((F.col("w") <= title) | ((F.col("in_pages") > 1) & ((F.col("w") <= long) | (F.col("a") != F.col("b")))))
    everywhere = segs.join(able.select("h"), "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    share = cut(able.join(everywhere, "h").where(F.col("in_pages") >= F.col("n") * least_share).select("h", "k", "w", "n"))
    furniture = share.where("n > 2")
    # furniture stands mostly in pages; a title is short and says the same nowhere else in prose
    plain = cut(furniture.select("h").unionByName(share.where(F.col("w") <= title).select("h")).unionByName(learned).distinct())
    rest = parts.join(plain, "h", "left_anti").where("k is not null").groupBy("h").agg(F.first("k").alias("k"))
    prose = parts.select("doc_id", "h").join(plain.unionByName(joined(rest, furniture.where("k is not null"))), "h", "left_anti")
    return held.select("doc_id").distinct().join(prose.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(of_templates).distinct()


def _texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))


def found(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` of every document with residue or in place of a post."""
    scan = scanned(_texts(documents, key, text))
    kept, variables = placeholders(scan)
    return kept.unionByName(blank_forms(scan, variables)).unionByName(pages(scan)).distinct()


def clean(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without residue; null and blank texts stay."""
    return documents.join(found(documents, key, text).withColumnRenamed("doc_id", "__residue"), F.col(key) == F.col("__residue"), "left_anti")
