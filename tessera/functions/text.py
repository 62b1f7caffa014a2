"""Text functions: normalisation, tokens, terms, clipping, identifiers.

All of them are column expressions that stay in the JVM.  White space in
patterns is Unicode-aware, as the compared engines' default is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query, and forms that no rule derives.
STOPWORDS = (
    "a an and are at be been but by can could did do does for from how i if in is it its may me might my of on or our "
    "shall should so that the then these this those to was we were what when where which who why will with would you your"
).split()
PROTECTED = "change check close no not open run set start stop turn use".split()
IRREGULAR = {"children": "child", "feet": "foot", "men": "man", "teeth": "tooth", "women": "woman"}
EMPTY_TOKEN = "__empty__"
_STOP, _TOKEN = frozenset(STOPWORDS), re.compile("[a-z0-9]+")
MAX_TERMS = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def normalize_text(text: Column) -> Column:
    """Without any white space, in lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def detect_language(text: Column) -> Column:
    """Zh if there is any ideograph of the basic block, else en."""
    return F.when(F.coalesce(text, F.lit("")).rlike("[一-鿿]"), "zh").otherwise("en")


def normalize_language(language: Column) -> Column:
    """En, zh or null; null never equals a filter."""
    low = F.lower(F.trim(language))
    return F.when(low.startswith("en"), "en").when(low.startswith("zh") | low.isin("cn", "chinese"), "zh")


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def english_tokens(text: Column) -> Column:
    """Lower-cased alphanumeric runs without stop words."""
    return F.filter(raw_tokens(text), lambda t: ~t.isin(STOPWORDS))


def _ends(token: Column, endings: str) -> Column:
    return reduce(lambda a, b: a | b, (token.endswith(e) for e in endings.split()))


def _undouble(stem: Column) -> Column:
    last = F.right(stem, F.lit(1))
    twice = (F.length(stem) > 2) & (last == F.substring(stem, -2, 1)) & ~last.isin(*"aeiou")
    return F.when(twice, _cut(stem, 1)).otherwise(stem)


def _cut(token: Column, n: int) -> Column:
    return F.left(token, F.length(token) - n)


def stem(token: Column) -> Column:
    """The light stem of a token; the token itself where no rule holds."""
    cut = lambda n: _cut(token, n)
    rules = [
        (token.isin(PROTECTED), token),
        *((token == form, F.lit(base)) for form, base in IRREGULAR.items()),
        ((F.length(token) <= 3) | (F.translate(token, "0123456789", "") == ""), token),
        (token.endswith("ies") & (F.length(token) > 4), F.concat(cut(3), F.lit("y"))),
        (token.endswith("ing") & (F.length(token) > 5), _undouble(cut(3))),
        (token.endswith("ied") & (F.length(token) > 4), F.concat(cut(3), F.lit("y"))),
        (token.endswith("ed") & (F.length(token) > 4), _undouble(cut(2))),
        (_ends(token, "sses xes zes ches shes") & (F.length(token) > 4), cut(2)),
        (token.endswith("s"), cut(1)),
    ]
    first, *rest = rules
    return reduce(lambda acc, rule: acc.when(*rule), rest, F.when(*first)).otherwise(token)


class TokenForms:
    """X5 for code that has a text at hand: index tokens, with the forms of a word remembered."""

    KEPT = 300_000

    def __init__(self) -> None:
        self._forms: dict[str, tuple[str, ...]] = {}

    def forms(self, word: str) -> tuple[str, ...]:
        """The word, and its stem where that differs; nothing for a stop word."""
        if (found := self._forms.get(word)) is None:
            if len(self._forms) >= self.KEPT:
                self._forms.clear()
            base = stem_word(word)
            found = self._forms[word] = () if word in _STOP else (word,) if base == word else (word, base)
        return found

    def index_tokens(self, text: str | None) -> list[str]:
        out = list(chain.from_iterable(map(self.forms, _TOKEN.findall((text or "").lower()))))
        return out or [EMPTY_TOKEN]

    def index_counts(self, text: str | None) -> dict[str, int]:
        """How often a text has each of its index tokens; a word's forms are looked up once a text."""
        out: dict[str, int] = {}
        for word, n in Counter(_TOKEN.findall((text or "").lower())).items():
            for form in self.forms(word):
                out[form] = out.get(form, 0) + n
        return out or {EMPTY_TOKEN: 1}


def token_set(text: str | None) -> set[str]:
    """The distinct alphanumeric runs of a text at hand, stop words included."""
    return set(_TOKEN.findall((text or "").lower()))


def stem_word(word: str) -> str:
    """``stem`` of a word that is no column."""
    n = len(word)
    if word in PROTECTED or word in IRREGULAR:
        return IRREGULAR.get(word, word)
    if n <= 3 or not word.strip("0123456789"):
        return word
    if n > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if n > 5 and word.endswith("ing"):
        return _single(word[:-3])
    if n > 4 and word.endswith("ied"):
        return word[:-3] + "y"
    if n > 4 and word.endswith("ed"):
        return _single(word[:-2])
    if n > 4 and word.endswith(("sses", "xes", "zes", "ches", "shes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") else word


def _single(stem: str) -> str:
    return stem[:-1] if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "aeiou" else stem


def index_tokens(text: Column) -> Column:
    """Every token, followed by its stem where that differs; a sentinel for none."""
    forms = F.transform(english_tokens(text), lambda t: F.struct(t.alias("t"), stem(t).alias("s")))
    both = F.flatten(F.transform(forms, lambda f: F.when(f["s"] == f["t"], F.array(f["t"])).otherwise(F.array(f["t"], f["s"]))))
    return F.when(F.size(both) > 0, both).otherwise(F.array(F.lit(EMPTY_TOKEN)))


def query_terms(text: Column, limit: int = MAX_TERMS) -> Column:
    """The first distinct tokens of a query, not stemmed."""
    return F.slice(F.array_distinct(english_tokens(text)), 1, limit)


def local_terms(text: Column) -> Column:
    """Words of three letters or more, and ideograph runs of 2 to 16."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}|[一-鿿]{2,16}"), F.lit(0)))


def alnum(text: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def clip(text: Column, limit: int) -> Column:
    """White space folded, at most ``limit`` characters, no blank end."""
    folded = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.rtrim(F.substring(folded, 1, limit))


def utf8_truncate(text: Column, limit: int, suffix: str = "...") -> Column:
    """At most ``limit`` bytes of UTF-8, cut between characters; the suffix counts.

    A cut inside a character leaves bytes that decode to replacement
    characters at the end; these are dropped.
    """
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit - len(suffix)).cast("string"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(head, "�+$", ""), F.lit(suffix)))


# How a picture's description is marked, and what separates lines.
DESCRIPTION = r"\{\{(?:此图片描述为|图片描述|image description)[:：]\s*(.*?)\}\}"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, s: F.regexp_replace(acc, *s), steps, text)


def markdown_to_index_text(text: Column) -> Column:
    """Markdown as plain words for an index; lines stay, images go, descriptions of pictures stay."""
    # The patterns, in their order.
    steps = [
        (rf"(?is)<PIC:[^>]+>(?:\s*{DESCRIPTION})?", " $1 "),
        (rf"(?is){DESCRIPTION}", " $1 "),
        (r"(?s)```.*?```", " "),
        (r"!\[[^\]]*\]\([^)]+\)", " "),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"`([^`]*)`", "$1"),
        (r"(?md)^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$", " "),
        (r"(?md)^\s{0,3}#{1,6}\s*", ""),
        (r"(?md)^\s*[-*+·]\s*", ""),
        (r"(?md)^\s*[0-9]+[.)]\s+", ""),
        (r"\|", " "),
        (r"[ \t\r\f\x0B]+", " "),
        (r" *\n *", "\n"),
        (r"\n{3,}", "\n\n"),
    ]
    return strip(_replaced(F.coalesce(text, F.lit("")), steps))


def markdown_to_answer(text: Column) -> Column:
    """Markdown as plain text for an answer; a table row becomes its cells behind their headings.

    Dividers, headings, quotes, links, bold and italic lose their marks; images
    and ordinary punctuation stay.
    """
    # The patterns, in their order.
    steps = [
        (r"(?md)^[ \t]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})[ \t]*\n?", ""),
        (r"(?md)^[ \t]{0,3}#{1,6}[ \t]+", ""),
        (r"(?md)^[ \t]{0,3}>[ \t]?", ""),
        (r"(?<!!)\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"\*\*(?=\S)(.+?)(?<=\S)\*\*|__(?=\S)(.+?)(?<=\S)__", "$1$2"),
        (r"(?<!\*)\*(?=\S)(.+?)(?<=\S)\*(?!\*)", "$1"),
        (r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n"),
    ]
    return strip(_replaced(_plain_tables(F.coalesce(text, F.lit(""))), steps))


def _plain_tables(text: Column) -> Column:
    """Lines, with each Markdown table as one line a row.

    A line walks over three states: no table, at the line of dashes, and inside.
    """
    bare = lambda line: strip(line)
    cells = lambda line: F.when(line.contains("|"), F.transform(F.split(F.regexp_replace(bare(line), r"^\|+|\|+\z", ""), r"\|"), bare)).otherwise(F.expr("cast(array() AS array<string>)"))
    lines = F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END)
    rows = F.transform(lines, lambda x: F.struct(x.alias("line"), cells(x).alias("cells")))
    looked = F.transform(rows, lambda r, i: F.struct(r["line"].alias("line"), r["cells"].alias("cells"), _opens_table(r["cells"], F.get(rows, i + 1)["cells"]).alias("opens")))
    start = F.struct(F.expr("cast(array() AS array<string>)").alias("out"), F.expr("cast(array() AS array<string>)").alias("heads"), F.lit(0).alias("state"), F.lit(0).alias("made"))

    def pairs(heads: Column, cells_: Column) -> Column:
        both = F.zip_with(heads, cells_, lambda h, v: F.when((h != "") & (v != ""), F.concat(h, F.lit("："), v)))
        return F.array_join(F.filter(both, lambda p: p.isNotNull()), "；")

    def state(out: Column, heads: Column, at: Column | int, made: Column | int) -> Column:
        at, made = (F.lit(x) if isinstance(x, int) else x for x in (at, made))
        return F.struct(out.alias("out"), heads.alias("heads"), at.cast("int").alias("state"), made.cast("int").alias("made"))

    def closed(acc: Column) -> Column:
        return F.when((acc["state"] == 2) & (acc["made"] == 0), F.array_append(acc["out"], F.array_join(acc["heads"], "；"))).otherwise(acc["out"])

    def step(acc: Column, row: Column) -> Column:
        inside = (acc["state"] == 2) & (F.size(row["cells"]) > 0)
        said = pairs(acc["heads"], row["cells"])
        within = state(F.when(said != "", F.array_append(acc["out"], said)).otherwise(acc["out"]), acc["heads"], 2, acc["made"] + F.when(said != "", 1).otherwise(0))
        opened = state(closed(acc), row["cells"], 1, 0)
        other = state(F.array_append(closed(acc), row["line"]), F.expr("cast(array() AS array<string>)"), 0, 0)
        return F.when(acc["state"] == 1, state(acc["out"], acc["heads"], 2, 0)).when(inside, within).when(row["opens"], opened).otherwise(other)

    return F.array_join(F.aggregate(looked, start, step, closed), "\n")


def _opens_table(heads: Column, dashes: Column) -> Column:
    """Whether a line's cells stand above a line of dashes of as many cells."""
    return F.coalesce((F.size(heads) > 0) & (F.size(dashes) == F.size(heads)) & F.forall(dashes, lambda c: c.rlike(r"^:?-{3,}:?\z")), F.lit(False))


def image_ids(text: Column) -> Column:
    """Names of images in order: the alternative text, else the file's stem."""
    found = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\([^)]*\)"), F.lit(0))
    alt = lambda m: F.trim(F.regexp_extract(m, r"!\[([^\]]*)\]", 1))
    file = lambda m: F.regexp_extract(m, r"([^/()]+?)(?:\.[A-Za-z0-9]+)?\)$", 1)
    return F.transform(found, lambda m: F.when(alt(m) != "", alt(m)).otherwise(file(m)))


def image_placeholders(text: Column, mark: str = "<PIC>") -> Column:
    """Every image replaced by a mark."""
    return F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", mark)


def sentences(text: Column) -> Column:
    """The sentences of a text; an end mark counts before white space or the end.

    What lies between marks and line ends is cut in one pass; pieces without
    such a mark are no sentences.
    """
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]++(?:[.!?](?=\s|\z))?+"), F.lit(0))
    return F.transform(F.filter(pieces, lambda p: F.right(p, F.lit(1)).isin(".", "!", "?")), strip)


def lines_of(text: Column) -> Column:
    """Lines without white space at their ends, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), strip), lambda line: line != "")


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def head_sentences(text: Column, n: int = 2) -> Column:
    """The first sentences, or the first lines of a text without one."""
    lines = F.array_join(F.slice(lines_of(text), 1, n), "\n")
    return let(sentences(text), lambda s: F.when(F.size(s) > 0, F.array_join(F.slice(s, 1, n), " ")).otherwise(lines))


def tail_sentences(text: Column, n: int = 2) -> Column:
    """The last sentences, or the last lines of a text without one."""
    lines = let(lines_of(text), lambda x: F.array_join(_last(x, n), "\n"))
    return let(sentences(text), lambda s: F.when(F.size(s) > 0, F.array_join(_last(s, n), " ")).otherwise(lines))


def dedupe_lines(text: Column) -> Column:
    """Each line once, by its words with folded blanks; single blank lines stay between others.

    Equal lines meet by sorting (key, place); a blank line has a key of its own.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), strip)
    keyed = F.transform(lines, lambda line, i: F.struct(F.when(line == "", F.format_string("\n%d", i)).otherwise(F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")).alias("key"), i.alias("i"), line.alias("line")))
    once = lambda o: F.filter(o, lambda x, k: ~x["key"].eqNullSafe(F.get(o, k - 1)["key"]))
    firsts = F.flatten(F.transform(F.array(F.array_sort(keyed)), once))
    placed = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"))))
    kept = lambda o: F.filter(o, lambda x, k: (x["line"] != "") | (F.coalesce(F.get(o, k - 1)["line"], F.lit("")) != ""))
    return F.regexp_replace(F.array_join(F.transform(F.flatten(F.transform(F.array(placed), kept)), lambda x: x["line"]), "\n"), r"\n+\z", "")


def chunk_key(chunk_id: Column, limit: int = 100) -> Column:
    """K5: the trimmed id if it fits a key, else a digest of it; null for none."""
    trimmed = F.trim(chunk_id)
    return F.when(F.length(trimmed).between(1, limit), trimmed).when(F.length(trimmed) > limit, F.concat(F.lit("chunk_"), F.sha1(trimmed)))


def picture_id(text: Column) -> Column:
    """The first picture id: a name and parts joined by underscores."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)", 1)


def flexible_timestamp(text: Column) -> Column:
    """Wall-clock ``YYYY/MM/DD (day) HH:MM``, ISO 8601, or milliseconds since the epoch."""
    wall = F.regexp_replace(text, r"^(\d{4})/(\d{2})/(\d{2})[^0-9]*(\d{2}:\d{2})$", "$1-$2-$3 $4:00")
    return F.when(text.rlike(r"^\d{12,14}$"), F.timestamp_millis(text.try_cast("long"))).otherwise(F.try_to_timestamp(wall))


def footer_field(text: Column, name: str) -> Column:
    """The value of the last ``name: value`` line, without end punctuation; null if none."""
    value = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is).*(?:^|\n)[ \t*-]*{name}[ \t*]*[:：][ \t*]*([^\n]*)", 1)
    clean = F.regexp_replace(F.trim(value), r"[\s.。,，;；*`]+$", "")
    return F.when(clean != "", clean)


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two paths."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(F.transform(same, lambda s: F.when(s, 1).otherwise(0)), 0)
    return F.when(first > 0, F.slice(a, 1, (first - 1).cast("int"))).otherwise(F.slice(a, 1, F.least(F.size(a), F.size(b))))


def to_bool(value: Column, default: bool = False) -> Column:
    """A setting as a boolean; what is neither yes nor no is the default."""
    low = F.lower(strip(value.cast("string")))
    return F.when(low.isin("1", "true", "yes", "y", "on"), True).when(low.isin("0", "false", "no", "n", "off", ""), False).otherwise(default)


def to_int(value: Column, default: int = 0) -> Column:
    """A setting as an integer, or the default."""
    text = strip(value.cast("string"))
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text).try_cast("long"), F.lit(default).cast("long"))


def to_float(value: Column, default: float = 0.0) -> Column:
    """A setting as a number, or the default."""
    return F.coalesce(strip(value.cast("string")).try_cast("double"), F.lit(float(default)))


def guessed_title(text: Column, name: Column, index: Column) -> Column:
    """The first heading of a text, else a numbered name."""
    headings = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), strip), lambda line: line.startswith("#"))
    heading = strip(F.regexp_replace(F.get(headings, F.lit(0)), "^#+", ""))
    return F.coalesce(F.nullif(heading, F.lit("")), F.concat(name, F.format_string(" baseline chunk %04d", index)))


def titled_index_text(title: Column, text: Column) -> Column:
    """A title over the text on one line, without picture marks."""
    return F.concat(title, F.lit("\n"), strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<PIC:[^>]+>", ""), r"(?U)\s+", " ")))


def placed_index_text(path: Column, title: Column, text: Column) -> Column:
    """Section path, title and body as plain lines, each said once; a title that opens the body is not repeated."""
    section = markdown_to_index_text(F.array_join(F.filter(F.coalesce(path, F.expr("cast(array() AS array<string>)")), lambda p: p != ""), " > "))
    head, body = markdown_to_index_text(title), markdown_to_index_text(text)
    first = F.coalesce(F.get(lines_of(body), F.lit(0)), F.lit(""))
    opens = (body != "") & (head != "") & ((first == head) | body.startswith(head))
    again = F.when((head != "") & (head != section) & ~opens, head)
    return dedupe_lines(F.concat_ws("\n", F.coalesce(F.nullif(section, F.lit("")), F.nullif(head, F.lit(""))), again, F.nullif(body, F.lit(""))))


def token_estimate(text: Column) -> Column:
    """4 tokens a message and one for each three bytes begun."""
    return (F.lit(4) + F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 3)).cast("long")
