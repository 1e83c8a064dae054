"""Column functions on text, all of them built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's \s and SQL's trim() know less of it.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TAG = r"<[^>]*>"
SPECIAL = r"<\|[^|<>]*\|>|<｜[^｜<>]*｜>"
#: A word: letters, joined by hyphens or apostrophes, that touches no digit, underscore or joiner before it.
WORD = r"(?<![\p{L}\p{N}_'’-])\p{L}+(?:[-'’]\p{L}+)*(?![\p{L}\p{N}_])"
#: What ends a sentence, and quotes and brackets around one.
SENTENCE_END = ".!?…"
CLOSERS = "\"'“”’»)]"
OPENERS = "\"'„“‚‘«(["
START_OPENERS = "\"'„“”‚‘’«»([{–—-*•"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once and may be used within lambdas, which results of Python may not."""
    return F.transform(F.array(value), then)[0]


def one_of(characters: str) -> str:
    """A regular expression class of the characters."""
    return "[" + "".join("\\" + c if c in "\\[]^-&" else c for c in characters) + "]"


#: The same characters as a set for trimming, which looks at a text's ends alone.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def right_strip(text: Column, characters: str = BLANKS) -> Column:
    return F.rtrim(text, F.lit(characters))


def left_strip(text: Column, characters: str = BLANKS) -> Column:
    return F.ltrim(text, F.lit(characters))


def collapse(text: Column) -> Column:
    """Words separated by single spaces."""
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def xml_safe(text: Column) -> Column:
    """Without the characters that XML 1.0 forbids."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")


def text_layer(text: Column) -> Column:
    """A page's text layer: line ends as LF, soft hyphen marks as a hyphen and line end; null if nothing is left."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    cleaned = strip(xml_safe(F.replace(lines, F.lit("￾"), F.lit("-\n"))))
    return F.when(cleaned != "", cleaned)


def clean_special(text: Column) -> Column:
    """Without model tokens, stripped."""
    return strip(F.regexp_replace(text, SPECIAL, ""))


def mask_tags(text: Column) -> Column:
    """Tags as spaces of equal length, so that offsets stay."""
    gaps = F.split(text, TAG, -1)
    tags = F.concat(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), F.array(F.lit("")))
    spaced = F.array_join(F.zip_with(gaps, tags, lambda a, b: F.concat(a, F.repeat(F.lit(" "), F.length(b)))), "")
    return F.when(F.contains(text, F.lit("<")), spaced).otherwise(text)


def word_list(text: Column) -> Column:
    """Words in order, without places."""
    return F.regexp_extract_all(mask_tags(text), F.lit(WORD), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """A text cut at the matches of a pattern: gap, match, gap, ... so that odd places (from 0) are matches.

    The pattern never matches nothing, so that there is one gap more than matches, whatever characters the text holds.
    """
    gaps = F.split(text, pattern, -1)
    found = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    return F.slice(F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(g, m))), F.lit(1), 2 * F.size(gaps) - 1)


def ends_sentence(text: Column) -> Column:
    """Whether a text's last character, closing quotes and brackets aside, ends a sentence; an empty text does."""
    bare = right_strip(right_strip(right_strip(text), CLOSERS))
    return (bare == "") | F.substring(bare, -1, 1).isin(*SENTENCE_END, ":")


def starts_lower(text: Column) -> Column:
    return F.rlike(left_strip(left_strip(text), OPENERS), F.lit(r"^\p{Ll}"))


def at_sentence_start(before: Column) -> Column:
    """Whether a word with this text before it starts a sentence."""
    bare = right_strip(before, BLANKS + START_OPENERS)
    return (bare == "") | F.substring(bare, -1, 1).isin(*SENTENCE_END)


#: Names of the model's paired tags, whose contents go too, and tags of tables.
PAIRED, TABLE_TAGS = ("ref", "det"), ("table", "thead", "tbody", "tr", "td", "th")
#: What a line that only draws a rule is made of.
RULE, LEAST_RULE, MOST_HASHES, MOST_INDENT = "-:| ", 3, 6, 3


def _pieces(text: Column, mark: str) -> Column:
    """A text cut at each place of a mark that is taken literally."""
    return F.split(text, "\\Q" + mark + "\\E", -1)


def without_pairs(text: Column, opening: str, closing: str) -> Column:
    """A space for each stretch from an opening mark to the next closing one; marks without their other half stay."""
    pieces = _pieces(text, closing)

    def cut(piece: Column, i: Column) -> Column:
        at = F.instr(piece, opening)
        ended = F.when(at > 0, F.concat(F.substring(piece, F.lit(1), at - 1), F.lit(" "))).otherwise(F.concat(piece, F.lit(closing)))
        return F.when(i < F.size(pieces) - 1, ended).otherwise(piece)

    return F.array_join(F.transform(pieces, cut), "")


def without_tokens(text: Column) -> Column:
    """A space for each model token: an opening mark, and a closing one before any other bar or angle."""

    def cut(piece: Column, i: Column) -> Column:
        rest = F.regexp_replace(piece, "^[^|>]*", "")
        return F.when(i == 0, piece).when(F.startswith(rest, F.lit("|>")), F.concat(F.lit(" "), F.substring(rest, 3, 1 << 30))).otherwise(F.concat(F.lit("<|"), piece))

    return F.array_join(F.transform(_pieces(text, "<|"), cut), "")


def without_table_tags(text: Column) -> Column:
    """A line end where a row or line of a table ends, and a space for its other tags; what else is angled stays."""

    def cut(piece: Column, i: Column) -> Column:
        end = F.instr(piece, ">")
        inner = F.lower(F.substring(piece, F.lit(1), end - 1))
        name = F.regexp_extract(inner, "^/?([a-z]*)", 1)
        after = F.substring(piece, end + 1, F.length(piece))
        row = (F.btrim(inner) == "/tr") | (name == "br")
        tag = F.when(row, F.lit("\n")).when(name.isin(*TABLE_TAGS), F.lit(" "))
        return F.when(i == 0, piece).when((end > 0) & tag.isNotNull(), F.concat(tag, after)).otherwise(F.concat(F.lit("<"), piece))

    return F.array_join(F.transform(_pieces(text, "<"), cut), "")


def unmarked_line(line: Column) -> Column:
    """A line without the Markdown that it begins with: hashes of a heading, or a bullet; nothing of a line that draws a rule."""
    bare = left_strip(line)
    first = F.regexp_extract(bare, r"^\S+", 0)
    rest = left_strip(F.substring(bare, F.length(first) + 1, F.length(bare)))
    heading = _only(first, "#") & (F.length(first) <= MOST_HASHES) & (F.length(line) - F.length(bare) <= MOST_INDENT)
    rule = (F.length(line) >= LEAST_RULE) & (F.translate(right_strip(bare), RULE, "") == "") & (bare != "")
    return F.when(heading | first.isin("-", "*"), rest).when(rule, F.lit("")).otherwise(line)


def clean_model_text(raw: Column) -> Column:
    """Plain words of model output: tags, model tokens, table markup and Markdown marks go."""
    for name in PAIRED:
        raw = without_pairs(raw, f"<|{name}|>", f"<|/{name}|>")
    lines = F.split(without_table_tags(F.replace(without_tokens(raw), F.lit("<PAGE>"), F.lit(" "))), "\n", -1)
    plain = F.array_join(F.transform(lines, unmarked_line), "\n")
    for mark in ("**", "__"):
        plain = F.replace(plain, F.lit(mark), F.lit(""))
    return F.translate(plain, "|", " ")


def plain_words(text: Column) -> Column:
    """Words for comparing layers: plain punctuation, words broken over lines joined. Text is taken to be NFC."""
    t = F.replace(F.translate(text, "’‘‚„“”–—", "'',\"\"\"--"), F.lit("…"), F.lit("..."))
    t = F.regexp_replace(t, r"([\p{L}\p{N}_])-\s*\n\s*(?=[\p{L}\p{N}_])", "$1")
    return F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")


#: The folder that holds users' homes, and what is put for one.
HOMES, TOLD, TOLD_NAME = "users", "%USERPROFILE%", "C--Users-<user>-"
#: How the segments of a path may be parted: a backslash, two as in JSON, a slash.
PARTED = ("\\\\", "\\", "/")


def scrub_user(text: Column, user: str) -> tuple[Column, Column]:
    """A text without paths into a user's home, and how many there were.

    The text is cut at the homes' folder. A home is there if a drive stands before the cut and the user's name after it,
    both parted from it alike: by a slash, a backslash or two of them, or by dashes in a path that was made one name.
    """
    name, kind = user.lower(), "struct<before:int,after:int,told:string>"

    def home(pieces: Column, i: Column) -> Column:
        """How much of the gaps before and after the cut belongs to a home, and what is put for it; null if there is none."""
        before, after = F.lower(F.get(pieces, i - 1)), F.lower(F.get(pieces, i + 1))
        out = F.when(F.rlike(before, F.lit("[a-z]--$")) & F.startswith(after, F.lit(f"-{name}-")), F.struct(F.lit(3).alias("before"), F.lit(len(name) + 2).alias("after"), F.lit(TOLD_NAME).alias("told")))
        for sign in PARTED:
            drive = F.rlike(F.substring(before, -len(sign) - 2, 2), F.lit("^[a-z]:$")) & F.endswith(before, F.lit(sign))
            next_ = F.substring(after, len(sign + name) + 1, 1)
            # in JSON the home's own separator goes along and is put back; else the name must end here
            json = len(sign) > 1
            whole = F.startswith(after, F.lit(sign + name + sign * json)) & (F.lit(json) | (next_ == "") | F.rlike(next_, F.lit(r"[^\w.-]")))
            out = out.when(drive & whole, F.struct(F.lit(len(sign) + 2).alias("before"), F.lit(len(sign + name + sign * json)).alias("after"), F.lit(TOLD + sign * json).alias("told")))
        return out.otherwise(F.lit(None).cast(kind))

    def scrubbed(pieces: Column) -> Column:
        def put(cuts: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                head, tail = F.coalesce(F.get(cuts, i - 1)["after"], F.lit(0)), F.coalesce(F.get(cuts, i + 1)["before"], F.lit(0))
                gap = F.substring(x, head + 1, F.greatest(F.length(x) - head - tail, F.lit(0)))
                return F.when(i % 2 == 1, F.coalesce(F.get(cuts, i)["told"], x)).otherwise(gap)

            found = F.size(F.array_compact(F.transform(cuts, lambda c: c["told"])))
            return F.struct(F.array_join(F.transform(pieces, one), "").alias("text"), found.alias("n"))

        return let(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, home(pieces, i)).otherwise(F.lit(None).cast(kind))), put)

    done = let(matches(text, f"(?i){HOMES}"), scrubbed)
    return done["text"], done["n"]


def words_found(text: Column, expected: list[str]) -> Column:
    """Which of the expected words a text holds, case aside."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, expected)), lambda w: F.contains(low, F.lower(w)))


#: Ligatures and the letters they stand for.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
MORE_LIGATURES = LIGATURES | {"ﬅ": "ft", "ﬆ": "st"}
_DIGITS = "0123456789"


def _only(text: Column, characters: str) -> Column:
    return (text != "") & (F.translate(text, characters, "") == "")


def stands_alone(line: Column) -> Column:
    """Whether a line is never joined to the one before: a heading, an item, a quotation, a table's or code's line."""
    bare = left_strip(line)
    first = F.regexp_extract(bare, r"^(\S+)\s", 1)
    numbered = F.right(first, F.lit(1)).isin(".", ")") & _only(F.substring(first, F.lit(1), F.length(first) - 1), _DIGITS)
    by_first = first.isin("-", "*", "+", "===") | (_only(first, "#") & (F.length(first) <= 6)) | numbered
    return by_first | F.substring(bare, 1, 1).isin(">", "|") | F.startswith(bare, F.lit("```"))


def clean_extracted(text: Column) -> Column:
    """Text extracted from a print layout: ligatures, unmapped glyphs, page breaks and numbers, hyphens, wrapped lines.

    Lines of a paragraph are joined by marking each line end that stays; a line that stands for itself keeps both ends.
    """
    for a, b in MORE_LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    t = F.replace(F.regexp_replace(text, r"\(cid:[0-9]+\)", ""), F.lit("\f"), F.lit("\n\n"))
    inner = r"[\p{L}\p{N}_]"
    t = F.regexp_replace(t, f"({inner})-\n(?={inner})", "$1")

    def page_number(line: Column) -> Column:
        bare = F.btrim(line, F.lit(" \t"))
        return _only(bare, _DIGITS) & (F.length(bare) <= 4)

    lines = F.filter(F.split(t, "\n", -1), lambda x: ~page_number(x))
    kind = F.transform(lines, lambda x: F.when(is_blank(x), F.lit("blank")).when(stands_alone(x), F.lit("own")).otherwise(F.lit("flow")))
    shown = F.zip_with(lines, kind, lambda x, k: F.when(k == "flow", strip(x)).when(k == "blank", F.lit("")).otherwise(x))
    after = F.concat(F.slice(kind, 2, F.size(kind)), F.array(F.lit("end")))
    ends = F.zip_with(kind, after, lambda a, b: F.when(b == "end", F.lit("")).when((a == "flow") & (b == "flow"), F.lit(" ")).otherwise(F.lit("\n")))
    joined = F.array_join(F.zip_with(shown, ends, lambda a, b: F.concat(a, b)), "")
    return F.when(text == "", text).otherwise(F.concat(strip(F.regexp_replace(joined, r"\n{3,}", "\n\n")), F.lit("\n")))


def joined(value: Column | str, gap: str, *order: Column | str) -> Column:
    """An aggregate: the texts of a group put together in an order, nulls left out."""
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]
    ordered = F.array_sort(F.collect_list(F.struct(*keys, (F.col(value) if isinstance(value, str) else value).alias("t"))))
    return F.array_join(ordered["t"], gap)
