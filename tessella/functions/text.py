"""Text functions on columns: tokens, counts, scripts, clean-up, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}\p{N}_]+"


def half_width(col: Column) -> Column:
    """Full-width ASCII forms and the ideographic blank to their half-width twins."""
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    half = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    return F.when(col.rlike(r"[\x{FF01}-\x{FF5E}\x{3000}]"), F.translate(col, full, half)).otherwise(col)  # texts without such forms are not gone through letter by letter


def tokenize(col: Column) -> Column:
    """Lower-cased words between anything that is neither letter, digit nor underscore."""
    return F.filter(F.split(F.regexp_replace(F.lower(half_width(col)), WORD_BREAK, " "), " "), lambda x: x != "")


def fine_tokens(tokens: Column) -> Column:
    return F.filter(F.flatten(F.transform(tokens, lambda t: F.split(t, "[/_-]"))), lambda x: x != "")


def token_count(col: Column) -> Column:
    """Words plus single marks; stands for a model's token count."""
    return F.regexp_count(col, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def truncate_words(col: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(col), r"\s+"), 1, n), " ")


def ascii_share(col: Column) -> Column:
    size = F.length(col)
    return F.length(F.regexp_replace(col, r"[^\x00-\x7F]", "")) / F.when(size > 0, size)


def is_english(col: Column, least: float = 0.8) -> Column:
    return F.coalesce(ascii_share(col) > least, F.lit(False))


def han_share(col: Column) -> Column:
    size = F.length(col)
    return (size - F.length(F.regexp_replace(col, r"[\x{4E00}-\x{9FFF}]", ""))) / F.when(size > 0, size)


def is_chinese(col: Column, least: float = 0.2) -> Column:
    return F.coalesce(han_share(col) > least, F.lit(False))


def mixed_spacing(col: Column) -> Column:
    """A blank between Latin letters or digits and Han characters."""
    one = F.regexp_replace(col, r"([A-Za-z0-9])([\x{4E00}-\x{9FFF}])", "$1 $2")
    return F.regexp_replace(one, r"([\x{4E00}-\x{9FFF}])([A-Za-z0-9])", "$1 $2")


#: Question words and auxiliaries left out of queries (fixed values).
QUESTION_WORDS = ("what", "who", "how", "which", "where", "why", "when", "is", "are", "were", "was", "do", "does", "did", "the", "a", "an", "of", "to", "please", "tell", "me")


def drop_question_words(col: Column) -> Column:
    """Without question words; the text itself if nothing is left."""
    left = F.array_join(F.filter(F.split(F.lower(col), " "), lambda w: (w != "") & ~w.isin(*QUESTION_WORDS)), " ")
    return F.when(left == "", col).otherwise(left)


def squeeze_spaces(col: Column) -> Column:
    """No blanks next to characters above ASCII."""
    return F.regexp_replace(F.regexp_replace(col, r"([^\x00-\x7F]) +", "$1"), r" +([^\x00-\x7F])", "$1")


#: Signs with a meaning in a full-text query (fixed values).
QUERY_SIGNS = ':{}/[]-*"()|+~^'


def escape_query(col: Column) -> Column:
    """A backslash before each sign that a full-text query would read as its own."""
    return F.regexp_replace(col, "([" + "".join(f"\\{c}" for c in QUERY_SIGNS) + "])", r"\\$1")


def strip_marks(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


#: Elements of a table whose tags are taken out (fixed values).
TABLE_ELEMENTS = ("table", "caption", "tr", "th", "td")


def strip_tags(col: Column, names: tuple[str, ...] = TABLE_ELEMENTS) -> Column:
    """Start and end tags of the named elements become a blank, their attributes with them."""
    return F.regexp_replace(col, rf"</?({'|'.join(names)})(\s[^<>]*)?>", " ")


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with {name} replaced by each value; a null value is empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


NUMERALS = {w: k for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {w: k + 1 for k, w in enumerate("一二三四五六七八九十")}


def numeral(col: Column) -> Column:
    """A whole number, an English number word up to twelve or a Chinese numeral up to ten as an integer, else -1."""
    known = F.create_map(*(F.lit(x) for pair in NUMERALS.items() for x in pair))
    return F.coalesce(F.when(col.rlike("^[0-9]{1,9}$"), col.try_cast("int")), F.try_element_at(known, F.lower(col)), F.lit(-1))


def clean(col: Column) -> Column:
    """Character references decoded, quotes and control characters dropped."""
    out = col
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(char))
    return F.regexp_replace(out, "[\"\\x00-\\x1F\\x7F-\\x9F]", "")


def to_float(col: Column) -> Column:
    """Minus infinity where the text is no number."""
    return F.coalesce(col.try_cast("double"), F.lit(float("-inf")))


def model_answer(col: Column) -> Column:
    """Without a leading thought part, code fences and what stands outside the outer braces."""
    out = F.regexp_replace(F.regexp_replace(col, r"(?s)^.*</think>", ""), r"```[a-z]*", "")
    return F.trim(F.regexp_extract(out, r"(?s)(\{.*\})", 1))


def tagged(col: Column, tag: str) -> Column:
    return F.regexp_extract_all(col, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
