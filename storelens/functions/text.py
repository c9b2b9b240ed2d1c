"""Text expressions: whitespace, title case, tokens, message templates."""
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Remove every kind of leading and trailing whitespace (``trim`` removes spaces only)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def title_case(text: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the rest.

    ``initcap`` starts a word only after a space; here an apostrophe, hyphen or
    digit starts one too, so ``o'brien-al x2y`` becomes ``O'Brien-Al X2Y``.
    """
    pieces = F.split(text, r"(?<=[^\p{L}])")
    cased = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)),
                                                   F.lower(F.substr(p, F.lit(2)))))
    return F.array_join(cased, "")


def standard_text(text: Column) -> Column:
    return title_case(strip(text))


def looks_messy(text: Column) -> Column:
    """True for padded text and for text in one case only; null stays null."""
    return (text != F.trim(text)) | (text == F.upper(text)) | (text == F.lower(text))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def bracketed(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]"))


# A word is a run of two or more a-z letters that touches no other letter, digit or underscore.
WORD = r"(?<![\p{L}\p{N}_])[a-z]{2,}(?![\p{L}\p{N}_])"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def words_and_pairs(tokens: Column) -> Column:
    """Single words followed by every pair of neighbours."""
    shorter = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), shorter), F.slice(tokens, F.lit(2), shorter),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, pairs)


def mentions(text: Column, markers: list[str]) -> Column:
    """True where one of the marker words occurs as a whole word, in any case."""
    options = "|".join(re.escape(m) for m in markers)
    return text.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{options})(?![\p{{L}}\p{{N}}_])")


def first_word(text: Column) -> Column:
    return F.element_at(F.split(strip(text), r"\s+"), 1)


def initials(name: Column) -> Column:
    """Upper-case first letters of the first two words."""
    parts = F.slice(F.split(strip(name), r"\s+"), 1, 2)
    return F.upper(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), ""))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` by its column; a name without a column stays as written.

    The constant template is cut up once, so text that arrives through a column
    is never scanned for placeholders itself. ``{{`` and ``}}`` stand for a brace.
    """
    parts: list[Column] = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece.startswith("{") and piece[1:-1] in values:
            parts.append(values[piece[1:-1]].cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")
