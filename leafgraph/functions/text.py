"""Text expressions: clean-up, sentences, titles, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NO_ANSWER = "I do not have the information to answer"

_CUT = "\u0001"
_DOT = "\u0002"


def clean_text(text: Column) -> Column:
    """The four clean-ups of serialised page text.

    Blank lines collapse to one, a single line break inside a paragraph becomes a space, heading marks go.
    """
    text = F.replace(text, F.lit("<[document]>"), F.lit(""))
    text = F.regexp_replace(text, r"\n{2,}", "\n\n")
    text = F.regexp_replace(text, rf"(?<={WORD})\n(?={WORD})", " ")
    return F.regexp_replace(text, "#+", "")


def split_sentences(text: Column) -> Column:
    """Array of trimmed sentences.

    A sentence ends after ``.``, ``!`` or ``?`` plus white space; a numbered item, a bullet and a blank line always
    start a new one. The full stop of an item number ends nothing.
    """
    text = F.regexp_replace(text, r"(^|\n)\s*(\d+)\.\s", f"{_CUT}$2{_DOT}")
    text = F.regexp_replace(text, r"(^|\n)\s*(\*+)", f"{_CUT}$2")
    text = F.regexp_replace(text, r"\n\n", _CUT)
    text = F.regexp_replace(text, r"([.!?])\s+", f"$1{_CUT}")
    parts = F.split(F.replace(text, F.lit(_DOT), F.lit(". ")), _CUT)
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != "")


def strip(text: Column) -> Column:
    """Strip every kind of white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def combine_titles(parent_titles: Column, titles: Column) -> Column:
    """Parent titles followed by own titles, without a leading blank and without repeating the joint element."""
    p = F.coalesce(parent_titles, F.array().cast("array<string>"))
    t = F.coalesce(titles, F.array().cast("array<string>"))
    t = F.when((F.size(t) > 0) & (F.try_element_at(t, F.lit(1)) == ""), F.slice(t, 2, F.greatest(F.size(t), F.lit(1)))
               ).otherwise(t)
    joint = (F.size(p) > 0) & (F.size(t) > 0) & (F.try_element_at(p, F.lit(-1)) == F.try_element_at(t, F.lit(1)))
    return F.when(joint, F.concat(p, F.slice(t, 2, F.greatest(F.size(t), F.lit(1))))).otherwise(F.concat(p, t))


def title_text(titles: Column, separator: str = " ") -> Column:
    return F.array_join(titles, separator)


def display_title(parent_titles: Column, titles: Column) -> Column:
    """Title path for display: parent titles without the last, then own titles."""
    p = F.coalesce(parent_titles, F.array().cast("array<string>"))
    head = F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))
    return F.array_join(F.concat(head, F.coalesce(titles, F.array().cast("array<string>"))), " -> ")


def titled_path(title: Column, program: Column, faculty: Column) -> Column:
    """Prefix program, then faculty, unless the title already holds them; an empty or missing one adds nothing."""
    def prefix(t: Column, part: Column) -> Column:
        part = F.coalesce(part, F.lit(""))
        return F.when(F.contains(t, part), t).otherwise(F.concat(part, F.lit(" -> "), t))
    return prefix(prefix(title, program), faculty)


def doc_preamble(title: Column, text: Column) -> Column:
    return F.concat(F.lit("The following reference is about "), title, F.lit("\n\n"), strip(text))


def is_empty_answer(answer: Column) -> Column:
    """True for a missing answer, an empty one, or one that says it cannot answer."""
    return F.coalesce((F.length(answer) == 0) | answer.contains(NO_ANSWER), F.lit(True))


def parse_verdict(text: Column, default: bool | None = False, yes: str = "YES", no: str = "NO") -> Column:
    """First of yes/no found in ``text``, ignoring case; without either the default, or an error if there is none."""
    upper = F.upper(text)
    at_yes = F.instr(upper, yes.upper())
    at_no = F.instr(upper, no.upper())
    if default is None:
        missing = F.raise_error(F.concat(F.lit(f"expected {yes} or {no}, received "), F.coalesce(upper, F.lit("null")))
                                ).cast("boolean")
    else:
        missing = F.lit(default)
    return (F.when((at_yes > 0) & (at_no > 0), at_yes < at_no)
            .when(at_yes > 0, F.lit(True)).when(at_no > 0, F.lit(False)).otherwise(missing))


def strip_prompt_echo(output: Column, prompt: Column) -> Column:
    """Model output without the prompt it repeats at its start."""
    return F.when(F.startswith(output, prompt), F.substring(output, F.length(prompt) + 1, F.length(output))
                  ).otherwise(output)


def extract_field(text: Column, name: str) -> Column:
    """The ``url:`` or ``text:`` field of a flattened row; the text runs to the next field line or the end.

    The text is taken line by line, possessively, and what stands behind its name always matches, so one scan does.
    """
    if name == "url":
        return F.nullif(F.regexp_extract(text, r"url:\s*(\S+)", 1), F.lit(""))
    pattern = name + r":\s*([^\n]*+(?:\n(?!\w+:\s|\z)[^\n]*+)*+)"
    return F.when(F.regexp_like(text, F.lit(name + ":")), F.regexp_extract(text, pattern, 1))


def italics(text: Column) -> Column:
    """Asterisks around every run of text on a line that starts and ends with a word character."""
    return F.regexp_replace(text, rf"({WORD}[^\n*]+{WORD})", r"*$1*")


def highlight(original: Column, compressed: Column) -> Column:
    """Mark the lines of ``compressed`` that occur literally in ``original``.

    Line numbering like ``1. `` and one pair of surrounding quotes are dropped before the search.
    """
    lines = F.transform(F.split(compressed, "\n"), lambda s: F.regexp_replace(strip(s), r"\d\.\s", ""))
    lines = F.transform(lines, lambda s: F.regexp_replace(s, r'^"|"$', ""))
    lines = F.filter(lines, lambda s: s != "")
    return F.aggregate(
        lines, original,
        lambda t, s: F.when(original.contains(s), F.replace(t, s, italics(s))).otherwise(t))


def display_text(text: Column, links: Column | None = None, min_title: int = 4) -> Column:
    """Text for display: trimmed, a leading bullet indented, no code blocks, link texts rendered as links."""
    text = strip(text)
    text = F.when(text.startswith("*"), F.concat(F.lit("  "), text)).otherwise(text)
    text = F.replace(text, F.lit("    "), F.lit("\t"))
    if links is None:
        return text
    shown = F.filter(F.coalesce(links, F.array().cast("array<struct<title:string,url:string,doc_id:bigint>>")),
                     lambda l: F.length(l["title"]) >= min_title)
    return F.aggregate(shown, text, lambda t, l: F.replace(
        t, l["title"], F.concat(F.lit("["), l["title"], F.lit("]("), l["url"], F.lit(")"))))
