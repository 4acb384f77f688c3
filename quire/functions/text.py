"""Words, white space, token budgets and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str.strip and str.split see it: 29 characters. Java's \s alone lacks 23 of them.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
#: Line ends as str.splitlines sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: Characters a word from which a text counts as written without blanks, and characters that then make a word.
DENSE_RATIO, DENSE_WORD = 15, 2
#: Output tokens per word, least and most.
TOKENS_PER_WORD, LEAST_TOKENS, MOST_TOKENS = 2.6, 64, 2048
#: Fixed value: what is asked about an image, in two languages' names.
IMAGE_PROMPT = "Translate all visible text in this image from %s to %s. Output ONLY the translation, one line per distinct text element. If the image contains NO readable text, respond with an empty string."
#: Fixed value: marks of opaque tokens in a text.
TOKEN_OPEN, TOKEN_CLOSE = "⟦", "⟧"


def words(text: Column) -> Column:
    """The runs between white space."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def left_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+", "")


def right_trim(text: Column) -> Column:
    """Without white space at the end. The look-behind keeps runs inside the text from being tried at every place."""
    return F.regexp_replace(text, f"(?<![{SPACE}])[{SPACE}]+\\z", "")


def trim(text: Column) -> Column:
    t = left_trim(text)
    return right_trim(t)


def lead(text: Column) -> Column:
    return F.regexp_extract(text, f"^([{SPACE}]*)", 1)


def tail(text: Column) -> Column:
    return F.regexp_extract(text, f"(?:^|[^{SPACE}])([{SPACE}]*)\\z", 1)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def effective_words(text: Column) -> Column:
    """Words, or half the characters where a word has over 15 on average, as in texts without blanks; at least 1 unless blank."""
    w, c = n_words(text), F.length(text)
    dense = c / w > DENSE_RATIO
    return F.when(w == 0, 0).when(dense, F.greatest(F.lit(1), F.floor(c / DENSE_WORD).cast("int"))).otherwise(w)


def token_budget(text: Column) -> Column:
    most = (effective_words(text) * F.lit(TOKENS_PER_WORD)).cast("int")
    return F.greatest(F.lit(LEAST_TOKENS), F.least(most, F.lit(MOST_TOKENS)))


def prompt(text: Column, source: Column, target: Column, source_name: Column, target_name: Column) -> Column:
    """What the model is asked. The wording is fixed; a paragraph on tokens joins it where the text holds one."""
    # The wording that the model was tuned on.
    tokens = (
        "IMPORTANT: The text contains placeholder tokens like ⟦1⟧, ⟦2⟧, ⟦3⟧. Each token stands for a hyperlink or footnote. You MUST keep every token EXACTLY as-is (same brackets and number), "
        "in the same position relative to the surrounding words. Never translate, alter, space out, reorder, split, merge, or remove any token. "
    )
    wording = (
        "You are a professional %1$s (%2$s) to %3$s (%4$s) translator. Your goal is to accurately convey the meaning and nuances of the original %1$s text while adhering to %3$s grammar, "
        "vocabulary, and cultural sensitivities. Produce only the %3$s translation, without any additional explanations or commentary. %5$sPlease translate the following %1$s text into %3$s:\n\n\n"
    )
    note = F.when(text.contains(TOKEN_OPEN), tokens).otherwise("")
    return F.concat(F.format_string(wording, source_name, source, target_name, target, note), text)


def image_prompt(source_name: Column, target_name: Column) -> Column:
    return F.format_string(IMAGE_PROMPT, source_name, target_name)


def scrub(text: Column) -> Column:
    """Without the model's request for a text, trimmed. The pattern is a fixed value."""
    return trim(F.regexp_replace(text, r"\(Please provide the [^\n]{0,60}text[^)]*\.\)", ""))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def duration(seconds: Column) -> Column:
    """1h 2m 3s, without hours or minutes that are zero."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.concat_ws(" ", F.when(h > 0, F.format_string("%dh", h)), F.when(m > 0, F.format_string("%dm", m)), F.format_string("%ds", s % 60))


def lines(text: Column) -> Column:
    """Lines as str.splitlines cuts them: a line end at the end opens no further line."""
    cut = F.split(text, LINE_END, -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)
