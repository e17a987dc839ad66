"""Prompts, and the tab-separated wire format in both directions, without any shuffle.

Prompts, encoding and checks are built-in expressions on arrays. Decoding takes every line apart several times, which Spark
interprets element by element; it is one pass over Arrow arrays instead.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow
from ..functions.text import strip
from ..schema import DEP, END_MARKER, MARKER, POS, SEPARATOR, TOKENS_TYPE, WHITESPACE, lookup

# Lines of the prompts.
TASK = "Task: Analyze tokens (idx,token,ws,POS,lemma,dep,head)"
TAILS = {
    "request": f"\n{TASK}\n\nAnalysis:\n",
    "inference": f"\n{TASK}\n\nAnalysis:",
    "legacy": "\nTask: Analyze tokens (idx,token,POS,lemma,dep,head)\n\nAnalysis:",
    "serving": f"\n{TASK}\n",
    "training": f"\n{TASK}",
}


def prompt(sentence: Column, language: Column, variant: str = "request") -> Column:
    return F.concat(F.lit("Language: "), language, F.lit("\nSentence: "), sentence, F.lit(TAILS[variant]))


def texts(tokens: Column) -> Column:
    return tokens["text"]


def lemmas(tokens: Column) -> Column:
    return tokens["lemma"]


def reconstruct(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.concat(t["text"], t["whitespace"])), "")


def move_spaces_forward(tokens: Column) -> Column:
    """A plain space after a token goes to the front of the next one; the last token keeps its own."""
    moved = lambda t, i: (t["whitespace"] == " ") & (i < F.size(tokens) - 1)
    return F.transform(
        tokens,
        lambda t, i: F.struct(
            F.concat(F.when((i > 0) & (F.get(tokens, i - 1)["whitespace"] == " "), " ").otherwise(""), t["text"]).alias("text"),
            F.when(moved(t, i), "").otherwise(t["whitespace"]).alias("whitespace"),
            t["pos"].alias("pos"), t["lemma"].alias("lemma"), t["dep"].alias("dep"), t["head"].alias("head"),
        ),
    )


def encode_lines(moved: Column, later: Column | None = None) -> Column:
    """The lines of one sentence; ``later``: it isn't the group's first, so its first token gets a space in front."""
    front = lambda i: F.when((i == 0) & later, " ").otherwise("") if later is not None else F.lit("")
    line = lambda t, i: F.concat_ws(
        "\t", (i + 1).cast("string"), F.concat(front(i), t["text"]), lookup(WHITESPACE, t["whitespace"]), t["pos"], t["lemma"], t["dep"], t["head"].cast("string")
    )
    return F.array_join(F.transform(moved, line), "\n")


def response(lines: Column) -> Column:
    return F.concat(F.lit(f"{MARKER}\n\n"), lines, F.lit(f"\n\n{END_MARKER}"))


def encode(tokens: Column) -> Column:
    """The response for one sentence."""
    return response(encode_lines(move_spaces_forward(tokens)))


def encode_group(sentences: Column) -> Column:
    """The response for an array of sentences with (moved) tokens; token numbers start again in each."""
    each = F.transform(sentences, lambda s, i: encode_lines(s["tokens"], i > 0))
    return response(F.array_join(each, f"\n{SEPARATOR}\n"))


def training_prompt(sentences: Column, language: Column) -> Column:
    return prompt(F.array_join(F.transform(sentences, lambda s: strip(s["sentence"])), " "), language, "training")


def full_text(prompt_text: Column, response_text: Column) -> Column:
    return F.concat(prompt_text, F.lit("\n\n"), response_text, F.lit("<eos>"))


def verbose_format(tokens: Column) -> Column:
    line = lambda t, i: F.concat(i.cast("string"), F.lit(": "), t["text"], F.lit(" | POS: "), t["pos"], F.lit(" | Lemma: "), t["lemma"], F.lit(" | Dep: "), t["dep"], F.lit(" | Head: "), t["head"].cast("string"))
    return F.array_join(F.transform(tokens, line), "\n")


def compact_format(tokens: Column) -> Column:
    line = lambda t, i: F.concat_ws("\t", i.cast("string"), t["text"], t["pos"], t["lemma"], t["dep"], t["head"].cast("string"))
    return F.array_join(F.transform(tokens, line), "\n")


def saved_percent(old: Column, new: Column) -> Column:
    """One decimal; null where there is nothing to save from."""
    return F.round(F.try_divide(100 * (F.length(old) - F.length(new)), F.length(old)), 1)


def per_item(length: Column, items: Column, of: int | None = None) -> Column:
    """Characters (or tokens) an item takes, one decimal, or those a sentence of ``of`` items would, rounded; null without items."""
    each = F.try_divide(length, items)
    return F.round(each, 1) if of is None else F.round(each * of, 0)


def after_marker(text: Column) -> Column:
    return F.substring_index(text, MARKER, -1)


def analysis(text: Column) -> Column:
    """What follows the last "Analysis:" of a model's whole output."""
    return strip(F.substring_index(text, "Analysis:", -1))


def head_number(text: Column) -> Column:
    """32-bit number with an optional sign; -1 for anything else."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), F.coalesce(text.try_cast("int"), F.lit(-1))).otherwise(-1)


@F.arrow_udf(T.StructType().add("tokens", TOKENS_TYPE).add("error", T.StringType()))
def _decoded(response: pa.Array) -> pa.Array:
    tokens, error = arrow.decode(response)
    return pa.StructArray.from_arrays([tokens.lists(response.is_null().to_numpy(zero_copy_only=False)), error], ["tokens", "error"])


def decode(df: DataFrame, response_col: str = "response") -> DataFrame:
    """Adds ``tokens`` and ``error``: null, or the first unknown label's kind (the sentence fails as a whole).

    Text before the last marker and from the first end marker on is dropped; so are empty lines, separators and lines of
    fewer than 7 fields. A space in front of a token's text goes back to the white space before it, in place of what is there.
    A null response has null tokens and no error.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("tokens", "error")]
    return df.select(*kept, _decoded(F.col(response_col)).alias("_d")).select(*kept, "_d.tokens", "_d.error")


def decode_lenient(response_text: Column) -> Column:
    """All fields as stripped text, no check, no repair, no end marker."""
    lines = F.transform(F.split(strip(after_marker(response_text)), "\n"), strip)
    fields = F.filter(F.transform(lines, lambda x: F.split(x, "\t", -1)), lambda p: F.size(p) >= 7)
    names = ("index", "token", "whitespace", "pos", "lemma", "dep", "head")
    as_space = lambda n, c: F.when(c == "_", " ").otherwise(c) if n == "whitespace" else c
    return F.transform(fields, lambda p: F.struct(*[as_space(n, strip(p[i])).alias(n) for i, n in enumerate(names)]))


# A well-formed line, but for the characters of its two words.
LINE = (
    r"^[0-9]+\t[^\t]+\t(_|none|nbsp|thinsp|hairsp|zwsp|ideogrp)\t(" + "|".join(p for p in POS if p != "SPACE") + r")\t[^\t]+\t("
    + "|".join(d for d in DEP if ":" not in d) + r")\t-?[0-9]+\z"
)


def fits_grammar(response_text: Column, sentence: Column) -> Column:
    """Whether a response is well-formed: an optional marker, groups of lines between separators, the end marker.

    Words are made of the sentence's own characters (a check, never a constraint). Lines are checked one by one against one
    fixed expression, and words by taking the sentence's characters away, so nothing is compiled for a row.
    """
    end, front = f"\n\n{END_MARKER}", f"{MARKER}\n\n"
    body = F.when(F.startswith(response_text, F.lit(front)), F.substr(response_text, F.lit(len(front) + 1))).otherwise(response_text)
    body = F.substr(body, F.lit(1), F.length(body) - len(end))
    lines = F.flatten(F.transform(F.split(body, f"\n{SEPARATOR}\n"), lambda g: F.split(g, "\n")))
    words = lambda x: F.concat(F.split_part(x, F.lit("\t"), F.lit(2)), F.split_part(x, F.lit("\t"), F.lit(5)))
    fits = lambda x: x.rlike(LINE) & (F.call_function("translate", words(x), sentence, F.lit("")) == "")
    ok = F.endswith(response_text, F.lit(end)) & F.forall(lines, fits)
    return (F.length(sentence) > 0) & F.coalesce(ok, F.lit(False))
