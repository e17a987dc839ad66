"""Domains and types of annotated text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts of speech.
POS = "ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB SPACE X".split()

# Dependency relations.
DEP = (
    "acl acl:relcl advcl advcl:relcl advmod advmod:emph advmod:lmod amod appos aux aux:pass case cc cc:preconj ccomp clf "
    "compound compound:lvc compound:prt compound:redup compound:svc conj cop csubj csubj:outer csubj:pass dep det det:numgov "
    "det:nummod det:poss discourse dislocated expl expl:impers expl:pass expl:pv fixed flat flat:foreign flat:name goeswith "
    "iobj list mark nmod nmod:poss nmod:tmod nsubj nsubj:outer nsubj:pass nummod nummod:gov obj obl obl:agent obl:arg "
    "obl:lmod obl:tmod orphan parataxis punct reparandum root vocative xcomp"
).split()

# Codes of white space after a token; all but the first are single characters.
WHITESPACE = {
    "": "none", " ": "_", "\u00A0": "nbsp", "\u2009": "thinsp", "\u200A": "hairsp", "\u200B": "zwsp", "\u202F": "narnbsp", "\u3000": "ideogrp",
}
# What models also write for U+202F.
WHITESPACE_VARIANTS = {"\u202F ": "\u202F", "  ": "\u202F", "\u00A0 ": "\u202F"}

# Names of languages in prompts; those of inference are a part of those of corpora.
LANGUAGES = {"eng": "English", "deu": "German", "fra": "French", "spa": "Spanish", "kor": "Korean", "por": "Portuguese", "ita": "Italian"}
INFERENCE_LANGUAGES = ("eng", "deu", "fra", "spa", "kor")

# Marks that end a sentence.
FINAL_MARKS = ".!?:;\u0964\u3002\uFF01\uFF1F\u061F\u00BF\u00A1"

# Marks of the wire format.
MARKER = "Here's the token analysis:"
END_MARKER = "</analysis>"
SEPARATOR = "-----"

TOKEN = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("text", "whitespace", "pos", "lemma", "dep")] + [T.StructField("head", T.IntegerType(), False)]
)
TOKENS = "array<struct<text:string,whitespace:string,pos:string,lemma:string,dep:string,head:int>>"
TOKENS_TYPE = T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in TOKEN.fields]))
PATTERN = "pattern_index int, label string, pattern array<string>"
TREE_PATTERN = "pattern_index int, label string, pnode int, pparent int, pdep string, lemma string"


def lookup(table: dict[str, str], key):
    """The table's value for a key, the key itself where it has none."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), key)


def language_name(code, strict: bool = False):
    """Name of a language code. Strict: null for unknown codes (corpora); else the code stands for itself (inference)."""
    names = LANGUAGES if strict else {c: LANGUAGES[c] for c in INFERENCE_LANGUAGES}
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code) if strict else lookup(names, code)


def is_pos(pos):
    return pos.isin(POS)


def is_dep(dep):
    return dep.isin(DEP)
