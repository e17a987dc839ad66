"""Sentences from the terminal, one by one: python -m tokenloom.prompt_loop URL."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from . import sources
from .engine import Engine


def loop(spark: SparkSession, engine: Engine, ask: Callable[[str], str] = input, say: Callable[[str], None] = print) -> None:
    """Until "quit": a sentence and a language code, unknown ones taken as eng; the tokens, or the error."""
    while (sentence := ask("Sentence (or quit): ").strip()).lower() != "quit":
        language = sources.known_language(ask("Language code (eng/deu/fra/spa/kor): "))
        row = engine.analyze(sources.from_sentences(spark, [sentence], language), save=False).first()
        if row.error:
            say(row.error)
        for t in row.tokens or []:
            say(f"  {t.text:15} POS: {t.pos:10} Lemma: {t.lemma:15} Dep: {t.dep}")


if __name__ == "__main__":
    loop(SparkSession.builder.getOrCreate(), Engine.from_server(sys.argv[1]))
