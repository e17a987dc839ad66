"""Annotated natural-language text as DataFrames: prompts, decoding, repair, phrase and tree matching, corpora, evaluation."""
