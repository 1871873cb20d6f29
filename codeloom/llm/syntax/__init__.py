"""Grammars of the supported languages."""

from codeloom.llm.syntax.judge import GRAMMARS, diagnose, rank, readings, valid  # noqa: F401
