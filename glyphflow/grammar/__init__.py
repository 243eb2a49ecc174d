"""Grammar files as rule tables."""

from .model import Grammar, GrammarError, Production, Projection, TokenRule
from .reader import read_grammar, read_grammar_file

__all__ = ["Grammar", "GrammarError", "Production", "Projection", "TokenRule", "read_grammar", "read_grammar_file"]
