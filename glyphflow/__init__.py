"""glyphflow: text as relations on Spark — lexing, parsing and graph analytics over columns of text."""

__version__ = "0.1.0"
