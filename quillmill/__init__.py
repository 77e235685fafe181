"""A correction-corpus engine on Spark: text and sentence pairs in, labelled training records out."""

__version__ = "0.1.0"
