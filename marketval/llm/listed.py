"""Imports every module that registers a query of this subpackage."""

from marketval.llm import bpe, chat, collocations, embeddings, feistel, infill, language, mixing, naming, quality, simhash, sketch, substrings  # noqa: F401
from marketval.llm.registry import QUERIES, SQL  # noqa: F401
