"""Operators for building language-model training data.

Nothing else in the library imports this subpackage; ``queries`` registers
one query per operator.  Import the operator modules directly:
``langid``, ``packing``, ``dedup``, ``token_files``, ``quality``,
``toxicity``, ``ngram_join``, ``mixing``, ``urls``, ``lines``, ``alignment``,
``substrings`` and ``resampling``.
"""
