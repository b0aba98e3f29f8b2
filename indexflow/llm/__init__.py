"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
registers one query per operator and ``corpus_pipeline.py`` chains five of them.
Nothing outside this subpackage imports it.
"""
