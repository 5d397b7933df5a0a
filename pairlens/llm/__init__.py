"""Operators that prepare text corpora for model training.

Each module holds one operator with a general interface; :mod:`pairlens.llm.catalogue`
derives the registered queries from them.  Nothing outside this folder imports it.
"""
