"""Operators for preparing training corpora at scale.

Ten self-contained operators, one module each, plus the registered queries in
``queries``.  Nothing outside this subpackage (and ``corpus_pipeline``) imports it.
"""
