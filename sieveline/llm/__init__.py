"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. Each
module holds one operator with a general DataFrame interface; ``catalog`` maps
the thin registered queries onto them.
"""
