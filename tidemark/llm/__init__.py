"""Operators for preparing training data, one module each; every module registers its query.

Functions of this package travel to the executors by value, so workers need not have the
package installed.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load() -> dict:
    """Name -> (function of session and folder, checking SQL or None)."""
    from tidemark.llm import (  # noqa: F401
        byte_merges,
        bag_minhash,
        importance,
        main_text,
        mixing,
        near_vectors,
        neighbours,
        personal,
        quality,
        registry,
        runs,
        shards,
        token_files,
        warc,
    )

    return registry.QUERIES
