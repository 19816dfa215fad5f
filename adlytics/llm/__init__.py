"""Operators of a training-data pipeline (dedup, fingerprints, quality,
language, tokens, mixing, search, URL rules, personal data, vector codes,
manifests, token files).

Nothing else in the library imports this subpackage.  Its functions run in
Python workers that may not have the repository on their path, so cloudpickle
sends them by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
