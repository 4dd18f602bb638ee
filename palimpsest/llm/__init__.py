"""Training-data operators: packing, deduplication, filtering and classification of documents.

Nothing outside this folder imports it. Worker code is pickled by value, so executors need numpy, pyarrow and the
tokenizer package, not this repository.
"""

from pyspark import cloudpickle as _cloudpickle

import palimpsest.llm as _self

_cloudpickle.register_pickle_by_value(_self)
