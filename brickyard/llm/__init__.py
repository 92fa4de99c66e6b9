"""Training-data operators.  Nothing else in the package imports this subpackage.

minhash      near-duplicate documents (multi-index Hamming join over b-bit signatures)
repeats      repeated passages (enhanced suffix arrays, common-prefix interval scan)
neighbours   nearest vectors (learned balanced partitions)
urls         URL verdicts (rules; host segmentation and naive Bayes)
quality      importance resampling with hashed n-gram models
mixing       sources to target weights (pivotal rounding, reduction tree)
covertree    vector pairs over a cosine threshold (cover-tree dual traversal)
sharding     stratified interleaving into shards
packing      BM25 retrieval packing into fixed windows
surrogates   keyed replacements for personal data
queries      the registered queries and their SQL
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
