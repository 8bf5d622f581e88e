"""quern: a Spark-native engine that mills raw pages and free-text records into a searchable catalog."""

from pyspark import cloudpickle

from quern.functions import blocks, words

# These helpers run inside Arrow UDFs.  Shipping them by value keeps executors free of
# any package installation step.
for module in (blocks, words):
    cloudpickle.register_pickle_by_value(module)
