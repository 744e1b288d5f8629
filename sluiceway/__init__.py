"""sluiceway: a PySpark-native engine for building and searching a curated slice of the web.

The core (``functions``, ``operators``, ``sources``, ``streaming``, ``plans``) never imports the
``llm`` subpackage, which holds the operators for training-data pipelines.
"""

__version__ = "0.1.0"
