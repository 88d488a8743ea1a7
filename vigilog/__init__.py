"""Log monitoring analytics as Spark DataFrame plans.

``functions`` holds column expressions, ``sources`` reads and writes tables, ``operators``
holds DataFrame-to-DataFrame transformations, ``plans`` composes them into data products
and the registered queries, and ``streaming`` reuses the batch operators on streams.
"""
