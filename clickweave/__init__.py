"""Click-stream analytics expressed as Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame; nothing is executed until the caller
asks for the result. The only eager work in the package is the bounded skew probe of
``clickweave.plans.skew``.
"""

__version__ = "0.1.0"
