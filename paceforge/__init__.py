"""paceforge: activity analytics as Spark jobs.

Every operator takes a DataFrame and returns a DataFrame, so steps compose with
``DataFrame.transform`` and Catalyst sees one declarative plan per output.
"""

__version__ = "0.1.0"
