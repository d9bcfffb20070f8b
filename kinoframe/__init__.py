"""kinoframe: film-catalogue analytics as Spark DataFrame jobs.

Every public operator takes DataFrames (plus column-name parameters) and
returns a DataFrame; nothing is collected to the driver except one-row
statistics and model metadata.
"""

__version__ = "0.1.0"
