"""chatloom: DataFrame operators that prepare and audit chat fine-tuning data on Spark.

Every operator takes DataFrames and returns DataFrames; nothing is collected to the
driver. See README.md for the operator map.
"""

__version__ = "0.1.0"
