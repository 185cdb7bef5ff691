"""corpusloom: retrieval, knowledge and quality analytics over text corpora, on Spark.

Every operator takes DataFrames and returns DataFrames.  Column helpers live in
``functions``, relational operators in ``operators``, readers and writers in
``sources``, whole workflows in ``plans`` and Structured Streaming in ``streaming``.
"""

__version__ = "0.1.0"
