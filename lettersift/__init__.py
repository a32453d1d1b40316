"""Message-index and search engine on PySpark DataFrames."""
