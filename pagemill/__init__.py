"""Page-to-product analytics over a table of fetched web pages, on PySpark."""
