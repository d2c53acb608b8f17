"""quern: a Spark-first engine for searching, curating and publishing document collections."""
