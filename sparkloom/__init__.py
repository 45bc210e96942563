"""sparkloom: an analytics engine expressed on the Spark DataFrame, SQL and streaming APIs."""
