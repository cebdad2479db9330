"""kelpgraph: graph, event-log and text analytics on PySpark DataFrames."""
