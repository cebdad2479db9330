"""kelpgraph subpackage."""
