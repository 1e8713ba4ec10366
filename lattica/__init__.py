"""An analytics engine on PySpark for property graphs, retrieval and question answering."""
