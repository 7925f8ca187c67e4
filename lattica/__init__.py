"""An analytics engine on PySpark for specimen-structured series, experiment records and weighted graphs."""
